"""Byte-level BPE by corpus-level merge replay.

Tasks split texts into words and code each chunk of texts against the chunk's own list of words.
The lists are dealt into buckets by word, joined to one list of distinct words, and each distinct
word of the corpus is merged once: an inverted index leads from token pairs to the positions that
hold them, merges are applied in rank order over all words of a block, and only the neighbours of a
merged pair are looked up and indexed again. Ids go back to the chunks by the same two steps, and
codes turn into ids, which decode by table. Chunks are compared in parts, so that a word that every chunk
has brings one row a part, not one a chunk, to the task that merges it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of text coded against one list of words (one longer text stands alone).
CHUNK_CHARS = 12_000_000
#: Chunks to a bucket of words, most buckets, and chunks whose lists are compared at once.
BUCKET_CHUNKS, BUCKETS, PART_CHUNKS = 4, 256, 2048
#: Words merged at once, and words of texts turned into ids at once.
BLOCK_WORDS, SLICE_WORDS = 200_000, 500_000
#: Ends of the ranges of ranks by which postings wait, each about a tenth longer than the one before.
_ENDS = np.unique(np.r_[np.geomspace(256, 1 << 17, 66).astype(np.int64), np.iinfo(np.int32).max])
NONE = np.iinfo(np.int32).max


class Merges:
    """A vocabulary's ranks: of single bytes, and of the pairs that make a longer token."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.token = {v: k for k, v in self.rank.items()}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        keys, made = [], []
        for word, r in self.rank.items():
            for cut in range(1, len(word)):
                a, b = self.rank.get(word[:cut]), self.rank.get(word[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank that each pair merges into, NONE where it doesn't."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        n = int(size.sum())
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        right, left = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        right[(start + size - 1)[size > 0]] = -1
        left[start[size > 0]] = -1
        alive, rank = np.ones(n, bool), np.full(n, NONE, np.int32)
        waiting: list[list[np.ndarray]] = [[] for _ in _ENDS]
        postings: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        end = 0

        def post(at: np.ndarray) -> None:
            """Index positions under their pair: now if its rank comes before ``end``, else in the range that waits."""
            at = at[rank[at] < NONE]
            if not len(at):
                return
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            split = np.searchsorted(r, end)
            if split:
                cuts = np.flatnonzero(np.diff(r[:split])) + 1
                for part, k in zip(np.split(at[:split], cuts), r[np.r_[0, cuts]].tolist(), strict=True):
                    if k in postings:
                        postings[k].append(part)
                    else:
                        postings[k] = [part]
                        heapq.heappush(heap, k)
            if split < len(at):
                k = np.searchsorted(_ENDS, r[split:], "right")
                cuts = np.flatnonzero(np.diff(k)) + 1
                for part, which in zip(np.split(at[split:], cuts), k[np.r_[0, cuts]].tolist(), strict=True):
                    waiting[which].append(part)

        def look_up(at: np.ndarray) -> None:
            rank[at] = self.pair(ids[at], ids[right[at]])
            post(at)

        look_up(np.flatnonzero(right >= 0).astype(np.int32))
        for k, limit in enumerate(_ENDS):
            end = int(limit)
            if waiting[k]:
                at, waiting[k] = np.concatenate(waiting[k]), []
                post(at[alive[at] & (rank[at] < end)])
            while heap:
                r = heapq.heappop(heap)
                at = np.unique(np.concatenate(postings.pop(r)))
                at = at[alive[at] & (rank[at] == r)]
                if not len(at):
                    continue
                at, later = self._chosen(at, r, ids, left, right, word)
                gone = right[at]
                after, before = right[gone], left[at]
                ids[at], rank[at], alive[gone] = r, NONE, False
                right[at] = after
                left[after[after >= 0]] = at[after >= 0]
                look_up(np.unique(np.r_[at[after >= 0], before[before >= 0]]))
                if len(later):
                    post(later[alive[later]])
        flat = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4
        return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    def _chosen(self, at: np.ndarray, r: int, ids: np.ndarray, left: np.ndarray, right: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of rank r to merge at once, and those to look at again.

        Of overlapping ones every other, from the left. A word where a merge may open a pair of lower rank
        takes its leftmost only, as that pair has to go first.
        """
        apart = np.r_[True, right[at[:-1]] != at[1:]]
        place = np.arange(len(at))
        pick = (place - np.maximum.accumulate(np.where(apart, place, 0))) % 2 == 0
        own = word[at]
        lead = np.r_[True, own[1:] != own[:-1]]
        if lead[pick].all():
            return at[pick], at[:0]
        new = np.full(len(at), r, ids.dtype)
        before, after = left[at], right[right[at]]
        low = (before >= 0) & ((self.pair(ids[before], new) < r) | (self.pair(new, new) < r)) | (after >= 0) & (self.pair(new, ids[after]) < r)
        if not low.any():
            return at[pick], at[:0]
        careful = np.isin(own, own[low])
        take = np.where(careful, lead, pick)
        return at[take], at[~take & careful]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; a word that is a token is that token."""
        known = [self.rank.get(w) for w in words]
        rest = [w for w, r in zip(words, known, strict=True) if r is None]
        merged = iter([x for i in range(0, len(rest), BLOCK_WORDS) for x in self.replay(rest[i : i + BLOCK_WORDS])])
        return [r.to_bytes(4, "little") if r is not None else next(merged) for r in known]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of an id sequence."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def merges(name: str) -> Merges:
    """The vocabulary that the driver sent along under this name."""
    with open(SparkFiles.get(name), "rb") as f:
        return Merges(f.read())


class _Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2**32, their bytes of one weight together, compressed."""
    x = x.astype("<u4")
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:4], "little")
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)).tolist()
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends][:-1], ends, strict=True)]


def pack_ids(ids: list[bytes]) -> bytes:
    """Several id sequences: how many there are, their lengths, and all ids."""
    return pack_numbers(np.r_[np.array([len(ids), *(len(x) // 4 for x in ids)], "<u4"), np.frombuffer(b"".join(ids), "<u4")])


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = unpack_numbers(data)
    n = int(x[0])
    return x[1 : n + 1].astype(np.int64), x[n + 1 :]


def _coded(name: str, pattern: str, buckets: int, schema: pa.Schema):
    """A row for each chunk: words a text, codes (by falling frequency), the rank of each code's word (2**32 - 1: no token), and of the others, by bucket, codes and words."""

    def code(batches):
        vocabulary, find = merges(name), regex.compile(pattern).findall
        pid, count = TaskContext.get().partitionId(), 0
        known, codes, numbers, kept, size = _Codes(), array("I"), [], [], 0

        def chunk():
            x = np.frombuffer(codes, np.uintc)
            order = np.argsort(-np.bincount(x, minlength=len(known)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words = [w.encode() for w in known]
            ranks = np.array([vocabulary.rank.get(w, 0xFFFFFFFF) for w in words], np.uint32)
            rest = sorted((zlib.crc32(w) % buckets, w, c) for w, c, r in zip(words, place.tolist(), ranks.tolist(), strict=True) if r == 0xFFFFFFFF)
            lists, i = [], 0
            while i < len(rest):
                j = i
                while j < len(rest) and rest[j][0] == rest[i][0]:
                    j += 1
                lists.append({"bucket": rest[i][0], "words": pack_words([w for _, w, _ in rest[i:j]])})
                i = j
            seal = zlib.crc32(b"".join(x["words"] for x in lists))
            head = [pa.array([pid << 24 | count], pa.int64()), pa.array([numbers], pa.list_(pa.int64())), pa.array([pack_numbers(place[x])], pa.binary()), pa.array([pack_numbers(ranks[order])], pa.binary()), pa.array([pack_numbers(np.array([c for _, _, c in rest]))], pa.binary()), pa.array([lists], schema.field("lists").type), pa.array([seal], pa.int64())]
            columns = [pa.concat_arrays([x[k] for x in kept]) for k in range(len(kept[0]))]
            return pa.RecordBatch.from_arrays([*head, *(pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), c) for c in columns)], names=schema.names)

        for batch in batches:
            for i, text in enumerate(batch.column(0)):
                text = text.as_py() or ""
                if numbers and size + len(text) > CHUNK_CHARS:
                    yield chunk()
                    count += 1
                    known, codes, numbers, kept, size = _Codes(), array("I"), [], [], 0
                before = len(codes)
                codes.extend(map(known.__getitem__, find(text)))
                numbers.append(len(codes) - before)
                kept.append([batch.column(k).slice(i, 1) for k in range(1, batch.num_columns)])
                size += len(text)
        if numbers:
            yield chunk()

    return code


def _lists(parts: int):
    def split(batches):
        for batch in batches:
            for chunk, lists, seal in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                part = zlib.crc32(chunk.to_bytes(8, "little")) % parts
                yield pa.RecordBatch.from_pylist([{"bucket": x["bucket"], "part": part, "chunk": chunk, "seal": seal, "words": x["words"]} for x in lists], schema=_LIST)

    return split


_LIST = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("seal", pa.int64()), ("words", pa.binary())])
_LIST_SQL = "bucket long, part long, chunk long, seal long, words binary"
_WORDS_SQL = "bucket long, sub long, part long, words binary"
_MERGED_SQL = "bucket long, part long, words binary, ids binary"
_TOLD_SQL = "chunk long, bucket long, seal long, ids binary"


def _distinct(buckets: int, parts: int):
    """The distinct words of a bucket in a part, dealt on by word."""

    def gather(group: pa.Table) -> pa.Table:
        words = set()
        for data in group.column("words"):
            words.update(unpack_words(data.as_py()))
        dealt: dict[int, list[bytes]] = {}
        for w in sorted(words):
            dealt.setdefault(zlib.crc32(w) // buckets % parts, []).append(w)
        n, bucket, part = len(dealt), group.column("bucket")[0].as_py(), group.column("part")[0].as_py()
        return pa.table({"bucket": [bucket] * n, "sub": list(dealt), "part": [part] * n, "words": [pack_words(x) for x in dealt.values()]}, schema=pa.schema([("bucket", pa.int64()), ("sub", pa.int64()), ("part", pa.int64()), ("words", pa.binary())]))

    return gather


def _merged(name: str):
    """Every distinct word once through the merges, its ids told to each part that has it."""

    def merge(group: pa.Table) -> pa.Table:
        lists = [unpack_words(x.as_py()) for x in group.column("words")]
        words = sorted({w for x in lists for w in x})
        ids = dict(zip(words, merges(name).encode_words(words), strict=True))
        return pa.table({"bucket": group.column("bucket"), "part": group.column("part"), "words": group.column("words"), "ids": pa.array([pack_ids([ids[w] for w in x]) for x in lists], pa.binary())})

    return merge


def _told(left: pa.Table, right: pa.Table) -> pa.Table:
    """Ids of each chunk's words of a bucket, in the chunk's order."""
    ids: dict[bytes, bytes] = {}
    for words, data in zip(right.column("words"), right.column("ids"), strict=True):
        n, flat = unpack_ids(data.as_py())
        ends, flat = (np.cumsum(n) * 4).tolist(), flat.tobytes()
        ids.update(zip(unpack_words(words.as_py()), (flat[a:b] for a, b in zip([0, *ends][:-1], ends, strict=True)), strict=True))
    out = [pack_ids([ids[w] for w in unpack_words(x.as_py())]) for x in left.column("words")]
    return pa.table({"chunk": left.column("chunk"), "bucket": left.column("bucket"), "seal": left.column("seal"), "ids": pa.array(out, pa.binary())})


def check_seals(chunk: list[int], told: list[int]) -> None:
    """Fail where ids answer another list of words than the chunk's: rows came in another order when a lost exchange was made again."""
    if len(chunk) != 1 or set(told) - set(chunk):
        raise ValueError("rows of a chunk changed between reads: give texts from files or a cut table")


def _texts(name: str, keep: int, with_ids: bool, schema: pa.Schema):
    """The rows of a chunk: its codes turned into ids, digested and decoded."""

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        vocabulary = merges(name)
        check_seals(left.column("seal").to_pylist(), right.column("seal").to_pylist())
        ranks = unpack_numbers(left.column("ranks")[0].as_py())
        codes = unpack_numbers(left.column("codes")[0].as_py())
        order = unpack_numbers(left.column("rest")[0].as_py())
        told = [unpack_ids(right.column("ids")[k].as_py()) for k in np.argsort(right.column("bucket").to_numpy(), kind="stable").tolist()]
        n, flat = np.ones(len(ranks), np.int64), np.concatenate([*(x for _, x in told), ranks])
        first = len(flat) - len(ranks) + np.arange(len(ranks))
        if told:
            n[order] = np.concatenate([x for x, _ in told])
            first[order] = np.cumsum(n[order]) - n[order]
        words = np.array(left.column("n")[0].as_py(), np.int64)
        bounds = np.r_[0, np.cumsum(words)]
        tokens, of_ids, decoded, ids = [], [], [], []
        i = 0
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE_WORDS, "right")) - 1)
            c = codes[bounds[i] : bounds[j]]
            length = n[c]
            ends = np.cumsum(length)
            x = flat[np.repeat(first[c] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")
            edges = np.r_[0, ends][bounds[i : j + 1] - bounds[i]].tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                tokens.append(b - a)
                of_ids.append(hashlib.sha256(x[a:b].tobytes()).hexdigest())
                decoded.append(hashlib.sha256(vocabulary.decode(x[a:b])).hexdigest())
                if with_ids:
                    ids.append(x[a:b].astype(np.int32))
            i = j
        kept = [left.column(f"k{k}").combine_chunks().flatten() for k in range(keep)]
        return pa.Table.from_arrays([*kept, pa.array(tokens, pa.int64()), pa.array(of_ids), pa.array(decoded), *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], schema=schema)

    return finish


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], text_col: str = "text", with_ids: bool = True, chars: int | None = None) -> DataFrame:
    """The columns ``keep`` of each row, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (list of int).

    Null texts count as empty: no ids, the hashes of no bytes. Texts are encoded whole, without
    special tokens. Repeated rows and ids are encoded each; ``keep`` may have any names but those
    added. Empty input gives an empty result. The ranks file goes to executors as a job file.
    Rows come in no fixed order. Chunks are made of rows in the order in which they are read; if that changes while a lost
    exchange is made again, seals of the chunks' words differ and the job fails rather than mix up ids. ``chars``: about how many characters there are, counted unless given.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bound_batches(docs)
    docs.sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]
    if chars is None:
        chars = docs.agg(F.sum(F.length(F.col(f"`{text_col}`")))).first()[0] or 0
    chunks = -(-chars // CHUNK_CHARS)
    buckets, parts = max(1, min(BUCKETS, -(-chunks // BUCKET_CHUNKS))), max(1, -(-chunks // PART_CHUNKS))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    coded_sql = ", ".join(["chunk long, n array<long>, codes binary, ranks binary, rest binary, lists array<struct<bucket: int, words: binary>>, seal long", *(f"k{i} array<{kinds[c]}>" for i, c in enumerate(keep))])
    out_sql = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * with_ids])
    arrow = lambda sql: to_arrow_schema(StructType.fromDDL(sql))
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    coded = rows.mapInArrow(_coded(name, pattern, buckets, arrow(coded_sql)), coded_sql).repartition("chunk")  # one exchange, read twice
    lists = coded.mapInArrow(_lists(parts), _LIST_SQL).repartition("bucket", "part")
    words = lists.groupBy("bucket", "part").applyInArrow(_distinct(buckets, parts), _WORDS_SQL)
    merged = words.groupBy("bucket", "sub").applyInArrow(_merged(name), _MERGED_SQL)
    told = lists.groupBy("bucket", "part").cogroup(merged.groupBy("bucket", "part")).applyInArrow(_told, _TOLD_SQL)
    out = coded.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_texts(name, len(keep), with_ids, arrow(out_sql)), out_sql)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)


def op6_merge_replay_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), str(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN, ["doc_id"], with_ids=False)
