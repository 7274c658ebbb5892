"""Collocations by hierarchical pair naming.

Texts become chunks of word codes. A chunk deals its distinct words, with their counts, into buckets by hash, packed as one list a
bucket; a bucket sums the lists of all chunks, names what is frequent, and answers each chunk with the names that it may use. Then
adjacent names make pairs, counted and named in the same way: a frequent phrase of k words is the pair of the names of its first
and its last k - 1 words. A pair that is everywhere brings an entry a chunk, not one for each place. A name's two
parents lead to all its parts: the counts at its cuts, and the shorter phrases that it may make superfluous.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import pack_words, unpack_words
from .common import bound_batches, discard, table, written
from .textblock import mix

#: Least count of a candidate, words of the longest, the share (of 100) of its count at which a longer one replaces it, phrases a language.
LEAST, LONGEST, REPLACED, TOP = 30, 4, 80, 2_000
#: Words of a chunk, and bytes of a text that are split together.
CHUNK_WORDS, SLICE_BYTES = 1_000_000, 1 << 20
#: Entries of a bucket, about.
BUCKET_ENTRIES = 1_500_000
#: A name is its phrase's words (up to 7), its bucket, and its number there, from these bits on. A chunk's number is its task's and, in the low bits, a count.
WORDS_BITS, BUCKET_BITS, COUNT_BITS = 60, 36, 16
#: Parts of a language's phrases that are ranked apart, before their best are ranked together.
RANKED_PARTS = 64

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BREAKS = rb".,;:!?\n-\r"
_TOKEN = re.compile(rb"[^ \t" + _BREAKS + rb"]+|[" + _BREAKS + rb"]+")
_GAP = re.compile(rb"[ \t" + _BREAKS + rb"]")
_BREAK = re.compile(rb"[" + _BREAKS + rb"]")


class _Words(dict):
    """Codes of a language's words in a chunk, given when first asked for; runs of breaks are -1."""

    def __init__(self, language: str, listed: list[tuple[str, bytes]]):
        self.language, self.listed = language, listed

    def __missing__(self, token: bytes) -> int:
        if _BREAK.match(token):
            n = -1
        else:
            n = len(self.listed)
            self.listed.append((self.language, token))
        self[token] = n
        return n


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers, their bytes of one weight together, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 6)


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _dense(name: np.ndarray, spread: int) -> np.ndarray:
    """Names of one level, dealt by ``spread`` buckets, as numbers without gaps between buckets."""
    bucket = name >> BUCKET_BITS & (1 << WORDS_BITS - BUCKET_BITS) - 1
    return (name & (1 << BUCKET_BITS) - 1) * spread + bucket


def pack_pairs(l: np.ndarray, r: np.ndarray) -> dict[str, bytes]:
    """Different pairs of dense names in ascending order as their steps, none of which is negative."""
    step = np.diff(l, prepend=0)
    begins = step > 0
    begins[:1] = True
    return {"l": pack(step), "r": pack(np.where(begins, r, np.diff(r, prepend=0)))}


def unpack_pairs(l: bytes, r: bytes, words: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of phrases of ``words`` words from what ``pack_pairs`` gave."""
    step, r = unpack(l), unpack(r)
    begins = step > 0
    begins[:1] = True
    total, at = np.cumsum(r), np.flatnonzero(begins)
    r = total - np.repeat(total[at] - r[at], np.diff(np.r_[at, len(r)]))
    return tuple(words << WORDS_BITS | x % spread << BUCKET_BITS | x // spread for x in (np.cumsum(step), r))


#: What chunks hand on: their state (bucket -1: codes of places from 1, 0 for none, and lead) and a list a bucket (places in the chunk, counts, and words or both parents).
_LISTS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("lead", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("l", pa.binary()), ("r", pa.binary())])
_LISTS_SQL = "chunk long, bucket long, lead long, places binary, counts binary, words binary, l binary, r binary"
#: What buckets say: to a chunk, the names of some of its places; and, a row each, the names.
_TOLD = pa.schema([("chunk", pa.int64()), ("places", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("f", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("lang", pa.string()), ("word", pa.string())])
_TOLD_SQL = "chunk long, places binary, ids binary, id long, f long, l long, r long, lang string, word string"


def _handed_on(chunk: int, lead: int, codes: np.ndarray, bucket: np.ndarray, counts: np.ndarray, lists) -> pa.Table:
    """A chunk's state, and its entries by bucket; ``lists`` packs the entries at some places."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    rows = [{"chunk": chunk, "bucket": -1, "lead": lead, "places": pack(codes.astype(np.int64) + 1)}, *({"chunk": chunk, "bucket": int(bucket[at[0]]), "places": pack(np.diff(at, prepend=0)), "counts": pack(counts[at]), **lists(at)} for at in parts)]
    return pa.Table.from_pylist(rows, schema=_LISTS)


class _Chunk:
    """Codes of words in order. ``lead`` words at its begin were counted by the chunk before, which ends within their text."""

    def __init__(self, language: str = "", before: Iterable[bytes] = ()):
        self.listed: list[tuple[str, bytes]] = []
        self.by_language: dict[str, _Words] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.add(language, list(before))
        self.lead = self.size

    def add(self, language: str, tokens: list[bytes]) -> None:
        if language not in self.by_language:
            self.by_language[language] = _Words(language, self.listed)
        self.parts.append(np.fromiter(map(self.by_language[language].__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(tokens)

    def stop(self) -> None:
        """End of a text: no phrase goes on."""
        self.parts.append(np.array([-1], np.int32))
        self.size += 1


def _first_level(chunk_words: int, longest: int, buckets: int):
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, chunk = TaskContext.get().partitionId(), 0, _Chunk()

        def done() -> list[pa.RecordBatch]:
            codes = np.concatenate(chunk.parts)
            counted = codes[chunk.lead :]
            counts = np.bincount(counted[counted >= 0], minlength=len(chunk.listed))
            words = [a.encode() + b"\t" + w for a, w in chunk.listed]  # words have no tabs
            bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
            return _handed_on(task << COUNT_BITS | number, chunk.lead, codes, bucket, counts, lambda at: {"words": pack_words([words[i] for i in at])}).to_batches()

        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, last = (text.as_py() or "").encode().translate(_FOLD), 0, deque(maxlen=longest - 1)
                while at < len(data):
                    gap = _GAP.search(data, at + SLICE_BYTES) if len(data) - at > SLICE_BYTES else None
                    end = gap.start() if gap else len(data)
                    tokens = _TOKEN.findall(data, at, end)
                    at = end
                    for i in range(0, len(tokens), chunk_words):
                        part = tokens[i : i + chunk_words]
                        chunk.add(language, part)
                        last.extend(part[-longest:])
                        if chunk.size >= chunk_words:
                            yield from done()
                            number, chunk = number + 1, _Chunk(language, last)
                chunk.stop()
        if chunk.listed:
            yield from done()

    return code


def _next_level(words: int, buckets: int, spread: int):
    """Pairs of adjacent names, phrases of ``words`` words, from a chunk's codes and the names of those that are frequent.

    A chunk numbers its pairs by bucket and then by name, so that lists hold small steps. ``spread``: buckets of the level before.
    """

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _LISTS.empty_table()
        codes, lead = unpack(left.column("places")[0].as_py()) - 1, left.column("lead")[0].as_py()
        places = np.concatenate([unpack(x.as_py()) for x in right.column("places")])
        span = max(int(codes.max(initial=0)), int(places.max(initial=0))) + 1
        name = np.full(span + 1, -1, np.int64)
        name[places] = np.concatenate([unpack(x.as_py()) for x in right.column("ids")])
        named = name[codes] >= 0  # code -1 looks at the last entry, which stays -1
        at = np.flatnonzero(named[:-1] & named[1:])
        pairs, inverse = np.unique(codes[at] * span + codes[at + 1], return_inverse=True)
        counts = np.bincount(inverse, weights=at + words - 1 >= lead, minlength=len(pairs)).astype(np.int64)
        l, r = name[pairs // span], name[pairs % span]
        with np.errstate(over="ignore"):
            bucket = (mix(mix(l.astype(np.uint64)) + r.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        l, r = _dense(l, spread), _dense(r, spread)
        order = np.lexsort((r, l, bucket))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        new = np.full(max(len(codes) - 1, 0), -1, np.int64)
        new[at] = number[inverse]
        l, r = l[order], r[order]
        return _handed_on(left.column("chunk")[0].as_py(), lead, new, bucket[order], counts[order], lambda k: pack_pairs(l[k], r[k]))

    return pair


def _answers(chunks: pa.ChunkedArray, place: np.ndarray, name: np.ndarray, ends: np.ndarray) -> list[dict]:
    """For each list (they end at ``ends``), the places that got a name, and the names."""
    out = []
    for chunk, a, b in zip(chunks.to_pylist(), np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
        at = a + np.flatnonzero(name[a:b] >= 0)
        if len(at):
            out.append({"chunk": chunk, "places": pack(place[at]), "ids": pack(name[at])})
    return out


def _summed(words: int, least: int, spread: int):
    """A bucket's lists summed: names for what is counted ``least`` times over all chunks, in the order of the keys. ``spread``: buckets of the level before."""

    def name(group: pa.Table) -> pa.Table:
        first = words << WORDS_BITS | group.column("bucket")[0].as_py() << BUCKET_BITS
        place = [np.cumsum(unpack(x.as_py())) for x in group.column("places")]
        ends, place = np.cumsum([len(p) for p in place]), np.concatenate(place)
        count = np.concatenate([unpack(x.as_py()) for x in group.column("counts")])
        if words == 1:
            listed = [w for x in group.column("words") for w in unpack_words(x.as_py())]
            number = {w: k for k, w in enumerate(sorted(set(listed)))}
            key = np.fromiter(map(number.__getitem__, listed), np.int64, len(listed))
            total = np.bincount(key, weights=count, minlength=len(number)).astype(np.int64)
        else:
            both = [unpack_pairs(a.as_py(), b.as_py(), words - 1, spread) for a, b in zip(group.column("l"), group.column("r"), strict=True)]
            l, r = (np.concatenate(x) for x in zip(*both, strict=True))
            order = np.lexsort((r, l))
            new = np.r_[True, (l[order][1:] != l[order][:-1]) | (r[order][1:] != r[order][:-1])]
            key = np.empty(len(order), np.int64)
            key[order] = np.cumsum(new) - 1
            total = np.add.reduceat(count[order], np.flatnonzero(new))
            l, r = l[order[new]], r[order[new]]
        often = np.flatnonzero(total >= least)
        ids = np.full(len(total), -1, np.int64)
        ids[often] = first + np.arange(len(often))
        told = pa.Table.from_pylist(_answers(group.column("chunk"), place, ids[key], ends), schema=_TOLD)
        names = {"id": ids[often], "f": total[often]}
        if words == 1:
            by_number = list(number)
            both = [by_number[k].decode().rsplit("\t", 1) for k in often.tolist()]
            names |= {"lang": [a for a, _ in both], "word": [w for _, w in both]}
        else:
            names |= {"l": l[often], "r": r[often]}
        n = len(often)
        return pa.concat_tables([told, pa.Table.from_arrays([pa.array(names[f.name], f.type) if f.name in names else pa.nulls(n, f.type) for f in _TOLD], schema=_TOLD)])

    return name


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language in first-level lists."""
    for batch in batches:
        n: dict[str, int] = {}
        for words, counts in zip(batch.column(0), batch.column(1), strict=True):
            for w, c in zip(unpack_words(words.as_py()), unpack(counts.as_py()).tolist(), strict=True):
                lang = w.rsplit(b"\t", 1)[0].decode()
                n[lang] = n.get(lang, 0) + c
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})


def _phrases(names: DataFrame, shorter: DataFrame, words: int) -> DataFrame:
    """Phrases of a level from their names and the phrases one word shorter, both parents looked up.

    firsts and lasts: counts of the first and the last 1, 2, ... words; parts: names of all shorter phrases of two words or more within.
    """
    side = lambda s: shorter.select(*[F.col(c).alias(s if c == "id" else f"{s}_{c}") for c in shorter.columns])
    parts = F.array().cast("array<long>") if words == 2 else F.array_distinct(F.concat("l_parts", "r_parts", F.array("l", "r")))
    both = names.join(side("l"), "l").join(side("r"), "r")
    return both.select("id", "f", F.col("l_lang").alias("lang"), F.concat_ws(" ", "l_phrase", "r_last_word").alias("phrase"), F.col("r_last_word").alias("last_word"), F.concat("l_firsts", F.array("l_f")).alias("firsts"), F.concat("r_lasts", F.array("r_f")).alias("lasts"), parts.alias("parts"))


_SCORED = """array_min(transform(sequence(1, size(firsts)), i -> named_struct(
    'score', (cast(2000000 as decimal(7, 0)) * cast(f as decimal(19, 0))) div (cast(firsts[i - 1] as decimal(19, 0)) + cast(lasts[size(lasts) - i] as decimal(19, 0))),
    'cut', i, 'l', firsts[i - 1], 'r', lasts[size(lasts) - i])))"""


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, replaced: int = REPLACED, top: int = TOP, text_col: str = "text", lang_col: str = "lang", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases of 2 to ``longest`` words.

    Null and empty texts have no words, a null language is ``und`` (one with rows of that name). Only A to Z are folded. Repeated rows count
    each. Phrases stay within pieces of a text. Languages without a candidate get no rows; an empty table gives none. Texts of any length
    are cut into chunks without losing a phrase. Extra columns don't matter.
    """
    bound_batches(docs)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = lambda entries: max(1, -(-entries // BUCKET_ENTRIES))
    spread, dealt = 0, buckets(chars // 12)  # buckets of the level before, and of this one
    level = written(rows.mapInArrow(_first_level(chunk_words, longest, dealt), _LISTS_SQL), "words")
    counts = level.where("bucket >= 0").select("words", "counts").mapInArrow(_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    totals = written(counts.where("n > 0"), "totals")
    names = []
    for words in range(1, longest + 1):
        lists = level.where("bucket >= 0").select("chunk", "bucket", "places", "counts", *(["words"] if words == 1 else ["l", "r"]))
        told = written(lists.groupBy("bucket").applyInArrow(_summed(words, least, spread), _TOLD_SQL), "named")
        names.append(told.where("id is not null").select("id", "f", *(["lang", "word"] if words == 1 else ["l", "r"])))
        if words < longest:
            live = names[-1].agg(F.sum("f")).first()[0] or 0  # places that have a name
            state = level.where("bucket = -1").select("chunk", "places", "lead")
            answers = told.where("id is null").select("chunk", "places", "ids")
            spread, dealt = dealt, buckets(live)
            last, level = level, written(state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_next_level(words + 1, dealt, spread), _LISTS_SQL), "pairs")
            discard(last)  # the next level is written, so nothing reads this one again
    discard(level)
    none = F.array().cast("array<long>")
    levels = [names[0].select("id", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last_word"), none.alias("firsts"), none.alias("lasts"), none.alias("parts"))]
    for words in range(2, longest + 1):
        levels.append(written(_phrases(names[words - 1], levels[-1], words), "phrases"))
    candidates = reduce(DataFrame.union, levels[1:])
    around = candidates.select(F.explode("parts").alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
    kept = candidates.join(around, "id", "left").where(F.expr(f"longer is null or 100 * longer < {replaced} * f"))
    scored = kept.withColumn("s", F.expr(_SCORED)).select("lang", "phrase", F.col("f").alias("a"), "s.l", "s.r", "s.score", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)).alias("part"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_pair_naming_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
g AS (SELECT lang, w[i : i + k - 1] AS w, k FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM p, range(1, 5) t(k))),
f AS (SELECT lang, w, k, count(*) AS f FROM g GROUP BY lang, w, k),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, w, k, f AS a FROM f WHERE k > 1 AND f >= 30),
s AS (
  SELECT c.lang, c.w, c.k, cut, a, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.w = c.w[1 : cut] JOIN f y ON y.lang = c.lang AND y.w = c.w[cut + 1 : c.k]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
sub AS (
  SELECT lang, w[i : i + m - 1] AS w, max(a) AS longer FROM (
    SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) t(m) WHERE m < k) GROUP BY ALL),
r AS (
  SELECT best.lang, array_to_string(best.w, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN sub ON sub.lang = best.lang AND sub.w = best.w
  WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM (
  SELECT r.*, n.n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r JOIN n USING (lang)) WHERE rank <= 2000
"""
