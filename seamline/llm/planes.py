"""Token ids in files of bit-plane shuffled blocks, in ascending document order.

Rows are dealt by ranges of doc_id, and each task encodes its sorted texts and writes them as it goes. A file
holds blocks of BLOCK ids. A block is transposed into planes - all first bytes of its ids, all second bytes,
or in the same way all bits of one weight -, planes above the block's largest id are left out, and each plane is
a zstandard frame of its own. After the blocks stand the documents' ids and lengths, then the index, which gives
each block's place, ids, check sum and planes, then a tail of fixed size. Readers look the index up and
fetch only the blocks that they need.

Layout, little-endian: blocks; documents (three byte-plane blocks: low and high halves of doc_id as stored, and lengths
in halves; validity bits); index; tail (index place, index bytes, documents' place, blocks, documents, kind, magic).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.plans.lineage import own_folder

from .common import bound_batches, table

TOKENIZER = "byte_bpe_50k.json"
#: The id after each document, ids of a block, ids after which a task begins a new file, and characters of text for each range.
END_ID, BLOCK, FILE_IDS, RANGE_CHARS = 2, 1 << 16, 1 << 26, 40_000_000
#: Words, and as many pieces, that a worker remembers, and characters of a text that are looked at together.
KNOWN_WORDS, SLICE_CHARS = 500_000, 1_000_000
KINDS = {"byte": 8, "bit": 1}
_MAGIC = b"seamids1"
_TAIL = struct.Struct("<QQQQQQ8s")
_ENTRY = struct.Struct("<QIIB")


# ---- planes


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The compressed planes of a block, least weight first; none above the largest id."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        planes = octets[: -(-bits // 8)]
    else:
        planes = [np.packbits(octets[k // 8] >> (k % 8) & 1, bitorder="little") for k in range(bits)]
    return [zstandard.compress(p.tobytes(), 3) for p in planes]


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    """The ids of a block as unsigned 32-bit integers."""
    octets = np.zeros((4, count), np.uint8)
    for k, plane in enumerate(planes):
        x = np.frombuffer(zstandard.decompress(plane), np.uint8)
        if kind == "byte":
            octets[k] = x
        else:
            octets[k // 8] |= np.unpackbits(x, count=count, bitorder="little") << np.uint8(k % 8)
    return np.ascontiguousarray(octets.T).view("<u4").ravel()


def _halves(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as all low halves, then all high ones."""
    return np.ascontiguousarray(x.astype("<u8").view("<u4").reshape(-1, 2).T).ravel()


def _whole(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(2, -1).T).view("<u8").ravel()


# ---- files


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it."""
    if re.match(r"file:/(?!//)", folder):
        folder = "file:///" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


class Writer:
    """One file; its name appears only when it is whole, so that a lost task leaves nothing that readers would see."""

    def __init__(self, folder: str, name: str, kind: str = "byte", block: int = BLOCK):
        self.fs, path = store(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.kind, self.block = f"{path}/{name}", kind, block
        self.draft = f"{path}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.index: list[tuple[int, int, int, list[int]]] = []
        self.waiting: list[np.ndarray] = []
        self.at = self.held = self.n_ids = 0
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.block:
            rest = np.concatenate(self.waiting)
            whole = len(rest) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(rest[i : i + self.block])
            self.waiting, self.held = [rest[whole:].copy()], len(rest) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = to_planes(ids, self.kind)
        self.index.append((self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), [len(p) for p in planes]))
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        blocks, place = len(self.index), self.at
        for x in (np.array([d or 0 for d in self.docs], np.int64), np.array(self.sizes, np.int64)):
            planes = to_planes(_halves(x), "byte")
            self.out.write(struct.pack("<B", len(planes)) + struct.pack(f"<{len(planes)}Q", *map(len, planes)) + b"".join(planes))
        self.out.write(np.packbits([d is not None for d in self.docs], bitorder="little").tobytes())
        index = b"".join(_ENTRY.pack(at, n, crc, len(p)) + struct.pack(f"<{len(p)}I", *p) for at, n, crc, p in self.index)
        index_at = self.out.tell()
        self.out.write(index)
        self.out.write(_TAIL.pack(index_at, len(index), place, blocks, len(self.docs), KINDS[self.kind], _MAGIC))
        self.out.close()
        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
            self.fs.delete_file(self.path)  # an earlier attempt of this task wrote the same
        self.fs.move(self.draft, self.path)


class Reader:
    """Index and documents of a file, and its blocks on demand."""

    def __init__(self, folder: str, name: str):
        system, path = store(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        end = self.file.size()
        index_at, size, docs_at, blocks, docs, bits, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, end - _TAIL.size))
        if magic != _MAGIC:
            raise ValueError(f"{name} is no file of token ids")
        self.kind = next(k for k, b in KINDS.items() if b == bits)
        data, at, self.blocks = self.file.read_at(size, index_at), 0, []
        for _ in range(blocks):
            place, n, crc, planes = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            self.blocks.append((place, n, crc, struct.unpack_from(f"<{planes}I", data, at)))
            at += 4 * planes
        self.bounds = np.cumsum([0, *(b[1] for b in self.blocks)])
        data, at, found = self.file.read_at(index_at - docs_at, docs_at), 0, []
        for _ in range(2):
            planes = data[at]
            sizes = struct.unpack_from(f"<{planes}Q", data, at + 1)
            at += 1 + 8 * planes
            parts = []
            for s in sizes:
                parts.append(data[at : at + s])
                at += s
            found.append(_whole(from_planes(parts, 2 * docs, "byte")).astype(np.int64))
        self.doc_ids, self.sizes = found
        self.valid = np.unpackbits(np.frombuffer(data[at:], np.uint8), count=docs, bitorder="little").astype(bool)

    def read(self, k: int) -> np.ndarray:
        """Block k, checked."""
        place, n, crc, sizes = self.blocks[k]
        data, at, planes = self.file.read_at(sum(sizes), place), 0, []
        for s in sizes:
            planes.append(data[at : at + s])
            at += s
        ids = from_planes(planes, n, self.kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def between(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1 of the file, from the blocks that hold them."""
        if first >= last:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(self.bounds, [first, last - 1], "right") - 1
        ids = np.concatenate([self.read(k) for k in range(a, b + 1)])
        return ids[first - self.bounds[a] : last - self.bounds[a]]

    def documents(self, with_ids: bool) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """Length, unsigned crc32 and, if asked for, ids of each document; one block is held at a time, and a document's ids if asked for."""
        k, ids = -1, np.zeros(0, "<u4")
        for size in self.sizes.tolist():
            crc, need, parts = 0, size, []
            while need:
                if not len(ids):
                    k += 1
                    ids = self.read(k)
                part, ids = ids[:need], ids[need:]
                crc = zlib.crc32(part.tobytes(), crc)
                need -= len(part)
                if with_ids:
                    parts.append(part)
            yield size, crc, np.concatenate(parts) if parts else None


# ---- encoding


class _Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class _Memory:
    """Numbered strings, and the ids of each in one array."""

    def __init__(self):
        self.known, self.size, self.first, self.flat = _Codes(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def numbers(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))

    def learn(self, size: np.ndarray, order: np.ndarray, parts: list[np.ndarray]) -> None:
        """Sizes of the next strings (-1: no ids), and the ids of those at the places ``order``."""
        first, count = np.zeros(len(size), np.int64), size[order]
        first[order] = len(self.flat) + np.cumsum(count) - count
        self.first, self.size, self.flat = np.r_[self.first, first], np.r_[self.size, size], np.concatenate([self.flat, *parts])

    def ids(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of these strings in a row, ``size`` of each."""
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.first[codes] - ends + size, size) + np.arange(ends[-1])]


_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: A word of Latin letters and ASCII alone, without white space at an end, and the pieces that the byte-level pattern makes of such words.
_PLAIN = re.compile(f"[!-~{_LETTERS}](?:[\\t\\n\\r!-~{_LETTERS}]*[!-~{_LETTERS}])?")
_PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")
#: The setting of the tokenizer under which its pattern is that one.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: How byte-level vocabularies write bytes: those that Latin-1 shows as they are, the others as characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELT = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Coder:
    """The tokenizers library behind a memory of words.

    The vocabulary's pattern begins a new piece at each space that stands between two characters that aren't white space,
    so what stands between such spaces has the same ids in every text, and is given to the library once. Slices where
    spaces stand otherwise go to the library as they are. Many words are one of few pieces with other marks or lines around it:
    where the pattern is the usual byte-level one, plain words are put together from pieces, and the library gets each piece once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # how byte-level vocabularies write a space
        setting = json.loads(self.tokenizer.to_str())
        pattern = setting["pre_tokenizer"] or {}
        self.by_pieces = setting["normalizer"] is None and all(pattern.get(k) == v for k, v in _BYTE_LEVEL.items())
        self.model = self.tokenizer.model
        self.pieces, self.words = _Memory(), _Memory()

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces without white space but a first space: what the pattern leaves whole needs only the library's merges."""
        spelt = "\n".join(pieces).encode().decode("latin-1").translate(_SPELT).split(_SPELT[10])
        return [np.array([t.id for t in self.model.tokenize(p)], np.uint32) for p in spelt]

    def _from_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of plain words, each after a space."""
        if len(self.pieces.known) > KNOWN_WORDS:
            self.pieces = _Memory()
        before, found = len(self.pieces.known), _PIECES.findall(" " + " ".join(words))
        codes = self.pieces.numbers(found)
        fresh = list(islice(self.pieces.known, before, None))
        blank = np.fromiter(map(str.isspace, fresh), bool, len(fresh))
        if fresh:
            got = self._by_model([p for p in fresh if not p.isspace()]) if not blank.all() else []
            got += self.library([p for p in fresh if p.isspace()])
            order, size = np.r_[np.flatnonzero(~blank), np.flatnonzero(blank)], np.empty(len(fresh), np.int64)
            size[order] = [len(x) for x in got]
            self.pieces.learn(size, order, got)
        heads = np.flatnonzero(np.fromiter((p[0] == " " for p in found), bool, len(found)))
        size = self.pieces.size[codes]
        return np.add.reduceat(size, heads), self.pieces.ids(codes, size)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. A size of -1 marks one with white space at an end, which has no ids of its own.

        A word that begins a text is written with a space before it, as other words have none in them.
        """
        plain = np.fromiter((self.by_pieces and _PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        size, parts = np.full(len(words), -1, np.int64), []
        if plain.any():
            size[plain], ids = self._from_pieces([w for w, ok in zip(words, plain.tolist(), strict=True) if ok])
            parts.append(ids)
        got = self._by_library([w for w, ok in zip(words, plain.tolist(), strict=True) if not ok])
        size[~plain] = [-1 if x is None else len(x) for x in got]
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain & (size >= 0))]
        self.words.learn(size, order, [*parts, *(x for x in got if x is not None)])

    def _by_library(self, words: list[str]) -> list[np.ndarray | None]:
        fit = [bool(w.lstrip(" ")) and not w[-1].isspace() and not w.removeprefix(" ")[0].isspace() for w in words]
        inner = [w for w, ok in zip(words, fit, strict=True) if ok and w[0] != " "]
        heads = self.library([w[1:] for w, ok in zip(words, fit, strict=True) if ok and w[0] == " "])
        found: list[np.ndarray] = []
        if inner:
            ids = self.library([" " + " ".join(inner)])[0]
            cuts = np.flatnonzero(self.opens[ids])
            found = np.split(ids, cuts[1:]) if len(cuts) == len(inner) else self.library([" " + w for w in inner])
        inner_at, head_at = iter(found), iter(heads)
        return [(next(head_at) if w[0] == " " else next(inner_at)) if ok else None for w, ok in zip(words, fit, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them for the whole text."""
        if len(self.words.known) > KNOWN_WORDS:
            self.words = _Memory()
        slices, owner = [], []
        for k, text in enumerate(texts):
            for part in _slices(text):
                slices.append(part)
                owner.append(k)
        if not slices:
            return []
        before = len(self.words.known)
        split = pc.split_pattern(pa.array([part for _, part in slices], pa.large_string()), " ")
        starts, words = split.offsets.to_numpy().astype(np.int64), split.values.dictionary_encode()
        codes = self.words.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        goes_on = np.array([g for g, _ in slices])
        codes[starts[:-1][~goes_on]] = self.words.numbers([" " + part.split(" ", 1)[0] for g, part in slices if not g])
        fresh_words = list(islice(self.words.known, before, None))
        for i in range(0, len(fresh_words), 50_000):
            self._learn(fresh_words[i : i + 50_000])
        size = self.words.size[codes]
        size[starts[:-1][goes_on]] = 0  # nothing, before the space that such a slice begins with
        whole = np.minimum.reduceat(size, starts[:-1]) < 0
        size[np.repeat(whole, np.diff(starts))] = 0
        ids, ends = self.words.ids(codes, size), np.r_[0, np.cumsum(size)][starts]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for (_, part), k, a, b, w in zip(slices, owner, ends[:-1].tolist(), ends[1:].tolist(), whole.tolist(), strict=True):
            out[k].append(self.library([part])[0] if w else ids[a:b])
        return [np.concatenate(x) for x in out]


_CUT = re.compile(r"(?<=\S) (?=\S)")


def _slices(text: str) -> Iterator[tuple[bool, str]]:
    """A text in slices of about SLICE_CHARS, and whether each goes on with the space that it was cut before. A text without such a space stays whole."""
    at = 0
    while len(text) - at > SLICE_CHARS and (cut := _CUT.search(text, at + SLICE_CHARS)):
        yield at > 0, text[at : cut.start()]
        at = cut.start()
    yield at > 0, text[at:]


@lru_cache(maxsize=2)
def coder(name: str) -> Coder:
    """The tokenizer that the driver sent along under this name, once a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Coder(SparkFiles.get(name))


# ---- Spark

_MANIFEST = "part long, seq long, name string, n_docs long, n_ids long"


def _write(folder: str, name: str, end_id: int, kind: str, block: int, file_ids: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, None

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "name": [out.path.rsplit("/", 1)[-1]], "n_docs": [len(out.docs)], "n_ids": [out.n_ids]})

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder(name).encode(texts), strict=True):
                if out is None:
                    out = Writer(folder, f"ids-{part:06d}-{seq:04d}", kind, block)
                out.add(doc_id, np.r_[ids, np.uint32(end_id)].astype(np.uint32))
                if out.n_ids >= file_ids:
                    yield done()
                    seq, out = seq + 1, None
        if out is not None:
            yield done()

    return write


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", kind: str = "byte", block: int = BLOCK, file_ids: int = FILE_IDS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Encode all rows into files of ``folder``, in ascending ``id_col``, and return the table of the files, which is kept beside them.

    Each row's ids are followed by ``end_id``. Null and empty texts are that id alone. Null ids come first; rows that repeat an id
    are ordered by their text's hash, then text. Strings like special tokens are ordinary text. An empty table gives no files.
    Other columns don't matter. The folder is new; its store must be one that Arrow opens (local or mounted paths, HDFS, S3, GCS).
    """
    spark = docs.sparkSession
    bound_batches(docs)
    spark.sparkContext.addFile(tokenizer)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(max(1, -(-chars // range_chars)), *order[:2]).sortWithinPartitions(*order)
    files = dealt.mapInArrow(_write(folder, tokenizer.rsplit("/", 1)[-1], end_id, kind, block, file_ids), _MANIFEST)
    files.write.parquet(f"{folder}/files")
    return open_ids(spark, folder)


def open_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder that ``write_ids`` wrote: name, n_docs, n_ids and ``start``, the ids of all files before.

    Sums run within runs of 1,024 tasks and then over the runs' sums, so that only the latter meet in one task.
    """
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/files").withColumn("run", F.expr("part div 1024"))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = files.groupBy("run").agg(F.sum("n_ids").alias("n_ids")).select("run", before(Window.orderBy("run")).alias("run_start"))
    inside = files.withColumn("inside", before(Window.partitionBy("run").orderBy("part", "seq")))
    return inside.join(runs, "run").select(F.lit(folder).alias("folder"), "name", "n_docs", "n_ids", (F.col("run_start") + F.col("inside")).alias("start"))


def _documents(with_ids: bool, batch_rows: int, batch_ids: int):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                file, start = Reader(f["folder"], f["name"]), f["start"]
                rows, held = [], 0
                for doc_id, valid, (size, crc, ids) in zip(file.doc_ids.tolist(), file.valid.tolist(), file.documents(with_ids), strict=True):
                    rows.append((doc_id if valid else None, start, size, crc, ids))
                    start += size
                    held += size
                    if len(rows) == batch_rows or with_ids and held > batch_ids:
                        yield _rows(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, with_ids)

    return read


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc_id, start, size, crc, ids = zip(*rows, strict=True)
    columns = {"doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
    if with_ids:
        columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)


def read_documents(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document in the files of ``open_ids``; a file is one task's, block by block."""
    n = files.count()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.repartition(max(1, n), "name").mapInArrow(_documents(with_ids, 10_000, 1_000_000), schema)


def _windows(length: int):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                file, end = Reader(f["folder"], f["name"]), f["start"] + f["n_ids"]
                for k in range(f["first"], f["last"] + 1):
                    a, b = max(k * length, f["start"]), min((k + 1) * length, end)
                    ids = file.between(a - f["start"], b - f["start"]).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({"w": pa.array([k], pa.int64()), "at": pa.array([a], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return read


def read_windows(files: DataFrame, length: int, wanted: DataFrame) -> DataFrame:
    """(window, ids) for the windows numbered in ``wanted`` (window long): ids window * length up to the next, across documents and files.

    Only blocks that a wanted window touches are read; windows that cross files are put together. Numbers beyond the end give no row, and the
    last window may be short.
    """
    asked = wanted.select(F.col("window").alias("w")).distinct().where("w >= 0")
    span = files.withColumns({"lo": F.expr(f"start div {length}"), "hi": F.expr(f"(start + n_ids - 1) div {length}")})
    # windows meet files by runs of windows, so that the join is one of equal keys
    by_run = 1024
    runs = span.withColumn("run", F.explode(F.sequence(F.expr(f"lo div {by_run}"), F.expr(f"hi div {by_run}"))))
    pairs = asked.withColumn("run", F.expr(f"w div {by_run}")).join(runs, "run").where("w between lo and hi")
    parts = pairs.select("folder", "name", "start", "n_ids", F.col("w").alias("first"), F.col("w").alias("last")).mapInArrow(_windows(length), "w long, at long, ids array<int>")
    return parts.groupBy("w").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids")).select(F.col("w").alias("window"), "ids")


def op12_bit_plane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ids and read back from the files."""
    import public_tokenizers

    files = write_ids(table(spark, sf_dir, "documents"), own_folder(spark, "ids"), str(public_tokenizers.path(TOKENIZER)))
    return read_documents(files)
