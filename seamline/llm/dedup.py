"""Exact removal of long repeated strings with run-length indexes.

Every window of ``length`` bytes has an anchor: the leftmost of the least hashed ``anchor``-byte
strings in it. Equal windows have equal anchors at equal places, so windows can only match where
anchors do. Windows of one text with one anchor form a segment; segments whose anchor occurs once in
the corpus are dropped, equal ones are counted and kept once, and the rest go to run-length indexes,
whole anchors together and a text's overlapping segments merged, where matching statistics find the
windows that start elsewhere as well. Where an anchor has more text than an index takes, its windows are
dealt on by where the anchor stands in them and by the longer string that all windows of such a range
share, with narrower ranges until an index takes each group: a group's windows only match each other.
Ranges of one window are equal or not as a whole. Covered bytes are then cut from the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, table
from .rlbwt import RunIndex
from .textblock import TextBlock, blocks

LENGTH, ANCHOR = 400, 200
#: Bytes of text that one index takes.
INDEX_BYTES = 2_000_000
#: How many places of an anchor in its windows make a range, where the anchor has more text than that.
RANGES = (25, 5, 1)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, from prefix and suffix minima of blocks."""
    n = len(h)
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(h.dtype).max, h.dtype)
    padded[:n] = h
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(block: TextBlock, length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Segments of all texts: text, start (in the text), windows, and hashes of anchor and segment."""
    n = len(block.buf)
    none = {k: np.zeros(0, np.int64) for k in ("text", "start", "windows", "anchor", "segment")}
    if n < length:
        return none
    sums = block.sums()
    h = block.window_hash(sums, anchor)
    bits = np.uint64(n.bit_length())
    place = np.arange(len(h), dtype=np.uint64)
    seed = sliding_least(h >> bits << bits | place, length - anchor + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    size = np.diff(block.starts)
    valid = place[: len(seed)].view(np.int64) <= np.repeat(block.starts[1:] - length, size)[: len(seed)]
    text_first = np.zeros(len(seed), bool)
    text_first[block.starts[:-1][block.starts[:-1] < len(seed)]] = True
    change = text_first
    change[0] = True
    change[1:] |= (seed[1:] != seed[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(seed)] - 1
    first, last = first[valid[first]], last[valid[first]]
    own = np.searchsorted(block.starts, first, "right") - 1
    return {"text": own, "start": first - block.starts[own], "windows": last - first + 1, "anchor": h[seed[first]].view(np.int64), "segment": block.substring_hash(sums, first, last + length).view(np.int64)}


_SEGMENT_SQL = "anchor long, segment long, doc_id long, hash long, start int, windows short"


def _emit(length: int, anchor: int, anchors_only: bool):
    def emit(batches):
        for batch in batches:
            ids, hashes = batch.column(1), batch.column(2)
            for i, j, block in blocks(batch.column(0)):
                s = segments(block, length, anchor)
                if anchors_only:
                    yield pa.RecordBatch.from_arrays([pa.array(s["anchor"], pa.int64())], names=["anchor"])
                else:
                    at = pa.array(s["text"])
                    yield pa.RecordBatch.from_arrays([pa.array(s["anchor"], pa.int64()), pa.array(s["segment"], pa.int64()), ids.slice(i, j - i).take(at), hashes.slice(i, j - i).take(at), pa.array(s["start"], pa.int32()), pa.array(s["windows"], pa.int16())], names=["anchor", "segment", "doc_id", "hash", "start", "windows"])

    return emit


def _pieces(length: int):
    """Cut the requested segments out of each text; overlapping ones of one index become one piece."""

    def cut_out(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                data = row["text"].encode()
                asked = sorted(row["asked"], key=lambda x: (x["pack"], x["part"], x["start"]))
                k = 0
                while k < len(asked):
                    x = asked[k]
                    end, group = x["start"] + x["windows"] + length - 1, [x]
                    k += 1
                    while k < len(asked) and (asked[k]["pack"], asked[k]["part"]) == (x["pack"], x["part"]) and asked[k]["start"] < end:
                        end = max(end, asked[k]["start"] + asked[k]["windows"] + length - 1)
                        group.append(asked[k])
                        k += 1
                    rows.append({"pack": x["pack"], "part": x["part"], "doc_id": row["doc_id"], "hash": row["hash"], "start": x["start"], "piece": data[x["start"] : end], "anchors": [y["anchor"] for y in group], "segments": [y["segment"] for y in group], "starts": [y["start"] - x["start"] for y in group], "windows": [y["windows"] for y in group], "copies": [y["copies"] for y in group]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)

    return cut_out


_PIECE = pa.schema([("pack", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("start", pa.int32()), ("piece", pa.binary()), *[(k, pa.list_(pa.int64())) for k in ("anchors", "segments", "starts", "windows", "copies")]])
_PIECE_SQL = "pack long, part long, doc_id long, hash long, start int, piece binary, " + ", ".join(f"{k} array<long>" for k in ("anchors", "segments", "starts", "windows", "copies"))


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2].tolist(), edge[1::2].tolist()


def _joined(group: pd.DataFrame) -> tuple[list[bytes], list[int]]:
    """Texts of one index, and where each row's piece begins in it: parts' pieces of one text that overlap become one, so that no byte enters twice."""
    pieces, offsets, own, start, end, base = [], np.zeros(len(group), np.int64), None, 0, 0, 0
    order = np.lexsort((group["start"], group["hash"], group["doc_id"]))
    for k, doc_id, name, at, piece in zip(order, *(group[c].to_numpy()[order] for c in ("doc_id", "hash", "start", "piece")), strict=True):
        if own != (doc_id, name) or at >= end:
            base += len(pieces[-1]) + 1 if pieces else 0
            own, start, end = (doc_id, name), at, at + len(piece)
            pieces.append(piece)
        elif at + len(piece) > end:
            pieces[-1] += piece[end - at :]
            end = at + len(piece)
        offsets[k] = base + at - start
    return pieces, offsets.tolist()


def _search(length: int, most: int):
    """Repeated windows of each segment in a pack, by the indexes of its parts."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.drop_duplicates(["part", "doc_id", "hash", "start"]).sort_values(["part", "doc_id", "hash", "start"])
        size = pdf["piece"].map(len).groupby(pdf["part"]).sum()
        batch = (size.cumsum() // most).rename("batch")
        for _, group in pdf.join(batch, on="part").groupby("batch"):
            pieces, offsets = _joined(group)
            index = RunIndex(pieces, length)
            repeats = index.longest_elsewhere() >= length
            for offset, anchors, names, starts, windows, copies in zip(offsets, group["anchors"], group["segments"], group["starts"], group["windows"], group["copies"], strict=True):
                for a, s, start, w, c in zip(anchors, names, starts, windows, copies, strict=True):
                    first, last = _runs(repeats[offset + start : offset + start + w] if c == 1 else np.ones(w, bool))
                    if first:
                        out.append((a, s, first, last))
        return pd.DataFrame(out, columns=["anchor", "segment", "first", "last"])

    return search


def _narrowed(length: int, anchor: int, width: int):
    """Segments cut into ranges of ``width`` places of their anchor, each with what its windows share (core) and a name (sub)."""

    def narrow(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for a, s, start, w, c in zip(row["anchors"], row["segments"], row["starts"], row["windows"], row["copies"], strict=True):
                    data = row["piece"][start : start + w + length - 1]
                    block = TextBlock(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                    place = int(np.argmin(block.window_hash(block.sums(), anchor)[: length - anchor + 1]))
                    k = 0
                    while k < w:
                        low = (place - k) // width * width
                        high = min(low + width - 1, length - anchor)
                        n = min(w, place - low + 1) - k
                        core, sub = data[place - low : place - high + length], data[k : k + n + length - 1]
                        out.append({"core": hashlib.blake2b(low.to_bytes(4, "little") + core, digest_size=16).digest(), "sub": hashlib.blake2b(sub, digest_size=16).digest(), "anchor": a, "segment": s, "at": k, "windows": n, "copies": c, "text": sub})
                        k += n
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_NARROW)

    return narrow


_NARROW = pa.schema([("core", pa.binary()), ("sub", pa.binary()), ("anchor", pa.int64()), ("segment", pa.int64()), ("at", pa.int32()), ("windows", pa.int32()), ("copies", pa.int64()), ("text", pa.binary())])
_NARROW_SQL = "core binary, sub binary, anchor long, segment long, at int, windows int, copies long, text binary"


def _search_ranges(length: int, most: int):
    """Repeated windows of each range in a pack, by indexes over whole cores."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["core", "sub"])
        batch = pdf["text"].map(len).groupby(pdf["core"]).sum().cumsum() // most
        for _, group in pdf.join(batch.rename("batch"), on="core").groupby("batch"):
            texts = group["text"].tolist()
            repeats = RunIndex(texts, length).longest_elsewhere() >= length
            start = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
            for core, sub, at, w, c in zip(group["core"], group["sub"], start, group["windows"], group["copies"], strict=False):
                first, last = _runs(repeats[at : at + w] if c == 1 else np.ones(w, bool))
                if first:
                    out.append((core, sub, first, last))
        return pd.DataFrame(out, columns=["core", "sub", "first", "last"])

    return search


def _heavy_repeats(heavy: DataFrame, length: int, anchor: int, index_bytes: int) -> DataFrame | None:
    """anchor, segment, first, last: repeated windows of the segments of anchors that no index takes, by ever narrower ranges."""
    found = None
    for width in RANGES:
        subs = cut(heavy.mapInArrow(_narrowed(length, anchor, width), _NARROW_SQL))
        kinds = subs.groupBy("core", "sub").agg(F.first("windows").alias("windows"), F.sum("copies").alias("copies"), F.first("text").alias("text"))
        cores = kinds.groupBy("core").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum("copies").alias("n")).where("n > 1")
        sized = cut(kinds.join(cores.select("core", "bytes"), "core"))
        light = sized.where(F.col("bytes") <= index_bytes) if width > 1 else sized.where("copies > 1")
        packs = max(1, -(-(light.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // index_bytes))
        if width > 1:
            hits = light.withColumn("pack", F.pmod(F.xxhash64("core"), F.lit(packs))).groupBy("pack").applyInPandas(_search_ranges(length, index_bytes), "core binary, sub binary, first array<int>, last array<int>")
        else:
            hits = light.select("core", "sub", F.array(F.lit(0)).alias("first"), F.array(F.lit(1)).alias("last"))
        shifted = subs.join(hits, ["core", "sub"]).select("anchor", "segment", F.transform("first", lambda x: x + F.col("at")).alias("first"), F.transform("last", lambda x: x + F.col("at")).alias("last"))
        found = shifted if found is None else found.union(shifted)
        rest = sized.where(F.col("bytes") > index_bytes).select("core").distinct()
        if width == 1 or rest.isEmpty():
            break
        again = subs.join(rest, "core", "left_semi").select("anchor", "segment").distinct()
        tops = heavy.select("piece", F.explode(F.arrays_zip("anchors", "segments", "starts", "windows", "copies")).alias("x")).join(again, (F.col("x.anchors") == F.col("anchor")) & (F.col("x.segments") == F.col("segment")), "left_semi")
        heavy = cut(tops.select("piece", *[F.array(F.col(f"x.{c}")).alias(c) for c in ("anchors", "segments", "starts", "windows", "copies")]))
    return found.groupBy("anchor", "segment").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))


def cover(first: list[int], last: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs covered by windows that start in the runs [first, last)."""
    order = np.argsort(first, kind="stable")
    a, b = np.asarray(first, np.int64)[order], np.asarray(last, np.int64)[order] + length - 1
    if not len(a):
        return a, b
    reach = np.maximum.accumulate(b)
    new = np.r_[True, a[1:] > reach[:-1]]
    return a[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]]


def _remove(length: int):
    def remove(batches):
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": [], "spans": []}
            for text, repeats in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                repeats = repeats.as_py() or []
                a, b = cover([x for r in repeats for x in r["first"]], [x for r in repeats for x in r["last"]], length)
                edges = [0, *np.c_[a, b].ravel().tolist(), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(a))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
                out["spans"].append([f"{x}:{y}" for x, y in zip(edges[1:-1:2], edges[2:-1:2], strict=True)])
            yield pa.RecordBatch.from_pydict(out, schema=_REMOVED)

    return remove


_REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.string()))])
_REMOVED_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<string>"


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for each of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans (start:end in bytes).

    Removes each byte covered by a ``length``-byte string that also starts elsewhere in the texts,
    the same text included; matches never cross texts and are judged on the input. Null texts
    count as empty; texts under ``length`` bytes are kept. Repeated rows repeat each other's text and
    so lose all of it if long enough; null ids are allowed. Whole-number ids; other columns play no
    part. Empty input gives an empty result.
    """
    bound_batches(docs)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("key"), F.xxhash64("text").alias("hash"))
    long_enough = rows.where(F.octet_length("text") >= length).select("text", "key", "hash")
    anchors = cut(long_enough.mapInArrow(_emit(length, anchor, True), "anchor long").groupBy("anchor").count().where("count > 1").select("anchor"))  # written, so that the join may split a frequent anchor
    seen = cut(long_enough.mapInArrow(_emit(length, anchor, False), _SEGMENT_SQL).join(anchors, "anchor"))
    kinds = seen.groupBy("anchor", "segment", "windows").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "hash", "start")).alias("at"))
    by_anchor = kinds.groupBy("anchor").agg(F.sum(F.col("windows") + (length - 1)).alias("bytes"), F.min("at.doc_id").alias("home"))
    by_home = by_anchor.where(F.col("bytes") <= index_bytes).groupBy("home").agg(F.sum("bytes").alias("all"))
    total = cut(by_home)
    packs = max(1, -(-(total.agg(F.sum("all")).first()[0] or 0) // index_bytes))
    parts = F.ceil(F.coalesce(F.col("all"), F.lit(0)) / index_bytes).cast("long")
    part = F.when(parts <= 1, F.col("home")).otherwise(F.pmod(F.xxhash64("anchor"), parts))
    pack = F.when(F.col("bytes") > index_bytes, -1).when(parts <= 1, F.pmod(F.xxhash64("home"), F.lit(packs))).otherwise(packs + F.pmod(F.xxhash64("home", part), F.lit(packs)))
    asked = kinds.join(by_anchor, "anchor").join(total, "home", "left").select(F.col("at.doc_id").alias("want"), F.col("at.hash").alias("want_hash"), F.struct(pack.alias("pack"), F.when(parts <= 1, F.col("home")).otherwise(F.xxhash64("home", part)).alias("part"), F.col("at.start").alias("start"), F.col("windows").cast("long").alias("windows"), "anchor", "segment", "copies").alias("x"))
    asked = asked.groupBy("want", "want_hash").agg(F.collect_list("x").alias("asked"))
    pieces = cut(rows.select("key", "text", "hash").join(asked, (F.col("key") == F.col("want")) & (F.col("hash") == F.col("want_hash"))).select(F.col("key").alias("doc_id"), "hash", "text", "asked").mapInArrow(_pieces(length), _PIECE_SQL))
    found = pieces.where("pack >= 0").groupBy("pack").applyInPandas(_search(length, index_bytes), "anchor long, segment long, first array<int>, last array<int>")
    heavy = pieces.where("pack < 0").dropDuplicates(["doc_id", "hash", "start", "part"])
    if not heavy.isEmpty():
        found = found.union(_heavy_repeats(heavy, length, anchor, index_bytes))
    repeats = seen.join(found, ["anchor", "segment"]).select("doc_id", "hash", F.struct(F.transform("first", lambda x: x + F.col("start")).alias("first"), F.transform("last", lambda x: x + F.col("start")).alias("last")).alias("r"))
    repeats = repeats.groupBy(F.col("doc_id").alias("own"), F.col("hash").alias("own_hash")).agg(F.collect_list("r").alias("repeats"))
    joined = rows.join(repeats, (F.col("key") == F.col("own")) & (F.col("hash") == F.col("own_hash")), "left")
    return joined.select("doc_id", "text", "repeats").mapInArrow(_remove(length), _REMOVED_SQL)


def op4_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 400-byte repeats leave of all documents."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.array_join("spans", ",").alias("spans"))
