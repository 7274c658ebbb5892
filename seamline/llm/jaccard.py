"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and word shingles columns of a 0/1 matrix; its product with its transpose holds
the overlaps. To keep the product to rows that can matter, each distinct shingle set gives its
smallest shingle hashes, EXTRA hundredths more than linked sets are bound to share, and of these, the
rarest in the corpus that suffice for any linked pair to share one. Rows sharing such a column and
of near enough size are chained into families, linearly in their number. Families are then cut into
blocks of rows; for each pair of blocks all overlaps are accumulated over the whole sets, and pairs
under the bound that the two sizes set are discarded. Nothing is lost: the sketch and its rarest
part are exact prefix filters, and whole sets decide.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, cut, table
from .graph import components
from .shingles import shingle_sets
from .textblock import blocks

#: Hundredths of a set that its sketch holds beyond the least that an exact filter needs.
EXTRA = 10
#: Rows of a block of the product, and shingle fingerprints that one task counts.
ROWS, COUNTED = 512, 1_000_000
#: Grades of set size in one step of the largest ratio that linked sets have: these are up to GRADES grades apart.
GRADES = 4
#: Most dropped rows (an id and a hash each) that keep_one broadcasts; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def need(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of a set of size n with any set it is linked with."""
    return -(-n * num // den)


def sketch_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest hashes kept of a set of size n: two linked sets share 1 + EXTRA * smaller // 100 of them."""
    return np.minimum(n, n - need(n, num, den) + 1 + EXTRA * n // 100)


def chosen_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of the sketch's rarest hashes any linked pair shares one of."""
    return sketch_size(n, num, den) - EXTRA * need(n, num, den) // 100


def set_key(grams: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _sketches(width: int, num: int, den: int):
    def sketch(batches):
        pid, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, block in blocks(batch.column(1)):
                bounds, grams = shingle_sets(block, width)
                n = np.diff(bounds)
                p = np.where(n > 0, sketch_size(n, num, den), 0)
                keys = b"".join(set_key(grams[a:b]) if b > a else b"\0" * 16 for a, b in zip(bounds[:-1], bounds[1:], strict=True))
                part = np.concatenate([grams[a : a + k] for a, k in zip(bounds[:-1], p, strict=True)]) if block.n else grams
                yield pa.RecordBatch.from_pydict({"chunk": [pid << 22 | count], "ids": [batch.column(0).slice(i, j - i).to_pylist()], "hashes": [batch.column(2).slice(i, j - i).to_pylist()], "n": [n.tolist()], "keys": [keys], "p": [p.tolist()], "grams": [part.tobytes()]}, schema=_SKETCH)
                count += 1

    return sketch


_SKETCH = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("keys", pa.binary()), ("p", pa.list_(pa.int64())), ("grams", pa.binary())])
_SKETCH_SQL = "chunk long, ids array<long>, hashes array<long>, n array<long>, keys binary, p array<long>, grams binary"


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            m = len(row["ids"])
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * m, pa.int64()), pa.array(range(m), pa.int64()), pa.array(row["ids"], pa.int64()), pa.array(row["hashes"], pa.int64()), pa.array(row["n"], pa.int64()), pa.array([row["keys"][16 * k : 16 * k + 16] if n else None for k, n in enumerate(row["n"])], pa.binary())], names=["chunk", "at", "doc_id", "hash", "n", "key"])


def _parts(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit fingerprint of each hash."""
    return ((grams >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64), (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _fingerprints(buckets: int):
    def emit(batches):
        for batch in batches:
            for chunk, grams in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bucket, prints = _parts(np.frombuffer(grams.as_buffer(), np.uint64), buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(cuts)):
                    u, c = np.unique(prints[order[cuts[b] : cuts[b + 1]]], return_counts=True)
                    rows.append({"bucket": int(b), "chunk": chunk, "prints": u.tobytes(), "counts": np.minimum(c, 65535).astype(np.uint16).tobytes()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PRINTS)

    return emit


_PRINTS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("prints", pa.binary()), ("counts", pa.binary())])


def _frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
    """What each chunk's fingerprints count in the whole corpus, where more than once."""
    prints = [np.frombuffer(x, np.uint32) for x in pdf["prints"]]
    flat = np.concatenate(prints)
    u, inverse = np.unique(flat, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["counts"]])).astype(np.int64)
    df = np.minimum(total, 2**31 - 1).astype(np.int32)[inverse]
    out, at = [], 0
    for chunk, x in zip(pdf["chunk"], prints, strict=True):
        d = df[at : at + len(x)]
        at += len(x)
        if (d > 1).any():
            out.append((pdf["bucket"].iloc[0], chunk, x[d > 1].tobytes(), d[d > 1].tobytes()))
    return pd.DataFrame(out, columns=["bucket", "chunk", "prints", "counts"])


def _columns(buckets: int, num: int, den: int):
    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"gram": [np.zeros(0, np.int64)], "node": [np.zeros(0, np.int64)], "n": [np.zeros(0, np.int64)]}
        if len(left) and len(right):
            row = left.iloc[0]
            grams, p, n = np.frombuffer(row["grams"], np.uint64), np.asarray(row["p"]), np.asarray(row["n"])
            chosen_row = np.zeros(len(n), bool)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for kind, bucket, prints, c in zip(right["kind"], right["bucket"], right["prints"], right["counts"], strict=True):
                if kind:
                    chosen_row[bucket] = True
                else:
                    keys.append(bucket << 32 | np.frombuffer(prints, np.uint32).astype(np.int64))
                    counts.append(np.frombuffer(c, np.int32).astype(np.int64))
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(keys)
            keys, counts = np.r_[keys[order], np.iinfo(np.int64).max], np.r_[counts[order], 0]
            bucket, prints = _parts(grams, buckets)
            own = bucket << 32 | prints.astype(np.int64)
            at = np.searchsorted(keys, own)
            df = np.where(keys[at] == own, counts[at], 1)
            doc = np.repeat(np.arange(len(n)), p)
            order = np.lexsort((grams, df, doc))
            place = np.arange(len(grams)) - np.repeat(np.cumsum(p) - p, p)
            keep = order[(place < chosen_size(n, num, den)[doc]) & (df[order] > 1) & chosen_row[doc]]
            out = {"gram": [grams[keep].view(np.int64)], "node": [row["chunk"] << 18 | doc[keep]], "n": [n[doc[keep]]]}
        return pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    return choose


def _whole_sets(width: int):
    def sets(batches):
        for batch in batches:
            for i, j, block in blocks(batch.column(0)):
                bounds, grams = shingle_sets(block, width)
                data = [grams[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                keep = [k for k in range(block.n) if len(data[k])]
                rest = [batch.column(c).slice(i, j - i).take(pa.array(keep, pa.int64())) for c in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([set_key(data[k]) for k in keep], pa.binary()), pa.array([data[k].tobytes() for k in keep], pa.binary())], names=[*batch.schema.names[1:], "own", "grams"])

    return sets


def product(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int):
    """Overlapping pairs that are linked, row by row: (row, linked rows) with row in ``left`` and partners in ``right``."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    _, column = np.unique(flat, return_inverse=True)
    order = np.lexsort((row, column))
    posting = row[order]
    start = np.searchsorted(column[order], np.arange(column.max() + 2))
    first = np.cumsum(size) - size
    for i in np.flatnonzero(left):
        columns = column[first[i] : first[i] + size[i]]
        a, length = start[columns], start[columns + 1] - start[columns]
        at = np.repeat(a - (np.cumsum(length) - length), length) + np.arange(length.sum())
        overlap = np.bincount(posting[at], minlength=len(sets))
        linked = right & ((num + den) * overlap >= num * (size[i] + size))
        linked[i] = False
        yield i, np.flatnonzero(linked)


def _cell(num: int, den: int):
    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        node, copies, mine = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["mine"].to_numpy()
        low, high = pdf["i"].iloc[0], pdf["j"].iloc[0]
        parent = np.arange(len(node))
        a, b, links = [], [], np.zeros(len(node), np.int64)

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, linked in product([np.frombuffer(x, np.uint64) for x in pdf["grams"]], mine == low, mine == high, num, den):
            links[i] += copies[linked].sum()
            if low != high:
                np.add.at(links, linked, copies[i])
            for k in linked:
                x, y = find(i), find(k)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(node[i])
                    b.append(node[k])
        some = np.flatnonzero(links)
        return pd.DataFrame({"a": np.r_[np.array(a, np.int64), node[some]], "b": np.r_[np.array(b, np.int64), node[some]], "links": np.r_[np.zeros(len(a), np.int64), links[some]]})

    return multiply


def _joined(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each of ``docs``: doc_id, hash (of the text), n, key, root (null where the set is empty), component_id and first_hash (the row that stands for the group), n_links."""
    bound_batches(docs)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    sketches = cut(rows.mapInArrow(_sketches(width, num, den), _SKETCH_SQL))
    total = sketches.agg(F.sum(F.octet_length("grams")).alias("x")).first()["x"] or 0
    buckets = int(max(1, min(1 << 22, -(-(total // 8) // COUNTED))))
    small = cut(sketches.select("chunk", "ids", "hashes", "n", "keys").mapInArrow(_documents, "chunk long, at long, doc_id long, hash long, n long, key binary"))
    classes = cut(small.where("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "chunk", "at", "n")).alias("f"), F.count(F.lit(1)).alias("copies")).select("key", "copies", "f.doc_id", "f.hash", "f.chunk", "f.at", "f.n", F.expr("(f.chunk << 18) | f.at").alias("node")))
    found = sketches.select("chunk", "grams").mapInArrow(_fingerprints(buckets), "bucket long, chunk long, prints binary, counts binary").groupBy("bucket").applyInPandas(_frequencies, "bucket long, chunk long, prints binary, counts binary")
    told = found.select("chunk", F.lit(False).alias("kind"), "bucket", "prints", "counts").union(classes.select("chunk", F.lit(True), "at", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
    columns = sketches.select("chunk", "n", "p", "grams").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_columns(buckets, num, den), "gram long, node long, n long")
    band = F.floor(F.log("n") / F.log(F.lit(den / num) * (1 + 1e-9))).cast("long")
    columns = cut(columns.select("gram", "node", band.alias("band")))
    heads = columns.groupBy("gram", "band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("k"))
    steps = heads.select("gram", (F.col("band") + 1).alias("band"), F.col("head").alias("below"))
    chains = columns.join(heads.where("k > 1"), ["gram", "band"]).select(F.col("node").alias("a"), F.col("head").alias("b")).union(heads.join(steps, ["gram", "band"]).select("head", "below"))
    family = components(chains).select("node", F.col("root").alias("family"))
    grade = F.floor(F.log("n") / F.log(F.lit(den / num) * (1 + 1e-9)) * GRADES).cast("long")
    sized = cut(family.join(classes, "node").withColumn("grade", grade))
    packs = max(1, -(-sized.count() // ROWS))
    ordered = Window.partitionBy("family").orderBy("grade")  # a row for each grade: some hundreds at most
    spans = sized.groupBy("family", "grade").agg(F.count(F.lit(1)).alias("m")).withColumn("end", F.sum("m").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    near = ordered.rangeBetween(-GRADES, GRADES)
    spans = spans.select("family", "grade", "m", (F.col("end") - F.col("m")).alias("start"), F.min(F.col("end") - F.col("m")).over(near).alias("low"), F.max("end").over(near).alias("high"), F.sum("m").over(Window.partitionBy("family")).alias("all"))
    one = F.col("all") <= ROWS
    spread = F.col("start") + F.pmod(F.xxhash64("node"), F.col("m"))
    placed = sized.join(spans, ["family", "grade"]).withColumn("pack", F.when(one, -1 - F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(F.col("family")))
    wanted = placed.select("node", "pack", *[F.when(one, 0).otherwise(F.floor(x / ROWS)).cast("int").alias(name) for name, x in (("mine", spread), ("low", F.col("low")), ("high", F.col("high") - 1))], "copies", "key", F.col("doc_id").alias("want"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("want"))).select("text", "node", "pack", "low", "high", "mine", "copies", "key")
    whole = texts.mapInArrow(_whole_sets(width), "node long, pack long, low int, high int, mine int, copies long, key binary, own binary, grams binary").where("key = own")
    cells = whole.select("node", "pack", "mine", "copies", "grams", F.explode(F.sequence("low", "high")).alias("other")).select("node", "pack", "mine", "copies", "grams", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    links = cut(cells.groupBy("pack", "i", "j").applyInPandas(_cell(num, den), "a long, b long, links long"))
    roots = components(links.where("a <> b").select("a", "b"))
    counts = links.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.join(roots, "node", "left").join(counts, "node", "left").select("key", "doc_id", "hash", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("f")).select("root", F.col("f.doc_id").alias("component_id"), F.col("f.hash").alias("first_hash"))
    named = known.join(least, "root").select("key", "root", "component_id", "first_hash", "n_links")
    return small.join(named, "key", "left")


def jaccard_join(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: doc_id, n_shingles, component_id, n_links.

    Two rows link when den * intersection >= num * union of their sets of ``width``-word shingles
    (words lower-cased in A-Z); n_links counts the rows linked, equal sets included. Texts that are
    null, empty or without words have an empty set and no links; those of fewer words have one
    shingle. Rows that repeat an id or a text are rows each; component_id is the smallest id
    reachable. Ids are whole numbers; a null id takes part and is never the smallest, unless alone.
    Empty input gives an empty result; other columns play no part.
    """
    out = _joined(docs, width, num, den, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, of each group of linked ones only one: that of the smallest id, with any columns.

    Texts without words are linked with nothing and stay, each row. Of rows that repeat both id and text,
    and of those that share the group's smallest id, one stays.
    """
    rows = _joined(docs, width, num, den, id_col, text_col).where("root is not null")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("hash") == F.col("first_hash"))
    marked = cut(rows.groupBy("doc_id", "hash").agg(F.first(first).alias("first"), (F.count(F.lit(1)) > 1).alias("again")).where("not first or again"))
    gone = marked.where("not first").select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    kept = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    again = marked.where("first").select(F.col("doc_id").alias("again_id"), F.col("hash").alias("again_hash"))
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("hash") == F.col("again_hash"))
        place = F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("hash"))
        one = kept.join(again, same, "left_semi").withColumn("place", place).where("place = 1").drop("place")
        kept = kept.join(again, same, "left_anti").union(one)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_sparse_product_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents at four words and 85 hundredths."""
    return jaccard_join(table(spark, sf_dir, "documents"))
