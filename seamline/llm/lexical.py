"""Ranked lexical search by a threshold-seeded join.

Documents are read once: a row keeps the occurrences of the terms that the items ask for. From these rows each term
gets its document frequency, its largest impact and its kth largest impact (rounded down to a step). An item's kth score
is at least the best weighted kth impact of its terms: that seeds its threshold. Terms are laid by falling bound;
those at the end whose bounds together stay below the threshold can't lift a document over it alone, so only the terms before
them generate candidates. A candidate whose sum and remaining bounds reach the threshold is scored exactly. Each task
keeps its k best of an item, whose kth raises the threshold, and tasks' lists are merged by a window.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, table, written

K = 50
#: Items are taken in blocks of about so many terms, which is what the driver and each task hold of them.
BLOCK_TERMS = 200_000
#: Impacts are counted by steps of this size to find a term's kth; documents times items in one array of sums; bytes of a text that are split together.
STEP, CELLS, SLICE_BYTES = 4_096, 1 << 20, 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, as UTF-8, some at a time: a very long text is never one list."""
    data, at = (text or "").encode().translate(_FOLD), 0
    while len(data) - at > SLICE_BYTES and (gap := _GAP.search(data, at + SLICE_BYTES)):
        yield _TERM.findall(data, at, gap.start())
        at = gap.start()
    yield _TERM.findall(data, at)


def _rows(vocabulary: Broadcast):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary.value)}
        for batch in batches:
            ids, n, ends, terms, times = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total, found = 0, Counter()
                for words in terms_of(text.as_py()):
                    total += len(words)
                    found.update(map(number.get, words))
                if total:
                    found.pop(None, None)
                    ids.append(doc_id)
                    n.append(total)
                    terms.extend(found)
                    times.extend(found.values())
                    ends.append(len(terms))
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), lists(terms, pa.int32()), lists(times, pa.int64())], names=["doc_id", "n", "terms", "tf"])

    return count


def impact(tf: Column | np.ndarray, m: Column | np.ndarray):
    """What a term's occurrences in a document of length measure m are worth, before the term's weight; whole numbers."""
    if isinstance(tf, Column):
        return F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1_000) * tf + F.lit(20) * m)
    return 1_000_000_000 * tf // (1_000 * tf + 20 * m)


@dataclass
class Block:
    """A block of items as tasks need it: entries (item, term, weight, bound), by item and then falling bound."""

    ids: list
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    bound: np.ndarray
    after: np.ndarray  # bounds of the item's terms behind this one, together
    seed: np.ndarray  # of each item
    n_terms: int
    docs: int
    words: int

    def split(self, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries that generate candidates, and, of each item, the bounds of all its others together.

        An entry is among the others if its own bound and those behind it stay below the threshold.
        """
        own = self.after + self.bound
        leads = own >= np.maximum(threshold, 1)[self.item]
        rest = np.zeros(len(self.ids), np.int64)
        others = np.flatnonzero(~leads)
        np.maximum.at(rest, self.item[others], own[others])
        return leads, rest


def _by_term(block: Block, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries laid by term: where each term's begin, items, weights."""
    at = np.flatnonzero(entries)
    at = at[np.argsort(block.term[at], kind="stable")]
    return np.searchsorted(block.term[at], np.arange(block.n_terms + 1)), block.item[at], block.weight[at]


def _scatter(sums: np.ndarray, doc: np.ndarray, term: np.ndarray, worth: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add each posting's worth, by its items' weights, to sums[doc, item]."""
    begin, items, weights = lists
    many = begin[term + 1] - begin[term]
    ends = np.cumsum(many)
    if not len(ends) or not ends[-1]:
        return
    entry = np.repeat(begin[term] - ends + many, many) + np.arange(ends[-1])
    np.add.at(sums.reshape(-1), np.repeat(doc, many) * sums.shape[1] + items[entry], np.repeat(worth, many) * weights[entry])


class Best:
    """The k best documents of each item so far, and what a document must reach to be among them."""

    def __init__(self, block: Block, k: int):
        self.k, self.threshold = k, np.maximum(block.seed, 1)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score, doc, null = np.r_[self.item, item], np.r_[self.score, score], np.r_[self.doc, doc], np.r_[self.null, null]
        order = np.lexsort((doc, ~null, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, np.arange(len(self.threshold)))[item]
        kth, keep = order[rank == self.k - 1], order[rank < self.k]
        self.threshold[item[rank == self.k - 1]] = np.maximum(self.threshold[item[rank == self.k - 1]], score[kth])
        self.item, self.score, self.doc, self.null = item[rank < self.k], score[keep], doc[keep], null[keep]


def _searched(shared: Broadcast, k: int):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = Best(block, k)
        step = max(1, CELLS // len(block.ids))
        for batch in batches:
            ids = batch.column(0)
            doc_ids, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            m = 50 + 50 * n * block.docs // block.words
            ends = np.r_[0, np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))]
            terms, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            for a in range(0, len(n), step):
                b = min(len(n), a + step)
                doc = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                term = terms[ends[a] : ends[b]]
                worth = impact(tf[ends[a] : ends[b]], m[a:b][doc])
                leads, rest = block.split(best.threshold)
                sums = np.zeros((b - a, len(block.ids)), np.int64)
                _scatter(sums, doc, term, worth, _by_term(block, leads))
                live = (sums > 0) & (sums + rest >= best.threshold)
                chosen = live.any(1)[doc]
                _scatter(sums, doc[chosen], term[chosen], worth[chosen], _by_term(block, ~leads))
                d, item = np.nonzero(live & (sums >= best.threshold))
                best.add(item, sums[d, item], doc_ids[a:b][d], null[a:b][d])
        yield pa.RecordBatch.from_arrays([pa.array([block.ids[i] for i in best.item.tolist()], pa.int64()), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())], names=["item_id", "doc_id", "score"])

    return search


def term_impacts(rows: DataFrame, docs: int, words: int, k: int, step: int = STEP) -> DataFrame:
    """term, df, its largest impact and its kth largest, rounded down to ``step`` (0 where fewer than k documents hold it).

    Impacts are counted by step, with map-side sums, so that a term of all documents brings as many rows as there are steps.
    """
    m = F.lit(50) + F.call_function("div", F.lit(50) * F.col("n") * F.lit(docs), F.lit(words))
    posting = rows.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tf")).alias("p")).select(F.col("p.terms").alias("term"), impact(F.col("p.tf"), F.col("m")).alias("impact"))
    levels = posting.groupBy("term", F.call_function("div", "impact", F.lit(step)).alias("level")).agg(F.count(F.lit(1)).alias("c"), F.max("impact").alias("top"))
    above = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    reached = levels.withColumn("held", F.sum("c").over(above))
    return reached.groupBy("term").agg(F.sum("c").alias("df"), F.max("top").alias("top"), F.coalesce(F.max(F.when(F.col("held") >= k, F.col("level") * step)), F.lit(0)).alias("kth"))


def _block(items: list, vocabulary: dict[bytes, int], stats: list, docs: int, words: int) -> Block:
    """Weights, bounds and seeds of a block's items; terms that no document holds fall away."""
    weight, top, kth = (np.zeros(len(vocabulary), np.int64) for _ in range(3))
    for r in stats:
        weight[r.term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * r.df + 1)))
        top[r.term], kth[r.term] = r.top, r.kth
    item = np.repeat(np.arange(len(items)), [len(t) for _, t in items])
    term = np.array([vocabulary[t] for t in chain.from_iterable(t for _, t in items)], np.int64)
    bound = weight[term] * top[term]
    seed = np.zeros(len(items), np.int64)
    np.maximum.at(seed, item, weight[term] * kth[term])
    order = np.lexsort((term, -bound, item))
    order = order[bound[order] > 0]
    item, term, bound = item[order], term[order], bound[order]
    upto = np.cumsum(bound)
    last = np.searchsorted(item, np.arange(len(items)), "right") - 1
    after = upto[last[item]] - upto
    return Block([i for i, _ in items], item, term, weight[term], bound, after, seed, len(vocabulary), docs, words)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best rows of ``docs`` with a score above 0; all, if fewer.

    Terms are maximal runs of ASCII letters and digits and all characters beyond ASCII; only A to Z are folded. Null and empty texts
    have none and don't count as documents. Equal scores go by ascending doc_id, null ids first; rows that repeat an id are documents
    each. Rows of ``items`` that repeat an id are one item with the terms of all; a null id is an id. Items without terms, or whose
    terms no document holds, get no rows. Empty tables give an empty result. Extra columns don't matter.

    Items come in blocks of about ``block_terms`` terms; each block reads the texts once.
    """
    spark = docs.sparkSession
    bound_batches(docs)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    own = F.array_distinct(F.regexp_extract_all(F.translate(F.col(f"`{item_text_col}`"), _UPPER, _LOWER), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)))
    asked = written(items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.explode(own).alias("term")).distinct(), "items")
    blocks = max(1, -(-asked.count() // block_terms))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).groupBy("item_id").agg(F.collect_list("term").alias("terms"))
        found = [(r.item_id, [t.encode() for t in r.terms]) for r in part.collect()]  # about block_terms terms, or one item
        if not found:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted(set(chain.from_iterable(t for _, t in found))))}
        rows = written(texts.mapInArrow(_rows(spark.sparkContext.broadcast(list(vocabulary))), "doc_id long, n long, terms array<int>, tf array<long>"), "rows")
        n, words = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n:
            break
        block = _block(found, vocabulary, term_impacts(rows, n, words, k).collect(), n, words)  # a row a term of the block
        held = rows.where(F.size("terms") > 0)
        out = out.union(held.mapInArrow(_searched(spark.sparkContext.broadcast(block), k), out.schema))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_threshold_seeded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, r, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM s),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM s) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
x AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), g GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 50
"""
