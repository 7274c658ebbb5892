"""Quality rules: word and repetition counts, then divergence from language references.

A language's reference is the mean character-class histogram and the mean common-word histogram of
all its documents that pass the base rules, so that junk that these reject doesn't move it. A document is rejected when the Jensen-Shannon distance (base 2, 0 to 1) of
either of its own histograms is over the limit; shorter documents than the guards are not judged.
A histogram of few words is noisy, so the words' limit is raised by NOISE over the root of their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table
from .textblock import TextBlock, blocks, mix, repeated

#: Frequent function words of each language with a reference.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not at this are or from have an but",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec il",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
OTHER = "(other)"
#: Limits of the distances, and the least numbers of characters and words judged.
CHAR_LIMIT, WORD_LIMIT, NOISE = 0.30, 0.20, 1.3
LEAST_CHARS, LEAST_WORDS = 200, 40
WINDOW, LEAST, REPEAT_PERCENT = 5, 10, 20
#: Histograms are summed as whole millionths, so that the sums don't depend on their order.
SCALE = 1_000_000
_WORDS = sorted({w for x in COMMON_WORDS.values() for w in x.split()})
_TRAILING = np.zeros(256, bool)
_TRAILING[list(b".,;:!?")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Classes of a code point's first byte: small letter, capital, digit, space, stop, symbol or other sign, beyond ASCII; 7 is for later bytes.
_CLASS = np.full(256, 5)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[list(b" \t\n\r\x0b\x0c")] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[128:192], _CLASS[192:] = 7, 6
CLASSES = 7


def _word_codes() -> tuple[np.ndarray, np.ndarray]:
    data = [w.encode() for w in _WORDS]
    at = np.r_[0, np.cumsum([len(x) for x in data])]
    block = TextBlock(np.frombuffer(b"".join(data), np.uint8), at)
    codes = block.substring_hash(block.sums(), at[:-1], at[1:])
    order = np.argsort(codes)
    return codes[order], order


def histograms(block: TextBlock, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words (the last column: all other words) by text."""
    chars = _by_text(_CLASS[block.buf], np.repeat(np.arange(block.n), np.diff(block.starts)), block.n, 8)[:, :CLASSES]
    low = TextBlock(_LOWER[block.buf], block.starts)
    ends = last - (_TRAILING[block.buf[last - 1]] & (last - first > 1))
    codes, which = _word_codes()
    h = low.substring_hash(low.sums(), first, ends)
    at = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
    return chars, _by_text(np.where(codes[at] == h, which[at], len(codes)), doc, block.n, len(codes) + 1)


def _by_text(kind: np.ndarray, doc: np.ndarray, n: int, kinds: int) -> np.ndarray:
    return np.bincount(doc * kinds + kind, minlength=n * kinds).reshape(n, kinds)


def shares(counts: np.ndarray) -> np.ndarray:
    """Rows as shares of their sums; rows of zeros stay so."""
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of p from the same row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        side = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)
        return np.sqrt(np.maximum((side(p) + side(q)) / 2, 0))


def rule_counts(block: TextBlock, first: np.ndarray, last: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The counts of the base rules by text."""
    n, sums = block.n, block.sums()
    lead = np.r_[0, np.cumsum((block.buf & 0xC0) != 0x80)]
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": np.bincount(doc, weights=lead[last] - lead[first], minlength=n).astype(np.int64), "n_symbols": block.per_text(np.flatnonzero(_SYMBOL[block.buf]))}
    breaks = np.flatnonzero(block.buf == 10)
    line_first = np.sort(np.r_[block.starts[:-1], breaks + 1])
    line_doc = np.sort(np.r_[np.arange(n), np.searchsorted(block.starts, breaks, "right") - 1])
    line_last = np.sort(np.r_[block.starts[1:], breaks])
    worded = np.searchsorted(first, line_last) > np.searchsorted(first, line_first)
    line_first, line_last, line_doc = line_first[worded], line_last[worded], line_doc[worded]
    with np.errstate(over="ignore"):
        salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        _, later = repeated(block.substring_hash(sums, line_first, line_last) ^ salt[line_doc])
        out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
        words = block.substring_hash(sums, first, last)
        size = len(words) - window + 1
        covered = np.zeros(len(words) + 1, np.int64)
        if size > 0:
            grams = np.zeros(size, np.uint64)
            for i in range(window):
                grams = mix(grams + words[i : i + size])
            at = np.flatnonzero(doc[:size] == doc[window - 1 :])
            twice, _ = repeated(grams[at] ^ salt[doc[at]])
            np.add.at(covered, at[twice], 1)
            np.add.at(covered, at[twice] + window, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered)[:-1] > 0], minlength=n)
    return out


def base_failed(counts):
    """Whether the base rules reject a text; ``counts``: arrays or columns by name."""
    return (counts["n_words"] < LEAST) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])


def _langs(column: pa.Array) -> np.ndarray:
    known = {x: i for i, x in enumerate(COMMON_WORDS)}
    return np.array([known.get(x, len(known)) for x in column.to_pylist()], np.int64)


def _reference(batches):
    """Sums of millionths and the number of documents, by language, kind of histogram."""
    for batch in batches:
        langs = _langs(batch.column(1))
        for i, j, block in blocks(batch.column(0)):
            first, last, doc = block.words()
            chars, words = histograms(block, first, last, doc)
            passed = ~base_failed(rule_counts(block, first, last, doc))
            for lang in np.unique(langs[i:j]):
                own = (langs[i:j] == lang) & passed
                c = own & (chars.sum(axis=1) >= LEAST_CHARS)
                w = own & (words.sum(axis=1) >= LEAST_WORDS)
                total = lambda x: np.rint(shares(x) * SCALE).astype(np.int64).sum(axis=0).tolist()
                yield pa.RecordBatch.from_pydict({"lang": [lang, lang], "kind": ["chars", "words"], "total": [total(chars[c]), total(words[w])]}, schema=_PART)


_PART = pa.schema([("lang", pa.int64()), ("kind", pa.string()), ("total", pa.list_(pa.int64()))])


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Reference histograms over all ``docs`` that pass the base rules: (languages + 1) by bins; the last row is for other languages.

    Only these few sums, as many as COMMON_WORDS has languages, reach the driver.
    """
    bound_batches(docs)
    parts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(_reference, "lang long, kind string, total array<long>")
    rows = parts.select("lang", "kind", F.posexplode("total").alias("bin", "x")).groupBy("lang", "kind", "bin").agg(F.sum("x").alias("x")).collect()
    out = {"chars": np.zeros((len(COMMON_WORDS) + 1, CLASSES)), "words": np.zeros((len(COMMON_WORDS) + 1, len(_WORDS) + 1))}
    for r in rows:
        out[r["kind"]][r["lang"], r["bin"]] = r["x"]
    return {k: shares(v) for k, v in out.items()}


def _judge(ref: dict[str, np.ndarray]):
    def judge(batches):
        for batch in batches:
            langs = _langs(batch.column(1))
            for i, j, block in blocks(batch.column(0)):
                first, last, doc = block.words()
                out = rule_counts(block, first, last, doc)
                chars, words = histograms(block, first, last, doc)
                which = langs[i:j]
                out["char_distance"] = np.where((chars.sum(axis=1) >= LEAST_CHARS) & (ref["chars"][which].sum(axis=1) > 0), js_distance(shares(chars), ref["chars"][which]), 0.0)
                judged = (words.sum(axis=1) >= LEAST_WORDS) & (which < len(COMMON_WORDS)) & (ref["words"][which].sum(axis=1) > 0)
                out["word_distance"] = np.where(judged, js_distance(shares(words), ref["words"][which]), 0.0)
                rest = [batch.column(k).slice(i, j - i) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(out[c]) for c in MEASURES)], names=[*batch.schema.names[2:], *MEASURES])

    return judge


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance"]


def measure(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns ``keep`` of each row with its MEASURES, base_failed and kept.

    Null and empty texts have no words, so base_failed. Null and unknown languages are pooled: their
    characters are judged against the pool, their words are not. Repeated rows are judged each.
    Columns of ``keep`` may have any names but those added. Empty input gives an empty result. The
    references are fitted by a job of its own when this is called.
    """
    ref = references(docs, text_col, lang_col)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), *(f"{c} {'double' if c.endswith('distance') else 'long'}" for c in MEASURES)])
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    out = rows.mapInArrow(_judge(ref), schema)
    failed = base_failed({c: F.col(c) for c in MEASURES})
    verdict = (F.col("char_distance") <= CHAR_LIMIT) & (F.col("word_distance") <= WORD_LIMIT + NOISE / F.sqrt("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, "base_failed", "kept")


def op5_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    out = measure(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
