"""Files of token ids: planes, blocks, whole tables and windows, against the tokenizers library itself."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seamline.llm import planes
from seamline.plans.lineage import own_folder

from . import data

PATH = str(public_tokenizers.path(planes.TOKENIZER))


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def wanted(rows):
    """doc_id, start, n_tokens, ids_crc32 in ascending doc_id, nulls first; ties as a set."""
    ids = library([r[1] for r in rows])
    out, start = [], 0
    for r, x in sorted(zip(rows, ids, strict=True), key=lambda p: (p[0][0] is not None, p[0][0] or 0)):
        out.append((r[0], start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("top", [0, 1, 255, 256, 50_256, 1 << 20, 2**32 - 1])
def test_planes_of_a_block(kind, top):
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 1000):
        ids = np.minimum(rng.integers(0, top + 1, n, dtype=np.uint64), top).astype(np.uint32)
        found = planes.to_planes(ids, kind)
        assert len(found) <= (4 if kind == "byte" else 32)
        assert (planes.from_planes(found, n, kind) == ids).all()


def test_words_have_the_same_ids_in_every_text():
    coder = planes.Coder(PATH)
    texts = ["", " ", "  ", "a", " a", "a ", "a b", "a  b", "a \n b", "a\nb c\n", "don't we'll 's", "x y 　 z", "a\x1c b \x1f", "日本 語", "<|endoftext|> b <|endoftext|>", "Ġa Ġb", "\n", "a\n\n\nb  \n c", "tab\t tab", "é è", "ab " * 2000, "x" * 5000, " ".join(f"w{i}" for i in range(3000))]
    for _ in range(2):
        assert [x.tolist() for x in coder.encode(texts)] == [x[:-1] for x in library(texts)]


def test_words_of_known_pieces_are_not_given_to_the_library_again():
    coder = planes.Coder(PATH)
    stems = [f"{a}{b}{c}" for a in "kqz" for b in ("aé", "Öl", "um") for c in "rst"]
    coder.encode([" ".join(f"{s} 12 {s}. {s}\n{s}" for s in stems)])
    given, whole, by_model = [], coder.library, coder._by_model
    coder.library = lambda texts: given.extend(texts) or whole(texts)
    coder._by_model = lambda pieces: given.extend(pieces) or by_model(pieces)
    texts = [" ".join(f"x {s}.\n{t} {t}12.{s}" for s in stems for t in stems) + " it's 'll\n\nwe'd\t12 ''s _a <|endoftext|> a\r\nb ſ×ÿ÷ aª1² x́y"]
    assert [x.tolist() for x in coder.encode(texts)] == [x[:-1] for x in library(texts)]
    assert sum(map(len, given)) < 500 < len(texts[0]) // 20


def test_slices_and_forgetting(monkeypatch):
    monkeypatch.setattr(planes, "SLICE_CHARS", 5)
    monkeypatch.setattr(planes, "KNOWN_WORDS", 3)
    coder = planes.Coder(PATH)
    texts = ["one two  three four\n five  six seven", " a b c d e f g h", "", "abcdefgh ijklmnop  q"]
    for t in texts:
        assert [coder.encode([t])[0].tolist()] == [x[:-1] for x in library([t])]


@pytest.mark.parametrize(("kind", "block", "file_ids", "chars"), [("byte", 1 << 16, 1 << 26, 40_000_000), ("bit", 100, 3000, 20_000), ("byte", 64, 500, 3_000)])
def test_written_and_read_back(spark, kind, block, file_ids, chars):
    folder = own_folder(spark, "ids")
    files = planes.write_ids(data.frame(spark), folder, PATH, kind=kind, block=block, file_ids=file_ids, range_chars=chars)
    got = sorted(map(tuple, planes.read_documents(files).collect()), key=lambda r: r[1])
    want = wanted(data.rows())
    assert [r[0] for r in got] == [r[0] for r in want]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in want)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    if block == 64:
        assert files.count() > 3
    flat = [i for r in sorted(planes.read_documents(planes.open_ids(spark, folder), with_ids=True).collect(), key=lambda r: r.start) for i in r.ids]
    numbers = spark.createDataFrame([(k,) for k in (-1, 0, 1, 5, len(flat) // 700, 10**6, 5)], "window long")
    got = {r.window: r.ids for r in planes.read_windows(files, 700, numbers).collect()}
    assert got == {k: flat[700 * k : 700 * (k + 1)] for k in (0, 1, 5, len(flat) // 700)}


def test_one_hot_id_and_repeated_rows(spark):
    rows = [(7, f"text {i % 3} of it", "en", "s") for i in range(300)] + [(8, "x", "en", "s"), (1, "y z", "en", "s")]
    got = planes.read_documents(planes.write_ids(data.frame(spark, rows), own_folder(spark, "ids"), PATH, block=50, range_chars=200)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], r[2], r[3]) for r in wanted(rows))
    assert sorted(r.start for r in got) == np.cumsum([0, *(r.n_tokens for r in sorted(got, key=lambda r: r.start))])[:-1].tolist()


def test_empty_table(spark):
    files = planes.write_ids(data.frame(spark, []), own_folder(spark, "ids"), PATH)
    assert files.count() == planes.read_documents(files).count() == 0


def test_damage_is_seen(tmp_path):
    w = planes.Writer(str(tmp_path), "f", block=10)
    w.add(1, np.arange(25, dtype=np.uint32))
    w.close()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f"]
    r = planes.Reader(str(tmp_path), "f")
    assert r.between(8, 21).tolist() == list(range(8, 21))
    r.blocks[1] = (r.blocks[1][0], r.blocks[1][1], r.blocks[1][2] ^ 1, r.blocks[1][3])
    with pytest.raises(ValueError, match="damaged"):
        r.read(1)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, planes.op12_bit_plane_ids(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == wanted(rows)
