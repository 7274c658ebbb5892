"""Operators of the subpackage against their plain versions, over awkward rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import string
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import bpe, chat, dedup, jaccard, mixing, pii, quality, secrets, sharding, topk

from . import brute, data


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_repeats(spark):
    got = dedup.remove_repeats(data.frame(spark), length=40, anchor=20).collect()
    want = brute.removed_bytes([r[1] for r in data.rows()], 40)
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], [(d[0], *w) for d, w in zip(data.rows(), want, strict=True)])


def test_repeats_of_an_anchor_beyond_an_index(spark):
    got = dedup.remove_repeats(data.frame(spark), length=40, anchor=20, index_bytes=500).collect()
    want = brute.removed_bytes([r[1] for r in data.rows()], 40)
    same([(r.doc_id, r.n_removed, r.kept_sha256) for r in got], [(d[0], w[1], w[3]) for d, w in zip(data.rows(), want, strict=True)])


@pytest.mark.parametrize("index_bytes", [300, 5_000, 2_000_000])
def test_repeats_of_four_hundred_bytes_with_a_passage_everywhere(spark, index_bytes):
    """A passage that all texts hold in contexts that differ, equal or near: more text than small indexes take."""
    rng = random.Random(9)
    make = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    passage, short, sides = make(520), make(390), [make(150) for _ in range(4)]
    rows = [(i, f"{make(rng.randint(50, 600))}{rng.choice(sides)}{passage if i % 3 else short}{rng.choice(sides)}{make(rng.randint(50, 600))}", "en", "s") for i in range(120)] + [(500, make(2000) * 2, "en", "s")]
    got = dedup.remove_repeats(data.frame(spark, rows), index_bytes=index_bytes).collect()
    want = brute.removed_bytes([r[1] for r in rows], 400)
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], [(d[0], *w) for d, w in zip(rows, want, strict=True)])
    assert all(sum(int(b) - int(a) for a, b in (x.split(":") for x in r.spans)) == r.n_removed for r in got)


def test_repeats_of_homes_that_alternate_in_a_text(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choices("abcdefgh ", k=30)) for _ in range(40)]
    rows = [(i, "".join(rng.choices(parts, k=8)), "en", "s") for i in range(40)]
    got = dedup.remove_repeats(data.frame(spark, rows), length=40, anchor=20).collect()
    want = brute.removed_bytes([r[1] for r in rows], 40)
    assert 0 < sum(w[1] for w in want) < sum(w[0] for w in want)
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], [(d[0], *w) for d, w in zip(rows, want, strict=True)])


def test_rule_counts(spark):
    got = quality.measure(data.frame(spark), ["doc_id", "hash"]).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(d[0], *brute.rule_counts(d[1])) for d in data.rows()])
    assert not any(r.kept and r.base_failed for r in got)


def test_divergence_rejects_junk_and_keeps_prose(spark):
    prose = "The house of the man is in the town and it was not as old as the road that runs to it from the hills. "
    other = "They said that this is for you and that it was by the river, with a boat on it, but not at the mill. "
    rows = [(i, f"{prose}{other}Number {i} of the list is on the page and it is not in a book.", "en", "s") for i in range(40)]
    rows.append((99, " ".join(f"#{i}%{i * 7}" for i in range(300)), "en", "s"))
    got = {r.doc_id: r.kept for r in quality.measure(data.frame(spark, rows), ["doc_id"]).collect()}
    assert not got[99] and all(got[i] for i in range(40))


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard(spark, width, num, den):
    got = jaccard.jaccard_join(data.frame(spark), width, num, den).collect()
    want = brute.jaccard_components([r[:2] for r in data.rows()], width, num, den)
    same([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got], [(d[0], *w) for d, w in zip(data.rows(), want, strict=True)])


def test_jaccard_against_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = jaccard.jaccard_join(docs).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], [(d[0], *w[:2]) for d, w in zip(rows, brute.jaccard_components(rows, 4, 85, 100), strict=True)])


@pytest.mark.parametrize("rows", [3])
def test_jaccard_of_families_beyond_a_block(spark, monkeypatch, rows):
    monkeypatch.setattr(jaccard, "ROWS", rows)
    words = [f"w{k}" for k in range(400)]
    chain = [(1000 + k, " ".join(words[3 * k : 3 * k + 60]), "en", "s") for k in range(40)]
    alike = [(2000 + k, " ".join([*words[300:], f"end{k}", *(["and"] * (k % 4))]), "en", "s") for k in range(12)]
    grown = [(3000 + k, " ".join(words[100 : 130 + 3 * k]), "en", "s") for k in range(50)]  # one family of sizes from 27 to 174
    given = [*data.rows(), *chain, *alike, *alike[:3], *grown]
    got = jaccard.jaccard_join(data.frame(spark, given)).collect()
    want = brute.jaccard_components([r[:2] for r in given], 4, 85, 100)
    same([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got], [(d[0], *w) for d, w in zip(given, want, strict=True)])


def test_keep_one(spark):
    kept = jaccard.keep_one(data.frame(spark)).collect()
    rows = data.rows()
    comps = brute.jaccard_components([r[:2] for r in rows], 5, 80, 100)
    groups = {(c, brute.shingles(d[1], 5) and c) for d, (n, c, _) in zip(rows, comps, strict=True) if n}
    assert len([r for r in kept if brute.shingles(r.text, 5)]) == len(groups)
    assert len([r for r in kept if not brute.shingles(r.text, 5)]) == len([r for r in rows if not brute.shingles(r[1], 5)])
    assert kept[0].asDict().keys() == data.frame(spark).first().asDict().keys()


def test_secrets(spark):
    got = secrets.scan(data.frame(spark))
    from pyspark.sql import functions as F

    rows = got.select("doc_id", secrets.listed(F.col("base")).alias("b"), secrets.listed(F.col("found")).alias("f"), secrets.redact(F.coalesce("text", F.lit("")), F.col("found")).alias("masked")).collect()
    want = {d[0]: brute.base_spans(d[1])[3] for d in data.rows()}
    assert all(hashlib.sha256(r.b.encode()).hexdigest() == want[r.doc_id] for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[19].f == "" and "hunter22" not in by[21].masked


def test_markov_models_on_held_out_strings(spark, sf_dir):
    """Nine in ten of unseen random tokens are found; none of the long ordinary identifiers."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    letters = string.ascii_letters + string.digits
    secret = ["".join(rng.choice(letters) for _ in range(rng.randint(24, 48))) for _ in range(100)]
    plain = ["_".join(rng.choice(["the", "tion", "reading", "house", "order", "another", "where", "station"]) for _ in range(rng.randint(4, 8))) for _ in range(100)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = spark.createDataFrame([(10**6 + i, f"x {t} y") for i, t in enumerate(secret + plain)], "doc_id long, text string")
    found = secrets.scan(docs.union(held)).where("doc_id >= 1000000").select("doc_id", F.size("found").alias("n")).collect()
    hits = {r.doc_id - 10**6 for r in found if r.n}
    assert len([i for i in hits if i < 100]) >= 90 and not [i for i in hits if i >= 100]


def test_ids_for_other_words_are_refused():
    bpe.check_seals([5], [5, 5])
    bpe.check_seals([5], [])
    for chunk, told in (([5], [5, 6]), ([5, 5], [5]), ([], [5])):
        with pytest.raises(ValueError, match="changed between reads"):
            bpe.check_seals(chunk, told)


def test_bpe_against_tiktoken(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(data.frame(spark), str(P.path(bpe.RANKS)), P.PATTERN, ["doc_id", "hash"]).collect()
    want = []
    for d in data.rows():
        ids = own.encode_ordinary(d[1] or "")
        want.append((d[0], ids, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest()))
    same([(r.doc_id, list(r.ids), r.ids_sha256, r.decoded_sha256) for r in got], want)


def test_merge_replay_of_awkward_words():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(bpe.RANKS), "rb") as f:
        vocabulary = bpe.Merges(f.read())
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={})
    rng = random.Random(4)
    words = [b"a" * k for k in range(1, 70)] + [b" " * k for k in range(1, 40)] + [b"=" * 5000, b"a" * 30001, b"\0\0x"]
    words += [bytes(rng.choice(b"abeti ") for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 20))) for _ in range(3000)]
    assert vocabulary.encode_words(words) == [struct.pack(f"<{len(ids)}I", *ids) for ids in map(own._encode_single_piece, words)]
    assert bpe.unpack_words(bpe.pack_words(words)) == words and bpe.unpack_words(bpe.pack_words([])) == []


def test_bpe_over_many_chunks_and_parts(spark, sf_dir, monkeypatch):
    """Chunks of a few texts, several buckets and parts: the same digests as in one chunk; a text of megabytes goes whole."""
    import public_tokenizers as P

    rng = random.Random(8)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(400_000))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, long)], "doc_id long, text string"))
    run = lambda: sorted(tuple(r) for r in bpe.encode(docs, str(P.path(bpe.RANKS)), P.PATTERN, ["doc_id"], with_ids=False).collect())
    want = run()
    for name, value in (("CHUNK_CHARS", 120_000), ("BUCKET_CHUNKS", 3), ("PART_CHUNKS", 4)):
        monkeypatch.setattr(bpe, name, value)
    assert run() == want
    assert want[0][0] == -1 and want[0][3] == hashlib.sha256(long.encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_mix_against_a_schedule_slot_by_slot(spark, seed):
    rng = random.Random(seed)
    names, weights = [f"src{i}" for i in range(5)], {f"src{i}": rng.randint(1, 9) for i in range(4)}
    rows = [(i, "t", "en", rng.choices(names, [9, 1, 1, 3, 2])[0]) for i in range(400)]
    got = mixing.mix(data.frame(spark, rows), weights, rest_weight=2, block_rows=4).collect()
    size = Counter(r[3] if r[3] in weights else mixing.REST for r in rows)
    want = brute.pfair_slots({s: -(-n // 4) for s, n in size.items()}, weights | {mixing.REST: 2})
    assert {(r.source if r.source in weights else mixing.REST, r.mix_block): r.mix_slot for r in got} == want
    assert [r.mix_slot for r in sorted(got, key=lambda r: r.mix_position)] == sorted(r.mix_slot for r in got)


def test_shards_against_plain_differencing(spark):
    rng = random.Random(2)
    rows = [(i, "x" * n, "en", "s") for i, n in enumerate(rng.sample(range(50, 900_000), 37))]
    sums = Counter()
    for r in sharding.shard(data.frame(spark, rows), 5).collect():
        sums[r.shard] += r.size
    assert sorted(sums.values()) == brute.differenced([len(r[1]) + 8 for r in rows], 5)


def test_divergence_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").union(data.frame(spark).select("doc_id", "text", "lang", "source"))
    rows = docs.collect()
    got = quality.measure(docs, ["doc_id", "text", "lang"]).collect()
    want = {(r.doc_id, r.text, r.lang): w for r, w in zip(rows, brute.divergence([(r.text, r.lang) for r in rows], quality.COMMON_WORDS), strict=True)}
    for r in got:
        chars, words, failed = want[r.doc_id, r.text, r.lang]
        assert abs(r.char_distance - chars) < 1e-6 and abs(r.word_distance - words) < 1e-6, r.doc_id
        assert r.base_failed == failed and r.kept == (not failed and chars <= quality.CHAR_LIMIT and words <= quality.WORD_LIMIT + quality.NOISE / max(r.n_words, 1) ** 0.5)
    assert 0 < sum(r.kept for r in got) < sum(not r.base_failed for r in got)


def test_markov_spans_against_brute_force(spark, sf_dir):
    rng = random.Random(6)
    letters = string.ascii_letters + string.digits
    tokens = ["".join(rng.choice(letters) for _ in range(rng.randint(16, 50))) for _ in range(40)] + ["/usr/lib/module/config-server/main_view", "123e4567-e89b-12d3-a456-426614174000", "aZ9" * 9]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, f"ü {t}, token={t[:9]} {t}") for i, t in enumerate(tokens)], "doc_id long, text string"))
    models = secrets.train(docs)
    from pyspark.sql import functions as F

    got = secrets.scan(docs).select("text", secrets.listed(F.filter("found", lambda x: x["k"] == secrets.MARKOV)).alias("f")).collect()
    assert sum(r.f != "" for r in got) > 30
    assert all(r.f == ",".join(brute.markov_spans(r.text or "", models, secrets.ORDINARY)) for r in got)


ORDINARY = {
    "url path": lambda w, n: f"{w()}/{w()}/{w()}/{n(99999)}/{w()}-{w()}",
    "file path": lambda w, n: f"/usr/lib/{w()}{n(9)}/{w()}-{w()}/{w()}_{w()}",
    "dated name": lambda w, n: f"{w()}-{w()}-20{10 + n(19)}-0{n(9)}-1{n(9)}-{w()}",
    "time stamp": lambda w, n: f"{w()}_{w()}_20{10 + n(19)}0{n(9)}1{n(9)}_{100000 + n(99999)}",
    "uuid": lambda w, n: "-".join(f"{n(16**k - 1):0{k}x}" for k in (8, 4, 4, 4, 12)),
    "camel case": lambda w, n: w() + "".join(w().capitalize() for _ in range(4)),
    "constant": lambda w, n: "_".join(w().upper() for _ in range(4)),
}


def test_ordinary_identifiers_are_no_secrets(spark, sf_dir):
    """Under 2 in 100 of each kind."""
    rng = random.Random(12)
    some = "config kitchen module reading house order station python source maple render widget alpha token garden river images profile settings download".split()
    rows = [(10**6 + 100 * k + i, f"x {make(lambda: rng.choice(some), lambda most: rng.randint(1, most))} y") for k, make in enumerate(ORDINARY.values()) for i in range(100)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secrets.scan(docs.union(spark.createDataFrame(rows, "doc_id long, text string"))).where("doc_id >= 1000000 and size(found) > 0").select("doc_id").collect()
    assert all(n < 2 for n in Counter((r.doc_id - 10**6) // 100 for r in found).values())


def test_mix_positions_and_shares(spark):
    rows = [(i, "t", "en", "src0" if i % 3 else "src1") for i in range(600)]
    got = sorted(mixing.mix(data.frame(spark, rows), {"src0": 3, "src1": 1}, block_rows=8).collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in got] == list(range(600))
    phase = [r.source for r in got[: 8 * 60]]
    assert all(abs(phase[: 8 * k].count("src0") / 8 - 0.75 * k) < 1 for k in range(60))
    got = mixing.mix(data.frame(spark), {"src0": 2, "src1": 1}, block_rows=2).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(data.rows())))


def test_shards(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = data.frame(spark).select("doc_id", "text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    got, want = sharding.shard(docs, 5).collect(), docs.collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    same([(r.doc_id, r.size, r.text_crc32) for r in got], [(d.doc_id, len((d.text or "").encode()) + 8, crc(d.text)) for d in want])
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) <= 0.01 * sum(sums.values()) / 5
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.text_crc32 == crc(data.rows()[3][1])}) == 1


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float((i * 7 + d) % 5 - 2) / 3 for d in range(4)]) for i in range(60)] + [(60, None), (80, [nan, 0.0, 0.0, 0.0]), (100, [inf, 0.0, 0.0, 0.0]), (120, [None, 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = topk.top_k(df, every=20, k=5, candidates=16, queries=2).collect()
    assert {tuple(r) for r in got} == brute.best_products(exact, 20, 5)


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", None), (5, 0, None, "z"), (5, 0, None, "z"), (None, 0, "user", "n")]
    got = {r.conv_id: r for r in chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got, key=str) == [1, 4, 5, None] and got[1].n_copies == 2 and got[5].n_turns == 2
    assert got[1].rendered == "<|user|>\na\n<|bot|>\nb\n<|end|>" and got[4].rendered == "<|user|>\n\n<|end|>"


@pytest.mark.parametrize("turns", [511, 512, 513, 30_000])
def test_chat_of_very_long_conversations(spark, turns):
    long = spark.range(turns).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    begun = long.where(F.col("turn") < turns - 1).withColumn("conv_id", F.lit(3).cast("long"))
    other = long.withColumn("conv_id", F.lit(1).cast("long")).withColumn("text", F.when(F.col("turn") == turns - 2, "else").otherwise(F.col("text")))
    got = {r.conv_id: r for r in chat.collapse(long.union(begun).union(other).union(long)).collect()}
    assert sorted(got) == [1, 3, 7] and got[7].n_turns == 2 * turns  # 7's turns are there twice, so that 3 doesn't begin it
    got = {r.conv_id: r for r in chat.collapse(long.union(begun).union(other)).collect()}
    assert sorted(got) == [1, 7] and got[7].n_turns == turns
    assert got[7].rendered == "".join(f"<|user|>\nt{k}\n" for k in range(turns)) + "<|end|>"


def test_surrogates(spark):
    got = pii.surrogates(data.frame(spark)).collect()
    assert len(got) == len(data.rows())
    by = {r.doc_id: r for r in got}
    assert by[11].text is None and by[11].n_entities == 0 and by[10].text == ""
    mail, named = by[24].text, by[25].text
    assert "kim@" not in mail and "4111 1111" not in mail and "0199" not in mail and "Kowalski" not in named
    new = mail.split()[1]
    assert new.endswith(".com") and new in named
    assert mail.split("card ")[1].count(" ") == 3 and by[25].n_entities == 4
    again = {r.doc_id: r.text for r in pii.surrogates(data.frame(spark)).collect()}
    assert again == {r.doc_id: r.text for r in got}


def test_surrogates_of_phone_forms_titles_and_untitled_names(spark):
    phones = ["01 23 45 67 89", "+33 1 23 45 67 89", "01.23.45.67.89", "0171/1234567", "+49 171/123 4567"]
    rows = [(i, f"call {x} now", "fr", "s") for i, x in enumerate(phones)]
    rows += [(10, "M. Dupont, Madame Claire Martin, Κύριος Παππάς; κ. Νίκος Παππάς. Size M Large", "fr", "s"), (11, "Smith wrote. Mr John Smith met Mrs Ann Lee-Smith. John Smith, Smith's and Smithson; Lee-Smith left.", "en", "s"), (12, "Smith without a title, 05/12/2024 and 1/2", "en", "s")]
    by = {r.doc_id: r for r in pii.surrogates(data.frame(spark, rows)).collect()}
    for i, x in enumerate(phones):
        new = by[i].text[5:-4]
        assert by[i].n_entities == 1 and new != x and [c for c in new if not c.isdigit()] == [c for c in x if not c.isdigit()] and len(new) == len(x)
    named, said = by[10].text, by[11].text
    assert by[10].n_entities == 4 and named.endswith("Size M Large") and not any(x in named for x in ("Dupont", "Claire", "Martin", "Παππάς", "Νίκος"))
    assert named.startswith("M. ") and "Madame " in named and named.split("; ")[0].split()[-1] == named.split(". Size")[0].split()[-1]
    family, given = said.split()[0], said.split()[3]
    assert by[11].n_entities == 6 and said.startswith(f"{family} wrote. Mr {given} {family} met Mrs ") and f". {given} {family}, {family}'s and Smithson; " in said
    assert "Smith" not in said.replace("Smithson", "") and said.split("; ")[1].split()[0] == said.split(". ")[1].split()[-1]
    assert by[12].text == rows[-1][1] and by[12].n_entities == 0


LABELLED = [
    ("Mail {} today", "x@y.co"), ("Mail {}, thanks", "anna.lee+news@mail.example.org"), ("at {} now", "10.0.0.7"), ("host {}.", "192.168.17.250"), ("IBAN {} please", "DE89 3704 0044 0532 0130 00"),
    ("iban {}", "GB29NWBK60161331926819"), ("SSN {} on file", "123-45-6789"), ("card {} ok", "4111 1111 1111 1111"), ("card {} ok", "378282246310005"), ("call {} or", "+1 (555) 555-0199"), ("call {}", "555.123.4567"),
    ("tel {}", "(030) 123 4567"), ("tel {}", "0171 123 4567"), ("met {} there", "Mary Miller"), ("met {} there", "Dr. Miller"), ("met {} there", "Hans Weber"), ("met {} there", "Ольга Иванова"), ("met {} there", "Νίκος Παππάς"), ("met {} there", "Mr כהן"), ("met {} there", "Dr. 田中 太郎"),
]
CLEAN = ["order 12345678 of 20240611", "12.345.678 items", "2024-06-11 10:15", "version 1.2.3 of 7", "room 4 1 1", "Paris and London", "Size M Large", "a 3 4 5 b", "serial 99887766554"]


def test_surrogates_against_labels(spark):
    """Every labelled entity goes and nothing else; surrogates keep type, script, format and checks, differ, and recur."""
    import re

    rows = [(i, t.format(e), "en", "s") for i, (t, e) in enumerate(LABELLED)] + [(100 + i, t, "en", "s") for i, t in enumerate(CLEAN)] + [(200 + i, f"again: {e}; end", "en", "s") for i, (_, e) in enumerate(LABELLED)]
    by = {r.doc_id: r for r in pii.surrogates(data.frame(spark, rows)).collect()}
    assert all(by[100 + i].text == t and by[100 + i].n_entities == 0 for i, t in enumerate(CLEAN))
    new = []
    for i, (t, e) in enumerate(LABELLED):
        head, tail = t.split("{}")
        assert by[i].n_entities == 1 and by[i].text.startswith(head) and by[i].text.endswith(tail) and e not in by[i].text, e
        new.append(by[i].text[len(head) : len(by[i].text) - len(tail)])
        assert by[200 + i].text == f"again: {new[-1]}; end"
    assert len(set(new)) == len(new)
    for (_, e), n in zip(LABELLED, new, strict=True):
        if re.match(r"^[\d+(]", e) and "." not in e[:4]:
            assert re.sub(r"\d", "9", n) == re.sub(r"\d", "9", e)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(re.sub(r"\D", "", d)))) % 10
    assert luhn(new[7]) == luhn(new[8]) == 0
    for n in new[4:6]:
        plain = n.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain[:2] in ("DE", "GB")
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", new[6])
    assert new[13].split()[1] == new[14].split()[1] and new[13].split()[0][-1] == "a"
    scripts = ["[А-яЁё]", "[Ͱ-Ͽ]", "[\u0590-\u05ff]", "[\u4e00-\u9fff]"]
    assert all(re.fullmatch(rf"(?:(?:Mr|Dr\.) )?{s}+(?: {s}+)?", n) for s, n in zip(scripts, new[16:20], strict=True))


def test_surrogates_of_more_short_addresses_than_there_are(spark):
    letters = string.ascii_lowercase
    rows = [(i, f"{a}@{b}.co", "en", "s") for i, (a, b) in enumerate((a, b) for a in letters for b in letters[:20])]
    got = [r.text for r in pii.surrogates(data.frame(spark, rows)).collect()]
    assert len(set(got)) == len(rows) and not set(got) & {r[1] for r in rows}


def test_empty_tables(spark):
    import public_tokenizers as P

    none = data.frame(spark, [])
    runs = [dedup.remove_repeats(none), quality.measure(none, ["doc_id"]), jaccard.jaccard_join(none), jaccard.keep_one(none), secrets.scan(none), bpe.encode(none, str(P.path(bpe.RANKS)), P.PATTERN, ["doc_id"]), mixing.mix(none, {"src0": 1}), sharding.shard(none), pii.surrogates(none)]
    assert [df.count() for df in runs] == [0] * len(runs)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), 20).count() == 0
    assert chat.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("fan_in", [7, 50])
def test_shards_of_partial_partitions_in_levels(spark, fan_in):
    """Far more groups than one task combines: levels of partial partitions, against sums worked out block by block."""
    rng = random.Random(13)
    sizes = {hashlib.sha256(str(i).encode()).digest(): rng.choice([8, 50, 900, rng.randint(1000, 9000)]) for i in range(400)}
    groups = spark.createDataFrame([(bytearray(d), n) for d, n in sizes.items()], "digest binary, bytes long")
    placed = {bytes(r.digest): r.shard for r in sharding.balance(groups, 6, len(sizes), fan_in).collect()}
    assert set(placed) == set(sizes) and set(placed.values()) == set(range(6))
    held = [sum(n for d, n in sizes.items() if placed[d] == s) for s in range(6)]
    assert max(held) - min(held) <= max(sizes.values())
    blocks = -(-len(sizes) // fan_in)
    of = {bytes(r.digest): r.b for r in groups.select("digest", sharding.bucket_of(F.xxhash64("digest"), blocks).alias("b")).collect()}
    level = {}
    for b in set(of.values()):
        own = sorted((d for d in sizes if of[d] == b), key=lambda d: (-sizes[d], d))
        level[b] = sharding.difference(np.array([[sizes[d]] + [0] * 5 for d in own]))[1]
    while blocks > 1:
        above = {}
        for b in sorted(level):
            above.setdefault(b // fan_in, []).append(level[b])
        level, blocks = {a: sharding.difference(np.array(p))[1] for a, p in above.items()}, -(-blocks // fan_in)
    assert held == level[0].tolist()
