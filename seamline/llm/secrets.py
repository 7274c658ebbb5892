"""Secret scans: base patterns, and tokens that a character model of random strings explains best.

First-order Markov models over characters are trained from labelled samples: random strings in hex
and in base 64 (digests of counted seeds), and ordinary identifiers: words of WORD_DOCS different
documents (those of least hash) and ORDINARY_WORDS, as they stand in paths, dated and numbered names;
in capitals; and in camel case. Counts of pairs are smoothed by those of single characters. A token is a
secret when the best of the random models is over the best of the ordinary ones by both limits, for the
whole token and per character. UUIDs are identifiers by their form and are left out of tokens. All of it is
DataFrame expressions; only character-pair counts reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions.matrices import let

from .common import table

#: The base kinds in their order with their patterns. A kind's last number is the least length of
#: the given group. Access keys and hex runs carry their length in the pattern, which finds the same matches,
#: as a run that is too short has no long enough run in it; assignments don't, as a short one hides what it covers.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
MARKOV = "markov"
#: Tokens that the models judge.
TOKEN, LEAST_TOKEN = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Bounds of the labelled samples: random strings, and documents whose words are identifiers.
RANDOM_STRINGS, WORD_DOCS = 2000, 150
RATIO, RATIO_PER_CHAR = 20.0, 0.75
#: Labelled sample of ordinary words, besides those of documents; each counts so many times.
ORDINARY_WORDS = (
    "access account action admin agent alpha android app archive array asset async audio auth backup base batch beta bin block body branch bucket buffer build button cache call channel chart check class client cloud cluster code column command commit common component config connection "
    "console content context control controller core count country create current data database date debug default delete demo deploy detail device dist docs document domain download drive driver editor element email engine entry error event example export factory feature field file filter "
    "final first flag folder font form format frame function gateway global graph group handler header health helper history home host html http image import index info init input install instance integer internal item java job json kernel key label language layer layout level library "
    "license limit line link linux list loader local log login machine main manager map master media memory menu message meta method metric model module monitor name network node note number object offset option order output package page panel parent parser password path pattern picture "
    "player plugin policy pool port post prefix preview price process product profile program project property protocol provider proxy public python query queue random range reader record region registry release remote report request resource response result return root route rule runtime "
    "sample schema scope screen script search section security select server service session setting shared size source stage start state static status storage store stream string style submit summary support switch system table target task template test text theme thread time timeout title "
    "token tool topic total tracker train transfer tree type unit update upload upper user util valid value vendor version video view virtual volume wallet warning watch web widget window worker workspace wrapper write"
).split()
ORDINARY_WEIGHT = 40
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: Tokens are of characters + to z.
FIRST, SIZE = 43, 80
#: How many models of ordinary identifiers come first.
ORDINARY = 3
#: Weight of single characters' shares in a pair's, and of an even share in these.
BACKOFF, EVEN = 20.0, 0.1
MASK = "<SECRET>"
_SPAN = "array<struct<s:int,e:int>>"
_SPANS = "array<struct<s:int,i:int,e:int,k:string>>"
_TOLD = "array<struct<s:int,i:int,e:int,k:string,m:string>>"


#: Matches whose places are summed up together, bits of a search in a sorted array, characters of a block of text.
RUN, HALVINGS, BLOCK = 64, 31, 1024


def find(text: Column, kind: str, order: int, pattern: str, group: int, least: int, with_text: bool = False) -> Column:
    """Leftmost matches of ``pattern`` whose ``group`` has ``least`` characters: start, order, end (code points, exclusive), kind, and the match if asked for.

    Places are sums of the lengths before. They are summed within runs of RUN matches, and the runs' sums on top,
    so that many matches in a text don't cost their square.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n")))

    def placed(steps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(steps) - 1) / RUN).cast("int")), lambda i: F.slice(steps, i * RUN + 1, F.lit(RUN)))
        end = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1)["e"], F.lit(0))
        step = lambda acc, x: F.concat(acc, F.array(F.struct((end(acc) + x["gap"]).alias("s"), (end(acc) + x["gap"] + x["n"]).alias("e"))).cast(_SPAN))
        inside = F.transform(runs, lambda run: F.aggregate(run, F.array().cast(_SPAN), step))
        starts = lambda inside: F.aggregate(inside, F.array(F.lit(0)), lambda acc, run: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + end(run))))
        moved = lambda both: F.flatten(F.transform(both["inside"], lambda run, i: let(F.get(both["starts"], i), lambda at: F.transform(run, lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"))))))
        return let(inside, lambda inside: let(F.struct(inside.alias("inside"), starts(inside).alias("starts")), moved))

    at = let(steps, placed)
    kept = F.filter(F.arrays_zip(at.alias("x"), groups.alias("g"), matches.alias("m")), lambda x: F.length(x["g"]) >= least)
    found = F.transform(kept, lambda x: F.struct(x["x"]["s"].alias("s"), F.lit(order).alias("i"), x["x"]["e"].alias("e"), F.lit(kind).alias("k"), *([x["m"].alias("m")] if with_text else [])))
    kind_of_rows = _TOLD if with_text else _SPANS
    return F.when(F.regexp_like(text, F.lit(pattern)), found.cast(kind_of_rows)).otherwise(F.array().cast(kind_of_rows))


def below(sorted_values: Column, x: Column) -> Column:
    """How many of a sorted array's values are below x, by halving."""
    half = lambda acc: F.shiftright(acc["lo"] + acc["hi"], 1)
    low = lambda acc: F.get(sorted_values, half(acc)) < x
    step = lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.when(low(acc), F.struct((half(acc) + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), half(acc).alias("hi"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0).alias("lo"), F.size(sorted_values).alias("hi")), step, lambda acc: acc["lo"])


def _as_identifiers(word: Column, h: Column) -> Column:
    """array<struct<label, token>>: a word as it stands in paths, dated and numbered names (0), capitals (1) and camel case (2)."""
    low, up, title = F.lower(word), F.upper(word), F.initcap(F.lower(word))
    pick = lambda n, shift, width: F.lpad(F.pmod(F.shiftright(h, shift), F.lit(n)).cast("string"), width, "0")
    year, month, day = F.concat(F.lit("20"), pick(40, 3, 2)), F.lpad((F.pmod(F.shiftright(h, 9), F.lit(12)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(F.shiftright(h, 15), F.lit(28)) + 1).cast("string"), 2, "0")
    plain = [F.concat(F.lit("/"), low, F.lit("/")), F.concat(F.lit("_"), low, F.lit("_")), F.concat(F.lit("-"), low, F.lit("-")), F.concat(F.lit("/"), title, F.lit("-")), F.concat_ws("-", low, year, month, day, low), F.concat_ws("/", low, year, month, day, low), F.concat_ws("_", low, F.concat(year, month, day), pick(1000000, 21, 6)), F.concat(low, pick(100, 5, 1), F.lit("/v"), pick(10, 7, 1), F.lit("/")), F.concat(F.lit("-"), pick(10000, 11, 1), F.lit("_"), low, pick(1000, 17, 1), F.lit("="))]
    capital = [F.concat(F.lit("_"), up, F.lit("_")), F.concat(up, pick(100, 5, 1), F.lit("-")), F.concat_ws("_", up, year, month)]
    camel = [F.concat(low, title, title), F.concat(title, pick(100, 5, 1), title), F.concat(F.lit("_"), low, title, F.lit("/"), title)]
    return F.array(*[F.struct(F.lit(k).alias("label"), x.alias("token")) for k, kind in enumerate((plain, capital, camel)) for x in kind])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[list[float]]:
    """Logarithms of each following character's share, SIZE * SIZE a model: ORDINARY of ordinary identifiers, then hex and base 64."""
    spark = docs.sparkSession
    seed = spark.range(RANDOM_STRINGS).select(F.sha2(F.concat(F.lit("random "), "id"), 256).alias("hex"))
    random = seed.select(F.posexplode(F.array("hex", F.base64(F.unhex("hex")))).alias("label", "token")).select((F.col("label") + ORDINARY).alias("label"), "token", F.lit(1).cast("long").alias("n"))
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"))
    last = rows.select("h").distinct().orderBy("h").limit(WORD_DOCS).agg(F.max("h")).first()[0]
    sample = rows.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text"))
    said = sample.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z]{4,}"), F.lit(0))).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    words = said.union(spark.range(1).select(F.explode(F.split(F.lit(" ".join(ORDINARY_WORDS)), " ")), F.lit(ORDINARY_WEIGHT).cast("long")))
    ordinary = words.select(F.explode(_as_identifiers(F.col("word"), F.xxhash64("word"))).alias("x"), "n").select("x.label", "x.token", "n")
    pairs = random.union(ordinary).select("token", "label", "n", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("at"))
    rows = pairs.groupBy("label", F.ascii(F.substring("token", F.col("at"), F.lit(1))).alias("a"), F.ascii(F.substring("token", F.col("at") + 1, F.lit(1))).alias("b")).agg(F.sum("n").alias("n")).collect()
    counts = [[[0.0] * SIZE for _ in range(SIZE)] for _ in range(ORDINARY + 2)]
    for r in rows:
        counts[r["label"]][r["a"] - FIRST][r["b"] - FIRST] += r["n"]
    return [_log_shares(c) for c in counts]


def _log_shares(counts: list[list[float]]) -> list[float]:
    """Logarithm of each following character's share, smoothed."""
    single = [sum(column) for column in zip(*counts, strict=True)]
    total = sum(single) or 1.0
    base = [(1 - EVEN) * x / total + EVEN / SIZE for x in single]
    return [math.log((x + BACKOFF * b) / (sum(row) + BACKOFF)) for row in counts for x, b in zip(row, base, strict=True)]


def ratio(token: Column, models: list[list[float]]) -> Column:
    """Log-likelihood of the best random model over the best ordinary one, along a token. Its pairs are looked up once for all models."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)
    pairs = let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: x * SIZE + y))

    def score(pairs: Column) -> Column:
        best = lambda some: F.greatest(*(_along(pairs, w) for w in some))
        return best(models[ORDINARY:]) - best(models[:ORDINARY])

    return let(pairs, score)


def _along(pairs: Column, weights: list[float]) -> Column:
    """Sum of a model's logarithms over the pairs of a token."""
    model = F.split(F.lit(",".join(f"{x:.4f}" for x in weights)), ",").cast("array<double>")
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.get(model, x))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``base`` and ``found`` to ``docs``: base spans, and these with the models' spans, each (s, i, e, k) by start and kind.

    A model's span that overlaps a base span is not added. Null texts count as empty. Repeated
    rows are scanned each; a column named like an added one is replaced; an empty table trains on
    no identifiers and gives an empty result.
    """
    models = train(docs, id_col, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = F.array_sort(F.concat(*(find(text, k, i, *rule) for i, (k, rule) in enumerate(KINDS.items()))))
    judged = find(text, MARKOV, len(KINDS), TOKEN, 0, LEAST_TOKEN, with_text=True)

    def random(x: Column) -> Column:
        scored = lambda token: (F.length(token) >= LEAST_TOKEN) & let(ratio(token, models), lambda score: (score >= RATIO) & (score >= RATIO_PER_CHAR * F.length(token)))
        return F.coalesce(let(F.regexp_replace(x["m"], UUID, ""), scored), F.lit(False))

    def apart(found: Column) -> Column:
        """Those that no base span overlaps: as many base spans begin before their end as end by their start."""
        bounds = F.struct(F.array_sort(F.transform("base", lambda y: y["s"])).alias("s"), F.array_sort(F.transform("base", lambda y: y["e"])).alias("e"))
        return let(bounds, lambda b: F.filter(found, lambda x: below(b["s"], x["e"]) == below(b["e"], x["s"] + 1)))

    secret = F.transform(apart(F.filter("found", random)), lambda x: F.struct(x["s"].alias("s"), x["i"].alias("i"), x["e"].alias("e"), x["k"].alias("k"))).cast(_SPANS)
    return docs.withColumn("base", base).withColumn("found", judged).withColumn("found", F.array_sort(F.concat("base", secret)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by MASK.

    A run begins where all spans that began before have ended. The text is taken in blocks, so that each gap between runs
    is put together from the blocks that it lies in.
    """

    def runs(b: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(b["s"]) - 1), lambda i: (i == 0) | (F.get(b["e"], i - 1) <= F.get(b["s"], i)))
        return let(first, lambda f: F.struct(F.transform(f, lambda i: F.get(b["s"], i)).alias("s"), F.transform(f, lambda i: F.when(i > 0, F.get(b["e"], i - 1)).otherwise(0)).alias("e"), F.get(b["e"], F.size(b["e"]) - 1).alias("last")))

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        """Characters a to b - 1."""
        i, j = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        one = F.substring(F.get(blocks, i), F.pmod(a, F.lit(BLOCK)) + 1, b - a)
        more = F.concat(F.substring(F.get(blocks, i), F.pmod(a, F.lit(BLOCK)) + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.substring(F.get(blocks, j), F.lit(1), F.pmod(b - 1, F.lit(BLOCK)) + 1))
        return F.when(a >= b, "").when(i == j, one).otherwise(more)

    def built(x: Column) -> Column:
        gaps = F.zip_with(x["r"]["e"], x["r"]["s"], lambda a, b: piece(x["blocks"], a, b))
        return F.concat(F.array_join(gaps, MASK), F.lit(MASK), piece(x["blocks"], x["r"]["last"], F.length(text)))

    bounds = F.struct(F.array_sort(F.transform(spans, lambda x: x["s"])).alias("s"), F.array_sort(F.transform(spans, lambda x: x["e"])).alias("e"))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(blocks.alias("blocks"), let(bounds, runs).alias("r")), built))


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, their digest and all spans of all documents."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
