"""The library's queries over the given tables, each with the DuckDB SQL that checks it where SQL can.

Stand-ins: orders name folders, embeddings are tile features (image_id = vec_id div 8, pos = vec_id % 8,
bank rows have vec_id % 5 = 0), events are scored images of a class, lineitem rows are method results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import names, vectors
from seamline.functions.stats import percent
from seamline.operators import catalog, coreset, ensemble, evaluate, grid, knn, metrics, raster, selfval
from seamline.plans.lineage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# Catalogue -----------------------------------------------------------------------------------

_W, _H, _I = "((o_custkey % 20) * 10 + 100)", "((o_orderkey % 7) * 10 + 50)", "(8 + 2 * (o_custkey % 7))"
_NAME = f"concat({{date}}, '_', CASE o_orderkey % 5 WHEN 0 THEN 'H' WHEN 1 THEN concat('W', CAST({_I} AS {{s}}), 'x') WHEN 2 THEN concat('HP', CAST({_I} AS {{s}}), 'x') ELSE '' END, CAST({_W} AS {{s}}), 'x', CAST({_H} AS {{s}}))"
_PARSE = r"""n AS (SELECT o_orderkey AS id, %s AS name FROM orders),
m AS (SELECT id, name, regexp_extract(name, '[\s_]((H|W\d+x|HP\d+x)?(\d+)x(\d+))', 1) AS raw, CAST(regexp_extract(name, '[\s_]((H|W\d+x|HP\d+x)?(\d+)x(\d+))', 3) AS INTEGER) AS d1, CAST(regexp_extract(name, '[\s_]((H|W\d+x|HP\d+x)?(\d+)x(\d+))', 4) AS INTEGER) AS d2 FROM n),
i AS (SELECT *, regexp_extract(raw, '^(?:W|HP)(\d+)x', 1) AS inch FROM m),
k AS (SELECT *, CASE inch WHEN '10' THEN 254 WHEN '12' THEN 305 WHEN '14' THEN 356 WHEN '16' THEN 406 WHEN '18' THEN 457 WHEN '21' THEN 533 WHEN '24' THEN 610 WHEN '27' THEN 686 WHEN '30' THEN 762 END AS mm FROM i),
f AS (SELECT id, name, raw AS raw_spec, CASE WHEN raw LIKE 'W%%' THEN mm WHEN raw LIKE 'HP%%' THEN coalesce(mm, d1) ELSE d1 END AS width_mm,
  CASE WHEN raw LIKE 'W%%' THEN mm WHEN raw LIKE 'HP%%' THEN coalesce(mm, d1) ELSE d2 END AS height_mm, regexp_replace(raw, '^H(\d+x\d+)', '\1') AS spec_key, CAST(strptime(name[1:8], '%%Y%%m%%d') AS DATE) AS prod_date FROM k),
folders AS (SELECT * FROM f WHERE width_mm IS NOT NULL)""" % _NAME.format(date="strftime(o_orderdate, '%Y%m%d')", s="VARCHAR").replace("%", "%")


def folders(spark: SparkSession, sf: str) -> DataFrame:
    """id, name, raw_spec, width_mm, height_mm, spec_key, prod_date of folders named after orders."""
    named = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_NAME.format(date="date_format(o_orderdate, 'yyyyMMdd')", s="STRING")).alias("name"))
    parsed = named.select("id", "name", names.parse_spec(F.col("name")).alias("s"), names.prod_date(F.col("name")).alias("prod_date")).where("s is not null")
    return parsed.select("id", "name", "s.*", names.spec_key(F.col("s.raw_spec")).alias("spec_key"), "prod_date")


@query(f"WITH {_PARSE} SELECT * FROM folders")
def catalog_parse_spec(spark, sf):
    return folders(spark, sf)


_DATES = "SELECT spec_key, count(*) AS n_folders, count(DISTINCT prod_date) AS n_dates, min(prod_date) AS first_date, max(prod_date) AS last_date FROM folders GROUP BY spec_key"


@query(f"WITH {_PARSE} {_DATES}")
def catalog_dates_per_spec(spark, sf):
    return folders(spark, sf).groupBy("spec_key").agg(F.count(F.lit(1)).alias("n_folders"), F.count_distinct("prod_date").alias("n_dates"), F.min("prod_date").alias("first_date"), F.max("prod_date").alias("last_date"))


@query(f"WITH {_PARSE} {_DATES} ORDER BY n_folders DESC, spec_key LIMIT 50")
def catalog_top_specs(spark, sf):
    return catalog_dates_per_spec(spark, sf).orderBy(F.desc("n_folders"), "spec_key").limit(50)


@query(f"WITH {_PARSE} SELECT * FROM ({_DATES}) WHERE n_folders >= 20")
def catalog_trainable(spark, sf):
    return catalog_dates_per_spec(spark, sf).where("n_folders >= 20")


_NEAR = """, z AS (SELECT spec_key, max(width_mm) AS w, max(height_mm) AS h, count(*) AS n, min(id) AS id FROM folders GROUP BY spec_key)
SELECT s.spec_key, min_by(t.spec_key, struct_pack(d := (s.w - t.w) * (s.w - t.w) + (s.h - t.h) * (s.h - t.h), id := t.id)) AS nearest_spec, round(sqrt(min((s.w - t.w) * (s.w - t.w) + (s.h - t.h) * (s.h - t.h))), 6) AS distance
FROM z s, z t WHERE s.n < 20 AND t.n >= 20 GROUP BY s.spec_key"""


@query(f"WITH {_PARSE}{_NEAR}")
def catalog_fallback_nearest(spark, sf):
    """For specs of few folders, the nearest spec with enough."""
    size = folders(spark, sf).groupBy("spec_key").agg(F.max("width_mm").alias("w"), F.max("height_mm").alias("h"), F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    point = cut(size.select("id", "spec_key", "n", F.array(F.col("w").cast("double"), F.col("h").cast("double")).alias("v")))  # names are parsed once, not by each use
    near = knn.neighbours(point.where("n < 20"), point.where("n >= 20"), 1)
    return near.join(point.select(F.col("id").alias("query_id"), "spec_key"), "query_id").join(point.select(F.col("id").alias("bank_id"), F.col("spec_key").alias("nearest_spec")), "bank_id").select("spec_key", "nearest_spec", r6(F.col("distance")).alias("distance"))


_SAMPLE = """, d AS (SELECT prod_date, row_number() OVER (ORDER BY prod_date) AS k, count(*) OVER () AS nd FROM (SELECT DISTINCT prod_date FROM folders)),
r AS (SELECT f.*, row_number() OVER (PARTITION BY f.prod_date ORDER BY md5(CAST(id AS VARCHAR)), CAST(id AS VARCHAR)) AS rn, 1000 // nd + CASE WHEN k <= 1000 % nd THEN 1 ELSE 0 END AS quota FROM folders f JOIN d USING (prod_date)),
a AS (SELECT * FROM r WHERE rn <= quota),
b AS (SELECT * FROM r WHERE rn > quota ORDER BY md5(CAST(id AS VARCHAR)), CAST(id AS VARCHAR) LIMIT (SELECT greatest(1000 - count(*), 0) FROM a))
SELECT id, name FROM a UNION ALL SELECT id, name FROM b"""


@query(f"WITH {_PARSE}{_SAMPLE}")
def catalog_sample_stratified(spark, sf):
    rows = folders(spark, sf).withColumn("key", F.col("id").cast("string"))
    return catalog.stratified(rows, 1000, key="key").select("id", "name")


_SEQ = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"WITH {_SEQ} SELECT user_id, event_id FROM e WHERE n > 20 AND rn > 10 AND rn <= n - 10 AND (rn - 11) % 3 = 0")
def images_trim_stride(spark, sf):
    return catalog.trim_stride(_t(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 10, 10, 3).select("user_id", "event_id")


@query(f"WITH {_SEQ} SELECT user_id, event_id FROM e WHERE n > 20 AND rn > 10 AND rn <= n - 10 AND (rn - 11) % 3 = 1")
def images_holdout(spark, sf):
    return catalog.trim_stride(_t(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 10, 10, 3, 1).select("user_id", "event_id")


@query(f"WITH {_SEQ} SELECT user_id, event_id FROM e WHERE (rn - 1) % greatest(n // 20, 1) = 0 AND (rn - 1) // greatest(n // 20, 1) < 20")
def images_cap_even(spark, sf):
    return catalog.cap_even(_t(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@query("SELECT date, event_id FROM (SELECT CAST(ts AS DATE) AS date, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 5")
def images_first_n_per_date(spark, sf):
    rows = _t(spark, sf, "events").select(F.to_date("ts").alias("date"), "event_id", "ts")
    return catalog.first_n(rows, ["date"], ["ts", "event_id"], 5).select("date", "event_id")


@query(f"WITH {_SEQ} SELECT user_id, event_id, CAST(rn - 1 AS INTEGER) AS rank FROM e WHERE rn - 1 IN (0, n // 4, n // 2)")
def images_middle_pick(spark, sf):
    return catalog.picks(_t(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "rank")


@query("SELECT concat(CAST(o_custkey AS VARCHAR), '_', CAST(o_orderkey AS VARCHAR)) AS name FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100")
def images_natural_sort(spark, sf):
    rows = _t(spark, sf, "orders").select(F.concat_ws("_", "o_custkey", "o_orderkey").alias("name"))
    return rows.orderBy(names.natural_key(F.col("name"))).limit(100)


@query("WITH e AS (SELECT event_id, CAST(ts AS DATE) AS date FROM events), c AS (SELECT min(date) AS f FROM (SELECT DISTINCT date FROM e ORDER BY date DESC LIMIT 3)) SELECT event_id, date, CASE WHEN date >= f THEN 'test' ELSE 'train' END AS split FROM e, c")
def split_latest_dates(spark, sf):
    return catalog.latest_split(_t(spark, sf, "events").select("event_id", F.to_date("ts").alias("date")), "date", 3)


@query("SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE event_id % 10 + 1 = {i}) AS BIGINT) AS cam_{i}" for i in range(1, 11)) + ", count(*) AS total FROM events GROUP BY user_id")
def catalog_inventory(spark, sf):
    from seamline.sources.images import inventory

    rows = _t(spark, sf, "events").select(F.col("user_id").alias("folder"), (F.col("event_id") % 10 + 1).cast("int").alias("cam_id"))
    return inventory(rows).withColumnRenamed("folder", "user_id")


_PLAN = """WITH s AS (SELECT DISTINCT concat(CAST(p_size * 10 AS VARCHAR), 'x', CAST(p_partkey % 7 * 10 + 50 AS VARCHAR)) AS spec_key, p_size * 10 * (p_partkey % 7 * 10 + 50) AS area FROM part),
j AS (SELECT spec_key, CAST(g AS INTEGER) AS group_id, area FROM s, range(1, 6) t(g))
SELECT spec_key, group_id, CASE WHEN area % 3 = 0 AND group_id <= 2 THEN 'EXISTS' ELSE 'TODO' END AS status, CAST(area AS BIGINT) AS priority FROM j"""


def _jobs(spark, sf):
    h = F.col("p_partkey") % 7 * 10 + 50
    specs = _t(spark, sf, "part").select(F.concat_ws("x", F.col("p_size") * 10, h).alias("spec_key"), (F.col("p_size") * 10 * h).cast("long").alias("area")).distinct()
    done = specs.where("area % 3 = 0").select("spec_key", F.explode(F.array(F.lit(1), F.lit(2))).alias("group_id"))
    return catalog.plan(specs, 5, done, F.col("area")).select("spec_key", "group_id", "status", "priority")


@query(_PLAN)
def plan_jobs(spark, sf):
    return _jobs(spark, sf)


@query(f"SELECT * FROM ({_PLAN}) WHERE status = 'TODO'")
def plan_resume_anti(spark, sf):
    from seamline.sources.images import unfinished

    jobs = _jobs(spark, sf)
    return unfinished(jobs, jobs.where("status = 'EXISTS'").select("spec_key", "group_id"), ["spec_key", "group_id"])


@query(f"SELECT * FROM ({_PLAN}) WHERE status = 'TODO' ORDER BY priority DESC, spec_key, group_id LIMIT 20")
def plan_priority_order(spark, sf):
    return _jobs(spark, sf).where("status = 'TODO'").orderBy(F.desc("priority"), "spec_key", "group_id").limit(20)


# Grids and masks -----------------------------------------------------------------------------

_GRID = "SELECT CAST(r * {nx} + c AS INTEGER) AS tile_idx, CAST(c * {s} AS INTEGER) AS tile_x, CAST(r * {s} AS INTEGER) AS tile_y, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM range({ny}) a(r), range({nx}) b(c)"


@query(_GRID.format(nx=15, ny=9, s=128))
def grid_tiles(spark, sf):
    return grid.tiles(spark, 1920, 1200, 128, 128)


@query(f"SELECT * FROM ({_GRID.format(nx=80, ny=50, s=24)}) WHERE row % 2 = 0 AND col % 2 = 0")
def grid_cells_stride2(spark, sf):
    return grid.stride2(grid.tiles(spark, 1920, 1200, 24, 24))


@query(f"WITH t AS ({_GRID.format(nx=14, ny=8, s=128)}) SELECT CAST(tile_x // 128 + i AS INTEGER) AS cell_x, CAST(tile_y // 128 + j AS INTEGER) AS cell_y, round(avg(tile_idx % 10), 6) AS heat FROM t, range(2) a(i), range(2) b(j) GROUP BY 1, 2")
def grid_overlap_heatmap(spark, sf):
    scores = grid.tiles(spark, 1920, 1200, 256, 128).withColumn("score", F.col("tile_idx") % 10)
    return grid.overlap_heatmap(scores, 256, 128).withColumn("heat", r6("heat"))


@query("SELECT l_suppkey AS folder, l_linenumber AS tile_idx, avg(l_quantity) >= 25 AS valid FROM lineitem GROUP BY 1, 2")
def tiles_mask_brightness(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("folder"), F.col("l_linenumber").alias("tile_idx"), F.col("l_quantity").alias("brightness"))
    return grid.brightness_mask(rows, ["folder", "tile_idx"], 25)


@query("WITH m AS (SELECT l_suppkey AS folder, l_linenumber AS tile_idx, avg(l_quantity) >= 25 AS valid FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2), t AS (SELECT s_suppkey AS folder, CAST(i AS INTEGER) AS tile_idx FROM supplier, range(1, 8) r(i)) SELECT folder, tile_idx, coalesce(valid, true) AS valid FROM t LEFT JOIN m USING (folder, tile_idx)")
def tiles_mask_left_join(spark, sf):
    mask = tiles_mask_brightness(spark, sf).where("folder % 2 = 0")
    tiles_ = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("folder"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("tile_idx"))
    return grid.masked(tiles_, mask, ["folder", "tile_idx"]).select("folder", "tile_idx", "valid")


# Vectors, banks, scores ----------------------------------------------------------------------

_TILES = "t AS (SELECT vec_id, vec_id // 8 AS image_id, vec_id % 8 AS pos, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_PAIRS = f"{_TILES}, p AS (SELECT q.vec_id, q.image_id, q.pos, q.label, b.vec_id AS bank_id, list_distance(q.v, b.v) AS d FROM t q JOIN t b ON q.vec_id % 5 <> 0 AND b.vec_id % 5 = 0)"
_SCORES = f"{_PAIRS}, s AS (SELECT vec_id, image_id, pos, label, min(d) AS score FROM p GROUP BY ALL)"


def tiles_of(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 8").alias("image_id"), (F.col("vec_id") % 8).alias("pos"), F.col("embedding").cast("array<double>").alias("v"), "label")


def scores_of(spark, sf, k=1):
    t = tiles_of(spark, sf)
    return knn.scores(t.where("id % 5 <> 0"), t.where("id % 5 = 0"), k).join(t.select("id", "image_id", "pos", "label"), "id")


@query(f"WITH {_SCORES} SELECT vec_id AS id, round(score, 6) AS score FROM s")
def knn_min(spark, sf):
    return scores_of(spark, sf).select("id", r6("score").alias("score"))


_TOPK = "SELECT vec_id AS id, round(avg(d), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, bank_id) AS rn FROM p) WHERE rn <= {k} GROUP BY 1"


@query(f"WITH {_PAIRS} {_TOPK.format(k=3)}")
def knn_mean_k3(spark, sf):
    return scores_of(spark, sf, 3).select("id", r6("score").alias("score"))


@query(f"WITH {_PAIRS} {_TOPK.format(k=5)}")
def knn_mean_k5(spark, sf):
    return scores_of(spark, sf, 5).select("id", r6("score").alias("score"))


_LOO = f"{_TILES}, p AS (SELECT q.vec_id, b.vec_id AS bank_id, list_distance(q.v, b.v) AS d FROM t q JOIN t b ON q.vec_id % 5 = 0 AND b.vec_id % 5 = 0 AND q.vec_id <> b.vec_id), l AS (SELECT vec_id, avg(d) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, bank_id) AS rn FROM p) WHERE rn <= 3 GROUP BY 1)"


@query(f"WITH {_LOO} SELECT round(avg(score), 6) AS baseline, round(quantile_cont(score, 0.95), 6) AS p95 FROM l")
def knn_loo_baseline(spark, sf):
    bank = tiles_of(spark, sf).where("id % 5 = 0")
    return knn.scores(bank, bank, 3, leave_own=True).agg(r6(F.avg("score")).alias("baseline"), r6(F.percentile("score", F.lit(0.95))).alias("p95"))


@query(f"WITH {_LOO}, b AS (SELECT avg(score) AS baseline FROM l), q AS (SELECT q.vec_id, q.image_id, b.vec_id AS bank_id, list_distance(q.v, b.v) AS d FROM t q JOIN t b ON q.vec_id % 5 <> 0 AND b.vec_id % 5 = 0), k AS (SELECT vec_id, image_id, avg(d) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, bank_id) AS rn FROM q) WHERE rn <= 3 GROUP BY ALL) SELECT image_id, count(*) FILTER (WHERE score / baseline > 1.05) AS n_defect, CASE WHEN count(*) FILTER (WHERE score / baseline > 1.05) > 0 THEN 'NG' ELSE 'OK' END AS verdict FROM k, b GROUP BY image_id")
def knn_verdict(spark, sf):
    bank = tiles_of(spark, sf).where("id % 5 = 0")
    base = knn.scores(bank, bank, 3, leave_own=True).agg(F.avg("score").alias("baseline"))
    out = scores_of(spark, sf, 3).join(F.broadcast(base)).groupBy("image_id").agg(F.count_if(F.col("score") / F.col("baseline") > 1.05).alias("n_defect"))
    return out.withColumn("verdict", F.when(F.col("n_defect") > 0, "NG").otherwise("OK"))


@query(f"WITH {_TILES} SELECT a.vec_id AS id, round(list_distance(a.v, b.v), 6) AS distance, round(list_inner_product(a.v, b.v), 6) AS dot, round(sqrt(list_inner_product(a.v, a.v)), 6) AS norm, CAST(len(list_concat(a.v, b.v)) AS INTEGER) AS width FROM t a JOIN t b ON a.vec_id = b.vec_id - 1")
def vec_functions(spark, sf):
    a = tiles_of(spark, sf)
    b = a.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return a.join(b, "id").select("id", r6(vectors.distance(F.col("v"), F.col("w"))).alias("distance"), r6(vectors.dot(F.col("v"), F.col("w"))).alias("dot"), r6(vectors.norm(F.col("v"))).alias("norm"), F.size(F.concat("v", "w")).alias("width"))


@query()
def coreset_greedy_per_model(spark, sf):
    return coreset.greedy(tiles_of(spark, sf).withColumn("model", F.col("label").cast("int")), 0.1).select("model", "pick", "id")


@query()
def coreset_partitioned(spark, sf):
    return coreset.partitioned(tiles_of(spark, sf).withColumn("model", F.lit(0)), 0.1, rows=200).select("model", "pick", "id")


_MAD = "m AS (SELECT event_type, median(value) AS median FROM events GROUP BY 1), a AS (SELECT event_type, any_value(m.median) AS median, median(abs(value - m.median)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1), th AS (SELECT *, median + 3.5 * 1.4826 * mad AS threshold FROM a)"


def _event_scores(spark, sf):
    return _t(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("score"))


@query(f"WITH {_MAD} SELECT event_type, round(median, 6) AS median, round(mad, 6) AS mad, round(threshold, 6) AS threshold FROM th")
def selfval_mad_threshold(spark, sf):
    return selfval.mad_threshold(_event_scores(spark, sf), ["event_type"]).select("event_type", *[r6(c).alias(c) for c in ("median", "mad", "threshold")])


@query(f"WITH {_MAD}, c AS (SELECT event_type, greatest(any_value(threshold), quantile_cont(value, 0.95)) AS threshold FROM events JOIN th USING (event_type) GROUP BY 1) SELECT event_id, event_type FROM events JOIN c USING (event_type) WHERE value >= threshold")
def selfval_reject_cap(spark, sf):
    s = _event_scores(spark, sf)
    return selfval.rejected(s, selfval.capped_threshold(s, ["event_type"]), ["event_type"]).select("event_id", "event_type")


@query("WITH c AS (SELECT event_type, quantile_cont(value, 0.95) AS threshold FROM events GROUP BY 1) SELECT event_id, event_type FROM events JOIN c USING (event_type) WHERE value >= threshold")
def selfval_reject_pct(spark, sf):
    s = _event_scores(spark, sf)
    cuts = s.groupBy("event_type").agg(F.percentile("score", F.lit(0.95)).alias("threshold"))
    return selfval.rejected(s, cuts, ["event_type"]).select("event_id", "event_type")


@query()
def selfval_three_rounds(spark, sf):
    return selfval.self_validate(tiles_of(spark, sf), 0.1).select("id")


_STATS = f"{_SCORES}, ps AS (SELECT pos, count(score) AS n, avg(score) AS mean, greatest(stddev_pop(score), CASE WHEN count(score) >= 10 THEN 0.01 ELSE 0.1 END) AS std FROM s GROUP BY pos), z AS (SELECT s.*, (score - mean) / std AS z, pos // 4 AS row, pos % 4 AS col FROM s JOIN ps USING (pos))"


def cells_of(spark, sf):
    s = scores_of(spark, sf)
    return metrics.position_z(s, metrics.position_stats(s)).withColumn("row", F.expr("pos div 4").cast("int")).withColumn("col", (F.col("pos") % 4).cast("int"))


@query(f"WITH {_STATS} SELECT pos, n, round(mean, 6) AS mean, round(std, 6) AS std FROM ps")
def pos_stats(spark, sf):
    return metrics.position_stats(scores_of(spark, sf)).select("pos", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"WITH {_STATS} SELECT vec_id AS id, round(z, 6) AS z FROM z")
def pos_zscore(spark, sf):
    return cells_of(spark, sf).select("id", r6("z").alias("z"))


@query(f"WITH {_SCORES} SELECT image_id, count(score) AS n_tiles, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM s GROUP BY 1")
def image_rollup(spark, sf):
    return metrics.rollup(scores_of(spark, sf)).select("image_id", "n_tiles", r6("max_score").alias("max_score"), r6("mean_score").alias("mean_score"))


@query(f"WITH {_SCORES} SELECT image_id, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, count(*) AS n_tiles FROM s GROUP BY 1 ORDER BY max(score) DESC, image_id LIMIT 10")
def image_most_anomalous(spark, sf):
    out = metrics.rollup(scores_of(spark, sf)).orderBy(F.desc("max_score"), "image_id").limit(10)
    return out.select("image_id", r6("max_score").alias("max_score"), r6("mean_score").alias("mean_score"), "n_tiles")


@query(f"WITH {_SCORES} SELECT image_id, round(avg(score), 6) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pos) AS rn FROM s) WHERE rn <= 3 GROUP BY 1")
def image_top3_mean(spark, sf):
    return metrics.top_mean(scores_of(spark, sf)).select("image_id", r6("top_mean").alias("top_mean"))


_SKEW = "CASE WHEN count(z) > 3 AND var_pop(z) > 0 THEN (avg(z*z*z) - 3*avg(z)*avg(z*z) + 2*avg(z)*avg(z)*avg(z)) / pow(var_pop(z), 1.5) ELSE 0 END"
_KURT = "CASE WHEN count(z) > 3 AND var_pop(z) > 0 THEN (avg(z*z*z*z) - 4*avg(z)*avg(z*z*z) + 6*avg(z)*avg(z)*avg(z*z) - 3*avg(z)*avg(z)*avg(z)*avg(z)) / pow(var_pop(z), 2) - 3 ELSE 0 END"
_HOT = f"{_STATS}, hot AS (SELECT image_id, row, col FROM z WHERE z > 0.5)"
_CLUSTERS = "reach AS (SELECT image_id, row AS r, col AS c, row, col FROM hot UNION SELECT a.image_id, a.r, a.c, b.row, b.col FROM reach a JOIN hot b ON a.image_id = b.image_id AND abs(a.row - b.row) + abs(a.col - b.col) = 1), sizes AS (SELECT image_id, r, c, count(*) AS n FROM reach GROUP BY ALL), cl AS (SELECT image_id, max(n) AS largest, round(sqrt(max(n) * count(*)), 6) AS cluster_score FROM sizes GROUP BY 1)"
_RUNS = "isl AS (SELECT image_id, col, row - row_number() OVER (PARTITION BY image_id, col ORDER BY row) AS island FROM hot), vr AS (SELECT image_id, max(n) AS run FROM (SELECT image_id, col, island, count(*) AS n FROM isl GROUP BY ALL) GROUP BY 1)"


@query(f"WITH RECURSIVE {_HOT}, {_CLUSTERS}, {_RUNS}, m AS (SELECT image_id, round(max(score), 6) AS tile_max_raw, round(avg(score), 6) AS tile_mean_raw, round(quantile_cont(score, 0.95), 6) AS tile_p95_raw, round(max(z), 6) AS tile_max_z, round(avg(z), 6) AS tile_mean_z, round(quantile_cont(z, 0.95), 6) AS tile_p95_z, CAST(count(*) FILTER (WHERE z > 0.5) AS DOUBLE) AS anomaly_count, round({_SKEW}, 5) AS z_skewness, round({_KURT}, 4) AS z_kurtosis FROM z GROUP BY 1) SELECT m.*, coalesce(cluster_score, 0) AS cluster_score, CAST(coalesce(run, 0) AS DOUBLE) AS max_vertical_run FROM m LEFT JOIN cl USING (image_id) LEFT JOIN vr USING (image_id)")
def image_metrics(spark, sf):
    m = metrics.image_metrics(cells_of(spark, sf), 0.5)
    digits = {"z_skewness": 5, "z_kurtosis": 4}
    return m.select("image_id", *[F.round(c, digits.get(c, 6)).alias(c) for c in metrics.METRICS])


@query(f"WITH {_STATS}, h AS (SELECT image_id, col, row - row_number() OVER (PARTITION BY image_id, col ORDER BY row) AS island FROM z WHERE z > 0.5), c AS (SELECT image_id, col, island, count(*) AS n FROM h GROUP BY ALL) SELECT image_id, max(n) AS max_vertical_run FROM c GROUP BY 1")
def image_vertical_run(spark, sf):
    return metrics.vertical_run(cells_of(spark, sf), 0.5)


@query(f"WITH RECURSIVE {_HOT}, {_CLUSTERS} SELECT image_id, largest, cluster_score FROM cl")
def image_cluster_score(spark, sf):
    return metrics.cluster_score(cells_of(spark, sf), 0.5).withColumn("cluster_score", r6("cluster_score"))


# Ensembles -----------------------------------------------------------------------------------

_NAMES = ["max_raw", "mean_raw", "max_z", "mean_z"]
_LONG = f"{_STATS}, w AS (SELECT image_id, max(score) AS max_raw, avg(score) AS mean_raw, max(z) AS max_z, avg(z) AS mean_z FROM z GROUP BY 1), lg AS (UNPIVOT w ON max_raw, mean_raw, max_z, mean_z INTO NAME metric VALUE value), st AS (SELECT metric, avg(value) AS mean, greatest(stddev_pop(value), 1e-6) AS std FROM lg WHERE image_id % 2 = 0 GROUP BY 1), ez AS (SELECT image_id, metric, value, (value - mean) / std AS z, CASE metric WHEN 'max_raw' THEN 1 WHEN 'mean_raw' THEN 2 WHEN 'max_z' THEN 3 ELSE 4 END AS place FROM lg JOIN st USING (metric))"


def long_of(spark, sf):
    wide = cells_of(spark, sf).groupBy("image_id").agg(F.max("score").alias("max_raw"), F.avg("score").alias("mean_raw"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"))
    return ensemble.long(wide, _NAMES)


def z_of(spark, sf):
    values = long_of(spark, sf)
    return ensemble.standardised(values, values.where("image_id % 2 = 0"))


@query(f"WITH {_LONG}, b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY z DESC, place) AS rn FROM ez) SELECT image_id, round(z, 6) AS ens_max, metric AS dominant_metric, z > 1.5 AS anomaly FROM b WHERE rn = 1")
def ens_max_z(spark, sf):
    return ensemble.ens_max_z(z_of(spark, sf), _NAMES, 1.5).withColumn("ens_max", r6("ens_max"))


@query(f"WITH {_LONG}, b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY z DESC, place) AS rn FROM ez) SELECT metric AS dominant_metric, count(*) AS n FROM b WHERE rn = 1 GROUP BY 1")
def ens_dominant(spark, sf):
    return ensemble.ens_max_z(z_of(spark, sf), _NAMES).groupBy("dominant_metric").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LONG}, b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY z DESC, metric) AS rn FROM ez) SELECT image_id, round(avg(z), 6) AS ens FROM b WHERE rn <= 3 GROUP BY 1")
def ens_top3_mean(spark, sf):
    return ensemble.ens_top(z_of(spark, sf)).withColumn("ens", r6("ens"))


@query(f"WITH {_LONG} SELECT image_id, round(avg(z), 6) AS ens FROM ez GROUP BY 1")
def ens_mean(spark, sf):
    return ensemble.ens_top(z_of(spark, sf), None).withColumn("ens", r6("ens"))


@query(f"WITH {_LONG}, q AS (SELECT image_id, CASE WHEN mean > 0 THEN value / mean ELSE value END AS ratio FROM lg JOIN st USING (metric) WHERE metric IN ('max_raw', 'mean_raw')) SELECT image_id, bool_or(ratio > 1.05) AS any_over, round(max(ratio), 6) AS max_ratio FROM q GROUP BY 1")
def ens_or_ratio(spark, sf):
    values = long_of(spark, sf).where("metric in ('max_raw', 'mean_raw')")
    return ensemble.ens_or_ratio(values, values.where("image_id % 2 = 0"), 1.05).withColumn("max_ratio", r6("max_ratio"))


@query(f"WITH {_LONG} SELECT image_id, round(sum(z * CASE metric WHEN 'max_raw' THEN 0.35 WHEN 'mean_raw' THEN 0.25 WHEN 'max_z' THEN 0.25 ELSE 0.15 END), 6) AS ens FROM ez GROUP BY 1")
def ens_weighted(spark, sf):
    return ensemble.ens_weighted(z_of(spark, sf), dict(zip(_NAMES, (0.35, 0.25, 0.25, 0.15), strict=True))).withColumn("ens", r6("ens"))


@query(f"WITH {_LONG}, u AS (SELECT 'raw' AS subset, 'max_raw' AS metric UNION ALL SELECT 'raw', 'mean_raw' UNION ALL SELECT 'peaks', 'max_raw' UNION ALL SELECT 'peaks', 'max_z'), b AS (SELECT subset, image_id, max(z) AS z FROM ez JOIN u USING (metric) GROUP BY ALL), g AS (SELECT unnest([0.5, 1.0, 1.5]) AS threshold) SELECT subset, CAST(threshold AS DOUBLE) AS threshold, count(*) AS n_images, count(*) FILTER (WHERE z > threshold) AS n_over FROM b, g GROUP BY ALL")
def ens_subset_search(spark, sf):
    return ensemble.subsets(z_of(spark, sf), {"raw": ["max_raw", "mean_raw"], "peaks": ["max_raw", "max_z"]}, [0.5, 1.0, 1.5])


# Evaluation ----------------------------------------------------------------------------------

_EV = "ev AS (SELECT event_id, value AS score, event_type = 'error' AS label, CAST(user_id % 10 + 1 AS INTEGER) AS cam FROM events)"
_SW = f"{_EV}, g AS (SELECT CAST(i AS DOUBLE) AS threshold FROM range(1, 61) t(i)), c AS (SELECT threshold, count(*) FILTER (WHERE score > threshold AND label) AS tp, count(*) FILTER (WHERE score > threshold AND NOT label) AS fp, count(*) FILTER (WHERE score <= threshold AND label) AS fn, count(*) FILTER (WHERE score <= threshold AND NOT label) AS tn FROM ev, g GROUP BY 1), sw AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c)"
_SWC = "threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr"


def labelled(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.col("value").alias("score"), (F.col("event_type") == "error").alias("label"), (F.col("user_id") % 10 + 1).cast("int").alias("cam"))


def _swept(spark, sf):
    return evaluate.sweep(labelled(spark, sf), [float(i) for i in range(1, 61)])


def _rounded(df):
    return df.select(*[r6(c).alias(c) if c in ("precision", "recall", "f1", "fpr") else c for c in df.columns])


@query(f"WITH {_SW} SELECT {_SWC} FROM sw")
def eval_threshold_sweep(spark, sf):
    return _rounded(_swept(spark, sf))


@query(f"WITH {_SW} SELECT {_SWC} FROM sw ORDER BY sw.f1 DESC, threshold LIMIT 1")
def eval_best_f1(spark, sf):
    return _rounded(evaluate.best_f1(_swept(spark, sf)))


@query(f"WITH {_SW.replace('CAST(i AS DOUBLE)', 'CAST(5 * i AS DOUBLE)')} SELECT {_SWC} FROM sw WHERE sw.fpr <= 0.05 ORDER BY sw.recall DESC, threshold LIMIT 1")
def eval_max_det_fp5(spark, sf):
    return _rounded(evaluate.best_within_fpr(evaluate.sweep(labelled(spark, sf), [5.0 * i for i in range(1, 61)])))


_AUC = "count(*) FILTER (WHERE label) AS n_pos, count(*) FILTER (WHERE NOT label) AS n_neg, round((sum(r) FILTER (WHERE label) - count(*) FILTER (WHERE label) * (count(*) FILTER (WHERE label) + 1) / 2.0) / (count(*) FILTER (WHERE label) * count(*) FILTER (WHERE NOT label)), 6) AS auroc"


@query(f"WITH {_EV}, k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM ev) SELECT {_AUC} FROM k")
def eval_auroc(spark, sf):
    return evaluate.auroc(labelled(spark, sf)).withColumn("auroc", r6("auroc"))


@query(f"WITH {_EV}, k AS (SELECT *, rank() OVER (PARTITION BY cam ORDER BY score) + (count(*) OVER (PARTITION BY cam, score) - 1) / 2.0 AS r FROM ev) SELECT cam, {_AUC} FROM k GROUP BY cam")
def eval_auroc_by_cam(spark, sf):
    return evaluate.auroc(labelled(spark, sf), ["cam"]).withColumn("auroc", r6("auroc"))


@query(f"WITH {_EV}, d AS (SELECT score, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM ev GROUP BY 1), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS total FROM d), m AS (SELECT score AS threshold, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / total AS recall FROM c), o AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM m) SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM o ORDER BY o.f1 DESC, threshold DESC LIMIT 1")
def eval_pr_best_f1(spark, sf):
    return _rounded(evaluate.pr_best_f1(labelled(spark, sf)))


@query(f"WITH {_EV}, q AS (SELECT unnest([95.0, 99.0, 99.5])::DOUBLE AS percentile, unnest(quantile_cont(score, [0.95, 0.99, 0.995])) AS threshold FROM ev WHERE NOT label) SELECT percentile, round(threshold, 6) AS threshold, round(100.0 * count(*) FILTER (WHERE score > threshold) / count(*), 6) AS detect_pct FROM ev, q WHERE label GROUP BY percentile, threshold")
def eval_fp_at_percentile(spark, sf):
    return evaluate.at_percentiles(labelled(spark, sf), [95, 99, 99.5]).select("percentile", r6("threshold").alias("threshold"), r6("detect_pct").alias("detect_pct"))


@query(f"WITH {_EV}, h AS (SELECT min(score) AS low, max(score) AS high FROM ev) SELECT label, CAST(least(floor((score - low) / (high - low) * 80), 79) AS INTEGER) AS bin, count(*) AS n FROM ev, h GROUP BY 1, 2")
def eval_histogram(spark, sf):
    rows = labelled(spark, sf)
    span = rows.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    from seamline.functions.stats import bin_of

    return rows.join(F.broadcast(span)).groupBy("label", bin_of(F.col("score"), F.col("low"), F.col("high"), 80).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_EV}, g AS (SELECT unnest([10.0, 20.0, 30.0])::DOUBLE AS threshold) SELECT cam, threshold, round(100.0 * count(*) FILTER (WHERE score > threshold) / count(*), 6) AS fp_pct FROM ev, g WHERE NOT label GROUP BY 1, 2")
def eval_holdout_fp(spark, sf):
    table = evaluate.sweep(labelled(spark, sf).where("not label"), [10, 20, 30], ["cam"])
    return table.select("cam", "threshold", r6(F.col("fpr") * 100).alias("fp_pct"))


_FACTS = "fa AS (SELECT l_returnflag AS method, l_linestatus AS defect, CAST(l_linenumber AS INTEGER) AS level, l_quantity > 30 AS detected, l_quantity AS score FROM lineitem)"


def facts(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("defect"), F.col("l_linenumber").cast("int").alias("level"), (F.col("l_quantity") > 30).alias("detected"), F.col("l_quantity").alias("score"))


@query(f"WITH {_FACTS} SELECT coalesce(method, 'all') AS method, coalesce(defect, 'all') AS defect, coalesce(CAST(level AS VARCHAR), 'all') AS level, count(*) AS n, count(*) FILTER (WHERE detected) AS n_detected, round(100.0 * count(*) FILTER (WHERE detected) / count(*), 6) AS rate FROM fa GROUP BY GROUPING SETS ((method), (defect), (level), (method, defect, level), ())")
def eval_rate_cube(spark, sf):
    cube = evaluate.rate_cube(facts(spark, sf), ["method", "defect", "level"])
    return cube.select(*[F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c) for c in ("method", "defect", "level")], "n", "n_detected", r6("rate").alias("rate"))


@query(f"WITH {_FACTS} SELECT CASE WHEN level <= 4 THEN 'spot' ELSE 'line' END AS family, method, round(100.0 * count(*) FILTER (WHERE detected) / count(*), 6) AS rate FROM fa GROUP BY 1, 2")
def eval_family_rate(spark, sf):
    family = F.when(F.col("level") <= 4, "spot").otherwise("line")
    return facts(spark, sf).groupBy(family.alias("family"), "method").agg(r6(percent(F.count_if("detected"), F.count(F.lit(1)))).alias("rate"))


@query(f"WITH {_FACTS}, b AS (SELECT defect, method, 100.0 * count(*) FILTER (WHERE detected) / count(*) AS rate, avg(score) AS mean FROM fa GROUP BY 1, 2) SELECT defect, method, round(rate, 6) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY defect ORDER BY rate DESC, mean DESC, method) AS rn FROM b) WHERE rn = 1")
def eval_best_method(spark, sf):
    from pyspark.sql.window import Window

    b = facts(spark, sf).groupBy("defect", "method").agg(percent(F.count_if("detected"), F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean"))
    best = Window.partitionBy("defect").orderBy(F.desc("rate"), F.desc("mean"), "method")
    return b.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("defect", "method", r6("rate").alias("rate"))


@query(f"WITH {_SCORES}, y AS (SELECT q.vec_id, min(list_distance(q.v, b.v)) AS same FROM t q JOIN t b ON q.vec_id % 5 <> 0 AND b.vec_id % 5 <> 0 AND q.vec_id <> b.vec_id GROUP BY 1) SELECT round(abs(avg(same) - avg(score)) / greatest(avg(score), 1e-6) * 100, 6) AS gap_pct FROM s JOIN y USING (vec_id)")
def eval_overfit_gap(spark, sf):
    q = tiles_of(spark, sf).where("id % 5 <> 0")
    same = knn.scores(q, q, 1, leave_own=True).withColumnRenamed("score", "same")
    return evaluate.overfit_gap(scores_of(spark, sf).select("id", F.col("score").alias("fair")).join(same, "id")).withColumn("gap_pct", r6("gap_pct"))


@query("SELECT user_id AS folder, round(100.0 * count(*) FILTER (WHERE value > 20) / count(*), 6) AS rate, round(median(value), 6) AS median FROM events GROUP BY 1 ORDER BY 100.0 * count(*) FILTER (WHERE value > 20) / count(*) DESC, folder LIMIT 20")
def eval_folder_rate(spark, sf):
    out = _t(spark, sf, "events").groupBy(F.col("user_id").alias("folder")).agg(percent(F.count_if(F.col("value") > 20), F.count(F.lit(1))).alias("rate"), r6(F.median("value")).alias("median"))
    return out.orderBy(F.desc("rate"), "folder").limit(20).withColumn("rate", r6("rate"))


# Sets, nested values, histograms, pixels ------------------------------------------------------


@query("SELECT user_id FROM events WHERE value > 40 UNION SELECT user_id FROM events WHERE event_type = 'error'")
def set_union_rejects(spark, sf):
    e = _t(spark, sf, "events")
    return e.where("value > 40").select("user_id").union(e.where("event_type = 'error'").select("user_id")).distinct()


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 250)")
def set_difference_unused(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("user_id").distinct().join(e.where("value > 250").select("user_id"), "user_id", "left_anti")


@query("SELECT user_id FROM events WHERE value > 40 INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def set_intersect(spark, sf):
    e = _t(spark, sf, "events")
    return e.where("value > 40").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, coalesce(CAST(props->>'$.missing' AS INTEGER), -1) AS missing FROM events")
def json_props_get(spark, sf):
    get = lambda f: F.get_json_object("props", f"$.{f}").cast("int")
    return _t(spark, sf, "events").select("event_id", get("k").alias("k"), F.coalesce(get("missing"), F.lit(-1)).alias("missing"))


_HIST = "h AS (SELECT cam, least(CAST(floor(score / 10) AS INTEGER), 9) AS bin, count(*) AS n FROM ev GROUP BY 1, 2), x AS (SELECT c.cam, b.bin, coalesce(h.n, 0)::DOUBLE / sum(coalesce(h.n, 0)) OVER (PARTITION BY c.cam) AS share FROM (SELECT DISTINCT cam FROM ev) c CROSS JOIN (SELECT CAST(i AS INTEGER) AS bin FROM range(10) t(i)) b LEFT JOIN h ON h.cam = c.cam AND h.bin = b.bin)"


@query(f"WITH {_EV}, {_HIST}, r AS (SELECT bin, share FROM x WHERE cam = 1) SELECT x.cam, round(sum((x.share - r.share) * (x.share - r.share) / (r.share + 1e-10)), 6) AS chi2 FROM x JOIN r USING (bin) WHERE r.share > 0 GROUP BY 1")
def hist_chi_square(spark, sf):
    """Distance of each camera's histogram of ten bins from camera 1's, over bins that camera 1 has."""
    bins = labelled(spark, sf).groupBy("cam").agg(*[F.count_if(F.least(F.floor(F.col("score") / 10), F.lit(9)) == i).alias(f"b{i}") for i in range(10)], F.count(F.lit(1)).alias("n"))
    h = bins.select("cam", F.array(*[F.col(f"b{i}") / F.col("n") for i in range(10)]).alias("h"))
    ref = h.where("cam = 1").select(F.col("h").alias("r"))
    both = h.join(F.broadcast(ref)).withColumn("pair", F.filter(F.arrays_zip("h", "r"), lambda p: p["r"] > 0))
    return both.select("cam", r6(vectors.chi_square(F.col("pair.h"), F.col("pair.r"))).alias("chi2"))


@query()
def pca_recon_error(spark, sf):
    """Error of rebuilding each vector from 8 principal components of the bank."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    t = tiles_of(spark, sf)
    mean = [r[0] for r in t.where("id % 5 = 0").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").select("m").collect()]
    centred = t.withColumn("c", F.zip_with("v", F.array(*[F.lit(m) for m in mean]), lambda x, m: x - m)).withColumn("features", array_to_vector("c"))
    model = PCA(k=8, inputCol="features", outputCol="p").fit(centred.where("id % 5 = 0"))
    p = model.transform(centred).withColumn("p", vector_to_array("p"))
    # Components are orthonormal: what is lost is the length not kept.
    lost = F.greatest(vectors.dot(F.col("c"), F.col("c")) - vectors.dot(F.col("p"), F.col("p")), F.lit(0.0))
    return p.select("id", r6(F.sqrt(lost)).alias("error"))


def _images(spark, sf):
    pixels = F.transform(F.col("embedding"), lambda x: F.least(F.greatest(x.cast("double") * 200 + 128, F.lit(0.0)), F.lit(255.0)))
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), pixels.alias("pixels"))


@query()
def raster_measures(spark, sf):
    return raster.measure(_images(spark, sf))


@query("SELECT event_id FROM events WHERE value > 40 UNION ALL SELECT event_id FROM events WHERE event_type = 'error'")
def set_concat(spark, sf):
    e = _t(spark, sf, "events")
    return e.where("value > 40").select("event_id").unionByName(e.where("event_type = 'error'").select("event_id"))


@query("SELECT event_id, value, event_type FROM events")
def json_result_roundtrip(spark, sf):
    lines = _t(spark, sf, "events").select(F.to_json(F.struct("event_id", "value", "event_type")).alias("line"))
    return lines.select(F.from_json("line", "event_id long, value double, event_type string").alias("r")).select("r.*")


@query("SELECT event_id, event_type AS kind, CAST(user_id AS INTEGER) AS cam FROM events")
def log_parse(spark, sf):
    line = F.concat(F.lit("\x1b[32mINFO\x1b[0m kind="), F.col("event_type"), F.lit(", \x1b[1mcam="), F.col("user_id"), F.lit("\x1b[0m"))
    fields = names.log_fields(line)
    return _t(spark, sf, "events").select("event_id", fields["kind"].alias("kind"), fields["cam"].cast("int").alias("cam"))


@query(f"WITH {_EV} SELECT cam, count(*) FILTER (WHERE label AND score <= 20) AS missed, count(*) FILTER (WHERE NOT label AND score > 20) AS false_alarms FROM ev GROUP BY 1")
def eval_overlap(spark, sf):
    table = evaluate.sweep(labelled(spark, sf), [20.0], ["cam"])
    return table.select("cam", F.col("fn").alias("missed"), F.col("fp").alias("false_alarms"))


@query(f"WITH {_FACTS}, st AS (SELECT method, avg(score) AS mean, greatest(stddev_pop(score), 1e-6) AS std FROM fa WHERE level = 1 GROUP BY 1) SELECT fa.method, level, count(*) AS n, count(*) FILTER (WHERE (score - mean) / std > 1.001) AS n_detected FROM fa JOIN st USING (method) GROUP BY 1, 2")
def ens_adaptive(spark, sf):
    f = facts(spark, sf).drop("detected")
    return ensemble.adaptive(f, f.where("level = 1"), 1.001).groupBy("method", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("n_detected"))


@query(f"WITH {_EV}, m AS (SELECT cam, CAST(event_id % 7 + event_id % 4 AS INTEGER) AS strip, avg(score) AS mean FROM ev GROUP BY 1, 2) SELECT a.cam AS cam_id, a.strip, round(abs(a.mean - b.mean), 6) AS gap FROM m a JOIN m b ON a.cam <= 5 AND b.cam = 11 - a.cam AND b.strip = 9 - a.strip")
def camera_pair_gaps(spark, sf):
    strip = (F.col("event_id") % 7 + F.col("event_id") % 4).cast("int")
    means = labelled(spark, sf).groupBy(F.col("cam").alias("cam_id"), strip.alias("strip")).agg(F.avg("score").alias("mean"))
    return catalog.paired_strips(means).withColumn("gap", r6("gap"))


@query(f"WITH {_SEQ}, t AS (SELECT user_id % 10 + 1 AS cam, event_id, CAST(CASE WHEN user_id % 10 = user_id % 7 THEN 1 WHEN rn <= 10 OR rn > n - 10 THEN 2 WHEN (rn - 11) % 3 <> 0 THEN 3 END AS INTEGER) AS tier FROM e) SELECT cam, event_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY tier, md5(CAST(event_id AS VARCHAR)), event_id) AS rk FROM t WHERE tier IS NOT NULL) WHERE rk <= 5")
def split_three_tier(spark, sf):
    rows = catalog.numbered(_t(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).withColumn("cam", F.col("user_id") % 10 + 1)
    tier = F.when(F.col("user_id") % 10 == F.col("user_id") % 7, 1).when((F.col("rn") <= 10) | (F.col("rn") > F.col("n") - 10), 2).when(F.pmod(F.col("rn") - 11, F.lit(3)) != 0, 3)
    return catalog.three_tier(rows, ["cam"], tier, "event_id", 5).select("cam", "event_id", "tier")


@query(f"WITH {_TILES} SELECT vec_id AS id, round(v[1] + v[2], 6) AS p1, round(v[3] - 2 * v[4], 6) AS p2 FROM t")
def vec_project(spark, sf):
    columns = [[1.0, 1.0] + [0.0] * 62, [0.0, 0.0, 1.0, -2.0] + [0.0] * 60]
    p = vectors.project(F.col("v"), columns)
    return tiles_of(spark, sf).select("id", r6(p[0]).alias("p1"), r6(p[1]).alias("p2"))


ENTRY = "image_most_anomalous"

from seamline.plans import images, more  # noqa: E402, F401  registers the rest
