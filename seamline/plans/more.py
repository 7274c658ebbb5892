"""Further queries: policies, pairs, pixels, defects, searches. Registered with those of queries.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions import defects, matrices, names, stats, vectors
from seamline.operators import catalog, coreset, ensemble, evaluate, grid, metrics, selfval
from seamline.operators.ranks import percentiles
from seamline.plans.queries import _EV, _FACTS, _GRID, _MAD, _PARSE, _SCORES, _SEQ, _STATS, _TILES, _event_scores, _t, cells_of, facts, folders, labelled, query, r6, scores_of, tiles_of

# Catalogue -----------------------------------------------------------------------------------

_SPLIT = ", d AS (SELECT *, contains(name, 'HP') AS is_defect FROM folders WHERE contains(name, 'x1'))"


def _split(spark, sf):
    return catalog.defect_split(folders(spark, sf).select("id", "name", "prod_date", F.col("id").cast("string").alias("key")), "x1", "HP")


@query(f"WITH {_PARSE}{_SPLIT} SELECT prod_date, is_defect, count(*) AS n FROM d GROUP BY 1, 2")
def catalog_defect_split(spark, sf):
    return _split(spark, sf).groupBy("prod_date", "is_defect").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PARSE}{_SPLIT}, s AS (SELECT DISTINCT prod_date FROM d WHERE is_defect), nm AS (SELECT * FROM d WHERE NOT is_defect),
r AS (SELECT nm.*, s.prod_date IS NOT NULL AS spoilt, row_number() OVER (PARTITION BY nm.prod_date ORDER BY md5(CAST(id AS VARCHAR)), CAST(id AS VARCHAR)) AS rn FROM nm LEFT JOIN s USING (prod_date))
SELECT 'keep' AS policy, id FROM r UNION ALL SELECT 'drop', id FROM r WHERE NOT spoilt UNION ALL SELECT 'sparse', id FROM r WHERE NOT spoilt OR (rn - 1) % 5 = 0""")
def catalog_date_policy(spark, sf):
    from functools import reduce

    rows = _split(spark, sf)
    each = [catalog.date_policy(rows, p, key="key").select(F.lit(p).alias("policy"), "id") for p in ("keep", "drop", "sparse")]
    return reduce(lambda a, b: a.union(b), each)


@query("SELECT user_id AS folder, count(*) AS n_files, bool_or(event_type = 'error') AS has_level2 FROM events GROUP BY 1")
def catalog_inventory_flags(spark, sf):
    file = F.when(F.col("event_type") == "error", "level2.txt").otherwise(F.concat("event_id", F.lit(".jpg")))
    rows = _t(spark, sf, "events").select(F.col("user_id").alias("folder"), file.alias("file"))
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.bool_or(F.col("file") == "level2.txt").alias("has_level2"))


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 50")
def images_first_n_overall(spark, sf):
    return _t(spark, sf, "events").select("event_id", "ts").orderBy("ts", "event_id").limit(50)


@query("SELECT p_partkey AS id, CAST(p_size * 10 AS INTEGER) AS width, CAST(50 + p_partkey % 3 * 50 AS INTEGER) AS height FROM part WHERE p_size * 10 BETWEEN 190 AND 210 AND 50 + p_partkey % 3 * 50 = 100")
def images_size_gate(spark, sf):
    """Images of the size that a model takes, within 5 % of the width."""
    rows = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 10).cast("int").alias("width"), (50 + F.col("p_partkey") % 3 * 50).cast("int").alias("height"))
    return rows.where((F.abs(F.col("width") - 200) <= 10) & (F.col("height") == 100))


@query("SELECT cam, event_id, concat('export/', cam, '/', lpad(CAST(rn AS VARCHAR), 3, '0'), '_', event_id) AS copy_to FROM (SELECT CAST(user_id % 10 + 1 AS INTEGER) AS cam, event_id, row_number() OVER (PARTITION BY user_id % 10 + 1 ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn FROM events) WHERE rn <= 5")
def export_manifest(spark, sf):
    rows = _t(spark, sf, "events").select((F.col("user_id") % 10 + 1).cast("int").alias("cam"), "event_id")
    return catalog.manifest(rows, ["cam"], "event_id", 5, "export").select("cam", "event_id", "copy_to")


@query("WITH c AS (SELECT CAST(i AS INTEGER) AS cam_id, CAST(least(i, 11 - i) AS INTEGER) AS group_id, i > 5 AS is_mirror FROM range(1, 11) t(i)) SELECT event_id, cam_id, group_id, is_mirror FROM events JOIN c ON cam_id = user_id % 10 + 1")
def camera_dimension(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", (F.col("user_id") % 10 + 1).cast("int").alias("cam_id"))
    return rows.join(F.broadcast(catalog.camera_dimension(spark)), "cam_id").select("event_id", "cam_id", "group_id", "is_mirror")


@query("WITH s AS (SELECT DISTINCT p_size * 10 * (p_partkey % 7 * 10 + 50) AS priority FROM part) SELECT CAST(priority AS BIGINT) AS priority FROM s ORDER BY priority LIMIT 20")
def plan_reverse_order(spark, sf):
    """The other end of the schedule first."""
    return _t(spark, sf, "part").select((F.col("p_size") * 10 * (F.col("p_partkey") % 7 * 10 + 50)).cast("long").alias("priority")).distinct().orderBy("priority").limit(20)


# Grids and tiles -----------------------------------------------------------------------------


@query(f"SELECT tile_idx, tile_x, CAST(tile_y + 100 AS INTEGER) AS tile_y, abs(tile_x + 64 - 960) <= 192 AND abs(tile_y + 164 - 600) <= 192 AS is_center FROM ({_GRID.format(nx=15, ny=7, s=128)})")
def grid_cropped(spark, sf):
    """Tiles of what is left after cropping 100 pixels at the top and bottom, and whether a tile is near the center."""
    t = grid.tiles(spark, 1920, 1000, 128, 128).withColumn("tile_y", (F.col("tile_y") + 100).cast("int"))
    return t.select("tile_idx", "tile_x", "tile_y", ((F.abs(F.col("tile_x") + 64 - 960) <= 192) & (F.abs(F.col("tile_y") + 64 - 600) <= 192)).alias("is_center"))


@query(f"SELECT tile_idx, CAST(row * 15 + 14 - col AS INTEGER) AS mirror_idx FROM ({_GRID.format(nx=15, ny=9, s=128)}) WHERE row < 2")
def tiles_row_band(spark, sf):
    """The top two rows of tiles, with the tile of the mirrored camera."""
    t = grid.tiles(spark, 1920, 1200, 128, 128).where("row < 2")
    return t.select("tile_idx", (F.col("row") * 15 + grid.mirror_col(F.col("col"), 15)).cast("int").alias("mirror_idx"))


@query("SELECT l_orderkey AS image_id, l_linenumber AS tile_idx, l_quantity AS brightness FROM lineitem WHERE l_quantity >= 30")
def tiles_brightness_filter(spark, sf):
    return _t(spark, sf, "lineitem").where("l_quantity >= 30").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("tile_idx"), F.col("l_quantity").alias("brightness"))


@query(f"WITH {_SCORES} SELECT image_id, round(quantile_cont(score, 0.99), 6) AS p99, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.8), 6) AS p80, round(quantile_cont(score, 0.7), 6) AS p70 FROM s GROUP BY 1")
def image_percentiles(spark, sf):
    """One image's scores are one group."""
    p = F.percentile("score", F.array(*[F.lit(x) for x in (0.99, 0.9, 0.8, 0.7)]))
    return scores_of(spark, sf).groupBy("image_id").agg(p.alias("p")).select("image_id", *[r6(F.col("p")[i]).alias(f"p{n}") for i, n in enumerate((99, 90, 80, 70))])


@query(f"WITH {_STATS}, w AS (SELECT *, score / (1 + abs(row - 0.5) + abs(col - 1.5)) AS weighted FROM z) SELECT image_id, round(avg(weighted), 6) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY weighted DESC, pos) AS rn FROM w) WHERE rn <= 3 GROUP BY 1")
def image_center_weighted(spark, sf):
    weight = 1 + F.abs(F.col("row") - 0.5) + F.abs(F.col("col") - 1.5)
    cells = cells_of(spark, sf).withColumn("score", F.col("score") / weight)
    return metrics.top_mean(cells).select("image_id", r6("top_mean").alias("top_mean"))


@query(f"WITH {_STATS}, pt AS (SELECT image_id, col // 2 AS patch, avg(score) AS mean FROM z GROUP BY 1, 2) SELECT image_id, round(max(mean), 6) AS patch_max FROM pt GROUP BY 1")
def image_subpatch_max(spark, sf):
    patch = cells_of(spark, sf).groupBy("image_id", F.expr("col div 2")).agg(F.avg("score").alias("mean"))
    return patch.groupBy("image_id").agg(r6(F.max("mean")).alias("patch_max"))


# Self-validation, banks ------------------------------------------------------------------------


@query(f"WITH {_MAD}, r AS (SELECT event_id, e.event_type, value, threshold, row_number() OVER (PARTITION BY e.event_type ORDER BY value, event_id) - 1 AS rank, count(*) OVER (PARTITION BY e.event_type) AS n, count(*) FILTER (WHERE value > threshold) OVER (PARTITION BY e.event_type) AS n_over FROM events e JOIN th ON e.event_type = th.event_type) SELECT event_id, event_type FROM r WHERE CASE WHEN n_over > n * 5 // 100 THEN rank < n - n * 5 // 100 ELSE value <= threshold END")
def selfval_keep_lowest(spark, sf):
    s = _event_scores(spark, sf)
    return selfval.keep_lowest(s, selfval.mad_threshold(s, ["event_type"]), ["event_type"], "event_id").select("event_id", "event_type")


@query(f"WITH {_SCORES}, m AS (SELECT median(score) AS median FROM s), a AS (SELECT any_value(m.median) AS median, median(abs(score - m.median)) AS mad FROM s, m) SELECT round(median, 6) AS median, round(mad, 6) AS mad, round(median + 3.5 * 1.4826 * mad, 6) AS threshold FROM a")
def selfval_rescored_threshold(spark, sf):
    t = tiles_of(spark, sf)
    out = selfval.rescored_threshold(t.where("id % 5 <> 0"), t.where("id % 5 = 0"))
    return out.select(*[r6(c).alias(c) for c in ("median", "mad", "threshold")])


@query("SELECT vec_id AS id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR))[1:12], vec_id LIMIT 200")
def bank_capped(spark, sf):
    return coreset.capped(tiles_of(spark, sf).select("id", "v"), 200).select("id")


@query("SELECT label AS model_id, count(*) AS n, round(sum(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS energy FROM embeddings WHERE vec_id % 5 = 0 GROUP BY 1")
def bank_tables(spark, sf):
    """Banks by model, written to tables and read again."""
    from seamline.plans.lineage import cut

    bank = cut(tiles_of(spark, sf).where("id % 5 = 0").select(F.col("label").alias("model_id"), "id", "v"))
    return bank.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(vectors.dot(F.col("v"), F.col("v"))), 5).alias("energy"))


# Evaluation and ensembles ----------------------------------------------------------------------

_TWO = "tw AS (SELECT a.l_linestatus AS defect, a.l_quantity > 30 AS hit_a, b.l_discount > 0.05 AS hit_b, a.l_quantity AS sa, b.l_discount AS sb FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_linestatus = b.l_linestatus)"


@query(f"WITH {_TWO} SELECT defect, count(*) AS n, count(*) FILTER (WHERE hit_a OR hit_b) AS n_any, count(*) FILTER (WHERE hit_a AND hit_b) AS n_both, round(avg(sa * sb), 6) AS mean_product FROM tw GROUP BY 1")
def eval_paired_methods(spark, sf):
    """Two methods on the same tiles: what either or both find."""
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("defect"), "l_quantity", "l_discount")
    method = lambda m, score, hit: rows.select("l_orderkey", "l_linenumber", "defect", F.lit(m).alias("method"), F.col(score).alias("score"), hit.alias("detected"))
    long = method("a", "l_quantity", F.col("l_quantity") > 30).union(method("b", "l_discount", F.col("l_discount") > 0.05))
    pairs = evaluate.paired(long, "a", "b", ["l_orderkey", "l_linenumber", "defect"])
    return pairs.groupBy("defect").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit_a") | F.col("hit_b")).alias("n_any"), F.count_if(F.col("hit_a") & F.col("hit_b")).alias("n_both"), r6(F.avg(F.col("score_a") * F.col("score_b"))).alias("mean_product"))


@query("WITH c AS (SELECT l_suppkey, avg(l_quantity) AS clean FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT CAST(l_linenumber AS INTEGER) AS level, count(*) AS n, count(*) FILTER (WHERE l_quantity / clean > 1.1) AS n_detected, round(avg(l_quantity / clean), 6) AS mean_ratio FROM lineitem JOIN c USING (l_suppkey) WHERE l_linenumber > 1 AND clean > 0 GROUP BY 1")
def eval_ratio_to_own_normal(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tile"), F.col("l_linenumber").cast("int").alias("level"), F.col("l_quantity").alias("score"))
    out = evaluate.against_own_normal(rows.where("level > 1"), rows.where("level = 1"), ["tile"])
    return out.groupBy("level").agg(F.count("ratio").alias("n"), F.count_if(F.col("ratio") > 1.1).alias("n_detected"), r6(F.avg("ratio")).alias("mean_ratio"))


@query(f"WITH {_EV} SELECT cam, round(median(score) FILTER (WHERE label) - median(score) FILTER (WHERE NOT label), 6) AS separation FROM ev GROUP BY 1 HAVING count(*) FILTER (WHERE label) > 0 AND count(*) FILTER (WHERE NOT label) > 0")
def eval_median_separation(spark, sf):
    return evaluate.median_separation(labelled(spark, sf), ["cam"]).withColumn("separation", r6("separation"))


@query("WITH f AS (SELECT CAST(l_suppkey % 10 + 1 AS INTEGER) AS cam, CAST(l_linenumber AS INTEGER) AS level, l_extendedprice AS score, l_quantity > 30 AS label FROM lineitem), k AS (SELECT *, rank() OVER (PARTITION BY cam, level ORDER BY score) + (count(*) OVER (PARTITION BY cam, level, score) - 1) / 2.0 AS r FROM f) SELECT cam, level, count(*) FILTER (WHERE label) AS n_pos, count(*) FILTER (WHERE NOT label) AS n_neg, round(coalesce((sum(r) FILTER (WHERE label) - count(*) FILTER (WHERE label) * (count(*) FILTER (WHERE label) + 1) / 2.0) / nullif(count(*) FILTER (WHERE label) * count(*) FILTER (WHERE NOT label), 0), 0), 6) AS auroc FROM k GROUP BY 1, 2")
def eval_auroc_by_cam_level(spark, sf):
    rows = _t(spark, sf, "lineitem").select((F.col("l_suppkey") % 10 + 1).cast("int").alias("cam"), F.col("l_linenumber").cast("int").alias("level"), F.col("l_extendedprice").alias("score"), (F.col("l_quantity") > 30).alias("label"))
    return evaluate.auroc(rows, ["cam", "level"]).withColumn("auroc", r6("auroc"))


_METRICS = ["max_raw", "mean_raw", "max_z", "mean_z", "anomalies"]
_SUBSETS = {"all": _METRICS, "raw": ["max_raw", "mean_raw"], "z": ["max_z", "mean_z"], "max": ["max_raw", "max_z"], "mean": ["mean_raw", "mean_z"], "count": ["anomalies"], "peaks": ["max_raw", "max_z", "anomalies"], "no_count": _METRICS[:4]}
_CONFIGS = {"full": "true", "even": "pos % 2 = 0", "odd": "pos % 2 = 1", "head": "pos < 6"}
_SEARCH = f"""WITH {_STATS}, cf AS ({' UNION ALL '.join(f"SELECT *, '{n}' AS config FROM z WHERE {w}" for n, w in _CONFIGS.items())}), th AS (SELECT unnest([0.5, 1.0, 1.5])::DOUBLE AS tile_th),
w AS (SELECT config, tile_th, image_id, max(score) AS max_raw, avg(score) AS mean_raw, max(z) AS max_z, avg(z) AS mean_z, CAST(count(*) FILTER (WHERE z > tile_th) AS DOUBLE) AS anomalies FROM cf, th GROUP BY 1, 2, 3),
lg AS (UNPIVOT w ON {', '.join(_METRICS)} INTO NAME metric VALUE value), st AS (SELECT config, tile_th, metric, avg(value) AS mean, greatest(stddev_pop(value), 1e-6) AS std FROM lg WHERE image_id % 2 = 0 GROUP BY 1, 2, 3),
zz AS (SELECT lg.config, lg.tile_th, image_id, lg.metric, (value - mean) / std AS ez FROM lg JOIN st ON lg.config = st.config AND lg.tile_th = st.tile_th AND lg.metric = st.metric),
mb AS ({' UNION ALL '.join(f"SELECT '{s}' AS subset, '{m}' AS metric" for s, ms in _SUBSETS.items() for m in ms)}),
l AS (SELECT config, tile_th, subset, image_id, list(ez ORDER BY ez DESC) AS zs FROM zz JOIN mb USING (metric) GROUP BY 1, 2, 3, 4),
o AS (SELECT config, tile_th, subset, 'max' AS agg, image_id, zs[1] AS score FROM l UNION ALL SELECT config, tile_th, subset, 'mean', image_id, list_avg(zs) FROM l UNION ALL SELECT config, tile_th, subset, 'top', image_id, list_avg(zs[1:2]) FROM l)
SELECT config, tile_th, subset, agg, count(*) AS n_images, round(avg(score), 5) AS mean_score, count(*) FILTER (WHERE image_id % 2 = 1 AND score > 1.001) AS n_found, count(*) FILTER (WHERE image_id % 2 = 0 AND score > 1.001) AS n_false FROM o GROUP BY 1, 2, 3, 4"""


@query(_SEARCH)
def ens_search(spark, sf):
    """4 configurations by 3 tile thresholds by 8 subsets of metrics by 3 aggregates: 288 rows."""
    cells = cells_of(spark, sf).select("image_id", "pos", "score", "z", F.explode(F.filter(F.array(*[F.when(F.expr(w), F.lit(n)) for n, w in _CONFIGS.items()]), lambda x: x.isNotNull())).alias("config"))
    each = cells.select("*", F.explode(F.array(*[F.lit(t) for t in (0.5, 1.0, 1.5)])).alias("tile_th"))
    keys = ["config", "tile_th"]
    wide = each.groupBy(*keys, "image_id").agg(F.max("score").alias("max_raw"), F.avg("score").alias("mean_raw"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"), F.count_if(F.col("z") > F.col("tile_th")).cast("double").alias("anomalies"))
    long = wide.unpivot([*keys, "image_id"], _METRICS, "metric", "value")
    normal = long.where("image_id % 2 = 0").groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(1e-6)).alias("std"))
    z = long.join(F.broadcast(normal), [*keys, "metric"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))
    out = ensemble.search(z, keys, _SUBSETS).groupBy(*keys, "subset", "agg")
    over = lambda odd: F.count_if((F.col("image_id") % 2 == odd) & (F.col("score") > 1.001))
    return out.agg(F.count(F.lit(1)).alias("n_images"), F.round(F.avg("score"), 5).alias("mean_score"), over(1).alias("n_found"), over(0).alias("n_false"))


#: Scoring methods by name, each from a column of scores to an aggregate: add one here to have it in method_scores.
METHODS = {"max": lambda s: F.max(s), "mean": lambda s: F.avg(s), "spread": lambda s: F.max(s) - F.min(s), "root_mean_square": lambda s: F.sqrt(F.avg(s * s))}


@query(f"WITH {_SCORES}, w AS (SELECT image_id, max(score) AS max, avg(score) AS mean, max(score) - min(score) AS spread, sqrt(avg(score * score)) AS root_mean_square FROM s GROUP BY 1), l AS (UNPIVOT w ON max, mean, spread, root_mean_square INTO NAME method VALUE score) SELECT image_id, method, round(score, 6) AS score FROM l")
def method_scores(spark, sf):
    wide = scores_of(spark, sf).groupBy("image_id").agg(*[f(F.col("score")).alias(n) for n, f in METHODS.items()])
    return wide.unpivot("image_id", list(METHODS), "method", "score").withColumn("score", r6("score"))


# Sets and scalars ------------------------------------------------------------------------------


@query("WITH f AS (SELECT user_id, event_type, min(ts) AS ts, min(event_id) AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY ts, id) AS kinds FROM f GROUP BY 1")
def set_ordered_unique(spark, sf):
    """Kinds of a user's events in the order in which they first came."""
    first = _t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("at", "event_type"))).alias("k")).select("user_id", F.array_join(F.col("k.event_type"), ",").alias("kinds"))


@query("WITH d AS (SELECT user_id % 10 AS cam, list_sort(list_distinct(list(CAST(ts AS DATE)) FILTER (WHERE event_type = 'error'))) AS a, list_sort(list_distinct(list(CAST(ts AS DATE)) FILTER (WHERE value > 60))) AS b FROM events GROUP BY 1) SELECT cam, CAST(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS INTEGER) AS n_dates FROM d")
def set_union_dates(spark, sf):
    dates = lambda c: F.collect_set(F.when(c, F.to_date("ts")))
    each = _t(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("cam")).agg(dates(F.col("event_type") == "error").alias("a"), dates(F.col("value") > 60).alias("b"))
    return each.select("cam", F.size(F.array_union("a", "b")).alias("n_dates"))


@query("SELECT o_orderkey AS id, concat(greatest(a, b), 'x', least(a, b)) AS size, concat('lot', o_custkey) AS lot, concat('rest_', o_orderkey) AS rest, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS padded FROM (SELECT *, (o_custkey % 20) * 10 + 100 AS a, (o_orderkey % 7) * 50 + 50 AS b FROM orders)")
def names_normalised(spark, sf):
    """Sizes with the wider side first whatever the case of x, names split at their first underscore, padded keys."""
    a, b = F.col("o_custkey") % 20 * 10 + 100, F.col("o_orderkey") % 7 * 50 + 50
    raw = F.concat(a, F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise("x"), b)
    rows = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"), F.concat(F.lit("lot"), "o_custkey", F.lit("_rest_"), "o_orderkey").alias("name"))
    head = names.at_first_underscore(F.col("name"))
    return rows.select("id", names.wide_first(F.col("raw")).alias("size"), head[0].alias("lot"), head[1].alias("rest"), F.lpad(F.col("id").cast("string"), 8, "0").alias("padded"))


@query(f"WITH {_STATS} SELECT vec_id AS id, round(1 + 0.1 * z, 6) AS ratio FROM z")
def z_to_ratio(spark, sf):
    return cells_of(spark, sf).select("id", r6(stats.ratio_of_z(F.col("z"))).alias("ratio"))


@query(f"WITH {_TILES}, x AS (SELECT CAST(i AS INTEGER) AS col, v[i + 1] AS x FROM t, range(64) r(i)), n AS (SELECT col, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1) SELECT col, round(norm, 6) AS norm, round(max(abs(x)) / any_value(norm), 6) AS largest FROM x JOIN n USING (col) GROUP BY col, norm")
def vec_column_norms(spark, sf):
    """Columns of the matrix of all vectors brought to length 1: norms and their largest entries."""
    x = tiles_of(spark, sf).select(F.posexplode("v").alias("col", "x"))
    return x.groupBy("col").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.max(F.abs("x")).alias("m")).select("col", r6("norm").alias("norm"), r6(F.col("m") / F.col("norm")).alias("largest"))


@query(f"WITH {_TILES} SELECT vec_id AS id, round(list_sum(v[1:64:8]), 6) AS strided, round(list_sum(list_filter(v, lambda x: x > 0)), 6) AS positive, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS argmax, round(list_sort(v)[32], 6) AS middle FROM t")
def vec_slices(spark, sf):
    """Strides, masks, positions and order within arrays."""
    v = F.col("v")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    strided = F.filter(v, lambda x, i: i % 8 == 0)
    return tiles_of(spark, sf).select("id", r6(total(strided)).alias("strided"), r6(total(F.filter(v, lambda x: x > 0))).alias("positive"), (F.array_position(v, F.array_max(v)) - 1).cast("int").alias("argmax"), r6(F.sort_array(v)[31]).alias("middle"))


@query(f"WITH {_SEQ}, g AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e) SELECT user_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(floor((epoch_us(ts) - epoch_us(before)) / 1000000) AS BIGINT) AS seconds FROM g")
def event_intervals(spark, sf):
    """Time since the user's event before, and the time stamp in ISO form."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = _t(spark, sf, "events").withColumn("gap", F.col("ts") - before)
    part = lambda unit, n: F.extract(F.lit(unit), "gap").cast("long") * n
    seconds = part("DAY", 86400) + part("HOUR", 3600) + part("MINUTE", 60) + F.floor(F.extract(F.lit("SECOND"), "gap"))
    return rows.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), seconds.cast("long").alias("seconds"))


# Pixels ----------------------------------------------------------------------------------------

_PX = "px AS (SELECT vec_id AS id, label, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, least(greatest(CAST(embedding[i + 1] AS DOUBLE) * 200 + 128, 0), 255) AS v FROM embeddings, range(64) r(i))"


def _matrix(name: str, m: np.ndarray) -> str:
    """A constant matrix as a table of its entries: o (row), i (column), w."""
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({o}, {i}, {float(m[o, i])!r}::DOUBLE)' for o, i in np.argwhere(m).tolist())}) t(o, i, w))"


def pixels_of(spark, sf):
    pixels = F.transform("embedding", lambda x: F.least(F.greatest(x.cast("double") * 200 + 128, F.lit(0.0)), F.lit(255.0)))
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", pixels.alias("pixels")).withColumn("m", matrices.rows_of(F.col("pixels"), 8))


_HALF, _SMOOTH = matrices.bilinear(8, 4), matrices.gaussian(8, 2.0, 4)
_UP = matrices.gaussian(16, 4.0, 8) @ matrices.bilinear(8, 16)


@query(f"WITH {_PX}, {_matrix('a', _HALF)} SELECT id, CAST(ay.o * 4 + ax.o AS INTEGER) AS pos, round(sum(ay.w * ax.w * v), 5) AS value FROM px JOIN a ay ON ay.i = y JOIN a ax ON ax.i = x GROUP BY 1, 2")
def pixel_resize(spark, sf):
    """Images of 8 by 8 brought to 4 by 4 by linear interpolation."""
    small = matrices.flat(matrices.separable(F.col("m"), _HALF, _HALF))
    return pixels_of(spark, sf).select("id", F.posexplode(small).alias("pos", "value")).select("id", "pos", F.round("value", 5).alias("value"))


@query(f"WITH {_PX}, {_matrix('a', _UP)}, u AS (SELECT id, ay.o AS y, ax.o AS x, sum(ay.w * ax.w * v) AS v FROM px JOIN a ay ON ay.i = y JOIN a ax ON ax.i = x GROUP BY 1, 2, 3) SELECT id, round(max(v), 5) AS peak FROM u GROUP BY 1")
def pixel_upsample_smooth_max(spark, sf):
    """Score grids brought to 16 by 16, smoothed (sigma 4), and their peaks."""
    return pixels_of(spark, sf).select("id", F.round(F.array_max(matrices.flat(matrices.separable(F.col("m"), _UP, _UP))), 5).alias("peak"))


@query(f"WITH {_PX}, {_matrix('a', _SMOOTH)}, u AS (SELECT id, ay.o AS y, ax.o AS x, sum(ay.w * ax.w * v) AS v FROM px JOIN a ay ON ay.i = y JOIN a ax ON ax.i = x GROUP BY 1, 2, 3) SELECT id, round(avg(v), 5) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS rn FROM u) WHERE rn <= 3 GROUP BY 1")
def grid_smoothed_top3(spark, sf):
    smooth = matrices.flat(matrices.separable(F.col("m"), _SMOOTH, _SMOOTH))
    return pixels_of(spark, sf).select("id", F.round(matrices.top_mean(smooth, 3), 5).alias("top_mean"))


@query(f"WITH {_PX}, {_matrix('a', matrices.dct(8))}, u AS (SELECT id, ay.o AS y, ax.o AS x, sum(ay.w * ax.w * v) AS v FROM px JOIN a ay ON ay.i = y JOIN a ax ON ax.i = x GROUP BY 1, 2, 3) SELECT id, round(avg(abs(v)) FILTER (WHERE y >= 4 AND x >= 4), 5) AS high, round(sum(v * v) FILTER (WHERE NOT (y < 2 AND x < 2)) / sum(v * v), 6) AS not_low FROM u GROUP BY 1")
def pixel_dct(spark, sf):
    """Cosine transform: mean size of the high quadrant, and the share of energy that isn't low."""
    c = matrices.flat(matrices.separable(F.col("m"), matrices.dct(8), matrices.dct(8)))
    energy = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)
    high = F.filter(c, lambda x, i: (i >= 32) & (i % 8 >= 4))
    low = F.filter(c, lambda x, i: (i < 16) & (i % 8 < 2))
    return pixels_of(spark, sf).withColumn("c", c).select("id", F.round(F.aggregate(high, F.lit(0.0), lambda acc, x: acc + F.abs(x)) / 16, 5).alias("high"), r6(1 - energy(low) / energy(F.col("c"))).alias("not_low"))


@query(f"WITH {_PX}, f AS (SELECT id, p.k AS ky, q.k AS kx, sum(v * cos(2 * pi() * (p.k * y + q.k * x) / 8)) AS re, sum(v * sin(2 * pi() * (p.k * y + q.k * x) / 8)) AS im FROM px, range(8) p(k), range(8) q(k) GROUP BY 1, 2, 3), s AS (SELECT id, ln(1 + sqrt(re * re + im * im)) AS s FROM f) SELECT id, round(avg(s), 4) AS mean_log, round(avg(s) FILTER (WHERE rn <= 10), 4) AS top_log FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS rn FROM s) GROUP BY 1")
def pixel_log_spectrum(spark, sf):
    """Logarithm of the Fourier spectrum: its mean, and that of its ten greatest values."""
    s = F.transform(matrices.flat(matrices.spectrum(F.col("m"), 8)), lambda x: F.log1p(x))
    return pixels_of(spark, sf).withColumn("s", s).select("id", F.round(matrices.top_mean(F.col("s"), 64), 4).alias("mean_log"), F.round(matrices.top_mean(F.col("s"), 10), 4).alias("top_log"))


@query(f"WITH {_PX} SELECT label, CAST(y * 8 + x AS INTEGER) AS pos, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std FROM px GROUP BY 1, 2")
def pixel_stack(spark, sf):
    """The mean image of each label and its deviation."""
    return _stack(spark, sf).select("label", "pos", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


def _stack(spark, sf):
    return pixels_of(spark, sf).select("label", F.posexplode("pixels").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


@query(f"WITH {_PX}, st AS (SELECT label, y, x, avg(v) AS mean, greatest(stddev_pop(v), 1.0) AS std FROM px GROUP BY 1, 2, 3), z AS (SELECT id, abs(v - mean) / std AS z FROM px JOIN st ON px.label = st.label AND px.y = st.y AND px.x = st.x) SELECT id, round(max(z), 5) AS z_max, round(avg(z), 5) AS z_mean, round(count(*) FILTER (WHERE z > 2.00001) / 64.0, 6) AS share_over FROM z GROUP BY 1")
def pixel_zmap(spark, sf):
    """Each image against the stack of its label: greatest and mean deviation, and the share of pixels over 2."""
    stack = _stack(spark, sf).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "mean", F.greatest("std", F.lit(1.0)).alias("std")))).alias("stack"))
    z = F.zip_with("pixels", "stack", lambda p, s: F.abs(p - s["mean"]) / s["std"])
    return pixels_of(spark, sf).join(F.broadcast(stack), "label").withColumn("z", z).select("id", F.round(F.array_max("z"), 5).alias("z_max"), F.round(matrices.top_mean(F.col("z"), 64), 5).alias("z_mean"), r6(F.size(F.filter("z", lambda x: x > 2.00001)) / 64).alias("share_over"))


@query(f"WITH {_PX} SELECT id, CAST(x // 2 AS INTEGER) AS strip, round(avg(v), 5) AS mean FROM px GROUP BY 1, 2")
def pixel_strip_means(spark, sf):
    rows = pixels_of(spark, sf).select("id", F.posexplode("pixels").alias("pos", "v"))
    return rows.groupBy("id", F.expr("pos % 8 div 2").cast("int").alias("strip")).agg(F.round(F.avg("v"), 5).alias("mean"))


@query(f"WITH {_PX} SELECT id, CAST((y - 2) * 8 + 7 - x AS INTEGER) AS pos, round(v, 5) AS value FROM px WHERE y BETWEEN 2 AND 5")
def pixel_crop_mirror(spark, sf):
    """The middle four rows, mirrored."""
    keep, mirror = np.eye(8)[2:6], np.eye(8)[::-1]
    return pixels_of(spark, sf).select("id", F.posexplode(matrices.flat(matrices.separable(F.col("m"), keep, mirror))).alias("pos", "value")).select("id", "pos", F.round("value", 5).alias("value"))


@query(f"WITH {_PX} SELECT id, CAST(c AS INTEGER) AS channel, round(avg((v / 255 - [0.485, 0.456, 0.406][c + 1]) / [0.229, 0.224, 0.225][c + 1]), 6) AS mean FROM px, range(3) r(c) GROUP BY 1, 2")
def pixel_normalised(spark, sf):
    """Grey images as three channels by the usual means and deviations (fixed values)."""
    means, stds = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)

    def channel(mean, std):
        return F.aggregate(F.transform("pixels", lambda p: (p / 255 - mean) / std), F.lit(0.0), lambda acc, x: acc + x) / F.size("pixels")

    channels = F.array(*map(channel, means, stds))
    return pixels_of(spark, sf).select("id", F.posexplode(channels).alias("channel", "mean")).select("id", "channel", r6("mean").alias("mean"))


@query(f"WITH {_PX} SELECT id, max(abs(v - least(v + id % 3, 255))) <= 1 AS is_grey FROM px GROUP BY 1")
def pixel_channels_equal(spark, sf):
    """Whether channels differ by 1 at most: a grey image stored in colour."""
    red, blue = F.col("pixels"), F.transform("pixels", lambda p: F.least(p + F.col("id") % 3, F.lit(255.0)))
    return pixels_of(spark, sf).select("id", (F.array_max(F.zip_with(red, blue, lambda a, b: F.abs(a - b))) <= 1).alias("is_grey"))


_LEVELS = [1, 2, 3]
_CHANGES = ", ".join(f"('{k}', {n}, {p // 8}, {p % 8}, {float(d)!r}::DOUBLE)" for k in defects.KINDS for n in _LEVELS for p, d in enumerate(defects.change(k, n, 8, 8).ravel().tolist()))


def _defective(spark, sf):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("level"), defects.injected(F.col("pixels"), k, n, 8, 8).alias("changed")) for k in defects.KINDS for n in _LEVELS])
    return pixels_of(spark, sf).select("id", "pixels", "m", F.explode(kinds).alias("d")).select("id", "pixels", "m", "d.*")


@query(f"WITH {_PX}, ch AS (SELECT * FROM (VALUES {_CHANGES}) t(kind, level, y, x, d)) SELECT id, kind, level, round(avg(abs(least(greatest(v + d, 0), 255) - v)), 5) AS mean_change FROM px JOIN ch ON px.y = ch.y AND px.x = ch.x GROUP BY 1, 2, 3")
def defects_generated(spark, sf):
    """Eleven kinds of synthetic defects at three levels: the mean change of each image."""
    away = F.aggregate(F.zip_with("pixels", "changed", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x) / F.size("pixels")
    return _defective(spark, sf).select("id", "kind", "level", F.round(away, 5).alias("mean_change"))


@query(f"WITH {_PX} SELECT id, CAST(l AS INTEGER) AS level, round(avg(CASE WHEN y = 4 THEN v * [1.0, 0.98, 0.95, 0.9, 0.8, 0.65, 0.5][l + 1] ELSE v END), 5) AS mean FROM px, range(7) r(l) GROUP BY 1, 2")
def defects_line_ratios(spark, sf):
    """A line dimmed to seven brightness ratios."""
    means = F.array(*[F.aggregate(defects.dimmed_line(F.col("pixels"), n, 8, 8), F.lit(0.0), lambda acc, x: acc + x) / 64 for n in range(7)])
    return pixels_of(spark, sf).select("id", F.posexplode(means).alias("level", "mean")).select("id", "level", F.round("mean", 5).alias("mean"))


_WINDOW = matrices.gaussian(8, 1.5, 5)


@query(f"""WITH {_PX}, ch AS (SELECT * FROM (VALUES {_CHANGES}) t(kind, level, y, x, d) WHERE level = 3 AND kind = 'spot'), {_matrix('a', _WINDOW)},
b AS (SELECT id, px.y, px.x, v, least(greatest(v + d, 0), 255) AS u FROM px JOIN ch ON px.y = ch.y AND px.x = ch.x),
g AS (SELECT id, ay.o, ax.o, sum(ay.w * ax.w * v) AS p, sum(ay.w * ax.w * u) AS q, sum(ay.w * ax.w * v * v) AS pp, sum(ay.w * ax.w * u * u) AS qq, sum(ay.w * ax.w * u * v) AS pq FROM b JOIN a ay ON ay.i = b.y JOIN a ax ON ax.i = b.x GROUP BY 1, 2, 3)
SELECT id, round(1 - avg((2 * p * q + 6.5025) * (2 * (pq - p * q) + 58.5225) / ((p * p + q * q + 6.5025) * (pp - p * p + qq - q * q + 58.5225))), 5) AS distance FROM g GROUP BY 1""")
def pixel_ssim_windowed(spark, sf):
    """1 - structural similarity, under a Gaussian window of 11 pixels, of an image with a spot to the image without."""
    changed = matrices.rows_of(defects.injected(F.col("pixels"), "spot", 3, 8, 8), 8)
    return pixels_of(spark, sf).select("id", F.round(1 - matrices.top_mean(matrices.ssim_map(F.col("m"), changed, _WINDOW), 64), 5).alias("distance"))


@query(f"WITH {_EV} SELECT cam, label, round(median(score), 6) AS p50, round(quantile_cont(score, 0.99), 6) AS p99 FROM ev GROUP BY 1, 2")
def eval_percentiles(spark, sf):
    """Percentiles by camera and class, without a group in one task."""
    out = percentiles(labelled(spark, sf), ["cam", "label"], "score", {"p50": 0.5, "p99": 0.99})
    return out.select("cam", "label", r6("p50").alias("p50"), r6("p99").alias("p99"))


@query(f"WITH {_FACTS} SELECT method, level, count(*) AS n FROM fa WHERE detected GROUP BY ALL HAVING count(*) >= 10")
def eval_detected_by_level(spark, sf):
    return facts(spark, sf).where("detected").groupBy("method", "level").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
