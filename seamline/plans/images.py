"""Queries over images: decoded bytes, drawn defects. Registered with those of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import brush, generators, stencils
from seamline.functions.matrices import let
from seamline.operators import coreset, drawing, equalise, grid, knn
from seamline.plans.lineage import own_folder
from seamline.plans.queries import _t, query
from seamline.sources import pixels, store
from seamline.streaming import status

# Images: an embedding is a grey image of 8 by 8 ---------------------------------------------------

#: Side of an image whose pixels are repeated SCALE times each way, and the unit of lengths meant for tiles of 256.
SIDE, SCALE, UNIT = 32, 4, 1 / 8
_GREY = "least(greatest(CAST({v} AS DOUBLE) * 200 + 128, 0), 255)"
_BIG = f"px AS (SELECT vec_id AS id, CAST(vec_id AS VARCHAR) AS k, y, x, {_GREY.format(v='embedding[CAST(y // 4 * 8 + x // 4 + 1 AS BIGINT)]')} AS v FROM embeddings, (SELECT CAST(i // 32 AS INTEGER) AS y, CAST(i % 32 AS INTEGER) AS x FROM range(1024) r(i)))"


def _grey(v):
    return F.least(F.greatest(v.cast("double") * 200 + 128, F.lit(0.0)), F.lit(255.0))


def big_images(spark, sf) -> DataFrame:
    """id, key, pixels: images of 32 by 32, flat."""
    at = lambda i: F.shiftright(i, 7) * 8 + F.shiftright(i.bitwiseAND(SIDE - 1), 2)
    places = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))  # SIDE is 2 ** 5, SCALE 2 ** 2
    flat = let(F.transform("embedding", _grey), lambda grey: F.transform(places, lambda i: F.coalesce(F.get(grey, at(i)), F.lit(0.0))))
    return spread(_t(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("key"), flat.alias("pixels"))


def _changed(a, b):
    """struct<n_changed, mean_change> between two flat images."""
    add = lambda acc, d: F.struct((acc["n"] + (d > 0.01).cast("int")).alias("n"), (acc["sum"] + d).alias("sum"))
    away = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(away, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum")), add, lambda acc: F.struct(acc["n"].alias("n_changed"), F.round(acc["sum"] / F.size(a), 5).alias("mean_change")))


def spread(rows: DataFrame, key: str, many: int = 10_000) -> DataFrame:
    """Rows dealt to a task for each ``many``, and to all cores at least: their work outweighs the exchange."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // many)), key)


def _each(images: DataFrame, kinds: list[tuple]) -> DataFrame:
    """Each image under the shapes of each (kind, level, array of shapes)."""
    names = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("level")) for k, n, _ in kinds])
    found = images.select("id", "pixels", F.array(*[s for _, _, s in kinds]).alias("sets")).mapInArrow(brush.changes(SIDE), "id long, at int, n int, sum double")
    return found.withColumn("of", F.get(names, F.col("at"))).select("id", "of.kind", "of.level", F.col("n").alias("n_changed"), F.round(F.col("sum") / (SIDE * SIDE), 5).alias("mean_change"))


#: The cover of pixel (x, y) by a shape, for DuckDB.
_COVER = """CASE form
 WHEN 1 THEN CAST((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (ey - ay)) ** 2 <= r * r + 1e-9 AS INTEGER)
 WHEN 2 THEN CAST((x - ax) ** 2 + (y - ay) ** 2 <= r * r + 1e-9 AS INTEGER)
 WHEN 3 THEN CAST((((x - ax) * cos(radians(turn)) + (y - ay) * sin(radians(turn))) / r) ** 2 + (((y - ay) * cos(radians(turn)) - (x - ax) * sin(radians(turn))) / r2) ** 2 <= 1 + 1e-9 AS INTEGER)
 WHEN 4 THEN CAST(x >= ax - 1e-9 AND x <= bx + 1e-9 AND y >= ay - 1e-9 AND y <= ey + 1e-9 AS INTEGER)
 WHEN 5 THEN exp(-((x - ax) ** 2 + (y - ay) ** 2) / (2 * r * r))
 WHEN 6 THEN least(greatest((r + r2 - sqrt((x - ax) ** 2 + (y - ay) ** 2)) / (2 * r2), 0), 1)
 WHEN 7 THEN exp(-((x - ax) ** 2 + (y - ay) ** 2) / (2 * r * r)) * (x - ax) / r
 WHEN 8 THEN CASE WHEN y < ay - r OR y >= ay + r THEN 0 ELSE [1, 0.5, 0, 0][CAST((y - ay + r) % 4 AS INTEGER) + 1] END
 WHEN 9 THEN CASE WHEN x >= ax AND x <= bx AND y >= ay AND y <= ey THEN ((x * 7919 + y * 104729 + CAST(r AS BIGINT) * 1299709) * 15485863) % 65537 / 32768.0::DOUBLE - 1 ELSE 0 END
 WHEN 10 THEN CAST(abs((y - r * sin(x * 0.1)) - floor((y - r * sin(x * 0.1)) / r2) * r2 - 0.5) <= 0.5 + 1e-9 AS INTEGER)
 WHEN 11 THEN CAST(x + y <= r + 1e-9 AS INTEGER)
 ELSE CAST(abs(y - ay) <= r + 1e-9 AND abs(x - ax - 5 * sin((y - ay) * 0.5)) <= 0.5 + 1e-9 AS INTEGER) END"""
#: From shapes s (kind, level, id or null for all, and the shape) and pixels px to pixels under them, v and u.
_PAINTED = f"""hit AS (
  SELECT px.id, s.kind, s.level, y, x, v, mode, amount, alpha, {_COVER} AS c FROM (
    SELECT *, CASE WHEN ax = bx AND ay = ey THEN 0 ELSE least(greatest(((x - ax) * (bx - ax) + (y - ay) * (ey - ay)) / ((bx - ax) ** 2 + (ey - ay) ** 2), 0), 1) END AS t
    FROM s JOIN px ON s.id = px.id) s JOIN (SELECT DISTINCT id FROM px) px USING (id)),
u AS (SELECT id, kind, level, y, x, v, least(greatest(CASE WHEN max(mode) = 2 THEN v + max(alpha * c) * (max(amount) - v) ELSE v + sum(amount * c) END, 0), 255) AS u FROM hit GROUP BY id, kind, level, y, x, v)"""
_MEASURED = "SELECT id, kind, level, CAST(count(*) FILTER (WHERE abs(u - v) > 0.01) AS INTEGER) AS n_changed, round(avg(abs(u - v)), 5) AS mean_change FROM u GROUP BY ALL"


def _lot(what: str, n: str | int) -> str:
    return f"(CAST('0x' || substr(md5(k || {what}), 1, 8) AS BIGINT) % {n})"


def _shapes_sql(rows: list[str]) -> str:
    """Shapes for all images: kind, level, form, ax, ay, bx, ey, r, r2, turn, mode, amount, alpha as SQL."""
    return f"SELECT id, f.* FROM (SELECT DISTINCT id FROM px), (VALUES {', '.join(f'({r})' for r in rows)}) f(kind, level, form, ax, ay, bx, ey, r, r2, turn, mode, amount, alpha)"


_SIGN = "(1 - 2 * " + _lot("'/' || kind || '/sign'", 2) + ")"
_POINT = {0: (f"{_lot(chr(39) + '/crack/x' + chr(39), 28)} + 2", f"{_lot(chr(39) + '/crack/y' + chr(39), 3)} + 2")}
_STEPS = ", ".join(f"q{i + 1} AS (SELECT *, greatest(least(x{i} + {_lot(repr(f'/crack/dx{i}'), 4)} - 2, 31), 1) AS x{i + 1}, least(y{i} + {_lot(repr(f'/crack/dy{i}'), 3)} + 2, 31) AS y{i + 1} FROM q{i})" for i in range(5))
_CRACK = " UNION ALL ".join(f"SELECT id, kind, 1 AS form, x{i} AS ax, y{i} AS ay, x{i + 1} AS bx, y{i + 1} AS ey, 0.5 AS r, 0 AS r2, 2 AS mode, tone AS amount FROM q5" for i in range(5))
_PLACED = f"""WITH {_BIG}, ids AS (SELECT DISTINCT id, k FROM px),
t AS (SELECT ids.*, f.*, {_lot("'/' || kind || '/cx'", 22)} + 5 AS cx, {_lot("'/' || kind || '/cy'", 22)} + 5 AS cy, {_SIGN} * change AS by_how FROM ids, (VALUES
  ('spot', 2, 0.625, 0, 30, 0), ('big_spot', 2, 1.25, 0, 30, 0), ('stain', 6, 1.875, 0.875, 25, 0), ('faint_spot', 2, 0.625, 0, 10, 0), ('gradient_stain', 6, 3.75, 3.75, 16, 0),
  ('scratch', 1, 0.5, 0, 30, 1), ('multi_scratch', 1, 0.5, 0, 25, 3), ('thin_scratch', 1, 0.5, 0, 15, 1), ('crack', 0, 0.5, 0, 25, 1)) f(kind, form, r, r2, change, many)),
tone AS (SELECT t.*, least(greatest(floor(v) + by_how, 0), 255) AS tone FROM t JOIN px ON px.id = t.id AND px.y = cy AND px.x = cx),
line AS (SELECT *, {_lot("'/' || kind || '/way' || n", 2)} = 0 AS upright, {_lot("'/' || kind || '/x' || n", 24)} + 4 AS lx, {_lot("'/' || kind || '/y' || n", 24)} + 4 AS ly, {_lot("'/' || kind || '/slant' || n", 2)} - 1 AS slant FROM tone, range(many) m(n) WHERE form = 1),
q0 AS (SELECT *, {_POINT[0][0]} AS x0, {_POINT[0][1]} AS y0 FROM tone WHERE form = 0), {_STEPS},
s AS (SELECT *, 0 AS level, 0 AS turn, 1 AS alpha FROM (
  SELECT id, kind, form, cx AS ax, cy AS ay, 0 AS bx, 0 AS ey, r, r2, 1 AS mode, by_how AS amount FROM tone WHERE form IN (2, 6)
  UNION ALL SELECT id, kind, 1, CASE WHEN upright THEN lx ELSE 1 END, CASE WHEN upright THEN 1 ELSE ly END, CASE WHEN upright THEN lx + slant ELSE 31 END, CASE WHEN upright THEN 31 ELSE ly + slant END, r, 0, 2, tone FROM line
  UNION ALL {_CRACK})),
{_PAINTED} SELECT id, kind, n_changed, mean_change FROM ({_MEASURED})"""


@query(_PLACED)
def defects_placed(spark, sf):
    """Nine kinds of defects, their place, direction and sign drawn for each image by its key."""
    kinds = [(k, 0, generators.placed(k, F.col("key"), F.col("pixels"), SIDE, SIDE, UNIT)) for k in generators.PLACED]
    return _each(big_images(spark, sf), kinds).drop("level")


_ROUND = "floor(32 * {})"
_OBVIOUS = [
    "'scratch', 0, 1, 3, 3, 28, 28, 1, 0, 0, 2, 30, 1", "'thick_scratch', 0, 1, 6, 3, 25, 28, 2, 0, 0, 2, 20, 1", "'bright_line', 0, 1, 4, 16, 27, 16, 1.5, 0, 0, 2, 220, 1", "'spot', 0, 2, 16, 16, 0, 0, 1, 0, 0, 2, 25, 1", "'big_spot', 0, 2, 16, 16, 0, 0, 1.875, 0, 0, 2, 30, 1",
    *(f"'crack', 0, 1, {a}, {16 if i % 2 == 0 else 9}, {b}, {9 if i % 2 == 0 else 16}, 1, 0, 0, 2, 25, 1" for i, (a, b) in enumerate([(3, 8), (8, 13), (13, 18), (18, 23), (23, 28)])),
    "'stain', 0, 3, 16, 16, 0, 0, 2.25, 1.25, 30, 2, 40, 1", *(f"'multi_scratch', 0, 1, {x}, 0, {x}.625, 32, 1, 0, 0, 2, 30, 1" for x in (4, 9, 14)),
]
_FAINT = [row for n in (1, 2, 3) for row in (
    f"'faint_scratch', {n}, 1, 6, 6, 25, 25, {n} / 2, 0, 0, 2, 128 - 15 * {n}, 1", f"'micro_spot', {n}, 2, 16, 16, 0, 0, (3 + {n}) / 8, 0, 0, 2, 128 - 15 * {n}, 1", f"'slight_stain', {n}, 3, 16, 16, 0, 0, (10 + 3 * {n}) / 8, (6 + 2 * {n}) / 8, 45, 2, 128 - 15 * {n}, 0.15 * {n}",
    *(f"'hairline_crack', {n}, 1, {a}, {16 if i % 2 == 0 else 12}, {b}, {12 if i % 2 == 0 else 16}, 0.5, 0, 0, 2, 128 - 15 * {n}, 1" for i, (a, b) in enumerate([(6, 10), (10, 14), (14, 17), (17, 21)])),
    f"'tiny_pit', {n}, 2, 10, 10, 0, 0, (2 + {n}) / 8, 0, 0, 2, 100 - 15 * {n}, 1", f"'surface_wave', {n}, 10, 0, 0, 0, 0, 2 * {n}, 20 - 5 * {n}, 0, 1, -floor(15 * {n} / 2), 1", f"'light_scuff', {n}, 4, 8, 8, 24, 24, 0, 0, 0, 2, 140 - 15 * {n}, 0.075 * {n}",
    f"'dim_spot', {n}, 2, 16, 16, 0, 0, (5 + 2 * {n}) / 8, 0, 0, 2, 120 - 15 * {n}, 0.15 * {n}", f"'thin_line', {n}, 1, 0, 16, 32, 16, 0.5, 0, 0, 2, 128 - 15 * {n}, 1", f"'edge_chip', {n}, 11, 0, 0, 0, 0, 5 * {n} / 8, 0, 0, 2, 100 - 15 * {n}, 1")]


@query(f"WITH {_BIG}, s AS ({_shapes_sql(_OBVIOUS)}), {_PAINTED} SELECT id, kind, n_changed, mean_change FROM ({_MEASURED})")
def defects_tile_kinds(spark, sf):
    """Eight obvious kinds at fixed places of a tile: lines, zigzags, spots, a stain."""
    return _each(big_images(spark, sf), [(k, 0, generators.tile(k, SIDE, SIDE, UNIT)) for k in generators.TILE]).drop("level")


@query(f"WITH {_BIG}, s AS ({_shapes_sql(_FAINT)}), {_PAINTED} {_MEASURED}")
def defects_faint_tile_kinds(spark, sf):
    """Ten subtle kinds at three intensities, blended with the tile."""
    return _each(big_images(spark, sf), [(k, n, generators.subtle_tile(k, n, SIDE, SIDE, UNIT)) for k in generators.SUBTLE_TILE for n in generators.LEVELS])


_CRACK_Y = {0: "16.0"} | {i + 1: " + ".join(["16.0", *(f"({_lot(repr('/micro_crack/') + ' || level || ' + repr(f'/{j}'), 3)} - 1)" for j in range(i + 1))]) for i in range(10)}
_SUBTLE = f"""WITH {_BIG}, ids AS (SELECT DISTINCT id, k FROM px), l AS (SELECT ids.*, CAST(level AS INTEGER) AS level FROM ids, range(1, 4) r(level)),
hair AS (SELECT *, radians({_lot("'/hair_scratch/' || level", 51)} + 20) AS turn_ FROM l),
s AS (
  SELECT id, f.* EXCLUDE (lvl), l.level FROM l JOIN (VALUES {', '.join(f'({r})' for n in (1, 2, 3) for r in (
    f"'faint_spot', {n}, 2, 16, 16, 0, 0, (3 + {n}) / 8, 0, 0, 1, -(3 * {n} + 2), 1", f"'gradient_stain', {n}, 5, 16, 16, 0, 0, 2.5, 0, 0, 1, 5 * {n}, 1", f"'discoloration', {n}, 4, 14.125, 14.125, 17.875, 17.875, 0, 0, 0, 1, 2 * {n} + 2, 1",
    f"'pinhole', {n}, 2, 16, 16, 0, 0, 0.25, 0, 0, 1, -10 * {n}, 1", f"'dent_shadow', {n}, 7, 16, 16, 0, 0, 1.875, 0, 0, 1, 4 * {n}, 1", f"'oxide_edge', {n}, 12, 16, 16, 0, 0, 3.75, 0, 0, 1, -5 * {n}, 1", f"'rolling_mark', {n}, 8, 16, 16, 0, 0, 4, 0, 0, 1, 2 * {n} + 1, 1"))}) f(kind, lvl, form, ax, ay, bx, ey, r, r2, turn, mode, amount, alpha) ON lvl = l.level
  UNION ALL BY NAME SELECT id, level, 'roughness' AS kind, 9 AS form, 13.5 AS ax, 13.5 AS ay, 18.5 AS bx, 18.5 AS ey, {_lot("'/roughness/' || level", 1000)} AS r, 0 AS r2, 0 AS turn, 1 AS mode, 3 * level * sqrt(3) AS amount, 1 AS alpha FROM l
  UNION ALL BY NAME SELECT id, level, 'hair_scratch' AS kind, 1 AS form, 16 - 9.5 * cos(turn_) AS ax, 16 - 9.5 * sin(turn_) AS ay, 16 + 9.5 * cos(turn_) AS bx, 16 + 9.5 * sin(turn_) AS ey, 0.5 AS r, 0 AS r2, 0 AS turn, 1 AS mode, -5 * level AS amount, 1 AS alpha FROM hair
  {' '.join(f"UNION ALL BY NAME SELECT id, level, 'micro_crack' AS kind, 1 AS form, 16 - (30 + 10 * level) / 16 + (30 + 10 * level) / 8 * {i} / 10 AS ax, {_CRACK_Y[i]} AS ay, 16 - (30 + 10 * level) / 16 + (30 + 10 * level) / 8 * {i + 1} / 10 AS bx, {_CRACK_Y[i + 1]} AS ey, 0.5 AS r, 0 AS r2, 0 AS turn, 1 AS mode, -5 * level AS amount, 1 AS alpha FROM l" for i in range(10))}),
{_PAINTED} {_MEASURED}"""


@query(_SUBTLE)
def defects_subtle(spark, sf):
    """Ten subtle kinds at three levels about the middle: scratches and cracks by lot, spots, shadows, stripes, grain."""
    return _each(big_images(spark, sf), [(k, n, generators.subtle(k, n, F.col("key"), SIDE, SIDE, UNIT)) for k in generators.SUBTLE for n in generators.LEVELS])


# Whole images as tiles: an image is 4 by 4 tiles of 8 by 8 -------------------------------------------


def tile_rows(spark, sf) -> DataFrame:
    """image, ty, tx, pixels."""
    return _t(spark, sf, "embeddings").select(F.expr("vec_id div 16").alias("image"), F.expr("cast(vec_id % 16 div 4 as int)").alias("ty"), F.expr("cast(vec_id % 4 as int)").alias("tx"), F.transform("embedding", _grey).alias("pixels"))


_WHOLE_ROWS = ["'scratch_long', 0, 1, 3, 3, 28, 28, 1, 0, 0, 2, 30, 1", *(f"'crack_zigzag', 0, 1, {a}, {14 if i % 2 == 0 else 4}, {b}, {4 if i % 2 == 0 else 14}, 1, 0, 0, 2, 25, 1" for i, (a, b) in enumerate([(3, 8), (8, 13), (13, 18), (18, 23), (23, 28)])), "'stain_large', 0, 3, 10, 16, 0, 0, 10, 5, 15, 2, 40, 1", *(f"'multi_scratch', 0, 1, {x}, 1, {x + 1.25}, 30, 1, 0, 0, 2, 30, 1" for x in (6, 11, 16, 20))]
_CLUSTER = " ".join(f"UNION ALL BY NAME SELECT id, 'spot_cluster' AS kind, 0 AS level, 2 AS form, 16 + {_lot(repr(f'/spot_cluster/x{n}'), 13)} - 6 AS ax, 16 + {_lot(repr(f'/spot_cluster/y{n}'), 13)} - 6 AS ay, 0 AS bx, 0 AS ey, ({_lot(repr(f'/spot_cluster/r{n}'), 8)} + 5) / 8 AS r, 0 AS r2, 0 AS turn, 2 AS mode, 25 AS amount, 1 AS alpha FROM (SELECT DISTINCT id, k FROM px)" for n in range(5))


@query(f"""WITH px AS (SELECT vec_id // 16 AS id, CAST(vec_id // 16 AS VARCHAR) AS k, CAST(vec_id % 16 // 4 * 8 + i // 8 AS INTEGER) AS y, CAST(vec_id % 4 * 8 + i % 8 AS INTEGER) AS x, {_GREY.format(v='embedding[i + 1]')} AS v FROM embeddings, range(64) r(i)),
s AS ({_shapes_sql(_WHOLE_ROWS)} {_CLUSTER}), {_PAINTED}
SELECT id AS image, kind, CAST(y // 8 AS INTEGER) AS ty, CAST(x // 8 AS INTEGER) AS tx, CAST(count(*) FILTER (WHERE abs(u - v) > 0.01) AS INTEGER) AS n_changed, round(avg(abs(u - v)), 5) AS mean_change FROM u GROUP BY ALL""")
def defects_whole_image(spark, sf):
    """Five kinds drawn over whole images that are stored as tiles: shapes meet the tiles that they reach."""
    tiles = tile_rows(spark, sf)
    images = tiles.select("image").distinct().withColumn("key", F.col("image").cast("string"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), generators.whole(k, F.col("key"), SIDE, SIDE, UNIT).alias("s")) for k in generators.WHOLE])
    drawn_on = images.select("image", F.explode(kinds).alias("d")).select("image", "d.kind", F.posexplode("d.s").alias("n", "shape"))
    each = tiles.withColumn("kind", F.explode(F.array(*map(F.lit, generators.WHOLE))))
    out = drawing.drawn(each, drawn_on, ["image", "kind"], 8, 4, 4)
    return out.select("image", "kind", "ty", "tx", _changed(F.col("pixels"), F.col("painted")).alias("c")).select("image", "kind", "ty", "tx", "c.*")


_LINE_SQL = f"""WITH {_BIG}, ids AS (SELECT DISTINCT id, k FROM px),
l AS (SELECT *, {_lot("'/line/cx'", 22)} + 5 AS cx, {_lot("'/line/cy'", 22)} + 5 AS cy, ({_lot("'/line/length'", 22)} + 10) // 2 AS half, floor(({_lot("'/line/slant'", 5)} - 2) / 2) AS lean FROM ids),
m AS (SELECT l.*, avg(v) AS mean FROM l JOIN px ON px.id = l.id AND x >= cx - 2 AND x < cx + 2 AND y >= cy - half AND y < cy + half GROUP BY ALL),
s AS (SELECT id, 'line' AS kind, CAST(n - 1 AS INTEGER) AS level, 1 AS form, cx - lean AS ax, cy - half AS ay, cx + lean AS bx, cy + half AS ey, 0.5 AS r, 0 AS r2, 0 AS turn, 2 AS mode, floor(mean * [0, 0.0, 0.25, 0.5, 0.75, 0.9, 0.95][n]) AS amount, CAST(n > 1 AS INTEGER) AS alpha FROM m, range(1, 8) r(n)),
{_PAINTED} SELECT id, level, n_changed, mean_change FROM ({_MEASURED})"""


@query(_LINE_SQL)
def defects_ratio_line(spark, sf):
    """A drawn line at seven levels: none, black, and ratios of the brightness about it."""
    return _each(big_images(spark, sf), [("line", n, generators.ratio_line(n, F.col("key"), F.col("pixels"), SIDE, SIDE, UNIT)) for n in generators.RATIOS]).drop("kind")


# Bytes, maps of vectors, layers, stored models ------------------------------------------------------


@query(f"SELECT vec_id AS id, CAST(i // 8 * 7 + i % 8 AS INTEGER) AS pos, CAST(floor({_GREY.format(v='embedding[i + 1]')}) AS INTEGER) AS value FROM embeddings, range(64) r(i) WHERE i % 8 < 7")
def pixels_from_bytes(spark, sf):
    """Images of 8 by 7 as bytes of bitmaps, with filled rows, and the pixels read from these."""
    kept = F.filter(F.transform("embedding", lambda x: F.floor(_grey(x))), lambda _, i: i % 8 < 7)
    data = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), pixels.to_bitmap(kept, 8, 7).alias("data"))
    return data.select("id", F.posexplode(pixels.bitmap(F.col("data"))["pixels"]).alias("pos", "value"))


def map_cells(spark, sf) -> DataFrame:
    """image, row, col, v: vectors on maps of 4 by 4."""
    return _t(spark, sf, "embeddings").select(F.expr("vec_id div 16").alias("image"), F.expr("cast(vec_id % 16 div 4 as int)").alias("row"), F.expr("cast(vec_id % 4 as int)").alias("col"), F.col("embedding").cast("array<double>").alias("v"))


@query("""WITH c AS (SELECT vec_id // 16 AS image, vec_id % 16 // 4 AS y, vec_id % 4 AS x, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
w AS (SELECT a.image, a.y, a.x, d, avg(b.v[d + 1]) AS m, count(*) AS n FROM c a JOIN c b ON a.image = b.image AND b.y BETWEEN a.y AND a.y + 2 AND b.x BETWEEN a.x AND a.x + 2, range(64) r(d) GROUP BY ALL)
SELECT image, CAST(y AS INTEGER) AS row, CAST(x AS INTEGER) AS col, CAST(d AS INTEGER) AS d, round(m, 6) AS value FROM w WHERE n = 9""")
def grid_pooled_vectors(spark, sf):
    """Maps of vectors under mean pooling of 3 by 3."""
    return grid.pooled(map_cells(spark, sf), ["image"]).select("image", "row", "col", F.posexplode("v").alias("d", "value")).withColumn("value", F.round("value", 6))


#: Components and bank rows (of every so many) of each layer set.
_LAYERS = {"L1": (0, 16, 5), "L1-3": (0, 48, 10), "L1-4": (0, 64, 5)}


@query(f"""WITH l AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {a}, {b}, {n})" for k, (a, b, n) in _LAYERS.items())}) t(layer, a, b, n)), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS id, layer, list_distance(q.v[a + 1 : b], k.v[a + 1 : b]) AS d FROM l, e q, e k WHERE q.vec_id % 5 <> 0 AND k.vec_id % n = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id, layer ORDER BY d) AS rn FROM d)
SELECT id, layer, round(avg(d), 6) AS score FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def knn_layer_sets(spark, sf):
    """Mean distance of the 3 nearest by layer set, each with a bank of its own, in one pass."""
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    sets = F.filter(F.array(*[F.when(F.col("id") % n == 0, k) for k, (_, _, n) in _LAYERS.items()]), lambda x: x.isNotNull())
    bank = rows.withColumn("layers", sets).where(F.size("layers") > 0)
    return knn.layer_scores(rows.where("id % 5 <> 0"), bank, {k: (a, b) for k, (a, b, _) in _LAYERS.items()}, 3).withColumn("score", F.round("score", 6))


@query("SELECT concat('m', label) AS model, count(*) AS n, min(vec_id) AS first, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE vec_id % CASE WHEN label = 1 THEN 7 ELSE 5 END = 0 AND label < 3 GROUP BY 1")
def models_stored(spark, sf):
    """Banks of three models in a store; one is fitted again alone, and all are read in their version in use."""
    root = own_folder(spark, "models")
    rows = _t(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    for label, every in ((0, 5), (1, 5), (2, 5), (1, 7)):
        store.save(root, {"bank": rows.where((F.col("label") == label) & (F.col("vec_id") % every == 0)).drop("label")}, f"m{label}")
    return store.load_all(spark, root, "bank").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.sum("vec_id").alias("ids"))


# Grids of given rows: a row is a tile of an image, numbered within it ---------------------------------

_AT = "g AS (SELECT CAST(r * {nx} + c AS INTEGER) AS tile_idx, CAST(c * {s} AS INTEGER) AS tile_x, CAST(r * {s} AS INTEGER) AS tile_y, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM range({ny}) a(r), range({nx}) b(c)), t AS (SELECT l_orderkey // {n} AS image, l_orderkey, l_linenumber, l_quantity, g.* FROM lineitem JOIN g ON g.tile_idx = (l_orderkey * 7 + l_linenumber) % {n})"


def line_tiles(spark, sf, width: int, height: int, size: int, step: int) -> DataFrame:
    """image, l_orderkey, l_linenumber, l_quantity and the tile of an image of width by height that a row of lineitem is."""
    places = grid.tiles(spark, width, height, size, step)
    n = ((width - size) // step + 1) * ((height - size) // step + 1)
    rows = _t(spark, sf, "lineitem").select(F.expr(f"l_orderkey div {n}").alias("image"), "l_orderkey", "l_linenumber", "l_quantity", F.expr(f"cast((l_orderkey * 7 + l_linenumber) % {n} as int)").alias("tile_idx"))
    return rows.join(F.broadcast(places), "tile_idx")  # as many rows as an image has tiles


@query(f"WITH {_AT.format(nx=15, ny=9, s=128, n=135)} SELECT image, tile_x, tile_y, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM t GROUP BY ALL")
def grid_tiles_of_rows(spark, sf):
    """Rows by image and place of their tile."""
    return line_tiles(spark, sf, 1920, 1200, 128, 128).groupBy("image", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query(f"WITH {_AT.format(nx=80, ny=50, s=24, n=4000)} SELECT l_orderkey, l_linenumber, row, col FROM t WHERE row % 2 = 0 AND col % 2 = 0")
def grid_cells_stride2_of_rows(spark, sf):
    """Rows on every other cell of every other row."""
    return grid.stride2(line_tiles(spark, sf, 1920, 1200, 24, 24)).select("l_orderkey", "l_linenumber", "row", "col")


@query(f"WITH {_AT.format(nx=14, ny=8, s=128, n=112)} SELECT CAST(tile_x // 128 + i AS INTEGER) AS cell_x, CAST(tile_y // 128 + j AS INTEGER) AS cell_y, round(avg(l_quantity), 6) AS heat FROM t, range(2) a(i), range(2) b(j) GROUP BY 1, 2")
def grid_overlap_heatmap_of_rows(spark, sf):
    """Mean quantity over the overlapping tiles that cover a cell."""
    return grid.overlap_heatmap(line_tiles(spark, sf, 1920, 1200, 256, 128).withColumn("score", F.col("l_quantity")), 256, 128).withColumn("heat", F.round("heat", 6))


@query(f"WITH {_AT.format(nx=15, ny=7, s=128, n=105)} SELECT image, count(*) FILTER (WHERE abs(tile_x + 64 - 960) <= 192 AND abs(tile_y + 164 - 600) <= 192) AS n_center, count(*) AS n FROM t GROUP BY 1")
def grid_cropped_of_rows(spark, sf):
    """Of images cropped by 100 pixels at the top and bottom: rows near the center, and all."""
    near = (F.abs(F.col("tile_x") + 64 - 960) <= 192) & (F.abs(F.col("tile_y") + 164 - 600) <= 192)
    return line_tiles(spark, sf, 1920, 1000, 128, 128).groupBy("image").agg(F.count_if(near).alias("n_center"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_AT.format(nx=15, ny=9, s=128, n=135)} SELECT l_orderkey, l_linenumber, tile_idx, CAST(row * 15 + 14 - col AS INTEGER) AS mirror_idx FROM t WHERE row < 2")
def tiles_row_band_of_rows(spark, sf):
    """Rows in the top two rows of tiles, with the tile of the mirrored camera."""
    t = line_tiles(spark, sf, 1920, 1200, 128, 128).where("row < 2")
    return t.select("l_orderkey", "l_linenumber", "tile_idx", (F.col("row") * 15 + grid.mirror_col(F.col("col"), 15)).cast("int").alias("mirror_idx"))


# Neighbourhoods, contrast, status ------------------------------------------------------------------

_SMALL = f"px AS (SELECT vec_id AS id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, {_GREY.format(v='embedding[i + 1]')} AS v FROM embeddings, range(64) r(i))"
_RING = ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(stencils.RING))


def small_images(spark, sf) -> DataFrame:
    """id, pixels: images of 8 by 8, flat."""
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", _grey).alias("pixels"))


@query(f"""WITH {_SMALL}, two AS (SELECT 0 AS turned, * FROM px UNION ALL SELECT 1, id, 7 - y, 7 - x, v FROM px),
n AS (SELECT c.turned, c.id, c.y, c.x, sum(CASE WHEN m.v >= c.v THEN 1 << k ELSE 0 END) AS code, sum(m.v * dx * (2 - abs(dy))) AS gx, sum(m.v * dy * (2 - abs(dx))) AS gy
  FROM two c, (VALUES {_RING}) f(k, dy, dx), two m WHERE m.turned = c.turned AND m.id = c.id AND m.y = c.y + dy AND m.x = c.x + dx AND c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 GROUP BY 1, 2, 3, 4),
l AS (SELECT id, stddev_pop(code) AS lbp_std, avg(sqrt(gx * gx + gy * gy)) AS sobel FROM n WHERE turned = 0 GROUP BY 1),
h AS (SELECT id, code, count(*) FILTER (WHERE turned = 0) / 36.0::DOUBLE AS a, count(*) FILTER (WHERE turned = 1) / 36.0::DOUBLE AS b FROM n GROUP BY 1, 2),
c AS (SELECT id, sum((a - b) ** 2 / (a + b)) / 2 AS lbp_chi2 FROM h GROUP BY 1),
s AS (SELECT id, k, y // k AS y, x // k AS x, avg(v) FILTER (WHERE turned = 0) AS v, avg(v) FILTER (WHERE turned = 1) AS w FROM two, (VALUES (1), (2), (4)) f(k) GROUP BY 1, 2, 3, 4),
d AS (SELECT id, k, stddev_pop(v) AS std FROM s GROUP BY 1, 2), m AS (SELECT id, avg(std) AS multires FROM d GROUP BY 1),
t AS (SELECT id, k, abs(v - w) AS away, row_number() OVER (PARTITION BY id, k ORDER BY abs(v - w) DESC) AS rn, count(*) OVER (PARTITION BY id, k) AS n FROM s),
w AS (SELECT id, max(top) AS worst FROM (SELECT id, k, avg(away) AS top FROM t WHERE rn <= greatest(floor(n * 5 / 100), 1) GROUP BY 1, 2) GROUP BY 1)
SELECT id, round(lbp_std, 5) AS lbp_std, round(lbp_chi2, 5) AS lbp_chi2, round(sobel, 5) AS sobel, round(multires, 5) AS multires, round(worst, 5) AS worst FROM l JOIN c USING (id) JOIN m USING (id) JOIN w USING (id)""")
def raster_stencils(spark, sf):
    """Binary patterns (deviation, and distance of the histogram from the turned image's), gradients, deviation over scales, and the worst scale against the turned image."""
    both = small_images(spark, sf).withColumn("turned", F.reverse("pixels"))
    p, t = F.col("pixels"), F.col("turned")
    measures = {"lbp_std": stencils.deviation(stencils.lbp(p, 8)), "lbp_chi2": stencils.chi_square(stencils.histogram(stencils.lbp(p, 8)), stencils.histogram(stencils.lbp(t, 8))), "sobel": stencils.mean(stencils.gradients(p, 8)), "multires": stencils.deviation_by_scale(p, 8), "worst": stencils.worst_scale(p, t, 8)}
    return both.select("id", *[F.round(m, 5).alias(n) for n, m in measures.items()])


@query(f"""WITH {_SMALL}, q AS (SELECT id, y, x, CAST(floor(v) AS INTEGER) AS v FROM px),
h AS (SELECT i.id, ty, tx, b, count(q.v) AS n FROM (SELECT DISTINCT id FROM q) i CROSS JOIN range(2) r(ty) CROSS JOIN range(2) c(tx) CROSS JOIN range(256) k(b) LEFT JOIN q ON q.id = i.id AND y // 4 = ty AND x // 4 = tx AND q.v = b GROUP BY 1, 2, 3, 4),
o AS (SELECT id, ty, tx, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS over FROM h GROUP BY 1, 2, 3),
e AS (SELECT h.id, h.ty, h.tx, b, least(n, 1) + over // 256 + CASE WHEN over % 256 > 0 AND b % greatest(256 // greatest(over % 256, 1), 1) = 0 AND b // greatest(256 // greatest(over % 256, 1), 1) < over % 256 THEN 1 ELSE 0 END AS n FROM h JOIN o ON o.id = h.id AND o.ty = h.ty AND o.tx = h.tx),
t AS (SELECT id, ty, tx, b, least(round_even(sum(n) OVER (PARTITION BY id, ty, tx ORDER BY b) * (255.0::DOUBLE / 16), 0), 255) AS u FROM e),
f AS (SELECT *, y / 4.0::DOUBLE - 0.5 AS fy, x / 4.0::DOUBLE - 0.5 AS fx FROM q),
g AS (SELECT f.id, f.y, f.x, sum(u * (CASE WHEN j = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE WHEN i = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END)) AS u
  FROM f, range(2) a(j), range(2) b(i), t WHERE t.id = f.id AND t.b = f.v AND t.ty = least(greatest(floor(fy) + j, 0), 1) AND t.tx = least(greatest(floor(fx) + i, 0), 1) GROUP BY 1, 2, 3)
SELECT id, CAST(y * 8 + x AS INTEGER) AS pos, round_even(u, 0) AS value FROM g""")
def pixel_clahe(spark, sf):
    """Contrast-limited equalisation of images of 8 by 8 in 2 by 2 tiles."""
    whole = small_images(spark, sf).withColumn("pixels", F.transform("pixels", lambda v: F.floor(v)))
    return equalise.clahe(whole, 8, 8, 2, 2).select("id", F.posexplode("pixels").alias("pos", "value"))


_LINES = "['Spec: ' || (event_id % 7) || 'x' || (event_id % 3) || ' | Group ' || (event_id % 5), 'Self-validation round ' || (event_id % 3 + 1) || '/3', 'Round ' || (event_id % 3) || ' features: ' || (event_id % 100) || '%', 'Scoring: ' || (event_id % 100) || '%', 'nothing to see']"


@query(f"""WITH l AS (SELECT user_id AS job, event_id AS seen_at, event_id % 5 AS kind, {_LINES}[event_id % 5 + 1] AS line FROM events)
SELECT job, arg_max(split_part(split_part(line, ' ', 2), ' ', 1), seen_at) FILTER (WHERE kind = 0) AS spec, CAST(arg_max(split_part(line, 'Group ', 2), seen_at) FILTER (WHERE kind = 0) AS INTEGER) AS "group",
  arg_max(split_part(line, 'round ', 2), seen_at) FILTER (WHERE kind = 1) AS round,
  arg_max(CASE WHEN kind = 2 THEN 'Feature extraction (Round ' || split_part(line, ' ', 2) || ')' ELSE 'Scoring' END, seen_at) FILTER (WHERE kind IN (2, 3)) AS stage,
  arg_max(CASE WHEN kind = 2 THEN split_part(line, 'features: ', 2) ELSE split_part(line, 'Scoring: ', 2) END, seen_at) FILTER (WHERE kind IN (2, 3)) AS detail, max(seen_at) AS seen FROM l GROUP BY 1""")
def status_of_jobs(spark, sf):
    """The last spec, round and stage of each job, from lines of its log."""
    e = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    lines = F.array(text("Spec: ", e % 7, "x", e % 3, " | Group ", e % 5), text("Self-validation round ", e % 3 + 1, "/3"), text("Round ", e % 3, " features: ", e % 100, "%"), text("Scoring: ", e % 100, "%"), F.lit("nothing to see"))
    return status.last_status(_t(spark, sf, "events").select(F.col("user_id").alias("job"), e.alias("at"), F.get(lines, (e % 5).cast("int")).alias("line")))


@query("""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT 0 AS pick, vec_id AS id, [v] AS found FROM e WHERE vec_id = (SELECT min(vec_id) FROM e)
  UNION ALL
  SELECT pick + 1, b.vec_id, list_append(found, b.v) FROM (SELECT p.pick, p.found, arg_max({'vec_id': e.vec_id, 'v': e.v}, {'d': list_min(list_transform(found, lambda x: list_distance(e.v, x))), 'low': -e.vec_id}) AS b FROM p, e GROUP BY ALL)
  WHERE pick + 1 < (SELECT CAST(floor(count(*) * 0.02) AS INTEGER) FROM e))
SELECT CAST(pick AS INTEGER) AS pick, id FROM p""")
def coreset_exact(spark, sf):
    """The farthest-point coreset of all vectors, in the order of picks."""
    rows = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return coreset.exact(rows, 0.02).select("pick", "id")
