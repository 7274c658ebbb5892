"""Tile and cell grids, overlap heat maps, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tiles(spark: SparkSession, width: int, height: int, tile: int, stride: int) -> DataFrame:
    """tile_idx, tile_x, tile_y, row, col, row-major; the last tile ends inside the image."""
    nx, ny = (width - tile) // stride + 1, (height - tile) // stride + 1
    at = spark.range(nx * ny).select(F.col("id").cast("int").alias("tile_idx"))
    row, col = F.expr(f"tile_idx div {nx}").cast("int"), F.col("tile_idx") % nx
    return at.select("tile_idx", (col * stride).cast("int").alias("tile_x"), (row * stride).cast("int").alias("tile_y"), row.alias("row"), col.cast("int").alias("col"))


def stride2(cells: DataFrame) -> DataFrame:
    """Cells of even row and column."""
    return cells.where("row % 2 = 0 and col % 2 = 0")


def mirror_col(col: Column, nx: int) -> Column:
    return nx - 1 - col


def overlap_heatmap(scores: DataFrame, tile: int, cell: int) -> DataFrame:
    """Mean score of the tiles over each cell: cell_x, cell_y, heat. ``scores``: tile_x, tile_y, score."""
    steps = F.sequence(F.lit(0), F.lit(tile // cell - 1))
    spread = scores.select("*", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    return spread.groupBy((F.expr(f"tile_x div {cell}") + F.col("i")).cast("int").alias("cell_x"), (F.expr(f"tile_y div {cell}") + F.col("j")).cast("int").alias("cell_y")).agg(F.avg("score").alias("heat"))


def brightness_mask(means: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, valid: whether the mean over images of a tile's brightness reaches the threshold."""
    return means.groupBy(*keys).agg((F.avg("brightness") >= threshold).alias("valid"))


def masked(tiles_: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles with valid from the mask, true where it has none."""
    return tiles_.join(mask, keys, "left").withColumn("valid", F.coalesce("valid", F.lit(True)))


def pooled(cells: DataFrame, keys: list[str], size: int = 3, stride: int = 1, vector: str = "v") -> DataFrame:
    """keys, row, col, v: means of vectors over windows of ``size`` by ``size`` cells, one every ``stride``, that lie within what is there.

    ``cells``: keys, row, col (ints) and vectors of one length. Sums run along rows, then along columns, so that a cell is sent to two windows
    rather than joined with each neighbour; windows that miss a cell give no row. ``row`` and ``col`` count the windows.
    """
    from seamline.functions.vectors import add

    def along(rows: DataFrame, group: list[str], order: str) -> DataFrame:
        span = Window.partitionBy(*keys, *group).orderBy(order).rangeBetween(0, size - 1)
        listed = rows.withColumn("_w", F.collect_list(vector).over(span)).where((F.size("_w") == size) & (F.col(order) % stride == 0))
        return listed.withColumn(vector, F.aggregate(F.slice("_w", 2, size - 1), F.get("_w", F.lit(0)), add)).drop("_w")

    sums = along(along(cells.select(*keys, "row", "col", vector), ["row"], "col"), ["col"], "row")
    number = lambda c: F.expr(f"{c} div {stride}").cast("int").alias(c)
    return sums.select(*keys, number("row"), number("col"), F.transform(vector, lambda x: x / (size * size)).alias("v"))
