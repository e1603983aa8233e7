"""Tiles over sheets, and what lies on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.functions.geometry import Box, box
from sheetweave.operators.spatial import grid_join


def tile_grid(sheets: DataFrame, *, size: int = 1024, overlap: int = 205) -> DataFrame:
    """sheets: sheet_id, width, height (int). Tiles every size - overlap pixels until an origin is past the page; the last ones are clamped to it, so slivers occur."""
    stride = max(1, size - overlap)
    begins = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1, F.lit(stride)))
    t = sheets.withColumn("ty", begins("height")).withColumn("tx", begins("width"))
    x1, y1 = F.least(F.col("tx") + size, F.col("width")), F.least(F.col("ty") + size, F.col("height"))
    edge = (F.col("tx") == 0) | (F.col("ty") == 0) | (x1 == F.col("width")) | (y1 == F.col("height"))
    return t.select("sheet_id", F.col("tx").alias("x0"), F.col("ty").alias("y0"), x1.alias("x1"), y1.alias("y1"), edge.alias("is_edge"))


def boxes_on_tiles(boxes: DataFrame, tiles: DataFrame, cell: float = 1024.0) -> DataFrame:
    """Each box on every tile with which it has an area in common, in the tile's coordinates: sheet_id, node, tx, ty, x0..y1."""
    t = tiles.select("sheet_id", *(F.col(c).cast("double").alias(f"t_{c}") for c in Box._fields))
    b, tb = box(), box("t_")
    pairs = grid_join(boxes.select("sheet_id", "node", *b), t, on=["sheet_id"], a=b, b=tb, cell=cell)
    strict = (b.x0 < tb.x1) & (tb.x0 < b.x1) & (b.y0 < tb.y1) & (tb.y0 < b.y1)
    return pairs.where(strict).select("sheet_id", "node", tb.x0.alias("tx"), tb.y0.alias("ty"), *b.shifted(-tb.x0, -tb.y0).columns())


def points_on_tiles(points: DataFrame, tiles: DataFrame, least: int = 64) -> DataFrame:
    """Each point on the tiles (of ``least`` pixels at least) that hold it, low borders included, in thousandths of the tile."""
    t = tiles.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least)).select("sheet_id", *(F.col(c).cast("double").alias(f"t_{c}") for c in Box._fields))
    tb = box("t_")
    p = points.select("sheet_id", "pos", "px", "py")
    pairs = grid_join(p, t, on=["sheet_id"], a=Box(F.col("px"), F.col("py"), F.col("px"), F.col("py")), b=tb, cell=1024.0)
    inside = (tb.x0 <= F.col("px")) & (F.col("px") < tb.x1) & (tb.y0 <= F.col("py")) & (F.col("py") < tb.y1)
    part = lambda v, lo, hi: F.bround((v - lo) / (hi - lo) * 1000).cast("long")
    return pairs.where(inside).select("sheet_id", "pos", tb.x0.alias("tx"), tb.y0.alias("ty"), part(F.col("px"), tb.x0, tb.x1).alias("x"), part(F.col("py"), tb.y0, tb.y1).alias("y"))
