"""Joins of boxes and points, keyed by sheet, as equi-joins on grid cells.

A range condition alone would plan as a nested loop. Both sides are laid on a grid instead, joined on sheet
and cell, and filtered exactly. A pair that shares several cells is kept in one of them only, the cell of the
corner where the boxes begin to overlap, so no distinct is needed.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetweave.functions.geometry import Box, box, center
from sheetweave.operators.sheets import Columns, begins, whole_sheets


def shuffled(df: DataFrame) -> DataFrame:
    """df, which the next join shuffles and sorts and never broadcasts.

    Spark takes a generated table for as large as what it is made from, and a file for as large as its compressed bytes, so by its own
    estimate it would gather tables of any size on the driver.
    """
    return df.hint("merge")


def grid_join(left: DataFrame, right: DataFrame, *, on: list[str], a: Box, b: Box, cell: float, how: Column | None = None) -> DataFrame:
    """All pairs of rows of one ``on`` whose boxes a (of left) and b (of right) touch. Column names of both sides must differ but for ``on``."""
    def cells(df: DataFrame, x: Box, tag: str) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
        return df.withColumn(f"_{tag}x", x.x0).withColumn(f"_{tag}y", x.y0).withColumn(f"_{tag}u", x.x1).withColumn(f"_{tag}v", x.y1).withColumn("_cx", span(x.x0, x.x1)).withColumn("_cy", span(x.y0, x.y1))

    both = shuffled(cells(left, a, "l")).join(shuffled(cells(right, b, "r")), [*on, "_cx", "_cy"])
    touch = (F.col("_lx") <= F.col("_ru")) & (F.col("_rx") <= F.col("_lu")) & (F.col("_ly") <= F.col("_rv")) & (F.col("_ry") <= F.col("_lv"))
    own = (F.col("_cx") == F.floor(F.greatest("_lx", "_rx") / cell)) & (F.col("_cy") == F.floor(F.greatest("_ly", "_ry") / cell))
    out = both.where(touch & own if how is None else touch & own & how)
    return out.drop("_cx", "_cy", *(f"_{s}{c}" for s in "lr" for c in "xyuv"))


def at_point(x: Column, y: Column, radius: float = 0.0) -> Box:
    return Box(x - radius, y - radius, x + radius, y + radius)


def points_in_boxes(points: DataFrame, boxes: DataFrame, *, px: str = "px", py: str = "py", cell: float = 128.0) -> DataFrame:
    """Candidate pairs of points and the boxes (x0..y1) that hold them, borders included."""
    return grid_join(points, boxes, on=["sheet_id"], a=at_point(F.col(px), F.col(py)), b=box(), cell=cell)


def nearest(points: DataFrame, targets: DataFrame, *, key: list[str], px: Column, py: Column, tx: Column, ty: Column, radius: float, tie: list[Column], strict: bool = False, k: int = 1) -> DataFrame:
    """For each point (key), its k nearest targets within the radius, with ``_d2`` and ``_rank``; ties go by ``tie``. Points without one are left out."""
    near = grid_join(points.withColumn("_px", px).withColumn("_py", py), targets.withColumn("_tx", tx).withColumn("_ty", ty), on=["sheet_id"], a=at_point(F.col("_px"), F.col("_py"), radius), b=at_point(F.col("_tx"), F.col("_ty")), cell=max(radius, 1.0))
    d2 = (F.col("_px") - F.col("_tx")) * (F.col("_px") - F.col("_tx")) + (F.col("_py") - F.col("_ty")) * (F.col("_py") - F.col("_ty"))
    near = near.withColumn("_d2", d2).where(F.col("_d2") < radius * radius if strict else F.col("_d2") <= radius * radius)
    order = Window.partitionBy("sheet_id", *key).orderBy(F.col("_d2"), *tie)
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_px", "_py", "_tx", "_ty")


def smallest(pairs: DataFrame, *, key: list[str], size: Column, tie: list[Column]) -> DataFrame:
    """One row for each key, that of the smallest size."""
    order = Window.partitionBy(*key).orderBy(size, *tie)
    return pairs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def k_nearest_pairs(nodes: DataFrame, k: int, *, id_col: str = "node") -> DataFrame:
    """Undirected pairs (sheet_id, a, b) of each node and its k nearest on the sheet by centre; ties by id.

    A sheet's nodes are compared with each other, whole sheets at a time; a sheet is a page, so their number is bounded.
    """
    x, y = center(box())

    def run(c: Columns) -> dict:
        out = []
        for lo, hi in pairwise(begins(c["sheet_id"]).tolist()):
            p, x, y = (c[k][lo:hi] for k in ("p", "x", "y"))
            few = max(1, 2_000_000 // len(p))
            for at in range(0, len(p), few):  # of a very large sheet, some rows at a time
                q = p[at : at + few]
                dx, dy = x[at : at + few, None] - x, y[at : at + few, None] - y
                d2 = dx * dx + dy * dy
                d2[np.isnan(d2)] = np.finfo(float).max  # of unknown places, last
                d2[q[:, None] == p] = np.inf
                rows = np.arange(len(q))
                for _ in range(min(k, len(p) - 1)):
                    best = d2.argmin(1)  # the first, and nodes come by id
                    i = rows[d2[rows, best] < np.inf]
                    out.append((np.minimum(i + at, best[i]) + lo) * len(c["p"]) + np.maximum(i + at, best[i]) + lo)
                    d2[rows, best] = np.inf
        a, b = np.divmod(np.unique(np.concatenate(out)) if out else np.empty(0, int), len(c["p"]))
        return {"sheet_id": c["sheet_id"][a], "a": c["p"][a], "b": c["p"][b]}

    here = nodes.select("sheet_id", F.col(id_col).alias("p"), x.alias("x"), y.alias("y"))
    return whole_sheets(here, run, "sheet_id long, a long, b long", order=["p"])


def diagram_area(symbols: DataFrame, page_side: float | None = None, *, share: float = 0.03, least: int = 8) -> DataFrame:
    """(sheet_id, ax0, ay0, ax1, ay1): the box of the symbols' centres, padded by a share of the page's longer side, or of its own if that isn't known; null for fewer than least."""
    x, y = center(box())
    spread = symbols.groupBy("sheet_id").agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    pad = share * (F.lit(page_side) if page_side is not None else F.greatest(box().width, box().height))
    return spread.select("sheet_id", *(F.when(F.col("n") >= least, c).alias(f"a{name}") for name, c in zip(Box._fields, box().padded(pad), strict=True)))
