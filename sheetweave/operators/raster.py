"""Raster steps: pages as tables of ink pixels where an expression will do, as arrays of one page where not."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetweave.functions.geometry import box
from sheetweave.operators.sheets import Columns, begins, whole_sheets
from sheetweave.operators.spatial import at_point, grid_join, shuffled


def masked(pixels: DataFrame, masks: DataFrame, pad: float = 0.0, cell: float = 16.0) -> DataFrame:
    """Pixels (sheet_id, x, y) outside all padded boxes (m_x0..m_y1)."""
    p = pixels.select("sheet_id", "x", "y")
    hit = grid_join(p, masks, on=["sheet_id"], a=at_point(F.col("x").cast("double"), F.col("y").cast("double")), b=box("m_").padded(pad), cell=cell)
    return p.join(shuffled(hit.select("sheet_id", "x", "y").distinct()), ["sheet_id", "x", "y"], "left_anti")


def junction_pixels(pixels: DataFrame, least: int = 3) -> DataFrame:
    """Pixels with at least three of eight neighbours, and how many. A pixel may be listed more than once. Whole sheets are looked up in their sorted pixels, so nothing grows but by the pixels."""
    def run(c: Columns) -> dict:
        x, y = c["x"] - c["x"].min() + 1, c["y"] - c["y"].min() + 1
        wide, high = int(x.max()) + 2, int(y.max()) + 2
        sheet = np.repeat(np.arange(len(b := begins(c["sheet_id"])) - 1), np.diff(b))
        ink, first = np.unique((sheet * high + y) * wide + x, return_index=True)
        n = np.zeros(len(ink), np.int64)
        for step in (1, wide - 1, wide, wide + 1):
            at = np.minimum(np.searchsorted(ink, ink + step), len(ink) - 1)
            met = ink[at] == ink + step
            n += met
            np.add.at(n, at[met], 1)
        kept = n >= least
        return {k: c[k][first[kept]] for k in ("sheet_id", "x", "y")} | {"n": n[kept]}

    return whole_sheets(pixels.select("sheet_id", F.col("x").cast("long"), F.col("y").cast("long")), run, "sheet_id long, x long, y long, n long")


def junction_kind(stubs: Column) -> Column:
    """By the number of lines that leave it; none with two or less."""
    return F.when(stubs <= 2, None).when(stubs == 3, "tee").when(stubs == 4, "cross").otherwise("joint")


def runs(pixels: DataFrame) -> DataFrame:
    """Runs of ink along rows: sheet_id, y, x (begin), n."""
    place = F.col("x") - F.row_number().over(Window.partitionBy("sheet_id", "y").orderBy("x"))
    return pixels.withColumn("_g", place).groupBy("sheet_id", "y", "_g").agg(F.min("x").alias("x"), F.count("*").alias("n")).drop("_g")


def otsu(page: np.ndarray) -> int:
    """The threshold between the two classes of grey levels that differ most."""
    h = np.bincount(page.ravel(), minlength=256).astype(float)
    w = np.cumsum(h)
    m = np.cumsum(h * np.arange(256))
    low, high = w, w[-1] - w
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (m / low - (m[-1] - m) / high) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, np.nan))) if len(np.unique(page)) > 1 else 127


def binarize(page: np.ndarray, size: int = 51, offset: int = 7) -> np.ndarray:
    """Ink (1) where a pixel is darker than the Gaussian mean around it by the offset; by Otsu if less than 1 or more than 99 per cent is ink."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-0.5 * ((np.arange(size) - size // 2) / sigma) ** 2)
    k /= k.sum()
    blur = page.astype(float)
    for axis in (0, 1):
        padded = np.pad(blur, [(size // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        blur = np.apply_along_axis(np.convolve, axis, padded, k, mode="valid")
    ink = (page <= blur - offset).astype(np.uint8)
    return ink if 0.01 <= ink.mean() <= 0.99 else (page <= otsu(page)).astype(np.uint8)


def skeleton(ink: np.ndarray) -> np.ndarray:
    """Thinning in two alternating passes until nothing changes (Zhang and Suen)."""
    img = np.pad(ink.astype(bool), 1)
    while True:
        changed = False
        for odd in (False, True):
            n = [np.roll(img, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            around = sum(x.astype(int) for x in n)
            turns = sum((~n[i] & n[(i + 1) % 8]).astype(int) for i in range(8))
            a, b = (n[0] & n[2] & n[6], n[0] & n[4] & n[6]) if odd else (n[0] & n[2] & n[4], n[2] & n[4] & n[6])
            gone = img & (around >= 2) & (around <= 6) & (turns == 1) & ~a & ~b
            if gone.any():
                img, changed = img & ~gone, True
        if not changed:
            return img[1:-1, 1:-1].astype(np.uint8)
