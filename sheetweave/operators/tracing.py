"""Lines of raster pages: from grey pixels to segments and junctions.

A page is one row with its grey bytes and is traced whole by one Arrow task, with the boxes of its symbols beside it;
pages never meet, so there is no shuffle of pixels. Points are (x, y) in pixels.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetweave.operators.raster import binarize, skeleton

Point = tuple[int, int]
AROUND = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j]
#: Which line a stroke's style stands for.
LINE_TYPES = {"continuous": "process", "dashed": "electric_signal", "dotted": "pneumatic", "double_line": "capillary", "unknown": "unknown"}


class Line(NamedTuple):
    points: list[Point]
    through: list[int]


class Junction(NamedTuple):
    x: int
    y: int
    kind: str


class Settings(NamedTuple):
    """Distances in pixels, angles in degrees."""

    pad: int = 12
    text_pad: int = 2
    cluster: int = 5
    window: int = 30
    tolerance: float = 2.0
    bridge_gap: int = 30
    join_gap: int = 36
    join_angle: float = 14.0
    junction_snap: int = 12
    symbol_snap: int = 60


def regions(mask: np.ndarray) -> np.ndarray:
    """The number of each pixel's region of touching pixels (eight neighbours), from 1 in reading order; 0 where the mask is empty.

    Runs of each row are the units: a run is tied to the runs of the row above that it touches.
    """
    out = np.zeros(mask.shape, np.int32)
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    wide = mask.shape[1] + 2
    first = np.searchsorted(row * wide + end, (row - 1) * wide + begin, "left")
    last = np.searchsorted(row * wide + begin, (row - 1) * wide + end, "right")
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(row)):
        for above in range(first[i], last[i]):
            a, b = find(above), find(i)
            root[max(a, b)] = min(a, b)
    number: dict[int, int] = {}
    for i in range(len(row)):
        out[row[i], begin[i] : end[i]] = number.setdefault(find(i), len(number) + 1)
    return out


def neighbours(ink: np.ndarray) -> np.ndarray:
    """How many of a pixel's eight neighbours are ink."""
    p = np.pad(ink.astype(np.int8), 1)
    h, w = ink.shape
    return sum(p[1 + j : 1 + j + h, 1 + i : 1 + i + w] for i, j in AROUND)


def _spread(mask: np.ndarray, radius: int) -> np.ndarray:
    for axis in (0, 1):
        padded = np.pad(mask, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)])
        mask = np.lib.stride_tricks.sliding_window_view(padded, 2 * radius + 1, axis=axis).any(-1)
    return mask


def stubs(thin: np.ndarray, x: int, y: int, window: int) -> int:
    """Lines that cross the border of the window around a point."""
    part = thin[max(0, y - window // 2) : y + window // 2 + 1, max(0, x - window // 2) : x + window // 2 + 1] > 0
    ring = part.copy()
    ring[1:-1, 1:-1] = False
    return int(regions(ring).max(initial=0))


def junctions(thin: np.ndarray, *, cluster: int = 5, window: int = 30) -> list[Junction]:
    """Where lines meet, by y and x: centres of clusters of pixels with three neighbours or more, if three lines or more leave the window."""
    crowded = (thin > 0) & (neighbours(thin) >= 3)
    if not crowded.any():
        return []
    spread = _spread(crowded, cluster)
    ys, xs = np.nonzero(spread)
    of = regions(spread)[ys, xs]
    n = np.bincount(of)[1:]
    cx, cy = (np.rint(np.bincount(of, v)[1:] / n).astype(int) for v in (xs, ys))
    found = []
    for y, x in sorted(zip(cy.tolist(), cx.tolist(), strict=True)):
        k = stubs(thin, x, y, window)
        if k > 2:
            found.append(Junction(x, y, {3: "tee", 4: "cross"}.get(k, "joint")))
    return found


def _steps_from(pixels: set[Point], start: Point) -> dict[Point, Point | None]:
    """Each pixel's predecessor on a shortest way from start, in the order in which they are reached."""
    came: dict[Point, Point | None] = {start: None}
    queue = deque([start])
    while queue:
        x, y = queue.popleft()
        for i, j in AROUND:
            q = (x + i, y + j)
            if q in pixels and q not in came:
                came[q] = (x, y)
                queue.append(q)
    return came


def _way(came: dict[Point, Point | None], to: Point | None) -> list[Point]:
    way = []
    while to is not None:
        way.append(to)
        to = came[to]
    return way[::-1]


def simplified(points: list[Point], tolerance: float) -> list[Point]:
    """Ramer-Douglas-Peucker: a vertex stays if it is further than the tolerance from the piece that would replace it."""
    p = np.array(points, float)
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        along, rel = p[j] - p[i], p[i + 1 : j] - p[i]
        t = np.clip(rel @ along / max(float(along @ along), 1e-12), 0, 1)
        off = np.linalg.norm(rel - t[:, None] * along, axis=1)
        if off.max() > tolerance:
            k = i + 1 + int(off.argmax())
            keep.add(k)
            todo += [(i, k), (k, j)]
    return [points[k] for k in sorted(keep)]


def polylines(thin: np.ndarray, at: list[Point], *, zone: int = 5, tolerance: float = 2.0) -> list[list[Point]]:
    """One line for each region that is left when a square around each junction is cleared: its longest way, simplified.

    The way leads between the two ends that lie furthest apart, or from the only end to the pixel that takes most steps.
    Regions without an end (rings) and single pixels give none.
    """
    left = thin > 0
    for x, y in at:
        left[max(0, y - zone) : y + zone + 1, max(0, x - zone) : x + zone + 1] = False
    ys, xs = np.nonzero(left)
    if not len(ys):
        return []
    of = regions(left)[ys, xs]
    is_end = neighbours(left)[ys, xs] == 1
    order = np.argsort(of, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        ends = part[is_end[part]]
        if len(part) < 2 or not len(ends):
            continue
        xy = lambda k: (int(xs[k]), int(ys[k]))
        start = xy(ends[0])
        stop = None
        if len(ends) > 1:
            ex, ey = xs[ends].astype(float), ys[ends].astype(float)
            far = [((ex[i + 1 :] - ex[i]) ** 2 + (ey[i + 1 :] - ey[i]) ** 2) for i in range(len(ends) - 1)]
            i = int(np.argmax([d.max() for d in far]))
            start, stop = xy(ends[i]), xy(ends[i + 1 + int(far[i].argmax())])
        came = _steps_from({xy(k) for k in part}, start)
        if stop is None:
            steps: dict[Point, int] = {}
            for q, before in came.items():
                steps[q] = 0 if before is None else steps[before] + 1
            stop = max(steps, key=steps.get)
        way = _way(came, stop)
        if len(way) > 1:
            out.append(simplified(way, tolerance))
    return out


def _flanks(ends: np.ndarray, b: np.ndarray, gap: float) -> np.ndarray:
    """Whether each end is near an edge of the box and not inside it."""
    x, y = ends.T
    x0, y0, x1, y1 = b
    inner = (x0 < x) & (x < x1) & (y0 < y) & (y < y1)
    beside = (np.minimum(abs(x - x0), abs(x - x1)) <= gap) & (y0 - gap <= y) & (y <= y1 + gap)
    above = (np.minimum(abs(y - y0), abs(y - y1)) <= gap) & (x0 - gap <= x) & (x <= x1 + gap)
    return ~inner & (beside | above)


def _sides(ends: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 left, 1 right, 2 above, 3 below: the side on which an end is nearest outside the box."""
    x, y = ends.T
    out = np.stack([b[0] - x, x - b[2], b[1] - y, y - b[3]]).astype(float)
    return np.where(out >= 0, out, np.inf).argmin(0)


def _from_box(p: Point, b: np.ndarray) -> float:
    """From a point to the nearest edge that faces it, or to a corner along both axes."""
    dx, dy = min(abs(p[0] - b[0]), abs(p[0] - b[2])), min(abs(p[1] - b[1]), abs(p[1] - b[3]))
    return dy if b[0] <= p[0] <= b[2] else dx if b[1] <= p[1] <= b[3] else dx + dy


def bridged(lines: list[Line], boxes: np.ndarray, ids: list[int], *, gap: float = 30.0) -> list[Line]:
    """Lines that a masked symbol cut are joined over it, and carry its id.

    Box by box, the first two lines that end near it and have ends on opposite sides are joined; then it begins again,
    until no box joins any. Ends don't move, so what each box sees of them is worked out once.
    """
    lines = list(lines)
    if not lines or not len(boxes):
        return lines
    ends = np.array([(line.points[0], line.points[-1]) for line in lines]).reshape(-1, 2)
    near = [_flanks(ends, b, gap) for b in boxes]
    side = [_sides(ends, b) for b in boxes]
    own = [(2 * i, 2 * i + 1) for i in range(len(lines))]  # a line's two ends
    line_of = {e: i for i, pair in enumerate(own) for e in pair}

    def partners(k: int) -> tuple[int, int] | None:
        at_box = sorted({line_of[e] for e in np.flatnonzero(near[k]).tolist() if e in line_of})
        if len(at_box) < 2:
            return None
        seen = [(i, int(side[k][e])) for i in at_box for e in own[i]]
        return next(((i, j) for i, s in seen for j, t in seen if i != j and s ^ 1 == t), None)

    k = 0
    while k < len(boxes):
        pair = partners(k)
        if pair is None:
            k += 1
            continue
        i, j = pair
        a, b = lines[i], lines[j]
        forward = _from_box(a.points[-1], boxes[k]) < _from_box(a.points[0], boxes[k])
        onward = _from_box(b.points[0], boxes[k]) < _from_box(b.points[-1], boxes[k])
        lines[i] = Line((a.points if forward else a.points[::-1]) + (b.points if onward else b.points[::-1]), sorted({*a.through, *b.through, ids[k]}))
        lines[j] = Line([], [])
        for e in own[i] + own[j]:
            del line_of[e]
        own[i] = (own[i][0 if forward else 1], own[j][1 if onward else 0])
        line_of |= dict.fromkeys(own[i], i)
        k = 0
    return [line for line in lines if line.points]


def _outward(points: list[Point], lookback: float = 14.0) -> np.ndarray:
    """The direction in which a line leaves its last point, from a point some way back."""
    tip = np.array(points[-1], float)
    back, length = tip, 0.0
    for p in points[-2::-1]:
        length += float(np.hypot(*(back - p)))
        back = np.array(p, float)
        if length >= lookback:
            break
    d = tip - back
    return d / (np.hypot(*d) or 1.0)


def _degrees(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(np.clip((u * v).sum(-1), -1, 1)))


def _close_pairs(at: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs of different points at most so far apart, by cells of that size."""
    cells: dict[tuple[int, int], list[int]] = {}
    for k, c in enumerate(np.floor(at / most).astype(int).tolist()):
        cells.setdefault((c[0], c[1]), []).append(k)
    a, b = [], []
    for (cx, cy), here in cells.items():
        others = [k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in cells.get((cx + i, cy + j), [])]
        a += [k for k in here for _ in others]
        b += others * len(here)
    one, two = np.array(a, int), np.array(b, int)
    close = (one != two) & (np.hypot(*(at[one] - at[two]).T) <= most)
    return one[close], two[close]


def joined(lines: list[Line], at: list[Point], *, gap: float = 36.0, angle: float = 14.0, block: float = 12.0, short: float = 9.0, short_angle: float = 27.0, rounds: int = 64) -> list[Line]:
    """Pieces of one straight line become one: dashes, and lines that a crossing cut.

    Two ends fit if they are at most ``gap`` apart, leave their lines in opposite directions, the gap lies in the first
    line's direction, and no junction is near its middle. The angle is wider for very short pieces. In each round, each
    line in turn takes the nearest end that fits of a line that has none yet; rounds go on until nothing fits.
    """
    lines = list(lines)
    spots = np.array(at, float).reshape(-1, 2)
    for _ in range(rounds):
        if len(lines) < 2:
            break
        tips = np.array([p for line in lines for p in (line.points[0], line.points[-1])], float)
        ways = np.array([w for line in lines for w in (_outward(line.points[::-1]), _outward(line.points))])
        length = np.array([np.hypot(*np.diff(np.array(line.points, float), axis=0).T).sum() for line in lines])
        a, b = _close_pairs(tips, gap)
        a, b = (v[a // 2 != b // 2] for v in (a, b))
        between = tips[b] - tips[a]
        far = np.hypot(*between.T)
        limit = np.where(np.minimum(length[a // 2], length[b // 2]) < short, short_angle, angle)
        fits = _degrees(ways[a], -ways[b]) <= limit
        fits &= (far <= 2) | (_degrees(ways[a], between / np.maximum(far, 1e-9)[:, None]) <= limit)
        a, b, far = a[fits], b[fits], far[fits]
        middle = (tips[a] + tips[b]) / 2
        if len(spots) and len(a):
            clear = np.array([np.hypot(*(spots - m).T).min() > block for m in middle])
            a, b, far = a[clear], b[clear], far[clear]
        if not len(a):
            break
        cell = np.floor(tips[b] / gap)
        order = np.lexsort((b, cell[:, 1], cell[:, 0], a, far, a // 2))
        used: set[int] = set()
        for k in order.tolist():
            i, j = int(a[k]) // 2, int(b[k]) // 2
            if i in used or j in used:
                continue
            used |= {i, j}
            one = lines[i].points if a[k] % 2 else lines[i].points[::-1]
            two = lines[j].points[::-1] if b[k] % 2 else lines[j].points
            lines[i] = Line(one + (two[1:] if one[-1] == two[0] else two), lines[i].through + lines[j].through)
            lines[j] = Line([], [])
        lines = [line for line in lines if line.points]
    return lines


def stroke(points: list[Point], page: np.ndarray, *, every: int = 3, ink: int = 128) -> tuple[str, float]:
    """(style, confidence) of a line, from runs of dark and light samples of the grey page along it."""
    dark: list[bool] = []
    h, w = page.shape
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        t = np.linspace(0, 1, max(1, max(1, int(np.hypot(x1 - x0, y1 - y0))) // every) + 1)
        x, y = np.rint(x0 + t * (x1 - x0)).astype(int), np.rint(y0 + t * (y1 - y0)).astype(int)
        on_page = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        dark += (page[y[on_page], x[on_page]] < ink).tolist()
    if not any(dark):
        return "unknown", 0.0
    cut = np.flatnonzero(np.diff(np.array(dark, np.int8))) + 1
    runs = [(bool(r[0]), len(r)) for r in np.split(np.array(dark), cut)]
    n_dark, n_light = (sum(1 for d, _ in runs if d == want) for want in (True, False))
    share = sum(dark) / len(dark)
    mean_dark, mean_light = sum(dark) / n_dark, (len(dark) - sum(dark)) / max(n_light, 1)
    if share > 0.85 and n_dark <= 2:
        return "continuous", min(0.95, share)
    if n_dark >= 3:
        if mean_dark <= 2 and mean_light >= 2 * mean_dark:
            return "dotted", 0.7
        return ("dashed", 0.75) if share > 0.25 else ("dotted", 0.55)
    return ("unknown", 0.3) if share < 0.2 else ("continuous", 0.5)


def ends_at(p: Point, at: list[Junction], boxes: np.ndarray, ids: list[int], s: Settings) -> tuple[str, int | None]:
    """(kind, id) of what a line's end belongs to: the nearest junction that is near enough, else the symbol around it whose centre is nearest."""
    d2 = [(j.x - p[0]) ** 2 + (j.y - p[1]) ** 2 for j in at]
    if d2 and min(d2) < (s.junction_snap + 1) ** 2:
        return "junction", int(np.argmin(d2))
    if len(boxes):
        r = s.symbol_snap
        around = (boxes[:, 0] - r <= p[0]) & (p[0] <= boxes[:, 2] + r) & (boxes[:, 1] - r <= p[1]) & (p[1] <= boxes[:, 3] + r)
        if around.any():
            off = ((boxes[:, 0] + boxes[:, 2]) / 2 - p[0]) ** 2 + ((boxes[:, 1] + boxes[:, 3]) / 2 - p[1]) ** 2
            return "symbol", ids[int(np.where(around, off, np.inf).argmin())]
    return "loose_end", None


def cleared(ink: np.ndarray, boxes: np.ndarray, pad: int) -> np.ndarray:
    ink = ink.copy()
    for x0, y0, x1, y1 in boxes.tolist():
        ink[max(0, y0 - pad) : max(0, y1 + pad), max(0, x0 - pad) : max(0, x1 + pad)] = 0
    return ink


def page_graph(page: np.ndarray, boxes: np.ndarray, ids: list[int], texts: np.ndarray | None = None, s: Settings = Settings()) -> tuple[list[dict], list[Junction]]:
    """(segments by the place of their first point, junctions by theirs) of one grey page.

    Symbols (boxes, whole pixels) and texts are masked, what is left is thinned; lines between junctions are joined over
    symbols and over gaps. A segment: points, through, style, line_type, confidence, and kind and id of both ends; a
    junction's id is its number.
    """
    boxes = np.asarray(boxes, int).reshape(-1, 4)
    ink = cleared(binarize(page), boxes, s.pad)
    if texts is not None:
        ink = cleared(ink, np.asarray(texts, int).reshape(-1, 4), s.text_pad)
    thin = skeleton(ink)
    at = junctions(thin, cluster=s.cluster, window=s.window)
    spots = [(j.x, j.y) for j in at]
    lines = [Line(p, []) for p in polylines(thin, spots, zone=s.cluster, tolerance=s.tolerance)]
    lines = joined(bridged(lines, boxes, ids, gap=s.bridge_gap), spots, gap=s.join_gap, angle=s.join_angle, block=s.junction_snap)
    segments = []
    for line in sorted(lines, key=lambda v: v.points[0][::-1]):
        style, confidence = stroke(line.points, page)
        a, b = (ends_at(p, at, boxes, ids, s) for p in (line.points[0], line.points[-1]))
        segments.append({"points": line.points, "through": line.through, "style": style, "line_type": LINE_TYPES[style], "confidence": round(confidence, 4), "a_kind": a[0], "a_ref": a[1], "b_kind": b[0], "b_ref": b[1]})
    return segments, at


def _by_page(pages: DataFrame, boxes: DataFrame | None, texts: DataFrame | None) -> DataFrame:
    """pages with arrays of their boxes, ids and texts' boxes; a page's boxes are a bounded list."""
    whole = [F.floor(c).cast("int") for c in ("x0", "y0", "x1", "y1")]
    out = pages.select("sheet_id", "width", "height", "grey")
    for name, df in (("boxes", boxes), ("texts", texts)):
        if df is None:
            out = out.withColumn(name, F.lit(None).cast("array<struct<id:bigint,b:array<int>>>"))
            continue
        key = F.col("node").cast("long") if "node" in df.columns else F.lit(0).cast("long")
        listed = df.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct(key.alias("id"), F.array(*whole).alias("b")))).alias(name))
        out = out.join(listed, "sheet_id", "left")
    return out


def _each_page(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(row, page as an array) gives tuples of the schema's columns after sheet_id. Pages without pixels give none."""
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.grey is None or not len(row.grey):
                    continue
                out = work(row, np.frombuffer(row.grey, np.uint8).reshape(int(row.height), int(row.width)))
                if out:
                    yield pd.DataFrame([(row.sheet_id, *t) for t in out], columns=names)

    return rows.mapInPandas(run, schema)


def trace_pages(pages: DataFrame, boxes: DataFrame, texts: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """The line graph of each page, as rows of segments and of junctions (``part``).

    pages: sheet_id, width, height, grey (a byte a pixel, row by row); boxes of symbols: sheet_id, node, x0..y1; texts: sheet_id, x0..y1.
    Segments: idx, points, style, line_type, confidence, a_kind, a_ref, b_kind, b_ref, through (symbols' ids); junctions: idx, points
    (one), kind, ambiguous. A page without symbols is traced without a mask; a null or empty page gives no rows.
    """
    at = pages.schema["sheet_id"].dataType.simpleString()
    schema = f"sheet_id {at}, part string, idx long, points array<array<int>>, kind string, ambiguous boolean, style string, line_type string, confidence double, a_kind string, a_ref long, b_kind string, b_ref long, through array<long>"

    def work(row, page: np.ndarray) -> list[tuple]:  # noqa: ANN001
        boxes_of = lambda listed: np.array([list(r["b"]) for r in (listed if listed is not None else [])], int).reshape(-1, 4)
        ids = [int(r["id"]) for r in (row.boxes if row.boxes is not None else [])]
        segments, found = page_graph(page, boxes_of(row.boxes), ids, boxes_of(row.texts), settings)
        out = [("segment", k, [list(p) for p in g["points"]], None, None, g["style"], g["line_type"], g["confidence"], g["a_kind"], g["a_ref"], g["b_kind"], g["b_ref"], g["through"]) for k, g in enumerate(segments)]
        return out + [("junction", k, [[j.x, j.y]], j.kind, j.kind == "cross", *(None,) * 8) for k, j in enumerate(found)]

    return _each_page(_by_page(pages, boxes, texts), work, schema)


def thinned(pages: DataFrame) -> DataFrame:
    """Ink pixels of the thinned pages: sheet_id, x, y."""
    at = pages.schema["sheet_id"].dataType.simpleString()

    def work(_, page: np.ndarray) -> list[tuple]:  # noqa: ANN001
        y, x = np.nonzero(skeleton(binarize(page)))
        return list(zip(x.tolist(), y.tolist(), strict=True))

    return _each_page(pages.select("sheet_id", "width", "height", "grey"), work, f"sheet_id {at}, x int, y int")


def autocontrast(page: np.ndarray) -> np.ndarray:
    """Grey levels stretched so that the darkest is 0 and the brightest 255; a page of one level stays."""
    lo, hi = int(page.min()), int(page.max())
    if hi <= lo:
        return page
    scale = 255.0 / (hi - lo)
    return np.clip(np.trunc(np.arange(256) * scale - lo * scale), 0, 255).astype(np.uint8)[page]


def upscaled(page: np.ndarray, times: float) -> np.ndarray:
    """The page enlarged (times at least 1) by a Lanczos filter of three lobes, rows first."""

    def weights(n: int) -> np.ndarray:
        m = int(n * times)
        centre = (np.arange(m) + 0.5) * n / m
        off = np.arange(n)[None, :] + 0.5 - centre[:, None]
        w = np.where(abs(off) < 3, np.sinc(off) * np.sinc(off / 3), 0.0)
        return w / w.sum(1, keepdims=True)

    level = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    wide = level(page.astype(float) @ weights(page.shape[1]).T)
    return level(weights(page.shape[0]) @ wide).astype(np.uint8)


def enhanced(pages: DataFrame, times: float = 1.0) -> DataFrame:
    """Pages (sheet_id, width, height, grey) enlarged and with their contrast stretched; pages without pixels are left out."""
    at = pages.schema["sheet_id"].dataType.simpleString()

    def work(_, page: np.ndarray) -> list[tuple]:  # noqa: ANN001
        done = autocontrast(upscaled(page, times) if times != 1 else page)
        return [(done.shape[1], done.shape[0], done.tobytes())]

    return _each_page(pages.select("sheet_id", "width", "height", "grey"), work, f"sheet_id {at}, width int, height int, grey binary")
