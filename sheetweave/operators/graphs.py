"""Line graphs and relation graphs, keyed by sheet: components, contraction, bounded traversal, hierarchy."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetweave.functions.geometry import Box, area, box, center, contained, distance2, foot, inside, segment_distance
from sheetweave.operators.assign import bridges
from sheetweave.operators.sheets import Columns, pair_codes, whole_sheets
from sheetweave.operators.spatial import at_point, diagram_area, grid_join, shuffled, smallest


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with the smaller end in a."""
    rest = [c for c in edges.columns if c not in ("sheet_id", "a", "b")]
    return edges.select("sheet_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest)


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the folder that spark.checkpoint.dir names and all executors share; joins don't broadcast it by the estimate of what it was made from."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return shuffled(df.checkpoint(eager=True))


def node_rows(nodes: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """Nodes (own) and edges as rows of one table: sheet_id, a, b, own and, of nodes, more."""
    own = nodes.select("sheet_id", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(True).alias("own"), *more)
    return own.unionByName(edges.select("sheet_id", "a", "b", F.lit(False).alias("own"), *(F.lit(False).alias(c) for c in more))).where("a is not null and b is not null")


def numbered(c: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of node_rows: the row of each node, by sheet and node, and the numbers of both ends of those edges whose ends are nodes."""
    a, b = pair_codes(c["sheet_id"], c["a"], c["b"])
    own = c["own"].astype(bool)
    node, first = np.unique(a[own], return_index=True)
    i, j = (np.minimum(np.searchsorted(node, x[~own]), len(node) - 1) for x in (a, b))
    known = (node[i] == a[~own]) & (node[j] == b[~own]) if len(node) else np.zeros(len(i), bool)
    return own.nonzero()[0][first], i[known], j[known]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sheet_id, node, component): the smallest node reachable. Edges with an end that is no node don't count."""
    def run(c: Columns) -> dict:
        row, i, j = numbered(c)
        low = np.arange(len(row))
        while True:  # the roots of both ends are joined, then each node looks up its root
            x, y = low[i], low[j]
            if (x == y).all():
                break
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low != (up := low[low])).any():
                low = up
        return {"sheet_id": c["sheet_id"][row], "node": c["a"][row], "component": c["a"][row][low]}

    return whole_sheets(node_rows(nodes, edges), run, "sheet_id long, node long, component long")


def cliques(members: DataFrame) -> DataFrame:
    """members: sheet_id, node, component, more. Distinct pairs a < b of one component."""
    x = members.select("sheet_id", "component", F.col("node").alias("a")).distinct()
    y = x.withColumnRenamed("a", "b")
    return shuffled(x).join(y, ["sheet_id", "component"]).where("a < b").select("sheet_id", "a", "b", "component")


def contract_through(nodes: DataFrame, edges: DataFrame, passing: tuple[str, ...], dropped: tuple[str, ...] = ("background",)) -> DataFrame:
    """Truth by contraction A: symbols that touch one component of passing nodes are all connected, dashed if an incident edge is; direct edges stay.

    nodes: sheet_id, node, cls; edges: sheet_id, a, b, line_type.
    """
    own = lambda n: shuffled(nodes.select("sheet_id", F.col("node").alias(n), F.col("cls").alias(f"c{n}")))
    e = canonical(edges).where("a <> b").join(own("a"), ["sheet_id", "a"]).join(own("b"), ["sheet_id", "b"])
    inner = nodes.where(F.col("cls").isin(*passing))
    parts = components(inner, e.where(F.col("ca").isin(*passing) & F.col("cb").isin(*passing)))
    comp = lambda n: shuffled(parts.select("sheet_id", F.col("node").alias(n), F.col("component")))
    touching = e.where(F.col("ca").isin(*passing)).join(comp("a"), ["sheet_id", "a"]).select("sheet_id", F.col("b").alias("node"), F.col("cb").alias("cls"), "component", "line_type")
    touching = touching.unionByName(e.where(F.col("cb").isin(*passing)).join(comp("b"), ["sheet_id", "b"]).select("sheet_id", F.col("a").alias("node"), F.col("ca").alias("cls"), "component", "line_type"))
    style = touching.groupBy("sheet_id", "component").agg(F.max((F.col("line_type") == "dashed").cast("int")).alias("dashed"))
    linked = cliques(touching.where(~F.col("cls").isin(*passing, *dropped))).join(shuffled(style), ["sheet_id", "component"])
    direct = e.where(~F.col("ca").isin(*passing, *dropped) & ~F.col("cb").isin(*passing, *dropped)).select("sheet_id", "a", "b", (F.col("line_type") == "dashed").cast("int").alias("dashed"))
    every = linked.select("sheet_id", "a", "b", "dashed").unionByName(direct)
    return every.groupBy("sheet_id", "a", "b").agg(F.when(F.max("dashed") == 1, "dashed").otherwise("solid").alias("line_type"))


def contract_equipment(nodes: DataFrame, edges: DataFrame, equipment: tuple[str, ...]) -> DataFrame:
    """Truth by contraction B: equipment is connected through connectors and through crossings whose degree isn't four. Degrees count repeated edges."""
    ends = edges.select("sheet_id", F.col("a").alias("node")).unionByName(edges.select("sheet_id", F.col("b").alias("node")))
    degree = ends.groupBy("sheet_id", "node").agg(F.count("*").alias("degree"))
    kinds = nodes.join(shuffled(degree), ["sheet_id", "node"], "left").withColumn("open", (F.col("cls") == "connector") | ((F.col("cls") == "crossing") & (F.coalesce("degree", F.lit(0)) != 4))).withColumn("equip", F.col("cls").isin(*equipment))
    own = lambda n: shuffled(kinds.select("sheet_id", F.col("node").alias(n), F.col("open").alias(f"o{n}"), F.col("equip").alias(f"q{n}")))
    e = canonical(edges.select("sheet_id", "a", "b")).where("a <> b").distinct().join(own("a"), ["sheet_id", "a"]).join(own("b"), ["sheet_id", "b"])
    parts = components(kinds.where("open"), e.where("oa and ob"))
    comp = lambda n: shuffled(parts.select("sheet_id", F.col("node").alias(n), "component"))
    touching = e.where("oa and qb").join(comp("a"), ["sheet_id", "a"]).select("sheet_id", F.col("b").alias("node"), "component").unionByName(e.where("ob and qa").join(comp("b"), ["sheet_id", "b"]).select("sheet_id", F.col("a").alias("node"), "component"))
    return cliques(touching).select("sheet_id", "a", "b").unionByName(e.where("qa and qb").select("sheet_id", "a", "b")).distinct()


def symbol_paths(nodes: DataFrame, edges: DataFrame, *, most: int = 8, passing: Column | None = None) -> DataFrame:
    """Shortest hops between symbols: (sheet_id, a, b, hops). nodes: sheet_id, node, symbol (boolean) and, if passing, that column.

    A frontier goes out from every symbol of some whole sheets at once and stops at symbols, unless they may be passed.
    (source, node) pairs are visited once, so paths never multiply.
    """
    may = F.col("symbol") if passing is None else F.col("symbol") & ~passing
    kinds = nodes.select("sheet_id", "node", F.coalesce("symbol", F.lit(False)).alias("symbol"), F.coalesce(~may, F.lit(False)).alias("open"))

    def run(c: Columns) -> dict:
        row, i, j = numbered(c)
        n = len(row)
        symbol, passed = (c[k][row].astype(bool) for k in ("symbol", "open"))
        order = np.argsort(np.concatenate((i, j)), kind="stable")
        to = np.concatenate((j, i))[order]
        degree = np.bincount(np.concatenate((i, j)), minlength=n)
        begin = np.cumsum(degree) - degree
        front = symbol.nonzero()[0] * (n + 1)
        seen, found, hops = front, [], []
        for hop in range(1, most + 1):
            source, at = np.divmod(front, max(n, 1))
            if hop > 1:
                source, at = source[passed[at]], at[passed[at]]
            many = degree[at]
            step = np.repeat(begin[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            front = np.setdiff1d(np.repeat(source, many) * n + to[step], seen)
            if not len(front):
                break
            seen = np.union1d(seen, front)
            source, at = np.divmod(front[symbol[front % n]], n)
            found.append(np.minimum(source, at) * n + np.maximum(source, at))
            hops.append(np.full(len(source), hop))
        pairs, first = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_index=True)  # the first has the fewest hops
        a, b = (c["a"][row][x] for x in np.divmod(pairs, max(n, 1)))
        return {"sheet_id": c["sheet_id"][row][pairs // max(n, 1)], "a": a, "b": b, "hops": np.concatenate([np.empty(0, np.int64), *hops])[first]}

    return whole_sheets(node_rows(kinds, edges, "symbol", "open"), run, "sheet_id long, a long, b long, hops int")


def split_points(segments: DataFrame, *, near: float = 2.0, low: float = 0.06, high: float = 0.94) -> DataFrame:
    """Noding: where other segments' ends lie on a segment. segments: sheet_id, seg, ax, ay, bx, by. Gives sheet_id, seg, t, distinct at four decimals."""
    ends = segments.select("sheet_id", F.col("seg").alias("of"), F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).select("sheet_id", "of", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    around = Box(F.least("ax", "bx") - near, F.least("ay", "by") - near, F.greatest("ax", "bx") + near, F.greatest("ay", "by") + near)
    line = (F.col("px"), F.col("py"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    pairs = grid_join(ends, segments, on=["sheet_id"], a=at_point(F.col("px"), F.col("py")), b=around, cell=256.0).where("of <> seg")
    t = foot(*line)
    return pairs.where((segment_distance(*line) <= near) & (t > low) & (t < high)).select("sheet_id", "seg", F.bround(t, 4).alias("t")).distinct()


def merged(points: DataFrame, distance: float = 4.0) -> DataFrame:
    """points: sheet_id, node, x, y. Adds component: points that hang together by steps of at most the distance are one."""
    here = points.select("sheet_id", F.col("node").alias("a"), F.col("x").alias("px"), F.col("y").alias("py"))
    there = points.select("sheet_id", F.col("node").alias("b"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    near = grid_join(here, there, on=["sheet_id"], a=at_point(F.col("px"), F.col("py"), distance), b=at_point(F.col("qx"), F.col("qy")), cell=64.0)
    edges = near.where((F.col("a") < F.col("b")) & (distance2(F.col("px"), F.col("py"), F.col("qx"), F.col("qy")) <= distance * distance)).select("sheet_id", "a", "b")
    return shuffled(points).join(components(points.select("sheet_id", "node"), edges), ["sheet_id", "node"])


def merge_points(points: DataFrame, distance: float = 4.0) -> DataFrame:
    """The merged points, each at the mean of its members."""
    return merged(points, distance).groupBy("sheet_id", F.col("component").alias("node")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def containment_parents(nodes: DataFrame, equipment: tuple[str, ...], children: tuple[str, ...], pad: float = 0.05) -> DataFrame:
    """Each child's smallest equipment that contains it, padded: (sheet_id, node, parent); ties by id."""
    e = nodes.where(F.col("cls").isin(*equipment)).select("sheet_id", F.col("node").alias("parent"), *(c.alias(f"e_{n}") for n, c in zip(box()._fields, box(), strict=True)))
    c = nodes.where(F.col("cls").isin(*children)).select("sheet_id", "node", *box())
    wide = box("e_").padded(pad * F.greatest(F.lit(1.0), box("e_").width), pad * F.greatest(F.lit(1.0), box("e_").height))
    pairs = grid_join(c, e, on=["sheet_id"], a=box(), b=wide, cell=256.0, how=contained(box(), box("e_"), pad))
    return smallest(pairs, key=["sheet_id", "node"], size=area(box("e_")), tie=[F.col("parent")]).select("sheet_id", "node", "parent")


def adjacent_parents(nodes: DataFrame, edges: DataFrame, placed: DataFrame, equipment: tuple[str, ...], children: tuple[str, ...]) -> DataFrame:
    """For children without a parent, the nearest equipment one or two edges away; ties by id."""
    both = edges.select("sheet_id", "a", "b").unionByName(edges.select("sheet_id", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    left = nodes.where(F.col("cls").isin(*children)).join(shuffled(placed), ["sheet_id", "node"], "left_anti").select("sheet_id", "node", center(box())[0].alias("x"), center(box())[1].alias("y"))
    both = shuffled(both)
    one = left.join(both.select("sheet_id", F.col("a").alias("node"), F.col("b").alias("parent")), ["sheet_id", "node"])
    two = one.withColumnRenamed("parent", "a").join(both, ["sheet_id", "a"]).drop("a").withColumnRenamed("b", "parent")
    e = nodes.where(F.col("cls").isin(*equipment)).select("sheet_id", F.col("node").alias("parent"), center(box())[0].alias("u"), center(box())[1].alias("v"))
    near = one.unionByName(two).distinct().join(shuffled(e), ["sheet_id", "parent"])
    return smallest(near, key=["sheet_id", "node"], size=distance2(F.col("x"), F.col("y"), F.col("u"), F.col("v")), tie=[F.col("parent")]).select("sheet_id", "node", "parent")


def degree_two_chains(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Degree-2 contraction: runs of nodes that aren't symbols and have two neighbours become one edge: (sheet_id, a, b, n_edges).

    A run is a component of such nodes; it joins the two nodes at its ends, and rings or runs that lead back to one node are left out.
    """
    e = canonical(edges.select("sheet_id", "a", "b")).where("a <> b").distinct()
    both = e.unionByName(e.select("sheet_id", F.col("b").alias("a"), F.col("a").alias("b")))
    inner = both.groupBy("sheet_id", F.col("a").alias("node")).agg(F.count("*").alias("n")).where("n = 2").join(shuffled(symbols.select("sheet_id", "node")), ["sheet_id", "node"], "left_anti")
    tag = lambda n: shuffled(inner.select("sheet_id", F.col("node").alias(n), F.lit(True).alias(f"i{n}")))
    kinds = e.join(tag("a"), ["sheet_id", "a"], "left").join(tag("b"), ["sheet_id", "b"], "left").select("sheet_id", "a", "b", F.coalesce("ia", F.lit(False)).alias("ia"), F.coalesce("ib", F.lit(False)).alias("ib"))
    parts = components(inner.select("sheet_id", "node"), kinds.where("ia and ib"))
    comp = lambda n: shuffled(parts.select("sheet_id", F.col("node").alias(n), "component"))
    ends = kinds.where("ia and not ib").join(comp("a"), ["sheet_id", "a"]).select("sheet_id", "component", F.col("b").alias("end")).unionByName(kinds.where("ib and not ia").join(comp("b"), ["sheet_id", "b"]).select("sheet_id", "component", F.col("a").alias("end")))
    size = parts.groupBy("sheet_id", "component").agg(F.count("*").alias("n"))
    runs = ends.groupBy("sheet_id", "component").agg(F.min("end").alias("a"), F.max("end").alias("b")).where("a <> b").join(shuffled(size), ["sheet_id", "component"]).select("sheet_id", "a", "b", (F.col("n") + 1).alias("n_edges"))
    return kinds.where("not ia and not ib").select("sheet_id", "a", "b", F.lit(1).cast("long").alias("n_edges")).unionByName(runs)


def first_evidence(pairs: DataFrame) -> DataFrame:
    """pairs: sheet_id, a, b, pass_no, more. One row for each undirected pair, that of the earliest pass."""
    c = canonical(pairs)
    order = Window.partitionBy("sheet_id", "a", "b").orderBy("pass_no")
    return c.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pieces(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """Segments cut at cuts (sheet_id, seg, t): sheet_id, seg, k, ax, ay, bx, by of each piece."""
    at = cuts.groupBy("sheet_id", "seg").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    ts = F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.expr("cast(array() as array<double>)")), F.array(F.lit(1.0)))
    cut_up = segments.join(shuffled(at), ["sheet_id", "seg"], "left").withColumn("ts", ts)
    part = F.posexplode(F.arrays_zip(F.slice("ts", F.lit(1), F.size("ts") - 1).alias("u"), F.slice("ts", F.lit(2), F.size("ts") - 1).alias("w")))
    rows = cut_up.select("sheet_id", "seg", "ax", "ay", "bx", "by", part.alias("k", "p"))
    along = lambda t, a, b: F.col(a) + F.col(f"p.{t}") * (F.col(b) - F.col(a))
    return rows.select("sheet_id", "seg", "k", along("u", "ax", "bx").alias("ax"), along("u", "ay", "by").alias("ay"), along("w", "ax", "bx").alias("bx"), along("w", "ay", "by").alias("by"))


def clipped(segments: DataFrame, symbols: DataFrame, page_side: float | None = None) -> DataFrame:
    """Segments whose middle lies in the diagram's area, which drops lines of title blocks and tables; all of a sheet with too few symbols to tell."""
    names = [f"_area_{n}" for n in Box._fields]
    area_of = diagram_area(symbols, page_side).toDF("sheet_id", *names)
    middle = ((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2)
    return segments.join(shuffled(area_of), "sheet_id", "left").where(F.coalesce(inside(*middle, box("_area_")), F.lit(True))).drop(*names)


def gap_bridges(segments: DataFrame, *, least: float = 4.0, most: float = 130.0, cosine: float = 0.96) -> DataFrame:
    """Lines over gaps, such as those that a symbol drawn on a pipe leaves: (sheet_id, i, j, ax, ay, bx, by), from end i to end j.

    segments: sheet_id, seg, ax, ay, bx, by, each longer than 0. Ends are numbered 2 seg and 2 seg + 1. An end is open if no other is
    within ``least``; two open ends of different segments fit if they are at most ``most`` apart and each points at the
    other. In the order of their numbers, each takes the nearest that is free.
    """
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    ux, uy = (F.col("bx") - F.col("ax")) / length, (F.col("by") - F.col("ay")) / length
    side = lambda k, x, y, dx, dy: F.struct((F.col("seg") * 2 + k).alias("i"), F.col(x).alias("x"), F.col(y).alias("y"), dx.alias("dx"), dy.alias("dy"))
    ends = cut(segments.select("sheet_id", "seg", F.explode(F.array(side(0, "ax", "ay", -ux, -uy), side(1, "bx", "by", ux, uy))).alias("e")).select("sheet_id", "seg", "e.*"))

    def pairs(df: DataFrame, radius: float, cell: float) -> DataFrame:
        other = df.select("sheet_id", *(F.col(c).alias(f"o_{c}") for c in ("seg", "i", "x", "y", "dx", "dy")))
        near = grid_join(df, other, on=["sheet_id"], a=at_point(F.col("x"), F.col("y"), radius), b=at_point(F.col("o_x"), F.col("o_y")), cell=cell)
        return near.withColumn("d2", distance2(F.col("x"), F.col("y"), F.col("o_x"), F.col("o_y"))).where(F.col("d2") <= radius * radius)

    closed = pairs(ends, least, 64.0).where("i <> o_i").select("sheet_id", "i").distinct()
    free = cut(ends.join(shuffled(closed), ["sheet_id", "i"], "left_anti"))
    toward = lambda sign, dx, dy: sign * (F.col(dx) * (F.col("o_x") - F.col("x")) + F.col(dy) * (F.col("o_y") - F.col("y"))) > cosine * F.sqrt("d2")
    fit = pairs(free, most, most).where((F.col("i") < F.col("o_i")) & (F.col("seg") != F.col("o_seg")) & (F.col("d2") > least * least) & toward(1, "dx", "dy") & toward(-1, "o_dx", "o_dy"))
    chosen = bridges(fit.select("sheet_id", "i", F.col("o_i").alias("j"), "d2"))
    at = lambda n, x, y: free.select("sheet_id", F.col("i").alias(n), F.col("x").alias(x), F.col("y").alias(y))
    return shuffled(chosen).join(at("i", "ax", "ay"), ["sheet_id", "i"]).join(at("j", "bx", "by"), ["sheet_id", "j"]).select("sheet_id", "i", "j", "ax", "ay", "bx", "by")


def vector_page_graph(segments: DataFrame, symbols: DataFrame, *, pad: float = 12.0, shortest: float = 1.0, joined: float = 4.0, clip: bool = True, bridge: float = 130.0, page_side: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a page's line graph. segments: sheet_id, seg, ax, ay, bx, by; symbols: sheet_id, node and a box.

    Segments outside the diagram's area are left out (clip), and gaps of up to ``bridge`` in a line are closed (none with 0).
    Segments are cut where others end on them, ends are merged, an end within a padded symbol is that symbol, and
    runs of nodes with two neighbours become one edge. Nodes: sheet_id, node, symbol (its id, or null), kind; symbols
    keep their ids, other nodes get negative ones. Edges: sheet_id, a, b, n_edges.
    """
    long_enough = segments.where(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) > shortest)
    drawn = clipped(long_enough, symbols, page_side) if clip else long_enough
    number = F.row_number().over(Window.partitionBy("sheet_id").orderBy("seg", "ax", "ay", "bx", "by")).cast("long")
    drawn = cut(drawn.select("sheet_id", number.alias("seg"), "ax", "ay", "bx", "by"))
    if bridge:
        drawn = cut(drawn.unionByName(gap_bridges(drawn, least=joined, most=bridge).select("sheet_id", (-F.col("i")).alias("seg"), "ax", "ay", "bx", "by")))
    part = cut(pieces(drawn, split_points(drawn)))
    end = lambda side: F.xxhash64("sheet_id", "seg", "k", F.lit(side))
    part = part.withColumn("p", end(0)).withColumn("q", end(1))
    points = part.select("sheet_id", F.col("p").alias("node"), F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(part.select("sheet_id", F.col("q").alias("node"), F.col("bx").alias("x"), F.col("by").alias("y")))
    of = cut(merged(points, joined))
    spots = of.groupBy("sheet_id", "component").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    pairs = grid_join(spots, symbols.select("sheet_id", F.col("node").alias("symbol"), *box()), on=["sheet_id"], a=at_point(F.col("x"), F.col("y")), b=box().padded(pad), cell=256.0)
    hit = smallest(pairs, key=["sheet_id", "component"], size=area(box()), tie=[F.col("symbol")]).select("sheet_id", "component", "symbol")
    new_id = -(F.row_number().over(Window.partitionBy("sheet_id").orderBy("y", "x", "component"))).cast("long")
    spots = cut(shuffled(spots).join(hit, ["sheet_id", "component"], "left").withColumn("_id", new_id).withColumn("node", F.coalesce("symbol", "_id")))
    named = shuffled(of.select("sheet_id", F.col("node").alias("_e"), "component")).join(spots.select("sheet_id", "component", "node"), ["sheet_id", "component"]).select("sheet_id", "_e", "node")
    ends = lambda c, to: shuffled(named.select("sheet_id", F.col("_e").alias(c), F.col("node").alias(to)))
    raw = cut(part.select("sheet_id", "p", "q").join(ends("p", "a"), ["sheet_id", "p"]).join(ends("q", "b"), ["sheet_id", "q"]).select("sheet_id", "a", "b").where("a <> b").distinct())
    edges = cut(degree_two_chains(raw, symbols.select("sheet_id", "node")))
    degree = edges.select("sheet_id", F.col("a").alias("node")).unionByName(edges.select("sheet_id", F.col("b").alias("node"))).groupBy("sheet_id", "node").agg(F.count("*").alias("degree"))
    kind = F.when(F.col("symbol").isNotNull(), "symbol").when(F.col("degree") == 1, "loose_end").when(F.col("degree") == 3, "tee").when(F.col("degree") == 4, "cross").otherwise("joint")
    nodes = spots.select("sheet_id", "node", "symbol").distinct().join(shuffled(degree), ["sheet_id", "node"]).select("sheet_id", "node", "symbol", kind.alias("kind"))
    return nodes, edges
