"""Typed relations from traced lines, and the sorting of extracted tags into symbols, ports and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetweave.functions.geometry import Box, area, box, center, gap, margin, text_shaped
from sheetweave.operators.graphs import canonical, first_evidence
from sheetweave.operators.spatial import at_point, grid_join, shuffled, smallest


def build_relations(nodes: DataFrame, inline: DataFrame, direct: DataFrame, paths: DataFrame, *, children: tuple[str, ...], hosts: tuple[str, ...], most_segments: int = 8, most_segments_boundary: int = 8, most_gap: float | None = None) -> DataFrame:
    """(sheet_id, a, b, pass_no, n_segments, verdict): every candidate pair with ``kept`` or the reason why it was dropped.

    nodes: sheet_id, node, cls, terminal and a box; inline (pass 0) and direct (pass 1): sheet_id, a, b; paths (pass 2):
    with n_segments. Direct evidence beats traversal for the same pair. Two terminals are never related. A terminal
    keeps only its shortest traversals. A child with a direct host gets no other host by traversal. Traversal between
    non-terminals is limited in distance. Two children stay related only by a line that passes through them.
    """
    own = lambda n: shuffled(nodes.select("sheet_id", F.col("node").alias(n), F.col("cls").alias(f"c{n}"), F.col("terminal").alias(f"t{n}"), *(c.alias(f"{n}_{f}") for f, c in zip(Box._fields, box(), strict=True))))
    none = F.lit(0).cast("long")
    given = canonical(inline.select("sheet_id", "a", "b", F.lit(0).alias("pass_no"), none.alias("n_segments"))).unionByName(canonical(direct.select("sheet_id", "a", "b", F.lit(1).alias("pass_no"), none.alias("n_segments"))))
    walked = canonical(paths.select("sheet_id", "a", "b", F.lit(2).alias("pass_no"), F.col("n_segments").cast("long").alias("n_segments")))
    walked = walked.groupBy("sheet_id", "a", "b", "pass_no").agg(F.min("n_segments").alias("n_segments"))
    known = given.unionByName(walked).where("a <> b").join(own("a"), ["sheet_id", "a"]).join(own("b"), ["sheet_id", "b"])
    boundary = F.col("ta") != F.col("tb")
    fits = (F.col("pass_no") < 2) | (F.col("n_segments") <= F.when(boundary, most_segments_boundary).otherwise(most_segments))
    known = known.where(fits)
    # the bar of a terminal: its shortest traversal to what isn't one; at most one end of a boundary pair is a terminal
    port = F.when(boundary & (F.col("pass_no") == 2), F.when(F.col("ta"), F.col("a")).otherwise(F.col("b")))
    known = known.withColumn("_port", port)
    bar = known.where("_port is not null").groupBy("sheet_id", "_port").agg(F.min("n_segments").alias("_bar"))
    hosted = known.where("pass_no < 2 and not (ta and tb)").select("sheet_id", F.explode(F.array(F.when(F.col("ca").isin(*children) & F.col("cb").isin(*hosts), F.col("a")), F.when(F.col("cb").isin(*children) & F.col("ca").isin(*hosts), F.col("b")))).alias("_child")).where("_child is not null").distinct().withColumn("_hosted", F.lit(True))
    child = F.when(F.col("ca").isin(*children) & F.col("cb").isin(*hosts), F.col("a")).when(F.col("cb").isin(*children) & F.col("ca").isin(*hosts), F.col("b"))
    known = known.withColumn("_child", child).join(shuffled(bar), ["sheet_id", "_port"], "left").join(shuffled(hosted), ["sheet_id", "_child"], "left")
    first = F.min("pass_no").over(Window.partitionBy("sheet_id", "a", "b"))
    far = (F.col("pass_no") == 2) & ~boundary & (gap(box("a_"), box("b_")) > most_gap) if most_gap is not None else F.lit(False)
    both_children = F.col("ca").isin(*children) & F.col("cb").isin(*children)
    verdict = (
        F.when(F.col("ta") & F.col("tb"), "terminal_pair")
        .when(F.coalesce(F.col("n_segments") > F.col("_bar"), F.lit(False)), "far_terminal")
        .when(F.col("pass_no") > F.col("_first"), "other_evidence")
        .when((F.col("pass_no") == 2) & F.coalesce("_hosted", F.lit(False)), "single_host")
        .when(far, "distance_cap")
        .when(both_children & (F.col("pass_no") > 0), "child_child")
        .otherwise("kept")
    )
    out = known.withColumn("_first", first).select("sheet_id", "a", "b", "pass_no", "n_segments", verdict.alias("verdict"))
    return out.where("verdict <> 'other_evidence'").distinct()


def relations(candidates: DataFrame) -> DataFrame:
    """The relations that were kept, one for each pair."""
    return first_evidence(candidates.where("verdict = 'kept'").select("sheet_id", "a", "b", "pass_no", "n_segments"))


def classify_tags(tags: DataFrame, *, page_w: Column, page_h: Column, label_types: tuple[str, ...] = ("line",)) -> DataFrame:
    """tags: sheet_id, node, text, type and a box. Adds ``pile``: label, schedule, port, symbol or duplicate.

    Labels are of label types; a text in a margin that also stands in the body restates it; equipment in a side
    margin is a port; of symbols with one text, those that look like text are dropped where another looks like a symbol.
    """
    b = box()
    zone = margin(b, page_w, page_h)
    t = tags.withColumn("_zone", zone).withColumn("_label", F.col("type").isin(*label_types))
    body = t.where("_zone = 'body' and not _label and text <> ''").select("sheet_id", "text").distinct().withColumn("_body", F.lit(True))
    t = t.join(shuffled(body), ["sheet_id", "text"], "left")
    pile = F.when(F.col("_label"), "label").when(F.coalesce("_body", F.lit(False)) & (F.col("_zone") != "body"), "schedule").when((F.col("type") == "equipment") & (F.col("_zone") == "side"), "port").otherwise("symbol")
    t = t.withColumn("pile", pile).withColumn("_flat", F.coalesce(text_shaped(b), F.lit(False)))
    shapes = t.where("pile = 'symbol' and text <> ''").groupBy("sheet_id", "text").agg((F.bool_or("_flat") & F.bool_or(~F.col("_flat"))).alias("_both"))
    t = t.join(shuffled(shapes), ["sheet_id", "text"], "left")
    double = (F.col("pile") == "symbol") & F.coalesce("_both", F.lit(False)) & F.col("_flat")
    return t.select("sheet_id", "node", "text", F.when(double, "duplicate").otherwise(F.col("pile")).alias("pile"))


def detect_ports(words: DataFrame, paths: DataFrame, *, page_w: float, page_h: float, pattern: str = r"^[A-Z]{2}-\d{4}", side: float = 0.16, pad: float = 3.0, most: float = 880.0, below: float = 90.0, beside: float = 200.0) -> DataFrame:
    """Off-page connectors from sheet references in the side margins: sheet_id, pos, text, box, ref.

    words: sheet_id, pos, text and a box; paths: sheet_id, node and a box. A reference's extent is the smallest path
    around it, or its own box; extents more than twice as wide as the upper median are cut to that width at the
    reference; ref is the cheapest text below, of which height counts four times as much as width.
    """
    b = box()
    w = words.where(F.col("text").rlike(pattern)).where(margin(b, F.lit(page_w), F.lit(page_h), side=side) == "side")
    seed = w.select("sheet_id", "pos", "text", center(b)[0].alias("cx"), center(b)[1].alias("cy"), *(c.alias(f"w_{n}") for n, c in zip(Box._fields, b, strict=True)))
    around = grid_join(seed, paths.select("sheet_id", "node", *b), on=["sheet_id"], a=at_point(F.col("cx"), F.col("cy")), b=b.padded(pad), cell=256.0, how=F.greatest(b.width, b.height) <= most)
    best = smallest(around, key=["sheet_id", "pos"], size=area(b), tie=[F.col("node")]).select("sheet_id", "pos", *b)
    p = seed.join(shuffled(best), ["sheet_id", "pos"], "left").select("sheet_id", "pos", "text", "cx", "cy", *(F.coalesce(n, f"w_{n}").alias(n) for n in Box._fields))
    usual = p.groupBy("sheet_id").agg(F.element_at(F.array_sort(F.collect_list(b.width)), F.floor(F.count("*") / 2).cast("int") + 1).alias("_med"))
    big = b.width > 2 * F.col("_med")
    p = p.join(shuffled(usual), "sheet_id").select("sheet_id", "pos", "text", "cx", "cy", F.when(big, F.col("cx") - F.col("_med") / 2).otherwise(b.x0).alias("x0"), "y0", F.when(big, F.col("cx") + F.col("_med") / 2).otherwise(b.x1).alias("x1"), "y1")
    text = words.select("sheet_id", F.col("pos").alias("ref"), center(b)[0].alias("wx"), center(b)[1].alias("wy"))
    reach = Box(F.col("cx") - beside, F.col("cy"), F.col("cx") + beside, F.col("cy") + below)
    near = grid_join(p.select("sheet_id", "pos", "cx", "cy"), text, on=["sheet_id"], a=reach, b=at_point(F.col("wx"), F.col("wy")), cell=200.0).where("ref <> pos")
    cost = F.abs(F.col("wy") - F.col("cy")) + 0.25 * F.abs(F.col("wx") - F.col("cx"))
    ref = smallest(near, key=["sheet_id", "pos"], size=cost, tie=[F.col("ref")]).select("sheet_id", "pos", "ref")
    return p.join(shuffled(ref), ["sheet_id", "pos"], "left").select("sheet_id", "pos", "text", *box(), "ref")
