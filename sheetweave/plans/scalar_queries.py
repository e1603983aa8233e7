"""Queries over projections, text and parsing functions, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions import parsing as p
from sheetweave.functions import text as t
from sheetweave.functions.geometry import Box, box
from sheetweave.operators.spatial import diagram_area
from sheetweave.plans.fixtures import Views, issues_of, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def bind() -> None:
    """Columns need a running session, so these names get theirs when a query runs."""
    global n, b, other, cx, cy, inner, far, line, corner, outside, wide, flat, joined, tag, cls, said, kind, name, page, ans, tb, ev, rv, pts, strict, lenient, first  # noqa: PLW0603
    n = F.col("node")
    b = box()
    #: A second box for each symbol: itself moved, so that some overlap.
    other = Box(b.x0 + n % 30 - 10, b.y0 + n % 50 - 20, b.x1 + n % 30 - 10, b.y1 + n % 50 - 20)
    cx, cy = g.center(b)
    far = Box(b.x0 + 100, b.y0 + n % 90, b.x1 + 100, b.y1 + n % 90)
    inner = Box(b.x0 - n % 7, b.y0 - n % 5, b.x1 - n % 11, b.y1 + n % 4)
    line = (cx, cy, F.lit(0.0), F.lit(0.0), (n % 9 * 100).cast("double"), F.lit(0.0))
    corner = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1))))
    outside = F.coalesce(~g.inside(F.col("wx"), F.col("wy"), Box(*map(F.col, ("ax0", "ay0", "ax1", "ay1")))), F.lit(False))
    wide = b.padded(150.0)
    flat = Box(b.x0, b.y0, b.x1 + n % 90, b.y1)
    joined = g.union_box(b, other, 40.0, 4200.0, 3200.0)
    tag, cls = F.col("tag"), F.col("cls")
    said = F.when(n % 5 == 0, F.lit('2"')).when(n % 5 == 1, F.concat(tag, F.lit(" SET @ 3"))).when(n % 5 == 2, F.lit("12345-6")).when(n % 5 == 3, F.lit("a")).otherwise(tag)
    kind = t.mapped(cls, t.AGENT_TYPES, "other")
    name = F.concat(F.lit("model-"), F.when(n % 3 == 0, "5-low").when(n % 3 == 1, "5-xhigh").otherwise("8"))
    page = F.element_at(F.array(*map(F.lit, ("PID_DRAWING", "LEGEND", "COVER"))), (n % 3).cast("int") + 1)
    ans = F.col("text")
    tb = p.title_block(F.when(n % 3 == 0, F.format_string('{"drawing_number": "D-%d", "title": null}', n)).when(n % 3 == 1, F.lit('{"site": ""}')).otherwise(F.lit("none")))
    ev, rv = p.entity_verdict(ans), p.relation_verdict(ans)
    pts = p.points(ans, 1024.0, 512.0)
    strict, lenient = p.boxes(ans), p.boxes(ans, strict=False)
    first = F.try_element_at(strict["boxes"], F.lit(1))


def add(name: str, run: Callable[[Views], DataFrame], check: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bind()
        return run(Views(spark, sf_dir, issues_of(check)))

    QUERIES[name] = query
    if check:
        SQL[name] = check


def on_sym(name: str, columns: Callable[[], dict[str, Column]], expressions: dict[str, str], dense: bool = False) -> None:
    view = "symd" if dense else "sym"
    add(name, lambda v: getattr(v, view)().select("node", *(c.alias(k) for k, c in columns().items())), sql(f"SELECT node, {', '.join(f'{e} AS {k}' for k, e in expressions.items())} FROM {view}", view))


OTHER = {"x0": "(x0 + node % 30 - 10)", "y0": "(y0 + node % 50 - 20)", "x1": "(x1 + node % 30 - 10)", "y1": "(y1 + node % 50 - 20)"}

on_sym("GEO_01_center", lambda: {"cx": cx, "cy": cy}, {"cx": "(x0 + x1) / 2", "cy": "(y0 + y1) / 2"})
on_sym("GEO_02_area", lambda: {"area": g.area(b)}, {"area": "greatest(0, x1 - x0) * greatest(0, y1 - y0)"})
INTER = f"(greatest(0, least(x1, {OTHER['x1']}) - greatest(x0, {OTHER['x0']})) * greatest(0, least(y1, {OTHER['y1']}) - greatest(y0, {OTHER['y0']})))"
on_sym("GEO_03_iou", lambda: {"iou": g.iou(b, other)}, {"iou": f"{INTER} / (2 * (x1 - x0) * (y1 - y0) - {INTER})"})
on_sym("GEO_04_gap", lambda: {"gap": g.gap(b, far)}, {"gap": "sqrt(pow(greatest(0, x0 + 100 - x1), 2) + pow(greatest(0, y0 + node % 90 - y1), 2))"})
on_sym("GEO_05_point_in_box", lambda: {"hit": g.inside(b.x0 + n % 70, b.y0 + n % 60, b)}, {"hit": "x0 + node % 70 <= x1 AND y0 + node % 60 <= y1"})
on_sym("GEO_06_boxes_intersect", lambda: {"hit": g.intersect(b, other)}, {"hit": f"x0 < {OTHER['x1']} AND {OTHER['x0']} < x1 AND y0 < {OTHER['y1']} AND {OTHER['y0']} < y1"})
on_sym("GEO_07_contained", lambda: {"hit": g.contained(inner, b)}, {"hit": "node % 7 <= 0.05 * greatest(1, x1 - x0) AND node % 5 <= 0.05 * greatest(1, y1 - y0) AND node % 4 <= 0.05 * greatest(1, y1 - y0)"})
on_sym("GEO_08_distance", lambda: {"d2": g.distance2(cx, cy, n % 500 * 1.0, n % 300 * 1.0), "d": F.sqrt(g.distance2(cx, cy, n % 500 * 1.0, n % 300 * 1.0))}, {"d2": "((x0 + x1) / 2 - node % 500) * ((x0 + x1) / 2 - node % 500) + ((y0 + y1) / 2 - node % 300) * ((y0 + y1) / 2 - node % 300)", "d": "sqrt(((x0 + x1) / 2 - node % 500) * ((x0 + x1) / 2 - node % 500) + ((y0 + y1) / 2 - node % 300) * ((y0 + y1) / 2 - node % 300))"})
T_ = "coalesce(((x0 + x1) / 2 * (node % 9 * 100)) / nullif(CAST(node % 9 * 100 * (node % 9 * 100) AS DOUBLE), 0), 0)"
on_sym("GEO_09_point_segment", lambda: {"t": g.foot(*line), "far": g.segment_distance(*line) > 2000}, {"t": T_, "far": f"sqrt(pow((x0 + x1) / 2 - greatest(0, least(1, {T_})) * (node % 9 * 100), 2) + pow((y0 + y1) / 2, 2)) > 2000"})
on_sym("GEO_10_segment_rect", lambda: {"vertical": g.crosses(b.x0 + n % 90, F.lit(0.0), b.x0 + n % 90, F.lit(1500.0), b), "level": g.crosses(F.lit(0.0), b.y0, F.lit(2000.0), b.y0, b)}, {"vertical": "x0 + node % 90 <= x1 AND y0 <= 1500", "level": "x0 <= 2000"})
on_sym("GEO_11_polyline", lambda: {"length": g.polyline_length(corner), "turn": g.angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))}, {"length": "(x1 - x0) + (y1 - y0)", "turn": "CAST(90 AS DOUBLE)"})
add("GEO_12_segment_length", lambda v: v.edge().where(F.hypot((F.col("b") - F.col("a")).cast("double"), F.lit(0.5)) > 1.0).groupBy("sheet_id").agg(F.count("*").alias("kept")), sql("SELECT sheet_id, count(*) AS kept FROM edge WHERE sqrt(pow(b - a, 2) + 0.25) > 1 GROUP BY sheet_id", "edge"))
add("GEO_13_percentile", lambda v: v.sym().groupBy("sheet_id").agg(F.percentile("x0", 0.25).alias("p25"), F.percentile("y0", 0.9).alias("p90")), sql("SELECT sheet_id, quantile_cont(x0, 0.25) AS p25, quantile_cont(y0, 0.9) AS p90 FROM sym GROUP BY sheet_id", "sym"))


AREA = "SELECT sheet_id, CASE WHEN count(*) >= 8 THEN min((x0 + x1) / 2) - 126 END AS ax0, CASE WHEN count(*) >= 8 THEN min((y0 + y1) / 2) - 126 END AS ay0, CASE WHEN count(*) >= 8 THEN max((x0 + x1) / 2) + 126 END AS ax1, CASE WHEN count(*) >= 8 THEN max((y0 + y1) / 2) + 126 END AS ay1"
add("GEO_14_diagram_area", lambda v: diagram_area(v.sym(), 4200.0), sql(f"{AREA} FROM sym GROUP BY sheet_id", "sym"))
add("GEO_15_outside_area", lambda v: v.word().select("sheet_id", "pos", (cx + F.col("pos") % 900).alias("wx"), cy.alias("wy")).join(diagram_area(v.sym(), 4200.0), "sheet_id").groupBy("sheet_id").agg(F.count_if(outside).alias("n_outside")), sql(f"AND a AS ({AREA} FROM sym GROUP BY sheet_id) SELECT sheet_id, count(*) FILTER (WHERE NOT ((x0 + x1) / 2 + pos % 900 BETWEEN ax0 AND ax1 AND (y0 + y1) / 2 BETWEEN ay0 AND ay1)) AS n_outside FROM word JOIN a USING (sheet_id) GROUP BY sheet_id", "word"))
on_sym("GEO_16_tile_to_sheet", lambda: dict(zip(("sx0", "sy0", "sx1", "sy1"), b.shifted(n % 5 * 819, n % 4 * 819), strict=True)), {"sx0": "x0 + node % 5 * 819", "sy0": "y0 + node % 4 * 819", "sx1": "x1 + node % 5 * 819", "sy1": "y1 + node % 4 * 819"})
on_sym("GEO_17_undo_upscale", lambda: {"ux": b.x0 / 2 + n % 5 * 819, "uy": b.y0 / 2 + n % 4 * 819}, {"ux": "x0 / 2 + node % 5 * 819", "uy": "y0 / 2 + node % 4 * 819"})
on_sym("GEO_18_xywh", lambda: {"x": (b.x0 + 0.75).cast("int"), "y": (b.y0 + 0.25).cast("int"), "w": b.width.cast("int"), "h": b.height.cast("int")}, {"x": "CAST(trunc(x0 + 0.75) AS INTEGER)", "y": "CAST(trunc(y0 + 0.25) AS INTEGER)", "w": "CAST(x1 - x0 AS INTEGER)", "h": "CAST(y1 - y0 AS INTEGER)"})
on_sym("GEO_19_normalise", lambda: {"fx": cx / 4200, "fy": cy / 3200, "k": F.bround(b.x0 / 4096 * 1000).cast("long")}, {"fx": "(x0 + x1) / 2 / 4200", "fy": "(y0 + y1) / 2 / 3200", "k": "CAST(round_even(x0 / 4096 * 1000, 0) AS BIGINT)"})
add("GEO_20_inflate_equipment", lambda v: v.sym().where("cls <> 'connector'").select("node", *(F.when(F.col("cls").isin("tank", "general"), w).otherwise(o).alias(k) for k, w, o in zip(Box._fields, wide, b, strict=True))), sql("SELECT node, x0 - p AS x0, y0 - p AS y0, x1 + p AS x1, y1 + p AS y1 FROM (SELECT *, CASE WHEN cls IN ('tank', 'general') THEN 150 ELSE 0 END AS p FROM sym WHERE cls <> 'connector')", "sym"))
on_sym("GEO_21_text_shaped", lambda: {"flat": g.text_shaped(flat)}, {"flat": "y1 - y0 < 35 AND (x1 + node % 90 - x0) / (y1 - y0) >= 2.5"})
on_sym("GEO_22_margins", lambda: {"zone": g.margin(b, F.lit(4200.0), F.lit(3200.0))}, {"zone": "CASE WHEN (x0 + x1) / 2 < 0.16 * 4200 OR (x0 + x1) / 2 > 0.84 * 4200 THEN 'side' WHEN (y0 + y1) / 2 < 0.1 * 3200 OR (y0 + y1) / 2 > 0.9 * 3200 THEN 'edge' ELSE 'body' END"})
on_sym("GEO_23_union_box", lambda: {**dict(zip(("ux0", "uy0", "ux1", "uy1"), joined, strict=True)), "fits": F.greatest(joined.width, joined.height) <= 140}, {"ux0": f"greatest(0, least(x0, {OTHER['x0']}) - 40)", "uy0": f"greatest(0, least(y0, {OTHER['y0']}) - 40)", "ux1": f"least(4200, greatest(x1, {OTHER['x1']}) + 40)", "uy1": f"least(3200, greatest(y1, {OTHER['y1']}) + 40)", "fits": f"greatest(least(4200, greatest(x1, {OTHER['x1']}) + 40) - greatest(0, least(x0, {OTHER['x0']}) - 40), least(3200, greatest(y1, {OTHER['y1']}) + 40) - greatest(0, least(y0, {OTHER['y0']}) - 40)) <= 140"})
on_sym("GEO_24_downscale", lambda: {"k": g.downscale(b.x1, b.y1, 1024.0), "sx": (b.x0 * g.downscale(b.x1, b.y1, 1024.0)).cast("int")}, {"k": "least(1, 1024 / greatest(x1, y1))", "sx": "CAST(trunc(x0 * least(1, 1024 / greatest(x1, y1))) AS INTEGER)"})

ALNUM = "regexp_replace(upper(tag), '[^A-Z0-9]', '', 'g')"
on_sym("STR_01_alnum", lambda: {"a": t.alnum(tag)}, {"a": ALNUM})
SAID = "CASE node % 5 WHEN 0 THEN '2\"' WHEN 1 THEN tag || ' SET @ 3' WHEN 2 THEN '12345-6' WHEN 3 THEN 'a' ELSE tag END"
on_sym("STR_02_tag_filter", lambda: {"kept": t.kept_tag(said)}, {"kept": f"CASE node % 5 WHEN 4 THEN {ALNUM} END"})
on_sym("STR_03_series", lambda: {"series": t.series(tag)}, {"series": "nullif(regexp_extract(tag, '([0-9]{3,4})', 1), '')"})
ktype = "CASE cls WHEN 'valve' THEN 'valve' WHEN 'instrumentation' THEN 'instrument' WHEN 'tank' THEN 'equipment' WHEN 'pump' THEN 'equipment' WHEN 'general' THEN 'equipment' ELSE 'other' END"
on_sym("STR_04_series_disagree", lambda: {"off": t.series_disagree(tag, kind, F.concat(F.lit("PBA-0"), (n % 1000 - n % 2).cast("string"), F.lit("00")), F.lit("equipment"))}, {"off": f"({ktype} IN ('valve', 'instrument')) AND coalesce(regexp_extract(tag, '([0-9]{{3,4}})', 1) <> nullif(regexp_extract('PBA-0' || (node % 1000 - node % 2) || '00', '([0-9]{{3,4}})', 1), ''), false)"})
on_sym("STR_05_field_norm", lambda: {"f": t.field_norm(F.concat(F.lit("  A b "), tag, F.lit(" ")))}, {"f": "replace(lower(trim('  A b ' || tag || ' ')), ' ', '')"})
add("STR_06_token_overlap", lambda v: v.table("benchmark").select("item_id", t.token_overlap(F.substr("text", F.lit(1), F.lit(200)), F.col("text")).alias("overlap")), "SELECT item_id, len(list_intersect(p, q)) / len(q) AS overlap FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(substr(text, 1, 200)), '[a-z0-9]+')) AS p, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark)")
on_sym("STR_07_title_case", lambda: {"name": t.title_case(F.concat(cls, F.lit("_of_line")))}, {"name": "upper(cls[1]) || cls[2:] || ' Of Line'"})
on_sym("STR_08_ids", lambda: {"id": t.temp_id(F.col("sheet_id"), n % 10000), "rel": t.temp_id(F.col("sheet_id"), n % 10000, "r"), "none": t.temp_id(F.lit(-1), n)}, {"id": "printf('p%d_e%04d', sheet_id, node % 10000)", "rel": "printf('p%d_r%04d', sheet_id, node % 10000)", "none": "NULL"})
on_sym("STR_09_model_effort", lambda: dict(zip(("model", "effort"), t.model_effort(name), strict=True)), {"model": "CASE WHEN node % 3 = 2 THEN 'model-8' ELSE 'model-5' END", "effort": "CASE node % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'xhigh' END"})
on_sym("STR_10_trailing_tag", lambda: {"tag_": t.trailing_tag(F.when(n % 2 == 0, F.concat(F.lit("Pump ("), tag, F.lit(") "))).otherwise(tag))}, {"tag_": "tag"})
on_sym("STR_11_confusion", lambda: {"bad": t.confuse(tag, F.lit(1) + (n % 2).cast("int"))}, {"bad": "tag[1:1 + node % 2] || CASE tag[2 + node % 2] WHEN 'B' THEN '8' WHEN 'O' THEN '0' WHEN 'I' THEN '1' WHEN '0' THEN '8' WHEN '1' THEN '7' WHEN '5' THEN '6' WHEN 'X' THEN 'Y' ELSE 'X' END || tag[3 + node % 2:]"})
on_sym("STR_12_degenerate", lambda: {"bad": t.degenerate(F.array_join(F.array_repeat(tag, (n % 20).cast("int")), " "))}, {"bad": "node % 20 > 8"})
add("STR_15_tag_list", lambda v: v.word().groupBy("sheet_id").agg(F.array_join(t.tag_list(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("text"), F.lit(" x ok")))), " ")), ",").alias("tags")), sql("SELECT sheet_id, string_agg(text, ',' ORDER BY text) AS tags FROM (SELECT DISTINCT sheet_id, text FROM word) GROUP BY sheet_id", "word"))
on_sym("MAP_01_vocabulary", lambda: {"kind": kind}, {"kind": ktype})
add("FLT_01_equipment", lambda v: v.sym().where(cls.isin("valve", "instrumentation", "tank", "pump", "general", "inlet/outlet")).select("node"), sql("SELECT node FROM sym WHERE cls IN ('valve', 'instrumentation', 'tank', 'pump', 'general', 'inlet/outlet')", "sym"))
add("FLT_02_connectivity", lambda v: v.claim().where(F.col("kind").isin("feeds", "relieves_to", "actuates", "signal_to") & (F.col("a") != F.col("b"))).select("sheet_id", "kind", "a", "b"), sql("SELECT sheet_id, kind, a, b FROM claim WHERE kind IN ('feeds', 'relieves_to', 'actuates', 'signal_to') AND a <> b", "claim"))
on_sym("FLT_03_page_gate", lambda: {"processed": page.isin("PID_DRAWING", "LEGEND")}, {"processed": "node % 3 < 2"})
on_sym("FLT_04_payload", lambda: {"value": F.coalesce(F.nullif(F.when(n % 3 == 0, "").otherwise(tag), F.lit("")), cls), "confidence": F.coalesce(F.when(n % 2 == 0, 0.9), F.lit(0.7))}, {"value": "CASE WHEN node % 3 = 0 THEN cls ELSE tag END", "confidence": "CAST(CASE WHEN node % 2 = 0 THEN 0.9 ELSE 0.7 END AS DOUBLE)"})


def words_near(v: Views) -> DataFrame:
    """STR-13: lines of recognised words as a prompt shows them."""
    w = v.word()
    text = F.format_string("[p%d_w%d] '%s' bbox=[%d,%d,%d,%d]", F.col("sheet_id"), F.col("pos"), F.col("text"), *(F.col(c).cast("long") for c in Box._fields))
    lines = F.array_sort(F.collect_list(F.struct("pos", text.alias("line"))))
    return w.groupBy("sheet_id").agg(F.array_join(F.transform(F.slice(lines, 1, 20), lambda s: s["line"]), "\n").alias("block"))


add("STR_13_word_lines", words_near, sql("SELECT sheet_id, string_agg(line, chr(10) ORDER BY pos) AS block FROM (SELECT sheet_id, pos, printf('[p%d_w%d] ''%s'' bbox=[%d,%d,%d,%d]', sheet_id, pos, text, CAST(x0 AS BIGINT), CAST(y0 AS BIGINT), CAST(x1 AS BIGINT), CAST(y1 AS BIGINT)) AS line, row_number() OVER (PARTITION BY sheet_id ORDER BY pos) AS r FROM word) WHERE r <= 20 GROUP BY sheet_id", "word"))



def on_answer(name: str, columns: Callable[[], dict[str, Column]], expressions: dict[str, str]) -> None:
    add(name, lambda v: v.answer().select("node", *(c.alias(k) for k, c in columns().items())), sql(f"SELECT node, {', '.join(f'{e} AS {k}' for k, e in expressions.items())} FROM answer", "answer"))


on_answer("PRS_01_json_text", lambda: {"json": p.json_text(ans)}, {"json": "CASE node % 5 WHEN 0 THEN '{' || split_part(split_part(text, '{', 2), '}', 1) || '}' WHEN 4 THEN text END"})
on_answer("PRS_02_json_span", lambda: {"json": p.json_span(ans)}, {"json": "CASE node % 5 WHEN 0 THEN '{' || split_part(split_part(text, '{', 2), '}', 1) || '}' END"})
on_answer("PRS_03_safe_json", lambda: {"ok": p.json_value(ans).isNotNull()}, {"ok": "node % 5 = 0"})
on_answer("PRS_04_title_block", lambda: {"located": tb["located"], "number": tb["drawing_number"], "failed": tb["parse_failed"]}, {"located": "node % 3 = 0", "number": "CASE WHEN node % 3 = 0 THEN 'D-' || node END", "failed": "node % 3 = 2"})
on_answer("PRS_06_entity_verdict", lambda: {"keep": ev["keep"], "confidence": ev["confidence"], "failed": ev["parse_failed"]}, {"keep": "CASE node % 5 WHEN 0 THEN node % 2 = 0 WHEN 1 THEN false END", "confidence": "CAST(CASE WHEN node % 5 < 2 THEN 0.5 END AS DOUBLE)", "failed": "node % 5 >= 2"})
on_answer("PRS_07_relation_verdict", lambda: {"verdict": rv["verdict"], "confidence": rv["confidence"], "failed": rv["parse_failed"]}, {"verdict": "CASE node % 5 WHEN 0 THEN CASE WHEN node % 3 = 0 THEN 'confirmed' ELSE 'rejected' END WHEN 1 THEN 'rejected' WHEN 2 THEN 'confirmed' END", "confidence": "CAST(CASE node % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 WHEN 2 THEN 0.75 END AS DOUBLE)", "failed": "node % 5 >= 3"})
on_answer("PRS_08_points", lambda: {"failed": pts["parse_failed"], "n": F.size(pts["points"]), "x": F.try_element_at(pts["points"], F.lit(1))["x"], "y": F.try_element_at(pts["points"], F.lit(2))["y"]}, {"failed": "false", "n": "CASE WHEN node % 5 = 3 THEN 2 ELSE 0 END", "x": "CASE WHEN node % 5 = 3 THEN CAST(node % 1000 AS DOUBLE) / 1000 * 1024 END", "y": "CASE WHEN node % 5 = 3 THEN CAST(node * 7 % 1000 AS DOUBLE) / 1000 * 512 END"})
on_answer("PRS_09_boxes", lambda: {"failed": strict["parse_failed"], "x0": F.try_element_at(first, F.lit(1)), "conf": F.try_element_at(first, F.lit(6)).cast("double")}, {"failed": "node % 5 <> 4", "x0": "CASE WHEN node % 5 = 4 THEN CAST(node % 50 AS VARCHAR) END", "conf": "CAST(CASE WHEN node % 5 = 4 THEN 0.9 END AS DOUBLE)"})
on_answer("PRS_10_boxes_lenient", lambda: {"n": F.size(lenient["boxes"])}, {"n": "CASE WHEN node % 5 = 4 THEN 1 END"})
on_answer("PRS_14_polarity", lambda: {"say": p.polarity(F.when(n % 4 == 0, "Yes, it is").when(n % 4 == 1, "ANSWER: NO").when(n % 4 == 2, "B. the second").otherwise("maybe"))}, {"say": "CASE node % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'no' END"})
on_answer("PRS_11_salvage", lambda: {"n": F.size(p.salvage(F.format_string('{"tags": [{"a": "}%d"}, {"b": {"c": 2}}, {"d": ', n)))}, {"n": "2"})
add("PRS_18_parse_rate", lambda v: v.answer().select("sheet_id", (~p.entity_verdict(ans)["parse_failed"]).alias("ok")).groupBy("sheet_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), (F.avg(F.col("ok").cast("int")) >= 0.95).alias("passed")), sql("SELECT sheet_id, count(*) AS n, count(*) FILTER (WHERE node % 5 < 2) AS n_ok, false AS passed FROM answer GROUP BY sheet_id", "answer"))
