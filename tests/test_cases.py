"""Small literal cases of the drawing operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetweave.functions import geometry as g
from sheetweave.functions import parsing as p
from sheetweave.functions import text as t
from sheetweave.operators import assign, graphs, metrics, raster, relations, spatial, tiling, tracing
from sheetweave.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def greedy_counts(spark, boxes, points):
    b = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(boxes)], "sheet_id long, node long, x0 double, y0 double, x1 double, y1 double")
    q = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "sheet_id long, rank long, px double, py double")
    return assign.first_free(spatial.points_in_boxes(q, b), rank="rank", choice="node").count()


@pytest.mark.parametrize(("points", "matched"), [([(5, 5), (25, 5), (45, 5)], 3), ([], 0), ([(5, 5), (25, 5)], 2), ([(5, 5), (6, 6)], 1)])
def test_greedy(spark, points, matched):
    assert greedy_counts(spark, [(0, 0, 10, 10), (20, 0, 30, 10), (40, 0, 50, 10)], points) == matched


def test_nested_boxes_match_once(spark):
    assert greedy_counts(spark, [(0, 0, 10, 10), (0, 0, 20, 20)], [(5, 5)]) == 1


def test_detection_of_empty_sheets(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (0, 2, 0)], "n_matched long, n_pred long, n_gt long")
    assert [(r["precision"], r["recall"]) for r in metrics.detection(rows).collect()] == [(1.0, 1.0), (0.0, 0.0), (0.0, 1.0)]


def test_stitch(spark):
    rows = [(0, "v", 0, 10.0, 10.0, 5.0), (0, "v", 1, 20.0, 10.0, 9.0), (0, "v", 2, 500.0, 10.0, None), (0, "w", 3, 11.0, 10.0, 1.0)]
    df = spark.createDataFrame(rows, "sheet_id long, cls string, pos long, px double, py double, conf double")
    assert sorted((r["cls"], r["pos"], r["n_members"]) for r in assign.anchor_clusters(df).collect()) == [("v", 1, 2), ("v", 2, 1), ("w", 3, 1)]


def test_distances_of_suppression(spark):
    df = spark.createDataFrame([(0, i, x, 0.0) for i, x in enumerate((0.0, 30.0, 60.0))], "sheet_id long, rank long, px double, py double")
    assert sorted(r["rank"] for r in assign.suppress(df, rank="rank", distance=30.0, strict=False).collect()) == [0, 2]
    assert sorted(r["rank"] for r in assign.suppress(df, rank="rank", distance=30.0, strict=True).collect()) == [0, 1, 2]


def test_points(spark):
    read = lambda s: one(spark, p.points(F.lit(s), 1000.0, 1000.0))
    ok = read('<points x coords="1 100 200 2 300 400"/>')
    assert not ok["parse_failed"] and [(q["x"], q["y"]) for q in ok["points"]] == [(100.0, 200.0), (300.0, 400.0)]
    assert [(q["x"], q["y"]) for q in read('<points a coords="1 1 100 200"/>')["points"]] == [(100.0, 200.0)]
    assert read('<points a coords="1 2"/>')["parse_failed"]
    assert read("<point>")["parse_failed"]
    assert not read("nothing here")["parse_failed"] and read("nothing here")["points"] == []


def test_json_locator(spark):
    read = lambda s: one(spark, p.json_text(F.lit(s)))
    assert read('```json\n{"a": 1}\n``` then ```\n[2]\n```') == "[2]"
    assert read('see [1, {"a": 2}] end') == '[1, {"a": 2}]'
    assert read('x {"a": [1]} y') == '{"a": [1]}'
    assert read("none") is None and read("} {") is None


def test_entity_verdicts(spark):
    read = lambda s: one(spark, p.entity_verdict(F.lit(s)))
    assert read('{"keep": true, "confidence": 0.75}')["confidence"] == 0.75
    assert read("Remove it")["keep"] is False
    assert read("keep or remove")["parse_failed"]


def test_salvage():
    assert p.balanced_objects('{"a": "}"} x {"b": {"c": 1}} {"d"') == ['{"a": "}"}', '{"b": {"c": 1}}']


def test_tags(spark):
    keep = lambda s: one(spark, t.kept_tag(F.lit(s)))
    assert keep("PSV-0300A") == "PSV0300A"
    assert [keep(s) for s in ('2"', '1-1/2" x 3"', "SET @ 5", "123456-7", "a", None)] == [None] * 6


def test_segment_through_box(spark):
    b = g.Box(*map(F.lit, (10.0, 10.0, 20.0, 20.0)))
    hit = lambda *s: one(spark, g.crosses(*(F.lit(float(x)) for x in s), b))
    assert hit(0, 15, 30, 15) and hit(15, 15, 15, 15) and hit(0, 10, 30, 10) and hit(0, 0, 15, 15)
    assert not hit(0, 9, 30, 9) and not hit(0, 15, 9, 15) and not hit(0, 25, 15, 21)


def test_chain_through_a_valve(spark):
    nodes = spark.createDataFrame([(0, i, c in "evE", c) for i, c in enumerate("evjvE")], "sheet_id long, node long, symbol boolean, cls string")
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(4)], "sheet_id long, a long, b long")
    assert sorted((r["a"], r["b"], r["hops"]) for r in graphs.symbol_paths(nodes, edges).collect()) == [(0, 1, 1), (1, 3, 2), (3, 4, 1)]
    through = graphs.symbol_paths(nodes, edges, passing=F.col("cls") == "v").collect()
    assert (0, 4, 4) in {(r["a"], r["b"], r["hops"]) for r in through}


def test_degree_two(spark):
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 3, 5)], "sheet_id long, a long, b long")
    symbols = spark.createDataFrame([(0, 0), (0, 4), (0, 5)], "sheet_id long, node long")
    assert sorted((r["a"], r["b"], r["n_edges"]) for r in graphs.degree_two_chains(edges, symbols).collect()) == [(0, 3, 3), (3, 4, 1), (3, 5, 1)]


def test_vector_page_graph(spark):
    symbols = spark.createDataFrame([(0, 1, 0.0, 0.0, 20.0, 20.0), (0, 2, 200.0, 0.0, 220.0, 20.0), (0, 3, 100.0, 200.0, 120.0, 220.0)], "sheet_id long, node long, x0 double, y0 double, x1 double, y1 double")
    lines = [(0, 0, 20.0, 10.0, 60.0, 10.0), (0, 1, 61.0, 10.0, 200.0, 10.0), (0, 2, 110.0, 11.0, 110.0, 200.0), (0, 3, 160.0, 11.0, 160.0, 90.0), (0, 4, 5.0, 5.0, 5.5, 5.0)]
    nodes, edges = graphs.vector_page_graph(spark.createDataFrame(lines, "sheet_id long, seg long, ax double, ay double, bx double, by double"), symbols)
    kinds = sorted(r["kind"] for r in nodes.collect())
    assert kinds == ["loose_end", "symbol", "symbol", "symbol", "tee", "tee"]
    assert sorted(r["n_edges"] for r in edges.collect()) == [1, 1, 1, 1, 2]
    paths = graphs.symbol_paths(nodes.select("sheet_id", "node", F.col("symbol").isNotNull().alias("symbol")), edges)
    assert sorted((r["a"], r["b"]) for r in paths.collect()) == [(1, 2), (1, 3), (2, 3)]


LINES = "sheet_id long, seg long, ax double, ay double, bx double, by double"


def test_page_graph_clips_and_bridges(spark):
    """A gap in a line is closed, one that is too long isn't, and a title block's line goes only where there are symbols enough to tell."""
    boxes = [(s, 10 * s + k, 300.0 * k, 0.0, 300.0 * k + 20, 20.0) for s, n in ((0, 8), (1, 7)) for k in range(n)]
    symbols = spark.createDataFrame(boxes, "sheet_id long, node long, x0 double, y0 double, x1 double, y1 double")
    lines = [(20.0, 10.0, 100.0, 10.0), (180.0, 10.0, 300.0, 10.0), (320.0, 10.0, 400.0, 10.0), (540.0, 10.0, 600.0, 10.0), (0.0, 900.0, 50.0, 900.0)]
    rows = spark.createDataFrame([(s, k, *xy) for s in (0, 1) for k, xy in enumerate(lines)], LINES)
    nodes, edges = graphs.vector_page_graph(rows, symbols)
    at = lambda s: sorted(r["n_edges"] for r in edges.where(f"sheet_id = {s}").collect())
    assert (at(0), at(1)) == ([1, 1, 3], [1, 1, 1, 3])
    paths = graphs.symbol_paths(nodes.select("sheet_id", "node", F.col("symbol").isNotNull().alias("symbol")), edges)
    assert sorted((r["a"], r["b"]) for r in paths.collect()) == [(0, 1), (10, 11)]
    _, apart = graphs.vector_page_graph(rows, symbols, clip=False, bridge=0)
    assert sorted(r["n_edges"] for r in apart.where("sheet_id = 0").collect()) == [1] * 5


def test_gap_bridges_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for seg in range(160):
        x, y, n = rng.randrange(0, 1200, 30), rng.randrange(0, 90, 30), rng.choice((3, 25, 50))
        rows.append((seg % 2, seg, float(x), float(y), float(x + n), float(y + rng.choice((0, 0, 1)))))
    want = set()
    for sheet in (0, 1):
        ends = []
        for _, seg, ax, ay, bx, by in (r for r in rows if r[0] == sheet):
            n = math.hypot(bx - ax, by - ay)
            ends += [(2 * seg, ax, ay, (ax - bx) / n, (ay - by) / n), (2 * seg + 1, bx, by, (bx - ax) / n, (by - ay) / n)]
        free = [e for e in ends if all(o is e or math.dist(e[1:3], o[1:3]) > 4 for o in ends)]
        used = set()
        for e in free:
            fit = []
            for o in free:
                d = math.dist(e[1:3], o[1:3])
                if e[0] // 2 != o[0] // 2 and not {e[0], o[0]} & used and 4 < d <= 130:
                    u = ((o[1] - e[1]) / d, (o[2] - e[2]) / d)
                    if e[3] * u[0] + e[4] * u[1] > 0.96 and -o[3] * u[0] - o[4] * u[1] > 0.96:
                        fit.append((round(d * d, 6), o[0]))
            if fit:
                used |= {e[0], min(fit)[1]}
                want.add((sheet, e[0], min(fit)[1]))
    assert len(want) > 10
    assert {(r["sheet_id"], r["i"], r["j"]) for r in graphs.gap_bridges(spark.createDataFrame(rows, LINES)).collect()} == want


def test_cycles(spark):
    rows = [(0, 1, 2, 5.0), (0, 2, 3, 1.0), (0, 3, 1, 9.0), (0, 4, 1, 1.0), (0, 5, 5, 1.0), (0, 6, 99, 1.0), (0, 7, None, 1.0)]
    got = {r["node"]: (r["parent"], r["cut"]) for r in assign.break_cycles(spark.createDataFrame(rows, "sheet_id long, node long, parent long, area double")).collect()}
    assert got == {1: (2, False), 2: (None, True), 3: (1, False), 4: (1, False), 5: (None, True), 6: (None, True), 7: (None, False)}


def test_relations_verdicts(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    far = (900.0, 900.0, 901.0, 901.0)
    nodes = spark.createDataFrame([(0, 1, "valve", False, *box), (0, 2, "equipment", False, *box), (0, 3, "equipment", False, *far), (0, 4, "port", True, *box), (0, 5, "port", True, *box), (0, 6, "valve", False, *box)], "sheet_id long, node long, cls string, terminal boolean, x0 double, y0 double, x1 double, y1 double")
    pairs = lambda *x: spark.createDataFrame([(0, *q) for q in x], "sheet_id long, a long, b long")
    paths = spark.createDataFrame([(0, 1, 3, 2), (0, 2, 3, 2), (0, 4, 5, 1), (0, 4, 2, 1), (0, 4, 3, 3), (0, 1, 6, 2), (0, 2, 1, 4)], "sheet_id long, a long, b long, n_segments long")
    got = {(r["a"], r["b"]): r["verdict"] for r in relations.build_relations(nodes, pairs((1, 6)), pairs((1, 2)), paths, children=("valve",), hosts=("equipment",), most_gap=100.0).collect()}
    assert got == {(1, 6): "kept", (1, 2): "kept", (1, 3): "single_host", (2, 3): "distance_cap", (4, 5): "terminal_pair", (2, 4): "kept", (3, 4): "far_terminal"}


def test_tiles(spark):
    tiles = tiling.tile_grid(spark.createDataFrame([(0, 1700, 900)], "sheet_id long, width int, height int")).collect()
    assert sorted((r["x0"], r["x1"], r["y0"], r["y1"]) for r in tiles) == [(0, 1024, 0, 900), (0, 1024, 819, 900), (819, 1700, 0, 900), (819, 1700, 819, 900), (1638, 1700, 0, 900), (1638, 1700, 819, 900)]


def test_graphml(spark, tmp_path):
    (tmp_path / "7.graphml").write_text("""<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d0" for="node" attr.name="label" attr.type="string"/><key id="d1" for="node" attr.name="xmin" attr.type="double"/><key id="d2" for="node" attr.name="ymin" attr.type="double"/><key id="d3" for="node" attr.name="xmax" attr.type="double"/><key id="d4" for="node" attr.name="ymax" attr.type="double"/><key id="d9" for="edge" attr.name="edge_label" attr.type="string"/>
<graph><node id="n1"><data key="d0">valve</data><data key="d1">1</data><data key="d2">2</data><data key="d3">3</data><data key="d4">4</data></node><node id="n2"><data key="d0">tank</data><data key="d1">x</data></node>
<edge source="n1" target="n2"><data key="d9">dashed</data></edge><edge source="n2" target="n1"/></graph></graphml>""")
    nodes, edges = readers.read_graphml(spark, str(tmp_path / "7.graphml"))
    assert [tuple(r) for r in nodes.collect()] == [("7", "n1", "valve", 1.0, 2.0, 3.0, 4.0)]
    assert sorted(tuple(r) for r in edges.collect()) == [("7", "n1", "n2", "dashed"), ("7", "n2", "n1", "solid")]
    assert not readers.graphml_accepted(nodes, 1)


def test_graphml_variants(spark, tmp_path):
    """Files read as they are, edges once between known ends, coordinates by pattern under either set of keys."""
    (tmp_path / "7.graphml").write_text("""<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d1" for="node" attr.name="xmin"/><key id="d2" for="node" attr.name="ymin"/><key id="d3" for="node" attr.name="xmax"/><key id="d4" for="node" attr.name="ymax"/>
<graph><node id="n1"><data key="d1">1</data><data key="d2">2</data><data key="d3">3</data><data key="d4">4</data></node><node id="n2"><data key="d1">1</data><data key="d2">2</data><data key="d3">3</data><data key="d4">4</data></node>
<edge source="n2" target="n1"/><edge source="n1" target="n2"/><edge source="n1" target="n9"/></graph></graphml>""")
    nodes, edges = readers.read_graphml(spark, str(tmp_path / "7.graphml"), no_class="", no_line="")
    assert {(r["node"], r["cls"]) for r in nodes.collect()} == {("n1", ""), ("n2", "")} and {r["line_type"] for r in edges.collect()} == {""}
    assert [tuple(r) for r in readers.linked_edges(nodes, edges).collect()] == [("7", "n1", "n2")]
    text = '<node id="a"><data key="d0">valve</data><data key="d5">0</data><data key="d6">2</data><data key="d7">4.5</data><data key="d8">4</data></node>\n<node id="b">\n<data key="d0">tank</data>\n<data key="d1">0</data><data key="d2">0</data><data key="d3">2</data><data key="d4">2</data></node><node id="c"><data key="d0">pump</data><data key="d1">0</data></node><node id="d"><data key="d1">0</data><data key="d2">0</data><data key="d3">2</data><data key="d4">2</data></node>'
    got = readers.graphml_centers(spark.createDataFrame([("7", text), ("8", None), ("9", "")], "sheet_id string, value string")).collect()
    assert sorted(map(tuple, got)) == [("7", "tank", 1.0, 1.0), ("7", "valve", 2.25, 3.0)]
    sinks.write_manifest(nodes.select("sheet_id", "node"), f"{tmp_path}/manifest")
    assert readers.read_records(spark, f"{tmp_path}/manifest", "sheet_id string, node string").count() >= 1


def test_non_maximum(spark):
    """Against the plain greedy rule."""
    rng = np.random.default_rng(5)
    rows = [(s, r, float(x), float(y), float(x + w), float(y + h)) for s in range(3) for r, (x, y, w, h) in enumerate(zip(*(rng.integers(lo, hi, 120) for lo, hi in ((-200, 200), (-200, 200), (20, 150), (20, 150))), strict=True))]
    got = {(r["sheet_id"], r["rank"]) for r in assign.non_maximum(spark.createDataFrame(rows, "sheet_id long, rank long, x0 double, y0 double, x1 double, y1 double")).collect()}
    want = []
    for s, r, *b in rows:
        def over(c, b=b):
            i = max(0, min(b[2], c[2]) - max(b[0], c[0])) * max(0, min(b[3], c[3]) - max(b[1], c[1]))
            return i / ((b[2] - b[0]) * (b[3] - b[1]) + (c[2] - c[0]) * (c[3] - c[1]) - i)

        if all(k[0] != s or over(k[2:]) < 0.5 for k in want):
            want.append((s, r, *b))
    assert got == {k[:2] for k in want} and len(got) < len(rows)


def test_files(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "s1.txt").write_text("3 0.5 0.5 0.2 0.1\nbad\n0 0.1 0.1 0.1 0.1\n")
    (tmp_path / "names.json").write_text(json.dumps({"0": "valve"}))
    boxes = readers.named(readers.read_yolo(spark, f"{tmp_path}/labels", 100, 200), readers.class_names(spark, f"{tmp_path}/names.json"))
    assert sorted((r["sheet_id"], r["cls"], round(r["x0"], 6), round(r["y1"], 6)) for r in boxes.collect()) == [("s1", "class_3", 40.0, 110.0), ("s1", "valve", 5.0, 30.0)]
    assert readers.class_names(spark, f"{tmp_path}/none.json").count() == 0
    assert {(r["folder"], r["ending"], r["n"]) for r in readers.tree(spark, f"{tmp_path}/labels").collect()} == {("labels", "txt", 1)}
    rec = spark.createDataFrame([("a", 1)], "arm string, n int")
    sinks.append_records(rec, f"{tmp_path}/log")
    sinks.append_records(rec, f"{tmp_path}/log")
    assert spark.read.csv(f"{tmp_path}/log", header=True).count() == 2
    sinks.write_splits(rec, f"{tmp_path}/split", F.lit("train"))
    assert spark.read.json(f"{tmp_path}/split").first()["split"] == "train"
    assert spark.read.parquet(sinks.write_stage(rec, str(tmp_path), "04", "j1")).count() == 1


def test_raster():
    page = np.full((60, 60), 255, np.uint8)
    page[28:33, 5:55] = 0
    ink = raster.binarize(page)
    assert ink[30, 30] == 1 and ink[5, 5] == 0
    thin = raster.skeleton(ink)
    assert thin.sum(0)[10:50].max() == 1 and thin.sum() > 40
    assert raster.binarize(np.full((40, 40), 200, np.uint8)).shape == (40, 40)


def test_no_nested_loops(spark):
    from sheetweave.plans.fixtures import Views

    v = Views(spark, "/root/testdata/sf0.001")
    plan = spatial.points_in_boxes(v.predd().drop("cls"), v.symd())._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_class_names_beyond_ten_thousand(spark):
    names = spark.range(20_000).selectExpr("cast(id as int) cls_id", "concat('n', id) cls")
    boxes = spark.createDataFrame([(5,), (10_500,), (19_999,), (20_001,)], "cls_id int")
    assert {r["cls_id"]: r["cls"] for r in readers.named(boxes, names).collect()} == {5: "n5", 10_500: "n10500", 19_999: "n19999", 20_001: "class_20001"}


def flood(mask):
    """Regions of touching pixels, pixel by pixel."""
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            y, x = todo.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = n
                todo += [(y + j, x + i) for i, j in tracing.AROUND]
    return out


def test_regions_by_brute_force():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        mask = rng.random((rng.integers(1, 25), rng.integers(1, 25))) < rng.random()
        assert (tracing.regions(mask) == flood(mask)).all()
    assert tracing.regions(np.zeros((3, 3), bool)).max() == 0


def test_neighbours_and_spread_by_brute_force():
    ink = np.random.default_rng(1).random((17, 23)) < 0.4
    near = lambda y, x, r: ink[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
    for y in range(17):
        for x in range(23):
            assert tracing.neighbours(ink)[y, x] == near(y, x, 1).sum() - ink[y, x]
            assert tracing._spread(ink, 3)[y, x] == near(y, x, 3).any()


def thin_page(*strokes):
    page = np.zeros((100, 160), np.uint8)
    for x0, y0, x1, y1 in strokes:
        page[y0 : y1 + 1, x0 : x1 + 1] = 1
    return page


def test_junctions():
    tee = thin_page((10, 50, 150, 50), (80, 50, 80, 95))
    assert [(j.kind, abs(j.x - 80) <= 1, abs(j.y - 50) <= 1) for j in tracing.junctions(tee)] == [("tee", True, True)]
    assert [j.kind for j in tracing.junctions(thin_page((10, 50, 150, 50), (80, 5, 80, 95)))] == ["cross"]
    assert tracing.junctions(thin_page((10, 50, 80, 50), (80, 50, 80, 95))) == []  # a bend
    star = thin_page((10, 50, 150, 50), (80, 5, 80, 95))
    for k in range(40):
        star[50 + k, 80 + k] = 1
    assert [j.kind for j in tracing.junctions(star)] == ["joint"]
    assert tracing.junctions(np.zeros((9, 9), np.uint8)) == []


def test_polylines():
    bend = thin_page((10, 50, 80, 50), (80, 50, 80, 95))
    assert tracing.polylines(bend, []) == [[(10, 50), (79, 50), (80, 95)]]  # the shortest way cuts the corner
    cross = thin_page((10, 50, 150, 50), (80, 5, 80, 95))
    assert sorted(map(sorted, tracing.polylines(cross, [(80, 50)]))) == [[(10, 50), (74, 50)], [(80, 5), (80, 44)], [(80, 56), (80, 95)], [(86, 50), (150, 50)]]
    ring = thin_page((20, 20, 60, 20), (20, 60, 60, 60), (20, 20, 20, 60), (60, 20, 60, 60))
    ring[20, 20] = ring[20, 60] = ring[60, 20] = ring[60, 60] = 0
    assert tracing.polylines(ring, []) == []
    assert tracing.polylines(thin_page((5, 5, 5, 5)), []) == []
    points = [(x, round(8 * np.sin(x / 9))) for x in range(120)]
    kept = tracing.simplified(points, 2.0)
    for p in points:  # no point is further than the tolerance from the line that is left
        gaps = []
        for a, b in zip(kept, kept[1:], strict=False):
            d, r = np.subtract(b, a), np.subtract(p, a)
            gaps.append(np.hypot(*(r - np.clip(r @ d / (d @ d), 0, 1) * d)))
        assert min(gaps) <= 2.0
    assert kept[0] == points[0] and kept[-1] == points[-1] and len(kept) < 30


def test_bridged():
    line = lambda *points: tracing.Line(list(points), [])
    box = np.array([[40, 40, 60, 60]])
    assert tracing.bridged([line((0, 50), (35, 50)), line((100, 50), (65, 50))], box, [7]) == [([(0, 50), (35, 50), (65, 50), (100, 50)], [7])]
    apart = [line((0, 45), (35, 45)), line((0, 55), (35, 55))]  # both from the left
    assert tracing.bridged(apart, box, [7]) == apart
    away = [line((0, 50), (5, 50)), line((65, 50), (100, 50))]
    assert tracing.bridged(away, box, [7], gap=30) == away
    two = [line((0, 50), (35, 50)), line((65, 50), (95, 50)), line((125, 50), (160, 50))]
    assert tracing.bridged(two, np.array([[40, 40, 60, 60], [100, 40, 120, 60]]), [7, 9]) == [([(0, 50), (35, 50), (65, 50), (95, 50), (125, 50), (160, 50)], [7, 9])]
    assert tracing.bridged([], box, [7]) == [] and tracing.bridged(two, np.zeros((0, 4), int), []) == two


def test_joined():
    line = lambda *points: tracing.Line(list(points), [])
    dashes = [line((x, 10), (x + 12, 10)) for x in range(0, 200, 20)]
    got = tracing.joined(dashes, [])
    assert len(got) == 1 and sorted({got[0].points[0], got[0].points[-1]}) == [(0, 10), (192, 10)] and len(got[0].points) == 20
    assert len(tracing.joined(dashes[:2], [(16, 12)])) == 2  # a junction is in the gap
    assert len(tracing.joined([line((0, 0), (30, 0)), line((34, 0), (34, 30))], [])) == 2  # a bend
    assert len(tracing.joined([line((0, 0), (30, 0)), line((70, 0), (90, 0))], [])) == 2  # too far
    assert tracing.joined([line((0, 0), (30, 0)), line((30, 0), (60, 0))], [])[0].points == [(0, 0), (30, 0), (60, 0)]
    assert len(tracing.joined([line((0, 0), (30, 0)), line((50, 12), (80, 12))], [])) == 2  # beside each other
    assert tracing.joined([], []) == []


def test_close_pairs_by_brute_force():
    at = np.random.default_rng(2).integers(-60, 200, (80, 2)).astype(float)
    a, b = tracing._close_pairs(at, 36.0)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(80) for j in range(80) if i != j and np.hypot(*(at[i] - at[j])) <= 36]


def test_strokes():
    page = np.full((20, 300), 255, np.uint8)
    page[5] = 0
    page[8, np.arange(300) // 12 % 2 == 0] = 0
    page[11, np.arange(300) % 15 < 3] = 0
    style = lambda y: tracing.stroke([(0, y), (299, y)], page)[0]
    assert [style(y) for y in (5, 8, 11, 14)] == ["continuous", "dashed", "dotted", "unknown"]
    assert tracing.LINE_TYPES[style(8)] == "electric_signal"


def test_enhance():
    page = np.array([[50, 100], [150, 200]], np.uint8)
    assert tracing.autocontrast(page).tolist() == [[0, 85], [170, 255]]
    assert tracing.autocontrast(np.full((2, 2), 9, np.uint8)).tolist() == [[9, 9], [9, 9]]
    assert (tracing.upscaled(np.full((5, 7), 90, np.uint8), 2) == np.full((10, 14), 90)).all()
    ramp = tracing.upscaled(np.tile(np.arange(0, 200, 10, dtype=np.uint8), (8, 1)), 2)
    assert ramp.shape == (16, 40) and (np.diff(ramp[8].astype(int))[8:-8] > 0).all()
    assert (tracing.upscaled(page, 1) == page).all()


def test_page_graph(spark):
    """Two symbols on a pipe with a valve between them and a branch; a null and an empty page give nothing."""
    page = np.full((300, 600), 255, np.uint8)
    page[149:152, 60:560] = 0
    page[150:290, 399:402] = 0
    boxes = [(1, 40, 130, 80, 170), (2, 220, 135, 250, 165), (3, 540, 130, 580, 170)]
    for _, x0, y0, x1, y1 in boxes:
        page[y0:y1, x0:x1] = 0
    pages = spark.createDataFrame([(1, 600, 300, bytearray(page.tobytes())), (2, 0, 0, bytearray()), (3, None, None, None), (4, 600, 300, bytearray(page.tobytes()))], "sheet_id long, width int, height int, grey binary")
    symbols = spark.createDataFrame([(1, i, *map(float, b)) for i, *b in boxes], "sheet_id long, node long, x0 double, y0 double, x1 double, y1 double")
    rows = tracing.trace_pages(pages, symbols, symbols.where("node < 0")).collect()
    of = lambda sheet, part: [r for r in rows if r["sheet_id"] == sheet and r["part"] == part]
    assert [(r["kind"], r["ambiguous"]) for r in of(1, "junction")] == [("tee", False)]
    ends = {tuple(sorted([(r["a_kind"], r["a_ref"]), (r["b_kind"], r["b_ref"])], key=str)) for r in of(1, "segment")}
    assert ends == {(("junction", 0), ("symbol", 1)), (("junction", 0), ("symbol", 3)), (("junction", 0), ("loose_end", None))}
    assert [r["through"] for r in of(1, "segment") if r["through"]] == [[2]]
    assert {r["line_type"] for r in of(1, "segment")} == {"process"}
    assert {r["sheet_id"] for r in rows} <= {1, 4}
    assert tracing.trace_pages(pages.where("sheet_id > 9"), symbols).count() == 0
    assert [(r["sheet_id"], r["width"], r["height"]) for r in tracing.enhanced(pages.where("sheet_id < 4"), 2.0).collect()] == [(1, 1200, 600)]
    alone = {(r["x"], r["y"]) for r in tracing.thinned(pages.where("sheet_id = 1")).collect()}
    y, x = np.nonzero(raster.skeleton(raster.binarize(page)))
    assert alone == set(zip(x.tolist(), y.tolist(), strict=True))
