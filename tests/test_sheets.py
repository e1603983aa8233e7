"""Joins that broadcast nothing by estimate, and steps over whole sheets against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sheetweave.operators import assign, graphs, raster, sheets, spatial
from sheetweave.plans import registry

SMALL = "/root/testdata/sf0.001"
GROWN = """JOI_11_seed_extent JOI_15_junction_symbol JOI_26_negative_boxes GRF_19_worklist GRF_20_agreement_sets AGG_04_topology AGG_05_06_micro_average
    CLU_01_stitch GRF_01_contraction_a GRF_02_contraction_b GRF_04_endpoint_merge AGG_01_detection AGG_02_average_precision CLU_04_tile_nms AGG_29_config_run
    GRF_08_symbol_paths GRF_09_topology JOI_01_point_in_box_greedy JOI_01_candidates GRF_06_vector_page_graph GRF_12_relations JOI_03_iou_best_first
    JOI_03_iou_candidates JOI_02_ranked_greedy GRF_05_degree_two GRF_14_break_cycles JOI_25_bridges""".split()


def broadcasts(spark, after=-1):
    """(last execution, rows of the broadcasts of those after one)."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsList()
    ids = [done.apply(i).executionId() for i in range(done.size())]
    counts = []
    for k in ids:
        nodes = store.planGraph(k).allNodes() if k > after else None
        for node in (nodes.apply(i) for i in range(nodes.size())) if nodes else ():
            if node.name() == "BroadcastExchange":
                ms = node.metrics()
                at = next(m.accumulatorId() for m in (ms.apply(i) for i in range(ms.size())) if m.name() == "number of output rows")
                value = store.executionMetrics(k).get(at)
                counts.append(int(value.get().replace(",", "")) if value.isDefined() else 0)
    return max(ids, default=-1), counts


@pytest.mark.parametrize("name", GROWN)
def test_nothing_is_broadcast_by_estimate(spark, name):
    """Symbols are 40 times the parts that they are made from, and lineitem is larger than its file. A threshold between what Spark takes them for and what they are stands for large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        last, _ = broadcasts(spark)
        registry.QUERIES[name](spark, SMALL).write.format("noop").mode("overwrite").save()
        now, counts = broadcasts(spark, last)
        assert now > last
        assert max(counts, default=0) < 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema).repartition(3)


def test_sheets_are_whole(spark):
    """However rows are cut into batches, each sheet is in one call, sheets without an id too."""
    data = [(s if s else None, i) for s in range(60) for i in range(s * 37 % 400)]

    def run(c):
        assert (c["sheet_id"][1:] >= c["sheet_id"][:-1]).all()
        b = sheets.begins(c["sheet_id"])
        return {"sheet_id": c["sheet_id"][b[:-1]], "n": b[1:] - b[:-1]}

    data += [(None, 0)]
    for least in (1, 500, 10**9):
        got = sheets.whole_sheets(rows(spark, data, "sheet_id long, i long"), run, "sheet_id long, n long", least=least).collect()
        assert sorted((r["sheet_id"] or 0, r["n"]) for r in got) == sorted((k or 0, n) for k, n in Counter(s for s, _ in data).items())


def test_components_by_brute_force(spark):
    rng = random.Random(5)
    nodes = [(s, s * 1000 - 7000 + i) for s in range(14) for i in range(rng.randrange(1, 90))] + [(99, -(2**62) + i) for i in range(60)]
    edges = [(s, n, n + rng.randrange(-9, 10)) for s, n in nodes if rng.random() < 0.7] + [(99, -(2**62) + i, -(2**62) + i + 1) for i in range(59)] + [(5, None, 3)]
    known, up = set(nodes), {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for s, a, b in edges:
        if (s, a) in known and (s, b) in known:
            x, y = sorted((root((s, a)), root((s, b))))
            up[y] = x
    got = graphs.components(rows(spark, nodes + nodes[:5], "sheet_id long, node long"), rows(spark, edges, "sheet_id long, a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((*x, root(x)[1]) for x in nodes)


def test_paths_by_brute_force(spark):
    """Random graphs with loops, repeated edges and ends that are no nodes; with and without symbols that may be passed."""
    rng = random.Random(9)
    nodes = [(s, s * 50 + i, rng.random() < 0.5, rng.random() < 0.3) for s in range(12) for i in range(rng.randrange(1, 40))] + [(90, 9000, True, False)]
    edges = [(s, n, s * 50 + rng.randrange(45)) for s, n, *_ in nodes for _ in range(rng.randrange(3))]
    kind = {x[:2]: x[2:] for x in nodes}
    both = {(s, *e) for s, a, b in edges for e in ((a, b), (b, a)) if (s, a) in kind and (s, b) in kind}
    df = rows(spark, nodes, "sheet_id long, node long, symbol boolean, pass boolean")
    for most, passing in ((1, False), (3, False), (4, True)):
        want = {}
        for s, n, symbol, _ in nodes:
            far, front = {n: 0}, {n} if symbol else set()
            for hop in range(1, most + 1):
                front = {b for t, a, b in both if t == s and a in front and (hop == 1 or not kind[s, a][0] or passing and kind[s, a][1])} - set(far)
                far |= dict.fromkeys(front, hop)
                for m in front:
                    if kind[s, m][0]:
                        pair = (s, min(n, m), max(n, m))
                        want[pair] = min(hop, want.get(pair, 99))
        got = graphs.symbol_paths(df, rows(spark, edges, "sheet_id long, a long, b long"), most=most, passing=F.col("pass") if passing else None).collect()
        assert sorted(map(tuple, got)) == sorted((*k, v) for k, v in want.items())


def test_nearest_by_brute_force(spark):
    """Many ties, nodes at one place, one without a place, sheets of one node."""
    rng = random.Random(6)
    nodes = [(s, s * 100 + i, *(2 * [float(rng.randrange(6))]), *(2 * [float(rng.randrange(6))])) for s in range(30) for i in range(rng.randrange(1, 25))]
    nodes[40] = (*nodes[40][:2], None, None, None, None)
    df = rows(spark, [(s, n, x, y, u, w) for s, n, x, u, y, w in nodes], "sheet_id long, node long, x0 double, y0 double, x1 double, y1 double")
    for k in (1, 2, 30):
        want = set()
        for s, n, x, _, y, _ in nodes:
            others = sorted(((u - x) ** 2 + (w - y) ** 2 if None not in (x, u) else float("inf"), m) for t, m, u, _, w, _ in nodes if t == s and m != n)
            want |= {(s, min(n, m), max(n, m)) for _, m in others[:k]}
        got = [tuple(r) for r in spatial.k_nearest_pairs(df, k).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want


def test_junction_pixels_by_brute_force(spark):
    """Pixels listed twice count once; neighbours across a border of the page or of another sheet don't count."""
    rng = random.Random(7)
    ink = [(s, rng.randrange(-3, 12), rng.randrange(-3, 12)) for s in range(9) for _ in range(20 + 9 * s)]
    there = set(ink)
    n = {(s, x, y): sum((s, x + i, y + j) in there for i in (-1, 0, 1) for j in (-1, 0, 1)) - 1 for s, x, y in there}
    got = raster.junction_pixels(rows(spark, ink, "sheet_id long, x long, y long")).collect()
    assert sorted(map(tuple, got)) == sorted((*p, k) for p, k in n.items() if k >= 3)


def test_clusters_and_suppression_by_brute_force(spark):
    """Points at whole distances, of classes that share a place, without a class, a place or a confidence."""
    rng = random.Random(8)
    points = [(s, rng.choice(["a", "b", None]), i, float(rng.randrange(-40, 40)), float(rng.randrange(-40, 40)), rng.choice([None, 1, 2, 3])) for s in range(12) for i in range(60)]
    points[7] = (*points[7][:3], None, None, 3)
    df = rows(spark, points, "sheet_id long, cls string, pos long, px double, py double, conf int")
    near = lambda p, q, d, strict=False: None not in (p[3], q[3]) and ((e := (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2) < d * d or e == d * d and not strict)
    clusters = defaultdict(list)
    for p in points:
        c = clusters[p[:2]]
        mine = next((m for m in c if near(m[0], p, 10)), None)
        mine.append(p) if mine else c.append([p])
    want = sorted((str(m[0][1]), m[0][0], max(m, key=lambda p: (p[5] or -1, -p[2]))[2], len(m)) for c in clusters.values() for m in c)
    assert sorted((str(r["cls"]), r["sheet_id"], r["pos"], r["n_members"]) for r in assign.anchor_clusters(df, distance=10.0).collect()) == want
    for strict in (False, True):
        kept = []
        for p in points:
            if not any(q[0] == p[0] and near(p, q, 10, strict) for q in kept):
                kept.append(p)
        got = assign.suppress(df.drop("cls", "conf"), rank="pos", distance=10.0, strict=strict).collect()
        assert sorted(map(tuple, got)) == sorted((p[0], p[2]) for p in kept)
