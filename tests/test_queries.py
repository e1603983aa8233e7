"""Every registered query agrees with its SQL, or gives rows."""

import random

import pytest
from compare import SF_DIR, connect, differ
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetweave.operators import assign
from sheetweave.plans import registry
from sheetweave.plans.fixtures import Views


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    run = registry.QUERIES[name]
    if name in registry.SQL:
        assert differ(spark, con, run, registry.SQL[name]) == ""
    else:
        assert run(spark, SF_DIR).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_suppression_reads_every_row(spark, con):
    """Clusters of all rows of lineitem, by brute force: their members add up, and points that stay lie apart and cover the rest."""
    v = Views(spark, SF_DIR)
    n = con.execute("SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey").fetchone()[0]
    assert registry.QUERIES["CLU_01_stitch"](spark, SF_DIR).agg({"n_members": "sum"}).first()[0] == n
    order = Window.partitionBy("sheet_id").orderBy(F.col("conf").isNull(), F.col("conf").desc(), "pos")
    points = v.predd().withColumn("rank", F.row_number().over(order)).toPandas()
    assert len(points) == n
    for name, rank, limit, strict in (("CLU_02_suppress", "rank", 30, False), ("CLU_03_first_come", "pos", 60, True)):
        got = {(r["sheet_id"], r[rank]) for r in registry.QUERIES[name](spark, SF_DIR).collect()}
        want = set()
        for sheet, g in points.sort_values(rank).groupby("sheet_id"):
            kept = []
            for k, x, y in g[[rank, "px", "py"]].itertuples(index=False):
                if all((x - a) ** 2 + (y - b) ** 2 >= limit**2 + (not strict) for a, b in kept):
                    kept.append((x, y))
                    want.add((sheet, k))
        assert got == want, name


def cut_rings(size, up):
    """(parent, cut) of every node: each ring is cut at its smallest member, and so are pointers to itself or nowhere."""
    ring_of = {}
    for n in up:
        path = [n]
        while up.get(path[-1]) in size and up[path[-1]] not in path:
            path.append(up[path[-1]])
        if up.get(path[-1]) in path:
            ring = path[path.index(up[path[-1]]) :]
            ring_of |= dict.fromkeys(ring, min(ring, key=lambda k: (size[k], k)))
    cut = {n for n in up if up[n] not in size or up[n] == n or ring_of.get(n) == n}
    return {n: (None if n in cut else up.get(n), n in cut) for n in size}


def test_break_cycles_by_brute_force(spark):
    """Of all rows of lineitem, and of random pointers."""
    sf_dir = SF_DIR.replace("sf0.01", "sf0.001")
    v = Views(spark, sf_dir)
    size = {r["node"]: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in v.sym().collect()}
    want = cut_rings(size, {r["node"]: r["parent"] for r in v.parent().collect()})
    assert {r["node"]: (r["parent"], r["cut"]) for r in registry.QUERIES["GRF_14_break_cycles"](spark, sf_dir).collect()} == want
    rng = random.Random(3)
    up = {n: n // 50 * 50 + rng.randrange(52) for n in range(1000) if rng.random() < 0.9}
    size = {n: float(rng.randrange(40)) for n in range(1000)}
    up = {n: p if p // 50 == n // 50 else 10**9 for n, p in up.items()}
    want = cut_rings(size, up)
    assert sum(c for _, c in want.values()) > 20
    rows = spark.createDataFrame([(n // 50, n, a, up.get(n)) for n, a in size.items()], "sheet_id long, node long, area double, parent long")
    assert {r["node"]: (r["parent"], r["cut"]) for r in assign.break_cycles(rows).collect()} == want
