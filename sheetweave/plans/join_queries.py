"""Queries over joins, metrics, windows, sets, tiles and graphs, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetweave.functions.geometry import Box, area, box, center, contained, distance2, gap, inside, iou
from sheetweave.functions.text import AGENT_TYPES, alnum, mapped, series, series_disagree
from sheetweave.operators import assign, graphs, metrics, spatial, tiling
from sheetweave.plans.fixtures import Views, issues_of, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EQUIPMENT, CHILDREN = ("tank", "general"), ("valve", "instrumentation")
PASSING = ("connector", "crossing", "arrow")


def query(name: str, check: str | None = None):  # noqa: ANN201
    def keep(run: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: run(Views(spark, sf_dir, issues_of(check)))
        if check:
            SQL[name] = check
        return run

    return keep


def center_sql(p: str = "") -> tuple[str, str]:
    return f"(({p}x0 + {p}x1) / 2)", f"(({p}y0 + {p}y1) / 2)"


# --- joins ---------------------------------------------------------------------------------------------

def candidates(v: Views) -> DataFrame:
    """Predictions and the dense symbols that hold their point, with the prediction's rank by confidence."""
    order = Window.partitionBy("sheet_id").orderBy(F.col("conf").isNull(), F.col("conf").desc(), "pos")
    p = v.predd().withColumn("rank", F.row_number().over(order).cast("long")).withColumnRenamed("cls", "pcls")
    return spatial.points_in_boxes(p, v.symd().drop("tag"))


RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY conf IS NULL, conf DESC, pos) AS rank FROM predd), c AS (SELECT r.sheet_id, r.rank, r.pos, node, r.conf FROM r JOIN symd s ON r.sheet_id = s.sheet_id AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1)"
GREEDY = RANKED + """, steps(sheet_id, rank, used, node) AS (
  SELECT DISTINCT sheet_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM r
  UNION ALL SELECT s.sheet_id, s.rank + 1, CASE WHEN f.node IS NULL THEN s.used ELSE list_append(s.used, f.node) END, f.node
  FROM steps s JOIN (SELECT sheet_id, max(rank) AS top FROM r GROUP BY sheet_id) m ON m.sheet_id = s.sheet_id AND s.rank < m.top
  LEFT JOIN LATERAL (SELECT min(c.node) AS node FROM c WHERE c.sheet_id = s.sheet_id AND c.rank = s.rank + 1 AND NOT list_contains(s.used, c.node)) f ON true)"""


@query("JOI_01_candidates", sql(f"AND {RANKED} SELECT sheet_id, pos, node FROM c", "symd", "predd"))
def _(v: Views) -> DataFrame:
    return candidates(v).select("sheet_id", "pos", "node")


@query("JOI_01_point_in_box_greedy", sql(f"AND {GREEDY} SELECT sheet_id, rank, node FROM steps WHERE node IS NOT NULL", "symd", "predd", recursive=True))
def _(v: Views) -> DataFrame:
    return assign.first_free(candidates(v), rank="rank", choice="node")


def iou_pairs(v: Views) -> DataFrame:
    p = v.predd().select("sheet_id", "pos", F.col("cls").alias("pcls"), *(c.alias(f"p_{n}") for n, c in zip(Box._fields, spatial.at_point(F.col("px"), F.col("py"), 25.0), strict=True)))
    pairs = spatial.grid_join(p, v.symd(), on=["sheet_id"], a=box("p_"), b=box(), cell=128.0)
    return pairs.withColumn("iou", iou(box("p_"), box())).where("pcls = cls and iou >= 0.1")


INTER = "(greatest(0, least(px + 25, x1) - greatest(px - 25, x0)) * greatest(0, least(py + 25, y1) - greatest(py - 25, y0)))"
IOUS = f"c AS (SELECT p.sheet_id, pos, node, {INTER} / (2500 + (x1 - x0) * (y1 - y0) - {INTER}) AS iou FROM predd p JOIN symd s ON p.sheet_id = s.sheet_id AND p.cls = s.cls), k AS (SELECT * FROM c WHERE iou >= 0.1)"


@query("JOI_03_iou_candidates", sql(f"AND {IOUS} SELECT sheet_id, pos, node, iou FROM k", "symd", "predd"))
def _(v: Views) -> DataFrame:
    return iou_pairs(v).select("sheet_id", "pos", "node", "iou")


@query("JOI_03_iou_best_first", sql(f"""AND {IOUS}, o AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY iou DESC, pos, node) AS rank FROM k),
  steps(sheet_id, rank, up, un, hit) AS (SELECT DISTINCT sheet_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false FROM o
  UNION ALL SELECT sheet_id, next, CASE WHEN free THEN list_append(up, pos) ELSE up END, CASE WHEN free THEN list_append(un, node) ELSE un END, free
  FROM (SELECT s.sheet_id, s.up, s.un, o.pos, o.node, o.rank AS next, NOT list_contains(s.up, o.pos) AND NOT list_contains(s.un, o.node) AS free FROM steps s JOIN o ON o.sheet_id = s.sheet_id AND o.rank = s.rank + 1))
  SELECT o.sheet_id, pos, node, iou FROM steps JOIN o USING (sheet_id, rank) WHERE hit""", "symd", "predd", recursive=True))
def _(v: Views) -> DataFrame:
    return assign.best_first(iou_pairs(v), score="iou", left="pos", right="node")


@query("JOI_04_relation_match", sql("AND t AS (SELECT DISTINCT sheet_id, a, b FROM pair), p AS (SELECT sheet_id, kind, a, b, least(a, b) AS x, greatest(a, b) AS y, row_number() OVER (PARTITION BY sheet_id, least(a, b), greatest(a, b) ORDER BY kind, a, b) AS r FROM claim WHERE a IN (SELECT node FROM sym WHERE x1 - x0 > 30) AND b IN (SELECT node FROM sym WHERE x1 - x0 > 30)) SELECT p.sheet_id, p.kind, p.a, p.b, t.a IS NOT NULL AND r = 1 AS tp FROM p LEFT JOIN t ON t.sheet_id = p.sheet_id AND t.a = x AND t.b = y", "sym", "pair", "claim"))
def _(v: Views) -> DataFrame:
    """Claims whose ends were matched (symbols wider than 30 px are); each true edge is credited once."""
    own = lambda n: v.sym().where(box().width > 30).select(F.col("node").alias(n))
    truth = graphs.canonical(v.edge()).select("sheet_id", F.col("a").alias("x"), F.col("b").alias("y")).distinct().withColumn("_t", F.lit(True))
    order = Window.partitionBy("sheet_id", "x", "y").orderBy("kind", "a", "b")
    p = v.claim().join(own("a"), "a", "left_semi").join(own("b"), "b", "left_semi").select("sheet_id", "kind", "a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).withColumn("r", F.row_number().over(order))
    return p.join(truth, ["sheet_id", "x", "y"], "left").select("sheet_id", "kind", "a", "b", (F.col("_t").isNotNull() & (F.col("r") == 1)).alias("tp"))


HOLDS = "c.x0 >= e.x0 - 0.05 * greatest(1, e.x1 - e.x0) AND c.y0 >= e.y0 - 0.05 * greatest(1, e.y1 - e.y0) AND c.x1 <= e.x1 + 0.05 * greatest(1, e.x1 - e.x0) AND c.y1 <= e.y1 + 0.05 * greatest(1, e.y1 - e.y0)"
PLACED = f"placed AS (SELECT c.sheet_id, c.node, arg_min(e.node, ((e.x1 - e.x0) * (e.y1 - e.y0), e.node)) AS parent FROM symd c JOIN symd e ON c.sheet_id = e.sheet_id AND {HOLDS} WHERE c.cls IN ('valve', 'instrumentation') AND e.cls IN ('tank', 'general') GROUP BY c.sheet_id, c.node)"


@query("JOI_05_containment", sql(f"AND {PLACED} SELECT * FROM placed", "symd"))
def _(v: Views) -> DataFrame:
    return graphs.containment_parents(v.symd(), EQUIPMENT, CHILDREN)


ADJACENT = f"""both_ AS (SELECT sheet_id, a, b FROM edge UNION SELECT sheet_id, b, a FROM edge), lost AS (SELECT * FROM symd c WHERE cls IN ('valve', 'instrumentation') AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.node = c.node)),
  hop AS (SELECT l.node, b AS e FROM lost l JOIN both_ ON l.sheet_id = both_.sheet_id AND l.node = a UNION SELECT l.node, t.b FROM lost l JOIN both_ o ON l.sheet_id = o.sheet_id AND l.node = o.a JOIN both_ t ON t.sheet_id = o.sheet_id AND t.a = o.b),
  near AS (SELECT c.sheet_id, c.node, arg_min(e.node, (pow((c.x0 + c.x1) / 2 - (e.x0 + e.x1) / 2, 2) + pow((c.y0 + c.y1) / 2 - (e.y0 + e.y1) / 2, 2), e.node)) AS parent FROM hop JOIN symd c ON c.node = hop.node JOIN symd e ON e.node = hop.e WHERE e.cls IN ('tank', 'general') GROUP BY c.sheet_id, c.node)"""


@query("JOI_06_adjacent_nearest", sql(f"AND {PLACED}, {ADJACENT} SELECT * FROM near", "symd", "edge"))
def _(v: Views) -> DataFrame:
    nodes = v.symd()
    return graphs.adjacent_parents(nodes, v.edge(), graphs.containment_parents(nodes, EQUIPMENT, CHILDREN), EQUIPMENT, CHILDREN)


KNN = "n AS (SELECT p.sheet_id, p.node AS p, q.node AS q, row_number() OVER (PARTITION BY p.node ORDER BY pow((p.x0 + p.x1) / 2 - (q.x0 + q.x1) / 2, 2) + pow((p.y0 + p.y1) / 2 - (q.y0 + q.y1) / 2, 2), q.node) AS r FROM sym p JOIN sym q ON p.sheet_id = q.sheet_id AND p.node <> q.node)"


@query("JOI_07_knn_pairs", sql(f"AND {KNN} SELECT DISTINCT sheet_id, least(p, q) AS a, greatest(p, q) AS b FROM n WHERE r <= 2", "sym"))
def _(v: Views) -> DataFrame:
    return spatial.k_nearest_pairs(v.sym(), 2)


def near_words(v: Views, radius: float, later: bool, strict: bool = False) -> DataFrame:
    w = v.word().select("sheet_id", F.col("pos").alias("wpos"), "text", *(c.alias(f"w_{n}") for n, c in zip(Box._fields, box(), strict=True)))
    x, y = center(box("w_"))
    tie = [F.col("wpos").desc() if later else F.col("wpos")]
    return spatial.nearest(v.pred(), w, key=["pos"], px=F.col("px"), py=F.col("py"), tx=x, ty=y, radius=radius, tie=tie, strict=strict)


def near_sql(radius: int, later: bool, op: str = "<=") -> str:
    d2 = "pow(px - (x0 + x1) / 2, 2) + pow(py - (y0 + y1) / 2, 2)"
    return f"w AS (SELECT p.sheet_id, p.pos, word.text, word.pos AS wpos, sqrt({d2}) AS d, row_number() OVER (PARTITION BY p.sheet_id, p.pos ORDER BY {d2}, word.pos {'DESC' if later else ''}) AS r FROM pred p JOIN word ON word.sheet_id = p.sheet_id AND {d2} {op} {radius * radius})"


@query("JOI_08_nearest_word", sql(f"AND {near_sql(60, True)} SELECT p.sheet_id, p.pos, w.text, px - 60 AS x0, py + 60 AS y1 FROM pred p LEFT JOIN w ON w.sheet_id = p.sheet_id AND w.pos = p.pos AND r = 1", "sym", "pred", "word"))
def _(v: Views) -> DataFrame:
    """The nearest word within the radius, the later one on ties; a point without one still gets its box."""
    got = near_words(v, 60.0, True).select("sheet_id", "pos", "text")
    return v.pred().join(got, ["sheet_id", "pos"], "left").select("sheet_id", "pos", "text", (F.col("px") - 60).alias("x0"), (F.col("py") + 60).alias("y1"))


@query("JOI_09_synthetic_tokens", sql(f"AND {near_sql(120, False)}, k AS (SELECT p.sheet_id, p.pos, coalesce(text, '?') AS text FROM pred p LEFT JOIN w ON w.sheet_id = p.sheet_id AND w.pos = p.pos AND r = 1 WHERE d IS NULL OR d > 30) SELECT sheet_id, pos, text, 500 + row_number() OVER (PARTITION BY sheet_id ORDER BY pos) - 1 AS id FROM k", "sym", "pred", "word"))
def _(v: Views) -> DataFrame:
    """No token within 30 px of a word; its text within 120; else a question mark. Ids run over what is left."""
    got = near_words(v, 120.0, False).select("sheet_id", "pos", "text", "_d2")
    left = v.pred().join(got, ["sheet_id", "pos"], "left").where("_d2 is null or _d2 > 900")
    return left.select("sheet_id", "pos", F.coalesce("text", F.lit("?")).alias("text"), (F.row_number().over(Window.partitionBy("sheet_id").orderBy("pos")) + 499).cast("long").alias("id"))


@query("JOI_10_word_in_tile", sql(f"AND {near_sql(40, False, '<')} SELECT sheet_id, pos, split_part(text, ' ', 1) AS value FROM w WHERE r = 1", "sym", "pred", "word"))
def _(v: Views) -> DataFrame:
    return near_words(v, 40.0, False, strict=True).select("sheet_id", "pos", F.split_part("text", F.lit(" "), F.lit(1)).alias("value"))


@query("JOI_11_seed_extent", sql("AND c AS (SELECT p.sheet_id, p.pos, node, (x1 - x0) * (y1 - y0) AS ar, row_number() OVER (PARTITION BY p.sheet_id, p.pos ORDER BY (x1 - x0) * (y1 - y0), node) AS r FROM predd p JOIN symd s ON s.sheet_id = p.sheet_id AND px BETWEEN x0 - 3 AND x1 + 3 AND py BETWEEN y0 - 3 AND y1 + 3 WHERE least(x1 - x0, y1 - y0) >= 22 AND greatest(x1 - x0, y1 - y0) <= 880) SELECT p.sheet_id, p.pos, a.node, CASE WHEN a.node IS NULL THEN 'radius_box' ELSE 'path' END AS extent_source, CASE WHEN b.ar IS NOT NULL THEN 1 - a.ar / b.ar WHEN a.ar IS NOT NULL THEN 1 ELSE 0 END AS confidence FROM predd p LEFT JOIN c a ON a.sheet_id = p.sheet_id AND a.pos = p.pos AND a.r = 1 LEFT JOIN c b ON b.sheet_id = p.sheet_id AND b.pos = p.pos AND b.r = 2", "symd", "predd"))
def _(v: Views) -> DataFrame:
    """A seed's smallest enclosing path within the size band; its confidence grows with the distance in size to the next one."""
    b = box()
    fits = (F.least(b.width, b.height) >= 22) & (F.greatest(b.width, b.height) <= 880)
    pairs = spatial.grid_join(v.predd().drop("cls"), v.symd(), on=["sheet_id"], a=spatial.at_point(F.col("px"), F.col("py")), b=b.padded(3.0), cell=256.0, how=fits)
    order = Window.partitionBy("sheet_id", "pos").orderBy("ar", "node")
    top = pairs.withColumn("ar", area(b)).withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("sheet_id", "pos").agg(F.min_by("node", "r").alias("node"), F.min("ar").alias("a1"), F.max(F.when(F.col("r") == 2, F.col("ar"))).alias("a2"))
    conf = F.when(F.col("a2").isNotNull(), 1 - F.col("a1") / F.col("a2")).when(F.col("a1").isNotNull(), 1.0).otherwise(0.0)
    return v.predd().join(top, ["sheet_id", "pos"], "left").select("sheet_id", "pos", "node", F.when(F.col("node").isNull(), "radius_box").otherwise("path").alias("extent_source"), conf.alias("confidence"))


@query("JOI_13_node_symbol", sql("SELECT p.sheet_id, pos, arg_min(node, ((x1 - x0) * (y1 - y0), node)) AS node FROM pred p JOIN sym s ON s.sheet_id = p.sheet_id AND px BETWEEN x0 - 12 AND x1 + 12 AND py BETWEEN y0 - 12 AND y1 + 12 GROUP BY p.sheet_id, pos", "sym", "pred"))
def _(v: Views) -> DataFrame:
    pairs = spatial.grid_join(v.pred().drop("cls"), v.sym(), on=["sheet_id"], a=spatial.at_point(F.col("px"), F.col("py")), b=box().padded(12.0), cell=256.0)
    return spatial.smallest(pairs, key=["sheet_id", "pos"], size=area(box()), tie=[F.col("node")]).select("sheet_id", "pos", "node")


NEARC = "arg_min(node, (pow(px - (x0 + x1) / 2, 2) + pow(py - (y0 + y1) / 2, 2), node))"


@query("JOI_15_junction_symbol", sql(f"SELECT p.sheet_id, pos, {NEARC} AS node FROM pred p JOIN sym s ON s.sheet_id = p.sheet_id AND px BETWEEN x0 - 27 AND x1 + 27 AND py BETWEEN y0 - 27 AND y1 + 27 GROUP BY p.sheet_id, pos", "sym", "pred"))
def _(v: Views) -> DataFrame:
    """A junction within a padded box belongs to the symbol with the nearest centre."""
    pairs = spatial.grid_join(v.pred().drop("cls"), v.sym(), on=["sheet_id"], a=spatial.at_point(F.col("px"), F.col("py")), b=box().padded(27.0), cell=256.0)
    return spatial.smallest(pairs, key=["sheet_id", "pos"], size=distance2(F.col("px"), F.col("py"), *center(box())), tie=[F.col("node")]).select("sheet_id", "pos", "node")


@query("JOI_14_endpoint_resolve", sql(f"""AND j AS (SELECT p.sheet_id, p.pos, arg_min(q.pos, (pow(p.px - q.px, 2) + pow(p.py - q.py, 2), q.pos)) AS junction FROM pred p JOIN pred q ON q.sheet_id = p.sheet_id AND q.pos % 3 = 0 AND pow(p.px - q.px, 2) + pow(p.py - q.py, 2) < 9 * 9 WHERE p.pos % 3 <> 0 GROUP BY p.sheet_id, p.pos),
  s AS (SELECT p.sheet_id, pos, {NEARC} AS symbol FROM pred p JOIN sym s ON s.sheet_id = p.sheet_id AND px BETWEEN x0 - 5 AND x1 + 5 AND py BETWEEN y0 - 5 AND y1 + 5 WHERE pos % 3 <> 0 GROUP BY p.sheet_id, pos)
  SELECT p.sheet_id, p.pos, CASE WHEN junction IS NOT NULL THEN 'junction' WHEN symbol IS NOT NULL THEN 'symbol' ELSE 'loose_end' END AS kind, coalesce(junction, symbol) AS ref FROM pred p LEFT JOIN j USING (sheet_id, pos) LEFT JOIN s USING (sheet_id, pos) WHERE p.pos % 3 <> 0""", "sym", "pred"))
def _(v: Views) -> DataFrame:
    """An end goes to the nearest junction, strictly nearer than the radius and one, else to the symbol that holds it, else it is loose."""
    ends = v.pred().where("pos % 3 <> 0").drop("cls")
    knots = v.pred().where("pos % 3 = 0").select("sheet_id", F.col("pos").alias("junction"), F.col("px").alias("jx"), F.col("py").alias("jy"))
    j = spatial.nearest(ends, knots, key=["pos"], px=F.col("px"), py=F.col("py"), tx=F.col("jx"), ty=F.col("jy"), radius=9.0, tie=[F.col("junction")], strict=True).select("sheet_id", "pos", "junction")
    pairs = spatial.grid_join(ends, v.sym(), on=["sheet_id"], a=spatial.at_point(F.col("px"), F.col("py")), b=box().padded(5.0), cell=256.0)
    s = spatial.smallest(pairs, key=["sheet_id", "pos"], size=distance2(F.col("px"), F.col("py"), *center(box())), tie=[F.col("node")]).select("sheet_id", "pos", F.col("node").alias("symbol"))
    out = ends.join(j, ["sheet_id", "pos"], "left").join(s, ["sheet_id", "pos"], "left")
    return out.select("sheet_id", "pos", F.when(F.col("junction").isNotNull(), "junction").when(F.col("symbol").isNotNull(), "symbol").otherwise("loose_end").alias("kind"), F.coalesce("junction", "symbol").alias("ref"))


@query("JOI_16_polyline_crossing", sql("AND c AS (SELECT sheet_id, node, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM symd), s AS (SELECT e.sheet_id, e.a, e.b, p.cx AS ax, p.cy AS ay, q.cx AS bx, q.cy AS by_ FROM (SELECT DISTINCT sheet_id, a, b FROM edge) e JOIN c p ON p.node = e.a JOIN c q ON q.node = e.b) SELECT s.sheet_id, s.a, s.b, node FROM s JOIN symd d ON d.sheet_id = s.sheet_id AND node <> s.a AND node <> s.b WHERE (ay BETWEEN y0 - 12 AND y1 + 12 AND least(ax, bx) <= x1 + 12 AND greatest(ax, bx) >= x0 - 12) OR (bx BETWEEN x0 - 12 AND x1 + 12 AND least(ay, by_) <= y1 + 12 AND greatest(ay, by_) >= y0 - 12)", "symd", "edge"))
def _(v: Views) -> DataFrame:
    """Symbols that an L-shaped line from one centre to another passes through, its ends left out."""
    from sheetweave.functions.geometry import crosses

    own = lambda n, x, y: v.symd().select(F.col("node").alias(n), center(box())[0].alias(x), center(box())[1].alias(y))
    e = v.edge().select("sheet_id", "a", "b").distinct().join(own("a", "ax", "ay"), "a").join(own("b", "bx", "by"), "b")
    legs = F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("u"), F.col("ay").alias("v")), F.struct(F.col("bx").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("u"), F.col("by").alias("v"))))
    e = e.select("sheet_id", "a", "b", legs.alias("l")).select("sheet_id", "a", "b", "l.*")
    run = Box(F.least("x", "u"), F.least("y", "v"), F.greatest("x", "u"), F.greatest("y", "v"))
    wide = box().padded(12.0)
    pairs = spatial.grid_join(e, v.symd(), on=["sheet_id"], a=run, b=wide, cell=256.0, how=crosses(F.col("x"), F.col("y"), F.col("u"), F.col("v"), wide))
    return pairs.where("node <> a and node <> b").select("sheet_id", "a", "b", "node").distinct()


@query("JOI_21_claim_partition", sql("AND k AS (SELECT claim.*, p.node IS NOT NULL AS ka, q.node IS NOT NULL AS kb FROM claim LEFT JOIN sym p ON p.sheet_id = claim.sheet_id AND p.node = a LEFT JOIN sym q ON q.sheet_id = claim.sheet_id AND q.node = b) SELECT sheet_id, kind, a, b, CASE WHEN ka AND kb THEN 'on_sheet' WHEN ka OR kb THEN 'off_page' ELSE 'unknown' END AS part FROM k", "sym", "claim"))
def _(v: Views) -> DataFrame:
    own = lambda n: v.sym().select("sheet_id", F.col("node").alias(n), F.lit(1).alias(f"k{n}"))
    known = F.coalesce("ka", F.lit(0)) + F.coalesce("kb", F.lit(0))
    part = F.when(known == 2, "on_sheet").when(known == 1, "off_page").otherwise("unknown")
    return v.claim().join(own("a"), ["sheet_id", "a"], "left").join(own("b"), ["sheet_id", "b"], "left").select("sheet_id", "kind", "a", "b", part.alias("part"))


@query("JOI_22_orphans", sql("SELECT node, 'no_pred' AS missing FROM sym s WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.node = s.node) UNION ALL SELECT p.node, 'no_sym' FROM parent p WHERE p.node % 2 = 0", "sym", "parent"))
def _(v: Views) -> DataFrame:
    s, p = v.sym().select("node"), v.parent().select("node")
    return s.join(p, "node", "left_anti").select("node", F.lit("no_pred").alias("missing")).unionByName(p.join(s.where("node % 2 = 1"), "node", "left_anti").select("node", F.lit("no_sym").alias("missing")))


@query("JOI_23_leak_check", sql("SELECT node FROM sym WHERE node % 6 = 0", "sym"))
def _(v: Views) -> DataFrame:
    """Ids in both of two sets; a caller fails when there are any."""
    return v.sym().where("node % 2 = 0").select("node").intersect(v.sym().where("node % 3 = 0").select("node"))


@query("JOI_25_bridge_candidates", sql("SELECT p.sheet_id, p.pos AS i, q.pos AS j, pow(p.px - q.px, 2) + pow(p.py - q.py, 2) AS d2 FROM pred p JOIN pred q ON p.sheet_id = q.sheet_id AND p.pos < q.pos AND pow(p.px - q.px, 2) + pow(p.py - q.py, 2) > 16 AND pow(p.px - q.px, 2) + pow(p.py - q.py, 2) <= 130 * 130", "sym", "pred"))
def _(v: Views) -> DataFrame:
    return bridge_candidates(v)


def bridge_candidates(v: Views) -> DataFrame:
    p = v.pred().select("sheet_id", F.col("pos").alias("i"), "px", "py")
    q = v.pred().select("sheet_id", F.col("pos").alias("j"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    d2 = distance2(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))
    pairs = spatial.grid_join(p, q, on=["sheet_id"], a=spatial.at_point(F.col("px"), F.col("py"), 130.0), b=spatial.at_point(F.col("qx"), F.col("qy")), cell=150.0)
    return pairs.withColumn("d2", d2).where("i < j and d2 > 16 and d2 <= 16900").select("sheet_id", "i", "j", "d2")


@query("JOI_25_bridges")
def _(v: Views) -> DataFrame:
    return assign.bridges(bridge_candidates(v))


@query("JOI_26_negative_boxes", sql("AND c AS (SELECT sheet_id, pos, px - 40 AS x0, py - 40 AS y0, px + 40 AS x1, py + 40 AS y1 FROM pred) SELECT sheet_id, pos FROM c WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.sheet_id = c.sheet_id AND s.node % 2 = 0 AND s.x0 < c.x1 AND c.x0 < s.x1 AND s.y0 < c.y1 AND c.y0 < s.y1)", "sym", "pred"))
def _(v: Views) -> DataFrame:
    """Boxes that have no area in common with a true one: an anti-join on what the grid join finds."""
    c = v.pred().select("sheet_id", "pos", *(e.alias(f"c_{n}") for n, e in zip(Box._fields, spatial.at_point(F.col("px"), F.col("py"), 40.0), strict=True)))
    b, k = box(), box("c_")
    hit = spatial.grid_join(c, v.sym().where("node % 2 = 0"), on=["sheet_id"], a=k, b=b, cell=256.0, how=(b.x0 < k.x1) & (k.x0 < b.x1) & (b.y0 < k.y1) & (k.y0 < b.y1))
    return c.select("sheet_id", "pos").join(hit.select("sheet_id", "pos").distinct(), ["sheet_id", "pos"], "left_anti")


@query("JOI_27_non_edges", sql(f"AND {KNN} SELECT DISTINCT sheet_id, least(p, q) AS a, greatest(p, q) AS b FROM n WHERE r <= 3 AND NOT EXISTS (SELECT 1 FROM pair e WHERE e.sheet_id = n.sheet_id AND e.a = least(p, q) AND e.b = greatest(p, q))", "sym", "pair"))
def _(v: Views) -> DataFrame:
    """Near pairs that are no edges: an anti-join."""
    e = graphs.canonical(v.edge()).select("sheet_id", "a", "b").distinct()
    return spatial.k_nearest_pairs(v.sym(), 3).join(e, ["sheet_id", "a", "b"], "left_anti")


# --- metrics -------------------------------------------------------------------------------------------

COUNTS = f"{GREEDY}, n AS (SELECT g.sheet_id, coalesce(m, 0) AS n_matched, coalesce(p, 0) AS n_pred, g AS n_gt FROM (SELECT sheet_id, count(*) AS g FROM symd GROUP BY sheet_id) g LEFT JOIN (SELECT sheet_id, count(*) AS p FROM predd GROUP BY sheet_id) USING (sheet_id) LEFT JOIN (SELECT sheet_id, count(*) AS m FROM steps WHERE node IS NOT NULL GROUP BY sheet_id) USING (sheet_id))"


def detection_counts(v: Views) -> DataFrame:
    m = assign.first_free(candidates(v), rank="rank", choice="node").groupBy("sheet_id").agg(F.count("*").alias("m"))
    p = v.predd().groupBy("sheet_id").agg(F.count("*").alias("p"))
    g = v.symd().groupBy("sheet_id").agg(F.count("*").alias("n_gt"))
    return g.join(p, "sheet_id", "left").join(m, "sheet_id", "left").select("sheet_id", F.coalesce("m", F.lit(0)).alias("n_matched"), F.coalesce("p", F.lit(0)).alias("n_pred"), "n_gt")


@query("AGG_01_detection", sql(f"AND {COUNTS} SELECT sheet_id, n_matched, n_pred, n_gt, CASE WHEN n_pred = 0 THEN CASE WHEN n_gt = 0 THEN 1.0 ELSE 0.0 END ELSE CAST(n_matched AS DOUBLE) / n_pred END AS precision, CASE WHEN n_gt = 0 THEN 1.0 ELSE CAST(n_matched AS DOUBLE) / n_gt END AS recall, coalesce(2 * (CAST(n_matched AS DOUBLE) / n_pred) * (CAST(n_matched AS DOUBLE) / n_gt) / nullif(CAST(n_matched AS DOUBLE) / n_pred + CAST(n_matched AS DOUBLE) / n_gt, 0), 0) AS f1 FROM n", "symd", "predd", recursive=True))
def _(v: Views) -> DataFrame:
    return metrics.detection(detection_counts(v))


@query("AGG_29_config_run", sql(f"AND {COUNTS} SELECT sum(n_matched) AS n_matched, sum(n_pred) AS n_pred, sum(n_gt) AS n_gt FROM n", "symd", "predd", recursive=True))
def _(v: Views) -> DataFrame:
    return detection_counts(v).agg(*(F.sum(c).alias(c) for c in ("n_matched", "n_pred", "n_gt")))


def hits(v: Views) -> DataFrame:
    """Predictions with a confidence by rank, and whether they are matched."""
    scored = candidates(v).where("conf is not null")
    got = assign.first_free(scored, rank="rank", choice="node").select("sheet_id", "rank", F.lit(True).alias("_hit"))
    order = Window.partitionBy("sheet_id").orderBy(F.col("conf").desc(), "pos")
    return v.predd().where("conf is not null").withColumn("rank", F.row_number().over(order).cast("long")).join(got, ["sheet_id", "rank"], "left").select("sheet_id", "rank", F.col("_hit").isNotNull().alias("hit"))


@query("AGG_02_average_precision", sql(f"""AND {GREEDY}, h AS MATERIALIZED (SELECT s.sheet_id, s.rank, s.node IS NOT NULL AS hit FROM steps s JOIN r ON r.sheet_id = s.sheet_id AND r.rank = s.rank WHERE conf IS NOT NULL),
  g AS (SELECT sheet_id, count(*) AS n FROM symd GROUP BY sheet_id), a AS (SELECT h.sheet_id, rank, CAST(count(*) FILTER (WHERE hit) OVER w AS DOUBLE) AS m, n FROM h JOIN g ON g.sheet_id = h.sheet_id WINDOW w AS (PARTITION BY h.sheet_id ORDER BY rank)),
  b AS (SELECT sheet_id, rank, m / n AS rc, max(m / rank) OVER (PARTITION BY sheet_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pr FROM a),
  d AS (SELECT sheet_id, pr * (rc - coalesce(lag(rc) OVER (PARTITION BY sheet_id ORDER BY rank), 0)) AS x FROM b) SELECT g.sheet_id, round(sum(x), 9) AS ap FROM g LEFT JOIN d ON d.sheet_id = g.sheet_id GROUP BY g.sheet_id""", "symd", "predd", recursive=True))
def _(v: Views) -> DataFrame:
    truth = v.symd().groupBy("sheet_id").agg(F.count("*").alias("n_gt"))
    return metrics.average_precision(hits(v), truth).select("sheet_id", F.round("ap", 9).alias("ap"))


@query("AGG_03_typing_accuracy", "SELECT quality AS cls, count(*) AS n, avg(CAST(quality = 1 - toxic AS INTEGER)) AS accuracy, count(*) < 20 AS rare FROM labels GROUP BY quality")
def _(v: Views) -> DataFrame:
    same = (F.col("quality") == 1 - F.col("toxic")).cast("int")
    return v.table("labels").groupBy(F.col("quality").alias("cls")).agg(F.count("*").alias("n"), F.avg(same).alias("accuracy"), (F.count("*") < 20).alias("rare"))


TOPO = f"""{KNN}, p AS (SELECT DISTINCT sheet_id, least(p, q) AS a, greatest(p, q) AS b FROM n WHERE r <= 1), u AS (SELECT coalesce(p.sheet_id, t.sheet_id) AS sheet_id, coalesce(p.a, t.a) AS a, coalesce(p.b, t.b) AS b, p.a IS NOT NULL AS ip, t.a IS NOT NULL AS it, CASE WHEN t.dashed THEN 'dashed' ELSE 'solid' END AS lt FROM p FULL JOIN pair t ON t.sheet_id = p.sheet_id AND t.a = p.a AND t.b = p.b),
  f AS (SELECT u.sheet_id, CAST(ip AND it AS BIGINT) AS tp, CAST(ip AND NOT it AS BIGINT) AS fp, CAST(it AND NOT ip AS BIGINT) AS fn, ['all', 'line:' || CASE WHEN it THEN lt ELSE 'false_positive' END, 'class:' || least(x.cls, y.cls) || '|' || greatest(x.cls, y.cls)] AS strata FROM u JOIN sym x ON x.node = u.a JOIN sym y ON y.node = u.b),
  l AS (SELECT sheet_id, unnest(strata) AS stratum, tp, fp, fn FROM f)"""


def topology_scores(v: Views) -> DataFrame:
    truth = graphs.canonical(v.edge()).groupBy("sheet_id", "a", "b").agg(F.when(F.max((F.col("line_type") == "dashed").cast("int")) == 1, "dashed").otherwise("solid").alias("line_type"))
    return metrics.topology(spatial.k_nearest_pairs(v.sym(), 1), truth, v.sym())


@query("AGG_04_topology", sql(f"AND {TOPO} SELECT sheet_id, stratum, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM l GROUP BY sheet_id, stratum", "sym", "pair"))
def _(v: Views) -> DataFrame:
    return topology_scores(v)


@query("AGG_05_06_micro_average", sql(f"AND {TOPO}, m AS (SELECT stratum, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM l GROUP BY stratum), pr AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall FROM m) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr", "sym", "pair"))
def _(v: Views) -> DataFrame:
    return metrics.micro(topology_scores(v))


@query("AGG_08_stratum", sql("SELECT sheet_id, a, b, least(x.cls, y.cls) || '|' || greatest(x.cls, y.cls) AS stratum FROM pair JOIN sym x USING (sheet_id) JOIN sym y USING (sheet_id) WHERE x.node = a AND y.node = b", "sym", "pair"))
def _(v: Views) -> DataFrame:
    own = lambda n: v.sym().select(F.col("node").alias(n), F.col("cls").alias(f"c{n}"))
    return graphs.canonical(v.edge()).select("sheet_id", "a", "b").distinct().join(own("a"), "a").join(own("b"), "b").select("sheet_id", "a", "b", metrics.stratum(F.col("ca"), F.col("cb")).alias("stratum"))


@query("AGG_09_agreement", sql("AND c AS (SELECT DISTINCT sheet_id, least(a, b) AS a, greatest(a, b) AS b FROM claim WHERE b < 1000000000000), g AS (SELECT * FROM pair WHERE NOT dashed), u AS (SELECT coalesce(c.sheet_id, g.sheet_id) AS sheet_id, c.a IS NOT NULL AS ic, g.a IS NOT NULL AS ig FROM c FULL JOIN g ON c.sheet_id = g.sheet_id AND c.a = g.a AND c.b = g.b) SELECT sheet_id, count(*) FILTER (WHERE ic AND ig) AS agreed, count(*) FILTER (WHERE ic AND NOT ig) AS llm_only, count(*) FILTER (WHERE ig AND NOT ic) AS geometry_only, coalesce(CAST(count(*) FILTER (WHERE ic AND ig) AS DOUBLE) / nullif(count(*) FILTER (WHERE ic), 0), 0) AS rate_llm, coalesce(CAST(count(*) FILTER (WHERE ic AND ig) AS DOUBLE) / nullif(count(*) FILTER (WHERE ig), 0), 0) AS rate_geometry FROM u GROUP BY sheet_id", "claim", "pair"))
def _(v: Views) -> DataFrame:
    c = graphs.canonical(v.claim().where("b < 1000000000000").select("sheet_id", "a", "b")).distinct().withColumn("_c", F.lit(1))
    g = graphs.canonical(v.edge()).groupBy("sheet_id", "a", "b").agg(F.bool_or(F.col("line_type") == "dashed").alias("dashed")).where("not dashed").select("sheet_id", "a", "b", F.lit(1).alias("_g"))
    ic, ig = F.col("_c").isNotNull(), F.col("_g").isNotNull()
    n = c.join(g, ["sheet_id", "a", "b"], "full").groupBy("sheet_id").agg(F.count_if(ic & ig).alias("agreed"), F.count_if(ic & ~ig).alias("llm_only"), F.count_if(ig & ~ic).alias("geometry_only"))
    return n.select("*", metrics.ratio(F.col("agreed"), F.col("agreed") + F.col("llm_only")).alias("rate_llm"), metrics.ratio(F.col("agreed"), F.col("agreed") + F.col("geometry_only")).alias("rate_geometry"))


@query("AGG_10_11_adjudicated", sql("AND k AS (SELECT sheet_id, kind, CASE (a + b) % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'not_real' ELSE 'unsure' END AS verdict FROM claim) SELECT kind, count(*) AS n, count(*) FILTER (WHERE verdict = 'unsure') AS unsure, CAST(count(*) FILTER (WHERE verdict = 'real') AS DOUBLE) / nullif(count(*) FILTER (WHERE verdict <> 'unsure'), 0) AS precision, CAST(count(*) FILTER (WHERE verdict = 'real') AS DOUBLE) / count(*) AS low, CAST(count(*) FILTER (WHERE verdict <> 'not_real') AS DOUBLE) / count(*) AS high FROM k GROUP BY kind", "claim"))
def _(v: Views) -> DataFrame:
    """Precision without unsure verdicts, and with all of them taken as wrong or as right."""
    k = v.claim().withColumn("m", (F.col("a") + F.col("b")) % 3)
    real, unsure = F.count_if(F.col("m") == 0), F.count_if(F.col("m") == 2)
    return k.groupBy("kind").agg(F.count("*").alias("n"), unsure.alias("unsure"), F.try_divide(real.cast("double"), F.count_if(F.col("m") != 2)).alias("precision"), F.try_divide(real.cast("double"), F.count("*")).alias("low"), F.try_divide((real + unsure).cast("double"), F.count("*")).alias("high"))


@query("AGG_12_tag_recall", sql("AND t AS (SELECT DISTINCT sheet_id, truth AS tag FROM tagset WHERE in_truth), p AS (SELECT DISTINCT sheet_id, found AS got FROM tagset WHERE in_found), h AS (SELECT t.sheet_id, tag, bool_or(tag = got OR (length(tag) >= 5 AND length(got) >= 5 AND (suffix(got, tag) OR suffix(tag, got)))) AS hit FROM t LEFT JOIN p ON p.sheet_id = t.sheet_id GROUP BY t.sheet_id, tag) SELECT sheet_id, count(*) AS n_truth, count(*) FILTER (WHERE hit) AS n_hit, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS recall FROM h GROUP BY sheet_id", "tagset"))
def _(v: Views) -> DataFrame:
    s = v.tagset()
    return metrics.tag_recall(s.where("in_truth").select("sheet_id", F.col("truth").alias("tag")), s.where("in_found").select("sheet_id", F.col("found").alias("tag")))


GROUPS = "k AS (SELECT sheet_id, node, node % 5 AS p, node % 10 // 3 AS t FROM sym)"


@query("AGG_14_co_grouping", sql(f"AND {GROUPS} SELECT x.sheet_id, count(*) AS n_pairs, count(*) FILTER (WHERE (x.p = y.p) = (x.t = y.t)) AS n_agree, CAST(count(*) FILTER (WHERE (x.p = y.p) = (x.t = y.t)) AS DOUBLE) / count(*) AS accuracy FROM k x JOIN k y ON x.sheet_id = y.sheet_id AND x.node < y.node GROUP BY x.sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    n = F.col("node")
    return metrics.co_grouping(v.sym().select("sheet_id", "node", (n % 5).alias("pred"), F.floor(n % 10 / 3).alias("truth")))


@query("AGG_16_count_errors", sql("AND k AS (SELECT sheet_id, count(*) AS t, count(*) FILTER (WHERE node % 7 <> 0) AS p FROM sym GROUP BY sheet_id) SELECT avg(abs(p - t)) AS mae, avg(CAST(p = t AS INTEGER)) AS exact, avg(CAST(p = 0 AS INTEGER)) AS zero FROM k", "sym"))
def _(v: Views) -> DataFrame:
    k = v.sym().groupBy("sheet_id").agg(F.count("*").alias("t"), F.count_if(F.col("node") % 7 != 0).alias("p"))
    return k.agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"), F.avg((F.col("p") == F.col("t")).cast("int")).alias("exact"), F.avg((F.col("p") == 0).cast("int")).alias("zero"))


@query("AGG_17_verdict_accuracy", sql("SELECT sheet_id, count(*) FILTER (WHERE node % 4 <> 3) AS decided, avg(CAST(node % 2 = node % 4 AS INTEGER)) FILTER (WHERE node % 4 <> 3) AS accuracy FROM sym GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    n = F.col("node")
    return v.sym().groupBy("sheet_id").agg(F.count_if(n % 4 != 3).alias("decided"), F.avg(F.when(n % 4 != 3, (n % 2 == n % 4).cast("int"))).alias("accuracy"))


@query("AGG_18_class_histogram", sql("SELECT cls, count(*) AS n, rank() OVER (ORDER BY count(*), cls) <= 5 AS rarest FROM sym GROUP BY cls", "sym"))
def _(v: Views) -> DataFrame:
    h = v.sym().groupBy("cls").agg(F.count("*").alias("n"))
    rare = h.orderBy("n", "cls").limit(5).select("cls", F.lit(True).alias("_rare"))
    return h.join(rare, "cls", "left").select("cls", "n", F.col("_rare").isNotNull().alias("rarest"))


@query("AGG_19_size_stats", sql("SELECT sheet_id, min(x1 - x0) AS low, quantile_cont(x1 - x0, 0.5) AS mid, max(x1 - x0) AS high FROM sym GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    w = box().width
    return v.sym().groupBy("sheet_id").agg(F.min(w).alias("low"), F.percentile(w, 0.5).alias("mid"), F.max(w).alias("high"))


@query("AGG_20_group_means", sql("SELECT cls, sheet_id % 2 AS family, grouping(sheet_id % 2) AS whole, avg(x0) AS mean FROM sym GROUP BY GROUPING SETS ((cls, sheet_id % 2), (cls))", "sym"))
def _(v: Views) -> DataFrame:
    return v.sym().withColumn("family", F.col("sheet_id") % 2).groupingSets([["cls", "family"], ["cls"]], "cls", "family").agg(F.grouping("family").cast("long").alias("whole"), F.avg("x0").alias("mean")).select("cls", "family", "whole", "mean")


@query("AGG_21_graph_stats", sql("SELECT sheet_id, count(*) AS n, count(*) FILTER (WHERE line_type = 'dashed') AS dashed, count(*) FILTER (WHERE line_type = 'solid') AS solid FROM edge GROUP BY sheet_id", "edge"))
def _(v: Views) -> DataFrame:
    by = v.edge().groupBy("sheet_id").pivot("line_type", ["dashed", "solid"]).agg(F.count(F.lit(1)))
    return by.select("sheet_id", (F.coalesce("dashed", F.lit(0)) + F.coalesce("solid", F.lit(0))).alias("n"), F.coalesce("dashed", F.lit(0)).alias("dashed"), F.coalesce("solid", F.lit(0)).alias("solid"))


@query("AGG_22_path_confidence", sql("SELECT node, CASE WHEN node % 6 = 0 THEN 0.0 ELSE least(1, (node % 13) / 10) * greatest(0.5, 1 - 0.05 * (node % 6 - 1)) * greatest(0.5, (node % 4) / 4) * greatest(0.5, 1 - 0.1 * (node % 8)) END AS confidence FROM sym", "sym"))
def _(v: Views) -> DataFrame:
    n = F.col("node")
    return v.sym().select("node", metrics.path_confidence((n % 13) / 10, n % 6, (n % 4) / 4, n % 8, digits=None).alias("confidence"))


@query("AGG_23_dominant_line", sql("AND c AS (SELECT sheet_id, a, line_type, count(*) AS n FROM edge GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY sheet_id, a) AS top FROM c) SELECT sheet_id, a, CASE WHEN count(*) = 1 THEN min(line_type) ELSE 'unknown' END AS line_type FROM t WHERE n = top GROUP BY sheet_id, a", "edge"))
def _(v: Views) -> DataFrame:
    return metrics.dominant(v.edge(), ["sheet_id", "a"], "line_type")


@query("AGG_25_median_guard", sql("AND m AS (SELECT sheet_id, list_sort(list(x1 - x0))[count(*) // 2 + 1] AS med FROM sym GROUP BY sheet_id) SELECT node, CASE WHEN x1 - x0 > 1.2 * med THEN (x0 + x1) / 2 - med / 2 ELSE x0 END AS x0, CASE WHEN x1 - x0 > 1.2 * med THEN (x0 + x1) / 2 + med / 2 ELSE x1 END AS x1 FROM sym JOIN m USING (sheet_id)", "sym"))
def _(v: Views) -> DataFrame:
    """Boxes much wider than the sheet's upper median are replaced by one of its size."""
    b = box()
    m = v.sym().groupBy("sheet_id").agg(F.element_at(F.array_sort(F.collect_list(b.width)), F.floor(F.count("*") / 2).cast("int") + 1).alias("med"))
    big, mid = b.width > 1.2 * F.col("med"), center(b)[0]
    return v.sym().join(m, "sheet_id").select("node", F.when(big, mid - F.col("med") / 2).otherwise(b.x0).alias("x0"), F.when(big, mid + F.col("med") / 2).otherwise(b.x1).alias("x1"))


@query("AGG_28_result_matrix", sql("SELECT cls, coalesce(CAST(max_by(node, x0 + node / 1e6) FILTER (WHERE sheet_id % 3 = 0) AS VARCHAR), '-') AS m0, coalesce(CAST(max_by(node, x0 + node / 1e6) FILTER (WHERE sheet_id % 3 = 1) AS VARCHAR), '-') AS m1 FROM sym GROUP BY cls", "sym"))
def _(v: Views) -> DataFrame:
    """The latest value of each row and column."""
    wide = v.sym().withColumn("model", F.concat(F.lit("m"), (F.col("sheet_id") % 3).cast("string"))).groupBy("cls").pivot("model", ["m0", "m1"]).agg(F.max_by("node", F.col("x0") + F.col("node") / 1e6))
    return wide.select("cls", *(F.coalesce(F.col(m).cast("string"), F.lit("-")).alias(m) for m in ("m0", "m1")))


@query("AGG_31_class_summary", sql("AND c AS (SELECT sheet_id, cls, count(*) AS n, min(node) AS f FROM sym GROUP BY sheet_id, cls) SELECT sheet_id, string_agg(cls || ' x' || n, ', ' ORDER BY n DESC, f) AS summary FROM c GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    c = v.sym().groupBy("sheet_id", "cls").agg(F.count("*").alias("n"), F.min("node").alias("f"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "f", F.concat("cls", F.lit(" x"), F.col("n").cast("string")).alias("t"))))
    return c.groupBy("sheet_id").agg(F.array_join(F.transform(lines, lambda s: s["t"]), ", ").alias("summary"))


@query("AGG_32_one_sided_recall", sql("SELECT sheet_id, avg(CAST(contains(lower(text), 'remove') AS INTEGER)) AS recall FROM answer GROUP BY sheet_id", "answer"))
def _(v: Views) -> DataFrame:
    return v.answer().groupBy("sheet_id").agg(F.avg(F.contains(F.lower("text"), F.lit("remove")).cast("int")).alias("recall"))


# --- windows, sets, tiles ------------------------------------------------------------------------------

@query("WIN_01_rank", sql("SELECT sheet_id, pos, row_number() OVER (PARTITION BY sheet_id ORDER BY conf DESC NULLS LAST, pos) AS rank FROM pred", "sym", "pred"))
def _(v: Views) -> DataFrame:
    return v.pred().select("sheet_id", "pos", F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.col("conf").desc_nulls_last(), "pos")).alias("rank"))


@query("WIN_05_worklist_order", sql("SELECT sheet_id, kind, a, b, row_number() OVER (PARTITION BY sheet_id ORDER BY b >= 1000000000000 DESC, kind = 'feeds' DESC, a DESC, kind, b) AS idx FROM claim", "claim"))
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("sheet_id").orderBy((F.col("b") >= 1000000000000).desc(), (F.col("kind") == "feeds").desc(), F.col("a").desc(), "kind", "b")
    return v.claim().select("sheet_id", "kind", "a", "b", F.row_number().over(w).alias("idx"))


@query("WIN_06_reading_order", sql("SELECT sheet_id, node, row_number() OVER (PARTITION BY sheet_id ORDER BY y0, x0, node) - 1 AS id FROM sym", "sym"))
def _(v: Views) -> DataFrame:
    return v.sym().select("sheet_id", "node", (F.row_number().over(Window.partitionBy("sheet_id").orderBy("y0", "x0", "node")) - 1).alias("id"))


@query("WIN_08_run_lengths", sql("AND k AS (SELECT sheet_id, node, node * 7 % 11 < 6 AS bit FROM sym), c AS (SELECT *, CAST(bit IS DISTINCT FROM lag(bit) OVER (PARTITION BY sheet_id ORDER BY node) AS INTEGER) AS ch FROM k), g AS (SELECT *, sum(ch) OVER (PARTITION BY sheet_id ORDER BY node) AS run FROM c) SELECT sheet_id, run, bool_or(bit) AS bit, count(*) AS n FROM g GROUP BY sheet_id, run", "sym"))
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("sheet_id").orderBy("node")
    k = v.sym().select("sheet_id", "node", (F.col("node") * 7 % 11 < 6).alias("bit")).withColumn("ch", (~F.col("bit").eqNullSafe(F.lag("bit").over(w))).cast("long"))
    return k.withColumn("run", F.sum("ch").over(w)).groupBy("sheet_id", "run").agg(F.bool_or("bit").alias("bit"), F.count("*").alias("n"))


@query("WIN_10_path_order", sql("SELECT sheet_id, a, b, row_number() OVER (PARTITION BY sheet_id ORDER BY a, b) AS idx FROM (SELECT DISTINCT sheet_id, a, b FROM edge)", "edge"))
def _(v: Views) -> DataFrame:
    """Paths in the order of their ends."""
    return v.edge().select("sheet_id", "a", "b").distinct().withColumn("idx", F.row_number().over(Window.partitionBy("sheet_id").orderBy("a", "b")))


@query("WIN_11_limit_per_class", sql("SELECT sheet_id, cls, node FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, cls ORDER BY node) AS r FROM sym) WHERE r <= 2", "sym"))
def _(v: Views) -> DataFrame:
    return v.sym().withColumn("r", F.row_number().over(Window.partitionBy("sheet_id", "cls").orderBy("node"))).where("r <= 2").select("sheet_id", "cls", "node")


@query("WIN_13_consecutive", sql("SELECT sheet_id, node AS a, next AS b FROM (SELECT sheet_id, node, lead(node) OVER (PARTITION BY sheet_id ORDER BY node) AS next FROM sym) WHERE next IS NOT NULL", "sym"))
def _(v: Views) -> DataFrame:
    return v.sym().select("sheet_id", F.col("node").alias("a"), F.lead("node").over(Window.partitionBy("sheet_id").orderBy("node")).alias("b")).where("b is not null")


@query("SET_01_pair_sets", sql("AND c AS (SELECT DISTINCT sheet_id, least(a, b) AS a, greatest(a, b) AS b FROM claim) SELECT *, 'both' AS part FROM (SELECT sheet_id, a, b FROM pair INTERSECT SELECT * FROM c) UNION ALL SELECT *, 'edge_only' FROM (SELECT sheet_id, a, b FROM pair EXCEPT SELECT * FROM c)", "pair", "claim"))
def _(v: Views) -> DataFrame:
    e, c = graphs.canonical(v.edge().select("sheet_id", "a", "b")).distinct(), graphs.canonical(v.claim().select("sheet_id", "a", "b")).distinct()
    return e.intersect(c).withColumn("part", F.lit("both")).unionByName(e.subtract(c).withColumn("part", F.lit("edge_only")))


@query("SET_02_first_evidence", sql("AND u AS (SELECT sheet_id, least(a, b) AS a, greatest(a, b) AS b, 1 AS pass_no FROM claim WHERE b < 1000000000000 UNION ALL SELECT sheet_id, a, b, 2 FROM pair) SELECT sheet_id, a, b, min(pass_no) AS pass_no FROM u GROUP BY sheet_id, a, b", "claim", "pair"))
def _(v: Views) -> DataFrame:
    return graphs.first_evidence(v.claim().where("b < 1000000000000").select("sheet_id", "a", "b", F.lit(1).alias("pass_no")).unionByName(v.edge().select("sheet_id", "a", "b", F.lit(2).alias("pass_no"))))


@query("SET_03_arm_union", sql("SELECT DISTINCT sheet_id, found AS tag FROM tagset WHERE in_found UNION SELECT sheet_id, truth FROM tagset WHERE node % 5 = 0", "tagset"))
def _(v: Views) -> DataFrame:
    s = v.tagset()
    return s.where("in_found").select("sheet_id", F.col("found").alias("tag")).unionByName(s.where("node % 5 = 0").select("sheet_id", F.col("truth").alias("tag"))).distinct()


@query("SET_05_verdict_partition", sql("SELECT sheet_id, coalesce(string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) FILTER (WHERE node % 4 = 0), '') AS removed, count(*) FILTER (WHERE node % 4 <> 0) AS confirmed FROM sym GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    n = F.col("node")
    return v.sym().groupBy("sheet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(n % 4 == 0, n))), lambda x: x.cast("string")), ",").alias("removed"), F.count_if(n % 4 != 0).alias("confirmed"))


@query("SET_06_multi_source", sql("AND d AS (SELECT sheet_id, count(*) AS n FROM pred GROUP BY sheet_id), s AS (SELECT *, CASE WHEN n >= 40 THEN 2 ELSE 1 END AS k FROM d) SELECT 'boxes' AS source, sheet_id, n FROM s UNION ALL SELECT 'boxes', sheet_id, n FROM s WHERE k = 2 UNION ALL SELECT 'points', sheet_id, n FROM s WHERE sheet_id % 2 = 0", "sym", "pred"))
def _(v: Views) -> DataFrame:
    """Samples of several sources; dense ones count twice."""
    d = v.pred().groupBy("sheet_id").agg(F.count("*").alias("n"))
    boxes = d.select(F.lit("boxes").alias("source"), "sheet_id", "n", F.explode(F.array_repeat(F.lit(0), F.when(F.col("n") >= 40, 2).otherwise(1))).alias("_")).drop("_")
    return boxes.unionByName(d.where("sheet_id % 2 = 0").select(F.lit("points").alias("source"), "sheet_id", "n"))


SIZES = "sheets AS (SELECT DISTINCT sheet_id, 4200 AS w, 3200 AS h FROM sym)"
GRID = f"{SIZES}, tiles AS (SELECT sheet_id, tx AS x0, ty AS y0, least(tx + 1024, w) AS x1, least(ty + 1024, h) AS y1, tx = 0 OR ty = 0 OR tx + 1024 >= w OR ty + 1024 >= h AS is_edge FROM sheets, (SELECT unnest(range(0, 4200, 819)) AS tx), (SELECT unnest(range(0, 3200, 819)) AS ty))"


def sheets(v: Views) -> DataFrame:
    return v.sym().select("sheet_id").distinct().select("sheet_id", F.lit(4200).alias("width"), F.lit(3200).alias("height"))


@query("TILE_01", sql(f"AND {GRID} SELECT * FROM tiles", "sym"))
def _(v: Views) -> DataFrame:
    return tiling.tile_grid(sheets(v))


@query("TILE_02_fine_grid", sql(f"AND {SIZES} SELECT sheet_id, count(*) AS n FROM sheets, (SELECT unnest(range(0, 4200, 410)) AS tx), (SELECT unnest(range(0, 3200, 410)) AS ty) GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    return tiling.tile_grid(sheets(v), size=512, overlap=102).groupBy("sheet_id").agg(F.count("*").alias("n"))


@query("JOI_19_boxes_on_tiles", sql(f"AND {GRID} SELECT s.sheet_id, node, CAST(t.x0 AS DOUBLE) AS tx, CAST(t.y0 AS DOUBLE) AS ty, s.x0 - t.x0 AS x0, s.y0 - t.y0 AS y0, s.x1 - t.x0 AS x1, s.y1 - t.y0 AS y1 FROM sym s JOIN tiles t ON t.sheet_id = s.sheet_id AND s.x0 < t.x1 AND t.x0 < s.x1 AND s.y0 < t.y1 AND t.y0 < s.y1", "sym"))
def _(v: Views) -> DataFrame:
    return tiling.boxes_on_tiles(v.sym(), tiling.tile_grid(sheets(v)))


@query("AGG_30_tile_counts", sql(f"AND {GRID} SELECT t.sheet_id, t.x0 AS tx, t.y0 AS ty, count(node) AS n FROM tiles t LEFT JOIN sym s ON t.sheet_id = s.sheet_id AND s.x0 < t.x1 AND t.x0 < s.x1 AND s.y0 < t.y1 AND t.y0 < s.y1 GROUP BY t.sheet_id, t.x0, t.y0", "sym"))
def _(v: Views) -> DataFrame:
    t = tiling.tile_grid(sheets(v))
    n = tiling.boxes_on_tiles(v.sym(), t).groupBy("sheet_id", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty")).agg(F.count("*").alias("n"))
    return t.select("sheet_id", F.col("x0").alias("tx"), F.col("y0").alias("ty")).join(n, ["sheet_id", "tx", "ty"], "left").select("sheet_id", "tx", "ty", F.coalesce("n", F.lit(0)).alias("n"))


@query("JOI_20_points_on_tiles", sql(f"AND {GRID} SELECT p.sheet_id, pos, CAST(t.x0 AS DOUBLE) AS tx, CAST(t.y0 AS DOUBLE) AS ty, CAST(round_even((px - t.x0) / (t.x1 - t.x0) * 1000, 0) AS BIGINT) AS x, CAST(round_even((py - t.y0) / (t.y1 - t.y0) * 1000, 0) AS BIGINT) AS y FROM pred p JOIN tiles t ON t.sheet_id = p.sheet_id AND t.x0 <= px AND px < t.x1 AND t.y0 <= py AND py < t.y1 WHERE t.x1 - t.x0 >= 64 AND t.y1 - t.y0 >= 64", "sym", "pred"))
def _(v: Views) -> DataFrame:
    return tiling.points_on_tiles(v.pred(), tiling.tile_grid(sheets(v)))


@query("TILE_03_examples", sql(f"AND {GRID} SELECT t.sheet_id, t.x0 AS tx, t.y0 AS ty, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS targets FROM tiles t JOIN sym s ON t.sheet_id = s.sheet_id AND s.x0 < t.x1 AND t.x0 < s.x1 AND s.y0 < t.y1 AND t.y0 < s.y1 GROUP BY t.sheet_id, t.x0, t.y0", "sym"))
def _(v: Views) -> DataFrame:
    b = tiling.boxes_on_tiles(v.sym(), tiling.tile_grid(sheets(v)))
    return b.groupBy("sheet_id", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("targets"))


# --- clusters and graphs -------------------------------------------------------------------------------

@query("CLU_01_stitch")
def _(v: Views) -> DataFrame:
    return assign.anchor_clusters(v.predd())


@query("CLU_02_suppress")
def _(v: Views) -> DataFrame:
    order = Window.partitionBy("sheet_id").orderBy(F.col("conf").isNull(), F.col("conf").desc(), "pos")
    return assign.suppress(v.predd().withColumn("rank", F.row_number().over(order).cast("long")), rank="rank", distance=30.0, strict=False)


@query("CLU_03_first_come")
def _(v: Views) -> DataFrame:
    return assign.suppress(v.predd(), rank="pos", distance=60.0, strict=True)


@query("CLU_04_tile_nms")
def _(v: Views) -> DataFrame:
    """Boxes of 50 px around all detections, by confidence."""
    order = Window.partitionBy("sheet_id").orderBy(F.col("conf").isNull(), F.col("conf").desc(), "pos")
    around = [c.alias(n) for n, c in zip(Box._fields, spatial.at_point(F.col("px"), F.col("py"), 25.0), strict=True)]
    return assign.non_maximum(v.predd().select("sheet_id", F.row_number().over(order).cast("long").alias("rank"), *around))


PARTS = """inner_ AS (SELECT sheet_id, node FROM sym WHERE cls IN ('connector', 'crossing', 'arrow')), be AS (SELECT sheet_id, a, b FROM pair UNION SELECT sheet_id, b, a FROM pair),
  reach(sheet_id, node, root) AS (SELECT sheet_id, node, node FROM inner_ UNION SELECT r.sheet_id, be.b, r.root FROM reach r JOIN be ON be.sheet_id = r.sheet_id AND be.a = r.node JOIN inner_ i ON i.sheet_id = be.sheet_id AND i.node = be.b),
  parts AS (SELECT sheet_id, node, min(root) AS component FROM reach GROUP BY sheet_id, node)"""


@query("GRF_components", sql(f"AND {PARTS} SELECT * FROM parts", "sym", "pair", recursive=True))
def _(v: Views) -> DataFrame:
    inner = v.sym().where(F.col("cls").isin(*PASSING)).select("sheet_id", "node")
    e = v.edge().join(inner.withColumnRenamed("node", "a"), ["sheet_id", "a"], "left_semi").join(inner.withColumnRenamed("node", "b"), ["sheet_id", "b"], "left_semi")
    return graphs.components(inner, e)


CONTRACT_A = """touch AS (SELECT be.sheet_id, be.b AS node, component FROM be JOIN parts ON parts.node = be.a JOIN sym s ON s.node = be.b WHERE s.cls NOT IN ('connector', 'crossing', 'arrow')),
  style AS (SELECT p.sheet_id, component, max(CAST(dashed AS INTEGER)) AS d FROM pair p JOIN parts ON (parts.node = p.a OR parts.node = p.b) GROUP BY p.sheet_id, component),
  linked AS (SELECT DISTINCT x.sheet_id, x.node AS a, y.node AS b, style.d FROM touch x JOIN touch y ON x.component = y.component AND x.node < y.node JOIN style ON style.component = x.component
  UNION ALL SELECT p.sheet_id, a, b, CAST(dashed AS INTEGER) FROM pair p JOIN sym x ON x.node = a JOIN sym y ON y.node = b WHERE x.cls NOT IN ('connector', 'crossing', 'arrow') AND y.cls NOT IN ('connector', 'crossing', 'arrow'))"""


@query("GRF_01_contraction_a", sql(f"AND {PARTS}, {CONTRACT_A} SELECT sheet_id, a, b, CASE WHEN max(d) = 1 THEN 'dashed' ELSE 'solid' END AS line_type FROM linked GROUP BY sheet_id, a, b", "sym", "pair", recursive=True))
def _(v: Views) -> DataFrame:
    return graphs.contract_through(v.sym(), v.edge(), PASSING)


@query("GRF_02_contraction_b", sql("""AND deg AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM edge UNION ALL SELECT b FROM edge) GROUP BY node), kinds AS (SELECT s.sheet_id, s.node, cls = 'connector' OR (cls = 'crossing' AND coalesce(n, 0) <> 4) AS o, cls IN ('valve', 'instrumentation', 'tank', 'general') AS q FROM sym s LEFT JOIN deg ON deg.node = s.node),
  be AS (SELECT sheet_id, a, b FROM pair UNION SELECT sheet_id, b, a FROM pair), reach(sheet_id, node, root) AS (SELECT sheet_id, node, node FROM kinds WHERE o UNION SELECT r.sheet_id, be.b, r.root FROM reach r JOIN be ON be.a = r.node JOIN kinds k ON k.node = be.b AND k.o),
  parts AS (SELECT node, min(root) AS component FROM reach GROUP BY node), touch AS (SELECT DISTINCT be.sheet_id, be.b AS node, component FROM be JOIN parts ON parts.node = be.a JOIN kinds k ON k.node = be.b AND k.q)
  SELECT x.sheet_id, x.node AS a, y.node AS b FROM touch x JOIN touch y ON x.component = y.component AND x.node < y.node UNION SELECT p.sheet_id, a, b FROM pair p JOIN kinds x ON x.node = a AND x.q JOIN kinds y ON y.node = b AND y.q""", "sym", "edge", "pair", recursive=True))
def _(v: Views) -> DataFrame:
    return graphs.contract_equipment(v.sym(), v.edge(), ("valve", "instrumentation", "tank", "general"))


@query("GRF_03_noding")
def _(v: Views) -> DataFrame:
    return graphs.split_points(segments(v))


def segments(v: Views) -> DataFrame:
    own = lambda n, x, y: v.sym().select(F.col("node").alias(n), center(box())[0].alias(x), center(box())[1].alias(y))
    e = v.edge().select("sheet_id", "a", "b").distinct().join(own("a", "ax", "ay"), "a").join(own("b", "bx", "by"), "b")
    legs = F.posexplode(F.array(F.struct(F.col("ax").alias("ax"), F.col("ay").alias("ay"), F.col("bx").alias("bx"), F.col("ay").alias("by")), F.struct(F.col("bx").alias("ax"), F.col("ay").alias("ay"), F.col("bx").alias("bx"), F.col("by").alias("by"))))
    return e.select("sheet_id", "a", "b", legs.alias("leg", "l")).select("sheet_id", (F.col("a") * 200 + F.col("b") % 100 * 2 + F.col("leg")).alias("seg"), "l.*").where(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) > 1)


@query("GRF_04_endpoint_merge")
def _(v: Views) -> DataFrame:
    return graphs.merge_points(v.predd().select("sheet_id", F.col("pos").alias("node"), F.col("px").alias("x"), F.col("py").alias("y")))


@query("GRF_05_degree_two")
def _(v: Views) -> DataFrame:
    return graphs.degree_two_chains(v.edge(), v.sym().where(~F.col("cls").isin(*PASSING)))


@query("GRF_08_symbol_paths", sql("""AND be AS (SELECT sheet_id, a, b FROM pair UNION SELECT sheet_id, b, a FROM pair), w(sheet_id, source, node, hops, sym_) AS (SELECT sheet_id, node, node, 0, true FROM sym WHERE cls NOT IN ('connector', 'crossing')
  UNION SELECT w.sheet_id, w.source, be.b, w.hops + 1, s.cls NOT IN ('connector', 'crossing') FROM w JOIN be ON be.a = w.node JOIN sym s ON s.node = be.b WHERE w.hops < 4 AND (w.hops = 0 OR NOT w.sym_))
  SELECT sheet_id, least(source, node) AS a, greatest(source, node) AS b, min(hops) AS hops FROM w WHERE sym_ AND hops > 0 AND source <> node GROUP BY sheet_id, least(source, node), greatest(source, node)""", "sym", "pair", recursive=True))
def _(v: Views) -> DataFrame:
    nodes = v.sym().select("sheet_id", "node", (~F.col("cls").isin("connector", "crossing")).alias("symbol"))
    return graphs.symbol_paths(nodes, v.edge(), most=4)


@query("GRF_13_hierarchy")
def _(v: Views) -> DataFrame:
    nodes = v.symd()
    placed = graphs.containment_parents(nodes, EQUIPMENT, CHILDREN)
    near = graphs.adjacent_parents(nodes, v.edge(), placed, EQUIPMENT, CHILDREN)
    parents = nodes.select("sheet_id", "node", area(box()).alias("area")).join(placed.unionByName(near), ["sheet_id", "node"], "left")
    return assign.break_cycles(parents)


@query("GRF_14_break_cycles")
def _(v: Views) -> DataFrame:
    return assign.break_cycles(v.sym().select("sheet_id", "node", area(box()).alias("area")).join(v.parent(), ["sheet_id", "node"], "left"))


@query("GRF_17_entity_checks", sql("SELECT 'duplicate_tag' AS rule, sheet_id, tag AS what FROM sym GROUP BY sheet_id, tag HAVING count(*) > 1 UNION ALL SELECT 'wide', sheet_id, CAST(node AS VARCHAR) FROM sym WHERE x1 - x0 > 65", "sym"))
def _(v: Views) -> DataFrame:
    """Violations of invariants as rows."""
    twice = v.sym().groupBy("sheet_id", "tag").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_tag").alias("rule"), "sheet_id", F.col("tag").alias("what"))
    return twice.unionByName(v.sym().where(box().width > 65).select(F.lit("wide").alias("rule"), "sheet_id", F.col("node").cast("string").alias("what")))


@query("GRF_18_parent_pairs", sql("SELECT DISTINCT sheet_id, least(node, parent) AS a, greatest(node, parent) AS b FROM parent", "parent"))
def _(v: Views) -> DataFrame:
    return v.parent().select("sheet_id", F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b")).distinct()


KTYPE = "CASE {}.cls WHEN 'valve' THEN 'valve' WHEN 'instrumentation' THEN 'instrument' WHEN 'tank' THEN 'equipment' WHEN 'general' THEN 'equipment' ELSE 'other' END"
S34 = "nullif(regexp_extract({}.tag, '([0-9]{{3,4}})', 1), '')"


@query("GRF_19_worklist", sql(f"AND w AS (SELECT p.sheet_id, p.a, p.b, {KTYPE.format('x')} AS ta, {KTYPE.format('y')} AS tb, {S34.format('x')} <> {S34.format('y')} AS differ, sqrt(pow(greatest(0, y.x0 - x.x1, x.x0 - y.x1), 2) + pow(greatest(0, y.y0 - x.y1, x.y0 - y.y1), 2)) AS gap_px FROM pair p JOIN sym x ON x.node = p.a JOIN sym y ON y.node = p.b), f AS (SELECT *, coalesce(differ AND ((ta IN ('valve', 'instrument') AND tb = 'equipment') OR (tb IN ('valve', 'instrument') AND ta = 'equipment')), false) AS flagged FROM w) SELECT sheet_id, a, b, flagged, gap_px, row_number() OVER (PARTITION BY sheet_id ORDER BY flagged DESC, gap_px DESC, a, b) AS idx FROM f", "sym", "pair"))
def _(v: Views) -> DataFrame:
    """Claims to be looked at: those with contradicting loop numbers first, then by distance."""
    own = lambda n: v.sym().select(F.col("node").alias(n), F.col("tag").alias(f"t{n}"), mapped(F.col("cls"), AGENT_TYPES, "other").alias(f"k{n}"), *(c.alias(f"{n}_{f}") for f, c in zip(Box._fields, box(), strict=True)))
    e = graphs.canonical(v.edge().select("sheet_id", "a", "b")).distinct().join(own("a"), "a").join(own("b"), "b")
    rows = e.select("sheet_id", "a", "b", series_disagree(F.col("ta"), F.col("ka"), F.col("tb"), F.col("kb")).alias("flagged"), gap(box("a_"), box("b_")).alias("gap_px"))
    w = Window.partitionBy("sheet_id").orderBy(F.col("flagged").desc(), F.col("gap_px").desc(), "a", "b")
    return rows.withColumn("idx", F.row_number().over(w))
