"""Further queries: answers' lists, ports, relations, samples, sources and sinks, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetweave.functions import prompts
from sheetweave.functions.geometry import Box, box, center
from sheetweave.functions.text import AGENT_TYPES, alnum, mapped, temp_id, token_overlap
from sheetweave.operators import assign, graphs, metrics, raster, relations, spatial, tracing
from sheetweave.plans.fixtures import Views, issues_of, sql
from sheetweave.plans.join_queries import KTYPE, RANKED, hits, segments
from sheetweave.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, check: str | None = None):  # noqa: ANN201
    def keep(run: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: run(Views(spark, sf_dir, issues_of(check)))
        if check:
            SQL[name] = check
        return run

    return keep


# --- lists in answers ----------------------------------------------------------------------------------

@query("PRS_05_skid_members", sql("SELECT node, 't' || node AS target, CAST(CASE WHEN node % 2 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence FROM sym", "sym"))
def _(v: Views) -> DataFrame:
    """Items without a target are left out; confidence defaults to 0."""
    n = F.col("node")
    text = F.format_string('[{"target_temp_id": "t%d"%s}, {"confidence": 1.0}]', n, F.when(n % 2 == 0, ', "confidence": 0.5').otherwise(""))
    items = F.from_json(text, "array<struct<target_temp_id: string, confidence: double>>")
    return v.sym().select("node", F.explode(F.filter(items, lambda i: i["target_temp_id"].isNotNull())).alias("i")).select("node", F.col("i.target_temp_id").alias("target"), F.coalesce("i.confidence", F.lit(0.0)).alias("confidence"))


@query("PRS_12_groups", sql("SELECT sheet_id, node, CASE WHEN node % 3 = 0 THEN node ELSE node - node % 2 END AS grp FROM sym", "sym"))
def _(v: Views) -> DataFrame:
    """Groups as lists of lists; an answer that can't be read puts each alone."""
    n = F.col("node")
    text = F.when(n % 3 == 0, "none").otherwise(F.format_string("[[%d, %d], []]", n - n % 2, n))
    groups = F.from_json(text, "array<array<long>>")
    return v.sym().select("sheet_id", "node", F.coalesce(F.try_element_at(F.try_element_at(groups, F.lit(1)), F.lit(1)), n).alias("grp"))


@query("PRS_13_group_map", sql("SELECT sheet_id, CASE node % 4 WHEN 0 THEN 'SKID-1' WHEN 1 THEN 'SKID-2' ELSE 'n' || node END AS grp, count(*) AS n FROM sym GROUP BY 1, 2", "sym"))
def _(v: Views) -> DataFrame:
    """A map of symbols to skids: the two skids are pooled, all others stand alone."""
    n = F.col("node")
    text = F.to_json(F.create_map(n.cast("string"), F.element_at(F.array(F.lit("SKID-1"), F.lit("SKID-2"), F.lit("none"), F.lit("?")), (n % 4).cast("int") + 1)))
    kv = v.sym().select("sheet_id", F.explode(F.from_json(text, "map<string,string>")).alias("k", "s"))
    return kv.groupBy("sheet_id", F.when(F.col("s").isin("SKID-1", "SKID-2"), F.col("s")).otherwise(F.concat(F.lit("n"), "k")).alias("grp")).agg(F.count("*").alias("n"))


@query("PRS_15_verdict_lookup", sql("SELECT node, CASE WHEN node % 5 <> 0 THEN node % 2 = 0 END AS verdict, node % 5 = 0 AS missing FROM sym", "sym"))
def _(v: Views) -> DataFrame:
    """Answers are found again by what their prompt says."""
    n = F.col("node")
    prompt = F.format_string("Relation from p%d to q%d, confidence 0.%d", n, n + 1, n % 7 + 1)
    key = [F.regexp_extract(prompt, r"from (\S+) to", 1).alias("src"), F.regexp_extract(prompt, r"to (\S+),", 1).alias("dst"), F.bround(F.regexp_extract(prompt, r"confidence ([0-9.]+)", 1).cast("double"), 3).alias("conf")]
    said = v.sym().where("node % 5 <> 0").select(F.concat(F.lit("p"), n.cast("string")).alias("src"), F.concat(F.lit("q"), (n + 1).cast("string")).alias("dst"), F.bround((n % 7 + 1) / 10, 3).alias("conf"), (n % 2 == 0).alias("verdict"))
    return v.sym().select("node", *key).join(said, ["src", "dst", "conf"], "left").select("node", "verdict", F.col("verdict").isNull().alias("missing"))


# --- joins ---------------------------------------------------------------------------------------------

@query("JOI_02_ranked_greedy", sql(f"AND {RANKED} SELECT sheet_id, count(*) AS n FROM r WHERE conf IS NOT NULL GROUP BY sheet_id", "symd", "predd"))
def _(v: Views) -> DataFrame:
    return hits(v).groupBy("sheet_id").agg(F.count("*").alias("n"))


@query("JOI_12_seeds", sql("SELECT node, CASE WHEN node % 2 = 0 THEN x0 ELSE (x0 + x1) / 2 END AS sx FROM sym", "sym"))
def _(v: Views) -> DataFrame:
    return v.sym().select("node", F.coalesce(F.when(F.col("node") % 2 == 0, F.col("x0")), center(box())[0]).alias("sx"))


def ports(v: Views) -> DataFrame:
    return v.sym().where("cls = 'connector'").select("sheet_id", F.col("node").alias("port"), "tag", center(box())[0].alias("cx"), center(box())[1].alias("cy"))


@query("JOI_17_ports_to_loose_ends", sql("AND p AS (SELECT sheet_id, node AS port, tag, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM sym WHERE cls = 'connector'), n AS (SELECT p.sheet_id, port, tag, pos, px, py, row_number() OVER (PARTITION BY port ORDER BY pow(cx - px, 2) + pow(cy - py, 2), pos) AS r FROM p JOIN pred q ON q.sheet_id = p.sheet_id AND pow(cx - px, 2) + pow(cy - py, 2) <= 300 * 300) SELECT sheet_id, round(px) AS ex, round(py) AS ey, min(port) AS owner, string_agg(DISTINCT tag, ',' ORDER BY tag) AS refs FROM n WHERE r = 1 GROUP BY sheet_id, round(px), round(py)", "sym", "pred"))
def _(v: Views) -> DataFrame:
    """Ports at one loose end are one; the first owns it and has the references of all."""
    ends = v.pred().select("sheet_id", "pos", "px", "py")
    near = spatial.nearest(ports(v), ends, key=["port"], px=F.col("cx"), py=F.col("cy"), tx=F.col("px"), ty=F.col("py"), radius=300.0, tie=[F.col("pos")])
    return near.groupBy("sheet_id", F.round("px").alias("ex"), F.round("py").alias("ey")).agg(F.min("port").alias("owner"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("refs"))


@query("JOI_18_port_text_below", sql("AND p AS (SELECT sheet_id, node AS port, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM sym WHERE cls = 'connector') SELECT p.sheet_id, port, arg_min(pos, (abs((y0 + y1) / 2 - cy) + 0.25 * abs((x0 + x1) / 2 - cx), pos)) AS word FROM p JOIN word w ON w.sheet_id = p.sheet_id AND (y0 + y1) / 2 - cy BETWEEN 0 AND 90 AND abs((x0 + x1) / 2 - cx) <= 200 GROUP BY p.sheet_id, port", "sym", "word"))
def _(v: Views) -> DataFrame:
    """The cheapest text below a port; height counts four times as much as width."""
    x, y = center(box())
    w = v.word().select("sheet_id", "pos", x.alias("wx"), y.alias("wy"))
    reach = Box(F.col("cx") - 200, F.col("cy"), F.col("cx") + 200, F.col("cy") + 90)
    pairs = spatial.grid_join(ports(v), w, on=["sheet_id"], a=reach, b=spatial.at_point(F.col("wx"), F.col("wy")), cell=200.0)
    cost = F.abs(F.col("wy") - F.col("cy")) + 0.25 * F.abs(F.col("wx") - F.col("cx"))
    return spatial.smallest(pairs, key=["sheet_id", "port"], size=cost, tie=[F.col("pos")]).select("sheet_id", "port", F.col("pos").alias("word"))


@query("JOI_24_verdict_by_pair", sql("AND j AS (SELECT least(x.tag, y.tag) AS a, greatest(x.tag, y.tag) AS b, min((p.a + p.b) % 3) AS verdict FROM pair p JOIN sym x ON x.node = p.a JOIN sym y ON y.node = p.b GROUP BY 1, 2), c AS (SELECT DISTINCT claim.sheet_id, claim.kind, claim.a, claim.b, x.tag AS s, y.tag AS t FROM claim JOIN sym x ON x.node = claim.a JOIN sym y ON y.node = claim.b) SELECT c.sheet_id, c.kind, c.a, c.b, j.verdict FROM c LEFT JOIN j ON j.a = least(s, t) AND j.b = greatest(s, t)", "sym", "pair", "claim"))
def _(v: Views) -> DataFrame:
    """Verdicts by the unordered pair of texts."""
    own = lambda n: v.sym().select(F.col("node").alias(n), F.col("tag").alias(f"t{n}"))
    key = [F.least("ta", "tb").alias("u"), F.greatest("ta", "tb").alias("w")]
    said = v.edge().select("a", "b").distinct().join(own("a"), "a").join(own("b"), "b").groupBy(*key).agg(F.min((F.col("a") + F.col("b")) % 3).alias("verdict"))
    c = v.claim().join(own("a"), "a").join(own("b"), "b").select("sheet_id", "kind", "a", "b", *key)
    return c.join(said, ["u", "w"], "left").select("sheet_id", "kind", "a", "b", "verdict")


# --- metrics -------------------------------------------------------------------------------------------

@query("AGG_07_on_sheet_boundary", sql("AND c AS (SELECT DISTINCT sheet_id, least(a, b) AS a, greatest(a, b) AS b FROM claim), u AS (SELECT coalesce(c.sheet_id, p.sheet_id) AS sheet_id, coalesce(c.b, p.b) >= 1000000000000 AS boundary, c.a IS NOT NULL AS ic, p.a IS NOT NULL AS it FROM c FULL JOIN pair p ON p.sheet_id = c.sheet_id AND p.a = c.a AND p.b = c.b) SELECT sheet_id, count(*) FILTER (WHERE NOT boundary AND ic AND it) AS tp_on, count(*) FILTER (WHERE NOT boundary AND ic AND NOT it) AS fp_on, count(*) FILTER (WHERE NOT boundary AND it AND NOT ic) AS fn_on, count(*) FILTER (WHERE boundary AND ic AND NOT it) AS fp_boundary FROM u GROUP BY sheet_id", "claim", "pair"))
def _(v: Views) -> DataFrame:
    """On-sheet and boundary claims are scored apart and never added up."""
    c = graphs.canonical(v.claim().select("sheet_id", "a", "b")).distinct().withColumn("_c", F.lit(1))
    t = graphs.canonical(v.edge().select("sheet_id", "a", "b")).distinct().withColumn("_t", F.lit(1))
    ic, it, off = F.col("_c").isNotNull(), F.col("_t").isNotNull(), F.col("b") >= 1000000000000
    return c.join(t, ["sheet_id", "a", "b"], "full").groupBy("sheet_id").agg(F.count_if(~off & ic & it).alias("tp_on"), F.count_if(~off & ic & ~it).alias("fp_on"), F.count_if(~off & it & ~ic).alias("fn_on"), F.count_if(off & ic & ~it).alias("fp_boundary"))


@query("AGG_13_title_fields", sql("AND k AS (SELECT sheet_id, unnest(['number', 'title']) AS field, unnest([node % 2 = 0, true]) AS exact, unnest([node % 2 = 0, true]) AS loose FROM sym) SELECT field, avg(CAST(exact AS INTEGER)) AS exact, avg(CAST(loose AS INTEGER)) AS loose FROM k GROUP BY field", "sym"))
def _(v: Views) -> DataFrame:
    """Fields that match exactly after normalisation, and those of whose tokens 60 per cent are there."""
    n = F.col("node")
    rows = v.sym().select(F.when(n % 2 == 0, F.col("tag")).otherwise("zz").alias("p1"), F.col("tag").alias("t1"), F.concat("cls", F.lit(" line")).alias("p2"), F.concat("cls", F.lit(" LINE")).alias("t2"))
    long = rows.select(F.stack(F.lit(2), F.lit("number"), "p1", "t1", F.lit("title"), "p2", "t2").alias("field", "p", "t"))
    same = F.replace(F.lower(F.trim("p")), F.lit(" "), F.lit("")) == F.replace(F.lower(F.trim("t")), F.lit(" "), F.lit(""))
    return long.groupBy("field").agg(F.avg(same.cast("int")).alias("exact"), F.avg((token_overlap(F.col("p"), F.col("t")) >= 0.6).cast("int")).alias("loose"))


@query("AGG_15_renumbering", sql("SELECT sheet_id, sheet_id % 4 <> 0 AS consistent FROM sym GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    """Labels under a permutation, mapped back, make the same groups."""
    n, m = F.col("node"), F.col("node") % 100
    moved = v.sym().select("sheet_id", m.alias("i"), (m % 5).alias("g"), ((m * 7 + 3) % 100).alias("j"))
    after = v.sym().select("sheet_id", ((n % 100 - 3) * 43 % 100 + 100).alias("_i"), (n % 100).alias("j"))
    back = after.select("sheet_id", "j", ((F.col("_i") % 100) % 5 + F.when((F.col("sheet_id") % 4 == 0) & (F.col("j") == 3), 1).otherwise(0)).alias("h"))
    return moved.join(back, ["sheet_id", "j"]).groupBy("sheet_id").agg(F.bool_and(F.col("g") == F.col("h")).alias("consistent"))


@query("AGG_24_usage", "SELECT event_type AS model, count(*) AS calls, sum(value) - min(value) AS delta FROM events GROUP BY event_type")
def _(v: Views) -> DataFrame:
    return v.table("events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), (F.sum("value") - F.min("value")).alias("delta"))


@query("AGG_27_pre_post", sql("SELECT sheet_id, count(*) FILTER (WHERE node % 3 = 0) AS pre_hit, count(*) FILTER (WHERE node % 3 <> 0) AS pre_miss, count(*) FILTER (WHERE node % 3 = 0 AND node % 4 <> 0) AS post_hit, count(*) FILTER (WHERE node % 3 <> 0 AND node % 4 <> 0) AS post_miss FROM sym GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    hit, kept = F.col("node") % 3 == 0, F.col("_k").isNotNull()
    k = v.sym().where("node % 4 <> 0").select("node", F.lit(1).alias("_k"))
    return v.sym().join(k, "node", "left").groupBy("sheet_id").agg(F.count_if(hit).alias("pre_hit"), F.count_if(~hit).alias("pre_miss"), F.count_if(hit & kept).alias("post_hit"), F.count_if(~hit & kept).alias("post_miss"))


# --- windows, sets, samples ----------------------------------------------------------------------------

D2 = "pow(px - (x0 + x1) / 2, 2) + pow(py - (y0 + y1) / 2, 2)"


@query("WIN_07_top_k", sql(f"SELECT sheet_id, pos, wpos, r AS rank FROM (SELECT p.sheet_id, p.pos, w.pos AS wpos, row_number() OVER (PARTITION BY p.sheet_id, p.pos ORDER BY {D2}, w.pos) AS r FROM pred p JOIN word w ON w.sheet_id = p.sheet_id AND {D2} <= 400 * 400) WHERE r <= 3", "sym", "pred", "word"))
def _(v: Views) -> DataFrame:
    x, y = center(box())
    w = v.word().select("sheet_id", F.col("pos").alias("wpos"), x.alias("wx"), y.alias("wy"))
    return spatial.nearest(v.pred(), w, key=["pos"], px=F.col("px"), py=F.col("py"), tx=F.col("wx"), ty=F.col("wy"), radius=400.0, tie=[F.col("wpos")], k=3).select("sheet_id", "pos", "wpos", F.col("_rank").alias("rank"))


@query("WIN_09_shortest_per_terminal", sql("AND k AS (SELECT sheet_id, a, b, (a + b) % 5 AS n, min((a + b) % 5) OVER (PARTITION BY sheet_id, a) AS bar FROM pair) SELECT sheet_id, a, b, n FROM k WHERE n = bar", "pair"))
def _(v: Views) -> DataFrame:
    e = graphs.canonical(v.edge().select("sheet_id", "a", "b")).distinct().withColumn("n", (F.col("a") + F.col("b")) % 5)
    return e.withColumn("bar", F.min("n").over(Window.partitionBy("sheet_id", "a"))).where("n = bar").drop("bar")


@query("WIN_12_hash_split")
def _(v: Views) -> DataFrame:
    """A reproducible split by a seeded hash of the id."""
    return v.sym().select("node", F.when(F.pmod(F.xxhash64("node", F.lit(42)), F.lit(10)) < 2, "val").otherwise("train").alias("split"))


@query("SET_04_delta", sql("AND c AS (SELECT DISTINCT sheet_id, least(a, b) AS a, greatest(a, b) AS b FROM claim WHERE b < 1000000000000 AND kind <> 'feeds') SELECT *, 'dropped' AS change FROM (SELECT sheet_id, a, b FROM pair EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'added' FROM (SELECT * FROM c EXCEPT SELECT sheet_id, a, b FROM pair WHERE NOT dashed)", "pair", "claim"))
def _(v: Views) -> DataFrame:
    marked = graphs.canonical(v.edge()).groupBy("sheet_id", "a", "b").agg(F.bool_or(F.col("line_type") == "dashed").alias("dashed"))
    e, solid = (marked.where(w).select("sheet_id", "a", "b") for w in ("true", "not dashed"))
    c = graphs.canonical(v.claim().where("b < 1000000000000 and kind <> 'feeds'").select("sheet_id", "a", "b")).distinct()
    return e.subtract(c).withColumn("change", F.lit("dropped")).unionByName(c.subtract(solid).withColumn("change", F.lit("added")))


@query("SET_07_negatives", sql("AND k AS (SELECT count(*) FILTER (WHERE cls = 'valve') AS p FROM sym), n AS (SELECT node, row_number() OVER (ORDER BY node) AS r FROM sym WHERE cls = 'connector') SELECT node FROM n, k WHERE r <= floor(p * 0.2 / 0.8)", "sym"))
def _(v: Views) -> DataFrame:
    """As many negatives as make up a share of one fifth, by rank; only the number of positives is gathered."""
    want = v.sym().where("cls = 'valve'").agg(F.floor(F.count("*") * 0.2 / 0.8).alias("want"))
    n = v.sym().where("cls = 'connector'").select("sheet_id", "node")
    before = n.groupBy("sheet_id").agg(F.count("*").alias("m"))
    before = before.withColumn("base", F.coalesce(F.sum("m").over(Window.orderBy("sheet_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("sheet_id", "base")
    r = F.row_number().over(Window.partitionBy("sheet_id").orderBy("node")) + F.col("base")
    return n.join(before, "sheet_id").withColumn("r", r).join(F.broadcast(want), F.col("r") <= F.col("want")).select("node")


@query("TILE_04_manifest", sql("SELECT 'sheet_' || sheet_id AS id, CASE WHEN sheet_id % 5 = 0 THEN 'test' ELSE 'train' END AS source, count(*) AS n FROM sym GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    n = v.sym().groupBy("sheet_id").agg(F.count("*").alias("n"))
    row = lambda part, src: n.where(part).select(F.concat(F.lit("sheet_"), F.col("sheet_id").cast("string")).alias("id"), F.lit(src).alias("source"), "n")
    return row("sheet_id % 5 = 0", "test").unionByName(row("sheet_id % 5 <> 0", "train"))


@query("GEN_01_pairs", sql("SELECT x.sheet_id, x.node AS a, y.node AS b FROM sym x JOIN sym y ON x.sheet_id = y.sheet_id AND x.node % 25 = y.node % 25 AND x.node < y.node", "sym"))
def _(v: Views) -> DataFrame:
    return graphs.cliques(v.sym().select("sheet_id", "node", (F.col("node") % 25).alias("component"))).select("sheet_id", "a", "b")


@query("GEN_02_samples", sql("SELECT node, unnest(range(5)) AS i, x0 + (x1 - x0) * unnest(range(5)) / 4 AS x FROM sym", "sym"))
def _(v: Views) -> DataFrame:
    """Evenly spaced points from one end of a line to the other."""
    return v.sym().select("node", "x0", "x1", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("node", "i", (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / 4).alias("x"))


@query("STR_14_locate_tag", sql("SELECT sheet_id, node, (x0 + x1) / 2 + node * 37 % 160 - 40 AS x FROM sym", "sym"))
def _(v: Views) -> DataFrame:
    """A tag in up to six words that follow each other: the mean of the corners of the first, shortest run that holds it."""
    w = Window.partitionBy("sheet_id").orderBy("pos").rowsBetween(Window.currentRow, 5)
    runs = v.word().select("sheet_id", "pos", F.collect_list(F.struct("text", center(box())[0].alias("x"))).over(w).alias("run"))
    tags = v.sym().select("sheet_id", "node", "tag")
    joined = tags.join(runs, (tags["sheet_id"] == runs["sheet_id"]) & (F.col("node") == F.col("pos"))).select(tags["sheet_id"], "node", "tag", "run")
    length = lambda k: F.array_join(F.transform(F.slice("run", 1, k), lambda s: alnum(s["text"])), "").contains(alnum(F.col("tag")))
    first = F.coalesce(*(F.when(length(k), F.lit(k)) for k in range(1, 7)))
    mean = F.aggregate(F.slice("run", F.lit(1), first), F.lit(0.0), lambda a, s: a + s["x"]) / first
    return joined.select("sheet_id", "node", mean.alias("x"))


# --- relations -----------------------------------------------------------------------------------------

@query("GRF_07_adjacency", sql("SELECT sheet_id, a AS node, count(DISTINCT b) AS degree FROM (SELECT sheet_id, a, b FROM edge UNION ALL SELECT sheet_id, b, a FROM edge) GROUP BY sheet_id, a", "edge"))
def _(v: Views) -> DataFrame:
    e = v.edge().select("sheet_id", "a", "b")
    return e.unionByName(e.select("sheet_id", F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("sheet_id", F.col("a").alias("node")).agg(F.count_distinct("b").alias("degree"))


def candidates(v: Views) -> DataFrame:
    nodes = v.sym().select("sheet_id", "node", mapped(F.col("cls"), AGENT_TYPES, "other").alias("cls"), (F.col("node") % 7 == 0).alias("terminal"), *box())
    e = v.edge().select("sheet_id", "a", "b").distinct()
    k = (F.col("a") + F.col("b")) % 5
    return relations.build_relations(nodes, e.where(k == 0), e.where(k == 1), e.where(k >= 2).withColumn("n_segments", (F.col("a") * 3 + F.col("b")) % 11 + 1), children=("valve", "instrument"), hosts=("equipment",), most_segments=8, most_segments_boundary=9, most_gap=1500.0)


RELATIONS = f"""e AS (SELECT DISTINCT sheet_id, least(a, b) AS a, greatest(a, b) AS b, CASE (a + b) % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS pass_no, CASE WHEN (a + b) % 5 >= 2 THEN (a * 3 + b) % 11 + 1 ELSE 0 END AS n FROM edge),
  g AS (SELECT sheet_id, a, b, pass_no, min(n) AS n FROM e GROUP BY sheet_id, a, b, pass_no),
  k AS (SELECT g.*, {KTYPE.format('x')} AS ca, {KTYPE.format('y')} AS cb, a % 7 = 0 AS ta, b % 7 = 0 AS tb, sqrt(pow(greatest(0, y.x0 - x.x1, x.x0 - y.x1), 2) + pow(greatest(0, y.y0 - x.y1, x.y0 - y.y1), 2)) AS gap FROM g JOIN sym x ON x.node = a JOIN sym y ON y.node = b),
  f AS (SELECT *, CASE WHEN ta <> tb AND pass_no = 2 THEN CASE WHEN ta THEN a ELSE b END END AS port FROM k WHERE pass_no < 2 OR n <= CASE WHEN ta <> tb THEN 9 ELSE 8 END),
  bar AS (SELECT port, min(n) AS bar FROM f WHERE port IS NOT NULL GROUP BY port),
  hosted AS (SELECT a AS child FROM f WHERE pass_no < 2 AND NOT (ta AND tb) AND ca IN ('valve', 'instrument') AND cb = 'equipment' UNION SELECT b FROM f WHERE pass_no < 2 AND NOT (ta AND tb) AND cb IN ('valve', 'instrument') AND ca = 'equipment'),
  v AS (SELECT sheet_id, a, b, pass_no, n AS n_segments, CASE WHEN ta AND tb THEN 'terminal_pair' WHEN coalesce(n > bar, false) THEN 'far_terminal' WHEN pass_no > min(pass_no) OVER (PARTITION BY sheet_id, a, b) THEN 'other_evidence'
    WHEN pass_no = 2 AND ((ca IN ('valve', 'instrument') AND cb = 'equipment' AND a IN (FROM hosted)) OR (cb IN ('valve', 'instrument') AND ca = 'equipment' AND b IN (FROM hosted))) THEN 'single_host'
    WHEN pass_no = 2 AND ta = tb AND gap > 1500 THEN 'distance_cap' WHEN ca IN ('valve', 'instrument') AND cb IN ('valve', 'instrument') AND pass_no > 0 THEN 'child_child' ELSE 'kept' END AS verdict FROM f LEFT JOIN bar USING (port))"""


@query("GRF_09_topology", sql(f"AND {RELATIONS} SELECT * FROM v WHERE verdict <> 'other_evidence'", "sym", "edge"))
def _(v: Views) -> DataFrame:
    return candidates(v)


@query("GRF_12_relations", sql(f"AND {RELATIONS} SELECT sheet_id, a, b, min(pass_no) AS pass_no, (a % 7 = 0) <> (b % 7 = 0) AS boundary FROM v WHERE verdict = 'kept' GROUP BY sheet_id, a, b", "sym", "edge"))
def _(v: Views) -> DataFrame:
    return relations.relations(candidates(v)).select("sheet_id", "a", "b", "pass_no", ((F.col("a") % 7 == 0) != (F.col("b") % 7 == 0)).alias("boundary"))


@query("GRF_15_classify_tags", sql(f"""AND k AS (SELECT sheet_id, node, CASE WHEN node % 3 = 0 THEN 'T' || (node % 20) ELSE tag END AS text, CASE WHEN cls = 'connector' THEN 'line' ELSE {KTYPE.format('s')} END AS type, x0, y0, x1 + node % 2 * 80 AS x1, y1 FROM sym s),
  z AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, CASE WHEN (x0 + x1) / 2 < 0.16 * 4200 OR (x0 + x1) / 2 > 0.84 * 4200 THEN 'side' WHEN (y0 + y1) / 2 < 320 OR (y0 + y1) / 2 > 2880 THEN 'edge' ELSE 'body' END AS zone, y1 - y0 < 35 AND (x1 - x0) / (y1 - y0) >= 2.5 AS flat FROM k),
  p AS (SELECT *, CASE WHEN type = 'line' THEN 'label' WHEN zone <> 'body' AND EXISTS (SELECT 1 FROM z o WHERE o.sheet_id = z.sheet_id AND o.text = z.text AND o.zone = 'body' AND o.type <> 'line') THEN 'schedule' WHEN type = 'equipment' AND zone = 'side' THEN 'port' ELSE 'symbol' END AS pile FROM z)
  SELECT sheet_id, node, text, CASE WHEN pile = 'symbol' AND flat AND EXISTS (SELECT 1 FROM p o WHERE o.sheet_id = p.sheet_id AND o.text = p.text AND o.pile = 'symbol' AND NOT o.flat) THEN 'duplicate' ELSE pile END AS pile FROM p""", "sym"))
def _(v: Views) -> DataFrame:
    n = F.col("node")
    kind = F.when(F.col("cls") == "connector", "line").otherwise(mapped(F.col("cls"), AGENT_TYPES, "other"))
    tags = v.sym().select("sheet_id", "node", F.when(n % 3 == 0, F.concat(F.lit("T"), (n % 20).cast("string"))).otherwise(F.col("tag")).alias("text"), kind.alias("type"), "x0", "y0", (F.col("x1") + n % 2 * 80).alias("x1"), "y1")
    return relations.classify_tags(tags, page_w=F.lit(4200.0), page_h=F.lit(3200.0))


@query("GRF_16_detect_ports", sql("""AND seed AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM word WHERE regexp_matches(text, '^[A-Z]{3}-[0-9]{4}') AND ((x0 + x1) / 2 < 672 OR (x0 + x1) / 2 > 3528)),
  best AS (SELECT s.pos, arg_min(d.node, ((d.x1 - d.x0) * (d.y1 - d.y0), d.node)) AS node FROM seed s JOIN sym d ON d.sheet_id = s.sheet_id AND cx BETWEEN d.x0 - 3 AND d.x1 + 3 AND cy BETWEEN d.y0 - 3 AND d.y1 + 3 GROUP BY s.pos),
  p AS (SELECT s.sheet_id, s.pos, s.text, cx, cy, coalesce(d.x0, s.x0) AS x0, coalesce(d.y0, s.y0) AS y0, coalesce(d.x1, s.x1) AS x1, coalesce(d.y1, s.y1) AS y1 FROM seed s LEFT JOIN best USING (pos) LEFT JOIN sym d ON d.node = best.node),
  m AS (SELECT sheet_id, list_sort(list(x1 - x0))[count(*) // 2 + 1] AS med FROM p GROUP BY sheet_id),
  r AS (SELECT p.pos, arg_min(w.pos, (abs((w.y0 + w.y1) / 2 - cy) + 0.25 * abs((w.x0 + w.x1) / 2 - cx), w.pos)) AS ref FROM p JOIN word w ON w.sheet_id = p.sheet_id AND w.pos <> p.pos AND (w.y0 + w.y1) / 2 - cy BETWEEN 0 AND 90 AND abs((w.x0 + w.x1) / 2 - cx) <= 200 GROUP BY p.pos)
  SELECT p.sheet_id, p.pos, text, CASE WHEN x1 - x0 > 2 * med THEN cx - med / 2 ELSE x0 END AS x0, y0, CASE WHEN x1 - x0 > 2 * med THEN cx + med / 2 ELSE x1 END AS x1, y1, ref FROM p JOIN m USING (sheet_id) LEFT JOIN r ON r.pos = p.pos""", "sym", "word"))
def _(v: Views) -> DataFrame:
    return relations.detect_ports(v.word(), v.sym(), page_w=4200.0, page_h=3200.0, pattern="^[A-Z]{3}-[0-9]{4}")


@query("PRS_17_fallback", sql("SELECT node, CASE node % 5 WHEN 0 THEN '{\"keep\":' || (node % 2 = 0) || ',\"confidence\":0.5}' WHEN 1 THEN '{\"keep\":false,\"confidence\":0.5}' ELSE '{}' END AS payload FROM answer", "answer"))
def _(v: Views) -> DataFrame:
    return v.answer().select("node", prompts.fallback(F.col("text"), "keep").alias("payload"))


@query("AGG_26_crop_coverage", sql("SELECT sheet_id, count(*) AS items, count(*) FILTER (WHERE greatest(x1, x0 + node % 900) - x0 <= 400) AS covered FROM sym GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    """Items whose crop stays within the largest size."""
    span = F.greatest(F.col("x1"), F.col("x0") + F.col("node") % 900) - F.col("x0")
    return v.sym().groupBy("sheet_id").agg(F.count("*").alias("items"), F.count_if(span <= 400).alias("covered"))


@query("GRF_20_agreement_sets", sql(f"AND {RELATIONS}, kept AS (SELECT DISTINCT sheet_id, a, b FROM v WHERE verdict = 'kept'), c AS (SELECT DISTINCT sheet_id, least(a, b) AS a, greatest(a, b) AS b FROM claim WHERE b < 1000000000000) SELECT coalesce(k.sheet_id, c.sheet_id) AS sheet_id, coalesce(k.a, c.a) AS a, coalesce(k.b, c.b) AS b, CASE WHEN k.a IS NULL THEN 'llm_only' WHEN c.a IS NULL THEN 'geometry_only' ELSE 'agreed' END AS category FROM kept k FULL JOIN c ON c.sheet_id = k.sheet_id AND c.a = k.a AND c.b = k.b", "sym", "edge", "claim"))
def _(v: Views) -> DataFrame:
    k = relations.relations(candidates(v)).select("sheet_id", "a", "b", F.lit(1).alias("_k"))
    c = graphs.canonical(v.claim().where("b < 1000000000000").select("sheet_id", "a", "b")).distinct().withColumn("_c", F.lit(1))
    category = F.when(F.col("_k").isNull(), "llm_only").when(F.col("_c").isNull(), "geometry_only").otherwise("agreed")
    return k.join(c, ["sheet_id", "a", "b"], "full").select("sheet_id", "a", "b", category.alias("category"))


@query("GRF_21_detections_to_entities", sql("SELECT sheet_id, printf('p%d_e%04d', sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY node) - 1) AS id, tag AS name FROM sym WHERE node % 6 <> 0", "sym"))
def _(v: Views) -> DataFrame:
    """Detections without a name or a box are left out; ids run over the rest."""
    named = v.sym().withColumn("name", F.when(F.col("node") % 6 != 0, F.col("tag"))).where("name is not null and x0 is not null")
    return named.select("sheet_id", temp_id(F.col("sheet_id"), F.row_number().over(Window.partitionBy("sheet_id").orderBy("node")) - 1).alias("id"), "name")


@query("GRF_06_vector_page_graph")
def _(v: Views) -> DataFrame:
    return graphs.vector_page_graph(segments(v), v.sym())[1]


@query("GRF_06_clip", sql("AND a AS (SELECT sheet_id, count(*) AS n, min((x0 + x1) / 2) AS lx, max((x0 + x1) / 2) AS hx, min((y0 + y1) / 2) AS ly, max((y0 + y1) / 2) AS hy FROM sym WHERE cls <> 'connector' GROUP BY sheet_id), p AS (SELECT *, 0.03 * greatest(hx - lx, hy - ly) AS pad FROM a) SELECT s.sheet_id, s.node FROM sym s LEFT JOIN p USING (sheet_id) WHERE coalesce(n, 0) < 8 OR (s.x0 BETWEEN lx - pad AND hx + pad AND (s.y0 + s.y1) / 2 BETWEEN ly - pad AND hy + pad)", "sym"))
def _(v: Views) -> DataFrame:
    """Lines to the left of symbols, clipped to the area of the symbols that aren't connectors."""
    x, y = F.col("x0"), (F.col("y0") + F.col("y1")) / 2
    lines = v.sym().select("sheet_id", F.col("node").alias("seg"), (x - 15).alias("ax"), y.alias("ay"), (x + 15).alias("bx"), y.alias("by"))
    return graphs.clipped(lines, v.sym().where("cls <> 'connector'")).select("sheet_id", F.col("seg").alias("node"))


@query("GRF_10_effective_symbol", sql("SELECT sheet_id, a, b, CASE WHEN a % 3 = 0 THEN a WHEN a % 3 = 1 THEN b END AS symbol FROM pair", "pair"))
def _(v: Views) -> DataFrame:
    """An end's own symbol, else the one its junction belongs to."""
    a, b = F.col("a"), F.col("b")
    return graphs.canonical(v.edge().select("sheet_id", "a", "b")).distinct().select("sheet_id", "a", "b", F.coalesce(F.when(a % 3 == 0, a), F.when(a % 3 == 1, b)).alias("symbol"))


@query("GRF_11_traced_relations")
def _(v: Views) -> DataFrame:
    """The first pipeline: lines to a page graph, and symbols that it connects."""
    nodes, edges = graphs.vector_page_graph(segments(v), v.sym())
    return graphs.symbol_paths(nodes.select("sheet_id", "node", F.col("symbol").isNotNull().alias("symbol")), edges, most=8)


@query("GRF_22_skid_relations", sql("SELECT DISTINCT sheet_id, a AS asset, b AS member FROM pair WHERE a % 4 = 0", "pair"))
def _(v: Views) -> DataFrame:
    """Groups keyed by asset, as a map and back to pairs."""
    e = graphs.canonical(v.edge().select("sheet_id", "a", "b")).distinct().where("a % 4 = 0")
    side = e.groupBy("sheet_id", "a").agg(F.array_sort(F.collect_list("b")).alias("m")).groupBy("sheet_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "m"))).alias("groups"))
    return side.select("sheet_id", F.explode("groups").alias("asset", "m")).select("sheet_id", "asset", F.explode("m").alias("member"))


# --- sources and sinks ---------------------------------------------------------------------------------

@query("SRC_06_07_yolo", sql("SELECT sheet_id, node, CASE WHEN node % 4 = 3 THEN 'class_3' ELSE ['a', 'b', 'c'][node % 4 + 1] END AS cls, CAST(round(x0 * 1000) AS BIGINT) AS mx0, CAST(round(y1 * 1000) AS BIGINT) AS my1 FROM sym WHERE node % 10 <> 9", "sym"))
def _(v: Views) -> DataFrame:
    """Lines of labels; one of ten is cut off and left out."""
    b, n = box(), F.col("node")
    whole = F.concat_ws(" ", (n % 4).cast("string"), *(x.cast("string") for x in (center(b)[0] / 4096, center(b)[1] / 4096, b.width / 4096, b.height / 4096)))
    lines = v.sym().select("node", "sheet_id", F.when(n % 10 == 9, "1 0.5").otherwise(whole).alias("value"))
    boxes = readers.yolo(lines.withColumn("sheet_id", F.struct("sheet_id", "node")), 4096, 4096)
    names = v.spark.sql("SELECT * FROM VALUES (0, 'a'), (1, 'b'), (2, 'c') AS t(cls_id, cls)")
    return readers.named(boxes, names).select("sheet_id.sheet_id", "sheet_id.node", "cls", F.round(F.col("x0") * 1000).cast("long").alias("mx0"), F.round(F.col("y1") * 1000).cast("long").alias("my1"))


@query("SRC_14_word_filter", sql("SELECT sheet_id, pos FROM word WHERE regexp_matches(text, '^PSV-[0-9]{4}') AND (x0 < 672 OR x1 > 3528)", "word"))
def _(v: Views) -> DataFrame:
    return v.word().where(F.col("text").rlike("^PSV-[0-9]{4}") & ((F.col("x0") < 672) | (F.col("x1") > 3528))).select("sheet_id", "pos")


@query("SRC_15_16_ocr_words", sql("AND k AS (SELECT sheet_id, pos, text, x0 + 819 AS x0, y1, row_number() OVER (PARTITION BY sheet_id ORDER BY pos) - 1 AS r FROM word WHERE sheet_id % 7 <> 0) SELECT sheet_id, r AS pos, text, x0, y1, false AS parse_failed FROM k UNION ALL SELECT DISTINCT sheet_id, NULL, NULL, NULL, NULL, true FROM word WHERE sheet_id % 7 = 0", "word"))
def _(v: Views) -> DataFrame:
    """Parallel arrays of a tile's words; where their lengths differ the answer is a failed one."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "text", *box())))
    r = v.word().groupBy("sheet_id").agg(rows.alias("r"))
    texts = F.transform("r", lambda s: s["text"])
    r = r.select("sheet_id", F.when(F.col("sheet_id") % 7 == 0, F.slice(texts, 1, 2)).otherwise(texts).alias("texts"), F.transform("r", lambda s: F.lit(0.9)).alias("scores"), F.transform("r", lambda s: F.array(s["x0"], s["y0"], s["x1"], s["y1"])).alias("boxes"), F.lit(819).alias("dx"), F.lit(0).alias("dy"))
    return readers.ocr_words(r).select("sheet_id", "pos", "text", "x0", "y1", "parse_failed")


@query("SRC_17_18_entities", sql(f"SELECT node, 'hand' AS extent_source, (x0 + x1) / 2 / 4200 AS cx, {KTYPE.format('s')} AS type FROM sym s", "sym"))
def _(v: Views) -> DataFrame:
    return v.sym().select("node", F.lit("hand").alias("extent_source"), (center(box())[0] / 4200).alias("cx"), mapped(F.col("cls"), AGENT_TYPES, "other").alias("type"))


@query("SRC_19_20_stem_join", sql("SELECT 'labels/s' || sheet_id || '.txt' AS label, 'images/s' || sheet_id || '.png' AS image FROM sym WHERE sheet_id % 2 = 0 GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    """Labels and images by their common stem, the first image of each."""
    s = v.sym().select(F.col("sheet_id").cast("string").alias("s")).distinct()
    labels = s.select(F.concat(F.lit("labels/s"), "s", F.lit(".txt")).alias("label")).withColumn("stem", readers.sheet_of(F.col("label")))
    images = s.where("s % 2 = 0").select(F.explode(F.array(F.concat(F.lit("images/s"), "s", F.lit(".png")), F.concat(F.lit("images2/s"), "s", F.lit(".png")))).alias("image")).withColumn("stem", readers.sheet_of(F.col("image"))).groupBy("stem").agg(F.min("image").alias("image"))
    return labels.join(images, "stem").select("label", "image")


@query("SRC_21_sample", sql("SELECT sheet_id, n FROM (SELECT sheet_id, count(*) AS n FROM pred GROUP BY sheet_id) WHERE n BETWEEN 30 AND 500 ORDER BY sheet_id LIMIT 1", "sym", "pred"))
def _(v: Views) -> DataFrame:
    return v.pred().groupBy("sheet_id").agg(F.count("*").alias("n")).where("n between 30 and 500").orderBy("sheet_id").limit(1)


@query("SNK_02_worklist_document", sql("SELECT sheet_id, a, b, row_number() OVER (PARTITION BY sheet_id ORDER BY a, b) AS idx FROM pair", "pair"))
def _(v: Views) -> DataFrame:
    """Items go into one JSON document for each sheet and come back."""
    e = graphs.canonical(v.edge().select("sheet_id", "a", "b")).distinct()
    items = e.withColumn("idx", F.row_number().over(Window.partitionBy("sheet_id").orderBy("a", "b")).cast("long"))
    return sinks.read_worklist(sinks.worklist_document(items), "a: long, b: long, idx: long")


@query("SNK_06_draw_list", sql("SELECT sheet_id, node, CASE WHEN node % 2 = 0 THEN 'green' ELSE 'red' END AS color, x0 - 40 AS cx0, y0 - 40 AS cy0, x1 + 40 AS cx1, y1 + 40 AS cy1 FROM sym", "sym"))
def _(v: Views) -> DataFrame:
    return sinks.draw_list(v.sym(), F.when(F.col("node") % 2 == 0, "green").otherwise("red"))


@query("SNK_07_report", sql("SELECT cls AS stratum, cls || ': P=0.500 R=1.000 F1=0.667 (tp=' || count(*) || ' fp=' || count(*) || ' fn=0)' AS line FROM sym GROUP BY cls", "sym"))
def _(v: Views) -> DataFrame:
    n = v.sym().groupBy(F.col("cls").alias("stratum")).agg(F.count("*").alias("tp"), F.count("*").alias("fp"), F.lit(0).cast("long").alias("fn"))
    return sinks.report(metrics.plain(n))


# --- raster --------------------------------------------------------------------------------------------

def outlines(v: Views) -> DataFrame:
    """A small raster for each sheet: ink where a symbol's borders are, a sixteenth of the size. Pixels of several borders are listed as often."""
    b = [F.floor(c / 16).cast("int") for c in box()]
    level = F.explode(F.sequence(b[0], b[2]))
    top = v.sym().select("sheet_id", b[1].alias("u"), b[3].alias("w"), level.alias("x")).select("sheet_id", "x", F.explode(F.array("u", "w")).alias("y"))
    side = v.sym().select("sheet_id", b[0].alias("u"), b[2].alias("w"), F.explode(F.sequence(b[1], b[3])).alias("y")).select("sheet_id", F.explode(F.array("u", "w")).alias("x"), "y")
    return top.unionByName(side)


def pixels(v: Views) -> DataFrame:
    return outlines(v).distinct()


INK = "ink AS (SELECT sheet_id, unnest(range(CAST(floor(x0 / 16) AS BIGINT), CAST(floor(x1 / 16) AS BIGINT) + 1)) AS x, CAST(floor(y0 / 16) AS BIGINT) AS y FROM sym UNION SELECT sheet_id, unnest(range(CAST(floor(x0 / 16) AS BIGINT), CAST(floor(x1 / 16) AS BIGINT) + 1)), CAST(floor(y1 / 16) AS BIGINT) FROM sym UNION SELECT sheet_id, CAST(floor(x0 / 16) AS BIGINT), unnest(range(CAST(floor(y0 / 16) AS BIGINT), CAST(floor(y1 / 16) AS BIGINT) + 1)) FROM sym UNION SELECT sheet_id, CAST(floor(x1 / 16) AS BIGINT), unnest(range(CAST(floor(y0 / 16) AS BIGINT), CAST(floor(y1 / 16) AS BIGINT) + 1)) FROM sym)"


@query("RAS_02_mask", sql(f"AND {INK} SELECT sheet_id, count(*) AS n FROM ink WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.sheet_id = ink.sheet_id AND s.node % 3 = 0 AND ink.x BETWEEN s.x0 / 16 - 1 AND s.x1 / 16 + 1 AND ink.y BETWEEN s.y0 / 16 - 1 AND s.y1 / 16 + 1) GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    masks = v.sym().where("node % 3 = 0").select("sheet_id", *((c / 16).alias(f"m_{n}") for n, c in zip(Box._fields, box(), strict=True)))
    return raster.masked(pixels(v), masks, pad=1.0).groupBy("sheet_id").agg(F.count("*").alias("n"))


@query("RAS_04_junction_pixels", sql(f"AND {INK} SELECT p.sheet_id, p.x, p.y, count(*) AS n FROM ink p JOIN ink q ON q.sheet_id = p.sheet_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND (q.x <> p.x OR q.y <> p.y) GROUP BY p.sheet_id, p.x, p.y HAVING count(*) >= 3", "sym"))
def _(v: Views) -> DataFrame:
    return raster.junction_pixels(outlines(v))


@query("RAS_05_junction_kind", sql("SELECT node, CASE WHEN node % 7 <= 2 THEN NULL WHEN node % 7 = 3 THEN 'tee' WHEN node % 7 = 4 THEN 'cross' ELSE 'joint' END AS kind, node % 7 = 4 AS ambiguous FROM sym", "sym"))
def _(v: Views) -> DataFrame:
    return v.sym().select("node", raster.junction_kind(F.col("node") % 7).alias("kind"), (F.col("node") % 7 == 4).alias("ambiguous"))


@query("RAS_07_stroke_runs", sql(f"AND {INK}, s AS (SELECT sheet_id, y, x, x - row_number() OVER (PARTITION BY sheet_id, y ORDER BY x) AS g FROM ink), r AS (SELECT sheet_id, y, g, count(*) AS n FROM s GROUP BY sheet_id, y, g) SELECT sheet_id, count(*) AS runs, max(n) AS longest FROM r GROUP BY sheet_id", "sym"))
def _(v: Views) -> DataFrame:
    return raster.runs(pixels(v)).groupBy("sheet_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


def traced(v: Views) -> DataFrame:
    """The line graphs of drawn pages, one for each sheet of parts."""
    one = Views(v.spark, v.sf_dir, 1)
    return tracing.trace_pages(one.pages(), one.sym(1200, 900))


@query("RAS_10_page_graph")
def _(v: Views) -> DataFrame:
    return traced(v).where("part = 'segment'").select("sheet_id", "idx", F.to_json("points").alias("points"), "style", "line_type", "confidence", "a_kind", "a_ref", "b_kind", "b_ref", F.to_json("through").alias("through"))


@query("RAS_04_05_junctions")
def _(v: Views) -> DataFrame:
    return traced(v).where("part = 'junction'").select("sheet_id", "idx", F.element_at(F.element_at("points", 1), 1).alias("x"), F.element_at(F.element_at("points", 1), 2).alias("y"), "kind", "ambiguous")


@query("RAS_01_03_thinned")
def _(v: Views) -> DataFrame:
    return tracing.thinned(Views(v.spark, v.sf_dir, 1).pages())


@query("RAS_11_autocontrast", "WITH g AS (SELECT p_partkey // 100 AS sheet_id, p_partkey % 100 AS node, (p_size * 5 + p_partkey * 7) % 180 + 30 AS g FROM part), m AS (SELECT sheet_id, min(g) AS lo, max(g) AS hi FROM g GROUP BY sheet_id) SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY node) AS place, CAST(CASE WHEN hi = lo THEN g ELSE trunc(g * (255e0 / (hi - lo)) - lo * (255e0 / (hi - lo))) END AS BIGINT) AS level FROM g JOIN m USING (sheet_id)")
def _(v: Views) -> DataFrame:
    """Pages of one row of pixels, whose grey levels come from the parts of a sheet."""
    level = F.format_string("%02X", (F.col("p_size") * 5 + F.col("p_partkey") * 7) % 180 + 30)
    dots = v.table("part").groupBy(F.floor(F.col("p_partkey") / 100).alias("sheet_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("p_partkey") % 100).alias("node"), level.alias("hex")))).alias("dots"))
    pages = dots.select("sheet_id", F.size("dots").alias("width"), F.lit(1).alias("height"), F.unhex(F.array_join("dots.hex", "")).alias("grey"))
    places = tracing.enhanced(pages).withColumn("place", F.explode(F.sequence(F.lit(1), F.col("width"))))
    return places.select("sheet_id", F.col("place").cast("long").alias("place"), F.conv(F.hex(F.expr("substring(grey, place, 1)")), 16, 10).cast("long").alias("level"))
