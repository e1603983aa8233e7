"""Scores: conditional sums over joined predictions and truth, per sheet, per stratum and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetweave.operators.spatial import shuffled


def ratio(a: Column, b: Column, empty: float | Column = 0.0) -> Column:
    """a / b; ``empty`` if b is 0."""
    return F.when(b == 0, empty).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def detection(counts: DataFrame) -> DataFrame:
    """counts: n_matched, n_pred, n_gt. An empty prediction of an empty sheet is perfect."""
    m, p, g = F.col("n_matched"), F.col("n_pred"), F.col("n_gt")
    out = counts.withColumn("precision", ratio(m, p, F.when(g == 0, 1.0).otherwise(0.0))).withColumn("recall", ratio(m, g, 1.0))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def plain(counts: DataFrame) -> DataFrame:
    """counts: tp, fp, fn. Ratios are 0 on empty denominators."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def average_precision(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """ranked: sheet_id, rank (1 on), hit (boolean) of the predictions with a confidence; truth: sheet_id, n_gt. Null without either."""
    w = Window.partitionBy("sheet_id").orderBy("rank")
    steps = ranked.join(shuffled(truth.where("n_gt > 0")), "sheet_id")
    steps = steps.withColumn("m", F.sum(F.col("hit").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("p", F.col("m") / F.col("rank")).withColumn("r", F.col("m") / F.col("n_gt"))
    steps = steps.withColumn("p", F.max("p").over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("d", F.col("r") - F.coalesce(F.lag("r").over(w), F.lit(0.0)))
    return shuffled(truth).join(steps.groupBy("sheet_id").agg(F.sum(F.col("p") * F.col("d")).alias("ap")), "sheet_id", "left").select("sheet_id", "ap")


def stratum(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def topology(pred: DataFrame, truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """Long table (sheet_id, stratum, tp, fp, fn). pred: sheet_id, a, b; truth: with line_type, one row a pair; nodes: sheet_id, node, cls.

    Predictions between unknown or equal nodes aren't scored. Strata: all, line:<type>, class:<a|b>.
    """
    ends = lambda n: shuffled(nodes.select("sheet_id", F.col("node").alias(n), F.col("cls").alias(f"cls_{n}")))
    p = pred.where("a <> b").select("sheet_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("_p", F.lit(True))
    t = truth.select("sheet_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "line_type").withColumn("_t", F.lit(True))
    both = shuffled(p).join(t, ["sheet_id", "a", "b"], "full").join(ends("a"), ["sheet_id", "a"]).join(ends("b"), ["sheet_id", "b"])
    p_, t_ = F.col("_p").isNotNull(), F.col("_t").isNotNull()
    flags = both.select("sheet_id", (p_ & t_).cast("long").alias("tp"), (p_ & ~t_).cast("long").alias("fp"), (~p_ & t_).cast("long").alias("fn"), F.coalesce("line_type", F.lit("false_positive")).alias("lt"), stratum(F.col("cls_a"), F.col("cls_b")).alias("cl"))
    strata = F.explode(F.array(F.lit("all"), F.concat(F.lit("line:"), "lt"), F.concat(F.lit("class:"), "cl")))
    return flags.withColumn("stratum", strata).groupBy("sheet_id", "stratum").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def micro(scores: DataFrame) -> DataFrame:
    """Sums of a long table over all sheets, and their ratios."""
    return plain(scores.groupBy("stratum").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def tag_recall(truth: DataFrame, found: DataFrame, least: int = 5) -> DataFrame:
    """truth, found: sheet_id, tag (letters and digits). A tag is hit by itself, or by one that ends in it or that it ends in, both of ``least`` at least.

    The suffix rule is an equi-join on the last characters of both.
    """
    t, p = truth.select("sheet_id", "tag").distinct(), found.select("sheet_id", F.col("tag").alias("got")).distinct()
    p = shuffled(p)
    same = t.join(p, (t["sheet_id"] == p["sheet_id"]) & (t["tag"] == p["got"]), "left_semi")
    tail = lambda c: F.when(F.length(c) >= least, F.right(F.col(c), F.lit(least)))
    ends = t.withColumn("_e", tail("tag")).join(p.withColumn("_e", tail("got")), ["sheet_id", "_e"]).where(F.col("got").endswith(F.col("tag")) | F.col("tag").endswith(F.col("got"))).select("sheet_id", "tag")
    hit = same.unionByName(ends).distinct().withColumn("_hit", F.lit(1))
    out = t.join(shuffled(hit), ["sheet_id", "tag"], "left").groupBy("sheet_id").agg(F.count("*").alias("n_truth"), F.count("_hit").alias("n_hit"))
    return out.withColumn("recall", ratio(F.col("n_hit"), F.col("n_truth")))


def co_grouping(groups: DataFrame) -> DataFrame:
    """groups: sheet_id, node, pred, truth. The share of pairs that both put together or both apart, from group sizes instead of pairs."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2).cast("long")
    cells = groups.groupBy("sheet_id", "pred", "truth").agg(F.count("*").alias("n"))
    both = cells.groupBy("sheet_id").agg(pairs("n").alias("both"), F.sum("n").alias("n"))
    p = cells.groupBy("sheet_id", "pred").agg(F.sum("n").alias("n")).groupBy("sheet_id").agg(pairs("n").alias("p"))
    t = cells.groupBy("sheet_id", "truth").agg(F.sum("n").alias("n")).groupBy("sheet_id").agg(pairs("n").alias("t"))
    every = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    agree = every - F.col("p") - F.col("t") + 2 * F.col("both")
    return both.join(shuffled(p), "sheet_id").join(shuffled(t), "sheet_id").select("sheet_id", every.alias("n_pairs"), agree.alias("n_agree"), ratio(agree, every).alias("accuracy"))


def path_confidence(base: Column, n: Column, top_share: Column, ambiguous: Column, digits: int | None = 4) -> Column:
    """Confidence of a traversed path, less for each further segment, mixed line types and ambiguous junctions; 0 without segments."""
    half = F.lit(0.5)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)) * F.greatest(half, 1 - 0.05 * (n - 1)) * F.greatest(half, top_share) * F.greatest(half, 1 - 0.1 * ambiguous)
    return F.when(n == 0, 0.0).otherwise(value if digits is None else F.bround(value, digits))


def dominant(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; ``unknown`` on a tie for the first place."""
    n = df.groupBy(*key, value).agg(F.count("*").alias("n"))
    best = n.groupBy(*key).agg(F.max("n").alias("top"))
    tops = n.join(shuffled(best), key).where("n = top").groupBy(*key).agg(F.count("*").alias("k"), F.min(value).alias("v"))
    return tops.select(*key, F.when(F.col("k") == 1, F.col("v")).otherwise("unknown").alias(value))
