"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; each round is saved in the shared checkpoint folder. A centre with very many
neighbours costs a minimum with partial aggregation and a join whose large side can be split (the minima are
saved first, so that the join reads both sides from exchanges of its own), never a group in one task. The rounds
end when the edges are stars; only a count per round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.common import saved


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which has none itself: then nothing can move. edges: a > b, each once."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] == 0


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = saved(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")))
    return both.join(least, F.col("a") == F.col("n")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them. edges: a > b."""
    least = saved(edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
    moved = edges.join(least, F.col("a") == F.col("n")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: two columns of ids (long). Returns (id, component) of every linked node but the component's smallest."""
    x, y = edges.columns[:2]
    now = saved(edges.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    for _ in range(most_rounds):
        if _stars(now):
            break
        now = saved(_small(_large(now)))
    else:
        raise RuntimeError(f"components need more than {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
