"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... take the points frac(i * golden ratio), which are mapped through the cumulative target
weights to a source and ranked within it. A source's documents, in a hashed order, form a stream that is cut
into blocks of equal numbers of words; rank r uses block r modulo the source's blocks, and the last rank of a
source uses only the head of its block, so that the words used add up to the target. Documents get the
words that used blocks share with them.

Edge cases: null text has size 0 and is taken 0 times; sources sort by code point with null last; an empty
table gives an empty result; repeated rows stay apart; rows with equal ids and sizes are ties, in any order, as what they get together is the same; a null doc_id is an id like others; a very long text spans as many blocks as it
needs; only doc_id, source and the text are read, so columns of other names do no harm. More than ``max_sources`` sources are an error, not cut.
"""

from __future__ import annotations

from itertools import cycle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.common import WORD, bucket_bits, running_before, saved, small_frame

GOLDEN = 0.6180339887498949


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; what exceeds cap times a source's size is shared anew by weight until none is above."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in above:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in above)
        open_ -= set(above)
        if left <= 0:
            break
    return out


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, source and the number of words."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def schedule(spark, table: list[dict], block: int) -> DataFrame:
    """(slot, k, rank, block, words) of every slot. table: a row of k, size, target, blocks, need for each source."""
    live = [r for r in table if r["need"] > 0]
    total = sum(r["target"] for r in live)
    cum, acc = [], 0.0
    for r in live:
        acc += r["target"]
        cum.append(acc / total)
    n_slots = sum(r["need"] for r in live)
    pick = F.element_at(F.array(*(F.lit(r["k"]) for r in live)), F.least(F.lit(len(live)), F.size(F.filter(F.array(*map(F.lit, cum)), lambda c: c <= F.col("u"))) + 1))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") * F.lit(GOLDEN)) % 1).alias("u")).select("slot", pick.alias("k"), F.lit(1).cast("long").alias("one"))
    bits = bucket_bits(n_slots)
    step = max(1, -(-n_slots // (1 << bits)))
    ranked = running_before(slots.withColumn("_bucket", F.floor(F.col("slot") / step)), "k", "_bucket", ["slot"], "one", "rank").select("slot", "k", "rank")
    # a source's last few slots that the points have not reached come at the end
    got = slots.groupBy("k").agg(F.count("*").alias("got"))
    info = F.broadcast(small_frame(spark, [(r["k"], r["size"], r["target_words"], r["blocks"], r["need"]) for r in live], "k int, s_size long, s_target long, s_blocks long, need long"))
    late = info.join(got, "k", "left").select("k", F.coalesce("got", F.lit(0)).alias("got"), "need").where("got < need")
    late = late.select(F.lit(n_slots).alias("slot"), "k", F.explode(F.expr("sequence(got, need - 1)")).alias("rank"))
    used = ranked.unionByName(late).join(info, "k").where("rank < need")
    epoch, at = F.floor(F.col("rank") / F.col("s_blocks")), F.col("rank") % F.col("s_blocks")
    begin = epoch * F.col("s_size") + at * block
    words = F.least(F.lit(block), F.col("s_size") - at * block, F.col("s_target") - begin)
    return used.select("slot", "k", "rank", at.alias("block"), words.alias("words"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, block: int = 1024, max_sources: int = 100_000, seed: int = 9) -> tuple[DataFrame, DataFrame | None]:
    """(documents, schedule). Documents: doc_id, source, size, source_size, target, taken.

    Only one row per source comes to the driver; more than max_sources of them are refused.
    """
    spark = docs.sparkSession
    sizes = saved(sized(docs))  # the texts are read once
    per = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(per) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    per = sorted(per, key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["size"] for r in per], [w for _, w in zip(per, cycle(weights), strict=False)], cap)
    table = []
    for k, (r, t) in enumerate(zip(per, aims, strict=True)):
        size, words = r["size"], min(round(t), cap * r["size"])
        blocks = max(1, -(-size // block))
        need = (words // size) * blocks + -(-(words % size) // block) if size else 0
        table.append({"k": k, "source": r["source"], "size": size, "target": t, "target_words": words, "blocks": blocks, "need": need})
    if not any(r["need"] for r in table):
        return sizes.select("*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken")), None
    slots = schedule(spark, table, block)
    uses = slots.groupBy("k", "block").agg(F.collect_list("words").alias("heads"))  # at most cap entries a block
    info = F.broadcast(small_frame(spark, [(r["k"], r["source"], r["size"], r["target"]) for r in table], "k int, _source string, source_size long, target double"))
    bits = bucket_bits(max(r["n"] for r in per))
    rows = sizes.join(info, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")))
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    placed = running_before(rows, "k", "_bucket", ["_h", "doc_id"], "size", "_from")
    first, last = F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest(F.col("_from") - F.col("block") * block, F.lit(0)), F.least(F.col("_from") + F.col("size") - F.col("block") * block, F.lit(block))
    cut = cut.withColumn("_lo", lo).withColumn("_hi", hi)
    share = F.aggregate(F.coalesce("heads", F.expr("cast(array() as array<bigint>)")), F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.lit(0), F.least(w, F.col("_hi")) - F.col("_lo")))
    keys = ["doc_id", "source", "size", "source_size", "target", "_from"]
    got = cut.join(uses, ["k", "block"], "left").withColumn("_got", share).groupBy(*keys).agg(F.sum("_got").alias("taken"), F.count("*").alias("_n"))
    # only rows without words share a place; their number is their count
    again = F.explode(F.array_repeat(F.lit(0), F.when(F.col("size") == 0, F.col("_n")).otherwise(1).cast("int")))
    return got.select("doc_id", "source", "size", "source_size", "target", "taken", again.alias("_x")).drop("_x"), slots
