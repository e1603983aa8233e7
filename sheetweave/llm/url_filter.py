"""URL filter: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The list is hashed into 512-bit blocks of eight 64-bit lanes, one bit in each lane per key. A page probes
one block; pages whose bits are all set are possible hits and go to an exact hash join with the list, which
removes the false positives, so the result never depends on the filter's size. Everything is SQL functions.

Edge cases: a null url, or one without ``://``, has an empty host and path and is allowed unless a rule fits
(none fits an empty host); an empty list allows all; repeated pages are judged one by one, and equal URLs alike; a URL
of any length is read whole; of rules of one length, the last by code points wins; other columns of the input are
ignored, so clashing names do no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.llm.common import saved

LANES = 8
BLOCK_BITS = 64 * LANES
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only track the visitor.
TRACKING = r"&(utm_[^&=]*|ref|gclid|fbclid)=[^&]*"


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds host, path and canonical_url (host without ``www.``, path without a last ``/``, no tracking parameters, no fragment)."""
    rest = F.col("_rest")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return (
        df.withColumn("_url", F.coalesce(F.col(url), F.lit("")))
        .withColumn("_rest", F.expr("if(instr(_url, '://') > 0, substring(_url, instr(_url, '://') + 3), '')"))
        .withColumn("host", F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER))
        .withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
        .withColumn("_query", F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), TRACKING, ""), r"^&", ""))
        .withColumn("canonical_url", F.concat(F.regexp_replace("host", r"^www\.", ""), F.regexp_replace("path", r"/$", ""), F.when(F.col("_query") != "", F.concat(F.lit("?"), "_query")).otherwise("")))
        .drop("_url", "_rest", "_query")
    )


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's string and verdict, null if none fits. rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def _masks() -> list[Column]:
    """One bit for each lane, from six bits each of the second hash, ``_h2``."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h2, {6 * i}) & 63 as int))") for i in range(LANES)]


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, lane0..lane7) of the blocks that hold at least one key."""
    keyed = listed.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), F.xxhash64(key, F.lit(17)).alias("_h2"))
    return keyed.groupBy("block").agg(*(F.bit_or(m).alias(f"lane{i}") for i, m in enumerate(_masks())))


def block_count(keys: int, bits_per_key: int = 16) -> int:
    return max(1, -(-keys * bits_per_key // BLOCK_BITS))


def bloom_probe(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Adds ``_maybe``: false only if the key is in none of the blocks.

    The block table is broadcast only while its size, known from n_blocks, is within broadcast_bytes; beyond
    that it is joined by block.
    """
    if n_blocks * (LANES + 1) * 8 <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    asked = df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n_blocks))).withColumn("_h2", F.xxhash64(key, F.lit(17)))
    bits = reduce(lambda a, b: a & b, (F.col(f"lane{i}").bitwiseAND(m) == m for i, m in enumerate(_masks())))
    return asked.join(blocks, "block", "left").withColumn("_maybe", F.coalesce(bits, F.lit(False))).select(*df.columns, "_maybe")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", bits_per_key: int = 16, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per page: id, host, path, canonical_url, rule, listed, verdict.

    listed: a column canonical_url of blocked URLs.
    """
    urls = saved(listed.select("canonical_url").where(F.col("canonical_url").isNotNull()).distinct())  # read three times
    n_blocks = block_count(urls.count(), bits_per_key)
    rule, said = rule_of(rules)
    page = with_parts(pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("_in_url")), "_in_url").select(id_col, "host", "path", "canonical_url", rule.alias("rule"), said.alias("_said"))
    probed = bloom_probe(page, "canonical_url", bloom_blocks(urls, "canonical_url", n_blocks), n_blocks, broadcast_bytes).withColumn("_maybe", F.col("_maybe") & F.col("rule").isNull())
    kept = [id_col, "host", "path", "canonical_url", "rule", "_said"]
    clear = probed.where(~F.col("_maybe")).select(*kept, F.lit(False).alias("listed"))
    flags = urls.select(F.col("canonical_url").alias("_key"), F.lit(True).alias("_on"))
    hits = probed.where("_maybe").join(flags, F.col("canonical_url") == F.col("_key"), "left").select(*kept, F.coalesce("_on", F.lit(False)).alias("listed"))
    return clear.unionByName(hits).withColumn("verdict", F.coalesce("_said", F.when(F.col("listed"), "block").otherwise("allow"))).drop("_said")
