"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word: a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table of a size the caller has bounded."""
    return spark.createDataFrame(rows, T._parse_datatype_string(schema))


def shared_dir(spark: SparkSession) -> None:
    """checkpoint() needs a folder that all executors share; the cluster names it in spark.checkpoint.dir. Only a session of one machine gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def saved(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucket_bits(rows: int, least: int = 256) -> int:
    """Bits of a hash that cut ``rows`` into buckets of about max(least, sqrt(rows)): either level then fits one task."""
    per = max(least, math.isqrt(max(rows, 1)))
    return max(0, math.ceil(math.log2(max(1.0, rows / per))))


def running_before(df: DataFrame, group: str, bucket: str, order: list[str], size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows of the same group that come before, by bucket and then ``order``.

    No task ever holds a whole group: sums of buckets are made first (with map-side partial sums), their
    running totals are taken over one row per bucket, and rows are then summed inside (group, bucket) only.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(size).alias("_sum"))
    upto = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return rows.join(base, (F.col(group) == F.col("_g")) & (F.col(bucket) == F.col("_b"))).withColumn(out, F.col("_base") + F.col("_in")).drop("_g", "_b", "_base", "_in")


def arrow_schema(ddl: str):  # noqa: ANN201
    """The Arrow schema of ``name type, ...`` with plain types and arrays of them; works in Python workers."""
    import pyarrow as pa

    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(pa.field(name.strip("`"), pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]))
    return pa.schema(fields)


def arrow_batch(rows: list[tuple], schema):  # noqa: ANN001, ANN201
    """rows, at least one, as one record batch."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
