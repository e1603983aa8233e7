"""Writers: append-only records, JSON documents with a summary, split manifests and stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_records(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Adds rows to a table of records; a CSV file has a header."""
    writer = df.write.mode("append")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def worklist_document(items: DataFrame, key: str = "sheet_id") -> DataFrame:
    """One JSON document for each sheet: a summary and the items in order of idx."""
    rest = [c for c in items.columns if c != key]
    lines = F.array_sort(F.collect_list(F.struct("idx", F.struct(*rest).alias("item"))))
    return items.groupBy(key).agg(F.to_json(F.struct(F.struct(F.count("*").alias("total")).alias("summary"), F.transform(lines, lambda x: x["item"]).alias("items"))).alias("document"))


def read_worklist(documents: DataFrame, item_schema: str) -> DataFrame:
    """The items of such documents again."""
    parsed = F.from_json("document", f"summary struct<total: long>, items array<struct<{item_schema}>>")
    return documents.select(*[c for c in documents.columns if c != "document"], F.inline(parsed["items"]))


def write_splits(df: DataFrame, path: str, split: Column) -> None:
    """JSON lines in one folder for each split."""
    df.withColumn("split", split).write.mode("overwrite").partitionBy("split").json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """A manifest, one JSON object a row, that read_records or any JSON reader takes."""
    rows.write.mode("overwrite").json(path)


def write_stage(df: DataFrame, root: str, stage: str, job: str) -> str:
    """A stage's artifact at its fixed place."""
    at = f"{root}/stage={stage}/job_id={job}"
    df.write.mode("overwrite").parquet(at)
    return at


def report(rows: DataFrame) -> DataFrame:
    """Scores as lines of text. rows: stratum, tp, fp, fn, precision, recall, f1."""
    return rows.select("stratum", F.format_string("%s: P=%.3f R=%.3f F1=%.3f (tp=%d fp=%d fn=%d)", "stratum", "precision", "recall", "f1", "tp", "fp", "fn").alias("line"))


def draw_list(items: DataFrame, color: Column, pad: float = 40.0) -> DataFrame:
    """What an overlay shows: who, in which colour, and the padded crop; drawing happens elsewhere."""
    return items.select("sheet_id", "node", color.alias("color"), (F.col("x0") - pad).alias("cx0"), (F.col("y0") - pad).alias("cy0"), (F.col("x1") + pad).alias("cx1"), (F.col("y1") + pad).alias("cy1"))
