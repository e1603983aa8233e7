"""Readers of the files that drawing benchmarks come in, as keyed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sheet_of(path: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def yolo(lines: DataFrame, width: Column | float, height: Column | float) -> DataFrame:
    """lines: sheet_id, value (``class cx cy w h`` in fractions). Adds cls_id and a box in pixels; lines of another shape are left out."""
    part = F.split(F.trim("value"), r"\s+")
    n = [F.try_element_at(part, F.lit(i)).try_cast("double") for i in range(1, 6)]
    cx, cy, w, h = n[1] * width, n[2] * height, n[3] * width, n[4] * height
    boxes = [(cx - w / 2).alias("x0"), (cy - h / 2).alias("y0"), (cx + w / 2).alias("x1"), (cy + h / 2).alias("y1")]
    return lines.where(F.size(part) >= 5).select("sheet_id", n[0].cast("int").alias("cls_id"), *boxes).where("cls_id is not null and x0 is not null and y1 is not null")


def read_yolo(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    text = spark.read.text(path).select(sheet_of(F.col("_metadata.file_path")).alias("sheet_id"), "value")
    return yolo(text, width, height)


def named(boxes: DataFrame, names: DataFrame | None) -> DataFrame:
    """Adds cls: the name of the class id, ``class_<id>`` for an unknown one, ``symbol`` for all without names."""
    if names is None:
        return boxes.withColumn("cls", F.lit("symbol"))
    return boxes.join(names, "cls_id", "left").withColumn("cls", F.coalesce("cls", F.concat(F.lit("class_"), F.col("cls_id").cast("string"))))


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """(cls_id, cls) of a JSON object of names by id; empty if there is no such file."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "cls_id int, cls string")
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "cls")).select(F.col("k").cast("int").alias("cls_id"), "cls")


def read_graphml(spark: SparkSession, path: str, *, no_class: str | None = None, no_line: str = "solid") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Attribute ids are resolved by each file's own declarations; a node needs four numbers. no_class and no_line stand for what isn't declared; with empty strings for both, files are read as they are."""
    def rows(tag: str, fields: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(fields).load(path).withColumn("file", F.col("_metadata.file_path"))

    data = "data array<struct<_VALUE string, _key string>>"
    names = rows("key", "_id string, `_attr.name` string, _for string").select("file", F.col("_id").alias("key"), F.col("`_attr.name`").alias("name"), F.col("_for").alias("kind"))

    def wide(df: DataFrame, kind: str, keep: list[str]) -> DataFrame:
        long = df.select("file", *keep, F.explode_outer("data").alias("d")).select("file", *keep, F.col("d._key").alias("key"), F.col("d._VALUE").alias("value"))
        long = long.join(names.where(F.col("kind").isin(kind, "all")).drop("kind"), ["file", "key"], "left")
        return long.groupBy("file", *keep).agg(F.map_from_entries(F.filter(F.collect_list(F.struct(F.coalesce("name", "key").alias("k"), "value")), lambda e: e["k"].isNotNull())).alias("m"))

    n = wide(rows("node", f"_id string, {data}"), "node", ["_id"])
    number = lambda k: F.try_element_at("m", F.lit(k)).try_cast("double")
    nodes = n.select(sheet_of(F.col("file")).alias("sheet_id"), F.col("_id").alias("node"), F.coalesce(F.try_element_at("m", F.lit("label")), F.lit(no_class)).alias("cls"), number("xmin").alias("x0"), number("ymin").alias("y0"), number("xmax").alias("x1"), number("ymax").alias("y1"))
    nodes = nodes.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    e = wide(rows("edge", f"_source string, _target string, {data}"), "edge", ["_source", "_target"])
    edges = e.select(sheet_of(F.col("file")).alias("sheet_id"), F.col("_source").alias("a"), F.col("_target").alias("b"), F.coalesce(F.try_element_at("m", F.lit("edge_label")), F.lit(no_line)).alias("line_type"))
    return nodes, edges


def linked_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected edges, each once, whose ends are both among the nodes: sheet_id, a, b with a before b."""
    known = nodes.select("sheet_id", "node").distinct()
    both = edges.select("sheet_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return both.join(known.withColumnRenamed("node", "a"), ["sheet_id", "a"], "left_semi").join(known.withColumnRenamed("node", "b"), ["sheet_id", "b"], "left_semi").select("sheet_id", "a", "b")


def graphml_centers(files: DataFrame) -> DataFrame:
    """files: sheet_id, value (a whole file). Class and box centre of nodes by pattern, for files whose coordinates are under d1 to d4 or d5 to d8 without declarations; nodes that lack a class or a coordinate are left out."""
    body = F.explode(F.regexp_extract_all("value", F.lit(r'(?s)<node id="[^"]*">(.*?)</node>'), F.lit(1))).alias("body")
    under = lambda key, what: F.nullif(F.regexp_extract("body", rf'<data key="{key}">({what})</data>', 1), F.lit(""))
    side = [F.coalesce(*(under(f"d{i + k}", "[0-9.]+").try_cast("double") for k in (0, 4))) for i in range(1, 5)]
    rows = files.select("sheet_id", body).select("sheet_id", under("d0", r"\w+").alias("cls"), *(c.alias(n) for c, n in zip(side, ("x0", "y0", "x1", "y1"), strict=True))).dropna()
    return rows.select("sheet_id", "cls", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))


def graphml_accepted(nodes: DataFrame, n_files: int) -> Column | bool:
    """Whether at least half of the sampled files (one at least) have two nodes or more."""
    good = nodes.groupBy("sheet_id").agg(F.count("*").alias("n")).where("n >= 2").count()
    return good >= max(1, n_files // 2)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of any layout over lines, as rows of the schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def tree(spark: SparkSession, path: str) -> DataFrame:
    """(folder, ending, n, bytes) of all files below a path; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ending")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def ocr_words(results: DataFrame) -> DataFrame:
    """results: sheet_id, texts, scores, boxes (array<array<double>>), dx, dy. One row a word, moved by the tile's origin; parse_failed where the arrays don't match."""
    same = (F.size("texts") == F.size("scores")) & (F.size("texts") == F.size("boxes"))
    empty = F.col("texts").isNull()
    bad = results.where(~empty & ~F.coalesce(same, F.lit(False))).select("sheet_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("confidence"), *(F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(True).alias("parse_failed"))
    zipped = results.where(~empty & F.coalesce(same, F.lit(False))).select("sheet_id", "dx", "dy", F.posexplode(F.arrays_zip("texts", "scores", "boxes")).alias("pos", "w"))
    side = lambda i, d: (F.bround(F.element_at("w.boxes", i + 1)) + F.col(d)).cast("double")
    good = zipped.select("sheet_id", F.col("pos").cast("long").alias("pos"), F.col("w.texts").alias("text"), F.col("w.scores").alias("confidence"), side(0, "dx").alias("x0"), side(1, "dy").alias("y0"), side(2, "dx").alias("x1"), side(3, "dy").alias("y1"), F.lit(False).alias("parse_failed"))
    return good.unionByName(bad)
