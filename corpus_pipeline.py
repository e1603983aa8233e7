"""A corpus pipeline of five stages: quality, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept, written as Parquet and read
again; all but the last return the columns of ``documents``, and columns that a stage makes for itself take names that
the documents don't have. Every stage takes null, empty and very long texts, repeated rows and ids, and no rows; what becomes of
them is said at each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.llm.common import crc_mod, read, shared_dir
from sheetweave.llm.jaccard import near_rows
from sheetweave.llm.mixing import mix
from sheetweave.llm.packing import pack
from sheetweave.llm.pseudonyms import pseudonymise
from sheetweave.llm.quality import fit, score
from sheetweave.llm.queries import PSEUDONYM_KEY, vocabulary


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until docs has no column of it."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5; the scores are learned from two thirds of the labels.

    Null and empty texts are scored by features of zero; equal texts get equal scores, so ties and repeated rows stay or go
    together; without labels of both kinds every score is 0.5 and all stay.
    """
    ranker = fit(docs, read(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1))
    mark = free_name(docs, "_quality")
    return score(docs, ranker, out_col=mark).where(F.col(mark) >= 0.5).drop(mark)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; ids may be null or repeated.

    Null and empty texts have no shingles and stay, one for each id; of rows that repeat id and text one stays; among rows of
    one id, or without any, the text with the smallest hash does.
    """
    h = free_name(docs, "_h")
    stays = near_rows(docs).where("stays").select(F.col("doc_id").alias("_stays"), F.col("text_hash").alias("_of"))
    hashed = docs.withColumn(h, F.xxhash64("text"))
    kept = hashed.join(stays, (hashed[h] == stays["_of"]) & hashed["doc_id"].cast("long").eqNullSafe(stays["_stays"]), "left_semi")
    return kept.dropDuplicates(["doc_id", h]).drop(h)  # rows that repeat id and text


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, row by row, with pseudonyms for personal data and n_chars counted anew. Null texts stay null, with n_chars null too."""
    done = pseudonymise(docs, PSEUDONYM_KEY, checked=True)  # an address may be a digit shorter
    done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
    return done.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    The mix takes a document's words some r times. It appears floor(r) times and, with the chance of what is left of r, once
    more, by a hash of id and text, so that the words of each source still come near its target. Rows that repeat id and
    text share what they get together. Documents without words are not taken; ids may be null or repeated.
    """
    key, times, one = (free_name(docs, n) for n in ("_key", "_times", "_one"))
    row_key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")), F.col("source").cast("string"))
    mixed = mix(docs.select(row_key.alias("doc_id"), "source", "text"))[0].where("taken > 0")
    r = F.col("_taken") / F.col("_size")
    chance = F.pmod(F.xxhash64("_id", F.lit(4)), F.lit(1 << 20)) / (1 << 20)
    wanted = mixed.groupBy(F.col("doc_id").alias("_id")).agg(F.avg("taken").alias("_taken"), F.max("size").alias("_size"))
    wanted = wanted.select("_id", (F.floor(r) + (chance < r - F.floor(r)).cast("int")).cast("int").alias("_n")).where("_n > 0")
    joined = docs.withColumn(key, row_key).join(wanted.withColumnsRenamed({"_id": f"{key}_id", "_n": times}), F.col(key) == F.col(f"{key}_id"))
    return joined.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in sequences. A null or empty text is its end token alone, and a very long one is cut; repeated rows are packed one by one."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("source mix", source_mix), ("packing", packing)]
#: Learned scores, hash functions, tokens: SQL can't express them; tests compare with brute force.
ORACLE_SQL = None


def delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted when the next one has written its own; the last such folder stays, as the result reads it."""
    shared_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            delete(spark, f"{at}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
