"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetweave.llm.chat import digests, format_chats
from sheetweave.llm.common import crc_mod, read
from sheetweave.llm.ego import near_vectors
from sheetweave.llm.jaccard import join_near
from sheetweave.llm.lm import held_out
from sheetweave.llm.lm import score as lm_score
from sheetweave.llm.mixing import mix
from sheetweave.llm.packing import pack
from sheetweave.llm.pseudonyms import pseudonymise
from sheetweave.llm.quality import fit, score
from sheetweave.llm.token_rules import judge
from sheetweave.llm.url_filter import judge_urls, with_parts

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Sites whose pages make up the list of blocked URLs.
ABUSE_HOSTS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
#: A real run gives its own key; equal keys give equal pseudonyms.
PSEUDONYM_KEY = "example key, replace in production"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    listed = with_parts(pages.select("url"), "url").where(F.col("host").rlike(f"(^|[.])({'|'.join(ABUSE_HOSTS)})[.]")).select("canonical_url")
    return judge_urls(pages, listed, RULES)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), vocabulary("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score(read(spark, sf_dir, "documents"), ~held_out())
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ranker = fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    held_out = (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return score(docs.select("doc_id", "text"), ranker).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_chats(rows.unionByName(probe), vocabulary("byte_bpe_50k.json")))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY, checked=True)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))[0]


OP1_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  regexp_replace(regexp_replace('&' || regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&(utm_[^&=]*|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&', '') AS q FROM a),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url FROM b),
listed_urls AS (SELECT DISTINCT canonical_url FROM c WHERE regexp_matches(host, '(^|[.])(spam-farm|cheap-pills|casino-win|free-bets|adult-x|ads-track)[.]')),
rules(say, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(say, length(h || p)) AS said
  FROM (SELECT DISTINCT host, path FROM c) u JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, c.host, c.path, c.canonical_url, rule,
  (rule IS NULL AND l.canonical_url IS NOT NULL) AS listed,
  coalesce(said, CASE WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best ON c.host = best.host AND c.path = best.path LEFT JOIN listed_urls l ON c.canonical_url = l.canonical_url
"""

QUERIES = {"op1_url_filter": op1_url_filter, "op2_token_rules": op2_token_rules, "op3_packing": op3_packing, "op4_language_model": op4_language_model, "op5_quality": op5_quality, "op10_chat": op10_chat, "op7_pseudonyms": op7_pseudonyms, "op6_embeddings": op6_embeddings, "op8_jaccard": op8_jaccard, "op9_mixing": op9_mixing}
SQL = {"op1_url_filter": OP1_SQL}
