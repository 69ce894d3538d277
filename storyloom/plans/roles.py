"""Given tables in the roles of the data model; each as a DataFrame and as the same CTE for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(minutes) -> F.col:
    return F.timestamp_seconds(F.lit(1704067200) + minutes * 60)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News entries: documents, seven minutes apart."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        "source",
        "lang",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("summary"),
        F.col("text").alias("body"),
        _ts(F.col("doc_id") * 7).alias("published_at"),
    )


ENTRIES = """entries AS (
  SELECT doc_id AS id, source, lang, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS summary,
    text AS body, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 7 MINUTE AS published_at FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a vector, 37 minutes apart; theme or category: label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label", _ts(F.col("vec_id") * 37).alias("published_at"))


VECTORS = """vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label,
    TIMESTAMP '2024-01-01' + vec_id * INTERVAL 37 MINUTE AS published_at FROM embeddings)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token mentions: events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("token"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("publisher"),
        F.col("value").alias("duration"),
    )


MENTIONS = """mentions AS (
  SELECT event_id AS id, user_id AS token, ts, event_type AS publisher, value AS duration FROM events)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storyline entries: conversation turns; system turns are syndicated."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("storyline"),
        F.col("turn").alias("ordinal"),
        "role",
        "text",
        (F.col("role") == "system").alias("syndicated"),
        _ts(F.col("conv_id") * 60 + F.col("turn") * 90).alias("ts"),
    )


CHAIN = """chain AS (
  SELECT conv_id AS storyline, turn AS ordinal, role, text, role = 'system' AS syndicated,
    TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 90 MINUTE AS ts FROM conversations)"""


def storyline_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of storylines: order lines with their supplier's nation as agency."""
    o = table(spark, sf_dir, "orders")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        o.join(line, o["o_orderkey"] == line["l_orderkey"])
        .join(s, F.col("l_suppkey") == s["s_suppkey"])
        .join(n, F.col("s_nationkey") == n["n_nationkey"])
        .select(
            F.col("o_custkey").alias("storyline"),
            F.col("o_orderkey").alias("entry"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("l_suppkey").alias("feed"),
            F.col("n_name").alias("agency"),
            F.element_at(F.array(F.lit(3.0), F.lit(2.0), F.lit(1.5)), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("weight"),
        )
    )


STORYLINE_ENTRIES = """storyline_entries AS (
  SELECT o_custkey AS storyline, o_orderkey AS entry, o_orderdate AS ts, l_suppkey AS feed, n_name AS agency,
    CASE n_nationkey % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS weight
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""


def seconds(column: str):
    """A time as whole seconds, for results."""
    return F.unix_seconds(F.col(column).cast("timestamp"))
