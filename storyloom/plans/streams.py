"""Stream queries over the events table as a file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import themes
from storyloom.operators.components import connected_components
from storyloom.operators.scratch import new_folder
from storyloom.plans.event_time import SQL as BATCH
from storyloom.plans.event_time import WEEK_S
from storyloom.plans.roles import MENTIONS, seconds
from storyloom.streaming import events


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as the table is one file
    return s.select(F.col("event_id").alias("id"), F.col("user_id").alias("token"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_type").alias("publisher"), F.col("value").alias("duration"))


def j2_stream_duplicates(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).withColumn("h", F.concat_ws(":", "token", "publisher"))
    return events.run_available(events.duplicate_flags(s, "h", 72))


def j3_stream_ema(spark: SparkSession, d: str) -> DataFrame:
    s = events.ended(_stream(spark, d), "2100-01-01")
    return events.run_available(events.running_ema(s, "token", WEEK_S)).select("id", F.round("ema", 6).alias("ema"))


def j4_stream_episodes(spark: SparkSession, d: str) -> DataFrame:
    out = events.run_available(events.episodes(_stream(spark, d), "token", "4 hours"), "complete")
    return out.select("token", "n", seconds("first_at").alias("first_s"), seconds("last_at").alias("last_s"))


def j5_stream_health(spark: SparkSession, d: str) -> DataFrame:
    out = events.run_available(events.hourly_health(_stream(spark, d), F.col("publisher") == "purchase"), "complete")
    return out.select(F.unix_seconds("w.start").alias("hour_s"), "success", "other")


def j8_stream_idempotent(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).withColumn("key", F.concat_ws(":", "token", "publisher", F.date_format("ts", "yyyyMMddHH")))
    return events.run_available(events.idempotent(s, "key")).select("key")


def j9_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/pages.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return events.ingest(s.select(F.col("page_id").alias("id"), F.split_part("url", F.lit("?"), F.lit(1)).alias("url")), new_folder(spark, "store"))


def j6_stream_sweeps(spark: SparkSession, d: str) -> DataFrame:
    count = lambda b: b.groupBy("sweep", "publisher").agg(F.count("*").alias("n"))
    out = events.sweeps(_stream(spark, d), "1 day", count, new_folder(spark, "store"))
    return out.select(F.unix_seconds("sweep").alias("sweep_s"), "publisher", "n")


def _gated(rows: DataFrame) -> DataFrame:
    """H5 on the rows of each sweep; the threshold fits random vectors."""
    nodes = connected_components(themes.theme_links(rows, ("window_s", "label"), 0.2)).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    members = nodes.join(rows, "id")
    good = themes.gated_themes(members, least_members=4, least_days=2, least_cohesion=0.1)
    return nodes.join(good.select("cluster"), "cluster", "left_semi")


def j6_theme_sweeps(spark: SparkSession, d: str) -> DataFrame:
    """Themes of vectors, swept every four days of event time over the last eight."""
    path = f"{d}/embeddings.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 37 * 60)
    v = s.select(F.col("vec_id").alias("id"), "embedding", "label", ts.alias("ts"), ts.alias("published_at"))
    return events.theme_sweeps(v, "4 days", new_folder(spark, "store"), _gated)


QUERIES = {f.__name__: f for f in (j2_stream_duplicates, j3_stream_ema, j4_stream_episodes, j5_stream_health, j8_stream_idempotent, j9_stream_ingest, j6_stream_sweeps, j6_theme_sweeps)}
SQL = {
    "j2_stream_duplicates": f"""WITH {MENTIONS} SELECT id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 72 HOUR THEN lag(id) OVER w END AS duplicate_of
  FROM mentions WINDOW w AS (PARTITION BY token, publisher ORDER BY ts, id)""",
    "j3_stream_ema": f"SELECT id, ema FROM ({BATCH['d5_entity_ema']})",
    "j4_stream_episodes": f"SELECT token, n, first_s, last_s FROM ({BATCH['h2_quiet_gap_episodes']})",
    "j5_stream_health": f"SELECT hour_s, success, other FROM ({BATCH['d8_hourly_health']})",
    "j9_stream_ingest": "SELECT min(page_id) AS id, split_part(url, '?', 1) AS url FROM pages GROUP BY 2",
    "j6_stream_sweeps": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS sweep_s, event_type AS publisher, count(*) AS n FROM events GROUP BY 1, 2",
    "j8_stream_idempotent": f"SELECT key FROM ({BATCH['j8_idempotent_events']})",
}
