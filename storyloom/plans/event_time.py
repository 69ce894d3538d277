"""Event-time queries: duplicates in windows, decay, episodes, batches, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import rank, windows
from storyloom.plans.roles import CHAIN, ENTRIES, MENTIONS, chain, entries, mentions, seconds, table

WEEK_S = 7 * 86400


def c4_window_duplicate(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("id", "published_at", text.content_hash(F.col("title"), F.col("summary")).alias("h"))
    return windows.earlier_duplicate(e, "h", "published_at", "id", 72).select("id", "duplicate_of")


def d4_entity_stats(spark: SparkSession, d: str) -> DataFrame:
    out = windows.decayed_counts(mentions(spark, d), "token", "ts", WEEK_S)
    return out.select("token", seconds("first_at").alias("first_s"), seconds("last_at").alias("last_s"), "n", F.round("ema", 6).alias("ema"))


def d5_entity_ema(spark: SparkSession, d: str) -> DataFrame:
    return windows.running_decay(mentions(spark, d), "token", "ts", "id", WEEK_S).select("id", "token", F.round("ema", 6).alias("ema"))


def h2_quiet_gap_episodes(spark: SparkSession, d: str) -> DataFrame:
    e = windows.episodes_by_gap(mentions(spark, d), "token", "ts", "id", 4 * 3600)
    return e.groupBy("token", "episode").agg(
        F.count("*").alias("n"), F.min(seconds("ts")).alias("first_s"), F.max(seconds("ts")).alias("last_s"))


def e1_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    best = windows.newest_per_group(o, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    return best.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1000).select("o_orderkey", "o_custkey")


def e2_capped_backlog(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).where("length(body) >= 40")
    return windows.newest_per_group(e, "source", [F.asc("published_at"), F.asc("id")], 10).select("id", "source")


def e3_batches(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderdate", "o_orderkey")
    out = rank.ordinals(o, ["o_orderdate", "o_orderkey"])
    n = F.col("ordinal").cast("long")
    return out.select("o_orderkey", n.alias("ordinal"), F.floor((n - 1) / 50 + 1).cast("long").alias("batch"))


def e6_card_versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return windows.card_versions(o, "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_orderkey").select(
        "o_orderkey", "o_custkey", "version", "superseded_by")


def e9_fair_due(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    active = m.where("publisher = 'click'").groupBy("token").agg((F.count("*") % 4).alias("n"))
    return windows.fair_due(m, "token", [F.asc("ts"), F.asc("id")], 5, active).select("id", "token")


def e13_banded_sample(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    band = F.when(F.col("n") <= 2, 0).when(F.col("n") <= 5, 1).otherwise(2)
    return windows.banded_sample(n, band, "seed-1:", "o_custkey", 60).select("o_custkey", "n", F.col("band").cast("long").alias("band"))


def e13_agency_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Round robin over agencies, within one by a seeded hash."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return windows.banded_sample(c, F.col("c_nationkey"), "seed-2:", "c_custkey", 90).select("c_custkey", F.col("band").cast("long").alias("band"))


def e14_representative(spark: SparkSession, d: str) -> DataFrame:
    return chain(spark, d).groupBy("storyline").agg(
        F.min_by("ordinal", F.struct("syndicated", "ts", "ordinal")).alias("representative"),
        F.count_if("syndicated").alias("syndicated"))


def e16_overview_text(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct("ordinal", F.col("text").alias("t"))
    return chain(spark, d).groupBy("storyline").agg(F.array_sort(F.collect_list(line)).alias("l")).select(
        "storyline", F.array_join(F.transform("l", lambda x: x["t"]), " / ").alias("overview"))


def e17_rank_history(spark: SparkSession, d: str) -> DataFrame:
    cards = e6_card_versions(spark, d)
    return cards.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("version", "o_orderkey")), False).alias("h")).select(
        "o_custkey", F.array_join(F.transform("h", lambda x: x["o_orderkey"].cast("string")), ",").alias("history"))


def e18_first_card(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    order = [F.asc("o_orderdate"), F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return windows.canonical_rows(o, "o_custkey", order).where("is_canonical").select("o_custkey", "o_orderkey")


def j8_idempotent_events(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d).withColumn("key", F.concat_ws(":", "token", "publisher", F.date_format("ts", "yyyyMMddHH")))
    return windows.canonical_rows(m, "key", [F.asc("ts"), F.asc("id")]).where("is_canonical").select("key", "id")


def d8_hourly_health(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    return m.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count_if(F.col("publisher") == "purchase").alias("success"),
        F.count_if(F.col("publisher") != "purchase").alias("other"),
        F.round(F.percentile("duration", F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile("duration", F.lit(0.95)), 6).alias("p95"),
    ).select(F.unix_seconds("w.start").alias("hour_s"), "success", "other", "p50", "p95")


def d7_status_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).groupBy("publisher").agg(
        F.count("*").alias("n"), F.min(seconds("ts")).alias("oldest_s"), F.count_if(F.col("duration") > 100).alias("slow"))


def f5_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    m = mentions(spark, d)
    at = F.timestamp_seconds(F.lit(1705276800))
    return m.where((F.col("ts") < at) | ((F.col("ts") == at) & (F.col("id") < 5000))).orderBy(F.desc("ts"), F.desc("id")).limit(51).select(
        "id", seconds("ts").alias("ts_s"))


_FOLD = r"replace(replace(lower(trim(regexp_replace({x}, '\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"
HASH = f"hashed AS (SELECT id, published_at, sha256({_FOLD.format(x='title')} || chr(10) || {_FOLD.format(x='summary')}) AS h FROM entries)"
_CARDS = """cards AS (SELECT o_orderkey, o_custkey, row_number() OVER w AS version, lead(o_orderkey) OVER w AS superseded_by
  FROM orders WHERE o_orderstatus <> 'P' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""

QUERIES = {f.__name__: f for f in (
    c4_window_duplicate, d4_entity_stats, d5_entity_ema, h2_quiet_gap_episodes, e1_balanced_sample, e2_capped_backlog,
    e3_batches, e6_card_versions, e9_fair_due, e13_banded_sample, e13_agency_round_robin, e14_representative, e16_overview_text, e17_rank_history,
    e18_first_card, j8_idempotent_events, d8_hourly_health, d7_status_breakdown, f5_keyset_page)}
SQL = {
    "c4_window_duplicate": f"""WITH {ENTRIES}, {HASH} SELECT id, (SELECT max(b.id) FROM hashed b WHERE b.h = a.h AND b.id < a.id
  AND b.published_at > a.published_at - INTERVAL 72 HOUR) AS duplicate_of FROM hashed a""",
    "d4_entity_stats": f"""WITH {MENTIONS}, l AS (SELECT token, min(ts) AS f, max(ts) AS t, count(*) AS n FROM mentions GROUP BY 1)
SELECT m.token, CAST(floor(epoch(any_value(f))) AS BIGINT) AS first_s, CAST(floor(epoch(any_value(t))) AS BIGINT) AS last_s, any_value(n) AS n,
  round(sum(pow(0.5, (epoch(t) - epoch(ts)) / {WEEK_S}.0)), 6) AS ema FROM mentions m JOIN l USING (token) GROUP BY m.token""",
    "d5_entity_ema": f"""WITH {MENTIONS} SELECT a.id, a.token, round(sum(pow(0.5, (epoch(a.ts) - epoch(b.ts)) / {WEEK_S}.0)), 6) AS ema
  FROM mentions a JOIN mentions b ON a.token = b.token AND (b.ts, b.id) <= (a.ts, a.id) GROUP BY a.id, a.token""",
    "h2_quiet_gap_episodes": f"""WITH {MENTIONS}, o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY token ORDER BY ts, id) > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS opens FROM mentions),
r AS (SELECT *, 1 + sum(opens) OVER (PARTITION BY token ORDER BY ts, id) AS episode FROM o)
SELECT token, CAST(episode AS BIGINT) AS episode, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s FROM r GROUP BY token, episode""",
    "e1_balanced_sample": """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn <= 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000""",
    "e2_capped_backlog": f"""WITH {ENTRIES} SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at, id) AS rn FROM entries WHERE length(body) >= 40) WHERE rn <= 10""",
    "e3_batches": "SELECT o_orderkey, n AS ordinal, (n - 1) // 50 + 1 AS batch FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)",
    "e6_card_versions": f"WITH {_CARDS} SELECT * FROM cards",
    "e9_fair_due": f"""WITH {MENTIONS}, a AS (SELECT token, count(*) % 4 AS n FROM mentions WHERE publisher = 'click' GROUP BY 1)
SELECT id, token FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY ts, id) AS rn FROM mentions) LEFT JOIN a USING (token) WHERE rn <= 5 - coalesce(n, 0)""",
    "e13_banded_sample": """WITH n AS (SELECT o_custkey, count(*) AS n, CASE WHEN count(*) <= 2 THEN 0 WHEN count(*) <= 5 THEN 1 ELSE 2 END AS band FROM orders GROUP BY 1)
SELECT o_custkey, n, CAST(band AS BIGINT) AS band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sha256('seed-1:' || o_custkey), o_custkey) AS rn FROM n) ORDER BY rn, band LIMIT 60""",
    "e13_agency_round_robin": """SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS band FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('seed-2:' || c_custkey), c_custkey) AS rn FROM customer) ORDER BY rn, c_nationkey LIMIT 90""",
    "e14_representative": f"""WITH {CHAIN} SELECT storyline, arg_min(ordinal, (syndicated, ts, ordinal)) AS representative, count(*) FILTER (WHERE syndicated) AS syndicated FROM chain GROUP BY 1""",
    "e16_overview_text": f"WITH {CHAIN} SELECT storyline, string_agg(text, ' / ' ORDER BY ordinal) AS overview FROM chain GROUP BY 1",
    "e17_rank_history": f"WITH {_CARDS} SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY version DESC) AS history FROM cards GROUP BY 1",
    "e18_first_card": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "j8_idempotent_events": f"""WITH {MENTIONS} SELECT key, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS rn FROM (
  SELECT *, token || ':' || publisher || ':' || strftime(ts, '%Y%m%d%H') AS key FROM mentions)) WHERE rn = 1""",
    "d8_hourly_health": f"""WITH {MENTIONS} SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_s, count(*) FILTER (WHERE publisher = 'purchase') AS success,
  count(*) FILTER (WHERE publisher <> 'purchase') AS other, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.95), 6) AS p95 FROM mentions GROUP BY 1""",
    "d7_status_breakdown": f"""WITH {MENTIONS} SELECT publisher, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS oldest_s, count(*) FILTER (WHERE duration > 100) AS slow FROM mentions GROUP BY 1""",
    "f5_keyset_page": f"""WITH {MENTIONS} SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s FROM mentions WHERE (ts, id) < (TIMESTAMP '2024-01-15', 5000) ORDER BY ts DESC, id DESC LIMIT 51""",
}
