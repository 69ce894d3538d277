"""Inventory, ingest and check queries over two versions of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import urls
from storyloom.operators import state
from storyloom.plans.roles import ENTRIES, VECTORS, entries, seconds, table, vectors


def _inventory(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    previous = c.where("c_custkey % 9 <> 0").withColumn("active", F.col("c_custkey") % 5 != 0)
    moved = F.when(F.col("c_custkey") % 13 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    return previous, c.where("c_custkey % 11 <> 0").withColumn("c_nationkey", moved.cast("int"))


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    return state.reconcile(*_inventory(spark, d), "c_custkey", ["c_mktsegment", "c_nationkey"])


def c2_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d)


def c3_discovery_due(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).where("action in ('insert', 'reactivate', 'update')").select("c_custkey")


def d6_inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).groupBy("action").agg(F.count("*").alias("n"), F.count_if("active").alias("active"))


def i10_snapshot_gate(spark: SparkSession, d: str) -> DataFrame:
    p, c = _inventory(spark, d)
    return state.snapshot_gate(p, c, "c_custkey", 100, 0.8)


def _incoming(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.split_part("url", F.lit("?"), F.lit(1)).alias("url"))
    old = p.where("id % 3 = 0").select("id", "url", F.concat(F.lit("x"), "id").alias("external_id"))
    new = p.where("id % 2 = 0").select(
        F.col("id"), "url", F.concat(F.lit("x"), F.when(F.col("id") % 4 == 0, F.col("id") + 3).otherwise(F.col("id"))).alias("external_id"), F.col("id").alias("ordinal"))
    return new, old


def c14_dispositions(spark: SparkSession, d: str) -> DataFrame:
    return state.dispositions(*_incoming(spark, d))


def d35_run_counters(spark: SparkSession, d: str) -> DataFrame:
    return c14_dispositions(spark, d).groupBy("disposition").agg(F.count("*").alias("n"))


def i1_idempotent_ingest(spark: SparkSession, d: str) -> DataFrame:
    new, old = _incoming(spark, d)
    fresh = state.dispositions(new, old).where("disposition = 'inserted'").select("id")
    return old.select("id", "url").union(new.join(fresh, "id", "left_semi").select("id", "url"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = entries(spark, d).select("id", F.sha2("body", 256).alias("hash"), F.length("body").cast("long").alias("chars"))
    rev = entries(spark, d).where("id % 10 <> 0").select("id", F.sha2(F.when(F.col("id") % 7 == 0, F.concat("body", F.lit(" rev"))).otherwise(F.col("body")), 256).alias("hash"))
    return e.where("id % 17 <> 0"), rev


def a7_corpus_sync(spark: SparkSession, d: str) -> DataFrame:
    return state.sync(*_versions(spark, d), "id", "hash", ["chars"])


def i2_content_replay(spark: SparkSession, d: str) -> DataFrame:
    """A second pass of extractors over the corpus: newer for some rows, of the same version with more text for others."""
    e = entries(spark, d).select("id", (F.col("id") % 3).alias("version"), F.length("body").cast("long").alias("chars"), F.sha2("body", 256).alias("hash"), F.col("lang").alias("feature"))
    again = e.where("id % 10 <> 0").select("id", (F.col("id") % 4).alias("version"), (F.col("chars") + F.when(F.col("id") % 7 == 0, 4).otherwise(0)).alias("chars"), F.sha2(F.concat("hash", F.lit("2")), 256).alias("hash"))
    return state.replay(e.where("id % 17 <> 0"), again, "id", ["feature"]).select("id", "version", "chars", "feature", "replaced")


def i3_feature_fill(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.col("lang")).alias("lang"), "source")
    n = entries(spark, d).where("id % 3 = 0").select("id", F.col("lang"), F.lit(None).cast("string").alias("source"))
    return state.fill_features(e, n, "id", ["lang", "source"])


def i4_theme_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two themes are merged into others; small ones are demoted."""
    m = spark.createDataFrame([(3, 1), (7, 2)], "label int, target int")
    out = state.merge_groups(vectors(spark, d).select("id", "label", "published_at"), m, "label", least=48)
    return out.select("label", "state", "target", "n", seconds("newest_at").alias("newest_s"))


def c27_relation_refresh(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    known = e.groupBy(F.col("user_id")).agg((F.count("*") % 2).cast("long").alias("misses"))
    seen = e.where("event_type = 'purchase' and event_id % 3 = 0").select("user_id")
    return state.misses(seen, known, "user_id", 2)


def i12_cancelled_purge(spark: SparkSession, d: str) -> DataFrame:
    """Entries that only a cancelled target (nation 3) brought in and no other saw."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    seen = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    mine, others = seen.where("s_nationkey = 3").select("l_orderkey").distinct(), seen.where("s_nationkey <> 3").select("l_orderkey")
    return mine.join(others, "l_orderkey", "left_anti")


def d33_column_checks(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return state.violations(li, {
        "quantity": F.col("l_quantity").between(1, 50), "discount": F.col("l_discount") <= 0.05, "flag": F.col("l_returnflag").isin("A", "N"), "line": F.col("l_linenumber") > 0})


def b5_inventory_rows(spark: SparkSession, d: str) -> DataFrame:
    h = urls.host(F.col("url"))
    reason = F.when(h.isNull(), "no host").when(h.rlike("^m\\."), "mobile").when(F.endswith(h, F.lit(".net")), "other domain")
    return table(spark, d, "pages").select("page_id", h.alias("host"), reason.alias("exclusion_reason"), reason.isNull().alias("usable"))


def d38_inventory_inspection(spark: SparkSession, d: str) -> DataFrame:
    return b5_inventory_rows(spark, d).groupBy(F.coalesce("exclusion_reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


def e10_canonical_host(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"))
    return p.groupBy("host").agg(F.min(F.struct((~F.col("url").startswith("https")).alias("s"), "url", "page_id")).alias("x"), F.count("*").alias("rows")).select("host", F.col("x.page_id").alias("page_id"), "rows")


def b34_usable_sites(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).where("active and c_mktsegment <> 'MACHINERY'").select("c_custkey")


def d39_run_close(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(
        F.every(F.col("value") > 1).alias("all_ok"), F.some(F.col("event_type") == "error").alias("any_error"), F.count("*").alias("n"))
    return e.select("user_id", F.when(F.col("all_ok"), "succeeded").when(F.col("any_error"), "failed").otherwise("partial").alias("status"), "n")


def b37_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Bounded exponential backoff in seconds with a jitter that only depends on the row."""
    jitter = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 4), 16, 10).cast("long") % 60
    tries = F.col("event_id") % 9
    return table(spark, d, "events").select("event_id", (F.least(F.lit(3600), 30 * F.pow(F.lit(2), tries).cast("long")) + jitter).cast("long").alias("delay_s"))


def g3_missing_types(spark: SparkSession, d: str) -> DataFrame:
    every = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return e.select("user_id", F.array_join(F.array_sort(F.array_except(every, F.col("t"))), ",").alias("missing"))


_INV = """prev AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_custkey % 5 <> 0 AS active FROM customer WHERE c_custkey % 9 <> 0),
cur AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 13 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 11 <> 0),
rec AS (SELECT coalesce(c.c_custkey, p.c_custkey) AS c_custkey, coalesce(c.c_mktsegment, p.c_mktsegment) AS c_mktsegment, CAST(coalesce(c.c_nationkey, p.c_nationkey) AS INTEGER) AS c_nationkey, c.c_custkey IS NOT NULL AS active,
  CASE WHEN p.c_custkey IS NULL THEN 'insert' WHEN c.c_custkey IS NULL THEN CASE WHEN p.active THEN 'deactivate' ELSE 'keep' END WHEN NOT p.active THEN 'reactivate'
    WHEN p.c_nationkey IS DISTINCT FROM c.c_nationkey OR p.c_mktsegment IS DISTINCT FROM c.c_mktsegment THEN 'update' ELSE 'keep' END AS action
  FROM prev p FULL JOIN cur c ON p.c_custkey = c.c_custkey)"""
_DISP = """p AS (SELECT page_id AS id, split_part(url, '?', 1) AS url FROM pages), old AS (SELECT id, url, 'x' || id AS external_id FROM p WHERE id % 3 = 0),
inc AS (SELECT id, url, 'x' || CASE WHEN id % 4 = 0 THEN id + 3 ELSE id END AS external_id FROM p WHERE id % 2 = 0),
disp AS (SELECT i.id, u.id AS url_id, x.id AS ext_id, CASE WHEN u.id IS NOT NULL AND x.id IS NOT NULL AND u.id <> x.id THEN 'identity_conflict' WHEN u.id IS NOT NULL THEN 'existing_url'
  WHEN x.id IS NOT NULL THEN 'existing_external_id' WHEN i.id <> min(i.id) OVER (PARTITION BY i.url) THEN 'repeated' ELSE 'inserted' END AS disposition
  FROM inc i LEFT JOIN (SELECT url, min(id) AS id FROM old GROUP BY 1) u ON i.url = u.url LEFT JOIN (SELECT external_id, min(id) AS id FROM old GROUP BY 1) x ON i.external_id = x.external_id)"""
_SYNC = """cur AS (SELECT doc_id AS id, sha256(text) AS hash, length(text) AS chars FROM documents WHERE doc_id % 17 <> 0),
inc AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' rev' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 0),
synced AS (SELECT coalesce(c.id, i.id) AS id, coalesce(i.hash, c.hash) AS hash, CASE WHEN i.hash IS NULL OR i.hash IS NOT DISTINCT FROM c.hash THEN chars END AS chars,
  i.hash IS NOT NULL AND i.hash IS DISTINCT FROM c.hash AS changed FROM cur c FULL JOIN inc i ON c.id = i.id)"""
_B5 = """b5 AS (SELECT page_id, host, CASE WHEN host = '' THEN 'no host' WHEN starts_with(host, 'm.') THEN 'mobile' WHEN host LIKE '%.net' THEN 'other domain' END AS exclusion_reason FROM (
  SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM pages))"""

QUERIES = {f.__name__: f for f in (
    c2_reconcile, c3_discovery_due, d6_inventory_summary, i10_snapshot_gate, c14_dispositions, d35_run_counters, i1_idempotent_ingest, a7_corpus_sync,
    i2_content_replay, i3_feature_fill, i4_theme_merge, c27_relation_refresh, i12_cancelled_purge, d33_column_checks, b5_inventory_rows,
    d38_inventory_inspection, e10_canonical_host, b34_usable_sites, d39_run_close, b37_backoff, g3_missing_types)}
SQL = {
    "c2_reconcile": f"WITH {_INV} SELECT * FROM rec",
    "c3_discovery_due": f"WITH {_INV} SELECT c_custkey FROM rec WHERE action IN ('insert', 'reactivate', 'update')",
    "d6_inventory_summary": f"WITH {_INV} SELECT action, count(*) AS n, count(*) FILTER (WHERE active) AS active FROM rec GROUP BY 1",
    "i10_snapshot_gate": f"WITH {_INV}, s AS (SELECT (SELECT count(*) FROM prev) AS before, (SELECT count(*) FROM cur) AS after, (SELECT count(DISTINCT c_custkey) FROM cur) AS k) SELECT before, after, after < 100 AS too_few, after < 0.8 * before AS shrunk, k < after AS duplicate_keys, NOT (after < 100 OR after < 0.8 * before OR k < after) AS accepted FROM s",
    "c14_dispositions": f"WITH {_DISP} SELECT id, disposition, coalesce(url_id, ext_id) AS matched FROM disp",
    "d35_run_counters": f"WITH {_DISP} SELECT disposition, count(*) AS n FROM disp GROUP BY 1",
    "i1_idempotent_ingest": f"WITH {_DISP} SELECT id, url FROM old UNION ALL SELECT i.id, i.url FROM inc i JOIN disp d ON i.id = d.id WHERE disposition = 'inserted'",
    "a7_corpus_sync": f"WITH {_SYNC} SELECT * FROM synced",
    "i2_content_replay": f"""WITH {ENTRIES}, c AS (SELECT id, id % 3 AS version, length(body) AS chars, lang AS feature FROM entries WHERE id % 17 <> 0),
n AS (SELECT id, id % 4 AS version, length(body) + CASE WHEN id % 7 = 0 THEN 4 ELSE 0 END AS chars FROM entries WHERE id % 10 <> 0),
j AS (SELECT coalesce(c.id, n.id) AS id, c.version AS v, c.chars AS k, feature, n.version AS nv, n.chars AS nk,
  n.id IS NOT NULL AND (c.id IS NULL OR n.version > c.version OR (n.version = c.version AND n.chars > c.chars)) AS replaced FROM c FULL JOIN n ON c.id = n.id)
SELECT id, CASE WHEN replaced THEN nv ELSE v END AS version, CASE WHEN replaced THEN nk ELSE k END AS chars, CASE WHEN NOT replaced THEN feature END AS feature, replaced FROM j""",
    "i3_feature_fill": f"WITH {ENTRIES} SELECT id, CASE WHEN id % 3 = 0 OR id % 2 = 0 THEN lang END AS lang, source FROM entries",
    "i4_theme_merge": f"""WITH {VECTORS}, m(label, target) AS (VALUES (3, 1), (7, 2)), c AS (SELECT coalesce(target, v.label) AS label, count(*) AS n, max(published_at) AS newest FROM vectors v LEFT JOIN m ON m.label = v.label GROUP BY 1)
SELECT l.label, CASE WHEN target IS NOT NULL THEN 'merged' WHEN coalesce(n, 0) < 48 THEN 'demoted' ELSE 'active' END AS state, target, coalesce(n, 0) AS n, CAST(epoch(newest) AS BIGINT) AS newest_s
FROM (SELECT DISTINCT label FROM vectors) l LEFT JOIN m ON m.label = l.label LEFT JOIN c ON c.label = l.label""",
    "c27_relation_refresh": "WITH k AS (SELECT user_id, count(*) % 2 AS m, count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 3 = 0) AS s FROM events GROUP BY 1) SELECT user_id, CASE WHEN s > 0 THEN 0 ELSE m + 1 END AS misses, CASE WHEN s > 0 THEN 0 ELSE m + 1 END < 2 AS active FROM k",
    "i12_cancelled_purge": "SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING bool_and(s_nationkey = 3)",
    "d33_column_checks": """SELECT 'quantity' AS rule, count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 50) AS broken FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER (WHERE l_discount > 0.05) FROM lineitem
UNION ALL SELECT 'flag', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem UNION ALL SELECT 'line', count(*) FILTER (WHERE l_linenumber <= 0) FROM lineitem""",
    "b5_inventory_rows": f"WITH {_B5} SELECT *, exclusion_reason IS NULL AS usable FROM b5",
    "d38_inventory_inspection": f"WITH {_B5} SELECT coalesce(exclusion_reason, 'eligible') AS reason, count(*) AS n FROM b5 GROUP BY 1",
    "e10_canonical_host": "SELECT host, arg_min(page_id, (NOT starts_with(url, 'https'), url, page_id)) AS page_id, count(*) AS rows FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM pages) GROUP BY 1",
    "b34_usable_sites": f"WITH {_INV} SELECT c_custkey FROM rec WHERE active AND c_mktsegment <> 'MACHINERY'",
    "d39_run_close": "SELECT user_id, CASE WHEN bool_and(value > 1) THEN 'succeeded' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'partial' END AS status, count(*) AS n FROM events GROUP BY 1",
    "b37_backoff": "SELECT event_id, CAST(least(3600, 30 * CAST(pow(2, event_id % 9) AS BIGINT)) + CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 4) AS BIGINT) % 60 AS BIGINT) AS delay_s FROM events",
    "g3_missing_types": "SELECT user_id, coalesce(array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(t, x))), ','), '') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY 1)",
}
