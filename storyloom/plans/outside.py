"""Source and sink queries: bodies are built from given tables, so that their rows are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storyloom.functions import text, vectors
from storyloom.operators import rank
from storyloom.operators.scratch import new_folder
from storyloom.plans.roles import ENTRIES, entries, table
from storyloom.plans.texts import ALL_KEY_SETS, keyed_text
from storyloom.sources import feeds


def a1_inventory_csv(spark: SparkSession, d: str) -> DataFrame:
    at = new_folder(spark, "source")
    s = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "quoted"')).alias("s_name"), "s_nationkey")
    s.write.option("header", True).option("escape", '"').csv(at)
    schema = StructType.fromDDL("s_suppkey bigint, s_name string, s_nationkey int")
    return feeds.read_inventory(spark, at, schema, {"s_suppkey", "s_name"}).select("s_suppkey", F.length("s_name").cast("long").alias("name_chars"), "s_nationkey")


def _feed_bodies(spark: SparkSession, d: str) -> DataFrame:
    """RSS and, for one feed in three, Atom documents of twenty entries each."""
    e = entries(spark, d)
    k = F.col("id").cast("string")
    title, text_of = feeds.escaped(F.col("title")), feeds.escaped(F.coalesce("summary", F.lit("")))
    rss = F.concat(F.lit("<item><guid>"), k, F.lit("</guid><link>http://x.gov/"), k, F.lit("</link><title>"), title, F.lit("</title><description>"), text_of, F.lit("</description></item>"))
    atom = F.concat(F.lit("<entry><id>"), k, F.lit('</id><link rel="alternate" href="http://x.gov/'), k, F.lit('"/><title type="text">'), title, F.lit("</title><summary>"), text_of, F.lit("</summary></entry>"))
    feed = F.floor(F.col("id") / 20)
    g = e.groupBy(feed.alias("feed")).agg(F.array_sort(F.collect_list(F.struct("id", F.when(feed % 3 == 0, atom).otherwise(rss).alias("x")))).alias("items"))
    items = F.array_join(F.transform("items", lambda i: i["x"]), "")
    head = F.concat(F.lit("<title>Feed "), F.col("feed").cast("string"), F.lit("</title>"))
    body = F.when(F.col("feed") % 3 == 0, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), head, F.lit('<link href="https://home.gov/"/>'), items, F.lit("</feed>"))).otherwise(
        F.concat(F.lit('<rss version="2.0"><channel>'), head, F.lit("<link>https://home.gov/</link>"), items, F.lit("</channel></rss>")))
    return g.select("feed", body.alias("body"))


def a2_feed_items(spark: SparkSession, d: str) -> DataFrame:
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return feeds.feed_items(_feed_bodies(spark, d)).select(F.col("guid").cast("long").alias("id"), "url", sha("title").alias("title_sha"), sha("summary").alias("summary_sha"), F.col("position").cast("long").alias("position"))


def b11_feed_kind(spark: SparkSession, d: str) -> DataFrame:
    """Kind, title and home page of feed documents, some of them JSON, with a DOCTYPE, or no feed."""
    b = _feed_bodies(spark, d)
    i = F.col("feed") % 5
    json = F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.concat(F.lit("JSON "), F.col("feed").cast("string")).alias("title"), F.lit("https://home.gov/").alias("home_page_url")))
    body = F.when(i == 0, json).when(i == 1, F.concat(F.lit("<!DOCTYPE rss>"), "body")).when(i == 2, F.lit("<html><title>No feed</title></html>")).otherwise(F.col("body"))
    made = b.select("feed", body.alias("body"))
    return made.select("feed", feeds.feed_kind(F.col("body")).alias("kind"), feeds.feed_title(F.col("body")).alias("title"), feeds.feed_home(F.col("body")).alias("home"))


def a3_sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Sitemap documents of fifty pages each and an index of them: url rows from a day on, with news tags, and index rows."""
    n = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("2024-0"), (n % 9 + 1).cast("string"), F.lit("-15")).alias("m"), F.floor(n / 50).alias("map"))
    news = F.when(n % 4 == 0, F.concat(F.lit("<news:news><news:publication_date>"), "m", F.lit("T08:00:00Z</news:publication_date><news:title>News &amp; "), n.cast("string"), F.lit("</news:title></news:news>"))).otherwise("")
    row = F.concat(F.lit("<url><loc>"), feeds.escaped(F.col("url")), F.lit("</loc>"), F.when(n % 4 != 0, F.concat(F.lit("<lastmod>"), "m", F.lit("</lastmod>"))).otherwise(""), news, F.lit("</url>"))
    maps = p.groupBy("map").agg(F.array_join(F.collect_list(row), "").alias("rows")).select(F.concat(F.lit("map"), F.col("map").cast("string")).alias("source"), F.concat(F.lit("<urlset>"), "rows", F.lit("</urlset>")).alias("body"))
    ref = F.concat(F.lit("<sitemap><loc>https://x.gov/map"), F.col("map").cast("string"), F.lit(".xml</loc><lastmod>2024-0"), (F.col("map") % 9 + 1).cast("string"), F.lit("-01</lastmod></sitemap>"))
    index = p.select("map").distinct().groupBy(F.floor(F.col("map") / 50).alias("i")).agg(F.array_join(F.collect_list(ref), "").alias("rows"))
    index = index.select(F.concat(F.lit("index"), F.col("i").cast("string")).alias("source"), F.concat(F.lit("<sitemapindex>"), "rows", F.lit("</sitemapindex>")).alias("body"))
    return feeds.sitemap_rows(maps.unionByName(index), "2024-05-01")


def a4_json_payload(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as a payload of one of five kinds, and all of them in one candidate schema."""
    c = table(spark, d, "conversations").withColumn("kind", F.element_at(F.array(*map(F.lit, feeds.PAYLOADS)), (F.col("conv_id") % len(feeds.PAYLOADS) + 1).cast("int")))
    key = F.concat_ws("-", "conv_id", "turn")
    url, day = F.concat(F.lit("https://x.gov/"), key), F.concat(F.lit("2024-01-0"), (F.col("turn") % 9 + 1).cast("string"))
    title = F.concat("role", F.lit(" "), F.col("turn").cast("string"))

    def body(kind: str, item: Column, wrap) -> DataFrame:
        rows = c.where(F.col("kind") == kind)
        return rows.groupBy("conv_id", "kind").agg(F.to_json(wrap(F.collect_list(item))).alias("body"))

    named = lambda **x: F.struct(*[v.alias(k) for k, v in x.items()])
    made = (
        body("wordpress", named(id=key, link=url, date_gmt=day, title=named(rendered=title), excerpt=named(rendered=F.concat(F.lit("<p>"), feeds.escaped(F.col("text")), F.lit("</p>")))), lambda x: x)
        .unionByName(body("drupal", named(id=key, attributes=named(title=title, created=day, path=named(alias=F.concat(F.lit("/"), key)), body=named(processed=F.col("text")))), lambda x: named(data=x)))
        .unionByName(body("media", named(id=key, sourceUrl=url, datePublished=day, name=title, description=F.col("text")), lambda x: named(results=x)))
        .unionByName(body("solr", named(id=key, url=url, date=day, title=title, body=F.col("text")), lambda x: named(response=named(docs=x))))
        .unionByName(body("parks", named(id=key, url=url, releaseDate=day, title=title, abstract=F.col("text")), lambda x: named(data=x)))
    )
    out = feeds.payload_candidates(made, base="https://x.gov")
    return out.select("conv_id", "external_id", "url", "day", "title", F.sha2("summary", 256).alias("summary_sha"))


def a6_yearly_captures(spark: SparkSession, d: str) -> DataFrame:
    """Index documents of a hundred captures each: the latest of each address and year."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("a"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("t"), F.floor(F.col("o_orderkey") / 100).alias("g"))
    return feeds.yearly_captures(o.groupBy("g").agg(F.to_json(F.collect_list(F.array("t", "a"))).alias("body")))


def _run_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("customer", "orders", "nation")}


def a8_run_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return feeds.write_snapshot(_run_tables(spark, d), new_folder(spark, "source"))


def a9_snapshot_scan(spark: SparkSession, d: str) -> DataFrame:
    at = new_folder(spark, "source")
    feeds.write_snapshot(_run_tables(spark, d), at)
    return spark.read.parquet(f"{at}/orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def a10_json_export(spark: SparkSession, d: str) -> DataFrame:
    at = new_folder(spark, "source")
    feeds.export_json_lines(table(spark, d, "labels"), ["doc_id"], at)
    return spark.read.schema("doc_id bigint, quality int, toxic int").json(at)


def b6_strict_boolean(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("l_returnflag") == "A", "true").when(F.col("l_returnflag") == "N", "false").otherwise(F.col("l_returnflag"))
    rows = table(spark, d, "lineitem").select(raw.alias("raw"))
    value = F.when(F.col("raw") == "true", True).when(F.col("raw") == "false", False)
    return rows.select(value.alias("value"), value.isNull().alias("rejected")).groupBy("value", "rejected").agg(F.count("*").alias("n"))


def b15_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Accepted and rejected candidates: a title is needed, and a time in [start, end)."""
    e = entries(spark, d)
    s = F.unix_seconds("published_at")
    why = F.when(F.trim("title") == "", "no title").when((s < 1704100000) | (s >= 1704300000), "outside window")
    return e.select("id", why.alias("reason"), F.length(F.substring("title", 1, 80)).cast("long").alias("title_chars"))


def b19_reextraction(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose extractor is older than the third version, or unknown, with their keys read anew."""
    e = keyed_text(entries(spark, d)).withColumn("version", F.when(F.col("id") % 3 != 0, F.col("id") % 5))
    return e.where("version is null or version < 3").select("id", F.size(text.event_keys(F.col("keyed"))).cast("long").alias("keys"))


def b23_fp16(spark: SparkSession, d: str) -> DataFrame:
    """Vectors packed to half-precision bytes and unpacked again: bytes, and the largest change of a number."""
    packed = table(spark, d, "embeddings").select("vec_id", "embedding", vectors.pack_fp16(F.col("embedding")).alias("packed"))
    back = packed.select("vec_id", "embedding", "packed", vectors.unpack_fp16(F.col("packed")).alias("back"))
    change = F.array_max(F.zip_with("embedding", "back", lambda x, y: F.abs(x - y)))
    return back.select("vec_id", F.hex("packed").alias("packed"), F.round(change.cast("double"), 9).alias("change"))


def b25_running_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each label as of each of its rows, by dimension."""
    x = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    out = rank.running_sums(x, ("label", "dim"), ["vec_id"], "x")
    return out.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("sum") / F.col("n"), 6).alias("mean"))


def b36_publisher_weight(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    weights = n.where("n_nationkey % 3 = 0").select("n_nationkey", (F.col("n_nationkey") / 10 + 1).alias("w"))
    return s.join(F.broadcast(weights), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy((F.col("s_suppkey") % 20).alias("storyline")).agg(
        F.greatest(F.coalesce(F.max("w"), F.lit(1.0)), F.lit(1.0)).alias("weight"))


def b39_verdict_values(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("1", "0", "y", "n", "maybe", "")]), (F.col("doc_id") % 6 + 1).cast("int"))
    v = F.when(raw.isin("1", "y"), 1).when(raw.isin("0", "n"), 0)
    return table(spark, d, "labels").select("doc_id", v.alias("verdict"), v.isNull().alias("violation"))


def b31_citation_guard(spark: SparkSession, d: str) -> DataFrame:
    """Timeline bullets that cite an unknown turn are dropped; the newest stand first."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("known"))
    bullets = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")), lambda i: i)
    kept = F.sort_array(F.filter(bullets, lambda b: F.array_contains("known", b)), False)
    return c.select("conv_id", F.array_join(F.transform(kept, lambda b: b.cast("string")), ",").alias("timeline"))


def b32_overview_checks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("cited"), F.sum(F.size(F.split("text", " "))).alias("words"))
    want = F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))
    return c.select("conv_id", F.size(F.array_except(want, "cited")).cast("long").alias("uncited"), F.size(F.array_except("cited", want)).cast("long").alias("unknown"), F.col("words").between(20, 500).alias("length_ok"))


def b29_strong_keys(spark: SparkSession, d: str) -> DataFrame:
    """A state, month and hazard key of a title, from first matches over fixed lists."""
    first = lambda words: F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("title"), w)), F.lit(0))
    a, b = first(("the", "die", "les", "las")), first(("of", "und", "que", "con"))
    return entries(spark, d).select("id", F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(":", a, b, F.lit("2024"))).alias("key"))


QUERIES = {f.__name__: f for f in (
    a1_inventory_csv, a2_feed_items, b11_feed_kind, a3_sitemap, a4_json_payload, a6_yearly_captures, a8_run_snapshot, a9_snapshot_scan, a10_json_export, b6_strict_boolean,
    b15_candidates, b19_reextraction, b23_fp16, b25_running_mean, b36_publisher_weight, b39_verdict_values, b31_citation_guard, b32_overview_checks, b29_strong_keys)}
SQL = {
    "a1_inventory_csv": "SELECT s_suppkey, length(s_name || ', \"quoted\"') AS name_chars, s_nationkey FROM supplier",
    "a2_feed_items": f"WITH {ENTRIES} SELECT id, 'http://x.gov/' || id AS url, sha256(trim(title)) AS title_sha, sha256(trim(coalesce(summary, ''))) AS summary_sha, row_number() OVER (PARTITION BY id // 20 ORDER BY id) - 1 AS position FROM entries",
    "b11_feed_kind": """WITH f AS (SELECT DISTINCT doc_id // 20 AS feed FROM documents)
SELECT feed, CASE WHEN feed % 5 = 0 THEN 'json_feed' WHEN feed % 5 IN (1, 2) THEN 'none' WHEN feed % 3 = 0 THEN 'atom' ELSE 'rss' END AS kind,
  CASE WHEN feed % 5 = 0 THEN 'JSON ' || feed WHEN feed % 5 > 2 THEN 'Feed ' || feed END AS title, CASE WHEN feed % 5 NOT IN (1, 2) THEN 'https://home.gov/' END AS home FROM f""",
    "a3_sitemap": """SELECT 'map' || (page_id // 50) AS source, 'url' AS kind, url AS loc, CASE WHEN page_id % 4 <> 0 THEN '2024-0' || (page_id % 9 + 1) || '-15' END AS lastmod,
  CASE WHEN page_id % 4 = 0 THEN 'News & ' || page_id END AS title, CASE WHEN page_id % 4 = 0 THEN '2024-0' || (page_id % 9 + 1) || '-15T08:00:00Z' END AS published FROM pages WHERE page_id % 9 >= 4
UNION ALL SELECT 'index' || (m // 50), 'index', 'https://x.gov/map' || m || '.xml', '2024-0' || (m % 9 + 1) || '-01', NULL, NULL FROM (SELECT DISTINCT page_id // 50 AS m FROM pages) WHERE m % 9 >= 4""",
    "a4_json_payload": """SELECT conv_id, conv_id || '-' || turn AS external_id, 'https://x.gov/' || conv_id || '-' || turn AS url, '2024-01-0' || (turn % 9 + 1) AS day,
  role || ' ' || turn AS title, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS summary_sha FROM conversations""",
    "a6_yearly_captures": "SELECT CAST(o_custkey % 50 AS VARCHAR) AS address, strftime(o_orderdate, '%Y') AS year, max(strftime(o_orderdate, '%Y%m%d%H%M%S')) AS latest FROM orders GROUP BY 1, 2",
    "a8_run_snapshot": "SELECT 'customer' AS \"table\", count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation",
    "a9_snapshot_scan": "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1",
    "a10_json_export": "SELECT doc_id, quality, toxic FROM labels",
    "b6_strict_boolean": "SELECT CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS value, l_returnflag NOT IN ('A', 'N') AS rejected, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "b15_candidates": f"WITH {ENTRIES} SELECT id, CASE WHEN trim(title) = '' THEN 'no title' WHEN epoch(published_at) < 1704100000 OR epoch(published_at) >= 1704300000 THEN 'outside window' END AS reason, least(length(title), 80) AS title_chars FROM entries",
    "b19_reextraction": f"WITH {ENTRIES}, {ALL_KEY_SETS} SELECT id, len(list) AS keys FROM key_sets WHERE id % 3 = 0 OR id % 5 < 3",
    "b25_running_mean": "SELECT vec_id, dim, round(avg(x) OVER (PARTITION BY label, dim ORDER BY vec_id), 6) AS mean FROM (SELECT vec_id, label, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)",
    "b36_publisher_weight": "SELECT s_suppkey % 20 AS storyline, greatest(coalesce(max(CASE WHEN s_nationkey % 3 = 0 THEN s_nationkey / 10.0::DOUBLE + 1 END), 1.0), 1.0) AS weight FROM supplier GROUP BY 1",
    "b39_verdict_values": "SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 2) THEN 1 WHEN doc_id % 6 IN (1, 3) THEN 0 END AS verdict, doc_id % 6 >= 4 AS violation FROM labels",
    "b31_citation_guard": "SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn DESC) AS timeline FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn <= 9) GROUP BY 1",
    "b32_overview_checks": "SELECT conv_id, 4 - count(DISTINCT turn) FILTER (WHERE turn <= 3) AS uncited, count(DISTINCT turn) FILTER (WHERE turn > 3) AS unknown, sum(len(string_split(text, ' '))) BETWEEN 20 AND 500 AS length_ok FROM conversations GROUP BY 1",
    "b29_strong_keys": f"""WITH {ENTRIES}, k AS (SELECT id, list_filter(['the', 'die', 'les', 'las'], lambda w: contains(lower(title), w))[1] AS a, list_filter(['of', 'und', 'que', 'con'], lambda w: contains(lower(title), w))[1] AS b FROM entries)
SELECT id, a || ':' || b || ':2024' AS key FROM k""",
}
