"""Outside formats to rows: feeds, sitemaps, JSON payloads, capture indexes, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storyloom.functions import text

# The five character references of XML; the ampersand is written first and read last.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escaped(plain: Column) -> Column:
    for char, name in REFERENCES:
        plain = F.replace(plain, F.lit(char), F.lit(name))
    return plain


def unescaped(marked: Column) -> Column:
    for char, name in reversed(REFERENCES):
        marked = F.replace(marked, F.lit(name), F.lit(char))
    return marked


def inside(block: Column, tag: str) -> Column:
    """Text of the first element of that name in a block; CDATA marks are dropped. Empty if there is none."""
    found = F.regexp_extract(block, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return unescaped(F.trim(F.regexp_replace(found, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))


def feed_items(bodies: DataFrame, body: str = "body") -> DataFrame:
    """A2: the items of RSS and the entries of Atom documents, in order: position, guid, url, title, summary, date. A
    document with a DOCTYPE is rejected whole."""
    safe = bodies.where(~F.contains(F.lower(F.col(body)), F.lit("<!doctype")))
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)<(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)>"), F.lit(1))
    items = safe.select(*[c for c in bodies.columns if c != body], F.posexplode(blocks).alias("position", "block"))
    pick = lambda *tags: F.coalesce(*[F.nullif(inside(F.col("block"), t), F.lit("")) for t in tags])
    link = F.coalesce(F.nullif(inside(F.col("block"), "link"), F.lit("")), F.nullif(F.regexp_extract("block", r'(?i)<link[^>]*href="([^"]*)"', 1), F.lit("")))
    return items.select("*", pick("guid", "id").alias("guid"), link.alias("url"), pick("title").alias("title"), pick("description", "summary").alias("summary"), pick("pubDate", "published", "updated").alias("date")).drop("block")


def feed_kind(body: Column) -> Column:
    """Rss, atom, json_feed or none."""
    b = F.lower(body)
    return (
        F.when(F.contains(b, F.lit("<!doctype")), "none")
        .when(b.rlike(r"<rss[\s>]|<rdf:rdf[\s>]"), "rss")
        .when(b.rlike(r"<feed[\s>]"), "atom")
        .when(F.contains(F.coalesce(F.get_json_object(body, "$.version"), F.lit("")), F.lit("jsonfeed.org")), "json_feed")
        .otherwise("none")
    )


def _head(body: Column) -> Column:
    """A feed document up to its first item."""
    return F.regexp_replace(body, r"(?is)<(?:item|entry)[\s>].*$", "")


def _known(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def feed_title(body: Column) -> Column:
    """The title of a feed document; null where it is none."""
    xml = feed_kind(body).isin("rss", "atom")
    return F.when(xml, _known(inside(_head(body), "title"))).when(feed_kind(body) == "json_feed", F.get_json_object(body, "$.title"))


def feed_home(body: Column) -> Column:
    """The page that a feed document belongs to."""
    link = F.coalesce(_known(inside(_head(body), "link")), _known(F.regexp_extract(_head(body), r'(?i)<link[^>]*href="([^"]*)"', 1)))
    return F.when(feed_kind(body).isin("rss", "atom"), link).when(feed_kind(body) == "json_feed", F.get_json_object(body, "$.home_page_url"))


def sitemap_rows(bodies: DataFrame, since: str, body: str = "body") -> DataFrame:
    """A3: rows of sitemaps and of indexes of them: kind (url or index), loc, lastmod, and a news item's title and time.
    Those last changed (or, without that, published) before a day (yyyy-mm-dd) are left out; undated ones stay."""
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)(<(?:url|sitemap)>.*?</(?:url|sitemap)>)"), F.lit(1))
    rows = bodies.select(*[c for c in bodies.columns if c != body], F.explode(blocks).alias("b"))
    named = rows.select(
        *rows.columns,
        F.when(F.col("b").rlike("(?i)^<sitemap>"), "index").otherwise("url").alias("kind"),
        inside(F.col("b"), "loc").alias("loc"),
        _known(inside(F.col("b"), "lastmod")).alias("lastmod"),
        _known(inside(F.col("b"), "news:title")).alias("title"),
        _known(inside(F.col("b"), "news:publication_date")).alias("published"),
    ).drop("b")
    return named.where(F.coalesce("lastmod", "published", F.lit(since)) >= since)


def payload_rows(bodies: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """A4: the rows of a JSON array of objects, by a fixed schema; what doesn't parse gives none."""
    parsed = F.from_json(body, F.lit(f"array<struct<{schema}>>"))
    return bodies.select(*[c for c in bodies.columns if c != body], F.inline(parsed))


#: A4: by kind of payload, its schema, the array of its items, and where an item keeps id, address, day, title, summary.
PAYLOADS: dict[str, tuple[str, str, tuple[str, str, str, str, str]]] = {
    "wordpress": (
        "array<struct<id: string, link: string, date_gmt: string, title: struct<rendered: string>, excerpt: struct<rendered: string>>>",
        "p", ("id", "link", "date_gmt", "title.rendered", "excerpt.rendered")),
    "drupal": (
        "struct<data: array<struct<id: string, attributes: struct<title: string, created: string, path: struct<alias: string>, body: struct<processed: string>>>>>",
        "p.data", ("id", "attributes.path.alias", "attributes.created", "attributes.title", "attributes.body.processed")),
    "media": (
        "struct<results: array<struct<id: string, sourceUrl: string, datePublished: string, name: string, description: string>>>",
        "p.results", ("id", "sourceUrl", "datePublished", "name", "description")),
    "solr": (
        "struct<response: struct<docs: array<struct<id: string, url: string, date: string, title: string, body: string>>>>",
        "p.response.docs", ("id", "url", "date", "title", "body")),
    "parks": (
        "struct<data: array<struct<id: string, url: string, releaseDate: string, title: string, abstract: string>>>",
        "p.data", ("id", "url", "releaseDate", "title", "abstract")),
}


def payload_candidates(bodies: DataFrame, *, base: str, body: str = "body", kind: str = "kind") -> DataFrame:
    """A4: payloads of all kinds in one schema of candidates: external_id, url (relative ones under base), day, title,
    summary (without markup). One pass: a body is parsed by its own kind's schema."""
    carried = [c for c in bodies.columns if c not in (body, kind)]
    out = None
    for name, (schema, items, fields) in PAYLOADS.items():
        parsed = bodies.where(F.col(kind) == name).select(*carried, F.from_json(body, F.lit(schema)).alias("p"))
        i = parsed.select(*carried, F.explode(items).alias("i"))
        external, url, day, title, summary = (F.col(f"i.{f}") for f in fields)
        rows = i.select(
            *carried, external.alias("external_id"), F.when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url).alias("url"),
            F.substring(day, 1, 10).alias("day"), title.alias("title"), text.strip_markup(summary).alias("summary"))
        out = rows if out is None else out.unionByName(rows)
    return out


def yearly_captures(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Of capture rows [timestamp, address], the latest of each address and year."""
    rows = bodies.select(F.explode(F.from_json(body, F.lit("array<array<string>>"))).alias("r"))
    ts, at = F.col("r")[0], F.col("r")[1]
    return rows.select(at.alias("address"), F.substring(ts, 1, 4).alias("year"), ts.alias("ts")).groupBy("address", "year").agg(F.max("ts").alias("latest"))


def read_inventory(spark: SparkSession, path: str, schema: StructType, required: set[str]) -> DataFrame:
    """A1: a CSV snapshot with quoted fields; a row that doesn't fit fails the read, a missing column too."""
    header = set(spark.read.option("header", True).csv(path).columns)
    if missing := required - header:
        raise ValueError(f"inventory lacks {sorted(missing)}")
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def write_snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Every table of a run under path/table, and how many rows each has."""
    spark = next(iter(tables.values())).sparkSession
    counts = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        n = spark.read.schema(df.schema).parquet(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        counts = n if counts is None else counts.union(n)
    return counts


def export_json_lines(rows: DataFrame, order: list[str], path: str) -> None:
    """A10: JSON lines in order over the part files, without one task that holds them all."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)
