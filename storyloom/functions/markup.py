"""Look-ups in HTML and the metadata of an article page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import article, text, urls

#: Months by their first three letters, for dates in words.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _known(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def tags(html: Column, name: str) -> Column:
    """All opening tags of a name, in order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\b[^>]*>)"), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or not; null where there is none."""
    form = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, form, i), F.lit("")) for i in (1, 2, 3)])


def first_tag(html: Column, name: str, holds) -> Column:
    """The first tag of a name for which holds(tag) is true."""
    return F.get(F.filter(tags(html, name), lambda t: F.coalesce(holds(t), F.lit(False))), F.lit(0))


def metas(html: Column) -> Column:
    """The meta elements that have a key, as structs (key, content), in order."""
    key = lambda t: F.lower(F.coalesce(attribute(t, "property"), attribute(t, "name"), attribute(t, "itemprop")))
    return F.filter(F.transform(tags(html, "meta"), lambda t: F.struct(key(t).alias("key"), attribute(t, "content").alias("content"))), lambda m: m["key"].isNotNull())


def link(html: Column, rel: str) -> Column:
    """Address of the first link element of a relation."""
    return attribute(first_tag(html, "link", lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), rel)), "href")


def inside(html: Column, name: str) -> Column:
    """What the first element of a name holds, as text; null where there is none."""
    return _known(text.strip_markup(F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)))


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def day(value: Column) -> Column:
    """A date from an ISO time or from words as in March 5, 2024; null where there is none."""
    iso = F.try_to_date(F.regexp_extract(value, r"^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    form = r"(?i)\b([A-Z][a-z]{2})[a-z]{0,6}\.?\s+(\d{1,2}),\s+(20\d{2})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(value, form, 1)))
    words = F.try_to_date(F.concat_ws("-", F.regexp_extract(value, form, 3), month.cast("string"), F.regexp_extract(value, form, 2)), "y-M-d")
    return F.coalesce(iso, words)


#: Date fields of meta elements, in this order.
DATE_METAS = ("article:published_time", "cdc:first_published", "date", "dcterms.created", "dcterms.date", "dc.date.created", "dc.date", "datepublished")
#: Forms of marked dates in a page, in this order.
MARKED_DATES = (
    r"""(?i)field--name-field-news-publication-date[\s\S]{0,500}?<time\b[^>]*datetime=["']([^"']+)""",
    r"""(?i)field--name-field-publication-date-for-dis[\s\S]{0,500}?field__item["'][^>]*>([^<]+)""",
    r"""(?i)<strong\b[^>]*>\s*News Release Date:\s*</strong>\s*([^<\r\n]+)""",
    r"""(?i)article-meta__publish-date["'][^>]*>\s*([^<\r\n]+)""",
    r"""(?i)field--name-dynamic-twig-fieldnode-press-release-lead-in[\s\S]{0,500}?<p\b[^>]*>[^<]*?,\s*([A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+20\d{2})""",
    r"""(?i)field--name-field-press-body[\s\S]{0,500}?<p\b[^>]*>\s*([A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+20\d{2})\s*</p>""",
    r"""(?i)class=["'][^"']*meta[^"']*["'][^>]*>\s*([A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+20\d{2})\s*[|<]""",
    r"""(?i)class=["'][^"']*press-release[^"']*["'][\s\S]{0,1000}?<p\b[^>]*>\s*<(?:b|strong)\b[^>]*>\s*([A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+20\d{2})""",
    r"""(?i)itemprop=["']text["'][\s\S]{0,1000}?(?:Washington,?\s*D\.?C\.?\s*)?([A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+20\d{2})\s*(?:&nbsp;\s*)*(?:&mdash;|—|-)""",
    r"""(?i)\bWASHINGTON\s*\(\s*([A-Z][a-z]{2,8}\.?\s+\d{1,2},\s+20\d{2})\s*\)""",
)
#: Where a marked title is; a host whose titles' dates come before all others.
MARKED_TITLE = r"(?i)field--name-field-press-body[\s\S]{0,1000}?<h[2-5]\b[^>]*>([\s\S]*?)</h[2-5]>"
TITLE_DATE_HOST = "inciweb.wildfire.gov"


def article_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages with title, day, canonical (address), summary and body.

    Title: the headline of the first article in JSON-LD at any depth, then meta fields, a marked heading, the first
    heading, the title element. Day: that article's, any of JSON-LD, meta fields, marked text, the address, the title, and
    last the first time element. Canonical: the link's address as it stands in the page, else the page's. Summary: JSON-LD,
    then meta fields. Body: that article's text if it has enough, else that of the page (see functions/article.py). Each
    part of a page is read once, into a column of its own; parts that are missing are null.
    """
    h = F.col(html)
    read = pages.select(
        "*", metas(h).alias("_metas"), article.json_fields(json_ld(h)).alias("_ld"), attribute(F.get(tags(h, "time"), F.lit(0)), "datetime").alias("_time"),
        F.regexp_extract(h, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1).alias("_h1"), F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)</title>", 1).alias("_title"),
        F.regexp_extract(h, MARKED_TITLE, 1).alias("_heading"), article.body(h).alias("_body"), link(h, "canonical").alias("_link"))
    pick = lambda k: F.get(F.filter("_metas", lambda m: m["key"] == k), F.lit(0))["content"]
    first = lambda values: F.coalesce(*[article.cleaned(v) for v in values])
    named = read.withColumn("title", first([F.col("_ld.headline"), pick("og:title"), pick("twitter:title"), F.col("_heading"), F.col("_h1"), F.col("_title")]))
    said = F.array_compact(F.array(*[day(v) for v in (F.col("_ld.published"), F.col("_ld.any_date"), *map(pick, DATE_METAS))]))
    marked = F.array_compact(F.array(*[day(F.regexp_extract(h, form, 1)) for form in MARKED_DATES]))
    in_title = urls.date_in_title(F.col("title"))
    dated = F.coalesce(
        F.when(urls.host(F.col(url)) == TITLE_DATE_HOST, in_title), F.get(said, F.lit(0)), F.get(marked, F.lit(0)), urls.date_in_path(F.col(url)), in_title, day(F.col("_time")))
    own = article.cleaned(F.col("_ld.body"))
    return named.select(
        *pages.columns, "title", dated.alias("day"), article.resolved(F.col("_link"), F.col(url)).alias("canonical"),
        first([F.col("_ld.description"), pick("description"), pick("og:description")]).alias("summary"),
        F.when(F.length(own) >= article.ENOUGH, own).otherwise(F.coalesce("_body", own)).alias("body"))
