"""Text and URL queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import markup, text, urls, vectors
from storyloom.plans.roles import ENTRIES, entries, table

MARKERS = ("cookie", "javascript", "subscribe", "sign up", "skip to", "all rights", "enable", "404")
PHRASES = {"culture": ("eau", "de la", "un et"), "nature": ("thing", "the in", "river"), "state": ("tion", "und der", "of the"), "trade": ("there", "and hend", "ouv")}
PRIORS = {"src1": {"trade": 6.0}, "src2": {"state": 4.0, "nature": 1.0}, "src7": {"culture": 5.5}}
OVERRIDES = {"nature": ("wh,", "zu und"), "trade": ("enn",)}


def b1_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


def b2_canonical_url_secure(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", urls.canonical(F.col("url"), trackers=urls.NEWS_TRACKERS, secure_suffixes=(*urls.SECURE_SUFFIXES, ".example.com")).alias("canonical"))


def b3_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", text.content_hash(F.col("title"), F.col("summary")).alias("content_hash"))


def b4_candidate_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.candidate_key(F.col("page_id").cast("string"), F.col("url")).alias("candidate_key"))


#: Hosts that take the place of a page's own, by page_id, each with the reason why it isn't public (none: it is).
HOSTS = (
    ("www.fda.gov", None), ("user@www.fda.gov", "credentials"), ("www.fda.gov:443", None), ("www.fda.gov:8080", "port"),
    ("localhost", "local name"), ("a.local", "local name"), ("metadata.google.internal", "local name"), ("10.1.2.3", "private address"),
    ("8.8.8.8", None), ("172.16.0.1", "private address"), ("172.32.0.1", None), ("192.168.1.1", "private address"),
    ("100.64.0.1", "private address"), ("203.0.113.9", "private address"), ("300.1.1.1", "private address"), ("[::1]", "private address"),
    ("[::ffff:10.0.0.1]", "private address"), ("[::ffff:8.8.8.8]", None), ("[2606:4700::1111]", None), ("[2001:db8::1]", "private address"),
    ("[fe80::1]", "private address"), ("198.18.0.1", "private address"), ("224.0.0.1", "private address"),
)


def b7_unsafe_url(spark: SparkSession, d: str) -> DataFrame:
    """Of each page's URL with another host, and with another scheme for one page in five."""
    hosts = F.array(*[F.lit(h) for h, _ in HOSTS])
    at = F.element_at(hosts, (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    scheme = F.when(F.col("page_id") % 5 == 4, "ftp").otherwise("https")
    made = F.concat(scheme, F.lit("://"), at, F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]*", ""))
    return table(spark, d, "pages").select("page_id", urls.unsafe_reason(made).alias("reason"))


BASES = ("example.com", "example.net", "example.org")


def b8_domain_containment(spark: SparkSession, d: str) -> DataFrame:
    h = urls.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", *[urls.within(h, F.lit(b)).alias("in_" + b.split(".")[1]) for b in BASES])


def b13_strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(text.strip_markup(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)), 256).alias("h1_sha"))


def b12_title_and_heading(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", text.strip_markup(F.regexp_extract(h, "<title>(.*?)</title>", 1)).alias("title"),
        F.length(text.strip_markup(F.regexp_extract(h, "<h1>(.*?)</h1>", 1))).cast("long").alias("h1_chars"))


def b12_article_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Title, day, canonical address and body of pages with JSON-LD, meta fields, a time element or a marked date put in
    by page_id, as the given pages have none."""
    i = F.col("page_id")
    two = F.lpad((i % 28 + 1).cast("string"), 2, "0")
    ld = F.concat(F.lit('<script type="application/ld+json">{"name": "A site", "@graph": [{"@type": "WebPage", "name": "A page", "mainEntity": {"@type": "NewsArticle", "headline": "Graph '), i.cast("string"), F.lit('", "datePublished": "2024-03-'), two, F.lit('T10:00:00Z"}}]}</script>'))
    fields = F.concat(F.lit("<meta content='Field &amp; "), i.cast("string"), F.lit("' property='og:title'><meta name=\"DC.date\" content=\"2024-04-"), two, F.lit('">'))
    time = F.concat(F.lit('<time class=x datetime="2024-05-'), two, F.lit('">then</time>'))
    marked = F.concat(F.lit("<strong>News Release Date:</strong> June "), (i % 28 + 1).cast("string"), F.lit(", 2024<br>"))
    put = F.element_at(F.array(ld, fields, time, marked, F.lit("")), (i % 5 + 1).cast("int"))
    canonical = F.when(i % 3 == 0, F.concat(F.lit('<link href="https://x.gov/'), i.cast("string"), F.lit('" rel="shortlink canonical">'))).otherwise("")
    html = F.replace("html", F.lit("</head>"), F.concat(put, canonical, F.lit("</head>")))
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://x.gov/2024/07/"), two, F.lit("/a")).alias("url"), html.alias("html"))
    out = markup.article_metadata(p)
    return out.select("page_id", "title", F.date_format("day", "yyyy-MM-dd").alias("day"), "canonical", F.length("body").cast("long").alias("body_chars"))


def b13_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Attributes and elements of pages: language, character set, number of links, the first address, the title."""
    h = F.col("html")
    first = F.get(markup.tags(h, "a"), F.lit(0))
    return table(spark, d, "pages").select(
        "page_id", markup.attribute(F.get(markup.tags(h, "html"), F.lit(0)), "lang").alias("lang"), markup.attribute(F.get(markup.tags(h, "meta"), F.lit(0)), "charset").alias("charset"),
        F.size(markup.tags(h, "a")).cast("long").alias("links"), markup.attribute(first, "href").alias("first_href"), markup.inside(h, "title").alias("title"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Pages' URLs with a day in one of five forms, and a title with one. Some days don't exist."""
    i = F.col("page_id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    m, day = two(i % 14 + 1), two(i % 33 + 1)
    forms = [F.concat(F.lit("/2024/"), m, F.lit("/"), day, F.lit("/x")), F.concat(F.lit("/2024-"), m, F.lit("-"), day, F.lit(".html")),
             F.concat(F.lit("/a_"), m, day, F.lit("2024.pdf")), F.concat(F.lit("/n2024"), m, day, F.lit("-a")), F.lit("/none")]
    path = F.element_at(F.array(*forms), (i % len(forms) + 1).cast("int"))
    site = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*[^?#]*", 0)
    title = F.concat(F.lit("Notice of "), (i % 14 + 1).cast("string"), F.lit("/"), (i % 33 + 1).cast("string"), F.lit("/2023 given"))
    return table(spark, d, "pages").select("page_id", F.concat(site, path).alias("url"), title.alias("title"))


def b14_date_in_path(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _dated(spark, d).select("page_id", day(urls.date_in_path(F.col("url"))).alias("day"), day(urls.date_in_title(F.col("title"))).alias("title_day"))


def b16_title_patterns(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return entries(spark, d).select("id", t.rlike("(?i)^the |tion").alias("allowed"), t.rlike("(?i)\\bof\\b").alias("denied"))


def b17_entities(spark: SparkSession, d: str) -> DataFrame:
    found = text.entities(F.col("title"), F.col("summary"), F.col("body"))
    return entries(spark, d).select("id", F.array_join(found, ",").alias("entities"))


def keyed_text(e: DataFrame) -> DataFrame:
    """Entries with a text that names a vulnerability, a docket, a document or a case after their id, at its end."""
    mark = lambda form: F.format_string(form, F.col("id"))
    marks = [mark("CVE-2024-%07d"), mark("Docket No.  24-%04d"), mark("EPA-HQ-2023-%05d"), mark("2024-%06d"), mark("no-2024-%06d")]  # ids beyond a width stay whole
    at_end = F.element_at(F.array(*marks), (F.col("id") % len(marks) + 1).cast("int"))
    shared = F.format_string(" and Z-%04d-2024 Case no. 23-104.", F.col("id") % 5000)
    return e.withColumn("keyed", F.concat(text.keys_text(F.col("title"), F.col("summary"), F.col("body")), F.lit(" see "), at_end, shared))


def b18_event_keys(spark: SparkSession, d: str) -> DataFrame:
    return keyed_text(entries(spark, d)).select("id", F.array_join(text.event_keys(F.col("keyed")), ",").alias("keys"))


def b20_valid_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", text.is_valid_enrichment(F.col("summary"), MARKERS).alias("valid"))


def b21_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", F.sha2(_embedding_text(), 256).alias("text_sha"))


def _embedding_text() -> Column:
    """The summary if it is prose, else a title of some length, else the head of the body."""
    valid = text.is_valid_enrichment(F.col("summary"), MARKERS)
    return F.coalesce(F.when(valid, F.col("summary")), F.when(F.length("title") >= 20, F.col("title")), F.substring("body", 1, text.BODY_CAP))


def b22_bag_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Hashed bag of words of the embedding text: unit vector of 256 dimensions, as a list of its digits' sha256 and its
    non-zero entries."""
    chosen = entries(spark, d).select("id", _embedding_text().alias("t"))
    words = F.filter(F.transform(F.split(text.folded(F.col("t")), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()'\"]+|[.,;:!?()'\"]+$", "")), lambda w: F.length(w) >= 3)
    byte = lambda w, i: F.conv(F.substr(F.sha2(w, 256), F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("long")
    dims = chosen.select("id", F.explode(words).alias("w")).select("id", F.explode(F.array(byte(F.col("w"), 0), byte(F.col("w"), 1))).alias("dim"))
    counts = dims.groupBy("id", "dim").agg(F.count("*").alias("n"))
    made = counts.groupBy("id").agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"), F.array_sort(F.collect_list(F.struct("dim", "n"))).alias("seen"))
    dense = made.select("id", vectors.dense(F.col("seen"), "dim", "n", 256).alias("v"), "norm")
    unit = dense.select("id", F.posexplode("v").alias("dim", "x"), "norm").where("x > 0")
    return unit.select("id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x") / F.col("norm"), 9).alias("x"))


def b26_receipt(spark: SparkSession, d: str) -> DataFrame:
    fields = {"status": F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")), "key": F.col("o_orderkey"), "priority": F.col("o_orderpriority")}
    return table(spark, d, "orders").select("o_orderkey", text.receipt("v1", fields).alias("receipt"))


def b27_lexical_category(spark: SparkSession, d: str) -> DataFrame:
    """Categories by phrases in title and text, publishers' priors and overrides."""
    found = text.lexical_category(F.col("title"), F.col("body"), F.col("source"), phrases=PHRASES, priors=PRIORS, overrides=OVERRIDES)
    return entries(spark, d).select("id", found.alias("x")).select("id", "x.*")


def b28_title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", F.array_join(text.title_tokens(F.col("title")), " ").alias("tokens"))


def b30_theme_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.is_theme_name(F.col("p_name")).alias("valid"))


def b33_topology_class(spark: SparkSession, d: str) -> DataFrame:
    """Class of a storyline by its entries and episodes, and the flags that go with it."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("entries"), F.count_distinct("o_orderpriority").alias("episodes"))
    e = F.col("entries")
    return n.select("o_custkey", F.when(e == 1, "singleton").when(F.col("episodes") == 1, "single_episode").when(e <= 5, "short_chain").otherwise("long_chain").alias("class"),
                    (e > 1).alias("is_cluster"), (F.col("episodes") > 1).alias("is_multi_episode"), (e == 1).alias("is_singleton"), ((e > 1) & (e == F.col("episodes"))).alias("is_spread"))


def b38_probe_class(spark: SparkSession, d: str) -> DataFrame:
    h = F.lower("html")
    return table(spark, d, "pages").select("page_id", F.when(F.contains(h, F.lit("wp-content")), "wordpress").when(F.contains(h, F.lit("drupal")), "drupal")
        .when(F.contains(h, F.lit("<article")), "article").otherwise("other").alias("kind"))


def a5_archive_links(spark: SparkSession, d: str) -> DataFrame:
    """First-seen anchors of each page: address and text."""
    a = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">'), F.lit(1))
    t = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    links = table(spark, d, "pages").select("page_id", F.posexplode(F.arrays_zip(a.alias("href"), t.alias("text"))).alias("pos", "x"))
    return links.select("page_id", F.col("x.href").alias("href"), F.col("x.text").alias("text"), "pos").groupBy("page_id", "href").agg(
        F.min_by("text", "pos").alias("text"), F.min("pos").cast("long").alias("pos"))


def b9_feed_links(spark: SparkSession, d: str) -> DataFrame:
    """At most three landing links of each page whose address holds a mark."""
    return a5_archive_links(spark, d).where("href rlike '(?i)th|de'").groupBy("page_id").agg(
        F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda x: x["href"]), 1, 3), " ").alias("links"))


def b10_feed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Conventional feed addresses of each host, once."""
    paths = F.array(*[F.lit(p) for p in ("/feed", "/rss.xml", "/atom.xml")])
    return table(spark, d, "pages").select(urls.host(F.col("url")).alias("host")).distinct().select("host", F.posexplode(paths).alias("rank", "path")).select(
        F.concat(F.lit("https://"), "host", "path").alias("candidate"), F.col("rank").cast("long").alias("rank"))


def a11_partition_manifest(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", text.big_mod(F.sha2("body", 256), 97).alias("part"))


def a12_artifact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Objects of one declared hash: its duplicates, their bytes, and whether their sizes contradict it. The declared hash
    is that of the title, so that copies with another body are conflicts."""
    e = entries(spark, d).select(F.sha2("title", 256).alias("sha"), F.octet_length("body").cast("long").alias("bytes"))
    g = e.groupBy("sha").agg(F.count("*").alias("objects"), F.sum("bytes").alias("bytes"), (F.count_distinct("bytes") > 1).alias("conflict"))
    return g.where("objects > 1")


_CANON = """SELECT page_id, {scheme} || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END ||
  CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(list_transform(q, lambda p: {{'n': split_part(p, '=', 1), 'p': p}})), lambda x: x.p), '&') END AS canonical FROM (
  SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) AS host,
    regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')
      AND NOT list_contains({trackers}, lower(split_part(p, '=', 1)))) AS q FROM pages)"""
_STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
#: As HTML reads them, these four need no semicolon.
_READ = "regexp_replace({x}, '&(amp|lt|gt|quot);?', '&\\1;', 'g')"
_SQUEEZE = "replace(replace(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"
_VALID = ("(length(trim(summary)) >= 40 AND length(regexp_replace(summary, '[^A-Za-z0-9]', '', 'g')) >= 20 AND NOT ("
          + " OR ".join(f"contains(lower(summary), '{m}')" for m in MARKERS) + "))")
_STOPS = "[" + ",".join(f"'{w}'" for w in [*text.AGENCY_WORDS, *text.BOILERPLATE_WORDS]) + "]"
_CHOSEN = f"coalesce(CASE WHEN {_VALID} THEN summary END, CASE WHEN length(title) >= 20 THEN title END, substr(body, 1, 4000))"
_LINE = "\\b([A-Z][A-Z''.-]+(?:\\s+[A-Z][A-Z''.-]+)*)(?:,\\s*[A-Z][A-Za-z]{0,5}\\.?)?\\s+[–—-]\\s+"
_END = "(?s)^(.*?[.!?])(?:\\s|$)"
#: entity_sets (id, list) and key_sets (id, list) from entries. Accented letters count as letters at word ends.
ENTITY_SETS = f"""heads AS (SELECT id, title, v.which, v.t, regexp_extract(substr(v.t, 1, 240), '{_LINE}', 0) AS line, regexp_extract(substr(v.t, 1, 240), '{_LINE}', 1) AS city
  FROM entries, LATERAL (VALUES (1, summary), (2, substr(body, 1, 4000))) v(which, t)),
afters AS (SELECT *, CASE WHEN line = '' THEN t ELSE substr(t, instr(t, line) + length(line)) END AS after FROM heads),
proses AS (SELECT *, CASE WHEN length(regexp_extract(after, '{_END}', 1)) <= 241 THEN regexp_extract(after, '{_END}', 1) ELSE '' END AS sentence FROM afters),
chosen AS (SELECT x.id, x.title, CASE WHEN x.sentence = '' AND x.city = '' THEN y.sentence ELSE x.sentence END AS sentence, CASE WHEN x.sentence = '' AND x.city = '' THEN y.city ELSE x.city END AS city
  FROM proses x JOIN proses y ON x.id = y.id WHERE x.which = 1 AND y.which = 2),
spans AS (SELECT id, title || '. ' || sentence AS t, city FROM chosen),
span_words AS (SELECT id, unnest(flatten(list_transform(list_append(regexp_extract_all(regexp_replace(t, '[À-ɏ]', '_', 'g'), '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b'), city), lambda x: regexp_split_to_array(x, '\\s+')))) AS w FROM spans),
bare AS (SELECT id, lower(regexp_replace(w, '^[.,;:''"()]+|[.,;:''"()]+$', '', 'g')) AS w FROM span_words),
named AS (SELECT id, w FROM bare WHERE length(w) >= 4 AND NOT list_contains({_STOPS}, w)
  UNION SELECT id, {_SQUEEZE.format(x="unnest(regexp_extract_all(t, '(?i)\\$\\d[\\d,.]*(?:\\s?(?:million|billion|trillion))?'))")} FROM spans),
entity_sets AS (SELECT e.id, coalesce(list_sort(list(DISTINCT w) FILTER (WHERE w IS NOT NULL))[1:64], []) AS list FROM entries e LEFT JOIN named k ON e.id = k.id GROUP BY e.id)"""
_KEYED = """(title || '. ' || CASE WHEN summary = '' THEN substr(body, 1, 4000) ELSE summary END || ' see ' || CASE id % 5 WHEN 0 THEN printf('CVE-2024-%07d', id) WHEN 1 THEN printf('Docket No.  24-%04d', id)
  WHEN 2 THEN printf('EPA-HQ-2023-%05d', id) WHEN 3 THEN printf('2024-%06d', id) ELSE printf('no-2024-%06d', id) END || printf(' and Z-%04d-2024 Case no. 23-104.', id % 5000))"""
ALL_KEY_SETS = f"""keyed AS (SELECT id, {_KEYED} AS t FROM entries),
raw_keys AS (SELECT id, unnest(flatten([regexp_extract_all(t, '(?i)\\bCVE-\\d{{4}}-\\d{{4,7}}\\b'), regexp_extract_all(t, '\\b[A-Z]{{2,6}}(?:-[A-Z]{{1,6}})*-\\d{{4}}-\\d{{3,5}}(?:-\\d{{1,6}})?\\b'),
  regexp_extract_all(t, '(?:^|[^-\\w])(\\d{{4}}-\\d{{5,6}})\\b', 1), regexp_extract_all(t, '\\b[ZF]-\\d{{4}}-\\d{{2,4}}\\b'),
  regexp_extract_all(t, '(?i)\\b(?:case|docket)\\s+no\\.\\s?\\d{{2}}-\\d{{2,5}}\\b')])) AS k FROM keyed),
key_sets AS (SELECT e.id, coalesce(list_sort(list(DISTINCT lower(regexp_replace(k, '\\s+', ' ', 'g'))) FILTER (WHERE k IS NOT NULL)), []) AS list FROM entries e LEFT JOIN raw_keys r ON e.id = r.id GROUP BY e.id)"""
#: Keys of an entry that C12 and C13 block by at most.
MOST_KEYS = 16
KEY_SETS = ALL_KEY_SETS.replace("(WHERE k IS NOT NULL))", f"(WHERE k IS NOT NULL))[1:{MOST_KEYS}]")
_LINKS = """links AS (SELECT page_id, href, arg_min(t, pos) AS text, min(pos) AS pos FROM (
  SELECT page_id, unnest(a) AS href, unnest(t) AS t, unnest(range(len(a))) AS pos FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS a, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages)) GROUP BY 1, 2)"""

QUERIES = {f.__name__: f for f in (
    b1_canonical_url, b2_canonical_url_secure, b3_content_hash, b4_candidate_key, b7_unsafe_url, b8_domain_containment, b12_title_and_heading, b12_article_metadata, b13_lookups,
    b13_strip_markup, b14_date_in_path, b16_title_patterns, b17_entities, b18_event_keys, b20_valid_enrichment, b21_embedding_text, b22_bag_embedding,
    b26_receipt, b27_lexical_category, b28_title_tokens, b30_theme_names, b33_topology_class, b38_probe_class, a5_archive_links, b9_feed_links,
    b10_feed_candidates, a11_partition_manifest, a12_artifact_dedupe)}
SQL = {
    "b1_canonical_url": _CANON.format(scheme="scheme", trackers="[" + ",".join(f"'{t}'" for t in urls.TRACKERS) + "]"),
    "b2_canonical_url_secure": _CANON.format(scheme="CASE WHEN lower(host) LIKE '%.example.com' THEN 'https' ELSE scheme END", trackers="[" + ",".join(f"'{t}'" for t in urls.NEWS_TRACKERS) + "]"),
    "b3_content_hash": f"WITH {ENTRIES} SELECT id, sha256({_SQUEEZE.format(x='title')} || chr(10) || {_SQUEEZE.format(x='summary')}) AS content_hash FROM entries",
    "b4_candidate_key": "SELECT page_id, sha256(page_id || chr(10) || url) AS candidate_key FROM pages",
    "b7_unsafe_url": f"""WITH hosts(k, reason) AS (VALUES {", ".join(f"({i}, {'NULL' if r is None else repr(r)})" for i, (_, r) in enumerate(HOSTS))})
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'scheme' ELSE reason END AS reason FROM pages JOIN hosts ON page_id % {len(HOSTS)} = k""",
    "b8_domain_containment": "SELECT page_id, " + ", ".join(
        f"regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '(^|\\.){b.replace('.', '[.]')}$') AS in_{b.split('.')[1]}" for b in BASES) + " FROM pages",
    "b12_title_and_heading": f"SELECT page_id, {_STRIP.format(x="regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, length({_STRIP.format(x="regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS h1_chars FROM pages",
    "b12_article_metadata": f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Graph ' || page_id WHEN 1 THEN 'Field & ' || page_id ELSE nullif({_STRIP.format(x=_READ.format(x="regexp_extract(html, '<h1>(.*?)</h1>', 1)"))}, '') END AS title,
  printf('2024-%02d-%02d', CASE WHEN page_id % 5 = 2 THEN 7 ELSE 3 + page_id % 5 END, page_id % 28 + 1) AS day,
  CASE WHEN page_id % 3 = 0 THEN 'https://x.gov/' || page_id ELSE printf('https://x.gov/2024/07/%02d/a', page_id % 28 + 1) END AS canonical,
  nullif(length({_STRIP.format(x=_READ.format(x="regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<h1>.*?</h1>|<script.*?</script>', ' ', 'g'), '</?(b|i|br|a)( [^>]*)?>', '', 'g')"))}), 0) AS body_chars FROM pages""",
    "b13_lookups": f"""SELECT page_id, nullif(regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(html, '<meta[^>]*\\scharset="([^"]*)"', 1), '') AS charset,
  len(regexp_extract_all(html, '<a\\b[^>]*>')) AS links, nullif(regexp_extract(html, '<a\\b[^>]*\\shref="([^"]*)"', 1), '') AS first_href, nullif({_STRIP.format(x="regexp_extract(html, '<title>(.*?)</title>', 1)")}, '') AS title FROM pages""",
    "b13_strip_markup": f"SELECT page_id, sha256({_STRIP.format(x="regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS h1_sha FROM pages",
    "b14_date_in_path": """WITH x AS (SELECT page_id, page_id % 14 + 1 AS m, page_id % 33 + 1 AS d, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS old FROM pages),
p AS (SELECT *, old || CASE page_id % 5 WHEN 0 THEN printf('/2024/%02d/%02d/x', m, d) WHEN 1 THEN printf('/2024-%02d-%02d.html', m, d)
    WHEN 2 THEN printf('/a_%02d%02d2024.pdf', m, d) WHEN 3 THEN printf('/n2024%02d%02d-a', m, d) ELSE '/none' END AS path FROM x),
g AS (SELECT *, regexp_extract(path, '/(20\\d{2})/(0[1-9]|1[0-2])/(0[1-9]|[12]\\d|3[01])(?:/|$)', ['y', 'm', 'd']) AS a,
  regexp_extract(path, '/(20\\d{2})-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])(?:[./]|$)', ['y', 'm', 'd']) AS b,
  regexp_extract(path, '(?i)_(0[1-9]|1[0-2])(0[1-9]|[12]\\d|3[01])(20\\d{2})\\.[a-z0-9]+$', ['m', 'd', 'y']) AS c,
  regexp_extract(path, '(?:^|\\D)(20\\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\\d|3[01])(?:\\D|$)', ['y', 'm', 'd']) AS e FROM p)
SELECT page_id, strftime(coalesce(try_strptime(a.y || '-' || a.m || '-' || a.d, '%Y-%m-%d'), try_strptime(b.y || '-' || b.m || '-' || b.d, '%Y-%m-%d'),
  try_strptime(c.y || '-' || c.m || '-' || c.d, '%Y-%m-%d'), try_strptime(e.y || '-' || e.m || '-' || e.d, '%Y-%m-%d')), '%Y-%m-%d') AS day,
  CASE WHEN m <= 12 AND d <= 31 THEN strftime(try_strptime('2023-' || m || '-' || d, '%Y-%m-%d'), '%Y-%m-%d') END AS title_day FROM g""",
    "b16_title_patterns": f"WITH {ENTRIES} SELECT id, regexp_matches(title, '(?i)^the |tion') AS allowed, regexp_matches(title, '(?i)\\bof\\b') AS denied FROM entries",
    "b17_entities": f"WITH {ENTRIES}, {ENTITY_SETS} SELECT id, array_to_string(list, ',') AS entities FROM entity_sets",
    "b18_event_keys": f"WITH {ENTRIES}, {ALL_KEY_SETS} SELECT id, array_to_string(list, ',') AS keys FROM key_sets",
    "b20_valid_enrichment": f"WITH {ENTRIES} SELECT id, {_VALID} AS valid FROM entries",
    "b21_embedding_text": f"WITH {ENTRIES} SELECT id, sha256({_CHOSEN}) AS text_sha FROM entries",
    "b22_bag_embedding": f"""WITH {ENTRIES}, w AS (SELECT id, unnest(list_filter(list_transform(regexp_split_to_array(replace(replace(lower({_CHOSEN}), 'ß', 'ss'), 'ς', 'σ'), '\\s+'),
  lambda x: regexp_replace(x, '^[.,;:!?()''"]+|[.,;:!?()''"]+$', '', 'g')), lambda x: length(x) >= 3)) AS w FROM entries),
dims AS (SELECT id, unnest([CAST('0x' || substr(sha256(w), 1, 2) AS BIGINT), CAST('0x' || substr(sha256(w), 3, 2) AS BIGINT)]) AS dim FROM w),
c AS (SELECT id, dim, count(*) AS n FROM dims GROUP BY 1, 2)
SELECT id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 9) AS x FROM c""",
    "b26_receipt": """SELECT o_orderkey, 'v1:' || sha256('{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":' || CASE WHEN o_orderkey % 9 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS receipt FROM orders""",
    "b27_lexical_category": f"""WITH {ENTRIES}, f AS (SELECT id, source, replace(replace(lower(title), 'ß', 'ss'), 'ς', 'σ') AS t, replace(replace(lower(body), 'ß', 'ss'), 'ς', 'σ') AS c FROM entries),
rules(category, phrase, hi, lo) AS (VALUES {", ".join(f"('{k}', '{p}', {(5.0 if ' ' in p else 3.5)}::DOUBLE, {(1.4 if ' ' in p else 0.8)}::DOUBLE)" for k, ps in PHRASES.items() for p in ps)}),
priors(source, category, w) AS (VALUES {", ".join(f"('{s}', '{k}', {w}::DOUBLE)" for s, g in PRIORS.items() for k, w in g.items())}),
over(category, phrase) AS (VALUES {", ".join(f"('{k}', '{p}')" for k, ps in OVERRIDES.items() for p in ps)}),
s AS (SELECT f.id, r.category, sum(CASE WHEN contains(t, phrase) THEN hi WHEN contains(c, phrase) THEN lo ELSE 0 END)
  + coalesce((SELECT sum(w) FROM priors p WHERE p.source = any_value(f.source) AND p.category = r.category), 0)
  + CASE WHEN (SELECT count(*) FROM over o WHERE o.category = r.category AND contains(any_value(f.t), o.phrase)) > 0 THEN 11 ELSE 0 END AS score FROM f, rules r GROUP BY f.id, r.category),
r AS (SELECT id, category, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, category) AS rn FROM s),
b AS (SELECT id, max(category) FILTER (WHERE rn = 1) AS category, max(score) FILTER (WHERE rn = 1) AS top, round(max(score) FILTER (WHERE rn = 1) - max(score) FILTER (WHERE rn = 2), 6) AS margin FROM r GROUP BY id)
SELECT id, category, margin, CASE WHEN top >= 9 AND margin >= 4 THEN 'high' WHEN top >= 6 AND margin >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM b""",
    "b28_title_tokens": f"WITH {ENTRIES} SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4))), ' ') AS tokens FROM entries",
    "b30_theme_names": "SELECT p_partkey, len(regexp_split_to_array(trim(p_name), '\\s+')) BETWEEN 2 AND 5 AND len(list_filter(regexp_split_to_array(trim(p_name), '\\s+'), lambda w: NOT regexp_full_match(w, '[A-Za-z0-9]+'))) = 0 AS valid FROM part",
    "b33_topology_class": "SELECT o_custkey, CASE WHEN count(*) = 1 THEN 'singleton' WHEN count(DISTINCT o_orderpriority) = 1 THEN 'single_episode' WHEN count(*) <= 5 THEN 'short_chain' ELSE 'long_chain' END AS class, count(*) > 1 AS is_cluster, count(DISTINCT o_orderpriority) > 1 AS is_multi_episode, count(*) = 1 AS is_singleton, count(*) > 1 AND count(*) = count(DISTINCT o_orderpriority) AS is_spread FROM orders GROUP BY 1",
    "b38_probe_class": "SELECT page_id, CASE WHEN contains(lower(html), 'wp-content') THEN 'wordpress' WHEN contains(lower(html), 'drupal') THEN 'drupal' WHEN contains(lower(html), '<article') THEN 'article' ELSE 'other' END AS kind FROM pages",
    "a5_archive_links": f"WITH {_LINKS} SELECT page_id, href, text, pos FROM links",
    "b9_feed_links": f"WITH {_LINKS} SELECT page_id, array_to_string(list(href ORDER BY pos)[1:3], ' ') AS links FROM links WHERE regexp_matches(href, '(?i)th|de') GROUP BY 1",
    "b10_feed_candidates": "SELECT DISTINCT 'https://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || path AS candidate, CAST(r AS BIGINT) AS rank FROM pages, (VALUES ('/feed', 0), ('/rss.xml', 1), ('/atom.xml', 2)) p(path, r)",
    "a11_partition_manifest": "SELECT doc_id AS id, CAST(list_reduce([0::HUGEINT] || list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha256(text), CAST(i * 8 + 1 AS BIGINT), 8) AS HUGEINT)), lambda a, b: (a * 4294967296 + b) % 97) AS BIGINT) AS part FROM documents",
    "a12_artifact_dedupe": f"WITH {ENTRIES} SELECT sha256(title) AS sha, count(*) AS objects, CAST(sum(strlen(body)) AS BIGINT) AS bytes, count(DISTINCT strlen(body)) > 1 AS conflict FROM entries GROUP BY 1 HAVING count(*) > 1",
}
