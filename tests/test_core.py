"""Operators and functions on literal rows and against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import article, markup, text, urls, vectors
from storyloom.operators import rank, state, themes, verdicts, windows
from storyloom.operators.scratch import clear, kept
from storyloom.streaming import events


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("conf", [{}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "512kb", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "64"}])
def test_ordinals_number_every_row_once(spark, conf):
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        wide = spark.range(40_000).select(((F.col("id") * 7919) % 40_000).alias("k"), (F.col("id") % 3).alias("g"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 5).alias("wide"))
        got = rank.ordinals(wide, ["k"]).select("k", "ordinal").collect()
        assert sorted(r["ordinal"] for r in got) == list(range(1, 40_001))
        assert all(r["ordinal"] == r["k"] + 1 for r in got)
        hot = wide.withColumn("g", F.when(F.col("k") % 5 == 0, F.col("k")).when(F.col("k") % 5 == 1, None).otherwise(-1))
        by_group: dict = {}
        for r in rank.ordinals(hot, [F.desc("k")], "n", ("g",)).collect():
            by_group.setdefault(r["g"], []).append((r["n"], -r["k"]))
        for rows in by_group.values():
            rows.sort()
            assert [n for n, _ in rows] == list(range(1, len(rows) + 1)) and rows == sorted(rows, key=lambda x: x[1])
        assert rank.ordinals(wide.where("false"), ["k"]).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_preference_weights_are_the_non_negative_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    x[:, 2] = x[:, 0] * 0.8 + rng.normal(size=400) * 0.3
    offset = rng.normal(size=400) * 0.2
    won = rng.random(400) < 1 / (1 + np.exp(-(x @ np.array([1.5, -0.7, -0.4]) + offset)))
    df = spark.createDataFrame([(*map(float, r), float(o), bool(w)) for r, o, w in zip(x, offset, won)], "a double, b double, c double, offset double, won boolean")
    got = np.array(rank.preference_weights(df, ["a", "b", "c"]))
    w = np.zeros(3)
    for _ in range(20_000):  # projected gradient
        p = 1 / (1 + np.exp(-(x @ w + offset)))
        w = np.maximum(0, w - 0.3 * ((x * (p - won)[:, None]).mean(0) + 0.01 * w))
    assert got[1] == 0 and np.abs(got - w).max() < 2e-4


def test_running_decay_over_decades(spark):
    rows = [(i, "a", datetime(2000, 1, 1) + timedelta(days=d)) for i, d in enumerate([0, 1, 3, 9000, 9001, 9001, 20000])]
    df = spark.createDataFrame(rows, "id long, token string, ts timestamp")
    got = [r["ema"] for r in windows.running_decay(df, "token", "ts", "id", 7 * 86400).orderBy("id").collect()]
    for i, (_, _, at) in enumerate(rows):
        want = sum(0.5 ** ((at - b).total_seconds() / 604800) for _, _, b in rows[: i + 1])
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_skip_fill_is_the_fold(spark):
    rng = random.Random(3)
    groups = [(rng.choice("ab"), i, rng.choice([1, 2, 3, 5, 9, 30])) for i in range(300)]
    df = spark.createDataFrame(groups, "stratum string, key long, size long")
    targets = {"a": 47, "b": 23}
    import hashlib

    want = set()
    for s, target in targets.items():
        total = 0
        for _, key, size in sorted((g for g in groups if g[0] == s), key=lambda g: hashlib.sha256(f"s{g[1]}".encode()).hexdigest()):
            if total + size <= target:
                total += size
                want.add((s, key, size))
    assert {tuple(r) for r in themes.skip_fill(df, targets, "s").collect()} == want
    assert themes.skip_fill(df.where("false"), targets, "s").count() == 0


def test_urls(spark):
    for raw, want in (
        ("https://WWW.FDA.gov/news/recall?utm_source=x&utm_medium=y&id=42#section", "https://www.fda.gov/news/recall?id=42"),
        ("https://fda.gov:443/a?b=2&a=1", "https://fda.gov/a?a=1&b=2"), ("https://fda.gov/a?a-b=1&a=2", "https://fda.gov/a?a=2&a-b=1"),
        ("https://fda.gov/news/", "https://fda.gov/news"), ("https://fda.gov/", "https://fda.gov/"),
    ):
        assert one(spark, urls.canonical(F.col("u")), u=raw) == want
    for raw, want in (
        ("http://[::ffff:10.0.0.1]/", "private address"), ("http://[2606:4700::1]/a", None), ("http://[::1]/", "private address"), ("https://a.gov.", None),
        ("https://a.gov:80/", "port"), ("ftp://a.gov/", "scheme"), ("http://192.0.2.1/", "private address"), ("http://8.8.4.4/", None), ("https://x@a.gov/", "credentials"),
    ):
        assert one(spark, urls.unsafe_reason(F.col("u")), u=raw) == want, raw
    assert str(one(spark, urls.date_in_path(F.col("u")), u="https://a.gov/x/2024/02/30/y?d=/2023/01/01/")) == "None"
    assert str(one(spark, urls.date_in_path(F.col("u")), u="https://a.gov/release_03152024.pdf")) == "2024-03-15"
    assert str(one(spark, urls.date_in_title(F.col("u")), u="Update of 3/7/2025")) == "2025-03-07"


def test_entities(spark):
    def found(title, summary=None, body=None):
        return one(spark, text.entities(F.col("t"), F.col("s").cast("string"), F.col("b").cast("string")), t=title, s=summary, b=body)

    got = found("Bureau Announces Audit of Quillmark", "Tessaron Shipping opened its books in the audit that began in spring.")
    assert {"quillmark", "tessaron"} <= set(got) and not {"bureau", "announces"} & set(got)
    assert found("BUREAU ANNOUNCES STATEWIDE REVIEW") == []
    assert "$7.25 million" in found("Office Awards Grant", "Counties will share $7.25 million for bridges.")
    wire = "Two Days Remain SALEM, Ore. – Oregon growers can still file a claim."
    assert {"salem", "oregon"} <= set(found("Office Issues Guidance", wire))
    assert {"santa", "fe", "quillmark"} - {"fe"} <= set(found("Office Issues Guidance", "SANTA FE – Quillmark sales begin again."))
    menu = "Home Calendar Permits Careers Libraries Boards Maps Newsroom Forms Payments Parks Meetings " * 3
    assert "libraries" not in found("Mayor Meets With Envoy Dornak", menu)
    assert "dornak" in found("Mayor Speaks", menu, "HARBOR CITY – The mayor thanked Dornak Foundry for its gift on Tuesday.")
    assert "dornak" not in found("Office Issues Guidance", "Quillmark sales begin again this week.", "Elsewhere Dornak Foundry closes.")
    keys = one(spark, text.event_keys(F.col("t")), t="filed in DOT-OST-2025-0077 under 14 CFR 25; CVE-2025-40404 and FR 2025-00912, Case No. 24-310, USDL No. 24-09")
    assert keys == ["2025-00912", "case no. 24-310", "cve-2025-40404", "dot-ost-2025-0077"]
    assert one(spark, text.nfkc(F.col("t")), t="ﬁne Ⅷ") == "fine VIII"
    same = [one(spark, text.content_hash(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("FDA  Recalls", "Straße  found."), ("fda recalls", "strasse found."))]
    assert same[0] == same[1]


def test_article_metadata(spark):
    ld = """<script type="application/ld+json">[{"@type": "WebSite", "name": "Not a title"}, {"@graph": [{"part": {"@type": ["Thing", "NewsArticle"],
      "headline": "From LD &amp; more", "datePublished": "2024-03-05T01:00:00Z", "description": "Said", "articleBody": "Too short"}}]}]</script>"""
    broken = '<script type="application/ld+json">{"@type": "Article",</script><script type="application/ld+json">{"datePosted": "2024-05-06", "name": "Org"}</script>'
    pages = [
        (1, f"<head>{ld}<meta property='og:title' content='Other'></head><h1>Head</h1><article><p>Body &amp; text</p></article>", "https://a.gov/x"),
        (2, '<meta content="Field &quot;two&quot;" name=twitter:title><meta name="DC.Date" content="March 7, 2024"><main>main&nbsp;part</main>', "https://a.gov/x"),
        (3, '<title>Only title 3/9/2023</title><link href="/c?q=1" rel="canonical">', "https://a.gov/d/x"),
        (4, '<h1> </h1><time datetime="2022-02-03T00:00">then</time>', "https://a.gov/2021/01/02/x"),
        (5, None, None),
        (6, f'{broken}<h1>Of the <b>site</b></h1><time datetime="2022-02-03">then</time>', "https://a.gov/x"),
        (7, "<h1>Fire update 7/8/2023</h1><meta name=date content=2020-01-01>", "https://inciweb.wildfire.gov/i/1"),
        (8, "<strong>News Release Date:</strong> July 1, 2019<p>x</p><meta name=description content='Meta &eacute;'>", "https://a.gov/2018/01/02/"),
        (9, "<time datetime='2017-06-05'></time>", "https://a.gov/none"),
    ]
    df = spark.createDataFrame(pages, "id long, html string, url string")
    got = {r["id"]: (r["title"], str(r["day"]), r["canonical"], r["summary"], r["body"]) for r in markup.article_metadata(df).collect()}
    assert got == {
        1: ("From LD & more", "2024-03-05", "https://a.gov/x", "Said", "Body & text"), 2: ('Field "two"', "2024-03-07", "https://a.gov/x", None, "main part"),
        3: ("Only title 3/9/2023", "2023-03-09", "https://a.gov/c?q=1", None, None), 4: (None, "2021-01-02", "https://a.gov/2021/01/02/x", None, "then"), 5: (None, "None", None, None, None),
        6: ("Of the site", "2024-05-06", "https://a.gov/x", None, "Of the sitethen"), 7: ("Fire update 7/8/2023", "2023-07-08", "https://inciweb.wildfire.gov/i/1", None, "Fire update 7/8/2023"),
        8: (None, "2019-07-01", "https://a.gov/2018/01/02/", "Meta é", "x"), 9: (None, "2017-06-05", "https://a.gov/none", None, None),
    }


def test_article_text_is_looked_for_in_order():
    long = "A sentence that is long enough to be taken for the text of the article at once, as it has many letters. " * 2
    menu = "<nav><p>Menu</p></nav><div class='share-buttons x'><p>Share</p></div><aside><p>Aside</p></aside><form><p>Form</p></form>"
    page = f"<body><header><p>Top</p></header><main><article><h2>Kicker</h2>{menu}<p>{long}<p>Second<ul><li>One<li>Two <b>bold</b></ul></article></main><footer><p>End</p></footer></body>"
    assert article.body_text(page) == f"Kicker {long.strip()} Second One Two bold"
    inner = f"<div class='field--name-body'><p>{long}</p></div>"
    assert article.body_text(page.replace("</article>", f"{inner}</article>")) == long.strip()
    short = "<article><p>Short one</p></article><div id=content><p>Short two</p></div>"
    assert article.body_text(short) == "Short one"  # none has enough: the first that has any
    two = f"<article><p>small</p></article><article><div>{long}</div></article>"
    assert article.body_text(two) == long.strip()  # the longest, all of it as it has no blocks
    assert article.body_text("<main><div hidden><p>no</p></div><div class=official-website-banner>no</div><p>yes<p>nested <blockquote><p>in it</p></blockquote></main>") == "yes nested in it"
    table = "<main><table><tr><td>a</td><td>b</td><tr><td>c</table><script>var x = '<p>no</p>'</script></main>"
    assert article.body_text(table) == "ab c"
    assert article.body_text("") is None and article.body_text("<p>&#8212;&nbsp;&copy;</p>") == "— ©" and article.body_text("<div>" * 5000 + "deep") == "deep"


def test_article_objects_at_any_depth():
    assert article.article_object({"a": [1, {"b": {"@type": "Report", "x": 1}}], "c": {"@type": "Article"}})["x"] == 1
    assert article.article_object([{"@type": "Person"}, "Article", None]) is None and article.article_object({"@type": ["Article"]}) is None
    assert article.first_string({"a": {"dateCreated": 5}, "b": [{"dateCreated": "later"}], "datePosted": "now"}, article.DATE_FIELDS) == "now"


def test_lexical_category(spark):
    rules = {"phrases": {"a": ("fire", "wild fire"), "b": ("tax",)}, "priors": {"irs": {"b": 2.0}}, "overrides": {"a": ("blaze",)}}
    for title, content, publisher, want in (
        ("Wild fire spreads", "the tax", "x", ("a", 7.7, "medium")), ("None", "a tax and a wild fire", "irs", ("b", 0.6, "low")),
        ("Blaze", "", "irs", ("a", 9.0, "high")), ("nothing", "", "x", ("a", 0.0, "low")),
    ):
        got = one(spark, text.lexical_category(F.col("t"), F.col("c"), F.col("p"), **rules), t=title, c=content, p=publisher)
        assert (got["category"], got["margin"], got["confidence"]) == want


def test_half_precision_bytes(spark):
    v = [0.1, -2.5, 3.0e-5, 65504.0]
    df = spark.createDataFrame([(v,), (None,), ([],)], "v array<float>").select("v", vectors.pack_fp16(F.col("v")).alias("p"))
    rows = df.select("v", "p", vectors.unpack_fp16(F.col("p")).alias("b")).collect()
    assert bytes(rows[0]["p"]) == np.array(v, np.float32).astype("<f2").tobytes() and rows[0]["b"] == np.array(v, np.float32).astype("<f2").astype(float).tolist()
    assert rows[1]["p"] is None and rows[1]["b"] is None and rows[2]["b"] == []


def test_verdict_scores(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    links = frame([("c1", 1, "m1", True), ("c1", 2, "m2", True), ("c2", 1, "m1", False), ("c2", 2, "m2", True)], "chain string, position int, method string, related boolean")
    chains = frame([("c1", "drifted", True), ("c2", "should_split", False)], "chain string, verdict string, endpoints boolean")
    r = verdicts.chain_scores(links, chains).first()
    assert (r["v1"], r["v1_n"], r["drift_rate"], r["worst_method"], r["worst_precision"]) == ((2 - 4) / 4, 4, 0.5, "m1", 0.5)
    members = frame([("t", True, False), ("t", True, False), ("t", False, False), ("t", True, True), ("u", True, False)], "theme string, fits boolean, planted boolean")
    by_theme = verdicts.theme_scores(members, frame([("t", "too_broad"), ("u", "right")], "theme string, verdict string"))
    got = {r["theme"]: (r["score"], r["discrimination"]) for r in by_theme.collect()}
    assert got["t"] == pytest.approx(((2 - 2 - 2) / 4 - 0.25, 2 / 3 - 1)) and got["u"] == (1.0, None)
    assert verdicts.theme_score(by_theme).first()["v2"] == pytest.approx((got["t"][0] + 1) / 2)
    over = frame([(True, False, True, True), (True, True, True, True)], "coverage boolean, faithful boolean, current boolean, representative boolean")
    assert verdicts.overview_score(over).first()["v7"] == (7 - 2) / 8
    scores = frame([(0.5, 4, 0.25, 2, 5, 3, 1.0, 2, 2, 0.75, 8, 0.5, 4, 0.625, 2)], "v1 double, v1_n int, v2 double, v2_themes int, v2_cases int, least_cases int, v3 double, v3_n int, merges int, v5 double, v5_n int, v6 double, v6_n int, v7 double, v7_n int")
    r = verdicts.reward(scores).first()
    assert r["reward"] == pytest.approx((0.5 + 0.25 + 1 + 0.75 + 0.5 + 0.625) / 6 - 0.04)
    assert r["flip_v1"] == pytest.approx(3 / 4 / 6) and r["flip_v2"] == pytest.approx(3 / 3 / 2 / 6)
    assert verdicts.event_score(frame([], "same_event boolean")).first()["v6"] is None


def _files(spark, path, batches):
    """A file stream that gives one of the batches at a time."""
    schema = "id long, token string, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_streams_keep_state_over_batches(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [[(1, "a", at(0)), (2, "b", at(1)), (3, "a", at(2))], [(4, "a", at(50)), (5, "b", at(80))], [(6, "a", at(60)), (7, "b", at(100)), (8, "c", at(200))]]
    rows = [r for b in batches for r in b]
    s = _files(spark, str(tmp_path / "dup"), batches)
    got = {r["id"]: r["duplicate_of"] for r in events.run_available(events.duplicate_flags(s, "token", 72)).collect()}
    want = {}
    for i, k, t in rows:
        before = [(u, j) for j, m, u in rows if m == k and (u, j) < (t, i) and t - u < timedelta(hours=72)]
        want[i] = max(before)[1] if before else None
    assert got == want


def test_stream_ema_counts_late_rows_in_order_and_forgets(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    end = [(None, None, at(5000))]
    batches = [[(1, "a", at(0)), (2, "b", at(1)), (3, "a", at(9))], [(4, "a", at(5)), (5, "b", at(12)), (6, "a", at(20))], [(7, "a", at(14)), (8, "c", at(30)), (9, "a", at(5))], [(10, "a", at(1)), (11, "a", at(40))], end]
    s = _files(spark, str(tmp_path / "ema"), batches)
    done = events.running_ema(s, "token", 86400.0, late="10 hours", forget=2)
    out = str(tmp_path / "out")
    query = done.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    ema = {r["id"]: r["ema"] for r in spark.read.schema(done.schema).parquet(out).collect()}
    rows = [r for b in batches[:4] for r in b if r[0] != 10]  # ten is older than rows that were counted before it came
    assert set(ema) == {r[0] for r in rows}
    for i, k, t in rows:
        assert ema[i] == pytest.approx(sum(0.5 ** ((t - u).total_seconds() / 86400) for j, m, u in rows if m == k and (u, j) <= (t, i)))
    assert max(states) == 3 and states[-1] == 0


def test_themes_live_on_over_sweeps(spark, tmp_path):
    """Clusters are given by a column: the same members keep their theme's id, a late batch sweeps its window and those
    after it again, a theme whose members are gone ends."""
    at = lambda d: datetime(2024, 1, 2) + timedelta(days=d)
    batches = [
        [(1, "x", at(0)), (2, "x", at(0)), (3, "x", at(1)), (4, "y", at(1)), (5, "y", at(1))],
        [(6, "x", at(2)), (7, "x", at(3)), (8, "z", at(3))],
        [(9, "z", at(3)), (10, "q", at(6))],
    ]
    s = _files(spark, str(tmp_path / "in"), batches)
    cluster = lambda rows: rows.select("id", F.col("token").alias("cluster"))
    out = events.theme_sweeps(s, "2 days", (tmp_path / "store").as_uri(), cluster, span=2, least=0.3)
    got = {}
    for r in out.collect():
        got.setdefault(((r["sweep_s"] - 1704153600) // 86400, r["theme"].split(":")[1]), set()).add(r["id"])
    assert got == {
        (0, "1"): {1, 2, 3}, (0, "4"): {4, 5}, (2, "1"): {1, 2, 3, 6, 7}, (2, "4"): {4, 5}, (2, "8"): {8, 9}, (6, "10"): {10},
    }


def test_sweeps_of_a_batch_cluster_once_and_ties_go_by_themes(spark, tmp_path):
    """Twelve windows of random clusters, many of them alike: what one sweep after the other gives, in one call a batch."""
    rng = random.Random(7)
    rows = [(i, rng.choice("abc"), datetime(2024, 1, 2) + timedelta(days=i // 8)) for i in range(96)]
    batches, calls = [rows[:70], rows[70:]], []
    s = _files(spark, str(tmp_path / "in"), batches)

    def cluster(seen):
        calls.append(1)
        return seen.select("id", F.col("token").alias("cluster"))

    out = events.theme_sweeps(s, "1 day", (tmp_path / "store").as_uri(), cluster, span=2, least=0.2)
    got = {}
    for r in out.collect():
        got.setdefault((r["sweep_s"], r["theme"]), set()).add(r["id"])
    want, before = {}, {}
    for day in range(12):
        start = int((datetime(2024, 1, 2) + timedelta(days=day) - datetime(1970, 1, 1)).total_seconds())
        groups = {}
        for i, token, _ in rows[max(0, 8 * day - 8) : 8 * day + 8]:
            groups.setdefault(token, set()).add(i)
        named = {f"{start}:{min(g)}": g for g in groups.values()}
        scored = sorted((-round(len(g & h) / len(g | h), 9), a, b) for a, g in named.items() for b, h in before.items() if len(g & h) >= 0.2 * len(g | h))
        match = {}
        for _, a, b in scored:
            if a not in match and b not in match.values():
                match[a] = b
        before = {match.get(a, a): g for a, g in named.items()}
        want |= {(start, t): g for t, g in before.items()}
    assert got == want and len(calls) == len(batches)


def test_a_sweep_sees_its_whole_window(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [[(1, "a", at(1)), (2, "a", at(30))], [(3, "a", at(5)), (4, "b", at(60))], [(5, "b", at(31))]]
    s = _files(spark, str(tmp_path / "in"), batches)
    out = events.sweeps(s, "1 day", lambda b: b.groupBy("sweep").agg(F.count("*").alias("n"), F.count_distinct("token").alias("tokens")), (tmp_path / "store").as_uri())
    assert sorted((r["sweep"].day, r["n"], r["tokens"]) for r in out.collect()) == [(1, 2, 1), (2, 2, 2), (3, 1, 1)]


def test_scratch_is_one_folder_for_the_application(spark):
    df = kept(spark.range(5))
    path = df.inputFiles()[0]
    assert f"storyloom-{spark.sparkContext.applicationId}" in path and df.count() == 5
    assert callable(clear)  # other tests of this session still read what it would delete


def test_dispositions_keep_every_row(spark):
    incoming = spark.createDataFrame(
        [(1, None, "x1", 1), (2, None, None, 2), (3, None, "x9", 3), (4, None, "x9", 4), (5, "u", None, 5), (6, "v", "x2", 6), (7, "v", None, 7), (8, "u", "x1", 8)],
        "id long, url string, external_id string, ordinal long")
    existing = spark.createDataFrame([(10, None, "x1"), (11, "u", None), (12, None, None)], "id long, url string, external_id string")
    got = {r["id"]: (r["disposition"], r["matched"]) for r in state.dispositions(incoming, existing).collect()}
    assert got == {
        1: ("existing_external_id", 10), 2: ("no_identity", None), 3: ("inserted", None), 4: ("repeated", None), 5: ("existing_url", 11), 6: ("inserted", None),
        7: ("repeated", None), 8: ("identity_conflict", 11),
    }


def test_sums_percentiles_and_neighbours_over_partitions(spark):
    """Groups that lie over several range partitions, nulls among groups and values, ties."""
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), rng.randrange(50) if i % 11 else None) for i in range(400)] + [(400, None, 3), (401, None, 4), (402, "none", None)]
    df = spark.createDataFrame(rows, "id long, g string, x long").repartition(7)
    got = {r["id"]: (r["sum"], r["n"]) for r in rank.running_sums(df, ("g",), ["id"], "x").collect()}
    for i, g, _ in rows:
        before = [x or 0 for j, h, x in rows if h == g and j <= i]
        assert got[i] == (sum(before), len(before))
    shares = {"low": 0.05, "mid": 0.5, "top": 1.0}
    for r in rank.percentiles(df, "g", "x", shares).collect():
        xs = [x for _, g, x in rows if g == r["g"] and x is not None]
        assert [r[n] for n in shares] == ([None] * 3 if not xs else pytest.approx([np.percentile(xs, 100 * s) for s in shares.values()]))
    ranked = rank.ordinals(df.where("g is not null"), ["id"], "position", ("g",))
    by_group = {g: [i for i, h, _ in rows if h == g] for g in ("a", "b", "none")}
    pairs = {(r["a"], r["b"], r["step"]) for r in rank.neighbour_pairs(ranked, ["g"], 2, "id").collect()}
    assert pairs == {(v[k], v[k + s], s) for v in by_group.values() for s in (1, 2) for k in range(len(v) - s)}
    near = {r["id"]: [x["id"] for x in r["near"]] for r in rank.neighbours(ranked, ["g"], 2, "id").collect()}
    assert near == {x: [*v[max(0, k - 2) : k], *v[k + 1 : k + 3]] for v in by_group.values() for k, x in enumerate(v)}
    share = {r["id"]: r["percentile"] for r in rank.percentile_of_rank(df, ("g",), ["id"]).collect()}
    assert all(share[x] == pytest.approx(k / max(1, len(v) - 1)) for v in by_group.values() for k, x in enumerate(v))


def test_ranked_rows_are_narrow_and_counted_without_copies(spark):
    """Distinct counts copy no row for each kind, a theme's ranking expands no other facet, weights read written pairs."""
    from storyloom.plans import ranking

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = [(1, 10, "2024-01-01", 5, "x", 2.0), (1, 10, "2024-01-01", 6, "x", 3.0), (1, 11, "2024-01-03", 5, "y", 1.0), (2, 12, "2024-01-02", None, None, None), (None, 13, "2024-01-02", 7, "z", 1.0)]
    df = spark.createDataFrame(rows, "storyline long, entry long, ts string, feed long, agency string, weight double")
    made = rank.storyline_rollup(df)
    assert "Expand" not in plan(made)
    assert {r["storyline"]: tuple(r)[1:] for r in made.collect()} == {
        1: (2, 2, ["x", "y"], "2024-01-01", "2024-01-03", 3.0), 2: (1, 0, [], "2024-01-02", "2024-01-02", None), None: (1, 1, ["z"], "2024-01-02", "2024-01-02", 1.0)}
    assert {r["storyline"]: r["agencies"] for r in rank.storyline_rollup(df, lists=False).collect()} == {1: 2, 2: 0, None: 1}
    sf = "/root/testdata/sf0.001"
    themes_only = ranking.c23_neighbour_pairs(spark, sf)
    assert "Generate explode(concat" not in plan(themes_only) and "facet_type" not in plan(themes_only)
    ranked = ranking._ranked(spark, sf)
    assert set(ranked.columns) == {"storyline", "rank_key", "first_at", "c_name", "facet_type", "facet_key", "position"}


def test_streams_call_python_for_buckets_of_keys(spark, tmp_path):
    """Many keys in a few buckets, over batches: fewer states than keys, and each key's own rows."""
    rng = random.Random(3)
    rows = [(i, f"k{rng.randrange(40)}", datetime(2024, 1, 1) + timedelta(hours=i // 4)) for i in range(600)]
    batches = [rows[:250], rows[250:400], rows[400:]]
    s = _files(spark, str(tmp_path / "in"), batches)
    out = events.duplicate_flags(s, "token", 6, buckets=3)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= 3
    got = {r["id"]: r["duplicate_of"] for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    for i, k, t in rows:
        before = [(u, j) for j, m, u in rows if m == k and (u, j) < (t, i)]
        assert got[i] == (max(before)[1] if before and t - max(before)[0] < timedelta(hours=6) else None)
    s = _files(spark, str(tmp_path / "ema"), [*batches, [(None, None, datetime(2100, 1, 1))]])
    ema = {r["id"]: r["ema"] for r in events.run_available(events.running_ema(s, "token", 86400.0, buckets=3)).collect()}
    for i, k, t in rows:
        assert ema[i] == pytest.approx(sum(0.5 ** ((t - u).total_seconds() / 86400) for j, m, u in rows if m == k and (u, j) <= (t, i)))
