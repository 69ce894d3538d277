"""Literal cases of the column functions."""

from __future__ import annotations

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text, urls, vectors
from storyloom.operators import components, similar, windows


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def test_canonical_url(spark):
    c = urls.canonical(F.col("u"))
    assert one(spark, c, u="HTTPS://Example.GOV:443/a/b/?utm_source=x&b=2&a=1&gclid=q#top") == "https://example.gov/a/b?a=1&b=2"
    assert one(spark, c, u="http://example.gov") == "http://example.gov/"
    assert one(spark, c, u="http://example.gov:8080/x/") == "http://example.gov:8080/x"


def test_unsafe_url(spark):
    r = urls.unsafe_reason(F.col("u"))
    for u, why in (("ftp://a.gov/", "scheme"), ("http://me@a.gov/", "credentials"), ("http://a.gov:22/", "port"), ("http://localhost/", "local name"),
                   ("http://10.1.2.3/", "private address"), ("http://172.20.0.1/", "private address"), ("https://a.gov/x", None), ("http://8.8.8.8/", None)):
        assert one(spark, r, u=u) == why, u


def test_content_hash_ignores_case_and_space(spark):
    h = text.content_hash(F.col("t"), F.col("s"))
    assert one(spark, h, t="  A  Title", s="Text\n here ") == one(spark, h, t="a title", s="text here")
    assert one(spark, h, t="a", s=None) == hashlib.sha256(b"a\n").hexdigest()


def test_event_keys(spark):
    k = text.event_keys(F.col("t"))
    assert one(spark, k, t="CVE-2024-12345 and FR 2024-12345; EPA-HQ-2023-0123 Case No. 24-123; 1-2024-12345") == ["2024-12345", "case no. 24-123", "cve-2024-12345", "epa-hq-2023-0123"]


def test_event_keys_are_all_kept(spark):
    """A text that names forty documents has forty keys; the first ones only where a caller asks for that."""
    names = [f"cve-2024-{i:05d}" for i in range(40)]
    assert one(spark, text.event_keys(F.col("t")), t=" ".join(reversed(names))) == names
    assert one(spark, text.event_keys(F.col("t"), 16), t=" ".join(reversed(names))) == names[:16]


@pytest.mark.parametrize(("name", "keys"), [("b18_event_keys", lambda r: len(r["keys"].split(","))), ("b19_reextraction", lambda r: r["keys"])])
def test_queries_give_all_event_keys(spark, tmp_path, name, keys):
    """The query and its SQL list every key of an entry that names forty."""
    import duckdb

    from storyloom.plans import outside, texts

    rows = [(15, " ".join(f"CVE-2024-{i:05d}" for i in range(40)) + "\nof this week", "en", "a", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    plan = texts if name in texts.QUERIES else outside
    (got,) = plan.QUERIES[name](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert con.execute(plan.SQL[name]).fetchall() == [tuple(got)]
    assert keys(got) == 43  # and three that the query adds


def test_entities(spark):
    e = text.entities(F.col("t"), F.col("s"))
    assert one(spark, e, t="FDA Recalls Zantac", s="Sanofi paid $4.5 million to Ohio. Later Ignored.") == ["$4.5 million", "ohio", "sanofi", "zantac"]


def test_date_in_path(spark):
    assert one(spark, urls.date_in_path(F.col("u")), u="https://a.gov/news/2024/03/09/x") == datetime.date(2024, 3, 9)
    assert one(spark, urls.date_in_path(F.col("u")), u="https://a.gov/news/2024/3/9/x") is None
    assert one(spark, urls.date_in_path(F.col("u")), u="https://a.gov/2024/13/40/x") is None


def test_cosine_of_zero_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_duplicate_window_is_strict(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, "h", t), (2, "h", t + datetime.timedelta(hours=72)), (3, "h", t + datetime.timedelta(hours=143))]
    df = spark.createDataFrame(rows, "id long, h string, ts timestamp")
    out = {r["id"]: r["duplicate_of"] for r in windows.earlier_duplicate(df, "h", "ts", "id", 72).collect()}
    assert out == {1: None, 2: None, 3: 2}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_no_pair_of_vectors_is_shuffled(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)], "id long, embedding array<double>")
    plan = similar.nearest_neighbours(rows, rows, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    from conftest import ROOT

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_keys_of_large_ids_stay_whole(spark):
    """Ids of more digits than a key's width, as SQL's printf has them."""
    from storyloom.plans.texts import keyed_text

    ids = [7, 12_340, 12_341, 123_456, 1_234_567, 1_234_568, 12_345_679, 123_456_780]
    forms = ("CVE-2024-%07d", "Docket No.  24-%04d", "EPA-HQ-2023-%05d", "2024-%06d", "no-2024-%06d")
    e = spark.createDataFrame([(i, "T", "S", "B") for i in ids], "id long, title string, summary string, body string")
    want = {i: f"T. S see {forms[i % 5] % i} and Z-{i % 5000:04d}-2024 Case no. 23-104." for i in ids}
    assert {r["id"]: r["keyed"] for r in keyed_text(e).collect()} == want


def test_attach_mix_judges_similarities_as_they_are_given(spark, tmp_path):
    """a cosine of 0.3499997 is 0.35 to six digits, in which matches are given."""
    from storyloom.plans.views import d13_attach_mix

    x = 0.3499997
    spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [x, (1 - x * x) ** 0.5], 0)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {(r["method"], r["n"], r["similarity"]) for r in d13_attach_mix(spark, str(tmp_path)).collect()} == {("new", 1, None), ("near_duplicate", 1, 0.35)}


def test_sql_of_article_metadata_reads_references_without_semicolon(spark, tmp_path):
    """&amp at the end of a heading is &, as HTML has it, in the query and in its SQL."""
    import duckdb

    from storyloom.plans import texts

    page = "<html><head><title>T</title></head><body><article><h1>a&amp;&amp</h1><p>b &lt c and &quot;d&quot</p></article></body></html>"
    spark.createDataFrame([(2, "http://x.org/a", page)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    row = texts.b12_article_metadata(spark, str(tmp_path)).first()
    cursor = con.execute(texts.SQL["b12_article_metadata"])
    assert dict(zip([d[0] for d in cursor.description], cursor.fetchone(), strict=True)) == row.asDict()
    assert (row["title"], row["body_chars"]) == ("a&&", len('b < c and "d"'))
