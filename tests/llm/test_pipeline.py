"""The pipeline's stages on a small fixture, and the SQL of the operators' queries."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from storyloom.llm import near_dedup, queries, quality_rules
from storyloom.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "decontamination", "SentencePiece"]


def test_pipeline_step_by_step(spark):
    """Each stage against what its operator says of the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    one = staged(stages[0](spark, docs, SF))
    assert one.columns == names and ids(one) == ids(quality_rules.score_quality(docs).where("kept"))
    two = staged(stages[1](spark, one, SF))
    assert two.columns == names and two.where("n_chars <> length(text)").isEmpty()
    three = staged(stages[2](spark, two, SF))
    assert three.columns == names and ids(three) == ids(near_dedup.near_duplicates(two, width=5).where("kept"))
    four = staged(stages[3](spark, three, SF))
    assert four.columns == names and ids(four) <= ids(three)
    five = stages[4](spark, four, SF)
    assert ids(five) == ids(four) and five.where("not round_trip").isEmpty()
    assert {(r["doc_id"], r["n_ids"]) for r in corpus_pipeline.run(spark, SF).collect()} == {(r["doc_id"], r["n_ids"]) for r in five.collect()}


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted(repr([r[i] for i in at]) for r in cursor.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want
