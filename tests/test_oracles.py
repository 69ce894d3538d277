"""Each query of the library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from storyloom.plans import clusters, event_time, linking, outside, ranking, similarity, states, streams, texts, views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (ranking, event_time, texts, similarity, states, views, outside, clusters, linking, streams)
CASES = [(name, plan) for plan in PLANS for name in plan.QUERIES]

#: Queries that SQL can't express, and the test that holds their operator against brute force.
BRUTE_FORCE = {
    "b23_fp16": "test_core.test_half_precision_bytes",
    "h4_average_linkage": "test_clusters.test_average_linkage_is_one_merge_at_a_time",
    "h6_reconciliation": "test_clusters.test_matches_are_greedy",
    "h7_sweep_outcome": "test_clusters.test_sweep_outcome_of_all_kinds",
    "h7_sweep_assignments": "test_clusters.test_sweep_outcome_of_all_kinds",
    "j6_theme_sweeps": "test_core.test_themes_live_on_over_sweeps",
    "h12_preference_weights": "test_core.test_preference_weights_are_the_non_negative_optimum",
}


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize(("name", "plan"), CASES, ids=[n for n, _ in CASES])
def test_same_rows(spark, duck, name, plan):
    df = plan.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in plan.SQL:
        assert name in BRUTE_FORCE and got
        return
    cursor = duck.execute(plan.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert got == want


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(entry.queries()) >= {n for n, _ in CASES}
    assert set(entry.oracle_sql()) <= set(entry.queries())
