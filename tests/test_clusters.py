"""Cluster operators against brute force on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.operators import blocks, similar, themes
from storyloom.operators.components import connected_components
from storyloom.plans import clusters


def test_best_in_groups_sees_every_group(spark):
    """One label holds the 45 nearest members; the others' best must be there too."""
    rows = [(0, "q", [1.0, 0.0])] + [(i, "hot", [1.0, i / 1000]) for i in range(1, 46)] + [(100, "x", [1.0, 1.0]), (101, "y", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, label string, embedding array<double>")
    got = {r["label"]: r["sim"] for r in similar.best_in_groups(df.where("id = 0"), df, "label").collect()}
    assert set(got) == {"hot", "x", "y"}
    assert abs(got["x"] - 0.5**0.5) < 1e-6 and abs(got["y"]) < 1e-6


def test_overlap_edges_have_no_cap_on_holders(spark):
    rng = np.random.default_rng(3)
    sets = {i: {"a", "b", "c"} for i in range(90)}  # one set in more rows than the old cap of 40
    sets |= {i: set(rng.choice(list("abcdefghijkl"), rng.integers(2, 6), replace=False).tolist()) for i in range(90, 130)}
    sets |= {i: {f"t{i}", f"u{i}", "a", "b"} for i in range(200, 205)}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, token string")
    got = {r["node"]: r["component"] for r in connected_components(similar.overlap_edges(df, 3)).collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 3]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {i: find(i) for i in {n for p in pairs for n in p}}
    assert max(Counter(got.values()).values()) >= 90


def _linked(x: np.ndarray, stop: float) -> set[frozenset]:
    """Average linkage, one merge at a time."""
    sims = x @ x.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        mean, i, j = max((sims[np.ix_(groups[i], groups[j])].mean(), i, j) for i in range(len(groups)) for j in range(i))
        if mean < stop:
            break
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


def test_average_linkage_is_one_merge_at_a_time(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(x)], "id long, label string, embedding array<double>")
    got: dict[int, set] = {}
    for r in themes.average_linkage(df.select("id", "embedding"), themes.theme_edges(df, "label", 0.4), 0.4).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == _linked(x, 0.4)
    assert all(c == min(g) for c, g in got.items())


def test_average_linkage_splits_large_components(spark):
    """2,101 rows in one component: one row links two bundles that average linkage keeps apart."""
    rows = [(i, [1.0, 0.0]) for i in range(1050)] + [(1050 + i, [0.0, 1.0]) for i in range(1050)] + [(2100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    tree = spark.createDataFrame([(0, 2100), (1050, 2100)], "a long, b long")
    full = spark.range(2100).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 20)).alias("b"))
    full = full.where("b < 2100 and floor(a / 1050) = floor(b / 1050)")
    got = {r["id"]: r["cluster"] for r in themes.average_linkage(df, full.union(tree), 0.6).collect()}
    assert got[5] == 0 and got[1500] == 1050 and len(got) == 2101


def test_matches_are_greedy(spark):
    rng = np.random.default_rng(11)
    edges = [(int(a), int(b) + 100, float(s)) for a in range(12) for b in range(12) if (s := round(rng.random(), 1)) > 0.3]
    want, left, right = set(), set(), set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in left and b not in right:
            want.add((a, b, s))
            left.add(a)
            right.add(b)
    df = spark.createDataFrame(edges, "l long, r long, score double")
    assert {tuple(r) for r in themes.greedy_matches(df).collect()} == want
    assert themes.greedy_matches(df.where("false")).count() == 0


def test_sweep_outcome_of_all_kinds(spark):
    clusters = spark.createDataFrame([(1, False), (2, False), (3, True)], "cluster long, failed boolean")
    all_themes = spark.createDataFrame([(10, False), (11, True), (12, False)], "theme long, manual boolean")
    matches = spark.createDataFrame([(1, 10, 0.9)], "l long, r long, score double")
    out = themes.sweep_outcome(clusters, all_themes, matches)
    assert {tuple(r) for r in out.collect()} == {(1, 10, "kept"), (2, None, "created"), (3, None, "failed"), (None, 11, "kept"), (None, 12, "protected")}
    calm = themes.sweep_outcome(clusters.where("not failed"), all_themes, matches)
    assert {(r["theme"], r["action"]) for r in calm.where("cluster is null").collect()} == {(11, "kept"), (12, "demoted")}
    members = spark.createDataFrame([(100, 1), (101, 2), (102, 3)], "id long, cluster long")
    assert {tuple(r) for r in themes.assignments(members, out).collect()} == {(100, 10, False), (101, 2, True)}


def test_theme_edges_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, label int, embedding array<double>")
    monkeypatch.setattr(similar, "BLOCK_ROWS", 7)
    got = {tuple(r) for r in themes.theme_edges(df, "label", 0.5).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {(a, b) for a, b in combinations(range(60), 2) if a % 2 == b % 2 and u[a] @ u[b] >= 0.5}
    groups = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(20, 3)))], "g long, centroid array<double>")
    top = similar.nearest_groups(df, groups, "g", least=-1.0, k=3).collect()  # more groups than a block holds
    monkeypatch.setattr(similar, "BLOCK_ROWS", 2000)
    assert sorted(map(tuple, top)) == sorted(map(tuple, similar.nearest_groups(df, groups, "g", least=-1.0, k=3).collect()))


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 2)])
def test_top_sharing_is_brute_force(spark, monkeypatch, seed, least):
    """Tokens that nearly every row holds, rows of only such tokens, rows with more of them than combinations are listed."""
    rng = random.Random(seed)
    monkeypatch.setattr(similar, "LONG_LIST", 6)
    monkeypatch.setattr(similar, "MOST_HOT", 3)
    vocabulary = [f"w{i}" for i in range(40)]
    frequency = [1 / (1 + i) for i in range(40)]
    sets = {i: set(rng.choices(vocabulary, frequency, k=rng.randint(1, 6))) for i in range(150)}
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, token string")
    weight = {t: float(sum(t in s for s in sets.values())) for t in vocabulary}
    weights = spark.createDataFrame(list(weight.items()), "token string, weight double")
    want = []
    for i, s in sets.items():
        scored = [(-round(sum(1 / (1 + weight[t]) for t in s & sets[b]), 9), -len(s & sets[b]), b) for b in sets if b < i and len(s & sets[b]) >= least]
        want += [(i, b, pytest.approx(-x), -n, rank) for rank, (x, n, b) in enumerate(sorted(scored)[:3], 1)]
    got = sorted(tuple(r) for r in similar.top_sharing(rows, weights, 3, least).select("id", "b", "score", "shared", "rank").collect())
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    pairs = {tuple(r) for r in similar.sharing_pairs(rows, least).select("a", "b", "shared").collect()}
    assert pairs == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}


def test_rows_joined_by_a_hot_token_grow_with_the_table(spark, monkeypatch):
    """A token that all rows hold: candidates are 3 for a row, not all before it."""
    written = []
    keep = similar.kept
    monkeypatch.setattr(similar, "kept", lambda df: written.append(keep(df)) or written[-1])
    rows = spark.range(2000).select("id", F.explode(F.array(F.lit("all"), F.concat(F.lit("own"), "id"))).alias("token"))
    weights = rows.groupBy("token").agg(F.count("*").cast("double").alias("weight"))
    got = similar.top_sharing(rows, weights, 3)
    assert got.where("id >= 3").groupBy("id").agg(F.array_sort(F.collect_list("b")).alias("b")).where("b <> array(0, 1, 2)").isEmpty()
    pairs = [df for df in written if df.columns == ["id", "b"]]
    assert len(pairs) == 1 and pairs[0].count() <= 3 * 2000


def _written(monkeypatch) -> list:
    out, keep = [], similar.kept
    monkeypatch.setattr(similar, "kept", lambda df: out.append(keep(df)) or out[-1])
    return out


def test_token_joins_write_no_pairs(spark, monkeypatch):
    """Rows with many frequent tokens give edges, facts and best rows without a table of pairs."""
    rng = random.Random(3)
    sets = {i: set(rng.sample([f"w{j}" for j in range(30)], 12)) for i in range(300)}
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, token string")
    weights = spark.createDataFrame([(f"w{j}", 0.0) for j in range(30)], "token string, weight double")
    monkeypatch.setattr(similar, "BLOCK_SETS", 90)
    monkeypatch.setattr(similar, "BLOCK_PAIRS", 90)
    written = _written(monkeypatch)
    edges = similar.overlap_edges(rows, 3)
    assert edges.count() <= 8 * 300  # of about 43,000 pairs that share three
    assert all(len(sets[r["a"]] & sets[r["b"]]) >= 3 for r in edges.collect())
    best = {(r["id"], r["rank"]): (r["b"], r["shared"]) for r in similar.top_sharing(rows, weights, 2, 2).collect()}
    for i in sets:
        want = sorted((-len(sets[i] & sets[b]), b) for b in range(i) if len(sets[i] & sets[b]) >= 2)[:2]
        assert [best.get((i, k + 1)) for k in range(len(want))] == [(b, -n) for n, b in want]
    carry = spark.range(300).select("id", (F.col("id") * 2).alias("x"))
    facts = similar.sharing_pairs(rows, 6, carry=carry, words=True).collect()
    assert {(r["a"], r["b"]): (r["shared"], r["words"], r["xa"], r["xb"]) for r in facts} == {
        (a, b): (len(sets[a] & sets[b]), " ".join(sorted(sets[a] & sets[b])), 2 * a, 2 * b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 6}
    assert all(df.count() <= 12 * 300 and {"a", "b"} - set(df.columns) for df in written)


def _documents(spark, tmp_path, titles: dict[int, str]):
    import duckdb

    rows = [(i, f"{t}\nsummary", "en", f"source_{i % 3}", 9) for i, t in titles.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    return str(tmp_path), lambda sql, *columns: con.execute(f"select {', '.join(columns)} from ({sql})").fetchall()


COPIES = {1: "harbour bridge closes", 2: "Harbour bridge closes", 3: "harbour bridge closes", 4: "bridge closes tonight", 5: "bridge closes tonight", 6: "unread letters",
          7: "harbour bridge closes tonight", 8: "bridge closes"}


@pytest.mark.parametrize("hot", [8, 0])
def test_candidates_of_copies_are_whole(spark, monkeypatch, tmp_path, hot):
    """entries whose words an earlier entry has too get their own three candidates, with lists and with blocks."""
    monkeypatch.setattr(similar, "LONG_LIST", 2)
    monkeypatch.setattr(similar, "MOST_HOT", hot)
    d, sql = _documents(spark, tmp_path, COPIES)
    words = {i: set(t.lower().split()) for i, t in COPIES.items()}
    want = set()
    for b in COPIES:
        earlier = [a for a in COPIES if a < b]
        same = [a for a in earlier if COPIES[a] == COPIES[b]][:1]
        met = [(0 if a in same else 1, -len(words[a] & words[b]), a) for a in earlier if a in same or len(words[a] & words[b]) >= 2]
        want |= {(a, b, p, -n, rank) for rank, (p, n, a) in enumerate(sorted(met)[:3], 1)}
    columns = ("a", "b", "priority", "shared", "rank")
    assert {tuple(r) for r in clusters.c10_candidate_merge(spark, d).select(*columns).collect()} == want
    assert set(sql(clusters.SQL["c10_candidate_merge"], *columns)) == want
    assert {(3, 4), (4, 8)} & {(a, b) for a, b, *_ in want}


def test_facts_of_copies_are_whole(spark, tmp_path):
    """each pair of entries that shares two words has its facts, copies too."""
    d, sql = _documents(spark, tmp_path, COPIES)
    words = {i: set(t.lower().split()) for i, t in COPIES.items()}
    want = {(a, b, len(x), " ".join(sorted(x)), round((b - a) * 7 / 60, 6), 0, round(len(x) / len(words[a] | words[b]), 6))
            for a, b in combinations(COPIES, 2) if len(x := words[a] & words[b]) >= 2}
    columns = ("a", "b", "shared", "words", "gap_hours", "gap_days", "similarity")
    assert sorted(tuple(r) for r in clusters.c11_candidate_facts(spark, d).select(*columns).collect()) == sorted(want)
    assert sorted(sql(clusters.SQL["c11_candidate_facts"], *columns)) == sorted(want)


def test_verdicts_carry_no_titles(spark, monkeypatch, tmp_path):
    """pairs of classes get the same preference from a place among all classes, and rows are dealt in few blocks."""
    made = []
    before = blocks.before
    monkeypatch.setattr(blocks, "before", lambda rows, n, *a, **b: made.append((rows, n)) or before(rows, n, *a, **b))
    titles = {i: f"harbour bridge part{(89 - i) % 40:03d} {'x' * 300}" for i in range(90)} | {100: "harbour", 101: "bridge"}
    d, sql = _documents(spark, tmp_path, titles)
    columns = ("a", "b", "same_event", "member", "prefers")
    got = sorted(tuple(r) for r in clusters.j1_stub_verdicts(spark, d).select(*columns).collect())
    assert got == sorted(sql(clusters.SQL["j1_stub_verdicts"], *columns)) and {r[-1] for r in got} == {"a", "b"}
    ((rows, n),) = made
    assert n == 1 and set(rows.columns) == {"id", "tokens", "place"} and rows.dtypes[rows.columns.index("tokens")][1] == "array<bigint>"


def test_best_rows_are_dealt_narrow(spark, monkeypatch):
    """rows that meet block by block are dealt with numbers for words, and the earlier side without weights."""
    made = []
    before = blocks.before
    monkeypatch.setattr(blocks, "before", lambda rows, n, *a, **b: made.append((dict(rows.dtypes), b)) or before(rows, n, *a, **b))
    monkeypatch.setattr(similar, "LONG_LIST", 1)
    monkeypatch.setattr(similar, "MOST_HOT", 0)
    rows = spark.createDataFrame([(i, f"word{j}") for i in range(40) for j in range(i % 4 + 1)], "id long, token string")
    weights = spark.createDataFrame([(f"word{j}", float(j)) for j in range(4)], "token string, weight double")
    got = {r["id"]: (r["b"], r["shared"]) for r in similar.top_sharing(rows, weights, 1).collect()}
    assert got == {i: (next(b for b in range(i) if b % 4 >= i % 4 or b == i - 1 and i < 4), min(i % 4 + 1, i if i < 4 else 4)) for i in range(1, 40)}
    assert made == [({"id": "bigint", "tokens": "array<bigint>", "w": "array<double>"}, {"later_only": ("w",)})]


def test_blocks_leave_their_task_as_they_come(spark):
    """a result of two blocks is passed on in parts, and every pair of blocks meets once, in whatever task."""
    rows = spark.createDataFrame([(i, i * i) for i in range(200)] + [(None, 7)], "id long, x long")

    def each(later, earlier):
        assert not later["x"].null_count and earlier["x"].null_count == len(earlier)
        for i in later["id"].to_pylist():
            j = [k for k in earlier["id"].to_pylist() if k < i]
            yield pa.table({"a": pa.array(j, pa.int64()), "b": pa.array([i] * len(j), pa.int64())})

    got = [tuple(r) for r in blocks.before(rows, 7, each, "a long, b long", later_only=("x",)).collect()]
    assert len(got) == len(set(got)) == 200 * 199 // 2


def test_edges_make_no_pair_that_no_rule_joins(spark, monkeypatch, tmp_path):
    """pairs that share only terms, entities or one rare word are never made; the edges are those of the SQL."""

    def refused(*args):
        raise AssertionError("all pairs of all keys")

    monkeypatch.setattr(similar, "blocked_pairs", refused)
    monkeypatch.setattr(similar, "BUCKET_VECTORS", 5)
    written = _written(monkeypatch)
    monkeypatch.setattr(clusters, "kept", similar.kept)
    titles = COPIES | {i: f"common{i % 20} of number{i}" for i in range(20, 150)} | {5001: "elsewhere", 5004: "bridge closes tonight"}
    d, sql = _documents(spark, tmp_path, titles)
    columns = ("a", "b", "title_cosine", "content_cosine", "strict", "balanced", "episode")
    got = sorted(tuple(r) for r in clusters.c13_edge_predicate(spark, d).select(*columns).collect())
    want = sorted(sql(clusters.SQL["c13_edge_predicate"], *columns))
    assert [(*r[:2], *r[4:]) for r in got] == [(*r[:2], *r[4:]) for r in want] and {(1, 5001), (4, 5)} <= {r[:2] for r in got}
    assert np.allclose([r[2:4] for r in got], [r[2:4] for r in want], atol=2e-6)
    assert max(df.count() for df in written if {"a", "b"} <= set(df.columns)) <= 40  # some 400 pairs share one word of a title


def test_first_meetings_and_dots_are_brute_force(monkeypatch):
    """pairs under the first key that they share, with counts by kind, and cosines of pairs that meet under a key."""
    rng = random.Random(2)
    monkeypatch.setattr(blocks, "HOLDERS", 50)
    own = {i: sorted(rng.sample(range(30), rng.randint(1, 8))) for i in range(80)}
    rows = sorted((k, i) for i, keys in own.items() for k in keys)
    table = pa.table({"key": [k for k, _ in rows], "id": [i for _, i in rows], "own": [own[i] for _, i in rows]})
    parts = [out for whole in blocks.whole_keys(iter(table.to_batches(max_chunksize=37))) for out in blocks.first_met(whole, {0: 1, 2: 2}, 3)]
    want = []
    for a, b in combinations(own, 2):
        both = sorted(set(own[a]) & set(own[b]))
        n = Counter(k % 3 for k in both)
        want += [(both[0], a, b, n[0], n[2])] if n[0] >= 1 or n[2] >= 2 else []
    assert sorted(tuple(r.values()) for part in parts for r in part.to_pylist()) == sorted(want)
    codes = {i: sorted(rng.sample(range(50), rng.randint(1, 9))) for i in range(40)}
    vectors = {i: {c: rng.random() for c in x} for i, x in codes.items()}
    held = [(k, i) for k in range(5) for i in codes if rng.random() < 0.8]
    pairs = [(rng.randrange(6), rng.randrange(42), rng.randrange(42)) for _ in range(300)]
    got = blocks.dots(pa.table(dict(zip(("key", "a", "b"), map(list, zip(*pairs, strict=True)), strict=True))), pa.table({
        "key": [k for k, _ in held], "id": [i for _, i in held], "codes": [codes[i] for _, i in held], "w": [list(vectors[i].values()) for _, i in held]}))
    assert blocks.repeats(pa.table({"a": [1, 2, 1, 1], "b": [5, 5, 5, 6]})).tolist() == [2, 1, 2, 1]
    assert np.allclose(got, [sum(w * vectors[b].get(c, 0) for c, w in vectors[a].items()) if (k, a) in held and (k, b) in held else 0 for k, a, b in pairs])


def test_theme_links_connect_what_edges_do(spark, monkeypatch):
    """Few edges, of pairs near enough, with the same components."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 6))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(900, 0, None), (901, 1, [0.0] * 6)], "id long, label int, embedding array<double>")
    monkeypatch.setattr(similar, "BLOCK_ROWS", 50)
    links, edges = themes.theme_links(df, "label", 0.2), themes.theme_edges(df.where("id < 900"), "label", 0.2)
    found, every = {tuple(r) for r in links.collect()}, {tuple(r) for r in edges.collect()}
    assert found <= every and len(found) < len(every) / 2
    assert {tuple(r) for r in connected_components(links).collect()} == {tuple(r) for r in connected_components(edges).collect()}


def test_copies_of_a_vector_leave_a_block_by_the_smallest_ids(spark):
    """500 equal vectors: the best of each query are the smallest ids, with and without its own."""
    df = spark.createDataFrame([(i, "g", [1.0, 2.0]) for i in range(500)], "id long, label string, embedding array<double>")
    got = similar.nearest_neighbours(df.where("id in (0, 7)"), df, 3).collect()
    assert {(r["q"], r["rank"]): r["id"] for r in got} == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (7, 1): 0, (7, 2): 1, (7, 3): 2}
    assert [tuple(r) for r in similar.best_in_groups(df.where("id = 3"), df, "label").collect()] == [(3, "g", 1.0)]


def test_nearest_in_windows_and_orders_is_brute_force(spark, monkeypatch):
    """Copies, ties and blocks; single precision alone would mix up what differs in the eighth digit. Pairs stay in numpy."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", 60)
    monkeypatch.setattr(blocks, "STEP", 500)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    x[50:90] = x[50] * (1 + 1e-9 * rng.normal(size=(40, 8)))
    x[7] = 0
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    sims = np.round(np.clip(unit @ unit.T, -1, 1), 9)
    us = np.sort(rng.integers(0, 40, 300)) * 3_600_000_000
    rows = [(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, us, strict=True))]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, us long").withColumn("published_at", F.timestamp_micros("us"))
    best = lambda i, js, k, least: sorted((-sims[i, j], j) for j in js if sims[i, j] >= least)[:k]
    near = similar.near_in_window(df, hours=6, least=0.3)
    assert not re.search("Join", near._jdf.queryExecution().toString())
    want = {}
    for i in range(300):
        found = best(i, [j for j in range(300) if (us[j], j) < (us[i], i) and us[j] > us[i] - 6 * 3_600_000_000], 1, 0.3)
        want |= {i: (found[0][1], -found[0][0])} if found else {}
    assert {r["id"]: (r["match"], r["sim"]) for r in near.collect()} == want
    groups = df.where("id % 3 = 0").select("id", "embedding", "us")
    got = sorted((r["id"], r["group"], r["sim"]) for r in similar.earlier_groups(df, groups, 0.2, 3).collect())
    assert got == sorted((i, j, -s) for i in range(300) for s, j in best(i, [j for j in range(0, 300, 3) if (us[j], j) < (us[i], i)], 3, 0.2))
    got = sorted((r["q"], r["id"], r["sim"]) for r in similar.nearest_neighbours(df, df, 4).collect())
    assert got == sorted((i, j, -s) for i in range(300) for s, j in best(i, [j for j in range(300) if j != i], 4, -1.0))


def test_theme_pairs_stay_in_numpy_and_grown_clusters_alone_are_met_again(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 5))
    df = spark.createDataFrame([(i, "t" if i % 2 else None, v.tolist()) for i, v in enumerate(x)], "id long, label string, embedding array<double>")
    edges = themes.theme_edges(df, "label", 0.5)
    assert not re.search(r"(Hash|SortMerge|Inner).*Join|Join Inner", edges._jdf.queryExecution().toString())
    odd = range(1, 120, 2)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert {tuple(r) for r in edges.collect()} == {(i, j) for i in odd for j in odd if i < j and u[i] @ u[j] >= 0.5}
    got: dict[int, set] = {}
    rows = df.where("label is not null").select("id", "embedding")
    for r in themes.average_linkage(rows, edges, 0.5).collect():
        got.setdefault(r["cluster"], set()).add((r["id"] - 1) // 2)
    assert {frozenset(g) for g in got.values()} == _linked(u[1::2], 0.5)
