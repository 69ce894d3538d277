from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from storyloom.operators import blocks, overlap, similar
from storyloom.operators.components import connected_components


def _sets(n: int, seed: int) -> dict[int, set[str]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    sets = {i: set(rng.choices(words, [1 / (1 + j) for j in range(60)], k=rng.randint(1, 12))) for i in range(n)}
    return sets | {n: set(words), n + 1: {"w0", "w1", "own"}, n + 2: {"w0", "w1", "w2"}, n + 3: {"w0", "w1", "w2"}, n + 4: {"alone", "single", "none"}}


def _wanted(sets: dict[int, set[str]], least: int) -> tuple[set, dict]:
    pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return pairs, {i: find(i) for p in pairs for i in p}


@pytest.mark.parametrize(("least", "few"), [(3, 0), (3, 9), (3, 4096), (2, 9), (1, 9)])
def test_edges_connect_what_pairs_connect(spark, monkeypatch, least, few):
    """all of it under rare tokens, all under combinations of frequent ones, and both; rows never meet in blocks."""

    def refused(*args):
        raise AssertionError("all pairs of rows")

    monkeypatch.setattr(blocks, "before", refused)
    monkeypatch.setattr(overlap, "FEW_HOLDERS", few)
    sets = _sets(150, least)
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "id long, token string")
    edges = similar.overlap_edges(rows, least)
    found = {tuple(r) for r in edges.collect()}
    pairs, component = _wanted(sets, least)
    assert found <= pairs and {b for _, b in found} == {b for _, b in pairs}
    assert {tuple(r) for r in connected_components(edges).collect()} == set(component.items())


def test_work_grows_with_rows(spark, monkeypatch):
    """four times the rows of the same words: no more than four times the cells and combinations for each row
    once words are frequent (pairs of rows: sixteen times)."""
    cells = []
    monkeypatch.setattr(overlap, "_tasks", lambda n: cells.append(n) or 2)
    monkeypatch.setattr(overlap, "FEW_HOLDERS", 20)
    for n in (400, 1600):
        rows = [(i, f"w{j}") for i in range(n) for j in random.Random(i).sample(range(80), 4)] + [(i, f"own{i // 2}") for i in range(n)]
        overlap.edges(spark.createDataFrame(rows, "id long, token string"), 3)
    small, large = sum(cells[:2]), sum(cells[2:])
    assert len(cells) == 4 and large <= 4.1 * small


@pytest.mark.parametrize("step", [1, 50, 1 << 22])
def test_steps_and_batches_change_nothing(monkeypatch, step):
    """Rows of a token go on in the next batch, and a step may hold a single row or element."""
    monkeypatch.setattr(overlap, "STEP", step)
    rng = np.random.default_rng(1)
    rows = [(t, i, sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist())) for t in range(9) for i in range(t * 2)]
    table = pa.table({"token": pa.array([r[0] for r in rows], pa.int64()), "id": pa.array([r[1] for r in rows], pa.int64()), "rest": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})
    got = {(a, b) for out in overlap._compared(iter(table.to_batches(max_chunksize=7)), 2) for a, b in zip(*out.to_pydict().values(), strict=True)}
    pairs = {(i, j) for t, i, x in rows for u, j, y in rows if t == u and i < j and len(set(x) & set(y)) >= 2}
    assert got <= pairs and {b for _, b in got} == {b for _, b in pairs}

    hot = {i: sorted(rng.choice(10, rng.integers(3, 7), replace=False).tolist()) for i in range(30)}
    table = pa.table({"id": pa.array(list(hot), pa.int64()), "hot": pa.array(list(hot.values()), pa.list_(pa.int64()))})
    out = [r for batch in overlap._combined(iter(table.to_batches()), 3) for r in batch.to_pylist()]
    linked, firsts = {(r["a"], r["b"]) for r in out if r["a"] is not None}, {}
    for r in out:
        if r["a"] is None:
            key = (r["k0"], r["k1"], r["k2"])
            firsts.setdefault(key, set()).add(r["b"])
    linked |= {(min(ids), b) for ids in firsts.values() for b in ids if b > min(ids)}
    pairs = {(i, j) for i in hot for j in hot if i < j and len(set(hot[i]) & set(hot[j])) >= 3}
    assert linked <= pairs and {b for _, b in linked} == {b for _, b in pairs}
