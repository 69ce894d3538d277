"""H1's components on graphs that need many rounds, and on stars, against literal answers."""

from __future__ import annotations

import random

import pytest

from storyloom.operators import components


def labels_of(spark, pairs, monkeypatch):
    """(node: component, rounds)."""
    written = []
    kept = components.kept
    monkeypatch.setattr(components, "kept", lambda df: written.append(1) or kept(df))
    rows = components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    monkeypatch.undo()
    return {r["node"]: r["component"] for r in rows}, (len(written) - 2) // 2


@pytest.mark.parametrize(("n", "most"), [(2, 1), (400, 12), (100_000, 20)])
def test_shuffled_path(spark, monkeypatch, n, most):
    order = list(range(n))
    random.Random(n).shuffle(order)
    got, rounds = labels_of(spark, list(zip(order, order[1:], strict=False)), monkeypatch)
    assert got == dict.fromkeys(range(n), 0) and rounds <= most


def test_comb_star_and_loops(spark, monkeypatch):
    order = list(range(0, 600, 2))
    random.Random(1).shuffle(order)
    comb = list(zip(order, order[1:], strict=False)) + [(x, x + 1) for x in order]  # 0 to 599
    star = [(2000, x) for x in range(1000, 1500)]
    again = [(1000, 2000), (2000, 1000), (3000, 3000)]
    got, rounds = labels_of(spark, comb + star + again, monkeypatch)
    assert got == dict.fromkeys(range(600), 0) | dict.fromkeys([*range(1000, 1500), 2000], 1000) | {3000: 3000}
    assert rounds <= 12


def test_random_graphs(spark, monkeypatch):
    rng = random.Random(7)
    for n, m in ((50, 30), (300, 280), (40, 400)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        least = {x: x for p in pairs for x in p}
        for _ in range(n):
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        assert labels_of(spark, pairs, monkeypatch)[0] == least


def test_no_edges(spark, monkeypatch):
    assert labels_of(spark, [], monkeypatch)[0] == {}
