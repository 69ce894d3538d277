"""Ranked search, fill-in-middle and SimHash near-dedup against brute force, round trips and edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import pytest
import xxhash

from storyloom.llm import fill_in_middle, lexical_search, simhash_dedup
from tests.llm.brute import components_of, lower, words_of

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " \n\t ", "word", "a b", "Tie tie TIE", "x" * 50_000, ("long text " * 4000).strip(), "é ß 日本 𝕏", "a\n\nb\n", "<P> in it"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in any column, very long and empty texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "id", "s", 1) for i, t in enumerate(EDGE)] + [(1, "", "id", "s", 2), (None, "null id", None, None, None), (3, "word", "x", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, item string, score long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, id string")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 11


def ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    split = [(i, collections.Counter(terms(t))) for i, t in docs if i is not None]
    split = [(i, c, sum(c.values())) for i, c in split if c]
    total, length = len(split), sum(n for *_, n in split)
    df = collections.Counter(t for _, c, _ in split for t in c)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        own = {t for i, text in items if i == item for t in terms(text)}
        scored = []
        for i, c, n in split:
            m = 50 + (50 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def found(docs, items, **how):
    return sorted(tuple(r) for r in lexical_search.search(docs, items, **how).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("k", [1, 50])
def test_search_is_brute_force(spark, documents, k):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = ranked(rows_of(documents), [tuple(r) for r in items.select("item_id", "text").collect()], k)
    assert found(documents.repartition(5), items, k=k) == want


@pytest.mark.parametrize("seed", range(2))
def test_search_limits_accumulators_and_loses_nothing(spark, monkeypatch, seed):
    """Common words, copies that tie, small batches: the limit closes items early, results stay those of brute force."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 40))) for _ in range(500)]
    rows = [(i, rng.choice(texts[:20]) if i % 3 == 0 else texts[i]) for i in range(500)]
    items = [(f"q{i}", " ".join(rng.choices(vocabulary, weights, k=12))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(lexical_search, "BATCH_ROWS", 64)
    monkeypatch.setattr(lexical_search, "FIRST_LISTS", 2)
    assert found(docs, spark.createDataFrame(items, "item_id string, text string"), k=5) == ranked(rows, items, 5)


def test_search_stops_making_accumulators():
    import numpy as np

    weights = lexical_search.Weights(100, 1000, np.array([2, 60]), np.array([3000, 500]), np.array([400_000, 400_000]))
    scorer = lexical_search.Scorer([np.array([0, 1])], weights, np.array([900_000_000]), 2)
    doc, term = np.array([0, 1, 0, 1, 2, 3]), np.array([0, 0, 1, 1, 1, 1])
    _, docs, scores = scorer.score(np.full(4, 10), doc, term, np.ones(6, np.int64))
    assert sorted(docs) == [0, 1]  # documents 2 and 3 hold the common term only and get no accumulator
    gain = int(lexical_search.impacts(np.array([1]), np.array([10]), 100, 1000)[0])
    assert list(scores) == [3500 * gain] * 2 and scorer.least[0] == 3500 * gain


def test_search_blocks_of_items(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = found(documents, items, k=3)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 2500)
    assert found(documents, items, k=3) == whole


def test_search_edges(spark, edges, empty):
    texts = [("a", "WORD tie x"), ("b", None), ("c", " ,. "), (None, "word"), ("d", "long é"), ("a", "b"), ("d", "long é"), ("e", "absent")]
    items = spark.createDataFrame([(*t, 1, 2) for t in texts], "item_id string, text string, doc_id int, rank int")
    rows = rows_of(edges)
    want = ranked(rows, texts, 50)
    assert found(edges, items) == want and [r for r in want if r[0] == "a" and r[2] == 3] != []
    assert found(empty, items) == [] and found(edges, items.where("false")) == []
    assert found(edges.where("text is null or text = ''"), items) == []


# 12


def filled(key, text: str | None) -> tuple:
    text = text or ""
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check_filled(df):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = fill_in_middle.fill_in_middle(df).collect()
    want = [(i, *(w := filled(i, t))[:4], sha(w[4]), sha(t or ""), w[4]) for i, t in rows_of(df)]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    return rows


def test_fill_in_middle_is_brute_force(spark, documents, edges, empty):
    rows = check_filled(documents)
    assert {r["form"] for r in rows} == {"plain", "spm", "psm"}
    check_filled(edges)
    assert fill_in_middle.fill_in_middle(empty).collect() == []


def test_fill_in_middle_round_trip(spark, documents, edges):
    for df in (documents, edges):
        back = fill_in_middle.unfilled(fill_in_middle.fill_in_middle(df, rate=100))
        assert sorted(map(repr, rows_of(back))) == sorted(repr((i, t or "")) for i, t in rows_of(df))


def test_fill_in_middle_all_places_and_forms():
    text = " a\tbé <x> <S < P>  \n".encode()
    ends = [0, *map(int, fill_in_middle.unit_ends(text))]
    for form, (a, b) in itertools.product(("psm", "spm"), itertools.combinations_with_replacement(ends, 2)):
        parts = fill_in_middle.PieceTable(text).cut(a, b)
        output = parts.arrange(form)
        assert bytes(parts) == text and len(output.pieces) == 6
        back = fill_in_middle.opened(bytes(output), form).restore(form)
        assert bytes(back) == text and output.sha256() == hashlib.sha256(bytes(output)).hexdigest()
    with pytest.raises(ValueError, match="not an output"):
        fill_in_middle.opened(b"<S>a<M>b<P>c", "psm")


# 13


def simhash(text: str | None) -> int:
    w = words_of(lower(text))
    of = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in of]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints: dict) -> dict:
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    return components_of(prints, pairs)


def test_simhash_is_brute_force(spark, documents):
    prints = {i: simhash(t) for i, t in rows_of(documents)}
    least = linked(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.simhash_duplicates(documents).collect()}
    assert got == {i: (f"{p:016x}", least[i]) for i, p in prints.items()}
    assert any(i != c for i, (_, c) in got.items())


def test_long_texts_are_hashed_in_steps(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(1000))
    monkeypatch.setattr(simhash_dedup, "STEP", 7)
    assert simhash_dedup.fingerprint(text) == simhash(text)


@pytest.mark.parametrize("seed", range(2))
def test_balls_find_every_link(spark, seed):
    """Chains and clouds of fingerprints 1 to 4 bits apart, around centres of either parity."""
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(450):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted({simhash_dedup.signed(x) for x in prints})
    nodes = spark.createDataFrame([(x,) for x in prints], "bits long")
    got = {r["bits"]: r["component"] for r in simhash_dedup.near_fingerprints(nodes).collect()}
    want = linked({x: x & (1 << 64) - 1 for x in prints})
    assert got == want and len(set(want.values())) < len(prints)


@pytest.mark.parametrize("n", [10**6, 10**8, 10**10])
def test_masks_cover_every_three_bits(n):
    masks = simhash_dedup.block_masks(n)
    assert all(any(m & bits == 0 for m in masks) for bits in (1 << i | 1 << j | 1 << k for i, j, k in itertools.combinations(range(64), 3)))


def test_simhash_edges(spark, edges, empty):
    got = collections.Counter(map(tuple, simhash_dedup.simhash_duplicates(edges).collect()))
    prints = [(i, simhash(t)) for i, t in rows_of(edges)]
    least = {p: min((i for i, q in prints if q == p and i is not None), default=None) for _, p in prints}
    known = sorted({p for i, p in prints if i is not None})
    assert all((a ^ b).bit_count() > 3 for a, b in itertools.combinations(known, 2))
    assert got == collections.Counter((i, f"{p:016x}", None if i is None else least[p]) for i, p in prints)
    assert least[0] == 0 and got[(1, "0" * 16, 0)] == 2
    assert simhash_dedup.simhash_duplicates(empty).collect() == []


def test_simhash_of_many_copies(spark):
    rows = [(i, "the same few words again and again") for i in range(3000)] + [(i, f"other words {i} here {i * 7}") for i in range(3000, 3200)]
    got = simhash_dedup.simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 3000")
    assert {r["component_id"] for r in got.collect()} == {0}
