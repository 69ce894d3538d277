"""Edges between sets that share tokens, in a time that grows with the sets and not with their pairs (H1, H3)."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.blocks import MOST_TASKS, STEP, Forest
from storyloom.operators.scratch import kept

#: Holders of a token up to which they are compared with each other; those of more meet through combinations of tokens.
FEW_HOLDERS = 4096
#: Pairs or combinations that a task is given, about.
TASK_CELLS = 1 << 24
#: Rows whose edges a task reduces, about.
TASK_ROWS = 100_000


def edges(tokens: DataFrame, least: int) -> DataFrame:
    """Edges (a < b) that connect just those rows (id, token; distinct) that pairs sharing `least` tokens or more connect; a
    row that shares so many with an earlier one is the b of an edge. Each edge is such a pair.

    Tokens are ordered by their number of holders, and a pair meets under the rarest token it shares. If that has at most
    FEW_HOLDERS, its holders are compared there over the tokens that come after it. Else all that the pair shares are
    tokens with more holders: these rows list each combination of `least` of theirs, and link to its first holder. So the
    time grows with rows times FEW_HOLDERS and with a row's combinations of frequent tokens, not with the square of the
    rows or of a token's holders; exact."""
    few = FEW_HOLDERS if least > 1 else 0
    held = kept(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").withColumn("code", F.monotonically_increasing_id()))
    sets = tokens.join(held, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("held"))
    sets = kept(sets.where(F.size("held") >= least))
    codes = lambda x: F.transform(x, lambda h: h["code"])

    after = F.slice("held", F.col("i") + 2, F.size("held"))
    met = sets.select("id", "held", F.posexplode("held").alias("i", "x")).where((F.col("x.n") <= few) & (F.col("i") <= F.size("held") - least))
    met = met.select(F.col("x.code").alias("token"), "id", codes(after).alias("rest"))
    cells = held.where(F.col("n") <= few).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    met = met.repartition(_tasks(cells), "token").sortWithinPartitions("token", "id")
    compared = met.mapInArrow(lambda batches: _compared(batches, least - 1), "a long, b long")
    # all edges to a row meet in one task, and few tasks leave few edges
    fewer = lambda found: found.repartition(-(-max(1, sets.count()) // TASK_ROWS), "b").mapInArrow(_fewer, "a long, b long")

    hot = sets.select("id", codes(F.filter("held", lambda h: h["n"] > few)).alias("hot")).where(F.size("hot") >= least)
    listed = hot.agg(F.sum(F.pow(F.size("hot").cast("double"), F.lit(least)))).first()[0]
    if not listed:
        return fewer(compared)
    keys = [f"k{i}" for i in range(least)]
    hot = hot.repartition(_tasks(listed / factorial(least)), "id")
    firsts = kept(hot.mapInArrow(lambda batches: _combined(batches, least), ", ".join(f"{c} long" for c in ("a", "b", *keys))))
    shared = firsts.where("a is null").groupBy(*keys).agg(F.min("b").alias("a"), F.collect_set("b").alias("b")).where(F.size("b") > 1)
    shared = shared.select("a", F.explode("b").alias("b")).where("a < b")
    return fewer(compared.union(firsts.where("a is not null").select("a", "b")).union(shared))


def _tasks(cells: float) -> int:
    return int(min(max(16, cells // TASK_CELLS), MOST_TASKS))


_NO_EDGES = pa.record_batch({c: pa.array([], pa.int64()) for c in "ab"})


class _Links:
    """A forest over places of ids in order, and the smallest earlier place that each meets."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.forest, self.low = Forest(np.arange(len(ids))), np.full(len(ids), len(ids))

    def link(self, later: np.ndarray, earlier: np.ndarray) -> None:
        np.minimum.at(self.low, later, earlier)
        self.forest.link(later, earlier)

    def edges(self) -> pa.RecordBatch:
        found, b = self.forest.edges(), np.flatnonzero(self.low < len(self.ids))
        a, b = np.r_[found["a"].to_numpy(), self.low[b]], np.r_[found["b"].to_numpy(), b]
        return _fewest(self.ids[a], self.ids[b])


def _fewest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Of edges (a < b) that of each b to its smallest a, and those that connect what these leave apart."""
    order = np.lexsort((a, b))
    forest = Forest(np.r_[a, b])
    forest.link(b[order], a[order], first_too=True)
    return forest.edges().combine_chunks().to_batches()[0] if len(a) else _NO_EDGES


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fewest edges of a task; no more than these and STEP others are held."""
    held, last = [], 0
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= STEP + last:
            held = [_fewest(*_ends(held))]
            last = len(held[0])
    yield _fewest(*_ends(held)) if held else _NO_EDGES


def _ends(batches: list[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (np.concatenate([batch[c].to_numpy() for batch in batches]) for c in "ab")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the lists of a column, and all their elements."""
    whole = pa.concat_arrays(column.chunks)
    return whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten().to_numpy(zero_copy_only=False)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, n of each."""
    return np.repeat(start - (n.cumsum() - n), n) + np.arange(n.sum())


def _steps(cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of places whose costs sum to STEP at most, of one place at least."""
    total, at = np.r_[0, cost.cumsum()], 0
    while at < len(cost):
        end = max(at + 1, int(np.searchsorted(total, total[at] + STEP, "right")) - 1)
        yield at, end
        at = end


def _compared(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Edges between rows (token, id, rest), in that order, of one token whose rests share `least` elements or more."""
    kept_back = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if kept_back is None else pa.concat_tables([kept_back, table])
        token = table["token"].to_numpy()
        cut = int(np.searchsorted(token == token[-1], True)) if len(token) else 0  # the last token's rows may go on
        kept_back = table.slice(cut)
        if cut:
            yield _compare(table.slice(0, cut), least)
    if kept_back is not None and len(kept_back):
        yield _compare(kept_back, least)


def _compare(table: pa.Table, least: int) -> pa.RecordBatch:
    ids, node = np.unique(table["id"].to_numpy(), return_inverse=True)
    token, (size, rest) = table["token"].to_numpy(), _lists(table["rest"])
    opens = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    start = np.repeat(opens, np.diff(np.r_[opens, len(token)]))
    # a row has a cell for each row of its token before it
    local = np.arange(len(token)) - start
    cells = np.r_[0, local.cumsum()]
    row = np.repeat(np.arange(len(token)), size)
    order = np.lexsort((rest, start[row]))  # stable: holders of an element stay in order
    s, e = start[row][order], rest[order]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])]) if len(e) else np.zeros(0, np.int64)
    begins = np.empty(len(row), np.int64)
    begins[order] = np.repeat(first, np.diff(np.r_[first, len(row)]))
    before = np.empty(len(row), np.int64)
    before[order] = np.arange(len(row))
    before -= begins
    holders, entry = row[order], np.r_[0, size.cumsum()]
    links = _Links(ids)
    for lo, hi in _steps(local + np.diff(np.r_[0, before.cumsum()][entry])):
        part = slice(entry[lo], entry[hi])
        n = before[part]
        cell = np.repeat(cells[row[part]] - cells[lo], n) + local[holders[_ranges(begins[part], n)]]
        hit = np.flatnonzero(np.bincount(cell, minlength=cells[hi] - cells[lo]) >= least) + cells[lo]
        later = np.searchsorted(cells, hit, "right") - 1
        links.link(node[later], node[start[later] + hit - cells[later]])
    return links.edges()


def _combined(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of rows (id, hot) edges (a, b) to the first of the batch with the same combination of `least` elements, as few as
    connect them; and that first (b, with no a) and the combination (k0, k1, ...)."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).sort_by("id")
        if not len(table):
            continue
        size, hot = _lists(table["hot"])
        names, code = np.unique(hot, return_inverse=True)
        row, end = np.repeat(np.arange(len(size)), size), np.repeat(size.cumsum(), size)
        ids = table["id"].to_numpy()
        links = _Links(ids)
        made = np.ones(len(hot))
        for i in range(1, least):
            made *= (end - np.arange(len(hot)) - i).clip(0) / i
        none = lambda n: pa.nulls(n, pa.int64())
        for lo, hi in _steps(made.round().astype(np.int64)):
            parts = [np.arange(lo, hi)]
            for _ in range(1, least):
                last = parts[-1]
                n = end[last] - 1 - last
                parts = [*(np.repeat(p, n) for p in parts), _ranges(last + 1, n)]
            key = np.zeros(len(parts[0]), np.int64)
            for p in parts:
                if len(key) and int(key.max()) + 1 > (1 << 62) // len(names):
                    key = np.unique(key, return_inverse=True)[1]
                key = key * len(names) + code[p]
            order = np.argsort(key, kind="stable")
            opens = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, bool)
            holder, at = row[parts[0]][order], np.flatnonzero(opens)
            firsts = np.repeat(holder[at], np.diff(np.r_[at, len(key)]))
            links.link(holder[~opens], firsts[~opens])
            columns = {f"k{i}": pa.array(hot[p[order[at]]], pa.int64()) for i, p in enumerate(parts)}
            yield pa.record_batch({"a": none(len(at)), "b": pa.array(ids[holder[at]], pa.int64()), **columns})
        found = links.edges()
        yield pa.record_batch({"a": found["a"], "b": found["b"], **{f"k{i}": none(len(found)) for i in range(least)}})
