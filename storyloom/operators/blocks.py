"""Blocks of rows against blocks of rows: a task compares two blocks in numpy and lets out what is wanted of their pairs;
the pairs themselves are never shuffled. Exact, and quadratic in the rows that meet, with a block's bounds on memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Partitions that pairs of blocks are dealt to at most.
MOST_TASKS = 4000
#: Cells (pairs of rows, or of a row and a holder of its token) that a task looks at in one step.
STEP = 1 << 22
#: Holders of a row's tokens that a task looks at in one step.
HOLDERS = 1 << 20
#: Rows of a batch of results.
OUT_ROWS = 1 << 16


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _dealt(a: DataFrame, b: DataFrame, keys: list[str], tasks: int, each: Callable, schema: str) -> DataFrame:
    # a stated number of partitions: adaptive execution would merge small tables that take long to compare
    deal = lambda df: df.repartition(min(max(tasks, 1), MOST_TASKS), *keys).groupBy(*keys)
    columns = to_arrow_schema(StructType.fromDDL(schema))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return each(left, right).cast(columns) if len(left) and len(right) else columns.empty_table()

    # columns of its own for the right side: a cogroup of a table with itself loses those it shares with the left
    own = b.select(*[F.col(c).alias(c) for c in b.columns])
    return deal(a).cogroup(deal(own)).applyInArrow(both, schema)


def crossed(left: DataFrame, right: DataFrame, blocks: tuple[int, int], each: Callable, schema: str, by: tuple[str, ...] = (), groups: int = 1) -> DataFrame:
    """each(left block, right block), Arrow tables to an Arrow table, for all pairs of blocks of rows with an id that are
    equal in `by`; groups: about how many values that has."""
    m, n = blocks
    home = lambda count: F.pmod(F.xxhash64("id"), F.lit(count))
    a = left.withColumn("_i", home(m)).withColumn("_j", _numbers(n))
    b = right.withColumn("_j", home(n)).withColumn("_i", _numbers(m))
    return _dealt(a, b, [*by, "_i", "_j"], m * n * groups, each, schema)


def before(rows: DataFrame, n: int, each: Callable, schema: str, later_only: tuple[str, ...] = ()) -> DataFrame:
    """each(block, block of no later rows), two Arrow tables, gives Arrow tables, for all pairs of about n blocks in order
    of id. What it gives leaves the task as it comes, so a task holds two blocks and no more than one of these tables.
    Columns in later_only are null in the second block. Rows without an id meet none."""
    rows = rows.where("id is not null")
    bounds = sorted(set(rows.approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    block = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("id"))) if bounds else F.pmod(F.xxhash64("id"), F.lit(1)).cast("int")
    n = len(bounds) + 1
    # the cell of blocks i and j <= i is i (i + 1) / 2 + j: a row is in those of its block as the later and as the earlier one
    own = F.col("_own")
    as_later = F.transform(F.sequence(F.lit(0), own), lambda j: F.struct((own * (own + 1) / 2 + j).cast("int").alias("cell"), F.lit(True).alias("later")))
    as_earlier = F.transform(F.sequence(own, F.lit(n - 1)), lambda i: F.struct((i * (i + 1) / 2 + own).cast("int").alias("cell"), F.lit(False).alias("later")))
    held = [F.when(F.col("_x.later"), F.col(c)).alias(c) if c in later_only else F.col(c) for c in rows.columns]
    dealt = rows.withColumn("_own", block).withColumn("_x", F.explode(F.concat(as_later, as_earlier))).select(F.col("_x.cell").alias("_cell"), F.col("_x.later").alias("_later"), *held)
    # a task for each cell: a hash of so few keys would leave some tasks several and others none
    dealt = dealt.repartitionById(min(n * (n + 1) // 2, MOST_TASKS), "_cell").sortWithinPartitions("_cell")
    columns = to_arrow_schema(StructType.fromDDL(schema))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            later, cell = cell["_later"], cell.drop_columns(["_cell", "_later"])
            left, right = cell.filter(later), cell.filter(pc.invert(later))
            if len(left) and len(right):
                del cell
                for out in each(left, right):
                    yield from out.cast(columns).to_batches(max_chunksize=OUT_ROWS)

    return dealt.mapInArrow(met, schema)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A table for each cell, of rows in order of _cell."""
    held = []
    for batch in batches:
        cell = batch["_cell"].to_numpy()
        opens = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)] if len(cell) else []
        for lo, hi in zip(opens, opens[1:], strict=False):
            if held and held[-1]["_cell"][-1].as_py() != cell[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _plain(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)


def units(table: pa.Table, vector: str, ordered: bool = False) -> tuple[pa.Table, np.ndarray]:
    """The rows of a block with a vector in order of id, or as they are ordered, and their unit vectors; a zero vector
    stays. All of one length."""
    table = table.filter(pc.is_valid(table[vector]))
    table = table if ordered else table.sort_by("id")
    lists = _plain(table[vector])
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(table):
        return table, np.zeros((0, 0))
    x = flat.reshape(len(table), -1)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return table, np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] != 0)


def cosines(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, cosines of some rows of the left with all of the right)."""
    if len(left) and len(right):
        step = max(1, STEP // len(right))
        for first in range(0, len(left), step):
            yield first, np.clip(left[first : first + step] @ right.T, -1.0, 1.0)


def best(r: np.ndarray, order: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the first k of each r in an order, whose most significant part comes first."""
    if not len(r):
        return np.zeros(0, np.int64)
    at = np.lexsort((*reversed(order), r))
    rs = r[at]
    opens = np.flatnonzero(np.r_[True, rs[1:] != rs[:-1]])
    rank = np.arange(len(rs)) - np.repeat(opens, np.diff(np.r_[opens, len(rs)]))
    return at[rank < k]


def may_be_best(r: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of all that can be among the k highest of each r, which come in runs: those not below the first of its
    distinct scores down to which there are k."""
    if not len(r):
        return np.zeros(0, np.int64)
    opens = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    n = np.diff(np.r_[opens, len(r)])
    least, reached = np.full(len(opens), np.inf), np.zeros(len(opens), np.int64)
    for _ in range(k):
        below = np.where(score < np.repeat(least, n), score, -np.inf)
        least = np.where(reached < k, np.maximum.reduceat(below, opens), least)
        reached = np.add.reduceat((score >= np.repeat(least, n)).astype(np.int64), opens)
    return np.flatnonzero(score >= np.repeat(least, n))


def places_before(rows: pa.Table, marks: pa.Table, by: list[str], marks_by: list[str] | None = None) -> np.ndarray:
    """How many rows are before each mark in an order by two columns, in which both tables are."""
    side = lambda t, columns: [t[c].to_numpy(zero_copy_only=False) for c in columns]
    (t, i), (at, own) = side(rows, by), side(marks, marks_by or by)
    x, y = np.r_[t, at], np.r_[i, own]
    of_marks = np.r_[np.zeros(len(t), bool), np.ones(len(at), bool)]
    # a mark comes before a row that equals it
    ranked = np.lexsort((~of_marks, y, x))
    seen = np.cumsum(~of_marks[ranked])
    out = np.empty(len(x), np.int64)
    out[ranked] = seen
    return out[len(t) :]


#: Columns whose highest cosine stands for them; pairs whose cosine is computed again in double precision in one step.
GROUP, AGAIN = 16, 1 << 16


def nearest(q: np.ndarray, x: np.ndarray, k: int, least: float, *, ids: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None,
            without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine to nine digits) of the k highest cosines from `least` on of each unit vector of q with those of
    x from place `start` up to, without, `end`, and not of the id `without`; of equals the smallest ids.

    Cosines are compared in single precision first. What can't be among the k best, by more than its error, goes: the k-th
    highest of the groups of columns, each by its highest, is no higher than the k-th of all. The rest is computed again."""
    rs, cs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(q) and len(x):
        margin = np.float32((x.shape[1] + 16) * 1.2e-7)
        small, others = q.astype(np.float32), np.ascontiguousarray(x.T.astype(np.float32))
        step = max(1, STEP // len(x))
        at_id = np.argsort(ids, kind="stable")
        by_id = np.empty(len(ids), np.int64)
        by_id[at_id] = np.arange(len(ids))
        for first in range(0, len(q), step):
            part = slice(first, min(first + step, len(q)))
            lo, hi = 0 if start is None else int(start[part].min()), len(x) if end is None else int(end[part].max())
            if lo >= hi:
                continue
            sims = small[part] @ others[:, lo:hi]
            place = np.arange(lo, hi)
            if start is not None:
                sims[place < start[part, None]] = -np.inf
            if end is not None and (end[part] < hi).any():
                sims[place >= end[part, None]] = -np.inf
            if without is not None:
                to = np.minimum(np.searchsorted(ids, without[part], sorter=at_id), len(ids) - 1)
                r = np.flatnonzero(ids[at_id[to]] == without[part])
                c = at_id[to[r]] - lo
                inside = (c >= 0) & (c < hi - lo)
                sims[r[inside], c[inside]] = -np.inf
            floor = np.full(len(sims), least - margin, np.float32)
            whole = (hi - lo) // GROUP
            if whole > k:
                tops = sims[:, : whole * GROUP].reshape(len(sims), GROUP, whole).max(axis=1)
                floor = np.maximum(floor, np.partition(tops, whole - k, axis=1)[:, whole - k] - 2 * margin)
            r, c = np.nonzero(sims >= floor[:, None])
            s = np.concatenate([np.einsum("ij,ij->i", q[first + r[i : i + AGAIN]], x[lo + c[i : i + AGAIN]]) for i in range(0, len(r), AGAIN)] or [np.zeros(0)])
            s = np.round(np.clip(s, -1.0, 1.0), 9)
            r, c, s = r[s >= least], c[s >= least] + lo, s[s >= least]
            at = best(r, [-s, by_id[c]], k)
            rs.append(r[at] + first), cs.append(c[at]), ss.append(s[at])
    return np.concatenate(rs), np.concatenate(cs), np.concatenate(ss)


class Forest:
    """Edges that connect what the pairs it is given connect, of those pairs themselves."""

    def __init__(self, ids: np.ndarray) -> None:
        self.nodes = np.unique(ids)
        self.label, self.found = np.arange(len(self.nodes)), []

    def link(self, later: np.ndarray, earlier: np.ndarray, first_too: bool = False) -> None:
        """Pairs of ids, in order of the later ones. In rounds each tree hooks itself below a smaller one by one pair.
        first_too: beside those each row's first pair is an edge."""
        x, y = np.searchsorted(self.nodes, later), np.searchsorted(self.nodes, earlier)
        if first_too and len(x):
            first = np.r_[True, x[1:] != x[:-1]]
            self.found.append((self.nodes[y[first]], self.nodes[x[first]]))
            self._hook(x[first], y[first], told=True)
        self._hook(x, y, told=False)

    def _hook(self, x: np.ndarray, y: np.ndarray, told: bool) -> None:
        while True:
            p, q = self.label[x], self.label[y]
            apart = p != q
            if not apart.any():
                return
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            high, at = np.unique(np.maximum(p, q), return_index=True)
            up = np.arange(len(self.nodes))
            up[high] = np.minimum(p, q)[at]
            if not told:
                self.found.append((self.nodes[y[at]], self.nodes[x[at]]))
            while (up[up] != up).any():
                up = up[up]
            self.label = up[self.label]

    def edges(self) -> pa.Table:
        a, b = (np.concatenate([f[i] for f in self.found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


class Lists:
    """Lists of the right block's holders of each token, to meet rows of the left block in. Tokens are numbered in their
    order; no row holds one twice."""

    def __init__(self, left: pa.Table, right: pa.Table, tokens: str = "tokens", weights: str | None = None) -> None:
        a, b = _plain(left[tokens]), _plain(right[tokens])
        coded = pa.chunked_array([pa.concat_arrays([a.flatten(), b.flatten()])]).combine_chunks().dictionary_encode()
        coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
        by_name = pc.sort_indices(coded.dictionary)
        self.names = coded.dictionary.take(by_name)
        number = np.empty(len(by_name), np.int64)
        number[by_name.to_numpy()] = np.arange(len(by_name))
        codes = number[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        sizes = lambda x: pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
        self.size, self.n = sizes(a), len(right)
        n_left = int(self.size.sum())
        self.codes, held = codes[:n_left], codes[n_left:]
        self.weights = _plain(left[weights]).flatten().to_numpy(zero_copy_only=False) if weights else None
        #: the weight that all tokens have, if so: sums need no order then
        self.even = float(self.weights[0]) if weights and len(self.weights) and (self.weights == self.weights[0]).all() else None
        at = np.argsort(held, kind="stable")
        self.holders = np.repeat(np.arange(self.n), sizes(b))[at]
        ends = np.bincount(held, minlength=len(by_name)).cumsum() if len(by_name) else np.zeros(0, np.int64)
        self.starts = np.r_[0, ends].astype(np.int64)

    def shared(self, least: int, words: bool = False) -> Iterator[tuple]:
        """(rows of the left, of the right, tokens shared, their weights' sum, what is shared) of pairs that share `least`
        tokens or more, some rows of the left at a time; the last, with `words`, gives the shared tokens of some of these
        pairs. Only pairs that share a token take time: each holder met is a number, and equal numbers are one pair."""
        first = np.r_[0, self.size.cumsum()]
        length = (self.starts[1:] - self.starts[:-1])[self.codes]
        cost = np.r_[0, length.cumsum()][first]
        row = 0
        while row < len(self.size):
            end = max(row + 1, int(np.searchsorted(cost, cost[row] + HOLDERS, "right")) - 1)
            lo, hi = first[row], first[end]
            n, c = length[lo:hi], self.codes[lo:hi]
            back = np.repeat(self.starts[c] - np.r_[0, n.cumsum()[:-1]] if len(n) else n, n)
            pair = np.repeat(np.repeat(np.arange(end - row), self.size[row:end]), n) * self.n + self.holders[back + np.arange(len(back))]
            weighed = self.weights is not None and self.even is None
            order = np.argsort(pair) if words or weighed else None
            pair = np.sort(pair) if order is None else pair[order]
            opens = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[opens, len(pair)])
            weights = np.add.reduceat(np.repeat(self.weights[lo:hi], n)[order], opens) if weighed and len(pair) else counts * (self.even or 0.0)
            hit = counts >= least
            opens, counts, weights = opens[hit], counts[hit], weights[hit]

            def names(wanted: np.ndarray, order=order, c=c, n=n, opens=opens, counts=counts) -> pa.Array:
                """The shared tokens of some pairs in order, with one space between."""
                size = counts[wanted]
                offsets = np.r_[0, size.cumsum()]
                at = np.repeat(opens[wanted] - offsets[:-1], size) + np.arange(offsets[-1])
                code = np.repeat(c, n)[order[at]]
                code = code[np.lexsort((code, np.repeat(np.arange(len(size)), size)))]
                return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.names.take(pa.array(code))), " ")

            pair = pair[opens]
            yield row + pair // self.n, pair % self.n, counts, weights, names
            row = end


def dots(pairs: pa.Table, vectors: pa.Table) -> np.ndarray:
    """Inner products of pairs (key, a, b) of sparse vectors (key, id, codes in order, w), 0 where one is missing."""
    out = np.zeros(len(pairs))
    if not len(vectors) or not len(pairs):
        return out
    side = lambda t, c: t[c].to_numpy()
    vectors = vectors.take(pa.array(np.lexsort((side(vectors, "id"), side(vectors, "key")))))
    keys, ids = np.unique(side(vectors, "key")), np.unique(side(vectors, "id"))
    place = lambda key, i: np.searchsorted(keys, key) * (len(ids) + 1) + np.searchsorted(ids, i)
    held = place(side(vectors, "key"), side(vectors, "id"))

    def at(c: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs' vectors, and which are there."""
        i = np.minimum(np.searchsorted(held, place(side(pairs, "key"), side(pairs, c))), len(held) - 1)
        return i, (side(vectors, "key")[i] == side(pairs, "key")) & (side(vectors, "id")[i] == side(pairs, c))

    (a, has_a), (b, has_b) = at("a"), at("b")
    wanted = np.flatnonzero(has_a & has_b)
    a, b = a[wanted], b[wanted]
    lists = _plain(vectors["codes"])
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    names, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    w = _plain(vectors["w"]).flatten().to_numpy(zero_copy_only=False)
    for lo, hi, i, j, same, of in _matches(a, b, size, code, len(names)):
        out[wanted[lo:hi]] = np.bincount(of, np.where(same, w[i] * w[j], 0.0), hi - lo)
    return out


def repeats(pairs: pa.Table) -> np.ndarray:
    """How many of the pairs (a, b) equal each of them."""
    a, b = (np.unique(pairs[c].to_numpy(), return_inverse=True)[1] for c in "ab")
    _, at, n = np.unique(a * (len(pairs) + 1) + b, return_inverse=True, return_counts=True)
    return n[at]


def _matches(a: np.ndarray, b: np.ndarray, size: np.ndarray, code: np.ndarray, n_codes: int) -> Iterator[tuple]:
    """Some pairs (a, b) of rows with lists of codes in order, one after the other, at a time: (first pair, end, places i of
    the codes of the shorter list of each, places j, whether j holds the other list's equal, pair of each)."""
    start = size.cumsum() - size
    entry = np.repeat(np.arange(len(size)), size) * n_codes + code
    shorter = size[a] <= size[b]
    a, b = np.where(shorter, a, b), np.where(shorter, b, a)
    cost, row = np.r_[0, size[a].cumsum()], 0
    while row < len(a):
        end = max(row + 1, int(np.searchsorted(cost, cost[row] + HOLDERS, "right")) - 1)
        n = size[a[row:end]]
        i = np.repeat(start[a[row:end]] - (n.cumsum() - n), n) + np.arange(n.sum())
        sought = np.repeat(b[row:end], n) * n_codes + code[i]
        j = np.minimum(np.searchsorted(entry, sought), len(entry) - 1)
        yield row, end, i, j, entry[j] == sought, np.repeat(np.arange(end - row), n)
        row = end


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their keys, of rows in order of key."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        key = table["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key's rows may go on
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if held is not None and len(held):
        yield held


def first_met(rows: pa.Table, least: dict[int, int], kinds: int) -> Iterator[pa.Table]:
    """(key, a, b, n_<kind>) of rows (key, id, own: all keys of the row, in order) of pairs a < b of a key that is the first
    that they share, and that share as many keys of a kind as `least` asks for; a key's kind is its rest by `kinds`."""
    rows = rows.take(pa.array(np.lexsort((rows["id"].to_numpy(), rows["key"].to_numpy()))))
    key, ids, lists = rows["key"].to_numpy(), rows["id"].to_numpy(), _plain(rows["own"])
    opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    local = np.arange(len(key)) - np.repeat(opens, np.diff(np.r_[opens, len(key)]))
    # a row meets those of its key before it
    b = np.repeat(np.arange(len(key)), local)
    a = b - local[b] + (np.arange(len(b)) - np.repeat(local.cumsum() - local, local))
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    own = lists.flatten().to_numpy(zero_copy_only=False)
    names, code = np.unique(own, return_inverse=True)
    for lo, hi, i, _, same, of in _matches(a, b, size, code, len(names)):
        first = np.full(hi - lo, len(names))
        np.minimum.at(first, of[same], code[i[same]])
        kind = own[i] % kinds
        counts = {k: np.bincount(of, same & (kind == k), hi - lo).astype(np.int64) for k in least}
        wanted = (names[np.minimum(first, len(names) - 1)] == key[b[lo:hi]]) & (ids[a[lo:hi]] < ids[b[lo:hi]]) & np.any([counts[k] >= n for k, n in least.items()], axis=0)
        x, y = a[lo:hi][wanted], b[lo:hi][wanted]
        yield pa.table({"key": key[x], "a": ids[x], "b": ids[y], **{f"n_{k}": n[wanted] for k, n in counts.items()}})
