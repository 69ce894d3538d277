"""MinHash near-dedup: bottom-k sketches of one hash function, inverted lists of retained values, union-sketch
estimates, exact Jaccard on full sets, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import map_texts, staged
from storyloom.llm.word_hash import chunks, mix, word_hashes
from storyloom.operators.components import connected_components

#: Odd multipliers for the places in a shingle.
_PLACES = np.random.default_rng(4).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Rows of three numbers that are sent to all tasks, 24 MB, in place of shuffling texts; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of the word shingles of each text; of fewer words, the whole sequence is one."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        hashes, bounds = word_hashes(texts[a:b])
        n = len(hashes)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            rolled += hashes[k : k + len(rolled)] * _PLACES[k]
        rolled = mix(rolled) >> np.uint64(1)
        for i in range(b - a):
            s, e = bounds[i], bounds[i + 1]
            if e - s >= width:
                out.append(np.unique(rolled[s : e - width + 1]))
            elif e > s:
                whole = (hashes[s:e] * _PLACES[: e - s]).sum() + np.uint64(e - s)
                out.append(mix(np.array([whole], np.uint64)) >> np.uint64(1))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(k: int, percent: int, miss: float) -> int:
    """Most T for which a pair at the threshold shares fewer than T of the k smallest values of its union with a
    probability of at most `miss` (a binomial bound on the hypergeometric tail)."""
    p, tail = percent / 100, 0.0
    for t in range(k + 1):
        tail += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail > miss:
            return t
    return k


@dataclass(frozen=True)
class Threshold:
    """When sets link, and what their sketches of k values then share."""

    percent: int
    k: int | None
    miss: float

    def needed(self, n: Column) -> Column:
        """Retained values that a partner at the threshold shares with a set of n: exactly known up to k, else T."""
        exact = F.ceil(n * self.percent / 100).cast("int")
        return exact if self.k is None else F.least(exact, F.lit(least_overlap(self.k, self.percent, self.miss)))

    def likely(self, a: Column, b: Column) -> Column:
        """Whether two sketches allow a link: enough of the k smallest values of their union are in both."""
        union = F.sort_array(F.array_union(a, b))
        union = union if self.k is None else F.slice(union, 1, self.k)
        return F.size(F.array_intersect(F.array_intersect(union, a), b)) >= self.needed(F.size(union))

    def fits(self, n: Column, m: Column) -> Column:
        """Whether the sizes of two sets allow a link."""
        return (n * 100 >= m * self.percent) & (m * 100 >= n * self.percent)

    def apart(self, sizes: Column) -> Column:
        """Most shingles that are in only one of two linked sets, by the sum of their sizes."""
        return F.floor(sizes * (100 - self.percent) / F.lit(100 + self.percent)).cast("int")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    k: int | None = 64,
    miss: float = 1e-7,
    hub_rounds: int = 2,
    long_list: int = 50,
) -> DataFrame:
    """id_col, n_shingles, component_id (smallest id reachable over links), kept (is it its own component's id).

    Sets link if 100 * intersection >= percent * union. One row for each row, none for none. A text without words, or
    null, has no shingles and is linked with nothing. A null id takes no part: component_id null, kept true. Rows that
    repeat an id and a text are one document; rows that share an id but not a text are documents of their own with that
    id. Texts of any length are read whole. Other columns are ignored.

    1. One pass makes each text's set, its bottom-k sketch and a 128-bit digest of the set. Equal sets are one class,
       by partial aggregation, so thousands of copies cost nothing more.
    2. Inverted lists of retained values, for the classes. Partners share at least T of the values in their sketches
       (missed with a probability of at most `miss`), so with all values ordered from rare to frequent they share one
       of the first m - T + 1 of theirs: only these are listed. A passage that many documents hold is frequent and
       falls out of the lists of all that hold much else. k=None retains whole sets: exact, for more disk.
    3. A long list is not multiplied out. Each member is first compared with a hub of its lists, the one that shares the
       longest lists, then another; what links falls into one component. Then only pairs of one list that are still in
       different components are compared, so no link between components is lost. Lists longer than long_list are
       first taken apart by the differences of their members from a hub (see _spread).
    4. Compared means: estimated from the bottom-k of the union of both sketches, then checked on full sets.
    """
    made = "n bigint, d1 bigint, d2 bigint, sketch array<bigint>"
    at = Threshold(percent, k, miss)
    signed = lambda x: int(np.uint64(x).astype(np.int64))
    digest = lambda s: signed(mix(s).sum(dtype=np.uint64))

    def sketch(texts: list[str | None]) -> dict[str, list]:
        sets = shingle_sets(texts, width)
        return {
            "n": [len(s) for s in sets],
            "d1": [digest(s) for s in sets],
            "d2": [signed(mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)).sum(dtype=np.uint64)) for s in sets],
            "sketch": [s[:k].astype(np.int64) for s in sets],
        }

    made_rows = staged(map_texts(docs, id_col, text_col, made, sketch).withColumnRenamed(id_col, "id"))
    real = made_rows.where("id is not null and n > 0")
    classes = staged(
        real.groupBy("n", "d1", "d2")
        .agg(F.min("id").alias("first"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    values = classes.select("node", "n", F.explode("sketch").alias("v"))
    shared = staged(values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"))
    listed = staged(
        values.join(shared, "v")
        .groupBy("node", "n")
        .agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("by_rarity"))
        # values that no other set holds come first of all and need no list
        .withColumn("take", F.greatest(F.lit(0), F.size("by_rarity") - at.needed(F.col("n")) + 1))
        .select("node", "n", F.explode(F.slice("by_rarity", F.lit(1), F.col("take"))).alias("x"))
        .select(F.col("x.v").alias("v"), "node", "n")
    )
    lists = staged(listed.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"))
    # A group's unedited original is in most of its lists, and those are its longest: it makes the best hub.
    weights = listed.join(lists, "v").groupBy("node").agg(F.sum("c").alias("weight"))
    listed = staged(listed.join(lists.select("v"), "v").join(staged(weights), "node").select("v", "node", "n", "weight"))
    members = staged(listed.select("node").distinct().join(classes.select("node", "first", "d1"), "node"))

    def full(texts: list[str | None]) -> dict[str, list]:
        sets = shingle_sets(texts, width)
        return {"d1": [digest(s) for s in sets], "set": [s.astype(np.int64) for s in sets]}

    few = members.count() <= MOST_BROADCAST
    sent = lambda df: F.broadcast(df) if few else df
    wanted = docs.join(sent(members.select(F.col("first").alias(id_col)).distinct()), id_col, "left_semi")
    sets = staged(
        map_texts(wanted.select(id_col, text_col), id_col, text_col, "d1 bigint, set array<bigint>", full)
        .withColumnRenamed(id_col, "first")
        .join(sent(members), ["first", "d1"])
        .select("node", "set")
        .dropDuplicates(["node"])
    )
    sketches = classes.select("node", "sketch")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        likely = staged(
            pairs.join(_side(sketches, "a"), "a")
            .join(_side(sketches, "b"), "b")
            .where(at.likely(F.col("sketch_a"), F.col("sketch_b")))
            .select("a", "b")
            .distinct()
        )
        common = F.size(F.array_intersect("set_a", "set_b"))
        return (
            likely.join(_side(sets, "a"), "a")
            .join(_side(sets, "b"), "b")
            .select("a", "b", common.alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
            .where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent)
            .select("a", "b")
            .distinct()
        )

    hub_order = lambda r: F.struct(F.col("weight"), -F.col("node")) if r == 0 else F.struct(F.xxhash64("node", F.lit(r)), F.col("node"))
    links = None
    placed = listed.withColumn("component", F.col("node"))
    for r in range(hub_rounds):
        hubs = (
            placed.groupBy("v")
            .agg(
                F.max_by(F.struct("node", "component", "n"), hub_order(r)).alias("hub"),
                F.min("component").alias("lo"),
                F.max("component").alias("hi"),
            )
            .where("lo <> hi")
            .select("v", F.col("hub.node").alias("hub"), F.col("hub.component").alias("hub_component"), F.col("hub.n").alias("m"))
        )
        best = (
            placed.join(staged(hubs), "v")
            .where((F.col("component") != F.col("hub_component")) & at.fits(F.col("n"), F.col("m")))
            .groupBy("node", "hub")
            .agg(F.count("*").alias("c"))
            .groupBy("node")
            .agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
        )
        found = linked(_pair("node", "hub", best).distinct())
        links = staged(found if links is None else links.union(found).distinct())
        placed = _placed(listed, connected_components(links))
    sized = _sized(placed, ["v"])
    rest = staged(placed.join(sized, "v"))
    short = rest.where(F.col("size") <= long_list)
    other = short.select("v", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("component_b"))
    across = (
        short.withColumnRenamed("node", "a")
        .join(other, "v")
        .where((F.col("a") < F.col("b")) & (F.col("component") != F.col("component_b")) & at.fits(F.col("n"), F.col("m")))
        .select("a", "b")
    )
    links, spread = _spread(rest.where(F.col("size") > long_list).select("v", "node", "n", "weight"), sets, links, at)
    labels = staged(connected_components(links.union(linked(across.union(spread).distinct())).distinct()))

    named = classes.select("node", "first", "n", "d1", "d2").join(labels, "node")
    least = staged(named.groupBy("component").agg(F.min("first").alias("component_id")))
    found = classes.select("node", "first", "n", "d1", "d2").join(labels, "node", "left").join(least, "component", "left")
    found = staged(found.select("n", "d1", "d2", F.coalesce("component_id", "first").alias("component_id")))
    out = made_rows.select("id", "n", "d1", "d2").join(found, ["n", "d1", "d2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _side(rows: DataFrame, to: str) -> DataFrame:
    return rows.select(F.col("node").alias(to), *[F.col(c).alias(f"{c}_{to}") for c in rows.columns if c != "node"])


def _pair(x: str, y: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the component of their node; a node without a link is its own."""
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _sized(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose rows are in more than one component, and how many rows each has."""
    sums = rows.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"))
    return staged(sums.where("lo <> hi").select(*key, "size"))


def _spread(crowded: DataFrame, sets: DataFrame, links: DataFrame, at: Threshold) -> tuple[DataFrame, DataFrame]:
    """Long lists (v, node, n, weight) taken apart: links with those found, and pairs (a, b) of what is still apart; every
    link between different components is among them.

    All members of a list are compared with one of them, its hub. Let s(x) be how many shingles x shares with the hub, own(x)
    the others of x. Sets x and y that link share at least ceil(percent of the larger) shingles, and min(s(x), s(y)) of them
    at most are the hub's. So if s(x) is less than percent of x, a foreign member, say one that holds the hub's passage and
    little else of it, own(x) and own(y) share t = ceil(percent of the larger) - min(s(x), s(y)) or more, which is over 0:
    with own shingles ordered from rare to common they share one among the first |own| - t + 1 of each. What a foreign
    member lacks of the hub needs no row.

    Two that aren't foreign meet by what differs: let D(x) be the shingles that are in just one of x and the hub. x and y
    differ in |D(x)| + |D(y)| - 2 |D(x) and D(y)| shingles, so if they link, D(x) and D(y) share at
    least t = (|D(x)| + |D(y)| - most) / 2, where `most` is what linked sets of their sizes differ in. With both linked to
    the hub they are in its component. Else one, x, is not, and t is over 1 and over about half of |D(y)|; of |D(x)| it
    leaves out at most `most`, and half of it too if y isn't linked to the hub either. With differences ordered from
    rare to common they share one among the first |D| - t + 1 of each.

    So (hub, shingle) is the key under which what is apart meets; edits of one's own are rare and come first, so few
    members meet anyone. Of those that do, bitmaps of both sets drop a pair if they show that too many shingles differ.
    """
    percent = at.percent
    hubs = staged(
        crowded.groupBy("v")
        .agg(F.max_by(F.struct("node", "n"), F.struct(F.col("weight"), -F.col("node"))).alias("h"))
        .select("v", F.col("h.node").alias("hub"), F.col("h.n").alias("m"))
    )
    # A list all of whose members already have another, larger list's hub takes that one: fewer comparisons.
    own = staged(crowded.select("v", "node").join(hubs.select("v", "hub"), "v"))
    known = staged(own.select("node", "hub").distinct())
    held_by = known.groupBy("hub").agg(F.count("*").alias("members"))
    sizes = own.groupBy("v").agg(F.count("*").alias("size"))
    covering = own.select("v", "node").join(known, "node").groupBy("v", "hub").agg(F.count("*").alias("have")).join(sizes, "v").where("have = size")
    chosen = covering.join(held_by, "hub").groupBy("v").agg(F.max_by("hub", F.struct("members", "hub")).alias("hub"))
    by_size = hubs.select("hub", "m").distinct()
    met = staged(
        crowded.select("v", "node", "n").join(staged(chosen), "v").where("node <> hub").select("node", "hub", "n").distinct().join(by_size, "hub")
    )
    d, n = F.col("d"), F.col("n")
    apart = staged(
        met.join(_side(sets, "hub"), "hub")
        .join(sets.withColumnRenamed("set", "set_node"), "node")
        .select("node", "hub", "n", "m", F.array_except("set_node", "set_hub").alias("own"), F.array_except("set_hub", "set_node").alias("lack"))
        .withColumn("d", F.size("own") + F.size("lack"))
        .withColumn("near", d <= at.apart(n + F.col("m")))
        .withColumn("s", n - F.size("own"))
        .withColumn("foreign", F.col("s") * 100 < n * percent)
    )
    links = staged(links.union(_pair("node", "hub", apart.where("near"))).distinct())
    labels = connected_components(links)
    home = labels.select(F.col("node").alias("hub"), F.col("component").alias("home"))
    placed = _placed(apart, labels).join(home, "hub", "left").withColumn("home", F.coalesce("home", "hub"))
    placed = staged(placed.join(_sized(placed, ["hub"]).select("hub"), "hub"))
    about = ["hub", "node", "n", "component", "home"]
    # by own shingles: the least that any partner of a foreign member can share with it
    least = F.when(F.col("foreign"), F.ceil(n * percent / 100) - F.col("s")).otherwise(1)
    own = placed.withColumn("reach", (F.size("own") - least).cast("int"))
    marked = staged(_bitmaps(sets.join(placed.select("node").distinct(), "node", "left_semi")))
    keyed = _rare_first(own, "own", [*about, "s", "foreign", "reach"]).join(marked, "node")
    a, b = _sided(keyed.where("component <> home"), "_a"), _sided(keyed, "_b")
    t = F.ceil(F.greatest("n_a", "n_b") * percent / 100) - F.least("s_a", "s_b")
    can_link = (
        (F.col("foreign_a") | F.col("foreign_b"))
        & (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("home_b")) | (F.col("node_a") < F.col("node_b")))
        & (F.col("place_a") <= F.col("n_a") - F.col("s_a") - t)
        & (F.col("place_b") <= F.col("n_b") - F.col("s_b") - t)
        & at.fits(F.col("n_a"), F.col("n_b"))
        & _may_share(percent)
    )
    by_own = _pair("node_a", "node_b", a.join(b, ["hub", "w"]).where(can_link))
    # by what differs. The last place that any partner can need: one that isn't linked to the hub, or, of those
    # themselves, one that is.
    all_but_most = d - F.greatest(F.lit(1), d - at.apart(n + F.floor(n * 100 / percent)))
    half = F.least(all_but_most, d - F.floor(d * percent / (100 + percent)) - 1)
    close = (
        placed.where(~F.col("foreign"))
        .withColumn("diff", F.concat("own", "lack"))
        .withColumn("half", half.cast("int"))
        .withColumn("reach", F.when(F.col("near"), F.col("half")).otherwise(all_but_most.cast("int")))
    )
    keyed = _rare_first(close, "diff", [*about, "d", "near", "half", "reach"]).join(marked, "node")
    a, b = _sided(keyed.where("component <> home"), "_a"), _sided(keyed.where("place <= half"), "_b")
    t = F.greatest(F.lit(1), F.ceil((F.col("d_a") + F.col("d_b") - at.apart(F.col("n_a") + F.col("n_b"))) / 2))
    can_link = (
        (F.col("component_a") != F.col("component_b"))
        & (F.col("near_b") | (F.col("place_a") <= F.col("half_a")))
        & ((F.col("component_b") == F.col("home_b")) | (F.col("node_a") < F.col("node_b")))
        & (F.col("place_a") <= F.col("d_a") - t)
        & (F.col("place_b") <= F.col("d_b") - t)
        & at.fits(F.col("n_a"), F.col("n_b"))
        & _may_share(percent)
    )
    return links, by_own.union(_pair("node_a", "node_b", a.join(b, ["hub", "w"]).where(can_link)))


#: Words of 64 bits in a set's bitmap.
BITMAP = 16


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(node, bits0, bits1, ...) of sets (node, set): a bit for each shingle, by ten bits of its hash."""
    one = "aggregate(filter(set, x -> shiftright(x, 6) & {last} = {i}), 0L, (acc, x) -> acc | shiftleft(1L, cast(x & 63 AS int))) AS bits{i}"
    return sets.selectExpr("node", *[one.format(i=i, last=BITMAP - 1) for i in range(BITMAP)])


def _may_share(percent: int) -> Column:
    """Whether the bitmaps of sides _a and _b leave it open that the sets link. Each bit that only one side has is of a
    shingle that the other doesn't hold, so no pair that links is dropped."""
    only = lambda x, y: sum((F.bit_count(F.col(f"bits{i}{x}").bitwiseAND(F.bitwise_not(f"bits{i}{y}"))) for i in range(1, BITMAP)), F.bit_count(F.col(f"bits0{x}").bitwiseAND(F.bitwise_not(f"bits0{y}"))))
    shared = F.least(F.col("n_a") - only("_a", "_b"), F.col("n_b") - only("_b", "_a"))
    return shared * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def _rare_first(members: DataFrame, values: str, about: list[str]) -> DataFrame:
    """(about, w, place) of each member's values w that another member of its hub holds too, up to place `reach`: places
    count from 0 in the order from rare to common, in which those that no other holds come first and need no row."""
    met = _that_meet(members.select(*about, F.size(values).alias("size"), values), values)
    held = staged(met.select(*about, "size", F.explode(values).alias("w")))
    common = staged(held.groupBy("hub", "w").agg(F.count("*").alias("c")).where("c > 1"))
    ranked = (
        held.join(common, ["hub", "w"])
        .groupBy(*about, "size")
        .agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("common"))
        .withColumn("alone", F.col("size") - F.size("common"))
        .select(*about, "alone", F.posexplode(F.slice("common", F.lit(1), F.greatest(F.lit(0), F.col("reach") + 1 - F.col("alone")))).alias("i", "x"))
    )
    return staged(ranked.select(*about, F.col("x.w").alias("w"), (F.col("alone") + F.col("i")).alias("place")))


#: Bits of the filter of values that two members of a hub hold, 4 MB that all tasks get, and in how many parts it is made.
FILTER_BITS, FILTER_PARTS = 25, 64


def _bit(batch: pa.RecordBatch, values: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The values of a batch's rows (hub, values) in one array, how many each row has, and the bit of each in its hub."""
    lists = batch.column(values)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    hub = np.repeat(batch.column("hub").to_numpy().astype(np.uint64), n)
    return flat, n, (mix(flat.to_numpy().astype(np.uint64) ^ mix(hub)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _that_meet(members: DataFrame, values: str) -> DataFrame:
    """members (hub, values, ...) without values that no other member of the hub holds, but for a few whose bit in a filter
    another value has too: what nobody shares needs no row of its own. Bits that a batch of members holds go to their part
    of the filter as arrays, where those held twice are found."""
    span = (1 << FILTER_BITS) // FILTER_PARTS

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, n = np.unique(_bit(batch, values)[2], return_counts=True)
            bits = np.repeat(bits, np.minimum(n, 2))
            bounds = np.searchsorted(bits, np.arange(FILTER_PARTS + 1) * span)
            parts = np.flatnonzero(np.diff(bounds))
            lists = [bits[bounds[i] : bounds[i + 1]] - i * span for i in parts]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["part", "bits"])

    def twice(rows: pa.Table) -> pa.Table:
        bits, n = np.unique(rows["bits"].combine_chunks().flatten().to_numpy(), return_counts=True)
        out = np.zeros(span, bool)
        out[bits[n > 1]] = True
        return pa.table({"part": rows["part"][:1], "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    parts = members.select("hub", values).mapInArrow(held, "part long, bits array<long>").groupBy("part").applyInArrow(twice, "part long, bits binary")
    whole = np.zeros((FILTER_PARTS, span // 8), np.uint8)
    for r in parts.collect():  # 4 MB at most
        whole[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    sent = members.sparkSession.sparkContext.broadcast(whole.tobytes())

    def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            flat, n, bits = _bit(batch, values)
            met = (known[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8) & 1).astype(bool)
            ends = np.r_[0, met.cumsum()][np.r_[0, n.cumsum()]].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(met)))
            at = batch.schema.get_field_index(values)
            yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return members.mapInArrow(those, members.schema)


def _sided(rows: DataFrame, to: str) -> DataFrame:
    return rows.select("hub", "w", *[F.col(c).alias(c + to) for c in rows.columns if c not in ("hub", "w")])


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps: one document of each group.

    Rows without an id, and texts without words, are kept. Rows that repeat an id are all kept if a row of that id is.
    Long texts and empty tables as there.
    """
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where("kept").select(id_col)
    return docs.join(kept.where(F.col(id_col).isNotNull()).distinct(), id_col, "left_semi").select(docs.columns).union(
        docs.where(F.col(id_col).isNull())
    )
