"""Clusters above storylines and matching between clusterings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import vectors
from storyloom.operators import blocks, hyperplanes, similar
from storyloom.operators.scratch import forget, kept


def theme_edges(rows: DataFrame, by: str, least: float, recall: float | None = None) -> DataFrame:
    """H5: pairs (a, b) of rows (id, embedding) of one category with a cosine from `least` on. With a recall, rows meet
    through bands of hyperplanes, and each pair is found with that probability. Without, a category is cut into blocks of
    bounded size, each of which meets the whole category, so that a large one is spread over tasks: exact, all pairs."""
    if recall is not None:
        fullest = rows.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        side = lambda to: rows.select(by, F.col("id").alias(to), "embedding")
        met = hyperplanes.near_pairs(side("l"), side("r"), least=least, recall=recall, by=(by,), population=fullest)
        return met.where("l < r").select(F.col("l").alias("a"), F.col("r").alias("b")).distinct()
    side, count, groups = _categories(rows, (by,))

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        (left, x), (right, y) = blocks.units(left, "embedding"), blocks.units(right, "embedding")
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for first, sims in blocks.cosines(x, y):
            r, c = np.nonzero((sims >= least) & (ids[first : first + len(sims), None] < others))
            found.append((ids[r + first], others[c]))
        return pa.table({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    return blocks.crossed(side, side, (count, count), pairs, "a long, b long", (by,), groups)


def _categories(rows: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, int, int]:
    """Rows of a category, the blocks that each is cut into, how many categories there are; of small ones, how many tasks
    they fill."""
    fullest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.count("*").alias("groups"), F.sum("n").alias("rows")).first()
    filled = max(16, (fullest["rows"] or 0) // (similar.BUCKET_ROWS // 2))
    # two at least, so that a category is spread over tasks
    return rows.select(*by, "id", "embedding").dropna(subset=list(by)), max(2, similar.block_count(fullest["n"] or 0)), min(fullest["groups"], filled)


def theme_links(rows: DataFrame, by: str | tuple[str, ...], least: float) -> DataFrame:
    """H5: edges (a < b) that connect just those rows that theme_edges() connects. Of the pairs in two blocks an edge
    leaves the task only if it connects what wasn't connected there yet; exact, and a category's pairs are compared."""
    by = (by,) if isinstance(by, str) else by
    side, count, groups = _categories(rows, by)

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        (left, x), (right, y) = blocks.units(left, "embedding"), blocks.units(right, "embedding")
        if left["_i"][0].as_py() > right["_j"][0].as_py():
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})  # the same pairs are met the other way
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        forest = blocks.Forest(np.r_[ids, others])
        for first, sims in blocks.cosines(x, y):
            r, c = np.nonzero(sims >= least)
            forest.link(ids[r + first], others[c])
        return forest.edges()

    return blocks.crossed(side, side, (count, count), links, "a long, b long", by, groups)


def gated_themes(members: DataFrame, *, least_members: int, least_days: int, least_cohesion: float) -> DataFrame:
    """H5: clusters (cluster, id, published_at, embedding) with enough members on enough days, whose members' mean cosine
    to their centroid is high enough: cluster, n, days, cohesion."""
    sim = similar.to_centroid(members, "cluster").select("cluster", "sim", F.to_date("published_at").alias("day"))
    g = sim.groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"), F.round(F.avg("sim"), 6).alias("cohesion"))
    return g.where((F.col("n") >= least_members) & (F.col("days") >= least_days) & (F.col("cohesion") >= least_cohesion))


def average_linkage(rows: DataFrame, edges: DataFrame, stop: float) -> DataFrame:
    """H4: (id, cluster) by average linkage down to a mean cosine of `stop`; edges: the pairs (a, b) at the stop value or
    above, without which no merge can be. In each round all pairs of clusters merge that are best for each other, ties by
    a hash, so that copies halve in number: average linkage can't bring a third cluster nearer to a merged one than to both its parts, so that gives one
    merge at a time's clusters. A cluster is its sum of unit vectors and its size: the mean cosine of two is a product."""
    unit = vectors.unit(F.col("embedding"))
    clusters = kept(rows.select(F.col("id").alias("c"), unit.alias("s"), F.lit(1).cast("long").alias("n")))
    members = kept(rows.select("id", F.col("id").alias("cluster")))
    new = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    side = lambda x: clusters.select(F.col("c").alias(x), F.col("s").alias("s" + x), F.col("n").alias("n" + x))
    near, waste = None, []
    while True:
        dot = F.aggregate(F.zip_with("sa", "sb", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        met = new.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(dot / (F.col("na") * F.col("nb")), 12).alias("mean"))
        # a pair below the stop can't come back by a merge: a merged cluster is no nearer to a third than both its parts were
        met = met.where(F.col("mean") >= stop)
        near = kept(met if near is None else met.union(near))
        forget(*waste)
        if near.isEmpty():
            return members
        ends = near.select(F.explode(F.array("a", "b")).alias("e"), F.struct((-F.col("mean")).alias("m"), F.xxhash64("a", "b").alias("h"), "a", "b").alias("x"))
        best = ends.groupBy("e").agg(F.min("x").alias("x"))
        merged = kept(best.groupBy("x").agg(F.count("*").alias("n")).where("n = 2").select(F.col("x.b").alias("was"), F.col("x.a").alias("now")))
        moved = kept(merged.select(F.inline(F.array(F.struct("was", "now"), F.struct(F.col("now").alias("was"), "now")))))
        to = lambda x: moved.select(F.col("was").alias(x), F.col("now").alias(f"_{x}"))
        waste = [members, clusters, near, merged, moved]
        members = kept(members.join(to("cluster"), "cluster", "left").select("id", F.coalesce("_cluster", "cluster").alias("cluster")))
        grown = merged.join(side("now"), "now").join(side("was"), "was").select(
            F.col("now").alias("c"), F.zip_with("snow", "swas", lambda x, y: x + y).alias("s"), (F.col("nnow") + F.col("nwas")).alias("n"))
        clusters = kept(clusters.join(moved.select(F.col("was").alias("c")), "c", "left_anti").union(grown))
        # only pairs with a cluster that has grown are computed again
        told = near.join(to("a"), "a", "left").join(to("b"), "b", "left")
        x, y = F.coalesce("_a", "a"), F.coalesce("_b", "b")
        new = told.where("_a is not null or _b is not null").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b").distinct()
        near = told.where("_a is null and _b is null").select("a", "b", "mean")


def greedy_matches(edges: DataFrame) -> DataFrame:
    """H6: one-to-one matches of edges (l, r, score), best score first, ties by l and r: in each round the edges that
    are best for both their ends are taken, which is greedy's choice under a total order. Each round takes one at least."""
    left, taken = kept(edges.select("l", "r", "score")), None
    order = [F.desc("score"), F.asc("l"), F.asc("r")]
    while not left.isEmpty():
        ranked = left.withColumn("rl", F.row_number().over(Window.partitionBy("l").orderBy(*order))).withColumn("rr", F.row_number().over(Window.partitionBy("r").orderBy(*order)))
        now = kept(ranked.where("rl = 1 and rr = 1").select("l", "r", "score"))
        taken = now if taken is None else kept(taken.union(now))
        left = kept(left.join(now.select("l"), "l", "left_anti").join(now.select("r"), "r", "left_anti"))
    return edges.where("false") if taken is None else taken


def sweep_outcome(clusters: DataFrame, themes: DataFrame, matches: DataFrame) -> DataFrame:
    """H7: what a sweep does with clusters (cluster, failed) and themes (theme, manual): matched themes are kept, other
    clusters make new ones, unless their naming failed; themes without a cluster are demoted, unless they are manual or
    a cluster failed, which may have been theirs. (cluster, theme, action)"""
    m = matches.select(F.col("l").alias("cluster"), F.col("r").alias("theme"))
    matched = clusters.join(m, "cluster", "left")
    made = matched.select("cluster", "theme", F.when(F.col("theme").isNotNull(), "kept").when(F.col("failed"), "failed").otherwise("created").alias("action"))
    lost = made.agg(F.count_if(F.col("action") == "failed").alias("failures"))
    spared = F.when(F.col("manual"), "kept").when(F.col("failures") > 0, "protected").otherwise("demoted")
    gone = themes.join(m.select("theme"), "theme", "left_anti").crossJoin(F.broadcast(lost))  # one row
    return made.union(gone.select(F.lit(None).cast(clusters.schema["cluster"].dataType).alias("cluster"), "theme", spared.alias("action")))


def assignments(members: DataFrame, outcome: DataFrame) -> DataFrame:
    """H7: the theme that each member (id, cluster) of a kept or created theme is assigned to; a created theme is named
    by its cluster. (id, theme, created)"""
    taken = outcome.where("action in ('kept', 'created') and cluster is not null")
    return members.join(taken, "cluster").select("id", F.coalesce("theme", "cluster").alias("theme"), (F.col("action") == "created").alias("created"))


def run_opinion(verdicts: DataFrame) -> DataFrame:
    """Per target (target, side, step, crosses) how many neighbours in a row, nearest first, it should cross on a
    side; bounded if the window ended before it found one that it should not."""
    g = verdicts.groupBy("target", "side").agg(F.min(F.when(~F.col("crosses"), F.col("step"))).alias("stop"), F.max("step").alias("last"))
    return g.select("target", "side", F.coalesce(F.col("stop") - 1, F.col("last")).cast("long").alias("run"), F.col("stop").isNull().alias("bounded"))


def skip_fill(groups: DataFrame, targets: dict[str, int], seed: str) -> DataFrame:
    """Whole groups (stratum, key, size) in seeded hash order, each taken if it still fits its stratum's target:
    (stratum, key, size).

    In rounds: what is left of a target admits at most that many groups, so the first ones in hash order of a size that
    still fits are enough for a round. They go through a fold in one row of bounded length; the next round begins after
    the last of them with the smaller rest. Each round takes at least one group or is the last.
    """
    h = F.sha2(F.concat(F.lit(seed), F.col("key").cast("string")), 256)
    rows = kept(groups.select("stratum", "key", F.col("size").cast("long").alias("size"), h.alias("h")))
    left = {k: (t, "") for k, t in targets.items()}
    taken = None
    while left:
        now = F.lit(None)
        after = F.lit(None)
        for k, (rest, last) in left.items():
            now, after = F.when(F.col("stratum") == k, F.lit(rest)).otherwise(now), F.when(F.col("stratum") == k, F.lit(last)).otherwise(after)
        open_rows = rows.withColumn("rest", now.cast("long")).where((F.col("h") > after) & (F.col("size") <= F.col("rest")))
        w = Window.partitionBy("stratum").orderBy("h")
        first = open_rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("rest"))
        lists = first.groupBy("stratum", "rest").agg(F.array_sort(F.collect_list(F.struct("h", "size", "key"))).alias("g"))
        start = F.struct(F.lit(0).cast("long").alias("total"), F.slice("g", 1, 0).alias("got"))

        def step(acc, g):
            fits = acc["total"] + g["size"] <= F.col("rest")
            return F.struct(F.when(fits, acc["total"] + g["size"]).otherwise(acc["total"]).alias("total"), F.when(fits, F.concat(acc["got"], F.array(g))).otherwise(acc["got"]).alias("got"))

        folded = kept(lists.select("stratum", F.aggregate("g", start, step).alias("f"), F.element_at("g", -1)["h"].alias("last")))
        got = folded.select("stratum", F.explode("f.got").alias("x")).select("stratum", "x.key", "x.size")
        taken = got if taken is None else taken.union(got)
        sums = folded.select("stratum", F.col("f.total").alias("total"), "last").collect()  # one row for each stratum
        left = {r["stratum"]: (left[r["stratum"]][0] - r["total"], r["last"]) for r in sums if left[r["stratum"]][0] > r["total"]}
    return taken


def fill_with_singletons(taken: DataFrame, singles: DataFrame, target: int, seed: str) -> DataFrame:
    """Singles (key) in seeded hash order for what the groups taken (size) leave of a target: (key)."""
    rest = max(0, target - (taken.agg(F.sum("size")).first()[0] or 0))
    h = F.sha2(F.concat(F.lit(seed), F.col("key").cast("string")), 256)
    return singles.orderBy(h, "key").limit(rest).select("key")
