"""Ranking: rollups, terms, facets, positions, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.scratch import kept


def storyline_rollup(entries: DataFrame, lists: bool = True) -> DataFrame:
    """For each storyline its entries, feeds, agencies (sorted; their number without `lists`), first and newest
    time, heaviest publisher.

    Each kind of value is made distinct by itself and then counted: several distinct counts in one aggregate would copy
    every row for each of them, and sort all copies where a list is collected beside them."""
    w = lambda c: F.col("storyline").eqNullSafe(F.col(c))
    by_entry = entries.groupBy("storyline", "entry").agg(F.min("ts").alias("first_at"), F.max("ts").alias("newest_at"), F.max("weight").alias("weight"))
    out = by_entry.groupBy("storyline").agg(
        F.count("entry").alias("entry_count"), F.min("first_at").alias("first_at"), F.max("newest_at").alias("newest_at"), F.max("weight").alias("weight"))
    feeds = entries.select(F.col("storyline").alias("_f"), "feed").distinct().groupBy("_f").agg(F.count("feed").alias("feeds"))
    found = entries.select(F.col("storyline").alias("_a"), "agency").distinct().groupBy("_a")
    found = found.agg(F.array_sort(F.collect_list("agency")).alias("agencies")) if lists else found.agg(F.count("agency").alias("agencies"))
    return out.join(feeds, w("_f")).join(found, w("_a")).select("storyline", "entry_count", "feeds", "agencies", "first_at", "newest_at", "weight")


def rank_terms(rubric: Column, agencies: Column, feeds: Column, weight: Column, newest: Column, cutoff_s: int, tau_s: float = 124600.0) -> dict[str, Column]:
    """Rubric (or half of the total for unjudged ones), breadth of agencies and feeds, authority, recency. newest:
    seconds. The cut-off is a parameter, never the clock."""
    return {
        "rubric": F.coalesce(rubric, F.lit(4.0)),
        "agencies": 0.5 * F.log1p(agencies.cast("double")),
        "feeds": 0.5 * F.log1p(feeds.cast("double")),
        "authority": F.log(F.greatest(weight, F.lit(0.001))),
        "recency": F.least(newest, F.lit(float(cutoff_s))) / F.lit(tau_s),
    }


def rank_key(rubric: Column, agencies: Column, feeds: Column, weight: Column, newest: Column, cutoff_s: int, tau_s: float = 124600.0) -> Column:
    """The sum of the terms."""
    first, *others = rank_terms(rubric, agencies, feeds, weight, newest, cutoff_s, tau_s).values()
    return sum(others, first)


def term_differences(pairs: DataFrame, terms: DataFrame, names: list[str]) -> DataFrame:
    """For each term the mean absolute difference of the two rows of a pair (a, b, follows), over pairs whose verdict
    follows the ranking and over those whose doesn't: (term, agreeing, disagreeing). terms: id and a column for each."""
    side = lambda to: terms.select(F.col("id").alias(to), *[F.col(n).alias(f"{n}_{to}") for n in names])
    each = F.array(*[F.struct(F.lit(n).alias("term"), F.abs(F.col(f"{n}_a") - F.col(f"{n}_b")).alias("delta")) for n in names])
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("follows", F.inline(each))
    return rows.groupBy("term").agg(F.avg(F.when(F.col("follows"), F.col("delta"))).alias("agreeing"), F.avg(F.when(~F.col("follows"), F.col("delta"))).alias("disagreeing"))


def facets(rows: DataFrame, *, agencies: str = "agencies", single: dict[str, str]) -> DataFrame:
    """G1: each row once for all, once for each of its agencies, and once for each single facet, in one pass."""
    all_of = F.array(F.struct(F.lit("global").alias("facet_type"), F.lit("all").alias("facet_key")))
    by_agency = F.transform(agencies, lambda a: F.struct(F.lit("agency").alias("facet_type"), a.alias("facet_key")))
    others = [
        F.array(F.struct(F.lit(kind).alias("facet_type"), F.col(c).cast("string").alias("facet_key")))
        for kind, c in single.items()
    ]
    return rows.withColumn("facet", F.explode(F.concat(all_of, by_agency, *others))).select("*", "facet.*").drop("facet")


def positions(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Position of each row among those alike in `by`. A group is sorted in one task; see ordinals()."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def ordinals(rows: DataFrame, order: list[str | Column], name: str = "ordinal", by: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """Positions from 1 in an order without ties, over all rows or among those alike in `by`, without one
    task that sees them all.

    Rows are range-partitioned by group and order and sorted, and written out once with their place: partition and row.
    Counts, offsets and rows all come from that table, as range borders differ from one run of a plan to the next. Each
    group has one run of rows in each partition that it reaches; a run's offset is the sum of those before it. With
    `total`, a column of that name has the group's count.
    """
    sort = [*by, *order]
    placed = kept(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = [F.sum("_n").over(Window.partitionBy(*by)).alias(total)] if total else []
    runs = runs.select(F.col("_part").alias("_run"), *[F.col(c).alias(f"_run_{c}") for c in by], "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), *every)
    return placed.join(runs, _same_run(by)).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name), *([total] if total else []))


def running_sums(rows: DataFrame, by: tuple[str, ...], order: list[str | Column], column: str, name: str = "sum", count: str = "n") -> DataFrame:
    """Each row with the sum of a column and the count of rows of its group up to it, in an order without ties. A
    null counts as a row of 0.

    A grouped prefix scan: rows are range-partitioned by group and order, sorted and written once. Sums run inside a
    partition, and what the partitions before it hold of the group, one row for each of them, is added: a group of any
    size is spread over tasks, and no window holds more than a written partition.
    """
    sort = [*by, *order]
    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    placed = kept(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*by, "_part").agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in ("_s", "_n")]
    runs = runs.select(F.col("_part").alias("_run"), *[F.col(c).alias(f"_run_{c}") for c in by], *ahead)
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_s", F.sum(value).over(inside)).withColumn("_n", F.count("*").over(inside))
    out = [(F.col(c) + F.col(f"{c}_before")).alias(made) for c, made in (("_s", name), ("_n", count))]
    return summed.join(runs, _same_run(by)).select(*rows.columns, *out)


def _same_run(by: tuple[str, ...]) -> Column:
    """Rows and runs of equal partitions and groups; a null is a group of its own."""
    same = F.col("_part") == F.col("_run")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_run_{c}"))
    return same


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of a value in each group, linearly between the two rows around a place: by and a column for
    each name. Values are numbered in range partitions, so that a group of any size is spread over tasks; only the rows at
    the places asked for are joined, two for each group and name. Nulls have no place; a group of nulls only has nulls."""
    placed = ordinals(rows.where(F.col(value).isNotNull()).select(by, value, F.monotonically_increasing_id().alias("_tie")), [value, "_tie"], "_at_row", (by,), "_total")
    out = rows.select(by).distinct()
    wanted = []
    for name, share in shares.items():
        place = 1 + share * (F.col("_total") - 1)
        inside = (F.col("_at_row") == F.floor(place)) | (F.col("_at_row") == F.floor(place) + 1)
        weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_at_row") - place))
        wanted.append(F.struct(F.lit(name).alias("name"), F.when(inside, weight).alias("weight")))
    near = placed.select(by, value, F.inline(F.filter(F.array(*wanted), lambda x: x["weight"] > 0)))
    made = near.groupBy(by).agg(*[F.sum(F.when(F.col("name") == n, F.col(value) * F.col("weight"))).alias(n) for n in shares])
    return out.withColumnRenamed(by, "_group").join(made, F.col("_group").eqNullSafe(F.col(by)), "left").select(F.col("_group").alias(by), *shares)


def percentile_of_rank(rows: DataFrame, by: tuple[str, ...], order: list[str | Column]) -> DataFrame:
    """(position - 1) / (n - 1), 0 for a single row; the order has no ties."""
    placed = ordinals(rows, order, "_position", by, "_total")
    share = F.when(F.col("_total") > 1, (F.col("_position") - 1) / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    return placed.withColumn("percentile", share).drop("_position", "_total")


def neighbour_pairs(ranked: DataFrame, by: list[str], width: int, key: str) -> DataFrame:
    """Each row with the next `width` rows of its facet, by an equi-join on facet and position: rows are dealt by
    both, so a facet of any size is spread over tasks."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(width))).alias("step")
    before = ranked.select(*by, F.col(key).alias("a"), "position", steps).select(*by, "a", "step", (F.col("position") + F.col("step")).alias("position"))
    return before.join(ranked.select(*by, "position", F.col(key).alias("b")), [*by, "position"]).select(*by, "a", "b", "step")


def neighbours(ranked: DataFrame, by: list[str], width: int, key: str) -> DataFrame:
    """Each row's `width` neighbours on either side, as an array near of structs (position, key) in their order."""
    ahead = neighbour_pairs(ranked, by, width, key)
    both = ahead.select(*by, F.col("a").alias(key), F.col("step").alias("at"), F.col("b").alias("other")).union(
        ahead.select(*by, "b", -F.col("step"), "a"))
    met = both.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct("at", "other"))).alias("near"))
    return ranked.join(met, [*by, key], "left").withColumn(
        "near", F.transform(F.coalesce("near", F.array()), lambda x: F.struct((F.col("position") + x["at"]).alias("position"), x["other"].alias(key))))


def swap_verdict(verdicts: DataFrame) -> DataFrame:
    """Pairs judged both ways agree on a winner, or are inconsistent. verdicts: a, b, winner (a's or b's id)."""
    back = verdicts.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("winner").alias("reverse"))
    return (
        verdicts.where("a < b")
        .join(back, ["a", "b"])
        .select("a", "b", F.when(F.col("winner") == F.col("reverse"), F.col("winner")).alias("winner"), (F.col("winner") != F.col("reverse")).alias("inconsistent"))
    )


def check_positions(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Per facet, whether positions run from 1 to the count without gaps, and how far terms miss their key."""
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        ((F.min("position") == 1) & (F.max("position") == F.count("*")) & (F.count_distinct("position") == F.count("*"))).alias("contiguous"),
    )


def preference_weights(pairs: DataFrame, deltas: list[str], *, l2: float = 0.01, rounds: int = 60) -> list[float]:
    """Non-negative weights of rubric deltas from pairs (won, offset, deltas), by logistic regression with a fixed
    offset and mean loss + l2/2 |w|^2, rounded to four digits.

    Projected Newton steps: weights at zero whose gradient would make them negative stay there, the others take the
    Newton step among themselves, cut back to zero and halved until the loss falls. Each needs only sums over the pairs:
    loss, gradient and a small square matrix, one aggregate.
    """
    import numpy as np

    k = len(deltas)
    pairs = kept(pairs.select("won", "offset", *deltas))  # each step reads them again
    n = max(1, pairs.count())

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        score = F.col("offset").cast("double")
        for c, x in zip(deltas, w, strict=True):
            score = score + F.col(c) * float(x)
        won = F.col("won").cast("double")
        p = 1 / (1 + F.exp(-score))
        loss = F.greatest(score, F.lit(0.0)) + F.log1p(F.exp(-F.abs(score))) - won * score
        sums = pairs.agg(
            F.sum(loss).alias("loss"),
            *[F.sum((p - won) * F.col(c)).alias(f"g{i}") for i, c in enumerate(deltas)],
            *[F.sum(p * (1 - p) * F.col(a) * F.col(b)).alias(f"h{i}_{j}") for i, a in enumerate(deltas) for j, b in enumerate(deltas)],
        ).first()
        gradient = np.array([sums[f"g{i}"] or 0.0 for i in range(k)]) / n + l2 * w
        matrix = np.array([[sums[f"h{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]) / n + l2 * np.eye(k)
        return (sums["loss"] or 0.0) / n + l2 / 2 * float(w @ w), gradient, matrix

    w = np.zeros(k)
    loss, gradient, matrix = at(w)
    for _ in range(rounds):
        free = (w > 0) | (gradient < 0)
        step = np.zeros(k)
        if free.any():
            step[free] = np.linalg.solve(matrix[np.ix_(free, free)], gradient[free])
        for half in range(12):
            tried = np.maximum(w - step / 2**half, 0.0)
            found = at(tried)
            if found[0] <= loss:
                break
        moved = np.abs(tried - w).max(initial=0.0)
        w, (loss, gradient, matrix) = tried, found
        if moved < 1e-9:
            break
    return [round(float(x), 4) for x in w]
