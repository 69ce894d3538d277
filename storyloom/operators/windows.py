"""Event-time windows and ordered picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_of(ts: str) -> Column:
    return F.unix_micros(F.col(ts)) / F.lit(1e6)


def earlier_duplicate(rows: DataFrame, key: str, ts: str, id_col: str, hours: float) -> DataFrame:
    """C4: the newest earlier row with the same key, if strictly within the window. In a chain of equal keys that is
    the row just before."""
    w = Window.partitionBy(key).orderBy(ts, id_col)
    before, at = F.lag(id_col).over(w), F.lag(F.unix_micros(ts)).over(w)
    recent = F.unix_micros(ts) - at < int(hours * 3600 * 1_000_000)
    return rows.withColumn("duplicate_of", F.when(recent, before))


def decayed_counts(mentions: DataFrame, key: str, ts: str, half_life_s: float) -> DataFrame:
    """Per key its first and last time, count, and exponentially decayed count as of the last."""
    last = mentions.groupBy(key).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("n"))
    aged = mentions.select(key, ts).join(last, key)
    decay = F.pow(F.lit(0.5), (seconds_of("last_at") - seconds_of(ts)) / half_life_s)
    return aged.groupBy(key, "first_at", "last_at", "n").agg(F.sum(decay).alias("ema"))


#: Half-lives after which the running sum starts anew: powers of two of twice as many still are numbers.
EPOCH = 400


def running_decay(mentions: DataFrame, key: str, ts: str, id_col: str, half_life_s: float) -> DataFrame:
    """The decayed count as of each mention, itself included.

    A running sum of growing weights, scaled back. Ages count from the start of an epoch of 400 half-lives, so that no
    weight overflows however long a key's mentions span; the epoch before adds its sum, those before it less than 2^-400.
    """
    first = mentions.groupBy(key).agg(F.min(seconds_of(ts)).alias("_first"))
    age = (seconds_of(ts) - F.col("_first")) / half_life_s
    aged = mentions.join(first, key).withColumn("_epoch", F.floor(age / EPOCH)).withColumn("_age", age - F.col("_epoch") * EPOCH)
    grown = aged.withColumn("_up", F.pow(F.lit(2.0), F.col("_age"))).drop("_first")
    w = Window.partitionBy(key, "_epoch").orderBy(ts, id_col).rowsBetween(Window.unboundedPreceding, 0)
    before = grown.groupBy(key, (F.col("_epoch") + 1).alias("_epoch")).agg((F.sum("_up") * F.lit(2.0**-EPOCH)).alias("_before"))
    summed = grown.withColumn("_sum", F.sum("_up").over(w)).join(before, [key, "_epoch"], "left")
    ema = (F.col("_sum") + F.coalesce("_before", F.lit(0.0))) * F.pow(F.lit(2.0), -F.col("_age"))
    return summed.withColumn("ema", ema).select(*mentions.columns, "ema")


def episodes_by_gap(rows: DataFrame, key: str, ts: str, id_col: str, gap_s: int) -> DataFrame:
    """H2: runs of a key with no gap over gap_s (a gap equal to it stays in the run), numbered from 1."""
    w = Window.partitionBy(key).orderBy(ts, id_col)
    opens = F.when(F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w) > gap_s * 1_000_000, 1).otherwise(0)
    runs = rows.withColumn("_opens", opens)
    return runs.withColumn("episode", F.sum("_opens").over(w) + 1).drop("_opens")


def newest_per_group(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order. The partial top-n runs before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def card_versions(cards: DataFrame, by: str, order: list[Column], key: str) -> DataFrame:
    """Dense versions per group; each card but the last is superseded by the next."""
    w = Window.partitionBy(by).orderBy(*order)
    return cards.withColumn("version", F.row_number().over(w).cast("long")).withColumn("superseded_by", F.lead(key).over(w))


def fair_due(rows: DataFrame, lane: str, order: list[Column], cap: int, active: DataFrame) -> DataFrame:
    """Per lane at most cap less what is active there, oldest first. active: lane, n."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(lane).orderBy(*order)))
    return (
        ranked.join(active.select(F.col(lane), F.col("n").alias("_active")), lane, "left")
        .where(F.col("_rn") <= cap - F.coalesce("_active", F.lit(0)))
        .drop("_rn", "_active")
    )


def canonical_rows(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key is canonical; the others are its duplicates."""
    return rows.withColumn("is_canonical", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)


def banded_sample(rows: DataFrame, band: Column, seed: str, key: str, n: int) -> DataFrame:
    """Round robin over bands, within a band by a seeded hash; the first n. No random numbers. No band gives more than
    n rows, and the first n of a task's share of a band are enough of it to shuffle."""
    hashed = rows.withColumn("band", band).withColumn("_h", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256))
    ranked = hashed.withColumn("_rn", F.row_number().over(Window.partitionBy("band").orderBy("_h", key)))
    return ranked.where(F.col("_rn") <= n).orderBy("_rn", "band").limit(n).drop("_rn", "_h")
