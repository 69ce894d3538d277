"""State changes as joins of two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(previous: DataFrame, current: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """One full outer join of a state table (key, attributes, active) and a snapshot (key, attributes) gives the
    next state and what happened: insert, update, reactivate, deactivate or keep. Nulls compare as values."""
    p = previous.select(F.col(key).alias("k"), F.struct(*attributes).alias("was"), F.col("active").alias("was_active"))
    c = current.select(F.col(key).alias("k"), F.struct(*attributes).alias("now"))
    action = (
        F.when(F.col("was").isNull(), "insert")
        .when(F.col("now").isNull(), F.when(F.col("was_active"), "deactivate").otherwise("keep"))
        .when(~F.col("was_active"), "reactivate")
        .when(~F.col("was").eqNullSafe(F.col("now")), "update")
        .otherwise("keep")
    )
    j = p.join(c, "k", "full_outer").withColumn("action", action).withColumn("x", F.coalesce("now", "was"))
    return j.select(F.col("k").alias(key), *[F.col("x")[a].alias(a) for a in attributes], F.col("now").isNotNull().alias("active"), "action")


def dispositions(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """C14: what becomes of each incoming row (id, url, external_id, ordinal) beside existing ones (id, url,
    external_id): matched by URL, by outside id, by both to different rows (a conflict), repeated in the batch, or new.
    A row without a URL is known by its outside id alone; one without either has no identity. One row for each row."""
    by_url = existing.select(F.col("url"), F.col("id").alias("url_id")).where("url is not null").groupBy("url").agg(F.min("url_id").alias("url_id"))
    by_ext = existing.select("external_id", F.col("id").alias("ext_id")).where("external_id is not null").groupBy("external_id").agg(F.min("ext_id").alias("ext_id"))
    key = F.coalesce(F.concat(F.lit("url "), "url"), F.concat(F.lit("id "), "external_id"))
    named = incoming.withColumn("_key", key)
    first = named.where("_key is not null").groupBy("_key").agg(F.min("ordinal").alias("first"))
    j = named.join(by_url, "url", "left").join(by_ext, "external_id", "left").join(first, "_key", "left")
    return j.select(
        "id",
        F.when(F.col("url_id").isNotNull() & F.col("ext_id").isNotNull() & (F.col("url_id") != F.col("ext_id")), "identity_conflict")
        .when(F.col("url_id").isNotNull(), "existing_url")
        .when(F.col("ext_id").isNotNull(), "existing_external_id")
        .when(F.col("_key").isNull(), "no_identity")
        .when(F.col("ordinal") != F.col("first"), "repeated")
        .otherwise("inserted")
        .alias("disposition"),
        F.coalesce("url_id", "ext_id").alias("matched"),
    )


def sync(current: DataFrame, incoming: DataFrame, key: str, content: str, features: list[str]) -> DataFrame:
    """The next version of a table: incoming content wins, and features of changed rows are cleared."""
    i = incoming.select(F.col(key), F.col(content).alias("new"))
    j = current.join(i, key, "full_outer")
    changed = F.col("new").isNotNull() & ~F.col(content).eqNullSafe(F.col("new"))
    return j.select(key, F.coalesce("new", content).alias(content), *[F.when(~changed, F.col(f)).alias(f) for f in features], changed.alias("changed"))


def replay(current: DataFrame, incoming: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Content (key, version, chars, hash) that comes again replaces what is stored if a newer extractor made it, or
    the same one with more text; the features of a replaced row are cleared. New keys are added without features."""
    i = incoming.select(key, *[F.col(c).alias("new_" + c) for c in ("version", "chars", "hash")])
    j = current.join(i, key, "full_outer")
    better = (F.col("new_version") > F.col("version")) | ((F.col("new_version") == F.col("version")) & (F.col("new_chars") > F.col("chars")))
    replaced = F.col("new_version").isNotNull() & F.coalesce(better, F.lit(True))
    content = [F.when(replaced, F.col("new_" + c)).otherwise(F.col(c)).alias(c) for c in ("version", "chars", "hash")]
    return j.select(key, *content, *[F.when(~replaced, F.col(f)).alias(f) for f in features], replaced.alias("replaced"))


def merge_groups(rows: DataFrame, mapping: DataFrame, column: str, *, least: int) -> DataFrame:
    """I4: groups after a merge (mapping: column, target): merged ones stay as tombstones that name their target, the
    others are counted anew with what moved to them, and those under `least` rows are demoted."""
    moved = repoint(rows, mapping, column)
    counts = moved.groupBy(column).agg(F.count("*").alias("n"), F.max("published_at").alias("newest_at"))
    state = F.when(F.col("target").isNotNull(), "merged").when(F.coalesce("n", F.lit(0)) < least, "demoted").otherwise("active")
    known = rows.select(column).distinct().join(mapping, column, "left").join(counts, column, "left")
    return known.select(column, state.alias("state"), "target", F.coalesce("n", F.lit(0)).alias("n"), "newest_at")


def fill_features(current: DataFrame, incoming: DataFrame, key: str, features: list[str]) -> DataFrame:
    """New feature values over old ones; a null leaves the old."""
    n = incoming.select(key, *[F.col(f).alias("new_" + f) for f in features])
    return current.join(n, key, "left").select(key, *[F.coalesce("new_" + f, f).alias(f) for f in features])


def misses(seen: DataFrame, known: DataFrame, key: str, limit: int) -> DataFrame:
    """Relations that were seen are active with no misses; others miss once more and end at the limit."""
    s = seen.select(key).distinct().withColumn("seen", F.lit(True))
    j = known.join(s, key, "full_outer")
    n = F.when(F.col("seen"), 0).otherwise(F.col("misses") + 1).cast("long")
    return j.select(key, n.alias("misses"), (n < limit).alias("active"))


def snapshot_gate(previous: DataFrame, current: DataFrame, key: str, least_rows: int, least_share: float) -> DataFrame:
    """One row: whether a snapshot may replace the last, and each reason why not."""
    p = previous.agg(F.count("*").alias("before"))
    c = current.agg(F.count("*").alias("after"), F.count_distinct(key).alias("keys"))
    few, shrunk, twice = F.col("after") < least_rows, F.col("after") < least_share * F.col("before"), F.col("keys") < F.col("after")
    return p.crossJoin(c).select("before", "after", few.alias("too_few"), shrunk.alias("shrunk"), twice.alias("duplicate_keys"), (~(few | shrunk | twice)).alias("accepted"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """For each named rule the rows that break it; a null outcome breaks it too. One pass for all rules."""
    sums = rows.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])).alias("r")).select("r.*")


def repoint(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """I4: rows whose group was merged move to the group it went to. mapping: column, target."""
    return rows.join(mapping, column, "left").withColumn(column, F.coalesce("target", column)).drop("target")
