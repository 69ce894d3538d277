"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines, reassemble by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import ascii_lower, staged, strip_white


def line_key(line: Column) -> Column:
    return ascii_lower(strip_white(line))


def _hash(key: Column) -> Column:
    """128 bits, so that equal hashes mean equal keys at any corpus size met in practice."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def _kept_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, carry: Sequence[str]) -> DataFrame:
    """id, text (kept lines), n_lines, n_dropped, carried: a struct of the columns named in carry, c0 on by place."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("n"), *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried"),
    ).withColumn("tk", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    exploded = (
        rows.where("id is not null")
        .select("id", "tk", F.posexplode(F.transform(lines, line_key)).alias("pos", "key"))
        .where(F.length("key") >= min_chars)
        .select("id", "tk", "pos", _hash(F.col("key")).alias("h"))
    )
    holders = exploded.select("h", "id").distinct().groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("keeper"))
    repeated = staged(holders.where(F.col("n") >= min_docs).select("h", "keeper"))
    drops = (
        exploded.join(repeated, "h")
        .where(F.col("id") != F.col("keeper"))
        .groupBy("id", "tk")
        .agg(F.collect_set("pos").alias("drop"))
    )
    joined = rows.join(drops, ["id", "tk"], "left").select("id", lines.alias("lines"), "drop", "carried")
    # Positions, not texts, are subtracted: array_except hashes its operands, so long documents stay linear.
    positions = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.transform(positions, lambda p: F.get(F.col("lines"), p))
    )
    return joined.select(
        "id",
        F.array_join(kept, "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        "carried",
    )


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Drops each line that min_docs documents or more hold, except in the smallest id that holds it.

    Returns id_col, text (kept lines joined by newlines), n_lines, n_dropped; one row for each input row.
    A null text counts as one empty line. Lines whose key has fewer than min_chars code points always stay.
    A null id is no document: its lines stay and are not counted. Rows that repeat an id and its text are one
    document and are treated alike. Columns named in carry come along; others are ignored, whatever their names. Texts of
    any length are split whole. No rows in, none out.

    Plan: only 16-byte hashes are shuffled for the counts. (hash, id) pairs are made distinct first, so a line in
    a third of all documents reaches its counter as one partial count per task. The repeated hashes are written
    out before the join back, which lets adaptive execution split a hot hash. Texts are shuffled once, by id.
    """
    kept = _kept_lines(docs, id_col, text_col, min_chars, min_docs, carry)
    more = [F.col("carried")[f"c{i}"].alias(c) for i, c in enumerate(carry)]
    return kept.select(F.col("id").alias(id_col), "text", "n_lines", "n_dropped", *more)


def drop_repeated_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str = "n_chars",
    min_chars: int = 10,
    min_docs: int = 2,
) -> DataFrame:
    """docs with all their columns, whatever their names, and only the lines that dedup_lines() keeps; chars_col, where
    there is one, is brought up to date. Documents that lost lines and have no more than white space left are dropped,
    all others stay. Nulls, repeats and empty tables as there; a null text becomes empty.
    """
    carry = [c for c in docs.columns if c not in (id_col, text_col)]
    kept = _kept_lines(docs, id_col, text_col, min_chars, min_docs, carry)
    out = kept.where((F.col("n_dropped") == 0) | (strip_white(F.col("text")) != ""))
    columns = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col("carried")[f"c{i}"] for i, c in enumerate(carry)}
    if chars_col in carry:
        columns[chars_col] = F.length("text").cast(docs.schema[chars_col].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])
