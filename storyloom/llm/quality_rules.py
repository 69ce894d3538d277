"""Quality rules in native expressions: a short-circuit cascade, ordered by sampled rejection per timed cost."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import WHITE, let, staged, strip_white, words_of

SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition rule.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named rejection."""

    name: str
    reject: Column


@dataclass(frozen=True)
class Limits:
    """Thresholds. Each is far from what prose shows, so that clean documents stay."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbols_per_100_words: int = 20
    max_upper_percent: int = 50
    max_dup_line_percent: int = 60
    min_lines_for_dup: int = 5
    min_word_chars: int = 2
    max_word_chars: int = 25


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, WHITE, ""))


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(strip_white(x)) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def n_upper(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))


def n_repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    Windows are compared by 64-bit hash. Sorting (hash, start) puts equal windows side by side; the starts of the
    repeated ones, in order, then give the size of their union. A text without repeats stops at the distinct count.
    """
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        step = lambda acc, p: F.struct(
            p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")
        )
        return F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    def repeated(ranked: Column) -> Column:
        twin = lambda x, j: (x["h"] == F.get(ranked, j - 1)["h"]) | (x["h"] == F.get(ranked, j + 1)["h"])
        found = F.filter(ranked, lambda x, j: F.coalesce(twin(x, j), F.lit(False)))
        return covered(F.array_sort(F.transform(found, lambda x: x["i"])))

    def count(hs: Column) -> Column:
        ranked = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(ranked, repeated))

    return let(hashes, count)


def rules(text: Column, limits: Limits = Limits(), measured: dict[str, Column] | None = None) -> list[Rule]:
    """The rules on a text column. measured: columns that already hold a measure, by name; others are computed where
    and when a rule needs them."""
    m = measured or {}
    words = m.get("words", words_of(text))
    n_words = m.get("n_words", F.size(words))
    chars = m.get("word_chars", word_chars(text))
    repeats = m.get("n_repeat_words", let(words, n_repeat_words))
    dup = m.get("n_dup_lines", n_dup_lines(text))
    n_lines = F.size(F.split(text, "\n", -1))
    symbols = m.get("n_symbols", n_symbols(text))
    return [
        Rule("few_words", n_words < limits.min_words),
        Rule("repeated_windows", 100 * repeats > limits.max_repeat_percent * n_words),
        Rule("symbols", 100 * symbols > limits.max_symbols_per_100_words * n_words),
        Rule("upper_case", 100 * n_upper(text) > limits.max_upper_percent * chars),
        Rule("duplicate_lines", (n_lines >= limits.min_lines_for_dup) & (100 * dup > limits.max_dup_line_percent * n_lines)),
        Rule("word_length", (chars < limits.min_word_chars * n_words) | (chars > limits.max_word_chars * n_words)),
    ]


def ordered(docs: DataFrame, text_col: str, limits: Limits, *, fraction: float, seed: int = 7) -> list[str]:
    """Names of the rules by rejection per cost, both measured on a sample of the documents, which is written out once.

    The cost of a rule is the time of one aggregate of it over the sample, less that of an aggregate that only reads the
    texts and splits them into words, as the cascade does for all rules at once. Only the order, and so the speed, depends
    on it; the verdict of the whole cascade does not. An empty sample leaves the given order.
    """
    sample = staged(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).sample(fraction, seed))
    sample = sample.withColumn("words", words_of(F.col("text")))
    made = rules(F.col("text"), limits, {"words": F.col("words")})

    def timed(value: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(value.cast("double")), F.max(F.size("words"))).first()[0] or 0.0
        return share, time.perf_counter() - began

    timed(F.lit(0))  # the first run also pays for loading
    base = timed(F.lit(0))[1]
    gain = {}
    for r in made:
        share, seconds = timed(r.reject)
        gain[r.name] = share / max(seconds - base, 0.001)
    return sorted(gain, key=lambda name: -gain[name])  # stable: equal gains keep the given order


def first_failed(cascade: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null. coalesce() evaluates a rule only if those before it let pass."""
    return F.coalesce(*[F.when(r.reject, F.lit(r.name)) for r in cascade], F.lit(None).cast("string"))


def filter_quality(
    docs: DataFrame, *, text_col: str = "text", limits: Limits = Limits(), fraction: float = 0.01
) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns, whatever their names. A null or empty text has no
    words and is rejected. Rows that repeat are judged alike; long texts are judged whole; no rows give none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = ordered(docs, text_col, limits, fraction=fraction)

    def verdict(words: Column) -> Column:
        by_name = {r.name: r for r in rules(text, limits, {"words": words})}
        return first_failed([by_name[name] for name in order])

    return docs.where(let(words_of(text), verdict).isNull())


def score_quality(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = Limits(),
    fraction: float = 0.01,
) -> DataFrame:
    """All measures of each row and the cascade's verdict: id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, failed_rule (null if kept). One row for each input row.

    Null and empty texts have no words: zero measures, base_failed. Rows that repeat are judged alike, long texts whole;
    no rows give none. Other columns are ignored. No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ordered(rows, "text", limits, fraction=fraction)
    split = rows.withColumn("words", words_of(F.col("text")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    measured = split.select(
        "id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("text")).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).cast("long").alias("n_symbols"),
        n_dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    by_name = {r.name: r for r in rules(F.col("text"), limits, {n: F.col(n) for n in names})}
    failed = first_failed([by_name[name] for name in order])
    base = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")
    )
    return measured.select(
        F.col("id").alias(id_col),
        *names,
        base.alias("base_failed"),
        failed.isNull().alias("kept"),
        failed.alias("failed_rule"),
    )
