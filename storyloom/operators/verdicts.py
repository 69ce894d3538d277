"""Scores of judged verdicts (D24, D25). Each score is one aggregate over its verdicts and gives one row; a set without
verdicts has no score (null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted(passed: Column, total: Column) -> Column:
    """Share of passes less twice that of failures."""
    return F.try_divide(passed - 2 * (total - passed), total)


def chain_scores(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """V1: links of chains, pairs (chain, position, method, related), under chain verdicts (chain, verdict, endpoints):
    score, n, drift_rate, worst_method and its precision.

    A chain that drifted, should be split, or whose ends are unrelated, while all its links passed, is charged for its
    last link. Methods are judged before that charge. Verdicts: coherent, drifted, should_split.
    """
    failed = (F.col("verdict") != "coherent") | ~F.col("endpoints")
    whole = Window.partitionBy("chain")
    last = F.row_number().over(whole.orderBy(F.desc("position"))) == 1
    all_passed = F.every("related").over(whole)
    judged = pairs.join(chains.select("chain", failed.alias("failed")), "chain", "left")
    charged = judged.withColumn("value", F.col("related") & ~(last & all_passed & F.coalesce("failed", F.lit(False))))
    by_method = pairs.groupBy("method").agg(F.avg(F.col("related").cast("double")).alias("precision"))
    worst = by_method.agg(F.min(F.struct("precision", "method")).alias("w"))
    drift = chains.agg(F.avg((F.col("verdict") == "drifted").cast("double")).alias("drift_rate"))
    out = charged.agg(weighted(F.count_if("value"), F.count("*")).alias("v1"), F.count("*").alias("v1_n"))
    return out.crossJoin(drift).crossJoin(worst).select(  # one row each
        "v1", "v1_n", F.coalesce("drift_rate", F.lit(0.0)).alias("drift_rate"), F.col("w.method").alias("worst_method"), F.col("w.precision").alias("worst_precision"))


def theme_scores(members: DataFrame, granularity: DataFrame) -> DataFrame:
    """V2 by theme: members (theme, fits, planted) and granularity (theme, verdict: right, too_granular, too_broad).
    Misfits and accepted intruders count twice against a theme; a wrong granularity costs a quarter."""
    g = members.groupBy("theme").agg(
        F.count_if(~F.col("planted") & F.col("fits")).alias("fits"), F.count_if(~F.col("planted")).alias("own"),
        F.count_if(F.col("planted") & F.col("fits")).alias("accepted"), F.count("*").alias("cases"))
    misfits = F.col("own") - F.col("fits")
    score = (F.col("fits") - 2 * misfits - 2 * F.col("accepted")) / F.col("cases") - F.when(F.col("verdict") == "right", 0.0).otherwise(0.25)
    intruders = F.col("cases") - F.col("own")
    told_apart = F.when(intruders > 0, F.coalesce(F.col("fits") / F.nullif("own", F.lit(0)), F.lit(0.0)) - F.col("accepted") / intruders)
    return g.join(granularity, "theme").select("theme", "cases", "own", score.alias("score"), told_apart.alias("discrimination"))


def theme_score(by_theme: DataFrame) -> DataFrame:
    """V2: the mean over themes, and how well planted intruders are told apart."""
    return by_theme.agg(F.avg("score").alias("v2"), F.count("*").alias("v2_themes"), F.sum("cases").alias("v2_cases"), F.avg("discrimination").alias("discrimination"))


def category_score(rows: DataFrame) -> DataFrame:
    """V3: share of verdicts that are correct or ambiguous."""
    return rows.agg(F.avg(F.col("verdict").isin("correct", "ambiguous").cast("double")).alias("v3"), F.count("*").alias("v3_n"))


def merge_score(rows: DataFrame) -> DataFrame:
    """V4: how many candidate pairs should be merged."""
    return rows.agg(F.count_if("should_merge").alias("merges"), F.count("*").alias("merge_candidates"))


def token_score(rows: DataFrame) -> DataFrame:
    """V5: (kind: entity or event_key, valid): precision of entities, validity of keys."""
    entity, key = F.col("kind") == "entity", F.col("kind") == "event_key"
    share = lambda k: F.avg(F.when(k, F.col("valid").cast("double")))
    return rows.agg(share(entity).alias("v5"), F.count_if(entity).alias("v5_n"), share(key).alias("key_validity"))


def event_score(rows: DataFrame) -> DataFrame:
    """V6: pairs judged the same event."""
    return rows.agg(weighted(F.count_if("same_event"), F.count("*")).alias("v6"), F.count("*").alias("v6_n"))


#: What an overview is judged by; a claim that isn't faithful counts twice against it.
CRITERIA = ("coverage", "faithful", "current", "representative")


def overview_score(rows: DataFrame) -> DataFrame:
    """V7: share of criteria passed, less twice the unfaithful overviews, over all criteria."""
    passed = sum((F.count_if(c) for c in CRITERIA[1:]), F.count_if(CRITERIA[0]))
    return rows.agg(F.try_divide(passed - 2 * F.count_if(~F.col("faithful")), len(CRITERIA) * F.count("*")).alias("v7"), F.count("*").alias("v7_n"))


VECTORS = ("v1", "v2", "v3", "v5", "v6", "v7")


def reward(scores: DataFrame) -> DataFrame:
    """The mean of six scores less 0.02 for each merge outstanding; null if one is missing. Beside it what one
    flipped verdict changes in each (V2's by its smallest theme: least_cases)."""
    parts = [F.col(v) for v in VECTORS]
    mean = sum(parts[1:], parts[0]) / len(parts) - 0.02 * F.col("merges")
    flip = lambda by, n: F.try_divide(F.lit(by), n * len(parts))
    themes = F.col("v2_themes")
    return scores.select(
        mean.alias("reward"), flip(3.0, F.col("v1_n")).alias("flip_v1"), F.greatest(flip(3.0, F.col("least_cases") * themes), flip(0.25, themes)).alias("flip_v2"),
        flip(1.0, F.col("v3_n")).alias("flip_v3"), flip(1.0, F.col("v5_n")).alias("flip_v5"), flip(3.0, F.col("v6_n")).alias("flip_v6"),
        flip(3.0, F.col("v7_n") * len(CRITERIA)).alias("flip_v7"))
