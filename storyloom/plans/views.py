"""Catalogues, as-of views, metrics and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.operators import rank, verdicts
from storyloom.operators.windows import newest_per_group
from storyloom.plans.roles import CHAIN, STORYLINE_ENTRIES, VECTORS, chain, seconds, storyline_entries, table, vectors
from storyloom.plans.similarity import NEAR, c5_near_duplicate

AS_OF_S = 883612800  # 1998-01-01


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    """The newest card of each storyline up to the end of a day."""
    o = table(spark, d, "orders").where(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) <= AS_OF_S)
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("card")).select("o_custkey", "card.*")


def c19_as_of_card(spark: SparkSession, d: str) -> DataFrame:
    return _as_of(spark, d).select("o_custkey", "o_orderkey")


def f4_as_of_rank(spark: SparkSession, d: str) -> DataFrame:
    best = _as_of(spark, d).orderBy(F.desc("o_totalprice"), F.asc("o_orderdate"), F.asc("o_orderpriority"), F.asc("o_orderkey")).limit(200)
    w = Window.orderBy(F.desc("o_totalprice"), F.asc("o_orderdate"), F.asc("o_orderpriority"), F.asc("o_orderkey"))
    return best.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("position"))


def c20_as_of_detail(spark: SparkSession, d: str) -> DataFrame:
    """Storylines at a time: visible entries, their episodes (two turns each) that have a visible original, and cards."""
    cut = F.timestamp_seconds(F.lit(1704326400))
    seen = chain(spark, d).where(F.col("ts") <= cut).withColumn("episode", F.floor(F.col("ordinal") / 2))
    whole = seen.groupBy("storyline", "episode").agg(F.count("*").alias("entries"), F.count_if(~F.col("syndicated")).alias("originals"), F.max("ordinal").alias("last"))
    return whole.where("originals > 0").groupBy("storyline").agg(
        F.count("*").alias("episodes"), F.sum("entries").alias("entries"), F.max("last").alias("last_turn"))


def c21_theme_visibility(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).where(F.unix_seconds("published_at") <= 1704672000)
    g = v.groupBy("label").agg(F.count("*").alias("n"), F.max(F.unix_seconds("published_at")).alias("newest_s"))
    return g.select("label", "n", ((F.col("n") >= F.when(F.col("label") == 0, 1).otherwise(4)) & (F.col("newest_s") >= 1704672000 - 2 * 86400)).alias("visible"))


def c1_publisher_attribution(spark: SparkSession, d: str) -> DataFrame:
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier").where("s_suppkey % 10 <> 0")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("s_suppkey").isNull()).alias("missing"))


def c26_storyline_detail(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("lines"))
    e = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.struct("o_orderkey", F.size("lines").alias("n"), F.element_at("lines", 1)["l_suppkey"].alias("first")).alias("e"))
    shown = F.transform(F.array_sort(F.collect_list("e")), lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["n"].cast("string"), x["first"].cast("string")))
    return e.groupBy("o_custkey").agg(F.array_join(shown, ";").alias("episodes"))


def d1_episode_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts, times and the words of each storyline's turns, sorted, at most 128: distinct words before they meet."""
    c = chain(spark, d)
    words = c.select("storyline", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).distinct()
    w = Window.partitionBy("storyline").orderBy("w")
    first = words.withColumn("rn", F.row_number().over(w)).where("rn <= 128").groupBy("storyline").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("words"))
    sums = c.groupBy("storyline").agg(F.count("*").alias("n"), F.min(seconds("ts")).alias("first_s"), F.max(seconds("ts")).alias("last_s"))
    return sums.join(first, "storyline")


def d3_theme_rollup(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min(seconds("published_at")).alias("first_s"), F.max(seconds("published_at")).alias("newest_s"))


def d12_corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 200).alias("short"), F.sum(F.length("text")).alias("chars"))


def d13_volume(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"), F.expr("sum(cast(round(o_totalprice * 100) as bigint)) div count(*)").alias("mean_cents"))


def d13_attach_mix(spark: SparkSession, d: str) -> DataFrame:
    """How entries with a vector came to their storyline, with the mean similarity, and how chains' turns did: first,
    original or syndicated."""
    v = vectors(spark, d)
    near = c5_near_duplicate(spark, d)  # to six digits, as its matches are given
    m = v.select("id").join(near, "id", "left").select(F.when(F.col("sim").isNull(), "new").when(F.col("sim") >= 0.35, "near_duplicate").otherwise("candidate").alias("method"), "sim")
    one = m.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("similarity"))
    turns = chain(spark, d).select(F.when(F.col("ordinal") == 0, "first").when(F.col("syndicated"), "syndicated").otherwise("original").alias("method"))
    two = turns.groupBy("method").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("similarity"))
    return one.select(F.lit("entries").alias("level"), "*").union(two.select(F.lit("storylines"), "*"))


def d13_syndication(spark: SparkSession, d: str) -> DataFrame:
    return chain(spark, d).agg(F.round(F.avg(F.col("syndicated").cast("double")), 6).alias("syndication_rate"), F.count("*").alias("turns"))


def d14_percentiles(spark: SparkSession, d: str) -> DataFrame:
    shares = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    out = rank.percentiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", shares)
    return out.select("l_returnflag", *[F.round(n, 6).alias(n) for n in shares])


def d15_capped_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.groupBy(F.least("n", F.lit(10)).alias("bucket")).agg(F.count("*").alias("storylines"))


def d17_categories(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer").where("c_nationkey % 4 <> 0").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("k", F.lit(0)).alias("storylines"))


def d18_catalog(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.min("o_orderkey").alias("first"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "latest", "first", F.coalesce("open", F.lit(0)).alias("open"))


def d20_topology_report(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"))
    size = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").when(F.col("n") <= 20, "6-20").otherwise("21+")
    return c.groupBy("c_mktsegment", size.alias("size")).agg(F.count("*").alias("storylines"), F.sum("n").alias("entries"))


def d20_topology_examples(spark: SparkSession, d: str) -> DataFrame:
    """Of each size class its share, the commonest status of its storylines' entries, and its three largest storylines."""
    o = table(spark, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("size", F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").when(F.col("n") <= 20, "6-20").otherwise("21+"))
    by_status = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("k"))
    own = newest_per_group(by_status, "o_custkey", [F.desc("k"), F.asc("o_orderstatus")], 1).select("o_custkey", F.col("o_orderstatus").alias("status"))
    votes = n.join(own, "o_custkey").groupBy("size", "status").agg(F.count("*").alias("k"))
    major = newest_per_group(votes, "size", [F.desc("k"), F.asc("status")], 1).select("size", F.col("status").alias("majority"))
    top = newest_per_group(n, "size", [F.desc("n"), F.asc("o_custkey")], 3)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "o_custkey"))), lambda x: x["o_custkey"].cast("string")), ",")
    examples = top.groupBy("size").agg(shown.alias("examples"))
    total = n.agg(F.count("*").alias("all"))
    sums = n.groupBy("size").agg(F.count("*").alias("storylines")).crossJoin(F.broadcast(total))  # one row
    return sums.join(major, "size").join(examples, "size").select("size", "storylines", F.round(F.col("storylines") / F.col("all"), 6).alias("share"), "majority", "examples")


def d21_majority_subtype(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return newest_per_group(n, "user_id", [F.desc("n"), F.asc("event_type")], 1)


def d24_source_scores(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("cases"), F.round(1 - 2 * F.count_if(F.col("quality") == 0) / F.count("*"), 6).alias("score"))


def _verdicts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Verdict rows of all seven kinds, as pure functions of the given tables' rows."""
    c, e, lab = table(spark, d, "conversations"), vectors(spark, d), table(spark, d, "labels")
    turn, conv, i = F.col("turn"), F.col("conv_id"), F.col("id")
    links = c.where("turn > 0").select(conv.alias("chain"), turn.alias("position"), F.col("role").alias("method"), ((conv + turn) % 5 != 0).alias("related"))
    verdict = F.when(conv % 7 == 0, "drifted").when(conv % 11 == 0, "should_split").otherwise("coherent")
    chains = c.select("conv_id").distinct().select(conv.alias("chain"), verdict.alias("verdict"), (conv % 13 != 0).alias("endpoints"))
    members = e.select(F.col("label").alias("theme"), (i % 6 != 0).alias("fits"), (i % 10 == 3).alias("planted"))
    grain = e.select("label").distinct().select(F.col("label").alias("theme"), F.when(F.col("label") % 3 == 0, "too_broad").otherwise("right").alias("verdict"))
    category = lab.select(F.when(F.col("quality") == 1, "correct").when(F.col("doc_id") % 3 == 0, "ambiguous").otherwise("better_option_exists").alias("verdict"))
    merge = e.select((i % 97 == 0).alias("should_merge"))
    token = lab.select(F.when(F.col("doc_id") % 4 == 0, "event_key").otherwise("entity").alias("kind"), (F.col("doc_id") % 9 != 0).alias("valid"))
    same = lab.select((F.col("toxic") == 0).alias("same_event"))
    overview = c.where("turn = 0").select((conv % 4 != 0).alias("coverage"), (conv % 6 != 0).alias("faithful"), (conv % 5 != 0).alias("current"), F.lit(True).alias("representative"))
    return {"links": links, "chains": chains, "members": members, "grain": grain, "category": category, "merge": merge, "token": token, "same": same, "overview": overview}


def _scores(spark: SparkSession, d: str) -> DataFrame:
    r = _verdicts(spark, d)
    by_theme = verdicts.theme_scores(r["members"], r["grain"])
    least = by_theme.agg(F.min("cases").alias("least_cases"))
    out = verdicts.chain_scores(r["links"], r["chains"])
    for one in (verdicts.theme_score(by_theme), verdicts.category_score(r["category"]), verdicts.merge_score(r["merge"]), verdicts.token_score(r["token"]),
                verdicts.event_score(r["same"]), verdicts.overview_score(r["overview"]), least):
        out = out.crossJoin(one)  # one row each
    return out


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else c for c, kind in df.dtypes])


def d24_verdict_scores(spark: SparkSession, d: str) -> DataFrame:
    """V1 to V7 with their case counts, in one row."""
    return _rounded(_scores(spark, d))


def d24_theme_scores(spark: SparkSession, d: str) -> DataFrame:
    r = _verdicts(spark, d)
    return _rounded(verdicts.theme_scores(r["members"], r["grain"]))


def d25_reward(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(verdicts.reward(_scores(spark, d)))


def d26_case_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Cases wanted (one document in three) against verdicts (some given twice): missing, unexpected and duplicate keys."""
    lab = table(spark, d, "labels").select("doc_id")
    want, got = table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id"), lab.unionAll(lab.where("doc_id % 20 = 0"))
    one = want.exceptAll(got).select("doc_id", F.lit("missing").alias("kind")).union(got.join(want, "doc_id", "left_anti").distinct().select("doc_id", F.lit("unexpected")))
    return one.union(got.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("duplicate")))


def d28_gold_status(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "labels").select("doc_id", "quality", F.floor(F.col("doc_id") / 50).alias("batch"))
    return w.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("reviewed"))


def d29_label_checks(spark: SparkSession, d: str) -> DataFrame:
    """Labelled turns that break a rule: a field missing, a text under more than one conversation, a text that is no
    longer what was labelled."""
    c = table(spark, d, "conversations").withColumn("label", F.when(F.col("turn") % 6 != 5, F.col("role")))
    key = F.concat_ws("-", "conv_id", "turn")
    fields = c.where("label is null or text is null").select(F.lit("missing_field").alias("rule"), key.alias("child"))
    many = c.groupBy("text").agg(F.count_distinct("conv_id").alias("parents")).where("parents <> 1").select(F.lit("parents").alias("rule"), F.sha2("text", 256).alias("child"))
    was = F.sha2(F.when(F.col("conv_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    drift = c.where(F.sha2("text", 256) != was).select(F.lit("hash_drift").alias("rule"), key.alias("child"))
    return fields.union(many).union(drift)


def d31_card_context(spark: SparkSession, d: str) -> DataFrame:
    c = chain(spark, d)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "ordinal"))), lambda x: x["ordinal"].cast("string")), ",")
    return c.groupBy("storyline").agg(ids.alias("ids"), F.count_if(~F.col("syndicated")).alias("original"), F.count_if("syndicated").alias("syndicated"))


def d34_set_hash(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("h"))
    return o.groupBy("o_custkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("set_hash"))


def d37_dataset_overview(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").where("quality = 1").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return j.agg(F.count("*").alias("reviewed"), F.max("doc_id").alias("newest"), F.count_distinct("source").alias("sources"))


def e7_relative_placements(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("key"))
    order = [F.desc_nulls_last("key"), F.asc("c_custkey")]
    one = rank.ordinals(c, order, "placement", ("c_nationkey",))
    return rank.ordinals(one, order, "in_segment", ("c_mktsegment",)).select("c_custkey", "placement", "in_segment")


def _listing(rows: DataFrame, *, where: dict[str, list] | None = None, least: dict[str, float] | None = None, group: str | None = None, sort: str = "newest") -> DataFrame:
    """Storylines by optional filters, a group as the first sort key, and one of three orders."""
    for c, values in (where or {}).items():
        rows = rows.where(F.col(c).isin(values))
    for c, value in (least or {}).items():
        rows = rows.where(F.col(c) >= value)
    orders = {"newest": [F.desc("newest")], "size": [F.desc("n"), F.desc("newest")], "balance": [F.desc("c_acctbal")]}
    return rows.orderBy(*([F.asc_nulls_last(group)] if group else []), *orders[sort], F.asc("c_custkey"))


def f1_listing(spark: SparkSession, d: str) -> DataFrame:
    """Pages of three listings: filtered and by balance, grouped and by size, all and by time."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))
    c = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"))
    one = _listing(c, where={"c_mktsegment": ["BUILDING"]}, least={"c_acctbal": 0.0}, sort="balance").offset(10).limit(50)
    two = _listing(c, where={"c_nationkey": [1, 2, 3]}, least={"n": 3}, group="c_mktsegment", sort="size").limit(40)
    three = _listing(c).limit(30)
    named = lambda df, name: df.select(F.lit(name).alias("listing"), "c_custkey", "n")
    return named(one, "balance").union(named(two, "size")).union(named(three, "newest"))


def f2_borderline(spark: SparkSession, d: str) -> DataFrame:
    gap = F.abs(F.col("l_extendedprice") - 30000.0)
    return table(spark, d, "lineitem").where(gap < 500).orderBy(gap, "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber")


def f3_top_chains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("o_custkey")).limit(20)


def f3_top_lists(spark: SparkSession, d: str) -> DataFrame:
    """The most mentioned tokens, and the newest headlines of each theme."""
    top = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("user_id")).limit(25)
    newest = newest_per_group(vectors(spark, d), "label", [F.desc("published_at"), F.desc("id")], 5)
    return top.select(F.lit("token").alias("list"), F.col("user_id").alias("key"), F.col("n").alias("value")).union(newest.select(F.lit("headline"), F.col("label").cast("long"), "id"))


def f6_replay_input(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("length(text) >= 100 and doc_id between 100 and 700").orderBy("doc_id").limit(300).select("doc_id")


def f7_grouped_table(spark: SparkSession, d: str) -> DataFrame:
    """Segments with their counts and first five customers: only these leave a task."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("segment"))
    firsts = newest_per_group(c, "segment", [F.asc("c_custkey")], 5).groupBy("segment").agg(F.array_join(F.array_sort(F.collect_list("c_custkey")), ",").alias("firsts"))
    n = c.groupBy("segment").agg(F.count("*").alias("n"))
    g = n.join(firsts.withColumnRenamed("segment", "s"), F.col("segment").eqNullSafe(F.col("s")))
    return g.select("segment", "n", "firsts", F.row_number().over(Window.orderBy(F.asc_nulls_last("segment"))).cast("long").alias("position"))


def f8_worst(spark: SparkSession, d: str) -> DataFrame:
    return d24_source_scores(spark, d).orderBy("score", "source").limit(5)


def f9_facet_filter(spark: SparkSession, d: str) -> DataFrame:
    """Storylines with a chosen agency, category or theme, in three orders, and which one is the top row of each."""
    agencies = similar_agencies(spark, d)
    c = table(spark, d, "customer").join(agencies, F.col("c_custkey") == F.col("storyline"))
    chosen = F.arrays_overlap("agencies", F.array(F.lit("FRANCE"), F.lit("CHINA"))) | F.col("c_mktsegment").isin("BUILDING") | (F.col("c_nationkey") == 3)
    rows = c.where(chosen).select("c_custkey", "c_acctbal", "c_name", F.size("agencies").cast("long").alias("n_agencies"))
    orders = {"balance": [F.desc("c_acctbal"), F.asc("c_custkey")], "name": [F.asc("c_name")], "breadth": [F.desc("n_agencies"), F.asc("c_custkey")]}
    for name, order in orders.items():
        rows = rank.ordinals(rows, order, f"by_{name}")
    return rows.select("c_custkey", "n_agencies", *[f"by_{n}" for n in orders], (F.col("by_balance") == 1).alias("top"))


def similar_agencies(spark: SparkSession, d: str) -> DataFrame:
    return storyline_entries(spark, d).groupBy("storyline").agg(F.array_sort(F.collect_set("agency")).alias("agencies"))


def f10_ranking_page(spark: SparkSession, d: str) -> DataFrame:
    ok = table(spark, d, "customer").where("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    shown = f4_as_of_rank(spark, d).join(ok, "o_custkey", "left_semi")
    return shown.select("o_custkey", F.row_number().over(Window.orderBy("position")).cast("long").alias("place")).orderBy("place").offset(20).limit(20)


def g2_set_equality(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return a.subtract(b).agg(F.count("*").alias("only_left")).crossJoin(b.subtract(a).agg(F.count("*").alias("only_right")))


def g5_distinct_agencies(spark: SparkSession, d: str) -> DataFrame:
    arrays = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    return arrays.select(F.explode("a").alias("agency")).distinct()


def g6_strata(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.where("n <= 5").withColumn("stratum", F.lit("short")).unionByName(n.where("n > 20").withColumn("stratum", F.lit("long")))


def g7_facet_options(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(_as_of(spark, d).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    both = F.array(F.struct(F.lit("segment").alias("facet"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("facet"), F.col("c_nationkey").cast("string").alias("value")))
    return c.select(F.explode(both).alias("o")).select("o.*").distinct()


def g8_fallback_attribute(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    one = c.select("c_custkey", F.col("c_mktsegment").alias("value"))
    two = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("value"))
    return one.union(two).groupBy("c_custkey").agg(F.min_by("value", F.sha2(F.concat("c_custkey", F.lit("|"), "value"), 256)).alias("value"))


def i7_batch_gate(spark: SparkSession, d: str) -> DataFrame:
    s = d28_gold_status(spark, d).withColumn("open", F.col("reviewed") < F.col("n"))
    first = s.where("open").agg(F.min("batch").alias("first_open"))
    return s.crossJoin(F.broadcast(first)).select("batch", (F.col("batch") <= F.coalesce("first_open", "batch")).alias("allowed"))


_ASOF = f"""as_of AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE epoch(o_orderdate) <= {AS_OF_S}) WHERE rn = 1),
ranked AS (SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderdate, o_orderpriority, o_orderkey) AS position FROM as_of)"""
_GOLD = "gold AS (SELECT doc_id // 50 AS batch, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS reviewed FROM labels GROUP BY 1)"
_SCORE = "scores AS (SELECT source, count(*) AS cases, round(1 - 2.0::DOUBLE * count(*) FILTER (WHERE quality = 0) / count(*), 6) AS score FROM labels JOIN documents USING (doc_id) GROUP BY 1)"
_V = f"""{VECTORS}, links AS (SELECT conv_id AS chain, turn AS pos, role AS method, (conv_id + turn) % 5 <> 0 AS ok FROM conversations WHERE turn > 0),
charged AS (SELECT *, ok AND NOT (row_number() OVER (PARTITION BY chain ORDER BY pos DESC) = 1 AND bool_and(ok) OVER (PARTITION BY chain)
  AND (chain % 7 = 0 OR chain % 11 = 0 OR chain % 13 = 0)) AS value FROM links),
mp AS (SELECT method, avg(CAST(ok AS INTEGER)) AS p FROM links GROUP BY 1 ORDER BY p, method LIMIT 1),
t AS (SELECT theme, cases, own, (fits - 2 * (own - fits) - 2 * accepted) * 1.0::DOUBLE / cases - CASE WHEN theme % 3 = 0 THEN 0.25 ELSE 0 END AS score,
  CASE WHEN cases > own THEN coalesce(fits / nullif(own, 0), 0) - accepted / (cases - own) END AS discrimination FROM (
  SELECT label AS theme, count(*) AS cases, count(*) FILTER (WHERE id % 10 <> 3) AS own, count(*) FILTER (WHERE id % 10 <> 3 AND id % 6 <> 0) AS fits, count(*) FILTER (WHERE id % 10 = 3 AND id % 6 <> 0) AS accepted FROM vectors GROUP BY 1)),
v AS (SELECT * FROM (SELECT round((3 * count(*) FILTER (WHERE value) - 2 * count(*)) / count(*), 9) AS v1, count(*) AS v1_n FROM charged),
  (SELECT round(avg(CAST(conv_id % 7 = 0 AS INTEGER)), 9) AS drift_rate FROM (SELECT DISTINCT conv_id FROM conversations)), (SELECT method AS worst_method, round(p, 9) AS worst_precision FROM mp),
  (SELECT round(avg(score), 9) AS v2, count(*) AS v2_themes, CAST(sum(cases) AS BIGINT) AS v2_cases, round(avg(discrimination), 9) AS discrimination, min(cases) AS least_cases FROM t),
  (SELECT round(avg(CAST(quality = 1 OR doc_id % 3 = 0 AS INTEGER)), 9) AS v3, count(*) AS v3_n FROM labels), (SELECT count(*) FILTER (WHERE id % 97 = 0) AS merges, count(*) AS merge_candidates FROM vectors),
  (SELECT round(avg(CAST(doc_id % 9 <> 0 AS INTEGER)) FILTER (WHERE doc_id % 4 <> 0), 9) AS v5, count(*) FILTER (WHERE doc_id % 4 <> 0) AS v5_n, round(avg(CAST(doc_id % 9 <> 0 AS INTEGER)) FILTER (WHERE doc_id % 4 = 0), 9) AS key_validity FROM labels),
  (SELECT round((3 * count(*) FILTER (WHERE toxic = 0) - 2 * count(*)) / count(*), 9) AS v6, count(*) AS v6_n FROM labels),
  (SELECT round((sum(CAST(conv_id % 4 <> 0 AS INTEGER) + CAST(conv_id % 6 <> 0 AS INTEGER) + CAST(conv_id % 5 <> 0 AS INTEGER) + 1) - 2 * count(*) FILTER (WHERE conv_id % 6 = 0)) / (4 * count(*)), 9) AS v7, count(*) AS v7_n FROM conversations WHERE turn = 0))"""
_N = "n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"

QUERIES = {f.__name__: f for f in (
    c19_as_of_card, f4_as_of_rank, c20_as_of_detail, c21_theme_visibility, c1_publisher_attribution, c26_storyline_detail, d1_episode_rollup, d3_theme_rollup,
    d12_corpus_summary, d13_volume, d13_attach_mix, d13_syndication, d14_percentiles, d15_capped_histogram, d17_categories, d18_catalog, d20_topology_report, d20_topology_examples, d21_majority_subtype, d24_source_scores, d24_verdict_scores, d24_theme_scores, d25_reward,
    d26_case_coverage, d28_gold_status, d29_label_checks, d31_card_context, d34_set_hash, d37_dataset_overview, e7_relative_placements, f1_listing, f2_borderline,
    f3_top_chains, f3_top_lists, f6_replay_input, f7_grouped_table, f8_worst, f9_facet_filter, f10_ranking_page, g2_set_equality, g5_distinct_agencies, g6_strata, g7_facet_options,
    g8_fallback_attribute, i7_batch_gate)}
SQL = {
    "c19_as_of_card": f"WITH {_ASOF} SELECT o_custkey, o_orderkey FROM as_of",
    "f4_as_of_rank": f"WITH {_ASOF} SELECT * FROM ranked WHERE position <= 200",
    "c20_as_of_detail": f"""WITH {CHAIN}, e AS (SELECT storyline, ordinal // 2 AS episode, count(*) AS entries, count(*) FILTER (WHERE NOT syndicated) AS originals, max(ordinal) AS last FROM chain WHERE epoch(ts) <= 1704326400 GROUP BY 1, 2)
SELECT storyline, count(*) AS episodes, CAST(sum(entries) AS BIGINT) AS entries, max(last) AS last_turn FROM e WHERE originals > 0 GROUP BY 1""",
    "c21_theme_visibility": f"WITH {VECTORS} SELECT label, count(*) AS n, count(*) >= CASE WHEN label = 0 THEN 1 ELSE 4 END AND max(epoch(published_at)) >= 1704672000 - 172800 AS visible FROM vectors WHERE epoch(published_at) <= 1704672000 GROUP BY 1",
    "c1_publisher_attribution": "SELECT s_nationkey, count(*) AS n, count(*) FILTER (WHERE s_suppkey IS NULL) AS missing FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) ON l_suppkey = s_suppkey GROUP BY 1",
    "c26_storyline_detail": "WITH l AS (SELECT l_orderkey, count(*) AS n, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS f FROM lineitem GROUP BY 1) SELECT o_custkey, string_agg(o_orderkey || ':' || n || ':' || f, ';' ORDER BY o_orderkey) AS episodes FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1",
    "d1_episode_rollup": f"WITH {CHAIN} SELECT storyline, count(*) AS n, CAST(epoch(min(ts)) AS BIGINT) AS first_s, CAST(epoch(max(ts)) AS BIGINT) AS last_s, array_to_string(list_sort(list_distinct(flatten(list(regexp_split_to_array(lower(text), '[^a-z]+')))))[1:128], ' ') AS words FROM chain GROUP BY 1",
    "d3_theme_rollup": f"WITH {VECTORS} SELECT label, count(*) AS n, CAST(epoch(min(published_at)) AS BIGINT) AS first_s, CAST(epoch(max(published_at)) AS BIGINT) AS newest_s FROM vectors GROUP BY 1",
    "d12_corpus_summary": "SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) < 200) AS short, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "d13_volume": "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS BIGINT) AS mean_cents FROM orders GROUP BY 1, 2",
    "d13_attach_mix": f"""WITH {NEAR}, m AS (SELECT CASE WHEN sim IS NULL THEN 'new' WHEN sim >= 0.35 THEN 'near_duplicate' ELSE 'candidate' END AS method, sim FROM vectors v LEFT JOIN best b ON v.id = b.id), {CHAIN}
SELECT 'entries' AS level, method, count(*) AS n, round(avg(sim), 6) AS similarity FROM m GROUP BY 2
UNION ALL SELECT 'storylines', CASE WHEN ordinal = 0 THEN 'first' WHEN syndicated THEN 'syndicated' ELSE 'original' END, count(*), NULL FROM chain GROUP BY 2""",
    "d13_syndication": f"WITH {CHAIN} SELECT round(avg(CAST(syndicated AS INTEGER)), 6) AS syndication_rate, count(*) AS turns FROM chain",
    "d14_percentiles": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for q, n in ((0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"))) + " FROM lineitem GROUP BY 1",
    "d15_capped_histogram": f"WITH {_N} SELECT least(n, 10) AS bucket, count(*) AS storylines FROM n GROUP BY 1",
    "d17_categories": "SELECT n_name, count(c_custkey) AS storylines FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey % 4 <> 0) ON n_nationkey = c_nationkey GROUP BY 1",
    "d18_catalog": "SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, min(o_orderkey) AS first, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "d20_topology_report": f"WITH {_N} SELECT c_mktsegment, CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS size, count(*) AS storylines, CAST(sum(n) AS BIGINT) AS entries FROM customer JOIN n ON c_custkey = o_custkey GROUP BY 1, 2",
    "d20_topology_examples": f"""WITH {_N}, s AS (SELECT *, CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS size FROM n),
own AS (SELECT o_custkey, o_orderstatus AS status FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) = 1),
major AS (SELECT size, status FROM s JOIN own USING (o_custkey) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY size ORDER BY count(*) DESC, status) = 1),
top AS (SELECT size, o_custkey, n FROM s QUALIFY row_number() OVER (PARTITION BY size ORDER BY n DESC, o_custkey) <= 3),
ex AS (SELECT size, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY n DESC, o_custkey) AS examples FROM top GROUP BY 1)
SELECT size, storylines, round(storylines / (SELECT count(*) FROM n), 6) AS share, status AS majority, examples FROM (SELECT size, count(*) AS storylines FROM s GROUP BY 1) JOIN major USING (size) JOIN ex USING (size)""",
    "d21_majority_subtype": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1",
    "d24_source_scores": f"WITH {_SCORE} SELECT * FROM scores",
    "d24_verdict_scores": f"WITH {_V} SELECT * FROM v",
    "d24_theme_scores": f"WITH {_V} SELECT theme, cases, own, round(score, 9) AS score, round(discrimination, 9) AS discrimination FROM t",
    "d25_reward": f"""WITH {_V} SELECT round((v1 + v2 + v3 + v5 + v6 + v7) / 6 - 0.02 * merges, 9) AS reward, round(3 / v1_n / 6, 9) AS flip_v1, round(greatest(3 / least_cases / v2_themes / 6, 0.25 / v2_themes / 6), 9) AS flip_v2,
  round(1 / v3_n / 6, 9) AS flip_v3, round(1 / v5_n / 6, 9) AS flip_v5, round(3 / v6_n / 6, 9) AS flip_v6, round(3 / (v7_n * 4) / 6, 9) AS flip_v7 FROM v""",
    "d26_case_coverage": """SELECT doc_id, 'missing' AS kind FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'duplicate' FROM labels WHERE doc_id % 20 = 0""",
    "d28_gold_status": f"WITH {_GOLD} SELECT * FROM gold",
    "d29_label_checks": """SELECT 'missing_field' AS rule, conv_id || '-' || turn AS child FROM conversations WHERE turn % 6 = 5 OR text IS NULL
UNION ALL SELECT 'parents', sha256(text) FROM conversations GROUP BY text HAVING count(DISTINCT conv_id) <> 1
UNION ALL SELECT 'hash_drift', conv_id || '-' || turn FROM conversations WHERE conv_id % 9 = 0""",
    "d31_card_context": f"WITH {CHAIN} SELECT storyline, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ts, ordinal) AS ids, count(*) FILTER (WHERE NOT syndicated) AS original, count(*) FILTER (WHERE syndicated) AS syndicated FROM chain GROUP BY 1",
    "d34_set_hash": "SELECT o_custkey, sha256(string_agg(h, '' ORDER BY h)) AS set_hash FROM (SELECT o_custkey, sha256(o_orderkey || '|' || o_orderstatus) AS h FROM orders) GROUP BY 1",
    "d37_dataset_overview": "SELECT count(*) AS reviewed, max(doc_id) AS newest, count(DISTINCT source) AS sources FROM labels JOIN documents USING (doc_id) WHERE quality = 1",
    "e7_relative_placements": "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS placement, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS in_segment FROM customer",
    "f1_listing": """WITH l AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey, count(*) AS n, max(o_orderdate) AS newest FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT 'balance' AS listing, c_custkey, n FROM (SELECT * FROM l WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 10)
UNION ALL SELECT 'size', c_custkey, n FROM (SELECT * FROM l WHERE c_nationkey IN (1, 2, 3) AND n >= 3 ORDER BY c_mktsegment, n DESC, newest DESC, c_custkey LIMIT 40)
UNION ALL SELECT 'newest', c_custkey, n FROM (SELECT * FROM l ORDER BY newest DESC, c_custkey LIMIT 30)""",
    "f2_borderline": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice - 30000.0) < 500 ORDER BY abs(l_extendedprice - 30000.0), l_orderkey, l_linenumber LIMIT 100",
    "f3_top_chains": f"WITH {_N} SELECT * FROM n ORDER BY n DESC, o_custkey LIMIT 20",
    "f3_top_lists": f"""WITH {VECTORS}, t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 25)
SELECT 'token' AS list, user_id AS key, n AS value FROM t UNION ALL SELECT 'headline', CAST(label AS BIGINT), id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY published_at DESC, id DESC) AS rn FROM vectors) WHERE rn <= 5""",
    "f6_replay_input": "SELECT doc_id FROM documents WHERE length(text) >= 100 AND doc_id BETWEEN 100 AND 700 ORDER BY doc_id LIMIT 300",
    "f7_grouped_table": "SELECT segment, n, firsts, row_number() OVER (ORDER BY segment ASC NULLS LAST) AS position FROM (SELECT CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS segment, count(*) AS n, array_to_string(list_sort(list(c_custkey))[1:5], ',') AS firsts FROM customer GROUP BY 1)",
    "f8_worst": f"WITH {_SCORE} SELECT * FROM scores ORDER BY score, source LIMIT 5",
    "f9_facet_filter": f"""WITH {STORYLINE_ENTRIES}, a AS (SELECT storyline, list(DISTINCT agency) AS agencies FROM storyline_entries GROUP BY 1),
r AS (SELECT c_custkey, c_acctbal, c_name, len(agencies) AS n_agencies FROM customer JOIN a ON c_custkey = storyline WHERE list_has_any(agencies, ['FRANCE', 'CHINA']) OR c_mktsegment = 'BUILDING' OR c_nationkey = 3),
o AS (SELECT c_custkey, n_agencies, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS by_balance, row_number() OVER (ORDER BY c_name) AS by_name, row_number() OVER (ORDER BY n_agencies DESC, c_custkey) AS by_breadth FROM r)
SELECT *, by_balance = 1 AS top FROM o""",
    "f10_ranking_page": f"WITH {_ASOF} SELECT o_custkey, row_number() OVER (ORDER BY position) AS place FROM ranked JOIN customer ON c_custkey = o_custkey WHERE position <= 200 AND c_mktsegment <> 'FURNITURE' QUALIFY row_number() OVER (ORDER BY position) BETWEEN 21 AND 40",
    "g2_set_equality": "WITH b AS (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT o_orderkey FROM orders)) AS only_right",
    "g5_distinct_agencies": "SELECT DISTINCT event_type AS agency FROM events",
    "g6_strata": f"WITH {_N} SELECT *, 'short' AS stratum FROM n WHERE n <= 5 UNION ALL SELECT *, 'long' FROM n WHERE n > 20",
    "g7_facet_options": f"WITH {_ASOF}, v AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM as_of)) SELECT DISTINCT 'segment' AS facet, c_mktsegment AS value FROM v UNION SELECT 'nation', CAST(c_nationkey AS VARCHAR) FROM v",
    "g8_fallback_attribute": "SELECT c_custkey, arg_min(value, sha256(c_custkey || '|' || value)) AS value FROM (SELECT c_custkey, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1",
    "i7_batch_gate": f"WITH {_GOLD} SELECT batch, batch <= coalesce((SELECT min(batch) FROM gold WHERE reviewed < n), batch) AS allowed FROM gold",
}
