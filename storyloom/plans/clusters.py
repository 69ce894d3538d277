"""Candidate, theme, curation and label-promotion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.operators import rank, similar, themes, windows
from storyloom.operators.components import connected_components
from storyloom.operators.scratch import kept
from storyloom.plans import ranking, similarity
from storyloom.plans.event_time import HASH, c4_window_duplicate, e6_card_versions
from storyloom.plans.event_time import SQL as EVENT_SQL
from storyloom.plans.roles import ENTRIES, VECTORS, chain, entries, table, vectors
from storyloom.plans.similarity import CENT, COS, NEAR, TOK
from storyloom.plans.texts import ENTITY_SETS, KEY_SETS, MOST_KEYS, b27_lexical_category, keyed_text
from storyloom.plans.texts import SQL as TEXT_SQL


def c6_centroid_candidates(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    groups = similar.centroids(v.withColumn("episode", F.floor(F.col("id") / 25)), "episode")
    out = similar.nearest_groups(v, groups, "episode", least=0.1, k=3)
    return out.select("id", "episode", F.round("sim", 6).alias("sim"), "rank")


def c7_member_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Best cosine of each query to the members of each storyline, from a floor on."""
    v = vectors(spark, d)
    best = similar.best_in_groups(v.where("id % 50 = 0"), v, "label", 0.2).select("q", "label", F.round("sim", 6).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "label")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")


def c10_candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by event key (a title seen before, which the first entry with it stands for), then by shared words, of
    all entries, copies too; the best three of each."""
    e = entries(spark, d).select("id", "title", F.size(text.title_tokens(F.col("title"), 6)).cast("long").alias("n"))
    first = e.groupBy("title").agg(F.min("id").alias("a"))
    # equal titles share all of their words
    one = e.join(first, "title").where("a < id").select("a", F.col("id").alias("b"), F.lit(0).alias("priority"), F.greatest("n", F.lit(1).cast("long")).alias("shared"))
    words = kept(similarity.title_words(spark, d))
    even = words.select("token").distinct().withColumn("weight", F.lit(0.0))
    two = similar.top_sharing(words, even, 3, least=2).select(F.col("b").alias("a"), F.col("id").alias("b"), F.lit(1).alias("priority"), "shared")
    best = one.union(two).groupBy("a", "b").agg(F.min("priority").cast("long").alias("priority"), F.max("shared").alias("shared"))
    w = Window.partitionBy("b").orderBy("priority", F.desc("shared"), "a")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3")


def c11_candidate_facts(spark: SparkSession, d: str) -> DataFrame:
    """Of each candidate pair, copies too: shared words, the gap in hours and days, and the similarity of the titles' words."""
    words = kept(similarity.title_words(spark, d).distinct())
    known = words.groupBy("id").agg(F.count("*").alias("n")).join(entries(spark, d).select("id", F.unix_seconds("published_at").alias("s")), "id")
    p = similar.sharing_pairs(words, 2, carry=known, words=True)
    gap = (F.col("sb") - F.col("sa")) / 3600.0
    union = F.col("na") + F.col("nb") - F.col("shared")
    return p.select("a", "b", "shared", "words", F.round(gap, 6).alias("gap_hours"), F.floor(gap / 24).alias("gap_days"), F.round(F.col("shared") / union, 6).alias("similarity"))


#: Holders that a key of each index may have at most.
MOST_HOLDERS = {"title": 80, "term": 70, "rare_title": 80, "entity": 80, "event_key": 100}
#: Words of which an entry selects, and the most holders that a selected one may have.
SELECTED, SELECTED_HOLDERS = 12, 70


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, words): words of whole texts, with repeats; one row for each id."""
    words = F.filter(F.split(F.lower("body"), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    e = entries(spark, d)
    rows = e.select("id", words.alias("words"))
    if e.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows  # as a rule: no text is shuffled
    return rows.groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"))


def _holders(texts: DataFrame) -> DataFrame:
    """(token, df) of texts (id, words)."""
    return texts.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def _indexes(spark: SparkSession, d: str, texts: DataFrame, holders: DataFrame) -> dict[str, tuple[DataFrame, int]]:
    e = keyed_text(entries(spark, d))
    title = e.where("title <> ''").select("id", F.sha2(text.squeeze(F.col("title")), 256).alias("token"))
    held = texts.select("id", F.explode(F.array_distinct("words")).alias("token"))
    df = holders.select("token", F.col("df").alias("n")).where(F.col("n").between(2, SELECTED_HOLDERS))
    w = Window.partitionBy("id").orderBy("n", "token")
    terms = held.join(df, "token").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SELECTED).select("id", "token")
    exploded = lambda column: e.select("id", F.explode(column).alias("token"))
    made = {
        "title": title, "term": terms, "rare_title": exploded(text.title_tokens(F.col("title"))),
        "entity": exploded(text.entities(F.col("title"), F.col("summary"), F.col("body"))), "event_key": exploded(text.event_keys(F.col("keyed"), MOST_KEYS)),
    }
    return {kind: (rows, MOST_HOLDERS[kind]) for kind, rows in made.items()}


def c12_blocked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of five indexes, and how many keys of each they share."""
    texts = _texts(spark, d)
    return similar.blocked_pairs(_indexes(spark, d, texts, _holders(texts)))


#: Titles that a publisher repeats with other content, and publishers that do so a lot: parameters of the evidence rules.
TEMPLATE = "(?i)licen[sc]ed under|version [0-9]"
TEMPLATE_SOURCES = ("source_3", "source_7")


def c13_edge_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Story and episode edges among the candidates of C12, by the strict and the balanced rules.

    Evidence: TF-IDF cosines of titles and contents, shared keys and titles, categories, gaps. A pair is a story edge by
    a shared event key, or inside one category by an equal title or by similarity; an episode edge besides by the gap.
    """
    n = entries(spark, d).count()
    words = entries(spark, d).select("id", F.explode(F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)).alias("token"))
    e = entries(spark, d).join(b27_lexical_category(spark, d).select("id", "category"), "id").select(
        "id", F.col("source").isin(*TEMPLATE_SOURCES).alias("source"), "category", F.unix_seconds("published_at").alias("s"), text.content_hash(F.col("title"), F.col("summary")).alias("h"), F.col("title").rlike(TEMPLATE).alias("template"))
    e, kinds = kept(e), list(MOST_HOLDERS)
    numbered = lambda df: kept(df.withColumn("code", F.monotonically_increasing_id()))
    texts = _texts(spark, d)
    content_df = numbered(_holders(texts))
    sets = similar.key_sets(_indexes(spark, d, texts, content_df))
    # each rule asks for a shared event key or title, or two rare words of the titles: no other pair is made
    p = similar.deciding_pairs(sets, kinds, {"event_key": 1, "title": 1, "rare_title": 2})
    c = F.col
    for to in ("a", "b"):
        p = p.join(e.select(F.col("id").alias(to), *[F.col(x).alias(f"{x}_{to}") for x in ("source", "category", "s", "h", "template")]), to)
    p = p.select(
        "key", "a", "b", "by_event_key", "by_title", "by_rare_title", (~(c("template_a") | c("template_b"))).alias("plain"), (c("source_a") | c("source_b")).alias("sources"),
        (c("category_a") == c("category_b")).alias("alike"), (F.abs(c("s_b") - c("s_a")) / 3600).alias("gap"), (c("h_a") == c("h_b")).alias("same"))
    # fixed values: the cosines, counts and gaps below
    plain, sources, alike, gap = c("plain"), c("sources"), c("alike"), c("gap")
    known = (c("by_event_key") > 0) | (alike & (c("by_title") > 0) & plain)
    p = p.where(known | (alike & plain & (c("by_rare_title") >= 2)))
    p = kept(similar.with_shared_keys(p, sets, kinds, ("term", "entity")))
    in_pairs = lambda rows: rows.join(p.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    title_df = numbered(words.distinct().groupBy("token").agg(F.count("*").alias("df")))
    p = kept(similar.pair_cosines(p, similar.tf_idf(in_pairs(words), n, most=3, df=title_df), "title_cosine"))
    entity = (c("by_rare_title") >= 2) & (c("by_entity") >= 1)
    p = kept(p.where(known | (c("title_cosine") >= 0.77) | entity))
    content = in_pairs(texts).select("id", F.explode("words").alias("token"))
    p = similar.pair_cosines(p, similar.tf_idf(content, n, most=4, df=content_df), "content_cosine")
    strict_join = plain & (c("title_cosine") >= 0.84) & (c("by_rare_title") >= 3)
    loose_join = plain & (((c("title_cosine") >= 0.77) & (c("by_rare_title") >= 2)) | ((c("content_cosine") >= 0.82) & (c("by_rare_title") >= 2) & (c("by_entity") >= 1)))
    strict = known | (alike & strict_join)
    balanced = known | (alike & F.when(sources, strict_join).otherwise(loose_join))
    near = (c("by_event_key") > 0) | (c("by_title") > 0) | ((c("content_cosine") >= 0.72) & ((c("by_rare_title") + c("by_entity") >= 1) | (c("by_term") >= 2)))
    episode = (c("same") & (gap <= 72)) | ((gap <= 4) & near)
    out = p.select("a", "b", "title_cosine", "content_cosine", strict.alias("strict"), balanced.alias("balanced"), (balanced & episode).alias("episode"))
    return out.where("strict or balanced")


def c17_merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Themes: labels with their centroids, and the name of the part of the same key."""
    names = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("name"))
    c = similar.centroids(vectors(spark, d), "label").select(F.col("label").cast("long").alias("id"), F.col("centroid").alias("embedding"))
    return similar.merge_candidates(c.join(names, "id"), 0.1).select("a", "b", F.round("cosine", 6).alias("cosine"), "shared")


def c18_intruders(spark: SparkSession, d: str) -> DataFrame:
    """Rows outside a theme: the nearest, then others by a seeded hash."""
    out = similar.intruders(vectors(spark, d), "label", 5, "seed:")
    return out.select("theme", "id", "near", F.col("rank").cast("long").alias("rank"))


def c24_training_pairs(spark: SparkSession, d: str) -> DataFrame:
    keys = kept(ranking._keys(spark, d))
    pairs = ranking._verdicts(keys).where("not inconsistent")
    side = lambda c: keys.select(F.col("storyline").alias(c), F.coalesce("rubric", F.lit(4.0)).alias("r" + c), F.col("rank_key").alias("k" + c))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    return j.select("a", "b", (F.col("winner") == F.col("a")).alias("won"), (F.col("ra") - F.col("rb")).alias("delta"), F.round(F.col("ka") - F.col("kb") - (F.col("ra") - F.col("rb")), 6).alias("offset"))


def h12_preference_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weight of the rubric's difference that explains the verdicts best beside the other terms."""
    pairs = kept(c24_training_pairs(spark, d))
    w = rank.preference_weights(pairs, ["delta"])
    return pairs.agg(F.count("*").alias("pairs"), F.lit(w[0]).alias("weight"))


def h10_topology_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label rows of each entry from its component; entries without an edge are singletons."""
    c = similarity.h1_components(spark, d)
    n = c.groupBy("component").agg(F.count("*").alias("size"))
    return entries(spark, d).select("id").join(c, "id", "left").join(n, "component", "left").select("id", F.coalesce("component", "id").alias("storyline"), F.coalesce("size", F.lit(1)).alias("size"))


def c30_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Sources all of whose documents at a cut-off are reviewed with an unchanged hash: the corpus as it was, in which one
    text in seven was another, is what the reviewers saw."""
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "labels").select("doc_id", "quality")
    seen = F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" rev"))).otherwise(F.col("text")), 256)
    j = docs.join(labels, "doc_id", "left").withColumn("ok", F.coalesce((F.col("quality") == 1) & (F.sha2("text", 256) == seen), F.lit(False)))
    return j.groupBy("source").agg(F.every("ok").alias("covered"), F.count_if("ok").alias("reviewed"), F.count("*").alias("n"))


def c28_rank_detail(spark: SparkSession, d: str) -> DataFrame:
    """A ranked row with its experiment and version, its position's opinion, and its three neighbours on each side."""
    r = kept(ranking._by_theme(ranking._keys(spark, d)))
    rows = rank.neighbours(r, ["facet_key"], 3, "storyline")
    cards = c6_versions(spark, d)
    opinion = themes.run_opinion(_crossings(ranking._neighbours(r))).select(F.col("target").alias("storyline"), "run", "bounded")
    j = rows.join(cards, "storyline", "left").join(opinion, "storyline", "left")
    return j.select("storyline", F.lit("exp-1").alias("experiment"), "version", "run", "bounded",
                    F.array_join(F.transform("near", lambda x: x["storyline"].cast("string")), ",").alias("neighbours"))


def c6_versions(spark: SparkSession, d: str) -> DataFrame:
    """The latest card version of each storyline."""
    return e6_card_versions(spark, d).groupBy(F.col("o_custkey").alias("storyline")).agg(F.max("version").alias("version"))


def c29_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Runs recorded for each storyline's cards, from contexts and entries, looked up in two run ledgers; ambiguous if
    more than one is known there."""
    o = table(spark, d, "orders")
    runs = o.select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("run")).union(o.select("o_custkey", F.when(F.col("o_orderstatus") == "F", "1").otherwise("2"))).distinct()
    ledgers = table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("run"), (F.substring("o_orderpriority", 1, 1) != "3").alias("finished"))
    one = ledgers.where("run <> '5'").groupBy("run").agg(F.first("finished").alias("finished"))
    two = ledgers.where("run = '5' or run = '1'").groupBy("run").agg(F.count("*").alias("cards"))
    j = runs.join(one, "run", "left").join(two, "run", "left")
    known = F.col("finished").isNotNull() | F.col("cards").isNotNull()
    return j.groupBy("o_custkey").agg(F.count("*").alias("runs"), F.count_if(known).alias("known"), F.count_if(F.coalesce("finished", F.lit(False))).alias("finished")).withColumn("ambiguous", F.col("known") > 1)


def d11_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """A linked run: storylines, their sizes, how entries came to theirs, and its themes."""
    linked = h3_linked_storylines(spark, d)
    n = linked.groupBy("storyline").agg(F.count("*").alias("n"))
    chains = n.agg(F.count("*").alias("storylines"), F.sum("n").alias("entries"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))
    mix = linked.agg(*[F.count_if(F.col("method") == m).alias(f"by_{m}") for m in METHODS], F.round(F.avg((F.col("method") == "new").cast("double")), 6).alias("new_share"))
    groups = vectors(spark, d).groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("themes"), F.max("n").alias("largest_theme"))
    return chains.crossJoin(mix).crossJoin(groups)  # one row each


def d23_b_cubed(spark: SparkSession, d: str) -> DataFrame:
    return similarity.d22_cluster_scores(spark, d).select("b3_precision", "b3_recall", "b3_f1")


def d30_label_set_checks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    real = o.groupBy("o_custkey").agg(F.count("*").alias("actual"))
    said = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 12 + 4).alias("declared"))
    return said.join(real, "o_custkey", "left").where(~F.col("declared").eqNullSafe(F.coalesce("actual", F.lit(0)))).select("o_custkey", "declared", F.coalesce("actual", F.lit(0)).alias("actual"))


def d36_article_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("id", "source", F.sha2("title", 256).alias("now"), F.sha2(F.when(F.col("id") % 6 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), 256).alias("was"))
    return e.groupBy("source").agg(F.count_if(F.col("now") == F.col("was")).alias("current"), F.count_if(F.col("now") != F.col("was")).alias("stale"))


def _crossings(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("target"), F.lit("below").alias("side"), "step", ((F.col("a") + F.col("b")) % 3 != 0).alias("crosses"))


def e11_position_opinion(spark: SparkSession, d: str) -> DataFrame:
    return themes.run_opinion(_crossings(ranking.c23_neighbour_pairs(spark, d)))


def _theme_members(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    labels = connected_components(themes.theme_links(v, "label", 0.2))
    return labels.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(v, "id")


def h5_gated_themes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors are random: at the reference's cosine of 0.60 there are no edges, so 0.2 and a cohesion of 0.1 stand in."""
    return themes.gated_themes(_theme_members(spark, d), least_members=4, least_days=3, least_cohesion=0.1)


def h4_average_linkage(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return themes.average_linkage(v.select("id", "embedding"), themes.theme_edges(v, "label", 0.4), 0.4)


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return similarity.g4_member_overlap(spark, d).select("l", "r", F.col("jaccard").alias("score"))


def h6_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return themes.greedy_matches(_overlaps(spark, d))


def _outcome(spark: SparkSession, d: str) -> DataFrame:
    o = _overlaps(spark, d)
    clusters = o.select(F.col("l").alias("cluster")).distinct().withColumn("failed", F.col("cluster") == 9)
    return themes.sweep_outcome(clusters, o.select(F.col("r").alias("theme")).distinct().withColumn("manual", F.col("theme") == 6), h6_reconciliation(spark, d))


def h7_sweep_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _outcome(spark, d)


def h7_sweep_assignments(spark: SparkSession, d: str) -> DataFrame:
    """The theme of each vector after the sweep."""
    return themes.assignments(vectors(spark, d).select("id", F.col("label").cast("long").alias("cluster")), _outcome(spark, d))


TARGETS = {"short": 60, "long": 60}


def h11_curation(spark: SparkSession, d: str) -> DataFrame:
    """Whole storylines without open orders by seeded hash order until two strata are full, and single ones for a third."""
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("size"), F.every(F.col("o_orderstatus") != "P").alias("ok"))
    ok = g.where("ok")
    grouped = ok.where("size > 1").withColumn("stratum", F.when(F.col("size") <= 8, "short").otherwise("long"))
    taken = themes.skip_fill(grouped, TARGETS, "s1")
    fill = themes.fill_with_singletons(taken, ok.where("size = 1"), sum(TARGETS.values()) + 10, "s1")
    return taken.select("stratum", "key").union(fill.select(F.lit("single"), "key"))


METHODS = ("duplicate", "near_duplicate", "shared_words", "new")


def h3_linked_storylines(spark: SparkSession, d: str) -> DataFrame:
    """Each entry's storyline and how it came there: the best of its edges to earlier entries.

    Edges: the same content within 72 hours, the nearest earlier vector within 72 hours, then titles that share words,
    of which the verdict (three or more) accepts. Storylines are the components.
    """
    dup = c4_window_duplicate(spark, d).where("duplicate_of is not null").select(F.col("duplicate_of").alias("a"), F.col("id").alias("b"), F.lit(0).alias("m"))
    ids = entries(spark, d).select("id")
    v = vectors(spark, d).join(ids, "id", "left_semi")  # entries with a vector
    near = similar.near_in_window(v, hours=72, least=0.35).select(F.col("match").alias("a"), F.col("id").alias("b"), F.lit(1).alias("m"))
    words = similar.overlap_edges(similarity.title_words(spark, d), 3).select("a", "b", F.lit(2).alias("m"))
    edges = kept(dup.union(near).union(words))
    labels = connected_components(edges)
    best = edges.groupBy(F.col("b").alias("id")).agg(F.min("m").alias("m"))
    j = ids.join(labels.withColumnRenamed("node", "id"), "id", "left").join(best, "id", "left")
    method = F.element_at(F.array(*map(F.lit, METHODS)), F.coalesce("m", F.lit(3)) + 1)
    return j.select("id", F.coalesce("component", "id").alias("storyline"), method.alias("method"))


def h3_storyline_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Of each linked storyline: entries, sources, first and last time, its first entry's title."""
    j = h3_linked_storylines(spark, d).join(entries(spark, d), "id")
    return j.groupBy("storyline").agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min(F.unix_seconds("published_at")).alias("first_s"),
        F.max(F.unix_seconds("published_at")).alias("last_s"), F.sha2(F.min_by("title", F.struct("published_at", "id")), 256).alias("title_sha"))


def i5_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed labels are proposed, approved by a second reviewer (not every one), and promoted to the gold set, which
    mirrors documents. Nothing is promoted of a batch with a violation; a document that is gone makes an orphan."""
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents").where("doc_id % 7 <> 0").select("doc_id")
    proposed = labels.where("quality = 1").withColumn("batch", F.floor(F.col("doc_id") / 50)).withColumn("approved", F.col("doc_id") % 8 != 0)
    broken = ~F.coalesce(F.col("toxic").isin(0, 1) & (F.col("doc_id") % 101 != 0), F.lit(False))
    open_batches = proposed.where(broken).select("batch").distinct().withColumn("refused", F.lit(True))
    j = proposed.join(docs.withColumn("there", F.lit(True)), "doc_id", "left").join(open_batches, "batch", "left")
    state = F.when(F.col("there").isNull(), "orphan").when(F.coalesce("refused", F.lit(False)), "refused").when(~F.col("approved"), "proposed").otherwise("promoted")
    return j.select("doc_id", state.alias("state"))


def i6_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of labelled entries: storylines, open or dormant at a cut-off, with their headline and card text."""
    c = chain(spark, d)
    cut = F.timestamp_seconds(F.lit(1704412800))
    return c.groupBy("storyline").agg(
        F.count("*").alias("n"), F.when(F.max("ts") < cut, "dormant").otherwise("open").alias("state"), F.min_by("ordinal", F.struct("syndicated", "ts", "ordinal")).alias("headline"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " / "), 256).alias("card_sha"))


def i6_rebuilt_themes(spark: SparkSession, d: str) -> DataFrame:
    """Themes of labelled vectors: members, first and newest time, cohesion to the rebuilt centroid, and that centroid."""
    v = vectors(spark, d)
    sums = similar.to_centroid(v, "label").groupBy("label").agg(
        F.count("*").alias("n"), F.min(F.unix_seconds("published_at")).alias("first_s"), F.max(F.unix_seconds("published_at")).alias("newest_s"), F.round(F.avg("sim"), 6).alias("cohesion"))
    first = similar.centroids(v, "label").select("label", F.round(F.element_at("centroid", 1), 6).alias("x0"), F.round(F.aggregate("centroid", F.lit(0.0), lambda t, x: t + x), 6).alias("x_sum"))
    return sums.join(first, "label")


def i9_rank_receipts(spark: SparkSession, d: str) -> DataFrame:
    k = ranking.b35_rank_key(spark, d).withColumn("stored", F.col("rank_key") + F.when(F.col("storyline") % 10 == 0, 0.01).otherwise(0.0))
    status = F.when(F.abs(F.col("stored") - F.col("rank_key")) <= 1e-6, "exact").otherwise("mismatch")
    return k.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def i8_active_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Experiments are built, checked, and the newest one that passes becomes active; its rows are the active view. Of
    three built here, the newest has a gap in its positions and must not be taken."""
    rows = kept(ranking.e5_experiment_positions(spark, d).select("storyline", "global_position"))
    gap = F.when(F.col("global_position") > 10, F.col("global_position") + 1).otherwise(F.col("global_position"))
    built = rows.select(F.lit(1).alias("experiment"), "*").where("storyline % 2 = 0").union(rows.select(F.lit(2), "*")).union(rows.select(F.lit(3), "storyline", gap))
    checks = built.groupBy("experiment").agg(((F.min("global_position") == 1) & (F.max("global_position") == F.count("*")) & (F.count_distinct("global_position") == F.count("*"))).alias("ok"))
    pointer = checks.where("ok").agg(F.max("experiment").alias("experiment"))
    return built.join(F.broadcast(pointer), "experiment").select("experiment", "storyline", "global_position")  # one row


def i11_clear_features(spark: SparkSession, d: str) -> DataFrame:
    """Features made from summaries that aren't prose are cleared, and proposals that rest on them are open again."""
    e = entries(spark, d)
    valid = text.is_valid_enrichment(F.col("summary"), ("cookie", "javascript"))
    proposal = F.when(F.col("id") % 4 == 0, "approved").otherwise("none")
    return e.select("id", F.when(valid, F.length("summary")).cast("long").alias("chars"), F.when(~valid & (proposal == "approved"), "open").otherwise(proposal).alias("proposal"))


def j1_stub_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The model's seam with its deterministic defaults, for pairs of classes of equal titles: same event if three long
    words are shared; membership if any is; which ranks higher, by entries, sources and title."""
    classes = kept(similarity.word_classes(spark, d))
    sizes = classes.select("id", "class").join(entries(spark, d).select("id", "source", "title"), "id").groupBy("class").agg(
        F.count_distinct("source").alias("sources"), F.count("*").alias("n"), F.min("title").alias("title"))
    # a class's place among all, by what decides: pairs carry a number and not titles, which may be whole texts
    placed = kept(sizes).orderBy(F.desc("sources"), F.desc("n"), "title", "class").select(F.col("class").alias("id"), F.monotonically_increasing_id().alias("place"))
    p = similar.sharing_pairs(similar.class_tokens(classes), 1, carry=kept(placed))
    higher = F.when(F.col("placea") < F.col("placeb"), "a").otherwise("b")
    return p.select("a", "b", (F.col("shared") >= 3).alias("same_event"), (F.col("shared") >= 1).alias("member"), higher.alias("prefers"))


def j1_stub_themes(spark: SparkSession, d: str) -> DataFrame:
    """Default verdicts on groups: a theme's name from its two commonest title words, and whether it is kept by its
    cohesion; themes: sources of the documents."""
    words = entries(spark, d).select("source", F.explode(text.title_tokens(F.col("title"))).alias("w")).groupBy("source", "w").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "w")
    top = words.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rn", "w"))).alias("x"), F.max("n").alias("n"))
    size = entries(spark, d).groupBy("source").agg(F.count("*").alias("entries"))
    return top.join(size, "source").select("source", F.initcap(F.array_join(F.transform("x", lambda x: x["w"]), " ")).alias("name"), F.when(F.col("n") / F.col("entries") < 0.2, "demote").otherwise("keep").alias("verdict"))


def j7_resume(spark: SparkSession, d: str) -> DataFrame:
    """A slice with the 72 hours before it as its tail finds the duplicates that the whole run finds."""
    e = entries(spark, d).select("id", "published_at", text.content_hash(F.col("title"), F.col("summary")).alias("h"))
    middle = e.agg((F.min("published_at").cast("double") / 2 + F.max("published_at").cast("double") / 2).cast("timestamp").alias("start"))
    tail = e.crossJoin(F.broadcast(middle)).where(F.col("published_at") > F.col("start") - F.expr("interval 72 hours"))  # one row
    return windows.earlier_duplicate(tail, "h", "published_at", "id", 72).where(F.col("published_at") >= F.col("start")).select("id", "duplicate_of")


OPINION = f"WITH v AS (SELECT a AS target, step, (a + b) % 3 <> 0 AS crosses FROM ({ranking.SQL['c23_neighbour_pairs']})) SELECT target, 'below' AS side, CAST(coalesce(min(step) FILTER (WHERE NOT crosses) - 1, max(step)) AS BIGINT) AS run, count(*) FILTER (WHERE NOT crosses) = 0 AS bounded FROM v GROUP BY 1"
_CONTENT = "content AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda w: length(w) >= 4)) AS token FROM entries)"
_INDEXES = f"""{ENTRIES}, {KEY_SETS}, {ENTITY_SETS}, {_CONTENT},
held_content AS (SELECT DISTINCT id, token FROM content), cdf AS (SELECT token, count(*) AS n FROM held_content GROUP BY 1 HAVING count(*) BETWEEN 2 AND {SELECTED_HOLDERS}),
indexed AS (SELECT 'title' AS kind, id, sha256(replace(replace(lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')) AS token FROM entries WHERE title <> ''
  UNION SELECT 'term', id, token FROM (SELECT h.id, h.token, row_number() OVER (PARTITION BY h.id ORDER BY n, h.token) AS rn FROM held_content h JOIN cdf ON h.token = cdf.token) WHERE rn <= {SELECTED}
  UNION SELECT 'rare_title', id, unnest(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4)) FROM entries
  UNION SELECT 'entity', id, unnest(list) FROM entity_sets UNION SELECT 'event_key', id, unnest(list) FROM key_sets),
most(kind, m) AS (VALUES {", ".join(f"('{k}', {m})" for k, m in MOST_HOLDERS.items())}),
usable AS (SELECT kind, token FROM indexed JOIN most USING (kind) GROUP BY 1, 2, m HAVING count(*) BETWEEN 2 AND m),
blocked AS (SELECT x.a, x.b, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS by_{k}" for k in MOST_HOLDERS)} FROM (
  SELECT p.kind, p.id AS a, q.id AS b FROM indexed p JOIN usable u ON p.kind = u.kind AND p.token = u.token JOIN indexed q ON q.kind = p.kind AND q.token = p.token AND p.id < q.id) x GROUP BY 1, 2)"""


def _unit(name: str, source: str, most: int) -> str:
    return f"""{name}_tf AS (SELECT id, token, count(*) AS tf FROM {source} GROUP BY 1, 2), {name}_df AS (SELECT token, count(*) AS df FROM {name}_tf GROUP BY 1),
{name}_w AS (SELECT id, t.token, (1 + ln(least(tf, {most}))) * (ln(((SELECT count(*) FROM entries) + 1.0::DOUBLE) / (df + 1)) + 1) AS w FROM {name}_tf t JOIN {name}_df d ON t.token = d.token),
{name}_u AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}_w),
{name}_cos AS (SELECT p.a, p.b, round(sum(x.w * y.w), 6) AS cosine FROM blocked p JOIN {name}_u x ON x.id = p.a JOIN {name}_u y ON y.id = p.b AND y.token = x.token GROUP BY 1, 2)"""


_EDGES = f"""{_INDEXES}, title_words AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: length(w) >= 4)) AS token FROM entries),
{_unit("title", "title_words", 3)}, {_unit("body", "content", 4)}, {HASH}, cat AS ({TEXT_SQL["b27_lexical_category"]}),
x AS (SELECT p.*, coalesce(t.cosine, 0) AS title_cosine, coalesce(c.cosine, 0) AS content_cosine, ca.category = cb.category AS alike,
  NOT (regexp_matches(ea.title, '{TEMPLATE}') OR regexp_matches(eb.title, '{TEMPLATE}')) AS plain, ea.source IN {TEMPLATE_SOURCES} OR eb.source IN {TEMPLATE_SOURCES} AS sources,
  abs(epoch(eb.published_at) - epoch(ea.published_at)) / 3600 AS gap, ha.h = hb.h AS same
  FROM blocked p LEFT JOIN title_cos t ON t.a = p.a AND t.b = p.b LEFT JOIN body_cos c ON c.a = p.a AND c.b = p.b JOIN entries ea ON ea.id = p.a JOIN entries eb ON eb.id = p.b
  JOIN cat ca ON ca.id = p.a JOIN cat cb ON cb.id = p.b JOIN hashed ha ON ha.id = p.a JOIN hashed hb ON hb.id = p.b),
j AS (SELECT *, plain AND title_cosine >= 0.84 AND by_rare_title >= 3 AS sj,
  plain AND ((title_cosine >= 0.77 AND by_rare_title >= 2) OR (content_cosine >= 0.82 AND by_rare_title >= 2 AND by_entity >= 1)) AS lj,
  by_event_key > 0 OR (alike AND by_title > 0 AND plain) AS known FROM x),
m AS (SELECT *, known OR (alike AND sj) AS strict, known OR (alike AND CASE WHEN sources THEN sj ELSE lj END) AS balanced,
  (same AND gap <= 72) OR (gap <= 4 AND (by_event_key > 0 OR by_title > 0 OR (content_cosine >= 0.72 AND (by_rare_title + by_entity >= 1 OR by_term >= 2)))) AS ep FROM j)"""
_SHARING = "held_words AS (SELECT DISTINCT id, unnest(t) AS token FROM sets), sharing AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM held_words x JOIN held_words y ON x.token = y.token AND x.id < y.id GROUP BY 1, 2)"
_FIRSTS = "firsts AS (SELECT title, min(id) AS a FROM entries GROUP BY 1)"
_LINKED = f"""{NEAR.replace("near AS (", "docs AS (SELECT doc_id FROM documents), near AS (").replace("FROM vectors a JOIN vectors b ON", "FROM vectors a JOIN vectors b ON a.id IN (SELECT doc_id FROM docs) AND b.id IN (SELECT doc_id FROM docs) AND").replace("sim >= 0.2", "sim >= 0.35")},
{TOK}, {HASH}, dup AS (SELECT * FROM (SELECT a.id AS b, (SELECT max(b.id) FROM hashed b WHERE b.h = a.h AND b.id < a.id AND b.published_at > a.published_at - INTERVAL 72 HOUR) AS a FROM hashed a) WHERE a IS NOT NULL),
linked_edges AS (SELECT a, b, 0 AS m FROM dup UNION SELECT match, id, 1 FROM best UNION SELECT a, b, 2 FROM shared WHERE shared >= 3
  UNION SELECT c.id, s.id, 2 FROM sets s JOIN classes c ON s.t = c.t WHERE len(s.t) >= 3 AND s.id <> c.id),
both_ways AS (SELECT a, b FROM linked_edges UNION SELECT b, a FROM linked_edges),
reach AS (SELECT DISTINCT a AS id, a AS other FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY 1), how AS (SELECT b AS id, min(m) AS m FROM linked_edges GROUP BY 1),
linked AS (SELECT e.id, coalesce(component, e.id) AS storyline, {list(METHODS)}[coalesce(m, 3) + 1] AS method FROM entries e LEFT JOIN comp ON comp.id = e.id LEFT JOIN how ON how.id = e.id)"""
_EPISODE = f"""{VECTORS}, edims AS (SELECT id // 25 AS episode, unnest(range(64)) AS dim, unnest(embedding) AS x FROM vectors), emeans AS (SELECT episode, dim, avg(x) AS x FROM edims GROUP BY 1, 2),
ecents AS (SELECT episode, list(x ORDER BY dim) AS c FROM emeans GROUP BY 1)"""
_THEMES = f"""{VECTORS}, tp AS (SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.id < b.id WHERE {COS.format(a='a.embedding', b='b.embedding')} >= 0.2),
te AS (SELECT a, b FROM tp UNION SELECT b, a FROM tp), tr AS (SELECT DISTINCT a AS id, a AS other FROM te UNION SELECT r.id, e.b FROM tr r JOIN te e ON r.other = e.a),
tc AS (SELECT id, min(other) AS cluster FROM tr GROUP BY 1)"""

QUERIES = {f.__name__: f for f in (
    c6_centroid_candidates, c7_member_retrieval, c10_candidate_merge, c11_candidate_facts, c12_blocked_pairs, c13_edge_predicate, c17_merge_candidates, c18_intruders,
    c24_training_pairs, c28_rank_detail, c29_lineage, c30_coverage, d11_run_summary, d23_b_cubed, d30_label_set_checks, d36_article_coverage,
    e11_position_opinion, h3_linked_storylines, h3_storyline_rollups, h4_average_linkage, h5_gated_themes, h6_reconciliation, h7_sweep_outcome, h7_sweep_assignments, h10_topology_labels, h11_curation,
    h12_preference_weights, i5_promotion, i6_rebuild, i6_rebuilt_themes, i8_active_experiment, i9_rank_receipts, i11_clear_features, j1_stub_verdicts, j1_stub_themes, j7_resume)}
SQL = {
    "c6_centroid_candidates": f"""WITH {_EPISODE}, m AS (SELECT id, episode, round({COS.format(a='embedding', b='c')}, 9) AS sim FROM vectors, ecents)
SELECT id, episode, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, episode) AS rank FROM m WHERE sim >= 0.1) WHERE rank <= 3""",
    "c7_member_retrieval": f"""WITH {VECTORS}, m AS (SELECT q.id AS q, r.label, round(max(round({COS.format(a='q.embedding', b='r.embedding')}, 9)), 6) AS score FROM vectors q, vectors r WHERE q.id % 50 = 0 AND q.id <> r.id GROUP BY 1, 2)
SELECT q, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, label) AS rank FROM m WHERE score >= 0.2) WHERE rank <= 3""",
    "c10_candidate_merge": f"""WITH {TOK}, {_SHARING}, {_FIRSTS}, x AS (SELECT a, e.id AS b, 0 AS priority, 1 AS shared FROM entries e JOIN firsts f ON e.title = f.title WHERE a < e.id UNION ALL SELECT a, b, 1, shared FROM sharing WHERE shared >= 2),
m AS (SELECT a, b, CAST(min(priority) AS BIGINT) AS priority, CAST(max(shared) AS BIGINT) AS shared FROM x GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY priority, shared DESC, a) AS rank FROM m) WHERE rank <= 3""",
    "c11_candidate_facts": f"""WITH {TOK}, {_SHARING} SELECT p.a, p.b, shared, array_to_string(list_sort(list_intersect(x.t, y.t)), ' ') AS words, round((p.b - p.a) * 7 / 60.0::DOUBLE, 6) AS gap_hours, (p.b - p.a) * 7 // 1440 AS gap_days,
  round(shared * 1.0::DOUBLE / (len(x.t) + len(y.t) - shared), 6) AS similarity FROM sharing p JOIN sets x ON x.id = p.a JOIN sets y ON y.id = p.b WHERE shared >= 2""",
    "c12_blocked_pairs": f"WITH {_INDEXES} SELECT * FROM blocked",
    "c13_edge_predicate": f"WITH {_EDGES} SELECT a, b, title_cosine, content_cosine, strict, balanced, balanced AND ep AS episode FROM m WHERE strict OR balanced",
    "c17_merge_candidates": f"""WITH {CENT}, w AS (SELECT DISTINCT label AS id, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS token FROM cents JOIN part ON p_partkey = label + 1),
s AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM w x JOIN w y ON x.token = y.token AND x.id < y.id WHERE x.token <> '' GROUP BY 1, 2),
n AS (SELECT p.label AS a, q.label AS b, round({COS.format(a='p.c', b='q.c')}, 9) AS sim FROM cents p JOIN cents q ON p.label < q.label)
SELECT CAST(n.a AS BIGINT) AS a, CAST(n.b AS BIGINT) AS b, round(sim, 6) AS cosine, coalesce(shared, 0) AS shared FROM n LEFT JOIN s ON s.a = n.a AND s.b = n.b WHERE sim >= 0.1 OR coalesce(shared, 0) > 0""",
    "c18_intruders": f"""WITH {CENT}, m AS (SELECT k.label AS theme, id, round({COS.format(a='embedding', b='c')}, 9) AS sim FROM vectors v JOIN cents k ON v.label <> k.label),
near AS (SELECT theme, id, row_number() OVER (PARTITION BY theme ORDER BY sim DESC, id) AS rank FROM m QUALIFY rank <= 3),
rest AS (SELECT theme, id, 3 + row_number() OVER (PARTITION BY theme ORDER BY sha256('seed:' || id), id) AS rank FROM m WHERE (theme, id) NOT IN (SELECT theme, id FROM near) QUALIFY rank <= 5)
SELECT theme, id, true AS near, rank FROM near UNION ALL SELECT theme, id, false, rank FROM rest""",
    "c24_training_pairs": f"WITH {ranking._PAIRS} SELECT v.a, v.b, w1 = v.a AS won, coalesce(x.rubric, 4.0) - coalesce(y.rubric, 4.0) AS delta, round(x.rank_key - y.rank_key - (coalesce(x.rubric, 4.0) - coalesce(y.rubric, 4.0)), 6) AS offset FROM verdicts v JOIN keyed x ON x.storyline = v.a JOIN keyed y ON y.storyline = v.b WHERE w1 = w2",
    "c28_rank_detail": f"""WITH {ranking._RANKED}, r AS (SELECT facet_key, storyline, position FROM ranked WHERE facet_type = 'theme'),
near AS (SELECT x.storyline, string_agg(CAST(y.storyline AS VARCHAR), ',' ORDER BY y.position) AS neighbours FROM r x JOIN r y ON x.facet_key = y.facet_key AND abs(x.position - y.position) BETWEEN 1 AND 3 GROUP BY 1),
v AS (SELECT o_custkey, max(version) AS version FROM ({EVENT_SQL["e6_card_versions"]}) GROUP BY 1), p AS ({OPINION})
SELECT r.storyline, 'exp-1' AS experiment, version, run, bounded, coalesce(neighbours, '') AS neighbours FROM r LEFT JOIN near n ON n.storyline = r.storyline LEFT JOIN v ON v.o_custkey = r.storyline LEFT JOIN p ON p.target = r.storyline""",
    "c29_lineage": """WITH runs AS (SELECT o_custkey, substr(o_orderpriority, 1, 1) AS run FROM orders UNION SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '2' END FROM orders)
SELECT o_custkey, count(*) AS runs, count(*) FILTER (WHERE run IN ('1', '2', '3', '4', '5')) AS known, count(*) FILTER (WHERE run IN ('1', '2', '4')) AS finished, count(*) FILTER (WHERE run IN ('1', '2', '3', '4', '5')) > 1 AS ambiguous FROM runs GROUP BY 1""",
    "c30_coverage": """WITH j AS (SELECT source, coalesce(quality = 1 AND sha256(text) = sha256(CASE WHEN d.doc_id % 7 = 0 THEN text || ' rev' ELSE text END), false) AS ok FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT source, bool_and(ok) AS covered, count(*) FILTER (WHERE ok) AS reviewed, count(*) AS n FROM j GROUP BY 1""",
    "d11_run_summary": f"""WITH RECURSIVE {_LINKED}, n AS (SELECT storyline, count(*) AS n FROM linked GROUP BY 1)
SELECT count(*) AS storylines, CAST(sum(n) AS BIGINT) AS entries, count(*) FILTER (WHERE n = 1) AS singletons, max(n) AS longest, round(avg(n), 6) AS mean,
  {", ".join(f"(SELECT count(*) FROM linked WHERE method = '{m}') AS by_{m}" for m in METHODS)}, (SELECT round(avg(CAST(method = 'new' AS INTEGER)), 6) FROM linked) AS new_share,
  (SELECT count(DISTINCT label) FROM vectors) AS themes, (SELECT max(k) FROM (SELECT count(*) AS k FROM vectors GROUP BY label)) AS largest_theme FROM n""",
    "d23_b_cubed": f"SELECT b3_precision, b3_recall, b3_f1 FROM ({similarity.SQL['d22_cluster_scores']})",
    "d30_label_set_checks": "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey AS o_custkey, c_custkey % 12 + 4 AS declared, coalesce(n, 0) AS actual FROM customer LEFT JOIN n ON c_custkey = o_custkey WHERE c_custkey % 12 + 4 <> coalesce(n, 0)",
    "d36_article_coverage": f"WITH {ENTRIES} SELECT source, count(*) FILTER (WHERE id % 6 <> 0) AS current, count(*) FILTER (WHERE id % 6 = 0) AS stale FROM entries GROUP BY 1",
    "e11_position_opinion": OPINION,
    "h3_linked_storylines": f"WITH RECURSIVE {_LINKED} SELECT * FROM linked",
    "h3_storyline_rollups": f"""WITH RECURSIVE {_LINKED} SELECT storyline, count(*) AS n, count(DISTINCT source) AS sources, CAST(epoch(min(published_at)) AS BIGINT) AS first_s, CAST(epoch(max(published_at)) AS BIGINT) AS last_s,
  sha256(arg_min(title, (published_at, e.id))) AS title_sha FROM linked l JOIN entries e ON e.id = l.id GROUP BY 1""",
    "h5_gated_themes": f"""WITH RECURSIVE {_THEMES}, j AS (SELECT cluster, v.id, published_at, embedding FROM tc JOIN vectors v ON v.id = tc.id),
dims AS (SELECT cluster, unnest(range(64)) AS dim, unnest(embedding) AS x FROM j), means AS (SELECT cluster, dim, avg(x) AS x FROM dims GROUP BY 1, 2), cs AS (SELECT cluster, list(x ORDER BY dim) AS c FROM means GROUP BY 1)
SELECT * FROM (SELECT j.cluster, count(*) AS n, count(DISTINCT CAST(published_at AS DATE)) AS days, round(avg({COS.format(a='embedding', b='c')}), 6) AS cohesion FROM j JOIN cs ON cs.cluster = j.cluster GROUP BY 1) WHERE n >= 4 AND days >= 3 AND cohesion >= 0.1""",
    "h11_curation": f"""WITH RECURSIVE g AS (SELECT o_custkey AS key, count(*) AS size FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus <> 'P')),
s AS (SELECT *, CASE WHEN size = 1 THEN 'single' WHEN size <= 8 THEN 'short' ELSE 'long' END AS stratum FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('s1' || key), key) AS k FROM s),
f(stratum, k, total, taken) AS (SELECT stratum, 0::BIGINT, 0::BIGINT, false FROM (VALUES ('short'), ('long')) v(stratum)
  UNION ALL SELECT o.stratum, o.k, CASE WHEN f.total + o.size <= 60 THEN f.total + o.size ELSE f.total END, f.total + o.size <= 60 FROM f JOIN o ON o.stratum = f.stratum AND o.k = f.k + 1),
got AS (SELECT o.stratum, o.key, o.size FROM f JOIN o ON o.stratum = f.stratum AND o.k = f.k WHERE taken)
SELECT stratum, key FROM got UNION ALL SELECT stratum, key FROM o WHERE stratum = 'single' AND k <= 130 - (SELECT coalesce(sum(size), 0) FROM got)""",
    "i5_promotion": """WITH p AS (SELECT doc_id, doc_id // 50 AS batch, doc_id % 101 = 0 OR toxic NOT IN (0, 1) OR toxic IS NULL AS broken FROM labels WHERE quality = 1)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id NOT IN (SELECT doc_id FROM documents) THEN 'orphan' WHEN batch IN (SELECT batch FROM p WHERE broken) THEN 'refused' WHEN doc_id % 8 = 0 THEN 'proposed' ELSE 'promoted' END AS state FROM p""",
    "i6_rebuild": """SELECT conv_id AS storyline, count(*) AS n, CASE WHEN max(TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 90 MINUTE) < TIMESTAMP '2024-01-05' THEN 'dormant' ELSE 'open' END AS state,
  arg_min(turn, (role = 'system', turn)) AS headline, sha256(string_agg(text, ' / ' ORDER BY turn, text)) AS card_sha FROM conversations GROUP BY 1""",
    "i6_rebuilt_themes": f"""WITH {CENT} SELECT v.label, count(*) AS n, CAST(epoch(min(published_at)) AS BIGINT) AS first_s, CAST(epoch(max(published_at)) AS BIGINT) AS newest_s, round(avg({COS.format(a='embedding', b='c')}), 6) AS cohesion,
  round(any_value(c)[1], 6) AS x0, round(list_sum(any_value(c)), 6) AS x_sum FROM vectors v JOIN cents k ON k.label = v.label GROUP BY 1""",
    "i8_active_experiment": f"""WITH r AS (SELECT storyline, global_position AS p FROM ({ranking.SQL['e5_experiment_positions']})),
b AS (SELECT 1 AS experiment, * FROM r WHERE storyline % 2 = 0 UNION ALL SELECT 2, * FROM r UNION ALL SELECT 3, storyline, CASE WHEN p > 10 THEN p + 1 ELSE p END FROM r),
c AS (SELECT experiment FROM b GROUP BY 1 HAVING min(p) = 1 AND max(p) = count(*) AND count(DISTINCT p) = count(*))
SELECT experiment, storyline, p AS global_position FROM b WHERE experiment = (SELECT max(experiment) FROM c)""",
    "i9_rank_receipts": f"SELECT CASE WHEN storyline % 10 = 0 THEN 'mismatch' ELSE 'exact' END AS status, count(*) AS n FROM ({ranking.SQL['b35_rank_key']}) GROUP BY 1",
    "j1_stub_verdicts": f"""WITH {TOK}, z AS (SELECT c.id, count(DISTINCT source) AS sources, count(*) AS n, min(title) AS title FROM sets s JOIN classes c ON s.t = c.t JOIN entries e ON e.id = s.id GROUP BY 1)
SELECT a, b, shared >= 3 AS same_event, shared >= 1 AS member, CASE WHEN (x.sources, x.n) > (y.sources, y.n) THEN 'a' WHEN (y.sources, y.n) > (x.sources, x.n) THEN 'b' WHEN x.title <= y.title THEN 'a' ELSE 'b' END AS prefers
FROM shared JOIN z x ON x.id = a JOIN z y ON y.id = b""",
    "j1_stub_themes": f"""WITH {ENTRIES}, w AS (SELECT source, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4))) AS w FROM entries),
k AS (SELECT source, w, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS rn FROM k),
z AS (SELECT source, count(*) AS entries FROM entries GROUP BY 1)
SELECT t.source, string_agg(upper(w[1]) || w[2:], ' ' ORDER BY rn) AS name, CASE WHEN max(n) * 1.0 / any_value(entries) < 0.2 THEN 'demote' ELSE 'keep' END AS verdict FROM t JOIN z ON z.source = t.source WHERE rn <= 2 GROUP BY 1""",
    "i11_clear_features": f"WITH {ENTRIES} SELECT id, CASE WHEN length(trim(summary)) >= 40 AND length(regexp_replace(summary, '[^A-Za-z0-9]', '', 'g')) >= 20 AND NOT contains(lower(summary), 'cookie') AND NOT contains(lower(summary), 'javascript') THEN length(summary) END AS chars, CASE WHEN id % 4 <> 0 THEN 'none' WHEN length(trim(summary)) >= 40 AND length(regexp_replace(summary, '[^A-Za-z0-9]', '', 'g')) >= 20 AND NOT contains(lower(summary), 'cookie') AND NOT contains(lower(summary), 'javascript') THEN 'approved' ELSE 'open' END AS proposal FROM entries",
    "j7_resume": f"WITH {ENTRIES}, s AS (SELECT min(published_at) + (max(published_at) - min(published_at)) / 2 AS start FROM entries) SELECT d.id, duplicate_of FROM ({EVENT_SQL['c4_window_duplicate']}) d JOIN entries e ON e.id = d.id WHERE published_at >= (SELECT start FROM s)",
    "h10_topology_labels": f"WITH c AS ({similarity.SQL['h1_components']}), n AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT doc_id AS id, coalesce(c.component, doc_id) AS storyline, coalesce(size, 1) AS size FROM documents LEFT JOIN c ON c.id = doc_id LEFT JOIN n ON n.component = c.component",
}
