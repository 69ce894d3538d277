"""Similarity, candidate and cluster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text
from storyloom.functions import vectors as v
from storyloom.operators import similar, windows
from storyloom.operators.components import connected_components
from storyloom.operators.windows import newest_per_group
from storyloom.plans.roles import ENTRIES, VECTORS, entries, table, vectors


def b24_cosine(spark: SparkSession, d: str) -> DataFrame:
    a = vectors(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return a.join(b, "id").select("id", F.round(v.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


def c5_near_duplicate(spark: SparkSession, d: str) -> DataFrame:
    out = similar.near_in_window(vectors(spark, d), hours=72, least=0.2)
    return out.select("id", "match", F.round("sim", 6).alias("sim"))


def d9_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = similar.centroids(vectors(spark, d), "label")
    return c.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def d10_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return similar.to_centroid(vectors(spark, d), "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("cohesion"))


def e15_nearest_members(spark: SparkSession, d: str) -> DataFrame:
    s = similar.to_centroid(vectors(spark, d), "label").select("id", "label", F.round("sim", 6).alias("sim"))
    return newest_per_group(s, "label", [F.desc("sim"), F.asc("id")], 15)


def c15_theme_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    out = similar.nearest_groups(rows, similar.centroids(rows, "label").withColumnRenamed("label", "theme"), "theme", least=0.05, k=5)
    return out.select("id", "theme", F.round("sim", 6).alias("sim"), "rank")


def c16_cross_category(spark: SparkSession, d: str) -> DataFrame:
    """Every other label whose centroid is near, all of them in order."""
    c = similar.centroids(vectors(spark, d), "label")
    return similar.near_misses(c.select(F.col("label").alias("id"), F.col("centroid").alias("embedding")), 0.0).select(
        F.col("a").alias("label"), F.col("b").alias("other"), F.round("sim", 6).alias("sim"))


def c22_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return similar.nearest_neighbours(rows.where("id % 50 = 0"), rows, 8).select("q", "id", F.round("sim", 6).alias("sim"), "rank")


def c25_duplicate_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("id", "embedding")
    pairs = c5_near_duplicate(spark, d).select("id", "match")
    m = rows.select(F.col("id").alias("match"), F.col("embedding").alias("e2"))
    return pairs.join(rows, "id").join(m, "match").select("id", "match", F.round(v.cosine(F.col("embedding"), F.col("e2")), 6).alias("sim"))


def d16_threshold_suggestion(spark: SparkSession, d: str) -> DataFrame:
    return c25_duplicate_cosine(spark, d).agg(F.round(F.percentile("sim", F.lit(0.05)) - 0.02, 6).alias("threshold"), F.count("*").alias("pairs"))


def title_words(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("id", F.explode(text.title_tokens(F.col("title"), 6)).alias("token"))


def word_classes(spark: SparkSession, d: str) -> DataFrame:
    return similar.token_classes(title_words(spark, d))


def c8_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal titles that share words; c8_token_classes says who belongs to a class."""
    return similar.shared_tokens(similar.class_tokens(word_classes(spark, d)))


def c8_token_classes(spark: SparkSession, d: str) -> DataFrame:
    return word_classes(spark, d).select("id", "class", F.size("tokens").cast("long").alias("words"))


def c9_rarity_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = similar.class_tokens(word_classes(spark, d))
    weights = t.groupBy("token").agg(F.count("*").cast("double").alias("weight"))
    return similar.top_sharing(t, weights, 3).select("id", "b", F.round("score", 6).alias("score"), "shared", "rank")


def d19_tf_idf(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    words = e.select("id", F.explode(F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)).alias("token"))
    return similar.tf_idf(words, e.count()).select("id", "token", "df", F.round("w", 6).alias("w"))


def d19_rarest_terms(spark: SparkSession, d: str) -> DataFrame:
    """The twelve rarest terms of each title."""
    return newest_per_group(d19_tf_idf(spark, d).select("id", "token", "df"), "id", [F.asc("df"), F.asc("token")], 12)


def g4_member_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    left = rows.select(F.col("label").cast("long").alias("set"), F.col("id").alias("member"))
    right = rows.select((F.col("id") % 7).alias("set"), F.col("id").alias("member"))
    return similar.set_overlap(left, right, 0.05).select("l", "r", F.round("jaccard", 6).alias("jaccard"))


def d22_cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    return similar.pair_scores(F.col("id") % 7, F.col("label"), vectors(spark, d))


def h1_components(spark: SparkSession, d: str) -> DataFrame:
    """Storylines: components of entries that share two title words or more; episodes: their runs without a gap over
    four hours."""
    edges = similar.overlap_edges(title_words(spark, d), 2)
    nodes = connected_components(edges).select(F.col("node").alias("id"), "component")
    timed = nodes.join(entries(spark, d).select("id", "published_at"), "id")
    return windows.episodes_by_gap(timed, "component", "published_at", "id", 4 * 3600).select("id", "component", F.col("episode").cast("long").alias("episode"))


def h9_group_key(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    ids = F.transform(F.array_sort(F.collect_set("turn")), lambda x: x.cast("string"))
    return c.groupBy("conv_id").agg(F.sha2(F.array_join(ids, "|"), 256).alias("group_key"))


def h8_demotion_review(spark: SparkSession, d: str) -> DataFrame:
    return d10_cohesion(spark, d).where("n >= 2 and cohesion < 0.40")


COS = "CASE WHEN sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})) = 0 THEN 0 ELSE greatest(-1, least(1, list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))))) END"
NEAR = f"""{VECTORS}, near AS (SELECT b.id, a.id AS match, round({COS.format(a='a.embedding', b='b.embedding')}, 9) AS sim
  FROM vectors a JOIN vectors b ON a.published_at < b.published_at AND a.published_at > b.published_at - INTERVAL 72 HOUR),
best AS (SELECT id, match, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, match) AS rn FROM near WHERE sim >= 0.2) WHERE rn = 1)"""
CENT = f"""{VECTORS}, dims AS (SELECT label, unnest(range(64)) AS dim, unnest(embedding) AS x FROM vectors),
means AS (SELECT label, dim, avg(x) AS x FROM dims GROUP BY 1, 2),
cents AS (SELECT label, list(x ORDER BY dim) AS c FROM means GROUP BY 1),
sims AS (SELECT id, v.label, {COS.format(a='embedding', b='c')} AS sim FROM vectors v JOIN cents k ON v.label = k.label)"""
TOK = f"""{ENTRIES}, sets AS (SELECT id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 6))) AS t FROM entries),
classes AS (SELECT t, min(id) AS id FROM sets WHERE len(t) > 0 GROUP BY t),
tokens AS (SELECT id, unnest(t) AS token FROM classes),
held AS (SELECT id, token, count(*) OVER (PARTITION BY token) AS n FROM tokens),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM tokens x JOIN tokens y ON x.token = y.token AND x.id < y.id GROUP BY 1, 2)"""

QUERIES = {f.__name__: f for f in (
    b24_cosine, c5_near_duplicate, d9_centroids, d10_cohesion, e15_nearest_members, c15_theme_candidates, c16_cross_category, c22_knn,
    c25_duplicate_cosine, d16_threshold_suggestion, c8_token_overlap, c8_token_classes, c9_rarity_candidates, d19_tf_idf, d19_rarest_terms, g4_member_overlap, d22_cluster_scores,
    h1_components, h9_group_key, h8_demotion_review)}
SQL = {
    "b24_cosine": f"WITH {VECTORS} SELECT a.id, round({COS.format(a='a.embedding', b='b.embedding')}, 6) AS sim FROM vectors a JOIN vectors b ON b.id = a.id + 1",
    "c5_near_duplicate": f"WITH {NEAR} SELECT * FROM best",
    "d9_centroids": f"WITH {CENT} SELECT label, dim, round(x, 6) AS x FROM means",
    "d10_cohesion": f"WITH {CENT} SELECT label, count(*) AS n, round(avg(sim), 6) AS cohesion FROM sims GROUP BY 1",
    "e15_nearest_members": f"WITH {CENT} SELECT id, label, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 6) DESC, id) AS rn FROM sims) WHERE rn <= 15",
    "c15_theme_candidates": f"""WITH {CENT}, m AS (SELECT id, k.label AS theme, round({COS.format(a='embedding', b='c')}, 9) AS sim FROM vectors, cents k)
SELECT id, theme, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, theme) AS rank FROM m WHERE sim >= 0.05) WHERE rank <= 5""",
    "c16_cross_category": f"WITH {CENT} SELECT * FROM (SELECT a.label, b.label AS other, round({COS.format(a='a.c', b='b.c')}, 6) AS sim FROM cents a, cents b WHERE a.label <> b.label) WHERE sim >= 0",
    "c22_knn": f"""WITH {VECTORS}, m AS (SELECT q.id AS q, r.id, round({COS.format(a='q.embedding', b='r.embedding')}, 9) AS sim FROM vectors q, vectors r WHERE q.id % 50 = 0 AND q.id <> r.id)
SELECT q, id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM m) WHERE rank <= 8""",
    "c25_duplicate_cosine": f"WITH {NEAR} SELECT b.id, b.match, round({COS.format(a='x.embedding', b='y.embedding')}, 6) AS sim FROM best b JOIN vectors x ON x.id = b.id JOIN vectors y ON y.id = b.match",
    "d16_threshold_suggestion": f"WITH {NEAR} SELECT round(quantile_cont(sim, 0.05) - 0.02, 6) AS threshold, count(*) AS pairs FROM best",
    "c8_token_overlap": f"WITH {TOK} SELECT * FROM shared",
    "c8_token_classes": f"WITH {TOK} SELECT s.id, c.id AS class, len(s.t) AS words FROM sets s JOIN classes c ON s.t = c.t",
    "c9_rarity_candidates": f"""WITH {TOK}, s AS (SELECT x.id, y.id AS b, round(sum(1.0::DOUBLE / (1 + x.n)), 9) AS score, count(*) AS shared FROM held x JOIN held y ON x.token = y.token AND y.id < x.id GROUP BY 1, 2)
SELECT id, b, round(score, 6) AS score, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, shared DESC, b) AS rank FROM s) WHERE rank <= 3""",
    "d19_tf_idf": f"""WITH {ENTRIES}, w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS token FROM entries),
tf AS (SELECT id, token, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT id, tf.token, df, tf * (ln(((SELECT count(*) FROM entries) + 1.0::DOUBLE) / (df + 1)) + 1) AS w FROM tf JOIN df ON tf.token = df.token)
SELECT id, token, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM x""",
    "g4_member_overlap": f"""WITH {VECTORS}, m AS (SELECT CAST(label AS BIGINT) AS l, id % 7 AS r FROM vectors), c AS (SELECT l, r, count(*) AS c FROM m GROUP BY 1, 2)
SELECT * FROM (SELECT l, r, round(c / (sum(c) OVER (PARTITION BY l) + sum(c) OVER (PARTITION BY r) - c), 6) AS jaccard FROM c) WHERE jaccard >= 0.05""",
    "d22_cluster_scores": f"""WITH {VECTORS}, x AS (SELECT a.id % 7 = b.id % 7 AS p, a.label = b.label AS g FROM vectors a JOIN vectors b ON a.id < b.id),
k AS (SELECT count(*) FILTER (WHERE p AND g) * 1.0::DOUBLE / count(*) FILTER (WHERE p) AS p, count(*) FILTER (WHERE p AND g) * 1.0::DOUBLE / count(*) FILTER (WHERE g) AS r FROM x),
b AS (SELECT avg(bp) AS bp, avg(br) AS br FROM (SELECT a.id, count(*) FILTER (WHERE a.id % 7 = b.id % 7 AND a.label = b.label) / count(*) FILTER (WHERE a.id % 7 = b.id % 7) AS bp,
  count(*) FILTER (WHERE a.id % 7 = b.id % 7 AND a.label = b.label) / count(*) FILTER (WHERE a.label = b.label) AS br FROM vectors a, vectors b GROUP BY 1))
SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, round(bp, 9) AS b3_precision, round(br, 9) AS b3_recall, round(2 * bp * br / (bp + br), 9) AS b3_f1 FROM k, b""",
    "h1_components": f"""WITH RECURSIVE {TOK}, pairs AS (SELECT a, b FROM shared WHERE shared >= 2
  UNION SELECT c.id, s.id FROM sets s JOIN classes c ON s.t = c.t WHERE len(s.t) >= 2 AND s.id <> c.id),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (SELECT DISTINCT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT id, min(other) AS component FROM r GROUP BY 1),
o AS (SELECT c.id, component, published_at, CASE WHEN published_at - lag(published_at) OVER (PARTITION BY component ORDER BY published_at, c.id) > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS opens
  FROM c JOIN entries e ON e.id = c.id)
SELECT id, component, CAST(1 + sum(opens) OVER (PARTITION BY component ORDER BY published_at, id) AS BIGINT) AS episode FROM o""",
    "h9_group_key": "SELECT conv_id, sha256(string_agg(CAST(turn AS VARCHAR), '|' ORDER BY turn)) AS group_key FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY 1",
    "h8_demotion_review": f"WITH {CENT} SELECT * FROM (SELECT label, count(*) AS n, round(avg(sim), 6) AS cohesion FROM sims GROUP BY 1) WHERE n >= 2 AND cohesion < 0.40",
}
SQL["d19_rarest_terms"] = f"SELECT id, token, df FROM ({SQL['d19_tf_idf']}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, token) <= 12"
