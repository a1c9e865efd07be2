"""Scores, vectors and fused retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import text as fx
from sieveline.operators import scoring as sc
from sieveline.operators import vectors as vec
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL} "
NOW = "TIMESTAMP '2025-01-01'"


def _round(c: F.Column, name: str) -> F.Column:
    return F.round(c, 6).alias(name)


@query("r02_rank_fusion", E + ", k AS (SELECT id, row_number() OVER (ORDER BY ais DESC, id) - 1 AS rank FROM (SELECT * FROM entries WHERE ais IS NOT NULL ORDER BY ais DESC, id LIMIT 200)), v AS (SELECT id, row_number() OVER (ORDER BY iqs DESC, id) - 1 AS rank, iqs / 100 AS raw FROM (SELECT * FROM entries WHERE iqs IS NOT NULL ORDER BY iqs DESC, id LIMIT 200)) SELECT coalesce(k.id, v.id) AS id, round(coalesce(0.4 / (60 + k.rank + 1), 0) + coalesce(0.6 * (1.0 / (60 + v.rank + 1) + 0.25 * v.raw), 0), 6) AS score, CASE WHEN v.id IS NULL THEN 'keyword' WHEN k.id IS NULL THEN 'vector' ELSE 'hybrid' END AS origin FROM k FULL JOIN v ON k.id = v.id")
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    top = lambda c: e.where(F.col(c).isNotNull()).orderBy(F.col(c).desc(), "id").limit(200).withColumn("rank", F.row_number().over(Window.orderBy(F.col(c).desc(), "id")) - 1)
    return vec.fuse(top("ais").select("id", "rank"), top("iqs").select("id", "rank", (F.col("iqs") / 100).alias("raw")), "id").select("id", _round(F.col("score"), "score"), "origin")


_TOK = lambda c: f"list_distinct([x FOR x IN regexp_split_to_array(lower({c}), '\\s+') IF length(x) >= 3 AND NOT list_contains([{', '.join(repr(w) for w in fx.STOPWORDS)}], x)])"
_Q = "the them these onthe"


@query("r03_vector_rerank", f"WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS title, (n_chars % 97) / 97.0 AS raw, CASE WHEN doc_id % 2 = 0 THEN 1.25 ELSE 0 END AS stored FROM documents), s AS (SELECT *, len(list_intersect({_TOK('title')}, {_TOK(repr(_Q))})) / len({_TOK(repr(_Q))}) AS a, len(list_intersect({_TOK('text')}, {_TOK(repr(_Q))})) / len({_TOK(repr(_Q))}) AS b FROM d) SELECT doc_id, round(raw * CASE WHEN stored > 0 THEN stored ELSE 1.5 * 0.9 / 2 END * CASE WHEN length(trim(text)) < 60 THEN 0.72 WHEN length(trim(text)) < 140 THEN 0.88 ELSE 1 END + 0.35 * a + 0.15 * b, 6) AS final_score FROM s")
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    stored = F.when(F.col("doc_id") % 2 == 0, 1.25).otherwise(0.0)
    score = sc.rerank((F.col("n_chars") % 97) / 97, stored, F.lit("tier_2_official"), F.lit("ngo_guidance"), _Q, F.get(F.split("text", "\n"), F.lit(0)), F.col("text"))
    return d.select("doc_id", _round(score, "final_score"))


@query("r04_length_factor", "SELECT doc_id, CASE WHEN length(trim(text)) < 60 THEN 0.72 WHEN length(trim(text)) < 140 THEN 0.88 ELSE 1.0 END::DOUBLE AS factor FROM documents")
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sc.length_factor(F.col("text")).alias("factor"))


@query("r05_token_overlap", f"SELECT doc_id, round(len(list_intersect({_TOK('text')}, {_TOK(repr(_Q))})) / len({_TOK(repr(_Q))}), 6) AS overlap FROM documents")
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _round(fx.overlap(fx.tokens(F.lit(_Q)), fx.tokens(F.col("text"))), "overlap"))


@query("r07_source_weight", "SELECT doc_id, round(CASE doc_id % 4 WHEN 0 THEN 1.8 WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.7 END * CASE doc_id % 3 WHEN 0 THEN 1.4 WHEN 1 THEN 0.8 ELSE 1.0 END, 3)::DOUBLE AS weight FROM documents")
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    trust = F.element_at(F.array(*[F.lit(x) for x in sc.TRUST]), (k % 4).cast("int") + 1)
    kind = F.when(k % 3 == 0, "statute").when(k % 3 == 1, "website").otherwise("unlisted")
    return table(spark, sf_dir, "documents").select("doc_id", sc.source_weight(trust, kind).alias("weight"))


@query("r13_confidence_buckets", "SELECT event_id, CASE WHEN s >= 12 THEN 0.92 WHEN s >= 9 THEN 0.86 WHEN s >= 6 THEN 0.79 WHEN s >= 4 THEN 0.72 ELSE 0.55 END::DOUBLE AS confidence FROM (SELECT event_id, value / 6 AS s FROM events)")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", sc.confidence_bucket(F.col("value") / 6).alias("confidence"))


@query("r15_recency_rerank", E + f"SELECT id, round(CASE WHEN age >= 0 AND age < 365 THEN iqs * (1 - age / 365.0 * 0.1) ELSE iqs END, 6) AS score FROM (SELECT id, coalesce(iqs, 0) AS iqs, date_diff('day', CAST(last_seen AS DATE), DATE '2025-01-01') AS age FROM entries)")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry; one without a score has 0, one that was never seen keeps its score."""
    e = entries(spark, sf_dir)
    return e.select("id", _round(sc.recency(F.coalesce("iqs", F.lit(0.0)), F.datediff(F.lit("2025-01-01").cast("date"), F.col("last_seen").cast("date"))), "score"))


_FRESH = f"CASE WHEN last_seen IS NULL THEN 50 WHEN dd <= 7 THEN 100 WHEN dd <= 30 THEN 90 WHEN dd <= 90 THEN 75 WHEN dd <= 180 THEN 60 WHEN dd <= 365 THEN 40 ELSE 20 END"
_HAS = lambda c: f"(coalesce({c}, '') <> '')::INT"


@query("r17_information_quality", E + f", f AS (SELECT *, floor((epoch({NOW}) - epoch(last_seen)) / 86400) AS dd FROM entries) SELECT id, round(((1 + {_HAS('title_de')} + {_HAS('url')} + {_HAS('status')} + {_HAS('source')}) / 5.0 * 70 + ({_HAS('summary_de')} + {_HAS('content_de')} + 1 + (tags IS NOT NULL)::INT) / 5.0 * 30) * 0.4 + {_FRESH} * 0.3 + CASE WHEN source <> '' THEN 25 ELSE 0 END * 0.15 + ({_HAS('title_de')} + {_HAS('title_en')} + {_HAS('title_easy_de')} + {_HAS('summary_de')} + {_HAS('summary_en')} + {_HAS('content_de')}) / 9.0 * 100 * 0.15, 2) AS quality FROM f")
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", sc.information_quality(F.lit("2025-01-01").cast("timestamp")).alias("quality"))


@query("r18_searchability", E + f", g AS (SELECT *, ({_HAS('title_de')} + {_HAS('summary_de')} + {_HAS('content_de')} > 0)::INT + ({_HAS('title_en')} + {_HAS('summary_en')} > 0)::INT + {_HAS('title_easy_de')} AS nl, length(coalesce(content_de, '')) AS n, length(coalesce(summary_de, '')) AS s FROM entries) SELECT id, round((CASE WHEN {_HAS('title_de')} + {_HAS('title_en')} + {_HAS('title_easy_de')} > 0 THEN 30 ELSE 0 END + CASE WHEN {_HAS('summary_de')} + {_HAS('summary_en')} > 0 THEN 25 ELSE 0 END + 25 * {_HAS('content_de')}) * 0.35 + (35 + CASE WHEN tags IS NOT NULL THEN 30 ELSE 0 END) * 0.3 + (CASE WHEN n >= 200 THEN 50 WHEN n >= 100 THEN 30 WHEN n >= 50 THEN 15 ELSE 0 END + CASE WHEN s >= 50 THEN 50 WHEN s > 0 THEN 25 ELSE 0 END) * 0.2 + CASE nl WHEN 3 THEN 100 WHEN 2 THEN 70 WHEN 1 THEN 40 ELSE 0 END * 0.15, 2)::DOUBLE AS searchability FROM g")
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", sc.searchability().alias("searchability"))


@query("r19_freshness", E + f", f AS (SELECT *, floor((epoch({NOW}) - epoch(last_seen)) / 86400) AS dd FROM entries) SELECT id, ({_FRESH})::DOUBLE AS freshness FROM f")
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", sc.freshness(F.col("last_seen"), F.lit("2025-01-01").cast("timestamp")).alias("freshness"))


_TIERS = ("tier_1_law", "TIER_1_official ", "tier_2_official", "tier_2_ngo_watchdog", "tier_3_ngo", "tier_3_press", "tier_4_academic", "tier_4_other", "tier_5_contextual", "tier_5_partisan_context", "tier_unknown", None)


@query("r27_tier_rank", E + "SELECT id, [4, 4, 3, 2, 2, 1, 1, 0, 0, 0, -1, -1][CAST(id % 12 AS INT) + 1] AS rank FROM entries")
def r27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of one of ten tiers, of one that isn't any, or of none, for every entry."""
    tier = F.element_at(F.array(*map(F.lit, _TIERS)), (F.col("id") % 12).cast("int") + 1)
    return entries(spark, sf_dir).select("id", sc.tier_rank(tier).cast("int").alias("rank"))


@query("r31_position_confidence", "SELECT conv_id, turn, greatest(0.1, round(1 - 0.15 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1), 2))::DOUBLE AS confidence FROM conversations")
def r31(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.greatest(F.lit(0.1), F.round(1 - 0.15 * i, 2)).alias("confidence"))


@query("r34_readability", "WITH s AS (SELECT doc_id, len(string_split(trim(text), ' ')) AS w, greatest(1, length(text) - length(replace(text, '.', ''))) AS n FROM documents), a AS (SELECT doc_id, CAST(w AS DOUBLE) / n AS a FROM s) SELECT doc_id, CASE WHEN a <= 8 THEN 'A1' WHEN a <= 12 THEN 'A2' WHEN a <= 16 THEN 'B1' WHEN a <= 20 THEN 'B2' ELSE 'C1' END AS level, CASE WHEN a <= 12 THEN 'simple' WHEN a <= 20 THEN 'moderate' ELSE 'complex' END AS complexity FROM a")
def r34(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = F.size(F.split(F.trim("text"), " ")) / F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"\.")))
    level, complexity = sc.readability(F.col("per"))
    return table(spark, sf_dir, "documents").select("doc_id", per.alias("per")).select("doc_id", level.alias("level"), complexity.alias("complexity"))


@query("r36_evidence_sufficiency", E + "SELECT domain, coalesce(max(iqs / 100) >= 0.7, FALSE) AS sufficient FROM entries GROUP BY domain")
def r36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("domain").agg(F.coalesce(F.max(F.col("iqs") / 100) >= 0.7, F.lit(False)).alias("sufficient"))


_VQ = "CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])"


def _asked(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


@query("v01_cosine", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VQ}), 6) AS score FROM embeddings")
def v01(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _asked(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", _round(vec.cosine(F.col("embedding"), q), "score"))


@query("v02_euclidean", f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), {_VQ}), 6) AS distance FROM embeddings")
def v02(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _asked(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", _round(vec.euclidean(F.col("embedding"), q), "distance"))


@query("v03_dot_product", f"SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), {_VQ}), 6) AS product FROM embeddings")
def v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _asked(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", _round(vec.dot(F.col("embedding"), q), "product"))


@query("v04_search", f"SELECT vec_id, label, round(score, 6) AS score FROM (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VQ}) AS score FROM embeddings) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 10")
def v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec.search(table(spark, sf_dir, "embeddings"), _asked(spark, sf_dir), 10, 0.1).select("vec_id", "label", _round(F.col("score"), "score"))


@query("w20_find_similar", "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), a) AS score FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, vec_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 5")
def w20(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vec.search_blocks(v, v.where("vec_id % 100 = 0"), 5).select("query_id", "vec_id", _round(F.col("score"), "score"), "place")


@query("v05_validated_vectors", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF isfinite(x)]) = 64")
def v05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec.valid(table(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id")


@query("v06_filtered_search", f"SELECT vec_id, round(score * (1 + label / 10.0), 5) AS score FROM (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VQ}) AS score FROM embeddings WHERE label IN (1, 3, 5)) ORDER BY score DESC, vec_id LIMIT 8")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3, 5))
    q = F.array(*[F.lit(float(x)) for x in _asked(spark, sf_dir)])
    weighted = F.round(vec.cosine(F.col("embedding"), q) * (1 + F.col("label") / 10), 5)
    return v.select("vec_id", weighted.alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(8)


@query("v07_cache_misses", "SELECT sha256('model' || text) AS key FROM conversations WHERE sha256('model' || text) NOT IN (SELECT sha256('model' || text) FROM conversations WHERE conv_id % 2 = 0) GROUP BY 1")
def v07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.sha2(F.concat(F.lit("model"), "text"), 256).alias("key"))
    return c.select("key").join(c.where("conv_id % 2 = 0").select("key"), "key", "left_anti").distinct()


@query("v10_store_stats", "SELECT count(*) AS vectors, min(len(embedding)) AS dimension, count(*) * (50 + 8 * min(len(embedding)) + 200) AS memory FROM embeddings")
def v10(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.count("*"), F.min(F.size("embedding"))
    return table(spark, sf_dir, "embeddings").agg(n.alias("vectors"), d.cast("long").alias("dimension"), (n * (50 + 8 * d + 200)).alias("memory"))
