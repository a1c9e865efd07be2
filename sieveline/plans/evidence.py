"""Evidence, conversations, error registers and severity as queries; SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import quality as qu
from sieveline.operators import ranking as rk
from sieveline.operators import vectors as ve
from sieveline.plans.quality import _ERR
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources.entries import DOMAINS, ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL} "


@query("w13_evidence_order", E + "SELECT id, iqs / 100 AS confidence FROM entries ORDER BY coalesce(iqs / 100, 0) DESC, id LIMIT 8")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight pieces of evidence with the highest confidence; equal ones keep their order."""
    e = entries(spark, sf_dir).select("id", (F.col("iqs") / 100).alias("confidence"))
    return e.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "id").limit(8)


@query("w26_recent_messages", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def w26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two messages for each of the last three turns."""
    return rk.first_of(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn").desc()], 2 * 3).select("conv_id", "turn", "role", "text")


@query("w29_capped_samples", E + "SELECT domain, status, list_sort(list(id))[1:5] AS samples, count(*) AS n FROM entries GROUP BY ALL")
def w29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sample ids of each list and its whole count; only samples are gathered."""
    e = entries(spark, sf_dir).select("domain", "status", "id")
    samples = rk.first_of(e, ["domain", "status"], ["id"], 5).groupBy("domain", "status").agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return e.groupBy("domain", "status").agg(F.count("*").alias("n")).join(samples, ["domain", "status"]).select("domain", "status", "samples", "n")


@query("w08_overfetch_rerank", E + """, near AS (SELECT e.id, e.domain, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS score, e.ais
FROM embeddings v JOIN entries e ON e.id = v.vec_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
pool AS (SELECT * FROM near ORDER BY score DESC, id LIMIT 40)
SELECT id, round(score * (1 + coalesce(ais, 0) / 1000), 6) AS reranked FROM pool ORDER BY score * (1 + coalesce(ais, 0) / 1000) DESC, id LIMIT 10""")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hits for one stated vector: four times as many are fetched by likeness, scored again and cut."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id = 0").select("embedding").first()[0]
    known = v.join(entries(spark, sf_dir).select(F.col("id").alias("vec_id"), "ais"), "vec_id")
    pool = ve.search(known, asked, 4 * 10, least=-2.0)
    return pool.withColumn("new", F.col("score") * (1 + F.coalesce("ais", F.lit(0.0)) / 1000)).orderBy(F.col("new").desc(), "vec_id").limit(10).select(F.col("vec_id").alias("id"), F.round("new", 6).alias("reranked"))


@query("s25_delete_source", "SELECT vec_id, label FROM embeddings WHERE label IS DISTINCT FROM 3")
def s25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector store without the points of one source."""
    return table(spark, sf_dir, "embeddings").where(~F.col("label").eqNullSafe(3)).select("vec_id", "label")


@query("a19_batch_validation", E + f"SELECT domain, count(*) AS total, count(*) FILTER ({_ERR} = 0) AS valid, count(*) FILTER ({_ERR} <> 0) AS invalid FROM entries GROUP BY domain")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and invalid entries of each domain's batch."""
    e = entries(spark, sf_dir).select("domain", (F.size(qu.entry_errors(DOMAINS)) == 0).alias("ok"))
    return e.groupBy("domain").agg(F.count("*").alias("total"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


@query("r37_severity_rollup", E + """SELECT domain, count(*) FILTER (tier IS NULL OR tier = 'tier_unknown') AS critical,
count(*) FILTER (tags IS NULL) + count(*) FILTER (coalesce(tier, '') <> 'tier_1_official' AND list_contains(topics, 'health')) AS warnings FROM entries GROUP BY domain""")
def r37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical findings are tiers that are unknown; warnings are missing tags and sensitive topics without an official source."""
    t = F.coalesce("tier", F.lit(""))
    sensitive = (t != "tier_1_official") & F.array_contains("topics", "health")
    return entries(spark, sf_dir).groupBy("domain").agg(F.count_if(t.isin("", "tier_unknown")).alias("critical"), (F.count_if(F.col("tags").isNull()) + F.count_if(sensitive)).alias("warnings"))


@query("st8_source_errors", "SELECT user_id AS source_id, count(*) AS fail_count, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last_error, max(ts) AS last_seen FROM events WHERE value < 10 GROUP BY user_id")
def st8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each source: how many, the last one's message and time; events of low value stand in for failures."""
    failed = table(spark, sf_dir, "events").where("value < 10")
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return failed.groupBy(F.col("user_id").alias("source_id")).agg(F.count("*").alias("fail_count"), last.alias("last")).select("source_id", "fail_count", F.col("last.event_type").alias("last_error"), F.col("last.ts").alias("last_seen"))


_TOKENS = "list_distinct([x FOR x IN regexp_split_to_array(lower({}), '[^a-z0-9äöüß]+') IF length(x) >= 3])"


@query(
    "r26_scenario_overlap",
    E + f""", told AS (SELECT id, {_TOKENS.format("coalesce(title_de, '') || ' ' || url")} AS r, {_TOKENS.format("array_to_string(topics, ' ') || ' example org ' || lang")} AS s FROM entries)
SELECT id, round(CASE WHEN len(r) = 0 OR len(s) = 0 THEN 0 ELSE len(list_intersect(r, s)) / least(len(r), len(s)) END, 6) AS overlap FROM told""",
)
def r26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the smaller token set that a resource and its scenario have in common."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9äöüß]+"), lambda x: F.length(x) >= 3))
    resource, scenario = tokens(F.concat_ws(" ", F.coalesce("title_de", F.lit("")), "url")), tokens(F.concat_ws(" ", F.array_join("topics", " "), F.lit("example org"), "lang"))
    e = entries(spark, sf_dir).select("id", resource.alias("r"), scenario.alias("s"))
    least = F.least(F.size("r"), F.size("s"))
    return e.select("id", F.round(F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect("r", "s")) / least), 6).alias("overlap"))
