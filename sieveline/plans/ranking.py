"""Orders, pages, and ranked picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import filters as fl
from sieveline.operators import answers
from sieveline.operators import ranking as op
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL} "
_PRIORITY = "CASE coalesce(tier, 'tier_unknown') WHEN 'tier_1_official' THEN 0 WHEN 'tier_2_ngo_watchdog' THEN 1 WHEN 'tier_4_academic' THEN 2 WHEN 'tier_3_press' THEN 3 ELSE 4 END, coalesce(ais, 0) DESC, coalesce(iqs, 0) DESC, last_seen DESC NULLS LAST, first_seen DESC NULLS LAST, id"


@query("w01_source_priority", E + f"SELECT id, row_number() OVER (PARTITION BY domain ORDER BY {_PRIORITY}) AS place FROM entries")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.placed(entries(spark, sf_dir).select("id", "domain", "tier", "ais", "iqs", "last_seen", "first_seen"), "domain", op.source_priority()).select("id", "place")


@query("w02_match_field_order", E + "SELECT id FROM entries WHERE content_de ILIKE '%tion%' ORDER BY CASE WHEN title_de ILIKE '%tion%' THEN 0 WHEN summary_de ILIKE '%tion%' THEN 1 ELSE 2 END, first_seen DESC, id LIMIT 50")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fl.text_search(entries(spark, sf_dir), "tion", ["content_de"])
    field = F.when(F.col("title_de").ilike("%tion%"), 0).when(F.col("summary_de").ilike("%tion%"), 1).otherwise(2)
    return op.page(e, [field, F.col("first_seen").desc(), "id"], 1, 50).select("id")


@query("w04_pagination", E + f"SELECT id, domain FROM entries WHERE status = 'active' ORDER BY {_PRIORITY} LIMIT 20 OFFSET 40")
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page(fl.equal_filters(entries(spark, sf_dir), status="active"), op.source_priority(), 3, 20).select("id", "domain")


_FIELDS = ["title_de", "title_en", "title_easy_de", "summary_de", "summary_en", "content_de"]
_TERMS = ["thon", "eau"]
_SCORE = " + ".join(f"CASE WHEN {' OR '.join(f'coalesce({c} ILIKE {chr(39)}%{t}%{chr(39)}, FALSE)' for c in _FIELDS)} THEN 1 ELSE 0 END" for t in _TERMS)


@query("w05_prefetch", E + f"SELECT id, term_score FROM (SELECT *, {_SCORE} AS term_score FROM entries) WHERE term_score > 0 ORDER BY term_score DESC, {_PRIORITY} LIMIT 24")
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fl.terms_search(entries(spark, sf_dir), _TERMS, _FIELDS)
    return e.orderBy(F.col("term_score").desc(), *op.source_priority()).limit(24).select("id", "term_score")


@query("w06_rerank_top", E + "SELECT id, iqs / 100 AS score FROM entries WHERE iqs / 100 > 0.5 ORDER BY score DESC, ais DESC, id LIMIT 6")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).withColumn("score", F.col("iqs") / 100).where("score > 0.5").orderBy(F.col("score").desc(), F.col("ais").desc(), "id").limit(6).select("id", "score")


@query("w09_keep_first", E + "SELECT content_de IS NOT NULL AS has_text, min(id) AS id FROM entries GROUP BY md5(content_de), content_de IS NOT NULL")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).select("id", F.md5("content_de").alias("key"), F.col("content_de").isNotNull().alias("has_text"))
    return e.groupBy("key", "has_text").agg(F.min("id").alias("id")).select("has_text", "id")


_LAST = "SELECT user_id, event_type AS last_type, CAST(ts AS VARCHAR) AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) AS n FROM events) WHERE n = 1"


@query("w10_keep_last", _LAST)
@query("w10_keep_last_all", _LAST)
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user under either name."""
    last = op.last_of(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "ts"])
    text = F.regexp_replace(F.regexp_replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "0+$", ""), r"\.$", "")
    return last.select("user_id", F.col("event_type").alias("last_type"), text.alias("last_ts"))


@query("w11_best_score", E + "SELECT id, host FROM (SELECT id, host, row_number() OVER (PARTITION BY host ORDER BY coalesce(iqs, 0) DESC, id) AS n FROM entries) WHERE n = 1")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumn("score", F.coalesce("iqs", F.lit(0.0)))
    return op.best_or_keyless(e, "host", "score", "id").select("id", "host")


@query("w14_lane_split", E + "SELECT lane, id FROM (SELECT coalesce(tier, 'none') AS lane, id, row_number() OVER (PARTITION BY coalesce(tier, 'none') ORDER BY ais DESC NULLS LAST, id) AS n FROM entries) WHERE n <= 5")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumn("lane", F.coalesce("tier", F.lit("none")))
    return op.first_of(e, ["lane"], [F.col("ais").desc_nulls_last(), "id"], 5).select("lane", "id")


_DIVERSE = """, r AS (SELECT lang AS q, domain, id, row_number() OVER (PARTITION BY lang ORDER BY ais DESC NULLS LAST, id) AS place FROM entries),
s AS (SELECT *, row_number() OVER (PARTITION BY q, domain ORDER BY place) AS nth FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY nth <> 1, place) AS lead FROM s)
SELECT q, id, domain, position FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN place = 1 THEN 0 WHEN nth = 1 AND lead <= 4 THEN 1 ELSE 2 END, place) AS position FROM t) WHERE position <= 8"""


@query("w12_diversify", E + _DIVERSE)
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumnRenamed("lang", "q")
    return op.diversify(e, "q", "domain", [F.col("ais").desc_nulls_last(), "id"], 4, 8).select("q", "id", "domain", "position")


@query("w18_resource_packs", E + "SELECT domain, jurisdiction, id FROM (SELECT *, row_number() OVER (PARTITION BY domain, jurisdiction ORDER BY id % 13 = 0 DESC, iqs DESC NULLS LAST, id) AS n FROM entries WHERE coalesce(iqs, 0) >= 2.5) WHERE n <= 4")
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).where(F.coalesce("iqs", F.lit(0.0)) >= 2.5).withColumn("pinned", F.col("id") % 13 == 0)
    return op.first_of(e, ["domain", "jurisdiction"], [F.col("pinned").desc(), F.col("iqs").desc_nulls_last(), "id"], 4).select("domain", "jurisdiction", "id")


@query("w21_severity_sort", "SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS severity FROM events ORDER BY severity, value DESC, event_id LIMIT 40")
def w21(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    s = F.when(t == "error", 0).when(t == "purchase", 1).otherwise(2)
    return table(spark, sf_dir, "events").withColumn("severity", s).orderBy("severity", F.col("value").desc(), "event_id").limit(40).select("event_id", "severity")


@query("w22_key_sentences", """WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: length(x) > 20 AND length(x) < 200)) AS s,
    generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: length(x) > 20 AND length(x) < 200), 1) AS n FROM documents),
p AS (SELECT *, CASE WHEN regexp_matches(s, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(s, '^(?i:You (?:can|must|should|need|are)|The |To |If you|When|Important)') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(s), 'eligible|required|must|can apply|deadline|amount|benefit') THEN 1 ELSE 0 END AS p FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, n) AS k FROM p)
SELECT d.doc_id, coalesce(list(s ORDER BY k) FILTER (k <= 5), []) AS points FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""")
def w22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five sentences of each document that say most."""
    return table(spark, sf_dir, "documents").select("doc_id", answers.key_points(F.col("text")).alias("points"))


@query("w24_last_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 8")
def w24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.first_of(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn").desc()], 8).select("conv_id", "turn", "role")


@query("w24_latest_user_message", "SELECT conv_id, max_by(text, turn) AS latest FROM conversations WHERE role = 'user' GROUP BY conv_id")
def w24_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("latest"))


@query("w25_conversation_prune", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations) WHERE a <= 2 OR z <= 10")
def w25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ends(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 2, 10).select("conv_id", "turn")


@query("w27_token_budget", "WITH t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS size FROM conversations), r AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM t) SELECT conv_id, turn, CAST(CASE WHEN e <= 300 THEN size ELSE 300 - (e - size) END AS BIGINT) AS included, e > 300 AS cut FROM r WHERE e <= 300 OR 300 - (e - size) > 50")
def w27(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.ceil(F.length("text") / 4.0).cast("long")
    return op.pack(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], size, 300, 50).select("conv_id", "turn", "included", "cut")


@query("w28_context_size", "SELECT conv_id, turn, CASE WHEN n <= 5 THEN 3 WHEN n <= 15 THEN 5 ELSE 8 END AS context FROM (SELECT conv_id, turn, len(string_split(trim(text), ' ')) AS n FROM conversations)")
def w28(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split(F.trim("text"), " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(n <= 5, 3).when(n <= 15, 5).otherwise(8).alias("context"))


@query("w31_newest_first", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def w31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100).select("o_orderkey")


@query("w32_lowest_quality", E + "SELECT id, iqs FROM entries WHERE iqs < 50 OR ais < 50 ORDER BY iqs, id LIMIT 20")
def w32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.low_quality(entries(spark, sf_dir)).orderBy(F.col("iqs").asc_nulls_last(), "id").limit(20).select("id", "iqs")


@query("w34_assistive_contacts", E + "SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY ais DESC NULLS LAST, id) AS place FROM (SELECT id, ais FROM (SELECT *, row_number() OVER (PARTITION BY host, lang ORDER BY id) AS nth FROM entries WHERE domain = 'contacts') WHERE nth = 1)) WHERE place <= 5")
def w34(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = op.first_of(entries(spark, sf_dir).where("domain = 'contacts'"), ["host", "lang"], ["id"]).orderBy(F.col("ais").desc_nulls_last(), "id").limit(5)
    return e.select("id", F.row_number().over(Window.orderBy(F.col("ais").desc_nulls_last(), "id")).alias("place"))
