"""Projections, ids, and row shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import text as fx
from sieveline.operators import shaping as op
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL} "


@query("p01_quality_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("p02_multilingual", E + "SELECT id, array_to_string(list_filter(['de', 'en', 'easy_de'], lambda x: CASE x WHEN 'de' THEN coalesce(title_de, '') <> '' WHEN 'en' THEN coalesce(title_en, '') <> '' ELSE coalesce(title_easy_de, '') <> '' END), ',') AS languages FROM entries")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = op.multilingual({"de": F.col("title_de"), "en": F.col("title_en"), "easy_de": F.col("title_easy_de")})
    return entries(spark, sf_dir).select("id", F.coalesce(F.array_join(F.map_keys(m), ","), F.lit("")).alias("languages"))


@query("p03_entry_shape", E + "SELECT id, domain, coalesce(title_de, title_en, '') AS title, url, status, coalesce(iqs, 0) AS iqs, strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ') AS last_seen FROM entries")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", "domain", F.coalesce("title_de", "title_en", F.lit("")).alias("title"), "url", "status", F.coalesce("iqs", F.lit(0.0)).alias("iqs"), F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_seen"))


@query("p05_first_text", E + "SELECT id, coalesce(CASE WHEN trim(title_easy_de) <> '' THEN title_easy_de END, CASE WHEN trim(title_en) <> '' THEN title_en END, CASE WHEN trim(title_de) <> '' THEN title_de END) AS title FROM entries")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", fx.first_text("title_easy_de", "title_en", "title_de").alias("title"))


@query("p06_text_blob", E + "SELECT id, md5(lower(concat_ws(' ', title_de, summary_de, content_de, array_to_string(topics, ' ')))) AS blob_md5 FROM entries")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", F.md5(F.lower(F.concat_ws(" ", "title_de", "summary_de", "content_de", F.array_join("topics", " ")))).alias("blob_md5"))


@query("p13_page_counts", E + "SELECT domain, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages_at_least_one FROM entries WHERE status = 'active' GROUP BY domain")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.ceil(F.count("*") / 20.0).cast("long")
    return entries(spark, sf_dir).where("status = 'active'").groupBy("domain").agg(F.count("*").alias("total"), pages.alias("pages"), F.greatest(F.lit(1), pages).cast("long").alias("pages_at_least_one"))


@query("p14_provenance", E + "SELECT id, source || '|' || coalesce(tier, '') || '|' || md5(content_de) AS provenance FROM entries")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct("source", F.coalesce("tier", F.lit("")).alias("tier"), F.md5("content_de").alias("checksum"))
    return entries(spark, sf_dir).select("id", s.alias("p")).select("id", F.concat_ws("|", "p.source", "p.tier", "p.checksum").alias("provenance"))


_PERCENT = "SELECT event_id, CAST(CAST(round(CAST(value AS DECIMAL(28,10)), 1) AS DECIMAL(28,1)) AS VARCHAR) || '%' AS similarity FROM events"


@query("p17_result_format", _PERCENT)
@query("p17_result_format_all", _PERCENT)
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event under either name."""
    return table(spark, sf_dir, "events").select("event_id", op.percent(F.col("value")).alias("similarity"))


@query("p18_citations", "SELECT conv_id, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || role AS citation FROM conversations")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("["), n.cast("string"), F.lit("] "), "role").alias("citation"))


@query("s11_size_batches", "WITH r AS (SELECT doc_id, doc_id // 100 AS stripe, n_chars, sum(n_chars) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - n_chars AS before FROM documents) SELECT stripe, before // 20000 AS batch, count(*) AS n, sum(n_chars) AS chars FROM r GROUP BY ALL")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("stripe", F.floor(F.col("doc_id") / 100))
    return op.batches(d, ["stripe"], ["doc_id"], "n_chars", 20_000).groupBy("stripe", "batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("s17_cache_ids", "SELECT page_id, left(md5(url), 12) AS cache_id FROM pages")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.md5("url"), 1, 12).alias("cache_id"))


@query("s24_point_ids", "SELECT page_id, CAST(CAST('0x' || left(sha1(url), 16) AS UBIGINT) AS VARCHAR) AS point_id FROM pages")
def s24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.conv(F.substring(F.sha1("url"), 1, 16), 16, 10).alias("point_id"))


@query("s12_compacted", "SELECT doc_id, length(left(text, 12000)) AS kept FROM documents")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.substring("text", 1, 12000)).alias("kept"))


@query("s18_error_registry", "SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') >= 3 AS skip FROM events GROUP BY user_id")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("failures"), (n >= 3).alias("skip"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"


@query("x01_url_forms", f"SELECT page_id, {_HOST} AS host, regexp_replace(lower(trim(url)), '/+$', '') AS plain, regexp_replace(url, '[?#].*$', '') AS bare, regexp_replace(trim(url), '/$', '') AS one_slash FROM pages")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", fx.host(u).alias("host"), fx.plain_url(u).alias("plain"), fx.bare_url(u).alias("bare"), fx.one_slash(u).alias("one_slash"))


@query("x02_canonical_url", "SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || '/' || array_to_string([x FOR x IN string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') IF x <> ''], '/') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM (SELECT *, array_to_string(list_sort([p FOR p IN string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') IF p <> '' AND NOT starts_with(p, 'utm_') AND string_split(p, '=')[1] NOT IN ('fbclid', 'gclid', 'ref', 'source', 'mc_cid', 'mc_eid')]), '&') AS q FROM pages)")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fx.canonical_url(F.col("url")).alias("canonical"))


@query("x03_domain_of_host", E + "SELECT id, list_contains(['src0.example.org', 'src5.example.org'], host) AS listed FROM entries")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", F.col("host").isin("src0.example.org", "src5.example.org").alias("listed"))
