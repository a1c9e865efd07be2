"""Statistics, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import text as fx
from sieveline.operators import filters as fl
from sieveline.operators import quality
from sieveline.operators import ranking as rk
from sieveline.plans.filters import _GATE
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources import reports
from sieveline.sources.entries import DOMAINS, ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL} "


def _blank(c: str) -> F.Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


@query("a01_entry_statistics", E + "SELECT domain, count(*) AS total, count(*) FILTER (status = 'active') AS active, avg(iqs) AS avg_iqs, avg(ais) AS avg_ais, count(*) FILTER (coalesce(trim(title_en), '') = '') AS missing_en, count(*) FILTER (coalesce(trim(title_easy_de), '') = '') AS missing_easy_de FROM entries GROUP BY domain")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.avg("iqs").alias("avg_iqs"), F.avg("ais").alias("avg_ais"), F.count_if(_blank("title_en")).alias("missing_en"), F.count_if(_blank("title_easy_de")).alias("missing_easy_de"))


@query("a02_domain_status_counts", E + "SELECT domain, status, count(*) AS n FROM entries GROUP BY ALL")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("domain", "status").agg(F.count("*").alias("n"))


@query("a03_queue_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("a04_global_averages", E + "SELECT avg(iqs) AS avg_iqs, avg(ais) AS avg_ais FROM entries WHERE iqs IS NOT NULL AND ais IS NOT NULL")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).where("iqs is not null and ais is not null").agg(F.avg("iqs").alias("avg_iqs"), F.avg("ais").alias("avg_ais"))


_STATES = ["active", "archived", "discontinued", "under_revision"]


@query("a05_status_pivot", E + f"SELECT domain, {', '.join(f'count(*) FILTER (status = {s!r}) AS {s}' for s in _STATES)}, count(*) AS total FROM entries GROUP BY ROLLUP (domain)")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).rollup("domain").agg(*[F.count_if(F.col("status") == s).alias(s) for s in _STATES], F.count("*").alias("total"))


@query("a06_scores_with_missing_as_zero", E + "SELECT avg(coalesce(iqs, 0)) AS avg_iqs, avg(coalesce(ais, 0)) AS avg_ais FROM entries")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).agg(F.avg(F.coalesce("iqs", F.lit(0.0))).alias("avg_iqs"), F.avg(F.coalesce("ais", F.lit(0.0))).alias("avg_ais"))


@query("a07_quality_by_domain", E + "SELECT domain, count(*) AS n, avg(coalesce(iqs, 0)) AS avg_iqs, count(*) FILTER (coalesce(iqs, 0) < 50 OR coalesce(ais, 0) < 50) AS low FROM entries GROUP BY domain")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, a = F.coalesce("iqs", F.lit(0.0)), F.coalesce("ais", F.lit(0.0))
    return entries(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.avg(i).alias("avg_iqs"), F.count_if((i < 50) | (a < 50)).alias("low"))


@query("a08_report_of_all_domains", E + f", dims(domain) AS (VALUES {', '.join(f'({d!r})' for d in DOMAINS)}) SELECT dims.domain, count(e.id) AS n, avg(e.iqs) AS avg_iqs FROM dims LEFT JOIN (SELECT * FROM entries WHERE status = 'archived' AND domain <> 'tools') e ON dims.domain = e.domain GROUP BY dims.domain")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = spark.createDataFrame([(d,) for d in DOMAINS], "domain string")
    agg = entries(spark, sf_dir).where("status = 'archived' and domain <> 'tools'").groupBy("domain").agg(F.count("*").alias("n"), F.avg("iqs").alias("avg_iqs"))
    return F.broadcast(dims).join(agg, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"), "avg_iqs")


@query("a09_total_count", E + "SELECT count(*) AS total FROM entries WHERE status = 'active' AND domain = 'aid'")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.equal_filters(entries(spark, sf_dir), status="active", domain="aid").agg(F.count("*").alias("total"))


@query("a10_source_catalog", E + "SELECT host, count(*) AS n, count(DISTINCT domain) AS domains, avg(CASE WHEN iqs > 0 THEN iqs END) AS avg_iqs, CAST(max(last_seen) AS VARCHAR) AS last_seen, min_by(url, id) AS first_url FROM entries GROUP BY host")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"), F.avg(F.when(F.col("iqs") > 0, F.col("iqs"))).alias("avg_iqs"), F.date_format(F.max("last_seen"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"), F.min_by("url", "id").alias("first_url"))


@query("a11_merged_partials", E + ", h AS (SELECT host, lang, sum(iqs) AS s, count(iqs) AS n FROM entries GROUP BY ALL) SELECT lang, sum(s) / sum(n) AS avg_iqs, sum(n) AS n FROM h GROUP BY lang")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = entries(spark, sf_dir).groupBy("host", "lang").agg(F.sum("iqs").alias("s"), F.count("iqs").alias("n"))
    return parts.groupBy("lang").agg((F.sum("s") / F.sum("n")).alias("avg_iqs"), F.sum("n").alias("n"))


@query("a12_audit_counters", E + "SELECT domain, coalesce(tier, 'none') AS tier, count(*) AS n, count(*) FILTER (status = 'active') AS active, count(DISTINCT host) AS hosts FROM entries GROUP BY ALL")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("domain", F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"), F.countDistinct("host").alias("hosts"))


_PH = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"


@query("a13_top_hosts", f"SELECT host, n FROM (SELECT {_PH} AS host, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, host LIMIT 30")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(fx.host(F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "host").limit(30)


@query("a14_duplicate_url_groups", E + ", k AS (SELECT CASE WHEN id % 4 = 0 THEN 'https://example.org/page/' || (id % 12) ELSE url END AS url, domain FROM entries) SELECT url, count(*) AS n, count(DISTINCT domain) AS domains FROM k WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1 AND count(DISTINCT domain) > 1")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that entries of several domains share; every fourth entry stands under one of three, in two spellings."""
    k = F.col("id")
    spelt = F.when(k % 8 == 0, F.concat(F.lit("HTTPS://Example.org:443/page/"), (k % 12).cast("string"), F.lit("/?utm_source=x"))).otherwise(F.concat(F.lit("https://example.org/./page/"), (k % 12).cast("string")))
    url = fx.canonical_url(F.when(k % 4 == 0, spelt).otherwise(F.col("url")))
    g = entries(spark, sf_dir).select(url.alias("url"), "domain").where("url is not null").groupBy("url").agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"))
    return g.where("n > 1 and domains > 1")


@query("a15_unknown_sources", E + ", u AS (SELECT * FROM entries WHERE tier IS NULL OR tier = 'tier_unknown'), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY id) AS n FROM u) SELECT host, count(*) AS n, array_to_string(list_sort(list_distinct(list(domain))), ',') AS domains, string_agg(CASE WHEN r.n <= 5 THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS samples FROM r GROUP BY host")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = entries(spark, sf_dir).where("tier is null or tier = 'tier_unknown'")
    groups = u.groupBy("host").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))
    # The first five of each host are cut before the shuffle, so no host's rows gather.
    first = rk.first_of(u.select("host", "id"), ["host"], ["id"], 5).groupBy(F.col("host").alias("_host")).agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("samples"))
    return groups.join(first, F.col("host").eqNullSafe(F.col("_host"))).select("host", "n", "domains", "samples")


@query("a16_crawl_metrics", E + "SELECT lang, count(*) AS n, round(avg(iqs), 2) AS avg_iqs, round(avg(ais), 2) AS avg_ais, count(*) FILTER (iqs < 60) AS low FROM entries GROUP BY lang")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("iqs"), 2).alias("avg_iqs"), F.round(F.avg("ais"), 2).alias("avg_ais"), F.count_if(F.col("iqs") < 60).alias("low"))


@query("a16_distributions", E + """, v AS (SELECT 'host' AS kind, host AS value FROM entries WHERE host IS NOT NULL UNION ALL SELECT 'tier', coalesce(tier, 'tier_unknown') FROM entries UNION ALL SELECT 'topic', unnest(topics) FROM entries UNION ALL SELECT 'tag', unnest(tags) FROM entries),
n AS (SELECT kind, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL) SELECT kind, value, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS place FROM n QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) <= 15""")
def a16_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most frequent hosts, tiers, topics and tags of a crawl's entries."""
    e = entries(spark, sf_dir)
    lists = {"host": F.array("host"), "tier": F.array(F.coalesce("tier", F.lit("tier_unknown"))), "topic": F.col("topics"), "tag": F.col("tags")}
    return quality.most_common(e, lists, 15)


@query("a16_low_quality", E + ", l AS (SELECT id, domain, url, iqs, ais, row_number() OVER (PARTITION BY domain ORDER BY id) AS n, count(*) OVER (PARTITION BY domain) AS total FROM entries WHERE iqs < 60 OR ais < 60) SELECT domain, any_value(total) AS low_quality, list(id ORDER BY id) FILTER (n <= 10) AS samples FROM l GROUP BY domain")
def a16_low_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries of each domain have a score below sixty, and the first ten of them."""
    low = entries(spark, sf_dir).where("iqs < 60 or ais < 60").select("domain", "id")
    first = rk.first_of(low, ["domain"], ["id"], 10).groupBy(F.col("domain").alias("_domain")).agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return low.groupBy("domain").agg(F.count("*").alias("low_quality")).join(first, F.col("domain") == F.col("_domain")).select("domain", "low_quality", "samples")


@query("a12_audit_dimensions", E + """, v AS (SELECT status, unnest(['domain:' || domain, 'tier:' || coalesce(tier, 'unknown'), 'jurisdiction:' || coalesce(jurisdiction, 'unknown'), 'host:' || coalesce(host, 'unknown')]) AS k FROM entries)
SELECT split_part(k, ':', 1) AS dimension, substring(k, instr(k, ':') + 1) AS value, count(*) AS n, count(*) FILTER (status = 'active') AS active FROM v GROUP BY k""")
def a12_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and active ones by domain, tier, jurisdiction and host, in one pass."""
    e = entries(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(c, F.lit("unknown")).alias("value")) for d, c in (("domain", "domain"), ("tier", "tier"), ("jurisdiction", "jurisdiction"), ("host", "host"))])
    return e.select("status", F.explode(each).alias("v")).groupBy("v.dimension", "v.value").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"))


@query("a17_promotion_report", E + f"SELECT domain, reason, count(*) AS n FROM (SELECT domain, {_GATE} AS reason FROM entries e) GROUP BY ALL")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return e.groupBy("domain", fl.candidate_gate(e).alias("reason")).agg(F.count("*").alias("n"))


@query("a20_diff_summary", """WITH o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS p_name, p_brand, p_size FROM part WHERE p_partkey % 5 <> 0),
n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END AS p_name, p_brand, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0),
c AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'create' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS type,
    (o.p_name IS NULL AND n.p_name IS NOT NULL)::INT + (o.p_brand IS NULL AND n.p_brand IS NOT NULL)::INT + (o.p_size IS NULL AND n.p_size IS NOT NULL)::INT AS a, coalesce(o.p_name <> n.p_name, FALSE)::INT + coalesce(o.p_brand <> n.p_brand, FALSE)::INT + coalesce(o.p_size <> n.p_size, FALSE)::INT AS m,
    (o.p_name IS NOT NULL AND n.p_name IS NULL)::INT + (o.p_brand IS NOT NULL AND n.p_brand IS NULL)::INT + (o.p_size IS NOT NULL AND n.p_size IS NULL)::INT AS r, coalesce(o.p_name = n.p_name, FALSE)::INT + coalesce(o.p_brand = n.p_brand, FALSE)::INT + coalesce(o.p_size = n.p_size, FALSE)::INT AS u FROM o FULL JOIN n ON o.id = n.id)
SELECT id, type, a AS added_count, m AS modified_count, r AS removed_count, u AS unchanged_count, a + m + r AS total_changes FROM c""")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two versions of every part: names, a size that went, parts that are new or gone."""
    p, k = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id"), F.col("id")
    old = p.where(k % 5 != 0).select("id", F.when(k % 11 != 0, F.col("p_name")).alias("p_name"), "p_brand", "p_size")
    new = p.where(k % 7 != 0).select("id", F.when(k % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"), "p_brand", F.when(k % 4 != 0, F.col("p_size")).alias("p_size"))
    return quality.diff_summary(old, new, "id")


_COST = "CAST(round(value * CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 1.5 ELSE 0.5 END / 1000, 6) AS DECIMAL(18, 6))"


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a cost log: model, feature and cost of each request."""
    price = F.when(F.col("event_type") == "purchase", 3.0).when(F.col("event_type") == "signup", 1.5).otherwise(0.5)
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("model"), F.concat(F.lit("feature"), (F.col("user_id") % 7).cast("string")).alias("feature"), F.round(F.col("value") * price / 1000, 6).cast("decimal(18,6)").alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("a21_cost_by_period", f"SELECT CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, model, CAST(round(sum(cost), 4) AS DOUBLE) AS cost, count(*) AS requests FROM (SELECT ts, event_type AS model, {_COST} AS cost FROM events) GROUP BY GROUPING SETS ((1, model), (1), ())")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = costs(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return c.groupingSets([["day", "model"], ["day"], []], "day", "model").agg(F.round(F.sum("cost"), 4).cast("double").alias("cost"), F.count("*").alias("requests"))


@query("a22_cost_report", f"SELECT model, CAST(round(sum(cost), 4) AS DOUBLE) AS cost, count(*) AS requests, round(CAST(sum(cost) AS DOUBLE) / count(*), 6) AS per_request FROM (SELECT event_type AS model, {_COST} AS cost FROM events) GROUP BY model")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs(spark, sf_dir).groupBy("model").agg(F.round(F.sum("cost"), 4).cast("double").alias("cost"), F.count("*").alias("requests"), F.round(F.sum("cost").cast("double") / F.count("*"), 6).alias("per_request"))


@query("a23_pipeline_stats", "SELECT avg(value) AS mean_latency, count(*) FILTER (value >= 75) * 100.0 / count(*) AS high, count(*) FILTER (value >= 40 AND value < 75) * 100.0 / count(*) AS medium, count(*) FILTER (value < 40) * 100.0 / count(*) AS low FROM events")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    share = lambda c: F.count_if(c) * 100.0 / F.count("*")
    return table(spark, sf_dir, "events").agg(F.avg(v).alias("mean_latency"), share(v >= 75).alias("high"), share((v >= 40) & (v < 75)).alias("medium"), share(v < 40).alias("low"))


@query("a24_path_summary", "SELECT seg, count(*) AS n FROM (SELECT array_to_string([x FOR x IN string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/') IF x <> ''][1:2], '/') AS seg FROM pages) GROUP BY seg ORDER BY n DESC, seg LIMIT 25")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.array_join(F.slice(fx.path_parts(F.col("url")), 1, 2), "/")
    return table(spark, sf_dir, "pages").groupBy(seg.alias("seg")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "seg").limit(25)


_NEEDLES = ("form", "the", "ing")


@query("a25_capability_scores", "SELECT page_id, score, CASE WHEN score >= 40 THEN 'high' WHEN score >= 10 THEN 'medium' ELSE 'low' END AS level FROM (SELECT page_id, " + " + ".join(f"(length(lower(html)) - length(replace(lower(html), '{n}', ''))) // {len(n)}" for n in _NEEDLES) + " AS score FROM pages)")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = sum((F.regexp_count(F.lower("html"), F.lit(n)) for n in _NEEDLES), F.lit(0)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", score.alias("score")).withColumn("level", F.when(F.col("score") >= 40, "high").when(F.col("score") >= 10, "medium").otherwise("low"))


@query("a26_pass_rates", "SELECT avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS cases, avg((quality + 1 - toxic) / 2.0) AS checks, count(*) AS n FROM labels")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("cases"), F.avg((F.col("quality") + 1 - F.col("toxic")) / 2.0).alias("checks"), F.count("*").alias("n"))


@query("a27_coverage_gaps", E + ", t(domain, target) AS (VALUES ('aid', 5), ('tools', 1000000), ('contacts', 150)) SELECT t.domain, t.target, greatest(0, t.target - count(e.id)) AS gap FROM t LEFT JOIN entries e ON t.domain = e.domain AND e.status = 'active' GROUP BY t.domain, t.target")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("aid", 5), ("tools", 1_000_000), ("contacts", 150)], "domain string, target long")
    n = entries(spark, sf_dir).where("status = 'active'").groupBy("domain").agg(F.count("*").alias("n"))
    return F.broadcast(t).join(n, "domain", "left").select("domain", "target", F.greatest(F.lit(0), F.col("target") - F.coalesce("n", F.lit(0))).alias("gap"))


@query("a31_repeated_lines", "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) > 4 GROUP BY ALL HAVING count(*) >= 4")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    return lines.where(F.length("line") > 4).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 4")


@query("a33_facets", E + "SELECT array_to_string(list_sort(list_distinct(list(domain))), ',') AS domains, array_to_string(list_sort(list_distinct(list(tier))), ',') AS tiers, array_to_string(list_sort(list_distinct(list(jurisdiction))), ',') AS jurisdictions FROM entries")
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    facet = lambda c, name: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name)
    return entries(spark, sf_dir).agg(facet("domain", "domains"), facet("tier", "tiers"), facet("jurisdiction", "jurisdictions"))


@query("a34_occurrence_counter", "SELECT sha256(lower(trim(text))) AS key, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations WHERE role = 'user' GROUP BY 1")
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("key")).agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("s06_history_filter", f"SELECT event_id, model, feature FROM (SELECT event_id, ts, event_type AS model, 'feature' || (user_id % 7) AS feature, {_COST} AS cost FROM events) WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND model = 'purchase' AND feature = 'feature3'")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = costs(spark, sf_dir)
    return c.where("ts >= timestamp'2024-01-10' and ts < timestamp'2024-01-20' and model = 'purchase' and feature = 'feature3'").select("event_id", "model", "feature")


@query("s08_json_overlay", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1)).alias("k"))


@query("d19_site_summary", f"SELECT host, count(*) AS pages, count(DISTINCT path) AS paths, sum(length(html)) AS chars FROM (SELECT {_PH} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS path, html FROM pages) GROUP BY host")
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(fx.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.countDistinct(path).alias("paths"), F.sum(F.length("html")).alias("chars"))


@query("a13_top_sources_in_domain", E + "SELECT domain, host, n FROM (SELECT domain, host, count(*) AS n, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, host) AS r FROM entries GROUP BY domain, host) WHERE r <= 3")
def a13_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = entries(spark, sf_dir).groupBy("domain", "host").agg(F.count("*").alias("n"))
    return rk.first_of(n, ["domain"], [F.col("n").desc(), "host"], 3)


@query("s26_markdown_report", E + """, t AS (SELECT domain, count(*) AS entries, count(*) FILTER (status = 'active') AS active, round(avg(iqs), 2) AS iqs FROM entries GROUP BY domain)
SELECT 0 AS n, '## Entries' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| domain | entries | active | note |' UNION ALL SELECT 3, '| --- | --- | --- | --- |'
UNION ALL SELECT 3 + row_number() OVER (ORDER BY entries DESC, domain), '| ' || domain || ' | ' || entries || ' | ' || active || ' | ' || CASE WHEN domain = 'aid' THEN '' ELSE 'a\\|b c' END || ' |' FROM t""")
def s26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by domain as the lines of a Markdown report."""
    t = entries(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "active").alias("active"))
    return reports.markdown(t.withColumn("note", F.when(F.col("domain") != "aid", "a|b\n c")), "Entries", [F.col("entries").desc(), F.col("domain")])


@query("s26_json_report", E + """, t AS (SELECT domain, count(*) FILTER (coalesce(iqs, 100) < 5) AS low FROM entries GROUP BY domain)
SELECT count(*) AS rows, count(*) FILTER (low > 0) AS failed, count(*) FILTER (low > 0) = 0 AS passed, coalesce(string_agg(domain, ',' ORDER BY domain) FILTER (low > 0), '') AS failures FROM t""")
def s26_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report that a build reads: domains with entries of a very low score fail; read again."""
    t = entries(spark, sf_dir).groupBy("domain").agg(F.count_if(F.coalesce("iqs", F.lit(100.0)) < 5).alias("low"))
    r = F.from_json("report", "rows long, failed long, passed boolean, failures array<string>")
    told = reports.summary(t, "quality", F.col("low") > 0).select(r.alias("r")).select("r.*")
    return told.select("rows", "failed", "passed", F.array_join(F.transform("failures", lambda x: F.get_json_object(x, "$.domain")), ",").alias("failures"))
