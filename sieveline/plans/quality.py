"""Validation, review and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import evaluation
from sieveline.operators import quality as op
from sieveline.operators.ranking import first_of
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources.entries import DOMAINS, ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL} "
_OK = "coalesce(trim({c}), '') = ''"
_ERR = f"""(({_OK.format(c='title_de')})::INT + ({_OK.format(c='url')})::INT + (NOT regexp_matches(url, '^https?://[^/\\s]+'))::INT + (status NOT IN ('active', 'discontinued', 'archived', 'under_revision'))::INT + coalesce((iqs < 0 OR iqs > 100)::INT, 0))"""
_WARN = f"(({_OK.format(c='summary_de')})::INT + ({_OK.format(c='title_en')})::INT + (tags IS NULL)::INT + coalesce((length(title_de) > 200)::INT, 0))"


@query("d01_validation", E + f"SELECT id, {_ERR} AS errors, {_WARN} AS warnings FROM entries")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", F.size(op.entry_errors(DOMAINS)).alias("errors"), F.size(op.entry_warnings()).alias("warnings"))


@query("a18_validation_report", E + f"SELECT domain, count(*) AS entries, sum({_ERR}) AS errors, sum({_WARN}) AS warnings, count(*) FILTER ({_ERR} = 0) AS valid FROM entries GROUP BY domain")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).select("domain", F.size(op.entry_errors(DOMAINS)).alias("e"), F.size(op.entry_warnings()).alias("w"))
    return e.groupBy("domain").agg(F.count("*").alias("entries"), F.sum("e").alias("errors"), F.sum("w").alias("warnings"), F.count_if(F.col("e") == 0).alias("valid"))


@query("d04_lint_messages", E + f"SELECT w AS warning, count(*) AS n FROM (SELECT unnest([CASE WHEN {_OK.format(c='summary_de')} THEN 'no summary' END, CASE WHEN {_OK.format(c='title_en')} THEN 'no english title' END, CASE WHEN tags IS NULL THEN 'no tags' END, CASE WHEN length(title_de) > 200 THEN 'title is long' END]) AS w FROM entries) WHERE w IS NOT NULL GROUP BY w")
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(F.explode(op.entry_warnings()).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


@query("d06_important_changes", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'p_name' ELSE '' END AS important FROM part")
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id").select("id", "p_name", "p_size")
    new = p.select("id", F.when(F.col("id") % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"), F.when(F.col("id") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return op.diff(p, new, "id").select("id", F.array_join(op.important("modified", ["p_name"]), ",").alias("important"))


@query("d08_review_decisions", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'approved' WHEN o_orderkey % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status FROM orders")
def d08(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("status"))
    d = q.where("id % 3 <> 2").select("id", F.when(F.col("id") % 3 == 0, "accept").otherwise("reject").alias("decision"))
    return op.decide(q, d, "id")


@query("d10_metadata_enrichment", E + "SELECT id, CASE WHEN tier IS NULL OR tier = 'tier_unknown' THEN 'tier_3_press' ELSE tier END AS tier, coalesce(jurisdiction, upper(lang)) AS jurisdiction FROM entries")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumns({"suggested_tier": F.lit("tier_3_press"), "suggested_jurisdiction": F.upper("lang")})
    return op.enriched(e, {"tier": "suggested_tier", "jurisdiction": "suggested_jurisdiction"}).select("id", "tier", "jurisdiction")


@query("d12_source_audit", E + "SELECT domain, count(*) AS n, count(*) FILTER (tier IS NULL) AS no_tier, count(*) FILTER (status = 'active' AND source_unavailable) AS dead, count(*) FILTER (iqs IS NULL) AS unscored, count(DISTINCT host) AS hosts FROM entries GROUP BY domain")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("tier").isNull()).alias("no_tier"), F.count_if((F.col("status") == "active") & F.col("source_unavailable")).alias("dead"), F.count_if(F.col("iqs").isNull()).alias("unscored"), F.countDistinct("host").alias("hosts"))


@query("d17_gold_checks", E + """, h AS (SELECT lang, title_de, url, domain, id, row_number() OVER (PARTITION BY lang ORDER BY coalesce(ais, -1) DESC, id) AS place FROM entries),
t AS (SELECT lang, lower(string_agg(coalesce(title_de, '') || ' ' || coalesce(url, ''), ' ' ORDER BY place)) AS corpus, any_value(lower(coalesce(title_de, '') || ' ' || coalesce(url, ''))) FILTER (place = 1) AS best, coalesce(lower(string_agg(coalesce(title_de, '') || ' ' || coalesce(url, ''), ' ' ORDER BY place) FILTER (domain = 'contacts')), '') AS contacts, list(domain) AS domains FROM h WHERE place <= 8 GROUP BY lang),
c AS (SELECT lang, [{'id': 'life_event', 'pass': lang = 'de'}, {'id': 'required_domains_all', 'pass': list_has_all(domains, ['aid', 'tools'])}, {'id': 'required_domains_any', 'pass': list_has_any(domains, ['contacts'])}, {'id': 'expected_terms_any', 'pass': contains(corpus, 'the ') OR contains(corpus, 'zz')},
    {'id': 'expected_terms_top1', 'pass': contains(best, 'src1')}, {'id': 'blocked_terms_absent', 'pass': NOT contains(corpus, '/fr/')}, {'id': 'contact_keywords_any', 'pass': contains(contacts, 'src')}] AS checks FROM t),
u AS (SELECT lang, unnest(checks) AS k FROM c) SELECT lang, k.id AS check_id, k.pass AS passed FROM u WHERE k.id <> 'expected_terms_top1' OR lang <> 'es'""")
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven checks of the eight best entries of each language; one language states six."""
    best = first_of(entries(spark, sf_dir).withColumn("o", F.struct(-F.coalesce("ais", F.lit(-1.0)), "id")), ["lang"], ["o"], 8)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("o", F.struct(F.col("title_de").alias("title"), "url", "domain").alias("r")))), lambda x: x["r"])
    words = lambda *w: F.array(*map(F.lit, w))
    case = {"expected_life_event": F.lit(" de "), "required_domains_all": words("aid", "tools"), "required_domains_any": words("contacts"), "expected_terms_any": words("THE ", "zz"), "expected_terms_top1": F.when(F.col("lang") != "es", words("src1")), "blocked_terms_any": words("/FR/"), "contact_keywords_any": words("src")}
    checked = best.groupBy("lang").agg(listed.alias("results")).select("lang", F.explode(evaluation.retrieval_checks(case, F.array("lang"), F.col("results"))).alias("k"))
    return checked.select("lang", F.col("k.id").alias("check_id"), F.col("k.pass").alias("passed"))


@query("d18_answer_checks", """WITH a AS (SELECT conv_id, turn, replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS t, turn % 3 AS k FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, k, [{'id': 'must_mention_any', 'pass': contains(t, 'the') OR contains(t, 'ae')}, {'id': 'must_mention_all', 'pass': contains(t, 'a') AND contains(t, 'en')}, {'id': 'required_sources_any', 'pass': contains(t, 'https://b.de') OR turn % 2 = 0}, {'id': 'must_not_mention', 'pass': NOT contains(t, 'ough')},
    {'id': 'min_cited_sources', 'pass': turn % 4 >= 2}, {'id': 'unsupported_claims', 'pass': turn % 5 <> 0}, {'id': 'query_specificity', 'pass': turn % 7 <> 3}] AS ks FROM a), u AS (SELECT conv_id, turn, k, unnest(ks) AS x FROM c)
SELECT conv_id, turn, list(x.id ORDER BY x.id) AS made, bool_and(x.pass) AS passed, list(x.id ORDER BY x.id) FILTER (x.pass) AS held FROM u WHERE k <> 0 OR x.id IN ('unsupported_claims', 'query_specificity') GROUP BY conv_id, turn""")
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of every answer; a third of the cases state nothing, so only the two that are always made are."""
    words = lambda *w: F.when(F.col("turn") % 3 != 0, F.array(*map(F.lit, w)))
    t = F.col("turn")
    case = {"must_mention_any": words("THE", "ä"), "must_mention_all": words("a", "en"), "required_sources_any": words("https://B.de"), "must_not_mention": words("ough"), "min_cited_sources": F.when(t % 3 != 0, 2)}
    sources = F.when(t % 2 == 0, F.array(F.lit("x"), F.lit("https://b.de/1")))
    checks = evaluation.answer_checks(case, F.col("text"), sources, t % 4, F.when(t % 5 == 0, 1).otherwise(0), F.when(t % 7 == 3, False))
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", checks.alias("c"))
    ids = lambda c: F.array_sort(F.transform(c, lambda x: x["id"]))
    held = ids(F.filter("c", lambda x: x["pass"]))
    return a.select("conv_id", "turn", ids(F.col("c")).alias("made"), evaluation.passed(F.col("c")).alias("passed"), F.when(F.size(held) > 0, held).alias("held"))
