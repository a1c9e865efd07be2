"""Packs, curated confidence, contacts, routes, fixtures and documented sources as queries; SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import packs as op
from sieveline.operators import plain
from sieveline.operators.ranking import first_of
from sieveline.operators.rules import Pack
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL}"
PIN = "https://www.src6.example.org/en/6"
SCENARIOS = (op.Scenario("loss", Pack(("thon", "eau"), ("ness",), ("/en/",), ("ing",), ("src",), ("aid", "contacts")), required=("the", "de "), blocked=("oughtest",), pins={"documents": (PIN,), "ngo_assistance": (PIN,)}), op.Scenario("move", Pack(("zzzz",), ("/fr/", "/es/"), (), ("ció",), (), ("tools",))))


def _has(c: str, *words: str) -> str:
    return "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"


_ENTRIES = E + """, b AS (SELECT id, url, domain, coalesce(tier, '') AS tier, id % 9 = 0 AS is_ngo, replace(replace(replace(replace(lower(coalesce(title_de, '') || ' ' || coalesce(content_de, '')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS t,
    replace(replace(replace(replace(lower(coalesce(title_de || ' ', '') || coalesce(url || ' ', '') || domain), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS f FROM entries WHERE coalesce(url, '') <> ''),
n AS (SELECT *, is_ngo OR tier IN ('tier_2_ngo_watchdog', 'tier_3_ngo') AS ngo, tier IN ('tier_1_law', 'tier_1_official', 'tier_2_official') AS official, tier IN ('tier_1_law', 'tier_1_official', 'tier_2_official', 'tier_2_ngo_watchdog', 'tier_3_ngo', 'tier_3_press', 'tier_4_academic', 'tier_4_other') AS valid FROM b)
"""


@query("d15_resource_packs", _ENTRIES + f""", s AS (
    SELECT 'loss' AS scenario, *, 3 * {_has('t', 'thon', 'eau')} + 2.25 * {_has('t', 'ness')} + 2 * {_has('t', '/en/')} + 1.5 * {_has('t', 'ing')} + 1.5 * {_has('t', 'src')} + (domain IN ('aid', 'contacts'))::INT + 0.75 * official::INT + 0.5 * ngo::INT AS score,
        {_has('f', 'thon', 'eau', 'ness', '/en/', 'ing', 'src')} > 0 AS shown, (contains(t, 'the') OR contains(t, 'de ')) AND NOT contains(t, 'oughtest') AS fits FROM n
    UNION ALL SELECT 'move', *, 3 * {_has('t', 'zzzz')} + 2.25 * {_has('t', '/fr/', '/es/')} + 1.5 * {_has('t', 'ció')} + (domain = 'tools')::INT + 0.75 * official::INT + 0.5 * ngo::INT, {_has('f', 'zzzz', '/fr/', '/es/', 'ció')} > 0, TRUE FROM n),
x AS (
    SELECT scenario, 'documents' AS lane, 0 AS kind, 1.0 AS o, id, url FROM s WHERE scenario = 'loss' AND url = '{PIN}' AND valid UNION ALL SELECT scenario, 'ngo_assistance', 0, 1.0, id, url FROM s WHERE scenario = 'loss' AND url = '{PIN}' AND valid
    UNION ALL SELECT scenario, 'documents', 1, -score, id, url FROM s WHERE domain <> 'contacts' AND official AND fits AND shown AND score >= 2.5 UNION ALL SELECT scenario, 'contacts', 1, -score, id, url FROM s WHERE domain = 'contacts' AND valid AND fits AND shown AND score >= 2.5
    UNION ALL SELECT scenario, 'ngo_assistance', 1, -score, id, url FROM s WHERE domain <> 'organizations' AND valid AND ngo AND fits AND shown AND score >= 2.5 UNION ALL SELECT scenario, 'ngo_assistance', 2, -score, id, url FROM s WHERE domain <> 'organizations' AND valid AND ngo AND shown AND score >= 1.5),
u AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY scenario, lane, url ORDER BY kind, o, id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY scenario, lane ORDER BY kind, o, id) AS n, count(*) FILTER (kind < 2) OVER (PARTITION BY scenario, lane) AS own FROM u)
SELECT scenario, lane, row_number() OVER (PARTITION BY scenario, lane ORDER BY n) AS place, id, url FROM r WHERE kind < 2 AND n <= CASE lane WHEN 'documents' THEN 10 ELSE 5 END OR kind = 2 AND n <= 3""")
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs of two scenarios: one with a pin and guards, one that few entries fit."""
    e = entries(spark, sf_dir)
    blob = F.concat(F.coalesce("title_de", F.lit("")), F.lit(" "), F.coalesce("content_de", F.lit("")))
    return op.scenario_packs(e.select("id", "url", F.col("title_de").alias("title"), "domain", "tier", F.when(F.col("id") % 9 == 0, "ngo").alias("institution"), blob.alias("blob")), SCENARIOS)


_TITLES = ("Arbeitslos melden", "Dienststellen", "Energieschulden", "Bürgergeld online", "Antrag und Bescheid", "Finanziell absichern", "Einkommen ergänzen", "Freiwillige Arbeitslosenversicherung", "Einkommen", "Widerspruch beim Arbeitslos melden")


@query("r29_curated_confidence", E + """ SELECT id, CASE WHEN id % 3 = 0 OR id % 10 = 8 THEN 0.75 ELSE [0.88, 0.8, 0.42, 0.74, 0.72, 0.68, 0.46, 0.4, 0.75, 0.88][CAST(id % 10 AS INT) + 1] END::DOUBLE AS confidence FROM entries""")
def r29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each entry is as a curated resource, with one of ten titles, for two scenarios."""
    k = F.col("id")
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (k % 10).cast("int") + 1)
    url = F.when(k % 10 == 1, F.concat(F.lit("https://web.de/Dienststellen/"), k.cast("string"))).otherwise("https://web.de/")
    return entries(spark, sf_dir).select("id", op.curated_confidence(F.when(k % 3 == 0, "other").otherwise("job_loss_start"), title, url, F.lit(0.75)).alias("confidence"))


@query("r30_contact_ranks", E + """, r AS (SELECT id, host, iqs / 100 + CASE domain WHEN 'contacts' THEN 2 WHEN 'aid' THEN 1 ELSE 0 END + CASE WHEN contains(lower(coalesce(title_de, '')), 'the') OR contains(lower(coalesce(title_de, '')), 'und') THEN 2 ELSE 0 END + CASE WHEN contains(url, '/en/') THEN 2 ELSE 0 END AS v FROM entries WHERE url IS NOT NULL AND iqs IS NOT NULL AND (domain IN ('contacts', 'aid') OR id % 4 = 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY round(v, 6) DESC, id) AS n FROM r) SELECT id, host, round(v, 6)::DOUBLE AS rank FROM n WHERE n <= 5""")
def r30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best contacts of each host among the entries that have a score; every fourth URL says that it is one."""
    url = F.when(F.col("id") % 4 == 0, F.concat("url", F.lit("/Beratung"))).otherwise(F.col("url"))
    rank = op.contact_rank(F.col("domain"), F.col("title_de"), url, F.col("iqs") / 100, ("the", "und"), ("/en/",))
    ranked = entries(spark, sf_dir).where("iqs is not null").select("id", "host", F.round(rank, 6).alias("rank")).where("rank is not null")
    return first_of(ranked, ["host"], [F.col("rank").desc(), "id"], 5)


_ASKED = ("Wo ist das Jobcenter in meiner Stadt", "Sozialhilfe in Leipzig", "Kindergeld und Elterngeld, Familienkasse", "", "Schulden 04109", "Hilfe für Antrag und Pflege", "nichts", "Sozialamt")


@query("w33_routes", """SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN ['service_bund_local_search', 'arbeitsagentur', 'buergergeld'] WHEN 1 THEN ['service_bund_local_search', 'stadt_leipzig_sozialamt', 'kommune_sozialamt'] WHEN 2 THEN CASE WHEN role = 'user' THEN ['familie', 'arbeitsagentur'] END
WHEN 4 THEN ['service_bund_local_search', 'schulden'] WHEN 5 THEN CASE WHEN role = 'user' THEN ['pflege'] END WHEN 7 THEN CASE WHEN role = 'user' THEN ['kommune_sozialamt'] END END AS routes FROM conversations""")
def w33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one of eight questions for each turn is sent; only users' turns have weak evidence."""
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), ((F.col("conv_id") + F.col("turn")) % 8).cast("int") + 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", op.routes(asked, F.col("role") == "user").alias("routes"))


@query("d27_fixtures", """WITH q AS (SELECT item_id, list_filter(string_split(text, '.'), lambda x: trim(x) <> '') AS qs FROM benchmark WHERE item_id % 3 <> 1), e AS (SELECT item_id, qs, generate_subscripts(qs, 1) AS n, unnest(qs) AS query FROM q)
SELECT 'suggested-s' || item_id || '-' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS id, query, 's' || item_id AS expected_life_event, CASE WHEN item_id % 2 = 0 THEN ['aid', 'tools'] ELSE ['aid'] END AS required_domains_any, CASE WHEN item_id % 2 = 0 THEN ['r'] ELSE ['e1', 'e2', 'e3', 'e4', 'e5', 'e6'] END AS expected_terms_any,
[]::VARCHAR[] AS blocked_terms_any, 8 AS top_k FROM e""")
def d27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test case for every sentence of the benchmark's items that have a scenario."""
    b, k = table(spark, sf_dir, "benchmark"), F.col("item_id")
    words = lambda *w: F.array(*map(F.lit, w))
    named = F.concat(F.lit("s"), k.cast("string")).alias("scenario_id")
    suggestions = b.select(named, F.split("text", "[.]").alias("questions"))
    scenarios = b.where(k % 3 != 1).select(named, F.when(k % 2 == 0, words("aid", "tools", "contacts")).otherwise(words("aid")).alias("domains"), F.when(k % 2 == 0, words("r")).alias("required"), words("e1", "e2", "e3", "e4", "e5", "e6", "e7").alias("expansions"), F.lit(None).cast("array<string>").alias("blocked"))
    return op.fixtures(suggestions, scenarios)


@query("j25_documented_sources", """WITH d AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'job' WHEN 1 THEN 'home' WHEN 2 THEN 'lost' END AS s, regexp_replace(regexp_replace(url, '[?].*$', ''), '/+$', '') AS u FROM pages),
x AS (SELECT s AS scenario, 'documents' AS lane, u || '/amt' AS url FROM d WHERE s IN ('job', 'home') UNION SELECT s, 'documents', u || '/a.pdf' FROM d WHERE s IN ('job', 'home') UNION SELECT s, 'contacts', u FROM d WHERE s IN ('job', 'home') UNION SELECT 'job', 'documents', u FROM d WHERE page_id % 5 = 0)
SELECT scenario, lane, lower(url) AS url, count(*) AS n FROM x GROUP BY ALL""")
def j25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack of a fifth of the pages with what half of the pages document; one life event has no scenario, one no pack yet."""
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?].*$", ""), "/+$", "").alias("u"))
    one = lambda end: F.array(F.struct(F.lit("T").alias("title"), F.concat("u", F.lit(end)).alias("url")))
    event = F.when(k % 4 == 0, " JOB").when(k % 4 == 1, "home").when(k % 4 == 2, "lost")
    sources = p.select(event.alias("life_event"), one("/amt").alias("official"), one("/a.pdf").alias("pdfs"), F.lit(None).cast("array<struct<title: string, url: string>>").alias("ngo"), one("/").alias("contacts"))
    old = p.where(k % 5 == 0).select(F.lit("job").alias("scenario"), F.lit("documents").alias("lane"), F.lit("Alt").alias("title"), F.col("u").alias("url"))
    out = op.documented(old, sources, {"job": "job", "home": "home"})
    return out.groupBy("scenario", "lane", F.regexp_replace(F.lower("url"), "/+$", "").alias("url")).agg(F.count("*").alias("n"))


@query("d26_translation_pilot", E + ", f AS (SELECT * FROM entries ORDER BY domain, id LIMIT 100) SELECT id, domain, CASE WHEN trim(coalesce(content_de, '')) <> '' THEN 'translated' ELSE 'error' END AS outcome, CASE WHEN trim(coalesce(content_de, '')) <> '' THEN coalesce(url, '') END AS source, CASE WHEN trim(coalesce(content_de, '')) <> '' THEN 'pending' END AS status FROM f")
def d26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pilot's first hundred entries, and what becomes of each."""
    e = entries(spark, sf_dir).select("id", "domain", F.col("title_de").alias("title"), "url", F.col("content_de").alias("content"), F.col("summary_de").alias("summary"))
    return plain.translation_pilot(e, F.lit("2024-06-01")).select("id", "domain", "outcome", F.col("translation.source").alias("source"), "status")


@query("f34_id_lookup", E + " SELECT id, url FROM entries WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def f34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a list of ids."""
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return entries(spark, sf_dir).select("id", "url").join(ids, "id", "left_semi")
