"""Rule-driven scores, plain language, and the rest of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import text as fx
from sieveline.operators import crawl, filters, plain, quality, topics
from sieveline.operators import ranking as rk
from sieveline.operators import rules as op
from sieveline.plans.filters import _GATE
from sieveline.plans.registry import query
from sieveline.session import numbered, scratch, stash, table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL} "
FOLD = lambda c: f"replace(replace(replace(replace(lower({c}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
_TYPES = ("formular", "weisung", "statute", "website")
_HAS = lambda c, t: f"coalesce(contains({c}, '{t}'), FALSE)::INT"
_HITS = lambda c, ts: " + ".join(f"coalesce(contains({c}, '{t}'), FALSE)::INT" for t in ts)


@query("r06_topic_boost", E + """, t AS (SELECT id, ['formular', 'weisung', 'statute', 'website'][CAST(id % 4 AS INT) + 1] AS kind, topics FROM entries)
SELECT id, round(least(2.0, CASE WHEN kind = 'formular' OR list_has_any(topics, ['family', 'kindergeld', 'health']) THEN 1.6 ELSE 1 END * CASE WHEN kind = 'weisung' OR list_has_any(topics, ['housing', 'kosten_der_unterkunft']) THEN 1.35 ELSE 1 END
    * CASE WHEN kind IN ('formular', 'merkblatt') OR list_has_any(topics, ['family', 'kindergeld', 'health']) THEN 1.2 ELSE 1 END * CASE WHEN kind IN ('statute', 'weisung', 'guide') OR list_has_any(topics, ['application_process', 'financial_support', 'money']) THEN 1.3 ELSE 1 END)::DOUBLE, 6) AS boost FROM t""")
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of the twelve rules are met by the question; two of its topics have one below them."""
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("id") % 4).cast("int") + 1)
    return entries(spark, sf_dir).select("id", F.round(op.topic_boost("Kindergeld Antrag, Miete und Widerspruch", kind, F.col("topics"), {"family": ("health",), "financial_support": ("money",)}), 6).alias("boost"))


_ASK = "the hilfe antrag"
_T, _X = FOLD("title_de"), FOLD("content_de")


@query("r11_entry_score", E + f", s AS (SELECT id, domain, {_T} AS t, lower(content_de) AS x, {_X} AS f FROM entries), p AS (SELECT id, 3.0 * {_HAS('t', 'thon')} + 1.25 * {_HAS('x', 'thon')} + 3.0 * {_HAS('t', 'eau')} + 1.25 * {_HAS('x', 'eau')} + 8 * {_HAS('t', 'ness')} + 4 * {_HAS('f', 'ness')} + 10 * ({_HAS('t', 'ing')} | {_HAS('f', 'ing')}) + 8 * ({_HAS('t', 'ung')} | {_HAS('f', 'ung')}) - 22 * ({_HAS('t', 'scum')} | {_HAS('f', 'scum')}) - 35 * ({_HAS('f', 'sanktion')} | {_HAS('f', 'widerspruch')} | {_HAS('f', 'rechtsberatung')}) - 35 * ({_HAS('f', 'integrationskurs')} | {_HAS('f', 'zugewanderte')} | {_HAS('f', 'migration')} | {_HAS('f', 'gefluechtete')} | {_HAS('f', 'ukraine')}) - 55 * {_HAS('t', 'selbststaendigkeit mit kind')} - 60 * {_HAS('f', 'paroches')} + 3 * {_HAS('x', 'eservices')} + CASE domain WHEN 'aid' THEN 4 WHEN 'contacts' THEN 3.5 WHEN 'benefits' THEN 2.5 WHEN 'tools' THEN 4.5 ELSE 0 END AS v FROM s) SELECT id, CASE WHEN v < 2 THEN v - 3 ELSE v END::DOUBLE AS score FROM p")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"title": F.col("title_de"), "text": F.col("content_de"), "url": F.col("url"), "domain": F.col("domain")}
    return entries(spark, sf_dir).select("id", op.entry_score(_ASK, ["thon", "eau"], ["ness"], ["ing", "ung"], ["scum"], cols).alias("score"))


_TITLES = ("Bürgergeld online beantragen", "Bürgergeld: Antrag und Bescheid", "Einkommen ergänzen", "Arbeitslosengeld", "Jobcenter", "Freiwillige Arbeitslosenversicherung", "Widerspruch", "Integrationskurs")


@query("r11_benefit_score", E + """, s AS (SELECT id, domain, id % 8 AS k, url FROM entries),
p AS (SELECT id, k, domain, CASE k WHEN 0 THEN 3 + 80 + (18 + 5) + 18 WHEN 1 THEN 3 + 48 + (18 + 5) WHEN 2 THEN -45 - 18 WHEN 3 THEN -28 - 18 WHEN 4 THEN 22 - 18 WHEN 5 THEN -70 - 18 WHEN 6 THEN -35 - 18 ELSE -35 - 18 END AS v FROM s),
q AS (SELECT id, v + CASE WHEN domain = 'aid' THEN 6 ELSE 0 END + CASE WHEN k = 0 THEN 2.5 WHEN k = 4 THEN 4 ELSE 0 END + CASE WHEN k IN (0, 1) THEN 4.5 ELSE -16 END + CASE WHEN k = 2 THEN -18 ELSE 0 END + CASE WHEN k = 3 THEN 2.75 + 1.5 ELSE 0 END AS v FROM p)
SELECT id, CASE WHEN v < 2 THEN v - 3 ELSE v END::DOUBLE AS score FROM q""")
def r11_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with one of eight titles as their text too, for a question about the place of an application and a scenario."""
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("id") % 8).cast("int") + 1)
    scenario = op.Scenario(domains={"aid": 6}, terms={"online": 2.5, "jobcenter": 4}, required=("buergergeld",), blocked=("einkommen",), resources=("arbeitslosengeld",))
    score = op.entry_score("Wo kann ich Bürgergeld bekomme", ["buergergeld"], [], [], [], {"title": title, "text": title, "url": F.col("url"), "domain": F.col("domain")}, ["jobcenter", "bekomme"], [scenario])
    return entries(spark, sf_dir).select("id", score.alias("score"))


_SCENARIOS = {"work": ("thon", "the the"), "home": ("eau", "de la"), "law": ("ung",)}
_SSQL = {k: " + ".join(f"{3.0 if ' ' in w else 1.5} * {_HAS('lower(text)', w)}" for w in ws) for k, ws in _SCENARIOS.items()}


@query("r12_scenario_match", """WITH q AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(text || [' Nach-Ausbildung', ' Ausbildung beendet und Umschulung', ' KURZ arbeit', ''][CAST((conv_id + turn) % 4 AS INT) + 1]), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\\p{L}\\p{N}]', ' ', 'g'), ' +', ' ', 'g')) AS q FROM conversations),
m AS (SELECT conv_id, turn, q, replace(q, ' ', '') AS c, string_split(q, ' ') AS w FROM q),
s AS (SELECT conv_id, turn, 'work' AS scenario, 1.5 * contains(c, 'thon')::INT + 3 * (contains(q, 'the the') OR contains(c, 'thethe') OR list_contains(w, 'the'))::INT + 1.5 * (contains(q, 'kurzarbeit') OR contains(c, 'kurzarbeit'))::INT AS score FROM m
UNION ALL SELECT conv_id, turn, 'home', 1.5 * contains(c, 'eau')::INT + 3 * (contains(q, 'de la') OR contains(c, 'dela'))::INT FROM m
UNION ALL SELECT conv_id, turn, 'upskilling', 1.5 * (contains(q, 'ausbildung') OR contains(c, 'ausbildung'))::INT - CASE WHEN contains(c, 'nachausbildung') AND NOT contains(c, 'umschulung') THEN 8 ELSE 0 END FROM m WHERE contains(c, 'ausbildung'))
SELECT conv_id, turn, scenario, score::DOUBLE AS score FROM s WHERE score <> 0""")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios with a keyword in a message, some in two words or put apart; completed training counts against more of it."""
    more = F.element_at(F.array(*map(F.lit, (" Nach-Ausbildung", " Ausbildung beendet und Umschulung", " KURZ arbeit", ""))), ((F.col("conv_id") + F.col("turn")) % 4).cast("int") + 1)
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", more).alias("text"))
    return op.matched_scenarios(said, "text", {"work": ("thon", "the the", "Kurz-Arbeit".replace("-", "").lower()), "home": ("eau", "de la"), "upskilling": ("ausbildung",)})


@query("r14_stage_gap", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, scenario) AS n, lead(score) OVER (PARTITION BY conv_id, turn ORDER BY score DESC, scenario) AS next FROM (SELECT * FROM (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS scenario, ({v})::DOUBLE AS score FROM conversations" for k, v in _SSQL.items()) + ") WHERE score > 0)) SELECT conv_id, turn, scenario, coalesce(score - next < 2, FALSE) AS needs_review FROM r WHERE n = 1")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id", "turn").orderBy(F.col("score").desc(), "scenario")
    low = F.lower("text")
    points = [F.struct(F.lit(k).alias("scenario"), sum((F.when(low.contains(x), 3.0 if " " in x else 1.5).otherwise(0.0) for x in words), F.lit(0.0)).alias("score")) for k, words in _SCENARIOS.items()]
    scored = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(*points)).alias("s")).select("conv_id", "turn", "s.*").where("score > 0")
    r = scored.withColumns({"n": F.row_number().over(w), "next": F.lead("score").over(w)})
    return r.where("n = 1").select("conv_id", "turn", "scenario", F.coalesce(F.col("score") - F.col("next") < 2, F.lit(False)).alias("needs_review"))


_CQ = ["the", "thon", "ing"]
_EV = "lower(coalesce(title_de, '')) || ' ' || lower(content_de)"


@query("r16_context_rerank", E + f"SELECT id, round(0.5 * (1 + ({_HITS(_EV, _CQ)}) / 3.0 * 0.2) * (1 + ({_HITS(chr(108) + 'ower(coalesce(title_de, ' + chr(39) * 2 + '))', _CQ)}) / 3.0 * 0.3) * greatest(0.5, 1 - date_diff('day', CAST(first_seen AS DATE), DATE '2025-01-01') / 365.0 * 0.05) * CASE WHEN length({_EV}) > 500 THEN 1.05 WHEN length({_EV}) < 100 THEN 0.95 ELSE 1 END, 6)::DOUBLE AS score FROM entries")
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = F.datediff(F.lit("2025-01-01").cast("date"), F.col("first_seen").cast("date")) / 365
    return entries(spark, sf_dir).select("id", F.round(op.context_score(F.lit(0.5), _CQ, F.col("title_de"), F.col("content_de"), years), 6).alias("score"))


@query("r20_weighted_quality", "SELECT doc_id, round(quality * 100 * 0.4 + (1 - toxic) * 100 * 0.3 + 50 * 0.2 + (doc_id % 101) * 0.1, 4)::DOUBLE AS iqs FROM labels")
def r20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.round(F.col("quality") * 100 * 0.4 + (1 - F.col("toxic")) * 100 * 0.3 + F.lit(50) * 0.2 + F.col("doc_id") % 101 * 0.1, 4).alias("iqs"))


@query("r21_field_presence", E + "SELECT id, ((coalesce(title_de, '') <> '')::INT + (coalesce(title_en, '') <> '')::INT + (coalesce(summary_de, '') <> '')::INT + (coalesce(content_de, '') <> '')::INT) / 4.0 * 100 AS presence FROM entries")
def r21(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.operators.scoring import has, share

    return entries(spark, sf_dir).select("id", (share(has("title_de"), has("title_en"), has("summary_de"), has("content_de")) * 100).alias("presence"))


_TOPICS = (
    topics.Topic("money", "Geld", ("aid", "benefits"), ("th", "/es/", "tion", "blog", "zz"), (topics.Preference("one", "official_rule_source", "high", ("/de/", "/EN/"), ("https://m.tionsh.example.net/en/98",)), topics.Preference("two", "official_contact_source", "critical"), topics.Preference("three", "journalism_source", "low", ("/nowhere/",)))),
    topics.Topic("work", "Arbeit", ("aid",), ("/en/",)),
)
_SOURCES = (("one", "tionsh.example.net", "Eins", "tier_1_official", "authority", ["all"]), ("two", "www.therwh.example.org", "Zwei", "tier_3_press", "press", None), ("three", "example.com", "Drei", "tier_2_ngo_watchdog", "ngo", ["some"]), ("four", "example.net", "Vier", "tier_1_official", "authority", None), ("five", "example.org", "Fünf", "tier_2_ngo_watchdog", "ngo", None))


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SOURCES, "source_id string, host string, name string, tier string, institution string, groups array<string>")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in three domains; a few of them below paths that say what they are."""
    k = F.col("page_id")
    kind = F.when(k % 11 == 0, "/Lexikon/a").when(k % 11 == 1, "/leichte-sprache").when(k % 11 == 2, "/x/buergertelefon").when(k % 11 == 3, "/presse/1").when(k % 11 == 4, "/eine-studie").otherwise("")
    whole = F.concat(F.regexp_replace("url", "[?].*$", ""), kind, F.when(F.contains("url", F.lit("?")), F.regexp_extract("url", "[?].*$", 0)).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", whole.alias("url"), F.element_at(F.array(*map(F.lit, ("aid", "benefits", "tools"))), (k % 3).cast("int") + 1).alias("domain"))


_TOPIC_SQL = r"""WITH p AS (
    SELECT page_id, regexp_replace(url, '[?].*$', '') || CASE page_id % 11 WHEN 0 THEN '/Lexikon/a' WHEN 1 THEN '/leichte-sprache' WHEN 2 THEN '/x/buergertelefon' WHEN 3 THEN '/presse/1' WHEN 4 THEN '/eine-studie' ELSE '' END || regexp_extract(url, '[?].*$') AS url, ['aid', 'benefits', 'tools'][CAST(page_id % 3 AS INT) + 1] AS domain FROM pages),
u AS (SELECT DISTINCT url, domain, lower(url) AS low, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM p),
h AS (SELECT *, host = 'tionsh.example.net' OR host LIKE '%.tionsh.example.net' AS one, host = 'therwh.example.org' OR host LIKE '%.therwh.example.org' AS two, host = 'example.com' OR host LIKE '%.example.com' AS three, host = 'example.net' OR host LIKE '%.example.net' AS four, host = 'example.org' OR host LIKE '%.example.org' AS five FROM u WHERE NOT regexp_matches(low, '/impressum|/datenschutz|/privacy|/cookie|/rss|/aktuelles|/presse|/meta/|/gebaerdensprache')),
k AS (SELECT *, CASE WHEN contains(low, '/lexikon/') THEN 24 ELSE 0 END + CASE WHEN contains(low, '/leichte-sprache') THEN 22 ELSE 0 END + CASE WHEN contains(low, 'buergertelefon') THEN 18 ELSE 0 END + CASE WHEN contains(low, 'studie') THEN 12 ELSE 0 END - CASE WHEN contains(url, '?') THEN 6 ELSE 0 END AS kind,
      CASE WHEN one OR four THEN 26 WHEN two THEN 0 WHEN three OR five THEN 18 ELSE 0 END AS tier, CASE WHEN one THEN 'one' WHEN two THEN 'two' WHEN three THEN 'three' WHEN four THEN 'four' WHEN five THEN 'five' ELSE host END AS near FROM h),
s AS (
    SELECT 'money' AS topic, domain, url, CASE WHEN two THEN 65 WHEN one THEN 48 + CASE WHEN url = 'https://m.tionsh.example.net/en/98' THEN 50 ELSE 0 END + CASE WHEN contains(low, '/de/') OR contains(low, '/en/') THEN 18 * (contains(low, '/de/')::INT + contains(low, '/en/')::INT) ELSE -8 END
        WHEN three THEN 20 + CASE WHEN contains(low, '/nowhere/') THEN 18 ELSE -8 END ELSE tier END + least(36, 8 * (contains(low, 'th')::INT + contains(low, '/es/')::INT + contains(low, 'tion')::INT + contains(low, 'blog')::INT + contains(low, 'zz')::INT)) + kind AS score,
        CASE WHEN two THEN 'official_contact_source' WHEN one THEN 'official_rule_source' WHEN three THEN 'journalism_source' ELSE 'discovered' END AS role, CASE WHEN two THEN 'critical' WHEN one THEN 'high' WHEN three THEN 'low' ELSE 'normal' END AS priority, CASE WHEN two THEN 'two' ELSE near END AS source_id FROM k WHERE domain IN ('aid', 'benefits')
    UNION ALL SELECT 'work', domain, url, tier + 8 * contains(low, '/en/')::INT + kind, 'discovered', 'normal', near FROM k WHERE domain = 'aid')
"""


@query("r22_discovery_score", _TOPIC_SQL + "SELECT * FROM s WHERE score >= 20")
def r22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two topics say of each page's URL in the topics' domains."""
    return topics.scored_urls(_urls(spark, sf_dir), _TOPICS, _sources(spark)).select("topic", "domain", "url", "score", "role", "priority", "source_id")


@query("d23_topic_report", _TOPIC_SQL + """, b AS (SELECT topic, url, max(score) AS score, arg_max(priority, score) AS priority FROM s WHERE score >= 20 GROUP BY topic, url),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, url) AS n FROM b)
SELECT topic, count(*) AS candidates, list(url ORDER BY n) FILTER (n <= 50) AS top FROM r GROUP BY topic""")
def d23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic's candidates: how many, and the best fifty."""
    return topics.discovery_report(topics.scored_urls(_urls(spark, sf_dir), _TOPICS, _sources(spark)), 50)


@query("d22_seed_manifest", r"""WITH e AS (SELECT DISTINCT ['aid', 'benefits', 'tools'][CAST(page_id % 3 AS INT) + 1] AS domain, regexp_replace(url, '[?].*$', '') AS url FROM pages WHERE page_id % 2 = 0),
f AS (SELECT DISTINCT 'two' AS source_id, regexp_replace(url, '[?].*$', '') AS url FROM pages WHERE page_id % 5 = 0),
d AS (SELECT unnest(['aid', 'benefits']) AS domain),
n AS (SELECT domain, 'one' AS source_id, 'https://m.tionsh.example.net/en/98' AS url, ['official_rule_source'] AS tags, 0 AS j FROM d UNION ALL SELECT domain, 'two', url, ['official_contact_source', 'contact'], 1 FROM f, d),
g AS (SELECT domain, url, list(source_id ORDER BY j) AS sources, flatten(list(tags ORDER BY j)) AS tags FROM n GROUP BY domain, url)
SELECT coalesce(e.domain, g.domain) AS domain, coalesce(e.url, g.url) AS url, g.sources[-1] AS source_id, len(g.sources) IS NOT NULL AND e.url IS NULL AS added, coalesce(len(g.sources), 0) - (e.url IS NULL)::INT AS updates,
    CASE WHEN e.url IS NULL THEN []::VARCHAR[] ELSE ['old'] END || CASE WHEN g.url IS NULL THEN [] WHEN g.domain = 'benefits' THEN ['money', 'financial_support'] ELSE ['money'] END AS topics, coalesce(g.tags, []) AS tags,
    CASE WHEN list_contains(g.sources, 'one') THEN ['all'] ELSE []::VARCHAR[] END AS groups
FROM e FULL JOIN g ON g.domain = e.domain AND g.url = e.url""")
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of half of the pages, after a topic's stated seeds and what a fifth of the pages gave of one of its sources."""
    bare = F.regexp_replace("url", "[?].*$", "")
    p = _urls(spark, sf_dir).select("page_id", "domain").join(table(spark, sf_dir, "pages").select("page_id", bare.alias("url")), "page_id")
    none = F.array().cast("array<string>")
    old = p.where("page_id % 2 = 0").select("domain", "url", F.lit("Alt").alias("label"), F.array(F.lit("old")).alias("topics"), none.alias("tags"), none.alias("groups"))
    found = p.where("page_id % 5 = 0").select(F.lit("two").alias("source_id"), "url")
    return topics.synced_seeds(old, _TOPICS[:1], _sources(spark), found).select("domain", "url", "source_id", "added", "updates", "topics", "tags", "groups")


_PARTS = "[x FOR x IN string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/') IF x <> '']"


@query("r23_sitemap_score", f"SELECT page_id, 3 * (contains(j, 'en')::INT + contains(j, 'de')::INT) - 4 * contains(j, 'html')::INT - least(n, 8) + CASE WHEN n <= 2 THEN 1 ELSE 0 END AS score FROM (SELECT page_id, array_to_string({_PARTS}, ' ') AS j, len({_PARTS}) AS n FROM pages)")
def r23(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.path_parts(F.col("url"))
    j, n = F.array_join(parts, " "), F.size(parts)
    score = 3 * op.hits(j, ("en", "de")) - 4 * op.hits(j, ("html",)) - F.least(n, F.lit(8)) + F.when(n <= 2, 1).otherwise(0)
    return table(spark, sf_dir, "pages").select("page_id", score.cast("long").alias("score"))


_PACK = op.Pack(("thon", "eau"), ("ness", "ough"), ("ung",), ("ing", "ez"), ("kontakt", "ó"), ("aid", "tools"))


@query("r24_pack_score", E + f""", b AS (SELECT id, domain, tier, lower(coalesce(title_de, '') || ' ' || coalesce(summary_de, '') || ' ' || coalesce(content_de, '')) AS t FROM entries)
SELECT id, (3 * ({_HITS('t', ['thon', 'eau'])}) + 2.25 * ({_HITS('t', ['ness', 'ough'])}) + 2 * ({_HITS('t', ['ung'])}) + 1.5 * ({_HITS('t', ['ing', 'ez'])}) + 1.5 * ({_HITS('t', ['kontakt', 'ó'])}) + CASE WHEN domain IN ('aid', 'tools') THEN 1 ELSE 0 END + CASE WHEN tier = 'tier_1_official' THEN 0.75 ELSE 0 END
    + CASE WHEN id % 9 = 0 OR tier = 'tier_2_ngo_watchdog' THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM b""")
def r24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each entry fits a scenario's pack; one of nine institutions is an organisation."""
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title_de", "summary_de", "content_de")]))
    return entries(spark, sf_dir).select("id", _PACK.score(blob, F.col("domain"), F.col("tier"), F.when(F.col("id") % 9 == 0, "ngo")).alias("score"))


@query("r33_answer_confidence", "SELECT conv_id, turn, CASE WHEN contains(l, 'not sure') OR contains(l, 'unclear') OR contains(l, 'don''t know') OR contains(l, 'can''t answer') OR contains(l, 'don''t have enough information') OR h >= 3 OR c = 0 OR n < 100 THEN 'low' WHEN c >= 3 AND h = 0 AND n > 200 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT conv_id, turn, lower(text) AS l, len(regexp_extract_all(text, '\\[\\d+\\]')) AS c, length(text) AS n, contains(lower(text), 'might')::INT + contains(lower(text), 'may')::INT + contains(lower(text), 'possibly')::INT + contains(lower(text), 'perhaps')::INT + contains(lower(text), 'probably')::INT AS h FROM conversations)")
def r33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", op.answer_confidence(F.col("text")).alias("confidence"))


_AUDIT = "WITH s AS (SELECT doc_id, text, [len(string_split(trim(x), ' ')) FOR x IN regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(x) <> ''] AS n FROM documents)"


@query("r35_plain_language_audit", _AUDIT + " SELECT doc_id, CASE WHEN coalesce(len(n), 0) = 0 THEN 0 ELSE greatest(0, least(100, 100 - CASE WHEN list_avg(n) > 16 THEN 18 ELSE 0 END - CASE WHEN len(n) > 8 THEN 8 ELSE 0 END - CASE WHEN regexp_matches(text, '[;:]') THEN 6 ELSE 0 END)) END AS einfach, CASE WHEN coalesce(len(n), 0) = 0 THEN 0 ELSE greatest(0, 100 - CASE WHEN list_avg(n) > 10 THEN 24 ELSE 0 END - CASE WHEN contains(text, ', ') THEN 10 ELSE 0 END - CASE WHEN contains(text, 'bedeutet') THEN 0 ELSE 10 END) END AS leicht FROM s")
def r35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; one without a sentence has nothing that is plain, so 0."""
    n = F.transform(fx.sentences(F.col("text")), lambda s: F.size(F.split(F.trim(s), " ")))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", n.alias("n"))
    mean = F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / F.size("n")
    minus = lambda c, k: F.when(c, k).otherwise(0)
    einfach = 100 - minus(mean > 16, 18) - minus(F.size("n") > 8, 8) - minus(F.col("text").rlike("[;:]"), 6)
    leicht = 100 - minus(mean > 10, 24) - minus(F.col("text").contains(", "), 10) - minus(~F.col("text").contains("bedeutet"), 10)
    read = lambda c: F.when(F.coalesce(F.size("n"), F.lit(0)) > 0, c).otherwise(0)
    return d.select("doc_id", read(einfach).alias("einfach"), read(leicht).alias("leicht"))


@query("r38_eval_confidence", E + f", s AS (SELECT id, domain, {_T} AS t, lower(content_de) AS x FROM entries), v AS (SELECT id, 3.0 * ({_HITS('t', ['thon', 'eau'])}) + 1.25 * ({_HITS('x', ['thon', 'eau'])}) + CASE domain WHEN 'contacts' THEN 5 ELSE 0 END AS v FROM s) SELECT id, round(greatest(0.1, least(0.95, CASE WHEN v < 2 THEN v - 3 ELSE v END / 30)), 6)::DOUBLE AS confidence FROM v")
def r38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure an evaluation is of each entry for a question: its score as a share of thirty, within bounds."""
    cols = {"title": F.col("title_de"), "text": F.col("content_de"), "url": F.lit(""), "domain": F.col("domain")}
    score = op.entry_score("Telefon: Widerspruch gegen Asyl", ["thon", "eau"], [], [], [], cols)
    return entries(spark, sf_dir).select("id", F.round(op.eval_confidence(score), 6).alias("confidence"))


@query("r39_source_role", E + "SELECT id, CASE WHEN domain = 'tools' AND tier = 'tier_1_official' THEN 'trusted_tool' WHEN tier = 'tier_1_official' THEN 'official_info' WHEN list_contains(coalesce(tags, []), 'src3') THEN 'trusted_tool' ELSE 'context_info' END AS role FROM entries")
def r39(spark: SparkSession, sf_dir: str) -> DataFrame:
    official = F.col("tier") == "tier_1_official"
    tagged = F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "src3")
    role = F.when((F.col("domain") == "tools") & official, "trusted_tool").when(official, "official_info").when(tagged, "trusted_tool").otherwise("context_info")
    return entries(spark, sf_dir).select("id", role.alias("role"))


_INTENT_SQL = (
    ("eligibility", "eligible|qualify|can i get|can i receive|am i entitled|berechtigt|anspruch|bekomme ich|erhalte ich"), ("how_to", "how do|how can|how to|apply|application|process|steps|register|wie|beantragen|anmelden|verfahren|schritte"),
    ("comparison", "difference|compare|versus|vs|better|which one|unterschied|vergleich|besser"), ("temporal", "when|until when|deadline|expire|how long|duration|wann|bis wann|frist|ablauf|wie lange|dauer"),
    ("calculation", "how much|amount|calculate|payment|receive|wie viel|betrag|berechnen|zahlung|erhalte"), ("contact", "where|contact|office|phone|email|address|location|wo|kontakt|büro|telefon|adresse|standort"),
    ("definition", "what is|define|explain|meaning of|was ist|bedeutung|erklärung"), ("status", "status|state|progress|approved|denied|pending|stand|fortschritt|genehmigt|abgelehnt"),
)


@query("x04_intents", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '(?:^|[^A-Za-z0-9_])(?:{p})(?:$|[^A-Za-z0-9_])') THEN '{n}'" for n, p in _INTENT_SQL) + " ELSE 'general' END AS intent FROM conversations")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", op.intent(F.col("text")).alias("intent"))


_W = "regexp_split_to_array(lower(text), '\\s+')"


@query("x05_indicator_language", f"SELECT doc_id, CASE WHEN de > en THEN 'de' WHEN en > de THEN 'en' ELSE 'unknown' END AS spoken FROM (SELECT doc_id, len([w FOR w IN {_W} IF list_contains({list(op.GERMAN)}, w)]) + CASE WHEN regexp_matches(text, '[äöüßÄÖÜ]') THEN 2 ELSE 0 END AS de, len([w FOR w IN {_W} IF list_contains({list(op.ENGLISH)}, w)]) AS en FROM documents)")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", op.spoken(F.col("text")).alias("spoken"))


@query("t20_first_useful_sentence", "SELECT doc_id, CASE WHEN length(s) <= 180 THEN s ELSE regexp_extract(left(s, 181), '^(.*)\\s\\S*$', 1, 's') END AS lead FROM (SELECT doc_id, trim(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1]) AS s FROM documents)")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.trim(F.get(F.split(F.trim("text"), r"(?<=[.!?])\s+"), F.lit(0)))
    cut = F.when(F.length(s) <= 180, s).otherwise(F.regexp_extract(F.substring(s, 1, 181), r"(?s)^(.*)\s\S*$", 1))
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("lead"))


_DRAFTS = ("Weil Sie Geld brauchen, können Sie es beantragen, einreichen, oder nicht", "Da ist die Voraussetzung. Sie sind zuständig", "", "Nichts!")


@query("t21_easy_german", """WITH t AS (SELECT doc_id, trim(regexp_replace(['Weil Sie Geld brauchen, können Sie es beantragen, einreichen, oder nicht', 'Da ist die Voraussetzung. Sie sind zuständig', '', 'Nichts!'][CAST(doc_id % 4 AS INT) + 1] || ' ' || text, '\\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS n FROM t),
c AS (SELECT doc_id, n, regexp_replace(regexp_replace(s, '(^|[^\\p{L}\\p{N}_])(?i:obwohl|während|da|weil|damit|sodass|indem)([^\\p{L}\\p{N}_]|$)', '\\1.\\2', 'g'), '(^|[^\\p{L}\\p{N}_])(?i:obwohl|während|da|weil|damit|sodass|indem)([^\\p{L}\\p{N}_]|$)', '\\1.\\2', 'g') AS s FROM s WHERE trim(s) <> ''),
p AS (SELECT doc_id, n, s, list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '') AS ps FROM c),
j AS (SELECT doc_id, n, CASE WHEN len(ps) > 2 THEN array_to_string(ps, '. ') ELSE s END AS s FROM p),
w AS (SELECT doc_id, n, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(^|[^\\p{L}\\p{N}_])Voraussetzung([^\\p{L}\\p{N}_]|$)', '\\1Bedingung\\2', 'g'), '(^|[^\\p{L}\\p{N}_])beantragen([^\\p{L}\\p{N}_]|$)', '\\1anfragen\\2', 'g'), '(^|[^\\p{L}\\p{N}_])zuständig([^\\p{L}\\p{N}_]|$)', '\\1verantwortlich\\2', 'g'), '(^|[^\\p{L}\\p{N}_])einreichen([^\\p{L}\\p{N}_]|$)', '\\1abgeben\\2', 'g') AS s FROM j),
a AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END, ' ' ORDER BY n) AS t FROM w GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(CASE WHEN length(t) > 2000 THEN regexp_replace(left(t, 2000), ' [^ ]*$', '') || '...' ELSE t END, '')) AS easy_md5 FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""")
def t21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft of every document in short sentences and simpler words; one of four beginnings has what the rules change."""
    begin = F.element_at(F.array(*map(F.lit, _DRAFTS)), (F.col("doc_id") % 4).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(plain.easy_german(F.concat(begin, F.lit(" "), "text"))).alias("easy_md5"))


@query("t36_variant_selection", E + "SELECT id, coalesce(CASE WHEN title_easy_de <> '' THEN title_easy_de END, CASE WHEN title_en <> '' THEN title_en END, title_de, '') AS picked, CASE WHEN title_easy_de <> '' THEN 'reviewed' WHEN title_en <> '' THEN 'suggested' ELSE 'fallback' END AS origin FROM entries")
def t36(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    e = entries(spark, sf_dir)
    return e.select("id", F.when(some("title_easy_de"), F.col("title_easy_de")).when(some("title_en"), F.col("title_en")).otherwise(F.coalesce("title_de", F.lit(""))).alias("picked"), F.when(some("title_easy_de"), "reviewed").when(some("title_en"), "suggested").otherwise("fallback").alias("origin"))


@query("st6_failure_streaks", "WITH l AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN ts END) AS ok FROM events GROUP BY user_id) SELECT e.user_id, count(*) FILTER (event_type = 'error' AND (ok IS NULL OR ts > ok)) AS failures, count(*) FILTER (event_type = 'error' AND (ok IS NULL OR ts > ok)) >= 3 AS skip FROM events e JOIN l ON e.user_id = l.user_id GROUP BY e.user_id")
def st6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = F.max(F.when(F.col("event_type") != "error", F.col("ts"))).over(Window.partitionBy("user_id"))
    streak = F.count_if((F.col("event_type") == "error") & (F.col("ok").isNull() | (F.col("ts") > F.col("ok"))))
    return e.withColumn("ok", last).groupBy("user_id").agg(streak.alias("failures"), (streak >= 3).alias("skip"))


@query("d09_plain_language_review", E + """, r AS (SELECT id, title_easy_de, id % 4 = 0 AS has_old, CASE id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'approve' END AS action, CASE WHEN id % 13 = 0 THEN 'schwer' ELSE 'leicht' END AS mode, CASE WHEN id % 2 = 0 THEN 'eva' ELSE '' END AS who FROM entries),
e AS (SELECT *, CASE WHEN mode = 'schwer' THEN 'unsupported mode: schwer' WHEN title_easy_de IS NULL AND NOT has_old THEN 'no leicht translation' END AS error FROM r)
SELECT id, error, CASE WHEN title_easy_de IS NULL THEN NULL WHEN error IS NOT NULL THEN 'open' WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END AS suggested_status, CASE WHEN error IS NULL AND action = 'approve' THEN coalesce(title_easy_de, 'alt') WHEN has_old THEN 'alt' END AS reviewed_text,
CASE WHEN error IS NULL AND action = 'approve' THEN CASE WHEN who <> '' THEN who WHEN title_easy_de IS NULL THEN 'max' END WHEN has_old THEN 'max' END AS reviewed_by, CASE WHEN error IS NULL AND action = 'approve' THEN '2024-06-01' WHEN has_old THEN '2024-01-01' END AS reviewed_at FROM e""")
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of every entry's title in plain language: two of three approve, some of a mode that there isn't; every fourth entry has a reviewed one already."""
    k, none = F.col("id"), F.lit(None).cast("string")
    record = lambda text, reviewed, status, by, at: F.struct(text.alias("text"), F.lit(reviewed).alias("reviewed"), F.lit("leicht").alias("variant"), F.lit(status).alias("review_status"), by.alias("reviewed_by"), at.alias("reviewed_at"), at.alias("timestamp"))
    suggested = F.when(F.col("title_easy_de").isNotNull(), record(F.col("title_easy_de"), False, "open", none, none))
    reviewed = F.when(k % 4 == 0, record(F.lit("alt"), True, "approved", F.lit("max"), F.lit("2024-01-01")))
    out = quality.reviewed_translation(suggested, reviewed, F.when(k % 13 == 0, "schwer").otherwise("leicht"), F.when(k % 3 == 1, "reject").otherwise("approve"), F.when(k % 2 == 0, "eva").otherwise(""), F.lit("2024-06-01"))
    r = entries(spark, sf_dir).select("id", out.alias("r"))
    return r.select("id", "r.error", F.col("r.suggested.review_status").alias("suggested_status"), F.col("r.reviewed.text").alias("reviewed_text"), "r.reviewed.reviewed_by", "r.reviewed.reviewed_at")


@query("d11_metadata_suggestion", E + f"SELECT id, array_to_string(list_filter(['article', 'water'], lambda x: CASE x WHEN 'article' THEN contains(lower(content_de), 'the') ELSE contains(lower(content_de), 'eau') END), ',') AS suggested, least(0.95, 0.35 + 0.08 * ({_HITS('lower(content_de)', ['the', 'eau', 'ung'])}))::DOUBLE AS confidence FROM entries")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.lower("content_de")
    made = F.array_join(F.array_compact(F.array(F.when(c.contains("the"), "article"), F.when(c.contains("eau"), "water"))), ",")
    return entries(spark, sf_dir).select("id", made.alias("suggested"), F.least(F.lit(0.95), 0.35 + 0.08 * op.hits(c, ("the", "eau", "ung"))).alias("confidence"))


@query("d14_promotion", E + f""", c AS (SELECT *, {_GATE} AS reason FROM entries WHERE id % 2 = 0), r AS (SELECT domain, string_agg(reason || ':' || n, ',' ORDER BY reason || ':' || n) AS rejected FROM (SELECT domain, reason, count(*) AS n FROM c WHERE reason <> 'accepted' GROUP BY ALL) GROUP BY domain),
x AS (SELECT id, domain, CASE WHEN id % 10 = 0 THEN url || '/alt' ELSE url END AS url, title_de, content_de, CASE WHEN id % 3 = 0 THEN iqs ELSE 99 END AS iqs, ais FROM entries WHERE id % 3 <> 2),
k AS (SELECT domain, lower(url) AS at, iqs, ais FROM x WHERE url IS NOT NULL AND NOT coalesce(length(title_de) > 500, FALSE) AND NOT coalesce(length(trim(content_de)) > 500000, FALSE)),
n AS (SELECT domain, lower(url) AS at, iqs, ais FROM c WHERE reason = 'accepted' AND url IS NOT NULL),
b AS (SELECT coalesce(k.domain, n.domain) AS domain, n.at IS NOT NULL AND (k.at IS NULL OR coalesce(n.ais, 0) > coalesce(k.ais, 0) OR coalesce(n.iqs, 0) > coalesce(k.iqs, 0)) AS promoted FROM k FULL JOIN n ON k.domain = n.domain AND k.at = n.at),
s AS (SELECT domain, count(*) AS existing, count(*) FILTER (url IS NOT NULL AND (coalesce(length(title_de) > 500, FALSE) OR coalesce(length(trim(content_de)) > 500000, FALSE))) AS dropped FROM x GROUP BY domain)
SELECT s.domain, s.existing, (SELECT count(*) FROM c WHERE c.domain = s.domain) AS candidates, (SELECT count(*) FROM b WHERE b.domain = s.domain AND promoted) AS promoted, (SELECT count(*) FROM b WHERE b.domain = s.domain) AS total_after_merge, s.dropped AS dropped_existing, coalesce(r.rejected, '') AS rejected
FROM s LEFT JOIN r ON r.domain = s.domain""")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the entries as candidates for two thirds of them: some under another URL, some with better scores."""
    e, k = entries(spark, sf_dir), F.col("id")
    shape = lambda df: df.withColumns({"title": F.col("title_de"), "content": F.col("content_de")})
    old = e.where(k % 3 != 2).withColumns({"url": F.when(k % 10 == 0, F.concat("url", F.lit("/alt"))).otherwise(F.col("url")), "iqs": F.when(k % 3 == 0, F.col("iqs")).otherwise(99.0)})
    new = e.where(k % 2 == 0)
    return quality.promotion(shape(old), shape(new), filters.candidate_gate(new))


@query("w19_supplement", E + ", m AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS n FROM entries WHERE tier = 'tier_2_ngo_watchdog'), x AS (SELECT domain, id, 'own' AS origin FROM m WHERE n <= 2), s AS (SELECT domain, id, 'supplement' AS origin, row_number() OVER (PARTITION BY domain ORDER BY id) AS n FROM entries e WHERE tier = 'tier_1_official' AND id NOT IN (SELECT id FROM x)) SELECT domain, id, origin FROM x UNION ALL SELECT s.domain, s.id, s.origin FROM s WHERE s.n <= 3 - coalesce((SELECT count(*) FROM x WHERE x.domain = s.domain), 0)")
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).select("domain", "id", "tier")
    own = rk.first_of(e.where("tier = 'tier_2_ngo_watchdog'"), ["domain"], ["id"], 2).select("domain", "id", F.lit("own").alias("origin"))
    have = own.groupBy("domain").agg(F.count("*").alias("have"))
    # The first three of each domain are cut before the shuffle; which of them are needed is told among those.
    more = rk.first_of(e.where("tier = 'tier_1_official'").join(own.select("id"), "id", "left_anti"), ["domain"], ["id"], 3).join(have, "domain", "left")
    n = F.row_number().over(Window.partitionBy("domain").orderBy("id"))
    return own.unionByName(more.withColumn("n", n).where("n <= 3 - coalesce(have, 0)").select("domain", "id", F.lit("supplement").alias("origin")))


@query("j08_topic_role_boost", E + """, w AS (SELECT id, CASE source WHEN 'src1' THEN 4.0 + 1.2 * contains(url, '/de/')::INT + 1.2 * contains(url, '/en/')::INT WHEN 'src2' THEN 3.0 + 1.2 * contains(url, '/es/')::INT ELSE 0 END + CASE WHEN host IS NULL THEN 0 ELSE 1.0 END AS b FROM entries)
SELECT id, round(b, 6)::DOUBLE AS boost FROM w""")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosts by a topic's preferred sources: their hosts come from the registry, one above all others; one isn't registered."""
    preferred = spark.createDataFrame([("rules", "official_rule_source", ["/DE/", "/en/"]), ("office", "official_contact_source", ["/es/"]), ("press", "journalism_source", None), ("lost", "official_rule_source", None)], "source_id string, role string, patterns array<string>")
    registry = spark.createDataFrame([("rules", "src1.example.org"), ("office", "src2.example.org"), ("press", "example.org"), ("other", "src3.example.org")], "source_id string, host string")
    return crawl.role_boost(entries(spark, sf_dir), "id", "host", "url", preferred.join(registry, "source_id").select("host", "role", "patterns"))


@query("j23_exact_host_profile", E + ", p(host, name) AS (VALUES ('src1.example.org', 'one'), ('src2.example.org', 'two'), ('example.org', 'top')) SELECT e.id, coalesce(p.name, 'inferred') AS profile FROM entries e LEFT JOIN p ON e.host = p.host")
def j23(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.operators.joins import rules

    p = rules(spark.createDataFrame([("src1.example.org", "one"), ("src2.example.org", "two"), ("example.org", "top")], "host string, profile string"))
    return entries(spark, sf_dir).join(p, "host", "left").select("id", F.coalesce("profile", F.lit("inferred")).alias("profile"))


@query("u10_lane_union", E + ", l AS (SELECT regexp_replace(lower(url), '/$', '') AS key, domain, id FROM entries WHERE id % 2 = 0 UNION ALL SELECT regexp_replace(lower(url || '/'), '/$', ''), domain, id + 1000000 FROM entries WHERE id % 3 = 0) SELECT domain, min(id) AS id FROM l GROUP BY key, domain")
def u10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    key = lambda c: F.regexp_replace(F.lower(c), "/$", "").alias("key")
    every = e.where("id % 2 = 0").select(key("url"), "domain", "id").unionByName(e.where("id % 3 = 0").select(key(F.concat("url", F.lit("/"))), "domain", (F.col("id") + 1_000_000).alias("id")))
    return every.groupBy("key", "domain").agg(F.min("id").alias("id")).select("domain", "id")


@query("p10_flattened", "SELECT event_id, event_type AS \"e.type\", CAST(json_extract(props, '$.k') AS BIGINT) AS \"e.props.k\" FROM events")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.operators.shaping import flat

    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("type"), F.from_json("props", "k bigint").alias("props")).alias("e"))
    return e.select(*flat(e))


@query("a32_vector_store_memory", "SELECT label, count(*) AS n, count(*) * (50 + 8 * 64 + 200) AS memory FROM embeddings GROUP BY label")
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), (F.count("*") * (50 + 8 * 64 + 200)).alias("memory"))


@query("a29_lane_counts", E + "SELECT CASE tier WHEN 'tier_1_official' THEN 'official' WHEN 'tier_2_ngo_watchdog' THEN 'support' ELSE 'context' END AS lane, count(*) AS n FROM entries GROUP BY 1")
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    lane = F.when(F.col("tier") == "tier_1_official", "official").when(F.col("tier") == "tier_2_ngo_watchdog", "support").otherwise("context")
    return entries(spark, sf_dir).groupBy(lane.alias("lane")).agg(F.count("*").alias("n"))


@query("s13_backfilled_titles", E + "SELECT id, coalesce(nullif(title_en, ''), title_de) AS title FROM entries WHERE domain = 'aid'")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).where("domain = 'aid'").select("id", F.coalesce(F.nullif("title_en", F.lit("")), "title_de").alias("title"))


@query("w30_catalog_sorts", E + "SELECT host, n, row_number() OVER (ORDER BY n DESC, host) AS by_entries, row_number() OVER (ORDER BY host) AS by_name FROM (SELECT host, count(*) AS n FROM entries GROUP BY host)")
def w30(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = entries(spark, sf_dir).groupBy("host").agg(F.count("*").alias("n"))
    with scratch(spark) as keep:
        ranked = numbered(numbered(h, [F.col("n").desc(), F.col("host")], "a"), [F.col("host").asc()], "b")
        return keep(stash(ranked.select("host", "n", (F.col("a") + 1).alias("by_entries"), (F.col("b") + 1).alias("by_name")), "sorts", sweep=False))
