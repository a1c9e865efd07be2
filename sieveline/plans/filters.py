"""Filters and predicates over entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as fx
from sieveline.operators import answers, discovery, evaluation, pages, rules, seeds
from sieveline.operators import filters as op
from sieveline.operators.ranking import first_of
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL} "
TITLES = ["title_de", "title_en", "title_easy_de"]
FIELDS = [*TITLES, "summary_de", "summary_en", "content_de"]
_ANY = lambda cols, term: " OR ".join(f"{c} ILIKE '%{term}%'" for c in cols)


@query("f01_equality_filters", E + "SELECT id, domain, status, tier FROM entries WHERE domain = 'aid' AND status = 'active' AND coalesce(tier, '') = 'tier_1_official'")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.equal_filters(entries(spark, sf_dir), domain="aid", status="active", tier="tier_1_official", jurisdiction=None).select("id", "domain", "status", "tier")


@query("f02_title_search", E + f"SELECT id, title_de FROM entries WHERE {_ANY(TITLES, 'the')}")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.text_search(entries(spark, sf_dir), "the", TITLES).select("id", "title_de")


@query("f03_text_search", E + f"SELECT id, domain FROM entries WHERE {_ANY(FIELDS, 'thon')}")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.text_search(entries(spark, sf_dir), "thon", FIELDS).select("id", "domain")


_TERMS = ["thon", "eau", "ción", "lich"]


@query("f04_terms_search", E + f"SELECT * FROM (SELECT id, {' + '.join(f'CASE WHEN {_ANY(FIELDS, t)} THEN 1 ELSE 0 END' for t in _TERMS)} AS term_score FROM entries) WHERE term_score > 0")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.terms_search(entries(spark, sf_dir), _TERMS, FIELDS).select("id", "term_score")


@query("f05_list_filter", E + "SELECT id, url FROM entries WHERE lower(title_de) LIKE lower('%AND%') OR lower(url) LIKE lower('%SRC3%')")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return e.where(F.lower("title_de").like("%and%") | F.lower("url").like("%src3%")).select("id", "url")


@query("f06_retrieval_predicate", E + f"SELECT id, domain FROM entries WHERE status = 'active' AND domain IN ('aid', 'tools') AND ({_ANY(FIELDS, 'ness')} OR {_ANY(FIELDS, 'ung')})")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = op.terms_search(entries(spark, sf_dir), ["ness", "ung"], FIELDS)
    return e.where((F.col("status") == "active") & F.col("domain").isin("aid", "tools")).select("id", "domain")


@query("f07_zero_hit_fallback", E + "SELECT id FROM entries WHERE status = 'active' AND (content_de ILIKE '%no such words here%' OR NOT EXISTS (SELECT 1 FROM entries WHERE status = 'active' AND content_de ILIKE '%no such words here%'))")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = entries(spark, sf_dir).where("status = 'active'")
    return op.or_all(active, F.col("content_de").ilike("%no such words here%")).select("id")


@query("f08_snapshot_filter", E + "SELECT id FROM entries WHERE status = 'active' AND jurisdiction = 'DE' AND (lower(title_de) LIKE '%on%' OR lower(summary_de) LIKE '%on%' OR lower(url) LIKE '%on%')")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = op.equal_filters(entries(spark, sf_dir), status="active", jurisdiction="DE")
    return e.where(op.some([F.lower(c).contains("on") for c in ("title_de", "summary_de", "url")])).select("id")


@query("f09_low_quality", E + "SELECT id, iqs, ais FROM entries WHERE iqs < 50 OR ais < 50")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.low_quality(entries(spark, sf_dir)).select("id", "iqs", "ais")


@query("f09_low_quality_unscored_as_zero", E + "SELECT id, iqs, ais FROM entries WHERE coalesce(iqs, 0) < 50 OR coalesce(ais, 0) < 50")
def f09_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.low_quality(entries(spark, sf_dir), unscored=True).select("id", "iqs", "ais")


@query("f10_missing_translations", E + "SELECT id, title_en IS NULL OR trim(title_en) = '' AS missing_en, title_easy_de IS NULL OR trim(title_easy_de) = '' AS missing_easy_de FROM entries WHERE title_en IS NULL OR trim(title_en) = '' OR title_easy_de IS NULL OR trim(title_easy_de) = ''")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    out = entries(spark, sf_dir).select("id", missing("title_en").alias("missing_en"), missing("title_easy_de").alias("missing_easy_de"))
    return out.where("missing_en or missing_easy_de")


_LOW = " OR ".join([*(f"contains(u, '{w}')" for w in op.LOW_SIGNAL_URL), *(f"contains(t, '{w}')" for w in op.LOW_SIGNAL_TITLE), "(u = '' AND t = '')"])


@query("f11_low_signal", E + f"SELECT id, {_LOW} AS low FROM (SELECT id, lower(coalesce(url, '')) AS u, lower(coalesce(title_de, '')) AS t FROM entries)")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", op.low_signal(F.col("url"), F.col("title_de")).alias("low"))


_COOKIES = ("", "", "", " Mit der Einwilligung", " Widerruf der EINWILLIGUNG", " Matomo", " Webverhalten-Analysetool", "", " Cookiehinweis", " tracking")
_SPELT = lambda k: "([" + ", ".join(f"'{x}'" for x in _COOKIES) + f"])[CAST({k} % 10 AS INT) + 1]"


@query("f12_boilerplate_lines", f"WITH t AS (SELECT doc_id, text || {_SPELT('doc_id')} AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(lower(t), 'einwilligung von nutzenden|webverhalten- analysetool|webverhalten-analysetool|webverhalten analysetool|matomo|mit der einwilligung|cookie-einwilligung|cookiehinweis|tracking|nach erteilung der einwilligung|widerruf der einwilligung') THEN '' ELSE t END AS cleaned FROM t")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts about cookies and tracking are blanked; six of ten documents have such words put after their text."""
    text = F.concat("text", F.element_at(F.array(*map(F.lit, _COOKIES)), (F.col("doc_id") % 10).cast("int") + 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(fx.contains_any(F.lower(text), answers.BOILERPLATE), "").otherwise(text).alias("cleaned"))


@query("f13_relevance_guard", E + "SELECT id FROM entries e WHERE (content_de LIKE '%eau%' AND content_de NOT LIKE '%http%') OR NOT EXISTS (SELECT 1 FROM entries WHERE content_de LIKE '%eau%' AND content_de NOT LIKE '%http%')")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content_de")
    return op.or_all(entries(spark, sf_dir), c.contains("eau") & ~c.contains("http")).select("id")


_RANK = "CASE tier WHEN 'tier_1_official' THEN 4 WHEN 'tier_2_ngo_watchdog' THEN 3 WHEN 'tier_4_academic' THEN 2 WHEN 'tier_3_press' THEN 1 ELSE -1 END"


@query("f15_evidence_policy", E + """, r AS (SELECT id, domain, CASE tier WHEN 'tier_1_official' THEN 4 WHEN 'tier_2_ngo_watchdog' THEN 2 WHEN 'tier_3_press' THEN 1 WHEN 'tier_4_academic' THEN 1 ELSE -1 END AS rank, coalesce(iqs, 0) / 100 AS c, coalesce(tier, '') = 'tier_1_official' AS official FROM entries),
d AS (SELECT domain, CASE WHEN rank < 0 THEN 'unclassified' WHEN c < 0.3 THEN 'confidence' WHEN rank < 2 THEN 'tier' WHEN domain <> 'tools' AND NOT official THEN 'unofficial' ELSE 'kept' END AS outcome, domain = 'tools' AS lenient FROM r)
SELECT domain, outcome, count(*) AS n FROM d GROUP BY ALL""")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries of each domain a policy keeps as evidence, and why it drops the others; tools need not be official."""
    e = entries(spark, sf_dir)
    of = lambda strict: evaluation.policy_drop(F.col("tier"), discovery.source_role(F.col("tier"), F.col("domain")), F.col("iqs") / 100, 0.3, "tier_3_ngo", strict)
    outcome = F.coalesce(F.when(F.col("domain") == "tools", of(False)).otherwise(of(True)), F.lit("kept"))
    return e.groupBy("domain", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("f16_lane_relevance", E + "SELECT id, domain FROM (SELECT id, domain, iqs > 95 AS met, bool_or(coalesce(iqs > 95, FALSE)) OVER (PARTITION BY host) AS got, row_number() OVER (PARTITION BY host ORDER BY id) AS n FROM entries) WHERE met OR (NOT got AND n <= 2)")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.or_first(entries(spark, sf_dir), F.col("iqs") > 95, "host", "id").select("id", "domain")


_ANY = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_BY_DOMAIN = lambda text, table: "(" + " OR ".join(f"(domain = '{d}' AND {_ANY(text, words)})" for d, words in table.items()) + ")"
_T, _U, _S, _C = (f"lower(coalesce({c}, ''))" for c in ("title_de", "url", "summary_de", "content_de"))
_GATE = f"""CASE WHEN length({_T}) > 500 THEN 'oversized_title' WHEN length(trim({_C})) > 500000 THEN 'oversized_content'
WHEN {_T} = '' OR {_ANY(_T, op.GATE_TITLE)} THEN 'low_signal_title' WHEN {_BY_DOMAIN(_T, op.GATE_DOMAIN_TITLE)} THEN 'domain_low_signal_title'
WHEN {_ANY(_U, op.GATE_URL)} THEN 'low_signal_url' WHEN {_BY_DOMAIN(_U, op.GATE_DOMAIN_URL)} THEN 'domain_low_signal_url'
WHEN {_ANY(_S, op.GATE_CONTENT)} OR {_ANY(_C, op.GATE_CONTENT)} THEN 'low_signal_content'
WHEN coalesce(tier, '') IN ('', 'tier_unknown') THEN 'unknown_source_tier' WHEN length(trim({_C})) < 140 THEN 'thin_content'
WHEN {_S} <> '' AND {_S} = {_T} THEN 'summary_equals_title' WHEN coalesce(iqs, 0) < 75 THEN 'iqs_below_threshold'
WHEN coalesce(ais, 0) < 70 THEN 'ais_below_threshold' ELSE 'accepted' END"""


@query("f17_candidate_gate", E + f"SELECT id, {_GATE} AS reason FROM entries e")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return e.select("id", op.candidate_gate(e).alias("reason"))


_POOR = "'navigation', 'hauptnavigation', 'haupt-navigation', 'startseite', 'home', 'homepage', 'menu', 'hinweis zum datenschutz', 'datenschutz', 'datenschutzhinweis', 'impressum', 'cookie-hinweis', 'cookie hinweis'"
_ABOUT = "cookie|datenschutz|javascript|newsletter|anmelden|registrieren|suche|navigation|zum inhalt|barrierefreiheit|impressum|einwilligung|webverhalten|tracking|analyse-tool|matomo|einwilligen ablehnen"


@query("f18_low_quality_titles", E + f""", n AS (SELECT id, CASE id % 9 WHEN 0 THEN 'Startseite' WHEN 1 THEN ' IMPRESSUM ' WHEN 2 THEN 'Jetzt loslegen' WHEN 3 THEN '' WHEN 4 THEN 'Cookie-Einstellungen' ELSE title_de END AS t,
    trim(regexp_replace(regexp_replace(coalesce(CASE WHEN id % 7 = 0 THEN summary_de || ' Zum Inhalt' ELSE summary_de END, ''), '\\s+', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g'), ' -|') AS s FROM entries)
SELECT id, lower(trim(coalesce(t, ''))) IN ('', {_POOR}) OR regexp_matches(lower(coalesce(t, '')), 'jetzt|hier klicken|mehr erfahren|loslegen|starten|anmelden|datenschutz|cookie|impressum') AS poor_title,
    length(s) < 40 OR regexp_matches(lower(s), '{_ABOUT}') AS poor_description FROM n""")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and descriptions that say nothing; five of nine entries have such titles, one of seven such a description."""
    k = F.col("id") % 9
    named = F.when(k == 0, "Startseite").when(k == 1, " IMPRESSUM ").when(k == 2, "Jetzt loslegen").when(k == 3, "").when(k == 4, "Cookie-Einstellungen").otherwise(F.col("title_de"))
    summary = F.when(F.col("id") % 7 == 0, F.concat("summary_de", F.lit(" Zum Inhalt"))).otherwise(F.col("summary_de"))
    return entries(spark, sf_dir).select("id", pages.poor_title(named).alias("poor_title"), pages.poor_description(summary).alias("poor_description"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"


@query("f19_host_match", f"SELECT page_id, {_HOST} AS host, {_HOST} = 'example.net' OR {_HOST} LIKE '%.example.net' AS inside FROM pages")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = fx.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), fx.under(host, F.lit("example.net")).alias("inside"))


_GUARD = seeds.Guard(urls=("http://therwh.example.org/es/12", "https://m.tionsh.example.net/en/98"), hosts=("cheap-pills.example.com", "www.casino-win.example.org"), suffixes=("example.net",), words=("/EN/9", "utm_"))


@query("f20_guardrails", f"""WITH p AS (SELECT page_id, url, {_HOST} AS h, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS u FROM pages)
SELECT page_id, CASE WHEN u IN ('http://therwh.example.org/es/12', 'https://m.tionsh.example.net/en/98') THEN 'exact_url_blocklist' WHEN h IN ('cheap-pills.example.com', 'casino-win.example.org') THEN 'blocked_host'
WHEN h = 'example.net' OR h LIKE '%.example.net' THEN 'blocked_host_suffix' WHEN contains(lower(u), '/en/9') THEN 'blocked_url_token' END AS reason FROM p""")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a page's normalised URL is stopped: as a whole, by its host, by a domain above it, or by a part; parameters that track are gone by then."""
    return table(spark, sf_dir, "pages").select("page_id", _GUARD.reason(fx.canonical_url(F.col("url"))).alias("reason"))


_PAGES = ("https://www.bmas.de/DE/Arbeit/x", "https://www.bmas.de/DE/Service/x", "HTTPS://www.bmbfsfj.bund.de/bmbfsfj/themen/familie/", "https://www.bmbfsfj.bund.de/bmbfsfj/", "https://www.bmbfsfj.bund.de/bmbfsfj/mediathek/a", "https://www.bmas.de/de/Soziales/", "https://www.bmbfsfj.bund.de/bmbfsfj/themen/familie/geld")


@query("f23_prune_rules", E + """SELECT id, CASE WHEN domain = 'organizations' AND id % 7 IN (0, 5) THEN 'bmas_topic_page' WHEN domain = 'organizations' AND id % 7 IN (2, 4, 6) THEN 'bmbfsfj_theme_media_meta'
WHEN domain = 'aid' AND id % 7 = 3 THEN 'bmbfsfj_root_page' WHEN domain = 'aid' AND id % 7 = 2 THEN 'bmbfsfj_theme_root' ELSE 'kept' END AS reason FROM entries""")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why entries are pruned from a domain that their URL, one of seven, doesn't fit."""
    url = F.element_at(F.array(*map(F.lit, _PAGES)), (F.col("id") % 7).cast("int") + 1)
    return entries(spark, sf_dir).select("id", op.prune_reason(F.col("domain"), url).alias("reason"))


@query("f24_cookie_boilerplate", E + "SELECT id FROM entries WHERE NOT (id % 5 = 0 AND summary_de IS NOT NULL OR id % 7 = 0 AND content_de IS NOT NULL OR id % 6 = 0 AND url IS NOT NULL)")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that aren't about cookies; one of five says so in its summary, one of seven in its content, one of six in its URL."""
    k = F.col("id")
    with_words = lambda c, n, words: F.when(k % n == 0, F.concat(c, F.lit(words))).otherwise(F.col(c))
    cookie = op.cookie_entry(with_words("url", 6, "/Dynamic/Action/1"), with_words("summary_de", 5, " MATOMO "), with_words("content_de", 7, " Einwilligen ablehnen"))
    return entries(spark, sf_dir).where(~cookie).select("id")


@query("f26_payload_filter", E + "SELECT id FROM entries WHERE tier IN ('tier_1_official', 'tier_3_press') AND list_has_any(topics, ['family', 'money']) AND jurisdiction = 'DE'")
def f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).where(F.col("tier").isin("tier_1_official", "tier_3_press") & F.arrays_overlap("topics", F.array(F.lit("family"), F.lit("money"))) & (F.col("jurisdiction") == "DE")).select("id")


@query("f28_active", E + "SELECT id FROM entries WHERE status = 'active' AND NOT source_unavailable")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).where("status = 'active' and not source_unavailable").select("id")


@query("f29_unknown_values", E + "SELECT id, coalesce(lower(trim(tier)), '') IN ('', 'unknown', 'tier_unknown', 'none') AS tier_unknown, coalesce(lower(trim(jurisdiction)), '') IN ('', 'unknown', 'tier_unknown', 'none') AS jurisdiction_unknown FROM entries")
def f29(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")).isin("", "unknown", "tier_unknown", "none")
    return entries(spark, sf_dir).select("id", unknown("tier").alias("tier_unknown"), unknown("jurisdiction").alias("jurisdiction_unknown"))


_BYTES = ("", "a %PDF-1.7", " endstream ", "x startxref 1", "/FlateDecode", "\\ufffd" * 4 + "\\x01" * 4, "\\ufffd" * 8, "\\x0b" * 8, "\\n\\t" * 8)
_BYTES = tuple(x.encode().decode("unicode_escape") for x in _BYTES)


@query("f31_binary_text", "SELECT page_id, page_id % 9 IN (1, 2, 3, 4, 6, 7) AS is_binary FROM pages")
def f31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one of nine beginnings: marks of a file, or eight characters that don't belong in texts, of one kind."""
    begin = F.element_at(F.array(*map(F.lit, _BYTES)), (F.col("page_id") % 9).cast("int") + 1)
    return table(spark, sf_dir, "pages").select("page_id", op.binary_text(F.concat(begin, "html")).alias("is_binary"))


@query("f32_external_evidence", E + """, c AS (SELECT id, host, coalesce(nullif(trim(url), ''), 'unknown') AS source, CASE WHEN id % 7 = 0 THEN 0.6 ELSE greatest(0.0, least(1.0, coalesce(iqs / 80 - 0.1, 0.6))) END AS confidence, row_number() OVER (PARTITION BY host ORDER BY id) AS n FROM entries WHERE host LIKE '%.example.org' AND host NOT IN ('src1.example.org', 'src2.example.org'))
SELECT id, source, round(confidence, 6)::DOUBLE AS confidence FROM c WHERE n <= 12""")
def f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve items that every allowed host gives as evidence, with a confidence from 0 to 1; some state none or no number."""
    allowed = fx.under(F.col("host"), F.lit("example.org")) & ~F.col("host").isin("src1.example.org", "src2.example.org")
    stated = F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("iqs") / 80 - 0.1)
    rows = first_of(entries(spark, sf_dir).where(allowed), ["host"], ["id"], evaluation.PAYLOAD_MOST)
    return rows.select("id", F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.lit("unknown")).alias("source"), F.round(evaluation.external_confidence(stated), 6).alias("confidence"))


_KINDS = (("eligibility", "kann ich|darf ich|habe ich anspruch|berechtigt|voraussetzung"), ("howto", "wie|wo|beantragen|antrag|welche dokumente|schritte"), ("factual", "was ist|wie viel|wie hoch|wann|wer|betrag|höhe"), ("comparison", "unterschied|vergleich|besser|oder|versus|vs"), ("exploratory", "welche|alle|gibt es|übersicht|möglichkeiten"))


@query("f33_question_type", "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{ws}') THEN '{k}'" for k, ws in _KINDS) + " ELSE 'factual' END AS kind FROM conversations")
def f33(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", op.first_reason([(k, fx.contains_any(low, ws)) for k, ws in rules.QUESTIONS.items()], "factual").alias("kind"))
