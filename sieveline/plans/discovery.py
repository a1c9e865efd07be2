"""Seeds, registries, queues, surfaces and field checks as queries; SQL beside each.

The tables have no registry, pins or queue; the queries derive such rows from every entry, the same in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import text as fx
from sieveline.operators import discovery as op
from sieveline.operators import filters
from sieveline.plans.evidence import r26
from sieveline.plans.registry import SQL, query
from sieveline.session import table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL} "


@query("f21_registry_skip", E + """SELECT id, url FROM entries WHERE tier IS NULL OR NOT (status IN ('archived', 'discontinued') OR id % 13 = 0 OR id % 8 = 0)""")
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds that the registry doesn't rule out by a final state, a mark or another canonical URL; entries without a tier aren't registered."""
    e = entries(spark, sf_dir)
    state = F.when(F.col("status") == "archived", "dns_error").when(F.col("status") == "discontinued", "redirect_alias").otherwise("ok")
    registry = e.where("tier is not null").select("url", state.alias("state"), (F.col("id") % 13 == 0).alias("skip"), F.when(F.col("id") % 8 == 0, F.concat("url", F.lit("/new"))).alias("canonical"))
    return op.open_seeds(e.select("id", "url"), registry)


@query("f14_hard_narrowing", E + ", hit AS (SELECT * FROM entries WHERE (content_de ILIKE '%heit%' OR content_de ILIKE '%ción%') AND NOT (content_de ILIKE '%schuld%' OR content_de ILIKE '%thwh%')) SELECT id FROM entries WHERE id IN (SELECT id FROM hit) OR NOT EXISTS (SELECT 1 FROM hit)")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a wanted and without an unwanted word; all of them if there is none."""
    any_of = lambda words: F.coalesce(F.lower("content_de").rlike("|".join(words)), F.lit(False))
    return filters.or_all(entries(spark, sf_dir), any_of(["heit", "ción"]) & ~any_of(["schuld", "thwh"])).select("id")


@query("r25_surface_score", E + """, s AS (SELECT id, lower(coalesce(title_de || ' ', '') || url || ' ' || domain) AS t FROM entries)
SELECT id, (3 * (contains(t, 'aid')::INT + contains(t, 'src1')::INT) + 2 * (contains(t, '/en/')::INT + contains(t, 'the')::INT) + 1.5 * contains(t, 'tools')::INT)::DOUBLE AS score FROM s""")
def r25(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return e.select("id", op.surface_score(F.concat_ws(" ", "title_de", "url", "domain"), ("aid", "src1"), ("/en/", "the"), ("tools",)).alias("score"))


@query("r28_evidence_role", E + "SELECT id, coalesce(tier, 'unknown') AS source_tier, CASE WHEN coalesce(tier, '') LIKE 'tier\\_1\\_%' ESCAPE '\\' OR tier = 'tier_2_official' THEN 'official_info' WHEN domain = 'tools' THEN 'trusted_tool' ELSE 'context_info' END AS source_role FROM entries")
def r28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", F.coalesce("tier", F.lit("unknown")).alias("source_tier"), op.source_role(F.col("tier"), F.col("domain")).alias("source_role"))


@query("r40_resource_placement", E + """, u AS (SELECT id, CASE id % 6 WHEN 0 THEN 'https://www.arbeitsagentur.de/a' WHEN 1 THEN 'https://Service.Bund.de/b.PDF' WHEN 2 THEN 'https://bund.de/download/c' WHEN 3 THEN 'https://www.bamf.de/d' WHEN 4 THEN url END AS u,
    CASE domain WHEN 'contacts' THEN 'contacts' WHEN 'organizations' THEN 'ngo_assistance' WHEN 'benefits' THEN 'documents' ELSE 'information' END AS lane FROM entries)
SELECT id, CASE WHEN lane = 'contacts' THEN 'contacts' WHEN lane = 'ngo_assistance' THEN 'aid' WHEN id % 6 IN (1, 2) THEN 'tools' WHEN id % 6 = 0 OR lane = 'documents' THEN 'benefits' ELSE 'aid' END AS placed,
CASE WHEN lane = 'ngo_assistance' THEN 'tier_2_ngo_watchdog' WHEN id % 6 IN (0, 1, 3) THEN 'tier_1_official' ELSE 'tier_2_official' END AS tier FROM u""")
def r40(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("id") % 6, F.col("domain")
    url = F.when(k == 0, "https://www.arbeitsagentur.de/a").when(k == 1, "https://Service.Bund.de/b.PDF").when(k == 2, "https://bund.de/download/c").when(k == 3, "https://www.bamf.de/d").when(k == 4, F.col("url"))
    lane = F.when(d == "contacts", "contacts").when(d == "organizations", "ngo_assistance").when(d == "benefits", "documents").otherwise("information")
    domain, tier = op.placement(url, lane)
    return entries(spark, sf_dir).select("id", domain.alias("placed"), tier.alias("tier"))


@query("r32_enrichment_confidence", E + "SELECT id, round(CASE WHEN tags IS NULL THEN 0.35 ELSE least(0.95, 0.6 + 0.08 * len(tags)) END, 6)::DOUBLE AS confidence FROM entries")
def r32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of suggested tags: a base and a step for each one added, less where only old ones stand."""
    added = F.coalesce(F.size("tags"), F.lit(0))
    return entries(spark, sf_dir).select("id", F.round(F.when(added > 0, F.least(F.lit(0.95), 0.6 + 0.08 * added)).otherwise(0.35), 6).alias("confidence"))


@query("w03_snapshot_order", E + """SELECT id, tier, ais, iqs FROM entries ORDER BY CASE tier WHEN 'tier_1_official' THEN 0 WHEN 'tier_2_official' THEN 1 WHEN 'tier_2_ngo_watchdog' THEN 2 WHEN 'tier_4_academic' THEN 3 WHEN 'tier_3_press' THEN 4 ELSE 5 END,
coalesce(ais, 0) DESC, coalesce(iqs, 0) DESC, coalesce(last_seen, first_seen) DESC, id LIMIT 100""")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of 100 in a snapshot's order."""
    order = ("tier_1_official", "tier_2_official", "tier_2_ngo_watchdog", "tier_4_academic", "tier_3_press")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("tier")), F.lit(0)), F.lit(6))
    e = entries(spark, sf_dir)
    return e.orderBy(rank, F.coalesce("ais", F.lit(0.0)).desc(), F.coalesce("iqs", F.lit(0.0)).desc(), F.coalesce("last_seen", "first_seen").desc(), "id").limit(100).select("id", "tier", "ais", "iqs")


_TOPICS = {"family": ("the", "than"), "housing": ("on", "heron"), "work": ("ing", "er"), "health": ("zzz",)}


@query("w15_topic_match", r"""WITH t(topic_id, ks) AS (VALUES ('family', ['the', 'than']), ('housing', ['on', 'heron']), ('work', ['ing', 'er']), ('health', ['zzz'])),
b AS (SELECT item_id, lower(text) AS x, regexp_split_to_array(replace(lower(text), '-', ' '), '\s+') AS w FROM benchmark),
k AS (SELECT item_id, topic_id, x, w, unnest(ks) AS k FROM b, t),
h AS (SELECT item_id, topic_id, count(*) FILTER (list_contains(w, k)) AS exact_hits, count(*) FILTER (NOT list_contains(w, k)) AS loose_hits, max(length(k)) AS specificity FROM k WHERE contains(x, k) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY exact_hits DESC, loose_hits DESC, specificity DESC, topic_id) AS place FROM h""")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each text by exact hits, loose hits and the longest keyword; a text has at most one row a topic."""
    rows = op.matched_topics(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", _TOPICS)
    order = Window.partitionBy("item_id").orderBy(F.desc("exact_hits"), F.desc("loose_hits"), F.desc("specificity"), "topic_id")
    return rows.drop("text").withColumn("place", F.row_number().over(order).cast("long"))


@query("w16_url_candidates", E + """, c AS (SELECT regexp_replace(url, '/[0-9]+$', '') AS url, id * 31 % 17 AS score, CASE status WHEN 'active' THEN 0 WHEN 'archived' THEN 1 ELSE 2 END AS class FROM entries)
SELECT url, score, class FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, class) AS n FROM c) WHERE n = 1 ORDER BY score DESC, class, url LIMIT 50""")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best URLs by score and class, each once; the best row of a URL comes from a partial aggregate."""
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "archived", 1).otherwise(2)
    c = entries(spark, sf_dir).select(F.regexp_replace("url", "/[0-9]+$", "").alias("url"), (-(F.col("id") * 31 % 17)).alias("less"), rank.alias("class"))
    best = c.groupBy("url").agg(F.min(F.struct("less", "class")).alias("b")).select("url", (-F.col("b.less")).alias("score"), "b.class")
    return best.orderBy(F.desc("score"), "class", "url").limit(50)


_PATH = "list_filter(string_split(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: trim(p) <> '')"
_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_POINTS = f"""p AS (SELECT *, {_PATH.format(u="url")} AS parts FROM {{src}}), j AS (SELECT *, lower(url_decode(array_to_string(parts, ' '))) AS path FROM p),
g AS (SELECT *, 3 * len(list_filter({_LIST(op.HIGH_SIGNAL)}, lambda t: contains(path, t))) - 4 * len(list_filter({_LIST(op.LOW_SIGNAL)}, lambda t: contains(path, t))) - least(len(parts), 8) + (len(parts) <= 2)::INT AS points FROM j)"""
_SLUGS = "page_id, regexp_replace(url, '/[^/]*$', '') || '/' || (['beratung', 'presse/news', 'Hilfe%20Arbeitslos', 'a/b/c'])[CAST(page_id % 4 AS INT) + 1] AS url"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.element_at(F.array(*map(F.lit, ("beratung", "presse/news", "Hilfe%20Arbeitslos", "a/b/c"))), (F.col("page_id") % 4).cast("int") + 1)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "/[^/]*$", ""), F.lit("/"), slug).alias("url"))


@query("r23_sitemap_points", f"WITH s AS (SELECT {_SLUGS} FROM pages), {_POINTS.format(src='s')} SELECT page_id, points::BIGINT AS points FROM g")
def r23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each page's path, whose last part is replaced by one that the tables of parts know."""
    return _paths(spark, sf_dir).select("page_id", op.sitemap_points(F.col("url")).alias("points"))


@query("w17_sitemap_sample", f"WITH s AS (SELECT DISTINCT url FROM (SELECT {_SLUGS} FROM pages)), {_POINTS.format(src='s')} SELECT url, points::BIGINT AS points FROM g ORDER BY points DESC, length(url), url LIMIT 20")
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 distinct URLs that promise most, short ones first."""
    urls = _paths(spark, sf_dir).select("url").distinct().withColumn("points", op.sitemap_points(F.col("url")))
    return urls.orderBy(F.desc("points"), F.length("url"), "url").limit(20)


_RAW = "q AS (SELECT id AS k, CASE WHEN id % 5 > 0 THEN id::VARCHAR ELSE '' END AS id, CASE WHEN id % 2 = 0 THEN 'e' || id END AS a, CASE WHEN id % 3 = 0 THEN 'f' || id END AS b, domain, CASE id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'drop' WHEN 2 THEN '' END AS action, status, last_seen, first_seen FROM entries)"
_CANON = f"{_RAW}, c AS (SELECT k, CASE WHEN id <> '' THEN id ELSE coalesce(a, b, '') END AS id, coalesce(a, b) AS entry_id, domain, coalesce(nullif(action, ''), 'update') AS action, CASE WHEN status = 'archived' THEN 'pending' WHEN status = 'active' THEN 'approved' ELSE status END AS status, last_seen AS created_at FROM q)"


def _raw_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return entries(spark, sf_dir).select(
        F.when(k % 5 > 0, k.cast("string")).otherwise("").alias("id"), F.when(k % 2 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("entryId"), F.when(k % 3 == 0, F.concat(F.lit("f"), k.cast("string"))).alias("entry_id"), "domain",
        F.when(k % 4 == 0, "create").when(k % 4 == 1, "drop").when(k % 4 == 2, "").alias("action"), F.when(F.col("status") == "archived", F.lit(None)).when(F.col("status") == "active", "approved").otherwise(F.col("status")).alias("status"), F.col("last_seen").alias("createdAt"),
    )


@query("p15_queue_canonical", E + f", {_CANON} SELECT id, entry_id, domain, action, status, created_at FROM c")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows in either spelling under one."""
    return op.canonical_queue(_raw_queue(spark, sf_dir))


@query("d07_queue_validation", E + f""", {_CANON} SELECT id, list_filter([CASE WHEN created_at IS NULL THEN 'Missing required field ''created_at''' END, CASE WHEN status NOT IN ('pending', 'approved', 'rejected', 'accepted') THEN 'Field ''status'' must be one of pending|approved|rejected|accepted' END,
CASE WHEN action NOT IN ('create', 'update', 'delete') THEN 'Field ''action'' must be one of create|update|delete' END], lambda x: x IS NOT NULL) AS errors FROM c""")
def d07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each canonical queue row."""
    return op.canonical_queue(_raw_queue(spark, sf_dir)).select("id", op.queue_errors().alias("errors"))


@query("d02_field_mismatches", """WITH s AS (SELECT event_id, replace(props, '"k"', ['"k"', '"Title"', '"target_groups"', '"SOURCE_TIER"', '"url"'][CAST(event_id % 5 AS INT) + 1]) AS p FROM events), f AS (SELECT event_id, json_keys(p) AS ks FROM s),
m AS (SELECT event_id, unnest(ks) AS f FROM f)
SELECT f.event_id, coalesce((SELECT list(m.f || ' -> ' || a.n ORDER BY m.f) FROM m JOIN (VALUES ('title'), ('url'), ('targetGroups'), ('sourceTier'), ('K')) a(n) ON lower(replace(a.n, '_', '')) = lower(replace(m.f, '_', '')) AND a.n <> m.f WHERE m.event_id = f.event_id), []) AS mismatches FROM f""")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every event's properties that are spelt otherwise than the schema spells them; one of five names stands in them."""
    names = F.element_at(F.array(*map(F.lit, ('"k"', '"Title"', '"target_groups"', '"SOURCE_TIER"', '"url"'))), (F.col("event_id") % 5).cast("int") + 1)
    keys = F.json_object_keys(F.replace(F.col("props"), F.lit('"k"'), names))
    return table(spark, sf_dir, "events").select("event_id", op.field_mismatches(F.coalesce(keys, F.array().cast("array<string>")), ("title", "url", "targetGroups", "sourceTier", "K")).alias("mismatches"))


@query("d03_translation_fields", E + """SELECT id, CASE WHEN title_en IS NULL THEN ['title: Missing required field'] ELSE [] END || ['provenance: Missing required field'] || CASE WHEN summary_en IS NULL THEN []::VARCHAR[] ELSE ['Unknown field ''abstract'''] END AS errors FROM entries""")
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and unknown fields of each entry's translation."""
    fields = F.array_compact(F.array(F.when(F.col("title_en").isNotNull(), "title"), F.lit("timestamp"), F.lit("method"), F.when(F.col("summary_en").isNotNull(), "abstract")))
    return entries(spark, sf_dir).select("id", op.translation_errors(fields).alias("errors"))


@query("t14_text_blocks", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g'), ' -|')) AS block FROM documents")
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(op.text_block(F.col("text"))).alias("block"))


@query("v09_text_to_embed", E + """, w AS (SELECT id, concat_ws(chr(10) || chr(10), 'Title: ' || nullif(title_de, ''), 'Description: ' || nullif(summary_de, ''), CASE WHEN length(coalesce(summary_de, '')) < 100 THEN 'Content: ' || nullif(content_de, '') END) AS t FROM entries),
n AS (SELECT id, t, ceil(length(t) / 4) AS k FROM w) SELECT id, md5(CASE WHEN k > 8000 THEN substring(t, 1, CAST(floor(length(t) * (8000.0::DOUBLE / k)) AS INT)) ELSE t END) AS embed FROM n""")
def v09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of each entry."""
    return entries(spark, sf_dir).select("id", F.md5(op.text_to_embed(F.col("title_de"), F.col("summary_de"), F.col("content_de"))).alias("embed"))


_LONG = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\W+'), lambda w: length(w) > 4))"


@query("t27_context_overlap", f"""WITH w AS (SELECT a.conv_id, a.turn, {_LONG.format("a.text")} AS answer, {_LONG.format("c.text")} AS context FROM conversations a LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1 WHERE a.role = 'assistant')
SELECT conv_id, turn, round(CASE WHEN coalesce(len(answer), 0) = 0 OR context IS NULL THEN 0 ELSE len(list_intersect(answer, context)) / len(answer) END, 6)::DOUBLE AS overlap FROM w""")
def t27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each answer is grounded in the message before it; one without such a message isn't at all."""
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return c.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(F.coalesce(op.context_overlap(F.col("text"), F.coalesce("context", F.lit(""))), F.lit(0.0)), 6).alias("overlap"))


@query("t30_critical_info", E + ", t AS (SELECT id, coalesce(title_de, '') || ': ' || id || ',50 € bis ' || (2000 + id % 30) || ', ab ' || id % 90 || ' Jahren, Arbeitslos, am ' || (1 + id % 28) || '.12.2024' AS x FROM entries) SELECT id, " + ", ".join(f"list_sort(list_distinct(regexp_extract_all(x, '(?i){p}'))) AS {n}" for n, p in op.CRITICAL.items()) + " FROM t")
def t30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, dates and requirements of each entry's line, sorted."""
    k = F.col("id")
    line = F.concat(F.coalesce("title_de", F.lit("")), F.lit(": "), k.cast("string"), F.lit(",50 € bis "), (2000 + k % 30).cast("string"), F.lit(", ab "), (k % 90).cast("string"), F.lit(" Jahren, Arbeitslos, am "), (1 + k % 28).cast("string"), F.lit(".12.2024"))
    e = entries(spark, sf_dir).select("id", line.alias("x"))
    return e.select("id", *op.critical(F.col("x"))).select("id", *[F.array_sort(n).alias(n) for n in op.CRITICAL])


@query("u07_merged_pins", E + ", p AS (SELECT lang AS section, host AS url, title_de AS title, id AS place FROM entries WHERE domain <> 'aid') SELECT section, url, arg_min(struct_pack(t := title), place).t AS title, min(place) AS place FROM p GROUP BY section, url")
def u07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pin for each section and URL, the first; entries of one domain stand for pins without a URL."""
    return op.merged_pins(entries(spark, sf_dir).select(F.col("lang").alias("section"), F.when(F.col("domain") != "aid", F.col("host")).alias("url"), F.col("title_de").alias("title"), F.col("id").alias("place")))


@query("u09_stale_keys", E + "SELECT id, CASE WHEN tier = 'tier_unknown' THEN ['source', 'sourceTierInferredAt', 'sourceTierInferredFrom'] ELSE ['source'] END AS keys FROM entries")
def u09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the provenance, without those of an inferred tier where the tier isn't inferred."""
    stale = ("sourceTierInferredFrom", "sourceTierInferredAt")
    kept = F.map_filter("p", lambda k, v: ~k.isin(*stale) | (F.coalesce("tier", F.lit("")) == "tier_unknown"))
    e = entries(spark, sf_dir).withColumn("p", F.create_map(F.lit("source"), "source", F.lit(stale[0]), "host", F.lit(stale[1]), F.col("first_seen").cast("string")))
    return e.select("id", F.array_sort(F.map_keys(kept)).alias("keys"))


@query("j11_resolved_pins", E + """, p AS (SELECT CASE WHEN id % 3 = 0 THEN url ELSE url || '/pin' END AS url, CASE WHEN id % 2 = 0 THEN domain END AS domain, CASE WHEN id % 7 = 0 THEN 'pin ' || id END AS title FROM entries)
SELECT p.url, coalesce(e.id::VARCHAR, coalesce(p.domain, 'pinned') || ':' || p.url) AS id, coalesce(p.domain, e.domain, 'benefits') AS domain, coalesce(p.title, e.title_de, p.url) AS title, coalesce(e.tier, 'unknown') AS tier FROM p LEFT JOIN entries e ON e.url = p.url""")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins with what is known of their entries."""
    e, k = entries(spark, sf_dir), F.col("id")
    pins = e.select(F.when(k % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/pin"))).alias("url"), F.when(k % 2 == 0, F.col("domain")).alias("domain"), F.when(k % 7 == 0, F.concat(F.lit("pin "), k.cast("string"))).alias("title"))
    return op.resolved_pins(pins, e)


_NORMAL = r"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\p{L}\p{N}]', ' ', 'g'), ' +', ' ', 'g'))"


@query("j21_scenario_keywords", f"""WITH q AS (SELECT item_id, {_NORMAL} AS t FROM benchmark), k(keyword) AS (VALUES ('heron'), ('the thin'), ('and than thon'), ('er'))
SELECT item_id, keyword FROM q, k WHERE contains(t, keyword) OR contains(replace(t, ' ', ''), replace(keyword, ' ', '')) OR
(contains(keyword, ' ') AND len(list_filter(string_split(keyword, ' '), lambda w: NOT list_contains(string_split(t, ' '), w))) = 0)""")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario keywords that each text has: in it, in it without spaces, or word by word."""
    q = table(spark, sf_dir, "benchmark").select("item_id", op.scenario_text(F.col("text")).alias("t"))
    found = F.array_compact(F.array(*[F.when(op.keyword_matches(F.col("t"), k), k) for k in ("heron", "the thin", "and than thon", "er")]))
    return q.select("item_id", F.explode(found).alias("keyword"))


@query("d20_seed_prune", E + """, s AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 4 = 0 THEN 'https://' || host || '/' ELSE url END AS url, source FROM entries), v AS (SELECT regexp_replace(lower(url), '/+$', '') AS u FROM s WHERE url IS NOT NULL AND source NOT LIKE '%3')
SELECT * FROM (SELECT 'missing_url' AS reason, count(*) AS n FROM s WHERE url IS NULL UNION ALL SELECT 'blocked', count(*) FROM s WHERE url IS NOT NULL AND source LIKE '%3' UNION ALL SELECT 'kept', count(DISTINCT u) FROM v UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT u) FROM v) WHERE n > 0""")
def d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds that stay and go, by reason."""
    k = F.col("id")
    url = F.when(k % 9 == 0, F.lit(None)).when(k % 4 == 0, F.concat(F.lit("https://"), "host", F.lit("/"))).otherwise(F.col("url"))
    return op.prune_counts(entries(spark, sf_dir).select(url.alias("url"), "source"), F.col("url"), F.col("source").endswith("3"))


@query("a28_section_counters", SQL["r26_scenario_overlap"].replace("\nSELECT id, round(", ", o AS (SELECT id, round(").replace("AS overlap FROM told", "AS overlap FROM told)") + """
SELECT domain, count(*) AS resources, count(*) FILTER (coalesce(tier, 'tier_unknown') = 'tier_unknown') AS unknown_tiers, count(*) FILTER (overlap < 0.08) AS low_overlap FROM entries JOIN o USING (id) GROUP BY domain""")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of each section, those of unknown tier, and those that share too few words with their scenario."""
    rows = entries(spark, sf_dir).select("id", "domain", "tier").join(r26(spark, sf_dir), "id")
    return rows.groupBy("domain").agg(F.count("*").alias("resources"), F.count_if(F.coalesce("tier", F.lit("tier_unknown")) == "tier_unknown").alias("unknown_tiers"), F.count_if(F.col("overlap") < 0.08).alias("low_overlap"))
