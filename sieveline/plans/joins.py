"""Joins, set operations and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as fx
from sieveline.operators import joins as op
from sieveline.operators import ranking as rk
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL} "


@query("j01_queue_left_join", "SELECT o_orderkey AS queue_id, o_orderstatus AS queue_status, c_name AS name, c_acctbal AS balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal")
    o = table(spark, sf_dir, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(F.col("o_orderkey").alias("queue_id"), F.col("o_orderstatus").alias("queue_status"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


@query("j02_extension_row", E + "SELECT e.id, e.domain, l.quality AS extension_quality FROM entries e LEFT JOIN labels l ON e.id = l.doc_id AND e.domain IN ('aid', 'benefits')")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, x = entries(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return e.join(x, (e.id == x.doc_id) & e.domain.isin("aid", "benefits"), "left").select("id", "domain", F.col("quality").alias("extension_quality"))


@query("j03_translations_attach", E + "SELECT e.id, t.title AS english FROM entries e LEFT JOIN (SELECT id, title_en AS title FROM entries WHERE title_en IS NOT NULL) t ON e.id = t.id")
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    t = e.where("title_en is not null").select("id", F.col("title_en").alias("english"))
    return e.select("id").join(t, "id", "left")


@query("j04_create_or_update", E + ", c AS (SELECT id AS candidate, CASE WHEN id % 4 = 0 THEN url || '/new' ELSE url END AS url FROM entries) SELECT candidate, c.url, CASE WHEN x.existing_id IS NULL THEN 'create' ELSE 'update' END AS action, existing_id FROM c LEFT JOIN (SELECT url, max(id) AS existing_id FROM entries WHERE id % 3 <> 0 GROUP BY url) x ON c.url = x.url")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    c = e.select(F.col("id").alias("candidate"), F.when(F.col("id") % 4 == 0, F.concat("url", F.lit("/new"))).otherwise(F.col("url")).alias("url"))
    return op.classify(c, e.where("id % 3 <> 0").select("id", "url")).select("candidate", "url", "action", "existing_id")


@query("j05_seed_registry", E + ", registry AS (SELECT url, CASE WHEN id % 2 = 0 THEN 'gone' ELSE 'ok' END AS state FROM entries WHERE id % 5 = 0) SELECT e.id, e.url FROM entries e WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.url = e.url AND r.state = 'gone')")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    gone = e.where("id % 5 = 0 and id % 2 = 0").select("url")
    return e.select("id", "url").join(gone, "url", "left_anti")


_PROFILES = (("example.org", 1, 5), ("example.net", 2, 5), ("blog.example.com", 3, 1), ("tionsh.example.net", 1, 2), ("example.com", 3, 3))
_H = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"


@query("j07_source_profile", f"WITH profiles(profile, tier, priority) AS (VALUES {', '.join(str(p) for p in _PROFILES)}) SELECT page_id, host, profile, tier FROM (SELECT p.page_id, p.host, r.profile, r.tier, row_number() OVER (PARTITION BY p.page_id ORDER BY r.profile IS NULL, r.tier, r.priority, length(r.profile) DESC) AS n FROM (SELECT page_id, {_H} AS host FROM pages) p LEFT JOIN profiles r ON p.host = r.profile OR p.host LIKE '%.' || r.profile) WHERE n = 1")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", fx.host(F.col("url")).alias("host"))
    profiles = op.rules(spark.createDataFrame(_PROFILES, "profile string, tier int, priority int"))
    order = [F.col("tier"), F.col("priority"), F.length("profile").desc()]
    return op.by_suffix(pages, "host", profiles, "profile", order, ["page_id"]).select("page_id", "host", "profile", "tier")


def _extensions(e: DataFrame) -> dict[str, DataFrame]:
    """Extension rows of two domains, each with columns of its own; not all entries have one."""
    k = F.col("id")
    return {"benefits": e.where((F.col("domain") == "benefits") & (k % 3 != 0)).select("id", F.concat(k.cast("string"), F.lit(" Monate")).alias("duration")), "tools": e.where(F.col("domain") == "tools").select("id", F.lit("rechner").alias("kind"), (k % 4).alias("level"))}


@query("j02_extension_rows", E + "SELECT id, domain, CASE WHEN domain = 'benefits' AND id % 3 <> 0 THEN id || ' Monate' END AS duration, CASE WHEN domain = 'tools' THEN 'rechner' END AS kind FROM entries")
def j02_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with the row of its domain's extension table."""
    e = entries(spark, sf_dir).select("id", "domain")
    told = op.with_extension(e, _extensions(e))
    return told.select("id", "domain", F.get_json_object("extension", "$.duration").alias("duration"), F.get_json_object("extension", "$.kind").alias("kind"))


@query("s09_upsert_extended", E + """, n AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'tools' ELSE domain END AS domain FROM entries WHERE id % 5 = 0)
SELECT e.id, coalesce(n.domain, e.domain) AS domain, CASE WHEN n.id IS NULL THEN e.title_de ELSE 'neu' END AS title, e.first_seen,
    CASE WHEN n.domain = 'benefits' THEN 'neu' WHEN n.id IS NULL AND e.domain = 'benefits' AND e.id % 3 <> 0 THEN e.id || ' Monate' END AS duration, CASE WHEN n.domain = 'tools' THEN 'lotse' WHEN n.id IS NULL AND e.domain = 'tools' THEN 'rechner' END AS kind
FROM entries e LEFT JOIN n ON n.id = e.id""")
def s09_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the entries comes again with extension rows, half of those under another domain."""
    e = entries(spark, sf_dir).select("id", "domain", F.col("title_de").alias("title"), "first_seen")
    new = e.where("id % 5 = 0").withColumns({"domain": F.when(F.col("id") % 10 == 0, "tools").otherwise(F.col("domain")), "title": F.lit("neu"), "first_seen": F.lit("2030-01-01").cast("timestamp")})
    fresh = {"benefits": new.select("id", F.lit("neu").alias("duration")), "tools": new.select("id", F.lit("lotse").alias("kind"), F.lit(0).cast("long").alias("level"))}
    rows, tables = op.upsert_extended(e, _extensions(e), new, fresh, ["first_seen"], ["title"])
    told = op.with_extension(rows, tables)
    return told.select("id", "domain", "title", "first_seen", F.get_json_object("extension", "$.duration").alias("duration"), F.get_json_object("extension", "$.kind").alias("kind"))


_SOURCES = (("high", "example.org", "tier_3_press", "high", ["aid", "tools"]), ("ngo", "tionsh.example.net", "tier_2_ngo_watchdog", "normal", ["aid"]), ("law", "example.net", "tier_1_official", "normal", ["tools"]), ("low", "m.tionsh.example.net", "tier_1_official", "normal", ["aid"]), ("wide", "example.net", "tier_1_official", "normal", ["aid"]))


@query("j07_resolved_sources", f"""WITH p AS (SELECT page_id, {_H} AS h, ['aid', 'tools', 'benefits'][CAST(page_id % 3 AS INT) + 1] AS d FROM pages),
s(source_id, host, tier, a, b, d) AS (VALUES ('high', 'example.org', 'tier_3_press', 2, 0, 'aid'), ('high', 'example.org', 'tier_3_press', 2, 0, 'tools'), ('ngo', 'tionsh.example.net', 'tier_2_ngo_watchdog', 1, 1, 'aid'), ('law', 'example.net', 'tier_1_official', 0, 1, 'tools'), ('low', 'm.tionsh.example.net', 'tier_1_official', 0, 1, 'aid'), ('wide', 'example.net', 'tier_1_official', 0, 1, 'aid')),
m AS (SELECT p.page_id, s.source_id, s.tier, row_number() OVER (PARTITION BY p.page_id ORDER BY a, b, length(s.host), s.source_id) AS n FROM p JOIN s ON s.d = p.d AND (p.h = s.host OR p.h LIKE '%.' || s.host))
SELECT p.page_id, CASE WHEN m.source_id IS NOT NULL THEN m.source_id WHEN h LIKE '%example.com' THEN replace(h, '.', '_') END AS source_id, CASE WHEN m.source_id IS NOT NULL THEN m.tier WHEN h LIKE '%example.com' THEN 'tier_2_official' END AS source_tier,
    CASE WHEN m.source_id IS NOT NULL THEN 'registered' WHEN h LIKE '%example.com' THEN 'inferred' END AS source_status FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.n = 1""")
def j07_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of every page in one of three domains: registered for that domain, inferred from its host, or none."""
    domain = F.element_at(F.array(*map(F.lit, ("aid", "tools", "benefits"))), (F.col("page_id") % 3).cast("int") + 1)
    p = table(spark, sf_dir, "pages").select("page_id", fx.host(F.col("url")).alias("host"), domain.alias("domain"))
    profiles = spark.createDataFrame(_SOURCES, "source_id string, host string, tier string, priority string, domains array<string>")
    inferred = F.when(fx.under(F.col("host"), F.lit("example.com")), "tier_2_official")
    return op.resolved_source(p, "host", "domain", profiles, inferred).select("page_id", "source_id", "source_tier", "source_status")


@query("j09_merge_better", E + ", o AS (SELECT url, iqs, ais FROM entries WHERE id % 3 <> 0), n AS (SELECT url, 100 - iqs AS iqs, 100 - ais AS ais FROM entries WHERE id % 4 <> 0), j AS (SELECT o.url AS ou, n.url AS nu, o.iqs AS oi, o.ais AS oa, n.iqs AS ni, n.ais AS na, o.url IS NULL OR (n.url IS NOT NULL AND (coalesce(n.ais, 0) > coalesce(o.ais, 0) OR coalesce(n.iqs, 0) > coalesce(o.iqs, 0))) AS b FROM o FULL JOIN n ON o.url = n.url) SELECT coalesce(ou, nu) AS url, CASE WHEN b THEN ni ELSE oi END AS iqs, CASE WHEN b THEN na ELSE oa END AS ais, CASE WHEN ou IS NULL THEN 'added' WHEN b THEN 'replaced' ELSE 'kept' END AS outcome FROM j")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    old = e.where("id % 3 <> 0").select("url", "iqs", "ais")
    new = e.where("id % 4 <> 0").select("url", (100 - F.col("iqs")).alias("iqs"), (100 - F.col("ais")).alias("ais"))
    return op.merge_better(old, new, "url", ["iqs", "ais"])


@query("j10_catalog_sources", "WITH r(name, hosts) AS (VALUES ('first', ['src0.example.org', 'src1.example.org']), ('second', ['src2.example.org']), ('none', ['other.example.org'])), s AS (SELECT source || '.example.org' AS host, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1) SELECT r.name, coalesce(sum(s.n), 0) AS entries, coalesce(sum(s.chars), 0) AS chars FROM (SELECT name, unnest(hosts) AS host FROM r) r LEFT JOIN s ON r.host = s.host GROUP BY r.name")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame([("first", ["src0.example.org", "src1.example.org"]), ("second", ["src2.example.org"]), ("none", ["other.example.org"])], "name string, hosts array<string>")
    stats = table(spark, sf_dir, "documents").groupBy(F.concat("source", F.lit(".example.org")).alias("host")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    joined = r.select("name", F.explode("hosts").alias("host")).join(stats, "host", "left")
    return joined.groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


@query("j12_pack_url_boost", E + ", pins AS (SELECT lower(url) || '/' AS url, 8 + id % 3 AS boost FROM entries WHERE id % 6 = 0) SELECT e.id, coalesce(p.boost, 0) AS boost FROM entries e LEFT JOIN (SELECT regexp_replace(lower(trim(url)), '/+$', '') AS url, max(boost) AS boost FROM pins GROUP BY 1) p ON regexp_replace(lower(trim(e.url)), '/+$', '') = p.url")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    pins = e.where("id % 6 = 0").select(fx.plain_url(F.concat(F.lower("url"), F.lit("/"))).alias("key"), (8 + F.col("id") % 3).alias("boost")).groupBy("key").agg(F.max("boost").alias("boost"))
    return e.select("id", fx.plain_url(F.col("url")).alias("key")).join(pins, "key", "left").select("id", F.coalesce("boost", F.lit(0)).alias("boost"))


@query("j15_taxonomy_membership", E + ", t AS (SELECT id, unnest(topics) AS topic FROM entries) SELECT DISTINCT id, topic AS unknown_topic FROM t WHERE topic NOT IN ('family', 'housing', 'work')")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("family",), ("housing",), ("work",)], "topic string")
    return entries(spark, sf_dir).select("id", F.explode("topics").alias("topic")).join(op.rules(known), "topic", "left_anti").select("id", F.col("topic").alias("unknown_topic")).distinct()


@query("j16_lookup_or_drop", E + "SELECT p.p_partkey AS probe, e.id FROM part p JOIN entries e ON e.url = 'https://www.src' || (p.p_partkey % 20) || '.example.org/en/' || p.p_partkey")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    probes = table(spark, sf_dir, "part").select(k.alias("probe"), F.concat(F.lit("https://www.src"), (k % 20).cast("string"), F.lit(".example.org/en/"), k.cast("string")).alias("url"))
    return probes.join(entries(spark, sf_dir).select("id", "url"), "url").select("probe", "id")


@query("j17_duplicate_urls", "WITH c AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS u FROM pages), old AS (SELECT u FROM c WHERE page_id % 2 = 0) SELECT page_id FROM c WHERE page_id % 3 = 0 AND u IN (SELECT u FROM old) OR page_id % 3 <> 0 AND u || '/neu' IN (SELECT u FROM old)")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose canonical URL is known: every page comes again, a third of them in another spelling, the others below their URL; even pages are known."""
    bare = F.regexp_replace(fx.bare_url(F.col("url")), "/+$", "")
    p = table(spark, sf_dir, "pages").select("page_id", bare.alias("u"))
    again = F.when(F.col("page_id") % 3 == 0, F.concat("u", F.lit("/?utm_medium=mail#top"))).otherwise(F.concat("u", F.lit("/neu")))
    known = p.where("page_id % 2 = 0").select(fx.canonical_url(F.col("u")).alias("key"))
    return p.select("page_id", fx.canonical_url(again).alias("key")).join(known, "key", "left_semi").select("page_id")


@query("j18_trusted_sources", E + "SELECT id, id IN (SELECT doc_id FROM labels WHERE quality = 1) OR url IN (SELECT url FROM entries WHERE tier = 'tier_1_official') AS trusted FROM entries")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).select("id", "url", "tier")
    ids = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("by_id")).distinct()
    urls = e.where("tier = 'tier_1_official'").select("url", F.lit(True).alias("by_url")).distinct()
    return e.join(ids, "id", "left").join(urls, "url", "left").select("id", (F.coalesce("by_id", F.lit(False)) | F.coalesce("by_url", F.lit(False))).alias("trusted"))


@query("j19_blocked_sources", E + "SELECT id, source FROM entries WHERE source NOT IN ('src1', 'src7', 'src11')")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = spark.createDataFrame([("src1",), ("src7",), ("src11",)], "source string")
    return entries(spark, sf_dir).select("id", "source").join(op.rules(blocked), "source", "left_anti")


_TRIGGERS = (("the", "article"), ("thon", "suffix"), ("ation", "noun"), ("ea", "water"))


@query("j20_longest_trigger", f"WITH t(word, name) AS (VALUES {', '.join(str(t) for t in _TRIGGERS)}) SELECT conv_id, turn, max_by(name, length(word)) AS override FROM conversations c JOIN t ON contains(lower(c.text), t.word) GROUP BY conv_id, turn")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = op.rules(spark.createDataFrame(_TRIGGERS, "word string, name string"))
    c = table(spark, sf_dir, "conversations")
    return c.join(t, F.lower(c.text).contains(t.word)).groupBy("conv_id", "turn").agg(F.max_by("name", F.length("word")).alias("override"))


@query("j24_insert_new", E + "SELECT id, source FROM entries WHERE id % 3 = 0 UNION ALL SELECT id, 'new' FROM entries WHERE id % 2 = 0 AND id % 3 <> 0")
def j24(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).select("id", "source")
    return op.insert_new(e.where("id % 3 = 0"), e.where("id % 2 = 0").withColumn("source", F.lit("new")), "id")


@query("s09_upsert", E + ", o AS (SELECT id, first_seen, last_seen FROM entries WHERE id % 3 <> 0), n AS (SELECT id, TIMESTAMP '2025-01-01' AS first_seen, CASE WHEN id % 5 <> 0 THEN TIMESTAMP '2025-01-01' END AS last_seen FROM entries WHERE id % 2 = 0) SELECT coalesce(o.id, n.id) AS id, CAST(coalesce(o.first_seen, n.first_seen) AS VARCHAR) AS first_seen, CAST(coalesce(n.last_seen, o.last_seen) AS VARCHAR) AS last_seen FROM o FULL JOIN n ON o.id = n.id")
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, now = entries(spark, sf_dir), F.lit("2025-01-01").cast("timestamp")
    old = e.where("id % 3 <> 0").select("id", "first_seen", "last_seen")
    new = e.where("id % 2 = 0").select("id", now.alias("first_seen"), F.when(F.col("id") % 5 != 0, now).alias("last_seen"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return op.upsert(old, new, "id", ["first_seen"], ["last_seen"]).select("id", stamp("first_seen"), stamp("last_seen"))


@query("u01_union_dedupe", E + ", l AS (SELECT id, url, 'external' AS origin, 0 AS pos FROM entries WHERE id % 4 = 0 UNION ALL SELECT id, url, 'keyword', 1 FROM entries WHERE id % 3 = 0 UNION ALL SELECT id, url, 'curated', 2 FROM entries WHERE id % 2 = 0) SELECT id, url, origin FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos, id) AS n FROM l) WHERE n = 1")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).select("id", "url")
    part = lambda k, name, pos: e.where(f"id % {k} = 0").withColumns({"origin": F.lit(name), "pos": F.lit(pos)})
    every = part(4, "external", 0).unionByName(part(3, "keyword", 1)).unionByName(part(2, "curated", 2))
    return rk.first_of(every, ["url"], ["pos", "id"]).select("id", "url", "origin")


@query("u03_ordered_union", E + "SELECT id, array_to_string(list_distinct_ordered, '|') AS labels FROM (SELECT id, [x FOR x, i IN l IF list_position(l, x) = i] AS list_distinct_ordered FROM (SELECT id, list_concat(topics, coalesce(tags, [])) AS l FROM entries))")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", F.array_join(F.array_distinct(F.concat("topics", F.coalesce("tags", F.array().cast("array<string>")))), "|").alias("labels"))


@query("u04_facet_difference", E + "SELECT id, array_to_string(list_sort(list_distinct([x FOR x IN topics IF NOT list_contains(['family', 'work'], x)])), '|') AS added, array_to_string([x FOR x IN ['family', 'work'] IF NOT list_contains(topics, x)], '|') AS removed FROM entries")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.array(F.lit("family"), F.lit("work"))
    return entries(spark, sf_dir).select("id", F.array_join(F.array_sort(F.array_except("topics", old)), "|").alias("added"), F.array_join(F.array_except(old, "topics"), "|").alias("removed"))


@query("u05_token_overlap", "WITH b AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents) SELECT item_id, doc_id, len(list_intersect(b.w, d.w)) / len(b.w) AS ratio FROM b JOIN d ON len(list_intersect(b.w, d.w)) / len(b.w) >= 0.5")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have at least half of a benchmark item's words."""
    words = F.array_distinct(F.split(F.lower("text"), " "))
    return op.word_containment(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", words, 0.5)


@query("u05_token_overlap_all", "WITH b AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents) SELECT item_id, doc_id, len(list_intersect(b.w, d.w)) / len(b.w) AS ratio FROM b JOIN d ON list_has_any(b.w, d.w)")
def u05_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("text"), " "))
    return op.word_overlap(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", words)


@query("u06_record_diff", "WITH o AS (SELECT p_partkey AS k, p_name, p_brand, p_size FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END AS p_name, p_brand, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0) SELECT coalesce(o.k, n.k) AS id, CASE WHEN o.k IS NULL THEN 'create' WHEN n.k IS NULL THEN 'delete' WHEN o.p_name <> n.p_name OR o.p_size <> n.p_size THEN 'update' ELSE 'unchanged' END AS kind, CASE WHEN o.k IS NULL OR n.k IS NULL THEN 0 ELSE (o.p_name <> n.p_name)::INT + (o.p_size <> n.p_size)::INT END AS n_modified FROM o FULL JOIN n ON o.k = n.k")
def u06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sieveline.operators.quality import diff

    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    old = p.where("id % 5 <> 0").select("id", "p_name", "p_brand", "p_size")
    new = p.where("id % 7 <> 0").select("id", F.when(F.col("id") % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"), "p_brand", F.when(F.col("id") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return diff(old, new, "id").select("id", "kind", F.coalesce(F.size("modified"), F.lit(0)).alias("n_modified"))


@query("u08_manifest_dedupe", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def u08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").dropDuplicates()
