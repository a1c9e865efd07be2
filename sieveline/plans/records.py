"""Records, cleaned fields and snapshots as queries; SQL beside each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as fx
from sieveline.operators import cleaning, filters
from sieveline.operators import records as op
from sieveline.operators import texts
from sieveline.plans.registry import query
from sieveline.session import discard, shared_dir, stash, table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL}"


@query("p04_benefit_record", E + """SELECT id, CASE WHEN coalesce(trim(title_de), '') <> '' THEN title_de END AS amount, coalesce(len(list_filter([summary_de, summary_en], lambda x: coalesce(x, '') <> '')), 0) AS languages, nullif(trim(CASE WHEN id % 2 = 0 THEN ' zwei Jahre ' ELSE ' ' END), '') AS duration,
CASE WHEN id % 3 = 0 THEN ['a', 'b'] ELSE []::VARCHAR[] END AS steps FROM entries""")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, k = F.lit(None).cast("string"), F.col("id")
    r = op.benefit({"de": F.col("title_de")}, {"de": F.col("summary_de"), "en": F.col("summary_en")}, F.when(k % 2 == 0, " zwei Jahre ").otherwise(" "), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))), F.lit(None).cast("array<string>"), none, none)
    return entries(spark, sf_dir).select("id", r.alias("r")).select("id", F.col("r.benefitAmount")["de"].alias("amount"), F.coalesce(F.size("r.eligibilityCriteria"), F.lit(0)).cast("long").alias("languages"), "r.duration", F.col("r.applicationSteps").alias("steps"))


@query("p07_without_translations", E + "SELECT id, url FROM entries")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).select("id", "url", F.create_map(F.lit("en"), "title_en").alias("translations"))
    return op.without_translations(rows)


@query("p09_iso_times", "SELECT event_id, regexp_replace(strftime(t, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') AS at, [regexp_replace(strftime(t, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', ''), NULL] AS times, strftime(t, '%Y-%m-%d') AS day FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE ts END AS t FROM events)")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and dates of every event in a struct, a list and a map as text."""
    t = F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts"))
    nested = table(spark, sf_dir, "events").select("event_id", F.struct(t.alias("at"), F.array(t, F.lit(None).cast("timestamp")).alias("times"), F.create_map(F.lit("day"), t.cast("date")).alias("days")).alias("v"))
    told = nested.select("event_id", cleaning.iso_times(F.col("v"), nested.schema["v"].dataType).alias("v"))
    return told.select("event_id", "v.at", "v.times", F.col("v.days")["day"].alias("day"))


_ONE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


@query("p11_cleaned_fields", E + f"""SELECT id, trim('Ämter & Co € ' || {_ONE('title_de')}) AS title, CASE WHEN id % 5 = 0 THEN '' ELSE {_ONE('summary_de')} END AS summary, url || ' &amp;' AS url, ['für ' || id, 'x < y'] AS labels, CASE WHEN title_en IS NOT NULL THEN {_ONE('title_en')} END AS en, '&lt;' AS other FROM entries""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry as a nested record with damaged, escaped and spaced texts, some of them a file's bytes; URLs are only trimmed."""
    k = F.col("id").cast("string")
    label = lambda c: F.struct(c.alias("label"), k.alias("id"))
    record = F.struct(
        F.concat(F.lit("&Auml;mter &amp;\x07Co &#x20AC; "), F.coalesce("title_de", F.lit(""))).alias("title"), F.struct(F.when(F.col("id") % 5 == 0, F.concat(F.lit("%PDF-1.7 "), F.coalesce("summary_de", F.lit("")))).otherwise(F.coalesce("summary_de", F.lit(""))).alias("de")).alias("summary"),
        F.concat(F.lit("  "), "url", F.lit(" &amp; ")).alias("url"), F.array(label(F.concat(F.lit("fÃ¼r  "), k)), label(F.lit("x &lt; y"))).alias("parts"), F.create_map(F.lit("en"), "title_en", F.lit("other"), F.lit(" &lt; ")).alias("more"),
    )
    rows = entries(spark, sf_dir).select("id", record.alias("r"))
    r = rows.select("id", cleaning.cleaned_fields(F.col("r"), rows.schema["r"].dataType, filters.binary_text).alias("r"))
    return r.select("id", "r.title", F.col("r.summary.de").alias("summary"), "r.url", F.transform("r.parts", lambda p: p["label"]).alias("labels"), F.col("r.more")["en"].alias("en"), F.col("r.more")["other"].alias("other"))


@query("p16_evidence", E + "SELECT id, 'rag' AS source, least(1.0, greatest(0.0, (id % 150 - 20) / 100.0))::DOUBLE AS confidence, md5(left(content_de, 600)) AS summary_md5, md5(content_de) AS content_md5, source AS source_name, topics FROM entries")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = {"chunk_id": F.col("id").cast("string"), "title": F.col("title_de"), "url": F.col("url"), "text": F.col("content_de"), "topics": F.col("topics"), "source_id": F.col("source"), "document_type": F.col("domain")}
    e = entries(spark, sf_dir).select("id", op.evidence(chunk, (F.col("id") % 150 - 20) / 100).alias("e"))
    of = lambda path: F.get_json_object("e.content", path)
    return e.select("id", "e.source", "e.confidence", F.md5(of("$.summary.de")).alias("summary_md5"), F.md5(of("$.content.de")).alias("content_md5"), of("$.provenance.source_name").alias("source_name"), F.from_json(of("$.topics"), "array<string>").alias("topics"))


@query("p19_catalog_items", E + """, c AS (SELECT host, count(*) AS n, list_sort(list_distinct(list(domain))) AS domains, sum(iqs) FILTER (iqs > 0) AS iqs, count(*) FILTER (iqs > 0) AS iqs_n, max(last_seen) AS last_seen FROM entries WHERE host IS NOT NULL GROUP BY host)
SELECT host AS id, host AS name, host, 'unknown' AS "sourceTier", n AS "entryCount", list_sort(CASE WHEN length(host) % 2 = 0 THEN list_distinct(['aid'] || domains) ELSE domains END) AS domains, round(iqs / nullif(iqs_n, 0), 6) AS "avgIqs", 'https://' || host AS "sampleUrl" FROM c""")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog item for every host of entries; the sources have no id or name of their own, half of them a domain."""
    e = entries(spark, sf_dir).where("host is not null")
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    counts = e.groupBy("host").agg(
        F.count("*").alias("entries"), F.array_sort(F.collect_set("domain")).alias("domains"), F.sum(some("iqs")).alias("iqs_sum"), F.count(some("iqs")).alias("iqs_count"), F.sum(some("ais")).alias("ais_sum"), F.count(some("ais")).alias("ais_count"), F.max("last_seen").alias("last_seen"), F.lit(None).cast("string").alias("sample_url"),
    )
    none = F.lit(None).cast("string")
    source = F.struct(none.alias("id"), F.lit(" ").alias("name"), F.array("host").alias("hosts"), F.lit("").alias("tier"), none.alias("institution"), none.alias("jurisdiction"), none.alias("role"), F.when(F.length("host") % 2 == 0, F.array(F.lit("aid"))).alias("domains"), F.concat(F.lit("https://"), "host").alias("base_url"))
    items = counts.select(op.catalog_item(source, F.struct(*[c for c in counts.columns if c != "host"])).alias("i")).select("i.*")
    return items.select("id", "name", "host", "sourceTier", "entryCount", F.array_sort("domains").alias("domains"), F.round("avgIqs", 6).alias("avgIqs"), "sampleUrl")


@query("p20_seed_records", "SELECT page_id, url, page_id % 4 <> 1 AS enabled, CASE WHEN page_id % 4 = 1 THEN 'Seite ' || page_id END AS label, CASE WHEN page_id % 4 = 1 THEN ['geld', 'amt'] END AS topics, CASE WHEN page_id % 4 = 1 THEN CAST(page_id AS INT) END AS priority FROM pages WHERE page_id % 4 <> 3")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of every page in JSON: a string, an object with all fields, one with few, or one without a URL, which is none."""
    k, u = F.col("page_id"), F.col("url")
    whole = F.to_json(F.struct(F.concat(F.lit(" "), u).alias("url"), F.lit(False).alias("enabled"), F.concat(F.lit("Seite "), k.cast("string"), F.lit(" ")).alias("label"), F.array(F.lit(" geld"), F.lit(" "), F.lit("amt")).alias("topics"), F.array(F.lit("")).alias("tags"), k.cast("int").alias("priority")))
    raw = F.when(k % 4 == 0, F.concat(F.lit('" '), u, F.lit(' "'))).when(k % 4 == 1, whole).when(k % 4 == 2, F.to_json(F.struct(u.alias("url"), F.lit("x").alias("priority"), F.lit(" ").alias("label")))).otherwise('{"url": " ", "label": "x"}')
    s = table(spark, sf_dir, "pages").select("page_id", op.seed(raw).alias("s")).where("s is not null")
    return s.select("page_id", "s.url", "s.enabled", "s.label", "s.topics", "s.priority")


@query("u02_seed_files", "SELECT url, 0 AS file, page_id AS place, 'Seite' AS label FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 1, page_id, NULL FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, 2, page_id, NULL FROM pages")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seed files as one, each row with its file and place; a field that a file lacks is null."""
    p = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("place"))
    files = (p.where("place % 2 = 0").withColumn("label", F.lit("Seite")), p.where("place % 3 = 0"), p)
    out = None
    for i, f in enumerate(files):
        part = f.withColumn("file", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select("url", "file", "place", "label")


@query("s03_snapshots", E + " SELECT id, domain, title_de AS title, url, topics FROM entries")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry written in documents of one domain and at most a hundred entries, and read again."""
    path = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    op.write_snapshots(entries(spark, sf_dir).select("id", "domain", F.col("title_de").alias("title"), "url", "topics"), path, most=100)
    written = op.read_snapshots(spark, path, "id long, title string, url string, topics array<string>")
    written._stash_path = path
    out = stash(written.select("id", "domain", "title", "url", "topics"), "snapshots", sweep=False)
    discard(written)
    return out


@query("s04_registry_lines", "SELECT DISTINCT ON (user_id) 'https://example.org/' || user_id AS key, event_id AS seq, event_type AS status FROM events WHERE event_id % 7 <> 0 ORDER BY user_id, event_id DESC")
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry's lines, written with one broken line of seven and URLs in two spellings; the last state of each URL."""
    k = F.col("event_id")
    url = F.when(k % 2 == 0, F.concat(F.lit("HTTPS://Example.org/"), F.col("user_id").cast("string"), F.lit("/#x"))).otherwise(F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string")))
    line = F.when(k % 7 == 0, F.concat(F.lit('{"url": "'), url)).otherwise(F.to_json(F.struct(url.alias("url"), k.alias("seq"), F.col("event_type").alias("status"))))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    read = op.read_keyed(spark, path, "url string, seq long, status string", F.when(F.col("seq").isNotNull(), fx.canonical_url(F.col("url"))), "seq").select("key", "seq", "status")
    out = stash(read, "lines", sweep=False)
    read._stash_path = path
    discard(read)
    return out


@query("j13_chunk_provenance")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the provenance of their document; held against a join in tests/test_records.py."""
    return texts.chunk_places(table(spark, sf_dir, "documents"), "doc_id", "text", ["source", "lang"]).select("chunk_id", "doc_id", "source", "lang", "chunk_index")
