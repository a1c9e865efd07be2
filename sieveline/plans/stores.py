"""Versioned stores, batch embedding and the review log as queries; SQL beside each states what must be left."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import embedding, reviews
from sieveline.plans.registry import query
from sieveline.session import scratch, shared_dir, stash, table
from sieveline.sources.entries import ENTRIES_SQL, entries
from sieveline.sources.store import Store

E = f"WITH {ENTRIES_SQL}"


def _kept(spark: SparkSession, store: Store, columns: list[str]) -> DataFrame:
    """The store's rows in a table of their own; the store goes."""
    out = stash(store.load().select(*columns), "store", sweep=False)
    store.drop()
    return out


@query("s23_vector_store", "SELECT vec_id, label, CASE WHEN label % 3 = 0 THEN round((embedding[1] * 2)::DOUBLE, 5) ELSE round(embedding[1]::DOUBLE, 5) END AS first, len(embedding) AS dimension FROM embeddings WHERE NOT (label % 3 = 0 AND vec_id % 5 = 0)")
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors saved by label, then a third of the labels replaced: doubled, and without each fifth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    store = Store(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", "vec_id long, embedding array<float>, label int", "label")
    store.save(vectors)
    labels = [r[0] for r in vectors.select("label").where("label % 3 = 0").distinct().limit(10_001).collect()]
    store.replace(vectors.where("vec_id % 5 <> 0").withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float"))), labels)
    out = _kept(spark, store, ["vec_id", "label", "embedding"])
    return out.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.size("embedding").cast("long").alias("dimension"))


@query("s13_replaced_domain", E + " SELECT id, domain, CASE WHEN domain = 'aid' THEN coalesce(nullif(CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN 'Titel ' || id END, ''), title_de) ELSE title_de END AS title FROM entries WHERE domain <> 'aid' OR id % 3 <> 0")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by domain; one domain is imported anew, without a third of its rows, and its missing titles are filled from the German ones."""
    e = entries(spark, sf_dir).select(F.col("id"), "domain", F.col("title_de").alias("title"))
    k = F.col("id")
    stated = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("Titel "), k.cast("string")))
    fresh = e.where("domain = 'aid' and id % 3 <> 0").withColumn("title", F.coalesce(F.nullif(stated, F.lit("")), "title"))
    store = Store(spark, f"{shared_dir(spark)}/entries-{uuid.uuid4().hex}", "id long, domain string, title string", "domain")
    store.save(e)
    store.replace(fresh, ["aid"])
    return _kept(spark, store, ["id", "domain", "title"])


@query("s10_bulk_upsert", E + " SELECT id, CASE WHEN id % 7 = 0 THEN 'tools' ELSE domain END AS domain, CASE WHEN id % 7 = 0 THEN 'neu' ELSE title_de END AS title FROM entries WHERE id % 11 <> 0 OR id % 7 = 0")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of eleven entries in a store; every seventh comes again under another domain, with rows that have no id."""
    e = entries(spark, sf_dir).select("id", "domain", F.col("title_de").alias("title"))
    fresh = e.where("id % 7 = 0").select("id", F.lit("tools").alias("domain"), F.lit("neu").alias("title"))
    lost = e.where("id % 13 = 0").withColumn("id", F.lit(None).cast("long"))
    store = Store(spark, f"{shared_dir(spark)}/entries-{uuid.uuid4().hex}", "id long, domain string, title string", "domain")
    store.save(e.where("id % 11 <> 0"))
    store.upsert(fresh.unionByName(lost), "id", most=None)
    return _kept(spark, store, ["id", "domain", "title"])


def _measured(texts: pd.Series) -> list[list[float]]:
    """A stand-in for a model: length, and how many e and spaces a text has."""
    return [[len(t), t.count("e"), t.count(" ")] for t in texts]


@query("v08_batch_embedding", """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '  ' ELSE ' ' || text || ' ' END AS text FROM conversations), b AS (SELECT *, nullif(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') AS body FROM t)
SELECT conv_id, turn, CASE WHEN body IS NULL THEN NULL WHEN length(body) % 3 = 0 AND length(body) % 2 = 1 THEN [-1.0::DOUBLE] ELSE [length(body)::DOUBLE, (length(body) - length(replace(body, 'e', '')))::DOUBLE, (length(body) - length(replace(body, ' ', '')))::DOUBLE] END AS vector FROM b""")
def v08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every turn that isn't blank; texts whose length is a multiple of three are in the cache, half of them too old."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("text"))
    body = F.btrim(F.col("text"), F.lit(" \t\r\n\f\x0b"))
    saved = F.when(F.length(body) % 2 == 0, F.lit("2024-01-01").cast("timestamp")).otherwise(F.lit("2024-03-01").cast("timestamp"))
    cache = c.where(F.length(body) % 3 == 0).select(embedding.text_key(body, "model").alias("key"), F.array(F.lit(-1.0)).alias("vector"), saved.alias("saved_at"))
    with scratch(spark) as keep:
        out, _ = embedding.embedded(c, "text", "model", _measured, cache, F.lit("2024-03-15").cast("timestamp"))
        return keep(stash(out.select("conv_id", "turn", "vector"), "embedded", sweep=False))


_LOG = """WITH log AS (
    SELECT event_id AS seq, ts AS tm, CASE event_id % 7 WHEN 0 THEN 'created' WHEN 3 THEN 'disabled' WHEN 4 THEN 'applied' WHEN 5 THEN 'applied' ELSE 'seen' END AS action, 'c' || (user_id % 50) AS case_id, 'o' || (user_id % 20) AS override_id,
           'Frage ' || (user_id % 50) AS query, CASE WHEN event_id % 21 <> 0 THEN ' Trigger-' || (user_id % 10) END AS trigger_text, CASE WHEN event_id % 35 = 0 THEN ' ' ELSE 'Job_' || event_type END AS target,
           CASE WHEN event_id % 2 = 0 THEN 'anna' ELSE '' END AS reviewer, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id ELSE ' ' END AS note FROM events),
born AS (SELECT override_id, min(seq) AS first FROM log WHERE action = 'created' AND trigger_text IS NOT NULL AND trim(target) <> '' GROUP BY override_id),
birth AS (SELECT b.first, l.* FROM born b JOIN log l ON l.seq = b.first)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review log (``reviews.EVENT``), one event for each event; users share 50 cases and 20 overrides."""
    k, u = F.col("event_id"), F.col("user_id")
    named = lambda p, n: F.concat(F.lit(p), (u % n).cast("string"))
    action = F.when(k % 7 == 0, "created").when(k % 7 == 3, "disabled").when((k % 7 == 4) | (k % 7 == 5), "applied").otherwise("seen")
    return table(spark, sf_dir, "events").select(
        k.alias("seq"), F.col("ts").alias("at"), action.alias("action"), named("c", 50).alias("case_id"), named("o", 20).alias("override_id"), named("Frage ", 50).alias("query"), F.array("event_type").alias("reasons"),
        F.when(k % 21 != 0, named(" Trigger-", 10)).alias("trigger_text"), F.when(k % 35 == 0, " ").otherwise(F.concat(F.lit("Job_"), "event_type")).alias("target"), F.when(k % 2 == 0, "anna").otherwise("").alias("reviewer"),
        F.when(k % 3 == 0, F.concat(F.lit("n"), k.cast("string"))).otherwise(" ").alias("note"),
    )


@query("d24_overrides", _LOG + """SELECT b.override_id, trim(b.trigger_text) AS trigger_text, lower(replace(trim(b.trigger_text), '-', ' ')) AS normalized_trigger_text, lower(trim(b.target)) AS target, coalesce(arg_max(nullif(trim(l.note), ''), l.seq) FILTER (l.action = 'disabled' AND trim(l.note) <> ''), nullif(trim(any_value(b.note)), '')) AS note,
       nullif(any_value(b.reviewer), '') AS reviewer, CASE WHEN count(*) FILTER (l.action = 'disabled') > 0 THEN 'disabled' ELSE 'active' END AS status, any_value(b.tm) AS created_at, coalesce(max(l.tm) FILTER (l.action = 'disabled'), any_value(b.tm)) AS updated_at,
       count(*) FILTER (l.action = 'applied') AS applied_count, max(l.tm) FILTER (l.action = 'applied') AS last_applied_at
FROM birth b LEFT JOIN log l ON l.override_id = b.override_id AND l.seq > b.seq AND l.action IN ('disabled', 'applied') GROUP BY b.override_id, b.trigger_text, b.target""")
def d24_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every override after the whole log."""
    return reviews.overrides(_log(spark, sf_dir))


@query("d24_cases", _LOG + """, s AS (SELECT case_id, arg_max(query, seq) AS query, arg_max(event_type, seq) AS reason, count(*) AS occurrence_count, min(tm) AS first_seen, max(tm) AS seen_at, min(seq) AS first FROM (SELECT l.*, e.event_type FROM log l JOIN events e ON e.event_id = l.seq) WHERE action = 'seen' GROUP BY case_id),
by_case AS (SELECT b.case_id, max(b.seq) AS seq FROM birth b JOIN s ON s.case_id = b.case_id AND b.seq > s.first GROUP BY b.case_id)
SELECT s.case_id, s.query, [s.reason] AS reasons, s.occurrence_count, s.first_seen, greatest(s.seen_at, b.tm) AS last_seen, CASE WHEN b.seq IS NULL THEN 'open' ELSE 'resolved' END AS resolved_status, nullif(trim(b.note), '') AS resolution_notes, nullif(b.reviewer, '') AS resolved_by, b.tm AS resolved_at
FROM s LEFT JOIN by_case c ON c.case_id = s.case_id LEFT JOIN birth b ON b.seq = c.seq""")
def d24_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case after the whole log."""
    return reviews.cases(_log(spark, sf_dir))


@query("d24_overrides_as_of", _LOG + """, spans AS (SELECT b.override_id, lower(replace(trim(b.trigger_text), '-', ' ')) AS t, lower(trim(b.target)) AS target, b.tm AS since, min(l.tm) FILTER (l.action = 'disabled') AS until FROM birth b LEFT JOIN log l ON l.override_id = b.override_id AND l.seq > b.seq GROUP BY ALL),
hit AS (SELECT e.event_id, s.override_id, s.target, row_number() OVER (PARTITION BY e.event_id ORDER BY s.since DESC, s.override_id DESC) AS n FROM events e JOIN spans s ON s.t = 'trigger ' || (e.user_id % 13) AND e.ts >= s.since AND (s.until IS NULL OR e.ts < s.until))
SELECT e.event_id, h.override_id, h.target FROM events e LEFT JOIN hit h ON h.event_id = e.event_id AND h.n = 1""")
def d24_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The override that held for each event's question when it was asked."""
    asked = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("TRIGGER "), (F.col("user_id") % 13).cast("string")).alias("question"), "ts")
    return reviews.as_of(asked, "question", "ts", _log(spark, sf_dir)).select("event_id", "override_id", "target")


@query("d24_audit", _LOG + """SELECT l.seq, l.tm AS timestamp, CASE WHEN l.action = 'created' AND l.seq = b.first OR l.action <> 'created' AND l.seq > b.first THEN 'life_event_override_' || l.action ELSE 'refused' END AS action, CASE WHEN l.reviewer = '' THEN 'admin' ELSE l.reviewer END AS user_id,
CASE WHEN l.action = 'created' THEN l.case_id END AS entry_id, l.override_id FROM log l LEFT JOIN born b ON b.override_id = l.override_id WHERE l.action <> 'seen'""")
def d24_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every event of the log did."""
    return reviews.audited(_log(spark, sf_dir))
