"""Coverage of queries and scenarios as queries; SQL beside each tries every query on every entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import probes as op
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL}"
_DOMAINS = ("benefits", "aid", "contacts", "tools")
_STOP = "['" + "', '".join("der die das den dem des ein eine einer einem einen und oder aber doch dass weil ich du er sie wir ihr mir mich dir dich uns euch ist sind war waren wird werden mit ohne fuer auf bei von zu im in am an was wie wo wer wann warum wieso weshalb nun jetzt heute morgen gestern bitte danke hallo".split()) + "']"
_TOKENS = f""",
split AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}-]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w)) AS ws FROM benchmark),
asked AS (SELECT item_id, (list_filter(ws, lambda w, i: list_position(ws, w) = i))[1:12] AS tokens FROM split)"""


@query("d28_probe_coverage", E + _TOKENS + """, low AS (SELECT id, lower(coalesce(title_de, '') || chr(10) || content_de) AS t FROM entries WHERE status = 'active' AND domain IN ('benefits', 'aid', 'contacts', 'tools')),
hit AS (SELECT a.item_id, count(*) AS n FROM asked a JOIN low l ON len(list_filter(a.tokens, lambda w: contains(l.t, w))) > 0 GROUP BY a.item_id)
SELECT a.item_id, len(tokens) AS n_tokens, coalesce(n, 0) AS n_entries, n IS NOT NULL AS covered FROM asked a LEFT JOIN hit h ON h.item_id = a.item_id""")
def d28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many active entries of four domains have one of the first twelve tokens of each benchmark question."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", op.tokens(F.col("text"), 12).alias("tokens"))
    e = entries(spark, sf_dir, scored=False).where((F.col("status") == "active") & F.col("domain").isin(*_DOMAINS))
    hits = op.found(asked, "item_id", F.col("tokens"), e, "id", {"title": (F.col("title_de"), 1), "text": (F.col("content_de"), 1)})
    return op.coverage(asked, "item_id", F.col("tokens"), hits)


@query("d16_scenario_coverage", E + _TOKENS.replace("[1:12]", "[1:4]") + """, probes AS (SELECT item_id, item_id % 10 AS scenario, tokens FROM asked),
low AS (SELECT id, url, domain, tier, lower(coalesce(title_de, '')) AS t, lower(coalesce(content_de, '')) AS c FROM entries WHERE status = 'active'),
scored AS (SELECT p.item_id, p.scenario, l.*, list_sum(list_transform(p.tokens, lambda w: 3 * contains(l.t, w)::INT + 1.25 * contains(l.c, w)::INT)) AS score FROM probes p, low l),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS n FROM scored WHERE score > 0),
once AS (SELECT *, row_number() OVER (PARTITION BY scenario, coalesce(nullif(url, ''), id::VARCHAR) ORDER BY item_id, n) AS k FROM best WHERE n <= 10),
lists AS (SELECT scenario, list(id ORDER BY score DESC, item_id, id) FILTER (domain <> 'contacts' AND tier IN ('tier_1_law', 'tier_1_official', 'tier_2_official')) AS docs,
    list(id ORDER BY score DESC, item_id, id) FILTER (domain = 'contacts') AS contacts, list(id ORDER BY score DESC, item_id, id) FILTER (domain <> 'organizations' AND tier IN ('tier_2_ngo_watchdog', 'tier_3_ngo')) AS ngos FROM once WHERE k = 1 GROUP BY scenario),
cut AS (SELECT p.scenario, coalesce(docs[1:10], []) AS docs, coalesce(contacts[1:5], []) AS contacts, coalesce(ngos[1:5], []) AS ngos FROM (SELECT DISTINCT scenario FROM probes) p LEFT JOIN lists l ON l.scenario = p.scenario)
SELECT scenario, docs, contacts, ngos, greatest(5 - len(docs), 0) AS missing_docs, greatest(5 - len(contacts), 0) AS missing_contacts, greatest(3 - len(ngos), 0) AS missing_ngos FROM cut""")
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first four tokens of each benchmark question find; ten scenarios have a tenth of the questions each."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 10).alias("scenario"), op.tokens(F.col("text"), 4).alias("tokens"))
    e = entries(spark, sf_dir, scored=False).where("status = 'active'")
    hits = op.found(asked, "item_id", F.col("tokens"), e, "id", {"title": (F.col("title_de"), 3), "text": (F.col("content_de"), 1.25)})
    return op.scenario_coverage(asked, "scenario", "item_id", hits, e, "id")
