"""Seed scans, alias chains, the URL registry and greedy batches as queries; SQL beside each.

The tables have no seed files or registry.  The queries derive them from every entry and event by arithmetic on ids: seeds
under three spellings in three files, registry rows with chains of three aliases, cycles, one URL that very many stand
for, final states, and registry events of every kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import batches, seeds
from sieveline.plans.registry import query
from sieveline.session import scratch, stash, table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL}"
SHARED = "https://www.src0.example.org/shared"
GUARD = seeds.Guard(urls=("https://www.src1.example.org/en/1", "https://www.src1.example.org/en/21"), hosts=("src3.example.org", "WWW.src4.example.org"), suffixes=("src7.example.org",), words=("/FR/",))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, enabled, file, place: an entry may stand in each of three files."""
    k, url = F.col("id"), F.col("url")
    loud = F.concat(F.lit("HTTPS://WWW."), F.upper("host"), F.lit(":443/"), "lang", F.lit("/"), k.cast("string"), F.lit("/?utm_source=feed"))
    row = lambda when, u, enabled, file: F.when(when, F.struct(u.alias("url"), enabled.alias("enabled"), F.lit(file).alias("file")))
    each = F.array_compact(F.array(row(k % 2 == 0, url, k % 20 != 0, 0), row(k % 3 == 0, loud, F.lit(True), 1), row(k % 5 < 3, F.concat(F.lit(" "), url, F.lit("#top")), F.lit(None).cast("boolean"), 2)))
    return entries(spark, sf_dir).select(k.alias("place"), F.explode(each).alias("s")).select("s.url", "s.enabled", "s.file", "place")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, status, skip, final_url, canonical_url of the entries whose id's last digit is 3 to 9."""
    k, url = F.col("id") % 10, F.col("url")
    below = lambda x: F.concat(url, F.lit(x))

    def row(u: Column, status: str = "ok", skip: bool | None = None, final: Column | None = None, canonical: Column | None = None) -> Column:
        return F.struct(u.alias("url"), F.lit(status).alias("status"), F.lit(skip).cast("boolean").alias("skip"), (F.lit("") if final is None else final).alias("final_url"), (F.lit(None).cast("string") if canonical is None else canonical).alias("canonical_url"))

    chain = F.array(row(url, final=below("/1")), row(below("/1"), final=below("/2")), row(below("/2"), final=below("/3")))
    cycle = F.array(row(url, final=below("/x")), row(below("/x"), final=url))
    one = F.when(k == 5, row(url, "dns_error")).when(k == 6, row(url, skip=True)).when(k == 7, row(url, canonical=below("/c"))).when(k == 8, row(url, skip=False, canonical=url)).when(k == 9, row(url, final=F.lit(SHARED)))
    return entries(spark, sf_dir).where("url is not null").select(F.explode(F.when(k == 3, chain).when(k == 4, cycle).otherwise(F.array_compact(F.array(one)))).alias("r")).select("r.*")


_JUDGED = f"""{E},
named AS (
    SELECT id, host, lang, url, 0 AS file, url AS seed FROM entries WHERE id % 2 = 0 AND id % 20 <> 0
    UNION ALL SELECT id, host, lang, url, 1, 'HTTPS://WWW.' || upper(host) || ':443/' || lang || '/' || id || '/?utm_source=feed' FROM entries WHERE id % 3 = 0
    UNION ALL SELECT id, host, lang, url, 2, ' ' || url || '#top' FROM entries WHERE id % 5 < 3),
first AS (SELECT id, any_value(host) AS host, any_value(lang) AS lang, url, min(file) AS file, arg_min(seed, file) AS seed FROM named WHERE url IS NOT NULL GROUP BY id, url),
judged AS (
    SELECT *, CASE WHEN url IN ('https://www.src1.example.org/en/1', 'https://www.src1.example.org/en/21') THEN 'exact_url_blocklist' WHEN host IN ('src3.example.org', 'src4.example.org') THEN 'blocked_host'
                   WHEN host = 'src7.example.org' THEN 'blocked_host_suffix' WHEN lang = 'fr' THEN 'blocked_url_token' WHEN id % 10 IN (5, 6, 7) THEN 'skipped' ELSE 'kept' END AS outcome,
           CASE id % 10 WHEN 3 THEN url || '/3' WHEN 7 THEN url || '/c' WHEN 9 THEN '{SHARED}' ELSE url END AS target
    FROM first)
"""


@query("j06_guarded_seeds", _JUDGED + "SELECT url, outcome, target FROM judged")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every distinct seed URL, and the URL that is crawled for it."""
    return seeds.judged(_seeds(spark, sf_dir), _registry(spark, sf_dir), GUARD).select("url", "outcome", "target")


@query("s22_seed_scan", _JUDGED + ", kept AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY file, id) AS n FROM judged WHERE outcome = 'kept') SELECT target AS url, file, id AS place, seed FROM kept WHERE n = 1")
def s22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds that are crawled: normalised, guarded, not closed in the registry, aliases replaced, the first of each URL."""
    return seeds.kept(seeds.judged(_seeds(spark, sf_dir), _registry(spark, sf_dir), GUARD)).select("url", "file", "place", "seed")


@query("s22_seed_records", _JUDGED + """SELECT url, CASE WHEN outcome = 'kept' THEN 'canonical_alias' ELSE 'invalid_url' END AS status, CASE WHEN outcome = 'kept' THEN target END AS canonical_url,
CASE WHEN outcome = 'kept' THEN 'preferred_url_from_registry' ELSE 'guardrail_' || outcome END AS reason, TRUE AS skip FROM judged WHERE outcome <> 'skipped' AND (outcome <> 'kept' OR target <> url)""")
def s22_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry learns from the scan: stopped URLs and aliases."""
    return seeds.recorded(seeds.judged(_seeds(spark, sf_dir), _registry(spark, sf_dir), GUARD)).select("url", "status", "canonical_url", "reason", "skip")


@query("j05_preferred_urls", E + f""", u AS (SELECT url, id % 10 AS k FROM entries WHERE url IS NOT NULL)
SELECT url, url || '/3' AS target FROM u WHERE k = 3 UNION ALL SELECT url || '/1', url || '/3' FROM u WHERE k = 3 UNION ALL SELECT url || '/2', url || '/3' FROM u WHERE k = 3
UNION ALL SELECT url, url || '/c' FROM u WHERE k = 7 UNION ALL SELECT url, '{SHARED}' FROM u WHERE k = 9""")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL that each alias of the registry ends at; aliases in a cycle have none."""
    with scratch(spark) as keep:
        return keep(stash(seeds.preferred(_registry(spark, sf_dir)), "preferred", sweep=False))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry events (``seeds.EVENT``), one for each event; a user is a URL that may stand for a later user's."""
    k, user = F.col("event_id"), F.col("user_id")
    url = lambda u: F.concat(F.lit("https://example.org/"), u.cast("string"))
    status = F.when(F.col("event_type") == "error", "fetch_failed").when(k % 11 == 0, "content_empty").when(F.col("event_type") == "signup", "ok").otherwise("checked")
    return table(spark, sf_dir, "events").select(
        url(user).alias("url"), k.alias("seq"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), status.alias("status"), F.when(k % 17 == 0, url(user + 1)).alias("final_url"), F.when(k % 37 == 0, url(user + 1000000)).when(k % 41 == 0, "").alias("canonical_url"),
        F.when(k % 5 == 0, F.concat(F.lit("r"), (k % 4).cast("string"))).alias("reason"), F.when(status == "fetch_failed", (500 + k % 4).cast("int")).alias("status_code"), F.when(k % 29 == 0, True).when(k % 31 == 0, False).alias("skip"),
    )


@query("st6_url_registry", """
WITH e AS (
    SELECT 'https://example.org/' || user_id AS url, event_id AS seq, 's' || (event_id % 3) AS source,
           CASE WHEN event_type = 'error' THEN 'fetch_failed' WHEN event_id % 11 = 0 THEN 'content_empty' WHEN event_type = 'signup' THEN 'ok' ELSE 'checked' END AS status,
           CASE WHEN event_id % 17 = 0 THEN 'https://example.org/' || (user_id + 1) END AS final_url, CASE WHEN event_id % 37 = 0 THEN 'https://example.org/' || (user_id + 1000000) END AS canonical_url,
           CASE WHEN event_id % 5 = 0 THEN 'r' || (event_id % 4) END AS reason, CASE WHEN event_type = 'error' THEN CAST(500 + event_id % 4 AS INT) END AS status_code,
           CASE WHEN event_id % 29 = 0 THEN TRUE WHEN event_id % 31 = 0 THEN FALSE END AS skip FROM events),
g AS (SELECT *, count(*) FILTER (status = 'ok') OVER w AS g, last_value(canonical_url IGNORE NULLS) OVER w AS c, last_value(final_url IGNORE NULLS) OVER w AS f FROM e WINDOW w AS (PARTITION BY url ORDER BY seq ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, count(*) FILTER (status = 'fetch_failed') OVER (PARTITION BY url, g ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run, coalesce(c, f) AS target FROM g),
x AS (SELECT *, status = 'fetch_failed' AND skip IS NULL AND run >= 3 AS late FROM r),
y AS (SELECT *, coalesce(reason, CASE WHEN late THEN 'fetch_failed_threshold' END) AS why, coalesce(skip, CASE WHEN late THEN TRUE WHEN status = 'ok' THEN FALSE WHEN status = 'content_empty' THEN TRUE END) AS skips FROM x),
own AS (
    SELECT url, arg_max(source, seq) AS source, arg_max(status, seq) AS status, max(seq) AS checked, arg_max(final_url, seq) FILTER (final_url IS NOT NULL) AS final_url, arg_max(canonical_url, seq) FILTER (canonical_url IS NOT NULL) AS canonical_url,
           arg_max(why, seq) FILTER (why IS NOT NULL) AS reason, arg_max(status_code, seq) FILTER (status_code IS NOT NULL) AS status_code, nullif(arg_max(run, seq), 0) AS fail_count, arg_max(skips, seq) FILTER (skips IS NOT NULL) AS skip
    FROM y GROUP BY url),
named AS (SELECT target AS url, arg_min(source, seq) AS source, max(seq) AS checked FROM y WHERE target IS NOT NULL GROUP BY target)
SELECT coalesce(o.url, n.url) AS url, coalesce(o.source, n.source) AS source, coalesce(o.status, 'discovered') AS status, greatest(o.checked, n.checked) AS checked, o.final_url, o.canonical_url, o.reason, o.status_code, o.fail_count,
       coalesce(o.skip, CASE WHEN n.url IS NOT NULL THEN FALSE END) AS skip
FROM own o FULL JOIN named n ON o.url = n.url""")
def st6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after all events."""
    return seeds.after(_events(spark, sf_dir))


@query("s11_greedy_batches", """WITH RECURSIVE """ + ENTRIES_SQL + """,
sized AS (SELECT id, domain, coalesce(strlen(title_de), 0) + coalesce(strlen(content_de), 0) AS size, row_number() OVER (PARTITION BY domain ORDER BY id) AS rn FROM entries),
walk AS (
    SELECT id, domain, rn, 0 AS b, 1 AS n, 40 + size AS weight, size FROM sized WHERE rn = 1
    UNION ALL
    SELECT s.id, s.domain, s.rn, w.b + CASE WHEN w.n = 20 OR w.weight + 1 + s.size > 60000 THEN 1 ELSE 0 END, CASE WHEN w.n = 20 OR w.weight + 1 + s.size > 60000 THEN 1 ELSE w.n + 1 END,
           CASE WHEN w.n = 20 OR w.weight + 1 + s.size > 60000 THEN 40 + s.size ELSE w.weight + 1 + s.size END, s.size
    FROM walk w JOIN sized s ON s.domain = w.domain AND s.rn = w.rn + 1)
SELECT id, domain, dense_rank() OVER (ORDER BY domain, b) - 1 AS batch, size + 40 > 60000 AS oversize FROM walk""")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each domain by id in batches of at most 20 and 60,000 bytes, with 40 bytes around a batch and one between rows; one that fits no batch is its own."""
    size = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(c), F.lit(0)) for c in ("title_de", "content_de")))
    e = entries(spark, sf_dir).select("id", "domain", size.alias("size"))
    return batches.greedy(e, F.col("domain"), [F.col("id")], F.col("size"), 20, 60_000, 40, 1).select("id", "domain", "batch", "oversize")
