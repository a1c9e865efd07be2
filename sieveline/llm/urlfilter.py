"""URL filters: a temporal list join.

A list is rows (pattern, action, listed): from that day on the pattern is under the action, until its next row.  The
rows become validity intervals; a pattern is a host or domain (`example.com`) or the start of a path below one
(`example.com/ads/`).  A capture may be covered by its host, the domains above it, and each of these with each leading
part of the path; of the entries active when it was fetched the longest pattern wins, the host's own before a longer
path of a shorter domain.

How it goes: distinct hosts ask which of their domains the list has at all, so a domain above very many captures is
asked for once for each host.  Only captures of the hosts that are on the list ask for patterns, as distinct pairs of
URL and date without their other columns.  The answers join the captures by that pair.

Edge cases: captures without a URL, host or fetch date, and those no active entry covers, have a null pattern and
action and aren't blocked.  Hosts are compared in lower case, without port and user.  Of several list rows of a pattern
on a day the last action in alphabetical order counts.  Rows with null pattern, action or date are no entries.
Repeated captures are judged each; other columns are kept, and an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.session import spare

#: The dated list that the query applies.
LISTED = (
    ("cheap-pills.example.com", "block", "2024-01-15"),
    ("casino-win.example.org", "block", "2024-02-01"),
    ("casino-win.example.org", "release", "2024-09-01"),
    ("spam-farm.example.org", "block", "2024-03-01"),
    ("free-bets.example.com", "block", "2024-01-01"),
    ("free-bets.example.com", "release", "2024-06-01"),
    ("free-bets.example.com", "block", "2024-10-01"),
    ("ads-track.example.org", "block", "2024-04-10"),
    ("example.net/de/", "block", "2024-05-01"),
    ("example.net/de/", "release", "2024-08-01"),
    ("tionsh.example.net", "block", "2024-07-01"),
    ("tionsh.example.net/en/", "release", "2024-07-15"),
    ("m.example.org", "block", "2024-02-20"),
    ("thther.example.org", "block", "2024-11-01"),
    ("thther.example.org/fr/", "release", "2024-11-15"),
)


def sample_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTED, "pattern string, action string, listed string").withColumn("listed", F.col("listed").cast("date"))


def intervals(listed: DataFrame) -> DataFrame:
    """pattern, action, since, until (exclusive; null while it lasts) of each list row."""
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.substr("pattern", F.length(host) + 1))  # paths keep their case
    rows = listed.select(pattern.alias("pattern"), "action", F.col("listed").alias("since")).where("pattern is not null and action is not null and since is not null")
    rows = rows.groupBy("pattern", "since").agg(F.max("action").alias("action"))
    return rows.withColumn("until", F.lead("since").over(Window.partitionBy("pattern").orderBy("since")))


_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_REST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]+)(?:[/]([^?#]*))?"


def _domains(host: Column) -> Column:
    """A host and the domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def asked(url: str = "url") -> Column:
    """The patterns that may cover a URL, the one that wins first."""
    host, parts = F.lower(F.regexp_extract(url, _HOST, 1)), F.split(F.regexp_extract(url, _REST, 2), "/")
    paths = F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.when(i > 0, F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))).otherwise(""))
    return F.when(host != "", F.flatten(F.transform(_domains(host), lambda d: F.transform(paths, lambda p: F.concat(d, p)))))


def judge(captures: DataFrame, listed: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with the pattern and action of the entry that decides, and whether it blocks.

    Columns of those names that captures have already stay, and the new ones get underscores before theirs.
    """
    entries = intervals(listed)
    pairs = captures.select(F.col(url).alias("url"), F.col(fetched).alias("at")).where("url is not null and at is not null")
    hosts = pairs.select(F.lower(F.regexp_extract("url", _HOST, 1)).alias("host")).where("host <> ''").distinct()
    above = hosts.select("host", F.explode(_domains(F.col("host"))).alias("domain"))
    on_list = above.join(entries.select(F.substring_index("pattern", "/", 1).alias("domain")).distinct(), "domain", "left_semi").select("host").distinct()
    some = pairs.withColumn("host", F.lower(F.regexp_extract("url", _HOST, 1))).join(on_list, "host", "left_semi").select("url", "at").distinct()
    found = some.select("url", "at", F.posexplode(asked("url")).alias("rank", "key")).join(entries, (F.col("key") == F.col("pattern")) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    best = found.groupBy("url", "at").agg(F.min(F.struct("rank", "pattern", "action")).alias("best"))
    c, b = captures.alias("c"), best.alias("b")
    names = [spare(captures.columns, n) for n in ("pattern", "action", "blocked")]
    new = [F.col("b.best.pattern"), F.col("b.best.action"), F.coalesce(F.col("b.best.action") == "block", F.lit(False))]
    return c.join(b, (F.col(f"c.{url}") == F.col("b.url")) & (F.col(f"c.{fetched}") == F.col("b.at")), "left").select("c.*", *[x.alias(n) for x, n in zip(new, names, strict=True)])


ORACLE_SQL = f"""
WITH listed(pattern, action, listed) AS (VALUES {", ".join(f"('{p}', '{a}', DATE '{d}')" for p, a, d in LISTED)}),
spans AS (SELECT pattern, action, listed AS since, lead(listed) OVER (PARTITION BY pattern ORDER BY listed) AS until FROM listed),
captures AS (
    SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
           lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#]+)(?:[/]([^?#]*))?', 2) AS rest
    FROM pages),
parts AS (SELECT *, string_split(host, '.') AS labels, string_split(rest, '/') AS dirs FROM captures),
domains AS (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM parts),
paths AS (SELECT *, array_to_string(labels[i:], '.') AS domain, unnest(range(0, len(dirs))) AS j FROM domains),
keys AS (SELECT page_id, url, fetched, i, j, domain || CASE WHEN j = 0 THEN '' ELSE '/' || array_to_string(dirs[1:j], '/') || '/' END AS key FROM paths),
hits AS (
    SELECT k.page_id, s.pattern, s.action, row_number() OVER (PARTITION BY k.page_id ORDER BY i, j DESC) AS n
    FROM keys k JOIN spans s ON k.key = s.pattern AND k.fetched >= s.since AND (s.until IS NULL OR k.fetched < s.until))
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, h.pattern, h.action, coalesce(h.action = 'block', FALSE) AS blocked
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.n = 1
"""
