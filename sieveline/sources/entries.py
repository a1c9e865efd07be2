"""The core relation: curated entries, read from snapshots or derived from the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.joins import rules
from sieveline.session import table

DOMAINS = ("benefits", "aid", "tools", "organizations", "contacts")
TIERS = ("tier_1_official", "tier_2_ngo_watchdog", "tier_3_press", "tier_4_academic", "tier_unknown")
TOPICS = ("family", "housing", "work", "health", "money")
LANGUAGES = ("de", "en", "easy_de")

#: Declared, never inferred.
SNAPSHOT = (
    "id string, domain string, title string, url string, status string, topics array<string>, tags array<string>, targetGroups array<string>, "
    "summary struct<de string, en string, easy_de string>, content struct<de string, en string, easy_de string>, firstSeen string, lastSeen string, sourceUnavailable boolean, "
    "provenance struct<source string, crawler string, crawledAt string, checksum string, sourceTier string, jurisdiction string>, qualityScores struct<iqs double, ais double>"
)


def read_snapshot(spark: SparkSession, path: str, schema: str = SNAPSHOT) -> DataFrame:
    """Entries of a JSON snapshot, either an array of entries or an object that holds one in ``entries``."""
    raw = spark.read.schema(f"entries array<struct<{_nested(schema)}>>, {schema}").json(path, multiLine=True)
    listed = raw.where("entries is not null").select(F.explode("entries").alias("e")).select("e.*")
    return listed.unionByName(raw.where("entries is null").drop("entries"))


def _nested(schema: str) -> str:
    """A list of columns as the fields of a struct."""
    out, depth = [], 0
    for part in schema.split(", "):
        name, _, kind = part.partition(" ")
        out.append(f"{name}: {kind}" if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def read_domains(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The snapshots of several domains, each row with its domain."""
    parts = [read_snapshot(spark, p).withColumn("domain", F.lit(d)) for d, p in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_domains(entries: DataFrame, path: str) -> None:
    """Entries as Parquet, a folder for each domain; only the domains that are present are replaced."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; lines that aren't JSON are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def write_lines(rows: DataFrame, path: str, order: str = "url") -> None:
    rows.orderBy(order).write.mode("overwrite").json(path)


def _pick(values: tuple[str, ...], k: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), k.cast("int") + 1)


def entries(spark: SparkSession, sf_dir: str, scored: bool = True) -> DataFrame:
    """``documents`` and ``labels`` as entries: lines of the text are title, summary and content.

    Without ``scored`` they have neither iqs nor ais, and texts stay where they are: of the labels only those count that
    give a document more than one row, and they are broadcast if they are few (RULES).
    """
    d, labels, k = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("doc_id")
    lines = F.split("text", "\n")
    if scored:
        rows = d.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    else:
        again = rules(labels.groupBy("doc_id").agg(F.count("*").cast("int").alias("_n")).where("_n > 1"))
        rows = d.join(again, "doc_id", "left").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.coalesce("_n", F.lit(1)))))
    return rows.select(
        k.alias("id"),
        _pick(DOMAINS, k % 5).alias("domain"),
        F.get(lines, F.lit(0)).alias("title_de"),
        F.when(k % 3 != 0, F.get(lines, F.lit(1))).alias("title_en"),
        F.when(k % 4 == 1, F.get(lines, F.lit(2))).alias("title_easy_de"),
        F.get(lines, F.lit(3)).alias("summary_de"),
        F.when(k % 3 != 0, F.get(lines, F.lit(4))).alias("summary_en"),
        F.col("text").alias("content_de"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.org/"), "lang", F.lit("/"), k.cast("string")).alias("url"),
        F.concat("source", F.lit(".example.org")).alias("host"),
        F.when(k % 10 == 0, "archived").when(k % 10 == 1, "under_revision").when(k % 10 == 2, "discontinued").otherwise("active").alias("status"),
        F.when(k % 6 < 5, _pick(TIERS, k % 6)).alias("tier"),
        F.when(k % 3 == 0, "DE").when(k % 3 == 1, "EU").alias("jurisdiction"),
        *[F.when(F.col("quality").isNotNull(), (k * by % 101).cast("double")).alias(n) for n, by in (("iqs", 37), ("ais", 53)) if scored],
        F.expr("timestamp'2023-01-01' + make_interval(0, 0, 0, cast(doc_id % 365 as int))").alias("first_seen"),
        F.when(k % 9 != 0, F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(doc_id * 17 % 500 as int))")).alias("last_seen"),
        F.array(_pick(TOPICS, k % 5), _pick(TOPICS, k % 3)).alias("topics"),
        F.when(k % 4 != 0, F.array(F.col("lang"), F.col("source"))).alias("tags"),
        "lang",
        "source",
        (k % 11 == 0).alias("source_unavailable"),
    )


#: The same relation in DuckDB SQL, as the start of a WITH clause.
ENTRIES_SQL = """
entries AS (
    SELECT d.doc_id AS id, (['benefits','aid','tools','organizations','contacts'])[CAST(d.doc_id % 5 AS INT) + 1] AS domain,
        ls[1] AS title_de, CASE WHEN d.doc_id % 3 <> 0 THEN ls[2] END AS title_en, CASE WHEN d.doc_id % 4 = 1 THEN ls[3] END AS title_easy_de,
        ls[4] AS summary_de, CASE WHEN d.doc_id % 3 <> 0 THEN ls[5] END AS summary_en, d.text AS content_de,
        'https://www.' || d.source || '.example.org/' || d.lang || '/' || d.doc_id AS url, d.source || '.example.org' AS host,
        CASE d.doc_id % 10 WHEN 0 THEN 'archived' WHEN 1 THEN 'under_revision' WHEN 2 THEN 'discontinued' ELSE 'active' END AS status,
        CASE WHEN d.doc_id % 6 < 5 THEN (['tier_1_official','tier_2_ngo_watchdog','tier_3_press','tier_4_academic','tier_unknown'])[CAST(d.doc_id % 6 AS INT) + 1] END AS tier,
        CASE d.doc_id % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'EU' END AS jurisdiction,
        CASE WHEN l.quality IS NOT NULL THEN CAST(d.doc_id * 37 % 101 AS DOUBLE) END AS iqs,
        CASE WHEN l.quality IS NOT NULL THEN CAST(d.doc_id * 53 % 101 AS DOUBLE) END AS ais,
        TIMESTAMP '2023-01-01' + to_days(CAST(d.doc_id % 365 AS INT)) AS first_seen,
        CASE WHEN d.doc_id % 9 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id * 17 % 500 AS INT)) END AS last_seen,
        [(['family','housing','work','health','money'])[CAST(d.doc_id % 5 AS INT) + 1], (['family','housing','work','health','money'])[CAST(d.doc_id % 3 AS INT) + 1]] AS topics,
        CASE WHEN d.doc_id % 4 <> 0 THEN [d.lang, d.source] END AS tags, d.lang, d.source, d.doc_id % 11 = 0 AS source_unavailable
    FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
