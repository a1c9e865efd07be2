"""Records as other programs read them: benefits, evidence, catalog items, seeds; and snapshots of entries as documents.

Edge cases: null and blank fields are left out of what is optional and empty in what isn't.  Lists lose their blank items.
A snapshot's document has at most as many entries as it is told, so no document and no task holds a whole domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.batches import greedy
from sieveline.operators.shaping import multilingual
from sieveline.session import spare

#: Version of a snapshot, and how much of a text its evidence shows.
VERSION, SHOWN = "0.1.0", 600
#: Fields of a seed that are texts, and that are lists.
SEED_TEXTS = ("label", "sourceTier", "institutionType", "jurisdiction", "seedCategory", "notes", "source")
SEED_LISTS = ("topics", "tags", "targetGroups", "allowedPaths")


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _items(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")


def benefit(amount: dict[str, Column], eligibility: dict[str, Column], duration: Column, steps: Column, documents: Column, form: Column, contact: Column) -> Column:
    """A benefit's fields: texts by language without empty ones, lists that are never null."""
    flat = {f"{n}_{k}": _given(c) for n, texts in (("benefit_amount", amount), ("eligibility_criteria", eligibility)) for k, c in texts.items()}
    lists = {"applicationSteps": steps, "requiredDocuments": documents}
    return F.struct(
        multilingual(amount).alias("benefitAmount"), multilingual(eligibility).alias("eligibilityCriteria"), *[c.alias(n) for n, c in flat.items()], _given(duration).alias("duration"),
        *[F.coalesce(c, F.array().cast("array<string>")).alias(n) for n, c in lists.items()], _given(form).alias("formLink"), contact.alias("contactInfo"),
    )


def without_translations(df: DataFrame, asked: bool = False, column: str = "translations") -> DataFrame:
    """``df`` without its translations unless they are asked for."""
    return df if asked else df.drop(column)


def evidence(chunk: dict[str, Column], score: Column) -> Column:
    """A chunk as evidence: its payload as JSON, with the first ``SHOWN`` characters as summary, and its score as confidence from 0 to 1."""
    of = lambda n: F.coalesce(chunk.get(n, F.lit("")), F.lit(""))
    payload = F.struct(
        of("chunk_id").alias("id"), of("title").alias("title"), of("url").alias("url"), F.struct(F.substring(of("text"), 1, SHOWN).alias("de")).alias("summary"), F.struct(of("text").alias("de")).alias("content"),
        F.coalesce(chunk.get("topics", F.lit(None).cast("array<string>")), F.array().cast("array<string>")).alias("topics"), of("document_type").alias("domain"), F.lit("active").alias("status"),
        F.struct(of("url").alias("source"), F.coalesce(_given(of("source_name")), of("source_id")).alias("source_name"), *[of(n).alias(n) for n in ("source_trust_level", "knowledge_layer", "document_type", "section_title", "publication_date", "license_or_rights")]).alias("provenance"),
    )
    return F.struct(F.lit("rag").alias("source"), F.to_json(payload).alias("content"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("confidence"))


def catalog_item(source: Column, counts: Column) -> Column:
    """A registered source (id, name, hosts, tier, institution, jurisdiction, role, domains, base_url) with what its entries add up to (entries, domains, iqs_sum, iqs_count, ais_sum, ais_count, last_seen, sample_url)."""
    host = F.get(source["hosts"], F.lit(0))
    or_unknown = lambda c, other="unknown": F.coalesce(_given(c), F.lit(other))
    mean = lambda n: F.when(counts[f"{n}_count"] > 0, counts[f"{n}_sum"] / counts[f"{n}_count"])
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(_given(source["id"]), host, _given(source["name"]), F.lit("unknown")).alias("id"), F.coalesce(_given(source["name"]), host, F.lit("Unknown source")).alias("name"), F.coalesce(host, F.lit("unknown")).alias("host"),
        or_unknown(source["tier"]).alias("sourceTier"), or_unknown(source["institution"]).alias("institutionType"), or_unknown(source["jurisdiction"]).alias("jurisdiction"), source["role"].alias("sourceRole"),
        F.coalesce(counts["entries"], F.lit(0)).cast("long").alias("entryCount"), F.array_distinct(F.concat(F.coalesce(source["domains"], none), F.coalesce(counts["domains"], none))).alias("domains"),
        mean("iqs").alias("avgIqs"), mean("ais").alias("avgAis"), counts["last_seen"].alias("lastSeen"), F.coalesce(counts["sample_url"], _given(source["base_url"])).alias("sampleUrl"),
    )


def seed(raw: Column) -> Column:
    """A seed from JSON: a URL as a string, or an object with one; null for anything else.  Blank texts and items are left out, and only a stated ``false`` disables it."""
    lists = ", ".join(f"{n} string" for n in SEED_LISTS)
    parsed = F.from_json(raw, f"url string, enabled string, priority string, {', '.join(f'{n} string' for n in SEED_TEXTS)}, {lists}")
    text = _given(F.regexp_replace(F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x"), r"^\s+|\s+$", ""))
    listed = lambda n: F.from_json(parsed[n], "array<string>")
    some = lambda n: F.when(F.size(_items(listed(n))) > 0, _items(listed(n)))
    url = F.when(F.trim(raw).startswith('"'), text).otherwise(_given(parsed["url"]))
    record = F.struct(url.alias("url"), (F.coalesce(parsed["enabled"], F.lit("true")) != "false").alias("enabled"), *[_given(parsed[n]).alias(n) for n in SEED_TEXTS], *[some(n).alias(n) for n in SEED_LISTS], F.when(parsed["priority"].rlike("^-?[0-9]{1,9}$"), parsed["priority"].cast("int")).alias("priority"))
    return F.when(url.isNotNull(), record)


def write_snapshots(entries: DataFrame, path: str, domain: str = "domain", key: str = "id", most: int = 1000) -> None:
    """Entries as documents {version, domain, entries}, one in each line, of one domain and at most ``most`` entries each."""
    batch = spare(entries.columns, "batch")
    numbered = greedy(entries, F.col(domain), [F.col(key)], F.lit(1), most, most)
    kept = [c for c in entries.columns if c != domain]
    documents = numbered.groupBy(domain, F.col(batch).alias("_n")).agg(F.sort_array(F.collect_list(F.struct(key, F.struct(*kept).alias("e")))).alias("_e"))
    listed = F.transform("_e", lambda x: x["e"])
    documents.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.col(domain).alias("domain"), listed.alias("entries"))).alias("value")).write.mode("overwrite").text(path)


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries (``schema``) of documents as ``write_snapshots`` makes them, or of lists of entries, one in each line; ``domain`` is that of the document."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    listed = F.when(F.trim("value").startswith("["), F.struct(F.lit(None).cast("string").alias("domain"), F.from_json("value", f"array<struct<{schema}>>").alias("entries"))).otherwise(F.from_json("value", f"domain string, entries array<struct<{schema}>>"))
    return lines.select(listed.alias("d")).select("d.domain", F.explode("d.entries").alias("e")).select("domain", "e.*")


def read_keyed(spark: SparkSession, path: str, schema: str, key: Column, order: str) -> DataFrame:
    """The last row by ``order`` of each key of a file of JSON lines; lines that aren't objects and rows without a key are left out."""
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*").withColumn("_key", key).where("_key is not null")
    kept = rows.columns[:-1]
    return rows.groupBy("_key").agg(F.max(F.struct(order, *[c for c in kept if c != order])).alias("_r")).select(F.col("_key").alias("key"), *[f"_r.{c}" for c in kept])
