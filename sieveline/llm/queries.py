"""The corpus operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, fingerprint, langid, media, mixing, neardup, periodic, pii, repeats, secretscan, spelling, toxicity, urlfilter
from sieveline.session import table


def vocabulary_path() -> str:
    """Where the public byte-level vocabulary is on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=0.85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~toxicity.held_out(3, 1)))
    return langid.languages(docs, model).select("doc_id", toxicity.held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "token_ids"), path)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.where(~toxicity.held_out(5, 0)))
    out = toxicity.scored(docs, machine)
    return out.select("doc_id", toxicity.held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 366) as int))").alias("fetched"))
    judged = urlfilter.judge(captures, urlfilter.sample_list(spark))
    return judged.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "pattern", "action", "blocked")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def _with_copies(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row; in one of ten texts a part of the words stands again and again until the end.

    Let h be the unsigned crc32 of the id in decimals, g = h // 10 and n the number of words.  If h % 10 = 0, word i
    becomes word a + (i - a) % p from word a on, where a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parted = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).alias("words"))
    sized = parted.select("*", F.size("words").alias("n"), F.expr("h div 10").alias("g"))
    placed = sized.select("*", F.expr("if(n > 0, cast(g % n as int), 0)").alias("a")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.described(_with_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", periodic.longest())
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secretscan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(secretscan.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, r.kind)) for r in secretscan.BASE]
    counts = [(F.size("spans") - left).cast("long").alias(f"n_{r.kind}") for r, left in zip(secretscan.BASE, counts, strict=True)]
    return out.select("doc_id", *counts, F.sha2(secretscan.listed(base), 256).alias("base_sha256"), secretscan.listed(F.col("spans")).alias("spans"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose hash with their document's id is a multiple of 199 lose one letter."""

    def written(run: Column) -> Column:
        h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % 199 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)

    words = spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), least_letters=6, least=5, written=written)
    return spelling.variants(words, ratio=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_near_dedup, op2_language_id, op3_bpe, op4_media, op5_substring_dedup, op6_mixing, op7_toxicity, op8_url_filters, op9_fingerprints, op10_pii, op11_periodic_runs, op12_secret_scan, op13_spelling_variants, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": urlfilter.ORACLE_SQL, "op12_secret_scan": secretscan.ORACLE_SQL}
