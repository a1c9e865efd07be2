"""Plain language as queries; SQL beside each where it isn't the builders' own rules, which tests hold against loops.

Entries hold none of the hard words, so one of eight sentences about money stands before each summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import plain as op
from sieveline.operators.ranking import first_of
from sieveline.plans.registry import query
from sieveline.session import table
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL}"
SENTENCES = ("Das Bürgergeld und der Kinderzuschlag: beides zählt.", "Sie oder Mitglieder Ihrer Familie sind erwerbsfähig, oder nicht.", "Hilfebedürftig ist, wer kein Geld hat; das prüft das Jobcenter.", "Die Voraussetzungen sind erfüllt!", "Sie können Arbeitslosengeld beantragen.", "Das Existenzminimum | der Lebensunterhalt", "", "Unterhaltsvorschuss, Bedarfsgemeinschaft und Lebensmittelpunkt.")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, host, ais, title, url and text of every entry."""
    said = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("id") % 8).cast("int") + 1)
    return entries(spark, sf_dir).select("id", "host", "ais", F.col("title_de").alias("title"), "url", F.trim(F.concat(said, F.lit(" "), F.coalesce("summary_de", F.lit("")))).alias("text"))


@query("t37_plain_language")
def t37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels of every entry; held against loops in tests/test_plain.py."""
    return _texts(spark, sf_dir).select("id", op.einfach(F.col("title"), F.col("text")).alias("einfach"), op.leicht(F.col("title"), F.col("text")).alias("leicht"))


def _audit_sql() -> str:
    hard = (("bedarfsgemeinschaft", "Familie oder Menschen, die zusammen leben", "Das sind Menschen, die zusammen leben und gemeinsam Geld zum Leben brauchen."), ("hilfebed[üu]rftig", "auf Hilfe angewiesen", "Das bedeutet: Das Geld reicht nicht zum Leben."), ("erwerbsf[äa]hig", "arbeitsfähig", "Das bedeutet: Sie können arbeiten."), ("jobcenter", "Jobcenter", "Das Jobcenter ist die Stelle für Bürgergeld."),
            ("b[üu]rgergeld", "Bürger-Geld", "Das ist Geld für Menschen mit wenig oder keinem Einkommen."), ("arbeitslosengeld", "Arbeitslosen-Geld", "Das ist Geld für Menschen ohne Arbeit."), ("kinderzuschlag", "Kinder-Zuschlag", "Das ist extra Geld für Familien mit wenig Einkommen."), ("unterhaltsvorschuss", "Unterhalts-Vorschuss", "Das ist Geld für Kinder, wenn Unterhalt fehlt."))
    lacks = " + ".join(f"(regexp_matches(t, '(?i)(^|[^A-Za-z0-9_]){p}($|[^A-Za-z0-9_])') AND NOT contains(t, '{r} bedeutet') AND NOT contains(t, '{m}'))::INT" for p, r, m in hard)
    said = ", ".join(f"'{x}'" for x in SENTENCES)
    return E + f""", x AS (SELECT id, trim(regexp_replace(trim([{said}][CAST(id % 8 AS INT) + 1] || ' ' || coalesce(summary_de, '')), '\\s+', ' ', 'g')) AS t FROM entries),
p AS (SELECT id, t, list_filter(list_transform(string_split(regexp_replace(t, '([:;.!?])\\s+', '\\1|', 'g'), '|'), lambda y: trim(y)), lambda y: y <> '') AS ps, {lacks} AS j FROM x),
w AS (SELECT *, list_sum(list_transform(ps, lambda y: len(string_split(y, ' ')))) / len(ps) AS avg FROM p)
SELECT id, CASE WHEN t = '' THEN 0 ELSE greatest(0, 100 - CASE WHEN avg > 16 THEN 18 ELSE 0 END - CASE WHEN len(ps) > 8 THEN 8 ELSE 0 END - CASE WHEN regexp_matches(t, '[;:]') THEN 6 ELSE 0 END - least(20, 5 * j)) END AS einfach,
CASE WHEN t = '' THEN 0 ELSE greatest(0, 100 - CASE WHEN avg > 10 THEN 24 ELSE 0 END - CASE WHEN contains(t, ', ') THEN 10 ELSE 0 END - CASE WHEN contains(t, 'bedeutet') THEN 0 ELSE 10 END - least(20, 5 * j)) END AS leicht FROM w"""


@query("r35_plain_audit", _audit_sql())
def r35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How plain every entry's text is for both levels, hard words that nothing explains included."""
    return _texts(spark, sf_dir).select("id", *[op.audit(F.col("text"), mode)["score"].alias(mode) for mode in ("einfach", "leicht")])


def _translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry's translations before and after they are filled: one of five has a reviewed record, one of three a suggestion, some without a body."""
    k, none = F.col("id"), F.lit(None).cast("string")

    def record(body: F.Column, status: str) -> F.Column:
        return F.struct(F.lit("T").alias("title"), F.lit("S").alias("summary"), body.alias("body"), none.alias("source"), none.alias("crawled_at"), F.lit("hand").alias("method"), none.alias("generator"), F.lit("2024-01-01").alias("timestamp"), F.lit(status == "approved").alias("reviewed"), F.lit("leicht").alias("variant"), F.lit(status).alias("review_status"))

    own = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(key).alias("key"), record(body, status).alias("value"))) for when, key, body, status in ((k % 5 == 0, "de-LEICHT", F.lit("Geprüft."), "approved"), (k % 3 == 0, "de-LEICHT-SUGGESTED", F.when(k % 2 == 0, "Vorschlag."), "suggested"), (k % 4 == 0, "en", F.lit("English"), "approved"))]))
    old = F.map_from_entries(own)
    t = _texts(spark, sf_dir).withColumn("old", F.when(k % 7 != 0, old))
    return t.withColumn("new", op.filled_translations(F.col("old"), F.col("title"), F.col("text"), F.col("url"), none, F.lit("2024-06-01")))


@query("t38_filled_translations", E + """SELECT id, list_sort(list_filter(['de-EINFACH-SUGGESTED', 'de-LEICHT-SUGGESTED', CASE WHEN id % 7 <> 0 AND id % 5 = 0 THEN 'de-LEICHT' END, CASE WHEN id % 7 <> 0 AND id % 4 = 0 THEN 'en' END], lambda x: x IS NOT NULL)) AS languages,
CASE WHEN id % 7 <> 0 AND id % 6 = 0 THEN 'hand' ELSE 'rule' END AS method, CASE WHEN id % 7 <> 0 AND id % 6 = 0 THEN '2024-01-01' ELSE '2024-06-01' END AS timestamp, CASE WHEN id % 7 <> 0 AND id % 6 = 0 THEN 'T' ELSE coalesce(nullif(trim(title_de), ''), 'Eintrag') END AS title FROM entries""")
def t38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which translations every entry has afterwards, and where its suggestion for the second level comes from."""
    r = F.col("new")["de-LEICHT-SUGGESTED"]
    return _translations(spark, sf_dir).select("id", F.array_sort(F.map_keys("new")).alias("languages"), r["method"].alias("method"), r["timestamp"].alias("timestamp"), r["title"].alias("title"))


@query("t39_readable_answers")
def t39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer at each level from the three best entries of each host; held against loops in tests/test_plain.py."""
    best = first_of(_translations(spark, sf_dir).withColumn("o", F.struct(-F.coalesce("ais", F.lit(-1.0)), "id")), ["host"], ["o"], 3)
    texts = lambda mode: F.transform(F.sort_array(F.collect_list(F.struct("o", op.readable(F.col("new"), mode).alias("t")))), lambda x: x["t"])
    gathered = best.groupBy("host").agg(texts("einfach").alias("e"), texts("leicht").alias("l"))
    return gathered.select("host", op.grounded_answer(F.col("e"), "einfach").alias("einfach"), op.grounded_answer(F.col("l"), "leicht").alias("leicht"))
