"""Structured facts and extractive answers as queries.

Entries have no fact columns; the queries derive them from titles, summaries and ids.  Each host is asked one of six
questions, and its five entries with the best scores are the evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import answers as op
from sieveline.plans.registry import query
from sieveline.sources.entries import ENTRIES_SQL, entries

E = f"WITH {ENTRIES_SQL}"
QUESTIONS = ("Wo kann ich den Antrag stellen?", "Wie viel Euro bekomme ich?", "Bis wann läuft die Frist?", "Welche Unterlagen brauche ich für den Widerspruch?", "Wer hilft mir?", "the thing")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their facts under the names that ``answers.gathered`` reads."""
    k = F.col("id")
    named = lambda lead, end="": F.concat(F.lit(lead), k.cast("string"), F.lit(end))
    facts = op.structured_facts(
        F.array("title_de", F.lit("Prüfen Sie die Angaben auf der Quellseite."), F.lit("kurz"), F.col("title_en")), F.when(k % 3 == 0, F.array(named("Meldebescheinigung "), F.lit("Pass"), F.lit("Wir nutzen Matomo zum Tracking."))),
        F.when(k % 4 == 0, named("Regelbedarf ", " Euro")).when(k % 4 == 1, "Die verlinkte Quelle enthält die aktuellen Hinweise zur Höhe."), F.col("summary_de"), F.when(k % 5 == 0, named("Zwölf Monate ab ")), F.when(k % 7 == 0, named("Bis zum Monat ")),
        F.when(k % 2 == 0, named("Jobcenter Nummer ")), F.when(k % 6 == 0, F.lit(" ")).when(k % 6 == 1, F.col("url")), F.when(k % 6 == 0, F.lit("https://example.org/formular")), F.array(named("Telefon 030 ")), F.when(k % 8 == 0, F.lit("Kuratiert für den gewählten  Lebenskontext.")),
    )
    return entries(spark, sf_dir).select("id", "host", "ais", F.col("title_de").alias("title"), F.col("summary_de").alias("summary"), F.col("content_de").alias("content"), "url", "domain", facts.alias("facts"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, question, evidence."""
    rows = op.gathered(_evidence(spark, sf_dir), "host", [-F.coalesce("ais", F.lit(-1.0)), F.col("id")])
    return rows.select("host", F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.crc32("host") % len(QUESTIONS) + 1).cast("int")).alias("question"), "evidence")


_USABLE = lambda c: f"(trim({c}) <> '' AND length(trim({c})) >= 12 AND NOT regexp_matches(lower({c}), 'einwilligung von nutzenden|webverhalten[- ]? ?analysetool|matomo|mit der einwilligung|cookie-einwilligung|cookiehinweis|tracking|nach erteilung der einwilligung|widerruf der einwilligung'))"
_TEXT = lambda c: f"CASE WHEN {_USABLE(c)} THEN trim({c}) END"


@query("t32_structured_facts", E + f"""SELECT id, list_filter([{_TEXT("title_de")}, {_TEXT("title_en")}, CASE id % 6 WHEN 0 THEN 'Online-Antrag: https://example.org/formular' WHEN 1 THEN 'Online-Antrag: ' || {_TEXT("url")} END], lambda x: x IS NOT NULL) AS application,
CASE WHEN id % 4 = 0 THEN ['Regelbedarf ' || id || ' Euro'] ELSE []::VARCHAR[] END AS amount, list_filter([{_TEXT("summary_de")}], lambda x: x IS NOT NULL) AS eligibility, CASE WHEN id % 3 = 0 THEN ['Meldebescheinigung ' || id] ELSE []::VARCHAR[] END AS documents,
list_filter([CASE WHEN id % 5 = 0 THEN 'Zwölf Monate ab ' || id END, CASE WHEN id % 7 = 0 THEN 'Bis zum Monat ' || id END], lambda x: x IS NOT NULL) AS deadline,
list_filter([CASE WHEN id % 2 = 0 THEN 'Zustaendige Stelle: Jobcenter Nummer ' || id END, 'Telefon 030 ' || id], lambda x: x IS NOT NULL) AS contacts, []::VARCHAR[] AS appeal FROM entries""")
def t32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("id", "facts.*")


_TOP = E + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY coalesce(ais, -1) DESC, id) AS n FROM entries),
named AS (SELECT *, coalesce(nullif(trim(title_de), ''), 'Eintrag') AS t FROM ranked WHERE n <= 3)
"""


def _ordered_sql(first: str, contacts: str, source: str) -> str:
    step = f"CASE domain WHEN 'tools' THEN '- Online starten ueber ' || t || '.' WHEN 'contacts' THEN '- {contacts} ueber ' || t || '.' ELSE '- Danach ' || t || ' pruefen.' END || {source}"
    rest = "CASE WHEN count(*) > 1 THEN chr(10) || chr(10) || 'Was du jetzt tun kannst:' || chr(10) || string_agg(s, chr(10) ORDER BY n) FILTER (n > 1) ELSE '' END"
    lead = f"'Wahrscheinlich zuerst relevant:' || chr(10) || '- ' || t || ': ' || {first} || {source}"
    return _TOP + f", lines AS (SELECT host, n, CASE WHEN n = 1 THEN {lead} ELSE {step} END AS s FROM named) SELECT host, any_value(s) FILTER (n = 1) || {rest} AS answer FROM lines GROUP BY host"


@query("t33_synthesis_answers", _ordered_sql(f"coalesce({_TEXT('summary_de')}, {_TEXT('content_de')}, 'Direkt pruefen.')", "Anlaufstelle finden", "CASE WHEN coalesce(url, '') <> '' THEN chr(10) || '[Quelle: ' || url || ']' ELSE '' END"))
def t33_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("host", op.synthesis_answer(F.col("evidence")).alias("answer"))


@query("t33_card_answers", _ordered_sql("coalesce(nullif(trim(summary_de), ''), 'Direkt pruefen.')", "Kontakt aufnehmen", "''"))
def t33_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("host", op.card_answer(F.col("evidence")).alias("answer"))


def _built(build: Column, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("host", "question", build.alias("answer"))


@query("t33_focused_answers")
def t33_focused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against loops in tests/test_answers.py."""
    return _built(op.focused_answer(F.col("question"), F.col("evidence")), spark, sf_dir)


@query("t33_official_answers")
def t33_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against loops in tests/test_answers.py."""
    return _built(op.official_answer(F.col("question"), F.col("evidence")), spark, sf_dir)
