"""Structured facts of entries, and answers that are put together from them without a model.

Evidence is a short array of entries (``EVIDENCE``) in order; ``gathered`` makes it from rows.  Every builder is an
expression over such an array: it makes the lines of each entry and joins them.

Edge cases: without evidence there is no answer (null).  Null and blank fields count as absent; a title that is absent is
``Eintrag``.  Texts about cookies and tracking count as absent wherever a builder reads them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import contains_any, fold_german
from sieveline.operators.cleaning import ASKED, let
from sieveline.operators.probes import tokens
from sieveline.operators.ranking import first_of

#: Words of texts about cookies and tracking.
BOILERPLATE = ("einwilligung von nutzenden", "webverhalten- analysetool", "webverhalten-analysetool", "webverhalten analysetool", "matomo", "mit der einwilligung", "cookie-einwilligung", "cookiehinweis", "tracking", "nach erteilung der einwilligung", "widerruf der einwilligung")
#: Facts and summaries that only point elsewhere, with umlauts spelled out.
POINTERS = (r"pruefen sie .*quellseite", r"pruefen sie die hinweise .*verlinkten seite", r"die verlinkte quelle enthaelt die aktuellen hinweise")
CURATED = r"^kuratiert fuer den gewaehlten lebenskontext\.?$|^kuratiert fuer diesen lebenskontext:"
FACT_LEAST, SENTENCE_LEAST, SENTENCE_MOST, LEAD_MOST = 12, 24, 260, 180
#: What a question about papers or appeals has, and terms that a question's subject adds.
PAPERS, APPEALS = r"unterlag|dokument|nachweis|papier|formular", r"widerspruch|bescheid|ablehn|klage"
TERMS = {
    r"beantrag|antrag|wo\b|zust": ("beantrag", "antrag", "online", "stelle", "jobcenter", "familienkasse", "arbeitsagentur"),
    r"wie\s*viel|wieviel|hoehe|betrag|geld|euro|bekomm": ("hoehe", "betrag", "euro", "anspruch", "erhalten", "gezahlt"),
    r"frist|wann|datum|termin|bis": ("frist", "termin", "datum", "monat", "tag", "rueckwirkend"),
}
#: Label, fact and most values of the groups that a question asks for, and of those for any other question.
GROUPS = (("Antrag", "application", 3, ("place", "application")), ("Zustaendige Stelle", "contacts", 2, ("place", "application")), ("Hoehe", "amount", 2, ("amount",)), ("Anspruch", "eligibility", 2, ("amount",)), ("Frist oder Dauer", "deadline", 2, ("deadline",)), ("Unterlagen", "documents", 4, ("papers",)), ("Widerspruch", "appeal", 2, ("appeals",)))
OTHER_GROUPS = (("Anspruch", "eligibility", 2), ("Antrag", "application", 2), ("Hoehe", "amount", 1))
_START, _OFFICE = "online|beantrag|antrag|formular|portal", "jobcenter|familienkasse|elterngeldstelle|sozialamt|arbeitsagentur|dienststelle"
#: The lead of an entry by what is asked, what its title has or its domain is; the first that fits counts.
OFFICIAL_LEADS = ((("place", "application"), _START, None, "Antrag starten"), (("place", "application"), None, None, "Zustaendige Stelle pruefen"), (("application",), None, None, "Antrag pruefen"), (("amount",), None, None, "Hoehe oder Anspruch pruefen"), (("deadline",), None, None, "Frist pruefen"))
FOCUSED_LEADS = (
    (("place", "application"), _START, None, "Antrag starten"), (("place", "application"), _OFFICE, "contacts", "Zustaendige Stelle finden"), (("place", "application"), None, None, "Fuer den Antrag wichtig"), (("place",), None, None, "Passende Stelle pruefen"),
    (("application",), None, None, "Antrag pruefen oder starten"), (("contact",), None, None, "Hilfe bekommen"), (("amount",), None, None, "Betrag oder Anspruch pruefen"), ((), None, None, "Zuerst relevant"),
)
#: How an entry after the first is named by its domain.
NEXT_STEPS = {"tools": "Online starten ueber {}.", "contacts": "Anlaufstelle finden ueber {}."}
NEXT_CARDS = {"tools": "Online starten ueber {}.", "contacts": "Kontakt aufnehmen ueber {}."}
OTHER_STEP, CHECK, UNTITLED = "Danach {} pruefen.", "Direkt pruefen.", "Eintrag"
FIRST, THEN = "Wahrscheinlich zuerst relevant:", "Was du jetzt tun kannst:"

_FACTS = ("application", "amount", "eligibility", "documents", "deadline", "contacts", "appeal")
FACTS = "struct<" + ", ".join(f"{n}: array<string>" for n in _FACTS) + ">"
EVIDENCE = f"array<struct<title: string, summary: string, content: string, url: string, domain: string, facts: {FACTS}>>"


def sober(c: Column) -> Column:
    """A text without white space at its ends; null if it is blank or about cookies."""
    return F.when((F.trim(c) != "") & ~contains_any(F.lower(c), BOILERPLATE), F.trim(c))


def usable(c: Column) -> Column:
    """A text that says something; else null."""
    folded = F.trim(F.regexp_replace(fold_german(c), r"\s+", " "))
    pointer = reduce(lambda a, b: a | b, (folded.rlike(p) for p in (*POINTERS, CURATED)))
    return F.when((F.length(F.trim(c)) >= FACT_LEAST) & ~pointer, sober(c))


def _usable_of(values: Column) -> Column:
    return F.array_compact(F.transform(F.coalesce(values, F.array().cast("array<string>")), usable))


def structured_facts(steps: Column, documents: Column, amount: Column, eligibility: Column, duration: Column, deadline: Column, agency: Column, online: Column, form: Column, channels: Column, appeal: Column) -> Column:
    """An entry's usable facts by kind (``FACTS``)."""
    one = lambda c, lead="": F.concat(F.lit(lead), usable(c))
    some = lambda *c: F.array_compact(F.array(*c))
    link = F.coalesce(F.nullif(F.trim(online), F.lit("")), form)
    told = {
        "application": F.concat(_usable_of(steps), some(one(link, "Online-Antrag: "))), "amount": some(one(amount)), "eligibility": some(one(eligibility)), "documents": _usable_of(documents),
        "deadline": some(one(duration), one(deadline)), "contacts": F.concat(some(one(agency, "Zustaendige Stelle: ")), _usable_of(channels)), "appeal": some(one(appeal)),
    }
    return F.struct(*[told[n].alias(n) for n in _FACTS])


def gathered(rows: DataFrame, key: str, order: list[Column], n: int = 5) -> DataFrame:
    """``key`` and ``evidence`` (``EVIDENCE``): the first ``n`` rows of each key in order; rows have the fields of an entry."""
    fields = [F.col(c) for c in ("title", "summary", "content", "url", "domain", "facts")]
    ranked = first_of(rows.withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])), [key], ["_order"], n)
    listed = F.sort_array(F.collect_list(F.struct("_order", F.struct(*fields).alias("e"))))
    return ranked.groupBy(key).agg(F.transform(listed, lambda x: x["e"]).alias("evidence"))


def _asked(query: Column) -> dict[str, Column]:
    q = fold_german(F.coalesce(query, F.lit("")))
    return {k: q.rlike(p) for k, p in (ASKED | {"papers": PAPERS, "appeals": APPEALS}).items()}


def fact_groups(asked: dict[str, Column], facts: Column) -> Column:
    """``label: value`` for the facts that a question asks for, or a few of any kind if there are none."""

    def told(label: str, name: str, most: int, due: Column) -> Column:
        values = F.transform(F.slice(F.array_distinct(facts[name]), 1, most), lambda v: F.concat(F.lit(f"{label}: "), v))
        return F.when(due, values).otherwise(F.array().cast("array<string>"))

    wanted = F.concat(*[told(label, name, most, reduce(lambda a, b: a | b, (asked[k] for k in kinds))) for label, name, most, kinds in GROUPS])
    return let(wanted, lambda w: F.when(F.size(w) > 0, w).otherwise(F.concat(*[told(label, name, most, F.lit(True)) for label, name, most in OTHER_GROUPS])))


def terms(query: Column) -> Column:
    """What a sentence should have to answer a question, with umlauts spelled out."""
    q = fold_german(F.coalesce(query, F.lit("")))
    long = F.transform(F.filter(tokens(F.coalesce(query, F.lit(""))), lambda w: F.length(w) >= 5), fold_german)
    return F.array_distinct(F.concat(long, *[F.when(q.rlike(p), F.array(*map(F.lit, ws))).otherwise(F.array().cast("array<string>")) for p, ws in TERMS.items()]))


def best_sentences(content: Column, terms: Column, most: int = 2) -> Column:
    """The sentences with most ``terms``: four points for each, and less the later they stand; the first ``most``: the feature."""
    text = F.trim(F.regexp_replace(F.coalesce(sober(content), F.lit("")), r"\s+", " "))
    some = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)).between(SENTENCE_LEAST, SENTENCE_MOST))

    def scored(s: Column, i: Column) -> Column:
        hits = F.size(F.filter(terms, lambda t: F.contains(fold_german(s), t)))
        return F.struct((i * 0.15 - hits * 4.0).alias("less"), i.alias("i"), F.trim(s).alias("s"))

    return F.transform(F.slice(F.sort_array(F.filter(F.transform(some, scored), lambda x: x["less"] < 0)), 1, most), lambda x: x["s"])


#: How a sentence that matters begins, and words that it has.
OPENERS = r"^(?i:You (?:can|must|should|need|are)|The |To |If you|When|Important)"
POINTED = ("eligible", "required", "must", "can apply", "deadline", "amount", "benefit")


def key_points(answer: Column, most: int = 5) -> Column:
    """The sentences of 21 to 199 characters that say most, ``most`` at most: two points for a number, one each for an opener and a word."""
    some = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))), lambda s: F.length(s).between(21, 199))
    whether = lambda c, n: F.when(c, n).otherwise(0)
    scored = F.transform(some, lambda s, i: F.struct((-(whether(s.rlike("[0-9]"), 2) + whether(s.rlike(OPENERS), 1) + whether(contains_any(F.lower(s), POINTED), 1))).alias("less"), i.alias("i"), s.alias("s")))
    return F.transform(F.slice(F.sort_array(scored), 1, most), lambda x: x["s"])


def lead_sentence(summary: Column, content: Column) -> Column:
    """The first sentence of the summary, or of the content, cut at a word after LEAD_MOST characters."""
    text = F.trim(F.regexp_replace(F.coalesce(F.coalesce(F.nullif(F.trim(summary), F.lit("")), content), F.lit("")), r"\s+", " "))
    first = lambda t: F.trim(F.split(t, r"(?<=[.!?])\s+")[0])
    short = lambda s: F.when(F.length(s) > LEAD_MOST, F.concat(F.regexp_replace(F.substring(s, 1, LEAD_MOST), r"\s+\S*$", ""), F.lit("."))).otherwise(s)
    return F.coalesce(let(first(sober(text)), short), F.lit(CHECK))


def _title(e: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(e["title"]), F.lit("")), F.lit(UNTITLED))


def _source(e: Column) -> Column:
    """The line that names an entry's source; none without one."""
    return F.when(F.coalesce(e["url"], F.lit("")) != "", F.array(F.concat(F.lit("[Quelle: "), e["url"], F.lit("]")))).otherwise(F.array().cast("array<string>"))


def _lead(leads: tuple, asked: dict[str, Column], title: Column, domain: Column) -> Column:
    """The first lead that fits; null if none does."""
    out = []
    for kinds, pattern, of, lead in leads:
        due = reduce(lambda a, b: a & b, (asked[k] for k in kinds), F.lit(True))
        if pattern:
            fits = title.rlike(pattern)
            due &= fits if of is None else fits | F.coalesce(domain == of, F.lit(False))
        out.append(F.when(due, lead))
    return F.coalesce(*out)


def _answer(lines: Column, evidence: Column) -> Column:
    return F.when(F.size(evidence) > 0, F.array_join(lines, "\n"))


def official_answer(query: Column, evidence: Column) -> Column:
    """Up to four entries: what to do with each, its facts that the question asks for, else its best sentences, and its source; no line twice."""
    asked, wanted = _asked(query), terms(query)

    def lines(e: Column) -> Column:
        title, name = fold_german(_title(e)), _title(e)
        lead = _lead(OFFICIAL_LEADS, asked, title, e["domain"])
        summary = F.array_compact(F.array(usable(lead_sentence(e["summary"], e["content"]))))
        body = F.coalesce(F.nullif(F.trim(e["content"]), F.lit("")), e["summary"])
        sentences = let(best_sentences(body, wanted), lambda s: F.when(F.size(s) > 0, s).otherwise(summary))
        details = let(fact_groups(asked, e["facts"]), lambda g: F.when(F.size(g) > 0, g).otherwise(sentences))
        told = F.transform(F.filter(details, lambda d: ~F.contains(fold_german(d), title)), lambda d: F.concat(F.lit("  - "), d))
        return F.concat(F.array(F.concat(F.lit("- "), F.coalesce(F.concat(lead, F.lit(": ")), F.lit("")), name, F.lit("."))), told, _source(e))

    def once(every: Column) -> Column:
        plain = F.transform(every, lambda x: F.trim(F.regexp_replace(fold_german(x), r"\s+", " ")))
        return let(plain, lambda p: F.filter(every, lambda x, i: F.array_position(p, F.get(p, i)) == i + 1))

    return _answer(let(F.flatten(F.transform(F.slice(evidence, 1, 4), lines)), once), evidence)


def focused_answer(query: Column, evidence: Column) -> Column:
    """Up to three different entries: what to do with each, its first sentence and its source."""
    asked = _asked(query)

    def lines(e: Column) -> Column:
        title, name = fold_german(_title(e)), _title(e)
        summary = lead_sentence(e["summary"], e["content"])
        told = let(summary, lambda s: F.when(F.contains(fold_german(s), title), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("  "), s))))
        return F.concat(F.array(F.concat(F.lit("- "), _lead(FOCUSED_LEADS, asked, title, e["domain"]), F.lit(": "), name, F.lit("."))), told, _source(e))

    return _answer(F.flatten(F.transform(F.slice(F.array_distinct(evidence), 1, 3), lines)), evidence)


def _steps(e: Column, texts: dict[str, str]) -> Column:
    say = lambda t: F.concat(F.lit("- " + t.split("{}")[0]), _title(e), F.lit(t.split("{}")[1]))
    out = say(OTHER_STEP)
    for domain, text in texts.items():
        out = F.when(e["domain"] == domain, say(text)).otherwise(out)
    return F.array(out)


def _ordered(evidence: Column, first: Column, later: dict[str, str], sources: bool) -> Column:
    """The first entry with a line about it, then what to do with up to two others."""
    none = F.array().cast("array<string>")
    source = _source if sources else lambda e: none
    head = F.concat(F.array(F.lit(FIRST), first), source(evidence[0]))
    rest = F.flatten(F.transform(F.slice(evidence, 2, 2), lambda e: F.concat(_steps(e, later), source(e))))
    return _answer(F.concat(head, F.when(F.size(evidence) > 1, F.array(F.lit(""), F.lit(THEN))).otherwise(none), rest), evidence)


def synthesis_answer(evidence: Column) -> Column:
    """The first entry with its summary or content, then up to two more, each with its source."""
    return let(F.slice(evidence, 1, 3), lambda es: let(F.get(es, F.lit(0)), lambda e: _ordered(es, F.concat(F.lit("- "), _title(e), F.lit(": "), F.coalesce(usable(e["summary"]), usable(e["content"]), F.lit(CHECK))), NEXT_STEPS, True)))


def card_answer(evidence: Column) -> Column:
    """As ``synthesis_answer`` with the summary as it is, other words for contacts, and the sources left to the caller."""
    return let(F.slice(evidence, 1, 3), lambda es: let(F.get(es, F.lit(0)), lambda e: _ordered(es, F.concat(F.lit("- "), _title(e), F.lit(": "), F.coalesce(F.nullif(F.trim(e["summary"]), F.lit("")), F.lit(CHECK))), NEXT_CARDS, False)))
