"""Scores from rule tables: what a query has, what an entry has, and the points that both together give."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import contains_any, fold_german
from sieveline.operators.cleaning import let
from sieveline.operators.discovery import keyword_matches, scenario_text
from sieveline.operators.probes import OFFICIAL, ORGANISATIONS, QUESTION_WORDS


@dataclass(frozen=True)
class Rule:
    """``points`` for entries that meet every clause of ``when``, if the query meets every one of ``asks`` and has none of ``unless``.

    A clause of ``asks`` is terms of which the query has one.  A clause of ``when`` is tests of which one holds: ``field: term``
    for a field that has a term, ``field= term`` for one that is it, ``field$ term`` for one that ends with it; a clause that begins
    with ``not`` holds if none does.  Fields are title and text with umlauts spelled out, raw (the text as it is), url and domain.
    """

    points: float
    when: tuple[tuple[str, ...], ...]
    asks: tuple[tuple[str, ...], ...] = ()
    unless: tuple[str, ...] = ()


_JOBLESS, _ONLINE, _HELP, _VOUCHER = (("arbeitslos",),), (("online", "antrag", "beantrag"),), (("hilfe", "unterstuetz"),), (("bildungsgutschein",),)
_BASIC = (("buergergeld",), ("antrag", "beantrag", "wo kann"))
_FAMILY = (("elterngeld", "kindergeld"), ("antrag", "beantrag"))
_CHILD, _PARENT = (*_FAMILY, ("kindergeld",)), (*_FAMILY, ("elterngeld",))
_RECOGNITION = (("berufsanerkennung", "abschluss", "zeugnisanerkennung"),)
#: Bonuses and penalties of entries for what a query asks.
RULES = (
    Rule(5, (("domain= contacts",),), (("kontakt", "telefon", "erreichen"),)),
    Rule(60, (("title: arbeitslos melden", "text: arbeitslos melden"),), _JOBLESS),
    Rule(24, (("title: arbeitslosengeld", "text: arbeitslosengeld beantragen"),), _JOBLESS),
    Rule(18, (("url: arbeitslosengeld",),), _JOBLESS),
    Rule(42, (("text: arbeitsagentur und jobcenter vor ort",),), _JOBLESS),
    Rule(-45, (("text: freiwillige arbeitslosenversicherung",),), _JOBLESS, ("selbst", "umschulung", "elternzeit", "ausland")),
    Rule(-35, (("text: sanktion", "text: widerspruch", "text: rechtsberatung"),), (), ("sanktion", "widerspruch", "bescheid", "klage")),
    Rule(-35, (("text: integrationskurs", "text: zugewanderte", "text: migration", "text: gefluechtete", "text: ukraine"),), (), ("migration", "zugewander", "ausland", "aufenthalt", "asyl")),
    Rule(-55, (("title: selbststaendigkeit mit kind", "url: /selbststaendigkeit"),), (), ("selbst", "freiberuf", "unternehmen")),
    Rule(-45, (("text: obdachlos", "text: wohnungslos", "text: notunterkunft"),), (("energie", "strom", "heizkosten", "abschaltung"),), ("wohnung", "obdach", "raeumung")),
    Rule(4, (("domain= aid",),), _HELP),
    Rule(3.5, (("domain= contacts",),), _HELP),
    Rule(2.5, (("domain= benefits",),), _HELP),
    Rule(1.5, (("domain= tools",),), _HELP),
    Rule(3, (("domain= tools",),), _ONLINE),
    Rule(3, (("raw: eservices",),), _ONLINE),
    Rule(80, (("title: buergergeld online beantragen", "url: buergergeld-beantragen"),), _BASIC),
    Rule(48, (("title: buergergeld",), ("title: antrag und bescheid",)), _BASIC),
    Rule(36, (("title: buergergeld",), ("url$ /buergergeld",)), _BASIC),
    Rule(22, (("text: jobcenter", "url: jobcenter"),), _BASIC),
    Rule(-45, (("title: einkommen",), ("title: ergaenzen",)), _BASIC),
    Rule(-70, (("text: freiwillige arbeitslosenversicherung",),), _BASIC),
    Rule(-28, (("title: arbeitslosengeld",),), _BASIC, ("arbeitslosengeld",)),
    Rule(18, (("title: bildungsgutschein", "text: bildungsgutschein"),), _VOUCHER),
    Rule(10, (("title: weiterbildungsfoerderung", "text: weiterbildungsfoerderung"),), _VOUCHER),
    Rule(8, (("url: fbwo",),), _VOUCHER),
    Rule(-14, (("text: freiwillige arbeitslosenversicherung",),), _VOUCHER),
    Rule(-8, (("text: berufliche rehabilitation",),), _VOUCHER, ("rehabilitation", "behinderung")),
    Rule(5, (("text: beantragen", "text: antrag stellen"),), _FAMILY),
    Rule(18, (("title: kindergeld-antrag", "url: kindergeld-antrag"),), _CHILD),
    Rule(45, (("text: kindergeld-antrag stellen",),), _CHILD),
    Rule(14, (("text: elterngelddigital",),), _PARENT),
    Rule(12, (("text: elterngeld",), ("text: beantragen",)), _PARENT),
    Rule(90, (("title: elterngelddigital",),), _PARENT),
    Rule(-10, (("text: kinderzuschlag",),), _FAMILY, ("kinderzuschlag",)),
    Rule(28, (("title: kinderzuschlag",), ("title: anspruch", "title: hoehe", "url: anspruch-hoehe-dauer")), (("kinderzuschlag",), ("wie viel", "wie hoch", "hoehe", "betrag"))),
    Rule(-60, (("url: /meta/languages", "text: oικογενειακές", "text: paroches"),)),
    Rule(-18, (("not", "raw: beruf", "raw: qualifikation", "raw: zeugnis", "raw: gleichwertig", "raw: anerkennungsberatung", "raw: iq netzwerk", "raw: ihk"),), _RECOGNITION),
    Rule(-24, (("raw: vaterschaft", "raw: schuldner", "raw: unterhalt", "raw: familie", "raw: kindergeld"),), _RECOGNITION),
)
#: Questions for the place of an application, their words that name no subject, and where entries show one.
PLACE = r"\bwo\b.*\b(beantrag|antrag|stelle|zustaendig|bekomme)\b|\bwie\b.*\b(beantrag|antrag stellen)\b"
ACTIONS = ("beantrag", "beantrage", "beantragen", "antrag", "stellen", "stelle", "zustaendig", "zustandig", "online", "bekomme", "kann")
SURFACE = ("title: beantrag", "title: antrag", "url: beantrag", "url: antrag", "text: online beantragen", "text: antrag stellen", "text: zustaendig", "text: jobcenter", "text: familienkasse", "text: sozialamt")

#: Keywords, document types and topics that raise a chunk, and by what factor.
BOOSTS = (
    (("kindergeld", "familienkasse", "beantragen", "antrag"), ("formular",), ("family", "kindergeld"), 1.6),
    (("sanktion", "leistungsminderung", "meldeversäumnis", "pflichtverletzung"), ("weisung",), ("sanktionen", "buergergeld"), 1.35),
    (("unterkunft", "kdu", "miete", "wohnen", "heizung", "angemessen"), ("weisung",), ("housing", "kosten_der_unterkunft"), 1.35),
    (("bürgergeld", "sgb ii", "grundsicherung", "alg ii", "arbeitslosengeld ii"), ("statute", "merkblatt", "weisung"), ("financial_support", "buergergeld"), 1.2),
    (("arbeitslosengeld", "alg i", "sgb iii", "arbeitslos"), ("statute", "merkblatt"), ("employment", "arbeitslosengeld"), 1.2),
    (("kindergeld", "familienkasse", "kind"), ("formular", "merkblatt"), ("family", "kindergeld"), 1.2),
    (("widerspruch", "klage", "rechtsmittel", "bescheid", "ablehnung"), ("statute", "weisung", "guide"), ("application_process", "financial_support"), 1.3),
    (("erwerbsfähigkeit", "arbeitsunfähig", "krankheit", "reha"), ("weisung", "statute"), ("healthcare", "eligibility"), 1.25),
    (("nebeneinkommen", "hinzuverdienst", "freibetrag", "einkommen"), ("weisung", "merkblatt", "statute"), ("financial_support", "employment"), 1.25),
    (("wohngeld", "wohngeldantrag", "mietzuschuss"), ("formular", "merkblatt", "guide"), ("housing", "wohngeld"), 1.3),
    (("sozialhilfe", "sgb xii", "grundsicherung im alter", "hilfe zum lebensunterhalt"), ("statute", "merkblatt", "guide"), ("financial_support", "sozialhilfe"), 1.25),
    (("regelbedarf", "regelleistung", "grundsicherungsbetrag", "wie hoch bürgergeld", "bürgergeld höhe", "standard benefit", "regelleistung höhe"), ("statute", "merkblatt", "broschuere", "weisung"), ("buergergeld", "regelbedarf", "financial_support"), 1.4),
)

#: The words of each intent; the first intent with one of its words in a question counts.
INTENT_WORDS = {
    "eligibility": "eligible|qualify|can i get|can i receive|am i entitled|berechtigt|anspruch|bekomme ich|erhalte ich",
    "how_to": "how (?:do|can|to)|apply|application|process|steps|register|wie|beantragen|anmelden|verfahren|schritte",
    "comparison": "difference|compare|versus|vs|better|which one|unterschied|vergleich|besser",
    "temporal": "when|until when|deadline|expire|how long|duration|wann|bis wann|frist|ablauf|wie lange|dauer",
    "calculation": "how much|amount|calculate|payment|receive|wie viel|betrag|berechnen|zahlung|erhalte",
    "contact": "where|contact|office|phone|email|address|location|wo|kontakt|büro|telefon|adresse|standort",
    "definition": "what is|define|explain|meaning of|was ist|bedeutung|erklärung",
    "status": "status|state|progress|approved|denied|pending|stand|fortschritt|genehmigt|abgelehnt",
}
INTENTS = tuple((name, rf"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])") for name, words in INTENT_WORDS.items())

#: The words that a type of question has; the first type with one counts, else it is factual.
QUESTIONS = {
    "eligibility": ("kann ich", "darf ich", "habe ich anspruch", "berechtigt", "voraussetzung"),
    "howto": ("wie", "wo", "beantragen", "antrag", "welche dokumente", "schritte"),
    "factual": ("was ist", "wie viel", "wie hoch", "wann", "wer", "betrag", "höhe"),
    "comparison": ("unterschied", "vergleich", "besser", "oder", "versus", "vs"),
    "exploratory": ("welche", "alle", "gibt es", "übersicht", "möglichkeiten"),
}

#: Words that show a language.
GERMAN = ("der", "die", "das", "ich", "und", "ist", "für", "auf", "mit", "von")
ENGLISH = ("the", "is", "are", "and", "for", "with", "can", "how", "what")


def hits(c: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms a text has."""
    return sum((F.when(c.contains(t), 1).otherwise(0) for t in terms), F.lit(0))


def _folded(query: str) -> str:
    return query.lower().translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}))


def _test(test: str, columns: dict[str, Column]) -> Column:
    name, kind, term = re.fullmatch(r"(\w+)([:=$]) (.*)", test).groups()
    c = columns[name]
    return F.coalesce({":": lambda: F.contains(c, F.lit(term)), "=": lambda: c == term, "$": lambda: c.endswith(term)}[kind](), F.lit(False))


def _clause(tests: tuple[str, ...], columns: dict[str, Column]) -> Column:
    some = reduce(lambda a, b: a | b, (_test(t, columns) for t in tests if t != "not"))
    return ~some if tests[0] == "not" else some


def rule_points(query: str, columns: dict[str, Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """Points of an entry by the rules that a query meets; what the query has is settled before anything runs."""
    q, columns = _folded(query), {"raw": columns["text"]} | columns
    met = [r for r in rules if all(any(a in q for a in clause) for clause in r.asks) and not any(u in q for u in r.unless)]
    return sum((F.when(reduce(lambda a, b: a & b, (_clause(c, columns) for c in r.when)), float(r.points)).otherwise(0.0) for r in met), F.lit(0.0))


def place_points(query: str, columns: dict[str, Column]) -> Column:
    """Points for the place of an application: entries about its subject, and of those the ones where one can apply."""
    q = _folded(query)
    subject = [w for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*", q) if len(w) >= 4 and w not in QUESTION_WORDS and w not in ACTIONS]
    if not re.search(PLACE, q, re.ASCII):
        return F.lit(0.0)
    found = sum((_clause((f"title: {w}", f"url: {w}", f"text: {w}"), columns).cast("int") for w in subject), F.lit(0))
    starts = F.when(_clause(SURFACE, columns), 18.0 + 5.0 * found).otherwise(0.0) + F.when(_clause(("title: beantrag", "url: beantrag"), columns), 18.0).otherwise(0.0)
    return F.when(found > 0, starts).otherwise(F.lit(-18.0 if subject else 0.0))


@dataclass(frozen=True)
class Scenario:
    """What a scenario that fits the query says of entries: points by domain and term, guards, and the resources it needs."""

    domains: dict[str, float] = field(default_factory=dict)
    terms: dict[str, float] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    blocked: tuple[str, ...] = ()
    resources: tuple[str, ...] = ()
    guarded: bool = True  # whether entries that fail the guard lose points: of several scenarios only the selected one's do

    def points(self, columns: dict[str, Column]) -> list[Column]:
        plus = lambda tests, n: F.when(_clause(tests, columns), float(n)).otherwise(0.0)
        out = [plus((f"domain= {d}",), n) for d, n in self.domains.items()] + [plus((f"text: {t}",), n) for t, n in self.terms.items()]
        if self.guarded:
            out += [plus(("not", *(f"text: {t}" for t in self.required)), -16)] if self.required else []
            out += [plus(tuple(f"text: {t}" for t in self.blocked), -18)] if self.blocked else []
        out += [plus((f"title: {t}", f"url: {t}"), 4.5) for t in self.required]
        return out + [plus((f"title: {t}",), 2.75) + plus((f"raw: {t}",), 1.5) for t in self.resources]


def entry_score(query: str, tokens: list[str], strong: list[str], ordered: list[str], blocked: list[str], columns: dict[str, Column], weak: list[str] = (), scenarios: list[Scenario] = ()) -> Column:
    """An entry's score for a query: tokens, linked terms, the order of first answers, blocked terms, the rules, the place of an application, scenarios.

    Titles are folded and texts aren't when tokens are looked for; a score below 2 loses 3 more.  columns: title, text, url, domain.
    """
    url = F.regexp_replace(F.lower(F.trim(columns["url"])), "/+$", "")
    fields = {"title": fold_german(columns["title"]), "text": fold_german(columns["text"]), "raw": F.lower(columns["text"]), "url": url, "domain": columns["domain"]}
    q = _folded(query)
    plus = lambda n, *tests: F.when(_clause(tests, fields), float(n)).otherwise(0.0)
    either = lambda t: (f"title: {t}", f"text: {t}")
    parts = [plus(3, f"title: {t}") + plus(1.25, f"raw: {t}") for t in tokens]
    parts += [plus(8, f"title: {t}") + plus(4, f"text: {t}") for t in strong]
    parts += [plus(max(2, 10 - 2 * i), *either(t)) for i, t in enumerate(ordered)]
    parts += [plus(5, *either(t)) for t in weak if t in q]
    parts += [plus(-22, *either(t)) for t in blocked if t not in q]
    parts += [c for s in scenarios for c in s.points(fields)]
    score = sum(parts, F.lit(0.0)) + rule_points(query, fields) + place_points(query, fields)
    return let(score, lambda x: F.when(x < 2, x - 3).otherwise(x)) if tokens else score


#: The scenario that completed training counts against, unless more of it is asked for.
TRAINED, TRAINING, UPSKILLING = ("ausbildungbeendet", "ausbildungabgeschlossen", "nachausbildung"), ("weiterbildung", "umschulung", "bildungsgutschein", "qualifizierung"), "upskilling"


def matched_scenarios(df: DataFrame, text: str, scenarios: dict[str, tuple[str, ...]]) -> DataFrame:
    """``df`` without the text, a row for each scenario with a keyword in it: three points for each of several words, one and a half for the others."""
    rows = df.withColumn("_q", scenario_text(F.coalesce(F.col(text), F.lit(""))))
    compact = F.replace(F.col("_q"), F.lit(" "))

    def score(name: str, keywords: tuple[str, ...]) -> Column:
        each = [F.when(keyword_matches(F.col("_q"), k), 3.0 if len(k.split()) >= 2 else 1.5).otherwise(0.0) for k in keywords]
        total = sum(each, F.lit(0.0))
        drift = F.when(contains_any(compact, TRAINED) & ~contains_any(compact, TRAINING), 8.0).otherwise(0.0) if name == UPSKILLING else F.lit(0.0)
        return F.when(total > 0, F.struct(F.lit(name).alias("scenario"), (total - drift).alias("score")))

    found = F.array_compact(F.array(*[score(n, ks) for n, ks in scenarios.items()]))
    kept = [c for c in df.columns if c != text]
    return rows.select(*kept, F.explode(found).alias("_s")).select(*kept, "_s.scenario", "_s.score")


#: Points of a scenario's words in an entry, by list; of its domain, of official tiers and of organisations.
PACK_WORDS = {"keywords": 3.0, "expansions": 2.25, "documents": 2.0, "information": 1.5, "contacts": 1.5}
PACK_DOMAIN, PACK_OFFICIAL, PACK_ORGANISATION = 1.0, 0.75, 0.5


@dataclass(frozen=True)
class Pack:
    """What a scenario's pack of resources looks for."""

    keywords: tuple[str, ...] = ()
    expansions: tuple[str, ...] = ()
    documents: tuple[str, ...] = ()
    information: tuple[str, ...] = ()
    contacts: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()

    def score(self, blob: Column, domain: Column, tier: Column, institution: Column) -> Column:
        """How well an entry (its text in lower case) fits."""
        whether = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0.0)
        words = sum((n * hits(blob, getattr(self, name)) for name, n in PACK_WORDS.items()), F.lit(0.0))
        return words + whether(domain.isin(*self.domains), PACK_DOMAIN) + whether(tier.isin(*OFFICIAL), PACK_OFFICIAL) + whether((F.coalesce(institution, F.lit("")) == "ngo") | F.coalesce(tier, F.lit("")).isin(*ORGANISATIONS), PACK_ORGANISATION)


def eval_confidence(score: Column) -> Column:
    """A score as a share of thirty, a tenth at least and 0.95 at most."""
    return F.greatest(F.lit(0.1), F.least(F.lit(0.95), score / 30))


def topic_boost(query: str, doctype: Column, topics: Column, below: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Product of the factors whose keywords the query has and whose type or topics the chunk has, 2 at most.

    ``below`` has the topics under a topic; those count for it too.
    """
    q = query.lower()
    out = F.lit(1.0)
    for words, types, tops, factor in BOOSTS:
        if any(w in q for w in words):
            every = [*tops, *(x for t in tops for x in (below or {}).get(t, ()))]
            fits = F.coalesce(F.lower(doctype).isin(*types), F.lit(False)) | F.coalesce(F.arrays_overlap(topics, F.array(*map(F.lit, every))), F.lit(False))
            out = out * F.when(fits, factor).otherwise(1.0)
    return F.least(out, F.lit(2.0))


def intent(c: Column) -> Column:
    """The first intent whose pattern a question matches."""
    out = None
    for name, pattern in INTENTS:
        out = F.when(F.lower(c).rlike(pattern), name) if out is None else out.when(F.lower(c).rlike(pattern), name)
    return out.otherwise("general")


def spoken(c: Column) -> Column:
    """German or English by indicator words; umlauts count two for German."""
    words = F.split(F.lower(c), r"\s+")
    count = lambda ws: F.size(F.filter(words, lambda w: w.isin(*ws)))
    de, en = count(GERMAN) + F.when(c.rlike("[äöüßÄÖÜ]"), 2).otherwise(0), count(ENGLISH)
    return F.when(de > en, "de").when(en > de, "en").otherwise("unknown")


def answer_confidence(c: Column) -> Column:
    """high, medium or low by doubts, hedges, citations and length."""
    low = F.lower(c)
    doubt = contains_any(low, ("don't have enough information", "don't know", "not sure", "can't answer", "unclear"))
    hedges, cites, n = hits(low, ("might", "may", "possibly", "perhaps", "probably")), F.regexp_count(c, F.lit(r"\[\d+\]")), F.length(c)
    return F.when(doubt | (hedges >= 3) | (cites == 0) | (n < 100), "low").when((cites >= 3) & (hedges == 0) & (n > 200), "high").otherwise("medium")


def context_score(similarity: Column, query: list[str], title: Column, text: Column, years: Column) -> Column:
    """Similarity raised by terms in all the text and in the title, lowered by age, adjusted by length."""
    every = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(text))
    share = lambda c: hits(c, tuple(query)) / len(query)
    age = F.greatest(F.lit(0.5), 1 - years * 0.05)
    size = F.when(F.length(every) > 500, 1.05).when(F.length(every) < 100, 0.95).otherwise(1.0)
    return similarity * (1 + share(every) * 0.2) * (1 + share(F.lower(F.coalesce(title, F.lit("")))) * 0.3) * age * size
