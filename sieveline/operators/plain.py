"""Plain language by rules: two levels of it for a text, records that fill what translations lack, and answers to read.

``einfach`` keeps sentences and puts plain words for hard ones; ``leicht`` makes short lines.  Both explain the hard words that
the text has.  ``easy_german`` is the shorter draft for translations.

Edge cases: null and blank texts give an empty text, or only the title's line; a record is filled in where there is none with a
body.  Limits on sentences and lines are the feature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.cleaning import let

#: Hard words (as patterns), what stands for them, and what they mean.
GLOSSARY = (
    ("bedarfsgemeinschaft", "Familie oder Menschen, die zusammen leben", "Das sind Menschen, die zusammen leben und gemeinsam Geld zum Leben brauchen."),
    ("hilfebed[üu]rftig", "auf Hilfe angewiesen", "Das bedeutet: Das Geld reicht nicht zum Leben."),
    ("erwerbsf[äa]hig", "arbeitsfähig", "Das bedeutet: Sie können arbeiten."),
    ("existenzminimum", "das Geld, das man mindestens zum Leben braucht", None),
    ("lebensmittelpunkt", "der Ort, an dem Sie vor allem leben", None),
    ("lebensunterhalt", "das tägliche Leben", None),
    ("jobcenter", "Jobcenter", "Das Jobcenter ist die Stelle für Bürgergeld."),
    ("b[üu]rgergeld", "Bürger-Geld", "Das ist Geld für Menschen mit wenig oder keinem Einkommen."),
    ("arbeitslosengeld", "Arbeitslosen-Geld", "Das ist Geld für Menschen ohne Arbeit."),
    ("kinderzuschlag", "Kinder-Zuschlag", "Das ist extra Geld für Familien mit wenig Einkommen."),
    ("unterhaltsvorschuss", "Unterhalts-Vorschuss", "Das ist Geld für Kinder, wenn Unterhalt fehlt."),
)
#: Phrases and their plainer form, after the words above.
PHRASES = (("Sie oder Mitglieder Ihrer Familie", "Sie oder Ihre Familie"), ("Sie oder Mitglieder Ihrer Bedarfsgemeinschaft", "Sie oder Ihre Familie"), ("keine Krankheit oder Behinderung hindert Sie daran", "keine Krankheit oder Behinderung hält Sie davon ab"), ("Voraussetzungen", "Bedingungen"), ("beantragen", "anfragen oder beantragen"))
SENTENCES, LINES, DEFINITIONS = {"einfach": 6, "leicht": 5}, 14, {"einfach": 2, "leicht": 4}
#: Names of the records, who made them, and how many lines their summary has.
GENERATOR = "sieveline-plain-language-v1"
REVIEWED, SUGGESTED = {"einfach": "de-EINFACH", "leicht": "de-LEICHT"}, {"einfach": "de-EINFACH-SUGGESTED", "leicht": "de-LEICHT-SUGGESTED"}
SUMMARY = {"einfach": 2, "leicht": 4}
#: The frame of an answer to read.
LEICHT_FRAME = ("Das ist jetzt wichtig:", "Prüfen Sie die passenden Stellen in den Quellen unten.")
EINFACH_FRAME = ("Das passt zu Ihrer Situation.", "", "Als naechster Schritt gilt: ", "Zusaetzlich ist wichtig: ", "Unten finden Sie die passenden Quellen und Anlaufstellen.")
#: For drafts, connectors that become the end of a sentence, words and simpler ones, and the most characters.
CONNECTORS = ("obwohl", "während", "da", "weil", "damit", "sodass", "indem")
SIMPLER = (("Voraussetzung", "Bedingung"), ("beantragen", "anfragen"), ("zuständig", "verantwortlich"), ("einreichen", "abgeben"))
DRAFT_MOST = 2000

RECORD = "struct<title: string, summary: string, body: string, source: string, crawled_at: string, method: string, generator: string, timestamp: string, reviewed: boolean, variant: string, review_status: string>"


def _word(pattern: str) -> str:
    return rf"(?iu)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def spaced(c: Column) -> Column:
    """One space between words, none at the ends; null as empty."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, spaced), lambda x: x != "")


def parts(text: Column) -> Column:
    """Sentences, and what colons, semicolons and bars set apart."""
    return _filled(F.split(spaced(text), r"(?<=[:;.!?])\s+|\|"))


def plainer(sentence: Column) -> Column:
    """A sentence with plain words for hard ones."""
    swaps = [(p, plain) for p, plain, _ in GLOSSARY] + list(PHRASES)
    return spaced(reduce(lambda c, s: F.regexp_replace(c, _word(s[0]), s[1]), swaps, sentence))


def meanings(text: Column, mode: str) -> Column:
    """What the hard words of a text mean: a line for each, or for ``leicht`` two."""
    told = []
    for pattern, plain, meaning in GLOSSARY:
        if meaning:
            lines = [f"{plain} bedeutet:", meaning] if mode == "leicht" else [f"{plain} bedeutet: {meaning}"]
            told.append(F.when(F.coalesce(text, F.lit("")).rlike(_word(pattern)), F.array(*map(F.lit, lines))))
    return F.slice(F.array_distinct(F.flatten(F.array_compact(F.array(*told)))), 1, DEFINITIONS[mode])


def einfach(title: Column, text: Column) -> Column:
    """Title, six sentences in plain words, and two meanings, as one paragraph."""
    head = F.when(spaced(title) != "", F.concat(title, F.lit("."))).otherwise("")
    body = F.array_join(_filled(F.transform(F.slice(parts(text), 1, SENTENCES["einfach"]), plainer)), " ")
    tail = let(meanings(text, "einfach"), lambda m: F.when(F.size(m) > 0, F.concat(F.lit("Wichtige Begriffe: "), F.array_join(m, " "))).otherwise(""))
    return F.array_join(_filled(F.array(head, body, tail)), " ")


def leicht(title: Column, text: Column) -> Column:
    """Title, five sentences in lines that end at each period, comma and ``und``, and two meanings; fourteen lines."""
    short = lambda s: F.split(F.regexp_replace(F.regexp_replace(plainer(s), _word("und"), "."), r",\s*", ". "), r"\.")
    lines = F.flatten(F.transform(F.slice(parts(text), 1, SENTENCES["leicht"]), short))
    return F.array_join(F.slice(_filled(F.concat(F.array(F.coalesce(title, F.lit(""))), lines, meanings(text, "leicht"))), 1, LINES), "\n")


BUILDERS = {"einfach": einfach, "leicht": leicht}


def filled_translations(translations: Column, title: Column, text: Column, source: Column, crawled_at: Column, now: Column) -> Column:
    """Translations (a map of ``RECORD``) with a suggestion for each level that has none with a body; the others stay."""
    old = F.coalesce(translations, F.create_map().cast(f"map<string, {RECORD}>"))
    named = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Eintrag"))

    def record(mode: str) -> Column:
        body = BUILDERS[mode](named, text)
        return let(body, lambda b: F.struct(
            named.alias("title"), F.trim(F.array_join(F.slice(F.split(b, "\n"), 1, SUMMARY[mode]), " ")).alias("summary"), b.alias("body"), source.alias("source"), F.coalesce(crawled_at, now).alias("crawled_at"),
            F.lit("rule").alias("method"), F.lit(GENERATOR).alias("generator"), now.alias("timestamp"), F.lit(False).alias("reviewed"), F.lit(mode).alias("variant"), F.lit("suggested").alias("review_status"),
        ))

    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.try_element_at(old, F.lit(key))["body"], F.lit("")) == "", F.struct(F.lit(key).alias("key"), record(mode).alias("value"))) for mode, key in SUGGESTED.items()]))
    return let(lacking, lambda new: F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.transform(new, lambda n: n["key"]), k)), F.map_from_entries(new)))


def readable(translations: Column, mode: str, field: str = "body") -> Column:
    """The body (or summary) to read at a level: the reviewed one, else the suggestion, else empty."""
    of = lambda key: F.nullif(F.try_element_at(translations, F.lit(key))[field], F.lit(""))
    return F.coalesce(of(REVIEWED[mode]), of(SUGGESTED[mode]), F.lit(""))


def grounded_answer(texts: Column, mode: str) -> Column:
    """An answer from the first sentences of up to three readable texts, in a frame; empty without any."""
    first = lambda t: F.coalesce(F.get(parts(t), F.lit(0)), F.lit(""))
    found = F.filter(F.transform(F.slice(texts, 1, 3), first), lambda s: s != "")
    if mode == "leicht":
        told = lambda f: F.array_join(F.concat(F.array(F.lit(LEICHT_FRAME[0])), f, F.array(F.lit(LEICHT_FRAME[1]))), "\n")
    else:
        told = lambda f: F.array_join(_filled(F.array(F.lit(EINFACH_FRAME[0]), *[F.coalesce(F.concat(F.lit(EINFACH_FRAME[i + 1]), F.get(f, F.lit(i))), F.lit("")) for i in range(3)], F.lit(EINFACH_FRAME[4]))), " ")
    return let(found, lambda f: F.when(F.size(f) > 0, told(f)).otherwise(""))


#: What an audit of each level takes off, and for unexplained words in all.
AUDITS = {"einfach": (("long_sentences", 18), ("long_text", 8), ("colons", 6)), "leicht": (("long_sentences", 24), ("commas", 10), ("nothing_explained", 10))}
WORDS_MOST, TEXT_MOST, JARGON, JARGON_MOST = {"einfach": 16, "leicht": 10}, 8, 5, 20


def audit(text: Column, mode: str) -> Column:
    """How plain a text is for a level: a score from 0 to 100, and what was found; 0 and ``no_text`` for a blank one."""
    whole = spaced(text)
    sentences = parts(text)
    count = F.size(sentences)
    words = F.aggregate(sentences, F.lit(0), lambda n, s: n + F.size(F.split(s, r"\s+"))) / F.greatest(count, F.lit(1))
    holds = {"long_sentences": words > WORDS_MOST[mode], "long_text": count > TEXT_MOST, "colons": whole.rlike("[;:]"), "commas": F.contains(whole, F.lit(", ")), "nothing_explained": ~F.contains(whole, F.lit("bedeutet"))}
    hard = [F.when(whole.rlike(_word(pattern)) & ~F.contains(whole, F.lit(f"{plain} bedeutet")) & ~F.contains(whole, F.lit(meaning)), F.lit(plain)) for pattern, plain, meaning in GLOSSARY if meaning]
    points = sum((F.when(holds[name], n).otherwise(0) for name, n in AUDITS[mode]), F.lit(0))

    def told(jargon: Column) -> Column:
        found = F.concat(F.array_compact(F.array(*[F.when(holds[name], name) for name, _ in AUDITS[mode]])), F.when(F.size(jargon) > 0, F.array(F.concat(F.lit("unexplained: "), F.array_join(jargon, ", ")))).otherwise(F.array().cast("array<string>")))
        score = F.greatest(F.lit(0), F.lit(100) - points - F.least(F.lit(JARGON_MOST), JARGON * F.size(jargon)))
        return F.struct(F.when(whole == "", 0).otherwise(score).cast("long").alias("score"), F.when(whole == "", F.array(F.lit("no_text"))).otherwise(found).alias("findings"))

    return let(F.array_compact(F.array(*hard)), told)


def easy_german(text: Column) -> Column:
    """A draft in short sentences and simpler words, cut at a word after DRAFT_MOST characters; empty for null and blank texts."""
    sentences = _filled(F.split(spaced(text), r"(?<=[.!?])\s+"))

    def simple(s: Column) -> Column:
        cut = F.regexp_replace(s, rf"(?iU)(?<!\w)(?:{'|'.join(CONNECTORS)})(?!\w)", ".")
        pieces = F.filter(F.transform(F.split(cut, ","), lambda p: F.trim(p)), lambda p: p != "")
        apart = F.when(F.size(pieces) > 2, F.array_join(pieces, ". ")).otherwise(cut)
        words = reduce(lambda c, w: F.regexp_replace(c, rf"(?U)(?<!\w){w[0]}(?!\w)", w[1]), SIMPLER, apart)
        return let(words, lambda x: F.when(x.rlike("[.!?]$"), x).otherwise(F.concat(x, F.lit("."))))

    whole = F.array_join(F.transform(sentences, simple), " ")
    return let(whole, lambda w: F.when(F.length(w) > DRAFT_MOST, F.concat(F.regexp_replace(F.substring(w, 1, DRAFT_MOST), r" [^ ]*$", ""), F.lit("..."))).otherwise(w))


def translation_pilot(entries: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """The first ``most`` entries by domain and id (the feature) with a draft of their text as a translation, and the item that puts it to review.

    entries: id, domain, title, url, content, summary.  outcome is ``translated``, or ``error`` for an entry without any text.
    """
    text = F.coalesce(F.nullif(spaced(F.col("content")), F.lit("")), F.nullif(spaced(F.col("summary")), F.lit("")))
    some = F.col("_text").isNotNull()
    record = F.struct(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), easy_german(F.col("_text")).alias("body"), F.coalesce("url", F.lit("")).alias("source"), now.alias("crawled_at"),
        F.lit("rule").alias("method"), F.lit(GENERATOR).alias("generator"), now.alias("timestamp"), F.lit(False).alias("reviewed"), F.lit("leicht").alias("variant"), F.lit("suggested").alias("review_status"),
    )
    chosen = entries.orderBy("domain", "id").limit(most).withColumn("_text", text)
    return chosen.select("id", "domain", F.when(some, "translated").otherwise("error").alias("outcome"), F.when(some, record).alias("translation"), F.when(some, "update").alias("action"), F.when(some, "pending").alias("status"), F.when(some, F.array(F.lit("Added translation: de-LEICHT"))).alias("important_changes"))
