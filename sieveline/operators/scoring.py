"""Scores of entries and chunks, as column arithmetic; the date that ages count from is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.text import overlap, tokens

#: Weights of trust levels, knowledge layers and document types.
TRUST = {"tier_1_law": 1.8, "tier_2_official": 1.5, "tier_3_ngo": 1.0, "tier_4_other": 0.7}
LAYER = {"law": 1.6, "official_guidance": 1.4, "administrative_practice": 1.2, "case_law": 1.1, "ngo_guidance": 0.9, "unknown": 0.7}
DOCTYPE = {"statute": 1.4, "merkblatt": 1.5, "weisung": 1.4, "broschuere": 1.1, "formular": 1.0, "faq": 1.0, "guide": 0.9, "website": 0.8, "other": 0.7}


def lookup(table: dict[str, float], c: Column, default: float) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default))


def source_weight(trust: Column, doctype: Column) -> Column:
    return F.round(lookup(TRUST, trust, 1.0) * lookup(DOCTYPE, doctype, 1.0), 3)


def length_factor(text: Column) -> Column:
    n = F.length(F.trim(text))
    return F.when(n < 60, 0.72).when(n < 140, 0.88).otherwise(1.0)


def rerank(raw: Column, stored: Column, trust: Column, layer: Column, query: str, title: Column, text: Column) -> Column:
    """Raw score by source weight and length, plus what the query shares with title and text."""
    asked = tokens(F.lit(query))
    weight = F.when(stored > 0, stored).otherwise(lookup(TRUST, trust, 1.0) * lookup(LAYER, layer, 0.7) / 2)
    # What is asked are tokens already, so any word of title and text that is among them is one.
    words = lambda c: F.split(F.lower(c), r"\s+")
    return raw * weight * length_factor(text) + 0.35 * overlap(asked, words(title)) + 0.15 * overlap(asked, words(text))


def freshness(last_seen: Column, now: Column) -> Column:
    """Steps by whole days of 24 hours; 50 if unknown."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(last_seen)) / 86400)
    return F.when(last_seen.isNull(), 50.0).when(days <= 7, 100.0).when(days <= 30, 90.0).when(days <= 90, 75.0).when(days <= 180, 60.0).when(days <= 365, 40.0).otherwise(20.0)


def share(*present: Column) -> Column:
    """Share of conditions that hold."""
    return sum((F.when(F.coalesce(p, F.lit(False)), 1).otherwise(0) for p in present), F.lit(0)) / len(present)


def has(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def information_quality(now: Column) -> Column:
    """Completeness, freshness, provenance and languages of an entry, 0 to 100."""
    filled = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    required = share(F.col("id").isNotNull(), has("title_de"), has("url"), has("status"), has("source"))
    wanted = share(has("summary_de"), has("content_de"), filled("topics"), filled("tags"), F.lit(False))
    languages = share(has("title_de"), has("title_en"), has("title_easy_de"), has("summary_de"), has("summary_en"), F.lit(False), has("content_de"), F.lit(False), F.lit(False))
    return F.round((required * 70 + wanted * 30) * 0.4 + freshness(F.col("last_seen"), now) * 0.3 + F.when(has("source"), 25.0).otherwise(0.0) * 0.15 + languages * 100 * 0.15, 2)


def searchability() -> Column:
    """Structure, metadata, text and languages of an entry, 0 to 100."""
    points = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    filled = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    structure = points(has("title_de") | has("title_en") | has("title_easy_de"), 30) + points(has("summary_de") | has("summary_en"), 25) + points(has("content_de"), 25)
    metadata = points(filled("topics"), 35) + points(filled("tags"), 30)
    n, s = F.length(F.coalesce("content_de", F.lit(""))), F.length(F.coalesce("summary_de", F.lit("")))
    quality = F.when(n >= 200, 50.0).when(n >= 100, 30.0).when(n >= 50, 15.0).otherwise(0.0) + F.when(s >= 50, 50.0).when(s > 0, 25.0).otherwise(0.0)
    langs = F.when(has("title_de") | has("summary_de") | has("content_de"), 1).otherwise(0) + F.when(has("title_en") | has("summary_en"), 1).otherwise(0) + F.when(has("title_easy_de"), 1).otherwise(0)
    spoken = F.when(langs == 3, 100.0).when(langs == 2, 70.0).when(langs == 1, 40.0).otherwise(0.0)
    return F.round(structure * 0.35 + metadata * 0.3 + quality * 0.2 + spoken * 0.15, 2)


def confidence_bucket(score: Column) -> Column:
    return F.when(score >= 12, 0.92).when(score >= 9, 0.86).when(score >= 6, 0.79).when(score >= 4, 0.72).otherwise(0.55)


def recency(score: Column, age_days: Column) -> Column:
    """Up to a tenth less over a year; older rows as they are."""
    return F.when((age_days >= 0) & (age_days < 365), score * (1 - age_days / 365 * 0.1)).otherwise(score)


def readability(words_per_sentence: Column) -> tuple[Column, Column]:
    """(level, complexity) by words in a sentence."""
    w = words_per_sentence
    return F.when(w <= 8, "A1").when(w <= 12, "A2").when(w <= 16, "B1").when(w <= 20, "B2").otherwise("C1"), F.when(w <= 12, "simple").when(w <= 20, "moderate").otherwise("complex")


#: How much a source's tier weighs.
TIER_RANK = {"tier_1_law": 4, "tier_1_official": 4, "tier_2_official": 3, "tier_2_ngo_watchdog": 2, "tier_3_ngo": 2, "tier_3_press": 1, "tier_4_academic": 1, "tier_4_other": 0, "tier_5_contextual": 0, "tier_5_partisan_context": 0}


def tier_rank(tier: Column) -> Column:
    """The rank of a tier in any case; -1 for others and null."""
    t = F.lower(F.trim(F.coalesce(tier, F.lit(""))))
    return F.coalesce(*[F.when(t == name, rank) for name, rank in TIER_RANK.items()], F.lit(-1))
