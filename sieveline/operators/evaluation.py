"""Checks of retrieval and answers against stated cases, and which evidence a policy lets through.

A case states only some expectations; checks are made for those, and ``passed`` is whether all that are made hold.

Edge cases: null and empty lists state nothing.  Null texts are empty.  Results and sources that are missing are none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.text import fold_german
from sieveline.operators.scoring import tier_rank

CHECK = "array<struct<id: string, pass: boolean>>"
#: Confidence of external evidence that states none, and how many items of a payload count.
DEFAULT_CONFIDENCE, PAYLOAD_MOST = 0.6, 12


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _made(checks: list[tuple[str, Column, Column]]) -> Column:
    """The checks that are due: (name, whether it is, whether it holds)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(due, F.lit(False)), F.struct(F.lit(name).alias("id"), F.coalesce(holds, F.lit(False)).alias("pass"))) for name, due, holds in checks]))


def passed(checks: Column) -> Column:
    return F.forall(checks, lambda c: c["pass"])


def retrieval_checks(case: dict[str, Column], stages: Column, results: Column, top: int = 8) -> Column:
    """Seven kinds of checks of a query's first ``top`` results (title, url, domain), in order, and of the stages that were inferred.

    case: expected_life_event, required_domains_all, required_domains_any, expected_terms_any, expected_terms_top1, blocked_terms_any,
    contact_keywords_any; any of them may be left out.
    """
    none = F.lit(None).cast("array<string>")
    first = F.slice(F.coalesce(results, F.array().cast("array<struct<title: string, url: string, domain: string>>")), 1, top)
    said = lambda r: F.concat(F.coalesce(r["title"], F.lit("")), F.lit(" "), F.coalesce(r["url"], F.lit("")))
    text = lambda rows: F.lower(F.array_join(F.transform(rows, said), " "))
    domains = F.transform(first, lambda r: F.coalesce(r["domain"], F.lit("")))
    corpus, best = text(first), F.coalesce(F.lower(said(F.get(first, F.lit(0)))), F.lit(""))
    contacts = text(F.filter(first, lambda r: r["domain"] == "contacts"))
    any_in = lambda words, c: F.exists(_list(words), lambda w: F.contains(c, F.lower(w)))
    stated = lambda n: F.size(_list(case.get(n, none))) > 0
    event = F.trim(F.coalesce(case.get("expected_life_event", F.lit("")), F.lit("")))
    return _made([
        ("life_event", event != "", F.array_contains(_list(stages), event)),
        ("required_domains_all", stated("required_domains_all"), F.size(F.array_except(_list(case.get("required_domains_all", none)), domains)) == 0),
        ("required_domains_any", stated("required_domains_any"), F.arrays_overlap(_list(case.get("required_domains_any", none)), domains)),
        ("expected_terms_any", stated("expected_terms_any"), any_in(case.get("expected_terms_any", none), corpus)),
        ("expected_terms_top1", stated("expected_terms_top1"), any_in(case.get("expected_terms_top1", none), best)),
        ("blocked_terms_absent", stated("blocked_terms_any"), ~any_in(case.get("blocked_terms_any", none), corpus)),
        ("contact_keywords_any", stated("contact_keywords_any"), any_in(case.get("contact_keywords_any", none), contacts)),
    ])


def answer_checks(case: dict[str, Column], answer: Column, sources: Column, cited: Column, unsupported: Column, specific: Column) -> Column:
    """Seven kinds of checks of an answer: five that a case may state, and always that nothing is unsupported and that it speaks to the question.

    case: must_mention_any, must_mention_all, required_sources_any, must_not_mention, min_cited_sources.  Umlauts count as spelled out.
    """
    none = F.lit(None).cast("array<string>")
    text = fold_german(F.coalesce(answer, F.lit("")))
    with_sources = fold_german(F.concat(F.coalesce(answer, F.lit("")), F.lit("\n"), F.array_join(_list(sources), " ")))
    of = lambda n: _list(case.get(n, none))
    some = lambda n, c: F.exists(of(n), lambda w: F.contains(c, fold_german(w)))
    least = F.coalesce(case.get("min_cited_sources", F.lit(0)), F.lit(0))
    return _made([
        ("must_mention_any", F.size(of("must_mention_any")) > 0, some("must_mention_any", text)),
        ("must_mention_all", F.size(of("must_mention_all")) > 0, F.forall(of("must_mention_all"), lambda w: F.contains(text, fold_german(w)))),
        ("required_sources_any", F.size(of("required_sources_any")) > 0, some("required_sources_any", with_sources)),
        ("must_not_mention", F.size(of("must_not_mention")) > 0, ~some("must_not_mention", text)),
        ("min_cited_sources", least > 0, F.coalesce(cited, F.lit(0)) >= least),
        ("unsupported_claims", F.lit(True), F.coalesce(unsupported, F.lit(0)) == 0),
        ("query_specificity", F.lit(True), F.coalesce(specific, F.lit(True))),
    ])


def policy_drop(tier: Column, role: Column, confidence: Column, min_confidence: float = 0.0, min_tier: str | None = None, strict_official: bool = False) -> Column:
    """Why a policy drops evidence: its source isn't classified, it isn't sure enough, its tier is too low, or it isn't official; null if it stays."""
    rank = tier_rank(tier)
    rules = [F.when(rank < 0, "unclassified"), F.when(F.coalesce(confidence, F.lit(0.0)) < max(0.0, min(1.0, min_confidence)), "confidence")]
    if min_tier:
        rules.append(F.when(rank < tier_rank(F.lit(min_tier)), "tier"))
    if strict_official:
        rules.append(F.when(F.coalesce(role, F.lit("")) != "official_info", "unofficial"))
    return F.coalesce(*rules)


def external_confidence(c: Column) -> Column:
    """The confidence of external evidence: as stated from 0 to 1, a default where it isn't a number."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), DEFAULT_CONFIDENCE).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
