"""Predicates and filters over entries; a condition whose argument isn't given is left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import contains_any, under
from sieveline.operators.ranking import first_of

#: Parts of a URL and words of a title that mark pages without substance.
LOW_SIGNAL_URL = ("/presse", "/mediathek", "/sitzungen", "/bundeskabinett", "/overview", "/uebersicht", "/lageplan", "/anreise", "/besucherdienst", "/veranstaltungen", "/events", "/impressum", "/datenschutz", "/leichte-sprache", "/meta/leichte-sprache", "/meta/languages", "/breg-de")
LOW_SIGNAL_TITLE = ("was wir tun", "pressebereich", "lageplan", "anreiseinformationen", "kommende veranstaltungen", "veranstaltungen auf einen blick", "übersicht der internetseite", "uebersicht der internetseite", "bundeskabinett", "leichte sprache", "einfach-sprache aktiv", "digitale angebote", "herzlich willkommen", "informationen fuer gefluechtete aus der ukraine")
#: What stops a candidate's promotion, in its title, URL and content, everywhere and by domain.
GATE_TITLE = ("datenschutz", "cookie", "impressum", "hauptnavigation", "navigation", "startseite", "home")
GATE_URL = ("/datenschutz", "/impressum", "/privacy", "/cookie", "/dynamic/action/", "!zip-search", "/search", "/tag/", "/author/")
GATE_CONTENT = ("mit der einwilligung von nutzenden", "webverhalten- analysetool", "webverhalten-analysetool", "webverhalten analysetool", "matomo", "einwilligen ablehnen")
GATE_DOMAIN_TITLE = {
    "aid": ("aktuell", "alle meldungen", "presse", "pressemitteilungen", "reden und interviews", "rss-service", "erklärung zur barrierefreiheit", "rechtliche hinweise", "deutsche gebärdensprache", "leichte sprache", "inhalt"),
    "tools": ("newsletter", "kontakt", "service", "warenkorb", "porträts", "portraets", "downloads", "aktuelles", "presse"),
    "organizations": ("lebenslauf", "gesetz", "vol.", "@"),
    "contacts": ("aktuelles", "pressemitteilungen", "innovation"),
}
GATE_DOMAIN_URL = {
    "aid": ("/aktuelles", "/mediathek", "/meta/", "/erklaerung-zur-barrierefreiheit", "/informationen-zur-verarbeitung-personenbezogener-daten", "/gebaerdensprache", "/leichte-sprache", "/rechtliche-hinweise", "/downloads"),
    "tools": ("/newsletter", "/warenkorb", "/service/kontakt", "/service/portraets", "/service/publikationen"),
    "organizations": ("social.bund.de", "tiktok.com", "/issue/", "/ministerium/gesetze", "/ministerium/ministerin-hausleitung", "/bmbfsfj-als-arbeitgeber"),
    "contacts": ("/news", "/presse", "/downloads", "/mediathek", "/fuer-behoerden", "/social.", "/social.bund.de"),
}


def every(*conditions: Column | None) -> Column:
    """All conditions that are given; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def some(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def equal_filters(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns have the wanted values; null counts as empty."""
    return df.where(every(*[F.coalesce(F.col(c), F.lit("")) == v for c, v in wanted.items() if v is not None]))


def text_search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows one of whose columns has the term, in any case; % and _ in it are wildcards."""
    return df.where(some([F.col(c).ilike(f"%{term}%") for c in columns]))


def terms_search(df: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    """Rows with any of the terms, and how many of them (``term_score``)."""
    hit = [some([F.col(c).ilike(f"%{t}%") for c in columns]) for t in terms]
    score = sum((F.when(F.coalesce(h, F.lit(False)), 1).otherwise(0) for h in hit), F.lit(0))
    return df.withColumn("term_score", score).where("term_score > 0")


def or_all(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition, or all of them if none does."""
    met = df.withColumn("_met", F.coalesce(condition, F.lit(False)))
    any_met = met.agg(F.coalesce(F.max("_met"), F.lit(False)).alias("_any"))
    return met.join(F.broadcast(any_met)).where("_met or not _any").drop("_met", "_any")


def or_first(df: DataFrame, condition: Column, group: str, order: str, n: int = 2) -> DataFrame:
    """In each group the rows that meet the condition, or its first ``n`` if none does."""
    met = F.coalesce(condition, F.lit(False))
    none = df.groupBy(F.col(group).alias("_group")).agg(F.max(met).alias("_any")).where("not _any").select("_group")
    # Which groups have none is a row for each; of those the first few are cut before their rows move.
    rest = df.join(none, F.col(group).eqNullSafe(F.col("_group")), "left_semi")
    return df.where(met).unionByName(first_of(rest, [group], [order], n))


def low_quality(df: DataFrame, bound: float = 50, unscored: bool = False) -> DataFrame:
    """Rows with a score below the bound; without scores only if ``unscored`` says to count them as 0."""
    of = (lambda c: F.coalesce(F.col(c), F.lit(0.0))) if unscored else F.col
    return df.where((of("iqs") < bound) | (of("ais") < bound))


def low_signal(url: Column, title: Column) -> Column:
    """Pages without substance by words in URL or title, or with neither."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    return some([F.contains(u, F.lit(w)) for w in LOW_SIGNAL_URL]) | some([F.contains(t, F.lit(w)) for w in LOW_SIGNAL_TITLE]) | ((u == "") & (t == ""))


def first_reason(rules: list[tuple[str, Column]], accepted: str = "accepted") -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise(accepted)


def candidate_gate(df: DataFrame, iqs: float = 75.0, ais: float = 70.0, least: int = 140, most: int = 500_000, title_most: int = 500) -> Column:
    """Why an entry isn't promoted, or ``accepted``: the first of twelve reasons that holds."""
    lowered = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    title, url, summary, content = lowered("title_de"), lowered("url"), lowered("summary_de"), lowered("content_de")
    holds = lambda text, words: some([F.contains(text, F.lit(w)) for w in words])
    of_domain = lambda text, table: some([(F.col("domain") == d) & holds(text, words) for d, words in table.items()])
    return first_reason(
        [
            ("oversized_title", F.length(title) > title_most),
            ("oversized_content", F.length(F.trim(content)) > most),
            ("low_signal_title", (title == "") | holds(title, GATE_TITLE)),
            ("domain_low_signal_title", of_domain(title, GATE_DOMAIN_TITLE)),
            ("low_signal_url", holds(url, GATE_URL)),
            ("domain_low_signal_url", of_domain(url, GATE_DOMAIN_URL)),
            ("low_signal_content", holds(summary, GATE_CONTENT) | holds(content, GATE_CONTENT)),
            ("unknown_source_tier", F.coalesce("tier", F.lit("")).isin("", "tier_unknown")),
            ("thin_content", F.length(F.trim(content)) < least),
            ("summary_equals_title", (summary != "") & (summary == title)),
            ("iqs_below_threshold", F.coalesce("iqs", F.lit(0.0)) < iqs),
            ("ais_below_threshold", F.coalesce("ais", F.lit(0.0)) < ais),
        ]
    )


#: Marks of files, and how many characters that don't belong in a text make it one.
FILE_MARKS, STRAY = ("%PDF-", " endstream ", " startxref ", "/FlateDecode"), 8
#: By domain, URLs that don't belong there, and why; the first that fits counts.
PRUNED = {
    "organizations": (("bmas_topic_page", r"(?i)^https://www\.bmas\.de/DE/(Arbeit|Soziales|Europa-und-die-Welt)/"), ("bmbfsfj_theme_media_meta", r"(?i)^https://www\.bmbfsfj\.bund\.de/bmbfsfj/(themen|mediathek|meta)/")),
    "aid": (("bmbfsfj_root_page", r"(?i)^https://www\.bmbfsfj\.bund\.de/bmbfsfj/?$"), ("bmbfsfj_theme_root", r"(?i)^https://www\.bmbfsfj\.bund\.de/bmbfsfj/themen/[^/]+/?$")),
}
#: What entries about cookies have in summary or content, and in their URL.
COOKIE_WORDS = ("mit der einwilligung von nutzenden", "webverhalten- analysetool", "webverhalten-analysetool", "webverhalten analysetool", "matomo", "einwilligen ablehnen")
COOKIE_URLS = ("/dynamic/action/", "!zip-search")


def binary_text(c: Column) -> Column:
    """Whether a text is a file's bytes, by its first 4000 characters: a mark of a file, or eight replacement or eight control characters."""
    head = F.substring(c, 1, 4000)
    many = lambda kind: F.regexp_count(head, F.lit(kind)) >= STRAY
    return contains_any(head, FILE_MARKS) | many("\ufffd") | many(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def prune_reason(domain: Column, url: Column) -> Column:
    """Why an entry is pruned from its domain, or ``kept``."""
    return first_reason([(name, (domain == d) & F.coalesce(url, F.lit("")).rlike(pattern)) for d, rules in PRUNED.items() for name, pattern in rules], "kept")


def cookie_entry(url: Column, summary: Column, content: Column) -> Column:
    """Whether an entry is about cookies."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return contains_any(low(summary), COOKIE_WORDS) | contains_any(low(content), COOKIE_WORDS) | contains_any(low(url), COOKIE_URLS)
