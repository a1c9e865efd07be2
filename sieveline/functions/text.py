"""Text and URL expressions, all of them built-in column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track, and prefixes of such.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "mc_cid", "mc_eid")
TRACKING_PREFIXES = ("utm_",)
#: Words that don't count for token overlap.
STOPWORDS = ("der", "die", "das", "ein", "eine", "und", "oder", "mit", "von", "im", "in", "an", "auf", "zu", "ist", "es", "ich", "sie", "wir")
#: Damaged UTF-8 and what it stood for, a soft hyphen, and private characters of PDF fonts.
MOJIBAKE = (("Ã¤", "ä"), ("Ã¶", "ö"), ("Ã¼", "ü"), ("ÃŸ", "ß"), ("Ã„", "Ä"), ("Ã–", "Ö"), ("Ãœ", "Ü"), ("â€œ", "“"), ("â€\u009d", "”"), ("â€˜", "‘"), ("â€™", "’"), ("â€“", "–"), ("â€”", "—"),("­", ""), ("", "-"), ("", " "))


def first_text(*columns: str) -> Column:
    """The first column that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns])


def fold_german(c: Column) -> Column:
    """Lower case with umlauts and sharp s spelled out."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")), F.lower(c))


def repair(c: Column) -> Column:
    """Damaged umlauts and font characters replaced."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), MOJIBAKE, c)


def dehyphenate(c: Column) -> Column:
    """Words that a line break cut at a hyphen in one piece."""
    return F.regexp_replace(c, r"-\n([a-zäöüß])", "$1")


def collapse(c: Column) -> Column:
    """Runs of spaces as one, of three and more line breaks as two, no white space at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"), F.lit(" \t\n\x0b\f\r"))


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-case words of at least ``least`` characters, without stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: (F.length(x) >= least) & ~F.array_contains(stop, x)))


def overlap(query: Column, candidate: Column) -> Column:
    """Share of the query's tokens that the candidate has; 0 without any."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, candidate)) / F.size(query)).otherwise(0.0)


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(n)) for n in needles))


def sentences(c: Column) -> Column:
    """Sentences, cut after closing punctuation."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def host(url: Column) -> Column:
    """Host in lower case without www and port; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def under(host: Column, domain: Column) -> Column:
    """Whether a host is a domain or below it."""
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port, tracking parameters, fragment and closing slash gone, parameters
    sorted, dot segments resolved; null if it isn't an absolute URL.
    """
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?", k)
    scheme, name, port, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4), part(5)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(segments, F.array().cast("array<string>"), lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s))))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    wanted = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).isin(*TRACKING) & ~reduce(lambda a, b: a | b, (key(p).startswith(x) for x in TRACKING_PREFIXES)))
    asked = F.array_join(F.array_sort(wanted), "&")
    return F.when(name != "", F.concat(scheme, F.lit("://"), name, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.lit("/"), F.array_join(walked, "/"), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def plain_url(url: Column) -> Column:
    """The whole URL in lower case without closing slashes."""
    return F.regexp_replace(F.lower(F.trim(url)), "/+$", "")


def bare_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def one_slash(url: Column) -> Column:
    """Without one closing slash."""
    return F.regexp_replace(F.trim(url), "/$", "")


def path_parts(url: Column) -> Column:
    """The parts of a URL's path."""
    return F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")


def slug_title(url: Column) -> Column:
    """A title from the last part of a URL's path."""
    return F.initcap(F.regexp_replace(F.regexp_replace(F.try_element_at(path_parts(url), F.lit(-1)), r"\.[a-z]+$", ""), "[-_]+", " "))
