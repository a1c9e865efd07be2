"""Secret scans: a trigram inverted index narrows what each rule's regular expression has to look at.

1. Each rule's expression is read as a sequence of what must stand in a match: single letters, small classes, optional
   parts, alternatives.  Neighbouring ones are multiplied out to strings while those are few, and the strings' trigrams
   give a Boolean query: ``password|token`` asks for (pas and ass and ... ) or (tok and oke and ken).
2. The index has a row (trigram, document) for each trigram that some rule asks for and that the document's text has, in
   lower case: postings in a long form, so no list of a common trigram is ever in one place.
3. Postings are intersected by document, and each rule's query is evaluated on what meets there.  The documents for which
   it holds are the rule's candidates.  A rule without mandatory trigrams takes every document.
4. Candidates are verified by the expression itself.  Places come from the lengths of the parts between matches.

All of this is DataFrame functions; Python runs on the driver only, to read the rules.

Edge cases: null and empty texts have no spans.  Rows are told apart by doc_id and a hash of the text, so repeated rows,
repeated ids and null ids get their own spans each.  Places are code points, end exclusive.  Matches of one rule don't
overlap (leftmost first); those of different rules may, and spans with one start are in the rules' order.  Texts are
scanned whole.  An empty table gives an empty result.  Columns of docs stay; a new one whose name is taken gets
underscores before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import spare

#: Strings that neighbouring parts are multiplied out to, and members of a class that are spelled out.
FEW = 16
#: Spans that are appended to one list before it is set aside: appending copies.
RUN = 256


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` or more characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules.  The longest run of one class is what its ``+`` matches, so a least length can stand in the pattern.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of keys that services hand out.
SERVICES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A Boolean query: a trigram, or ("and" | "or", queries).  An empty "and" holds everywhere.
Query = str | tuple[str, tuple]
ANY: Query = ("and", ())


def _all(queries: list[Query]) -> Query:
    return ("and", tuple(q for q in queries if q != ANY))


def _some(queries: list[Query]) -> Query:
    return ANY if ANY in queries else ("or", tuple(queries))


def _members(items: list) -> frozenset[str] | None:
    """The members of a class in lower case, if they are few."""
    found: set[str] = set()
    for op, arg in items:
        low, high = arg if str(op) == "RANGE" else (arg, arg)
        if str(op) not in ("LITERAL", "RANGE") or high - low > 2 * FEW:
            return None
        found |= {chr(c).lower() for c in range(low, high + 1)}
    return frozenset(found) if len(found) <= FEW else None


def _parts(items: Iterator) -> Iterator[frozenset[str] | Query]:
    """What must stand one after another: one of a few strings, or something of which a query is known (``ANY``: nothing)."""
    for op, arg in items:
        match str(op):
            case "LITERAL":
                yield frozenset({chr(arg).lower()})
            case "IN":
                yield _members(arg) or ANY
            case "SUBPATTERN":
                yield from _parts(arg[3])
            case "BRANCH":
                each = [_strings([*_parts(p)]) for p in arg[1]]
                whole = None if None in each else frozenset().union(*each)
                yield whole if whole and len(whole) <= FEW else _some([_asked([*_parts(p)]) for p in arg[1]])
            case "MAX_REPEAT" | "MIN_REPEAT":
                low, high, inner = arg
                once = [*_parts(inner)]
                if (low, high) == (0, 1):
                    strings = _strings(once)
                    yield strings | {""} if strings is not None else ANY
                else:
                    for _ in range(min(low, FEW)):
                        yield from once
                    if high != low or low > FEW:
                        yield ANY
            case "AT":
                pass
            case _:
                yield ANY


def _times(left: frozenset[str], right: frozenset[str]) -> frozenset[str]:
    return frozenset(a + b for a, b in product(left, right))


def _strings(parts: list) -> frozenset[str] | None:
    """All strings that ``parts`` can be, if these are few."""
    now = frozenset({""})
    for part in parts:
        if not isinstance(part, frozenset) or len(now) * len(part) > FEW:
            return None
        now = _times(now, part)
    return now


def _one_of(strings: frozenset[str]) -> Query:
    """Every trigram of one of the strings."""
    return _some([("and", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))) for s in sorted(strings)])


def _asked(parts: list) -> Query:
    factors, now = [], frozenset({""})
    for part in [*parts, ANY]:
        if isinstance(part, frozenset) and len(now) * len(part) <= FEW:
            now = _times(now, part)
            continue
        factors.append(_one_of(now))
        now = part if isinstance(part, frozenset) else frozenset({""})
        if not isinstance(part, frozenset):
            factors.append(part)
    return _all(factors)


def trigram_query(pattern: str) -> Query:
    """A query over the trigrams of a text in lower case that holds wherever ``pattern`` matches."""
    return _asked([*_parts(re._parser.parse(pattern))])


def trigrams(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def holds(query: Query, found: Column) -> Column:
    """Whether the array of trigrams ``found`` satisfies ``query``."""
    if isinstance(query, str):
        return F.array_contains(found, query)
    each = [holds(q, found) for q in query[1]]
    if query[0] == "and":
        return reduce(Column.__and__, each, F.lit(True))
    return reduce(Column.__or__, each, F.lit(False))


def marked(docs: DataFrame, text: str, mark: str) -> DataFrame:
    return docs.withColumn(mark, F.xxhash64(text))


def postings(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """The index: (trigram, doc_id, mark) for the trigrams that ``rules`` ask for and the texts that have them."""
    asked = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    low = docs.where(F.col(text).isNotNull()).select("doc_id", F.xxhash64(text).alias("mark"), F.lower(text).alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked]).cast("array<string>"))
    return low.select(F.explode(there).alias("trigram"), "doc_id", "mark")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, mark, kinds): the rules whose queries the postings of a document satisfy; not those that scan fully."""
    narrow = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    met = index.where(F.col("trigram").isin(sorted(set().union(*map(trigrams, narrow.values()))))).groupBy("doc_id", "mark").agg(F.collect_set("trigram").alias("found"))
    kinds = F.array_compact(F.array(*[F.when(holds(q, F.col("found")), F.lit(kind)) for kind, q in narrow.items()]).cast("array<string>"))
    return met.select("doc_id", "mark", kinds.alias("kinds")).where(F.size("kinds") > 0)


SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string>"


def matches(rule: Rule, rank: int, text: Column) -> Column:
    """The spans of one rule, in order."""
    every = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else every
    sizes = F.arrays_zip(F.transform(F.slice(between, 1, F.size(every)), F.length).alias("gap"), F.transform(every, F.length).alias("size"), F.transform(checked, F.length).alias("checked"))
    none, nothing = F.array().cast(f"array<{SPAN}>"), F.array().cast(f"array<array<{SPAN}>>")

    def step(held: Column, one: Column) -> Column:
        start = held["at"] + one["gap"]
        end = start + one["size"]
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        full = F.size(held["now"]) >= RUN
        more = F.when(one["checked"] < rule.least, none).otherwise(span)
        return F.struct(end.alias("at"), F.when(full, F.concat(held["done"], F.array(held["now"]))).otherwise(held["done"]).alias("done"), F.concat(F.when(full, none).otherwise(held["now"]), more).alias("now"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("done"), none.alias("now"))
    return F.aggregate(sizes, begin, step, lambda held: F.flatten(F.concat(held["done"], F.array(held["now"]))))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = BASE + SERVICES, text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``spans`` (start, rank and kind of the rule, end), by start, then the rules' order.

    ``index`` is what ``postings`` gave for the same documents and rules, from a table if it was kept; without one it is
    made on the way.
    """
    mark, kinds, spans = spare(docs.columns, "mark"), spare(docs.columns, "kinds"), spare(docs.columns, "spans")
    met = candidates(postings(docs, rules, text) if index is None else index, rules)
    met = met.select(F.col("doc_id").alias(f"{mark}_id"), F.col("mark").alias(f"{mark}_of"), F.col("kinds").alias(kinds))
    rows = marked(docs, text, mark).join(met, F.col("doc_id").eqNullSafe(F.col(f"{mark}_id")) & (F.col(mark) == F.col(f"{mark}_of")), "left")
    found = []
    for rank, rule in enumerate(rules):
        matched = F.col(text).rlike(rule.pattern)
        asked = matched if trigram_query(rule.pattern) == ANY else F.array_contains(kinds, rule.kind) & matched
        found.append(F.when(asked, matches(rule, rank, F.col(text))).otherwise(F.array().cast(f"array<{SPAN}>")))
    return rows.select(*docs.columns, F.array_sort(F.concat(*found)).alias(spans))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _sql() -> str:
    """The same scan without an index.  Letters in either case are spelled out: DuckDB's case-insensitive mode knows more letters than A to Z."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    kinds = (
        ("assign", f"""({words})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
        ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
        ("google", "AIza[A-Za-z0-9_-]{35}", 0, 0),
        ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
        ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 0),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    )
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, string_split_regex(body, {quoted(p)}) AS gaps, regexp_extract_all(body, {quoted(p)}, 0) AS hits, regexp_extract_all(body, {quoted(p)}, {group}) AS checked FROM texts"
        for rank, (kind, p, group, least) in enumerate(kinds)
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
parts AS ({parts}),
each AS (SELECT doc_id, kind, rank, least, unnest(range(1, len(hits) + 1)) AS k, gaps, hits, checked FROM parts WHERE len(hits) > 0),
sized AS (SELECT doc_id, kind, rank, least, k, length(gaps[k]) AS gap, length(hits[k]) AS size, length(checked[k]) AS checked FROM each),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, rank ORDER BY k) AS stop FROM sized),
spans AS (SELECT doc_id, kind, rank, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE checked >= least),
told AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
    FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told t ON d.doc_id = t.doc_id
"""


ORACLE_SQL = _sql()
