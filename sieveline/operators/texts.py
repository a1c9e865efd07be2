"""Document texts: normalising, chunks, HTML. Stateful steps are Arrow-batched pandas functions of one text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.batches import each_value
from sieveline.functions.text import canonical_url, collapse, dehyphenate, repair
from sieveline.session import ship, spare

CHUNK, OVERLAP = 900, 140


def without_repeated_lines(df: DataFrame, key: str, text: str, times: int = 4, least: int = 4) -> DataFrame:
    """Texts without the lines of more than ``least`` characters that a text has ``times`` times or more; without an
    explode, so a text's lines stay together.

    The sorted lines are a column of their own: an array that a function of its elements also looks into would be made
    anew for each element.
    """
    lines = spare(df.columns, "lines")
    placed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.trim(x).alias("t"), i.alias("i"), x.alias("x")))
    at = lambda k: F.get(F.col(lines), k)["t"]

    def often(e: Column, k: Column) -> Column:
        """In a sorted array a line is there ``times`` times if some stretch of that many around it begins and ends with it."""
        ends = [(at(k - d) == e["t"]) & (at(k - d + (times - 1)) == e["t"]) for d in range(times)]
        return (F.length(e["t"]) > least) & reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in ends])

    kept = F.filter(F.transform(lines, lambda e, k: F.when(~often(e, k), F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e.isNotNull())
    out = df.withColumn(lines, F.sort_array(placed))
    return out.withColumn(text, F.array_join(F.transform(F.sort_array(kept), lambda e: e["x"]), "\n")).drop(lines)


def _unwrap(text: str | None) -> str | None:
    """Lines that were broken within a sentence in one piece."""
    if text is None:
        return None
    out: list[str] = []
    for line in text.split("\n"):
        last = out[-1].rstrip() if out else ""
        if out and last and line.strip() and not last.startswith("#") and last[-1] not in ".!?:;|" and line.lstrip()[:1].islower():
            out[-1] = f"{last} {line.lstrip()}"
        else:
            out.append(line)
    return "\n".join(out)


#: Lines that only number pages.
_PAGE_LINES = (r"(?m)^[-–]\s*\d+\s*[-–]\s*$", r"(?mi)^Seite\s+\d+\s+(von\s+\d+)?\s*$")


def normalized(df: DataFrame, key: str, text: str) -> DataFrame:
    """Damaged characters, page numbers, repeated lines, hyphenation, wraps and spaces, in this order."""
    numbers = F.regexp_replace(F.regexp_replace(repair(F.col(text)), _PAGE_LINES[0], ""), _PAGE_LINES[1], "")
    out = without_repeated_lines(df.withColumn(text, numbers), key, text)
    return out.withColumn(text, collapse(each_value(_unwrap, T.StringType(), dehyphenate(F.col(text)))))


#: Fixed value: a heading line of one to four #.
_HEADING = re.compile(r"^(#{1,4})\s+(.+)$", re.MULTILINE)


def _sections(text: str) -> Iterator[tuple[str, int, str]]:
    """(heading, its place in the text, body) for each heading and for what is before the first; empty bodies are left out."""
    marks = [(0, 0, ""), *((m.start(), m.end(), m[2].strip()) for m in _HEADING.finditer(text))]
    ends = [*(start for start, _, _ in marks[1:]), len(text)]
    for (start, begin, heading), end in zip(marks, ends, strict=True):
        if body := text[begin:end].strip():
            yield heading, start, body


def _paragraphs(body: str) -> Iterator[tuple[int, str]]:
    """(place, text) of what blank lines set apart; a paragraph's place is that of the line break before it."""
    at = 0
    while at < len(body):
        end = body.find("\n\n", at + 1)
        end = len(body) if end < 0 else end
        if paragraph := body[at:end].strip():
            yield at, paragraph
        at = end


def _pieces(body: str) -> Iterator[tuple[int, str]]:
    """(place, text): paragraphs gathered up to CHUNK characters; a piece that begins after a full one is led by its last
    OVERLAP, and a longer paragraph that begins a piece is cut every CHUNK - OVERLAP.
    """
    held, start = "", 0
    for at, paragraph in _paragraphs(body):
        if len(held) + 2 * bool(held) + len(paragraph) <= CHUNK:
            held, start = (f"{held}\n\n{paragraph}", start) if held else (paragraph, at)
        elif held:
            yield start, held
            held, start = f"{held[-OVERLAP:]}\n\n{paragraph}".strip(), max(0, at - OVERLAP)
        else:
            for k in range(0, len(paragraph), CHUNK - OVERLAP):
                yield at + k, paragraph[k : k + CHUNK]
    if held:
        yield start, held


_CUT = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("body", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _cut(text: str | None) -> list[dict]:
    return [{"heading": h, "body": p if not h or p.startswith(h) else f"{h}\n{p}", "start": s + a, "end": s + a + len(p)} for h, s, b in _sections(text or "") for a, p in _pieces(b) if p.strip()]


def chunks(df: DataFrame, key: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each chunk: its id, place, number of chunks, heading, text, and the characters of the document it covers; ``carry`` are columns of the document that go with it."""
    parts = df.select(key, *carry, each_value(_cut, _CUT, F.col(text)).alias("_parts"))
    # The outer form: for the other, the plan asks for lists with items first, and would cut each document twice.
    out = parts.select(key, *carry, F.size("_parts").alias("total_chunks"), F.posexplode_outer("_parts").alias("chunk_index", "_part")).where("chunk_index is not null")
    return out.select(F.format_string("%s-c%04d", F.col(key).cast("string"), "chunk_index").alias("chunk_id"), key, "chunk_index", "total_chunks", F.col("_part.heading").alias("section"), F.col("_part.body").alias("text"), F.col("_part.start").alias("char_start"), F.col("_part.end").alias("char_end"), *carry)


def _count(text: str | None) -> int:
    return sum(bool(p.strip()) for _, _, b in _sections(text or "") for _, p in _pieces(b))


def chunk_places(df: DataFrame, key: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
    """The ids and places that ``chunks`` gives, with the document's ``carry``; only a number for each document leaves Python."""
    parts = df.select(key, *carry, each_value(_count, T.IntegerType(), F.col(text)).alias("_n"))
    # The outer form here too, for the same reason.
    out = parts.select(key, *carry, F.posexplode_outer(F.array_repeat(F.lit(True), F.col("_n"))).alias("chunk_index", "_one")).where("chunk_index is not null")
    return out.select(F.format_string("%s-c%04d", F.col(key).cast("string"), "chunk_index").alias("chunk_id"), key, "chunk_index", *carry)


class _Links(HTMLParser):
    """The targets of a page's links."""

    def __init__(self) -> None:
        super().__init__()
        self.targets: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a" and (target := dict(attrs).get("href")):
            self.targets.append(target)


def _links(source: str) -> list[str]:
    page = _Links()
    page.feed(source)
    page.close()
    return page.targets


def links(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """The distinct canonical targets of a page's links."""
    ship(df.sparkSession)

    @F.pandas_udf("array<string>")
    def targets(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([[urljoin(b, t) for t in _links(p)] if p and b else [] for p, b in zip(pages, bases, strict=True)])

    out = df.select(key, F.explode(targets(F.col(html), F.col(url))).alias("_to")).where(F.col("_to").rlike("^https?://"))
    return out.select(key, canonical_url(F.col("_to")).alias("target")).where("target is not null").distinct()


def truncated(text: Column, most: int, where: str = "end") -> Column:
    """At most ``most`` characters: the rest goes from the end, the start or the middle."""
    half = most // 2
    cut = {"end": F.substring(text, 1, most), "start": F.right(text, F.lit(most)), "middle": F.concat(F.substring(text, 1, half), F.lit("..."), F.right(text, F.lit(half)))}
    return F.when(F.length(text) <= most, text).otherwise(cut[where])
