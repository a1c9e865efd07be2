"""Texts mended, titles, citations, answers and payloads; all built-in functions but for ``decoded``, which needs Python's codecs."""

from __future__ import annotations

import contextlib
import html
import html.entities
import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import text as fx
from sieveline.functions.batches import each_value

#: Marks of UTF-8 that was read as a one-byte encoding.
DAMAGE = ("Ã", "Â", "â€", "â€“", "â€”", "â€ž", "â€œ", "â€˜", "â€™")
#: Words that a hyphenated compound may have swallowed, and what sets a brand apart from a title.
SWALLOWED = ("der", "die", "das", "dem", "den", "des", "und", "im", "in", "am", "für", "von")
BRAND_MARKS, BRAND_LEAST = (" | ", " – ", " — ", " - "), 12
#: What a question asks for, what answers it, and for two of them what the evidence must have before an answer is due.
ASKED = {
    "place": r"\bwo\b|\bzustaendig|\bstelle\b|\badresse\b|\bamt\b",
    "application": r"beantrag|antrag|formular|online starten|stellen\b",
    "amount": r"wie\s+(viel|hoch)|hoehe|betrag|kosten|regelsatz|regelbedarf",
    "deadline": r"frist|bis wann|deadline|termin|datum",
    "contact": r"wer hilft|hilfe|beratung|an wen|kontakt|telefon|e-?mail",
}
ANSWERED = {
    "place": r"jobcenter|familienkasse|elterngeldstelle|sozialamt|arbeitsagentur|dienststelle|stelle|amt|portal|online|adresse|kontakt|zustaendig",
    "application": r"beantrag|antrag|formular|online|portal|stellen|jobcenter|familienkasse|elterngelddigital",
    "amount": r"euro|betrag|hoehe|regelbedarf|regelsatz|berechn|anspruch",
    "deadline": r"frist|bis|termin|datum|monat|tag|woche|rueckwirkend",
    "contact": r"beratung|kontakt|telefon|e-mail|email|stelle|hilfe|hotline|termin",
}
DUE = {"amount": r"euro|betrag|hoehe|regelbedarf|regelsatz|berechn", "deadline": r"frist|termin|datum|monat|tag|woche|rueckwirkend"}
#: Fixed value: what follows a shortened text.
SHORTENED = "\n\n[Inhalt fuer D1/Pages gekuerzt]"

# The characters that cp1252 puts where Latin-1 has controls, and those controls.
_EXTRA = [(bytes([b]).decode("cp1252"), chr(b)) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is stated, and computed, once however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _damage(c: Column) -> Column:
    """How many marks of damage a text has."""
    return reduce(lambda a, b: a + b, (((F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m)).cast("int") for m in DAMAGE))


def reencoded(c: Column) -> Column:
    """A text that was read as Latin-1 or cp1252 as the UTF-8 that it is, where that is valid and has fewer marks of damage; null for null."""
    extra, controls = "".join(x for x, _ in _EXTRA), "".join(y for _, y in _EXTRA)
    # `encode` fails on other characters, so it only sees texts that fit.
    latin = F.when(c.rlike(r"\A[\x{0}-\x{FF}]*\z"), F.encode(c, "ISO-8859-1").cast("string"))
    cp1252 = F.when(c.rlike(rf"\A[\x{{0}}-\x{{7F}}\x{{A0}}-\x{{FF}}{extra}]*\z"), F.encode(F.translate(c, extra, controls), "ISO-8859-1").cast("string"))
    better = lambda x: F.when(F.is_valid_utf8(x) & (_damage(x) < _damage(c)), x)
    return F.when(fx.contains_any(c, DAMAGE), F.coalesce(better(latin), better(cp1252), c)).otherwise(c)


_LETTERS = "A-Za-zÄÖÜäöüß"


def _parted(piece: Column) -> Column:
    """A piece of a title whose last hyphenated word has swallowed the one after it, in two."""
    runs = F.split(piece, r"(?<=[\p{L}\p{N}_-])(?![\p{L}\p{N}_-])|(?<![\p{L}\p{N}_-])(?=[\p{L}\p{N}_-])")

    def run(r: Column) -> Column:
        parts = F.split(r, "-")
        swallowed = lambda p: F.get(F.filter(F.array(*map(F.lit, SWALLOWED)), lambda w: F.lower(p).endswith(w) & (F.length(p) > F.length(w))), F.lit(0))
        whole = lambda p, i: (i > 0) & p.rlike(f"^[{_LETTERS}]+$") & F.get(parts, i - 1).rlike(f"[{_LETTERS}]$") & swallowed(p).isNotNull()
        at = F.array_max(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: whole(F.get(parts, i), i)))
        cut = lambda p, w: F.concat(F.substr(p, F.lit(1), F.length(p) - F.length(w)), F.lit(" "), F.substr(p, F.length(p) - F.length(w) + 1))
        told = F.transform(parts, lambda p, i: F.when(i == at, cut(p, swallowed(p))).otherwise(p))
        return F.when(at.isNotNull(), F.array_join(told, "-")).otherwise(r)

    return F.when(F.contains(piece, F.lit("-")), F.array_join(F.transform(runs, run), "")).otherwise(piece)


def title(c: Column) -> Column:
    """A page's title: words that ran together apart, one space, no brand after a title of at least BRAND_LEAST characters.

    The title is cut to pieces at white space, before a capital that follows a small letter and after punctuation; each
    piece is looked at by itself, and all are joined again.
    """
    edge = r"\s+|(?<=[a-zäöüß])(?=[A-ZÄÖÜ])|(?<=[:;,.!?])"
    pieces = F.filter(F.split(F.replace(F.regexp_replace(c, r"(?U)\s", " "), F.lit("\u00ad")), edge), lambda x: x != "")
    branded = lambda two: (F.length(F.trim(two[0])) >= BRAND_LEAST) & (F.trim(F.get(two, F.lit(1))) != "")

    def bare(whole: Column) -> Column:
        halves = F.filter(F.array(*[F.split(whole, m.replace("|", r"\|"), 2) for m in BRAND_MARKS]), branded)
        return F.coalesce(F.trim(F.get(F.get(halves, F.lit(0)), F.lit(0))), whole)

    return let(F.array_join(F.transform(pieces, _parted), " "), bare)


#: Spellings of a citation, in plain text: a URL that stands twice is the same URL.  A stated one may be in any brackets.
SPELLINGS = ("[label](url) [url](url)", "[label](url)", "[url](url)")
LABEL = "(?i:Quelle|Source)"


def _scanner() -> str:
    """One expression for every spelling, with a group for each that holds the URL, without what closes a sentence."""

    def compiled(spelling: str, group: int) -> str:
        out, seen, rest = "", False, spelling
        while rest:
            if rest.startswith("url"):
                stop = re.escape(rest[3])
                out += rf"\{group}" if seen else rf"((?i:https?)://[^{stop}\s]*[^{stop}\s.,;])[.,;]*"
                seen, rest = True, rest[3:]
            elif rest.startswith("label"):
                out, rest = out + LABEL + ":?", rest[5:]
            else:
                out, rest = out + (r"\s+" if rest[0] == " " else re.escape(rest[0])), rest[1:]
        return (r"(?:(?m:^)\s*\[\]\s*)?" if "label" in spelling else "") + out

    linked = [compiled(s, k) for k, s in enumerate(SPELLINGS, 1)]
    return "|".join([*linked, rf"\[*\b{LABEL}:\s*((?i:https?)://[^\]\s]*[^\]\s.,;])[.,;]*\]*"])


_CITED = _scanner()


def citations(c: Column) -> Column:
    """Every spelling of a source as ``[Quelle: url]``; a line that only cites stands once, empty brackets and the blank lines before a citation go."""
    found = F.regexp_replace(c, _CITED, "[Quelle: " + "".join(f"${k}" for k in range(1, len(SPELLINGS) + 2)) + "]")
    lines = F.transform(F.split(found, r"\r?\n"), lambda x: F.when(F.trim(x) == "[]", "").otherwise(F.rtrim(x)))
    near = F.split(F.array_join(F.split(F.array_join(lines, "\n"), r"\n+(?=\[Quelle: https?://)"), "\n"), "\n")
    bare = F.transform(near, lambda x: F.trim(x))
    first = F.filter(near, lambda x, i: ~F.trim(x).startswith("[Quelle: http") | (F.array_position(bare, F.trim(x)) == i + 1))
    return F.btrim(F.array_join(first, "\n"), F.lit(" \t\r\n"))


def lanes(official: Column, assistive: Column, contacts: Column) -> Column:
    """The answers of the lanes that have one, each under its heading."""
    parts = ((official, "Amtliche Grundlage:\n"), (assistive, "\nNGO-/Praktische Hilfe:\n"), (contacts, "\nDirekte Kontakte:\n"))
    return F.concat_ws("\n", *[F.when(lane != "", F.concat(F.lit(head), lane)) for lane, head in parts])


def shape_findings(query: Column, answer: Column, evidence: Column) -> Column:
    """What an answer lacks of what its question asks for; an empty list where nothing is missing."""
    q, a, e = (fx.fold_german(F.coalesce(c, F.lit(""))) for c in (query, answer, evidence))
    due = lambda k: e.rlike(DUE[k]) if k in DUE else F.lit(True)
    return F.array_compact(F.array(F.when(F.trim(a) == "", "empty_answer"), *[F.when(q.rlike(p) & ~a.rlike(ANSWERED[k]) & due(k), f"missing_{k}_answer") for k, p in ASKED.items()]))


def walked(c: Column, kind: T.DataType, leaf: Callable[[Column], Column], items: int | None = None) -> Column:
    """A value of any type with ``leaf`` applied to its strings and at most ``items`` of each list; keys of maps stay, null stays null."""
    if isinstance(kind, T.StringType):
        return leaf(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c if items is None else F.slice(c, 1, items), lambda x: walked(x, kind.elementType, leaf, items))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: walked(v, kind.valueType, leaf, items))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[walked(c.getField(f.name), f.dataType, leaf, items).alias(f.name) for f in kind.fields]))
    return c


#: Keys whose strings are for people; every other key's are only trimmed.
TEXT_KEYS = (
    "title", "summary", "content", "description", "name", "label", "notes", "note", "providerName", "publisherName", "operatorName", "author",
    "labelDe", "label_de", "labelEn", "label_en", "summaryDe", "summary_de", "descriptionDe", "description_de", "titleDe", "title_de", "easy_de", "de", "en",
)


def unescaped(c: Column) -> Column:
    """HTML's character references that end with a semicolon, named or by number, as their characters; unknown ones stay.

    The names come from Python's own table as one constant; the text is cut at references and joined again.
    """
    names = {n: v for n, v in html.entities.html5.items() if n.endswith(";")}
    known = F.from_json(F.lit(json.dumps(names)), "map<string, string>")
    point = lambda digits, base: F.conv(digits, base, 10).cast("long")
    # What numbers stand for where HTML reads them as another character or none.
    moved = {int(k): ord(v) for k, v in html._invalid_charrefs.items() if len(v) == 1}

    def character(number: Column) -> Column:
        mended = F.coalesce(*[F.when(number == k, v) for k, v in moved.items() if k != v], number)
        fits = mended.between(1, 0x10FFFF) & ~mended.between(0xD800, 0xDFFF)
        none = mended.isin(*(html._invalid_codepoints - set(html._invalid_charrefs)))
        return F.when(fits, F.when(none, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(mended), 8, "0")), "UTF-32"))).otherwise(F.lit("\ufffd"))

    def piece(p: Column) -> Column:
        decimal, hexed = F.regexp_extract(p, r"^&#([0-9]{1,9});$", 1), F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]{1,8});$", 1)
        told = F.when(decimal != "", character(point(decimal, 10))).when(hexed != "", character(point(hexed, 16))).otherwise(F.try_element_at(known, F.substring(p, 2, 100)))
        return F.when(p.rlike("^&.*;$"), F.coalesce(told, p)).otherwise(p)

    cut = F.split(c, r"(?=&#?[0-9A-Za-z]{1,40};)|(?<=&#?[0-9A-Za-z]{1,40};)")
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(cut, piece), "")).otherwise(c)


def clean_text(c: Column, binary: Callable[[Column], Column]) -> Column:
    """A text for people: mended, unescaped, without controls, one space between words; empty if it is null or a file's bytes (``binary``)."""
    plain = F.regexp_replace(F.translate(unescaped(reencoded(c)), "\u00a0\ufeff", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    return F.when(c.isNull() | binary(c), "").otherwise(F.btrim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def cleaned_fields(c: Column, kind: T.DataType, binary: Callable[[Column], Column], key: str | None = None) -> Column:
    """A value of any type whose strings under ``TEXT_KEYS`` are cleaned and whose others are trimmed; strings without any key are cleaned.

    Lists keep the key they stand under, fields of structs have their own, and so have the values of maps; null stays null.
    """
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), clean_text(c, binary)) if key is None or key in TEXT_KEYS else F.btrim(c, F.lit(" \t\n\r\f\x0b"))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: cleaned_fields(x, kind.elementType, binary, key))
    if isinstance(kind, T.MapType):
        text, other = (lambda v, k: cleaned_fields(v, kind.valueType, binary, k)), "url"
        return F.transform_values(c, lambda k, v: F.when(k.isin(*TEXT_KEYS), text(v, "title")).otherwise(text(v, other)))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[cleaned_fields(c.getField(f.name), f.dataType, binary, f.name).alias(f.name) for f in kind.fields]))
    return c


def iso_times(c: Column, kind: T.DataType) -> Column:
    """A value of any type with its dates and timestamps as ISO text; a fraction of a second only where there is one."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: iso_times(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: iso_times(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[iso_times(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return c


def compacted(c: Column, kind: T.DataType, most: int = 12000, items: int = 100) -> Column:
    """A nested value whose strings have at most ``most`` characters, and a note where more were, and lists at most ``items`` items: the feature."""
    short = lambda x: F.when(F.length(x) <= most, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, most), r"\s+\z", ""), F.lit(SHORTENED)))
    return walked(c, kind, short, items)


_HEAD = 4096  # a page declares its encoding there or not at all


def _declared(payload: bytes) -> str | None:
    """The value of the first charset attribute, or charset in an attribute, of the page's meta tags."""
    for tag in payload[:_HEAD].lower().split(b"<meta")[1:]:
        inside, closed, _ = tag.partition(b">")
        _, named, value = inside.replace(b" =", b"=").replace(b"= ", b"=").partition(b"charset=")
        name = value.strip(b"\"' ").replace(b";", b" ").replace(b"/", b" ").replace(b"'", b" ").replace(b'"', b" ").split()
        if named and name:
            return name[0].decode("ascii", "ignore")
    return None


def _decoded(payload: bytes | None, charset: str | None) -> str | None:
    """By the first attempt that knows its encoding and, where it must, fits the bytes."""
    if payload is None:
        return None
    for name, errors in ((charset, "replace"), (_declared(payload), "replace"), ("utf-8", "strict"), ("cp1252", "replace")):
        with contextlib.suppress(LookupError, UnicodeDecodeError):
            if name:
                return payload.decode(name, errors)
    return ""


def decoded(payload: Column, charset: Column) -> Column:
    """Bytes as text by the header's charset, what the page declares, UTF-8, or cp1252: the first that is known; null for null."""
    return each_value(_decoded, T.StringType(), payload, charset)
