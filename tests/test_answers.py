"""Extractive answers beside loops, over the query's rows and on stated cases."""

import os
import re

import pytest
from pyspark.sql import functions as F

from sieveline.operators import answers as op
from sieveline.operators.probes import QUESTION_WORDS
from sieveline.plans import answers as plan

SF = "/root/testdata/sf0.001"


def fold(x):
    return x.lower().translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}))


def sober(x):
    x = (x or "").strip(" ")
    return x if x and not any(w in x.lower() for w in op.BOILERPLATE) else None


def usable(x):
    f = re.sub(r"\s+", " ", fold((x or ""))).strip()
    return sober(x) if len((x or "").strip(" ")) >= 12 and not any(re.search(p, f) for p in (*op.POINTERS, op.CURATED)) else None


def lead_sentence(e):
    text = re.sub(r"\s+", " ", (e["summary"] or "").strip(" ") or e["content"] or "").strip(" ")
    if not sober(text):
        return "Direkt pruefen."
    s = re.split(r"(?<=[.!?])\s+", text)[0].strip()
    return re.sub(r"\s+\S*$", "", s[:180]) + "." if len(s) > 180 else s


def intents(q):
    q = fold(q or "")
    found = {"place": r"\bwo\b|\bzustaendig|\bstelle\b|\badresse\b|\bamt\b", "application": r"beantrag|antrag|formular|online starten|stellen\b", "amount": r"wie\s+(viel|hoch)|hoehe|betrag|kosten|regelsatz|regelbedarf", "deadline": "frist|bis wann|deadline|termin|datum", "contact": "wer hilft|hilfe|beratung|an wen|kontakt|telefon|e-?mail"}
    return {k for k, p in found.items() if re.search(p, q, re.ASCII)}


def details(q, e):
    found, folded, out = intents(q), fold(q or ""), []

    def add(label, name, most):
        out.extend(f"{label}: {v}" for v in list(dict.fromkeys(e["facts"][name]))[:most])

    if found & {"place", "application"}:
        add("Antrag", "application", 3)
        add("Zustaendige Stelle", "contacts", 2)
    if "amount" in found:
        add("Hoehe", "amount", 2)
        add("Anspruch", "eligibility", 2)
    if "deadline" in found:
        add("Frist oder Dauer", "deadline", 2)
    if re.search("unterlag|dokument|nachweis|papier|formular", folded):
        add("Unterlagen", "documents", 4)
    if re.search("widerspruch|bescheid|ablehn|klage", folded):
        add("Widerspruch", "appeal", 2)
    if not out:
        add("Anspruch", "eligibility", 2)
        add("Antrag", "application", 2)
        add("Hoehe", "amount", 1)
    return out


def sentences(q, e):
    folded, words = fold(q or ""), []
    for w in re.findall(r"[^\W_]+(?:[\w-]*)", (q or "").lower()):
        if len(w) >= 5 and w not in QUESTION_WORDS:
            words.append(fold(w))
    for p, more in ((r"beantrag|antrag|wo\b|zust", "beantrag antrag online stelle jobcenter familienkasse arbeitsagentur"), (r"wie\s*viel|wieviel|hoehe|betrag|geld|euro|bekomm", "hoehe betrag euro anspruch erhalten gezahlt"), ("frist|wann|datum|termin|bis", "frist termin datum monat tag rueckwirkend")):
        if re.search(p, folded, re.ASCII):
            words += more.split()
    body = sober((e["content"] or "").strip(" ") or e["summary"]) or ""
    some = [s.strip(" ") for s in re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", body).strip(" "))]
    scored = [(0.15 * i - 4 * sum(w in fold(s) for w in dict.fromkeys(words)), i, s) for i, s in enumerate(x for x in some if 24 <= len(x) <= 260)]
    return [s for less, _, s in sorted(x for x in scored if x[0] < 0)[:2]]


def title(e):
    return (e["title"] or "").strip(" ") or "Eintrag"


def official(q, evidence):
    lines, found = [], intents(q)
    for e in evidence[:4]:
        t = fold(title(e))
        lead = None
        if {"place", "application"} <= found:
            lead = "Antrag starten" if re.search("online|beantrag|antrag|formular|portal", t) else "Zustaendige Stelle pruefen"
        elif "application" in found:
            lead = "Antrag pruefen"
        elif "amount" in found:
            lead = "Hoehe oder Anspruch pruefen"
        elif "deadline" in found:
            lead = "Frist pruefen"
        lines.append(f"- {lead + ': ' if lead else ''}{title(e)}.")
        told = details(q, e) or sentences(q, e) or [x for x in [usable(lead_sentence(e))] if x]
        lines += [f"  - {d}" for d in told if t not in fold(d)]
        lines += [f"[Quelle: {e['url']}]"] if e["url"] else []
    out, seen = [], set()
    for x in lines:
        n = re.sub(r"\s+", " ", fold(x)).strip(" ")
        if n not in seen:
            seen.add(n)
            out.append(x)
    return "\n".join(out) if evidence else None


def focused(q, evidence):
    lines, found = [], intents(q)
    distinct = [e for i, e in enumerate(evidence) if e not in evidence[:i]]
    for e in distinct[:3]:
        t = fold(title(e))
        if {"place", "application"} <= found:
            office = e["domain"] == "contacts" or re.search("jobcenter|familienkasse|elterngeldstelle|sozialamt|arbeitsagentur|dienststelle", t)
            lead = "Antrag starten" if re.search("online|beantrag|antrag|formular|portal", t) else "Zustaendige Stelle finden" if office else "Fuer den Antrag wichtig"
        else:
            lead = next((x for k, x in (("place", "Passende Stelle pruefen"), ("application", "Antrag pruefen oder starten"), ("contact", "Hilfe bekommen"), ("amount", "Betrag oder Anspruch pruefen")) if k in found), "Zuerst relevant")
        lines.append(f"- {lead}: {title(e)}.")
        s = lead_sentence(e)
        lines += [f"  {s}"] if t not in fold(s) else []
        lines += [f"[Quelle: {e['url']}]"] if e["url"] else []
    return "\n".join(lines) if evidence else None


BUILDERS = {"official": (op.official_answer, official), "focused": (op.focused_answer, focused)}


@pytest.mark.parametrize("name", BUILDERS)
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_queries(spark, name):
    built, loop = BUILDERS[name]
    rows = plan._asked(spark, SF).select("question", "evidence", built(F.col("question"), F.col("evidence")).alias("a")).collect()
    assert len({r.question for r in rows}) > 2
    for r in rows:
        assert r.a == loop(r.question, [e.asDict(True) for e in r.evidence])


def entry(title, summary=None, content=None, url="", domain=None, **facts):
    return (title, summary, content, url, domain, tuple(facts.get(n, []) for n in op._FACTS))


CASES = [
    entry("Kindergeld online beantragen", "Der Antrag geht online. Mehr steht hier.", "Sie können den Antrag online stellen, das ist einfach. Dies ist ein Satz ohne Bezug dazu. Die Familienkasse zahlt das Geld monatlich aus.", "https://a.de", "benefits"),
    entry("Jobcenter", None, "Das Jobcenter hilft Ihnen dabei weiter und berät Sie gern.", "", "contacts"),
    entry(" ", " ", None, None, None),
    entry("Regelbedarf", "Wir nutzen Matomo.", "x " * 150 + "Ende", "https://b.de", "tools", amount=["Der Regelbedarf beträgt 500 Euro", "563 Euro im Monat", "zu viel im Jahr 2"], appeal=["Widerspruch binnen eines Monats"]),
    entry("Regelbedarf", "Wir nutzen Matomo.", "x " * 150 + "Ende", "https://b.de", "tools", amount=["563 Euro im Monat"]),
]
ASKED = ["Wo kann ich den Antrag stellen?", "Wie hoch ist der Betrag?", "Widerspruch gegen den Bescheid", "Wann ist die Frist?", "Wer hilft mir", "Kindergeld", "", None]


def test_cases(spark):
    lists = [CASES, CASES[3:], CASES[2:3], [CASES[0], CASES[0], CASES[1]], []]
    rows = spark.createDataFrame([(q, e) for q in ASKED for e in lists], f"q string, e {op.EVIDENCE}")
    got = rows.select("q", "e", *[f(F.col("q"), F.col("e")).alias(n) for n, (f, _) in BUILDERS.items()]).collect()
    for r in got:
        evidence = [e.asDict(True) for e in r.e]
        assert r.official == official(r.q, evidence) and r.focused == focused(r.q, evidence)
    first = next(r for r in got if r.q == ASKED[0] and len(r.e) == 3)
    assert first.official.split("\n") == ["- Antrag starten: Kindergeld online beantragen.", "  - Sie können den Antrag online stellen, das ist einfach.", "  - Die Familienkasse zahlt das Geld monatlich aus.", "[Quelle: https://a.de]", "- Zustaendige Stelle pruefen: Jobcenter."]


def test_synthesis_and_cards(spark):
    rows = spark.createDataFrame([(1, CASES[:4]), (2, CASES[2:3]), (3, [])], f"i int, e {op.EVIDENCE}")
    got = {r.i: (r.s, r.c) for r in rows.select("i", op.synthesis_answer(F.col("e")).alias("s"), op.card_answer(F.col("e")).alias("c")).collect()}
    head, then = "Wahrscheinlich zuerst relevant:", "Was du jetzt tun kannst:"
    assert got[1][0].split("\n") == [head, "- Kindergeld online beantragen: Der Antrag geht online. Mehr steht hier.", "[Quelle: https://a.de]", "", then, "- Anlaufstelle finden ueber Jobcenter.", "- Danach Eintrag pruefen."]
    assert got[1][1].split("\n")[-2:] == ["- Kontakt aufnehmen ueber Jobcenter.", "- Danach Eintrag pruefen."] and "Quelle" not in got[1][1]
    assert got[2] == (f"{head}\n- Eintrag: Direkt pruefen.",) * 2 and got[3] == (None, None)


def test_facts(spark):
    none, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    one = lambda **k: op.structured_facts(*[k.get(n, texts if n in ("steps", "documents", "channels") else none) for n in ("steps", "documents", "amount", "eligibility", "duration", "deadline", "agency", "online", "form", "channels", "appeal")])
    df = spark.range(1).select(one().alias("a"), one(steps=F.array(F.lit(" Antrag im Amt stellen "), none, F.lit("kurz")), form=F.lit("https://x.de/form"), online=F.lit(" "), agency=F.lit("Jobcenter Berlin"), duration=F.lit("zwölf Monate"), deadline=F.lit("Kuratiert für diesen Lebenskontext: x")).alias("b"))
    r = df.first()
    assert all(x == [] for x in r.a) and r.b.application == ["Antrag im Amt stellen", "Online-Antrag: https://x.de/form"] and r.b.contacts == ["Zustaendige Stelle: Jobcenter Berlin"] and r.b.deadline == ["zwölf Monate"]
