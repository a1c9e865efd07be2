"""Plain language beside loops, over the queries' rows and on stated cases; records, reviews, promotion and diffs."""

import os
import re

import pytest
from pyspark.sql import functions as F

from sieveline.operators import answers, crawl, plain, quality, rules
from sieveline.plans import plain as plan

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def one_line(x):
    return re.sub(r"\s+", " ", x or "").strip()


def split(text):
    return [p for p in (one_line(x) for x in re.split(r"(?<=[:;.!?])\s+|\|", one_line(text))) if p]


def word(p):
    return re.compile(rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])", re.I)


def simpler(s):
    for p, r, _ in plain.GLOSSARY:
        s = word(p).sub(lambda _, r=r: r, s)
    for p, r in (("Sie oder Mitglieder Ihrer Familie", "Sie oder Ihre Familie"), ("Sie oder Mitglieder Ihrer Bedarfsgemeinschaft", "Sie oder Ihre Familie"), ("keine Krankheit oder Behinderung hindert Sie daran", "keine Krankheit oder Behinderung hält Sie davon ab"), ("Voraussetzungen", "Bedingungen"), ("beantragen", "anfragen oder beantragen")):
        s = word(p).sub(r, s)
    return one_line(s)


def explained(text, mode):
    out = []
    for p, r, e in plain.GLOSSARY:
        if e and word(p).search(text or ""):
            out += [f"{r} bedeutet:", e] if mode == "leicht" else [f"{r} bedeutet: {e}"]
    return list(dict.fromkeys(out))


def einfach(title, text):
    told = [f"{title}." if one_line(title) else "", " ".join(simpler(s) for s in split(text)[:6]), ("Wichtige Begriffe: " + " ".join(explained(text, "einfach")[:2])) if explained(text, "einfach") else ""]
    return " ".join(x for x in map(one_line, told) if x)


def leicht(title, text):
    lines = [title]
    for s in split(text)[:5]:
        lines += re.sub(r",\s*", ". ", word("und").sub(".", simpler(s))).split(".")
    return "\n".join([x for x in map(one_line, lines + explained(text, "leicht")[:4]) if x][:14])


@tables
def test_levels(spark):
    rows = plan._texts(spark, SF).select("title", "text", plain.einfach(F.col("title"), F.col("text")).alias("e"), plain.leicht(F.col("title"), F.col("text")).alias("l")).collect()
    for r in rows:
        assert (r.e, r.l) == (einfach(r.title, r.text), leicht(r.title, r.text))
    assert sum("Wichtige Begriffe" in r.e for r in rows) > 20 and sum("bedeutet:\n" in r.l for r in rows) > 20


def test_stated_levels(spark):
    cases = [("Hilfe", "Das Jobcenter hilft, und zahlt. Sie sind hilfebedurftig: ja!"), (None, None), ("Nur Titel", " "), ("", "BÜRGERGELD|Bürgergeldantrag und bürgergeld."), ("T", ". ".join("a" * 3 for _ in range(9)))]
    rows = spark.createDataFrame(cases, "t string, x string").select(plain.einfach(F.col("t"), F.col("x")).alias("e"), plain.leicht(F.col("t"), F.col("x")).alias("l")).collect()
    assert [(r.e, r.l) for r in rows] == [(einfach(*c), leicht(*c)) for c in cases]
    assert rows[0].l.split("\n") == ["Hilfe", "Das Jobcenter hilft", "zahlt", "Sie sind auf Hilfe angewiesen:", "ja!", "auf Hilfe angewiesen bedeutet:", "Das bedeutet: Das Geld reicht nicht zum Leben.", "Jobcenter bedeutet:", "Das Jobcenter ist die Stelle für Bürgergeld."]
    assert rows[1].e == rows[1].l == "" and rows[2].e == "Nur Titel."


def grounded(texts, mode):
    first = [s for s in ((split(t) or [""])[0] for t in texts[:3]) if s]
    if not first:
        return ""
    if mode == "leicht":
        return "\n".join(["Das ist jetzt wichtig:", *first, "Prüfen Sie die passenden Stellen in den Quellen unten."])
    lead = ["", "Als naechster Schritt gilt: ", "Zusaetzlich ist wichtig: "]
    return " ".join(["Das passt zu Ihrer Situation.", *(a + b for a, b in zip(lead, first, strict=False)), "Unten finden Sie die passenden Quellen und Anlaufstellen."])


@tables
def test_translations_and_answers(spark):
    rows = plan._translations(spark, SF).collect()
    want, best = {}, {}
    for r in rows:
        old = {k: v.asDict() for k, v in (r.old or {}).items()}
        title = (r.title or "").strip() or "Eintrag"
        new = dict(old)
        for mode, build, key, n in (("einfach", einfach, "de-EINFACH-SUGGESTED", 2), ("leicht", leicht, "de-LEICHT-SUGGESTED", 4)):
            if not (old.get(key) or {}).get("body"):
                body = build(title, r.text)
                new[key] = {"title": title, "summary": " ".join(body.split("\n")[:n]).strip(), "body": body, "source": r.url, "crawled_at": "2024-06-01", "method": "rule", "generator": plain.GENERATOR, "timestamp": "2024-06-01", "reviewed": False, "variant": mode, "review_status": "suggested"}
        assert {k: v.asDict() for k, v in r.new.items()} == new
        want[r.id] = [(new.get(a) or {}).get("body") or (new.get(b) or {}).get("body") or "" for a, b in (("de-EINFACH", "de-EINFACH-SUGGESTED"), ("de-LEICHT", "de-LEICHT-SUGGESTED"))]
        best.setdefault(r.host, []).append((-(-1.0 if r.ais is None else r.ais), r.id))
    for r in plan.t39(spark, SF).collect():
        ids = [i for _, i in sorted(best[r.host])[:3]]
        assert (r.einfach, r.leicht) == (grounded([want[i][0] for i in ids], "einfach"), grounded([want[i][1] for i in ids], "leicht"))
    assert spark.range(1).select(plain.grounded_answer(F.array().cast("array<string>"), "leicht")).first()[0] == ""


def test_drafts(spark):
    cases = {"Weil es regnet, obwohl es warm ist, bleiben wir da. Ja": ". es regnet. . es warm ist. bleiben wir .. Ja.", "Voraussetzungen einreichen!": "Voraussetzungen abgeben!", " ": "", None: "", "Indem damitten": ". damitten.", "x " * 1100: ("x " * 1000)[:-2].rstrip() + " x..."}
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(plain.easy_german(F.col("t"))).collect()]
    assert got[:5] == list(cases.values())[:5]
    assert got[5].endswith("x...") and len(got[5]) <= 2003


def test_points_links_scenarios(spark):
    text = "You must pay 5 Euro for this, please. Short. The benefit is paid each month there. Nothing is said in this sentence at all! " + "x" * 250
    assert spark.createDataFrame([(text,), (None,)], "t string").select(answers.key_points(F.col("t"), 2)).collect()[0][0] == ["You must pay 5 Euro for this, please", "The benefit is paid each month there"]
    links = [("https://x.de/Geld/hilfe", "aid"), ("https://x.de/", "aid"), (None, "nope"), ("https://x.de/ueber", None)]
    assert [r[0] for r in spark.createDataFrame(links, "u string, f string").select(crawl.link_domain(F.col("u"), F.col("f"))).collect()] == ["benefits", "aid", "benefits", "benefits"]
    said = [(1, "Nach-Ausbildung"), (2, "Ausbildung beendet, Umschulung"), (3, "Geld für Miete"), (4, None)]
    got = {(r.i, r.scenario): r.score for r in rules.matched_scenarios(spark.createDataFrame(said, "i int, t string"), "t", {"upskilling": ("ausbildung",), "rent": ("miete geld", "miet")}).collect()}
    assert got == {(1, "upskilling"): -6.5, (2, "upskilling"): 1.5, (3, "rent"): 4.5}


def test_reviews_of_translations(spark):
    rec = lambda text, by=None: (text, False, None, "open", by, None, "t0")
    rows = [(rec("s"), None, "leicht", "approve", "eva"), (rec("s", "max"), rec("r"), "einfach", "reject", ""), (None, rec("r", "max"), "leicht", "approve", None), (None, None, "leicht", "approve", "eva"), (rec("s"), None, "schwer", "approve", "eva"), (rec("s"), None, "leicht", "drop", "eva"), (None, rec("r"), "leicht", "reject", "eva")]
    df = spark.createDataFrame(rows, f"s {quality.RECORD}, r {quality.RECORD}, m string, a string, w string")
    got = [x[0] for x in df.select(quality.reviewed_translation(F.col("s"), F.col("r"), F.col("m"), F.col("a"), F.col("w"), F.lit("now"))).collect()]
    assert tuple(got[0].suggested) == ("s", True, "leicht", "approved", "eva", "now", "t0") and tuple(got[0].reviewed) == ("s", True, "leicht", "approved", "eva", "now", "now")
    assert tuple(got[1].suggested) == ("s", False, "einfach", "rejected", "max", "now", "t0") and tuple(got[1].reviewed) == rec("r")
    assert got[2].suggested is None and got[2].reviewed.reviewed_by == "max" and got[2].reviewed.review_status == "approved"
    assert [x.error for x in got] == [None, None, None, "no leicht translation", "unsupported mode: schwer", "unsupported action: drop", None]
    assert tuple(got[4].suggested) == rec("s") and tuple(got[6].reviewed) == rec("r")


def test_promotion_and_diffs(spark):
    kinds = "id int, domain string, url string, title string, content string, iqs double, ais double, why string"
    old = [(1, "a", "https://x/1/", "t", "c", 50.0, 50.0, ""), (2, "a", "https://x/2", "t", "c", None, None, ""), (3, "a", None, "t", "c", 1.0, 1.0, ""), (4, "a", "https://x/4", "t" * 501, "c", 1.0, 1.0, ""), (5, "b", "https://x/5", "t", "c", 9.0, 9.0, "")]
    new = [(11, "a", "https://X/1", "t", "c", 50.0, 51.0, "accepted"), (12, "a", "https://x/2/", "t", "c", None, None, "accepted"), (13, "a", "https://x/9", "t", "c", 1.0, None, "accepted"), (14, "a", "https://x/9", "t", "c", 2.0, None, "accepted"), (15, "a", "https://x/8", "t", "c", 2.0, 1.0, "thin"), (16, "c", "https://x/8", "t", "c", 2.0, 1.0, "accepted"), (17, "b", "", "t", "c", 2.0, 1.0, "accepted")]
    out = {r.domain: tuple(r)[1:] for r in quality.promotion(spark.createDataFrame(old, kinds), spark.createDataFrame(new, kinds), F.col("why")).collect()}
    assert out == {"a": (4, 5, 2, 3, 1, "thin:1"), "b": (1, 1, 0, 1, 0, ""), "c": (0, 1, 1, 1, 0, "")}
    a, b = [(1, "x", None), (2, "y", 5), (3, "z", 1)], [(1, "x", 7), (2, None, 6), (4, "n", None)]
    got = sorted(map(tuple, quality.diff_summary(spark.createDataFrame(a, "id int, s string, n int"), spark.createDataFrame(b, "id int, s string, n int"), "id").collect()))
    assert got == [(1, "update", 1, 0, 0, 1, 1), (2, "update", 0, 1, 1, 0, 2), (3, "delete", 0, 0, 2, 0, 2), (4, "create", 1, 0, 0, 0, 1)]


def test_audit(spark):
    texts = [None, " ", "Kurz.", "Das Jobcenter zahlt, und zwar: viel.", "Jobcenter bedeutet: Amt.", " ".join(["wort"] * 17) + ".", "Ja. " * 9, "Bürgergeld, Jobcenter, Kinderzuschlag, Arbeitslosengeld, Bedarfsgemeinschaft"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(plain.audit(F.col("t"), "einfach").alias("e"), plain.audit(F.col("t"), "leicht").alias("l")).collect()
    assert [r.e.score for r in rows] == [0, 0, 100, 89, 94, 82, 92, 80] and [r.l.score for r in rows] == [0, 0, 90, 75, 100, 66, 90, 60]
    assert rows[0].e.findings == ["no_text"] and rows[2].e.findings == [] and rows[3].e.findings == ["colons", "unexplained: Jobcenter"]
