"""Rule tables on stated cases: scores, boosts, intents, questions, and what is kept out."""

import pytest
from pyspark.sql import functions as F

from sieveline.operators import answers, filters, pages, rules, seeds


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column).first()[0]


def score(spark, query, title="", text="", url="", domain="x", **more):
    c = {k: F.col(k) for k in ("title", "text", "url", "domain")}
    given = {"tokens": [], "strong": [], "ordered": [], "blocked": []} | more
    return one(spark, rules.entry_score(query, given.pop("tokens"), given.pop("strong"), given.pop("ordered"), given.pop("blocked"), c, **given), title=title, text=text, url=url, domain=domain)


@pytest.mark.parametrize(
    ("query", "entry", "points"),
    [
        ("Ich bin arbeitslos", {"text": "Arbeitslos melden"}, 60),
        ("Ich bin arbeitslos", {"title": "Arbeitslosengeld", "url": "https://x.de/arbeitslosengeld/"}, 42),
        ("arbeitslos, selbst", {"text": "freiwillige Arbeitslosenversicherung"}, 0),
        ("arbeitslos", {"text": "freiwillige Arbeitslosenversicherung"}, -45),
        ("Miete", {"text": "Widerspruch einlegen"}, -35),
        ("Widerspruch", {"text": "Widerspruch einlegen"}, 0),
        ("Miete", {"text": "Geflüchtete und Rechtsberatung"}, -70),
        ("Miete", {"url": "https://x.de/selbststaendigkeit"}, -55),
        ("Strom abgestellt", {"text": "Notunterkunft"}, -45),
        ("Strom in der Wohnung", {"text": "Notunterkunft"}, 0),
        ("Hilfe mit dem Antrag online", {"domain": "tools", "text": "eServices"}, 7.5),
        ("Bürgergeld Antrag", {"title": "Bürgergeld online beantragen"}, 80),
        ("Bürgergeld Antrag", {"title": "Bürgergeld", "url": "https://x.de/Buergergeld//"}, 36),
        ("Bürgergeld Antrag", {"title": "Arbeitslosengeld und Einkommen ergänzen"}, -73),
        ("Bildungsgutschein", {"text": "Weiterbildungsförderung, berufliche Rehabilitation", "url": "fbwo"}, 10),
        ("Elterngeld beantragen", {"title": "ElterngeldDigital", "text": "Elterngeld beantragen mit Kinderzuschlag"}, 97),
        ("Kindergeld beantragen", {"text": "Kindergeld-Antrag stellen"}, 50),
        ("Wie hoch ist der Kinderzuschlag", {"title": "Kinderzuschlag: Anspruch"}, 28),
        ("Abschluss", {"text": "Unterhalt"}, -42),
        ("Abschluss", {"text": "Beruf"}, 0),
        ("Miete", {"url": "https://x.de/meta/languages"}, -60),
        ("Wo kann ich Wohngeld beantrag", {"title": "Wohngeld beantragen"}, 41),
        ("Wo kann ich Wohngeld beantrag", {"title": "Pflege"}, -18),
        ("Wie viel Wohngeld", {"title": "Wohngeld beantragen"}, 0),
    ],
)
def test_entry_rules(spark, query, entry, points):
    assert score(spark, query, **entry) == points


def test_entry_score_parts(spark):
    assert score(spark, "x", "Für Alle", "für alle", tokens=["fuer", "alle"]) == 3 + 3 + 1.25
    assert score(spark, "x", "a", tokens=["b"]) == -3 and score(spark, "x", None, None, None, None, tokens=["b"]) == -3
    assert score(spark, "x", "Ämter", "Ämter", strong=["aemter"], ordered=["z", "aemter"], blocked=["aemter"]) == 12 + 8 - 22
    assert score(spark, "Ämter", "Ämter", blocked=["aemter"], weak=["aemter", "z"]) == 5
    s = rules.Scenario({"aid": 3}, {"geld": 2, "kur": -4}, ("geld",), ("sucht",), ("antrag",))
    assert score(spark, "x", "Geld Antrag", "Geld Sucht antrag", domain="aid", scenarios=[s]) == 3 + 2 - 18 + 4.5 + 2.75 + 1.5
    assert score(spark, "x", "", "nichts", scenarios=[s]) == -16 and score(spark, "x", "", "nichts", scenarios=[rules.Scenario(required=("geld",), guarded=False)]) == 0


def test_boosts(spark):
    boost = lambda q, kind, topics, **k: one(spark, F.round(rules.topic_boost(q, F.col("k"), F.col("t"), **k), 4), k=kind, t=topics)
    assert len(rules.BOOSTS) == 12
    assert boost("Wie hoch Bürgergeld?", "broschuere", []) == 1.4 and boost("Wie hoch Bürgergeld?", "STATUTE", []) == round(1.2 * 1.4, 4)
    assert boost("Kindergeld Antrag", "formular", ["family"]) == 1.92 and boost("Kindergeld Antrag, Wohngeld", "formular", []) == 2.0
    assert boost("Sozialhilfe", "x", ["grundbedarf"]) == 1.0 and boost("Sozialhilfe", "x", ["grundbedarf"], below={"sozialhilfe": ("grundbedarf",)}) == 1.25
    assert boost("x", None, []) == 1.0


def test_intents_and_questions(spark):
    asked = {"Am I eligible?": "eligibility", "Wie viel bekomme ich": "eligibility", "Wie viel Geld": "how_to", "What is better": "comparison", "until when": "temporal", "Betrag": "calculation", "Büro": "contact", "Erklärung": "definition", "Stand": "status", "Standort": "contact", "verstanden": "general"}
    got = {r.q: r.i for r in spark.createDataFrame([(q,) for q in asked], "q string").select("q", rules.intent(F.col("q")).alias("i")).collect()}
    assert got == asked
    assert list(rules.QUESTIONS) == ["eligibility", "howto", "factual", "comparison", "exploratory"]


def test_kept_out(spark):
    kinds = ["", None, "x %PDF-1", "endstream", "a endstream b", " startxref ", "/FlateDecode", "�" * 4 + "\x01" * 4, "�" * 8, "\x0b" * 8, "\n\r\t" * 9, "a" * 4000 + "%PDF-"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in kinds], "t string").select(filters.binary_text(F.col("t"))).collect()]
    assert got == [False, None, True, False, True, True, True, False, True, True, False, False]
    guard = seeds.Guard(("https://a.de/x",), ("www.B.de",), ("c.de",), ("/Login",))
    urls = ["https://a.de/x", "https://a.de/y", "https://www.b.de/", "https://sub.b.de/", "https://x.c.de/", "https://notc.de/", "https://a.de/login/1", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(guard.reason(F.col("u"))).collect()] == ["exact_url_blocklist", None, "blocked_host", None, "blocked_host_suffix", None, "blocked_url_token", None]
    assert one(spark, filters.prune_reason(F.col("d"), F.col("u")), d="aid", u="https://www.bmbfsfj.bund.de/bmbfsfj") == "bmbfsfj_root_page" and one(spark, filters.prune_reason(F.col("d"), F.col("u")), d="aid", u=None) == "kept"
    assert one(spark, filters.cookie_entry(F.col("u"), F.col("s"), F.col("c")), u="x!ZIP-search", s=None, c=None) and not one(spark, filters.cookie_entry(F.col("u"), F.col("s"), F.col("c")), u=None, s="Cookie", c=None)
    assert one(spark, answers.sober(F.col("t")), t="Wir nutzen MATOMO") is None and one(spark, pages.poor_title(F.col("t")), t=None) and not one(spark, pages.poor_title(F.col("t")), t="Wohngeld")
