"""Packs, curated confidence, contacts and routes beside loops and on stated cases."""

import random

from pyspark.sql import functions as F

from sieveline.operators import packs
from sieveline.operators.probes import OFFICIAL, ORGANISATIONS
from sieveline.operators.rules import Pack

PINS = {"documents": ("u3", "u1", "gone"), "contacts": ("u2",)}
SCENARIOS = (packs.Scenario("a", Pack(("geld",), ("amt",), ("form",), ("info",), ("tel",), ("aid",)), ("hilfe", "rat"), ("nein",), PINS), packs.Scenario("b", Pack(("über",)), pins={"ngo_assistance": ("u5",)}), packs.Scenario("c", Pack(("nirgends",))))
WORDS = ["geld", "amt", "form", "info", "tel", "hilfe", "rat", "nein", "Über", "x", "y"]


def fold(x):
    return (x or "").lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")


def loop(entries):
    valid = (*OFFICIAL, *ORGANISATIONS, "tier_3_press", "tier_4_academic", "tier_4_other")
    lanes = {"documents": lambda e, ngo: e["domain"] != "contacts" and e["tier"] in OFFICIAL, "contacts": lambda e, ngo: e["domain"] == "contacts" and e["tier"] in valid, "ngo_assistance": lambda e, ngo: e["domain"] != "organizations" and e["tier"] in valid and ngo}
    out = []
    for s in SCENARIOS:
        for lane, fits in lanes.items():
            rows, later = [], []
            for e in entries:
                if not e["url"]:
                    continue
                ngo, blob = e["institution"] == "ngo" or e["tier"] in ORGANISATIONS, fold(e["blob"])
                lists = {"keywords": (3.0, 3.0), "expansions": (2.25, 2.0), "documents": (2.0, 1.5), "information": (1.5, 1.5), "contacts": (1.5, 1.5)}
                score = sum(n * (w in blob) for k, (n, _) in lists.items() for w in getattr(s.pack, k)) + (e["domain"] in s.pack.domains) + 0.75 * (e["tier"] in OFFICIAL) + 0.5 * ngo
                face = fold(" ".join(x for x in (e["title"], e["url"], e["domain"]) if x is not None))
                shown = any(fold(w) in face for k in lists for w in getattr(s.pack, k))
                pins = s.pins.get(lane, ())
                if e["tier"] in valid and e["url"] in pins:
                    rows.append((0, pins.index(e["url"]) + 1.0, e["id"], e["url"]))
                allowed = (not s.required or any(w in blob for w in s.required)) and not any(w in blob for w in s.blocked)
                if fits(e, ngo) and allowed and shown and score >= 2.5:
                    rows.append((1, -score, e["id"], e["url"]))
                if lane == "ngo_assistance" and fits(e, ngo) and shown and score >= 1.5:
                    later.append((2, -score, e["id"], e["url"]))
            own, seen = [], set()
            for r in sorted(rows):
                if r[3] not in seen:
                    seen.add(r[3])
                    own.append(r)
            own = own[: 10 if lane == "documents" else 5]
            if lane == "ngo_assistance":
                for r in sorted(later):
                    if len(own) < 3 and r[3] not in {x[3] for x in own}:
                        own.append(r)
            out += [(s.scenario_id, lane, i + 1, r[2], r[3]) for i, r in enumerate(own)]
    return sorted(out)


def test_scenario_packs(spark):
    rng = random.Random(5)
    kinds = "id int, url string, title string, domain string, tier string, institution string, blob string"
    for n in (0, 8, 60, 200):
        text = lambda: rng.choice([None, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 5)))])
        rows = [(i, rng.choice([None, "", *(f"u{j}" for j in range(n))]), text(), rng.choice(["aid", "contacts", "organizations", "tools"]), rng.choice([None, "tier_1_official", "tier_3_ngo", "tier_3_press", "tier_unknown"]), rng.choice([None, "ngo", "authority"]), text()) for i in range(n)]
        df = spark.createDataFrame(rows, kinds).repartition(3)
        names = [c.split()[0] for c in kinds.split(", ")]
        assert sorted(map(tuple, packs.scenario_packs(df, SCENARIOS).collect())) == loop([dict(zip(names, r, strict=True)) for r in rows])


def test_confidence_and_contacts(spark):
    cases = [("job_loss_start", "Arbeitslos melden", None, 0.88), ("job_loss_start", None, "https://x.de/Arbeitslosengeld/", 0.88), ("job_loss_start", "Einkommen ergänzen", "", 0.46), ("job_loss_start", "Einkommen", "", 0.5), ("other", "Arbeitslos melden", "", 0.5), (None, None, None, 0.5), ("job_loss_start", "Widerspruch, Antrag und Bescheid", "", 0.42)]
    got = spark.createDataFrame([c[:3] for c in cases], "s string, t string, u string").select(packs.curated_confidence(F.col("s"), F.col("t"), F.col("u"), F.lit(0.5))).collect()
    assert [r[0] for r in got] == [c[3] for c in cases]
    contacts = [("contacts", "Amt", "u", 0.5, 2.5), ("aid", "Rat", "u", None, 3.0), ("tools", "x", "https://x/HOTLINE", 0.25, 2.25), ("tools", "x", "u", 0.5, None), ("contacts", "x", "", 0.5, None), ("contacts", "x", None, 0.5, None), (None, None, "https://x/hilfe", 0.5, 0.5)]
    got = spark.createDataFrame([c[:4] for c in contacts], "d string, n string, u string, c double").select(packs.contact_rank(F.col("d"), F.col("n"), F.col("u"), F.col("c"), ("rat",), ("hotline",))).collect()
    assert [r[0] for r in got] == [c[4] for c in contacts]


def test_routes(spark):
    local = packs.LOCAL_ROUTE
    cases = [
        ("Sozialhilfe in Leipzig", False, [local, "stadt_leipzig_sozialamt", "kommune_sozialamt"], "Leipzig"), ("Sozialhilfe", True, ["kommune_sozialamt"], None), ("Sozialhilfe", False, None, None), ("Jobcenter 04109", False, [local, "arbeitsagentur", "buergergeld"], "PLZ 04109"),
        ("Hilfe in meiner Stadt", False, [local], None), ("Antrag für Kindergeld", True, ["familie"], None), ("Beratung für bad münder", False, [local], "Bad Muender"), ("x", True, None, None), (None, True, None, None), (" ", True, None, None), ("Jobcenter, Familienkasse, Kindergeld, Bürgergeld, Pflege, Krankengeld", True, ["buergergeld", "familie", "arbeitsagentur"], None),
    ]
    got = spark.createDataFrame([c[:2] for c in cases], "q string, w boolean").select(packs.routes(F.col("q"), F.col("w")).alias("r"), packs.local_hint(F.col("q")).alias("h")).collect()
    assert [(r.r, r.h) for r in got] == [c[2:] for c in cases]


def test_fixtures_and_documented(spark):
    suggestions = spark.createDataFrame([("a", ["Wie?", " ", None, "Wo?"]), ("b", []), ("lost", ["x"]), ("c", None)], "scenario_id string, questions array<string>")
    scenarios = spark.createDataFrame([("a", ["d1", "d2", "d3"], None, list("abcdefgh"), ["z"]), ("b", None, None, None, None), ("c", None, ["r"], ["e"], None)], "scenario_id string, domains array<string>, required array<string>, expansions array<string>, blocked array<string>")
    got = sorted(map(tuple, packs.fixtures(suggestions, scenarios).collect()))
    assert got == [("suggested-a-01", "Wie?", "a", ["d1", "d2"], list("abcdef"), ["z"], 8), ("suggested-a-02", "Wo?", "a", ["d1", "d2"], list("abcdef"), ["z"], 8)]
    old = spark.createDataFrame([("s1", "documents", "T", "https://x/1/"), ("s2", "contacts", "K", "https://x/2")], "scenario string, lane string, title string, url string")
    item = "array<struct<title: string, url: string>>"
    docs = spark.createDataFrame([("Job", [("N", "HTTPS://X/1"), ("M", "https://x/3")], [("P", "https://x/3/")], None, []), ("home", None, None, [("G", "https://x/4")], [("L", " "), (None, "https://x/5")]), ("other", [("N", "https://x/9")], None, None, None)], f"life_event string, official {item}, pdfs {item}, ngo {item}, contacts {item}")
    got = {tuple(r) for r in packs.documented(old, docs, {"job": "s1", "home": "s9"}).collect()}
    assert got == {("s1", "documents", "T", "https://x/1/"), ("s2", "contacts", "K", "https://x/2"), ("s1", "documents", "M", "https://x/3"), ("s9", "ngo_assistance", "G", "https://x/4"), ("s9", "contacts", None, "https://x/5")}


def test_translation_pilot(spark):
    from sieveline.operators import plain

    rows = [(1, "b", "T", "u", "Inhalt, eins", "s"), (2, "a", None, "v", None, "Nur Summe"), (3, "a", "X", None, " ", ""), (4, "a", "Y", "w", "Weil ja", None)]
    df = spark.createDataFrame(rows, "id int, domain string, title string, url string, content string, summary string")
    out = {r.id: r for r in plain.translation_pilot(df, F.lit("now")).collect()}
    assert {i: (r.outcome, r.translation and r.translation.body, r.translation and r.translation.source) for i, r in out.items()} == {1: ("translated", "Inhalt, eins.", "u"), 2: ("translated", "Nur Summe.", "v"), 3: ("error", None, None), 4: ("translated", ". ja.", "w")}
    assert {r.id for r in plain.translation_pilot(df, F.lit("now"), most=2).collect()} == {2, 3}
    assert out[1].action == "update" and out[1].status == "pending" and out[3].action is None
