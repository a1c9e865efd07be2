"""Versioned stores, batch embedding, coverage probes and the review log, beside loops over the same rows."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.operators import embedding, probes, reviews
from sieveline.sources.store import Store

SCHEMA = "id string, part string, n int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_store(spark, tmp_path):
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    store = Store(spark, f"{tmp_path}/store", SCHEMA, "part")
    assert rows(store.load()) == [] and store.stats() == {"rows": 0, "partitions": 0}
    first = [("a", "x", 1), ("b", "x/ =é", 2), ("c", None, 3), ("d", "", 4)]
    assert store.save(frame(first)) == 1 and rows(store.load()) == sorted(first, key=str) and store.stats() == {"rows": 4, "partitions": 4}
    before = store.load()
    # A reader from before a write sees the rows from before it; rows of other partitions in the write are left out.
    assert store.replace(frame([("e", "x", 5), ("f", "other", 6), ("g", None, 7)]), ["x", None, "gone"]) == 2
    assert rows(before) == sorted(first, key=str)
    after = [("b", "x/ =é", 2), ("d", "", 4), ("e", "x", 5), ("g", None, 7)]
    assert rows(store.load()) == sorted(after, key=str) and rows(store.load(1)) == sorted(first, key=str)
    assert store.upsert(frame([("b", "x", 8), ("h", "x", 9), ("h", "x", 10), (None, "x", 11), (" ", "x", 12)]), "id") == (3, 2)
    last = [("d", "", 4), ("e", "x", 5), ("g", None, 7), ("b", "x", 8), ("h", "x", 10)]
    assert rows(store.load()) == sorted(last, key=str)
    with pytest.raises(ValueError, match="2 rows"):
        store.upsert(frame(first), "id", most=2)
    store.vacuum()
    assert rows(store.load()) == sorted(last, key=str) and store._manifests() == [3]
    with pytest.raises(ValueError, match="schema"):
        Store(spark, store.path, "id string, part string", "part").load()
    # A second writer that began from the same manifest is refused, and nothing of the store changes.
    late, seen = Store(spark, store.path, SCHEMA, "part"), store.manifest()
    store.save(frame(first))
    with pytest.raises(RuntimeError):
        late._published(seen, {})
    assert rows(store.load()) == sorted(first, key=str)
    assert store.save(frame([])) == 5 and rows(store.load()) == []
    (tmp_path / "store" / "manifests" / "9.json").write_text('{"version": "2.0"}')
    with pytest.raises(ValueError, match="version"):
        store.load()


def test_embedding(spark, tmp_path):
    calls = f"{tmp_path}/calls"

    def model(texts: pd.Series):
        with open(calls, "a") as f:
            f.writelines(f"{len(texts)} {t}\n" for t in texts)
        return [[len(t), 0] for t in texts]

    now = F.lit("2024-06-01").cast("timestamp")
    texts = spark.createDataFrame([(0, "aa"), (1, None), (2, "  "), (3, " aa"), (4, "bbb"), (5, "old"), (6, "new"), (7, "aa\t")], "at int, text string").withColumn("vector", F.lit(0))
    cached = [("old", [9.0], "2024-04-01"), ("new", [7.0], "2024-05-20"), ("new", [8.0], "2024-05-30"), ("other", [1.0], "2024-05-30")]
    cache = spark.createDataFrame(cached, "t string, vector array<double>, s string").select(embedding.text_key(F.col("t"), "m").alias("key"), "vector", F.col("s").cast("timestamp").alias("saved_at"))
    out, new = embedding.embedded(texts, "text", "m", model, cache, now, batch=1)
    assert out.columns == ["at", "text", "vector", "_vector"]
    for _ in range(2):  # read twice, embedded once
        assert {r.at: r._vector for r in out.collect()} == {0: [2, 0], 1: None, 2: None, 3: [2, 0], 4: [3, 0], 5: [3, 0], 6: [8.0], 7: [2, 0]}
    assert sorted(open(calls).read().split("\n")) == ["", "1 aa", "1 bbb", "1 old"]
    assert new.columns == ["key", "vector", "saved_at"] and new.count() == 3
    again, more = embedding.embedded(texts, "text", "m", model, cache.unionByName(new), now)
    assert more.count() == 0 and again.where("_vector is not null").count() == 6
    empty, none = embedding.embedded(texts.limit(0), "text", "m", model, cache, now)
    assert empty.count() == none.count() == 0


def test_probes(spark):
    entries = spark.createDataFrame([(1, "Kindergeld", "Der Antrag auf Kindergeld-Zuschlag", "u1", "benefits", "tier_1_official"), (2, "Hilfe", "nichts", "u1", "contacts", None), (3, None, None, "u3", "aid", "tier_3_ngo"), (4, "", "Geldanlage und Kinder", "", "aid", "tier_2_ngo_watchdog")], "id int, title string, text string, url string, domain string, tier string")
    asked = spark.createDataFrame([(1, "a", "Wie viel Geld, bitte? GELD!"), (2, "a", "Kinder und Kinder"), (3, "b", "wo ist das"), (4, "b", "xyzzy"), (5, "c", None), (6, "a", "antrag")], "probe int, scenario string, q string").withColumn("tokens", F.coalesce(probes.tokens(F.col("q"), 12), F.array().cast("array<string>")))
    assert {r.probe: r.tokens for r in asked.collect()} == {1: ["viel", "geld"], 2: ["kinder"], 3: [], 4: ["xyzzy"], 5: [], 6: ["antrag"]}
    fields = {"title": (F.col("title"), 3), "text": (F.col("text"), 1.25)}
    hits = probes.found(asked, "probe", F.col("tokens"), entries, "id", fields)
    assert {(r.probe, r.id): r.score for r in hits.collect()} == {(1, 1): 4.25, (1, 4): 1.25, (2, 1): 4.25, (2, 4): 1.25, (6, 1): 1.25}
    assert rows(probes.coverage(asked, "probe", F.col("tokens"), hits)) == [(1, 2, 2, True), (2, 1, 2, True), (3, 0, 0, False), (4, 1, 0, False), (5, 0, 0, False), (6, 1, 1, True)]
    got = {r.scenario: r for r in probes.scenario_coverage(asked, "scenario", "probe", hits, entries, "id").collect()}
    assert (got["a"].docs, got["a"].contacts, got["a"].ngos, got["a"].missing_docs, got["a"].missing_ngos) == ([1], [], [4], 4, 2)
    assert (got["b"].docs, got["b"].missing_docs, got["c"].missing_contacts) == ([], 5, 5)
    assert probes.found(asked.limit(0), "probe", F.col("tokens"), entries, "id", fields).count() == 0 and probes.found(asked, "probe", F.col("tokens"), entries.limit(0), "id", fields).count() == 0


def test_probes_against_every_word(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc-") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    asked = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) for _ in range(60)} | {"zzz"})
    got = probes.token_words(spark.createDataFrame([(t,) for t in asked * 2], "token string"), spark.createDataFrame([(w,) for w in words], "word string"))
    assert rows(got) == sorted((t, w) for t in asked for w in words if t in w)


def replay(events):
    """The tables that a service would update in place."""
    overrides, cases = {}, {}
    clean = lambda x: (x or "").strip() or None
    for e in events:
        o = overrides.get(e["override_id"])
        if e["action"] == "seen" and clean(e["case_id"]):
            c = cases.setdefault(e["case_id"], {"query": None, "reasons": None, "occurrence_count": 0, "first_seen": e["at"], "resolved_status": "open", "resolution_notes": None, "resolved_by": None, "resolved_at": None})
            c |= {"query": clean(e["query"]) or c["query"], "reasons": e["reasons"] if e["reasons"] is not None else c["reasons"], "occurrence_count": c["occurrence_count"] + 1, "last_seen": e["at"]}
        elif e["action"] == "created" and o is None and clean(e["trigger_text"]) and clean(e["target"]) and clean(e["override_id"]):
            overrides[e["override_id"]] = {"trigger_text": clean(e["trigger_text"]), "target": clean(e["target"]).lower(), "note": clean(e["note"]), "reviewer": clean(e["reviewer"]), "status": "active", "created_at": e["at"], "updated_at": e["at"], "applied_count": 0, "last_applied_at": None}
            if e["case_id"] in cases:
                cases[e["case_id"]] |= {"resolved_status": "resolved", "resolution_notes": clean(e["note"]), "resolved_by": clean(e["reviewer"]), "resolved_at": e["at"], "last_seen": e["at"]}
        elif e["action"] == "disabled" and o is not None:
            o |= {"status": "disabled", "updated_at": e["at"], "note": clean(e["note"]) or o["note"]}
        elif e["action"] == "applied" and o is not None:
            o |= {"applied_count": o["applied_count"] + 1, "last_applied_at": e["at"]}
    return overrides, cases


def test_review_log(spark):
    rng, begin = random.Random(8), datetime(2024, 1, 1)
    pick = rng.choice
    log = [
        {"seq": i, "at": begin + timedelta(hours=i), "action": pick(["seen", "seen", "created", "disabled", "applied"]), "case_id": pick(["c1", "c2", "c3", "", None]), "override_id": pick(["o1", "o2", "o3", "o4", None]), "query": pick(["q", "", None]), "reasons": pick([["r"], [], None]),
         "trigger_text": pick([" Jobverlust ", "Miete!", "", None]), "target": pick(["Job", " ", "home"]), "reviewer": pick(["anna", " ", None]), "note": pick(["n", "m", "", None])}
        for i in range(60)
    ]
    df = spark.createDataFrame([tuple(e[c.split()[0]] for c in reviews.EVENT.split(", ")) for e in log], reviews.EVENT).repartition(3)
    for n in (0, 7, 23, 60):  # any prefix
        at = F.lit(begin + timedelta(hours=n) - timedelta(minutes=1)) if n < 60 else None
        overrides, cases = replay(log[:n])
        assert {r.override_id: {k: r[k] for k in overrides[r.override_id]} for r in reviews.overrides(df, at).collect()} == overrides
        assert {r.case_id: {k: r[k] for k in cases[r.case_id]} for r in reviews.cases(df, at).collect()} == cases
    asked = [(i, pick(["jobverlust", "MIETE", "x", None]), begin + timedelta(hours=rng.randint(-2, 62), minutes=30)) for i in range(80)]
    got = {r.i: (r.override_id, r.target) for r in reviews.as_of(spark.createDataFrame(asked, "i int, t string, at timestamp"), "t", "at", df).collect()}
    for i, text, at in asked:
        held = {k: v for k, v in replay([e for e in log if e["at"] <= at])[0].items() if v["status"] == "active" and text and v["trigger_text"].lower().strip("!") == text.lower()}
        best = max(((v["created_at"], k, v["target"]) for k, v in held.items()), default=(None, None, None))
        assert got[i] == best[1:]
    audit = reviews.audited(df).collect()
    assert len(audit) == sum(e["action"] != "seen" for e in log) and sum(r.action == "life_event_override_created" for r in audit) == len(replay(log)[0])
    assert reviews.overrides(df.limit(0)).count() == reviews.cases(df.limit(0)).count() == reviews.audited(df.limit(0)).count() == 0
