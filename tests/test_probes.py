"""Entries that probes find, by both ways, against every token tried on every text."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline import catalog
from sieveline.operators import probes


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", " ".join("".join(rng.choice("abä-B") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 12)))])
    asked = [(rng.choice([None, *range(9)]), ["".join(rng.choice("abä") for _ in range(rng.randint(3, 4))) for _ in range(rng.randint(0, 4))]) for _ in range(14)]
    entries = [(f"e{k}", text(), text()) for k in range(700)]
    want = {}
    tokens = {p: {t for q, ts in asked if q == p for t in ts} for p, _ in asked}
    for p, ts in tokens.items():
        for key, title, body in entries:
            has = lambda c: [t for t in ts if t in (c or "").lower()]
            if has(title) or has(body):
                want[p, key] = 3 * len(has(title)) + 1.25 * len(has(body))
    return spark.createDataFrame(asked, "probe int, tokens array<string>"), spark.createDataFrame(entries, "id string, title string, body string"), want


def scored(tables):
    asked, entries, _ = tables
    return probes.found(asked, "probe", F.col("tokens"), entries, "id", {"title": (F.col("title"), 3), "body": (F.col("body"), 1.25)})


@pytest.mark.parametrize("few", [100_000, 2])
def test_found(tables, monkeypatch, few):
    monkeypatch.setattr(probes, "RULES", few, raising=False)
    got = scored(tables).collect()
    assert {(r.probe, r.id): r.score for r in got} == tables[2] and len(got) == len(tables[2]) > 500


def test_entries_are_scored_where_they_stand(tables):
    plan = scored(tables)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_coverage_moves_counts_only(tables):
    asked = tables[0].where("probe is not null").dropDuplicates(["probe"])
    hits = scored((asked, *tables[1:]))
    out = probes.coverage(asked, "probe", F.col("tokens"), hits)
    held = {r.probe: set(r.tokens) for r in asked.collect()}
    texts = [[(c or "").lower() for c in r[1:]] for r in tables[1].collect()]
    want = {p: sum(any(t in c for t in ts for c in e) for e in texts) for p, ts in held.items()}
    assert {r.probe: r.n_entries for r in out.collect()} == want
    counted = hits.groupBy("probe").count()._jdf.queryExecution().executedPlan().toString()
    assert counted.count("Exchange hashpartitioning") == 1  # of partial counts


def test_coverage_leaves_texts_where_they_stand(spark, tmp_path):
    """Labels too large to broadcast move no text, and those that repeat a document give it rows as the SQL does."""
    rows = [(k, f"Antrag {k}\nWohnung und Familie" if k % 3 else "Arbeit", "de", "amt") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 60, 2)] + [(k, None, 0) for k in (3, 3, 4, 8, 8, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    asked = [(1, "Wo ist der Antrag?"), (2, "familie wohnung"), (3, "nichts davon"), (4, None)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = catalog.queries()["d28_probe_coverage"](spark, str(tmp_path))
        got, plan = out.collect(), out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    con = pytest.importorskip("duckdb").connect()
    for name in ("documents", "labels", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["d28_probe_coverage"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and [r[2] for r in sorted(want)][:2] != [0, 0]
    # One exchange is of the final join's questions; those of texts and labels would be by doc_id.
    texts = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert not [line for line in plan.splitlines() if "SortMergeJoin [doc_id" in line], plan
    assert len(texts) <= 2, texts  # of the labels' own count, in the final and the initial plan
