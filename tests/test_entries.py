"""Operators on small tables, with the edge cases the big ones lack."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as fx
from sieveline.operators import filters, joins, pages, quality, ranking, rules, scoring, shaping, texts, vectors
from sieveline.sources import entries as src
from sieveline.streaming import windows


def one(spark, column, **values):
    """The value of an expression over one row of string columns."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.ORG:443/path/to/page/#section", "https://example.org/path/to/page"),
        ("https://example.org/search?b=2&utm_source=newsletter&a=1&utm_campaign=test", "https://example.org/search?a=1&b=2"),
        ("https://example.org/a/./b/../c/", "https://example.org/a/c"),
        ("http://example.org:8080/path/?x=1", "http://example.org:8080/path?x=1"),
        ("not a url", None),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, want):
    assert one(spark, fx.canonical_url(F.col("u")), u=url) == want


def test_german_folding_and_repair(spark):
    assert one(spark, fx.fold_german(F.col("t")), t="Straße ÄÖÜ") == "strasse aeoeue"
    assert one(spark, fx.repair(F.col("t")), t="fÃ¼r SÃ¤tze­") == "für Sätze"
    assert one(spark, fx.dehyphenate(F.col("t")), t="Arbeits-\nlosengeld") == "Arbeitslosengeld"
    assert one(spark, fx.first_text("a", "b", "c"), a=" ", b=None, c="x") == "x"


def test_overlap_without_tokens(spark):
    assert one(spark, fx.overlap(fx.tokens(F.col("q")), fx.tokens(F.col("t"))), q="ist es", t="haus") == 0.0


def test_wildcards_in_terms(spark):
    rows = spark.createDataFrame([("100%",), ("1000",), (None,)], "t string")
    assert filters.text_search(rows, "100_", ["t"]).count() == 2
    assert filters.terms_search(rows, ["10", "%"], ["t"]).count() == 2


def test_fallbacks(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 1), (4, "b", 2), (5, "b", 3)], "id int, g string, x int")
    assert filters.or_all(rows, F.col("x") > 99).count() == 5
    assert filters.or_all(rows, F.col("x") > 4).count() == 1
    assert sorted(r.id for r in filters.or_first(rows, F.col("x") > 4, "g", "id").collect()) == [1, 3, 4]
    assert filters.or_all(rows.limit(0), F.col("x") > 4).count() == 0


def test_unscored_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 40.0, 90.0), (3, 60.0, 60.0)], "id int, iqs double, ais double")
    assert [r.id for r in filters.low_quality(rows).collect()] == [2]
    assert sorted(r.id for r in filters.low_quality(rows, unscored=True).collect()) == [1, 2]


def test_suffix_join_picks_the_best(spark):
    pages = spark.createDataFrame([(1, "a.b.org"), (2, "xb.org"), (3, "b.org"), (4, "")], "id int, host string")
    profiles = spark.createDataFrame([("b.org", 2), ("a.b.org", 1), ("org", 3)], "profile string, tier int")
    got = {r.id: r.profile for r in joins.by_suffix(pages, "host", profiles, "profile", [F.col("tier")], ["id"]).collect()}
    assert got == {1: "a.b.org", 2: "org", 3: "b.org", 4: None}


def test_merge_and_upsert(spark):
    old = spark.createDataFrame([("u", 1.0, 1.0), ("v", 5.0, 5.0)], "url string, iqs double, ais double")
    new = spark.createDataFrame([("u", 2.0, 0.0), ("v", 5.0, 5.0), ("w", None, None)], "url string, iqs double, ais double")
    assert {r.url: r.outcome for r in joins.merge_better(old, new, "url", ["iqs", "ais"]).collect()} == {"u": "replaced", "v": "kept", "w": "added"}
    assert {(r.url, r.ais, r.iqs) for r in joins.upsert(old, new, "url", ["ais"], ["iqs"]).collect()} == {("u", 1.0, 2.0), ("v", 5.0, 5.0), ("w", None, None)}
    assert joins.insert_new(old, new, "url").count() == 3


def test_diff_and_decisions(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id int, t string, n int")
    new = spark.createDataFrame([(1, "A", 1), (2, "b", None), (4, "d", 4)], "id int, t string, n int")
    got = {r.id: (r.kind, r.modified) for r in quality.diff(old, new, "id").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "update", 2: "unchanged", 3: "delete", 4: "create"}
    assert got[1][1]["t"].asDict() == {"old": "a", "new": "A"}
    queue = spark.createDataFrame([(1, "pending"), (2, "pending")], "id int, status string")
    assert {r.id: r.status for r in quality.decide(queue, spark.createDataFrame([(1, "accept")], "id int, decision string"), "id").collect()} == {1: "approved", 2: "pending"}


def test_ranked_picks(spark):
    rows = spark.createDataFrame([(i, f"k{i % 3}" if i % 4 else None, float(i % 5), "q") for i in range(12)], "id int, key string, score double, q string")
    best = ranking.best_or_keyless(rows, "key", "score", "id")
    assert best.where("key is null").count() == 3 and best.where("key is not null").count() == 3
    spread = ranking.diversify(rows, "q", "key", [F.col("score").desc(), "id"], 2, 5).orderBy("position").collect()
    assert [r.position for r in spread] == [1, 2, 3, 4, 5] and spread[0].score == 4.0
    packed = {r.id: (r.included, r.cut) for r in ranking.pack(rows.where("id < 4"), ["q"], ["id"], F.lit(10), 25, 3).collect()}
    assert packed == {0: (10, False), 1: (10, False), 2: (5, True)}
    assert ranking.page(rows, ["id"], 2, 500, 5).count() == 5


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, 1.0, 1.0])], "vec_id int, embedding array<float>")
    fine = vectors.valid(rows, "embedding", 2)
    assert sorted(r.vec_id for r in fine.collect()) == [0, 1, 2]
    assert {r.vec_id: r.score for r in vectors.search(fine, [2.0, 0.0], 5, -1.0).collect()} == {0: 1.0, 1: 0.0, 2: -1.0}
    with pytest.raises(Exception, match="dimensions differ"):
        vectors.search(rows.where("vec_id = 4"), [1.0, 0.0]).collect()
    with pytest.raises(ValueError, match="ask in blocks"):
        vectors.search_many(fine, fine, most=2)


def test_fusion(spark):
    k = spark.createDataFrame([("a", 0), ("b", 1)], "id string, rank int")
    v = spark.createDataFrame([("b", 0, 0.5), ("c", 1, None)], "id string, rank int, raw double")
    got = {r.id: (round(r.score, 9), r.origin) for r in vectors.fuse(k, v, "id").collect()}
    assert got == {"a": (round(0.4 / 61, 9), "keyword"), "b": (round(0.4 / 62 + 0.6 * (1 / 61 + 0.125), 9), "hybrid"), "c": (round(0.6 / 62, 9), "vector")}


@pytest.mark.parametrize(("days", "want"), [(7, 100.0), (8, 90.0), (30, 90.0), (90, 75.0), (180, 60.0), (365, 40.0), (366, 20.0)])
def test_freshness_steps(spark, days, want):
    now = F.lit("2025-06-01").cast("timestamp")
    assert one(spark, scoring.freshness(now - F.expr(f"interval {days} days"), now), x="") == want
    assert one(spark, scoring.freshness(F.lit(None).cast("timestamp"), now), x="") == 50.0


def test_rules(spark):
    cols = {"title": F.col("t"), "text": F.col("t"), "url": F.col("u"), "domain": F.col("d")}
    assert one(spark, rules.rule_points("arbeitslos", cols), t="arbeitslos melden", u="", d="tools") == 60.0
    assert one(spark, rules.rule_points("kontakt", cols), t="", u="", d="contacts") == 5.0
    assert one(spark, rules.intent(F.col("q")), q="Wie kann ich mich anmelden?") == "how_to"
    assert one(spark, rules.intent(F.col("q")), q="wieso") == "general"
    assert one(spark, rules.spoken(F.col("q")), q="Grüße") == "de"
    assert one(spark, rules.answer_confidence(F.col("q")), q="x" * 201 + "[1][2][3]") == "high"


def test_chunks_and_normalizing(spark):
    body = "\n".join(f"Absatz {i} " + "wort " * 60 for i in range(10))
    docs = spark.createDataFrame([(1, f"# Titel\n{body}"), (2, ""), (3, None), (4, "kurz")], "id int, text string")
    got = texts.chunks(docs, "id", "text").collect()
    assert {r.id for r in got} == {1, 4}
    assert [r.chunk_id for r in got if r.id == 1][:2] == ["1-c0000", "1-c0001"] and all(r.text.startswith("Titel\n") for r in got if r.id == 1)
    noisy = spark.createDataFrame([(1, "Kopfzeile\n- 3 -\nein Satz\nder weiter geht.\nKopfzeile\nKopfzeile\nArbeits-\nlos   x\nKopfzeile"), (2, None)], "id int, text string")
    clean = {r.id: r.text for r in texts.normalized(noisy, "id", "text").collect()}
    assert clean == {1: "ein Satz der weiter geht.\nArbeitslos x", 2: None}


def test_html(spark):
    page = '<html><head><style>x{}</style></head><body><nav>no</nav><h1>T &amp; U</h1><p>a <b>b</b><br>c</p><ul><li><a href="/x?utm_a=1">l</a></li></ul><script>no()</script></body></html>'
    rows = spark.createDataFrame([(1, "https://e.org/d/", page), (2, None, None)], "id int, url string, html string")
    assert {r.id: r.text for r in rows.select("id", pages.readable_text(F.col("html")).alias("text")).collect()} == {1: "# T & U\n\na b c\n- l", 2: None}
    assert [(r.id, r.target) for r in texts.links(rows, "id", "url", "html").collect()] == [(1, "https://e.org/x")]


def test_shapes(spark):
    assert one(spark, shaping.multilingual({"de": F.col("a"), "en": F.col("b")}), a="x", b="") == {"de": "x"}
    assert one(spark, shaping.multilingual({"de": F.col("a")}), a="") is None
    rows = spark.createDataFrame([(1, 60), (2, 60), (3, 60)], "id int, size int").withColumn("g", F.lit(1))
    assert [r.batch for r in shaping.batches(rows, ["g"], ["id"], "size", 100).orderBy("id").collect()] == [0, 0, 1]


def test_snapshots(spark, tmp_path):
    entry = {"id": "1", "title": "T", "url": "https://e.org", "status": "active", "summary": {"de": "s"}, "qualityScores": {"iqs": 1.5}}
    (tmp_path / "a.json").write_text(json.dumps([entry]))
    (tmp_path / "b.json").write_text(json.dumps({"version": "1", "domain": "aid", "entries": [entry | {"id": "2"}]}, indent=1))
    rows = src.read_domains(spark, {"tools": str(tmp_path / "a.json"), "aid": str(tmp_path / "b.json")})
    assert {(r.id, r.domain, r.summary.de, r.qualityScores.iqs) for r in rows.collect()} == {("1", "tools", "s", 1.5), ("2", "aid", "s", 1.5)}
    src.write_domains(rows, str(tmp_path / "out"))
    src.write_domains(rows.where("domain = 'aid'"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_json_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"url": "b", "n": 1}\nbroken\n{"url": "a", "n": 2}\n')
    rows = src.read_lines(spark, str(tmp_path / "log.jsonl"), "url string, n int")
    src.write_lines(rows, str(tmp_path / "sorted"))
    assert sorted(r.url for r in spark.read.json(str(tmp_path / "sorted")).collect()) == ["a", "b"]


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def test_window_counts_as_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:20:00", "a"), (3, "2024-01-01 02:00:00", "b"), (4, "2024-01-01 09:00:00", "a")]
    stream = _stream(spark, tmp_path, rows, "event_id long, ts string, kind string")
    q = windows.counted(stream, "kind").writeStream.format("memory").queryName("counted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.kind, r.n) for r in spark.table("counted").collect()} == {("a", 2), ("b", 1)}


def test_failure_registry_keeps_state(spark, tmp_path):
    schema = "user_id long, ts string, event_id long, ok boolean"
    stream = _stream(spark, tmp_path, [(1, "2024-01-01 00:00:00", 1, False), (1, "2024-01-01 00:01:00", 2, False), (2, "2024-01-01 00:00:00", 3, True)], schema)
    q = windows.failure_registry(stream).writeStream.format("memory").queryName("registry").outputMode("update").start()
    q.processAllAvailable()
    _stream(spark, tmp_path, [(1, "2024-01-01 00:02:00", 4, False)], schema)
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("registry").collect():
        last[r.user_id] = max(last.get(r.user_id, (0, False)), (r.failures, r.skip))
    assert last == {1: (3, True), 2: (0, False)}


def test_entry_module_without_optional_parts():
    """The corpus operators are only ever imported by the entry module."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[1] / "sieveline"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) sieveline\.llm", f.read_text(), re.M), f
