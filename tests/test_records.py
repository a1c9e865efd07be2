"""Records, character references, cleaned fields and snapshots on stated cases."""

import html
import json
from datetime import date, datetime

from pyspark.sql import functions as F

from sieveline import catalog
from sieveline.operators import cleaning, filters, records, texts


def one(spark, values, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(column).collect()]


def test_unescaped(spark):
    values = ["&amp;&lt;b&gt;", "&#8364;&#x20ac;&#X1F600;", "&NotEqualTilde; &Auml;", "&unknown; &;", "&#0;&#128;&#55296;&#1114112;&#1;&#11;&#13;&#129;", "a & b; c", "&&amp;;", "", None, "&amp;lt;", "x&#xZ;&copy;2024"]
    assert one(spark, values, cleaning.unescaped(F.col("v"))) == [None if v is None else html.unescape(v) for v in values]


def test_clean_text(spark):
    values = [" a \n\t b ", "fÃ¼r&nbsp;uns", "x﻿y", "a\x07b\x7fc", "%PDF-1 text", None, "&lt;p&gt;"]
    assert one(spark, values, cleaning.clean_text(F.col("v"), filters.binary_text)) == ["a b", "für uns", "xy", "a b c", "", "", "<p>"]


def test_cleaned_fields(spark):
    kind = "struct<title: string, id: string, tags: array<string>, summary: struct<de: string, x: array<struct<en: string, href: string>>>, more: map<string, string>, n: int>"
    df = spark.createDataFrame([((" a&amp;b ", " &amp; ", [" x  y "], (" c  d ", [(" e  f ", " g  h "), None]), {"de": " i  j ", "url": " k  l "}, 3),), ((None, None, None, None, None, None),), (None,)], f"v {kind}")
    a, b, c = (r[0] for r in df.select(cleaning.cleaned_fields(F.col("v"), df.schema["v"].dataType, filters.binary_text)).collect())
    assert (a.title, a.id, a.tags, a.summary.de, a.summary.x[0].en, a.summary.x[0].href, a.summary.x[1], a.more, a.n) == ("a&b", "&amp;", ["x  y"], "c d", "e f", "g  h", None, {"de": "i j", "url": "k  l"}, 3)
    assert tuple(b) == (None,) * 6 and c is None
    assert one(spark, [[" a  b ", None]], cleaning.cleaned_fields(F.col("v"), spark.createDataFrame([], "v array<string>").schema["v"].dataType, filters.binary_text), "array<string>") == [["a b", None]]


def test_iso_times(spark):
    df = spark.createDataFrame([((datetime(2024, 1, 2, 3, 4, 5), [datetime(2024, 1, 2, 3, 4, 5, 60), None], {"d": date(2024, 2, 3)}, "x"),), (None,)], "v struct<t: timestamp, l: array<timestamp>, m: map<string, date>, s: string>")
    a, b = (r[0] for r in df.select(cleaning.iso_times(F.col("v"), df.schema["v"].dataType)).collect())
    assert tuple(a) == ("2024-01-02T03:04:05", ["2024-01-02T03:04:05.000060", None], {"d": "2024-02-03"}, "x") and b is None


def test_seeds(spark):
    raw = ['" https://a.de "', '{"url": " https://b.de ", "enabled": false, "label": " x ", "notes": " ", "topics": [" t ", "", null], "tags": [" "], "priority": 3}', '{"url": "https://c.de", "enabled": null, "priority": "high"}', '{"url": " "}', "7", "[1]", "nonsense", "", None, '" "']
    got = one(spark, raw, records.seed(F.col("v")))
    assert [g and g.url for g in got] == ["https://a.de", "https://b.de", "https://c.de", None, None, None, None, None, None, None]
    assert (got[1].enabled, got[1].label, got[1].notes, got[1].topics, got[1].tags, got[1].priority) == (False, "x", None, ["t"], None, 3)
    assert got[0].enabled and got[2].enabled and got[2].priority is None


def test_evidence_and_items(spark):
    df = spark.createDataFrame([("c1", "t" * 700, None, 1.5), (None, None, "S", -1.0)], "id string, text string, name string, score double")
    chunk = {"chunk_id": F.col("id"), "text": F.col("text"), "source_id": F.lit("src"), "source_name": F.col("name")}
    a, b = (r[0] for r in df.select(records.evidence(chunk, F.col("score"))).collect())
    x, y = json.loads(a.content), json.loads(b.content)
    assert (a.source, a.confidence, len(x["summary"]["de"]), len(x["content"]["de"]), x["provenance"]["source_name"], x["topics"], x["status"]) == ("rag", 1.0, 600, 700, "src", [], "active")
    assert (b.confidence, y["id"], y["content"]["de"], y["provenance"]["source_name"]) == (0.0, "", "", "S")
    source = "struct<id: string, name: string, hosts: array<string>, tier: string, institution: string, jurisdiction: string, role: string, domains: array<string>, base_url: string>"
    counts = "struct<entries: bigint, domains: array<string>, iqs_sum: double, iqs_count: bigint, ais_sum: double, ais_count: bigint, last_seen: string, sample_url: string>"
    rows = [((None, "Amt", ["a.de", "b.de"], "tier_1", None, "DE", "r", ["x", "y"], "https://a.de"), (3, ["y", "z"], 30.0, 2, 0.0, 0, "2024", None)), ((None,) * 9, (None,) * 8)]
    full, none = (r[0] for r in spark.createDataFrame(rows, f"s {source}, c {counts}").select(records.catalog_item(F.col("s"), F.col("c"))).collect())
    assert tuple(full) == ("a.de", "Amt", "a.de", "tier_1", "unknown", "DE", "r", 3, ["x", "y", "z"], 15.0, None, "2024", "https://a.de")
    assert tuple(none) == ("unknown", "Unknown source", "unknown", "unknown", "unknown", "unknown", None, 0, [], None, None, None, None)


def test_benefit(spark):
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    r = spark.range(1).select(records.benefit({"de": F.lit(" "), "en": F.lit("x")}, {"de": none}, F.lit(" 1 "), no_list, F.array(F.lit("p")), F.lit(""), none)).first()[0]
    assert r.benefitAmount == {"de": " ", "en": "x"} and r.eligibilityCriteria is None and r.benefit_amount_de is None and r.benefit_amount_en == "x"
    assert (r.duration, r.applicationSteps, r.requiredDocuments, r.formLink) == ("1", [], ["p"], None)


def test_snapshots(spark, tmp_path):
    rows = [(i, "ab"[i % 7 == 0], f"t{i}", ["x"] * (i % 2)) for i in range(50)]
    records.write_snapshots(spark.createDataFrame(rows, "id long, domain string, title string, topics array<string>").repartition(3), f"{tmp_path}/s", most=7)
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/s").collect()]
    assert all(d["version"] == "0.1.0" and 0 < len(d["entries"]) <= 7 for d in lines) and len(lines) == 6 + 2
    back = records.read_snapshots(spark, f"{tmp_path}/s", "id long, title string, topics array<string>")
    assert sorted(map(tuple, back.select("id", "domain", "title", "topics").collect())) == sorted((i, d, t, x) for i, d, t, x in rows)
    (tmp_path / "plain.txt").write_text('[{"id": 1, "title": "a"}, {"id": 2}]\n\n{"domain": "d", "entries": [{"id": 3}]}\n{"domain": "e", "entries": []}\n')
    assert sorted(map(tuple, records.read_snapshots(spark, f"{tmp_path}/plain.txt", "id long, title string").collect()), key=str) == [("d", 3, None), (None, 1, "a"), (None, 2, None)]


def test_keyed_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"url": "A", "seq": 2, "s": "new"}\n{"url": "a", "seq": 1, "s": "old"}\n{"url": \nnull\n\n{"url": "b", "seq": 3}\n{"seq": 4}\n')
    got = records.read_keyed(spark, f"{tmp_path}/r.jsonl", "url string, seq long, s string", F.lower("url"), "seq")
    assert {r.key: (r.url, r.seq, r.s) for r in got.collect()} == {"a": ("A", 2, "new"), "b": ("b", 3, None)}


def test_chunks_carry_columns(spark):
    df = spark.createDataFrame([(1, "# A\nx\n\n" + "y " * 900, "s1", "de"), (2, None, "s2", None), (3, "kurz", None, "en")], "doc_id long, text string, source string, lang string")
    carried, plain = texts.chunks(df, "doc_id", "text", ["source", "lang"]), texts.chunks(df, "doc_id", "text")
    joined = plain.join(df.drop("text"), "doc_id").select(carried.columns)
    assert sorted(map(str, carried.collect())) == sorted(map(str, joined.collect())) and carried.count() >= 3


def test_provenance_takes_only_numbers_from_python(spark, tmp_path):
    odd = [None, "", " \n\n ", "# A\n\n## B\n", "# A\nx\n\n" + "y " * 900, "z" * 5000, "ä\n\n" * 700, "#### d\n" + "w" * 1199 + "\n\n \n\nq", "kurz"]
    df = spark.createDataFrame([(k, t, f"s{k}", "de") for k, t in enumerate(odd)], "doc_id long, text string, source string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.queries()["j13_chunk_provenance"](spark, str(tmp_path))
    want = texts.chunks(df, "doc_id", "text", ["source", "lang"]).select(out.columns)
    assert out.dtypes == want.dtypes and sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() > 9
    node, kinds = out._jdf.queryExecution().optimizedPlan(), []
    while node.children().size():
        if node.nodeName() == "ArrowEvalPython":
            kinds.append(node.resultAttrs().apply(0).dataType().simpleString())
        node = node.children().apply(0)
    assert kinds == ["int"]
