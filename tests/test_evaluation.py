"""Checks of retrieval and answers, evidence policy and tiers on stated cases."""

from pyspark.sql import functions as F

from sieveline.operators import evaluation, scoring

RESULTS = [("Kindergeld Antrag", "https://a.de/1", "benefits"), ("Telefon", None, "contacts"), (None, "https://SRC.de", None)]


def ids(checks):
    return {c.id: c["pass"] for c in checks}


def test_retrieval_checks(spark):
    words = "array<string>"
    kinds = f"event string, r_all {words}, r_any {words}, terms {words}, top1 {words}, blocked {words}, contact {words}, stages {words}, results array<struct<title: string, url: string, domain: string>>"
    rows = [
        ("job ", ["benefits", "contacts"], ["x", "contacts"], ["zz", "KINDERgeld"], ["antrag"], ["src.DE"], ["telefon"], ["job"], RESULTS),
        ("job", ["tools"], ["tools"], ["zz"], ["telefon"], ["zz"], ["kindergeld"], ["home"], RESULTS),
        (" ", [], None, None, [], None, None, None, RESULTS),
        ("job", ["x"], ["x"], ["x"], ["x"], ["x"], ["x"], None, None),
        (None, ["benefits"], None, None, None, None, ["telefon"], None, RESULTS[:1]),
    ]
    case = {"expected_life_event": F.col("event"), "required_domains_all": F.col("r_all"), "required_domains_any": F.col("r_any"), "expected_terms_any": F.col("terms"), "expected_terms_top1": F.col("top1"), "blocked_terms_any": F.col("blocked"), "contact_keywords_any": F.col("contact")}
    got = spark.createDataFrame(rows, kinds).select(evaluation.retrieval_checks(case, F.col("stages"), F.col("results")).alias("c")).select("c", evaluation.passed(F.col("c")).alias("p")).collect()
    names = ["life_event", "required_domains_all", "required_domains_any", "expected_terms_any", "expected_terms_top1", "blocked_terms_absent", "contact_keywords_any"]
    assert ids(got[0].c) == dict(zip(names, [True, True, True, True, True, False, True], strict=True)) and not got[0].p
    assert ids(got[1].c) == dict(zip(names, [False, False, False, False, False, True, False], strict=True))
    assert got[2].c == [] and got[2].p
    assert ids(got[3].c) == dict(zip(names, [False, False, False, False, False, True, False], strict=True))
    assert ids(got[4].c) == {"required_domains_all": True, "contact_keywords_any": False}
    one = spark.createDataFrame(rows[:1], kinds).select(evaluation.retrieval_checks({"required_domains_any": F.array(F.lit("contacts"))}, F.col("stages"), F.col("results"), top=1)).first()[0]
    assert ids(one) == {"required_domains_any": False}


def test_answer_checks(spark):
    rows = [("Das Amt zahlt für Köln.", ["https://a.de"], 2, 0, True), ("nichts", None, None, None, None), (None, None, 0, 1, False)]
    df = spark.createDataFrame(rows, "a string, s array<string>, c int, u int, q boolean")
    words = lambda *w: F.array(*map(F.lit, w))
    case = {"must_mention_any": words("x", "FUER"), "must_mention_all": words("amt", "koeln"), "required_sources_any": words("A.de"), "must_not_mention": words("nicht"), "min_cited_sources": F.lit(2)}
    got = [ids(r[0]) for r in df.select(evaluation.answer_checks(case, F.col("a"), F.col("s"), F.col("c"), F.col("u"), F.col("q"))).collect()]
    assert all(got[0].values()) and len(got[0]) == 7
    assert got[1] == {"must_mention_any": False, "must_mention_all": False, "required_sources_any": False, "must_not_mention": False, "min_cited_sources": False, "unsupported_claims": True, "query_specificity": True}
    assert got[2]["must_not_mention"] and not got[2]["unsupported_claims"] and not got[2]["query_specificity"]
    assert ids(df.select(evaluation.answer_checks({}, F.col("a"), F.col("s"), F.col("c"), F.col("u"), F.col("q"))).first()[0]) == {"unsupported_claims": True, "query_specificity": True}


def test_policy_and_tiers(spark):
    rows = [("tier_1_law", "official_info", 0.9), ("tier_unknown", "official_info", 0.9), (None, None, None), ("tier_3_press", "official_info", 0.9), ("tier_2_ngo_watchdog", "context_info", 0.9), ("Tier_2_Official ", "official_info", 0.2), ("tier_4_other", None, None)]
    df = spark.createDataFrame(rows, "t string, r string, c double")
    strict = evaluation.policy_drop(F.col("t"), F.col("r"), F.col("c"), 0.5, "tier_3_ngo", True)
    assert [r[0] for r in df.select(strict).collect()] == [None, "unclassified", "unclassified", "tier", "unofficial", "confidence", "confidence"]
    assert [r[0] for r in df.select(evaluation.policy_drop(F.col("t"), F.col("r"), F.col("c"))).collect()] == [None, "unclassified", "unclassified", None, None, None, None]
    assert [r[0] for r in df.select(scoring.tier_rank(F.col("t"))).collect()] == [4, -1, -1, 1, 2, 3, 0] and len(scoring.TIER_RANK) == 10
    values = [None, float("nan"), float("inf"), -1.0, 0.25, 7.0]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(evaluation.external_confidence(F.col("v"))).collect()] == [0.6, 0.6, 0.6, 0.0, 0.25, 1.0]


def test_resolved_sources_and_frequencies(spark):
    from sieveline.operators import joins, quality

    profiles = spark.createDataFrame([("a", "x.de", "tier_3_press", "high", ["d", "e"]), ("b", "x.de", "tier_3_press", "normal", ["d"]), ("c", "s.x.de", "tier_1_official", "normal", ["d"]), ("w", "y.de", "tier_1_official", "normal", ["e"])], "source_id string, host string, tier string, priority string, domains array<string>")
    rows = [(1, "x.de", "d"), (2, "t.s.x.de", "d"), (3, "t.s.x.de", "e"), (4, "y.de", "d"), (5, "", "d"), (6, None, "d"), (7, "x.de", None), (8, "notx.de", "d"), (1, "x.de", "d")]
    out = joins.resolved_source(spark.createDataFrame(rows, "id int, host string, domain string"), "host", "domain", profiles, F.when(F.col("host") == "y.de", "tier_2_official")).collect()
    assert len(out) == len(rows) and {r.id: (r.source_id, r.source_tier, r.source_status) for r in out} == {
        1: ("a", "tier_3_press", "registered"), 2: ("c", "tier_1_official", "registered"), 3: ("a", "tier_3_press", "registered"), 4: ("y_de", "tier_2_official", "inferred"), 5: (None,) * 3, 6: (None,) * 3, 7: (None,) * 3, 8: (None,) * 3,
    }
    df = spark.createDataFrame([(["a", "b", None], "x"), (None, "y"), (["b", "c"], None)], "l array<string>, s string")
    got = sorted(map(tuple, quality.most_common(df, {"l": F.col("l"), "s": F.array("s")}, 2).collect()))
    assert got == [("l", "a", 1, 2), ("l", "b", 2, 1), ("s", "x", 1, 1), ("s", "y", 1, 2)]


def test_reports(spark, tmp_path):
    import json

    import pytest

    from sieveline.sources import reports

    df = spark.createDataFrame([("a|b", 2, None), ("x\n y", 1, "z")], "k string, n int, note string")
    reports.write_markdown(df, "T", [F.col("n")], f"{tmp_path}/r")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == ["## T", "", "| k | n | note |", "| --- | --- | --- |", "| x y | 1 | z |", "| a\\|b | 2 |  |"]
    assert reports.markdown(df.limit(0), "T", [F.col("n")]).count() == 4
    told = json.loads(reports.summary(df, "q", F.col("n") > 1).first()[0])
    assert (told["name"], told["rows"], told["failed"], told["passed"], [json.loads(x)["k"] for x in told["failures"]]) == ("q", 2, 1, False, ["a|b"])
    assert json.loads(reports.summary(df.limit(0), "q", F.col("n") > 1).first()[0])["passed"]
    with pytest.raises(ValueError):
        reports.markdown(spark.range(1001), "T", [F.col("id")])


def test_extension_rows(spark):
    from sieveline.operators import joins

    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 2), (3, "c", "z", 3)], "id int, domain string, title string, seen int")
    tables = {"a": spark.createDataFrame([(1, "p"), (9, "q")], "id int, v string"), "b": spark.createDataFrame([(2, 5)], "id int, w int")}
    assert {r.id: r.extension for r in joins.with_extension(old, tables).collect()} == {1: '{"v":"p"}', 2: '{"w":5}', 3: None}
    new = spark.createDataFrame([(1, "b", "n", 8), (2, "b", None, 8), (4, "a", "m", 8)], "id int, domain string, title string, seen int")
    fresh = {"a": spark.createDataFrame([(4, "r"), (1, "no")], "id int, v string"), "b": spark.createDataFrame([(1, 7)], "id int, w int")}
    rows, after = joins.upsert_extended(old, tables, new, fresh, ["seen"], ["title"])
    assert sorted(map(tuple, rows.select("id", "domain", "title", "seen").collect())) == [(1, "b", "n", 1), (2, "b", "y", 2), (3, "c", "z", 3), (4, "a", "m", 8)]
    assert sorted(map(tuple, after["a"].collect())) == [(4, "r"), (9, "q")] and sorted(map(tuple, after["b"].collect())) == [(1, 7), (2, 5)]
    assert joins.with_extension(old, {}).where("extension is not null").count() == 0
