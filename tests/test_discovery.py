"""Seeds, queues, surfaces and field checks on stated cases, nulls and empty tables."""

from pyspark.sql import functions as F

from sieveline.operators import discovery as op


def one(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column).collect()]


def test_open_seeds(spark):
    seeds = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",), (None,)], "url string")
    registry = spark.createDataFrame([("a", "ok", None, "a"), ("b", "dns_error", False, None), ("c", "ok", True, None), ("d", None, None, "other")], "url string, state string, skip boolean, canonical string")
    assert {r.url for r in op.open_seeds(seeds, registry).collect()} == {"a", "e", None}
    assert op.open_seeds(seeds, registry.limit(0)).count() == 6
    assert op.open_seeds(seeds.limit(0), registry).count() == 0


def test_sitemap_points(spark):
    urls = ["https://x.de/beratung", "https://x.de/presse/News/a", "https://x.de/", "https://x.de/Hilfe%20Arbeitslos", "https://x.de/100%/service", None]
    # hilfe, arbeit and arbeitslos all count; a bad escape is kept as it stands.
    assert one(spark, urls, op.sitemap_points(F.col("v"))) == [3, -11, 1, 9, 2, None]


def test_keyword_matches(spark):
    texts = ["ich bin Arbeits-los!", "los der arbeit", "arbeit", None, ""]
    t = op.scenario_text(F.col("v"))
    assert one(spark, texts, op.keyword_matches(t, "arbeitslos")) == [True, False, False, None, False]
    assert one(spark, texts, op.keyword_matches(t, "arbeit los")) == [False, True, False, None, False]


def test_matched_topics(spark):
    df = spark.createDataFrame([(1, "Kinder-Geld beantragen"), (2, "nichts"), (3, None)], "id int, text string")
    got = {tuple(r)[2:] for r in op.matched_topics(df, "text", {"family": ("kinder", "antrag", "zzz"), "work": ("jobcenter",)}).collect()}
    assert got == {("family", 1, 1, 6)}


def test_critical_info(spark):
    text = "Bis zu 1.250 € monatlich, 40 EUR, ab 15 Jahren, ARBEITSLOS, bis 2025, am 1.3.2024, MÄRZ 2024, 40 EUR"
    amounts, dates, needs = spark.createDataFrame([(text,)], "v string").select(*op.critical(F.col("v"))).first()
    assert amounts == ["1.250 €", "40 EUR"]
    assert dates == ["bis 2025", "1.3.2024", "MÄRZ 2024"]
    assert needs == ["ab 15 Jahre", "ARBEITSLOS"]  # the pattern ends before a dative n


def test_queue_rows_in_either_spelling(spark):
    raw = spark.createDataFrame([(None, "e1", None, "aid", None, None, None, "t"), ("", None, "e2", None, "drop", "open", "u", "t")], "id string, entryId string, entry_id string, domain string, action string, status string, created_at string, crawledAt string")
    got = [tuple(r) for r in op.canonical_queue(raw).collect()]
    assert got == [("e1", "e1", "aid", "update", "pending", "t"), ("e2", "e2", None, "drop", "open", "u")]
    assert [len(r[0]) for r in op.canonical_queue(raw).select(op.queue_errors()).collect()] == [0, 3]


def test_text_blocks_and_embedded_texts(spark):
    assert one(spark, [" - a \n\t b , c | ", None, ""], op.text_block(F.col("v"))) == ["a b, c", None, ""]
    whole = op.text_to_embed(F.lit("t"), F.lit(None).cast("string"), F.col("v"), most=5)
    assert one(spark, ["x" * 40, ""], whole) == ["Title: t\n\nContent: ", "Title: t"]


def test_fields(spark):
    fields = F.split("v", ",")
    assert one(spark, ["Title,url,source_tier,x"], op.field_mismatches(fields, ("title", "url", "sourceTier"))) == [["Title -> title", "source_tier -> sourceTier"]]
    assert one(spark, ["title,timestamp,provenance,extra"], op.translation_errors(fields)) == [["Unknown field 'extra'"]]


def test_pins_and_prunes(spark):
    pins = spark.createDataFrame([("s", "u", "late", 2), ("s", "u", "first", 1), ("s", None, "x", 0), ("t", "u", "other", 3)], "section string, url string, title string, place int")
    assert {tuple(r) for r in op.merged_pins(pins).collect()} == {("s", "u", "first", 1), ("t", "u", "other", 3)}
    seeds = spark.createDataFrame([("https://a.de/",), ("https://A.de",), (None,), (" ",), ("https://bad.de",)], "url string")
    assert {tuple(r) for r in op.prune_counts(seeds, F.col("url"), F.coalesce(F.col("url").contains("bad"), F.lit(False))).collect()} == {("kept", 1), ("duplicate", 1), ("missing_url", 2), ("blocked", 1)}
    assert op.prune_counts(seeds.limit(0), F.col("url"), F.lit(False)).count() == 0
