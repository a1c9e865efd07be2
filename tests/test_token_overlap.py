"""Every document is compared with every item, whatever its id."""

from sieveline import catalog


def test_documents_of_other_ids_count(spark, tmp_path):
    spark.createDataFrame([(0, "a b c d"), (1, "x A a")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(0, "q"), (50, "d C c b"), (51, "A"), (51, "x a"), (52, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, catalog.queries()["u05_token_overlap_all"](spark, str(tmp_path)).collect()))
    assert got == [(0, 50, 0.75), (0, 51, 0.25), (0, 51, 0.25), (1, 51, 0.5), (1, 51, 1.0)]


def test_containment_misses_no_pair(spark):
    import random

    from pyspark.sql import functions as F

    from sieveline.operators import joins

    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("aaabbbcdefghij") for _ in range(rng.randint(0, 9)))
    items, docs = [(i % 15, text()) for i in range(20)], [(i % 50, rng.choice([text(), text(), None])) for i in range(60)]
    words = lambda t: set(t.split(" "))
    split = F.array_distinct(F.split("text", " "))
    asked, found = spark.createDataFrame(items, "item int, text string"), spark.createDataFrame(docs, "doc int, text string")
    for least in (0.01, 0.4, 0.75, 1.0):
        want = sorted((i, d, len(words(a) & words(b)) / len(words(a))) for i, a in items for d, b in docs if b is not None and len(words(a) & words(b)) / len(words(a)) >= least)
        assert sorted(map(tuple, joins.word_containment(asked, found, "item", "doc", split, least).collect())) == want
    assert joins.word_containment(asked, found.limit(0), "item", "doc", split, 0.5).count() == 0 == joins.word_containment(asked.limit(0), found, "item", "doc", split, 0.5).count()


def test_words_stay_where_their_document_is(spark, monkeypatch):
    """Few items are counted in place: the documents aren't shuffled, and no pair carries a document's words."""
    from pyspark.sql import functions as F

    from sieveline.operators import joins

    asked = spark.createDataFrame([(1, "a b"), (2, "b c d"), (1, "a b"), (3, "")], "item int, text string")
    found = spark.createDataFrame([(None, "a x"), (7, "c d a"), (7, "b"), (8, None), (9, "")], "doc int, text string")
    words = F.array_distinct(F.split("text", " "))
    plans = []
    real = joins.stash
    monkeypatch.setattr(joins, "stash", lambda df, name, **k: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), real(df, name, **k))[1])
    want = sorted([(1, None, 0.5), (1, None, 0.5), (1, 7, 0.5), (1, 7, 0.5), (1, 7, 0.5), (1, 7, 0.5), (2, 7, 2 / 3), (3, 9, 1.0)], key=str)
    few = joins.word_containment(asked, found, "item", "doc", words, 0.5)
    assert sorted(map(tuple, few.collect()), key=str) == want
    assert not any("Exchange hashpartitioning" in plan for name, plan in plans if name == "containment")
    monkeypatch.setattr(joins, "RULES", 2)
    many = joins.word_containment(asked, found, "item", "doc", words, 0.5)
    assert sorted(map(tuple, many.collect()), key=str) == want
