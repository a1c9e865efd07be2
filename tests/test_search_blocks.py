"""A query set of more than one block is searched whole."""

from sieveline.operators import vectors


def test_blocks_give_what_one_search_gives(spark):
    rows = spark.createDataFrame([(i, [float((i * 37) % 11 - 5), float((i * 17) % 13 - 6), 1.0]) for i in range(60)], "vec_id int, embedding array<float>")
    whole = vectors.search_many(rows, rows, 3)
    cut = vectors.search_blocks(rows, rows, 3, most=8)
    assert cut.count() == 180
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
