"""Only a short list of each query is numbered, and it gives what numbering all rows gives."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import ranking


def by_hand(rows, groups, limit):
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))
    firsts = {}
    for r in rows:
        firsts.setdefault(r[1], r)
    leads = list(firsts.values())[:groups]
    front = [rows[0], *[r for r in leads if r != rows[0]]]
    return [r[0] for r in front + [r for r in rows if r not in front]][:limit]


@pytest.mark.parametrize("kinds", [3, 2000])
def test_short_list_is_enough(spark, kinds):
    rng = random.Random(kinds)
    rows = [(i, f"k{rng.randrange(kinds)}", float(rng.randrange(40)), "q") for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, key string, score double, q string")
    order = [F.col("score").desc(), "id"]
    assert ranking.shortlist(df, "q", "key", order, 4, 8, "id", 4).count() <= 4 * (8 + 8)
    got = ranking.diversify(df, "q", "key", order, 4, 8).orderBy("position").collect()
    assert [r.id for r in got] == by_hand(rows, 4, 8)
