"""Lines that a text repeats, against a loop; and a text of very many lines."""

import random
import time
from collections import Counter

from sieveline.operators import texts


def naive(text, times, least):
    if text is None:
        return None
    n = Counter(x.strip(" ") for x in text.split("\n"))
    return "\n".join(x for x in text.split("\n") if n[x.strip(" ")] < times or len(x.strip(" ")) <= least)


def test_against_a_loop(spark):
    rng = random.Random(3)
    cases = [None, "", "\n\n\n", "lange\nlange\nlange", "lange\n lange\nlange \nlange", *("\n".join(rng.choice(["", " x", "lange", " lange ", "länge", "tab\tda", "kurz"]) for _ in range(rng.randint(1, 30))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    for times, least in ((4, 4), (2, 0), (1, 4)):
        got = {r.id: r.text for r in texts.without_repeated_lines(df, "id", "text", times, least).collect()}
        assert got == {i: naive(t, times, least) for i, t in enumerate(cases)}


def test_time_grows_with_the_lines(spark):
    """Each line used to sort all lines of its text again, some minutes for these."""
    text = "\n".join(f"Zeile {i % 4000}" for i in range(16_000)) + "\nletzte"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    begin = time.monotonic()
    assert texts.without_repeated_lines(df, "id", "text").collect()[0].text == "letzte"
    assert time.monotonic() - begin < 20


def test_normalized_time_grows_with_the_lines(spark):
    text = "\n".join(f"Zeile {i % 4000}" for i in range(16_000)) + "\nlang-\nsame Zeile\nund weiter"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    begin = time.monotonic()
    assert {r.id: r.text for r in texts.normalized(df, "id", "text").collect()} == {1: "langsame Zeile und weiter", 2: None}
    assert time.monotonic() - begin < 20
