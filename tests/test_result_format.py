"""Every event is formatted, also those on a half."""

from pyspark.sql import functions as F

from sieveline import catalog
from sieveline.operators import shaping


def test_halves_and_odd_values(spark):
    rows = spark.createDataFrame([(6.55,), (6.45,), (0.05,), (-0.05,), (7.0,), (1e20,), (None,)], "value double")
    got = [r.v for r in rows.select(shaping.percent(F.col("value")).alias("v")).collect()]
    assert got == ["6.6%", "6.5%", "0.1%", "-0.1%", "7.0%", "100000000000000000000.0%", None]


def test_no_event_is_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(i, i / 100) for i in range(100)], "event_id long, value double")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    assert catalog.queries()["p17_result_format_all"](spark, str(tmp_path)).count() == 100
