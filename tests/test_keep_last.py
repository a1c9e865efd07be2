"""Keep-last gives every user one row; ties of the time go to the greatest event_id."""

from pyspark.sql import functions as F

from sieveline import catalog


def test_ties_are_settled(spark, tmp_path):
    events = [(1, "2024-01-01 00:00:00", 1, "view"), (2, "2024-01-02 00:00:00.5", 1, "click"), (3, "2024-01-02 00:00:00.5", 1, "error"), (4, "2024-01-01 00:00:00", 2, "view"), (5, None, 2, "click"), (6, None, 3, None)]
    rows = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: (r.last_type, r.last_ts) for r in catalog.queries()["w10_keep_last_all"](spark, str(tmp_path)).collect()}
    assert got == {1: ("error", "2024-01-02 00:00:00.5"), 2: ("view", "2024-01-01 00:00:00"), 3: (None, None)}
