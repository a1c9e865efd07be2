"""Reports of small tables as Markdown and as JSON for a build to read.

Edge cases: nulls are empty cells; bars and line breaks in cells are escaped.  An empty table has its head only.  A table of more than
``MOST`` rows is an error, never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST = 1000


def _small(rows: DataFrame) -> DataFrame:
    if rows.limit(MOST + 1).count() > MOST:
        raise ValueError(f"a report has at most {MOST} rows")
    return rows


def markdown(rows: DataFrame, title: str, order: list[Column]) -> DataFrame:
    """(n, line): a heading, and the rows as a table in ``order``."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, rows.columns)), F.lit(" |"))
    head = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    above = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "n long, line string")
    # One window over all is fine here: the table was counted to be small.
    numbered = _small(rows).select((F.row_number().over(Window.orderBy(*order)) + len(head) - 1).cast("long").alias("n"), line.alias("line"))
    return above.unionByName(numbered)


def write_markdown(rows: DataFrame, title: str, order: list[Column], path: str) -> None:
    """The report as one text file in the folder ``path``."""
    markdown(rows, title, order).repartition(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(path)


def summary(rows: DataFrame, name: str, failed: Column) -> DataFrame:
    """One row with the report as JSON: its name, how many rows there are and fail, whether it passes, and the rows that fail."""
    kept = _small(rows).withColumn("_failed", F.coalesce(failed, F.lit(False)))
    bad = F.sort_array(F.collect_list(F.when(F.col("_failed"), F.to_json(F.struct(*rows.columns)))))
    counts = kept.agg(F.count("*").alias("rows"), F.count_if("_failed").alias("failed"), bad.alias("bad"))
    report = F.struct(F.lit(name).alias("name"), "rows", "failed", (F.col("failed") == 0).alias("passed"), F.col("bad").alias("failures"))
    return counts.select(F.to_json(report).alias("report"))
