"""Batches are worked on in slices, and the operators that read texts in Python take them so."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from sieveline.functions import batches
from sieveline.operators import cleaning, pages, texts


def test_slices_are_bounded_and_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * (k % 97 * 50) for k in range(999)] + ["y" * 90_000])], names=["k", "t"])
    parts = list(batches.slices(batch, 64, 20_000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]).combine_chunks())
    assert all(p.num_rows <= 64 and (p.num_rows == 1 or p.nbytes <= 20_000) for p in parts)
    assert list(batches.slices(batch.slice(0, 0))) == []


READ = {
    "outline": lambda d: d.select(pages.outline(F.col("t"), F.col("t"))),
    "decoded": lambda d: d.select(cleaning.decoded(F.encode("t", "UTF-8"), F.col("t"))),
    "chunks": lambda d: texts.chunks(d, "k", "t"),
    "provenance": lambda d: texts.chunks(d, "k", "t", ["c"]).select("chunk_id", "c", "chunk_index"),
}


@pytest.mark.parametrize("name", sorted(READ))
def test_python_holds_no_whole_batch(spark, name):
    rows = [(k, "ä" * (k % 40) if k % 7 else None, k) for k in range(1500)]
    df = READ[name](spark.createDataFrame(rows, "k int, t string, c int").coalesce(1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    evals = [line for line in plan.splitlines() if "EvalPython" in line]
    assert len(evals) == 1 and evals[0].rstrip().endswith(f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}"), plan
    assert df.count() == (len([t for _, t, _ in rows if t]) if name in ("chunks", "provenance") else len(rows))
