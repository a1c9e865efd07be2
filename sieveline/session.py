"""Session helpers that every subpackage shares: table reads, shared-folder stashes, code shipping."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and the session is local."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(sc, "_sieveline_dir", None) or tempfile.mkdtemp(prefix="sieveline-")
        sc._sieveline_dir = found
    return found.rstrip("/")


def stash(df: DataFrame, name: str, sweep: bool = True) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    With ``sweep``, what only the finished plan still held, its shuffle files above all, is let go at once rather than
    whenever the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if sweep:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    back = spark.read.schema(df.schema).parquet(path)
    back._stash_path = path
    for held in getattr(spark.sparkContext, "_sieveline_scratch", [])[-1:]:
        held.append(back)
    return back


def discard(*stashed: DataFrame) -> None:
    """Delete stashes that nothing will read again."""
    for df in stashed:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stash_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the stashes made inside when it ends, but for those that were passed to the function it gives."""
    stack = spark.sparkContext.__dict__.setdefault("_sieveline_scratch", [])
    held: list[DataFrame] = []
    kept: list[DataFrame] = []
    stack.append(held)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        stack.remove(held)
        saved = {df._stash_path for df in kept}
        for outer in stack[-1:]:
            outer += kept
        discard(*(df for df in held if df._stash_path not in saved))


def spare(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as set it apart from ``columns`` (names count in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, order: list[Column], name: str, stashed: str = "ordered") -> DataFrame:
    """``df`` with each row's place (from 0) in ``order``, ties in any order.

    Ranges of the order are partitions, whose sizes give their offsets; so no task sees more than one range.  The rows
    are written once, because ranges are drawn anew whenever they are computed.
    """
    part, at = spare(df.columns, "part"), spare(df.columns, "at")
    held = stash(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), stashed, sweep=False)
    offsets, before = [], 0
    for p, n in sorted((r[0], r[1]) for r in held.groupBy(part).count().collect()):
        offsets.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, f"{part} int, {at} long")
    rows = held.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order))).join(F.broadcast(starts), part)
    return rows.withColumn(name, F.col(name) - 1 + F.col(at)).drop(part, at)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each context, so that tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_sieveline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sieveline-src-"), "sieveline_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("sieveline", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._sieveline_shipped = True
