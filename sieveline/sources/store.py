"""A versioned store of rows: Parquet parts, and manifests that say which parts are the store.

A write puts its parts into a new folder first and then publishes a manifest with the next number.  A manifest lists the
folder of every partition, so a write that replaces some partitions names the old folders of the others.  A reader takes
the newest manifest and reads what it lists: it sees the store before a write or after it, never both.  Two writers that
start from one manifest can't both publish the next one; the second gets an error and changes nothing.

Edge cases: a store without a manifest is empty.  A manifest of another version or with another schema is refused.  Rows
whose partition is null are a partition of their own.  Old parts stay for readers that began before a write, until
``vacuum``.  The number of partitions is bounded by ``PARTITIONS``, as the manifest is read whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "1.0"
PARTITIONS = 10_000
#: Fixed value: most rows that one request may bring.
REQUEST = 1500
_PART = "_part"


class Store:
    """Rows of ``schema`` under ``path``, in partitions by the value of a column."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, partition: str) -> None:
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, number: int | None = None) -> dict:
        """The newest manifest, or one by its number; of an empty store one without partitions."""
        known = self._manifests()
        if number is None and not known:
            return {"version": VERSION, "number": 0, "partitions": {}}
        number = known[-1] if number is None else number
        stream = self._fs.open(self._path(f"{self.path}/manifests/{number}.json"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if found.get("version") != VERSION:
            raise ValueError(f"unsupported version: {found.get('version')}")
        if found["schema"] != self.schema.jsonValue():
            raise ValueError("the store has another schema")
        return found

    def load(self, number: int | None = None) -> DataFrame:
        """All rows as of a manifest."""
        folders = [p["folder"] for p in self.manifest(number)["partitions"].values()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def stats(self) -> dict[str, int]:
        """Rows and partitions of the store, from its manifest alone."""
        parts = self.manifest()["partitions"].values()
        return {"rows": sum(p["rows"] for p in parts), "partitions": len(parts)}

    def _written(self, df: DataFrame) -> dict[str, dict]:
        """Parts of ``df`` in a new folder, by partition."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        keyed = df.select(*self.schema.names).withColumn(_PART, _code(self.partition))
        keyed.write.partitionBy(_PART).parquet(folder)
        rows = self.spark.read.schema(StructType([*self.schema.fields]).add(_PART, "string")).parquet(folder).groupBy(_PART).count().limit(PARTITIONS + 1).collect()
        if len(rows) > PARTITIONS:
            raise ValueError(f"more than {PARTITIONS} partitions")
        return {r[0]: {"folder": f"{folder}/{_PART}={r[0]}", "rows": r[1]} for r in rows}

    def _published(self, before: dict, partitions: dict[str, dict]) -> int:
        number = before["number"] + 1
        name, rest = self._path(f"{self.path}/manifests/{number}.json"), self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        body = json.dumps({"version": VERSION, "number": number, "schema": self.schema.jsonValue(), "partitions": partitions})
        stream = self._fs.create(rest, False)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        if self._manifests()[-1:] == [number] or not self._fs.rename(rest, name):
            self._fs.delete(rest, False)
            raise RuntimeError(f"another writer has published manifest {number}")
        return number

    def _key(self, value: object) -> str:
        return "null" if value is None else "v" + str(value).encode().hex().upper()

    def save(self, df: DataFrame) -> int:
        """``df`` as the whole store; the new manifest's number."""
        before = self.manifest()
        return self._published(before, self._written(df))

    def replace(self, df: DataFrame, values: Iterable[object]) -> int:
        """The partitions of ``values`` as the rows of ``df`` that belong to them say; the others stay as they are."""
        before, gone = self.manifest(), {self._key(v) for v in values}
        mine = _code(self.partition).isin(*gone)
        rest = {k: p for k, p in before["partitions"].items() if k not in gone}
        return self._published(before, rest | self._written(df.where(mine)))

    def upsert(self, df: DataFrame, key: str, most: int | None = REQUEST) -> tuple[int, int]:
        """Rows of ``df`` put in the place of those with their key, which may stand in other partitions.

        Rows without a key are skipped; of several with one key, the last by the order of their columns counts.  A request of
        more than ``most`` rows is refused.  Only partitions that lose or gain rows are written.  Returns the manifest's
        number and how many rows were skipped.
        """
        before = self.manifest()
        given, skipped = df.agg(F.count("*"), F.count_if(_keyless(key))).first()
        if most is not None and given > most:
            raise ValueError(f"a request may have {most} rows, not {given}")
        names = self.schema.names
        fresh = df.select(*names).where(~_keyless(key)).groupBy(key).agg(F.max(F.struct(*[c for c in names if c != key])).alias("row")).select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in names])
        old = self.load(before["number"] or None)
        touched = old.join(fresh.select(key), key, "left_semi").select(self.partition).union(fresh.select(self.partition)).distinct().limit(PARTITIONS + 1).collect()
        gone = {self._key(r[0]) for r in touched}
        stay = old.where(_code(self.partition).isin(*gone)).join(fresh.select(key), key, "left_anti").select(*names) if gone else old.limit(0)
        rest = {k: p for k, p in before["partitions"].items() if k not in gone}
        return self._published(before, rest | self._written(stay.unionByName(fresh))), skipped

    def vacuum(self, keep: int = 1) -> None:
        """Delete manifests but for the newest ``keep``, and the parts that none of those lists."""
        numbers = self._manifests()
        kept = [self.manifest(n) for n in numbers[-keep:]]
        used = {p["folder"] for m in kept for p in m["partitions"].values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{n}.json"), False)
        root = self._path(f"{self.path}/data")
        for write in self._fs.listStatus(root) if self._fs.exists(root) else []:
            folders = [s for s in self._fs.listStatus(write.getPath()) if s.isDirectory()]
            live = [s for s in folders if any(u.endswith(f"{write.getPath().getName()}/{s.getPath().getName()}") for u in used)]
            for s in folders if live else [write]:
                if s not in live:
                    self._fs.delete(s.getPath(), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)


def _code(partition: str) -> Column:
    """A partition's value as part of a folder's name."""
    return F.coalesce(F.concat(F.lit("v"), F.hex(F.encode(F.col(partition).cast("string"), "UTF-8"))), F.lit("null"))


def _keyless(key: str) -> Column:
    return F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
