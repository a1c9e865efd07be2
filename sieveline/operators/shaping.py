"""Row shaping: multilingual maps, size-bounded batches, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def multilingual(texts: dict[str, Column]) -> Column:
    """language -> text without empty ones; null if nothing is left."""
    pairs = [x for k, v in texts.items() for x in (F.lit(k), v)]
    kept = F.map_filter(F.create_map(*pairs), lambda _, v: F.coalesce(v, F.lit("")) != "")
    return F.when(F.size(kept) > 0, kept)


def percent(c: Column) -> Column:
    """A number with one decimal and a percent sign; halves of its shortest decimal form (ten places) go away from zero."""
    exact = F.round(c.try_cast("decimal(28,10)"), 1).cast("string")
    return F.when(c.isNotNull(), F.coalesce(F.concat(exact, F.lit("%")), F.format_string("%.1f%%", c)))


def batches(df: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """``batch``: which stretch of ``budget`` a row starts in, in the order within its group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("batch", F.floor((F.sum(size).over(w) - F.col(size)) / budget))


def flat(df: DataFrame, prefix: str = "") -> list[Column]:
    """Columns of nested structs under dotted names; lists as JSON."""

    def walk(kind: T.StructType, path: str) -> list[Column]:
        out = []
        for f in kind.fields:
            at = f"{path}.{f.name}" if path else f.name
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, at)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.to_json(F.col(at)).alias(prefix + at))
            else:
                out.append(F.col(at).alias(prefix + at))
        return out

    return walk(df.schema, "")
