"""Validation, differences and promotion of entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("active", "discontinued", "archived", "under_revision")


def errors(*checks: tuple[str, Column]) -> Column:
    """The messages of the checks that fail, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for m, c in checks]))


def entry_errors(domains: tuple[str, ...]) -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return errors(
        ("id is required", F.col("id").isNull()),
        ("title is required", blank("title_de")),
        ("url is required", blank("url")),
        ("url must be absolute", ~F.col("url").rlike(r"^https?://[^/\s]+")),
        ("status is not known", ~F.col("status").isin(*STATUSES)),
        ("domain is not known", ~F.col("domain").isin(*domains)),
        ("score is out of range", F.coalesce((F.col("iqs") < 0) | (F.col("iqs") > 100), F.lit(False))),
    )


def entry_warnings() -> Column:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return errors(
        ("no summary", blank("summary_de")),
        ("no english title", blank("title_en")),
        ("no tags", F.size(F.coalesce("tags", F.array().cast("array<string>"))) == 0),
        ("title is long", F.coalesce(F.length("title_de") > 200, F.lit(False))),
    )


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, kind (create, delete, update, unchanged) and modified: column -> old and new as text."""
    o, n = old.alias("o"), new.alias("n")
    columns = [c for c in old.columns if c in new.columns and c != key]
    pair = lambda c: F.struct(F.col(f"o.{c}").cast("string").alias("old"), F.col(f"n.{c}").cast("string").alias("new"))
    changes = F.map_from_entries(F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.struct(F.lit(c).alias("key"), pair(c).alias("value"))) for c in columns])))
    both = F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull()
    kind = F.when(F.col(f"o.{key}").isNull(), "create").when(F.col(f"n.{key}").isNull(), "delete")
    out = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), kind.alias("kind"), F.when(both, changes).alias("modified"))
    return out.withColumn("kind", F.coalesce("kind", F.when(F.size("modified") > 0, "update").otherwise("unchanged")))


def important(modified: str, critical: list[str]) -> Column:
    """The critical columns among those that changed."""
    return F.filter(F.map_keys(modified), lambda k: k.isin(critical))


def decide(queue: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """A review queue with decisions applied: accepted and rejected rows change their status, others wait."""
    d = decisions.select(key, "decision").dropDuplicates([key])
    status = F.when(F.col("decision") == "accept", "approved").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status"))
    return queue.join(d, key, "left").withColumn("status", status).drop("decision")


def enriched(df: DataFrame, columns: dict[str, str], overwrite: bool = False) -> DataFrame:
    """Columns filled from suggestions where they are unknown, or always."""
    unknown = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")).isin("", "unknown", "tier_unknown", "none")
    return df.withColumns({c: F.coalesce(F.when(F.lit(overwrite) | unknown(c), F.col(s)), F.col(c)) for c, s in columns.items()})


def diff_summary(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, type (create, update, delete) and how many fields came, went, changed and stayed; a field that both lack is none."""
    o, n = old.alias("o"), new.alias("n")
    columns = [c for c in old.columns if c in new.columns and c != key]
    kind = lambda c: F.when(F.col(f"o.{c}").isNull() & F.col(f"n.{c}").isNull(), "none").when(F.col(f"o.{c}").isNull(), "added").when(F.col(f"n.{c}").isNull(), "removed").when(F.col(f"o.{c}") == F.col(f"n.{c}"), "unchanged").otherwise("modified")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    out = both.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), F.when(F.col(f"o.{key}").isNull(), "create").when(F.col(f"n.{key}").isNull(), "delete").otherwise("update").alias("type"), F.array(*map(kind, columns)).alias("_kinds"))
    count = lambda *names: sum((F.size("_kinds") - F.size(F.array_remove("_kinds", x)) for x in names), F.lit(0)).cast("long")
    return out.select(key, "type", *[count(x).alias(f"{x}_count") for x in ("added", "modified", "removed", "unchanged")], count("added", "modified", "removed").alias("total_changes"))


RECORD = "struct<text: string, reviewed: boolean, variant: string, review_status: string, reviewed_by: string, reviewed_at: string, timestamp: string>"


def reviewed_translation(suggested: Column, reviewed: Column, mode: Column, action: Column, reviewer: Column, now: Column) -> Column:
    """A plain-language translation after its review: (suggested, reviewed, error), records as ``RECORD``.

    Approval makes the suggestion, or else the record that is reviewed already, the reviewed one; rejection only marks the
    suggestion.  Both records stay as they are with an error: without any record, or for another action or mode.
    """
    source = F.coalesce(suggested, reviewed)
    error = F.when(~F.coalesce(mode.isin("einfach", "leicht"), F.lit(False)), F.concat(F.lit("unsupported mode: "), F.coalesce(mode, F.lit(""))))
    error = F.coalesce(error, F.when(~F.coalesce(action.isin("approve", "reject"), F.lit(False)), F.concat(F.lit("unsupported action: "), F.coalesce(action, F.lit("")))), F.when(source.isNull(), F.concat(F.lit("no "), mode, F.lit(" translation"))))

    def marked(record: Column, status: Column, stamp: Column) -> Column:
        by = F.coalesce(F.nullif(reviewer, F.lit("")), record["reviewed_by"])
        return F.struct(record["text"].alias("text"), (status == "approved").alias("reviewed"), mode.alias("variant"), status.alias("review_status"), by.alias("reviewed_by"), now.alias("reviewed_at"), stamp.alias("timestamp"))

    status = F.when(action == "approve", "approved").otherwise("rejected")
    fine = error.isNull()
    new_suggested = F.when(fine & suggested.isNotNull(), marked(suggested, status, suggested["timestamp"])).otherwise(suggested)
    new_reviewed = F.when(fine & (action == "approve"), marked(source, status, now)).otherwise(reviewed)
    return F.struct(new_suggested.alias("suggested"), new_reviewed.alias("reviewed"), error.alias("error"))


def promotion(existing: DataFrame, candidates: DataFrame, reason: Column, title_most: int = 500, content_most: int = 500_000) -> DataFrame:
    """What promoting ``candidates`` into ``existing`` (both id, domain, url, title, content, iqs, ais, ...) does in each domain.

    ``reason`` says of each candidate why it isn't promoted, or ``accepted``.  A candidate takes the place of the entry with its
    URL if either score is greater.  Of several candidates with one URL the one with the best scores counts, and the others
    are promoted no more than that one; entries without a URL or too large are dropped.
    """
    score = lambda c: F.coalesce(c, F.lit(0.0))
    at = F.lower(F.regexp_replace(F.trim("url"), "/+$", ""))
    told = candidates.withColumns({"_reason": reason, "_at": at})
    counts = told.groupBy("domain").agg(F.count("*").alias("candidates"))
    rejected = told.where("_reason <> 'accepted'").groupBy("domain", "_reason").agg(F.count("*").alias("n"))
    rejected = rejected.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_reason", "n"))), ",").alias("rejected"))
    order = F.struct(score(F.col("ais")), score(F.col("iqs")), "id")
    best = told.where("_reason = 'accepted' and coalesce(_at, '') <> ''").groupBy("domain", "_at").agg(F.max_by(F.struct("ais", "iqs"), order).alias("new"))
    big = F.coalesce((F.length("title") > title_most) | (F.length(F.trim("content")) > content_most), F.lit(False))
    kept = existing.withColumns({"_at": at, "_big": big})
    sizes = kept.groupBy("domain").agg(F.count("*").alias("existing"), F.count_if((F.coalesce("_at", F.lit("")) != "") & F.col("_big")).alias("dropped_existing"))
    old = kept.where("not _big and coalesce(_at, '') <> ''").groupBy("domain", "_at").agg(F.max_by(F.struct("ais", "iqs"), "id").alias("old"))
    both = old.join(best, ["domain", "_at"], "full")
    better = F.col("old").isNull() | (score(F.col("new.ais")) > score(F.col("old.ais"))) | (score(F.col("new.iqs")) > score(F.col("old.iqs")))
    merged = both.groupBy("domain").agg(F.count("*").alias("total_after_merge"), F.count_if(F.col("new").isNotNull() & better).alias("promoted"))
    out = sizes.join(counts, "domain", "full").join(merged, "domain", "left").join(rejected, "domain", "left")
    return out.select("domain", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("existing", "candidates", "promoted", "total_after_merge", "dropped_existing")], F.coalesce("rejected", F.lit("")).alias("rejected"))


def most_common(df: DataFrame, lists: dict[str, Column], most: int = 15) -> DataFrame:
    """(kind, value, n, place): the ``most`` most frequent values of each list column, ties in the order of values: the feature."""
    named = [F.transform(F.coalesce(c, F.array().cast("array<string>")), _named(kind)) for kind, c in lists.items()]
    counts = df.select(F.explode(F.flatten(F.array(*named))).alias("v")).where("v.value is not null").groupBy("v.kind", "v.value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.col("n").desc(), "value")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).withColumn("place", F.col("place").cast("long"))


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))
