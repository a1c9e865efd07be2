"""Reviews and overrides as the fold of an append-only log.

Every change is an event with a number that orders it; nothing is updated in place.  What holds at any time is a fold by
key over the events up to then, made of sums and largest values, so Spark adds up before it shuffles and a case that is seen
very often is no single task.  The log itself is the audit: ``audited`` says for every event what it did.

Events (``EVENT``): ``seen`` counts a query that no scenario fits; ``created`` makes an override from a trigger to a target
and settles the case it names; ``disabled`` ends an override; ``applied`` counts its use.

Edge cases: ``created`` without trigger or target, a second ``created`` of an override, and ``disabled`` or ``applied`` of one
that isn't created yet change nothing and are audited as ``refused``.  Blank notes, reviewers and cases count as not given.
Empty logs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.discovery import scenario_text

EVENT = "seq long, at timestamp, action string, case_id string, override_id string, query string, reasons array<string>, trigger_text string, target string, reviewer string, note string"


def _given(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _latest(value: Column, when: Column | None = None) -> Column:
    """The last value by number that is given."""
    some = value.isNotNull() if when is None else when & value.isNotNull()
    return F.max(F.when(some, F.struct("seq", value.alias("v"))))["v"]


def until(log: DataFrame, at: Column | None) -> DataFrame:
    """The events up to a time; all of them without one."""
    return log if at is None else log.where(F.col("at") <= at)


def _births(log: DataFrame) -> DataFrame:
    """The first event that creates each override."""
    valid = (F.col("action") == "created") & _given("trigger_text").isNotNull() & _given("target").isNotNull() & _given("override_id").isNotNull()
    fields = F.struct("seq", "at", _given("trigger_text").alias("trigger_text"), F.lower(_given("target")).alias("target"), _given("reviewer").alias("reviewer"), _given("note").alias("note"), _given("case_id").alias("case_id"))
    return log.where(valid).groupBy("override_id").agg(F.min(fields).alias("born"))


def overrides(log: DataFrame, at: Column | None = None) -> DataFrame:
    """Each override as it stands: what it says, active or disabled, when that changed, how often it was applied."""
    events = until(log, at)
    born = _births(events)
    later = events.where("action in ('disabled', 'applied')").select("override_id", "seq", "at", "action", _given("note").alias("said"))
    # Whether an event comes after its override's creation is known by the smallest number only, so that is joined first.
    known = later.join(born.select("override_id", F.col("born.seq").alias("first")), "override_id").where("seq > first")
    ended, used = F.col("action") == "disabled", F.col("action") == "applied"
    counts = known.groupBy("override_id").agg(F.max(F.when(ended, F.col("at"))).alias("ended_at"), _latest(F.col("said"), ended).alias("said"), F.count_if(used).alias("applied_count"), F.max(F.when(used, F.col("at"))).alias("last_applied_at"))
    rows = born.join(counts, "override_id", "left")
    return rows.select(
        "override_id", "born.trigger_text", scenario_text(F.col("born.trigger_text")).alias("normalized_trigger_text"), F.col("born.target").alias("target"), F.coalesce("said", "born.note").alias("note"), "born.reviewer",
        F.when(F.col("ended_at").isNull(), "active").otherwise("disabled").alias("status"), F.col("born.at").alias("created_at"), F.coalesce("ended_at", "born.at").alias("updated_at"), F.coalesce("applied_count", F.lit(0)).alias("applied_count"), "last_applied_at",
    )


def cases(log: DataFrame, at: Column | None = None) -> DataFrame:
    """Each case as it stands: how often it was seen, first and last, and whether an override has settled it."""
    events = until(log, at).where(_given("case_id").isNotNull())
    seen = events.where("action = 'seen'").groupBy("case_id").agg(_latest(_given("query")).alias("query"), _latest(F.col("reasons")).alias("reasons"), F.count("*").alias("occurrence_count"), F.min("at").alias("first_seen"), F.max("at").alias("seen_at"), F.min("seq").alias("first"))
    born = _births(until(log, at)).select("born.*").where("case_id is not null")
    # An override that names a case before it is seen finds none to settle.
    settled = born.join(seen.select("case_id", "first"), "case_id").where("seq > first").groupBy("case_id").agg(F.max(F.struct("seq", "at", "note", "reviewer")).alias("by"))
    rows = seen.join(settled, "case_id", "left")
    return rows.select(
        "case_id", "query", "reasons", "occurrence_count", "first_seen", F.greatest("seen_at", "by.at").alias("last_seen"), F.when(F.col("by").isNull(), "open").otherwise("resolved").alias("resolved_status"),
        F.col("by.note").alias("resolution_notes"), F.col("by.reviewer").alias("resolved_by"), F.col("by.at").alias("resolved_at"),
    )


def validity(log: DataFrame) -> DataFrame:
    """(override_id, normalized_trigger_text, target, since, until): when each override holds; until is null while it does."""
    born = _births(log)
    first_end = log.where("action = 'disabled'").join(born.select("override_id", F.col("born.seq").alias("first")), "override_id").where("seq > first").groupBy("override_id").agg(F.min("at").alias("until"))
    return born.join(first_end, "override_id", "left").select("override_id", scenario_text(F.col("born.trigger_text")).alias("normalized_trigger_text"), "born.target", F.col("born.at").alias("since"), "until")


def as_of(asked: DataFrame, trigger: str, at: str, log: DataFrame) -> DataFrame:
    """``asked`` with the override (its id and target) of each row's trigger that held at its time; the newest if there are several, null if none."""
    held = validity(log).select(F.col("normalized_trigger_text").alias("_text"), F.col("override_id").alias("_id"), F.col("target").alias("_target"), "since", "until")
    key = scenario_text(F.col(trigger))
    inside = (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    # Distinct questions meet the intervals, so a question that is asked very often is one row there.
    distinct = asked.select(key.alias("_key"), F.col(at).alias("_at")).distinct()
    best = distinct.join(held, (F.col("_key") == F.col("_text")) & inside).groupBy("_key", "_at").agg(F.max(F.struct("since", "_id", "_target")).alias("_best"))
    out = asked.withColumns({"_k": key, "_t": F.col(at)}).join(best, (F.col("_k") == F.col("_key")) & (F.col("_t") == F.col("_at")), "left")
    return out.select(*asked.columns, F.col("_best._id").alias("override_id"), F.col("_best._target").alias("target"))


def audited(log: DataFrame) -> DataFrame:
    """Every event but sightings with what it did: created, disabled, applied, or refused."""
    born = _births(log).select(F.col("override_id").alias("_id"), F.col("born.seq").alias("_first"))
    rows = log.where("action <> 'seen'").join(born, F.col("override_id") == F.col("_id"), "left")
    after = F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))
    done = F.when(F.col("action") == "created", F.coalesce(F.col("seq") == F.col("_first"), F.lit(False))).otherwise(after)
    return rows.select("seq", F.col("at").alias("timestamp"), F.when(done, F.concat(F.lit("life_event_override_"), "action")).otherwise("refused").alias("action"), F.coalesce(_given("reviewer"), F.lit("admin")).alias("user_id"), F.when(F.col("action") == "created", _given("case_id")).alias("entry_id"), "override_id")
