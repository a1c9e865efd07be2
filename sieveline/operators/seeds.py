"""Seeds against guardrails and the URL registry, alias chains to their ends, and the registry's state after its events.

A registry row is a URL's state: url, source, status, checked (the last event's number), final_url, canonical_url, reason,
status_code, fail_count, skip.  An event brings some of these; ``after`` folds any number of events into the state, and
``streaming.registry`` does the same for a stream.

Edge cases: URLs that can't be normalised have no state and are no seeds.  Null flags count as not stated.  Rows that
repeat are events or seeds like others.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import text as fx
from sieveline.operators.discovery import TERMINAL
from sieveline.session import scratch, stash

#: Failures in a row from which a URL is skipped.
FAILURES = 3
#: Events of a URL, by number, that one task orders.
BLOCK = 4096
STATE = "url string, source string, status string, checked long, final_url string, canonical_url string, reason string, status_code int, fail_count long, skip boolean"
EVENT = "url string, seq long, source string, status string, final_url string, canonical_url string, reason string, status_code int, skip boolean"


@dataclass(frozen=True)
class Guard:
    """What isn't crawled: whole URLs, hosts, hosts with all below them, and parts of URLs.  Configuration, so of bounded size."""

    urls: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    words: tuple[str, ...] = field(default=())

    def reason(self, url: Column) -> Column:
        """Why a normalised URL is stopped, the most exact rule first; null if it isn't."""
        host = fx.host(url)
        anyone = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
        return F.coalesce(
            F.when(url.isin(*self.urls), "exact_url_blocklist") if self.urls else F.lit(None),
            F.when(host.isin(*[h.lower().removeprefix("www.") for h in self.hosts]), "blocked_host") if self.hosts else F.lit(None),
            F.when(anyone(fx.under(host, F.lit(s.lower())) for s in self.suffixes), "blocked_host_suffix"),
            F.when(anyone(F.contains(F.lower(url), F.lit(w.lower())) for w in self.words), "blocked_url_token"),
        )


def chain_ends(links: DataFrame) -> DataFrame:
    """(url, target): where each alias (url, target) ends if its target's target and so on is followed.

    Every round doubles how far all aliases look, so a chain of n takes log n joins.  Of several targets of a URL the
    first in order counts.  Aliases that lead to a cycle have no end and no row.  Inside ``scratch`` the rounds' tables go.
    """
    links = links.where("url is not null and target is not null and url <> target")
    now = stash(links.groupBy("url").agg(F.min("target").alias("target")), "aliases", sweep=False)
    before = None
    while True:
        via = now.select(F.col("url").alias("via"), F.col("target").alias("further"))
        step = stash(now.join(via, F.col("target") == F.col("via"), "left").select("url", F.coalesce("further", "target").alias("target"), F.col("via").isNotNull().alias("open")), "aliases", sweep=False)
        still = step.where("open").count()
        if still in (0, before):  # none left, or only cycles: an open chain would have lost its last open link
            return step.where("not open").select("url", "target")
        now, before = step.drop("open"), still


def preferred(registry: DataFrame, whole: bool = True) -> DataFrame:
    """(url, target): the URL that the registry prefers to another, at the end of its chain or, without ``whole``, the next one."""
    target = F.coalesce(F.nullif("canonical_url", F.lit("")), F.nullif("final_url", F.lit("")))
    links = registry.select("url", target.alias("target")).where("target is not null and target <> url")
    return chain_ends(links) if whole else links.groupBy("url").agg(F.min("target").alias("target"))


def judged(seeds: DataFrame, registry: DataFrame, guard: Guard, hosts: tuple[str, ...] = (), whole: bool = True) -> DataFrame:
    """Each distinct URL of the enabled ``seeds`` (url, enabled, file, place, ...) and what becomes of it.

    url: as normalised; first: the seed that names it first by file and place; outcome: ``kept``, ``skipped`` (by the
    registry), or why the guard stops it; target: the URL that is crawled for it.  ``hosts`` limits seeds to hosts and
    what is below them.  ``registry`` has a row for each URL.
    """
    with scratch(seeds.sparkSession) as keep:
        named = seeds.withColumn("_url", fx.canonical_url(F.trim("url"))).where("_url is not null and coalesce(enabled, true)")
        if hosts:
            named = named.where(reduce(lambda a, b: a | b, (fx.under(fx.host(F.col("_url")), F.lit(h.lower())) for h in hosts)))
        # A URL that very many seeds name is one row before anything is joined.
        first = named.groupBy(F.col("_url").alias("url")).agg(F.min(F.struct("file", "place", *[F.col(c).alias("seed" if c == "url" else c) for c in seeds.columns if c not in ("file", "place")])).alias("first"))
        closed = [F.col("status").isin(*TERMINAL), F.col("skip"), (F.col("canonical_url") != "") & (F.col("canonical_url") != F.col("url"))]
        known = registry.select(F.col("url").alias("known"), reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in closed)).alias("closed"))
        ends = preferred(registry, whole).select(F.col("url").alias("alias"), "target")
        rows = first.join(known, F.col("url") == F.col("known"), "left").join(ends, F.col("url") == F.col("alias"), "left")
        outcome = F.coalesce(guard.reason(F.col("url")), F.when(F.col("closed"), "skipped"), F.lit("kept"))
        return keep(stash(rows.select("url", "first", outcome.alias("outcome"), F.coalesce("target", "url").alias("target")), "judged", sweep=False))


def kept(rows: DataFrame) -> DataFrame:
    """The seeds of ``judged`` that are crawled: of all that lead to one URL the first by file and place."""
    return rows.where("outcome = 'kept'").groupBy(F.col("target").alias("url")).agg(F.min("first").alias("first")).select("url", "first.*")


def recorded(rows: DataFrame) -> DataFrame:
    """What the registry learns from ``judged``: URLs that the guard stopped, and aliases with the URL they stand for."""
    stopped = ~F.col("outcome").isin("kept", "skipped")
    alias = (F.col("outcome") == "kept") & (F.col("target") != F.col("url"))
    return rows.where(stopped | alias).select(
        "url", F.lit("seed_scan").alias("source"), F.when(stopped, "invalid_url").otherwise("canonical_alias").alias("status"), F.lit(None).cast("string").alias("final_url"),
        F.when(alias, F.col("target")).alias("canonical_url"), F.when(stopped, F.concat(F.lit("guardrail_"), "outcome")).otherwise("preferred_url_from_registry").alias("reason"),
        F.lit(None).cast("int").alias("status_code"), F.lit(True).alias("skip"),
    )


def _blank(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def followed(events: DataFrame, old: DataFrame | None, block: int = BLOCK) -> DataFrame:
    """``events`` with run (failures since the last success) and target (the URL it stands for) of each.

    A URL's events are ordered block by block of their numbers: what a block hands to the next ones is one row, so a URL
    with very many events is no single task.
    """
    e = events.withColumns({"_block": F.floor(F.col("seq") / block), "_ok": F.col("status") == "ok", "_fail": (F.col("status") == "fetch_failed").cast("long"), "_canonical": _blank("canonical_url"), "_final": _blank("final_url")})
    inside = Window.partitionBy("url", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = lambda c: F.last(c, ignorenulls=True).over(inside)
    e = e.withColumns({"_fails": F.sum("_fail").over(inside), "_canonical": so_far("_canonical"), "_final": so_far("_final")})
    e = e.withColumn("_run", F.col("_fails") - F.coalesce(F.max(F.when(F.col("_ok"), F.col("_fails"))).over(inside), F.lit(0)))
    e = e.withColumn("_reset", F.max("_ok").over(inside))
    last = e.groupBy("url", "_block").agg(F.max_by(F.struct("_run", "_reset", "_canonical", "_final"), "seq").alias("end"))
    earlier = Window.partitionBy("url").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    given = last.select("url", "_block", "end.*") if old is None else last.select("url", "_block", "end.*").join(old.select("url", F.col("fail_count").alias("_old_run"), F.col("canonical_url").alias("_old_canonical"), F.col("final_url").alias("_old_final")), "url", "left")
    if old is None:
        given = given.withColumns({"_old_run": F.lit(0).cast("long"), "_old_canonical": F.lit(None).cast("string"), "_old_final": F.lit(None).cast("string")})
    total = given.withColumn("_sum", F.coalesce(F.sum("_run").over(earlier), F.lit(0)))
    # Sums grow, so the largest sum before a block that had a success is that of the last such block.
    base = F.max(F.when(F.col("_reset"), F.col("_sum"))).over(earlier)
    carry = total.select(
        "url", "_block", (F.col("_sum") - F.coalesce(base, F.lit(0)) + F.when(base.isNull(), F.coalesce("_old_run", F.lit(0))).otherwise(0)).alias("_in_run"),
        F.coalesce(F.last("_canonical", ignorenulls=True).over(earlier), F.nullif("_old_canonical", F.lit(""))).alias("_in_canonical"), F.coalesce(F.last("_final", ignorenulls=True).over(earlier), F.nullif("_old_final", F.lit(""))).alias("_in_final"),
    )
    out = e.join(carry, ["url", "_block"])
    target = F.coalesce("_canonical", "_in_canonical", "_final", "_in_final")
    return out.select(*events.columns, (F.col("_run") + F.when(F.col("_reset"), 0).otherwise(F.col("_in_run"))).alias("run"), F.when(target != F.col("url"), target).alias("target"))


def after(events: DataFrame, old: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The registry (``STATE``) after ``events`` (``EVENT``; seq is their order), from the rows of ``old`` if there is a registry already.

    ``FAILURES`` failures since the last success make a URL skipped, as do the final states; success ends that, and an
    event that states skip itself decides.  The URL that another stands for is registered too, as discovered.
    """
    rows = followed(events, old, block)
    over = (F.col("status") == "fetch_failed") & F.col("skip").isNull() & (F.col("run") >= FAILURES)
    rows = rows.withColumns(
        {
            "_reason": F.coalesce(_blank("reason"), F.when(over, "fetch_failed_threshold")),
            "_skip": F.coalesce("skip", F.when(over, True), F.when(F.col("status") == "ok", False), F.when(F.col("status").isin(*TERMINAL), True)),
        }
    )
    # Largest by number of those that say something: such sums are made before anything moves.
    latest = lambda c, value: F.max(F.when(value.isNotNull(), F.struct("seq", value.alias("v"))))["v"].alias(c)
    own = rows.groupBy("url").agg(
        latest("source", F.col("source")), latest("status", F.col("status")), F.max("seq").alias("checked"), latest("final_url", _blank("final_url")), latest("canonical_url", _blank("canonical_url")),
        latest("reason", F.col("_reason")), latest("status_code", F.col("status_code")), F.max_by("run", "seq").alias("fail_count"), latest("skip", F.col("_skip")),
    )
    named = rows.where("target is not null").groupBy(F.col("target").alias("url")).agg(F.min(F.struct("seq", "source")).alias("first"), F.max("seq").alias("named"))
    return combined(own, named, old)


def combined(own: DataFrame, named: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """One registry of what URLs had themselves (``own``: ``STATE``), where others named them (url, first, named) and the ``old`` state."""
    names = [c.split()[0] for c in STATE.split(", ")]
    both = own.join(named, "url", "full_outer")
    told = {c: F.col(c) for c in names[1:]}
    if old is not None:
        both = both.join(old.select("url", F.struct(*names[1:]).alias("old")), "url", "full_outer")
        told = {c: F.coalesce(c, f"old.{c}") for c in names[1:]}
        # Failures count on from the old state, which a success ends; a URL without events keeps its own.
        told["fail_count"] = F.when(F.col("status").isNull(), F.col("old.fail_count")).otherwise(F.col("fail_count"))
    told["checked"] = F.greatest("named", *([F.col("checked")] if old is None else [F.col("checked"), F.col("old.checked")]))
    told["source"] = F.coalesce(told["source"], "first.source")
    told["status"] = F.coalesce(told["status"], F.lit("discovered"))
    told["skip"] = F.coalesce(told["skip"], F.when(F.col("named").isNotNull(), False))
    told["fail_count"] = F.nullif(told["fail_count"], F.lit(0))
    return both.select("url", *[c.alias(n) for n, c in told.items()])
