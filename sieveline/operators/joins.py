"""Joins between entries, registries, seeds and rule tables.

Rule tables are small by nature; ``rules`` broadcasts one only after counting that it is.  Suffix joins expand a host
to the domains above it and join by equality, so they never compare all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sieveline.functions.batches import ROWS, expanded, slices
from sieveline.session import scratch, ship, stash

#: Most rows that a rule table may have to be broadcast.
RULES = 100_000


def rules(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most RULES rows, else as it is."""
    return F.broadcast(df) if df.limit(RULES + 1).count() <= RULES else df


def domains_above(host: Column) -> Column:
    """A host and the domains above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def by_suffix(df: DataFrame, host: str, profiles: DataFrame, profile_host: str, order: list[Column], keys: list[str]) -> DataFrame:
    """Each row with the best profile whose host is its own or above it; null columns if none is."""
    wide = df.select(*df.columns, F.explode_outer(domains_above(F.col(host))).alias("_above"))
    joined = wide.join(profiles, wide["_above"] == profiles[profile_host], "left")
    first = Window.partitionBy(*keys).orderBy(F.col(profile_host).isNull(), *order)
    return joined.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_above")


def classify(candidates: DataFrame, existing: DataFrame, key: str = "url") -> DataFrame:
    """Candidates with action create or update; of several existing rows with a key the last by id counts."""
    last = existing.groupBy(key).agg(F.max_by("id", "id").alias("existing_id"))
    return candidates.join(last, key, "left").withColumn("action", F.when(F.col("existing_id").isNull(), "create").otherwise("update"))


def merge_better(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge by key; a new row replaces the old one if either of its scores is greater."""
    o, n = old.alias("o"), new.alias("n")
    score = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0.0))
    better = F.col(f"o.{key}").isNull() | (F.col(f"n.{key}").isNotNull() & ((score("n", "ais") > score("o", "ais")) | (score("n", "iqs") > score("o", "iqs"))))
    outcome = F.when(F.col(f"o.{key}").isNull(), "added").when(better, "replaced").otherwise("kept")
    picked = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), *[F.when(better, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*picked, outcome.alias("outcome"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str], take: list[str]) -> DataFrame:
    """Insert or update by key: ``keep`` columns stay as they were, ``take`` columns are the new ones where given."""
    o, n = old.alias("o"), new.alias("n")
    cols = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in [key, *keep]] + [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in take]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*cols)


def insert_new(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``df`` and the rows of ``more`` whose key it lacks."""
    return df.unionByName(more.join(df.select(key), key, "left_anti"))


def word_overlap(asked: DataFrame, found: DataFrame, item: str, doc: str, words: Column) -> DataFrame:
    """(item, doc, ratio) for each row of ``asked`` and each of ``found`` that share a word: the share of the item's
    distinct words that the document has.  The words of the items are broadcast if they are few; pairs without a
    common word are never made.
    """
    a = asked.select(F.col(item), F.monotonically_increasing_id().alias("_a"), words.alias("_w"))
    a = a.select(item, "_a", F.size("_w").alias("_size"), F.explode("_w").alias("_word"))
    d = found.select(F.col(doc), F.monotonically_increasing_id().alias("_d"), words.alias("_w")).select(doc, "_d", F.explode("_w").alias("_word"))
    hits = d.join(rules(a), "_word").groupBy(item, "_a", "_size", doc, "_d").agg(F.count("*").alias("_hits"))
    return hits.select(item, doc, (F.col("_hits") / F.col("_size")).alias("ratio"))


def _contained(asked: list[tuple[int, list[str]]], least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (document, words) to (document, item, ratio) of the pairs that reach ``least``: the items' words are
    looked up in all texts of a slice at once, and what each text has of each item is counted.
    """
    numbers, sizes = np.array([n for n, _ in asked], np.int64), np.array([len(w) for _, w in asked], np.int64)
    place = {w: i for i, w in enumerate(sorted({w for _, ws in asked for w in ws}))}
    held = sorted((place[w], i) for i, (_, ws) in enumerate(asked) for w in ws)
    starts = np.searchsorted(np.array([w for w, _ in held], np.int64), np.arange(len(place) + 1))
    items = np.array([i for _, i in held], np.int64)
    rows = max(1, min(ROWS, (1 << 22) // max(len(held), 1)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(place), pa.string())
        for batch in batches:
            for part in slices(batch, rows):
                words = part.column(1)
                at = pc.fill_null(pc.index_in(words.flatten(), known), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
                where, item = expanded(at[at >= 0], starts, items)
                hits = np.bincount(row[at >= 0][where] * len(sizes) + item, minlength=len(words) * len(sizes)).reshape(-1, len(sizes))
                ratio = hits / sizes
                doc, item = np.nonzero((hits > 0) & (ratio >= least))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(numbers[item]), pa.array(ratio[doc, item])], names=["_doc", "_a", "ratio"])

    return match


def word_containment(asked: DataFrame, found: DataFrame, item: str, doc: str, words: Column, least: float) -> DataFrame:
    """(item, doc, ratio) of the pairs in which the document has at least ``least`` (above 0) of the item's distinct words.

    If the items' words are few (RULES), tasks hold them and count them in each document where it stands; nothing but the
    result moves.  Else, of n words a document may lack n - ceil(least * n), so it has one of the n - ceil(least * n) + 1 that
    fewest documents have: documents look for those only, and the pairs that this finds are compared in full, so common
    words make no pairs.  Rows that repeat are compared each.  Null and empty texts are in no pair.
    """
    spark = asked.sparkSession
    a = asked.select(F.col(item).alias("_item"), F.monotonically_increasing_id().alias("_a"), words.alias("_asked")).where(F.size("_asked") > 0)
    d = found.select(F.col(doc).alias("_doc"), words.alias("_found")).where("_found is not null")
    with scratch(spark) as keep:
        a = stash(a, "asked", sweep=False)  # the rows' numbers are settled by being written
        if a.select(F.explode("_asked")).limit(RULES + 1).count() <= RULES:
            ship(spark)
            kind = T.StructType([d.schema["_doc"], T.StructField("_a", T.LongType()), T.StructField("ratio", T.DoubleType())])
            pairs = d.mapInArrow(_contained([(r[0], r[1]) for r in a.select("_a", "_asked").collect()], least), kind)
            named = pairs.join(F.broadcast(a.select("_a", "_item")), "_a").select(F.col("_item").alias(item), F.col("_doc").alias(doc), "ratio")
            return keep(stash(named, "containment", sweep=False))
        each = a.select("_a", F.explode("_asked").alias("_word"), (F.size("_asked") - F.ceil(F.size("_asked") * least) + 1).alias("_some"))
        often = d.select(F.explode("_found").alias("_word")).join(rules(each.select("_word").distinct()), "_word").groupBy("_word").agg(F.count("*").alias("_n"))
        rare = Window.partitionBy("_a").orderBy(F.coalesce("_n", F.lit(0)), "_word")
        prefix = stash(each.join(often, "_word", "left").withColumn("_place", F.row_number().over(rare)).where("_place <= _some").groupBy("_word").agg(F.collect_set("_a").alias("_items")), "prefix", sweep=False)
        # Words don't travel with the candidates: those are a document's items by its id, and rows that share an id try them all.
        met = d.select("_doc", F.explode("_found").alias("_word")).join(rules(prefix), "_word").select("_doc", F.explode("_items").alias("_a")).distinct()
        tried = met.groupBy(F.col("_doc").alias("_id")).agg(F.collect_list("_a").alias("_tried"))
        share = F.size(F.array_intersect("_asked", "_found")) / F.size("_asked")
        each_pair = d.join(tried, F.col("_doc").eqNullSafe(F.col("_id"))).select("_doc", "_found", F.explode("_tried").alias("_a"))
        pairs = each_pair.join(rules(a), "_a").select(F.col("_item").alias(item), F.col("_doc").alias(doc), share.alias("ratio"))
        return keep(stash(pairs.where(F.col("ratio") >= least), "containment", sweep=False))


def resolved_source(df: DataFrame, host: str, domain: str, profiles: DataFrame, inferred: Column) -> DataFrame:
    """``df`` with source_id, tier and how it is known: the registered source of the row's domain whose host is its own or above it, or one inferred from the host.

    profiles: source_id, host, tier, priority, domains.  Official sources come first, then organisations, then high priority, then the
    shorter host; ids settle ties.  ``inferred`` is the tier that the host itself says, null if it says none.  Rows without either
    have nulls.  Distinct pairs of host and domain are resolved once, so a host with very many rows is asked for once.
    """
    pairs = df.where(F.coalesce(host, F.lit("")) != "").select(F.col(host).alias("_host"), F.col(domain).alias("_domain")).distinct()
    above = pairs.select("_host", "_domain", F.explode(domains_above(F.col("_host"))).alias("_at"))
    p = profiles.select(F.col("host").alias("_at"), "source_id", "tier", "priority", F.explode("domains").alias("_domain")).distinct()
    order = F.struct(F.when(F.col("tier") == "tier_1_official", 0).when(F.col("tier") == "tier_2_ngo_watchdog", 1).otherwise(2).alias("a"), F.when(F.col("priority") == "high", 0).otherwise(1).alias("b"), F.length("_at").alias("c"), F.col("source_id").alias("d"))
    best = above.join(p, ["_at", "_domain"]).groupBy("_host", "_domain").agg(F.min_by(F.struct("source_id", "tier"), order).alias("_best"))
    out = df.join(best, (F.col(host) == F.col("_host")) & F.col(domain).eqNullSafe(F.col("_domain")), "left")
    guess = F.when(F.coalesce(F.col(host), F.lit("")) != "", inferred)
    known, told = F.col("_best").isNotNull(), guess.isNotNull()
    return out.select(*df.columns, F.when(known, F.col("_best.source_id")).when(told, F.replace(F.col(host), F.lit("."), F.lit("_"))).alias("source_id"), F.when(known, F.col("_best.tier")).otherwise(guess).alias("source_tier"), F.when(known, "registered").when(told, "inferred").alias("source_status"))


def with_extension(entries: DataFrame, tables: dict[str, DataFrame], key: str = "id", domain: str = "domain") -> DataFrame:
    """``entries`` with ``extension``: the row of the table of their domain as JSON without its key, null where there is none.

    Tables have a row for each key and columns of their own; an entry meets only the table of its domain.
    """
    rows = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("_domain"), F.col(key).alias("_key"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("extension"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return entries.withColumn("extension", F.lit(None).cast("string"))
    return entries.join(rows, (F.col(domain) == F.col("_domain")) & (F.col(key) == F.col("_key")), "left").drop("_domain", "_key")


def upsert_extended(old: DataFrame, tables: dict[str, DataFrame], new: DataFrame, extensions: dict[str, DataFrame], keep: list[str], take: list[str], key: str = "id", domain: str = "domain") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Entries and the extension tables of their domains after an upsert: (entries, tables).

    A new row takes the place of the old one with its key, but for the columns of ``keep``.  Its extension row replaces the one
    in its domain's table as a whole; an entry that has changed its domain leaves the table of the old one.
    """
    entries = upsert(old, new, key, keep, [domain, *take])
    out = {}
    for name in tables.keys() | extensions.keys():
        before, fresh = tables.get(name), extensions.get(name)
        mine = new.where(F.col(domain) == name).select(key)
        fresh = None if fresh is None else fresh.join(mine, key, "left_semi")
        if before is None:
            out[name] = fresh
            continue
        gone = new.where(F.col(domain) != name).select(key)
        gone = gone if fresh is None else gone.unionByName(fresh.select(key))
        kept = before.join(gone, key, "left_anti")
        out[name] = kept if fresh is None else kept.unionByName(fresh)
    return entries, out
