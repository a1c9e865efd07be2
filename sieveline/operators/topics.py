"""Topics and the sources they prefer: URL scores with reasons, discovery reports, and seed manifests.

Topics are configuration, a tuple of ``Topic``; sources are a table (source_id, host, name, tier, institution, groups) with a row for
each host of a source.  A URL meets the sources of its host and of the domains above it by equality, once for each distinct
host, so no source is tried on every URL and a host with very many URLs is asked for once.

Edge cases: URLs without a host have no source and can still score by their words; null URLs have no score.  Of several rows
of one URL in a domain one counts.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as fx
from sieveline.operators.joins import domains_above
from sieveline.operators.ranking import first_of

#: Parts of URLs that are never candidates.
NEVER = ("/impressum", "/datenschutz", "/privacy", "/cookie", "/rss", "/aktuelles", "/presse", "/meta/", "/gebaerdensprache")
#: Points by a preference's priority, by the tier of any other known source, for kinds of pages, and the least that counts.
PRIORITIES, OTHER_PRIORITY = {"critical": 65, "high": 48, "medium": 32}, 20
TIERS = {"tier_1_official": (26, "tier:official"), "tier_2_ngo_watchdog": (18, "tier:ngo")}
KINDS = ((("/lexikon/",), 24, "type:glossary"), (("/leichte-sprache",), 22, "type:light_language"), (("/kontakt/", "kontaktformular", "buergertelefon"), 18, "type:contact"), (("studie",), 12, "type:study"))
SEED, PATH, NO_PATH, KEYWORD, KEYWORDS_MOST, ASKED, LEAST = 50, 18, -8, 8, 36, -6, 20
#: Tags of a source's role, and the topic that a domain's seeds have besides.
ROLE_TAGS = {"official_glossary_source": ("glossary",), "official_contact_source": ("contact",), "official_light_language_source": ("light_language",)}
DOMAIN_TOPICS = {"benefits": "financial_support", "contacts": "contacts"}


@dataclass(frozen=True)
class Preference:
    """A source that a topic prefers."""

    source_id: str
    role: str
    priority: str = "medium"
    patterns: tuple[str, ...] = ()
    seeds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Topic:
    topic_id: str
    name: str
    domains: tuple[str, ...]
    keywords: tuple[str, ...] = ()
    sources: tuple[Preference, ...] = field(default=())


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words), F.lit(False))


def known_sources(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """``urls`` (url, ...) with ``host`` and ``known``: the sources of its host and of those above it, the nearest first."""
    hosted = urls.withColumn("host", fx.host(F.col("url")))
    above = hosted.select("host").where("host <> ''").distinct().select("host", F.posexplode(domains_above(F.col("host"))).alias("far", "at"))
    met = above.join(sources.select(F.lower(F.regexp_replace("host", "^www\\.", "")).alias("at"), "source_id", "name", "tier", "institution"), "at")
    listed = met.groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_set(F.struct("far", "source_id", "name", "tier", "institution"))).alias("known"))
    return hosted.join(listed, F.col("host") == F.col("_host"), "left").drop("_host")


def _scored(topic: Topic, url: Column, host: Column, known: Column, domain: Column) -> Column:
    """What a topic says of a URL: score, role, priority, source and reasons; null if that is too little."""
    low, nothing = F.lower(url), F.array().cast("array<string>")
    ids = F.coalesce(F.transform(known, lambda k: k["source_id"]), nothing)
    ranked = sorted(topic.sources, key=lambda p: {"critical": 0, "high": 1}.get(p.priority, 2))  # the first preference of the highest priority that the host has

    def by_preference(p: Preference) -> Column:
        hits = F.filter(F.array(*map(F.lit, p.patterns)).cast("array<string>"), lambda x: F.contains(low, F.lower(x)))
        points = F.lit(PRIORITIES.get(p.priority, OTHER_PRIORITY)) + F.when(url.isin(*p.seeds), SEED).otherwise(0) + PATH * F.size(hits) + F.when((F.size(hits) == 0) & F.lit(bool(p.patterns)), NO_PATH).otherwise(0)
        told = F.concat(F.array(F.lit(f"source:{p.source_id}"), F.lit(f"role:{p.role}")), F.when(url.isin(*p.seeds), F.array(F.lit("seed_url"))).otherwise(nothing), F.transform(hits, lambda x: F.concat(F.lit("path:"), x)))
        return F.struct(points.alias("points"), F.lit(p.role).alias("role"), F.lit(p.priority).alias("priority"), F.lit(p.source_id).alias("source_id"), told.alias("reasons"))

    near = F.get(known, F.lit(0))
    tier_points, tier_reason = F.lit(0), nothing
    for tier, (points, reason) in TIERS.items():
        tier_points, tier_reason = F.when(near["tier"] == tier, points).otherwise(tier_points), F.when(near["tier"] == tier, F.array(F.lit(reason))).otherwise(tier_reason)
    by_tier = F.struct(tier_points.alias("points"), F.lit("discovered").alias("role"), F.lit("normal").alias("priority"), F.coalesce(near["source_id"], host).alias("source_id"), tier_reason.alias("reasons"))
    source = F.coalesce(*[F.when(F.array_contains(ids, p.source_id), by_preference(p)) for p in ranked], by_tier)
    words = F.filter(F.array(*map(F.lit, topic.keywords)).cast("array<string>"), lambda k: F.contains(low, k))
    asked = F.contains(url, F.lit("?")) & ~url.endswith("?")
    kinds = [(_any(low, marks), points, reason) for marks, points, reason in KINDS] + [(asked, ASKED, "query_penalty")]
    score = source["points"] + F.least(F.lit(KEYWORDS_MOST), KEYWORD * F.size(words)) + sum((F.when(c, n).otherwise(0) for c, n, _ in kinds), F.lit(0))
    reasons = F.concat(
        F.array(F.concat(F.lit("domain:"), domain)), source["reasons"], F.when(F.size(words) > 0, F.array(F.concat(F.lit("keywords:"), F.array_join(F.slice(words, 1, 4), ",")))).otherwise(nothing),
        F.array_compact(F.array(*[F.when(c, reason) for c, _, reason in kinds])),
    )
    out = F.struct(F.lit(topic.topic_id).alias("topic"), score.cast("long").alias("score"), source["role"].alias("role"), source["priority"].alias("priority"), source["source_id"].alias("source_id"), reasons.alias("reasons"))
    return F.when(domain.isin(*topic.domains) & ~_any(low, NEVER) & (score >= LEAST), out)


def scored_urls(urls: DataFrame, topics: tuple[Topic, ...], sources: DataFrame) -> DataFrame:
    """(topic, domain, url, host, score, role, priority, source_id, reasons) of the URLs (url, domain) that a topic of their domain wants."""
    u = known_sources(urls.select(F.trim("url").alias("url"), "domain").where("url <> ''").distinct(), sources)
    each = F.array_compact(F.array(*[_scored(t, F.col("url"), F.col("host"), F.col("known"), F.col("domain")) for t in topics]))
    return u.select("url", "domain", "host", F.explode(each).alias("s")).select("s.topic", "domain", "url", "host", "s.score", "s.role", "s.priority", "s.source_id", "s.reasons")


def discovery_report(scored: DataFrame, top: int = 50) -> DataFrame:
    """Each topic with its number of distinct candidate URLs and the best ``top`` of them: the feature.

    A URL of several domains counts once, as in the domain where it does best.
    """
    order = F.struct((-F.col("score")).alias("less"), F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).otherwise(2).alias("class"), F.col("url").alias("u"), F.col("domain").alias("d"))
    best = scored.groupBy("topic", "url").agg(F.min(F.struct(order.alias("o"), "domain", "score", "role", "source_id")).alias("b"))
    counts = best.groupBy("topic").agg(F.count("*").alias("candidates"))
    # The best of each topic are cut before the shuffle, so a topic that nearly all URLs fit doesn't gather.
    leading = first_of(best.withColumn("_o", F.col("b.o")), ["topic"], ["_o"], top)
    listed = leading.groupBy(F.col("topic").alias("_topic")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "url"))), lambda x: x["url"]).alias("top"))
    return counts.join(listed, F.col("topic") == F.col("_topic")).select("topic", "candidates", "top")


def synced_seeds(existing: DataFrame, topics: tuple[Topic, ...], sources: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The seed manifests of all domains after the topics' seeds have come in.

    existing: domain, url, label, topics, tags, groups.  more: (source_id, url) that were found of a source besides, as in its
    sitemaps.  A seed keeps its label and the order of its topics, tags and groups; new ones follow, in the order of the
    topics and of their sources.  ``added`` says whether the seed is new, ``updates`` how often a topic has touched a seed that
    was there.
    """
    spark = existing.sparkSession
    rows = [(d, t.topic_id, t.name, p.source_id, p.role, i, j, k, u.strip()) for i, t in enumerate(topics) for d in t.domains for j, p in enumerate(t.sources) for k, u in enumerate(p.seeds) if u.strip()]
    kinds = "domain string, topic string, name string, source_id string, role string, i int, j int, k long, url string"
    given = spark.createDataFrame(rows, kinds)
    if more is not None:
        wanted = spark.createDataFrame([(d, t.topic_id, t.name, p.source_id, p.role, i, j) for i, t in enumerate(topics) for d in t.domains for j, p in enumerate(t.sources)], kinds.rsplit(", k", 1)[0])
        found = more.select("source_id", F.trim("url").alias("url")).where("url <> ''").distinct()
        given = given.unionByName(found.join(F.broadcast(wanted), "source_id").withColumn("k", F.lit(1 << 31)).select(*given.columns))
    profiles = sources.groupBy("source_id").agg(F.min("groups").alias("groups"))
    tags = F.concat(F.array("role"), F.coalesce(*[F.when(F.col("role") == r, F.array(*map(F.lit, more))) for r, more in ROLE_TAGS.items()], F.array().cast("array<string>")))
    extra = F.coalesce(*[F.when(F.col("domain") == d, F.array("topic", F.lit(x))) for d, x in DOMAIN_TOPICS.items()], F.array("topic"))
    slug = F.initcap(F.trim(F.translate(F.coalesce(F.try_element_at(fx.path_parts(F.col("url")), F.lit(-1)), fx.host(F.col("url"))), "-_", "  ")))
    told = given.join(profiles, "source_id", "left").select("domain", "url", "source_id", F.trim(F.concat_ws(" ", "name", slug)).alias("label"), extra.alias("topics"), tags.alias("tags"), F.coalesce("groups", F.array().cast("array<string>")).alias("groups"), "i", "j", "k")
    # A seed is named by at most each preference of each topic, so its list is bounded by the configuration.
    each = F.sort_array(F.collect_list(F.struct("i", "j", "k", "source_id", "label", "topics", "tags", "groups")))
    news = told.groupBy("domain", "url").agg(each.alias("new"))
    old = existing.select(F.col("domain").alias("_domain"), F.trim("url").alias("_url"), F.struct("label", "topics", "tags", "groups").alias("old")).where("_url <> ''").groupBy("_domain", "_url").agg(F.max("old").alias("old"))
    both = old.join(news, (F.col("domain") == F.col("_domain")) & (F.col("url") == F.col("_url")), "full")
    none = F.array().cast("array<string>")
    merged = lambda c: F.array_distinct(F.concat(F.coalesce(F.col(f"old.{c}"), none), F.coalesce(F.flatten(F.transform("new", lambda n: n[c])), none)))
    touched = F.coalesce(F.size("new"), F.lit(0))
    return both.select(
        F.coalesce("_domain", "domain").alias("domain"), F.coalesce("_url", "url").alias("url"), F.element_at("new", -1)["source_id"].alias("source_id"), F.coalesce(F.nullif("old.label", F.lit("")), F.get("new", F.lit(0))["label"]).alias("label"),
        *[merged(c).alias(c) for c in ("topics", "tags", "groups")], F.col("old").isNull().alias("added"), (touched - F.col("old").isNull().cast("int")).cast("long").alias("updates"),
    )
