"""Robots files, sitemaps, source reports, and what a page's words say of its kind; all built-in functions and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.functions import text as fx
from sieveline.operators.discovery import keyword_matches
from sieveline.session import scratch, stash

#: Words of contact pages.
CONTACT = ("kontakt", "telefon", "hotline", "sprechzeiten", "ansprechpartner", "servicecenter", "service-center", "servicetelefon", "email", "e-mail", "chat", "rufnummer", "erreichen-sie-uns", "helpdesk")
#: Words of aid in money, kinds of tools by words in their order, services by parts of hosts.
MONEY = ("geld", "zuschlag", "finanz", "leistung", "unterhalt", "buergergeld", "bürgergeld")
TOOLS = {"calculator": ("rechner", "calculator"), "application": ("antrag", "apply", "beantragen"), "job-search": ("jobsuche",), "checker": ("lotse", "check")}
SERVICES = {
    "arbeitsagentur": ("Arbeitsvermittlung", "Leistungsinformationen", "Familienkasse"),
    "bmas": ("Arbeit", "Soziales", "Buergerinformationen"),
    "bmbfsfj": ("Familie", "Jugend", "Gleichstellung"),
    "sanktionsfrei.de": ("Buergergeld-Beratung", "Sozialrechtsinformation", "Unterstuetzung bei Jobcenter-Themen"),
}
OTHER_SERVICES = ("Informationsangebote", "Service und Kontakt")
#: Weights of a source's role for a topic, of a preferred path, and of roles that an intent or a word asks for.
ROLES = {"official_rule_source": 4.0, "official_glossary_source": 3.5, "official_contact_source": 3.0, "official_light_language_source": 2.5, "official_background_source": 1.5, "ngo_context_source": 1.5, "journalism_source": 1.0}
OTHER_ROLE, PREFERRED_PATH = 0.5, 1.2
ROLE_EXTRAS = {"official_contact_source": ("contact", 2.0), "official_rule_source": ("application", 1.8), "official_glossary_source": ("glossary", 1.5), "official_light_language_source": ("light", 2.0)}
#: Scores of an entry for somebody without work.
JOBLESS_WORDS = {("buergergeld", "bürgergeld"): 4.0, ("arbeitslosengeld",): 3.5, ("jobcenter", "arbeitsagentur"): 2.5, ("kurzarbeitergeld",): -4.5, ("kurzarbeit",): -4.5}
JOBLESS_DOMAINS = {"benefits": 1.5, "tools": 1.0, "contacts": 0.5}
#: Hints of a crawl's report, in their order.
HINTS = {
    "fetch": "Investigate network, robots, or host restrictions for failed seeds.",
    "validation": "Validation failures occurred; inspect candidate field mapping before promoting entries.",
    "empty": "Improve summary/content extraction for thin or chrome-heavy pages.",
    "alias": "Refresh urls.json from preferred canonical URLs to reduce alias churn.",
    "reasons": "Use failure reasons to suppress noisy seeds or create manual-review candidates.",
    "quality": "Low-quality entries detected; prioritize those URLs for recrawl, manual cleanup, or extraction tuning.",
    "none": "No major crawl issues detected in this run.",
}

_sum = lambda terms: reduce(lambda a, b: a + b, terms)
_if = lambda condition, points: F.when(condition, F.lit(float(points))).otherwise(F.lit(0.0))


def robots(text: Column, origin: Column, agent: str) -> Column:
    """Struct of the paths that a robots file allows our agent and of its sitemaps, as URLs in the file's order."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    fields = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.when(F.contains(x, F.lit(":")), F.trim(F.regexp_replace(x, r"\A[^:]*:", ""))).otherwise("").alias("v")))
    full = lambda v: fx.canonical_url(F.when(v.rlike("^https?://"), v).otherwise(F.concat(origin, F.when(v.startswith("/"), "").otherwise("/"), v)))
    path = lambda v: F.regexp_replace(F.trim(F.regexp_replace(v, "#.*", "")), r"[*$]+\z", "")
    ours = lambda v: (v != "") & ((v == "*") | F.contains(F.lit(agent.lower()), F.lower(v)))
    start = F.expr("struct(false as ours, cast(array() as array<string>) as allowed, cast(array() as array<string>) as sitemaps)")

    def step(s: Column, x: Column) -> Column:
        k, v = x["k"], x["v"]
        add = lambda kept, new, test: F.when(test, F.concat(kept, F.array(new))).otherwise(kept)
        allowed = add(s["allowed"], full(path(v)), s["ours"] & (k == "allow") & path(v).startswith("/"))
        return F.struct(F.when(k == "user-agent", ours(v)).otherwise(s["ours"]).alias("ours"), allowed.alias("allowed"), add(s["sitemaps"], full(v), (k == "sitemap") & (v != "")).alias("sitemaps"))

    return F.aggregate(fields, start, step, lambda s: F.struct(F.array_compact(s["allowed"]).alias("allowed"), F.array_compact(s["sitemaps"]).alias("sitemaps")))


def sitemap_urls(files: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """Distinct pages (url) of the sitemaps (url, xml) reached from the roots (url), through indexes of indexes.

    Each level is one join; a file is read once, so indexes that name each other end.  More than ``depth`` levels are an error.
    A file that is missing or has no entries adds nothing.
    """
    body = F.regexp_replace("xml", "(?s)<!--.*?-->", "")
    locs = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))))
    with scratch(files.sparkSession) as keep:
        parsed = stash(files.select("url", body.rlike("(?i)<sitemapindex[ >]").alias("is_index"), locs.alias("locs")).dropDuplicates(["url"]), "sitemaps")
        front, seen, pages = stash(roots.select("url").where("url is not null").distinct(), "front"), None, None
        for _ in range(depth):
            seen = front if seen is None else seen.unionByName(front)
            hit = parsed.join(front, "url", "left_semi")
            found = hit.where("not is_index").select(F.explode("locs").alias("url"))
            pages = found if pages is None else pages.unionByName(found)
            front = stash(hit.where("is_index").select(F.explode("locs").alias("url")).distinct().join(seen, "url", "left_anti"), "front")
            if front.isEmpty():
                return keep(stash(pages.where("url <> ''").distinct(), "pages"))
    raise ValueError(f"sitemaps more than {depth} levels deep")


def contact_page(url: Column, *texts: str) -> Column:
    """Whether a page's URL or texts have a word of contact pages."""
    return fx.contains_any(F.lower(F.concat_ws(" ", url, *texts)), CONTACT)


def aid_kind(text: Column) -> tuple[Column, Column]:
    """Type and modality of aid by its words."""
    money = fx.contains_any(F.lower(text), MONEY)
    return F.when(money, "financial").otherwise("advisory"), F.when(money, "application").otherwise("information")


def tool_kind(text: Column) -> Column:
    """The first kind of tool whose words the text has, else a portal."""
    return F.coalesce(*[F.when(fx.contains_any(F.lower(text), w), kind) for kind, w in TOOLS.items()], F.lit("portal"))


#: Words of links by the domain that they belong to; the first domain with one counts.
LINK_WORDS = {
    "benefits": ("leistung", "benefit", "kindergeld", "buergergeld", "zuschlag", "geld"),
    "aid": ("hilfe", "aid", "unterstützung", "support", "beratung"),
    "tools": ("tool", "rechner", "calculator", "service", "antrag", "formular", "lotse", "jobsuche"),
    "organizations": ("ministerium", "organisation", "about", "über-uns", "institution"),
    "contacts": ("kontakt", "contact", "telefon", "helpline", "115", "erreichen"),
}


def link_domain(url: Column, fallback: Column) -> Column:
    """The domain that a link's words say, else ``fallback`` if it is a domain, else benefits."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.coalesce(*[F.when(fx.contains_any(low, words), d) for d, words in LINK_WORDS.items()], F.when(fallback.isin(*LINK_WORDS), fallback), F.lit("benefits"))


def services(host: Column) -> Column:
    """What an organization offers, by its host."""
    listed = lambda names: F.array(*map(F.lit, names))
    return F.coalesce(*[F.when(F.contains(host, F.lit(part)), listed(names)) for part, names in SERVICES.items()], listed(OTHER_SERVICES))


def role_boost(entries: DataFrame, key: str, host: str, url: str, sources: DataFrame, asked: tuple[str, ...] = ()) -> DataFrame:
    """Boost of each entry by the sources (host, role, patterns) that it comes from; ``asked`` holds intents, and ``glossary`` or ``light`` where words ask for those.

    An entry meets a source by equality with its host or a domain above it, so no condition is tried on every pair.
    """
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    e = entries.select(key, F.lower(url).alias("_url"), F.explode(above).alias("_host"))
    s = sources.select(F.col("host").alias("_host"), F.coalesce("role", F.lit("discovered")).alias("_role"), F.coalesce("patterns", F.array().cast("array<string>")).alias("_patterns"))
    weight = F.coalesce(*[F.when(F.col("_role") == r, w) for r, w in ROLES.items()], F.lit(OTHER_ROLE))
    paths = PREFERRED_PATH * F.size(F.filter("_patterns", lambda p: F.contains(F.col("_url"), F.lower(p))))
    extra = _sum([F.lit(0.0), *[_if(F.col("_role") == r, points) for r, (intent, points) in ROLE_EXTRAS.items() if intent in asked]])
    boosts = e.join(s, "_host").groupBy(key).agg(F.round(F.sum(weight + paths + extra), 6).alias("boost"))
    return entries.select(key).join(boosts, key, "left").select(key, F.coalesce("boost", F.lit(0.0)).alias("boost"))


def intent_score(base: Column, title: Column, blob: Column, topics: Column, groups: Column, tags: Column, domain: Column, intents: tuple[str, ...], terms: tuple[str, ...]) -> Column:
    """An entry's score for a query's intents; topics, groups and tags that are null are empty."""
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(blob)
    parts = [base]
    if "unemployment" in intents:
        parts += [_if(has(topics, "employment"), 3), _if(has(groups, "unemployed"), 3), *[_if(domain == d, p) for d, p in JOBLESS_DOMAINS.items()]]
        parts += [_if(fx.contains_any(b, w) | (fx.contains_any(t, w) if p < 0 else F.lit(False)), p) for w, p in JOBLESS_WORDS.items()]
        if "family" not in intents:
            only = F.size(F.array_except(F.coalesce(groups, F.array().cast("array<string>")), F.array(F.lit("families"), F.lit("single_parents")))) == 0
            parts += [_if(has(topics, "family"), -3.5), _if(only, -4)]
    if "contact" in intents:
        parts.append(_if(domain == "contacts", 3))
    if "application" in intents:
        parts.append(_if(has(tags, "application_required") | (domain == "tools"), 1.5))
    if terms:
        parts.append(_if(fx.contains_any(t, terms), 1.5))
    return _sum(parts)


def topic_nodes(df: DataFrame, ids: str, text: str, nodes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows with the nodes (``node``) whose id they name or one of whose aliases their normal text has."""
    hit = lambda node, aliases: F.coalesce(F.array_contains(ids, node), F.lit(False)) | reduce(lambda a, b: a | b, (F.coalesce(keyword_matches(F.col(text), a), F.lit(False)) for a in aliases), F.lit(False))
    return df.withColumn("node", F.explode(F.array_compact(F.array(*[F.when(hit(n, a), n) for n, a in nodes.items()]))))


def unknown_sources(entries: DataFrame, samples: int = 5) -> DataFrame:
    """Hosts of entries (id, domain, tier, title, url, host) whose tier is unknown: tiers, domains, number, and the first few entries.

    The sample's window has a limit that Spark applies before the shuffle, so a host's rows never gather.
    """
    e = entries.where("coalesce(tier, 'tier_unknown') in ('tier_unknown', 'unknown', '')").withColumn("host", F.when(F.coalesce("host", F.lit("")) == "", "(missing-host)").otherwise(F.col("host")))
    told = F.coalesce(F.nullif(F.col("tier"), F.lit("")), F.lit("(missing)"))
    groups = e.groupBy("host").agg(F.array_sort(F.collect_set(told)).alias("tiers"), F.array_sort(F.collect_set("domain")).alias("domains"), F.count("*").alias("entries"))
    first = e.withColumn("_n", F.row_number().over(Window.partitionBy("host").orderBy("id"))).where(F.col("_n") <= samples)
    shown = first.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "url"))), lambda x: x["url"]).alias("samples"))
    return groups.join(shown, "host").select("host", F.translate("host", "-.", "__").alias("source_id"), "tiers", "domains", "entries", "samples")


def crawl_hints(**counts: Column) -> Column:
    """Hints for a crawl by its counts: fetch, validation, empty, alias, reasons, quality."""
    given = F.array_compact(F.array(*[F.when(counts[k] > 0, text) for k, text in HINTS.items() if k != "none"]))
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(HINTS["none"])))
