"""Seeds, URL registries, review queues and what a URL or a surface says of its page; all built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as fx
from sieveline.operators.quality import errors

#: Registry states after which a URL isn't fetched again.
TERMINAL = ("invalid_url", "invalid_host", "dns_error", "head_failed", "content_empty", "redirect_alias", "canonical_alias")
#: Parts of paths that speak for a page and against it.
HIGH_SIGNAL = ("beratung", "hilfe", "kontakt", "service", "leistungen", "antrag", "rechner", "suche", "krank", "depression", "krise", "pflege", "familie", "arbeit", "arbeitslos", "weiterbildung", "schulden", "wohnen", "migration", "integration", "einsamkeit")
LOW_SIGNAL = ("datenschutz", "impressum", "presse", "news", "aktuelles", "newsletter", "cookie", "login", "warenkorb", "shop", "mediathek")
#: Hosts whose pages are benefits, and hosts of the first tier.
BENEFIT_HOSTS = ("arbeitsagentur.de", "jobcenter.de", "bmas.de", "bund.de")
FIRST_TIER_HOSTS = (".bund.de", "arbeitsagentur.de", "jobcenter.de", "bamf.de", "bmas.de")
#: States and actions of a review queue; what a translation must and may have.
QUEUE_STATES, QUEUE_ACTIONS = ("pending", "approved", "rejected", "accepted"), ("create", "update", "delete")
TRANSLATION_NEEDS = ("title", "timestamp", "provenance")
TRANSLATION_FIELDS = ("title", "summary", "body", "provenance", "method", "generator", "timestamp", "reviewed")


def points(c: Column, terms: tuple[str, ...], each: float) -> Column:
    """``each`` for every term that the text has."""
    return reduce(lambda a, b: a + b, (F.when(F.contains(c, F.lit(t)), F.lit(each)).otherwise(F.lit(0.0)) for t in terms), F.lit(0.0))


def open_seeds(seeds: DataFrame, registry: DataFrame) -> DataFrame:
    """Seeds (url) that their registry row (url, state, skip, canonical) doesn't rule out; those without a row stay."""
    other = (F.coalesce("_canonical", F.lit("")) != "") & (F.col("_canonical") != F.col("url"))
    out = F.coalesce(F.col("_state").isin(*TERMINAL), F.lit(False)) | F.coalesce("_skip", F.lit(False)) | other
    known = registry.select("url", F.col("state").alias("_state"), F.col("skip").alias("_skip"), F.col("canonical").alias("_canonical"))
    return seeds.join(known, "url", "left").where(~F.coalesce(out, F.lit(False))).select(*seeds.columns)


def sitemap_points(url: Column) -> Column:
    """What the path promises: three for each good part, four less for each bad one, one less a level, one more near the root; null for null."""
    parts = F.filter(fx.path_parts(url), lambda p: F.trim(p) != "")
    plain = F.transform(parts, lambda p: F.lower(F.trim(F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))))
    path = F.array_join(plain, " ")
    total = points(path, HIGH_SIGNAL, 3.0) - points(path, LOW_SIGNAL, 4.0) - F.least(F.size(parts), F.lit(8)) + F.when(F.size(parts) <= 2, 1).otherwise(0)
    return F.when(url.isNotNull(), total.cast("long"))


def placement(url: Column, lane: Column) -> tuple[Column, Column]:
    """Domain and tier of a resource by its URL and the lane it was found in."""
    u = F.lower(F.coalesce(url, F.lit("")))
    benefits = (lane == "documents") | fx.contains_any(u, BENEFIT_HOSTS)
    domain = F.when(lane == "contacts", "contacts").when(lane == "ngo_assistance", "aid").when(F.contains(u, F.lit("/download")) | u.endswith(".pdf"), "tools").when(benefits, "benefits").otherwise("aid")
    tier = F.when(lane == "ngo_assistance", "tier_2_ngo_watchdog").when(fx.contains_any(u, FIRST_TIER_HOSTS), "tier_1_official").otherwise("tier_2_official")
    return domain, tier


def source_role(tier: Column, domain: Column, stated: Column | None = None) -> Column:
    """The role that is stated, else by tier and domain."""
    t = F.coalesce(tier, F.lit("unknown"))
    by_tier = F.when(t.startswith("tier_1_") | (t == "tier_2_official"), "official_info").when(domain == "tools", "trusted_tool").otherwise("context_info")
    return by_tier if stated is None else F.coalesce(stated, by_tier)


def surface_score(surface: Column, keywords: tuple[str, ...], expansions: tuple[str, ...], targets: tuple[str, ...]) -> Column:
    """Three for each keyword on the surface (title, URL, domain), two for each expansion, one and a half for each target."""
    s = F.lower(surface)
    return points(s, keywords, 3.0) + points(s, expansions, 2.0) + points(s, targets, 1.5)


def scenario_text(c: Column) -> Column:
    """Lower case, umlauts spelled out, letters and digits only, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(fx.fold_german(c), r"[^\p{L}\p{N}]", " "), " +", " "))


def keyword_matches(query: Column, keyword: str) -> Column:
    """Whether a query (as ``scenario_text``) has a keyword: in it, in it without spaces, or by all words of three letters and more."""
    words = [w for w in keyword.split() if len(w) >= 3]
    found = F.contains(query, F.lit(keyword)) | F.contains(F.replace(query, F.lit(" ")), F.lit(keyword.replace(" ", "")))
    return found | reduce(lambda a, b: a & b, (F.array_contains(F.split(query, " "), w) for w in words)) if len(words) >= 2 else found


def matched_topics(df: DataFrame, text: str, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """Topics with a keyword in a text: hits as words, other hits, the longest keyword's length; no row without any."""
    whole = F.lower(text)
    known = F.array(*[F.struct(F.lit(t).alias("topic_id"), F.array(*map(F.lit, ks)).alias("keywords")) for t, ks in sorted(topics.items())])
    rows = df.withColumn("_words", F.split(F.replace(whole, F.lit("-"), F.lit(" ")), r"\s+")).withColumn("_topic", F.explode(known))
    inside = F.filter("_topic.keywords", lambda k: F.contains(whole, k))
    exact = F.filter("_topic.keywords", lambda k: F.array_contains("_words", k))
    rows = rows.select(*df.columns, "_topic.topic_id", F.size(exact).cast("long").alias("exact_hits"), F.size(F.array_except(inside, exact)).cast("long").alias("loose_hits"), F.array_max(F.transform(inside, F.length)).cast("long").alias("specificity"))
    return rows.where("exact_hits + loose_hits > 0")


def canonical_queue(raw: DataFrame) -> DataFrame:
    """Queue rows under one spelling: either spelling's value, the entry's id for a missing id, the usual action and state."""
    has = {c.lower() for c in raw.columns}
    either = lambda *names: F.coalesce(*[F.col(n) for n in names if n.lower() in has], F.lit(None))
    entry = either("entryId", "entry_id").cast("string")
    return raw.select(
        F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), entry, F.lit("")).alias("id"), entry.alias("entry_id"), "domain",
        F.coalesce(F.nullif("action", F.lit("")), F.lit("update")).alias("action"), F.coalesce(F.nullif("status", F.lit("")), F.lit("pending")).alias("status"),
        either("createdAt", "created_at", "crawledAt").alias("created_at"),
    )


def queue_errors() -> Column:
    """What is wrong with a canonical queue row."""
    missing = [(f"Missing required field '{c}'", F.col(c).isNull()) for c in ("id", "domain", "action", "status", "created_at")]
    return errors(*missing, ("Field 'status' must be one of " + "|".join(QUEUE_STATES), ~F.col("status").isin(*QUEUE_STATES)), ("Field 'action' must be one of " + "|".join(QUEUE_ACTIONS), ~F.col("action").isin(*QUEUE_ACTIONS)))


def field_mismatches(fields: Column, allowed: tuple[str, ...]) -> Column:
    """Fields that aren't allowed but differ from an allowed one only in case and underscores, with that one."""
    known = F.array(*map(F.lit, allowed))
    bare = lambda c: F.replace(F.lower(c), F.lit("_"))
    told = lambda f: F.transform(F.filter(known, lambda a: bare(a) == bare(f)), lambda a: F.concat(f, F.lit(" -> "), a))
    return F.flatten(F.transform(F.array_except(fields, known), told))


def translation_errors(fields: Column) -> Column:
    """Missing and unknown fields of a translation, by name."""
    needs, known = F.array(*map(F.lit, TRANSLATION_NEEDS)), F.array(*map(F.lit, TRANSLATION_FIELDS))
    return F.concat(F.transform(F.array_except(needs, fields), lambda f: F.concat(f, F.lit(": Missing required field"))), F.transform(F.array_except(fields, known), lambda f: F.concat(F.lit("Unknown field '"), f, F.lit("'"))))


def text_block(c: Column) -> Column:
    """White space as one space, none before punctuation, no spaces, hyphens and bars at the ends."""
    one = F.regexp_replace(c, r"[\t\n\x0B\f\r ]+", " ")
    return F.btrim(F.regexp_replace(one, " ([,.;:!?])", "$1"), F.lit(" -|"))


def text_to_embed(title: Column, description: Column, content: Column, most: int = 8000) -> Column:
    """Title, description, and the content if the description is short; cut in proportion beyond ``most`` tokens of four letters."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    short = F.length(F.coalesce(description, F.lit(""))) < 100
    whole = F.concat_ws("\n\n", part("Title: ", title), part("Description: ", description), F.when(short, part("Content: ", content)))
    tokens = F.ceil(F.length(whole) / 4)
    return F.when(tokens > most, F.substring(whole, F.lit(1), F.floor(F.length(whole) * (F.lit(float(most)) / tokens)).cast("int"))).otherwise(whole)


def context_overlap(answer: Column, context: Column) -> Column:
    """Share of an answer's distinct words of five letters and more that its context has; 0 without any."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: F.length(w) > 4))
    return fx.overlap(words(answer), words(context))


#: What an entry must not lose when it is shortened.
CRITICAL = {
    "amounts": r"€\s*[\d.,]+|[\d.,]+\s*€|[\d.,]+\s*(?:Euro|EUR)",
    "dates": r"\d{1,2}\.\d{1,2}\.\d{2,4}|(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s+\d{4}|bis\s+\d{4}",
    "requirements": r"(?:unter|über|ab|bis)\s+\d+\s*(?:Jahre?|Monate?)|arbeitslos|erwerbslos|hilfebedürftig|bedürftig",
}


def critical(text: Column) -> list[Column]:
    """Distinct amounts, dates and requirements in the order of the text."""
    return [F.array_distinct(F.regexp_extract_all(text, F.lit("(?iu)" + pattern), F.lit(0))).alias(name) for name, pattern in CRITICAL.items()]


def merged_pins(pins: DataFrame) -> DataFrame:
    """One pin (section, url, title, place) for each section and URL, the first by place; pins without a URL go."""
    first = pins.where(F.coalesce("url", F.lit("")) != "").groupBy("section", "url").agg(F.min(F.struct("place", "title")).alias("_first"))
    return first.select("section", "url", "_first.title", "_first.place")


def resolved_pins(pins: DataFrame, entries: DataFrame) -> DataFrame:
    """Pins (url, domain, title) with the entry of their URL, the least id if several have it; a pin without one gets an id of its own."""
    known = entries.groupBy("url").agg(F.min(F.struct("id", "domain", "title_de", "tier")).alias("_e"))
    rows = pins.join(known, "url", "left")
    own = F.concat(F.coalesce("domain", F.lit("pinned")), F.lit(":"), "url")
    return rows.select("url", F.coalesce(F.col("_e.id").cast("string"), own).alias("id"), F.coalesce("domain", "_e.domain", F.lit("benefits")).alias("domain"), F.coalesce("title", "_e.title_de", "url").alias("title"), F.coalesce("_e.tier", F.lit("unknown")).alias("tier"))


def prune_counts(seeds: DataFrame, url: Column, blocked: Column) -> DataFrame:
    """How many seeds stay or go, by reason: no URL, a blocked one, one that came before.

    Counted for each URL first, so a URL that stands very often is never gathered.
    """
    state = F.when(F.coalesce(F.trim(url), F.lit("")) == "", "missing_url").when(blocked, "blocked").otherwise("kept")
    each = seeds.select(state.alias("reason"), F.when(state == "kept", fx.plain_url(url)).alias("_url")).groupBy("reason", "_url").agg(F.count("*").alias("n"))
    split = each.select(F.explode(F.when(F.col("reason") == "kept", F.array(F.struct(F.lit("kept").alias("reason"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("duplicate").alias("reason"), (F.col("n") - 1).alias("n")))).otherwise(F.array(F.struct("reason", "n")))).alias("r"))
    return split.groupBy("r.reason").agg(F.sum("r.n").alias("n")).where("n > 0")
