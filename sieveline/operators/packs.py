"""Resource packs of scenarios, confidence of curated resources, ranks of contacts, and routing to institutions.

Scenarios and routes are configuration; entries are a table.  Every entry scores for all scenarios in one pass, only those
that may be in a pack go on, and the best of each scenario and lane are cut before anything gathers.

Edge cases: entries without a URL are in no pack.  Null texts and tiers are empty.  Ties go to the smaller id.  Scenarios that find
nothing have empty lanes.  Limits of lanes and lists are the feature.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import contains_any, fold_german, plain_url
from sieveline.operators.probes import OFFICIAL, ORGANISATIONS
from sieveline.operators.ranking import first_of
from sieveline.operators.rules import Pack

#: Tiers that a pinned or contact resource may have; most of each lane, and the fewest organisations.
VALID = (*OFFICIAL, *ORGANISATIONS, "tier_3_press", "tier_4_academic", "tier_4_other")
MOST = {"documents": 10, "contacts": 5, "ngo_assistance": 5}
FEWEST_NGOS, SCORE_LEAST, SUPPLEMENT_LEAST = 3, 2.5, 1.5
#: Points of a scenario's words on an entry's title, URL and domain.
SURFACE = {"keywords": 3.0, "expansions": 2.0, "documents": 1.5, "information": 1.5, "contacts": 1.5}
#: Confidence of curated resources after the loss of a job, by title or URL; the first that fits counts.
JOB_LOSS = (
    (("arbeitslos melden",), ("/arbeitslosengeld",), 0.88), (("arbeitsagentur und jobcenter",), ("dienststellen",), 0.8), (("energieschulden", "abschaltung", "sanktions", "wohnungslos", "obdachlos", "widerspruch", "rechtsbehelf"), (), 0.42),
    (("buergergeld online",), ("buergergeld-beantragen",), 0.74), (("antrag und bescheid",), (), 0.72), (("finanziell absichern",), (), 0.68), (("einkommen&ergaenzen",), (), 0.46), (("freiwillige arbeitslosenversicherung",), (), 0.4),
)
#: How much a contact's domain and words that its scenario prefers add to its confidence, and what makes other pages contacts.
CONTACT_DOMAINS, CONTACT_WORDS, CONTACT_URLS = {"contacts": 2.0, "aid": 1.0}, 2.0, "(?i)kontakt|beratung|hilfe|hotline|jobcenter|arbeitsagentur"


@dataclass(frozen=True)
class Route:
    """An institution that a question is sent to, for questions with one of its words and, if it has any, its cities."""

    route_id: str
    words: tuple[str, ...]
    cities: tuple[str, ...] = ()


#: Routes by their words; the route for a place that is asked for.
ROUTES = (
    Route("stadt_leipzig_sozialamt", ("sozialamt", "sozialhilfe", "sgb xii", "grundsicherung im alter", "leipzig"), ("leipzig",)),
    Route("kommune_sozialamt", ("sozialamt", "sozialhilfe", "sgb xii", "grundsicherung im alter", "wohngeldstelle", "buergeramt", "bürgeramt", "jugendamt")),
    Route("arbeitsagentur", ("arbeitsagentur", "agentur fuer arbeit", "agentur für arbeit", "jobcenter", "familienkasse", "dienststelle", "arbeitsamt", "biz")),
    Route("buergergeld", ("buergergeld", "bürgergeld", "grundsicherung", "aufstockung", "jobcenter")),
    Route("krankengeld", ("krankengeld", "krank", "arbeitsunfaehig", "arbeitsunfähig", "krankschreibung", "krankenkasse")),
    Route("pflege", ("pflegegeld", "pflegegrad", "pflegebeduerftig", "pflegebedürftig", "pflegekasse", "pflege")),
    Route("migration", ("migration", "migrationsberatung", "integration", "integrationskurs", "aufenthalt", "auslaenderbehoerde", "ausländerbehörde", "duldung", "asyl")),
    Route("familie", ("kindergeld", "kinderzuschlag", "elterngeld", "familienkasse", "familie")),
    Route("schulden", ("schulden", "schuldnerberatung", "pfaendung", "pfändung", "inkasso", "insolvenz", "mietrueckstand", "mietrückstand")),
)
LOCAL_ROUTE = "service_bund_local_search"
LOCAL = r"(?<![a-z0-9_])(in meiner stadt|in meiner naehe|in der naehe|vor ort|bei mir|postleitzahl|plz|adresse)(?![a-z0-9_])"
NO_PLACE = r"^(meiner|meine|der|die|dem|mir)(?![a-z0-9_])|(?<![a-z0-9_])(kindergeld|kinderzuschlag|buergergeld|burgergeld|arbeitslosengeld|krankengeld|wohngeld|elterngeld|pflegegeld|unterlagen|antrag|hilfe|leistung|leistungen|stelle)(?![a-z0-9_])"


@dataclass(frozen=True)
class Scenario:
    """A scenario's pack, its guards (words that an entry must have one of, and must not have), and pinned URLs by lane."""

    scenario_id: str
    pack: Pack
    required: tuple[str, ...] = ()
    blocked: tuple[str, ...] = ()
    pins: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def surface(self, text: Column) -> Column:
        each = ((n, w) for name, n in SURFACE.items() for w in getattr(self.pack, name))
        return sum((F.when(F.contains(text, F.lit(_folded(w))), n).otherwise(0.0) for n, w in each), F.lit(0.0))


def _folded(word: str) -> str:
    return word.lower().translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}))


def scenario_packs(entries: DataFrame, scenarios: tuple[Scenario, ...]) -> DataFrame:
    """(scenario, lane, place, id, url): the resources of each scenario's pack.

    entries: id, url, title, domain, tier, institution, blob (all their text).  Pinned resources of a valid tier stand first, in their order;
    the others need a score, a word on their surface and what the scenario's guards ask.  Too few organisations are filled up with
    others that score less.
    """
    blob, surface = fold_german(F.coalesce("blob", F.lit(""))), fold_german(F.concat_ws(" ", "title", "url", "domain"))
    tier, ngo = F.coalesce("tier", F.lit("")), (F.coalesce("institution", F.lit("")) == "ngo") | F.coalesce("tier", F.lit("")).isin(*ORGANISATIONS)
    has = lambda words: contains_any(blob, tuple(map(_folded, words)))
    lanes = {"documents": (F.col("domain") != "contacts") & tier.isin(*OFFICIAL), "contacts": (F.col("domain") == "contacts") & tier.isin(*VALID), "ngo_assistance": (F.col("domain") != "organizations") & tier.isin(*VALID) & ngo}
    found = []
    for s in scenarios:
        score, shown = s.pack.score(blob, F.col("domain"), tier, F.col("institution")), s.surface(surface) > 0
        fits = (has(s.required) if s.required else F.lit(True)) & (~has(s.blocked) if s.blocked else F.lit(True))
        for lane, of in lanes.items():
            row = lambda kind, order: F.struct(F.lit(s.scenario_id).alias("scenario"), F.lit(lane).alias("lane"), F.lit(kind).alias("kind"), order.cast("double").alias("order"))  # noqa: B023, E731
            pinned = s.pins.get(lane, ())
            if pinned:
                at = F.array_position(F.array(*map(F.lit, pinned)), F.col("url"))
                found.append(F.when(tier.isin(*VALID) & (at > 0), row(0, at)))
            found.append(F.when(of & fits & shown & (score >= SCORE_LEAST), row(1, -score)))
            if lane == "ngo_assistance":
                found.append(F.when(of & shown & (score >= SUPPLEMENT_LEAST), row(2, -score)))
    each = entries.where("coalesce(url, '') <> ''").select("id", "url", F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*", "id", "url")
    once = each.groupBy("scenario", "lane", "url").agg(F.min(F.struct("kind", "order", "id")).alias("b")).select("scenario", "lane", "url", "b.*")
    best = first_of(once, ["scenario", "lane"], ["kind", "order", "id"], max(MOST.values()))
    # A lane has at most ten rows here; fillers only count up to the fewest organisations.
    listed = best.groupBy("scenario", "lane").agg(F.sort_array(F.collect_list(F.struct("kind", "order", "id", "url"))).alias("rows"))
    own = F.filter("rows", lambda r: r["kind"] < 2)
    fill = F.slice(F.filter("rows", lambda r: r["kind"] == 2), 1, F.greatest(F.lit(FEWEST_NGOS) - F.size(own), F.lit(0)))
    most = F.coalesce(*[F.when(F.col("lane") == lane, n) for lane, n in MOST.items()])
    return listed.select("scenario", "lane", F.posexplode(F.concat(F.slice(own, F.lit(1), most), fill)).alias("place", "r")).select("scenario", "lane", (F.col("place") + 1).cast("long").alias("place"), "r.id", "r.url")


def curated_confidence(scenario: Column, title: Column, url: Column, base: Column) -> Column:
    """How sure a curated resource is: for the loss of a job by what it is about, else as given."""
    t, u = fold_german(F.coalesce(title, F.lit(""))), plain_url(F.coalesce(url, F.lit("")))
    word = lambda w: reduce(lambda a, b: a & b, (F.contains(t, F.lit(x)) for x in w.split("&")))
    some = lambda titles, urls: reduce(lambda a, b: a | b, [*map(word, titles), *(F.contains(u, F.lit(x)) for x in urls)])
    return F.coalesce(F.when(scenario == "job_loss_start", F.coalesce(*[F.when(some(titles, urls), n) for titles, urls, n in JOB_LOSS])), base)


def contact_rank(domain: Column, name: Column, url: Column, confidence: Column, name_words: tuple[str, ...] = (), url_words: tuple[str, ...] = ()) -> Column:
    """Where an entry stands among contacts: its confidence and what its domain and its scenario's words add; null if it is none."""
    is_contact = domain.isin(*CONTACT_DOMAINS) | F.coalesce(url, F.lit("")).rlike(CONTACT_URLS)
    rank = F.coalesce(confidence, F.lit(0.0)) + F.coalesce(*[F.when(domain == d, n) for d, n in CONTACT_DOMAINS.items()], F.lit(0.0))
    for c, words in ((name, name_words), (url, url_words)):
        rank = rank + F.when(contains_any(F.lower(F.coalesce(c, F.lit(""))), words), CONTACT_WORDS).otherwise(0.0) if words else rank
    return F.when((F.coalesce(url, F.lit("")) != "") & F.coalesce(is_contact, F.lit(False)), rank)


def local_hint(query: Column) -> Column:
    """The place that a question names: a postal code, or up to three words after ``in`` or ``für`` that are no subject; null if none."""
    q = fold_german(F.coalesce(query, F.lit("")))
    code = F.regexp_extract(q, r"(?<![a-z0-9_])(\d{5})(?![a-z0-9_])", 1)
    place = F.regexp_extract(q, r"(?<![a-z0-9_])(?:in|fuer)\s+([a-z][a-z.-]+(?:\s+[a-z][a-z.-]+){0,2})(?![a-z0-9_])", 1)
    named = F.array_join(F.transform(F.split(F.trim(place), r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))), " ")
    return F.when(code != "", F.concat(F.lit("PLZ "), code)).when((place != "") & ~place.rlike(NO_PLACE), named)


def routes(query: Column, weak: Column, table: tuple[Route, ...] = ROUTES, most: int = 3) -> Column:
    """Where a question is sent: the local search if it asks for a place, then the ``most`` routes with most of their words; null if there is none.

    A question that names no place is only sent on where the evidence is ``weak``.
    """
    q = fold_german(F.coalesce(query, F.lit("")))
    local = q.rlike(LOCAL) | local_hint(query).isNotNull()
    scored = []
    for i, r in enumerate(table):
        hits = sum((F.when(F.contains(q, F.lit(w)), 1).otherwise(0) for w in map(_folded, r.words)), F.lit(0))
        there = contains_any(q, tuple(map(_folded, r.cities))) if r.cities else F.lit(True)
        scored.append(F.when((hits > 0) & there, F.struct((-hits).alias("less"), F.lit(i).alias("i"), F.lit(r.route_id).alias("route"))))
    matched = F.transform(F.slice(F.sort_array(F.array_compact(F.array(*scored))), 1, most), lambda x: x["route"])
    every = F.concat(F.when(local, F.array(F.lit(LOCAL_ROUTE))).otherwise(F.array().cast("array<string>")), matched)
    return F.when((F.trim(q) != "") & (local | F.coalesce(weak, F.lit(True))) & (F.size(every) > 0), every)


def fixtures(suggestions: DataFrame, scenarios: DataFrame, top: int = 8) -> DataFrame:
    """A test case for each suggested question (scenario_id, questions) of a known scenario (scenario_id, domains, required, expansions, blocked).

    Cases expect the first two domains of the scenario, and the first six of the words its guard requires, or else of its expansions.
    """
    first = lambda c, n: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n)
    asked = suggestions.select("scenario_id", F.posexplode(F.filter("questions", lambda q: F.coalesce(F.trim(q), F.lit("")) != "")).alias("place", "query"))
    wanted = F.when(F.size(F.coalesce("required", F.array().cast("array<string>"))) > 0, F.col("required")).otherwise(F.col("expansions"))
    known = scenarios.select("scenario_id", first(F.col("domains"), 2).alias("required_domains_any"), first(wanted, 6).alias("expected_terms_any"), first(F.col("blocked"), 6).alias("blocked_terms_any"))
    return asked.join(known, "scenario_id").select(F.format_string("suggested-%s-%02d", "scenario_id", F.col("place") + 1).alias("id"), "query", F.col("scenario_id").alias("expected_life_event"), "required_domains_any", "expected_terms_any", "blocked_terms_any", F.lit(top).alias("top_k"))


def documented(packs: DataFrame, sources: DataFrame, scenario_of: dict[str, str]) -> DataFrame:
    """``packs`` (scenario, lane, title, url) with the documented ``sources`` (life_event, official, pdfs, ngo, contacts: lists of title and url) of the scenarios that ``scenario_of`` has.

    A pack that there isn't yet comes to be; of resources with one URL in a lane the one that was there stays, else the first.
    """
    lanes = (("official", "documents"), ("pdfs", "documents"), ("ngo", "ngo_assistance"), ("contacts", "contacts"))
    target = F.coalesce(*[F.when(F.lower(F.trim("life_event")) == k, v) for k, v in scenario_of.items()], F.lit(None))
    rows = None
    for n, (column, lane) in enumerate(lanes):
        part = sources.select(target.alias("scenario"), F.lit(lane).alias("lane"), F.lit(n + 1).alias("kind"), F.posexplode(column).alias("place", "x")).select("scenario", "lane", "x.title", F.trim("x.url").alias("url"), "kind", "place")
        rows = part if rows is None else rows.unionByName(part)
    every = rows.where("scenario is not null").unionByName(packs.select("scenario", "lane", "title", "url", F.lit(0).alias("kind"), F.lit(0).alias("place"))).where("coalesce(url, '') <> ''")
    best = every.groupBy("scenario", "lane", plain_url(F.col("url")).alias("_at")).agg(F.min_by(F.struct("title", "url"), F.struct("kind", "place", "url")).alias("b"))
    return best.select("scenario", "lane", "b.title", "b.url")
