"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then seeded block selection.

The words of a source, its documents in a seeded order, form one stream.  Targets fill up by weight, none beyond
``cap`` times its source.  Equal-token blocks go to sources by the highest quotients target / (2k + 1); they have
``block`` words, fewer where the smallest target would hold less than ``FINE`` of them.  A source's stream is cut into
runs of such blocks, as many in one as leave it ``FINE`` runs or more, ``block`` words at most; ``run`` of them are a
shard.  Runs go to the shards by the highest quotients words / (2k + 1), and a shard that gets q for its n runs takes
each q // n times and q % n seeded ones once more.

How it scales: a source's stream is laid out over 4096 seeded buckets, so no source is in one task.  The table of
sources is never in one task either: their order comes from ranges, their targets and quotas from sums over
them, a few for each step towards the level or the divisor.  Shards of a source differ only in the last, so their
quotas need no ranking at all.

Edge cases: null and empty texts have size 0 and take 0; a null source is a source of its own, the last one; a
source without words has target 0; with no words at all every target is 0.  Repeated rows count as often as they
occur, each with words of its own; which of several equal rows has which is not defined.  An empty table gives an
empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.session import numbered, scratch, spare, stash

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
#: Blocks that the smallest target holds at least, and runs that a source holds at least where its words allow.
FINE = 64
#: Divisors that are tried at once, and seats between two divisors that are few enough to be ranked.
TRIED, RANKED = 16, 10_000
#: Weights of the sources in order of code points, repeating.
WEIGHTS = (3, 1, 2)
#: Primes above any shard's number of runs, one of which steps through it.
STEPS = (5003, 6007, 7001, 8009, 9001, 10007)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, a mark of the text, and its size in words."""
    words = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("mark"), F.when(F.col("text").isNull(), 0).otherwise(words).alias("size"))


def targets(sized: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: by weight, no source beyond ``cap`` times its size, the excess shared again.

    The level (words for each unit of weight) rises until no further source is full; each step is one sum over sources.
    """
    by = stash(numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "place", "sources"), "sources", sweep=False)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    by = by.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most"))
    every = by.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    if not every[2]:
        return by.select("source", "source_size", F.lit(0.0).alias("target"))
    pool = Fraction(share) * every[0]
    level, full = float(pool / every[1]), -1
    while True:
        # A source is full if the level gives it more than it may have; the order of most / weight settles which come first.
        is_full = F.col("most") < F.lit(level) * F.col("weight")
        got = by.agg(F.sum(F.when(is_full, F.col("most"))), F.sum(F.when(~is_full, F.col("weight"))), F.count_if(is_full)).first()
        if got[2] <= full or not got[1]:
            break
        full, level = got[2], float((pool - (got[0] or 0)) / got[1])
    return by.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def quotas(parties: DataFrame, total: int, claim: str, most: str, key: str) -> DataFrame:
    """``parties`` with ``quota``: ``total`` seats by the highest quotients claim / (2k + 1), none with more than ``most``.

    A party has min(most, floor(claim / d + 1/2)) seats at divisor d.  Sums over the parties for many divisors at once
    close in on the one that gives out all seats; the seats between the last two divisors, few or as good as tied, go by
    quotient and then by ``key``.
    """
    seats = lambda d: F.least(F.col(most), F.floor(F.col(claim) / d + 0.5)).cast("long")
    bounds = parties.agg(F.sum(most), F.max(claim), F.sum(claim)).first()
    if not total or not bounds[1]:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    total = min(total, bounds[0])
    given = lambda ds: list(parties.agg(*[F.sum(seats(F.lit(d))) for d in ds]).first())
    low = float(bounds[2]) / total
    high = low * 2
    at_low, at_high = given([low, high])
    while at_low < total:
        low, high, at_high = low / 4, low, at_low
        if low < 1e-300:
            return parties.withColumn("quota", F.col(most))
        at_low = given([low])[0]
    while at_high > total:
        low, high, at_low = high, high * 4, at_high
        at_high = given([high])[0]
    while at_low - at_high > RANKED and high / low > 1 + 1e-13:
        tried = [low, *(low * (high / low) ** (i / (TRIED + 1)) for i in range(1, TRIED + 1)), high]
        seated = [at_low, *given(tried[1:-1]), at_high]
        k = max(i for i, n in enumerate(seated) if n >= total)
        if k == len(tried) - 1:
            break
        low, high, at_low, at_high = tried[k], tried[k + 1], seated[k], seated[k + 1]
    sure = parties.withColumn("quota", seats(F.lit(high)))
    left = total - sure.agg(F.sum("quota")).first()[0]
    if not left:
        return sure
    rest = sure.withColumn("seat", F.explode(F.sequence(F.lit(0).cast("long"), seats(F.lit(low)) - F.col("quota")))).where(F.col("seat") < seats(F.lit(low)) - F.col("quota"))
    quotient = F.round(F.log(F.col(claim) / (2 * (F.col("quota") + F.col("seat")) + 1)), 11)
    ranked = numbered(rest.select(key, "seat", quotient.alias("quotient")), [F.col("quotient").desc(), F.col(key).asc_nulls_last(), F.col("seat")], "rank", "seats")
    won = ranked.where(F.col("rank") < left).groupBy(F.col(key).alias("won_by")).agg(F.count("*").alias("won"))
    return sure.join(won, F.col(key).eqNullSafe(F.col("won_by")), "left").withColumn("quota", F.col("quota") + F.coalesce("won", F.lit(0))).drop("won_by", "won")


def _last_quota() -> Column:
    """Seats of a source's last shard, the only one that may be smaller: ``due`` for ``full`` equal ones and it.

    Its k-th quotient wins if it is above the one at rank due - k + 1 of the others; it is within two of its share.
    """
    words, last = F.col("width").cast("double"), F.col("last_words").cast("double")
    share = F.floor(F.col("due") * last / (F.col("full") * words + last))
    other = lambda k: words / (2 * F.ceil((F.col("due") - k + 1) / F.col("full")) - 1)
    wins = F.size(F.filter(F.sequence(F.greatest(F.lit(1).cast("long"), share - 2), share + 3), lambda k: (k <= F.col("due")) & (last / (2 * k - 1) > other(k))))
    count = F.greatest(F.lit(0).cast("long"), share - 3) + wins
    # Seats that the others can't take are its own, and the other way round.
    return F.when(F.col("full") == 0, F.col("due")).otherwise(F.least(F.greatest(count, F.col("due") - F.col("full") * F.col("most_full")), F.col("most_last"))).cast("long")


def _shards(by: DataFrame, cap: int, block: int, run: int, seed: int) -> DataFrame:
    """source, shard, n runs, quota, and how its seeded runs are picked; piece is a run's words."""
    least = by.where("target > 0").agg(F.min("target"), F.sum("target")).first()
    unit = max(1, min(block, int((least[0] or 0) // FINE)))
    seats = by.where("target > 0").withColumn("blocks", F.ceil(F.col("source_size") * cap / unit).cast("long"))
    seats = stash(quotas(seats, round((least[1] or 0) / unit), "target", "blocks", "source"), "quotas", sweep=False)
    piece = unit * F.greatest(F.lit(1), F.floor(F.least(F.lit(float(block)), F.col("source_size") / FINE) / unit))
    seats = seats.select("source", "source_size", piece.cast("long").alias("piece"), (F.col("quota") * unit).alias("words"))
    seats = seats.withColumn("n", F.ceil(F.col("source_size") / F.col("piece")).cast("long")).withColumn("due", F.least(F.round(F.col("words") / F.col("piece")).cast("long"), cap * F.col("n")))
    seats = seats.withColumns({"full": F.floor((F.col("n") - 1) / run), "width": F.col("piece") * run})
    seats = seats.withColumns({"last_n": F.col("n") - F.col("full") * run, "last_words": F.col("source_size") - F.col("full") * F.col("width"), "most_full": F.lit(cap * run).cast("long")})
    seats = seats.withColumn("most_last", cap * F.col("last_n")).withColumn("last_due", _last_quota())
    rest = F.col("due") - F.col("last_due")
    shard = seats.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))).withColumn("is_last", F.col("shard") == F.col("full"))
    even = F.floor(rest / F.col("full")) + F.when(F.col("shard") < F.pmod(rest, F.col("full")), 1).otherwise(0)
    step = F.element_at(F.array(*[F.lit(p) for p in STEPS]), (F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.lit(len(STEPS))) + 1).cast("int"))
    out = shard.select("source", "shard", "piece", "width", F.when(F.col("is_last"), F.col("last_n")).otherwise(run).alias("n"), F.when(F.col("is_last"), F.col("last_due")).otherwise(even).alias("quota"), step.alias("step"))
    return out.withColumn("shift", F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.col("n")))


def _planned(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS, block: int = 128, run: int = 4096, seed: int = 42) -> DataFrame:
    """As ``mix``, with the mark of the text."""
    with scratch(docs.sparkSession) as keep:
        sized = keep(stash(sizes(docs), "sizes", sweep=False)).withColumns({"place": F.xxhash64(F.lit(seed), "doc_id", "mark")})
        sized = sized.withColumn("bucket", F.pmod(F.col("place"), F.lit(BUCKETS)))
        by = keep(stash(targets(sized, share, cap, weights), "targets", sweep=False))
        due = keep(stash(_shards(by, cap, block, run, seed), "shards"))

    # Where each document starts in its source's stream: the buckets before it, then the documents before it.
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(in_source), F.lit(0))).drop("held")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    laid = sized.withColumns({"before": F.coalesce(F.sum("size").over(in_bucket), F.lit(0)), "row": F.row_number().over(Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "mark"))})
    s, t = laid.alias("s"), starts.alias("t")
    laid = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.bucket") == F.col("t.bucket"))).select("s.doc_id", "s.source", "s.mark", "s.size", "s.bucket", "s.row", (F.col("base") + F.col("before")).alias("start"))
    few = by.count() <= 100_000
    c = by.join(due.groupBy(F.col("source").alias("in_source")).agg(F.first("width").alias("width")), F.col("source").eqNullSafe(F.col("in_source")), "left").drop("in_source").alias("c")
    laid = laid.alias("a").join(F.broadcast(c) if few else c, F.col("a.source").eqNullSafe(F.col("c.source")), "left").select("a.*", "source_size", "target", "width")

    # What each document has in the runs that were taken.
    wide = F.col("width")
    cut = laid.withColumn("shard", F.explode_outer(F.when((F.col("size") > 0) & wide.isNotNull(), F.sequence(F.floor(F.col("start") / wide), F.floor((F.col("start") + F.col("size") - 1) / wide)))))
    c, d = cut.alias("c"), due.drop("width").alias("d")
    cut = c.join(d, F.col("c.source").eqNullSafe(F.col("d.source")) & (F.col("c.shard") == F.col("d.shard")), "left").select("c.*", "piece", "n", "quota", "step", "shift")
    low, high, piece = F.greatest(F.col("start"), F.col("shard") * wide), F.least(F.col("start") + F.col("size"), (F.col("shard") + 1) * wide), F.col("piece")
    span = lambda b: F.struct(
        (F.greatest(low, b * piece) - F.col("start")).alias("start"),
        (F.least(high, (b + 1) * piece) - F.col("start")).alias("end"),
        (F.floor(F.col("quota") / F.col("n")) + F.when(F.pmod((b - F.col("shard") * run) * F.col("step") + F.col("shift"), F.col("n")) < F.pmod("quota", "n"), 1).otherwise(0)).alias("times"),
    )
    cut = cut.withColumn("pieces", F.when(piece.isNotNull(), F.transform(F.sequence(F.floor(low / piece), F.floor((high - 1) / piece)), span)))
    spans = F.sort_array(F.flatten(F.collect_list("pieces")))
    out = cut.groupBy("doc_id", "source", "mark", "size", "bucket", "row", "source_size", "target").agg(spans.alias("spans"))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]) * x["times"])
    return out.select("doc_id", "source", "mark", "size", "source_size", "target", taken.alias("taken"), "spans")


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and spans (start, end, times) of the words that are taken.

    Options: share, cap, weights, block, run, seed.
    """
    return _planned(docs, **options).drop("mark")


def mixed_texts(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` as the mix takes them: the taken words of each document, once for each time that they are taken.

    A document's first copy has the words taken at least once, the second those taken twice; n_chars follows the
    text.  Documents of which nothing is taken go.
    """
    key, source, mark, row = (spare(docs.columns, n) for n in ("key", "source_key", "mark", "row"))
    same = Window.partitionBy("doc_id", "source", "mark").orderBy("spans")
    plan = _planned(docs, **options).withColumn("row", F.row_number().over(same)).where("exists(spans, x -> x.times > 0)")
    plan = plan.select("doc_id", "source", "mark", "row", "spans", F.explode(F.sequence(F.lit(1), F.array_max(F.col("spans.times")).cast("int"))).alias("copy"))
    whole = docs.withColumns({key: F.col("doc_id").cast("long"), source: F.col("source").cast("string"), mark: F.xxhash64("text")})
    # Repeated rows are told apart by number.  The number is compared after the join, so that one shuffle serves both.
    whole = whole.withColumn(row, F.row_number().over(Window.partitionBy(key, source, mark).orderBy(mark)))
    w, p = whole.alias("w"), plan.alias("p")
    joined = w.join(p, F.col(f"w.{key}").eqNullSafe(F.col("p.doc_id")) & F.col(f"w.{source}").eqNullSafe(F.col("p.source")) & (F.col(f"w.{mark}") == F.col("p.mark")) & (F.abs(F.col(f"w.{row}") - F.col("p.row")) < 1))
    every = F.size(F.filter("p.spans", lambda x: x["times"] < F.col("p.copy"))) == 0
    picked = F.filter("p.spans", lambda x: x["times"] >= F.col("p.copy"))
    words = F.regexp_extract_all("w.text", F.lit(WORD), F.lit(0))
    text = F.when(every, F.col("w.text")).otherwise(F.array_join(F.flatten(F.transform(picked, lambda x: F.slice(words, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), " "))
    made = joined.where(F.size(picked) > 0).select(F.col("w.*"), text.alias(spare([*docs.columns, key, source, mark, row], "made")))
    new = made.columns[-1]
    return made.select(*[F.col(new).alias(c) if c == "text" else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
