"""Seed scans, alias chains, the registry's fold in batch and stream, and greedy batches, beside loops."""

import random

from pyspark.sql import functions as F

from sieveline.operators import batches, seeds
from sieveline.operators.discovery import TERMINAL
from sieveline.streaming import registry

NAMES = [c.split()[0] for c in seeds.STATE.split(", ")]
REG = "url string, status string, skip boolean, final_url string, canonical_url string"


def test_chain_ends(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("n", None), (None, "n"), ("m", "q"), ("m", "p")] + [(f"l{i}", f"l{i + 1}") for i in range(37)]
    df = spark.createDataFrame(links, "url string, target string")
    got = {r.url: r.target for r in seeds.chain_ends(df).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", "m": "p"} | {f"l{i}": "l37" for i in range(37)}
    assert seeds.chain_ends(df.limit(0)).count() == 0


def test_seed_scan(spark):
    reg = [("https://a.de/1", "ok", None, "https://a.de/2", None), ("https://a.de/2", "ok", None, "https://a.de/3", ""), ("https://a.de/3", "ok", False, "https://a.de/4", None), ("https://a.de/x", "ok", None, "https://a.de/y", None), ("https://a.de/y", "ok", None, "https://a.de/x", None)]
    reg += [("https://a.de/t", "head_failed", None, None, None), ("https://a.de/s", "ok", True, None, None), ("https://a.de/c", "ok", None, None, "https://a.de/d"), ("https://a.de/o", "ok", False, None, "https://a.de/o")]
    rows = [("HTTPS://A.de/4/", True, 1, 0, "late"), ("https://a.de/1", None, 0, 5, "first"), ("https://a.de/1?utm_source=x", True, 0, 2, "earlier"), ("https://a.de/x", True, 0, 3, "cycle"), ("https://a.de/t", True, 0, 1, ""), ("https://a.de/s", True, 0, 1, ""), ("https://a.de/c", True, 0, 1, ""), ("https://a.de/o", True, 2, 1, "own")]
    rows += [("https://a.de/off", False, 0, 1, ""), ("nonsense", True, 0, 1, ""), (None, True, 0, 1, ""), ("https://www.bad.de/p", True, 0, 1, ""), ("https://x.evil.de/", True, 0, 1, ""), ("https://notevil.de/", True, 0, 9, "fine"), ("https://b.de/Login/1", True, 0, 1, ""), ("https://b.de/e", True, 0, 1, "")]
    registered, named = spark.createDataFrame(reg, REG), spark.createDataFrame(rows, "url string, enabled boolean, file int, place long, label string")
    guard = seeds.Guard(urls=("https://b.de/e",), hosts=("bad.de",), suffixes=("evil.de",), words=("/login",))
    out = seeds.judged(named, registered, guard)
    assert {r.url: (r.url, r.label, r.seed) for r in seeds.kept(out).collect()} == {
        "https://a.de/4": ("https://a.de/4", "earlier", "https://a.de/1?utm_source=x"), "https://a.de/x": ("https://a.de/x", "cycle", "https://a.de/x"), "https://a.de/o": ("https://a.de/o", "own", "https://a.de/o"), "https://notevil.de/": ("https://notevil.de/", "fine", "https://notevil.de/"),
    }
    assert {(r.url, r.status, r.canonical_url, r.reason, r.skip) for r in seeds.recorded(out).collect()} == {
        ("https://a.de/1", "canonical_alias", "https://a.de/4", "preferred_url_from_registry", True), ("https://www.bad.de/p", "invalid_url", None, "guardrail_blocked_host", True), ("https://x.evil.de/", "invalid_url", None, "guardrail_blocked_host_suffix", True),
        ("https://b.de/Login/1", "invalid_url", None, "guardrail_blocked_url_token", True), ("https://b.de/e", "invalid_url", None, "guardrail_exact_url_blocklist", True),
    }
    assert {r.url for r in seeds.kept(seeds.judged(named, registered, guard, whole=False)).collect()} == {"https://a.de/2", "https://a.de/4", "https://a.de/y", "https://a.de/o", "https://notevil.de/"}
    assert {r.url for r in seeds.kept(seeds.judged(named, registered, guard, hosts=("notevil.de",))).collect()} == {"https://notevil.de/"}
    assert seeds.kept(seeds.judged(named.limit(0), registered.limit(0), guard)).count() == 0


def loop(events, state=None):
    """The registry after events in order, one at a time."""
    held = {u: dict(r) for u, r in (state or {}).items()}
    for e in sorted(events, key=lambda e: e["seq"]):
        r = held.setdefault(e["url"], dict.fromkeys(NAMES) | {"url": e["url"]})
        r |= {"source": e["source"], "status": e["status"], "checked": e["seq"]}
        r |= {k: e[k] for k in ("final_url", "canonical_url", "reason") if e[k]} | ({"status_code": e["status_code"]} if e["status_code"] is not None else {})
        if e["status"] == "fetch_failed":
            r["fail_count"] = (r["fail_count"] or 0) + 1
            if e["skip"] is None and r["fail_count"] >= 3:
                r["skip"] = True
                r["reason"] = e["reason"] or "fetch_failed_threshold"
        elif e["status"] == "ok":
            r |= {"fail_count": None, "skip": False}
        elif e["status"] in TERMINAL:
            r["skip"] = True
        if e["skip"] is not None:
            r["skip"] = e["skip"]
        target = r["canonical_url"] or r["final_url"]
        if target and target != e["url"]:
            t = held.setdefault(target, dict.fromkeys(NAMES) | {"url": target})
            t |= {"source": t["source"] or e["source"], "status": t["status"] or "discovered", "skip": False if t["skip"] is None else t["skip"], "checked": e["seq"]}
    return held


def made(n, seed):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    return [
        {"url": some("hot", "hot", *"abcdef"), "seq": i, "source": some("s", "t"), "status": some("fetch_failed", "fetch_failed", "ok", "content_empty", "checked"), "final_url": some(None, None, None, "", *"abg"), "canonical_url": some(*[None] * 9, "", "c", "h"),
         "reason": some(None, None, "", "why"), "status_code": some(None, 200, 503), "skip": some(*[None] * 8, True, False)}
        for i in range(n)
    ]


def frame(spark, events):
    return spark.createDataFrame([tuple(e[c.split()[0]] for c in seeds.EVENT.split(", ")) for e in events], seeds.EVENT)


def answers(df):
    assert df.columns == NAMES
    rows = df.collect()
    out = {r.url: r.asDict() for r in rows}
    assert len(out) == len(rows)
    return out


def test_registry_fold(spark):
    """Blocks of one, three and all events, from nothing and from a registry that is there."""
    for seed in range(4):
        events = made(120, seed)
        for block in (1, 3, 4096):
            assert answers(seeds.after(frame(spark, events).repartition(3), block=block)) == loop(events)
    early = loop(events[:50])
    old = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in early.values()], seeds.STATE)
    assert answers(seeds.after(frame(spark, events[50:]), old, block=7)) == loop(events)
    assert seeds.after(frame(spark, []), block=7).count() == 0
    assert answers(seeds.after(frame(spark, []), old)) == early


def test_registry_stream(spark, tmp_path):
    """Micro-batches with rows in any order, each in a query that starts again from the checkpoint, against the batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events, place = made(90, 9), str(tmp_path)
        for i in range(3):
            part = events[30 * i : 30 * i + 30]
            random.Random(i).shuffle(part)
            frame(spark, part).coalesce(1).write.mode("append").parquet(f"{place}/in")
            stream = spark.readStream.schema(seeds.EVENT).parquet(f"{place}/in")
            registry.write(stream, f"{place}/out", f"{place}/checkpoint").awaitTermination()
            assert answers(registry.read(spark, f"{place}/out")) == loop(events[: 30 * i + 30])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert answers(seeds.after(frame(spark, events))) == answers(registry.read(spark, f"{place}/out"))


def greedy_loop(rows, most_rows, most_size, base, between):
    out, n, now = {}, -1, None
    for i, k, s in sorted(rows, key=lambda r: (r[1], r[0])):
        s = s or 0
        if now is None or now[0] != k or now[1] == most_rows or now[2] + between + s > most_size:
            n, now = n + 1, [k, 0, base - between]
        now = [k, now[1] + 1, now[2] + between + s]
        out[i] = (n, base + s > most_size)
    return out


def test_greedy_batches(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaabc"), rng.choice([None, 1, 5, 10, 50, 120])) for i in range(10_000)]
    df = spark.createDataFrame(rows, "id long, key string, size long").withColumn("batch", F.lit(1)).repartition(5)
    for most_rows, most_size, base, between, block in ((20, 100, 2, 1, 64), (7, 10**9, 0, 0, 16), (50, 300, 10, 2, 1 << 16)):
        out = batches.greedy(df, F.col("key"), [F.col("id")], F.col("size"), most_rows, most_size, base, between, block)
        assert out.columns == ["id", "key", "size", "batch", "_batch", "oversize"]
        assert {r.id: (r._batch, r.oversize) for r in out.collect()} == greedy_loop(rows, most_rows, most_size, base, between)
    assert batches.greedy(df.limit(0), F.col("key"), [F.col("id")], F.col("size"), 5, 5).count() == 0
