"""The registered queries by their contracts, over whole tables, beside brute force; repeated ids and clashing names."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sieveline.llm")
from sieveline.llm import bpe, fingerprint, langid, media, mixing, neardup, pii, queries, repeats, toxicity, urlfilter
from sieveline.llm import text as tx

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def asked(spark, name):
    return {r.doc_id: r for r in queries.queries()[name](spark, SF).collect()}


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


@tables
def test_near_dedup_query(spark, docs):
    sets = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and root[a] != root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = asked(spark, "op1_near_dedup")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


@tables
def test_language_query(spark, docs):
    got = asked(spark, "op2_language_id")
    assert all(r.held_out == held(i, 3, 1) and 0 <= r.score <= 1 for i, r in got.items())
    told = [(i, x) for i, x in zip(docs.doc_id, docs.lang, strict=True) if x and got[i].held_out and got[i].lang_pred != "und"]
    assert sum(got[i].lang_pred == x for i, x in told) >= 0.95 * len(told) > 0


@tables
def test_bpe_query(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    reference = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = asked(spark, "op3_bpe")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def naive_feature(payload):
    """Resampling, framing, filterbank and segments by loops over single outputs."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    out = np.array([sum(media._PHASES[(4 * m) % 3][::-1][t] * (x[4 * m // 3 - 15 + t] if 0 <= 4 * m // 3 - 15 + t < len(x) else 0) for t in range(16)) for m in range(-(-len(x) * 3 // 4))])
    count = max(1, -(-(len(out) - 256) // 128) + 1)
    out = np.append(out, np.zeros(count * 128 + 256))
    power = np.array([np.abs(np.fft.rfft(out[128 * k : 128 * k + 256] * np.hanning(256))) ** 2 for k in range(count)])
    energy = 10 * np.log10(power.sum(1) + 1e-6)
    on, spans = False, []
    for k, e in enumerate(energy):
        if not on and e >= np.median(energy) + media.ON:
            on = True
            spans.append([k, k])
        on = on and e >= np.median(energy) + media.OFF
        if on:
            spans[-1][1] = k + 1
    return np.log10(power @ media._MEL + 1e-6), np.array(spans).reshape(-1, 2) * 128 / 6000


@tables
def test_media_query(spark, docs):
    got = asked(spark, "op4_media")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    for t in [None, "x" * 64, *docs.text[:3]]:
        payload = media.payload_of((t or "").encode())
        mels, spans = naive_feature(payload)
        packed = media.unpack(media.pack(*media.features(payload)))
        assert packed.column("log_mel").type == media.tensor_type()
        tensors = packed.column("log_mel").combine_chunks().to_numpy_ndarray()
        assert np.allclose(tensors.reshape(-1, media.MELS)[: len(mels)], mels, atol=2e-3) and not tensors.reshape(-1, media.MELS)[len(mels) :].any()
        assert np.allclose(np.unique([[s["start"], s["end"]] for w in packed.column("segments").to_pylist() for s in w] or np.zeros((0, 2)), axis=0), spans)
        starts = packed.column("t_start").to_numpy()
        assert np.allclose(starts, np.arange(len(starts)) * 64 * 128 / 6000) and packed.column("t_end")[-1].as_py() == pytest.approx(len(mels) * 128 / 6000)


@tables
def test_substring_query(spark, docs):
    rows = {i: WORD.findall(t or "") for i, t in zip(docs.doc_id, docs.text, strict=True)}
    often = collections.Counter(tuple(w[k : k + 35]) for w in rows.values() for k in range(len(w) - 34))
    got = asked(spark, "op5_substring_dedup")
    for i, w in rows.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if often[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), gone.sum(), hashlib.sha256(left.encode()).hexdigest())


def test_repeated_stretches_random():
    rng = np.random.default_rng(0)
    for _ in range(300):
        w, k = int(rng.integers(2, 7)), int(rng.integers(2, 9))
        parts = [rng.integers(0, k, rng.integers(1, 40)).astype(np.uint64) for _ in range(rng.integers(1, 6))]
        parts.append(np.concatenate([parts[0][3:], parts[-1]]))
        twice = rng.random(len(parts)) < 0.2
        often = collections.Counter()
        for p, t in zip(parts, twice, strict=True):
            for i in range(len(p) - w + 1):
                often[tuple(p[i : i + w])] += 1 + t
        got = [np.zeros(len(p), bool) for p in parts]
        for a, s, e in repeats.repeated(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), twice, w):
            got[a][s:e] = True
        for p, g in zip(parts, got, strict=True):
            want = np.zeros(len(p), bool)
            for i in range(len(p) - w + 1):
                if often[tuple(p[i : i + w])] > 1:
                    want[i : i + w] = True
            assert (g == want).all()


@tables
def test_mixing_query(spark, docs):
    got = asked(spark, "op6_mixing")
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    taken, target = collections.Counter(), {}
    for i, r in got.items():
        assert r.taken <= 2 * r.size
        taken[source[i]] += r.taken
        target[source[i]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in target)


def by_seats(claims, most, total):
    seats = [0] * len(claims)
    for _ in range(min(total, sum(most))):
        best = max((i for i in range(len(claims)) if seats[i] < most[i]), key=lambda i: (claims[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


@pytest.mark.parametrize(("claims", "most", "total", "ranked"), [([1000.0] + [0.6] * 200, [10_000] * 201, 1120, 10_000), ([1000.0] + [0.6] * 200, [10_000] * 201, 1120, 0), ([5.0] * 7, [3] * 7, 10, 10_000), ([7.0, 3.0, 1.0], [2, 2, 2], 100, 10_000)])
def test_quotas_are_sainte_lague(spark, monkeypatch, claims, most, total, ranked):
    monkeypatch.setattr(mixing, "RANKED", ranked)
    rows = spark.createDataFrame([*zip(range(len(claims)), claims, most, strict=True)], "k long, c double, m long")
    assert [r.quota for r in mixing.quotas(rows, total, "c", "m", "k").orderBy("k").collect()] == by_seats(claims, most, total)


def test_last_shard_quota(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        full, last = int(rng.integers(0, 6)), int(rng.integers(1, 100))
        n = -(-last // 10)
        rows.append((full, 100, last, 20, 2 * n, int(rng.integers(0, 2 * (full * 10 + n) + 1))))
    frame = spark.createDataFrame(rows, "full long, width long, last_words long, most_full long, most_last long, due long")
    got = [r.x for r in frame.withColumn("x", mixing._last_quota()).collect()]
    assert got == [by_seats([float(w)] * f + [float(x)], [mf] * f + [ml], due)[-1] for f, w, x, mf, ml, due in rows]


def test_mixing_small_sources(spark):
    rows = spark.createDataFrame([(i, "a b c d e", f"s{i % 5}") for i in range(30)], "doc_id long, text string, source string")
    taken, target = collections.Counter(), {}
    for r in mixing.mix(rows).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(225) and all(abs(taken[s] - target[s]) <= 1 for s in target)


@tables
def test_toxicity_query(spark, docs):
    got = asked(spark, "op7_toxicity")
    machine = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out(5, 0)))
    assert all(r.held_out == held(i, 5, 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    for i, t in list(zip(docs.doc_id, docs.text, strict=True))[:40]:
        # A scorer by loops over the terms of the whole text and their pairs.
        raw = np.frombuffer((t or "").encode(), np.uint8)
        terms = {int(machine.place[b]) for _, bs in toxicity.term_buckets(raw, np.array([0, len(raw)])) for b in bs.tolist() if machine.place[b] >= 0}
        z = machine.bias + sum(machine.weight[k] for k in terms) + sum(machine.factor[a] @ machine.factor[b] for a in terms for b in terms if a < b)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)


def test_toxicity_of_pairs_only(spark):
    """An insult and a group are harmless alone and toxic together."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1200):
        w = [f"n{x}" for x in rng.integers(0, 50, 20)]
        kind = i % 6
        if kind in (0, 1, 2):
            w[0] = "insultword"
        if kind in (0, 3, 4):
            w[1] = "groupword"
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(docs.where("doc_id < 900"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.scored(docs, machine).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, y in labels if i >= 900)


@tables
def test_fingerprint_query(spark, docs):
    got = asked(spark, "op9_fingerprints")
    rows = sorted(zip(docs.doc_id, docs.text.fillna(""), strict=True))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.same_edited, r.same_next) == tuple(len(os.path.commonprefix([t, x])) for x in (edited, after))


def test_fingerprints_in_small_blocks(monkeypatch):
    """Hashes and extensions across blocks are those of one block; the least hashes are a loop's."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 300))) for _ in range(60)]
    texts += [t[:100] + "c" + t for t in texts[:20]]
    one = [fingerprint._Text(t) for t in texts]
    monkeypatch.setattr(fingerprint, "_BLOCK", 64)
    for a, b, t, u in zip(one, one[1:], texts, texts[1:], strict=False):
        x, y = fingerprint._Text(t), fingerprint._Text(u)
        assert x.mark == a.mark and sorted(x.hashes.tolist()) == sorted(a.hashes.tolist())
        assert x.prefix.extension(0, y.prefix, 0) == len(os.path.commonprefix([t, u])) == a.prefix.extension(0, b.prefix, 0)
        if len(t) > 70 and len(u) > 40:
            assert x.prefix.extension(70, y.prefix, 33) == len(os.path.commonprefix([t[70:], u[33:]]))


@tables
def test_pii_query(spark, docs):
    got = asked(spark, "op10_pii")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        base = pii.base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert {pii.written([s]) for s in base} <= set(got[i].spans.split(","))


def test_field_beyond_the_rules():
    """Lines that are not in the labelled table."""
    field = pii.Field().fit()
    lines = ("please call {phone:(312) 555-0188} soon", "tel {phone:089 7654321} danke", "call {phone:(917) 555-0123} now or {phone:+1 (917) 555-0124}", "fax: {phone:(069) 555-4321}", "telefono {phone:933 221 100} hoy", "the year 1999 had (365) days and 555-0101 parts", "items 089 7654321 in stock", "between 912 and 345 678 units", "{card:4845168114407329} {card:7536784127813050} fin")
    for line in lines:
        words, labels = pii._labelled(line)
        assert tx.viterbi(field.emission(words), np.array([0, len(words)]), field.change, field.start).tolist() == labels
    got = dict(zip(("a", "b"), pii.find(["call (312) 555-0188 now", "card 4845168114407329 7536784127813050"], field), strict=True))
    assert got["a"] == ([], [("phone", 5, 19)]) and not got["b"][0] and len(got["b"][1]) == 2


def test_caches_are_bounded():
    field = pii.Field().fit()
    for k in range(3):
        field.emission([f"{k}a{i}" for i in range(pii.KNOWN)])
    field.emission(["1" * 1000])
    assert len(field.known) <= pii.KNOWN and max(map(len, field.known)) <= pii.LONG
    public = pytest.importorskip("public_tokenizers")
    encoder = bpe.Encoder(bpe.read_vocabulary(public.path("byte_bpe_50k.json")))
    encoder.encode("a" * 5000)
    assert max(map(len, encoder.known), default=0) <= bpe.LONG


def test_scripts_rule_languages_out(spark):
    rows = spark.createDataFrame([(1, "собака и кошка живут в доме " * 5, "ru"), (2, "the dog lives in the house " * 5, "en")], "doc_id long, text string, lang string")
    model = langid.train(rows)
    got = [r.lang_pred for r in langid.languages(spark.createDataFrame([(1, "zq" * 150), (2, "ж" * 300)], "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got == ["en", "ru"]


CLASH = ["_key", "key", "spans", "mark", "_mark", "n_words", "node", "_id", "row", "pattern", "action", "at", "source_key", "bucket", "made"]


def clashing(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, url string, fetched string")
    return frame.withColumn("fetched", F.col("fetched").cast("date")).withColumns({c: F.lit(f"mine {c}") for c in CLASH})


def test_clashing_names_and_repeated_ids(spark):
    words = lambda seed, n: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 9000, n))
    a, b = words(1, 60), words(2, 60)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (None, a), (5, None), (6, "")]
    docs = clashing(spark, [(i, t, "s", "en", len(t or ""), "http://a.example.com/x/1", "2024-01-05") for i, t in rows])
    near = neardup.near_duplicates(docs, 3, 0.85).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in near) == sorted([("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 1, False), ("3", 1, False), ("None", 1, True), ("5", 5, True), ("6", 6, True)])
    unlike = docs.where("doc_id is not null and doc_id <> 1 or text like '%w%' and doc_id = 1").withColumn("doc_id", F.when(F.col("doc_id") == 1, 4).otherwise(F.col("doc_id")))
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(unlike, 3, 0.85).collect()) == [(2, 2), (3, 3), (3, 3), (4, 2), (4, 3), (5, 5), (6, 6)]
    one = neardup.keep_one(unlike, 3, 0.85)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == [2, 3, 3, 5, 6]
    left = repeats.without_repeats(docs, 35)
    assert left.columns == [*docs.columns, "_n_words", "n_removed"] and left.where("_key <> 'mine _key' or spans <> 'mine spans'").count() == 0
    assert collections.Counter(r.n_removed for r in left.collect()) == collections.Counter([60] * 4 + [61, 61, 0, 0])  # the row that occurs twice repeats to its end
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns and mixed.where(" or ".join(f"{c} <> 'mine {c}'" for c in CLASH)).count() == 0
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in mixing.mix(docs).collect()) > 0
    listed = spark.createDataFrame([("example.com", "block", "2024-01-01")], "pattern string, action string, listed string").withColumn("listed", F.col("listed").cast("date"))
    judged = urlfilter.judge(docs, listed)
    assert judged.columns == [*docs.columns, "_pattern", "_action", "blocked"] and judged.where("blocked").count() == len(rows)
    for out in (media.described(docs), fingerprint.fingerprints(docs), pii.personal_data(docs), langid.languages(docs, langid.train(docs)), toxicity.scored(docs, toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")))):
        assert out.count() == len(rows)
    assert toxicity.keep_clean(docs, toxicity.train(docs, spark.createDataFrame([(2, 0)], "doc_id long, toxic int"))).columns == docs.columns
    assert pii.without_personal_data(docs).columns == docs.columns


def test_empty_tables_of_the_others(spark):
    none = clashing(spark, [])
    machine = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(none, machine).count() == toxicity.keep_clean(none, machine).count() == 0
    assert urlfilter.judge(none, urlfilter.sample_list(spark)).count() == 0
    assert mixing.mixed_texts(none).count() == neardup.keep_one(none).count() == pii.without_personal_data(none).count() == 0


def test_blocks_of_any_size_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "HELD", 500)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        for j in np.random.default_rng(i).integers(0, len(w), i % 9):
            w[j] = f"e{i}x{j}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    small = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 3, 0.85).collect()}
    monkeypatch.undo()
    assert small == {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 3, 0.85).collect()}


@tables
def test_fingerprints_by_span(spark, docs):
    """The query's likeness between neighbours is that of the operator's own fingerprints, and equal texts have equal ones."""
    got = asked(spark, "op9_fingerprints")
    by_text = collections.defaultdict(set)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        by_text[t or ""].add(got[i].fingerprint)
        edited = got[i].edited_fingerprint
        if edited == got[i].fingerprint:
            assert got[i].near_edited == 1.0
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert all(len(f) == 1 for f in by_text.values())


@tables
def test_mix_by_document(spark, docs):
    """What the mix takes of every document: none more than twice, each source near its target, and the same again in another run."""
    first, second = asked(spark, "op6_mixing"), asked(spark, "op6_mixing")
    taken = collections.Counter()
    sources = dict(zip(docs.doc_id, docs.source, strict=True))
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        size = len(WORD.findall(t or ""))
        assert first[i].size == size and 0 <= first[i].taken <= 2 * size
        assert (first[i].taken, first[i].target, first[i].source_size) == (second[i].taken, second[i].target, second[i].source_size)
        taken[sources[i]] += first[i].taken
    targets = {sources[i]: r.target for i, r in first.items()}
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(128, 0.02 * target)


@tables
def test_media_features_of_the_query(spark, docs):
    """Equal texts have equal media and features, and unlike payloads unlike ones."""
    got = asked(spark, "op4_media")
    told = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        r = got[i]
        one = (r.media_bytes, r.media_sha256, r.feature)
        assert told.setdefault(t or "", one) == one and r.media_bytes > r.payload_bytes
    assert len({x[1] for x in told.values()}) == len(told)
