"""Small tables with every edge case, and brute force beside each operator."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sieveline.llm")
from sieveline.llm import bpe, fingerprint, langid, media, mixing, neardup, pii, repeats, toxicity, urlfilter
from sieveline.llm import text as tx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, start long, _key string, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, sources=None, langs=None):
    """Documents with extra columns whose names operators use themselves."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["a"] * len(texts))[i], len(t or ""), "k", 1, "k", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(seed, n, kinds=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, kinds, n))


def edges():
    long = sentence(1, 5000, 3000)
    base = sentence(2, 120)
    return [None, "", " \t\n", "one", "one two", "one two", base, base, base + " tail", base.replace("w1", "W1"), long, long + " x", sentence(3, 200), "ü " * 50, sentence(2, 60) + " " + sentence(4, 60)]


def components(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(sets):
            for j in range(i):
                if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return sets, root


def test_near_duplicates_edges(spark):
    texts = edges()
    sets, root = components(texts, 3, 85)
    got = {r.doc_id: r for r in neardup.near_duplicates(table(spark, texts), 3, 0.85).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].kept for i in range(len(texts))] == [root[i] == i for i in range(len(texts))]


def test_near_duplicates_cluster_with_fringe(spark):
    """Variants of one text, many of them only alike to the text itself or to none: stars alone would lose links."""
    base = sentence(5, 150, 10_000).split()
    texts = []
    for i in range(60):
        w = list(base)
        for j in np.random.default_rng(i).integers(0, len(w), i % 9):
            w[j] = f"e{i}x{j}"
        texts.append(" ".join(w))
    _, root = components(texts, 3, 85)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, texts), 3, 0.85).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_near_duplicates_chain(spark):
    words = [f"c{i}" for i in range(400)]
    texts = [" ".join(words[i * 8 : i * 8 + 200]) for i in range(12)]
    _, root = components(texts, 5, 80)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, texts), 5, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_keep_one_keeps_columns_and_null_ids(spark):
    docs = table(spark, edges()).union(spark.createDataFrame([(None, sentence(9, 30), "en", None, 1, "k", 1, "k", "c")], SCHEMA))
    out = neardup.keep_one(docs, 3, 0.85)
    assert out.columns == docs.columns
    assert out.where("doc_id is null").count() == 1


def test_band_rows_bound_misses():
    for t in (0.8, 0.85, 0.9):
        assert (1 - t ** neardup.band_rows(t)) ** neardup.BANDS <= 1e-6


def test_languages(spark):
    en = ["the cat and the dog are in the house " * 5, "this is a letter from the other town " * 5]
    de = ["der hund und die katze sind nicht im haus " * 5, "das ist ein brief aus einer anderen stadt " * 5]
    ru = ["собака и кошка живут в большом доме " * 5]
    train = table(spark, [*en, *de, *ru, None, ""], langs=["en", "en", "de", "de", "ru", "en", None])
    model = langid.train(train)
    assert model.langs == ["de", "en", "ru"]
    ask = table(spark, [None, "", "12 34 ...", "the dog is in the town", "die katze ist nicht da", "кошка дома", "漢字"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(ask, model).collect()}
    assert [got[i][0] for i in range(7)][:6] == ["und", "und", "und", "en", "de", "ru"]
    assert all(0 <= s <= 1 for _, s in got.values())
    both = table(spark, ["the dog and the cat are in the house " * 3 + "die katze und der hund sind nicht im haus " * 3])
    spans = langid.language_spans(both, model).orderBy("start").collect()
    assert [s.lang for s in spans] == ["en", "de"] and spans[-1].end == 54


def test_languages_without_training_rows(spark):
    model = langid.train(table(spark, ["a"], langs=[None]))
    assert [r.lang_pred for r in langid.languages(table(spark, ["hello"]), model).collect()] == ["und"]


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(0)
    at = np.array([0, 4, 4, 5, 10])
    scores, change = rng.normal(size=(10, 3)), rng.normal(size=(3, 3))
    import itertools

    for label, step in ((tx.viterbi(scores, at, change), change), (tx.viterbi_spans(scores, at, 0.7), np.where(np.eye(3, dtype=bool), 0, -0.7))):
        for a, b in zip(at[:-1], at[1:], strict=True):
            score = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) + sum(step[x, y] for x, y in itertools.pairwise(p))  # noqa: B023, E731
            best = max(itertools.product(range(3), repeat=int(b - a)), key=score)
            assert score(label[a:b]) == pytest.approx(score(best))


def test_bpe_is_exact(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    letters = list("aaabcdet  \n\t'.,-01\x1c\x85\xa0éß€漢😀")
    texts = [None, "", " ", "a" * 4000, "<|endoftext|> x<|endoftext|>", "it's we'll  \n\n  end "] + ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(300)]
    docs = table(spark, texts)
    out = bpe.encode(docs, path)
    assert out.columns == [*docs.columns, "token_ids"]
    ids = {r.doc_id: list(r.token_ids) for r in out.select("doc_id", "token_ids").collect()}
    want = [reference.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[i] for i in range(len(texts))] == want
    back = {r.doc_id: r.decoded for r in bpe.decode(out.select("doc_id", "token_ids"), path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    for r in bpe.digests(out.select("doc_id", "token_ids"), path).collect():
        t, i = texts[r.doc_id] or "", want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_media_round_trip(spark):
    texts = [None, "", "x" * 64, "x" * 65, "é" * 100, "a", "a", sentence(1, 30_000)]
    for r in media.described(table(spark, texts)).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44
    rows = media.audio_features(media.stored(table(spark, texts))).collect()
    assert all(len(r.log_mel) == media.WINDOW * media.MELS and r.t_end > r.t_start for r in rows)
    assert {r.doc_id for r in rows} == set(range(len(texts)))


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / media.RATE
    out = media.resample(np.sin(2 * np.pi * 440 * t))
    spectrum = np.abs(np.fft.rfft(out[500:5500]))
    assert abs(np.fft.rfftfreq(5000, 1 / 6000)[spectrum.argmax()] - 440) < 2


def test_hysteresis_segments():
    assert media.segments(np.array([0, 0, 3, 0.5, 0.5, 0, 0, 0.5, 0, 0, 0])).tolist() == [[2, 5]]


def removed(texts, window):
    rows = [WORD.findall(t or "") for t in texts]
    often = collections.Counter(tuple(w[i : i + window]) for w in rows for i in range(len(w) - window + 1))
    out = []
    for w in rows:
        cover = [False] * len(w)
        for i in range(len(w) - window + 1):
            if often[tuple(w[i : i + window])] > 1:
                cover[i : i + window] = [True] * window
        out.append((len(w), sum(cover), " ".join(x for x, c in zip(w, cover, strict=True) if not c)))
    return out


@pytest.mark.parametrize(("hot", "shard"), [(20_000, 1_000_000), (1, 1_000_000), (20_000, 200)])
def test_substring_dedup(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD", shard)
    passage = sentence(7, 60)
    texts = [None, "", "a b", *[f"{sentence(20 + i, 50)} {passage} {sentence(40 + i, 30)}" for i in range(6)], passage, "z " * 200, sentence(60, 100), sentence(60, 100), sentence(20, 34)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in repeats.without_repeats(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 35)


def test_fm_index_counts():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 499), 0)
    index = repeats.FMIndex(text, 4, 64)
    for n in (1, 2, 3, 5):
        at = rng.integers(0, 500 - n, 20)
        low, high = np.zeros(20, np.int64), np.full(20, 500)
        for k in range(n - 1, -1, -1):
            low, high = index.extend(text[at + k], low, high)
        assert (high - low).tolist() == [sum((text[j : j + n] == text[a : a + n]).all() for j in range(500 - n + 1)) for a in at]


def test_mixing(spark):
    texts = [sentence(i, 20 + 37 * i % 400) for i in range(300)] + [None, ""]
    sources = [None if i % 11 == 0 else f"s{i % 7}" if i % 3 else "s0" for i in range(302)]
    out = mixing.mix(table(spark, texts, sources)).collect()
    again = mixing.mix(table(spark, texts, sources)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == 302
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        s = sources[r.doc_id]
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.taken <= 2 * r.size
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, left = {}, set(order)
    while True:
        rest = 1.5 * sum(size.values()) - sum(full.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 2 * size[s]]
        if not over:
            break
        for s in over:
            full[s] = 2 * size[s]
            left.discard(s)
    want = full | {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 300 for s in order)
    texts_out = mixing.mixed_texts(table(spark, texts, sources))
    assert texts_out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sum(len(WORD.findall(r.text)) for r in texts_out.collect()) == sum(taken.values())


def test_mixing_without_words(spark):
    assert [(r.target, r.taken) for r in mixing.mix(table(spark, [None, ""])).collect()] == [(0.0, 0), (0.0, 0)]


def test_toxicity_learns_pairs_and_words(spark):
    rng = np.random.default_rng(3)
    texts, rows = [], []
    for i in range(400):
        w = [f"n{x}" for x in rng.integers(0, 50, 30)]
        bad = i % 8 == 0
        if bad:
            w[rng.integers(30)] = rng.choice(["insultone", "insulttwo"])
        texts.append(" ".join(w))
        rows.append((i, int(bad)))
    texts += [None, ""]
    labels = spark.createDataFrame([*rows, (9999, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(table(spark, texts), labels)
    score = {r.doc_id: r.score for r in toxicity.scored(table(spark, texts), machine).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, y in rows)
    assert score[400] == score[401] and 0 <= score[400] < 0.5
    docs = table(spark, texts)
    assert toxicity.keep_clean(docs, machine).columns == docs.columns
    assert toxicity.keep_clean(docs, machine).count() == 352


def test_toxicity_without_labels(spark):
    machine = toxicity.train(table(spark, ["a"]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score < 0.5 for r in toxicity.scored(table(spark, ["a", None]), machine).collect()] == [True, True]


def test_machine_gradient():
    """The factorization term is the sum over pairs of products of factors."""
    m = toxicity.Machine(np.arange(5), 0.3)
    m.weight, m.factor = np.arange(5) / 10, np.random.default_rng(0).normal(size=(5, toxicity.FACTORS))
    z, _ = m.raw(np.array([0, 0, 0]), np.array([1, 2, 4]), 1)
    pairs = sum(m.factor[a] @ m.factor[b] for a, b in ((1, 2), (1, 4), (2, 4)))
    assert z[0] == pytest.approx(0.3 + 0.7 + pairs)


def test_url_filters(spark):
    listed = spark.createDataFrame([("example.com", "block", "2024-01-10"), ("example.com", "release", "2024-02-01"), ("a.example.com/x/", "block", "2024-01-01"), (None, "block", "2024-01-01"), ("b.org", None, "2024-01-01")], "pattern string, action string, listed string").withColumn("listed", F.col("listed").cast("date"))
    asked = [("http://Example.com/", "2024-01-09"), ("http://example.com:80/y?q", "2024-01-10"), ("http://sub.example.com", "2024-01-31"), ("http://example.com", "2024-02-01"), ("http://a.example.com/x/y", "2024-02-05"), ("http://a.example.com/xy", "2024-02-05"), (None, "2024-01-15"), ("http://example.com/", None), ("no url", "2024-01-15"), ("http://example.com/", "2024-01-15"), ("http://example.com/", "2024-01-15")]
    rows = spark.createDataFrame([(u, d, "p") for u, d in asked], "url string, fetched string, _key string").withColumn("fetched", F.col("fetched").cast("date"))
    got = collections.Counter((r.url, str(r.fetched) if r.fetched else None, r.action, r.blocked) for r in urlfilter.judge(rows, listed).collect())
    actions = [None, "block", "block", "release", "block", "release", None, None, None, "block", "block"]
    assert got == collections.Counter((u, d, a, a == "block") for (u, d), a in zip(asked, actions, strict=True))
    assert urlfilter.judge(rows, listed.limit(0)).where("blocked").count() == 0


def test_fingerprints(spark):
    texts = [None, "", "a", sentence(1, 80), sentence(1, 80), sentence(2, 300), "é😀" * 40, sentence(3, 9000, 5000)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x, y = t or "", texts[(i + 1) % len(texts)] or ""
        e = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.fingerprint(x), fingerprint.fingerprint(e))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[3].fingerprint == got[4].fingerprint and got[3].near_next == 1 and got[5].near_next < 0.1


def test_fingerprints_of_one_row_and_repeats(spark):
    docs = table(spark, ["abc"])
    assert [r.near_next for r in fingerprint.fingerprints(docs).collect()] == [1.0]
    assert fingerprint.fingerprints(docs.union(docs).union(spark.createDataFrame([(None, "x", "en", "a", 1, "k", 1, "k", "c")], SCHEMA))).count() == 3


def test_prefix_hash_extensions():
    a, b = fingerprint.codes_of("xxhello worldyy"), fingerprint.codes_of("hello world!")
    p, q = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
    assert p.extension(2, q, 0) == 11 and p.extension(0, q, 0) == 0 and p.same(4, q, 2, 5)


def slow_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_personal_data(spark):
    rng = np.random.default_rng(6)
    letters = list("0123456789.@+- ()ab\né")
    texts = [None, "", "mail a.b@c.example.org now", "1" * 5000, "card 4556737586899855 and +1 (212) 555-0147", "+1 (826) 555-4081 190.137.223.20 end"] + ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(2000)]
    for r in pii.personal_data(table(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        base = slow_spans(t)
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(pii.written([s]) for s in base) <= set(every)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.without_personal_data(table(spark, texts[:6])).collect()}
    assert masked[0] == (None, None) and masked[2][0] == "mail <EMAIL> now" and masked[4][0] == "card <CARD> and <PHONE>"
    assert masked[5][0] == "<PHONE> <IP> end" and masked[5][1] == len(masked[5][0])


def test_field_fits_its_table():
    field = pii.Field().fit()
    for line in pii.LABELLED:
        words, labels = pii._labelled(line)
        assert tx.viterbi(field.emission(words), np.array([0, len(words)]), field.change, field.start).tolist() == labels


@pytest.mark.parametrize("run", [lambda d: neardup.near_duplicates(d), lambda d: repeats.without_repeats(d), lambda d: mixing.mix(d), lambda d: fingerprint.fingerprints(d), lambda d: media.described(d), lambda d: pii.personal_data(d), lambda d: langid.languages(d, langid.train(d)), lambda d: bpe.encode(d, pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
