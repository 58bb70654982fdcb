"""The training-data operators: edge cases, round trips, brute force and held-out accuracy."""

import dataclasses
import datetime
import hashlib
import hmac
import itertools
import re
import zlib

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF

from framewright.llm import audio, bpe, chat, decontam, huffman, licenses, near_dup, pii, quality, queries, scratch, token_files, toxicity, training
from framewright.llm import components as components_module
from framewright.llm.components import components

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew very strange potions in deep caves".split()
LONG = " ".join(WORDS * 3000)
ODD = [None, "", " ", "\n\n", "a", "Ünïcode  text\twith\r\ntabs", "same text", "same text", LONG, "x" * 5000, "<|endoftext|> in text", "\0 nul \x1c"]


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


def frame(spark, texts, **extra):
    rows = [(i, t, f"m{i}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, maybe string, node long")


def by_id(df):
    return df.toPandas().sort_values("doc_id").reset_index(drop=True)


# op1


def stored_features(spark, texts):
    return scratch.materialize(audio.store_features(scratch.materialize(audio.encode(frame(spark, texts)), "media")), "features")


def test_audio_reads_back_what_it_stored(spark):
    got = by_id(audio.analyse(stored_features(spark, ODD)))
    assert len(got) == len(ODD)
    for t, r in zip(ODD, got.itertuples(), strict=True):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
        wav = audio.write_wav(want, 16_000)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
    assert got.feature[6] == got.feature[7] and got.feature[0] == got.feature[1]
    assert audio.analyse(stored_features(spark, [])).count() == 0
    same = spark.createDataFrame([(None, "a b", 1), (7, "a b", 2), (7, "a b", 3)], "doc_id long, text string, media int")
    rows = audio.analyse(audio.store_features(audio.encode(same))).toPandas()
    assert rows.doc_id.isna().sum() == 1 and rows.feature.nunique() == 1 and len(rows) == 3


def plain_features(text, c):
    """Log-mel hundredths and segments, straight from the formulas."""
    x = (np.frombuffer(audio.payload(text), np.uint8).astype(float) - 128) / 128
    y = []
    for j in range(-(-len(x) * c.up // c.down)):
        n = np.arange(int(j * c.down / c.up) - 10, int(j * c.down / c.up) + 11)
        d = n - j * c.down / c.up
        w = np.where(np.abs(d) < 8, np.sinc(c.up / c.down * d) * (0.5 + 0.5 * np.cos(np.pi * d / 8)), 0)
        ok = (n >= 0) & (n < len(x))
        y.append((x[n[ok]] * w[ok]).sum() / w.sum())
    y = np.array(y)
    frames = max(1, -(-(len(y) - c.frame) // c.hop) + 1)
    y = np.concatenate([y, np.zeros(frames * c.hop + c.frame)])
    k = np.arange(c.frame // 2 + 1)
    turn = np.exp(-2j * np.pi * np.outer(k, np.arange(c.frame)) / c.frame)
    to_mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    mels, energy = [], []
    for f in range(frames):
        own = y[f * c.hop : f * c.hop + c.frame]
        power = np.abs(turn @ (own * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(c.frame) / (c.frame - 1))))) ** 2 / c.frame
        row = []
        for m in range(c.mels):
            left, mid, right = (to_mel(c.out_rate / 2) * (m + i) / (c.mels + 1) for i in range(3))
            row.append(sum(p * max(0, min((to_mel(b * c.out_rate / c.frame) - left) / (mid - left), (right - to_mel(b * c.out_rate / c.frame)) / (right - mid))) for b, p in enumerate(power)))
        mels.append(1000 * np.log10(np.maximum(row, 1e-6)))
        energy.append(round(1000 * np.log10(max(own.var(), 1e-9))))
    spans, since = [], None
    for f, e in enumerate(energy):
        if since is None and e >= c.rise:
            since = f
        elif since is not None and e < c.fall:
            spans.append((since, f))
            since = None
    return np.array(mels), spans + ([(since, frames)] if since is not None else [])


def test_audio_features_equal_the_formulas(spark):
    c = audio.AudioConfig()
    texts = [" ".join(WORDS * 3), "short", "a" * 700 + "~" * 900 + "a" * 700, "é" * 300, None, "\x00\xff" * 400, " ".join(WORDS * 60)]
    stored = stored_features(spark, texts)
    cubes = audio.mel_tensors(stored).toPandas().sort_values(["doc_id", "tensor_no"])
    spans = audio.energy_segments(stored).toPandas().sort_values(["doc_id", "segment_no"])
    for k, t in enumerate(texts):
        mels, segs = plain_features(t, c)
        own = cubes[cubes.doc_id == k]
        got = np.concatenate([np.array(x).reshape(c.tensor_frames, c.mels)[:n] for x, n in zip(own.tensor, own.frames, strict=True)])
        assert got.shape == mels.shape and np.abs(got * 100 - mels).max() <= 0.51
        assert own.start_s.tolist() == pytest.approx([n * c.tensor_frames * c.hop / c.out_rate for n in range(len(own))])
        assert own.end_s.iloc[-1] == pytest.approx(((len(mels) - 1) * c.hop + c.frame) / c.out_rate)
        rows = spans[spans.doc_id == k]
        assert [*rows.start_s, *rows.end_s] == pytest.approx([x * c.hop / c.out_rate for side in zip(*segs, strict=True) for x in side])
    assert len(spans) > 1


def test_audio_blocks_equal_one_pass(monkeypatch):
    wav = audio.write_wav(audio.payload(LONG), 16_000)
    whole = audio.features(wav, audio.AudioConfig())
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 17)
    parts = audio.features(wav, audio.AudioConfig())
    assert np.abs(whole["mels"] - parts["mels"]).max() <= 1 and whole["segments"] == parts["segments"]


def test_audio_tone_and_tensors(spark):
    c = audio.AudioConfig()
    t = np.arange(16_000)
    tone = (128 + 100 * np.sin(2 * np.pi * 500 * t / 16_000) * (t > 8000)).astype(np.uint8).tobytes()
    got = audio.features(audio.write_wav(tone, 16_000), c)
    ((first, last),) = got["segments"]
    assert abs(first * c.hop / c.out_rate - 0.5) < 0.06 and last == len(got["energy"])
    row = stored_features(spark, [LONG]).first()
    table = pa.ipc.open_stream(row.tensors).read_all()
    assert table.schema.field("tensor").type == pa.fixed_shape_tensor(pa.int16(), (c.tensor_frames, c.mels)) and table.num_rows > 1


# op2


def near_copies():
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(12):
        base = [f"w{rng.integers(5000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 4)):
            other = list(base)
            other[rng.integers(200)] = f"n{rng.integers(10**6)}"
            texts.append(" ".join(other))
    hot = [f"h{k}" for k in range(300)]
    texts += [" ".join([*hot[:k], f"z{k}", *hot[k + 1 :]]) for k in range(0, 120)]
    return texts + [None, "", "", "one two", "one two", texts[0]]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies()
    docs = frame(spark, texts)
    got = by_id(near_dup.NearDuplicates(docs).classes())
    root = brute.classes(len(texts), brute.similar_pairs(texts))
    assert got.class_id.tolist() == root
    kept = near_dup.NearDuplicates(docs).keep_one()
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_recall_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")).select("text").distinct().toPandas()
    texts = [*docs.text, *near_copies(), *ODD]
    pairs = [p for p in brute.similar_pairs(texts) if texts[p[0]] != texts[p[1]]]
    got = by_id(near_dup.NearDuplicates(frame(spark, texts)).classes()).class_id
    assert len(pairs) > 50 and np.mean([got[a] == got[b] for a, b in pairs]) >= 0.97
    root = brute.classes(len(texts), brute.similar_pairs(texts))
    assert all(root[i] == root[c] for i, c in enumerate(got))  # and nothing else is joined


def test_large_buckets_lose_nothing(spark, monkeypatch):
    """Families of texts about the threshold, in buckets of many chunks and few pivots."""
    for name, value in (("CHUNK", 10), ("FEW_PIVOTS", 1), ("HOT_ROWS", 20)):
        monkeypatch.setattr(near_dup, name, value)
    rng = np.random.default_rng(7)
    texts = []
    for f in range(2):
        base = [f"f{f}w{k}" for k in range(150)]
        for _ in range(70):
            own = list(base)
            for at in rng.choice(30, rng.integers(1, 5), replace=False):
                own[5 * at] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(own))
    pairs = brute.similar_pairs(texts)
    apart = len(set(brute.classes(len(texts), pairs)))
    assert 3 < apart < 100
    got = by_id(near_dup.NearDuplicates(frame(spark, texts), config=near_dup.DedupConfig(bands=40, rows=2)).classes())
    assert got.class_id.tolist() == brute.classes(len(texts), pairs)


def test_similar_texts_share_a_rare_shingle():
    rng = np.random.default_rng(2)
    for _ in range(200):
        base = [f"w{k}" for k in range(40)]
        texts = []
        for _ in range(2):
            own = list(base)
            own[rng.integers(40)] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(own))
        s = near_dup.Shingles.of(pa.array(texts), 5)
        df = rng.integers(1, 4, len(s.key)).astype(np.uint32)
        for key in np.unique(s.key):
            df[s.key == key] = df[s.key == key][0]
        weight = s.weigh(df, 100)
        doc, key = near_dup.prefix(s, weight, df, 0.8)
        one, two = s.doc == 0, s.doc == 1
        if near_dup.weighted_jaccard(s.key[one], weight[one], s.key[two], weight[two]) >= 0.8:
            assert set(key[doc == 0]) & set(key[doc == 1])
        assert len(key) < len(s.key)


def test_document_frequencies_are_exact(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PART_BYTES", 1 << 17)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{w}" for w in rng.integers(5000, size=300)) for _ in range(300)]
    texts += [*texts[:40], None, "", "one two", texts[0] + " " + texts[1]]
    s = near_dup.Shingles.of(pa.array(texts, pa.string()), 5)
    _, at, n = np.unique(s.key, return_inverse=True, return_counts=True)
    got = by_id(near_dup.NearDuplicates(frame(spark, texts)).signatures)
    assert np.concatenate([np.frombuffer(x, np.uint32) for x in got.df]).tolist() == n[at].tolist()


def test_near_duplicates_of_little(spark):
    assert near_dup.NearDuplicates(frame(spark, [])).classes().count() == 0
    twice = frame(spark, ["same words here and there now"]).union(frame(spark, ["same words here and there now"]))
    assert near_dup.NearDuplicates(twice).keep_one().count() == 1


@pytest.mark.parametrize("hot", [10_000, 3])
def test_components_of_a_path_and_a_star(spark, monkeypatch, hot):
    monkeypatch.setattr(components_module, "HOT_LINKS", hot)
    links = [(159 - k, 159) for k in range(20)] + [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k <= 40} == {k: 0 for k in range(41)} and {v for k, v in got.items() if k > 40} == {100}


# op3


def test_licences(spark, duck):
    texts = [*ODD, "Released under the MIT license", "prose\nLicensed under CC BY-NC 4.0.\nprose", "Released under the licence of MIT-like kinds", "this work is licensed under the gnu general public license, version 3"]
    got = by_id(licenses.summary(frame(spark, texts)))
    assert got.templates[len(ODD) :].tolist()[:2] == ["MIT", "CC-BY-NC-4.0"] and got.n_matches[: len(ODD)].sum() == 0
    assert got.best_template.iloc[-1] == "GPL-3.0"
    duck.execute("create or replace temp view t as select 1")
    want = duck.execute(licenses.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    mine = by_id(queries.op3_licence_scan(spark, SF))
    assert mine.templates.tolist() == want.templates.tolist() and mine.n_matches.tolist() == want.n_matches.tolist()


def test_wrapped_and_inline_notices(spark):
    gpl = licenses.TEMPLATES["GPL-3.0"].split()
    texts = ["first\n" + " ".join(gpl[:6]) + "\n" + " ".join(gpl[6:]) + "\nlast", "\n".join(" ".join(gpl[k : k + 4]) for k in range(0, len(gpl), 4)), "Some words here. Licensed under CC BY 4.0. More words follow here.", licenses.TEMPLATES["MIT-text"].lower().replace("\n", "\n\n"), "x\n" * 3000 + licenses.TEMPLATES["ISC-text"], *ODD]
    docs = spark.createDataFrame([(k, t, "u") for k, t in enumerate(texts)], "doc_id long, text string, units string")
    got = by_id(licenses.scan(docs))
    named = [{m["template"] for m in row} for row in got.licences]
    assert named[:4] == [{"GPL-3.0"}, {"GPL-3.0"}, {"CC-BY-4.0"}, {"MIT-text"}] and not any(named[5:])
    assert got.columns.tolist() == ["doc_id", "text", "units", "licences"] and licenses.scan(docs.limit(0)).count() == 0


def test_licence_pruning_loses_nothing():
    words = licenses.telling_words({k: licenses.bigrams_of(licenses.normalised_words(t)) for k, t in licenses.TEMPLATES.items()}, 0.8)
    rng = np.random.default_rng(0)
    for t in licenses.TEMPLATES.values():
        g = set(licenses.bigrams_of(licenses.normalised_words(t)))
        for _ in range(50):
            unit = [w for w in licenses.normalised_words(t) if rng.random() > 0.1]
            u = set(licenses.bigrams_of(unit))
            if u and 2 * len(u & g) / (len(u) + len(g)) >= 0.8:
                assert any(w in x for w in words for x in unit)


# op4 and op6


def synthetic(n=900):
    rng = np.random.default_rng(1)
    bad, good = ["idiot", "moron", "scum"], [f"word{k}" for k in range(400)]
    texts, toxic, quality_ = [], [], []
    for _ in range(n):
        words = list(rng.choice(good, rng.integers(20, 120)))
        toxic.append(int(rng.random() < 0.2))
        quality_.append(int(rng.random() > 0.2))
        if toxic[-1]:
            words[rng.integers(len(words))] = str(rng.choice(bad))
        text = " ".join(words)
        texts.append(text if quality_[-1] else text.upper().replace(" ", "!! "))
    return texts, toxic, quality_


def accuracy(scored, truth, cut):
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id])
    return ((scored.score >= cut) == (np.array(truth) == 1))[held].mean()


def test_classifiers_on_held_out_rows(spark):
    texts, toxic, good = synthetic()
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(zip(good, toxic, strict=True))], "doc_id long, quality int, toxic int")
    assert accuracy(by_id(toxicity.score(docs, toxicity.fit(docs, labels))), toxic, 0.5) > 0.97
    model = quality.fit(docs, labels)
    assert accuracy(by_id(quality.score(docs, model)), good, 0.3) > 0.97
    odd = by_id(quality.score(frame(spark, ODD), model))
    assert odd.score.between(0, 1).all() and odd.score[6] == odd.score[7]
    assert quality.keep_good(frame(spark, ODD), model).columns == frame(spark, ODD).columns


def test_classifiers_without_labels(spark):
    docs, none = frame(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert (by_id(toxicity.score(docs, toxicity.fit(docs, none))).score < 0.5).all()
    assert (by_id(quality.score(docs, quality.fit(docs, none))).score > 0.3).all()
    assert toxicity.score(frame(spark, []), toxicity.fit(docs, none)).count() == 0


def test_unlabelled_learning_equals_a_plain_one():
    """The same steps with dense matrices, and gradients of the risk by differences."""
    rng = np.random.default_rng(0)
    c = dataclasses.replace(toxicity.PUConfig(), bits=8, least_docs=1, least_z=1.0, steps=25, batch=10_000)
    make = lambda n, share: [np.unique(np.concatenate([rng.integers(0, 200, 12), rng.choice([230, 231, 232], 2) if rng.random() < share else np.zeros(0, int)])).astype(np.int64) for _ in range(n)]
    positive, unlabelled = make(60, 0.95), make(400, 0.2)
    prior = 0.2
    model = toxicity.train(positive, unlabelled, prior, c)
    kept = toxicity.enriched(positive, unlabelled, c)
    dense = [np.array([np.isin(kept, x) for x in rows], dtype=float) for rows in (positive, unlabelled)]
    dense = [np.hstack([x, np.ones((len(x), 1))]) for x in dense]
    soft = lambda z: np.logaddexp(0, z).mean()
    positive_part = lambda t: prior * soft(-dense[0] @ t)
    negative_part = lambda t: soft(dense[1] @ t) - prior * soft(dense[0] @ t)

    def slope(f, t):
        return np.array([(f(t + d) - f(t - d)) / 2e-6 for d in 1e-6 * np.eye(len(t))])

    t = np.append(np.zeros(len(kept)), np.log(prior / (1 - prior)))
    m, v, turned = np.zeros_like(t), np.zeros_like(t), 0
    for step in range(1, c.steps + 1):
        if negative_part(t) >= 0:
            g = slope(positive_part, t) + slope(negative_part, t)
        else:
            g, turned = -slope(negative_part, t), turned + 1
        g[:-1] += c.l2 * t[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        t = t - c.rate * (1 - step / (c.steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.abs(np.append(model.weights[kept], model.bias) - t).max() < 1e-3 and len(kept) >= 3


def test_prior_without_negatives():
    rng = np.random.default_rng(1)
    c = toxicity.PUConfig()
    for prior in (0.05, 0.2, 0.5):
        p = rng.normal(3, 1, 2000)
        u = np.where(rng.random(12_000) < prior, rng.normal(3, 1, 12_000), rng.normal(-1, 1, 12_000))
        assert abs(toxicity.class_prior(p, u, c) - prior) < 0.03
        cut = toxicity.best_cut(p, u, prior)
        assert abs(cut - (1 + np.log((1 - prior) / prior) / 4)) < 0.5  # where the densities' shares are equal


def test_samples_keep_their_bound(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k} of {k % 7}") for k in range(800)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 40, k % 2) for k in range(500)], "doc_id long, toxic int")
    rows = training.labelled_sample(docs, labels, "toxic", 10).collect()
    assert 0 < len(rows) <= 10 and sorted(rows) == sorted(training.labelled_sample(docs.repartition(7), labels.repartition(5), "toxic", 10).collect())
    assert 0 < training.unlabelled_sample(docs, 10).count() <= 10
    same = spark.createDataFrame([(k, "copy") for k in range(50)], "doc_id long, text string")
    assert training.unlabelled_sample(same, 30).count() == 1


def test_ranking_against_a_plain_fit():
    """Pairwise learning orders unseen rows as well as a pointwise logistic fit over the same bins."""
    rng = np.random.default_rng(2)
    n, k = 3000, len(quality.FIGURES)
    x = rng.normal(size=(2 * n, k))
    true = 1.5 * x[:, 0] - 2 * np.abs(x[:, 1]) + x[:, 2]
    y = (true + rng.logistic(size=2 * n) > np.median(true)).astype(float)
    model = quality.train(x[:n], y[:n], quality.RankConfig())
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    design = np.hstack([np.eye(len(e) + 1)[at] for at, e in zip(bins, model.edges, strict=True)])
    w = np.zeros(design.shape[1])
    for _ in range(1500):
        w += 0.3 * (design[:n].T @ (y[:n] - 1 / (1 + np.exp(-design[:n] @ w))) / n - 1e-4 * w)
    auc = lambda s: (np.argsort(np.argsort(s))[y[n:] == 1].mean() - (y[n:].sum() - 1) / 2) / (n - y[n:].sum())
    assert auc(model.strength(x[n:])) > auc(design[n:] @ w) - 0.02
    scores = model.score(x[:n])
    assert abs((scores >= quality.RankConfig().cut_score).mean() - y[:n].mean()) < 0.01


def test_ranking_learns_from_every_row_and_pair(spark):
    """The loss, the pushes and the cut are those of all pairs, from the counts by strength; the fit in Spark is
    the fit in memory, whatever the partitions."""
    rng = np.random.default_rng(4)
    counts = np.column_stack([rng.permutation(900)[:60] - 450, rng.integers(0, 4, (60, 2))])
    loss, low, push = quality.all_pairs(counts)
    good, poor = (np.repeat(counts[:, 0], counts[:, k]) for k in (1, 2))
    gap = (poor[:, None] - good[None]) * quality.UNIT
    assert abs(loss - np.log1p(np.exp(gap)).mean()) < 1e-9
    wrong = 1 / (1 + np.exp(-gap))
    assert np.allclose(push[0][poor - low], wrong.mean(axis=1)) and np.allclose(push[1][good - low], wrong.mean(axis=0))

    n = 2000
    x = rng.normal(size=(n, len(quality.FIGURES)))
    y = (x[:, 0] + rng.logistic(size=n) > -1).astype(float)
    held = quality.train(x, y, quality.RankConfig())
    assert held.edges.shape == (len(quality.FIGURES), 30)
    rows = spark.createDataFrame([(float(b), bytearray(a.tobytes())) for a, b in zip(x, y, strict=True)], "y double, x binary")
    for parts in (1, 5):
        stored = quality.descend(quality.StoredRows(rows.repartition(parts)), quality.RankConfig())
        assert (stored.weights == held.weights).all() and (stored.edges == held.edges).all() and stored.cut == held.cut and stored.slope == held.slope
    assert abs((held.strength(x) >= held.cut).mean() - y.mean()) < 0.01


# op5


def test_pseudonyms(spark):
    texts = ["pay 4539 1488 0343 6467 or 4539148803436467", "born 1987-02-28, 31.12.1999", "bad 1987-02-30 4539148803436468 300.1.1.1", "call +1 (414) 555-7134", "hein.19@mail5.example.com at 10.0.0.1", "DE89370400440532013000", "123-45-6789 666-45-6789", *ODD]
    docs = frame(spark, texts)
    out = pii.pseudonymise(docs, "k", found="kinds")
    got = by_id(out)
    assert got.kinds.map(list).tolist()[:7] == [["card", "card"], ["date", "date"], [], ["phone"], ["email", "ip"], ["iban"], ["national"]]
    assert got.text[2] == texts[2] and got.text[7:].tolist() == [t for t in ODD]
    a, b = got.text[0].removeprefix("pay ").split(" or ")
    assert a.replace(" ", "") == b and a != "4539 1488 0343 6467" and [len(x) for x in a.split()] == [4, 4, 4, 4]
    digits = [int(d) for d in b][::-1]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    iban = got.text[5]
    assert iban[:2] == "DE" and int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97 == 1
    assert by_id(pii.pseudonymise(docs, "k")).text.equals(got.text) and by_id(pii.pseudonymise(docs, "other")).text[0] != got.text[0]
    pd.to_datetime(got.text[1][5:15])
    assert out.columns == [*docs.columns, "kinds"]


def test_cards_beside_other_numbers(spark):
    card, plain, other = "4539 1488 0343 6467", "4539148803436467", "5500000000000004"
    texts = [f"{card} 12/27", f"7 {card}", f"{plain} 123", f"{plain} {other}", f"2024 {card} 123", f"{card} 414-555-7134", "3782 822463 10005 1234", f"{card} {card}", "45391 48803 436467", f"password={plain}", f"{plain}@example.com"]
    cards = [[card], [card], [plain], [plain, other], [card], [card], ["3782 822463 10005"], [card], ["45391 48803 436467"], [], []]
    got = by_id(pii.pseudonymise(frame(spark, texts), "k", found="kinds"))
    assert got.kinds.map(list).tolist() == [["card"]] * 3 + [["card"] * 2, ["card"], ["card", "phone"], ["card"], ["card"] * 2, ["card"], ["secret"], ["email"]]
    assert not any(c in t for t, cs in zip(got.text, cards, strict=True) for c in cs)
    assert got.text[0].endswith(" 12/27") and got.text[1].startswith("7 ") and got.text[2].endswith(" 123") and got.text[6].endswith(" 1234")
    assert got.text[4].startswith("2024 ") and got.text[4].endswith(" 123") and got.text[7][:19] == got.text[7][20:] == got.text[0][:19]


def test_names_in_capitals_foreign_phones_and_short_dates(spark):
    text = "PASSWORD=Hunter2abcdef Password: Hunter2abcdef API_KEY=abcdefgh12345 +49 30 12345678 or +493012345678, on 1/2/1990 and 01/02/1990, 1.2.1990"
    (got,) = by_id(pii.pseudonymise(frame(spark, [text]), "k", found="kinds")).itertuples()
    assert list(got.kinds) == ["secret"] * 3 + ["phone"] * 2 + ["date"] * 3
    assert not any(x in got.text for x in ("Hunter2abcdef", "abcdefgh12345", "30 12345678", "3012345678", "1/2/1990", "01/02/1990", "1.2.1990"))
    one, two = re.search(r"(\+49 .. .{8}) or (\+49.{10}),", got.text).groups()
    assert one.replace(" ", "") == two
    a, b, c = re.search(r"on (\S+) and (\S+), (\S+)$", got.text).groups()
    day = lambda t: tuple(map(int, re.split("[/.]", t)))
    assert day(a) == day(b) == day(c)
    same = ["call 12+34567890 x", "version 1.2.19900", "+1 2 3", "1/2/90", "32/13/1990"]
    kept = by_id(pii.pseudonymise(frame(spark, same), "k"))
    assert kept.text.tolist()[1:] == same[1:]


def test_number_permutation_is_one(spark):
    F = pii.F
    own = F.struct(F.lit(b"i" * 64).alias("inner"), F.lit(b"o" * 64).alias("outer"))
    df = spark.range(17 * 43).select(pii.permute_number(F.col("id"), F.lit(17).cast("long"), F.lit(43).cast("long"), own).alias("v"))
    assert sorted(r.v for r in df.collect()) == list(range(17 * 43))
    small = spark.range(1000).select(pii.permute_characters(F.lpad(F.col("id").cast("string"), 3, "0"), own, F.lit(False)).alias("v"))
    assert sorted(r.v for r in small.collect()) == [f"{k:03d}" for k in range(1000)]


def plain_pseudonym(kind: str, m: str, key: str) -> str:
    """The pseudonym by plain Python."""
    own = hmac.digest(key.encode(), kind.encode(), "sha256")

    def mac(*parts):
        return hmac.new(own, "|".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()

    def characters(text):
        def shift(c, by):
            for low, high in ([("2", "9"), ("0", "1")] if kind == "phone" else [("0", "9")]) + [("a", "z"), ("A", "Z")]:
                if low <= c <= high:
                    return chr(ord(low) + (ord(c) - ord(low) + by) % (ord(high) - ord(low) + 1))
            return c

        one, two = text[: len(text) // 2], text[len(text) // 2 :]
        for k in range(1, 9):
            seed = mac(k, len(one), ",".join(str(ord(c)) for c in two))
            stream = "".join(hashlib.sha256(f"{seed}|{b}".encode()).hexdigest() for b in range(len(one) // 16 + 1))
            one, two = two, "".join(shift(c, int(stream[4 * i : 4 * i + 4], 16)) for i, c in enumerate(one))
        return one + two

    def number(v, high, low):
        hi, lo = divmod(v, low)
        for k in range(1, 9):
            if k % 2:
                hi = (hi + int(mac(k, lo)[:15], 16)) % high
            else:
                lo = (lo + int(mac(k, hi)[:15], 16)) % low
        return hi * low + lo

    def refill(text):
        left = iter(text)
        return "".join(next(left) if c.isalnum() else c for c in m)

    plain = "".join(c for c in m if c.isalnum())
    if kind == "email":
        local, _, domain = m.partition("@")
        return f"{characters(local)}@{domain}"
    if kind == "secret":
        head = "AKIA" if m.startswith("AKIA") else re.match("[A-Za-z_-]+ ?[=:] ?[\"']?", m).group()
        return head + characters(m[len(head) :])
    if kind == "phone" and (code := re.match(r"\+(351|49|1|7)[ .-]?(?!.*\d{3}[ .-]\d{4}$)", m)):
        return refill(code[1] + characters(plain[len(code[1]) :]))
    if kind == "phone":
        return refill(plain[:-10] + characters(plain[-10:]))
    if kind == "card":
        start = plain[0] + characters(plain[1:-1])
        return refill(next(start + c for c in "0123456789" if luhn(start + c)))
    if kind == "iban":
        account = characters(plain[4:])
        return refill(next(f"{plain[:2]}{c:02d}{account}" for c in range(2, 99) if mod97(f"{account}{plain[:2]}{c:02d}") == 1))
    if kind == "ip":
        v = number(int.from_bytes(bytes(map(int, m.split(".")))), 1 << 16, 1 << 16)
        return ".".join(map(str, v.to_bytes(4)))
    if kind == "national":
        area, group, serial = map(int, m.split("-"))
        v = number(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999)
        area = v // (99 * 9999) + 1
        return f"{area + (area >= 666):03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"
    first = datetime.date(1900, 1, 1)
    sign = "/" if "/" in m else "."
    bare = "-" not in m and {1} <= set(map(len, m.split(sign)))
    orders = ["%Y-%m-%d"] if "-" in m else [f"%d{sign}%m{sign}%Y", f"%m{sign}%d{sign}%Y"]
    for k, order in enumerate(orders):
        try:
            v = (datetime.datetime.strptime(m, order).date() - first).days
        except ValueError:
            continue
        while True:
            v = number(v, 17, 4297)
            day = first + datetime.timedelta(v)
            if not k or day.day > 12:
                return sign.join(p.lstrip("0") for p in day.strftime(order).split(sign)) if bare else day.strftime(order)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def private_values(rng):
    """(kind, value) of every kind and many formats."""

    def some(alphabet, n):
        return "".join(rng.choice(list(alphabet), n))

    digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    while True:
        start = "4" + some(digits, 14)
        card = next(start + c for c in digits if luhn(start + c))
        yield "card", [card, " ".join(card[k : k + 4] for k in (0, 4, 8, 12)), "-".join(card[k : k + 4] for k in (0, 4, 8, 12))][rng.integers(3)]
        country = str(rng.choice(["DE", "GB", "NO", "FR", "MT"]))
        account = some(digits + letters.upper(), pii.IBAN_LENGTHS[country] - 4)
        iban = next(f"{country}{c:02d}{account}" for c in range(2, 99) if mod97(f"{account}{country}{c:02d}") == 1)
        yield "iban", iban if rng.integers(2) else " ".join(iban[k : k + 4] for k in range(0, len(iban), 4))
        yield "phone", [f"+1 ({some(digits, 3)}) {some(digits, 3)}-{some(digits, 4)}", f"{some(digits, 3)}-{some(digits, 3)}-{some(digits, 4)}", f"+49 {some(digits, 3)} {some(digits, 3)} {some(digits, 4)}", f"+49 {some(digits, 2)} {some(digits, 8)}", f"+351{some(digits, 9)}", f"+7.{some(digits, 3)}.{some(digits, 2)}.{some(digits, 2)}.{some(digits, 3)}"][rng.integers(6)]
        yield "national", f"{rng.integers(1, 666):03d}-{rng.integers(1, 100):02d}-{rng.integers(1, 10000):04d}"
        yield "ip", ".".join(map(str, rng.integers(0, 256, 4)))
        day = datetime.date(1900, 1, 1) + datetime.timedelta(int(rng.integers(73_049)))
        yield "date", day.strftime(str(rng.choice(["%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y", "%-d/%-m/%Y", "%-d.%-m.%Y", "%-m/%-d/%Y"])))
        yield "email", f"{some(letters + digits + '._%+-', int(rng.choice([1, 8, 64, 70, 300])))}@{'.'.join(some(letters, 5) for _ in range(rng.choice([1, 2, 14])))}.example"
        yield "secret", [f"password={some(letters + digits, int(rng.choice([8, 17, 520, 600])))}", f'token = "{some(letters + digits + "+/_-", 600)}', "AKIA" + some(digits + letters.upper(), 16), f"api_key: {some(letters, 33)}", f"PASSWORD={some(letters, 9)}", f"Api-Key: {some(digits, 20)}"][rng.integers(6)]


def test_pseudonyms_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    values = list(itertools.islice(private_values(rng), 1200))
    texts, want, kinds = [], [], []
    for k in range(0, len(values), 3):
        parts, new = ["Begin "], ["Begin "]
        for kind, m in values[k : k + 3]:
            parts += [m, "\" said word, "]
            new += [plain_pseudonym(kind, m, "k"), "\" said word, "]
        texts.append("".join(parts))
        want.append("".join(new))
        kinds.append([kind for kind, _ in values[k : k + 3]])
    got = by_id(pii.pseudonymise(frame(spark, texts), "k", found="kinds"))
    assert got.kinds.map(list).tolist() == kinds
    assert got.text.tolist() == want
    assert not any(m in t for (_, m), t in zip(values, np.repeat(got.text, 3), strict=True) if len(m.partition("@")[0]) > 12)


def test_pseudonyms_keep_their_key_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, "born 12/31/1999 or 31/12/1999", 7)], "doc_id long, text string, hits long")
    out = pii.pseudonymise(docs, "the key of the test")
    plan = out._jdf.queryExecution().toString()
    sub = hmac.digest(b"the key of the test", b"date", "sha256")
    assert "the key" not in plan and sub.hex()[:12] not in plan.lower() and bytes(b ^ 0x36 for b in sub[:6]).hex() not in plan.lower()
    (row,) = out.collect()
    assert row.hits == 7 and out.columns == docs.columns
    month_first, day_first = row.text[5:15], row.text[19:29]
    assert int(month_first[3:5]) > 12 and int(day_first[3:5]) <= 12
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


# op7 and op10


def test_bpe_is_exact(spark, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    texts = [*ODD, *("".join(rng.choice(["a", "the", " ", "  ", "\n", "'s", "é", "你", "1", "!", "\x1c", "\0"], 40)) for _ in range(300))]
    got = by_id(bpe.round_trip(frame(spark, texts), path))
    for t, r in zip(texts, got.itertuples(), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.decode_column(bpe.encode_column(frame(spark, texts), path).select("doc_id", "encoded.ids"), path)
    assert by_id(both).decoded.tolist() == [t or "" for t in texts]


def test_halves_of_long_texts_join_exactly(path):
    """On the registered documents, and on hard texts with halves of a few characters."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    exact = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    documents = pd.read_parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").text.tolist()
    codec = bpe.Encoder(path)
    assert codec.encode(documents) == [exact(t) for t in documents]
    assert codec.joins > 0 and codec.joins >= sum(len((t or "").encode()) > bpe.HALF_BYTES for t in documents) > 0
    rng = np.random.default_rng(8)
    signs = ["a", "B", " ", "  ", "\n", "\r\n", "\t", "\0", "é", "你", "\xa0", "\u3000", "\u200b", "'s", "'ll", "don't", "123", "9", "!?", "...", "<|endoftext|>", "😀", "x" * 30, "\x1c", "\x85", "'", "''", "9's", ",'", "a9", "(b", "_x", "~", "`", "^", "'t,", "\x7f"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(1500)]
    small = bpe.Encoder(path, half=7)
    assert small.encode(texts) == [exact(t) for t in texts] and small.joins > 10_000


def test_windows_stay_small_where_nothing_splits_a_text(path):
    rng = np.random.default_rng(13)
    texts = {
        "letters": "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 300_000)),
        "one letter": "a" * 300_000,
        "ideographs": "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 100_000))),
        "ideographs with stops": "".join(chr(x) if k % 17 else "。" for k, x in enumerate(rng.integers(0x4E00, 0x9FA5, 60_000).tolist())),
        "blanks": " " * 200_000,
        "blanks between": "word" + " " * 100_000 + "x " * 9_000,
        "tabs": "\t" * 60_000 + "a" * 40_000 + "\u3000" * 30_000,
        "signs": "=" * 100_000 + "'s" * 20_000 + "'" * 50_000 + "s",
        "specials": "".join(rng.choice(["a'", "'s", "<|endoftext|>", "1", "!", "x", "é"], 80_000)),
        "addresses": "".join(rng.choice(["http://a.b/", "c?d=", "é&"], 60_000)),
    }
    for name, text in texts.items():
        codec = bpe.Encoder(path)
        assert codec.encode([text]) == [np.array(codec.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()], name
        assert codec.widest <= 4096, name


def test_a_vocabulary_that_splits_otherwise_is_refused(path):
    with pytest.raises(ValueError, match="pre-tokeniser"):
        bpe.Encoder(path.replace("byte_bpe_50k", "word_bpe_49k"))


def test_tree_concatenation(path):
    small, library = bpe.Encoder(path, leaf=16), bpe.Encoder(path).library
    rng = np.random.default_rng(6)
    for k in range(20):
        t = "".join(rng.choice(list("abcdethning") if k % 2 else ["the", "ing", "é", "aaa"], 150))
        assert np.frombuffer(small.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_huffman_round_trip():
    rng = np.random.default_rng(7)
    for n, limit in ((1, 18), (2, 18), (40, 6), (3000, 12)):
        counts = (rng.pareto(0.7, n) * 10 + 1).astype(np.int64)
        code = huffman.Code(huffman.code_lengths(counts, limit))
        ids = rng.choice(n, 5000, p=counts / counts.sum())
        raw, marks = code.encode(ids)
        sizes = np.full(len(marks), huffman.STRETCH)
        sizes[-1] = len(ids) - huffman.STRETCH * (len(marks) - 1)
        assert code.limit <= limit and (code.decode(np.frombuffer(raw, np.uint8), marks, sizes) == ids).all()


def test_documents_coded_together_equal_those_coded_apart():
    rng = np.random.default_rng(9)
    code = huffman.Code(huffman.code_lengths((rng.pareto(0.7, 500) * 10 + 1).astype(np.int64)))
    counts = rng.choice([0, 1, 2, 511, 512, 513, 1500], 60)
    ids = rng.integers(0, 500, counts.sum())
    data, n_bytes, marks, n_marks = code.encode_many(ids, counts)
    apart = [code.encode(x) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert [x.tobytes() for x in np.split(data, np.cumsum(n_bytes)[:-1])] == [x for x, _ in apart]
    assert [x.tolist() for x in np.split(marks, np.cumsum(n_marks)[:-1])] == [m.tolist() for _, m in apart]


def test_hot_and_null_ids_fill_several_shards(spark, path, tmp_path):
    texts = [f"{WORDS[k % 19]} {k} " * (5 + k % 7) for k in range(300)]
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(300)]
    rows = [*zip(ids, texts, strict=True), *list(zip(ids, texts, strict=True))[:9]]  # with repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write_corpus(docs, path, str(tmp_path / "c"), 2, 50_257, shard_ids=500, block_ids=300)
    blocks = spark.read.parquet(str(tmp_path / "c/blocks"))
    shares = [r.n for r in blocks.groupBy("shard").agg({"n_tokens": "sum"}).toDF("shard", "n").collect()]
    assert len(shares) > 5 and max(shares) < 4 * np.mean(shares)
    got = token_files.read_checksums(spark, str(tmp_path / "c")).toPandas().sort_values("start").reset_index(drop=True)
    assert len(got) == len(rows) and (got.start == got.n_tokens.cumsum() - got.n_tokens).all()
    key = got.assign(doc_id=got.doc_id.fillna(-1))[["doc_id", "ids_crc32"]].apply(tuple, axis=1).tolist()
    assert key == sorted(key)


def test_token_files(spark, path, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    docs = frame(spark, ODD).select("doc_id", "text").repartition(3)
    token_files.write_corpus(docs, path, str(tmp_path / "c"), 2, 50_257, shard_ids=2000, block_ids=500)
    got = by_id(token_files.read_corpus(spark, str(tmp_path / "c")))
    start = 0
    for t, r in zip(ODD, got.itertuples(), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, np.frombuffer(r.ids, "<u4").tolist()) == (start, ids)
        start += len(ids)
    block = spark.read.parquet(str(tmp_path / "c/blocks")).first().data
    with pytest.raises(ValueError):
        token_files.unpack_block(bytes(block[:-1]) + b"?")
    assert token_files.store_and_check(docs.limit(0), path, 2, 50_257).count() == 0


# op8


def test_decontamination(spark):
    item = " ".join(WORDS[:14])
    texts = [f"prefix {item.upper()} suffix", " ".join(WORDS[:9]), "zz tiny item zz", *ODD[:6]]
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, item)], "item_id long, text string")
    for block in (decontam.BLOCK_BYTES, 30):
        got = by_id(decontam.annotate(docs, bench, block_bytes=block))
        assert [r["n_hit"] for r in got.contamination] == [14, 0, 2, *[0] * 6]
        assert sorted(got.contamination[0]["items"]) == ["1", "4"] and list(got.contamination[2]["items"]) == ["2"]
        m = got.contamination[0]["matches"][0]
        assert (m["at"], m["item_at"], m["words"]) == (1, 0, 14)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 2
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(texts)
    assert decontam.annotate(docs.limit(0), bench).count() == 0


# op9


def test_chat(spark):
    part = lambda kind, **v: {"kind": kind, "text": None, "uri": None, "width": None, "height": None, "seconds": None, "pages": None} | v
    hard = "\\### <turn> </turn>\n <image 0> \\"
    rows = [
        (1, 0, "user", [part("text", text="see "), part("image", uri="i.png", width=28, height=15), part("audio", uri="a", seconds=2.1), part("document", uri="d", pages=3)]),
        (1, 1, "assistant", [part("text", text=hard)]),
        (1, 1, "assistant", [part("text", text=hard)]),
        (2, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    fragments = chat.format_chat(df, turns=2)
    found = {(a.kind, a.tokens) for r in fragments.collect() for a in r.attachments}
    assert found == {("image", 4), ("audio", 53), ("document", 768)}
    got = {r.conv_id: r for r in chat.digests(fragments).collect()}
    want = "user\nsee \n" + f"assistant\n{hard}\n" * 2
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (2 * len(hard), hashlib.sha256((hard * 2).encode()).hexdigest())
    assert got[2].n_turns == 1 and got[2].loss_chars == 0
    assert chat.digests(chat.format_chat(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.Flattener().visit(part("video"))
