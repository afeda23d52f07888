"""Toxicity, quality and the language model."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import language_model as L
from tabforge.llm import quality, toxicity
from tabforge.llm.common import Words, fold, labelled_sample

WORDS = "the of and river stone light window garden table paper music winter letter bridge forest".split()
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def labelled(spark, n=240):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        bad, poor = i % 4 == 0, i % 3 == 0
        w = [rng.choice(WORDS) for _ in range(rng.randint(5, 120))]
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "idiotic"]))
        if poor:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not poor), int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


@pytest.mark.parametrize("module, train, column", [(toxicity, "train_toxicity", "toxic"), (quality, "train_quality", "quality")])
def test_learns_and_scores_edges(spark, edge_docs, no_docs, module, train, column):
    docs, labels = labelled(spark)
    rows = module.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[column] for r in rows]) > 0.9
    model = getattr(module, train)(docs, labels)
    score = module.score_toxicity if module is toxicity else module.score_quality
    got = score(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add(round(r["score"], 5))
    assert len(by_id[5]) == 1 and by_id[4] == by_id[5] and by_id[1] == by_id[2]
    assert module is quality or by_id[1] == by_id[7]  # white space has byte runs, but no words
    assert score(no_docs, model).count() == 0


def test_one_class_or_no_labels(spark, edge_docs):
    labels = spark.createDataFrame([(4, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(edge_docs, quality.train_quality(edge_docs, labels)).collect()} and quality.fit([]).bias == 0
    none = labels.where("false")
    assert {round(r["score"], 6) for r in toxicity.score_toxicity(edge_docs, toxicity.train_toxicity(edge_docs, none)).collect()} == {0.5}


def test_keep_quality_keeps_columns(spark, edge_docs):
    model = quality.QualityModel(np.zeros(1 << quality.BITS), 1.0)
    kept = quality.keep_quality(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark)
    assert len(labelled_sample(docs, labels, "toxic", F.lit(True), 10, 10_000_000)) == 20
    assert sum(len(t) for t, _ in labelled_sample(docs, labels, "toxic", F.lit(True), 100, 2000)) <= 2000


@pytest.mark.parametrize("label", [0, 1])
def test_sample_skips_only_what_does_not_fit(spark, label):
    """A text over the budget, repeated rows of an id and a class of long texts leave room for the others."""
    rows = [(i, f"text {i} " + "w" * 50) for i in range(40)] + [(100 + i, "long " * 1000) for i in range(20)] + [(200, "copy " * 10)] * 300
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100 + i, label) for i in range(20)] + [(200, 1)], "doc_id long, toxic int")
    got = labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", F.lit(True), 100, 4500)
    assert len(got) == 41 and sum(y for _, y in got) == 21
    got = labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", F.lit(True), 100, 12000)
    assert len(got) > 41 and sum(len(t) for t, _ in got) <= 12000


def test_words_match_split():
    texts = [b"", b" a  B\tc\n", b"x", b"\x0b\x0c", "é ü ñ—x".encode()]
    w = Words(texts)
    for i, t in enumerate(texts):
        assert [w.word(k) for k in range(w.first[i], w.first[i + 1])] == t.translate(LOW).split()
    assert Words([b"same"]).hash[0] == Words([b"other same"]).hash[1]


def test_toxicity_gradient():
    rng, h = np.random.default_rng(0), toxicity.HIDDEN
    u = lambda *s: rng.uniform(-0.5, 0.5, s).astype(np.float32)
    block = toxicity._BLOCK
    p = {"Wf": u(12, 3 * h), "Wb": u(12, 3 * h), "bf": u(3 * h), "bb": u(3 * h), "Uzr": u(2 * h, 4 * h) * block[:, :, None, :].transpose(0, 2, 1, 3).repeat(2, 1).reshape(2 * h, 4 * h), "Uc": u(2 * h, 2 * h) * block.reshape(2 * h, 2 * h), "A": u(2 * h, 8), "v": u(8), "w": u(2 * h), "b": np.float32(0.1)}
    x, ids, size = u(20, 12), rng.integers(0, 20, (5, toxicity.WINDOW)), np.array([32, 32, 7, 1, 20])
    mask, y = (np.arange(toxicity.WINDOW) < size[:, None]).astype(np.float32), np.array([1, 0, 1, 0, 1], np.float32)

    def loss(x):
        xf, xb = toxicity._gates(x, p)
        z = toxicity._forward(xf, xb, ids, mask, p)[-1].astype(float)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    dx = toxicity._gradients(p, x, ids, mask, y)[1]
    for at in ((3, 2), (7, 5), (0, 0)):
        a, b = x.copy(), x.copy()
        a[at] += 1e-2
        b[at] -= 1e-2
        assert abs((loss(a) - loss(b)) / 2e-2 - dx[at]) < 2e-4


def naive_toxicity(model, text):
    """Largest window logit of one text, step by step, direction by direction."""
    p, h = {k: np.asarray(v, float) for k, v in model.p.items()}, toxicity.HIDDEN
    w, sigmoid = Words([text], marks=False), lambda v: 1 / (1 + np.exp(-v))
    vectors = []
    for k in range(len(w)):
        raw = b"\x01" + w.word(k) + b"\x02"
        runs = [int.from_bytes(raw[i : i + 4], "little") * 0x9E3779B1 % (1 << 32) >> (32 - toxicity.GRAM_BITS) for i in range(len(raw) - 3)]
        known = np.flatnonzero(model.vocabulary == w.hash[k])
        vectors.append(p["E"][known[0] if len(known) else -1] + (p["C"][runs].mean(0) if runs else 0))
    best = -np.inf
    starts = [*range(0, max(1, len(vectors) - toxicity.WINDOW), toxicity.STRIDE), max(0, len(vectors) - toxicity.WINDOW)]
    for a in starts if vectors else []:
        own, states = vectors[a : a + toxicity.WINDOW], {}
        for d, (wx, bx) in enumerate((("Wf", "bf"), ("Wb", "bb"))):
            s, at = np.zeros(h), range(len(own)) if d == 0 else range(len(own) - 1, -1, -1)
            cols = slice(d * h, (d + 1) * h)
            uz, ur, uc = p["Uzr"][cols, : 2 * h][:, cols], p["Uzr"][cols, 2 * h :][:, cols], p["Uc"][cols, cols]
            for t in at:
                x = own[t] @ p[wx] + p[bx]
                z, r = sigmoid(x[:h] + s @ uz), sigmoid(x[h : 2 * h] + s @ ur)
                s = s + z * (np.tanh(x[2 * h :] + (r * s) @ uc) - s)
                states.setdefault(t, [None, None])[d] = s
        both = np.array([np.concatenate(states[t]) for t in range(len(own))])
        e = np.exp(np.tanh(both @ p["A"]) @ p["v"])
        best = max(best, float((e / e.sum()) @ both @ p["w"] + p["b"]))
    return best if vectors else float(p["b"])


def test_toxicity_scores_by_brute_force(spark):
    docs, labels = labelled(spark, 120)
    model = toxicity.train_toxicity(docs, labels)
    texts = [r["text"].encode() for r in docs.orderBy("doc_id").limit(25).collect()] + [b"", b"one", b"a b", "ünï wörds ".encode() * 40, b"scumbag " * 33]
    want = [1 / (1 + math.exp(-(model.scale * naive_toxicity(model, t) + model.shift))) for t in texts]
    assert toxicity.score_texts(model, texts) == pytest.approx(want, abs=1e-4)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert [got[i] for i in range(25)] == pytest.approx(want[:25], abs=1e-4)


@pytest.mark.parametrize("at", range(0, 70, 3))
def test_a_passage_lies_whole_in_a_window(at):
    """Wherever a passage of STRIDE + 1 words stands, some window holds all of it."""
    for n in (87, 100):
        start, size, _ = toxicity._window_starts(np.array([0, n]))
        assert any(s <= at and at + toxicity.STRIDE + 1 <= s + k for s, k in zip(start, size))


def test_quality_scores_by_brute_force(spark):
    """Features listed one by one: words, pairs (a word said twice is one feature), runs of three bytes with the space that ends the text."""
    docs, labels = labelled(spark, 120)
    model = quality.train_quality(docs, labels)
    down, full = 64 - quality.BITS, (1 << 64) - 1

    def naive(text):
        w = [int(x) for x in Words([text], lower=False).hash]
        buckets = [x * 0xD6E8FEB86659FD93 % (1 << 64) >> down for x in w]
        buckets += [0 if a == b else (a * 0xA0761D6478BD642F & full ^ b) * 0xE7037ED1A0B428DB % (1 << 64) >> down for a, b in zip(w, w[1:])]
        raw = text + b" "
        buckets += [int.from_bytes(raw[i : i + 3], "little") * 0x9E3779B1 % (1 << 32) >> (32 - quality.BITS) for i in range(len(raw) - 2)]
        return 1 / (1 + math.exp(-(sum(model.share[b] for b in buckets) / max(1, len(buckets)) + model.bias)))

    texts = [r["text"].encode() for r in docs.orderBy("doc_id").limit(25).collect()] + [b"", b"x", b"same same same", "ünï".encode()]
    assert quality.score_texts(model, texts) == pytest.approx([naive(t) for t in texts], abs=1e-9)


def test_every_window_is_scored():
    start, size, text = toxicity._window_starts(np.array([0, 100, 100, 103]))
    seen = np.zeros(103, bool)
    for s, n in zip(start, size):
        seen[s : s + n] = True
    assert seen.all() and set(text) == {0, 2} and start[text == 0].max() == 68


def test_language_model_base_and_edges(spark, edge_docs, no_docs):
    docs, _ = labelled(spark, 60)
    both = docs.unionByName(edge_docs.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1000))
    rows, got = both.collect(), L.scored_documents(both).collect()
    assert len(rows) == len(got)
    tokens = [(r["doc_id"], (r["text"] or "").encode().translate(LOW).split() + [None]) for r in rows]
    c = collections.Counter(t for i, ts in tokens if zlib.crc32(str(i).encode()) % 5 != 1 for t in ts)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, len(ts), sum(c[t] > 0 for t in ts), round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 4)) for i, ts in tokens)
    assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got)
    assert all(r["train_tokens"] == n and math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert L.scored_documents(no_docs).count() == 0
    assert L.scored_documents(edge_docs).count() == edge_docs.count()


def test_language_model_is_a_probability():
    """Over all tokens the model's next-token probabilities add up to one, and rare words share the open entry."""
    common = [(b"w%d" % i, 50 - i) for i in range(40)] + [(L.END, 9)]
    common.sort(key=lambda x: (-x[1], x[0]))
    lex = L.Lexicon(common, 5000, 300)
    p = L.first_parameters(lex)
    rng = np.random.default_rng(1)
    p["Wc"], p["Ww"] = rng.normal(size=p["Wc"].shape).astype(np.float32), rng.normal(size=p["Ww"].shape).astype(np.float32)
    state = rng.normal(size=(1, L.HIDDEN)).astype(np.float32)
    logs = L._output(np.repeat(state, L.VOCABULARY, 0), np.arange(L.VOCABULARY), p)[0]
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-4


def test_language_model_output_takes_all_classes_at_once(monkeypatch):
    """Log-probabilities of a plain softmax in a softmax, classes without targets included, from two calls whatever the classes."""
    rng, h, c = np.random.default_rng(8), L.HIDDEN, L.CLASSES
    p = {"Wc": (h, c), "bc": (c,), "Ww": (c, h, c), "bw": (c, c)}
    p = {k: rng.normal(size=x).astype(np.float32) for k, x in p.items()}
    states, target = np.tanh(rng.normal(size=(50, h))).astype(np.float32), rng.integers(0, 9 * c, 50)
    calls, softmax = [], L._softmax
    monkeypatch.setattr(L, "_softmax", lambda *a: calls.append(1) or softmax(*a))
    got, _ = L._output(states, target, p)
    log = lambda x, k: x[k] - np.log(np.exp(x).sum())
    want = [log(s @ p["Wc"] + p["bc"], t // c) + log(s @ p["Ww"][t // c] + p["bw"][t // c], t % c) for s, t in zip(states.astype(float), target)]
    assert np.allclose(got, want, atol=1e-4) and len(calls) == 2


def test_language_model_gradient_and_lanes():
    common = sorted([(b"w%d" % i, 60 - i) for i in range(30)] + [(L.END, 9)], key=lambda x: (-x[1], x[0]))
    lex = L.Lexicon(common, 3000, 100)
    p = L.first_parameters(lex)
    rng = np.random.default_rng(2)
    p["Wc"] += rng.normal(size=p["Wc"].shape).astype(np.float32) * 0.3
    tokens, first = rng.integers(0, 31, 50).astype(np.int32), np.array([0, 7, 8, 30, 50])
    lanes = L.Lanes(tokens, first, lex.end, 2)
    assert sorted(lanes.tokens.tolist()) == sorted(tokens.tolist()) and lanes.load.sum() == 50
    window = next(lanes.windows(20))
    g = L._window_gradient(lanes, window, np.zeros((2, L.HIDDEN), np.float32), p)

    def loss():
        s = L._steps(lanes, window, np.zeros((2, L.HIDDEN), np.float32), p)
        return -L._output(s, lanes.tokens[np.concatenate(window)], p)[0].astype(float).sum()

    for name, at in (("Uc", (1, 2)), ("Uzr", (3, 20)), ("Wc", (2, 0))):
        p[name][at] += 1e-2
        a = loss()
        p[name][at] -= 2e-2
        b = loss()
        p[name][at] += 1e-2
        assert abs((a - b) / 2e-2 - g[name][at]) < 2e-2 * max(1, abs(g[name][at]))


def test_state_is_carried_over_windows():
    """A text's score does not depend on which texts stand beside it."""
    common = sorted([(b"w%d" % i, 60 - i) for i in range(30)] + [(L.END, 9)], key=lambda x: (-x[1], x[0]))
    lex, rng = L.Lexicon(common, 3000, 100), np.random.default_rng(2)
    p = L.first_parameters(lex)
    p["Wc"] = rng.normal(size=p["Wc"].shape).astype(np.float32)
    one, more = rng.integers(0, 31, 200).astype(np.int32), rng.integers(0, 31, 90).astype(np.int32)
    alone = L.text_scores(one, np.array([0, 200]), lex.end, p)[0]
    both = L.text_scores(np.concatenate([more, one]), np.array([0, 20, 90, 290]), lex.end, p)[2]
    assert abs(alone - both) < 1e-2


def test_language_model_trains_whole_texts_with_a_large_vocabulary(monkeypatch):
    """Training lays a long text in one lane, without a restart, and has 4096 entries or more."""
    assert L.VOCABULARY >= 4096
    seen = []

    class Lanes(L.Lanes):
        def __init__(self, tokens, first, *a, **b):
            super().__init__(tokens, first, *a, **b)
            seen.append((np.diff(self.first).tolist(), int((self.goes_on == 0).sum())))

    monkeypatch.setattr(L, "Lanes", Lanes)
    lex = L.Lexicon([(b"on", 4000), (b"and", 2000), (L.END, 2)], 6002, 3)
    p, n = L.fitted([np.array([1, 2] * 3000 + [3], np.uint16), np.array([0, 3], np.uint16)], L.first_parameters(lex), lex.end)
    assert n == 6003 and [sorted(x) for x, _ in seen] == [[2, 6001]] and seen[0][1] == 2


def naive_score(numbers, end, p):
    """Natural logarithm of a text's probability, token by token."""
    h, k = L.HIDDEN, L.CLASSES
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    q = {name: x.astype(float) for name, x in p.items()}
    state, before, out = np.zeros(h), end, 0.0
    for i, x in enumerate(numbers):
        state = state if i else np.zeros(h)
        zr = q["G"][before, : 2 * h] + state @ q["Uzr"]
        z, r = sigmoid(zr[:h]), sigmoid(zr[h:])
        state = state + z * (np.tanh(q["G"][before, 2 * h :] + (r * state) @ q["Uc"]) - state)
        for logits, at in ((state @ q["Wc"] + q["bc"], x // k), (state @ q["Ww"][x // k] + q["bw"][x // k], x % k)):
            out += logits[at] - np.log(np.exp(logits).sum())
        before = x
    return out


def test_language_model_score_is_that_of_a_naive_loop_and_of_no_partitioning(spark, monkeypatch):
    """Some rounds of shards; the scores agree for 1, 4 and 16 partitions, and with a token-by-token loop over whole texts."""
    monkeypatch.setattr(L, "SHARD_TOKENS", 1000)
    docs, _ = labelled(spark, 120)
    rows = docs.select("doc_id", "text")
    kept = []
    monkeypatch.setattr(L, "train", lambda *a, f=L.train, **b: kept.append((a[1], f(*a, **b))) or kept[-1][1])
    got = [{r["doc_id"]: r["score"] for r in L.scored_documents(rows.repartition(n)).collect()} for n in (1, 4, 16)]
    assert len(got[0]) == 120 and all(abs(x[i] - got[0][i]) < 1e-4 * abs(got[0][i]) for x in got[1:] for i in got[0])
    assert all((kept[0][1][k] == x[1][k]).all() for x in kept[1:] for k in x[1]) and not np.allclose(kept[0][1]["Ww"], 0)
    lex, p = kept[0]
    number = {int(x): int(n) for x, n in zip(lex.hash, lex.number)}
    c = collections.Counter(t for i, t in ((r["doc_id"], t) for r in rows.collect() for t in [*r["text"].encode().lower().split(), L.END]) if zlib.crc32(str(i).encode()) % 5 != 1)
    for r in rows.orderBy("doc_id").limit(12).collect():
        words = [*r["text"].encode().lower().split(), L.END]
        numbers = [number.get(int(x), 0) for x in L._hashes(words)]
        share = sum(math.log10(c[w] + 0.5) - math.log10(lex.outside) for w, x in zip(words, numbers) if not x)
        assert abs(naive_score(numbers, lex.end, p) / math.log(10) + share - got[0][r["doc_id"]]) < 1e-3 * len(words)


def test_language_model_window_is_a_loop_over_tokens_on_whole_rows(monkeypatch):
    """Every parameter's gradient is that of a token-by-token loop; lanes are columns, and only logits that may be too large are bounded."""
    common = sorted([(b"w%d" % i, 200 - i) for i in range(90)] + [(L.END, 9)], key=lambda x: (-x[1], x[0]))
    lex, rng = L.Lexicon(common, 20000, 100), np.random.default_rng(4)
    p = {k: x + rng.normal(size=x.shape).astype(np.float32) * 0.2 for k, x in L.first_parameters(lex).items()}
    texts = [rng.integers(0, 91, n).astype(np.int32) for n in (7, 1, 22, 20)]
    lanes = L.Lanes(np.concatenate(texts), np.array([0, 7, 8, 30, 50]), lex.end, 2)
    window, state = next(lanes.windows(50)), lambda: np.zeros((2, L.HIDDEN), np.float32)
    kept, bounded, minimum = [], [], np.minimum
    states = L._steps(lanes, window, state(), p, kept)
    assert [x.shape for x in kept[0]] == [(L.HIDDEN, 2)] * len(kept[0]) and len(set(map(len, window))) == 2
    monkeypatch.setattr(np, "minimum", lambda *a, **b: bounded.append(1) or minimum(*a, **b))
    g = L._window_gradient(lanes, window, state(), p)
    assert not bounded
    large = p | {"Wc": p["Wc"] * 1000}
    assert np.isfinite(L._output(states, lanes.tokens[np.concatenate(window)], large)[0]).all() and bounded
    full = np.zeros_like(p["G"])
    full[g["G"][0]] = g["G"][1]
    q, loss = {k: x.astype(float) for k, x in p.items()}, lambda: -sum(naive_score(x, lex.end, q) for x in texts)
    for name, grad in (g | {"G": full}).items():
        assert grad.shape == p[name].shape
        for at in [np.unravel_index(np.argsort(-np.abs(grad), axis=None)[i], grad.shape) for i in (0, 3, 40)]:
            ends = []
            for step in (1e-4, -2e-4):
                q[name][at] += step
                ends.append(loss())
            q[name][at] += 1e-4
            assert abs((ends[0] - ends[1]) / 2e-4 - grad[at]) < 1e-3 * max(1, abs(grad[at])), name


def test_language_model_sums_do_not_depend_on_order():
    p = {"a": np.random.default_rng(1).normal(size=500).astype(np.float32)}
    parts = [L._shares({"a": p["a"] * k}, n) for k, n in ((1, 5), (3, 2_000_000), (-2, 77_000))]
    batch = lambda w, x: L.pa.RecordBatch.from_arrays([L.pa.array([w]), L.pa.array([x.tobytes()])], ["w", "p"])
    one, two = (next(L._summed(batch(*x) for x in order)) for order in (parts, parts[::-1]))
    assert one.equals(two) and next(L._summed(iter(())), None) is None
