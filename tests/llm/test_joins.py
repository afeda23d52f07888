"""Vector codes, n-gram joins and divergence against brute force, and their defined cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import codes, divergence, ngram_join


def test_tree_finds_the_nearest_entry():
    """Nearest by distance, then by index, with ties and equal entries; fewer distances than all on clustered entries."""
    rng = np.random.default_rng(3)
    centre = rng.integers(-3000, 3000, (12, 4))
    for entries in (rng.integers(-3, 4, (256, 4)), rng.integers(-1000, 1000, (200, 4)), np.zeros((90, 4), np.int64), np.repeat(centre, 20, axis=0) + rng.integers(-9, 9, (240, 4)), rng.integers(-(1 << 25), 1 << 25, (70, 4))):
        x = np.concatenate([entries[rng.integers(0, len(entries), 150)] + rng.integers(-4, 5, (150, 4)), rng.integers(-4, 5, (50, 4))])
        at, far, _ = codes.Gnat(entries).nearest(x)
        all_ = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (at == all_.argmin(1)).all() and (far == all_.min(1)).all()
    clustered = np.repeat(centre, 20, axis=0) + rng.integers(-9, 9, (240, 4))
    x = clustered[rng.integers(0, 240, 500)] + rng.integers(-4, 5, (500, 4))
    assert codes.Gnat(clustered).nearest(x)[2] < 0.5 * x.shape[0] * 240


def brute_codes(rows, width):
    q = [[math.floor(1024 * v) for v in x] + [0] * (width - len(x)) for _, x, _ in rows]
    size = width // 4
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    part = lambda i, p: q[i][p * size : (p + 1) * size]
    books = [[part(i, p) for i in order[:256]] for p in range(4)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda e: (gap(v, books[p][e]), e))
    for _ in range(4):
        at = [[nearest(p, part(i, p)) for p in range(4)] for i in range(len(rows))]
        for p in range(4):
            for e in range(len(books[p])):
                own = [part(i, p) for i in range(len(rows)) if at[i][p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    at = [[nearest(p, part(i, p)) for p in range(4)] for i in range(len(rows))]
    error = [sum(gap(part(i, p), books[p][at[i][p]]) for p in range(4)) for i in range(len(rows))]
    label = Counter()
    for r, e in zip(rows, error):
        label[r[2]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{c:02x}" for c in a), e, label[r[2]], sha) for r, a, e in zip(rows, at, error))


def test_codes_by_brute_force(spark):
    """Repeated and null ids, null labels, short vectors, rows that take no part and other columns."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-0.1, 0.1) for _ in range(7)], rng.choice([None, 0, 1])) for i in range(290)]
    rows += [(3, [0.5] * 7, None), (None, [0.25] * 7, 1), (9, [0.125] * 3, 0), (4, rows[4][1], 1)]
    bad = [(500, None, 1), (501, [0.1, None], 1), (502, [float("nan")] * 7, 0), (503, [float("inf")] * 7, 0)]
    df = spark.createDataFrame([(*r, "own", 1.0) for r in rows + bad], "vec_id long, embedding array<double>, label int, code string, x double").repartition(4)
    got = Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.compressed(df).collect())
    assert got == brute_codes(rows, 8)
    assert codes.compressed(df.where("false")).count() == 0 and codes.compressed(df.where("vec_id = 500")).count() == 0
    with pytest.raises(ValueError, match="beyond"):
        codes.compressed(spark.createDataFrame([(1, [1e9], 1)], "vec_id long, embedding array<double>, label int"))


def test_codes_decode(spark):
    """What a code stands for differs from the vector by the stated error."""
    rng = random.Random(6)
    df = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<double>")
    rows = codes.usable(df)
    books = codes.train(rows, entries=16)
    for r in codes.decode(codes.encode(rows, books), books).join(rows, "vec_id").collect():
        assert sum((math.floor(1024 * v) - round(1024 * w)) ** 2 for v, w in zip(r["x"], r["approximation"])) == r["error"]


def shingle_set(text, n=5):
    w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set()


def brute_join(rows):
    """(doc_id, n, smallest id reachable) of every row, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            group = [group[i] if g == group[j] else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return Counter((rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows)))


def join_corpus(seed):
    """Near copies at all similarities, chains, passages that many documents share, short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = []
    for _ in range(25):
        w = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        if rng.random() < 0.5:
            w = w[:25] + passage + w[25:50]
        texts.append(w)
    for w in list(texts):
        for _ in range(rng.randint(0, 6)):
            w = list(w)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(w)
    texts += [[*passage[:k], *passage[k + 1 :]] for k in range(0, 40, 3)] + [["One"], ["one"], ["a", "b", "c", "d"], ["a", "b", "c", "D"]] * 2
    rows = [(rng.randrange(1000), " ".join(w)) for w in texts] + [(1, None), (2, ""), (2, " \t"), (None, "no id"), (None, " ".join(texts[0]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, small, part, table, longest", [(1, 16, 512, 1 << 19, 8), (2, 2, 3, 1 << 19, 8), (3, 0, 4, 60, 8), (4, 2, 2, 0, 1), (5, 16, 512, 200, 3)])
def test_join_by_brute_force(spark, monkeypatch, seed, small, part, table, longest):
    """Whatever the sizes of buckets and parts, of the table of frequent shingles and of l, links are those of all pairs."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "PART", part)
    rows = join_corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sid string").repartition(4)
    assert Counter(map(tuple, ngram_join.joined(df, longest=longest, most=table).collect())) == brute_join(rows)


def test_join_edges(spark, edge_docs, no_docs):
    got = Counter(map(tuple, ngram_join.joined(edge_docs).collect()))
    assert got == brute_join([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert ngram_join.joined(no_docs).count() == 0


def test_prefixes_share_what_they_must():
    """Any two sets with the similarity share as many prefix shingles as the lesser l, whatever the frequencies."""
    rng = np.random.default_rng(8)
    table = ngram_join.Frequent(np.arange(0, 400, 3).astype(np.uint64), rng.integers(4, 500, 134), 0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = rng.choice(400, n, replace=False).astype(np.uint64)
        y = np.unique(np.concatenate([x[int(rng.integers(0, n // 8 + 1)) :], rng.choice(400, int(rng.integers(0, n // 8 + 1)), replace=False).astype(np.uint64)]))
        x = np.sort(x)
        if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
            continue
        first = np.array([0, len(x), len(x) + len(y)])
        sets, df = ngram_join.ordered(np.concatenate([x, y]), first, table)
        l, size = ngram_join.lengths(df, first)
        shared = np.intersect1d(sets[: size[0]], sets[first[1] : first[1] + size[1]])
        assert len(shared) >= l.min() >= 1


def test_frequencies_are_counted(spark):
    """Shingles that four documents or more hold are in the table with their number of documents."""
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 12)) + " " + "the same five words end") for i in range(30)]
    table = ngram_join.frequent(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    sets, _ = ngram_join.shingle_sets([t.encode() for _, t in rows])
    value, n = np.unique(sets, return_counts=True)
    assert (table.of(value) == np.where(n >= 4, n, 0)).all() and n.max() == 30


def brute_divergence(rows, min_df=10, top=10):
    tokens = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(g or "", s or "", Counter(tokens(t))) for g, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for g, _, c in docs if g == lang for t in c)
        kept = sorted(t for t in df if df[t] >= min_df)
        count = {None: Counter()} | {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, c in docs:
            if g == lang:
                for t in kept:
                    count[s][t] += c[t]
                    count[None][t] += c[t]
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            if s is None:
                continue
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in count if o not in (None, s)]
            terms = [("term", t, f(p[s][t], p[None][t])) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for found, most in ((pairs, None), (terms, top)):
                for k, (part, item, value) in enumerate(sorted(found, key=lambda x: (-x[2], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return Counter(out)


def divergence_rows(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "Lo", "mï", "tu-", "re9") for b in ("na", "VE", "pó", "é", "")]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "é", None]), " ".join(rng.choices(words, range(1, 26), k=rng.randint(0, 40)))) for _ in range(120)]
    return rows + [("en", "lonely", None), ("en", "lonely2", "123 ..."), ("xx", "a", "few words"), ("xx", "b", ""), ("one", "only", "x")]


@pytest.mark.parametrize("block", [512, 2])
def test_divergence_by_brute_force(spark, block):
    """Null lang, source and text, a group and a lang without terms, and more sources than a block."""
    rows = divergence_rows(block)
    df = spark.createDataFrame([(i, t, g, s, 1) for i, (g, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long").repartition(4)
    assert Counter(map(tuple, divergence.audit(df, block=block).collect())) == brute_divergence(rows)


def test_divergence_edges(edge_docs, no_docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in edge_docs.collect()]
    assert Counter(map(tuple, divergence.audit(edge_docs, min_df=1).collect())) == brute_divergence(rows, 1)
    assert divergence.audit(no_docs).count() == 0


def test_vectors_are_those_of_a_count_vectorizer(spark, monkeypatch):
    """Kept terms and counts equal Spark's own class with minDF and the largest vocabSize, lang by lang; terms whose hashes collide are told apart."""
    from pyspark.ml.feature import CountVectorizer

    rows = divergence_rows(9)
    df = spark.createDataFrame([(i, t, g, s) for i, (g, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    mine = {r["doc_id"]: r["vector"] for r in divergence.document_vectors(df).collect()}
    for lang in ("en", "de", ""):
        lower = F.translate(F.coalesce("text", F.lit("")), divergence.UPPER, divergence.LOWER)
        own = df.where(F.coalesce("lang", F.lit("")) == lang).withColumn("terms", F.array_remove(F.split(lower, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), ""))
        model = CountVectorizer(inputCol="terms", outputCol="v", minDF=10.0, vocabSize=2**31 - 1).fit(own)
        for r in model.transform(own).collect():
            want = {model.vocabulary[i]: int(v) for i, v in zip(r["v"].indices, r["v"].values)}
            assert {t: n for t, n in mine[r["doc_id"]].items() if t in model.vocabulary} == want
    texts = [(t or "").encode() for _, _, t in rows]
    own, _ = divergence.Vectors(texts), monkeypatch.setattr(divergence, "_BASE", np.uint64(0))
    clash = divergence.Vectors(texts)
    entries = lambda v: {(i, v.terms[k].as_py(), n) for i, k, n in zip(v.text.tolist(), v.term.tolist(), v.count.tolist())}
    assert entries(clash) == entries(own)
