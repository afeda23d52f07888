"""Top-k, SimHash, winnowing and repeated passages against brute force."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabforge.llm import common, repeats, similar, simhash, topk, winnowing

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def test_top_k(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 1.0]) for _ in range(4)], "x") for i in range(130)]
    rows += [(200, None, "x"), (250, [0.1, None, 0.2, 0.3], "x"), (300, [float("nan"), 0.0, 0.0, 0.0], "x"), (350, [float("inf"), 0.0, 0.0, 0.0], "x"), (None, [1.0] * 4, "x"), (None, [1.0] * 4, "x"), (400, [1.0], "x"), (450, [], "x"), (rows[3][0], rows[3][1], "x"), (100, [1.0, 0.5, 0.25, 0.25], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    ok = [(i, np.array([math.floor(256 * np.float32(x).astype(float)) for x in v] + [0] * (4 - len(v)))) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def brute(ok, k=5, is_query=lambda i: i is not None and i % 50 == 0):
        want = Counter()
        for n, (q, v) in enumerate(ok):
            if is_query(q):
                best = sorted((-int(v @ x), i is None, i or 0) for m, (i, x) in enumerate(ok) if m != n)[:k]
                want.update((q, r, None if none else i, -s) for r, (s, none, i) in enumerate(best, 1))
        return want

    counted = lambda df: Counter(map(tuple, df.collect()))
    want = brute(ok)
    assert counted(topk.fiftieth(df)) == want
    assert topk.fiftieth(df.where("false")).count() == 0
    assert counted(topk.fiftieth(df.where("vec_id in (0, 1, 2)"))) == brute([x for x in ok if x[0] in (0, 1, 2)])
    monkeypatch.setattr(topk, "CHUNK_BYTES", 64 * 8)  # many chunks
    assert counted(topk.top_k(df, F.lit(True), 2)) == brute(ok, 2, lambda i: True)


def brute_print(t):
    w = (t or "").encode().translate(LOW).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    link = {i: i for i in prints}

    def top(x):
        while link[x] != x:
            x = link[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                link[y] = x
    return {i: top(i) for i in ids}


def near_texts(n=60, seed=5):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(200)) for _ in range(6)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        out.append((i, " ".join(w)))
    return out


def test_simhash_components(spark, edge_docs, no_docs):
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, roots = {i: brute_print(t) for i, t in rows}, None
    roots = brute_components(want)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.components_query(df).collect()}
    assert got == {i: (want[i], roots[i]) for i in want}
    edges = simhash.components_query(edge_docs).collect()
    assert len(edges) == edge_docs.count() and {r["component_id"] for r in edges if r["doc_id"] in (1, 2, 7)} == {1}
    assert simhash.components_query(no_docs).count() == 0


def test_simhash_split_shards(spark, monkeypatch):
    """Groups cut into many parts give the same components."""
    monkeypatch.setattr(simhash, "SHARD", 4)
    rng = random.Random(9)
    prints = {i: (rng.choice([0, 0xFFFF0000FFFF0000]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3)))) for i in range(80)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in set(prints.values())]
    links = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    mine = {v: v for v in prints.values()}

    def top(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for r in links:
        a, b = top(r["u"] % (1 << 64)), top(r["v"] % (1 << 64))
        mine[a] = b
    roots = brute_components(prints)
    groups = lambda f: {frozenset(i for i in prints if f(i) == f(j)) for j in prints}
    assert groups(lambda i: top(prints[i])) == groups(lambda i: roots[i])


def similar_texts():
    """Families of near copies at 0.6 to 0.97, exact copies, chains and texts that stand alone."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 400))]
        for edits in (0, 0, 1, rng.randint(1, 4), rng.randint(2, 8)):
            w = list(base)
            for _ in range(max(1, edits * len(base) // 200) if edits else 0):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stage_finds_similar_texts(spark, edge_docs, no_docs, monkeypatch):
    """The pipeline's stage equals brute force at a similarity of 0.8 over five-word shingles, also where buckets are cut in parts."""
    import corpus_pipeline

    rows = similar_texts()
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in sets for j in range(i)]
    assert sum(0.8 <= s < 0.95 for *_, s in pairs) > 20 and sum(0.5 < s < 0.8 for *_, s in pairs) > 20
    linked = [(i, j) for i, j, s in pairs if s >= 0.8]
    while any(group[i] != group[j] for i, j in linked):
        for i, j in linked:
            group[i] = group[j] = min(group[i], group[j])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for part in (similar.PART, 2):
        monkeypatch.setattr(similar, "PART", part)
        kept = corpus_pipeline.near_duplicate_stage(spark, df, "").collect()
        assert sorted(r["doc_id"] for r in kept) == sorted(set(group.values()))
    kept = similar.keep_one(edge_docs).collect()
    assert similar.keep_one(edge_docs).columns == edge_docs.columns and sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 3, 4, 8, 9]
    assert similar.keep_one(no_docs).count() == 0


def test_pipeline_candidates_come_from_simhash(spark, monkeypatch):
    """Votes are a plain loop's, sets at 0.8 share a table's key, only fingerprints within the radius are confirmed, and crowds ask one pair a member at once."""
    rng = np.random.default_rng(4)
    flat = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    bits = lambda x, w: (((y := int(x) * int(similar._ODD[w]) % (1 << 64)) ^ (y >> 32)) >> np.arange(64, dtype=object)) & 1
    votes = similar._votes(flat)
    for w in (0, 7, similar.WORDS - 1):
        assert votes[w].tolist() == [2 * int(n) - 60 for n in sum(bits(x, w) for x in flat)]
    assert similar._simhash(votes)[0] % (1 << 64) == sum(1 << k for k in range(64) if votes[0][k] > 0)
    for nodes, least in ((1000, 0.98), (similar.WIDE + 1, 0.97)):
        words, met, n = similar.tables(nodes), 0, 200
        for _ in range(n):
            x = rng.integers(0, 1 << 64, 110, dtype=np.uint64)
            a, b = (np.frombuffer(similar._clearest(similar._votes(y)), np.uint8) for y in (x[:99], x[11:]))  # similarity 0.8
            met += bool((a[words] == b[words]).all(1).any())
        assert met >= least * n
    asked, confirmed = [], similar._confirmed
    monkeypatch.setattr(similar, "_confirmed", lambda pairs, *a: asked.append({tuple(r) for r in pairs.collect()}) or confirmed(pairs, *a))
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(40)] + [(100 + i, " ".join(f"{i}v{k}" for k in range(50))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert similar.keep_one(df).count() == 31
    fp = {r["sid"]: (r["f0"], r["f1"]) for r in similar.prints(df).collect()}
    assert asked and all(sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(fp[u], fp[v])) <= similar.RADIUS for pairs in asked for u, v in pairs)
    asked.clear()
    monkeypatch.setattr(similar, "PART", 1)  # every bucket of two members counts as crowded
    assert similar.keep_one(df).count() == 31 and asked and all(len(pairs) <= len(rows) for pairs in asked)


def test_pairs_that_simhash_misses_are_found(spark, monkeypatch):
    """With one table for 64 SimHash misses most pairs at 0.8; the stage still has brute force's groups."""
    import corpus_pipeline

    rng = random.Random(5)
    rows, want = [], []
    for i in range(60):
        w = [f"{i}w{k}" for k in range(103)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:92], *(f"{i}x{k}" for k in range(11))]))]  # 88 shared of 110 shingles
        want.append(2 * i)
    rows += [(500 + i, " ".join([*(f"{i}w{k}" for k in range(91)), *(f"{i}y{k}" for k in range(12))])) for i in range(30)]  # 87 of 111, and 87 of 111
    want += range(500, 530)
    rng.shuffle(rows)
    df, every = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), similar.tables
    monkeypatch.setattr(similar, "tables", lambda nodes: every(nodes)[:1])
    assert similar.links(df, _nodes(df)).count() < 50
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()) == want


def _nodes(df):
    from pyspark.sql import functions as F

    found = similar.prints(df)
    return found.groupBy("sid").agg(F.min("t").alias("t"), *(F.min(c).alias(c) for c in ("f0", "f1", "clear")))


def test_crowds_hold_each_member_once(spark, monkeypatch):
    """A cloud of copies, near enough and not, meets in many tables: its rows are compared by member, not by table, and the groups are brute force's."""
    rng = random.Random(8)
    texts = [[f"w{k}" for k in range(200)] for _ in range(70)]
    for i, t in enumerate(texts):
        for _ in range(2 if i < 35 else rng.randrange(4, 14)):
            t[rng.randrange(200)] = f"x{rng.randrange(9)}"
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[k : k + 5]) for k in range(196)} for t in texts]
    group = list(range(70))
    for i, j in ((i, j) for i in range(70) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
        group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert 5 < len(set(group)) < 60
    held, verified = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda rows, *a: held.append(rows.select("key", "sid").collect()) or verified(rows, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for part in (similar.PART, 16):
        monkeypatch.setattr(similar, "PART", part)
        assert sorted(r["doc_id"] for r in similar.keep_one(df).collect()) == sorted(set(group))
    assert len(held) == 2 and all(len(x) == len(set(x)) <= 4 * len(rows) for x in held)


def test_rows_of_one_id_with_other_texts_are_documents(spark):
    """By row against all pairs: ids repeat with near, equal and other texts."""
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(12)]
    texts = base + [" ".join([*t.split()[:-2], "x", "y"]) for t in base[:8]]
    rows = [(3, "A b c d e f g"), (5, "a B c d e f g"), (5, "z y x w v u"), (7, "k l m n o p")] + [(rng.randrange(6), t) for t in texts for _ in range(2)]
    rows += rows[:6]
    sets = [{tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)} for _, t in rows]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(i, j):
                group = [group[j] if g == group[i] else g for g in group]
    kept = [(r["doc_id"], r["text"]) for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert len(kept) == len(set(group)) == len({group[rows.index(k)] for k in kept})
    assert all(k[0] == min(r[0] for r, g in zip(rows, group) if g == group[rows.index(k)]) for k in kept)
    assert (5, "z y x w v u") in kept and (3, "A b c d e f g") in kept and (5, "a B c d e f g") not in kept


def test_bk_tree():
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ 5 for v in values]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:20]:
        assert set(tree.within(v, 4)) == {x for x in values if (x ^ v).bit_count() <= 4}


def brute_fingerprint(t):
    t = (t or "").strip(" \t\n\v\f\r")
    w = re.split(r"[ \t-\r]+", t.lower()) if t else []
    x = [xxhash.xxh64_intdigest(s.encode(), 42) for s in w]
    rot = lambda v, b: ((v << b) | (v >> (64 - b))) & (2**64 - 1)
    g = []
    for i in range(len(x) - 4):
        h = 0
        for k in range(5):
            h ^= rot(x[i + k], 4 - k)
        g.append((h >> 28, -i))
    out = []
    for a in range(max(1, len(g) - 15) if g else 0):
        m = min(g[a : a + 16])
        if m not in out:
            out.append(m)
    return out


def test_winnowing(spark, edge_docs, no_docs):
    rows = near_texts(25, 7) + [(100, ""), (101, "ä ö ü ß " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in winnowing.compared(df).collect()}
    ids = sorted(dict(rows), reverse=True)
    text = dict(rows)
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for i, k in enumerate(ids):
        t, nxt = text[k], text[ids[(i + 1) % len(ids)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r, sets = got[k], [{h for h, _ in brute_fingerprint(x)} for x in (t, edited, nxt)]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == " ".join(f"{h:x}:{-p}" for h, p in brute_fingerprint(t))
        assert abs(r["near_edited"] - like(sets[0], sets[1])) < 1e-9 and abs(r["near_next"] - like(sets[0], sets[2])) < 1e-9
    assert winnowing.compared(no_docs).count() == 0


def test_winnowing_keeps_every_row(spark, edge_docs):
    """Rows without an id, repeated ids and equal rows each have a row, in the stated order; also with many ranges and chunks of copies."""
    rows = [(r["doc_id"], (r["text"] or "").strip() and f"{r['text'][:3000]} " * 5) for r in edge_docs.collect()] + [(7, "another text of seven words or so"), (7, ""), (6, "")] + [(None, "equal rows " * 9)] * 7 + [(-5, "below zero " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = Counter()
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]]):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = ({h for h, _ in brute_fingerprint(x)} for x in (t, edited, nxt))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), " ".join(f"{h:x}:{-p}" for h, p in brute_fingerprint(t)), round(like(a, b), 9), round(like(a, c), 9)] += 1
    for at_once, copies in ((200_000, 1000), (2, 3)):
        got = winnowing.compared(df, copies, at_once).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want


def brute_removed(texts):
    c = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            if c[t[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if t else b""
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed=4):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh éü") for _ in range(n))
    shared = [noise(n) for n in (399, 400, 401, 700, 1500)]
    rows = []
    for i in range(60):
        parts = [noise(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [s[a:] if rng.random() < 0.5 else s, noise(rng.randint(0, 200))]
        rows.append((i, "".join(parts)))
    return rows + [(100, "ab " * 400), (101, "x" * 1000), (102, rows[0][1] * 2), (103, rows[5][1]), (104, rows[5][1])]


def test_repeats(spark, edge_docs, no_docs, monkeypatch):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = dict(zip((i for i, _ in rows), brute_removed([t.encode() for _, t in rows])))
    assert sum(v[1] for v in want.values()) > 10_000
    assert {r[0]: tuple(r)[1:] for r in repeats.digested(df).collect()} == want
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.deduplicated(df).collect()} == {i: v[:3] for i, v in want.items()}
    monkeypatch.setattr(repeats, "MEMBERS", 0)  # all groups by counting
    assert {r[0]: tuple(r)[1:] for r in repeats.digested(df).collect()} == want
    monkeypatch.undo()
    edges = edge_docs.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(edges, brute_removed([(r["text"] or "").encode() for r in edges])))
    assert Counter(tuple(r) for r in repeats.digested(edge_docs).collect()) == want
    assert repeats.digested(no_docs).count() == 0


def test_repeats_in_long_texts(spark, monkeypatch):
    """Anchors of a text worked on in segments are those of the whole, so results are equal."""
    rows = passages(9)
    long = "".join(t for _, t in rows[:40])
    whole = [x.tolist() for x in repeats.anchors(long.encode())]
    for size in (37, 400, 5000):
        monkeypatch.setattr(repeats, "SEGMENT", size)
        assert [x.tolist() for x in repeats.anchors(long.encode())] == whole
    df = spark.createDataFrame([*rows, (500, long)], "doc_id long, text string")
    want = dict(zip([i for i, _ in rows] + [500], brute_removed([t.encode() for _, t in rows] + [long.encode()])))
    assert {r[0]: tuple(r)[1:] for r in repeats.digested(df).collect()} == want


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_repeats_on_a_whole_table(spark):
    """Every document of a test table against brute force by a sorted list of string hashes, which are compared byte by byte where equal."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    want = dict(zip((i for i, _ in rows), brute_removed([t for _, t in rows])))
    assert {r[0]: tuple(r)[1:] for r in repeats.digested(df).collect()} == want and sum(v[1] for v in want.values()) > 0


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    assert common.shared_dir(spark)


def test_long_words_differ_by_all_their_bytes():
    a = b"x" * 5000
    b, c = a[:10] + b"y" + a[11:], a[:4106] + b"y" + a[4107:]  # 4096 bytes apart
    w = common.Words([b" ".join([a, b, c, b"short"])])
    assert len(set(w.hash.tolist())) == 4 and w.hash[3] == common.Words([b"short"]).hash[0]


def test_run_index():
    rng = np.random.default_rng(3)
    parts = [rng.integers(1, 4, rng.integers(3, 30)) for _ in range(40)]
    parts += parts[:5]
    text = np.concatenate([np.append(x, 0) for x in parts]).astype(np.int32)
    starts = np.flatnonzero(np.concatenate([[True], text[:-1] == 0]))
    index = repeats.RunIndex(text, starts)
    got, n = index.statistics(), len(text)
    ends = np.flatnonzero(text == 0)
    for p in range(n):
        end = ends[np.searchsorted(ends, p)]
        best = 0
        for q in range(n):
            k = 0
            while q != p and p + k < end and q + k < n and text[p + k] == text[q + k]:
                k += 1
            best = max(best, k)
        assert min(int(got[p]), int(end - p)) == best, p
    assert index.run_length.sum() == n and index.runs == len(index.run_symbol)
