"""Mixing, pieces, surrogates and the pipeline."""

import collections
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import mixing, pieces, private

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_weights_and_bisection():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1, "d": 0.0}
    assert mixing.weights(shares, 1.0) == pytest.approx(shares) and mixing.weights(shares, 0.0) == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3, "d": 0})
    tokens = {"a": 7000, "b": 2000, "c": 1000}
    a = mixing.bisect_exponent(tokens, 10_000, 0.95, None)
    assert mixing.entropy(mixing.weights({k: v / 10_000 for k, v in tokens.items()}, a)) == pytest.approx(0.95, abs=1e-6)
    a = mixing.bisect_exponent(tokens, 10_000, 1.0, 2.0)
    w = mixing.weights({k: v / 10_000 for k, v in tokens.items()}, a)
    assert max(10_000 * w[k] / tokens[k] for k in w) == pytest.approx(2.0, abs=1e-6)
    assert mixing.bisect_exponent({}, 10, None, 4.0) == 1.0 and mixing.bisect_exponent({"a": 5}, 5, None, 4.0) == pytest.approx(1.0)


def test_mixture_meets_the_weights(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 10 < 7 else "mid" if i % 10 < 9 else None, " ".join(["w"] * rng.randint(1, 30))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    out = mixing.mixed_documents(df).collect()
    n = {i: len(t.split()) for i, _, t in rows}
    own, got, weight = collections.Counter(), collections.Counter(), {}
    for i, s, _ in rows:
        own[s] += n[i]
    copies = collections.Counter()
    for r in out:
        got[r["source"]] += n[r["doc_id"]]
        weight[r["source"]] = r["weight"]
        copies[r["doc_id"], r["source"], r["epoch"]] += 1
    total = sum(own.values())
    assert max(copies.values()) == 1 and weight["big"] < own["big"] / total and weight[None] > own[None] / total
    for s in own:
        assert 0 <= weight[s] * total - got[s] <= 31
        whole = int(weight[s] * total) // own[s]
        for e in range(whole):
            assert {i for i, x, k in copies if x == s and k == e} == {i for i, x, _ in rows if x == s}
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mixed_documents(df.repartition(7)).collect()), key=repr)
    half = mixing.mix(df, budget=total // 2, keep_place=True)
    assert sum(n[r["doc_id"]] for r in half.collect()) <= total // 2


def brute_mixture(spark, rows, budget=None, entropy=None, repeats=4.0, block_documents=mixing.BLOCK_DOCUMENTS):
    """(epoch, doc_id, source, text, block, block_place, place) of each copy, by plain passes over lists, and the weights; the places are Spark's hashes."""
    n = lambda t: len((t or "").split())
    own, want = collections.Counter(), collections.Counter()
    for _, s, t in rows:
        own[s] += n(t)
    total = budget or sum(own.values())
    a = mixing.bisect_exponent(dict(own), total, entropy, repeats)
    w = mixing.weights({k: v / sum(own.values()) for k, v in own.items()}, a)
    for s in own:
        full, rest = divmod(int(w[s] * total), own[s])
        mine = spark.createDataFrame([r for r in rows if r[1] == s], "doc_id long, __mix_source string, text string").withColumn("__mix_h", F.xxhash64(F.lit(17), "doc_id", "text"))
        blocks = -(-mine.count() // block_documents)
        hashed = mine.withColumn("__mix_block", F.pmod("__mix_h", F.lit(blocks))).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(full))))
        place = hashed.withColumn("p", mixing.block_order(17, F.col("e"))).withColumn("q", mixing._place(17, F.col("e"))).collect()
        key = lambda r, s=s: (r["e"], r["doc_id"], s, r["text"], r["__mix_block"], r["p"], r["q"])
        want.update(key(r) for r in place if r["e"] < full)
        used, last = 0, sorted((r for r in place if r["e"] == full), key=lambda r: (r["p"], r["__mix_block"], r["q"], (r["doc_id"] is not None, r["doc_id"] or 0), r["__mix_h"]))
        for _, block in itertools.groupby(last if rest else [], key=lambda r: (r["p"], r["__mix_block"])):
            block = list(block)
            size = sum(n(r["text"]) for r in block)
            if used + size > rest:
                for r in block:
                    used += n(r["text"])
                    if used <= rest:
                        want[key(r)] += 1
                break
            used += size
            want.update(map(key, block))
    return want, w


def test_mixture_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(i if i % 50 else None, rng.choice(["a", "a", "a", "b", "c", None]), " ".join(["w"] * rng.randint(0, 40)) if i % 31 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    total = sum(len((t or "").split()) for *_, t in rows)
    for budget, entropy, repeats in ((None, None, 4.0), (total * 3, 1.0, 5.0), (total // 3, 0.9, None)):
        out = mixing.mix(df.repartition(5), budget, entropy, repeats, block_documents=16, keep_place=True).collect()
        want, w = brute_mixture(spark, rows, budget, entropy, repeats, 16)
        assert collections.Counter((r["epoch"], r["doc_id"], r["source"], r["text"], r["block"], r["block_place"], r["place"]) for r in out) == want
        assert all(r["weight"] == pytest.approx(w[r["source"]]) for r in out)


def test_mixing_edges(edge_docs, no_docs):
    out = mixing.mix(edge_docs)
    assert out.columns == edge_docs.columns and out.count() >= edge_docs.count() - 1
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in edge_docs.collect()}  # no other column changes
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(edge_docs.where("coalesce(trim(text), '') = ''")).count() == 2 + 1 * (edge_docs.where("doc_id = 7").count() - 1)


needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file")


@needs_model
def test_pieces_match_the_library(spark, edge_docs, no_docs):
    import sentencepiece as spm

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(open(pieces.MODEL, "rb").read())
    m.trainer_spec.model_type = 1  # the library's best path by scores
    for p in m.pieces:
        p.score = max(p.score, -40_000)
    library = spm.SentencePieceProcessor(model_proto=m.SerializeToString())
    known = pieces.load_pieces()
    codec = pieces.Codec(known | {"normal": [(p, max(s, -40_000), i) for p, s, i in known["normal"]]})
    rng = random.Random(4)
    texts = ["", " ", "a", "Hello, world.", "  two  spaces ", "tab\tline\nend", "żółć 漢字 🙂 ½²", "x" * 300, "don't (stop)! 3.14"] + ["".join(rng.choice("abcde éß .,!\n12") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), np.int32).tolist()
        assert ids == library.encode(t), t
        assert codec.decode(ids) == t
    out = pieces.encode(edge_docs)
    assert "text" not in out.columns and set(edge_docs.columns) - {"text"} < set(out.columns) and out.where("not exact").count() == 0
    assert out.where("doc_id in (1, 2) and size(piece_ids) = 0").count() == 2
    back = pieces.decode(out.select("doc_id", "piece_ids"))
    plain = lambda df: collections.Counter((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())
    assert plain(back) == plain(edge_docs) and pieces.encode(no_docs).count() == 0


def test_best_path_by_brute_force():
    table = [("▁", -1.0, 0), ("a", -1.5, 1), ("b", -1.7, 2), ("ab", -2.0, 3), ("▁a", -1.9, 4), ("ba", -2.5, 5), ("aba", -3.1, 6)]
    codec = pieces.Codec({"normal": table, "bytes": {}, "unknown": 99})
    score = {p: s for p, s, _ in table}
    for n in range(1, 7):
        for t in map("".join, itertools.product("ab", repeat=n)):
            s = "▁" + t
            best = max(sum(score[x] for x in cut) for k in range(len(s)) for at in itertools.combinations(range(1, len(s)), k) for cut in [[s[i:j] for i, j in zip((0, *at), (*at, len(s)))]] if all(x in score for x in cut))
            names = {i: p for p, _, i in table}
            assert sum(score[names[i]] for i in codec.best_path(s)) == pytest.approx(best)
    assert codec.best_path("c") == [99]


KEY = b"only for tests"


def test_long_parts_take_the_same_path(monkeypatch):
    """A part without a cut, worked on in arrays, is cut as in lists; also one of a million characters."""
    table = [("▁", -1.0, 0), ("a", -1.5, 1), ("b", -1.7, 2), ("ab", -2.0, 3), ("▁a", -1.9, 4), ("ba", -2.5, 5), ("aba", -3.1, 6)]
    codec = pieces.Codec({"normal": table, "bytes": {}, "unknown": 99})
    rng = random.Random(1)
    texts = ["▁" + "".join(rng.choice("abc") for _ in range(n)) for n in (5, 50, 500)]
    want = [codec.best_path(t) for t in texts]
    monkeypatch.setattr(pieces.Codec, "LONG", 3)
    assert [codec.best_path(t) for t in texts] == want
    assert codec.decode(codec.best_path("▁" + "ab" * 500_000)) == "ab" * 500_000


def test_every_mention_of_a_found_name_goes():
    text = "Mrs. Maria Lopez met Maria and Lopez, not Lopezia. Anna Smith called; then Smith, and anna, left. Dr. Lopez-Smith, Mr Pavel."
    found = private.find(text)
    old = [text[a:b] for a, b, _ in found]
    assert old == ["Maria Lopez", "Maria", "Lopez", "Anna Smith", "Smith", "Lopez-Smith", "Pavel"]
    out = private.masked(text, found, KEY)
    new = dict(zip(old, (out[a:b] for a, b, _ in private.find(out))))
    assert new["Maria Lopez"] == f"{new['Maria']} {new['Lopez']}" and new["Anna Smith"].endswith(" " + new["Smith"]) and new["Lopez-Smith"] == f"{new['Lopez']}-{new['Smith']}"
    assert not {"Maria", "Lopez", "Smith", "Anna"} & set(out.replace(",", " ").replace(".", " ").replace("-", " ").split())
    assert new["Maria"] in private.GIVEN["latin", "f"] and new["Anna Smith"].split()[0] in private.GIVEN["latin", "f"]
    assert private.find("The Anna river. Mark, Smith and others; Annabel Smith") == []


def test_the_key_comes_from_outside(spark):
    df = spark.createDataFrame([(1, "call 367-555-9476 now")], "doc_id long, text string")
    one, two = (private.mask(df).first()["text"] for _ in range(2))
    assert one != two  # a random key each
    spark.conf.set(private.KEY_SETTING, "a secret")
    try:
        three, four = (private.mask(df).first()["text"] for _ in range(2))
    finally:
        spark.conf.unset(private.KEY_SETTING)
    assert three == four and three not in (one, two) and private.mask(df, KEY).first()["text"] == private.masked_documents(df, KEY).first()["text"] != three


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_distinctness_by_brute_force(spark):
    """Over a whole table: one surrogate an original, one original a surrogate, none unchanged but by chance of tiny domains, and nothing else changes."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = {r["doc_id"]: r for r in private.masked_documents(rows, KEY).collect()}
    there, back, n = {}, {}, 0
    for r in rows.collect():
        text = r["text"] or ""
        found = private.find(text)
        end, at, new = 0, 0, out[r["doc_id"]]["text"] or ""
        assert out[r["doc_id"]]["n_entities"] == len(found)
        for a, b, kind in found:  # surrogates have the length of what they stand for, but given names and addresses
            at += a - end
            assert new[at - (a - end) : at] == text[end:a]
            s = private.surrogate(kind, text[a:b], KEY)
            assert new[at : at + len(s)] == s
            end, at, n = b, at + len(s), n + 1
            old, s = private.canonical(kind, text[a:b]), private.canonical(kind, s)
            assert there.setdefault((kind, old), s) == s and back.setdefault((kind, s), old) == old
        assert new[at:] == text[end:]
    assert n > 50


def test_surrogates_keep_type_and_format():
    text = 'Mrs. Maria Lopez wrote to bob.smith7@mail.example.com, +1 (367) 555-9476 or 367-555-9476, from 10.20.30.40, card 4539 1488 0343 6467, token = "9765fab7324201a5ddfac0becd9064abbef40be8". Mr Иван Петров; IBAN DE89 3704 0044 0532 0130 00; 123-45-6789. Again bob.smith7@mail.example.com.'
    found = private.find(text)
    assert [k for _, _, k in found] == ["person", "email", "phone", "phone", "ip", "card", "secret", "person", "iban", "ssn", "email"]
    out = private.masked(text, found, KEY)
    again = private.find(out)
    assert [k for _, _, k in again] == [k for _, _, k in found]
    new = [out[a:b] for a, b, _ in again]
    old = [text[a:b] for a, b, _ in found]
    assert all(a != b for a, b in zip(old, new)) and new[1] == new[-1] and [c for c in new[2] if c.isdigit()][-10:] == [c for c in new[3] if c.isdigit()]
    assert new[0].split()[0] in private.GIVEN["latin", "f"] and new[7].split()[0] in private.GIVEN["cyrillic", "m"]
    card = "".join(c for c in new[5] if c.isdigit())
    assert card[0] == "4" and private._luhn(card[:-1]) == int(card[-1]) and new[5].count(" ") == 3
    iban = new[8].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@pytest.mark.parametrize("kind, texts", [("phone", [f"+1 (200) 555-{i:04d}" for i in range(2000)]), ("email", [f"a{i:02d}@b.com" for i in range(100)]), ("ip", [f"1.2.{i}.{j}" for i in range(20) for j in range(50)]), ("card", [f"4111 1111 {i:04d} {j:04d}" for i in range(30) for j in range(30)])])
def test_surrogates_stay_distinct(kind, texts):
    new = {private.surrogate(kind, t, KEY) for t in texts}
    assert len(new) == len(texts)


def test_names_stay_distinct_and_cased():
    names = [f"{a} {b}" for a in ("Maria", "Anna", "Zelda") for b in ("Smith", "Smyth", "Jones", "O")]
    assert len({private.surrogate("person", n, KEY) for n in names}) == len(names)
    assert private.surrogate("email", "Bob@X.com", KEY).lower() == private.surrogate("email", "bob@x.com", KEY)
    assert private._moved(3, 10, b"k", "t") in range(10) and sorted(private._moved(i, 37, b"k", "t") for i in range(37)) == list(range(37))


def test_mask_edges(spark, edge_docs, no_docs):
    out = private.mask(edge_docs)
    assert out.schema == edge_docs.schema and collections.Counter(r["text"] for r in out.collect()) == collections.Counter(r["text"] for r in edge_docs.collect())
    assert private.mask(no_docs).count() == 0 and private.masked_documents(no_docs).count() == 0
    df = spark.createDataFrame([(1, "call +1 (367) 555-9476"), (2, "call 367-555-9476 now"), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in private.masked_documents(df).collect()}
    digits = lambda t: "".join(c for c in t if c.isdigit())[-10:]
    assert digits(rows[1]["text"]) == digits(rows[2]["text"]) != "3675559476" and rows[3]["text"] is None and rows[1]["n_entities"] == 1
    assert private.collisions(private.entities(df, KEY)).count() == 0


def test_collisions_are_seen(spark):
    df = spark.createDataFrame([("ip", "a", "x"), ("ip", "b", "x"), ("ip", "c", "y"), ("ip", "c", "z"), ("ssn", "q", "x")], "kind string, original string, surrogate string")
    assert {(r["value"], r["broken"]) for r in private.collisions(df).collect()} == {("x", "distinctness"), ("c", "coreference")}


@needs_model
def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    words = [a + b for a in "ka lo mi tu re so".split() for b in "na ve po di".split()]
    docs, labels = [], []
    for i in range(160):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(30, 90)))
        poor = i % 4 == 0
        t = " ".join(w.upper() + "!!" for w in t.split()) if poor else t + f" mail user{i}@mail.example.com"
        docs.append((i, t, "en", f"s{i % 3 if i % 7 else 0}", len(t)))
        labels.append((i, int(not poor), 0))
    copies = [(1000 + k, docs[1][1], "en", "s1", docs[1][4]) for k in range(5)]
    spark.createDataFrame(docs + copies, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert not ids & {i for i in range(160) if i % 4 == 0} and not ids & set(range(1000, 1005)) and len(ids) > 80
    assert all(r["exact"] for r in out)
    texts = pieces.decode(spark.createDataFrame(out[:20], "doc_id long, lang string, source string, n_chars long, piece_ids array<int>, exact boolean")).collect()
    assert all(f"user{r['doc_id']}@mail.example.com" not in r["text"] and "@" in r["text"] for r in texts)
    assert [n for n, _ in corpus_pipeline.STAGES] and F is not None


@needs_model
def test_pipeline_by_brute_force(spark, tmp_path):
    """All five stages over a small corpus, done by loops: scores of the same model, all pairs of shingle sets, surrogates text by text, passes over lists, best paths."""
    from tabforge.llm import quality
    from tabforge.llm.common import fold

    rng = random.Random(12)
    words = [a + b for a in "ka lo mi tu re so".split() for b in "na ve po di".split()]
    docs, labels = [], []
    for i in range(120):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(40, 90)))
        t = " ".join(w.upper() + "!!" for w in t.split()) if i % 4 == 0 else t + f" mail user{i}@mail.example.com and Mrs. Maria Lopez, then Lopez"
        docs.append((i, t, f"s{i % 3 if i % 7 else 0}"))
        labels.append((i, int(i % 4 > 0), 0))
    for i in range(0, 120, 5):  # near copies at several similarities
        w = docs[i][1].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "zz"
        docs.append((1000 + i, " ".join(w), "s1"))
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set(private.KEY_SETTING, "pipeline")
    try:
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        table = spark.read.parquet(f"{tmp_path}/documents.parquet")
        key = private.session_key(table)
    finally:
        spark.conf.unset(private.KEY_SETTING)
    model = quality.train_quality(table, spark.read.parquet(f"{tmp_path}/labels.parquet"), fold("doc_id", 3) != 1)
    good = [r for r, s in zip(docs, quality.score_texts(model, [t.encode() for _, t, _ in docs])) if s >= 0.5]
    assert 60 < len(good) < len(docs)
    sets = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)} for i, t, _ in good}
    group = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert linked
    while any(group[i] != group[j] for i, j in linked):
        for i, j in linked:
            group[i] = group[j] = min(group[i], group[j])
    left = [(i, s, private.masked(t, private.find(t), key)) for i, t, s in good if group[i] == i]
    codec = pieces.Codec(pieces.load_pieces())
    want = collections.Counter()
    for (_, i, s, t, *_), n in brute_mixture(spark, left)[0].items():
        want[i, s, tuple(np.frombuffer(codec.encode(t), np.int32).tolist())] += n
    assert collections.Counter((r["doc_id"], r["source"], tuple(r["piece_ids"])) for r in out) == want


@needs_model
@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_edges(spark, tmp_path, edge_docs, no_docs, empty):
    """Null and empty texts, a null id, repeated rows, clashing columns, no labels and an empty table."""
    (no_docs if empty else edge_docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece_ids", "exact", "score", "_source"} <= set(out.columns)
    rows = out.collect()
    assert rows == [] if empty else len({r["doc_id"] for r in rows}) >= 4 and all(r["exact"] and r["_source"] == "q" for r in rows)
