"""Passages of over 50 words that documents share, against brute force."""

import random
import re
from collections import Counter

from tabforge.llm import passages, queries, repeats
from tabforge.llm.common import WORD


def brute_shared(texts):
    words = [re.findall(WORD.encode(), (t or "").encode()) for t in texts]
    own = [{tuple(w[p : p + 51]) for p in range(len(w) - 50)} for w in words]
    rows = Counter(x for s in own for x in s)
    out = []
    for w in words:
        hit = [False] * len(w)
        for p in range(len(w) - 50):
            if rows[tuple(w[p : p + 51])] > 1:
                hit[p : p + 51] = [True] * 51
        out.append(sum(hit))
    return out


def planted():
    rng = random.Random(7)
    prose = lambda n: [rng.choice(["a", "bé", "of", "the", "ü"]) + str(rng.randrange(300)) for _ in range(n)]
    shared = [prose(n) for n in (50, 51, 52, 60, 95, 150)]
    assert all(len(" ".join(x)) < 400 for x in shared[:4])  # bytes, too: shorter than the strings of op10
    rows = []
    for i in range(80):
        parts = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            parts += rng.choice(shared) + prose(rng.randint(0, 60))
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    loop = prose(60)
    return rows + [(100, "ab " * 400), (101, " ".join(loop * 3)), (102, rows[0][1]), (None, rows[5][1]), (5, rows[5][1]), (103, " ".join(prose(51))), (104, " ".join(prose(700))), (105, "und " * 51), (106, "und " * 90), (107, None), (108, "")]


def test_shared_words(spark, edge_docs, no_docs):
    rows = planted()
    rows += [(200, rows[-5][1]), (201, rows[-5][1])]  # a copied text of 700 words
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_shared([t for _, t in rows])
    assert 0 < sum(x > 0 for x in want) < len(want) and max(want) == 700
    got = passages.audited(df)
    digests = repeats.digested(df)
    assert got.columns == [*digests.columns, "n_shared_words"]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_shared_words"]) for r in got.collect()) == Counter((i, len((t or "").encode()), x) for (i, t), x in zip(rows, want))
    assert Counter(map(tuple, got.drop("n_shared_words").collect())) == Counter(map(tuple, digests.collect()))
    edges = edge_docs.collect()
    assert Counter((r["doc_id"], r["n_shared_words"]) for r in passages.audited(edge_docs).collect()) == Counter((r["doc_id"], x) for r, x in zip(edges, brute_shared([r["text"] for r in edges])))
    assert passages.audited(no_docs).count() == 0


def test_query_catches_planted_passages(spark, tmp_path):
    """A passage of 60 words and under 400 bytes is told in each document that holds it, and in no other."""
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(10**4)}" for _ in range(n))
    passage = prose(60)
    assert len(passage) < 400
    rows = [(i, f"{prose(200)} {passage} {prose(90)}" if i % 4 == 0 else prose(350)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.queries()["op10_repeats"](spark, str(tmp_path)).collect()}
    assert {i: r["n_shared_words"] for i, r in got.items()} == {i: 60 * (i % 4 == 0) for i in range(40)}
    assert all(r["n_removed"] == 0 for r in got.values())
