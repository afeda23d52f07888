r"""Operator 13, source divergence audit: how far the sources of each lang differ in the words they use, in integers.

What a CountVectorizer per lang does with `minDF` and the largest integer as `vocabSize` is done on arrays here: in each task
the documents of a slice become exact sparse vectors (document, term, count), the vectors are summed by (lang, source) as
Summarizer does it, but sparsely, and the documents that hold a term are counted. Rows of these sums are added up over the
cluster, and terms in fewer documents of their lang than `min_df` go. No vocabulary is held by the driver or sent to tasks,
so it may grow with the corpus; the README has the figures of Spark's class, which a test compares the vectors with.

Pairs of sources are evaluated on what they hold. With p = p0 for a term that a source lacks, the sum over all V terms is
V * f(p0, q0), plus what changes where one source alone has the term, plus what changes again where both do. The first change
depends on the count only, so it is taken from a source's histogram of counts. The second is added up in tasks that hold a
block of `BLOCK` sources by as many, a term at a time; a task hands on one number a pair, never a row for each term of a pair.

p = 1 + floor(10**9 * (count + 2) / (N + 2 V)); f = floor((p - q)**2 / (p + q)); terms are runs of other characters than
[\x00-\x40\x5B-\x60\x7B-\x7F], A-Z as a-z.

Defined cases: null text, lang and source are ''; a lang without kept terms has pairs of value 0 and no terms; a group whose
documents hold no term is a group; every row is a document, also where ids repeat or are null; equal values are ranked by the
item's bytes; a long text is a slice of its own; an empty table gives an empty result; only `text`, `lang` and `source` are
read, whatever else the table has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import checkpoint, text_slices

BLOCK = 512
UNIT = 1_000_000_000
#: For the SQL.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_INSIDE = np.arange(256) >= 128
_INSIDE[65:91] = _INSIDE[97:123] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 22


class Vectors:
    """Sparse vectors of some texts: terms (the distinct ones), and entries (text, term, count) sorted by text and term."""

    def __init__(self, texts: list[bytes]):
        buf = _LOWERED[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
        edge = np.flatnonzero(np.diff(_INSIDE[buf], prepend=False, append=False))
        start, length = edge[::2], edge[1::2] - edge[::2]
        owner = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), start, "right")
        index, first = self._distinct(buf, start, length)
        #: Each distinct term once, end to end.
        size = length[first]
        at = np.arange(size.sum()) + np.repeat(start[first] - np.cumsum(size) + size, size)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        self.terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[at].tobytes()))
        entry, count = np.unique(owner * max(len(first), 1) + index, return_counts=True)
        self.text, self.term, self.count = entry // max(len(first), 1), entry % max(len(first), 1), count

    @staticmethod
    def _distinct(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's number among the distinct ones, and where each of those is first. By hash, then compared byte by byte."""
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.cumsum(length) - length
        inner = np.arange(length.sum()) - np.repeat(begin, length)
        own = buf[inner + np.repeat(start, length)]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(length.max()), _BASE), dtype=np.uint64)
            value = np.add.reduceat((own.astype(np.uint64) + np.uint64(1)) * power[inner], begin)
            value ^= value >> np.uint64(31)
        _, first, index = np.unique(value, return_index=True, return_inverse=True)
        same = (length == length[first][index]).all() and (own == own[inner + np.repeat(begin[first][index], length)]).all()
        if not same:  # two terms with one hash
            words = np.array([own[a : a + n].tobytes() for a, n in zip(begin.tolist(), length.tolist())], object)
            _, first, index = np.unique(words, return_index=True, return_inverse=True)
        return index, first

    def summed(self, group: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entries summed over the texts of a group: group, term, count and number of texts."""
        n = max(len(self.terms), 1)
        key, back, texts = np.unique(group[self.text] * n + self.term, return_inverse=True, return_counts=True)
        return key // n, key % n, np.bincount(back, self.count, len(key)).astype(np.int64), texts


def document_vectors(docs: DataFrame) -> DataFrame:
    """doc_id, lang and vector (a map from each term to its count) of every row, of all terms."""

    def run(batches):
        for part, texts in text_slices(batches, max_bytes=SLICE_BYTES):
            v = Vectors(texts)
            offsets = np.searchsorted(v.text, np.arange(len(texts) + 1)).astype(np.int32)
            maps = pa.MapArray.from_arrays(pa.array(offsets), v.terms.take(pa.array(v.term)), pa.array(v.count))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), maps], ["doc_id", "lang", "vector"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, lang string, vector map<string, long>")


def term_counts(docs: DataFrame, min_df: int = 10) -> DataFrame:
    """lang, source, term, n and of_lang (the count in the whole lang) of every kept term that a group holds."""

    def run(batches):
        for part, texts in text_slices(batches, max_bytes=SLICE_BYTES):
            v, names = Vectors(texts), list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            groups = sorted(set(names))
            number = {g: i for i, g in enumerate(groups)}
            group, term, n, df = v.summed(np.array([number[x] for x in names]))
            lang, source = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(group)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, v.terms.take(pa.array(term)), pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")
    sums = rows.mapInArrow(run, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    kept = sums.groupBy("lang", "term").agg(F.sum("df").alias("in_lang"), F.sum("n").alias("of_lang")).where(F.col("in_lang") >= min_df)
    # both sides read the same columns of sums, so that Spark makes and shuffles them once
    return checkpoint(sums.where("df > 0").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "of_lang"))


def _p(n: Column, total: str = "total", kept: str = "kept") -> Column:
    """p of a count among total, with kept terms in the lang; the product may pass 64 bits."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + 2), (F.col(total) + 2 * F.col(kept)).cast("decimal(20,0)"))


def _f(p, q) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def _change(p: np.ndarray, q: np.ndarray, p0: np.ndarray, q0: np.ndarray) -> np.ndarray:
    """What a term changes for each pair of a source with it (p) and another (q), beyond what each changes alone."""
    f = lambda a, b: (a[:, None] - b[None, :]) ** 2 // (a[:, None] + b[None, :])
    return f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)


def _numbers(column: pa.Array) -> np.ndarray:
    """A number for each value of a column of strings."""
    return np.asarray(column.dictionary_encode().indices)


def _shared(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Changes of each pair i < j over the terms in rows sorted by lang, x, y and term: lang, x, y, term, i, p, p0."""
    key, sums, held = None, None, None

    def add(i: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        left, right = i // block == key[1], i // block == key[2]
        sums[np.ix_(i[left] % block, i[right] % block)] += _change(p[left], p[right], p0[left], p0[right])

    def ended() -> pa.RecordBatch:
        i, j = np.nonzero(sums)
        value, i, j = sums[i, j], i + key[1] * block, j + key[2] * block
        use = i < j
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * int(use.sum()), pa.string()), pa.array(i[use]), pa.array(j[use]), pa.array(value[use])], ["lang", "i", "j", "value"])

    def runs(rows: pa.RecordBatch, whole: bool) -> tuple[list, int]:
        """Where terms begin and end, without the last one unless it is whole; and where that begins."""
        names = np.stack([_numbers(rows.column(0)), np.asarray(rows.column(1)), np.asarray(rows.column(2)), _numbers(rows.column(3))])
        cut = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), len(rows)]
        spans = list(zip(cut, cut[1:]))
        return (spans, len(rows)) if whole else (spans[:-1], cut[-2])

    def added(rows: pa.RecordBatch, spans: list) -> Iterator[pa.RecordBatch]:
        nonlocal key, sums
        langs, x, y = rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist()
        numbers = [np.asarray(rows.column(c)) for c in (4, 5, 6)]
        for a, b in spans:
            if (now := (langs[a], x[a], y[a])) != key:
                if key is not None:
                    yield ended()
                key, sums = now, np.zeros((block, block), np.int64)
            add(*(n[a:b] for n in numbers))

    for batch in batches:
        rows = batch if held is None or not len(held) else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if len(rows):
            spans, last = runs(rows, False)
            yield from added(rows, spans)
            held = rows.slice(last)
    if held is not None and len(held):
        yield from added(held, runs(held, True)[0])
    if key is not None:
        yield ended()


def _pairs(counts: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """lang, source, item and value of all ordered pairs of a lang's sources. groups: lang, source, i, sources, total, kept, p0."""
    own = counts.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n")))
    left = groups.select("lang", F.col("i").alias("a"), "kept", "p0")
    right = groups.select("lang", F.col("i").alias("b"), F.col("p0").alias("q0"))
    pair = ["lang", "a", "b"]
    base = left.join(right, "lang").where("a <> b").select(*pair, F.when(F.col("kept") > 0, F.col("kept") * _f("p0", "q0")).otherwise(0).alias("value"))
    single = own.groupBy("lang", F.col("i").alias("a"), "p", "p0").agg(F.count("*").alias("m")).join(right, "lang").where("a <> b")
    single = single.groupBy(*pair).agg(F.sum(F.col("m") * (_f("p", "q0") - _f("p0", "q0"))).alias("value"))
    block = F.floor(F.col("i") / size)
    others = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("sources") / size).cast("long") - 1)
    rows = own.select("lang", "term", "i", "p", "p0", block.alias("h"), F.explode(others).alias("o"))
    rows = rows.select("lang", F.least("h", "o").alias("x"), F.greatest("h", "o").alias("y"), "term", "i", "p", "p0")
    both = rows.repartition("lang", "x", "y", "term").sortWithinPartitions("lang", "x", "y", "term").mapInArrow(lambda b: _shared(b, size), "lang string, i long, j long, value long")
    both = both.groupBy("lang", F.col("i").alias("a"), F.col("j").alias("b")).agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    total = base.unionByName(single).unionByName(turned(single)).unionByName(both).unionByName(turned(both)).groupBy(*pair).agg(F.sum("value").alias("value"))
    name = lambda i, c: groups.select("lang", F.col("i").alias(i), F.col("source").alias(c))
    return total.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, min_df: int = 10, top: int = 10, block: int = BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank: each source against the others of its lang, and the `top` terms it uses more than its lang does."""
    counts = term_counts(docs, min_df)
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang", "term").agg(F.first("of_lang").alias("of_lang")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("total"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs.select("lang", "kept", F.col("total").alias("lang_total")), "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    # what the rows of counts need of their lang stands in their group, so that no join deals them out by lang
    groups = groups.withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    groups = checkpoint(groups.withColumn("p0", F.when(F.col("kept") > 0, _p(F.lit(0)))).withColumn("i", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")))
    pairs = _pairs(counts, groups, block).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    own = counts.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"))).withColumn("q", _p(F.col("of_lang"), "lang_total")).where("p > q")
    ranked = own.select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(ranked, "term"))


ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), tokens AS MATERIALIZED (
  SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM tokens GROUP BY lang, term HAVING count(*) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT t.lang, t.source, t.term, CAST(sum(t.n) AS HUGEINT) AS n FROM tokens t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
grp AS MATERIALIZED (
  SELECT d.lang, d.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = d.lang AND c.source = d.source), 0) AS total, coalesce(l.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN langs l ON d.lang = l.lang
), dense AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) AS p,
    1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM dense WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
