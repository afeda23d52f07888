"""Operator 11, vector code compression: each vector is cut into equal parts, and each part becomes the number of its nearest
codebook entry (product quantisation), all in integers.

Nearest entries are found by a GNAT over each part's entries. A node has split points; every other entry belongs to its
nearest split, and for each (split, child) the node stores the least and greatest distance from the split to the child's
entries. A query whose distances to the splits show that a whole child lies farther than the best entry so far skips it, and
only where it lies strictly farther, as an entry as near may have the lower index. Distances in these bounds are rounded
away from elimination, and winners are compared by integer squared distances, then by index. A block of queries goes down the
tree together: each query first enters the child of its nearest split, then those that its bounds leave.

A round reads the table once. A task hands on sums and counts of the entries it met, at most parts * entries * width numbers,
and these are added up over the cluster; codebooks (the same bound) pass through the driver and go to the tasks.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with
zeros to the longest, and that to a multiple of the parts; fewer rows than entries give as many entries; among equal vec_ids
the lesser vector comes first, null ids come last; every row has a result of its own, also where ids repeat; an empty table
gives an empty result; a floor beyond 2**26 raises, since squared distances would leave 64 bits; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import checkpoint

LARGEST = 1 << 26
SPLITS, LEAF, ROWS = 16, 24, 4096


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; by products of doubles where these are exact, too."""
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * x.shape[1] * peak * peak < 1 << 52:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(y)), np.int64)
    for d in range(x.shape[1]):
        gap = x[:, d, None] - y[None, :, d]
        out += gap * gap
    return out


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


class Gnat:
    """Entries with their indices; splits and children, or, in a leaf, entries alone."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        index = np.arange(len(entries)) if index is None else index
        self.children: list[Gnat | None] = []
        if len(entries) <= LEAF:
            self.split, self.index = entries, index
            return
        picked, gap = [0], _squared(entries, entries[:1])[:, 0]
        while len(picked) < SPLITS and gap.max() > 0:
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, _squared(entries, entries[picked[-1:]])[:, 0])
        self.split, self.index = entries[picked], index[picked]
        rest = np.setdiff1d(np.arange(len(entries)), picked)
        far = _squared(entries[rest], self.split)
        owner, reach = far.argmin(1), np.sqrt(far.astype(np.float64))
        self.low, self.high = np.full((len(picked), len(picked)), np.inf), np.full((len(picked), len(picked)), -np.inf)
        for j in range(len(picked)):
            own = rest[owner == j]
            # equal entries beyond the splits cannot be parted and stay together in a leaf
            self.children.append((Gnat(entries[own], index[own]) if len(picked) > 1 else _leaf(entries[own], index[own])) if len(own) else None)
            if len(own):
                self.low[:, j], self.high[:, j] = _down(reach[owner == j].min(0)), _up(reach[owner == j].max(0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest entry, and how many distances were computed."""
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
        return at, best, self._search(x, np.arange(len(x)), best, at)

    def _search(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> int:
        if not len(rows):
            return 0
        far = _squared(x[rows], self.split)
        least = far.min(1)
        first = np.where(far == least[:, None], self.index[None, :], np.iinfo(np.int64).max).min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < at[rows]))
        best[rows[better]], at[rows[better]] = least[better], first[better]
        spent = far.size
        if self.children:
            reach = np.sqrt(far.astype(np.float64))
            near, away, own = _down(reach), _up(reach), far.argmin(1)
            for home in (True, False):
                for j, child in enumerate(self.children):
                    if child is not None:
                        some = np.flatnonzero((own == j) == home)
                        limit = _up(np.sqrt(best[rows[some]].astype(np.float64)))[:, None]
                        out = (_down(near[some] - self.high[None, :, j]) > limit) | (_down(self.low[None, :, j] - away[some]) > limit)
                        spent += child._search(x, rows[some[~out.any(1)]], best, at)
        return spent


def _leaf(entries: np.ndarray, index: np.ndarray) -> Gnat:
    node = Gnat(entries[:0], index[:0])
    node.split, node.index = entries, index
    return node


@dataclass
class Codebooks:
    """books: one array (entry, position) of integers for each part."""

    books: list[np.ndarray]
    scale: int

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def sha256(self) -> str:
        """Of all components as decimal integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, x (doubles) and kept columns of the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(x.isNotNull() & finite).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), *keep)


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x), padded with zeros."""
    out = np.zeros((len(column), width))
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return np.floor(out * scale).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, len(batch), ROWS):
            part = batch.slice(a, ROWS)
            yield part, _integers(part.column(part.schema.get_field_index("x")), width, scale)


def _means(rows: DataFrame, now: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of the parts it is nearest to; others stay."""
    send = rows.sparkSession.sparkContext.broadcast([(b, Gnat(b)) for b in now.books])
    width, scale = now.width, now.scale

    def run(batches):
        parts = send.value
        size = parts[0][0].shape[1]
        sums, counts = [np.zeros(b.shape, np.int64) for b, _ in parts], [np.zeros(len(b), np.int64) for b, _ in parts]
        for _, x in _blocks(batches, width, scale):
            for p, (_, tree) in enumerate(parts):
                own = x[:, p * size : (p + 1) * size]
                at = tree.nearest(own)[0]
                np.add.at(sums[p], at, own)
                counts[p] += np.bincount(at, minlength=len(counts[p]))
        for p, (s, n) in enumerate(zip(sums, counts)):
            met = np.flatnonzero(n)
            entry, position = np.repeat(met, size), np.tile(np.arange(size), len(met))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(position.astype(np.int32)), pa.array(s[met].ravel()), pa.array(n[entry])], ["part", "entry", "position", "sum", "n"])

    found = rows.select("x").mapInArrow(run, "part int, entry int, position int, sum long, n long")
    total = found.groupBy("part", "entry", "position").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n")).collect()
    books = [b.copy() for b in now.books]
    for r in total:
        books[r["part"]][r["entry"], r["position"]] = int(r["sum"]) // r["n"]
    send.unpersist()
    return Codebooks(books, scale)


def train(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks of rows (as usable gives them), from the vectors of the smallest ids; None without rows."""
    longest, peak = rows.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    if longest is None:
        return None
    if (peak or 0) * scale > LARGEST - 1:
        raise ValueError(f"a component of {peak} times {scale} is beyond {LARGEST}")
    width = -(-longest // parts) * parts
    first = rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).toArrow().combine_chunks()
    start = _integers(first.column("x").combine_chunks(), width, scale)
    books = Codebooks(np.split(start, parts, axis=1) if width else [start[:, :0]] * parts, scale)
    for _ in range(rounds):
        books = _means(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """rows without x, with code (two hex digits a part, or as many as the entries need) and error (squared distances summed)."""
    send = rows.sparkSession.sparkContext.broadcast([Gnat(b) for b in books.books])
    width, scale, names = books.width, books.scale, [c for c in rows.columns if c != "x"]
    digits = max(2, *(len(f"{max(len(b) - 1, 0):x}") for b in books.books))

    def run(batches):
        for part, x in _blocks(batches, width, scale):
            error, codes, size = np.zeros(len(x), np.int64), [], width // len(send.value)
            for p, tree in enumerate(send.value):
                at, far, _ = tree.nearest(x[:, p * size : (p + 1) * size])
                error += far
                codes.append(at.tolist())
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*codes)]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(text, pa.string()), pa.array(error)], [*names, "code", "error"])

    kept = rows.drop("x").schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "code string", "error long"])
    return rows.mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with approximation: the entries' components over scale, end to end."""
    send, scale, names = codes.sparkSession.sparkContext.broadcast(books.books), books.scale, codes.columns
    digits = max(2, *(len(f"{max(len(b) - 1, 0):x}") for b in books.books))

    def run(batches):
        for batch in batches:
            rows = [[v for p, b in enumerate(send.value) for v in (b[int(c[p * digits : (p + 1) * digits], 16)] / scale).tolist()] for c in batch.column(names.index("code")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*names, "approximation"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema), "approximation array<double>"])
    return codes.mapInArrow(run, schema)


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together) and codebooks_sha256."""
    rows = usable(vectors, keep=("label",))
    books = train(rows)
    if books is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = checkpoint(encode(rows, books))
    by_label = coded.groupBy(F.col("label").alias("own")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("own"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """SQL of a round: book n from book n - 1."""
    return f"""
near{n} AS MATERIALIZED (
  SELECT q.row, q.part, arg_min(b.entry, 100000 * CAST(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) + b.entry) AS entry
  FROM parts q JOIN book{n - 1} b ON q.part = b.part GROUP BY q.row, q.part
), mean{n} AS MATERIALIZED (
  SELECT part, entry, list(m ORDER BY position) AS v FROM (
    SELECT e.part, e.entry, e.position, CAST(floor(sum(e.x)::DOUBLE / count(*)) AS BIGINT) AS m
    FROM (SELECT a.part, a.entry, unnest(range(len(q.v))) AS position, unnest(q.v) AS x FROM near{n} a JOIN parts q ON a.row = q.row AND a.part = q.part) e
    GROUP BY e.part, e.entry, e.position) GROUP BY part, entry
), book{n} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{n - 1} b LEFT JOIN mean{n} m ON b.part = m.part AND b.entry = m.entry
)"""


ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, p AS part, q[p * (len(q) // 4) + 1 : (p + 1) * (len(q) // 4)] AS v FROM kept, (SELECT unnest([0, 1, 2, 3]) AS p)
), book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= 256),
{",".join(_round(n) for n in range(1, 5))}, last AS MATERIALIZED (
  SELECT q.row, q.part, min(100000 * CAST(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) + b.entry) AS best
  FROM parts q JOIN book4 b ON q.part = b.part GROUP BY q.row, q.part
), coded AS MATERIALIZED (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(CAST(best % 100000 AS BIGINT))), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // 100000) AS BIGINT) AS error
  FROM last JOIN kept k ON last.row = k.row GROUP BY k.row, k.vec_id, k.label
), flat AS (SELECT part, entry, unnest(range(len(v))) AS position, unnest(v) AS x FROM book4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, position)) FROM flat) AS codebooks_sha256
FROM coded
"""
