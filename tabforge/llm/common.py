"""What the operators share: tables, checkpoints, hash folds, samples of labelled rows and byte-level word splitting."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new temporary folder if Spark runs in this process alone, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written to a new folder that all executors share, and read from there: a checkpoint that compresses, for many narrow rows."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are stored: it does so once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows_per_class: int, max_bytes: int) -> list[tuple[bytes, int]]:
    """Whole texts and 0/1 labels of at most rows_per_class documents of each class and max_bytes of text in all.

    Rows are taken in the order of a hash of their id, so the sample does not depend on the partitioning. Each class has
    half of max_bytes, and what one leaves is the other's; a text that does not fit is skipped alone. Null labels and
    labels other than 0 and 1 are left out; an id that has both labels counts as 1; of rows that repeat an id the shortest
    text stands for it. The ids are chosen from the labels alone, and only the chosen texts reach the driver.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where(learn)
    ids = [r for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class).collect()]
    if not ids:
        return []
    chosen = F.broadcast(spark.createDataFrame([(int(r["doc_id"]), int(r["label"])) for r in ids], "doc_id long, label int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("size", F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("t")))
    sizes = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("size").alias("size"), F.first("label").alias("label"))
    rows = sorted(sizes.select("doc_id", "size", "label", F.xxhash64("doc_id").alias("h")).collect(), key=lambda r: (r["h"], r["doc_id"]))
    fits = _within(rows, max_bytes)
    if not fits:
        return []
    kept = F.broadcast(spark.createDataFrame([(r["doc_id"], tuple(r["size"]), r["label"]) for r in fits], "doc_id long, size struct<n: int, t: long>, label int"))
    got = texts.join(kept, ["doc_id", "size"]).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "label").collect()
    return [(r["text"].encode(), r["label"]) for r in sorted(got, key=lambda r: (r["h"], r["doc_id"]))]


def _within(rows: list, max_bytes: int) -> list:
    """Rows whose sizes fit: in each class those within half of max_bytes, then others while the sum allows."""
    taken, used = set(), {0: 0, 1: 0}
    for limit in (lambda y: max_bytes // 2 - used[y], lambda y: max_bytes - sum(used.values())):
        for i, r in enumerate(rows):
            if i not in taken and r["size"]["n"] <= limit(r["label"]):
                taken.add(i)
                used[r["label"]] += r["size"]["n"]
    return [r for i, r in enumerate(rows) if i in taken]


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts have about max_bytes, with the texts as bytes; a null text is empty, a longer one stands alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        group = np.cumsum(size) // max_bytes
        cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
        for a, b in zip(cut, cut[1:]):
            part = batch.slice(a, b - a)
            yield part, [x or b"" for x in part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = _SPACE | np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _MULT, np.uint64), dtype=np.uint64)


def _powers(longest: int) -> np.ndarray:
    """Powers of the hash's base, as many as the longest word has bytes."""
    return _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _MULT, np.uint64), dtype=np.uint64)


class Words:
    """Words of several texts as arrays: buf (bytes, each text followed by a space), start, length, hash and, per text, first (the number of its first word)."""

    def __init__(self, texts: list[bytes], lower: bool = True, marks: bool = True):
        """marks: whether ASCII characters other than letters and digits belong to words or part them."""
        buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.buf = _LOWER[buf] if lower else buf
        space = np.empty(len(buf) + 1, bool)
        space[0] = True
        space[1:] = (_SPACE if marks else _MARK)[buf]
        edge = np.flatnonzero(space[1:] != space[:-1])
        if len(edge) % 2:
            edge = np.append(edge, len(buf))
        self.start, end = edge[::2], edge[1::2]
        self.length = end - self.start
        ends = np.cumsum([len(x) + 1 for x in texts]) if texts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        if len(self.start):
            #: Polynomial hash: the prefix sums restart in each word as positions count from its start.
            n = int(self.length.sum())
            inner = np.arange(n) - np.repeat(np.cumsum(self.length) - self.length, self.length)
            at = inner + np.repeat(self.start, self.length)
            with np.errstate(over="ignore"):
                self.hash = np.add.reduceat((self.buf[at].astype(np.uint64) + np.uint64(1)) * _powers(int(self.length.max()))[inner], np.cumsum(self.length) - self.length)
                self.hash ^= self.hash >> np.uint64(31)
                self.hash *= np.uint64(0xBF58476D1CE4E5B9)
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.start[i] + self.length[i]].tobytes()
