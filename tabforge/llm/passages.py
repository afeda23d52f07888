"""Words in passages that documents share: runs of WORDS words in a row that also stand in another document (row).

Words are runs of bytes without ASCII white space, taken as they are; the white space between them may differ. This
goes beside the strings of 400 bytes in repeats.py, as a passage of over 50 words can be shorter than that.

Each run of WORDS words has an anchor, the least hash of its runs of GRAM words, so equal runs have equal anchors. Only
runs whose anchor stands in two different texts go on; they are compared by a 64-bit hash each. Hashes travel packed, in
buckets, meet in the task that sorts a bucket and go on packed by text. In a text that stands in several rows all runs are shared; its runs at
every WORDS-th word are sent with a flag for that. Texts are told apart by 64-bit hashes, too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import Words, released, shared_dir, text_slices
from tabforge.llm.repeats import _digests, _kept, _power, _texts, keyed

WORDS, GRAM = 51, 8
SPAN = WORDS - GRAM + 1  # runs of GRAM words in a run of WORDS
ENTRIES = 1 << 20  # that a task gathers before it sends them
COPIED = np.uint32(1 << 31)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of WORDS words that lie in one text: the text's number, the first word's number there, the hash and the anchor."""
    w = Words(texts, lower=False)
    starts = len(w) - WORDS + 1
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))
    whole = np.flatnonzero(text[: max(starts, 0)] == text[WORDS - 1 :])
    if not len(whole):
        return whole, whole, whole.astype(np.uint64), whole.astype(np.uint64)
    h = {1: w.hash}
    for s in (1, 2, 4, 8, 16):  # polynomial hashes of 1, 2, 4, ... words in a row
        h[2 * s] = h[s][:-s] * _power(s) + h[s][s:]
    hashed, at = np.zeros(starts, np.uint64), 0
    for s in (32, 16, 2, 1):
        hashed = hashed * _power(s) + h[s][at : at + starts]
        at += s
    least, step = _mixed(h[GRAM]), 1
    while step * 2 <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:starts], least[SPAN - step : SPAN - step + starts])
    return text[whole], whole - w.first[text[whole]], _mixed(hashed[whole]), least[whole]


def _dealt(entries: Iterator[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket's number and packed columns, from columns of which the first is a hash."""
    held, size = [], 0

    def emit():
        columns = [np.concatenate(x) for x in zip(*held)]
        bucket = columns[0].view(np.uint64) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        own, head = np.unique(bucket[order], return_index=True)
        cuts = list(zip(head.tolist(), [*head[1:].tolist(), len(order)]))
        packed = [[x[a:b].tobytes() for a, b in cuts] for x in (c[order] for c in columns)]
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)], ["bucket", "a", "b", "c"][: 1 + len(columns)])

    for columns in entries:
        held.append(columns)
        size += len(columns[0])
        if size > ENTRIES:
            yield emit()
            held, size = [], 0
    if size:
        yield emit()


def _met(batches: Iterator[pa.RecordBatch], *types: type) -> Iterator[tuple[np.ndarray, ...]]:
    """Where groups of equal values begin, and the packed columns of all rows together, sorted by the first; nothing if there are none."""
    if rows := [b for b in batches if b.num_rows]:
        columns = [np.frombuffer(b"".join(x for b in rows for x in b.column(i + 1).to_pylist()), t) for i, t in enumerate(types)]
        order = np.argsort(columns[0])
        columns = [c[order] for c in columns]
        yield np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1])), *columns


def _groups(head: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of each entry's group, and whether the group has several ids."""
    size = np.diff(np.append(head, len(ids)))
    several = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)
    return np.repeat(size, size), np.repeat(several, size)


def _shared_anchors(head: np.ndarray, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with their anchors that stand in several texts, and with 0 for those that occur twice in one, as those of copies do."""
    size, several = _groups(head, ids)
    ids, found = ids[size > 1], (h * several)[size > 1]
    order = np.lexsort((found, ids))
    ids, found = ids[order], found[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (found[1:] != found[:-1]))[: len(ids)]  # a text with many copies sends each once
    return ids[new], found[new]


def _shared_runs(head: np.ndarray, h: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = _groups(head, ids)[1] | (place >= COPIED)
    return ids[keep], place[keep] & ~COPIED


def covered(starts: np.ndarray) -> int:
    """Words in runs of WORDS words from each of starts."""
    starts = np.unique(starts).astype(np.int64)
    return int(np.minimum(np.diff(starts), WORDS).sum()) + WORDS if len(starts) else 0


def shared_words(docs: DataFrame) -> DataFrame:
    """id and n_shared_words of each distinct text that has any. docs: id (a 64-bit hash of the text) and text."""
    spark = docs.sparkSession
    folder, n = f"{shared_dir(spark)}/passages-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * n

    def anchors(batches):
        def entries():
            for part, texts in text_slices(batches):
                text, _, _, anchor = runs(texts)
                new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))[: len(text)])
                yield anchor[new], part.column(0).to_numpy()[text[new]]

        yield from _dealt(entries(), buckets)

    def candidates(batches):
        def entries():
            for part, texts in text_slices(batches):
                text, first, h, anchor = runs(texts)
                ids, copies = part.column(0).to_numpy(), part.column(1).to_numpy()
                last = np.append(text[1:] != text[:-1], True)[: len(text)]
                flag = (copies[text] > 1) & ((first % WORDS == 0) | last)
                keep = flag.copy()
                edge = np.searchsorted(text, np.arange(len(texts) + 1))
                for a, b, wanted in zip(edge.tolist(), edge[1:].tolist(), part.column(2).to_pylist()):
                    keep[a:b] |= np.isin(anchor[a:b], np.frombuffer(wanted, np.uint64))
                yield h[keep], ids[text[keep]], first[keep].astype(np.uint32) | COPIED * flag[keep]

        yield from _dealt(entries(), buckets)

    def by_text(batches, kind, made, name, to):
        for head, ids, values in _met(batches, np.int64, kind):
            made_of = [made(values[a:b]) for a, b in zip(head.tolist(), [*head[1:].tolist(), len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(made_of, to)], ["id", name])

    def meet(df, *types, shared):
        """The shared entries of what df deals, each dealt on by its text."""
        df = df.repartition(n, "bucket").mapInArrow(lambda x: _dealt((shared(*g) for g in _met(x, *types)), buckets), "bucket int, a binary, b binary")
        return df.repartition(n, "bucket")

    met = meet(docs.select("id", "text").mapInArrow(anchors, "bucket int, a binary, b binary"), np.uint64, np.int64, shared=_shared_anchors)
    lists = _kept(met.mapInArrow(lambda x: by_text(x, np.uint64, lambda v: np.unique(v).tobytes(), "found", pa.binary()), "id long, found binary"), folder, "anchors")
    texts = _texts(docs.withColumnRenamed("id", "key"), lists.withColumnRenamed("id", "key")).select("key", "copies", "found", "text")
    met = meet(texts.mapInArrow(candidates, "bucket int, a binary, b binary, c binary"), np.uint64, np.int64, np.uint32, shared=_shared_runs)
    out = _kept(met.mapInArrow(lambda x: by_text(x, np.uint32, covered, "n_shared_words", pa.int64()), "id long, n_shared_words long"), folder, "counts")
    released(spark)
    return out


def audited(docs: DataFrame) -> DataFrame:
    """As repeats.digested, with n_shared_words."""
    rows = keyed(docs)
    shared = shared_words(rows.select(F.xxhash64("key").alias("id"), "text"))
    digests = _digests(rows).withColumn("id", F.xxhash64("key")).drop("key")
    return digests.join(shared, "id", "left").drop("id").withColumn("n_shared_words", F.coalesce("n_shared_words", F.lit(0)).cast("long"))
