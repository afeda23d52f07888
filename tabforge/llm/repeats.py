"""Operator 10, suffix-array dedup with a run-length index: bytes that lie in a string of LENGTH bytes that starts elsewhere, too.

Candidates. Of the `LENGTH - GRAM + 1` byte runs of GRAM bytes inside each string of LENGTH bytes the one of the least
rolling hash is its anchor, so equal strings have equal anchors at equal offsets. Only strings whose anchor occurs at least
twice in the corpus go on. Those of one anchor are taken in blocks of `BLOCK` neighbouring starts; all strings of a block
hold the same core of `LENGTH - BLOCK + 1` bytes, and two equal strings always have equal cores. So a group is a core, and
a member of it is what stands left and right of the core: at most `2 * (BLOCK - 1)` bytes. Equal members are counted and
travel once; a passage that a third of all documents share is one core with few distinct members.

Index. Whole groups are packed into index texts of about `INDEX_SYMBOLS` symbols, in which one symbol stands for the core.
Each text's suffixes are ordered by prefix doubling and its Burrows-Wheeler transform is cut into runs; suffix positions
are sampled at the heads and ends of runs, with the length of the match to the neighbour before (heads) or after (ends).
All other matching statistics follow from the nearest sample to the left, as a match shrinks by one with each symbol
inside a run; they are streamed over the text, and strings whose match spans the whole string are marked. A member that
occurs more than once stands in the text twice.

A group of more than `MEMBERS` distinct members would not fit an index text; its strings are counted by a 128-bit hash
each instead, which is exact up to collisions and splits the group over the cluster.

Defined cases: a null text counts as empty; texts shorter than LENGTH keep all bytes; repeated rows remove each other
whole (if long enough) and are indexed once; an empty table gives an empty result; a null doc_id is kept. Only `doc_id`
and `text` are read; positions are bytes of the UTF-8 text; a text may have 2**31 - 1 bytes, as many as Spark holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import shared_dir, text_slices

LENGTH, GRAM, BLOCK = 400, 25, 47
INDEX_SYMBOLS, MEMBERS = 1 << 20, 20_000
FEW_KEYS = 1 << 19
SEGMENT = 1 << 22  # starts of strings in a long text that are worked on at once
SPAN = LENGTH - GRAM + 1  # starts of strings that hold an anchor
_BASE = 0x100000001B3


def _power(e: int) -> np.uint64:
    return np.uint64(pow(_BASE, e, 1 << 64))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last start of the strings that it stands for; `SEGMENT` starts at a time."""
    starts = len(text) - LENGTH + 1
    if starts < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    found = [[x + a * (i > 0) for i, x in enumerate(_anchors(text[a : a + SEGMENT + LENGTH - 1]))] for a in range(0, starts, SEGMENT)]
    h, place, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.append(True, place[1:] != place[:-1])  # an anchor on both sides of a segment's edge is one
    return h[new], place[new], first[new], last[np.append(np.flatnonzero(new)[1:], len(new)) - 1]


def _anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(text)
    one = (np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    # polynomial hash of GRAM = 25 = 16 + 8 + 1 bytes from those of powers of two
    h = {1: one}
    for s in (1, 2, 4, 8):
        h[2 * s] = h[s][:-s] * _power(s) + h[s][s:]
    size = len(one) - GRAM + 1
    hashed = (h[16][:size] * _power(8) + h[8][16 : 16 + size]) * _power(1) + one[24 : 24 + size]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    low = np.uint64(28)  # places in a segment; of equal hashes the leftmost is chosen
    least = (hashed >> low << low) | np.arange(size, dtype=np.uint64)
    step = 1
    while step * 2 <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    starts = n - LENGTH + 1
    least = np.minimum(least[:starts], least[SPAN - step : SPAN - step + starts])
    place = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return hashed[place[first]], place[first], first, np.append(first[1:], starts) - 1


def _spots(docs: DataFrame) -> DataFrame:
    """key, h, n and spots (place, first, last as int32) of the anchors of each row."""

    def run(batches):
        for part, texts in text_slices(batches):
            keys, hs, ns, spots = [], [], [], []
            for key, text in zip(part.column(0).to_pylist(), texts):
                h, a, lo, hi = anchors(text)
                if len(h):
                    order = np.argsort(h, kind="stable")
                    data = np.stack([a, lo, hi], 1)[order].astype(np.int32)
                    own, head = np.unique(h[order], return_index=True)
                    for x, p, q in zip(own.view(np.int64).tolist(), head.tolist(), [*head[1:].tolist(), len(h)]):
                        keys.append(key)
                        hs.append(x)
                        ns.append(q - p)
                        spots.append(data[p:q].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hs, pa.int64()), pa.array(ns, pa.int64()), pa.array(spots, pa.binary())], ["key", "h", "n", "spots"])

    return docs.select("key", "text").mapInArrow(run, "key binary, h long, n long, spots binary")


def members_of(text: bytes, spots: np.ndarray) -> dict[tuple[bytes, bytes], list[int]]:
    """First starts of the strings of each (core, wings) around the anchors in spots (place, first, last)."""
    out: dict[tuple[bytes, bytes], list[int]] = {}
    digest = xxhash.xxh3_128_digest
    for a, lo, hi in spots.tolist():
        for b in range((a - hi) // BLOCK, (a - lo) // BLOCK + 1):
            last = a - b * BLOCK
            first = max(last - BLOCK + 1, a - SPAN + 1)
            p, q = max(first, lo), min(last, hi)
            left, right = text[p:last], text[first + LENGTH : q + LENGTH]
            out.setdefault((digest(text[last : first + LENGTH]), bytes([len(left), last - first]) + left + right), []).append(p)
    return out


def _members(rows: DataFrame) -> DataFrame:
    """key, core, wing (a digest), wings, starts and n (occurrences in all copies of the text)."""

    def run(batches):
        for part, texts in text_slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            for key, copies, lists, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts):
                for (core, wings), starts in members_of(text, np.frombuffer(b"".join(lists), np.int32).reshape(-1, 3)).items():
                    for c, x in zip(cols, (key, core, xxhash.xxh3_128_digest(wings), wings, starts, copies * len(starts))):
                        c.append(x)
            types = (pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "core", "wing", "wings", "starts", "n"])

    return rows.select("key", "copies", "spots", "text").mapInArrow(run, "key binary, core binary, wing binary, wings binary, starts array<int>, n long")


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text of symbols below 2**16, with suffixes sampled at heads and ends of runs.

    parts: first places of parts of the text; a sample is taken at each, so no statistic runs over a part's edge.
    """

    def __init__(self, text: np.ndarray, parts: np.ndarray):
        n = self.n = len(text)
        padded = np.concatenate([text, np.zeros(256, text.dtype)]).astype(np.uint64)
        key = padded[:n] << np.uint64(48) | padded[1 : n + 1] << np.uint64(32) | padded[2 : n + 2] << np.uint64(16) | padded[3 : n + 3]
        # equal prefixes may stand in any order: their match is as long as any that counts
        order = np.argsort(key)
        head = np.empty(n, bool)
        head[:1] = True
        head[1:] = key[order[1:]] != key[order[:-1]]
        self.levels: list[tuple[int, np.ndarray]] = []
        width = 4
        while True:
            rank = np.empty(n + 256, np.int32)
            rank[n:] = -1
            rank[order] = np.cumsum(head)
            self.levels.append((width, rank))
            open_ = np.flatnonzero(~(head & np.append(head[1:], True)))  # places in order whose prefix is not alone
            if width >= 128 or not len(open_):
                break
            at = order[open_]
            key = rank[at].astype(np.uint64) << np.uint64(32) | (rank[at + width].astype(np.int64) + 1).astype(np.uint64)
            by = np.argsort(key)
            order[open_] = at[by]
            key = key[by]
            head[open_[1:]] |= key[1:] != key[:-1]
            width *= 2
        self.text, self.order = padded, order
        before = np.where(order > 0, text[order - 1], -1)
        part = np.zeros(n + 1, bool)
        part[parts] = True
        new = np.empty(n + 1, bool)
        new[0] = new[n] = True
        new[1:n] = (before[1:] != before[:-1]) | part[order[1:]] | part[order[:-1]]
        heads, ends = np.flatnonzero(new[:n]), np.flatnonzero(new[1:])
        self.runs = len(heads)
        self.run_symbol, self.run_length = before[heads], np.diff(np.append(heads, n))
        self.head_at, self.head_match = self._sampled(heads, heads - 1)
        self.end_at, self.end_match = self._sampled(ends, ends + 1)

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, up to 255."""
        out = np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels):
            same = rank[np.minimum(a + out, self.n)] == rank[np.minimum(b + out, self.n)]
            same &= (a + out < self.n) & (b + out < self.n)
            out += width * same
        for _ in range(3):
            out += (self.text[a + out] == self.text[b + out]) & (a + out < self.n) & (b + out < self.n)
        return out

    def _sampled(self, at: np.ndarray, neighbour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled suffixes in the order of the text, each with its match to the neighbour in suffix order."""
        inside = (neighbour >= 0) & (neighbour < self.n)
        match = np.zeros(len(at), np.int64)
        match[inside] = self._match(self.order[at[inside]], self.order[neighbour[inside]])
        place = self.order[at]
        by_place = np.argsort(place)
        return place[by_place], match[by_place]

    def statistics(self) -> np.ndarray:
        """At each place of the text the longest match that starts at another place, streamed from the samples (up to 255 symbols)."""
        out = np.zeros(self.n, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.end_at, self.end_match)):
            run = np.diff(np.append(at, self.n))
            np.maximum(out[at[0] :], np.repeat(match, run) - (np.arange(at[0], self.n) - np.repeat(at, run)), out=out[at[0] :])
        return out


def marked(members: list[tuple[bytes, bytes, bytes, int]]) -> list[tuple[bytes, bytes, int]]:
    """(core, wing, mask) from (core, wing, wings, n), sorted by core: bit i says that the i-th string of the member starts elsewhere, too."""
    groups = {c: i for i, c in enumerate(dict.fromkeys(m[0] for m in members))}
    pieces, start, at = [], [], 0
    for core, _, wings, n in members:
        left = wings[0]
        one = np.empty(len(wings), np.int32)  # left, the core's symbol, right, an end: two bytes of wings are numbers
        body = np.frombuffer(wings, np.uint8)[2:].astype(np.int32) + 1
        one[:left], one[left], one[left + 1 : -1], one[-1] = body[:left], 257 + groups[core], body[left:], 0
        start.append(at)
        for _ in range(2 if n > 1 else 1):
            pieces.append(one)
            at += len(one)
    text = np.concatenate(pieces)
    parts = np.flatnonzero(np.concatenate([[True], text[:-1] == 0]))
    longest = RunIndex(text, parts).statistics()
    out = []
    for (core, wing, wings, _), a in zip(members, start):
        span = wings[1] + 1
        hit = longest[a : a + len(wings) - 1 - span + 1] >= span
        if hit.any():
            out.append((core, wing, int.from_bytes(np.packbits(hit, bitorder="little").tobytes(), "little")))
    return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indexes whole groups of rows sorted by core, some groups at a time."""
    group, pack, size, groups, core = [], [], 0, 0, None

    def emit(rows):
        found = marked(rows)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else ([], [], []), (pa.binary(), pa.binary(), pa.int64()))], ["core", "wing", "mask"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != core:
                pack += group
                group, core, groups = [], row[0], groups + 1
                if size > INDEX_SYMBOLS or groups > 60_000:
                    yield emit(pack)
                    pack, size, groups = [], 0, 1
            group.append(row)
            size += len(row[2]) * (2 if row[3] > 1 else 1)
    if pack or group:
        yield emit(pack + group)


def _counted(hot: DataFrame) -> DataFrame:
    """Masks of members of groups too large for an index text, by counting each string."""

    def run(batches):
        for batch in batches:
            out = []
            for core, wing, wings, n in zip(*(c.to_pylist() for c in batch.columns)):
                body, left, span = wings[2:], wings[0], wings[1]
                for i in range(len(body) - span + 1):
                    out.append((core, wing, i, xxhash.xxh3_128_digest(bytes([max(0, left - i)]) + body[i : i + span]), n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()))], ["core", "wing", "i", "string", "n"])

    strings = hot.mapInArrow(run, "core binary, wing binary, i int, string binary, n long")
    often = strings.groupBy("core", "string").agg(F.sum("n").alias("t")).where("t > 1").select("core", "string")
    return strings.join(often, ["core", "string"]).groupBy("core", "wing").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))


def removed(text: bytes, starts: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, their maximal runs, and what is kept, if a string of LENGTH bytes goes at each of starts."""
    edge = np.zeros(len(text) + 1, np.int64)
    starts = np.unique(starts)
    edge[starts] += 1
    np.add.at(edge, starts + LENGTH, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _cut(rows: DataFrame) -> DataFrame:
    """key, n_removed, n_spans and kept of texts with marks (starts, mask)."""

    def run(batches):
        for part, texts in text_slices(batches):
            cols: list[list] = [[], [], [], []]
            for key, marks, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                at = [np.add.outer(np.array(m["starts"], np.int64), np.flatnonzero(np.unpackbits(np.frombuffer(m["mask"].to_bytes(8, "little"), np.uint8), bitorder="little"))).ravel() for m in marks]
                for c, x in zip(cols, (key, *removed(text, np.concatenate(at)))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["key", "n_removed", "n_spans", "kept"])

    return rows.select("key", "marks", "text").mapInArrow(run, "key binary, n_removed long, n_spans long, kept binary")


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that what follows does not compute it anew."""
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, text, copies and the columns of wanted (one row a key) of each distinct text in wanted.

    Up to FEW_KEYS keys (16 bytes each) are broadcast first, so that only wanted texts are shuffled; beyond that the join
    alone selects them.
    """
    if wanted.count() <= FEW_KEYS:
        docs = docs.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    return docs.groupBy("key").agg(F.min("text").alias("text"), F.count("*").alias("copies")).join(wanted, "key")


def marks(docs: DataFrame) -> DataFrame:
    """key, text and marks (starts and mask) of each distinct text with a string that starts elsewhere, too. docs: key and text."""
    folder = f"{shared_dir(docs.sparkSession)}/repeats-{uuid.uuid4().hex}"
    spots = _kept(_spots(docs), folder, "spots")
    # on its own, so that Spark can split the rows of an anchor that many texts share
    often = _kept(spots.groupBy("h").agg(F.sum("n").alias("t")).where("t > 1").select("h"), folder, "often")
    lists = _kept(spots.join(often, "h").groupBy("key").agg(F.collect_set("spots").alias("spots")), folder, "lists")
    found = _kept(_members(_texts(docs, lists)), folder, "members")
    distinct = found.groupBy("core", "wing").agg(F.min("wings").alias("wings"), F.sum("n").alias("n"))
    groups = found.groupBy("core").agg(F.sum("n").alias("t"), F.approx_count_distinct("wing").alias("members")).where("t > 1")
    rows = distinct.join(groups, "core").select("core", "wing", "wings", "n", (F.col("members") > MEMBERS).alias("hot"))
    small = rows.where("not hot").drop("hot").repartition("core").sortWithinPartitions("core", "wing").mapInArrow(_indexed, "core binary, wing binary, mask long")
    masks = small.unionByName(_counted(rows.where("hot").drop("hot")))
    by_text = _kept(found.select("key", "core", "wing", "starts").join(masks, ["core", "wing"]).groupBy("key").agg(F.collect_list(F.struct("starts", "mask")).alias("marks")), folder, "marks")
    return _texts(docs, by_text)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary; null where nothing is removed) of every row."""
    rows = keyed(docs)
    cut = _cut(marks(rows.select("key", "text")))
    return rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes")).join(cut, "key", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), "kept")


def digested(docs: DataFrame) -> DataFrame:
    """As deduplicated, with the SHA-256 of what is kept."""
    return _digests(keyed(docs)).drop("key")


def _digests(rows: DataFrame) -> DataFrame:
    cut = _cut(marks(rows.select("key", "text"))).select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    whole = rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    return whole.join(cut, "key", "left").select("key", "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
