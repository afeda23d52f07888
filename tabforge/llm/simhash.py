"""Operator 4, near-duplicates by SimHash: fingerprints link where they differ in few bits, found with BK-trees.

Equal fingerprints become one node first, so thousands of copies cost one row. The nodes are dealt to shards by the
pigeonhole rule: cut 64 bits into b blocks; two fingerprints with at most r differing bits agree on b - r whole blocks,
so each node goes to one shard for every choice of b - r blocks (b grows with the number of nodes until a shard of
unrelated nodes is small; no b loses a link). Each shard is a BK-tree: children keyed by the integer Hamming distance to
their parent, and a search follows only edges within the radius of the distance at hand. A shard of more than `SHARD`
nodes is cut into that many parts, and each tree is sent to the parts that ask it. Trees are not broadcast whole: that
would gather all fingerprints on the driver.

A shard hands on a spanning forest of its links, never all pairs; the links meet in distributed connected components.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words than a shingle make one
shingle; repeated rows share a component; an empty table gives an empty result; a null doc_id takes its group's smallest
id, null if there is none. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import checkpoint, text_slices
from tabforge.llm.graph import components

SHARD = 4096


def fingerprint(text: bytes, words_each: int = 4) -> int:
    """SimHash of the XXH64 (seed 42) of all word shingles; A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_each:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    else:
        joined = b" ".join(words)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.concatenate([[0], end[:-words_each] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(start.tolist(), end[words_each - 1 :].tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    counts = np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(bits), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for part, texts in text_slices(batches):
            prints = np.array([fingerprint(x, words_each) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A node is [value, {distance: child}]."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (value ^ node[0]).bit_count():
            if (child := node[1].get(d)) is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, open_ = [], [self.root] if self.root else []
        while open_:
            at, children = open_.pop()
            d = (value ^ at).bit_count()
            if d <= radius:
                found.append(at)
            if children:
                if len(children) > 2 * radius + 1:
                    open_.extend(c for e in range(d - radius, d + radius + 1) if (c := children.get(e)))
                else:
                    open_.extend(c for e, c in children.items() if d - radius <= e <= d + radius)
        return found


def _forest(shard: list[tuple[int, int]], radius: int, one_part: bool) -> list[tuple[int, int]]:
    """Links that join what they meet for the first time. shard: (part, fingerprint), unsigned."""
    tree, link, out = BKTree(), {}, []

    def top(x: int) -> int:
        while (y := link.get(x, x)) != x:
            link[x] = x = link.get(y, y)
        return x

    last = max(p for p, _ in shard)
    if not one_part:
        for p, x in shard:
            if p == last:
                tree.add(x)
    for p, x in shard:
        if one_part or p != last:
            for y in tree.within(x, radius):
                if (a := top(x)) != (b := top(y)):
                    link[a] = b
                    out.append((x, y))
            if one_part:
                tree.add(x)
    return out


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of the shards in rows sorted by shard (k, v, i, j)."""
    key, shard, out = None, [], []

    def ended() -> None:
        if len(shard) > 1:
            out.extend(_forest(shard, radius, key[2] == key[3]))

    for batch in batches:
        for *now, part, fp in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if key is not None:
                    ended()
                key, shard = now, []
            shard.append((part, fp & 0xFFFFFFFFFFFFFFFF))
        if out:
            yield _edges(out)
            out = []
    if key is not None:
        ended()
        yield _edges(out)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _masks(nodes: int, radius: int) -> list[int]:
    """Bit masks of the choices of whole blocks on which linked fingerprints agree."""
    blocks = radius + 1
    while nodes / 2 ** (64 * (blocks - radius) / blocks) > 64 and blocks < 2 * radius:
        blocks += 1
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
    return [sum(x) for x in combinations(block, blocks - radius)]


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """u and v: links between distinct fingerprints fp that suffice to join all that are within the radius."""
    masks = _masks(nodes.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("k", "v"))
    sizes = keyed.groupBy("k", "v").count().where("count > 1")
    parted = keyed.join(sizes, ["k", "v"]).withColumn("m", F.ceil(F.col("count") / SHARD).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    paired = parted.select("k", "v", "part", "fp", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    rows = paired.select("k", "v", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "fp")
    return rows.repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j", "fp").mapInArrow(lambda b: _search(b, radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, words_each: int = 4) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row."""
    prints = checkpoint(fingerprints(docs, words_each))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = checkpoint(components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp"))
    joined = roots.join(nodes, "fp")
    least = joined.groupBy("root").agg(F.min("doc_id").alias("least"))
    named = joined.join(least, "root").select("fp", "least")
    # both sides of the last join stand on their own, so that Spark can split the rows of a fingerprint that many documents share
    whole = checkpoint(nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "doc_id").alias("component_id")))
    return prints.join(whole, "fp").select("doc_id", "fp", "component_id")


def components_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
