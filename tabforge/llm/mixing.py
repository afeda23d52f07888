"""Operator 5, mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent a, normalised over the sources. a = 1 keeps the shares, a = 0
makes all equal, so entropy grows and the most repeated source repeats more as a falls. The exponent is bisected to the
target: an entropy (as a share of the largest possible; by default halfway between that of the shares and the largest),
and a limit on how often a source may repeat, which wins where the two disagree.

The weights are realised within a budget of tokens. A source's quota is its weight times the budget. Its documents lie in
blocks by a hash of id and text, and each pass (epoch) visits the blocks in an order of its own, a keyed permutation, and
the documents of a block in keyed order. All passes but the last are whole; the last takes whole blocks in its order while
they fit and then, from the block at the edge, documents in order while they fit. So a source misses its quota by less than
one document, and every copy has a place: epoch, the block's place in it, the document's place in the block.

Only sums per source and per block travel: tokens per block are added up, then per range of the last pass's order
(`RANGES` a source). Running sums find the range at the edge, then the block in it, so no task orders all blocks of a
source. The number of sources is bounded by a checked parameter, `MAX_SOURCES`; the weights are found on the driver from
one row a source.

Defined cases: a null source is a source of its own; a null or empty text has no tokens and comes with each whole pass and
with the part of the last one that it stands in; rows that repeat an id count each, and rows of equal id and text share a
block; a null id is an id like others; without tokens at all every row comes once; an empty table gives an empty result.
Further columns pass through `mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import WORD, checkpoint

MAX_SOURCES = 100_000
RANGES = 4096
BLOCK_DOCUMENTS = 256


def weights(shares: dict, exponent: float) -> dict:
    """Normalised powers of the shares; a share of zero stays zero."""
    top = max(shares.values(), default=0)
    raised = {k: (v / top) ** exponent if v else 0.0 for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total else raised


def entropy(w: dict) -> float:
    """As a share of the largest entropy over as many sources."""
    used = [v for v in w.values() if v > 0]
    return -sum(v * math.log(v) for v in used) / math.log(len(used)) if len(used) > 1 else 1.0


def bisect_exponent(tokens: dict, budget: float, target_entropy: float | None = None, most_repeats: float | None = 4.0) -> float:
    """The largest exponent in [0, 1] that reaches the entropy, raised to the smallest that keeps every source within most_repeats.

    If not even the shares themselves (exponent 1) keep the limit, 1 is the answer, as no temperature of at least one could do better.
    """
    total = sum(tokens.values())
    shares = {k: v / total for k, v in tokens.items()} if total else {}

    def edge(ok, good: float, bad: float) -> float:
        """The place nearest to bad where ok still holds, which it does at good and not beyond one threshold."""
        if ok(bad):
            return bad
        for _ in range(60):
            mid = (good + bad) / 2
            good, bad = (mid, bad) if ok(mid) else (good, mid)
        return good

    if not shares:
        return 1.0
    target = (1 + entropy(shares)) / 2 if target_entropy is None else target_entropy
    exponent = edge(lambda a: entropy(weights(shares, a)) >= target, 0.0, 1.0)
    if most_repeats is not None:
        repeats = lambda a: max(budget * w / tokens[k] for k, w in weights(shares, a).items() if tokens[k])
        exponent = max(exponent, edge(lambda a: repeats(a) <= most_repeats, 1.0, 0.0) if repeats(1.0) <= most_repeats else 1.0)
    return exponent


def source_plan(rows: DataFrame, budget: int | None, target_entropy: float | None, most_repeats: float | None, block_documents: int, seed: int) -> DataFrame:
    """One row a source: blocks, whole passes, weight, and where its last pass ends: the block at the edge, its place in the order and the room left in it.

    rows: __mix_source, __mix_h (hash of id and text) and __mix_n (tokens).
    """
    spark = rows.sparkSession
    counted = rows.groupBy("__mix_source").agg(F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    count = {r["__mix_source"]: -(-r["rows"] // block_documents) for r in counted}
    sizes = spark.createDataFrame(list(count.items()), "__mix_name string, __mix_blocks long")
    blocks = checkpoint(with_block(rows, sizes).groupBy("__mix_source", "__mix_block").agg(F.sum("__mix_n").alias("__mix_tokens")))
    per = {r["__mix_source"]: int(r["n"]) for r in blocks.groupBy("__mix_source").agg(F.sum("__mix_tokens").alias("n")).collect()}
    total = sum(per.values())
    budget = total if budget is None else budget
    w = weights({k: v / total for k, v in per.items()}, bisect_exponent(per, budget, target_entropy, most_repeats)) if total else {}
    passes = {k: divmod(int(w[k] * budget), n) if n else (1, 0) for k, n in per.items()}
    edges = _edges(blocks, {k: x for k, x in passes.items() if x[1]}, seed)
    lines = [(k, count[k], passes[k][0], float(w.get(k, 0.0)), *edges.get(k, (None, None, None))) for k in per]
    return spark.createDataFrame(lines, "__mix_name string, __mix_blocks long, __mix_full long, __mix_weight double, __mix_edge_order long, __mix_edge_block long, __mix_room long")


def _edges(blocks: DataFrame, passes: dict, seed: int) -> dict:
    """Place, block and room of the block at the edge of the last pass of each source: a range of places is found first, then the block."""
    if not passes:
        return {}
    spark, source = blocks.sparkSession, F.col("__mix_source").eqNullSafe(F.col("__mix_name"))
    named = spark.createDataFrame([(k, *x) for k, x in passes.items()], "__mix_name string, __mix_full long, __mix_rest long")
    ordered = blocks.join(F.broadcast(named), source).withColumn("__mix_order", block_order(seed, F.col("__mix_full")))
    ordered = ordered.withColumn("__mix_range", F.shiftright("__mix_order", 64 - (RANGES.bit_length() - 1)))

    def at_edge(rows: DataFrame, *by: str) -> DataFrame:
        end = F.sum("__mix_tokens").over(Window.partitionBy("__mix_source").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("__mix_end", end)
        return rows.where((F.col("__mix_end") > F.col("__mix_rest")) & (F.col("__mix_end") - F.col("__mix_tokens") <= F.col("__mix_rest"))).withColumn("__mix_room", F.col("__mix_rest") - F.col("__mix_end") + F.col("__mix_tokens"))

    ranges = at_edge(ordered.groupBy("__mix_source", "__mix_range", "__mix_rest").agg(F.sum("__mix_tokens").alias("__mix_tokens")), "__mix_range").collect()
    inside = spark.createDataFrame([(r["__mix_source"], r["__mix_range"], r["__mix_room"]) for r in ranges], "__mix_name string, __mix_range long, __mix_rest long")
    within = ordered.drop("__mix_rest", "__mix_name").join(F.broadcast(inside), ["__mix_range"]).where(source)
    return {r["__mix_source"]: (r["__mix_order"], r["__mix_block"], r["__mix_room"]) for r in at_edge(within, "__mix_order", "__mix_block").collect()}


def block_order(seed: int, epoch: Column) -> Column:
    """Place of a block in a pass of its source."""
    return F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("__mix_source"), F.col("__mix_block"))


def with_block(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with the columns of sizes (at most MAX_SOURCES rows, broadcast) and __mix_block."""
    return rows.join(F.broadcast(sizes), F.col("__mix_source").eqNullSafe(F.col("__mix_name"))).withColumn("__mix_block", F.pmod(F.col("__mix_h"), F.col("__mix_blocks")))


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, most_repeats: float | None = 4.0, block_documents: int = BLOCK_DOCUMENTS, seed: int = 17, text: str = "text", source: str = "source", keep_place: bool = False) -> DataFrame:
    """docs, each row as often as its source's passes reach it (maybe never).

    budget: tokens in all, by default as many as docs has. With keep_place the columns epoch (from 0), block, block_place,
    place and weight follow: within a source, copies are ordered by epoch, block_place, block and place. Only documents of
    the blocks at an edge are shuffled.
    """
    words = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")
    own = docs.withColumn("__mix_source", F.col(f"`{source}`").cast("string")).withColumn("__mix_h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(f"`{text}`")))
    plan = source_plan(own.select("__mix_source", "__mix_h", words.alias("__mix_n")), budget, target_entropy, most_repeats, block_documents, seed)
    placed = with_block(own, plan).withColumn("__mix_order", block_order(seed, F.col("__mix_full")))
    at_edge = F.coalesce((F.col("__mix_order") == F.col("__mix_edge_order")) & (F.col("__mix_block") == F.col("__mix_edge_block")), F.lit(False))
    before = F.coalesce((F.col("__mix_order") < F.col("__mix_edge_order")) | ((F.col("__mix_order") == F.col("__mix_edge_order")) & (F.col("__mix_block") < F.col("__mix_edge_block"))), F.lit(False))
    whole = placed.where(~at_edge).withColumn("__mix_passes", F.col("__mix_full") + before.cast("long"))
    keyed = Window.partitionBy("__mix_source").orderBy(_place(seed, F.col("__mix_full")), "doc_id", "__mix_h").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(at_edge).withColumn("__mix_passes", F.col("__mix_full") + (F.sum(words).over(keyed) <= F.col("__mix_room")).cast("long"))
    out = whole.unionByName(edge).where("__mix_passes > 0").withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0), F.col("__mix_passes").cast("int") - 1)))
    epoch = F.col("__mix_epoch")
    place = [epoch.alias("epoch"), F.col("__mix_block").alias("block"), block_order(seed, epoch).alias("block_place"), _place(seed, epoch).alias("place"), F.col("__mix_weight").alias("weight")] if keep_place else []
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *place)


def _place(seed: int, epoch: Column) -> Column:
    """Place of a document within its block in a pass."""
    return F.xxhash64(F.lit(seed + 1), epoch.cast("long"), F.col("__mix_h"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, epoch, block, their places and its source's weight for every copy in the mixture."""
    return mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), keep_place=True).drop("text")
