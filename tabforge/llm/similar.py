"""Near-duplicates by SimHash, for the pipeline: documents link where the Jaccard similarity of their sets of five-word
shingles is 0.8 or more, and one document of each connected group stays.

The shingles' hashes vote on `WORDS` words of 64 bits. The majorities of the first two words are the fingerprint: unrelated
ones differ in 64 +- 6 bits, those at 0.8 in 19 +- 4, and a candidate in `RADIUS` or fewer. Fingerprints are dealt by bits
of SimHash, too: not by bits at fixed places, of which two near sets often differ in one, but by the place and the value of
the bit that the votes decide most clearly, in the words that a table names (two words a table, 14 bits; three for more
nodes than `WIDE`). At 0.8 a word's clearest bit agrees with probability 0.44, so that such a pair meets in one of the tables
with 0.9993 and one at 0.85 with 0.9999 (three words: 0.993 and 0.999), by simulation. Every candidate is confirmed by the exact similarity of the sets.

What SimHash misses is found by the exact join of `ngram_join`, which takes these links as known: it looks only between sets
that they do not join. So the groups are those of all pairs, whatever the number of nodes.

Equal sets become one node first. A bucket's candidates are found inside a task where they are few. Crowded buckets (more
than `PART` members, or more than `PAIRS` candidates a member) first ask only for their members' links to the least one, one
link a member. Pairs whose ends confirmed links join need no look any more, so a large group of near copies never asks for
all its pairs, and a bucket of one group is done. Buckets with the same largest group then become one home, which holds each
member once, however many tables they met in. Its stragglers (members that are not in the largest group) ask for the closest
of `PIVOTS` members of that group. What is left, stragglers against each other and against the rest of their home, is compared
in blocks inside tasks, which hand on links that join groups.

Defined cases: A-Z count as a-z; a null or empty text has the empty set, and such texts are equal; fewer words than a
shingle make one shingle; rows without an id link like others and stay; rows that repeat an id with another text are documents
of their own; equal rows are near-duplicates; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import Words, checkpoint, released, stored, text_slices
from tabforge.llm.graph import components

WORDS = 32
RADIUS = 40
WIDE = 1 << 22
PIVOTS, PART, PAIRS = 4, 1024, 4
_ODD = np.random.default_rng(17).integers(0, 1 << 63, WORDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], words_each: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, end to end, and where each text's begin."""
    w = Words(texts)
    n = np.diff(w.first)
    count = np.where(n == 0, 0, np.maximum(n - words_each + 1, 1))
    text = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][text]
    last = w.first[1:][text]
    h = np.zeros(len(text), np.uint64)
    for k in range(words_each):
        at = start + k
        inside = at < last  # only a text shorter than a shingle ends before
        h = np.where(inside, _mixed(h * _MIX + (w.hash[np.minimum(at, max(len(w) - 1, 0))] if len(w) else 0)), h)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def _sid(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each set: equal sets have equal ones."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return _mixed((total[first[1:]] - total[first[:-1]]) * _MIX + np.diff(first).astype(np.uint64)).view(np.int64)


def _votes(sets: np.ndarray) -> np.ndarray:
    """Of each bit of each word, the ones less the zeros among the shingles' hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for a in range(0, len(sets), 255):
        y = sets[a : a + 255, None] * _ODD
        y ^= y >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(y.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (2 * ones - len(sets)).reshape(WORDS, 64)


def _simhash(votes: np.ndarray) -> tuple[int, int]:
    """The majorities of the first two words."""
    return tuple(np.packbits(votes[:2] > 0, axis=1, bitorder="little").view(np.int64).ravel().tolist())


def _clearest(votes: np.ndarray) -> bytes:
    """Place and value of the bit that is decided most clearly, of each word."""
    size = np.abs(votes)
    at = size.argmax(1)
    return (at * 2 + (votes[np.arange(WORDS), at] > 0)).astype(np.uint8).tobytes()


def tables(nodes: int) -> np.ndarray:
    """Numbers of the words whose clearest bits are a key, a row a table; more words for more nodes, so that buckets of unrelated ones stay small."""
    steps = [(0, 1), (0, 7)] if nodes <= WIDE else [(0, 1, 5), (0, 2, 12), (0, 3, 11), (0, 6, 13)]
    return (np.array(steps)[:, None] + np.arange(WORDS)[:, None]).reshape(-1, len(steps[0])) % WORDS


def prints(docs: DataFrame, words_each: int = 5) -> DataFrame:
    """doc_id, t (hash of the text), sid, f0 and f1 (fingerprint) and clear (clearest bits; none for the empty set) of every row."""

    def run(batches):
        for part, texts in text_slices(batches):
            sets, first = shingle_sets(texts, words_each)
            votes = [_votes(sets[a:b]) for a, b in zip(first[:-1], first[1:])]
            fp = np.array([_simhash(x) for x in votes], np.int64).reshape(-1, 2)
            clear = pa.array([_clearest(x) if b > a else b"" for x, a, b in zip(votes, first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_sid(sets, first)), pa.array(fp[:, 0]), pa.array(fp[:, 1]), clear], ["doc_id", "t", "sid", "f0", "f1", "clear"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(run, "doc_id long, t long, sid long, f0 long, f1 long, clear binary")


def dealt(nodes: DataFrame, words: np.ndarray) -> DataFrame:
    """key, sid, f0 and f1 of every node in every table."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array([len(x.as_buffer()) > 0 for x in batch.column(3)], pa.bool_()))
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                clear = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, WORDS).astype(np.int64)
                key = np.broadcast_to(np.arange(len(words)), (len(part), len(words)))
                for w in words.T:
                    key = key * 128 + clear[:, w]
                same = [pa.array(np.repeat(c.to_numpy(zero_copy_only=False), len(words))) for c in part.columns[:3]]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *same], ["key", "sid", "f0", "f1"])

    return nodes.select("sid", "f0", "f1", "clear").mapInArrow(run, "key long, sid long, f0 long, f1 long")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; the last axis holds f0 and f1."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(-1, dtype=np.int64)


_NEAR = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("sids", pa.list_(pa.int64())), ("star", pa.list_(pa.int64()))])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs u, v within the radius of the buckets in rows sorted by key; a bucket with too many gives one row: key, u (its least
    member), sids (its members) and star (those within the radius of the least)."""
    carried = None

    def pairs(rows: np.ndarray):
        out, crowded = [], []
        cut = [0, *(np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1).tolist(), len(rows)]
        for a, b in zip(cut, cut[1:]):
            if b - a < 2:
                continue
            sid, f = rows[a:b, 1], rows[a:b, 2:]
            i, j = np.nonzero(np.triu(_apart(f[:, None], f[None]) <= RADIUS, 1))
            if len(i) > PAIRS * (b - a):
                least = sid.argmin()
                crowded.append((rows[a, 0], sid[least], None, sid, sid[(_apart(f, f[least]) <= RADIUS) & (sid != sid[least])]))
            elif len(i):
                out.append(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], 1))
        if out:
            found = np.unique(np.concatenate(out), axis=0)
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(found[:, 0]), pa.array(found[:, 1]), *[pa.nulls(len(found), x.type) for x in list(_NEAR)[3:]]], schema=_NEAR)
        if crowded:
            yield pa.RecordBatch.from_arrays([pa.array(x, y.type) for x, y in zip(zip(*crowded), _NEAR)], schema=_NEAR)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        if not len(rows):
            continue
        rows = rows if carried is None else np.concatenate([carried, rows])
        last = np.searchsorted(rows[:, 0], rows[-1, 0])
        yield from pairs(rows[:last])
        carried = rows[last:]
    if carried is not None:
        yield from pairs(carried)


class _Block:
    """Rows of one block: a straggler part (left) against itself, another one or a part of the bucket's largest group (right)."""

    def __init__(self, rows: np.ndarray, sets: list[np.ndarray] | None = None):
        i, j, part, self.sid, f0, f1, self.group = rows
        self.fp = np.stack([f0, f1], 1)
        self.left, self.right, self.same = np.flatnonzero(part == i[0]), np.flatnonzero(part == j[0]), i[0] == j[0]
        self.sets = sets

    def near(self, a: int) -> np.ndarray:
        """Rows on the right of another group whose fingerprints are within the radius of row a's."""
        b = self.right[self.right > a] if self.same else self.right
        b = b[self.group[b] != self.group[a]]
        return b[_apart(self.fp[b], self.fp[a]) <= RADIUS]

    def candidates(self) -> np.ndarray:
        """Rows with a partner within the radius in another group."""
        met = np.zeros(len(self.sid), bool)
        for a in self.left:
            b = self.near(a)
            met[a] |= len(b) > 0
            met[b] = True
        return np.flatnonzero(met)

    def links(self, similarity: float) -> list[tuple[int, int]]:
        """Pairs with the similarity that join groups not joined before; shared shingles are counted by an inverted index of the right."""
        values, owner = np.concatenate([self.sets[b] for b in self.right]), np.repeat(self.right, [len(self.sets[b]) for b in self.right])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        size, out = np.array([len(x) for x in self.sets]), []
        for a in self.left:
            b = self.near(a)
            if not len(b):
                continue
            low, high = (np.searchsorted(values, self.sets[a], side) for side in ("left", "right"))
            n = high - low
            at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
            both = np.bincount(owner[at], minlength=len(size))[b]
            for c in b[both >= similarity * (size[a] + size[b] - both)]:
                if self.group[c] != self.group[a]:
                    self.group[self.group == self.group[c]] = self.group[a]
                    out.append((int(self.sid[a]), int(self.sid[c])))
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, list]]:
    """(key, i, j), numbers and sets of each block in rows sorted by them: key, i, j, part, sid, f0, f1, group and maybe set."""
    key, held, sets = None, [], []
    for batch in batches:
        if not len(batch):
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:8]])
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(8)] if batch.num_columns > 8 else []
        cut = [0, *(np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1).tolist(), rows.shape[1]]
        for a, b in zip(cut, cut[1:]):
            now = tuple(rows[:3, a].tolist())
            if held and now != key:
                yield key, np.concatenate(held, axis=1), sets
                held, sets = [], []
            key = now
            held.append(rows[:, a:b])
            sets += own[a:b]
    if held:
        yield key, np.concatenate(held, axis=1), sets


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows, _ in _blocks(batches):
        at = _Block(rows[1:]).candidates()
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in rows], _BLOCK)


_BLOCK = ["key", "i", "j", "part", "sid", "f0", "f1", "group"]


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """sid and set (sorted hashes) of the nodes in wanted."""
    texts = docs.select("text", F.xxhash64("text").alias("t")).join(nodes.join(wanted, "sid").select("sid", "t"), "t").groupBy("sid").agg(F.min("text").alias("text"))

    def run(batches):
        for part, texts in text_slices(batches):
            values, first = shingle_sets(texts, words_each)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["sid", "set"])

    return checkpoint(texts.mapInArrow(run, "sid long, set binary"))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs u, v whose sets have the similarity."""

    def keep(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if similarity * max(len(x), len(y)) <= min(len(x), len(y)) else 0
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    one = pairs.distinct().join(sets.select(F.col("sid").alias("u"), F.col("set").alias("x")), "u")
    both = one.join(sets.select(F.col("sid").alias("v"), F.col("set").alias("y")), "v").select("u", "v", "x", "y")
    return checkpoint(both.mapInArrow(keep, "u long, v long"))


def _open(members: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the buckets whose members are not of one group yet: home, the bucket's largest group, sid, its group and its fingerprint, once each."""
    roots = components(links).withColumnRenamed("node", "sid")
    grouped = stored(members.join(roots, "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("group")))
    tops = grouped.groupBy("key", "group").count().groupBy("key").agg(F.max(F.struct("count", "group"))["group"].alias("home"), F.count("*").alias("groups")).where("groups > 1")
    return stored(grouped.join(tops.select("key", "home"), "key").select("home", "sid", "group").distinct().join(nodes.select("sid", "f0", "f1"), "sid"))


def _regrouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (of _open) with the groups that the links make, of homes with more than one; their largest group is top. Columns as _verified has them."""
    roots = components(links).withColumnRenamed("node", "sid")
    grouped = stored(rows.drop("group").join(roots, "sid", "left").select("home", "sid", "f0", "f1", F.coalesce("root", "sid").alias("group")))
    tops = grouped.groupBy("home", "group").count().groupBy("home").agg(F.max(F.struct("count", "group"))["group"].alias("top"), F.count("*").alias("groups")).where("groups > 1")
    return stored(grouped.join(tops.select("home", "top"), "home").withColumnRenamed("home", "key"))


def _verified(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that join the groups in rows (of _regrouped): stragglers, in parts, against each other and against the largest group's parts.

    A block hands on its members with candidates, then, once their sets are there, links that join groups; never pairs.
    """
    stray = F.col("group") != F.col("top")
    counts = rows.groupBy("key").agg(F.ceil(F.count_if(stray) / PART).cast("long").alias("strays"), F.ceil(F.count_if(~stray) / PART).cast("long").alias("rest"))
    hashed = F.xxhash64("sid")
    parted = rows.join(counts, "key").withColumn("part", F.when(stray, F.pmod(hashed, F.col("strays"))).otherwise(F.col("strays") + F.pmod(hashed, F.col("rest"))))
    paired = parted.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.when(stray, F.col("strays") + F.col("rest")).otherwise(F.col("strays")) - 1)))
    blocks = paired.select("key", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), *_BLOCK[3:])
    schema = ", ".join(f"{c} long" for c in _BLOCK)
    near = checkpoint(blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_near, schema))
    whole = near.join(sets, "sid").select(*_BLOCK, "set")

    def join(batches):
        for _, numbers, sets in _blocks(batches):
            if found := _Block(numbers[1:], sets).links(similarity):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["u", "v"])

    return checkpoint(whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(join, "u long, v long"))


def links(docs: DataFrame, nodes: DataFrame, similarity: float = 0.8, words_each: int = 5) -> DataFrame:
    """Confirmed links u, v between sets that join all candidates of the similarity."""
    spark = docs.sparkSession
    keyed = dealt(nodes, tables(nodes.count()))
    crowds = stored(keyed.groupBy("key").count().where(F.col("count") > PART).select("key"))
    small = keyed.join(crowds, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    near = stored(small.mapInArrow(_candidates, "key long, u long, v long, sids array<long>, star array<long>"))
    released(spark)
    pairs = stored(near.where("key is null").select("u", "v").distinct())
    crowded = near.where("key is not null")
    apart = lambda x: sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{x}.{c}"))) for c in ("f0", "f1"))
    large = stored(keyed.join(crowds, "key"))
    large = stored(large.join(large.groupBy("key").agg(F.min(F.struct("sid", "f0", "f1")).alias("least")), "key").select("key", "sid", F.when((F.col("sid") != F.col("least.sid")) & (apart("least") <= RADIUS), F.col("least.sid")).alias("least")))
    members = stored(crowded.select("key", F.explode("sids").alias("sid")).unionByName(large.select("key", "sid")))
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("sid")).unionByName(members.select("sid")).distinct()
    sets = _sets(docs, nodes, wanted, words_each)
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    stars = crowded.select(F.explode("star").alias("sid"), F.col("u").alias("least")).unionByName(large.where("least is not null").select("sid", "least"))
    star = stars.groupBy("sid").agg(F.min("least").alias("least"))
    found = _confirmed(pairs.unionByName(star.select(*pair("sid", "least"))), sets, similarity)
    released(spark)
    rows = _open(members, nodes, found)
    if not rows.take(1):
        return found
    # some members of the largest group stand for it, and each straggler asks for the closest one alone
    slot, order = F.pmod(F.xxhash64("sid"), F.lit(PIVOTS)), F.xxhash64("sid", F.lit(1))
    pivots = rows.where("group = home").groupBy("home", slot.alias("slot")).agg(F.min(F.struct(order.alias("h"), "sid", "f0", "f1")).alias("pivot")).drop("slot")
    asked = rows.where("group <> home").join(pivots, "home").where(apart("pivot") <= RADIUS).groupBy("sid").agg(F.min(F.struct(apart("pivot").alias("apart"), F.col("pivot.sid").alias("sid")))["sid"].alias("pivot"))
    found = checkpoint(found.unionByName(_confirmed(asked.select(*pair("sid", "pivot")), sets, similarity)))
    released(spark)
    rows = _regrouped(rows, found)
    return found.unionByName(_verified(rows, sets, similarity)) if rows.take(1) else found


def keep_one(docs: DataFrame, percent: int = 80, words_each: int = 5) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, and of the rows with this id that of the least text hash. Rows without an id stay, as none can be named for them.

    What goes and stays is decided for rows, by id and text: rows of one id with other texts are documents of their own. Of
    rows that are equal in both, one stays (any one, should they differ in other columns).
    """
    from tabforge.llm import ngram_join  # which takes the sets from here

    found = checkpoint(prints(docs, words_each))
    row = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))).alias("row")
    nodes = checkpoint(found.groupBy("sid").agg(row, F.min("t").alias("t"), *(F.min(c).alias(c) for c in ("f0", "f1", "clear"))))
    near = checkpoint(links(docs, nodes, percent / 100, words_each))
    released(docs.sparkSession)
    near = ngram_join.links(docs, nodes, percent, words_each, known=near)
    roots = checkpoint(components(near).withColumnRenamed("node", "sid"))
    least = nodes.join(roots, "sid", "left").groupBy(F.coalesce("root", "sid")).agg(F.min("row").alias("row")).where("row is not null").select("row.*")
    equal = found.groupBy("doc_id", "t").agg((F.count("*") > 1).alias("repeated"))
    kept = least.join(equal, ["doc_id", "t"]).select(*(F.col(c).alias(f"__kept_{c}") for c in ("doc_id", "t", "repeated")))
    named = docs.join(kept, (docs["doc_id"] == kept["__kept_doc_id"]) & (F.xxhash64(docs["text"]) == kept["__kept_t"]))
    once = named.where("not __kept_repeated").select(*docs.columns)
    # few keys: only ids that stand with an equal text on several rows, and copies meet before the shuffle
    among = named.where("__kept_repeated").groupBy("__kept_doc_id", "__kept_t").agg(F.first(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return once.unionByName(among).unionByName(docs.where(F.col("doc_id").isNull()))
