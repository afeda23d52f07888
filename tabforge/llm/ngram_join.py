"""Operator 12, n-gram Jaccard join: documents link where the Jaccard similarity of their sets of five-word shingles is 0.8
or more; found with adaptive multi-match prefixes.

Equal sets become one node first. All shingles have one global order, the rarest first. Two linked sets share at least
t = ceil(0.8 n) shingles, n being either's size, so their first l common shingles lie in the first n - t + l of both: with
prefixes of that length, at least l prefix shingles are shared. Each document takes the l of the least estimated cost: a longer
prefix costs rows and meets more documents, but a pair counts as a candidate only if it shares as many prefix shingles as the
lesser l of the two, so that fewer sets are compared. The estimate adds up how many documents hold each prefix shingle.

Frequencies are counted over all documents, in packed blocks of hashes; the `FREQUENT` most frequent shingles at most (a
level of frequency is taken that fewer reach) go to every task, and the others count as rare and are ordered by hash. Any
order gives the same links, so this bounds the table and changes nothing else.

Shared prefix shingles make buckets. A bucket first asks for its members' links to its least member. Where confirmed links
join all members of a bucket, it is done, so a group of near copies never asks for all its pairs. In what is left, small
buckets (`SMALL`) name pairs of different groups, which are counted over the buckets and, with l or more, compared; large ones
are cut into parts whose pairs are compared inside tasks, again by shared prefix shingles first, and hand on links that join
groups, never pairs. Every pair that is not yet joined is met in one of the two ways.

Shingles are told apart by 64-bit hashes, and so are sets.

Defined cases: A-Z count as a-z; a document with fewer than five words has its whole sequence as one shingle; a null text and
one without words have the empty set, no link, and are their own component; repeated rows and repeated ids have rows of their
own; a null doc_id takes its component's smallest id, null if there is none; long texts are slices of their own; an empty table
gives an empty result; only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import checkpoint, released, stored, text_slices
from tabforge.llm.graph import components
from tabforge.llm.similar import _sid, shingle_sets

#: Similarity as percent, words of a shingle, longest l, entries of the table of frequent shingles, members of a small bucket and of a part.
PERCENT, WORDS_EACH, LONGEST, FREQUENT, SMALL, PART = 80, 5, 8, 1 << 19, 16, 1024
#: Estimated costs: of a row of the index, of a met document, of comparing one shingle, and how many documents a rare shingle meets.
ROW, MET, COMPARED, RARE = 1.0, 1.0, 1 / 16, 0.1
#: Hashes that a task packs at once; bytes of text for each block of hashes that is counted together.
PACKED, COUNTED = 1 << 21, 1 << 19
_BITS = 32
#: Bits of the bitmap of wanted texts, as a power of two.
_PLACES = 24


def overlap(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least number of shared shingles of a linked document with n."""
    return -(-percent * n // 100)


def prints(docs: DataFrame, words_each: int = WORDS_EACH) -> DataFrame:
    """doc_id, t (hash of the text), sid (hash of the set) and n (its size) of every row."""

    def run(batches):
        for part, texts in text_slices(batches):
            sets, first = shingle_sets(texts, words_each)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_sid(sets, first)), pa.array(np.diff(first))], ["doc_id", "t", "sid", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(run, "doc_id long, t long, sid long, n long")


def _unseen(sets: np.ndarray, first: np.ndarray, seen: set) -> Iterator[tuple[int, int, int]]:
    """sid, start and end of each set that is not empty and was not seen before."""
    for sid, a, b in zip(_sid(sets, first).tolist(), first[:-1].tolist(), first[1:].tolist()):
        if b > a and sid not in seen:
            seen.add(sid)
            yield sid, a, b


def _packed(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """Distinct hashes with their counts, a row for each block: by planes of bytes, since those of sorted numbers compress."""
    values, counts = np.unique(hashes, return_counts=True)
    block = (values >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
    low = ((values << np.uint64(bits)) >> np.uint64(64 - _BITS)).astype(np.uint32)
    planes = lambda x: x.view(np.uint8).reshape(-1, 4).T.tobytes()
    spans = list(zip(cut[:-1], cut[1:]))
    return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pa.array([planes(low[a:b]) for a, b in spans], pa.binary()), pa.array([planes(counts[a:b].astype(np.uint32)) for a, b in spans], pa.binary())], ["block", "low", "count"])


def _unpacked(column: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0] for x in column])


def _totals(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """h (the first bits + 32 bits of a hash) and df of hashes met twice or more, from rows sorted by block."""
    block, low, count = None, [], []

    def ended() -> pa.RecordBatch:
        values, back = np.unique(_unpacked(low), return_inverse=True)
        total = np.bincount(back, _unpacked(count)).astype(np.int64)
        often = total > 1
        h = (np.uint64(block) << np.uint64(_BITS)) | values[often].astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(total[often])], ["h", "df"])

    for batch in batches:
        for b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            if b != block and low:
                yield ended()
                low, count = [], []
            block = b
            low.append(x)
            count.append(y)
    if low:
        yield ended()


class Frequent:
    """The table of frequent shingles: the first bits of their hashes and how many documents hold them."""

    def __init__(self, h: np.ndarray, df: np.ndarray, shift: int):
        order = np.argsort(h)
        self.h, self.df, self.shift = h[order], df[order], np.uint64(shift)
        #: One bit for each value of 24 bits of the hash spares most searches.
        self.some = np.zeros(1 << 24, bool)
        self.some[(self.h & np.uint64((1 << 24) - 1)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """How many documents hold each shingle; 0 for rare ones."""
        out, short = np.zeros(len(hashes), np.int64), hashes >> self.shift
        some = np.flatnonzero(self.some[(short & np.uint64((1 << 24) - 1)).astype(np.int64)])
        if len(some) and len(self.h):
            at = np.minimum(np.searchsorted(self.h, short[some]), len(self.h) - 1)
            out[some] = np.where(self.h[at] == short[some], self.df[at], 0)
        return out


def frequent(docs: DataFrame, words_each: int = WORDS_EACH, most: int = FREQUENT) -> Frequent:
    """Counts all shingles and returns those of the lowest level (a power of two) that `most` at most reach."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(8, int(size // COUNTED).bit_length()), 64 - _BITS)

    def run(batches):
        held, n, seen = [], 0, set()
        for _, texts in text_slices(batches):
            sets, first = shingle_sets(texts, words_each)
            for _, a, b in _unseen(sets, first, seen):
                held.append(sets[a:b])
                n += b - a
            if n > PACKED:
                yield _packed(np.concatenate(held), bits)
                held, n = [], 0
        if held:
            yield _packed(np.concatenate(held), bits)

    packed = docs.select("text").mapInArrow(run, "block long, low binary, count binary")
    totals = stored(packed.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _totals(b, bits), "h long, df long").where("df >= 4"))
    level = F.floor(F.log2("df")).cast("int")
    sizes, total, least = {r["level"]: r["n"] for r in totals.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}, 0, 64
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    rows = totals.where(level >= least).toArrow().combine_chunks()
    h, df = (np.asarray(rows.column(i).combine_chunks()).astype(np.int64) if len(rows) else np.zeros(0, np.int64) for i in (0, 1))
    return Frequent(h.view(np.uint64), df, 64 - bits - _BITS)


def ordered(sets: np.ndarray, first: np.ndarray, table: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Each set's shingles in the global order, and how many documents hold them."""
    df = table.of(sets)
    order = np.lexsort((sets, df, np.repeat(np.arange(len(first) - 1), np.diff(first))))
    return sets[order], df[order]


def lengths(df: np.ndarray, first: np.ndarray, percent: int = PERCENT, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """l and the prefix length of each ordered set: the l of the least estimated cost."""
    n = np.diff(first)
    t = overlap(n, percent)
    met = np.concatenate([[0.0], np.cumsum(np.where(df > 0, df, RARE))])
    cost = np.full((longest, len(n)), np.inf)
    for x in range(1, longest + 1):
        size = np.minimum(n - t + x, n)
        meets = met[first[:-1] + size] - met[first[:-1]]
        cost[x - 1] = np.where(x <= np.maximum(t, 1), ROW * size + MET * meets + COMPARED * n * meets / x, np.inf)
    best = cost.argmin(0) + 1
    return best, np.minimum(n - t + best, n)


def prefixes(docs: DataFrame, table, words_each: int = WORDS_EACH, percent: int = PERCENT, longest: int = LONGEST) -> DataFrame:
    """h, sid and more (size of the set, l and whether the shingle is in the table, packed as below) for each shingle of each prefix. table: a broadcast Frequent."""

    def run(batches):
        seen = set()
        for _, texts in text_slices(batches):
            sets, first = shingle_sets(texts, words_each)
            new = list(_unseen(sets, first, seen))
            if not new:
                continue
            sets, sid, first = np.concatenate([sets[a:b] for _, a, b in new]), np.array([x for x, _, _ in new]), np.cumsum([0, *(b - a for _, a, b in new)])
            sets, df = ordered(sets, first, table.value)
            l, size = lengths(df, first, percent, longest)
            at = np.arange(size.sum()) + np.repeat(first[:-1] - np.cumsum(size) + size, size)
            of = np.repeat(np.arange(len(size)), size)
            more = (np.diff(first) << 9 | l << 1)[of] | (df[at] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(sets[at].view(np.int64)), pa.array(sid[of]), pa.array(more)], ["h", "sid", "more"])

    return docs.select("text").mapInArrow(run, "h long, sid long, more long")


#: A size, an l (at most 255) and a flag in one number: size << 9 | l << 1 | often.
_MET = "key long, sid long, n long, l long, often boolean, least long, least_n long, least_l long"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of buckets with two or more, with the least member, from rows sorted by h and sid: h, sid and more.

    Buckets of frequent shingles may be spread over tasks, so all their rows pass, with a least member of this task alone.
    """

    def done(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
        rows = rows[:, new]
        start = np.flatnonzero(np.diff(rows[0], prepend=rows[0, 0] ^ 1))
        size = np.diff(np.append(start, rows.shape[1]))
        keep = (np.repeat(size, size) > 1) | (rows[2] & 1 > 0)
        least = rows[:, np.repeat(start, size)]
        columns = [rows[0], rows[1], rows[2] >> 9, rows[2] >> 1 & 255, rows[2] & 1 > 0, least[1], least[2] >> 9, least[2] >> 1 & 255]
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["key", "sid", "n", "l", "often", "least", "least_n", "least_l"])

    held = np.zeros((3, 0), np.int64)
    for batch in batches:
        now = np.stack([np.asarray(c) for c in batch.columns])
        rows = np.concatenate([held, now], axis=1)
        if rows.shape[1]:
            # the last bucket waits for its other members, unless it is a frequent shingle's
            last = rows.shape[1] if rows[2, -1] & 1 else int(np.searchsorted(rows[0], rows[0, -1]))
            if last:
                yield done(rows[:, :last])
            held = rows[:, last:]
    if held.shape[1]:
        yield done(held)


def buckets(docs: DataFrame, table, words_each: int = WORDS_EACH, percent: int = PERCENT, longest: int = LONGEST) -> DataFrame:
    """key, sid, n and l of the members of each bucket of two or more, with the bucket's least member and its n and l."""
    rows = prefixes(docs, table, words_each, percent, longest)
    salt = F.when(F.col("more").bitwiseAND(1) == 1, F.pmod("sid", F.lit(256))).otherwise(0)
    met = stored(rows.repartition("h", salt).sortWithinPartitions("h", "sid").mapInArrow(_met, _MET))
    own = ["key", "sid", "n", "l"]
    often = met.where("often").select(*own)
    first = often.groupBy("key").agg(F.min(F.struct("sid", "n", "l")).alias("x"), F.max("sid").alias("y")).where("x.sid <> y")
    first = first.select("key", F.col("x.sid").alias("least"), F.col("x.n").alias("least_n"), F.col("x.l").alias("least_l"))
    return met.where("not often").drop("often").unionByName(often.join(first, "key"))


def _fits(n: Column | str, m: Column | str, percent: int) -> Column:
    """Whether sets of these sizes can have the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _counted(pairs: DataFrame) -> DataFrame:
    """u and v of the pairs that share as many prefix shingles as they need."""
    return pairs.groupBy("u", "v").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("u", "v")


def _sets(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """sid and set (sorted hashes) of the nodes (sid, t) in wanted.

    Texts are not shuffled: a bitmap of the wanted texts' hashes (2 MB, whatever their number) goes to every task, which makes
    the sets of the texts that it lets pass; a join drops those that passed by chance.
    """
    place = F.pmod("t", F.lit(1 << _PLACES)) + 1
    rows = wanted.select(place.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    bits = np.zeros(1 << _PLACES, bool)
    for r in rows:
        bits[(r["k"] - 1) << 15 : r["k"] << 15] = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")[: 1 << 15]
    passes = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        seen, lets = set(), np.unpackbits(passes.value).view(bool)
        for batch in batches:
            t = np.asarray(batch.column(1))
            new = []
            for i in np.flatnonzero(lets[t & ((1 << _PLACES) - 1)]).tolist():
                if t[i] not in seen:
                    seen.add(t[i])
                    new.append(i)
            for part, texts in text_slices([batch.take(pa.array(new, pa.int64()))]):
                values, first = shingle_sets(texts, words_each)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["t", "set"])

    made = docs.select("text", F.xxhash64("text").alias("t")).mapInArrow(run, "t long, set binary")
    # texts' hashes meet once for both steps; a set has one text among the nodes
    return stored(made.groupBy("t").agg(F.min("set").alias("set")).join(wanted.select("sid", "t"), "t").select("sid", "set"))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs u, v whose sets have the similarity."""

    def keep(batches):
        for batch in batches:
            good = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.select(F.col("sid").alias("u"), F.col("set").alias("x")), "u")
    both = one.join(sets.select(F.col("sid").alias("v"), F.col("set").alias("y")), "v").select("u", "v", "x", "y")
    return checkpoint(both.mapInArrow(keep, "u long, v long"))


def _open(met: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the buckets that are not of one group yet, with group, top (the bucket's largest group) and members (their number)."""
    roots = components(links).withColumnRenamed("node", "sid")
    grouped = met.select("key", "sid", "n", "l").join(roots, "sid", "left").select("key", "sid", "n", "l", F.coalesce("root", "sid").alias("group"))
    sizes = grouped.groupBy("key", "group").count().groupBy("key")
    tops = sizes.agg(F.max(F.struct("count", "group"))["group"].alias("top"), F.sum("count").alias("members"), F.count("*").alias("groups")).where("groups > 1")
    return stored(grouped.join(tops.drop("groups"), "key"))


def _named(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates among small buckets' pairs of different groups."""
    a, b = (rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("sid", "n", "l", "group")]) for x in "ab")
    pairs = a.join(b, "key").where((F.col("sid_a") < F.col("sid_b")) & (F.col("group_a") != F.col("group_b")) & _fits("n_a", "n_b", percent))
    return _counted(pairs.select(F.col("sid_a").alias("u"), F.col("sid_b").alias("v"), F.least("l_a", "l_b").alias("need")))


_BLOCK = ["key", "i", "j", "part", "sid", "group"]


def _index(arrays: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' values in order, and whose they are."""
    values, owner = np.concatenate([arrays[b] for b in rows]), np.repeat(rows, [len(arrays[b]) for b in rows])
    order = np.argsort(values)
    return values[order], owner[order]


def _shared(index: tuple[np.ndarray, np.ndarray], own: np.ndarray, rows: int) -> np.ndarray:
    """How many values of own each row has."""
    low, high = np.searchsorted(index[0], own), np.searchsorted(index[0], own, "right")
    size = high - low
    return np.bincount(index[1][np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)], minlength=rows)


def _met_in(key: tuple, part: np.ndarray, n: np.ndarray, l: np.ndarray, group: np.ndarray, prefix: list[np.ndarray], keys: list[list[int]], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of part i with the rows of part j of other groups that share enough prefix shingles with it; group is read anew for each row.

    A pair belongs to the least of the large buckets (keys) that both are in, and is met there alone.
    """
    _, i, j = key
    before = [np.array([k for k in own if k < key[0]], np.int64) for own in keys]
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    index, other = _index(prefix, right), _index(before, right)
    for a in left.tolist():
        shared = _shared(index, prefix[a], len(n))
        fits = np.minimum(n, n[a]) * 100 >= np.maximum(n, n[a]) * percent
        found = np.flatnonzero((shared > 0) & (shared >= np.minimum(l, l[a])) & fits & (group != group[a]))
        if len(found) and len(before[a]):
            found = found[_shared(other, before[a], len(n))[found] == 0]
        if len(found):
            yield a, found


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """(key, i, j) and rows (part, sid, group and what follows) of each block whose parts are both there and which has two groups."""
    key, held = None, []
    whole = lambda: held and len({h[2] for h in held}) > 1 and set(key[1:]) <= {h[0] for h in held}
    for batch in batches:
        for k, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (k, i, j) != key:
                if whole():
                    yield key, held
                key, held = (k, i, j), []
            held.append(row)
    if whole():
        yield key, held


def _crowded(rows: DataFrame, sets: DataFrame, table, percent: int, longest: int) -> DataFrame:
    """Links that join the groups of large buckets: stragglers (members outside the largest group), in parts, against each other and against the others' parts.

    Members first go with their prefixes alone; those that share enough prefix shingles with another group go again with
    their sets, and are compared.
    """
    stray, hashed = F.col("group") != F.col("top"), F.xxhash64("sid")
    parts = lambda c: F.ceil(F.count_if(c) / PART).cast("long")
    counts = rows.groupBy("key").agg(parts(stray).alias("strays"), parts(~stray).alias("rest"))
    parted = rows.join(counts, "key").withColumn("part", F.when(stray, F.pmod(hashed, F.col("strays"))).otherwise(F.col("strays") + F.pmod(hashed, F.col("rest"))))
    paired = parted.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.when(stray, F.col("strays") + F.col("rest")).otherwise(F.col("strays")) - 1)))
    blocks = paired.select("key", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "sid", "group")
    dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "sid")

    def cut(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
                first = np.cumsum([0, *map(len, own)])
                values, df = ordered(np.concatenate(own), first, table.value)
                l, size = lengths(df, first, percent, longest)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(l), pa.array([values[x : x + s].tobytes() for x, s in zip(first[:-1], size)], pa.binary()), part.column(2)], ["sid", "n", "l", "prefix", "keys"])

    def near(batches):
        for key, held in _by_block(batches):
            part, sid, group, n, l = (np.array([h[x] for h in held], np.int64) for x in range(5))
            met = np.zeros(len(held), bool)
            for a, found in _met_in(key, part, n, l, group, [np.frombuffer(h[5], np.uint64) for h in held], [h[6] for h in held], percent):
                met[a] = met[found] = True
            at = np.flatnonzero(met)
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(at), k)) for k in key), *(pa.array(x[at]) for x in (part, sid, group, n, l)), pa.array([held[x][5] for x in at.tolist()], pa.binary()), pa.array([held[x][6] for x in at.tolist()], pa.list_(pa.int64()))], [*_BLOCK, "n", "l", "prefix", "keys"])

    def join(batches):
        for key, held in _by_block(batches):
            part, sid, group, n, l = (np.array([h[x] for h in held], np.int64) for x in range(5))
            own, links = [np.frombuffer(h[7], np.uint64) for h in held], []
            for a, found in _met_in(key, part, n, l, group, [np.frombuffer(h[5], np.uint64) for h in held], [h[6] for h in held], percent):
                for b in found.tolist():
                    if group[b] != group[a] and _similar(own[a], own[b], percent):
                        group[group == group[b]] = group[a]
                        links.append((int(sid[a]), int(sid[b])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*links)], ["u", "v"])

    within = rows.groupBy("sid").agg(F.collect_set("key").alias("keys"))  # as many as prefix shingles at most
    prefix = stored(sets.join(within, "sid").select("sid", "set", "keys").mapInArrow(cut, "sid long, n long, l long, prefix binary, keys array<long>"))
    schema = ", ".join(f"{c} long" for c in [*_BLOCK, "n", "l"]) + ", prefix binary, keys array<long>"
    met = stored(dealt(blocks.join(prefix, "sid").select(*_BLOCK, "n", "l", "prefix", "keys")).mapInArrow(near, schema))
    released(rows.sparkSession)
    return checkpoint(dealt(met.join(sets, "sid").select(*met.columns, "set")).mapInArrow(join, "u long, v long"))


def links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT, words_each: int = WORDS_EACH, longest: int = LONGEST, most: int = FREQUENT, known: DataFrame | None = None) -> DataFrame:
    """Confirmed links u, v between different sets that join all that are linked. known: links found otherwise, which take the place of those to the least members."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent(docs, words_each, most))
    released(spark)
    met = buckets(docs, table, words_each, percent, longest)
    released(spark)
    ends = lambda pairs: pairs.select(F.explode(F.array("u", "v")).alias("sid"))
    sets = lambda wanted: _sets(docs, nodes.join(wanted.distinct(), "sid"), words_each)
    found = known
    if known is None:
        star = met.where((F.col("sid") != F.col("least")) & _fits("n", "least_n", percent))
        asked = stored(_counted(star.select(F.least("sid", "least").alias("u"), F.greatest("sid", "least").alias("v"), F.least("l", "least_l").alias("need"))))
        found = _confirmed(asked, sets(ends(asked)), percent)
    rows = _open(met, found)
    released(spark)
    named, large = stored(_named(rows.where(F.col("members") <= SMALL), percent)), rows.where(F.col("members") > SMALL)
    more = sets(ends(named).unionByName(large.select("sid")))
    released(spark)
    named = named if known is not None else named.join(asked, ["u", "v"], "left_anti")
    out = found.unionByName(_confirmed(named, more, percent))
    return out.unionByName(_crowded(large, more, table, percent, longest)) if large.take(1) else out


def joined(docs: DataFrame, percent: int = PERCENT, words_each: int = WORDS_EACH, longest: int = LONGEST, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    rows = checkpoint(prints(docs, words_each))
    nodes = checkpoint(rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min("t").alias("t")))
    roots = checkpoint(components(links(docs, nodes, percent, words_each, longest, most)).withColumnRenamed("node", "sid"))
    named = roots.join(nodes.select("sid", "doc_id"), "sid")
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    # stands on its own, so that Spark can split the rows of a set that many documents share
    whole = checkpoint(nodes.join(named.join(least, "root").select("sid", "least"), "sid", "left").select("sid", F.coalesce("least", "doc_id").alias("component_id")))
    size = F.col("n").alias("n_shingles")
    linked = rows.where("n > 0").join(whole, "sid").select("doc_id", size, "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id")))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words
), sizes AS MATERIALIZED (SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON r.other = l.u)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id FROM sizes s JOIN reached r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.n
"""
