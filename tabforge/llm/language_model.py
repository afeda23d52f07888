"""Operator 8, LM scoring: a gated recurrent language model with a class-factored output softmax.

Tokens are words (A-Z as a-z) and an end after each text. The commonest `VOCABULARY - 1` tokens and one entry for all
others lie in `CLASSES` classes; the output is the softmax over classes times the softmax within the class. A token outside
the vocabulary has that entry's probability times its smoothed share of the counts outside, so the model is a probability
of the text itself. Output biases start at the smoothed counts: untrained, the model is the unigram base.

Counts are exact and cover all training texts. Every text is turned into token numbers once, and those are written to the
shared folder. Training reads every training text once, in `ROUNDS` rounds. The texts are dealt to shards by a hash of id
and text, some `SHARD_TOKENS` tokens each (long texts apart), so the number of shards follows from the corpus and not from its partitions. Each
round takes the next part of the texts: every shard starts from the parameters of the round before and runs truncated
backpropagation in numpy over its texts, in the order of their hashes, laid in lanes with the state carried from window to
window and reset where a text begins; then the shards' parameters are averaged, weighted by tokens. The sums are taken in
whole numbers, so they do not depend on any order. Scoring carries the state over the whole document, too, whatever its
length. So a score depends on the texts alone, up to the rounding of 32-bit matrix products.

The counts of common words are broadcast as two arrays of at most `COMMON` numbers. All other words of a text go, once a
text, through a join with the count table; none of these is frequent, so that join has no hot key.

Defined cases: a null or empty text is its end token alone; repeated rows are scored each; a null doc_id belongs to fold 0,
and is returned; without training rows N and V are 0; an empty table gives an empty result. Only `doc_id` and `text` are
read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import Words, checkpoint, fold, shared_dir, text_slices

CLASSES = 64
VOCABULARY = CLASSES * CLASSES
HIDDEN, LANES, STEPS = 16, 512, 16
UPDATE, MOST_STEPS = LANES * STEPS, 256
SHARD_TOKENS, ROUNDS = 4_000_000, 6
CHUNK_TOKENS = 8_000_000  # texts whose tokens are laid in lanes together when they are scored
COMMON = 1 << 18
END = b"\n"  # no word holds a line feed


def token_counts(docs: DataFrame) -> DataFrame:
    """word (binary, END for the end of a text) and c."""

    def run(batches):
        seen: Counter = Counter()
        for _, texts in text_slices(batches):
            for t in texts:
                seen.update(t.lower().split())
            seen[END] += len(texts)
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def common_words(counts: DataFrame, most: int = COMMON) -> list[tuple[bytes, int]]:
    """All words above a count, at most `most`, commonest first. The count is found from a histogram of fixed size."""
    level = F.floor(F.log2("c") * 16)
    above, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        above += r["count"]
        if above > most:
            break
        least = r["level"]
    if least is None:
        return []
    got = counts.where(level >= least).toArrow()
    return sorted(zip((bytes(x) for x in got.column("word").to_pylist()), got.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))


def _hashes(words: list[bytes]) -> np.ndarray:
    """Words.hash of single words; END gets zero."""
    out = np.zeros(len(words), np.uint64)
    at = [i for i, x in enumerate(words) if x != END]
    out[at] = Words([b" ".join(words[i] for i in at)]).hash
    return out


class Lexicon:
    """Sorted hashes of the common words, their counts and their numbers in the model (0: others; the end has the number `end`)."""

    def __init__(self, common: list[tuple[bytes, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        hashes = _hashes([w for w, _ in common])
        order = np.argsort(hashes)
        self.hash, self.count = hashes[order], np.array([c for _, c in common], np.int64)[order]
        self.bucket = np.searchsorted(self.hash >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
        self.depth = int(np.diff(self.bucket).max())  # words of one bucket, compared one after another
        inside = common[: VOCABULARY - 1]
        number = np.zeros(len(common), np.int32)
        number[: len(inside)] = np.arange(1, len(inside) + 1)
        self.number = number[order]
        at = [i for i, (w, _) in enumerate(common) if w == END]
        self.end_count = common[at[0]][1] if at else 0
        self.end = at[0] + 1 if at and at[0] < len(inside) else 0
        self.outside = total - sum(c for _, c in inside) + 0.5 * (distinct - len(inside) + 1)
        self.bias = np.full(VOCABULARY, -30.0)
        self.bias[0] = math.log(self.outside)
        self.bias[1 : len(inside) + 1] = np.log([c + 0.5 for _, c in inside])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word among the common ones, -1 for others."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = self.bucket[hashes >> np.uint64(44)]
        last = len(self.hash) - 1
        out = np.full(len(hashes), -1)
        left = np.arange(len(hashes))
        for _ in range(self.depth):
            np.minimum(at, last, out=at)
            hit = self.hash[at] == hashes
            out[left[hit]] = at[hit]
            miss = ~hit
            at, hashes, left = at[miss] + 1, hashes[miss], left[miss]
        return out


def first_parameters(lexicon: Lexicon, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    by_class = lexicon.bias.reshape(CLASSES, CLASSES)
    top = by_class.max(1, keepdims=True)
    mass = (top + np.log(np.exp(by_class - top).sum(1, keepdims=True)))[:, 0]
    p = {"G": 0.1 * rng.normal(size=(VOCABULARY, 3 * h)), "Uzr": 0.25 * rng.normal(size=(h, 2 * h)), "Uc": 0.25 * rng.normal(size=(h, h)), "Wc": np.zeros((h, CLASSES)), "bc": mass - mass.max(), "Ww": np.zeros((CLASSES, h, CLASSES)), "bw": by_class - top}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _packed(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shares(p: dict, n: int) -> tuple[int, np.ndarray]:
    """Weight of n tokens and parameters times it, as whole numbers, whose sums are exact over 2**20 shards and more."""
    weight = max(1, round(n / SHARD_TOKENS * 256))
    return weight, np.rint(np.clip(_packed(p).astype(np.float64), -64, 64) * 2**24).astype(np.int64) * weight


def _unpacked(flat: np.ndarray, like: dict) -> dict:
    out, a = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[a : a + n].reshape(like[k].shape).astype(np.float32)
        a += n
    return out


class Lanes:
    """Texts' token numbers laid end to end in lanes of nearly equal length, longest lane first."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray, end: int, lanes: int = LANES):
        size = np.diff(first)
        heap = [(0, i) for i in range(min(lanes, len(size)))]
        members: list[list[int]] = [[] for _ in heap]
        for d in np.argsort(-size, kind="stable"):
            load, i = heap[0]
            members[i].append(int(d))
            heapq.heapreplace(heap, (load + int(size[d]), i))
        load = np.zeros(len(heap), np.int64)
        for n, i in heap:
            load[i] = n
        order = np.argsort(-load, kind="stable")
        self.texts = np.array([d for i in order for d in members[i]], np.int64)
        self.load = load[order]
        self.start = np.cumsum(self.load) - self.load
        n = size[self.texts]
        self.first = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(n.sum()) - np.repeat(self.first[:-1], n) + np.repeat(first[self.texts], n)
        self.tokens = tokens[at]
        self.before = np.concatenate([[end], self.tokens[:-1]]).astype(np.int32)
        self.goes_on = np.ones(len(at), np.float32)
        self.before[self.first[:-1]] = end
        self.goes_on[self.first[:-1]] = 0

    def windows(self, steps: int = STEPS) -> Iterator[list[np.ndarray]]:
        """Places in tokens of the active lanes at each of the window's steps; where few lanes are active a window has more steps."""
        longest = int(self.load[0]) if len(self.load) else 0
        active = np.searchsorted(-self.load, -np.arange(longest), side="left")  # lanes with more than t tokens
        a = 0
        while a < longest:
            b = min(longest, a + max(steps, min(MOST_STEPS, UPDATE // 8 // int(active[a]))))
            yield [self.start[: active[t]] + t for t in range(a, b)]
            a = b


def _steps(lanes: Lanes, window: list[np.ndarray], state: np.ndarray, p: dict, kept: list | None = None) -> np.ndarray:
    """States of the window, step by step; state is carried on.

    Inside, each lane is a column, so that a gate is a run of whole rows and no operation strides over the others.
    """
    h, out, now = HIDDEN, [], state.T
    less, uc = -p["Uzr"].T, p["Uc"].T
    with np.errstate(over="ignore"):  # an infinite exponential makes a closed gate
        for at in window:
            n = len(at)
            before = now[:, :n] * lanes.goes_on[at]
            g = np.ascontiguousarray(p["G"].take(lanes.before[at], 0).T)
            zr = less @ before
            zr -= g[: 2 * h]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:h], zr[h:]
            reset = r * before
            c = uc @ reset
            c += g[2 * h :]
            np.tanh(c, out=c)
            new = c - before
            new *= z
            new += before
            now[:, :n] = new
            out.append(new.T)
            if kept is not None:
                kept.append((before, z, r, reset, c))
    return np.concatenate(out)


def _softmax(x: np.ndarray, target: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of the targets (places in x's memory), the exponentials (in x's memory) and their sums.

    The largest bias is zero and states lie in [-1, 1], so logits need no shift by their maximum; where `most`, which they
    cannot exceed, leaves 32-bit exponentials in doubt, they are bounded.
    """
    if not most <= 80:
        np.minimum(x, np.float32(80), out=x)
    out = x.ravel()[target]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    return out - np.log(total), x, total


def _most(weights: np.ndarray, bias: np.ndarray) -> float:
    """What no logit of states in [-1, 1] exceeds."""
    return HIDDEN * max(float(weights.max()), -float(weights.min())) + float(bias.max())


def _output(states: np.ndarray, target: np.ndarray, p: dict, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logarithm of each target's probability; with grad also the gradient of their negative sum, by parameter and by state."""
    n, h = states.shape
    # rows lie by class, so that a class is a slice and all but the products is done for all classes at once
    order = np.argsort((target // CLASSES).astype(np.int16), kind="stable")
    own = target[order]
    group, inside = own // CLASSES, own % CLASSES
    s = np.ones((n, h + 1), np.float32)  # the last column meets the biases
    s[:, :h] = states
    s = s.take(order, 0)
    edge = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    met = [(k, edge[k], edge[k + 1]) for k in range(CLASSES) if edge[k] < edge[k + 1]]
    row = np.arange(n) * CLASSES
    at, at_inside = row + group, row + inside
    log, e, total = _softmax(s @ np.concatenate([p["Wc"], p["bc"][None]]), at, _most(p["Wc"], p["bc"]))
    back = None
    if grad is not None:
        e.ravel()[at] -= total
        total = 1 / total[:, None]  # goes to the narrow side of each product
        both = (e.T @ (s * total)).T
        grad["Wc"], grad["bc"] = both[:h], both[h]
        back = e @ p["Wc"].T
        back *= total
    logits, inner = np.empty((n, CLASSES), np.float32), np.concatenate([p["Ww"], p["bw"][:, None]], 1)
    for k, a, b in met:
        np.matmul(s[a:b], inner[k], out=logits[a:b])
    more, e, total = _softmax(logits, at_inside, _most(p["Ww"], p["bw"]))
    log += more
    if grad is not None:
        e.ravel()[at_inside] -= total
        total = 1 / total[:, None]
        s *= total
        both, sent = np.zeros_like(inner), np.empty((n, h), np.float32)
        for k, a, b in met:
            np.matmul(s[a:b].T, e[a:b], out=both[k])
            np.matmul(e[a:b], p["Ww"][k].T, out=sent[a:b])
        grad["Ww"], grad["bw"] = both[:, :h], both[:, h]
        sent *= total
        sent += back
        back[order] = sent
    out = np.empty_like(log)
    out[order] = log
    return out, back


def _window_gradient(lanes: Lanes, window: list[np.ndarray], state: np.ndarray, p: dict) -> dict:
    """Truncated backpropagation: the gradient within the window, the state at its start taken as given. Lanes are columns, as in _steps."""
    h, kept, g = HIDDEN, [], {}
    states = _steps(lanes, window, state, p, kept)
    at = np.concatenate(window)
    back = np.ascontiguousarray(_output(states, lanes.tokens[at], p, g)[1].T)
    edge = np.cumsum([0, *map(len, window)])
    ds, gates = np.zeros((h, 0), np.float32), []
    for t in reversed(range(len(window))):
        before, z, r, reset, c = kept[t]
        gate = np.empty((3 * h, before.shape[1]), np.float32)
        daz, dar, dac = gate[:h], gate[h : 2 * h], gate[2 * h :]
        d = back[:, edge[t] : edge[t + 1]]
        d[:, : ds.shape[1]] += ds
        dz = d * z
        np.multiply(c, c, out=dac)
        np.subtract(1, dac, out=dac)
        dac *= dz
        np.subtract(c, before, out=daz)
        daz *= dz
        daz *= 1 - z
        drs = p["Uc"] @ dac
        np.subtract(1, r, out=dar)
        dar *= reset
        dar *= drs
        ds = p["Uzr"] @ gate[: 2 * h]
        drs *= r
        ds += drs
        d -= dz
        ds += d
        ds *= lanes.goes_on[window[t]]
        gates.append(gate)
    gates = np.concatenate(gates[::-1], 1)
    g["Uzr"] = np.concatenate([k[0] for k in kept], 1) @ gates[: 2 * h].T
    g["Uc"] = np.concatenate([k[3] for k in kept], 1) @ gates[2 * h :].T
    before = lanes.before[at].astype(np.uint16)
    order = np.argsort(before, kind="stable")
    before = before[order]
    head = np.concatenate([[0], np.flatnonzero(before[1:] != before[:-1]) + 1])
    g["G"] = (before[head], np.ascontiguousarray(np.add.reduceat(gates.take(order, 1, mode="clip"), head, axis=1).T))
    return g


class Adam:
    """Takes gradient sums of windows and moves the parameters once they cover `UPDATE` tokens."""

    def __init__(self, p: dict, rate: float = 0.02, done: int = 0):
        """done: updates of earlier rounds, which the rate takes into account."""
        self.rate, self.step, self.done = rate, 0, done
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
        self.sums: dict = {}
        self.rows: list = []
        self.n = 0

    def add(self, p: dict, g: dict, n: int) -> None:
        self.rows.append(g.pop("G"))
        for k, x in g.items():
            if self.n:
                self.sums[k] += x
            else:
                self.sums[k] = x
        self.n += n
        if self.n >= UPDATE:
            self.update(p)

    def update(self, p: dict) -> None:
        if not self.n:
            return
        self.step += 1
        lr = self.rate / math.sqrt(1 + (self.done + self.step) / 60)
        met, rows = self.rows[0]
        if len(self.rows) > 1:
            words = np.concatenate([w for w, _ in self.rows])
            order = np.argsort(words, kind="stable")
            met, head = np.unique(words[order], return_index=True)
            rows = np.add.reduceat(np.concatenate([x for _, x in self.rows])[order], head, axis=0)
        for k, (at, grad) in ({k: (slice(None), x) for k, x in self.sums.items()} | {"G": (met, rows)}).items():
            grad = grad / self.n
            m, v = self.m[k][at], self.v[k][at]  # the arrays themselves, or copies of the rows met
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            grad *= grad
            grad *= 0.01
            v += grad
            move = np.sqrt(v, out=grad)
            move *= 1 / math.sqrt(1 - 0.99**self.step)
            move += 1e-8
            np.divide(m, move, out=move)
            move *= lr / (1 - 0.9**self.step)
            p[k][at] -= move
            if k == "G":
                self.m[k][at], self.v[k][at] = m, v
        self.sums, self.rows, self.n = {}, [], 0


def _tokens(texts: list[bytes], lexicon: Lexicon) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their places among the common ones, the texts' token numbers with ends, and the first token of each text."""
    w = Words(texts)
    place = lexicon.find(w.hash)
    n = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    tokens = np.full(first[-1], lexicon.end, np.int32)
    at = np.arange(len(w)) + np.repeat(np.arange(len(n)), n)
    tokens[at] = np.where(place >= 0, lexicon.number[place], 0) if len(lexicon.number) else 0
    return w, place, tokens, first


def fitted(texts: list[np.ndarray], start: dict, end: int, done: int = 0) -> tuple[dict, int]:
    """Parameters after one pass over a shard's texts (token numbers) from start on, and the tokens read."""
    p = {k: v.copy() for k, v in start.items()}
    adam = Adam(p, done=done)
    lanes = Lanes(np.concatenate(texts).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in texts])]), end)
    state = np.zeros((HIDDEN, len(lanes.load)), np.float32).T
    for window in lanes.windows():
        adam.add(p, _window_gradient(lanes, window, state, p), sum(map(len, window)))
    adam.update(p)
    return p, len(lanes.tokens)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Token numbers of the texts of each shard in rows sorted by shard (shard, tokens)."""
    shard, held = None, []
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != shard and held:
                yield held
                held = []
            shard = k
            held.append(np.frombuffer(x.as_buffer(), np.uint16))
    if held:
        yield held


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = None, 0
    for batch in batches:
        for w, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(x.as_buffer(), np.int64)
            total, weight = x.copy() if total is None else total + x, weight + w
    if weight:
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["w", "p"])


def train(texts: DataFrame, lexicon: Lexicon, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters learnt from texts: round, h (hash of id and text) and tokens. A tree of tasks adds up the shards of a round.

    Texts longer than a lane's share of a shard have shards of their own, or each shard would end with one of them alone.
    """
    p = first_parameters(lexicon, seed)
    context, schema, done = texts.sparkSession.sparkContext, "w long, p binary", 0
    n = F.octet_length("tokens") / 2
    sums = texts.groupBy("round").agg(F.sum(F.when(n <= SHARD_TOKENS // LANES, n)).alias("short"), F.sum(F.when(n > SHARD_TOKENS // LANES, n)).alias("long")).orderBy("round").collect()
    for r in sums:
        shared = context.broadcast((p, lexicon.end, done))

        def run(batches, shared=shared):
            start, end, done = shared.value
            for own in _by_shard(batches):
                weight, share = _shares(*fitted(own, start, end, done))
                yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([share.tobytes()], pa.binary())], ["w", "p"])

        short, long = (math.ceil((r[k] or 0) / SHARD_TOKENS) for k in ("short", "long"))
        width, hashed = short + long, F.xxhash64("h", F.lit(2))
        shard = F.when(n <= SHARD_TOKENS // LANES, F.pmod(hashed, F.lit(max(1, short)))).otherwise(short + F.pmod(hashed, F.lit(max(1, long)))).cast("int")
        own = texts.where(F.col("round") == r["round"]).select(shard.alias("shard"), "tokens", "h")
        parts = own.repartitionById(width, "shard").sortWithinPartitions("shard", "h", "tokens").select("shard", "tokens").mapInArrow(run, schema)
        while width > 16:
            width = -(-width // 16)
            parts = parts.repartition(width).mapInArrow(_summed, schema)
        got = list(_summed(iter([pa.RecordBatch.from_arrays([pa.array([x["w"]], pa.int64()), pa.array([bytes(x["p"])], pa.binary())], ["w", "p"]) for x in parts.collect()])))
        shared.destroy()
        if got:
            p = _unpacked(np.frombuffer(got[0].column(1)[0].as_buffer(), np.int64) / (got[0].column(0)[0].as_py() * 2.0**24), p)
            done += int(((r["short"] or 0) + (r["long"] or 0)) / (short + long) / UPDATE)
    return p


def text_scores(tokens: np.ndarray, first: np.ndarray, end: int, p: dict) -> np.ndarray:
    """Natural logarithm of each text's probability by the numbers of its tokens."""
    lanes = Lanes(tokens, first, end)
    state, logs = np.zeros((HIDDEN, len(lanes.load)), np.float32).T, np.zeros(len(tokens), np.float32)
    for window in lanes.windows():
        states = _steps(lanes, window, state, p)
        at = np.concatenate(window)
        logs[at] = _output(states, lanes.tokens[at], p)[0]
    out = np.empty(len(first) - 1)
    out[lanes.texts] = np.add.reduceat(logs.astype(np.float64), lanes.first[:-1])
    return out


_TEXT = "uid long, doc_id long, h long, learn boolean, tokens binary, word binary, n long, known long, base double, outside long, outside_base double"
_NAMES = [x.split()[0] for x in _TEXT.split(", ")]


def _encoded(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """A row for each text with its token numbers and what common words give, and one for each other word in it."""
    uid = TaskContext.get().partitionId() << 40
    logs = np.log10(lexicon.count + 0.5) if len(lexicon.count) else np.zeros(1)
    end = math.log10(lexicon.end_count + 0.5)
    for part, texts in text_slices(batches):
        w, place, tokens, first = _tokens(texts, lexicon)
        m, text = len(texts), np.repeat(np.arange(len(texts)), np.diff(w.first))
        common = place >= 0
        base = np.where(common, logs[place], 0.0)
        out = common & (lexicon.number[place] == 0) if len(lexicon.number) else np.zeros(len(w), bool)
        total = lambda x, m=m, text=text: np.bincount(text, x, m)
        known = total(common).astype(np.int64) + (lexicon.end_count > 0)
        sums = [known, total(base) + end, total(out | ~common).astype(np.int64) + (lexicon.end == 0), total(base * out) + end * (lexicon.end == 0)]
        ids = np.arange(uid, uid + m)
        numbers = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer((first * 2).astype(np.int32)), pa.py_buffer(tokens.astype(np.uint16).tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(ids), part.column(0), part.column(1), part.column(2), numbers, pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), *map(pa.array, sums)], _NAMES)
        rare = np.flatnonzero(~common)
        if len(rare):
            mixed = w.hash[rare] ^ (text[rare].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, one, count = np.unique(mixed, return_index=True, return_counts=True)
            at = rare[one]
            size = w.length[at]
            edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            data = w.buf[np.arange(edge[-1]) - np.repeat(edge[:-1], size) + np.repeat(w.start[at], size)]
            words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edge), pa.py_buffer(data.tobytes())])
            k = len(at)
            none = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.binary())]
            more = [pa.nulls(k, t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[text[at]]), *none, words, pa.array(count.astype(np.int64)), *more], _NAMES)
        uid += m


def _modelled(batches: Iterator[pa.RecordBatch], end: int, p: dict) -> Iterator[pa.RecordBatch]:
    """uid and model (logarithm to base 10) of rows of uid and tokens."""
    ids, held, waiting = [], [], 0

    def scored():
        flat, first = np.concatenate(held).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in held])])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(text_scores(flat, first, end, p) / math.log(10))], ["uid", "model"])

    for batch in batches:
        for uid, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(uid)
            held.append(np.frombuffer(x.as_buffer(), np.uint16))
            waiting += len(held[-1])
            if waiting >= CHUNK_TOKENS:
                yield scored()
                ids, held, waiting = [], [], 0
    if held:
        yield scored()


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (logarithms to base 10) of every row, learnt from the rows where learn holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), learn.alias("learn"), "text")
    counts = checkpoint(token_counts(rows.where("learn")))
    total, distinct = counts.select(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    lexicon = Lexicon(common_words(counts), total, distinct)
    shared = spark.sparkContext.broadcast(lexicon)
    # written once: the uid of a text, made in its task, is what was written, whatever is lost and run again later
    rounds = min(ROUNDS, max(1, -(-total // SHARD_TOKENS)))
    turn = F.when(F.col("learn"), F.pmod(F.xxhash64("h", F.lit(1)), F.lit(rounds))).cast("int")
    kind = F.when(F.col("word").isNotNull(), F.lit("word")).otherwise(F.lit("text"))
    folder = f"{shared_dir(spark)}/language-{uuid.uuid4().hex}"
    encoded = rows.mapInArrow(lambda b: _encoded(b, shared.value), _TEXT).withColumns({"round": turn, "kind": kind})
    encoded.write.option("compression", "zstd").partitionBy("kind", "round").parquet(folder)
    schema = f"{_TEXT}, kind string, round int"
    encoded = spark.read.schema(schema).parquet(folder)
    texts = encoded.where("kind = 'text'")
    p = train(texts.where("round is not null"), lexicon)
    fit = spark.sparkContext.broadcast((lexicon.end, p))
    # few long texts keep their lanes busy alone at a chunk's end, so chunks are whole: files are read together, nothing is shuffled
    n = texts.select(F.coalesce(F.sum(F.octet_length("tokens") / 2), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(n / CHUNK_TOKENS), min(spark.sparkContext.defaultParallelism, int(n / 1_000_000)))
    model = texts.select("uid", "tokens").coalesce(chunks).mapInArrow(lambda b: _modelled(b, *fit.value), "uid long, model double")
    named = counts.select("word", "c")
    met = encoded.where("kind = 'word'").select("uid", "word", "n").join(named, "word", "left").select("uid", F.when(F.col("c") > 0, F.col("n")).alias("known"), (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare"))
    one = texts.select("uid", "doc_id", (F.octet_length("tokens") / 2).cast("long").alias("n_tokens"), "known", "base", "outside", "outside_base", F.lit(None).cast("double").alias("rare"), F.lit(None).cast("double").alias("model"))
    sums = one.unionByName(met, allowMissingColumns=True).unionByName(model, allowMissingColumns=True).groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.max("outside").alias("outside"),
        (F.max("base") + F.coalesce(F.sum("rare"), F.lit(0.0))).alias("base"), (F.max("outside_base") + F.coalesce(F.sum("rare"), F.lit(0.0)) + F.max("model")).alias("score"),
    )
    return sums.select(
        "doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + 0.5 * (distinct + 1)))).alias("base_score"),
        (F.col("score") - F.col("outside") * F.lit(math.log10(lexicon.outside))).alias("score"),
    )


def scored_documents(docs: DataFrame) -> DataFrame:
    return score(docs, fold("doc_id", 5) != 1).select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
