"""Operator 1, toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Words are runs of letters and digits. A word's input is the vector of the word (or that of unknown words) plus the mean vector of its hashed runs of four bytes. The network reads
windows of `WINDOW` words that begin every `STRIDE` words, half a window, so a passage of up to `STRIDE + 1` words lies whole in
one wherever it stands; the last window ends with the text. Both directions run as one recurrence with block-diagonal weights. Attention pools the states of a
window into its logit; a text's logit is the largest of its windows, put on a probability scale by logistic calibration.

The network is trained in numpy on a bounded sample of labelled texts (`rows_per_class`, `max_bytes`), with the window
that scores highest standing for its text after the first pass. Scoring covers every window of every text.

Defined cases: a null or empty text has no window and gets the score of a window without words; a text shorter than a
window makes one masked window; repeated rows get equal scores up to the rounding of
32-bit floats; an empty table gives an empty result; without labels of
both classes the share of label 1 (0.5 if none) is every text's score. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import Words, fold, labelled_sample, text_slices

WINDOW, STRIDE = 32, 16
DIM, HIDDEN, ATTEND = 12, 8, 8
GRAM_BITS = 15
LEAST_STEPS, MOST_PASSES = 400, 48


@dataclass
class ToxicModel:
    """vocabulary: sorted hashes of the known words; p: parameters; scale and shift: calibration of the logit."""

    vocabulary: np.ndarray
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of each window, and its text; first: number of the first word of each text."""
    n = np.diff(first)
    count = np.where(n <= 0, 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1)
    text = np.repeat(np.arange(len(n)), count)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + np.minimum(inner * STRIDE, np.maximum(0, n[text] - WINDOW))
    return start, np.minimum(n[text], WINDOW), text


def _grams(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the runs of four bytes of each word in which, its ends marked, and how many each has (none for one byte)."""
    n = w.length[which] + 2
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.repeat(n, n)
    body = w.buf[np.clip(np.repeat(w.start[which], n) + inner - 1, 0, max(0, len(w.buf) - 1))]
    marked = np.where(inner == 0, 1, np.where(inner == size - 1, 2, body)).astype(np.uint32)
    run = marked[:-3] | (marked[1:-2] << np.uint32(8)) | (marked[2:-1] << np.uint32(16)) | (marked[3:] << np.uint32(24)) if len(marked) > 3 else np.zeros(0, np.uint32)
    bucket = ((run * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
    return bucket[(inner < size - 3)[: len(bucket)]], np.maximum(n - 3, 0)


def _char_means(w: Words, which: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Mean vector of the byte runs of the words in which."""
    bucket, n = _grams(w, which)
    out = np.zeros((len(which), c.shape[1]), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(c[bucket], (np.cumsum(n) - n)[full], axis=0) / n[full, None].astype(np.float32)
    return out


def _known(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary; its length for an unknown one."""
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashes, at, len(vocabulary)) if len(vocabulary) else np.zeros(len(hashes), np.int64)


def _inputs(w: Words, model: ToxicModel) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word in a table of input vectors, and the table, which has a row for each distinct word."""
    _, one, row = np.unique(w.hash, return_index=True, return_inverse=True)
    x = model.p["E"][_known(model.vocabulary, w.hash[one])] + _char_means(w, one, model.p["C"])
    return row.astype(np.int32), x


def _forward(xf: np.ndarray, xb: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, p: dict, kept: list | None = None) -> tuple:
    """States (window position, window, both directions), attention and logits. xf, xb: tables of gate inputs by direction."""
    n, steps, h = len(ids), ids.shape[1], HIDDEN
    s, states = np.zeros((n, 2 * h), np.float32), np.empty((steps, n, 2 * h), np.float32)
    gate = np.empty((n, 3, 2, h), np.float32)
    flat = gate.reshape(n, 6 * h)
    for t in range(steps):
        gate[:, :, 0] = xf[ids[:, t]]
        gate[:, :, 1] = xb[ids[:, steps - 1 - t]]
        zr = s @ p["Uzr"]
        zr += flat[:, : 4 * h]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, : 2 * h], zr[:, 2 * h :]
        c = (r * s) @ p["Uc"]
        c += flat[:, 4 * h :]
        np.tanh(c, out=c)
        if mask is not None:
            z = z * np.concatenate([np.repeat(mask[:, t, None], h, 1), np.repeat(mask[:, steps - 1 - t, None], h, 1)], 1)
        if kept is not None:
            kept.append((s, z, r, c, zr[:, : 2 * h]))
        s = s + z * (c - s)
        states[t, :, :h] = s[:, :h]
        states[steps - 1 - t, :, h:] = s[:, h:]
    u = np.tanh(states @ p["A"])
    e = (u @ p["v"])
    if mask is not None:
        e = np.where(mask.T > 0, e, -1e9)
    e = np.exp(e - e.max(0))
    if mask is not None:
        e *= mask.T
    alpha = e / np.maximum(e.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", alpha, states)
    return states, u, alpha, pooled, pooled @ p["w"] + p["b"]


def _gates(x: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    return (x @ p["Wf"] + p["bf"]).reshape(-1, 3, HIDDEN), (x @ p["Wb"] + p["bb"]).reshape(-1, 3, HIDDEN)


def window_logits(row: np.ndarray, x: np.ndarray, start: np.ndarray, size: np.ndarray, p: dict, at_once: int = 2048) -> np.ndarray:
    """Logit of each window; whole windows go without masks, shorter ones with."""
    out = np.empty(len(start), np.float32)
    xf, xb = _gates(x, p)
    for short in (False, True):
        which = np.flatnonzero((size < WINDOW) == short)
        for a in range(0, len(which), at_once):
            some = which[a : a + at_once]
            inner = np.arange(WINDOW)
            mask = (inner < size[some, None]).astype(np.float32) if short else None
            at = start[some, None] + (np.minimum(inner, size[some, None] - 1) if short else inner)
            out[some] = _forward(xf, xb, row[at], mask, p)[-1]
    return out


def text_logits(model: ToxicModel, texts: list[bytes]) -> np.ndarray:
    """Largest window logit of each text."""
    w = Words(texts, marks=False)
    out = np.full(len(texts), float(model.p["b"]))
    if len(w):
        start, size, text = _window_starts(w.first)
        row, x = _inputs(w, model)
        logits = window_logits(row, x, start, size, model.p)
        head = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[head]] = np.maximum.reduceat(logits, head)
    return out


def score_texts(model: ToxicModel, texts: list[bytes]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.scale * text_logits(model, texts) + model.shift, -60, 60)))


def _gradients(p: dict, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean logistic loss, by parameter and by row of x."""
    h, steps, n = HIDDEN, ids.shape[1], len(ids)
    kept: list = []
    xf, xb = _gates(x, p)
    states, u, alpha, pooled, logit = _forward(xf, xb, ids, mask, p, kept)
    d = ((_sigmoid(logit) - y) / n).astype(np.float32)
    g = {"w": pooled.T @ d, "b": d.sum()}
    dp = d[:, None] * p["w"]
    da = np.einsum("tbh,bh->tb", states, dp)
    dstates = alpha[:, :, None] * dp
    de = alpha * (da - (alpha * da).sum(0))
    g["v"] = np.einsum("tba,tb->a", u, de)
    du = de[:, :, None] * p["v"] * (1 - u * u)
    g["A"] = np.tensordot(states, du, ([0, 1], [0, 1]))
    dstates += du @ p["A"].T
    g["Uzr"], g["Uc"] = np.zeros_like(p["Uzr"]), np.zeros_like(p["Uc"])
    ds = np.zeros((n, 2 * h), np.float32)
    dxf, dxb = np.zeros((len(x), 3 * h), np.float32), np.zeros((len(x), 3 * h), np.float32)
    for t in reversed(range(steps)):
        s, z, r, c, plain = kept[t]
        ds = ds + np.concatenate([dstates[t, :, :h], dstates[steps - 1 - t, :, h:]], 1)
        m = np.concatenate([np.repeat(mask[:, t, None], h, 1), np.repeat(mask[:, steps - 1 - t, None], h, 1)], 1)
        dac = ds * z * (1 - c * c)
        daz = ds * m * (c - s) * plain * (1 - plain)
        drs = dac @ p["Uc"].T
        g["Uc"] += (r * s).T @ dac
        dar = drs * s * r * (1 - r)
        dzr = np.concatenate([daz, dar], 1)
        g["Uzr"] += s.T @ dzr
        ds = ds * (1 - z) + drs * r + dzr @ p["Uzr"].T
        dg = np.concatenate([dzr, dac], 1).reshape(n, 3, 2, h)
        np.add.at(dxf, ids[:, t], dg[:, :, 0].reshape(n, -1))
        np.add.at(dxb, ids[:, steps - 1 - t], dg[:, :, 1].reshape(n, -1))
    g["Uzr"] *= _BLOCKS
    g["Uc"] *= _BLOCK.reshape(2 * h, 2 * h)
    g["Wf"], g["bf"], g["Wb"], g["bb"] = x.T @ dxf, dxf.sum(0), x.T @ dxb, dxb.sum(0)
    return g, dxf @ p["Wf"].T + dxb @ p["Wb"].T


_BLOCK = np.kron(np.eye(2), np.ones((HIDDEN, HIDDEN))).astype(np.float32).reshape(2 * HIDDEN, 2, HIDDEN)
#: A direction's states meet its own columns alone, in the update gates of both directions and then in the reset gates.
_BLOCKS = np.concatenate([_BLOCK.reshape(2 * HIDDEN, 2 * HIDDEN)] * 2, 1)


def fit(sample: list[tuple[bytes, int]], odds: float | None = None, passes: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 11) -> ToxicModel:
    """Adam on windows, `passes` times over the texts, more often if that gives fewer than LEAST_STEPS steps. odds: label 1 to label 0 among all labelled rows, if the sample's differ."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    aside = sample[::5]  # judged after training, for the calibration
    sample = [x for i, x in enumerate(sample) if i % 5]
    y = np.array([b for _, b in sample], np.float32)
    texts = [a for a, _ in sample]
    w = Words(texts, marks=False)
    words, one, row, count = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
    vocabulary = words[count >= 5]
    u = lambda *s: rng.uniform(-0.35, 0.35, s).astype(np.float32)
    p = {"E": 0.3 * u(len(vocabulary) + 1, DIM), "C": 0.3 * u(1 << GRAM_BITS, DIM), "Wf": u(DIM, 3 * h), "Wb": u(DIM, 3 * h), "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32)}
    p |= {"Uzr": u(2 * h, 4 * h) * _BLOCKS, "Uc": u(2 * h, 2 * h) * _BLOCK.reshape(2 * h, 2 * h), "A": u(2 * h, ATTEND), "v": u(ATTEND), "w": u(2 * h), "b": np.float32(0)}
    model = ToxicModel(vocabulary, p)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    if not 0 < y.sum() < len(y) or not len(w):
        return ToxicModel(vocabulary, p, 0.0, float(np.log(share / (1 - share))))
    known = _known(vocabulary, words)
    start, size, text = _window_starts(w.first)
    head = np.flatnonzero(np.diff(text, prepend=-1))
    tail = np.append(head[1:], len(text))
    passes = max(passes, min(MOST_PASSES, -(-LEAST_STEPS * batch // (2 * len(head)))))
    moments: dict = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for turn in range(passes):
        if turn == 0:
            chosen = np.concatenate([rng.integers(head, tail) for _ in range(3)])
        else:
            logits = window_logits(row, p["E"][known] + _char_means(w, one, p["C"]), start, size, p)
            best = np.array([a + np.argmax(logits[a:b]) for a, b in zip(head, tail)])
            other = rng.integers(head, tail)
            chosen = np.concatenate([best, other[y[text[other]] == 0]])
        chosen = rng.permutation(chosen)
        total = passes * (len(chosen) // batch + 1)
        for a in range(0, len(chosen), batch):
            some = chosen[a : a + batch]
            inner = np.arange(WINDOW)
            mask = (inner < size[some, None]).astype(np.float32)
            used, ids = np.unique(row[start[some, None] + np.minimum(inner, size[some, None] - 1)], return_inverse=True)
            ids = ids.reshape(len(some), WINDOW)
            as_word = known[used]
            as_word[rng.random(len(used)) < 0.3] = len(vocabulary)  # trains the vector of unknown words
            x = p["E"][as_word] + _char_means(w, one[used], p["C"])
            g, dx = _gradients(p, x, ids, mask, y[text[some]])
            g["E"] = np.zeros_like(p["E"])
            np.add.at(g["E"], as_word, dx)
            bucket, n = _grams(w, one[used])
            g["C"] = np.zeros_like(p["C"])
            np.add.at(g["C"], bucket, np.repeat(dx / np.maximum(n, 1)[:, None].astype(np.float32), n, axis=0))
            step += 1
            lr = rate * max(0.05, 1 - step / total)
            for k, grad in g.items():
                m, v = moments[k]
                m = 0.9 * m + 0.1 * grad
                v = 0.999 * v + 0.001 * grad * grad
                moments[k] = (m, v)
                p[k] = (p[k] - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    if len({b for _, b in aside}) == 2:
        y, texts = np.array([b for _, b in aside], np.float32), [a for a, _ in aside]
    return _calibrated(model, text_logits(model, texts), y, odds)


def _calibrated(model: ToxicModel, logit: np.ndarray, y: np.ndarray, odds: float | None) -> ToxicModel:
    """Logistic regression of the label on the logit by Newton steps, the classes weighted to the odds among all labels."""
    ones, zeros = y.sum(), len(y) - y.sum()
    weight = np.where(y == 1, 1.0, (ones / zeros) / odds if odds else 1.0)
    x, b = np.stack([logit, np.ones(len(logit))], 1), np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        b -= np.clip(np.linalg.solve(hess, x.T @ (weight * (q - y)) + 1e-2 * (b - [1.0, 0.0])), -2, 2)
    return ToxicModel(model.vocabulary, model.p, float(b[0]), float(b[1]))


def train_toxicity(docs: DataFrame, labels: DataFrame, learn=None, rows_per_class: int = 1500, max_bytes: int = 12_000_000) -> ToxicModel:
    """Fit on at most rows_per_class labelled texts of each class and max_bytes of text; learn limits the rows by doc_id."""
    learn = F.lit(True) if learn is None else learn
    ones, zeros = labels.where(learn).select(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    return fit(labelled_sample(docs, labels, "toxic", learn, rows_per_class, max_bytes), ones / zeros if ones and zeros else None)


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and score of every row; narrow, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(shared.value, texts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the rows whose id is not in fold 0 of 5, then scores every row."""
    model = train_toxicity(docs, labels, fold("doc_id", 5) != 0)
    return score_toxicity(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
