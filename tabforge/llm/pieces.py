"""Operator 7, SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each character the automaton's state names the longest piece that ends there; its output links name the shorter ones,
and each relaxes the best score at that position. A character that no piece covers alone costs `min score - 10` and is
written as byte pieces (or the unknown piece if the model has no bytes). Of equal scores the path by the longest last piece
stays. This is the best path by the pieces' scores; a model of merges, encoded by merging, may cut some words otherwise.

A text is cut first where no piece can cross: before a run of spaces, and around characters that occur in no piece of
two or more characters. Short parts are remembered in a bounded table of each worker, since words repeat.

Defined cases: a null or empty text has no pieces and is exact; a literal U+2581 decodes to a space, as in the library,
so such a text is exact up to that; a part without a cut may be as long as a text (16 bytes a character are kept while it is
worked on); repeated rows are encoded alike; an empty table gives an empty result. The model's
file is read on the driver only.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import text_slices

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(model_file: str = MODEL) -> dict:
    """Pieces of a model file: surface and score of each normal id, ids of the 256 bytes if any, and the unknown id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(p.get_piece_size())
    normal = [(p.id_to_piece(i), p.get_score(i), i) for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    byte = {int(p.id_to_piece(i)[1:-1], 16): i for i in ids if p.is_byte(i)}
    return {"normal": normal, "bytes": byte, "unknown": p.unk_id()}


class Codec(dict):
    """Encodes and decodes; as a dict it maps short parts of texts to their ids as int32 bytes."""

    REMEMBERED, SHORT, LONG = 300_000, 48, 4096

    def __init__(self, pieces: dict):
        self.byte, self.unknown = pieces["bytes"], pieces["unknown"]
        self.next: list[dict[str, int]] = [{}]
        self.depth, self.score, self.id = [0], [0.0], [-1]
        for piece, score, i in pieces["normal"]:
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[at] + 1)
                    self.score.append(0.0)
                    self.id.append(-1)
                at = to
            self.score[at], self.id[at] = score, i
        self.edge = {(a, c): b for a, to in enumerate(self.next) for c, b in to.items()}
        self.fail, self.out = [0] * len(self.next), [0] * len(self.next)
        level = list(self.next[0].values())
        while level:  # breadth first: links lead to shorter nodes, which are ready
            below = []
            for node in level:
                for c, to in self.next[node].items():
                    f = self.fail[node]
                    while f and c not in self.next[f]:
                        f = self.fail[f]
                    self.fail[to] = f = self.next[f].get(c, 0)
                    self.out[to] = f if self.id[f] >= 0 else self.out[f]
                    below.append(to)
            level = below
        self.rare = min((s for _, s, _ in pieces["normal"]), default=0.0) - 10
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, _, i in pieces["normal"]} | {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        self.parts = re.compile(self._cuts([p for p, _, _ in pieces["normal"]])).findall
        self.ends: dict[int, list[tuple[int, float, int]]] = {}

    @staticmethod
    def _cuts(pieces: list[str]) -> str:
        """Pattern of parts that no piece crosses.

        Cuts lie around characters of no longer piece, before spaces that follow another character, and before marks:
        characters that in every piece follow a space, another mark or nothing.
        """
        joins = {c for p in pieces if len(p) > 1 for c in p} - {SPACE}
        before = {(x, y) for p in pieces for x, y in zip(p, p[1:])}
        spaced = any(y == SPACE and x != SPACE for x, y in before)
        marks = {c for c in joins if not c.isalpha()}
        while bad := {y for x, y in before if y in marks and x not in marks and x != SPACE}:
            marks -= bad
        as_class = lambda s: "".join(map(re.escape, sorted(s))) or "\\x00"
        every, mark, rest = as_class(joins), as_class(marks), as_class(joins - marks)
        if spaced:
            return f"[^{every}{SPACE}]|[{every}{SPACE}]+"
        return f"[^{every}{SPACE}]|{SPACE}*[{mark}]*[{rest}]+|{SPACE}*[{mark}]+|{SPACE}+"

    def _ending(self, state: int) -> list[tuple[int, float, int]]:
        """Pieces that end in a state, longest first, by its output links."""
        found, node = [], state if self.id[state] >= 0 else self.out[state]
        while node:
            found.append((self.depth[node], self.score[node], self.id[node]))
            node = self.out[node]
        self.ends[state] = found
        return found

    def _step(self, state: int, c: str) -> int:
        """Where failure links lead; kept as an edge for the next time if the character is in the automaton at all."""
        at = state
        while at and c not in self.next[at]:
            at = self.fail[at]
        to = self.next[at].get(c, 0)
        if to:
            self.edge[state, c] = to
        return to

    def best_path(self, part: str) -> list[int]:
        n = len(part)
        best, back, last = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        if n > self.LONG:  # 16 bytes a character instead of some 100
            best, back, last = array("d", best), array("i", back), array("i", last)
        edge, ends, rare, state = self.edge, self.ends, self.rare, 0
        for i, c in enumerate(part, 1):
            state = edge.get((state, c)) or self._step(state, c)
            found = ends.get(state)
            if found is None:
                found = self._ending(state)
            top = how = None
            for d, s, k in found:
                s += best[i - d]
                if top is None or s > top:
                    top, at, how = s, i - d, k
            if (not found or found[-1][0] > 1) and (top is None or best[i - 1] + rare > top):
                top, at, how = best[i - 1] + rare, i - 1, -1
            best[i], back[i], last[i] = top, at, how
        ids = []
        while n:
            a, i = back[n], last[n]
            ids.extend([i] if i >= 0 else [self.byte[b] for b in reversed(part[a:n].encode())] if self.byte else [self.unknown])
            n = a
        return ids[::-1]

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.best_path(part), np.int32).tobytes()
        if len(part) <= self.SHORT:
            if len(self) >= self.REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as int32 bytes; a space is put before a text that is not empty."""
        return b"".join(map(self.__getitem__, self.parts(SPACE + text.replace(" ", SPACE)))) if text else b""

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


_WORKER: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One automaton a worker and model."""
    if shared.value["key"] not in _WORKER:
        _WORKER.clear()
        _WORKER[shared.value["key"]] = Codec(shared.value)
    return _WORKER[shared.value["key"]]


def encode(docs: DataFrame, model_file: str = MODEL, text: str = "text", ids: str = "piece_ids", exact: str = "exact") -> DataFrame:
    """docs without the text column, with ids (array of int) and exact: whether decoding them gives the text. Narrow, no shuffle."""
    pieces = load_pieces(model_file)
    shared = docs.sparkSession.sparkContext.broadcast(pieces | {"key": hash((model_file, len(pieces["normal"])))})
    kept = [c for c in docs.columns if c not in (text, ids, exact)]

    def run(batches):
        codec = _codec(shared)
        for part, texts in text_slices(batches, text):
            words = [t.decode() for t in texts]
            found = [codec.encode(t) for t in words]
            flat = np.frombuffer(b"".join(found), np.int32)
            edge = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            same = [codec.decode(flat[a:b].tolist()) == t.replace(SPACE, " ") for t, a, b in zip(words, edge, edge[1:])]
            names = part.schema.names
            rest = [part.column(names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(edge), pa.array(flat)), pa.array(same)], [*kept, ids, exact])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), f"`{ids}` array<int>", f"`{exact}` boolean"])
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`")).mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str = MODEL, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """rows without ids, with the text that they encode; null ids give an empty text."""
    pieces = load_pieces(model_file)
    shared = rows.sparkSession.sparkContext.broadcast(pieces | {"key": hash((model_file, len(pieces["normal"])))})
    kept = [c for c in rows.columns if c not in (text, ids)]

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            names = batch.schema.names
            texts = [codec.decode(x or []) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in kept), pa.array(texts, pa.string())], [*kept, text])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept), f"`{text}` string"])
    return rows.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids}`")).mapInArrow(run, schema)


def encoded_documents(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    return encode(docs.select("doc_id", "text"), model_file).select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", "exact")
