"""Token counts by a linear longest-match automaton.

Greedy longest-match-first word pieces of a word are counted without building them: one trie holds
the pieces that start words and, under a second root, those that continue them. The failure link of
a node says where matching goes on once the longest piece on its path is popped (repeatedly, if need
be), and a number beside it says how many pieces that pops. Links are folded into a full transition
table over bytes, so every byte of every word is one look-up; all words of a batch step together.
Pieces are whole UTF-8 strings, so matching bytes and matching characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import texts
from sluice.llm.pieces import SPACE, load


class Automaton:
    """Transition table ``go``, popped pieces ``pops`` and pieces at a word's end ``last`` (-1: none)."""

    def __init__(self, initial: set[bytes], continuing: set[bytes]):
        children: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        depth = [0, 0]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for b in piece:
                    nxt = children[at].get(b)
                    if nxt is None:
                        nxt = children[at][b] = len(children)
                        children.append({})
                        ends.append(False)
                        depth.append(depth[at] + 1)
                    at = nxt
                ends[at] = at > 1
        n = len(children)
        self.dead = n
        used = sorted({b for c in children for b in c})
        self.column = np.full(256, len(used), np.int64)
        self.column[used] = np.arange(len(used))
        width = len(used) + 1
        go = np.full((n + 1, width), self.dead, np.int32)
        # No move pops more pieces than its node has bytes.
        pops = np.zeros((n + 1, width), np.min_scalar_type(max(depth) + 1))
        fail = np.full(n + 1, self.dead, np.int64)
        popped = np.zeros(n + 1, np.int64)
        order = [0, 1]
        for at in order:
            order += children[at].values()
        parent = np.zeros(n, np.int64)
        byte = np.zeros(n, np.int64)
        for at, below in enumerate(children):
            for b, child in below.items():
                parent[child], byte[child] = at, self.column[b]
        self.ends = np.array(ends)
        level = np.array(depth)
        of_level = [np.flatnonzero(level == d) for d in range(max(depth) + 1)]
        below = [np.array([(at, self.column[b], c) for at in nodes for b, c in children[at].items()], np.int64).reshape(-1, 3) for nodes in (x.tolist() for x in of_level)]
        for d, nodes in enumerate(of_level):
            if d:
                up, column = parent[nodes], byte[nodes]
                # After the longest piece on the path: this node itself, or where its parent's link leads by the same byte.
                whole = self.ends[nodes]
                to = go[fail[up], column]
                fail[nodes] = np.where(whole, 1, to)
                popped[nodes] = np.where(whole, 1, popped[up] + pops[fail[up], column])
            # Without a child the move is the link's own move.
            go[nodes] = go[fail[nodes]]
            more = popped[nodes, None] + pops[fail[nodes]]
            pops[nodes] = np.where(go[nodes] == self.dead, 0, more)
            if len(below[d]):
                at, column, child = below[d].T
                go[at, column] = child
                pops[at, column] = 0
        self.go, self.pops = go, pops
        last = np.full(n + 1, -1, np.int64)
        last[1] = 0
        for nodes in of_level[1:]:
            rest = last[fail[nodes]]
            last[nodes] = np.where((fail[nodes] != self.dead) & (rest >= 0), popped[nodes] + rest, -1)
        self.last = last

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; a word that can't be divided counts as one unknown piece."""
        if not words:
            return np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        by = np.argsort(-size, kind="stable")
        size = size[by]
        flat = self.column[np.frombuffer(b"".join(words), np.uint8)]
        start = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))[:-1]][by]
        state = np.zeros(len(words), np.int64)
        total = np.zeros(len(words), np.int64)
        live = len(words)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size[:live], -step, side="left"))
            column = flat[start[:live] + step]
            total[:live] += self.pops[state[:live], column]
            state[:live] = self.go[state[:live], column]
        end = np.where(size > 0, self.last[state], 0)
        out = np.empty(len(words), np.int64)
        out[by] = np.where(end < 0, 1, total + end)
        return out


@dataclass
class Pieces:
    """Word-starting and continuing pieces; a worker builds their automaton once for all its tasks."""

    initial: set[bytes]
    continuing: set[bytes]

    @cached_property
    def automaton(self) -> Automaton:
        return Automaton(self.initial, self.continuing)


def vocabulary(path: str) -> Pieces:
    """The pieces of a SentencePiece model file, as UTF-8."""
    names = load(path).scores
    initial = {p[1:].encode() for p in names if p.startswith(SPACE) and len(p) > 1 and SPACE not in p[1:]}
    return Pieces(initial, {p.encode() for p in names if SPACE not in p})


def token_counts(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they stand; each takes its longest starting piece, then
    longest continuing pieces, and counts one if it can't be divided so. Null and empty texts have
    none. Repeated rows stay repeated; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton
        for batch in batches:
            for start, part in texts(batch.column(1)):
                words = [t.split() for t in part]
                n = np.fromiter(map(len, words), np.int64, len(words))
                every = [w for t in words for w in t]
                place = {w: i for i, w in enumerate(dict.fromkeys(every))}
                counts = automaton.count(list(place))[np.fromiter(map(place.__getitem__, every), np.int64, len(every))]
                ends = np.r_[0, np.cumsum(counts)]
                edge = np.r_[0, np.cumsum(n)]
                yield pa.record_batch([batch.column(0).slice(start, len(part)), pa.array(n), pa.array(ends[edge[1:]] - ends[edge[:-1]])], ["doc_id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
