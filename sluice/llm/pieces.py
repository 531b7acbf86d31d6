"""SentencePiece encoding and decoding by streaming Viterbi search.

The pieces of a model span a lattice over the text. In a unigram model its best path by log
probabilities is the encoding. Scores of a BPE model are ranks of merges, not log probabilities, and
the path of the largest sum is not that model's encoding; there a step is open only if merges of a
piece and the one before it leave both as they are, and the only open path is the encoding.
The search keeps a window: a place can only be reached from the last ``longest`` characters, and as
soon as the backpointer paths of all places that can still be extended run through one boundary, the
ids up to it are committed and forgotten. Where no piece has the space sign behind another character
every space starts such a boundary, so words are searched one by one and remembered. Characters that
no piece covers become bytes, where the model has them, or the unknown id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import texts

SPACE = "▁"
#: Words of either generation that a worker remembers.
MEMORY = 100_000
#: Score of a character that no piece covers, below the least score.
UNKNOWN_PENALTY = 10.0
#: Pieces of a BPE model whose followers a worker remembers before it starts anew.
ROWS = 100_000
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Vocabulary:
    """Pieces with scores and ids; ``bytes_at`` are the ids of the 256 byte pieces, or None."""

    scores: dict[str, tuple[float, int]]
    bytes_at: list[int] | None
    unknown: int
    names: list[str]
    bpe: bool = False

    def __post_init__(self):
        self.longest = max(map(len, self.scores), default=1)
        self.least = min((s for s, _ in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.byte_of = {i: b for b, i in enumerate(self.bytes_at or [])}

    @cached_property
    def trie(self) -> dict:
        """From each character to (what may follow, score, id); score None where no piece ends."""
        root: dict = {}
        for piece in sorted(self.scores):
            at = root
            for c in piece[:-1]:
                at = at.setdefault(c, ({}, None, -1))[0]
            at[piece[-1]] = (at.get(piece[-1], ({},))[0], *self.scores[piece])
        return root

    @cached_property
    def fits(self) -> dict[str, dict[str, bool]]:
        """Which pieces of a BPE model may follow a piece, as far as was asked."""
        return {}

    @cached_property
    def encoder(self) -> Encoder:
        """One encoder, with its memory of words, for all tasks of a worker."""
        return MergeEncoder(self) if self.bpe else Encoder(self)

    @cached_property
    def decoder(self) -> Decoder:
        return Decoder(self)


def load(path: str) -> Vocabulary:
    """Read a SentencePiece model file on the driver; its piece list is what tasks receive."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    names = [model.id_to_piece(i) for i in every]
    plain = {names[i]: (model.get_score(i), i) for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    octets = [i for i in every if model.is_byte(i)]
    bpe = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
    return Vocabulary(plain, octets if len(octets) == 256 else None, model.unk_id(), names, bpe)


@dataclass
class Window:
    """One streaming Viterbi search; ``widest`` is the largest number of places held so far."""

    vocabulary: Vocabulary
    ids: list[int] = field(default_factory=list)
    widest: int = 0

    def _short(self, text: str) -> list[int]:
        """The same search for a text that fits the window whole: nothing can be committed earlier."""
        trie, least, n = self.vocabulary.trie, self.vocabulary.least, len(text)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            here, node, j = best[i], trie, i
            for c in text[i:]:
                hit = node.get(c)
                if hit is None:
                    break
                j += 1
                node, score, piece = hit
                if score is not None and here + score > best[j]:
                    best[j], back[j] = here + score, (i, piece)
            if here + least > best[i + 1] and trie.get(text[i], (None, None))[1] is None:
                best[i + 1], back[i + 1] = here + least, (i, -1)
        self.widest = max(self.widest, n + 1)
        self._emit(text, 0, back, n)
        return self.ids

    def run(self, text: str, check: int = 64) -> list[int]:
        """Ids of a text; every ``check`` characters the joint part of all open paths is committed."""
        if len(text) <= check:
            return self._short(text)
        trie, least = self.vocabulary.trie, self.vocabulary.least
        base, best, back = 0, [0.0], [(0, -1)]  # for places from base on: score, (start, id)
        n = len(text)
        for i in range(n):
            here, node, j = best[i - base], trie, i
            while j < n and (hit := node.get(text[j])) is not None:
                j += 1
                node, score, piece = hit
                if score is not None:
                    self._offer(best, back, base, i, j, here + score, piece)
            if trie.get(text[i], (None, None))[1] is None:
                self._offer(best, back, base, i, i + 1, here + least, -1)
            if (i + 1 - base) % check == 0:
                base, best, back = self._commit(text, base, best, back, i + 1)
        self.widest = max(self.widest, len(best))
        self._emit(text, base, back, n)
        return self.ids

    @staticmethod
    def _offer(best: list, back: list, base: int, i: int, j: int, score: float, piece: int) -> None:
        while len(best) <= j - base:
            best.append(-np.inf)
            back.append((0, -1))
        if score > best[j - base]:
            best[j - base], back[j - base] = score, (i, piece)

    def _commit(self, text: str, base: int, best: list, back: list, at: int) -> tuple[int, list, list]:
        """Commit up to the last boundary through which the paths of all open places run."""
        self.widest = max(self.widest, len(best))
        fronts = {p for p in range(at, base + len(best)) if best[p - base] > -np.inf}
        while len(fronts) > 1:
            far = max(fronts)
            fronts.discard(far)
            fronts.add(back[far - base][0])
        joint = fronts.pop()
        if joint <= base or joint > at:
            return base, best, back
        self._emit(text, base, back, joint)
        return joint, best[joint - base :], [x and (max(x[0], joint), x[1]) for x in back[joint - base :]]

    def _emit(self, text: str, base: int, back: list, end: int) -> None:
        path = []
        while end > base:
            start, piece = back[end - base]
            path.append((start, end, piece))
            end = start
        for start, stop, piece in reversed(path):
            if piece >= 0:
                self.ids.append(piece)
            elif self.vocabulary.bytes_at is None:
                self.ids.append(self.vocabulary.unknown)
            else:
                self.ids += [self.vocabulary.bytes_at[b] for b in text[start:stop].encode("utf-8", "surrogatepass")]


def merged(text: str, scores: dict[str, tuple[float, int]]) -> list[str]:
    """The pieces that merges leave of a short text: the neighbours whose joint piece ranks first, the left ones among equals."""
    parts = list(text)
    found = [scores.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = -np.inf, -1
        for i, hit in enumerate(found):
            if hit is not None and hit[0] > best:
                best, at = hit[0], i
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del found[at]
        if at < len(found):
            found[at] = scores.get(parts[at] + parts[at + 1])
        if at:
            found[at - 1] = scores.get(parts[at - 1] + parts[at])


class MergeWindow(Window):
    """The streaming search for a BPE model: a step of the lattice is open or closed in place of having a score.

    A piece may follow another if merges of the two alone leave just these two; a chain of pieces is
    the model's encoding if every neighbouring pair is of that kind, and each place of a text is
    reached by exactly one such chain. So each place has one surviving path, and the boundary
    through which the paths of all open places run is committed as in the search by scores.
    """

    def _row(self, before: str) -> dict[str, bool]:
        """Which pieces may follow one, as far as was asked."""
        fits = self.vocabulary.fits
        row = fits.get(before)
        if row is None:
            if len(fits) > ROWS:
                fits.clear()
            row = fits[before] = {}
        return row

    def _fits(self, row: dict[str, bool], before: str, piece: str) -> bool:
        fit = row[piece] = merged(before + piece, self.vocabulary.scores) == ([before, piece] if before else [piece])
        return fit

    def _short(self, text: str) -> list[int]:
        trie, names, n = self.vocabulary.trie, self.vocabulary.names, len(text)
        back: list = [None] * (n + 1)
        last = [""] * (n + 1)
        for i in range(n):
            before, node, j = last[i], trie, i
            row = self._row(before)
            for c in text[i:]:
                hit = node.get(c)
                if hit is None:
                    break
                j += 1
                node, score, piece = hit
                if score is not None and back[j] is None:
                    name = names[piece]
                    fit = row.get(name)
                    if self._fits(row, before, name) if fit is None else fit:
                        back[j], last[j] = (i, piece), name
            if back[i + 1] is None and (trie.get(text[i]) or (None, None))[1] is None:
                fit = row.get(text[i])
                if self._fits(row, before, text[i]) if fit is None else fit:
                    back[i + 1], last[i + 1] = (i, -1), text[i]
        self.widest = max(self.widest, n + 1)
        self._emit(text, 0, back, n)
        return self.ids

    def run(self, text: str, check: int = 64) -> list[int]:
        if len(text) <= check:
            return self._short(text)
        trie, names = self.vocabulary.trie, self.vocabulary.names
        n, base = len(text), 0
        back: list = [(0, -1)]  # for places from base on: where the piece starts and its id, None where no path has come yet
        last = [""]  # the piece that ends there
        for i in range(n):
            before, node, j = last[i - base], trie, i
            row = self._row(before)
            while True:
                if j - base + 1 >= len(back):
                    back.append(None)
                    last.append("")
                if j == n or (hit := node.get(text[j])) is None:
                    break
                j += 1
                node, score, piece = hit
                if score is not None and back[j - base] is None:
                    name = names[piece]
                    fit = row.get(name)
                    if self._fits(row, before, name) if fit is None else fit:
                        back[j - base], last[j - base] = (i, piece), name
            if back[i + 1 - base] is None and (trie.get(text[i]) or (None, None))[1] is None:
                fit = row.get(text[i])
                if self._fits(row, before, text[i]) if fit is None else fit:
                    back[i + 1 - base], last[i + 1 - base] = (i, -1), text[i]
            if (i + 1 - base) % check == 0:
                start, back = self._settle(text, base, back, i + 1)
                last = last[start - base :]
                base = start
        self.widest = max(self.widest, len(back))
        self._emit(text, base, back, n)
        return self.ids

    def _settle(self, text: str, base: int, back: list, at: int) -> tuple[int, list]:
        reached = [0.0 if b is not None else -np.inf for b in back]
        base, _, back = self._commit(text, base, reached, back, at)
        return base, back


class Encoder:
    """Whole texts to id arrays (int32 bytes), remembering words where the model lets it."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # Words since the last change of generations, and those of the one before.
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        if not self.vocabulary.splits:
            return self._coded(text)
        words = _WORDS.findall(text)
        if len(self.memory) > MEMORY:
            self.memory, self.older = {}, self.memory
        memory = self.memory
        for word in set(words).difference(memory):
            memory[word] = self.older.get(word) or self._coded(word)
        return b"".join(map(memory.__getitem__, words))

    def _coded(self, text: str) -> bytes:
        return np.array(Window(self.vocabulary).run(text), np.int32).tobytes()


class MergeEncoder(Encoder):
    """As ``Encoder`` for BPE models."""

    def _coded(self, text: str) -> bytes:
        return np.array(MergeWindow(self.vocabulary).run(text), np.int32).tobytes()


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """Ids back to text: bytes are joined, space signs become spaces, the added first one goes."""
    names, byte_of = vocabulary.names, vocabulary.byte_of
    out = bytearray()
    for i in ids.tolist():
        b = byte_of.get(i)
        if b is None:
            out += names[i].encode()
        else:
            out.append(b)
    return out.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


class Decoder:
    """As ``decode``, one table look-up an id."""

    def __init__(self, vocabulary: Vocabulary):
        octets = vocabulary.byte_of
        self.table = [bytes([octets[i]]) if i in octets else name.replace(SPACE, " ").encode() for i, name in enumerate(vocabulary.names)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist())).removeprefix(b" ")


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, n_ids, n_bytes, round_trip`` of every whole text.

    ``round_trip`` tells whether the decoded ids give the text's bytes again; it is false only for
    texts that hold the space sign U+2581 itself. Null and empty texts have no ids. Repeated rows
    stay repeated; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared.value.encoder, shared.value.decoder
        for batch in batches:
            for start, part in texts(batch.column(1)):
                coded = [encoder.encode(t.decode("utf-8", "replace")) for t in part]
                n = np.array([len(c) // 4 for c in coded], np.int64)
                flat = np.frombuffer(b"".join(coded), np.int32)
                ends = np.cumsum(n)
                same = [decoder.decode(flat[e - k : e]) == t for e, k, t in zip(ends.tolist(), n.tolist(), part)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
                yield pa.record_batch([batch.column(0).slice(start, len(part)), lists, pa.array(n), pa.array([len(t) for t in part], pa.int64()), pa.array(same)], ["doc_id", "ids", "n_ids", "n_bytes", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids long, n_bytes long, round_trip boolean")
