"""Toxicity behind disguises: noisy-channel restoration, then a linear score of the restored words.

Every token is a lattice of what its characters may stand for: leetspeak signs for letters, signs
put between letters for nothing, long repetitions for one or two letters, and single letters with
spaces for one word. Viterbi decoding finds the reading that a character trigram model and the
channel's costs make likeliest. A token of plain letters has one path and stays as it is. Words and
word beginnings of the restored text are the features of a logistic regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.core.session import cut
from sluice.llm.common import fold, texts

#: Bound of the labelled sample that the classifier is fitted on.
SAMPLE_ROWS = 20_000
FEATURES = 400
LEAST_DOCS = 4
THRESHOLD = 0.3
RIDGE = 0.05
#: Share of the character model's mass that goes to words marking toxic training texts.
LEXICON_SHARE = 0.05
#: Tokens whose features a worker remembers before it starts anew.
MEMORY = 150_000

# Leetspeak signs and the letters they stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "µ": "u",
}
WILD = "aeiou"
_SUBSTITUTE, _DROP, _WILD, _JOIN, _ONCE = -0.7, -0.4, -2.0, -0.3, -0.2
_EDGE = "\"'`´.,;:?!()[]{}<>«»„“”‚‘’…"
_TRAIL = re.compile(r"([^\w\s])\1{2,}$|^([^\w\s])\2{2,}")
_SIGNS = re.compile(r"[@$]")
_LONG = re.compile(r"(.)\1\1")
_SPACED = re.compile(r" [^\W_](?: [^\W_]){2,}(?= )| (?:[\w@$!|+] ){2,}[\w@$!|+](?= )")
_LETTERS = {chr(97 + i): 1 + i for i in range(26)} | {chr(c): 27 + i for i, c in enumerate(x for x in range(0xDF, 0x100) if x != 0xF7)}
OTHER, A = 63, 64
_CODE = np.zeros(0x3000, np.uint8)
for _c in range(0x3000):
    if chr(_c).isalpha():
        _CODE[_c] = _LETTERS.get(chr(_c).lower(), OTHER)


def code(letter: str) -> int:
    return _LETTERS.get(letter, OTHER) if letter != " " else 0


def trigram_counts(text: str) -> np.ndarray:
    """Codes of all character trigrams; everything but letters is one boundary sign."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 0x3000, _CODE[np.minimum(points, 0x2FFF)], OTHER).astype(np.int64)
    codes = np.concatenate([[0, 0], codes[(codes > 0) | np.r_[True, codes[:-1] > 0]] if len(codes) else codes, [0]])
    return (codes[:-2] * A + codes[1:-1]) * A + codes[2:]


class CharModel:
    """Interpolated character trigrams; ``logp[a][b][c]`` is the log of c after a b."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(A, A, A).astype(np.float64)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + A)
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 20 * p2) / (three.sum(2, keepdims=True) + 20)
        self.logp = np.log(p3).tolist()


def options(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a token: for each place the strings it may stand for, with channel costs."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, j = token[i], i + 1
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if c == " ":
            out.append([(" ", 0.0), ("", _JOIN)])
        elif c.isalpha():
            out.append([(c * n, 0.0)] if n < 3 else [(c, _ONCE), (c * 2, 2 * _ONCE)])
        else:
            here = [(x * min(n, 2), _SUBSTITUTE) for x in LEET.get(c, "")]
            if n > 1:
                here += [(x, _SUBSTITUTE + _ONCE) for x in LEET.get(c, "")]
            if not c.isdigit():
                here += [("", _DROP)]
            if c in "*#%" and n == 1:
                here += [(x, _WILD) for x in WILD]
            out.append(here or [("", _DROP)])
        i = j
    return out


def decode(token: str, logp: list) -> str:
    """The likeliest reading of a token (or of single letters with spaces) under the model."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for here in [*options(token), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, read) in best.items():
            for piece, cost in here:
                x, y, total = a, b, score + cost
                for c in piece:
                    z = code(c)
                    if z or y:
                        total += logp[x][y][z]
                        x, y = y, z
                old = after.get((x, y))
                if old is None or total > old[0]:
                    after[x, y] = (total, read + piece)
        best = after
    return max(best.values())[1].strip()


@dataclass
class Restorer:
    """Tokens to restored words, with a bounded memory."""

    model: CharModel
    memory: dict = field(default_factory=dict)

    def words(self, token: str) -> tuple[str, ...]:
        core = token.strip(_EDGE)
        if core.isalpha() and not _LONG.search(core):
            return (core,)
        core = _TRAIL.sub("", core).strip(_EDGE)
        if core.isalpha() and not _LONG.search(core):
            return (core,)
        if not any(map(str.isalpha, core)):
            # Signs alone may spell a word, numbers don't.
            if len(core) < 3 or not _SIGNS.search(core) or not all(c in LEET for c in core):
                return ()
        found = decode(core, self.model.logp).split()
        before = token[: token.find(core)][-1:] if core else ""
        if before in ("!", "("):
            # A sign at the edge of a disguised word may be its first letter.
            found += decode(before + core, self.model.logp).split()
        return tuple(dict.fromkeys(found))

    def spaced(self, joined: str) -> list[str]:
        """Words read from runs of three or more single signs in space-joined text with edges.

        The run as one word counts beside the likeliest division.
        """
        found = []
        for m in _SPACED.finditer(joined):
            run = m[0].strip()
            words = self.memory.get(run)
            if words is None:
                words = self.memory[run] = tuple(w for w in (*decode(run, self.model.logp).split(), decode(run.replace(" ", ""), self.model.logp)) if len(w) > 2)
            found += words
        return found

    def restore(self, text: str) -> str:
        """The whole text with its disguises undone, lower case, words joined by single spaces."""
        tokens = text.lower().split()
        joined = f" {' '.join(tokens)} "
        joined = _SPACED.sub(lambda m: " " + decode(m[0].strip(), self.model.logp), joined)
        return " ".join(w for t in joined.split() for w in self.words(t))


def features(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four, five and six letters."""
    return (word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n))


@dataclass
class Model:
    chars: CharModel
    index: dict
    weights: np.ndarray
    bias: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "restorer"}

    def present(self, text: str) -> set[int]:
        """Indices of the features that the restored text has."""
        if not hasattr(self, "restorer") or len(self.restorer.memory) > MEMORY:
            self.restorer = Restorer(self.chars)
        restorer, index = self.restorer, self.index
        memory = restorer.memory
        tokens = text.lower().split()
        found: set[int] = set()
        for token in set(tokens):
            known = memory.get(token)
            if known is None:
                known = memory[token] = tuple({index[f] for w in restorer.words(token) for f in features(w) if f in index})
            if known:
                found.update(known)
        for word in restorer.spaced(f" {' '.join(tokens)} "):
            found.update(index[f] for f in features(word) if f in index)
        return found

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights[list(self.present(text))])))))


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character trigram counts over all whole texts, summed by Spark; ``A ** 3`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(A**3, np.int64)
        for batch in batches:
            for _, part in texts(batch.column(0)):
                total += np.bincount(trigram_counts(b"\n\n".join(part).decode("utf-8", "replace")), minlength=A**3)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["trigram", "n"])

    rows = docs.select(text_col).mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    out = np.zeros(A**3, np.int64)
    out[found["trigram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _select(sample: DataFrame, most: int, least: int):
    """The features that tell toxic training texts best, by chi-square, with their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Restorer(CharModel(np.zeros(A**3)))
        plain.words = lru_cache(MEMORY)(lambda t: (t.strip(_EDGE),) if t.strip(_EDGE).isalpha() else ())
        counts: tuple[dict, dict] = ({}, {})
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for start, part in texts(batch.column(0)):
                for i, text in enumerate(part):
                    seen = counts[toxic[start + i]]
                    for f in {f for t in set(text.decode("utf-8", "replace").lower().split()) for w in plain.words(t) for f in features(w)}:
                        seen[f] = seen.get(f, 0) + 1
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([counts[1].get(f, 0) for f in names], pa.int64()), pa.array([counts[0].get(f, 0) for f in names], pa.int64())], ["feature", "pos", "neg"])

    sums = sample.select("text", "toxic").mapInArrow(run, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    p, q = n.get(1, 0), n.get(0, 0)
    if not p or not q:
        return [], p, q
    odd = F.col("pos") * (q - F.col("neg")) - F.col("neg") * (p - F.col("pos"))
    chi = (p + q) * odd.cast("double") * odd / (F.lit(float(p)) * q * (F.col("pos") + F.col("neg")) * (p + q - F.col("pos") - F.col("neg")))
    rows = sums.where((F.col("pos") + F.col("neg") >= least) & (F.col("pos") + F.col("neg") < p + q)).withColumn("chi", chi).orderBy(F.desc("chi"), "feature").limit(most).collect()
    return rows, p, q


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES) -> Model:
    """Fit on ``labels`` (doc_id, toxic) of ``docs``; the character model reads all of ``corpus``.

    Labels that are null or not 0 or 1 are left out, repeated ones count as their largest. The
    sample is the ``sample_rows`` labels of the smallest id hashes. Without both classes the score
    is the share of toxic labels (0.5 where there are none).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    picked = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast(kind).alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id").where("text is not null")
    # A labelled id counts once, with the text of the smallest hash where rows share it.
    sample = cut(known.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    rows, p, q = _select(sample, n_features, LEAST_DOCS)
    counts = char_counts(corpus, text_col).astype(np.float64)
    marks = [r["feature"] for r in rows if not r["feature"].endswith("-") and len(r["feature"]) > 3 and r["pos"] * q > 4 * r["neg"] * p]
    for word in marks:
        own = np.bincount(trigram_counts(word), minlength=A**3)
        counts += own * (LEXICON_SHARE * (counts.sum() + 1) / len(marks) / own.sum())
    model = Model(CharModel(counts), {r["feature"]: i for i, r in enumerate(rows)}, np.zeros(len(rows)), float(np.log((p + 0.5) / (q + 0.5))))
    if not rows:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(shared.value.present(t.decode("utf-8", "replace"))) for _, part in texts(batch.column(1)) for t in part]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sets, pa.list_(pa.int32()))], ["doc_id", "toxic", "present"])

    found = sample.select("doc_id", "text", "toxic").mapInArrow(run, f"doc_id {kind}, toxic int, present array<int>").orderBy("doc_id").collect()
    x = np.zeros((len(found), len(rows) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(found):
        x[i, r["present"]] = 1
    y = np.array([r["toxic"] for r in found], np.float32)
    ridge = np.r_[np.full(len(rows), RIDGE), 1e-3].astype(np.float64)
    w = np.zeros(len(rows) + 1)
    for _ in range(12):
        p1 = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (p1 * (1 - p1) + 1e-6).astype(np.float32)
        step = np.linalg.solve((x.T * slope) @ x + np.diag(ridge), x.T @ (y - p1) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; null text is empty and scores the bias.

    Repeated rows stay repeated; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t.decode("utf-8", "replace")) for _, part in texts(batch.column(1)) for t in part]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def detect(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of the held fold are never read."""
    seen = labels.where(fold(F.col("doc_id"), folds) != held)
    model = train(docs, seen, docs)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
