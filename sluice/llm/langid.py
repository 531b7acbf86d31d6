"""Language identification by string kernels.

A text is the set of its distinct character n-grams of length 1 to 3 (a blended spectrum, presence
only). The kernel of two texts is the number of n-grams they share over the geometric mean of their
set sizes. Bounded landmarks give the Nystroem map ``K(x, L) W^(-1/2)``, and one-versus-rest kernel
ridge regression is fitted in that space on a bounded sample. Scoring is two matrix products a
batch: presence by landmark presence, then the folded map and coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import few, fold, texts

#: Bits of the space that n-grams are hashed into.
SPACE = 1 << 18
LANDMARKS_PER_LANG = 24
SAMPLE_PER_LANG = 300
RIDGE = 1e-2
BATCH = 256

_FOLD = np.arange(0x3000, dtype=np.uint32)
for _c in range(0x3000):
    _low = chr(_c).lower()
    _FOLD[_c] = ord(_low) if len(_low) == 1 and _low.isalpha() else 0


def grams(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of one text; ``seen`` is a zeroed scratch array of ``SPACE`` flags.

    Letters are lowered, everything else is one separator, runs of it included.
    """
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 0x3000, _FOLD[np.minimum(points, 0x2FFF)], points)
    points = np.concatenate([[0], points, [0]]).astype(np.uint32)
    points = points[(points != 0) | np.r_[True, points[:-1] != 0]]
    one = points * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (points[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (points[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    for part in (one, two, three):
        seen[(part ^ (part >> np.uint32(15))) >> np.uint32(14)] = 1
    found = np.flatnonzero(seen)
    seen[found] = 0
    return found


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, set(text.decode("utf-8", "replace"))))


@dataclass
class Model:
    """``place`` maps hashed n-grams to columns of ``landmarks`` (-1: in none)."""

    langs: list[str]
    place: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def scores(self, batch: list[bytes]) -> np.ndarray:
        seen = np.zeros(SPACE, np.uint8)
        present = np.zeros((len(batch), self.landmarks.shape[0]), np.float32)
        size = np.ones(len(batch), np.float32)
        for i, text in enumerate(batch):
            found = grams(text, seen)
            size[i] = max(1, len(found))
            at = self.place[found]
            present[i, at[at >= 0]] = 1
        kernel = (present @ self.landmarks) / np.sqrt(size[:, None] * self.sizes[None, :])
        return kernel @ self.weights

    def predict(self, batch: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and a score of 0 to 1: the softmax of the one-versus-rest values, sharpened."""
        raw = self.scores(batch) * 6
        soft = np.exp(raw - raw.max(1, keepdims=True))
        soft /= soft.sum(1, keepdims=True)
        best = soft.argmax(1)
        lettered = np.array([has_letter(t) for t in batch])
        langs = [self.langs[k] if ok else "und" for k, ok in zip(best, lettered)]
        return langs, np.where(lettered, soft[np.arange(len(batch)), best], 0.0).astype(np.float64)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG, landmarks_per_lang: int = LANDMARKS_PER_LANG) -> Model | None:
    """Fit on at most ``sample_per_lang`` distinct texts a language, those of the smallest hashes of id and text.

    Only rows under a hash that lets about twice the sample of a language through are ranked, and the
    sampled texts alone are read whole, so neither a task nor the driver holds more than the bound.
    Rows that share an id are told apart by text, repeated rows count once. Returns None where no
    row has a text with a letter and a language.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    usable = usable.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), F.xxhash64(id_col, text_col).alias("deal"))
    # One row a language: broadcast once counted to be few, so that no language's rows meet in one task.
    sizes = few(usable.groupBy("lang").agg(F.approx_count_distinct("deal", 0.02).alias("n")))
    # The hash is even over 64 bits; a language of few texts passes whole.
    reach = F.when(F.col("n") > 4 * sample_per_lang, (2.0 * sample_per_lang / F.col("n") - 0.5) * 2.0**64)
    pick = Window.partitionBy("lang").orderBy("deal", "doc_id")
    ids = (
        usable.drop("text")
        .join(sizes, "lang")
        .withColumn("reach", reach)
        .where(F.col("reach").isNull() | (F.col("deal") <= F.col("reach")))
        .select("lang", "doc_id", "text_hash", "deal")
        .distinct()
        .withColumn("rank", F.row_number().over(pick))
        .where(F.col("rank") <= sample_per_lang)
        .select("doc_id", "text_hash", "lang", "rank")
    )
    chosen = [((r["doc_id"], r["text_hash"]), r["lang"], r["rank"]) for r in ids.collect()]
    if not chosen:
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SPACE, np.uint8)
        for batch in batches:
            out = []
            for _, part in texts(batch.column(2)):
                out += [grams(t, seen).astype(np.int32).tobytes() if has_letter(t) else None for t in part]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "text_hash", "grams"])

    kind = labelled.schema[id_col].dataType.simpleString()
    wanted = F.broadcast(labelled.sparkSession.createDataFrame([c[0] for c in chosen], f"doc_id {kind}, text_hash long").distinct())
    rows = (
        usable.select("doc_id", "text_hash", "text")
        .join(wanted, ["doc_id", "text_hash"], "left_semi")
        .mapInArrow(read, f"doc_id {kind}, text_hash long, grams binary")
        .where("grams is not null")
        .groupBy("doc_id", "text_hash")
        .agg(F.first("grams").alias("grams"))
    )
    sets = {(r["doc_id"], r["text_hash"]): np.frombuffer(r["grams"], np.int32) for r in rows.collect()}
    chosen = sorted((c for c in chosen if c[0] in sets), key=lambda c: (str(c[1]), c[2]))
    if not chosen:
        return None
    langs = sorted({c[1] for c in chosen})
    marks = [sets[c[0]] for c in chosen if c[2] <= landmarks_per_lang] or [sets[chosen[0][0]]]
    columns = np.unique(np.concatenate(marks))
    place = np.full(SPACE, -1, np.int32)
    place[columns] = np.arange(len(columns), dtype=np.int32)

    def presence(lists: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(lists), len(columns)), np.float32)
        for i, x in enumerate(lists):
            at = place[x]
            out[i, at[at >= 0]] = 1
        return out

    landmarks = presence(marks).T.copy()
    sizes = np.array([max(1, len(x)) for x in marks], np.float32)
    own = (landmarks.T @ landmarks) / np.sqrt(sizes[:, None] * sizes[None, :])
    values, vectors = np.linalg.eigh(own.astype(np.float64))
    keep = values > 1e-6 * values.max()
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    lists = [sets[c[0]] for c in chosen]
    size = np.array([max(1, len(x)) for x in lists], np.float32)
    mapped = (presence(lists) @ landmarks / np.sqrt(size[:, None] * sizes[None, :])) @ nystroem
    goal = np.where(np.array([c[1] for c in chosen])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    ridge = np.linalg.solve(mapped.T @ mapped + RIDGE * len(lists) * np.eye(mapped.shape[1]), mapped.T @ goal)
    return Model(langs, place, landmarks, sizes, (nystroem @ ridge).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    A text that is null or has no letter, and any text under a model of nothing, is ``und`` with
    score 0. Repeated rows stay repeated; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for _, part in texts(batch.column(1)):
                for i in range(0, len(part), BATCH):
                    some = part[i : i + BATCH]
                    a, b = fitted.predict(some) if fitted else (["und"] * len(some), np.zeros(len(some)))
                    langs += a
                    scores += b.tolist()
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; rows of fold 0 are held out of training."""
    held = fold(F.col(id_col), folds) == 0
    model = train(docs.where(~held), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")
