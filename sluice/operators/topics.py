"""Topics of texts by non-negative factors of their TF-IDF weights.

The weights of a text are one row; the topics are a small matrix that the driver holds and sends to
every task. A round is one pass over the rows: each brings its text's loads up to date by the
topics of all rounds so far, and sends sums of the size of the topics. Nothing about a text is kept
between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.core.session import cut

_TINY = 1e-12


def tfidf_rows(docs: DataFrame, id_col: str, text_col: str, most_terms: int = 2000, least_docs: int = 2, most_share: float = 0.95, stop_words: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """``id, terms, weights`` of every text that has a term of the vocabulary, and the vocabulary.

    Terms are lower-case words of two or more letters or digits; those in fewer than ``least_docs``
    texts, in more than a share of ``most_share``, or stop words are left out, and of the rest the
    ``most_terms`` in most texts kept, ties by name. Weights are counts times
    ``ln((1 + n) / (1 + df)) + 1``, scaled to length one. Rows are texts: equal ids don't meet.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    counts = docs.select(F.col(id_col).alias("id"), words.alias("words"))
    n = docs.count()
    df = counts.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= least_docs) & (F.col("df") <= most_share * n))
    if stop_words:
        df = df.where(~F.col("term").isin(list(stop_words)))
    kept = sorted(df.orderBy(F.desc("df"), "term").limit(most_terms).collect(), key=lambda r: r["term"])
    vocabulary, idf = [r["term"] for r in kept], np.array([np.log((1 + n) / (1 + r["df"])) + 1 for r in kept])
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(vocabulary, pa.string()), idf))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = shared.value
        for batch in batches:
            at = pc.index_in(pc.list_flatten(batch.column(1)), terms)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())
            use = at.is_valid().to_numpy(zero_copy_only=False)
            found, times = np.unique(row[use] * len(terms) + at.drop_null().to_numpy(), return_counts=True)
            row, at = np.divmod(found, max(1, len(terms)))
            w = times * idf[at]
            w = w / np.sqrt(np.bincount(row, w * w, batch.num_rows))[row]
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            out = pa.record_batch([batch.column(0), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), w))], ["id", "terms", "weights"])
            yield out.filter(pc.greater(pc.list_value_length(out.column(1)), 0))

    kind = counts.schema["id"].dataType.simpleString()
    return cut(counts.mapInArrow(weigh, f"id {kind}, terms array<int>, weights array<double>")), vocabulary


def _flat(terms: pa.Array, weights: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and weights of all rows, which have one at least, and where each row starts."""
    sizes = pc.list_value_length(terms).to_numpy().astype(np.int64)
    return terms.flatten().to_numpy(), weights.flatten().to_numpy(), np.cumsum(sizes) - sizes


def _loads(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Topics by texts: their loads after a multiplicative update by each round's topics and their products."""
    topics = len(history[0][0])
    w = np.full((topics, len(starts)), 1.0 / topics)
    for h, square in history:
        seen = np.array([np.add.reduceat(row[terms] * weights, starts) for row in h])
        w = w * seen / np.maximum(square @ w, _TINY)
    return w


def factorise(rows: DataFrame, n_terms: int, topics: int, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, list[float], list]:
    """The topics by terms, the squared error before each change of them, and the history that loads need.

    ``rows`` has ``terms`` and ``weights``. The topics' size, ``topics * n_terms``, is what goes
    between driver and tasks, once for every round.
    """
    h = np.random.default_rng(seed).random((topics, n_terms)) + 0.1
    history, errors, spark = [], [], rows.sparkSession
    norm = rows.agg(F.sum(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    for _ in range(rounds):
        history.append((h, h @ h.T))
        shared = spark.sparkContext.broadcast(history)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            numerator, square = np.zeros((topics, n_terms)), np.zeros((topics, topics))
            for batch in batches:
                if batch.num_rows:
                    terms, weights, starts = _flat(batch.column(0), batch.column(1))
                    w = _loads(terms, weights, starts, shared.value)
                    each = np.repeat(w, np.diff(np.r_[starts, len(terms)]), axis=1) * weights
                    numerator += [np.bincount(terms, x, n_terms) for x in each]
                    square += w @ w.T
            both = np.concatenate([numerator.T, square.T])
            ends = np.arange(len(both) + 1, dtype=np.int32) * topics
            yield pa.record_batch([pa.array(np.arange(len(both))), pa.ListArray.from_arrays(pa.array(ends), pa.array(both.ravel()))], ["place", "sums"])

        added = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(topics)]
        total = rows.select("terms", "weights").mapInArrow(sums, "place long, sums array<double>").groupBy("place").agg(*added).toPandas().sort_values("place")
        both = total.drop(columns="place").to_numpy()
        if not len(both):
            return h, errors, history
        numerator, square = both[:n_terms].T, both[n_terms:].T
        errors.append(float(max(0.0, norm - 2 * (numerator * h).sum() + (square * (h @ h.T)).sum())))
        h = h * numerator / np.maximum(square @ h, _TINY)
    return h, errors, history


def fit_topics(docs: DataFrame, id_col: str, text_col: str, topics: int = 4, rounds: int = 20, seed: int = 0, **vocabulary) -> tuple[DataFrame, DataFrame, list[float]]:
    """``topic, rank, term, weight`` of every topic's terms, ``id, topic, confidence, loads`` of every text, and the errors.

    A text's topic is that of its largest load, and the confidence that load's share; loads are those
    of the topics before their last change. Texts without a term of the vocabulary have topic null.
    """
    rows, terms = tfidf_rows(docs, id_col, text_col, **vocabulary)
    spark, kind = docs.sparkSession, rows.schema["id"].dataType.simpleString()
    h, errors, history = factorise(rows, len(terms), topics, rounds, seed) if terms else (np.zeros((topics, 0)), [], [])
    ranked = [(k, r, terms[t], float(h[k, t])) for k in range(topics) for r, t in enumerate(np.argsort(-h[k], kind="stable").tolist(), 1)]
    shared = spark.sparkContext.broadcast(history)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = _loads(*_flat(batch.column(1), batch.column(2)), shared.value)
                ends = np.arange(batch.num_rows + 1, dtype=np.int32) * topics
                yield pa.record_batch([batch.column(0), pa.array(w.argmax(0).astype(np.int32)), pa.array(w.max(0) / np.maximum(w.sum(0), _TINY)), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.T.ravel()))], ["id", "topic", "confidence", "loads"])

    found = rows.mapInArrow(label, f"id {kind}, topic int, confidence double, loads array<double>")
    others = docs.select(F.col(id_col).alias("id")).exceptAll(rows.select("id")).select("id", F.lit(None).cast("int").alias("topic"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<double>").alias("loads"))
    return spark.createDataFrame(ranked, "topic int, rank int, term string, weight double"), found.union(others), errors
