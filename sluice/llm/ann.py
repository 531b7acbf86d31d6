"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of codewords, one of each full-dimensional codebook, which are
trained on residuals and chosen by beam search. A query's inner products with all codewords form a
table; the sum of a vector's entries, scaled by its stored norm over that of its approximation,
scores it. The best of every block are scored again exactly, in double precision, on the vectors
themselves. Index rows and queries are dealt into blocks of bounded size by a hash of the id, and
every block of queries meets every block of the index once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.core.session import cut

BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors that the codebooks are trained on, those of the smallest id hashes.
SAMPLE = 8192
ROUNDS = 8
INDEX_BLOCK, QUERY_BLOCK = 8192, 2048
#: Distinct vectors of a block that are scored exactly for each query.
SHORTLIST = 320
QUERIES_AT_ONCE = 64


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Residual codebooks ``(books, words, dimension)``: k-means of what the books before leave."""
    draw = np.random.default_rng(seed)
    rest = sample.astype(np.float32).copy()
    out = np.zeros((books, words, sample.shape[1]), np.float32)
    for m in range(books):
        centre = rest[draw.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = (rest @ centre.T * -2 + (centre**2).sum(1)).argmin(1)
            total = np.zeros_like(centre)
            np.add.at(total, near, rest)
            n = np.bincount(near, minlength=words)
            centre[n > 0] = total[n > 0] / n[n > 0, None]
            idle = np.flatnonzero(n == 0)
            centre[idle] = rest[draw.choice(len(rest), len(idle))]
        out[m] = centre
        rest -= centre[(rest @ centre.T * -2 + (centre**2).sum(1)).argmin(1)]
    return out


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``(n, books)`` by beam search, and each vector's norm over its approximation's."""
    codes = np.zeros((len(vectors), len(books)), np.uint8 if books.shape[1] <= 256 else np.uint16)
    scale = np.ones(len(vectors), np.float32)
    squares = (books**2).sum(2)
    for start in range(0, len(vectors), chunk):
        x = vectors[start : start + chunk].astype(np.float32)
        n = len(x)
        rest, cost, path = x[:, None, :], (x**2).sum(1)[:, None], np.zeros((n, 1, 0), np.int64)
        for m, book in enumerate(books):
            total = cost[:, :, None] - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, rest.shape[1], -1) + squares[m]
            total = total.reshape(n, -1)
            keep = min(beam, total.shape[1])
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(total, best, 1)
            old, word = best // len(book), best % len(book)
            path = np.concatenate([np.take_along_axis(path, old[:, :, None], 1), word[:, :, None]], 2)
            rest = np.take_along_axis(rest, old[:, :, None], 1) - book[word]
        at = cost.argmin(1)
        codes[start : start + n] = path[np.arange(n), at]
        near = x - rest[np.arange(n), at]
        size = np.linalg.norm(near, axis=1)
        scale[start : start + n] = np.where(size > 0, np.linalg.norm(x, axis=1) / np.where(size > 0, size, 1), 0)
    return codes, scale


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(broken, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _packed(rows: DataFrame, block: int, books: np.ndarray | None, double: bool) -> tuple[DataFrame, int]:
    """``block, ids, vectors, codes, scale``: each block of rows as one row of binary columns."""
    numbers = np.float64 if double else np.float32

    def flush(at: int, ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        own, x = np.concatenate(ids), np.concatenate(vectors)
        codes, scale = encode(x, books) if books is not None else (np.zeros((0, 0), np.uint8), np.zeros(0, np.float32))
        return pa.record_batch([pa.array([v], t) for v, t in ((at, pa.int32()), (own.tobytes(), pa.binary()), (x.tobytes(), pa.binary()), (codes.tobytes(), pa.binary()), (scale.tobytes(), pa.binary()))], ["block", "ids", "vectors", "codes", "scale"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            block_of = batch.column(0).to_numpy()
            own = batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(numbers).reshape(batch.num_rows, -1)
            edge = np.flatnonzero(np.r_[True, block_of[1:] != block_of[:-1], True])
            for a, b in zip(edge[:-1], edge[1:]):
                if at is not None and block_of[a] != at:
                    yield flush(at, ids, vectors)
                    ids, vectors = [], []
                at = int(block_of[a])
                ids.append(own[a:b])
                vectors.append(x[a:b])
        if at is not None:
            yield flush(at, ids, vectors)

    blocks = max(1, -(-rows.count() // block))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "vector")
    return dealt.repartition("block").sortWithinPartitions("block", "id").mapInArrow(run, "block int, ids binary, vectors binary, codes binary, scale binary"), blocks


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scale: np.ndarray, books: np.ndarray, k: int, shortlist: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` best of one block: table look-ups, then exact inner products.

    Equal vectors stand in the shortlist once and bring their smallest ids, so copies can't crowd
    others out of it. The shortlist grows by all vectors whose looked-up score is as near to the
    last place as the errors seen in it, so slightly different ones can't either.
    """
    _, first, which = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    edge = np.searchsorted(which[order], np.arange(len(first) + 1))
    codes, scale, distinct = codes[first], scale[first], vectors[first].astype(np.float64)
    few = min(shortlist, len(first))
    for start in range(0, len(queries), QUERIES_AT_ONCE):
        some = queries[start : start + QUERIES_AT_ONCE].astype(np.float64)
        tables = np.einsum("qd,mkd->qmk", some.astype(np.float32), books, optimize=True)
        rough = np.zeros((len(some), len(first)), np.float32)
        for m in range(len(books)):
            rough += np.take(tables[:, m], codes[:, m], axis=1)
        rough *= scale
        picks = np.argpartition(-rough, few - 1, axis=1)[:, :few]
        for i, pick in enumerate(picks):
            exact = (distinct[pick] * some[i]).sum(1)
            if few > k + 1:
                # Whatever may reach the last place by the largest error seen is scored exactly too.
                last = np.partition(exact, few - k - 1)[few - k - 1]
                within = rough[i] >= last - np.abs(exact - rough[i, pick]).max()
                within[pick] = False
                more = np.flatnonzero(within)
                pick, exact = np.r_[pick, more], np.r_[exact, (distinct[more] * some[i]).sum(1)]
                best = exact >= np.partition(exact, len(exact) - k - 1)[len(exact) - k - 1]
                pick, exact = pick[best], exact[best]
            members = np.concatenate([order[edge[p] : edge[p + 1]][: k + 1] for p in pick])
            values = np.repeat(exact, np.minimum(edge[pick + 1] - edge[pick], k + 1))
            found = ids[members]
            other = found != query_ids[start + i]
            found, values = found[other], values[other]
            top = np.lexsort((found, -values))[:k]
            yield query_ids[start + i], found[top], values[top]


def _taught(rows: DataFrame, n: int, sample: int) -> DataFrame:
    """The ``sample`` rows of the smallest id hashes, of ``n``.

    Hashes under a threshold are ranked alone: every task hands on its share of them and not a whole
    sample. The driver is given the sample, ranked before.
    """
    own, share = F.xxhash64("id"), 1.25 * sample / n
    near = rows
    while share < 1:
        near = rows.where(own < F.lit(int(share * 2**64) - 2**63))
        if near.limit(sample).count() == sample:
            break
        near, share = rows, 4 * share
    return cut(near.orderBy(own, "id").limit(sample).select("vector"))


def _search(rows: DataFrame, queries: DataFrame, k: int, shortlist: int, double: bool, sample: int, n: int) -> DataFrame:
    taught = _taught(rows, n, sample).collect()
    books = train(np.array([r["vector"] for r in taught], np.float32))
    index, blocks = _packed(rows, INDEX_BLOCK, books, double)
    asked, _ = _packed(queries, QUERY_BLOCK, None, double)
    numbers = np.float64 if double else np.float32
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                raw = [batch.column(k)[row].as_buffer() for k in range(6)]
                query_ids, ids = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[2], np.int64)
                queries = np.frombuffer(raw[1], numbers).reshape(len(query_ids), -1)
                vectors = np.frombuffer(raw[3], numbers).reshape(len(ids), -1)
                codes = np.frombuffer(raw[4], np.uint8).reshape(len(ids), -1)
                got = list(_best(query_ids, queries, ids, vectors, codes, np.frombuffer(raw[5], np.float32), books, k, shortlist))
                n = [len(g[1]) for g in got]
                yield pa.record_batch([pa.array(np.repeat([g[0] for g in got], n).astype(np.int64)), pa.array(np.concatenate([g[1] for g in got]).astype(np.int64)), pa.array(np.concatenate([g[2] for g in got]))], ["query_id", "vec_id", "score"])

    # Copies of the queries, one for each block of the index, go by a shuffle: what they grow to isn't seen before.
    pairs = (
        asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
        .hint("merge")
        .join(index, "block")
        .select("query_ids", "queries", "ids", "vectors", "codes", "scale")
    )
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, shortlist: int = SHORTLIST, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``k``
    nearest other rows by inner product, in double precision, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    null ids. Vectors are compared with those of their own length. Rows with the query's own id
    aren't its neighbours; other repeated rows stand for themselves. Of several vectors of one id the
    shortest and then smallest asks. An empty table gives an empty result.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    double = vectors.schema[vector_col].dataType.elementType.simpleString() == "double"
    lengths = [tuple(r) for r in rows.groupBy(F.size("vector").alias("n")).count().orderBy("n").collect()]
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct(F.size("vector").alias("n"), "vector")).alias("v")).select("id", "v.vector")
    parts = [_search(rows.where(F.size("vector") == n), asked.where(F.size("vector") == n), k, shortlist, double, sample, rows_of) for n, rows_of in lengths]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts) if parts else empty
