import numpy as np
import pandas as pd
import pytest

from sluice.llm import ann


def brute(rows, every, k):
    out = {}
    for q, v in rows:
        if q % every == 0:
            ranked = sorted(((-float((np.array(x, float) * np.array(v, float)).sum()), i) for i, x in rows if i != q))[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = brute(rows, 20, 20), collect(ann.nearest(df))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert set(want) == set(got) and hits / (20 * len(want)) > 0.97
    exact = {(q, i): s for q in want for i, s in brute(rows, 20, len(rows))[q]} if len(rows) < 600 else None
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True) and len(found) == 20
        for i, s in found if exact is None else []:
            x, y = (np.array(dict(rows)[k], float) for k in (q, i)) if len(rows) < 600 else (None, None)
            assert x is None or s == pytest.approx((x * y).sum(), abs=1e-12)


def test_recall_on_unseen_blocks_and_in_a_tight_cluster(spark):
    """Six blocks whose codebooks saw a sixth of the rows; a third of them are slightly different copies of one vector."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(48000, 32))
    x[::3] = rng.normal(size=32) + 0.01 * rng.normal(size=(16000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = collect(ann.nearest(df, every=400))
    hits = {True: [], False: []}
    for q in range(0, len(x), 400):
        scores = x.astype(np.float64) @ x[q].astype(np.float64)
        scores[q] = -9
        hits[q % 3 == 0].append(len({i for i, _ in got[q]} & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(hits[True]) > 0.9 and np.mean(hits[False]) > 0.9


def test_ties_copies_and_broken_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(900)]
    broken = [(1001, None), (1002, []), (1003, [0.0] * 8), (1004, [float("nan")] * 8), (1005, [None] * 8), (1006, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    other = [(2000, [1.0, 2.0]), (2001, [2.0, 1.0])]
    df = spark.createDataFrame(rows + broken + other, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as block", "3 as score")
    got = collect(ann.nearest(df))
    want = brute(rows, 20, 20) | brute(other, 20, 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-9)


def test_doubles_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.1])], "vec_id long, embedding array<double>")
    assert collect(ann.nearest(df)) == {0: [(1, 0.5)]}
    assert ann.nearest(df.where("false")).count() == 0


def test_encoding_beats_greedy():
    x = np.random.default_rng(2).normal(size=(600, 16)).astype(np.float32)
    books = ann.train(x, 4, 32, 5)

    def error(beam):
        codes, _ = ann.encode(x, books, beam)
        return float(((x - sum(books[m][codes[:, m]] for m in range(4))) ** 2).sum())

    assert error(8) <= error(1) < float((x**2).sum())


def test_an_id_with_two_vectors_asks_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.5, 0.5, 0.5]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [tuple(r) for r in out] == [(0, 1, 2, 3.0), (0, 2, 1, 1.0)]


def test_tasks_hand_on_their_share_of_the_sample(spark):
    """The sample is that of the smallest hashes, and no task brings a whole one of its own."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 20000, 1, 8).select("id", F.array(F.col("id").cast("float")).alias("vector"))
    want = [r["vector"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(500).select("vector").collect()]
    seen = []
    cut = ann.cut
    ann.cut = lambda df: seen.append(df) or cut(df)
    try:
        assert [r["vector"] for r in ann._taught(rows, 20000, 500).collect()] == want
        assert [r["vector"] for r in ann._taught(rows.where("id < 300"), 300, 500).collect()] == [r["vector"] for r in rows.where("id < 300").orderBy(F.xxhash64("id"), "id").select("vector").collect()]
        # Rows of one id have one hash.
        assert ann._taught(rows.withColumn("id", F.lit(7).cast("long")), 20000, 500).count() == 500
    finally:
        ann.cut = cut
    assert "xxhash64" in seen[0]._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1]


def test_queries_are_not_broadcast_with_their_copies(spark):
    """However few, they are repeated for every block of the index, through the driver if broadcast."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(400)], "vec_id long, embedding array<float>")
    found = ann.nearest(df)
    assert found.count() == 400
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
