import numpy as np

from sluice.operators import topics


def plain(v, k, rounds, seed):
    """The same updates on a dense matrix."""
    h = np.random.default_rng(seed).random((k, v.shape[1])) + 0.1
    w, errors = np.full((len(v), k), 1 / k), []
    for _ in range(rounds):
        w = w * (v @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        errors.append(((v - w @ h) ** 2).sum())
        h = h * (w.T @ v) / np.maximum(w.T @ w @ h, 1e-12)
    return h, w, errors


TEXTS = ["cats purr and cats sleep", "dogs bark and dogs run", "cats and dogs", "stocks fall and bonds rise", "bonds and stocks trade", "a b c", "", None, "Stocks RISE as bonds fall", "dogs sleep, cats run"] * 6


def test_factors_equal_numpy_and_errors_fall(spark):
    docs = spark.createDataFrame([(i % 50, t, 1) for i, t in enumerate(TEXTS)], "id long, text string, terms int").repartition(7)
    rows, terms = topics.tfidf_rows(docs, "id", "text", stop_words=["and"])
    assert "and" not in terms and terms == sorted(terms) and "stocks" in terms
    v = np.zeros((rows.count(), len(terms)))
    for i, r in enumerate(rows.collect()):
        v[i, r["terms"]] = r["weights"]
        assert abs(sum(x * x for x in r["weights"]) - 1) < 1e-9
    h, errors, _ = topics.factorise(rows, len(terms), 3, rounds=12, seed=5)
    want_h, _, want = plain(v, 3, 12, 5)
    assert np.allclose(h, want_h) and np.allclose(errors, want) and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))


def test_topics_part_the_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    best, found, _ = topics.fit_topics(docs, "id", "text", 2, rounds=25, stop_words=["and"])
    rows = {r["id"]: r for r in found.collect()}
    assert len(rows) == len(TEXTS) and rows[0]["topic"] == rows[1]["topic"] != rows[3]["topic"] == rows[4]["topic"] and rows[5]["topic"] is None and rows[6]["topic"] is None
    assert 0.5 <= rows[3]["confidence"] <= 1 and len(rows[3]["loads"]) == 2
    top = {r["topic"]: set() for r in best.collect()}
    for r in best.where("rank <= 3").collect():
        top[r["topic"]].add(r["term"])
    assert {"stocks", "bonds"} <= top[rows[3]["topic"]] and {"cats", "dogs"} <= top[rows[0]["topic"]]
    assert topics.fit_topics(docs.where("false"), "id", "text")[1].count() == 0
