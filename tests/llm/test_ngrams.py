import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import ngrams
from sluice.llm.eliasfano import EliasFano


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=200), st.lists(st.integers(0, 10**6 + 5), max_size=50), st.sampled_from([10**6 + 1, 1 << 30, 1 << 63]))
def test_elias_fano(values, asked, universe):
    values = np.sort(np.array(values, np.uint64))
    sequence = EliasFano.build(values, universe)
    assert (sequence.at(np.arange(len(values))) == values).all()
    x = np.concatenate([np.array(asked, np.uint64), values])
    at, equal = sequence.successor(x)
    want = np.searchsorted(values, x)
    assert (at == want).all()
    assert equal.tolist() == [w < len(values) and values[w] == q for w, q in zip(want, x)]


def brute(rows):
    """Counts and interpolated pairs in dictionaries."""
    words, pairs, texts, n = Counter(), Counter(), [], 0
    for doc_id, text in rows:
        w = [*(text or "").encode().lower().split(), b"\n"]
        texts.append((doc_id, w))
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10:
            words.update(w)
            pairs.update(zip([None, *w[:-1]], w))
            n += 1
    total, kinds = sum(words.values()), len(words)
    words[None] = n
    kept = defaultdict(float)
    for (a, _), k in pairs.items():
        kept[a] += (k - ngrams.DISCOUNT) / words[a]
    single = lambda w: (words[w] + 0.1) / (total + 0.1 * (kinds + 1))
    out = []
    for doc_id, w in texts:
        base = sum(math.log10(single(x)) for x in w)
        full = 0.0
        for a, b in zip([None, *w[:-1]], w):
            p = single(b)
            if words[a]:
                k = pairs[a, b]
                p = max(1 - kept[a], 1e-9) * p + ((k - ngrams.DISCOUNT) / words[a] if k else 0)
            full += math.log10(p)
        out.append((doc_id, len(w), sum(words[x] > 0 for x in w), total, base, full))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key)):
        assert g[:1] + g[2:5] == w[:4]
        assert math.isclose(g[5], w[4], rel_tol=1e-9) and abs(g[6] - w[5]) < 3e-4 * w[1]


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = ngrams.score_corpus(docs).collect()
    compare(out, brute([(r["doc_id"], r["text"]) for r in docs.collect()]))
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_awkward_texts(awkward, nothing):
    out = ngrams.score_corpus(awkward).collect()
    compare(out, brute([(r["doc_id"], r["text"]) for r in awkward.collect()]))
    assert ngrams.score_corpus(nothing).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = ngrams.score_corpus(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 3) and row["score"] == row["base_score"]


def test_a_context_of_a_third_of_all_pairs_lies_in_many_files(spark, tmp_path):
    import pandas as pd

    rows = [(i, " ".join(f"hot w{i * 40 + k} x{(i * k) % 97}" for k in range(40))) for i in range(300)]
    docs = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).repartition(6)
    model = ngrams.train(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"))
    store = ngrams.Store(model["folder"])
    words = ngrams.Words(store, model["base"])
    grid = ngrams.Grid(model["base"])
    hot = words.find(ngrams.digest([b"hot"]))[0]
    cells = [c for c in model["cells"] if c // grid.ranges == grid.range_of(hot)[0]]
    sizes = [len(store.get(f"pairs-{c}")["share"]) for c in cells]
    assert len(cells) == grid.ranges > 1 and max(sizes) < 1.3 * sum(sizes) / len(sizes)
    compare(ngrams.score_corpus(docs).collect(), brute(rows))


def test_a_lost_file_is_an_error(spark):
    import os

    import pytest

    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(50)], "doc_id long, text string")
    model = ngrams.train(docs)
    folder = model["folder"].removeprefix("file://").removeprefix("file:")
    os.rename(f"{folder}/pairs-{model['cells'][0]}", f"{folder}/gone")
    with pytest.raises(Exception, match="FileNotFoundError|No such file"):
        ngrams.score(docs, model).collect()
