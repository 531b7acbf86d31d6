import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import simhash


def slow_fingerprint(text):
    tokens = text.encode().lower().split()
    grams = [b" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] if len(tokens) >= 3 else [b" ".join(tokens)] * bool(tokens)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abé \t\nC", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def components(prints):
    """The smallest id reached, by comparing everything with everything."""
    values = np.array([p for _, p in prints], np.uint64)
    group = list(range(len(values)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            group[root(i)] = root(int(j))
    least = {}
    for k, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return [least.get(root(k)) for k in range(len(prints))]


def test_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = simhash.near_duplicates(docs).orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(int(r["fingerprint"], 16) == slow_fingerprint(texts[r["doc_id"]]) for r in out[:60])
    assert [r["component_id"] for r in out] == components([(r["doc_id"], int(r["fingerprint"], 16)) for r in out])


def test_links_of_crowded_fingerprints(spark):
    rng = np.random.default_rng(4)
    middle = int(rng.integers(0, 1 << 62))
    made = set()
    while len(made) < 400:
        x = middle
        for k in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= 1 << int(k)
        made.add(x)
    made |= {int(v) for v in rng.integers(0, 1 << 63, 100)}
    values = sorted(made)
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash.near_links(prints).collect()
    want = components(list(enumerate(values)))
    group = list(range(len(values)))
    at = {v: i for i, v in enumerate(values)}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        i, j = at[a % (1 << 64)], at[b % (1 << 64)]
        assert bin(values[i] ^ values[j]).count("1") <= 3
        group[max(root(i), root(j))] = min(root(i), root(j))
    assert [root(i) for i in range(len(values))] == want


def test_awkward_rows(awkward, nothing):
    out = simhash.near_duplicates(awkward).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 9 and by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[3]["component_id"] == 2 and by[8]["component_id"] == 1 and by[None]["component_id"] is None
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.keep_one(awkward).collect())
    assert kept == [(False, 1), (False, 2), (False, 4), (False, 5), (False, 7), (True, 0)]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_spark_hash_agrees(spark):
    text = "ein zwei drei"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)
