import random

import corpus_pipeline as P
import pytest

from sluice.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8 if a or b else True


def by_brute_force(rows):
    """The smallest id that pairs of similarity 0.8 or more reach, comparing everything with everything."""
    sets = [grams(t) for _, t in rows]
    group = {i: i for i, _ in rows}
    for k, (i, _) in enumerate(rows):
        for m in range(k):
            j = rows[m][0]
            if group[i] != group[j] and alike(sets[k], sets[m]):
                low, high = sorted((group[i], group[j]))
                group = {x: low if g == high else g for x, g in group.items()}
    return group


@pytest.fixture(scope="module")
def edited():
    """Texts with copies of a few edited words, chains of edits, copies of another case, and short and empty ones."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(40):
        text = [word() for _ in range(rng.choice((4, 30, 120, 300)))]
        for _ in range(rng.randint(1, 5)):
            rows.append((len(rows), " ".join(text)))
            for _ in range(len(text) // 60):
                text[rng.randrange(len(text))] = word()
    rows += [(len(rows), rows[0][1].upper()), (len(rows) + 1, ""), (len(rows) + 2, None), (len(rows) + 3, "one two"), (len(rows) + 4, "One  two")]
    rng.shuffle(rows)
    return rows


def test_components_against_all_pairs(spark, edited):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in edited], SCHEMA)
    want = by_brute_force([(i, t or "") for i, t in edited])
    assert dict(shingles.components(docs).collect()) == want


def test_stage_drops_edited_copies_that_fingerprints_miss(spark, edited):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in edited] + [(None, "no id", "en", "a", 1)], SCHEMA)
    want = set(by_brute_force([(i, t or "") for i, t in edited]).values())
    kept = [r["doc_id"] for r in P.near_duplicates(spark, docs, "").collect()]
    assert kept.count(None) == 1 and set(kept) - {None} <= want and len(kept) == len(set(kept))
    assert len(kept) < simhash.keep_one(docs).count()
    for i in want - set(kept):  # what else is left out has a fingerprint near a kept text
        assert i not in {r["doc_id"] for r in simhash.keep_one(docs).collect()}


def test_members_of_a_bucket_that_are_alike_but_not_to_its_smallest(spark, monkeypatch):
    # One band value for all: the star of the smallest id verifies nothing, the second round must compare the rest.
    monkeypatch.setattr(shingles, "sketches", lambda docs, *_: docs.selectExpr("doc_id", "doc_id whole", "array(7L) bands"))
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "something else altogether that is not like them"), (2, text), (3, text + " more"), (4, "and a third kind of text again here")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    assert dict(shingles.components(docs).collect()) == {1: 1, 2: 2, 3: 2, 4: 4}


def test_blocks_of_a_large_bucket(spark, edited):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in edited], SCHEMA)
    want = by_brute_force([(i, t or "") for i, t in edited])
    assert dict(shingles.components(docs, block=500).collect()) == want


def test_links_of_a_block_against_all_pairs():
    import numpy as np

    rng = random.Random(8)
    for _ in range(60):
        base = [rng.getrandbits(40) for _ in range(60)]
        sets = []
        for _ in range(25):
            own = [rng.getrandbits(40) if rng.random() < rng.choice((0.02, 0.1, 0.3)) else x for x in rng.choice([base, list(sets[-1]) if sets else base])]
            sets.append(np.unique(np.array(own, np.uint64)))
        labels = [rng.randrange(6) for _ in sets]
        group = list(labels)
        for x, y in shingles._block_links(labels, np.zeros(len(sets), int), sets, 0.8):
            assert shingles.jaccard(sets[x], sets[y]) >= 0.8
            group = [group[x] if g == group[y] else g for g in group]
        want = list(labels)
        for x in range(len(sets)):
            for y in range(x):
                if want[x] != want[y] and shingles.jaccard(sets[x], sets[y]) >= 0.8:
                    want = [want[x] if g == want[y] else g for g in want]
        assert len(set(group)) == len(set(want)) and len(set(zip(group, want))) == len(set(want))


def test_awkward_rows(spark, awkward, nothing):
    out = dict(shingles.components(awkward).distinct().collect())
    assert out == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 7: 7, 8: 1}
    assert shingles.components(nothing).count() == 0 and P.near_duplicates(spark, nothing, "").count() == 0


def test_stage_leaves_no_pair_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, "").collect()]
    assert by_brute_force(kept) == {i: i for i, _ in kept}
    assert len(kept) < simhash.keep_one(docs).count()


def test_struct_keys_in_open_buckets(spark, edited):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in edited], SCHEMA)
    want = by_brute_force([(i, t or "") for i, t in edited])
    found = shingles.components(simhash.row_keys(docs), "key").collect()
    assert {r["doc_id"]["id"]: r["component_id"]["id"] for r in found} == want
