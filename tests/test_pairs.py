import itertools
import math
import random
import re
import types

import pyarrow as pa
import pytest

from sluice.operators import models, pairs


def plain(rows, k, least, unowned=False):
    """Every pair, one by one; a score of no known product is null."""
    of, norm = {}, {}
    for u, i, r in rows:
        if i is not None:
            of.setdefault((u, i), []).extend([] if r is None else [r])
    mean = {key: sum(v) / len(v) if v else None for key, v in of.items()}
    for (u, i), r in mean.items():
        if r is not None and (u is not None or unowned):
            norm[i] = norm.get(i, 0.0) + r * r
    shared, dot = {}, {}
    lists = {}
    for (u, i), r in mean.items():
        if u is not None:
            lists.setdefault(u, []).append((i, r))
    for found in lists.values():
        for (i, a), (j, b) in itertools.permutations(found, 2):
            shared[i, j] = shared.get((i, j), 0) + 1
            if a is not None and b is not None:
                dot[i, j] = dot.get((i, j), 0.0) + a * b
    best = {}
    for (i, j), n in shared.items():
        if n >= least:
            below = math.sqrt(norm[i]) * math.sqrt(norm[j]) if (i, j) in dot else 1.0
            s = None if (i, j) not in dot else dot[i, j] / below if below else math.nan
            best.setdefault(i, []).append((math.inf if s is None else -math.inf if s != s else -round(s, 9), j, s))
    return sorted((i, j, s if s is None or s != s else round(s, 9)) for i, l in best.items() for _, j, s in sorted(l, key=lambda t: t[:2])[:k])


def same(got, want):
    """Equal but for the last digit of a score and the places that it decides."""
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert (g[2] is None) == (w[2] is None) and (g[2] is None or g[2] != g[2] and w[2] != w[2] or abs(g[2] - w[2]) < 2e-9)


def drawn(seed, users, items, share):
    rng = random.Random(seed)
    return [(u, i, rng.choice([1.0, 2.0, 3.0, 5.0, 0.5, -1.0])) for u in range(users) for i in range(items) if rng.random() < share]


@pytest.mark.parametrize("blocks, packed, bits, least, k", [(1, 1000, 18, 1, 3), (3, 40, 4, 2, 4), (7, 5, 2, 2, 1), (7, 1, 6, 3, 100)])
@pytest.mark.parametrize("odd", [False, True])
def test_cells_have_all_pairs(monkeypatch, blocks, packed, bits, least, k, odd):
    """Packed lists, lists longer than a pack, items of more pairs than are sorted at a time; ratings null, NaN and 0."""
    monkeypatch.setattr(pairs, "PACKED", packed)
    monkeypatch.setattr(pairs, "SORTED_BITS", bits)
    monkeypatch.setattr(pairs, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    rows = drawn(blocks, 25, 30, 0.3)
    if odd:
        rng = random.Random(9)
        rows = [(u, i, 0.0 if i == 4 else None if i == 5 or rng.random() < 0.1 else r) for u, i, r in rows]
    batches = [pa.RecordBatch.from_pylist([dict(user=u, at=i, r=r) for u, i, r in rows[a : a + 17]], pa.schema([("user", "int64"), ("at", "int64"), ("r", "float64")])) for a in range(0, len(rows), 17)]
    made = [r for b in pairs.pack(blocks)(batches) for r in b.to_pylist()]
    norm = {}
    for _, i, r in rows:
        norm[i] = norm.get(i, 0.0) + (r or 0.0) ** 2
    made += [dict(block=b, batch=None, norms=[math.sqrt(norm.get(i, 0.0)) for i in range(b, 30, blocks)]) for b in range(blocks)]
    schema = pa.schema([("lo", "int32"), ("hi", "int32"), ("block", "int32"), ("batch", "int64"), *[(c, pa.binary()) for c in ("n", "place", "code", "kinds")], ("norms", pa.list_(pa.float64()))])
    got = []
    for lo, hi in itertools.combinations_with_replacement(range(blocks), 2):
        cell = pa.RecordBatch.from_pylist([r | dict(lo=lo, hi=hi) for r in made if r["block"] in (lo, hi)], schema)
        got += [tuple(r.values()) for b in pairs.nearest(blocks, k, least)([cell]) for r in b.to_pylist()]
    ahead = lambda s: math.inf if s is None else -math.inf if s != s else -s
    kept = [r for _, found in itertools.groupby(sorted(got, key=lambda r: (r[0], ahead(r[2]), r[1])), lambda r: r[0]) for r in itertools.islice(found, k)]
    same(sorted(kept, key=lambda r: r[:2]), plain(rows, k, least))


def test_ties_go_to_the_smaller(monkeypatch):
    """The same with a buffer of candidates that is cut down many times."""
    import numpy as np

    rng = np.random.default_rng(3)
    item, other, score = rng.integers(0, 9, 500), rng.permutation(500), rng.choice([0.1, 0.2, 0.200000001, np.inf, -np.inf, -0.3], 500)
    for k in (1, 2, 7, 400):
        kept, last = pairs.ranked(item, other, score, k)
        want = {i: sorted(np.flatnonzero(item == i), key=lambda r: (-score[r], other[r]))[:k] for i in range(9)}
        assert kept.tolist() == [r for i in range(9) for r in want[i]]
        assert last.tolist() == [want[i][-1] for i in range(9) if len(want[i]) == k]


def test_similarity_of_odd_ratings(spark):
    """No user, no item, no rating, several ratings of one item, texts as items; more items than may be broadcast."""
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(20)]), rng.choice([None, *"abcdefghijkl"]), rng.choice([None, 1.0, 2.0, 4.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "u int, i string, r double").repartition(5)
    for unowned in (False, True):
        for small in (400_000, 3):
            held, models.SMALL_ROWS = models.SMALL_ROWS, small
            try:
                got = sorted((tuple(r) for r in models.item_similarity(df, "u", "i", "r", 4, 2, unowned).collect()), key=lambda r: r[:2])
            finally:
                models.SMALL_ROWS = held
            same(got, plain(rows, 4, 2, unowned))
    assert models.item_similarity(df.limit(0), "u", "i", "r", 4).collect() == []


def test_pairs_are_no_rows(spark):
    """No operator has a row for each pair, and none joins or groups by one."""
    df = spark.range(20).selectExpr("id % 4 AS u", "id AS i", "1.0D AS r")
    plan = models.item_similarity(df, "u", "i", "r", 2)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*, ", plan) and "product" not in plan and "MapInArrow" in plan
