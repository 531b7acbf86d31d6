import math
import re

import pytest

from sluice.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Targets by refilling until none is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, everything = set(), share * sum(sizes.values())
    while True:
        left = everything - sum(limit * sizes[s] for s in full)
        open_ = sum(weight[s] for s in sizes if s not in full)
        now = {s: limit * sizes[s] if s in full else left * weight[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in full and now[s] >= limit * sizes[s]}
        if not over:
            return now
        full |= over


def solve(sizes, target, limit=2):
    """The multiplier by bisection."""
    total = sum(sizes)
    if target >= limit * total:
        return math.inf
    mean = sum(s * s for s in sizes) / total
    low, high = -500.0, 500.0
    got = lambda a: sum(s * min(limit, math.exp(min(a * s / mean, 700))) for s in sizes if s)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if got(middle) < target else (low, middle)
    return low


def check(rows, out):
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for _, text, source in rows:
        by.setdefault(source, []).append(size_of(text))
    want = targets({s: sum(v) for s, v in by.items()})
    root = {s: solve(by[s], want[s]) for s in by}
    got = {}
    for r, source in out:
        assert r["source_size"] == sum(by[source]) and r["target"] == pytest.approx(want[source], rel=1e-9, abs=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        got[source] = got.get(source, 0) + r["taken"]
        if want[source] < 2 * sum(by[source]) and r["size"]:
            mean = sum(s * s for s in by[source]) / sum(by[source])
            assert r["rate"] == pytest.approx(min(2, math.exp(root[source] * r["size"] / mean)), rel=1e-4)
    for source, words in got.items():
        assert abs(words - want[source]) <= max(by[source]) + 1


def test_table_against_bisection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    source = {r[0]: r[2] for r in rows}
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    check(rows, [(r, source[r["doc_id"]]) for r in out])
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_large_group_of_equal_sizes(spark):
    rows = [(i, "a b c", "s") for i in range(9000)] + [(10000 + i, "w " * (i % 40 + 1), "t") for i in range(300)] + [(20000 + i, "w " * 70, None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {r[0]: r[2] for r in rows}
    check(rows, [(r, source[r["doc_id"]]) for r in mixing.mix(df).collect()])


def test_awkward_rows(awkward, nothing):
    out = mixing.mix(awkward).collect()
    assert len(out) == 9 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert mixing.mixed(awkward).columns == awkward.columns


def test_unsettled_multipliers_are_an_error(spark):
    table = spark.createDataFrame([("a", 3, 5), ("a", 7, 2)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 29, 40.0)], "source string, source_size long, target double")
    with pytest.raises(RuntimeError, match="settle"):
        mixing.multipliers(table, targets, rounds=1)
