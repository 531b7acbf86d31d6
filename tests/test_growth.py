"""Work that once grew faster than its input, held against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from sluice.operators import accessibility, panel, relations, text, topics
from sluice.queries import commerce


def plain_cache(rows, threshold):
    """All earlier rows of the label, one by one."""
    unit = {}
    for i, (_, _, _, v) in enumerate(rows):
        if v is not None and None not in v:
            n = 0.0
            for x in v:
                n += x * x
            unit[i] = [x / n**0.5 for x in v]
    out = {}
    for i, (key, at, label, _) in enumerate(rows):
        best = None
        for j, (source, before, other, _) in enumerate(rows):
            if i in unit and j in unit and label is not None and label == other and before < at and len(unit[i]) == len(unit[j]):
                s = 0.0
                for x, y in zip(unit[i], unit[j]):
                    s += x * y
                s = float("inf") if s != s else round(s, 6)
                if best is None or (s, -source) > best:
                    best = (s, -source)
        hit = best is not None and best[0] >= threshold
        out[key] = (hit, -best[1] if hit else None, best[0] if hit else None)
    return out


def test_semantic_cache_in_parts(spark):
    rng, rows = random.Random(4), []
    seeds = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(30)]
    for key in rng.sample(range(1000), 400):
        v = [x + rng.choice([0, 0, 1e-7, 0.3]) * rng.random() for x in rng.choice(seeds)]
        v = rng.choice([v] * 20 + [v[:4], [None, *v[1:]], None, [float("nan"), *v[1:]]])
        rows.append((key, rng.randrange(150), rng.choice(["a", "a", "a", "b", None]), v))
    df = spark.createDataFrame(rows, "key long, at int, label string, v array<double>").repartition(5)
    for part in (7, 100, 10_000):
        got = text.semantic_cache(df, "key", "at", "v", ["label"], 0.5, part).collect()
        assert {r["key"]: (r["hit"], r["source"], r["score"] if r["score"] is None or r["score"] == r["score"] else float("inf")) for r in got} == plain_cache(rows, 0.5)


def test_semantic_cache_hands_on_few_rows_of_copies():
    """A part of copies: each row hands on one source, and the products are of the distinct vectors alone."""
    n = 20_000
    v, at = np.tile([0.6, 0.8], (n, 1)), np.arange(n)
    found = list(text._cache_fronts(v, at, at, at, at))
    assert sum(len(x[0]) for x in found) == n - 1 and all((x[1] == 0).all() for x in found)


def plain_search(docs, queries, k):
    """All words of a key together, every document against every query."""
    bags, asked = {}, {}
    for key, t in docs:
        bags.setdefault(key, Counter()).update(re.findall("[a-z0-9]+", (t or "").lower()))
    for key, t in queries:
        asked.setdefault(key, Counter()).update(re.findall("[a-z0-9]+", (t or "").lower()))
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    out = set()
    for query, wanted in asked.items():
        q = {t: n * idf[t] for t, n in wanted.items() if t in idf}
        length, scores = math.sqrt(sum(x * x for x in q.values())), []
        for key, bag in bags.items():
            if key is not None and any(t in bag for t in q):
                w = {t: n / bag.total() * idf[t] for t, n in bag.items()}
                scores.append((-round(sum(w.get(t, 0) * x / length for t, x in q.items()) / math.sqrt(sum(x * x for x in w.values())), 9), key))
        out |= {(query, r, key, round(-s, 7)) for r, (s, key) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_search_hands_on_leading_pairs_alone(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(rng.choice(words[: rng.choice([5, 20, 60])]) for _ in range(rng.randrange(n)))
    docs = [(rng.choice([i, i, i, 7, None]), some(30)) for i in range(200)] + [(1000 + i, "w1 w2 w3") for i in range(50)] + [(2000, None), (2001, "")]
    queries = [(f"q{i}", some(8)) for i in range(12)] + [("copies", "w1 w2 w3"), (None, "w4 w5"), ("none", "unheard"), ("q1", "w7 w8")]
    frames = [spark.createDataFrame(docs, "id long, t string").repartition(3), spark.createDataFrame(queries, "q string, t string")]
    want = plain_search(docs, queries, 3)
    for asked, held, small in ((1 << 22, 100_000, 400_000), (100, 20, 400_000), (1 << 22, 50, 10)):
        monkeypatch.setattr(text, "_ASKED", asked)
        monkeypatch.setattr(text, "_HELD", held)
        monkeypatch.setattr(text, "SMALL_ROWS", small)
        assert {(r["query"], r["rank"], r["key"], round(r["score"], 7)) for r in text.search(*frames, "id", "t", "q", "t", 3).collect()} == want
    assert text.search(frames[0].where("false"), frames[1], "id", "t", "q", "t", 3).count() == 0


def test_values_are_grouped_before_collations_compare_them(spark):
    df = spark.createDataFrame([(w,) for w in ["a", "A", "a", "ä", "Ä", "b", None, "B"] * 9], "w string")
    out = relations.distinct_under(df, "w", ["UTF8_BINARY", "UTF8_LCASE", "UNICODE_CI"])
    assert {r["collation"]: r["n"] for r in out.collect()} == {"UTF8_BINARY": 6, "UTF8_LCASE": 3, "UNICODE_CI": 3}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("Expand") :], plan
    assert sorted(r["w"] for r in relations.once(df.select(F.collate("w", "UTF8_LCASE").alias("w")), "w").where("w is not null").collect()) == ["A", "B", "a", "b", "Ä", "ä"]


def test_loads_of_a_batch_at_once():
    rng = np.random.default_rng(3)
    dense = rng.random((9, 12)) * (rng.random((9, 12)) < 0.4)
    dense[:, 0] += 0.1
    row, terms = np.nonzero(dense)
    history = [(h, h @ h.T) for h in rng.random((4, 3, 12))]
    got = topics._loads(terms, dense[row, terms], np.searchsorted(row, np.arange(9)), history)
    want = np.full((9, 3), 1 / 3)
    for h, square in history:
        want = want * (dense @ h.T) / (want @ square)
    assert np.allclose(got.T, want)


def test_grades_walk_a_page_once(spark, monkeypatch):
    monkeypatch.setattr(accessibility, "ELEMENTS", 3)
    pages = spark.createDataFrame([(i, "<html lang='en'><title>x</title><h1>a</h1>" + "<img src='a'>" * (i % 5)) for i in range(40)] + [(40, None), (None, "<h2>b</h2>")], "id long, html string").coalesce(2)
    out = accessibility.grades(accessibility.elements(pages, "id", "html"))
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["page"]: (r["faults"], r["score"]) for r in out.collect()}
    assert len(got) == 42 and all(got[i] == (1 + i % 5, max(0, 97 - 10 * (i % 5))) for i in range(40))


def test_lags_over_the_borders_of_stretches(spark):
    """A step is sent once, or twice at the end of a stretch, not once for every lag."""
    steps = [t for t in range(-700, 700) if t % 97]
    df = spark.createDataFrame([(k, t, float(t), 0.0) for t in steps for k in (1, None)], "key int, t int, x double, y double").repartition(4)
    out = panel.lagged(df, ["key"], "t", ["x", "y"], 3)
    want = {t: [t - 1.0, t - 2.0, t - 3.0] for t in steps if all((t - k) % 97 and t - k >= -700 for k in (1, 2, 3))}
    rows = out.collect()
    assert len(rows) == 2 * len(want) and all(r["x_lags"] == want[r["t"]] for r in rows)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_allocated_orders_get_tasks_by_their_lines(spark, monkeypatch):
    """A task joins and sorts so many lines, however many there are; orders stay whole."""
    folder = "/root/testdata/sf0.001"
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = rows(commerce.allocated_order_totals(spark, folder))
    monkeypatch.setattr(commerce, "LINES", 300)
    out = commerce.allocated_order_totals(spark, folder)
    n = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert out.rdd.getNumPartitions() == 1 + n // 300 and rows(out) == want
