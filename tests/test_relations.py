import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice import catalog
from sluice.functions import privacy
from sluice.operators import quality, relations, statistics

DATA = "/root/testdata/sf0.001"


def test_masks_of_short_and_odd_values(spark):
    df = spark.createDataFrame([("a@x.com", "12-34-56789", "no zip"), ("abc@x.com", "1234", "SW1A 12345"), ("nobody", "call 555", "1"), (None, None, None)], "mail string, phone string, zip string")
    out = df.select(privacy.mask_email(F.col("mail")), privacy.mask_keep_last(F.col("phone")), privacy.zip_prefix(F.col("zip"))).collect()
    assert [tuple(r) for r in out] == [("a*@x.com", "*****6789", None), ("a**@x.com", "****", "112**"), ("**body", "**** 555", "1"), (None, None, None)]


def test_a_bad_expression_fails_alone(spark):
    rules = [{"name": "ok", "type": "expression", "expr": "x > 0"}, {"name": "gone", "type": "expression", "expr": "nothing > 0"}, {"name": "broken", "type": "expression", "expr": "x >"}]
    out = {r["rule"]: (r["n_checked"], r["passed"]) for r in quality.run_rules(spark.range(3).withColumnRenamed("id", "x"), rules).collect()}
    assert out == {"ok": (3, False), "gone": (0, False), "broken": (0, False)}


def test_adjusted_p_values_against_a_loop(spark):
    rng = np.random.default_rng(3)
    p = np.r_[rng.random(400).round(2), [0.5] * 200, rng.random(50) ** 4]
    order = np.argsort(p, kind="stable")
    want, low = np.empty(len(p)), 1.0
    for k in range(len(p) - 1, -1, -1):
        low = min(low, p[order[k]] * len(p) / (k + 1))
        want[order[k]] = low
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(-1, None)], "key int, p double")
    out = {r["key"]: r["p_adjusted"] for r in statistics.benjamini_hochberg(df, "p", buckets=7).collect()}
    assert out.pop(-1) is None and [out[i] for i in range(len(p))] == pytest.approx(want)


def test_a_cycle_has_no_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    with pytest.raises(ValueError):
        relations.levels(edges, "a", "b", 6)


def test_pages_by_key_meet_every_row_once(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(20)], "a int, b int")
    seen, after = [], None
    while rows := [tuple(r) for r in relations.keyset_page(df, ["a", "b"], after, 6).collect()]:
        seen += rows
        after = rows[-1]
    assert seen == sorted((i % 3, i) for i in range(20))


def test_truncation_keeps_marks_and_wide_characters_whole(spark):
    df = spark.createDataFrame([("日本語のテキスト",), ("café au lait",), ("short",), ("",), (None,)], "t string")
    out = [r[0] for r in df.select(relations.truncate(F.col("t"), 7)).collect()]
    assert out == ["日本語…", "café a…", "short", "", None]


def test_principal_components_against_numpy(spark):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()], float)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    out = catalog.queries()["pca_embeddings"](spark, DATA).orderBy("component").collect()
    assert [r["variance"] for r in out] == pytest.approx((values / values.sum())[:5].tolist())


def test_queries_without_sql(spark):
    """What the four queries without SQL and without an operator test give on the smallest tables."""
    q = catalog.queries()
    found = q["pii_scan"](spark, DATA)
    assert found.count() > 0 and found.isEmpty() is False
    assert q["balanced_labels"](spark, DATA).count() > 0
    quality_ = q["text_classifier_quality"](spark, DATA).first().asDict()
    assert all(0 <= v <= 1 for v in quality_.values() if isinstance(v, float))
    assert q["customer_segments"](spark, DATA).count() > 0
