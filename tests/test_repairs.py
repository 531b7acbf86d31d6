"""Cases that once came out wrong."""

import datetime

import pytest
from pyspark.sql import functions as F

from sluice.functions import privacy
from sluice.operators import governance, relations


def test_equal_facts_stay_apart(spark):
    day = datetime.datetime(2024, 1, 5)
    facts = spark.createDataFrame([(1, day), (1, day), (1, datetime.datetime(2023, 1, 1)), (2, day), (None, day)], "k int, at timestamp")
    versions = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1), "a"), (1, datetime.datetime(2024, 1, 2), datetime.datetime(2024, 2, 1), "late")], "k int, valid_from timestamp, recorded_at timestamp, v string")
    out = sorted(((r["k"], r["at"].year, r["v"]) for r in relations.bitemporal(facts, versions, "k", "at", F.col("at"), ["v"]).collect()), key=str)
    assert out == sorted([(1, 2024, "a"), (1, 2024, "a"), (1, 2023, None), (2, 2024, None), (None, 2024, None)], key=str)


def test_mask_counts_digits(spark):
    rows = [("123-45-6789", "*****6789"), ("+1 (555) 010-9999", "*******9999"), ("AB-12", "*B-12"), ("1234", "****"), ("ab", "**"), ("", ""), (None, None), ("abcdefgh", "****efgh")]
    out = spark.createDataFrame(rows, "v string, want string").select("want", privacy.mask_keep_last(F.col("v")).alias("got")).collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_paths_of_forty_levels(spark):
    text = '{"a":' * 20 + "[" * 20 + "1" + "]" * 20 + "}" * 20
    out = {r["path"]: (r["kind"], r["n"]) for r in relations.json_paths(spark.createDataFrame([(text,), ('{"a": 1}',), ("broken",)], "t string"), "t").collect() if r["path"] != "$.a" or r["kind"] == "object"}
    deep = "$" + ".a" * 20 + "[]" * 20
    assert out[deep] == ("number", 1) and out["$"] == ("object", 2) and len(out) == 41


def test_roll_up_of_many_levels(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(60)], "child string, parent string")
    posts = spark.createDataFrame([("0", 5.0)], "node string, amount double")
    out = {r["node"]: r["total"] for r in governance.roll_up(spark, edges, posts).collect()}
    assert out == {str(i): 5.0 for i in range(61)}
    with pytest.raises(Exception, match="(?i)recursion"):
        governance.roll_up(spark, edges, posts, max_depth=20).collect()


def test_prior_median_streams_over_a_hot_key(spark):
    import random
    import statistics as plain

    from sluice.operators import statistics

    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice([None, 1.0, 2.5, rng.random()])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, at int, v double").repartition(6)
    got = {r["at"]: r["baseline"] for r in statistics.prior_median(df, ["k"], "at", "v").collect()}
    assert len(got) == 700
    for k, at, _ in rows:
        before = [v for q, t, v in rows if q == k and t < at and v is not None]
        assert got[at] is None if not before else abs(got[at] - plain.median(before)) < 1e-12


def test_ladder_classes_are_the_texts_of_the_sql(spark, tmp_path):
    """Nation 1 with band 12 and nation 11 with band 2 are one text; a null makes the text null."""
    import duckdb

    from sluice.catalog import oracle_sql, queries

    rows = [(1, 1, 12000.0, "BUILDING"), (2, 11, 2000.0, "BUILDING"), (3, 1, None, "BUILDING"), (4, 2, None, "BUILDING"), (5, 2, -5.0, "BUILDING")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(oracle_sql()["kanon_ladder"]).fetchall()
    assert sorted(tuple(r) for r in queries()["kanon_ladder"](spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.parametrize("rows", [0, 12])
def test_ladder_tells_zeros_apart(spark, tmp_path, rows):
    """-0.0 and 0.0 are two texts; no customer is no level."""
    import duckdb

    from sluice.catalog import oracle_sql, queries

    balances = [-0.0, 0.0, 0.0, 999.0, -0.01, float("nan"), 0.0 * -1000, float("inf"), float("-inf"), 1e19, -1.2345678901234567e25, 9.007199254740993e18][:rows]
    df = spark.createDataFrame([(i, 1, v, "BUILDING") for i, v in enumerate(balances)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    df.write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(oracle_sql()["kanon_ladder"]).fetchall()
    assert sorted(tuple(r) for r in queries()["kanon_ladder"](spark, str(tmp_path)).collect()) == sorted(want)


def test_floors_have_the_text_of_the_sql(spark):
    import duckdb

    values = [-0.0, 0.0, -0.5, 0.5, 7.9, -7.9, 1e7, 1e15, 9.9e15, 1e16, -1e16, 1.5e300, 12345678901234567.0, float("inf"), float("-inf"), float("nan"), None]
    from sluice.queries.governance import floor_text

    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(floor_text(F.col("v"))).collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT floor(CAST(? AS DOUBLE)) || ''", [v]).fetchone()[0] for v in values]


def test_profile_repeats_no_rows(spark):
    from sluice.operators import quality

    out = quality.profile(spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string"))
    assert [tuple(r)[:6] for r in out.orderBy("column").collect()] == [("k", 3, 0, 2, "1", "2"), ("v", 3, 1, 2, "a", "b")]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_make_their_bits_once(spark):
    import base64
    import hashlib
    import hmac

    df = spark.createDataFrame([("Customer#1",), ("",), (None,)], "v string")
    out = df.select("v", *[privacy.token_value(F.col("v"), b"pepper", n).alias(f"t{n}") for n in (1, 12, 20, 52)])
    for r in out.collect():
        code = r["v"] is not None and base64.b32encode(hmac.new(b"pepper", r["v"].encode(), hashlib.sha256).digest()).decode().lower()
        assert all(r[f"t{n}"] == (f"tok_{code[:n]}" if code else None) for n in (1, 12, 20, 52))
    assert spark.range(2).select(privacy.token_value(F.col("id"), b"pepper"))._jdf.queryExecution().optimizedPlan().toString().count("conv(") < 9
