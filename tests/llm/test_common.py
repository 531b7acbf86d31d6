from pyspark.sql import functions as F

from sluice.llm.common import labelled


def test_rows_of_heavy_keys_get_what_a_plain_join_gives(spark):
    key = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 501 != 0, F.col("id")).alias("k")
    rows = spark.range(3000).select("id", key)
    known = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    got = labelled(rows, known, "k")
    assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=str) == sorted(map(tuple, rows.join(known, "k", "left").select("id", "k", "v").collect()), key=str)
    assert got.where("k = 0").count() == 1500 and got.where("k is null").count() == 3
    assert labelled(rows.limit(0), known, "k").count() == 0
