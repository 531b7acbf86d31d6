"""Amounts of money that add up: shares by largest remainders, and taxes rounded by line or by invoice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate(df: DataFrame, keys: list[str], total: str, weight: str, order: list[str], places: int = 2, weight_places: int = 4) -> DataFrame:
    """Rows with ``share``, the part of their group's ``total`` by ``weight``, and ``absorbed``, whether a rest went to it.

    Shares are whole steps of ``places`` decimals and add up to the total. What is left after rounding down
    goes, a step each, to the rows of the largest remainders, ties to the first by ``order``. All
    arithmetic is in whole numbers: weights count to ``weight_places`` decimals. The total is the same
    in all rows of a group and a multiple of the step; weights aren't negative and not all zero; what is
    not so is an error, as are nulls. A group is one task's to rank.
    """
    units = (F.col(total).cast(f"decimal(20,{places})") * 10**places).cast("decimal(20,0)")
    parts = F.bround(F.col(weight).cast("decimal(30,10)") * 10**weight_places, 0).cast("decimal(16,0)")
    group = Window.partitionBy(*keys)
    rows = df.withColumns({"units_": units, "parts_": parts})
    rows = rows.withColumns({"all_": F.sum("parts_").over(group).cast("decimal(18,0)"), "least_": F.min("parts_").over(group), "low_": F.min("units_").over(group), "high_": F.max("units_").over(group)})
    bad = (
        F.when(F.col(total).isNull() | F.col(weight).isNull(), "null amounts or weights").when(F.col("least_") < 0, "a negative weight").when(F.col("all_") == 0, "weights of zero")
        .when(F.col("low_") != F.col("high_"), "several totals in one group").when(F.col("units_") / 10**places != F.col(total).cast("decimal(30,10)"), "a total that the step can't pay")
    )
    checked = rows.withColumn("units_", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("cannot allocate: "), bad)).cast("decimal(20,0)")).otherwise(F.col("units_")))
    product = F.col("units_") * F.col("parts_")
    # Rounding goes down, for a negative total away from zero.
    floor = F.expr("(units_ * parts_ - pmod(units_ * parts_, all_)) div all_")
    cut = checked.withColumns({"floor_": floor, "rest_": F.pmod(product, F.col("all_"))})
    short = F.col("units_") - F.sum("floor_").over(group)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rest_"), *order))
    marked = cut.withColumn("short_", short).withColumn("absorbed", (place <= F.col("short_")))
    share = ((F.col("floor_") + F.col("absorbed").cast("int")).cast("decimal(20,0)") / F.lit(10**places)).cast(f"decimal(20,{places})")
    return marked.select(*df.columns, share.alias("share"), "absorbed")


def tax_by_level(df: DataFrame, keys: list[str], net: str, rate: str, places: int = 2) -> DataFrame:
    """``<keys>, by_line, by_invoice, differs``: the tax rounded on every line and then added, and on the sum once.

    Half goes to the even step. The rate is one for each invoice. Lines with nulls take no part.
    """
    amount, share = F.col(net).cast("decimal(18,4)"), F.col(rate).cast("decimal(10,6)")
    rows = df.where(F.col(net).isNotNull() & F.col(rate).isNotNull())
    out = rows.groupBy(*keys).agg(F.sum(F.bround(amount * share, places)).alias("by_line"), F.bround(F.sum(amount) * F.max(share), places).alias("by_invoice"))
    kind = f"decimal(20,{places})"
    return out.select(*keys, F.col("by_line").cast(kind).alias("by_line"), F.col("by_invoice").cast(kind).alias("by_invoice"), (F.col("by_line") != F.col("by_invoice")).alias("differs"))


def chain_round(amount: Column, places: Sequence[int]) -> Column:
    """An amount rounded to one number of decimals after the other, half to even; not what rounding once gives."""
    out = amount
    for p in places:
        out = F.bround(out, p)
    return out
