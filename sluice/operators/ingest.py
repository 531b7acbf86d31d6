"""Ingest: clean headers and cells, flatten JSON, duplicate keys, line ends, partitioned writes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean a missing value.
NULL_TOKENS = ("", "na", "n/a", "null", "none", "nan", "-", "--", "?", "missing")


def clean_headers(names: list[str]) -> list[str]:
    """Snake case; repeated names get ``_2``, ``_3``."""
    out, seen = [], {}
    for n in names:
        base = re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", n.strip().lower())).strip("_") or "column"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def clean_table(df: DataFrame, numeric_share: float = 0.9) -> DataFrame:
    """Headers, trimmed cells, null words, empty rows and columns, repeated rows, numbers - in this order.

    One aggregation finds which columns are empty and which are numbers in ``numeric_share`` of
    their values; the rest is a projection.
    """
    out = df.toDF(*clean_headers(df.columns))
    texts = [f.name for f in out.schema if isinstance(f.dataType, T.StringType)]
    cell = lambda c: F.when(~F.lower(F.trim(F.col(c))).isin(*NULL_TOKENS), F.trim(F.col(c)))
    out = out.select([cell(c).alias(c) if c in texts else F.col(c) for c in out.columns]).na.drop("all")
    counted = out.agg(*[F.count(c).alias(f"n_{c}") for c in out.columns], *[F.count(F.col(c).try_cast("double")).alias(f"d_{c}") for c in texts]).first()
    kept = [c for c in out.columns if counted[f"n_{c}"]]
    numbers = {c for c in texts if counted[f"n_{c}"] and counted[f"d_{c}"] >= numeric_share * counted[f"n_{c}"]}
    return out.select(kept).dropDuplicates().select([F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in kept])


def flatten(df: DataFrame, arrays: str = "explode", pin: tuple[str, ...] = (), sep: str = ".") -> DataFrame:
    """Structs become dotted columns; arrays explode (nulls kept), are indexed (first three) or JSON text.

    ``pin`` names arrays that stay JSON whatever the mode, which holds the grain.
    """
    while True:
        field = next((f for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType))), None)
        if field is None:
            return df
        name, kind = field.name, field.dataType
        rest = [F.col(f"`{c}`") for c in df.columns if c != name]
        own = F.col(f"`{name}`")
        if isinstance(kind, T.StructType):
            df = df.select(*rest, *[own[f.name].alias(f"{name}{sep}{f.name}") for f in kind])
        elif name in pin or arrays == "json":
            df = df.select(*rest, F.to_json(own).alias(name))
        elif arrays == "index":
            df = df.select(*rest, *[F.try_element_at(own, F.lit(i + 1)).alias(f"{name}{sep}{i}") for i in range(3)])
        else:
            df = df.select(*rest, F.explode_outer(own).alias(name))


def duplicate_keys(text) -> F.Column:
    """Whether a JSON object's text repeats a top-level key; readers disagree on such objects.

    Strings are blanked and nested values removed first, so only the object's own keys are left.
    """
    keys = F.regexp_extract_all(text, F.lit(r'"([^"\\]*(?:\\.[^"\\]*)*)"\s*:'), F.lit(1))
    return F.size(keys) != F.size(F.array_distinct(keys))


def line_ends(text) -> F.Column:
    """``struct(crlf, lf, cr, style)``: counts of line ends, and mixed where more than one kind occurs."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf = F.regexp_count(text, F.lit("\n")) - crlf
    cr = F.regexp_count(text, F.lit("\r")) - crlf
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.struct(crlf.alias("crlf"), lf.alias("lf"), cr.alias("cr"), F.when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").when(cr > 0, "cr").otherwise("none").alias("style"))


def write_partitioned(df: DataFrame, path: str, ts: str, codec: str = "zstd") -> None:
    """Hive-partitioned Parquet by year and month of ``ts``; each month's rows are dealt over tasks
    by adaptive rebalancing, so a large month makes several files and a small one no splinters."""
    dated = df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts))
    dated.hint("rebalance", "year", "month").write.mode("overwrite").partitionBy("year", "month").option("compression", codec).parquet(path)


def bucket_backoff(attempt, base: float, cap: float, policy: str = "exponential") -> F.Column:
    """Seconds to wait before an attempt: constant, linear, exponential or fibonacci, up to a cap."""
    a = attempt.cast("double")
    phi = (1 + 5**0.5) / 2
    wait = {"constant": F.lit(base), "linear": F.lit(base) * a, "exponential": F.lit(base) * F.pow(F.lit(2.0), a - 1), "fibonacci": F.lit(base) * F.round(F.pow(F.lit(phi), a) / 5**0.5)}[policy]
    return F.least(F.lit(cap), wait)


def backfill_chunks(spark, start: str, end: str, unit: str = "day") -> DataFrame:
    """``chunk, begins, ends`` of the half-open range, by day, week or month, the last one clipped."""
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[unit]
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}' - interval 1 day, {step})")).alias("begins"))
    ends = F.least(F.expr(f"cast(begins + {step} as date)"), F.lit(end).cast("date"))
    return days.select(F.concat(F.lit(f"{unit}-"), F.date_format("begins", "yyyyMMdd")).alias("chunk"), "begins", ends.alias("ends"))
