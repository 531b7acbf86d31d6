"""Fixed-width records: byte slices, implied decimals, overpunch, packed decimals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Overpunched last digits.
POSITIVE, NEGATIVE = "{ABCDEFGHI", "}JKLMNOPQR"


@dataclass(frozen=True)
class Field:
    """``start`` counts bytes from 0; ``kind`` is text, int, decimal, overpunch, comp3 or date."""

    name: str
    start: int
    width: int
    kind: str = "text"
    scale: int = 0


def _value(raw: Column, f: Field) -> Column:
    if f.kind == "comp3":
        digits = F.hex(raw)
        sign = F.right(digits, F.lit(1))
        body = F.substring(digits, 1, 2 * f.width - 1)
        number = F.when(body.rlike("^[0-9]+$") & sign.isin("C", "D", "F"), body.cast("decimal(38,0)") * F.when(sign == "D", -1).otherwise(1))
        return (number / F.lit(10**f.scale)).cast(f"decimal(38,{f.scale})")
    text = F.decode(raw, "UTF-8")
    if f.kind == "text":
        return F.rtrim(text)
    if f.kind == "int":
        return F.trim(text).try_cast("long")
    if f.kind == "date":
        return F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd")).cast("date")
    if f.kind == "decimal":
        return (F.trim(text).try_cast("decimal(38,0)") / F.lit(10**f.scale)).cast(f"decimal(38,{f.scale})")
    if f.kind == "overpunch":
        t = F.trim(text)
        last = F.right(t, F.lit(1))
        digit = F.translate(last, POSITIVE + NEGATIVE, "01234567890123456789")
        number = F.concat(F.substr(t, F.lit(1), F.length(t) - 1), digit).try_cast("decimal(38,0)")
        return (number * F.when(F.instr(F.lit(NEGATIVE), last) > 0, -1).otherwise(1) / F.lit(10**f.scale)).cast(f"decimal(38,{f.scale})")
    raise ValueError(f"unknown kind {f.kind}")


def parse_records(df: DataFrame, record: str, layout: list[Field]) -> DataFrame:
    """Columns of a binary record column; a value that its kind can't read is null."""
    return df.select(*[_value(F.substring(F.col(record), f.start + 1, f.width), f).alias(f.name) for f in layout])


def read_blocks(spark, path: str, width: int, layout: list[Field]) -> DataFrame:
    """Files of fixed-length records without line ends. Files must fit a task; split larger ones."""
    files = spark.read.format("binaryFile").load(path).select("content")
    n = F.floor(F.length("content") / width).cast("int")
    rows = files.select(F.explode(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda i: F.substr("content", i * width + 1, F.lit(width)))).alias("record"))
    return parse_records(rows, "record", layout)
