"""Five-field cron schedules as Column expressions, and the minutes they fire at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.core.session import counted_small
from sluice.operators.text import let

#: Lines read, of some hundred bytes each, that may be broadcast.
FEW_LINES = 20_000

# The fields of a cron line and their ranges.
FIELDS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}
# Names that months and weekdays have.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "sun mon tue wed thu fri sat".split()
_ITEM = r"(\*|\d+(?:-\d+)?)(?:/[1-9]\d*)?"


def _numbers(field: Column, name: str) -> Column:
    """The sorted values of a field; null where the field has no such grammar or leaves its range."""
    least, most = FIELDS[name]
    text = F.lower(field)
    names = {"month": MONTHS, "weekday": WEEKDAYS}.get(name, [])
    for i, word in enumerate(names, least):
        text = F.regexp_replace(text, rf"\b{word}\b", str(i))

    def values(item: Column) -> Column:
        return let(F.struct(F.split_part(item, F.lit("/"), F.lit(1)).alias("span"), F.split_part(item, F.lit("/"), F.lit(2)).try_cast("int").alias("step")), ends)

    def ends(v: Column) -> Column:
        span, step = v["span"], v["step"]
        first = F.when(span == "*", least).otherwise(F.split_part(span, F.lit("-"), F.lit(1)).try_cast("int"))
        # A single number with a step runs to the end of the range.
        last = F.when((span == "*") | (step.isNotNull() & ~span.contains("-")), most).when(span.contains("-"), F.split_part(span, F.lit("-"), F.lit(2)).try_cast("int")).otherwise(first)
        return let(F.struct(first.alias("first"), last.alias("last"), F.coalesce(step, F.lit(1)).alias("step")), numbers)

    def numbers(v: Column) -> Column:
        first, last = v["first"], v["last"]
        fits = (first >= least) & (last <= most) & (first <= last)
        return F.when(fits, F.sequence(F.when(fits, first).otherwise(0), F.when(fits, last).otherwise(0), v["step"]))

    def whole(text: Column) -> Column:
        found = F.flatten(F.transform(F.split(text, ","), values))
        if name == "weekday":
            found = F.transform(found, lambda x: x % 7)
        return F.when(text.rlike(f"^{_ITEM}(?:,{_ITEM})*$"), F.array_sort(F.array_distinct(found)))

    return let(text, whole)


def parse_cron(line: Column) -> Column:
    """``struct`` of the five fields' values and ``either``: whether day and weekday are both restricted.

    Null where the line has not five fields or one does not read. Weekday 7 is Sunday, as is 0.
    """
    parts = F.split(F.trim(line), r"\s+")
    fields = {name: _numbers(F.get(parts, F.lit(i)), name) for i, name in enumerate(FIELDS)}
    reads = (F.size(parts) == 5) & F.greatest(*[x.isNull().cast("int") for x in fields.values()]).cast("boolean").eqNullSafe(False)
    either = ~F.get(parts, F.lit(2)).startswith("*") & ~F.get(parts, F.lit(4)).startswith("*")
    return F.when(reads, F.struct(*[x.alias(name) for name, x in fields.items()], either.alias("either")))


def fires(df: DataFrame, line: str, first: str, last: str) -> DataFrame:
    """Rows with ``fires_at`` for every minute from the day ``first`` to the day ``last`` that the schedule names.

    Where day and weekday are both restricted either will do, otherwise both must hold. Lines that
    do not read fire never. Each different line is read once, and its days filtered before hours and
    minutes are spread out; rows join what their line gave, which is broadcast if lines were counted to be few.
    """
    c = F.col("cron_")
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    by_day = lambda d: F.array_contains(c["day"], F.dayofmonth(d))
    by_weekday = lambda d: F.array_contains(c["weekday"], F.dayofweek(d) - 1)
    named = F.filter(days, lambda d: F.array_contains(c["month"], F.month(d)) & F.when(c["either"], by_day(d) | by_weekday(d)).otherwise(by_day(d) & by_weekday(d)))
    lines = df.select(F.col(line).alias("line_")).distinct().withColumn("cron_", F.explode(F.array(parse_cron(F.col("line_"))))).where("cron_ is not null")
    read = counted_small(lines.select("line_", named.alias("days_"), c["hour"].alias("hours_"), c["minute"].alias("minutes_")), FEW_LINES)
    spread = df.join(read, F.col(line) == F.col("line_")).withColumn("day_", F.explode("days_"))
    spread = spread.withColumn("hour_", F.explode("hours_")).withColumn("minute_", F.explode("minutes_"))
    at = F.col("day_").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour_"), F.col("minute_"))
    return spread.withColumn("fires_at", at).drop("line_", "days_", "hours_", "minutes_", "day_", "hour_", "minute_")
