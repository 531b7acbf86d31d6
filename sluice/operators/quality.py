"""Data quality: rules, contracts, profiles, anomalies, diffs, reconciliation, fingerprints, upserts, survivorship."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.statistics import quantiles


def _mask(rule: dict, df: DataFrame) -> tuple[Column | None, Column]:
    """(violated, checked) of a row rule; None where a rule isn't one of rows."""
    column = F.col(rule["column"]) if rule.get("column") else None
    kind = rule["type"]
    if kind == "not_null":
        return column.isNull(), F.lit(True)
    if kind == "in_range":
        value = column.cast("string").try_cast("double") if hasattr(column, "try_cast") else F.expr(f"try_cast(`{rule['column']}` as double)")
        low, high = rule.get("min"), rule.get("max")
        outside = value.isNull()
        if low is not None:
            outside = outside | (value < low)
        if high is not None:
            outside = outside | (value > high)
        return column.isNotNull() & outside, column.isNotNull()
    if kind == "allowed_values":
        return column.isNotNull() & ~column.isin(list(rule["values"])), column.isNotNull()
    if kind == "regex_match":
        return column.isNotNull() & ~column.cast("string").rlike(f"^(?:{rule['pattern']})"), column.isNotNull()
    if kind == "expression":
        return ~F.coalesce(F.expr(rule["expr"]), F.lit(False)), F.lit(True)
    return None, F.lit(True)


def _analysable(df: DataFrame, expression: str) -> bool:
    """Whether a condition can be planned over the table; nothing is run."""
    try:
        return df.limit(0).select(F.expr(expression).cast("boolean")).schema is not None
    except (AnalysisException, ParseException):
        return False


def run_rules(df: DataFrame, rules: list[dict], references: dict[str, DataFrame] | None = None) -> DataFrame:
    """``rule, type, severity, n_checked, n_violations, passed``: one row per rule.

    All row rules are counted in one pass. Nulls pass every rule but ``not_null``; a number that
    can't be read violates ``in_range``; ``unique`` marks all members of a repeated value; a rule of
    a missing column, an unknown type or an expression that can't be planned fails with nothing checked.
    """
    spark = df.sparkSession
    plain, apart, failed = [], [], []
    for rule in rules:
        if rule.get("column") and rule["column"] not in df.columns:
            failed.append(rule)
        elif rule["type"] == "expression" and not _analysable(df, rule["expr"]):
            failed.append(rule)
        elif rule["type"] in ("not_null", "in_range", "allowed_values", "regex_match", "expression"):
            plain.append(rule)
        elif rule["type"] in ("unique", "foreign_key", "row_count"):
            apart.append(rule)
        else:
            failed.append(rule)
    schema = "rule string, type string, severity string, n_checked long, n_violations long, passed boolean"
    parts = []
    if plain:
        sums = []
        for i, rule in enumerate(plain):
            bad, checked = _mask(rule, df)
            sums += [F.count_if(checked).alias(f"c{i}"), F.count_if(bad).alias(f"v{i}")]
        rows = [F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["type"]).alias("type"), F.lit(r.get("severity", "error")).alias("severity"), F.col(f"c{i}").alias("n_checked"), F.col(f"v{i}").alias("n_violations")) for i, r in enumerate(plain)]
        parts.append(df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("passed", F.col("n_violations") == 0))
    for rule in apart:
        lead = [F.lit(rule["name"]).alias("rule"), F.lit(rule["type"]).alias("type"), F.lit(rule.get("severity", "error")).alias("severity")]
        if rule["type"] == "unique":
            groups = df.where(F.col(rule["column"]).isNotNull()).groupBy(rule["column"]).agg(F.count("*").alias("n"))
            counts = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_checked"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_violations"))
        elif rule["type"] == "foreign_key":
            known = (references or {})[rule["reference"]].select(F.col(rule.get("reference_column", rule["column"])).alias(rule["column"])).distinct().withColumn("known_", F.lit(True))
            joined = df.where(F.col(rule["column"]).isNotNull()).select(rule["column"]).join(known, rule["column"], "left")
            counts = joined.agg(F.count("*").alias("n_checked"), F.count_if(F.col("known_").isNull()).alias("n_violations"))
        else:
            n = df.agg(F.count("*").alias("n_checked"))
            low, high = rule.get("min", 0), rule.get("max")
            outside = (F.col("n_checked") < low) | (F.col("n_checked") > high if high is not None else F.lit(False))
            counts = n.withColumn("n_violations", outside.cast("long"))
        parts.append(counts.select(*lead, "n_checked", "n_violations", (F.col("n_violations") == 0).alias("passed")))
    if failed or not parts:
        parts.append(spark.createDataFrame([(r["name"], r["type"], r.get("severity", "error"), 0, 0, False) for r in failed], schema))
    return reduce(DataFrame.unionByName, parts)


def rollup(results: DataFrame) -> DataFrame:
    """``verdict``: FAIL if an error rule failed, else WARN if any failed, else PASS."""
    return results.agg(
        F.when(F.count_if(~F.col("passed") & (F.col("severity") == "error")) > 0, "FAIL").when(F.count_if(~F.col("passed")) > 0, "WARN").otherwise("PASS").alias("verdict"),
        F.count("*").alias("rules"), F.count_if(F.col("passed")).alias("passed_rules"),
    )


def profile(df: DataFrame) -> DataFrame:
    """``column, rows, nulls, distinct_values, low, high, mean`` of every column.

    All but the distinct values are one aggregation without groups; each column's values are grouped by
    themselves, so no row is repeated for every column.
    """
    names = df.columns
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte") or f.dataType.typeName().startswith("decimal")}
    sums, distinct = [], []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        sums += [F.count_if(c.isNull()).alias(f"n{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}"), (F.avg(c) if n in numeric else F.lit(None).cast("double")).alias(f"m{i}")]
        distinct.append(df.select(c.alias("v")).groupBy("v").agg(F.count("v").alias("n")).agg(F.count("v").alias(f"d{i}")))
    rows = [F.struct(F.lit(n).alias("column"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct_values"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), F.col(f"m{i}").alias("mean")) for i, n in enumerate(names)]
    # One row each.
    whole = reduce(DataFrame.crossJoin, [F.broadcast(d) for d in distinct], df.agg(F.count("*").alias("rows"), *sums))
    return whole.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def infer_tests(profiled: DataFrame) -> DataFrame:
    """``column, test``: not_null at under 2 % nulls, unique from 99 % distinct, relationships of ``*_id``."""
    filled = F.col("rows") - F.col("nulls")
    tests = F.filter(
        F.array(
            F.when(F.col("nulls") < F.lit(0.02) * F.col("rows"), "not_null"),
            F.when((filled > 0) & (F.col("distinct_values") >= F.lit(0.99) * filled), "unique"),
            F.when((F.col("distinct_values").between(2, 12)) & (F.col("distinct_values") < F.lit(0.99) * filled) & F.col("mean").isNull(), "accepted_values"),
            F.when(F.col("column").endswith("_id"), "relationships"),
        ),
        lambda t: t.isNotNull(),
    )
    return profiled.select("column", F.explode(tests).alias("test"))


def numeric_anomalies(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, value, zscore, modified_z, methods, severity``: rows that z, quartile fences or MAD flag.

    Nothing is flagged of fewer than five values or of one distinct value. Moments, exact quartiles and
    the median deviation are taken over counts of distinct values; the few numbers are literals after.
    """
    own = df.select(F.col(key).alias("key"), F.col(column).cast("double").alias("value")).where("value is not null and not isnan(value)")
    stats = own.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    q = quantiles(own, "value", [0.25, 0.5, 0.75]) or [0.0] * 3
    mad = (quantiles(own.select(F.abs(F.col("value") - q[1]).alias("far")), "far", [0.5]) or [0.0])[0]
    marked = own.join(F.broadcast(stats)).withColumns({"q": F.array(*map(F.lit, q)), "mad": F.lit(mad)}).where("n >= 5 and least < most")
    iqr = F.col("q")[2] - F.col("q")[0]
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd"))
    mz = F.when(F.col("mad") > 0, F.lit(0.6745) * (F.col("value") - F.col("q")[1]) / F.col("mad"))
    by_z, by_mad = F.coalesce(F.abs(z) > 3, F.lit(False)), F.coalesce(F.abs(mz) > 3.5, F.lit(False))
    by_iqr = (iqr > 0) & ((F.col("value") < F.col("q")[0] - 1.5 * iqr) | (F.col("value") > F.col("q")[2] + 1.5 * iqr))
    methods = by_z.cast("int") + by_iqr.cast("int") + by_mad.cast("int")
    size = F.abs(F.coalesce(z, mz, F.lit(0.0)))
    base = F.when(size >= 5, "high").when(size >= 4, "medium").otherwise("low")
    return marked.select("key", "value", z.alias("zscore"), mz.alias("modified_z"), methods.alias("methods"), F.when((methods >= 2) & (base != "low"), "high").otherwise(base).alias("severity")).where("methods > 0")


def rare_categories(df: DataFrame, column: str) -> DataFrame:
    """``value, n, share, severity`` of values on at most 1 % of rows (one row at least), from 20 rows on."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(0))
    marked = counts.withColumn("rows", F.sum("n").over(all_)).withColumn("kinds", F.count("*").over(all_))
    rare = marked.where((F.col("rows") >= 20) & (F.col("kinds") <= 0.5 * F.col("rows")) & (F.col("n") <= F.greatest(F.lit(1), F.floor(0.01 * F.col("rows")))))
    share = F.col("n") / F.col("rows")
    return rare.select("value", "n", share.alias("share"), F.when(F.col("n") == 1, "high").when(share < 0.005, "medium").otherwise("low").alias("severity"))


def null_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``pattern, n``: which columns are null together (the names, comma-joined), with their rows."""
    pattern = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))


def null_overlap(df: DataFrame, columns: list[str]) -> DataFrame:
    """``left, right, jaccard`` of the columns' null rows (0 where neither has any), in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = []
    for i, (a, b) in enumerate(pairs):
        sums += [F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"i{i}"), F.count_if(F.col(a).isNull() | F.col(b).isNull()).alias(f"u{i}")]
    rows = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.when(F.col(f"u{i}") > 0, F.col(f"i{i}") / F.col(f"u{i}")).otherwise(0.0).alias("jaccard")) for i, (a, b) in enumerate(pairs)]
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scorecard(df: DataFrame, key: str, numeric: str, timestamp: str, as_of: str, stale_days: int) -> DataFrame:
    """``dimension, score``: completeness, uniqueness, timeliness and distribution, 0 to 100, one decimal.

    Timeliness is 100 less the share of future stamps and half that of stale ones; distribution is
    100 less four times the share beyond three quartile ranges.
    """
    stats = df.agg(F.percentile(numeric, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    out = (F.col(numeric) < F.col("q")[0] - 3 * iqr) | (F.col(numeric) > F.col("q")[1] + 3 * iqr)
    at = F.to_timestamp(F.lit(as_of))
    cells = sum((F.count_if(F.col(c).isNotNull()) for c in df.columns), F.lit(0))
    one = df.join(F.broadcast(stats)).agg(
        F.round(100 * cells / (F.count("*") * len(df.columns)), 1).alias("completeness"),
        F.round(100 * F.count_distinct(key) / F.count("*"), 1).alias("uniqueness"),
        F.round(F.greatest(F.lit(0.0), 100 - 100 * F.count_if(F.col(timestamp) > at) / F.count("*") - 50 * F.count_if(F.col(timestamp) < at - F.expr(f"interval {stale_days} days")) / F.count("*")), 1).alias("timeliness"),
        F.round(F.greatest(F.lit(0.0), 100 - 400 * F.count_if(out) / F.count("*")), 1).alias("distribution"),
    )
    return one.select(F.expr("stack(4, 'completeness', completeness, 'uniqueness', uniqueness, 'timeliness', timeliness, 'distribution', distribution) as (dimension, score)"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``change, key, column, before, after``: added and removed keys, and changed cells of shared columns.

    Keys must be unique in both; a repeated key raises when the result is read. One full join.
    """
    shared = [c for c in before.columns if c in after.columns and c != key]

    def side(df: DataFrame, name: str) -> DataFrame:
        packed = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias(f"{name}_n"), F.first(F.struct(*[F.col(c).cast("string").alias(c) for c in shared])).alias(name))
        return packed.withColumn(f"{name}_n", F.when(F.col(f"{name}_n") > 1, F.raise_error(F.concat(F.lit(f"repeated key in {name}: "), F.col("key").cast("string")))).otherwise(F.col(f"{name}_n")))

    both = side(before, "old").join(side(after, "new"), "key", "full_outer")
    cell = lambda c: F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.struct(F.lit("modified").alias("change"), F.lit(c).alias("column"), F.col(f"old.{c}").alias("before"), F.col(f"new.{c}").alias("after")))
    whole = lambda kind: F.struct(F.lit(kind).alias("change"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    changes = F.when(F.col("old_n").isNull(), F.array(whole("added"))).when(F.col("new_n").isNull(), F.array(whole("removed"))).otherwise(F.filter(F.array(*[cell(c) for c in shared]), lambda x: x.isNotNull()))
    return both.select("key", F.explode(changes).alias("c")).select(F.col("c.change").alias("change"), "key", "c.column", "c.before", "c.after")


def reconcile(source: DataFrame, target: DataFrame, key: str, order: str, columns: list[str], tolerance: float = 0.01) -> DataFrame:
    """One row: ``source_rows, target_rows, missing, extra, mismatched_cells, match_rate`` and whether sums agree.

    Each side keeps its first row of a key by ``order``. Numbers agree within the tolerance, two
    nulls agree; sums within the tolerance times the rows. The rate is clean shared keys over all
    source rows, to four decimals.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("key")).agg(F.min_by(F.struct(*columns), order).alias(name), F.count("*").alias(f"{name}_n"))

    both = side(source, "s").join(side(target, "t"), "key", "full_outer")
    numeric = {f.name for f in source.schema if f.dataType.typeName() in ("integer", "long", "double", "float")}
    off = lambda c: ~((F.col(f"s.{c}").isNull() & F.col(f"t.{c}").isNull()) | F.coalesce(F.abs(F.col(f"s.{c}") - F.col(f"t.{c}")) <= tolerance if c in numeric else F.col(f"s.{c}") == F.col(f"t.{c}"), F.lit(False)))
    shared = F.col("s_n").isNotNull() & F.col("t_n").isNotNull()
    wrong = sum((off(c).cast("int") for c in columns), F.lit(0))
    counted = both.withColumn("wrong", F.when(shared, wrong))
    sums = [F.abs(F.coalesce(F.sum(f"s.{c}"), F.lit(0)) - F.coalesce(F.sum(f"t.{c}"), F.lit(0))) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.count("s_n"), F.lit(1))) for c in columns if c in numeric]
    rows = F.coalesce(F.sum("s_n"), F.lit(0))
    return counted.agg(
        rows.alias("source_rows"), F.coalesce(F.sum("t_n"), F.lit(0)).alias("target_rows"), F.count_if(F.col("t_n").isNull()).alias("missing"), F.count_if(F.col("s_n").isNull()).alias("extra"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("mismatched_cells"), F.round(F.count_if(F.col("wrong") == 0) / rows, 4).alias("match_rate"), reduce(lambda a, b: a & b, sums, F.lit(True)).alias("sums_agree"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """``rows, xor_hash, sum_hash``: fingerprints of a table that its row order doesn't change.

    Values are written with type and length, so shifted borders and nulls show. The xor misses
    pairs of equal rows; the sum, modulo 2^64, doesn't.
    """
    canonical = F.concat(*[F.when(F.col(f.name).isNull(), F.lit("~;")).otherwise(F.concat(F.lit(f.dataType.typeName()), F.lit(":"), F.length(F.col(f.name).cast("string")), F.lit(":"), F.col(f.name).cast("string"), F.lit(";"))) for f in df.schema])
    h = F.conv(F.substring(F.md5(canonical), 1, 15), 16, 10).cast("long")
    hashed = df.select(h.alias("h"))
    return hashed.agg(F.count("*").alias("rows"), F.bit_xor("h").alias("xor_hash"), F.pmod(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(2**60).cast("decimal(20,0)")).cast("long").alias("sum_hash"))


def fanout_audit(fact: DataFrame, dimension: DataFrame, fact_key: str, dimension_key: str, measure: str) -> DataFrame:
    """One row: rows and measure before and after the join, and whether the dimension's key is unique
    and among the keys that facts refer to."""
    copies = dimension.where(F.col(dimension_key).isNotNull()).groupBy(F.col(dimension_key).alias("k")).agg(F.count("*").alias("n"))
    joined = fact.select(F.col(fact_key).alias("k"), F.col(measure).alias("m")).join(copies, "k", "left")
    n = F.coalesce(F.col("n"), F.lit(1))
    referred = joined.agg(F.count("*").alias("rows_before"), F.sum(n).alias("rows_after"), F.sum("m").alias("measure_before"), F.sum(F.col("m") * n).alias("measure_after"), (F.coalesce(F.max("n"), F.lit(1)) <= 1).alias("referenced_key_unique"))
    return referred.join(F.broadcast(copies.agg((F.coalesce(F.max("n"), F.lit(1)) <= 1).alias("declared_unique")))).withColumn("pk_preserved", F.col("rows_before") == F.col("rows_after"))


def upsert(target: DataFrame, increment: DataFrame, key: str, deleted: str | None = "deleted") -> DataFrame:
    """The target after an increment: tombstones delete and are dropped, other rows replace or add."""
    kept = target.join(increment.select(key).distinct(), key, "left_anti")
    live = increment.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted and deleted in increment.columns else increment
    return kept.select(target.columns).unionByName(live.select(target.columns))


def since_watermark(df: DataFrame, column: str, watermark) -> DataFrame:
    """Rows strictly after the watermark (all of them without one); the filter reaches the scan."""
    return df if watermark is None else df.where(F.col(column) > F.lit(watermark))


def match_key(email: Column, phone: Column, name: Column) -> Column:
    """Normalised email, else the last digits of the phone, else the bare name."""
    mail = F.nullif(F.lower(F.trim(email)), F.lit(""))
    digits = F.nullif(F.substring(F.regexp_replace(phone, r"\D", ""), -8, 8), F.lit(""))
    bare = F.nullif(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", " "), F.lit(""))
    return F.coalesce(F.concat(F.lit("e:"), mail), F.concat(F.lit("p:"), digits), F.concat(F.lit("n:"), F.trim(bare)))


def survivors(df: DataFrame, key: str, rules: dict[str, str], updated: str, source_rank: Column | None = None) -> DataFrame:
    """One record per key; each field by its rule: most_recent, source_priority, longest, majority.

    Nulls and blanks are no candidates. Ties go to the latest and then to the greater value.
    Returns the key, the fields and ``merged`` rows. One aggregation, combined before the shuffle.
    """

    def pick(column: str, rule: str) -> Column:
        value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
        if rule == "majority":
            return F.mode(value, deterministic=True)
        order = {
            "most_recent": F.struct(F.col(updated), value),
            "source_priority": F.struct(-(source_rank if source_rank is not None else F.lit(0)), F.col(updated), value),
            "longest": F.struct(F.length(value), F.col(updated), value),
        }[rule]
        return F.max_by(value, F.when(value.isNotNull(), order))

    return df.groupBy(F.col(key).alias("key")).agg(*[pick(c, r).alias(c) for c, r in rules.items()], F.count("*").alias("merged"))


def type_ladder(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, inferred``: the narrowest type that keeps every text value as it is.

    Leading zeros, plus signs and thousands separators stay text; zeros and ones are SMALLINT; one
    distinct truth word is no boolean. All columns are counted in one pass, and of distinct values only
    truth words, one by one: the others don't matter.
    """
    truths = ("true", "false", "yes", "no", "t", "f", "y", "n")
    sums = []
    for i, c in enumerate(columns):
        v = F.nullif(F.trim(F.col(c)), F.lit(""))
        whole, point = v.rlike(r"^-?(0|[1-9][0-9]*)$"), v.rlike(r"^-?(0|[1-9][0-9]*)\.[0-9]+$")
        number = v.try_cast("double")
        sums += [
            F.count(v).alias(f"n{i}"), F.count_if(whole).alias(f"w{i}"), F.count_if(whole | point).alias(f"p{i}"), F.max(F.when(whole, F.abs(v.try_cast("decimal(38,0)")))).alias(f"m{i}"),
            F.count_if(F.lower(v).isin(*truths)).alias(f"b{i}"), reduce(Column.__add__, [F.coalesce(F.max((F.lower(v) == w).cast("int")), F.lit(0)) for w in truths]).alias(f"k{i}"),
            F.count_if(v.rlike(r"^\d{4}-\d{2}-\d{2}$") & v.try_cast("date").isNotNull()).alias(f"d{i}"), F.count_if(v.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$") & v.try_cast("timestamp").isNotNull()).alias(f"t{i}"),
            F.count_if(number.isNotNull() & v.rlike(r"^-?[0-9.]+[eE][-+]?[0-9]+$")).alias(f"e{i}"), F.max(F.length(v)).alias(f"l{i}"),
            F.max(F.length(F.regexp_extract(v, r"\.(\d+)$", 1))).alias(f"s{i}"),
        ]

    def rung(i: int) -> Column:
        n, c = F.col(f"n{i}"), lambda x: F.col(f"{x}{i}")
        size = F.greatest(F.col(f"l{i}"), F.lit(1))
        return (
            F.when(n == 0, "TEXT")
            .when((c("b") == n) & (c("k") == 2), "BOOLEAN")
            .when((c("w") == n) & (c("m") <= 32767), "SMALLINT")
            .when((c("w") == n) & (c("m") <= 2147483647), "INTEGER")
            .when((c("w") == n) & (c("m") <= F.lit(9223372036854775807).cast("decimal(38,0)")), "BIGINT")
            .when(c("p") == n, F.concat(F.lit("NUMERIC("), F.least(size, F.lit(38)).cast("string"), F.lit(","), c("s").cast("string"), F.lit(")")))
            .when(c("p") + c("e") == n, "DOUBLE")
            .when(c("d") == n, "DATE")
            .when(c("d") + c("t") == n, "TIMESTAMP")
            .when(size <= 255, F.concat(F.lit("VARCHAR("), size.cast("string"), F.lit(")")))
            .otherwise("TEXT")
        )

    rows = [F.struct(F.lit(c).alias("column"), rung(i).alias("inferred")) for i, c in enumerate(columns)]
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def contract_check(df: DataFrame, contract: dict[str, dict]) -> DataFrame:
    """``column, check, severity, n``: violations of a contract of columns.

    Each column declares ``type`` (number, text, timestamp), ``nullable``, ``unique``, ``allowed``,
    ``min``, ``max``. A wrong type hides the column's other checks, a missing column is an error, an
    undeclared one a warning.
    """
    families = {"number": ("integer", "long", "double", "float", "short", "byte", "decimal"), "text": ("string", "varchar", "char"), "timestamp": ("timestamp", "timestamp_ntz", "date"), "boolean": ("boolean",)}
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    fixed = [(c, "undeclared", "warning", 1) for c in kinds if c not in contract]
    sums, names = [], []
    for c, spec in contract.items():
        if c not in kinds:
            fixed.append((c, "missing", "error", 1))
            continue
        if "type" in spec and not kinds[c].startswith(families[spec["type"]]):
            fixed.append((c, "type", "error", 1))
            continue
        col, checks = F.col(c), {}
        if not spec.get("nullable", True):
            checks["nullable"] = F.count_if(col.isNull())
        if spec.get("unique"):
            checks["unique"] = F.count(col) - F.count_distinct(col)
        if "allowed" in spec:
            checks["allowed"] = F.count_if(col.isNotNull() & ~col.isin(list(spec["allowed"])))
        if "min" in spec:
            checks["min"] = F.count_if(col < spec["min"])
        if "max" in spec:
            checks["max"] = F.count_if(col > spec["max"])
        for name, count in checks.items():
            sums.append(count.alias(f"v{len(names)}"))
            names.append((c, name))
    parts = [df.sparkSession.createDataFrame(fixed, "column string, check string, severity string, n long")]
    if sums:
        rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.lit("error").alias("severity"), F.col(f"v{i}").cast("long").alias("n")) for i, (c, k) in enumerate(names)]
        parts.append(df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("n > 0"))
    return reduce(DataFrame.unionByName, parts)
