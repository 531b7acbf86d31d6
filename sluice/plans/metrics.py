"""Governed metrics and self-serve questions: declared specs that compile to DataFrame plans."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AGGREGATE = re.compile(r"^\s*(sum|avg|mean|count|count_distinct|min|max)\s*\(\s*(\*|[A-Za-z_]\w*)\s*\)\s*$", re.I)
_FILTER = re.compile(r"^\s*([A-Za-z_]\w*)\s*(==|=|!=|>=|<=|>|<)\s*(.+?)\s*$")


@dataclass(frozen=True)
class Metric:
    """``expr`` is one aggregate of one column; ``filters`` compare a column with a literal."""

    name: str
    expr: str
    dimensions: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    owner: str = ""
    description: str = ""


def parse_metrics(text: str) -> list[Metric]:
    """Metrics from a YAML text with a list under ``metrics``."""
    import yaml

    found = (yaml.safe_load(text) or {}).get("metrics") or []
    return [Metric(m.get("name", ""), str(m.get("expr", "")), tuple(m.get("dimensions") or ()), tuple(m.get("filters") or ()), m.get("owner") or "", m.get("description") or "") for m in found]


def validate_metrics(metrics: list[Metric]) -> list[str]:
    """Problems of a metric set: bad aggregates, repeated names, one name with two meanings, no owner."""
    issues, seen = [], {}
    for m in metrics:
        if not _AGGREGATE.match(m.expr):
            issues.append(f"{m.name}: unsupported expression {m.expr!r}")
        if m.name in seen:
            issues.append(f"{m.name}: defined twice" + (" with different expressions" if seen[m.name] != m.expr else ""))
        seen.setdefault(m.name, m.expr)
        if not m.owner:
            issues.append(f"{m.name}: has no owner")
    return issues


def aggregate(expr: str) -> Column:
    found = _AGGREGATE.match(expr)
    if not found:
        raise ValueError(f"unsupported metric expression: {expr}")
    kind, name = found[1].lower(), found[2]
    if name == "*":
        return F.count(F.lit(1))
    column = F.col(name)
    return {"sum": F.sum, "avg": F.avg, "mean": F.avg, "count": F.count, "count_distinct": F.count_distinct, "min": F.min, "max": F.max}[kind](column)


def literal(text: str) -> Column:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return F.lit(text[1:-1])
    for kind in (int, float):
        try:
            return F.lit(kind(text))
        except ValueError:
            pass
    return F.lit(text)


def apply_filter(df: DataFrame, condition: str) -> DataFrame:
    """``column op literal``; an unknown column or an unreadable condition changes nothing."""
    found = _FILTER.match(condition)
    if not found or found[1] not in df.columns:
        return df
    column, value = F.col(found[1]), literal(found[3])
    return df.where({"=": column == value, "==": column == value, "!=": column != value, ">": column > value, "<": column < value, ">=": column >= value, "<=": column <= value}[found[2]])


def compute(metric: Metric, df: DataFrame, grain: list[str] | None = None) -> DataFrame:
    """The metric by those grain columns that it declares and the table has."""
    for condition in metric.filters:
        df = apply_filter(df, condition)
    keys = [g for g in grain or [] if g in metric.dimensions and g in df.columns]
    return df.groupBy(*keys).agg(aggregate(metric.expr).alias(metric.name))


def to_sql(metric: Metric, grain: list[str] | None = None, table: str = "events") -> str:
    """The canonical SQL of a metric; a grain it doesn't declare falls back to its first dimensions."""
    found = _AGGREGATE.match(metric.expr)
    if not found:
        raise ValueError(f"unsupported metric expression: {metric.expr}")
    kind, name = found[1].lower(), found[2]
    call = f"COUNT(DISTINCT {name})" if kind == "count_distinct" else f"{'AVG' if kind == 'mean' else kind.upper()}({name})"
    keys = [g for g in grain or [] if g in metric.dimensions] or list(metric.dimensions[: len(grain or [])])
    where = f" WHERE {' AND '.join(f.replace('==', '=') for f in metric.filters)}" if metric.filters else ""
    lead = "".join(f"{k}, " for k in keys)
    return f"SELECT {lead}{call} AS {metric.name} FROM {table}{where}" + (f" GROUP BY {', '.join(keys)}" if keys else "")


@dataclass(frozen=True)
class Explore:
    """A self-serve question: filters by membership, rows, one measure, an optional pivot and top n."""

    rows: tuple[str, ...]
    measure: str
    agg: str = "sum"
    filters: dict = field(default_factory=dict)
    pivot: str | None = None
    top_n: int | None = None


def explore(df: DataFrame, q: Explore, pivot_values: list | None = None) -> DataFrame:
    """Filters on unknown columns or of empty lists are ignored; pivot cells without rows are 0.

    ``pivot_values`` spares the extra pass that finds the pivot's values.
    """
    for name, allowed in q.filters.items():
        if name in df.columns and allowed:
            df = df.where(F.col(name).isin(list(allowed)))
    value = aggregate(f"{q.agg}({q.measure})").alias("value")
    if not q.pivot:
        out = df.groupBy(*q.rows).agg(value)
        return out.orderBy(F.desc("value"), *q.rows).limit(q.top_n) if q.top_n else out
    spread = df.groupBy(*q.rows).pivot(q.pivot, pivot_values).agg(value)
    cells = [c for c in spread.columns if c not in q.rows]
    out = spread.na.fill(0, cells)
    if q.top_n:
        total = sum((F.col(f"`{c}`") for c in cells), F.lit(0))
        out = out.orderBy(total.desc(), *q.rows).limit(q.top_n)
    return out


_WRITES = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|merge|grant|revoke|attach|pragma|replace|call|exec)\b", re.I)


def guard_sql(spark: SparkSession, sql: str, tables: dict[str, list[str]], limit: int = 1000) -> tuple[str | None, list[str]]:
    """Whether a SQL text may run: one SELECT over known tables and columns; a LIMIT is added.

    Spark's own parser reads the text, so comments and strings can't hide a statement. Returns the
    SQL to run (None if refused) and the issues.
    """
    issues = []
    text = sql.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if ";" in bare:
        issues.append("only one statement is allowed")
    if not re.match(r"(select|with)\b", bare, re.I):
        issues.append("only SELECT is allowed")
    if m := _WRITES.search(bare):
        issues.append(f"forbidden keyword {m[1].lower()}")
    if not issues:
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
        except Exception as broken:
            return None, [f"doesn't parse: {str(broken).splitlines()[0]}"]
        named = {n.lower() for n in re.findall(r"UnresolvedRelation \[([\w, ]+)\]", plan)}
        own = {n.lower() for n in re.findall(r"\bwith\s+(\w+)|,\s*(\w+)\s+as\s*\(", bare, re.I) for n in n if n}
        known = {t.lower() for t in tables} | own
        issues += [f"unknown table {n}" for n in sorted(named - known)]
        columns = {c.lower() for cs in tables.values() for c in cs}
        aliases = {a.lower() for a in re.findall(r"\bas\s+(\w+)", bare, re.I)} | known | own
        used = {c.lower() for c in re.findall(r"'(?:\w+\.)*(\w+)(?=[^\w(]|$)", plan)}
        issues += [f"unknown column {c}" for c in sorted(used - columns - aliases) if not c.isdigit() and c not in ("unresolvedrelation", "project", "filter", "aggregate", "sort", "join", "null", "globallimit", "locallimit", "unresolvedhaving", "with", "distinct", "subqueryalias", "unresolvedwith", "union")]
    if issues:
        return None, issues
    return (text if re.search(r"\blimit\s+\d+\s*$", bare, re.I) else f"{text} LIMIT {limit}"), []


_COUNT = re.compile(r"\b(how many|count|number of)\b", re.I)


def translate(question: str, table: str, columns: list[str]) -> str:
    """A plain question to SQL by rules: count, sum or average, by a column, top n, one equality."""
    words = question.lower()
    named = [c for c in columns if re.search(rf"\b{re.escape(c.lower().replace('_', ' '))}\b", words.replace("_", " "))]
    by = re.search(r"\b(?:by|per|for each)\s+(\w+)", words)
    group = next((c for c in columns if by and c.lower() == by[1]), None)
    top = re.search(r"\btop\s+(\d+)", words)
    equal = re.search(r"\bwhere\s+(\w+)\s*(?:=|is|equals)\s*'?([\w -]+?)'?\s*(?:\bby\b|\bper\b|$)", words)
    measure = next((c for c in named if c != group), None)
    if _COUNT.search(words) or measure is None:
        value, alias = "COUNT(*)", "n"
    else:
        kind = "AVG" if re.search(r"\b(average|avg|mean)\b", words) else "SUM"
        value, alias = f"{kind}({measure})", f"{kind.lower()}_{measure}"
    where = f" WHERE {equal[1]} = '{equal[2].strip()}'" if equal and equal[1] in [c.lower() for c in columns] else ""
    lead = f"{group}, " if group else ""
    out = f"SELECT {lead}{value} AS {alias} FROM {table}{where}" + (f" GROUP BY {group}" if group else "")
    return out + (f" ORDER BY {alias} DESC LIMIT {top[1]}" if top else "")


LINT = (
    ("select-star", r"select\s+\*", "name the columns"),
    ("leading-wildcard", r"like\s+'%", "a pattern that starts with % can't be pushed down"),
    ("non-sargable", r"where\s[^;]*\b(?:year|month|date|upper|lower|substr|substring|cast)\s*\([^)]*\)\s*(?:=|<|>)", "compare the bare column"),
    ("or-conditions", r"where\s[^;]*\bor\b", "many ORs on one column are an IN"),
    ("cross-join", r"cross\s+join|from\s+\w+\s*,\s*\w+", "every pair of rows is made"),
    ("distinct", r"select\s+distinct", "DISTINCT may hide a fan-out"),
    ("subquery-in-select", r"select\s[^;]*\(\s*select\b[^;]*\)[^;]*\bfrom\b", "join in place of a scalar subquery"),
)


def lint_sql(sql: str) -> tuple[int, list[str]]:
    """Score of 0 to 100 and the rules that a SQL text breaks; advice only."""
    text = re.sub(r"\s+", " ", sql.strip().lower())
    broken = [name for name, pattern, _ in LINT if re.search(pattern, text)]
    if text.startswith("select") and " where " not in text and " join " not in text:
        broken.append("no-filter")
    if text.startswith("select") and " limit " not in text and " group by " not in text:
        broken.append("no-limit")
    if " order by " in text and " limit " not in text:
        broken.append("sort-no-limit")
    return max(0, 100 - 12 * len(broken)), broken
