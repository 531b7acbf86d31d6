"""A JSON schema from samples: evidence that can be merged, and what it allows to be required.

Evidence is one table of counts by place, kind and value. Counts of two sets of samples add up, so
evidence may be kept, merged with that of new samples, and read again; the order of samples means
nothing. Only the fields of the schema, of which there are few, go to the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.core.session import cut

EVIDENCE = ["path", "parent", "key", "kind", "value"]
KINDS = ("array", "boolean", "integer", "null", "number", "object", "string")
#: JSON Schema formats and the texts that have them.
FORMATS = {
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "uri": r"^[a-zA-Z][a-zA-Z0-9+.-]*://\S+$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}


@dataclass(frozen=True)
class Policy:
    """How much must be seen of what before the schema says so."""

    required_at: float = 0.98
    rare_below: float = 0.20
    enum_most: int = 8
    enum_support: int = 2
    enum_share: float = 0.30
    least_samples: int = 5
    closed: bool = True
    bounds: bool = True
    #: More fields than this are data used as keys, and an error.
    most_fields: int = 10_000


def _kind(v: Column) -> Column:
    """A variant's JSON kind; decimals without a fraction that no long holds are whole numbers written out."""
    name = F.schema_of_variant(v)
    digits = F.regexp_extract(name, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(name == "BIGINT", "integer").when((digits != "") & (F.try_to_number(digits, F.lit("99")) > 18), "integer").when(name.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("string")
    )


def evidence(df: DataFrame, column: str) -> DataFrame:
    """``path, parent, key, kind, value, n`` of all places in a column of JSON texts.

    The value of an array says whether it is empty; objects and nulls have none. Elements share the
    key ``[]``. Texts that aren't JSON and nulls are no samples. One pass over each level of nesting.
    """
    at = df.select(F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("key"), F.try_parse_json(column).alias("v")).where("v is not null")
    found = []
    while True:
        at = cut(at.withColumn("kind", _kind(F.col("v"))))
        items = F.expr("try_variant_get(v, '$', 'array<variant>')")
        value = F.when(F.col("kind").isin("boolean", "integer", "number", "string"), F.expr("try_variant_get(v, '$', 'string')")).when(F.col("kind") == "array", F.when(F.size(items) == 0, "empty").otherwise("filled"))
        found.append(at.groupBy("path", "parent", "key", "kind", value.alias("value")).agg(F.count("*").alias("n")))
        inner = at.where("kind in ('object', 'array')")
        if inner.isEmpty():
            break
        plain = "rlike(e.key, '^[^.\\\\[\\\\]]+$')"
        named = F.expr(f"transform(map_entries(try_variant_get(v, '$', 'map<string,variant>')), e -> struct(concat(path, if({plain}, concat('.', e.key), concat('[', e.key, ']'))) as path, path as parent, e.key as key, e.value as v))")
        listed = F.expr("transform(try_variant_get(v, '$', 'array<variant>'), e -> struct(concat(path, '[]') as path, path as parent, '[]' as key, e as v))")
        at = inner.select(F.explode(F.when(F.col("kind") == "object", named).otherwise(listed)).alias("e")).select("e.*")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def merged(*parts: DataFrame) -> DataFrame:
    """The evidence of all samples of several."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*EVIDENCE).agg(F.sum("n").alias("n"))


def fields(found: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``path, parent, key, presence, seen, of, types, distinct, decision`` and counts by kind of every place.

    ``of`` counts the objects that could have had the key. ``types`` go from the most seen to the
    least, ties by name. ``distinct`` counts scalar values.
    """
    number = F.when(F.col("kind").isin("integer", "number"), F.expr("try_cast(value as double)"))
    text = F.col("kind") == "string"
    counts = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    formats = [F.coalesce(F.sum(F.when(text & F.col("value").rlike(p), F.col("n"))), F.lit(0)).alias(f"f_{name}") for name, p in FORMATS.items()]
    each = found.groupBy("path", "parent", "key").agg(
        F.sum("n").alias("seen"), *counts, *formats, F.min(number).alias("low"), F.max(number).alias("high"),
        F.count_if(F.col("kind").isin("boolean", "integer", "number", "string")).alias("distinct"), F.count_if(text).alias("texts"), F.min(F.when(text, F.col("n"))).alias("support"),
        F.coalesce(F.sum(F.when(F.col("value").eqNullSafe("filled") & (F.col("kind") == "array"), F.col("n"))), F.lit(0)).alias("filled"),
    )
    holders = each.where("n_object > 0").select(F.col("path").alias("parent"), F.col("n_object").alias("holders"))
    samples = each.where("path = '$'").select(F.col("seen").alias("samples"))
    types = F.array_join(F.transform(F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"n_{k}")).alias("n"), F.lit(k).alias("kind")) for k in KINDS]), lambda t: t["n"] < 0)), lambda t: t["kind"]), "|")
    known = each.join(holders, "parent", "left").join(F.broadcast(samples)).withColumn("of", F.when((F.col("key") == "[]") | F.col("parent").isNull(), F.col("seen")).otherwise(F.col("holders")))
    share = F.col("seen") / F.col("of")
    decision = (
        F.when(F.col("samples") < policy.least_samples, "optional (too few samples)").when(share >= policy.required_at, "required")
        .when(share < policy.rare_below, F.concat(F.lit("optional - rare ("), F.bround(100 * share, 0).cast("int").cast("string"), F.lit("%)"))).otherwise("optional")
    )
    return known.select(*each.columns, share.alias("presence"), "of", "samples", types.alias("types"), decision.alias("decision"))


def _listed(found: DataFrame, about: DataFrame, policy: Policy) -> dict[str, list[str]]:
    """The values of the places whose strings are few, each seen often enough, the most seen first."""
    few = about.where((F.col("texts").between(1, policy.enum_most)) & (F.col("support") >= policy.enum_support) & (F.col("texts") <= policy.enum_share * F.col("n_string")))
    rows = found.where("kind = 'string'").join(F.broadcast(few.select("path")), "path", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))).alias("v"))
    return {r["path"]: [v["value"] for v in r["v"]] for r in rows.collect()}


def infer(found: DataFrame, policy: Policy = Policy(), title: str = "Inferred") -> tuple[dict, list[dict]]:
    """The JSON Schema of evidence and what it could not say: ``path, kind, severity, detail``, worst first.

    A mix of kinds is pinned to the one most seen, but whole and other numbers are numbers. Without
    samples the schema is open.
    """
    about = cut(fields(merged(found), policy))
    if about.count() > policy.most_fields:
        raise ValueError(f"more than {policy.most_fields} fields: keys hold data")
    rows = {r["path"]: r.asDict() for r in about.collect()}
    head = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title}
    if not rows:
        return head, [{"path": "$", "kind": "no-samples", "severity": "block", "detail": "no samples"}]
    below: dict[str, list[dict]] = {}
    for r in rows.values():
        below.setdefault(r["parent"], []).append(r)
    enough = rows["$"]["samples"] >= policy.least_samples
    enums = _listed(found, about, policy) if enough else {}
    told: list[dict] = []

    def tell(r: dict, kind: str, severity: str, detail: str) -> None:
        told.append({"path": r["path"], "kind": kind, "severity": severity, "detail": detail})

    def members(r: dict) -> dict:
        out: dict = {"type": "object", "properties": {}}
        required = []
        for child in sorted((c for c in below.get(r["path"], []) if c["key"] != "[]"), key=lambda c: c["key"]):
            out["properties"][child["key"]] = of(child)
            if enough and child["presence"] >= policy.required_at:
                required.append(child["key"])
            elif enough and child["presence"] < policy.rare_below:
                tell(child, "rare-key", "warn", f"in {child['seen']} of {child['of']}")
        return out | ({"required": required} if required else {}) | ({"additionalProperties": False} if policy.closed else {})

    def of(r: dict) -> dict:
        kinds = {k: r[f"n_{k}"] for k in KINDS if k != "null" and r[f"n_{k}"]}
        if not kinds:
            tell(r, "always-null", "warn", f"null in all {r['seen']}")
            return {}
        kind = min(kinds, key=lambda k: (-kinds[k], k))
        if len(kinds) > 1:
            if set(kinds) == {"integer", "number"}:
                kind = "number"
            else:
                tell(r, "type-instability", "block", ", ".join(f"{k} {n}" for k, n in sorted(kinds.items(), key=lambda x: (-x[1], x[0]))))
        null = ["null"] if r["n_null"] else []
        out: dict = {"type": [kind, *null] if null else kind}
        if kind == "object":
            return members(r) | out
        if kind == "array":
            item = next((c for c in below.get(r["path"], []) if c["key"] == "[]"), None)
            if item is None:
                tell(r, "empty-array", "warn", f"empty in all {r['n_array']}")
                return out
            if r["filled"] < max(3, 0.25 * r["seen"]):
                tell(r, "thin-array-evidence", "info", f"filled in {r['filled']} of {r['seen']}")
            return out | {"items": of(item)}
        if kind == "string":
            if r["path"] in enums:
                return {"enum": [*enums[r["path"]], *([None] if null else [])]}
            same = [f for f in FORMATS if enough and r[f"f_{f}"] == r["n_string"]]
            return out | ({"format": same[0]} if same else {})
        if kind in ("integer", "number") and policy.bounds and r["low"] is not None and r["low"] < r["high"] < math.inf:
            out["minimum"], out["maximum"] = round_interval(r["low"], r["high"])
        return out

    if not enough:
        tell(rows["$"], "few-samples", "warn", f"{rows['$']['samples']} samples: nothing is required or enumerated")
    schema = head | of(rows["$"])
    order = {"block": 0, "warn": 1, "info": 2}
    return schema, sorted(told, key=lambda t: (order[t["severity"]], t["path"], t["kind"]))


def round_interval(low: float, high: float) -> tuple[float, float]:
    """The interval widened to multiples of the power of ten of its width, as samples seldom hold the ends."""
    step = 10.0 ** math.floor(math.log10(high - low))
    return round(math.floor(low / step) * step, 6), round(math.ceil(high / step) * step, 6)


def infer_text(df: DataFrame, column: str, policy: Policy = Policy()) -> str:
    """The schema of a column of JSON texts as JSON with sorted keys."""
    return json.dumps(infer(evidence(df, column), policy)[0], sort_keys=True, ensure_ascii=False)
