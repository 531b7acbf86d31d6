import json
import random
from collections import Counter, defaultdict

import pytest

from sluice.operators import schemas


def kind_of(v):
    return {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def observed(samples):
    """Counts by place in dictionaries."""
    kinds, seen, values = defaultdict(Counter), Counter(), defaultdict(set)

    def walk(path, v):
        kinds[path][kind_of(v)] += 1
        seen[path] += 1
        if isinstance(v, dict):
            for k, x in v.items():
                walk(f"{path}.{k}" if not set(k) & set(".[]") else f"{path}[{k}]", x)
        elif isinstance(v, list):
            for x in v:
                walk(path + "[]", x)
        elif v is not None:
            values[path].add((kind_of(v), v))

    for s in samples:
        walk("$", s)
    return kinds, seen, values


def made(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = {"id": i, "status": rng.choice(["open", "shut", "lost"]), "when": f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", "score": rng.choice([1, 2.5, 10]), "mail": f"u{i}@x.org"}
        if rng.random() < 0.6:
            s["user"] = {"name": f"n{i}", "age": rng.choice([None, 30, 41]), "a.b": True}
        if rng.random() < 0.1:
            s["rare"] = None
        s["tags"] = [rng.choice("xyz") for _ in range(rng.randint(0, 3))]
        s["mixed"] = rng.choice([1, "one", "one", "two"])
        s["none"] = []
        out.append(s)
    return out


def frame(spark, samples, parts=4):
    return spark.createDataFrame([(json.dumps(s), 1) for s in samples] + [("{broken", 1), (None, 1)], "text string, path int").repartition(parts)


def test_fields_against_dictionaries(spark):
    samples = made(1)
    kinds, seen, values = observed(samples)
    rows = {r["path"]: r for r in schemas.fields(schemas.evidence(frame(spark, samples), "text")).collect()}
    assert set(rows) == set(seen)
    for path, r in rows.items():
        assert r["seen"] == seen[path] and r["distinct"] == len(values[path])
        assert r["types"] == "|".join(sorted(kinds[path], key=lambda k: (-kinds[path][k], k)))
    assert rows["$.user"]["of"] == 60 and rows["$.user.name"]["of"] == seen["$.user"] and rows["$.user[a.b]"]["key"] == "a.b"
    assert rows["$.id"]["decision"] == "required" and rows["$.rare"]["decision"].startswith("optional - rare") and rows["$.user"]["decision"] == "optional"


def test_schema_and_findings(spark):
    schema, told = schemas.infer(schemas.evidence(frame(spark, made(2)), "text"))
    p = schema["properties"]
    assert schema["required"] == ["id", "mail", "mixed", "none", "score", "status", "tags", "when"] and schema["additionalProperties"] is False
    assert p["id"] == {"type": "integer", "minimum": 0, "maximum": 60} and p["score"]["type"] == "number" and p["when"] == {"type": "string", "format": "date"} and p["mail"] == {"type": "string", "format": "email"}
    assert sorted(p["status"]["enum"]) == ["lost", "open", "shut"] and sorted(p["tags"]["items"]["enum"]) == ["x", "y", "z"]
    assert p["user"]["properties"]["age"]["type"] == ["integer", "null"] and p["rare"] == {} and "items" not in p["none"]
    assert {(t["path"], t["kind"]) for t in told} == {("$.mixed", "type-instability"), ("$.rare", "always-null"), ("$.rare", "rare-key"), ("$.none", "empty-array")} and told[0]["severity"] == "block"


def test_order_and_parts_mean_nothing(spark):
    samples = made(3, 80)
    whole = schemas.infer_text(frame(spark, samples), "text")
    turned = samples[::-1]
    assert schemas.infer_text(frame(spark, turned, 9), "text") == whole
    kept = schemas.merged(schemas.evidence(frame(spark, samples[:33]), "text"), schemas.evidence(frame(spark, samples[33:]), "text"))
    assert json.dumps(schemas.infer(kept)[0], sort_keys=True, ensure_ascii=False) == whole


def test_few_none_and_odd_samples(spark):
    assert schemas.infer(schemas.evidence(frame(spark, []), "text"))[1][0]["kind"] == "no-samples"
    schema, told = schemas.infer(schemas.evidence(frame(spark, [{"a": "x"}] * 2), "text"))
    assert "required" not in schema and schema["properties"]["a"] == {"type": "string"} and told[0]["kind"] == "few-samples"
    schema, told = schemas.infer(schemas.evidence(frame(spark, [[1, 2.0], "x", [3]] * 3), "text"))
    assert schema["type"] == "array" and schema["items"]["type"] == "number" and told[0]["kind"] == "type-instability"
    big = spark.createDataFrame([('{"n": 12345678901234567890123}',), ('{"n": 1.0}',), ('{"n": 7}',)], "t string")
    assert {r["types"] for r in schemas.fields(schemas.evidence(big, "t")).collect()} == {"object", "integer|number"}
    with pytest.raises(ValueError, match="keys hold data"):
        schemas.infer(schemas.evidence(frame(spark, [{f"k{i}": 1} for i in range(30)]), "text"), schemas.Policy(most_fields=20))
