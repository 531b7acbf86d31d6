import hashlib
import math
import random
import re
import string

import pytest

from sluice.llm import secrets

# The patterns as they are stated, with short matches dropped after matching.
STATED = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
ALLOWED = [re.compile(a) for a in secrets.ALLOWED]


def brute(text):
    text = text or ""
    base = [(m.start(), k, kind, m.end()) for k, (kind, p, group, least) in enumerate(STATED) for m in p.finditer(text) if len(m[group]) >= least]
    more = []
    for k, c in enumerate(secrets.CLASSES, len(STATED)):
        for m in re.finditer(f"[{c.alphabet}]+", text):
            run, spans = m[0], []
            for i in range(len(run) - c.window + 1):
                w = run[i : i + c.window]
                if -sum(w.count(x) / c.window * math.log2(w.count(x) / c.window) for x in set(w)) >= c.bits:
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + c.window
                    else:
                        spans.append([i, i + c.window])
            more += [(m.start() + a, k, c.kind, m.start() + e) for a, e in spans if not any(x.search(run[a:e]) for x in ALLOWED)]
    return sorted(base), sorted(base + more)


def joined(found):
    return ",".join(f"{kind}:{a}:{e}" for a, _, kind, e in found)


def check(rows, texts):
    got = sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in rows)
    want = []
    for doc_id, text in texts:
        base, every = brute(text)
        counts = [sum(s[2] == kind for s in base) for kind, *_ in STATED]
        want.append((str(doc_id), *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
    assert got == sorted(want)


def made(rng):
    parts = [
        lambda: rng.choice(["password: ", "Secret=", "API_KEY = '", "token\":\"", "apikey=", "passwd :x", "token: secret: "]) + "".join(rng.choices(string.ascii_letters + string.digits + "+/_.=-", k=rng.choice([3, 7, 8, 30, 60]))),
        lambda: "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=rng.choice([5, 11, 12, 16, 30]))),
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([8, 31, 32, 40, 64]))),
        lambda: "".join(rng.choices("0123456789ABCDEF", k=rng.choice([20, 24, 40, 1100]))),
        lambda: "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=rng.choice([19, 20, 44, 700, 1600]))),
        lambda: "550e8400-e29b-41d4-a716-446655440000",
        lambda: "abcdefghijklmnopqrstuvwxyz0123456789",
        lambda: "internationalization-of-everything/path_to/some_file",
        lambda: "1" * 40 + "".join(rng.choices(string.digits, k=30)),
        lambda: " café \U0001f600\n",
    ]
    return "".join(rng.choice(["", " ", ", ", "ü"]) + rng.choice(parts)() for _ in range(rng.randint(0, 12)))


def test_made_texts_against_brute_force(spark):
    rng = random.Random(2)
    texts = [(i, made(rng)) for i in range(300)]
    check(secrets.secret_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(secrets.secret_spans(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_awkward_rows(awkward, nothing):
    out = secrets.secret_spans(awkward).collect()
    check(out, [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert secrets.secret_spans(nothing).count() == 0


def test_very_many_matches_and_one_very_long_run(spark):
    rng = random.Random(3)
    many = " ".join("".join(rng.choices("0123456789abcdef", k=32)) for _ in range(3000))
    long = "".join(rng.choices(string.ascii_letters + string.digits, k=20_000)) + "a" * 3000 + "".join(rng.choices(string.ascii_letters, k=900))
    texts = [(1, many), (2, long)]
    check(secrets.secret_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)


@pytest.mark.parametrize(("text", "found"), [("key aB3dE5fG7hI9jK1lM3nO5p", ["entropy_base64"]), ("key example-aB3dE5fG7hI9jK1lM3nO5p", []), ("a1b2c3" * 8, ["hex"]), ("550e8400-e29b-41d4-a716-446655440000", []), ("", [])])
def test_allow_list_and_classes(spark, text, found):
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s["kind"] for s in row["found"]] == found and all(text[s["start"] : s["end"]] == s["text"] for s in row["found"])


def test_no_python_in_the_plan(spark):
    plan = secrets.secret_spans(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan
