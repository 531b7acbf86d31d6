"""Secrets in texts: known shapes, and windows of high entropy, on DataFrame functions only.

Two layers. Patterns find assignments, access keys and long hexadecimal runs. The other layer takes
every run of a character class's alphabet as a candidate, slides a window over it and keeps the
counts of the window's characters: one step adds a character, drops another and changes the sum of
``c * log2(c)`` by two table entries, in whole numbers. A window is high where its Shannon entropy
reaches the class's limit; high windows that overlap or touch are one span, unless an allow-list
pattern finds something harmless in it. All of it are functions of one row: nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A kind of secret: matches whose ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int
    least: int


@dataclass(frozen=True)
class Entropy:
    """A character class: windows of ``window`` characters of an alphabet with ``bits`` or more of entropy."""

    kind: str
    alphabet: str
    window: int
    bits: float


#: Runs of one alphabet are matched from their first character on, so asking for the least number at once finds what
#: dropping shorter matches would leave, without an array of every short run. Assignments are dropped after the match,
#: as a value too short takes its text from the next one.
PATTERNS = (
    Pattern("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Pattern("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Pattern("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Of 5,000 random strings 93 % of 20 base64 characters and all of 40 reach 3.8 bits, of 40 hexadecimal ones few do.
CLASSES = (Entropy("entropy_base64", "A-Za-z0-9+/_-", 20, 3.8), Entropy("entropy_hex", "0-9A-Fa-f", 24, 3.0))
#: Spans in which one of these is found are harmless: no digit or no letter, UUIDs, alphabets, placeholders.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i)abcdefgh|12345678",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6}",
)
#: Array elements that are summed or scanned at a time, as appending to an array copies it.
_STEP = 512
#: Entropy sums are whole numbers of 2^-20 bits.
_UNIT = 1 << 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column) -> Column:
    """The sums of a long array up to and with each element."""

    def block(done: Column, start: Column) -> Column:
        empty = F.struct(done["at"].alias("at"), F.array().cast("array<bigint>").alias("sums"))
        inner = F.aggregate(F.slice(values, start, _STEP), empty, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"] + x)).alias("sums")))
        return _let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(done["sums"], F.array(r["sums"])).alias("sums")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("sums"))
    blocks = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(_STEP))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(blocks, start, block, lambda s: s["sums"]))


def matches(text: Column, regex: str, group: int = 0) -> Column:
    """The leftmost non-overlapping matches of a pattern that can't be empty, in order.

    An array of ``start, end`` (code points, end exclusive), ``text`` and ``part``, the group's text.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string,part:string>>")
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(regex), F.lit(group)) if group else None
    between = F.transform(F.split(text, regex, -1), F.length)

    def placed(found: Column) -> Column:
        # What lies before the end of match i are the texts between up to i and the matches up to i.
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, m: (gap + F.length(m)).cast("long"))
        return _let(_running(steps), lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("text"), (F.get(part, i) if group else m).alias("part"))))

    return F.when(F.regexp_like(text, F.lit(regex)), _let(whole, placed)).otherwise(none)


def _high(codes: Column, c: Entropy) -> Column:
    """Where in an array of character codes the high windows start, by one pass over it."""
    first, last = 43, 122  # + to z
    terms = [round(_UNIT * n * math.log2(n)) if n else 0 for n in range(c.window + 1)]
    term = lambda n: F.element_at(F.array(*map(F.lit, terms)), n + 1)
    most = math.floor(_UNIT * c.window * (math.log2(c.window) - c.bits))
    start = F.struct(
        F.array_repeat(F.lit(0), last - first + 1).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.array().cast("array<int>").alias("high"),
    )

    def step(s: Column, i: Column) -> Column:
        new = F.get(codes, i) - first
        old = F.when(i >= c.window, F.get(codes, i - c.window) - first).otherwise(F.lit(-1))
        had = F.when(old >= 0, F.get(s["counts"], old)).otherwise(F.lit(0))
        has = F.get(s["counts"], new) - F.when(old == new, 1).otherwise(0)
        total = s["total"] + F.when(old >= 0, term(had - 1) - term(had)).otherwise(F.lit(0)) + term(has + 1) - term(has)
        counts = F.transform(s["counts"], lambda n, k: n + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
        return _let(total, lambda t: F.struct(counts.alias("counts"), t.cast("long").alias("total"), F.when((i >= c.window - 1) & (t <= most), F.concat(s["high"], F.array(i - (c.window - 1)))).otherwise(s["high"]).alias("high")))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["high"])


def _windows(run: Column, c: Entropy) -> Column:
    """Starts of the high windows of one candidate, which is scanned in pieces that overlap by a window less one."""

    def scanned(pieces: Column) -> Column:
        def one(piece: Column, k: Column) -> Column:
            more = F.concat(piece, F.coalesce(F.substring(F.get(pieces, k + 1), 1, c.window - 1), F.lit("")))
            codes = F.transform(F.split(more, ""), F.ascii)
            return F.when(F.length(more) >= c.window, F.transform(_let(codes, lambda x: _high(x, c)), lambda i: i + k * _STEP)).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(pieces, one))

    return _let(F.regexp_extract_all(run, F.lit(f".{{1,{_STEP}}}"), F.lit(0)), scanned)


def high_entropy(text: Column, c: Entropy, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Unions of touching high windows of a class: an array of ``start, end, text``, allow-listed ones left out."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")

    def spans(run: Column) -> Column:
        def unions(high: Column) -> Column:
            begins = F.filter(high, lambda x, i: (i == 0) | (x - F.coalesce(F.get(high, i - 1), F.lit(0)) > c.window))
            ends = F.filter(high, lambda x, i: (i == F.size(high) - 1) | (F.coalesce(F.get(high, i + 1), F.lit(0)) - x > c.window))
            return F.zip_with(begins, ends, lambda a, b: F.struct((run["start"] + a).alias("start"), (run["start"] + b + c.window).alias("end"), F.substring(run["text"], a + 1, b + c.window - a).alias("text")))

        return _let(_windows(run["text"], c), unions)

    found = F.flatten(F.transform(matches(text, f"[{c.alphabet}]{{{c.window},}}"), spans))
    kept = F.filter(found, lambda s: ~F.exists(F.array(*map(F.lit, allowed)), lambda a: F.regexp_like(s["text"], a))) if allowed else found
    return F.when(F.regexp_like(text, F.lit(f"[{c.alphabet}]{{{c.window},}}")), kept).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: tuple[Pattern, ...] = PATTERNS, classes: tuple[Entropy, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``doc_id, found``: all secrets of each whole text, an array of ``start, rank, kind, end, text``.

    Sorted by start and then kind, patterns as listed before classes (``rank``). Spans of different
    kinds may overlap. Positions are code points, the end exclusive. The allow-list holds for the
    classes alone. A null text is empty and has none; repeated rows stay repeated, a null id stays
    null. Other columns are not read.
    """
    text = F.col("text")

    def found(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["text"].alias("text")))

    def long_enough(p: Pattern) -> Column:
        return F.filter(matches(text, p.regex, p.group), lambda m: F.length(m["part"]) >= p.least)

    kinds = [found(long_enough(p), k, p.kind) for k, p in enumerate(patterns)]
    kinds += [found(high_entropy(text, c, allowed), k, c.kind) for k, c in enumerate(classes, len(patterns))]
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return whole.select("doc_id", F.sort_array(F.concat(*kinds)).alias("found"))


def spans(found: Column) -> Column:
    """``kind:start:end`` of secrets, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, counts of the three pattern kinds, ``base_sha256`` of their spans, and all ``spans``."""
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = spans(F.filter(found, lambda s: s["rank"] < len(PATTERNS)))
    return find_secrets(docs, **options).select("doc_id", *(count(p.kind) for p in PATTERNS), F.sha2(base, 256).alias("base_sha256"), spans(found).alias("spans"))
