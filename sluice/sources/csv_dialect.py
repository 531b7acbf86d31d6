"""The dialect of each CSV file of a folder, from its own bytes, and a reader that goes by it.

Every file is judged whole by one task: its encoding, the delimiters and quotes under which all
records have the same width, the ends of its records, and whether its first record is a header. What
the bytes don't settle is said, not guessed; reading then needs to be told. Files of one dialect are
read together by Spark's own reader.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Byte order marks, candidates, and texts by their kind.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
ENCODINGS = ("utf-8", "cp1252", "shift_jis")
DELIMITERS = (",", ";", "\t", "|", ":", " ")
QUOTES = ('"', "'", None)
KINDS = (("int", r"[+-]?\d+"), ("float", r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?"), ("date", r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?"), ("float,", r"[+-]?\d+,\d+"))
#: Encodings of Spark's reader.
SPARK_NAMES = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}
_KINDS = [(name, re.compile(p)) for name, p in KINDS]

SCHEMA = "path string, bytes long, encoding string, plausible array<string>, delimiter string, quote string, records long, fields int, rivals int, quote_seen boolean, terminator string, embedded long, header string, basis string, names array<string>, status string"


def encoding_of(raw: bytes) -> tuple[str, list[str]]:
    """The verdict (a name, ``undetermined`` or ``undecodable``) and the candidates that decode to text.

    A byte order mark settles it, then UTF-8 if it decodes. Of the others one must be left: a decode
    with control characters of 80 to 9F is not text. Encodings that never fail are no evidence.
    """
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name, [name]
    left = []
    for name in ENCODINGS:
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        if not re.search("[\x80-\x9f]", text):
            left.append(name)
    if "utf-8" in left:
        return "utf-8", left
    return left[0] if len(left) == 1 else "undetermined" if left else "undecodable", left


def records_of(text: str, delimiter: str, quote: str | None) -> list[list[str]]:
    """The records under a dialect, blank lines left out."""
    settings = {"quoting": csv.QUOTE_NONE} if quote is None else {"quotechar": quote, "doublequote": True}
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, **settings)
    return [r for r in rows if r and r != [""]]


def fit(text: str, delimiter: str, quote: str | None) -> tuple[int, int] | None:
    """Records and fields of a file that a dialect cuts to one width of two or more with no quote left open; else None."""
    try:
        rows = records_of(text, delimiter, quote)
    except csv.Error:
        return None
    widths = Counter(map(len, rows))
    if len(widths) != 1 or min(widths) < 2:
        return None
    if quote is not None and any(len(s := f.strip()) > 1 and s.startswith(quote) and not s.endswith(quote) for r in rows for f in r):
        return None
    return len(rows), min(widths)


def terminator_of(text: str, quote: str | None) -> str:
    """``crlf``, ``lf``, ``cr``, ``mixed`` or ``none``: what ends records outside of quotes."""
    outside = re.sub(f"{re.escape(quote)}[^{re.escape(quote)}]*(?:{re.escape(quote)}|$)", "", text) if quote else text
    found = {{"\r\n": "crlf", "\n": "lf", "\r": "cr"}[m] for m in re.findall(r"\r\n|\n|\r", outside)}
    return "mixed" if len(found) > 1 else next(iter(found), "none")


def kind_of(cell: str) -> str:
    cell = cell.strip()
    return "empty" if not cell else next((name for name, p in _KINDS if p.fullmatch(cell)), "text")


def header_of(rows: list[list[str]]) -> tuple[str, str]:
    """``header`` where a column's first cell is text above numbers or dates; else ``undetermined``; and on what basis."""
    if len(rows) < 2:
        return "undetermined", "too_short"
    first = [kind_of(c) for c in rows[0]]
    body = [Counter(kind_of(r[k]) for r in rows[1:]).most_common(1)[0][0] for k in range(len(first))]
    differ = [(a, b) for a, b in zip(first, body) if a != b]
    if any(a == "text" for a, _ in differ):
        return "header", "text_over_nontext"
    return "undetermined", "mixed" if differ else "all_text" if set(first) == {"text"} else "row0_matches_body"


def _used(text: str, delimiter: str, quotes: list[str | None]) -> str | None:
    """Of quotes that cut a file alike the one that wraps most cells; the first listed if none does."""
    if None not in quotes:
        return quotes[0]
    cells = [c for r in records_of(text, delimiter, None) for c in r if len(c) > 1]
    return max(quotes, key=lambda q: (sum(c[0] == c[-1] == q for c in cells), -QUOTES.index(q)))


def dialect_of(raw: bytes, fallback: str | None = None) -> dict:
    """All that a file's bytes settle. ``status`` is ok, contested, undetermined, undecodable or, of a file without records, empty.

    ``fallback`` is the encoding to take where several are plausible and it is one of them.
    """
    encoding, plausible = encoding_of(raw)
    if encoding == "undetermined" and fallback in plausible:
        encoding = fallback
    out = {"encoding": encoding, "plausible": plausible, "delimiter": None, "quote": None, "records": 0, "fields": 0, "rivals": 0, "quote_seen": False, "terminator": None, "embedded": 0, "header": None, "basis": None, "names": []}
    if encoding in ("undetermined", "undecodable"):
        return out | {"status": encoding}
    text = raw.decode(encoding).removeprefix("﻿")
    if not text.strip("\r\n"):
        return out | {"terminator": terminator_of(text, None), "status": "empty"}
    found: dict[tuple[str, int, int], list[str | None]] = {}
    for delimiter in DELIMITERS:
        for quote in QUOTES:
            shape = fit(text, delimiter, quote)
            if shape:
                found.setdefault((delimiter, *shape), []).append(quote)
    if not found:
        return out | {"terminator": terminator_of(text, '"'), "status": "undetermined"}
    # More columns, then more records, then the delimiter listed first: a preference, which the rivals tell.
    best = max(found, key=lambda k: (k[2], k[1], -DELIMITERS.index(k[0])))
    quote = _used(text, best[0], found[best])
    rows = records_of(text, best[0], quote)
    header, basis = header_of(rows)
    embedded = sum("\n" in c or "\r" in c for r in rows for c in r)
    return out | {
        "delimiter": best[0], "quote": quote, "records": best[1], "fields": best[2], "rivals": len(found) - 1, "quote_seen": len(found[best]) < len(QUOTES), "terminator": terminator_of(text, quote),
        "embedded": embedded, "header": header, "basis": basis, "names": rows[0], "status": "contested" if len(found) > 1 else "ok",
    }


def dialects(spark: SparkSession, path: str, pattern: str = "*", fallback: str | None = None, most_bytes: int = 1 << 30) -> DataFrame:
    """One row for each file: what ``dialect_of`` says. A file is read whole by one task; larger ones are an error.

    A file of one record can't show whether it is a header: it is one (basis ``other_files``) where another
    file of that delimiter has the same header. Writers leave such files for partitions without rows.
    """

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([{"path": p, "bytes": len(raw)} | dialect_of(raw, fallback) for p, raw in zip(part["path"], part["content"])], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    checked = files.select("path", F.when(F.col("length") > most_bytes, F.raise_error(F.concat(F.lit("too large to judge whole: "), "path")).cast("binary")).otherwise(F.col("content")).alias("content"))
    found = checked.mapInPandas(judge, SCHEMA)
    alike = Window.partitionBy("delimiter", "names")
    known = (F.col("records") == 1) & F.max(F.coalesce(F.col("header") == "header", F.lit(False))).over(alike)
    found = found.withColumn("known", known)
    return found.withColumns({"header": F.when(F.col("known"), "header").otherwise(F.col("header")), "basis": F.when(F.col("known"), "other_files").otherwise(F.col("basis"))}).drop("known")


def _parser(encoding: str, delimiter: str, quote: str | None, with_header: bool, names: list[str]):
    """Records of whole files in an encoding that Spark's reader doesn't have; as there, an empty cell is null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part["content"]:
                rows = records_of(raw.decode(encoding), delimiter, quote)[int(with_header) :]
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame([[c or None for c in r] for r in rows[at : at + 10_000]], columns=names, dtype=object)

    return run


def read_csv(spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*", header: bool | None = None, doubtful: str = "error", fallback: str | None = None) -> DataFrame:
    """All CSV files of a folder as one table, each by its own dialect; columns go by position.

    ``header`` says whether first records are headers where a file doesn't (None: only those are that
    show it), ``fallback`` the encoding of files that could have several. A contested dialect is an error unless ``doubtful`` is ``preferred``; undecided ones and
    other widths than the schema's always are, but for files without records. Files of one dialect are one scan. A record's line ends
    within quotes are kept. The list of files goes through the driver, as it does for any read.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = dialects(spark, path, pattern, fallback).where("status <> 'empty'").drop("names", "plausible").collect()
    bad = [r["path"] for r in found if r["status"] not in ("ok", *(["contested"] if doubtful == "preferred" else [])) or r["fields"] != len(schema.fields)]
    if bad:
        raise ValueError(f"no dialect can be told of {len(bad)} files, such as {sorted(bad)[0]}")
    groups: dict[tuple, list[str]] = {}
    for r in found:
        with_header = r["header"] == "header" or bool(header)
        groups.setdefault((r["encoding"], r["delimiter"], r["quote"], r["terminator"], with_header), []).append(r["path"])
    parts = []
    for (encoding, delimiter, quote, terminator, with_header), paths in sorted(groups.items(), key=str):
        text = StructType([StructField(f.name, StringType()) for f in schema.fields])
        if encoding in SPARK_NAMES:
            settings = {"encoding": SPARK_NAMES[encoding], "sep": delimiter, "quote": quote or "\u0000", "escape": quote or "\u0000", "header": str(with_header).lower(), "enforceSchema": "true", "mode": "FAILFAST", "multiLine": "true"}
            if terminator in ("lf", "cr"):
                settings["lineSep"] = {"lf": "\n", "cr": "\r"}[terminator]
            read = spark.read.schema(text).options(**settings).csv(paths)
        else:
            read = spark.read.format("binaryFile").load(paths).select("content").mapInPandas(_parser(encoding, delimiter, quote, with_header, text.names), text)
        first = text.fields[0].name
        clean = F.when(F.col(first).startswith("﻿"), F.expr(f"substring(`{first}`, 2)")).otherwise(F.col(first))
        parts.append(read.select(clean.cast(schema.fields[0].dataType).alias(first), *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields[1:]]))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
