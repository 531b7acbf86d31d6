"""Careful readers of booleans, numbers, durations, timestamps and log lines, as Column expressions.

Where a text has no single meaning the reader says so in a status; it never guesses.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each reader takes for true and false (None: by other rules, below).
BOOLEAN_READERS = {
    "yaml11": (("y", "Y", "yes", "Yes", "YES", "true", "True", "TRUE", "on", "On", "ON"), ("n", "N", "no", "No", "NO", "false", "False", "FALSE", "off", "Off", "OFF")),
    "yaml12": (("true", "True", "TRUE"), ("false", "False", "FALSE")),
    "json": (("true",), ("false",)),
    "go": (("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")),
    "git": (("yes", "on", "true", "1"), ("no", "off", "false", "0", "")),
    "java": (("true",), None),
    "postgres": (("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")),
}
FOLDED = ("git", "java", "postgres")


def read_boolean(text: Column, reader: str) -> Column:
    """True, false or null (refused) by a reader's rules; ``python`` takes any non-empty text for true."""
    if reader == "python":
        return F.length(text) > 0
    yes, no = BOOLEAN_READERS[reader]
    t = F.lower(text) if reader in FOLDED else text
    if reader == "postgres":
        t = F.trim(t)
    if no is None:
        return F.when(text.isNotNull(), t.isin(*yes))
    return F.when(t.isin(*yes), True).when(t.isin(*no), False)


# Group and decimal signs by locale.
LOCALES = {"en": (",", "."), "de": (".", ","), "fr": (" \u202f\u00a0", ","), "ch": ("'’", ".")}


def read_number(text: Column, locale: str) -> Column:
    """``struct(value decimal(38,10), status)``: groups must be of three digits; brackets are negative.

    A text that the locale's grammar doesn't have is refused, not stripped.
    """
    group, point = LOCALES[locale]
    t = F.trim(text)
    bare = F.regexp_replace(t, r"^\((.*)\)$", "-$1")
    g = f"[{re.escape(group)}]"
    grammar = rf"^[+-]?(\d{{1,3}}(?:{g}\d{{3}})+|\d+)(?:{re.escape(point)}\d+)?$"
    plain = F.replace(F.regexp_replace(bare, g, ""), F.lit(point), F.lit(".")).try_cast("decimal(38,10)")
    fits = bare.rlike(grammar)
    return F.struct(F.when(fits, plain).alias("value"), F.when(t.isNull() | (t == ""), "empty").when(fits, "ok").otherwise("refused").alias("status"))


def column_locale(text: Column) -> Column:
    """An aggregate: the locales under which every value reads, comma-joined ("" if none)."""
    return F.concat_ws(",", *[F.when(F.count_if(text.isNotNull()) == F.count_if(read_number(text, k)["status"] == "ok"), F.lit(k)) for k in LOCALES])


def go_duration(text: Column) -> Column:
    """Seconds of a Go duration like ``1h15m30.5s``; null if refused."""
    t = F.trim(text)
    fits = t.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)((\d+(\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h))*$")
    unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
    parts = F.regexp_extract_all(t, F.lit(r"((?:\d+(?:\.\d*)?|\.\d+)(?:ns|us|µs|ms|s|m|h))"), F.lit(1))
    factor = lambda p: F.coalesce(*[F.when(F.regexp_replace(p, r"[\d.]+", "") == u, F.lit(x)) for u, x in unit.items()])
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.regexp_replace(p, r"[^\d.]", "").try_cast("double") * factor(p))
    return F.when(t == "0", 0.0).when(fits, F.when(t.startswith("-"), -total).otherwise(total))


def iso_duration(text: Column) -> Column:
    """``struct(months, days, seconds)`` of an ISO 8601 duration, nominal parts apart; null if refused."""
    pattern = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    t = F.trim(text)
    g = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).try_cast("double"), F.lit(0.0))
    fits = t.rlike(pattern) & ~t.rlike(r"(^P|T)$")
    return F.when(fits, F.struct((g(1) * 12 + g(2)).cast("long").alias("months"), (g(3) * 7 + g(4)).cast("long").alias("days"), (g(5) * 3600 + g(6) * 60 + g(7)).alias("seconds")))


def short_duration(text: Column) -> Column:
    """Seconds of ``1d 2h 30m``-like shorthand and of ``h:mm:ss``; null if refused."""
    t = F.lower(F.trim(text))
    clock = t.rlike(r"^\d+:[0-5]\d(:[0-5]\d)?$")
    p = F.split(t, ":")
    seconds = F.try_element_at(p, F.lit(1)).try_cast("long") * 3600 + F.try_element_at(p, F.lit(2)).try_cast("long") * 60 + F.coalesce(F.try_element_at(p, F.lit(3)).try_cast("long"), F.lit(0))
    fits = t.rlike(r"^(\d+\s*[wdhms]\s*)+$")
    parts = F.regexp_extract_all(t, F.lit(r"(\d+\s*[wdhms])"), F.lit(1))
    unit = lambda x: F.when(x.endswith("w"), 604800).when(x.endswith("d"), 86400).when(x.endswith("h"), 3600).when(x.endswith("m"), 60).otherwise(1)
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + F.regexp_extract(x, r"(\d+)", 1).cast("long") * unit(x))
    return F.when(clock, seconds).when(fits, total)


def local_to_utc(local: Column, zone: Column, policy: str = "flag") -> Column:
    """``struct(utc, status)`` of a wall time and zone: ok, ambiguous, nonexistent or unparsed.

    ``flag`` leaves doubtful times null; ``earlier`` and ``later`` choose an offset on an overlap;
    ``shift_forward`` moves a time in a gap past it.
    """
    wall = local.try_cast("timestamp_ntz").cast("timestamp")
    utc = F.to_utc_timestamp(wall, zone)
    gap = F.from_utc_timestamp(utc, zone) != wall
    overlap = F.from_utc_timestamp(utc + F.expr("interval 1 hour"), zone) == wall
    status = F.when(wall.isNull(), "unparsed").when(gap, "nonexistent").when(overlap, "ambiguous").otherwise("ok")
    pick = {"flag": F.lit(None).cast("timestamp"), "earlier": utc, "later": utc + F.expr("interval 1 hour"), "shift_forward": F.lit(None).cast("timestamp")}[policy]
    moved = utc if policy == "shift_forward" else F.lit(None).cast("timestamp")
    return F.struct(F.when(status == "ok", utc).when(status == "ambiguous", pick).when(status == "nonexistent", moved).alias("utc"), status.alias("status"))


# Log levels by severity.
LEVELS = {"CRITICAL": 50, "FATAL": 50, "ERROR": 40, "WARNING": 30, "WARN": 30, "INFO": 20, "DEBUG": 10, "TRACE": 5}
_GENERIC = r"^\[?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S*)\]?\s+\[?(CRITICAL|FATAL|ERROR|WARNING|WARN|INFO|DEBUG|TRACE)\]?[\s:-]+(.*)$"
_ACCESS = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([^"]*)" (\d{3}) \S+'


def parse_log(line: Column) -> Column:
    """``struct(format, level, ts, message)``: JSON, then stamped lines, then access logs, then a level's word."""
    t = F.trim(line)
    obj = F.from_json(t, "level string, severity string, timestamp string, time string, ts string, message string, msg string", {"mode": "PERMISSIVE"})
    is_json = t.startswith("{") & F.try_parse_json(t).isNotNull()
    level = F.upper(F.coalesce(obj["level"], obj["severity"], F.lit("INFO")))
    status = F.regexp_extract(line, _ACCESS, 4).try_cast("int")
    by_status = F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO")
    word = F.coalesce(*[F.when(F.upper(line).rlike(rf"\b{k}\b"), F.lit(k)) for k in sorted(LEVELS, key=lambda k: -LEVELS[k])], F.lit("UNKNOWN"))
    row = lambda kind, lv, ts, message: F.struct(F.lit(kind).alias("format"), lv.alias("level"), ts.alias("ts"), message.alias("message"))
    none = F.lit(None).cast("string")
    return (
        F.when(t == "", row("blank", F.lit("UNKNOWN"), none, F.lit("")))
        .when(is_json, row("json", F.when(level.isin(*LEVELS), level).otherwise("INFO"), F.coalesce(obj["timestamp"], obj["time"], obj["ts"]), F.coalesce(obj["message"], obj["msg"], t)))
        .when(line.rlike("(?i)" + _GENERIC), row("generic", F.upper(F.regexp_extract(line, "(?i)" + _GENERIC, 2)), F.regexp_extract(line, "(?i)" + _GENERIC, 1), F.trim(F.regexp_extract(line, "(?i)" + _GENERIC, 3))))
        .when(line.rlike(_ACCESS), row("access", by_status, F.regexp_extract(line, _ACCESS, 2), F.concat(F.regexp_extract(line, _ACCESS, 3), F.lit(" -> "), status)))
        .otherwise(F.struct(F.when(word == "UNKNOWN", "unparsed").otherwise("keyword").alias("format"), word.alias("level"), none.alias("ts"), t.alias("message")))
    )


def slugify(text: Column) -> Column:
    """Lower-case letters and digits joined by single hyphens; accents of Latin letters are dropped."""
    accents = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
    plain = "aaaaaaceeeeiiiinooooouuuuyy"
    t = F.translate(F.lower(text), accents, plain)
    return F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("ß"), F.lit("ss")), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def safe_filename(text: Column, max_bytes: int = 255) -> Column:
    """A name that Windows and POSIX both take: no reserved signs or names, no trailing dots or spaces."""
    t = F.regexp_replace(F.regexp_replace(text, r"[<>:\"/\\|?*\x00-\x1f]", "_"), r"[. ]+$", "")
    t = F.when(F.lower(F.substring_index(t, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), t)).otherwise(t)
    t = F.when(t == "", "_").otherwise(t)
    return F.when(F.octet_length(t) <= max_bytes, t).otherwise(F.substring(t, 1, max_bytes // 4))


def phone_e164(text: Column, dial: str = "1", national_digits: int = 10) -> Column:
    """``+`` and digits, where a number has its country's code or a national length; null if refused."""
    digits = F.regexp_replace(text, r"[^\d+]", "")
    bare = F.regexp_replace(digits, r"\D", "")
    return (
        F.when(digits.startswith("+") & F.length(bare).between(8, 15), F.concat(F.lit("+"), bare))
        .when(digits.startswith("00") & (F.length(bare) >= 10), F.concat(F.lit("+"), F.substring(bare, 3, 15)))
        .when(F.length(bare) == national_digits, F.concat(F.lit(f"+{dial}"), bare))
        .when((F.length(bare) == national_digits + len(dial)) & bare.startswith(dial), F.concat(F.lit("+"), bare))
    )


def email_ok(text: Column) -> Column:
    """The dot-atom grammar of an address: 64 and 255 octets at most, labels of 63, no edge hyphens."""
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    label = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    atom = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
    return F.coalesce(text.rlike(rf"^{atom}(?:\.{atom})*@{label}(?:\.{label})+$") & (F.octet_length(local) <= 64) & (F.octet_length(domain) <= 255), F.lit(False))


def round_money(amount: Column, exponent: int, mode: str = "half_up", step: str | None = None) -> Column:
    """A decimal rounded to a currency's exponent or cash step by a named mode."""
    unit = F.lit(step or "1e-%d" % exponent).cast("decimal(38,10)")
    n = (amount.cast("decimal(38,10)") / unit).cast("decimal(38,10)")
    whole = {
        "half_up": lambda: F.round(n, 0), "half_even": lambda: F.bround(n, 0), "floor": lambda: F.floor(n), "ceiling": lambda: F.ceil(n),
        "down": lambda: F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)), "up": lambda: F.when(n < 0, F.floor(n)).otherwise(F.ceil(n)),
    }[mode]()
    return (whole.cast("decimal(28,0)") * unit).cast(f"decimal(28,{max(exponent, 0)})")
