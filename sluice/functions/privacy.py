"""Masks, tokens, generalisations and detectors of personal data as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of personal data and secrets.
PII = {
    "Email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "Phone (US)": r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "Credit Card": r"\b(?:\d[ -]*?){13,16}\b",
    "IP Address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "Date of Birth": r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b",
    "US Zip Code": r"\b\d{5}(?:-\d{4})?\b",
}
SECRETS = {
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "api_key": r"\b(?:sk|pk|api)[-_][A-Za-z0-9]{16,}\b",
    "bearer": r"\bBearer\s+[A-Za-z0-9._-]{20,}\b",
}
BLOCK = "█"


def hash_value(value: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(value.cast("string"), 256), 1, length)


def token_value(value: Column, salt: bytes, length: int = 12) -> Column:
    """``tok_`` and the start of the base-32 HMAC-SHA256 of the value, made of built-in functions.

    HMAC is two nested SHA-256 over the salt's padded blocks; base 32 comes from the digest's bits, which
    are made once a value.
    """
    import hashlib

    key = hashlib.sha256(salt).digest() if len(salt) > 64 else salt
    key = key.ljust(64, b"\0")
    inner, outer = bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)
    text = F.encode(value.cast("string"), "UTF-8")
    first = F.unhex(F.sha2(F.concat(F.lit(inner), text), 256))
    digest = F.sha2(F.concat(F.lit(outer), first), 256)
    parts = range(min(8, -(-5 * length // 32)))
    binary = lambda d: F.concat(*[F.lpad(F.conv(F.substring(d, 1 + 8 * i, 8), 16, 2), 32, "0") for i in parts])
    bits = F.rpad(F.element_at(F.transform(F.array(digest), binary), 1), 260, "0")
    letters = F.lit("abcdefghijklmnopqrstuvwxyz234567")
    letter = lambda b, i: F.substring(letters, F.conv(F.substr(b, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    code = F.transform(F.array(bits), lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: letter(b, i)), ""))
    return F.when(value.isNotNull(), F.concat(F.lit("tok_"), F.element_at(code, 1)))


def mask_keep_last(value: Column, n: int = 4) -> Column:
    """A star for each digit but the last ``n``, and these, where there are more digits than that.

    Texts with fewer digits keep their last ``n`` characters; texts of ``n`` characters or fewer are
    stars only.
    """
    text = value.cast("string")
    digits = F.regexp_replace(text, r"\D", "")
    last = lambda x: F.concat(F.repeat(F.lit("*"), F.length(x) - n), F.right(x, F.lit(n)))
    return F.when(F.length(digits) > n, last(digits)).when(F.length(text) > n, last(text)).otherwise(F.repeat(F.lit("*"), F.length(text)))


def mask_email(value: Column) -> Column:
    """The first letter and the domain stay, at least one star between; a value without an address is masked whole."""
    local = F.substring_index(value, "@", 1)
    masked = F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(local) - 1, F.lit(1))), F.lit("@"), F.substring_index(value, "@", -1))
    return F.when(F.contains(value, F.lit("@")), masked).otherwise(mask_keep_last(value))


def mask_match(kind: str, match: Column) -> Column:
    """A found value's mask by its kind."""
    digits = F.regexp_replace(match, r"\D", "")
    last4 = F.concat(F.repeat(F.lit(BLOCK), F.length(digits) - 4), F.right(digits, F.lit(4)))
    if kind == "Email":
        local = F.substring_index(match, "@", 1)
        return F.concat(F.substring(local, 1, 1), F.repeat(F.lit(BLOCK), F.length(local) - 1), F.lit("@"), F.substring_index(match, "@", -1))
    if kind == "SSN":
        return F.concat(F.lit("XXX-XX-"), F.right(match, F.lit(4)))
    if kind in ("Credit Card", "Phone (US)"):
        return last4
    return F.repeat(F.lit(BLOCK), F.length(match))


def age_band(birth: Column, today: str, width: int = 10) -> Column:
    age = F.floor(F.datediff(F.lit(today).cast("date"), birth.cast("date")) / 365.25)
    low = F.floor(age / width) * width
    return F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))


def zip_prefix(value: Column, digits: int = 3) -> Column:
    kept = F.substring(F.regexp_replace(value.cast("string"), r"\D", ""), 1, 5)
    return F.when(F.length(kept) > 0, F.concat(F.substring(kept, 1, digits), F.repeat(F.lit("*"), F.greatest(F.length(kept) - digits, F.lit(0)))))


def numeric_band(value: Column, width: float) -> Column:
    low = (F.floor(value / width) * width).cast("long")
    return F.concat(F.format_number(low, 0), F.lit("-"), F.format_number(low + int(width), 0))
