"""Text keys and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_whitespace(value: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def normalize_key(value: Column) -> Column:
    """Lower-case key of letters and digits a-z 0-9, one blank between runs; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def word_tokens(value: Column) -> Column:
    """Word tokens: runs of letters, marks, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), 0)


def join_present(*parts: Column) -> Column:
    """Parts that are neither null nor blank, joined by comma and blank."""
    return F.concat_ws(", ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])


def searchable(*fields: Column) -> Column:
    """Lower-cased text of several fields, one a line; nulls count as empty."""
    return F.lower(F.concat_ws("\n", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def fnv1a(value: Column) -> Column:
    """32-bit FNV-1a of the characters' code points, as a long."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def stable_hash(prefix: str, length: int, **fields: Column) -> Column:
    """Prefix and the head of the SHA-1 of the fields as sorted, compact JSON with nulls kept."""
    payload = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix), F.substring(F.sha1(payload), 1, length))
