"""Values that say nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The import layer's null tokens and the statistics layer's unknown markers.
UNKNOWN_MARKERS = ("", "unknown", "unk", "n/a", "na", "none", "null", "-", "unresolved", "not_provided")


def says_something(value: Column) -> Column:
    """True where ``value`` is neither null, blank nor an unknown marker in any case."""
    return F.coalesce(~F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))).isin(*UNKNOWN_MARKERS), F.lit(False))


def clean(value: Column) -> Column:
    """``value`` trimmed, null where it says nothing."""
    return F.when(says_something(value), F.trim(value))
