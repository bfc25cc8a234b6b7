"""Ordered classifiers: the first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes by pattern, in order; the label of the first match.
SHAPES = (
    ("triangle", r"triang|delta|wedge|\bv[ -]shape"), ("disk", r"dis[ck]|saucer|plate"), ("cigar", r"cigar|cylind|\brod\b|tube"), ("sphere", r"spher|\borb\b|globe|\bball\b"),
    ("oval", r"oval|\begg\b|ellip"), ("fireball", r"fire ?ball|flame|meteor"), ("chevron", r"chevron|boomerang"), ("diamond", r"diamond|rhomb|kite"),
    ("cone", r"\bcone|bell|funnel"), ("cross", r"cross|plus sign"), ("formation", r"formation|cluster|string of"), ("light", r"light|glow"),
)


def first_match(text: Column, rules: tuple[tuple[str, str], ...], other: str | None = None) -> Column:
    """Label of the first rule whose pattern occurs in the lower-cased text."""
    low, out = F.lower(text), F.lit(other)
    for label, pattern in reversed(rules):
        out = F.when(F.coalesce(low.rlike(pattern), F.lit(False)), F.lit(label)).otherwise(out)
    return out


def classify(fields: dict[str, tuple[Column, str]], rules: tuple[tuple[str, str], ...] = SHAPES) -> Column:
    """label, source and confidence from the first field, in order, in which a rule fits; 'unknown' if none does."""
    out = F.struct(F.lit("unknown").alias("label"), F.lit(None).cast("string").alias("source"), F.lit("none").alias("confidence"))
    for name, (text, confidence) in reversed(list(fields.items())):
        label = first_match(text, rules)
        out = F.when(label.isNotNull(), F.struct(label.alias("label"), F.lit(name).alias("source"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out
