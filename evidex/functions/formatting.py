"""Labels and durations for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_label(label: Column) -> Column:
    """Lower case, but words of more than one capital stay."""
    return F.array_join(F.transform(F.split(label, " "), lambda w: F.when(F.length(F.regexp_replace(w, "[^A-Z]", "")) > 1, w).otherwise(F.lower(w))), " ")


def duration(seconds: Column) -> Column:
    """Seconds below 120, then minutes below 7200 s, hours below 172800 s, days."""
    show = lambda v, unit: F.concat(F.round(v, 0).cast("long").cast("string"), F.lit(f" {unit}"))
    return F.when(seconds < 120, show(seconds, "s")).when(seconds < 7200, show(seconds / 60, "min")).when(seconds < 172800, show(seconds / 3600, "h")).otherwise(show(seconds / 86400, "days"))


def mentions(text: Column, terms: list[str], limit: int = 4) -> Column:
    """Glossary terms in order of first appearance, a plural s allowed."""
    places = F.array(*(F.struct(F.regexp_instr(text, F.lit(rf"(?i)\b{t}s?\b")).alias("at"), F.lit(t).alias("term")) for t in terms))
    found = F.sort_array(F.filter(places, lambda p: p["at"] > 0))
    return F.slice(F.transform(found, lambda p: p["term"]), 1, limit)
