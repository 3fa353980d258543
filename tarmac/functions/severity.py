"""Severity-driven expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.model import OTHER_COLOUR, RISK_WEIGHT, SEVERITY_COLOUR


def risk_weight(severity: Column) -> Column:
    """Hotspot weight of one collision; unknown severities weigh nothing."""
    weight = F.lit(0)
    for name, value in RISK_WEIGHT.items():
        weight = F.when(severity == name, value).otherwise(weight)
    return weight.cast("bigint")


def colour(severity: Column) -> Column:
    """Map colour as an ``ARRAY<INT>`` of red, green, blue, alpha."""
    shade = F.array(*[F.lit(v) for v in OTHER_COLOUR])
    for name, rgba in SEVERITY_COLOUR.items():
        shade = F.when(severity == name, F.array(*[F.lit(v) for v in rgba])).otherwise(shade)
    return shade


def count_if(condition: Column) -> Column:
    """Number of rows meeting the condition, 0 rather than NULL for none."""
    return F.count(F.when(condition, 1))


def sum_if(condition: Column, value: Column) -> Column:
    """Sum over the rows meeting the condition, counting the others as 0."""
    return F.sum(F.when(condition, value).otherwise(0))
