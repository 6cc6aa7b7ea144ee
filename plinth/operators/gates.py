"""Validation gates. Every threshold is an argument that must be given: a gate has no default to pass by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def back_aggregation_bias(parent: Column, children: Column) -> Column:
    """Per cent by which the children's sum misses the parent; null for a parent of 0, which never passes."""
    return F.try_divide((children - parent) * 100, parent)


def within(value: Column, most: float | None) -> Column:
    """Whether |value| is at most `most`; null doesn't pass."""
    if most is None:
        raise ValueError("a threshold is required")
    return F.coalesce(F.abs(value) <= most, F.lit(False))


def at_least(value: Column, least: float | None) -> Column:
    if least is None:
        raise ValueError("a threshold is required")
    return F.coalesce(value >= least, F.lit(False))


def decision(steps: list[tuple[Column, str]]) -> Column:
    """First step that fails (its column is false or null) as the outcome; `publish` if none does."""
    out = None
    for ok, outcome in steps:
        failed = ~F.coalesce(ok, F.lit(False))
        out = F.when(failed, outcome) if out is None else out.when(failed, outcome)
    return out.otherwise("publish")


def spread(values: list[Column]) -> Column:
    """Range over mean; null for a mean of 0."""
    return F.try_divide(F.greatest(*values) - F.least(*values), sum(values[1:], values[0]) / len(values))
