"""Metric formulas over aggregated counts; zero denominators give the stated value, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def accuracy(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return ratio(tp + tn, tp + fp + fn + tn)


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """In doubles, since the product of four counts outgrows integers."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    return ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def at_least(count: Column, total: Column, threshold: float) -> Column:
    """A fraction of the total up to 1, a count above it."""
    return ratio(count, total) >= threshold if threshold <= 1 else count >= threshold


def vote(confidence: Column) -> Column:
    return (confidence > 0.5).cast("int")
