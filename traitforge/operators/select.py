"""Feature scores in closed form over sparse presence, and selection by scores.

Presence is long: (row, feature) for values of 1; the rows carry the label. All moments of a
feature follow from the counts of its ones, so nothing is made wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _class_counts(present: DataFrame, labels: DataFrame, row: str, feature: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Ones of each (feature, class), zero counts included, and the classes' sizes."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ones = present.join(labels.select(row, label), row).groupBy(feature, label).agg(F.count(F.lit(1)).alias("s"))
    # One row for each feature and class; classes are few.
    grid = ones.select(feature).distinct().crossJoin(F.broadcast(sizes))
    return grid.join(ones, [feature, label], "left").fillna(0, ["s"]), sizes


def _statistic(explained: Column, rest: Column) -> Column:
    """Their ratio; infinite if nothing is left to explain, null if there was nothing to begin with."""
    return F.when((rest == 0) & (explained > 0), F.lit(float("inf"))).otherwise(F.try_divide(explained, rest))


def anova_f(present: DataFrame, labels: DataFrame, row: str, feature: str = "feature", label: str = "label") -> DataFrame:
    """(feature, score): one-way analysis of variance of a 0/1 feature across classes; null where
    there is one class only, or as many classes as rows."""
    counts, _ = _class_counts(present, labels, row, feature, label)
    s, n = F.col("s").cast("double"), F.col("n").cast("double")
    sums = counts.groupBy(feature).agg(F.sum(s).alias("total"), F.sum(n).alias("rows"), F.sum(s * s / n).alias("between"), F.count(F.lit(1)).alias("k"))
    correction = F.col("total") * F.col("total") / F.col("rows")
    ssb, ssw = F.col("between") - correction, F.col("total") - F.col("between")
    return sums.select(feature, _statistic(F.try_divide(ssb, F.col("k") - 1), F.try_divide(ssw, F.col("rows") - F.col("k"))).alias("score"))


def chi2(present: DataFrame, labels: DataFrame, row: str, feature: str = "feature", label: str = "label") -> DataFrame:
    """(feature, score): observed sums by class against the class shares of the feature's sum."""
    counts, _ = _class_counts(present, labels, row, feature, label)
    per_feature = counts.groupBy(feature).agg(F.sum("s").alias("total"), F.sum("n").alias("rows"))
    joined = counts.join(per_feature, feature)
    expected = F.col("total") * F.col("n") / F.col("rows")
    return joined.groupBy(feature).agg(F.sum(F.try_divide((F.col("s") - expected) * (F.col("s") - expected), expected)).alias("score"))


def regression_f(present: DataFrame, targets: DataFrame, row: str, feature: str = "feature", target: str = "target") -> DataFrame:
    """(feature, score): F of a univariate linear regression on a 0/1 feature. Where ``present`` holds the
    rows' targets itself, its many rows need not meet ``targets`` in a join."""
    totals = targets.agg(F.count(target).alias("n"), F.sum(target).alias("sy"), F.sum(F.col(target) * F.col(target)).alias("syy"))
    known = present if target in present.columns else present.join(targets.select(row, target), row)
    sums = known.groupBy(feature).agg(F.count(F.lit(1)).cast("double").alias("sx"), F.sum(target).alias("sxy"))
    j = sums.crossJoin(F.broadcast(totals))  # one row of totals
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx, vy = F.col("n") * F.col("sx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    r2 = F.try_divide(cov * cov, vx * vy)
    return j.select(feature, _statistic(r2 * (F.col("n") - 2), 1 - r2).alias("score"))


def top_features(scores: DataFrame, k: int, feature: str = "feature") -> DataFrame:
    """The ``k`` features with the largest scores; equal scores in order of name."""
    return scores.orderBy(F.col("score").desc_nulls_last(), feature).limit(k)


def drop_lowest(scores: DataFrame, n: int, feature: str = "feature") -> DataFrame:
    """All but the ``n`` features with the lowest scores."""
    return scores.join(F.broadcast(scores.orderBy(F.col("score").asc_nulls_first(), F.col(feature).desc()).limit(n).select(feature)), feature, "left_anti")


def elimination_step(features: int, wanted: int) -> int:
    """Features dropped in each round of recursive elimination but a shorter last one."""
    return max(1, (features - wanted) // 10)
