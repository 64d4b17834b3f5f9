"""Evaluation of predictions as set operations: votes, counts, ranks and running sums.

Curves and ranks need an order of scores. It is built on distinct scores of a group with their
counts, so equal scores share a rank, and in ranges, so no group has to fit one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics as M
from .prefix import prefix_sums


def ensemble(predictions: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    """Median confidence of each key over the runs, and the vote on it."""
    return exact_median(predictions.na.drop(subset=keys), keys, confidence, "confidence").withColumn("prediction", M.vote(F.col("confidence")))


def exact_median(rows: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    """(group, ``name``): the median of ``value`` in each group, null where it has no value. Values are
    counted and their counts added up in ranges, so a group of any size is nowhere in one buffer."""
    counts = rows.groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    running = prefix_sums(counts.filter("_v IS NOT NULL"), group, [F.col("_v")], {"_upto": F.col("_n")})
    totals = counts.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("_t"))
    totals = totals.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "_t")
    same = F.lit(True)
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    at = lambda k: F.max(F.when((F.col("_upto") - F.col("_n") < k) & (F.col("_upto") >= k), F.col("_v")))
    low, high = at(F.floor((F.col("_t") + 1) / 2)), at(F.floor(F.col("_t") / 2) + 1)
    joined = totals.join(running, same, "left")
    found = joined.groupBy(*[f"_g{k}" for k in range(len(group))]).agg(((low + high) / 2).alias(name))
    return found.select(*[F.col(f"_g{k}").alias(g) for k, g in enumerate(group)], name)


def confusion(predictions: DataFrame, group: list[str], label: str, prediction: str) -> DataFrame:
    """(group, tp, fp, fn, tn) in one pass; rows without label or prediction are left out."""
    y, p = F.col(label) > 0, F.col(prediction) > 0
    clean = predictions.na.drop(subset=[label, prediction])
    return clean.groupBy(*group).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def classification_metrics(counts: DataFrame, group: list[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(*group, M.accuracy(tp, fp, fn, tn).alias("accuracy"), M.precision(tp, fp).alias("precision"), M.recall(tp, fn).alias("recall"), M.f1(tp, fp, fn).alias("f1"), M.mcc(tp, fp, fn, tn).alias("mcc"))


def score_counts(predictions: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """(group, score, pos, neg): labels at each distinct score."""
    y = F.col(label) > 0
    return predictions.na.drop(subset=[label, score]).groupBy(*group, F.col(score).alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def auc(predictions: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """(group, auc) by the rank sum, ties shared; null for groups with one class only."""
    counts = score_counts(predictions, group, label, score)
    ranked = prefix_sums(counts, group, [F.col("score")], {"below": F.col("neg")}, inclusive=False)
    summed = ranked.withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2)).groupBy(*group).agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return summed.select(*group, F.try_divide(F.col("won"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def _running(predictions: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    counts = score_counts(predictions, group, label, score)
    running = prefix_sums(counts, group, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = counts.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return running.join(totals, same).drop(*[f"_g_{g}" for g in group])


def roc_points(predictions: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """(group, threshold, fpr, tpr) at every distinct score, and the start (0, 0) above all."""
    points = _running(predictions, group, label, score).select(*group, F.col("score").cast("double").alias("threshold"), M.ratio(F.col("fp"), F.col("n")).alias("fpr"), M.ratio(F.col("tp"), F.col("p")).alias("tpr"))
    start = points.select(*group).distinct().select(*group, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_points(predictions: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """(group, threshold, precision, recall) at every distinct score, and the end point with
    precision 1 and recall 0."""
    points = _running(predictions, group, label, score)
    curve = points.select(*group, F.col("score").cast("double").alias("threshold"), M.precision(F.col("tp"), F.col("fp")).alias("precision"), M.ratio(F.col("tp"), F.col("p")).alias("recall"))
    ends = points.select(*group).distinct().select(*group, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(ends)


def regression_metrics(predictions: DataFrame, group: list[str], target: str, prediction: str) -> DataFrame:
    """(group, mse, r2) from sums in one pass."""
    y, e = F.col(target).cast("double"), F.col(target).cast("double") - F.col(prediction)
    sums = predictions.na.drop(subset=[target, prediction]).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.var_pop(y).alias("var"))
    return sums.select(*group, (F.col("sse") / F.col("n")).alias("mse"), (1 - F.try_divide(F.col("sse"), F.col("n") * F.col("var"))).alias("r2"))


def fitted_line(rows: DataFrame, group: list[str], y: str, x: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def best_with_ties(rows: DataFrame, group: list[str], score: Column) -> DataFrame:
    """Rows whose score is their group's largest, ties included."""
    top = rows.withColumn("_s", score)
    most = top.groupBy(*group).agg(F.max("_s").alias("_m"))
    return top.join(most, group).filter("_s = _m").drop("_s", "_m")


def best_first(rows: DataFrame, score: str, tie: list[str]) -> DataFrame:
    return rows.orderBy(F.col(score).desc_nulls_last(), *tie).limit(1)


def mann_whitney(values: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, u, p_value) for each pair of groups a < b: U of a and its two-sided p. That is exact where
    the smaller group has at most ``EXACT`` values and no value is in the pair twice, else by the normal
    approximation with tie and continuity correction. Only counts at distinct values are paired."""
    counts = values.na.drop(subset=[group, value]).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    names = sizes.select(F.col(group).alias("a"), F.col("size").alias("na")).join(sizes.select(F.col(group).alias("b"), F.col("size").alias("nb")), F.col("a") < F.col("b"))
    one = names.join(counts.select(F.col(group).alias("a"), F.col(value).alias("v"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")), "a")
    two = names.join(counts.select(F.col(group).alias("b"), F.col(value).alias("v"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")), "b")
    merged = one.unionByName(two).groupBy("a", "b", "na", "nb", "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    ranked = prefix_sums(merged, ["a", "b"], [F.col("v")], {"below": F.col("y")}, inclusive=False)
    won = ranked.withColumn("won", F.col("x") * (F.col("below") + F.col("y") / 2)).withColumn("t", (F.col("x") + F.col("y")).cast("double"))
    u = won.groupBy("a", "b", "na", "nb").agg(F.sum("won").alias("u"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.greatest(F.lit(0.0), F.try_divide(F.abs(F.col("u") - na * nb / 2) - 0.5, sd))
    # One row a pair: the exact distribution takes a task some milliseconds a row.
    exact = _exact_p(F.col("na"), F.col("nb"), F.least(F.col("u"), na * nb - F.col("u")))
    small = (F.col("ties") == 0) & (F.least("na", "nb") <= EXACT)
    p = F.when(small, exact).otherwise(F.least(F.lit(1.0), _two_sided(F.coalesce(z, F.lit(0.0)))))
    return u.select("a", "b", F.col("u").cast("double").alias("u"), p.alias("p_value"))


#: Values of the smaller group up to which the distribution of U is computed.
EXACT = 8


def u_distribution(m: int, n: int, most: int) -> np.ndarray:
    """How many of the ways to draw ``m`` of ``m + n`` ranks have U = 0, 1, ..., ``most``: coefficients of
    the Gaussian binomial, as products of (1 - q^(n + i)) / (1 - q^i)."""
    ways = np.zeros(most + 1)
    ways[0] = 1.0
    for i in range(1, m + 1):
        if n + i <= most:
            ways[n + i :] -= ways[: most + 1 - n - i].copy()
        for first in range(min(i, most + 1)):  # divide: running sums of every i-th
            ways[first::i] = np.cumsum(ways[first::i])
    return ways


@F.pandas_udf(T.DoubleType())
def _exact_p(na: pd.Series, nb: pd.Series, u: pd.Series) -> pd.Series:
    def one(a: float, b: float, least: float) -> float | None:
        m, n = sorted((int(a), int(b)))
        if m > EXACT:
            return None
        return min(1.0, 2 * float(u_distribution(m, n, int(least)).sum()) / math.comb(m + n, m))

    return pd.Series([one(*x) for x in zip(na, nb, u, strict=True)], dtype="float64")


def _two_sided(z: Column) -> Column:
    """Two-sided normal tail probability, by a rational approximation good to 1.2e-7 relative."""
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    # Chebyshev coefficients of the complementary error function.
    fixed = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly: Column = F.lit(fixed[-1])
    for c in fixed[-2::-1]:
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)


def median_by_run(shap: DataFrame, run: str, feature: str, value: str, shap_value: str) -> DataFrame:
    """(run, feature, value, median): attribution rolled up for each value of a feature."""
    return exact_median(shap, [run, feature, value], shap_value)


def top_by_mean_abs(shap: DataFrame, feature: str, shap_value: str, k: int = 20) -> DataFrame:
    """The ``k`` features with the largest mean absolute attribution."""
    means = shap.groupBy(feature).agg(F.avg(F.abs(F.col(shap_value))).alias("mean_abs"))
    return means.orderBy(F.col("mean_abs").desc(), feature).limit(k)


def compare_methods(predictions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(best cut-offs by method, their metrics of every run) from rows of (model, cut_off, run,
    keys, label, confidence): cut-offs are ranked by the MCC of the votes, ties kept."""
    votes = ensemble(predictions, ["model", "cut_off", *keys, "label"])
    by_cut = classification_metrics(confusion(votes, ["model", "cut_off"], "label", "prediction"), ["model", "cut_off"])
    best = best_with_ties(by_cut, ["model"], F.col("mcc"))
    chosen = predictions.join(F.broadcast(best.select("model", "cut_off")), ["model", "cut_off"], "left_semi").withColumn("prediction", M.vote(F.col("confidence")))
    return best, classification_metrics(confusion(chosen, ["model", "cut_off", "run"], "label", "prediction"), ["model", "cut_off", "run"])


def describe(rows: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """One row: number, mean, deviation, least, median and most of ``value``, and how many values
    reach each of ``thresholds`` (``reach_0``, ``reach_1``, ...)."""
    v = F.col(value)
    return rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.median(v).alias("median"), F.max(v).alias("most"), *[F.count_if(v >= t).alias(f"reach_{k}") for k, t in enumerate(thresholds)])


def by_dataset(rows: DataFrame, dataset: str, model: str, models: list, value: str) -> DataFrame:
    """Datasets against models: the median of ``value`` in each cell."""
    return spread(exact_median(rows, [dataset, model], value), dataset, model, models, F.max("median"))


def spread(rows: DataFrame, row: str, column: str, columns: list, value: Column) -> DataFrame:
    """A report table: one column for each of ``columns``, ``value`` aggregated in each cell, null
    where there is nothing."""
    return rows.groupBy(row).pivot(column, columns).agg(value)
