"""Train and test splits, presence filters across groups, and class weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sums


def common_features(train: DataFrame, test: DataFrame, feature: str = "feature") -> DataFrame:
    """Features that occur on both sides."""
    return train.select(feature).intersect(test.select(feature))


def group_presence(present: DataFrame, least: int, feature: str = "feature", group: str = "group") -> DataFrame:
    """Features that occur in at least ``least`` different groups."""
    counted = present.na.drop(subset=[feature, group]).groupBy(feature).agg(F.countDistinct(group).alias("groups"))
    return counted.filter(F.col("groups") >= least)


def group_sizes(rows: DataFrame, group: str, positive: Column) -> DataFrame:
    """(group, size, has_positive), from one aggregation over all rows."""
    return rows.na.drop(subset=[group]).groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.bool_or(positive), F.lit(False)).alias("has_positive"))


def split_groups(sizes: list[tuple], seed: int, attempts: int = 10, share: float = 0.8) -> tuple[set, set] | None:
    """Whole groups into train until it has ``share`` of the rows, the rest into test, with a
    positive on both sides if some attempt gives one. ``sizes`` lists (group, size, has_positive):
    one entry for each group of genomes. None if no attempt leaves two test rows."""
    ordered = sorted(sizes, key=lambda g: str(g[0]))
    total, want_positive = sum(s for _, s, _ in ordered), sum(p for *_, p in ordered) >= 2
    for attempt in range(attempts if want_positive else 1):
        shuffled = [ordered[i] for i in np.random.RandomState(seed * 1000 + attempt * 17).permutation(len(ordered))]
        train, test, n = [], [], 0
        for g in shuffled:
            (train if n < int(share * total) else test).append(g)
            n += g[1]
        if train and sum(s for _, s, _ in test) >= 2 and (not want_positive or all(any(p for *_, p in side) for side in (train, test))):
            return {g for g, *_ in train}, {g for g, *_ in test}
    return None


def split_by_group(rows: DataFrame, group: str, label: str, seed: int = 0, share: float = 0.8) -> DataFrame:
    """``rows`` with ``fold`` (train or test), no group on both sides; by row where groups cannot
    be split. Only group sizes reach the driver."""
    sizes = [tuple(r) for r in group_sizes(rows, group, F.col(label) > 0).collect()]
    parts = split_groups(sizes, seed, share=share)
    if parts is None:
        return split_rows(rows, seed, share, F.col(label) > 0)
    spark = rows.sparkSession
    folds = spark.createDataFrame([(g, "train") for g in sorted(parts[0], key=str)] + [(g, "test") for g in sorted(parts[1], key=str)], rows.select(group).withColumn("fold", F.lit("")).schema)
    return rows.join(F.broadcast(folds), group)


def split_rows(rows: DataFrame, seed: int = 0, share: float = 0.8, positive: Column | None = None, attempts: int = 10) -> DataFrame:
    """``rows`` with ``fold`` from a seeded hash of the row, which no repartitioning changes. With
    ``positive``, the first of ``attempts`` seeds that leaves a positive on both sides, if any does;
    one aggregation tries them all."""

    def in_train(s: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(s), *rows.columns), F.lit(1_000_000)) / 1_000_000 < share

    seeds = [seed * 1000 + k * 17 for k in range(attempts if positive is not None else 1)]
    chosen = seeds[0]
    if positive is not None:
        tried = rows.agg(*[(F.coalesce(F.bool_or(positive & in_train(s)), F.lit(False)) & F.coalesce(F.bool_or(positive & ~in_train(s)), F.lit(False))).alias(f"a{k}") for k, s in enumerate(seeds)]).first()
        chosen = next((s for s, good in zip(seeds, tried, strict=True) if good), chosen)
    return rows.withColumn("fold", F.when(in_train(chosen), "train").otherwise("test"))


def split_rows_runs(rows: DataFrame, runs: dict[str, int], share: float = 0.8, positive: Column | None = None, attempts: int = 10) -> DataFrame:
    """``rows`` once for each of ``runs`` (name to seed) with ``run`` and ``fold``, the folds that
    :func:`split_rows` gives with that seed. One aggregation tries the attempts of all runs; a row for
    each attempt reaches the driver."""

    def in_train(s: Column) -> Column:
        return F.pmod(F.xxhash64(s, *rows.columns), F.lit(1_000_000)) / 1_000_000 < share

    tries = {name: [seed * 1000 + k * 17 for k in range(attempts if positive is not None else 1)] for name, seed in runs.items()}
    chosen = {name: seeds[0] for name, seeds in tries.items()}
    if positive is not None:
        every = F.explode(F.array(*[F.lit(s) for s in sorted({s for seeds in tries.values() for s in seeds})]))
        held = rows.filter(positive).withColumn("_s", every).groupBy("_s")
        sides = held.agg(F.bool_or(in_train(F.col("_s"))).alias("a"), F.bool_or(~in_train(F.col("_s"))).alias("b"))
        good = {r["_s"] for r in sides.collect() if r.a and r.b}
        chosen = {name: next((s for s in seeds if s in good), seeds[0]) for name, seeds in tries.items()}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("run"), F.lit(s).alias("seed")) for name, s in chosen.items()]))
    return rows.withColumn("_r", each).select(*rows.columns, F.col("_r.run").alias("run"), F.when(in_train(F.col("_r.seed")), "train").otherwise("test").alias("fold"))


def split_by_group_runs(rows: DataFrame, group: str, label: str, runs: dict[str, int], share: float = 0.8) -> DataFrame:
    """The same with whole groups, as :func:`split_by_group` deals them; group sizes are counted once
    for all runs."""
    sizes = [tuple(r) for r in group_sizes(rows, group, F.col(label) > 0).collect()]
    parts = {name: split_groups(sizes, seed, share=share) for name, seed in runs.items()}
    dealt = [(name, g, fold) for name, sides in parts.items() if sides for fold, side in zip(("train", "test"), sides, strict=True) for g in sorted(side, key=str)]
    kind = rows.schema[group].dataType.simpleString()
    folds = rows.sparkSession.createDataFrame(dealt, f"run string, _g {kind}, fold string")
    out = rows.join(F.broadcast(folds), F.col(group) == F.col("_g")).select(*rows.columns, "run", "fold")
    lost = {name: runs[name] for name, sides in parts.items() if sides is None}
    return out.unionByName(split_rows_runs(rows, lost, share, F.col(label) > 0)) if lost else out


def map_groups(rows: DataFrame, groups: DataFrame, key: str, group: str = "group") -> DataFrame:
    """``rows`` with the ``group`` of their ``key``; a key without one stops the job and is named."""
    lost = F.raise_error(F.concat(F.lit(f"no {group} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.join(groups.select(key, F.col(group).alias("_group")), key, "left").withColumn(group, F.coalesce(F.col("_group"), lost.cast(groups.schema[group].dataType))).drop("_group")


def cumulative_split(rows: DataFrame, group: str, order: Column, share: float = 0.8) -> DataFrame:
    """(group, size, fold) as one query: groups in ``order`` go to train while the rows before them
    are fewer than ``share`` of all. One row for each group is sorted, not the rows."""
    sizes = rows.na.drop(subset=[group]).groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("_o", order)
    before = prefix_sums(sizes, [], [F.col("_o"), F.col(group)], {"before": F.col("size")}, inclusive=False)
    total = sizes.agg(F.floor(F.sum("size") * share).alias("target"))
    return before.crossJoin(F.broadcast(total)).select(group, "size", F.when(F.col("before") < F.col("target"), "train").otherwise("test").alias("fold"))


def class_weights(rows: DataFrame, group: str, label: str, method: str = "log10", smoothing: float = 1.0) -> DataFrame:
    """(group, positives, negatives, weight): the weight of positive rows; negatives weigh 1."""
    counts = rows.na.drop(subset=[group, label]).groupBy(group).agg(F.sum((F.col(label) > 0).cast("long")).alias("positives"), F.count(F.lit(1)).alias("total"))
    pos, neg = F.col("positives").cast("double"), (F.col("total") - F.col("positives")).cast("double")
    rules = {
        "log10": F.greatest(F.lit(1.0), F.coalesce(F.log10(neg / (pos + smoothing)) + 1, F.lit(1.0))),
        "inverse_frequency": F.col("total") / (pos + smoothing),
        "balanced": neg / (pos + smoothing),
    }
    if method not in rules:
        raise ValueError(f"unknown weights method {method!r}")
    weight = F.when(pos == 0, F.lit(float(smoothing))).otherwise(rules[method])
    return counts.select(group, "positives", (F.col("total") - F.col("positives")).alias("negatives"), weight.alias("weight"))


def row_weights(rows: DataFrame, weights: DataFrame, group: str, label: str) -> DataFrame:
    """``rows`` with ``weight``: their group's for positives, else and for unknown groups 1."""
    joined = rows.join(weights.select(group, F.col("weight").alias("_w")), group, "left")
    return joined.withColumn("weight", F.when(F.col(label) > 0, F.coalesce("_w", F.lit(1.0))).otherwise(F.lit(1.0))).drop("_w")
