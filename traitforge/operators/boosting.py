"""Boosting of symmetric trees over long presence, for all runs and grid settings at once.

All splits of one level of a tree are on one feature, present or absent, so a tree is a list of
features and a value for each leaf. Many ensembles grow side by side: one for each run (its folds
and features), rate and depth; fewer iterations are a prefix of more. A level of the next tree of all
of them takes one aggregation over (fit, feature), with the gradients' sums of each leaf in columns
of their own: tasks sum what their rows add, Spark adds that up and picks the best gain. The
number of jobs depends on the rounds and levels, not on the number of fits.

Rows are a table (:func:`cells`): label, numbers of the features that a row holds, and arrays over
the runs of folds and weights and over the fits of scores. Nothing is as wide as the features. Every
``KEEP`` rounds the scores are written anew and finished trees go to a table, so the driver holds the
trees of ``KEEP`` rounds only, and a lost executor repeats tasks. At most ``FITS`` ensembles grow
together (their trees of ``KEEP`` rounds are sent to all tasks); more go in batches.

Gains are the second-order ones: squares of summed gradients over summed curvatures plus
``PENALTY``, leaves times the rate. Gains are compared to 9 digits, equal ones go to the feature
first in order of name. A level without gain ends its tree, and an ensemble is over when a tree
has no level, after its iterations, or when its loss on the test fold has not fallen for
``PATIENCE`` rounds; it is cut at its least loss on the test fold, if there is one.

Defined results: rows in no fold of a run are not in it; features that a run may not use, or that no
training row holds, are never split on; a run whose training rows have no weight, or whose labels
leave nothing to learn, has no trees and predicts its start; null labels, rows and features are
left out; rows without features count as holding none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .prefix import numbered

PENALTY, PATIENCE = 3.0, 100
#: Rounds between two writings of the scores, and ensembles that grow side by side.
KEEP, FITS = 10, 256
#: Cells (rows times needed features) that a task looks at at once.
CELLS = 4_000_000
#: Features held by the rows that a task adds up at once.
HELD = 1_000_000

TREES = "fit string, tree int, codes array<int>, leaves array<double>, covers array<double>, gains array<double>"


@dataclass(frozen=True)
class Fit:
    """One ensemble to grow: its name, its run (whose features it may use), its settings, and the
    folds that it goes by, if these are not named like the run."""

    name: str
    run: str
    rate: float
    depth: int
    iterations: int
    folds: str | None = None


@dataclass
class Grown:
    """What is known of an ensemble: start, number of trees, and loss on the test fold by round."""

    fit: Fit
    start: float = 0.0
    trees: int = 0
    best: int = 0
    least: float = math.inf
    over: bool = False
    losses: list[float] = field(default_factory=list)
    recent: list[tuple] = field(default_factory=list)

    def length(self, iterations: int | None = None) -> int:
        """Trees that an ensemble of so many iterations keeps: up to its least loss, if it was measured."""
        n = self.trees if iterations is None else min(self.trees, iterations)
        known = [loss for loss in self.losses[: n + 1] if not math.isnan(loss)]
        return self.losses.index(min(known)) if known else n


def number_features(present: DataFrame) -> DataFrame:
    """(feature, code): the features of ``present`` numbered in order of name."""
    return numbered(present.select("feature").na.drop().distinct(), [F.col("feature")], "code").select("feature", F.col("code").cast("int").alias("code"))


def cells(examples: DataFrame, present: DataFrame, codes: DataFrame, runs: list[str]) -> DataFrame:
    """(row, label, held, fold, weight): ``examples`` (run, row, label, weight, fold) with the codes of
    what ``present`` (row, feature) says they hold; ``fold`` and ``weight`` are arrays over ``runs``,
    fold 1 for train, 2 for test, 0 for neither."""
    spark = examples.sparkSession
    at = spark.createDataFrame([(r, i) for i, r in enumerate(runs)], "run string, i int")
    fold = F.when(F.col("fold") == "train", 1).when(F.col("fold") == "test", 2).otherwise(0)
    own = examples.na.drop(subset=["row", "label"]).join(F.broadcast(at), "run")
    # A row that stands there twice weighs twice.
    own = own.groupBy("row", "label", "i").agg(F.max(fold).alias("fold"), F.sum(F.coalesce(F.col("weight").cast("double"), F.lit(1.0))).alias("weight"))
    own = own.groupBy("row", "label").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("fold", "weight")))).alias("of"))
    each = F.sequence(F.lit(0), F.lit(len(runs) - 1))
    folds = F.transform(each, lambda i: F.coalesce(F.col("of")[i]["fold"], F.lit(0)))
    weights = F.transform(each, lambda i: F.coalesce(F.col("of")[i]["weight"], F.lit(0.0)))
    own = own.select("row", "label", folds.alias("fold"), weights.alias("weight"))
    held = present.join(codes, "feature").groupBy("row").agg(F.collect_set("code").alias("held"))
    return own.join(held, "row", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))


def common_codes(data: DataFrame, runs: list[str]) -> DataFrame:
    """(run, code): the features that some training and some test row of a run hold. Folds become bits,
    63 runs to a number, so each cell is read once for all runs."""
    words = range(0, len(runs), 63)

    def bits(side: int, first: int) -> Column:
        own = [F.when(F.col("fold")[k] == side, F.lit(1 << (k - first))).otherwise(0) for k in range(first, min(first + 63, len(runs)))]
        out = F.lit(0).cast("long")
        for c in own:
            out = out.bitwiseOR(c.cast("long"))
        return out

    rows = data.select("held", *[bits(side, w).alias(f"b{side}_{w}") for side in (1, 2) for w in words])
    seen = rows.select(F.explode("held").alias("code"), *rows.columns[1:]).groupBy("code").agg(*[F.bit_or(c).alias(c) for c in rows.columns[1:]])
    tests = [F.struct(F.lit(r).alias("run"), (F.getbit(F.col(f"b1_{k // 63 * 63}").bitwiseAND(F.col(f"b2_{k // 63 * 63}")), F.lit(k % 63)) == 1).alias("both")) for k, r in enumerate(runs)]
    return seen.select("code", F.explode(F.array(*tests)).alias("r")).filter("r.both").select(F.col("r.run").alias("run"), "code")


# What tasks do with a batch of rows.


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), width)


def _held(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row in the batch, code) of every feature held."""
    sizes = column.value_lengths().to_numpy()
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()


def _holds(rows: np.ndarray, codes: np.ndarray, n: int, wanted: np.ndarray) -> np.ndarray:
    """Which of the ``n`` rows hold each of the codes ``wanted``, in order; one more column of none."""
    out = np.zeros((n, len(wanted) + 1), bool)
    if len(wanted) and len(codes):
        at = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
        hit = wanted[at] == codes
        out[rows[hit], at[hit]] = True
    return out


def leaves_of(holds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leaf of each row in trees whose levels look at the columns ``at`` (trees x levels)."""
    leaf = np.zeros((len(holds), len(at)), np.int32)
    for level in range(at.shape[1]):
        leaf |= holds[:, at[:, level]].astype(np.int32) << level
    return leaf


def _packed(trees: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of trees (codes, leaves) as arrays: owner, codes (-1 beyond the depth), leaves and the
    codes that occur."""
    flat = [(k, *tree) for k, own in enumerate(trees) for tree in own]
    depth = max((len(c) for _, c, _ in flat), default=0)
    codes = np.full((len(flat), depth), -1, np.int64)
    leaves = np.zeros((len(flat), 1 << depth))
    for i, (_, c, values) in enumerate(flat):
        codes[i, : len(c)] = c
        leaves[i, : len(values)] = values
    return np.array([k for k, *_ in flat], np.int64), codes, leaves, np.unique(codes[codes >= 0])


def _add_scores(scores: np.ndarray, rows: np.ndarray, codes: np.ndarray, trees: tuple) -> None:
    """Add what ``trees`` give each row to the columns of ``scores`` that own them."""
    owner, levels, leaves, wanted = trees
    if not len(owner):
        return
    at = np.where(levels >= 0, np.searchsorted(wanted, levels), len(wanted))
    leaf = leaves_of(_holds(rows, codes, len(scores), wanted), at)
    found = leaves[np.arange(len(owner)), leaf]
    for k in np.unique(owner):
        scores[:, k] += found[:, owner == k].sum(1)


def gradients(label: np.ndarray, score: np.ndarray, weight: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray]:
    """Weighted negative gradients and curvatures of the loss; rows x fits."""
    if task == "classification":
        p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        return weight * ((label > 0)[:, None] - p), weight * p * (1 - p)
    return weight * (label[:, None] - score), weight


def losses(label: np.ndarray, score: np.ndarray, task: str) -> np.ndarray:
    if task == "classification":
        return np.logaddexp(0, np.where((label > 0)[:, None], -score, score))
    return (label[:, None] - score) ** 2


def _parts(n: int, wide: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, wide))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


def _slices(held: pa.ListArray, wide: int) -> Iterator[slice]:
    """The parts of :func:`_parts`, cut further so that none holds more than ``HELD`` features (or one row's)."""
    before = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
    for part in _parts(len(held), wide):
        at = part.start
        while at < part.stop:
            end = min(part.stop, max(at + 1, int(np.searchsorted(before, before[at] + HELD, "right")) - 1))
            yield slice(at, end)
            at = end


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur, in order, and where each one stands among them; by a table if it is not
    much longer than ``codes``."""
    if not len(codes) or codes.max() > 8 * len(codes):
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[codes]


class Forest:
    """Ensembles that grow together over one table of cells."""

    def __init__(self, data: DataFrame, fits: list[Fit], runs: list[str], allowed: DataFrame | None, task: str, validate: bool = True):
        self.spark, self.fits, self.task, self.runs = data.sparkSession, fits, task, runs
        self.run_of = np.array([runs.index(f.folds or f.run) for f in fits])
        self.validate = validate
        self.grown = [Grown(f) for f in fits]
        self.allowed = allowed
        self.data = data
        self.trees: DataFrame | None = None
        if task != "classification":
            self._start_at_means()
        starts = F.array(*[F.lit(float(g.start)) for g in self.grown])
        self.data = materialize(data.select("row", "label", "held", "fold", "weight", starts.alias("score")), "cells")

    def _start_at_means(self) -> None:
        each = self.data.select("label", F.posexplode(F.arrays_zip("fold", "weight"))).filter("col.fold = 1")
        means = {r.pos: r.mean for r in each.groupBy("pos").agg((F.sum(F.col("label") * F.col("col.weight")) / F.sum("col.weight")).alias("mean")).collect()}
        for g, run in zip(self.grown, self.run_of.tolist(), strict=True):
            g.start = float(means.get(run) or 0.0)

    def _scored(self, make, schema: str, live: list[int], levels: list[list[int]]) -> DataFrame:
        """``make(rows, codes, label, fold, weight, score, leaf)`` over slices of the cells, for the fits
        ``live``; ``leaf`` is where the rows stand in the trees whose features are ``levels``."""
        n_runs, n_fits, run_of = len(self.runs), len(self.fits), self.run_of
        recent = _packed([g.recent for g in self.grown])
        chosen = _packed([[(c, np.zeros(1))] for c in levels])
        own = np.array(live)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for part in _slices(whole.column("held"), len(recent[3]) + len(recent[0]) + len(chosen[3]) + 2 * n_fits):
                    batch = whole.slice(part.start, part.stop - part.start)
                    rows, codes = _held(batch.column("held"))
                    score = _matrix(batch.column("score"), n_fits).copy()
                    _add_scores(score, rows, codes, recent)
                    fold, weight = (_matrix(batch.column(c), n_runs)[:, run_of[own]] for c in ("fold", "weight"))
                    at = np.where(chosen[1] >= 0, np.searchsorted(chosen[3], chosen[1]), len(chosen[3]))
                    leaf = leaves_of(_holds(rows, codes, batch.num_rows, chosen[3]), at)
                    yield from make(rows, codes, batch.column("label").to_numpy().astype(float), fold, weight, score[:, own], leaf)

        return self.data.select("label", "held", "fold", "weight", "score").mapInArrow(work, schema)

    def totals(self, live: list[int]) -> dict[int, tuple[float, float, float, float]]:
        """For each live fit the sums of gradients and curvatures of its training rows, and the loss
        and number of its test rows: one row a fit."""
        task, own, validate = self.task, np.array(live, np.int32), self.validate

        def total(rows, codes, label, fold, weight, score, leaf):
            g, h = gradients(label, score, weight * (fold == 1), task)
            tested = (fold == 2) & validate
            sums = (g.sum(0), h.sum(0), (losses(label, score, task) * tested).sum(0), tested.sum(0).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, sums)], names=["fit", "g", "h", "loss", "n"])

        found = self._scored(total, "fit int, g double, h double, loss double, n double", live, [[] for _ in live])
        return {r.fit: (r.g, r.h, r.loss, r.n) for r in found.groupBy("fit").agg(*[F.sum(c).alias(c) for c in ("g", "h", "loss", "n")]).collect()}

    def histogram(self, live: list[int], levels: list[list[int]]) -> DataFrame:
        """(fit, code, g0, h0, g1, h1, ...): for each feature the summed gradients and curvatures of the
        rows in each leaf that hold it."""
        task, width = self.task, 1 << max(len(c) for c in levels)
        names = ["fit", "code", *[f"{s}{k}" for k in range(width) for s in "gh"]]

        def add_up(rows, codes, label, fold, weight, score, leaf):
            g, h = gradients(label, score, weight * (fold == 1), task)
            local, at = _distinct(codes)
            for k, fit in enumerate(live):
                place = at * width + leaf[:, k][rows] if width > 1 else at
                sums = [np.bincount(place, v[:, k][rows], len(local) * width).reshape(-1, width) for v in (g, h)]
                some = np.flatnonzero(sums[1].any(1))
                if len(some):
                    values = [pa.array(s[some, j]) for j in range(width) for s in sums]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), fit, np.int32)), pa.array(local[some].astype(np.int32)), *values], names=names)

        parts = self._scored(add_up, ", ".join(f"{n} {'int' if n in ('fit', 'code') else 'double'}" for n in names), live, levels)
        sums = parts.groupBy("fit", "code").agg(*[F.sum(n).alias(n) for n in names[2:]])
        if self.allowed is None:
            return sums
        run = self.spark.createDataFrame(pa.table({"fit": pa.array(live, pa.int32()), "run": pa.array([self.fits[k].run for k in live], pa.string())}))
        return sums.join(F.broadcast(run), "fit").join(self.allowed.select("run", "code"), ["run", "code"], "left_semi").drop("run")

    def gains(self, live: list[int], levels: list[list[int]], known: list[list[tuple[float, float]]]) -> DataFrame:
        """(fit, code, gain, sums): for each live fit and feature the gain of a split of the next level, and
        the sums of the rows in each leaf that hold it; ``known`` are the sums of the leaves there are."""
        width = 1 << max(len(c) for c in levels)
        padded = [(fit, [g for g, _ in own] + [0.0] * (width - len(own)), [h for _, h in own] + [0.0] * (width - len(own))) for fit, own in zip(live, known, strict=True)]
        fit, all_g, all_h = zip(*padded, strict=True)
        lists = pa.list_(pa.float64())
        all_sums = self.spark.createDataFrame(pa.table({"fit": pa.array(fit, pa.int32()), "all_g": pa.array(all_g, lists), "all_h": pa.array(all_h, lists)}))
        found = self.histogram(live, levels).join(F.broadcast(all_sums), "fit")
        gain = split_gain([(F.col(f"g{k}"), F.col(f"h{k}"), F.col("all_g")[k], F.col("all_h")[k]) for k in range(width)])
        return found.select("fit", "code", F.round(gain, 9).alias("gain"), F.array(*[F.array(f"g{k}", f"h{k}") for k in range(width)]).alias("sums"))

    def best_splits(self, live: list[int], levels: list[list[int]], known: list[list[tuple[float, float]]]) -> dict[int, tuple]:
        """For each live fit (gain, code, sums of the leaves that hold it) of the best split, one row a fit."""
        best = self.gains(live, levels, known).groupBy("fit").agg(F.max_by(F.struct("gain", "code", "sums"), F.struct(F.col("gain"), -F.col("code"))).alias("b"))
        return {r.fit: (r.b.gain, r.b.code, [tuple(s) for s in r.b.sums]) for r in best.collect()}

    def grow_round(self) -> bool:
        """The next tree of every ensemble that is not over; False if all are."""
        live = [k for k, g in enumerate(self.grown) if not g.over]
        if not live:
            return False
        at = self.totals(live)
        for k in list(live):
            own = self.grown[k]
            _, h, loss, n = at.get(k, (0.0, 0.0, 0.0, 0.0))
            own.losses.append(loss / n if n else math.nan)
            if n and own.losses[-1] < own.least:
                own.least, own.best = own.losses[-1], own.trees
            if own.trees >= own.fit.iterations or h <= 0 or n and own.trees - own.best >= PATIENCE:
                own.over = True
                live.remove(k)
        levels: dict[int, list[int]] = {k: [] for k in live}
        sums = {k: [at[k][:2]] for k in live}
        gains: dict[int, list[float]] = {k: [] for k in live}
        going = list(live)
        while going := [k for k in going if len(levels[k]) < self.fits[k].depth]:
            found = self.best_splits(going, [levels[k] for k in going], [sums[k] for k in going])
            for k in list(going):
                gain, code, held = found.get(k, (0.0, None, None))
                if code is None or gain <= 0:
                    going.remove(k)
                    continue
                without = [(g - a, h - b) for (g, h), (a, b) in zip(sums[k], held, strict=False)]
                levels[k].append(code)
                gains[k].append(gain)
                sums[k] = without + [held[i] for i in range(len(without))]
        for k in live:
            own = self.grown[k]
            if not levels[k]:
                own.over = True
                continue
            leaves = [own.fit.rate * g / (max(h, 0.0) + PENALTY) for g, h in sums[k]]
            own.recent.append((levels[k], np.array(leaves)))
            self._done.append((own.fit.name, own.trees, levels[k], leaves, [max(h, 0.0) for _, h in sums[k]], gains[k]))
            own.trees += 1
        return any(not g.over for g in self.grown)

    def grow(self) -> DataFrame:
        """Grow all; a table of the trees (``TREES``). Ensembles may hold more trees than
        :meth:`Grown.length` keeps."""
        self._done: list[tuple] = []
        rounds = 0
        while self.grow_round():
            rounds += 1
            if rounds % KEEP == 0:
                self._write()
        self._flush()
        return self.trees

    def _flush(self) -> None:
        part = materialize(self.spark.createDataFrame(self._done, TREES), "trees")
        self.trees = part if self.trees is None else materialize(self.trees.unionByName(part), "trees")
        self._done = []

    def _write(self) -> None:
        """Write scores with the recent trees added, and the trees."""
        n_fits = len(self.fits)
        recent = _packed([g.recent for g in self.grown])
        schema = self.data.schema

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for part in _parts(whole.num_rows, len(recent[3]) + len(recent[0]) + n_fits):
                    batch = whole.slice(part.start, part.stop - part.start)
                    score = _matrix(batch.column("score"), n_fits).copy()
                    _add_scores(score, *_held(batch.column("held")), recent)
                    offsets = pa.array(np.arange(0, score.size + 1, n_fits, dtype=np.int32))
                    yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.ListArray.from_arrays(offsets, pa.array(score.ravel())))

        self.data = materialize(self.data.mapInArrow(add, schema), "cells")
        for g in self.grown:
            g.recent = []
        self._flush()


def split_gain(leaves: list[tuple[Column, Column, Column, Column]]) -> Column:
    """Gain of a split of all leaves: (gradients and curvatures of the rows that hold the feature, those
    of all rows) of each leaf."""
    term = lambda g, h: g * g / (h + PENALTY)
    gain = F.lit(0.0)
    for g, h, all_g, all_h in leaves:
        gain = gain + term(g, h) + term(all_g - g, all_h - h) - term(all_g, all_h)
    return gain


def fit_all(data: DataFrame, fits: list[Fit], runs: list[str], allowed: DataFrame | None = None, task: str = "classification", validate: bool = True) -> tuple[DataFrame, list[Grown]]:
    """(trees, what is known of each ensemble). ``data`` is a table of :func:`cells` over the folds
    ``runs``; ``allowed`` (run, code) names the features that each run may use; the test folds end
    and cut ensembles if ``validate``."""
    trees, grown = None, []
    for at in range(0, len(fits), FITS):
        forest = Forest(data, fits[at : at + FITS], runs, allowed, task, validate)
        part = forest.grow()
        trees = part if trees is None else trees.unionByName(part)
        grown += forest.grown
    return trees, grown


def cut_trees(trees: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """The first so many trees of each ensemble."""
    spark = trees.sparkSession
    kept = spark.createDataFrame(list(lengths.items()), "fit string, n int")
    return trees.join(F.broadcast(kept), "fit").filter("tree < n").drop("n")


def feature_gains(trees: DataFrame) -> DataFrame:
    """(fit, code, importance): shares of the gain of all splits."""
    each = trees.select("fit", F.explode(F.arrays_zip(F.col("codes").alias("code"), F.col("gains").alias("gain"))).alias("s")).groupBy("fit", F.col("s.code").alias("code")).agg(F.sum("s.gain").alias("gain"))
    whole = each.groupBy("fit").agg(F.sum("gain").alias("whole"))
    return each.join(F.broadcast(whole), "fit").select("fit", "code", (F.col("gain") / F.col("whole")).alias("importance"))


def collect_models(trees: DataFrame) -> dict[str, list[tuple]]:
    """Trees of a bounded number of ensembles, for tasks: (codes, leaves, covers) in order."""
    out: dict[str, list[tuple]] = {}
    for r in sorted(trees.collect(), key=lambda r: (r.fit, r.tree)):
        out.setdefault(r.fit, []).append((list(r.codes), np.array(r.leaves), np.array(r.covers)))
    return out


def _wanted(batch: pa.RecordBatch, within: tuple[dict[str, int], int] | None, names: list[str]) -> np.ndarray:
    """Which (row, ensemble) are asked for: all, or those whose fold is the one ``within`` names."""
    if within is None:
        return np.ones((batch.num_rows, len(names)), bool)
    fold = batch.column("fold")
    return _matrix(fold, len(fold.flatten()) // max(1, len(fold)))[:, [within[0][n] for n in names]] == within[1]


def score_rows(rows: DataFrame, models: dict[str, list[tuple]], starts: dict[str, float], task: str = "classification", within: tuple[dict[str, int], int] | None = None) -> DataFrame:
    """(row, fit, raw, confidence, prediction) of ``rows`` (row, held) under every ensemble of
    ``starts``; confidence is null for regression. ``within`` asks for the rows of one fold only: the
    places of the ensembles' folds in the array ``fold``, and 1 (train) or 2 (test)."""
    names = sorted(starts)
    packed = _packed([[(c, v) for c, v, _ in models.get(n, [])] for n in names])
    base = np.array([starts[n] for n in names])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _parts(whole.num_rows, len(packed[3]) + len(packed[0]) + len(names)):
                batch = whole.slice(part.start, part.stop - part.start)
                raw = np.tile(base, (batch.num_rows, 1))
                _add_scores(raw, *_held(batch.column("held")), packed)
                row, fit = np.nonzero(_wanted(batch, within, names))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row)), pa.array(names, pa.string()).take(pa.array(fit)), pa.array(raw[row, fit])], names=["row", "fit", "raw"])

    found = rows.select("row", "held", *(["fold"] if within else [])).mapInArrow(score, "row string, fit string, raw double")
    if task != "classification":
        return found.withColumns({"confidence": F.lit(None).cast("double"), "prediction": F.col("raw")})
    return found.withColumn("confidence", 1 / (1 + F.exp(-F.col("raw")))).withColumn("prediction", (F.col("raw") > 0).cast("double"))


def path_changes(leaves: np.ndarray, covers: np.ndarray, depth: int) -> tuple[float, list[np.ndarray]]:
    """The mean of a tree, and by level the change of the mean at each split for the bits so far."""
    means, cover = [leaves], covers
    for level in range(depth - 1, -1, -1):
        half = 1 << level
        below, low, high = means[0], cover[:half], cover[half : 2 * half]
        total = low + high
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(total > 0, (below[:half] * low + below[half : 2 * half] * high) / total, (below[:half] + below[half : 2 * half]) / 2)
        means.insert(0, mean)
        cover = total
    changes = []
    for level in range(depth):
        bits = np.arange(1 << (level + 1))
        changes.append(means[level + 1] - means[level][bits & ((1 << level) - 1)])
    return float(means[0][0]), changes


def expected(model: list[tuple], start: float) -> float:
    """What an ensemble says of no row in particular: the sum of its trees' means."""
    return start + sum(path_changes(v, w, len(c))[0] for c, v, w in model)


def attributions(rows: DataFrame, models: dict[str, list[tuple]], within: tuple[dict[str, int], int] | None = None) -> DataFrame:
    """(row, fit, code, held, attribution): by feature, the changes of the mean at the splits along a
    row's paths; with :func:`expected` they add up to the raw score. Only features that some tree of
    an ensemble splits on have rows, whatever the number of features; ``within`` as in
    :func:`score_rows`."""
    plans = []
    for name, model in sorted(models.items()):
        wanted = np.unique([c for levels, _, _ in model for c in levels]).astype(np.int64)
        trees = [(np.searchsorted(wanted, cs), path_changes(v, w, len(cs))[1]) for cs, v, w in model]
        plans.append((name, wanted, trees))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for name, wanted, trees in plans:
                if not len(wanted):
                    continue
                for part in _parts(whole.num_rows, 4 * len(wanted)):
                    batch = whole.slice(part.start, part.stop - part.start)
                    batch = batch.filter(pa.array(_wanted(batch, within, [name])[:, 0]))
                    n = batch.num_rows
                    holds = _holds(*_held(batch.column("held")), n, wanted)
                    total = np.zeros((n, len(wanted)))
                    for at, changes in trees:
                        bits = np.zeros(n, np.int64)
                        for level, (column, change) in enumerate(zip(at.tolist(), changes, strict=True)):
                            bits |= holds[:, column].astype(np.int64) << level
                            total[:, column] += change[bits]
                    many = pa.array(np.repeat(np.arange(n), len(wanted)))
                    codes, held = np.tile(wanted, n).astype(np.int32), holds[:, : len(wanted)].ravel()
                    columns = [pa.array([name] * len(many), pa.string()), pa.array(codes), pa.array(held), pa.array(total.ravel())]
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(many), *columns], names=["row", "fit", "code", "held", "attribution"])

    return rows.select("row", "held", *(["fold"] if within else [])).mapInArrow(walk, "row string, fit string, code int, held boolean, attribution double")

