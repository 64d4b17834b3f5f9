"""Sweeps of selection and modelling: all runs and grid settings grown together.

A sweep makes the folds of all its runs in one plan, grows their ensembles side by side (see
``operators.boosting``) and writes a table for each kind of result, partitioned by cut-off and run.
Runs are done in batches whose ensembles may grow together; a batch is what a killed sweep repeats.
"""

from __future__ import annotations

import json
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, evaluate, model, select, split
from ..operators.prefix import prefix_sums
from .storage import RunTable, Stages, materialize

TREES = "tree int, features array<string>, leaves array<double>, covers array<double>"
ENSEMBLES = "start double, iterations int, rate double, depth int, features array<string>"
IMPORTANCES = "feature string, importance double"
ATTRIBUTIONS = "row string, feature string, value double, attribution double"


def run_folds(rows: DataFrame, c, seeds: list[int], groups: DataFrame | None = None) -> DataFrame:
    """(run, the columns of ``rows``, weight, fold) for runs ``run_<seed>``. ``groups`` (strain, group)
    are the clusters that a cluster split keeps whole."""
    runs = {f"run_{s}": s for s in seeds}
    if c.split == "cluster":
        if groups is None:
            raise ValueError("a split by clusters needs the clusters of strains")
        # A strain without features is a cluster of its own; map_groups stops the job for any other.
        lone = rows.select(c.strain).distinct().join(groups, c.strain, "left_anti").select(c.strain, F.col(c.strain).alias("group"))
        grouped = split.map_groups(rows, groups.select(c.strain, F.col("group").cast("string")).unionByName(lone), c.strain)
        folded = split.split_by_group_runs(grouped, "group", c.phenotype, runs).drop("group")
    elif c.split == "group" and c.strain in rows.columns:
        folded = split.split_by_group_runs(rows, c.strain, c.phenotype, runs)
    else:
        folded = split.split_rows_runs(rows, runs, positive=F.col(c.phenotype) > 0 if c.task == "classification" else None)
    if not c.use_weights:
        return folded.withColumn("weight", F.lit(1.0))
    # Weights of a run come from its training rows.
    entity = c.phage if c.phage in rows.columns else c.strain
    keyed = folded.withColumn("_of", F.to_json(F.array("run", F.col(entity).cast("string"))))
    weights = split.class_weights(keyed.filter("fold = 'train'"), "_of", c.phenotype, c.weights_method)
    return split.row_weights(keyed, weights, "_of", c.phenotype).drop("_of")


def usable_runs(examples: DataFrame, c, both: bool) -> set[str]:
    """Runs whose training rows (and test rows, if ``both``) are of more than one class."""
    counts = {(r.run, r.fold): (r.n, r.p) for r in examples.groupBy("run", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(c.phenotype) > 0).alias("p")).collect()}

    def usable(run: str, fold: str) -> bool:
        n, p = counts.get((run, fold), (0, 0))
        return n > 0 and (c.task != "classification" or 0 < p < n)

    return {r for r in {run for run, _ in counts} if usable(r, "train") and (not both or usable(r, "test"))}


class Table:
    """The cells of all runs, with the numbers of the features."""

    def __init__(self, examples: DataFrame, present: DataFrame, label: str, runs: list[str]):
        self.runs = runs
        self.codes = materialize(boosting.number_features(present), "codes")
        slim = examples.select("run", "row", F.col(label).alias("label"), "weight", "fold")
        self.data = materialize(boosting.cells(slim, present, self.codes, runs), "cells")

    def coded(self, named: DataFrame) -> DataFrame:
        """(run, code) of (run, feature)."""
        return named.join(self.codes, "feature").select("run", "code")

    def within(self, folds: dict[str, str], side: int) -> tuple[dict[str, int], int]:
        """For scoring: the place of each ensemble's fold in the arrays of the cells."""
        return {name: self.runs.index(run) for name, run in folds.items()}, side


def _keep_best(left: DataFrame, scores: DataFrame, keep: dict[str, int]) -> DataFrame:
    """The so many features (run, code) of each run with the highest ``score``, equal ones by name."""
    spark = left.sparkSession
    ranked = left.join(scores, ["run", "code"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    numbered = prefix_sums(ranked, ["run"], [F.desc("score"), F.col("code")], {"at": F.lit(1)}, inclusive=False)
    wanted = spark.createDataFrame(list(keep.items()), "run string, keep int")
    return numbered.join(F.broadcast(wanted), "run").filter("at < keep").select("run", "code")


def closed_scores(table: Table, c) -> DataFrame:
    """(run, code, score): the closed-form score of every feature in every run's training rows, as
    ``operators.select`` has it for one run. One aggregation counts for all runs, a column each; per
    class and run one number reaches the driver."""
    runs = table.runs
    trained = [F.col("fold")[k] == 1 for k in range(len(runs))]
    each = table.data.select("label", "fold", F.explode("held").alias("code"))
    if c.task != "classification":
        y = F.col("label")
        sums = lambda of: [of(k, t) for k, t in enumerate(trained)]
        counted = each.groupBy("code").agg(*sums(lambda k, t: F.count_if(t).alias(f"s{k}")), *sums(lambda k, t: F.sum(F.when(t, y)).alias(f"y{k}")))
        whole = table.data.agg(*sums(lambda k, t: F.count_if(t).alias(f"n{k}")), *sums(lambda k, t: F.sum(F.when(t, y)).alias(f"y{k}")), *sums(lambda k, t: F.sum(F.when(t, y * y)).alias(f"z{k}"))).first()
        facts = [F.struct(F.lit(r).alias("run"), F.col(f"s{k}").cast("double").alias("sx"), F.coalesce(f"y{k}", F.lit(0.0)).alias("sxy"), F.lit(float(whole[f"n{k}"])).alias("n"), F.lit(float(whole[f"y{k}"] or 0)).alias("sy"), F.lit(float(whole[f"z{k}"] or 0)).alias("syy")) for k, r in enumerate(runs)]
        rows = counted.select("code", F.explode(F.array(*facts)).alias("f")).select("code", "f.*").filter("sx > 0")
        cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
        r2 = F.try_divide(cov * cov, (F.col("n") * F.col("sx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
        return rows.select("run", "code", select._statistic(r2 * (F.col("n") - 2), 1 - r2).alias("score"))
    counts = [F.count_if(t).alias(f"s{k}") for k, t in enumerate(trained)]
    sizes = [(runs[k], float(r.label), float(r[f"s{k}"])) for r in table.data.groupBy("label").agg(*counts).collect() for k in range(len(runs)) if r[f"s{k}"]]
    held = each.groupBy("code", "label").agg(*counts)
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(f"s{k}").cast("double").alias("s")) for k, r in enumerate(runs)])).alias("x")
    spark = table.data.sparkSession
    by_class = spark.createDataFrame(sizes, "run string, label double, n double")
    by_run = by_class.groupBy("run").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"))
    rows = held.select("code", "label", one).select("code", "label", "x.run", "x.s").filter("s > 0").join(F.broadcast(by_class), ["run", "label"])
    sums = rows.groupBy("run", "code").agg(F.sum("s").alias("total"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between")).join(F.broadcast(by_run), "run")
    total, between, n = F.col("total"), F.col("between"), F.col("rows")
    if c.method == "chi_squared":
        # Observed sums against the classes' shares of the feature's sum, the squares multiplied out.
        return sums.select("run", "code", (n / total * between - total).alias("score"))
    ssb, ssw = between - total * total / n, total - between
    return sums.select("run", "code", select._statistic(F.try_divide(ssb, F.col("k") - 1), F.try_divide(ssw, n - F.col("k"))).alias("score"))


def select_by_scores(table: Table, allowed: DataFrame, wanted: int, c) -> DataFrame:
    """(run, code): the ``wanted`` features of each run with the highest closed-form scores."""
    left = materialize(allowed, "left")
    scores = closed_scores(table, c).withColumn("score", F.coalesce(F.round("score", 9), F.lit(-1.0)))
    return _keep_best(left, scores, dict.fromkeys(table.runs, wanted))


#: Ensembles whose trees are sent to tasks at once.
SENT = 32


def _in_parts(names: list[str], make) -> DataFrame | None:
    out = None
    for at in range(0, len(names), SENT):
        part = make(names[at : at + SENT])
        out = part if out is None else out.unionByName(part)
    return out


def _told(table: Table, trees: DataFrame, fits: list[boosting.Fit], attribution: bool) -> DataFrame:
    """(run, code, score) of fits named like their runs: the share of the gain, or the mean absolute
    attribution over the training rows."""
    if not attribution:
        return boosting.feature_gains(trees).select(F.col("fit").alias("run"), "code", F.col("importance").alias("score"))

    def part(names: list[str]) -> DataFrame:
        models = boosting.collect_models(trees.filter(F.col("fit").isin(names)))
        found = boosting.attributions(table.data, models, table.within({n: n for n in models}, 1))
        # All of a run's features are divided by the same number of rows.
        return found.groupBy(F.col("fit").alias("run"), "code").agg(F.sum(F.abs("attribution")).alias("score"))

    return _in_parts([f.name for f in fits], part)


def select_by_trees(table: Table, runs: list[str], allowed: DataFrame, wanted: int, c) -> DataFrame:
    """(run, code): what recursive elimination (or one ranking by attributions) leaves of ``allowed``,
    for all runs at once. A round of elimination grows the ensembles of all runs that still have too
    many features."""
    left = materialize(allowed, "left")
    sizes = {r.run: r["count"] for r in left.groupBy("run").count().collect()}
    steps = {run: sizes[run] if c.method == "shap" else select.elimination_step(sizes[run], wanted) for run in sizes}
    while going := [r for r in runs if sizes.get(r, 0) > wanted]:
        fits = [boosting.Fit(r, r, 0.1, 4, c.eliminate_iterations) for r in going]
        trees, _ = boosting.fit_all(table.data, fits, table.runs, left, c.task, validate=False)
        keep = {r: max(wanted, sizes[r] - steps[r]) for r in going}
        kept = _keep_best(left.filter(F.col("run").isin(going)), _told(table, trees, fits, c.method != "rfe"), keep)
        left = materialize(left.filter(~F.col("run").isin(going)).unionByName(kept), "left")
        sizes |= keep
    return left


def fit_grids(table: Table, ensembles: dict[str, str], allowed: DataFrame, c) -> dict:
    """The best of the grid for each of ``ensembles`` (name, which ``allowed`` lists as run, to its
    fold's name), by the metrics on the test rows. What has no setting worth keeping is left out.

    Fewer iterations are a prefix of more, so the grid takes an ensemble for each rate and depth.
    """
    shapes = list(product(c.grid["rate"], c.grid["depth"]))
    fits = [boosting.Fit(f"{name}|{rate}|{depth}", name, rate, depth, max(c.grid["iterations"]), run) for name, run in ensembles.items() for rate, depth in shapes]
    trees, grown = boosting.fit_all(table.data, fits, table.runs, allowed, c.task)
    known = {g.fit.name: g for g in grown}
    lengths = {f"{g.fit.name}|{n}": (g.fit.name, n) for g in grown for n in {g.length(i) for i in c.grid["iterations"]}}

    def score(names: list[str]) -> DataFrame:
        whole = boosting.collect_models(trees.filter(F.col("fit").isin(sorted({lengths[n][0] for n in names}))))
        models = {n: whole.get(lengths[n][0], [])[: lengths[n][1]] for n in names}
        folds = {n: known[lengths[n][0]].fit.folds for n in names}
        return boosting.score_rows(table.data, models, {n: known[lengths[n][0]].start for n in names}, c.task, table.within(folds, 2))

    scored = materialize(_in_parts(sorted(lengths), score).join(table.data.select("row", "label"), "row"), "grid-scores")
    if c.task == "classification":
        measured = evaluate.classification_metrics(evaluate.confusion(scored, ["fit"], "label", "prediction"), ["fit"])
    else:
        measured = evaluate.regression_metrics(scored, ["fit"], "label", "prediction")
    metrics = {r.fit: r.asDict() for r in measured.collect()}
    key, least = ("mcc", 0.0) if c.task == "classification" else ("r2", None)
    best: dict[str, tuple] = {}
    for name in ensembles:
        top = None
        for iterations, (rate, depth) in product(c.grid["iterations"], shapes):
            g = known[f"{name}|{rate}|{depth}"]
            full = f"{g.fit.name}|{g.length(iterations)}"
            value = metrics.get(full, {}).get(key)
            if value is not None and (least is None or value >= least) and model.better(value, top, "last"):
                top, best[name] = value, (full, g, iterations)
    return {"best": best, "trees": trees, "scored": scored}


def best_trees(found: dict) -> DataFrame | None:
    """The trees (fit: the ensemble's name) of the best settings."""
    chosen = {g.fit.name: (name, g.length(iterations)) for name, (_, g, iterations) in found["best"].items()}
    if not chosen:
        return None
    cut = boosting.cut_trees(found["trees"], {fit: n for fit, (_, n) in chosen.items()})
    named = found["trees"].sparkSession.createDataFrame([(fit, name) for fit, (name, _) in chosen.items()], "fit string, name string")
    return cut.join(F.broadcast(named), "fit").drop("fit").withColumnRenamed("name", "fit")


def with_names(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """``rows`` with ``feature`` in place of ``code``."""
    return rows.join(codes, "code").drop("code")


def _batches(keys: list, c) -> list[list]:
    """Runs whose grids grow together."""
    size = max(1, boosting.FITS // (len(c.grid["rate"]) * len(c.grid["depth"])))
    return [keys[at : at + size] for at in range(0, len(keys), size)]


class Sweep:
    """A run table whose finished runs are known and whose work is logged in ``stages``."""

    def __init__(self, stages: Stages, name: str, keys: tuple[str, ...], settings: dict):
        self.stages, self.table = stages, RunTable(stages.spark, f"{stages.folder}/{name}", keys)
        self.settings = settings
        # What another stage made anew since is older than what it was made from.
        self.done = {} if stages.stale else self.table.done()

    def wanted(self, key: tuple) -> str:
        own = self.settings.get(key, self.settings.get(None, {}))
        return json.dumps(own, sort_keys=True, default=str)

    def open(self, keys: list[tuple], label) -> list[tuple]:
        """The runs among ``keys`` that are not done with these settings."""
        todo = []
        for key in keys:
            if self.done.get(key, ("",))[0] == self.wanted(key):
                self.stages.log.append((label(key), "reused", 0.0))
            else:
                todo.append(key)
        self.stages.stale = self.stages.stale or bool(todo)
        return todo

    def record(self, states: dict[tuple, str], label, seconds: float) -> None:
        self.table.record([(*k, self.wanted(k), status) for k, status in states.items()])
        for k in states:
            self.stages.log.append((label(k), "made", seconds))


def read_models(spark: SparkSession, folder: str, cut_off: int) -> tuple[DataFrame, DataFrame] | None:
    """(trees, ensembles) of a cut-off in a folder of models, or None."""
    table = RunTable(spark, folder, ("cut_off", "run"))
    ensembles = table.read("ensembles", ENSEMBLES).filter(F.col("cut_off") == cut_off)
    if ensembles.isEmpty():
        return None
    return table.read("trees", TREES).filter(F.col("cut_off") == cut_off), ensembles
