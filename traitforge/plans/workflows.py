"""Workflows: chains of operators over named, resumable stages.

A workflow takes DataFrames and a folder. Each stage is a Parquet table in that folder; a second
run with the same settings reads what is there and makes what is missing (see ``Stages``).
"""

from __future__ import annotations

import time
import warnings
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import family_of_label, kmer_of_label
from ..operators import align, annotate, boosting, cluster, coverage, evaluate, hierarchy, merge, model, presence, select, sequence, split
from . import sweeps
from .storage import Stages, exists

METHODS = ("rfe", "shap_rfe", "shap", "select_k_best", "chi_squared", "lasso")


@dataclass
class Config:
    """Settings of all workflows; command-line defaults."""

    strain: str = "strain"
    phage: str = "phage"
    phenotype: str = "interaction"
    task: str = "classification"
    method: str = "rfe"
    k: int = 5
    one_gene: bool = False
    least_identity: float = 0.4
    coverage: float = 0.8
    num_features: int | None = None
    runs_selection: int = 25
    runs_modelling: int = 50
    cutoffs: tuple[int, ...] = tuple(range(3, 51, 2))
    #: ``random`` rows, whole strains (``group``), or whole clusters of strains (``cluster``).
    split: str = "random"
    #: How a cluster split finds them: ``hierarchical`` (Ward) or ``hdbscan``; clusters of the first.
    cluster_method: str = "hierarchical"
    group_clusters: int = 20
    #: Least size of a cluster of the second, and features must occur in so many clusters (0: any).
    least_cluster: int = 5
    least_presence: int = 0
    #: Keep the attributions of modelling runs on their training rows.
    attributions: bool = True
    use_weights: bool = False
    weights_method: str = "inverse_frequency"
    threshold: float = 0.001
    grid: dict = field(default_factory=lambda: dict(model.GRID))
    eliminate_iterations: int = 500
    #: Fit the grid in every selection run too, for its importances.
    score_selection: bool = True
    #: Off: elimination, attribution and L1 models start from all features. A number leaves them so
    #: many of the best by a closed-form score.
    prefilter: int | None = None
    threads: int = 4

    def __post_init__(self):
        if self.task not in ("classification", "regression"):
            raise ValueError(f"unknown task {self.task!r}")
        if self.method not in METHODS:
            raise ValueError(f"unknown selection method {self.method!r}; there are {', '.join(METHODS)}")
        if self.task == "regression" and self.method == "chi_squared":
            raise ValueError("chi_squared needs classes")
        if self.split not in ("random", "group", "cluster"):
            raise ValueError(f"unknown split {self.split!r}")
        if self.cluster_method not in ("hierarchical", "hdbscan"):
            raise ValueError(f"unknown cluster method {self.cluster_method!r}")


def _identity(c: Config) -> dict:
    """The settings that results depend on."""
    return {k: v for k, v in asdict(c).items() if k != "threads"}


def require_rows(table: DataFrame, what: str) -> DataFrame:
    if table.isEmpty():
        raise ValueError(f"no {what}")
    return table


def family_features(stages: Stages, proteins: DataFrame, c: Config, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(presence, feature map, assignments) of one side's protein families."""
    require_rows(proteins, f"{kind} proteins")
    families = stages.run(f"{kind}_families", lambda: align.protein_families(proteins, c.k, c.least_identity, c.coverage), {"k": c.k, "identity": c.least_identity, "coverage": c.coverage})
    present = stages.run(f"{kind}_presence", lambda: presence.presence(proteins.join(families, "protein_id"), "genome", "cluster"))
    return (present, *_collapsed(stages, present, kind))


def kmer_features(stages: Stages, proteins: DataFrame, c: Config, kind: str, families: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from k-mers, of all proteins or within families."""

    def make() -> DataFrame:
        # K-mers of proteins without a family have a null one, and support leaves null keys out.
        rows = proteins if families is None else proteins.join(families.withColumnRenamed("cluster", "family"), "protein_id", "left")
        group = [] if families is None else ["family"]
        occ = sequence.explode_kmers(rows, c.k, ["genome", "protein_id", *group])
        found = sequence.kmer_features(occ, sequence.kmer_support(occ, group, one_gene=c.one_gene), group, "genome")
        return found.withColumnRenamed("feature", "cluster")

    require_rows(proteins, f"{kind} proteins")
    present = stages.run(f"{kind}_kmer_presence", make, {"k": c.k, "one_gene": c.one_gene, "families": families is not None})
    return (present, *_collapsed(stages, present, f"{kind}_kmer", proteins))


def _collapsed(stages: Stages, present: DataFrame, name: str, genomes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Features and assignments; ``genomes`` without any feature get a row with a null one."""
    features = stages.run(f"{name}_features", lambda: presence.collapse(present, "p" if name.startswith("phage") else "s"))

    def assign() -> DataFrame:
        assigned = presence.assign_features(present, features)
        return assigned if genomes is None else presence.add_missing_genomes(assigned, genomes)

    return features, stages.run(f"{name}_assignments", assign)


def phenotype_rows(phenotypes: DataFrame, c: Config) -> DataFrame:
    """Phenotype rows without nulls, keyed ``row`` by the entities in them, as JSON so that no two
    combinations have one key."""
    keys = [k for k in (c.strain, c.phage) if k in phenotypes.columns]
    rows = merge.drop_null_rows(phenotypes.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(c.phenotype).cast("double").alias(c.phenotype)))
    return rows.withColumn("row", F.to_json(F.array(*keys)))


def row_features(rows: DataFrame, strain: DataFrame | None, phage: DataFrame | None, c: Config) -> DataFrame:
    """(row, feature) in long form, of rows that have features on every side given."""
    sides = [(key, s) for key, s in ((c.strain, strain), (c.phage, phage)) if s is not None and key in rows.columns]
    known = rows
    for key, s in sides:
        known = known.join(s.select(F.col("genome").alias(key)).distinct(), key, "left_semi")
    out = None
    for key, s in sides:
        part = known.select("row", key).distinct().join(s.filter("feature IS NOT NULL").withColumnRenamed("genome", key), key).select("row", "feature")
        out = part if out is None else out.unionByName(part)
    return out


def held_table(rows: DataFrame, present: DataFrame, features: DataFrame) -> DataFrame:
    """``rows`` with ``held``, the names among ``features`` (feature) that each of them has."""
    held = present.join(F.broadcast(features), "feature", "left_semi").groupBy("row").agg(F.collect_set("feature").alias(model.HELD))
    return rows.join(held, "row", "left").withColumn(model.HELD, F.coalesce(model.HELD, F.array().cast("array<string>")))


def wide_table(rows: DataFrame, present: DataFrame, features: list[str]) -> DataFrame:
    wanted = present.filter(F.col("feature").isin(features)) if len(features) <= 1000 else present.join(F.broadcast(present.sparkSession.createDataFrame([(f,) for f in features], "feature string")), "feature", "left_semi")
    return presence.wide(wanted, "row", "feature", features, rows).join(rows, "row")


def _one_class(rows: DataFrame, c: Config) -> bool:
    """Whether there is nothing to tell apart: no rows, or classes of one kind only."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(c.phenotype) > 0).alias("p")).first()
    return found.n == 0 or c.task == "classification" and found.p in (0, found.n)


def _settings(c: Config, seed: int) -> model.Settings:
    return model.Settings(task=c.task, label=c.phenotype, weight="weight" if c.use_weights else None, seed=seed, grid=c.grid, threads=c.threads)


TREE_METHODS, CLOSED_METHODS = ("rfe", "shap_rfe", "shap"), ("select_k_best", "chi_squared")


def select_runs(rows: DataFrame, present: DataFrame, c: Config, wanted: int, seeds: list[int], groups: DataFrame | None = None) -> tuple[DataFrame, sweeps.Table | None]:
    """(run, feature) that trees or closed forms select in all runs at once, and the table of cells that
    they read. Runs whose training rows are of one class have none."""
    examples = sweeps.materialize(sweeps.run_folds(rows, c, seeds, groups), "examples")
    runs = sorted(sweeps.usable_runs(examples, c, both=False), key=lambda r: int(r[4:]))
    if not runs:
        return rows.sparkSession.createDataFrame([], "run string, feature string"), None
    table = sweeps.Table(examples.filter(F.col("run").isin(runs)), present, c.phenotype, runs)
    allowed = boosting.common_codes(table.data, runs)
    kept = sweeps.select_by_scores(table, allowed, wanted, c) if c.method in CLOSED_METHODS else sweeps.select_by_trees(table, runs, allowed, wanted, c)
    return sweeps.with_names(kept, table.codes).select("run", "feature"), table


def select_run(rows: DataFrame, present: DataFrame, c: Config, wanted: int, seed: int, groups: DataFrame | None = None) -> list[str]:
    """One run's selected features, from its training rows, of those that both folds have; none if
    the training rows are of one class."""
    if c.method in CLOSED_METHODS or c.method in TREE_METHODS and c.prefilter is None:
        found, _ = select_runs(rows, present, c, wanted, [seed], groups)
        return sorted(r.feature for r in found.collect())
    folded = sweeps.run_folds(rows, c, [seed], groups).drop("run", "weight")
    train, test = folded.filter("fold = 'train'"), folded.filter("fold = 'test'")
    if _one_class(train, c):
        return []
    trained = present.join(train.select("row"), "row", "left_semi")
    both = split.common_features(trained, present.join(test.select("row"), "row", "left_semi"))
    trained = trained.join(both, "feature", "left_semi")
    label = train.select("row", F.col(c.phenotype).alias("label")).distinct()
    if c.prefilter is not None:
        score = select.anova_f if c.task == "classification" else None
        scores = score(trained, label, "row") if score else select.regression_f(trained, label.withColumnRenamed("label", "target"), "row")
        names = sorted(r.feature for r in select.top_features(scores, c.prefilter).collect())
    else:
        names = sorted(r.feature for r in both.collect())  # the columns of a model
    if not names:
        return []
    named = rows.sparkSession.createDataFrame([(f,) for f in names], "feature string")
    if c.method in TREE_METHODS:
        found, _ = select_runs(rows, present.join(named, "feature", "left_semi"), c, wanted, [seed], groups)
        return sorted(r.feature for r in found.collect())
    table = held_table(train.drop("fold"), trained, named)
    table, s = _weighed(table, c).persist(), _settings(c, seed)
    try:
        return model.lasso(table, names, wanted, s)
    finally:
        table.unpersist()


def _weighed(table: DataFrame, c: Config) -> DataFrame:
    if not c.use_weights:
        return table
    group = c.phage if c.phage in table.columns else c.strain
    return split.row_weights(table, split.class_weights(table, group, c.phenotype, c.weights_method), group, c.phenotype)


def strain_groups(stages: Stages, assigned: DataFrame, c: Config) -> DataFrame | None:
    """(strain, group): the clusters of strains by their features (genome, feature) that a cluster
    split keeps whole; None for other splits."""
    if c.split != "cluster":
        return None

    def make() -> DataFrame:
        vectors, names = hierarchy.presence_vectors(assigned, "genome", "feature")
        if c.cluster_method == "hdbscan":
            found = hierarchy.hdbscan_groups(vectors, names, "genome", c.least_cluster)
        else:
            found = hierarchy.ward_groups(vectors, names, "genome", max(1, min(c.group_clusters, names.count() - 1)))
        return found.withColumnRenamed("genome", c.strain)

    return stages.run("strain_groups", make, {"method": c.cluster_method, "clusters": c.group_clusters, "least": c.least_cluster})


def widespread(rows: DataFrame, present: DataFrame, groups: DataFrame | None, c: Config) -> DataFrame:
    """``present`` without the features that occur in fewer than ``least_presence`` clusters of strains."""
    if groups is None or c.least_presence < 1:
        return present
    held = present.join(rows.select("row", F.col(c.strain).alias("genome")), "row").select("genome", F.col("feature").alias("cluster")).distinct()
    kept = cluster.filter_by_groups(held, groups.withColumnRenamed(c.strain, "genome"), c.least_presence)
    return present.join(kept.select(F.col("cluster").alias("feature")).distinct(), "feature", "left_semi")


def _run_label(kind: str):
    return lambda key: f"{kind}/run={key[-1][4:]}" if len(key) == 1 else f"{kind}/cutoff_{key[0]}/{key[1]}"


def selection(stages: Stages, rows: DataFrame, present: DataFrame, c: Config, groups: DataFrame | None = None) -> DataFrame:
    """(cut_off, feature): features by the number of runs that selected them. Each run's grid is
    fitted too, and the importances of its best model kept under ``selection_importances``.

    Closed forms are counted, and trees and grids grown, for all runs together; L1 models take a few jobs
    a run.
    """
    spark = rows.sparkSession
    n = rows.count()
    wanted = c.num_features or merge.selected_features_per_run(n)
    sweep = sweeps.Sweep(stages, "selection", ("run",), {None: {**_identity(c), "wanted": wanted}})
    label = _run_label("selection")
    todo = [int(run[4:]) for (run,) in sweep.open([(f"run_{s}",) for s in range(c.runs_selection)], label)]
    began = time.monotonic()
    if todo and (c.method in CLOSED_METHODS or c.method in TREE_METHODS and c.prefilter is None):
        found, _ = select_runs(rows, present, c, wanted, todo, groups)
        _selected(sweep, found, todo, label, began)
    else:
        for seed in todo:
            names = select_run(rows, present, c, wanted, seed, groups)
            _selected(sweep, spark.createDataFrame([(f"run_{seed}", f) for f in names], "run string, feature string"), [seed], label, began)
    runs = sweep.table.read("features", "feature string")
    if c.score_selection:
        _selection_importances(stages, rows, present, runs, c, wanted, groups)
    occurrence = merge.occurrences(runs)
    return stages.run("cutoff_tables", lambda: merge.cutoff_tables(occurrence, list(c.cutoffs), n), {"cutoffs": c.cutoffs})


def _selected(sweep: sweeps.Sweep, found: DataFrame, seeds: list[int], label, began: float) -> None:
    found = sweeps.materialize(found, "selected")
    sweep.table.write("features", found)
    with_some = {r.run for r in found.select("run").distinct().collect()}
    for seed in seeds:
        if f"run_{seed}" not in with_some:
            sweep.stages.skipped(f"selection/run={seed}", "one class or no common features")
    sweep.record({(f"run_{s}",): "made" if f"run_{s}" in with_some else "skipped" for s in seeds}, label, time.monotonic() - began)


def _selection_importances(stages: Stages, rows: DataFrame, present: DataFrame, runs: DataFrame, c: Config, wanted: int, groups: DataFrame | None) -> None:
    sweep = sweeps.Sweep(stages, "selection_importances", ("run",), {None: {**_identity(c), "wanted": wanted}})
    label = _run_label("selection_importances")
    for batch in sweeps._batches(sweep.open([(f"run_{s}",) for s in range(c.runs_selection)], label), c):
        began = time.monotonic()
        names = [run for (run,) in batch]
        found, table = _grids(rows, present, runs.filter(F.col("run").isin(names)), {r: r for r in names}, c, groups)
        trees = sweeps.best_trees(found) if found else None
        if trees is not None:
            shares = sweeps.with_names(boosting.feature_gains(trees), table.codes)
            sweep.table.write("importances", shares.select(F.col("fit").alias("run"), "feature", "importance"))
        kept = found["best"] if found else {}
        sweep.record({(r,): "made" if r in kept else "skipped" for r in names}, label, time.monotonic() - began)


def _grids(rows: DataFrame, present: DataFrame, features: DataFrame, ensembles: dict[str, str], c: Config, groups: DataFrame | None) -> tuple[dict | None, sweeps.Table | None]:
    """The grids of ``ensembles`` (name to its run) on ``features`` (run: the ensemble's name, feature), of those
    runs that have several classes on both sides; None if none has."""
    seeds = sorted({int(run[4:]) for run in ensembles.values()})
    examples = sweeps.materialize(sweeps.run_folds(rows, c, seeds, groups), "examples")
    usable = sweeps.usable_runs(examples, c, both=True)
    kept = {name: run for name, run in ensembles.items() if run in usable}
    if not kept:
        return None, None
    runs = sorted(usable, key=lambda r: int(r[4:]))
    asked = present.join(features.select("feature").distinct(), "feature", "left_semi")
    table = sweeps.Table(examples.filter(F.col("run").isin(runs)), asked, c.phenotype, runs)
    return sweeps.fit_grids(table, kept, sweeps.materialize(table.coded(features), "allowed"), c), table


def modelling(stages: Stages, rows: DataFrame, present: DataFrame, tables: DataFrame, c: Config, groups: DataFrame | None = None) -> dict[str, DataFrame]:
    """Models, predictions, importances and attributions of every cut-off and run, and their
    evaluation. All cut-offs and runs of a batch grow together; each table is read in one scan."""
    spark = rows.sparkSession
    keys = [k for k in (c.strain, c.phage) if k in rows.columns]
    names: dict[int, list[str]] = {}
    for r in tables.select("cut_off", "feature").distinct().collect():  # a few thousand names
        names.setdefault(r.cut_off, []).append(r.feature)
    if not names:
        raise ValueError("no cut-off left a table of features to model")
    every = [(cut, f"run_{seed}") for cut in sorted(names) for seed in range(c.runs_modelling)]
    settings = {cut: {**_identity(c), "features": sorted(own)} for cut, own in names.items()}
    sweep = sweeps.Sweep(stages, "models", ("cut_off", "run"), {key: settings[key[0]] for key in every})
    label = _run_label("predictions")
    for batch in sweeps._batches(sweep.open(every, label), c):
        began = time.monotonic()
        kept = _model_batch(sweep.table, rows, present, batch, names, keys, c, groups)
        for key in batch:
            if key not in kept:
                stages.skipped(label(key), "one class or no model worth keeping")
        sweep.record({key: "made" if key in kept else "skipped" for key in batch}, label, time.monotonic() - began)
    named = "".join(f", {k} string" for k in keys)
    predicted = sweep.table.read("predictions", f"row string{named}, label double, prediction double, confidence double")
    metrics = stages.run("metrics", lambda: evaluate_predictions(predicted, c), _identity(c))
    out = {"predictions": predicted, "metrics": metrics, "importances": sweep.table.read("importances", sweeps.IMPORTANCES)}
    if c.attributions:
        shares = sweep.table.read("attributions", sweeps.ATTRIBUTIONS)
        out["attributions"] = shares
        out["attribution_medians"] = stages.run("attribution_medians", lambda: median_attributions(shares), _identity(c))
    return out


def median_attributions(shares: DataFrame) -> DataFrame:
    """(cut_off, run, feature, value, median) of all runs' attributions."""
    keyed = shares.withColumn("_run", F.to_json(F.struct("cut_off", "run")))
    rolled = evaluate.median_by_run(keyed, "_run", "feature", "value", "attribution")
    own = F.from_json("_run", "cut_off int, run string")
    return rolled.select(own["cut_off"].alias("cut_off"), own["run"].alias("run"), "feature", "value", "median")


def _model_batch(table: sweeps.RunTable, rows: DataFrame, present: DataFrame, batch: list[tuple], names: dict[int, list[str]], keys: list[str], c: Config, groups: DataFrame | None) -> set[tuple]:
    """Write the results of the runs of ``batch``; gives those that have a model worth keeping."""
    spark = rows.sparkSession
    key_of = {f"{cut}|{run}": (cut, run) for cut, run in batch}
    features = spark.createDataFrame([(name, f) for name, (cut, _) in key_of.items() for f in names[cut]], "run string, feature string")
    found, cells = _grids(rows, present, features, {name: run for name, (_, run) in key_of.items()}, c, groups)
    trees = sweeps.best_trees(found) if found else None
    if trees is None:
        return set()
    best, codes = found["best"], cells.codes
    trees = sweeps.materialize(trees, "best-trees")
    own = F.split("fit", r"\|")
    keyed = lambda df: df.withColumns({"cut_off": own[0].cast("int"), "run": own[1]}).drop("fit")
    chosen = spark.createDataFrame([(full, name) for name, (full, _, _) in best.items()], "fit string, name string")
    scored = found["scored"].join(F.broadcast(chosen), "fit").select("row", F.col("name").alias("fit"), "label", "prediction", "confidence")
    table.write("predictions", keyed(scored.join(rows.select("row", *keys).distinct(), "row").select("row", *keys, "label", "prediction", "confidence", "fit")))
    table.write("importances", keyed(sweeps.with_names(boosting.feature_gains(trees), codes)))
    placed = trees.select("fit", "tree", "leaves", "covers", F.posexplode("codes").alias("level", "code"))
    named = sweeps.with_names(placed, codes).groupBy("fit", "tree", "leaves", "covers").agg(F.sort_array(F.collect_list(F.struct("level", "feature"))).alias("s"))
    table.write("trees", keyed(named.select("fit", "tree", F.col("s.feature").alias("features"), "leaves", "covers")))
    facts = [(name, float(g.start), iterations, g.fit.rate, g.fit.depth, sorted(names[key_of[name][0]])) for name, (_, g, iterations) in best.items()]
    table.write("ensembles", keyed(spark.createDataFrame(facts, f"fit string, {sweeps.ENSEMBLES}")))
    if c.attributions:
        within = {name: key_of[name][1] for name in best}

        def share(part: list[str]) -> DataFrame:
            models = boosting.collect_models(trees.filter(F.col("fit").isin(part)))
            return boosting.attributions(cells.data, models, cells.within({n: within[n] for n in models}, 1))

        shares = sweeps.with_names(sweeps._in_parts(sorted(best), share), codes)
        table.write("attributions", keyed(shares.select("row", "feature", F.col("held").cast("double").alias("value"), "attribution", "fit")))
    return {key_of[name] for name in best}


def evaluate_predictions(predictions: DataFrame, c: Config) -> DataFrame:
    """Metrics of each cut-off, best first: votes over the runs for classes, means otherwise."""
    if c.task == "classification":
        votes = evaluate.ensemble(predictions, ["cut_off", "row", "label"])
        counts = evaluate.classification_metrics(evaluate.confusion(votes, ["cut_off"], "label", "prediction"), ["cut_off"])
        return counts.join(evaluate.auc(votes, ["cut_off"], "label", "confidence"), "cut_off").orderBy(F.col("mcc").desc(), "cut_off")
    means = predictions.groupBy("cut_off", "row", "label").agg(F.avg("prediction").alias("prediction"))
    return evaluate.regression_metrics(means, ["cut_off"], "label", "prediction").orderBy(F.col("r2").desc(), "cut_off")


def best_cutoff(metrics: DataFrame, c: Config) -> int:
    best = evaluate.best_first(metrics, "mcc" if c.task == "classification" else "r2", ["cut_off"]).first()
    if best is None:
        raise ValueError("no run gave a model worth keeping")
    return best.cut_off


def feature_table(spark: SparkSession, folder: str, strains: DataFrame, phenotypes: DataFrame, c: Config, phages: DataFrame | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Protein families to (row, feature) and labelled rows."""
    stages = Stages(spark, folder, force)
    _, s_map, s_features = family_features(stages, strains, c, "strain")
    p_map = p_features = None
    if phages is not None:
        _, p_map, p_features = family_features(stages, phages, c, "phage")
    rows = stages.run("rows", lambda: phenotype_rows(phenotypes, c), _identity(c))
    present = stages.run("row_features", lambda: require_rows(row_features(rows, s_features, p_features, c), "phenotype rows with features"), _identity(c))
    maps = s_map if p_map is None else s_map.unionByName(p_map)
    return {"stages": stages, "rows": rows, "present": present, "maps": maps, "strain": s_features, "phage": p_features}


def protein_family_workflow(spark: SparkSession, folder: str, strains: DataFrame, phenotypes: DataFrame, c: Config, phages: DataFrame | None = None, force: bool = False) -> dict:
    """From proteins and phenotypes to models, metrics, and the proteins behind the best features."""
    made = feature_table(spark, folder, strains, phenotypes, c, phages, force)
    stages, rows = made["stages"], made["rows"]
    groups = strain_groups(stages, made["strain"], c)
    present = widespread(rows, made["present"], groups, c)
    tables = selection(stages, rows, present, c, groups)
    out = modelling(stages, rows, present, tables, c, groups)
    best = best_cutoff(out["metrics"], c)
    families = spark.read.parquet(f"{folder}/strain_families")
    proteins = stages.run("predictive_proteins", lambda: annotate.predictive_proteins(tables.filter(F.col("cut_off") == best), made["maps"], families))
    return {**out, **made, "tables": tables, "best_cutoff": best, "predictive_proteins": proteins, "sequences": annotate.extract_sequences(strains, proteins)}


def kmer_workflow(spark: SparkSession, folder: str, strains: DataFrame, phenotypes: DataFrame, c: Config, phages: DataFrame | None = None, families: DataFrame | None = None, force: bool = False) -> dict:
    """The same from k-mers of all proteins, or of the given families."""
    stages = Stages(spark, folder, force)
    _, s_map, s_features = kmer_features(stages, strains, c, "strain", families)
    p_features = kmer_features(stages, phages, c, "phage")[2] if phages is not None else None
    rows = stages.run("rows", lambda: phenotype_rows(phenotypes, c), _identity(c))
    present = stages.run("row_features", lambda: require_rows(row_features(rows, s_features, p_features, c), "phenotype rows with features"), _identity(c))
    groups = strain_groups(stages, s_features, c)
    present = widespread(rows, present, groups, c)
    tables = selection(stages, rows, present, c, groups)
    out = modelling(stages, rows, present, tables, c, groups)
    return {**out, "stages": stages, "rows": rows, "present": present, "maps": s_map, "tables": tables, "best_cutoff": best_cutoff(out["metrics"], c)}


def full_workflow(spark: SparkSession, folder: str, strains: DataFrame, phenotypes: DataFrame, c: Config, phages: DataFrame | None = None, force: bool = False) -> dict:
    """Families first, then k-mers within the predictive families' proteins."""
    first = protein_family_workflow(spark, f"{folder}/families", strains, phenotypes, c, phages, force)
    kept = first["sequences"]
    families = spark.read.parquet(f"{folder}/families/strain_families")
    return {"families": first, "kmers": kmer_workflow(spark, f"{folder}/kmers", kept, phenotypes, c, phages, families, force)}


def assign_features(proteins: DataFrame, training: DataFrame, families: DataFrame, features: DataFrame, c: Config) -> DataFrame:
    """(genome, feature) of new genomes: each protein takes the family of its best hit. Genomes that
    get no feature have a row with a null one."""
    hits = align.alignment_hits(proteins.select("protein_id", "sequence"), training.select("protein_id", "sequence"), c.k, c.least_identity)
    best = presence.best_of(hits, "query", [-F.col("score"), -F.col("identity"), -F.col("target_coverage"), F.col("target")], ["target"])
    assigned = presence.assign_clusters(best, families, "target", "protein_id", "cluster").filter("cluster IS NOT NULL").select(F.col("query").alias("protein_id"), "cluster")
    return presence.add_missing_genomes(presence.transfer_features(assigned, proteins.select("protein_id", "genome"), features), proteins)


def assign_kmer_features(proteins: DataFrame, features: DataFrame, c: Config) -> DataFrame:
    """(genome, feature) of new genomes from the k-mers of a feature map (cluster, feature). Genomes
    that get no feature have a row with a null one."""
    kmers = features.select("cluster", "feature", kmer_of_label(F.col("cluster")).alias("kmer"))
    # Proteins meet k-mers through their own k-mers, an equality, not by testing every pair.
    own = sequence.explode_kmers(proteins, c.k, ["genome"]).distinct()
    hits = own.join(kmers, "kmer").select("genome", "feature", "cluster", "kmer").distinct()
    totals = kmers.groupBy("feature").agg(F.count(F.lit(1)).alias("total"))
    counts = hits.groupBy("genome", "feature").agg(F.count(F.lit(1)).alias("hits")).join(totals, "feature")
    from ..functions.metrics import at_least

    called = counts.filter(at_least(F.col("hits"), F.col("total"), c.threshold)).select("genome", "feature")
    return presence.add_missing_genomes(called, proteins)


def kmer_coverage_workflow(spark: SparkSession, folder: str, selected: DataFrame, maps: DataFrame, families: DataFrame, proteins: DataFrame, aligned: DataFrame | None = None, k: int = 5, gap_aware: bool = False, quick: bool = False, force: bool = False, make_alignments: bool = False) -> dict:
    """Where the selected k-mer features lie in their families' proteins.

    ``selected`` (feature) and ``maps`` (cluster, feature) name the k-mers, ``families`` (cluster,
    protein_id) and ``proteins`` (protein_id, sequence) the proteins that may hold them, ``aligned``
    (family, protein_id, aligned) their alignments; with ``make_alignments`` they are made here, of families
    named by a member. The work ends early, with a ``status`` that says
    why, where a step leaves nothing, where ``quick`` asks for the matches only, or without
    alignments.
    """
    stages = Stages(spark, folder, force)
    label = F.col("cluster")
    kmers = stages.run("selected_kmers", lambda: maps.join(selected.select("feature").distinct(), "feature", "left_semi").select("feature", family_of_label(label).alias("family"), kmer_of_label(label).alias("kmer")).distinct(), {"k": k})
    if kmers.isEmpty():
        return {"status": "no k-mers", "stages": stages}
    members = stages.run("family_proteins", lambda: families.withColumnRenamed("cluster", "family").join(kmers.select("family").distinct(), "family", "left_semi").join(proteins.select("protein_id", "sequence"), "protein_id"))
    if members.isEmpty():
        return {"status": "no families", "stages": stages, "kmers": kmers}
    # Proteins meet k-mers through their own k-mers, an equality.
    own = sequence.explode_kmers(members, k, ["family", "protein_id"]).distinct()
    matches = stages.run("kmer_matches", lambda: own.join(kmers, ["family", "kmer"]), {"k": k})
    found = {"stages": stages, "kmers": kmers, "members": members, "matches": matches}
    if matches.isEmpty():
        return {"status": "no match", **found}
    if quick:
        return {"status": "quick run", **found}
    if aligned is None and make_alignments:
        aligned = stages.run("alignments", lambda: align.align_families(members))
    if aligned is None or aligned.isEmpty():
        return {"status": "no alignments", **found}
    cut = stages.run("trimmed_alignments", lambda: coverage.trim_leading_gaps(aligned))
    covered = coverage.covered_residues(cut, matches, gap_aware)
    segments = stages.run("segments", lambda: coverage.add_uncovered(coverage.segments(covered), cut), {"gap_aware": gap_aware})
    return {"status": "done", **found, "segments": segments}


def predict(spark: SparkSession, models: str, cut_off: int, strains: DataFrame, phages: DataFrame | None, c: Config, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All runs' predictions for every strain with every phage, and the vote on them.

    ``strains`` and ``phages`` are (genome, feature), ``known`` (feature) are the features that were
    looked for in them; without it those that some genome has. A model that needs others stops the
    work with their names. Models that cannot be read are skipped with a warning.
    """
    grid = merge.prediction_grid(strains.select(F.col("genome").alias(c.strain)).distinct(), phages.select(F.col("genome").alias(c.phage)).distinct() if phages is not None else None)
    keys = [k for k in (c.strain, c.phage) if k in grid.columns]
    rows = grid.withColumn("row", F.to_json(F.array(*keys)))
    present = row_features(rows, strains, phages, c)
    if known is None:
        known = present.select("feature")
    found = sweeps.read_models(spark, models, cut_off)
    out = None if found is None else _predict_runs(rows, present, known, *found, keys, c)
    older = _predict_pipelines(spark, f"{models}/cutoff_{cut_off}", rows, present, known, keys, c)
    if older is not None:
        out = older if out is None else out.unionByName(older)
    if out is None:
        raise ValueError(f"no models under {models} for cut-off {cut_off}")
    if c.task == "classification":
        return out, evaluate.ensemble(out, keys)
    return out, out.groupBy(*keys).agg(F.avg("prediction").alias("prediction"))


def _require_known(spark: SparkSession, known: DataFrame, names: list[str]) -> None:
    asked = spark.createDataFrame([(f,) for f in names], "feature string")
    lacking = sorted(r.feature for r in asked.join(known, "feature", "left_anti").collect())
    if lacking:
        merge.require_features(set(names) - set(lacking), names)


def _predict_runs(rows: DataFrame, present: DataFrame, known: DataFrame, trees: DataFrame, ensembles: DataFrame, keys: list[str], c: Config) -> DataFrame:
    """Predictions of all runs of a table of models, in one plan."""
    spark = rows.sparkSession
    facts = {r.run: r for r in ensembles.collect()}  # one row a run
    _require_known(spark, known, sorted({f for r in facts.values() for f in r.features}))
    used = sorted(r.feature for r in trees.select(F.explode("features").alias("feature")).distinct().collect())
    code = {f: i for i, f in enumerate(used)}
    codes = spark.createDataFrame(list(code.items()), "feature string, code int")
    held = present.join(codes, "feature").groupBy("row").agg(F.collect_set("code").alias("held"))
    cells = rows.select("row").join(held, "row", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))

    def score(runs: list[str]) -> DataFrame:
        named = trees.filter(F.col("run").isin(runs)).select(F.col("run").alias("fit"), "tree", F.col("features").alias("codes"), "leaves", "covers")
        models = {run: [([code[f] for f in fs], v, w) for fs, v, w in own] for run, own in boosting.collect_models(named).items()}
        return boosting.score_rows(cells, models, {r: facts[r].start for r in runs}, c.task)

    scored = sweeps._in_parts(sorted(facts), score)
    return scored.join(rows.select("row", *keys), "row").select("row", *keys, "confidence", "prediction", F.col("fit").alias("run"))


def _predict_pipelines(spark: SparkSession, folder: str, rows: DataFrame, present: DataFrame, known: DataFrame, keys: list[str], c: Config) -> DataFrame | None:
    """Predictions of fitted pipelines that stand in a folder each; broken ones are skipped."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = None
    for status in sorted(fs.listStatus(root), key=lambda s: s.getPath().getName()) if fs.exists(root) else []:
        run = status.getPath().getName()
        try:
            fitted = PipelineModel.load(str(status.getPath()))
        except Exception as e:  # whatever a broken folder makes the reader raise
            warnings.warn(f"model {run} skipped: {e}", stacklevel=3)
            continue
        names = model.names_of(fitted)
        _require_known(spark, known, names)
        table = held_table(rows, present, spark.createDataFrame([(f,) for f in names], "feature string"))
        part = model.score(fitted, table, c.task)
        confidence = F.col("confidence") if c.task == "classification" else F.lit(None).cast("double")
        part = part.select("row", *keys, confidence.alias("confidence"), "prediction", F.lit(run).alias("run"))
        out = part if out is None else out.unionByName(part)
    return out


def known_features(spark: SparkSession, folder: str) -> DataFrame | None:
    """(feature): the features that a folder's assignments were made from, if it says."""
    out = None
    for name in ("known_features", "strain_features", "phage_features", "strain_kmer_features", "phage_kmer_features"):
        if exists(spark, f"{folder}/{name}/_SUCCESS"):
            part = spark.read.parquet(f"{folder}/{name}").select("feature").distinct()
            out = part if out is None else out.unionByName(part)
    return out
