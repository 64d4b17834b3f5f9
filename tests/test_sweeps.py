import random

import pytest
from pyspark.sql import functions as F

from traitforge.operators import boosting, select, split
from traitforge.plans import sweeps
from traitforge.plans import workflows as W
from traitforge.plans.storage import RunTable, Stages

GRID = {"iterations": (2, 4), "rate": (0.3,), "depth": (1, 2)}


def interactions(spark, seed=3, strains=16):
    r = random.Random(seed)
    has = {f"s{i}": i % 2 for i in range(strains)}
    held = {s: [f"sc_{j}" for j in range(1, 5) if r.random() < 0.5] + ["sc_0"] * has[s] for s in has}
    rows = [(f'["{s}","p{k}"]', s, f"p{k}", float(has[s] and r.random() < 0.97)) for s in has for k in range(3)]
    present = [(row, f) for row, s, *_ in rows for f in held[s]]
    assigned = [(s, f) for s, own in held.items() for f in own]
    return spark.createDataFrame(rows, "row string, strain string, phage string, interaction double"), spark.createDataFrame(present, "row string, feature string"), spark.createDataFrame(assigned, "genome string, feature string")


def test_folds_of_all_runs_equal_those_of_each(spark):
    rows, *_ = interactions(spark)
    positive = F.col("interaction") > 0
    found = split.split_rows_runs(rows, {"run_0": 0, "run_4": 4}, positive=positive)
    for seed in (0, 4):
        want = {(r.row, r.fold) for r in split.split_rows(rows, seed, positive=positive).collect()}
        assert {(r.row, r.fold) for r in found.filter(F.col("run") == f"run_{seed}").collect()} == want
    found = split.split_by_group_runs(rows, "strain", "interaction", {"run_0": 0, "run_4": 4})
    for seed in (0, 4):
        want = {(r.row, r.fold) for r in split.split_by_group(rows, "strain", "interaction", seed).collect()}
        assert {(r.row, r.fold) for r in found.filter(F.col("run") == f"run_{seed}").collect()} == want


def test_killed_sweep_resumes_and_is_one_scan(spark, tmp_path, monkeypatch):
    rows, present, _ = interactions(spark)
    tables = spark.createDataFrame([(c, f) for c in (1, 3) for f in ("sc_0", "sc_1", "sc_2")[: 4 - c]], "cut_off int, feature string")
    c = W.Config(runs_modelling=2, grid=GRID)
    monkeypatch.setattr(boosting, "FITS", 4)  # two runs a batch
    whole, calls = W._model_batch, []

    def killed(*args):
        calls.append(args[3])
        if len(calls) == 2:
            raise KeyboardInterrupt
        return whole(*args)

    monkeypatch.setattr(W, "_model_batch", killed)
    with pytest.raises(KeyboardInterrupt):
        W.modelling(Stages(spark, str(tmp_path)), rows, present, tables, c)
    monkeypatch.setattr(W, "_model_batch", whole)
    stages = Stages(spark, str(tmp_path))
    out = W.modelling(stages, rows, present, tables, c)
    assert [a for n, a, _ in stages.log if n.startswith("predictions/")].count("reused") == 2
    assert out["predictions"].select("cut_off", "run").distinct().count() == 4
    plan = out["predictions"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    pruned = out["predictions"].filter("cut_off = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cut_off" in pruned
    shares = out["attributions"]
    assert shares.groupBy("cut_off", "run").count().count() == 4
    # Attributions are of training rows, predictions of test rows.
    assert shares.join(out["predictions"], ["cut_off", "run", "row"]).count() == 0
    medians = out["attribution_medians"].filter("feature = 'sc_0' AND cut_off = 1").groupBy("value").agg(F.avg("median").alias("m")).collect()
    assert {r.value: r.m > 0 for r in medians} == {0.0: False, 1.0: True}
    again = Stages(spark, str(tmp_path))
    W.modelling(again, rows, present, tables, c)
    assert {a for _, a, _ in again.log} == {"reused"}


def test_run_table_reads_only_what_is_done(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), ("cut_off", "run"))
    assert table.read("x", "v int").count() == 0
    write = lambda v, *keys: table.write("x", spark.createDataFrame([(v, *k) for k in keys], "v int, cut_off int, run string"))
    write(1, (1, "a"), (1, "b"))
    table.record([(1, "a", "s", "made"), (1, "b", "s", "made")])
    write(2, (1, "b"), (2, "c"))  # c is not recorded: the work was killed
    assert {(r.v, r.cut_off, r.run) for r in table.read("x", "v int").collect()} == {(1, 1, "a"), (2, 1, "b")}
    table.record([(1, "a", "t", "skipped")])
    assert {r.run for r in table.read("x", "v int").collect()} == {"b"} and table.done()[1, "a"] == ("t", "skipped")


@pytest.mark.parametrize("method", ["hierarchical", "hdbscan"])
def test_cluster_split_end_to_end(spark, tmp_path, method):
    """Clusters of strains stay whole, and features of one cluster only are left out on demand."""
    rows, present, assigned = interactions(spark, strains=24)
    present = present.unionByName(spark.createDataFrame([('["s0","p0"]', "lone")], "row string, feature string"))
    c = W.Config(split="cluster", cluster_method=method, group_clusters=8, least_cluster=2, least_presence=2, runs_selection=2, runs_modelling=2, eliminate_iterations=3, num_features=2, grid=GRID, cutoffs=(1,), use_weights=True)
    stages = Stages(spark, str(tmp_path))
    groups = W.strain_groups(stages, assigned, c)
    kept = W.widespread(rows, present, groups, c)
    assert "lone" not in {r.feature for r in kept.select("feature").distinct().collect()}
    folds = sweeps.run_folds(rows, c, [0, 1], groups).join(groups, "strain")
    assert folds.groupBy("run", "group").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert folds.select("run", "fold").distinct().count() == 4
    tables = W.selection(stages, rows, kept, c, groups)
    assert spark.read.parquet(str(tmp_path / "selection" / "features")).filter("feature = 'sc_0'").count() == 2
    chosen = spark.createDataFrame([(1, "sc_0"), (1, "sc_1")], "cut_off int, feature string")
    assert tables.columns == ["cut_off", "feature"]
    assert W.modelling(stages, rows, kept, chosen, c, groups)["metrics"].first().accuracy > 0.8


def test_elimination_of_all_runs(spark):
    rows, present, _ = interactions(spark)
    for method in ("rfe", "shap_rfe", "shap"):
        c = W.Config(method=method, eliminate_iterations=3, split="group")
        found, _ = W.select_runs(rows, present, c, 2, [0, 1, 2])
        chosen = {}
        for r in found.collect():
            chosen.setdefault(r.run, set()).add(r.feature)
        assert all(len(v) == 2 and "sc_0" in v for v in chosen.values()) and len(chosen) == 3, (method, chosen)


def test_closed_scores_of_all_runs_equal_those_of_each(spark):
    rows, present, _ = interactions(spark)
    for task, method in (("classification", "select_k_best"), ("classification", "chi_squared"), ("regression", "select_k_best")):
        c = W.Config(task=task, method=method)
        examples = sweeps.run_folds(rows, c, [0, 1]).cache()
        table = sweeps.Table(examples, present, "interaction", ["run_0", "run_1"])
        got = {(r.run, r.feature): r.score for r in sweeps.with_names(sweeps.closed_scores(table, c), table.codes).collect()}
        want = {}
        for run in ("run_0", "run_1"):
            train = examples.filter((F.col("run") == run) & (F.col("fold") == "train"))
            held = present.join(train.select("row"), "row", "left_semi")
            labels = train.select("row", F.col("interaction").alias("label" if task == "classification" else "target"))
            found = select.regression_f(held, labels, "row") if task == "regression" else (select.chi2 if method == "chi_squared" else select.anova_f)(held, labels, "row")
            want |= {(run, r.feature): r.score for r in found.collect()}
        assert got == {k: pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in want.items()}
        chosen, _ = W.select_runs(rows, present, c, 2, [0, 1])
        assert {r["count"] for r in chosen.groupBy("run").count().collect()} == {2}
        assert chosen.filter("feature = 'sc_0'").count() == 2
