import random

import pytest

from traitforge import cli
from traitforge.operators import model, select, split
from traitforge.plans import workflows as W

GRID = {"iterations": (5,), "rate": (0.3,), "depth": (2,)}


def table(spark, n=80, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = (r.randint(0, 1) for _ in range(3))
        rows.append((f"s{i}", a, b, c, float(a if r.random() < 0.95 else 1 - a)))
    return spark.createDataFrame(rows, "strain string, fa int, fb int, fc int, interaction double")


def test_fit_importance_and_attribution(spark):
    df = table(spark)
    s = model.Settings(grid=GRID)
    best, found, predictions = model.grid_search(df, df, ["fa", "fb", "fc"], s)
    assert found[0]["mcc"] > 0.7 and predictions.count() == 80
    assert model.importances(best, ["fa", "fb", "fc"])[0][0] == "fa"
    assert model.eliminate(df, ["fa", "fb", "fc"], 1, s, iterations=5) == ["fa"]
    assert model.eliminate(df, ["fa", "fb", "fc"], 1, s, iterations=5, row_id="strain") == ["fa"]
    assert model.lasso(df, ["fa", "fb", "fc"], 1, s) == ["fa"]
    parts = model.attributions(best, df, ["fa", "fb", "fc"], "strain")
    total = {r.strain: r.s for r in parts.groupBy("strain").agg({"attribution": "sum"}).withColumnRenamed("sum(attribution)", "s").collect()}
    raw = {r.strain: float(r.rawPrediction[1]) for r in best.transform(df).collect()}
    roots = {round(raw[k] / 2 - total.get(k, 0.0), 6) for k in raw} | {round(raw[k] - total.get(k, 0.0), 6) for k in raw}
    assert min(len({round(raw[k] * f - total.get(k, 0.0), 6) for k in raw}) for f in (0.5, 1.0)) == 1, roots


def test_tie_rules():
    assert model.better(0.5, 0.5, "last") and not model.better(0.5, 0.5, "first") and model.better(0.0, None, "first")


def genomes(r, n=14):
    word = lambda k: "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(k))
    pool = [word(30) for _ in range(8)]
    strains, marks = [], {}
    for i in range(n):
        held = [j for j in range(8) if r.random() < 0.6] or [0]
        marks[f"s{i}"] = 1.0 if 2 in held else 0.0
        strains += [(f"s{i}", f"s{i}_{j}", pool[j]) for j in held]
    return strains, marks


def test_family_workflow_end_to_end_and_resumes(spark, tmp_path):
    strains, marks = genomes(random.Random(6))
    proteins = spark.createDataFrame(strains, "genome string, protein_id string, sequence string")
    rows = [(s, f"p{k}", y) for s, y in marks.items() for k in range(3)]
    phenotypes = spark.createDataFrame(rows, "strain string, phage string, interaction double")
    c = W.Config(method="select_k_best", num_features=7, runs_selection=2, runs_modelling=2, cutoffs=(1,), grid=GRID, k=4)
    import traitforge.operators.merge as merge

    keep = merge.cutoff_tables
    merge.cutoff_tables = lambda occ, cutoffs, n: keep(occ, cutoffs, n, least=0, most=100)
    try:
        out = W.protein_family_workflow(spark, str(tmp_path / "w"), proteins, phenotypes, c)
        again = W.protein_family_workflow(spark, str(tmp_path / "w"), proteins, phenotypes, c)
    finally:
        merge.cutoff_tables = keep
    assert {a for _, a, _ in again["stages"].log} == {"reused"}
    assert out["metrics"].count() == 1 and out["predictive_proteins"].count() > 0
    assigned = W.assign_features(proteins, proteins, spark.read.parquet(str(tmp_path / "w" / "strain_families")), out["maps"], c)
    assert {tuple(r) for r in assigned.select("genome", "feature").collect()} == {tuple(r) for r in out["strain"].select("genome", "feature").collect()}
    every, votes = W.predict(spark, str(tmp_path / "w" / "models"), out["best_cutoff"], assigned, None, c)
    assert votes.count() == len(marks) and every.count() % len(marks) == 0


def test_every_selection_method_finds_the_feature_that_matters(spark):
    r = random.Random(9)
    rows = [(f"s{i}|p", f"s{i}", "p", float(i % 2)) for i in range(60)]
    present = [(k, "sc_1") for k, *_, y in rows if y and r.random() < 0.97] + [(k, f"sc_{j}") for k, *_ in rows for j in (2, 3) if r.random() < 0.5]
    df = spark.createDataFrame(rows, "row string, strain string, phage string, interaction double")
    feats = spark.createDataFrame(present, "row string, feature string")
    for method in W.METHODS:
        c = W.Config(method=method, eliminate_iterations=3, use_weights=method == "rfe", split="group" if method == "lasso" else "random")
        assert W.select_run(df, feats, c, 1, 0) == ["sc_1"], method
    assert W.select_run(df, feats, W.Config(task="regression", method="select_k_best"), 1, 0) == ["sc_1"]


def test_kmer_assignment_finds_its_own_genomes(spark, tmp_path):
    strains, _ = genomes(random.Random(2), 5)
    proteins = spark.createDataFrame(strains, "genome string, protein_id string, sequence string")
    c = W.Config(k=5, threshold=1.0)
    _, features, assigned = W.kmer_features(W.Stages(spark, str(tmp_path / "k")), proteins, c, "strain")
    got = W.assign_kmer_features(proteins, features, c)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in assigned.select("genome", "feature").collect()}


def test_settings_are_checked():
    for bad in ({"task": "x"}, {"method": "x"}, {"split": "x"}, {"task": "regression", "method": "chi_squared"}):
        with pytest.raises(ValueError):
            W.Config(**bad)


def test_command_line_knows_all_commands():
    assert len(cli.INPUTS) == 13
    args = cli.parser().parse_args(["kmer-workflow", "--input_strain", "a", "--phenotype_matrix", "b", "--output", "c", "--k", "4", "--cutoffs", "1,2"])
    c = cli.config(args)
    assert (c.k, c.cutoffs, c.method) == (4, (1, 2), "rfe")
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["kmer-workflow", "--output", "c"])


def test_prediction_with_phages_names_missing_features(spark, tmp_path):
    """Strain and phage features end to end through the command line."""
    r = random.Random(3)
    strains = [f"s{i}" for i in range(12)]
    has_s, has_p = {s: i % 2 for i, s in enumerate(strains)}, {f"p{j}": j % 2 for j in range(6)}
    rows = [(f'["{s}","{p}"]', s, p, float(has_s[s] and has_p[p])) for s in strains for p in has_p]
    s_assigned = [(s, f) for s in strains for f, v in (("sc_0", has_s[s]), ("sc_1", r.random() < 0.5)) if v] + [(s, None) for s in strains]
    p_assigned = [(p, f) for p in has_p for f, v in (("pc_0", has_p[p]), ("pc_1", r.random() < 0.5)) if v] + [(p, None) for p in has_p]
    df = spark.createDataFrame(rows, "row string, strain string, phage string, interaction double")
    s_side, p_side = (spark.createDataFrame(t, "genome string, feature string").distinct() for t in (s_assigned, p_assigned))
    c = W.Config(runs_modelling=1, grid=GRID)
    present = W.row_features(df, s_side, p_side, c)
    tables = spark.createDataFrame([(1, "sc_0"), (1, "pc_0")], "cut_off int, feature string")
    stages = W.Stages(spark, str(tmp_path / "m"))
    out = W.modelling(stages, df, present, tables, c)
    assert out["importances"].count() == 2
    other = W.Stages(spark, str(tmp_path / "m"))
    W.modelling(other, df, present, tables, W.Config(runs_modelling=1, grid={**GRID, "depth": (3,)}))
    assert ("predictions/cutoff_1/run_0", "made") in {row[:2] for row in other.log}
    s_side.write.parquet(str(tmp_path / "in" / "strain_assignments"))
    p_side.write.parquet(str(tmp_path / "phages"))
    args = ["predict", "--input_dir", str(tmp_path / "in"), "--model_dir", str(tmp_path / "m" / "models"), "--cut_off", "1", "--output", str(tmp_path / "out")]
    cli.run(spark, cli.parser().parse_args([*args, "--phage_assignments", str(tmp_path / "phages")]))
    votes = {(v.strain, v.phage): v.prediction for v in spark.read.parquet(str(tmp_path / "out" / "all_predictions")).collect()}
    assert len(votes) == 72 and sum(votes[s, p] == (has_s[s] and has_p[p]) for s, p in votes) >= 65
    with pytest.raises(ValueError, match="pc_0"):
        cli.run(spark, cli.parser().parse_args(args))
    with pytest.raises(ValueError, match="phage_feature_map"):
        cli.run(spark, cli.parser().parse_args([*args, "--input_phage", "x"]))


def test_broken_models_are_skipped(spark, tmp_path):
    (tmp_path / "models" / "cutoff_1" / "run_0").mkdir(parents=True)
    strains = spark.createDataFrame([("a", "sc_0")], "genome string, feature string")
    with pytest.warns(UserWarning, match="run_0 skipped"), pytest.raises(ValueError, match="no models"):
        W.predict(spark, str(tmp_path / "models"), 1, strains, None, W.Config())


def test_one_class_is_skipped_and_recorded(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", f"s{i}", 1.0) for i in range(20)], "row string, strain string, interaction double")
    present = spark.createDataFrame([(f"r{i}", f"sc_{j}") for i in range(20) for j in range(2)], "row string, feature string")
    assert W.select_run(rows, present, W.Config(), 1, 0) == []
    stages = W.Stages(spark, str(tmp_path / "w"))
    out = W.modelling(stages, rows, present, spark.createDataFrame([(1, "sc_0")], "cut_off int, feature string"), W.Config(runs_modelling=1, grid=GRID))
    assert out["predictions"].count() == 0 and any(a.startswith("skipped") for _, a, _ in stages.log)
    stages.write_report({"rows": 20})
    assert spark.read.option("header", True).csv(str(tmp_path / "w" / "reports")).count() == len(stages.log)
    with pytest.raises(ValueError, match="no strain proteins"):
        W.family_features(stages, spark.createDataFrame([], "genome string, protein_id string, sequence string"), W.Config(), "strain")


def test_splits_leave_positives_on_both_sides(spark):
    rows = spark.createDataFrame([(i, float(i < 3)) for i in range(40)], "i int, y double")
    for seed in range(4):
        folds = {r.fold: r.n for r in split.split_rows(rows, seed, positive=W.F.col("y") > 0).filter("y > 0").groupBy("fold").agg(W.F.count("*").alias("n")).collect()}
        assert set(folds) == {"train", "test"}
    groups = spark.createDataFrame([(i, "g") for i in range(39)], "i int, group string")
    with pytest.raises(Exception, match="no group for i 39"):
        split.map_groups(rows, groups, "i").collect()


def test_elimination_steps_do_not_shrink():
    assert [select.elimination_step(f, 50) for f in (200, 60, 51)] == [15, 1, 1]


def test_kmer_coverage_workflow_and_its_early_ends(spark, tmp_path):
    proteins = spark.createDataFrame([("a1", "MKLVV"), ("a2", "MKLAA")], "protein_id string, sequence string")
    families = spark.createDataFrame([("f", "a1"), ("f", "a2")], "cluster string, protein_id string")
    maps = spark.createDataFrame([("f_MKL", "sc_0"), ("f_LVV", "sc_1"), ("g_AAA", "sc_2"), ("f_WWW", "sc_3")], "cluster string, feature string")
    aligned = spark.createDataFrame([("f", "a1", "--MK-LVV"), ("f", "a2", "--MK-LAA")], "family string, protein_id string, aligned string")

    def run(name, features, aligned=aligned, **more):
        selected = spark.createDataFrame([(f,) for f in features], "feature string")
        return W.kmer_coverage_workflow(spark, str(tmp_path / name), selected, maps, families, proteins, aligned, k=3, **more)

    assert run("a", ["none"])["status"] == "no k-mers" and run("b", ["sc_2"])["status"] == "no families" and run("c", ["sc_3"])["status"] == "no match"
    assert run("d", ["sc_0"], None)["status"] == "no alignments" and run("e", ["sc_0"], quick=True)["matches"].count() == 2
    done = run("f", ["sc_1"], gap_aware=True)
    got = {(s.feature, s.protein_id, s.coverage, s.start, s.stop) for s in done["segments"].collect()}
    assert done["status"] == "done" and got == {("sc_1", "a1", 0, 0, 2), ("sc_1", "a1", 1, 3, 6), (None, "a2", 0, 0, 5)}
