import math
import random

import pytest

from traitforge.operators import evaluate, select, split


def scored(spark, rows):
    return spark.createDataFrame([("g", float(s), y) for s, y in rows], "g string, score double, y int")


def test_auc_pairs_and_ties(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0)]
    assert evaluate.auc(scored(spark, rows), ["g"], "y", "score").first().auc == 0.875
    assert evaluate.auc(scored(spark, [(0.5, 1)]), ["g"], "y", "score").first().auc is None


def test_auc_against_pair_counting_and_mirror(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 9) / 10, r.randint(0, 1)) for _ in range(80)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.auc(scored(spark, rows), ["g"], "y", "score").first().auc == pytest.approx(want)
    assert evaluate.auc(scored(spark, [(-s, y) for s, y in rows]), ["g"], "y", "score").first().auc == pytest.approx(1 - want)


def test_metrics_from_counts(spark):
    counts = spark.createDataFrame([("a", 3, 1, 2, 4), ("zero", 0, 0, 0, 5)], "g string, tp long, fp long, fn long, tn long")
    got = {r.g: r for r in evaluate.classification_metrics(counts, ["g"]).collect()}
    a = got["a"]
    assert (a.accuracy, a.precision, a.recall, a.f1, a.mcc) == pytest.approx((0.7, 0.75, 0.6, 2 / 3, 10 / math.sqrt(4 * 5 * 5 * 6)))
    assert (got["zero"].precision, got["zero"].mcc) == (0, 0)


def test_curves_end_where_they_should(spark):
    rows = scored(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0)])
    roc = {(r.fpr, r.tpr) for r in evaluate.roc_points(rows, ["g"], "y", "score").collect()}
    assert roc == {(0, 0), (0, 0.5), (0.5, 1), (1, 1)}
    pr = {(r.precision, r.recall) for r in evaluate.pr_points(rows, ["g"], "y", "score").collect()}
    assert pr == {(1.0, 0.5), (2 / 3, 1.0), (0.5, 1.0), (1.0, 0.0)}


def test_votes_are_strict(spark):
    rows = spark.createDataFrame([("s", c) for c in (0.2, 0.6, 0.9)] + [("t", 0.4), ("t", 0.6)], "k string, confidence double")
    assert {r.k: (r.confidence, r.prediction) for r in evaluate.ensemble(rows, ["k"]).collect()} == {"s": (0.6, 1), "t": (0.5, 0)}


def test_mann_whitney_against_counting(spark):
    r = random.Random(2)
    rows = [(g, r.randint(0, 8) / 2) for g in ("a", "b", "c") for _ in range(r.randint(5, 20))]
    got = {(x.a, x.b): x for x in evaluate.mann_whitney(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), x in got.items():
        va, vb = ([v for g, v in rows if g == k] for k in (a, b))
        u = sum((p > q) + (p == q) / 2 for p in va for q in vb)
        n = len(va) + len(vb)
        ties = sum(c**3 - c for c in ((va + vb).count(v) for v in set(va + vb)))
        sd = math.sqrt(len(va) * len(vb) / 12 * (n + 1 - ties / (n * (n - 1))))
        p = math.erfc(max(0, abs(u - len(va) * len(vb) / 2) - 0.5) / sd / math.sqrt(2))
        assert x.u == u and x.p_value == pytest.approx(min(1, p), rel=1e-5)


def test_chi2_by_hand(spark):
    present = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x")], "row int, feature string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0)], "row int, label int")
    assert select.chi2(present, labels, "row").first().score == pytest.approx(1 / 3)
    # One-way F by hand: class means 1 and 0.5, grand mean 0.75.
    assert select.anova_f(present, labels, "row").first().score == pytest.approx((2 * 0.0625 * 2) / (0.5 / 2))
    assert [select.elimination_step(a, b) for a, b in ((100, 50), (55, 50), (51, 50))] == [5, 1, 1]


def test_a_feature_that_explains_everything_scores_highest(spark):
    present = spark.createDataFrame([(0, "x"), (1, "x"), (0, "y"), (2, "y"), (0, "z"), (1, "z"), (2, "z"), (3, "z")], "row int, feature string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0)], "row int, label int")
    scores = {r.feature: r.score for r in select.anova_f(present, labels, "row").collect()}
    assert scores == {"x": float("inf"), "y": 0.0, "z": None}
    assert {r.feature: r.score for r in select.regression_f(present, labels.selectExpr("row", "double(label) AS target"), "row").collect()}["x"] == float("inf")


def test_top_and_lowest(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "feature string, score double")
    assert [r.feature for r in select.top_features(s, 2).collect()] == ["b", "c"]
    assert {r.feature for r in select.drop_lowest(s, 2).collect()} == {"b", "c"}


@pytest.mark.parametrize(("method", "want"), [("log10", math.log10(8 / 3) + 1), ("inverse_frequency", 10 / 3), ("balanced", 8 / 3)])
def test_class_weights(spark, method, want):
    rows = spark.createDataFrame([("p", 1)] * 2 + [("p", 0)] * 8 + [("q", 0)] * 3 + [("r", 1)] * 5, "phage string, y int")
    got = {r.phage: r.weight for r in split.class_weights(rows, "phage", "y", method).collect()}
    assert got["p"] == pytest.approx(want) and got["q"] == 1.0
    if method == "log10":
        assert got["r"] == 1.0
    weighed = split.row_weights(rows, split.class_weights(rows, "phage", "y", method), "phage", "y")
    assert {(r.phage, r.y): r.weight for r in weighed.collect()}[("p", 1)] == pytest.approx(want)
    with pytest.raises(ValueError):
        split.class_weights(rows, "phage", "y", "none")


def test_group_split_keeps_groups_whole(spark):
    r = random.Random(3)
    rows = [(f"g{r.randint(0, 11)}", i, r.randint(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "grp string, i int, y int")
    out = split.split_by_group(df, "grp", "y", seed=5)
    folds = {}
    for x in out.collect():
        folds.setdefault(x.grp, set()).add(x.fold)
    assert out.count() == 200 and all(len(f) == 1 for f in folds.values()) and {f for s in folds.values() for f in s} == {"train", "test"}
    assert split.split_groups([("a", 4, False), ("b", 3, False)], 0, share=2.0) is None
    assert {x.fold for x in split.split_rows(df, 1).collect()} == {"train", "test"}
    assert split.group_presence(spark.createDataFrame([("f", "a"), ("f", "b"), ("h", "a"), ("h", None)], "feature string, group string"), 2).first().feature == "f"


def test_methods_are_compared_at_their_best_cutoffs(spark):
    rows = []
    for m, cut, right in (("a", 3, 1.0), ("a", 5, 0.0), ("b", 3, 0.5)):
        for k in range(8):
            y = k % 2
            good = k < right * 8
            for run in ("r0", "r1"):
                rows.append((m, cut, run, f"s{k}", float(y), 0.9 if (y == 1) == good else 0.1))
    best, runs = evaluate.compare_methods(spark.createDataFrame(rows, "model string, cut_off int, run string, strain string, label double, confidence double"), ["strain"])
    assert {(r.model, r.cut_off) for r in best.collect()} == {("a", 3), ("b", 3)}
    assert {(r.model, r.run): r.accuracy for r in runs.collect()} == {("a", "r0"): 1, ("a", "r1"): 1, ("b", "r0"): 0.5, ("b", "r1"): 0.5}


def test_prefix_sums_over_groups_and_ranges(spark):
    from pyspark.sql import functions as F

    from traitforge.operators.prefix import numbered, prefix_sums

    r = random.Random(7)
    rows = [(g, k, r.randint(0, 9)) for g in ("big", "small", None) for k in range(300 if g == "big" else 5)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = {(x.g, x.k): (x.s, x.b) for x in prefix_sums(prefix_sums(df, ["g"], [F.col("k")], {"s": F.col("v")}), ["g"], [F.col("k")], {"b": F.col("v")}, inclusive=False).collect()}
    for g, k, _ in rows:
        before = sum(v for h, j, v in rows if h == g and j < k)
        assert got[(g, k)] == (before + next(v for h, j, v in rows if (h, j) == (g, k)), before)
    down = {x.k: x.n for x in numbered(df.filter("g = 'big'"), [F.col("k").desc()]).collect()}
    assert down == {k: 299 - k for k in range(300)}


def test_exact_medians_with_nulls_and_ties(spark):
    import statistics

    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, 2.0, 2.5, r.random()])) for _ in range(200)] + [("none", None), ("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = evaluate.exact_median(df, ["g"], "v")
    got = {x.g: x.median for x in found.collect()}
    want = {g: (statistics.median(v) if (v := [x for k, x in rows if k == g and x is not None]) else None) for g in {k for k, _ in rows}}
    assert got == want
    assert "percentile" not in found._jdf.queryExecution().toString() and "median(" not in found._jdf.queryExecution().toString()
    assert evaluate.exact_median(df.limit(0), ["g"], "v").count() == 0


def test_distribution_of_u_against_enumeration():
    from itertools import combinations

    for m, n in ((1, 4), (3, 5), (4, 4), (2, 9)):
        ways = [0] * (m * n + 1)
        for ranks in combinations(range(m + n), m):
            ways[sum(ranks) - m * (m - 1) // 2] += 1
        assert evaluate.u_distribution(m, n, m * n).tolist() == ways
        assert evaluate.u_distribution(m, n, 2).tolist() == ways[:3]


def test_small_groups_have_exact_p(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (5, 6, 7, 8, 9)] + [("c", float(v)) for v in (1, 2.5, 9.5)]
    got = {(x.a, x.b): (x.u, x.p_value) for x in evaluate.mann_whitney(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got["a", "b"][0] == 0 and abs(got["a", "b"][1] - 2 / 126) < 1e-12
    # "a" and "c" share a value: the approximation.
    assert 0 < got["a", "c"][1] <= 1 and got["b", "c"][0] == 10 and abs(got["b", "c"][1] - 2 * 17 / 56) < 0.3


def test_targets_that_presence_holds_take_no_join_by_row(spark):
    present = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z")], "row string, feature string")
    targets = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("c", 4.0), ("d", 3.0), ("e", 2.0)], "row string, target double")
    want = {r.feature: r.score for r in select.regression_f(present, targets, "row").collect()}
    held = select.regression_f(present.join(targets, "row").localCheckpoint(), targets, "row")
    assert {r.feature: r.score for r in held.collect()} == want
    assert "SortMergeJoin" not in held._jdf.queryExecution().toString()
