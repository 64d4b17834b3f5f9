import math
import random

import numpy as np
import pytest

from traitforge.operators import boosting as B


def plain(x, y, w, fold, names, rate, depth, iterations, task):
    """One ensemble on a dense table, by the rules that the module states."""
    n = len(y)
    train, test = fold == 1, fold == 2
    start = 0.0 if task == "classification" else float((y * w)[train].sum() / w[train].sum())
    score, trees, losses = np.full(n, start), [], []
    while True:
        p = 1 / (1 + np.exp(-score))
        g, h = (w * ((y > 0) - p), w * p * (1 - p)) if task == "classification" else (w * (y - score), w)
        loss = np.logaddexp(0, np.where(y > 0, -score, score)) if task == "classification" else (y - score) ** 2
        losses.append(loss[test].mean() if test.any() else math.nan)
        if len(trees) == iterations:
            break
        leaf, codes = np.zeros(n, int), []
        for level in range(depth):
            best = None
            for f in names:
                gain, used = 0.0, False
                for k in range(1 << level):
                    at = train & (leaf == k)
                    a = at & x[:, f]
                    used |= h[a].sum() > 0
                    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + B.PENALTY)
                    gain += part(a) + part(at & ~x[:, f]) - part(at)
                if used and (best is None or round(gain, 9) > best[0]):
                    best = (round(gain, 9), f)
            if best is None or best[0] <= 0:
                break
            codes.append(best[1])
            leaf |= x[:, best[1]].astype(int) << level
        if not codes:
            break
        values = [rate * g[train & (leaf == k)].sum() / (h[train & (leaf == k)].sum() + B.PENALTY) for k in range(1 << len(codes))]
        trees.append((codes, values))
        score = score + np.array(values)[leaf]
    known = [v for v in losses if not math.isnan(v)]
    return trees, (losses.index(min(known)) if known else len(trees)), start


def tables(spark, seed, n=60, width=7, runs=2, task="classification"):
    r = np.random.RandomState(seed)
    x = r.rand(n, width) < 0.4
    y = ((x[:, 1] & ~x[:, 3]) ^ (r.rand(n) < 0.1)).astype(float) if task == "classification" else x[:, 1] * 2.0 - x[:, 3] + r.rand(n)
    w = r.choice([1.0, 2.5], n)
    folds = r.choice([0, 1, 1, 1, 2], (n, runs))
    names = ["", "train", "test"]
    examples = [(f"r{k}", f"x{i}", float(y[i]), float(w[i]), names[folds[i, k]]) for i in range(n) for k in range(runs) if folds[i, k]]
    present = [(f"x{i}", f"f{j}") for i in range(n) for j in range(width) if x[i, j]]
    return x, y, w, folds, spark.createDataFrame(examples, "run string, row string, label double, weight double, fold string").repartition(3), spark.createDataFrame(present, "row string, feature string")


@pytest.mark.parametrize(("seed", "task"), [(1, "classification"), (2, "classification"), (3, "regression")])
def test_all_fits_equal_plain_boosting(spark, monkeypatch, seed, task):
    monkeypatch.setattr(B, "KEEP", 2)
    monkeypatch.setattr(B, "FITS", 3 if seed == 1 else 256)
    monkeypatch.setattr(B, "CELLS", 300)
    x, y, w, folds, examples, present = tables(spark, seed, task=task)
    codes = B.number_features(present)
    runs = ["r0", "r1"]
    data = B.cells(examples, present, codes, runs)
    allowed = {"r0": [0, 2, 3, 4, 5, 6], "r1": list(range(7))}
    allowed_rows = spark.createDataFrame([(k, c) for k, own in allowed.items() for c in own], "run string, code int")
    fits = [B.Fit(f"{run}-{rate}-{depth}", run, rate, depth, 4) for run in runs for rate, depth in ((0.3, 2), (0.1, 3))]
    trees, grown = B.fit_all(data, fits, runs, allowed_rows, task)
    models = B.collect_models(trees)
    rows = data.select("row", "held")
    starts = {g.fit.name: g.start for g in grown}
    kept = {name: models.get(name, [])[: g.length()] for name, g in ((g.fit.name, g) for g in grown)}
    raw = {(r.row, r.fit): r.raw for r in B.score_rows(rows, kept, starts, task).collect()}
    shares = {}
    for r in B.attributions(rows, kept).collect():
        shares[r.row, r.fit] = shares.get((r.row, r.fit), 0.0) + r.attribution
    for g in grown:
        k = runs.index(g.fit.run)
        want, length, start = plain(x, y, w, folds[:, k], allowed[g.fit.run], g.fit.rate, g.fit.depth, 4, task)
        got = models.get(g.fit.name, [])
        assert [c for c, *_ in got] == [c for c, _ in want]
        for (_, v, _), (_, u) in zip(got, want, strict=True):
            np.testing.assert_allclose(v, u, atol=1e-9)
        assert g.length() == length and g.start == pytest.approx(start)
        base = B.expected(kept[g.fit.name], g.start)
        for i in range(len(y)):
            if not folds[i].any():
                continue
            score = start + sum(v[sum(int(x[i, c]) << level for level, c in enumerate(cs))] for cs, v in want[:length])
            assert raw[f"x{i}", g.fit.name] == pytest.approx(score)
            assert base + shares.get((f"x{i}", g.fit.name), 0.0) == pytest.approx(score)


def test_jobs_follow_rounds_not_fits(spark):
    """Twice as many fits take as many jobs."""
    *_, examples, present = tables(spark, 5, runs=4)
    codes = B.number_features(present)
    runs = [f"r{k}" for k in range(4)]
    data = B.cells(examples, present, codes, runs)
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for some in (runs[:1], runs):
        group = f"fits-{len(some)}"
        spark.sparkContext.setJobGroup(group, group)
        B.fit_all(data, [B.Fit(f"{r}/{d}", r, 0.1, 2, 3) for r in some for d in range(8)], runs)
        counts.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1], counts


def test_attributions_with_very_many_features(spark):
    """Rows of 10^5 features: what a row costs follows what it holds and what the trees split on."""
    r = random.Random(4)
    present = [(f"x{i}", f"f{r.randrange(100_000):06d}") for i in range(40) for _ in range(2500)] + [(f"x{i}", "target") for i in range(0, 40, 2)]
    present = spark.createDataFrame(present, "row string, feature string")
    examples = spark.createDataFrame([("r", f"x{i}", float(i % 2 == 0), 1.0, "train" if i % 5 else "test") for i in range(40)], "run string, row string, label double, weight double, fold string")
    codes = B.number_features(present)
    data = B.cells(examples, present, codes, ["r"])
    trees, (grown,) = B.fit_all(data, [B.Fit("a", "r", 0.5, 2, 3)], ["r"])
    models = {"a": B.collect_models(trees)["a"][: grown.length()]}
    found = B.attributions(data, models)
    assert found.select("code").distinct().count() <= 6
    total = {r.row: r.s for r in found.groupBy("row").agg({"attribution": "sum"}).withColumnRenamed("sum(attribution)", "s").collect()}
    raw = {r.row: r.raw for r in B.score_rows(data, models, {"a": grown.start}).collect()}
    base = B.expected(models["a"], grown.start)
    assert all(raw[k] == pytest.approx(base + total[k]) for k in raw)
    best = B.feature_gains(trees).join(codes, "code").orderBy("importance", ascending=False).first()
    assert best.feature == "target"


def test_nothing_to_learn(spark):
    examples = spark.createDataFrame([("r", "a", 1.0, 1.0, "train"), ("r", "b", 1.0, 0.0, "train"), ("s", "a", None, 1.0, "train")], "run string, row string, label double, weight double, fold string")
    present = spark.createDataFrame([("a", "f"), ("b", "f"), (None, "g"), ("b", None)], "row string, feature string")
    data = B.cells(examples, present, B.number_features(present), ["r", "s"])
    trees, grown = B.fit_all(data, [B.Fit("r", "r", 0.1, 2, 4), B.Fit("s", "s", 0.1, 2, 4)], ["r", "s"])
    assert trees.count() == 0 and [g.length() for g in grown] == [0, 0]
    assert {(r.fit, r.raw) for r in B.score_rows(data, {}, {"r": 0.0}).collect()} == {("r", 0.0)}


def test_tasks_add_up_a_bounded_number_of_held_features(monkeypatch):
    monkeypatch.setattr(B, "HELD", 50)
    sizes = random.Random(2).choices([0, 1, 7, 20, 90], k=200)
    held = B.pa.array([list(range(n)) for n in sizes], B.pa.list_(B.pa.int32()))
    parts = list(B._slices(held, 1))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(200))
    assert all(sum(sizes[p]) <= 50 or p.stop - p.start == 1 for p in parts)
    for codes in (np.array([5, 2, 5, 9]), np.array([10**6, 3, 3]), np.array([], np.int64)):
        assert all((x == y).all() for x, y in zip(B._distinct(codes), np.unique(codes, return_inverse=True), strict=True))
