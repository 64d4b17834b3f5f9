import math

import numpy as np
import pytest

from traitforge.operators import hierarchy as H


def plain_ward(x, k):
    """The nearest two clusters merge, one pair at a time."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = x[groups[i]], x[groups[j]]
                d = 2 * len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or d < best[0]:
                    best = (d, i, j)
        _, i, j = best
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def plain_labels(x, least):
    """HDBSCAN on a dense matrix, its tree built by recursion from the whole down."""
    n = len(x)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    core = np.sort(d, 1)[:, min(least, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    tree, part = [], list(range(n))
    for w, i, j in edges:
        if part[i] != part[j]:
            tree.append((w, i, j))
            part = [part[i] if p == part[j] else p for p in part]

    def parts(points, links):
        """Split at the last link: (height, the two sides)."""
        w, i, _ = links[-1]
        side, grown = {i}, True
        while grown:
            grown = False
            for _, a, b in links[:-1]:
                if (a in side) != (b in side):
                    side |= {a, b}
                    grown = True
        inside = lambda s: [e for e in links[:-1] if e[1] in s]
        rest = set(points) - side
        return w, (side, inside(side)), (rest, inside(rest))

    def cluster(points, links, born):
        """(stability, best clusters) of the cluster that begins with these points."""
        stable = 0.0
        points, whole = set(points), set(points)
        while True:
            if not links:
                stable += len(points) * (1e9 - born)
                return choose(stable, [], whole)
            w, one, two = parts(points, links)
            at = 1 / max(w, 1e-9)
            large = [s for s in (one, two) if len(s[0]) >= least]
            if len(large) == 2:
                stable += len(points) * (at - born)
                return choose(stable, [cluster(*s, at) for s in large], whole)
            for s in (one, two):
                if len(s[0]) < least:
                    stable += len(s[0]) * (at - born)
            if not large:
                return choose(stable, [], whole)
            points, links = large[0]

    def choose(stable, below, whole):
        under = sum(b[0] for b in below)
        return (stable, [whole]) if stable >= under else (under, [c for b in below for c in b[1]])

    def children(points, links):
        """The clusters below the whole."""
        while links:
            w, one, two = parts(points, links)
            large = [s for s in (one, two) if len(s[0]) >= least]
            if len(large) == 2:
                return [c for s in large for c in cluster(*s, 1 / max(w, 1e-9))[1]]
            if not large:
                return []
            points, links = large[0]
        return []

    return {frozenset(c) for c in children(set(range(n)), tree)}


def vectors(spark, x):
    table = spark.createDataFrame([(f"g{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)], "genome string, x array<double>").repartition(3)
    return H.dense_vectors(table, "genome", "x")


def groups_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group, set()).add(int(r.genome[1:]))
    assert all(int(k[1:]) == min(v) for k, v in out.items())
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize(("seed", "block", "small"), [(1, 1000, 2048), (2, 9, 4), (3, 17, 20)])
def test_ward_equals_one_merge_at_a_time(spark, monkeypatch, seed, block, small):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "SMALL", small)
    monkeypatch.setattr(H, "PLACES", 3)
    x = np.random.RandomState(seed).rand(40, 7)
    v, names = vectors(spark, x)
    assert groups_of(H.ward_groups(v, names, "genome", 6)) == plain_ward(x, 6)


def test_ward_heights_rise_and_sum_to_the_deviation(spark):
    x = np.random.RandomState(5).rand(30, 4)
    v, _ = vectors(spark, x)
    heights = sorted(r.height for r in H.ward_merges(v).collect())
    assert len(heights) == 29 and math.isclose(sum(heights) / 2, ((x - x.mean(0)) ** 2).sum(), rel_tol=1e-6)


@pytest.mark.parametrize(("seed", "block"), [(1, 1000), (2, 13), (4, 1000)])
def test_hdbscan_equals_recursion(spark, monkeypatch, seed, block):
    monkeypatch.setattr(H, "BLOCK", block)
    r = np.random.RandomState(seed)
    x = np.concatenate([r.randn(14, 2) * 0.2 + c for c in ((0, 0), (3, 3), (0, 4), (5, 0), (5.8, 0.6))] + [r.rand(8, 2) * 9 - 2])
    v, names = vectors(spark, x)
    want = plain_labels(x, 4)
    assert len(want) >= 4
    got = groups_of(H.hdbscan_groups(v, names, "genome", 4))
    assert {g for g in got if len(g) > 1} == want
    assert {i for g in got for i in g} == set(range(len(x)))


def test_few_labels_fall_back_to_ward_and_edge_cases(spark):
    x = np.random.RandomState(3).rand(12, 3)
    v, names = vectors(spark, x)
    assert groups_of(H.hdbscan_groups(v, names, "genome", 6)) == plain_ward(x, 5)
    present = spark.createDataFrame([("g001", "a"), ("g002", "a"), ("g002", None), ("g003", None), (None, "b"), ("g004", "b")], "genome string, feature string")
    v, names = H.presence_vectors(present, "genome", "feature")
    assert groups_of(H.ward_groups(v, names, "genome", 3)) == {frozenset({1, 2}), frozenset({3}), frozenset({4})}
    assert groups_of(H.ward_groups(v, names, "genome", 9)) == {frozenset({i}) for i in (1, 2, 3, 4)}
    v, names = H.presence_vectors(present.limit(0), "genome", "feature")
    assert H.ward_groups(v, names, "genome", 3).count() == 0


def test_what_a_search_sends_grows_with_the_vectors(spark, monkeypatch):
    """Sixty blocks' worth of vectors are searched in about ``TASKS`` pairs of blocks, not in 3,600."""
    monkeypatch.setattr(H, "BLOCK", 10)
    v, _ = vectors(spark, np.random.RandomState(1).rand(600, 3))
    pairs = H._searched(v, v, lambda a, b: H.pa.table({"id": H.pa.array([1], H.pa.int64())}), "id long").count()
    assert 32 <= pairs <= 72, pairs


def test_vectors_that_keep_what_they_found_do_not_search_again(spark, monkeypatch):
    asked, search = [], H.nearest_outside
    monkeypatch.setattr(H, "nearest_outside", lambda queries, rows: asked.append(queries.count()) or search(queries, rows))
    r = np.random.RandomState(6)
    v, _ = vectors(spark, np.concatenate([r.randn(30, 2) * 0.1 + c for c in ((0, 0), (5, 0), (0, 7))]))
    assert H.spanning_tree(v, 3).count() == 89
    assert asked[0] == 90 and asked[-1] < 90, asked


def test_lists_of_the_nearest_tell_most_of_the_tree(spark, monkeypatch):
    """The nearest of each are searched once; then few search again."""
    asked, search = [], H.nearest_outside
    monkeypatch.setattr(H, "nearest_outside", lambda queries, rows: asked.append(queries.count()) or search(queries, rows))
    v, _ = vectors(spark, np.random.RandomState(9).randn(300, 10))
    assert H.spanning_tree(v, 4).count() == 299
    assert asked[0] == 300 and sum(asked) < 360, asked


def test_density_of_copies_far_from_the_origin_with_short_lists(spark, monkeypatch):
    """Rounding in single precision, equal distances and lists that end early change nothing."""
    monkeypatch.setattr(H, "LISTED", 4)
    r = np.random.RandomState(12)
    x = np.concatenate([r.randn(12, 3) * 0.2 + c for c in ((0, 0, 0), (4, 0, 0), (0, 5, 0), (0, 0, 6))] + [r.randint(0, 3, (14, 3)) + 9.0])
    x = np.concatenate([x, x[:9], np.repeat(x[20:21], 7, 0)]) + 2000
    v, names = vectors(spark, x)
    want = plain_labels(x, 3)
    got = groups_of(H.hdbscan_groups(v, names, "genome", 3, fewest=1))
    assert {g for g in got if len(g) > 1} == want and len(want) >= 4


def test_clusters_whose_nearest_merged_take_the_next_of_their_lists(spark, monkeypatch):
    """Beside merged clusters few search again, also where near copies merge that are both on others' lists."""
    monkeypatch.setattr(H, "SMALL", 12)
    asked, search = [], H.nearest_clusters
    monkeypatch.setattr(H, "nearest_clusters", lambda queries, *more: asked.append(queries.select("id").distinct().count()) or search(queries, *more))
    r = np.random.RandomState(4)
    x = np.repeat(r.randn(40, 12), 2, 0) + r.randn(80, 12) * 0.05
    v, names = vectors(spark, x)
    assert groups_of(H.ward_groups(v, names, "genome", 7)) == plain_ward(x, 7)
    assert asked[0] == 80 and sum(asked) < 240, asked


def test_ward_adds_vectors_that_hold_different_places(spark, monkeypatch):
    monkeypatch.setattr(H, "SMALL", 3)
    monkeypatch.setattr(H, "KEPT", 2)
    r = np.random.RandomState(8)
    x = (r.rand(22, 9) < 0.4).astype(float) * np.arange(1, 10) ** 1.37
    rows = [(f"g{i:03d}", int(j), float(x[i, j])) for i in range(22) for j in np.flatnonzero(x[i])] + [(f"g{i:03d}", None, None) for i in np.flatnonzero(x.sum(1) == 0)]
    held = spark.createDataFrame(rows, "genome string, j int, x double").groupBy("genome").agg(H.F.array_sort(H.F.collect_list(H.F.struct("j", "x"))).alias("e"))
    names = held.select(H.F.substring("genome", 2, 3).cast("long").alias("id"), "genome")
    v = held.select(H.F.substring("genome", 2, 3).cast("long").alias("id"), H.F.lit(1.0).alias("n"), H.F.col("e.j").alias("at"), H.F.col("e.x").alias("v"))
    assert groups_of(H.ward_groups(v, names, "genome", 5)) == plain_ward(x, 5)
