from collections import Counter

import numpy as np

from traitforge.llm import embeddings
from traitforge.llm.embeddings import audit_recall, near_duplicate_vectors


def brute(rows, threshold=0.95):
    unit = []
    for _, v in rows:
        x = np.zeros(8)
        if v and all(c is not None for c in v) and np.isfinite(v).all():
            x[: len(v)] = v
        unit.append(x / np.linalg.norm(x) if np.abs(x).max() > 0 else x)
    unit = np.array(unit)
    links = unit @ unit.T >= threshold
    np.fill_diagonal(links, False)
    comp = np.arange(len(rows))
    while True:
        new = np.array([min(comp[i], *comp[links[i]]) if links[i].any() else comp[i] for i in range(len(rows))])
        if (new == comp).all():
            break
        comp = new
    ids = [i for i, _ in rows]
    least = {c: min((ids[k] for k in np.flatnonzero(comp == c) if ids[k] is not None), default=None) for c in set(comp)}
    return Counter((ids[k], int(links[k].sum()), least[comp[k]], ids[k] == least[comp[k]]) for k in range(len(rows)))


def corpus(seed, n=400):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            base = np.array(out[r.integers(len(out))])
            out.append((base * r.choice([1.0, 3.0]) + r.normal(0, r.choice([0.0, 0.02, 0.3]), 8)).tolist())
        else:
            out.append(r.normal(size=8).tolist())
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", 60)
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rows = [(i, v) for i, v in enumerate(corpus(3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = near_duplicate_vectors(df).cache()
    got = {r.id: r for r in found.collect()}
    want = brute(rows)
    true = sum(n for _, n, _, _ in want.elements())
    assert sum(r.n_links for r in got.values()) >= 0.97 * true
    exact = {i: n for i, n, _, _ in want}
    assert all(r.n_links <= exact[i] for i, r in got.items())
    assert audit_recall(df, found, every=5) >= 0.95


def test_large_shards_are_dealt_out_again(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("BLOCK", 50), ("CENTROIDS", 4), ("LARGE", 100), ("PORTION", 70)):
        monkeypatch.setattr(embeddings, name, value)
    rows = [(i, v) for i, v in enumerate(corpus(4, 500))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    classes = embeddings._classes(df, "vec_id", "embedding").select("cls", "unit").dropDuplicates(["cls"])
    shards = embeddings._sharded(classes, 8)
    sizes = [r["count"] for r in shards.filter("p = q AND own = p").groupBy("shard").count().collect()]
    assert len(sizes) > 4 and shards.select("cls").distinct().count() == classes.count()
    found = near_duplicate_vectors(df).withColumnRenamed("unit", "u").collect()
    true = sum(n for _, n, _, _ in brute(rows).elements())
    assert sum(r.n_links for r in found) >= 0.95 * true


def test_links_found_from_the_later_side_only(spark, monkeypatch):
    def backwards(query, unit, lists, start, threshold):
        sims = unit @ query
        found = np.flatnonzero(sims >= threshold)
        return found[found < np.flatnonzero((unit == query).all(1))[0]], None

    monkeypatch.setattr(embeddings, "range_search", backwards)
    rows = [(i, v) for i, v in enumerate(corpus(4, 60))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in near_duplicate_vectors(df).collect()}
    want = {i: n for i, n, _, _ in brute(rows)}
    assert got == want and sum(want.values()) > 0


def test_small_cases_are_exact(spark):
    one = [1.0] + [0.0] * 7
    rows = [(5, one), (5, one), (2, one), (None, one), (7, [0.0] * 8), (8, None), (9, [float("nan")] * 8), (10, [1.0, None]), (11, [float("inf")] * 8), (12, [2.0]), (13, []), (None, [0.0, 1.0]), (14, [1e-300, 0.0, 0.0]), (15, [1e300, 1e300])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = Counter((r.id, r.n_links, r.component, r.kept) for r in near_duplicate_vectors(df).collect())
    assert got == {(5, 5, 2, False): 2, (2, 5, 2, True): 1, (None, 5, 2, False): 1, (12, 5, 2, False): 1, (14, 5, 2, False): 1, **{(i, 0, i, True): 1 for i in (7, 8, 9, 10, 11, 13, 15)}, (None, 0, None, True): 1}
    assert near_duplicate_vectors(df.limit(0)).count() == 0
