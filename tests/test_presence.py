import random

from pyspark.sql import functions as F

from traitforge.operators import cluster, merge, presence


def rel(spark, rows):
    return spark.createDataFrame(rows, "genome string, cluster string")


def test_best_hit_order_and_missing_cluster(spark):
    hits = spark.createDataFrame([("q", "t1", 0.90, 1e-5, 0), ("q", "t2", 0.95, 1e-3, 1), ("q", "t3", 0.95, 1e-9, 2), ("r", "x", 0.5, 1.0, 3)], "query string, target string, identity double, e_value double, n int")
    ranked = presence.best_hits(hits, "query", [F.col("identity").desc(), F.col("e_value").asc(), F.col("n").asc()])
    picked = presence.best_of(hits, "query", [-F.col("identity"), F.col("e_value"), F.col("n")], ["target"])
    assert {(r.query, r.target) for r in ranked.collect()} == {(r.query, r.target) for r in picked.collect()} == {("q", "t3"), ("r", "x")}
    clusters = spark.createDataFrame([("c", "t3")], "cluster string, protein_id string")
    assert {(r.query, r.cluster) for r in presence.assign_clusters(picked, clusters, "target", "protein_id", "cluster").collect()} == {("q", "c"), ("r", None)}


def test_collapse_and_assignment(spark):
    present = rel(spark, [("a", "c1"), ("b", "c1"), ("a", "c2"), ("b", "c2"), ("a", "c3"), ("a", "c1")])
    features = presence.collapse(present)
    assert dict(map(tuple, features.collect())) == {"c1": "sc_0", "c2": "sc_0", "c3": "sc_1"}
    assert {tuple(r) for r in presence.assign_features(present, features).collect()} == {("a", "sc_0"), ("a", "sc_1"), ("b", "sc_0")}
    missing = presence.add_missing_genomes(presence.assign_features(present, features), rel(spark, [("z", "")]))
    assert [tuple(r) for r in missing.collect()] == [("z", None)]


def test_collapse_does_not_depend_on_row_order(spark):
    r = random.Random(1)
    rows = [(f"g{r.randint(0, 5)}", f"c{r.randint(0, 30)}") for _ in range(150)]
    want = {tuple(x) for x in presence.collapse(rel(spark, rows)).collect()}
    r.shuffle(rows)
    assert {tuple(x) for x in presence.collapse(rel(spark, rows).repartition(7)).collect()} == want


def test_wide_and_long_are_inverse(spark):
    rows = {("a", "x"), ("b", "y"), ("a", "y")}
    wide = presence.wide(rel(spark, sorted(rows)), "genome", "cluster", ["x", "y", "z"], rel(spark, [("a", ""), ("b", ""), ("c", "")]))
    assert {r.genome: (r.x, r.y, r.z) for r in wide.collect()} == {"a": (1, 1, 0), "b": (0, 1, 0), "c": (0, 0, 0)}
    assert {tuple(r) for r in presence.long(wide, "genome", ["x", "y", "z"]).collect()} == rows
    assert [tuple(r) for r in presence.binarise(spark.createDataFrame([("a", 3, 0)], "g string, x int, y int"), ["x", "y"]).collect()] == [("a", 1, 0)]


def test_shared_clusters_within_listed_genomes(spark):
    present = rel(spark, [("a", "c1"), ("b", "c1"), ("a", "c2"), ("z", "c2"), (None, "c3")])
    assert {(r.genome, r.cluster) for r in presence.shared_clusters(present, rel(spark, [("a", ""), ("b", "")])).collect()} == {("a", "c1"), ("b", "c1")}
    assert presence.presence(present, "genome", "cluster").count() == 4


def test_grid_and_alignment(spark):
    strains, phages = spark.createDataFrame([("s1",), ("s2",)], "strain string"), spark.createDataFrame([("p1",), ("p2",)], "phage string")
    assert sorted(tuple(r) for r in merge.prediction_grid(strains, phages).collect()) == [("p1", "s1"), ("p1", "s2"), ("p2", "s1"), ("p2", "s2")]
    assert merge.prediction_grid(strains, None).count() == 2
    table = spark.createDataFrame([(1, 2)], "f2 int, f3 int")
    try:
        merge.align_columns(table, ["f1", "f2"])
    except ValueError as e:
        assert "f1" in str(e)
    else:
        raise AssertionError
    assert merge.align_columns(table, ["f3"]).columns == ["f3"]
    assert [merge.selected_features_per_run(n) for n in (499, 500, 1999, 2000)] == [50, 100, 100, 100]


def test_cutoff_tables_keep_strictly_between(spark):
    occ = spark.createDataFrame([(f"f{i}", 3 if i < 5 else 2 if i < 6 else 1) for i in range(40)], "feature string, occurrence long")
    got = {r.cut_off for r in merge.cutoff_tables(occ, [1, 2, 3], 400).select("cut_off").collect()}
    assert got == {2}


def test_families_link_kin_through_shared_kmers(spark):
    base = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQ"
    rows = [("a", base), ("b", base[:-3] + "AAA"), ("c", "WWWWWWWWWWPPPPPPPPPPGGGGGGGGGG"), ("d", base + "KKK")]
    got = dict((r.protein_id, r.cluster) for r in cluster.protein_families(spark.createDataFrame(rows, "protein_id string, sequence string"), k=4).collect())
    assert got == {"a": "a", "b": "a", "d": "a", "c": "c"}


def test_a_query_of_common_kmers_still_finds_its_kin(spark):
    rows = [(f"p{i}", "MKTAYIAK") for i in range(6)]
    got = cluster.protein_families(spark.createDataFrame(rows, "protein_id string, sequence string"), k=4, most=2)
    assert {r.cluster for r in got.collect()} == {"p0"}


def test_dense_groups_and_group_filter(spark):
    present = rel(spark, [(g, c) for g in ("a", "b", "c") for c in ("x", "y", "z")] + [("d", "x"), ("d", "q"), ("e", "q")])
    groups = cluster.dense_groups(present)
    assert dict(map(tuple, groups.collect())) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert {r.cluster for r in cluster.filter_by_groups(present, groups, 2).collect()} == {"x", "q"}


def test_genome_clusters_have_at_most_k_groups(spark):
    table = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 0, 1), ("d", 0, 1)], "genome string, x int, y int")
    got = dict(map(tuple, cluster.genome_clusters(table, "genome", ["x", "y"], 2).collect()))
    assert got["a"] == got["b"] != got["c"] == got["d"]


def test_large_family_with_private_changes(spark):
    """More members than ``most``, all with the same conserved k-mers and each with k-mers of its own."""
    base = "MKVLAARTGQWERTYHPLKSDFGHNMCVWIPEAKRTLQNDSYHFGEWMKCTV"
    rows = [(f"p{i}", base[: 5 + 6 * i] + "X" + base[6 + 6 * i :]) for i in range(7)] + [("short", base[9:35]), ("z", "GGGGAAAACCCCTTTTSSSS")]
    proteins = spark.createDataFrame(rows, "protein_id string, sequence string")
    kmers = {p: {s[i : i + 4] for i in range(len(s) - 3)} for p, s in rows}
    for least, coverage in ((0.4, 0.0), (0.7, 0.8), (0.0, 0.0)):
        found = cluster.homology_hits(proteins, proteins, k=4, least_identity=least, coverage=coverage, most=2)
        got = {(r.query, r.target): r.identity for r in found.collect()}
        want = {}
        for a, x in kmers.items():
            for b, y in kmers.items():
                n = len(x & y)
                if n and n / min(len(x), len(y)) >= least and n / max(len(x), len(y)) >= coverage:
                    want[a, b] = n / min(len(x), len(y))
        assert got == want
    families = dict((r.protein_id, r.cluster) for r in cluster.protein_families(proteins, k=4, most=2).collect())
    assert {families[f"p{i}"] for i in range(7)} == {"p0"} and families["z"] == "z"
