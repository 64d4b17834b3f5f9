import random
import time

from pyspark.sql import functions as F

from traitforge.operators import annotate, coverage


def test_segments_of_a_coverage_row(spark):
    rows = [("f", "fam", "p", i, c) for i, c in enumerate([0, 0, 1, 1, 0, 1])]
    df = spark.createDataFrame(rows, "feature string, family string, protein_id string, index int, coverage int")
    got = sorted((r.segment_id, r.coverage, r.start, r.stop) for r in coverage.segments(df).collect())
    assert got == [(1, 0, 0, 2), (2, 1, 2, 4), (3, 0, 4, 5), (4, 1, 5, 6)]


def test_gaps_lie_inside_a_segment(spark):
    rows = [("f", "fam", "p", i, 1) for i in (0, 1, 4)]
    df = spark.createDataFrame(rows, "feature string, family string, protein_id string, index int, coverage int")
    assert [(r.start, r.stop) for r in coverage.segments(df).collect()] == [(0, 5)]


def test_segments_partition_the_residues(spark):
    r = random.Random(8)
    rows = [("f", "fam", f"p{p}", i, r.randint(0, 1)) for p in range(5) for i in range(40) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "feature string, family string, protein_id string, index int, coverage int")
    found = coverage.segments(df).collect()
    for *_, p, i, c in rows:
        inside = [s for s in found if s.protein_id == p and s.start <= i < s.stop]
        assert len(inside) == 1 and inside[0].coverage == c


def test_coverage_from_aligned_kmers_and_uncovered_proteins(spark):
    rows = [("f", "fam", "p", "-K-TKT", "KT"), ("f", "fam", "p", "-K-TKT", "TK"), ("f", "fam", "q", "--AA--", "KT")]
    aligned = spark.createDataFrame(rows, "feature string, family string, protein_id string, aligned string, kmer string")
    got = {(r.protein_id, r["index"]): (r.residue, r.coverage) for r in coverage.residue_coverage(coverage.kmer_ranges(aligned)).collect()}
    assert got == {("p", 1): ("K", 1), ("p", 3): ("T", 1), ("p", 4): ("K", 1), ("p", 5): ("T", 1), ("q", 2): ("A", 0), ("q", 3): ("A", 0)}
    found = coverage.segments(coverage.residue_coverage(coverage.kmer_ranges(aligned)).filter("protein_id = 'p'"))
    rest = [r for r in coverage.add_uncovered(found, aligned).collect() if r.protein_id == "q"]
    assert [(r.feature, r.coverage, r.segment_id, r.start, r.stop) for r in rest] == [(None, 0, None, 0, 2)]


def test_shared_leading_gaps_are_cut(spark):
    df = spark.createDataFrame([("x", "a", "--MK"), ("x", "b", "---K"), ("y", "c", "-A")], "family string, protein_id string, aligned string")
    assert {r.protein_id: (r.aligned, r.start_index) for r in coverage.trim_leading_gaps(df).collect()} == {"a": ("MK", 0), "b": ("-K", 1), "c": ("A", 0)}


def test_back_mapping(spark):
    assert annotate.predictive_features(["sc_1", "pc_2", "x"]) == {"strain": ["sc_1"], "phage": ["pc_2"]}
    features = spark.createDataFrame([("sc_0", "c1"), ("sc_0", "c2"), ("sc_1", "c3")], "feature string, cluster string")
    clusters = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "c")], "cluster string, protein_id string")
    selected = spark.createDataFrame([("sc_0",)], "feature string")
    rows = annotate.predictive_proteins(selected, features, clusters).collect()
    assert {(r.protein_id, r.unique_clusters, r.unique_proteins) for r in rows} == {("a", 2, 3), ("b", 2, 3), ("c", 2, 3)}


def test_one_pass_equals_ranges_of_each_kmer(spark):
    r = random.Random(3)
    aligned, kmers = [], []
    for p in range(12):
        text = "".join(r.choice("AK-T") for _ in range(r.randint(0, 40)))
        aligned.append(("fam", f"p{p}", text))
        kmers += [(f"f{r.randint(0, 2)}", "fam", f"p{p}", "".join(r.choice("AKT") for _ in range(r.randint(1, 3)))) for _ in range(4)]
    a = spark.createDataFrame([*aligned, ("fam", "none", None)], "family string, protein_id string, aligned string")
    k = spark.createDataFrame([*kmers, kmers[0], ("f0", "fam", "none", "A")], "feature string, family string, protein_id string, kmer string")
    for gap_aware in (False, True):
        want = coverage.residue_coverage(coverage.kmer_ranges(a.join(k, ["family", "protein_id"]), gap_aware))
        got = coverage.covered_residues(a, k, gap_aware)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_long_rows_take_seconds_not_minutes(spark):
    from traitforge.functions.sequences import gap_tolerant_starts, kmers

    text = "".join(random.Random(1).choice("ACDEFGHIKL") for _ in range(35_000))
    df = spark.createDataFrame([("f", "fam", "p", text, text[100:106])], "feature string, family string, protein_id string, aligned string, kmer string")
    coverage.covered_residues(df.select("family", "protein_id", "aligned"), df).agg({"coverage": "sum"}).collect()  # warm
    for work in (lambda: coverage.covered_residues(df.select("family", "protein_id", "aligned"), df).agg({"coverage": "sum"}).first()[0] >= 6, lambda: 100 in df.select(gap_tolerant_starts(F.col("aligned"), F.col("kmer"))).first()[0], lambda: len(df.select(kmers(F.col("aligned"), 6)).first()[0]) == 34_995):
        began = time.monotonic()
        assert work()
        took = time.monotonic() - began
        assert took < 8, took
        print(took)


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_residues_become_rows_last(spark):
    """Rows of one protein meet before residues are rows, also those of different sequences."""
    rows = [("f", "fam", "p", "KTA", "KT"), ("f", "fam", "p", "KTA", "TA"), ("f", "fam", "p", "K-TC", "C"), ("f", "fam", "p", None, "K"), ("f", "fam", "q", "AA", "K")]
    aligned = spark.createDataFrame(rows, "feature string, family string, protein_id string, aligned string, kmer string")
    found = coverage.residue_coverage(coverage.kmer_ranges(aligned))
    got = sorted((r.protein_id, r["index"], r.residue, r.coverage) for r in found.collect())
    assert got == [("p", 0, "K", 1), ("p", 1, "T", 1), ("p", 2, "A", 1), ("p", 2, "T", 0), ("p", 3, "C", 1), ("q", 0, "A", 0), ("q", 1, "A", 0)]
    assert plan_of(found).index("Generate") < plan_of(found).index("Exchange")


def test_many_short_rows_take_seconds(spark):
    """Residues are handed over many proteins at a time."""
    rows = spark.range(30_000).select(F.lit("fam").alias("family"), F.col("id").alias("protein_id"), F.lit("largering").alias("aligned"))
    kmers = rows.select(F.explode(F.array(F.lit("f"), F.lit("g"), F.lit("h"))).alias("feature"), "family", "protein_id", F.lit("ri").alias("kmer"))
    coverage.covered_residues(rows.limit(1), kmers.limit(1)).count()  # warm
    began = time.monotonic()
    assert coverage.covered_residues(rows, kmers).agg(F.count(F.lit(1)), F.sum("coverage")).first()[:] == (810_000, 180_000)
    assert time.monotonic() - began < 12


def test_pairs_are_dealt_out_before_they_are_told_apart(spark):
    """A protein in two clusters of a feature counts once; no task of the join holds all its pairs."""
    features = spark.createDataFrame([("f", "x"), ("f", "y"), ("f", "empty"), ("g", "y"), ("h", "x")], "feature string, cluster string")
    clusters = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b"), ("y", "c")], "cluster string, protein_id string")
    found = annotate.predictive_proteins(spark.createDataFrame([("f",), ("g",)], "feature string"), features, clusters)
    got = sorted((r.feature, r.cluster, r.protein_id or "", r.unique_clusters, r.unique_proteins) for r in found.collect())
    assert got == [("f", "empty", "", 3, 3), ("f", "x", "a", 3, 3), ("f", "x", "b", 3, 3), ("f", "y", "b", 3, 3), ("f", "y", "c", 3, 3), ("g", "y", "b", 1, 2), ("g", "y", "c", 1, 2)]
    assert "REPARTITION_BY_COL" in plan_of(found)
