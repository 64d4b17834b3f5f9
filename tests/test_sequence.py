from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traitforge.functions import sequences as S
from traitforge.operators import sequence


def proteins(spark, *rows):
    return spark.createDataFrame(list(rows), "genome string, protein_id string, sequence string")


def test_kmers_of_short_and_starred_sequences(spark):
    df = proteins(spark, ("g", "a", "MKTAY"), ("g", "b", "MK"), ("g", "c", "MK*TA"), ("g", "d", ""), ("g", "e", None))
    got = {r.protein_id: r.k for r in df.select("protein_id", S.kmers(F.col("sequence"), 3).alias("k")).collect()}
    assert got["a"] == ["MKT", "KTA", "TAY"] and got["b"] == [] and got["c"] == ["MKT", "KTA"] and got["d"] == [] and not got["e"]


def test_kmer_range_is_the_union_of_its_sizes(spark):
    df = proteins(spark, ("g", "a", "MKTAY"))
    got = sequence.explode_kmer_range(df, 3, 5, ["protein_id"]).collect()
    assert sorted((r.k, r.kmer) for r in got) == [(3, "KTA"), (3, "MKT"), (3, "TAY"), (4, "KTAY"), (4, "MKTA"), (5, "MKTAY")]


def test_support_counts_proteins_not_occurrences(spark):
    occ = sequence.explode_kmers(proteins(spark, ("g", "a", "AAAA"), ("h", "b", "KTA"), ("h", "c", "KTAA"), ("h", None, "AAA")), 3, ["protein_id", "genome"])
    assert {(r.kmer, r.proteins) for r in sequence.kmer_support(occ, []).collect()} == {("KTA", 2)}
    assert {(r.kmer, r.proteins) for r in sequence.kmer_support(occ, [], one_gene=True).collect()} == {("KTA", 2), ("AAA", 1), ("TAA", 1)}
    assert {(r.genome, r.feature) for r in sequence.kmer_features(occ, sequence.kmer_support(occ, []), [], "genome").collect()} == {("h", "KTA")}


def test_feature_call_thresholds(spark):
    rows = [("g1", "f", "c", k, h) for k, h in (("a", 1), ("b", 1), ("c", 0), ("d", 0))] + [("g2", "f", "c", k, 0) for k in "abcd"] + [(None, "f", "c", "a", 1)]
    hits = spark.createDataFrame(rows, "genome string, feature string, cluster string, kmer string, hit int")
    universe = spark.createDataFrame([("f",), ("z",)], "feature string")
    for threshold in (0.5, 2.0):
        got = {(r.genome, r.feature): r.present for r in sequence.call_features(hits, universe, threshold).collect()}
        assert got == {("g1", "f"): 1, ("g2", "f"): 0, ("g1", "z"): 0, ("g2", "z"): 0}


def test_identifiers(spark):
    row = spark.range(1).select(
        S.genome_of_protein(F.lit("g_1_7 # x")).alias("genome"), S.without_suffix(F.lit("a.b")).alias("stem"), S.kmer_of_label(F.lit("fam_A_MKT")).alias("kmer"), S.family_of_label(F.lit("fam_A_MKT")).alias("family"),
        S.cutoff_of_name(F.lit("table_cutoff_12.csv")).alias("cut"), S.cutoff_of_name(F.lit("none")).alias("no_cut"), S.file_safe(F.lit("a|b/c")).alias("safe"),
    ).first()
    assert tuple(row) == ("g_1", "a", "MKT", "fam_A", 12, None, "a_b_c")


def test_duplicates_rewrite_all_ids_or_none(spark):
    twice = proteins(spark, ("g", "a", "M"), ("h", "a", "K"), ("h", "b", "T"))
    assert {r.protein_id for r in sequence.rewrite_ids(twice, "protein_id", "genome").collect()} == {"g::a", "h::a", "h::b"}
    once = proteins(spark, ("g", "a", "M"), ("h", "b", "T"))
    assert {r.protein_id for r in sequence.rewrite_ids(once, "protein_id", "genome").collect()} == {"a", "b"}


def test_gapped_positions(spark):
    df = spark.createDataFrame([("-K-TKT", "KT"), ("AAAA", "AA"), ("--", "A"), ("A", "AA")], "a string, k string")
    plain = [[tuple(x) for x in r[0]] for r in df.select(S.gap_tolerant_ranges(F.col("a"), F.col("k"))).collect()]
    aware = [[tuple(x) for x in r[0]] for r in df.select(S.gap_tolerant_ranges(F.col("a"), F.col("k"), True)).collect()]
    assert plain == [[(1, 2), (4, 5)], [(0, 1), (1, 2), (2, 3)], [], []]
    assert aware == [[(1, 3), (4, 5)], [(0, 1), (1, 2), (2, 3)], [], []]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("AK-", min_size=1, max_size=12), min_size=1, max_size=8), st.text("AK", min_size=1, max_size=3))
def test_gapped_positions_match_a_regular_expression(spark, texts, kmer):
    import re

    pattern = re.compile("(?=" + "-*".join(kmer) + ")")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    got = {r.i: r.s for r in df.select("i", S.gap_tolerant_starts(F.col("a"), F.lit(kmer)).alias("s")).collect()}
    assert got == {i: [m.start() for m in pattern.finditer(t)] for i, t in enumerate(texts)}


def test_proteins_are_dealt_out_before_their_kmers_are_rows(spark):
    proteins = spark.createDataFrame([("a", "MKTM"), ("b", "MKT"), ("b", "MKT"), ("c", None)], "protein_id string, sequence string").coalesce(1)
    found = sequence.explode_kmers(proteins, 3, ["protein_id"])
    assert sorted(map(tuple, found.collect())) == [("a", "KTM"), ("a", "MKT"), ("b", "MKT"), ("b", "MKT")]
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning(protein_id")
