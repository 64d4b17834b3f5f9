import pytest
from pyspark.sql import functions as F

from traitforge.operators import annotate, cluster, evaluate, merge, model, presence, select
from traitforge.plans import storage
from traitforge.sources import files


def test_spread_values_refuses_two_for_one_cell(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "g string, f string, v int")
    assert sorted(map(tuple, presence.spread_values(rows, "g", "f", ["x", "y"], "v").collect())) == [("a", 1, 0), ("b", 0, 2)]
    with pytest.raises(Exception, match="two values for a x"):
        presence.spread_values(rows.unionByName(rows), "g", "f", ["x", "y"], "v").collect()


def test_names_that_may_be_missing(spark):
    table = spark.createDataFrame([("s", "p", 1)], "strain string, my_phage string, f int")
    assert merge.without_columns(table, ["strain", "nothing"]).columns == ["my_phage", "f"]
    assert [merge.entity_column(table.columns, "phage"), merge.entity_column(["strain"], "phage"), merge.entity_column(["phage", "strain"], "strain")] == ["my_phage", None, "strain"]
    with pytest.raises(ValueError, match="g, h"):
        merge.align_columns(table, ["f", "g", "h"])
    assert merge.align_columns(table, ["f"]).columns == ["f"]


def test_unassigned_hits_are_counted_and_first_files_win(spark):
    best = spark.createDataFrame([("q1", "t1"), ("q2", "t2")], "query string, target string")
    clusters = spark.createDataFrame([("c", "t1")], "cluster string, member string")
    assert presence.count_unassigned(presence.assign_clusters(best, clusters, "target", "member", "cluster"), "cluster") == 1
    rows = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), (None, 1, "c")], "id string, n int, v string")
    assert {tuple(r) for r in annotate.first_per_key(rows, "id", ["n"]).collect()} == {("p", 1, "a"), (None, 1, "c")}


def test_scores_without_classes_to_tell_apart(spark):
    present = spark.createDataFrame([(1, "f"), (2, "f"), (2, "g")], "row int, feature string")
    for labels in ([(1, 1), (2, 1)], [(1, 0), (2, 1)]):
        assert {r.score for r in select.anova_f(present, spark.createDataFrame(labels, "row int, label int"), "row").collect()} <= {None}


def test_a_large_family_with_one_private_change_each(spark):
    """Every member has rare k-mers of its own; the common ones, held by all, still bring them together."""
    core = "".join(chr(65 + (k * k + 3 * k) % 20) for k in range(40))
    rows = [(f"p{i:04d}", core[: i % 40] + "YZ"[i // 40 % 2] * (1 + i // 80) + core[i % 40 + 1 :]) for i in range(300)]
    found = cluster.protein_families(spark.createDataFrame(rows, "protein_id string, sequence string"), k=4, least_identity=0.5, coverage=0.3, most=20)
    assert {r.cluster for r in found.collect()} == {"p0000"}


def test_dense_groups_ignore_how_common_features_are(spark):
    rows = [(f"g{i}", f"c{j}") for i in range(30) for j in range(12)] + [(f"h{i}", f"d{j}") for i in range(3) for j in range(5)] + [("h0", "c1")]
    got = dict(map(tuple, cluster.dense_groups(spark.createDataFrame(rows, "genome string, cluster string"), 0.8).collect()))
    assert {got[f"g{i}"] for i in range(30)} == {"g0"} and {got[f"h{i}"] for i in range(3)} == {"h0"}


def test_attributions_carry_values(spark):
    rows = spark.createDataFrame([(i, ["a"] if i % 2 else [], float(i % 2)) for i in range(40)], "i int, held array<string>, y double")
    s = model.Settings(label="y")
    fitted = model.fit(rows, ["a", "b"], s, 2, 0.5, 2)
    assert model.names_of(fitted) == ["a", "b"]
    parts = model.attributions(fitted, rows, ["a", "b"], "i").collect()
    assert {(p.feature, p.value, p.attribution > 0) for p in parts} == {("a", 1.0, True), ("a", 0.0, False)}


def test_describe_and_headerless_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    assert tuple(evaluate.describe(rows, "v", [2.0]).first())[:2] == (2, 2.0) and evaluate.describe(rows, "v", [2.0]).first().reach_0 == 1
    hits = spark.createDataFrame([("p", "c")], "protein_id string, cluster string")
    files.write_hits(hits, str(tmp_path / "hits"))
    assert [tuple(r) for r in files.read_best_hits(spark, str(tmp_path / "hits")).collect()] == [("p", "c")]


def test_intermediate_tables_are_released(spark):
    mark = storage.written()
    kept = [storage.materialize(spark.range(3), "t") for _ in range(3)]
    paths = storage._WRITTEN[mark:]
    storage.release(spark, mark, keep_last=True)
    assert [storage.exists(spark, p) for p in paths] == [False, False, True] and kept[2].count() == 3
    storage.release(spark, mark)
    assert not storage.exists(spark, paths[2]) and storage.written() == mark
    assert spark.range(1).select(F.lit(1)).count() == 1
