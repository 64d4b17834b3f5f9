import pytest

from traitforge.plans.storage import Stages
from traitforge.sources import files
from traitforge.streaming.scoring import running_votes, stream_presence


def test_fasta_round_trip_and_pruning(spark, tmp_path):
    folder = tmp_path / "fa"
    folder.mkdir()
    (folder / "x.y.faa").write_text(">p1 a > b\nMKT\nAY\n>p2\nMK*\n")
    (folder / "z.faa").write_text(">p3 d\r\nAAA\r\nCCC\r\n")
    (folder / "n.txt").write_text(">no\nM\n")
    (folder / "empty.faa").write_text("")
    got = {(r.genome, r.protein_id, r.sequence, r.description) for r in files.read_fasta(spark, str(folder), "faa").collect()}
    assert got == {("x.y", "p1", "MKTAY", "p1 a > b"), ("x.y", "p2", "MK*", "p2"), ("z", "p3", "AAACCC", "p3 d")}
    assert {r.genome for r in files.read_fasta(spark, str(folder), "faa", ["z"]).collect()} == {"z"}
    files.write_fasta(files.read_fasta(spark, str(folder), "faa"), str(tmp_path / "out"))
    assert {(r.protein_id, r.sequence) for r in files.read_fasta(spark, str(tmp_path / "out")).collect()} == {(p, s) for _, p, s, _ in got}


def test_tables(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("q\tt\t10\t0.9\t1e-5\t1\t5\t9\t1\t5\t9\n")
    hit = files.read_hits(spark, str(tmp_path / "h.tsv")).first()
    assert (hit.query, hit.target_length) == ("q", 9)
    (tmp_path / "a.txt").write_text('strain\tdesc\ns1\t"a, b"\n')
    assert files.read_annotations(spark, str(tmp_path / "a.txt")).first().desc == "a, b"
    (tmp_path / "b.txt").write_text("only\n")
    with pytest.raises(ValueError):
        files.sniff_separator(spark, str(tmp_path / "b.txt"))
    (tmp_path / "c.csv").write_text("strain\n7\n7\n8\n")
    assert {r.strain for r in files.read_entities(spark, str(tmp_path / "c.csv"), "strain").collect()} == {"7", "8"}
    with pytest.raises(ValueError, match="strain"):
        files.read_entities(spark, str(tmp_path / "c.csv"), "phage")
    runs = spark.createDataFrame([(1, "run_0", "f"), (2, "run_0", "g")], "cut_off int, run string, feature string")
    files.write_runs(runs, str(tmp_path / "runs"))
    assert files.read_runs(spark, str(tmp_path / "runs")).filter("cut_off = 2").select("feature").first().feature == "g"


def test_stages_resume_and_invalidate(spark, tmp_path):
    made = []

    def make(name):
        made.append(name)
        return spark.createDataFrame([(1,)], "x int")

    for settings, want in (({"k": 1}, ["a", "b"]), ({"k": 1}, []), ({"k": 2}, ["a", "b"])):
        made.clear()
        stages = Stages(spark, str(tmp_path / "s"))
        stages.run("a", lambda: make("a"), settings)
        stages.run("b", lambda: make("b"))
        assert made == want
    made.clear()
    Stages(spark, str(tmp_path / "s"), force=True).run("b", lambda: make("b"))
    assert made == ["b"]
    stages = Stages(spark, str(tmp_path / "s"))
    assert stages.run("a", lambda: make("a"), {"k": 2}, columns=["x"]).count() == 1
    assert [tuple(r)[:2] for r in stages.report().collect()] == [("a", "reused")]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("g", "MKTAY")], "genome string, sequence string").write.parquet(str(tmp_path / "p"))
    features = spark.createDataFrame([("KTA", "sc_0")], "cluster string, feature string")
    stream = spark.readStream.schema("genome string, sequence string").parquet(str(tmp_path / "p"))
    q = stream_presence(stream, features, 3).writeStream.format("memory").queryName("present").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("present").collect()] == [("g", "sc_0")]
    spark.sql("SELECT 's' AS strain, timestamp'2026-01-01 00:01:00' AS ts, 0.9D AS confidence UNION ALL SELECT 's', timestamp'2026-01-01 00:02:00', 0.3D").write.parquet(str(tmp_path / "v"))
    votes = running_votes(spark.readStream.schema("strain string, ts timestamp, confidence double").parquet(str(tmp_path / "v")), ["strain"], "ts")
    q = votes.writeStream.format("memory").queryName("votes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.strain, round(r.confidence, 6), r.runs, r.prediction) for r in spark.table("votes").collect()] == [("s", 0.6, 2, 1)]
