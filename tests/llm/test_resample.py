import hashlib
import math
import random
from zlib import crc32

import duckdb
import pytest

from traitforge.llm import resample
from traitforge.llm.resample import buckets_of, draw, importance_scores, op11_crc_resampling


def brute(rows, target, percent=5, least=20):
    fold = lambda t: (t or "").encode().translate(resample._FOLD).split()
    runs = lambda w: [crc32(b" ".join(w[i : i + k])) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    s, t = [0] * 10000, [0] * 10000
    for _, text in rows:
        for b in runs(fold(text)):
            s[b] += 1
    for text in target:
        for b in runs(fold(text)):
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1.0) * (sum(s) + 10000) / ((x + 1.0) * (sum(t) + 10000)))) for x, y in zip(s, t, strict=True)]
    out = []
    for key, text in rows:
        w = fold(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in runs(w))
        out.append((key, len(w), len(runs(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    first = able[: len(able) * percent // 100]
    rest = able[len(first) :] + [r for r in out if r[1] < least]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:4], r[4] or 0)
    return sorted([(r[0], r[2], r[3], r[4], k + 1) for k, r in enumerate(first)] + [(r[0], r[2], r[3], r[4], None) for r in rest], key=key)


def corpus(seed, n=300):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["Ti", "on", "é", "ing", "ß9", "the"]) for _ in range(r.randint(1, 3)))
    rows = [(k, r.choice([" ", "-", "\n"]).join(word() for _ in range(r.randint(0, 80)))) for k in range(n)]
    rows += [(None, "lost words " * 15), (None, None), (3, None), (7, "twice " * 30), (7, "twice " * 30), (n, "x"), (n + 1, "word " * 3000)]
    return rows, [rows[5][1], "the ing", None, ""]


def test_ring_finds_every_run_whatever_the_step():
    r = random.Random(1)
    for _ in range(400):
        text = " ".join("".join(r.choice("abÉ-Z9") for _ in range(r.randint(0, 5))) for _ in range(r.randint(0, 12)))
        n, words = r.randint(1, 4), text.encode().translate(resample._FOLD).split()
        want = sorted(crc32(b" ".join(words[i : i + k])) % 999 for k in range(1, n + 1) for i in range(len(words) - k + 1))
        for step in (1, 3, 1000):
            count, found = buckets_of(text, n, 999, step)
            assert (count, sorted(found.tolist())) == (len(words), want)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(resample, "STEP", 50)
    rows, target = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in draw(importance_scores(docs, wanted)).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:4], r[4] or 0)) == brute(rows, target)


def test_query_against_sql(spark, tmp_path):
    rows, target = corpus(3)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(resample.OP11_SQL).select("doc_id", "n_features", "weight", "score", "rank").fetchall()
    got = [tuple(r) for r in op11_crc_resampling(spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_drawn_documents_keep_their_columns(spark):
    rows, target = corpus(4)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, rank string, row int")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, wanted, percent=10)
    assert got.columns == docs.columns
    ranked = {r.doc_id for r in draw(importance_scores(docs, wanted), percent=10).filter("rank IS NOT NULL").collect()}
    assert {r.doc_id for r in got.collect()} == ranked
    assert resample.resample(docs.limit(0), wanted).count() == 0
    assert importance_scores(docs, wanted.limit(0)).count() == len(rows)
