import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from traitforge.llm import recompress
from traitforge.llm.recompress import Symbols, op12_recompression_dedup, passage_report, spans_of, window_marks


def brute(rows, window):
    """rows: (id, text); without the words of windows that start in a smaller document."""
    key = lambda d: (d is not None, d or 0)
    split = [(key(d), (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            at = tuple(w[i : i + window])
            least[at] = min(least.get(at, d), d)
    out = []
    for (d, w), (own, _) in zip(split, rows, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((own, len(w), sum(gone), kept))
    return Counter(out)


def corpus(seed, n=50):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(["a", "b", "ü", "the", "ing", "ß."]) for _ in range(k))
    passages = [text(r.randint(40, 90)) for _ in range(4)]
    rows = []
    for k in range(n):
        t = text(r.randint(0, 140))
        if r.random() < 0.6:
            t = f"{t} {r.choice(passages)}\n{text(r.randint(0, 20))}"
        if rows and r.random() < 0.2:
            t = r.choice(rows)[1] or ""
        if rows and r.random() < 0.2:
            b = (r.choice(rows)[1] or "").split()
            t = " ".join(b[: len(b) // 2] + ["X"] + b[len(b) // 2 :])
        rows.append((k, t))
    same = "x " * 130
    rows += [(n, same), (n + 1, same + "y"), (n + 2, "p q " * 90), (n + 3, "q p " * 80), (n + 4, "a b c " * 70), (n + 5, "b c a " * 70)]
    rows += [(3, passages[0] * 2), (3, rows[3][1]), (None, passages[1]), (None, passages[1]), (n + 6, None), (n + 7, " \t\x0b"), (-4, passages[2] + " " + passages[3])]
    return rows


@pytest.mark.parametrize(("seed", "window", "piece", "rounds"), [(1, 50, 1 << 19, 6), (2, 50, 300, 6), (3, 7, 60, 6), (4, 20, 90, 2), (5, 50, 1 << 19, 12)])
def test_against_brute_force(spark, seed, window, piece, rounds, monkeypatch):
    monkeypatch.setattr(recompress, "PIECE", piece)
    monkeypatch.setattr(recompress, "BLOCK", 4 * piece)
    monkeypatch.setattr(recompress, "ROUNDS", rounds)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, lo int").repartition(5)
    got = Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in passage_report(docs, window=window).collect())
    assert got == brute(rows, window)


def test_equal_windows_have_equal_marks_at_equal_offsets():
    r = random.Random(7)
    for alphabet in (2, 5, 400):
        words = np.array([r.randrange(alphabet) for _ in range(4000)], np.uint64)
        inner = words[1000:1160].copy()
        words[3000:3160] = inner
        mark, place = window_marks(words)
        at = np.arange(len(mark))
        assert (place >= at).all() and (place < at + recompress.WINDOW).all()
        for k in range(111):
            assert mark[1000 + k] == mark[3000 + k] and place[1000 + k] - 1000 == place[3000 + k] - 3000


def test_rounds_keep_the_text():
    r = random.Random(8)
    words = np.array([r.randrange(3) for _ in range(500)], np.uint64)
    symbols, meaning = Symbols(words), {}
    for turn in range(5):
        symbols.compress_runs()
        symbols.compress_pairs(turn)
        for name, a, b in zip(symbols.names.tolist(), symbols.at[:-1], symbols.at[1:], strict=True):
            assert meaning.setdefault(name, words[a:b].tolist()) == words[a:b].tolist()
    assert symbols.at[0] == 0 and symbols.at[-1] == 500 and len(symbols.names) < 200


def test_spans_hold_every_window_once():
    r = random.Random(9)
    texts = [" ".join(str(r.randrange(9)) for _ in range(r.randint(0, 200))).encode() for _ in range(20)]
    _, owner, lo, n, _ = spans_of(texts)
    held = Counter((o, at + k) for o, at, m in zip(owner.tolist(), lo.tolist(), n.tolist(), strict=True) for k in range(m))
    assert held == Counter((o, k) for o, t in enumerate(texts) for k in range(len(t.split()) - 49))


def test_query_against_sql(spark, tmp_path):
    spark.createDataFrame(corpus(6), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = op12_recompression_dedup(spark, str(tmp_path))
    columns = sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(con.sql(recompress.OP12_SQL).select(*columns).fetchall())
    assert passage_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_copies_of_one_row(spark):
    text = " ".join(str(k) for k in range(300))
    docs = spark.createDataFrame([(5, text)] * 400 + [(6, text), (4, "x " + text[:400])], "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_removed, hashlib.md5(r.kept).hexdigest()[:6]) for r in passage_report(docs).collect())
    assert sorted((k[0], k[1], v) for k, v in got.items()) == [(4, 0, 1), (5, len(text[:400].split()[:-1]), 400), (6, 300, 1)]
