import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from traitforge.llm import suffix_dedup
from traitforge.llm.suffix_dedup import previous_factors, previous_smaller, remove_repeats, repeat_report, window_keys


def brute(rows, length, keep="none"):
    """rows: (id, text); every byte covered by a string of ``length`` bytes that starts elsewhere."""
    bodies = [(t or "").encode() for _, t in rows]
    places = {}
    for k, b in enumerate(bodies):
        for i in range(len(b) - length + 1):
            places.setdefault(b[i : i + length], []).append((k, i))
    out = []
    for k, b in enumerate(bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            found = places[b[i : i + length]]
            if len(found) > 1 and (keep == "none" or any((rows[j][0], p) < (rows[k][0], i) for j, p in found)):
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((rows[k][0], len(b), sum(gone), runs, kept))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ti", "on", "é", "ing", "ß", "the"]) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(r.randint(20, 60)) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = text(r.randint(0, 150))
        if r.random() < 0.5:
            t = t[: len(t) // 2] + r.choice(passages) + t[len(t) // 2 :]
        if texts and r.random() < 0.2:
            t = r.choice(texts)
        if texts and r.random() < 0.2:
            b = r.choice(texts)
            t = b[: len(b) // 2] + "X" + b[len(b) // 2 :]
        texts.append(t)
    texts += ["ab" * 400, "ab" * 300 + "c", "", "x" * 199, "x" * 200, passages[0] * 3]
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "size"), [(1, 1_500_000), (2, 2000), (3, 300), (1, 300)])
def test_against_brute_force(spark, seed, size, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", size)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup, "SPAN", 90)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for keep in ("none", "first"):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeat_report(docs, keep=keep).collect())
        assert got == sorted(brute(rows, 200, keep)), keep


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats_inside_one_span(spark, keep):
    """Periodic texts whose windows share one anchor that no other text has, at the full ``PIECE``;
    the last two are copies of each other."""
    r = random.Random(5)
    prose = lambda k: " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(2, 9))) for _ in range(k))
    line = prose(20)[:169]
    texts = ["ab" * 400, "x" * 1000, line * 4, prose(60) + "-" * 260 + prose(60), prose(60) + "=" * 150 + prose(60), prose(20)[:100] + "again and " * 50, *["one line\n" * 90] * 2]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeat_report(docs, keep=keep).collect())
    assert got == sorted(brute(rows, 200, keep))


def test_nulls_repeats_and_other_columns(spark):
    long = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(None, long, "a", 1), (1, None, "b", None), (2, long, "c", 2), (2, long, "c", 2), (3, "short", None, 5)], "doc_id long, text string, n_removed string, n_chars int")
    got = Counter((r.doc_id, r.n_removed) for r in repeat_report(docs).collect())
    assert got == {(None, len(long)): 1, (1, 0): 1, (2, len(long)): 2, (3, 0): 1}
    kept = remove_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([(None, long, "a", 1), (1, None, "b", None), (2, "", "c", 0), (2, "", "c", 0), (3, "short", None, 5)], key=str)
    assert repeat_report(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeat_report(docs, keep="all")


def test_query_digest(spark, tmp_path):
    rows = corpus(9, 20)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in suffix_dedup.op3_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(kept).hexdigest() for i, *_, kept in brute(rows, 200)}


def test_texts_that_agree_in_a_weak_hash(spark):
    """Blocks in the pattern of the Thue-Morse sequence and its complement have equal polynomial
    hashes modulo 2^64 under any odd base, though no 200 bytes are shared."""
    low = "".join(chr(97 + (7 * k * k + k) % 26) for k in range(32))
    block = {b: chr(65 + b) + "-" * 31 + low for b in (0, 1)}
    sign = [bin(k).count("1") % 2 for k in range(64)]
    texts = ["".join(block[b] for b in sign), "".join(block[1 - b] for b in sign)]
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in repeat_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(i, len(t), n, s, k) for i, t in enumerate(texts) for n, k, s in [(got[i][0], got[i][1], 0)]] == [(i, n, removed, 0, kept) for i, n, removed, _, kept in brute(list(enumerate(texts)), 200)]


def test_previous_factors():
    r = random.Random(11)
    for _ in range(30):
        length = r.choice([8, 10, 20])
        data = np.frombuffer(bytes(r.choice(b"aab") for _ in range(r.randint(length, 200))), np.uint8)
        n = len(data) - length + 1
        keys, text = window_keys(data, np.arange(n), length), bytes(data)
        order, place = np.argsort(keys), np.array(r.sample(range(n), n))
        windows = [text[i : i + length] for i in order]
        assert windows == sorted(windows)
        lcp = [windows[i] == windows[i + 1] for i in range(n - 1)]
        assert (keys[order][1:] == keys[order][:-1]).tolist() == lcp
        got = np.zeros(n, int)
        got[order] = previous_factors(np.array(lcp, bool), place[order], length)
        assert got.tolist() == [length if any(text[j : j + length] == text[i : i + length] and place[j] < place[i] for j in range(n)) else 0 for i in range(n)]


def test_previous_smaller():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 200):
        values, begins = r.permutation(n), np.repeat(np.arange(0, n, 13), 13)[:n]
        want = [next((j for j in range(i - 1, begins[i] - 1, -1) if values[j] < values[i]), -1) for i in range(n)]
        assert previous_smaller(values, begins).tolist() == want


def test_repeated_rows_give_their_spans_once(spark, monkeypatch):
    """Of very many equal rows an anchor holds the first and the last occurrence, once each."""
    r = random.Random(11)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(120))
    docs = spark.createDataFrame([(5, text)] * 500 + [(6, text), (7, "else " + text[:300])], "doc_id long, text string").repartition(4)
    seen, texts = [], suffix_dedup._texts

    def counted(*args):
        found = texts(*args)
        seen.append(found.groupBy("anchor", "span", "rep").count().agg({"count": "max"}).first()[0])
        return found

    monkeypatch.setattr(suffix_dedup, "_texts", counted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Counter((x.doc_id, x.n_removed) for x in repeat_report(docs, keep="none").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(5, len(text)): 500, (6, len(text)): 1, (7, 300): 1} and max(seen) == 1
