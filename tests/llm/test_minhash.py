import random
import re
from collections import Counter

import numpy as np
import pytest

from traitforge.llm import minhash
from traitforge.operators.graph import components
from traitforge.llm.minhash import CHUNKS, DISTANCE, HASHES, NearDuplicates, chunk_keys, op9_minhash_hamming_join


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width=4):
    s = [sets(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(s[k]), c := (least.get(find(k)) if s[k] else i), i == c) for k, (i, _) in enumerate(rows))


def corpus(seed, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ti", "on", "é", "Ing", "ß", "the"]) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    texts = []
    for _ in range(n):
        t = text(r.randint(0, 120))
        if texts and r.random() < 0.5:
            words = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = word()
            t = r.choice([" ", "\t", "  "]).join(words)
        texts.append(t)
    base = text(200).split(" ")
    for _ in range(60):  # one large group of near copies
        words = list(base)
        for _ in range(r.randint(0, 12)):
            words[r.randrange(200)] = word()
        texts.append(" ".join(words))
    texts += ["a b c", "A  b c", "a b c d", "", " \n", "one", "one", "x\x1cy z w v", "é" * 3000]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 8), (3, 3)])
def test_against_brute_force(spark, seed, block, monkeypatch, tmp_path):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PIECE", 4000)
    rows = corpus(seed)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in op9_minhash_hamming_join(spark, str(tmp_path)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute(rows)


def test_nulls_repeats_and_other_columns(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None), (8, "q w e r t y u"), (None, "lonely text stands here all alone"), (3, "A B C D E F")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").withColumn("cls", minhash.F.lit(1))
    rows = NearDuplicates(docs, width=4).groups().collect()
    assert sum(r.leader for r in rows) == 4
    got = Counter((r.id, r.component, r.kept) for r in rows)
    assert got == {(None, 3, False): 1, (7, 3, False): 2, (3, 3, True): 1, (8, 8, True): 2, (None, None, True): 1}
    assert NearDuplicates(docs.limit(0)).groups().count() == 0


def test_every_pair_within_the_distance_shares_a_key():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 16, (3000, HASHES), dtype=np.uint16)
    b = a.copy()
    for k in range(len(b)):
        at = r.choice(HASHES, DISTANCE, replace=False)
        b[k, at] ^= r.integers(1, 1 << 16, DISTANCE, dtype=np.uint16)
    assert DISTANCE // CHUNKS == 1
    assert (chunk_keys(a) == chunk_keys(b)).any(1).all()


def test_components_of_chain_star_and_ring(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201 + i) for i in range(50)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)] + [(400, 400)]
    got = dict(components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {**{i: 0 for i in range(101)}, **{i: 200 for i in range(200, 251)}, **{i: 300 for i in range(300, 309)}}


def test_texts_that_agree_in_a_weak_hash(spark):
    """Words in the pattern of the Thue-Morse sequence and its complement agree in any polynomial
    hash modulo 2^64 with an odd base; they are different words."""
    sign = [bin(k).count("1") % 2 for k in range(2048)]
    rows = [(1, "".join("ab"[b] for b in sign)), (2, "".join("ba"[b] for b in sign)), (3, "A" + "".join("ab"[b] for b in sign)[1:])]
    got = {r.id: r.component for r in NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).groups().collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_full_sets_are_told_by_both_halves_of_a_name():
    x = np.array([(1, 1), (2, 5), (7, 7)], np.uint64)
    y = np.array([(1, 1), (2, 6), (7, 7)], np.uint64)
    assert minhash.common_names(x, y) == 2
    assert minhash.common_names(x, x) == 3
