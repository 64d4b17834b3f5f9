import hashlib
import random
import re
from collections import Counter

import pytest

from traitforge.llm import decontaminate
from traitforge.llm.decontaminate import find_contamination, op2_benchmark_decontamination, remove_contamination


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for key, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else []:
            wins.setdefault(tuple(w[i : i + n]), set()).add(key)
    sizes = {len(w) for w in wins}
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((key, len(w), len(hit), tuple(sorted(str(f) for f in found if f is not None))))
    return out


def corpus(seed):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(["a", "b", "ab", "é", "Ñ", "x1", "Ba"]) + r.choice(["", ".", ",", "\n"]) for _ in range(k))
    items = [(i, text(r.randint(0, 25))) for i in range(12)] + [(3, text(11)), (None, text(12)), (99, None), (100, "...")]
    docs = []
    for d in range(60):
        t = text(r.randint(0, 80))
        if r.random() < 0.6:
            i = r.choice(items)[1] or ""
            t = t[: len(t) // 2] + " " + i.upper().replace("É", "é") + " " + t[len(t) // 2 :]
        docs.append((d, t))
    return docs + [(None, "a b"), (7, None), (8, "")], items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("shard", [1 << 20, 25])
def test_against_brute_force(spark, seed, shard):
    docs, items = corpus(seed)
    d = spark.createDataFrame([(*x, "extra") for x in docs], "doc_id long, text string, n_words string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in find_contamination(d, b, shard_words=shard).collect())
    assert got == Counter(brute(docs, items))


def test_removal_keeps_clean_texts_and_drops_mostly_hit_ones(spark):
    item = "one two three four five six seven eight nine ten eleven"
    filler = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{filler}. ONE two, three four five six seven eight nine ten eleven; {filler}", 5, "z"), (2, item, 6, "z"), (3, filler, 7, None), (4, None, None, "z"), (4, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, hits string")
    out = remove_contamination(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert out.columns == docs.columns
    cut = f"{filler}. ; {filler}"
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, cut, len(cut), "z"), (3, filler, 7, None), (4, None, None, "z"), (4, None, None, "z")], key=str)
    again = remove_contamination(docs.withColumnsRenamed({"n_chars": "id", "hits": "items"}), spark.createDataFrame([(0, item), (1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w11"), (2, "not there")], "item_id long, text string"), shard_words=4)
    assert sorted((r.doc_id, r.text) for r in again.filter("text IS NOT NULL").collect()) == [(1, cut), (3, filler)] and again.columns[2:] == ["id", "items"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert remove_contamination(docs, empty).count() == 5 and remove_contamination(docs.limit(0), empty).count() == 0


def test_query_digest(spark, tmp_path):
    docs, items = corpus(5)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r.doc_id, r.n_items, r.items_sha256, r.contaminated) for r in op2_benchmark_decontamination(spark, str(tmp_path)).collect())
    assert got == Counter((k, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for k, _, h, f in brute(docs, items))


def test_very_long_texts_and_items(spark):
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, "w5 " * 9), (3, "x " * 200_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(977))), (2, "x x")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in find_contamination(docs, items).collect()}
    # The last, unfinished round of 977 words holds windows too.
    assert got == {1: (120_000, 120_000, ["1"]), 2: (9, 0, []), 3: (200_000, 200_000, ["2"])}


def test_automaton_memory():
    import sys

    r = random.Random(6)
    vocabulary = [f"word{i}".encode() for i in range(20_000)]
    items = [(str(i), [vocabulary[min(19_999, int(r.paretovariate(0.6)))] for _ in range(100)]) for i in range(500)]
    a = decontaminate.ItemAutomaton(items, 10)
    size = sum(c.itemsize * len(c) for c in (a.word, a.next, a.link, a.length)) + sys.getsizeof(a.more) + 64 * len(a.more) + sum(sys.getsizeof(w) + 104 for w in a.vocabulary) + a.owned.nbytes + a.owner.nbytes
    assert size / 50_000 < 250  # bytes a word, with a vocabulary that is large for so few words


def test_words_are_runs_of_letters_digits_and_other_scripts():
    assert decontaminate.words_of("A-b_c1 É日本[x]{y}") == [b"a", b"b", b"c1", "É日本".encode(), b"x", b"y"]
