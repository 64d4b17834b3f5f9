import random
import zlib

import numpy as np
import pytest

import zstandard
from pyspark.sql import functions as F

from traitforge.llm import language, learning, toxicity
from traitforge.llm.decontaminate import words_of
from traitforge.llm.language import posteriors
from traitforge.llm.quality import Sizer, op5_compression_quality, score_quality
from traitforge.llm.toxicity import BlockMaxIndex, op10_tfidf_toxicity, score_toxicity

CRC = lambda i, n: zlib.crc32(str(i).encode()) % n


def prose(r, pool, n):
    return " ".join(r.choice(pool) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(4)
    syllables = {"en": ["the", "ing", "th", "and", "er", "on"], "fr": ["le", "eau", "tion", "é", "oi", "ment"], "de": ["der", "sch", "ung", "ß", "ein", "ch"]}
    pools = {k: ["".join(r.choice(v) for _ in range(r.randint(1, 3))) for _ in range(300)] for k, v in syllables.items()}
    docs, labels = [], []
    for i in range(600):
        lang = r.choice(list(pools))
        text, good, bad_words = prose(r, pools[lang], r.randint(20, 200)), r.random() < 0.7, r.random() < 0.3
        if not good:
            text = " | ".join(text.split())
        if bad_words:
            w = text.split(" ")
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["vile", "scoundrel", "wretch"]))
            text = " ".join(w)
        docs.append((i, text, lang if r.random() < 0.9 else None, "s"))
        labels.append((i, int(good), int(bad_words)))
    docs += [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "123 ... ½²", "fr", "s"), (None, "the and er", "en", "s"), (5, docs[5][1], docs[5][2], "s"), (1003, "le eau " * 60000, None, "s")]
    labels += [(5, labels[5][1], labels[5][2]), (None, 1, 1), (2000, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs, labels


def test_quality_held_out(spark, corpus):
    path, docs, labels = corpus
    rows = op5_compression_quality(spark, path).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (CRC(r.doc_id, 5) == 0) for r in rows if r.doc_id is not None)
    truth = {i: q for i, q, _ in labels if q is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.95


def test_quality_without_labels(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.limit(0), none).count() == 0


def test_toxicity_held_out_and_evidence(spark, corpus):
    path, docs, labels = corpus
    rows = op10_tfidf_toxicity(spark, path).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {i: t for i, _, t in labels if t is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for p, y in held]) > 0.97
    found = score_toxicity(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    marked = [r for r in found.collect() if r.evidence]
    assert {w for r in marked for w in r.evidence} <= {"vile", "scoundrel", "wretch"} and all(r.nearest for r in marked)
    assert {r.score for r in score_toxicity(spark.read.parquet(f"{path}/documents.parquet"), spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.0}


def test_block_max_search_is_exact():
    r = np.random.default_rng(2)
    vectors = []
    for _ in range(400):
        terms = r.choice(30, r.integers(1, 6), replace=False)
        w = r.random(len(terms)) + 0.1
        w /= np.linalg.norm(w)
        order = np.argsort(terms)
        vectors.append((terms[order], w[order]))
    plain = [dict(zip(t.tolist(), w.tolist(), strict=True)) for t, w in vectors]
    index = BlockMaxIndex(vectors, [str(i) for i in range(400)], [i % 2 for i in range(400)], 30)
    for i, q in enumerate(plain[:60]):
        cos = {str(j): round(sum(w * v.get(t, 0.0) for t, w in q.items()), 9) for j, v in enumerate(plain)}
        want = sorted((-c, k) for k, c in cos.items() if c > 0)
        best, cosines = index.nearest(vectors[i], toxicity.NEIGHBOURS)
        assert [(-c, index.keys[p]) for p, c in zip(best, cosines, strict=True)] == want[: toxicity.NEIGHBOURS]
        best, _ = index.nearest(vectors[i], toxicity.NEIGHBOURS, index.place[i])
        assert [index.keys[p] for p in best] == [k for _, k in want if k != str(i)][: toxicity.NEIGHBOURS]
    assert len(index.nearest((np.zeros(0, int), np.zeros(0)), 3)[0]) == 0


def test_toxicity_query_against_brute_force(spark, corpus, monkeypatch):
    """Scores from plain dictionaries: all cosines, sorted, and Newton's method for the calibration."""
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 2)
    path, docs, labels = corpus
    text = {i: t for i, t, *_ in docs if t is not None and i is not None}
    label = {i: t for i, _, t in labels if t is not None and i in text and CRC(i, 5)}
    split = {i: words_of(t.lower()) for i, t, *_ in docs if i is not None and t}
    unique = {}
    for i in sorted(label, key=lambda i: (label[i], str(i))):
        unique.setdefault(text[i] if len(text[i]) <= 16000 else i, i)
    sample = list(unique.values())
    vocabulary = {w for i in sample for w in split[i]}
    df = {w: sum(w in set(words_of((t or "").lower())) for _, t, *_ in docs) for w in vocabulary}
    sizes = [sum(label[i] == v for i in sample) for v in (0, 1)]

    def weight(w):
        seen = [sum(w in split[i] for i in sample if label[i] == v) for v in (0, 1)]
        error = ((sum(seen) + 1) / len(sample) * (1 / sizes[0] + 1 / sizes[1])) ** 0.5
        beyond = max(0.0, abs(seen[1] / sizes[1] - seen[0] / sizes[0]) / error - 5)
        return (np.log((1 + len(docs)) / (1 + df[w])) + 1) * (0.02 + beyond / (5 + beyond))

    weights = {w: weight(w) for w in vocabulary}

    def vector(found):
        v = {w: (1 + np.log(found.count(w))) * weights[w] for w in set(found) & vocabulary}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(split[i]) for i in sample}

    def vote(v, but=None):
        near = sorted((-round(sum(x * vectors[j].get(w, 0.0) for w, x in v.items()), 9), str(j), j) for j in sample if j != but)[:15]
        return sum(-c * (2 * label[j] - 1) for c, _, j in near if c) / 15

    x, y = np.array([vote(vectors[i], i) for i in sample]), np.array([label[i] for i in sample], float)
    counts = [sum(v == k for v in label.values()) for k in (0, 1)]
    share = np.where(y == 1, counts[1] / sizes[1], counts[0] / sizes[0])
    model = toxicity.logistic(x[:, None], y, share / share.mean(), ridge=1e-2)
    got = {r.doc_id: r.score for r in op10_tfidf_toxicity(spark, path).collect()}
    for i in [*list(split)[:150], 1003]:
        assert abs(got[i] - toxicity.probability(model, np.array([[vote(vector(split[i]))]]))[0]) < 1e-6, i
    assert abs(got[1000] - toxicity.probability(model, np.zeros((1, 1)))[0]) < 1e-6


def test_language_query_against_brute_force(spark, corpus):
    """Forward-backward one word after another, with each word's weights looked up on its own."""
    path, docs, _ = corpus
    model = language.learn_languages(spark.read.parquet(f"{path}/documents.parquet"))
    got = {r.doc_id: r for r in language.op8_crf_language(spark, path).collect()}
    for i, text, *_ in [*docs[:40], docs[600], docs[602]]:
        found = language.words(text)
        if not found:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        e = np.exp([model.table[language.word_features([w])[0]].sum(0).astype(float) for w in found])
        move, a, b = np.exp(model.step), [np.exp(model.start) * e[0]], [np.ones(len(model.languages))]
        for t in range(1, len(found)):
            a.append((a[-1] @ move) * e[t])
            a[-1] /= a[-1].sum()
            b.append(move @ (e[-t] * b[-1]))
            b[-1] /= b[-1].sum()
        p = np.array(a) * np.array(b[::-1])
        mean = (p / p.sum(1, keepdims=True)).mean(0)
        assert got[i].lang_pred == model.languages[int(mean.argmax())] and abs(got[i].score - mean.max()) < 1e-4, i


def test_sizes_against_plain_compression(spark, corpus):
    r = random.Random(8)
    good, bad = (("".join(r.choice(p) for _ in range(4000))).encode() for p in ("abcd ", "xyz|"))
    sizer = Sizer(good, bad)
    for text in ("", "abcd abcd", "x|y|z" * 3000, None):
        data = (text or "").encode()
        sizes = []
        for raw in (good, bad):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(1 + sum(len(c.compress(data[k : k + 2048])) for k in range(0, len(data), 2048)))
        a, b = sizes
        assert sizer.features(text) == ((b - a) / max(a, b), a / (len(data) + 1), b / (len(data) + 1))


def test_samples(spark, monkeypatch):
    """The lowest lots of each label, long texts in pieces, labels without a text left out."""
    monkeypatch.setattr(learning, "SAMPLE_CHARS", 40)
    rows = [(i, f"text {i}" if i % 3 else None, "ab"[i % 2]) for i in range(300)] + [(900, "x" * 30 + "y" * 30 + "z" * 30, "a"), (7, "one more", None), (None, "no id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found, total = learning.own_sample(docs, "lang", 4, 2, 20, 10)
    usable = [(i, t, v) for i, t, v in rows if v and t and CRC("" if i is None else i, 4) != 2]
    assert total == {v: sum(x == v for *_, x in usable) for v in "ab"}
    lots = {r.i: r.h & ((1 << 63) - 1) for r in spark.sql("SELECT i, xxhash64(coalesce(cast(i AS string), '')) AS h FROM (SELECT explode(sequence(0, 900)) AS i UNION ALL SELECT null)").collect()}
    for v in "ab":
        want = sorted((lots[i], "" if i is None else str(i)) for i, _, x in usable if x == v)[:20]
        assert sorted(key for label, key, _ in found if label == v) == sorted(key for _, key in want)
    assert all(t is not None and "one more" not in t for *_, t in found)
    assert learning.own_sample(docs, "lang", 4, 2, 20, 1)[1].keys() == {"b"}
    every, _ = learning.own_sample(docs, "lang", 4, 2, 1000, 10)
    assert {t for _, key, t in every if key == "900"} <= {"x" * 10 + "\n" + "x" * 4 + "y" * 6 + "\n" + "y" * 7 + "z" * 3 + "\n" + "z" * 10}
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, 1), (5, 0), (2000, 1)], "doc_id long, toxic int")
    found, total = learning.labelled_sample(docs, labels, "toxic", 5, 0, 1000)
    want = sorted((i % 2, str(i), "one more" if i == 7 else t) for i, t, _ in rows[:300] if t and CRC(i, 5))
    assert sorted(found) == want and total == {v: sum(w[0] == v for w in want) for v in (0, 1)}


def test_empty_tables_and_clashing_columns(spark, corpus):
    path = corpus[0]
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    more = docs.limit(40)
    for name in ("id", "label", "lot", "depth", "score", "held_out", "text_", "count", "predicted"):
        more = more.withColumn(name, F.lit("x"))
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert language.identify_language(docs.limit(0), language.learn_languages(docs.limit(0))).count() == 0
    assert score_quality(more, labels.withColumn("text", F.lit(1))).count() == 40
    assert score_toxicity(more, labels.withColumn("text", F.lit(1))).count() == 40
    assert language.identify_language(more, language.learn_languages(more)).count() == 40


def test_language_held_out(spark, corpus):
    path, docs, _ = corpus
    rows = language.op8_crf_language(spark, path).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "fr" and by[None].lang_pred == "en"
    truth = {i: lang for i, _, lang, _ in docs if lang and i is not None and i < 1000}
    held = [by[i].lang_pred == lang for i, lang in truth.items() if CRC(i, 4) == 2]
    assert len(held) > 80 and np.mean(held) > 0.97


def test_code_switched_words_get_their_own_labels(spark, corpus):
    model = language.learn_languages(spark.read.parquet(f"{corpus[0]}/documents.parquet"))
    means, n = model.label(["the and thing ering le eauoi mentoi tionle der schung einch ungder"])
    assert n[0] == 12 and means.max() < 0.75
    assert (model.step.diagonal() > np.where(np.eye(3, dtype=bool), -np.inf, model.step).max(1)).all()


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify_language(docs, language.learn_languages(docs)).collect()} == {"und"}
    one = spark.createDataFrame([(i, "abc def", "en") for i in range(6)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify_language(one, language.learn_languages(one)).collect()} == {"en"}


def test_forward_backward_against_plain_recursion():
    r = np.random.default_rng(1)
    k, lengths = 3, np.array([1, 200, 0, 64, 65, 7, 128])
    emission, start, step = r.normal(size=(lengths.sum(), k)), r.normal(size=k), r.normal(size=(k, k))
    want, at = [], 0
    for n in lengths[lengths > 0]:
        e, m = np.exp(emission[at : at + n]), np.exp(step)
        a, b = [np.exp(start) * e[0]], [np.ones(k)]
        for t in range(1, n):
            x = (a[-1] @ m) * e[t]
            a.append(x / x.sum())
        for t in range(n - 1, 0, -1):
            y = m @ (e[t] * b[0])
            b.insert(0, y / y.sum())
        p = np.array(a) * np.array(b)
        want.append(p / p.sum(1, keepdims=True))
        at += n
    assert np.allclose(posteriors(emission, lengths, start, step), np.concatenate(want), atol=1e-9)


def test_sample_of_one_id_or_none_is_bounded(spark, monkeypatch):
    """Rows of a null or repeated id are told apart by their texts, and only some thousand are fetched."""
    rows = spark.range(60_000).selectExpr("CAST(NULL AS long) AS doc_id", "concat('word ', id) AS text", "'a' AS lang").unionByName(spark.range(3000).selectExpr("5L AS doc_id", "'same text' AS text", "'b' AS lang"))
    fetched, first = [], learning._first
    monkeypatch.setattr(learning, "_first", lambda found, n: fetched.append(len(found)) or first(found, n))
    found, total = learning.own_sample(rows, "lang", 4, 9, 500)
    assert fetched[0] < 2000 and total == {"a": 60_000, "b": 1}
    assert len(found) == 501 and len({t for lang, _, t in found if lang == "a"}) == 500


def test_languages_share_the_sample(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('l', id % 300) AS lang")
    found, total = learning.own_sample(docs, "lang", 4, 9, 500, in_all=600, fewest=1)
    assert len(total) == 300 and len(found) == 600
    found, _ = learning.own_sample(docs, "lang", 4, 9, 500, in_all=10, fewest=3)
    assert len(found) == 900


def test_word_by_word_equals_blocks(monkeypatch):
    r = np.random.RandomState(0)
    emission, lengths, start, step = r.randn(300, 5), np.array([100, 1, 0, 70, 129]), r.randn(5), r.randn(5, 5)
    want = posteriors(emission.copy(), lengths, start, step)
    monkeypatch.setattr(language, "BLOCKWISE", 1)
    np.testing.assert_allclose(posteriors(emission.copy(), lengths, start, step), want, atol=1e-12)


def test_three_hundred_languages(monkeypatch):
    """All are learned and told apart, within some memory, and in a time that is not their cube."""
    import random
    import time

    monkeypatch.setattr(language, "STEPS", 25)
    r, names = random.Random(1), [f"l{i:03d}" for i in range(300)]
    parts = {n: ["".join(random.Random(f"{n}{j}").choices("abcdefghijklmnopqrstuvwxyzéöü", k=3)) for j in range(20)] for n in names}
    text = lambda n, m: " ".join("".join(r.choices(parts[n], k=2)) for _ in range(m))
    model = language.LanguageModel([(n, str(j), text(n, 200)) for n in names for j in range(6)], names)
    assert model.usable and model.table.size <= language.WEIGHTS
    some = names[::10]
    began = time.monotonic()
    means, _ = model.label([text(n, 500) for n in some])
    took = time.monotonic() - began
    assert np.mean([names[m.argmax()] == n for m, n in zip(means, some, strict=True)]) > 0.9
    assert took < 10, took
