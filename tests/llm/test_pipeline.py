import random

import test_decontaminate
import test_minhash
import test_suffix_dedup
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from traitforge.llm.bpe import tokenizer_path
from traitforge.llm.decontaminate import cut_words
from traitforge.llm.language import UNKNOWN, _predicted, learn_languages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(seed):
    r = random.Random(seed)
    pools = {k: ["".join(r.choice(v) for _ in range(r.randint(2, 3))) for _ in range(400)] for k, v in {"en": ["the", "ing", "er", "on"], "fr": ["eau", "tion", "é", "oi"]}.items()}
    text = lambda lang, n: " ".join(r.choice(pools[lang]) for _ in range(n))
    items = [(i, text("en", 14)) for i in range(4)]
    passage = text("en", 60)
    docs = []
    for i in range(120):
        lang = r.choice(["en", "fr"])
        t = text(lang, r.randint(5, 120))
        lot = r.random()
        if docs and lot < 0.15:
            t = docs[r.randrange(len(docs))][1] or ""
            t = t + " end" if r.random() < 0.5 else t
        elif lot < 0.25:
            t = f"{t} {passage} {text(lang, 9)}"
        elif lot < 0.35:
            t = f"{t} {r.choice(items)[1]} {text(lang, 9)}"
        docs.append((i, t, lang, "s", len(t)))
    docs += [(200, None, "en", "s", None), (201, "12 34", "en", "s", 5), (202, "", None, None, 0), (203, passage, "en", "s", len(passage)), (204, items[0][1], "en", "s", 5)]
    return docs, items


def test_run_against_brute_force(spark, tmp_path):
    docs, items = corpus(2)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = learn_languages(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    names, scores, _ = _predicted(model, [t for _, t, *_ in docs])
    rows = [(d[0], d[1]) for d, n, s in zip(docs, names, scores, strict=True) if n != UNKNOWN and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert {200, 201, 202}.isdisjoint(i for i, _ in rows) and len(rows) == len(docs) - 3
    kept = {i for i, _, component, k in test_minhash.brute(rows, 5) if k}
    rows = [r for r in rows if r[0] in kept]
    rows = [(i, b.decode("utf-8", "ignore")) for i, *_, b in test_suffix_dedup.brute(rows, 200, "first")]
    rows = [r for r in rows if r[1].strip()]
    final = []
    for (i, t), (_, n, hit, _) in zip(rows, test_decontaminate.brute(rows, items), strict=True):
        if hit <= 0.5 * n:
            final.append((i, t if not hit else cut_words(t, hit_ranges(t, items))))
    library = Tokenizer.from_file(tokenizer_path())
    want = {i: " ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for i, t in final}
    got = {r.doc_id: r.ids for r in __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()}
    assert got == want and 204 not in got


def hit_ranges(text, items):
    words, hit = test_decontaminate.words(text), set()
    for _, item in items:
        w = test_decontaminate.words(item)
        for k in range(len(w) - 9):
            hit |= {j + x for j in range(len(words) - 9) if words[j : j + 10] == w[k : k + 10] for x in range(10)}
    runs = []
    for p in sorted(hit):
        if runs and runs[-1][1] == p:
            runs[-1][1] = p + 1
        else:
            runs.append([p, p + 1])
    return [tuple(x) for x in runs]


def test_gibberish_goes_and_clean_documents_stay(spark):
    r = random.Random(7)
    syllables = {"en": ["the", "ing", "er", "on"], "fr": ["eau", "tion", "é", "oi"], "de": ["sch", "ung", "ß", "ein"], "es": ["ción", "os", "ñ", "ar"]}
    pools = {k: ["".join(r.choice(v) for _ in range(r.randint(2, 3))) for _ in range(400)] for k, v in syllables.items()}
    rows = [(i, " ".join(r.choice(pools[lang]) for _ in range(r.randint(3, 60))), lang) for i in range(400) for lang in [r.choice(list(pools))]]
    rows += [(1000 + i, " ".join("".join(r.choice("qxzjkvwbpf") for _ in range(r.randint(3, 8))) for _ in range(60)), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert kept >= set(range(400)) and len(kept) <= 404


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    _, items = corpus(1)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS and docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_clashing_columns_white_space_and_very_long_texts(spark, tmp_path):
    """Columns named like the stages' own pass through; what leaves only line breaks goes."""
    passage = " ".join(f"the{k}" for k in range(60))
    long = " ".join(f"the ing{k % 5003} on" for k in range(60_000))
    rows = [(1, passage, "en"), (2, f"\n{passage}\n\n", "en"), (3, long, "en"), (4, "er on the " * 5, "fr"), (5, "er on", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": corpus_pipeline.F.lit("s"), "n_chars": corpus_pipeline.F.length("text")})
    for name in ("id", "print", "body", "hits", "items", "spans", "ranges", "rid", "mark", "absent", "c0", "component", "leader", "key", "lot", "label"):
        docs = docs.withColumn(name, corpus_pipeline.F.lit("x"))
    spark.createDataFrame([(1, "not there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_repeated_passages(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    assert {1, 3} <= {r.doc_id for r in at.collect()}


def test_repeated_rows_of_a_group_leave_one(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en", "s", 1)] * 3 + [(0, "A b c d e f g", "en", "s", 1), (5, None, None, None, None), (5, None, None, None, None), (None, "x y z", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect() if r.text) == [("0", "A b c d e f g"), ("None", "x y z")]
    again = corpus_pipeline.drop_near_duplicates(spark, docs.filter("doc_id = 1"), "").collect()
    assert len(again) == 1
