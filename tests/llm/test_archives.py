import random
from collections import Counter

import duckdb
import pytest

from traitforge.llm import fixity, preference
from traitforge.llm.fixity import audit, op1_merkle_fixity
from traitforge.llm.preference import format_preferences, gather_turns, op4_preference_pairs


def recs(spark, rows):
    return spark.createDataFrame(rows, "file string, offset long, length long, digest string")


def test_audit_finds_exactly_the_damage(spark):
    r = random.Random(3)
    rows = []
    for f in ("a", "b", "c"):
        at = 0
        for _ in range(400):
            n = r.randint(150, 40000)
            rows.append((f, at, n, f"{r.random()}"))
            at += n
    other, want = [], Counter()
    for row in rows:
        lot = r.random()
        if row[0] != "c" and lot < 0.01:
            want[(row[0], row[1], "missing")] += 1
        elif row[0] != "c" and lot < 0.02:
            other.append((*row[:3], "bad"))
            want[(row[0], row[1], "corrupt")] += 1
        else:
            other.append(row)
    other.append(("d", 0, 5, "new"))
    want[("d", 0, "extra")] += 1
    assert Counter(map(tuple, audit(recs(spark, rows), recs(spark, other)).collect())) == want
    assert audit(recs(spark, rows), recs(spark, rows).repartition(7)).count() == 0
    assert audit(recs(spark, []), recs(spark, [])).count() == 0


def test_roots_differ_only_for_damaged_files(spark):
    one = recs(spark, [("a", 0, 10, "x"), ("a", 10, 5, "y"), ("b", 0, 1, "z")])
    two = recs(spark, [("a", 0, 10, "x"), ("a", 10, 5, "Y"), ("b", 0, 1, "z")])
    roots = [dict((r.file, r.digest) for r in fixity.tree(t)[-1].collect()) for t in (one, two)]
    assert roots[0]["b"] == roots[1]["b"] and roots[0]["a"] != roots[1]["a"]


def sql(path, text, table):
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    return con.sql(text)


def test_query_with_nulls_and_repeats(spark, tmp_path):
    rows = [(i % 900 if i % 50 else None, f"u{i}" if i % 7 else None, f"<p>{i}</p>" * (i % 5) if i % 11 else None, "x") for i in range(3000)] + [(5, "u", "same", "x")] * 3
    spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = op1_merkle_fixity(spark, str(tmp_path))
    want = sql(tmp_path, fixity.OP1_SQL, "pages")
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.select(*[f'"{c}"' for c in columns]).fetchall())


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_prompt_is_rendered_once_and_masks_cover_assistant_text(spark):
    a = turns(spark, [(1, 1, "assistant", "hi"), (1, 0, "user", "yo"), (1, 2, "user", "so?"), (1, 3, "assistant", "good"), (2, 0, "user", "only"), (None, 0, "user", "lost")])
    b = turns(spark, [(1, 0, "user", "yo"), (1, 1, "assistant", "hi"), (1, 2, "user", "so?"), (1, 3, "assistant", "bad!"), (1, 4, "user", "x"), (3, 0, "user", "alone")])
    (row,) = format_preferences(gather_turns(a, "conv_id", "chosen"), gather_turns(b, "conv_id", "rejected"), "conv_id").collect()
    assert (row.prompt_turns, row.chosen_turns, row.rejected_turns) == (3, 1, 2)
    assert row.prompt == "<|im_start|>user\nyo<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user\nso?<|im_end|>\n"
    for text, spans, want in ((row.chosen, row.chosen_trained, ["good<|im_end|>\n"]), (row.rejected, row.rejected_trained, ["bad!<|im_end|>\n"])):
        assert [text[int(s.split("-")[0]) : int(s.split("-")[1])] for s in spans.split(",")] == want


def test_equal_and_prefix_conversations(spark):
    a = turns(spark, [(1, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, "assistant", None)])
    b = turns(spark, [(1, 0, "user", "x"), (2, 0, "user", "x")])
    got = {r.conv_id: r for r in format_preferences(gather_turns(a, "conv_id", "chosen"), gather_turns(b, "conv_id", "rejected"), "conv_id").collect()}
    assert (got[1].prompt_turns, got[1].chosen, got[1].rejected, got[1].chosen_trained) == (1, "", "", "")
    assert (got[2].chosen_turns, got[2].rejected) == (1, "")


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_sql(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(c if r.random() < 0.97 else None, r.choice([0, 1, 2, 3, None]), r.choice(["user", "assistant", "system", None]), r.choice(["a", "bé", None, "", "long text"])) for c in range(40) for _ in range(r.randint(0, 6))]
    turns(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op4_preference_pairs(spark, str(tmp_path))
    want = sql(tmp_path, preference.OP4_SQL, "conversations")
    columns = sorted(got.columns)
    assert Counter(tuple(x[c] for c in columns) for x in got.collect()) == Counter(want.select(*columns).fetchall())


def test_preferences_of_long_turns_empty_tables_and_clashing_columns(spark):
    long = "wörd " * 200_000
    rows = [(1, 0, "user", "hi", "x", 1), (1, 1, "assistant", long, "x", 1), (None, 0, "user", "lost", "x", 1)]
    schema = "conv_id long, turn long, role string, text string, chosen string, n int"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([rows[0], (1, 1, "assistant", "no", "y", 2)], schema)
    pair = lambda x, y: format_preferences(gather_turns(x, "conv_id", "chosen"), gather_turns(y, "conv_id", "rejected"), "conv_id")
    (row,) = pair(a, b).collect()
    start, end = map(int, row.chosen_trained.split("-"))
    assert row.prompt_turns == 1 and row.chosen[start:end] == long + "<|im_end|>\n"
    assert pair(a.limit(0), b).count() == pair(a, b.limit(0)).count() == pair(a.limit(0), b.limit(0)).count() == 0


def test_fixity_of_long_pages_and_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "<p>" + "x" * 2_000_000, "f", 0, "d"), (2, "v", "", "f", 1, "e"), (2, "v", "", "f", 1, "e"), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, file string, offset long, digest string").write.parquet(f"{tmp_path}/pages.parquet")
    got = op1_merkle_fixity(spark, str(tmp_path))
    want = sql(tmp_path, fixity.OP1_SQL, "pages")
    columns = sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.select(*[f'"{c}"' for c in columns]).fetchall())
