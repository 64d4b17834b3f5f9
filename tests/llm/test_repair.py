import random
from collections import Counter
from functools import cache

import duckdb
import pytest

from traitforge.llm import repair
from traitforge.llm.repair import cheapest, damage, join_chunks, op13_conversation_repair, repair_conversations


def plain(initials, faults):
    """Cheapest edits by plain recursion over all of them, of equal ones the first in ASCII."""

    @cache
    def best(i, state, inserted):
        found = []
        if i == len(initials) and state in (0, 3):
            found.append((0, ""))
        if inserted < 3:
            cost, rest = best(i, (2, 2, 3, 2)[state], inserted + 1)
            found.append((cost + 2, "I" + rest))
        if i < len(initials):
            cost, rest = best(i + 1, state, 0)
            found.append((cost + 3, "D" + rest))
            if faults[i] not in "bd":
                more = faults[i] == "t"
                to = {"0s": 1, "0u": 2, "1u": 2, "2a": 3, "3u": 2}.get(f"{state}{initials[i]}")
                if to:
                    cost, rest = best(i + 1, to, 0)
                    found.append((cost + more, "K" + rest))
                cost, rest = best(i + 1, (2, 2, 3, 2)[state], 0)
                found.append((cost + 2 + more, "R" + rest))
        return min(found, default=(10**6, ""))

    return best(0, 0, 0)


def lots(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        m = r.randint(0, 9)
        yield [r.choice("suuaaax") for _ in range(m)], "".join(r.choice("..tbd") for _ in range(m))


def test_search_finds_the_cheapest_edits():
    for initials, faults in lots(1, 3000):
        ((cost, edits),) = cheapest(initials, faults, 0, True).values()
        assert (cost, edits) == plain(tuple(initials), faults), (initials, faults)


def test_chunks_join_to_the_same_edits():
    r = random.Random(2)
    for initials, faults in lots(2, 1500):
        cuts = sorted(r.sample(range(len(initials) + 1), r.randint(0, min(3, len(initials)))))
        bounds = [0, *cuts, len(initials)]
        chunks = [[{"enter": s, "leave": to, "cost": c, "edits": e} for s in range(4) for to, (c, e) in cheapest(initials[a:b], faults[a:b], s, False).items()] for a, b in zip(bounds, bounds[1:], strict=False)]
        cost, steps = join_chunks(chunks)
        assert (cost, "".join(e for _, e in steps)) == plain(tuple(initials), faults)


def rows_of(seed, longest=6):
    r = random.Random(seed)
    text = lambda: r.choice(["yes.", "no", "Ünd!\n", " \t", "", None, "same?", "b. c", "long " * 50])
    role = lambda: r.choice(["user", "assistant", "assistant", "system", None, "", "tool"])
    return [(c if r.random() < 0.98 else None, r.choice([*range(8), None]), role(), text()) for c in range(60) for _ in range(r.randint(1, longest))] + [(7, 3, "user", "again.")] * 5


@pytest.mark.parametrize(("seed", "longest", "chunk"), [(1, 6, 256), (2, 30, 3), (3, 12, 1)])
def test_query_against_sql(spark, tmp_path, monkeypatch, seed, longest, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    spark.createDataFrame(rows_of(seed, longest), "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = op13_conversation_repair(spark, str(tmp_path))
    columns = sorted(got.columns)
    want = con.sql(repair.OP13_SQL).select(*columns).fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want)


def test_repaired_turns_alternate_and_other_columns_are_not_read(spark):
    turns = spark.createDataFrame([(*row, 1, "x") for row in rows_of(5)], "conv_id long, turn long, role string, text string, key int, edits string")
    found = repair_conversations(turns).collect()
    assert len(found) == len({row[0] for row in rows_of(5)})
    for row in found:
        roles = "".join(t.role[0] for t in row.turns)
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2)
        assert len(row.turns) == len(row.edits) - row.edits.count("D")
    assert repair_conversations(turns.limit(0)).count() == 0
    assert damage(turns.limit(0)).count() == 0


def test_one_conversation_of_very_many_turns(spark):
    n = 6000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 7 = 3 THEN 'x' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "CASE WHEN id % 3 = 0 THEN 'same.' ELSE concat(id, IF(id % 5 = 0, '', '.')) END AS text")
    (row,) = repair_conversations(turns.unionByName(turns.filter("turn = 1")).repartition(6)).collect()
    rows = turns.orderBy("turn").collect()
    seen, faults, initials = set(), "", []
    for r in rows:
        for copy in range(1 + (r.turn == 1)):
            faults += "d" if copy or (r.role, r.text) in seen else "." if r.text.endswith(".") else "t"
            seen.add((r.role, r.text))
            initials.append(r.role[0])
    ((cost, edits),) = cheapest(initials, faults, 0, True).values()
    assert (row.cost, row.edits) == (cost, edits)
    assert (row.gaps, row.duplicate, row.truncated) == (0, faults.count("d"), faults.count("t"))
