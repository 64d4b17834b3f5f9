"""Repair of conversations: the cheapest edits after which turns alternate as they should.

Wanted are no turns at all, or an optional system turn and then user and assistant turns in turn.
Each turn has at most one fault, the first that holds: ``blank`` (white space only), ``duplicate``
(role and text stood earlier in the conversation), ``truncated`` (the last character that is no
white space does not end a sentence). Edits: keep a turn (K, 0), give it the role that is due
(R, 2), delete it (D, 3; required for blank and duplicate ones), insert an empty turn of the role
that is due (I, 2); a truncated turn that stays costs 1 more. Of the cheapest edits the ones whose
initials come first in ASCII are taken.

The edit lattice has a node for each number of turns consumed and each of four states of the
wanted pattern. A* searches it, keyed by (cost so far plus heuristic, edits so far). The heuristic
is a suffix sum: 3 for each turn ahead that must go, 1 for each truncated one, which costs that
whether it stays or goes. It never falls by more than an edit costs, so the first path to reach a
node is its cheapest, and of the cheapest the first in ASCII.

Turns are dealt out by ranges of (conversation, order), so a conversation of any length is shared
between tasks and cut every ``CHUNK`` turns (or ``CHUNK_BYTES`` of text). A conversation that lies in one
chunk is searched from start to end. Of a longer one each chunk is searched from each state to each
state, and the chunks' best paths, some bytes a turn, are put together in order. Repeated turns are
counted before they are dealt out.

Defined results: turns stand in order of their number, nulls first, then of role and text; null
roles and texts are one space; a null conversation id is a conversation; a role counts by its first
letter (s, u, a), any other is illegal; repeated rows are duplicates; very long texts are used
whole; a conversation without turns left has no edits; an empty table stays empty; other columns,
whatever their names, are not read. One conversation's edits and its repaired turns are one value,
as long as the conversation.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC_SQL, materialize, small_batches, table

#: Turns and bytes of text of one conversation that are searched at once.
CHUNK, CHUNK_BYTES = 256, 8 << 20

BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "."
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
BEGUN, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (BEGUN, ASSISTANT)
#: The state after keeping a turn of this initial.
KEPT = {(BEGUN, "s"): SYSTEM, (BEGUN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a turn of the role that is due, and that role.
DUE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
RELABEL, DELETE, INSERT, CHARGE = 2, 3, 2, 1


def cheapest(initials: list[str], faults: str, start: int, final: bool) -> dict[int, tuple[int, str]]:
    """For each state in which the turns can be left, the cost and initials of the best edits that
    begin in ``start``. If ``final``, the best way to an allowed end only, insertions after the last
    turn included; otherwise these are left to what follows."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if faults[i] in (BLANK, DUPLICATE) else CHARGE if faults[i] == TRUNCATED else 0)
    heap, closed, found = [(ahead[0], "", 0, start)], set(), {}
    while heap:
        bound, edits, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n:
            if not final or state in ENDS:
                found[state] = (bound, edits)
                if final:
                    break
            if not final:
                continue
        due = DUE[state]
        heapq.heappush(heap, (bound + INSERT, edits + "I", i, due))
        if i < n:
            charge = ahead[i] - ahead[i + 1]
            heapq.heappush(heap, (bound + DELETE - charge, edits + "D", i + 1, state))
            if faults[i] not in (BLANK, DUPLICATE):
                to = KEPT.get((state, initials[i]))
                if to is not None:
                    heapq.heappush(heap, (bound, edits + "K", i + 1, to))
                heapq.heappush(heap, (bound + RELABEL, edits + "R", i + 1, due))
    return found


def apply_edits(edits: str, start: int, roles: list[str], texts: list[str | None]) -> list[dict]:
    """The turns that ``edits`` leave."""
    out, i, state = [], 0, start
    for e in edits:
        if e == "K":
            out.append({"role": roles[i], "text": texts[i]})
            state = KEPT[state, roles[i][:1]]
        elif e in "RI":
            state = DUE[state]
            out.append({"role": ROLE[state], "text": texts[i] if e == "R" else ""})
        i += e != "I"
    return out


def join_chunks(chunks: list[list[dict]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the best edits of a conversation and, for each of its chunks, the state in which it is
    entered and its edits. ``chunks`` holds for each of them ways (enter, leave, cost, edits).

    Of two ways of equal cost to one state neither begins with the other, since the rest of the
    longer one would be insertions that lead nowhere; so the first in ASCII stays first."""
    best: dict[int, tuple] = {BEGUN: (0, None)}  # state: (cost, (before, enter, edits))
    for ways in chunks:
        after: dict[int, tuple] = {}
        for way in ways:
            if way["enter"] in best:
                cost, path = best[way["enter"]]
                new, old = (cost + way["cost"], (path, way["enter"], way["edits"])), after.get(way["leave"])
                if old is None or new[0] < old[0] or new[0] == old[0] and _before(new[1], old[1]):
                    after[way["leave"]] = new
        best = after
    last = None
    for state, (cost, path) in best.items():
        closing = cheapest([], "", state, True)
        for more, edits in closing.values():
            new = (cost + more, (path, state, edits))
            if last is None or new[0] < last[0] or new[0] == last[0] and _before(new[1], last[1]):
                last = new
    cost, path = last
    steps = []
    while path is not None:
        steps.append(path[1:])
        path = path[0]
    return cost, steps[::-1]


def _before(a: tuple | None, b: tuple | None) -> bool:
    """Whether path ``a`` comes before ``b``, of as many steps, in ASCII."""
    ours, theirs = [], []
    while a is not b:
        ours.append(a[2])
        theirs.append(b[2])
        a, b = a[0], b[0]
    return "".join(ours[::-1]) < "".join(theirs[::-1])


_TURNS = "array<struct<role:string,text:string>>"
_WAYS = "array<struct<enter:int,leave:int,cost:long,edits:string>>"
_PIECE = f"p int, c int, initial string, final string, illegal long, cost long, edits string, turns {_TURNS}, ways {_WAYS}, roles array<string>, texts array<string>"


def turn_faults(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, turn, role, text, copies, first): different turns with their number, and the fault of the
    first copy; further copies are blank like it, or else duplicates."""
    rows = turns.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    rows = rows.groupBy("key", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    said = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), 1, 16)
    rows = rows.withColumn("said", said)
    begun = rows.groupBy("key", "said").agg(F.min(F.struct("turn")).alias("begun")).withColumnsRenamed({"key": "_key", "said": "_said"})
    rows = rows.join(begun, F.col("key").eqNullSafe(F.col("_key")) & (F.col("said") == F.col("_said")))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(~F.col("begun")["turn"].eqNullSafe(F.col("turn")), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(SOUND)
    )
    return rows.select("key", "turn", "role", "text", "copies", fault.alias("first"))


def _pieces(faults: DataFrame) -> DataFrame:
    """A row for each chunk of a conversation; ``ways`` is null for those searched whole."""
    key = faults.schema["key"]
    schema = T.StructType([key, *T._parse_datatype_string(_PIECE).fields])
    kind = pa.schema([pa.field("key", _arrow_type(key.dataType)), *_arrow_fields()])
    chunk, chunk_bytes = CHUNK, CHUNK_BYTES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, c, out, weight = TaskContext.get().partitionId(), 0, [], 0
        current, held, size, edge = None, [], 0, True

        def close(whole: bool) -> None:
            nonlocal c, held, size, weight
            weight += size
            out.append(_searched(current, p, c, held, whole))
            c, held, size = c + 1, [], 0

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal out, weight
            yield pa.RecordBatch.from_pylist(out, schema=kind)
            out, weight = [], 0

        started = False
        for batch in batches:
            for at, role, text, copies, first in zip(*(batch.column(k).to_pylist() for k in ("key", "role", "text", "copies", "first")), strict=True):
                if not started:
                    current, started = at, True
                elif at != current:
                    # A range's first conversation may have begun in the one before.
                    close(whole=not edge)
                    current, edge = at, False
                for copy in range(copies):
                    if len(held) >= chunk or size >= chunk_bytes:
                        close(whole=False)
                        edge = True
                        if weight >= chunk_bytes or len(out) >= 1000:
                            yield from ready()
                    fault = first if copy == 0 or first == BLANK else DUPLICATE
                    kept = None if fault in (BLANK, DUPLICATE) else text
                    held.append((role, kept, fault))
                    size += len(kept or "")
                if weight >= chunk_bytes or len(out) >= 1000:
                    yield from ready()
        if started:
            close(whole=False)
            yield from ready()

    dealt = faults.repartitionByRange("key", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("key", "turn", "role", "text")
    return dealt.select("key", "role", "text", "copies", "first").mapInArrow(search, schema)


def _searched(key: object, p: int, c: int, held: list[tuple], whole: bool) -> dict:
    roles, texts, faults = [h[0] for h in held], [h[1] for h in held], "".join(h[2] for h in held)
    initials = [r[:1] for r in roles]
    row = {"key": key, "p": p, "c": c, "initial": initials[0], "final": initials[-1], "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))}
    if whole:
        ((cost, edits),) = cheapest(initials, faults, BEGUN, True).values()
        return row | {"cost": cost, "edits": edits, "turns": apply_edits(edits, BEGUN, roles, texts)}
    ways = [{"enter": s, "leave": to, "cost": cost, "edits": edits} for s in range(4) for to, (cost, edits) in cheapest(initials, faults, s, False).items()]
    return row | {"ways": ways, "roles": roles, "texts": texts}


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _arrow_fields() -> list[pa.Field]:
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    ways = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
    kinds = {"p": pa.int32(), "c": pa.int32(), "initial": pa.string(), "final": pa.string(), "illegal": pa.int64(), "cost": pa.int64(), "edits": pa.string(), "turns": turns, "ways": ways, "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}
    return [pa.field(name, kind) for name, kind in kinds.items()]


def _joined(pieces: DataFrame) -> DataFrame:
    """(key, illegal, cost, edits, turns) of conversations that lie in several chunks."""
    key = pieces.schema["key"]
    schema = T.StructType([key, *T._parse_datatype_string("p int, c int, start int, edits string, cost long, illegal long").fields])

    def choose(group):
        group = group.sort_values(["p", "c"])
        cost, steps = join_chunks([list(w) for w in group["ways"]])
        between = sum(a + b not in LEGAL for a, b in zip(group["final"].iloc[:-1], group["initial"].iloc[1:], strict=True))
        # What is inserted after the last turn is a step of its own, put to the last chunk.
        starts, edits = [s for s, _ in steps[:-1]], [e for _, e in steps[:-1]]
        edits[-1] += steps[-1][1]
        out = group[["key", "p", "c"]].assign(start=starts, edits=edits, cost=0, illegal=group["illegal"])
        out.iloc[0, out.columns.get_loc("cost")] = cost
        out.iloc[0, out.columns.get_loc("illegal")] += between
        return out

    slim = pieces.select("key", "p", "c", "initial", "final", "illegal", "ways")
    chosen = slim.groupBy("key").applyInPandas(choose, schema).drop("key")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [apply_edits(*r) for r in zip(*(batch.column(k).to_pylist() for k in ("edits", "start", "roles", "texts")), strict=True)]
            turns = pa.array(rows, _arrow_fields()[7].type)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("key", "p", "c", "illegal", "cost", "edits")), turns], names=["key", "p", "c", "illegal", "cost", "edits", "turns"])

    done = pieces.select("key", "p", "c", "roles", "texts").join(chosen, ["p", "c"])
    shape = T.StructType([key, *T._parse_datatype_string(f"p int, c int, illegal long, cost long, edits string, turns {_TURNS}").fields])
    done = done.mapInArrow(edited, shape)
    parts = F.sort_array(F.collect_list(F.struct("p", "c", "edits", "turns")))
    whole = done.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), parts.alias("parts"))
    return whole.select("key", "illegal", "cost", F.array_join("parts.edits", "").alias("edits"), F.flatten("parts.turns").alias("turns"))


def repair_conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: ``key``, ``gaps`` (turn numbers missing between the least and
    the greatest), ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbouring turns that may
    not follow each other), ``cost``, ``edits`` (initials) and the repaired ``turns``."""
    small_batches(turns.sparkSession)
    faults = materialize(turn_faults(turns, key, turn, role, text), "turn-faults")
    count = lambda held: F.sum(held).alias
    blank = F.when(F.col("first") == BLANK, F.col("copies")).otherwise(0)
    again = F.when(F.col("first") == BLANK, 0).when(F.col("first") == DUPLICATE, F.col("copies")).otherwise(F.col("copies") - 1)
    by_turn = faults.groupBy("key", "turn").agg(count(blank)("blank"), count(again)("duplicate"), count(F.when(F.col("first") == TRUNCATED, 1).otherwise(0))("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    stats = by_turn.groupBy("key").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    pieces = materialize(_pieces(faults), "pieces")
    found = pieces.filter("ways IS NULL").select("key", "illegal", "cost", "edits", "turns").unionByName(_joined(pieces.filter("ways IS NOT NULL"))).withColumnRenamed("key", "_key")
    joined = stats.join(found, F.col("key").eqNullSafe(F.col("_key")))
    return joined.select(F.col("key").alias(key), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "edits", "turns")


def damage(turns: DataFrame) -> DataFrame:
    """A drill: ``turns`` (conv_id, turn, role, text) damaged as crc32 of ``conv_id:turn`` says."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    lot = F.crc32(named.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    hurt = turns.select(
        "conv_id",
        "turn",
        F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1))),
    )
    return hurt.drop("col")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair_conversations(damage(turns)).withColumnRenamed("conv_id", "_id")
    joined = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return joined.select("conv_id", *counts, F.coalesce("edits", F.lit("")).alias("audit"), F.sha2(F.coalesce(lines, F.lit("")).cast("binary"), 256).alias("repaired_sha256"))


OP13_SQL = (
    r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named FROM conversations),
hashed AS (SELECT DISTINCT named AS f, hex(encode(named)) AS x, octet_length(encode(named)) AS n FROM src),
longest AS (SELECT max(n) AS n FROM hashed),
"""
    + CRC_SQL
    + r"""
lot AS (SELECT f AS named, crc % 20 AS lot FROM crc),
hurt AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, lot
  FROM src JOIN lot USING (named)),
damaged AS (SELECT k, turn, role, text FROM hurt WHERE lot <> 0 UNION ALL SELECT k, turn, role, text FROM hurt WHERE lot = 3),
placed AS (
  SELECT k, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
fault AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '.' END AS fault,
    lag(initial) OVER (PARTITION BY k ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
stat AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n
  FROM fault GROUP BY k),
due AS (SELECT * FROM (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (2, 1, 3), (3, 1, 2), (0, 2, 3), (1, 2, 3), (2, 2, 2), (3, 2, 3)) v(q, inserted, q2)),
move AS (
  SELECT * FROM (VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2),
    (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3)) v(q2, edit, wanted, q3)),
step AS (
  SELECT k, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': CAST(0 AS BIGINT), 'edits': ''} AS best FROM stat
  UNION ALL
  SELECT s.k, s.i + 1, m.q3, min({'cost': s.best.cost + 2 * d.inserted + CASE m.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN f.fault = 't' AND m.edit <> 'D' THEN 1 ELSE 0 END,
    'edits': s.best.edits || repeat('I', d.inserted) || m.edit})
  FROM step s JOIN due d USING (q) JOIN fault f ON f.k = s.k AND f.i = s.i + 1 JOIN move m ON m.q2 = d.q2 AND (m.edit = 'D' OR f.fault NOT IN ('b', 'd') AND coalesce(m.wanted = f.initial, true))
  GROUP BY s.k, s.i, m.q3),
done AS (
  SELECT s.k, min({'cost': s.best.cost + 2 * d.inserted, 'edits': s.best.edits || repeat('I', d.inserted)}) AS best
  FROM step s JOIN stat t ON t.k = s.k AND t.n = s.i JOIN due d ON d.q = s.q AND d.q2 IN (0, 3) GROUP BY s.k),
edit AS (SELECT k, e, p, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER w AS nth
  FROM (SELECT k, unnest(string_split(best.edits, '')) AS e, unnest(range(length(best.edits))) AS p FROM done WHERE best.edits <> '') WINDOW w AS (PARTITION BY k ORDER BY p)),
turn AS (
  SELECT edit.k, p, e, nth, f.role, f.text, max(CASE WHEN e = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY edit.k) AS led
  FROM edit LEFT JOIN fault f ON f.k = edit.k AND f.i = edit.i AND edit.e <> 'I' WHERE e <> 'D'),
line AS (
  SELECT k, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS lines FROM turn GROUP BY k)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.edits, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM hurt) LEFT JOIN stat USING (k) LEFT JOIN done USING (k) LEFT JOIN line USING (k)
"""
)
