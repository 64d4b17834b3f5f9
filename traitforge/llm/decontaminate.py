"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton. Document words stream
through it, tracking the longest suffix that occurs in any item. Where that length reaches the
window (``window`` consecutive item words; a shorter item is one window), the covered words are
hit, and the automaton's states tell whose windows they are.

An automaton holds about ``SHARD_WORDS`` item words, some 100 bytes each, or one longer item.
Larger benchmarks are dealt out to several, of which one at a time is held: each streams over the
documents, what they find is united by document.

Defined results: null or empty texts have no words and are clean; very long texts are streamed
whole; null or wordless items match nothing; items repeated under one id count once; an item whose
id is null still marks words as hit but is in no list of items; every input row gives one output
row, repeated rows included; an empty benchmark leaves all documents clean, an empty table stays
empty. Other columns, whatever their names, are not read in reports and are passed through
unchanged by :func:`remove_contamination`.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, small_batches, table, text_print

WINDOW = 10
#: Item words in one automaton on average; larger benchmarks take several automata in turn.
SHARD_WORDS = 1_000_000

#: Words are runs of digits, letters a-z and bytes of non-ASCII characters, A-Z lower-cased.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of word sequences that knows which windows belong to which items.

    States are numbers; each state's first edge, link and length stand in flat arrays, further
    edges under ``state << 32 | word`` in one dictionary.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.word, self.next, self.link, self.length = (array("i", [v]) for v in (-1, -1, -1, 0))
        self.more: dict[int, int] = {}
        branches: dict[int, array] = {}
        self.names = [key for key, words in items if words]
        coded = [array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for _, words in items if words]
        self.shortest = min((min(window, len(c)) for c in coded), default=window)
        for codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c, branches)
        del branches
        states, owners = array("i"), array("i")
        self.whole: dict[int, list[tuple[int, str | None]]] = {}
        for k, codes in enumerate(coded):
            state = 0
            for i, c in enumerate(codes):
                state = self._edge(state, c)
                if i + 1 >= window and self.names[k] is not None:
                    states.append(self._holder(state, window))
                    owners.append(k)
            if len(codes) < window:
                self.whole.setdefault(self._holder(state, len(codes)), []).append((len(codes), self.names[k]))
        pairs = np.unique(np.frombuffer(states, np.int32).astype(np.int64) << 32 | np.frombuffer(owners, np.int32)) if len(states) else np.zeros(0, np.int64)
        self.owned, self.owner = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        #: For each state the nearest one on its suffix path that is a whole short item; 0 if none.
        self.short = array("i", [0]) * len(self.link) if self.whole else array("i")
        if self.whole:
            for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]:
                self.short[s] = s if s in self.whole else self.short[self.link[s]]

    def _edge(self, state: int, c: int) -> int:
        return self.next[state] if self.word[state] == c else self.more.get(state << 32 | c, -1)

    def _lead(self, state: int, c: int, to: int, branches: dict[int, array]) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.next[state] = c, to
        else:
            if state << 32 | c not in self.more:
                branches.setdefault(state, array("i")).append(c)
            self.more[state << 32 | c] = to

    def _extend(self, last: int, c: int, branches: dict[int, array]) -> int:
        there = self._edge(last, c)
        if there >= 0:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, c, there, branches)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and self._edge(p, c) < 0:
            self._lead(p, c, new, branches)
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self._edge(p, c)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q, branches)
        return new

    def _state(self, length: int) -> int:
        for column, value in ((self.word, -1), (self.next, -1), (self.link, 0), (self.length, length)):
            column.append(value)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int, branches: dict[int, array]) -> int:
        copy = self._state(self.length[p] + 1)
        self.word[copy], self.next[copy] = self.word[q], self.next[q]
        for d in branches.get(q, ()):
            self._lead(copy, d, self.more[q << 32 | d], branches)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self._edge(p, c) == q:
            self._lead(p, c, copy, branches)
            p = self.link[p]
        return copy

    def _holder(self, state: int, n: int) -> int:
        """The state on the suffix path of ``state`` that holds its suffix of ``n`` words."""
        while state and self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _short_items(self, state: int) -> Iterator[tuple[int, str | None]]:
        """Whole short items among the suffixes of ``state``."""
        state = self.short[state]
        while state > 0:
            yield from self.whole[state]
            state = self.short[self.link[state]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges [start, end), disjoint and in order, and the ids of the items found."""
        if len(words) < self.shortest:
            return [], set()
        code = self.vocabulary.get
        codes = np.fromiter((code(w, -1) for w in words), np.int64, len(words))
        # Only runs of item vocabulary that are long enough for some window can hold a hit.
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes >= 0, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        cuts: set[int] = set()
        word, follow, more, link, length = self.word, self.next, self.more.get, self.link, self.length
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state = matched = 0
            for i, c in enumerate(codes[start:end].tolist(), start):
                while True:
                    to = follow[state] if word[state] == c else more(state << 32 | c, -1)
                    if to >= 0 or not state:
                        break
                    state = link[state]
                    matched = length[state]
                if to >= 0:
                    state = to
                    matched += 1
                if matched >= self.window:
                    cuts.add(self._holder(state, self.window))
                    ranges.append((i + 1 - self.window, i + 1))
                if self.whole and matched >= self.shortest:
                    for n, key in self._short_items(state):
                        if n <= matched:
                            ranges.append((i + 1 - n, i + 1))
                            if key is not None:
                                items.add(key)
        for state in cuts:
            first, last = np.searchsorted(self.owned, [state, state + 1])
            items.update(self.names[k] for k in self.owner[first:last].tolist())
        return merge_ranges(ranges), items


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class _Benchmark:
    """Test items dealt out to automata whose size is measured first."""

    def __init__(self, benchmark: DataFrame, item_col: str, item_text: str, window: int, shard_words: int):
        self.spark, self.window = benchmark.sparkSession, window
        self.items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
        total = self.items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
        self.shards = max(1, -(-total // shard_words))

    def automaton(self, k: int):
        """Automaton ``k``, broadcast."""
        part = self.items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(self.shards)) == k).distinct()
        rows = [(r.item, words_of(r.text)) for r in part.toLocalIterator()]
        return self.spark.sparkContext.broadcast(ItemAutomaton(sorted(rows, key=lambda r: (r[0] or "", r[1])), self.window))


_HITS = "array<struct<start:int,end:int>>"
_ARROW_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _each(docs: DataFrame, benchmark: _Benchmark, id_col: str, text_col: str, make: Callable, schema: T.StructType) -> DataFrame:
    """``make(batch, located)`` for each batch of ``docs``, where ``located`` holds for each row its
    words, hit ranges and items."""
    at = docs.columns.index(text_col)
    if benchmark.shards == 1:
        automaton = benchmark.automaton(0)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                split = [words_of(t) for t in batch.column(at).to_pylist()]
                yield make(batch, [(words, *automaton.value.scan(words)) for words in split])

        return docs.mapInArrow(scan, schema)

    # Columns by number, so that no name of theirs is in the way.
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    key, text = f"c{docs.columns.index(id_col)}", f"c{at}"
    slim = rows.select(F.col(key).alias("id"), text_print(F.col(text)).alias("print"), F.col(text).alias("text"))
    found = None
    for k in range(benchmark.shards):
        automaton = benchmark.automaton(k)

        def locate(batches: Iterator[pa.RecordBatch], automaton=automaton) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                results = [automaton.value.scan(words_of(t)) for t in batch.column(2).to_pylist()]
                some = pa.array([j for j, (ranges, _) in enumerate(results) if ranges], pa.int64())
                hit = [r for r in results if r[0]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array([[{"start": s, "end": e} for s, e in r] for r, _ in hit], _ARROW_HITS), pa.array([sorted(i) for _, i in hit], pa.list_(pa.string()))], names=["id", "print", "hits", "items"])

        part = materialize(slim.mapInArrow(locate, T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(f"print binary, hits {_HITS}, items array<string>").fields])), "located")
        automaton.destroy()
        found = part if found is None else found.unionByName(part)
    united = found.groupBy("id", "print").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = rows.join(united, rows[key].eqNullSafe(united["id"]) & (text_print(rows[text]) == united["print"]), "left").select(*rows.columns, "hits", "items")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            hits, items = (batch.column(c).to_pylist() for c in ("hits", "items"))
            located = [(words_of(t), merge_ranges([(r["start"], r["end"]) for r in h or []]), set(i or [])) for t, h, i in zip(batch.column(at).to_pylist(), hits, items, strict=True)]
            yield make(batch, located)

    return joined.mapInArrow(finish, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``n_hit``, ``hits`` (word ranges), ``items``
    (sorted ids of the items with occurring windows) and ``contaminated``."""
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string(f"n_words long, n_hit long, hits {_HITS}, items array<string>").fields])

    def report(batch: pa.RecordBatch, located: list) -> pa.RecordBatch:
        hits = pa.array([[{"start": s, "end": e} for s, e in ranges] for _, ranges, _ in located], _ARROW_HITS)
        n_hit = [sum(e - s for s, e in ranges) for _, ranges, _ in located]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w, _, _ in located], pa.int64()), pa.array(n_hit, pa.int64()), hits, pa.array([sorted(i) for _, _, i in located], pa.list_(pa.string()))], names=schema.names)

    found = _each(docs.select(id_col, text_col), _Benchmark(benchmark, item_col, item_text, window, shard_words), id_col, text_col, report, schema)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", window: int = WINDOW, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Cut hit spans out of the texts and drop documents of whose words more than ``max_coverage``
    are hit. The columns stay as they are; ``length_col`` follows the shortened text."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None
    names = docs.columns

    def clean(batch: pa.RecordBatch, located: list) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        keep = np.ones(len(texts), bool)
        changed: dict[int, str] = {}
        for k, (words, ranges, _) in enumerate(located):
            if ranges:
                keep[k] = sum(e - s for s, e in ranges) <= max_coverage * len(words)
                changed[k] = cut_words(texts[k], ranges)
        columns = list(batch.columns)[: len(names)]
        if changed:
            columns[at] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], batch.column(at).type)
            if length_at is not None:
                was = batch.column(length_at).to_pylist()
                columns[length_at] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(was)], batch.column(length_at).type)
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return _each(docs, _Benchmark(benchmark, "item_id", "text", window, shard_words), id_col, text_col, clean, docs.schema)


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``ranges`` and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for start, end in ranges:
        out.append(data[at : spans[start][0]])
        at = spans[end - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, gram.n, item_id FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(coalesce(len(doc.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
