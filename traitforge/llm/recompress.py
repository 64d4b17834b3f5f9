"""Removal of word passages that stand in an earlier document, found by recompression.

The words of a text are its first symbols. Rounds of recompression make symbols of symbols: a run of
equal symbols becomes one, then pairs do, whose left symbol is of one half of the alphabet and whose
right one of the other half, as a bit of the symbol's name in that round says. A name is a hash of
the parts' names, so all executors give equal parts equal names and none has to ask another.

What a symbol becomes depends on it and its neighbours only, so the symbols inside two equal
passages are the same, but for some at the borders. In each round those leave a window's inside
that something around the window might change: the run at either end, a right half at the left
border, a left half at the right border. A window's words alone thus decide what its inside holds
in the last round in which it holds symbols. The longest of these, of equally long ones that with
the least name, is its mark. Equal windows have equal marks at equal offsets, wherever they stand.

Windows next to each other share marks: they form spans. Spark tallies the marks of all
documents; only spans of marks that documents of different ids share go on. Of these, different spans
are told by 128-bit digests of their words, and each keeps its smallest document. A span that its
mark never shows otherwise is settled by that; of the others the windows are cut from the smallest
document's text and tallied by digests of their words, which verifies every repeat. Hashes of 64
bits only deal work out.

Defined results: null or empty texts have no words; texts of fewer words than a window lose
nothing; the smallest document of a window keeps it, though it may stand there several times;
repeated rows, and rows of one id with other texts, have one document id and do not take words from
each other; a null id is smaller than all others; very long texts are cut into overlapping pieces
and lose nothing; an empty table stays empty; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digests, materialize, mix64, prefix_hash, slices, small_batches, span_hash, table, text_print
from .suffix_dedup import _as_bytes, _packed, _typed

WINDOW = 50
#: Rounds of pairs; before the first and every ``RUNS``-th of them is one of runs.
ROUNDS, RUNS = 6, 3
#: Bytes of text that are parsed at once, and of a piece of one long text.
BLOCK, PIECE = 1 << 20, 1 << 19

U64 = np.uint64


def name_runs(name: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Names of runs of a symbol; a run of one is the symbol itself."""
    with np.errstate(over="ignore"):
        return np.where(times > 1, mix64(name + mix64(times.astype(U64) << U64(1))), name)


def name_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(left) * U64(3) + right)


def right_halves(names: np.ndarray, turn: int) -> np.ndarray:
    """Which symbols are of the half of the alphabet that stands right in pairs of this round."""
    with np.errstate(over="ignore"):
        return mix64(names + U64(turn + 1) * U64(0x9E3779B97F4A7C15)) >> U64(63) == 1


class Symbols:
    """The symbols of a text in some round: their names and first words (and the text's end)."""

    def __init__(self, words: np.ndarray):
        self.names, self.at = words, np.arange(len(words) + 1)

    def compress_runs(self) -> np.ndarray:
        """Make each run one symbol; gives the new symbol of each old one."""
        fresh = np.ones(len(self.names), bool)
        fresh[1:] = self.names[1:] != self.names[:-1]
        first = np.flatnonzero(fresh)
        self.names = name_runs(self.names[first], np.diff(np.append(first, len(fresh))))
        self.at = np.append(self.at[first], self.at[-1])
        return np.cumsum(fresh) - 1

    def compress_pairs(self, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Make each pair of a left and a right half one symbol; gives the new symbol of each old
        one (and the number of new ones), and which old ones are right halves."""
        right = right_halves(self.names, turn)
        second = np.zeros(len(right) + 1, bool)
        second[1:-1] = ~right[:-1] & right[1:]
        first = np.flatnonzero(~second[:-1])
        paired = second[first + 1]
        after = np.minimum(first + 1, len(right) - 1)
        self.names = np.where(paired, name_pairs(self.names[first], self.names[after]), self.names[first])
        self.at = np.append(self.at[first], self.at[-1])
        return np.cumsum(~second) - 1, right

    def longest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the symbols [lo, hi) the longest one, of equal ones that with the least name and then
        the first. Minima over 1, 2, 4, ... symbols answer all ranges."""
        n = len(self.names)
        if n >= 1 << 24:
            raise ValueError("too many symbols for one block")
        length = np.minimum(np.diff(self.at), 255).astype(U64)
        key = (U64(255) - length) << U64(56) | self.names >> U64(32) << U64(24) | np.arange(n, dtype=U64)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out, step = np.empty(len(lo), U64), 1
        for k in range(level.max(initial=-1) + 1):
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(key[lo[own]], key[hi[own] - step])
            key = np.minimum(key[:-step], key[step:]) if len(key) > step else key
            step *= 2
        return (out & U64((1 << 24) - 1)).astype(np.int64)


def window_marks(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The mark of each window of ``window`` word names: its name, and the word at which it begins."""
    symbols = Symbols(words)
    lo = np.arange(len(words) - window + 1)
    hi, live = lo + window, np.arange(len(lo))
    mark, place = np.empty(len(lo), U64), np.empty(len(lo), np.int64)

    def settle(own: np.ndarray) -> None:
        best = symbols.longest(lo[own], hi[own])
        mark[live[own]], place[live[own]] = symbols.names[best], symbols.at[best]

    for turn in range(ROUNDS):
        for runs in (True, False) if turn % RUNS == 0 else (False,):
            before = symbols
            symbols = Symbols.__new__(Symbols)
            symbols.names, symbols.at = before.names, before.at
            if runs:
                to = symbols.compress_runs()
                inner, outer = to[lo] + 1, to[hi - 1]
            else:
                to, right = symbols.compress_pairs(turn)
                inner, outer = to[lo + right[lo]], to[hi - ~right[hi - 1]]
            after, symbols = symbols, before
            kept = inner < outer
            settle(np.flatnonzero(~kept))
            symbols, live, lo, hi = after, live[kept], inner[kept], outer[kept]
    settle(np.arange(len(live)))
    return mark, place


def normal(text: bytes | None) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join(text.split()) if text else b""


def cut_long(data: bytes, window: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Pieces (first word, bytes) of a normal text; each but the first repeats ``window`` - 1 words."""
    if len(data) <= size:
        yield 0, data
        return
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    first = 0
    while True:
        begin = ends[first - 1] + 1 if first else 0
        last = max(first + window, int(np.searchsorted(ends, begin + size)))
        last = min(last, len(ends))
        yield first, data[begin : ends[last - 1]]
        if last == len(ends):
            return
        first = last - window + 1


def spans_of(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Spans of all windows of normal texts: mark, owner, first window, number of windows, digest."""
    pieces = [(k, at, piece) for k, text in enumerate(texts) for at, piece in cut_long(text, window, PIECE)][::-1]
    out: list[tuple] = []
    while pieces:
        block, size = [], 0
        while pieces and (not block or size + len(pieces[-1][2]) <= BLOCK):
            piece = pieces.pop()
            if piece[2]:
                block.append(piece)
                size += len(piece[2]) + 1
        if not block:
            break
        joined = b" ".join(p[2] for p in block)
        data = np.frombuffer(joined, np.uint8)
        spaces = np.flatnonzero(data == 32)
        starts, ends = np.append(0, spaces + 1), np.append(spaces, len(data))
        if len(starts) < window:
            continue
        mark, place = window_marks(span_hash(prefix_hash(data), starts, ends), window)
        # The piece of each word; windows over two pieces are none.
        sizes = np.array([len(p[2]) + 1 for p in block])
        which = np.repeat(np.arange(len(block)), sizes)[starts]
        opened = np.searchsorted(which, np.arange(len(block)))
        own = np.flatnonzero(which[: len(mark)] == which[window - 1 :])
        if not len(own):
            continue
        fresh = np.ones(len(own), bool)
        fresh[1:] = (mark[own[1:]] != mark[own[:-1]]) | (place[own[1:]] != place[own[:-1]]) | (np.diff(own) != 1)
        first = own[np.flatnonzero(fresh)]
        n = np.diff(np.append(np.flatnonzero(fresh), len(own)))
        view = memoryview(joined)
        names = digests([view[s:e] for s, e in zip(starts[first].tolist(), ends[first + n - 2 + window].tolist(), strict=True)])
        w = which[first]
        owner, base = np.array([p[0] for p in block])[w], np.array([p[1] for p in block])[w]
        out.append((mark[first].view(np.int64), owner, first - opened[w] + base, n, names))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    return tuple(np.concatenate(c) if isinstance(c[0], np.ndarray) else [d for part in c for d in part] for c in zip(*out, strict=True))


def _spans(docs: DataFrame, id_type: T.DataType, window: int) -> DataFrame:
    """(mark, span, n, print, lo, id) of every span, ``span`` being its digest."""
    schema = _typed("mark long, span binary, n int, print binary, lo int", id_type)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            mark, owner, lo, n, span = spans_of([normal(b) for b in batch.column("body").to_pylist()], window)
            if len(owner):
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(span, pa.binary()), pa.array(n, pa.int32()), batch.column("print").take(at), pa.array(lo, pa.int32()), batch.column("id").take(at)], names=schema.names)

    return docs.select("id", "print", "body").mapInArrow(parse, schema)


def _windows(docs: DataFrame, kinds: DataFrame, id_type: T.DataType, window: int) -> DataFrame:
    """(words, mark, span, k, id): the digest of each window of the spans ``kinds``, read from the
    text of their smallest document."""
    wanted = kinds.select("mark", "span", "n", "first.*").groupBy("id", "print").agg(F.collect_list(F.struct("mark", "span", "n", "lo")).alias("spans")).withColumnsRenamed({"id": "wid", "print": "wprint"})
    packed = _packed(docs.select("id", "print", "body"))
    texts = packed.join(wanted, packed["id"].eqNullSafe(wanted["wid"]) & (packed["print"] == wanted["wprint"])).select("id", "print", "body", "spans")
    schema = _typed("words binary, mark long, span binary, k int", id_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor().decompress, None
        for batch in batches:
            for row in range(batch.num_rows):
                own = (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
                if own == last:  # a repeated row has the same windows
                    continue
                last = own
                body = normal(unpack(batch.column(2)[row].as_py()))
                data = np.frombuffer(body, np.uint8)
                ends = np.append(np.flatnonzero(data == 32), len(data))
                starts = np.append(0, ends[:-1] + 1)
                spans = batch.column(3)[row].values
                lo, n = spans.field("lo").to_numpy(), spans.field("n").to_numpy()
                of = np.repeat(np.arange(len(n)), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = lo[of] + k
                view = memoryview(body)
                for part in range(0, len(at), 1 << 15):
                    p = slice(part, part + (1 << 15))
                    names = digests([view[s:e] for s, e in zip(starts[at[p]].tolist(), ends[at[p] + window - 1].tolist(), strict=True)])
                    many = pa.array(of[p])
                    ids = batch.column(0).take(pa.array(np.full(len(names), row)))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), spans.field("mark").take(many), spans.field("span").take(many), pa.array(k[p], pa.int32()), ids], names=schema.names)

    return texts.mapInArrow(cut, schema)


def _late(windows: DataFrame) -> DataFrame:
    """(mark, span, late): the windows of a span's smallest document that a smaller one has too."""
    tally = windows.groupBy("words").agg(F.min(F.struct("id")).alias("least"), F.max(F.struct("id")).alias("most")).filter(~F.col("least").eqNullSafe(F.col("most"))).select("words", "least")
    late = windows.join(tally, "words").filter(~F.struct("id").eqNullSafe(F.col("least")))
    return late.groupBy("mark", "span").agg(F.collect_set("k").alias("late"))


def later_ranges(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Per (id, print) of documents that lose words: ``ranges`` of word places, unmerged."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    plain = docs.select(F.col(id_col).alias("id"), text_print(F.col(text_col)).alias("print"), _as_bytes(F.col(text_col)).alias("body"))
    spans = materialize(_spans(plain, id_type, window), "spans")
    tally = spans.groupBy("mark").agg(F.min(F.struct("id")).alias("least"), F.max(F.struct("id")).alias("most"))
    shared = materialize(tally.filter(~F.col("least").eqNullSafe(F.col("most"))).select("mark"), "marks")
    found = materialize(spans.join(shared, "mark"), "shared-spans")
    kinds = materialize(found.groupBy("mark", "span", "n").agg(F.min(F.struct("id", "print", "lo")).alias("first")), "kinds")
    mixed = kinds.groupBy("mark").count().filter("count > 1").select("mark")
    windows = materialize(_windows(plain, kinds.join(mixed, "mark"), id_type, window), "windows")
    told = materialize(kinds.select("mark", "span", F.col("first.id").alias("least")).join(_late(windows), ["mark", "span"], "left"), "told")

    whole = F.array(F.struct(F.col("lo").alias("start"), (F.col("lo") + F.col("n") + (window - 1)).alias("end")))
    some = F.transform(F.coalesce("late", F.array().cast("array<int>")), lambda k: F.struct((F.col("lo") + k).alias("start"), (F.col("lo") + k + window).alias("end")))
    # Only the smallest document of a span's words keeps the span, but for what others have before it.
    ranges = F.when(F.col("id").eqNullSafe(F.col("least")), some).otherwise(whole)
    rows = found.join(told, ["mark", "span"]).select("id", "print", ranges.alias("ranges")).filter(F.size("ranges") > 0).distinct()
    return rows.groupBy("id", "print").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: ``id_col``, ``n_words``, ``n_removed`` and ``kept``, the remaining
    words with one space between them."""
    ranges = materialize(later_ranges(docs, id_col, text_col, window), "word-ranges").withColumnsRenamed({"id": "rid", "print": "rprint"})
    plain = docs.select(F.col(id_col).alias("id"), text_print(F.col(text_col)).alias("print"), _as_bytes(F.col(text_col)).alias("body"))
    packed = _packed(plain)
    joined = packed.join(ranges, packed["id"].eqNullSafe(ranges["rid"]) & (packed["print"] == ranges["rprint"]), "left").select(F.col("id").alias(id_col), "body", "ranges")
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("n_words long, n_removed long, kept binary").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "body"):
            rows = [kept_words(unpack(b).split(), r or []) for b, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n, removed, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def kept_words(words: list[bytes], ranges: list[dict]) -> tuple[int, int, bytes]:
    """Number of words, of those in ``ranges``, and the others joined."""
    out, at = [], 0
    for start, end in sorted((r["start"], r["end"]) for r in ranges):
        if end > at:
            out += words[at : max(start, at)]
            at = end
    out += words[at:]
    return len(words), len(words) - len(out), b" ".join(out)


def op12_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = passage_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
ranked AS (SELECT r, dense_rank() OVER (ORDER BY doc_id NULLS FIRST) AS k, w FROM doc WHERE len(w) >= 50),
win AS (SELECT r, k, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM ranked)),
late AS (SELECT win.r, i FROM win JOIN (SELECT h, min(k) AS k FROM win GROUP BY h) least USING (h) WHERE win.k > least.k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM late),
word AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc WHERE r IN (SELECT r FROM late))),
cut AS (SELECT r, count(gone.i) AS n, coalesce(string_agg(word, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL), '') AS kept FROM word LEFT JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, array_to_string(w, ' '), '')) AS kept_sha256
FROM doc LEFT JOIN cut USING (r)
"""
