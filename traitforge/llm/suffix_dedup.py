"""Removal of byte strings that repeat anywhere, by longest-previous-factor arrays.

Every window of ``length`` bytes belongs to exactly one anchor, the smallest hash of its
``GRAM``-byte substrings, so equal windows have equal anchors wherever they stand. The windows
of one anchor in a row form a span (about 300 bytes, ``SPAN`` windows at most). Anchors of one
span cannot repeat, unless windows repeat inside that span (as in periodic text), and are dropped
by one aggregation and join. Of spans that are copies of each other only the first and the last
occurrence are compared; what stands between has an earlier and a later copy if these have.

The texts are dealt out by anchor. The suffixes of the texts of a group of anchors are ranked by
prefix multiplication; that gives the suffix order of their windows, by ``length`` bytes, and the
longest common prefixes of neighbours, of which those of ``length`` count. The previous and the next
smaller place of each window in that order give its longest previous factor, and with places
reversed its longest next factor. A window with a previous factor of ``length`` bytes is a later
copy, one with such a next factor an earlier copy; only these factors remove bytes.

An anchor with more than ``GROUP_BYTES`` of different spans is not left to one task. Its spans are
cut into parts of up to ``PART`` windows that have most of their bytes in common, and these are dealt
out by the common bytes; should such a group still be larger, so are its single windows.

Hashes of 64 bits only deal work out. Copies are told by 128-bit cryptographic digests, and their
first and last occurrence again byte by byte.

Occurrences are ordered by document id, then place. ``keep="first"`` removes what has an earlier
copy; ``keep="none"`` removes every copy.

Defined results: null texts count as empty and nothing is removed from texts shorter than
``length``; matches never cross documents; repeated rows are copies of each other under
``keep="none"`` and stay alike under ``keep="first"``; a null id sorts first; very long texts are
cut into overlapping pieces and lose nothing; empty tables give empty tables; other columns pass
through unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digests, materialize, prefix_hash, slices, small_batches, span_hash, table, text_print

LENGTH = 200
#: Bytes of an anchor's substring.
GRAM = 32
#: Bytes of texts handled at once, and of a piece of one long text.
BLOCK, PIECE = 1 << 19, 1 << 18
#: Windows of one span at most.
SPAN = 1024
#: Bytes of different spans of one anchor that one task may hold.
GROUP_BYTES = 1_500_000
#: Windows in a part of a span, whose common bytes are all but so many of a window.
PART = 40
#: Bytes of span texts that one suffix array covers before the next anchor starts another.
ARRAY_BYTES = 1 << 19


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()[:n]
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()[:n]
    return np.minimum(back[: n - width + 1], ahead[width - 1 :])


def spans_of(texts: list[bytes], length: int, gram: int, named: bool) -> list[np.ndarray | list[bytes]]:
    """Spans of all windows: their anchors' hashes, then, if ``named``, owner, first window, number
    of windows and digest of each, or else whether a window repeats inside it."""
    pieces: list[tuple[int, int, bytes]] = []
    for k, text in enumerate(texts):
        pieces += [(k, at, text[at : at + PIECE + length - 1]) for at in range(0, len(text) - length + 1, PIECE)]
    out: list[tuple] = []
    while pieces:
        block, size = [], 0
        while pieces and (not block or size + len(pieces[-1][2]) <= BLOCK):
            block.append(pieces.pop())
            size += len(block[-1][2])
        joined = b"".join(p[2] for p in block)
        data = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(p[2]) for p in block])
        begins = np.cumsum(sizes) - sizes
        prefix = prefix_hash(data)
        at = np.arange(len(data) - gram + 1)
        grams = span_hash(prefix, at, at + gram)
        least = sliding_min(grams, length - gram + 1)
        which = np.repeat(np.arange(len(block)), sizes)[: len(least)]
        inside = np.arange(len(least)) + length <= (begins + sizes)[which]
        fresh = np.ones(len(least), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (which[1:] != which[:-1])
        opened = np.flatnonzero(fresh)
        runs = np.diff(np.append(opened, len(least)))
        if runs.max() > SPAN:  # periodic text: cut at every so many windows
            fresh |= (np.arange(len(least)) - np.repeat(opened, runs)) % SPAN == 0
        starts = np.flatnonzero(fresh & inside)
        w = which[starts]
        ends = np.append(starts[1:], len(least))
        ends = np.minimum(ends, (begins + sizes)[w] - length + 1)
        anchors = least[starts].view(np.int64)
        if named:
            whole = memoryview(joined)
            names = digests([whole[s:e] for s, e in zip(starts.tolist(), (ends - 1 + length).tolist(), strict=True)])
            owner, base = np.array([p[0] for p in block])[w], np.array([p[1] for p in block])[w]
            out.append((anchors, owner, starts - begins[w] + base, ends - starts, names))
        else:
            out.append((anchors, repeats_inside(prefix, grams, starts, ends, length, gram)))
    if not out:
        out = [tuple([*(np.zeros(0, np.int64) for _ in range(4)), []]) if named else (np.zeros(0, np.int64), np.zeros(0, bool))]
    return [np.concatenate(c) if isinstance(c[0], np.ndarray) else [d for part in c for d in part] for c in zip(*out, strict=True)]


def repeats_inside(prefix: np.ndarray, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which spans hold one of their windows twice. Equal windows have their anchor at the same
    offset, so only spans in which it occurs more than once are looked at window by window."""
    width = length - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    out = np.zeros(len(starts), bool)
    for at in range(0, len(starts), 4096):
        s, e = starts[at : at + 4096], ends[at : at + 4096]
        held = views[s]
        anchor = held.min(1)[:, None]
        first = s + (held == anchor).argmax(1)
        last = e - 1 + width - 1 - (views[e - 1][:, ::-1] == anchor).argmax(1)
        for i in np.flatnonzero(first < last).tolist():
            k = np.arange(s[i], e[i])
            out[at + i] = len(np.unique(span_hash(prefix, k, k + length))) < len(k)
    return out


def suffix_ranks(data: np.ndarray, length: int) -> tuple[int, np.ndarray]:
    """A width and the ranks of all positions by their next ``width`` bytes, equal if these agree:
    of widths of 8 bytes, 24, 72, ... the first of which three cover ``length``. Positions nearer to
    the end are ranked as if zeros followed. Three ranks of 21 bits make one key."""
    if len(data) >= 1 << 21:
        raise ValueError("too many bytes for one suffix array")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view(">u8").ravel().astype(np.uint64)
    width, rank = 8, np.unique(words, return_inverse=True)[1].astype(np.int64)
    while 3 * width < length:
        key = (rank + 1) << 42
        key[:-width] |= (rank[width:] + 1) << 21
        key[: -2 * width] |= rank[2 * width :] + 1
        width, rank = 3 * width, np.unique(key, return_inverse=True)[1].astype(np.int64)
    return width, rank


def window_keys(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Numbers that order the windows at ``starts`` by their ``length`` bytes (8 at least)."""
    width, rank = suffix_ranks(data, length)
    last = length - width
    return rank[starts] << 42 | rank[starts + last // 2] << 21 | rank[starts + last]


def previous_smaller(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each index the nearest one before it, not before its ``begins``, whose value is smaller;
    -1 if there is none. Minima of 1, 2, 4, ... values in a row are skipped, largest first."""
    n = len(values)
    here = np.arange(n)
    minima = [values]
    while 2 << len(minima) - 1 <= (here - begins).max(initial=0) + 1:
        last, step = minima[-1], 1 << len(minima) - 1
        minima.append(np.minimum(last[:-step], last[step:]))
    stop = here.copy()
    for k in reversed(range(len(minima))):
        to = stop - (1 << k)
        free = to >= begins
        free[free] = minima[k][to[free]] > values[free]
        stop[free] = to[free]
    return np.where(stop > begins, stop - 1, -1)


def previous_factors(agree: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factors of windows in suffix order, counted up to ``length``, shorter ones
    as 0: the longest prefix that a window at a smaller ``place`` has too. ``agree`` tells which
    neighbours have a longest common prefix of ``length``.

    It is the longer one of the common prefixes with the previous and with the next smaller place;
    between two windows it is the least one of the neighbours between them, so only runs of
    neighbours that agree are searched.
    """
    factors = np.zeros(len(place), np.int64)
    run = np.concatenate(([0], np.cumsum(~agree)))
    member = np.flatnonzero(np.bincount(run)[run] > 1)
    value, run = place[member], run[member]
    edges = np.flatnonzero(np.diff(run, prepend=-1))
    sizes = np.diff(np.append(edges, len(run)))
    begins, ends = np.repeat(edges, sizes), np.repeat(edges + sizes, sizes)
    before = previous_smaller(value, begins) >= 0
    after = previous_smaller(value[::-1], (len(run) - ends)[::-1])[::-1] >= 0
    factors[member] = np.where(before | after, length, 0)
    return factors


def repeated_windows(texts: list[bytes], text_of: list[int], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each occurrence of a text, which of its windows have an earlier and which a later equal
    window. Occurrences, and the windows inside each, stand in order of place."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = (np.cumsum(sizes) - sizes)[text_of]
    counts = sizes[text_of] - length + 1
    starts = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    keys = window_keys(data, starts, length)
    order = np.argsort(keys)
    agree = keys[order][1:] == keys[order][:-1]
    place = order.astype(np.int32)
    earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    earlier[order] = previous_factors(agree, place, length) == length
    later[order] = previous_factors(agree, len(place) - 1 - place, length) == length
    cuts = np.cumsum(counts)[:-1]
    return np.split(earlier, cuts), np.split(later, cuts)


def runs_of(flags: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edges.reshape(-1, 2).tolist()


_ARROW_RUNS = pa.list_(pa.list_(pa.int32()))


def _as_bytes(column: Column) -> Column:
    return F.coalesce(column, F.lit("")).cast("binary")


_PLACE = ("id", "print", "lo")


def _typed(text: str, id_type: T.DataType) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(text).fields, T.StructField("id", id_type)])


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, inner) of every span."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            anchor, inner = spans_of(batch.column(0).to_pylist(), length, GRAM, named=False)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(inner)], names=["anchor", "inner"])

    return docs.filter(F.octet_length("body") >= length).select("body").mapInArrow(cut, "anchor long, inner boolean")


def _spans(docs: DataFrame, id_type: T.DataType, length: int) -> DataFrame:
    """(anchor, span, n, print, lo, id) of every span, ``span`` being its digest."""
    schema = _typed("anchor long, span binary, n int, print binary, lo int", id_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            anchor, owner, lo, n, span = spans_of(batch.column("body").to_pylist(), length, GRAM, named=True)
            if len(owner):
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(span, pa.binary()), pa.array(n, pa.int32()), batch.column("print").take(at), pa.array(lo, pa.int32()), batch.column("id").take(at)], names=schema.names)

    return docs.filter(F.octet_length("body") >= length).mapInArrow(cut, schema)


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """Rows (id, print, lo, n, earlier, later) of spans that hold repeats: the runs of the span's
    windows that also stand at earlier or at later places."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    plain = docs.select(F.col(id_col).alias("id"), text_print(F.col(text_col)).alias("print"), _as_bytes(F.col(text_col)).alias("body"))
    twice = _anchors(plain, length).groupBy("anchor").agg(F.count(F.lit(1)).alias("count"), F.bool_or("inner").alias("inner")).filter("count > 1 OR inner").select("anchor")
    found = materialize(_spans(plain, id_type, length).join(twice, "anchor"), "anchors")
    place = F.struct(*_PLACE)
    spans = materialize(found.groupBy("anchor", "span", "n").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"), F.max(place).alias("last")), "spans")
    sizes = (F.col("n") + (length - 1)) * F.when(F.col("copies") > 1, 2).otherwise(1)
    large = materialize(spans.groupBy("anchor").agg(F.sum(sizes).alias("bytes")).filter(F.col("bytes") > GROUP_BYTES).select("anchor"), "large")
    packed = plain.filter(F.octet_length("body") >= length)
    if large.isEmpty():
        compared = _compare_groups(_texts(packed, spans, id_type, length), length)
    else:
        small = _texts(packed, spans.join(large, "anchor", "left_anti"), id_type, length)
        others = materialize(_texts(packed, spans.join(large, "anchor", "left_semi"), id_type, length).dropDuplicates(["anchor", "span", "n", "rep"]), "span-texts")
        compared = _compare_groups(small, length).unionByName(_compare_parts(others, length, id_type, PART))
    compared = materialize(compared, "compared")
    return _told(found.join(spans.drop("copies").join(compared, ["anchor", "span", "n"]), ["anchor", "span", "n"]), place).drop("anchor", "span")


def _texts(docs: DataFrame, spans: DataFrame, id_type: T.DataType, length: int) -> DataFrame:
    """(anchor, span, n, rep, inst, print, lo, text, id) of the first (``rep`` 0) and last (1)
    occurrences of ``spans``. Repeated rows, which a join leaves next to each other, give them once."""
    place = lambda rep, at: F.struct(F.lit(rep).alias("rep"), f"{at}.*")
    shown = F.when(F.col("copies") > 1, F.array(place(0, "first"), place(1, "last"))).otherwise(F.array(place(0, "first")))
    shown = spans.select("anchor", "span", "n", F.explode(shown).alias("at")).select("anchor", "span", "n", "at.*")
    wanted = shown.groupBy("id", "print").agg(F.collect_list(F.struct("anchor", "span", "n", "rep", "lo")).alias("spans"))
    packed = _packed(docs)
    texts = packed.join(wanted, packed["id"].eqNullSafe(wanted["id"]) & (packed["print"] == wanted["print"])).select(packed["id"], packed["print"], "body", "spans")
    schema = _typed("anchor long, span binary, n int, rep int, inst int, print binary, lo int, text binary", id_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, before = zstandard.ZstdDecompressor().decompress, None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            batch = batch.filter(pa.array([k != p for k, p in zip(keys, [before, *keys[:-1]], strict=True)], pa.bool_()))
            before = keys[-1] if keys else before
            own, row = batch.column(3).flatten(), pc.list_parent_indices(batch.column(3))
            lo, n = (own.field(c).to_numpy() for c in ("lo", "n"))
            parts, text, last = [], b"", -1
            for k, i, j in zip(row.to_pylist(), lo.tolist(), (lo + n - 1 + length).tolist(), strict=True):
                if k != last:
                    text, last = unpack(batch.column(2)[k].as_py()), k
                parts.append(text[i:j])
            yield pa.RecordBatch.from_arrays([*(own.field(c) for c in ("anchor", "span", "n", "rep", "rep")), batch.column(1).take(row), own.field("lo"), pa.array(parts, pa.binary()), batch.column(0).take(row)], names=schema.names)

    return texts.mapInArrow(cut, schema)


#: Runs of windows with an earlier and a later copy, for the first and the last occurrence.
_COMPARED = "anchor long, span binary, n int, e0 array<array<int>>, l0 array<array<int>>, e1 array<array<int>>, l1 array<array<int>>"


def _told(rows: DataFrame, place: Column) -> DataFrame:
    """``rows`` with what the comparison of their first and last copies says about each. Between
    the two, a copy has earlier ones as the last has, and later ones as the first has."""
    is_first, is_last = place.eqNullSafe(F.col("first")), place.eqNullSafe(F.col("last"))
    earlier = F.when(is_first, F.col("e0")).otherwise(F.col("e1"))
    later = F.when(is_last & ~is_first, F.col("l1")).otherwise(F.col("l0"))
    return rows.withColumns({"earlier": earlier, "later": later}).drop("first", "last", "e0", "l0", "e1", "l1")


def _compare_groups(pieces: DataFrame, length: int) -> DataFrame:
    """Factors over the texts of groups of anchors; all spans of an anchor are in one group."""

    columns = ["anchor", "span", "n", "rep", "id", "print", "lo", "inst", "text"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    if size > ARRAY_BYTES:
                        yield _compared(held, length)
                        held, size = [], 0
                    last = row[0]
                if not held or row[:4] != held[-1][:4]:
                    held.append(row)
                    size += len(row[8])
        if held:
            yield _compared(held, length)

    dealt = pieces.repartition("anchor").sortWithinPartitions("anchor", "span", "n", "rep")
    return dealt.select(*columns).mapInArrow(compare, _COMPARED)


def _compared(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Rows (anchor, span, n, rep, id, print, lo, inst, text), a last occurrence after its first."""
    by_place = sorted(range(len(rows)), key=lambda k: (rows[k][4] is not None, rows[k][4] if rows[k][4] is not None else 0, *rows[k][5:8]))
    texts: list[bytes] = []
    number: dict[bytes, int] = {}  # texts are equal byte by byte where they have one number
    text_of = []
    for k in by_place:
        text = rows[k][8]
        at = number.setdefault(text, len(texts))
        if at == len(texts):
            texts.append(text)
        text_of.append(at)
    found: list[tuple] = [()] * len(rows)
    for k, e, x in zip(by_place, *repeated_windows(texts, text_of, length), strict=True):
        found[k] = (runs_of(e), runs_of(x))
    out: list[list] = [[] for _ in range(7)]
    for row, (e, x) in zip(rows, found, strict=True):
        if row[3] == 0:
            for column, value in zip(out, (*row[:3], e, x, [], []), strict=True):
                column.append(value)
        else:
            out[5][-1], out[6][-1] = e, x
    kinds = [pa.int64(), pa.binary(), pa.int32(), *[_ARROW_RUNS] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["anchor", "span", "n", "e0", "l0", "e1", "l1"])


def parts_of(text: bytes, anchor: int, length: int, gram: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Parts of a span: first window, number of windows, hash of their common bytes, text digest.

    A window's part follows from its own bytes: the offset of the anchor's first occurrence in it,
    in steps of ``step`` windows. With a step of 1 every window is a part of its own.
    """
    if step == 1:
        starts = np.arange(len(text) - length + 1)
        names = digests(text[s : s + length] for s in starts.tolist())
        return starts, np.ones_like(starts), np.array([int.from_bytes(d[:8], "little", signed=True) for d in names], np.int64), names
    prefix = prefix_hash(np.frombuffer(text, np.uint8))
    at = np.arange(len(text) - gram + 1)
    found = np.flatnonzero(span_hash(prefix, at, at + gram).view(np.int64) == anchor)
    k = np.arange(len(text) - length + 1)
    occurs = found[np.searchsorted(found, k)]
    nth = (occurs - k) // step
    new = np.ones(len(k), bool)
    new[1:] = (occurs[1:] != occurs[:-1]) | (nth[1:] != nth[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(k))
    # Every window of the part holds the bytes from its last possible start to its first end.
    common = occurs[starts] - nth[starts] * step
    shared = digests(b"%d:" % q + text[c : c + length - step + 1] for q, c in zip(nth[starts].tolist(), common.tolist(), strict=True))
    key = np.array([int.from_bytes(d[:8], "little", signed=True) for d in shared], np.int64)
    return starts, ends - starts, key, digests(text[s : e - 1 + length] for s, e in zip(starts.tolist(), ends.tolist(), strict=True))


def _compare_parts(pieces: DataFrame, length: int, id_type: T.DataType, step: int) -> DataFrame:
    """The same for anchors with very many spans, by parts of spans and their common bytes."""
    schema = _typed("anchor long, span binary, n int, rep int, inst int, print binary, lo int, k int, m int, key long, part binary", id_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (anchor, text) in enumerate(zip(batch.column("anchor").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                k, m, key, part = parts_of(text, anchor, length, GRAM, step)
                many = pa.array(np.full(len(k), r))
                own = {c: batch.column(c).take(many) for c in ("anchor", "span", "n", "rep", "inst", "print", "lo", "id")}
                own |= {"k": pa.array(k, pa.int32()), "m": pa.array(m, pa.int32()), "key": pa.array(key), "part": pa.array(part, pa.binary())}
                yield pa.RecordBatch.from_arrays([own[c] for c in schema.names], names=schema.names)

    parts = materialize(pieces.select("anchor", "span", "n", "rep", "inst", "id", "print", "lo", "text").mapInArrow(cut, schema), "parts")
    place = F.struct("id", "print", (F.col("lo") + F.col("k")).alias("lo"), "inst", "anchor", "span", "n", "rep", "k")
    kinds = materialize(parts.groupBy("key", "part", "m").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"), F.max(place).alias("last")), "part-kinds")
    pick = lambda rep, at: F.struct(F.lit(rep).alias("as"), f"{at}.*")
    shown = F.when(F.col("copies") > 1, F.array(pick(0, "first"), pick(1, "last"))).otherwise(F.array(pick(0, "first")))
    sizes = (F.col("m") + (length - 1)) * F.when(F.col("copies") > 1, 2).otherwise(1)
    mixed = kinds.groupBy("key").agg(F.sum(sizes).alias("bytes"), F.count(F.lit(1)).alias("kinds"), F.max("copies").alias("most")).filter("kinds > 1 OR most > 1").select("key", "bytes")
    shown = kinds.join(mixed, "key").select("key", "part", "m", "bytes", F.explode(shown).alias("at")).select("key", "part", "m", "bytes", "at.*")
    texts = shown.join(pieces.select("anchor", "span", "n", "rep", "text"), ["anchor", "span", "n", "rep"])
    texts = texts.select(F.col("key").alias("anchor"), F.col("part").alias("span"), F.col("m").alias("n"), F.col("as").alias("rep"), "bytes", "id", "print", "lo", "inst", F.substring("text", F.col("k") + 1, F.col("m") - 1 + length).alias("text"))
    texts = materialize(texts, "part-texts")
    # Parts of one window that meet are equal, so there is no further step below.
    compared = _compare_groups(texts.filter((F.col("bytes") <= GROUP_BYTES) | F.lit(step == 1)), length)
    large = texts.filter((F.col("bytes") > GROUP_BYTES) & F.lit(step > 1))
    if step > 1 and not large.isEmpty():
        compared = compared.unionByName(_compare_parts(large, length, id_type, 1))
    compared = compared.withColumnsRenamed({"anchor": "key", "span": "part", "n": "m"})
    flags = _told(parts.join(kinds.drop("copies").join(compared, ["key", "part", "m"]), ["key", "part", "m"]), place)
    moved = lambda c: F.flatten(F.collect_list(F.transform(c, lambda r: F.array(r[0] + F.col("k"), r[1] + F.col("k")))))
    own = lambda rep, c: moved(F.when(F.col("rep") == rep, F.col(c)))
    return flags.groupBy("anchor", "span", "n").agg(own(0, "earlier").alias("e0"), own(0, "later").alias("l0"), own(1, "earlier").alias("e1"), own(1, "later").alias("l1"))


def _packed(rows: DataFrame) -> DataFrame:
    """``body`` compressed on the side that reads it, so that the shuffle moves fewer bytes."""
    at = rows.columns.index("body")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "body"):
            yield batch.set_column(at, "body", pa.array([squeeze(b) for b in batch.column(at).to_pylist()], pa.binary()))

    return rows.mapInArrow(pack, rows.schema)


def removed_ranges(docs: DataFrame, id_col: str, text_col: str, keep: str, length: int = LENGTH) -> DataFrame:
    """Per (id, print) of documents that lose bytes: ``ranges`` of byte positions, unmerged."""
    if keep not in ("first", "none"):
        raise ValueError(f"keep must be 'first' or 'none', not {keep!r}")
    spans = repeated_spans(docs, id_col, text_col, length)
    windows = F.concat("earlier", "later") if keep == "none" else F.col("earlier")
    rows = spans.select("id", "print", F.transform(windows, lambda r: F.struct((F.col("lo") + r[0]).alias("start"), (F.col("lo") + r[1] - 1 + length).alias("end"))).alias("ranges"))
    rows = rows.filter(F.size("ranges") > 0)
    return rows.groupBy("id", "print").agg(F.array_distinct(F.flatten(F.collect_list("ranges"))).alias("ranges"))


def _with_ranges(docs: DataFrame, id_col: str, text_col: str, keep: str, length: int) -> DataFrame:
    """Columns c0, c1, ... of ``docs``, the packed ``body`` in place of the text, and ``ranges``."""
    ranges = removed_ranges(docs, id_col, text_col, keep, length).withColumnsRenamed({"id": "rid", "print": "rprint"})
    names = [f"c{k}" for k in range(len(docs.columns))]
    at, key = docs.columns.index(text_col), names[docs.columns.index(id_col)]
    rows = docs.toDF(*names)
    mark = text_print(F.col(names[at]))
    rows = rows.select(*[c for c in names if c != names[at]], F.col(names[at]).isNull().alias("absent"), mark.alias("mark"), _as_bytes(F.col(names[at])).alias("body"))
    packed = _packed(rows)
    return packed.join(ranges, packed[key].eqNullSafe(F.col("rid")) & (F.col("mark") == F.col("rprint")), "left").drop("rid", "rprint", "mark")


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "none") -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs) and ``kept`` (the remaining bytes)."""
    slim = docs.select(F.col(id_col), F.col(text_col))
    joined = _with_ranges(slim, id_col, text_col, keep, length).select(F.col("c0").alias(id_col), "body", "ranges")
    schema = T.StructType([slim.schema[id_col], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept binary").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "body"):
            done = [cut_ranges(unpack(b), r or []) for b, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n, removed, spans, kept = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    return joined.mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", length: int = LENGTH, keep: str = "first") -> DataFrame:
    """``docs`` with repeated bytes cut out of the texts; characters that lose a part go with it.
    ``length_col`` follows the shortened text; texts that lose nothing stay as they are."""
    joined = _with_ranges(docs, id_col, text_col, keep, length)
    schema = docs.schema
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None
    others = [k for k in range(len(docs.columns)) if k != at]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "body"):
            absent, bodies, ranges = (batch.column(c).to_pylist() for c in ("absent", "body", "ranges"))
            texts = [None if a else (unpack(b) if r is None else cut_ranges(unpack(b), r)[3]).decode("utf-8", "ignore") for a, b, r in zip(absent, bodies, ranges, strict=True)]
            columns: list = [None] * len(schema)
            for place, k in enumerate(others):
                columns[k] = batch.column(place)
            columns[at] = pa.array(texts, pa.string())
            if length_at is not None:
                was = columns[length_at].to_pylist()
                columns[length_at] = pa.array([n if r is None else len(t) for n, r, t in zip(was, ranges, texts, strict=True)], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(cut, schema)


def cut_ranges(body: bytes, ranges: list[dict]) -> tuple[int, int, int, bytes]:
    """Size, bytes removed, maximal removed runs, and what stays of ``body``."""
    out, at, removed, spans, end = [], 0, 0, 0, -1
    for start, stop in sorted((r["start"], r["end"]) for r in ranges):
        spans += start > end
        if stop > max(at, start):
            out.append(body[at : max(start, at)])
            removed += stop - max(start, at)
            at = stop
        end = max(end, stop)
    out.append(body[at:])
    return len(body), removed, spans, b"".join(out)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = repeat_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
