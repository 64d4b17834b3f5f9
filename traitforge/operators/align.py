"""Search by alignment, families by set cover, and alignments of families.

Search seeds and extends: pairs that share enough k-mers (by the exact prefix filter of
``cluster``) get the diagonal on which most of these lie, and are aligned around it, in a band,
with affine gaps. Tasks align batches of pairs, row by row of the dynamic program for all pairs of a
batch at once.

Families: proteins in order of their number of neighbours, then length, then name; one that no
representative before it is a neighbour of is a representative, and takes its neighbours.
Each round decides all proteins that no undecided neighbour comes before, so chains of unlike
proteins are never one family, and the outcome is that of going through them one by one.

Alignments of a family: every member is aligned to the family's representative from end to end, the
widest insertion of any member before each place of it (one aggregation) gives the columns, and each
member's row is laid out on its own; no family is in one task.

Defined results: sequences are compared in upper case, ``*`` left out; empty or null ones have no
hits, and are all gaps in an alignment; places count from 1, ends included; of equally good
paths substitution comes before a gap in the target, and that before one in the query; of equally
good ends the first in the query, then in the target; of equally full diagonals the least.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize
from . import cluster
from .prefix import numbered

#: Residues that are alike.
ALIKE = ("AGPST", "C", "DENQ", "FWY", "HKR", "ILMV")
#: Cells of the dynamic program that a task holds.
CELLS = 24_000_000
BAND = 32


@dataclass(frozen=True)
class Scoring:
    """Scores of equal, alike and other residues, what the first and each further gap cost, and the
    factor of expected hits by chance."""

    same: int = 5
    alike: int = 1
    other: int = -2
    first_gap: int = 8
    gap: int = 1
    factor: float = 0.1

    def table(self) -> np.ndarray:
        """Scores by the bytes of two residues."""
        out = np.full((256, 256), self.other, np.int32)
        for group in ALIKE:
            codes = np.frombuffer(group.encode(), np.uint8)
            out[np.ix_(codes, codes)] = self.alike
        np.fill_diagonal(out, self.same)
        return out

    def scale(self) -> float:
        """The scale of chance scores: where the mean of exp(scale * score) is 1 for residues that are
        equally frequent."""
        n = sum(map(len, ALIKE))
        same, alike = 1 / n, sum((len(g) / n) ** 2 for g in ALIKE) - 1 / n
        mean = lambda x: same * math.exp(x * self.same) + alike * math.exp(x * self.alike) + (1 - same - alike) * math.exp(x * self.other)
        low, high = 1e-6, 5.0
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if mean(middle) < 1 else (low, middle)
        return low


NONE = -(1 << 28)
#: What a cell of the program comes from, and whether its gaps go on.
STOP, BOTH, QUERY, TARGET, QUERY_ON, TARGET_ON = 0, 1, 2, 3, 4, 8


def align_batch(queries: list[bytes], targets: list[bytes], centres: list[int], band: int, s: Scoring, whole: bool) -> list[tuple[int, int, int, bytes]]:
    """(score, first query place, first target place, path) of each pair, in the band of diagonals
    around its centre. Paths are of M, Q (a query residue alone) and T. With ``whole`` both are aligned
    from end to end, else as well as any parts can be; then a score of 0 has an empty path."""
    p, width = len(queries), 2 * band + 1
    n = max(map(len, queries))
    q = np.zeros((p, n), np.uint8)
    for k, x in enumerate(queries):
        q[k, : len(x)] = np.frombuffer(x, np.uint8)
    m = np.array([len(t) for t in targets])
    t = np.zeros((p, int(m.max()) + 1), np.uint8)
    for k, x in enumerate(targets):
        t[k, : len(x)] = np.frombuffer(x, np.uint8)
    length, table, rows = np.array([len(x) for x in queries]), s.table(), np.arange(p)[:, None]
    shift = np.array(centres)[:, None] + np.arange(width)[None, :] - band  # target place less query place
    came = np.zeros((n, p, width), np.uint8)
    slope = s.gap * np.arange(width, dtype=np.int64)
    edge = lambda j: -(s.first_gap + s.gap * j)
    if whole:
        j = shift - 1
        above = np.where(j == -1, 0, np.where(j >= 0, edge(j), NONE)).astype(np.int64)
    else:
        above = np.zeros((p, width), np.int64)
    gap_above = np.full((p, width), NONE, np.int64)
    best, where = np.zeros(p, np.int64), np.full((p, 2), -1)
    last = np.full((p, 1), NONE, np.int64)
    for i in range(n):
        j = shift + i
        inside = (j >= 0) & (j < m[:, None])
        score = table[q[:, i][:, None], t[rows, np.clip(j, 0, t.shape[1] - 1)]]
        open_gap, go_on = np.hstack([above[:, 1:], last]) - s.first_gap, np.hstack([gap_above[:, 1:], last]) - s.gap
        gap = np.maximum(open_gap, go_on)
        both = above + score
        here = np.maximum(both, gap)
        if not whole:
            here = np.maximum(here, 0)
        if whole:
            here = np.where(j == -1, edge(i), here)
            here = np.where(inside | (j == -1), here, NONE)
        else:
            here = np.where(inside, here, 0)
        # A gap in the query goes on from the best place before it in this row.
        before = np.maximum.accumulate(here + slope, 1)
        side = np.full((p, width), NONE, np.int64)
        side[:, 1:] = before[:, :-1] - s.first_gap - slope[:-1]
        total = np.where(inside, np.maximum(here, side), here)
        came_from = np.where(total == both, BOTH, np.where(total == gap, QUERY, TARGET)).astype(np.uint8)
        if not whole:
            came_from[total <= 0] = STOP
        came_from = np.where(inside, came_from, np.where(j == -1, QUERY, STOP) if whole else STOP).astype(np.uint8)
        side_opens = np.full((p, width), NONE, np.int64)
        side_opens[:, 1:] = here[:, :-1] - s.first_gap
        came[i] = came_from | np.where(go_on > open_gap, QUERY_ON, 0).astype(np.uint8) | np.where(side > side_opens, TARGET_ON, 0).astype(np.uint8)
        if not whole:
            top = np.where(inside & (i < length)[:, None], total, 0)
            at = top.argmax(1)
            better = top[np.arange(p), at] > best
            best = np.where(better, top[np.arange(p), at], best)
            where[better] = np.stack([np.full(p, i), at], 1)[better]
        else:
            end = i == length - 1
            at = m - 1 - i - shift[:, 0]
            ok = end & (at >= 0) & (at < width)
            best[ok] = total[np.flatnonzero(ok), at[ok]]
            where[ok] = np.stack([np.full(p, i), at], 1)[ok]
        above, gap_above = total, np.where(inside, gap, NONE)
    return [_path(came[:, k], int(best[k]), *where[k].tolist(), int(shift[k, 0]), whole) for k in range(p)]


def _path(came: np.ndarray, score: int, i: int, w: int, first: int, whole: bool) -> tuple[int, int, int, bytes]:
    path, state, j = bytearray(), STOP, first + w + i
    while i >= 0 and 0 <= w < came.shape[1] and j >= 0:
        code = int(came[i, w])
        if state == STOP:
            state = code & 3
            if state == STOP:
                break
        if state == BOTH:
            path += b"M"
            i, j, state = i - 1, j - 1, STOP
        elif state == QUERY:
            path += b"Q"
            state = QUERY if code & QUERY_ON else STOP
            i, w = i - 1, w + 1
        else:
            path += b"T"
            state = TARGET if code & TARGET_ON else STOP
            w, j = w - 1, j - 1
    if whole:  # what is left stands before the other's begin
        path += b"Q" * (i + 1) + b"T" * (j + 1)
        i = j = -1
    return score, i + 1, j + 1, bytes(path[::-1])


def _clean(text: str | None) -> bytes:
    return (text or "").replace("*", "").upper().encode("ascii", "replace")


def align_pairs(pairs: list[tuple[bytes, bytes, int, int]], s: Scoring, whole: bool) -> list[tuple[int, int, int, bytes]]:
    """The alignments of (query, target, centre, band), dealt into batches of like size."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][3], len(pairs[k][0])))
    batch: list[int] = []

    def flush() -> None:
        if batch:
            band = pairs[batch[-1]][3]
            for k, r in zip(batch, align_batch([pairs[k][0] for k in batch], [pairs[k][1] for k in batch], [pairs[k][2] for k in batch], band, s, whole), strict=True):
                out[k] = r
            batch.clear()

    for k in order:
        query, target, _, band = pairs[k]
        if not query or not target:
            out[k] = (0, 0, 0, b"Q" * len(query) + b"T" * len(target) if whole else b"")
            continue
        if batch and (pairs[batch[0]][3] != band or (len(batch) + 1) * len(query) * (2 * band + 1) > CELLS or len(batch) >= 512):
            flush()
        batch.append(k)
    flush()
    return out


HITS = "query string, target string, score double, identity double, e_value double, query_start int, query_end int, query_length int, target_start int, target_end int, target_length int, raw long, columns int, gaps int"


def seeds(queries: DataFrame, targets: DataFrame, k: int, least_shared: float, most: int = 1000) -> DataFrame:
    """(query, target, centre): pairs of which one shares ``least_shared`` of its k-mers with the
    other, and the diagonal that most of the shared ones lie on."""
    q, t = (cluster.kmer_sets(df, k).withColumnRenamed("protein_id", c) for df, c in ((queries, "query"), (targets, "target")))
    up, down = cluster._candidates(q, t, "query", "target", least_shared, most), cluster._candidates(t, q, "target", "query", least_shared, most)
    pairs = materialize(up.unionByName(down).distinct(), "pairs")
    placed = lambda df, name, at: df.select(F.col("protein_id").alias(name), F.posexplode(_kmers("sequence", k)).alias(at, "kmer"))
    shared = pairs.join(placed(queries, "query", "i"), "query").join(placed(targets, "target", "j"), ["target", "kmer"])
    on = shared.groupBy("query", "target", (F.col("j") - F.col("i")).alias("centre")).agg(F.count(F.lit(1)).alias("n"))
    return on.groupBy("query", "target").agg(F.max_by("centre", F.struct(F.col("n"), -F.col("centre"))).alias("centre"))


def _kmers(column: str, k: int):
    from ..functions.sequences import kmers

    return kmers(F.upper(column), k)


def alignment_hits(queries: DataFrame, targets: DataFrame, k: int = 5, least_identity: float = 0.0, coverage: float = 0.0, least_shared: float = 0.2, band: int = BAND, scoring: Scoring | None = None, most_expected: float = 10.0) -> DataFrame:
    """Local alignments (``HITS``) of ``queries`` with ``targets`` (protein_id, sequence) that share
    seeds: score in bits, share of equal residues among the aligned columns, expected number of hits by
    chance in all targets, ranges and lengths; ``coverage`` is of both sides."""
    s = scoring or Scoring()
    scale, factor = s.scale(), s.factor
    clean = lambda df, name, text: df.select(F.col("protein_id").cast("string").alias(name), F.col("sequence").alias(text))
    found = seeds(queries.withColumn("protein_id", F.col("protein_id").cast("string")), targets.withColumn("protein_id", F.col("protein_id").cast("string")), k, least_shared)
    # One number against all rows: the residues there are to hit by chance.
    total = targets.agg(F.coalesce(F.sum(F.length(F.replace("sequence", F.lit("*"), F.lit("")))), F.lit(0)).alias("residues"))
    rows = found.join(clean(queries, "query", "a"), "query").join(clean(targets, "target", "b"), "target").crossJoin(F.broadcast(total)).select("query", "target", "a", "b", "centre", "residues")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, centre, residues = ([_clean(x) for x in batch.column(c).to_pylist()] if c < 4 else batch.column(c).to_pylist() for c in (2, 3, 4, 5))
            done = align_pairs([(x, y, d, band) for x, y, d in zip(a, b, centre, strict=True)], s, False)
            names, out = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), []
            for (query, target), x, y, r, (raw, i, j, path) in zip(names, a, b, residues, done, strict=True):
                if not path:
                    continue
                equal, qi, tj = 0, i, j
                for c in path:
                    if c == 77:
                        equal += x[qi] == y[tj]
                    qi, tj = qi + (c != 84), tj + (c != 81)
                bits = (scale * raw - math.log(factor)) / math.log(2)
                gaps = len(path) - path.count(b"M")
                out.append((query, target, bits, equal / len(path), factor * len(x) * r * math.exp(-scale * raw), i + 1, qi, len(x), j + 1, tj, len(y), raw, len(path), gaps))
            columns = list(zip(*out, strict=True)) or [()] * 14
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _HIT_TYPES, strict=True)], names=[f.split()[0] for f in HITS.split(", ")])

    hits = rows.mapInArrow(work, HITS)
    covered = lambda side: (F.col(f"{side}_end") - F.col(f"{side}_start") + 1) / F.col(f"{side}_length")
    hits = hits.withColumns({"query_coverage": covered("query"), "target_coverage": covered("target")})
    return hits.filter((F.col("identity") >= least_identity) & (F.col("query_coverage") >= coverage) & (F.col("target_coverage") >= coverage) & (F.col("e_value") <= most_expected))


_HIT_TYPES = [{"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]] for f in HITS.split(", ")]


def cover_families(proteins: DataFrame, links: DataFrame) -> DataFrame:
    """(cluster, protein_id): families by greedy set cover of ``links`` (query, target), named by
    their representatives."""
    both = links.select(F.col("query").alias("u"), F.col("target").alias("v")).filter("u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "kin")
    known = proteins.filter("protein_id IS NOT NULL").groupBy("protein_id").agg(F.max(F.length("sequence")).alias("length"))
    degree = both.groupBy(F.col("u").alias("protein_id")).agg(F.count(F.lit(1)).alias("n"))
    ranked = known.join(degree, "protein_id", "left").select("protein_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("length", F.lit(0)).alias("length"))
    order = materialize(numbered(ranked, [F.desc("n"), F.desc("length"), F.col("protein_id")], "p").select("protein_id", "p"), "order")
    end = lambda c, p: order.select(F.col("protein_id").alias(c), F.col("p").alias(p))
    edges = materialize(both.join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b"), "edges")
    open_ones, left, chosen = order.select("p"), edges, None
    while not open_ones.isEmpty():
        first = left.groupBy("a").agg(F.min("b").alias("least"))
        found = materialize(open_ones.join(first, F.col("p") == F.col("a"), "left").filter("least IS NULL OR least > p").select("p"), "chosen")
        chosen = found if chosen is None else chosen.unionByName(found)
        taken = materialize(left.join(found, F.col("b") == F.col("p")).select(F.col("a").alias("q")).unionByName(found.select(F.col("p").alias("q"))).distinct(), "taken")
        open_ones = materialize(open_ones.join(taken, F.col("p") == F.col("q"), "left_anti"), "open")
        left = materialize(left.join(taken, F.col("a") == F.col("q"), "left_anti").join(taken, F.col("b") == F.col("q"), "left_anti"), "edges")
    if chosen is None:
        return proteins.select(F.col("protein_id").alias("cluster"), "protein_id").limit(0)
    heads = chosen.select(F.col("p").alias("head"))
    joined = edges.join(heads, F.col("b") == F.col("head")).groupBy("a").agg(F.min("head").alias("head"))
    own = heads.select(F.col("head").alias("a"), "head")
    members = joined.join(own.select(F.col("a").alias("h")), F.col("a") == F.col("h"), "left_anti").unionByName(own)
    return members.join(end("protein_id", "a"), "a").join(end("cluster", "head"), "head").select("cluster", "protein_id")


def protein_families(proteins: DataFrame, k: int = 5, least_identity: float = 0.4, coverage: float = 0.8, **options) -> DataFrame:
    """(cluster, protein_id): families whose members align with their representative."""
    hits = alignment_hits(proteins, proteins, k, least_identity, coverage, **options)
    return cover_families(proteins, hits.select("query", "target"))


_LAID = "family string, protein_id string, body string, inserted array<struct<at:int,text:string>>"


def align_families(members: DataFrame, scoring: Scoring | None = None, band: int = BAND) -> DataFrame:
    """(family, protein_id, aligned) of ``members`` (family, protein_id, sequence), whose families are
    named by one of their members; a family without that one has no alignment."""
    s = scoring or Scoring()
    rows = members.select(F.col("family").cast("string").alias("family"), F.col("protein_id").cast("string").alias("protein_id"), "sequence").dropDuplicates(["family", "protein_id"])
    rows = materialize(rows, "members")
    heads = rows.filter("family = protein_id").select(F.col("family").alias("head"), F.col("sequence").alias("centre"))
    joined = rows.join(heads, F.col("family") == F.col("head")).select("family", "protein_id", "sequence", "centre")
    kind = pa.schema([("family", pa.string()), ("protein_id", pa.string()), ("body", pa.string()), ("inserted", pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())])))])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, centre = ([_clean(x) for x in batch.column(c).to_pylist()] for c in (2, 3))
            done = align_pairs([(x, y, 0, band + abs(len(x) - len(y))) for x, y in zip(own, centre, strict=True)], s, True)
            out = []
            for family, protein, x, (_, _, _, path) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own, done, strict=True):
                body, inserted, i = bytearray(), {}, 0
                for c in path:
                    if c == 81:
                        inserted.setdefault(len(body), bytearray()).append(x[i])
                    else:
                        body.append(x[i] if c == 77 else 45)
                    i += c != 84
                out.append({"family": family, "protein_id": protein, "body": body.decode(), "inserted": [{"at": at, "text": text.decode()} for at, text in inserted.items()]})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    laid = materialize(joined.mapInArrow(lay, _LAID), "laid")
    wide = laid.select("family", F.explode("inserted").alias("x")).groupBy("family", F.col("x.at").alias("at")).agg(F.max(F.length("x.text")).alias("width"))
    columns = wide.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("at", "width"))).alias("columns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body, inserted, widths in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                held, parts, at = {x["at"]: x["text"] for x in inserted}, [], 0
                for w in widths or []:
                    parts += [body[at : w["at"]], held.get(w["at"], "").ljust(w["width"], "-")]
                    at = w["at"]
                texts.append("".join([*parts, body[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["family", "protein_id", "aligned"])

    return laid.join(columns, "family", "left").select("family", "protein_id", "body", "inserted", "columns").mapInArrow(write, "family string, protein_id string, aligned string")
