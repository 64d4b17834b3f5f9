"""From k-mer places in aligned sequences to covered segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.sequences import bound, gap_tolerant_ranges

KEYS = ["feature", "family", "protein_id"]
#: Residues that a task hands over at once.
RESIDUES = 200_000


def kmer_ranges(aligned: DataFrame, gap_aware: bool = False) -> DataFrame:
    """``aligned`` (feature, family, protein_id, aligned, kmer) with ``ranges`` of each k-mer."""
    return aligned.withColumn("ranges", gap_tolerant_ranges(F.col("aligned"), F.col("kmer"), gap_aware))


def covered_residues(aligned: DataFrame, kmers: DataFrame, gap_aware: bool = False) -> DataFrame:
    """(keys, index, residue, coverage): what :func:`kmer_ranges` and :func:`residue_coverage` give for
    every feature of ``kmers`` (feature, family, protein_id, kmer) in ``aligned`` (family, protein_id,
    aligned), in time linear in the residues, whatever the number of k-mers.

    A protein's k-mers meet its residues once: every substring of their lengths is looked up, the
    ranges of a feature are united on a line, and only then residues become rows.
    """
    keys = ["family", "protein_id"]
    # Dealt out by protein before anything is aggregated: a small file may be one task.
    asked = kmers.select(*KEYS, "kmer").repartition(*keys).groupBy(*keys).agg(F.collect_set(F.struct("feature", "kmer")).alias("asked"))
    rows = aligned.select(*keys, "aligned").repartition(*keys).dropDuplicates().join(asked, keys).select(*keys, "aligned", "asked")
    feature, own = kmers.schema["feature"], [aligned.schema[k] for k in keys]
    schema = T.StructType([feature, *own, *T._parse_datatype_string("index int, residue string, coverage int").fields])
    at = rows.columns.index("asked")

    kind = rows.schema["asked"].dataType.elementType["feature"].dataType

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], 0
            for r, (text, wanted) in enumerate(zip(batch.column("aligned").to_pylist(), batch.column(at).to_pylist(), strict=True)):
                if text is not None:
                    found.append((r, *_covered(text, wanted, gap_aware)))
                    n += found[-1][2].size
                if n >= RESIDUES:
                    yield together(batch, found)
                    found, n = [], 0
            if found:
                yield together(batch, found)

    def together(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        """One batch of the residues of many proteins, feature by feature in each."""
        sizes = np.array([covered.size for _, _, covered, *_ in found])
        of = pa.array(np.repeat([r for r, *_ in found], sizes))
        lengths = np.concatenate([np.full(len(names), len(place)) for _, names, _, place, _ in found])
        names = pa.array([f for _, names, *_ in found for f in names], to_arrow_type(kind)).take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
        place = np.concatenate([np.tile(place, len(names)) for _, names, _, place, _ in found]).astype(np.int32)
        letters = np.concatenate([np.tile(letters, len(names)) for _, names, _, _, letters in found])
        covered = np.concatenate([covered.ravel() for _, _, covered, *_ in found])
        columns = [names, *[batch.column(c).take(of) for c in keys], pa.array(place), pa.array(letters.tolist(), pa.string()), pa.array(covered)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(walk, schema)


def _covered(text: str, wanted: list[dict], gap_aware: bool) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(features, coverage by feature and residue, the residues' places, the residues) of one protein."""
    letters = np.array(list(text), "U1")
    place = np.flatnonzero(letters != "-")
    plain = text.replace("-", "")
    names = list(dict.fromkeys(x["feature"] for x in wanted))
    number = {f: i for i, f in enumerate(names)}
    table: dict[str, list[int]] = {}
    for x in wanted:
        if x["kmer"]:
            table.setdefault(x["kmer"], []).append(number[x["feature"]])
    # Where ranges begin and end, for each feature, on the line of the alignment.
    edges = np.zeros((len(names), len(text) + 1), np.int32)
    for k in {len(m) for m in table}:
        for i in range(len(plain) - k + 1):
            for f in table.get(plain[i : i + k], ()):
                start = place[i]
                stop = place[i + k - 1] if gap_aware else start + k - 1
                edges[f, start] += 1
                edges[f, min(stop + 1, len(text))] -= 1
    covered = (np.cumsum(edges, 1)[:, :-1][:, place] > 0).astype(np.int32)
    return names, covered, place, letters[place]


def residue_coverage(ranges: DataFrame) -> DataFrame:
    """(keys, index, residue, coverage): 1 where some k-mer of the protein covers the residue.

    Gaps are no residues. Rows are dealt out by their keys and the ranges of equal sequences united, so
    only the result is as long as the residues; different sequences with the same keys are united in order of index.
    """
    own = ranges.filter("aligned IS NOT NULL").select(*KEYS, "aligned", "ranges").repartition(*KEYS)
    united = own.groupBy(*KEYS, "aligned").agg(F.when(F.count("ranges") > 0, F.flatten(F.collect_list("ranges"))).alias("ranges"))
    texts = united.groupBy(*KEYS).agg(F.collect_list(F.struct("aligned", "ranges")).alias("texts"))

    def marked(text: Column) -> Column:
        hit = lambda i: F.exists(text["ranges"], lambda x: i.between(x["start"], x["stop"])).cast("int")
        each = F.transform(F.split(text["aligned"], ""), lambda r, i: F.struct(i.alias("index"), r.alias("residue"), F.coalesce(-hit(i), F.lit(1)).alias("miss")))
        return F.filter(each, lambda m: ~m["residue"].isin("-", ""))

    def firsts(rows: Column) -> Column:
        """Of equal index and residue the first, that is the covered one if any is."""
        before = lambda i: F.get(rows, i - 1)
        return F.filter(rows, lambda m, i: (i == 0) | (before(i)["index"] != m["index"]) | (before(i)["residue"] != m["residue"]))

    one = bound(F.get("texts", F.lit(0)), marked)
    many = bound(F.sort_array(F.flatten(F.transform("texts", marked))), firsts)
    rows = texts.select(*KEYS, F.explode(F.when(F.size("texts") == 1, one).otherwise(many)).alias("m"))
    return rows.select(*KEYS, F.col("m.index").alias("index"), F.col("m.residue").alias("residue"), F.when(F.col("m.miss") < 1, -F.col("m.miss")).alias("coverage"))


def segments(covered: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, flag: str = "coverage") -> DataFrame:
    """(keys, coverage, segment_id, start, stop): runs of equal coverage, stop exclusive; skipped
    indices, that is gaps, lie inside a run. ``order`` is the index, with tie breaks after it."""
    keys = KEYS if keys is None else keys
    order = ["index"] if order is None else order
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    running = covered.withColumn("_c", changed).withColumn("segment_id", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return running.groupBy(*keys, F.col(flag).alias("coverage"), "segment_id").agg(F.min(order[0]).alias("start"), (F.max(order[0]) + 1).alias("stop"))


def add_uncovered(found: DataFrame, aligned: DataFrame) -> DataFrame:
    """Segments, and for each protein without one a row of coverage 0 over all its residues, with
    null feature and segment."""
    rest = aligned.join(found.select("protein_id").distinct(), "protein_id", "left_anti").select("family", "protein_id", "aligned").distinct()
    whole = rest.select("family", "protein_id", F.lit(0).alias("coverage"), F.lit(0).alias("start"), F.length(F.replace("aligned", F.lit("-"), F.lit(""))).alias("stop"))
    return found.unionByName(whole, allowMissingColumns=True)


def trim_leading_gaps(aligned: DataFrame) -> DataFrame:
    """Alignments without the leading gaps that all of a family's sequences share, and each one's
    ``start_index`` (its own remaining leading gaps)."""
    lead = F.length("aligned") - F.length(F.ltrim(F.col("aligned"), F.lit("-")))
    shared = aligned.groupBy("family").agg(F.min(lead).alias("shared"))
    cut = aligned.join(shared, "family").withColumn("aligned", F.expr("substring(aligned, shared + 1)"))
    return cut.withColumn("start_index", lead).drop("shared")
