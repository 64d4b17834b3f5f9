"""Column expressions over protein sequences, identifiers and k-mers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def kmers(sequence: Column, k: int) -> Column:
    """All overlapping substrings of length ``k``, in order; none if the sequence is shorter."""

    def spread(clean: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(clean) - k + 1), lambda i: F.substring(clean, i, F.lit(k)))
        return F.when(F.length(clean) >= k, found).otherwise(F.array().cast("array<string>"))

    return bound(F.replace(sequence, F.lit("*"), F.lit("")), spread)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row, however often it is used and in whatever
    functions of elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kmer_range(sequence: Column, least: int, most: int) -> Column:
    """(k, kmer) structs for every k from ``least`` to ``most``."""

    def tagged(k: int) -> Column:
        return F.transform(kmers(sequence, k), lambda m: F.struct(F.lit(k).alias("k"), m.alias("kmer")))

    return F.flatten(F.array(*[tagged(k) for k in range(least, most + 1)]))


def genome_of_protein(protein_id: Column) -> Column:
    """The id before `` # ``, without its last ``_`` token."""
    return F.regexp_replace(F.split_part(protein_id, F.lit(" # "), F.lit(1)), "_[^_]*$", "")


def without_suffix(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(1))


def kmer_of_label(label: Column) -> Column:
    return F.substring_index(label, "_", -1)


def family_of_label(label: Column) -> Column:
    return F.regexp_replace(label, "_[^_]*$", "")


def cutoff_of_name(name: Column) -> Column:
    """The number after ``cutoff_``; null where there is none."""
    return F.regexp_extract(name, r"cutoff_(\d+)", 1).try_cast("int")


def file_safe(name: Column) -> Column:
    return F.translate(name, "|/", "__")


def _read(aligned: Column) -> Column:
    """``plain``: the residues without gaps; ``at``: the 1-based place of each."""
    each = F.transform(F.split(aligned, ""), lambda r, i: F.struct(r.alias("r"), (i + 1).alias("i")))
    held = F.filter(each, lambda x: ~x["r"].isin("-", ""))
    return F.struct(F.transform(held, lambda x: x["i"]).alias("at"), F.replace(aligned, F.lit("-"), F.lit("")).alias("plain"))


def _hits(read: Column, kmer: Column) -> Column:
    """1-based places of the k-mer among the residues."""
    last = F.length(read["plain"]) - F.length(kmer) + 1
    found = F.filter(F.sequence(F.lit(1), last), lambda i: F.substring(read["plain"], i, F.length(kmer)) == kmer)
    return F.when((last >= 1) & (F.length(kmer) > 0), found).otherwise(F.array().cast("array<int>"))


def gap_tolerant_starts(aligned: Column, kmer: Column) -> Column:
    """0-based places in an aligned sequence where the k-mer occurs, gaps between residues allowed.

    A start is a residue from which, gaps skipped, the k-mer reads on.
    """
    return bound(_read(aligned), lambda x: F.transform(_hits(x, kmer), lambda i: F.element_at(x["at"], i) - 1))


def gap_tolerant_ranges(aligned: Column, kmer: Column, gap_aware: bool = False) -> Column:
    """(start, stop) of each occurrence, stop inclusive. Without ``gap_aware`` the stop counts the
    k-mer's own length from the start, with it the last residue's place."""

    def ranges(x: Column) -> Column:
        start = lambda i: F.element_at(x["at"], i) - 1
        stop = (lambda i: F.element_at(x["at"], i + F.length(kmer) - 1) - 1) if gap_aware else (lambda i: start(i) + F.length(kmer) - 1)
        return F.transform(_hits(x, kmer), lambda i: F.struct(start(i).alias("start"), stop(i).alias("stop")))

    return bound(_read(aligned), ranges)
