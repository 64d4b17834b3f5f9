"""K-mer relations and identifier repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import at_least
from ..functions.sequences import kmer_range, kmers


def explode_kmers(proteins: DataFrame, k: int, keep: list[str], sequence: str = "sequence") -> DataFrame:
    """One row for each occurrence: the columns ``keep`` and ``kmer``. Proteins are dealt out first, since
    the k-mers of a small file, which is one task, may be many; streams stay as they are."""
    used = list(dict.fromkeys([*keep, sequence]))
    dealt = proteins if proteins.isStreaming else proteins.select(*used).repartition(*used)
    return dealt.select(*keep, F.explode(kmers(F.col(sequence), k)).alias("kmer"))


def explode_kmer_range(proteins: DataFrame, least: int, most: int, keep: list[str], sequence: str = "sequence") -> DataFrame:
    """The same for every k of a range in one pass, with a column ``k``."""
    return proteins.select(*keep, F.explode(kmer_range(F.col(sequence), least, most)).alias("item")).select(*keep, "item.k", "item.kmer")


def kmer_support(occurrences: DataFrame, group: list[str], protein: str = "protein_id", one_gene: bool = False) -> DataFrame:
    """Distinct proteins of each k-mer (within ``group`` columns besides it), of those in more than
    one protein; with ``one_gene`` in any. Rows with a null key vanish."""
    keys = ["kmer", *group]
    clean = occurrences.na.drop(subset=[*keys, protein])
    counted = clean.groupBy(*keys).agg(F.countDistinct(protein).alias("proteins"))
    return counted.filter(F.col("proteins") >= (1 if one_gene else 2))


def kmer_features(occurrences: DataFrame, support: DataFrame, group: list[str], genome: str) -> DataFrame:
    """(genome, feature): which genomes hold which supported k-mers, as ``group_kmer`` names."""
    keys = ["kmer", *group]
    name = F.concat_ws("_", *[F.col(g).cast("string") for g in group], F.col("kmer"))
    return occurrences.join(support.select(*keys), keys, "left_semi").select(F.col(genome).alias("genome"), name.alias("feature")).na.drop().distinct()


def contained(pairs: DataFrame, sequence: str = "sequence", kmer: str = "kmer") -> DataFrame:
    """Pairs with ``hit``: 1 where the sequence contains the k-mer, unaltered."""
    return pairs.withColumn("hit", F.contains(F.col(sequence), F.col(kmer)).cast("int"))


def call_features(hits: DataFrame, universe: DataFrame, threshold: float) -> DataFrame:
    """Features called for each genome from k-mer hits.

    ``hits`` has (genome, feature, cluster, kmer, hit); a k-mer counts once for each cluster and
    genome. A feature is present if the share of its k-mers that hit is at least ``threshold``, or,
    for thresholds above 1, their number. ``universe`` (feature) gives the features that every
    genome gets a 0 for.
    """
    clean = hits.na.drop(subset=["genome", "feature", "cluster", "kmer"])
    best = clean.groupBy("genome", "feature", "cluster", "kmer").agg(F.max("hit").alias("hit"))
    calls = best.groupBy("genome", "feature").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    calls = calls.select("genome", "feature", at_least(F.col("hits"), F.col("total"), threshold).cast("int").alias("present"))
    # Features are a selected list, and genomes few beside their rows: the grid is the output.
    grid = clean.select("genome").distinct().crossJoin(universe.select("feature").distinct())
    return grid.join(calls, ["genome", "feature"], "left").fillna(0, ["present"])


def duplicate_ids(proteins: DataFrame, id_col: str) -> DataFrame:
    return proteins.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def rewrite_ids(proteins: DataFrame, id_col: str, genome: str) -> DataFrame:
    """If any id occurs twice, all ids get their genome in front: ``genome::id``."""
    any_twice = duplicate_ids(proteins, id_col).agg((F.count(F.lit(1)) > 0).alias("twice"))
    name = F.when(F.col("twice"), F.concat_ws("::", F.col(genome).cast("string"), F.col(id_col).cast("string"))).otherwise(F.col(id_col).cast("string"))
    # One row against all: no more than a flag is sent around.
    return proteins.crossJoin(F.broadcast(any_twice)).withColumn(id_col, name).drop("twice")
