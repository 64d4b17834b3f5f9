"""Protein families and genome clusters as joins and components.

Families come from shared k-mers: proteins that share enough of them are linked, and linked
proteins form a family named by its smallest member. Candidates come from a prefix filter that
loses no pair: a protein that shares enough k-mers with a larger one shares one of its rarest.
"""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize
from . import presence, sequence
from .graph import components


def kmer_sets(proteins: DataFrame, k: int, id_col: str = "protein_id") -> DataFrame:
    return sequence.explode_kmers(proteins, k, [id_col]).distinct()


def _candidates(small: DataFrame, large: DataFrame, small_id: str, large_id: str, least: float, most: int) -> DataFrame:
    """Pairs in which ``small`` has no more k-mers than ``large`` and one of its ``n - ceil(least * n)
    + 1`` k-mers that are rarest in ``large`` is shared; all pairs that share ``least`` of it are."""
    holders = large.groupBy("kmer").agg(F.count(F.lit(1)).alias("holders"))
    own = Window.partitionBy(small_id)
    ranked = small.join(holders, "kmer", "left").withColumn("ns", F.count(F.lit(1)).over(own)).withColumn("at", F.row_number().over(own.orderBy(F.coalesce("holders", F.lit(0)), "kmer")))
    needed = F.greatest(F.lit(1), F.ceil(F.col("ns") * least - 1e-9))
    seeds = ranked.filter(F.col("holders").isNotNull() & (F.col("at") <= F.col("ns") - needed + 1))
    blocks = F.ceil(F.col("holders") / most)
    seeds = seeds.select(small_id, "kmer", "ns", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    held = large.join(holders, "kmer").withColumn("nl", F.count(F.lit(1)).over(Window.partitionBy(large_id)))
    held = held.select(large_id, "kmer", "nl", F.pmod(F.xxhash64(large_id), blocks).alias("block"))
    return seeds.join(held, ["kmer", "block"]).filter("ns <= nl").select(small_id, large_id).distinct()


def homology_hits(queries: DataFrame, targets: DataFrame, k: int = 5, least_identity: float = 0.4, coverage: float = 0.0, most: int = 1000) -> DataFrame:
    """(query, target, identity, query_coverage, target_coverage) of pairs whose k-mer sets overlap.

    Identity is the share of k-mers of the shorter side that the other has. The side with fewer
    k-mers looks for the other by its rarest ones, one more than it may lack, so no pair is lost.
    K-mers with more than ``most`` holders are joined in blocks of about so many.
    """
    q = kmer_sets(queries, k).withColumnRenamed("protein_id", "query")
    t = kmer_sets(targets, k).withColumnRenamed("protein_id", "target")
    least = max(least_identity, coverage)
    up = _candidates(q, t, "query", "target", least, most)
    down = _candidates(t, q, "target", "query", least, most)
    pairs = up.unionByName(down).distinct()
    sizes_q = q.groupBy("query").agg(F.count(F.lit(1)).alias("nq"))
    sizes_t = t.groupBy("target").agg(F.count(F.lit(1)).alias("nt"))
    shared = pairs.join(q, "query").join(t, ["target", "kmer"]).groupBy("query", "target").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.join(sizes_q, "query").join(sizes_t, "target")
    out = scored.select("query", "target", (F.col("shared") / F.least("nq", "nt")).alias("identity"), (F.col("shared") / F.col("nq")).alias("query_coverage"), (F.col("shared") / F.col("nt")).alias("target_coverage"))
    return out.filter((F.col("identity") >= least_identity) & (F.col("query_coverage") >= coverage) & (F.col("target_coverage") >= coverage))


def protein_families(proteins: DataFrame, k: int = 5, least_identity: float = 0.4, coverage: float = 0.8, most: int = 1000) -> DataFrame:
    """(cluster, protein_id): families named by their smallest member; proteins without kin are
    families of one."""
    hits = materialize(homology_hits(proteins, proteins, k, least_identity, coverage, most).filter("query < target"), "kin")
    joined = components(hits.select(F.col("query").alias("src"), F.col("target").alias("dst")))
    members = proteins.select("protein_id").distinct().join(joined.withColumnRenamed("node", "protein_id"), "protein_id", "left")
    return members.select(F.coalesce("component", "protein_id").alias("cluster"), "protein_id")


def genome_clusters(table: DataFrame, genome: str, features: list[str], k: int, seed: int = 0) -> DataFrame:
    """(genome, group) by bisecting k-means over 0/1 vectors, a divisive hierarchy that Spark
    builds over all executors; at most one group fewer than there are genomes."""
    rows = VectorAssembler(inputCols=features, outputCol="_v").transform(table.select(genome, *features))
    n = rows.count()
    model = BisectingKMeans(k=max(1, min(k, n - 1)), seed=seed, featuresCol="_v", predictionCol="group").fit(rows)
    return model.transform(rows).select(genome, "group")


def dense_groups(present: DataFrame, least_similarity: float = 0.8, least_neighbours: int = 2) -> DataFrame:
    """(genome, group): density clusters of genomes by the Jaccard similarity of their features.

    Genomes with enough neighbours are cores; linked cores and their neighbours form a group;
    what is left over is a group of its own. Two genomes that are similar enough share one of the
    rarest features of the smaller one, so only those that do are compared: common features pair
    nobody.
    """
    rows = present.select("genome", "cluster").distinct()
    sizes = rows.groupBy("genome").agg(F.count(F.lit(1)).alias("n"))
    small, large = (rows.select(F.col("genome").alias(c), F.col("cluster").alias("kmer")) for c in ("a", "b"))
    pairs = _candidates(small, large, "a", "b", least_similarity, 1000).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    shared = pairs.join(small, "a").join(large, ["b", "kmer"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"))
    near = shared.join(sizes.withColumnsRenamed({"genome": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"genome": "b", "n": "nb"}), "b")
    near = materialize(near.filter(F.col("s") >= least_similarity * (F.col("na") + F.col("nb") - F.col("s"))).select("a", "b"), "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cores = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_neighbours).select(F.col("a").alias("core"))
    links = both.join(cores, F.col("a") == F.col("core"), "left_semi")
    core_links = links.join(cores, F.col("b") == F.col("core"), "left_semi")
    of_core = components(core_links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"node": "core", "component": "group"})
    grouped = cores.join(of_core, "core", "left").select("core", F.coalesce("group", "core").alias("group"))
    border = links.join(grouped, F.col("a") == F.col("core")).groupBy(F.col("b").alias("genome")).agg(F.min("group").alias("border"))
    return sizes.select("genome").join(grouped.withColumnRenamed("core", "genome"), "genome", "left").join(border, "genome", "left").select("genome", F.coalesce("group", "border", "genome").alias("group"))


def filter_by_groups(present: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """Presence rows of clusters that occur in at least ``least`` groups of genomes."""
    from .split import group_presence

    rows = present.join(groups, "genome").select(F.col("cluster").alias("feature"), "group")
    return present.join(group_presence(rows, least).select(F.col("feature").alias("cluster")), "cluster", "left_semi")


__all__ = ["dense_groups", "filter_by_groups", "genome_clusters", "homology_hits", "kmer_sets", "presence", "protein_families"]
