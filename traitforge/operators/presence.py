"""Best hits, presence relations, and the collapse of features that always occur together.

Presence is kept in long form, (genome, cluster), one row for each that is there; wide tables are
made only on export, over a stated list of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .prefix import numbered


def best_hits(hits: DataFrame, query: str, order: list[Column]) -> DataFrame:
    """The first row of each query by ``order``; give a last key that breaks all ties."""
    ranked = hits.withColumn("_place", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked.filter("_place = 1").drop("_place")


def best_of(hits: DataFrame, query: str, order: list[Column], value: list[str]) -> DataFrame:
    """The same as an aggregation that combines before it shuffles, for ascending ``order``
    expressions: a query with very many hits is never sorted in one task."""
    picked = F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *value))
    return hits.groupBy(query).agg(picked.alias("best")).select(query, *[f"best.{v}" for v in value])


def assign_clusters(best: DataFrame, clusters: DataFrame, target: str, member: str, cluster: str) -> DataFrame:
    """Best hits with their target's cluster, null where the target is in none."""
    return best.join(clusters.select(F.col(member).alias(target), cluster), target, "left")


def count_unassigned(assigned: DataFrame, cluster: str) -> int:
    """How many best hits point at a target that is in no cluster."""
    return assigned.agg(F.count_if(F.col(cluster).isNull())).first()[0]


def compare_clusters(clusters: DataFrame, best: DataFrame, on: str) -> DataFrame:
    """Clustering against search, rows of either side kept."""
    return clusters.join(best, on, "full")


def presence(members: DataFrame, genome: str, cluster: str) -> DataFrame:
    """Distinct (genome, cluster), null keys left out."""
    return members.select(F.col(genome).alias("genome"), F.col(cluster).alias("cluster")).na.drop().distinct()


def wide(present: DataFrame, row: str, column: str, columns: list[str], universe: DataFrame | None = None) -> DataFrame:
    """One 0/1 column for each of ``columns``; rows of ``universe`` that hold none are all zero."""
    table = present.groupBy(row).pivot(column, columns).agg(F.lit(1)).na.fill(0)
    if universe is not None:
        table = universe.select(row).distinct().join(table, row, "left").na.fill(0, columns)
    return table


def spread_values(rows: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    """One column for each of ``columns`` with the cell's only value, 0 where there is none; two
    values for one cell stop the job."""
    twice = F.raise_error(F.concat_ws(" ", F.lit("two values for"), F.col(row).cast("string"), F.col(column).cast("string")))
    cells = rows.groupBy(row, column).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias("_v"))
    cells = cells.select(row, column, F.when(F.col("_n") == 1, F.col("_v")).otherwise(twice.cast(rows.schema[value].dataType)).alias("_v"))
    return cells.groupBy(row).pivot(column, columns).agg(F.first("_v")).na.fill(0, [str(c) for c in columns])


def long(table: DataFrame, row: str, columns: list[str], name: str = "cluster") -> DataFrame:
    """(row, name) for the cells of a wide table that are 1."""
    return table.unpivot([row], columns, name, "value").filter("value = 1").drop("value")


def binarise(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.withColumns({c: (F.col(c) > 0).cast("int") for c in columns})


def shared_clusters(present: DataFrame, genomes: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Rows of clusters that occur in at least ``least`` of the listed genomes."""
    rows = present if genomes is None else present.join(genomes.select("genome").distinct(), "genome", "left_semi")
    common = rows.groupBy("cluster").agg(F.countDistinct("genome").alias("n")).filter(F.col("n") >= least)
    return rows.join(common.select("cluster"), "cluster", "left_semi")


def collapse(present: DataFrame, prefix: str = "s", order: str = "cluster") -> DataFrame:
    """(cluster, feature): clusters with the same set of genomes share one feature.

    Features are numbered by the first cluster, by ``order``, that belongs to them. A set is known by
    its size and the sums of two 60-bit pieces of its members' SHA-256, so that sets of any size
    combine before they are shuffled; the clusters' sets are written once.
    """
    digest = F.sha2(F.col("genome").cast("string"), 256)
    piece = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")
    sets = materialize(present.select("genome", "cluster").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(piece(1)).alias("s1"), F.sum(piece(16)).alias("s2")), "sets")
    key = ["n", "s1", "s2"]
    firsts = numbered(sets.groupBy(*key).agg(F.min(order).alias("first")), [F.col("first")], "at")
    named = firsts.select(*key, F.concat(F.lit(f"{prefix}c_"), F.col("at").cast("string")).alias("feature"))
    return sets.join(named, key).select("cluster", "feature")


def assign_features(present: DataFrame, features: DataFrame) -> DataFrame:
    """Distinct (genome, feature) of a presence relation under a feature map."""
    return present.join(features, "cluster").select("genome", "feature").distinct()


def add_missing_genomes(assigned: DataFrame, universe: DataFrame) -> DataFrame:
    """(genome, feature) with a null feature for genomes that have none."""
    return universe.select("genome").distinct().join(assigned, "genome", "left")


def transfer_features(hits: DataFrame, genomes: DataFrame, features: DataFrame) -> DataFrame:
    """(genome, feature) of new genomes: hits (protein_id, cluster), the proteins' genomes
    (protein_id, genome) and the training map (cluster, feature)."""
    return hits.join(features, "cluster").join(genomes, "protein_id").select("genome", "feature").distinct()
