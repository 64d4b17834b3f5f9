"""Mapping selected features back to clusters, proteins, importances and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictive_features(names: list[str], kinds: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Feature columns by kind, from the text before ``c_`` in their names."""
    kinds = kinds or {"s": "strain", "p": "phage"}
    out: dict[str, list[str]] = {kind: [] for kind in kinds.values()}
    for name in names:
        for prefix, kind in kinds.items():
            if name.startswith(f"{prefix}c_"):
                out[kind].append(name)
    return out


def predictive_proteins(selected: DataFrame, features: DataFrame, clusters: DataFrame) -> DataFrame:
    """(feature, cluster, protein_id, unique_clusters, unique_proteins) of the selected features."""
    picked = features.join(selected.select("feature").distinct(), "feature", "left_semi")
    rows = picked.join(clusters, "cluster", "left")
    # Pairs are dealt out before they are told apart: where few repeat, a task of the join would hold all of its own.
    proteins = rows.select("feature", "protein_id").repartition("feature", "protein_id").distinct()
    counts = picked.groupBy("feature").agg(F.countDistinct("cluster").alias("unique_clusters")).join(proteins.groupBy("feature").agg(F.count("protein_id").alias("unique_proteins")), "feature")
    return rows.join(counts, "feature")


def feature_overview(proteins: DataFrame, genomes: DataFrame, assignments: DataFrame) -> DataFrame:
    """Predictive proteins with their genome, where that genome is assigned the feature."""
    return proteins.join(genomes, "protein_id").join(assignments.select("genome", "feature").distinct(), ["genome", "feature"])


def importance_rollup(importances: DataFrame, shap: DataFrame) -> DataFrame:
    """(feature, importance, shap): means over the runs, features known to both, best first."""
    a = importances.groupBy("feature").agg(F.avg("importance").alias("importance"))
    b = shap.groupBy("feature").agg(F.avg(F.abs(F.col("shap_value"))).alias("shap"))
    return a.join(b, "feature").orderBy(F.col("importance").desc(), "feature")


def annotate(proteins: DataFrame, annotations: DataFrame, key: str = "protein_id") -> DataFrame:
    return proteins.join(annotations.withColumnRenamed(key, "protein_id"), "protein_id")


def extract_sequences(sequences: DataFrame, proteins: DataFrame) -> DataFrame:
    return sequences.join(proteins.select("protein_id").distinct(), "protein_id", "left_semi")


def scaled_by_max(rows: DataFrame, group: str, value: str, out: str = "scaled") -> DataFrame:
    """``value`` over its group's largest one; null where that is 0."""
    most = rows.groupBy(group).agg(F.max(value).alias("_m"))
    return rows.join(most, group).withColumn(out, F.try_divide(F.col(value), F.col("_m"))).drop("_m")


def family_members(families: DataFrame, proteins: DataFrame) -> DataFrame:
    """(protein_id, family, member): all members of the first family of each protein."""
    first = first_per_key(families.select("protein_id", "cluster").distinct(), "protein_id", ["cluster"]).join(proteins.select("protein_id").distinct(), "protein_id", "left_semi")
    return first.join(families.select("cluster", F.col("protein_id").alias("member")).distinct(), "cluster").select("protein_id", F.col("cluster").alias("family"), "member")


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: first file wins where ids repeat."""
    picked = F.min(F.struct(*order, *[c for c in rows.columns if c not in order])).alias("_first")
    return rows.groupBy(F.col(key).alias("_key")).agg(picked).select(*[F.col(f"_first.{c}").alias(c) for c in rows.columns])
