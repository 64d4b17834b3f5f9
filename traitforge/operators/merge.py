"""Merging phenotypes with features, prediction grids, universes and occurrence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_features(phenotypes: DataFrame, strain_features: DataFrame | None, phage_features: DataFrame | None, strain: str = "strain", phage: str = "phage") -> DataFrame:
    """Phenotype rows that have features on every side given; an absent side is skipped."""
    out = phenotypes
    if strain_features is not None:
        out = out.join(strain_features, strain)
    if phage_features is not None:
        out = out.join(phage_features, phage)
    return out


def prediction_grid(strains: DataFrame, phages: DataFrame | None) -> DataFrame:
    """Every phage with every strain; strains alone where there are no phages.

    The grid is the result asked for: each pair is scored. Both sides are lists of genomes.
    """
    return strains if phages is None else phages.crossJoin(strains)


def listed_and_present(listed: DataFrame, present: DataFrame, column: str) -> DataFrame:
    return listed.select(column).intersect(present.select(column))


def absent(listed: DataFrame, present: DataFrame, column: str) -> DataFrame:
    return listed.select(column).distinct().join(present, column, "left_anti")


def selected_features_per_run(rows: int) -> int:
    """How many features to select, from the number of rows."""
    return 50 if rows < 500 else 100 if rows < 2000 else rows // 20


def occurrences(runs: DataFrame, run: str = "run", feature: str = "feature") -> DataFrame:
    """(feature, occurrence): the number of runs that selected it."""
    return runs.select(run, feature).na.drop().distinct().groupBy(feature).agg(F.count(F.lit(1)).alias("occurrence"))


def cutoff_tables(occurrence: DataFrame, cutoffs: list[int], rows: int, least: int | None = None, most: int | None = None, feature: str = "feature") -> DataFrame:
    """(cut_off, feature) for cut-offs that leave more than ``least`` and fewer than ``most``
    features; by default 5 and a tenth of the rows below 500 rows, else 20 and a twentieth."""
    least = (5 if rows < 500 else 20) if least is None else least
    most = (rows // 10 if rows < 500 else rows // 20) if most is None else most
    passed = occurrence.withColumn("cut_off", F.explode(F.array(*map(F.lit, cutoffs)))).filter("occurrence >= cut_off")
    sizes = passed.groupBy("cut_off").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > least) & (F.col("n") < most))
    return passed.join(F.broadcast(sizes.select("cut_off")), "cut_off").select("cut_off", feature)


def drop_null_rows(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return table.na.drop("any", subset=columns)


def require_features(known: set[str], needed: list[str]) -> None:
    """An error that names the features a model needs and the inputs do not know."""
    missing = [c for c in needed if c not in known]
    if missing:
        raise ValueError(f"features missing from the table: {', '.join(missing)}")


def align_columns(table: DataFrame, needed: list[str]) -> DataFrame:
    """The columns a model needs, in its order; the missing ones are named in the error."""
    require_features(set(table.columns), needed)
    return table.select(needed)


def without_columns(table: DataFrame, names: list[str]) -> DataFrame:
    """``table`` without the columns ``names``, of which some may not be there."""
    return table.drop(*names)


def entity_column(columns: list[str], wanted: str, word: str = "phage") -> str | None:
    """``wanted`` if the table has it, else its first column with ``word`` in the name, else None:
    then all files' entities are meant."""
    return wanted if wanted in columns else next((c for c in columns if word in c.lower()), None)
