"""Command line: one subcommand for each workflow."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotate, merge
from .plans import workflows as W
from .sources import files

INPUTS = {
    "cluster": ("input_strain", "phenotype_matrix"),
    "select-features": ("input",),
    "train": ("input",),
    "predict": ("input_dir", "model_dir"),
    "assign-features": ("input_dir", "training", "feature_map"),
    "annotate": ("feature_file_path", "feature2cluster_path", "cluster2protein_path", "fasta_dir_or_file"),
    "select-and-train": ("input",),
    "protein-family-workflow": ("input_strain", "phenotype_matrix"),
    "full-workflow": ("input_strain", "phenotype_matrix"),
    "kmer-workflow": ("input_strain", "phenotype_matrix"),
    "kmer-assign-features": ("input_dir", "feature_map"),
    "kmer-assign-predict": ("input_dir", "feature_map", "model_dir"),
    "assign-predict": ("input_dir", "training", "feature_map", "model_dir"),
}

#: Commands beyond these. ``kmer-coverage`` reads the folders of two workflows: a k-mer workflow's
#: (``--input``) and the family workflow's whose proteins its k-mers come from (``--families``).
MORE = {"kmer-coverage": ("input", "families", "proteins")}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="traitforge")
    commands = top.add_subparsers(dest="command", required=True)
    for name, inputs in (INPUTS | MORE).items():
        p = commands.add_parser(name)
        for i in inputs:
            p.add_argument(f"--{i}", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--input_phage", help="phage proteins; to predict with them, give --phage_feature_map (and --phage_training) too")
        p.add_argument("--phage_assignments", help="a table (genome, feature) of phages to predict with")
        p.add_argument("--phage_feature_map")
        p.add_argument("--phage_training", help="training folder of the phage side: proteins and phage_families")
        p.add_argument("--suffix", default="faa")
        p.add_argument("--force", action="store_true")
        p.add_argument("--cut_off", type=int)
        for option, kind in (("strain", str), ("phage", str), ("phenotype", str), ("task", str), ("method", str), ("k", int), ("num_features", int), ("runs_selection", int), ("runs_modelling", int), ("split", str), ("cluster_method", str), ("group_clusters", int), ("least_cluster", int), ("least_presence", int), ("weights_method", str), ("threshold", float), ("least_identity", float), ("coverage", float), ("prefilter", int), ("threads", int)):
            p.add_argument(f"--{option}", type=kind)
        p.add_argument("--one_gene", action="store_true", default=None)
        p.add_argument("--use_weights", action="store_true", default=None)
        p.add_argument("--no_selection_scores", dest="score_selection", action="store_false", default=None)
        p.add_argument("--kmer_families", help="a table (cluster, protein_id): k-mer features within families")
        p.add_argument("--alignments", help="a folder of aligned FASTA files, one a family; made here if there is none")
        p.add_argument("--gap_aware", action="store_true")
        p.add_argument("--cutoffs", type=lambda s: tuple(map(int, s.split(","))))
    return top


def config(args: argparse.Namespace) -> W.Config:
    names = W.Config.__dataclass_fields__
    return W.Config(**{k: v for k, v in vars(args).items() if k in names and v is not None})


def _proteins(spark: SparkSession, path: str | None, suffix: str) -> DataFrame | None:
    return files.read_fasta(spark, path, suffix) if path else None


def _phenotypes(spark: SparkSession, path: str, c: W.Config) -> DataFrame:
    table = files.read_annotations(spark, path)
    named = merge.entity_column(table.columns, c.phage)
    if named is not None:
        table = table.withColumnRenamed(named, c.phage)
    return table.withColumn(c.phenotype, F.col(c.phenotype).cast("double"))


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    c, out, name = config(args), args.output.rstrip("/"), args.command
    if name in ("cluster", "protein-family-workflow", "full-workflow", "kmer-workflow"):
        work = {"cluster": W.feature_table, "protein-family-workflow": W.protein_family_workflow, "full-workflow": W.full_workflow, "kmer-workflow": W.kmer_workflow}[name]
        phages = _proteins(spark, args.input_phage, args.suffix)
        more = {"families": spark.read.parquet(args.kmer_families)} if name == "kmer-workflow" and args.kmer_families else {}
        made = work(spark, out, _proteins(spark, args.input_strain, args.suffix), _phenotypes(spark, args.phenotype_matrix, c), c, phages=phages, force=args.force, **more)
        if "stages" in made:
            made["stages"].write_report({"command": name, "rows": made["rows"].count()})
    elif name in ("select-features", "train", "select-and-train"):
        stages = W.Stages(spark, out, args.force)
        rows, present = (spark.read.parquet(f"{args.input}/{t}") for t in ("rows", "row_features"))
        groups = W.strain_groups(stages, spark.read.parquet(f"{args.input}/strain_assignments"), c) if c.split == "cluster" else None
        present = W.widespread(rows, present, groups, c)
        tables = spark.read.parquet(f"{args.input}/cutoff_tables") if name == "train" else W.selection(stages, rows, present, c, groups)
        if name != "select-features":
            files.write_table(W.modelling(stages, rows, present, tables, c, groups)["metrics"], f"{out}/metrics_csv")
        stages.write_report({"command": name})
    elif name == "kmer-coverage":
        _kmer_coverage(spark, args, c, out)
    elif name == "annotate":
        selected = files.read_annotations(spark, args.feature_file_path).select("feature")
        proteins = annotate.predictive_proteins(selected, spark.read.parquet(args.feature2cluster_path), spark.read.parquet(args.cluster2protein_path))
        proteins.write.mode("overwrite").parquet(f"{out}/predictive_proteins")
        files.write_fasta(annotate.extract_sequences(_proteins(spark, args.fasta_dir_or_file, args.suffix), proteins), f"{out}/sequences")
    elif name == "predict":
        strains = spark.read.parquet(f"{args.input_dir}/strain_assignments")
        _predict(spark, args, c, out, strains, W.known_features(spark, args.input_dir))
    else:
        proteins, features = _proteins(spark, args.input_dir, args.suffix), spark.read.parquet(args.feature_map)
        training = getattr(args, "training", None)
        _assign(spark, args, c, proteins, features, training, "strain").write.mode("overwrite").parquet(f"{out}/strain_assignments")
        features.select("feature").distinct().write.mode("overwrite").parquet(f"{out}/known_features")
        if name.endswith("predict"):
            _predict(spark, args, c, out, spark.read.parquet(f"{out}/strain_assignments"), features.select("feature"))


def _kmer_coverage(spark: SparkSession, args: argparse.Namespace, c: W.Config, out: str) -> None:
    """Where a k-mer workflow's selected features lie in their families."""
    tables = spark.read.parquet(f"{args.input}/cutoff_tables")
    selected = tables.filter(F.col("cut_off") == args.cut_off) if args.cut_off is not None else tables
    aligned = None
    if args.alignments:
        rows = files.read_fasta(spark, args.alignments)
        aligned = rows.select(F.col("genome").alias("family"), "protein_id", F.col("sequence").alias("aligned"))
    maps, families = spark.read.parquet(f"{args.input}/strain_kmer_features"), spark.read.parquet(f"{args.families}/strain_families")
    found = W.kmer_coverage_workflow(spark, out, selected.select("feature"), maps, families, _proteins(spark, args.proteins, args.suffix), aligned, c.k, args.gap_aware, force=args.force, make_alignments=True)
    found["stages"].write_report({"command": args.command, "status": found["status"]})


def _assign(spark: SparkSession, args: argparse.Namespace, c: W.Config, proteins: DataFrame, features: DataFrame, training: str | None, side: str) -> DataFrame:
    """(genome, feature) of new proteins: from k-mers, or by the families of a training folder."""
    if training is None:
        # Of proteins that several files hold under one id the first file's counts.
        return W.assign_kmer_features(annotate.first_per_key(proteins, "protein_id", ["genome", "sequence"]), features, c)
    return W.assign_features(proteins, _proteins(spark, f"{training}/proteins", args.suffix), spark.read.parquet(f"{training}/{side}_families"), features, c)


def _phage_side(spark: SparkSession, args: argparse.Namespace, c: W.Config, out: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(assignments, features looked for) of the phages that the command names, if any."""
    if args.phage_assignments:
        assigned = spark.read.parquet(args.phage_assignments)
        return assigned, assigned.select("feature").na.drop().distinct()
    if args.input_phage is None:
        return None, None
    if args.phage_feature_map is None:
        raise ValueError("--input_phage needs --phage_feature_map to be predicted with")
    features = spark.read.parquet(args.phage_feature_map)
    _assign(spark, args, c, _proteins(spark, args.input_phage, args.suffix), features, args.phage_training, "phage").write.mode("overwrite").parquet(f"{out}/phage_assignments")
    return spark.read.parquet(f"{out}/phage_assignments"), features.select("feature").distinct()


def _predict(spark: SparkSession, args: argparse.Namespace, c: W.Config, out: str, strains: DataFrame, known: DataFrame | None) -> None:
    if args.cut_off is None:
        raise ValueError("--cut_off names the models to use")
    phages, more = _phage_side(spark, args, c, out)
    if known is not None and more is not None:
        known = known.unionByName(more)
    every, votes = W.predict(spark, args.model_dir, args.cut_off, strains, phages, c, known)
    every.write.mode("overwrite").parquet(f"{out}/all_predictions")
    files.write_table(spark.read.parquet(f"{out}/all_predictions"), f"{out}/all_predictions_csv")
    files.write_table(votes, f"{out}/median_predictions")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"traitforge {args.command}").getOrCreate()
    try:
        run(spark, args)
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError) as e:
        print(f"traitforge: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
