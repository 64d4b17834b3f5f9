"""Readers and writers: FASTA, typed delimited tables, run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Search hits, in the column order of the table they come in.
HITS = T.StructType(
    [
        T.StructField("query", T.StringType()), T.StructField("target", T.StringType()), T.StructField("score", T.FloatType()), T.StructField("identity", T.FloatType()), T.StructField("e_value", T.FloatType()),
        *(T.StructField(c, T.IntegerType()) for c in ("query_start", "query_end", "query_length", "target_start", "target_end", "target_length")),
    ]
)
CLUSTERS = T.StructType([T.StructField("cluster", T.StringType()), T.StructField("protein_id", T.StringType())])
BEST_HITS = T.StructType([T.StructField("protein_id", T.StringType()), T.StructField("cluster", T.StringType())])


def read_fasta(spark: SparkSession, path: str | list[str], suffix: str | None = None, genomes: list[str] | None = None) -> DataFrame:
    """(genome, protein_id, sequence, description) of FASTA files; the genome is the file's name
    without ``suffix`` (``.faa`` and the like) or its last extension.

    Records begin with ``>`` at the start of a line, so descriptions may hold that character.
    ``genomes`` prunes by file name before the text is parsed.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    if suffix:
        raw = raw.filter(F.endswith("file", F.lit(suffix if suffix.startswith(".") else f".{suffix}")))
        genome = F.expr(f"substring(file, 1, length(file) - {len(suffix.lstrip('.')) + 1})")
    else:
        genome = F.regexp_replace("file", r"\.[^.]*$", "")
    raw = raw.withColumn("genome", genome)
    if genomes is not None:
        raw = raw.filter(F.col("genome").isin(genomes)) if len(genomes) <= 1000 else raw.join(spark.createDataFrame([(g,) for g in genomes], "genome string"), "genome", "left_semi")
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), r"\r$", "")
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.expr("substring(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)"), r"\s", "")).otherwise(F.lit(""))
    rows = raw.select("genome", F.regexp_extract(head, r"^(\S+)", 1).alias("protein_id"), body.alias("sequence"), head.alias("description"))
    return rows.filter("protein_id <> ''")


def write_fasta(proteins: DataFrame, path: str, id_col: str = "protein_id", sequence: str = "sequence") -> None:
    proteins.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """A delimited export, with or without a line of names."""
    rows.write.mode("overwrite").csv(path, sep=sep, header=header)


def write_hits(rows: DataFrame, path: str) -> None:
    """Best hits as tab-separated text without names, as :func:`read_best_hits` reads it."""
    write_table(rows.select(*BEST_HITS.names), path, "\t", header=False)


def read_best_hits(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, BEST_HITS, "\t", header=False)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, HITS, "\t", header=False)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, CLUSTERS, "\t", header=False)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Tab for .tsv, comma for .csv, else whichever the first line has, tab before comma."""
    if path.endswith(".tsv"):
        return "\t"
    if path.endswith(".csv"):
        return ","
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    for sep in ("\t", ","):
        if sep in line:
            return sep
    raise ValueError(f"no tab or comma in the first line of {path}")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A table of annotations with all columns as text, its separator found from name or content."""
    return spark.read.csv(path, sep=sniff_separator(spark, path), header=True)


def read_entities(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct values of one column; an error names the columns there are."""
    table = read_annotations(spark, path)
    if column not in table.columns:
        raise ValueError(f"no column {column} in {path}; it has {', '.join(table.columns)}")
    return table.select(F.col(column).cast("string").alias(column)).na.drop().distinct()


def write_runs(rows: DataFrame, path: str) -> None:
    """Run artifacts as Parquet, partitioned by cut-off and run, so that reads prune by both."""
    rows.write.mode("append").partitionBy(*[c for c in ("cut_off", "run") if c in rows.columns]).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
