"""Streams: k-mer presence of arriving proteins, and running votes on arriving predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import vote
from ..operators.sequence import explode_kmers


def stream_presence(proteins: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """(genome, feature) of a stream of (genome, sequence) under a static map (cluster, feature)
    whose clusters are k-mers; stateless, repeats included."""
    return explode_kmers(proteins, k, ["genome"]).join(features.withColumnRenamed("cluster", "kmer"), "kmer").select("genome", "feature")


def running_votes(predictions: DataFrame, keys: list[str], time: str, late: str = "10 minutes", window: str = "10 minutes") -> DataFrame:
    """Mean confidence and vote of each key in windows of event time; rows later than ``late``
    behind the newest are dropped, and windows are final once the watermark has passed them."""
    windowed = predictions.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    out = windowed.agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("runs"))
    return out.select(F.col("window.start").alias("start"), *keys, "confidence", "runs", vote(F.col("confidence")).alias("prediction"))
