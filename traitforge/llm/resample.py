"""Importance resampling towards a target text, with hashed word n-grams.

Every run of 1 to ``n`` words is a feature, put into one of ``buckets`` by its CRC-32. One scan of
a text finds all of them: it keeps the running zlib states of the runs that began at the last
``n`` words and extends each by a space and the next word, so no feature is ever spelled out. The
scan writes the buckets of a document (two bytes a feature); counts over the whole corpus and
over the target give each bucket's gain, a document's weight is the sum of its gains, and weights
with Gumbel noise of the id's digest are drawn from the top: sampling without replacement in
proportion to exp(weight / 1000).

Defined results: null or empty texts have no features, weigh 0 and are never drawn; a null id
counts as empty text for the noise and is smallest among ties; repeated rows are rows of their own
with equal scores and neighbouring ranks; very long texts are scanned whole, a megabyte at a time;
an empty target gives gains from the corpus alone; an empty table stays empty. Other columns,
whatever their names, are not read, and pass through :func:`resample` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import numbered
from .common import CRC_SQL, materialize, slices, small_batches, table, text_print

BUCKETS = 10_000
#: Longest run of words.
RUN = 3
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: Bytes of a text whose words are held at once.
STEP = 1 << 20

#: Words are runs of digits, letters and bytes of non-ASCII characters, with A-Z lower-cased.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def pieces(text: str | None, step: int = STEP) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``step`` bytes."""
    data = text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + step)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class CrcRing:
    """Running CRC-32 states of the runs that began at the last words of one text."""

    def __init__(self, n: int = RUN):
        self.last: list[int | None] = [None] * (n - 1)

    def extend(self, words: list[bytes]) -> list[list[int]]:
        """CRC-32 of every run that ends in ``words``, by the number of its words. A run of k + 1
        words extends the state of the run of k words that ended one word before."""
        if not words:
            return []
        tails = [b" " + w for w in words]
        states = list(map(crc32, words))
        found = [states]
        for k, carried in enumerate(self.last):
            self.last[k] = states[-1]
            # Without a carried state the text has begun in these words.
            before = states[:-1] if carried is None else [carried, *states[:-1]]
            states = list(map(crc32, tails[len(tails) - len(before) :], before))
            if not states:
                break
            found.append(states)
        return found


def buckets_of(text: str | None, n: int = RUN, buckets: int = BUCKETS, step: int = STEP) -> tuple[int, np.ndarray]:
    """Number of words of a text and the buckets of all its features."""
    ring, words, found = CrcRing(n), 0, []
    for part in pieces(text, step):
        words += len(part)
        found += [np.array(states, np.uint32) for states in ring.extend(part)]
    hashed = np.concatenate(found) % np.uint32(buckets) if found else np.zeros(0, np.uint32)
    return words, hashed.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def scan_features(docs: DataFrame, id_col: str, text_col: str, n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(``id_col``, print, n_words, n_features, buckets) of every row, the last one packed."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col), text_print(F.col(text_col)).alias("print"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema[id_col], *T._parse_datatype_string("print binary, n_words long, n_features long, buckets binary").fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [buckets_of(t, n, buckets) for t in batch.column(2).to_pylist()]
            columns = [pa.array([w for w, _ in rows], pa.int64()), pa.array([len(b) for _, b in rows], pa.int64()), pa.array([b.tobytes() for _, b in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=schema.names)

    return slim.toDF(id_col, "print", "text").mapInArrow(scan, schema)


def _packed_type(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows each bucket holds: one number a bucket reaches the driver."""
    kind = _packed_type(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                if packed.is_valid:
                    total += np.bincount(np.frombuffer(packed.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "held"])

    counts = np.zeros(buckets, np.int64)
    for row in features.select("buckets").mapInArrow(count, "bucket long, held long").groupBy("bucket").agg(F.sum("held").alias("held")).collect():
        counts[row.bucket] = row.held
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    m = len(corpus)
    all_corpus, all_target = float(corpus.sum() + m), float(target.sum() + m)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * all_corpus) / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(h: int) -> int:
    """Thousandths of a Gumbel variate from 32 bits, rounded down."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(``id_col``, print, row, n_words, n_features, weight, score) of every row of ``docs``; ``row``
    numbers the rows."""
    features = materialize(scan_features(docs, id_col, text_col, n, buckets), "features")
    wanted = scan_features(target.select(F.lit(0).alias("k"), F.col(target_text).alias("text")), "k", "text", n, buckets)
    gains, kind = bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets)), _packed_type(buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("print binary, n_words long, n_features long, weight long, score long").fields])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gains[np.frombuffer(b.as_buffer(), kind)].sum()) for b in batch.column(4)]
            scores = [w + gumbel(h) for w, h in zip(weights, batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], names=schema.names)

    return materialize(features.withColumn("h", noise).mapInArrow(weigh, schema).withColumn("row", F.monotonically_increasing_id()), "weights")


def draw(scores: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores`` with ``rank``: 1, 2, 3, ... for the ``percent`` of the rows of ``least_words`` and
    more that have the highest scores, null for the others."""
    able = F.col("n_words") >= least_words
    drawn = scores.filter(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_first(id_col), F.col("n_features"), F.col("row")]
    ranked = numbered(scores.filter(able), order).withColumn("rank", F.when(F.col("n") < drawn, F.col("n").cast("long") + 1)).drop("n")
    return ranked.unionByName(scores.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The drawn documents with all their columns; repeated rows stay if one of them is drawn."""
    scores = importance_scores(docs, target, id_col, text_col, **options)
    kept = draw(scores, id_col, percent, least_words).filter("rank IS NOT NULL").select(F.col(id_col).alias("_id"), F.col("print").alias("_print")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_id"]) & (text_print(docs[text_col]) == kept["_print"]), "left_semi")


def op11_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = importance_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return draw(scores).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = (
    r"""
WITH RECURSIVE word AS (
  SELECT 'd' AS side, rowid AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid, text FROM documents)
  UNION ALL
  SELECT 'b', rowid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM (SELECT row_number() OVER () AS rowid, text FROM benchmark)),
feature AS (
  SELECT side, r, array_to_string(w[i : i + n - 1], ' ') AS f, count(*) AS times
  FROM (SELECT side, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM word, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)
  GROUP BY side, r, f),
hashed AS (SELECT f, hex(encode(f)) AS x, octet_length(encode(f)) AS n FROM (SELECT DISTINCT f FROM feature)),
longest AS (SELECT max(n) AS n FROM hashed),
"""
    + CRC_SQL
    + r"""
bucket AS (SELECT f, crc % 10000 AS bucket FROM crc),
placed AS (SELECT side, r, bucket, times FROM feature JOIN bucket USING (f)),
held AS (
  SELECT k.bucket, coalesce(sum(times) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(times) FILTER (WHERE side = 'b'), 0) AS t
  FROM (SELECT unnest(range(10000)) AS bucket) k LEFT JOIN placed USING (bucket) GROUP BY k.bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * CAST((SELECT sum(s) FROM held) + 10000 AS DOUBLE) / ((CAST(s AS DOUBLE) + 1) * CAST((SELECT sum(t) FROM held) + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM held),
weight AS (SELECT r, sum(times) AS n, sum(times * g) AS weight FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) d JOIN (SELECT * FROM word WHERE side = 'd') USING (r) LEFT JOIN weight USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY coalesce(n_words, 0) >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS p, count(*) FILTER (WHERE n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND p <= able * 5 // 100 THEN CAST(p AS BIGINT) END AS rank FROM ranked
"""
)
