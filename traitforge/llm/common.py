"""Helpers shared by the training-data operators: tables, Arrow batches, array hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialize as materialize

U64 = np.uint64
#: Text bytes that one Python-side step handles at once.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Have Spark cut the Arrow batches it sends to Python by bytes: 10,000 rows of long texts or
    large sets would not fit beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(CHUNK_BYTES))


def fold(id_col: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def slices(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker may wait long for its next task


def text_print(text: F.Column) -> F.Column:
    """128 bits of the SHA-256 of a text, null as empty, to tell rows of one id apart."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def digests(pieces: Iterable[bytes]) -> list[bytes]:
    """128-bit cryptographic digests: where bytes are declared equal by name, it is by these."""
    blake = hashlib.blake2b
    return [blake(p, digest_size=16).digest() for p in pieces]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 output bits."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(33)
        x *= U64(0xFF51AFD7ED558CCD)
        x ^= x >> U64(29)
        x *= U64(0xC4CEB9FE1A85EC53)
        x ^= x >> U64(32)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the odd hashing base (or of its inverse) modulo 2^64."""
    key = "inverse" if inverse else "base"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        size = max(1 << 16, n + (n >> 3))
        out = np.empty(size, U64)
        out[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
                done += step
        _POWERS[key] = have = out
    return have[:n]


_BYTE_CODES = mix64(np.arange(1, 257, dtype=U64))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of code(byte t) * base^t for i <= t < j, modulo 2^64."""
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_CODES[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) under :func:`prefix_hash`, place-independent.

    Texts can be made up that agree in them without being equal: they deal work out, and never
    decide what is equal."""
    with np.errstate(over="ignore"):
        raw = (prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts]
    return mix64(raw + (ends - starts).astype(U64))


#: Part of a recursive DuckDB query: ``crc`` (f, crc) from ``hashed`` (f, its bytes x in hexadecimal,
#: their number n) and ``longest`` (n). CRC-32 is linear: a text's value is the sum (exclusive or) of
#: what each byte gives at its distance from the end and of what the start gives at the text's length.
CRC_SQL = """
byte_step AS (
  SELECT b, b AS c, 0 AS k FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM byte_step WHERE k < 8),
crc_table AS (SELECT b, c FROM byte_step WHERE k = 8),
shifted AS (
  SELECT b, c, 0 AS after FROM crc_table
  UNION ALL
  SELECT s.b, xor(s.c >> 8, t.c), s.after + 1 FROM shifted s JOIN crc_table t ON t.b = s.c & 255 WHERE s.after < (SELECT n FROM longest)),
begun AS (
  SELECT CAST(4294967295 AS BIGINT) AS c, 0 AS n
  UNION ALL
  SELECT xor(s.c >> 8, t.c), s.n + 1 FROM begun s JOIN crc_table t ON t.b = s.c & 255 WHERE s.n < (SELECT n FROM longest)),
crc AS (
  SELECT f, xor(xor(bit_xor(s.c), any_value(begun.c)), 4294967295) AS crc
  FROM (SELECT f, n, CAST('0x' || x[2 * p + 1 : 2 * p + 2] AS BIGINT) AS b, n - 1 - p AS after FROM (SELECT *, unnest(range(n)) AS p FROM hashed)) u
  JOIN shifted s USING (b, after) JOIN begun USING (n) GROUP BY f),
"""
