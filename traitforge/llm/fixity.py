"""Fixity audit of WARC replicas with Merkle trees over ordered offset ranges.

The leaves of a file's tree are the digests of its records. A node covers a range of offsets and
hashes its children in order of offset; ranges widen by a factor of 64 from level to level up to
the whole file. Which node a record is under follows from its offset alone, so trees are built by
grouping, one aggregation for each level, and no file is ever gathered: offsets are running sums
over ranges of records, so that a file of any size is spread over many tasks. Each level is
written once. The audit compares the files' roots of two replicas and goes down only under nodes
that differ, joining the children with their suspect parents before they are compared, to the
damaged records.

Records of one range are at most its size over the size of a record header, so no group grows.

Defined results: null urls and pages are empty; rows without an id are archived in files of their
own, by content; equal rows follow each other in their file; pages of any length are one record; a
record that only one replica has is ``missing`` or ``extra``; empty replicas give no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import prefix_sums
from .common import materialize, table

#: Bits of offset that nodes of each level cover, the last a whole file.
LEVELS = (16, 22, 28, 34, 62)
#: Pages in one file of the archive.
FILE_PAGES = 1000


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A page as WARC response record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, file, offset, length): where each page's record is in its file.

    Only lengths are shuffled to be summed up, not the pages.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    number = F.floor(F.col("page_id") / FILE_PAGES).cast("long")
    file = F.when(F.col("page_id").isNull(), F.concat(F.lit("none-"), F.substring(digest, 1, 4))).otherwise(F.format_string("warc-%08d", number))
    return pages.withColumn("file", file).withColumn("length", F.octet_length(record_bytes(F.col("page_id"), F.col("url"), F.col("html"))).cast("long"))


def with_offsets(records: DataFrame) -> DataFrame:
    """``records`` (page_id, url, file, length, digest, ...) with their ``offset``. Equal rows are
    told apart by a number that no result shows."""
    order = [F.col(c).asc_nulls_first() for c in ("page_id", "url", "digest", "_row")]
    told = materialize(records.withColumn("_row", F.monotonically_increasing_id()), "unplaced")
    return prefix_sums(told, ["file"], order, {"offset": F.col("length")}, inclusive=False).drop("_row")


def tree(records: DataFrame) -> list[DataFrame]:
    """Node tables (file, node, digest), from the ranges of records up to the files' roots."""
    below = records.select("file", F.col("offset").alias("node"), F.concat_ws(":", F.col("length").cast("string"), "digest").alias("digest"))
    levels, bits = [], 0
    for k, top in enumerate(LEVELS):
        child = F.array_sort(F.collect_list(F.struct("node", "digest")))
        line = F.transform(child, lambda c: F.concat_ws(" ", c["node"].cast("string"), c["digest"]))
        nodes = below.withColumn("parent", F.shiftright("node", top - bits)).groupBy("file", "parent").agg(F.sha2(F.concat_ws("\n", line), 256).alias("digest"))
        below = materialize(nodes.withColumnRenamed("parent", "node"), f"tree-{k}")
        levels.append(below)
        bits = top
    return levels


def audit(original: DataFrame, replica: DataFrame, ours: list[DataFrame] | None = None, theirs: list[DataFrame] | None = None) -> DataFrame:
    """(file, offset, status) of damaged records: ``corrupt``, ``missing`` or ``extra``.

    Both tables have (file, offset, length, digest) for each record; their trees are built unless
    they are given.
    """
    ours, theirs = ours or tree(original), theirs or tree(replica)
    suspect = None
    for level in reversed(range(len(LEVELS))):
        a, b = ours[level].withColumnRenamed("digest", "da"), theirs[level].withColumnRenamed("digest", "db")
        if suspect is not None:
            parents, shift = suspect.withColumnRenamed("node", "parent"), LEVELS[level + 1] - LEVELS[level]
            a, b = (t.withColumn("parent", F.shiftright("node", shift)).join(parents, ["file", "parent"], "left_semi").drop("parent") for t in (a, b))
        suspect = materialize(a.join(b, ["file", "node"], "full").filter(~F.col("da").eqNullSafe(F.col("db"))).select("file", "node"), f"suspect-{level}")

    def under(records: DataFrame, name: str) -> DataFrame:
        near = records.withColumn("node", F.shiftright("offset", LEVELS[0])).join(suspect, ["file", "node"], "left_semi")
        line = F.concat_ws(":", F.col("length").cast("string"), "digest")
        return near.groupBy("file", "offset").agg(F.concat_ws("\n", F.array_sort(F.collect_list(line))).alias(name))

    both = under(original, "da").join(under(replica, "db"), ["file", "offset"], "full").filter(~F.col("da").eqNullSafe(F.col("db")))
    return both.select("file", "offset", F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise("corrupt").alias("status"))


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica for drills: by a hash of the id, one page in 256 has its first character
    overwritten (``altered`` digest), another one in 256 is lost."""
    lot = F.substring(F.sha2(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), 256), 1, 2)
    bad = F.when((lot == "00") & (F.length("html") > 0), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    return pages.withColumn("altered", bad).withColumn("lost", lot == "01")


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a drill replica of the archive of all pages: every record, with its status and the
    roots of its file's tree in the archive and in the replica (null if nothing of it is left)."""
    pages = damaged_copy(archive(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    digest = lambda html: F.sha2(record_bytes(F.col("page_id"), F.col("url"), F.col(html)), 256)
    records = with_offsets(pages.select("page_id", "url", "file", "length", digest("html").alias("digest"), digest("altered").alias("found"), "lost"))
    records = materialize(records.drop("url"), "records")
    original = records.select("file", "offset", "length", "digest")
    replica = records.filter("NOT lost").select("file", "offset", "length", F.col("found").alias("digest"))
    ours, theirs = tree(original), tree(replica)
    out = records.join(audit(original, replica, ours, theirs), ["file", "offset"], "left")
    out = out.join(ours[-1].select("file", F.col("digest").alias("root_sha256")), "file", "left").join(theirs[-1].select("file", F.col("digest").alias("replica_root_sha256")), "file", "left")
    return out.select("page_id", "file", "offset", "length", F.col("digest").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"), "root_sha256", "replica_root_sha256")


OP1_SQL = r"""
WITH page AS (
  SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, substr(sha256(coalesce(CAST(page_id AS VARCHAR), 'none')), 1, 2) AS lot,
    CASE WHEN page_id IS NULL THEN 'none-' || substr(sha256(coalesce(html, '')), 1, 4) ELSE 'warc-' || lpad(CAST(page_id // 1000 AS VARCHAR), 8, '0') END AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap
  FROM pages),
found AS (SELECT *, CASE WHEN lot = '00' AND length(h) > 0 THEN '#' || substr(h, 2) ELSE h END AS h2 FROM page),
rec AS (SELECT page_id, u, file, lot, h, h2, head || strlen(h) || gap || h || gap AS r, head || strlen(h2) || gap || h2 || gap AS r2 FROM found),
placed AS (
  SELECT page_id, file, r, r2, CASE WHEN lot = '01' THEN 'missing' WHEN h <> h2 THEN 'corrupt' ELSE 'ok' END AS status,
    CAST(coalesce(sum(strlen(r)) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, u, sha256(r) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o
  FROM rec),
leaf AS (
  SELECT 'archive' AS side, file, o AS node, strlen(r) || ':' || sha256(r) AS d FROM placed
  UNION ALL
  SELECT 'replica', file, o, strlen(r) || ':' || sha256(r2) FROM placed WHERE status <> 'missing'),
level16 AS (SELECT side, file, node >> 16 AS n, sha256(string_agg(node || ' ' || d, chr(10) ORDER BY node, d)) AS d FROM leaf GROUP BY ALL),
level22 AS (SELECT side, file, n >> 6 AS m, sha256(string_agg(n || ' ' || d, chr(10) ORDER BY n)) AS d FROM level16 GROUP BY ALL),
level28 AS (SELECT side, file, m >> 6 AS n, sha256(string_agg(m || ' ' || d, chr(10) ORDER BY m)) AS d FROM level22 GROUP BY ALL),
level34 AS (SELECT side, file, n >> 6 AS m, sha256(string_agg(n || ' ' || d, chr(10) ORDER BY n)) AS d FROM level28 GROUP BY ALL),
root AS (SELECT side, file, sha256(string_agg(m || ' ' || d, chr(10) ORDER BY m)) AS d FROM level34 GROUP BY ALL)
SELECT page_id, placed.file, o AS "offset", CAST(strlen(r) AS BIGINT) AS length, sha256(r) AS record_sha256, status,
  a.d AS root_sha256, b.d AS replica_root_sha256
FROM placed LEFT JOIN root a ON a.file = placed.file AND a.side = 'archive' LEFT JOIN root b ON b.file = placed.file AND b.side = 'replica'
"""
