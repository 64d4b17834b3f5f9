"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping cluster shards.

Equal vectors are one class. Class vectors go to the shards of their ``OVERLAP`` nearest
centroids (spherical k-means on a bounded sample); shards that are still large are dealt out once
more by centroids of their own, so that shards keep their size as the table grows. Each shard links every vector to near ones,
pruned so that a link is dropped when a kept one is a clear detour towards it; the shards'
adjacency lists are united. Every vector is then searched for in its shards: greedily from the
shard's medoid over the united lists, and once within range, on through everything found within a
widened range. Pairs found are verified in double precision.

The index holds every vector. :func:`audit_recall` measures the share of links found for stated
queries against brute force; the README gives its figures.

Defined results: vectors that are null, zero or hold null or non-finite components link with
nothing; shorter vectors count as padded with zeros; equal vectors are linked with each other,
repeated rows included; vectors of any length are compared whole; a component's name is its smallest
id that is not null, and a row without id is kept if it is alone; labels and other columns, whatever
their names, are not read; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import materialize, small_batches, table

THRESHOLD = 0.95
#: Vectors a shard should hold, and shards each vector is in; larger shards are built in pairs of
#: blocks of ``BLOCK`` vectors, so no vectors of a shard are kept apart.
SHARD, OVERLAP, BLOCK = 1500, 3, 3000
#: Centroids of one dealing at most, and sampled vectors for each.
CENTROIDS, SAMPLE_PER_CENTROID = 1024, 24
#: Vectors above which a shard is dealt out once more, in portions of ``PORTION`` of them.
LARGE, PORTION = 12_000, 50_000
#: Links of a vector in one shard, candidates for them, and how clear a detour must be.
DEGREE, CANDIDATES, DETOUR = 20, 48, 1.2
#: Vectors that greedy search keeps in view, and the cosine below the threshold it still follows.
BEAM, SLACK = 24, 0.1


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, cls, unit): digest and unit vector in double precision, null where it cannot link."""
    schema = T.StructType([vectors.schema[id_col], T.StructField("cls", T.BinaryType()), T.StructField("unit", T.BinaryType())])

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, units = [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v, float) if v and all(c is not None for c in v) else np.zeros(0)
                scale = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if scale > 0:
                    x = np.trim_zeros(x, "b") + 0.0
                    y = x / scale
                    data = (y / math.sqrt(float(y @ y))).tobytes()
                    digests.append(hashlib.md5(x.tobytes()).digest())
                    units.append(data)
                else:
                    digests.append(None)
                    units.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], names=schema.names)

    return vectors.select(id_col, vec_col).mapInArrow(unit, schema).withColumnRenamed(id_col, "id")


def as_matrix(units: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(units), width))
    for i, u in enumerate(units):
        x = np.frombuffer(u, float)
        n = min(len(x), width)
        out[i, :n] = x[:n]
    return out


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly taken sample vectors."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def robust_prune(v: int, candidates: np.ndarray, sims: np.ndarray) -> list[int]:
    """Neighbours of ``v`` among ``candidates`` (nearest first) that no kept one detours to.

    ``sims`` are the candidates' cosines with v (first row) and with each other.
    """
    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
    alive = np.ones(len(candidates), bool)
    kept: list[int] = []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(int(candidates[i]))
            if len(kept) == DEGREE:
                break
            alive &= DETOUR * far[i + 1] > far[0]
    return kept


def build_shard(unit: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Adjacency lists of a shard's vectors, both ways, and its medoid."""
    n = len(unit)
    lists: list[set[int]] = [set() for _ in range(n)]
    take = min(CANDIDATES, n - 1)
    for at in range(0, n, 512):
        sims = unit[at : at + 512] @ unit.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        if not take:
            break
        top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        for r, cand in enumerate(top):
            cand = cand[np.argsort(-sims[r, cand], kind="stable")]
            own = np.vstack([sims[r, cand], unit[cand] @ unit[cand].T])
            for c in robust_prune(at + r, cand, own):
                lists[at + r].add(c)
                lists[c].add(at + r)
    medoid = int((unit @ unit.mean(0)).argmax()) if n else 0
    return [np.fromiter(sorted(x), np.int64, len(x)) for x in lists], medoid


def range_search(query: np.ndarray, unit: np.ndarray, lists: list[np.ndarray], start: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with cosine of at least ``threshold`` reached from ``start``, and their cosines.

    Greedy best-first with a view of ``BEAM`` nodes; everything above the threshold less ``SLACK``
    is followed whatever the view holds.
    """
    seen = np.zeros(len(unit), bool)
    seen[start] = True
    first = float(unit[start] @ query)
    queue = [(-first, start)]
    view = [first]
    hits, cosines = ([start], [first]) if first >= threshold else ([], [])
    while queue:
        s, node = heapq.heappop(queue)
        if -s < threshold - SLACK and len(view) >= BEAM and -s < view[0]:
            break
        new = lists[node][~seen[lists[node]]]
        if not len(new):
            continue
        seen[new] = True
        for c, k in zip((unit[new] @ query).tolist(), new.tolist(), strict=True):
            if len(view) < BEAM:
                heapq.heappush(view, c)
            elif c > view[0]:
                heapq.heapreplace(view, c)
            elif c < threshold - SLACK:
                continue
            heapq.heappush(queue, (-c, k))
            if c >= threshold:
                hits.append(k)
                cosines.append(c)
    return np.array(hits, np.int64), np.array(cosines)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows of sorted batches, group by group."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sharded(classes: DataFrame, width: int) -> DataFrame:
    """(shard, p, q, own, cls, unit): every class in its shards, and in all block pairs of those."""
    spark = classes.sparkSession
    n = classes.count()
    k = max(1, min(CENTROIDS, -(-n // SHARD)))
    rows = classes.orderBy("cls").limit(k * SAMPLE_PER_CENTROID).select("unit").collect()
    centres = spark.sparkContext.broadcast(fit_centroids(as_matrix([r.unit for r in rows], width), k))
    overlap = min(OVERLAP, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = as_matrix(batch.column(1).to_pylist(), width) @ centres.value.T
            near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
            at = pa.array(np.repeat(np.arange(batch.num_rows), overlap))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["shard", "cls", "unit"])

    dealt = materialize(classes.select("cls", "unit").mapInArrow(assign, "shard long, cls binary, unit binary"), "shards")
    counts = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    large = materialize(counts.filter(F.col("size") > LARGE), "large")
    if not large.isEmpty():
        dealt = materialize(dealt.join(large, "shard", "left_anti").unionByName(_dealt_again(dealt.join(large, "shard"), width)), "shards")
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = dealt.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return materialize(own.select("shard", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "cls", "unit"), "blocks")


def _dealt_again(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (shard, cls, unit, size) under new shards, by centroids fitted in each old one."""
    k = F.least(F.lit(CENTROIDS), F.ceil(F.col("size") / SHARD)).cast("int")
    rows = rows.withColumn("k", k).withColumn("portions", F.ceil(F.col("size") / PORTION).cast("int"))
    sample = rows.filter(F.pmod(F.xxhash64("cls"), F.col("size")) < F.col("k") * SAMPLE_PER_CENTROID)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["shard"]):
            centres = fit_centroids(as_matrix([r["unit"] for r in group], width), min(group[0]["k"], len(group)))
            n = len(centres)
            yield pa.RecordBatch.from_arrays([pa.array([group[0]["shard"]] * n, pa.int64()), pa.array([group[0]["portions"]] * n, pa.int32()), pa.array([c.tobytes() for c in centres], pa.binary())], names=["shard", "portions", "unit"])

    centres = materialize(sample.repartition("shard").sortWithinPartitions("shard", "cls").mapInArrow(fit, "shard long, portions int, unit binary"), "centres")
    # Every portion of a shard meets all of its centres, which stand before the vectors.
    first = centres.select("shard", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(None).cast("binary").alias("cls"), "unit")
    both = first.unionByName(rows.select("shard", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("portions")).cast("int").alias("portion"), "cls", "unit"))
    both = both.repartition("shard", "portion").sortWithinPartitions("shard", "portion", F.col("cls").asc_nulls_first(), "unit")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, units = None, []
        for batch in batches:
            shard, portion, cls, unit = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for at, name, u in zip(zip(shard, portion, strict=True), cls, unit, strict=True):
                if at != key:
                    key, units, centre = at, [], None
                if name is None:
                    units.append(u)
                else:
                    centre = as_matrix(units, width) if centre is None else centre
                    near = np.argsort(-(centre @ as_matrix([u], width)[0]), kind="stable")[:OVERLAP]
                    out += [(at[0] * CENTROIDS + int(j) + CENTROIDS, name, u) for j in near]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "cls", "unit"])

    # A vector meets the same new shard once for each old one it was in, which are different numbers.
    return both.select("shard", "portion", "cls", "unit").mapInArrow(assign, "shard long, cls binary, unit binary")


GROUP = ["shard", "p", "q"]


def find_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) with a < b: class pairs found and verified to have a cosine of at least
    ``threshold``. ``classes`` has (cls, unit)."""
    width = (classes.agg(F.max(F.octet_length("unit"))).first()[0] or 8) // 8
    shards = _sharded(classes, width)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, GROUP):
            lists, _ = build_shard(as_matrix([r["unit"] for r in rows], width))
            names = [r["cls"] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([[names[j] for j in x] for x in lists], pa.list_(pa.binary()))], names=["cls", "links"])

    order = lambda df: df.repartition(*GROUP).sortWithinPartitions(*GROUP, "cls")
    built = materialize(order(shards).mapInArrow(build, "cls binary, links array<binary>"), "lists")
    united = materialize(built.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")), "united")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, GROUP):
            unit = as_matrix([r["unit"] for r in rows], width)
            names = [r["cls"] for r in rows]
            place = {c: i for i, c in enumerate(names)}
            lists = [np.array([place[c] for c in r["links"] if c in place], np.int64) for r in rows]
            medoid = int((unit @ unit.mean(0)).argmax())
            for i in range(len(rows)):
                # From the medoid, and from the vector's own links, which may lie in its component alone.
                found, _ = range_search(unit[i], unit, lists, medoid, threshold - 1e-9)
                own, _ = range_search(unit[i], unit, lists, i, threshold - 1e-9)
                both = np.union1d(found, own)
                both = both[both != i]  # the graph is not symmetric: a link may show from one side only
                both = both[np.einsum("ij,j->i", unit[both], unit[i]) >= threshold]
                if len(both):
                    yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(both), pa.binary()), pa.array([names[j] for j in both], pa.binary())], names=["a", "b"])

    found = order(shards.join(united, "cls")).mapInArrow(search, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``id``, ``n_links``, ``component``, ``kept``."""
    small_batches(vectors.sparkSession)
    rows = materialize(_classes(vectors, id_col, vec_col), "vectors")
    valid = rows.filter("cls IS NOT NULL")
    classes = materialize(valid.groupBy("cls").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")), "classes")
    links = materialize(find_links(classes.select("cls", "unit"), threshold), "links")
    joined = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"node": "cls", "component": "comp"})
    copies = classes.select(F.col("cls").alias("b"), "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "cls")
    named = classes.drop("unit").join(joined, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).join(degree, "cls", "left")
    names = named.groupBy("comp").agg(F.min("least").alias("component"))
    told = named.join(names, "comp").select("cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component")
    out = rows.drop("unit").join(told, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


def audit_recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, threshold: float = THRESHOLD, block: int = 2000) -> float:
    """Share of the links that brute force finds for the vectors whose id is divisible by
    ``every``, against all vectors, in blocks of queries; ``found`` comes from
    :func:`near_duplicate_vectors`."""
    spark = vectors.sparkSession
    rows = materialize(_classes(vectors.filter(F.col(id_col).isNotNull()), id_col, vec_col).filter("cls IS NOT NULL"), "audit")
    asked = rows.filter(F.col("id") % every == 0)
    steps = max(1, -(-asked.count() // block))
    width = (rows.agg(F.max(F.octet_length("unit"))).first()[0] or 8) // 8
    true = got = 0
    for step in range(steps):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(steps)) == step).select("id", "unit").collect()
        queries = spark.sparkContext.broadcast(as_matrix([r.unit for r in part], width))

        def count(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(queries.value), np.int64)
            for batch in batches:
                total += (queries.value @ as_matrix(batch.column(0).to_pylist(), width).T >= threshold).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "n"])

        exact = dict(rows.select("unit").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect())
        have = dict(found.join(F.broadcast(spark.createDataFrame([(r.id,) for r in part], "id long")), "id").select("id", "n_links").collect()) if part else {}
        true += sum(n - 1 for n in exact.values())
        got += sum(have[r.id] for r in part)
    return got / true if true else 1.0


def op6_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


OP6_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
"""
