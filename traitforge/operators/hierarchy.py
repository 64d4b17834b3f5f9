"""Ward's hierarchy and HDBSCAN over many vectors, exact, in rounds of block searches.

A search answers for each vector of a query set which other ones are nearest. Queries and vectors
are dealt into blocks, and each pair of blocks is one task's, of which only each query's best leave the
task, so no pair is a row. There are about ``TASKS`` pairs of blocks whatever the number of vectors, as long
as a block holds no more than ``VALUES`` values, so what is sent grows with the vectors and not with their
square. A task multiplies ``BLOCK`` by ``BLOCK`` vectors at a time, in single precision; what may be among the best
after its rounding is computed anew from differences. Vectors are sparse (places and values), so presence of any number
of features fits; with many places the product is in double precision and runs over ``PLACES`` of them at a time.

Ward: two clusters that are nearest to each other merge, all such pairs of a round at once, and the
sums of their vectors are added. A merge never brings anything nearer than its parts were, so these
are the merges that taking the nearest pair of all, one at a time, would make. A search lists the ``KEPT`` nearest
of a cluster, and so bounds how near any other is; of merged ones the recurrence for Ward's distance gives a lower bound.
Only merged clusters, and those whose nearest one is no longer known, search again. The last ``SMALL`` clusters are merged
in one task.

HDBSCAN: distances to the ``least``-th nearest (itself counted) are cores; the distance of two vectors
is at least either's core. One search of all vectors lists the ``LISTED`` nearest of each, and so bounds how near
any other is. Rounds of Boruvka join components by their best listed link, if no other one can be as near. Where that
is so of none, the members of all but the largest whose bound is within their component's best search again. The links are
the minimum spanning tree. One row a vector, they give the tree of clusters of at least ``least`` vectors, of which
those are kept that are most stable.

Defined results: distances count to 9 digits; of equally near ones those of smaller numbers are
taken first; equal vectors have distance 0; null ids are left out; vectors without values are zero;
fewer vectors than groups asked for are groups of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.storage import materialize
from .graph import components
from .prefix import numbered

#: Vectors and places of them multiplied at once, and clusters that one task merges.
BLOCK, PLACES, SMALL = 1000, 4096, 6144
#: Pairs of blocks of a search, fewer if there is little to do, and values in a block at most.
TASKS, LEAST_TASKS, VALUES = 64, 8, 8_000_000
#: Nearest vectors kept of each one, from which most of a spanning tree is known.
LISTED = 16
#: Pairs of vectors from which a search's pairs of blocks are dealt to partitions of their own.
LARGE = 2_000_000_000
#: Cheapest merges kept of each cluster, and how many numbers of clusters are sent to all tasks at most.
KEPT, FEW = 5, 50_000

VECTORS = "id long, n double, at array<int>, v array<double>"


def dense_vectors(table: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, names) of rows with an array of numbers; names are (id, ``key``)."""
    names = materialize(numbered(table.select(key, F.col(column).cast("array<double>").alias("v")).na.drop(subset=[key]), [F.col(key)], "id"), "vectors")
    at = F.transform("v", lambda _, i: i.cast("int"))
    number = F.col("id").cast("long").alias("id")
    places, values = F.coalesce(at, F.array().cast("array<int>")), F.coalesce("v", F.array().cast("array<double>"))
    return names.select(number, F.lit(1.0).alias("n"), places.alias("at"), values.alias("v")), names.select(number, key)


def presence_vectors(present: DataFrame, key: str, feature: str) -> tuple[DataFrame, DataFrame]:
    """The same from long presence: 1 at each feature that a ``key`` has; a row with a null feature
    gives a ``key`` without any."""
    names = materialize(numbered(present.select(key).na.drop().distinct(), [F.col(key)], "id").withColumn("id", F.col("id").cast("long")), "vector-names")
    codes = numbered(present.select(feature).na.drop().distinct(), [F.col(feature)], "code")
    held = present.join(codes, feature).groupBy(key).agg(F.sort_array(F.collect_set(F.col("code").cast("int"))).alias("at"))
    rows = names.join(held, key, "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    return rows.select("id", F.lit(1.0).alias("n"), "at", F.transform("at", lambda _: F.lit(1.0)).alias("v")), names.select("id", key)


class Block:
    """Vectors of a block in order of their numbers, or of other columns first: means by row, and what else
    their table holds. Of those with a ``version`` the last one of a number counts, without members it is gone."""

    def __init__(self, table: pa.Table, order: tuple[str, ...] = ()):
        if "version" in table.column_names:
            ids, version = table.column("id").to_numpy(), table.column("version").to_numpy()
            by = np.lexsort((version, ids))
            last = by[np.append(ids[by][1:] != ids[by][:-1], True)] if len(by) else by
            table = table.take(last[table.column("n").to_numpy()[last] > 0])
        table = table.sort_by([(c, "ascending") for c in (*order, "id")])
        self.table, self.ids, self.n = table, table.column("id").to_numpy(), table.column("n").to_numpy()
        at, v = (table.column(c).combine_chunks() for c in ("at", "v"))
        self.sizes = at.value_lengths().to_numpy()
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        row = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.at, self.v = at.flatten().to_numpy(), v.flatten().to_numpy() / self.n[row]
        self.square = np.bincount(row, self.v * self.v, len(self.ids))

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def tiles(self) -> list[slice]:
        return [slice(i, min(i + BLOCK, len(self.ids))) for i in range(0, len(self.ids), BLOCK)]

    def held(self, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of some rows."""
        return self.at[self.first[rows.start] : self.first[rows.stop]], self.v[self.first[rows.start] : self.first[rows.stop]]

    def dense(self, rows: slice, places: np.ndarray) -> np.ndarray:
        """Some rows' values at ``places`` (in order), 0 where there are none."""
        out = np.zeros((rows.stop - rows.start, len(places)))
        if len(places):
            at, v = self.held(rows)
            if len(at) == out.size and (at.reshape(out.shape) == places).all():
                return v.reshape(out.shape)
            row = np.repeat(np.arange(len(out)), self.sizes[rows])
            i = np.minimum(np.searchsorted(places, at), len(places) - 1)
            own = places[i] == at
            out[row[own], i[own]] = v[own]
        return out


class Pairs:
    """Squared distances of the vectors (means) of two blocks, or what it costs to merge them (``ward``: twice what the
    squared deviations from the mean grow by).

    With few places :meth:`near` has them in single precision, with how far off they may be, and :meth:`exact`
    gives those of chosen pairs, from the differences of their values. Otherwise both are in double precision.
    """

    def __init__(self, a: Block, b: Block, ward: bool = False, single: bool = True):
        self.a, self.b, self.ward, self.x = a, b, ward, None
        self.scaled = ward and not ((a.n == 1).all() and (b.n == 1).all())
        places, most = np.union1d(a.at, b.at), b.square.max(initial=0.0)
        if single and len(places) <= PLACES and max(len(a.ids), len(b.ids)) * len(places) <= 2 * VALUES and max(a.square.max(initial=0.0), most) < 1e30:
            self.x, self.y = (s.dense(slice(0, len(s.ids)), places) for s in (a, b))
            self.right = np.column_stack([self.y, np.ones(len(self.y)), b.square]).astype(np.float32)
            # What rounding adds to a product of so many places is less, as a part of the squared lengths.
            self.off = (len(places) + 8) * 2.0**-23 * (np.sqrt(a.square) + math.sqrt(most)) ** 2 + 1e-30

    def near(self, rows: slice, wanted=None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows of ``b``, values of the pairs, how far off they are by row of ``a``) of ``b``'s tiles that are ``wanted``."""
        na, off = self.a.n[rows], np.zeros(rows.stop - rows.start) if self.x is None else self.off[rows]
        if self.x is not None:
            x = np.column_stack([-2 * self.x[rows], self.a.square[rows], np.ones(len(off))])
            sizes, left = None, x.astype(np.float32)
        for cols in filter(wanted, self.b.tiles()):
            nb = self.b.n[cols]
            # If the others are all of one size (they are in its order), the factor is the own row's.
            even = self.scaled and self.x is not None and nb.min() == nb.max()
            if self.x is None:
                d = self._product(rows, cols)
            else:
                if self.scaled and sizes != (size := nb[0] if even else None):
                    sizes, left = size, (x * (2 * na * size / (na + size))[:, None] if even else x).astype(np.float32)
                d = left @ self.right[cols].T
            if self.scaled and not even:
                own, other = na.astype(d.dtype)[:, None], nb.astype(d.dtype)
                d *= 2 * own
                d *= other
                d /= own + other
            yield cols, d, off * (2 * na * nb.max() / (na + nb.max())) if self.scaled else off

    def _product(self, rows: slice, cols: slice) -> np.ndarray:
        a, b = self.a, self.b
        d, seen = np.zeros((rows.stop - rows.start, cols.stop - cols.start)), np.intersect1d(a.held(rows)[0], b.held(cols)[0])
        for first in range(0, len(seen), PLACES):
            some = seen[first : first + PLACES]
            d += a.dense(rows, some) @ b.dense(cols, some).T
        d *= -2
        d += a.square[rows, None]
        d += b.square[None, cols]
        return np.maximum(d, 0.0, out=d)

    def exact(self, r: np.ndarray, c: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The values of pairs of which :meth:`near` gave ``seen``."""
        if self.x is None:
            return seen
        out, step = np.empty(len(r)), max(1, VALUES // (4 * max(1, self.x.shape[1])))
        for i in range(0, len(r), step):
            d = self.x[r[i : i + step]] - self.y[c[i : i + step]]
            out[i : i + step] = np.einsum("ij,ij->i", d, d)
        if self.scaled:
            na, nb = self.a.n[r], self.b.n[c]
            out *= 2 * na * nb / (na + nb)
        return out


class Nearest:
    """The ``k`` nearest that rows of ``a`` (of ``pairs``) have among those of ``b`` seen so far, by distance to 9 digits, equal
    ones by number, which orders the pairs as well; none farther than ``limit``. With ``cores`` of both sides a
    distance is at least either's core; what merging costs is compared as it is."""

    def __init__(self, pairs: Pairs, rows: slice, k: int, limit: np.ndarray | None, cores: tuple[np.ndarray, np.ndarray] | None):
        self.pairs, self.rows, self.k, self.cores, n = pairs, rows, k, cores, rows.stop - rows.start
        self.bound = np.full(n, np.inf) if limit is None else limit[rows].copy()
        self.row, self.other, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting, self.held, self.tiles, self.due = [], 0, 0, 1

    def _ties(self, x: np.ndarray) -> np.ndarray:
        """The largest value that may equal ``x``, a distance or cost, to 9 digits."""
        return x + 2e-9 if self.pairs.ward else (x + 2e-9) ** 2

    def see(self, cols: slice, d: np.ndarray, off: np.ndarray) -> None:
        """Take up a tile; what is infinite in it is left out."""
        size, width = d.shape
        cut, new = self._ties(self.bound) + off, np.flatnonzero(np.isinf(self.bound))
        if len(new) and self.k <= width:
            low = np.partition(d[new], self.k - 1, axis=1)[:, self.k - 1].astype(float) + off[new]
            cut[new] = self._ties(low if self.pairs.ward else np.sqrt(np.maximum(low, 0.0))) + off[new]
        cut = np.nextafter(cut.astype(d.dtype), d.dtype.type(np.inf))
        near = np.flatnonzero(d.min(1) <= cut)
        some = d if len(near) == size else d[near]
        r, c = np.divmod(np.flatnonzero(some <= cut[near, None]), width)
        v = some[r, c]
        known = np.isfinite(v)
        self.waiting.append((near[r[known]], c[known] + cols.start, v[known].astype(float)))
        self.held, self.tiles = self.held + int(known.sum()), self.tiles + 1
        if self.tiles >= self.due or self.held > 8 * self.k * size:
            self.settle()
            self.due = 2 * self.tiles

    def settle(self) -> None:
        """Find the best of what waits."""
        if not self.waiting:
            return
        r, c, v = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        d = self.pairs.exact(r + self.rows.start, c, v)
        d = np.round(d if self.pairs.ward else np.sqrt(d), 9)
        if self.cores is not None:
            d = np.maximum(d, np.maximum(self.cores[0][r + self.rows.start], self.cores[1][c]))
        known = d <= self.bound[r]
        r, other, d = np.append(self.row, r[known]), np.append(self.other, self.pairs.b.ids[c[known]]), np.append(self.d, d[known])
        order = np.lexsort((other, d, r))
        r, other, d = r[order], other[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        last, best = place == self.k - 1, place < self.k
        self.bound[r[last]] = d[last]
        self.row, self.other, self.d = r[best], other[best], d[best]


LISTS = "id long, near array<struct<d: double, other: long>>"


def nearest_in_block(pairs: Pairs, k: int, first: np.ndarray, last: np.ndarray, limit: np.ndarray | None = None, cores: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Table:
    """The :class:`Nearest` of each row of ``a``, without those of ``b`` from its ``first`` to before its ``last``."""
    ids, sizes, others, distances = [], [], [], []
    for rows in pairs.a.tiles():
        lo, hi, best = first[rows], last[rows], Nearest(pairs, rows, k, limit, cores)
        for cols, d, off in pairs.near(rows, lambda cols: not ((lo <= cols.start) & (hi >= cols.stop)).all()):  # noqa: B023
            shut, at = np.flatnonzero((lo < cols.stop) & (hi > cols.start)), np.arange(cols.start, cols.stop)
            if len(shut):
                d[shut] = np.where((at >= lo[shut, None]) & (at < hi[shut, None]), np.inf, d[shut])
            best.see(cols, d, off)
        best.settle()
        ids.append(pairs.a.ids[rows])
        sizes.append(np.bincount(best.row, minlength=len(lo)))
        others.append(best.other)
        distances.append(best.d)
    each = pa.StructArray.from_arrays([pa.array(np.concatenate(distances)), pa.array(np.concatenate(others))], ["d", "other"])
    offsets = pa.array(np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32))
    return pa.table({"id": np.concatenate(ids), "near": pa.ListArray.from_arrays(offsets, each)})


def _merged_lists(found: DataFrame, k: int, *more: str) -> DataFrame:
    """The ``k`` best of each id (and ``more``) of what blocks found."""
    return found.groupBy("id", *more).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _searched(queries: DataFrame, rows: DataFrame, answer, schema: str, order: tuple[str, ...] = (), sizes=None) -> DataFrame:
    """``answer(queries, rows)`` for each pair of blocks, both :class:`Block` in this ``order``; ``sizes`` are the rows and values
    of both where they are known."""
    sizes = sizes or [_size(df) for df in (queries, rows)]
    nq, nr = _blocks(*sizes)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # The two may be one table, whose columns need names of their own on either side.
    fresh = lambda df: df.toDF(*[f"_{c}" for c in df.columns]).toDF(*df.columns)
    q = fresh(queries).withColumn("qb", block(nq)).withColumn("rb", every(nr))
    r = fresh(rows).withColumn("rb", block(nr)).withColumn("qb", every(nq))
    empty = T._parse_datatype_string(schema)

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = Block(a, order), Block(b, order)
        return answer(a, b) if len(a.ids) and len(b.ids) else to_arrow_schema(empty).empty_table()

    if sizes[0][0] * sizes[1][0] > LARGE:
        # Two partitions a pair: few get more than two or three of them.
        q, r = (df.repartition(2 * nq * nr, "qb", "rb") for df in (q, r))
    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(work, schema)


def _size(df: DataFrame) -> tuple[int, int]:
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("at")), F.lit(0))).first())


def _blocks(queries: tuple[int, int], rows: tuple[int, int]) -> tuple[int, int]:
    """Blocks of the queries and of the rows, of which numbers and values are given: about ``TASKS``
    pairs that send little, none of less than ``BLOCK`` or more than ``VALUES``. Blocks of rows are larger, since each finds
    its best anew."""
    tasks = min(TASKS, max(LEAST_TASKS, queries[0] * rows[0] // (20 * BLOCK * BLOCK)))
    most = [max(1, -(-n // BLOCK)) for n, _ in (queries, rows)]
    least = [max(1, -(-values // VALUES)) for _, values in (queries, rows)]
    nq = max(least[0], min(most[0], round(math.sqrt(2 * tasks * max(1, queries[0]) / max(1, rows[0])))), 1)
    return nq, max(least[1], min(most[1], -(-tasks // nq)))


def nearest_clusters(queries: DataFrame, clusters: DataFrame, sizes=None) -> DataFrame:
    """(id, n, near, bound): for each query its size, the ``KEPT`` clusters that it would merge with at least cost, and what any other
    one costs at least."""

    def answer(a: Block, b: Block) -> pa.Table:
        # Itself is shut out.
        order = np.argsort(b.ids)
        i = order[np.minimum(np.searchsorted(b.ids[order], a.ids), len(order) - 1)]
        return nearest_in_block(Pairs(a, b, ward=True), KEPT, i, i + (b.ids[i] == a.ids)).append_column("n", pa.array(a.n))

    found = _merged_lists(_searched(queries, clusters, answer, f"{LISTS}, n double", ("n",), sizes), KEPT, "n")
    return found.withColumn("bound", F.when(F.size("near") == KEPT, F.element_at("near", -1).getField("d")).otherwise(math.inf))


MERGES = "a long, b long, height double"


def merge_in_task(clusters: pa.Table) -> pa.Table:
    """All merges of a bounded number of clusters, by the recurrence for Ward's distance."""
    block = Block(clusters)
    ids, n = block.ids, block.n.copy()
    d = np.zeros((len(ids), len(ids)))
    pairs = Pairs(block, block, ward=True, single=False)
    for rows in block.tiles():
        for cols, costs, _ in pairs.near(rows):
            d[rows, cols] = np.round(costs, 9)
    np.fill_diagonal(d, np.inf)
    alive, out = np.ones(len(ids), bool), []
    while alive.sum() > 1:
        near = d.argmin(1)
        rows = np.flatnonzero(alive)
        pairs = [(i, j) for i, j in zip(rows.tolist(), near[rows].tolist(), strict=True) if i < j and near[j] == i]
        for i, j in pairs:
            out.append((int(ids[i]), int(ids[j]), float(d[i, j])))
            total = n[i] + n[j] + n
            new = ((n[i] + n) * d[i] + (n[j] + n) * d[j] - n * d[i, j]) / total
            new[~alive] = np.inf
            new[[i, j]] = np.inf
            d[i] = d[:, i] = np.round(new, 9)
            d[j] = d[:, j] = np.inf
            alive[j] = False
            n[i] += n[j]
    return pa.table([pa.array([m[k] for m in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], names=["a", "b", "height"])


def ward_merges(vectors: DataFrame) -> DataFrame:
    """(a, b, height): every merge of the hierarchy; ``a`` < ``b`` are the smallest numbers of the two
    clusters, ``height`` is the squared one of the usual dendrogram."""
    # Merged clusters are added as further versions, of which now and then the last ones are written anew.
    clusters, merges, near, turn, parts = materialize(vectors.withColumn("version", F.lit(0)), "clusters"), None, None, 0, 1
    count, values = _size(clusters)
    held, each = count, values / max(count, 1)
    while count > SMALL:
        if near is None:
            near = nearest_clusters(clusters, clusters)
        near, turn = materialize(near, "near"), turn + 1
        first = near.select("id", "n", F.element_at("near", 1).alias("e")).select("id", "n", F.col("e.other").alias("other"), F.col("e.d").alias("d"))
        back = first.select(F.col("id").alias("other"), F.col("other").alias("id"), F.col("n").alias("nb"))
        pairs = first.join(back, ["id", "other"]).filter("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("d").alias("height"), F.col("n").alias("na"), "nb")
        seen = Observation()
        pairs = materialize(pairs.observe(seen, F.count(F.lit(1)).alias("n")), "merges")
        merged = seen.get["n"]
        if not merged:
            raise RuntimeError("no two clusters are nearest to each other")
        merges = pairs.select("a", "b", "height") if merges is None else merges.unionByName(pairs.select("a", "b", "height"))
        side = lambda gone, mate, n, m: F.struct(F.col(gone).alias("gone"), F.col(mate).alias("mate"), F.col(n).alias("ng"), F.col(m).alias("nm"))
        gone = pairs.select(F.col("a").alias("to"), "height", F.explode(F.array(side("a", "b", "na", "nb"), side("b", "a", "nb", "na"))).alias("s")).select("to", "height", "s.*")
        gone = F.broadcast(gone) if merged <= FEW else gone
        dead = pairs.select(F.col("b").alias("id"), F.lit(0.0).alias("n"), F.array().cast("array<int>").alias("at"), F.array().cast("array<double>").alias("v"))
        added = _added(clusters.join(gone.select(F.col("gone").alias("id"), "to"), "id"))
        clusters = clusters.unionByName(materialize(added.unionByName(dead).withColumn("version", F.lit(turn)), "merged"))
        count, held, parts = count - merged, held + 2 * merged, parts + 1
        if held > 1.5 * count or parts > 8:
            last = clusters.groupBy("id").agg(F.max_by(F.struct("n", "at", "v"), "version").alias("c")).filter("c.n > 0")
            clusters, held, parts = materialize(last.select("id", "c.*", F.lit(turn).alias("version")), "clusters"), count, 1
        seen = Observation()
        told = materialize(_still_near(near, gone).observe(seen, F.count_if(~F.col("known")).alias("n")), "told")
        asked = told.filter("NOT known").select("id").unionByName(pairs.select(F.col("a").alias("id")))
        n = seen.get["n"] + merged
        queries = clusters.join(F.broadcast(asked) if n <= FEW else asked, "id", "left_semi")
        # A merged cluster may hold twice the values of others.
        near = told.filter("known").drop("known").unionByName(nearest_clusters(queries, clusters, [(n, round(2 * n * each)), (held, round(held * each))]))
    rest = clusters.withColumn("_all", F.lit(True)).groupBy("_all").applyInArrow(merge_in_task, MERGES)
    return materialize(rest if merges is None else merges.unionByName(rest), "hierarchy")


def _added(moved: DataFrame) -> DataFrame:
    """The sums of clusters and of those that they merge with (``to``)."""
    part = F.struct("n", "at", "v")
    both = moved.groupBy("to").agg(*[F.max_by(part, F.when(own, F.col("version"))).alias(c) for c, own in (("x", F.col("id") == F.col("to")), ("y", F.col("id") != F.col("to")))])
    held = lambda c: F.map_from_arrays(f"{c}.at", f"{c}.v")
    zero = F.lit(0.0)
    listed = F.array_sort(F.map_entries(F.map_zip_with(held("x"), held("y"), lambda _, p, q: F.coalesce(p, zero) + F.coalesce(q, zero))))
    apart = F.struct(F.transform(listed, lambda e: e.key).alias("at"), F.transform(listed, lambda e: e.value).alias("v"))
    same = F.struct(F.col("x.at").alias("at"), F.zip_with("x.v", "y.v", lambda p, q: p + q).alias("v"))
    total = both.select(F.col("to").alias("id"), (F.col("x.n") + F.col("y.n")).alias("n"), F.when(F.col("x.at") == F.col("y.at"), same).otherwise(apart).alias("s"))
    return total.select("id", "n", "s.at", "s.v")


def _still_near(near: DataFrame, gone: DataFrame) -> DataFrame:
    """The lists of clusters that have not merged, less what has, with lower bounds, and whether their first one is
    ``known`` to cost least. Merged ones of a list cost what the recurrence for Ward's distance says, at least."""
    rest = near.join(gone.select(F.col("gone").alias("id")), "id", "left_anti")
    each = rest.select("id", "n", "bound", F.explode("near").alias("e")).select("id", "n", "bound", "e.d", "e.other")
    mates = each.select("id", F.col("other").alias("mate"), F.col("d").alias("dm"))
    hits = each.join(gone, F.col("other") == F.col("gone")).join(mates, ["id", "mate"], "left")
    total = (F.col("n") + F.col("ng")) * F.col("d") + (F.col("n") + F.col("nm")) * F.coalesce("dm", "bound") - F.col("n") * F.col("height")
    # Less what rounding may have added.
    lower = F.min(total / (F.col("n") + F.col("ng") + F.col("nm"))) * (1 - 1e-12) - 1e-8
    rest = rest.join(hits.groupBy("id").agg(lower.alias("lower"), F.collect_list("gone").alias("hits")), "id", "left")
    left = F.when(F.col("hits").isNull(), F.col("near")).otherwise(F.filter("near", lambda e: ~F.array_contains("hits", e.other)))
    told = rest.select("id", left.alias("near"), F.least("bound", "lower").alias("bound"), "n")
    return told.withColumn("known", F.coalesce(F.try_element_at("near", F.lit(1)).getField("d") < F.col("bound"), F.lit(False)))


def ward_groups(vectors: DataFrame, names: DataFrame, key: str, k: int) -> DataFrame:
    """(``key``, group): the ``k`` clusters of Ward's hierarchy, each named by its smallest member."""
    merges = ward_merges(vectors)
    n = names.count()
    order = [F.col("height"), F.col("a"), F.col("b")]
    low = numbered(merges, order, "at").filter(F.col("at") < n - min(k, n))
    return _named(names, components(low.select(F.col("a").alias("src"), F.col("b").alias("dst"))), key)


def _named(names: DataFrame, found: DataFrame, key: str) -> DataFrame:
    rows = names.join(found.withColumnRenamed("node", "id"), "id", "left").select(key, F.coalesce("component", "id").alias("_c"))
    first = names.select(F.col("id").alias("_c"), F.col(key).alias("group"))
    return rows.join(first, "_c").select(key, "group")


def nearest_outside(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, near): for each query the ``LISTED`` nearest (d, other) among vectors of another ``part``, no farther than its
    ``limit`` if it has that column; a distance is at least either's ``core``."""
    bounded = "limit" in queries.columns

    def answer(a: Block, b: Block) -> pa.Table:
        own, part = a.column("part"), b.column("part")
        cores = a.column("core"), b.column("core")
        shut = np.searchsorted(part, own), np.searchsorted(part, own, "right")
        return nearest_in_block(Pairs(a, b), LISTED, *shut, limit=a.column("limit") if bounded else None, cores=cores)

    return _merged_lists(_searched(queries, rows, answer, LISTS, ("part",)), LISTED)


def core_distances(vectors: DataFrame, least: int) -> DataFrame:
    """(id, core): the distance to the ``least``-th nearest vector, itself counted; to the farthest if
    there are fewer."""

    def answer(a: Block, b: Block) -> pa.Table:
        shut = np.searchsorted(b.ids, a.ids), np.searchsorted(b.ids, a.ids, "right")
        return nearest_in_block(Pairs(a, b), max(1, least - 1), *shut)

    return _merged_lists(_searched(vectors, vectors, answer, LISTS), max(1, least - 1)).select("id", _core(least).alias("core"))


def _core(least: int):
    """The distance to the ``least``-th nearest one of a list, itself counted."""
    if least < 2:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at("near", F.lit(least - 1)).getField("d"), F.try_element_at("near", F.lit(-1)).getField("d"), F.lit(0.0))


def spanning_tree(vectors: DataFrame, least: int) -> DataFrame:
    """(a, b, d): the minimum spanning tree under the distance that is at least either's core."""
    alone = vectors.withColumn("part", F.col("id"))
    if listed := least - 1 <= LISTED // 2:
        rows = alone.withColumn("core", F.lit(0.0))
    else:
        rows = materialize(alone.join(core_distances(vectors, least), "id"), "cores")
    near = materialize(nearest_outside(rows, rows), "near")
    cores = near.select("id", _core(least).alias("core")) if listed else rows.select("id", "core")
    # All others are at least as far as ``bound``.
    bound = F.when(F.size("near") == LISTED, F.element_at("near", -1).getField("d")).otherwise(math.inf)
    members = materialize(near.select("id", bound.alias("bound")).join(cores, "id").withColumn("part", F.col("id")), "members")
    core = lambda c: cores.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"))
    pairs = near.select("id", F.explode("near").alias("e")).select(*_ends("id", "e.other"), F.col("e.d").alias("d")).distinct()
    far = pairs.join(core("a"), "a").join(core("b"), "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("d"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    edges, tree = materialize(far, "edges"), None
    while True:
        parts = members.groupBy("part").agg(F.min("bound").alias("bound"), F.count(F.lit(1)).alias("n"))
        both = edges.select(F.col("pa").alias("part"), "d", "a", "b").unionByName(edges.select(F.col("pb").alias("part"), "d", "a", "b"))
        best = both.groupBy("part").agg(F.min(F.struct("d", "a", "b")).alias("e"))
        parts = materialize(parts.join(best, "part", "left"), "parts")
        counts = parts.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("e.d") < F.col("bound")).alias("sure"), F.max_by("part", "n").alias("largest")).first()
        if counts["all"] < 2:
            break
        # A part's best edge is of the tree if no unknown one can be as near. Only if that is so of none, all but the
        # largest search, and theirs are.
        chosen = parts.filter(F.col("e.d") < F.col("bound")).select("e.*")
        if not counts.sure:
            seeking = parts.filter(F.col("part") != counts.largest).select("part", F.coalesce("e.d", F.lit(math.inf)).alias("limit"))
            asked = members.join(seeking, "part").filter("bound <= limit").select("id", "limit")
            held = vectors.join(members.select("id", "core", "part"), "id")
            found = materialize(nearest_outside(held.join(asked, "id"), held), "found")
            # Edges of which only one was asked for are as good as known.
            nearest = found.filter("size(near) > 0").select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"), F.col("e.d").alias("d"))
            side = lambda c, p: members.select(F.col("id").alias(c), F.col("part").alias(p))
            fresh = nearest.join(side("id", "pi"), "id").join(side("other", "po"), "other")
            a_first = F.col("id") < F.col("other")
            fresh = fresh.select(*_ends("id", "other"), "d", F.when(a_first, F.col("pi")).otherwise(F.col("po")).alias("pa"), F.when(a_first, F.col("po")).otherwise(F.col("pi")).alias("pb"))
            edges = materialize(edges.unionByName(fresh), "edges")
            both = edges.select(F.col("pa").alias("part"), "d", "a", "b").unionByName(edges.select(F.col("pb").alias("part"), "d", "a", "b"))
            chosen = both.join(seeking.select("part"), "part", "left_semi").groupBy("part").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.*")
            told = asked.join(found, "id", "left").select("id", F.when(F.size("near") == LISTED, F.element_at("near", -1).getField("d")).otherwise(F.col("limit")).alias("now"))
            members = members.join(told, "id", "left").withColumn("bound", F.greatest("bound", "now")).drop("now")
        links = materialize(chosen.join(edges, ["d", "a", "b"]).select("a", "b", "d", "pa", "pb").distinct(), "links")
        tree = links.select("a", "b", "d") if tree is None else tree.unionByName(links.select("a", "b", "d"))
        joined = materialize(components(links.select(F.col("pa").alias("src"), F.col("pb").alias("dst"))), "joined")
        to = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"to_{c}"))
        moved = edges.join(to("pa"), "pa", "left").join(to("pb"), "pb", "left")
        moved = moved.select("a", "b", "d", F.coalesce("to_pa", "pa").alias("pa"), F.coalesce("to_pb", "pb").alias("pb")).filter("pa <> pb")
        # Of the edges between two parts the best will do.
        edges = materialize(moved.groupBy(F.least("pa", "pb"), F.greatest("pa", "pb")).agg(F.min(F.struct("d", "a", "b", "pa", "pb")).alias("e")).select("e.*"), "edges")
        members = materialize(members.join(to("part"), "part", "left").withColumn("part", F.coalesce("to_part", "part")).drop("to_part"), "members")
    return tree if tree is not None else members.sparkSession.createDataFrame([], "a long, b long, d double")


def _ends(one: str, two: str) -> list:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def condense(links: list[tuple[int, int, float]], points: list[int], least: int) -> dict[int, int]:
    """Cluster of each point (its smallest member) from a spanning tree; -1 for noise.

    The tree is taken apart from its longest link down. A part of fewer than ``least`` points falls
    off; where two larger ones remain, the cluster ends and they are new ones. A cluster's
    stability is the sum over its points of 1 / d where they leave it, less 1 / d where it began; it
    is kept if that is no less than what is kept below it. The whole is no cluster.
    """
    # Single linkage: a node for each point and each link, joined from the shortest up.
    node = {p: i for i, p in enumerate(points)}
    size, sides, height, top = [1] * len(points), [None] * len(points), [0.0] * len(points), list(range(len(points)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    holder = list(range(len(points)))  # the tree's node of each root
    for a, b, d in sorted(links, key=lambda e: (e[2], e[0], e[1])):
        x, y = root(node[a]), root(node[b])
        size.append(size[holder[x]] + size[holder[y]])
        sides.append((holder[x], holder[y]))
        height.append(d)
        top[y] = x
        holder[x] = len(size) - 1
    start = len(size) - 1
    rate = lambda d: 1 / max(d, 1e-9)
    parent, born, stable, below, members = [None], [0.0], [0.0], [[]], [[]]

    def leave(n: int, cluster: int, at: float) -> None:
        """All points under ``n`` leave ``cluster``."""
        stack = [n]
        while stack:
            m = stack.pop()
            if sides[m] is None:
                members[cluster].append(m)
                stable[cluster] += at - born[cluster]
            else:
                stack += sides[m]

    todo = [(start, 0)] if points else []
    while todo:
        n, cluster = todo.pop()
        if sides[n] is None:
            leave(n, cluster, rate(0.0))
            continue
        at = rate(height[n])
        large = [s for s in sides[n] if size[s] >= least]
        if len(large) == 2:
            stable[cluster] += size[n] * (at - born[cluster])
            for s in sides[n]:
                parent.append(cluster)
                born.append(at)
                stable.append(0.0)
                below.append([])
                members.append([])
                below[cluster].append(len(parent) - 1)
                todo.append((s, len(parent) - 1))
            continue
        for s in sides[n]:
            if s in large:
                todo.append((s, cluster))
            else:
                leave(s, cluster, at)
    best, kept = [0.0] * len(parent), [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        under = sum(best[b] for b in below[c])
        kept[c] = stable[c] >= under
        best[c] = max(stable[c], under)
    out = dict.fromkeys(points, -1)
    todo = list(below[0])
    while todo:
        c = todo.pop()
        if not kept[c]:
            todo += below[c]
            continue
        own, stack = [], [c]
        while stack:
            m = stack.pop()
            own += members[m]
            stack += below[m]
        name = min(points[i] for i in own)
        out.update((points[i], name) for i in own)
    return out


def hdbscan_groups(vectors: DataFrame, names: DataFrame, key: str, least: int = 5, fewest: int = 5) -> DataFrame:
    """(``key``, group): density clusters, named by their smallest members; noise are groups of their
    own. With fewer than ``fewest`` labels, noise being one, Ward's ``fewest`` clusters instead."""
    vectors = materialize(vectors, "vectors")
    links = spanning_tree(vectors, least)
    none = F.lit(None).cast("long")
    alone = vectors.select(none.alias("a"), none.alias("b"), F.lit(None).cast("double").alias("d"), "id")
    every = links.withColumn("id", none).unionByName(alone)

    def label(rows: pa.Table) -> pa.Table:
        listed = list(zip(*(rows.column(c).to_pylist() for c in ("a", "b", "d", "id")), strict=True))
        found = condense([r[:3] for r in listed if r[3] is None], sorted(r[3] for r in listed if r[3] is not None), least)
        return pa.table([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["id", "label"])

    labels = materialize(every.withColumn("_all", F.lit(True)).groupBy("_all").applyInArrow(label, "id long, label long"), "labels")
    if labels.select("label").distinct().count() < fewest:
        return ward_groups(vectors, names, key, fewest)
    found = labels.select(F.col("id").alias("node"), F.when(F.col("label") < 0, F.col("id")).otherwise(F.col("label")).alias("component"))
    return _named(names, found, key)
