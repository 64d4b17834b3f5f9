"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A document's set of word shingles gives ``HASHES`` minimum values, of which ``BITS`` bits each are
kept. The signature distance of two documents is the number of values that differ. Signatures are
cut into ``CHUNKS`` chunks; two that differ in at most ``DISTANCE`` values differ in at most
floor(DISTANCE / CHUNKS) = 1 values of some chunk. So each chunk is indexed under the keys that
remain when one of its values is left out: all pairs within the distance meet under some key. At a
similarity of 0.8 a pair exceeds the distance with probability 0.0002, at 0.85 with 0.000002.

Pairs are never formed from all members of a key. Documents with equal sets are one class. In
each key the class that shares most keys with others is the hub, and the others are compared with
it; what links joins one component. Only members of a key that are still in different components
after that are compared with each other, in blocks, each pair under its first common key: first
every member outside the key's main component with its nearest one, then, once those links have
joined what they can, all that are still apart. Bitmaps of the sets, whose difference is never more
than that of the sets, spare nearly all pairs that cannot link. Every link is confirmed on full sets.

A shingle is named by 128 bits made from 128-bit cryptographic digests of its words, so that full
sets are compared by these names. What is guaranteed: no pair is linked that is not similar enough,
and every pair within the signature distance is linked or joined through others; a similar pair
beyond the distance may be missed, with the probabilities above.

Defined results: words are what stands between ASCII white space, A-Z lower-cased; null texts and
texts without words have empty sets and link with nothing; with fewer words than the shingle
length, the whole sequence is the only shingle; very long texts give sets as long;
equal texts under any ids are one component, repeated rows included; a component's name is its smallest id that is not null, and a row without
id is kept if it is alone; empty tables give empty tables; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import U64, digests, materialize, mix64, slices, small_batches, table, text_print

HASHES, BITS, DISTANCE, CHUNKS = 48, 16, 20, 11
#: Members of one key that are compared with each other in one step.
BLOCK = 512
#: Bits of the bitmap that bounds the difference of two sets from below.
BITMAP = 4096
#: Bytes of text hashed at once.
PIECE = 1 << 19
#: Words whose digests a Python worker remembers.
REMEMBERED = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of a shingle's name, two numbers of 64 bits: sets are arrays of two columns.
NAME_BYTES = 16
with np.errstate(over="ignore"):
    _MULTIPLIERS = mix64(np.arange(1, HASHES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_PLACES = [mix64(np.array([k + 77], U64))[0] | U64(1) for k in range(16)]


_KNOWN: dict[bytes, int] = {}
_NAMES = np.empty((0, 2), U64)


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all texts, one after the other, and the number of words of each."""
    global _NAMES
    split = [t.translate(_LOWER).split() for t in texts]
    if len(_KNOWN) > REMEMBERED:
        _KNOWN.clear()
        _NAMES = _NAMES[:0]
    fresh = list(set().union(*split).difference(_KNOWN))
    if fresh:
        _KNOWN.update(zip(fresh, range(len(_KNOWN), len(_KNOWN) + len(fresh)), strict=True))
        _NAMES = np.concatenate([_NAMES, np.frombuffer(b"".join(digests(fresh)), U64).reshape(-1, 2)])
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    at = np.fromiter(map(_KNOWN.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    return _NAMES[at], sizes


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of all texts, text by text in rising order, and the bounds of each."""
    words, counts = word_names(texts)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), shingles)
    starts = np.arange(len(owner)) + (np.cumsum(counts) - counts - (np.cumsum(shingles) - shingles))[owner]
    short = np.flatnonzero(counts[owner] < width)  # a text of few words is one shingle of them all
    lanes = []
    with np.errstate(over="ignore"):
        for lane in (0, 1):
            column = np.append(words[:, lane], np.zeros(width, U64))
            mixed = column[starts]
            for k in range(1, width):
                mixed = mix64(mixed * U64(0x9E3779B97F4A7C15) + column[starts + k])
            for i in short.tolist():
                x = column[starts[i] : starts[i] + 1]
                for k in range(1, counts[owner[i]]):
                    x = mix64(x * U64(0x9E3779B97F4A7C15) + column[starts[i] + k])
                mixed[i] = mix64(x + U64(counts[owner[i]]))[0]
            lanes.append(mixed)
    a, b = lanes
    order = np.lexsort((a, owner))
    owner, a, b = owner[order], a[order], b[order]
    same = (a[1:] == a[:-1]) & (owner[1:] == owner[:-1])
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((b, a, owner))
        owner, a, b = owner[order], a[order], b[order]
        same = (a[1:] == a[:-1]) & (owner[1:] == owner[:-1]) & (b[1:] == b[:-1])
    new = np.ones(len(a), bool)
    new[1:] = ~same
    return np.stack([a[new], b[new]], 1), np.searchsorted(owner[new], np.arange(len(texts) + 1))


def common_names(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sets of names."""
    both = np.concatenate([x, y])
    order = np.argsort(both[:, 0])
    a = both[order, 0]
    same = np.flatnonzero(a[1:] == a[:-1])
    if (both[order[same + 1], 1] != both[order[same], 1]).any():
        return len(set(map(tuple, x.tolist())) & set(map(tuple, y.tolist())))
    return len(same)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """b-bit minimum hashes, one row for each set; rows of empty sets are zero."""
    filled = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, HASHES), np.uint16)
    if len(filled):
        first = np.ascontiguousarray(values[:, 0])
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                least = np.minimum.reduceat(first * _MULTIPLIERS[k], bounds[:-1][filled])
                out[filled, k] = (mix64(least) >> U64(64 - BITS)).astype(np.uint16)
    return out


def _left_out() -> list[tuple[int, np.ndarray]]:
    """(chunk, columns that stay) for each value of each chunk left out in turn."""
    out = []
    for c, columns in enumerate(np.array_split(np.arange(HASHES), CHUNKS)):
        out += [(c, np.delete(columns, k)) for k in range(len(columns))]
    return out


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of each signature, one column for each chunk and left-out value."""
    out = np.empty((len(sigs), 0), np.int64)
    keys = []
    with np.errstate(over="ignore"):
        for variant, (_, columns) in enumerate(_left_out()):
            h = np.full(len(sigs), variant + 1, U64)
            for c in columns:
                h = mix64(h * U64(0x9E3779B97F4A7C15) + sigs[:, c].astype(U64) + U64(1))
            keys.append(h.view(np.int64))
    return np.stack(keys, 1) if keys else out


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """(id, print, n, cls, sig): set size, set digest and signature of each row."""
    schema = T.StructType([docs.schema["id"], docs.schema["print"], *T._parse_datatype_string("n long, cls binary, sig binary").fields])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", PIECE):
            values, bounds = shingle_sets(batch.column(2).to_pylist(), width)
            sigs = signatures(values, bounds)
            whole = memoryview(values.tobytes())
            names = digests(whole[s * NAME_BYTES : e * NAME_BYTES] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(names, pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary())], names=schema.names)

    return docs.mapInArrow(profile, schema)


def _index(classes: DataFrame) -> DataFrame:
    """(key, cls) under which classes meet."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = chunk_keys(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, HASHES))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1])))], names=["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(index, "key long, cls binary")


def _within_distance(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures differ in at most ``DISTANCE`` values."""
    a = classes.select(F.col("cls").alias("a"), F.col("sig").alias("sa"))
    b = classes.select(F.col("cls").alias("b"), F.col("sig").alias("sb"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= DISTANCE))

    return pairs.join(a, "a").join(b, "b").mapInArrow(near, "a binary, b binary")


def _blocks(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different components that may link, from keys cut into blocks: all, or for
    each member outside the block's main component the ``nearest`` only."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "cls", "comp", "sig", "n", "bitmap")

    def pairs(rows: list[dict]) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(-1, HASHES)
        keys = chunk_keys(sig)
        variant = int(np.argmax((keys == rows[0]["key"]).all(0)))
        comp = np.unique([r["comp"] for r in rows], return_inverse=True)[1]
        own, n = (np.array([r[c] for r in rows]) for c in ("own", "n"))
        bits = np.frombuffer(b"".join(r["bitmap"] for r in rows), U64).reshape(len(rows), -1)
        main = np.bincount(comp).argmax()
        left, right = [], []
        for i in range(len(rows) - 1) if not nearest else np.flatnonzero(comp != main).tolist():
            rest = slice(0 if nearest else i + 1, None)
            asked = comp[rest] != comp[i]
            # In a step of two blocks, pairs inside one block are left to that block's own step.
            if rows[0]["p"] != rows[0]["q"]:
                asked &= own[rest] != own[i]
            at = np.flatnonzero(asked) + rest.start
            distance = (sig[at] != sig[i]).sum(1)
            at, distance = at[distance <= DISTANCE], distance[distance <= DISTANCE]
            differ = np.bitwise_count(bits[at] ^ bits[i]).sum(1)
            mine = ((keys[at] == keys[i]).argmax(1) == variant) & (differ * (100 + percent) <= (100 - percent) * (n[i] + n[at]))
            at = at[mine]
            if nearest and len(at):
                at = at[[distance[mine].argmin()]]
            left += [rows[i]["cls"]] * len(at)
            right += [rows[j]["cls"] for j in at]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["key"], row["p"], row["q"]) != (held[0]["key"], held[0]["p"], held[0]["q"]):
                    yield pairs(held)
                    held = []
                held.append(row)
        if held:
            yield pairs(held)

    order = ["key", "p", "q"]
    found = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class NearDuplicates:
    """Near-duplicate classes of a table; see the module's text for the method."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80):
        small_batches(docs.sparkSession)
        self.width, self.percent = width, percent
        self.docs = docs.select(F.col(id_col).alias("id"), text_print(F.col(text_col)).alias("print"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
        self.rows = materialize(_profiles(self.docs, width), "profiles")

    def _sets(self, asked: DataFrame, where: DataFrame) -> DataFrame:
        """(cls, hashes): the full shingle sets of the classes ``asked``."""
        width, docs, at = self.width, self.docs, self.docs.columns.index("body")
        asked = asked.join(where, "cls").select("cls", F.col("place.id").alias("wid"), F.col("place.print").alias("wprint"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze = zstandard.ZstdCompressor(level=1).compress
            for batch in slices(batches, "body"):
                yield batch.set_column(at, "body", pa.array([squeeze(b) for b in batch.column(at).to_pylist()], pa.binary()))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor().decompress
            for batch in slices(batches, "body", PIECE):
                values, bounds = shingle_sets([unpack(b) for b in batch.column(1).to_pylist()], width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["cls", "hashes"])

        packed = docs.mapInArrow(pack, docs.schema)
        texts = packed.join(asked, packed["id"].eqNullSafe(F.col("wid")) & (packed["print"] == F.col("wprint"))).select("cls", "body")
        return materialize(texts.mapInArrow(sets, "cls binary, hashes binary").dropDuplicates(["cls"]), "sets")

    def _confirmed(self, pairs: DataFrame, full: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        percent = self.percent

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = (np.frombuffer(v, U64).reshape(-1, 2) for v in (x, y))
                    common = common_names(x, y)
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        joined = pairs.join(full.withColumnsRenamed({"cls": "a", "hashes": "ha"}), "a").join(full.withColumnsRenamed({"cls": "b", "hashes": "hb"}), "b")
        return joined.select("a", "b", "ha", "hb").mapInArrow(confirm, "a binary, b binary")

    @staticmethod
    def _bitmaps(full: DataFrame) -> DataFrame:
        """(cls, n, bitmap): set sizes, and one bit for each shingle's hash."""

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, maps = [], []
                for hashes in batch.column(1).to_pylist():
                    values = np.frombuffer(hashes, U64)[::2]
                    bits = np.zeros(BITMAP, bool)
                    bits[(values % U64(BITMAP)).astype(np.int64)] = True
                    sizes.append(len(values))
                    maps.append(np.packbits(bits).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], names=["cls", "n", "bitmap"])

        return full.mapInArrow(mark, "cls binary, n long, bitmap binary")

    @staticmethod
    def _apart(members: DataFrame, joined: DataFrame) -> DataFrame:
        """(key, cls, comp, size) of the keys whose members are in different components."""
        named = members.join(joined.withColumnsRenamed({"node": "cls", "component": "comp"}), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        named = materialize(named.select("key", "cls", "comp"), "rest")
        apart = named.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("key", "size")
        return materialize(named.join(apart, "key"), "apart")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Confirmed links (a, b) between classes that span every component, and the classes."""
        filled = self.rows.filter("n > 0")
        classes = materialize(filled.groupBy("cls").agg(F.min(F.struct("id", "print")).alias("place"), F.first("sig").alias("sig")), "classes")
        keys = materialize(_index(classes), "keys")
        met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shared = materialize(keys.join(met, "key"), "shared")
        weight = shared.groupBy("cls").agg(F.sum("size").alias("weight"))
        weighed = shared.join(weight, "cls")
        hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "cls"))["cls"].alias("hub"))
        hubbed = materialize(shared.join(hubs, "key"), "hubbed")
        first = hubbed.filter("cls != hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        where = classes.select("cls", "place")
        near = materialize(_within_distance(first, classes), "near")
        asked = near.select(F.col("a").alias("cls")).unionByName(near.select(F.col("b").alias("cls"))).distinct()
        links = materialize(self._confirmed(near, self._sets(asked, where)), "confirmed")
        so_far = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        rest = self._apart(hubbed.filter("size > 2 AND cls != hub").select("key", "cls"), so_far)
        if not rest.isEmpty():
            full = self._sets(rest.select("cls").distinct(), where)
            told = materialize(classes.select("cls", "sig").join(self._bitmaps(full), "cls"), "told")
            first = materialize(_blocks(rest.join(told, "cls"), self.percent, nearest=True), "nearest")
            links = links.unionByName(materialize(self._confirmed(first, full), "confirmed"))
            rest = self._apart(rest.select("key", "cls"), components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
            pairs = materialize(_blocks(rest.join(told, "cls"), self.percent, nearest=False).join(first, ["a", "b"], "left_anti"), "pairs")
            links = links.unionByName(materialize(self._confirmed(pairs, full), "confirmed"))
        return links, classes

    def groups(self) -> DataFrame:
        """One row per document: ``id``, ``print`` (hash of its text), ``n`` (set size),
        ``component``, ``kept``, and ``leader``: whether it is the group's first by id and text."""
        links, classes = self.links()
        joined = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"node": "cls", "component": "comp"})
        members = classes.select("cls").join(joined, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "print")
        firsts = self.rows.filter("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.min(place).alias("first"))
        named = members.join(firsts, "cls")
        names = named.groupBy("comp").agg(F.min("least").alias("component"), F.min("first").alias("first"))
        of_class = named.select("cls", "comp").join(names, "comp").select("cls", "component", "first")
        out = self.rows.drop("sig").join(of_class, "cls", "left")
        component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
        leader = (F.col("n") == 0) | place.eqNullSafe(F.col("first"))
        return out.select("id", "print", "n", component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"), leader.alias("leader"))


def op9_minhash_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = NearDuplicates(table(spark, sf_dir, "documents"), width=4, percent=80).groups()
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


OP9_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc.doc_id = component_id AS kept
FROM doc JOIN least USING (doc_id) LEFT JOIN size USING (doc_id)
"""
