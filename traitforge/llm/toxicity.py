"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every sampled example is indexed under all its words. A word weighs (1 + log of its count in the
text) times its inverse document frequency over all documents, times its relevance: how far beyond
chance its share of documents differs between the labels, from ``FLOOR`` to 1. Without relevance
the many rare words of long texts drown the few that insult (on labels held out at sf0.1: F1 0.62,
with it 0.95).

Examples stand in blocks: each posting list keeps the largest weight in each block, so that a query
bounds the cosines of a block before it opens it. It opens the blocks with the largest bounds, then
all others that may still hold one of the ``NEIGHBOURS`` nearest. The votes of these, weighted by
cosine, are calibrated on the examples themselves, each left out of its own vote.

Learning reads a bounded sample (``PER_CLASS`` labelled documents of each label, of long ones pieces:
``learning.sampled_text``; equal texts once) outside the held-out fold; frequencies and scores cover
every whole text.

Defined results: null and empty texts, and texts without any word of the examples, have no nearest
example and a vote of 0, calibrated like all others; without labels of both classes all scores are
the share of toxic labels (0 without any); equally near examples count in order of their ids; very
long texts are scored whole; repeated rows are scored each; empty tables give empty tables; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, slices, small_batches, table
from .decontaminate import words_of
from .learning import labelled_sample, logistic, probability

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
PER_CLASS = 2000
NEIGHBOURS, BLOCK, FIRST_BLOCKS = 15, 32, 8
#: Relevance: standard errors that are chance, and the share that every word keeps.
CHANCE, FLOOR = 5.0, 0.02
#: Words shown as evidence.
EVIDENCE = 5

Vector = tuple[np.ndarray, np.ndarray]


def words(text: str | None) -> list[bytes]:
    return words_of(text.lower()) if text else []


def relevance(seen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """From the documents of each label (columns) that hold each word (rows): the difference of
    their shares in standard errors beyond ``CHANCE``, saturating at 1."""
    shares = seen / sizes
    error = np.sqrt((seen.sum(1) + 1) / sizes.sum() * (1 / sizes).sum())
    beyond = np.maximum(0, np.abs(shares[:, 1] - shares[:, 0]) / error - CHANCE)
    return FLOOR + beyond / (CHANCE + beyond)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all ranges laid end to end, and which range each is of."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) + (starts - (np.cumsum(sizes) - sizes))[which], which


class BlockMaxIndex:
    """Inverted index of example vectors with the largest weight of each term in each block."""

    def __init__(self, vectors: list[Vector], keys: list[str], labels: list[int], terms: int):
        # Examples whose heaviest term agrees stand together, so that block bounds are tight.
        heaviest = [int(t[np.lexsort((t, -w))[0]]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (heaviest[i], keys[i]))
        self.place = {i: p for p, i in enumerate(order)}
        self.keys, self.labels = [keys[i] for i in order], np.array([labels[i] for i in order])
        self.rank = np.empty(len(order), np.int64)
        self.rank[sorted(range(len(order)), key=lambda p: (self.keys[p], p))] = np.arange(len(order))
        self.blocks = -(-len(order) // BLOCK)
        docs = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        term = np.concatenate([vectors[i][0] for i in order])
        weight = np.concatenate([vectors[i][1] for i in order])
        by_term = np.argsort(term, kind="stable")
        term, self.docs, self.weights = term[by_term], docs[by_term].astype(np.int32), weight[by_term]
        block = self.docs // BLOCK
        opens = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.block, self.most = block[opens], np.maximum.reduceat(weight[by_term], opens) if len(opens) else np.zeros(0)
        self.postings = np.append(opens, len(term))
        self.lists = np.searchsorted(term[opens], np.arange(terms + 1))

    def nearest(self, query: Vector, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples other than ``but``, exact, those with no
        word in common left out; ties in order of keys."""
        terms, weights = query
        entry, of = _ranges(self.lists[terms], self.lists[terms + 1])
        block, weight = self.block[entry], weights[of]
        bound = np.bincount(block, weight * self.most[entry], self.blocks)
        score = np.zeros(len(self.labels))

        def visit(chosen: np.ndarray) -> None:
            inside = chosen[block]
            posting, of = _ranges(self.postings[entry[inside]], self.postings[entry[inside] + 1])
            score[:] += np.bincount(self.docs[posting], self.weights[posting] * weight[inside][of], len(score))
            if but >= 0:
                score[but] = 0

        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        first &= bound > 0
        visit(first)
        least = np.partition(score, -k)[-k] if len(score) >= k else 0.0
        rest = ~first & (bound > 0) & (bound >= least - 1e-9)
        if rest.any():
            visit(rest)
        if len(score) > k:
            found = np.flatnonzero((score > 0) & (score >= np.partition(score, -k)[-k] - 1e-9))
        else:
            found = np.flatnonzero(score > 0)
        rounded = score[found].round(9)
        best = found[np.lexsort((self.rank[found], -rounded))[:k]]
        return best, score[best].round(9)


class ToxicityModel:
    """Index and calibration; ``constant`` stands in where one label is missing."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int, sample: list[tuple[int, str, str]], counts: dict):
        total = sum(counts.values())
        self.constant = counts.get(1, 0) / total if total else 0.0
        self.usable = len({v for v, _, _ in sample}) == 2
        if not self.usable:
            return
        split = [words(t) for _, _, t in sample]
        self.terms = {w: i for i, w in enumerate(sorted(set().union(*split)))}
        seen = np.zeros((len(self.terms), 2))
        for (label, _, _), found in zip(sample, split, strict=True):
            for w in set(found):
                seen[self.terms[w], label] += 1
        idf = np.log((1 + n_docs) / (1 + np.array([frequency.get(w, 0) for w in self.terms]))) + 1
        y = np.array([v for v, _, _ in sample], float)
        share = relevance(seen, np.array([(y == 0).sum(), (y == 1).sum()], float))
        self.weight, self.telling = idf * share, share > FLOOR
        vectors = [self.vector(found) for found in split]
        self.index = BlockMaxIndex(vectors, [key for _, key, _ in sample], [v for v, _, _ in sample], len(self.terms))
        x = np.array([[self.votes(v, self.index.place[i])[0]] for i, v in enumerate(vectors)])
        share = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
        self.calibration = logistic(x, y, share / share.mean(), ridge=1e-2)

    def vector(self, found: list[bytes]) -> Vector:
        """Terms, in order, and weights of a unit vector; empty without any known word."""
        count = Counter(w for w in found if w in self.terms)
        terms = np.sort(np.fromiter(map(self.terms.__getitem__, count), np.int64, len(count)))
        if not len(terms):
            return terms, np.zeros(0)
        by_term = {self.terms[w]: n for w, n in count.items()}
        weight = (1 + np.log([by_term[t] for t in terms.tolist()])) * self.weight[terms]
        return terms, weight / np.sqrt((weight * weight).sum())

    def votes(self, query: Vector, but: int = -1) -> tuple[float, np.ndarray]:
        """Sum of the nearest examples' signed cosines (toxic +, clean -) over their full number,
        and their places."""
        best, cosines = self.index.nearest(query, NEIGHBOURS, but)
        return float((cosines * (2 * self.index.labels[best] - 1)).sum()) / NEIGHBOURS, best


def document_frequencies(docs: DataFrame, terms: set[bytes], text_col: str) -> tuple[dict[bytes, int], int]:
    """Of the examples' words, over all documents, and the number of documents."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for batch in slices(batches, text_col):
            for text in batch.column(0).to_pylist():
                seen.update(known.value.intersection(words(text)))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.binary()), pa.array([*seen.values(), n], pa.int64())], names=["term", "n"])

    rows = docs.select(text_col).mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    known.destroy()
    return found, found.pop(None, 0)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: ``id_col``, ``held_out``, ``score``, the ids of the nearest examples
    (``nearest``) and, for toxic documents, the weightiest telling words shared with toxic ones of
    these (``evidence``)."""
    spark = docs.sparkSession
    small_batches(spark)
    sample, counts = labelled_sample(docs, labels, label_col, FOLDS, HELD_OUT, PER_CLASS, id_col, text_col)
    sample = list({t: (v, i, t) for v, i, t in sample[::-1]}.values())[::-1]
    both = len({v for v, _, _ in sample}) == 2
    frequency, n_docs = document_frequencies(docs, {w for _, _, t in sample for w in words(t)}, text_col) if both else ({}, 0)
    model = spark.sparkContext.broadcast(ToxicityModel(frequency, n_docs, sample, counts))
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("score double, nearest array<string>, evidence array<string>").fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        names = [w.decode("utf-8", "replace") for w in known.terms] if known.usable else []
        for batch in slices(batches, text_col):
            nearest, evidence = ([[] for _ in range(batch.num_rows)] for _ in range(2))
            scores = np.full(batch.num_rows, known.constant)
            if known.usable:
                vectors = [known.vector(words(t)) for t in batch.column(1).to_pylist()]
                votes = [known.votes(v) for v in vectors]
                scores = probability(known.calibration, np.array([[v] for v, _ in votes]))
                nearest = [[known.index.keys[p] for p in best.tolist()] for _, best in votes]
                for k in np.flatnonzero(scores >= THRESHOLD).tolist():
                    evidence[k] = _shared(known, vectors[k], votes[k][1], names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(nearest, pa.list_(pa.string())), pa.array(evidence, pa.list_(pa.string()))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(score, schema).withColumn("held_out", fold(id_col, FOLDS) == HELD_OUT)


def _shared(known: ToxicityModel, query: Vector, best: np.ndarray, names: list[str]) -> list[str]:
    """The query's weightiest telling words that toxic ones of its nearest examples have."""
    index = known.index
    toxic, out = best[index.labels[best] == 1], []
    terms = query[0][np.argsort(-query[1], kind="stable")]
    for t in terms[known.telling[terms]].tolist():
        first, last = index.postings[index.lists[[t, t + 1]]]
        if np.isin(toxic, index.docs[first:last]).any():
            out.append(names[t])
            if len(out) == EVIDENCE:
                break
    return out


def op10_tfidf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
