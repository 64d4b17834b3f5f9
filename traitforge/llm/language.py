"""Language identification: a linear-chain conditional random field over the words of a text.

Every word gets a label by forward-backward. Emission weights come from hashed affixes and
character n-grams and from a lexicon entry for the word itself; transition weights are learned
with them, from code-switched sequences spliced out of labelled documents. A document's language
is the one with the largest mean probability over its words, which is its score.

Learning reads a bounded sample outside the held-out fold: ``PER_LANGUAGE`` documents of each
language, of very many languages an even share of ``IN_ALL`` documents, but ``FEWEST``, of long ones
pieces (``learning.sampled_text``). Every language that has a text with a letter there is learned.
The emission table has at most ``WEIGHTS`` weights: the more languages, the fewer buckets. Prediction
labels every word of every whole text.

Few languages run through forward-backward in blocks side by side, which takes their number to the third
power for a word; more than ``BLOCKWISE`` run word by word, all texts of a batch side by side: one matrix
product of the transitions a step.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything
if nothing can be learned; with one learned language every text with a letter has it; rows with
null lang are predicted but not learned from, whatever other rows of their id say; equally likely
languages go to the first by name; very long texts are labelled whole, in blocks; repeated rows are
predicted each; empty tables give empty tables; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, fold, mix64, slices, small_batches, table
from .learning import own_sample

FOLDS, HELD_OUT = 4, 2
PER_LANGUAGE = 500
#: Documents learned from in all, where languages are very many, but at least so many of each.
IN_ALL, FEWEST = 8000, 8
#: Buckets of features, and weights of all languages together; the order of n-grams.
BUCKETS, WEIGHTS, GRAMS = 1 << 17, 1 << 25, 4
#: Words times languages of the texts labelled at once, or of one text.
WORDS_BY_LANGUAGES = 1 << 23
#: Languages up to which blocks run side by side.
BLOCKWISE = 8
#: Training: sequences a step, words a sequence, mean words of a run of one language, steps.
SEQUENCES, SEQUENCE, RUN, STEPS, RATE, DECAY = 192, 48, 12, 150, 0.08, 1e-4
#: Words of a block in forward-backward.
SPAN = 64
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    found = _WORDS.findall(text.lower()) if text else []
    # Superscripts, fractions and the like are numbers, not letters.
    return [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def buckets_for(languages: int) -> int:
    """A power of two so that no more than ``WEIGHTS`` weights are kept, 1024 at least."""
    return max(1024, min(BUCKETS, 1 << (max(1, WEIGHTS // max(1, languages)).bit_length() - 1)))


def word_features(vocabulary: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in one array, and where each word's begin.

    n-grams of bytes inside ``<word>``: those that touch the marks are its affixes; the hash of
    the whole is its lexicon entry.
    """
    data = ("".join([f"<{w}>" for w in vocabulary])).encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8).astype(U64)
    begins = np.concatenate(([0], np.flatnonzero(raw[:-1] == ord(">")) + 1))
    n = len(raw)
    ends = np.append(begins[1:], n)
    last = np.repeat(ends, ends - begins)
    owner = np.repeat(np.arange(len(begins)), ends - begins)
    at = np.arange(n)
    rows, features = [], []
    with np.errstate(over="ignore"):
        gram = np.zeros(n, U64)
        for k in range(GRAMS):
            gram = gram.copy()
            gram[: n - k] = gram[: n - k] * U64(0x100000001B3) + raw[k:] + U64(1)
            inside = at + k < last
            rows.append(owner[inside])
            features.append(mix64(gram[inside] * U64(2 * k + 3)))
        whole = np.add.reduceat(mix64(raw + (at - begins[owner]).astype(U64) * U64(0x9E3779B97F4A7C15)), begins)
    rows.append(np.arange(len(begins)))
    features.append(mix64(whole))
    owners, values = np.concatenate(rows), (np.concatenate(features) >> U64(40)).astype(np.int64) % buckets
    order = np.argsort(owners, kind="stable")
    return values[order], np.searchsorted(owners[order], np.arange(len(begins)))


def posteriors(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Forward-backward over sequences laid end to end: label probabilities of each word.

    Sequences are cut into blocks that run side by side: block products first, then the chain of
    blocks, then the words inside each block.
    """
    k = emission.shape[1]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, k))
    if k > BLOCKWISE:
        return _side_by_side(emission, lengths, start, step)
    scores = np.exp(emission - emission.max(1, keepdims=True))
    start, step = np.exp(start - start.max()), np.exp(step - step.max())
    counts = -(-lengths // SPAN)
    first_block = np.cumsum(counts) - counts
    n_blocks = int(counts.sum())
    seq = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(n_blocks) - first_block[seq]
    offset = (np.cumsum(lengths) - lengths)[seq] + nth * SPAN
    size = np.minimum(SPAN, lengths[seq] - nth * SPAN)
    place = offset[:, None] + np.minimum(np.arange(SPAN), size[:, None] - 1)
    e = scores[place]
    live = np.arange(SPAN) < size[:, None]
    opens = nth == 0
    eye = np.eye(k)

    product = np.broadcast_to(eye, (n_blocks, k, k)).copy()
    if counts.max() > 1:
        for t in range(SPAN):
            after = (product.reshape(-1, k) @ step).reshape(n_blocks, k, k)
            if t == 0:
                after[opens] = product[opens]
            after *= e[:, t, None, :]
            after /= after.sum((1, 2), keepdims=True)
            product = np.where(live[:, t, None, None], after, product)
    enter = np.empty((n_blocks, k))
    leave = np.ones((n_blocks, k))
    enter[first_block] = start
    for j in range(1, int(counts.max())):
        b = first_block[counts > j] + j
        a = np.einsum("ni,nij->nj", enter[b - 1], product[b - 1])
        enter[b] = a / a.sum(1, keepdims=True)
    for j in range(int(counts.max()) - 1, 0, -1):
        b = first_block[counts > j] + j
        a = np.einsum("nij,nj->ni", product[b], leave[b])
        leave[b - 1] = a / a.sum(1, keepdims=True)

    forward = np.empty((n_blocks, SPAN, k))
    state = enter
    for t in range(SPAN):
        after = state @ step
        if t == 0:
            after[opens] = state[opens]
        after = after * e[:, t]
        after /= after.sum(1, keepdims=True)
        state = np.where(live[:, t, None], after, state)
        forward[:, t] = state
    state = leave
    for t in range(SPAN - 1, -1, -1):
        forward[:, t] *= state
        after = (e[:, t] * state) @ step.T
        after /= after.sum(1, keepdims=True)
        state = np.where(live[:, t, None], after, state)
    out = forward[live]
    return out / out.sum(1, keepdims=True)


def _side_by_side(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The same word by word, for all sequences that still have one at once, the longest first."""
    emission -= emission.max(1, keepdims=True)
    scores = np.exp(emission, out=emission)
    kind = scores.dtype
    move, state = np.exp(step - step.max()).astype(kind), np.exp(start - start.max()).astype(kind)
    order = np.argsort(-lengths, kind="stable")
    size, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
    alive = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than each place
    out = np.empty_like(scores)
    now = np.broadcast_to(state, (len(size), len(state)))
    for t in range(int(size[0])):
        at = begin[: alive[t]] + t
        after = (now[: alive[t]] @ move if t else now) * scores[at]
        after /= after.sum(1, keepdims=True)
        out[at] = now = after
    back = np.ones((len(size), len(state)), kind)
    for t in range(int(size[0]) - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        out[at] *= back[:n]
        after = (scores[at] * back[:n]) @ move.T
        after /= after.sum(1, keepdims=True)
        back[:n] = after
    out /= out.sum(1, keepdims=True)
    return out


class LanguageModel:
    """Emission table, start and transition weights of the languages learned."""

    def __init__(self, sample: list[tuple[str, str, str]], languages: list[str], seed: int = 7):
        self.languages = languages
        k = len(languages)
        self.buckets = buckets_for(k)
        self.table, self.start, self.step = np.zeros((self.buckets, k), np.float32), np.zeros(k), np.zeros((k, k))
        texts: dict[str, list[list[str]]] = {}
        for lang, _, t in sample:
            texts.setdefault(lang, []).append(words(t))
        pools = [[w for w in texts.get(name, []) if w] for name in languages]
        self.usable = bool(languages) and all(pools)
        if self.usable and k > 1:
            self._learn(pools, np.random.default_rng(seed))

    def emission(self, vocabulary: list[str]) -> np.ndarray:
        """Summed weights of each word's features, some hundred words at a time."""
        features, begins = word_features(vocabulary, self.buckets)
        ends = np.append(begins[1:], len(features))
        part = max(1, (1 << 22) // (64 * len(self.languages)))
        out = [np.add.reduceat(self.table[features[begins[i] : ends[min(i + part, len(begins)) - 1]]], begins[i : i + part] - begins[i], axis=0) for i in range(0, len(begins), part)]
        return np.concatenate(out)

    def _splice(self, pools: list[list[list[str]]], r: np.random.Generator) -> tuple[list[str], np.ndarray]:
        """Code-switched sequences: runs of words from documents of changing languages."""
        found: list[str] = []
        labels: list[int] = []
        while len(found) < SEQUENCES * SEQUENCE:
            lang = int(r.integers(len(pools)))
            doc = pools[lang][int(r.integers(len(pools[lang])))]
            n = min(len(doc), 1 + int(r.geometric(1 / RUN)))
            at = int(r.integers(len(doc) - n + 1))
            found += doc[at : at + n]
            labels += [lang] * n
        n = SEQUENCES * SEQUENCE
        return found[:n], np.array(labels[:n])

    def _learn(self, pools: list[list[list[str]]], r: np.random.Generator) -> None:
        """Adaptive gradient ascent on the conditional likelihood of the labels."""
        k = len(self.languages)
        table, start, step = self.table, self.start, self.step
        size_t, size_a, size_s = np.full(self.buckets, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
        lengths, slope = np.full(SEQUENCES, SEQUENCE), np.empty_like(table)
        for _ in range(STEPS):
            found, gold = self._splice(pools, r)
            vocabulary: dict[str, int] = {}
            at = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found])
            features, begins = word_features(list(vocabulary), self.buckets)
            emission = self.emission(list(vocabulary))[at].astype(float)
            given = posteriors(emission.copy(), lengths, start, step)
            error = -given
            error[np.arange(len(gold)), gold] += 1
            owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(begins, len(features))))
            for c in range(k):  # one language at a time: all features of all would be large
                by_word = np.bincount(at, error[:, c], len(vocabulary))
                slope[:, c] = np.bincount(features, by_word[owner], self.buckets) / SEQUENCES - DECAY * table[:, c]
            size_t += np.einsum("ij,ij->i", slope, slope)
            slope *= (RATE / np.sqrt(size_t)).astype(np.float32)[:, None]
            table += slope
            # Expected transitions from neighbouring words' joint probabilities.
            p = given.reshape(SEQUENCES, SEQUENCE, k)
            scores = np.exp(emission - emission.max(1, keepdims=True)).reshape(SEQUENCES, SEQUENCE, k)
            joint = self._pairs(scores, start, step)
            truth = np.zeros((k, k))
            g = gold.reshape(SEQUENCES, SEQUENCE)
            np.add.at(truth, (g[:, :-1].ravel(), g[:, 1:].ravel()), 1)
            slope_a = (truth - joint) / (SEQUENCES * SEQUENCE)
            size_a += slope_a * slope_a
            step += RATE * slope_a / np.sqrt(size_a)
            slope_s = (np.bincount(g[:, 0], minlength=k) - p[:, 0].sum(0)) / SEQUENCES
            size_s += slope_s * slope_s
            start += RATE * slope_s / np.sqrt(size_s)

    @staticmethod
    def _pairs(scores: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Expected number of each transition over sequences of one length."""
        move = np.exp(step - step.max())
        n = scores.shape[1]
        a = [np.exp(start - start.max()) * scores[:, 0]]
        a[0] = a[0] / a[0].sum(1, keepdims=True)
        for t in range(1, n):
            x = (a[-1] @ move) * scores[:, t]
            a.append(x / x.sum(1, keepdims=True))
        total, b = np.zeros_like(move), np.ones_like(a[0])
        for t in range(n - 1, 0, -1):
            y = scores[:, t] * b
            b = y @ move.T
            whole = (a[t - 1] * b).sum(1, keepdims=True)
            total += (a[t - 1] / whole).T @ y
            b /= b.sum(1, keepdims=True)
        return total * move

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean label probabilities of each text's words, and their number."""
        split = [words(t) for t in texts]
        lengths = np.array([len(w) for w in split])
        means = np.zeros((len(texts), len(self.languages)))
        words_at_once = max(1, WORDS_BY_LANGUAGES // max(1, len(self.languages)))
        if lengths.sum() > words_at_once and len(texts) > 1:
            half = len(texts) // 2
            return tuple(np.concatenate(x) for x in zip(self.label(texts[:half]), self.label(texts[half:]), strict=True))
        if not lengths.sum():
            return means, lengths
        vocabulary: dict[str, int] = {}
        at = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for ws in split for w in ws), np.int64, int(lengths.sum()))
        kind = float if len(self.languages) <= BLOCKWISE else np.float32
        emission = self.emission(list(vocabulary))[at].astype(kind)
        given = posteriors(emission, lengths, self.start, self.step)
        filled = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[filled]
        means[filled] = np.add.reduceat(given, starts, axis=0) / lengths[filled, None]
        return means, lengths


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    sample, _ = own_sample(docs, lang_col, FOLDS, HELD_OUT, PER_LANGUAGE, None, id_col, text_col, IN_ALL, FEWEST)
    found = {lang for lang, _, text in sample if words(text)}
    return LanguageModel(sample, sorted(found))


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``lang_pred``, ``score`` and ``shares`` of the languages."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("lang_pred string, score double, shares map<string,double>").fields])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 19):
            names, scores, means = _predicted(known.value, batch.column(1).to_pylist())
            shares = [list(zip(known.value.languages, m, strict=True)) if n != UNKNOWN else [] for n, m in zip(names, means.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(predict, schema)


def _predicted(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    if not model.usable:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros((len(texts), 0))
    means, lengths = model.label(texts)
    best = means.argmax(1)
    scores = np.clip(np.where(lengths > 0, means.max(1), 0.0), 0, 1)
    return [model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), lengths.tolist(), strict=True)], scores, means


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of at least ``least``."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 19):
            names, scores, _ = _predicted(known.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array((np.array(names) != UNKNOWN) & (scores >= least)))

    return docs.mapInArrow(keep, docs.schema)


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs, learn_languages(docs))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
