"""BPE encoding and decoding: speculate with greedy longest match, verify every adjacent pair.

A text is normalised and cut into pieces as the tokenizer file says. For each new piece, greedy
longest-match proposes tokens. A proposal is the piece's BPE encoding exactly if every token
encodes to itself and no merge can cross any boundary between two adjacent tokens; that is
tested for all distinct adjacent pairs of a batch at once, by undoing the merges on both sides
of the boundary from the latest back to the first. Only pieces that fail go through exact
merging.

Defined results: null text counts as empty, and empty texts have no tokens and decode to empty
text; very long texts and words are encoded whole; repeated rows are encoded each; strings of
special tokens inside a text, written exactly so, become their ids; empty tables give empty tables;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, table

#: Chunks between white space whose encodings a Python worker remembers, twice over.
CACHE_CHUNKS = 100_000

#: The White_Space characters of Unicode.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACE = re.compile(f"[{_SPACES}]+")
#: Characters that str.split() takes for white space but Unicode does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in shown else chr(spare)
        spare += b not in shown
    return out


class WordBpe:
    """A byte-level BPE with end-of-word suffix, read from a tokenizer file's JSON text."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        steps = [n["type"] for n in data["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or data["decoder"] or data["post_processor"]:
            raise ValueError("this tokenizer file asks for steps that are not supported here")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in data["added_tokens"]):
            raise ValueError("this tokenizer file asks for added tokens that are not supported here")
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for text, i in [*self.vocab.items(), *self.added.items()]:
            self.tokens[i] = text
        self.pieces = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.longest = max(map(len, self.vocab))
        merges = [(self.vocab[a], self.vocab[b]) for a, b in (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])]
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.made = [self.vocab[self.tokens[a] + self.tokens[b]] for a, b in merges]
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)  # rank of the merge that makes a token, -1 for single symbols
        for r, (a, b) in enumerate(merges):
            t = self.made[r]
            if self.born[t] < 0:
                self.left[t], self.right[t], self.born[t] = a, b, r
        self.size = size
        keys = np.array([a * size + b for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.symbol = byte_symbols()
        self.sound = np.zeros(size, bool)  # tokens that encode to themselves
        for text, i in self.vocab.items():
            self.sound[i] = self.merge(self.symbols(text)) == [i]
        self.spec, self.library = spec, None
        self.new: dict[str | int, tuple[str, int, str]] = {}
        self.old: dict[str | int, tuple[str, int, str]] = {}

    def forget(self) -> None:
        """Drop the remembered chunks, which an idle worker has no use for."""
        self.new, self.old = {}, {}

    def symbols(self, text: str) -> list[int]:
        """Ids of the single symbols of a vocabulary string."""
        ends = text.endswith(self.suffix) and len(text) > len(self.suffix)
        chars = list(text[: -len(self.suffix)] if ends else text)
        if ends:
            chars[-1] += self.suffix
        return [self.vocab[c] for c in chars]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact BPE: merge the pair of lowest rank, the leftmost first, until none is left."""
        rank, never = self.rank, len(self.rank)
        ranks = [rank.get(p, never) for p in zip(ids, ids[1:])]
        ids = list(ids)
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), never)
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), never)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for long pieces, with a heap: n log n steps."""
        import heapq

        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ids = list(ids)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (n := self.rank.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (n, i, ids[i], ids[after[i]]))
            if (h := before[i]) >= 0 and (n := self.rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (n, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def propose(self, text: str) -> list[int]:
        """Greedy longest match over a piece that carries the end-of-word suffix."""
        vocab, longest, at, out = self.vocab, self.longest, 0, []
        last = len(text) - len(self.suffix)
        while at < last:
            if len(text) - at <= longest and (t := vocab.get(text[at:])) is not None:
                out.append(t)
                break
            stop = min(last, at + longest)
            while (t := vocab.get(text[at:stop])) is None:
                stop -= 1
            if stop == last:  # the last symbol must carry the suffix
                stop -= 1
                while stop > at and (t := vocab.get(text[at:stop])) is None:
                    stop -= 1
                if stop == at:
                    t, stop = vocab[text[at : at + 1] + self.suffix], last
            out.append(t)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the boundary, for each pair of adjacent tokens.

        x is the piece left of the boundary, y the one right of it, seen backwards in time;
        x_end and y_end are the ranks at which they are used up inside their tokens. A merge of
        (x, y) happens if its rank comes first; among equal ranks the leftmost merge wins.
        """
        never = len(self.rank)
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_end = np.full(len(x), never + 1)
        y_end = np.full(len(x), never + 1)
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            key = x[live] * self.size + y[live]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            m = np.where(self.pair_keys[at] == key, self.pair_ranks[at], never + 5)
            crossed = (m < x_end[live]) & (m <= y_end[live])
            good[live[crossed]] = False
            live = live[~crossed]
            rx, ry = self.born[x[live]], self.born[y[live]]
            live, rx, ry = (v[(rx >= 0) | (ry >= 0)] for v in (live, rx, ry))
            undo_x = rx > ry
            i, j = live[undo_x], live[~undo_x]
            x_end[i], x[i] = rx[undo_x], self.right[x[i]]
            y_end[j], y[j] = ry[~undo_x], self.left[y[j]]
        return good

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Encodings of pieces of normalised text."""
        symbol, suffix = self.symbol, self.suffix
        marked = [(p if p.isascii() and p.isalnum() else "".join([symbol[c] for c in p.encode("utf-8", "surrogatepass")])) + suffix for p in pieces]
        proposals = [self.propose(m) for m in marked]
        counts = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(proposals)), counts)
        fails = np.zeros(len(proposals), bool)
        fails[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        fails[owner[inner[~good[back]]]] = True
        for k in np.flatnonzero(fails).tolist():
            ids = self.symbols(marked[k])
            proposals[k] = self.merge(ids) if len(ids) < 64 else self.merge_long(ids)
        return proposals

    def chunks(self, text: str) -> list[str | int]:
        """Normalised text cut at white space, which no piece spans; the ids of special tokens, which
        are looked for in the text as it is, stand alone."""
        parts = self.specials.split(text) if self.specials is not None else [text]
        if len(parts) == 1:
            return self._plain(text)
        out: list[str | int] = []
        for k, part in enumerate(parts):
            out += [self.added[part]] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if _SEPARATORS.search(text):
            parts = [p for p in _SPACE.split(text) if p]
            return ["".join(c.lower() for c in p) for p in parts]
        # One character at a time, a final sigma is an ordinary one.
        lower = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return lower.split()

    def _cut(self, chunk: str) -> list[str]:
        if chunk.isascii() or all(unicodedata.category(c) != "Cn" for c in chunk):
            return self.pieces.findall(chunk)
        # Characters newer than Python's Unicode tables: the library knows their classes and case.
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        text = self.library.normalizer.normalize_str(chunk)
        return [text[start:end] for _, (start, end) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_batch(self, texts: list[str | None]) -> tuple[list[str], list[int], list[str]]:
        """Per text: ids in decimal joined by a space, their number, and the decoded text."""
        split = [self.chunks(t) if t else [] for t in texts]
        new, old = self.new, self.old
        missing: dict[str, None] = {}
        for chunks in split:
            for c in chunks:
                if c not in new:
                    if isinstance(c, int):
                        new[c] = (str(c), 1, self.tokens[c])
                    elif (have := old.get(c)) is not None:
                        new[c] = have
                    else:
                        missing[c] = None
        if missing:
            spans, pieces, chunk_list = [], [], list(missing)
            for c in chunk_list:
                found = [c] if c.isascii() and c.isalpha() else self._cut(c)
                spans.append((len(pieces), len(pieces) + len(found)))
                pieces += found
            encoded = self.encode_pieces(pieces)
            tokens = self.tokens
            for c, (start, end) in zip(chunk_list, spans, strict=True):
                ids = [t for p in encoded[start:end] for t in p]
                new[c] = (" ".join(map(str, ids)), len(ids), " ".join([tokens[t] for t in ids]))
        out = []
        for chunks in split:
            got = [g for g in [new[c] for c in chunks] if g[1]]
            out.append((" ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got])))
        if len(new) > CACHE_CHUNKS:
            self.new, self.old = {}, new
        ids, counts, decoded = (list(x) for x in zip(*out)) if out else ([], [], [])
        return ids, counts, decoded


_LOADED: dict[int, WordBpe] = {}


def _loaded(spec: str) -> WordBpe:
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def encode_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``ids`` (decimal ids joined by one space), ``n_tokens``
    and ``decoded`` (the tokens' strings joined by one space, as a file without a decoder asks)."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for batch in slices(batches, text_col):
            ids, counts, decoded = bpe.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.string()), pa.array(counts, pa.int64()), pa.array(decoded, pa.string())], names=schema.names)
        bpe.forget()

    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return encoded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
