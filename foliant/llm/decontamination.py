"""Benchmark decontamination by latent semantic retrieval.

Passages of documents and benchmark items are TF-IDF vectors over the items' words, with document
frequencies counted over the whole corpus; every word weighs, also one that all documents have. A
randomised SVD of all passages in one look, its products summed over the tasks, gives a latent space. Long items are searched in
pieces; around passages whose cosine with a piece is high, or that hold much of its weight,
the text is compared with the whole item word by word: a longest common subsequence that covers the item
is a leak, a shorter one only if the item's answer is there too.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch, counted
from foliant.llm.textbytes import LETTERS, column_bytes, row_chunks, split, trimmed

#: Words of a passage, and between the starts of passages.
WINDOW, STRIDE = 48, 16
#: Blocks of STRIDE words in a passage.
BLOCKS = WINDOW // STRIDE
#: Places that are summed one after the other at most.
RUN = 16
#: Words of a piece of an item at most; a passage holds two thirds of one.
PIECE = 72
#: Dimensions of the latent space, and extra ones of the random sketch.
RANK, EXTRA = 160, 16
#: Items weigh so many times as much in the fit as all passages.
ITEM_WEIGHT = 4.0
#: Words of a row of the sums that tasks hand on.
ROW_WORDS = 64
#: Items that are searched for in one pass at most; more take more passes.
BLOCK_ITEMS = 4000
#: A passage is compared with an item from this cosine on, or if it holds this share of the item's weight, whatever else it holds.
COSINE, COVER = 0.45, 0.5
#: Item words that a passage must have, fewer if a shorter item can leak with fewer.
LEAST_HITS = 3
#: Shares of an item's words in a common subsequence: a leak, or a paraphrase if so much of the answer's words is near.
LEAK, PARAPHRASE, ANSWER = 0.6, 0.5, 0.75
SEED = 20240607
#: Bytes of the items' words as dense rows at most.
DENSE = 32 << 20
#: Bytes of text and words that are worked on at once.
CHUNK, WORDS = 1 << 18, 40_000


class Vocabulary(dict):
    """The items' words, as bytes, to numbers; any other word is -1."""

    def numbers(self, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the lower-cased words of each row, runs of letters, digits and anything beyond ASCII, and the rows' offsets into them."""
        texts = split(d, o, LETTERS)
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=first[1:])
        return np.fromiter(map(self.get, itertools.chain.from_iterable(texts), itertools.repeat(-1)), dtype=np.int64, count=int(first[-1])), first


def split_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: the last sentence is the answer, of a single one the last third of its words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    cut = len(w) - max(1, len(w) // 3)
    return " ".join(w[:cut]), " ".join(w[cut:])


def lcs(masks: dict[int, int], n: int, words) -> int:
    """Length of the longest common subsequence of a pattern of n words (word to bits of its places) and words."""
    ones = (1 << n) - 1
    v = ones
    for w in words:
        if u := v & masks.get(w, 0):
            v = ((v + u) | (v - u)) & ones
    return n - v.bit_count()


@dataclass
class Items:
    """Items with words, answers, and pieces of their words: of each the item. Vectors are the pieces'."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: Vocabulary
    pieces: list[np.ndarray]
    item: np.ndarray
    weights: np.ndarray | None = None
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None
    lengths: np.ndarray | None = None
    least: int = 1

    def kind(self) -> np.dtype:
        """What words' numbers are written as."""
        return np.dtype("<i2" if len(self.vocabulary) < 1 << 15 else "<i4")

    @staticmethod
    def read(rows: list[tuple[int, str]]) -> Items:
        def of(text):
            d = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
            return split(d, np.array([0, len(d)]), LETTERS)[0]

        found = [(i, w, of(split_answer(t)[1])) for i, t in rows if t and (w := of(t))]
        vocabulary = Vocabulary({w: k for k, w in enumerate(sorted({x for _, words, _ in found for x in words}))})
        numbers = lambda words: np.array([vocabulary[x] for x in words], dtype=np.int64)
        least = min([LEAST_HITS] + [math.ceil(PARAPHRASE * len(w)) for _, w, _ in found])
        words = [numbers(w) for _, w, _ in found]
        # as few pieces as may be, of like lengths: of a text that holds half an item, some stretch holds half a piece
        pieces = [np.array_split(w, -(-len(w) // PIECE)) for w in words]
        item = np.repeat(np.arange(len(words)), [len(p) for p in pieces])
        return Items([i for i, _, _ in found], words, [numbers(w) for _, _, w in found], vocabulary, [x for p in pieces for x in p], item, least=least)


def _rows(items: Items, batches) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Ids, numbers of the words and the rows' offsets into them, some rows at a time: of texts, or of words that _numbered() has written."""
    for batch in batches:
        d, o = column_bytes(batch.column(1))
        if pa.types.is_binary(batch.column(1).type) or pa.types.is_large_binary(batch.column(1).type):
            kind = items.kind()
            for a, b in row_chunks(o, WORDS * kind.itemsize):
                yield batch.column(0).slice(a, b - a).to_pylist(), np.frombuffer(d[o[a] : o[b]].tobytes(), dtype=kind).astype(np.int64), (o[a : b + 1] - o[a]) // kind.itemsize
            continue
        for a, b in row_chunks(o, CHUNK):
            h, first = items.vocabulary.numbers(d[o[a] : o[b]], o[a : b + 1] - o[a])
            yield batch.column(0).slice(a, b - a).to_pylist(), h, first


def _numbered(items: Items):
    """Each row's id and the numbers of its words as bytes, so that texts are parted once."""

    def run(batches):
        for ids, h, first in _rows(items, batches):
            words = h.astype(items.kind())
            bounds = pa.py_buffer((first * words.itemsize).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.Array.from_buffers(pa.binary(), len(ids), [None, bounds, pa.py_buffer(words.tobytes())])], names=["doc_id", "words"])

    return trimmed(run)


def _frequencies(items: Items):
    def run(batches):
        df = np.zeros(len(items.vocabulary), dtype=np.int64)
        for ids, h, first in _rows(items, batches):
            row = np.repeat(np.arange(len(ids)), np.diff(first))
            keys = np.unique((row * len(df) + h)[h >= 0])
            df += np.bincount(keys % len(df), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["word", "df"])

    return trimmed(run)


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in blocks of STRIDE words, those with words in BLOCKS at least: row, first and last word, and whether a passage begins there."""
    size = np.diff(first)
    n = np.where(size > 0, np.maximum(BLOCKS, -(-size // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lo = np.minimum(first[row] + place * STRIDE, first[row + 1])
    return row, lo, np.minimum(lo + STRIDE, first[row + 1]), place <= n[row] - BLOCKS


def windows(items: Items, h: np.ndarray, first: np.ndarray):
    """Passages with enough item words: document, first and last word, and the range of their item words; those words and their places."""
    kept = np.flatnonzero(h >= 0)
    row, lo, hi, opens = _blocks(first)
    g = np.flatnonzero(opens)
    if not len(kept):
        return None
    lo, hi = lo[g], hi[g + BLOCKS - 1]
    a, b = np.searchsorted(kept, lo), np.searchsorted(kept, hi)
    some = b - a >= items.least
    return row[g[some]], lo[some], hi[some], a[some], b[some], h[kept], kept


def _weights(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequencies, which stay above zero for words of all documents."""
    return np.log1p(n / np.maximum(df, 1))


def _sums(table: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows of a table at places, over runs of so many places one after the other; long runs are summed by parts."""
    most = int(size.max()) if len(size) else 0
    if most > RUN:
        parts = -(-size // RUN)
        some = parts > 0
        length = np.full(int(parts.sum()), RUN)
        length[np.cumsum(parts)[some] - 1] = (size - (parts - 1) * RUN)[some]
        return _sums(_sums(table, at, length), np.arange(len(length)), parts)
    # runs by length, the longest first: their first places, then the second ones of those that have one, and so on
    order = np.argsort(-size, kind="stable")
    start, length = (np.cumsum(size) - size)[order], size[order]
    sums = np.zeros((len(order), table.shape[1]), dtype=table.dtype)
    for j in range(most):
        m = int(np.searchsorted(-length, -j, "left"))
        sums[:m] += table.take(at[start[:m] + j], axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


class Passages:
    """The passages of some rows as sums over blocks, which they share."""

    def __init__(self, items: Items, h: np.ndarray, first: np.ndarray):
        self.kept = np.flatnonzero(h >= 0)
        self.at = h[self.kept]
        self.row, self.lo, self.hi, opens = _blocks(first)
        self.a, self.b = np.searchsorted(self.kept, self.lo), np.searchsorted(self.kept, self.hi)
        g = np.flatnonzero(opens)
        #: Blocks where passages with enough item words begin.
        self.begin = g[self.b[g + BLOCKS - 1] - self.a[g] >= items.least]

    def vectors(self, table: np.ndarray) -> np.ndarray:
        """Sums of the rows of a weighted table over each passage's item words."""
        s = _sums(table, self.at, self.b - self.a)
        v = s[self.begin]
        for k in range(1, BLOCKS):
            v += s[self.begin + k]
        return v

    def back(self, v: np.ndarray, total: np.ndarray) -> None:
        """Adds to each word's row of total the vectors of the passages that it is in, as often as it is there."""
        z = np.zeros((len(self.row), v.shape[1]), dtype=v.dtype)
        for k in range(BLOCKS):
            z[self.begin + k] += v
        block = np.repeat(np.arange(len(z)), self.b - self.a)
        order = np.argsort(self.at.astype(np.uint16) if len(total) <= 1 << 16 else self.at, kind="stable")
        n = np.bincount(self.at, minlength=len(total))
        some = np.flatnonzero(n)
        total[some] += _sums(z, block[order], n[some])

    def unit(self, items: Items) -> np.ndarray:
        """Inverse norms of the passages' TF-IDF vectors, words counted as if distinct."""
        c = np.concatenate(([0.0], np.cumsum(items.weights[self.at] ** 2)))
        return 1 / np.sqrt(np.maximum(c[self.b[self.begin + BLOCKS - 1]] - c[self.a[self.begin]], 1e-12))


class Rows:
    """The pieces' TF-IDF vectors as units, word by word, and their lengths."""

    def __init__(self, items: Items):
        counted = [np.unique(w, return_counts=True) for w in items.pieces]
        self.word = np.concatenate([w for w, _ in counted])
        self.n, size = len(counted), np.array([len(w) for w, _ in counted])
        self.first = np.cumsum(size) - size
        value = np.concatenate([c for _, c in counted]) * items.weights[self.word]
        self.lengths = np.maximum(np.sqrt(np.add.reduceat(value**2, self.first)), 1e-12)
        self.value = value / np.repeat(self.lengths, size)
        self.ends = self.first + size

    def times(self, m: np.ndarray, some: int = 256) -> np.ndarray:
        """The vectors times a table by words, some pieces at a time."""
        out = np.zeros((self.n, m.shape[1]))
        for i in range(0, self.n, some):
            j = min(i + some, self.n)
            x, y = self.first[i], self.ends[j - 1]
            out[i:j] = np.add.reduceat(self.value[x:y, None] * m[self.word[x:y]], self.first[i:j] - x, axis=0)
        return out

    def back(self, m: np.ndarray, words: int) -> np.ndarray:
        """The vectors, transposed, times a table by pieces."""
        out = np.zeros((words, m.shape[1]))
        for i in range(self.n):
            x, y = self.first[i], self.ends[i]
            out[self.word[x:y]] += self.value[x:y, None] * m[i]
        return out


def _sketch(items: Items, width: int):
    """A task's share of A'(A R), for a random R: rows (part, sums) of ROW_WORDS words each, and the passages as part -1."""

    def run(batches):
        weighted = (_omega(items, width) * items.weights[:, None]).astype(np.float32)
        total, n = np.zeros((len(items.vocabulary), width)), 0
        for _, h, first in _rows(items, batches):
            p = Passages(items, h, first)
            if len(p.begin):
                p.back(p.vectors(weighted) * (p.unit(items)[:, None] ** 2).astype(np.float32), total)
                n += len(p.begin)
        total *= items.weights[:, None]
        starts = [i for i in range(0, len(total), ROW_WORDS) if total[i : i + ROW_WORDS].any()]
        yield pa.RecordBatch.from_arrays([pa.array([*starts, -1], pa.int64()), pa.array([*(total[i : i + ROW_WORDS].tobytes() for i in starts), np.float64(n).tobytes()], pa.binary())], names=["part", "sums"])

    return trimmed(run)


def _omega(items: Items, width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((len(items.vocabulary), width))


def _summed(batches):
    """The sums of each part of a task's rows; a part is one task's."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(sums.as_buffer())
            found[part] = found[part] + x if part in found else x.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["part", "sums"])


def fit(docs: DataFrame, items: Items) -> None:
    """Sets the items' latent space from all passages of docs and from the items.

    One look at the documents gives Y = K R for the weighted sum K of their and the items' products; the space is that of
    Nystrom's approximation Y (R'Y)^-1 Y' of K. Each part of the sums is added up by one task, so the driver gets each once.
    """
    width = min(RANK + EXTRA, len(items.vocabulary))
    rows, omega = Rows(items), _omega(items, width)
    y, n = np.zeros(omega.shape), 0
    for part, sums in docs.mapInArrow(_sketch(items, width), "part long, sums binary").repartition("part").mapInArrow(_summed, "part long, sums binary").collect():
        x = np.frombuffer(bytes(sums))
        if part < 0:
            n = int(x[0])
        else:
            y[part : part + ROW_WORDS] = x.reshape(-1, width)
    y += ITEM_WEIGHT * max(n, 1) / rows.n * rows.back(rows.times(omega), len(items.vocabulary))
    # a shift keeps the factor definite: K + shift is what is approximated
    shift = np.sqrt(len(y)) * np.finfo(np.float32).eps * max(float(np.linalg.norm(y, 2)), 1e-30)
    y += shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    some = values > values.max() * 1e-12
    left, _, _ = np.linalg.svd(y @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)
    items.basis = left[:, : min(RANK, width)].astype(np.float32)
    latent = rows.times(items.basis)
    kept = np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    items.latent, items.lengths = (latent / kept).astype(np.float32), (rows.lengths * kept[:, 0]).astype(np.float32)


HITS = "doc_id long, item_id long, cosine double, lcs double, answer double"


class Pattern:
    """An item's words for comparisons: distinct ones with their counts and the bits of their places."""

    def __init__(self, words: np.ndarray, vocabulary: int = 0):
        self.n = len(words)
        self.words, self.counts = np.unique(words, return_counts=True)
        self.bits: dict[int, int] = {}
        for place, word in enumerate(words.tolist()):
            self.bits[word] = self.bits.get(word, 0) | 1 << place
        self.has = np.zeros(vocabulary, dtype=bool) if vocabulary else None
        if vocabulary:
            self.has[self.words] = True

    def of(self, region: np.ndarray) -> np.ndarray:
        """The words of a region that the item has, in order; none if no subsequence of them can be a paraphrase."""
        if self.has is None:
            at = np.minimum(np.searchsorted(self.words, region), len(self.words) - 1)
            mine = region[self.words[at] == region]
        else:
            mine = region[self.has[region]]
        # words that stand more often than in the item count as often as there
        if len(mine) < PARAPHRASE * self.n or np.minimum(np.bincount(np.searchsorted(self.words, mine), minlength=len(self.words)), self.counts).sum() < PARAPHRASE * self.n:
            return mine[:0]
        return mine


def _regions(doc, item, lo, hi, cosine, reach):
    """Ranges of hits, sorted by document, item and place, that are one region each: those within the item's reach of the one before."""
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1] + reach[item[1:]])))
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(doc)) - 1, np.maximum.reduceat(cosine, start)


def _search(items: Items):
    def run(batches):
        patterns: dict[int, Pattern] = {}
        # a byte for each word and item makes comparisons faster, where that is little memory
        dense = len(items.vocabulary) if len(items.vocabulary) * len(items.ids) <= DENSE else 0
        answers = [np.unique(w) for w in items.answers]
        weighted = (items.basis * items.weights[:, None]).astype(np.float32)
        size = np.array([len(x) for x in items.words])
        # an item of one piece is near a hit, one of several may lie a whole length to either side
        near = np.where(size > PIECE, size, np.maximum(STRIDE, size // 2))
        reach = np.where(size > PIECE, size, 0)
        for ids, h, first in _rows(items, batches):
            out = []
            w = Passages(items, h, first)
            if len(w.begin):
                doc, lo, hi, at, kept = w.row[w.begin], w.lo[w.begin], w.hi[w.begin + BLOCKS - 1], w.at, w.kept
                v = w.vectors(weighted)
                held = v @ items.latent.T
                cosine = held / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                p, piece = np.nonzero((cosine >= COSINE) | (held >= COVER * items.lengths))
                if not len(p):
                    continue
                best, item = cosine[p, piece], items.item[piece]
                order = np.lexsort((lo[p], item, doc[p]))
                p, item, best = p[order], item[order], best[order]
                start, last, best = _regions(doc[p], item, lo[p], hi[p], best, reach)
                which, of = item[start], doc[p[start]]
                x, y = np.maximum(first[of], lo[p[start]] - near[which]), np.minimum(first[of + 1], hi[p[last]] + near[which])
                ka, kb = np.searchsorted(kept, x), np.searchsorted(kept, y)
                for i, d, s, e, cos in zip(which.tolist(), of.tolist(), ka.tolist(), kb.tolist(), best.tolist(), strict=True):
                    if i not in patterns:
                        patterns[i] = Pattern(items.words[i], dense)
                    region = patterns[i].of(at[s:e])
                    if not len(region):
                        continue
                    common = lcs(patterns[i].bits, patterns[i].n, region.tolist()) / patterns[i].n
                    if common < PARAPHRASE:
                        continue
                    answer = float(np.isin(answers[i], region).mean()) if len(answers[i]) else 0.0
                    if common >= LEAK or answer >= ANSWER:
                        out.append((ids[d], items.ids[i], cos, common, answer))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return trimmed(run)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, cosine, lcs, answer), one for each document and item that it leaks, with the best passage's figures.

    Every passage of every whole text is searched for every item, BLOCK_ITEMS items at a time. Null or empty texts and items
    leak nothing, nor do items without an id, which are left out; a document without an id gives rows with a null. Item ids
    are unique; rows that repeat a document are reported once. Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    scratch, out, last = Scratch(spark, "leaks"), None, None
    while True:
        block = bench if last is None else bench.where(F.col("item_id") > last)
        got = [tuple(r) for r in block.orderBy("item_id").limit(BLOCK_ITEMS).collect()]
        if not got:
            break
        last = got[-1][0]
        items = Items.read(got)
        if not items.ids:
            continue
        words = scratch.save(docs.mapInArrow(_numbered(items), "doc_id long, words binary"), "words")
        n = counted(words)["rows"]
        if not n:
            break
        df = np.zeros(len(items.vocabulary))
        for word, k in words.mapInArrow(_frequencies(items), "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect():
            df[word] = k
        items.weights = _weights(df, n)
        fit(words, items)
        found = words.mapInArrow(_search(items), HITS).groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "answer", "cosine")).alias("m")).select("doc_id", "item_id", "m.cosine", "m.lcs", "m.answer")
        found = scratch.save(found, "found")
        scratch.drop(words)
        out = found if out is None else out.union(found)
        if len(got) < BLOCK_ITEMS:
            break
    return out if out is not None else spark.createDataFrame([], HITS)
