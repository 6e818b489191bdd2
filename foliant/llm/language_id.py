"""Language identification as multilingual mixture inference.

Each word of a text is drawn from one of the learned languages; its likelihood under a language is
that of its letter trigrams. Expectation-maximisation estimates the languages' proportions in the
text, and languages leave the set one by one as long as the penalised likelihood (BIC) improves.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch, small_or_shuffled
from foliant.llm.textbytes import column_bytes, lists, row_chunks, trimmed

#: Distinct labelled texts of each language that the model is fitted on, about, chosen by a hash of the text; whole texts are counted.
SAMPLE_TEXTS = 400
#: Languages of which the counts are broadcast at most.
BROADCAST_ROWS = 20_000
SMOOTHING, BACKOFF = 0.5, 4.0
ROUNDS = 12
UNKNOWN = "und"
LETTER = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo"))
#: Characters of texts at once, and trigrams of which a worker keeps the probabilities.
CHUNK, SLOTS = 1 << 19, 1 << 18


@functools.cache
def is_letter() -> np.ndarray:
    """Whether each code point is a letter, made once a worker."""
    return np.array([unicodedata.category(chr(c)) in LETTER for c in range(0x110000)], dtype=bool)


@dataclass
class Model:
    """letters: the learned ones in order; codes: sorted seen trigrams; counts, pairs, firsts: (languages, ...) of trigrams, of pairs and of letters before another."""

    languages: list[str]
    letters: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    contexts: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def base(self) -> int:
        return len(self.letters) + 2

    def __post_init__(self):
        """Sums over the trigrams: of each leading pair, of each trailing pair and of its first letter."""
        n = self.base

        def summed(key):
            names, at = np.unique(key, return_inverse=True)
            return names, np.stack([np.bincount(at, c, minlength=len(names)) for c in self.counts])

        self.contexts = {"lead": summed(self.codes // n), "pair": summed(self.codes % (n * n)), "first": summed(self.codes // n % n)}

    def _of(self, name: str, key: np.ndarray) -> np.ndarray:
        names, counts = self.contexts[name]
        at = np.minimum(np.searchsorted(names, key), len(names) - 1)
        return np.where(names[at] == key, counts[:, at], 0.0)

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """(trigrams, languages): log-probability of the third letter after the first two, smoothed by that after the second."""
        n = self.base
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        seen = np.where(self.codes[at] == codes, self.counts[:, at], 0.0)
        back = (self._of("pair", codes % (n * n)) + SMOOTHING) / (self._of("first", codes // n % n) + SMOOTHING * n)
        return np.log((seen + BACKOFF * back) / (self._of("lead", codes // n) + BACKOFF)).T.astype(np.float32)


def numbers(letters: np.ndarray) -> np.ndarray:
    """The number of every code point: 0 no letter, 1 another letter, 2.. the learned ones."""
    table = is_letter().astype(np.int32)
    table[letters] = np.arange(len(letters)) + 2
    return table


class Cache:
    """Probabilities of the trigrams that a worker meets again and again; a slot holds one trigram, the last that was asked for."""

    def __init__(self, model: Model):
        self.model, self.table = model, numbers(model.letters)
        self.keys = np.full(SLOTS, -1, dtype=np.int64)
        self.values = np.zeros((SLOTS, len(model.languages)), dtype=np.float32)

    def logp(self, codes: np.ndarray) -> np.ndarray:
        slot = (codes * 0x9E3779B1 >> 11) % SLOTS
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != codes)
        if len(miss):
            fresh, at = np.unique(codes[miss], return_inverse=True)
            values = self.model.logp(fresh)
            out[miss] = values[at]
            where = (fresh * 0x9E3779B1 >> 11) % SLOTS
            self.keys[where], self.values[where] = fresh, values
            # of trigrams that want one slot the last stays: keys and values are set in the same order
        return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters of all texts, each text followed by a blank, and the texts' offsets."""
    parts = [t.lower() + " " for t in texts]
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32)
    return flat, np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def trigrams(x: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams that end at a letter or just after one, and where; a word's context starts with 0."""
    one, two = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    one[1:], two[2:] = x[:-1], x[:-2]
    two[one == 0] = 0
    at = np.flatnonzero((x > 0) | (one > 0))
    return (two[at] * base + one[at]) * base + x[at], at


def _count_letters(batches):
    """(lang, text) to (lang, letter, n), a row for each of a batch."""
    for batch in batches:
        rows: dict[tuple[str, int], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = code_points([text])[0]
            for c, n in zip(*(v.tolist() for v in np.unique(x[is_letter()[x]], return_counts=True)), strict=True):
                rows[lang, c] = rows.get((lang, c), 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int32()), pa.array(list(rows.values()), pa.int64())], names=["lang", "letter", "n"])


def _count_trigrams(letters: np.ndarray):
    """(lang, text) to (lang, codes, counts), lists, a row for each text."""

    def run(batches):
        table = numbers(letters)
        for batch in batches:
            found = [np.unique(trigrams(table[code_points([t])[0]], len(letters) + 2)[0], return_counts=True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists([c for c, _ in found]), lists([n for _, n in found])], names=["lang", "codes", "counts"])

    return run


def fit(rows: DataFrame) -> Model | None:
    """From (lang, text) rows, counted where they are; only letters and trigrams come here. None if there is no letter."""
    letters = [r["letter"] for r in rows.mapInArrow(_count_letters, "lang string, letter int, n long").select("letter").distinct().collect()]
    if not letters:
        return None
    letters = np.array(sorted(letters))
    counted = rows.mapInArrow(_count_trigrams(letters), "lang string, codes array<long>, counts array<long>")
    got = counted.select("lang", F.explode(F.arrays_zip("codes", "counts")).alias("x")).groupBy("lang", "x.codes").agg(F.sum("x.counts").alias("n")).toArrow()
    lang, code, n = got.column("lang").to_pylist(), got.column("codes").to_numpy(), got.column("n").to_numpy()
    languages = sorted(set(lang))
    codes, at = np.unique(code, return_inverse=True)
    counts = np.zeros((len(languages), len(codes)))
    place = {x: i for i, x in enumerate(languages)}
    counts[np.array([place[x] for x in lang]), at] = n
    return Model(languages, letters, codes, counts)


def _mixture(like: np.ndarray, first: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages, documents) and log-likelihoods by EM; like: (languages, words) scaled, first: words' offsets."""
    n = np.maximum(np.diff(first), 1)
    share = active / active.sum(0)
    for _ in range(ROUNDS):
        part = like * np.repeat(share, n, axis=1)
        part /= np.maximum(part.sum(0), 1e-30)
        share = np.add.reduceat(part, first[:-1], axis=1) / n
    total = (like * np.repeat(share, n, axis=1)).sum(0)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)), first[:-1])


def infer(like: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions (documents, languages) of the selected languages; like: (words, languages), every document has a word."""
    like = np.ascontiguousarray(like.T, dtype=np.float64)
    k, docs = len(like), len(first) - 1
    penalty = np.log(np.maximum(np.diff(first), 2))
    active = np.ones((k, docs))
    share, ll = _mixture(like, first, active)
    best = -2 * ll + penalty * (active.sum(0) - 1)
    going = np.flatnonzero(active.sum(0) > 1)
    while len(going):
        weak = np.where(active[:, going] > 0, share[:, going], np.inf).argmin(0)
        trial = active[:, going].copy()
        trial[weak, np.arange(len(going))] = 0
        sizes = np.diff(first)[going]
        take = np.repeat(first[:-1][going] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        s, l2 = _mixture(like[:, take], np.concatenate(([0], np.cumsum(sizes))), trial)
        score = -2 * l2 + penalty[going] * (trial.sum(0) - 1)
        better = score <= best[going]
        won = going[better]
        active[:, won], share[:, won], best[won] = trial[:, better], s[:, better], score[better]
        going = won[active[:, won].sum(0) > 1]
    return share.T


#: The cache of this worker, kept between tasks; one model at a time.
_caches: dict[int, Cache] = {}


def _predict(shared, number: int):
    def run(batches):
        cache = None
        if shared is not None:
            if number not in _caches:
                _caches.clear()
                _caches[number] = Cache(shared.value)
            cache = _caches[number]
        for batch in batches:
            n = batch.num_rows
            names, scores, mixes = [UNKNOWN] * n, [0.0] * n, [None] * n
            _, offsets = column_bytes(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK) if cache else ():
                flat, o = code_points([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                x = cache.table[flat]
                code, at = trigrams(x, cache.model.base)
                starts = np.flatnonzero((x > 0) & (np.concatenate(([0], x[:-1])) == 0))
                if not len(starts):
                    continue
                logs = np.add.reduceat(cache.logp(code), np.searchsorted(at, starts), axis=0)
                like = np.exp(logs - logs.max(1, keepdims=True))
                count = np.diff(np.searchsorted(starts, o))
                some = np.flatnonzero(count)
                share = infer(like, np.concatenate(([0], np.cumsum(count[some]))))
                languages = cache.model.languages
                for i, t, s in zip(some.tolist(), share.argmax(1).tolist(), share.tolist(), strict=True):
                    names[a + i], scores[a + i] = languages[t], min(max(s[t], 0.0), 1.0)
                    mixes[a + i] = [(lang, v) for lang, v in zip(languages, s, strict=True) if v > 0.005]
            kind = pa.map_(pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names), pa.array(scores, pa.float64()), pa.array(mixes, kind)], names=["doc_id", "held_out", "lang_pred", "score", "mixture"])

    return trimmed(run)


def training_rows(docs: DataFrame, scratch: Scratch, sample: int = SAMPLE_TEXTS) -> DataFrame:
    """(lang, text) of about so many distinct labelled texts of a language, or of all if there are fewer, by a hash of the text.

    A text of very many copies counts once; no language's texts are gathered or ranked.
    """
    key = docs.where("lang is not null and text is not null").select("doc_id", "lang", F.xxhash64("text").alias("h"))
    distinct = scratch.save(key.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")), "distinct")
    share = small_or_shuffled(scratch.save(distinct.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")), "shares"), BROADCAST_ROWS)
    hit = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    chosen = scratch.save(distinct.join(share, "lang").where(hit).select("doc_id", "h", "lang"), "chosen")
    texts = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("h")).join(small_or_shuffled(chosen, BROADCAST_ROWS), ["doc_id", "h", "lang"])
    return scratch.save(texts.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text"), "sample")


def predict(docs: DataFrame, held_out: Column, sample: int = SAMPLE_TEXTS) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, mixture) of docs (doc_id, text, lang); the model is fitted where held_out is false.

    Null texts and texts without a letter are `und` with score 0, as is everything if no text is labelled. Labels are
    never read at prediction; other columns are ignored. Repeated rows, and rows with one id, are predicted each for itself;
    very long texts whole. The sample is of about `sample` texts a language. Rows whose held_out is null, as that of a null
    id, are not learned from. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out.alias("held_out"))
    model = fit(training_rows(rows.where("not held_out").drop("held_out"), Scratch(spark, "language"), sample))
    shared = spark.sparkContext.broadcast(model) if model else None
    out = "doc_id long, held_out boolean, lang_pred string, score double, mixture map<string,double>"
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(shared, shared._jbroadcast.id() if shared else -1), out)
