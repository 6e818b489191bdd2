"""Katz backoff: Good-Turing discounted bigram and word counts, backoff weights that sum to one exactly, scores of whole texts.

Texts are read once, into chunks of some MB of words, numbered by their hash within the chunk. A chunk asks the table of words,
which lies in parts by hash, for the ids and counts of its distinct words; then the table of bigrams, in parts by history, for
the probabilities of its distinct bigrams. What a chunk holds twice is sent once, and a row of such a request holds all n-grams
that one chunk wants from one part, compressed. Histories that are too frequent for a part are dealt over all parts by
the whole bigram; only their sums are combined. Chunks then add up their texts' tokens.

A token's probability is recursive: the discounted share of its bigram if training has it, else the history's weight times the
word's discounted share, where all unknown words are one word that has what discounting took from the known ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch, counted
from foliant.llm.textbytes import IS_WORD, LOWER, column_bytes, mix, row_chunks, span_hashes, trimmed, word_spans

#: Bytes of text of a chunk, and for each part of the tables. A longer text is cut between words into several chunks.
CHUNK = 8 << 20
#: Counts up to this are discounted.
MOST = 5
#: Stands for the end of a text, and before its first word, and for all words that training lacks.
END, UNKNOWN = np.uint64(0x454E44), (1 << 32) - 1
#: Statistics of a part: tokens, distinct n-grams, and how many of them occur 1, 2, … MOST + 1 times.
STATS = MOST + 3

_LOW = np.frombuffer(LOWER, dtype=np.uint8)
_U = np.uint64
ROWS = "chunk long, bucket int, a binary, b binary, rows array<long>, ids array<long>, held array<boolean>, sizes array<int>, kind int"


def pack(a: np.ndarray) -> bytes:
    """An array of numbers, its length in bytes and then its bytes by place, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes, kind) -> np.ndarray:
    size, kind = int.from_bytes(b[:8], "little"), np.dtype(kind)
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack_values(v: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct values and the place of each value in them: most tokens share their probability with others."""
    u, at = np.unique(v, return_inverse=True)
    return pack(u), pack(at.astype(np.uint32))


def unpack_values(a: bytes, b: bytes) -> np.ndarray:
    return unpack(a, np.float64)[unpack(b, np.uint32)]


def _joined(parts: list[bytes], kind) -> np.ndarray:
    return np.concatenate([unpack(p, kind) for p in parts]) if parts else np.zeros(0, kind)


@dataclass
class Discounts:
    """How much of a count stays: share[r] of a count r <= MOST, all of a larger one; total and distinct n-grams of training."""

    total: int
    distinct: int
    share: np.ndarray

    @staticmethod
    def of(stats: list[int]) -> Discounts:
        """Katz's rule with the largest k <= MOST for which it gives shares between 0 and 1 for all counts up to k.

        Where there is no such k, as in tiny tables, a constant is taken from each count: n1 / (n1 + 2 n2), or a half if that
        is not between 0 and 1.
        """
        total, distinct, *n = stats
        n = [0, *n]
        share = np.ones(MOST + 1)
        for k in range(MOST, 0, -1):
            if not all(n[1 : k + 2]):
                continue
            a = (k + 1) * n[k + 1] / n[1]
            got = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a != 1 else 0 for r in range(1, k + 1)]
            if all(0 < x < 1 for x in got):
                share[1 : k + 1] = got
                break
        else:
            d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            share[1:] = 1 - d / np.arange(1, MOST + 1)
        return Discounts(total, distinct, share)

    def kept(self, c: np.ndarray) -> np.ndarray:
        return c * self.share[np.where(c <= MOST, c, 0)]


def _probability(words: Discounts, left: float, c: np.ndarray) -> np.ndarray:
    """Of words by their counts; a count of 0 is that of the unknown word."""
    return np.where(c > 0, words.kept(c) / max(words.total, 1), left)


def _pieces(d: np.ndarray, o: np.ndarray, chunk: int):
    """Groups of rows, or parts of one row, cut before a blank: (first row, offsets, whether the last one ends)."""
    for a, b in row_chunks(o, chunk):
        lo, end = int(o[a]), int(o[b])
        if b - a > 1 or end - lo <= chunk:
            yield a, o[a : b + 1], True
            continue
        while lo < end:
            hi = min(lo + chunk, end)
            while hi < end and IS_WORD[d[hi]]:  # a word that is cut goes to the piece that it began in
                step = np.flatnonzero(~IS_WORD[d[hi : hi + chunk]])
                hi = hi + int(step[0]) if len(step) else min(hi + chunk, end)
            yield a, np.array([lo, hi]), hi == end
            lo = hi


_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("kind", pa.int32())])


def _read(parts: int, chunk: int):
    """Chunks: the numbers of their tokens (kind 0), the hashes of their distinct words with counts in training (kind 1)."""

    def run(batches):
        place = TaskContext.get().partitionId() << 33
        row = n = 0
        for batch in batches:
            d, o = column_bytes(batch.column(2))
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            before = END
            for a, oo, ends in _pieces(d, o, chunk):
                low = _LOW[d[oo[0] : oo[-1]]]
                s, e, first = word_spans(low, oo - oo[0])
                h, many = span_hashes(low, s, e), len(oo) - 1
                # before each text stands what is its first token's history, after it its end
                tail = 1 if ends else 0
                sizes = np.diff(first) + 1 + tail
                tokens = np.full(len(h) + many * (1 + tail), END)
                of = np.repeat(np.arange(many), np.diff(first))
                tokens[np.arange(len(h)) + of * (1 + tail) + 1] = h
                tokens[0] = before
                before = END if ends else tokens[-1]
                u, at = np.unique(tokens, return_inverse=True)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                train = np.repeat(~np.array(held[a : a + many], dtype=bool), sizes)
                train[starts] = False
                c = np.bincount(at[train], minlength=len(u))
                key = place + n
                n += 1
                bucket = ((u >> _U(32)) * _U(parts)) >> _U(32)
                cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                out = [{"chunk": key, "a": pack(at.astype(np.uint32)), "rows": [place + row + a + i for i in range(many)], "ids": ids[a : a + many], "held": held[a : a + many], "sizes": sizes.tolist(), "kind": 0}]
                out += [{"chunk": key, "bucket": int(bucket[x]), "a": pack(u[x:y]), "b": pack(c[x:y].astype(np.uint32)), "kind": 1} for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
            row += len(ids)

    return trimmed(run)


def _stats(c: np.ndarray) -> list[int]:
    return [int(c.sum()), int((c > 0).sum()), *np.bincount(np.minimum(c, MOST + 2), minlength=MOST + 3)[1 : MOST + 2].tolist()]


WORDS = "chunk long, bucket int, a binary, b binary, stats array<long>"


def _words(parts: int):
    """A part of the table of words: for each chunk the ids and counts of its words, in their order; the part's statistics once."""

    def run(table):
        chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        hashes = [unpack(x, np.uint64) for x in table.column("a").to_pylist()]
        u, at = np.unique(np.concatenate(hashes), return_inverse=True)
        c = np.bincount(at, _joined(table.column("b").to_pylist(), np.uint32), minlength=len(u)).astype(np.int64)
        if len(u) * parts + bucket >= UNKNOWN:
            raise OverflowError("more than 2**32 distinct words")
        cut = np.cumsum([0, *map(len, hashes)])
        ids = np.where(c > 0, np.arange(len(u)) * parts + bucket, UNKNOWN).astype(np.uint32)
        spans = [at[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({
            "chunk": chunks, "bucket": pa.array([bucket] * len(chunks), pa.int32()), "a": pa.array([pack(ids[s]) for s in spans], pa.binary()),
            "b": pa.array([pack(c[s]) for s in spans], pa.binary()), "stats": pa.array([_stats(c), *[None] * (len(chunks) - 1)], pa.list_(pa.int64())),
        })

    return run


@dataclass
class Chunk:
    """A chunk's texts with its words' ids and counts, and its distinct bigrams in the order in which they are asked for."""

    row: dict
    ids: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(left: pa.Table, right: pa.Table) -> Chunk:
        row = left.to_pylist()[0]
        answers = sorted(((r["bucket"], r["a"], r["b"]) for r in right.to_pylist() if r["kind"] == 1), key=lambda r: r[0])
        ids, counts = _joined([r[1] for r in answers], np.uint32), _joined([r[2] for r in answers], np.int64)
        tokens = unpack(row["a"], np.uint32)
        first = np.zeros(len(tokens), dtype=bool)
        first[np.cumsum([0, *row["sizes"][:-1]])] = True
        return Chunk(row, ids, counts, tokens, first)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """For each scored token its bigram, in numbers of the chunk's words, and whether its history is known."""
        k = (self.tokens[:-1].astype(np.uint64) << _U(32) | self.tokens[1:])[~self.first[1:]]
        # unknown words are one word
        unknown = np.flatnonzero(self.counts == 0)
        if len(unknown) > 1:
            w = (k & _U(0xFFFFFFFF)).astype(np.int64)
            k = np.where(self.counts[w] > 0, k, k >> _U(32) << _U(32) | _U(unknown[0]))
        return k, self.counts[(k >> _U(32)).astype(np.int64)] > 0

    def order(self, u: np.ndarray, parts: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct bigrams by part: their places in u, parts, histories, words and whether the history is dealt out."""
        h, w = (u >> _U(32)).astype(np.int64), (u & _U(0xFFFFFFFF)).astype(np.int64)
        hot = self.counts[h] * parts > total
        ids = self.ids.astype(np.uint64)
        bucket = mix(np.where(hot, ids[h] << _U(32) | ids[w], ids[h])) % _U(parts)
        at = np.argsort(bucket.astype(np.uint16 if parts < 1 << 16 else np.uint64), kind="stable")
        return at, bucket[at], h[at], w[at], hot[at]


ASKED = "chunk long, bucket int, a binary, b binary, c binary, d binary"


def _ask(parts: int, total: int):
    """A chunk's distinct bigrams by part: runs of histories (id, length, count, dealt out), words' ids and counts, counts in training."""

    def run(key, left, right):
        if not left.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), **{x: pa.array([], pa.binary()) for x in "abcd"}})
        x = Chunk.of(left, right)
        k, known = x.keys()
        held = np.repeat(np.array(x.row["held"], dtype=bool), x.row["sizes"])[~x.first]
        u = np.unique(k[known])
        seen, times = np.unique(k[known & ~held], return_counts=True)
        n = np.zeros(len(u), dtype=np.uint32)
        n[np.searchsorted(u, seen)] = times
        at, bucket, h, w, hot = x.order(u, parts, total)
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(u) else np.zeros(1, int)
        cols: dict[str, list] = {c: [] for c in "abcd"}
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            hh = h[lo:hi]
            start = np.flatnonzero(np.concatenate(([True], hh[1:] != hh[:-1])))
            runs = np.stack((x.ids[hh[start]].astype(np.int64), np.diff(np.append(start, hi - lo)), x.counts[hh[start]], hot[lo:hi][start].astype(np.int64)))
            cols["a"].append(pack(runs.reshape(-1)))
            cols["b"].append(pack(x.ids[w[lo:hi]]))
            cols["c"].append(pack(x.counts[w[lo:hi]]))
            cols["d"].append(pack(n[at[lo:hi]]))
        return pa.table({"chunk": pa.array([x.row["chunk"]] * (len(cut) - 1), pa.int64()), "bucket": pa.array(bucket[cut[:-1]].astype(np.int32)), **{c: pa.array(v, pa.binary()) for c, v in cols.items()}})

    return run


BIGRAMS = "bucket int, chunks array<long>, sizes array<int>, at binary, runs binary, words binary, counts binary, stats array<long>, hot array<struct<h:long,kept:array<long>,large:long,lower:double,n:long>>"


def _bigrams(words: Discounts, left: float):
    """A part of the table of bigrams: distinct ones with counts, each chunk's places in them, sums of the histories that are dealt out."""

    def run(table):
        r = table.to_pydict()
        runs = [unpack(a, np.int64).reshape(4, -1) for a in r["a"]]
        h = np.concatenate([np.repeat(x[0], x[1]) for x in runs]).astype(np.uint64)
        key = h << _U(32) | _joined(r["b"], np.uint32)
        sizes = [int(x[1].sum()) for x in runs]
        u, one, at = np.unique(key, return_index=True, return_inverse=True)
        c = np.bincount(at, _joined(r["d"], np.uint32), minlength=len(u)).astype(np.int64)
        cw = _joined(r["c"], np.int64)[one]
        ch = np.concatenate([np.repeat(x[2], x[1]) for x in runs])[one]
        is_hot = np.concatenate([np.repeat(x[3], x[1]) for x in runs])[one] > 0
        uh = (u >> _U(32)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], uh[1:] != uh[:-1])))
        length = np.diff(np.append(start, len(u)))
        out = np.stack((uh[start], length, ch[start], is_hot[start].astype(np.int64)))
        hot = []
        for i in np.flatnonzero(out[3]).tolist():
            x, y = start[i], start[i] + length[i]
            some, lower = c[x:y], _probability(words, left, cw[x:y])
            by = np.bincount(some[some <= MOST], minlength=MOST + 1)
            hot.append({"h": int(out[0, i]), "kept": by[1:].tolist(), "large": int(some[some > MOST].sum()), "lower": float(lower[some > 0].sum()), "n": int(out[2, i])})
        return pa.Table.from_pylist(
            [{"bucket": r["bucket"][0], "chunks": r["chunk"], "sizes": sizes, "at": pack(at.astype(np.uint32)), "runs": pack(out.reshape(-1)), "words": pack(cw), "counts": pack(c), "stats": _stats(c), "hot": hot}],
            schema=pa.schema([("bucket", pa.int32()), ("chunks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("at", pa.binary()), ("runs", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64())), ("hot", pa.list_(pa.struct([("h", pa.int64()), ("kept", pa.list_(pa.int64())), ("large", pa.int64()), ("lower", pa.float64()), ("n", pa.int64())])))]),
        )

    return run


def weights(kept: np.ndarray, lower: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of histories: what their counts are divided by, and the weight of the lower order.

    kept: sums of discounted counts of the bigrams that training has; lower: sums of their words' probabilities. A history that
    discounting took nothing from is divided by one more than its count, so that what training lacks has a probability.
    """
    n = n.astype(np.float64)
    divisor = np.where(kept > n * (1 - 1e-12), n + 1, n)
    return divisor, (1 - kept / divisor) / (1 - lower)


def _answer(words: Discounts, pairs: Discounts, left: float, hot: dict[int, tuple[float, float]]):
    """For each chunk the logarithms of the probabilities of the bigrams that it asked for, in its order."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h, length, n, dealt = unpack(r["runs"], np.int64).reshape(4, -1)
                c, lower = unpack(r["counts"], np.int64), _probability(words, left, unpack(r["words"], np.int64))
                kept, start = pairs.kept(c), np.cumsum(length) - length
                total = np.add.reduceat(kept, start)
                under = np.add.reduceat(np.where(c > 0, lower, 0.0), start)
                divisor, weight = weights(total, under, n)
                for i in np.flatnonzero(dealt).tolist():
                    divisor[i], weight[i] = hot[int(h[i])]
                p = np.where(c > 0, kept / np.repeat(divisor, length), np.repeat(weight, length) * lower)
                log, at = np.log10(p), unpack(r["at"], np.uint32)
                cut = np.cumsum([0, *r["sizes"]])
                values, places = zip(*(pack_values(log[at[x:y]]) for x, y in zip(cut[:-1], cut[1:], strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["chunks"], pa.int64()), pa.array([r["bucket"]] * len(r["chunks"]), pa.int32()), pa.array(values, pa.binary()), pa.array(places, pa.binary()), pa.array([2] * len(r["chunks"]), pa.int32())],
                    names=["chunk", "bucket", "a", "b", "kind"],
                )

    return trimmed(run)


SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _add(words: Discounts, left: float, parts: int):
    """Sums of a chunk's texts."""

    def run(key, left_rows, right):
        names = [f.strip().split(" ")[0] for f in SCORES.split(",")]
        if not left_rows.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        x = Chunk.of(left_rows, right)
        k, known = x.keys()
        log = np.log10(_probability(words, left, x.counts))[(k & _U(0xFFFFFFFF)).astype(np.int64)]
        u, at = np.unique(k[known], return_inverse=True)
        order = x.order(u, parts, words.total)[0]
        answers = sorted(((r["bucket"], r["a"], r["b"]) for r in right.to_pylist() if r["kind"] == 2), key=lambda r: r[0])
        found = np.zeros(len(u))
        found[order] = np.concatenate([np.zeros(0), *(unpack_values(a, b) for _, a, b in answers)])
        log[known] = found[at]
        c = x.counts[x.tokens[~x.first]]
        base = np.log10((c + 1) / (words.total + words.distinct + 1))
        cut = np.cumsum([0, *(s - 1 for s in x.row["sizes"])])

        def sums(v):
            total = np.zeros(len(cut) - 1, v.dtype)
            some = np.flatnonzero(np.diff(cut))  # a piece of a long text may hold blanks only
            if len(some):
                total[some] = np.add.reduceat(v, cut[some])
            return total

        return pa.table([pa.array(x.row["rows"], pa.int64()), pa.array(x.row["ids"], pa.int64()), pa.array(x.row["held"], pa.bool_()), pa.array(np.diff(cut)), pa.array(sums((c > 0).astype(np.int64))), pa.array(sums(base)), pa.array(sums(log))], names=names)

    return run


def _sums(stats: dict) -> list[int]:
    return [int(stats[f"s{i}"] or 0) for i in range(STATS)]


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs.

    The model learns from the rows for which held_out is false; null counts as false. Tokens are words, A-Z lower-cased, and one
    end a text; null and empty texts have just the end. score is the model's log10 probability of the text, base_score that of
    words with one added to each count. Words are known by 64-bit hashes. Rows with a null or repeated id and repeated rows
    each count and are scored for themselves; other columns are ignored; an empty table gives an empty one. With nothing to
    learn from, every word is the unknown one and both scores are 0. A text longer than chunk bytes is cut between words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // CHUNK))
    scratch = Scratch(spark, "katz")
    sums = {f"s{i}": F.sum(F.col("stats")[i]) for i in range(STATS)}

    read = scratch.save(rows.mapInArrow(_read(parts, chunk), ROWS), "chunks", "kind")
    chunks = read.where("kind = 0").select("chunk", "a", "rows", "ids", "held", "sizes")
    asked = read.where("kind = 1").select("chunk", "bucket", "a", "b")
    known = scratch.save(asked.groupBy("bucket").applyInArrow(_words(parts), WORDS), "words", **sums)
    scratch.drop_part(read, "kind=1")
    words = Discounts.of(_sums(counted(known)))
    # what discounting took is the unknown word's
    n = _sums(counted(known))
    large = n[0] - sum(r * n[r + 1] for r in range(1, MOST + 1))
    left = 1 - (large + sum(float(words.share[r]) * r * n[r + 1] for r in range(1, MOST + 1))) / n[0] if n[0] else 1.0
    if left < 1e-12:  # all words are frequent: each gives the unknown one its part of one token
        left = 1 / (n[0] + 1)
        words.share = words.share * (1 - left)
    of_words = known.select("chunk", "bucket", "a", "b", F.lit(1).alias("kind"))

    wanted = chunks.groupBy("chunk").cogroup(of_words.groupBy("chunk")).applyInArrow(_ask(parts, words.total), ASKED)
    table = scratch.save(wanted.groupBy("bucket").applyInArrow(_bigrams(words, left), BIGRAMS), "bigrams", **sums)
    pairs = Discounts.of(_sums(counted(table)))
    hot = {}
    # at most as many histories as there are parts are that frequent
    by = table.select(F.explode("hot").alias("x")).groupBy(F.col("x.h").alias("h")).agg(*(F.sum(F.col("x.kept")[i]).alias(f"k{i + 1}") for i in range(MOST)), F.sum("x.large").alias("large"), F.sum("x.lower").alias("lower"), F.first("x.n").alias("n"))
    for r in by.collect():
        kept = r["large"] + sum(float(pairs.share[i]) * i * r[f"k{i}"] for i in range(1, MOST + 1))
        d, w = weights(np.array([kept]), np.array([r["lower"]]), np.array([r["n"]]))
        hot[r["h"]] = (float(d[0]), float(w[0]))
    answers = table.select("bucket", "chunks", "sizes", "at", "runs", "words", "counts").mapInArrow(_answer(words, pairs, left, hot), "chunk long, bucket int, a binary, b binary, kind int")
    scored = chunks.groupBy("chunk").cogroup(of_words.union(answers).groupBy("chunk")).applyInArrow(_add(words, left, parts), SCORES)
    out = scored.groupBy("row", "doc_id", "held_out").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
