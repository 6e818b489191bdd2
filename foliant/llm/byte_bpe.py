"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

The distinct pre-tokens of a batch are folded all at once: every word starts as its bytes, and in
each step the adjacent pair of least rank of every word is merged. Pair ranks come from a table made
of the vocabulary, once, on the driver; a task keeps the results for the words that return. Decoding concatenates the pieces.

encode_words_native() is the same fold as Spark higher-order functions over a literal rank map. It
serves small tables of distinct words; see the README for why whole texts do not go through it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.textbytes import column_bytes, lists, row_chunks, trimmed

#: Words of which a task keeps the ids at most, but for those of one chunk; beyond that it keeps those that have returned, if they are few.
CACHE_WORDS = 80_000
#: Bytes of text that are encoded before a batch of results is sent; a longer text is alone.
CHUNK = 1 << 19
#: Longer pre-tokens are merged one at a time, by a heap, rather than in the common fold.
LONG_WORD = 64
#: The rank of a pair that doesn't merge.
NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """Piece to rank from a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """A vocabulary as arrays that a worker opens fast: the pieces by rank, one after the other, and the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        order = sorted(ranks, key=ranks.__getitem__)
        self.ranks = np.array([ranks[p] for p in order], dtype=np.int64)
        self.size = np.array([len(p) for p in order], dtype=np.int64)
        self.pieces = b"".join(order)
        keys, values = [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.values = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int64)[order]


class Merger:
    """The fold of ranked merges over many words. Ids are ranks."""

    def __init__(self, v: Vocabulary):
        ends = np.cumsum(v.size)
        self.ranks = dict(zip((v.pieces[a:b] for a, b in zip((ends - v.size).tolist(), ends.tolist(), strict=True)), v.ranks.tolist(), strict=True))
        self.keys, self.values = v.keys, v.values
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.bytes = np.frombuffer(v.pieces, dtype=np.uint8)
        self.start, self.size = np.zeros((2, int(v.ranks.max()) + 1), dtype=np.int64)
        self.start[v.ranks], self.size[v.ranks] = ends - v.size, v.size
        self.names = list(map(str, range(len(self.size))))
        #: Ranks of the pairs of bytes.
        self.first = self.rank_of(np.repeat(self.single, 256), np.tile(self.single, 256))

    def pair(self, left: int, right: int) -> int | None:
        key = left << 32 | right
        at = int(np.searchsorted(self.keys, key))
        return int(self.values[at]) if at < len(self.keys) and self.keys[at] == key else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merged(self, text: np.ndarray):
        """The fold over words of one length, as rows of bytes: ranges of rows that have so many ids, and these."""
        ids, rank, live = self.single[text], self.first[text[:, :-1].astype(np.int64) << 8 | text[:, 1:]], np.arange(len(text))
        while len(live):
            if not rank.shape[1]:
                yield live, ids
                return
            at = rank.argmin(1)
            least = rank[np.arange(len(at)), at]
            go = least < NONE
            if not go.all():
                yield live[~go], ids[~go]
                live, ids, rank, at, least = live[go], ids[go], rank[go], at[go], least[go]
            # every row that is left loses one id, so rows stay of one length, and only the two pairs of the new id change
            k, row = np.arange(ids.shape[1] - 1), np.arange(len(at))
            ids = np.where(k <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[row, at] = least
            rank = np.where(k[:-1] < at[:, None], rank[:, :-1], rank[:, 1:])
            for some, shift in ((at > 0, -1), (at < ids.shape[1] - 1, 0)):
                r, c = row[some], at[some] + shift
                rank[r, c] = self.rank_of(ids[r, c], ids[r, c + 1])

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the words' offsets into them."""
        found = list(map(self.ranks.get, words))
        done, by = [], {}
        for i, (w, rank) in enumerate(zip(words, found, strict=True)):
            if rank is None:
                if len(w) > LONG_WORD:
                    done.append((np.array([i]), np.array([self.long(w)], dtype=np.int64)))
                else:
                    by.setdefault(len(w), []).append(i)
        for n, rows in by.items():
            text = np.frombuffer(b"".join(map(words.__getitem__, rows)), dtype=np.uint8).reshape(-1, n)
            rows = np.array(rows)
            done += [(rows[live], ids) for live, ids in self.merged(text)]
        whole = np.array([-1 if x is None else x for x in found], dtype=np.int64)
        at = np.flatnonzero(whole >= 0)
        done.append((at, whole[at, None]))
        first = np.zeros(len(words) + 1, dtype=np.int64)
        for rows, ids in done:
            first[rows + 1] = ids.shape[1]
        np.cumsum(first, out=first)
        out = np.zeros(int(first[-1]), dtype=np.int64)
        for rows, ids in done:
            out[first[rows, None] + np.arange(ids.shape[1])] = ids
        return out, first

    def text(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The pieces of ids one after the other, and the ends of each."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes(), ends

    def long(self, word: bytes) -> list[int]:
        """One long word: a heap of pairs over a linked list."""
        import heapq

        ids = self.single[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = r, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x in (left[i], i):
                y = right[x] if x >= 0 else -1
                if y >= 0 and (s := self.pair(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


class Codec:
    """Both directions, with the words that return kept: a word to its ids as one string, such a string to its bytes."""

    def __init__(self, pattern: str, vocabulary: Vocabulary):
        import regex

        self.split = regex.compile(pattern).findall
        self.merger = Merger(vocabulary)
        self.known: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}
        self.returned: set[str] = set()

    def encode(self, texts: list[str]) -> list[list[str]]:
        """For each text the ids of each pre-token, joined by blanks."""
        split = [self.split(t) for t in texts]
        words = set().union(*split)
        fresh = words.difference(self.known)
        self.returned |= words.difference(fresh)
        fresh = list(fresh)
        ids, first = self.merger.fold([w.encode("utf-8", "replace") for w in fresh])
        names = list(map(self.merger.names.__getitem__, ids.tolist()))
        text, ends = self.merger.text(ids)
        first, ends = first.tolist(), np.concatenate(([0], ends))[first].tolist()
        keys = [" ".join(names[a:b]) for a, b in itertools.pairwise(first)]
        self.known.update(zip(fresh, keys, strict=True))
        self.bytes.update(zip(keys, (text[a:b] for a, b in itertools.pairwise(ends)), strict=True))
        return [list(map(self.known.__getitem__, w)) for w in split]

    def decode(self, parts: list[str]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, parts))

    def trim(self) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known = {w: self.known[w] for w in self.returned} if 4 * len(self.returned) <= 3 * CACHE_WORDS else {}
            self.bytes = {k: self.bytes[k] for k in self.known.values()}
            self.returned = set()


#: Driver: (application, path) to the broadcast vocabulary, so that a table encoded again sends nothing anew.
_shared: dict[tuple[str, str], object] = {}


def _vocabulary(spark, path: str):
    key = (spark.sparkContext.applicationId, path)
    if key not in _shared:
        _shared[key] = spark.sparkContext.broadcast(Vocabulary(load_ranks(path)))
    return _shared[key]


def _run(pattern: str, shared, with_ids: bool):
    def run(batches):
        codec = Codec(pattern, shared.value)  # of this task: a worker that waits or does other work holds no words
        for batch in batches:
            _, offsets = column_bytes(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK):
                counts, ids_sha, text_sha, all_ids = [], [], [], []
                for parts in codec.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]):
                    joined = " ".join(parts)
                    counts.append(joined.count(" ") + 1 if joined else 0)
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(parts)).hexdigest())
                    if with_ids:
                        all_ids.append(np.fromstring(joined, dtype=np.int32, sep=" ") if joined else np.zeros(0, np.int32))
                codec.trim()
                cols = [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(lists(all_ids, np.int32))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return trimmed(run)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of whole texts.

    Null and empty texts have no tokens and the digest of nothing. Each row is encoded for itself, so rows with a null or
    repeated id and repeated rows each give a row; other columns are ignored; an empty table gives an empty one. A very long
    text is encoded whole, alone in its chunk. The vocabulary, of a fixed size, is read here and broadcast once a session.
    decoded_sha256 is of the bytes that the ids decode to.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    shared = _vocabulary(docs.sparkSession, path)
    return rows.mapInArrow(_run(pattern, shared, with_ids), schema)


def _decode(shared):
    def run(batches):
        pieces = {v: k for k, v in Merger(shared.value).ranks.items()}
        for batch in batches:
            out = [None if ids is None else b"".join(map(pieces.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return run


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, bytes) of id lists; a null list gives null. An id that the vocabulary lacks is an error."""
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(_vocabulary(tokens.sparkSession, path)), "doc_id long, bytes binary")


#: Buckets of the literal rank map: one lookup reads one bucket, not the whole map.
BUCKETS = 4096


def encode_words_native(words: DataFrame, ranks: dict[bytes, int], col: str = "word") -> DataFrame:
    """words with a column ids array<int>: ranked merges folded by higher-order functions over a literal rank map.

    Null gives null, an empty word an empty list. The map is one JSON literal of hex pieces, in BUCKETS maps.
    """
    import json
    import zlib

    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        h = piece.hex().upper()
        buckets[zlib.crc32(h.encode()) % BUCKETS][h] = rank
    table = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")

    def rank(h):
        return F.try_element_at(F.get(table, (F.crc32(h.cast("binary")) % BUCKETS).cast("int")), h)

    def merge(pieces, _):
        pairs = F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), lambda i: F.struct(F.coalesce(rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1))), F.lit(1 << 30)).alias("r"), i.alias("i")))
        best = F.array_min(pairs)
        joined = F.concat(
            F.slice(pieces, F.lit(1), best["i"]),
            F.array(F.concat(F.get(pieces, best["i"]), F.get(pieces, best["i"] + 1))),
            F.slice(pieces, best["i"] + 3, F.size(pieces)),
        )
        return F.when((F.size(pieces) < 2) | (best["r"] == 1 << 30), pieces).otherwise(joined)

    hexed = F.hex(F.encode(F.col(col), "utf-8"))
    size = F.length(hexed) / 2
    start = F.when(size > 0, F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: F.substring(hexed, i * 2 - 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    steps = F.when(size > 1, F.sequence(F.lit(2), size.cast("int"))).otherwise(F.array().cast("array<int>"))
    pieces = F.aggregate(steps, start, merge)
    return words.withColumn("ids", F.when(F.col(col).isNotNull(), F.transform(pieces, rank)))
