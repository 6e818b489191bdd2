"""Suffix-array dedup over a logarithmic family of sorted suffix tables.

A text's suffixes are sampled at minimizers: of the 32-byte strings in each window of WIDTH bytes the
one with the least hash, so equal windows always sample the same suffix. A batch becomes a table of
its suffixes' leading strings (a fingerprint `a`), each with the range of the digests `u` of all that
a window around the suffix can contain. Tables are bucketed and sorted by `a`, so a new batch is the only
thing that moves when it is merge-scanned against the levels that exist; levels of equal size merge on the
way, and n batches leave at most log2(n) levels.

A leading string that stands once has no match. Where all contexts of one are equal, they match throughout.
Where they differ, one copy of each context is fetched, contexts of a leading string are sorted as suffixes,
and their bytes are compared to both sides: no byte goes because of a fingerprint alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch, is_empty, partitions, small_or_shuffled
from foliant.llm.textbytes import column_bytes, lists, mix, row_chunks, trimmed

WIDTH, LEAD = 200, 32
SPAN = WIDTH - LEAD
#: Bytes of text that are sampled at once; a longer text is cut into pieces that overlap by WIDTH on both sides.
CHUNK = 1 << 18
#: Batches that a table is loaded in.
BATCHES = 4
#: Suffixes that a task combines by their leading string before it sends them.
COMBINE = 1 << 20
#: Groups of contexts up to this size are compared pair by pair, larger ones by all their windows.
PAIRS = 64
#: Contexts of one leading string that one task takes at most; the windows of more are counted by a shuffle.
HOT = 50_000
#: Documents of which the keys are broadcast at most (16 bytes each) to fetch their texts.
BROADCAST_ROWS = 500_000
_U = np.uint64
_BYTE = mix(np.arange(256, dtype=np.uint64) + _U(0x5851F42D4C957F2D))
NOTHING = hashlib.sha256(b"").hexdigest()


def _slide(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Least or largest of x[i : i + n] for each i, by doubling; short tails take what there is."""
    f, out, have = (np.minimum if least else np.maximum), x.copy(), 1
    while have < n:
        step = min(have, n - have)
        f(out[:-step], out[step:].copy(), out=out[:-step])
        have += step
    return out


def minimizers(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of the texts that o cuts d into, and the hashes of the strings there."""
    n = len(d)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.repeat(o[1:], np.diff(o))
    at = np.arange(n)
    with np.errstate(over="ignore"):
        h, power, have = _BYTE[d], _U(0x9FB21C651E98DF25), 1
        while have < LEAD:
            nxt = np.zeros_like(h)
            nxt[:-have] = h[have:]
            h, power, have = h * power + nxt, power * power, have * 2
        h = mix(h)
    h[at + LEAD > end] = ~_U(0)
    least = _slide(h, SPAN + 1, True)
    least[at + WIDTH > end] = 0
    most = _slide(least[::-1], SPAN + 1, False)[::-1]
    p = np.flatnonzero((most == h) & (at + LEAD <= end))
    return p, h[p]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows x to y, and the positions (in data) and hashes of their samples; a long text comes in several parts."""
    for x, y in row_chunks(offsets, CHUNK):
        lo, hi = int(offsets[x]), int(offsets[y])
        if hi - lo <= 2 * CHUNK:
            p, h = minimizers(data[lo:hi], offsets[x : y + 1] - lo)
            yield x, y, p + lo, h
            continue
        for c in range(lo, hi, CHUNK):
            s, e = max(lo, c - WIDTH), min(hi, c + CHUNK + WIDTH)
            p, h = minimizers(data[s:e], np.array([0, e - s]))
            mine = (p + s >= c) & (p + s < c + CHUNK)
            yield x, y, p[mine] + s, h[mine]


def _profile(batches):
    """(doc_id, id0, th, text) to lengths, digests and sampled suffixes; equal texts of a task are sampled once."""
    seen: set[bytes] = set()
    for batch in batches:
        data, o = column_bytes(batch.column(3))
        whole = [hashlib.sha256(data[o[i] : o[i + 1]]) for i in range(batch.num_rows)]
        fresh = []
        for w in whole:
            fresh.append(w.digest() not in seen)
            seen.add(w.digest())
        if len(seen) > 500_000:
            seen.clear()
        by: list[list] = [[[], [], []] for _ in whole]
        for x, y, p, h in _pieces(data, o):
            row = np.searchsorted(o, p, "right") - 1
            keep = np.array(fresh[x:y], dtype=bool)[row - x] if y > x else np.zeros(0, bool)
            p, h, row = p[keep], h[keep], row[keep]
            lo, hi = np.maximum(o[row], p - SPAN), np.minimum(o[row + 1], p + WIDTH)
            base, top = (int(lo[0]), int(hi.max())) if len(p) else (0, 0)
            text = data[base:top].tobytes()
            digests = b"".join([hashlib.blake2b(text[s:e] + k.to_bytes(1), digest_size=8).digest() for s, e, k in zip((lo - base).tolist(), (hi - base).tolist(), (p - lo).tolist(), strict=True)])
            u = np.frombuffer(digests, dtype=np.int64)
            first = np.searchsorted(row, np.arange(x, y + 1))
            for i in range(x, y):
                a, b = first[i - x], first[i - x + 1]
                if b > a:
                    for part, v in zip(by[i], (h[a:b].view(np.int64), u[a:b], p[a:b] - o[i]), strict=True):
                        part.append(v)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        t = [struct.unpack("<2q", w.digest()[:16]) for w in whole]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.diff(o)), pa.array([x[0] for x in t], pa.int64()), pa.array([x[1] for x in t], pa.int64()), pa.array([w.hexdigest() for w in whole]), *(lists([join(x[k]) for x in by]) for k in range(3))],
            names=["doc_id", "id0", "th", "n_bytes", "t0", "t1", "sha", "a", "u", "p"],
        )


def _combine(batches):
    """(a, u), lists, to (a, lo, hi, c): for each leading string of some COMBINE suffixes the least and largest digest and 1, or 2 if there are more."""

    def sent(parts):
        a, u = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(a, kind="stable")
        a, u = a[order], u[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        lo, hi = np.minimum.reduceat(u, first), np.maximum.reduceat(u, first)
        count = np.minimum(np.diff(np.append(first, len(a))), 2)
        for k in range(0, len(first), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(a[first[s]]), pa.array(lo[s]), pa.array(hi[s], mask=hi[s] == lo[s]), pa.array(count[s].astype(np.int32))], names=["a", "lo", "hi", "c"])

    held, n = [], 0
    for batch in batches:
        a, u = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
        if len(a):
            held.append((a, u))
            n += len(a)
        if n >= COMBINE:
            yield from sent(held)
            held, n = [], 0
    if held:
        yield from sent(held)


class SuffixFamily:
    """Levels of suffix tables (a, lo, hi, c) bucketed and sorted by a; level i holds 2**i batches or nothing."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.buckets = partitions(scratch.spark)
        self.levels: list[DataFrame | None] = []

    def _scan(self, rows: DataFrame) -> DataFrame:
        """One row for each leading string: the range of its digests, and c = 2 if it stands more than once."""
        hi = F.nullif(F.max(F.coalesce("hi", "lo")), F.min("lo"))
        return rows.groupBy("a").agg(F.min("lo").alias("lo"), hi.alias("hi"), F.least(F.sum("c"), F.lit(2)).cast("int").alias("c"), F.max("role").alias("role"))

    def insert(self, batch: DataFrame) -> None:
        """Adds suffixes (a, u: lists of a text's): one merge-scan of the batch against all levels, merging those that are full."""
        full = next((i for i, x in enumerate(self.levels) if x is None), len(self.levels))
        new = batch.select("a", "u").mapInArrow(_combine, "a long, lo long, hi long, c int")
        rows = new.repartition(self.buckets, "a").withColumn("role", F.lit(1))
        for i, level in enumerate(self.levels):
            if level is not None:  # already in place, so nothing of it moves
                rows = rows.union(level.withColumn("role", F.lit(1 if i < full else 0)))
        merged = self.scratch.save_bucketed(self._scan(rows).where("role = 1").drop("role"), f"level{full}", "a", self.buckets)
        if full == len(self.levels):
            self.levels.append(None)
        self.scratch.drop(*(x for x in self.levels[:full] if x is not None))
        self.levels[:full] = [None] * full
        self.levels[full] = merged

    def hits(self) -> DataFrame:
        """Rows (a, open) of the leading strings that stand more than once; open where their contexts differ.

        The level that a string came to last has what all levels know of it.
        """
        rows = None
        for level in self.levels:
            if level is not None:
                found = level.where("c > 1").withColumn("role", F.lit(1))
                rows = found if rows is None else rows.union(found)
        return self._scan(rows).select("a", F.col("hi").isNotNull().alias("open"))


def _contexts(batches):
    """(id0, th, text, suffixes) to one row (a, id0, th, p, once, before, after) a suffix; before is read backwards."""
    names = ["a", "id0", "th", "p", "once", "before", "after"]
    for batch in batches:
        data, o = column_bytes(batch.column(2))
        ids, ths, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
        for i, (id0, th) in enumerate(zip(ids, ths, strict=True)):
            text = data[o[i] : o[i + 1]]
            got = wanted[i].as_py()
            for k in range(0, len(got), 4096):
                part = got[k : k + 4096]
                cols = [[s["a"] for s in part], [id0] * len(part), [th] * len(part), [s["p"] for s in part], [s["once"] for s in part]]
                before = [text[max(0, s["p"] - SPAN) : s["p"]][::-1].tobytes() for s in part]
                after = [text[s["p"] : s["p"] + WIDTH].tobytes() for s in part]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*cols, before, after), kinds, strict=True)], names=names)


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row, at most so many."""
    differ = x != y
    first = differ.argmax(1)
    return np.minimum(np.where(differ[np.arange(len(first)), first], first, x.shape[1]), most)


def reaches(group: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How far the matches of each suffix of at least WIDTH bytes reach to the left and to the right, 0 and 0 without one.

    group: sorted numbers; suffixes of one group have the same leading string, and match where their bytes do.
    All windows that match contain the leading string, so what they cover is one stretch.
    """
    n = len(group)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    nb, na = np.array([len(x) for x in before], np.int64), np.array([len(x) for x in after], np.int64)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(start, n))
    of = np.repeat(np.arange(len(start)), size)
    few = np.flatnonzero(size[of] <= PAIRS)
    if len(few):
        b = np.frombuffer(b"".join(before[i].ljust(SPAN, b"\0") for i in few), np.uint8).reshape(-1, SPAN)
        a = np.frombuffer(b"".join(after[i].ljust(WIDTH, b"\0") for i in few), np.uint8).reshape(-1, WIDTH)
        g, lb, la = of[few], nb[few], na[few]
        for d in range(1, int(size[np.unique(g)].max())):
            i = np.flatnonzero(g[:-d] == g[d:])
            x = _common(b[i], b[i + d], np.minimum(lb[i], lb[i + d]))
            y = _common(a[i], a[i + d], np.minimum(la[i], la[i + d]))
            ok = x + y >= WIDTH
            for j in (few[i[ok]], few[i[ok] + d]):
                left[j], right[j] = np.maximum(left[j], x[ok]), np.maximum(right[j], y[ok])
    for s, k in zip(start[size > PAIRS].tolist(), size[size > PAIRS].tolist(), strict=True):
        whole = [before[i][::-1] + after[i] for i in range(s, s + k)]
        for shift in range(SPAN + 1):
            first: dict[bytes, int] = {}
            hit = set()
            for i in range(k):
                at = int(nb[s + i]) - shift
                if at >= 0 and at + WIDTH <= len(whole[i]):
                    j = first.setdefault(whole[i][at : at + WIDTH], i)
                    if j != i:
                        hit |= {i, j}
            for i in hit:
                left[s + i], right[s + i] = max(left[s + i], shift), max(right[s + i], WIDTH - shift)
    return left, right


_SPANS = "id0 long, th long, p long, l int, r int"


def _settle(batches):
    """Rows of _contexts, sorted by a, to the stretches (id0, th, p, l, r) of those that stand once; a group is held whole."""
    held = None

    def judged(t: pa.Table):
        a = t.column("a").to_numpy()
        left, right = reaches(a, t.column("before").to_pylist(), t.column("after").to_pylist())
        keep = np.flatnonzero((left + right >= WIDTH) & t.column("once").to_numpy(zero_copy_only=False))
        t = t.take(pa.array(keep))
        cols = [t.column(c).combine_chunks() for c in ("id0", "th", "p")]
        return pa.RecordBatch.from_arrays([*(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols), pa.array(left[keep].astype(np.int32)), pa.array(right[keep].astype(np.int32))], names=["id0", "th", "p", "l", "r"])

    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            t = pa.Table.from_batches([batch.slice(k, 4096)])
            t = t if held is None else pa.concat_tables([held, t])
            a = t.column("a").to_numpy()
            cut = int(np.searchsorted(a, a[-1], "left"))
            if cut:
                yield judged(t.slice(0, cut))
            held = t.slice(cut)
    if held is not None and held.num_rows:
        yield judged(held)


def _windows(batches):
    """Rows of _contexts to one row (w0, w1, id0, th, p, once, k) for each window around the suffix, by its digest."""
    for batch in batches:
        for row in batch.to_pylist():
            whole, n = row["before"][::-1] + row["after"], len(row["before"])
            ks = [k for k in range(SPAN + 1) if n >= k and n - k + WIDTH <= len(whole)]
            w = [struct.unpack("<2q", hashlib.blake2b(whole[n - k : n - k + WIDTH] + k.to_bytes(1), digest_size=16).digest()) for k in ks]
            rest = [[row[c]] * len(ks) for c in ("id0", "th", "p", "once")]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([x[0] for x in w], [x[1] for x in w], *rest, ks), kinds, strict=True)], names=["w0", "w1", "id0", "th", "p", "once", "k"])


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """_settle for leading strings with any number of contexts: windows that stand twice, counted over all tasks."""
    rows = contexts.mapInArrow(_windows, "w0 long, w1 long, id0 long, th long, p long, once boolean, k int")
    twice = rows.groupBy("w0", "w1").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    found = rows.where("once").join(twice, ["w0", "w1"], "left_semi")
    return found.groupBy("id0", "th", "p").agg(F.max("k").cast("int").alias("l"), (F.lit(WIDTH) - F.min("k")).cast("int").alias("r"))


def _finish(batches):
    """(id0, th, text, spans) to (id0, th, n_removed, n_spans, kept_sha256)."""
    for batch in batches:
        data, o = column_bytes(batch.column(2))
        rows = []
        for i in range(batch.num_rows):
            s = batch.column(3)[i].values
            p, left, right = (s.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            n = int(o[i + 1] - o[i])
            lo, hi = np.maximum(p - left, 0), np.minimum(p + right, n)
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            first = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
            starts, ends = lo[first], hi[np.append(first[1:], len(lo)) - 1]
            kept, at = hashlib.sha256(), int(o[i])
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                kept.update(data[at : int(o[i]) + a])
                at = int(o[i]) + b
            kept.update(data[at : int(o[i + 1])])
            rows.append((int((ends - starts).sum()), len(starts), kept.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["id0", "th", "n_removed", "n_spans", "kept_sha256"])


def _with_texts(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (id0, th, text) joined to rows, one for each key; only texts of these keys travel while the keys are few."""
    keys = scratch.save(rows.select("id0", "th"), "keys")
    return docs.join(small_or_shuffled(keys, BROADCAST_ROWS), ["id0", "th"], "left_semi").join(rows, ["id0", "th"])


def repeated_spans(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256): each text without the bytes of 200-byte strings that stand more than once.

    Null counts as empty; texts under 200 bytes lose nothing, so copies of short texts stay. All copies of a string go,
    the first included, also inside one document. Other columns are ignored. Each row is a document of its own, whatever
    its id: a row with a null id is compared like any other, rows that repeat an id keep their own marks, and repeated
    rows are copies. Very long texts are sampled piece by piece, so they take a few times their size. An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id0"), F.xxhash64(text, F.col(id_col).isNull()).alias("th"), text.alias("text"))
    schema = "doc_id long, id0 long, th long, n_bytes long, t0 long, t1 long, sha string, a array<long>, u array<long>, p array<long>"
    shape = docs.mapInArrow(trimmed(_profile), schema).withColumn("batch", F.pmod(F.xxhash64("id0", "th"), F.lit(batches)).cast("int"))
    profile = scratch.save(shape, "profile", "batch")
    family = SuffixFamily(scratch)
    for k in range(batches):
        family.insert(profile.where(F.col("batch") == k))
    hits = scratch.save(family.hits(), "hits")  # read anew, so that the join can split a leading string of very many suffixes

    at = profile.select("id0", "th", F.explode(F.arrays_zip("a", "u", "p")).alias("s")).select("s.a", "s.u", "id0", "th", "s.p")
    found = scratch.save(at.join(hits, "a"), "found")
    scratch.drop(*(x for x in family.levels if x is not None))
    plain = found.where("not open").select("id0", "th", "p")
    mixed = found.where("open")
    one = scratch.save(mixed.groupBy("a", "u").agg(F.count("*").alias("c"), F.min(F.struct("id0", "th", "p")).alias("s")), "contexts")
    more = mixed.join(one.where("c > 1").select("a", "u"), ["a", "u"], "left_semi").select("id0", "th", "p")

    wanted = one.select("s.id0", "s.th", F.struct("a", "s.p", (F.col("c") == 1).alias("once")).alias("x")).groupBy("id0", "th").agg(F.collect_list("x").alias("x"))
    texts = _with_texts(docs.select("id0", "th", "text"), wanted, scratch).select("id0", "th", "text", "x")
    contexts = texts.mapInArrow(trimmed(_contexts), "a long, id0 long, th long, p long, once boolean, before binary, after binary")
    hot = scratch.save(one.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("a"), "hot")
    if is_empty(hot):
        spans = contexts.repartition(family.buckets, "a").sortWithinPartitions("a", "after").mapInArrow(trimmed(_settle), _SPANS)
    else:
        contexts = scratch.save(contexts, "hotcontexts")
        hot = small_or_shuffled(hot, BROADCAST_ROWS)
        few = contexts.join(hot, "a", "left_anti")
        spans = few.repartition(family.buckets, "a").sortWithinPartitions("a", "after").mapInArrow(trimmed(_settle), _SPANS)
        spans = spans.union(_hot_spans(contexts.join(hot, "a", "left_semi")))
    spans = scratch.save(spans, "settled")

    whole = plain.union(more).select("id0", "th", "p", F.lit(SPAN).alias("l"), F.lit(WIDTH).alias("r")).union(spans)
    marks = scratch.save(whole.groupBy("id0", "th").agg(F.collect_list(F.struct("p", "l", "r")).alias("spans")), "marks")
    scratch.drop(found, one)
    copied = profile.where(F.col("n_bytes") >= WIDTH).groupBy("t0", "t1").agg(F.count("*").alias("c")).where("c > 1").select("t0", "t1", F.lit(True).alias("copied"))
    rows = scratch.save(profile.select("doc_id", "id0", "th", "n_bytes", "t0", "t1", "sha").join(copied, ["t0", "t1"], "left").select("doc_id", "id0", "th", "n_bytes", "sha", F.coalesce("copied", F.lit(False)).alias("copied")), "rows")
    scratch.drop(profile)
    partly = marks.join(rows.where("copied").select("id0", "th"), ["id0", "th"], "left_anti")
    cut = scratch.save(_with_texts(docs.select("id0", "th", "text"), partly, scratch).select("id0", "th", "text", "spans").mapInArrow(trimmed(_finish), "id0 long, th long, n_removed long, n_spans long, kept_sha256 string"), "cut")
    own = lambda name, gone, kept: F.when(F.col("copied"), gone).otherwise(F.coalesce(name, kept)).alias(name)
    return rows.join(cut.dropDuplicates(["id0", "th"]), ["id0", "th"], "left").select("doc_id", "n_bytes", own("n_removed", F.col("n_bytes"), F.lit(0)), own("n_spans", F.lit(1), F.lit(0)), own("kept_sha256", F.lit(NOTHING), F.col("sha")))
