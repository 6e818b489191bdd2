"""N-gram Jaccard join: size-banded tiles, bitmap bounds, then exact intersection.

Two texts link when |A & B| >= t * |A | B| for their shingle sets A and B. With d the largest
symmetric difference that a linked pair in a size band can have, the hash space is cut into m > d
tiles; a linked pair then has at least m - d equal tiles. A text has one signature for each filled
tile; one that leaves m - d tiles empty also has one for each pair of these, so no link is lost.
Sets with enough tokens of their own are left out of the search first, by counting the tokens of one
part of the hash space. Signatures are counted over all texts, and each text searches with its rarest
ones only, so many of them that a linked pair must still meet: what very many texts share, as a
passage, makes no candidates of them. Candidates are compared block by block, with the population count of
xor-ed bitmaps as an upper bound of the overlap before sorted arrays are intersected. A large group is first
compared within blocks, then by one text of what these connect; only texts that are then still apart meet, and of
these the bitmaps travel first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.llm.scratch import Scratch, is_empty, partitions, small_or_shuffled
from foliant.llm.textbytes import column_bytes, lists, mix, row_chunks, shingle_sets, trimmed

#: Documents, and shingles, of one block of candidates at most; a larger document is alone.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
#: Candidates of which the ids are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Tokens that a task combines before it sends them.
COMBINE = 1 << 19
#: Members that a component has in a block at least for one of them to stand for it in the others.
HEADED = 8
#: The part of a large group's blocks in which texts of several components are.
MIXED = -1
#: Lower thresholds would need tiles so small that most are empty.
LEAST_THRESHOLD = Fraction(4, 5)
_U = np.uint64


def linked(common: int, a: int, b: int, t: Fraction) -> bool:
    return t.denominator * common >= t.numerator * (a + b - common)


def bands(n: int, t: Fraction) -> list[int]:
    """Upper ends of the size bands in which a set of n must look for partners at least as large or as small."""
    ends, hi = [], 4
    top = n * t.denominator // t.numerator
    while hi < n:
        hi = hi * 3 // 2
    while True:
        ends.append(hi)
        if hi >= top:
            return ends
        hi = hi * 3 // 2


def region(t: Fraction) -> np.uint64:
    """The end of the part of the hash space, twice the share in which linked sets may differ, whose tokens are counted."""
    return _U(min((1 << 64) - 1, int(2 * (1 - t) * (1 << 64)) + 1))


def tiles(hi: int, t: Fraction) -> tuple[int, int]:
    """Tiles of a band and how many of them linked sets of at most hi elements have equal at least, always two or more."""
    q, p = t.denominator, t.numerator
    d = (q - p) * 2 * hi // (q + p)
    m = d + 2
    m += int(1.6 * m * math.exp(-2 * hi / 3 / m))
    return m, m - d


def signatures(x: np.ndarray, t: Fraction) -> list[tuple[int, int, np.ndarray]]:
    """Of one sorted set, for each band (number, least, signatures).

    Sets that are linked but not equal share at least `least` signatures of one number, where that is positive in both, or else
    at least one: of the filled tiles, or of the pairs of empty ones, whose number is negative.
    """
    out = []
    with np.errstate(over="ignore"):
        c = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(mix(x + _U(0x632BE59BD9B4E019)), out=c[1:])
        for hi in bands(len(x), t):
            m, equal = tiles(hi, t)
            if m == equal:
                continue  # only equal sets are linked here
            cuts = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
            at = np.concatenate(([0], np.searchsorted(x, cuts), [len(x)]))
            full = np.diff(at) > 0
            seed = mix(np.arange(m, dtype=np.uint64) + _U(m << 32))
            empty = seed[~full]
            out.append((hi, max(1, equal - len(empty)), mix((c[at[1:]] - c[at[:-1]]) ^ seed)[full]))
            if len(empty) >= equal:
                i, j = np.triu_indices(len(empty), 1)
                out.append((-hi, 1, mix(empty[i] * _U(3) + empty[j])))
    return out


def _sets(batches, k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        d, o = column_bytes(batch.column(1))
        for a, b in row_chunks(o):
            yield batch.slice(a, b - a), shingle_sets(d[o[a] : o[b]], o[a : b + 1] - o[a], k)


def _hashes(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    with np.errstate(over="ignore"):
        return [(int(x.sum(dtype=np.uint64)), int(mix(x).sum(dtype=np.uint64))) for x in sets]


def _profile(k: int, t: Fraction):
    """(doc_id, text) to (doc_id, n, r, h1, h2): size, tokens in the region, and hashes of the set."""

    def run(batches):
        for batch, sets in _sets(batches, k):
            r = [int(np.searchsorted(x, region(t))) for x in sets]
            signed = np.array(_hashes(sets), dtype=np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(r, pa.int64()), pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy())], names=["doc_id", "n", "r", "h1", "h2"])

    return run


def _runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts s, the starts of its runs of equal values in that order, and their lengths."""
    order = np.argsort(s, kind="stable")
    v = s[order]
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    return order, start, np.diff(np.append(start, len(v)))


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, ids) of some COMBINE values at a time."""
    held, n = [], 0
    for s, ids in parts:
        held.append((s, ids))
        n += len(s)
        if n >= COMBINE:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _batches(arrays: list[np.ndarray], masks: list[np.ndarray | None], names: list[str]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(arrays[0]), 1 << 16):
        cut = slice(k, k + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[cut], mask=None if m is None else m[cut]) for x, m in zip(arrays, masks, strict=True)], names=names)


def _tokens(k: int, t: Fraction):
    """(doc_id, text) to tokens of the region as rows (s, doc_id, c).

    Of tokens that some COMBINE ones hold more than once just one row without a document travels, as a witness; how many of
    them each document has is a row with c instead. So a token of very many documents is a row a task or so. A task sends the
    tokens of equal sets once.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()

        def parts():
            for batch, sets in _sets(batches, k):
                for i, x, key in zip(batch.column(0).to_pylist(), sets, _hashes(sets), strict=True):
                    if key not in seen:
                        seen.add(key)
                        x = x[: np.searchsorted(x, region(t))]
                        yield x.view(np.int64), np.full(len(x), i)
                if len(seen) > 500_000:
                    seen.clear()

        for s, ids in _gathered(parts()):
            order, start, n = _runs(s)
            known = np.repeat(n > 1, n)
            docs, c = np.unique(ids[order[known]], return_counts=True)
            first = order[start]
            rows = [np.concatenate((s[first], mix(docs.view(np.uint64)).view(np.int64))), np.concatenate((ids[first], docs)), np.concatenate((np.zeros(len(first), np.int64), c))]
            yield from _batches(rows, [None, np.concatenate((n > 1, np.zeros(len(docs), bool))), None], ["s", "doc_id", "c"])

    return trimmed(run)


def _shared(batches):
    """Rows of _tokens sorted by s to (doc_id, c): how many of a document's tokens other rows have too."""
    held = before = None
    names = ["doc_id", "c"]
    for batch in batches:
        ids, c = batch.column(1), batch.column(2).to_numpy()
        sums = np.flatnonzero(c > 0)
        if len(sums):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(sums)), pa.array(c[sums])], names=names)
        known = ids.is_null().to_numpy(zero_copy_only=False)[c == 0]
        s, ids = batch.column(0).to_numpy()[c == 0], ids.fill_null(0).to_numpy()[c == 0]
        if held is not None:
            s, ids, known = np.concatenate((held[0], s)), np.concatenate((held[1], ids)), np.concatenate((held[2], known))
        if not len(s):
            continue
        same = s[1:] == s[:-1]
        hit = np.append(same, False)
        hit[1:] |= same
        hit[0] |= before is not None and s[0] == before
        n = len(s) - 1
        found, count = np.unique(ids[:n][(hit & ~known)[:n]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count.astype(np.int64))], names=names)
        held, before = (s[n:], ids[n:], known[n:]), s[n - 1] if n else before
    if held is not None and before is not None and held[0][0] == before and not held[2][0]:
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array([1], pa.int64())], names=names)


def _signatures(k: int, t: Fraction):
    """(doc_id, text) to rows (doc_id, band, least, s), s a list."""

    def run(batches):
        for batch, sets in _sets(batches, k):
            rows = [(i, *sig) for i, x in zip(batch.column(0).to_pylist(), sets, strict=True) for sig in signatures(x, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), lists([r[3].view(np.int64) for r in rows])], names=["doc_id", "band", "least", "s"])

    return trimmed(run)


def candidates(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) of rows (doc_id, band, least, s): each document with the least one of each signature that it searches with.

    A document searches with the rarest of its signatures that others have too, all but least - 1 of a band.
    """
    rows = signed.select("doc_id", "band", "least", F.explode("s").alias("s"))
    common = rows.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    ordered = rows.join(common, "s").groupBy("doc_id", "band").agg(F.first("least").alias("least"), F.sort_array(F.collect_list(F.struct("f", "s"))).alias("x"))
    some = ordered.where(F.size("x") >= F.col("least")).select("doc_id", F.explode(F.slice("x", F.lit(1), (F.size("x") - F.col("least") + 1).cast("int"))).alias("x"))
    kept = scratch.save(some.select("doc_id", F.col("x.s").alias("s")), "kept")
    hubs = kept.groupBy("s").agg(F.min("doc_id").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    return kept.join(hubs, "s").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()


def _arrays(k: int, packed: bool):
    """(doc_id, text, …) to (doc_id, …, shingles): the sorted set, or its bitmap."""

    def run(batches):
        for batch, sets in _sets(batches, k):
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            data = [(_bitmaps([x], _width(len(x)))[0] if packed else x).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, pa.array(data, pa.binary())], names=["doc_id", *batch.schema.names[2:], "shingles"])

    return trimmed(run)


def _width(n: int) -> int:
    """Words of the bitmap of a set of n, some four bits for each element."""
    words = 1
    while words * 64 < 4 * n and words < 256:
        words *= 2
    return words


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap in fewer words, as if it had been made with these."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _bitmaps(sets: list[np.ndarray], words: int) -> np.ndarray:
    out = np.zeros((len(sets), words), dtype=np.uint64)
    for i, x in enumerate(sets):
        y = x & _U(words * 64 - 1)
        np.bitwise_or.at(out[i], (y >> _U(6)).astype(np.int64), _U(1) << (y & _U(63)))
    return out


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, t: Fraction) -> list[tuple[int, int]]:
    """Verified links between two blocks, or within one if right is None, as many as connect what is connected."""
    both = left + (right or [])
    size = np.array([len(x) for x in both], dtype=np.int64)
    bits = _bitmaps(both, _width(int(size.max())))
    root = list(range(len(both)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    found = []
    for i in range(len(left)):
        j0 = i + 1 if right is None else len(left)
        if j0 >= len(both):
            break
        for j in np.flatnonzero(_possible(bits[j0:], size[j0:], bits[i], size[i], t)) + j0:
            a, b = find(i), find(int(j))
            if a != b and linked(len(np.intersect1d(both[i], both[j], assume_unique=True)), size[i].item(), size[j].item(), t):
                root[max(a, b)] = min(a, b)
                found.append((i, int(j)))
    return found


def _possible(bits: np.ndarray, size: np.ndarray, one: np.ndarray, n: int, t: Fraction) -> np.ndarray:
    """Which of some sets may be linked with one, by their bitmaps and sizes.

    Each differing bit stands for an element of one set only: |A & B| <= (|A| + |B| - differ) / 2.
    """
    differ, total = np.bitwise_count(bits ^ one).sum(1, dtype=np.int64), size + n
    most = np.minimum((total - differ) // 2, np.minimum(size, n))
    return t.denominator * most >= t.numerator * (total - most)


def _sorted_sides(table: pa.Table) -> tuple[pa.Table, int]:
    table = table.sort_by([("side", "ascending"), ("n", "ascending"), ("doc_id", "ascending")])
    return table, sum(1 for x in table.column("side").to_pylist() if x == 0)


def _verify(t: Fraction):
    """Exact links between two blocks, or within one."""

    def run(key, table):
        table, cut = _sorted_sides(table)
        ids = table.column("doc_id").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        found = _links(sets[:cut], sets[cut:] or None, t)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return run


def _near(t: Fraction):
    """Pairs of different components that may be linked by their bitmaps, between two blocks or within one."""

    def run(key, table):
        table, cut = _sorted_sides(table)
        ids, root, size = (table.column(c).to_numpy() for c in ("doc_id", "root", "n"))
        maps = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        words = min(len(x) for x in maps)
        bits = np.stack([_folded(x, words) for x in maps])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(cut):
            j0 = i + 1 if cut == len(ids) else cut
            j = np.flatnonzero(_possible(bits[j0:], size[j0:], bits[i], size[i], t) & (root[j0:] != root[i])) + j0
            a.append(np.full(len(j), ids[i]))
            b.append(ids[j])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return run


def blocked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (doc_id, n, g, part, root) with a column block: the documents of a part in order of size, cut by count and by weight.

    Only the sizes of a part are put in order; documents of one size fall into its blocks by a hash, so no part is gathered.
    """
    counted = rows.groupBy("g", "part", "n").agg((F.count("*") * (F.lit(1.0 / BLOCK_DOCS) + F.col("n") / F.lit(float(BLOCK_SHINGLES)))).alias("weight"))
    before = F.sum("weight").over(Window.partitionBy("g", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    scale = scratch.save(counted.select("g", "part", "n", F.coalesce(before, F.lit(0.0)).alias("before"), "weight"), "scale")
    within = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    placed = rows.join(small_or_shuffled(scale, BROADCAST_ROWS), ["g", "part", "n"])
    return scratch.save(placed.select("doc_id", "n", "g", "part", "root", F.floor(F.col("before") + within * F.col("weight")).cast("long").alias("block")), "blocks")


def _meetings(placed: DataFrame, t: Fraction, inside: bool | None) -> DataFrame:
    """Rows (g, i, j, i_part, j_part, ...) of the pairs of blocks to compare: blocks with themselves, others of like size, or (None) both.

    Blocks of one part that isn't null are left apart if not inside.
    """
    spans = placed.groupBy("g", "part", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = spans.alias("x"), spans.alias("y")
    mine, theirs = F.struct("x.part", "x.block"), F.struct("y.part", "y.block")
    close = (F.col("y.lo") * t.numerator <= F.col("x.hi") * t.denominator) & (F.col("x.lo") * t.numerator <= F.col("y.hi") * t.denominator)
    if inside:
        return spans.select("g", F.struct("part", "block").alias("i"), F.struct("part", "block").alias("j"))
    apart = F.lit(True) if inside is None else (F.col("x.part") != F.col("y.part")) | (F.col("x.part") == MIXED)
    return x.join(y, F.col("x.g") == F.col("y.g")).where((mine <= theirs) & close & apart).select(F.col("x.g").alias("g"), mine.alias("i"), theirs.alias("j"))


def _compared(docs: DataFrame, placed: DataFrame, met: DataFrame, k: int, t: Fraction, scratch: Scratch, name: str, exact: bool) -> DataFrame:
    """Links (a, b) between the documents of the blocks that meet, or the pairs of different components (root) that bitmaps leave possible."""
    met = scratch.save(met, "met")
    sides = met.select("g", F.col("i").alias("at"), "i", "j", F.lit(0).alias("side")).union(met.where("i <> j").select("g", F.col("j").alias("at"), "i", "j", F.lit(1).alias("side")))
    busy = placed.withColumn("at", F.struct("part", "block")).join(small_or_shuffled(scratch.save(sides.select("g", "at").distinct(), "busy"), BROADCAST_ROWS), ["g", "at"], "left_semi")
    keys = scratch.save(busy.select("doc_id", "g", "n", "root", "at"), "keys")
    arrays = docs.join(small_or_shuffled(keys, BROADCAST_ROWS), "doc_id").select("doc_id", "text", "g", "n", "root", F.col("at.part").alias("part"), F.col("at.block").alias("block"))
    arrays = arrays.mapInArrow(_arrays(k, not exact), "doc_id long, g long, n long, root long, part long, block long, shingles binary")
    pairs = arrays.withColumn("at", F.struct("part", "block")).join(small_or_shuffled(scratch.save(sides, "sides"), BROADCAST_ROWS), ["g", "at"])
    pairs = pairs.select("doc_id", "n", "root", "shingles", "g", F.col("i.part").alias("ip"), F.col("i.block").alias("ib"), F.col("j.part").alias("jp"), F.col("j.block").alias("jb"), "side")
    return scratch.save(pairs.groupBy("g", "ip", "ib", "jp", "jb").applyInArrow((_verify if exact else _near)(t), "a long, b long"), name)


def _linked(docs: DataFrame, placed: DataFrame, met: DataFrame, k: int, t: Fraction, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) as _compared() finds them, for blocks of which most pairs are none: bitmaps travel first, and sets only of what these leave."""
    possible = _compared(docs, placed, met, k, t, scratch, f"{name}-possible", False)
    groups = scratch.save(components(possible, scratch), f"{name}-groups")
    sized = groups.join(placed.select("doc_id", "n"), groups["node"] == placed["doc_id"]).select("doc_id", "n", F.col("root").alias("g"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("root"))
    again = blocked(scratch.save(sized, f"{name}-sized"), scratch)
    return _compared(docs, again, _meetings(again, t, None), k, t, scratch, name, True)


def connected(docs: DataFrame, sized: DataFrame, k: int, t: Fraction, scratch: Scratch) -> DataFrame:
    """Components (node, root) of the links among the documents (doc_id, n, g) of each candidate group g."""
    zero = F.lit(0).cast("long")
    placed = blocked(sized.withColumn("part", zero).withColumn("root", zero), scratch)
    links = _compared(docs, placed, _meetings(placed, t, True), k, t, scratch, "links", True)
    labels = scratch.save(components(links, scratch), "labels")
    large = scratch.save(placed.groupBy("g").agg(F.max("block").alias("last")).where(F.col("last") > 0).select("g"), "large")
    if is_empty(large):
        return labels
    rest = scratch.save(placed.join(small_or_shuffled(large, BROADCAST_ROWS), "g").select("doc_id", "n", "g", "block"), "rest")

    def labelled(labels: DataFrame) -> DataFrame:
        mine = small_or_shuffled(labels.select(F.col("node").alias("doc_id"), "root"), BROADCAST_ROWS, labels)
        return rest.join(mine, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))

    # one text of each component of some size in each block stands for it
    one = labelled(labels).groupBy("g", "block", "root").agg(F.min(F.struct("n", "doc_id")).alias("x"), F.count("*").alias("c")).where(F.col("c") >= HEADED).select("x.doc_id", "x.n", "g", zero.alias("part"), "root")
    heads = blocked(scratch.save(one, "heads"), scratch)
    links = scratch.save(links.union(_linked(docs, heads, _meetings(heads, t, None), k, t, scratch, "headlinks")), "links")
    named = scratch.save(labelled(scratch.save(components(links, scratch), "labels")).select("doc_id", "n", "g", "root"), "named")
    big = scratch.save(named.groupBy("g", "root").agg(F.count("*").alias("c")).where(F.col("c") >= BLOCK_DOCS).drop("c"), "big")
    parts = named.join(small_or_shuffled(big.withColumn("part", F.col("root")), BROADCAST_ROWS, big), ["g", "root"], "left").select("doc_id", "n", "g", "root", F.coalesce("part", F.lit(MIXED)).alias("part"))
    placed = blocked(scratch.save(parts, "parts"), scratch)
    return components(links.union(_linked(docs, placed, _meetings(placed, t, False), k, t, scratch, "lastlinks")), scratch)


def jaccard_components(docs: DataFrame, k: int, threshold: Fraction, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): every document with the least id that links reach.

    Other columns of docs are ignored. Null or empty text: 0 shingles, linked with nothing. Rows with equal texts are
    linked, as are texts with equal sets. Ids are unique: rows that repeat an id are one node. A row with a null id is no
    node; it gets the component of the texts with an equal set. Very long texts are compared whole, each in a block of its
    own. An empty table gives an empty one.
    """
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"the threshold must be {LEAST_THRESHOLD} to 1")
    spark, t = docs.sparkSession, threshold
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = scratch.save(docs.mapInArrow(trimmed(_profile(k, t)), "doc_id long, n long, r long, h1 long, h2 long"), "profile")
    sets = profile.select("doc_id", "n", "h1", "h2")
    classes = scratch.save(sets.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")

    # a set with n - ceil(t n) + 1 tokens that no other set has is linked with none, and out of the search
    tokens = docs.where("doc_id is not null").mapInArrow(_tokens(k, t), "s long, doc_id long, c long")
    common = tokens.repartition(partitions(spark), "s").sortWithinPartitions("s").mapInArrow(_shared, "doc_id long, c long")
    common = scratch.save(common.groupBy("doc_id").agg(F.sum("c").alias("c")), "common")
    alone = F.col("n") - F.ceil(F.col("n") * t.numerator / t.denominator - F.lit(1e-9)) + 1
    open_ = profile.join(common, "doc_id", "left").where(F.col("n") > 0).where(F.col("r") - F.coalesce("c", F.lit(0)) < alone).select("n", "h1", "h2")
    searched = scratch.save(classes.join(open_.distinct(), ["n", "h1", "h2"]).select(F.col("rep").alias("doc_id"), "n"), "searched")

    mine = docs.join(small_or_shuffled(searched.select("doc_id"), BROADCAST_ROWS, searched), "doc_id")
    signed = scratch.save(mine.mapInArrow(_signatures(k, t), "doc_id long, band long, least long, s array<long>"), "signed")
    groups = scratch.save(components(candidates(signed, scratch), scratch), "groups")
    scratch.drop(signed)
    sized = scratch.save(groups.join(searched, groups["node"] == searched["doc_id"]).select("doc_id", "n", F.col("root").alias("g")), "sized")
    labels = connected(docs.join(small_or_shuffled(sized.select("doc_id"), BROADCAST_ROWS, sized), "doc_id", "left_semi"), sized, k, t, scratch)

    mine = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.coalesce("root", "rep").alias("component_id"))
    return sets.join(mine, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_join(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(8, 10), **columns) -> DataFrame:
    """jaccard_components with a scratch folder of its own."""
    return jaccard_components(docs, k, threshold, Scratch(docs.sparkSession, "jaccard"), **columns)
