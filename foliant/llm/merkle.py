"""A Merkle manifest of a dataset: every row's leaf with its proof up to its group's root and on to the root of all.

Leaves are dealt by range, so that their places in their group follow from counts of the ranges. A level of the distributed tree
takes aligned blocks of nodes; each block is a tree of bounded height that one task walks leaf by leaf. The walk is fractal: of
each of several stacked layers it keeps the subtree that the current leaf's path needs and grows the one that comes next,
one leaf a step, so it holds a few small subtrees and never the block's tree. Roots of blocks are the nodes of the next level;
their paths, found the same way, are appended to those below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch, counted, partitions, small_or_shuffled

#: Levels of a block, and of one layer of subtrees in it.
BLOCK, LAYER = 10, 2
#: Block roots with their paths, about 1 kB each, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 20_000


def joined_hash(*nodes: str | None) -> str | None:
    """The digest of the nodes that are there, as hexadecimal text; none of no nodes."""
    some = [n for n in nodes if n is not None]
    return hashlib.sha256("".join(some).encode()).hexdigest() if some else None


class Growing:
    """A subtree that grows by a leaf a step: nodes of its layer are kept, of those below only what waits for its neighbour."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self.n = low, high, 0
        self.waiting: list[str | None] = [None] * high
        self.kept: dict[tuple[int, int], str | None] = {}
        self.root: str | None = None

    def add(self, node: str | None) -> None:
        """The next leaf; None stands where there is none, and what it would be joined with is hashed alone."""
        at = self.n
        self.n += 1
        for height in range(self.high):
            if height >= self.low:
                self.kept[height, at] = node
            if not at & 1:
                self.waiting[height] = node
                return
            node = joined_hash(self.waiting[height], node)
            at >>= 1
        self.root = node


def walk(leaves: list[str], height: int, layer: int = LAYER) -> Iterator[list[str | None]]:
    """The siblings, from below, of each leaf of a tree of the given height that may end early; None where a node has none."""
    layers = [(low, min(low + layer, height)) for low in range(0, height, layer)]
    exist, desire = [], []
    leaf = lambda i: leaves[i] if i < len(leaves) else None
    for low, high in layers:
        tree = Growing(low, high)
        for i in range(1 << high):
            tree.add(leaf(i))
        exist.append(tree)
        desire.append(Growing(low, high))
    for i in range(len(leaves)):
        path: list[str | None] = []
        for (low, high), tree in zip(layers, exist, strict=True):
            within = i & ((1 << high) - 1)
            path += [tree.kept[h, within >> h ^ 1] for h in range(low, high)]
        yield path
        for k, (low, high) in enumerate(layers):
            if high < height:
                desire[k].add(leaf(i + (1 << high)))
                if not (i + 1) & ((1 << high) - 1):
                    exist[k], desire[k] = desire[k], Growing(low, high)


def top(nodes: list[str], height: int) -> str:
    for _ in range(height):
        nodes = [joined_hash(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0]


def _height(m: int) -> int:
    """Of the blocks of a group of m nodes: all of one height, or the tree's own if there is just one block."""
    return min(BLOCK, (m - 1).bit_length())


def _roots(table: pa.Table) -> pa.Table:
    t = table.select(["g", "block", "idx", "m", "digest"]).sort_by("idx")
    m = t.column("m")[0].as_py()
    return pa.table([t.column("g").slice(0, 1), t.column("block").slice(0, 1), pa.array([-(-m >> BLOCK)], pa.int64()), pa.array([top(t.column("digest").to_pylist(), _height(m))])], names=["g", "idx", "m", "digest"])


PROOF = "array<struct<left:boolean,digest:string>>"
_PROOF = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())]))


def _paths(table: pa.Table) -> pa.Table:
    t = table.sort_by("idx")
    height, proofs = _height(t.column("m")[0].as_py()), []
    for i, path in enumerate(walk(t.column("digest").to_pylist(), height)):
        proofs.append([{"left": bool(i >> h & 1), "digest": d} for h, d in enumerate(path)])
    return t.append_column("proof", pa.array(proofs, _PROOF))


def _numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """rows (g, …) with idx, the place in g by the columns order, and m, the rows of g. Only counts of ranges are summed up."""
    parts = partitions(rows.sparkSession)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order).select("*", F.spark_partition_id().alias("part"), place.alias("at"))
    dealt = scratch.save(dealt, "dealt")
    counts = scratch.save(dealt.groupBy(F.col("g").alias("gg"), F.col("part").alias("pp")).agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("gg").orderBy("pp").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select("gg", "pp", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("shift"), F.sum("n").over(Window.partitionBy("gg")).alias("m"))
    both = dealt.join(small_or_shuffled(shift, BROADCAST_ROWS, of=counts), F.col("g").eqNullSafe(F.col("gg")) & (F.col("part") == F.col("pp")))
    return both.select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "m")


def _proofs(nodes: DataFrame, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """nodes (g, idx, m, digest, …), at most `most` of a group, with proof and root; and the roots (g, digest)."""
    schema = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    blocks = nodes.withColumn("block", F.shiftright("idx", BLOCK))
    g = nodes.schema["g"].dataType.simpleString()
    roots = scratch.save(blocks.groupBy("g", "block").applyInArrow(_roots, f"g {g}, idx long, m long, digest string"), "roots")
    inner = blocks.groupBy("g", "block").applyInArrow(_paths, f"{schema(blocks)}, proof {PROOF}")
    alone = roots.where("m = 1").select("g", "digest")
    upper = roots.where("m = 1").select(F.col("g").alias("gg"), F.col("idx").alias("bb"), F.array().cast(PROOF).alias("more"), F.col("digest").alias("root"))
    if most > 1 << BLOCK:
        above, up = _proofs(roots.where("m > 1"), -(-most >> BLOCK), scratch)
        upper = upper.union(above.select("g", "idx", "proof", "root"))
        alone = alone.union(up)
    both = inner.join(small_or_shuffled(upper, BROADCAST_ROWS, of=roots), F.col("g").eqNullSafe(F.col("gg")) & (F.col("block") == F.col("bb")))
    return both.select(*nodes.columns, F.concat("proof", "more").alias("proof"), "root"), alone


def leaf_of(*columns: Column) -> Column:
    """The digest of values, each as its length in bytes, a colon and its text, or a dash if it is null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""

    def step(node, x):
        alone, before, after = F.sha2(node, 256), F.sha2(F.concat(x["digest"], node), 256), F.sha2(F.concat(node, x["digest"]), 256)
        return F.when(x["digest"].isNull(), alone).when(x["left"], before).otherwise(after)

    return F.aggregate(proof, leaf, step)


def siblings_digest(proof: Column) -> Column:
    """The digest of a proof's siblings one after the other."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: x["digest"]), ""), 256)


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", key: str = "doc_id", carry: Column | None = None) -> DataFrame:
    """Rows (key, leaf, subroot, root, proof[, carried]), one for each row of docs; carry is a column of docs' that is handed on.

    Leaves are the digests of the columns named. In each group they ascend by key, null first, rows of one key by their digest;
    runs of two, the last perhaps of one, are hashed until one node is left, the group's root. These, by group, null first, lead to
    the root in the same way. A proof has a step for each level: the digest beside the node and whether it stands left of it, or
    nulls where a node is hashed alone. Texts are read once and never moved; a null in any column is a dash in the leaf. Other
    columns are ignored, and an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    more = [] if carry is None else [carry.alias("carried")]
    leaves = docs.select(F.col(group).cast("string").alias("g"), F.col(key).alias("key"), leaf_of(*(F.col(c) for c in columns)).alias("digest"), F.monotonically_increasing_id().alias("seq"), *more)
    leaves = scratch.save(leaves, "leaves")
    most = counted(leaves)["rows"]
    lower, roots = _proofs(_numbered(leaves, ["key", "digest", "seq"], scratch), most, scratch)
    roots = scratch.save(roots, "subroots")
    n_groups = counted(roots)["rows"]
    upper, _ = _proofs(_numbered(roots.select(F.lit(0).alias("g"), F.col("g").alias("name"), "digest"), ["name"], scratch), n_groups, scratch)
    upper = upper.select(F.col("name").alias("nn"), F.col("proof").alias("more"), F.col("root").alias("all"))
    both = lower.join(small_or_shuffled(upper, BROADCAST_ROWS, of=roots), F.col("g").eqNullSafe(F.col("nn")))
    return both.select(F.col("key").alias(key), F.col("digest").alias("leaf"), F.col("root").alias("subroot"), F.col("all").alias("root"), F.concat("proof", "more").alias("proof"), *(["carried"] if more else []))
