"""Connected components of an edge table, by star contraction over shuffles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch, counted, small_or_shuffled


#: Nodes of which the least neighbours are broadcast at most (16 bytes each); those of more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _stars(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One contraction step on rows (a, b), b < a. large: bind larger neighbours of each node to its least one; else the smaller.

    The least neighbours are a table of their own, so that both sides of the join are read anew and a node with very many
    neighbours can be split.
    """
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = scratch.save(least, "least")
    tied = near.join(small_or_shuffled(least, BROADCAST_ROWS), "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


#: Edges that one task connects by itself (16 bytes each); more are contracted over shuffles, with the same result.
LOCAL_EDGES = 200_000


def _connected(batches):
    """All edges (a, b) to (node, root): each end of an edge takes the lesser root of the two, until none changes."""
    pairs = [np.stack([c.to_numpy() for c in batch.columns], 1) for batch in batches if batch.num_rows]
    if not pairs:
        return
    names, p = np.unique(np.concatenate(pairs), return_inverse=True)
    p, root = p.reshape(-1, 2), np.arange(len(names))
    while len(p):
        a, b = root[p[:, 0]], root[p[:, 1]]
        p, a, b = p[a != b], a[a != b], b[a != b]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "root"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b): root is the least node that links reach.

    Edges may repeat, point either way or be loops; those with a null end are ignored. No edges: an empty table.
    Each round writes a table, so a lost executor costs at most that round.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    e, before = scratch.save(e, "edges", mark=mark), None
    if counted(e)["rows"] <= LOCAL_EDGES:
        one = e.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1)
        return scratch.save(one.mapInArrow(_connected, "node long, root long"), "roots")
    while counted(e)["rows"] and counted(e) != before:
        before = counted(e)
        new = scratch.save(_stars(_stars(e, True, scratch), False, scratch), "stars", mark=mark)
        scratch.drop(e)
        e = new
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
