"""Connected components of an undirected edge table, for graphs of any size and diameter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import discard, written

#: Contracted edges (16 bytes each) that the terrain queries leave to one task.
LOCAL_EDGES = 1_000_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition, a batch at a time: each batch becomes one edge from every node to its least."""
    for b in batches:
        u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = np.arange(len(nodes))
        x, y = ends[: len(u)], ends[len(u) :]
        while True:
            low = np.minimum(parent[x], parent[y])
            new = parent.copy()
            np.minimum.at(new, parent[x], low)
            np.minimum.at(new, parent[y], low)
            new = new[new]
            if (new == parent).all():
                break
            parent = new
        keep = parent != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[parent[keep]])], names=["u", "v"])


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same over all batches of the partition at once: only for edges of a counted bound."""
    held = [b for b in batches if b.num_rows]
    if held:
        yield from forest(iter(pa.Table.from_batches(held).combine_chunks().to_batches()))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the least of its neighbourhood to its larger neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, local_limit: int = 0) -> DataFrame:
    """node, component (the least id of the component) for every node that has an edge to another node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) need a number of rounds that grows with the
    logarithm of the component, not with its diameter. Every round is written to the shared folder, so plans stay small
    and a lost executor costs one round. Before the first round each partition contracts its own edges. If no more than
    local_limit edges are then left, one task finishes them without rounds.
    """
    u, v = F.col(src).cast("long"), F.col(dst).cast("long")
    start = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v")
    now = written(start.mapInArrow(forest, "u long, v long"), "components")
    if local_limit and now.count() <= local_limit:
        before, now = now, written(now.coalesce(1).mapInArrow(_whole_forest, "u long, v long"), "components")
        discard(before)
        return _labels(now)
    state = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            break
        state = tuple(mark)
        before, now = now, written(_small_star(_large_star(now)), "components")
        discard(before)
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return _labels(now)


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
