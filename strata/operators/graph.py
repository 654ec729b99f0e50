"""Nodes to graph: edges within and across layers, components, the largest one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import Frame, Scene
from strata.functions.coords import step_length, traversable
from strata.operators.graph_core import LOCAL_EDGES, connected_components

HALF = ((0, 1), (1, -1), (1, 0), (1, 1))  # one of each two opposite neighbours
SQUARE = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1))


def active(nodes: DataFrame, scene: Scene) -> DataFrame:
    return nodes.where(traversable(scene))


def _moved(nodes: DataFrame, offsets: tuple[tuple[int, int], ...], layer_step=None) -> DataFrame:
    """Each node once for each offset, with the cell it looks at: layer, row, col; its own id and values as src, r, c, l, h."""
    moves = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets))).alias("o")
    layer = F.col("layer") if layer_step is None else F.col("layer") + layer_step
    n = nodes.select(F.col("node_id").alias("src"), layer.cast("int").alias("layer"), "row", "col", F.col("elev_g").alias("h"), moves)
    return n.select("src", "layer", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "h", F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"))


def _target(nodes: DataFrame) -> DataFrame:
    return nodes.select("layer", "row", "col", F.col("node_id").alias("dst"), F.col("elev_g").alias("h2"), F.col("trav").alias("trav2"))


def same_layer_edges(nodes: DataFrame, scene: Scene) -> DataFrame:
    """src, dst of active neighbours within a layer, each pair once; heights differ by no more than a step."""
    n = active(nodes, scene)
    met = _moved(n, HALF).join(_target(n), ["layer", "row", "col"])
    return met.where(F.abs(F.col("h2") - F.col("h")) <= scene.edge_step).select("src", "dst")


def cross_layer_edges(nodes: DataFrame, scene: Scene) -> DataFrame:
    """src, dst: each gateway and the best active node of the 3 x 3 cells in the layer it leads to.

    Best: nearest by squared distance in cells, then cheapest, then first by row and column.
    """
    n = active(nodes, scene)
    step = F.when(F.col("gateway") == 2, 1).otherwise(-1)
    met = _moved(n.where("gateway <> 0"), SQUARE, step).join(_target(n), ["layer", "row", "col"])
    met = met.where(F.abs(F.col("h2") - F.col("h")) <= scene.edge_step)
    best = F.min(F.struct((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d"), "trav2", "dr", "dc", "dst")).alias("best")
    return met.groupBy("src").agg(best).select("src", F.col("best.dst").alias("dst"))


def undirected_edges(nodes: DataFrame, scene: Scene) -> DataFrame:
    return same_layer_edges(nodes, scene).unionByName(cross_layer_edges(nodes, scene))


def graph_edges(nodes: DataFrame, scene: Scene, frame: Frame) -> DataFrame:
    """src, dst, weight: every edge both ways. The length is in cells, the penalty is that of the node it leads to."""
    one_way = undirected_edges(nodes, scene)
    both = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    a = nodes.select(F.col("node_id").alias("src"), "layer", "row", "col", "elev_g")
    b = nodes.select(F.col("node_id").alias("dst"), *(F.col(c).alias(f"{c}2") for c in ("layer", "row", "col", "elev_g", "trav")))
    weight = step_length(frame.resolution) + scene.cost_weight * F.col("trav2")
    return both.join(a, "src").join(b, "dst").select("src", "dst", weight.alias("weight"))


def component_labels(nodes: DataFrame, scene: Scene) -> DataFrame:
    """node_id, component (its least node_id) of every node; a node without edges is a component of its own."""
    linked = connected_components(undirected_edges(nodes, scene), local_limit=LOCAL_EDGES)
    return nodes.select("node_id").join(linked.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of the component with most nodes; of equal ones, the one with the least node_id."""
    top = component_sizes(labels).orderBy(F.desc("size"), "component").limit(1).select("component")
    if not nodes.limit(1).count():
        raise ValueError("no active node")
    return nodes.join(labels.join(F.broadcast(top), "component", "left_semi"), "node_id", "left_semi")


def removed_nodes(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    return nodes.join(kept.select("node_id"), "node_id", "left_anti")


def edge_direction_counts(nodes: DataFrame, scene: Scene) -> DataFrame:
    """kind, edges: how many edges run within and across layers."""
    kinds = same_layer_edges(nodes, scene).select(F.lit("same_layer").alias("kind")).unionByName(cross_layer_edges(nodes, scene).select(F.lit("cross_layer").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


def provenance(nodes: DataFrame, labels: DataFrame, scene: Scene, source: str) -> DataFrame:
    """One row: where a filtered map comes from."""
    sizes = component_sizes(labels).agg(F.max("size").alias("largest_nodes"), F.count(F.lit(1)).alias("components"))
    total = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(traversable(scene)).alias("active_nodes"))
    kinds = edge_direction_counts(nodes, scene).agg(
        F.coalesce(F.max(F.when(F.col("kind") == "same_layer", F.col("edges"))), F.lit(0)).alias("same_layer_edges"), F.coalesce(F.max(F.when(F.col("kind") == "cross_layer", F.col("edges"))), F.lit(0)).alias("cross_layer_edges")
    )
    row = total.crossJoin(sizes).crossJoin(kinds)
    return row.select(
        F.lit(source).alias("input"),
        F.lit("same-layer neighbours and gateways").alias("method"),
        F.lit(scene.cost_threshold).alias("cost_threshold"),
        F.lit(scene.edge_step).alias("step_max"),
        "total_nodes",
        "active_nodes",
        "largest_nodes",
        (F.col("total_nodes") - F.col("largest_nodes")).alias("removed_nodes"),
        "components",
        "same_layer_edges",
        "cross_layer_edges",
    )
