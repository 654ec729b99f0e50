"""Costs to nodes: which slices are kept as layers, gateways between layers, the sparse node table, the visible surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.config import Frame, Scene
from strata.operators.stencil import EMPTY_G


def next_layers(costs: DataFrame, scene: Scene, frame: Frame) -> DataFrame:
    """l, m: for each slice the first above it that shows something new.

    A slice m is new above l if, in some cell, its ground is higher or its cost lower than at l, its ground still rises
    at m + 1, and it isn't barred. Candidates for m are filtered before the join on the cell; only minima are shuffled on.
    """
    w = Window.partitionBy("cx", "cy").orderBy("s")
    v = costs.select("s", "cx", "cy", F.coalesce("g", F.lit(EMPTY_G)).alias("g"), "t").withColumn("above", F.lead("g").over(w))
    upper = v.where((F.col("above") > F.col("g")) & (F.col("t") < scene.cost_barrier) & F.col("s").between(1, frame.n_slice - 3))
    upper = upper.select("cx", "cy", F.col("s").alias("m"), F.col("g").alias("gm"), F.col("t").alias("tm"))
    lower = v.select("cx", "cy", F.col("s").alias("l"), "g", "t")
    met = lower.join(upper, ["cx", "cy"]).where((F.col("l") < F.col("m")) & ((F.col("gm") > F.col("g")) | (F.col("t") > F.col("tm"))))
    return met.groupBy("l").agg(F.min("m").alias("m"))


def kept_layers(costs: DataFrame, scene: Scene, frame: Frame) -> list[int]:
    """The slices kept, in order: the chain of next_layers() from slice 0 (at most one row for each slice on the driver)."""
    following = {r["l"]: r["m"] for r in next_layers(costs, scene, frame).collect()}
    kept = [0]
    while kept[-1] in following:
        kept.append(following[kept[-1]])
    if frame.n_slice > 1 and (last := max(1, frame.n_slice - 2)) != kept[-1]:
        kept.append(last)
    return kept


def layered(costs: DataFrame, kept: list[int]) -> DataFrame:
    """layer, s, cx, cy, g, c, t: the kept slices, numbered."""
    number = F.array_position(F.array(*(F.lit(s) for s in kept)), F.col("s")).cast("int") - 1
    return costs.where(F.col("s").isin(kept)).select(number.alias("layer"), "s", "cx", "cy", "g", "c", "t")


def gateways(layers: DataFrame, scene: Scene) -> DataFrame:
    """The layers with gateway: 2 to the layer above, -2 to the one below (which wins), else 0."""
    w = Window.partitionBy("cx", "cy").orderBy("layer")
    g, t = F.col("g"), F.col("t")
    close = lambda other: F.abs(other - g) < scene.gateway_height
    up = (F.lead("t").over(w) - t < -scene.gateway_cost) & close(F.lead("g").over(w))
    down = (t - F.lag("t").over(w) > scene.gateway_cost) & close(F.lag("g").over(w))
    return layers.withColumn("gateway", F.when(down, -2).when(up, 2).otherwise(0))


def numbered(rows: DataFrame) -> DataFrame:
    """node_id from 0 in order of (layer, col, row).

    Rows are numbered within their (layer, col); where each such strip begins is a running sum over strips, of which a
    map has as many as its width times its layers, so no task sees more than a strip or that list.
    """
    strip = Window.partitionBy("layer", "col")
    within = rows.withColumn("_at", F.row_number().over(strip.orderBy("row")))
    sizes = rows.groupBy("layer", "col").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("layer", "col", (F.sum("_n").over(Window.orderBy("layer", "col")) - F.col("_n")).alias("_before"))
    return within.join(before, ["layer", "col"]).withColumn("node_id", (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_at", "_before")


def sparse_nodes(layers: DataFrame, scene: Scene) -> DataFrame:
    """node_id, layer, row, col, trav, elev_g, elev_c, gateway of the cells worth planning on."""
    n = gateways(layers, scene).where((F.col("g").isNotNull() & (F.col("t") <= scene.cost_threshold)) | (F.col("gateway") != 0))
    n = n.select("layer", F.col("cy").alias("row"), F.col("cx").alias("col"), F.col("t").alias("trav"), F.col("g").alias("elev_g"), F.col("c").alias("elev_c"), "gateway")
    return numbered(n).select("node_id", "layer", "row", "col", "trav", "elev_g", "elev_c", "gateway")


def visible_surface(layers: DataFrame, scene: Scene) -> DataFrame:
    """layer, cx, cy, g, cost: a layer less than one slice below the next is hidden and hands its cost up if it is lower."""
    w = Window.partitionBy("cx", "cy").orderBy("layer")
    hidden = F.coalesce(F.lead("g").over(w) - F.col("g") < scene.slice_dh, F.lit(False))
    d = layers.withColumn("hidden", hidden)
    d = d.withColumn("island", F.sum(F.coalesce((~F.lag("hidden").over(w)).cast("int"), F.lit(0))).over(w))
    cost = F.min("t").over(Window.partitionBy("cx", "cy", "island").orderBy("layer").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("cost", cost).where("not hidden and g is not null").select("layer", "cx", "cy", "g", "cost")


def map_stats(layers: DataFrame, nodes: DataFrame, frame: Frame, n_layers: int) -> DataFrame:
    """One row: dense cells, occupied cells, nodes, gateways, and nodes for each dense cell."""
    dense = n_layers * frame.dim_x * frame.dim_y
    occupied = layers.agg(F.count_if(F.col("g").isNotNull()).alias("occupied_cells"))
    count = nodes.agg(F.count(F.lit(1)).alias("sparse_nodes"), F.count_if(F.col("gateway") != 0).alias("gateways"))
    return occupied.crossJoin(count).select(F.lit(dense).cast("long").alias("dense_cells"), "occupied_cells", "sparse_nodes", "gateways", (F.col("sparse_nodes") / F.lit(float(dense))).alias("sparse_ratio"))
