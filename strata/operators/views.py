"""Rows that a viewer draws: clouds, markers, boxes, labels, paths. The transport of messages is no part of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import Frame
from strata.functions.coords import node_x, node_y, world_of

# Corners of a box as (x, y, z) taken from its min or max, and the pairs of corners that its edges join.
CORNERS = (("min", "min", "min"), ("max", "min", "min"), ("max", "max", "min"), ("min", "max", "min"), ("min", "min", "max"), ("max", "min", "max"), ("max", "max", "max"), ("min", "max", "max"))
EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))


def sparse_cloud(nodes: DataFrame, frame: Frame) -> DataFrame:
    return nodes.select("node_id", node_x(frame).alias("x"), node_y(frame).alias("y"), F.col("elev_g").alias("z"), "trav", "gateway")


def surface_cloud(surface: DataFrame, frame: Frame) -> DataFrame:
    x, y = world_of(F.col("cx"), frame.center_x, frame.dim_x, frame.resolution), world_of(F.col("cy"), frame.center_y, frame.dim_y, frame.resolution)
    return surface.select("layer", x.alias("x"), y.alias("y"), F.col("g").alias("z"), "cost")


def raw_cloud(points: DataFrame) -> DataFrame:
    return points.select("x", "y", "z", F.lit(0.0).alias("intensity"))


def bbox_wireframe(regions: DataFrame) -> DataFrame:
    """id, edge, and both ends of each of the twelve edges of a region's box."""
    at = lambda k, p: [F.col(f"{side}_{axis}").alias(f"{p}{axis}") for side, axis in zip(CORNERS[k], "xyz", strict=True)]
    edges = F.array(*(F.struct(F.lit(i).alias("edge"), *at(a, "a"), *at(b, "b")) for i, (a, b) in enumerate(EDGES)))
    return regions.select(F.col("id").cast("int").alias("id"), F.explode(edges).alias("e")).select("id", "e.*")


def region_labels(regions: DataFrame, text_height: float = 0.4) -> DataFrame:
    """id, place and text of each region's label."""
    comp = F.when(F.size("component_id") == 1, F.col("component_id")[0].cast("string")).otherwise(F.concat(F.lit("["), F.array_join(F.transform("component_id", lambda c: c.cast("string")), ", "), F.lit("]")))
    text = F.format_string("id:%d comp:%s\nnodes:%d\nz:[%.2f, %.2f]", "id", comp, "node_count", "min_z", "max_z")
    return regions.select(F.col("id").cast("int").alias("id"), F.col("center_x").alias("x"), F.col("center_y").alias("y"), (F.col("center_z") + text_height * 0.5).alias("z"), text.alias("text"))


def region_centers(regions: DataFrame) -> DataFrame:
    return regions.select(F.col("id").cast("int").alias("id"), *(F.col(f"center_{v}").alias(v) for v in "xyz"))


def waypoint_markers(waypoints: DataFrame) -> DataFrame:
    """kind, pos, place, size and text: a point on the line, a sphere and a label for each, a disk where the radius is positive."""
    w = waypoints.select("pos", F.coalesce("name", F.concat(F.lit("wp_"), F.col("pos").cast("string"))).alias("text"), "x", "y", "z", F.coalesce("radius", F.lit(0.0)).alias("size"))
    kinds = [w.select(F.lit(k).alias("kind"), "pos", "x", "y", "z", "size", "text") for k in ("line", "sphere", "label")]
    disks = w.where("size > 0").select(F.lit("disk").alias("kind"), "pos", "x", "y", "z", "size", "text")
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(disks)


def path_rows(points: DataFrame) -> DataFrame:
    return points.select("pair_index", "seq", "x", "y", "z")
