"""Cloud to voxels: bounds, cells, slice buckets, ground and ceiling, downsampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.config import Frame, Scene
from strata.functions.coords import cell_of, first_slice


def clean(points: DataFrame) -> DataFrame:
    """Points with three coordinates; a null or NaN in any drops the row."""
    return points.select("x", "y", "z").na.drop().where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))


def bounds(points: DataFrame) -> DataFrame:
    """One row: count and extent of the clean cloud. Partial aggregates only, so one row for each task is shuffled."""
    agg = [f(F.col(c)).alias(f"{n}_{c}") for c in ("x", "y", "z") for f, n in ((F.min, "min"), (F.max, "max"))]
    return clean(points).agg(F.count(F.lit(1)).alias("n_points"), *agg)


def header(points: DataFrame, scene: Scene) -> DataFrame:
    """One row: the frame of the map, as columns."""
    b = bounds(points)
    r = F.lit(scene.resolution)
    return b.select(
        "n_points",
        ((F.col("min_x") + F.col("max_x")) / 2).alias("center_x"),
        ((F.col("min_y") + F.col("max_y")) / 2).alias("center_y"),
        (F.ceil((F.col("max_x") - F.col("min_x")) / r) + 4).cast("int").alias("dim_x"),
        (F.ceil((F.col("max_y") - F.col("min_y")) / r) + 4).cast("int").alias("dim_y"),
        F.ceil((F.col("max_z") - F.lit(scene.ground_h)) / F.lit(scene.slice_dh)).cast("int").alias("n_slice"),
        F.lit(scene.ground_h + scene.slice_dh).alias("slice_h0"),
    )


def frame_of(points: DataFrame, scene: Scene) -> Frame:
    """The frame on the driver (one row): later operators then hold plain literals."""
    row = header(points, scene).first()
    if not row["n_points"]:
        raise ValueError("the cloud has no point with three coordinates")
    return Frame(row["center_x"], row["center_y"], row["dim_x"], row["dim_y"], max(1, row["n_slice"]), row["slice_h0"], scene.slice_dh, scene.resolution)


def cells(points: DataFrame, frame: Frame) -> DataFrame:
    """Points with their cell; those outside the raster are dropped."""
    p = clean(points).select(
        cell_of(F.col("x"), frame.center_x, frame.dim_x, frame.resolution).alias("cx"), cell_of(F.col("y"), frame.center_y, frame.dim_y, frame.resolution).alias("cy"), "x", "y", "z"
    )
    return p.where(F.col("cx").between(0, frame.dim_x - 1) & F.col("cy").between(0, frame.dim_y - 1))


def bucket_extremes(points: DataFrame, frame: Frame) -> DataFrame:
    """Highest and lowest point of each (cell, first covering slice): partial aggregates before the only shuffle of points."""
    return cells(points, frame).select("cx", "cy", "z", first_slice(F.col("z"), frame).alias("s")).groupBy("cx", "cy", "s").agg(F.max("z").alias("z_max"), F.min("z").alias("z_min"))


def voxels(points: DataFrame, frame: Frame) -> DataFrame:
    """s, cx, cy, g, c for every slice of every cell that has a point.

    Ground is the running maximum over the buckets up to a slice, ceiling the minimum over those above it. Both change
    only where a cell has a bucket, so each bucket is one row with the slices it stands for, opened at the end. Slices
    under a cell's first bucket have no ground.
    """
    b = bucket_extremes(points, frame)
    w = Window.partitionBy("cx", "cy").orderBy("s")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    n = F.lit(frame.n_slice)
    runs = b.select(
        "cx",
        "cy",
        "s",
        F.max("z_max").over(up).alias("g"),
        F.min("z_min").over(down).alias("c"),
        F.coalesce(F.lead("s").over(w), n).alias("end"),
        (F.row_number().over(w) == 1).alias("lowest"),
        F.min("z_min").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("c_under"),
    )
    own = F.when(F.col("s") < F.col("end"), F.struct(F.col("s").alias("a"), (F.col("end") - 1).alias("b"), "g", "c"))
    under = F.when(F.col("lowest") & (F.col("s") > 0), F.struct(F.lit(0).alias("a"), (F.col("s") - 1).alias("b"), F.lit(None).cast("double").alias("g"), F.col("c_under").alias("c")))
    spans = runs.select("cx", "cy", F.explode(F.array_compact(F.array(under, own))).alias("r"))
    return spans.select(F.explode(F.sequence("r.a", "r.b")).alias("s"), "cx", "cy", "r.g", "r.c")


def ground_ceiling(points: DataFrame, frame: Frame) -> DataFrame:
    """Occupied voxels with their clearance (null: open above)."""
    return voxels(points, frame).where("g is not null").select("s", "cx", "cy", "g", "c", (F.col("c") - F.col("g")).alias("clearance"))


def slice_heights(points: DataFrame, frame: Frame) -> DataFrame:
    return points.sparkSession.range(frame.n_slice).select(F.col("id").cast("int").alias("s"), (F.lit(frame.slice_h0) + F.col("id") * F.lit(frame.slice_dh)).alias("height"))


def downsample(points: DataFrame, size: float = 0.1, least: int = 1_000_000) -> DataFrame:
    """One centroid for each voxel of a cloud of more than `least` points; smaller clouds pass unchanged."""
    p = clean(points)
    low = p.agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in "xyz")).first()
    if (low["n"] or 0) <= least:
        return p
    key = [F.floor((F.col(c) - (low[c] - size / 2)) / size).alias(f"v{c}") for c in "xyz"]
    return p.groupBy(*key).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count(F.lit(1)).alias("n_points"))


def tile_count(frame: Frame, budget_gib: float = 10.0, volumes: int = 13, usable: float = 0.95) -> int:
    """How many partitions keep each tile's dense volumes (float32) within a memory budget."""
    cells_at_once = budget_gib * (1 << 30) * usable / (volumes * 4 * frame.n_slice)
    return max(1, math.ceil(frame.dim_x * frame.dim_y / cells_at_once))
