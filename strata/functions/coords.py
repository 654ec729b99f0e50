"""The four coordinate conversions, which differ on purpose, and the predicates and weights shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.config import Frame, Scene


def cell_of(v: Column, center: float, dim: int, resolution: float) -> Column:
    """World to raster cell: half away from zero, whole half of the dimension."""
    return F.round((v - center) / resolution).cast("int") + dim // 2


def world_of(cell: Column, center: float, dim: int, resolution: float) -> Column:
    """Raster cell to world: real half of the dimension, so odd dimensions shift by half a cell."""
    return (cell - dim / 2.0) * resolution + center


def grid_of(v: Column, center: float, dim: int, resolution: float) -> Column:
    """World to planning grid: half to even, not clipped."""
    return F.rint((v - center) / resolution + dim / 2.0).cast("int")


def layer_of(z: Column, heights: list[float]) -> Column:
    """Height to layer: the last slice height that isn't above it, clipped to the table."""
    at = F.size(F.filter(F.array(*(F.lit(h) for h in heights)), lambda h: h <= z)) - 1
    return F.greatest(F.lit(0), at)


def first_slice(z: Column, frame: Frame) -> Column:
    """The first slice that covers a height; n_slice if it lies above them all."""
    s = F.greatest(F.lit(0), F.ceil((z - frame.slice_h0) / frame.slice_dh).cast("int"))
    return F.least(s, F.lit(frame.n_slice))


def node_x(frame: Frame) -> Column:
    return world_of(F.col("col"), frame.center_x, frame.dim_x, frame.resolution)


def node_y(frame: Frame) -> Column:
    return world_of(F.col("row"), frame.center_y, frame.dim_y, frame.resolution)


def traversable(scene: Scene) -> Column:
    return (F.col("trav") <= scene.cost_threshold) | (F.col("gateway") != 0)


def flat_id(frame: Frame) -> Column:
    """One integer for (layer, row, col), in 64 bits so that large maps don't overflow."""
    return (F.col("layer").cast("long") * frame.dim_y + F.col("row")) * frame.dim_x + F.col("col")


def step_length(resolution: float) -> Column:
    """Length in cells of a step from (layer, row, col, elev_g) to (layer2, row2, col2, elev_g2), the height counted in cells."""
    dl, dr, dc = (F.col(f"{n}2") - F.col(n) for n in ("layer", "row", "col"))
    dh = (F.col("elev_g2") - F.col("elev_g")) / resolution
    return F.sqrt(dl * dl + dr * dr + dc * dc + dh * dh)
