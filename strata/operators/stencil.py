"""Stencils over the cell plane, as scatter and group: a row sends its value to the cells around it, which add up what they get.

One shuffle (with partial aggregates) serves all neighbours at once, and only occupied cells send anything, so empty
space costs nothing. What a missing neighbour means is written out: the ground of an empty cell counts as -1e6.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.config import Frame, Scene

EMPTY_G, EMPTY_C = -1e6, 1e6


def inside(frame: Frame) -> Column:
    return F.col("cx").between(0, frame.dim_x - 1) & F.col("cy").between(0, frame.dim_y - 1)


def scatter(rows: DataFrame, offsets: list[tuple[int, int, int]], values: list[str], key: str = "s") -> DataFrame:
    """Each row once for each (dx, dy, tag), moved there; `tag` tells which."""
    moves = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(t).alias("tag")) for x, y, t in offsets))).alias("o")
    return rows.select(key, "cx", "cy", *values, moves).select(key, (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), F.col("o.tag").alias("tag"), *values)


def _cross(rows: DataFrame, value: str, frame: Frame, more: tuple[str, ...] = (), key: str = "s") -> DataFrame:
    """For every cell with a value or a neighbour that has one: own value and the four around it (x before, x after, y before, y after)."""
    sent = scatter(rows, [(0, 0, 0), (1, 0, 1), (-1, 0, 2), (0, 1, 3), (0, -1, 4)], [value, *more], key).where(inside(frame))
    at = lambda k, c: F.max(F.when(F.col("tag") == k, F.col(c)))
    return sent.groupBy(key, "cx", "cy").agg(at(0, value).alias(value), *(at(0, c).alias(c) for c in more), *(at(k, value).alias(n) for k, n in enumerate(("xa", "xb", "ya", "yb"), 1)))


def gradient(voxels: DataFrame, frame: Frame) -> DataFrame:
    """s, cx, cy, g, c, sq, mx for occupied cells and their neighbours; on the border of the raster both are 0."""
    d = _cross(voxels.where("g is not null"), "g", frame, ("c",))
    z = lambda c: F.coalesce(F.col(c), F.lit(EMPTY_G))
    sq = lambda c: (z("g") - z(c)) * (z("g") - z(c))
    dx, dy = F.greatest(sq("xa"), sq("xb")), F.greatest(sq("ya"), sq("yb"))
    inner = F.col("cx").between(1, frame.dim_x - 2) & F.col("cy").between(1, frame.dim_y - 2)
    return d.select("s", "cx", "cy", "g", "c", F.when(inner, dx + dy).otherwise(0.0).alias("sq"), F.when(inner, F.greatest(dx, dy)).otherwise(0.0).alias("mx"))


def _in_bounds(h: int, frame: Frame) -> Column:
    width = lambda c, n: F.least(F.col(c) + h, F.lit(n - 1)) - F.greatest(F.col(c) - h, F.lit(0)) + 1
    return width("cx", frame.dim_x) * width("cy", frame.dim_y)


def standable(grad: DataFrame, scene: Scene, frame: Frame) -> DataFrame:
    """s, cx, cy, standable: cells of the window that a robot can stand on, empty flat ones among them.

    Counted as cells within the raster less those that aren't standable, so far empty cells need no rows.
    """
    h = scene.half_window
    window = [(x, y, 0) for x in range(-h, h + 1) for y in range(-h, h + 1)]
    steep = scatter(grad.where(F.col("sq") >= scene.stand_sq), window, []).groupBy("s", "cx", "cy").agg(F.count(F.lit(1)).alias("steep"))
    return grad.select("s", "cx", "cy").join(steep, ["s", "cx", "cy"], "left").select("s", "cx", "cy", (_in_bounds(h, frame) - F.coalesce("steep", F.lit(0))).cast("long").alias("standable"))


def traversability(grad: DataFrame, scene: Scene, frame: Frame) -> DataFrame:
    """s, cx, cy, g, c, cost: what clearance, slope and steps cost; the barrier where a robot can't be."""
    counts = standable(grad, scene, frame)
    interval = F.coalesce("c", F.lit(EMPTY_C)) - F.coalesce("g", F.lit(EMPTY_G))
    base = F.greatest(F.lit(0.0), 20 * (F.lit(scene.interval_free) - interval))
    barrier = F.lit(scene.cost_barrier)
    cost = (
        F.when(interval < scene.interval_min, barrier)
        .when(F.col("sq") <= scene.stand_sq, base + 15 * F.col("sq") / scene.stand_sq)
        .when((F.col("mx") <= scene.cross_sq) & (F.col("standable") >= scene.standable_least), base + 20 * F.col("mx") / scene.cross_sq)
        .otherwise(barrier)
    )
    return grad.join(counts, ["s", "cx", "cy"]).select("s", "cx", "cy", "g", "c", cost.alias("cost"))


def inflate(costs: DataFrame, scene: Scene, frame: Frame) -> DataFrame:
    """s, cx, cy, t: the highest cost times score that reaches a cell. Cells that nothing reaches have 0 and no row."""
    moves = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(v).alias("score")) for x, y, v in scene.inflation_offsets()))).alias("o")
    sent = costs.where("cost > 0").select("s", "cx", "cy", "cost", moves)
    sent = sent.select("s", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"), (F.col("cost") * F.col("o.score")).alias("t"))
    return sent.where(inside(frame)).groupBy("s", "cx", "cy").agg(F.max("t").alias("t"))


def voxel_costs(voxels: DataFrame, scene: Scene, frame: Frame) -> DataFrame:
    """s, cx, cy, g, c, t for every slice of every cell that has a point."""
    inflated = inflate(traversability(gradient(voxels, frame), scene, frame), scene, frame)
    return voxels.join(inflated, ["s", "cx", "cy"], "left").select("s", "cx", "cy", "g", "c", F.coalesce("t", F.lit(0.0)).alias("t"))


def cost_gradient(inflated: DataFrame, frame: Frame, key: str = "s") -> DataFrame:
    """key, cx, cy, gx, gy: central differences of the inflated cost, not halved; 0 on the border across it."""
    d = _cross(inflated, "t", frame, key=key)
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    gx = F.when(F.col("cx").between(1, frame.dim_x - 2), v("xb") - v("xa")).otherwise(0.0)
    gy = F.when(F.col("cy").between(1, frame.dim_y - 2), v("yb") - v("ya")).otherwise(0.0)
    return d.select(key, "cx", "cy", gx.alias("gx"), gy.alias("gy"))


def ground_slope(nodes: DataFrame, frame: Frame) -> DataFrame:
    """node_id, layer, row, col, elev_g, slope of active nodes: gradients per layer, one-sided at the edges of the raster; null where a needed neighbour is missing."""
    n = nodes.select("layer", F.col("col").alias("cx"), F.col("row").alias("cy"), F.col("elev_g").cast("double").alias("elev_g"), "node_id")
    d = _cross(n, "elev_g", frame, ("node_id",), "layer").where("node_id is not null")

    def along(axis: str, last: int, before: str, after: str) -> Column:
        mid = F.col("elev_g")
        return F.when(F.col(axis) == 0, F.col(after) - mid).when(F.col(axis) == last, mid - F.col(before)).otherwise((F.col(after) - F.col(before)) / 2)

    gx, gy = along("cx", frame.dim_x - 1, "xa", "xb"), along("cy", frame.dim_y - 1, "ya", "yb")
    slope = F.hypot(gx / frame.resolution, gy / frame.resolution)
    return d.select("node_id", "layer", F.col("cy").alias("row"), F.col("cx").alias("col"), "elev_g", slope.alias("slope"))
