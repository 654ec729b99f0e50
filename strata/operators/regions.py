"""Flat regions: labelling, statistics, greedy removal of overlaps, merging by height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.config import Frame, Scene
from strata.functions.coords import flat_id, node_x, node_y
from strata.operators.graph import active
from strata.operators.graph_core import LOCAL_EDGES, connected_components
from strata.operators.stencil import ground_slope
from strata.session import written

STRETCH = 64

BOX = ("min_x", "max_x", "min_y", "max_y", "min_z", "max_z")


def flat_cells(nodes: DataFrame, scene: Scene, frame: Frame) -> DataFrame:
    """node_id, layer, row, col, elev_g, slope of active nodes on gentle ground; unknown slope counts as steep."""
    return ground_slope(active(nodes, scene), frame).where(F.col("slope") <= scene.flat_slope)


def flat_components(flat: DataFrame, frame: Frame) -> DataFrame:
    """The flat cells with component: 8-connected within a layer, numbered from 0 by layer and first cell in scan order.

    Cells side by side in a row are one run, told by its least node. Runs of neighbouring rows that touch are linked, and
    meet in stretches of STRETCH columns; so the graph has as many edges as runs touch, not as cells do.
    """
    gap = F.col("col") - F.row_number().over(Window.partitionBy("layer", "row").orderBy("col"))
    cells = flat.withColumn("gap", gap).withColumn("run", F.min("node_id").over(Window.partitionBy("layer", "row", "gap"))).drop("gap")
    cells = written(cells, "runs")
    runs = cells.groupBy("layer", "row", "run").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    stretch = lambda low, high: F.explode(F.sequence(F.floor(low / STRETCH), F.floor(high / STRETCH))).alias("stretch")
    upper = runs.select("layer", "row", F.col("run").alias("dst"), F.col("a").alias("a2"), F.col("b").alias("b2"), stretch(F.col("a"), F.col("b")))
    lower = runs.select("layer", (F.col("row") + 1).alias("row"), F.col("run").alias("src"), "a", "b", stretch(F.col("a") - 1, F.col("b") + 1))
    links = lower.join(upper, ["layer", "row", "stretch"]).where("a - 1 <= b2 and b + 1 >= a2").select("src", "dst")
    label = connected_components(links, local_limit=LOCAL_EDGES).withColumnRenamed("node", "run")
    labelled = cells.join(label, "run", "left").withColumn("root", F.coalesce("component", "run")).drop("component", "run")
    firsts = labelled.groupBy("layer", "root").agg(F.min(flat_id(frame)).alias("first"))
    # numbered within each layer, and layers one after another: no task sees more than a layer's components
    in_layer = F.row_number().over(Window.partitionBy("layer").orderBy("first")) - 1
    sizes = firsts.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("layer", (F.sum("n").over(Window.orderBy("layer")) - F.col("n")).alias("before"))
    ids = firsts.withColumn("k", in_layer).join(before, "layer").select("root", (F.col("before") + F.col("k")).cast("int").alias("component"))
    return labelled.join(ids, "root").drop("root")


def region_stats(components: DataFrame, scene: Scene, frame: Frame) -> DataFrame:
    """One row for each component of at least min_nodes cells: counts, heights, box, centre, size, slices; id in order of the component."""
    c = components.select("component", "layer", node_x(frame).alias("x"), node_y(frame).alias("y"), F.col("elev_g").alias("z"))
    r = c.groupBy("component").agg(
        F.count(F.lit(1)).alias("node_count"),
        *(f(v).alias(f"{n}_{v}") for v in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))),
        *(F.avg(v).alias(f"center_{v}") for v in "xyz"),
        F.sort_array(F.collect_set("layer")).alias("slices"),
    )
    r = r.where(F.col("node_count") >= scene.min_nodes)
    cell = F.lit(frame.resolution)
    return r.select(
        (F.row_number().over(Window.orderBy("component")) - 1).alias("id"),  # regions are few: large components of one map
        F.array("component").alias("component_id"),
        "node_count",
        F.col("center_z").alias("height_mean"),
        *BOX,
        "center_x",
        "center_y",
        "center_z",
        (F.col("max_x") - F.col("min_x") + cell).alias("size_x"),
        (F.col("max_y") - F.col("min_y") + cell).alias("size_y"),
        (F.col("max_z") - F.col("min_z")).alias("size_z"),
        "slices",
    )


def iou(a: Column, b: Column) -> Column:
    """Shared volume of two boxes by their joint volume; boxes that only touch, or are flat, share none."""
    side = lambda v: F.greatest(F.lit(0.0), F.least(a[f"max_{v}"], b[f"max_{v}"]) - F.greatest(a[f"min_{v}"], b[f"min_{v}"]))
    volume = lambda r: (r["max_x"] - r["min_x"]) * (r["max_y"] - r["min_y"]) * (r["max_z"] - r["min_z"])
    shared = side("x") * side("y") * side("z")
    return F.when(shared > 0, shared / (volume(a) + volume(b) - shared)).otherwise(0.0)


def iou_pairs(regions: DataFrame) -> DataFrame:
    """a, b, iou of regions whose boxes overlap.

    Boxes are dealt into the cells of a ground grid as wide as a box is in the mean, and meet in cells; of the cells that
    two boxes share, the first one counts. Only the two mean widths come to the driver.
    """
    widths = regions.agg(*(F.avg(F.col(f"max_{v}") - F.col(f"min_{v}")).alias(v) for v in "xy")).first()
    cell = lambda v, end: F.floor(F.col(f"{end}_{v}") / max(widths[v] or 0.0, 1e-3))
    dealt = regions.select("id", F.struct(*BOX).alias("box"), cell("x", "min").alias("x0"), cell("y", "min").alias("y0"), F.explode(F.sequence(cell("x", "min"), cell("x", "max"))).alias("cx"), cell("y", "max").alias("y1"))
    dealt = dealt.select("id", "box", "x0", "y0", "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    side = lambda n: dealt.select("cx", "cy", *(F.col(c).alias(f"{n}_{c}") for c in ("id", "box", "x0", "y0")))
    met = side("p").join(side("q"), ["cx", "cy"]).where((F.col("p_id") < F.col("q_id")) & (F.col("cx") == F.greatest("p_x0", "q_x0")) & (F.col("cy") == F.greatest("p_y0", "q_y0")))
    return met.select(F.col("p_id").alias("a"), F.col("q_id").alias("b"), iou(F.col("p_box"), F.col("q_box")).alias("iou")).where("iou > 0")


def deduplicate(regions: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Regions by falling node count, without those that overlap a kept one by more than the threshold; ids anew in that order.

    The greedy choice is sequential, but only among regions that overlap: it runs for each component of the graph of
    overlaps as one aggregate over its sorted regions. Regions without an overlap stay.
    """
    if threshold < 0:
        return regions
    columns = regions.columns
    overlaps = iou_pairs(regions).where(F.col("iou") > threshold)
    groups = connected_components(overlaps, "a", "b", local_limit=LOCAL_EDGES).select(F.col("node").alias("id"), "component")
    marked = regions.join(groups, "id", "left")
    row = F.struct((-F.col("node_count")).alias("_key"), F.col("id").alias("_id"), *columns)
    ordered = marked.where("component is not null").groupBy("component").agg(F.array_sort(F.collect_list(row)).alias("all"))
    empty = F.filter("all", lambda r: F.lit(False))
    kept = F.aggregate("all", empty, lambda acc, r: F.when(F.exists(acc, lambda k: iou(k, r) > threshold), acc).otherwise(F.concat(acc, F.array(r))))
    chosen = ordered.select(F.explode(kept).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in columns))
    out = marked.where("component is null").select(columns).unionByName(chosen)
    order = Window.orderBy(F.desc("node_count"), "id")  # what is left of the large components of one map: few
    return out.select((F.row_number().over(order) - 1).alias("id"), *(c for c in columns if c != "id"))


def merge_by_gap(regions: DataFrame, gap: float = 0.5) -> DataFrame:
    """Regions merged where their height intervals lie less than the gap apart, whatever their place; a chain merges as one.

    Along the height axis that is gaps and islands: an interval opens a new island if it begins at least the gap above
    the highest end before it. Islands keep the order of their first region.
    """
    columns = regions.columns
    if gap <= 0:
        return regions
    before = Window.orderBy("min_z", "max_z", "id").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("min_z") - F.max("max_z").over(before) >= gap).cast("int"), F.lit(1))
    island = F.sum("opens").over(Window.orderBy("min_z", "max_z", "id").rowsBetween(Window.unboundedPreceding, 0))
    marked = regions.withColumn("opens", opens).withColumn("island", island)
    weighted = lambda c: F.sum(F.col(c) * F.col("node_count")) / F.sum("node_count")
    one = F.count(F.lit(1)) == 1
    members = F.array_sort(F.collect_list(F.struct("id", "component_id")))
    extent = lambda v: F.when(one, F.max(f"size_{v}")).otherwise(F.max(f"max_{v}") - F.min(f"min_{v}"))
    m = marked.groupBy("island").agg(
        F.min("id").alias("_first"),
        F.flatten(F.transform(members, lambda x: x["component_id"])).alias("component_id"),
        F.sum("node_count").alias("node_count"),
        F.when(one, F.max("height_mean")).otherwise(weighted("center_z")).alias("height_mean"),
        *(F.min(c).alias(c) if c.startswith("min") else F.max(c).alias(c) for c in BOX),
        *(F.when(one, F.max(f"center_{v}")).otherwise(weighted(f"center_{v}")).alias(f"center_{v}") for v in "xyz"),
        *(extent(v).alias(f"size_{v}") for v in "xyz"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("slices")))).alias("slices"),
    )
    return m.withColumn("id", F.row_number().over(Window.orderBy("_first")) - 1).select(*columns)


def region_struct() -> Column:
    """A row of regions as the nested record of the report."""
    return F.struct(
        F.col("id").cast("int").alias("id"),
        "component_id",
        "node_count",
        "height_mean",
        F.col("min_z").alias("height_min"),
        F.col("max_z").alias("height_max"),
        (F.col("max_z") - F.col("min_z")).alias("height_range"),
        F.struct(*BOX).alias("bbox"),
        F.struct(*(F.col(f"center_{v}").alias(v) for v in "xyz")).alias("center"),
        F.struct(*(F.col(f"size_{v}").alias(v) for v in "xyz")).alias("size"),
        "slices",
    )


def region_json(regions: DataFrame) -> DataFrame:
    """id, json: one record for each region; a component_id of one number is written as that number."""
    as_text = F.to_json(region_struct())
    return regions.select(F.col("id").cast("int").alias("id"), F.regexp_replace(as_text, r'"component_id":\[(\d+)\]', r'"component_id":$1').alias("json"))
