"""The three ways through the engine: cloud to filtered map, map to region report, pairs to paths."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import Frame, Scene
from strata.operators import graph, grid, layers, regions, route, stencil
from strata.schema import FORMAT, HEADER
from strata.session import written
from strata.sources.files import nth_pair, waypoint_by_name


@dataclasses.dataclass
class Map:
    """A map with its frame, the kept slices, the layered cells (written) and the node table."""

    scene: Scene
    frame: Frame
    kept: list[int]
    layers: DataFrame
    nodes: DataFrame

    @property
    def heights(self) -> list[float]:
        return [self.frame.slice_h0 + s * self.frame.slice_dh for s in self.kept]

    def header(self) -> DataFrame:
        f = self.frame
        row = (FORMAT, [len(self.kept), f.dim_y, f.dim_x], f.resolution, [f.center_x, f.center_y], f.slice_h0, f.slice_dh, self.heights)
        return self.nodes.sparkSession.createDataFrame([row], HEADER)


def costed(points: DataFrame, scene: Scene) -> tuple[Frame, DataFrame]:
    """The frame, and the inflated costs of all slices, written once: choosing layers and keeping them both read it."""
    frame = grid.frame_of(points, scene)
    return frame, written(stencil.voxel_costs(grid.voxels(points, frame), scene, frame), "costs")


def layered_map(points: DataFrame, scene: Scene) -> Map:
    frame, costs = costed(points, scene)
    kept = layers.kept_layers(costs, scene, frame)
    kept_rows = layers.layered(costs, kept)
    return Map(scene, frame, kept, kept_rows, layers.sparse_nodes(kept_rows, scene))


def node_map(points: DataFrame, scene: Scene) -> Map:
    """The same with the node table written: every later step joins it several times."""
    m = layered_map(points, scene)
    return dataclasses.replace(m, nodes=written(m.nodes, "nodes"))


def filtered_map(points: DataFrame, scene: Scene) -> Map:
    """Only the nodes of the largest component; node ids stay those of the full map."""
    m = node_map(points, scene)
    return dataclasses.replace(m, nodes=written(graph.largest_component(m.nodes, graph.component_labels(m.nodes, scene)), "nodes"))


def flat_regions(m: Map) -> DataFrame:
    flat = regions.flat_cells(m.nodes, m.scene, m.frame)
    return regions.flat_components(flat, m.frame)


def large_regions(m: Map) -> DataFrame:
    """Written: a report has few regions, and both later steps read them more than once."""
    return written(regions.region_stats(flat_regions(m), m.scene, m.frame), "regions")


def region_report(m: Map, source: str = "") -> DataFrame:
    """One row: regions, summary, source and params; without a large region only an empty list, the summary null."""
    cells = written(flat_regions(m), "flat")
    large = written(regions.region_stats(cells, m.scene, m.frame), "regions")
    unique = written(regions.deduplicate(large, m.scene.dedup_iou), "regions")
    merged = regions.merge_by_gap(unique, m.scene.merge_gap)
    listed = merged.agg(F.array_sort(F.collect_list(regions.region_struct())).alias("regions"), F.count(F.lit(1)).alias("output_regions"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = m.nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if((F.col("trav") <= m.scene.cost_threshold) | (F.col("gateway") != 0)).alias("active_nodes"))
    counts = counts.crossJoin(cells.agg(F.count_distinct("component").alias("flat_components"))).crossJoin(n(large, "large_components")).crossJoin(n(unique, "regions_after_dedup"))
    summary = F.struct(
        "total_nodes",
        "active_nodes",
        "flat_components",
        "large_components",
        F.col("large_components").alias("regions_before_dedup"),
        "regions_after_dedup",
        F.col("regions_after_dedup").alias("regions_before_merge"),
        F.col("output_regions").alias("regions_after_merge"),
        "output_regions",
    )
    s = m.scene
    params = {"cost_threshold": s.cost_threshold, "slope_max": s.flat_slope, "min_nodes": float(s.min_nodes), "dedup_iou": s.dedup_iou, "merge_z_gap": s.merge_gap}
    params = F.create_map(*(F.lit(x) for kv in params.items() for x in kv))
    return listed.crossJoin(counts).select("regions", F.when(F.col("large_components") > 0, summary).alias("summary"), F.lit(source).alias("source"), params.alias("params"))


def planned_paths(m: Map, pairs: DataFrame, mode: str = "nearest") -> tuple[DataFrame, DataFrame]:
    """Paths (pair_index, cost, path) and their points."""
    snapped = route.snapped_pairs(pairs, m.nodes, m.scene, m.frame, mode, m.heights)
    paths = written(route.search_paths(snapped, m.nodes, graph.graph_edges(m.nodes, m.scene, m.frame)), "paths")
    return paths, route.path_points(paths, m.nodes, m.scene, m.frame)


def requested_pairs(spark: SparkSession, start=None, goal=None, waypoints: DataFrame | None = None, pairs: DataFrame | None = None, index: int | None = None) -> DataFrame:
    """The pairs of a request: all pairs of a table, the one of an index, or a start and a goal, each a place (x, y, z) or the name of a waypoint."""
    if start is None and goal is None:
        if pairs is None:
            raise ValueError("neither a start and a goal nor pairs")
        return pairs if index is None else nth_pair(pairs, index)
    if start is None or goal is None:
        raise ValueError("a start needs a goal, and a goal a start")

    def place(p) -> tuple[float, float, float]:
        if isinstance(p, str):
            if waypoints is None:
                raise ValueError(f"no waypoints to look up {p!r}")
            return waypoint_by_name(waypoints, p)
        if len(p) != 3:
            raise ValueError(f"a place needs three numbers: {p}")
        return tuple(map(float, p))

    return spark.createDataFrame([(0, *place(start), *place(goal), {})], "pair_index long, sx double, sy double, sz double, gx double, gy double, gz double, extra map<string,string>")


def planned_route(m: Map, waypoints: DataFrame) -> DataFrame:
    """One trajectory through all waypoints in order, or no row if a leg has no path."""
    legs = written(route.waypoint_legs(waypoints).withColumnRenamed("leg", "pair_index"), "legs")
    return route.joined_legs(planned_paths(m, legs)[1], legs.count())


def traversability_report(m: Map, waypoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unordered waypoint pairs without a path, and one row of counts. Reachability is sharing a component, so no path is searched."""
    ends = route.nearest_node(waypoints.select(F.col("pos").alias("query_id"), "x", "y", "z"), m.nodes, m.frame)
    label = ends.join(graph.component_labels(m.nodes, m.scene), "node_id").select(F.col("query_id").alias("pos"), "component")
    pairs = route.waypoint_pairs(waypoints).select("spos", "gpos", "sname", "gname")
    side = lambda p: label.select(*(F.col(c).alias(f"{p}{c}") for c in label.columns))
    marked = pairs.join(side("s"), "spos").join(side("g"), "gpos").withColumn("reachable", F.col("scomponent") == F.col("gcomponent"))
    counts = marked.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("reachable").alias("reachable"), F.count_if(~F.col("reachable")).alias("unreachable"))
    return marked.where("not reachable").select("spos", "gpos", "sname", "gname"), counts
