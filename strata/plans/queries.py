"""One query for each operator over the tables of the driver. Doubles are rounded to nine places, lists joined to text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import graph, grid, layers, regions, route, stencil, views
from strata.plans import pipelines as p
from strata.session import fresh_path
from strata.sources import adapters as a, files, pcd

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to nine places, arrays of numbers to text."""

    def one(name: str, kind: str):
        if kind in ("double", "float"):
            return F.round(F.col(name).cast("double"), 9).alias(name)
        if kind.startswith("array<"):
            return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)
        return F.col(name)

    return df.select(*(one(n, k) for n, k in df.dtypes))


def _frame(spark, sf_dir):
    points = a.points(spark, sf_dir)
    return points, grid.frame_of(points, a.SCENE)


def _voxels(spark, sf_dir):
    points, frame = _frame(spark, sf_dir)
    return grid.voxels(points, frame), frame


def _gradient(spark, sf_dir):
    v, frame = _voxels(spark, sf_dir)
    return stencil.gradient(v, frame), frame


def _layers(spark, sf_dir):
    return p.layered_map(a.points(spark, sf_dir), a.SCENE)


def _nodes(spark, sf_dir):
    return p.node_map(a.points(spark, sf_dir), a.SCENE)


@query
def cloud_header(spark, sf_dir):
    return tidy(grid.header(a.points(spark, sf_dir), a.SCENE))


@query
def cloud_bounds(spark, sf_dir):
    return tidy(grid.bounds(a.points(spark, sf_dir)))


@query
def cloud_cells(spark, sf_dir):
    points, frame = _frame(spark, sf_dir)
    return grid.cells(points, frame).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("points"))


@query
def slice_heights(spark, sf_dir):
    points, frame = _frame(spark, sf_dir)
    return tidy(grid.slice_heights(points, frame))


@query
def voxel_bucket_extremes(spark, sf_dir):
    points, frame = _frame(spark, sf_dir)
    return tidy(grid.bucket_extremes(points, frame))


@query
def voxel_ground_ceiling(spark, sf_dir):
    points, frame = _frame(spark, sf_dir)
    return tidy(grid.ground_ceiling(points, frame))


@query
def voxel_downsample(spark, sf_dir):
    d = grid.downsample(a.points(spark, sf_dir), least=0)
    return tidy(d.select("x", "y", "z", "n_points"))


@query
def gradient(spark, sf_dir):
    g, _ = _gradient(spark, sf_dir)
    flat = lambda c: F.when(F.col(c) > 1e6, -1.0).otherwise(F.col(c)).alias(c)
    return tidy(g.where("g is not null").select("s", "cx", "cy", flat("sq"), flat("mx")))


@query
def standable_count(spark, sf_dir):
    g, frame = _gradient(spark, sf_dir)
    return stencil.standable(g, a.SCENE, frame).join(g.where("g is not null").select("s", "cx", "cy"), ["s", "cx", "cy"])


@query
def traversability_cost(spark, sf_dir):
    g, frame = _gradient(spark, sf_dir)
    return tidy(stencil.traversability(g, a.SCENE, frame).where("g is not null").select("s", "cx", "cy", "cost"))


@query
def inflated_cost(spark, sf_dir):
    v, frame = _voxels(spark, sf_dir)
    return tidy(stencil.voxel_costs(v, a.SCENE, frame).where("g is not null").select("s", "cx", "cy", "t"))


@query
def cost_gradient(spark, sf_dir):
    points = a.points(spark, sf_dir)
    frame, costs = p.costed(points, a.SCENE)
    kept = layers.kept_layers(costs, a.SCENE, frame)
    v = grid.voxels(points, frame)
    inflated = stencil.inflate(stencil.traversability(stencil.gradient(v, frame), a.SCENE, frame), a.SCENE, frame)
    out = stencil.cost_gradient(inflated.where(F.col("s").isin(kept)), frame)
    cells = costs.where(F.col("g").isNotNull() & F.col("s").isin(kept)).select("s", "cx", "cy").join(out, ["s", "cx", "cy"], "left")
    return tidy(cells.select("s", "cx", "cy", F.coalesce("gx", F.lit(0.0)).alias("gx"), F.coalesce("gy", F.lit(0.0)).alias("gy")))


@query
def layer_next(spark, sf_dir):
    frame, costs = p.costed(a.points(spark, sf_dir), a.SCENE)
    return layers.next_layers(costs, a.SCENE, frame)


@query
def layer_keep(spark, sf_dir):
    m = _layers(spark, sf_dir)
    return spark.createDataFrame([(i, s) for i, s in enumerate(m.kept)], "layer int, s int")


@query
def gateways(spark, sf_dir):
    return layers.gateways(_layers(spark, sf_dir).layers, a.SCENE).where("gateway <> 0").select("layer", "cx", "cy", "gateway")


@query
def sparse_nodes(spark, sf_dir):
    return tidy(_layers(spark, sf_dir).nodes)


@query
def map_stats(spark, sf_dir):
    m = _layers(spark, sf_dir)
    return tidy(layers.map_stats(m.layers, m.nodes, m.frame, len(m.kept)))


@query
def visible_surface(spark, sf_dir):
    m = _layers(spark, sf_dir)
    return tidy(views.surface_cloud(layers.visible_surface(m.layers, a.SCENE), m.frame))


@query
def same_layer_edges(spark, sf_dir):
    return graph.same_layer_edges(_nodes(spark, sf_dir).nodes, a.SCENE)


@query
def cross_layer_edges(spark, sf_dir):
    return graph.cross_layer_edges(_nodes(spark, sf_dir).nodes, a.SCENE)


@query
def graph_edges(spark, sf_dir):
    m = _nodes(spark, sf_dir)
    return tidy(graph.graph_edges(m.nodes, a.SCENE, m.frame))


@query
def edge_direction_counts(spark, sf_dir):
    return graph.edge_direction_counts(_nodes(spark, sf_dir).nodes, a.SCENE)


@query
def component_labels(spark, sf_dir):
    return graph.component_labels(_nodes(spark, sf_dir).nodes, a.SCENE)


@query
def component_sizes(spark, sf_dir):
    return graph.component_sizes(graph.component_labels(_nodes(spark, sf_dir).nodes, a.SCENE))


@query
def largest_component(spark, sf_dir):
    return tidy(p.filtered_map(a.points(spark, sf_dir), a.SCENE).nodes)


@query
def removed_nodes(spark, sf_dir):
    m = _nodes(spark, sf_dir)
    kept = graph.largest_component(m.nodes, graph.component_labels(m.nodes, a.SCENE))
    return graph.removed_nodes(m.nodes, kept).select("node_id")


@query
def map_provenance(spark, sf_dir):
    m = _nodes(spark, sf_dir)
    return tidy(graph.provenance(m.nodes, graph.component_labels(m.nodes, a.SCENE), a.SCENE, "adapter"))


@query
def ground_slope(spark, sf_dir):
    m = _nodes(spark, sf_dir)
    return tidy(stencil.ground_slope(graph.active(m.nodes, a.SCENE), m.frame).select("node_id", "slope"))


@query
def flat_cells(spark, sf_dir):
    m = _nodes(spark, sf_dir)
    return regions.flat_cells(m.nodes, a.SCENE, m.frame).select("node_id")


@query
def flat_components(spark, sf_dir):
    return p.flat_regions(_nodes(spark, sf_dir)).select("node_id", "component")


@query
def region_stats(spark, sf_dir):
    return tidy(p.large_regions(_nodes(spark, sf_dir)))


@query
def region_iou_pairs(spark, sf_dir):
    return tidy(regions.iou_pairs(p.large_regions(_nodes(spark, sf_dir))))


@query
def region_dedup(spark, sf_dir):
    return tidy(regions.deduplicate(p.large_regions(_nodes(spark, sf_dir))))


@query
def region_zmerge(spark, sf_dir):
    return tidy(regions.merge_by_gap(p.large_regions(_nodes(spark, sf_dir))))


@query
def region_report(spark, sf_dir):
    r = p.region_report(_nodes(spark, sf_dir), "adapter")
    return r.select(F.to_json(F.struct("regions", "summary", "source", "params")).alias("json"))


@query
def regions_json(spark, sf_dir):
    return regions.region_json(p.large_regions(_nodes(spark, sf_dir)))


@query
def bbox_wireframe(spark, sf_dir):
    return tidy(views.bbox_wireframe(p.large_regions(_nodes(spark, sf_dir))))


@query
def region_labels(spark, sf_dir):
    return tidy(views.region_labels(p.large_regions(_nodes(spark, sf_dir))))


@query
def region_centers(spark, sf_dir):
    return tidy(views.region_centers(p.large_regions(_nodes(spark, sf_dir))))


@query
def nearest_node(spark, sf_dir):
    m = _nodes(spark, sf_dir)
    w = a.waypoints(spark, sf_dir).select(F.col("pos").alias("query_id"), "x", "y", "z")
    return tidy(route.nearest_node(w, m.nodes, m.frame))


@query
def world_to_grid(spark, sf_dir):
    m = _layers(spark, sf_dir)
    return route.to_grid(a.waypoints(spark, sf_dir).select(F.col("pos").alias("query_id"), "x", "y", "z"), m.frame, m.heights)


@query
def ring_snap(spark, sf_dir):
    m = _nodes(spark, sf_dir)
    cells = route.to_grid(a.waypoints(spark, sf_dir).select(F.col("pos").alias("query_id"), "x", "y", "z"), m.frame, m.heights)
    return tidy(route.ring_snap(cells, m.nodes, a.SCENE))


@query
def snapped_pairs(spark, sf_dir):
    m = _nodes(spark, sf_dir)
    return route.snapped_pairs(a.pairs(spark, sf_dir), m.nodes, a.SCENE, m.frame)


@query
def path_costs(spark, sf_dir):
    paths, _ = p.planned_paths(_nodes(spark, sf_dir), a.pairs(spark, sf_dir))
    return tidy(paths.select("pair_index", "cost"))


@query
def path_points(spark, sf_dir):
    return tidy(p.planned_paths(_nodes(spark, sf_dir), a.pairs(spark, sf_dir))[1])


@query
def path_lengths(spark, sf_dir):
    return tidy(route.path_lengths(p.planned_paths(_nodes(spark, sf_dir), a.pairs(spark, sf_dir))[1], "pair_index", ["seq"]))


@query
def failed_pairs(spark, sf_dir):
    pairs = a.pairs(spark, sf_dir)
    return route.unreachable(pairs, p.planned_paths(_nodes(spark, sf_dir), pairs)[0]).select("pair_index")


@query
def batch_success(spark, sf_dir):
    pairs = a.pairs(spark, sf_dir)
    paths, _ = p.planned_paths(_nodes(spark, sf_dir), pairs)
    return pairs.join(paths.select("pair_index", F.lit(1).alias("ok")), "pair_index", "left").agg(F.count(F.lit(1)).alias("pairs"), F.count("ok").alias("planned"))


@query
def trajectory_json(spark, sf_dir):
    pairs = a.pairs(spark, sf_dir)
    return route.trajectory_records(pairs, p.planned_paths(_nodes(spark, sf_dir), pairs)[1])


@query
def event_path_lengths(spark, sf_dir):
    return tidy(route.path_lengths(a.paths(spark, sf_dir), "path_id", ["at", "seq"]))


@query
def waypoint_pairs(spark, sf_dir):
    return route.waypoint_pairs(tidy(a.waypoints(spark, sf_dir)))  # rounded once a place, not once a pair


@query
def unreachable_pairs(spark, sf_dir):
    return p.traversability_report(_nodes(spark, sf_dir), a.waypoints(spark, sf_dir))[0]


@query
def reachability_counts(spark, sf_dir):
    return p.traversability_report(_nodes(spark, sf_dir), a.waypoints(spark, sf_dir))[1]


@query
def waypoint_legs(spark, sf_dir):
    return tidy(route.waypoint_legs(a.waypoints(spark, sf_dir)))


@query
def waypoint_markers(spark, sf_dir):
    return tidy(views.waypoint_markers(a.waypoints(spark, sf_dir)))


@query
def sparse_cloud_view(spark, sf_dir):
    m = _layers(spark, sf_dir)
    return tidy(views.sparse_cloud(m.nodes, m.frame))


@query
def raw_cloud_view(spark, sf_dir):
    return tidy(views.raw_cloud(a.points(spark, sf_dir)))


@query
def snapped_pairs_grid(spark, sf_dir):
    m = _nodes(spark, sf_dir)
    return route.snapped_pairs(a.pairs(spark, sf_dir), m.nodes, a.SCENE, m.frame, "grid", m.heights)


@query
def path_ends(spark, sf_dir):
    paths, _ = p.planned_paths(_nodes(spark, sf_dir), a.pairs(spark, sf_dir))
    return paths.select("pair_index", F.element_at("path", 1).alias("start_id"), F.element_at("path", -1).alias("goal_id"))


@query
def planned_legs(spark, sf_dir):
    """Which legs of the route through all waypoints have a path."""
    legs = route.waypoint_legs(a.waypoints(spark, sf_dir)).withColumnRenamed("leg", "pair_index")
    paths, _ = p.planned_paths(_nodes(spark, sf_dir), legs)
    return legs.join(paths.select("pair_index", F.lit(True).alias("ok")), "pair_index", "left").select(F.col("pair_index").alias("leg"), F.coalesce("ok", F.lit(False)).alias("planned"))


@query
def planned_route(spark, sf_dir):
    return tidy(p.planned_route(_nodes(spark, sf_dir), a.waypoints(spark, sf_dir)))


@query
def visited_nodes(spark, sf_dir):
    """How many nodes the search for each leg settles; no more than the component has, and no fewer than the path."""
    m = _nodes(spark, sf_dir)
    legs = route.waypoint_legs(a.waypoints(spark, sf_dir)).withColumnRenamed("leg", "pair_index")
    snapped = route.snapped_pairs(legs, m.nodes, m.scene, m.frame)
    return route.visited_nodes(snapped, m.nodes, graph.graph_edges(m.nodes, m.scene, m.frame)).groupBy("pair_index").agg(F.count(F.lit(1)).alias("settled"))


@query
def region_summary(spark, sf_dir):
    r = p.region_report(_nodes(spark, sf_dir), "adapter")
    return r.select("summary.*")


@query
def cloud_file(spark, sf_dir):
    path = fresh_path(spark, "cloud")
    pcd.write_pcd(a.points(spark, sf_dir), path)
    return tidy(pcd.read_pcd(spark, f"{path}/part-*"))


@query
def map_file(spark, sf_dir):
    m, path = _nodes(spark, sf_dir), fresh_path(spark, "map")
    files.write_map(m.header(), m.nodes, path)
    return tidy(files.read_map(spark, path)[1])


@query
def map_header_file(spark, sf_dir):
    m, path = _nodes(spark, sf_dir), fresh_path(spark, "map")
    files.write_map(m.header(), m.nodes, path)
    header = files.read_map(spark, path)[0]
    return header.select("format", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"), "resolution", "slice_h0", "slice_dh", F.size("slice_heights").alias("layers"))


@query
def dense_file(spark, sf_dir):
    path = fresh_path(spark, "dense")
    _, costs = p.costed(a.points(spark, sf_dir), a.SCENE)
    channels = F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), F.col(v).alias("value")) for k, v in ((0, "t"), (3, "g"), (4, "c"))))).alias("v")
    costs.select("s", "cx", "cy", channels).select("v.channel", "s", "cy", "cx", "v.value").write.parquet(path)
    return tidy(files.read_dense(spark, path))


def _one_document(rows: DataFrame, order: str, *record) -> DataFrame:
    """A JSON list of all rows, as such files are: of waypoints, legs or regions, not of anything that grows with a cloud."""
    return rows.agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*record).alias("r")))).alias("all")).select(F.to_json(F.transform("all", lambda x: x["r"])).alias("json"))


@query
def waypoints_file(spark, sf_dir):
    path = fresh_path(spark, "waypoints")
    files.write_json_lines(_one_document(a.waypoints(spark, sf_dir), "pos", "name", F.array("x", "y", "z").alias("pose"), "radius"), path)
    return tidy(files.read_waypoints(spark, path))


@query
def pairs_file(spark, sf_dir):
    path = fresh_path(spark, "pairs")
    legs = route.waypoint_legs(a.waypoints(spark, sf_dir))
    files.write_json_lines(_one_document(legs, "leg", F.array("sx", "sy", "sz").alias("start"), F.array("gx", "gy", "gz").alias("goal"), F.col("from_pos").alias("task")), path)
    back = files.read_pairs(spark, path)
    return tidy(back.withColumn("task", F.col("extra")["task"].cast("long")).drop("extra"))


@query
def path_file(spark, sf_dir):
    path = fresh_path(spark, "path") + ".csv"
    files.write_path(a.waypoints(spark, sf_dir).withColumnRenamed("pos", "seq"), path)
    return tidy(files.read_path(spark, path))


@query
def regions_file(spark, sf_dir):
    path = fresh_path(spark, "regions")
    large = p.large_regions(_nodes(spark, sf_dir))
    listed = large.agg(F.array_sort(F.collect_list(regions.region_struct())).alias("regions"))
    files.write_json_lines(listed.select(F.to_json(F.struct("regions")).alias("json")), path)
    r = files.read_regions(spark, path).select(F.explode("regions").alias("r")).select("r.*")
    flat = r.select("id", "component_id", "node_count", "height_mean", "height_min", "height_max", "bbox.*", F.col("center.x").alias("center_x"), F.col("center.y").alias("center_y"), F.col("center.z").alias("center_z"), "slices")
    return tidy(flat)
