"""Micro grids with values worked out by hand, invariants, and properties against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from strata.config import Frame, Scene
from strata.functions import coords
from strata.operators import graph, grid, layers, regions, route, stencil, views
from strata.operators.graph_core import connected_components
from strata.plans import pipelines
from strata.schema import MapFormatError
from strata.sources import files, pcd

SCENE = Scene(min_nodes=1)


def frame(x=5, y=5, s=1):
    return Frame(0.0, 0.0, x, y, s, -0.5, 0.5, 0.1)


def test_derived_constants():
    assert (SCENE.half_window, SCENE.half_inflation, SCENE.standable_least) == (2, 2, 9)
    base = Scene(kernel_size=7, slope_max=0.36, step_max=0.2, standable_ratio=0.2, safe_margin=0.4, inflation=0.2)
    assert (base.half_window, base.half_inflation, base.standable_least) == (3, 6, 8)
    scores = {(dx, dy): v for dx, dy, v in SCENE.inflation_offsets()}
    assert scores[0, 0] == scores[1, 1] == 1
    assert math.isclose(scores[2, 0], 0.8) and math.isclose(scores[2, 1], 0.7055728, rel_tol=1e-6) and math.isclose(scores[2, 2], 0.4686292, rel_tol=1e-6)


def test_conversions_round_differently(spark):
    f = frame(4, 4)
    d = spark.createDataFrame([(0.05,), (0.15,), (-0.05,)], "v double")
    row = d.select(coords.cell_of(F.col("v") * 10, 0.0, 4, 1.0).alias("a"), coords.grid_of(F.col("v") * 10, 0.0, 4, 1.0).alias("b")).collect()
    assert [tuple(r) for r in row] == [(3, 2), (4, 4), (1, 2)]
    assert spark.range(1).select(coords.layer_of(F.lit(-9.0), [0.0, 1.0])).first()[0] == 0
    assert spark.range(1).select(coords.layer_of(F.lit(1.0), [0.0, 1.0])).first()[0] == 1
    assert f.heights() == [-0.5]


def test_ground_and_ceiling_match_a_loop(spark):
    r = random.Random(5)
    pts = [(r.randint(-2, 1) * 0.1, r.randint(-2, 1) * 0.1, r.uniform(-1.4, 3.4)) for _ in range(400)] + [(0.0, 0.0, 9.0), (0.0, 0.0, -8.0)]
    f = frame(6, 6, 6)
    got = {(v.s, v.cx, v.cy): (v.g, v.c) for v in grid.voxels(spark.createDataFrame(pts, "x double, y double, z double"), f).collect()}
    cells = {}
    for x, y, z in pts:
        cells.setdefault((round(x * 10) + 3, round(y * 10) + 3), []).append(z)
    assert len(got) == 6 * len(cells)
    for (cx, cy), zs in cells.items():
        for s, h in enumerate(f.heights()):
            assert got[s, cx, cy] == (max((z for z in zs if z <= h), default=None), min((z for z in zs if z > h), default=None))


def test_bad_points_drop(spark):
    d = spark.createDataFrame([(0.0, 0.0, 1.0), (float("nan"), 0.0, 1.0), (0.0, None, 1.0)], "x double, y double, z double")
    assert grid.clean(d).count() == 1
    with pytest.raises(ValueError, match="no point"):
        grid.frame_of(d.where("z > 5"), SCENE)


def flat(spark, skip=(), bump=()):
    rows = [(0, x, y, 0.3 if (x, y) in bump else 0.0, None) for x in range(7) for y in range(7) if (x, y) not in skip]
    return spark.createDataFrame(rows, "s int, cx int, cy int, g double, c double")


def test_missing_cell_bars_itself_and_its_neighbours(spark):
    f = frame(7, 7)
    g = stencil.gradient(flat(spark, skip={(3, 3)}), f)
    cost = {(r.cx, r.cy): r.cost for r in stencil.traversability(g, SCENE, f).collect()}
    assert {k for k, v in cost.items() if v == 50} == {(3, 3), (2, 3), (4, 3), (3, 2), (3, 4)}
    assert cost[0, 0] == 0
    reach = {(r.cx, r.cy): r.t for r in stencil.inflate(stencil.traversability(g, SCENE, f), SCENE, f).collect()}
    assert reach[3, 3] == 50 and math.isclose(reach[3, 6], 40) and (0, 0) not in reach


def test_step_costs_by_its_height(spark):
    f = frame(7, 7)
    cost = {(r.cx, r.cy): r.cost for r in stencil.traversability(stencil.gradient(flat(spark, bump={(3, 3)}), f), SCENE, f).collect()}
    assert math.isclose(cost[3, 3], 20 * 0.09 / 0.25) and math.isclose(cost[2, 3], 20 * 0.09 / 0.25) and cost[1, 1] == 0


@pytest.mark.parametrize(("n", "kept"), [(1, [0]), (2, [0, 1]), (3, [0, 1])])
def test_few_slices(spark, n, kept):
    rows = [(s, 0, 0, float(s), None, 0.0) for s in range(n)]
    costs = spark.createDataFrame(rows, "s int, cx int, cy int, g double, c double, t double")
    assert layers.kept_layers(costs, SCENE, frame(s=n)) == kept


def test_gateways(spark):
    rows = [(k, i, cx, 0, g, None, t) for cx, column in enumerate(([(0.0, 9.0), (0.05, 0.0)], [(0.0, 0.0), (0.05, 9.0)], [(0.0, 9.0), (0.1, 0.0)], [(0.0, 9.0), (0.0, 0.0), (0.0, 9.0)])) for i, (g, t) in enumerate(column) for k in [i]]
    d = spark.createDataFrame(rows, "layer int, s int, cx int, cy int, g double, c double, t double")
    got = {(r.cx, r.layer): r.gateway for r in layers.gateways(d, SCENE).collect()}
    assert got == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): -2, (2, 0): 0, (2, 1): 0, (3, 0): 2, (3, 1): 0, (3, 2): -2}


def nodes(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node_id long, layer int, row int, col int, trav double, elev_g double, elev_c double, gateway int")


def test_cross_layer_edge_breaks_ties_by_row_and_column(spark):
    n = nodes(spark, [(0, 5, 5, 0.0, 0.0, None, 2), (1, 4, 5, 1.0, 0.0, None, 0), (1, 5, 4, 1.0, 0.0, None, 0), (1, 6, 6, 0.0, 0.0, None, 0)])
    assert [tuple(r) for r in graph.cross_layer_edges(n, SCENE).collect()] == [(0, 1)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_components_of_a_long_path(spark, limit):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(1000, 2000), (5, 5)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges, local_limit=limit).collect()}
    assert got == {**dict.fromkeys(range(1, 301), 1), 1000: 1000, 2000: 1000}


def test_components_match_union_find(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)]
    parent = list(range(201))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: root(n) for e in edges for n in e if e[0] != e[1]} | {n: c for n, c in got.items() if c == root(n)}


def test_empty_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert connected_components(none).count() == connected_components(none, local_limit=9).count() == 0


def box(i, n, x0, x1, z0, z1):
    row = {"id": i, "component_id": [i], "node_count": n, "height_mean": (z0 + z1) / 2, "slices": [0]}
    row |= {"min_x": x0, "max_x": x1, "min_y": 0.0, "max_y": 1.0, "min_z": z0, "max_z": z1}
    return row | {f"{k}_{v}": 1.0 for k in ("center", "size") for v in "xyz"}


def test_overlaps_go_greedily(spark):
    d = spark.createDataFrame([box(0, 5, 0.0, 2.0, 0.0, 1.0), box(1, 9, 1.0, 3.0, 0.0, 1.0), box(2, 5, 3.0, 4.0, 0.0, 1.0), box(3, 7, 1.0, 3.0, 0.5, 0.5)])
    got = regions.deduplicate(d).orderBy("id").select("id", F.col("component_id")[0]).collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 3), (2, 2)]
    assert regions.deduplicate(d, -1).count() == 4
    assert [(r.a, r.b) for r in regions.iou_pairs(d).collect()] == [(0, 1)]


def test_merging_by_gap_matches_union_find(spark):
    r = random.Random(9)
    rows = []
    for i in range(12):
        z = r.choice([0.0, 1.0, 2.0, 2.5, 4.0, 6.0])
        rows.append(box(i, r.randint(1, 9), 0.0, 1.0, z, z + r.choice([0.0, 0.3, 0.5])))
    parent = list(range(12))
    for i in range(12):
        for j in range(12):
            if max(rows[i]["min_z"], rows[j]["min_z"]) - min(rows[i]["max_z"], rows[j]["max_z"]) < 0.5:
                old, new = parent[j], parent[i]
                parent = [new if p == old else p for p in parent]
    groups = sorted(sorted(i for i in range(12) if parent[i] == p) for p in set(parent))
    got = regions.merge_by_gap(spark.createDataFrame(rows), 0.5).orderBy("id").collect()
    assert [sorted(g.component_id) for g in got] == groups
    assert regions.merge_by_gap(spark.createDataFrame(rows), 0.0).count() == 12


def test_ring_snap_stops_at_the_first_ring(spark):
    n = nodes(spark, [(0, 1, 1, 30.0, 0.0, None, 0), (0, 0, 2, 0.0, 0.0, None, 0), (0, 0, 1, 40.0, 0.0, None, 0)])
    q = spark.createDataFrame([(7, 0, 0, 0), (8, 1, 0, 0)], "query_id long, layer int, row int, col int")
    assert [(r.query_id, r.node_id, round(r.dist, 6)) for r in route.ring_snap(q, n, SCENE).collect()] == [(7, 0, round(math.sqrt(2), 6))]


def test_nearest_node_equals_all_pairs(spark):
    r = random.Random(4)
    f = frame(40, 40)
    n = nodes(spark, [(r.randint(0, 2), r.randint(0, 39), r.randint(0, 39), 0.0, r.choice([0.0, 0.4, 3.0]), None, 0) for _ in range(150)])
    places = [(i, r.uniform(-2, 2), r.uniform(-2, 2), r.choice([0.0, 1.5, 3.0])) for i in range(80)] + [(80, 90.0, -70.0, 5.0), (81, 0.0, 0.0, 0.0), (82, 0.0, 0.0, 0.0)]
    got = {x.query_id: (x.node_id, round(x.dist, 6)) for x in route.nearest_node(spark.createDataFrame([*places, (99, None, 0.0, 0.0)], "query_id long, x double, y double, z double"), n, f).collect()}
    at = [(x.node_id, *f_xy, x.elev_g) for x in n.collect() for f_xy in [((x.col - 20.0) * 0.1, (x.row - 20.0) * 0.1)]]
    for i, x, y, z in places:
        d, k = min((round((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2, 9), k) for k, a, b, c in at)
        assert got[i] == (k, round(math.sqrt(d), 6))
    assert 99 not in got and route.nearest_node(spark.createDataFrame(places, "query_id long, x double, y double, z double"), n.limit(0), f).count() == 0


def test_ring_snap_equals_all_pairs(spark):
    r = random.Random(6)
    rows = [(r.randint(0, 1), r.randint(0, 120), r.randint(0, 120), r.choice([0.0, 5.0, 40.0]), 0.0, None, 0) for _ in range(60)]
    cells = [(i, r.randint(0, 1), r.randint(-5, 125), r.randint(-5, 125)) for i in range(60)] + [(60, 0, 400, 400)]
    got = {x.query_id: x.node_id for x in route.ring_snap(spark.createDataFrame(cells, "query_id long, layer int, row int, col int"), nodes(spark, rows), SCENE).collect()}
    for i, layer, y, x in cells:
        near = [(max(abs(n[1] - y), abs(n[2] - x)), (n[1] - y) ** 2 + (n[2] - x) ** 2, n[3], n[1] - y, n[2] - x, k) for k, n in enumerate(rows) if n[0] == layer and n[3] <= 35]
        near = [k for k in near if k[0] <= SCENE.snap_radius]
        assert got.get(i) == (min(near)[-1] if near else None)


def plain_dijkstra(edges, start):
    cost, todo = {start: 0.0}, [(0.0, start)]
    while todo:
        c, u = todo.pop(todo.index(min(todo)))
        for a, b, w in edges:
            if a == u and c + w < cost.get(b, math.inf):
                cost[b] = c + w
                todo.append((c + w, b))
    return cost


@pytest.mark.parametrize("heuristic", ["octile", "euclidean"])
def test_path_costs_equal_a_plain_search(spark, heuristic):
    r = random.Random(2)
    n = nodes(spark, [(0, y, x, r.choice([0.0, 3.0]), r.choice([0.0, 0.2]), None, 0) for y in range(7) for x in range(7) if r.random() < 0.7])
    f = frame(7, 7)
    edges = graph.graph_edges(n, SCENE, f)
    plain = [(e.src, e.dst, e.weight) for e in edges.collect()]
    last = n.count() - 1
    pairs = [(i, r.randint(0, last), r.randint(0, last)) for i in range(60)]
    d = spark.createDataFrame(pairs, "pair_index long, start_id long, goal_id long")
    got = {x.pair_index: x for x in route.search_paths(d, n, edges, heuristic=heuristic).collect()}
    weight = {(a, b): w for a, b, w in plain}
    for i, s, g in pairs:
        cost = plain_dijkstra(plain, s).get(g)
        assert (cost is None) == (i not in got)
        if cost is not None:
            assert math.isclose(got[i].cost, cost, abs_tol=1e-9) and (got[i].path[0], got[i].path[-1]) == (s, g)
            assert math.isclose(sum(weight[e] for e in zip(got[i].path, got[i].path[1:], strict=False)), cost, abs_tol=1e-9)
    seen = route.visited_nodes(d.limit(5), n, edges, heuristic).groupBy("pair_index").agg(F.collect_set("node_id").alias("v")).collect()
    assert all({*got[x.pair_index].path} <= {*x.v} for x in seen)


def test_flat_components_equal_a_flood(spark):
    r = random.Random(12)
    cells = [(layer, y, x) for layer in range(2) for y in range(12) for x in range(140) if r.random() < (0.45, 0.7)[x > 60]]
    rows = [(i, layer, y, x, 0.0, 0.1) for i, (layer, y, x) in enumerate(cells)]
    d = spark.createDataFrame(rows, "node_id long, layer int, row int, col int, elev_g double, slope double")
    left, want = set(cells), {}
    for seed in cells:  # in order of layer, row, column, so components are met in the order of their numbers
        if seed in left:
            number, todo = len(set(want.values())), [seed]
            left.remove(seed)
            while todo:
                layer, y, x = todo.pop()
                want[layer, y, x] = number
                near = [(layer, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (layer, y + a, x + b) in left]
                left.difference_update(near)
                todo += near
    got = {(c.layer, c.row, c.col): c.component for c in regions.flat_components(d, frame(140, 12)).collect()}
    assert got == want


def test_overlaps_equal_all_pairs(spark):
    r = random.Random(7)
    rows = []
    for i in range(40):
        x, z = r.uniform(0, 20), r.choice([0.0, 1.0, 2.0])
        rows.append(box(i, r.randint(1, 9), x, x + r.choice([0.0, 0.5, 3.0, 15.0]), z, z + r.choice([0.0, 1.5])))
    side = lambda p, q, v: max(0.0, min(p[f"max_{v}"], q[f"max_{v}"]) - max(p[f"min_{v}"], q[f"min_{v}"]))
    size = lambda p: math.prod(p[f"max_{v}"] - p[f"min_{v}"] for v in "xyz")
    shared = {(p["id"], q["id"]): math.prod(side(p, q, v) for v in "xyz") / max(1e-12, size(p) + size(q) - math.prod(side(p, q, v) for v in "xyz")) for p in rows for q in rows if p["id"] < q["id"]}
    got = {(x.a, x.b): x.iou for x in regions.iou_pairs(spark.createDataFrame(rows)).collect()}
    assert got.keys() == {k for k, v in shared.items() if v > 0} and all(math.isclose(v, shared[k]) for k, v in got.items())
    kept = []
    for p in sorted(rows, key=lambda p: (-p["node_count"], p["id"])):
        if all(shared[min(p["id"], k), max(p["id"], k)] <= 0.1 for k in kept):
            kept.append(p["id"])
    assert [x.component_id[0] for x in regions.deduplicate(spark.createDataFrame(rows), 0.1).orderBy("id").collect()] == kept


def test_requests_by_place_name_and_index(spark):
    w = spark.createDataFrame([(0, "a", 1.0, 2.0, 3.0), (1, "b", 4.0, 5.0, 6.0)], "pos long, name string, x double, y double, z double")
    every = spark.createDataFrame([(0, 0.0), (1, 1.0)], "pair_index long, sx double")
    assert tuple(pipelines.requested_pairs(spark, "b", (7, 8, 9), w).first())[:7] == (0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0)
    assert pipelines.requested_pairs(spark, pairs=every).count() == 2 and pipelines.requested_pairs(spark, pairs=every, index=1).first().sx == 1.0
    with pytest.raises(KeyError, match="'a'"):
        pipelines.requested_pairs(spark, "c", "a", w)
    for bad in ({}, {"start": "a"}, {"start": (1, 2), "goal": (1, 2, 3)}, {"start": "a", "goal": "b"}):
        with pytest.raises(ValueError):
            pipelines.requested_pairs(spark, **bad)


def test_shared_folder_must_be_named_on_a_cluster():
    from strata import session

    class Elsewhere:
        master = "spark://somewhere:7077"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = Elsewhere

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session)


def test_paths_agree_with_relaxation(spark):
    r = random.Random(1)
    n = nodes(spark, [(0, y, x, r.choice([0.0, 3.0]), r.choice([0.0, 0.2]), None, 0) for y in range(6) for x in range(6) if r.random() < 0.85])
    f = frame(6, 6)
    edges = graph.graph_edges(n, SCENE, f)
    last = n.count() - 1
    pairs = spark.createDataFrame([(0, 0, last), (1, 3, 3), (2, last, 0), (3, 0, 999)], "pair_index long, start_id long, goal_id long")
    near = {p.pair_index: p for p in route.search_paths(pairs, n, edges).collect()}
    far = {p.pair_index: p for p in route.search_paths(pairs, n, edges, edge_limit=0).collect()}
    assert near.keys() == far.keys() and 3 not in near and near[1].path == [3] and near[1].cost == 0
    for k, p in near.items():
        assert math.isclose(p.cost, far[k].cost, abs_tol=1e-9)
        assert (p.path[0], p.path[-1]) == (far[k].path[0], far[k].path[-1])
    points = route.path_points(route.search_paths(pairs, n, edges), n, SCENE, f)
    lengths = {x.pair_index: x.length for x in route.path_lengths(points, "pair_index", ["seq"]).collect()}
    assert lengths[1] == 0 and lengths[0] > 0
    steps = points.orderBy("pair_index", "seq").collect()
    for a, b in zip(steps, steps[1:], strict=False):
        if a.pair_index == b.pair_index:
            assert max(abs(a.row - b.row), abs(a.col - b.col)) == 1


def test_a_failed_leg_fails_the_route(spark):
    d = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (1, 0, 1.0, 0.0, 0.0), (1, 1, 2.0, 0.0, 0.0)], "pair_index long, seq int, x double, y double, z double")
    assert [(r.seq, r.x) for r in route.joined_legs(d, 2).orderBy("seq").collect()] == [(0, 0.0), (1, 1.0), (2, 2.0)]
    assert route.joined_legs(d, 3).count() == 0


def test_map_round_trip_and_refusals(spark, tmp_path):
    m = pipelines.Map(SCENE, frame(), [0], None, nodes(spark, [(0, 1, 2, 1.5, 0.5, None, 0)]))
    files.write_map(m.header(), m.nodes, f"{tmp_path}/map")
    header, back = files.read_map(spark, f"{tmp_path}/map")
    assert header.first()["shape"] == [1, 5, 5] and back.first()["elev_g"] == 0.5
    with pytest.raises(MapFormatError, match="lacks"):
        files.validate_map(header.drop("format"), back)
    with pytest.raises(MapFormatError, match="format"):
        files.validate_map(header.withColumn("format", F.lit("dense")), back)
    with pytest.raises(MapFormatError, match="outside"):
        files.validate_map(header, back.withColumn("row", F.lit(9)))


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps([{"name": "a", "pose": [1, 2, 3]}, {"name": "b", "pose": [4, 5, 6], "radius": 0.5}]))
    (tmp_path / "p.json").write_text(json.dumps([{"start": [0, 0, 0], "goal": [1, 1, 1], "task": "x"}]))
    (tmp_path / "c.csv").write_text("x,y,z\n1,2,3\n")
    w = files.read_waypoints(spark, str(tmp_path / "w.json"))
    assert [tuple(r) for r in w.orderBy("pos").collect()] == [(0, "a", 1.0, 2.0, 3.0, None), (1, "b", 4.0, 5.0, 6.0, 0.5)]
    assert files.waypoint_by_name(w, "b") == (4.0, 5.0, 6.0)
    with pytest.raises(KeyError, match="'a'"):
        files.waypoint_by_name(w, "zz")
    assert files.json_kind(spark, str(tmp_path / "p.json")) == "pairs" and files.json_kind(spark, str(tmp_path / "w.json")) == "waypoints"
    p = files.read_pairs(spark, str(tmp_path / "p.json"))
    assert p.first()["extra"] == {"task": "x"} and p.first()["gz"] == 1.0
    with pytest.raises(IndexError):
        files.nth_pair(p, 4)
    assert tuple(files.read_path(spark, str(tmp_path / "c.csv")).first()) == (1.0, 2.0, 3.0)
    kinds = sorted(r.kind for r in views.waypoint_markers(w).collect())
    assert kinds == ["disk", "label", "label", "line", "line", "sphere", "sphere"]


def test_waypoint_pairs_of_odd_positions(spark):
    far = 2**53
    at = [7, None, -4, 7, 0, far, far + 1, far + 2, -far - 1, 7, 3, None, 12, -(2**63), 2**63 - 1]
    w = spark.createDataFrame([(p, f"w{i}", float(i), float(-i), None, 0.0) for i, p in enumerate(at)], "pos long, name string, x double, y double, z double, radius double")
    want = sorted((a, f"w{i}", float(i), b, f"w{j}", float(-j)) for i, a in enumerate(at) for j, b in enumerate(at) if a is not None and b is not None and a < b)
    for rows in (1, 3, 100):
        got = route.waypoint_pairs(w, rows)
        assert got.columns == ["spos", "sname", "sx", "sy", "sz", "gpos", "gname", "gx", "gy", "gz"]
        assert sorted((r.spos, r.sname, r.sx, r.gpos, r.gname, r.gy) for r in got.collect()) == want
    assert route.waypoint_pairs(w.where("pos is null")).count() == route.waypoint_pairs(w.limit(1)).count() == 0


def test_waypoint_pairs_are_dealt_out(spark):
    n = 3000
    w = spark.range(0, n, 1, 1).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("name"), *(F.lit(0.0).alias(v) for v in "xyz"))
    shares = [tuple(r) for r in route.waypoint_pairs(w).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)), F.sum("spos"), F.sum("gpos")).drop("SPARK_PARTITION_ID()").collect()]
    assert [sum(x) for x in zip(*shares, strict=True)] == [n * (n - 1) // 2, sum(i * (n - 1 - i) for i in range(n)), sum(i * i for i in range(n))]
    assert len(shares) > 2 and max(s[0] for s in shares) < 0.6 * n * (n - 1) // 2


def test_waypoint_pairs_round_places_and_not_pairs(spark, tmp_path):
    from strata.plans import queries

    rows = [(k, f"s{k}", k % 25) for k in range(30)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    q = queries.QUERIES["waypoint_pairs"](spark, str(tmp_path))
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "round(" in plan and "round(" not in plan[: plan.index("Join")]
    assert q.count() == 435 and q.where("spos = 1 and gpos = 3").first()[2:5] == (3.7, 2.7, 3.0)


def test_pcd_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(0.5, 1.0, -2.0), (3.0, 4.0, 5.25)], "x double, y double, z double").coalesce(1)
    pcd.write_pcd(d, f"{tmp_path}/cloud")
    assert sorted(tuple(r) for r in pcd.read_pcd(spark, f"{tmp_path}/cloud/part-*").collect()) == [(0.5, 1.0, -2.0), (3.0, 4.0, 5.25)]
    import numpy as np

    head = b"FIELDS rgb x y z\nSIZE 4 4 4 4\nTYPE U F F F\nCOUNT 1 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA binary\n"
    got = pcd.parse_pcd(head + np.array([7], "<u4").tobytes() + np.array([1, 2, 3], "<f4").tobytes())
    assert [float(got[c][0]) for c in "xyz"] == [1.0, 2.0, 3.0]


def test_queries_and_oracles_agree():
    from strata.plans import oracles, queries

    assert set(oracles.QUERIES) <= set(queries.QUERIES)
    assert all(oracles.sql_of(n) for n in oracles.QUERIES)
