"""Pairs to paths: snapping to the graph, search, reconstruction, lengths, legs, reachability."""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.config import Frame, Scene
from strata.functions.coords import grid_of, layer_of, node_x, node_y, traversable
from strata.operators.graph_core import LOCAL_EDGES, connected_components
from strata.session import discard, written

EDGE_LIMIT = 30_000_000  # edges of one component that a task may hold; about 1 GB
STARTS = 128  # starts that one task searches from
BLOCK_ROWS = 1_024  # waypoints of a block; blocks are paired
PAIR_TASKS = 2_000  # tasks that pairs of blocks are dealt out to, at most


def nearest_node(queries: DataFrame, nodes: DataFrame, frame: Frame) -> DataFrame:
    """query_id, node_id, dist: the nearest node in space to each (query_id, x, y, z); equal distances go to the least id.

    Positions and nodes are dealt into cubes; a position meets the nodes of the 27 cubes around its own, so the join has
    an equality and both sides are spread. What lies outside those is farther than a cube is wide, so a node found
    within that distance is the nearest. Positions without one go on with cubes four times as wide, until one cube is
    wider than all there is. Each position is looked up once, however many queries stand there.
    """
    q = queries.select("query_id", *(F.col(v).cast("double").alias(v) for v in "xyz")).dropna()
    n = written(nodes.select("node_id", node_x(frame).alias("nx"), node_y(frame).alias("ny"), F.col("elev_g").alias("nz")).dropna(), "places")
    todo = written(q.select("x", "y", "z").distinct(), "positions")
    ends = [f(v) for v in ("nx", "ny", "nz") for f in (F.min, F.max)], [f(v) for v in "xyz" for f in (F.min, F.max)]
    node_ends, query_ends = (tuple(t.agg(*(e.alias(str(i)) for i, e in enumerate(x))).first()) for t, x in zip((n, todo), ends, strict=True))
    known = node_ends[0] is not None and query_ends[0] is not None
    span = max(max(node_ends[i + 1], query_ends[i + 1]) - min(node_ends[i], query_ends[i]) for i in (0, 2, 4)) if known else -1.0
    around = F.explode(F.array(*(F.struct(*(F.lit(d).alias(v) for v, d in zip("abc", o, strict=True))) for o in itertools.product((-1, 0, 1), repeat=3)))).alias("o")
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    d2 = F.round(sq("x", "nx") + sq("y", "ny") + sq("z", "nz"), 9)
    size, found, used = 4 * frame.resolution, None, [n]
    while True:
        cube = lambda v: F.floor(F.col(v) / size)  # noqa: B023, E731
        places = n.withColumns({k: cube(v) for k, v in zip(("bx", "by", "bz"), ("nx", "ny", "nz"), strict=True)})
        asked = todo.select("x", "y", "z", around).select("x", "y", "z", *((cube(v) + F.col(f"o.{o}")).alias(k) for v, o, k in zip("xyz", "abc", ("bx", "by", "bz"), strict=True)))
        best = asked.join(places, ["bx", "by", "bz"]).groupBy("x", "y", "z").agg(F.min(F.struct(d2.alias("d2"), "node_id")).alias("b"))
        last = size > span
        best = written(best if last else best.where(F.sqrt("b.d2") < size - 1e-6), "nearest")
        found = best if found is None else found.unionByName(best)
        if last:
            break
        used.append(todo)
        todo = written(todo.join(best, ["x", "y", "z"], "left_anti"), "positions")
        if not todo.limit(1).count():
            break
        size *= 4
    discard(*used, todo)
    return q.join(found, ["x", "y", "z"]).select("query_id", F.col("b.node_id").alias("node_id"), F.sqrt("b.d2").alias("dist"))


def ring_snap(queries: DataFrame, nodes: DataFrame, scene: Scene) -> DataFrame:
    """query_id, node_id, dist: the best traversable node of the first square ring around (layer, row, col) that has one.

    Within the ring: least squared distance in cells, then cost, then row and column. Cells meet the nodes of the nine
    buckets around their own, which hold all rings as wide as a bucket; cells that find nothing there go on with buckets
    four times as wide, up to the radius. Each cell is looked up once, however many queries stand there.
    """
    q = queries.select("query_id", "layer", "row", "col").dropna()
    n = nodes.where(traversable(scene)).select("node_id", "layer", F.col("row").alias("nr"), F.col("col").alias("nc"), "trav")
    todo = written(q.select("layer", "row", "col").distinct(), "cells")
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in itertools.product((-1, 0, 1), repeat=2)))).alias("o")
    dr, dc = F.col("nr") - F.col("row"), F.col("nc") - F.col("col")
    rank = F.min(F.struct("ring", (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"), "trav", "dr", "dc", "node_id")).alias("b")
    size, found, used = min(4, scene.snap_radius), None, []
    while True:
        bucket = lambda c: F.floor(F.col(c) / max(1, size)).cast("int")  # noqa: B023, E731
        asked = todo.select("layer", "row", "col", near).select("layer", "row", "col", (bucket("row") + F.col("o.a")).alias("br"), (bucket("col") + F.col("o.b")).alias("bc"))
        met = asked.join(n.withColumns({"br": bucket("nr"), "bc": bucket("nc")}), ["layer", "br", "bc"]).withColumns({"dr": dr, "dc": dc, "ring": F.greatest(F.abs(dr), F.abs(dc))})
        best = written(met.where(F.col("ring") <= size).groupBy("layer", "row", "col").agg(rank), "rings")
        found = best if found is None else found.unionByName(best)
        used.append(todo)
        if size >= scene.snap_radius:
            break
        todo = written(todo.join(best, ["layer", "row", "col"], "left_anti"), "cells")
        if not todo.limit(1).count():
            used.append(todo)
            break
        size = min(4 * size, scene.snap_radius)
    discard(*used)
    return q.join(found, ["layer", "row", "col"]).select("query_id", F.col("b.node_id").alias("node_id"), F.sqrt(F.col("b.d2").cast("double")).alias("dist"))


def to_grid(queries: DataFrame, frame: Frame, heights: list[float]) -> DataFrame:
    """query_id, layer, row, col of (query_id, x, y, z)."""
    row, col = grid_of(F.col("y"), frame.center_y, frame.dim_y, frame.resolution), grid_of(F.col("x"), frame.center_x, frame.dim_x, frame.resolution)
    return queries.select("query_id", layer_of(F.col("z"), heights).alias("layer"), row.alias("row"), col.alias("col"))


def snapped_pairs(pairs: DataFrame, nodes: DataFrame, scene: Scene, frame: Frame, mode: str = "nearest", heights: list[float] | None = None) -> DataFrame:
    """pair_index, start_id, goal_id. Mode nearest: the nearest node, then the ring around it; grid: the ring around the cell. Pairs with an end that finds nothing drop out."""
    ends = pairs.select("pair_index", F.explode(F.array(*(F.struct(F.lit(e).alias("end"), *(F.col(f"{p}{v}").alias(v) for v in "xyz")) for e, p in (("s", "s"), ("g", "g"))))).alias("e"))
    ends = ends.select("pair_index", "e.*").withColumn("query_id", F.concat_ws(":", F.col("pair_index").cast("string"), "end"))
    if mode == "nearest":
        at = nearest_node(ends.select("query_id", "x", "y", "z"), nodes, frame).join(nodes.select("node_id", "layer", "row", "col"), "node_id").select("query_id", "layer", "row", "col")
    else:
        at = to_grid(ends, frame, heights or [])
    hit = ends.select("query_id", "pair_index", "end").join(ring_snap(at, nodes, scene), "query_id")
    one = lambda e: F.max(F.when(F.col("end") == e, F.col("node_id")))
    return hit.groupBy("pair_index").agg(one("s").alias("start_id"), one("g").alias("goal_id")).where("start_id is not null and goal_id is not null")


def octile(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Diagonal distance: steps along three, two and one axis."""
    return math.sqrt(3) * low + math.sqrt(2) * (mid - low) + (high - mid)


#: Bounds on the rest of a path from the sorted differences of layer, row and column. Manhattan may exceed it, as steps can be diagonal.
HEURISTICS = {
    "octile": octile,
    "euclidean": lambda low, mid, high: np.sqrt(low * low + mid * mid + high * high),
    "manhattan": lambda low, mid, high: low + mid + high,
}


class Adjacency:
    """The edges of a component as lists by source, with the cells of the nodes for the heuristic."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.cells = ids[order], cells[order]
        src, dst = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        by = np.lexsort((dst, src))
        first = np.searchsorted(src[by], np.arange(len(ids) + 1)).tolist()
        steps = list(zip(dst[by].tolist(), weight[by].tolist(), strict=True))
        self.steps = [steps[a:b] for a, b in itertools.pairwise(first)]

    def _number(self, node: int) -> int:
        at = int(np.searchsorted(self.ids, node))
        return at if at < len(self.ids) and self.ids[at] == node else -1

    def search(self, start: int, goals: list[int], heuristic: str = "octile") -> tuple[dict[int, tuple[float, list[int]]], list[int]]:
        """Cost and nodes of a cheapest path to each goal that has one, and the nodes settled, in that order.

        The heap is ordered by (cost + bound, node). One goal is searched for with a bound, several without.
        """
        s, left = self._number(start), {g for g in map(self._number, goals) if g >= 0}
        if s < 0 or not left:
            return {}, []
        bound = None
        if len(left) == 1:
            bound = HEURISTICS[heuristic](*np.sort(np.abs(self.cells - self.cells[next(iter(left))]), axis=1).T.astype(float)).tolist()
        cost, parent, settled, found, steps = {s: 0.0}, {s: -1}, {}, {}, self.steps
        heap = [(bound[s] if bound else 0.0, s)]
        while heap and left:
            _, u = heapq.heappop(heap)
            if u in settled:
                continue
            settled[u] = None
            if u in left:
                left.remove(u)
                path, at = [], u
                while at >= 0:
                    path.append(int(self.ids[at]))
                    at = parent[at]
                found[int(self.ids[u])] = cost[u], path[::-1]
            base = cost[u]
            for v, w in steps[u]:
                new = base + w
                if v not in settled and new < cost.get(v, math.inf):
                    cost[v], parent[v] = new, u
                    heapq.heappush(heap, (new + bound[v] if bound else new, v))
        return found, self.ids[list(settled)].tolist()


def _searches(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, edge_limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Distinct (start_id, goal_id, component) of one component; its edges with cells; the same two for components over the limit."""
    labels = written(connected_components(edges, local_limit=LOCAL_EDGES).select(F.col("node").alias("node_id"), "component"), "labels")
    known = nodes.select("node_id", "layer", "row", "col").join(labels, "node_id")
    side = lambda e: labels.select(F.col("node_id").alias(f"{e}_id"), F.col("component").alias(f"{e}_component"))
    asked = pairs.select("start_id", "goal_id").where("start_id <> goal_id").distinct().join(side("start"), "start_id").join(side("goal"), "goal_id")
    asked = written(asked.where("start_component = goal_component").select("start_id", "goal_id", F.col("start_component").alias("component")), "asked")
    known = known.join(asked.select("component").distinct(), "component", "left_semi")
    steps = written(edges.join(known.withColumnRenamed("node_id", "src"), "src"), "edges")
    large = F.broadcast(written(steps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > edge_limit).select("component"), "large"))  # at most one for edge_limit edges
    apart = lambda t, how: t.join(large, "component", how)
    return apart(asked, "left_anti"), apart(steps, "left_anti"), apart(asked, "left_semi"), apart(steps, "left_semi")


def _shared_out(asked: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with shard: the starts of a component by STARTS a shard, its edges once for each shard."""
    shards = asked.groupBy("component").agg((F.ceil(F.approx_count_distinct("start_id") / STARTS)).cast("int").alias("shards"))
    asked = asked.join(shards, "component").withColumn("shard", F.pmod(F.xxhash64("start_id"), F.col("shards")).cast("int")).drop("shards")
    steps = steps.join(shards, "component").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    return asked, steps


def _graph(steps: pa.Table) -> Adjacency:
    src = steps.column("src").to_numpy()
    ids, first = np.unique(src, return_index=True)
    cells = np.stack([steps.column(c).to_numpy()[first] for c in ("layer", "row", "col")], axis=1)
    return Adjacency(ids, cells, src, steps.column("dst").to_numpy(), steps.column("weight").to_numpy())


def search_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, edge_limit: int = EDGE_LIMIT, heuristic: str = "octile") -> DataFrame:
    """pair_index, cost, path (array of node_id) of (pair_index, start_id, goal_id); pairs without a path drop out.

    Only pairs of one component are searched for. A task gets the edges of one component and some of the starts there;
    all goals of a start are found by one search. The driver sees no graph. Components with more than edge_limit edges
    stay distributed, and costs are relaxed round by round.
    """
    edges = written(edges.select("src", "dst", "weight"), "edges")
    p = pairs.select(F.col("pair_index").cast("long").alias("pair_index"), F.col("start_id").cast("long").alias("start_id"), F.col("goal_id").cast("long").alias("goal_id"))
    asked, steps, far, far_steps = _searches(p, nodes, edges, edge_limit)

    def run(mine: pa.Table, graph: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if mine.num_rows and graph.num_rows:
            g, goals = _graph(graph), {}
            for s, t in zip(mine.column("start_id").to_pylist(), mine.column("goal_id").to_pylist(), strict=True):
                goals.setdefault(s, []).append(t)
            for s, ts in goals.items():
                for t, (cost, path) in g.search(s, ts, heuristic)[0].items():
                    for column, value in zip(out, (s, t, cost, path), strict=True):
                        column.append(value)
        return pa.table({"start_id": pa.array(out[0], pa.int64()), "goal_id": pa.array(out[1], pa.int64()), "cost": pa.array(out[2], pa.float64()), "path": pa.array(out[3], pa.list_(pa.int64()))})

    asked, steps = _shared_out(asked, steps)
    key = ["component", "shard"]
    found = asked.groupBy(*key).cogroup(steps.groupBy(*key)).applyInArrow(run, "start_id long, goal_id long, cost double, path array<long>")
    if far.limit(1).count():
        found = found.unionByName(relaxed_paths(far, far_steps))
    there = p.where("start_id = goal_id").join(nodes.select(F.col("node_id").alias("start_id")), "start_id", "left_semi")
    still = there.select("pair_index", F.lit(0.0).alias("cost"), F.array("start_id").alias("path"))
    return p.join(found, ["start_id", "goal_id"]).select("pair_index", "cost", "path").unionByName(still)


def visited_nodes(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, heuristic: str = "octile") -> DataFrame:
    """pair_index, seq, node_id: the nodes that the search for a single pair settles, in that order; pairs without a path drop out."""
    edges = written(edges.select("src", "dst", "weight"), "edges")
    asked, steps, _, _ = _searches(pairs, nodes, edges, EDGE_LIMIT)

    def run(mine: pa.Table, graph: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [])
        if mine.num_rows and graph.num_rows:
            g = _graph(graph)
            for s, t in zip(mine.column("start_id").to_pylist(), mine.column("goal_id").to_pylist(), strict=True):
                for column, value in zip(out, (s, t, g.search(s, [t], heuristic)[1]), strict=True):
                    column.append(value)
        return pa.table({"start_id": pa.array(out[0], pa.int64()), "goal_id": pa.array(out[1], pa.int64()), "visited": pa.array(out[2], pa.list_(pa.int64()))})

    asked, steps = _shared_out(asked, steps)
    key = ["component", "shard"]
    found = asked.groupBy(*key).cogroup(steps.groupBy(*key)).applyInArrow(run, "start_id long, goal_id long, visited array<long>")
    return pairs.join(found, ["start_id", "goal_id"]).select("pair_index", F.posexplode("visited").alias("seq", "node_id"))


def relaxed_paths(asked: DataFrame, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """start_id, goal_id, cost, path by rounds over tables: the frontier of every start meets the edges, and better costs make the next frontier.

    What costs as much as the dearest goal found from its start goes no further, once all goals of the start are found.
    """
    steps = edges.select(F.col("src").alias("node"), "dst", "weight")
    wanted = asked.groupBy("start_id").agg(F.collect_set("goal_id").alias("goals"))
    goals = asked.select("start_id", F.col("goal_id").alias("node"))
    best = written(asked.select("start_id").distinct().select("start_id", F.col("start_id").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("parent")), "best")
    front = written(best, "front")
    for _ in range(max_rounds):
        reached = best.join(goals, ["start_id", "node"]).groupBy("start_id").agg(F.max("cost").alias("most"), F.count(F.lit(1)).alias("n"))
        limits = reached.join(wanted, "start_id").where("n = size(goals)").select("start_id", "most")
        step = front.join(steps, "node").select("start_id", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.col("node").alias("parent"))
        step = step.groupBy("start_id", "node").agg(F.min(F.struct("cost", "parent")).alias("new")).join(limits, "start_id", "left").where("most is null or new.cost < most").drop("most")
        old = best.select("start_id", "node", F.col("cost").alias("old"))
        moved = written(step.join(old, ["start_id", "node"], "left").where("old is null or new.cost < old").select("start_id", "node", "new.cost", "new.parent"), "front")
        if not moved.limit(1).count():
            discard(moved)
            break
        now = written(best.join(moved, ["start_id", "node"], "left_anti").unionByName(moved), "best")
        discard(best, front)
        best, front = now, moved
    trail = written(goals.join(best, ["start_id", "node"]).select("start_id", F.col("node").alias("goal_id"), "cost", F.col("parent").alias("at"), F.array("node").alias("path")), "trail")
    back = best.select("start_id", F.col("node").alias("at"), F.col("parent").alias("up"))
    while trail.where("at is not null").limit(1).count():
        longer = trail.join(back, ["start_id", "at"], "left").select("start_id", "goal_id", "cost", F.col("up").alias("at"), F.when(F.col("at").isNotNull(), F.concat(F.array("at"), "path")).otherwise(F.col("path")).alias("path"))
        trail, before = written(longer, "trail"), trail
        discard(before)
    return trail.select("start_id", "goal_id", "cost", "path")


def path_points(paths: DataFrame, nodes: DataFrame, scene: Scene, frame: Frame) -> DataFrame:
    """pair_index, seq, node_id, layer, row, col, x, y, z of every step; z is lifted off the ground."""
    steps = paths.select("pair_index", F.posexplode("path").alias("seq", "node_id"))
    n = nodes.select("node_id", "layer", "row", "col", node_x(frame).alias("x"), node_y(frame).alias("y"), (F.col("elev_g") + scene.lift).alias("z"))
    return steps.join(n, "node_id").select("pair_index", "seq", "node_id", "layer", "row", "col", "x", "y", "z")


def path_lengths(points: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """key, n_points, length: the sum of the distances of consecutive points; 0 for fewer than two."""
    w = Window.partitionBy(key).orderBy(*order)
    d = [F.col(v) - F.lag(v).over(w) for v in "xyz"]
    steps = points.withColumn("step", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return steps.groupBy(key).agg(F.count(F.lit(1)).alias("n_points"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def waypoint_pairs(waypoints: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All unordered pairs i < j of waypoints, numbered by pos.

    The product is the task, so it is dealt out: waypoints lie in blocks of neighbouring pos, and each block meets itself
    and the later ones, by an equality. Borders are approximate, and a block that repeats a pos is larger; no pair is lost by that.
    """
    w = waypoints.select("pos", "name", "x", "y", "z").where("pos is not null")
    n = -(-w.count() // block_rows)
    borders = w.approxQuantile("pos", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    block = F.size(F.filter(F.array(*(F.lit(b) for b in borders)), lambda b: b <= F.col("pos").cast("double"))) if borders else F.lit(0)
    parts = min(max(1, n * (n + 1) // 2), PAIR_TASKS)

    def side(p: str, others: Column) -> DataFrame:
        a, b = ("block", "other") if p == "s" else ("other", "block")
        dealt = w.withColumn("block", block).withColumn("other", F.explode(others)).repartition(parts, a, b)
        return dealt.select(F.col(a).alias("sblock"), F.col(b).alias("gblock"), *(F.col(c).alias(f"{p}{c}") for c in w.columns))

    later, earlier = F.sequence("block", F.lit(len(borders))), F.sequence(F.lit(0), F.col("block"))
    met = side("s", later).hint("merge").join(side("g", earlier), ["sblock", "gblock"])
    return met.where("spos < gpos").drop("sblock", "gblock")


def waypoint_legs(waypoints: DataFrame) -> DataFrame:
    """leg, from and to of consecutive waypoints."""
    w = Window.orderBy("pos")  # a route is a list of named places, not a table that grows with the map
    legs = waypoints.select((F.row_number().over(w) - 1).alias("leg"), F.col("pos").alias("from_pos"), F.lead("pos").over(w).alias("to_pos"), *(F.col(v).alias(f"s{v}") for v in "xyz"), *(F.lead(v).over(w).alias(f"g{v}") for v in "xyz"))
    return legs.where("to_pos is not null")


def joined_legs(leg_points: DataFrame, n_legs: int) -> DataFrame:
    """The points of all legs as one trajectory, joints once; no row at all if a leg has no path."""
    complete = leg_points.agg(F.count_distinct("pair_index").alias("n")).where(F.col("n") == n_legs).select(F.lit(1).alias("whole"))
    kept = leg_points.where((F.col("seq") > 0) | (F.col("pair_index") == 0))
    whole = kept.join(F.broadcast(complete))
    return whole.withColumn("seq", F.row_number().over(Window.orderBy("pair_index", "seq")) - 1).select("seq", "x", "y", "z")


def unreachable(pairs: DataFrame, reached: DataFrame, key: str = "pair_index") -> DataFrame:
    return pairs.join(reached.select(key).distinct(), key, "left_anti")


def trajectory_records(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pair_index, json: one record for each pair that has a path, extras of the pair merged in."""
    line = points.groupBy("pair_index").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("p"))
    line = line.select("pair_index", F.transform("p", lambda s: F.array(s["x"], s["y"], s["z"])).alias("trajectory"))
    d = pairs.join(line, "pair_index")
    record = F.to_json(F.struct(F.array("sx", "sy", "sz").alias("start_pose"), F.array("gx", "gy", "gz").alias("goal_pose"), "trajectory", "pair_index"))
    extra = F.to_json("extra")
    merged = F.when(F.size("extra") > 0, F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit(","), F.substr(extra, F.lit(2)))).otherwise(F.col("record"))
    return d.withColumn("record", record).select("pair_index", merged.alias("json"))
