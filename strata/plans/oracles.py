"""SQL for DuckDB that states each query by itself, from dense grids and plain definitions, as named common table expressions.

Every entry of PARTS is one expression; a query's SQL is made of the parts it names, directly or through others.
"""

from __future__ import annotations

import re

from strata.sources.adapters import SCENE

OFFSETS = ", ".join(f"({x}, {y}, {v!r}::DOUBLE)" for x, y, v in SCENE.inflation_offsets())
SQUARE = ", ".join(f"({r}, {c})" for r in (-1, 0, 1) for c in (-1, 0, 1))
EIGHT = ", ".join(f"({r}, {c})" for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0))
STAND, CROSS, H, LEAST = f"{SCENE.stand_sq!r}::DOUBLE", f"{SCENE.cross_sq!r}::DOUBLE", SCENE.half_window, SCENE.standable_least
R6 = "round({0}, 9) AS {0}".format

PARTS: dict[str, str] = {
    "pts": """
        SELECT gx * 0.1::DOUBLE AS x, gy * 0.1::DOUBLE AS y,
               (CASE WHEN gy < 10 THEN greatest(0, least(3000, 100 * (gx - 10))) + greatest(0, least(3000, 100 * (gx - 50)))
                     WHEN gx % 20 = 10 AND gy >= 20 AND gy < 50 THEN 3000 * lv + 40 * q
                     ELSE 3000 * lv + 10 * (q % 5) END) / 1000.0::DOUBLE AS z
        FROM (SELECT l_partkey % 91 AS gx, l_orderkey % 61 AS gy, l_linenumber % 3 AS lv, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""",
    "hdr": """
        SELECT count(*) AS n_points, (min(x) + max(x)) / 2 AS center_x, (min(y) + max(y)) / 2 AS center_y,
               CAST(ceil((max(x) - min(x)) / 0.1::DOUBLE) + 4 AS INTEGER) AS dim_x, CAST(ceil((max(y) - min(y)) / 0.1::DOUBLE) + 4 AS INTEGER) AS dim_y,
               CAST(ceil((max(z) + 1.0::DOUBLE) / 0.5::DOUBLE) AS INTEGER) AS n_slice, -0.5::DOUBLE AS slice_h0
        FROM pts""",
    "cel": """
        SELECT CAST(round((x - center_x) / 0.1::DOUBLE) AS INTEGER) + dim_x // 2 AS cx, CAST(round((y - center_y) / 0.1::DOUBLE) AS INTEGER) + dim_y // 2 AS cy, z
        FROM pts, hdr""",
    "inr": "SELECT cx, cy, z FROM cel, hdr WHERE cx BETWEEN 0 AND dim_x - 1 AND cy BETWEEN 0 AND dim_y - 1",
    "buc": """
        SELECT cx, cy, s, max(z) AS z_max, min(z) AS z_min
        FROM (SELECT cx, cy, z, least(greatest(0, CAST(ceil((z - slice_h0) / 0.5::DOUBLE) AS INTEGER)), n_slice) AS s FROM inr, hdr) GROUP BY cx, cy, s""",
    "sli": "SELECT CAST(unnest(range(n_slice + 1)) AS INTEGER) AS s FROM hdr",
    "vox": """
        SELECT * FROM (
            SELECT s, cx, cy, max(z_max) OVER (PARTITION BY cx, cy ORDER BY s ROWS UNBOUNDED PRECEDING) AS g,
                   min(z_min) OVER (PARTITION BY cx, cy ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS c
            FROM (SELECT DISTINCT cx, cy FROM buc) CROSS JOIN sli LEFT JOIN buc USING (cx, cy, s)
        ), hdr WHERE s < n_slice""",
    "den": """
        SELECT s, cx, cy, coalesce(g, -1e6::DOUBLE) AS g, coalesce(c, 1e6::DOUBLE) AS c, g IS NOT NULL AS occ
        FROM (SELECT * FROM (SELECT s FROM sli, hdr WHERE s < n_slice), (SELECT CAST(unnest(range(dim_x)) AS INTEGER) AS cx FROM hdr), (SELECT CAST(unnest(range(dim_y)) AS INTEGER) AS cy FROM hdr))
        LEFT JOIN (SELECT s, cx, cy, g, c FROM vox) USING (s, cx, cy)""",
    "gra": """
        SELECT s, cx, cy, g, c, occ, CASE WHEN inner_ THEN dx + dy ELSE 0 END AS sq, CASE WHEN inner_ THEN greatest(dx, dy) ELSE 0 END AS mx
        FROM (
            SELECT *, greatest((g - xa) * (g - xa), (g - xb) * (g - xb)) AS dx, greatest((g - ya) * (g - ya), (g - yb) * (g - yb)) AS dy
            FROM (
                SELECT d.*, cx BETWEEN 1 AND dim_x - 2 AND cy BETWEEN 1 AND dim_y - 2 AS inner_,
                       lag(g) OVER wx AS xa, lead(g) OVER wx AS xb, lag(g) OVER wy AS ya, lead(g) OVER wy AS yb
                FROM den d, hdr WINDOW wx AS (PARTITION BY s, cy ORDER BY cx), wy AS (PARTITION BY s, cx ORDER BY cy)
            )
        )""",
    "sta": f"""
        SELECT *, sum(col_n) OVER (PARTITION BY s, cy ORDER BY cx ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING) AS standable
        FROM (SELECT *, sum(CASE WHEN sq < {STAND} THEN 1 ELSE 0 END) OVER (PARTITION BY s, cx ORDER BY cy ROWS BETWEEN {H} PRECEDING AND {H} FOLLOWING) AS col_n FROM gra)""",
    "cst": f"""
        SELECT s, cx, cy, g, c, occ,
               CASE WHEN c - g < 0.5::DOUBLE THEN 50::DOUBLE
                    WHEN sq <= {STAND} THEN greatest(0::DOUBLE, 20 * (0.6::DOUBLE - (c - g))) + 15 * sq / {STAND}
                    WHEN mx <= {CROSS} AND standable >= {LEAST} THEN greatest(0::DOUBLE, 20 * (0.6::DOUBLE - (c - g))) + 20 * mx / {CROSS}
                    ELSE 50::DOUBLE END AS cost
        FROM sta""",
    "inf": f"""
        SELECT d.s, d.cx, d.cy, d.g, d.c, d.occ, coalesce(t, 0::DOUBLE) AS t
        FROM den d LEFT JOIN (
            SELECT s, cx + dx AS cx, cy + dy AS cy, max(cost * score) AS t FROM cst, (VALUES {OFFSETS}) o(dx, dy, score) WHERE cost > 0 GROUP BY 1, 2, 3
        ) USING (s, cx, cy)""",
    "upr": "SELECT i.*, lead(g) OVER (PARTITION BY cx, cy ORDER BY s) AS above FROM inf i",
    "nxt": """
        SELECT a.s AS l, min(b.s) AS m
        FROM upr b JOIN hdr ON b.above > b.g AND b.t < 50 AND b.s BETWEEN 1 AND n_slice - 3
        JOIN inf a ON a.cx = b.cx AND a.cy = b.cy AND a.s < b.s AND (b.g > a.g OR a.t > b.t) GROUP BY a.s""",
    "chn": "SELECT 0 AS s UNION ALL SELECT m FROM chn JOIN nxt ON chn.s = nxt.l",
    "kep": """
        SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS layer, CAST(s AS INTEGER) AS s
        FROM (SELECT s FROM chn UNION SELECT greatest(1, n_slice - 2) FROM hdr WHERE n_slice > 1)""",
    "lay": "SELECT layer, s, cx, cy, CASE WHEN occ THEN g END AS g, CASE WHEN c < 1e6 THEN c END AS c, t FROM inf JOIN kep USING (s)",
    "gat": """
        SELECT *, CASE WHEN t - t0 > 8 AND abs(g - g0) < 0.1::DOUBLE THEN -2 WHEN t2 - t < -8 AND abs(g2 - g) < 0.1::DOUBLE THEN 2 ELSE 0 END AS gateway
        FROM (SELECT *, lag(t) OVER w AS t0, lag(g) OVER w AS g0, lead(t) OVER w AS t2, lead(g) OVER w AS g2 FROM lay WINDOW w AS (PARTITION BY cx, cy ORDER BY layer))""",
    "nod": """
        SELECT row_number() OVER (ORDER BY layer, cx, cy) - 1 AS node_id, layer, cy AS "row", cx AS col, t AS trav, g AS elev_g, c AS elev_c, gateway
        FROM gat WHERE (g IS NOT NULL AND t <= 35) OR gateway <> 0""",
    "vis": """
        SELECT layer, cx, cy, g, min(t) OVER (PARTITION BY cx, cy, island ORDER BY layer) AS cost, hidden
        FROM (SELECT *, sum(CASE WHEN hidden_below THEN 0 ELSE 1 END) OVER (PARTITION BY cx, cy ORDER BY layer) AS island
              FROM (SELECT *, coalesce(lag(hidden) OVER (PARTITION BY cx, cy ORDER BY layer), false) AS hidden_below
                    FROM (SELECT *, coalesce(lead(g) OVER (PARTITION BY cx, cy ORDER BY layer) - g < 0.5::DOUBLE, false) AS hidden FROM lay)))""",
    "sam": """
        SELECT a.node_id AS src, b.node_id AS dst FROM nod a, (VALUES (0, 1), (1, -1), (1, 0), (1, 1)) o(dr, dc), nod b
        WHERE b.layer = a.layer AND b."row" = a."row" + dr AND b.col = a.col + dc AND abs(b.elev_g - a.elev_g) <= 0.5::DOUBLE""",
    "crs": f"""
        SELECT src, dst FROM (
            SELECT a.node_id AS src, b.node_id AS dst, row_number() OVER (PARTITION BY a.node_id ORDER BY dr * dr + dc * dc, b.trav, dr, dc) AS k
            FROM nod a, (VALUES {SQUARE}) o(dr, dc), nod b
            WHERE a.gateway <> 0 AND b.layer = a.layer + a.gateway // 2 AND b."row" = a."row" + dr AND b.col = a.col + dc AND abs(b.elev_g - a.elev_g) <= 0.5::DOUBLE
        ) WHERE k = 1""",
    "und": "SELECT src, dst FROM sam UNION SELECT dst, src FROM sam UNION SELECT src, dst FROM crs UNION SELECT dst, src FROM crs",
    "edg": """
        SELECT e.src, e.dst, sqrt((b.layer - a.layer) ** 2 + (b."row" - a."row") ** 2 + (b.col - a.col) ** 2 + ((b.elev_g - a.elev_g) / 0.1::DOUBLE) ** 2) + 0.2::DOUBLE * b.trav AS weight
        FROM und e JOIN nod a ON a.node_id = e.src JOIN nod b ON b.node_id = e.dst""",
    "com": """
        SELECT node_id AS node, node_id AS label FROM nod
        UNION
        SELECT e.dst, min(x.label) FROM com x JOIN und e ON e.src = x.node JOIN recurring.com r ON r.node = e.dst WHERE x.label < r.label GROUP BY e.dst""",
    "siz": "SELECT label AS component, count(*) AS size FROM com GROUP BY label",
    "lar": "SELECT n.* FROM nod n JOIN com ON node = node_id WHERE label = (SELECT component FROM siz ORDER BY size DESC, component LIMIT 1)",
    "slo": """
        SELECT n.node_id, n.layer, n."row", n.col, n.elev_g,
               sqrt(((CASE WHEN n.col = 0 THEN r.elev_g - n.elev_g WHEN n.col = dim_x - 1 THEN n.elev_g - l.elev_g ELSE (r.elev_g - l.elev_g) / 2 END) / 0.1::DOUBLE) ** 2
                  + ((CASE WHEN n."row" = 0 THEN u.elev_g - n.elev_g WHEN n."row" = dim_y - 1 THEN n.elev_g - d.elev_g ELSE (u.elev_g - d.elev_g) / 2 END) / 0.1::DOUBLE) ** 2) AS slope
        FROM nod n CROSS JOIN hdr
        LEFT JOIN nod l ON l.layer = n.layer AND l."row" = n."row" AND l.col = n.col - 1 LEFT JOIN nod r ON r.layer = n.layer AND r."row" = n."row" AND r.col = n.col + 1
        LEFT JOIN nod d ON d.layer = n.layer AND d.col = n.col AND d."row" = n."row" - 1 LEFT JOIN nod u ON u.layer = n.layer AND u.col = n.col AND u."row" = n."row" + 1""",
    "fla": "SELECT * FROM slo WHERE slope <= 0.2::DOUBLE",
    "fle": f"""
        SELECT a.node_id AS src, b.node_id AS dst FROM fla a, (VALUES {EIGHT}) o(dr, dc), fla b WHERE b.layer = a.layer AND b."row" = a."row" + dr AND b.col = a.col + dc""",
    "fco": """
        SELECT node_id AS node, node_id AS label FROM fla
        UNION
        SELECT e.dst, min(x.label) FROM fco x JOIN fle e ON e.src = x.node JOIN recurring.fco r ON r.node = e.dst WHERE x.label < r.label GROUP BY e.dst""",
    "fcm": """
        SELECT node_id, layer, "row", col, elev_g, CAST(dense_rank() OVER (ORDER BY layer, first) - 1 AS INTEGER) AS component
        FROM (SELECT f.*, min("row" * dim_x + col) OVER (PARTITION BY label) AS first FROM fla f JOIN fco ON node = node_id CROSS JOIN hdr)""",
    "reg": """
        SELECT CAST(row_number() OVER (ORDER BY component) - 1 AS INTEGER) AS id, CAST(component AS VARCHAR) AS component_id, count(*) AS node_count, avg(z) AS height_mean,
               min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, avg(x) AS center_x, avg(y) AS center_y, avg(z) AS center_z,
               max(x) - min(x) + 0.1::DOUBLE AS size_x, max(y) - min(y) + 0.1::DOUBLE AS size_y, max(z) - min(z) AS size_z,
               array_to_string(list_sort(list(DISTINCT layer)), ',') AS slices, component
        FROM (SELECT component, layer, (col - dim_x / 2.0::DOUBLE) * 0.1::DOUBLE + center_x AS x, ("row" - dim_y / 2.0::DOUBLE) * 0.1::DOUBLE + center_y AS y, elev_g AS z FROM fcm, hdr)
        GROUP BY component HAVING count(*) >= 20""",
    "iou": """
        SELECT a, b, i / (va + vb - i) AS iou FROM (
            SELECT p.id AS a, q.id AS b,
                   greatest(0, least(p.max_x, q.max_x) - greatest(p.min_x, q.min_x)) * greatest(0, least(p.max_y, q.max_y) - greatest(p.min_y, q.min_y)) * greatest(0, least(p.max_z, q.max_z) - greatest(p.min_z, q.min_z)) AS i,
                   (p.max_x - p.min_x) * (p.max_y - p.min_y) * (p.max_z - p.min_z) AS va, (q.max_x - q.min_x) * (q.max_y - q.min_y) * (q.max_z - q.min_z) AS vb
            FROM reg p, reg q WHERE p.id <> q.id
        ) WHERE i > 0""",
    "rnk": "SELECT *, row_number() OVER (ORDER BY node_count DESC, id) AS k FROM reg",
    "ded": """
        SELECT 0::BIGINT AS step, CAST([] AS INTEGER[]) AS kept
        UNION ALL
        SELECT step + 1, CASE WHEN EXISTS (SELECT 1 FROM iou WHERE iou.a = r.id AND list_contains(kept, iou.b)) THEN kept ELSE list_append(kept, r.id) END
        FROM ded JOIN rnk r ON r.k = step + 1""",
    "isl": """
        SELECT *, sum(opens) OVER (ORDER BY min_z, max_z, id ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, CASE WHEN min_z - max(max_z) OVER (ORDER BY min_z, max_z, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.5::DOUBLE THEN 0 ELSE 1 END AS opens FROM reg)""",
    "way": """
        SELECT CAST(s_suppkey AS BIGINT) AS pos, s_name AS name, (s_suppkey * 37 % 91) * 0.1::DOUBLE AS x, (10 + s_suppkey * 17 % 51) * 0.1::DOUBLE AS y, 3.0::DOUBLE * (s_suppkey % 3) AS z,
               s_nationkey * 0.05::DOUBLE AS radius FROM supplier""",
    "prs": """
        SELECT CAST(o_orderkey AS BIGINT) AS pair_index, (o_orderkey * 29 % 91) * 0.1::DOUBLE AS sx, (o_orderkey * 13 % 61) * 0.1::DOUBLE AS sy, 3.0::DOUBLE * (o_orderkey % 3) AS sz,
               (o_custkey * 31 % 91) * 0.1::DOUBLE AS gx, (o_custkey * 19 % 61) * 0.1::DOUBLE AS gy, 3.0::DOUBLE * (o_custkey % 3) AS gz FROM orders""",
    "nxy": 'SELECT n.*, (col - dim_x / 2.0::DOUBLE) * 0.1::DOUBLE + center_x AS x, ("row" - dim_y / 2.0::DOUBLE) * 0.1::DOUBLE + center_y AS y FROM nod n, hdr',
    "end_": "SELECT pair_index, 's' AS e, sx AS x, sy AS y, sz AS z FROM prs UNION ALL SELECT pair_index, 'g', gx, gy, gz FROM prs",
    "nea": """
        SELECT pos, node_id, d2 FROM (
            SELECT w.pos, n.node_id, round((w.x - n.x) ** 2 + (w.y - n.y) ** 2 + (w.z - n.elev_g) ** 2, 9) AS d2,
                   row_number() OVER (PARTITION BY w.pos ORDER BY round((w.x - n.x) ** 2 + (w.y - n.y) ** 2 + (w.z - n.elev_g) ** 2, 9), node_id) AS k FROM way w, nxy n
        ) WHERE k = 1""",
    "hts": "SELECT layer, slice_h0 + s * 0.5::DOUBLE AS h FROM kep, hdr",
    "grd": """
        SELECT pos AS query_id, CAST(greatest(0, (SELECT count(*) FROM hts WHERE h <= z) - 1) AS INTEGER) AS layer,
               CAST(round_even((y - center_y) / 0.1::DOUBLE + dim_y / 2.0::DOUBLE, 0) AS INTEGER) AS "row", CAST(round_even((x - center_x) / 0.1::DOUBLE + dim_x / 2.0::DOUBLE, 0) AS INTEGER) AS col
        FROM way, hdr""",
    "rin": """
        SELECT query_id, node_id, d2 FROM (
            SELECT query_id, n.node_id, (n."row" - q."row") ** 2 + (n.col - q.col) ** 2 AS d2,
                   row_number() OVER (PARTITION BY query_id ORDER BY greatest(abs(n."row" - q."row"), abs(n.col - q.col)), (n."row" - q."row") ** 2 + (n.col - q.col) ** 2, trav, n."row" - q."row", n.col - q.col) AS k
            FROM grd q JOIN nod n ON n.layer = q.layer WHERE greatest(abs(n."row" - q."row"), abs(n.col - q.col)) <= 80
        ) WHERE k = 1""",
    "snx": """
        SELECT x, y, z, min({'d': d2, 'n': node_id}).n AS node_id FROM (
            SELECT w.x, w.y, w.z, n.node_id, round((w.x - n.x) ** 2 + (w.y - n.y) ** 2 + (w.z - n.elev_g) ** 2, 9) AS d2 FROM (SELECT DISTINCT x, y, z FROM end_) w, nxy n
        ) GROUP BY x, y, z""",
    "snp": """
        SELECT pair_index, max(CASE WHEN e = 's' THEN node_id END) AS start_id, max(CASE WHEN e = 'g' THEN node_id END) AS goal_id FROM end_ JOIN snx USING (x, y, z) GROUP BY pair_index""",
    "gre": """
        SELECT x, y, z, CAST(greatest(0, (SELECT count(*) FROM hts WHERE h <= z) - 1) AS INTEGER) AS layer,
               CAST(round_even((y - center_y) / 0.1::DOUBLE + dim_y / 2.0::DOUBLE, 0) AS INTEGER) AS "row", CAST(round_even((x - center_x) / 0.1::DOUBLE + dim_x / 2.0::DOUBLE, 0) AS INTEGER) AS col
        FROM (SELECT DISTINCT x, y, z FROM end_), hdr""",
    "grn": """
        SELECT x, y, z, min({'r': greatest(abs(n."row" - q."row"), abs(n.col - q.col)), 'd': (n."row" - q."row") ** 2 + (n.col - q.col) ** 2, 't': trav, 'a': n."row" - q."row", 'b': n.col - q.col, 'n': node_id}).n AS node_id
        FROM gre q JOIN nod n ON n.layer = q.layer WHERE greatest(abs(n."row" - q."row"), abs(n.col - q.col)) <= 80 GROUP BY x, y, z""",
    "grp": """
        SELECT * FROM (SELECT pair_index, max(CASE WHEN e = 's' THEN node_id END) AS start_id, max(CASE WHEN e = 'g' THEN node_id END) AS goal_id FROM end_ JOIN grn USING (x, y, z) GROUP BY pair_index)
        WHERE start_id IS NOT NULL AND goal_id IS NOT NULL""",
    "unq": "SELECT r.* FROM reg r, (SELECT kept FROM ded ORDER BY step DESC LIMIT 1) WHERE list_contains(kept, id)",
    "iun": """
        SELECT *, CASE WHEN min_z - max(max_z) OVER (ORDER BY min_z, max_z, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.5::DOUBLE THEN 0 ELSE 1 END AS opens FROM unq""",
    "wpr": "SELECT s.pos AS spos, s.name AS sname, s.x AS sx, s.y AS sy, s.z AS sz, g.pos AS gpos, g.name AS gname, g.x AS gx, g.y AS gy, g.z AS gz FROM way s JOIN way g ON s.pos < g.pos",
    "wlb": "SELECT pos, label FROM nea JOIN com ON node = node_id",
    "rch": "SELECT spos, gpos, sname, gname, a.label = b.label AS reachable FROM wpr JOIN wlb a ON a.pos = spos JOIN wlb b ON b.pos = gpos",
}
KEYED = {"com": "(node, label) USING KEY (node)", "fco": "(node, label) USING KEY (node)"}

BOX = ", ".join(map(R6, ("min_x", "max_x", "min_y", "max_y", "min_z", "max_z", "center_x", "center_y", "center_z", "size_x", "size_y", "size_z", "height_mean")))
_CORNERS = [("min", "min", "min"), ("max", "min", "min"), ("max", "max", "min"), ("min", "max", "min"), ("min", "min", "max"), ("max", "min", "max"), ("max", "max", "max"), ("min", "max", "max")]
_EDGES = [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)]
WIRES = " UNION ALL ".join(
    f"SELECT id, {i} AS edge, " + ", ".join(f"round({side}_{v}, 9) AS {p}{v}" for p, k in (("a", a), ("b", b)) for side, v in zip(_CORNERS[k], "xyz", strict=True)) + " FROM reg" for i, (a, b) in enumerate(_EDGES)
)
MERGED = " , ".join(f"round(CASE WHEN count(*) = 1 THEN max({{0}}_{v}) ELSE {{1}} END, 9) AS {{0}}_{v}" for v in "xyz")

QUERIES: dict[str, str] = {
    "cloud_header": f"SELECT n_points, {R6('center_x')}, {R6('center_y')}, dim_x, dim_y, n_slice, slice_h0 FROM hdr",
    "cloud_bounds": "SELECT count(*) AS n_points, " + ", ".join(f"round({f}({c}), 9) AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + " FROM pts",
    "cloud_cells": "SELECT cx, cy, count(*) AS points FROM inr GROUP BY cx, cy",
    "slice_heights": "SELECT s, round(slice_h0 + s * 0.5::DOUBLE, 9) AS height FROM sli, hdr WHERE s < n_slice",
    "voxel_bucket_extremes": f"SELECT cx, cy, s, {R6('z_max')}, {R6('z_min')} FROM buc",
    "voxel_ground_ceiling": f"SELECT s, cx, cy, {R6('g')}, {R6('c')}, round(c - g, 9) AS clearance FROM vox WHERE g IS NOT NULL",
    "voxel_downsample": """
        SELECT round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS n_points
        FROM pts, (SELECT min(x) - 0.1::DOUBLE / 2 AS x0, min(y) - 0.1::DOUBLE / 2 AS y0, min(z) - 0.1::DOUBLE / 2 AS z0 FROM pts)
        GROUP BY floor((x - x0) / 0.1::DOUBLE), floor((y - y0) / 0.1::DOUBLE), floor((z - z0) / 0.1::DOUBLE)""",
    "gradient": "SELECT s, cx, cy, CASE WHEN sq > 1e6 THEN -1 ELSE round(sq, 9) END AS sq, CASE WHEN mx > 1e6 THEN -1 ELSE round(mx, 9) END AS mx FROM gra WHERE occ",
    "standable_count": "SELECT s, cx, cy, CAST(standable AS BIGINT) AS standable FROM sta WHERE occ",
    "traversability_cost": f"SELECT s, cx, cy, {R6('cost')} FROM cst WHERE occ",
    "inflated_cost": f"SELECT s, cx, cy, {R6('t')} FROM inf WHERE occ",
    "cost_gradient": """
        SELECT s, cx, cy, round(CASE WHEN cx BETWEEN 1 AND dim_x - 2 THEN xb - xa ELSE 0 END, 9) AS gx, round(CASE WHEN cy BETWEEN 1 AND dim_y - 2 THEN yb - ya ELSE 0 END, 9) AS gy
        FROM (SELECT i.*, lag(t) OVER wx AS xa, lead(t) OVER wx AS xb, lag(t) OVER wy AS ya, lead(t) OVER wy AS yb
              FROM inf i JOIN kep USING (s) WINDOW wx AS (PARTITION BY s, cy ORDER BY cx), wy AS (PARTITION BY s, cx ORDER BY cy)), hdr
        WHERE occ AND near""",
    "layer_next": "SELECT l, m FROM nxt",
    "layer_keep": "SELECT layer, s FROM kep",
    "gateways": "SELECT layer, cx, cy, gateway FROM gat WHERE gateway <> 0",
    "sparse_nodes": f'SELECT node_id, layer, "row", col, {R6("trav")}, {R6("elev_g")}, {R6("elev_c")}, gateway FROM nod',
    "map_stats": """
        SELECT k * dim_x * dim_y AS dense_cells, occupied_cells, sparse_nodes, gateways, round(sparse_nodes / CAST(k * dim_x * dim_y AS DOUBLE), 9) AS sparse_ratio
        FROM hdr, (SELECT count(*) AS k FROM kep), (SELECT count(g) AS occupied_cells FROM lay), (SELECT count(*) AS sparse_nodes, count(CASE WHEN gateway <> 0 THEN 1 END) AS gateways FROM nod)""",
    "visible_surface": """
        SELECT layer, round((cx - dim_x / 2.0::DOUBLE) * 0.1::DOUBLE + center_x, 9) AS x, round((cy - dim_y / 2.0::DOUBLE) * 0.1::DOUBLE + center_y, 9) AS y, round(g, 9) AS z, round(cost, 9) AS cost
        FROM vis, hdr WHERE NOT hidden AND g IS NOT NULL""",
    "same_layer_edges": "SELECT src, dst FROM sam",
    "cross_layer_edges": "SELECT src, dst FROM crs",
    "graph_edges": f"SELECT src, dst, {R6('weight')} FROM edg",
    "edge_direction_counts": "SELECT 'same_layer' AS kind, count(*) AS edges FROM sam HAVING count(*) > 0 UNION ALL SELECT 'cross_layer', count(*) FROM crs HAVING count(*) > 0",
    "component_labels": "SELECT node AS node_id, label AS component FROM com",
    "component_sizes": "SELECT component, size FROM siz",
    "largest_component": f'SELECT node_id, layer, "row", col, {R6("trav")}, {R6("elev_g")}, {R6("elev_c")}, gateway FROM lar',
    "removed_nodes": "SELECT node_id FROM nod WHERE node_id NOT IN (SELECT node_id FROM lar)",
    "map_provenance": """
        SELECT 'adapter' AS input, 'same-layer neighbours and gateways' AS method, 35.0::DOUBLE AS cost_threshold, 0.5::DOUBLE AS step_max, n AS total_nodes, n AS active_nodes,
               big AS largest_nodes, n - big AS removed_nodes, components, (SELECT count(*) FROM sam) AS same_layer_edges, (SELECT count(*) FROM crs) AS cross_layer_edges
        FROM (SELECT count(*) AS n FROM nod), (SELECT max(size) AS big, count(*) AS components FROM siz)""",
    "ground_slope": f"SELECT node_id, {R6('slope')} FROM slo",
    "flat_cells": "SELECT node_id FROM fla",
    "flat_components": "SELECT node_id, component FROM fcm",
    "region_stats": f"SELECT id, component_id, node_count, {BOX}, slices FROM reg",
    "region_iou_pairs": "SELECT a, b, round(iou, 9) AS iou FROM iou WHERE a < b",
    "region_dedup": f"""
        SELECT CAST(list_position(kept, id) - 1 AS INTEGER) AS id, component_id, node_count, {BOX}, slices
        FROM reg, (SELECT kept FROM ded ORDER BY step DESC LIMIT 1) WHERE list_contains(kept, id)""",
    "region_zmerge": f"""
        SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS id, * EXCLUDE (first) FROM (
            SELECT min(id) AS first, string_agg(component_id, ',' ORDER BY id) AS component_id, CAST(sum(node_count) AS BIGINT) AS node_count,
                   round(sum(center_z * node_count) / sum(node_count), 9) AS height_mean,
                   {", ".join(f"round({f}({f}_{v}), 9) AS {f}_{v}" for v in "xyz" for f in ("min", "max"))},
                   {", ".join(f"round(sum(center_{v} * node_count) / sum(node_count), 9) AS center_{v}" for v in "xyz")},
                   {", ".join(f"round(CASE WHEN count(*) = 1 THEN max(size_{v}) ELSE max(max_{v}) - min(min_{v}) END, 9) AS size_{v}" for v in "xyz")},
                   array_to_string(list_sort(list_distinct(flatten(list(list_transform(string_split(slices, ','), lambda v: CAST(v AS INTEGER)))))), ',') AS slices
            FROM isl GROUP BY island)""",
    "bbox_wireframe": WIRES,
    "region_labels": """
        SELECT id, round(center_x, 9) AS x, round(center_y, 9) AS y, round(center_z + 0.2::DOUBLE, 9) AS z,
               printf('id:%d comp:%s', id, component_id) || chr(10) || printf('nodes:%d', node_count) || chr(10) || printf('z:[%.2f, %.2f]', min_z, max_z) AS text FROM reg""",
    "region_centers": "SELECT id, round(center_x, 9) AS x, round(center_y, 9) AS y, round(center_z, 9) AS z FROM reg",
    "nearest_node": "SELECT pos AS query_id, node_id, round(sqrt(d2), 9) AS dist FROM nea",
    "world_to_grid": 'SELECT query_id, layer, "row", col FROM grd',
    "ring_snap": "SELECT query_id, node_id, round(sqrt(d2), 9) AS dist FROM rin",
    "snapped_pairs": "SELECT pair_index, start_id, goal_id FROM snp",
    "snapped_pairs_grid": "SELECT pair_index, start_id, goal_id FROM grp",
    "path_ends": "SELECT s.pair_index, start_id, goal_id FROM snp s JOIN com a ON a.node = start_id JOIN com b ON b.node = goal_id WHERE a.label = b.label",
    "planned_legs": """
        SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS leg, label = next_label AS planned
        FROM (SELECT pos, label, lead(label) OVER (ORDER BY pos) AS next_label FROM wlb) WHERE next_label IS NOT NULL""",
    "region_summary": """
        SELECT n AS total_nodes, n AS active_nodes, (SELECT count(DISTINCT component) FROM fcm) AS flat_components, r AS large_components, r AS regions_before_dedup, u AS regions_after_dedup,
               u AS regions_before_merge, m AS regions_after_merge, m AS output_regions
        FROM (SELECT count(*) AS n FROM nod), (SELECT count(*) AS r FROM reg), (SELECT count(*) AS u, CAST(sum(opens) AS BIGINT) AS m FROM iun)""",
    "cloud_file": f"SELECT {R6('x')}, {R6('y')}, {R6('z')} FROM pts",
    "map_file": """
        SELECT node_id, layer, "row", col, round(CAST(CAST(trav AS FLOAT) AS DOUBLE), 9) AS trav, round(CAST(CAST(elev_g AS FLOAT) AS DOUBLE), 9) AS elev_g,
               round(CAST(CAST(elev_c AS FLOAT) AS DOUBLE), 9) AS elev_c, gateway FROM nod""",
    "map_header_file": """
        SELECT 'tomogram_sparse_v1' AS format, k || ',' || dim_y || ',' || dim_x AS shape, 0.1::DOUBLE AS resolution, slice_h0, 0.5::DOUBLE AS slice_dh, CAST(k AS INTEGER) AS layers
        FROM hdr, (SELECT count(*) AS k FROM kep)""",
    "dense_file": f"SELECT s, cx, cy, {R6('g')}, round(CASE WHEN c < 1e6 THEN c END, 9) AS c, {R6('t')} FROM inf WHERE occ",
    "waypoints_file": f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, name, {R6('x')}, {R6('y')}, {R6('z')}, {R6('radius')} FROM way",
    "pairs_file": """
        SELECT row_number() OVER (ORDER BY pos) - 1 AS pair_index, round(x, 9) AS sx, round(y, 9) AS sy, round(z, 9) AS sz, round(x2, 9) AS gx, round(y2, 9) AS gy, round(z2, 9) AS gz, pos AS task
        FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM way WINDOW w AS (ORDER BY pos)) WHERE x2 IS NOT NULL""",
    "path_file": f"SELECT {R6('x')}, {R6('y')}, {R6('z')} FROM way",
    "regions_file": """
        SELECT id, component_id, node_count, round(height_mean, 9) AS height_mean, round(min_z, 9) AS height_min, round(max_z, 9) AS height_max, round(min_x, 9) AS min_x, round(max_x, 9) AS max_x,
               round(min_y, 9) AS min_y, round(max_y, 9) AS max_y, round(min_z, 9) AS min_z, round(max_z, 9) AS max_z, round(center_x, 9) AS center_x, round(center_y, 9) AS center_y, round(center_z, 9) AS center_z, slices FROM reg""",
    "failed_pairs": "SELECT s.pair_index FROM snp s JOIN com a ON a.node = start_id JOIN com b ON b.node = goal_id WHERE a.label <> b.label",
    "batch_success": "SELECT count(*) AS pairs, count(CASE WHEN a.label = b.label THEN 1 END) AS planned FROM snp s JOIN com a ON a.node = start_id JOIN com b ON b.node = goal_id",
    "event_path_lengths": """
        SELECT path_id, count(*) AS n_points, round(coalesce(sum(sqrt(dx * dx + dy * dy)), 0), 9) AS length FROM (
            SELECT CAST(user_id AS BIGINT) AS path_id, value * 0.01::DOUBLE - lag(value * 0.01::DOUBLE) OVER w AS dx, (event_id % 61) * 0.1::DOUBLE - lag((event_id % 61) * 0.1::DOUBLE) OVER w AS dy
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY path_id""",
    "waypoint_pairs": "SELECT spos, sname, " + ", ".join(map(R6, ("sx", "sy", "sz"))) + ", gpos, gname, " + ", ".join(map(R6, ("gx", "gy", "gz"))) + " FROM wpr",
    "unreachable_pairs": "SELECT spos, gpos, sname, gname FROM rch WHERE NOT reachable",
    "reachability_counts": "SELECT count(*) AS pairs, count(CASE WHEN reachable THEN 1 END) AS reachable, count(CASE WHEN NOT reachable THEN 1 END) AS unreachable FROM rch",
    "waypoint_legs": """
        SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS leg, pos AS from_pos, p2 AS to_pos, """
    + ", ".join(f"round({v}, 9) AS s{v}" for v in "xyz")
    + ", "
    + ", ".join(f"round({v}2, 9) AS g{v}" for v in "xyz")
    + " FROM (SELECT *, lead(pos) OVER w AS p2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM way WINDOW w AS (ORDER BY pos)) WHERE p2 IS NOT NULL",
    "waypoint_markers": " UNION ALL ".join(f"SELECT '{k}' AS kind, pos, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, round(radius, 9) AS size, name AS text FROM way" for k in ("line", "sphere", "label"))
    + " UNION ALL SELECT 'disk', pos, round(x, 9), round(y, 9), round(z, 9), round(radius, 9), name FROM way WHERE radius > 0",
    "sparse_cloud_view": f"SELECT node_id, {R6('x')}, {R6('y')}, round(elev_g, 9) AS z, {R6('trav')}, gateway FROM nxy",
    "raw_cloud_view": f"SELECT {R6('x')}, {R6('y')}, {R6('z')}, 0.0::DOUBLE AS intensity FROM pts",
}
QUERIES["cost_gradient"] = QUERIES["cost_gradient"].replace(" AND near", "")


def _needs(sql: str) -> set[str]:
    return {w for w in re.findall(r"\b\w+\b", sql) if w in PARTS}


def sql_of(name: str) -> str:
    """The query with the parts it needs, in the order in which they are defined."""
    needed, todo = set(), _needs(QUERIES[name])
    while todo:
        part = todo.pop()
        needed.add(part)
        todo |= _needs(PARTS[part]) - needed
    # parts that several others read are worked out once
    heads = [f"{p}{KEYED.get(p, '')} AS {'' if p in KEYED or p in ('chn', 'ded') else 'MATERIALIZED '}({PARTS[p].strip()})" for p in PARTS if p in needed]
    return (f"WITH RECURSIVE {', '.join(heads)} " if heads else "") + QUERIES[name].strip()


def all_sql() -> dict[str, str]:
    return {name: sql_of(name) for name in QUERIES}
