"""Schemas of the tables that enter and leave the engine, and the check of a map on load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMAT = "tomogram_sparse_v1"

POINTS = "x double, y double, z double"
NODES = "node_id long, layer int, row int, col int, trav float, elev_g float, elev_c float, gateway int"
HEADER = "format string, shape array<int>, resolution double, center array<double>, slice_h0 double, slice_dh double, slice_heights array<double>"
WAYPOINT = "name string, pose array<double>, radius double"
PATH_POINT = "x double, y double, z double"
REGION = (
    "struct<id:int, component_id:array<int>, node_count:bigint, height_mean:double, height_min:double, height_max:double, height_range:double, "
    "bbox:struct<min_x:double,max_x:double,min_y:double,max_y:double,min_z:double,max_z:double>, center:struct<x:double,y:double,z:double>, "
    "size:struct<x:double,y:double,z:double>, slices:array<int>>"
)
SUMMARY = (
    "struct<total_nodes:bigint, active_nodes:bigint, flat_components:bigint, large_components:bigint, regions_before_dedup:bigint, "
    "regions_after_dedup:bigint, regions_before_merge:bigint, regions_after_merge:bigint, output_regions:bigint, elapsed_seconds:double>"
)
REGIONS_DOCUMENT = f"regions array<{REGION}>, summary {SUMMARY}, source string, params map<string,double>"

REQUIRED_HEADER = ("format", "shape", "resolution", "center", "slice_h0", "slice_dh", "slice_heights")
REQUIRED_NODES = ("layer", "row", "col", "trav", "elev_g", "elev_c", "gateway")


class MapFormatError(ValueError):
    """A map that lacks its format tag, a key or a column, or whose parts disagree."""


def validate_map(header: DataFrame, nodes: DataFrame) -> None:
    """Fail on a wrong format tag, a missing key or column, or nodes outside the stated shape. One pass over the nodes."""
    missing = [c for c in REQUIRED_HEADER if c not in header.columns] + [c for c in REQUIRED_NODES if c not in nodes.columns]
    if missing:
        raise MapFormatError(f"the map lacks {', '.join(missing)}")
    rows = header.limit(2).collect()
    if len(rows) != 1 or rows[0]["format"] != FORMAT:
        raise MapFormatError(f"expected one header of format {FORMAT}, found {[r['format'] for r in rows]}")
    s, y, x = rows[0]["shape"]
    if len(rows[0]["slice_heights"]) != s:
        raise MapFormatError(f"{len(rows[0]['slice_heights'])} slice heights for {s} layers")
    inside = F.col("layer").between(0, s - 1) & F.col("row").between(0, y - 1) & F.col("col").between(0, x - 1)
    if outside := nodes.where(~F.coalesce(inside, F.lit(False))).limit(1).collect():
        raise MapFormatError(f"a node lies outside the shape {(s, y, x)}: {outside[0].asDict()}")
