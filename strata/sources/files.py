"""Maps, waypoints, pairs, paths, regions and trajectories as files. Spark's committers publish a folder only when it is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.schema import HEADER, NODES, PATH_POINT, REGIONS_DOCUMENT, WAYPOINT, MapFormatError, validate_map


def write_map(header: DataFrame, nodes: DataFrame, path: str) -> None:
    """The sparse map: a header of one row and the node table, attributes in single precision."""
    names = [f.split()[0] for f in NODES.split(", ")]
    kinds = [f.split()[1] for f in NODES.split(", ")]
    header.write.mode("overwrite").parquet(f"{path}/header")
    nodes.select(*(F.col(n).cast(k) for n, k in zip(names, kinds, strict=True))).write.mode("overwrite").parquet(f"{path}/nodes")


def read_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header and nodes; a folder that isn't such a map is refused, NaN becomes null."""
    header, nodes = spark.read.parquet(f"{path}/header"), spark.read.parquet(f"{path}/nodes")
    validate_map(header, nodes)
    wanted = {f.split()[0]: f.split()[1] for f in HEADER.split(", ")}
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in nodes.dtypes]
    return header.select(*wanted), nodes.select(*clean)


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """A legacy dense map saved as rows (channel, s, cy, cx, value): s, cx, cy, g, c, t of the voxels that have ground."""
    d = spark.read.parquet(path)
    if not {"channel", "s", "cy", "cx", "value"} <= set(d.columns):
        raise MapFormatError("a dense map has the columns channel, s, cy, cx, value")
    at = lambda k: F.max(F.when(F.col("channel") == k, F.when(~F.isnan("value"), F.col("value").cast("double"))))
    return d.groupBy("s", "cx", "cy").agg(at(3).alias("g"), at(4).alias("c"), at(0).alias("t")).where("g is not null")


def read_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """pos, name, x, y, z, radius of a JSON list; every pose must have three numbers."""
    fields = ", ".join(f.replace(" ", ": ", 1) for f in WAYPOINT.split(", "))
    items = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{fields}>>").alias("items"))
    rows = items.select(F.posexplode("items").alias("pos", "w")).select(F.col("pos").cast("long").alias("pos"), "w.*")
    checked = F.when(F.coalesce(F.size("pose") == 3, F.lit(False)), F.col("pose")).otherwise(F.raise_error(F.concat(F.lit("waypoint "), F.col("pos").cast("string"), F.lit(" has no pose of three numbers"))))
    return rows.select("pos", "name", checked.alias("pose"), "radius").select("pos", "name", *(F.col("pose")[i].alias(v) for i, v in enumerate("xyz")), "radius")


def waypoint_by_name(waypoints: DataFrame, name: str) -> tuple[float, float, float]:
    """The first waypoint of that name; the error lists the names there are."""
    row = waypoints.where(F.col("name") == name).orderBy("pos").select("x", "y", "z").first()
    if row is None:
        names = [r["name"] for r in waypoints.select("name").distinct().orderBy("name").limit(50).collect()]
        raise KeyError(f"no waypoint {name!r}; there are {names}")
    return tuple(row)


def json_kind(spark: SparkSession, path: str) -> str:
    """pairs or waypoints, by the keys of the first element."""
    first = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$[0].start").alias("start"), F.get_json_object("value", "$[0].pose").alias("pose")).first()
    if first and first["start"] is not None:
        return "pairs"
    if first and first["pose"] is not None:
        return "waypoints"
    raise ValueError(f"{path} holds neither pairs nor waypoints")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """pair_index, start and goal coordinates, and a map of all other keys as JSON text."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("pair_index", "m"))
    point = lambda k: F.from_json(F.col("m")[k], "array<double>")
    d = rows.select(F.col("pair_index").cast("long").alias("pair_index"), point("start").alias("s"), point("goal").alias("g"), F.map_filter("m", lambda k, _: ~k.isin("start", "goal")).alias("extra"))
    ok = (F.size("s") == 3) & (F.size("g") == 3)
    s = F.when(F.coalesce(ok, F.lit(False)), F.col("s")).otherwise(F.raise_error(F.lit("a pair needs a start and a goal of three numbers")))
    return d.withColumn("s", s).select("pair_index", *(F.col("s")[i].alias(f"s{v}") for i, v in enumerate("xyz")), *(F.col("g")[i].alias(f"g{v}") for i, v in enumerate("xyz")), "extra")


def nth_pair(pairs: DataFrame, index: int) -> DataFrame:
    d = pairs.where(F.col("pair_index") == index)
    if not d.limit(1).count():
        raise IndexError(f"no pair {index}")
    return d


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of a CSV with a header; a row that isn't three numbers, or no row, is an error."""
    d = spark.read.csv(path, header=True, schema=PATH_POINT, mode="FAILFAST", enforceSchema=False)
    if not d.limit(1).count():
        raise ValueError(f"{path} holds no point")
    return d


def write_path(points: DataFrame, path: str, kind: str | None = None) -> None:
    """By kind, or by the ending of the path: csv with a header, parquet, pcd, json, or text."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    p = points.orderBy("seq").select("x", "y", "z")
    if kind == "pcd":
        from strata.sources.pcd import write_pcd

        write_pcd(p, path)
    elif kind == "csv":
        p.write.mode("overwrite").csv(path, header=True)
    elif kind in ("parquet", "npy", "pkl", "pickle"):
        p.write.mode("overwrite").parquet(path)
    elif kind == "json":
        p.write.mode("overwrite").json(path)
    else:
        p.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz"))).write.mode("overwrite").text(path)


def write_json_lines(records: DataFrame, path: str, column: str = "json") -> None:
    records.select(column).write.mode("overwrite").text(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """A region report, current or older, every field nullable; a component_id of one number counts as a list of one."""
    text = spark.read.text(path, wholetext=True)
    listed = F.regexp_replace("value", r'"component_id"\s*:\s*(\d+)', r'"component_id":[$1]')
    schema = "struct<" + REGIONS_DOCUMENT.replace("regions array", "regions: array").replace(" summary struct", " summary: struct").replace(" source string", " source: string").replace(" params map", " params: map") + ">"
    return text.select(F.from_json(listed, schema).alias("d")).select("d.*")
