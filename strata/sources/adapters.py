"""Point clouds, waypoints, pairs and paths made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import Scene
from strata.session import table

SCENE = Scene(min_nodes=20)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three floors joined by a ramp with landings, with walls: one point for each order line."""
    t = table(spark, sf_dir, "lineitem")
    p = t.select((F.col("l_partkey") % 91).alias("gx"), (F.col("l_orderkey") % 61).alias("gy"), (F.col("l_linenumber") % 3).alias("lv"), F.col("l_quantity").cast("int").alias("q"))
    rise = lambda at: F.greatest(F.lit(0), F.least(F.lit(3000), 100 * (F.col("gx") - at)))
    wall = (F.col("gx") % 20 == 10) & (F.col("gy") >= 20) & (F.col("gy") < 50)
    z = F.when(F.col("gy") < 10, rise(10) + rise(50)).when(wall, 3000 * F.col("lv") + 40 * F.col("q")).otherwise(3000 * F.col("lv") + 10 * (F.col("q") % 5))
    return p.select((F.col("gx") * F.lit(0.1)).alias("x"), (F.col("gy") * F.lit(0.1)).alias("y"), (z / F.lit(1000.0)).alias("z"))


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return t.select(
        k.cast("long").alias("pos"),
        F.col("s_name").alias("name"),
        ((k * 37 % 91) * F.lit(0.1)).alias("x"),
        ((10 + k * 17 % 51) * F.lit(0.1)).alias("y"),
        (F.lit(3.0) * (k % 3)).alias("z"),
        (F.col("s_nationkey") * F.lit(0.05)).alias("radius"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    point = lambda k, a, b: (((k * a % 91) * F.lit(0.1)), ((k * b % 61) * F.lit(0.1)), F.lit(3.0) * (k % 3))
    (sx, sy, sz), (gx, gy, gz) = point(o, 29, 13), point(c, 31, 19)
    return t.select(
        o.cast("long").alias("pair_index"),
        sx.alias("sx"),
        sy.alias("sy"),
        sz.alias("sz"),
        gx.alias("gx"),
        gy.alias("gy"),
        gz.alias("gz"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("extra"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path for each user, through its events in order of time."""
    t = table(spark, sf_dir, "events")
    return t.select(
        F.col("user_id").cast("long").alias("path_id"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        (F.col("value") * F.lit(0.01)).alias("x"),
        ((F.col("event_id") % 61) * F.lit(0.1)).alias("y"),
        F.lit(0.0).alias("z"),
    )
