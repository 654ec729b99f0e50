"""What every query needs from a session: the package on the workers, a shared folder for cut lineage, table reads."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application; workers that already have it on their path are unaffected."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    name = Path(tempfile.mkdtemp(prefix="strata-")) / "strata_pkg.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(name))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process, as in tests, a folder of this machine stands in."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"strata-shared-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/strata/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and any executor can be lost afterwards."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by written() that nothing will read again, through Hadoop's file system API, so any store works."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(t._written_path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
