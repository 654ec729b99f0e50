"""Point-cloud files in the PCD format: scan (ascii and binary, any point layout) and sink."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.schema import POINTS

KINDS = {"F": "f", "I": "i", "U": "u"}


def parse_pcd(data: bytes) -> dict[str, np.ndarray]:
    """x, y, z of one file, by the layout its header states. Compressed bodies are refused."""
    at, head = 0, {}
    while "DATA" not in head:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("a PCD file without a DATA line")
        line = data[at:end].decode("ascii", "replace").strip()
        at = end + 1
        if line and not line.startswith("#"):
            key, *values = line.split()
            head[key.upper()] = values
    fields, sizes, types = head["FIELDS"], head["SIZE"], head["TYPE"]
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(fields))]
    missing = {"x", "y", "z"} - set(fields)
    if missing:
        raise ValueError(f"a PCD file without {', '.join(sorted(missing))}")
    n = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    if head["DATA"][0] == "ascii":
        table = np.array(data[at:].split(), dtype="f8").reshape(-1, sum(counts))[:n]
        first = dict(zip(fields, np.cumsum([0, *counts[:-1]]), strict=True))
        return {c: table[:, first[c]] for c in "xyz"}
    if head["DATA"][0] != "binary":
        raise ValueError(f"PCD data {head['DATA'][0]} isn't supported")
    layout = np.dtype([(f"{name}_{i}", f"<{KINDS[t]}{s}", (c,)) for i, (name, t, s, c) in enumerate(zip(fields, types, sizes, counts, strict=True))])
    rows = np.frombuffer(data, layout, n, at)
    return {c: rows[f"{c}_{fields.index(c)}"][:, 0].astype("f8") for c in "xyz"}


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """The points of one file or of a folder of files; each file is parsed by the task that reads it."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.float64()) for c, v in parse_pcd(data).items()})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, POINTS)


def write_pcd(points: DataFrame, path: str) -> None:
    """One ascii PCD file per partition under the folder `path`, each with its own header."""

    def run(batches):
        lines = [f"{x:.9g} {y:.9g} {z:.9g}" for b in batches for x, y, z in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
        head = ["VERSION 0.7", "FIELDS x y z", "SIZE 4 4 4", "TYPE F F F", "COUNT 1 1 1", f"WIDTH {len(lines)}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {len(lines)}", "DATA ascii"]
        yield pa.RecordBatch.from_pydict({"value": pa.array(["\n".join(head + lines)], pa.string())})

    points.select(*(F.col(c).cast("double") for c in "xyz")).mapInArrow(run, "value string").write.text(path)
