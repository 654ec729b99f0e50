"""Path requests as a stream over a static map: an extension, the batch planner applied to each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strata.operators import graph, route
from strata.plans.pipelines import Map
from strata.session import written


def serve(requests: DataFrame, m: Map, out: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Answer a stream of (pair_index, sx, sy, sz, gx, gy, gz) with the points of its paths, appended as Parquet by batch.

    The graph is written once and read by every batch. A batch that is run again after a failure overwrites its own
    folder, so each request is answered once.
    """
    edges = written(graph.graph_edges(m.nodes, m.scene, m.frame), "edges")

    def answer(batch: DataFrame, number: int) -> None:
        snapped = route.snapped_pairs(batch, m.nodes, m.scene, m.frame)
        points = route.path_points(route.search_paths(snapped, m.nodes, edges), m.nodes, m.scene, m.frame)
        points.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
