"""Mixture-controlled packing (operator 6).

Every source is a queue: the ids of its documents end to end, in the order in which the encoded table was written.
Deficit round-robin serves the queues through a tree: at each node two groups of queues take turns. After p turns the one
has had floor(p * its share) of them; the fraction that rounding leaves over is its deficit and stays with it, across
windows and partitions. The turns of a window are laid out source by source, so each source has one piece there.

What a queue has had by any turn, and the turn of any of its ids, follow in closed form from the sizes along its path in
the tree. So any task can place any document from a few numbers that are joined to it; nobody waits, no task needs to
know the other queues, and the number of sources is free. In every window a source has its target share to less than one
id for each level of the tree, and all windows but the last are full.

By default the target shares are those of the sources themselves, and all queues run dry together. With given weights
the queues run dry one after the other; each time the others share on by their weights, under a tree of their own.
Sources without a weight follow at the end, in the shares of their sizes.

Two passes: encode and write (doc, queue, ids, place within its partition); add the partitions up, then cut. Ids are
shuffled only where the table of sums by partition and source is too large to broadcast.

Cases: null text counts as empty and gives one piece with the end id; null source is a queue of its own; texts of any
length are cut freely; repeated rows are packed each; an empty table gives an empty table; other columns take no part;
weights that aren't whole numbers over 0 raise an error.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from strata.llm.common import slices
from strata.llm.fast_ids import fast_ids
from strata.session import discard, written

WINDOW = 2048
NO_SOURCE = "\0none"


def encode_queues(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, queue, part, local_start, n, ids (binary): written to the shared folder, so that the order of the queues is fixed."""
    kind = dict(docs.dtypes)[id_col]
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("queue"))

    def run(batches):
        t, part, before = fast_ids(tokenizer_path), TaskContext.get().partitionId(), {}
        wide = 2 if max(t.size, end_id) < 1 << 16 else 4  # bytes for each id in the written table
        end = int(end_id).to_bytes(wide, "little")
        for b in slices(batches):
            ids = [x.astype(f"<u{wide}").tobytes() + end for x in t.encode(b.column(1).to_pylist())]
            start = []
            for q, x in zip(b.column(2).to_pylist(), ids, strict=True):
                start.append(before.get(q, 0))
                before[q] = start[-1] + len(x) // wide
            n = pa.array([len(x) // wide for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.full(len(ids), part, np.int32)), pa.array(start, pa.int64()), n, pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "local_start", "n", "ids"])

    return written(df.mapInArrow(run, f"doc_id {kind}, queue string, part int, local_start long, n long, ids binary"), "packing")


def times(p: np.ndarray, a: np.ndarray, n: np.ndarray, less: int = 0) -> np.ndarray:
    """floor((p * a - less) / n) for 64-bit numbers whose result is under 2^50: an estimate, set right by a remainder that wraps around."""
    q = (p * (a / n)).astype(np.int64)
    return q + (p * a - less - q * n) // n


class Lanes:
    """The ways through the tree of several queues: a row for each queue, a column for each level.

    turns: of the node, share: turns of the child on the way, second: whether it is the second child. A way that is
    shorter than others goes on through nodes of one child.
    """

    def __init__(self, turns: list[list[int]], share: list[list[int]], second: list[list[bool]]):
        depth = max(map(len, turns), default=0)
        fill = lambda rows, value: np.array([[*r, *[value] * (depth - len(r))] for r in rows], np.int64).reshape(len(rows), depth)
        self.turns, self.share, self.second = fill(turns, 1), fill(share, 1), fill(second, 0).astype(bool)

    def turn(self, row: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The turn at the root in which id number j of its queue is served."""
        for d in range(self.turns.shape[1] - 1, -1, -1):
            n, c, second = self.turns[row, d], self.share[row, d], self.second[row, d]
            j = np.where(second, times(j, n, c), times(j + 1, n, c, 1))
        return j

    def had(self, row: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the queue has had after p turns at the root, and what all queues before it in the tree have had."""
        ahead = np.zeros(len(p), np.int64)
        for d in range(self.turns.shape[1]):
            n, c, second = self.turns[row, d], self.share[row, d], self.second[row, d]
            first = times(p, np.where(second, n - c, c), n)
            ahead += np.where(second, first, 0)
            p = np.where(second, p - first, first)
        return p, ahead

    def cut(self, row: np.ndarray, start: np.ndarray, end: np.ndarray, shift: np.ndarray, total: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
        """Pieces of the ids [start, end) of queues whose turns begin at place `shift`: which range, first id, length, sequence, offset there."""
        first, last = ((self.turn(row, x) + shift) // window for x in (start, end - 1))
        spread = last - first + 1 > 4 * (end - start)  # shares so small that it is less to look at each id
        windows = np.where(spread, 0, last - first + 1)
        at = np.repeat(np.arange(len(row)), windows)
        sequence = first[at] + np.arange(len(at)) - (np.cumsum(windows) - windows)[at]
        if spread.any():
            ids = np.where(spread, end - start, 0)
            of = np.repeat(np.arange(len(row)), ids)
            j = start[of] + np.arange(len(of)) - (np.cumsum(ids) - ids)[of]
            w = (self.turn(row[of], j) + shift[of]) // window
            new = np.ones(len(of), bool)
            new[1:] = (w[1:] != w[:-1]) | (of[1:] != of[:-1])
            at, sequence = np.append(at, of[new]), np.append(sequence, w[new])
        upto = lambda w: np.clip(w * window - shift[at], 0, total[at])
        low, ahead = self.had(row[at], upto(sequence))
        high, ahead_then = self.had(row[at], upto(sequence + 1))
        a, b = np.maximum(low, start[at]), np.minimum(high, end[at])
        offset = np.maximum(sequence * window, shift[at]) - sequence * window + ahead_then - ahead + a - low
        keep = b > a
        return at[keep], a[keep], (b - a)[keep], sequence[keep], offset[keep]


def phases(sizes: dict[str, int], weights: dict[str, int]) -> list[tuple[int, str, int, int]]:
    """(phase, queue, first id, number of ids): in each phase all queues that still have ids are served by their weights, until one runs dry."""
    if bad := [k for k, w in weights.items() if not isinstance(w, int) or w < 1]:
        raise ValueError(f"weights must be whole numbers over 0: {bad}")
    out, had, rounds = [], dict.fromkeys(sizes, 0), sorted({-(-s // weights[q]) for q, s in sizes.items()})
    for k, r in enumerate(rounds):
        for q, s in sizes.items():
            upto = min(s, r * weights[q])
            if upto > had[q]:
                out.append((k, q, had[q], upto - had[q]))
                had[q] = upto
    return out


def lanes(served: DataFrame) -> DataFrame:
    """Of (phase, queue, first, size): with shift, total, and turns, share, second, the queue's way through the tree of its phase.

    The tree splits queues by the bits of a hash of their names, so it is made by grouping. Nodes with one child are left out.
    """
    served = written(served.withColumn("h", F.xxhash64("queue")), "queues")
    if served.groupBy("phase", "h").count().where("count > 1").limit(1).count():
        raise ValueError("two sources have the same 64-bit hash")
    totals = served.groupBy("phase").agg(F.sum("size").alias("total"))
    totals = totals.select("phase", "total", (F.sum("total").over(Window.orderBy("phase")) - F.col("total")).alias("shift"))
    prefix = F.when(F.col("d") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(h, 64 - d)"))
    marked = served.select("phase", "queue", "h", "size", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("d")).withColumn("prefix", prefix)
    nodes = marked.groupBy("phase", "d", "prefix").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("queues"))
    sizes = marked.join(nodes, ["phase", "d", "prefix"]).select("phase", "queue", "h", "d", "n", "queues")
    steps = sizes.groupBy("phase", "queue").agg(F.sort_array(F.collect_list(F.struct("d", "n", "queues", "h"))).alias("s"))
    # a level counts where the child holds fewer queues than its node
    step = "struct(x.n AS turns, s[i + 1].n AS share, x.queues > s[i + 1].queues AS splits, (shiftrightunsigned(x.h, 63 - x.d) & 1) = 1 AS second)"
    levels = F.expr(f"filter(transform(slice(s, 1, 64), (x, i) -> {step}), x -> x.splits)")
    ways = steps.select("phase", "queue", levels.alias("l")).select("phase", "queue", *(F.col(f"l.{k}").alias(k) for k in ("turns", "share", "second")))
    out = written(served.drop("h").join(ways, ["phase", "queue"]).join(totals, "phase"), "lanes")
    discard(served)
    return out


def cut_pieces(encoded: DataFrame, weights: dict[str, int] | None = None, window: int = WINDOW, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue for each piece; weights: whole numbers by source, by default the sizes."""
    spark = encoded.sparkSession
    sums = encoded.groupBy("part", "queue").agg(F.sum("n").alias("size"))
    totals = sums.groupBy("queue").agg(F.sum("size").alias("size"))
    if weights is None:
        served = totals.select(F.lit(0).alias("phase"), "queue", F.lit(0).cast("long").alias("first"), "size")
    else:  # at most as many rows as there are weights come to the driver
        known = {NO_SOURCE if q is None else q: w for q, w in weights.items()}
        named = F.col("queue").isin(list(known))
        first = phases({r.queue: r.size for r in totals.where(named).collect()}, known)
        served = spark.createDataFrame(first, "phase int, queue string, first long, size long")
        served = served.unionByName(totals.where(~named).select(F.lit(len(first)).alias("phase"), "queue", F.lit(0).cast("long").alias("first"), "size"))
    base = sums.select("part", "queue", (F.sum("size").over(Window.partitionBy("queue").orderBy("part")) - F.col("size")).alias("base")).join(lanes(served), "queue")
    base = F.broadcast(base) if base.select("part").limit(broadcast_rows + 1).count() <= broadcast_rows else base
    at = F.col("base") + F.col("local_start") - F.col("first")
    df = encoded.join(base, ["part", "queue"]).withColumns({"begin": F.greatest(at, F.lit(0)), "end": F.least(at + F.col("n"), F.col("size")), "own": F.greatest(-at, F.lit(0))})
    df = df.where("begin < end").select("doc_id", "queue", "ids", "n", "begin", "end", "own", "phase", "shift", "total", "turns", "share", "second")
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches):
        for b in slices(batches, 500):
            seen: dict[tuple, int] = {}
            row, ways = [], []
            for i, key in enumerate(zip(b.column(7).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if key not in seen:
                    seen[key] = len(ways)
                    ways.append([b.column(k)[i].as_py() for k in (10, 11, 12)])
                row.append(seen[key])
            n, begin, end, own, shift, total = (b.column(k).to_numpy() for k in (3, 4, 5, 6, 8, 9))
            doc, first, length, sequence, offset = Lanes(*zip(*ways, strict=True)).cut(np.array(row), begin, end, shift, total, window)
            start = first - begin[doc] + own[doc]
            whole = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4").data for x, k in zip(b.column(2).to_pylist(), n.tolist(), strict=True)]
            crc = [zlib.crc32(whole[d][s : s + k]) for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc], sequence, offset)), b.column(1).take(pa.array(doc))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

    return df.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, weights: dict[str, int] | None = None, **columns: str) -> DataFrame:
    return cut_pieces(encode_queues(docs, tokenizer_path, end_id, **columns), weights)
