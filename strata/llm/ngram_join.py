"""N-gram Jaccard join (operator 5): documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

1. One pass over the texts gives each document's set size and a digest of its set; equal sets form a class, and only
   classes go on. The same pass counts all shingles into a table whose size follows the input, up to a bound.
2. A second pass orders each set from rare to frequent by that table (ties by hash: one order for all) and emits only
   its prefix, n - ceil(0.75 n) + 1 shingles: two sets that link share a shingle of both prefixes.
3. Rows meet by shingle. Shingles of one class go. The others form buckets, and length and positional filters go over
   the pairs of a bucket with its anchor, the class with the fewest rare shingles. Each pair is verified once, after a
   suffix filter, on the exact sets. The links give components.
4. Buckets whose other classes now lie in one component are settled. In the rest, each class outside the bucket's largest
   component meets every class of another component, by a join on the shingle, through the same filters and a bound from
   signatures of the sets. So every pair that might link two components is verified, and no bucket is expanded into all
   its pairs.

Frequent shingles are known from the table. They skip the shuffle that looks for shingles of one class, and the joins on
them can be split, so a group of copies that holds a third of all rows loads no single task.

Keys that many rows share are dealt out: copies reach the answer by a broadcast of the classes with many rows, whose
number is bounded by the rows of a class; empty sets go around all joins; large open buckets are met in blocks.

Sets are compared by 64-bit hashes of their shingles, and a class is told by a 64-bit digest with the size of its set:
the join is exact up to a collision of those.

Cases: null and empty texts, and texts without words, have an empty set and link with nothing; fewer than five words are
one shingle; texts of any length are taken whole; rows that repeat a doc_id are each judged by their own text; an empty
table gives an empty table; other columns take no part. Rows with a null id link others, but jaccard_join gives no row
for them, as no result could name them; keep_one treats them like any other, as the last choice of a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from strata.llm.common import keyed_text, mix, slices
from strata.llm.shingles import shingle_sets, sort_each
from strata.operators.graph_core import connected_components
from strata.session import discard, written

CELLS = 1 << 18, 1 << 22
BYTES_A_CELL = 256
SIGNATURE = 16
RANGES = 16
HOT_CLASS = 50_000  # rows of a class that is joined by broadcast
BLOCK = 4096  # classes of an open bucket that meet the others at once
LOCAL_EDGES = 1_000_000  # contracted links, of 16 bytes, that one task finishes
#: Jaccard of at least 3/4, in whole numbers: 4 * intersection >= 3 * union.
UP, DOWN = 3, 4


def least_overlap(a, b):
    """The smallest intersection of sets of these sizes that link: ceil(3 / 7 * (a + b))."""
    return (UP * (a + b) + UP + DOWN - 1) // (UP + DOWN)


def cells_for(docs: DataFrame) -> int:
    """Cells of the counting table: a power of two that grows with the input, up to 16 MB of counts; beyond, a cell holds more shingles."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(CELLS[0], 1 << (size // BYTES_A_CELL).bit_length()), CELLS[1])


def cell(key: np.ndarray, cells: int) -> np.ndarray:
    return (key >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def digests(owner: np.ndarray, key: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of each set, whatever its order."""
    total = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        total[full] = np.add.reduceat(mix(key ^ np.uint64(0xA0761D6478BD642F)), (np.cumsum(sizes) - sizes)[full])
    return mix(total + sizes.astype(np.uint64)).view(np.int64)


def profile(texts: DataFrame, cells: int) -> DataFrame:
    """row, doc_id, th, n, digest of every document; besides, rows with the counts of each task (by range), told by row null."""

    def run(batches):
        counts, row = np.zeros(cells, np.uint32), TaskContext.get().partitionId() << 33
        for b in slices(batches):
            owner, key, sizes = shingle_sets(b.column(1))
            np.add.at(counts, cell(key, cells), np.uint32(1))
            none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            numbers = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([numbers, b.column(0), b.column(2), pa.array(sizes), pa.array(digests(owner, key, sizes)), *none], names=names)
        if counts.any():
            none = (pa.nulls(RANGES, pa.int64()),) * 5
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(RANGES), pa.int32()), pa.array([c.tobytes() for c in counts.reshape(RANGES, -1)], pa.binary())], names=names)

    names = ["row", "doc_id", "th", "n", "digest", "range", "cells"]
    return texts.select("doc_id", "text", "th").mapInArrow(run, "row long, doc_id long, th long, n long, digest long, range int, cells binary")


def frequencies(profiled: DataFrame, cells: int) -> np.ndarray:
    """The table of counts over all documents, added up by ranges on the executors: at most CELLS numbers."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[r] = total.get(r, 0) + np.frombuffer(c, np.uint32).astype(np.uint64)
        for r, c in total.items():
            yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "cells": pa.array([np.minimum(c, np.iinfo(np.uint32).max).astype(np.uint32).tobytes()])})

    parts = profiled.where(F.col("range").isNotNull()).select("range", "cells").repartition(RANGES, "range").mapInArrow(add, "range int, cells binary").collect()
    out = np.zeros((RANGES, cells // RANGES), np.uint32)
    for r in parts:
        out[r.range] = np.frombuffer(r.cells, np.uint32)
    return out.reshape(-1)


def level(often: np.ndarray) -> np.ndarray:
    """Counts in eighths of a doubling: 8 bits that grow with the count."""
    return (np.log2(np.maximum(often, 1)) * 7.9).astype(np.uint64)


def in_order(key: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles by names whose order is from rare to frequent, one order for all: the level of the count, then 56 bits of the hash."""
    return level(often) << np.uint64(56) | key >> np.uint64(8)


def prefixes(docs: DataFrame, counts, hot_from: int) -> DataFrame:
    """h, digest, n, pos, hot: the rare-first prefix of every distinct set that the task meets."""

    def run(batches):
        seen: set[int] = set()
        table = counts.value
        for b in slices(batches):
            owner, key, sizes = shingle_sets(b.column(1))
            digest = digests(owner, key, sizes)
            fresh = np.zeros(len(sizes), bool)
            for i, d in enumerate(digest.tolist()):
                if d not in seen:
                    fresh[i] = True
                    seen.add(d)
            if len(seen) > 500_000:
                seen.clear()
            key, owner, sizes = key[fresh[owner]], owner[fresh[owner]], np.where(fresh, sizes, 0)
            h = sort_each(in_order(key, table[cell(key, len(table))]), sizes)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = sizes[owner]
            keep = pos < n - (UP * n + DOWN - 1) // DOWN + 1
            h, owner = h[keep], owner[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(digest[owner]), pa.array(n[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32)), pa.array(h >= hot)], names=["h", "digest", "n", "pos", "hot"])

    hot = level(np.array([hot_from], np.uint32))[0] << np.uint64(56)
    return docs.select("doc_id", "text").mapInArrow(run, "h long, digest long, n int, pos int, hot boolean")


def shared_rows(batches):
    """Of rows sorted by (h, digest), one for each (h, digest) whose h has several digests. A run that a batch cuts is carried on."""
    rest = None
    for b in batches:
        rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        h = rest.column(0).to_numpy()
        cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
        yield from _several(rest.slice(0, cut))
        rest = rest.slice(cut)
    if rest is not None:
        yield from _several(rest)


def _several(rows: pa.Table):
    if not rows.num_rows:
        return
    h, d = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    rows = rows.filter(pa.array(first))
    h = h[first]
    same = h[1:] == h[:-1]
    keep = np.zeros(len(h), bool)
    keep[1:] |= same
    keep[:-1] |= same
    yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()


def buckets(prefix: DataFrame) -> DataFrame:
    """h, digest, n, pos of the shingles that several classes share (frequent ones unseen): the one shuffle of all prefixes."""
    names = ["h", "digest", "n", "pos"]
    rare = prefix.where("not hot").select(names).repartition("h").sortWithinPartitions("h", "digest").mapInArrow(shared_rows, "h long, digest long, n int, pos int")
    return rare.unionByName(prefix.where("hot").select(names))


def filtered(pairs: DataFrame) -> DataFrame:
    """Length and positional filters over rows (a, na, pa, ka, b, nb, pb, kb) that share a shingle; each pair once, the smaller id first.

    pos counts all shingles of a set before the shared one, k only those that other classes hold: the rest can't be shared.
    """
    need = F.expr(f"({UP} * (na + nb) + {UP + DOWN - 1}) div {UP + DOWN}")
    fits = F.least("na", "nb") >= need
    reach = F.least("ka", "kb") + 1 + F.least(F.expr("na - pa - 1"), F.expr("nb - pb - 1")) >= need
    return pairs.where((F.col("a") != F.col("b")) & fits & reach).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def signatures(texts: DataFrame) -> DataFrame:
    """id, s0 ... : the parities of a set's shingles over SIGNATURE * 64 cells. Two sets differ in at least as many shingles as parities."""

    def run(batches):
        for b in slices(batches):
            owner, key, sizes = shingle_sets(b.column(1))
            bits = SIGNATURE * 64
            odd = np.bincount(owner * bits + (mix(key) % np.uint64(bits)).astype(np.int64), minlength=len(sizes) * bits).reshape(-1, bits) & 1
            words = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(SIGNATURE))], names=["id", *(f"s{i}" for i in range(SIGNATURE))])

    return texts.select("id", "text").mapInArrow(run, "id long, " + ", ".join(f"s{i} long" for i in range(SIGNATURE)))


def alike():
    """Joined rows whose signatures (s0 ... and z0 ...) leave room for a link: the sets may differ in (na + nb) / 7 shingles."""
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("z0")))
    for i in range(1, SIGNATURE):
        apart = apart + F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"z{i}")))
    return apart * (UP + DOWN) <= (F.col("na") + F.col("nb")) * (DOWN - UP)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """At most so many shingles are in both: both are split at the middle of the one, and again, and the smaller part of each side counts."""
    if depth == 0 or not len(x) or not len(y):
        return min(len(x), len(y))
    at = x[len(x) // 2]
    i, j = len(x) // 2, int(np.searchsorted(y, at))
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose exact sets link."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in slices(batches, 500, 8 << 20):
            texts: dict[int, str] = {}
            sides = [batch.column(k).to_pylist() for k in (0, 1)]
            for side, k in zip(sides, (2, 3), strict=True):
                column = batch.column(k)
                for row, i in enumerate(side):
                    if i not in texts:
                        texts[i] = column[row].as_py()
            owner, key, sizes = shingle_sets(list(texts.values()))
            ends = np.cumsum(sizes)
            sets = {i: key[e - n : e] for i, e, n in zip(texts, ends.tolist(), sizes.tolist(), strict=True)}
            keep = []
            for i, j in zip(*sides, strict=True):
                x, y = sorted((sets[i], sets[j]), key=len)
                need = least_overlap(len(x), len(y))
                keep.append(bool(suffix_bound(x, y) >= need and np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x) >= need))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, th, n, least for every row; th: hash of the text; least: (no id, doc_id, th) of the first row of its component, null where the set is empty."""
    spark = docs.sparkSession
    texts = keyed_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    cells = cells_for(texts)
    profiled = written(profile(texts, cells), "profile")
    counts = frequencies(profiled, cells)
    total = int(counts.sum(dtype=np.uint64))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a shingle is hot if it may fill a sixteenth of a partition, and stands out from what chance gives a cell
    hot_from = max(1000, 4 * total // cells, total // (16 * parts))
    rows = profiled.where(F.col("range").isNull()).select("row", "doc_id", "th", "n", "digest")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    classes = written(rows.where("n > 0").groupBy("digest", "n").agg(F.min(F.struct("row", "doc_id", "th")).alias("one"), first.alias("least"), F.count(F.lit(1)).alias("copies")), "classes")

    found = buckets(prefixes(texts, spark.sparkContext.broadcast(counts), hot_from))
    found = found.join(classes.select("digest", F.col("n").cast("int").alias("n"), F.col("one.row").alias("id")), ["digest", "n"]).groupBy("digest", "n", "h").agg(F.min("id").alias("id"), F.min("pos").alias("pos"))
    in_order = Window.partitionBy("digest", "n").orderBy("pos")
    found = written(found.select("h", "id", "n", "pos", (F.row_number().over(in_order) - 1).alias("k")), "buckets")
    # the text of one row of each class that shares a shingle; rows with the same id and hash of the text are the same text
    asked = classes.select(F.col("one.row").alias("id"), F.coalesce("one.doc_id", F.lit(0)).alias("key"), F.col("one.th").alias("th")).join(found.select("id").distinct(), "id", "left_semi")
    members = texts.select(F.coalesce("doc_id", F.lit(0)).alias("key"), "th", "text").join(asked, ["key", "th"])
    members = written(members.groupBy("id").agg(F.min("text").alias("text")), "texts")

    # the anchor has the fewest rare shingles before the shared one: of a family of edited copies, the least edited
    anchors = found.groupBy("h").agg(F.min(F.struct("pos", "id", "n", "k")).alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    anchors = written(anchors.select("h", F.col("least.id").alias("a"), F.col("least.n").alias("na"), F.col("least.pos").alias("pa"), F.col("least.k").alias("ka")), "anchors")
    second = found.select("h", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("k").alias("kb"))
    first_pairs = written(filtered(second.join(anchors, "h")), "pairs")
    links = written(verified(first_pairs, members), "links")

    # what the first links leave open: buckets whose classes besides the anchor lie in several components
    labels = connected_components(links, "a", "b", local_limit=LOCAL_EDGES).select(F.col("node").alias("id"), "component")
    rest = found.join(anchors.select("h", "a"), "h").where("id <> a").drop("a")
    labelled = rest.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("h", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("h").agg(F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("several"), F.sum("size").alias("all")).where("several > 1")
    blocks = (F.col("all") / BLOCK).cast("int") + 1
    still = labelled.join(largest.select("h", F.col("top.component").alias("top"), blocks.alias("blocks")), "h")
    unmarked = written(still, "open")
    still = written(unmarked.join(signatures(members.join(unmarked.select("id").distinct(), "id", "left_semi")), "id"), "open")
    marks = [f"s{i}" for i in range(SIGNATURE)]
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    minor = still.where("component <> top").select("h", block, F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("k").alias("ka"), F.col("component").alias("ca"), *marks)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block")
    major = still.select("h", every, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("k").alias("kb"), F.col("component").alias("cb"), *(F.col(m).alias(f"z{i}") for i, m in enumerate(marks)))
    second_pairs = filtered(minor.join(major, ["h", "block"]).where((F.col("ca") != F.col("cb")) & alike())).join(first_pairs, ["a", "b"], "left_anti")
    open_pairs = written(second_pairs, "pairs")
    more = written(verified(open_pairs, members), "links")

    if more.limit(1).count():
        labels = connected_components(links.unionByName(more), "a", "b", local_limit=LOCAL_EDGES).select(F.col("node").alias("id"), "component")
    discard(found, members, anchors, first_pairs, links, unmarked, still, open_pairs, more)
    linked = classes.select("digest", "n", F.col("one.row").alias("id"), "least", "copies").join(labels, "id", "left")
    alone, joined = linked.where("component is null"), linked.where("component is not null")
    heads = joined.groupBy("component").agg(F.min("least").alias("least"))
    joined = joined.drop("least").join(heads, "component")
    named = written(alone.unionByName(joined, allowMissingColumns=True).select("digest", "n", "least", "copies"), "components")
    # classes of many rows are few, at most one for HOT_CLASS rows
    hot = F.broadcast(named.where(F.col("copies") >= HOT_CLASS).select("digest", "n", F.col("least").alias("often")))
    full = rows.where("n > 0").join(hot, ["digest", "n"], "left")
    rest = full.where("often is null").drop("often").join(named.where(F.col("copies") < HOT_CLASS).select("digest", "n", "least"), ["digest", "n"])
    many = full.where("often is not null").withColumnRenamed("often", "least")
    none = rows.where("n = 0").withColumn("least", F.lit(None).cast(dict(named.dtypes)["least"]))
    return none.unionByName(rest).unionByName(many).drop("digest")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row with an id."""
    rows = components(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: the one of least id, then of least hash of its text. Rows with an empty set all stay."""
    rows = components(docs, id_col, text_col).where("n > 0").select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th").alias("mine"), "least")
    told = written(rows.groupBy("mine").agg(F.first("least").alias("least"), F.count(F.lit(1)).alias("times")), "told")
    mine, names = "_mine", docs.columns
    while mine in names:
        mine += "_"
    number = F.col(id_col).cast("long")
    marked = docs.withColumn(mine, F.struct(number.isNull().alias("none"), number.alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")))
    key = lambda where: told.where(where).select(F.col("mine").alias(mine))
    again = "mine = least and times > 1"
    if not told.where(again).limit(1).count():
        return marked.join(key("mine <> least"), mine, "left_anti").select(names)
    # the same id and text several times: one of the rows, whichever comes first
    single = marked.join(key(f"mine <> least or {again}"), mine, "left_anti").select(names)
    several = marked.join(key(again), mine, "left_semi").withColumn(mine, F.row_number().over(Window.partitionBy(mine).orderBy(F.lit(1))))
    return single.unionByName(several.where(F.col(mine) == 1).select(names))
