"""Token ids in Parquet (operator 7).

A store is a folder of Parquet files in ascending doc_id order, one row for each document: doc_id, n_tokens, part,
local_start (ids of the part before it) and ids, a list of 32-bit integers. Row groups and pages are small and carry
page indexes, so a reader that wants a few documents or only the numbers beside the ids reads little else. Ids are
dictionary-encoded (a vocabulary fits one dictionary page) or delta-packed; both are then compressed.

Texts are encoded where they lie; only ids, two bytes each where the vocabulary allows, are shuffled into ranges of
doc_id. The borders of the ranges come from a sample of the doc_ids; they decide how evenly files fill, nothing else. A
doc_id that fills several ranges is dealt out over them.

Cases: null text counts as empty, so its document holds only the end id; texts of any length are taken whole; rows that
repeat a doc_id are stored each, next to one another, in no fixed order; rows with a null doc_id come first; an empty
table gives an empty store; other columns take no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import keyed_text, slices
from strata.llm.fast_ids import fast_ids

ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}
ROW_GROUP = 16 << 20
PAGE = 128 << 10
SAMPLED = 40  # doc_ids for each range


def borders(docs: DataFrame, ranges: int) -> list:
    """ranges - 1 doc_ids, in order, between which about equally many rows lie, from about SAMPLED * ranges of them."""
    keys = docs.where(F.col("doc_id").isNotNull()).select("doc_id")
    ids = sorted(r.doc_id for r in keys.sample(min(1.0, SAMPLED * ranges / max(1, keys.count())), 7).collect())
    return [ids[len(ids) * k // ranges] for k in range(1, ranges)] if ids else []


def write_store(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE, ranges: int | None = None
) -> None:
    """Encode every text, append the end id, write in ascending order of the id. One shuffle: of the ids, into ranges of doc_id."""
    spark, kind, texts = docs.sparkSession, dict(docs.dtypes)[id_col], keyed_text(docs, id_col, text_col)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    limits = np.array(borders(texts, ranges))

    def encode(batches):
        t, row = fast_ids(tokenizer_path), 0
        wide = 2 if max(t.size, end_id) < 1 << 16 else 4
        end = int(end_id).to_bytes(wide, "little")
        for b in slices(batches):
            keys, known = b.column(0), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            low, high = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            if len(limits) and known.any():
                present = np.array(keys.drop_null().to_pylist(), limits.dtype if limits.dtype.kind != "U" else None)
                low[known], high[known] = np.searchsorted(limits, present, "left"), np.searchsorted(limits, present, "right")
            part = low + (row + np.arange(len(keys))) % (high - low + 1)
            row += len(keys)
            ids = [x.astype(f"<u{wide}").tobytes() + end for x in t.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([keys, pa.array(part.astype(np.int32)), pa.array(np.full(len(ids), wide, np.int32)), pa.array(ids, pa.binary())], names=["doc_id", "part", "wide", "ids"])

    def lists(batches):
        before = 0
        for b in slices(batches, 5000):
            wide = b.column(2)[0].as_py()
            flat = b.column(3)
            offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
            ids = np.frombuffer(flat.buffers()[2], f"<u{wide}", (offsets[-1] - offsets[0]) // wide, offsets[0]).astype(np.int32)
            ends = (offsets[1:] - offsets[0]) // wide
            sizes = np.diff(ends, prepend=0)
            made = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int64)), b.column(1), pa.array(before + ends.astype(np.int64) - sizes), made], names=["doc_id", "n_tokens", "part", "local_start", "ids"])
            before += int(ends[-1])

    dealt = texts.mapInArrow(encode, f"doc_id {kind}, part int, wide int, ids binary").repartitionById(ranges, "part").sortWithinPartitions("doc_id")
    options = ENCODINGS[encoding] | {"parquet.block.size": str(row_group), "parquet.page.size": str(page), "compression": "zstd"}
    dealt.mapInArrow(lists, f"doc_id {kind}, n_tokens long, part int, local_start long, ids array<int>").write.options(**options).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_documents(spark: SparkSession, path: str, doc_ids: list, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The stored rows of those documents. Both bounds and the ids themselves are pushed to the files, which skip row groups and pages by their indexes."""
    if not doc_ids:
        return read_store(spark, path).select(*columns).limit(0)
    wanted = read_store(spark, path).where(F.col("doc_id").between(min(doc_ids), max(doc_ids)) & F.col("doc_id").isin(list(doc_ids)))
    return wanted.select(*columns)


def starts(store: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """The store with `start`: ids of all documents before each. Reads the numbers only; sums by part, then one running sum over parts."""
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("rows"))
    base = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    # one row for each part: broadcast if their number is small, else joined by shuffle
    small = (store.agg(F.max("part")).first()[0] or 0) <= broadcast_rows
    return store.join(F.broadcast(base) if small else base, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def digests(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the lists as read back."""
    df = starts(store).select("doc_id", "start", "ids")
    kind = dict(df.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            lists = b.column(2)
            at, flat = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.values.to_numpy()).view(np.uint8))
            crc = [zlib.crc32(flat[4 * s : 4 * e]) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
