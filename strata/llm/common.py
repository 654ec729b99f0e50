"""Shared pieces: Arrow batches in slices, word splitting on bytes, 64-bit hashes, the fold that is held out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows and, where a batch has several, about so many bytes."""

    def halves(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if b.num_rows > 1 and b.nbytes > size:
            yield from halves(b.slice(0, b.num_rows // 2))
            yield from halves(b.slice(b.num_rows // 2))
        elif b.num_rows:
            yield b

    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield from halves(b.slice(i, rows))


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), under fixed names: other columns, whatever their names, take no part."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow over slices of rows: make() turns one batch into a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(make(b))

    return df.mapInArrow(run, schema)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Bounded(dict):
    """A cache in two generations of at most `size` entries: d[key] makes what is missing; what is used again outlives a change of generation.

    A key is kept from its second use on: a bit for each hash tells which were asked for before, so that the many keys of
    a corpus that occur once don't push out the others. Keys of `longest` characters or more are never kept.
    """

    BITS = 1 << 24

    def __init__(self, make: Callable, size: int = 400_000, longest: int = 60):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}
        self.asked, self.set_bits = bytearray(self.BITS >> 3), 0

    def __missing__(self, key):
        if len(key) >= self.longest:
            return self.make(key)
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            at = hash(key) & (self.BITS - 1)
            if not self.asked[at >> 3] & (1 << (at & 7)):
                self.asked[at >> 3] |= 1 << (at & 7)
                self.set_bits += 1
                if self.set_bits > self.BITS >> 2:
                    self.asked, self.set_bits = bytearray(self.BITS >> 3), 0
                return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found
