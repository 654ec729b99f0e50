"""Quality rules (operator 4): base counts of a text and compression bands.

A text is compressed by zstandard as a whole and in fixed chunks. Its ratio (bytes by compressed bytes) must lie in the
band of its length: above the band the text repeats itself, below it the text is noise. A text fails if the whole lies
outside its band, or if chunks outside theirs hold at least half of its bytes.

Cases: null text has no words and no bytes, so it fails the base rule; texts under 256 bytes have no lower limit, as the
frame's own bytes dominate them; very long texts are taken whole; repeated rows are judged each by itself; an empty
table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from strata.llm.common import keyed_text, map_rows, mix

CHUNK = 4096
LEVEL = 3
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: (from so many bytes on, lowest ratio, highest ratio). Prose compresses better the longer it is, so both limits rise.
#: Set by hand around the ratios of the 9,066 documents of sf0.1 that pass the base rule: the lower limits lie a fifth or
#: more under the least of them, the upper ones at about their 99.9th percentile (98th in the band from 256 bytes on, where
#: repeated text reaches 5.5). 20 of those documents fall outside.
BANDS = (
    (0, 0.0, 2.3),
    (256, 1.1, 2.25),
    (512, 1.2, 2.3),
    (1024, 1.35, 2.45),
    (2048, 1.45, 2.55),
    (4096, 1.5, 2.65),
    (8192, 1.5, 2.75),
    (16384, 1.55, 2.85),
    (32768, 1.55, 3.0),
    (65536, 1.6, 3.2),
)
_FROM, _LOW, _HIGH = (np.array(x) for x in zip(*BANDS, strict=True))


def inside(sizes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which of the pieces have a ratio in the band of their length."""
    at = np.searchsorted(_FROM, sizes, "right") - 1
    ratio = sizes / np.maximum(packed, 1)
    return (ratio >= _LOW[at]) & (ratio <= _HIGH[at])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    h = mix(np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64) + np.uint64(1))
    if len(ids) == len(words):
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(text: str, packer: zstandard.ZstdCompressor) -> tuple[int, int, int, int, int, float, float, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio of the whole, share of bytes in chunks outside their band, in band."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    if not data:
        return 0, 0, 0, 0, 0, 0.0, 0.0, False
    whole = len(packer.compress(data))
    chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)] if len(data) > CHUNK else []
    sizes = np.array([len(c) for c in chunks], np.int64)
    off = float(sizes[~inside(sizes, np.array([len(packer.compress(c)) for c in chunks]))].sum() / len(data)) if chunks else 0.0
    good = bool(inside(np.array([len(data)]), np.array([whole]))[0]) and off < 0.5
    return len(words), chars, symbols, duplicate_lines(text), repeated_words(words), len(data) / whole, off, good


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept, ratio, off_band; one row for each row. No shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def make(b: pa.RecordBatch) -> dict:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        got = list(zip(*(measure(t, packer) for t in b.column(1).to_pylist()), strict=True))
        n_words, repeat = np.array(got[0]), np.array(got[4])
        failed = (n_words < 20) | (100 * repeat > 30 * n_words)
        counts = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), (pa.array(x, pa.int64()) for x in got), strict=False))
        return {"doc_id": b.column(0)} | counts | {"base_failed": pa.array(failed), "kept": pa.array(~failed & np.array(got[7], bool)), "ratio": pa.array(got[5], pa.float64()), "off_band": pa.array(got[6], pa.float64())}

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, off_band double"
    return map_rows(keyed_text(docs, id_col, text_col), make, schema)
