"""BPE encoding and decoding (operator 1).

Encoding backtracks over the longest vocabulary entries that an Aho-Corasick automaton finds at each position. A
neighbouring pair may stand only if byte-pair merging itself would leave the boundary between the two alone; that is
looked up in a pair-compatibility table, filled as pairs are met. The result equals merging rank by rank, in time
linear in the text. Decoding gathers bytes from one blob through a table of offsets.

Cases: null text counts as empty; empty text has no ids and decodes to the empty text; texts of any length are taken
whole; repeated rows are encoded each by itself; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC

from strata.llm.common import Bounded, keyed_text, map_rows

# The white space of the Unicode property White_Space, and the two splitting patterns of the files.
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATORS = "\x1c\x1d\x1e\x1f"  # str.split() splits on these, the property above doesn't hold them

END = chr(0xFFFF)  # stands for the word-end mark inside the automaton


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


@functools.lru_cache(1)
def known() -> regex.Pattern:
    """Text of characters that Unicode 3.2 already had, and the emoji of 6.0: on these the tables of all libraries agree."""
    old, runs = unicodedata.ucd_3_2_0, [[0x1F300, 0x1F5FF], [0x1F600, 0x1F64F], [0x1F680, 0x1F6C5]]
    for c in (*range(1, 0xD800), *range(0xF900, 0x10000)):
        if old.category(chr(c)) != "Cn":
            if runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs) + "]*+")


def alike(text: str) -> bool:
    """Do all libraries agree on the characters of the text?"""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")  # the quickest test that most other texts of Europe pass
    except UnicodeEncodeError:
        return known().fullmatch(text) is not None
    return True


def lowered(text: str, sure: bool = False) -> str:
    """The text in NFC and lower case, as the library's normalizers make it; its tables are older than Python's. sure: it is alike()."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text) if sure or alike(text) else NFC().normalize_str(text)
    return text.replace("Σ", "σ").lower()


class Merges:
    """A vocabulary and its merges as an automaton, the halves of each entry and the table of compatible pairs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        mark = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) else t
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.joined: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, whole = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.joined:
                self.joined[x, y] = r
                self.rank[whole], self.left[whole], self.right[whole] = r, x, y
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.length, self.shorter = [0] * size, [-1] * size
        ids = {mark(t): i for t, i in vocab.items()}
        for t, i in ids.items():
            self.found.add_word(t, i)
            self.length[i] = len(t)
            self.shorter[i] = next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1)
        self.found.make_automaton()
        self.pairs: dict[int, bool] = {}  # left id << 20 | right id

    def compatible(self, a: int, b: int) -> bool:
        """Would merging leave a|b apart? Undo merges on both sides, latest first; the boundary falls if an earlier merge spans it."""
        rank, bound = self.rank, len(self.joined) + 1
        while True:
            if self.joined.get((a, b), bound) < bound:
                return False
            if rank[a] > rank[b]:
                bound, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                bound, b = rank[b] + 1, self.left[b]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Longest match first; where a pair doesn't fit, the next shorter entry; where none fits, back by one token."""
        longest, length, shorter, pairs = self.found.iter_long, self.length, self.shorter, self.pairs
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        n, pos, token, last = len(word), 0, -2, -1
        while pos < n:
            if token == -2:
                hit = next(longest(word, pos), None)
                token = hit[1] if hit and hit[0] + 1 - length[hit[1]] == pos else -1
            while token >= 0:
                if not dead or pos + length[token] not in dead:
                    if last < 0:
                        break
                    fits = pairs.get(pair := last << 20 | token)
                    if fits is None:
                        if len(pairs) > 300_000:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                starts.append(pos)
                pos += length[token]
                last, token = token, -2
            elif out:
                dead.add(pos)
                token, pos = shorter[out.pop()], starts.pop()
                last = out[-1] if out else -1
            else:
                raise ValueError(f"the vocabulary has no symbols for {word[:40]!r}")
        return out


class Bpe:
    """A tokenizer file (JSON) of one of two kinds: byte-level, or with word ends, lower case and white space dropped."""

    def __init__(self, path: str, cache: int, library: bool):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.words = pre["type"] == "Sequence"
        if model["type"] != "BPE" or model["ignore_merges"] or self.words != bool(self.suffix) or self.words != bool(spec["normalizer"]):
            raise ValueError(f"{path}: a kind of tokenizer that isn't known here")
        vocab = dict(model["vocab"])
        if library:
            self.symbols = Tokenizer.from_file(path).model.tokenize
        else:
            self.merges = Merges(vocab, [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], self.suffix)
        self.library = library
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.letters = byte_letters()
        self.pattern = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        self.runs = re.compile(f"[^{SPACE}]+" if self.words else f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.quick = re.compile(r" ?\S+|\s+(?!\S)|\s+")
        # byte-level texts without double spaces, nearly all, use the third of these instead of the first
        self.cache, self.pieces = Bounded(self._chunk, cache if self.words else cache // 4), Bounded(self._piece, cache // 3)
        self.after_space = Bounded(lambda word: self._chunk(" " + word), cache)
        self._offsets({**vocab, **self.special}, bool(spec["decoder"]))

    def _offsets(self, vocab: dict[str, int], raw: bool) -> None:
        """One blob of all entries and where each begins; entries without a decoder are joined by spaces."""
        entries = [b""] * (max(vocab.values()) + 1)
        byte = {c: b for b, c in enumerate(self.letters)}
        for t, i in vocab.items():
            entries[i] = bytes(byte[c] for c in t) if raw and t not in self.special else t.encode() + (b"" if raw else b" ")
        self.raw, self.size = raw, len(entries)
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)

    def _chunk(self, chunk: str) -> bytes:
        """ids (32-bit, little-endian) of a run that no merge can cross."""
        if self.words:
            chunk = lowered(chunk)
        pieces = self.pieces
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():  # most runs: letters, perhaps after a space, perhaps with one stop after them
            return pieces[chunk]
        elif word[:-1].isalpha() and word[-1] in ",.":
            return pieces[chunk[:-1]] + pieces[chunk[-1]]
        return b"".join(map(pieces.__getitem__, self.pattern.findall(chunk)))

    def _piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() and piece.isalnum() else "".join(map(self.letters.__getitem__, piece.encode()))
        out = [t.id for t in self.symbols(symbols)] if self.library else self.merges.encode(symbols + END if self.suffix else symbols)
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> bytes:
        """All ids of a text, 32-bit little-endian. Strings of special tokens in the text are those tokens."""
        if "<|" in text and self.special_split.search(text):
            return b"".join(self.special[s].to_bytes(4, "little") if s in self.special else self._plain(s) for s in self.special_split.split(text) if s)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        odd = any(c in text for c in SEPARATORS)
        if self.words:
            return b"".join(map(self.cache.__getitem__, self.runs.findall(text) if odd else text.split()))
        if odd or "  " in text:
            return b"".join(map(self.cache.__getitem__, (self.runs if odd else self.quick).findall(text)))
        # a space that stands alone always begins a run: what lies between two of them is looked up without it
        first, *rest = text.split(" ")
        return (self._chunk(first) if first else b"") + b"".join(map(self.after_space.__getitem__, rest))

    def decode(self, ids: bytes | np.ndarray, step: int = 200_000) -> str:
        """The text of all ids, special ones included."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        parts = []
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            size = self.lengths[part]
            ends = np.cumsum(size)
            parts.append(self.blob[np.arange(ends[-1]) + np.repeat(self.offsets[part] - ends + size, size)].tobytes())
        data = b"".join(parts)
        return data.decode("utf-8", "replace") if self.raw else data[:-1].decode()


@functools.lru_cache(4)
def tokenizer(path: str, cache: int = 200_000, library: bool = False) -> Bpe:
    """Loaded once in each worker process; `cache` bounds each generation of the runs whose ids are remembered.

    With `library`, the merges of a run come from the tokenizers library instead of the backtracking encoder; the ids are
    the same. Operators whose subject is what happens to the ids take it, as it is the faster of the two.
    """
    return Bpe(path, cache, library)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens; one row for each row. No shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def make(b: pa.RecordBatch) -> dict:
        t = tokenizer(path)
        ids = [t.encode(x) for x in b.column(1).to_pylist()]
        return {"doc_id": b.column(0), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}

    return map_rows(keyed_text(docs, id_col, text_col), make, f"doc_id {kind}, ids binary, n_tokens long")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text for each row of encode(); null ids count as none."""
    kind = dict(encoded.dtypes)[id_col]
    df = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def make(b: pa.RecordBatch) -> dict:
        t = tokenizer(path)
        return {"doc_id": b.column(0), "ids": b.column(1), "text": pa.array([t.decode(x) for x in b.column(1).to_pylist()], pa.string())}

    return map_rows(df, make, f"doc_id {kind}, ids binary, text string")
