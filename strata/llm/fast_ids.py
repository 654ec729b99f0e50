"""The ids that the tokenizers library gives, several times as fast: the same vocabulary and merges run by tiktoken.

tiktoken merges the neighbours whose joined bytes are the earliest entry. In a vocabulary where every entry is what its own
bytes merge to, that is the merge which the file lists, as inside a span that becomes one entry all earlier merges are the
same in either order; entries that their own bytes don't merge to are left out. Entries of words that end in a mark get a
zero byte for it, and each piece of a text a zero byte after it, so whole texts go through one call.

Texts that may hold a special token, and for vocabularies with word ends texts with zero bytes or with characters on which
the Unicode tables of the libraries involved may disagree, go through the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

from strata.llm.bpe import BYTE_PATTERN, alike, byte_letters, lowered

#: White space apart from what RE2's \s holds: fixed values, the property White_Space without U+0009 to U+000D and U+0020.
OTHER_SPACE = "\\x{0B}\\x{85}\\p{Z}"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^\s{OTHER_SPACE}\p{{L}}\p{{N}}]+"


class FastIds:
    """Tokenizer files of the two kinds that strata.llm.bpe knows."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.words = bool(suffix)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        self.special = [t["content"][:2] for t in spec["added_tokens"]]
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}

        def raw(token: str) -> bytes:
            end = bool(suffix) and token.endswith(suffix)
            return bytes(byte[c] for c in (token[: -len(suffix)] if end else token)) + (b"\0" if end else b"")

        entries = [*letters, *(c + suffix for c in letters if suffix)]
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            entries.append(a + b)
        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        for token in entries:
            if ranks.setdefault(raw(token), len(ids)) == len(ids):
                ids.append(vocab[token])
        self.ids = np.array(ids, np.uint32)
        self.coder = tiktoken.Encoding("ids", pat_str=r"[^\s\x00]+\x00" if suffix else BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks

    def _slow(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return True
        return self.words and ("\0" in text or not alike(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers, without special tokens at its ends."""
        slow = [self._slow(t) for t in texts]
        if self.words:
            low = ["" if s else lowered(t, True) for t, s in zip(texts, slow, strict=True)]
            marked = pc.replace_substring_regex(pa.array(low, pa.large_string()), pattern=PIECES, replacement="\\0\0").to_pylist()
        else:
            marked = texts
        take, coder = self.ids, self.coder.encode_to_numpy
        return [
            np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if s else take[coder(m, disallowed_special=())]
            for t, m, s in zip(texts, marked, slow, strict=True)
        ]


@functools.lru_cache(4)
def fast_ids(path: str) -> FastIds:
    """Loaded once in each worker process."""
    return FastIds(path)
