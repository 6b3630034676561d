"""Exact byte-level BPE token ids of whole texts."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Ids of texts; the strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for piece, rank in ranks.items():
            self.lengths[rank] = len(piece)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one uint32 array and the n + 1 row bounds in it."""
        nothing = np.zeros(0, np.uint32)
        each = [np.array(self.encoding.encode_ordinary(t), np.uint32) if t else nothing for t in column.to_pylist()]
        bounds = np.zeros(len(each) + 1, np.int64)
        np.cumsum([len(e) for e in each], out=bounds[1:])
        return np.concatenate([nothing, *each]), bounds


@functools.lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """The worker's tokenizer for the vocabulary file at ``path``."""
    return Tokenizer(path)
