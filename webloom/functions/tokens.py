"""Token counts and token-exact splits, in Arrow batches."""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import sliced

VOCABULARY = os.environ.get("WEBLOOM_TOKEN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoding(model: str = "", name: str = ""):
    """The model's encoding, else the named one, else the vocabulary file; offline the last is what there is."""
    import tiktoken

    for find, key in ((tiktoken.encoding_for_model, model), (tiktoken.get_encoding, name)):
        try:
            if key:
                return find(key)
        except Exception:  # noqa: BLE001 - unknown, or a download that can't be made
            continue
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, model: str = "", name: str = "") -> int:
    return len(encoding(model, name).encode_ordinary(text)) if text else 0


def split(text: str, most: int, model: str = "", name: str = "") -> list[str]:
    """Consecutive stretches of at most ``most`` tokens; the text itself if it fits or there is no limit."""
    ids = encoding(model, name).encode_ordinary(text) if most > 0 else []
    if len(ids) <= most or most <= 0:
        return [text]
    return [encoding(model, name).decode(ids[i : i + most]) for i in range(0, len(ids), most)]


def count_tokens(column: Column, model: str = "", name: str = "", join: str = "") -> Column:
    """The tokens of each text; with ``join`` those it adds where that and a line that begins with a dash come after it."""

    @F.arrow_udf(T.LongType())
    @sliced
    def run(text: pa.Array) -> pa.Array:
        extra = count("-", model, name) if join else 0
        return pa.array([count((t or "") + join + "-" * bool(join), model, name) - extra for t in text.to_pylist()], pa.int64())

    return run(column)


def pieces(text: str, most: int, model: str = "", name: str = "") -> list[dict]:
    """``split`` with each stretch's number of tokens."""
    code = encoding(model, name)
    ids = code.encode_ordinary(text)
    if len(ids) <= most or most <= 0:
        return [{"chunk": text, "n_tokens": len(ids)}]
    return [{"chunk": code.decode(ids[i : i + most]), "n_tokens": min(most, len(ids) - i)} for i in range(0, len(ids), most)]


def split_by_tokens(most: int, model: str = "", name: str = ""):
    """array<struct<chunk, n_tokens>> of each text: encoded once."""
    kind = pa.list_(pa.struct([("chunk", pa.string()), ("n_tokens", pa.int64())]))

    @F.arrow_udf("array<struct<chunk: string, n_tokens: long>>")
    @sliced
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else pieces(t, most, model, name) for t in text.to_pylist()], kind)

    return run
