"""Token counts of texts by a public tokenizer, whose vocabulary file is a parameter.

Byte-level BPE merges within the pieces its pattern cuts, so a text's count is the sum of its pieces' counts; each worker
remembers the counts of pieces it has met. Null counts 0 tokens, like the empty text. Whole texts are counted.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern with which the public byte-level vocabularies cut a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PIECES = regex.compile(PATTERN)
#: Pieces remembered per worker; at that number it forgets all and starts again.
REMEMBERED = 300_000


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("warraq", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _memory(path: str) -> dict[str, int]:
    return {}


def count(text: str | None, path: str = VOCABULARY) -> int:
    if not text:
        return 0
    known = _memory(path)
    total = 0
    for p in _PIECES.findall(text):
        n = known.get(p)
        if n is None:
            if len(known) >= REMEMBERED:
                known.clear()
            n = known[p] = len(encoding(path).encode_ordinary(p))
        total += n
    return total


def counts(text: Column, path: str = VOCABULARY) -> Column:
    @F.pandas_udf(T.LongType())
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda t: count(t, path)).astype("int64")

    return udf(text)
