"""Token ids by a tokenizer file, in Arrow batches; the file's path is a parameter."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: Column, path: str) -> Column:
    @F.pandas_udf("array<long>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([e.ids for e in _library(path).encode_batch(s.fillna("").tolist(), add_special_tokens=False)])

    return run(text)


def decode(ids: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_library(path).decode_batch([[int(i) for i in x] if x is not None else [] for x in s]))

    return run(ids)


def encode_pair(query: Column, passage: Column, path: str, max_length: int) -> Column:
    """Ids, mask and segments of two texts, padded to a length."""

    @F.pandas_udf("struct<input_ids:array<long>,attention_mask:array<long>,token_type_ids:array<long>>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        t = _library(path)
        t.enable_truncation(max_length)
        t.enable_padding(length=max_length)
        out = t.encode_batch(list(zip(a.fillna(""), b.fillna(""))))
        return pd.DataFrame({"input_ids": [e.ids for e in out], "attention_mask": [e.attention_mask for e in out], "token_type_ids": [e.type_ids for e in out]})

    return run(query, passage)


def byte_level_decode(text: Column) -> Column:
    """Text of byte-level symbols back to text."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: bytes(table[c] for c in x if c in table).decode("utf-8", "replace"), na_action="ignore")

    return run(text)
