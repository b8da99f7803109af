"""The choice of a tokenizer: bytes, or a file of the `tokenizers` library where it is installed."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmill.functions import chat


@dataclass(frozen=True)
class Tokenizer:
    """encode: array<string> -> array<array<int>>; decode: array<int> -> string; end_id closes a sequence."""

    name: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    end_id: int


BYTES = Tokenizer("bytes", chat.byte_ids_of_all, chat.byte_text, chat.EOS_ID)


def from_file(path: str, end_id: int = 0) -> Tokenizer:
    """A tokenizer.json; every worker loads it once. Special tokens in texts count as ordinary text."""

    def loaded():
        from tokenizers import Tokenizer as Loaded

        own = Loaded.from_file(path)
        own.encode_special_tokens = True
        return own

    @pandas_udf("array<array<int>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = loaded()
        for rows in batches:
            yield rows.map(lambda texts: None if texts is None else [x.ids for x in own.encode_batch(list(texts), add_special_tokens=False)])

    @pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = loaded()
        for rows in batches:
            yield rows.map(lambda ids: None if ids is None else own.decode([int(i) for i in ids]))

    return Tokenizer(path, encode, decode, end_id)


def tokenizer(path: str | None = None, end_id: int = 0) -> Tokenizer:
    """The tokenizer of a file; bytes without one, and with a warning where file or library are missing."""
    if path is None:
        return BYTES
    try:
        import tokenizers  # noqa: F401
    except ImportError as e:
        warnings.warn(f"bytes in place of {path}: {e}", stacklevel=2)
        return BYTES
    if not os.path.exists(path):
        warnings.warn(f"bytes in place of {path}: there is no such file", stacklevel=2)
        return BYTES
    return from_file(path, end_id)


def encoded(text: Column, chosen: Tokenizer = BYTES, special: bool = False) -> Column:
    """Ids of a text; special puts the byte tokenizer's begin and end ids around them."""
    ids = F.get(chosen.encode(F.array(text)), 0)
    return F.concat(F.array(F.lit(chat.BOS_ID)), ids, F.array(F.lit(chosen.end_id))) if special else ids
