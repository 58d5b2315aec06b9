"""Token counts: by a byte-pair tokenizer whose file is a parameter, or whitespace words where there is none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .markdown import words

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].encode_special_tokens = True  # their names in a text are ordinary text
    return _loaded[path]


def counter(path: str | None = None):
    """A Column function; the tokenizer is loaded once in each worker."""
    if path is None:
        return words

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        known = [x for x in texts if x is not None]
        sizes = iter([len(x.ids) for x in _tokenizer(path).encode_batch(known, add_special_tokens=False)])
        return pd.Series([None if x is None else next(sizes) for x in texts], dtype="Int64")

    return lambda text: count(text)


def count(text: Column, path: str | None = None) -> Column:
    return counter(path)(text)
