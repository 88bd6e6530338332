"""Token counts by a vocabulary file, for budgets that a model's own tokenizer has to hold."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


@cache
def loaded(path: str):
    """The tokenizer of a file that every worker can reach, once in each of them. Its special tokens are plain text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _encoded(path: str, texts: list[str]):
    return loaded(path).encode_batch(texts, add_special_tokens=False)


def vocabulary_tokens(text: Column, path: str) -> Column:
    """How many tokens a text is; 0 for null."""
    ship(SparkSession.active())

    @F.pandas_udf("long")
    def count(column: pd.Series) -> pd.Series:
        return pd.Series([len(e.ids) for e in _encoded(path, column.fillna("").tolist())], dtype="int64")

    return count(text)


def fit_to_vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """docs(text, max_tokens, ...) with text cut to at most max_tokens tokens, at paragraphs and lines as far as that goes."""
    from ..operators.context import truncate_paragraphs

    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def fit(text: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for t, n, e in zip(text.fillna(""), most, _encoded(path, text.fillna("").tolist()), strict=True):
            n = max(int(n), 0)
            room = e.offsets[n - 1][1] if 0 < n < len(e.ids) else len(t) if n else 0
            while len(e.ids) > n:
                t = truncate_paragraphs(t, room) if room else ""
                e = loaded(path).encode(t, add_special_tokens=False)
                room = room * 9 // 10  # a closed fence may have added tokens
            out.append(t)
        return pd.Series(out)

    return docs.withColumns({"original_length": F.length("text"), "text": fit("text", "max_tokens")})
