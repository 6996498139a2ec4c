"""Sizes of texts in tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WordPunct rule: runs of letters, digits and underscores, or of other characters but white space.
TOKEN = r"(?U)[\p{L}\p{N}_]++|[^\p{L}\p{N}_\s]++"


def wordpunct_count(text: Column) -> Column:
    """Number of WordPunct tokens, in the JVM; null for null."""
    return F.regexp_count(text, F.lit(TOKEN))


def bpe_count(path: str):
    """A pandas UDF that counts the tokens of a public byte-level BPE file (``tokenizers`` JSON)."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            encoded = tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([len(e.ids) for e in encoded]).where(texts.notna().to_numpy())

    return count
