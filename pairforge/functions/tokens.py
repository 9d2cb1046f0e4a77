"""Token counts by a byte-level BPE vocabulary; the file is a parameter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts are counted in pieces that end before white space, so that none is very long; what a cut costs is a token at most.
_PIECE = re.compile(r"\s*\S{1,2000}|\s{1,2000}")


def bpe_tokens(text: Column, path: str) -> Column:
    """How many tokens the vocabulary file (of the tokenizers library) gives for a text; null has none. An upper estimate for runs of over 2,000 characters."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for texts in batches:
            yield pd.Series([len(tokenizer.encode(t, add_special_tokens=False).ids) if t and len(t) < 100_000 else sum(len(e.ids) for e in tokenizer.encode_batch(_PIECE.findall(t), add_special_tokens=False)) if t else 0 for t in texts], dtype="int64")

    return count(text)
