"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

#: The rank file is a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(documents: DataFrame, *keep: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The kept columns and n_tokens; null and empty texts have 0.

    The rank file, about a megabyte, is read on the driver and broadcast, so executors need no copy.
    """
    data = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.value.splitlines() if line)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            out = b[list(keep)].copy()
            out["n_tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield out

    kinds = dict(documents.dtypes)
    # kept columns travel as strings: a batch with a null would make floats of numbers
    plain = documents.select(*[documents[k].cast("string").alias(k) for k in keep], "text")
    counted = plain.mapInPandas(run, ", ".join([*(f"`{k}` string" for k in keep), "n_tokens bigint"]))
    return counted.select(*[counted[k].cast(kinds[k]).alias(k) for k in keep], "n_tokens")
