"""Token counts by a public vocabulary.

The vocabulary is a file of base64 tokens and ranks; its folder is a parameter and nothing is copied here.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the public byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(folder: str = FOLDER, name: str = VOCABULARY):
    """The byte-level BPE of a vocabulary file, read once per process; special tokens are ordinary text."""
    import tiktoken

    lines = Path(folder, name).read_bytes().splitlines()
    ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x)}
    return tiktoken.Encoding("public_byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(c: Column, folder: str = FOLDER) -> Column:
    """The number of tokens of a text, 0 for null; one Arrow batch at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(folder)
        for s in batches:
            yield s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(c)
