"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the tokenizer files; it must exist on every worker.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The encoder, made once a worker process; special token strings in a text are ordinary text."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("folioloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; null for a null text, 0 for an empty one."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(folder, vocabulary).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count(text)
