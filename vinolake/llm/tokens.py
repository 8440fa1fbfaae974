"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Default vocabulary file (byte-level BPE as ranks); read by the workers, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenization pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}
_sent: set[tuple[str, str]] = set()


def encoder(path: str = VOCABULARY):
    """The encoder of a vocabulary file, built once per worker process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a whole text; null and empty texts have none. The vocabulary file is sent to the workers by Spark."""
    spark, name = SparkSession.getActiveSession(), os.path.basename(path)
    sent = (spark.sparkContext.applicationId, path)
    if sent not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add(sent)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(SparkFiles.get(name))
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts.tolist()], dtype="int32")

    return count(text)
