"""Token counts from a registry of byte-pair vocabularies."""

from __future__ import annotations

import base64
from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FALLBACK_ENCODING = "cl100k_base"
VOCABULARY_MAX_BYTES = 32 * 1024 * 1024
GPT2_STYLE_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


@dataclass(frozen=True)
class Vocabulary:
    """A rank file (one base64 token and its rank per line) and its split pattern."""

    file: str
    split: str = GPT2_STYLE_SPLIT


@lru_cache(maxsize=16)
def _encoding(name: str, split: str, content: bytes):
    import tiktoken

    ranks = {
        base64.b64decode(token): int(rank)
        for token, rank in (line.split() for line in content.splitlines() if line)
    }
    return tiktoken.Encoding(name, pat_str=split, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Counts tokens on the executors.

    ``vocabularies`` maps encoding names to rank files; an encoding that is not
    registered counts with the fallback encoding. A registered file is read
    once here, checked for size and broadcast.
    """

    def __init__(self, spark: SparkSession, vocabularies: Mapping[str, Vocabulary]):
        if FALLBACK_ENCODING not in vocabularies:
            raise ValueError(f"a vocabulary for {FALLBACK_ENCODING} is required")
        self.names = tuple(vocabularies)
        shipped = {}
        for name, vocabulary in vocabularies.items():
            content = Path(vocabulary.file).read_bytes()
            if len(content) > VOCABULARY_MAX_BYTES:
                raise ValueError(f"the vocabulary of {name} is too large to broadcast")
            shipped[name] = (vocabulary.split, content)
        self._shipped: Broadcast = spark.sparkContext.broadcast(shipped)

    def resolve(self, encoding: Column) -> Column:
        """The encoding used: the named one, or the fallback if unregistered."""
        return F.when(encoding.isin(*self.names), encoding).otherwise(FALLBACK_ENCODING)

    def count(self, text: Column, encoding: Column) -> Column:
        """Exact count; '' gives 0 and NULL text gives NULL at no cost."""
        shipped = self._shipped

        @F.pandas_udf(T.IntegerType())
        def counted(texts: pd.Series, encodings: pd.Series) -> pd.Series:
            known = shipped.value
            counts = []
            for text, name in zip(texts, encodings, strict=True):
                if text is None:
                    counts.append(None)
                    continue
                split, content = known[name]
                counts.append(len(_encoding(name, split, content).encode_ordinary(text)))
            return pd.Series(counts, dtype="Int32")

        return counted(text, self.resolve(encoding))
