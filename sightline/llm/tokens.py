"""Token counts by public tokenizers."""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the public split pattern of the byte-level vocabularies
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# a byte-level vocabulary file; the path is a parameter wherever it is used
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# a rank file is sent to the executors; a larger one than this is no vocabulary
MOST_BYTES = 64 << 20


def encoder(vocabulary: str = DEFAULT_VOCABULARY, content: bytes | None = None):
    """The tokenizer of a rank file (or of its ``content``), made once per Python process."""
    import tiktoken

    # functions arrive by value, with globals of their own: a module of this name holds what lasts
    made = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")).__dict__
    if vocabulary not in made:
        lines = (content if content is not None else Path(vocabulary).read_bytes()).split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        made[vocabulary] = tiktoken.Encoding(
            "byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return made[vocabulary]


def token_count(text: Column | str, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of a text as int; null and empty texts have 0.  Whole texts are read.

    Only the driver reads the vocabulary's path: its content, at most
    ``MOST_BYTES``, is broadcast.
    """
    from pyspark.sql import SparkSession

    content = Path(vocabulary).read_bytes()
    if len(content) > MOST_BYTES:
        raise ValueError(f"{vocabulary} is too large for a vocabulary")
    sent = SparkSession.active().sparkContext.broadcast(content)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary, sent.value).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return count(F.col(text) if isinstance(text, str) else text)
