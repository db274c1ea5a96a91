"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie on every machine; a parameter of all operators that count tokens.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the public split pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The byte-level BPE of a rank file; strings of special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(
    df: DataFrame, text: str, keep: list[str], into: str = "n_tokens", vocabularies: str = VOCABULARIES, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``keep`` and the number of tokens of the whole text; null and empty texts have 0."""
    rows = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)), F.col(text).alias("_text"))
    out = T.StructType([*rows.schema.fields[:-1], T.StructField(into, T.IntegerType())])
    path = f"{vocabularies}/{vocabulary}"

    def count(batches):
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(sizes, pa.int32())], names=out.fieldNames())

    return rows.mapInArrow(count, out).withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keep)})
