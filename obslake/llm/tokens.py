"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslake.tables import spread

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(4)
def encoder(path: str, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once per worker."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(path, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(path, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(documents: DataFrame, text: str = "text", path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The other columns and ``tokens``, the size of the whole text; null and empty texts have 0 tokens. A column tokens is replaced."""
    keep = [c for c in documents.columns if c not in (text, "tokens")]
    schema = ",".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema), "tokens int"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int32())], names=[*keep, "tokens"])

    return spread(documents.select(*keep, F.col(text))).mapInArrow(count, schema)
