"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

#: The default vocabulary; any file of byte-level BPE ranks will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how that public vocabulary splits a text before its byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ready: dict[str, object] = {}


def _encoding(data: bytes):  # noqa: ANN202
    import tiktoken

    key = hashlib.sha1(data, usedforsecurity=False).hexdigest()
    if key not in _ready:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _ready[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ready[key]


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", path: str = TOKENIZER) -> DataFrame:
    """`df` with the size of `text` in tokens as a last column `out` (BIGINT); null and empty texts have size 0. `text` itself is dropped, and
    a column that is called `out` already is replaced.

    The vocabulary is read once, on the driver, and broadcast: a file of fixed size (about 1 MB), which need not lie on the executors. Whole texts are encoded.
    """
    spark = df.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(Path(path).read_bytes())
    cols = [c for c in df.columns if c not in (text, out)]
    held = next(n for i in range(len(cols) + 1) if (n := f"_text{i}") not in cols)
    schema = df.select(*cols).schema.add(out, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value)
        for b in batches:
            size = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size, pa.int64())], [*b.schema.names[:-1], out])

    return df.select(*cols, F.col(text).cast("string").alias(held)).mapInArrow(count, schema)
