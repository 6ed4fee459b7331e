"""Token counts of whole texts without keeping ids.

A task cuts its texts into pre-tokens, counts the pieces of each distinct pre-token
once (a worker remembers several hundred thousand of them between batches), joins the counts
to the per-document pre-token frequencies by dictionary code, and sums.
Nothing is shuffled, so a hot source or a very common word changes nothing.

Null text counts as empty: 0 bytes, 0 tokens.  A text of any length is counted whole, alone if it
is longer than a slice.  Repeated rows each get their own count.
Existing columns named like a result column are replaced; other columns are kept.
An empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pretokens


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    from .shared import add_columns, without

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n_bytes, n_tokens = pretokens.count_tokens(batch[text], tokenizer)
        return {"n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())}

    out = add_columns(without(docs, "over_limit"), {"n_bytes": T.LongType(), "n_tokens": T.LongType()}, keep, work, lambda b: pretokens.slices(b, text))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
