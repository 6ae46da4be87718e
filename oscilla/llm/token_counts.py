"""Token counts: Arrow functions that encode whole texts and return lengths only.

Rows of an Arrow batch are regrouped into batches of about ``BATCH`` bytes of UTF-8; texts beyond
that size are cut at safe boundaries, where no token can cross.

Defined results.  Null or empty text: 0 bytes, 0 tokens.  Repeated ids and null ids: a result for
each row.  Very long texts: cut safely, counted whole.  Empty table: empty result.  Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from oscilla.llm import common
from oscilla.llm.vocab import default_path, encoder

LIMIT = 512
BATCH = 2 << 20


def _counted(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in common.record_batches(batches):
            n = pa.array(enc.encode((t or "" for t in b.column("text").to_pylist()), counts=True, most=BATCH)[1])
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    return common.two_columns(docs, key, text).mapInArrow(_counted(tokenizer or default_path(), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
