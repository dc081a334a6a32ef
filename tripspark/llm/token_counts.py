"""Token counts of documents: whole tokens are counted as they stand, only the rest is merged."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tripspark.llm.bpe import encoder, ship

LIMIT = 2048


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens and over_limit, without a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Every row is counted by itself, so repeated rows and null ids come
    back as they are; other columns are ignored; no rows give no rows.
    """
    shipped = ship(docs.sparkSession, tokenizer_path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(shipped)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [code.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
