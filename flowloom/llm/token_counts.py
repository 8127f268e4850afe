"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from flowloom.llm.bpe import by_bytes, byte_level
from flowloom.llm.common import map_batches, whole_texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, batch_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    Rows are regrouped into batches of about ``batch_bytes`` of text; texts are split at safe boundaries (where a
    pre-token always begins) and each distinct piece of a batch is encoded once. Null and empty texts have 0 bytes
    and 0 tokens. Repeated rows give repeated rows; an empty table gives an empty one. Columns other than doc_id
    and text are left out. No shuffle: one pass over the scan's partitions.
    """

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch.column("text"), batch_bytes):
                texts = batch.column("text")[part]
                counts = byte_level(tokenizer_path).lengths(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[part], "n_bytes": pc.cast(pc.binary_length(texts), pa.int64()), "n_tokens": pa.array(counts), "over_limit": pa.array(counts > limit)})

    return map_batches(whole_texts(docs), run, SCHEMA)
