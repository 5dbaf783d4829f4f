"""Token counts by heap-and-linked-list byte-pair merging: initial symbols minus merges, no identifiers emitted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import counter, loaded, run_counts
from .common import slim


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens; rows with a null id stay, with a null id; repeated rows are counted
    each; an empty table gives no rows; other columns of `docs` are not read. Texts are never cut; runs of
    texts of about 8 MB, or one longer text, are worked on at a time. A map without a shuffle: a lost executor costs only its tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = loaded(tokenizer, counter)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            n_tokens = run_counts(texts, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return slim(docs, id_col, text_col).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
