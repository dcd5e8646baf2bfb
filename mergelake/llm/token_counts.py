"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelake.llm.common import small_batches
from mergelake.llm.units import balanced, encoder


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """Number of tokens of each whole text: doc_id, n_bytes, n_tokens, over_limit.

    No shuffle: each scan partition is encoded where it is read. Batches are regrouped by bytes; texts of any length are
    split at unit boundaries, where no pre-token can span, so the sum of the parts' lengths is the text's.

    A null or empty text has 0 bytes and 0 tokens; a null doc_id is kept; repeated rows are counted each; an empty table
    gives an empty result; columns besides doc_id and text are not read, whatever their names.
    """
    small_batches(docs.sparkSession)

    def lengths(batches):
        own = encoder(tokenizer_path)
        for batch in balanced(batches):
            counts = own.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(np.greater(counts, limit))], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
