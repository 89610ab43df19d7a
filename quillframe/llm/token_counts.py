"""Token counts: map-side two-tier lookup.

Tier one is a broadcast table of frequent pre-tokens, bounded by the tokenizer's vocabulary, whose merges
rank frequency; it is asked first and always kept. Tier two encodes the others through each worker's bounded
cache. No pre-token leaves its task, so there is no
shuffle at all, and a key that holds a third of the rows changes nothing.

Defined results: a null or empty text has 0 bytes and 0 tokens; null ids, repeated rows and ties are
kept row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillframe.llm.common import id_and_text, text_groups
from quillframe.llm.pretokens import library, load


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UTF-8 bytes and tokens of each text, and whether it has more tokens than ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = library(shared.value)
        for batch in batches:
            for start, texts in text_groups(batch):
                n = np.fromiter(map(counter.count, texts), np.int64, len(texts))
                size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every row of ``documents``."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
