"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

``write_tokens`` orders documents by id over range partitions, encodes them and writes one ORC file a
task; each row carries its offset within its file, so that readers can take stripes in parallel and
still know every document's global offset from one small sum a file. ``read_tokens`` adds those
offsets; ``find_documents`` reads only the stripes and row groups whose statistics and Bloom filters
admit the wanted ids.

Ties on the id are ordered by a hash of the text, which also splits a very frequent id over tasks.
Defined results: a null or empty text is its end id alone; null ids come first; repeated rows are each
stored; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import gathered, id_and_text, scratch_folder, text_slices
from quillframe.llm.pretokens import library, load

SCHEMA = "doc_id long, part int, local_start long, n_tokens int, token_ids array<int>"
#: Bytes of text that are encoded at once in a task.
GROUP = 1 << 22
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "2000", "orc.stripe.size": str(32 << 20), "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending order of document id."""
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, written = library(shared.value), 0
        for batch in gathered(batches, GROUP):
            for start, texts in text_slices(batch, limit=GROUP):
                lists, rows = encoder.encode_texts(texts, [end_id]), len(texts)
                bounds = lists.offsets.to_numpy().astype(np.int64)
                columns = [batch.column(0).slice(start, rows), batch.column(2).slice(start, rows), pa.array(written + bounds[:-1]), pa.array(np.diff(bounds).astype(np.int32)), lists]
                written += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "local_start", "n_tokens", "token_ids"])

    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document with ``start``: the ids stored before it in the whole order.

    The broadcast side has one row a written file.
    """
    stored = spark.read.schema(SCHEMA).orc(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return stored.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "token_ids")


def find_documents(spark: SparkSession, path: str, ids: Iterable[int]) -> DataFrame:
    """The stored rows of some documents; the filter is pushed to ORC's indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin([int(i) for i in ids])).select("doc_id", "n_tokens", "token_ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """CRC-32 of each document's ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds, data = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every row of ``documents`` as ORC, read the files back and digest them."""
    import public_tokenizers

    path = scratch_folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return checksums(read_tokens(spark, path))
