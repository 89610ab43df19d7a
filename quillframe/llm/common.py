"""Scratch storage and small Arrow helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as the contracts state them: space and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text whose arrays are held at once in a task.
GROUP = 1 << 19
#: Keys with more than one in so many rows are joined by broadcast, since one task would get all rows of a key. There are fewer such keys than this.
HOT = 1000
#: Rows that one task may join at any rate.
FEW = 100_000


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, in the store that every node shares.

    The cluster names that store in ``spark.checkpoint.dir``. Where the setting is absent, a temporary
    folder takes its place for the life of a local session; on a cluster that is an error, since other
    machines would not see the folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let this session's Arrow batches hold about ``most`` bytes, so that a task's memory does not grow with the texts' length.

    Tasks hold several copies of a batch in the JVM and in Python; the default of 64 MB a batch is ample for numbers, not for texts.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


#: Spark's setting that removes the shuffle files of a query as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the scratch store and read it back: recomputation stops there when an executor is lost.

    The shuffle files that led to it go at once; Spark would keep them until the driver collects its garbage.
    """
    return _written(df, scratch_folder(df.sparkSession, name))


def _written(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def held_table(df: DataFrame, name: str, *by: str) -> Iterator[DataFrame]:
    """A table in the scratch store for the length of a ``with`` block, in a folder for each value of the columns ``by``.

    What is made of it must be written before the block ends, since the table's files go then.
    """
    path = scratch_folder(df.sparkSession, name)
    try:
        yield _written(df, path, by)
    finally:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def join_hot(rows: DataFrame, small: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Left join of ``rows`` with ``small``, which has one row a key, its columns, and in ``key_rows`` how many of ``rows`` have it.

    Keys of more than one in ``HOT`` rows are joined by broadcast (fewer than ``HOT`` rows, by their counts), the
    others by shuffle, so no task gets all rows of a hot key. Rows whose key is null have nulls in the added columns.
    Up to ``FEW`` rows are joined as they are.
    """
    total = rows.count() if total is None else total
    if total <= FEW:
        return rows.join(small.drop("key_rows"), key, "left").select(*rows.columns, *[c for c in small.columns if c not in (key, "key_rows")])
    added = [c for c in small.columns if c not in (key, "key_rows")]
    hot = small.where(F.col("key_rows") * HOT > total)
    held = rows.where(F.col(key).isNotNull())
    common = held.join(F.broadcast(hot.drop("key_rows")), key)
    others = held.join(F.broadcast(hot.select(key)), key, "left_anti").join(small.drop("key_rows"), key, "left")
    none = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(small.schema[c].dataType).alias(c) for c in added])
    columns = [*rows.columns, *added]
    return common.select(columns).unionByName(others.select(columns)).unionByName(none.select(columns))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def gathered(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together up to ``limit`` bytes, in order; larger ones as they are."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = GROUP) -> Iterator[tuple[int, pa.StringArray]]:
    """Texts of a batch in runs of about ``limit`` bytes, each with its first row's index.

    A text longer than the limit makes a run of its own; nothing is cut. What
    Arrow holds unused goes back with the batch: Spark keeps workers, and their memory, from stage to stage.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    start, size = 0, 0
    for i, length in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > start and size + length > limit:
            yield start, texts.slice(start, i - start)
            start, size = i, 0
        size += length
    if len(texts) > start:
        yield start, texts.slice(start)
    pa.default_memory_pool().release_unused()


def text_groups(batch: pa.RecordBatch, column: str = "text", limit: int = GROUP) -> Iterator[tuple[int, list[str]]]:
    """The runs of ``text_slices`` as strings (null: empty); only one run at a time leaves Arrow."""
    for start, texts in text_slices(batch, column, limit):
        yield start, [t or "" for t in texts.to_pylist()]
