"""A corpus pipeline of the llm operators: each stage takes the documents its predecessor kept.

1. quality rules: documents that fail the base rules or the trees go;
2. n-gram Jaccard join: of each component of near copies (five-word shingles, 0.8 alike) one stays;
3. substring dedup: words in 50-word runs that an earlier document has are removed;
4. mixing: each source gives its target, documents being repeated or left out by hash threshold;
5. byte-level BPE: every document of the mix is encoded and decoded, and both are digested.

Stages 1 to 4 return the columns of ``documents``, and any more that the input has; a text that loses words in stage 3
stays, even empty.

Defined results: a null or empty text fails the base rules of stage 1, and is kept by all other stages; null ids are
kept, and count as the last in stages 2 and 3; rows that repeat one another in id and text count as one in stage 2; ties are
decided by a hash of the text; an empty table stays empty through all stages. ``n_chars`` is set anew in stage 3 where the
input has it. The stages bound the Arrow batches of the session they are given, and leave the bound set: it must still hold
when their result is read. The last stage writes the ids it makes of the documents, so its result reads no earlier stage's table.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import byte_bpe, mixing, ngram_join, quality, substring_dedup
from quillframe.llm.common import bound_batches, held_table, materialise

#: SQL cannot express fitted trees or byte-pair merges; the stages are tested against brute force.
ORACLE_SQL = None
SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by trees fitted to the labels of these documents."""
    bound_batches(spark)
    return quality.keep_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the least id."""
    bound_batches(spark)
    return ngram_join.keep_one(docs, SHINGLE, PERCENT)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word runs that documents with smaller ids have, and their lengths thereafter."""
    bound_batches(spark)
    kept = substring_dedup.drop_repeats(docs)
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else kept


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight, with repeated documents repeated."""
    return mixing.take_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the bytes they decode to, for every document of the mix.

    The ids are written between the two, so that a task has one Python worker at a time and not two.
    """
    import public_tokenizers

    bound_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(materialise(byte_bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN), "token_ids"), ranks)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("substring dedup", substring_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again; a stage's table goes when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = contextlib.ExitStack()
    for name, stage in STAGES[:-1]:
        with held:
            following = contextlib.ExitStack()
            docs = following.enter_context(held_table(stage(spark, docs, sf_dir), name.replace(" ", "_")))
        held = following
    with held:
        return STAGES[-1][1](spark, docs, sf_dir)
