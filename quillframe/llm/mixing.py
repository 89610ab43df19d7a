"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash in [0, 2**36). Words are summed by source and hash bucket; the bucket in which
a source's budget ends is refined, twice, by the next bits, and the source takes the documents whose
hash lies below the threshold found. Nothing is sorted, and what is not in a boundary bucket is summed
once. A target above the source's size takes every document whole as often as it fits, and the rest by
the threshold. Within the last bucket, the nearer of its two ends is taken.

All sums combine map-side, so a source with most of the rows costs one row a bucket and task. The only
joins are with one row a source; they are broadcast while there are at most ``SMALL`` sources.

Defined results: a null or empty text has size 0; a null source is a source of its own, the last; null
ids share one hash; repeated rows are taken or left together; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import WORD_PATTERN, materialise

LEVELS, BITS = 3, 12
SMALL = 100_000


def mix_key(id_col: str) -> Column:
    """A document's hash: the first 36 bits of the MD5 of its id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 9), 16, 10).cast("long")


def _beside(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Rows joined with their source's row, null included."""
    if small.count() <= SMALL:
        small = F.broadcast(small)
    return rows.join(small, "source_key")


def source_targets(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row a source: its size, and the words it should give.

    Sources in code-point order get the weights in turn. With sources ordered by cap / weight, those
    that reach their cap come first, and what is left is shared by weight among the others.
    """
    sizes = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    levels = caps.withColumn("level", level)
    shared = F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(Window.partitionBy())
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * shared, F.col("cap").cast("double")))
    targets = levels.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return targets.select("source_key", "source_size", "target", whole.alias("copies"), (F.col("target") - whole * F.col("source_size")).alias("budget"))


def find_thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source, the hash below which documents are taken once more."""
    state = targets.withColumn("prefix", F.lit(0).cast("long")).withColumn("left", F.col("budget"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bounds = state.select("source_key", "prefix", "left")
        inside = _beside(sized, bounds).where(F.shiftright("key", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source_key", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        running = F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket"))
        ends = sums.withColumn("upto", running).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
        found = ends.select("source_key", F.col("bucket").alias("found"), (F.col("left") - (F.col("upto") - F.col("words"))).alias("rest"), F.col("words").alias("last_words"))
        refined = state.select("source_key", *targets.columns[1:]).join(found, "source_key", "left")
        state = materialise(refined.select(*targets.columns, F.coalesce("found", F.lit(0)).alias("prefix"), F.coalesce("rest", F.lit(0.0)).alias("left"), "last_words"), f"mix_level_{level}")
    nearer = F.when(F.col("last_words").isNotNull() & (F.col("last_words") - F.col("left") < F.col("left")), 1).otherwise(0)
    return state.select("source_key", "source_size", "target", "copies", (F.col("prefix") + nearer).alias("threshold"))


def source_key(source_col: str) -> Column:
    """A source as a key that sorts by code point with null last, and equals itself."""
    return F.struct(F.col(source_col).isNull().alias("absent"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes, and one row a source with its target, whole copies and threshold."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(source_col).alias("source_key"), size.alias("size"), mix_key(id_col).alias("key")), "mix_sizes")
    targets = materialise(source_targets(sized, weights, most), "mix_targets")
    return sized, find_thresholds(sized, targets)


def copies_taken() -> Column:
    """How often the mix takes a document, from its hash and its source's row."""
    return F.col("copies") + F.when(F.col("key") < F.col("threshold"), 1).otherwise(0)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, **columns: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    sized, thresholds = mixing_plan(docs, weights, most, **columns)
    return _beside(sized, thresholds).select("doc_id", "size", "source_size", "target", (F.col("size") * copies_taken()).cast("long").alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with all its columns."""
    _, thresholds = mixing_plan(docs, weights, most, id_col, text_col, source_col)
    inner = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), source_key(source_col).alias("source_key"), mix_key(id_col).alias("key"))
    taken = _beside(inner, thresholds).withColumn("n", copies_taken().cast("int")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of every row of ``documents``."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 9) AS BIGINT) AS k
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked),
shared AS (SELECT max(level) AS level FROM levels WHERE cap > weight * level),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * (SELECT level FROM shared), CAST(cap AS DOUBLE))) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets),
keyed AS (
  SELECT source, k, sum(size) AS words FROM sized GROUP BY source, k),
running AS (
  SELECT source, k, words, sum(words) OVER (PARTITION BY source ORDER BY k) AS upto FROM keyed),
bounds AS (
  SELECT r.source, CASE WHEN r.upto - b.left_over < b.left_over - (r.upto - r.words) THEN r.k + 1 ELSE r.k END AS threshold
  FROM running r JOIN (SELECT *, target - copies * source_size AS left_over FROM budgets) b ON r.source IS NOT DISTINCT FROM b.source
  WHERE r.upto > b.left_over AND r.upto - r.words <= b.left_over)
SELECT s.doc_id, s.size, b.source_size, b.target,
       CAST(s.size * (b.copies + CASE WHEN s.k < coalesce(t.threshold, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN bounds t ON s.source IS NOT DISTINCT FROM t.source
"""
