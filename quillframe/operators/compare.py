"""Comparison of tables and entries: multisets of rows, and tags by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.lineage import cut
from quillframe.operators.listing import numbered_lines


#: Buckets of rows whose digests are compared before any row is.
BUCKETS = 1 << 12


def _hashes(columns: Sequence[Column]) -> tuple[Column, Column]:
    """Two hashes of some values, nulls told apart from each other's places."""
    told = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *told), F.xxhash64(F.lit(2), *told)


def _digest(hashes: Sequence[Column]) -> list[Column]:
    """Aggregates that tell multisets apart: their size, and the sums of the halves of the members' hashes.

    Sums are the same in any order and combine in tasks; halves keep them within 64 bits for 2**31 rows a group and more.
    """
    halves = [half for h in hashes for half in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"h{i}") for i, x in enumerate(halves)]]


_DIGEST = ("n", "h0", "h1", "h2", "h3")


def _unequal(one: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of (keys, digest) whose digests differ, or that one side lacks; each side has a row a key at most."""
    both = one.unionByName(other).groupBy(*keys).agg(F.count("*").alias("sides"), F.count_distinct(*_DIGEST).alias("kinds"))
    return both.where("sides < 2 or kinds > 1").select(*keys)


def _same_types(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their shared columns, under the types that their union has."""
    shared = [c for c in one.columns if c in other.columns]
    a, b = one.select(*shared), other.select(*shared)
    kinds = a.unionByName(b).schema
    return tuple(x.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields]) for x in (a, b))


def differing_buckets(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides with ``_bucket``, and the buckets (at most ``BUCKETS``) in which they differ; one aggregate a side finds these."""
    sides, digests = [], []
    for side in _same_types(one, other):
        hashes = _hashes([F.col(c) for c in side.columns])
        sides.append(side.withColumn("_bucket", F.pmod(hashes[0], F.lit(BUCKETS))))
        digests.append(sides[-1].groupBy("_bucket").agg(*_digest(hashes)))
    return *sides, _unequal(*digests, ["_bucket"])


def compare_rows(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that only one side has, as multisets; ``side`` names it.

    Rows are dealt into buckets by hash, and only buckets whose digests differ are compared row by row: sides that are
    equal cost one aggregate each, and no row of theirs is shuffled.
    """
    a, b, buckets = differing_buckets(one, other)
    buckets = F.broadcast(cut(buckets))
    a, b = (x.join(buckets, "_bucket", "left_semi").drop("_bucket") for x in (a, b))
    signed = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))).groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "left").otherwise("right")
    return signed.withColumn("side", side).withColumn("_k", F.explode(F.array_repeat(F.lit(0), F.abs("_n").cast("int")))).drop("_n", "_k")


def compare_by_key(one: DataFrame, other: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, left_value, right_value) of keys whose values differ, or that one side lacks."""
    a = one.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_left"))
    b = other.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_right"))
    joined = a.join(b, list(keys), "full")
    return joined.where(F.col("_left").isNull() | F.col("_right").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).drop("_left", "_right")


def exactly_equal(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: whether both sides have the same rows, ordinals included. Only digests are compared."""
    _, _, buckets = differing_buckets(one, other)
    return buckets.agg((F.count("*") == 0).alias("equal"))


def report(differences: DataFrame, message: str, order: Sequence[str], none: str = "Identical entries.") -> DataFrame:
    """Numbered lines of a report; the line ``none`` when there is nothing to say."""
    return numbered_lines(differences.select(*order, F.expr(message).alias("line")), order, none)


def equal_text(texts: DataFrame, text_col: str, other: str) -> DataFrame:
    """One row: whether every text of a column is exactly a given rendering."""
    return texts.agg(F.bool_and(F.sha2(F.col(text_col).cast("binary"), 256) == F.sha2(F.lit(other).cast("binary"), 256)).alias("equal"))


def entry_messages(one: tuple[DataFrame, DataFrame], other: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Messages on whole entries: ids and numbers of saveframes that differ, then those of ``compare_entries``."""
    count = lambda side: side[0].agg(F.max("entry_id").alias("entry_id"), F.count("*").alias("n"))
    a, b = count(one).toDF("id_a", "n_a"), count(other).toDF("id_b", "n_b")
    both = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k")  # one row each
    ids = both.where(~F.col("id_a").eqNullSafe(F.col("id_b"))).select(F.concat_ws(" ", F.lit("entry ids differ:"), "id_a", "id_b").alias("message"))
    sizes = both.where("n_a <> n_b").select(F.concat_ws(" ", F.lit("numbers of saveframes differ:"), F.col("n_a").cast("string"), F.col("n_b").cast("string")).alias("message"))
    return ids.unionByName(sizes).unionByName(compare_entries(one, other).select("message"))


_BRANCH = ["sf_name", "kind", "branch"]


def branch_digests(cells: DataFrame) -> DataFrame:
    """(sf_name, kind, branch, digest): digests of every saveframe's tags, and of every category of its loops.

    A row's digest sums its cells', a branch's sums its rows'; loops' order and their rows' order do not matter, columns' order does.
    """
    tag = F.col("kind") == "tag"
    cell = F.when(tag, F.struct(F.lit(-1).alias("at"), F.lower(F.concat_ws(".", "category", "tag")).alias("tag"), F.coalesce("value", F.lit(".")).alias("value")))
    cell = cell.otherwise(F.struct(F.col("col_ord").cast("int").alias("at"), F.lower("tag").alias("tag"), F.col("value").alias("value")))
    inner = cells.select("sf_name", "kind", F.when(~tag, F.lower("category")).alias("branch"), F.when(~tag, F.col("loop_ord")).alias("l"), F.when(~tag, F.col("row_ord")).alias("r"), cell.alias("c"))
    rows = inner.groupBy(*_BRANCH, "l", "r").agg(*_digest(_hashes([F.col("c.at"), F.col("c.tag"), F.col("c.value")])))
    return rows.groupBy(*_BRANCH).agg(*_digest(_hashes([F.col(c) for c in _DIGEST])))


def compare_entries(one: tuple[DataFrame, DataFrame], other: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Messages on the differences of two sides, each its (frames, cells): missing saveframes, tags that differ, rows that differ.

    Digests go up from cells to rows, and from rows to a saveframe's tags or loops; only what differs there is compared in full.
    """
    frames_a, frames_b = (side[0].select("sf_name", "tag_prefix") for side in (one, other))
    frames = compare_by_key(frames_a, frames_b, ["sf_name"], "tag_prefix").select("sf_name", F.concat(F.lit("saveframe differs or is missing: "), "sf_name").alias("message"))
    branches = cut(_unequal(branch_digests(one[1]), branch_digests(other[1]), _BRANCH))
    in_tags, in_loops = branches.where("kind = 'tag'").select("sf_name"), branches.where("kind = 'loop'").select("sf_name", F.col("branch").alias("low"))
    key = F.lower(F.concat_ws(".", "category", "tag")).alias("name")
    tags_a, tags_b = (side[1].where("kind = 'tag'").join(in_tags, "sf_name", "left_semi").select("sf_name", key, F.coalesce("value", F.lit(".")).alias("value")) for side in (one, other))
    tags = compare_by_key(tags_a, tags_b, ["sf_name", "name"], "value").select("sf_name", F.concat_ws(" ", F.lit("tag differs:"), "name", "left_value", "right_value").alias("message"))

    def rows(cells: DataFrame) -> DataFrame:
        held = cells.where("kind = 'loop'").withColumn("low", F.lower("category")).join(in_loops, ["sf_name", "low"], "left_semi")
        row = F.transform(F.array_sort(F.collect_list(F.struct("col_ord", F.lower("tag").alias("tag"), "value"))), lambda x: F.struct(x["tag"].alias("tag"), x["value"].alias("value")))
        return held.groupBy("sf_name", F.col("low").alias("category"), "loop_ord", "row_ord").agg(row.alias("row")).select("sf_name", "category", F.to_json("row").alias("row"))

    loops = compare_rows(rows(one[1]), rows(other[1])).select("sf_name", F.concat_ws(" ", F.lit("loop row only on the"), "side", F.lit("side of"), "category", "row").alias("message"))
    return frames.unionByName(tags).unionByName(loops)
