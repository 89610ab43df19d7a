"""Connected components of an edge table, by contraction: every round merges nodes and drops the edges within them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillframe.llm.common import join_hot, materialise

#: Live edges up to which one task ends the contraction, instead of a dozen rounds over ever fewer rows. A fixed bound at any size of input.
REST = 20_000


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node of its component.

    In each round a node follows the first of its neighbours, or itself, in an order that is hashed anew, so
    that chains shrink by a constant factor. Edges then join what their ends followed; those within one node go.
    Only live edges and nodes are read again, so the rounds get cheaper; the last ``REST`` edges are contracted
    at once. At last the rounds' tables are composed, from the smallest on. Every table is written to the scratch store, which ends its lineage. Hubs are joined by
    ``join_hot``: no task gets all edges of a node. Nodes may be of any type that sorts and hashes.
    """
    live = materialise(edges.select(*_ordered("a", "b")).where("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while n := live.count():
        if n <= REST:
            rounds.append(materialise(_contract(live), "follows"))
            break
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))), c)  # noqa: B023, E731
        ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy("a").agg(F.min(order(F.col("b"))).alias("near"), F.count("*").alias("key_rows"))
        label = F.least(F.col("near"), order(F.col("a")).cast(first.schema["near"].dataType))
        follows = materialise(first.select(F.col("a").alias("node"), label[first.schema["near"].dataType.names[1]].alias("label"), "key_rows"), "follows")
        moved = join_hot(live, follows.select(F.col("node").alias("a"), F.col("label").alias("to_a"), "key_rows"), "a", n)
        moved = join_hot(moved, follows.select(F.col("node").alias("b"), F.col("label").alias("to_b"), "key_rows"), "b", n)
        live = materialise(moved.select(*_ordered("to_a", "to_b")).where("a <> b").distinct(), "edges")
        rounds.append(follows.select("node", "label"))
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[-1]
    for follows in reversed(rounds[:-1]):
        labels = materialise(_via(follows, labels.select(F.col("node").alias("label"), F.col("label").alias("root"))), "labels")
    return _via(labels, labels.groupBy("label").agg(F.min("node").alias("root")))


def _contract(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of at most ``REST`` edges (a, b): the least node of its component, found in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, kind = {}, None

        def find(x):
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            kind = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        if up:
            nodes = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "label"])

    kind = edges.schema["a"].dataType
    return edges.select("a", "b").coalesce(1).mapInArrow(run, StructType([StructField("node", kind), StructField("label", kind)]))


def _via(follows: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, label) with each label replaced by its root, where it has one."""
    held = follows.groupBy("label").agg(F.count("*").alias("key_rows"))
    return join_hot(follows, roots.join(held, "label"), "label").select("node", F.coalesce("root", "label").alias("label"))
