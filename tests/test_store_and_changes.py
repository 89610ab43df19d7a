"""The clustered store, the log of changes, comparison by digests, validation by distinct value."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.errors import InvalidStateError
from quillframe.operators import compare, entries
from quillframe.operators.changes import KEY, CellLog
from quillframe.plans import validate
from quillframe.plans.catalogue import fixture
from quillframe.sources import store


def some_cells(spark, n=4000):
    rows = spark.range(n).select(F.lit("e").alias("entry_id"), (F.col("id") % 97).alias("sf_ord"), F.lit("loop").alias("kind"), F.lit(1).cast("long").alias("loop_ord"), F.concat(F.lit("_Cat"), F.col("id") % 40).alias("category"), F.col("id").alias("row_ord"))
    return rows.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(f"Tag{i}").alias("tag"), F.concat(F.lit(f"v{i}_"), F.col("row_ord") % 50).alias("value")) for i in range(5)])).alias("c")).select("*", "c.*").drop("c")


def rows_read(df):
    """Rows that the scans of a plan without exchange gave."""
    plan = df._jdf.queryExecution().executedPlan()
    df.sparkSession._jvm.scala  # the plan must have run
    df._jdf.collect()
    text, found, todo = plan, 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_look_ups_read_few_rows(spark, tmp_path):
    cells, path = some_cells(spark), str(tmp_path / "cells")
    store.write_cells(cells, path, row_group=1024)
    held = store.read_cells(spark, path)
    total = held.count()
    assert total == 20_000 and set(cells.columns) < set(held.columns)
    by_category = entries.loops_by_category(held, "cat7")
    assert rows_read(by_category) < total / 4
    assert by_category.count() == 500
    tagged = held.where((F.col("tag_lc") == "tag3") & (F.col("category_lc") == "_cat7") & (F.col("value") == "v3_7"))
    assert rows_read(tagged) < total / 4
    for f in (lambda c: entries.loops_by_category(c, "CAT7"), lambda c: entries.get_tags(c, ["_cat1.TAG2", "_cat3.tag0"]), lambda c: entries.frames_by_tag_value(c, "_Cat7.tag3", "v3_7")):
        got, want = f(held), f(cells)
        assert got.select(want.columns).exceptAll(want).collect() == [] and got.count() == want.count() > 0
    assert entries.get_tags(held, []).collect() == []


def test_many_edits_and_a_failing_one(spark, tmp_path):
    cells = some_cells(spark, 60)
    log, want = CellLog.create(cells, str(tmp_path / "log")), {tuple(r[k] for k in KEY): r.value for r in cells.collect()}
    rng = random.Random(2)
    keys = sorted(want)
    for n in range(1, 7):
        chosen = rng.sample(keys, 20)
        gone, set_to = [k for k in chosen[:5] if k in want], chosen[5:]
        changed = spark.createDataFrame([(*k, "_Cat", 0, f"new{n}") for k in set_to], "entry_id string, sf_ord long, kind string, loop_ord long, row_ord long, tag string, category string, col_ord int, value string")
        removed = spark.createDataFrame(gone, ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in KEY)) if gone else None
        assert log.commit(changed, removed) == n
        want = {k: v for k, v in want.items() if k not in gone} | {k: f"new{n}" for k in set_to}
        if n == 3:
            assert log.compact() == 3
    got = lambda version=None: {tuple(r[k] for k in KEY): r.value for r in log.read(version).collect()}
    assert got() == want and log.version == 6
    assert log.read().columns == cells.columns
    plan = log.read(2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1  # one pass over the base, however many commits
    twice = cells.limit(1).unionByName(cells.limit(1))
    missing = cells.limit(1).withColumn("row_ord", F.lit(10**9)).select(*KEY)
    for bad in ((twice, None), (None, missing), (cells.limit(1).withColumn("tag", F.lit(None).cast("string")), None)):
        with pytest.raises(InvalidStateError):
            log.commit(*bad)
        assert log.version == 6 and got() == want
    with pytest.raises(ValueError):
        log.commit()
    broken = cells.limit(1).withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        log.commit(broken)
    assert log.version == 6 and got() == want


def pairs(spark, seed, n=300):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.choice([None, 1, 2]), rng.choice([None, "a", ""]), rng.choice([0.0, -0.0, float("nan"), 2.5])) for _ in range(n)], "a int, b string, c double")


def test_comparison_equals_except_all(spark):
    one, other = pairs(spark, 1), pairs(spark, 2).withColumn("a", F.col("a").cast("long"))
    want = one.exceptAll(other).withColumn("side", F.lit("left")).unionByName(other.exceptAll(one).withColumn("side", F.lit("right")))
    got = compare.compare_rows(one, other)
    shown = lambda df: sorted((str(tuple(r)).replace("-0.0", "0.0") for r in df.select("a", "b", "c", "side").collect()))
    assert shown(got) == shown(want) != []
    assert compare.compare_rows(one, one.repartition(3)).collect() == [] and compare.exactly_equal(one, one.repartition(3)).first().equal
    swapped = spark.createDataFrame([(None, "x"), ("x", None)], "a string, b string")
    assert not compare.exactly_equal(swapped.limit(1), swapped.where("b is null")).first().equal
    assert compare.compare_rows(one.limit(0), one).count() == 300 and compare.exactly_equal(one.limit(0), one.limit(0)).first().equal


def test_equal_branches_are_not_compared(spark):
    cells = some_cells(spark, 200).withColumn("sf_name", F.concat(F.lit("s"), "sf_ord"))
    frames = cells.select("sf_name", F.lit("_C").alias("tag_prefix")).distinct()
    other = cells.withColumn("value", F.when((F.col("row_ord") == 7) & (F.col("tag") == "Tag1"), "x").otherwise(F.col("value")))
    assert compare.compare_entries((frames, cells), (frames, cells.repartition(2))).collect() == []
    assert compare._unequal(compare.branch_digests(cells), compare.branch_digests(other), compare._BRANCH).count() == 1
    found = compare.compare_entries((frames, cells), (frames, other)).collect()
    assert len(found) == 2 and all("loop row only on the" in r.message for r in found)


def test_hot_wrong_values_join_by_broadcast(spark, monkeypatch):
    cells = spark.range(300).select(F.lit("e").alias("entry_id"), F.col("id").alias("sf_ord"), F.lit("orders").alias("sf_category"), F.lit("tag").alias("kind"), F.lit(0).alias("loop_ord"), F.lit(0).alias("row_ord"), F.lit("_orders").alias("category"), F.lit("o_orderkey").alias("tag"), F.when(F.col("id") < 250, "bad").when(F.col("id") < 260, None).when(F.col("id") < 270, F.concat(F.lit("x"), "id")).otherwise(F.col("id").cast("string")).alias("value"))
    want = sorted(map(str, validate.cell_errors(cells, fixture(spark)).collect()))
    assert len(want) == 270
    monkeypatch.setattr(validate, "MANY", 100)
    assert sorted(map(str, validate.cell_errors(cells, fixture(spark)).collect())) == want
    assert validate.value_errors(cells, fixture(spark)).where("value = 'bad'").first().n == 250
