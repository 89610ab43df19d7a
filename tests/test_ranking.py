"""Ranks in groups of any size, and numbers that two runs agree on."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.operators.ranking import ranked_within


def test_ranks_equal_those_of_a_window(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 7 == 0, "b").when(F.col("id") == 5, "z").otherwise("a").alias("g"), (F.col("id") % 2 == 0).alias("h"), F.xxhash64("id").alias("v"), "id").repartition(3)
    for groups in (["g"], ["g", "h"]):
        want = rows.withColumn("n", F.row_number().over(Window.partitionBy(*groups).orderBy("v")).cast("long"))
        got = ranked_within(rows, groups, ["v"], "n")
        assert got.columns == want.columns
        assert got.exceptAll(want).collect() == [] and want.exceptAll(got).collect() == []


def test_a_large_group_spans_tasks(spark):
    one = spark.range(4000).select(F.lit("e").alias("g"), F.col("id").alias("v"))
    plan = ranked_within(one, ["g"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan
    assert ranked_within(one, ["g"], [F.desc("v")]).where("rank = 4000 - v").count() == 4000
    assert ranked_within(one.limit(0), ["g"], ["v"]).collect() == []
