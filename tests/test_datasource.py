"""The data source: ranges, compression told by content, and commits."""

import gzip
import os
import zlib

import pytest
from pyspark.sql import functions as F

from quillframe.sources import datasource, star
from tests.test_segments import TEXTS, UNENDED, WHOLE


def same(got, want):
    assert got.exceptAll(want).collect() == [] and want.exceptAll(got).collect() == []


def by_name(df):
    return df.withColumn("file", F.regexp_extract("file", "([^/]+)$", 1))


@pytest.mark.parametrize(("segment", "split"), [(7, 11), (40, 40), (1 << 20, 1 << 20)])
def test_any_ranges_give_the_same_tables(spark, tmp_path, segment, split):
    long = WHOLE.replace("kept", "kept " * 50_000) if segment > 40 else WHOLE
    made = {k: v.encode() for k, v in TEXTS.items()} | {"empty.str": b"", "long": long.encode(), "gz.str": gzip.compress(WHOLE.encode()), "two.str": gzip.compress(WHOLE[:100].encode()) + gzip.compress(WHOLE[100:].encode()), "z.txt": zlib.compress(UNENDED.encode()), "x": b"x\x9cdata"}
    plain = dict(TEXTS) | {"empty.str": "", "long": long, "gz.str": WHOLE, "two.str": WHOLE, "z.txt": UNENDED, "x": b"x\x9cdata".decode("utf-8", "replace")}
    for name, data in made.items():
        path = tmp_path / ("deep/er" if name == "long" else ".") / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "_hidden").write_bytes(b"data_")
    got = datasource.read_large_files(spark, str(tmp_path), segment, split)
    want = star.parse(spark.createDataFrame(list(plain.items()), "file string, text string"))
    for a, b in ((got.cells, want.cells), (got.errors, want.errors), (got.loops, want.loops), (got.entries, want.entries)):
        same(by_name(a).select(b.columns), b)


def test_large_files_are_planned_in_ranges(spark, tmp_path):
    (tmp_path / "big").write_text("data_a\nsave_a\n_A.b c\nloop_\n_B.x\n" + "value\n" * 50_000 + "stop_\nsave_\n")
    for i in range(20):
        (tmp_path / f"small{i}").write_text("data_a\n")
    reader = datasource.Reader({"path": str(tmp_path), "segment": "4096", "split": "65536"})
    parts = reader.partitions()
    assert len(parts) == 5 and sum(len(p.pieces) for p in parts) == 25
    sizes = datasource.read_segments(spark, str(tmp_path), 4096, 65536).agg(F.max(F.length("text")).alias("most"), F.count("*").alias("n")).first()
    assert sizes.most < 4096 + 20 and sizes.n > 70


def test_truncated_and_missing(spark, tmp_path):
    (tmp_path / "a").write_bytes(gzip.compress(b"data_a\n" * 1000)[:-20])
    with pytest.raises(Exception, match="ends early"):
        datasource.read_segments(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="nowhere"):
        datasource.read_segments(spark, str(tmp_path / "nowhere")).collect()
    with pytest.raises(Exception, match="segment"):
        datasource.read_segments(spark, str(tmp_path), 10, 5).collect()


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_written_entries_are_read_again(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"e/{i}", f"data_e{i}\nsave_a\n_A.b {i}\nsave_\n") for i in range(20)], "entry_id string, text string").repartition(4)
    datasource.write_entries(rows, out)
    assert len(files(out)) == 20 and all(x.startswith("part-") and x.endswith(".str") for x in files(out))
    assert {r.value for r in datasource.read_large_files(spark, out).cells.collect()} == {str(i) for i in range(20)}
    datasource.write_entries(rows.limit(1), out)
    assert len(files(out)) == 21
    datasource.write_entries(rows.limit(2), out, "json", "overwrite")
    assert len(files(out)) == 2 and all(x.endswith(".json") for x in files(out))


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(str(i), "data_a\n") for i in range(40)], "entry_id string, text string").repartition(4)
    datasource.write_entries(rows.limit(3), out)
    before = files(out)
    late = rows.withColumn("text", F.when(F.col("entry_id") == "37", F.lit(None)).otherwise(F.col("text")))
    for bad in (late, rows.unionByName(rows).coalesce(1)):
        with pytest.raises(Exception, match="needs an id|two entries"):
            datasource.write_entries(bad, out)
        assert files(out) == before and not os.path.exists(f"{out}/_temporary")
    with pytest.raises(ValueError, match="no format"):
        datasource.write_entries(rows, out, "yaml")
    with pytest.raises(Exception, match="entry_id, text"):
        rows.select("entry_id").write.format(datasource.NAME).mode("append").save(out)


def test_compressed_columns(spark):
    data = [(None,), (b"plain",), (gzip.compress("é".encode()),), (zlib.compress(b"z"),), (b"x^not zlib",), (b"",)]
    got = [r.t for r in spark.createDataFrame(data, "b binary").select(datasource.inflate("b").alias("t")).collect()]
    assert got == [None, "plain", "é", "z", "x^not zlib", ""]
    texts = spark.createDataFrame([(None,), ("",), ("é" * 1000,)], "t string")
    assert [tuple(r) for r in texts.select("t", datasource.inflate(datasource.deflate("t"))).collect()] == [(None, None), ("", ""), ("é" * 1000,) * 2]
