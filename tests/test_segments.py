"""Files in segments: the same tables whatever the segments are, and malformed files by rule."""

import re

import pytest
from pyspark.sql import functions as F

from quillframe.sources import star

WHOLE = """data_e1
# a ; comment 'x
save_first
 _A.Sf_category a
 _A.Sf_framecode first
 _A.ID "1 one" _A.Text
;one
two ' " # _x
 ;three
;
 _A.Note ;
save_no
loop_ stop_
;
 loop_ _B.x
 _B.Y
 1 'it''s'
 ;
inner

;
 '_a' $second
 stop_
save_
save_second
 _C.Sf_category a
 _C.One
;

   ;
   kept
;
 loop_
  _D.only
  1 2
  3
  # between
  4
 stop_
 loop_ _E.none stop_
save_
"""
UNENDED = "data_a\nsave_a\n_A.b c\n_A.d\n;\nopen\nsave_\nloop_\n_B.x\n1 2\n"
BROKEN = "data_a\nsave_a\n_A.b 'c\nloop_\n_B.x _B.y\n1\n2\n3\nstop_\nsave_\nsave_a\n_A.b\n;\nx\n;\n_A.B d\nsave_\n;\n\n"
TEXTS = {"whole": WHOLE, "unended": UNENDED, "broken": BROKEN, "crlf": WHOLE.replace("\n", "\r\n"), "starts": "data_a\nsave_a\n_A.a\n;x\n;y\n;z\n;\n;\nsave_\n"}


def segments(text, cuts):
    """A repaired text cut at some of its line ends, where the next line begins with no semicolon."""
    ends = [m.end() for m in re.finditer("\n(?!;)", text)][:-1] if text.endswith("\n") else [m.end() for m in re.finditer("\n(?!;)", text)]
    at = [0, *[e for i, e in enumerate(ends) if cuts(i)], len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def test_every_cut_gives_the_same_tables(spark):
    given = spark.createDataFrame(list(TEXTS.items()), "file string, text string")
    repaired = {r.file: r.text for r in star.cut_texts(given).collect()}
    rows, n = [], 0
    for file, text in repaired.items():
        lines = text.count("\n")
        for name, cuts in {"all": lambda i: True, "even": lambda i: i % 2 == 0, "third": lambda i: i % 3 == 2} .items() | {f"c{k}": (lambda i, k=k: i == k) for k in range(lines)}.items():
            parts = segments(text, cuts)
            n += len(parts) > 1
            rows += [(f"{file}/{name}", i, i == len(parts) - 1, x) for i, x in enumerate(parts)]
    assert n > 100
    cut = star.parse_segments(spark.createDataFrame(rows, "file string, seg int, last boolean, text string").repartition(4))
    whole = star.parse(given)
    names = spark.createDataFrame([(f, f.partition("/")[0]) for f in {r[0] for r in rows}], "file string, source string")
    for got, want in ((cut.entries, whole.entries), (cut.saveframes, whole.saveframes), (cut.loops, whole.loops), (cut.cells, whole.cells), (cut.errors, whole.errors)):
        wanted = want.withColumnRenamed("file", "source").join(names, "source").select("file", *[c for c in want.columns if c != "file"])
        got = got.select(wanted.columns)
        assert got.exceptAll(wanted).collect() == [] and wanted.exceptAll(got).collect() == []


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_cut_texts_loses_nothing(spark, size):
    given = spark.createDataFrame([*TEXTS.items(), ("none", None), ("empty", "")], "file string, text string")
    joined = {r.file: r for r in star.cut_texts(given, size).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda x: x["text"]), "").alias("text"), F.sum(F.col("last").cast("int")).alias("n")).collect()}
    whole = {r.file: r.text for r in star.cut_texts(given).collect()}
    assert {k: r.text for k, r in joined.items()} == whole and {r.n for r in joined.values()} == {1}
    assert all(r.seg == 0 or not r.text.startswith(";") for r in star.cut_texts(given, size).collect())


def test_tokens_of_segments(spark):
    given = spark.createDataFrame([("w", WHOLE)], "file string, text string")
    plain = [tuple(r)[2:] for r in star.tokens(given).orderBy("pos").collect()]
    assert [tuple(r)[2:] for r in star.tokens_of_segments(star.cut_texts(given, 15)).orderBy("pos").collect()] == plain


@pytest.mark.parametrize(
    ("text", "message"),
    [
        (None, "does not begin"), ("", "does not begin"), (" \n# only\n", "does not begin"), ("data_a save_a _A.Sf_framecode b save_", "not the saveframe's name"), ("data_a save_a _Ax 1 save_", "names its category"),
        ("data_a save_a _A.b c loop_ _B.a 1 'stop_' stop_ save_", "may not be quoted"), ("data_a save_a _A. c save_", "has no name"), ("data_a save_a _A.b.c d save_", "more than one"),
        ("data_a save_a _A.b c loop_ _B.c.d 1 stop_ save_", "more than one"), ("data_a save_a _A.b c loop_ _b 1 stop_ save_", "names no category"), ("data_a save_a _A.? c save_", "has no name"),
    ],
)
def test_more_parse_errors(spark, text, message):
    found = star.parse(spark.createDataFrame([("f", text)], "file string, text string"))
    errors = found.errors.collect()
    assert any(message in r.message for r in errors), errors
    assert found.entries.count() == 1


def test_tag_without_category_takes_its_frames(spark):
    found = star.parse(spark.createDataFrame([("f", "data_a save_a _A.b c _d 'stop_' _A.Sf_framecode a save_")], "file string, text string"))
    assert found.errors.collect() == []
    assert [(r.category, r.tag, r.value) for r in found.cells.orderBy("col_ord").collect()] == [("_A", "b", "c"), ("_A", "d", "stop_"), ("_A", "Sf_framecode", "a")]


def test_a_text_is_cut_once_and_tokens_are_read_a_few_times(spark):
    texts = spark.createDataFrame([("w", WHOLE)], "file string, text string")
    cut = star.cut_texts(texts, 20)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    tokens = star._explode_tokens(cut.selectExpr("*", "false AS inside", "false AS opens", "'' AS block", "0L AS line_before")).checkpoint()
    plan = star._classified(tokens, True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 4, plan


def test_a_loop_over_many_segments(spark):
    text = "data_a\nsave_a\n_A.b c\nloop_\n_B.x\n" + "".join(f"{i}\n" for i in range(4000)) + "stop_\nsave_\n"
    parsed = star.parse_segments(star.cut_texts(spark.createDataFrame([("w", text)], "file string, text string"), 100))
    assert parsed.cells.where("kind = 'loop'").agg(F.count("*"), F.sum("value"), F.max("row_ord")).first()[:] == (4000, 7998000.0, 3999)
    assert parsed.errors.count() == 0
