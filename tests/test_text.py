"""Names, quoting, tokens and the parser on hand-made text."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillframe.functions import names, quoting, values
from quillframe.errors import ParseError
from quillframe.sources import star, tables, writer
from quillframe.streaming.ingest import ingest, read_store

ENTRY = """data_e1
# a comment with 'quotes
save_first _A.Sf_category a  _A.Sf_framecode first
_A.ID "1 one"
_A.Text
;one
two
;
 LOOP_ _B.x _B.Y 1 'it's' '_a' $second stop_
save_
SAVE_second
  _A.Sf_category a
  _A.Other save_free
  loop_
    _C.only
  stop_
save_
"""


def parse(spark, text):
    return star.parse(spark.createDataFrame([("f", text)], "file string, text string"))


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def test_names(spark):
    made = {"A.b": "_A", "_A.b.c": "_A", "x": "_x", "": "", None: None}
    for name, category in made.items():
        assert one(spark, names.format_category(F.lit(name).cast("string"))) == category
    assert one(spark, names.format_tag(F.lit("_A.b.c"))) == "b.c" and one(spark, names.format_tag_lower(F.lit("Tag"))) == "tag"
    assert one(spark, names.strip_reference(F.lit("$a"))) == "a" and one(spark, names.as_reference(F.lit("$a"))) == "$a"
    assert [one(spark, names.is_null(F.lit(v).cast("string"))) for v in (None, "", ".", "?", "0")] == [True] * 4 + [False]


QUOTED = {
    "two words": "'two words'", "it's a word": '"it\'s a word"', "stop_": "'stop_'", "Save_x": "'Save_x'", "#no": "'#no'", "a#b": "a#b", "_t": "'_t'", "bare": "bare",
    "  ": "'  '", "\nl\n": "\nl\n", "l\nm": "l\nm\n", None: ".", "$r": "$r", ";a": ";a", "'x": '"\'x"', 'say "a" b': "'say \"a\" b'", "a'b\"c": "'a'b\"c'",
    "a' b\"c": '"a\' b"c"', "a' b\" c": "a' b\" c\n", "a\n;b": "\n   a\n   ;b\n", "\n;b": "\n   ;b\n",
}


def test_quoting(spark):
    rows = spark.createDataFrame([(k,) for k in QUOTED], "v string")
    assert {r.v: r.q for r in rows.select("v", quoting.quote_value(F.col("v")).alias("q")).collect()} == QUOTED
    with pytest.raises(PySparkException):
        one(spark, quoting.quote_value(F.lit("")))


def test_tokens(spark):
    text = "data_#1 save_s _T.a v #gone\n_T.b \".-!?\" _T.c\n; begins here; and\n;\n_T#d \"in\"ner \"quotes\" '_.' $ \"1#\" ;data; $it\r\n_T.e\n;\n\n   not\n   moved\n;\n_T.f\n;\n\n   ;\n   was\n   moved\n;\n"
    found = star.tokens(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("pos").collect()
    assert [(r.token, r.delim) for r in found] == [
        ("data_#1", " "), ("save_s", " "), ("_T.a", " "), ("v", " "), ("_T.b", " "), (".-!?", '"'), ("_T.c", " "), (" begins here; and\n", ";"), ("_T#d", " "), ('in"ner "quotes', '"'), ("_.", "'"), ("$", " "),
        ("1#", '"'), (";data;", " "), ("$it", "$"), ("_T.e", " "), ("\n\n   not\n   moved\n"[1:], ";"), ("_T.f", " "), ("\n;\nwas\nmoved", ";"),
    ]
    assert [r.line_no for r in found][:5] == [1, 1, 1, 1, 2]


def test_parser(spark):
    found = parse(spark, ENTRY)
    assert found.errors.collect() == []
    cells = [(r.sf_name, r.kind, r.category, r.row_ord, r.tag, r.value) for r in found.cells.orderBy("sf_ord", "kind", "row_ord", "col_ord").collect()]
    assert cells == [
        ("first", "loop", "_B", 0, "x", "1"), ("first", "loop", "_B", 0, "Y", "it's"), ("first", "loop", "_B", 1, "x", "_a"), ("first", "loop", "_B", 1, "Y", "$second"),
        ("first", "tag", "_A", 0, "Sf_category", "a"), ("first", "tag", "_A", 0, "Sf_framecode", "first"), ("first", "tag", "_A", 0, "ID", "1 one"), ("first", "tag", "_A", 0, "Text", "one\ntwo\n"),
        ("second", "tag", "_A", 0, "Sf_category", "a"), ("second", "tag", "_A", 0, "Other", "save_free"),
    ]
    assert [(r.category, r.tags, r.n_rows) for r in found.loops.orderBy("sf_ord").collect()] == [("_B", ["x", "Y"], 2), ("_C", ["only"], 0)]
    assert [(r.sf_name, r.sf_category, r.tag_prefix) for r in found.saveframes.orderBy("sf_ord").collect()] == [("first", "a", "_A"), ("second", "a", "_A")]
    assert found.entries.first()[1:] == ("e1", 2)


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("save_a _A.b c save_", "does not begin"), ("data_ save_a _A.b c save_", "does not begin"), ("data_a data_b", "only begin"), ("data_a _A.b c", "outside"), ("data_a save_a _A.b c", "ends within"),
        ("data_a save_a save_b _A.b c save_", "before the last"), ("data_a save_a _A.b loop_ save_", "no value"), ("data_a save_a _A.b 'c save_", "quoted value"), ("data_a save_a _A.b\n;\nc save_", "text block"),
        ("data_a save_a loop_ _B.a _B.b 1 2 3 stop_ save_", "multiple"), ("data_a save_a loop_ _B.a 1 _B.b stop_ save_", "follows the data"), ("data_a save_a loop_ 1 stop_ save_", "before any tag"),
        ("data_a save_a loop_ _B.a _C.b 1 2 stop_ save_", "different categories"), ("data_a save_a loop_ _B.a _B.A 1 2 stop_ save_", "occurs twice"), ("data_a save_a _A.b c _A.B d save_", "occurs twice"),
        ("data_a save_a _A.b c _B.b d save_", "different categories"), ("data_a save_a _A.b c save_ save_a _A.b c save_", "one name"), ("data_a save_a loop_ _B.a save_ stop_ save_", "reserved"),
        ("data_a save_a _A.b _c save_", "underscore"), ("data_a save_a c save_", "no tag"), ("data_a save_a loop_ _B.a 1 loop_ stop_ stop_ save_", "before the last"), ("data_a save_a stop_ save_", "ends no loop"),
        ("data_a save_a _A.b c save_ save_", "ends no saveframe"),
    ],
)
def test_parse_errors(spark, text, message):
    found = parse(spark, text).errors.collect()
    assert any(message in r.message for r in found), found


def test_checked_raises(spark):
    with pytest.raises(PySparkException, match="Error detected on line 2"):
        parse(spark, "data_a save_a\n_A.b 'c\nsave_").checked().cells.collect()
    assert parse(spark, ENTRY).checked().cells.count() == 10


def test_text_round_trip(spark):
    odd = ["plain", "two words", "it's", "a' \"b", "#x", "_y", "line\nbreak\n", "data_z", "$r", ".", "é ü", "\n;x\n;y"]
    rows = [("e", 1, 1, i // 2, i % 2, v) for i, v in enumerate(odd)]
    cells = spark.createDataFrame(rows, "entry_id string, sf_ord int, loop_ord int, row_ord long, col_ord int, value string")
    loops = spark.createDataFrame([("e", 1, 1, "_L", ["a", "b"])], "entry_id string, sf_ord int, loop_ord int, category string, tags array<string>")
    frames = spark.createDataFrame([("e", 1, "s", "c", "_F")], "entry_id string, sf_ord int, sf_name string, sf_category string, tag_prefix string")
    tags = spark.createDataFrame([("e", 1, "tag", "_F", t, i, v) for i, (t, v) in enumerate([("Sf_category", "c"), ("Long_name", "x y"), ("T", "p\nq\n")])], "entry_id string, sf_ord int, kind string, category string, tag string, col_ord int, value string")
    loop_texts = writer.format_loops(cells, loops, ["entry_id", "sf_ord", "loop_ord"])
    banner = spark.createDataFrame([("c", "# banner\n")], "category string, comment string")
    text = writer.format_entries(writer.format_frames(frames, tags, loop_texts, banner)).first().text
    assert text.startswith("data_e\n\n# banner\nsave_s\n   _F.Sf_category  c\n   _F.Long_name    'x y'\n   _F.T          \n;\np\nq\n;\n\n   loop_\n      _L.a\n      _L.b\n\n     plain")
    read = parse(spark, text)
    assert read.errors.collect() == []
    found = read.cells.where("kind = 'loop'").orderBy("row_ord", "col_ord").collect()
    assert [r.value for r in found] == odd
    assert [r.value for r in read.cells.where("kind = 'tag'").orderBy("col_ord").collect()] == ["c", "x y", "p\nq\n"]


def test_json_and_empty_columns(spark):
    read = parse(spark, ENTRY)
    again = star.from_json(writer.entry_json(read.saveframes, read.cells, read.loops), "json")
    columns = ["sf_ord", "kind", "category", "row_ord", "col_ord", "tag", "value"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, read.cells.select(columns).collect()))
    with pytest.raises(PySparkException):
        star.from_json(spark.createDataFrame([('{"saveframes":[]}',)], "value string")).collect()
    cells = spark.createDataFrame([("e", 0, 0, "1"), ("e", 0, 1, ".")], "entry_id string, row_ord long, col_ord int, value string")
    loops = spark.createDataFrame([("e", "_L", ["a", "b"])], "entry_id string, category string, tags array<string>")
    assert writer.format_loops(cells, loops, ["entry_id"], skip_empty_tags=True).first().text == "\n   loop_\n      _L.a\n\n     1    \n\n   stop_\n"


def test_values(spark):
    texts = ["1", "-2.5e3", "1d", "1_000", ".", "", None, "abc", "2006-9-7", "1."]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(values.as_integer(F.col("v")).alias("i"), values.as_number(F.col("v")).alias("n"), values.as_date(F.col("v")).cast("string").alias("d")).collect()
    assert [r.i for r in rows] == [1, *[None] * 9]
    assert [r.n for r in rows] == [1.0, -2500.0, None, None, None, None, None, None, None, 1.0]
    assert [r.d for r in rows][8] == "2006-09-07"
    assert one(spark, F.regexp_like(F.lit("a]b"), F.lit(values.java_pattern("[][ab]+")))) and not one(spark, F.regexp_like(F.lit("a\r"), F.lit(values.java_pattern("a"))))


def test_files_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.str").write_bytes(ENTRY.replace("\n", "\r\n").encode())
    import gzip

    (source / "b.str.gz").write_bytes(gzip.compress(ENTRY.replace("data_e1", "data_e2").encode()))
    found = star.read_files(spark, str(source))
    assert found.errors.count() == 0 and {r.entry_id: r.n for r in found.cells.groupBy("entry_id").agg(F.count("*").alias("n")).collect()} == {"e1": 10, "e2": 10}
    for _ in range(2):
        ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "cells")).count() == 20


def test_the_latest_file_of_an_entry_counts(spark, tmp_path):
    import os

    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(name, entry, value, time):
        (source / name).write_text(f"data_{entry}\nsave_a\n_A.v {value}\nloop_\n_B.x\n1\n2\nstop_\nsave_\n" if value else f"data_{entry}\n")
        os.utime(source / name, (time, time))

    def held():
        ingest(spark, str(source), out, str(tmp_path / "check")).awaitTermination()
        found = read_store(spark, out)
        assert found.loops.count() == found.saveframes.count() == found.entries.count()
        return {r.entry_id: r.value for r in found.cells.where("tag = 'v'").select("entry_id", "value").collect()}

    put("a1", "a", "one", 1_000_000)
    put("b1", "b", "one", 1_000_000)
    assert held() == {"a": "one", "b": "one"}
    put("a2", "a", "two", 2_000_000)
    put("c", "c", "one", 2_000_000)
    assert held() == {"a": "two", "b": "one", "c": "one"}
    put("a0", "a", "late", 500_000)  # older than what is there
    put("b2", "b", None, 3_000_000)  # takes the entry away
    (source / "bad").write_text("# nothing")
    assert held() == {"a": "two", "c": "one"} == held()
    assert [r.message for r in read_store(spark, out).errors.collect()] == ["The file does not begin with 'data_' and a name."]


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("data_a save_a save_", "no tag that names its category"), ("data_a save_a _A.b c loop_ _B.a 1 stop_ loop_ _b.c 2 stop_ save_", "Two loops"),
        ("data_a save_a _A.x 1 _a.y 2 save_", "spell its category"),
    ],
)
def test_rules_of_saveframes(spark, text, message):
    with pytest.raises(ParseError, match=message) as error:
        parse(spark, text).checked()
    assert error.value.line_no == 1 and error.value.file == "f"


def test_single_frames_and_loops(spark):
    texts = spark.createDataFrame([("x", "save_a _A.b c save_"), ("y", "save_a _A.b c save_ save_b _A.b c save_")], "id string, text string")
    read = star.one_frame(texts, "id", "text")
    assert [(r.file, r.message) for r in read.errors.collect()] == [("y", "There is more than one saveframe.")]
    loops = star.one_loop(spark.createDataFrame([("x", "loop_ _L.a 1 2 stop_"), ("y", "loop_ _L.a 1 stop_ loop_ _M.a 1 stop_"), ("z", "loop_ _L.a stop_")], "id string, text string"), "id", "text")
    assert [(r.file, r.message) for r in loops.errors.collect()] == [("y", "There is more than one loop.")]
    assert [(r.file, r.message) for r in loops.warnings().collect()] == [("z", "A loop has no data.")]
    assert [t.count() for t in star.empty_tables(spark, "e")] == [0, 0, 0]


def test_json_of_frames_and_loops(spark):
    frame = '{"name":"n","category":"c","tag_prefix":"_A","tags":[["x","1"]],"loops":[{"category":"_L","tags":["a","b"],"data":[["1",null]]}]}'
    cells = star.frames_from_json(spark.createDataFrame([("i", frame)], "id string, j string"), "id", "j").collect()
    assert sorted((r.entry_id, r.sf_name, r.kind, r.tag, r.value or "") for r in cells) == [("i", "n", "loop", "a", "1"), ("i", "n", "loop", "b", ""), ("i", "n", "tag", "x", "1")]
    for wrong in ('{"tags":["a"],"data":[["1"]]}', '{"category":"_L","tags":["a"],"data":[["1","2"]]}'):
        with pytest.raises(PySparkException):
            star.loops_from_json(spark.createDataFrame([("i", wrong)], "id string, j string"), "id", "j").collect()


def test_csv_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text('_L.a,_L.b\n1,"x, ""y"""\n2,"two\nlines"\n')
    category, rows = tables.loop_from_csv(spark, str(tmp_path / "l.csv"))
    assert category == "_L" and sorted(map(tuple, rows.collect())) == [("1", 'x, "y"'), ("2", "two\nlines")]
    lines = tables.loop_to_csv(rows.withColumn("n", F.col("a").cast("long")), ["a", "b"], "_L", "n", show_category=False).orderBy("n").collect()
    assert [r.line for r in lines] == ["a,b", '1,"x, ""y"""', '2,"two\nlines"']
    with pytest.raises(ValueError, match="one row"):
        tables.frame_from_csv(spark, str(tmp_path / "l.csv"))
    (tmp_path / "r.csv").write_text("_L.a,_L.b\n1,2,3\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        tables.frame_from_csv(spark, str(tmp_path / "r.csv"))
    (tmp_path / "f.csv").write_text('_L.a,_L.b\n1,"x, ""y"""\n')
    category, tags = tables.frame_from_csv(spark, str(tmp_path / "f.csv"))
    assert [(r.tag, r.value) for r in tags.orderBy("col_ord").collect()] == [("a", "1"), ("b", 'x, "y"')]
    (tmp_path / "m.csv").write_text("_L.a,_M.b\n1,2\n")
    with pytest.raises(ValueError):
        tables.loop_from_csv(spark, str(tmp_path / "m.csv"))
    read = parse(spark, "data_x save_c _C.a b loop_ _Banner.category _Banner.comment first 'hello  ' second . stop_ save_")
    assert [tuple(r) for r in tables.banners(read.cells).collect()] == [("first", "hello\n\n")]
