"""Loops, entries, the dictionary, validation, normalisation and comparison."""

import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillframe.functions.lineage import cut
from quillframe.operators import compare, dictionary, entries, listing
from quillframe.operators import frames as upkeep
from quillframe.operators.table import ROW, Loop, numbered
from quillframe.plans import catalogue, normalize, validate
from quillframe.sources import star


@pytest.fixture(scope="module")
def loop(spark):
    return Loop.of(spark.createDataFrame([(1, 2, 3), (4, 5, 6), (7, 8, 9)], "tag1 int, tag2 int, tag3 int"), "test", ["tag1"])


def rows(found):
    return [tuple(r[t] for t in found.tags) for r in found.df.orderBy(ROW).collect()]


def test_projection(loop):
    assert rows(loop.filter(["_test.TAG3", "tag1"])) == [(3, 1), (6, 4), (9, 7)]
    assert loop.filter(["tag3", "none"], ignore_missing=True).tags == ("tag3",)
    with pytest.raises(KeyError):
        loop.filter(["none"])
    with pytest.raises(ValueError):
        loop.filter(["tag1", "TAG1"])
    with pytest.raises(ValueError):
        loop.get_tag("_other.tag1")
    assert loop.tag_index("TAG2") == 1 and loop.tag_index("x") is None
    assert loop.get_tag("tag2", whole_tag=True).orderBy(ROW).first()["tag2"] == ("_test.tag2", 2)


def test_rows(loop):
    kept, gone = loop.remove_rows("tag2", 5)
    assert rows(kept) == [(1, 2, 3), (7, 8, 9)] and gone.count() == 1
    assert rows(kept.renumber("tag1", 5)) == [(5, 2, 3), (6, 8, 9)]
    assert rows(loop.renumber("tag2", 1, maintain_ordering=True)) == [(1, 1, 3), (4, 4, 6), (7, 7, 9)]
    assert rows(loop.add_dicts([{"TAG1": 10}, {"tag3": 11}]))[3:] == [(10, None, None), (None, None, 11)]
    assert rows(loop.add_columns({"tag1": [1, 2], "tag2": [3]}))[3:] == [(1, 3, None), (2, None, None)]
    assert rows(loop.add_flat([1, 1, 1, 2, 2, 2]))[3:] == [(1, 1, 1), (2, 2, 2)]
    for wrong in (lambda: loop.add_flat([1]), lambda: loop.add_dicts([{"x": 1}])):
        with pytest.raises((ValueError, KeyError)):
            wrong()
    assert rows(loop.clear()) == [] and loop.slice(1, 3).count() == 2


def test_tags(loop):
    assert rows(loop.remove_tags("tag1", "tag3")) == [(2,), (5,), (8,)]
    assert rows(loop.add_tag(" _test.new "))[0] == (1, 2, 3, None)
    for name in ("a b", "", ".", "tag1"):
        with pytest.raises(ValueError):
            loop.add_tag(name)
    assert loop.add_missing_tags(["tag2", "tag9", "tag1"]).tags == ("tag2", "tag9", "tag1", "tag3")
    assert rows(loop.set_tag("tag1", loop.df.select(ROW, (F.col("tag2") * 2).alias("value"))))[2] == (16, 8, 9)
    assert loop.non_empty_tags().first() == (True, True, True)


def test_sorting(spark):
    made = spark.createDataFrame([("10", "a", 0), ("9", "b", 1), ("9", "a", 2), ("1", "b", 3)], f"n string, s string, {ROW} long")
    assert [r[0] for r in rows(Loop(made, "_l", ("n", "s")).sort("n"))] == ["1", "9", "9", "10"]
    assert rows(Loop(made, "_l", ("n", "s")).sort("n", "s")) == [("9", "a"), ("10", "a"), ("1", "b"), ("9", "b")]
    text = made.withColumn("n", F.when(F.col("n") == "1", ".").otherwise(F.col("n")))
    assert [r[0] for r in rows(Loop(text, "_l", ("n", "s")).sort("n"))] == [".", "10", "9", "9"]
    assert [r[1] for r in rows(Loop(made, "_l", ("n", "s")).sort_by(F.desc("s")))] == ["b", "b", "a", "a"]


def test_numbering_over_many_ranges(spark):
    found = numbered(spark.range(1000).repartition(7).withColumn("k", 999 - F.col("id")), ["k"], "n", 5).collect()
    assert all(r.n == r.k + 5 for r in found)


TEXT = """data_{id}
save_one _Sample.Sf_category sample _Sample.Sf_framecode one _Sample.ID 7 _Sample.Entry_ID x _Sample.Name first
loop_ _Part.Ordinal _Part.ID _Part.Sample_ID 2 8 7 1 9 7 stop_ save_
save_two _Sample.Sf_category sample _Sample.Sf_framecode two _Sample.ID 3 _Sample.Entry_ID x _Sample.Name second save_
save_use _Use.Sf_category use _Use.Sf_framecode use _Use.ID 1 _Use.Entry_ID x _Use.Sample_ID 3
loop_ _Use_row.ID _Use_row.Sample_label _Use_row.Sample_ID 5 $one 99 6 $gone 3 stop_ save_
"""


@pytest.fixture(scope="module")
def known(spark):
    made = []
    for frame, tags in {"use": ["_Use.Sf_category", "_Use.Sf_framecode", "_Use.ID", "_Use.Entry_ID", "_Use.Sample_ID"], "sample": ["_Sample.Sf_category", "_Sample.Sf_framecode", "_Sample.ID", "_Sample.Entry_ID", "_Sample.Name"]}.items():
        for tag in tags:
            made.append({"tag": tag, "sf_category": frame, "nullable": not tag.endswith("ID"), "star_type": "int" if tag.endswith(".ID") else "any", "local_id_flag": tag.endswith((".ID", "Entry_ID")), "entry_id_flag": tag.endswith("Entry_ID")})
    made[4] |= {"fk_table": "Sample", "fk_column": "ID", "data_type": "INTEGER"}
    for frame, tag, extra in [("sample", "_Part.Ordinal", {}), ("sample", "_Part.ID", {}), ("sample", "_Part.Sample_ID", {"fk_table": "Sample", "fk_column": "ID"}), ("use", "_Use_row.ID", {}), ("use", "_Use_row.Sample_ID", {"fk_table": "Sample", "fk_column": "ID"}), ("use", "_Use_row.Sample_label", {"fk_table": "Sample", "fk_column": "Sf_framecode", "sf_pointer": True})]:
        made.append({"tag": tag, "sf_category": frame, "is_loop": True, "data_type": "VARCHAR(5)", **extra})
    return dictionary.from_rows(spark, made, {"int": "(?:-?[0-9]*)?", "any": ".*"})


def parsed(spark, text, name="e"):
    found = star.parse(cut(spark.createDataFrame([("f", text.format(id=name))], "file string, text string")))
    return star.StarTables(found.entries, *map(cut, (found.saveframes, found.loops, found.cells)), found.errors)


def values_of(cells):
    return {(r.sf_name, r.category, r.row_ord, r.tag): r.value for r in cells.collect()}


def test_normalisation(spark, known):
    found = parsed(spark, TEXT)
    cells, frames = normalize.normalize(found.cells, found.saveframes, known)
    assert [r.sf_name for r in frames.orderBy("sf_ord").collect()] == ["use", "two", "one"]
    value = values_of(cells)
    assert value["one", "_Sample", 0, "ID"] == "2" and value["two", "_Sample", 0, "ID"] == "1" and value["use", "_Use", 0, "Sample_ID"] == "1"
    assert {value[f, c, 0, "Entry_ID"] for f, c in (("one", "_Sample"), ("two", "_Sample"), ("use", "_Use"))} == {"e"}
    assert [value["one", "_Part", i, "Ordinal"] for i in (0, 1)] == ["1", "2"] and [value["one", "_Part", i, "ID"] for i in (0, 1)] == ["1", "2"]
    assert {value["one", "_Part", i, "Sample_ID"] for i in (0, 1)} == {"2"}
    assert value["use", "_Use_row", 0, "Sample_ID"] == "2" and value["use", "_Use_row", 1, "Sample_ID"] == "1"
    again, _ = normalize.normalize(cells, frames, known)
    assert values_of(again) == value
    blocks = TEXT.split("save_\nsave_")
    for seed in range(2):
        mixed = blocks[:1] + random.Random(seed).sample(blocks[1:], len(blocks) - 1)
        shuffled = parsed(spark, "save_\nsave_".join(b if i == len(mixed) - 1 else b for i, b in enumerate(mixed)).rstrip().removesuffix("save_") + " save_\n")
        assert values_of(normalize.normalize(shuffled.cells, shuffled.saveframes, known)[0]) == value
    assert [(r.tag_full, r.value) for r in normalize.dangling_keys(found.cells, known).collect()] == [("_Use_row.Sample_ID", "99")]


def test_validation(spark, known):
    text = TEXT.replace("_Use.ID 1", "_Use.ID x").replace("_Sample.Name second", "_Sample.name '.'").replace("5 $one 99", "5 $one 999999")
    found = parsed(spark, text)
    messages = [r.message for r in validate.validate(found.cells, found.saveframes, found.loops, known).collect()]
    for part in ("Dangling saveframe reference $gone", "does not match specification: '_Use.ID", "Length of '6' is too long"):
        assert any(part in m for m in messages), messages
    assert len(messages) == 3
    typed = {r.tag: (r.typed, r.convertible) for r in validate.convert(found.cells, known).where("sf_name = 'use' and kind = 'tag'").collect()}
    assert typed["Sample_ID"] == ("3", True)


def test_entries(spark, known):
    found = parsed(spark, TEXT)
    cells, frames = entries.rename_frame(found.cells, found.saveframes, "$one", "uno")
    value = values_of(cells)
    assert value["use", "_Use_row", 0, "Sample_label"] == "$uno" and value["uno", "_Sample", 0, "Sf_framecode"] == "uno" and frames.where("sf_name = 'uno'").count() == 1
    assert entries.dangling_references(found.cells, found.saveframes).count() == 1
    assert {r.value for r in entries.set_entry_id(found.cells, known, "new").where("tag = 'Entry_ID'").collect()} == {"new"}
    assert [r.value for r in entries.get_tags(found.cells, ["_part.id"]).orderBy("row_ord").collect()] == ["8", "9"]
    assert entries.frames_by_tag_value(found.cells, "Name", "second").first().sf_ord == 2
    assert [r.sf_category for r in entries.category_list(found.saveframes).orderBy("nth").collect()] == ["sample", "use"]
    empty = parsed(spark, "data_a save_b _B.Sf_category b _B.c . save_ save_d _B.Sf_category b _B.c 1 save_")
    assert [r.sf_ord for r in entries.empty_frames(empty.cells, empty.saveframes).collect()] == [1]
    left = entries.remove_empty_frames(empty.cells, empty.saveframes)
    assert [x.where("sf_ord = 1").count() for x in left] == [0, 0] and left[1].count() == 1
    with pytest.raises(PySparkException):
        entries.rename_frame(found.cells, found.saveframes, "one", "two")
    with pytest.raises(PySparkException):
        entries.remove_items(found.saveframes, "sf_name", ["nobody"]).collect()
    assert entries.remove_items(found.saveframes, "sf_name", ["two"]).count() == 2
    assert entries.contains_all(found.saveframes, "sf_name", ["ONE", "two"]).first().all_there


def test_comparison(spark):
    one, other = parsed(spark, TEXT), parsed(spark, TEXT.replace("_Sample.Name first", "_Sample.Name third").replace("2 8 7 1 9 7", "1 9 7 2 8 0").replace("save_use", "save_used"))
    side = lambda x: (x.saveframes, x.cells)
    assert compare.compare_entries(side(one), side(one)).count() == 0
    messages = [r.message for r in compare.compare_entries(side(one), side(other)).collect()]
    assert "tag differs: _sample.name first third" in messages and sum("loop row" in m and "_part" in m for m in messages) == 2 and sum("missing" in m for m in messages) == 2
    swapped = parsed(spark, TEXT.replace("2 8 7 1 9 7", "1 9 7 2 8 7"))
    assert compare.compare_entries(side(one), side(swapped)).count() == 0
    assert compare.report(spark.createDataFrame([], "k int"), "'x'", ["k"]).first().line == "Identical entries."


def test_dictionary(spark, known, tmp_path):
    assert [r.tag for r in dictionary.loop_template(known, "use_row").orderBy("place").collect()] == ["_Use_row.ID", "_Use_row.Sample_ID", "_Use_row.Sample_label"]
    frame = {r.tag: r.value for r in dictionary.frame_template(known, "sample", "s1", "e9").collect()}
    assert frame["_Sample.Sf_category"] == "sample" and frame["_Sample.Sf_framecode"] == "s1" and frame["_Sample.Entry_ID"] == "e9" and frame["_Sample.Name"] is None
    assert {r.sf_name for r in dictionary.entry_template(known, "e").collect()} == {"use_1", "sample_1"}
    for tag, kind in (("no_dot", "TEXT"), ("_a.b", "BLOB")):
        with pytest.raises(ValueError):
            dictionary.extend(known, tag, kind)
    path = tmp_path / "d.csv"
    path.write_text("\n".join(["tag,number,frame,type", "TBL_BEGIN,,1.0,", '_A.b,2,a,"VARCHAR(3)"', "_A.a,1,a,INTEGER", "TBL_END,,,"]))
    positions = {"tag": 0, "seq": 1, "sf_category": 2, "is_loop": 4, "data_type": 3, "star_type": 4}
    read = dictionary.read_dictionary(spark, str(path), positions, {"any": ".*"})
    assert [r.tag for r in read.orderBy("seq").collect()] == ["_A.a", "_A.b"]


def test_catalogue_takes_whole_tables(spark, tmp_path):
    docs = [(i, lang, source, text) for i, (lang, source, text) in enumerate([(None, "b", "t"), ("fr", None, None), ("es", "a", "t"), ("en", "c", "t"), ("de", "a", "t"), ("es", "b", "t")])]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "a b"), (1, 1, None)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def key(name, known):
        return (0, known.index(name), "") if name in known else (1, 0, hashlib.sha1(name.encode()).hexdigest()) if name else (2, 0, "")

    for query, column, known in (("normalize_order_lang", 1, ["de", "en"]), ("normalize_order_source", 2, ["de"])):
        found = [r.sf_ord for r in catalogue.QUERIES[query](spark, str(tmp_path)).orderBy("new_ord").collect()]
        assert found == [d[0] for d in sorted(docs, key=lambda d: (*key(d[column], known), d[0]))]
    quoted = catalogue.QUERIES["quote_value_conversations"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, quoted), key=str) == [("conversation", 1, 0, "'a b'"), ("conversation", 1, 1, "."), ("document", 1, None, ".")]


def test_frames(spark):
    found = parsed(spark, TEXT)
    frames, cells = found.saveframes, found.cells.select("entry_id", "sf_ord", "sf_name", "sf_category", "kind", "loop_ord", "category", "row_ord", "col_ord", "tag", "value")
    at = frames.where("sf_name = 'one'").select("entry_id", "sf_ord")
    tag = lambda t, v: at.select("*", F.lit(t).alias("tag"), F.lit(v).cast("string").alias("value"))
    more, moved = upkeep.add_tags(cells, frames, tag("_Sample.New", None).unionByName(tag("Sf_category", "other")).unionByName(tag("name", "x")), update=True)
    value = values_of(more)
    assert value["one", "_Sample", 0, "New"] == "." and value["one", "_Sample", 0, "name"] == "x" and value["one", "_Part", 0, "ID"] == "8" and more.count() == cells.count() + 1
    assert moved.where("sf_name = 'one'").first().sf_category == "other" and moved.columns == frames.columns
    for wrong in (tag("Name", "x"), tag("_Other.a", "x"), tag("a b", "x")):
        with pytest.raises(PySparkException):
            upkeep.add_tags(cells, frames, wrong)[0].collect()
    with pytest.raises(PySparkException):
        upkeep.add_tags(cells, frames, tag("Sf_framecode", "two"), update=True)[0].collect()
    renamed, frames_ = upkeep.set_frame(cells, frames, "one", "uno", "kind", "Probe")
    value = values_of(renamed)
    assert value["uno", "_Probe", 0, "Sf_framecode"] == "uno" and value["uno", "_Probe", 0, "Sf_category"] == "kind" and value["uno", "_Part", 0, "ID"] == "8"
    assert frames_.where("sf_name = 'uno'").first().tag_prefix == "_Probe"
    for name in ("a b", ".", "", None):
        with pytest.raises(ValueError):
            upkeep.checked_name(name)
    with pytest.raises(PySparkException):
        upkeep.frame_by_name(frames, "nobody").collect()
    with pytest.raises(PySparkException):
        upkeep.add_items(frames, frames.limit(1), ["entry_id", "sf_name"]).collect()
    with pytest.raises(PySparkException):
        listing.only_frame(frames, "sample").collect()
    assert upkeep.frame_by_place(frames, 1).first().sf_name == "two"


def test_typed_loops(spark, loop):
    known = dictionary.from_rows(spark, [{"tag": "_t.i", "data_type": "INTEGER"}, {"tag": "_t.f", "data_type": "FLOAT"}, {"tag": "_t.d", "data_type": "DATETIME year to day"}])
    made = Loop(spark.createDataFrame([(0, "12345678901234567890", "1e3", "2006-9-7", "x"), (1, ".", "?", "", None)], f"{ROW} long, i string, f string, d string, other string"), "_t", ("i", "f", "d", "other"))
    typed = rows(made.converted(known, strict=True))
    assert [str(x) for x in typed[0]] == ["12345678901234567890", "1000.0", "2006-09-07", "x"] and typed[1] == (None,) * 4
    bad = Loop(spark.createDataFrame([(0, "1x")], f"{ROW} long, i string"), "_t", ("i",))
    assert rows(bad.converted(known)) == [(None,)]
    with pytest.raises(PySparkException):
        bad.converted(known, strict=True).df.collect()
    with pytest.raises(ValueError):
        loop.add_by_tag([("tag2", 1)])
    with pytest.raises(ValueError):
        loop.append_positional(loop.df.select(ROW, "tag1"))
    with pytest.raises(PySparkException):
        loop.set_tag("tag1", loop.df.limit(1).select(ROW, F.lit(1).alias("value"))).df.collect()
    assert loop.tag_names()[0] == "_test.tag1" and loop.set_category("new.x").category == "_new"
    assert dictionary.loop_from_template(known, "t").tags == ("i", "f", "d")
    with pytest.raises(ValueError):
        dictionary.loop_from_template(known, "nothing")


def test_normalisation_shuffles_only_cells_that_point_and_keeps_stages_by_column(spark):
    known = dictionary.from_rows(spark, [
        {"tag": "_C.ID", "sf_category": "c", "star_type": "int", "local_id_flag": True},
        {"tag": "_O.C_ID", "sf_category": "c", "is_loop": True, "fk_table": "C", "fk_column": "ID"}, {"tag": "_O.Name", "sf_category": "c", "is_loop": True},
    ])
    cells = [("e", k, f"c{k}", "c", "tag", 0, "_C", 0, 0, "ID", str(10 * k)) for k in (1, 2)]
    cells += [("e", k, f"c{k}", "c", "loop", 1, "_O", r, i, t, v) for k in (1, 2) for r in (0, 1) for i, (t, v) in enumerate((("Name", None), ("C_ID", str(10 * k) if r else "99")))]
    cells = spark.createDataFrame(cells, "entry_id string, sf_ord long, sf_name string, sf_category string, kind string, loop_ord long, category string, row_ord long, col_ord int, tag string, value string")
    frames = spark.createDataFrame([("e", k, f"c{k}", "c", "_C") for k in (1, 2)], "entry_id string, sf_ord long, sf_name string, sf_category string, tag_prefix string")
    done, _ = normalize.normalize(cells, frames, known)
    found = {(r.sf_ord, r.kind, r.row_ord, r.tag): r.value for r in done.collect()}
    assert {k: v for k, v in found.items() if k[1] == "tag"} == {(1, "tag", 0, "ID"): "1", (2, "tag", 0, "ID"): "2"}
    assert [found[k, "loop", r, "C_ID"] for k in (1, 2) for r in (0, 1)] == ["99", "1", "99", "2"]
    assert len(found) == 10 and found[1, "loop", 0, "Name"] is None
    assert any("/rows-" in f for f in done.inputFiles())
