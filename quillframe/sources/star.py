"""Tag/loop text files as relational tables: tokens by one pattern, structure by running sums over a file's tokens.

``read_files``/``parse`` give the cell model: ``entries``, ``saveframes``, ``loops``, ``cells`` and ``errors``.

``parse`` takes whole texts, each tokenised and ordered in one task. ``parse_segments`` takes texts that were cut into
segments of whole lines (``cut_texts``, or the reader in ``datasource``), so that one large file is parsed by many tasks:

1. A segment may begin outside or inside of a text block. Where it ends is found for either case; these maps of two
   states are composed by a running window with one row a segment, which gives every segment its true beginning.
2. Segments are tokenised from there. Blocks that span segments are stitched, and take the place of their beginning.
3. Every count that runs over a file (loops, saveframes, values of a loop) is a sum within the segment plus the sums of the
   segments before, and no task holds more tokens than a segment has.

A text that is null, empty or only comments has a row in ``entries`` and an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.errors import ParseError
from quillframe.functions.lineage import cut
from quillframe.functions.names import NULL_TEXTS, RESERVED, format_category, format_tag
from quillframe.functions.quoting import normalise_newlines, repair_block_starts, unescape_block

_SPACE = "[ \\n\\t\\x0B]"
_TOKEN = f";(?=\\n)[\\s\\S]*?\\n;|;\\n|'[^\\n]*?'(?={_SPACE}|\\z)|\"[^\\n]*?\"(?={_SPACE}|\\z)|#[^\\n]*|[^ \\n\\t\\x0B]+"


@dataclass(frozen=True)
class StarTables:
    """The tables of some parsed files."""

    entries: DataFrame
    saveframes: DataFrame
    loops: DataFrame
    cells: DataFrame
    errors: DataFrame

    def checked(self, warnings: bool = False) -> StarTables:
        """The same tables, if no file breaks a rule; else a ``ParseError`` with the first error of the first file.

        With ``warnings``, loops without tags or without data are errors too. One row reaches the driver.
        """
        bad = self.errors if not warnings else self.errors.unionByName(self.warnings())
        found = bad.agg(F.min(F.struct("file", "line_no", "message")).alias("first")).first().first
        if found is not None:
            raise ParseError(found.message, found.line_no, found.file)
        return self

    def warnings(self) -> DataFrame:
        """(file, line_no, message): what is allowed but odd."""
        message = F.when(F.size("tags") == 0, "A loop has no tags.").when(F.col("n_rows") == 0, "A loop has no data.")
        return self.loops.select("file", "line_no", message.alias("message")).where("message is not null")


#: Characters of a segment, about; segments end with a line.
SEGMENT = 1 << 22
_RUNNING = (Window.unboundedPreceding, Window.currentRow)


def _lines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def repaired(text: Column) -> Column:
    """A text with plain newlines, whose blocks begin on lines of their own; null as empty."""
    return repair_block_starts(normalise_newlines(F.coalesce(text, F.lit(""))))


def cut_texts(texts: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(file, seg, last, text): texts of (file, text) in segments of at least ``size`` characters, except the last.

    A segment ends with a line, and before a line that does not begin with a semicolon, so no delimiter is cut.
    """
    pattern = F.lit(f"[\\s\\S]{{{size}}}[\\s\\S]*?\\n(?!;)|[\\s\\S]+")
    # a lambda's variable holds its value: a text is repaired and cut once, not once for each of its segments
    pieces = F.transform(F.array(repaired(F.col("text"))), lambda t: F.when(F.length(t) <= size, F.array(t)).otherwise(F.regexp_extract_all(t, pattern, F.lit(0))))
    numbered = F.flatten(F.transform(pieces, lambda ps: F.transform(ps, lambda p, i: F.struct(i.alias("seg"), (i == F.size(ps) - 1).alias("last"), p.alias("text")))))
    return texts.select("file", F.explode(numbered).alias("piece")).select("file", "piece.*")


def _all_tokens(text: Column, open_end: bool = False) -> Column:
    """The raw tokens of a text; with ``open_end``, a block that does not end reaches to the end of the text."""
    tail = "|;(?=\\n)[\\s\\S]*" if open_end else ""
    block, _, rest = _TOKEN.partition("|")
    return F.regexp_extract_all(text, F.lit(f"{_SPACE}*(?:{block}{tail}|{rest})"), F.lit(0))


def _left_open(text: Column) -> Column:
    """Whether a text that begins outside of blocks ends within one."""
    final = F.regexp_replace(F.try_element_at(_all_tokens(text, True), F.lit(-1)), f"^{_SPACE}+", "")
    return F.coalesce(final.startswith(";\n") & ~final.endswith("\n;"), F.lit(False))


def _after_block(text: Column) -> Column:
    """What follows the first end of a block; null without one."""
    at = F.instr(text, "\n;")
    return F.when(at > 0, F.substring(text, at + 2, F.length(text)))


def segment_states(segments: DataFrame) -> DataFrame:
    """(file, seg, inside, opens, opener, line_before) of (file, seg, last, text): how each segment begins and ends.

    ``inside``: it begins within a block; ``opens``: it ends within one that began in it; ``opener``: the segment where the block
    began that it begins in. A block that the file never ends is none: from there on segments begin outside.
    """
    alone = (F.col("seg") == 0) & F.col("last")
    rest = _after_block(F.col("text"))
    maps = segments.select(
        "file", "seg", "last", F.when(alone, 0).otherwise(_lines(F.col("text"))).alias("lines"), rest.isNotNull().alias("ends"),
        F.when(alone, False).otherwise(_left_open(F.col("text"))).cast("int").alias("a"), F.when(alone, False).otherwise(F.when(rest.isNull(), True).otherwise(_left_open(rest))).cast("int").alias("b"),
    )
    by_seg = Window.partitionBy("file").orderBy("seg")
    past = by_seg.rowsBetween(Window.unboundedPreceding, -1)
    # a map that ignores its beginning decides; the ones after it that swap the two states change its parity
    swaps = F.sum((F.col("a") > F.col("b")).cast("int")).over(by_seg)
    rows = maps.withColumn("swaps", swaps)
    fixed = F.last(F.when(F.col("a") == F.col("b"), F.struct("a", "swaps")), True).over(past)
    rows = rows.withColumn("fixed", fixed).withColumn("swapped", F.coalesce(F.lag("swaps").over(by_seg), F.lit(0)))
    rows = rows.withColumn("inside", (F.coalesce(F.col("fixed.a"), F.lit(0)) + F.col("swapped") - F.coalesce(F.col("fixed.swaps"), F.lit(0))) % 2 == 1)
    rows = rows.withColumn("exit", F.when(F.col("inside"), F.col("b")).otherwise(F.col("a")) == 1)
    rows = rows.withColumn("opens", F.col("exit") & (~F.col("inside") | F.col("ends")))
    whole = Window.partitionBy("file")
    unended = F.max(F.col("exit") & F.col("last")).over(whole)
    rows = rows.withColumn("never", F.when(unended, F.max(F.when(F.col("opens"), F.col("seg"))).over(whole)))
    beyond = F.coalesce(F.col("seg") > F.col("never"), F.lit(False))
    rows = rows.withColumn("inside", F.col("inside") & ~beyond).withColumn("opens", F.col("opens") & ~F.coalesce(F.col("seg") >= F.col("never"), F.lit(False)))
    opener = F.last(F.when(F.col("opens"), F.col("seg")), True).over(past)
    return rows.select("file", "seg", "inside", "opens", F.when(F.col("inside"), opener).alias("opener"), F.coalesce(F.sum("lines").over(past), F.lit(0)).alias("line_before"))


def _stitched(joined: DataFrame) -> DataFrame:
    """(file, seg, block): raw blocks that span segments, by the segment they begin in."""
    last = F.try_element_at(_all_tokens(F.when(F.col("inside"), _after_block(F.col("text"))).otherwise(F.col("text")), True), F.lit(-1))
    begun = joined.where("opens").select("file", F.col("seg").alias("at"), "seg", last.alias("part"))
    at = F.instr("text", "\n;")
    followed = joined.where("inside").select("file", F.col("opener").alias("at"), "seg", F.when(at > 0, F.substring(F.col("text"), F.lit(1), at + 1)).otherwise(F.col("text")).alias("part"))
    parts = begun.unionByName(followed).groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "part"))), lambda x: x["part"]), "").alias("block"))
    return parts.select("file", F.col("at").alias("seg"), "block")


def _explode_tokens(segments: DataFrame) -> DataFrame:
    """(file, seg, at, pos, line_no, token, delim): the tokens in order but comments, and a row for each file's end, whose delim is null.

    ``segments``: (file, seg, last, text), and what ``segment_states`` and ``_stitched`` add where files have several.
    """
    several = "inside" in segments.columns
    if several:
        body = F.when(F.col("inside"), F.coalesce(_after_block(F.col("text")), F.lit(""))).otherwise(F.col("text"))
        found = F.when(F.col("opens"), _all_tokens(body, True)).otherwise(_all_tokens(body))
        found = F.when(F.col("opens"), F.concat(F.slice(found, 1, F.size(found) - 1), F.array("block"))).otherwise(found)
        before = F.col("line_before") + F.when(F.col("inside"), _lines(F.col("text")) - _lines(body)).otherwise(0)
    else:
        found, before = _all_tokens(F.col("text")), F.lit(0)
    end = F.when(F.col("last"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    rows = segments.select("file", "seg", before.alias("before"), F.posexplode(F.concat(found, end)).alias("at", "whole"))
    raw = F.regexp_replace("whole", f"^{_SPACE}+", "")
    rows = rows.withColumn("raw", raw).withColumn("line_no", F.lit(1) + F.col("before") + F.sum(_lines(F.col("whole"))).over(Window.partitionBy("file", "seg").orderBy("at").rowsBetween(*_RUNNING)) - _lines(F.col("raw")))
    first, n = F.substring("raw", 1, 1), F.length("raw")
    block = F.col("raw").startswith(";\n") & F.col("raw").endswith("\n;") & (n > 2)
    quoted = first.isin("'", '"') & (n > 1) & (F.substring("raw", -1, 1) == first)
    value = F.when(block, unescape_block(F.substring(F.col("raw"), F.lit(3), n - 3))).when(quoted, F.substring(F.col("raw"), F.lit(2), n - 2)).otherwise(F.col("raw"))
    delim = F.when(n == 0, F.lit(None)).when(block, F.lit(";")).when(quoted, first).when(first == "#", F.lit("#")).when((first == "$") & (n > 1), F.lit("$")).otherwise(F.lit(" "))
    pos = F.shiftleft(F.col("seg").cast("long"), 32) + F.col("at")
    return rows.select("file", "seg", "at", pos.alias("pos"), F.col("line_no").cast("int").alias("line_no"), value.alias("token"), delim.alias("delim")).where("delim is null or delim <> '#'")


def _whole(texts: DataFrame) -> DataFrame:
    return texts.select("file", F.lit(0).alias("seg"), F.lit(True).alias("last"), repaired(F.col("text")).alias("text"))


def tokens(texts: DataFrame) -> DataFrame:
    """(file, pos, line_no, token, delim) of each token of (file, text) but comments.

    ``delim`` is a quote, ``;`` for text blocks, ``$`` for bare references and a space for bare words.
    """
    return _explode_tokens(_whole(texts)).where("delim is not null").select("file", "pos", "line_no", "token", "delim")


def tokens_of_segments(segments: DataFrame) -> DataFrame:
    """As ``tokens``, of texts in segments (file, seg, last, text)."""
    return _explode_tokens(_with_states(segments)).where("delim is not null").select("file", "pos", "line_no", "token", "delim")


def _with_states(segments: DataFrame) -> DataFrame:
    joined = segments.join(cut(segment_states(segments)), ["file", "seg"])
    return joined.join(_stitched(joined), ["file", "seg"], "left")


def _classified(found: DataFrame, segmented: bool = False) -> DataFrame:
    """Tokens with their kind, the numbers of their frame and loop, and their place in these.

    Everything is counted within segments first. What segments pass on is found from two small tables with a row a segment:
    the depth of loops and the last token, on which kinds rest, then counts and the last marks. The tokens are read for
    each of these once, however many counts there are.
    """
    here, by_seg = Window.partitionBy("file", "seg").orderBy("at"), Window.partitionBy("file").orderBy("seg")
    so_far, past = here.rowsBetween(*_RUNNING), by_seg.rowsBetween(Window.unboundedPreceding, -1)
    low, bare = F.lower("token"), F.coalesce(F.col("delim").isin(" ", "$"), F.lit(False))
    rows = found.withColumn("bare", bare).withColumn("is_loop", bare & (low == "loop_")).withColumn("is_stop", bare & (low == "stop_"))
    step, tag_like = F.col("is_loop").cast("int") - F.col("is_stop").cast("int"), F.col("bare") & F.col("token").startswith("_")
    depth, nth, before = F.sum(step).over(so_far), F.sum(F.lit(1)).over(so_far), F.lag(tag_like).over(here)
    if segmented:
        ends = rows.groupBy("file", "seg").agg(F.sum(step).alias("depth"), F.count("*").alias("n"), F.max(F.struct(F.col("at"), tag_like.alias("tag_like"))).alias("end"))
        entry = cut(ends.select("file", "seg", F.coalesce(F.sum("depth").over(past), F.lit(0)).alias("_depth"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_nth"), F.lag("end.tag_like").over(by_seg).alias("_before")))
        rows = rows.join(entry, ["file", "seg"])
        depth, nth, before = depth + F.col("_depth"), nth + F.col("_nth"), F.coalesce(before, "_before")
    rows = rows.withColumns({"depth": depth, "nth_token": nth, "after_tag": before}).drop("_depth", "_nth", "_before")
    # the token before had this one's depth less its own step
    rows = rows.withColumn("in_loop", F.col("depth") > 0).withColumn("after_tag", F.coalesce("after_tag", F.lit(False)) & (F.col("depth") - step <= 0))
    outside = F.col("bare") & ~F.col("in_loop") & ~F.col("after_tag")
    kind = (
        F.when(F.col("delim").isNull(), "end").when(F.col("is_loop"), "loop").when(F.col("is_stop"), "stop").when(outside & low.startswith("data_"), "data").when(outside & (low == "save_"), "close")
        .when(outside & low.startswith("save_"), "open").when(F.col("bare") & F.col("token").startswith("_") & ~F.col("after_tag"), "tag").otherwise("value")
    )
    rows = rows.withColumn("kind", kind)
    count = lambda *kinds: F.col("kind").isin(*kinds).cast("int")
    name = F.substring(F.col("token"), F.lit(6), F.length("token"))
    sums = {"sf_ord": count("open"), "closed": count("close"), "loop_no": count("loop"), "n_values": count("value") * F.col("in_loop").cast("int"), "n_tags": count("tag") * F.col("in_loop").cast("int"), "n_own": count("tag") * (~F.col("in_loop")).cast("int"), "n_data": count("data")}
    opens, loops = F.col("kind") == "open", F.col("kind") == "loop"
    following = F.struct(F.col("token").alias("token"), F.col("delim").alias("delim"), F.col("kind").alias("kind"))
    rows = rows.withColumns({k: F.sum(c).over(so_far) for k, c in sums.items()} | {"sf_name": F.last(F.when(opens, name), True).over(so_far), "next": F.lead(following).over(here)})
    # counts at the last saveframe's or loop's beginning
    marks = {"_loops": ("loop_no", opens), "_own": ("n_own", opens), "_values": ("n_values", loops), "_tags": ("n_tags", loops)}
    first_data = F.when((F.col("kind") == "data") & (F.col("n_data") == 1), name)
    rows = rows.withColumns({m: F.last(F.when(at, F.col(n)), True).over(so_far) for m, (n, at) in marks.items()} | {"entry_id": F.last(first_data, True).over(so_far)})
    if segmented:
        names = [*sums, *marks, "sf_name", "entry_id"]
        ends = rows.groupBy("file", "seg").agg(F.max(F.struct("at", *names)).alias("end"), F.min(F.struct(F.col("at"), following.alias("token"))).alias("begin"))
        ends = ends.withColumns({f"b_{k}": F.coalesce(F.sum(f"end.{k}").over(past), F.lit(0)) for k in sums})
        last = {m: F.col(f"end.{m}") + F.col(f"b_{n}") for m, (n, _) in marks.items()} | {"sf_name": F.col("end.sf_name"), "entry_id": F.when(F.col("b_n_data") == 0, F.col("end.entry_id"))}
        ends = ends.withColumns({f"b_{k}": F.last(c, True).over(past) for k, c in last.items()} | {"b_next": F.lead("begin.token").over(by_seg)})
        rows = rows.join(cut(ends.select("file", "seg", *[f"b_{k}" for k in names], "b_next")), ["file", "seg"])
        whole = {m: F.coalesce(F.col(m) + F.col(f"b_{n}"), f"b_{m}") for m, (n, _) in marks.items()} | {"entry_id": F.coalesce(F.when(F.col("b_n_data") == 0, F.col("entry_id")), "b_entry_id")}
        whole |= {k: F.col(k) + F.col(f"b_{k}") for k in sums} | {k: F.coalesce(k, f"b_{k}") for k in ("sf_name", "next")}
        rows = rows.withColumns(whole).drop(*[f"b_{k}" for k in names], "b_next")
    since = lambda n, mark: F.col(n) - F.coalesce(mark, F.lit(0))
    rows = rows.withColumns({"loop_ord": since("loop_no", "_loops"), "nth_own": since("n_own", "_own"), "loop_values": since("n_values", "_values"), "loop_tags": since("n_tags", "_tags")}).drop(*marks, "n_values", "n_tags", "n_own", "n_data")
    return rows.select("*", F.col("next.token").alias("next_token"), F.col("next.delim").alias("next_delim"), F.col("next.kind").alias("next_kind")).drop("next")


def parse(texts: DataFrame) -> StarTables:
    """Tables of the files (file, text). Errors are rows of ``errors``; well-formed parts are read all the same.

    The tokens are checkpointed at once: building these tables runs a job.
    """
    # one pass over the texts: all tables below are read from its result
    return _tables(cut(_classified(_explode_tokens(_whole(texts)))), False)


def parse_segments(segments: DataFrame) -> StarTables:
    """As ``parse``, of texts in segments (file, seg, last, text), so that no task holds a large file's tokens."""
    # written once: a source is read and cut once. The number is given, as small parts of text are much work and must not be put together
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = cut(segments.select("file", "seg", "last", "text").repartition(parts, "file", "seg"))
    return _tables(cut(_classified(cut(_explode_tokens(_with_states(segments))), True)), True)


def _own_category(token: Column) -> Column:
    """The category that a tag names itself; null without one."""
    return F.when(F.contains(token, F.lit(".")), format_category(token))


def _short(token: Column) -> Column:
    return F.when(F.contains(token, F.lit(".")), format_tag(token)).otherwise(F.ltrim(token, F.lit("_")))


def _with_heads(values: DataFrame, heads: DataFrame, segmented: bool) -> DataFrame:
    """A loop's values beside its tags; in segments, so that a loop of many values is not one key."""
    if not segmented:
        return values.join(heads, ["file", "loop_no"])
    held = values.select("file", "loop_no", "seg").distinct().join(heads, ["file", "loop_no"])
    return values.join(held, ["file", "loop_no", "seg"])


def _tables(rows: DataFrame, segmented: bool) -> StarTables:
    place = ["file", "entry_id", "sf_ord", "sf_name"]
    gathered = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "tag", F.struct("pos", "token")))), lambda x: x["token"])
    heads = rows.where("in_loop and kind in ('loop', 'tag')").groupBy(*place, "loop_no", "loop_ord").agg(F.min("line_no").alias("line_no"), gathered.alias("tags"))
    known = heads.select("file", "loop_no", "tags").where(F.size("tags") > 0)
    values = _with_heads(rows.where("in_loop and kind = 'value'"), known, segmented).withColumn("nth", F.col("loop_values") - 1)
    n = F.size("tags")
    name = F.element_at("tags", (F.col("nth") % n + 1).cast("int"))
    loop_cells = values.select(*place, F.lit("loop").alias("kind"), "loop_ord", format_category(name).alias("category"), F.floor(F.col("nth") / n).cast("long").alias("row_ord"), (F.col("nth") % n).cast("int").alias("col_ord"), format_tag(name).alias("tag"), F.col("token").alias("value"), "delim", "line_no")
    tags = rows.where("kind = 'tag' and not in_loop and sf_ord > 0")
    own = tags.select(
        *place, F.lit("tag").alias("kind"), F.lit(0).cast("long").alias("loop_ord"), _own_category(F.col("token")).alias("category"), F.lit(0).cast("long").alias("row_ord"),
        (F.col("nth_own") - 1).cast("int").alias("col_ord"), _short(F.col("token")).alias("tag"), F.col("next_token").alias("value"), F.col("next_delim").alias("delim"), "line_no",
    )
    told = own.groupBy("file", "sf_ord").agg(F.max(F.when(F.lower("tag") == "sf_category", F.col("value"))).alias("sf_category"), F.min_by("category", F.when(F.col("category").isNotNull(), F.col("col_ord"))).alias("tag_prefix"))
    frames = rows.where("kind = 'open'").select(*place, "line_no").join(told, ["file", "sf_ord"], "left")
    sizes = values.groupBy("file", "loop_no").agg(F.max(F.floor(F.col("nth") / n) + 1).alias("n_rows"), F.max("line_no").alias("end_line"), (F.count("*") % F.first(n)).alias("over"))
    loops = heads.join(sizes, ["file", "loop_no"], "left")
    entries = rows.groupBy("file").agg(F.max("entry_id").alias("entry_id"), F.max("sf_ord").alias("n_frames"))
    cells = own.unionByName(loop_cells).join(told, ["file", "sf_ord"], "left").withColumn("category", F.coalesce("category", "tag_prefix")).drop("tag_prefix")
    shown = loops.select(*place, "loop_ord", format_category(F.col("tags")[0]).alias("category"), F.transform("tags", format_tag).alias("tags"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "line_no")
    return StarTables(entries, frames, shown, cells, _errors(rows, loops))


def _errors(rows: DataFrame, loops: DataFrame) -> DataFrame:
    """(file, line_no, message): every rule of the format that a token, a loop's size or a saveframe's names break."""
    low, bare, loop, short = F.lower("token"), F.col("bare"), F.col("in_loop"), _short(F.col("token"))
    tag, value, own = F.col("kind") == "tag", F.col("kind") == "value", (F.col("kind") == "tag") & ~F.col("in_loop")
    begins = F.substring("token", 1, 1)
    message = (
        F.when(bare & begins.isin("'", '"'), "A quoted value was never ended before its line was.")
        .when(bare & (F.col("token") == ";\n"), "A text block was never ended.")
        .when((F.col("nth_token") == 1) & ((F.col("kind") != "data") | (F.length("token") < 6)), "The file does not begin with 'data_' and a name.")
        .when((F.col("kind") == "data") & (F.col("nth_token") > 1), "'data_' may only begin a file.")
        .when((F.col("kind") == "open") & (F.col("sf_ord") - F.col("closed") > 1), "A saveframe begins before the last one ended.")
        .when((F.col("kind") == "close") & (F.col("closed") > F.col("sf_ord")), "'save_' ends no saveframe.")
        .when((F.col("sf_ord") == F.col("closed")) & (F.col("nth_token") > 1) & ~F.col("kind").isin("open", "close", "data", "end"), "Only 'save_' and a name may stand outside of saveframes.")
        .when((F.col("kind") == "loop") & (F.col("depth") > 1), "A loop begins before the last one ended.")
        .when((F.col("kind") == "stop") & (F.col("depth") < 0), "'stop_' ends no loop.")
        .when(loop & tag & (F.col("loop_values") > 0), "A tag follows the data of its loop.")
        .when(loop & value & (F.col("loop_tags") == 0), "A loop has data before any tag.")
        .when(value & bare & low.isin(*RESERVED), "A reserved word must be quoted to be a value.")
        .when(loop & value & ~bare & (low == "stop_"), "'stop_' may not be quoted within a loop.")
        .when(value & F.col("after_tag") & bare & F.col("token").startswith("_"), "A value that begins with an underscore must be quoted.")
        .when(own & (F.col("next_kind").isNull() | F.col("next_kind").isin("loop", "stop", "end")), "A tag has no value.")
        .when(value & ~loop & ~F.col("after_tag"), "A value has no tag.")
        .when(tag & short.isin(*NULL_TEXTS), "A tag has no name.")
        .when(tag & F.contains(short, F.lit(".")), "A tag has more than one '.' in its name.")
        .when(tag & loop & ~F.contains("token", F.lit(".")), "A tag of a loop names no category.")
        .when(own & (F.lower(short) == "sf_framecode") & (F.col("next_token") != F.col("sf_name")), "Sf_framecode is not the saveframe's name.")
        .when((F.col("kind") == "end") & (loop | (F.col("closed") < F.col("sf_ord"))), "The file ends within a saveframe or loop.")
    )
    by_token = rows.select("file", "line_no", message.alias("message")).where("message is not null")
    ragged = loops.where("over <> 0").select("file", F.col("end_line").alias("line_no"), F.lit("The number of values is not a multiple of the number of tags.").alias("message"))
    # a saveframe (negative) or loop and its tags
    named = rows.where("kind = 'tag'").select("file", F.when(loop, F.col("loop_no")).otherwise(-F.col("sf_ord")).alias("at"), F.lower(short).alias("tag"), _own_category(F.col("token")).alias("category"), "line_no")
    per_tag = named.groupBy("file", "at", "tag").agg(F.max("line_no").alias("line_no"), F.count("*").alias("n"), F.collect_set("category").alias("categories"))
    twice = F.max(F.when(F.col("n") > 1, F.col("line_no")))
    spelled = F.array_distinct(F.flatten(F.collect_list("categories")))
    groups = per_tag.groupBy("file", "at").agg(F.max("line_no").alias("line_no"), twice.alias("twice"), spelled.alias("spelled")).withColumn("lowered", F.array_distinct(F.transform("spelled", F.lower)))
    found = F.array_compact(F.array(
        F.when(F.col("twice").isNotNull(), F.struct(F.col("twice").alias("line_no"), F.lit("A tag occurs twice.").alias("message"))),
        F.when(F.size("lowered") > 1, F.struct("line_no", F.lit("Tags of one saveframe or loop have different categories.").alias("message"))),
        F.when((F.size("lowered") == 1) & (F.size("spelled") > 1) & (F.col("at") < 0), F.struct("line_no", F.lit("Tags of one saveframe spell its category differently.").alias("message"))),
    ))
    of_tags = groups.select("file", F.explode(found).alias("e")).select("file", "e.*")
    opens = rows.where("kind = 'open'").select("file", "sf_ord", "sf_name", "line_no")
    names = opens.groupBy("file", "sf_name").agg(F.max("line_no").alias("line_no"), F.count("*").alias("n")).where("n > 1").select("file", "line_no", F.lit("Two saveframes have one name.").alias("message"))
    told = groups.where((F.col("at") < 0) & (F.size("lowered") > 0)).select("file", (-F.col("at")).alias("sf_ord"))
    untold = opens.join(told, ["file", "sf_ord"], "left_anti").select("file", "line_no", F.lit("A saveframe has no tag that names its category.").alias("message"))
    again = loops.where(F.size("tags") > 0).groupBy("file", "sf_ord", F.lower(format_category(F.col("tags")[0]))).agg(F.max("line_no").alias("line_no"), F.count("*").alias("n")).where("n > 1").select("file", "line_no", F.lit("Two loops of one saveframe have one category.").alias("message"))
    return by_token.unionByName(ragged).unionByName(of_tags).unionByName(names).unionByName(untold).unionByName(again)


def read_files(spark: SparkSession, path: str) -> StarTables:
    """The files under a path, compressed ones by their extension, each a whole."""
    return parse(spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def from_strings(texts: DataFrame, id_col: str, text_col: str) -> StarTables:
    """Files held in a column."""
    return parse(texts.select(F.col(id_col).cast("string").alias("file"), F.col(text_col).alias("text")))


def one_frame(texts: DataFrame, id_col: str, text_col: str) -> StarTables:
    """Texts of one saveframe each, as tables; a text of several is an error."""
    read = parse(texts.select(F.col(id_col).cast("string").alias("file"), wrap_frame(F.col(text_col)).alias("text")))
    many = read.saveframes.groupBy("file").agg(F.max("line_no").alias("line_no"), F.count("*").alias("n")).where("n > 1")
    return replace(read, errors=read.errors.unionByName(many.select("file", "line_no", F.lit("There is more than one saveframe.").alias("message"))))


def one_loop(texts: DataFrame, id_col: str, text_col: str) -> StarTables:
    """Texts of one loop each, as tables; a text of several is an error. The frame around the loop has a tag of its own."""
    read = parse(texts.select(F.col(id_col).cast("string").alias("file"), wrap_loop(F.col(text_col)).alias("text")))
    many = read.loops.groupBy("file").agg(F.max("line_no").alias("line_no"), F.count("*").alias("n")).where("n > 1")
    return replace(read, errors=read.errors.unionByName(many.select("file", "line_no", F.lit("There is more than one loop.").alias("message"))))


def empty_tables(spark: SparkSession, entry_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, cells, loops) of an entry without saveframes; the schemas are those of ``parse`` without places in files."""
    place = "entry_id string, sf_ord long, sf_name string"
    frames = spark.createDataFrame([], f"{place}, sf_category string, tag_prefix string")
    cells = spark.createDataFrame([], f"{place}, sf_category string, kind string, loop_ord long, category string, row_ord long, col_ord int, tag string, value string")
    loops = spark.createDataFrame([], f"{place}, loop_ord long, category string, tags array<string>, n_rows long")
    return frames, cells, loops


def wrap_frame(text: Column) -> Column:
    """A single saveframe as a file."""
    return F.concat(F.lit("data_1\n"), text)


def wrap_loop(text: Column) -> Column:
    """A single loop as a file."""
    return F.concat(F.lit("data_1\nsave_1\n_Wrapped.Loop .\n"), text, F.lit("\nsave_\n"))


LOOP_JSON = "struct<category:string,tags:array<string>,data:array<array<string>>>"
FRAME_JSON = f"struct<name:string,category:string,tag_prefix:string,tags:array<array<string>>,loops:array<{LOOP_JSON}>>"


def _with_keys(read: DataFrame, what: str, keys: tuple[str, ...]) -> DataFrame:
    missing = F.coalesce(*[F.when(F.col(f"e.{k}").isNull(), F.lit(k)) for k in keys])
    return read.where(F.when(missing.isNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"a {what} needs "), missing)).cast("boolean")))


def frames_from_json(texts: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The cells of single saveframes in JSON, each an entry of its own; missing keys are errors."""
    read = texts.select(F.col(id_col).cast("string").alias("entry_id"), F.from_json(json_col, FRAME_JSON).alias("e"))
    whole = _with_keys(read, "saveframe", ("name", "tag_prefix", "tags", "loops"))
    packed = whole.select(F.to_json(F.struct("entry_id", F.array("e").alias("saveframes")), {"ignoreNullFields": "false"}).alias("value"))
    return from_json(packed)


def loops_from_json(texts: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, category, row_ord, col_ord, tag, value) of single loops in JSON; missing keys are errors."""
    read = texts.select(F.col(id_col).alias("id"), F.from_json(json_col, LOOP_JSON).alias("e"))
    rows = _with_keys(read, "loop", ("tags", "category", "data")).select("id", "e.category", "e.tags", F.posexplode("e.data").alias("row_ord", "row"))
    wrong = F.size("row") != F.size("tags")
    pairs = F.when(wrong, F.raise_error(F.lit("a row has not as many values as its loop has tags")).cast("array<struct<tags:string,row:string>>")).otherwise(F.arrays_zip("tags", "row"))
    cells = rows.select("id", "category", F.col("row_ord").cast("long").alias("row_ord"), F.posexplode(pairs).alias("col_ord", "pair"))
    return cells.select("id", "category", "row_ord", "col_ord", F.col("pair.tags").alias("tag"), F.col("pair.row").alias("value"))


#: Shape of an entry in JSON.
ENTRY_JSON = "struct<{ids},saveframes:array<struct<name:string,category:string,tag_prefix:string,tags:array<array<string>>,loops:array<struct<category:string,tags:array<string>,data:array<array<string>>>>>>>"


def from_json(texts: DataFrame, json_col: str = "value", id_keys: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """The cells of entries in JSON; the first of ``id_keys`` that an entry has names it. Missing keys are errors."""
    read = texts.select(F.from_json(json_col, ENTRY_JSON.format(ids=",".join(f"{k}:string" for k in id_keys))).alias("e"))
    entry_id = F.coalesce(*[f"e.{k}" for k in id_keys])
    whole = F.when(entry_id.isNull() | F.col("e.saveframes").isNull(), F.raise_error(F.lit("an entry needs entry_id and saveframes")).cast("boolean")).otherwise(True)
    frames = read.where(whole).select(entry_id.alias("entry_id"), F.posexplode("e.saveframes").alias("f", "frame"))
    frames = frames.select("entry_id", (F.col("f") + 1).cast("long").alias("sf_ord"), "frame")
    head = ["entry_id", "sf_ord", F.col("frame.name").alias("sf_name"), F.col("frame.category").alias("sf_category")]
    tags = frames.select(*head, F.col("frame.tag_prefix").alias("category"), F.posexplode("frame.tags").alias("col_ord", "pair"))
    tags = tags.select("entry_id", "sf_ord", "sf_name", "sf_category", F.lit("tag").alias("kind"), F.lit(0).cast("long").alias("loop_ord"), "category", F.lit(0).cast("long").alias("row_ord"), "col_ord", F.col("pair")[0].alias("tag"), F.col("pair")[1].alias("value"))
    loops = frames.select(*head, F.posexplode("frame.loops").alias("l", "loop")).select("*", F.posexplode("loop.data").alias("r", "row")).select("*", F.posexplode(F.arrays_zip("loop.tags", "row")).alias("col_ord", "pair"))
    loops = loops.select("entry_id", "sf_ord", "sf_name", "sf_category", F.lit("loop").alias("kind"), (F.col("l") + 1).cast("long").alias("loop_ord"), F.col("loop.category").alias("category"), F.col("r").cast("long").alias("row_ord"), "col_ord", F.col("pair")["tags"].alias("tag"), F.col("pair")["row"].alias("value"))
    return tags.unionByName(loops)

