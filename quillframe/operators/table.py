"""A loop as a table: an ordered DataFrame with a category, and the operations on its tags and rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.errors import InvalidStateError
from quillframe.functions.lineage import cut
from quillframe.functions.names import NULL_TEXTS, is_null
from quillframe.functions.values import is_integer_text, is_number_text, typed

ROW = "_row"


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = ROW, start: int = 0) -> DataFrame:
    """Number all rows in a total order, without bringing them to one task.

    Rows are dealt by ranges and sorted there; a row's number is its place in its range plus the sizes of
    the ranges before. Only one row a range goes through the small window. The dealt rows are checkpointed, at once:
    ranges rest on a sample, and two runs may draw different ones.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part).count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    joined = dealt.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + place + start).drop("_at", "_part", "_before")


@dataclass(frozen=True)
class Loop:
    """Rows of one category; ``df`` has a column for each tag and the ordinal ``_row``."""

    df: DataFrame
    category: str
    tags: tuple[str, ...]

    @classmethod
    def of(cls, rows: DataFrame, category: str, order: Sequence[Column | str]) -> Loop:
        """A loop of some rows, ordered by a total order."""
        return cls(numbered(rows, order), category if category.startswith("_") else f"_{category}", tuple(rows.columns))

    def resolve(self, name: str) -> str:
        """The loop's own spelling of a tag; qualified names must be of this category."""
        category, dot, short = name.rpartition(".")
        if dot and category.lower().removeprefix("_") != self.category.lower().removeprefix("_"):
            raise ValueError(f"{name} is no tag of {self.category}")
        for tag in self.tags:
            if tag.lower() == short.lower():
                return tag
        raise KeyError(name)

    def tag_index(self, name: str) -> int | None:
        """A tag's position, or None; of repeated tags the last."""
        lower = [t.lower() for t in self.tags]
        short = name.rpartition(".")[2].lower()
        return len(lower) - 1 - lower[::-1].index(short) if short in lower else None

    # projection

    def filter(self, names: Iterable[str], ignore_missing: bool = False) -> Loop:
        """The named tags, in that order."""
        found: list[str] = []
        for name in names:
            try:
                tag = self.resolve(name)
            except KeyError:
                if ignore_missing:
                    continue
                raise
            if tag in found:
                raise ValueError(f"{name} is named twice")
            found.append(tag)
        return replace(self, df=self.df.select(ROW, *found), tags=tuple(found))

    def tag_names(self) -> list[str]:
        """The full names of the tags, in order."""
        return [f"{self.category}.{t}" for t in self.tags]

    def get_tag(self, *names: str, whole_tag: bool = False, dict_result: bool = False) -> DataFrame:
        """Values of the named tags (all: none named) with their row; ``whole_tag`` puts each beside its full name.

        With ``dict_result`` each row is one map of text from names, as the caller spells them or in full, to values.
        """
        if dict_result:
            spelled = {n: self.resolve(n) for n in names} or {t: t for t in self.tags}
            keys = [f"{self.category}.{t}" if whole_tag else n for n, t in spelled.items()]
            return self.df.select(ROW, F.create_map(*[x for k, t in zip(keys, spelled.values(), strict=True) for x in (F.lit(k), F.col(t).cast("string"))]).alias("values"))
        found = [self.resolve(n) for n in names] or list(self.tags)
        if not whole_tag:
            return self.df.select(ROW, *found)
        return self.df.select(ROW, *[F.struct(F.lit(f"{self.category}.{t}").alias("tag"), F.col(t).alias("value")).alias(t) for t in found])

    # rows

    def remove_rows(self, name: str, value: object) -> tuple[Loop, DataFrame]:
        """The loop without the rows that have a value, and those rows. Null equals null only."""
        same = F.col(self.resolve(name)).eqNullSafe(F.lit(value))
        return replace(self, df=self.df.where(~same)), self.df.where(same)

    def renumber(self, name: str, start: int = 1, maintain_ordering: bool = False) -> Loop:
        """Number a tag by position from ``start``; with ``maintain_ordering`` shift its values so that the first is ``start``."""
        tag = self.resolve(name)
        if not maintain_ordering:
            return replace(self, df=numbered(self.df, [ROW], "_number", start).withColumn(tag, F.col("_number").cast(self.df.schema[tag].dataType)).drop("_number"))
        bad = F.max((~is_integer_text(F.coalesce(F.col(tag).cast("string"), F.lit("")))).cast("int"))
        first, wrong = self.df.agg(F.min_by(F.col(tag).try_cast("long"), ROW)).scalar(), self.df.agg(bad).scalar()
        moved = F.when(wrong == 1, F.raise_error(F.lit("a value is no integer")).cast("long")).otherwise(F.col(tag).cast("long") + (start - first))
        return replace(self, df=self.df.withColumn(tag, moved.cast(self.df.schema[tag].dataType)))

    def sort(self, *names: str) -> Loop:
        """Sort stably by tags, the last being the most significant; a tag sorts as numbers where all its values are."""
        tags = [self.resolve(n) for n in reversed(names)]
        texts = {t: F.col(t).cast("string") for t in tags}
        keyed = self.df
        for t in tags:
            keyed = keyed.withColumn(f"_n_{t}", self.df.agg(F.min(F.coalesce(is_number_text(texts[t]), F.lit(False)).cast("int"))).scalar())
        order = [c for t in tags for c in (F.when(F.col(f"_n_{t}") == 1, texts[t].try_cast("double")), texts[t])]
        return replace(self, df=numbered(keyed.withColumnRenamed(ROW, "_was"), [*order, "_was"]).drop("_was", *[f"_n_{t}" for t in tags]))

    def sort_by(self, *keys: Column) -> Loop:
        """Sort stably by expressions over the whole row."""
        return replace(self, df=numbered(self.df.withColumnRenamed(ROW, "_was"), [*keys, "_was"]).drop("_was"))

    def slice(self, start: int, end: int) -> DataFrame:
        """The rows at positions ``start`` to ``end`` (exclusive)."""
        return self.df.where((F.col(ROW) >= start) & (F.col(ROW) < end))

    def append(self, rows: DataFrame) -> Loop:
        """Add rows of known tags, which have an ordinal of their own; missing tags are null, unknown ones an error."""
        spelled = {c: self.resolve(c) for c in rows.columns if c != ROW}
        top = self.df.agg(F.coalesce(F.max(ROW), F.lit(-1)) + 1).scalar()
        added = rows.select((F.col(ROW) + top).alias(ROW), *[F.col(c).alias(t) for c, t in spelled.items()])
        return replace(self, df=self.df.unionByName(added, allowMissingColumns=True))

    def append_positional(self, rows: DataFrame) -> Loop:
        """Add rows whose columns, but the ordinal, are the loop's tags in order; the width must be the same."""
        columns = [c for c in rows.columns if c != ROW]
        if len(columns) != len(self.tags):
            raise ValueError(f"{len(columns)} values for {len(self.tags)} tags")
        return self.append(rows.select(ROW, *[F.col(c).alias(t) for c, t in zip(columns, self.tags, strict=True)]))

    def add_by_tag(self, pairs: Sequence[tuple[str, object]]) -> Loop:
        """Add values one by one as (tag, value); they must come in the order of the tags, and fill whole rows."""
        for i, (tag, _) in enumerate(pairs):
            if self.resolve(tag) != self.tags[i % len(self.tags)]:
                raise ValueError(f"{tag} is not the next tag")
        return self.add_flat([v for _, v in pairs])

    def set_category(self, category: str) -> Loop:
        """The loop under another category."""
        name = category.partition(".")[0]
        return replace(self, category=name if name.startswith("_") else f"_{name}")

    def converted(self, dictionary: DataFrame, strict: bool = False) -> Loop:
        """The loop with columns of the dictionary's types: integers (exact to 38 digits), doubles, dates, else text.

        Null-equivalents are null. Other values that do not convert are null, or an error with ``strict``; unknown tags stay.
        """
        wanted = [f"{self.category}.{t}".lower() for t in self.tags]
        types = {r.tag_lc: r.data_type for r in dictionary.where(F.col("tag_lc").isin(wanted)).select("tag_lc", "data_type").collect()}
        columns = [typed(F.col(t).cast("string"), types.get(w), strict).alias(t) if w in types else F.col(t) for t, w in zip(self.tags, wanted, strict=True)]
        return replace(self, df=self.df.select(ROW, *columns))

    def add_dicts(self, rows: Sequence[Mapping[str, object]]) -> Loop:
        """Add a few literal rows by tag."""
        names = list(dict.fromkeys(k for r in rows for k in r))
        types = {n: self.df.schema[self.resolve(n)].dataType.simpleString() for n in names}
        made = [(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)]
        return self.append(self.df.sparkSession.createDataFrame(made, ", ".join([f"{ROW} long", *[f"`{n}` {types[n]}" for n in names]])))

    def add_columns(self, columns: Mapping[str, Sequence[object]]) -> Loop:
        """Add rows given by column; short columns are filled with null."""
        most = max(map(len, columns.values()), default=0)
        return self.add_dicts([{k: v[i] if i < len(v) else None for k, v in columns.items()} for i in range(most)])

    def add_flat(self, values: Sequence[object]) -> Loop:
        """Add rows from a flat list, row by row."""
        if len(values) % len(self.tags):
            raise ValueError("the number of values is not a multiple of the number of tags")
        return self.add_dicts([dict(zip(self.tags, values[i : i + len(self.tags)], strict=True)) for i in range(0, len(values), len(self.tags))])

    def clear(self) -> Loop:
        """The loop without rows."""
        return replace(self, df=self.df.limit(0))

    # tags

    def add_tag(self, name: str, value: Column | None = None) -> Loop:
        """Add a tag, null or computed; a name may be qualified by this category, and hold no white space and no second dot."""
        category, dot, short = name.strip().partition(".")
        short = short if dot else category
        if dot and category and category.lower().removeprefix("_") != self.category.lower().removeprefix("_"):
            raise ValueError(f"{name} is no tag of {self.category}")
        if short in NULL_TEXTS or "." in short or any(c.isspace() for c in short):
            raise ValueError(f"{name!r} is no name for a tag")
        if short.lower() in (t.lower() for t in self.tags):
            raise ValueError(f"there is a tag {short} already")
        return replace(self, df=self.df.withColumn(short, F.lit(None).cast("string") if value is None else value), tags=(*self.tags, short))

    def remove_tags(self, *names: str) -> Loop:
        """Drop tags, all of which must exist."""
        gone = {self.resolve(n) for n in names}
        return replace(self, df=self.df.drop(*gone), tags=tuple(t for t in self.tags if t not in gone))

    def set_tag(self, name: str, values: DataFrame) -> Loop:
        """Replace a tag's values by those of (_row, value)."""
        tag = self.resolve(name)
        # one value a row, no more and no fewer
        held = self.df.select(ROW, F.lit(1).alias("_n")).unionByName(values.select(ROW, F.lit(-1).alias("_n"))).groupBy(ROW).agg(F.sum("_n").alias("_n"))
        if held.where("_n <> 0").limit(1).count():
            raise InvalidStateError("there must be a value for each row")
        return replace(self, df=self.df.drop(tag).join(values.select(ROW, F.col("value").alias(tag)), ROW, "left").select(ROW, *self.tags))

    def order_tags(self, order: Sequence[str]) -> Loop:
        """Order tags by a dictionary's order; unknown tags follow, by name."""
        place = {t.lower(): i for i, t in enumerate(order)}
        tags = tuple(sorted(self.tags, key=lambda t: (place.get(t.lower(), len(place)), t)))
        return replace(self, df=self.df.select(ROW, *tags), tags=tags)

    def add_missing_tags_and_order(self, order: Sequence[str]) -> Loop:
        """As ``add_missing_tags``; then rows are sorted by their ``Ordinal``, or numbered by position where one is missing."""
        made = self.add_missing_tags(order)
        if "ordinal" not in (t.lower() for t in made.tags):
            return made
        tag = made.resolve("Ordinal")
        missing = made.df.agg(F.count_if(F.col(tag).isNull())).first()[0]
        return made.renumber(tag) if missing else made.sort(tag)

    def add_missing_tags(self, order: Sequence[str]) -> Loop:
        """Add a dictionary's tags that the loop lacks, as nulls, and order all."""
        have = {t.lower() for t in self.tags}
        made = self
        for tag in order:
            if tag.lower() not in have:
                made = made.add_tag(tag)
        return made.order_tags(order)

    # aggregates

    def non_empty_tags(self) -> DataFrame:
        """One row with, for each tag, whether any value is not null-equivalent."""
        return self.df.agg(*[F.coalesce(F.bool_or(~is_null(F.col(t).cast("string"))), F.lit(False)).alias(t) for t in self.tags])

    def widths(self) -> DataFrame:
        """One row with the width of each tag's column in text."""
        return self.df.agg(*[F.greatest(F.lit(4), F.coalesce(F.max(F.length(F.col(t).cast("string")) + 3), F.lit(4))).cast("long").alias(t) for t in self.tags])

    def as_cells(self) -> DataFrame:
        """The loop in long form: row_ord, col_ord, tag, value."""
        pairs = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for i, t in enumerate(self.tags)])
        return self.df.select(F.col(ROW).alias("row_ord"), F.explode(pairs).alias("cell")).select("row_ord", "cell.*")


def wide(cells: DataFrame, tags: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Cells of one category as a table with a column for each of the given tags (any case)."""
    picked = [F.max(F.when(F.lower("tag") == t.lower(), F.col("value"))).alias(t) for t in tags]
    return cells.groupBy(*keys, "row_ord").agg(*picked).withColumnRenamed("row_ord", ROW)
