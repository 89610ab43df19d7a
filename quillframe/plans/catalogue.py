"""The query catalogue: each operator over whole test tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions import names, quoting, values
from quillframe.functions.lineage import scratch_folder
from quillframe.operators import compare, dictionary, entries, listing
from quillframe.operators import frames as upkeep
from quillframe.operators.table import ROW, Loop, numbered, wide
from quillframe.plans import normalize, validate
from quillframe.sources import datasource, star, writer
from quillframe.sources import tables as csv_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns as text."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def frames_of(df: DataFrame, key: str, category: str, *tags: str) -> tuple[DataFrame, DataFrame]:
    """(frames, cells): each row of a table as a saveframe of one entry, its columns as tags."""
    rows = df.withColumn("sf_ord", F.col(key).cast("long")).withColumn("sf_name", F.concat(F.lit(f"{category}_"), F.col(key).cast("string")))
    frames = rows.select(F.lit("e").alias("entry_id"), "sf_ord", "sf_name", F.lit(category).alias("sf_category"), F.lit(f"_{category}").alias("tag_prefix"))
    pairs = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for i, t in enumerate(tags)])
    cells = rows.select(F.lit("e").alias("entry_id"), "sf_ord", "sf_name", F.lit(category).alias("sf_category"), F.lit("tag").alias("kind"), F.lit(0).cast("long").alias("loop_ord"), F.lit(f"_{category}").alias("category"), F.lit(0).cast("long").alias("row_ord"), F.explode(pairs).alias("cell"))
    return frames, cells.select("*", "cell.*").drop("cell")


def fixture(spark: SparkSession) -> DataFrame:
    """A small dictionary over the test tables; its attributes are invented."""
    rows = [
        {"tag": "_orders.o_orderkey", "sf_category": "orders", "data_type": "INTEGER", "star_type": "int", "nullable": False, "local_id_flag": True},
        {"tag": "_orders.o_custkey", "sf_category": "orders", "data_type": "INTEGER", "star_type": "int", "fk_table": "customer", "fk_column": "c_custkey"},
        {"tag": "_orders.o_orderstatus", "sf_category": "orders", "data_type": "CHAR(1)", "star_type": "yes_no", "entry_id_flag": True},
        {"tag": "_orders.o_orderpriority", "sf_category": "orders", "data_type": "VARCHAR(8)", "star_type": "any", "default_value": "5-LOW"},
        {"tag": "_part.p_type", "sf_category": "part", "is_loop": True, "data_type": "VARCHAR(255)", "star_type": "any"},
        {"tag": "_part.p_partkey", "sf_category": "part", "is_loop": True, "data_type": "INTEGER", "star_type": "int", "nullable": False},
        {"tag": "_part.p_comment", "sf_category": "part", "is_loop": True, "data_type": "TEXT", "star_type": "any"},
        {"tag": "_part.p_internal", "sf_category": "part", "is_loop": True, "public": "I"},
        {"tag": "_part.P_Name", "sf_category": "part", "is_loop": True, "data_type": "VARCHAR(255)", "star_type": "any"},
        {"tag": "_part.p_brand", "sf_category": "brands", "is_loop": True, "data_type": "VARCHAR(255)", "star_type": "any"},
        {"tag": "_part.p_size", "sf_category": "part", "is_loop": True, "data_type": "INTEGER", "star_type": "small"},
    ]
    return dictionary.from_rows(spark, rows, {"int": "(?:-?[0-9]*)?", "yes_no": "(?:yes|no)?", "any": ".*", "small": "[1-4]?[0-9]"})


# projection and selection


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def loop_filter(spark, d):
    orders = table(spark, d, "orders")
    loop = Loop(orders.withColumn(ROW, F.col("o_orderkey")), "_orders", tuple(orders.columns))
    return loop.filter(["_Orders.O_ORDERKEY", "O_ORDERSTATUS"]).df.drop(ROW)


@query("SELECT p_partkey, p_name FROM part")
def loop_filter_ignore_missing(spark, d):
    part = table(spark, d, "part")
    return Loop(part.withColumn(ROW, F.col("p_partkey")), "_part", tuple(part.columns)).filter(["p_partkey", "absent", "p_name"], ignore_missing=True).df.drop(ROW)


@query("SELECT '_nation.n_name' AS tag, n_name AS value FROM nation")
def get_tag_whole(spark, d):
    nation = table(spark, d, "nation")
    return Loop(nation.withColumn(ROW, F.col("n_nationkey")), "_nation", tuple(nation.columns)).get_tag("N_Name", whole_tag=True).select("n_name.tag", "n_name.value")


def _small_cells(spark, d):
    _, nation = frames_of(table(spark, d, "nation"), "n_nationkey", "nation", "n_name", "n_regionkey")
    _, region = frames_of(table(spark, d, "region"), "r_regionkey", "region", "r_name")
    return nation.unionByName(region)


@query("SELECT '_nation.n_name' AS name, n_name AS value FROM nation UNION ALL SELECT '_region.R_NAME', r_name FROM region")
def get_tags_long(spark, d):
    return entries.get_tags(_small_cells(spark, d), ["_nation.n_name", "_region.R_NAME"]).select("name", "value")


@query("SELECT o_orderkey AS sf_ord FROM orders WHERE o_orderstatus = 'F'")
def frames_by_tag_value(spark, d):
    _, cells = frames_of(table(spark, d, "orders"), "o_orderkey", "orders", "o_orderstatus", "o_orderpriority")
    return entries.frames_by_tag_value(cells, "_orders.o_orderstatus", "F").select("sf_ord")


@query("SELECT l_orderkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS n FROM lineitem) t WHERE n = 1")
def first_value_per_frame(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    cells = table(spark, d, "lineitem").select(F.lit("e").alias("entry_id"), F.col("l_orderkey").alias("sf_ord"), *order, F.lit("l_returnflag").alias("tag"), F.col("l_returnflag").alias("value"))
    return upkeep.first_value(cells, "L_ReturnFlag", order).select(F.col("sf_ord").alias("l_orderkey"), F.col("value").alias("l_returnflag"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS sf_ord, 'n_name' AS tag, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
def loops_by_category(spark, d):
    cells = _small_cells(spark, d).withColumn("kind", F.lit("loop"))
    return entries.loops_by_category(cells, "NATION").select("sf_ord", "tag", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'R'")
def remove_rows(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return Loop(items.withColumn(ROW, F.lit(0)), "_lineitem", tuple(items.columns)).remove_rows("L_ReturnFlag", "R")[0].df.drop(ROW)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IS NOT DISTINCT FROM 'R'")
def removed_rows(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return Loop(items.withColumn(ROW, F.lit(0)), "_lineitem", tuple(items.columns)).remove_rows("l_returnflag", "R")[1].drop(ROW)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'")
def remove_rows_renumber(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).cast("long").alias("nth"))
    kept, _ = Loop(orders.withColumn(ROW, F.col("o_orderkey")), "_orders", tuple(orders.columns)).remove_rows("o_orderstatus", "P")
    return kept.renumber("nth").df.select("o_orderkey", "nth")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + 9 AS nth FROM customer")
def renumber_rows(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lit(0).cast("long").alias("nth"), F.col("c_custkey").alias(ROW))
    return Loop(rows, "_customer", ("c_custkey", "nth")).renumber("nth", 10).df.select("c_custkey", "nth")


@query("SELECT event_id, event_id - min(event_id) OVER () + 1 AS moved FROM events")
def renumber_maintain(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_id").alias("moved"), F.col("event_id").alias(ROW))
    return Loop(rows, "_events", ("event_id", "moved")).renumber("moved", 1, maintain_ordering=True).df.select("event_id", "moved")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def sort_numeric(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderkey").alias(ROW))
    return Loop(rows, "_orders", ("o_orderkey", "price")).sort("price").df.select("o_orderkey", F.col(ROW).alias("place"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_partkey = 1 THEN '.' ELSE CAST(p_size AS VARCHAR) END, p_partkey) - 1 AS place FROM part")
def sort_string_fallback(spark, d):
    size = F.when(F.col("p_partkey") == 1, F.lit(".")).otherwise(F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", size.alias("size"), F.col("p_partkey").alias(ROW))
    return Loop(rows, "_part", ("p_partkey", "size")).sort("size").df.select("p_partkey", F.col(ROW).alias("place"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_nationkey, c_custkey) - 1 AS place FROM customer")
def sort_multi_last_primary(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_custkey").alias(ROW))
    return Loop(rows, "_customer", ("c_custkey", "c_nationkey", "c_mktsegment")).sort("c_nationkey", "c_mktsegment").df.select("c_custkey", F.col(ROW).alias("place"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) t WHERE n >= 100 AND n < 220")
def slice_rows(spark, d):
    return Loop.of(table(spark, d, "orders"), "orders", ["o_orderkey"]).slice(100, 220).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_rows(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderkey").alias(ROW))
    return Loop(orders, "_orders", ("o_orderkey", "o_totalprice")).sort_by(F.desc("o_totalprice")).slice(0, 25).select("o_orderkey", "o_totalprice")


# aggregates and checks


@query("SELECT source AS sf_category, row_number() OVER (ORDER BY min(doc_id)) AS nth FROM documents GROUP BY source")
def category_list(spark, d):
    frames = table(spark, d, "documents").select(F.lit("e").alias("entry_id"), F.col("source").alias("sf_category"), F.col("doc_id").alias("sf_ord"))
    return entries.category_list(frames).select("sf_category", F.col("nth").cast("long").alias("nth"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def object_counts(spark, d):
    frames = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"))
    loops = frames.select("entry_id", F.lit(0).cast("long").alias("n_rows")).limit(0)
    return upkeep.sizes(frames, loops).select(F.col("entry_id").alias("l_orderkey"), F.col("n_frames").alias("n"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS entry_id, CAST(l_linenumber AS VARCHAR) AS sf_name, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_names(spark, d):
    frames = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("entry_id"), F.col("l_linenumber").cast("string").alias("sf_name"))
    return entries.duplicate_names(frames).select("entry_id", "sf_name", F.col("count").alias("n"))


_HOLED = "CASE WHEN event_type = 'click' THEN '.' WHEN event_id % 3 = 0 THEN NULL ELSE '?' END"


@query(f"SELECT bool_or(NOT (h IS NULL OR h IN ('', '.', '?'))) AS holed, bool_or(event_type IS NOT NULL) AS event_type FROM (SELECT event_type, {_HOLED} AS h FROM events) t")
def nonempty_columns(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias(ROW), F.expr(_HOLED).alias("holed"), "event_type")
    return Loop(rows, "_events", ("holed", "event_type")).non_empty_tags()


@query("SELECT event_type, bool_and(v IS NULL OR v IN ('', '.', '?')) AS is_empty FROM (SELECT event_type, CASE WHEN event_type = 'click' THEN '.' ELSE CAST(event_id AS VARCHAR) END AS v FROM events) t GROUP BY event_type")
def is_empty(spark, d):
    value = F.when(F.col("event_type") == "click", ".").otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").groupBy("event_type").agg(F.bool_and(names.is_null(value)).alias("is_empty"))


@query("SELECT c_custkey AS sf_ord FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 200000)")
def drop_empty_frames(spark, d):
    frames, _ = frames_of(table(spark, d, "customer"), "c_custkey", "customer", "c_name")
    held = table(spark, d, "orders").where("o_orderstatus = 'P' and o_totalprice > 200000")
    cells = held.select(F.lit("e").alias("entry_id"), F.col("o_custkey").alias("sf_ord"), F.lit("loop").alias("kind"), F.lit("o_orderkey").alias("tag"), F.col("o_orderkey").cast("string").alias("value"))
    return entries.empty_frames(cells, frames).select("sf_ord")


@query("SELECT event_id, '$C' || user_id AS value FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_nationkey < 20)")
def dangling_refs(spark, d):
    cells = table(spark, d, "events").select("event_id", F.lit("e").alias("entry_id"), F.concat(F.lit("$C"), F.col("user_id").cast("string")).alias("value"))
    frames = table(spark, d, "customer").where("c_nationkey < 20").select(F.lit("e").alias("entry_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("sf_name"))
    return entries.dangling_references(cells, frames).select("event_id", "value")


@query("SELECT (SELECT count(*) FROM nation WHERE lower(n_name) IN ('france', 'nation_1', 'nation_2')) = 3 AS all_there")
def contains_all(spark, d):
    return entries.contains_all(table(spark, d, "nation"), "n_name", ["FRANCE", "nation_1", "NATION_2"])


# references


@query("SELECT o.o_orderkey, c.new_id FROM orders o LEFT JOIN (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS new_id FROM customer) c ON o.o_custkey = c.c_custkey")
def fk_remap(spark, d):
    ids = table(spark, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long").alias("new_id"))
    mapping = ids.select(F.lit("e").alias("entry_id"), F.lit("customer").alias("_table"), F.lit("c_custkey").alias("_column"), F.col("c_custkey").cast("string").alias("_old"), F.col("new_id").cast("string").alias("_new"))
    cells = table(spark, d, "orders").select(F.lit("e").alias("entry_id"), "o_orderkey", F.col("o_custkey").cast("string").alias("value"), F.lit("customer").alias("_table"), F.lit("c_custkey").alias("_column"))
    return normalize.remap(cells, mapping).select("o_orderkey", F.col("_new").cast("long").alias("new_id"))


@query("SELECT s_suppkey, CAST(n.n_nationkey AS BIGINT) AS nation_id FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def label_to_id(spark, d):
    nation = table(spark, d, "nation")
    labelled = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", names.as_reference(F.col("n_name")).alias("label"))
    ids = nation.select(names.as_reference(F.col("n_name")).alias("label"), F.col("n_nationkey").cast("long").alias("nation_id"))
    return normalize.ids_of_labels(labelled, ids, "label", ["s_suppkey"]).select("s_suppkey", "nation_id")


@query("SELECT o_orderkey AS sf_ord, 'o_orderstatus' AS tag, 'new' AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders")
def entry_id_cascade(spark, d):
    _, cells = frames_of(table(spark, d, "orders"), "o_orderkey", "orders", "o_orderstatus", "o_orderpriority")
    return entries.set_entry_id(cells, fixture(spark), "new").select("sf_ord", "tag", "value")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN '$renamed' ELSE '$nation_' || s_nationkey END AS value FROM supplier")
def rename_frame(spark, d):
    frames, _ = frames_of(table(spark, d, "nation"), "n_nationkey", "nation", "n_name")
    cells = table(spark, d, "supplier").select("s_suppkey", F.lit("s").alias("sf_name"), F.lit("loop").alias("kind"), F.lit("nation").alias("tag"), F.concat(F.lit("$nation_"), F.col("s_nationkey").cast("string")).alias("value"))
    return entries.rename_frame(cells, frames, "nation_3", "renamed")[0].select("s_suppkey", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS parent FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def parent_id_fill(spark, d):
    orders = table(spark, d, "orders").select(F.lit("e").alias("entry_id"), F.col("o_orderkey").alias("sf_ord"), F.lit("orders.o_custkey").alias("_parent"), F.col("o_custkey").alias("_parent_value"))
    rows = table(spark, d, "lineitem").select(F.lit("e").alias("entry_id"), F.col("l_orderkey").alias("sf_ord"), "l_linenumber", "l_partkey", "l_suppkey", F.lit("orders.o_custkey").alias("_parent"))
    return normalize.beside_parent(rows, orders).select(F.col("sf_ord").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", F.col("_parent_value").alias("parent"))


# rows and tags


def _nation_loop(spark, d):
    nation = table(spark, d, "nation")
    return Loop(nation.withColumn(ROW, F.col("n_nationkey").cast("long")), "_nation", tuple(nation.columns))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'A', NULL UNION ALL SELECT NULL, 'B', 7")
def add_rows_dicts(spark, d):
    return _nation_loop(spark, d).add_dicts([{"N_NationKey": 100, "n_name": "A"}, {"n_name": "B", "n_regionkey": 7}]).df.drop(ROW)


@query("SELECT CAST(n_nationkey AS BIGINT) AS place, n_name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 1, 'x' UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 2, NULL")
def add_rows_columns(spark, d):
    return _nation_loop(spark, d).add_columns({"n_nationkey": [1, 2], "n_name": ["x"]}).df.select(F.col(ROW).alias("place"), "n_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 200, 'C', 1 UNION ALL SELECT 201, 'D', 2")
def add_rows_flat(spark, d):
    return _nation_loop(spark, d).add_flat([200, "C", 1, 201, "D", 2]).df.drop(ROW)


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def append_positional(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias(ROW))
    return Loop(nation, "_names", ("name",)).append_positional(table(spark, d, "region").select(F.col("r_regionkey").alias(ROW), "r_name")).df.drop(ROW)


@query("SELECT r_regionkey, 'new ' || r_regionkey AS r_name FROM region")
def set_column(spark, d):
    region = table(spark, d, "region")
    loop = Loop(region.withColumn(ROW, F.col("r_regionkey")), "_region", tuple(region.columns))
    return loop.set_tag("R_NAME", loop.df.select(ROW, F.concat(F.lit("new "), F.col(ROW).cast("string")).alias("value"))).df.drop(ROW)


@query("SELECT p_partkey, p_name, CAST(NULL AS VARCHAR) AS added FROM part")
def add_column(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return Loop(part.withColumn(ROW, F.col("p_partkey")), "_part", tuple(part.columns)).add_tag(" _part.added ").df.drop(ROW)


@query("SELECT p_partkey, p_size FROM part")
def remove_columns(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return Loop(part.withColumn(ROW, F.col("p_partkey")), "_part", tuple(part.columns)).remove_tags("P_NAME", "p_brand").df.drop(ROW)


@query("SELECT p_type, p_partkey, CAST(NULL AS VARCHAR) AS p_comment, p_name, p_brand, p_size FROM part")
def add_missing_tags(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    order = [r.tag.partition(".")[2] for r in dictionary.loop_template(fixture(spark), "part").orderBy("place").collect()]
    return Loop(part.withColumn(ROW, F.col("p_partkey")), "_part", tuple(part.columns)).add_missing_tags(order).df.drop(ROW)


@query("SELECT CAST(i AS BIGINT) AS place, t AS tag FROM (VALUES (1, 'p_type'), (2, 'p_partkey'), (3, 'p_brand'), (4, 'p_retailprice')) v(i, t)")
def sort_tags(spark, d):
    part = table(spark, d, "part").select("p_retailprice", "p_partkey", "p_brand", "p_type")
    order = [r.tag.partition(".")[2] for r in dictionary.loop_template(fixture(spark), "part").orderBy("place").collect()]
    tags = Loop(part.withColumn(ROW, F.col("p_partkey")), "_part", tuple(part.columns)).order_tags(order).tags
    return spark.createDataFrame(list(enumerate(tags, 1)), "place long, tag string")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'changed' ELSE r_name END AS r_name FROM region UNION ALL SELECT 99, 'new'")
def upsert_tags(spark, d):
    return entries.upsert(table(spark, d, "region"), spark.createDataFrame([(1, "changed"), (99, "new")], "r_regionkey int, r_name string"), ["r_regionkey"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey IN (0, 3))")
def remove_items(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    gone = [r.n_name for r in nation.where("n_nationkey in (0, 3)").collect()]
    return entries.remove_items(nation, "n_name", gone).select("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 2, 'replaced'")
def replace_item(spark, d):
    return entries.upsert(table(spark, d, "region"), spark.createDataFrame([(2, "replaced")], "r_regionkey int, r_name string"), ["r_regionkey"])


# comparison


_CHANGED = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 10 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_orderkey % 17 <> 0"


@query(f"WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem), b AS ({_CHANGED}) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y")
def compare_rows(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    changed = items.where("l_orderkey % 17 <> 0").withColumn("l_returnflag", F.when(F.col("l_orderkey") % 10 == 0, "X").otherwise(F.col("l_returnflag")))
    return compare.compare_rows(items, changed)


_ORDER_SIDES = "SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 13 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0"


def _order_differences(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    other = orders.where("o_orderkey % 11 <> 0").withColumn("v", F.when(F.col("o_orderkey") % 7 == 0, "Z").otherwise(F.col("v")))
    return compare.compare_by_key(orders.where("o_orderkey % 13 <> 0"), other, ["o_orderkey"], "v")


@query(f"WITH a AS ({_ORDER_SIDES}) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.v AS left_value, b.v AS right_value FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.v IS DISTINCT FROM b.v OR a.o_orderkey IS NULL OR b.o_orderkey IS NULL")
def compare_tags(spark, d):
    return _order_differences(spark, d)


@query(f"WITH a AS ({_ORDER_SIDES}), c AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, a.v AS l, b.v AS r FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.v IS DISTINCT FROM b.v) SELECT row_number() OVER (ORDER BY k) AS n, 'order ' || k || ': ' || coalesce(l, 'nothing') || ' or ' || coalesce(r, 'nothing') AS line FROM c")
def diff_report(spark, d):
    line = "concat('order ', o_orderkey, ': ', coalesce(left_value, 'nothing'), ' or ', coalesce(right_value, 'nothing'))"
    return compare.report(_order_differences(spark, d), line, ["o_orderkey"])


@query("SELECT true AS equal")
def exact_equal(spark, d):
    nation = table(spark, d, "nation")
    return compare.exactly_equal(nation, nation.repartition(3))


# functions


@query("SELECT p_partkey, CASE WHEN p_brand LIKE '\\_%' ESCAPE '\\' THEN split_part(p_brand, '.', 1) ELSE '_' || split_part(p_brand, '.', 1) END AS category, 'x.y' AS tag, lower('A' || p_brand) AS tag_lower FROM part")
def format_names(spark, d):
    brand = F.col("p_brand")
    tag = names.format_tag(F.concat(F.lit("_"), F.replace(brand, F.lit("."), F.lit("")), F.lit(".x.y")))
    return table(spark, d, "part").select("p_partkey", names.format_category(brand).alias("category"), tag.alias("tag"), names.format_tag_lower(F.concat(F.lit("_c.A"), brand)).alias("tag_lower"))


_ODD = ["plain", "_tag", "'q", "a b", "data_x", "LOOP_", "a\tb", "#c", "a#c", "$ref", ";x", "it's \"b\"", "a' \"b", "a' b\" c", "two\nlines", "two\nlines\n", "x\n;y", "d'accord a", 'say "no"', "stop", "x\x0by"]
_LITERALS = ", ".join("(" + f"{i}, " + " || ".join(f"chr({ord(c)})" if c in "\n\t\x0b" else f"""'{c.replace("'", "''")}'""" for c in v) + ")" for i, v in enumerate(_ODD))
_QUOTED = r"""
CASE WHEN contains(v, chr(10) || ';') THEN (CASE WHEN starts_with(v, chr(10)) THEN '' ELSE chr(10) || '   ' END) || replace(v, chr(10), chr(10) || '   ') || chr(10)
  WHEN contains(v, chr(10)) THEN CASE WHEN right(v, 1) = chr(10) THEN v ELSE v || chr(10) END
  WHEN contains(v, '''') AND contains(v, '"') THEN CASE WHEN NOT regexp_matches(v, '''[ \n\t\x0B]') THEN '''' || v || '''' WHEN NOT regexp_matches(v, '"[ \n\t\x0B]') THEN '"' || v || '"' ELSE v || chr(10) END
  WHEN regexp_matches(v, '^[_"''#]') OR regexp_matches(lower(v), '^(data_|save_|loop_|stop_|global_)') OR regexp_matches(v, '[ \n\t\x0B]') THEN CASE WHEN contains(v, '''') THEN '"' || v || '"' ELSE '''' || v || '''' END
  ELSE v END"""


@query(f"SELECT 'odd' AS kind, CAST(i AS BIGINT) AS i, {_QUOTED} AS quoted FROM (VALUES {_LITERALS}) t(i, v) UNION ALL SELECT 'document', doc_id, {_QUOTED} FROM (SELECT doc_id, text AS v FROM documents WHERE text <> '') t UNION ALL SELECT 'part', p_partkey, {_QUOTED} FROM (SELECT p_partkey, p_name AS v FROM part) t")
def quote_value(spark, d):
    odd = spark.createDataFrame([("odd", i, v) for i, v in enumerate(_ODD)], "kind string, i long, v string")
    docs = table(spark, d, "documents").where("text <> ''").select(F.lit("document").alias("kind"), F.col("doc_id").alias("i"), F.col("text").alias("v"))
    part = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("i"), F.col("p_name").alias("v"))
    return odd.unionByName(docs).unionByName(part).select("kind", "i", quoting.quote_value(F.col("v")).alias("quoted"))


@query(f"SELECT 'conversation' AS kind, conv_id AS i, CAST(turn AS BIGINT) AS turn, CASE WHEN v IS NULL THEN '.' ELSE {_QUOTED} END AS quoted FROM (SELECT conv_id, turn, text AS v FROM conversations WHERE text IS NULL OR text <> '') t UNION ALL SELECT 'document', doc_id, NULL, '.' FROM documents WHERE text IS NULL")
def quote_value_conversations(spark, d):
    """Conversations, and the texts that quote_value leaves out for being null; an empty one is an error."""
    turns = table(spark, d, "conversations").where("text is null or text <> ''").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("i"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("v"))
    docs = table(spark, d, "documents").where("text is null").select(F.lit("document").alias("kind"), F.col("doc_id").alias("i"), F.lit(None).cast("long").alias("turn"), F.col("text").alias("v"))
    return turns.unionByName(docs).select("kind", "i", "turn", quoting.quote_value(F.col("v")).alias("quoted"))


@query("SELECT conv_id, turn, chr(10) || coalesce(text, '') || chr(10) || ';end' AS text FROM conversations")
def escape_roundtrip(spark, d):
    held = F.concat(F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n;end"))
    return table(spark, d, "conversations").select("conv_id", "turn", quoting.unescape_block(quoting.escape_block(held)).alias("text"))


@query("SELECT event_id, CAST(value AS DOUBLE) AS number, CAST(event_id AS BIGINT) AS whole, CAST(NULL AS BIGINT) AS none FROM events")
def convert_types(spark, d):
    events = table(spark, d, "events")
    return events.select("event_id", values.as_number(F.col("value").cast("string")).alias("number"), values.as_integer(F.col("event_id").cast("string")).alias("whole"), values.as_integer(F.lit("1d")).alias("none"))


@query("""
SELECT o_orderkey AS id, '_orders.o_orderpriority' AS tag, 'Length of ''' || length(o_orderpriority) || ''' is too long for ''VARCHAR(8)'': ''_orders.o_orderpriority'':''' || o_orderpriority || '''.' AS message FROM orders WHERE length(o_orderpriority) > 8
UNION ALL SELECT o_orderkey, '_orders.o_orderstatus', 'Value does not match specification: ''_orders.o_orderstatus'':''' || o_orderstatus || '''.' FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('', '.', '?')
UNION ALL SELECT o_orderkey, '_orders.o_orderkey', 'Value cannot be NULL but is: _orders.o_orderkey'':''.''.' FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT o_orderkey, '_orders.o_comment', 'Tag ''_orders.o_comment'' not found in schema.' FROM orders WHERE o_orderkey % 100 = 0
""")
def validate_values(spark, d):
    orders = table(spark, d, "orders").withColumn("key", F.col("o_orderkey"))
    orders = orders.withColumn("o_orderkey", F.when(F.col("key") % 50 == 0, ".").otherwise(F.col("key").cast("string"))).withColumn("o_comment", F.lit("x"))
    _, cells = frames_of(orders, "key", "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_comment")
    cells = cells.where("tag <> 'o_comment' or sf_ord % 100 = 0")
    return validate.cell_errors(cells, fixture(spark)).select(F.col("sf_ord").alias("id"), F.col("tag_full").alias("tag"), "message")


@query("SELECT p_partkey AS row_ord, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 4 END AS n FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0")
def validate_width(spark, d):
    width = F.when(F.col("p_partkey") % 5 == 0, 2).when(F.col("p_partkey") % 7 == 0, 4).otherwise(3)
    cells = table(spark, d, "part").select(F.lit("e").alias("entry_id"), F.lit(1).alias("sf_ord"), F.lit(1).alias("loop_ord"), F.lit("loop").alias("kind"), F.col("p_partkey").alias("row_ord"), F.explode(F.sequence(F.lit(1), width)).alias("col_ord"))
    loops = spark.createDataFrame([("e", 1, 1, ["a", "b", "c"])], "entry_id string, sf_ord int, loop_ord int, tags array<string>")
    return validate.width_errors(cells, loops).select("row_ord", F.col("n").cast("int").alias("n"))


# text, JSON, CSV


@query("SELECT n_nationkey, n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def to_csv_rows(spark, d):
    nation = table(spark, d, "nation")
    return nation.select("n_nationkey", writer.csv_line([F.col(c).cast("string") for c in nation.columns]).alias("line"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS sf_ord, '{\"category\":\"_region\",\"tags\":[\"r_name\"],\"data\":[[\"' || r_name || '\"]]}' AS json FROM region")
def to_json_rows(spark, d):
    _, cells = frames_of(table(spark, d, "region"), "r_regionkey", "region", "r_name")
    loops = cells.select("sf_ord", "category", F.array(F.lit("r_name")).alias("tags")).distinct()
    return writer.loop_json(cells, loops, ["sf_ord"])


@query("""
SELECT 'e' AS entry_id, chr(10) || '   loop_' || chr(10) || '      _region.r_regionkey' || chr(10) || '      _region.r_name' || chr(10) || chr(10)
  || string_agg('     ' || rpad(k, w0, ' ') || rpad(q, w1, ' ') || ' ' || chr(10), '' ORDER BY r_regionkey) || chr(10) || '   stop_' || chr(10) AS text
FROM (SELECT r_regionkey, k, q, CAST(greatest(4, max(length(k)) OVER () + 3) AS INTEGER) AS w0, CAST(greatest(4, max(length(q)) OVER () + 3) AS INTEGER) AS w1
  FROM (SELECT r_regionkey, CAST(r_regionkey AS VARCHAR) AS k, CASE WHEN contains(r_name, ' ') THEN chr(39) || r_name || chr(39) ELSE r_name END AS q FROM region) r) t
""")
def format_loop(spark, d):
    region = table(spark, d, "region")
    cells = Loop(region.withColumn(ROW, F.col("r_regionkey")), "_region", ("r_regionkey", "r_name")).as_cells().withColumn("entry_id", F.lit("e"))
    loops = spark.createDataFrame([("e", "_region", ["r_regionkey", "r_name"])], "entry_id string, category string, tags array<string>")
    return writer.format_loops(cells, loops, ["entry_id"])


@query("SELECT doc_id, replace(text, chr(13), chr(10)) || chr(10) AS token FROM documents WHERE text IS NOT NULL")
def tokenize(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    found = star.tokens(docs.select(F.col("doc_id").alias("file"), F.concat(F.lit(";\n"), "text", F.lit("\n;\n")).alias("text")))
    return found.select(F.col("file").alias("doc_id"), "token")


def _star_text(spark, d, rows: DataFrame, category: str, groups: int = 1) -> DataFrame:
    """(file, text): a table as entries of one loop each, rows dealt by key to some files."""
    columns = rows.columns
    loop = Loop(rows.withColumn(ROW, F.col(columns[0]).cast("long")), f"_{category}", tuple(columns))
    cells = loop.as_cells().withColumn("entry_id", F.concat(F.lit("f"), F.pmod("row_ord", F.lit(groups)).cast("string")))
    loops = cells.select("entry_id").distinct().select("entry_id", F.lit(f"_{category}").alias("category"), F.array(*map(F.lit, columns)).alias("tags"))
    bodies = writer.format_loops(cells, loops, ["entry_id"])
    return bodies.select(F.col("entry_id").alias("file"), F.concat(F.lit("data_"), "entry_id", F.lit("\n\nsave_all\n   _All.Sf_category  all\n"), "text", F.lit("\nsave_\n")).alias("text"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part")
def parse_roundtrip(spark, d):
    part = texts(table(spark, d, "part"), "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    parsed = star.parse(_star_text(spark, d, part, "part", 16)).checked()
    return wide(entries.loops_by_category(parsed.cells, "part"), part.columns, ["file"]).drop("file", ROW)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def json_roundtrip(spark, d):
    nation = texts(table(spark, d, "nation"), "n_nationkey", "n_name", "n_regionkey")
    parsed = star.parse(_star_text(spark, d, nation, "nation"))
    keyed = [t.withColumn("loop_ord", F.col("loop_ord")) for t in (parsed.cells, parsed.loops)]
    read = star.from_json(writer.entry_json(parsed.saveframes, *keyed), "json")
    return wide(entries.loops_by_category(read, "nation"), nation.columns).drop(ROW)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ', \"' || p_brand AS p_name FROM part")
def csv_roundtrip(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), F.concat("p_name", F.lit(', "'), "p_brand").alias("p_name"))
    lines = rows.select(writer.csv_line([F.col("p_partkey"), F.col("p_name")]).alias("line"))
    return csv_tables.loop_rows_from_csv(lines, "line", ["p_partkey", "p_name"])


@query("SELECT CAST(greatest(4, max(length(p_name)) + 3) AS BIGINT) AS p_name, CAST(greatest(4, max(length(p_brand)) + 3) AS BIGINT) AS p_brand FROM part")
def column_width(spark, d):
    part = table(spark, d, "part").select("p_name", "p_brand")
    return Loop(part, "_part", ("p_name", "p_brand")).widths()


# dictionary


@query("SELECT CAST(i AS BIGINT) AS place, t AS tag FROM (VALUES (1, '_part.p_type'), (2, '_part.p_partkey'), (3, '_part.p_comment'), (4, '_part.P_Name'), (5, '_part.p_brand'), (6, '_part.p_size')) v(i, t)")
def template_rows(spark, d):
    return dictionary.loop_template(fixture(spark), "PART").select("place", "tag")


@query("SELECT CAST(i AS BIGINT) AS place, t AS tag, v AS value FROM (VALUES (1, '_orders.o_orderkey', NULL), (2, '_orders.o_custkey', NULL), (3, '_orders.o_orderstatus', 'e1'), (4, '_orders.o_orderpriority', '5-LOW')) x(i, t, v)")
def template_frame(spark, d):
    return dictionary.frame_template(fixture(spark), "orders", "orders_1", "e1", default_values=True)


@query("""
SELECT '_part' AS category, CAST(NULL AS DOUBLE) AS seq, rpad('_part', 30, ' ') AS line
UNION ALL SELECT '_part', 4.0, '  ' || rpad('p_type', 15, ' ') || ' ' || rpad('VARCHAR(255)', 12, ' ') || ' ' || rpad('', 8, ' ') || '  ' || rpad('part', 6, ' ')
""")
def dictionary_listing(spark, d):
    return dictionary.listing(fixture(spark), "p_type")


@query("SELECT t AS tag, CAST(s AS DOUBLE) AS seq FROM (VALUES ('_part.p_new', 4.5), ('_part.p_end', 11), ('_part.p_type', 4)) v(t, s)")
def schema_extend(spark, d):
    wider = dictionary.extend(dictionary.extend(fixture(spark), "_part.p_new", "DATETIME year to day", after="_part.P_TYPE"), "_part.p_end", "TEXT")
    return wider.where("tag in ('_part.p_new', '_part.p_end', '_part.p_type')").select("tag", "seq")


# order and listings


def _frame_order(spark, docs: DataFrame, category: str, known: list[str]) -> DataFrame:
    """The normalised order of documents as saveframes of one entry."""
    frames = docs.select(F.lit("e").alias("entry_id"), F.col("doc_id").alias("sf_ord"), F.col(category).alias("sf_category"), F.concat(F.lit("_"), category).alias("tag_prefix"))
    cells = docs.select(F.lit("e").alias("entry_id"), F.col("doc_id").alias("sf_ord"), F.lit("tag").alias("kind"), F.lit("ID").alias("tag"), F.lit(0).alias("col_ord"), F.col("doc_id").cast("string").alias("value"))
    order = normalize.frame_order(frames, cells, dictionary.from_rows(spark, [{"tag": f"_{k}.ID"} for k in known]))
    return order.select("sf_ord", F.col("new_ord").cast("long").alias("new_ord"))


@query("SELECT doc_id AS sf_ord, row_number() OVER (ORDER BY CASE WHEN lang = 'de' THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END, CASE WHEN lang = 'es' THEN '98' WHEN lang = 'fr' THEN '99' END, doc_id) AS new_ord FROM (SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'en')) t")
def normalize_order(spark, d):
    return _frame_order(spark, table(spark, d, "documents").where("lang in ('de', 'en')"), "lang", ["de", "en"])


@query("SELECT doc_id AS sf_ord, row_number() OVER (ORDER BY CASE WHEN lang IN ('de', 'en') THEN 0 WHEN lang IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN lang = 'de' THEN 0 WHEN lang = 'en' THEN 1 END, sha1(lang), doc_id) AS new_ord FROM documents")
def normalize_order_lang(spark, d):
    """All documents: languages of the dictionary, then others by hash, then rows without one."""
    return _frame_order(spark, table(spark, d, "documents"), "lang", ["de", "en"])


@query("SELECT doc_id AS sf_ord, row_number() OVER (ORDER BY CASE WHEN source IS NOT NULL THEN 1 ELSE 2 END, sha1(source), doc_id) AS new_ord FROM documents")
def normalize_order_source(spark, d):
    """All documents with their source as category, which no dictionary knows."""
    return _frame_order(spark, table(spark, d, "documents"), "source", ["de"])


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AS first_in_category FROM documents")
def first_in_category(spark, d):
    return listing.first_of_category(table(spark, d, "documents"), "source", "doc_id", ()).select("doc_id", "first_in_category")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_name, n_nationkey) - 1 AS place FROM nation")
def frame_order(spark, d):
    return numbered(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_name", "n_nationkey"], "place").select("n_nationkey", "place")


@query("SELECT 0 AS depth, CAST(r_regionkey AS BIGINT) AS parent, CAST(0 AS BIGINT) AS nth, r_name AS label FROM region UNION ALL SELECT 1, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), n_name FROM nation")
def tree_listing(spark, d):
    parents = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("parent"), F.col("r_name").alias("label"))
    children = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("parent"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("label"))
    return listing.outline(parents, children)


@query("SELECT coalesce(a.n, b.n) AS n, coalesce(x, '') || chr(9) || coalesce(y, '') AS line FROM (SELECT CAST(n_nationkey AS BIGINT) AS n, n_name AS x FROM nation) a FULL JOIN (SELECT CAST(r_regionkey AS BIGINT) AS n, r_name AS y FROM region) b ON a.n = b.n")
def tag_table(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("value"))
    b = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("n"), F.col("r_name").alias("value"))
    return listing.side_by_side([a, b])


@query("SELECT i, regexp_replace(lower(trim(v)), '^bmr', '') AS accession FROM (VALUES (1, 'bmr15000'), (2, ' BMR17 '), (3, '99'), (4, 'abmr1')) t(i, v)")
def accession_names(spark, d):
    return spark.createDataFrame([(1, "bmr15000"), (2, " BMR17 "), (3, "99"), (4, "abmr1")], "i int, v string").select("i", names.accession(F.col("v")).alias("accession"))


@query("SELECT doc_id, replace(text, chr(10), '') AS sequence FROM documents")
def polymer_sequence(spark, d):
    return table(spark, d, "documents").select("doc_id", names.one_line(F.col("text")).alias("sequence"))


@query("SELECT 'orders_' || o_orderkey || ': ' || o_orderstatus AS line FROM orders")
def list_frames(spark, d):
    frames = table(spark, d, "orders").select(F.concat(F.lit("orders_"), F.col("o_orderkey").cast("string")).alias("sf_name"), "o_orderstatus")
    return listing.frame_lines(frames, F.col("o_orderstatus"))


@query("SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def star_join(spark, d):
    """Regions and nations written as tag/loop text, parsed, and joined from the parsed cells."""
    files = _star_text(spark, d, texts(table(spark, d, "nation"), "n_nationkey", "n_name", "n_regionkey"), "nation", 4)
    more = _star_text(spark, d, texts(table(spark, d, "region"), "r_regionkey", "r_name"), "region")
    cells = star.parse(files.unionByName(more.withColumn("file", F.concat(F.lit("region/"), "file")))).checked().cells
    nation = wide(entries.loops_by_category(cells, "nation"), ["n_name", "n_regionkey"], ["file"])
    region = wide(entries.loops_by_category(cells, "region"), ["r_regionkey", "r_name"], ["file"])
    return nation.join(region.drop("file", ROW), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


# saveframes


@query("SELECT o_orderkey AS sf_ord, o_orderstatus AS sf_category, 'o_orderstatus' AS tag, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS value FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, 'note', '.' FROM orders WHERE o_orderkey % 3 = 0")
def frame_add_tags(spark, d):
    frames, cells = frames_of(table(spark, d, "orders"), "o_orderkey", "orders", "o_orderstatus")
    category = table(spark, d, "orders").select(F.col("o_orderkey").alias("sf_ord"), F.col("o_orderstatus").alias("c"))
    frames, cells = (x.join(category, "sf_ord").withColumn("sf_category", F.col("c")).drop("c") for x in (frames, cells))
    third = frames.where("sf_ord % 3 = 0").select("entry_id", "sf_ord")
    tags = third.select("*", F.lit("_Orders.O_OrderStatus").alias("tag"), F.lit("changed").alias("value")).unionByName(third.select("*", F.lit("note").alias("tag"), F.lit(None).cast("string").alias("value")))
    found, _ = upkeep.add_tags(cells, frames, tags, update=True)
    return found.select("sf_ord", "sf_category", F.lower("tag").alias("tag"), "value")


@query("SELECT CAST(n_nationkey AS BIGINT) AS sf_ord, CASE WHEN n_nationkey = 3 THEN 'new' ELSE 'nation_' || n_nationkey END AS sf_name, CASE WHEN n_nationkey = 3 THEN 'land' ELSE 'nation' END AS sf_category, CASE WHEN n_nationkey = 3 THEN '_Land' ELSE '_nation' END AS category, n_name AS value FROM nation")
def frame_rename_all(spark, d):
    frames, cells = frames_of(table(spark, d, "nation"), "n_nationkey", "nation", "n_name")
    cells, _ = upkeep.set_frame(cells, frames, "nation_3", "new", "land", "Land")
    return cells.select("sf_ord", "sf_name", "sf_category", "category", "value")


@query("SELECT o_orderkey AS sf_ord, CAST(i AS BIGINT) AS col_ord, t AS tag, CASE t WHEN 'o_custkey' THEN CAST(o_custkey AS VARCHAR) WHEN 'o_orderpriority' THEN o_orderpriority WHEN 'o_extra' THEN o_orderstatus END AS value FROM orders CROSS JOIN (VALUES (0, 'o_orderkey'), (1, 'o_custkey'), (2, 'o_orderstatus'), (3, 'o_orderpriority'), (4, 'o_extra')) v(i, t)")
def frame_missing_tags(spark, d):
    frames, cells = frames_of(table(spark, d, "orders").withColumn("o_extra", F.col("o_orderstatus")), "o_orderkey", "orders", "o_extra", "o_orderpriority", "o_custkey")
    found = upkeep.add_missing_tags(cells, frames, fixture(spark))
    return found.select("sf_ord", F.col("col_ord").cast("long").alias("col_ord"), "tag", "value")


@query("SELECT CAST(n_nationkey AS BIGINT) AS sf_ord FROM nation WHERE n_nationkey IN (4, 7)")
def frame_access(spark, d):
    frames, _ = frames_of(table(spark, d, "nation"), "n_nationkey", "nation", "n_name")
    return upkeep.frame_by_name(frames, "nation_7").unionByName(upkeep.frame_by_place(frames, 4)).select("sf_ord")


@query("SELECT CAST(n_nationkey AS BIGINT) AS sf_ord, n_name AS value FROM nation")
def frame_get_tag(spark, d):
    _, cells = frames_of(table(spark, d, "nation"), "n_nationkey", "nation", "n_name", "n_regionkey")
    return upkeep.frame_tag(cells, "N_Name").select("sf_ord", "value")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'new'")
def add_unique_items(spark, d):
    return upkeep.add_items(table(spark, d, "nation").select("n_nationkey", "n_name"), spark.createDataFrame([(100, "new")], "n_nationkey int, n_name string"), ["n_name"], "saveframe")


@query("SELECT 'e' AS entry_id, (SELECT count(*) FROM customer) AS n_frames, count(*) AS n_loops, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t")
def entry_sizes(spark, d):
    frames, _ = frames_of(table(spark, d, "customer"), "c_custkey", "customer", "c_name")
    loops = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_rows")).withColumn("entry_id", F.lit("e"))
    return upkeep.sizes(frames, loops)


@query("SELECT CAST(n_regionkey AS BIGINT) AS g, to_json(map_from_entries(list((n_name, CAST(n_nationkey AS VARCHAR)) ORDER BY n_name))) AS items FROM nation GROUP BY n_regionkey")
def items_as_map(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("g"), "n_name", F.col("n_nationkey").cast("string").alias("k"))
    return upkeep.as_map(nation, ["g"], "n_name", "k").select("g", F.to_json("items").alias("items"))


# typed rows, comparison, listings


@query("SELECT p_partkey AS k, CAST(CAST(p_partkey AS BIGINT) * 1000003 AS VARCHAR) AS whole, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS price, DATE '1995-01-01' + CAST(p_size AS INTEGER) AS day FROM part")
def convert_loop(spark, d):
    rows = [{"tag": "_part.whole", "data_type": "INTEGER"}, {"tag": "_part.price", "data_type": "FLOAT"}, {"tag": "_part.day", "data_type": "DATETIME year to day"}]
    part = table(spark, d, "part").select(F.col("p_partkey").alias(ROW), F.col("p_partkey").alias("k"), (F.col("p_partkey") * 1000003).cast("string").alias("whole"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise(".").alias("price"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size")).cast("string").alias("day"))
    return Loop(part, "_part", ("k", "whole", "price", "day")).converted(dictionary.from_rows(spark, rows), strict=True).df.select("k", F.col("whole").cast("string").alias("whole"), "price", "day")


@query("SELECT n_nationkey, to_json(map(['N_Name', 'key'], [n_name, CAST(n_nationkey AS VARCHAR)])) AS row FROM (SELECT n_nationkey, n_name FROM nation) t")
def get_tag_maps(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("key"), F.col("n_nationkey").alias(ROW))
    return Loop(nation, "_nation", ("n_nationkey", "n_name", "key")).get_tag("N_Name", "key", dict_result=True).select(F.col(ROW).alias("n_nationkey"), F.to_json("values").alias("row"))


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS ordinal, CAST(NULL AS VARCHAR) AS added FROM nation")
def missing_tags_fill_ordinals(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 3, F.col("n_nationkey")).cast("long").alias("Ordinal"), F.col("n_nationkey").alias(ROW))
    found = Loop(nation, "_nation", ("n_nationkey", "Ordinal")).add_missing_tags_and_order(["Ordinal", "added", "n_nationkey"])
    return found.df.select("n_nationkey", F.col("Ordinal").alias("ordinal"), "added")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 90, 'a' UNION ALL SELECT 91, 'b'")
def add_rows_by_tag(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").cast("long").alias(ROW))
    return Loop(nation, "_nation", ("n_nationkey", "n_name")).add_by_tag([("n_nationkey", 90), ("N_Name", "a"), ("n_nationkey", 91), ("n_name", "b")]).set_category("land").df.drop(ROW)


@query("SELECT CASE WHEN count(*) = 0 THEN true ELSE false END AS equal FROM (SELECT n_nationkey, n_name FROM nation EXCEPT ALL SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'x' ELSE n_name END FROM nation) t")
def exact_unequal(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return compare.exactly_equal(nation, nation.withColumn("n_name", F.when(F.col("n_nationkey") == 5, "x").otherwise(F.col("n_name"))))


@query("SELECT bool_and(r_name = 'AFRICA') AS equal FROM region")
def equal_text(spark, d):
    return compare.equal_text(table(spark, d, "region"), "r_name", "AFRICA")


@query("SELECT 'numbers of saveframes differ: ' || (SELECT count(*) FROM nation) || ' ' || (SELECT count(*) FROM nation WHERE n_nationkey <> 4) AS message UNION ALL SELECT 'saveframe differs or is missing: nation_4' UNION ALL SELECT 'tag differs: _nation.n_name ' || n_name || ' other' FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'tag differs: _nation.n_name ' || n_name FROM nation WHERE n_nationkey = 4")
def compare_whole_entries(spark, d):
    nation = table(spark, d, "nation")
    other = nation.where("n_nationkey <> 4").withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, "other").otherwise(F.col("n_name")))
    return compare.entry_messages(*(frames_of(n, "n_nationkey", "nation", "n_name") for n in (nation, other)))


@query("SELECT 'entry e' AS line UNION ALL SELECT chr(9) || '[' || (row_number() OVER (ORDER BY n_nationkey) - 1) || '] saveframe nation_' || n_nationkey FROM nation UNION ALL SELECT chr(9) || chr(9) || '[0] loop _supplier' FROM (SELECT DISTINCT s_nationkey FROM supplier) t")
def print_tree(spark, d):
    frames, _ = frames_of(table(spark, d, "nation"), "n_nationkey", "nation", "n_name")
    loops = table(spark, d, "supplier").select(F.lit("e").alias("entry_id"), F.col("s_nationkey").alias("sf_ord"), F.lit(1).alias("loop_ord"), F.lit("_supplier").alias("category")).distinct()
    return listing.tree_lines(frames, loops).select("line")


@query("SELECT CAST(-1 AS BIGINT) AS n, '_part.p_partkey,_part.p_name' AS line UNION ALL SELECT p_partkey, p_partkey || ',' || p_name FROM part")
def loop_to_csv(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return csv_tables.loop_to_csv(part, ["p_partkey", "p_name"], "_part", "p_partkey")


@query("SELECT o_orderkey AS sf_ord, '_orders.o_orderstatus,_orders.o_orderpriority' AS header, o_orderstatus || ',' || o_orderpriority AS line FROM orders")
def frames_to_csv(spark, d):
    _, cells = frames_of(table(spark, d, "orders"), "o_orderkey", "orders", "o_orderstatus", "o_orderpriority")
    return csv_tables.frames_to_csv(cells).select("sf_ord", "header", "line")


@query("SELECT CAST(n_regionkey AS BIGINT) AS entry_id, min(n_nationkey) AS only FROM nation WHERE n_nationkey < 5 AND n_name <> 'x' GROUP BY n_regionkey HAVING count(*) = 1")
def only_frame(spark, d):
    nation = table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_regionkey").cast("long").alias("entry_id"), F.col("n_nationkey").alias("only"), F.lit("nation").alias("sf_category"))
    single = nation.join(nation.groupBy("entry_id").count().where("count = 1").select("entry_id"), "entry_id")
    return listing.only_frame(single, "nation").select("entry_id", "only")


@query(f"SELECT doc_id, CASE WHEN v IS NULL THEN 'none' WHEN v = '' THEN '.' ELSE {_QUOTED} END AS quoted FROM (SELECT doc_id, text AS v FROM documents) t")
def quote_value_with_nulls(spark, d):
    return table(spark, d, "documents").select("doc_id", quoting.quote_value(F.col("text"), {None: "none", "": "."}).alias("quoted"))


@query("""SELECT o_orderkey AS id, 'Value does not match specification: ''_orders.o_orderstatus'':''' || o_orderstatus || '''.' || chr(10) || '     Type specified: yes_no' || chr(10) || '     Regular expression for type: ''^(?:yes|no)?$''' AS message FROM orders WHERE o_orderstatus NOT IN ('', '.', '?')""")
def validate_values_explained(spark, d):
    _, cells = frames_of(table(spark, d, "orders"), "o_orderkey", "orders", "o_orderstatus")
    return validate.cell_errors(cells, fixture(spark), explained=True).select(F.col("sf_ord").alias("id"), "message")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, '_region' AS category, CAST(0 AS BIGINT) AS row_ord, 'r_name' AS tag, r_name AS value FROM region")
def loops_from_json(spark, d):
    _, cells = frames_of(table(spark, d, "region"), "r_regionkey", "region", "r_name")
    loops = cells.select("sf_ord", "category", F.array(F.lit("r_name")).alias("tags")).distinct()
    texts_ = writer.loop_json(cells, loops, ["sf_ord"]).withColumn("id", F.col("sf_ord").cast("string"))
    return star.loops_from_json(texts_, "id", "json").select("id", "category", "row_ord", "tag", "value")


@query("SELECT 'e' AS entry_id, 'Several saveframes are named region_' || r_regionkey AS message FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'e', 'Dangling saveframe reference $region_99 in _nation.r' FROM nation WHERE n_regionkey = 1")
def validate_whole(spark, d):
    frames, cells = frames_of(table(spark, d, "region"), "r_regionkey", "region", "r_name")
    frames = frames.unionByName(frames.where("sf_ord = 2").withColumn("sf_ord", F.col("sf_ord") + 100))
    wanted = F.when(F.col("n_regionkey") == 1, F.lit("$region_99")).otherwise(F.concat(F.lit("$region_"), F.col("n_regionkey").cast("string")))
    _, references = frames_of(table(spark, d, "nation").withColumn("r", wanted), "n_nationkey", "nation", "r")
    known = dictionary.from_rows(spark, [{"tag": "_nation.r", "sf_category": "nation"}, {"tag": "_region.r_name", "sf_category": "region"}])
    loops = spark.createDataFrame([], "entry_id string, sf_ord long, loop_ord long, tags array<string>")
    return validate.validate(cells.unionByName(references), frames, loops, known)


# files of any size, malformed files, files written by commit


#: A malformed file for each remainder of a key, and what is wrong with it.
_MALFORMED = [
    ("", "The file does not begin with 'data_' and a name."),
    ("data_a save_a _A.Sf_framecode b save_", "Sf_framecode is not the saveframe's name."),
    ("data_a save_a _Ax 1 save_", "A saveframe has no tag that names its category."),
    ("data_a save_a _A.b c loop_ _B.a 1 'stop_' stop_ save_", "'stop_' may not be quoted within a loop."),
    ("data_a save_a _A. c save_", "A tag has no name."),
    ("data_a save_a _A.b.c d save_", "A tag has more than one '.' in its name."),
    ("data_a save_a _A.b c loop_ _b 1 stop_ save_", "A tag of a loop names no category."),
    ("# nothing else", "The file does not begin with 'data_' and a name."),
    ("data_a save_a _A.b c save_", None),
    (None, "The file does not begin with 'data_' and a name."),
    ("data_a save_a _A.b c loop_ _B.a _B.b 1 2 3 stop_ save_", "The number of values is not a multiple of the number of tags."),
]
_MESSAGES = " ".join(f"WHEN {i} THEN '{m.replace(chr(39), chr(39) * 2)}'" for i, (_, m) in enumerate(_MALFORMED) if m)


@query(f"SELECT message, count(*) AS n FROM (SELECT CASE p_partkey % {len(_MALFORMED)} {_MESSAGES} END AS message FROM part) t WHERE message IS NOT NULL GROUP BY message")
def parse_errors(spark, d):
    """A file for each part, most of them malformed; errors by kind."""
    files = F.element_at(F.array(*[F.lit(t).cast("string") for t, _ in _MALFORMED]), (F.col("p_partkey") % len(_MALFORMED) + 1).cast("int"))
    found = star.parse(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), files.alias("text")))
    return found.errors.groupBy("message").agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders")
def parse_large_files(spark, d):
    """All orders in files of up to a million rows, each parsed in segments of 64 KB."""
    orders = texts(table(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    files = _star_text(spark, d, orders, "orders", orders.count() // 1_000_000 + 1)
    parsed = star.parse_segments(star.cut_texts(files, 1 << 16)).checked()
    return wide(entries.loops_by_category(parsed.cells, "orders"), orders.columns, ["file"]).drop("file", ROW)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def write_and_read_files(spark, d):
    """Customers as text files that a commit wrote, and what the data source reads of them."""
    customers = texts(table(spark, d, "customer"), "c_custkey", "c_name", "c_mktsegment")
    folder = scratch_folder(spark, "entries")
    datasource.write_entries(_star_text(spark, d, customers, "customer", customers.count() // 1000 + 1), folder, id_col="file")
    parsed = datasource.read_large_files(spark, folder, 1 << 14, 1 << 20).checked()
    return wide(entries.loops_by_category(parsed.cells, "customer"), customers.columns, ["file"]).drop("file", ROW)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def write_json_files(spark, d):
    """Suppliers by nation as JSON files that a commit wrote, read again."""
    rows = table(spark, d, "supplier").withColumn("entry_id", F.concat(F.lit("n"), F.col("s_nationkey")))
    columns = ["s_suppkey", "s_name", "s_nationkey"]
    pairs = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for i, t in enumerate(columns)])
    cells = rows.select("entry_id", F.lit(1).cast("long").alias("sf_ord"), F.lit("loop").alias("kind"), F.lit(1).cast("long").alias("loop_ord"), F.col("s_suppkey").alias("row_ord"), F.explode(pairs).alias("c")).select("*", "c.*").drop("c")
    framed = rows.select("entry_id").distinct().select("entry_id", F.lit(1).cast("long").alias("sf_ord"))
    frames = framed.select("*", F.lit("all").alias("sf_name"), F.lit("all").alias("sf_category"), F.lit("_All").alias("tag_prefix"))
    loops = framed.select("*", F.lit(1).cast("long").alias("loop_ord"), F.lit("_supplier").alias("category"), F.array(*map(F.lit, columns)).alias("tags"))
    folder = scratch_folder(spark, "json-entries")
    datasource.write_entries(writer.entry_json(frames, cells, loops), folder, "json", text_col="json")
    read = star.from_json(spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder))
    return wide(entries.loops_by_category(read, "supplier"), columns, ["entry_id"]).drop("entry_id", ROW)


@query("SELECT doc_id, text FROM documents")
def compressed_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", datasource.inflate(datasource.deflate("text")).alias("text"))


@query("SELECT c_custkey AS sf_ord FROM customer WHERE c_custkey % 3 <> 0")
def drop_structural_frames(spark, d):
    """Saveframes that hold only structural tags; a tag whose name only ends like one of them counts as data."""
    customer = table(spark, d, "customer").withColumn("Sf_category", F.lit("customer")).withColumn("NMR_STAR_version", F.lit("3.1"))
    frames, cells = frames_of(customer.withColumn("My_star_version", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(".")), "c_custkey", "customer", "Sf_category", "NMR_STAR_version", "My_star_version")
    left, _ = entries.remove_empty_frames(cells, frames)
    return frames.select("sf_ord").join(left.select("sf_ord").distinct(), "sf_ord", "left_anti")


@query("SELECT n_nationkey, n_name, n_regionkey AS half FROM nation")
def add_qualified_tag(spark, d):
    """A tag named with its category is added; one of another category, or with a second dot, is an error."""
    nation = table(spark, d, "nation")
    loop = Loop(nation.withColumn(ROW, F.col("n_nationkey")), "_nation", ("n_nationkey", "n_name", "n_regionkey"))
    for wrong in ("_nation.x.y", "_other.z", "_nation.", "a b"):
        try:
            loop.add_tag(wrong)
        except ValueError:
            continue
        raise AssertionError(wrong)
    return loop.add_tag("_Nation.half", F.col("n_regionkey")).df.select("n_nationkey", "n_name", "half")


# whole normalisation


@query("SELECT doc_id AS sf_ord, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) AS frame_id FROM documents")
def frame_numbers(spark, d):
    """Every document's number among those of its source, all in one entry."""
    docs = table(spark, d, "documents")
    frames = docs.select(F.lit("e").alias("entry_id"), F.col("doc_id").alias("sf_ord"), F.col("source").alias("sf_category"), F.concat(F.lit("_"), "source").alias("tag_prefix"))
    cells = docs.select(F.lit("e").alias("entry_id"), F.col("doc_id").alias("sf_ord"), F.lit("tag").alias("kind"), F.lit("ID").alias("tag"), F.lit(0).alias("col_ord"), F.col("doc_id").cast("string").alias("value"))
    return normalize.frame_order(frames, cells, dictionary.from_rows(spark, [{"tag": "_de.ID"}])).select("sf_ord", "frame_id")


@query("""
WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS n FROM customer),
o AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT n AS sf_ord, 'tag' AS kind, CAST(0 AS BIGINT) AS row_ord, 'ID' AS tag, CAST(n AS VARCHAR) AS value FROM c
UNION ALL SELECT n, 'tag', 0, 'Name', c_name FROM c
UNION ALL SELECT n, 'loop', r - 1, 'ID', CAST(r AS VARCHAR) FROM c JOIN o ON c_custkey = o_custkey
UNION ALL SELECT n, 'loop', r - 1, 'Customer_ID', CAST(n AS VARCHAR) FROM c JOIN o ON c_custkey = o_custkey
UNION ALL SELECT n, 'loop', r - 1, 'Status', o_orderstatus FROM c JOIN o ON c_custkey = o_custkey
""")
def normalize_whole(spark, d):
    """Customers as saveframes of one entry, their orders as loops: new ids, and references that follow."""
    known = dictionary.from_rows(spark, [
        {"tag": "_Customer.ID", "sf_category": "customer", "star_type": "int", "local_id_flag": True}, {"tag": "_Customer.Name", "sf_category": "customer"},
        {"tag": "_Order.ID", "sf_category": "customer", "is_loop": True, "star_type": "int"}, {"tag": "_Order.Status", "sf_category": "customer", "is_loop": True},
        {"tag": "_Order.Customer_ID", "sf_category": "customer", "is_loop": True, "fk_table": "Customer", "fk_column": "ID"},
    ])
    customer = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 3 + 100).alias("ID"), F.col("c_name").alias("Name"))
    frames, own = frames_of(customer, "c_custkey", "customer", "ID", "Name")
    frames, own = frames.withColumn("tag_prefix", F.lit("_Customer")), own.withColumn("category", F.lit("_Customer"))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("ID"), (F.col("o_custkey") * 3 + 100).alias("Customer_ID"), F.col("o_orderstatus").alias("Status"))
    pairs = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for i, t in enumerate(("ID", "Customer_ID", "Status"))])
    cells = orders.select(F.lit("e").alias("entry_id"), F.col("o_custkey").alias("sf_ord"), F.concat(F.lit("customer_"), "o_custkey").alias("sf_name"), F.lit("customer").alias("sf_category"), F.lit("loop").alias("kind"), F.lit(1).cast("long").alias("loop_ord"), F.lit("_Order").alias("category"), F.col("o_orderkey").alias("row_ord"), F.explode(pairs).alias("cell"))
    done, _ = normalize.normalize(own.unionByName(cells.select("*", "cell.*").drop("cell")), frames, known)
    return done.select("sf_ord", "kind", "row_ord", "tag", "value")


# dictionaries that a table gives, and listings over whole tables


def _brand_dictionary(spark, d) -> DataFrame:
    """A dictionary with a category for each brand of parts, and a tag for each of its types."""
    kinds = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("seq"), F.max("p_size").alias("size"))
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    rows = kinds.select(
        F.concat(F.lit("_"), brand, F.lit("."), F.replace("p_type", F.lit(" "), F.lit("_"))).alias("tag"), F.col("seq").cast("double").alias("seq"), F.lower(brand).alias("sf_category"), (F.col("seq") % 2 == 0).alias("is_loop"),
        F.concat(F.lit("VARCHAR("), "size", F.lit(")")).alias("data_type"), F.lit("any").alias("star_type"), (F.col("size") > 25).alias("nullable"), F.when(F.col("seq") % 5 == 0, "I").otherwise("Y").alias("public"),
        F.lit(None).cast("string").alias("default_value"), F.lit(False).alias("entry_id_flag"), F.lit(False).alias("local_id_flag"), F.lit(None).cast("string").alias("fk_table"), F.lit(None).cast("string").alias("fk_column"), F.lit(False).alias("sf_pointer"),
    )
    return dictionary.prepared(rows, {"any": ".*"})


_BRANDS = """SELECT '_' || replace(p_brand, '#', '_') AS category, '_' || replace(p_brand, '#', '_') || '.' || replace(p_type, ' ', '_') AS tag, replace(p_type, ' ', '_') AS field, CAST(min(p_partkey) AS DOUBLE) AS seq, max(p_size) AS size,
lower(replace(p_brand, '#', '_')) AS sf_category, min(p_partkey) % 2 = 0 AS is_loop, CASE WHEN min(p_partkey) % 5 = 0 THEN 'I' ELSE 'Y' END AS public FROM part GROUP BY p_brand, p_type"""


@query(f"""
WITH b AS ({_BRANDS}), s AS (SELECT *, 'VARCHAR(' || size || ')' AS kind, CASE WHEN size > 25 THEN '' ELSE 'NOT NULL' END AS n FROM b),
w AS (SELECT CAST(max(length(field)) AS INT) AS w0, CAST(max(length(kind)) AS INT) AS w1, CAST(max(length(n)) AS INT) AS w2, CAST(max(length(sf_category)) AS INT) AS w3 FROM s)
SELECT category, seq, '  ' || rpad(field, w0, ' ') || ' ' || rpad(kind, w1, ' ') || ' ' || rpad(n, w2, ' ') || '  ' || rpad(sf_category, w3, ' ') AS line FROM s, w
UNION ALL SELECT DISTINCT category, CAST(NULL AS DOUBLE), rpad(category, 30, ' ') FROM s
""")
def dictionary_listing_of_parts(spark, d):
    return dictionary.listing(_brand_dictionary(spark, d))


@query(f"WITH b AS ({_BRANDS}) SELECT category, tag, row_number() OVER (PARTITION BY category ORDER BY seq) AS place FROM b WHERE category = (SELECT min(category) FROM b) AND public <> 'I'")
def template_rows_of_parts(spark, d):
    """The loop template of the first brand."""
    known = _brand_dictionary(spark, d)
    first = known.agg(F.min("category")).first()[0]
    return dictionary.loop_template(known, first).select(F.lit(first).alias("category"), "tag", "place")


@query(f"WITH b AS ({_BRANDS}), f AS (SELECT sf_category, row_number() OVER (ORDER BY min(seq)) AS place FROM b WHERE NOT is_loop GROUP BY sf_category) SELECT b.sf_category, b.sf_category || '_1' AS sf_name, f.place, b.tag, CASE WHEN b.field = 'LARGE_BRUSHED_TIN' THEN '3.2' END AS value FROM b JOIN f ON b.sf_category = f.sf_category WHERE NOT b.is_loop AND b.public <> 'I'")
def entry_template_of_parts(spark, d):
    """A whole entry from a dictionary; some tags are given their values."""
    known = _brand_dictionary(spark, d)
    tags = [r.tag for r in known.where("tag_field = 'LARGE_BRUSHED_TIN'").select("tag").collect()]
    return dictionary.entry_template(known, "e", values={t.upper(): "3.2" for t in tags})


def _nations_with_loops(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, cells, loops): nations as saveframes, each with a loop of its suppliers."""
    frames, own = frames_of(table(spark, d, "nation"), "n_nationkey", "nation", "n_nationkey", "n_name")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey"))
    pairs = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for i, t in enumerate(("s_suppkey", "s_name"))])
    cells = supplier.select(F.lit("e").alias("entry_id"), F.col("s_nationkey").cast("long").alias("sf_ord"), F.concat(F.lit("nation_"), "s_nationkey").alias("sf_name"), F.lit("nation").alias("sf_category"), F.lit("loop").alias("kind"), F.lit(1).cast("long").alias("loop_ord"), F.lit("_Supplier").alias("category"), F.col("s_suppkey").alias("row_ord"), F.explode(pairs).alias("c")).select("*", "c.*").drop("c")
    loops = cells.select("entry_id", "sf_ord", "sf_name", "loop_ord", "category").distinct().withColumn("tags", F.array(F.lit("s_suppkey"), F.lit("s_name")))
    return frames, own.unionByName(cells), loops


@query("""
WITH l AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT CAST(-1 AS BIGINT) AS sf_ord, CAST(-1 AS BIGINT) AS loop_ord, CAST(-1 AS BIGINT) AS col_ord, 'Entry e' AS line
UNION ALL SELECT n_nationkey, -1, -1, '  Saveframe nation_' || n_nationkey || ':nation' FROM nation
UNION ALL SELECT n_nationkey, -1, 0, '    _nation.n_nationkey' FROM nation UNION ALL SELECT n_nationkey, -1, 1, '    _nation.n_name' FROM nation
UNION ALL SELECT k, 1, -1, '    Loop _Supplier' FROM l UNION ALL SELECT k, 1, 0, '      _Supplier.s_suppkey' FROM l UNION ALL SELECT k, 1, 1, '      _Supplier.s_name' FROM l
""")
def tag_outline(spark, d):
    return listing.tag_outline(*_nations_with_loops(spark, d)).drop("entry_id")


@query("SELECT doc_id AS sf_ord, '_document.text: ' || replace(coalesce(text, 'None'), chr(10), '\\n') AS line FROM documents")
def tag_value_lines(spark, d):
    _, cells = frames_of(table(spark, d, "documents"), "doc_id", "document", "text")
    return listing.value_lines(cells).select("sf_ord", "line")


@query("""
SELECT s_suppkey AS row_ord, i AS col_ord, t AS tag, CASE i WHEN 1 THEN CAST(s_suppkey AS VARCHAR) WHEN 3 THEN s_name END AS value
FROM supplier, (VALUES (0, 'First'), (1, 's_suppkey'), (2, 'Middle'), (3, 's_name')) v(i, t)
""")
def missing_loop_tags(spark, d):
    """The dictionary's tags added to every loop, its order kept; a tag that it does not know comes last."""
    known = dictionary.from_rows(spark, [{"tag": f"_supplier.{t}", "sf_category": "nation", "is_loop": True} for t in ("First", "S_SuppKey", "Middle")] + [{"tag": "_supplier.hidden", "is_loop": True, "public": "I"}])
    _, cells, loops = _nations_with_loops(spark, d)
    filled, wider = upkeep.add_missing_loop_tags(cells, loops, known)
    same = wider.where(F.size("tags") == 4).select("entry_id", "sf_ord", "loop_ord")
    return filled.where("kind = 'loop'").join(same, ["entry_id", "sf_ord", "loop_ord"], "left_semi").select("row_ord", "col_ord", "tag", "value")


@query("SELECT s_suppkey AS row_ord, s_name AS value FROM supplier")
def loop_by_place_and_name(spark, d):
    """The loop at the first place of each saveframe is the one of its name, and its cells are those of the whole table."""
    _, cells, loops = _nations_with_loops(spark, d)
    keys = ["entry_id", "sf_ord", "loop_ord"]
    both = upkeep.loop_of_frame(loops, 0).select(*keys).join(upkeep.loop_of_frame(loops, "SUPPLIER").select(*keys), keys)
    return cells.join(both, keys, "left_semi").where("tag = 's_name'").select("row_ord", "value")


@query("""
SELECT row_number() OVER (ORDER BY m) AS n, row_number() OVER (ORDER BY m) || ': ' || m AS line
FROM (SELECT 'Dangling saveframe reference $C' || user_id || ' in _events.ref' AS m FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)) t
""")
def validation_report(spark, d):
    """Dangling references of all events as a numbered report."""
    frames = table(spark, d, "customer").where("c_nationkey < 20").select(F.lit("e").alias("entry_id"), F.col("c_custkey").alias("sf_ord"), F.concat(F.lit("C"), "c_custkey").alias("sf_name"), F.lit("c").alias("sf_category"))
    cells = table(spark, d, "events").select(F.lit("e").alias("entry_id"), F.lit(0).cast("long").alias("sf_ord"), F.lit("loop").alias("kind"), F.lit(1).cast("long").alias("loop_ord"), F.col("event_id").alias("row_ord"), F.lit("_events").alias("category"), F.lit("ref").alias("tag"), F.lit("c").alias("sf_category"), F.concat(F.lit("$C"), "user_id").alias("value"))
    loops = spark.createDataFrame([("e", 0, 1, ["ref"])], "entry_id string, sf_ord long, loop_ord long, tags array<string>")
    known = dictionary.from_rows(spark, [{"tag": "_events.ref", "sf_category": "c"}])
    return validate.validation_report(validate.validate(cells, frames, loops, known))
