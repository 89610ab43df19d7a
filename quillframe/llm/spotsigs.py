"""SpotSigs document fingerprints, in DataFrame functions only; their near-duplicate join orders prefixes in numpy.

A signature is a common word (an anchor) with the chain of content words that follow it. A text's
fingerprint is the set of its signatures' hashes. Anchors are the corpus's most frequent short words,
counted over all documents; they and the chain length decide what is alike, so they are parameters.

``near_duplicates`` compares fingerprints within partitions by set size: sets of very different sizes
cannot reach the threshold, so each meets its own partition and the next only, through the signatures
of its prefix, and the Jaccard bound of the sizes prunes what is left before sets are compared.
``near_components`` gives every row its class of equal sets and its component of linked classes.

Defined results: a null or empty text, or one without words, has one signature for the empty text; a
text without anchors has one signature for its whole word sequence, so equal texts are always alike;
null ids come last; rows with the same id are ordered by a hash of their texts; a single document is
its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import id_and_text, materialise
from quillframe.llm.graph import connected_components

ANCHORS, ANCHOR_CHARS = 48, 5
CHAIN, REACH = 2, 8
SIMILARITY = 0.8
#: Signatures whose frequency orders prefixes; the others come before these. Any one order gives the same pairs.
FREQUENT = 100_000


def tokens(text: Column) -> Column:
    """A text's lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def common_words(docs: DataFrame, text_col: str = "text", n: int = ANCHORS, chars: int = ANCHOR_CHARS) -> list[str]:
    """The ``n`` most frequent words of at most ``chars`` letters, over all texts: the anchors."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+")).alias("word")).where(F.length("word").between(1, chars))
    return [r.word for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(n).collect()]


def with_signatures(rows: DataFrame, text_col: str, name: str, anchors: list[str], chain: int = CHAIN, reach: int = REACH) -> DataFrame:
    """Add a text column's signature hashes, distinct and sorted. A chain takes content words within ``reach`` words of its anchor.

    The words, the content words (null at anchors, so that each word is looked up once) and the raw signatures stand in
    columns of their own for a while: a lambda that held their expressions would split the text again for every word.
    """
    words, content, raw = F.col(f"{name}_words"), F.col(f"{name}_content"), F.col(f"{name}_raw")

    def at(word: Column, i: Column) -> Column:
        following = F.array_compact(F.slice(content, i + 2, F.lit(reach)))
        return F.when(word.isNull(), F.xxhash64(words[i], F.slice(following, 1, chain)))

    rows = rows.withColumn(f"{name}_words", tokens(F.col(text_col)))
    rows = rows.withColumn(f"{name}_content", F.transform(words, lambda w: F.when(~w.isin(anchors), w)))
    rows = rows.withColumn(f"{name}_raw", F.sort_array(F.array_distinct(F.array_compact(F.transform(content, at)))) if anchors else F.array().cast("array<long>"))
    return rows.withColumn(name, F.when(F.size(raw) > 0, raw).otherwise(F.array(F.xxhash64(F.lit("whole"), words)))).drop(f"{name}_words", f"{name}_content", f"{name}_raw")


def as_fingerprint(found: Column) -> Column:
    """A signature set as text: hexadecimal hashes in order."""
    return F.array_join(F.transform(found, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return (both / (F.size(a) + F.size(b) - both)).cast("double")


def beside_next(docs: DataFrame, buckets: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each row of (doc_id, text) with the columns that ``make`` adds, and next_* with those and the text of the next row in descending id.

    Rows are dealt to ``buckets`` ranges of ids, in one shuffle, and looked up within their range. The
    first row of the range below is added to each range (one row a range), so no row is left alone.
    """
    n = docs.agg(F.count("doc_id").alias("n")).first().n
    bounds = sorted({int(b) for b in docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)}) if n else []
    place = F.when(F.col("doc_id").isNull(), F.lit(-1))
    place = place.otherwise(F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0))
    rows = docs.withColumn("bucket", place.cast("int")).withColumn("tie", F.xxhash64("text"))
    rank = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "tie")
    tops = rows.groupBy("bucket").agg(F.max(rank).alias("top")).orderBy(F.desc("bucket")).collect()
    if not tops:
        heads = rows.limit(0).withColumn("head", F.lit(True))
    else:
        below = {t.bucket: tops[i - 1].bucket if i else tops[-1].bucket for i, t in enumerate(tops)}
        chosen = docs.sparkSession.createDataFrame([(t.top.doc_id, t.top.tie, below[t.bucket]) for t in tops], "top_id long, top_tie long, into int")
        heads = rows.join(F.broadcast(chosen), (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("top_id")) & (F.col("tie") == F.col("top_tie")))
        heads = heads.select("doc_id", "text", F.col("into").alias("bucket"), "tie", F.lit(True).alias("head"))
    dealt = make(rows.withColumn("head", F.lit(False)).unionByName(heads).repartition("bucket"))
    order = Window.partitionBy("bucket").orderBy("head", F.desc_nulls_last("doc_id"), F.desc("tie"))
    made = [c for c in dealt.columns if c not in ("doc_id", "bucket", "tie", "head")]
    found = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in made])
    return found.where(~F.col("head")).drop("bucket", "tie", "head")


def edited(text: Column, n: Column, following: Column) -> Column:
    """A text whose last third gave way to the first as many code points of the following text."""
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - third).cast("int")), F.substring(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, anchors: list[str], id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(doc_id, found): each document's signature set."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_signatures(rows, "text", "found", anchors, chain).select("doc_id", "found")


def compare_edits(docs: DataFrame, anchors: list[str], chain: int = CHAIN) -> DataFrame:
    """Fingerprints of each document and its edited text, and how like it the edited text and the next document are."""
    texts = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = beside_next(texts, buckets, lambda rows: with_signatures(rows, "text", "found", anchors, chain))
    n = F.length("text").cast("long")
    found = found.select("doc_id", n.alias("n_chars"), edited(F.col("text"), n, F.col("next_text")).alias("edit"), "found", "next_found")
    found = with_signatures(found, "edit", "edited_found", anchors, chain)
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edit"), 256).alias("edited_sha256"), as_fingerprint(F.col("found")).alias("fingerprint"), as_fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"), likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )


def set_class(found: Column) -> Column:
    """The name of all equal signature sets: 128 bits of hashes of the set."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), found)), 16, "0") for seed in ("class", "set")]))


def _classed(fingerprints: DataFrame) -> DataFrame:
    """Fingerprints (doc_id, found) beside the name of their class, where they do not have it yet."""
    return fingerprints if "class" in fingerprints.columns else fingerprints.select("doc_id", set_class(F.col("found")).alias("class"), "found")


def _prefixes(classes: DataFrame, similarity: float) -> DataFrame:
    """(k, n, place, signature): the first signatures of each set (k, n, found), rarest first, of which linked sets share one.

    The counts of at most ``FREQUENT`` signatures are broadcast; sets are ordered where they are, and only their prefixes leave the task.
    """
    held = classes.select(F.explode("found").alias("signature")).groupBy("signature").agg(F.count("*").alias("held"))
    top = held.where("held > 1").orderBy(F.desc("held"), "signature").limit(FREQUENT).toArrow()
    names = top["signature"].to_numpy()
    order = np.argsort(names)
    shared = classes.sparkSession.sparkContext.broadcast((names[order], top["held"].to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in batches:
            k, n, found = batch.column(0), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy()
            of = np.repeat(np.arange(len(n)), n)
            count = np.zeros(len(found), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                count = np.where(frequent[at] == found, np.minimum(counts[at], (1 << 40) - 1), 0)
            order = np.lexsort((found, (of << 40) + count))  # by set, count and signature
            place = np.arange(len(found)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
            first = np.flatnonzero(place < (n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1)[of])
            yield pa.RecordBatch.from_arrays([k.take(pa.array(of[first])), pa.array(n[of[first]]), pa.array(place[first].astype(np.int32)), pa.array(found[order[first]])], names=["k", "n", "place", "signature"])

    return classes.select("k", "n", "found").mapInArrow(run, "k long, n int, place int, signature long")


def near_duplicates(fingerprints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(class_a, class_b, a, b, likeness): pairs of classes of equal sets at or above ``similarity``, and their least ids.

    Sets are partitioned by the logarithm of their size to the base 1 / similarity: a partner is in the
    same partition or a neighbour. Within a partition sets meet through the signatures of their prefix,
    rarest first, of which linked sets share one. Signatures that only one prefix has go first; a pair is made
    only at the first signature that both prefixes share, hence once, and only where the sizes and what
    follows that place in either set leave room for the overlap. Sets are compared after that.
    """
    classes = _classed(fingerprints).groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("found").alias("found"))
    # a number stands for the class from here on: it is shorter in every shuffle
    classes = materialise(classes.withColumn("n", F.size("found")).withColumn("k", F.monotonically_increasing_id()), "signature_classes")
    places = materialise(_prefixes(classes, similarity), "prefixes")
    shared = places.groupBy("signature").count().where("count > 1").select("signature")
    kept = places.join(shared, "signature", "left_semi").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("place", "signature"))).alias("kept"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")
    kept = materialise(kept.withColumn("part", part), "shared_prefixes")
    entries = kept.select("k", "n", "part", F.col("kept.signature").alias("prefix"), F.explode("kept").alias("at")).select("k", "n", "part", "prefix", "at.place", "at.signature")
    mine, other = entries.alias("x"), entries.withColumn("part", F.explode(F.array("part", F.col("part") + 1))).alias("y")
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-9
    meet = mine.join(other, ["part", "signature"]).where("y.n < x.n or y.n = x.n and y.k < x.k").where(F.col("y.n") >= F.col("x.n") * similarity - 1e-9).where(room)
    meet = meet.where(F.array_intersect("x.prefix", "y.prefix")[0] == F.col("signature"))
    pairs = meet.select(F.least("x.k", "y.k").alias("k_a"), F.greatest("x.k", "y.k").alias("k_b"))
    sets = classes.select("k", "class", "doc_id", "found")
    both = pairs.join(sets.toDF("k_a", "class_a", "a", "found_a"), "k_a").join(sets.toDF("k_b", "class_b", "b", "found_b"), "k_b")
    both = both.withColumn("likeness", likeness(F.col("found_a"), F.col("found_b"))).where(F.col("likeness") >= similarity)
    first, pick = F.coalesce(F.col("a") <= F.col("b"), F.col("b").isNull()), lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return both.select(pick("class_a", "class_b").alias("class_a"), pick("class_b", "class_a").alias("class_b"), pick("a", "b").alias("a"), pick("b", "a").alias("b"), "likeness")


def near_components(fingerprints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class, component_id) of every row: its class of equal sets, and the least id of all rows linked to it (null: they have none)."""
    # texts are read and cut into signatures here and nowhere else, and sets are named here
    fingerprints = materialise(_classed(fingerprints.select("doc_id", "found")), "fingerprints")
    rows = fingerprints.select("doc_id", "class")
    labels = connected_components(near_duplicates(fingerprints, similarity).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    least = rows.groupBy("class").agg(F.min("doc_id").alias("least")).join(labels, F.col("class") == F.col("node"), "left")
    named = least.select("class", "least", F.coalesce("label", "class").alias("component"))
    told = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("class", "component_id")
    return rows.join(told, "class", "left").select("doc_id", "class", "component_id")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of every row of ``documents`` and of its edited text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return compare_edits(docs, common_words(docs))


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of equal fingerprints and near-duplicate component of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(fingerprint_documents(docs, common_words(docs)))
