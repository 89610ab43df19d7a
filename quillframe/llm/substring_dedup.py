"""Substring dedup by fixed-block anchors.

A run of ``WINDOW`` words that two documents share holds, wherever it starts, a whole one of the
non-overlapping ``BLOCK``-word reference blocks of either document. So blocks are indexed, every rolling
``BLOCK``-word window probes the index, and only windows around a hit need comparing. A block, like a
rolling window, is keyed by its least ``GRAM``-word hash: neighbouring probes mostly share their key,
and are sent once.

1. Keys of blocks (least document) and probes (greatest document) are combined per batch, then over the
   cluster; a key whose least block stands before its greatest probe is a hit. A Bloom filter of the
   hits, at most ``BLOOM_BITS`` long, is broadcast. Beyond its capacity it only lets more windows through.
2. Windows that contain a hit are extended to their exact ``WINDOW``-word hashes. What a batch already
   shows to start in a smaller document is covered; the first occurrences meet over the cluster.
3. The covered windows of each document are gathered and its words filtered.

A run that occurs in very many documents sends one row a task, not one a document: a task remembers runs that it has
seen in several documents.

Windows meet by 96 bits, two hashes of their words: among 10**13 windows a chance match is expected less than once in
a thousand corpora. Rows are told apart by their id and a 64-bit hash of their text.

Defined results: a null or empty text has no words; a null id counts as greater than all ids; rows with
the same id never remove each other's words; an empty table gives an empty result; other columns are
ignored by ``removed_words`` and kept by ``drop_repeats``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, text_groups
from quillframe.llm.words import Words, mix, windows

WINDOW = 50
GRAM = 10
BLOOM_BITS = 1 << 30
#: Repeated windows that a task remembers, and bytes of text that it compares at once.
REMEMBERED, GROUP = 1 << 18, 1 << 20
_LAST = (1 << 63) - 1
_OTHER = np.uint64(0x5851F42D4C957F2D)


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each position on, where all are there."""
    have, done = values, 1
    while done < width:
        step = min(done, width - done)
        have, done = np.minimum(have[: len(have) - step], have[step:]), done + step
    return have


class _Batch:
    """Rolling keys of the words of some documents: ``keys[p]`` for the block-sized window at word p, where ``whole[p]``."""

    def __init__(self, texts: list[str], window: int):
        self.words = Words(texts)
        self.block = (window + 1) // 2
        gram = min(GRAM, self.block)
        n = len(self.words.hashes)
        self.whole = self.words.inside(self.block)
        self.keys = np.zeros(n, np.uint64)
        if n >= self.block:
            least = _slide(windows(self.words.hashes, gram)[: n - gram + 1], self.block - gram + 1)
            self.keys[: len(least)] = mix(least)


def _group(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and document, and where each key begins."""
    order = np.lexsort((docs, keys))
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids (null: last) and texts; ``tag`` tells rows with one id apart by their texts."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), _tag(text_col).alias("tag"), F.col(text_col).alias("text"))


def _tag(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def _hit_keys(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, texts in text_groups(batch, limit=GROUP):
                b = _Batch(texts, window)
                doc_at = b.words.doc_of_word()
                docs = ids[start : start + len(texts)][doc_at]
                new = b.whole & np.concatenate([[True], (b.keys[1:] != b.keys[:-1]) | (doc_at[1:] != doc_at[:-1])])[: len(b.keys)]
                at = np.flatnonzero(new)
                order, first = _group(b.keys[at], docs[at])
                found = pa.array(b.keys[at][order][first].view(np.int64))
                greatest = docs[at][order][np.concatenate([first[1:], [len(order)]]) - 1] if len(order) else docs[:0]
                yield pa.RecordBatch.from_arrays([found, pa.nulls(len(first), pa.int64()), pa.array(greatest)], names=["key", "block", "probe"])
                at = np.flatnonzero(b.whole & ((np.arange(len(b.keys)) - b.words.first[doc_at]) % b.block == 0))
                order, first = _group(b.keys[at], docs[at])
                yield pa.RecordBatch.from_arrays([pa.array(b.keys[at][order][first].view(np.int64)), pa.array(docs[at][order][first]), pa.nulls(len(first), pa.int64())], names=["key", "block", "probe"])

    keys = rows.select("doc", "text").mapInArrow(run, "key long, block long, probe long")
    return keys.groupBy("key").agg(F.min("block").alias("block"), F.max("probe").alias("probe")).where("block < probe").select("key")


def _bloom(keys: DataFrame, most: int) -> np.ndarray:
    """A Bloom filter of the keys with two bits each, in at most ``most`` bits."""
    bits = 1 << 16
    n = keys.count()
    while bits < most and bits < 16 * n:
        bits *= 2
    part = min(bits, 1 << 23)
    places = keys.select(F.explode(F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))).alias("bit"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(part, bool)
        held[frame["bit"].to_numpy() % part] = True
        return pd.DataFrame({"part": [int(frame["bit"].iloc[0]) // part], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    whole = np.zeros(bits // 8, np.uint8)
    for row in places.groupBy(F.floor(F.col("bit") / part).alias("part")).applyInPandas(fill, "part long, bits binary").toLocalIterator():
        whole[row.part * part // 8 : (row.part + 1) * part // 8] = np.frombuffer(row.bits, np.uint8)
    return whole


def _in_bloom(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    most = np.uint64(len(bloom) * 8 - 1)

    def held(bit: np.ndarray) -> np.ndarray:
        return (bloom[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1

    return (held(keys & most) & held((keys >> np.uint64(32)) & most)).astype(bool)


def covered_windows(rows: DataFrame, window: int = WINDOW, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(doc, tag, starts, counts): per row of documents, runs of windows that also start in a document with a smaller id."""
    bloom = rows.sparkSession.sparkContext.broadcast(_bloom(materialise(_hit_keys(rows, window), "hit_keys"), bloom_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, seen_in = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start, texts in text_groups(batch, limit=GROUP):
                b = _Batch(texts, window)
                hit = b.whole.copy()
                hit[hit] = _in_bloom(bloom.value, b.keys[hit])
                sums = np.concatenate([[0], np.cumsum(hit)])
                n = len(hit)
                reach = np.minimum(np.arange(n) + window - b.block + 1, n)
                at = np.flatnonzero(b.words.inside(window) & (sums[reach] > sums[:n]))
                doc_at = b.words.doc_of_word()[at]
                docs, tag, hashes = ids[start : start + len(texts)][doc_at], tags[start : start + len(texts)][doc_at], windows(b.words.hashes, window)[at]
                check = windows(mix(b.words.hashes ^ _OTHER), window)[at].astype(np.uint32).view(np.int32)
                place = (at - b.words.first[doc_at]).astype(np.int32)
                order, first = _group(hashes, docs)
                ends = np.concatenate([first[1:], [len(order)]]).astype(np.int64)
                least = docs[order][first]
                later = np.zeros(len(at), bool)
                later[order] = docs[order] > np.repeat(least, ends - first)
                several = docs[order][ends - 1] > least if len(order) else np.zeros(0, bool)
                if len(seen):
                    near = np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)
                    known = seen[near] == hashes
                    later |= known & (docs > seen_in[near])
                    several &= ~known[order][first]
                if several.any() and len(seen) < REMEMBERED:
                    seen, seen_in = np.concatenate([seen, hashes[order][first][several]]), np.concatenate([seen_in, least[several]])
                    by_hash = np.argsort(seen)
                    seen, seen_in = seen[by_hash], seen_in[by_hash]
                # windows covered as far as this task knows, as runs
                known = np.flatnonzero(later)
                cut = np.flatnonzero(np.concatenate([[True], (place[known][1:] != place[known][:-1] + 1) | (doc_at[known][1:] != doc_at[known][:-1])])) if len(known) else known
                sizes = np.diff(np.concatenate([cut, [len(known)]]))
                heads = known[cut]
                rest = np.flatnonzero(~later)
                spread = mix(hashes[heads] ^ place[heads].astype(np.uint64) ^ docs[heads].astype(np.uint64))
                both = lambda x: np.concatenate([x[heads], x[rest]])  # noqa: B023, E731
                columns = [np.concatenate([spread, hashes[rest]]).view(np.int64), both(check), both(docs), both(tag), both(place), np.concatenate([sizes, np.zeros(len(rest), np.int64)]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "check", "doc", "tag", "place", "known"])

    found = rows.select("doc", "tag", "text").mapInArrow(run, "hash long, check int, doc long, tag long, place int, known int")
    least = F.min(F.when(F.col("known") == 0, F.col("doc"))).over(Window.partitionBy("hash", "check"))
    covered = found.withColumn("least", least).where("known > 0 or least < doc")
    # rows that repeat one another in id and text give the same runs
    return covered.groupBy("doc", "tag").agg(F.collect_set(F.struct(F.col("place").alias("start"), F.greatest("known", F.lit(1)).alias("count"))).alias("runs"))


def _kept(text: str | None, runs: list[dict] | None, window: int) -> tuple[int, int, str]:
    """Words of a text, how many of them are covered, and the others joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not runs:
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
    edge = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        edge[r["start"]] += 1
        edge[r["start"] + r["count"] + window - 1] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass")


def _with_runs(docs: DataFrame, covered: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), _tag(text_col).alias("tag"))
    return keyed.join(covered, ["doc", "tag"], "left").select("row", "runs")


def removed_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document's words without those that earlier documents have in a run of ``window``."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = _with_runs(slim, covered_windows(_rows(slim, "doc_id", "text"), window), "doc_id", "text").select("row.doc_id", "row.text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_kept(t, r, window) for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns; texts that lose words keep the others, joined by one space."""
    joined = _with_runs(docs, covered_windows(_rows(docs, id_col, text_col), window), id_col, text_col)

    @F.arrow_udf("string")
    def kept(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([_kept(t, r, window)[2] if r else t for t, r in zip(texts.to_pylist(), runs.to_pylist(), strict=True)], pa.string())

    found = joined.select("row", kept(F.col("row")[text_col], F.col("runs")).alias("text"))
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-word runs of every row of ``documents``, and a digest of the words kept."""
    found = removed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS least FROM runs GROUP BY s),
hits AS (SELECT r.doc_id, r.i FROM runs r JOIN firsts f ON r.s = f.s WHERE f.least < r.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hits, (SELECT unnest(range(0, 50)) AS k) ks),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0),
marked AS (SELECT t.doc_id, t.p, t.word, g.p IS NOT NULL AS lost FROM words t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (lost) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT lost) AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN sums ON w.doc_id = sums.doc_id
"""
