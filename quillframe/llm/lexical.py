"""Ranked lexical search: block-max WAND with blocks of variable size, over shards of documents.

``build_index`` reads the texts twice: once to count documents and terms, once to write the index. A shard is a run of documents
of about ``SHARD`` terms that one task has met, so no posting is shuffled and a term that every document holds is spread as the
documents are. For each of a shard's terms the index has the postings (document's number in the shard, impact) and their
blocks. An impact is the part of a score that does not depend on the query. A dynamic program chooses the blocks' ends: it
minimises, over all ways to cut a list, the sum over postings of (largest impact of the block - own impact), plus a
fixed cost a block.

``search`` takes the items in blocks of bounded size. Only the postings of their terms are dealt out, by shard. In a
shard every document's bound is the sum of the block maxima that cover it; documents are scored in full in the order of their
bounds until the best bound left is below the item's k-th score so far, and blocks without such a document are
skipped. The k-th score is carried from shard to shard of a task. Nothing is approximate.

Terms are told apart by a 64-bit hash of their bytes. What the driver holds of an item block is bounded by ``ITEM_BYTES`` of text.

Defined results: a null text, or one without a term, is no document and no item; rows of documents that repeat one another
rank one by one, as do items; null ids of documents come after all others of an equal score; empty tables give an empty
result; other columns are ignored. A text longer than a shard is a shard of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import id_and_text, materialise, text_groups
from quillframe.llm.words import Words

#: Maximal runs of ASCII letters, digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAPS = np.zeros(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _GAPS[_a : _b + 1] = True
#: Terms of a shard, about.
SHARD = 1 << 21
#: Blocks end at every GRAIN-th posting only, and have at most GRAIN * REACH postings; COST mean impacts a block.
GRAIN, REACH, COST = 4, 64, 4
#: Bytes of item texts searched for at once.
ITEM_BYTES = 4 << 20
_INDEX = "shard long, term long, df int, docs binary, impacts binary, ends binary, tops binary, ids array<long>"


@dataclass(frozen=True)
class Index:
    """A written index: one row a shard and term, one row a shard without a term for its documents' ids."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def document_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length factor m of documents with n terms."""
    return 75 + 25 * n * n_docs // max(n_terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence of a query's term gives, before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def term_weight(df: int, n_docs: int) -> int:
    """A term's weight, from the documents that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def cut_blocks(impacts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of the blocks of many posting lists laid end to end; ``starts`` has each list's first place and the total.

    All lists advance together, one grain a step. ``back`` has, for each grain, how many grains the best last block
    that ends there has.
    """
    sizes = np.diff(starts)
    grains = -(-sizes // GRAIN)
    offsets = np.concatenate([[0], np.cumsum(grains)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], grains)
    tops = np.maximum.reduceat(impacts, np.repeat(starts[:-1], grains) + place * GRAIN) if len(impacts) else np.zeros(0, np.int64)
    cost = COST * np.add.reduceat(impacts, starts[:-1]) / sizes if len(sizes) else np.zeros(0)
    back = np.ones(offsets[-1], np.uint8)
    lists = np.argsort(-grains, kind="stable")
    lists = lists[grains[lists] > 1]
    left = grains[lists]
    run, past = np.zeros((len(lists), REACH)), np.full((len(lists), REACH), np.inf)
    past[:, 0] = 0
    counts = GRAIN * np.arange(1, REACH + 1)
    for j in range(1, int(left[0]) + 1 if len(left) else 1):
        n = int(np.searchsorted(-left, -j, side="right"))  # lists with at least j grains
        own = lists[:n]
        top = tops[offsets[own] + j - 1][:, None]
        run[:n, 1:] = np.maximum(run[:n, :-1], top)
        run[:n, :1] = top
        short = np.maximum(j * GRAIN - sizes[own], 0)[:, None]  # the last grain may have fewer postings
        total = past[:n] + run[:n] * (counts - short)
        best = total.argmin(axis=1)
        back[offsets[own] + j - 1] = best + 1
        past[:n, 1:] = past[:n, :-1]
        past[:n, 0] = total[np.arange(n), best] + cost[own]
    ends, at, own = [], grains.copy(), np.arange(len(sizes))
    while len(own):
        ends.append(np.minimum(starts[own] + at[own] * GRAIN, starts[own + 1]))
        at[own] -= back[offsets[own] + at[own] - 1]
        own = own[at[own] > 0]
    return np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers as binary values."""
    data = np.ascontiguousarray(values, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(data)])


class _Shard:
    """Documents gathered for one shard."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.lengths: list[np.ndarray] = []
        self.docs = self.terms = 0

    def add(self, ids: pa.Array, texts: list[str]) -> None:
        words = Words(texts, lower=True, gaps=_GAPS)
        doc = words.doc_of_word()
        order = np.lexsort((words.hashes, doc))
        hashes, doc = words.hashes[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.found.append((hashes[at], (doc[at] + self.docs).astype(np.int32), np.diff(at, append=len(doc)).astype(np.int32)))
        self.ids.append(ids)
        self.lengths.append(np.diff(words.first))
        self.docs += len(texts)
        self.terms += len(doc)

    def rows(self, shard: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        """The shard's index."""
        term, doc, tf = (np.concatenate(x) for x in zip(*self.found, strict=True))
        m = document_factor(np.concatenate(self.lengths).astype(np.int64), n_docs, n_terms)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order].astype(np.int64)
        impacts = impact(tf, m[doc])
        starts = np.append(np.flatnonzero(np.diff(term, prepend=term[:1] ^ np.uint64(1)) != 0), len(term))
        ends = cut_blocks(impacts, starts)
        tops = np.maximum.reduceat(impacts, np.concatenate([[0], ends[:-1]])) if len(ends) else impacts
        blocks = np.searchsorted(ends, starts, side="right")
        n, names = len(starts) - 1, [c.split()[0] for c in _INDEX.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64())]
        ids = pa.concat_arrays(self.ids)
        head = [pa.array([shard]), *[pa.nulls(1, k) for k in kinds[1:7]], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        yield pa.RecordBatch.from_arrays(head, names=names)
        within = ends - np.repeat(starts[:-1], np.diff(blocks))
        columns = [pa.array(np.full(n, shard)), pa.array(term[starts[:-1]].view(np.int64)), pa.array(np.diff(starts).astype(np.int32)), _binary(doc, starts), _binary(impacts, starts), _binary(within, blocks), _binary(tops, blocks), pa.nulls(n, kinds[7])]
        whole = pa.RecordBatch.from_arrays(columns, names=names)
        for i in range(0, n, 1 << 14):
            yield whole.slice(i, 1 << 14)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD) -> Index:
    """The index of all documents, written to the shared store."""
    from pyspark import TaskContext

    texts = id_and_text(docs, id_col, text_col)
    found = texts.select(F.regexp_count("text", F.lit(TERM)).cast("long").alias("n")).where("n > 0").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    n_docs, n_terms = found.n_docs, found.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, shard = TaskContext.get().partitionId() << 32, 0, _Shard()
        for batch in batches:
            for start, group in text_groups(batch):
                shard.add(batch.column(0).slice(start, len(group)), group)
                if shard.terms >= shard_terms:
                    yield from shard.rows(first + made, n_docs, n_terms)
                    made, shard = made + 1, _Shard()
        if shard.terms:
            yield from shard.rows(first + made, n_docs, n_terms)

    return Index(materialise(texts.mapInArrow(run, _INDEX), "lexical_index"), n_docs, n_terms)


def item_terms(items: DataFrame, text_col: str = "text") -> DataFrame:
    """(item, term, n): how often each item, named by its number, holds a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_groups(batch):
                words = Words(texts, lower=True, gaps=_GAPS)
                items = batch.column(0).slice(start, len(texts)).to_numpy()[words.doc_of_word()]
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(words.hashes.view(np.int64))], names=["item", "term"])

    return items.select("item", F.col(text_col).alias("text")).mapInArrow(run, "item long, term long").groupBy("item", "term").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class _Queries:
    """Items as runs of (term's place in ``terms``, weight)."""

    terms: np.ndarray
    items: np.ndarray
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    k: int


class _Best:
    """The k best documents of each item so far."""

    def __init__(self, queries: _Queries):
        n = len(queries.items)
        self.k, self.level = queries.k, np.zeros(n, np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * n

    def add(self, item: int, scores: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        """Take in scored documents; ``level`` becomes the k-th score."""
        some = scores > 0
        scores, absent, ids = (np.concatenate([old, new[some]]) for old, new in zip(self.found[item], (scores, absent, ids), strict=True))
        order = np.lexsort((ids, absent, -scores))[: self.k]
        self.found[item] = scores[order], absent[order], ids[order]
        if len(order) == self.k:
            self.level[item] = scores[order[-1]]

    def rows(self, queries: _Queries) -> pa.RecordBatch:
        """(item, doc_id, score) of all."""
        scores, absent, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        items = np.repeat(queries.items, [len(f[0]) for f in self.found])
        return pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids, mask=absent), pa.array(scores)], names=["item", "doc_id", "score"])


class _Postings:
    """One shard's postings of the terms in question, decoded as far as they are needed."""

    def __init__(self, ids: pa.Array):
        self.absent = np.array(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, term: int, docs: bytes, impacts: bytes, ends: bytes, tops: bytes) -> None:
        doc, end = np.frombuffer(docs, np.int32), np.frombuffer(ends, np.int32)
        self.lists[term] = doc, np.frombuffer(impacts, np.int32)
        begin = np.concatenate([[0], end[:-1]])
        self.blocks[term] = doc[begin], doc[end - 1] + 1, np.frombuffer(tops, np.int32).astype(np.int64)

    def bounds(self, terms: list[tuple[int, int]]) -> np.ndarray:
        """For each document the sum of the block maxima that cover it."""
        n = len(self.ids) + 1
        begin, end, top = zip(*[self.blocks[t] for t, _ in terms], strict=True)
        value = np.concatenate([x * w for x, (_, w) in zip(top, terms, strict=True)])
        steps = np.zeros(n, np.int64)
        np.add.at(steps, np.concatenate(begin), value)
        np.add.at(steps, np.concatenate(end), -value)
        return np.cumsum(steps)[:-1]

    def scores(self, terms: list[tuple[int, int]], docs: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, in ascending order of number."""
        total = np.zeros(len(docs), np.int64)
        for t, w in terms:
            doc, impacts = self.lists[t]
            at = np.minimum(np.searchsorted(doc, docs), len(doc) - 1)
            total += np.where(doc[at] == docs, impacts[at].astype(np.int64) * w, 0)
        return total

    def search(self, queries: _Queries, best: _Best) -> None:
        """Bring every item's best documents up to date with this shard."""
        for item in range(len(queries.items)):
            part = slice(queries.first[item], queries.first[item + 1])
            terms = [(t, w) for t, w in zip(queries.term[part].tolist(), queries.weight[part].tolist(), strict=True) if w and t in self.lists]
            if not terms:
                continue
            bounds = self.bounds(terms)
            docs = np.flatnonzero(bounds >= max(1, best.level[item]))
            docs, step = docs[np.argsort(-bounds[docs], kind="stable")], 2 * queries.k
            while len(docs) and bounds[docs[0]] >= best.level[item]:
                now, docs = np.sort(docs[:step]), docs[step:]
                best.add(item, self.scores(terms, now), self.absent[now], self.ids[now])
                step *= 2


def _search_block(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): for the items of (item, term, n), each task's k best documents."""
    wanted = materialise(terms, "lexical_items")
    df = index.rows.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    asked = wanted.toArrow().sort_by([("item", "ascending"), ("term", "ascending")])
    known, held = df.column("term").to_numpy(), df.column("df").to_numpy()
    order = np.argsort(known)
    known, weights = known[order], np.array([term_weight(int(d), index.n_docs) for d in held[order]], np.int64)
    item, term, n = (asked.column(c).to_numpy() for c in ("item", "term", "n"))
    there = np.isin(term, known)
    item, term, n = item[there], term[there], n[there]
    place = np.searchsorted(known, term)
    names, first = np.unique(item, return_index=True)
    queries = _Queries(known, names, np.append(first, len(item)), place, weights[place] * n, k)
    spark = index.rows.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    lists = index.rows.join(F.broadcast(spark.createDataFrame(pa.table({"term": known}))), "term", "left_semi").select(index.rows.columns)
    dealt = lists.unionByName(index.rows.where("term is null")).repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best, shard = _Best(asked), None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (1, 3, 4, 5, 6)]
            for i, (term, docs, impacts, ends, tops) in enumerate(zip(*columns, strict=True)):
                if term is None:
                    if shard is not None:
                        shard.search(asked, best)
                    shard = _Postings(batch.column(7).slice(i, 1).flatten())
                else:
                    shard.add(int(np.searchsorted(asked.terms, term)), docs, impacts, ends, tops)
        if shard is not None:
            shard.search(asked, best)
        if len(asked.items):
            yield best.rows(asked)

    return materialise(dealt.mapInArrow(run, "item long, doc_id long, score long"), "lexical_found")


def search(index: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents, equal scores by ascending id."""
    rows = materialise(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text")), "lexical_queries")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = -(-total // item_bytes) or 1, None
    for b in range(blocks):
        part = _search_block(index, item_terms(rows.where(F.pmod(F.hash("item"), F.lit(blocks)) == b)), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = rows.select("item", "item_id")
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each item of ``benchmark``."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = rf"""
WITH doc_terms AS (
  SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
item_terms AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
asked AS (SELECT i, item_id, term, count(*) AS q FROM item_terms GROUP BY i, item_id, term),
lengths AS (SELECT d, count(*) AS n FROM doc_terms GROUP BY d),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
factors AS (SELECT d, 75 + (25 * n * n_docs) // n_terms AS m FROM lengths, total),
tfs AS (SELECT d, doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM asked) GROUP BY d, doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, total GROUP BY term, n_docs),
scored AS (
  SELECT a.i, a.item_id, t.d, t.doc_id, CAST(sum(a.q * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * f.m))) AS BIGINT) AS score
  FROM asked a JOIN tfs t ON a.term = t.term JOIN weights w ON a.term = w.term JOIN factors f ON t.d = f.d GROUP BY a.i, a.item_id, t.d, t.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
