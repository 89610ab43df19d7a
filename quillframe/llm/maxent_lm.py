"""Hashed maximum-entropy language model with a class-factored softmax.

The vocabulary is a tree of nested classes: an inner node has ``BRANCH`` outcomes, of which ``OWN`` are leaves
and the others classes of their own, so frequent words have short paths. A word's probability is the product of
the softmaxes on its path, times its add-one unigram share among the words of its leaf. Frequent words have
leaves of their own; all others, known or not, fall into the deepest leaves by their hash. The tree's depth and
the feature table's rows follow the number of words counted.

At each node the features are the word before, the word two places before (a skip) and both together; the deeper
the node, the fewer. A feature and its node are hashed to a row of ``BRANCH`` weights.

1. Words are counted, combined in tasks and then over the cluster; the nodes' biases are the unigram shares.
2. Each training pass goes over all training texts. A task takes the shared weights, follows the gradient of the
   likelihood in small steps (AdaGrad over rows) and sends what it changed, weighted by the squared gradients it
   saw; the changes are averaged over the cluster, in groups of at most ``FAN_IN`` tasks.
3. Texts are scored in numpy batches that gather only the rows of their own contexts.

The broadcast tables are bounded by parameters: ``ROWS`` of weights and the counts of about ``KNOWN`` frequent words.
Other words' counts are joined by shuffle, so the vocabulary may be of any size, and no count depends on ``KNOWN``.

Defined results: a null or empty text is its end token alone; a null id counts as empty text for the fold;
repeated rows are scored one by one; an empty table gives an empty result; with no training documents every
word is unknown; other columns are ignored. How rows are dealt to tasks decides the order of the gradient steps, and
so the last digits of ``score``; all other columns depend on the texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import id_and_text, materialise, text_groups
from quillframe.llm.words import Words, mix

BRANCH, OWN = 16, 4
KNOWN = 1 << 19
#: Most rows of the table of weights; words of the vocabulary to a leaf, at most, before the tree grows a layer.
ROWS, CROWD = 1 << 18, 64
#: Feature kinds (0: the word before, 1: the one before that, 2: both) at each layer; deeper layers have the last.
KINDS = ((0, 1, 2), (0, 1, 2), (0, 2), (0,))
RATE, START, STEP = 0.3, 1.0, 4096
PASSES, FAN_IN = 1, 64
#: Tokens of a training task, at least: each task sends what it changed in the whole table.
TASK_TOKENS = 1 << 21
PENDING = 1_500_000
_CLASSES = BRANCH - OWN
_END = np.uint64(0xE4D00000E4D1)
_PIECE = 1 << 12
_SALT, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_COLUMNS = np.arange(BRANCH)
_ONES = np.ones(BRANCH, np.float32)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that training leaves out: CRC-32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, an end after each text's words, and the texts' bounds."""
    words = Words(texts, lower=True)
    return np.insert(words.hashes, words.first[1:], _END), words.first + np.arange(len(words.first))


def _add_up(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum at each."""
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(sums), len(key)).astype(np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): the training words' hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            word, n = _add_up(*map(list, zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for _, group in text_groups(batch):
                held.append(np.unique(_tokens(group)[0], return_counts=True))
                if sum(len(h[0]) for h in held) > PENDING:
                    held = [_add_up(*map(list, zip(*held, strict=True)))]
                    if len(held[0][0]) > PENDING // 2:
                        yield flush()
                        held = []
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Tree:
    """Nested classes of some depth. Nodes of a layer are numbered so that a node's class k is node + k * (nodes of the layer)."""

    depth: int

    @classmethod
    def of(cls, types: int) -> Tree:
        """The shallowest tree whose deepest leaves are not too crowded."""
        depth = 3
        while BRANCH * _CLASSES ** (depth - 1) * CROWD < types:
            depth += 1
        return cls(depth)

    @cached_property
    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Layer, node and outcome of each leaf, the shortest paths first."""
        parts = []
        for layer in range(self.depth):
            nodes = _CLASSES**layer
            place = np.arange(nodes * (OWN if layer < self.depth - 1 else BRANCH))
            parts.append((np.full(len(place), layer), place % nodes, place // nodes))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    @cached_property
    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Node and outcome of each leaf's path at each layer (meaningless below the leaf)."""
        layer, node, outcome = self.leaves
        nodes = np.stack([node % _CLASSES**k for k in range(self.depth)])
        outcomes = np.stack([np.where(layer == k, outcome, OWN + node // _CLASSES**k % _CLASSES) for k in range(self.depth)])
        return nodes, outcomes

    @property
    def size(self) -> int:
        """Number of leaves."""
        return len(self.leaves[0])

    def hashed(self, words: np.ndarray) -> np.ndarray:
        """The deepest-layer leaf of each word, by its hash."""
        deepest = BRANCH * _CLASSES ** (self.depth - 1)
        return (mix(words) % np.uint64(deepest)).astype(np.int64) + self.size - deepest

    def biases(self, leaf_n: np.ndarray) -> list[np.ndarray]:
        """Logarithms of the outcomes' shares at the nodes of each layer."""
        found, (nodes, outcomes) = [], self.paths
        for k in range(self.depth):
            below = self.leaves[0] >= k
            n = np.bincount(nodes[k, below] * BRANCH + outcomes[k, below], leaf_n[below], _CLASSES**k * BRANCH).reshape(-1, BRANCH) + 0.5
            found.append(np.log(n / n.sum(1, keepdims=True)).astype(np.float32))
        return found


@dataclass(frozen=True)
class Model:
    """What scoring needs."""

    tree: Tree
    known: np.ndarray  # hashes of the frequent words, sorted, with their counts and leaves
    known_n: np.ndarray
    known_leaf: np.ndarray
    n_tokens: int
    n_types: int
    biases: list[np.ndarray]
    leaf_log: np.ndarray  # logarithm of each leaf's sum of counts plus one, and one for unknown words
    weights: np.ndarray

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and training count of each word; the count is -1 where the table does not tell."""
        leaf, n = self.tree.hashed(words), np.full(len(words), -1)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
            hit = self.known[at] == words
            leaf, n = np.where(hit, self.known_leaf[at], leaf), np.where(hit, self.known_n[at], n)
        return leaf, n

    @property
    def whole_log(self) -> float:
        """log10 of the add-one denominator."""
        return float(np.log10(self.n_tokens + self.n_types + 1))


def _contexts(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Hash of each feature kind at every token, from the words before it in its text."""
    n, starts = len(tokens), np.repeat(bounds[:-1], np.diff(bounds))
    before = []
    for k in (1, 2):
        at = np.arange(n) - k
        before.append(np.where(at >= starts, tokens[np.maximum(at, 0)], np.uint64(7)))
    return [mix(before[0] + np.uint64(1)), mix(before[1] + np.uint64(2)), mix(before[0] * np.uint64(3) + before[1])]


def _walk(model: Model, tokens: np.ndarray, leaf: np.ndarray, bounds: np.ndarray, weights: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the probability of each token's leaf. With ``squares``, ``weights`` follow the gradient on the way."""
    contexts, found = _contexts(tokens, bounds), np.zeros(len(tokens))
    nodes, outcomes = model.tree.paths
    layer_of, flat, shift = model.tree.leaves[0], weights.reshape(-1), np.uint64(64 - int(len(weights)).bit_length() + 1)
    for a in range(0, len(tokens), STEP):
        part = slice(a, a + STEP)
        leaves, here = leaf[part], [c[part] for c in contexts]
        at, reach = np.arange(len(leaves)), layer_of[leaf[part]]
        for layer in range(model.tree.depth):
            at = at[reach[at] >= layer] if layer else at
            node, outcome = nodes[layer, leaves[at]], outcomes[layer, leaves[at]]
            z = np.take(model.biases[layer], node, axis=0, mode="clip")
            salt = (node + (layer << 40) + 1).astype(np.uint64) * _SALT
            rows = [(((here[k][at] ^ salt) * _SPREAD) >> shift).view(np.int64) for k in KINDS[min(layer, len(KINDS) - 1)]]
            for r in rows:
                z += np.take(weights, r, axis=0, mode="clip")
            p = np.exp(z)
            sums, chosen = p @ _ONES, np.arange(len(at)) * BRANCH + outcome
            found[a + at] += z.reshape(-1)[chosen] - np.log(sums)
            if squares is not None:
                p *= (1 / sums)[:, None]
                p.reshape(-1)[chosen] -= 1
                size = np.einsum("ij,ij->i", p, p)
                for r in rows:
                    np.add.at(squares, r, size)
                    rate = -RATE / np.sqrt(np.take(squares, r, mode="clip"))
                    np.add.at(flat, (r[:, None] * BRANCH + _COLUMNS).reshape(-1), (p * rate[:, None]).reshape(-1))
    return found


def gradient_pass(texts: DataFrame, model: Model) -> Model:
    """The model after one pass over all texts (text): every task follows the gradient, and the changes are averaged."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights, squares = m.weights.copy(), np.full(len(m.weights), START, np.float32)
        for batch in batches:
            for _, group in text_groups(batch):
                tokens, bounds = _tokens(group)
                words, inverse = np.unique(tokens, return_inverse=True)
                _walk(m, tokens, m.look_up(words)[0][inverse], bounds, weights, squares)
        squares -= START
        weights -= m.weights
        weights *= squares[:, None]
        pieces = [k for k in range(0, len(squares), _PIECE) if squares[k : k + _PIECE].any()]
        sums = [squares[k : k + _PIECE].tobytes() + weights[k : k + _PIECE].tobytes() for k in pieces]
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(pieces), pa.int64()), pa.array(sums, pa.binary())], names=["piece", "part", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(frame["sums"].iloc[0], np.float32).copy()
        for more in frame["sums"].iloc[1:]:
            total += np.frombuffer(more, np.float32)
        return pd.DataFrame({"piece": frame["piece"].iloc[:1], "part": frame["part"].iloc[:1] // FAN_IN, "sums": [total.tobytes()]})

    kind = "piece long, part long, sums binary"
    tasks, found = texts.rdd.getNumPartitions(), texts.select("text").mapInArrow(run, kind)
    while tasks > 1:
        found = found.groupBy("piece", F.floor(F.col("part") / FAN_IN)).applyInPandas(lambda _, frame: add(frame), kind)
        tasks = -(-tasks // FAN_IN)
    weights = model.weights.copy()
    for row in found.toLocalIterator():
        sums = np.frombuffer(row.sums, np.float32)
        n = len(sums) // (BRANCH + 1)
        weights[row.piece : row.piece + n] += sums[n:].reshape(n, BRANCH) / np.maximum(sums[:n], 1e-9)[:, None]
    return replace(model, weights=weights)


def _frequent(counts: DataFrame) -> pd.DataFrame:
    """About ``KNOWN`` of the most frequent words, by levels of their count, the last level thinned by the words' hashes."""
    level, kept = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int"), 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if kept + row["count"] > KNOWN:
            share = int((KNOWN - kept) / row["count"] * 2**32)
            return counts.where((level > row.level) | ((level == row.level) & (F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < share))).toPandas()
        kept += row["count"]
    return counts.toPandas()


def start_model(counts: DataFrame) -> Model:
    """The model before any gradient step: the unigram shares of the counted words (word, n)."""
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("types")).first()
    n_tokens, n_types = int(whole.n or 0), int(whole.types)
    tree, rows = Tree.of(n_types), _frequent(counts).sort_values(["n", "word"], ascending=[False, True])
    words = rows["word"].to_numpy(np.int64).view(np.uint64)
    leaf = tree.hashed(words)
    leaf[: tree.size] = np.arange(min(tree.size, len(leaf)))
    order = np.argsort(words)
    model = Model(tree, words[order], rows["n"].to_numpy(np.int64)[order], leaf[order], n_tokens, n_types, [], np.zeros(0), np.zeros((1 << min(max(n_types.bit_length(), 12), ROWS.bit_length() - 1), BRANCH), np.float32))
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared.value.look_up(batch.column(0).to_numpy().view(np.uint64))[0]
            sums = np.bincount(leaves, batch.column(1).to_numpy() + 1.0, tree.size)
            held = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["leaf", "n"])

    leaf_n = np.ones(tree.size)
    for row in counts.select("word", "n").mapInArrow(run, "leaf long, n double").groupBy("leaf").agg(F.sum("n").alias("n")).toLocalIterator():
        leaf_n[row.leaf] += row.n
    return replace(model, biases=tree.biases(leaf_n), leaf_log=np.log(leaf_n))


def fit_model(docs: DataFrame, counts: DataFrame, passes: int = PASSES) -> Model:
    """The model of the training texts ``docs`` (text) with the word counts ``counts`` (word, n)."""
    model = start_model(counts)
    docs = docs.coalesce(max(1, model.n_tokens // TASK_TOKENS))
    for _ in range(passes if model.n_tokens else 0):
        model = gradient_pass(docs, model)
    return model


def score_documents(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Token counts, add-one unigram score and model score (log10) of every row of (doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row, ln10 = shared.value, TaskContext.get().partitionId() << 40, np.log(10)
        for batch in batches:
            for start, group in text_groups(batch):
                tokens, bounds = _tokens(group)
                words, inverse = np.unique(tokens, return_inverse=True)
                leaf, known = m.look_up(words)
                own = np.where(known >= 0, np.log10(np.maximum(known, 0) + 1), 0.0)
                model_log = _walk(m, tokens, leaf[inverse], bounds, m.weights) / ln10 + (own - m.leaf_log[leaf] / ln10)[inverse]
                known = known[inverse]
                spans = [np.concatenate([[0.0], np.cumsum(x)]) for x in ((own - m.whole_log)[inverse], model_log, known > 0)]
                at = np.flatnonzero(known < 0)
                lists = pa.ListArray.from_arrays(np.searchsorted(at, bounds).astype(np.int32), pa.array(tokens[at].view(np.int64)))
                n = len(group)
                columns = [batch.column(0).slice(start, n), batch.column(2).slice(start, n), pa.array(row + np.arange(n)), pa.array(np.diff(bounds)), *(pa.array(s[bounds[1:]] - s[bounds[:-1]]) for s in spans), lists]
                row += n
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "row", "n_tokens", "unigram", "found", "known", "outside"])

    scored = docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, unigram double, found double, known double, outside array<long>")
    scored = materialise(scored, "scored")
    outside = scored.select("row", F.explode("outside").alias("word")).groupBy("row", "word").count()
    told = outside.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum(F.col("count") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("count").alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("outside").join(told, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known").cast("long") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("unigram") + more).alias("base_score"), (F.col("found") + more).alias("score"),
    )


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the documents outside the held-out fold, score all."""
    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out())
    training = texts.where(~F.col("held_out"))
    counts = materialise(count_words(training), "word_counts")
    return score_documents(texts, fit_model(training, counts), counts)


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents``."""
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
