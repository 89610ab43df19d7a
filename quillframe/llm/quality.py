"""Quality rules: gradient-boosted trees over document statistics.

``document_stats`` counts words, symbols, repeated lines and repeated word runs of whole texts, in numpy
over Arrow batches, without a shuffle. ``fit_quality`` trains boosted trees on labelled documents;
``assess_quality`` and ``keep_quality`` score with the trees flattened to node arrays.

Training reads at most ``max_rows`` labelled documents (those with the smallest hash of their id): the
documented bound on what reaches the driver. Statistics and verdicts cover every document.

Defined results: a null or empty text has no words and fails the base rules; a null id is kept as it
is; repeated rows each get their own verdict; an empty table gives an empty result; without labels of
both kinds no tree is grown and the base rules alone decide. Columns beyond id and text are ignored by
``assess_quality`` and passed through unchanged by ``keep_quality``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import id_and_text, text_groups
from quillframe.llm.words import Words, mix

#: Model inputs and the direction in which each may move the score: -1 falling, 1 rising, 0 free.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "bang_share": -1, "pipe_share": -1, "distinct_share": 1, "words_per_line": 0,
}
MIN_WORDS = 50
MAX_LABELLED = 20_000

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\x0b\x0c\r")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BANG = np.zeros(256, bool)
_BANG[[33]] = True
_PIPE = np.zeros(256, bool)
_PIPE[[124]] = True
_LEAD = np.ones(256, bool)
_LEAD[128:192] = False  # UTF-8 continuation bytes begin no code point
_BLANK = " \t\n\x0b\x0c\r"


def _counts(words: Words, mask: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask[words.raw])])
    return sums[words.offsets[1:] - 1] - sums[words.offsets[:-1]]


def text_stats(texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts and the model's feature matrix of some texts."""
    words = Words(texts)
    n_words = np.diff(words.first)
    doc = words.doc_of_word()
    in_doc = mix(doc.astype(np.uint64) + np.uint64(0x51ED270B))

    repeat = np.zeros(len(words.hashes) + 3, np.int64)
    runs, inside = words.windows(3)
    if inside.any():
        at = np.flatnonzero(inside)
        _, inverse, counts = np.unique(runs[at] ^ in_doc[at], return_inverse=True, return_counts=True)
        twice = at[counts[inverse] > 1]
        for k in range(3):
            repeat[twice + k] = 1
    sums = np.concatenate([[0], np.cumsum(repeat[: len(words.hashes)])])
    n_repeat = sums[words.first[1:]] - sums[words.first[:-1]]

    distinct = np.zeros(len(texts), np.int64)
    if len(words.hashes):
        _, at = np.unique(words.hashes ^ in_doc, return_index=True)
        distinct = np.bincount(doc[at], minlength=len(texts))
    n_lines = np.zeros(len(texts), np.int64)
    n_dup = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = [x for x in text.split("\n") if x.strip(_BLANK)]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
    chars = _counts(words, _LEAD & ~_SPACES)
    base = {"n_words": n_words, "word_chars": chars, "n_symbols": _counts(words, _SYMBOLS), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}
    w, c, lines = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    features = np.column_stack([
        np.log1p(n_words), chars / w, base["n_symbols"] / c, n_dup / lines, n_repeat / w, _counts(words, _UPPER) / c,
        _counts(words, _DIGIT) / c, _counts(words, _BANG) / w, _counts(words, _PIPE) / w, distinct / w, n_words / lines,
    ])
    return base, features


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    """Fewer than 50 words, or more than half of them in repeated three-word runs."""
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


@dataclass(frozen=True)
class Trees:
    """Boosted trees as node arrays: node k of tree t goes to ``left``/``right`` by ``feature`` <= ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for each row of features."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def good(self, x: np.ndarray) -> np.ndarray:
        """The verdict: the margin reaches the threshold."""
        return self.margin(x) >= self.threshold


def grow_trees(x: np.ndarray, y: np.ndarray, directions: list[int], n_trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 48, min_rows: int = 8, ridge: float = 1.0, missed: float = 0.002) -> Trees:
    """Logistic boosting over histogram bins with monotonic constraints.

    A split on a constrained feature must order its two sides' values, and both sides inherit the middle
    as a bound, so no deeper split undoes the order. The verdict's threshold is the lower of even odds and
    the level that ``missed`` of the good training documents stay under: clean documents are kept.
    """
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots: list[int] = []

    def add(value: float) -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("cut", np.inf), ("left", k), ("right", k), ("value", value)):
            nodes[name].append(v)
        return k

    def finish(bias: float, threshold: float) -> Trees:
        kinds = {"feature": np.int64, "cut": np.float64, "left": np.int64, "right": np.int64, "value": np.float64}
        return Trees(*(np.array(nodes[k], kinds[k]) for k in kinds), np.array(roots, np.int64), depth, bias, threshold)

    if len(y) == 0 or y.min() == y.max():
        return finish(0.0, 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)

    def split(node: int, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, low: float, high: float, left_depth: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best, choice = 1e-6, None
        if left_depth:
            for j, edges in enumerate(cuts):
                if not len(edges):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, grad[rows], len(edges) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], len(edges) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(edges) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(g - gl) / (h - hl + ridge), low, high)
                gain = -(2 * gl * vl + (hl + ridge) * vl**2 + 2 * (g - gl) * vr + (h - hl + ridge) * vr**2) - g * g / (h + ridge)
                ok = (nl >= min_rows) & (len(rows) - nl >= min_rows) & ((vr - vl) * directions[j] >= 0)
                if ok.any() and (k := int(np.argmax(np.where(ok, gain, -np.inf)))) >= 0 and gain[k] > best:
                    best, choice = gain[k], (j, k, vl[k], vr[k])
        if choice is None:
            return
        j, k, vl, vr = choice
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[directions[j]]
        nodes["feature"][node], nodes["cut"][node] = j, cuts[j][k]
        side = binned[rows, j] <= k
        for name, v, chosen, bound in (("left", vl, rows[side], bounds[0]), ("right", vr, rows[~side], bounds[1])):
            child = add(rate * v)
            nodes[name][node] = child
            split(child, chosen, grad, hess, *bound, left_depth - 1)

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        root = add(0.0)
        split(root, np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, depth)
        if nodes["left"][root] == root:
            nodes["value"][root] = 0.0
        roots.append(root)
        margin += _one(nodes, root, depth, x)
    return finish(bias, float(min(0.0, np.quantile(margin[y == 1], missed))))


def _one(nodes: dict[str, list], root: int, depth: int, x: np.ndarray) -> np.ndarray:
    feature, cut, left, right, value = (np.array(nodes[k][root:]) for k in ("feature", "cut", "left", "right", "value"))
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        at = np.where(x[rows, feature[at]] <= cut[at], left[at] - root, right[at] - root)
    return value[at]


_STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and the feature vector of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_groups(batch):
                base, features = text_stats(texts)
                vectors = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * features.shape[1], features.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *(pa.array(v, pa.int64()) for v in base.values()), vectors], names=["doc_id", *base, "features"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _STATS + ", features array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Trees:
    """Trees fitted to ``labels`` (doc_id, quality 0/1); at most ``max_rows`` labelled documents reach the driver."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # of several rows with one id, the one with the least text hash is learnt from
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    rows = document_stats(texts).join(F.broadcast(chosen), "doc_id").select("features", "quality", "n_words", "n_repeat_words").orderBy("doc_id").collect()
    if not rows:
        return grow_trees(np.zeros((0, len(FEATURES))), np.zeros(0), list(FEATURES.values()))
    x, y = np.array([r.features for r in rows], float), np.array([float(r.quality > 0) for r in rows])
    judged = ~base_failed({k: np.array([r[k] for r in rows]) for k in ("n_words", "n_repeat_words")})
    return grow_trees(x[judged], y[judged], list(FEATURES.values()))


def assess_quality(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base verdict, the trees' margin and the verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_groups(batch):
                base, features = text_stats(texts)
                failed, margin = base_failed(base), trees.margin(features)
                columns = {"doc_id": batch.column(0).slice(start, len(texts)), **base, "base_failed": failed, "kept": ~failed & (margin >= trees.threshold), "margin": margin}
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _STATS + ", base_failed boolean, kept boolean, margin double")


def keep_quality(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns. Only the text goes to Python, and only the verdict comes back."""

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        found = []
        for _, group in text_groups(pa.RecordBatch.from_arrays([texts], names=["text"])):
            base, features = text_stats(group)
            found.append(~base_failed(base) & trees.good(features))
        return pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.where(good(F.col(text_col)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every row of ``documents``, by trees fitted to ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assess_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
