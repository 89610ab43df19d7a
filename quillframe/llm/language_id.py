"""Language identification by error-correcting output codes over byte n-grams.

Each learned language has a codeword of bits. For every bit a binary classifier tells the languages with a one from those with a
zero: a linear model over hashed n-grams, whose weights are the log odds of the n-gram's share in either half. A text is decoded
to the language whose codeword has the least loss, exp(-margin) summed over bits, each weighted by how well its classifier did
on the training texts; a text whose second language comes within ``DOUBT`` of the first is flagged.

1. Training texts are counted per language and hashed n-gram, each text having the weight of its root length; counts
   combine in tasks, so a language with most of the texts costs one row a bucket and task. All training texts count.
2. Codewords: for up to ``EXHAUSTIVE`` languages every way to split them in two, once; beyond that seeded bits, of the
   candidates those with the largest least distance. Their number grows with the logarithm of the languages.
3. The driver gets one row a bucket with the counts of every bit's halves, ``BUCKETS`` rows at most, and from a second pass
   over the training texts one row a bit; the broadcast model has ``BUCKETS`` * bits weights.

N-grams are 1 to 3 bytes long, of texts whose ASCII and accented Latin letters are in lower case and whose runs of anything
but letters are one space.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is not learned from; a null id has the fold of
the empty string; without a learned language all is ``und``; with one all texts with letters get it, with score 1; equal losses go to the
language first by code point; repeated rows get equal results; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import id_and_text, materialise, text_groups
from quillframe.llm.words import mix

BITS_OF_BUCKET = 16
BUCKETS = 1 << BITS_OF_BUCKET
SIZES = (1, 2, 3)
#: Languages up to which all splits are codeword bits, and bits for more: so many a doubling.
EXHAUSTIVE, PER_DOUBLING, CANDIDATES = 5, 8, 64
#: Largest share of the least loss by which a second language makes a text ambiguous.
DOUBT = 0.1
SMOOTH, SHARPNESS = 0.5, 10.0
#: Weighted counts are kept in whole numbers of 1 / UNIT.
UNIT = 1 << 10
#: Weights are whole numbers of 1 / FIXED, so that sums do not depend on what stands beside a text.
FIXED = 1 << 20
#: Languages a task holds counts of before it passes them on.
HELD = 64
UNKNOWN = "und"


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that training leaves out: CRC-32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _letters(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))


def _is_letter(raw: np.ndarray) -> np.ndarray:
    return ((raw >= 97) & (raw <= 122)) | (raw >= 128)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[~_is_letter(_FOLD)] = 32


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some texts, laid end to end, and each text's bounds."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = _FOLD[np.frombuffer(b" " + b" ".join(parts), np.uint8)]
    late = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    raw[late] += 0x20  # accented Latin capitals
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])  # of the space before each text
    space = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[1:-1]] = True  # but each text has a space of its own at its beginning
    place = np.cumsum(keep) - keep
    raw = raw[keep].astype(np.uint64)
    first = np.append(place[offsets[:-1]], len(raw))
    n, found = len(raw), []
    code = np.zeros(n, np.uint64)
    last = np.repeat(first[1:], np.diff(first))
    for size in range(1, max(SIZES) + 1):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - size + 1] = raw[size - 1 :]
        code = code << np.uint64(8) | shifted
        if size in SIZES:
            bucket = (mix(code + np.uint64(size << 40)) >> np.uint64(64 - BITS_OF_BUCKET)).astype(np.int32)
            found.append(np.where(np.arange(n) + size <= last, bucket, -1))
    grams = np.stack(found, axis=1).ravel()
    inside = grams >= 0
    upto = np.concatenate([[0], np.cumsum(inside)])
    return grams[inside], upto[first * len(SIZES)]


def count_grams(training: DataFrame) -> DataFrame:
    """(lang, bucket, n): weighted n-gram counts of (lang, text), in units of 1 / UNIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for start, texts in text_groups(batch):
                grams, bounds = ngrams(texts)
                sizes = np.diff(bounds)
                weight = np.maximum(np.rint(UNIT / np.sqrt(np.maximum(sizes, 1))), 1).astype(np.int64)
                langs = batch.column(0).slice(start, len(texts)).to_pylist()
                for lang in dict.fromkeys(langs):
                    own = np.array([x == lang for x in langs])
                    if lang not in held and len(held) >= HELD:
                        yield from flush()
                    some = np.repeat(own, sizes)
                    # whole numbers below 2**53: exact as doubles
                    n = np.bincount(grams[some], np.repeat(weight[own], sizes[own]), BUCKETS).astype(np.int64)
                    held[lang] = held[lang] + n if lang in held else n
        yield from flush()

    return training.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one a language; every bit has both, if there are two languages."""
    if n < 2:
        return np.ones((n, 1), np.int64)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))  # the last language is always on the minus side
        return np.where(splits[None, :] >> np.arange(n)[:, None] & 1, 1, -1)
    bits, best, found = PER_DOUBLING * int(np.ceil(np.log2(n))), -1, None
    for seed in range(CANDIDATES):
        rng = np.random.default_rng(seed)
        words = np.stack([rng.permutation(np.where(np.arange(n) % 2, 1, -1)) for _ in range(bits)], axis=1)
        agree = words @ words.T
        np.fill_diagonal(agree, -bits)
        if bits - agree.max() > best:
            best, found = bits - agree.max(), words
    return found


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their codewords, the weights of every n-gram bucket for every bit, and the bits' weights."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """The mean log odds of each text's n-grams, for each bit."""
        grams, bounds = ngrams(texts)
        sizes = np.diff(bounds)
        sums = np.zeros((len(texts), self.weights.shape[1]), np.int64)
        some = np.flatnonzero(sizes)
        for b in range(self.weights.shape[1] if len(some) else 0):
            sums[some, b] = np.add.reduceat(self.weights[:, b][grams], bounds[some])
        return sums / (FIXED * np.maximum(sizes, 1))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and ambiguity of each row of margins."""
        if len(self.languages) < 2:
            return np.zeros(len(margins), np.int64), np.ones(len(margins)), np.zeros(len(margins), bool)
        f = np.clip(SHARPNESS * margins, -30, 30)
        loss = np.stack([(np.exp(-f * word) * self.trust).sum(axis=1) for word in self.words], axis=1)
        best = loss.argmin(axis=1)
        rows = np.arange(len(loss))
        least = loss[rows, best]
        share = least[:, None] / loss  # 1 for the best
        second = np.partition(loss, 1, axis=1)[:, 1]
        return best, np.round(np.clip(1 / share.sum(axis=1), 0, 1), 9), second <= (1 + DOUBT) * least


def train_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """A model of all documents with a language and a letter."""
    training = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & _letters("text"))
    counts = materialise(count_grams(training), "language_grams")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    words = codewords(len(languages))
    bits = words.shape[1]
    if len(languages) < 2:
        return LanguageModel(languages, words, np.zeros((BUCKETS, bits), np.int64), np.ones(bits))
    spark = docs.sparkSession
    sides = spark.createDataFrame([(lang, words[i].tolist()) for i, lang in enumerate(languages)], "lang string, word array<int>")
    halves = [F.sum(F.when(F.col("word")[b] > 0, F.col("n"))).alias(f"b{b}") for b in range(bits)]
    rows = counts.join(F.broadcast(sides), "lang").groupBy("bucket").agg(F.sum("n").alias("n"), *halves).toArrow()
    bucket, total = rows.column("bucket").to_numpy(), np.zeros(BUCKETS)
    total[bucket] = rows.column("n").to_numpy()
    weights = np.zeros((BUCKETS, bits), np.int64, order="F")
    for b in range(bits):
        one = np.zeros(BUCKETS)
        one[bucket] = rows.column(f"b{b}").fill_null(0).to_numpy()
        other = total - one
        smooth = SMOOTH * UNIT
        share = lambda x: np.log((x + smooth) / (x.sum() + smooth * BUCKETS))
        weights[:, b] = np.where(total > 0, np.rint(FIXED * (share(one) - share(other))), 0)
    model = LanguageModel(languages, words, weights, np.ones(bits))
    return LanguageModel(languages, words, weights, _trust(training, model))


def _trust(training: DataFrame, model: LanguageModel) -> np.ndarray:
    """The bits' weights: log odds of their being right on training texts, each language having the same say."""
    shared = training.sparkSession.sparkContext.broadcast(model)
    bits, n = model.words.shape[1], len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {lang: i for i, lang in enumerate(model.languages)}
        right, seen = np.zeros((n, bits), np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for start, texts in text_groups(batch):
                lang = np.array([place[x] for x in batch.column(0).slice(start, len(texts)).to_pylist()], np.int64)
                np.add.at(right, lang, model.margins(texts) * model.words[lang] > 0)
                np.add.at(seen, lang, 1)
        for i in np.flatnonzero(seen):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(bits, i)), pa.array(np.arange(bits)), pa.array(right[i]), pa.array(np.full(bits, seen[i]))], names=["lang", "bit", "ok", "n"])

    by_lang = training.select("lang", "text").mapInArrow(run, "lang long, bit long, ok long, n long").groupBy("lang", "bit").agg((F.sum("ok") / F.sum("n")).alias("ok"))
    found, trust = by_lang.groupBy("bit").agg(F.avg("ok").alias("ok")).collect(), np.zeros(bits)
    for r in found:
        share = min(max(r.ok, 0.5), 0.999)
        trust[r.bit] = np.log(share / (1 - share))
    return trust / trust.sum() if trust.sum() > 0 else np.ones(bits)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous): the decoded language of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for start, texts in text_groups(batch):
                letters = np.array(batch.column(2).slice(start, len(texts))) & (len(model.languages) > 0)
                best, score, doubt = model.decode(model.margins(texts)) if len(model.languages) else (np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool))
                columns = [batch.column(0).slice(start, len(texts)), pa.array(names[np.where(letters, best, len(names) - 1)], pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(letters & doubt)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "ambiguous"])

    return id_and_text(docs, id_col, text_col).withColumn("letters", _letters("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every row of ``documents``, learned from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_languages(docs.where(~held_out()))
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
