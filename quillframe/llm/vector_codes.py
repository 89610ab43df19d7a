"""Vector codes: product quantisation by a delta-maintained Lloyd iteration in whole numbers.

Vectors become integers and are cut into equal parts; each part position has a codebook, which starts as that part of
the vectors with the smallest ids. A round assigns every part to its nearest entry and moves each entry to the floor of
the mean of its parts.

1. The assignments of a round are written beside those of the round before (``before``, ``code``), to the shared store.
2. Running counts and sums of every entry are kept from round to round. Only parts whose assignment changed add to
   them: minus what they gave their old entry, plus what they give the new one. Tasks add these up first, so at most
   two rows an entry leave a task, and rows without a change do not even reach Python.
3. The codebooks follow from the running sums; they and the sums are the only tables on the driver, and have a fixed
   size (parts * entries * width).

All arithmetic is exact, so neither the order of rows nor a lost executor changes a digit. A vector or label that a
third of the rows share costs one row a task as any other.

Defined results: rows whose vector is null, or has null or non-finite components, are dropped. Vectors of fewer
components than the longest, or of no multiple of ``parts``, are padded by zeros. Rows with one id are ordered by their
vectors; null ids come last; repeated rows count once each. With fewer rows than entries the codebooks are shorter; an empty
table gives an empty result. Integers beyond +-2**24 are set to that bound. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest integer component: squared distances of such components stay exact in 64 bits.
BOUND = 1 << 24
#: Whole numbers below this are exact in doubles.
_EXACT = 1 << 53
#: Rows whose distances to all entries are held at once.
_ROWS = 4096
#: Labels whose sums may be broadcast, and rows of one label that one task can bear.
SMALL, MANY = 100_000, 1_000_000


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, index and component: an integer array of parts * entries * width."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Digest of all components as decimal text, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every part (the first of equals), and the squared distance to it; rows * parts each."""
        rows, (parts, _, width) = len(vectors), self.entries.shape
        cut = vectors.reshape(rows, parts, width)
        code, distance = np.zeros((rows, parts), np.uint8), np.zeros((rows, parts), np.int64)
        largest = max(int(np.abs(self.entries).max(initial=0)), int(np.abs(vectors).max(initial=0)))
        kind = np.float64 if 4 * width * largest**2 < _EXACT else np.int64
        for p in range(parts):
            book = self.entries[p].astype(kind)
            length = (book * book).sum(axis=1)
            for i in range(0, rows, _ROWS):
                x = cut[i : i + _ROWS, p].astype(kind)
                to = length - 2 * (x @ book.T)
                nearest = to.argmin(axis=1)
                code[i : i + _ROWS, p] = nearest
                distance[i : i + _ROWS, p] = to[np.arange(len(x)), nearest] + (x * x).sum(axis=1)
        return code, distance

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (rows * parts) stand for."""
        return self.entries[np.arange(self.entries.shape[0]), codes].reshape(len(codes), -1)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): the rows with a whole vector, its components as floors of their ``scale``-fold."""
    odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(F.col(vector_col).isNotNull() & ~odd)
    bounded = lambda x: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), F.floor(x.cast("double") * scale).cast("double"))).cast("int")
    label = F.col(label_col) if label_col else F.lit(None)
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.transform(vector_col, bounded).alias("v"))


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """Codebooks from the vectors with the smallest ids; as many rows as entries reach the driver."""
    longest = vectors.agg(F.max(F.size("v")).alias("n")).first().n or 0
    width = max(1, -(-longest // parts))
    first = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    whole = np.zeros((len(first), parts * width), np.int64)
    for i, row in enumerate(first):
        whole[i, : len(row.v)] = row.v
    return Codebooks(whole.reshape(len(first), parts, width).swapaxes(0, 1).copy())


def _array(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers, short ones padded by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    """A binary column of codes as rows of parts."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def assign_parts(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The rows with their nearest entries in ``code``, one byte a part, and what ``code`` was in ``before``."""
    parts, _, width = books.entries.shape
    old = F.col("code") if "code" in vectors.columns else F.lit(None).cast("binary")
    rows = vectors.select("vec_id", "label", "v", old.alias("before"))
    kinds = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, v array<int>, before binary, code binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, _ = books.assign(_array(batch.column(2), parts * width))
            new = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=["vec_id", "label", "v", "before", "code"])

    return rows.mapInArrow(run, kinds)


def changed_sums(state: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, n, sums): what the last assignment changes in the counts and sums of the entries.

    Only parts with another entry than before count, with a minus for the old and a plus for the new.
    """
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            cut = _array(batch.column(0), parts * width).reshape(-1, parts, width)
            new, known = _codes(batch.column(2), parts), np.array(batch.column(1).is_valid())
            old = np.full(new.shape, -1)
            if known.any():
                old[known] = _codes(batch.column(1).drop_null(), parts)
            row, part = np.nonzero(old != new)
            for entry, sign in ((old[row, part], -1), (new[row, part], 1)):
                some = entry >= 0
                at = part[some] * entries + entry[some]
                np.add.at(n, at, sign)
                np.add.at(sums, at, sign * cut[row[some], part[some]])
        found = np.flatnonzero((n != 0) | (sums != 0).any(axis=1))
        if len(found):
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * width, sums[found].ravel())
            yield pa.RecordBatch.from_arrays([pa.array((found // entries).astype(np.int32)), pa.array((found % entries).astype(np.int32)), pa.array(n[found]), lists], names=["part", "entry", "n", "sums"])

    moved = state.where(~F.col("before").eqNullSafe(F.col("code"))).select("v", "before", "code")
    by_task = moved.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
    return by_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).select("part", "entry", "n", F.array(*[f"s{k}" for k in range(width)]).alias("sums"))


def train_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The last written state of the rows (vec_id, label, v, before, code), and the codebooks that follow from it."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: from 1 to 256 entries")
    books = first_codebooks(vectors, parts, entries)
    _, found, width = books.entries.shape
    if not found:
        return vectors, books
    n, sums = np.zeros((parts, found), np.int64), np.zeros((parts, found, width), np.int64)
    state = vectors
    for k in range(rounds):
        state = materialise(assign_parts(state, books), f"vector_codes_{k + 1}")
        for r in changed_sums(state, books).collect():  # a row an entry at most
            n[r.part, r.entry] += r.n
            sums[r.part, r.entry] += np.array(r.sums)
        used = n > 0
        books = Codebooks(np.where(used[..., None], sums // np.maximum(n, 1)[..., None], books.entries))
    return state, books


def encode_vectors(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): codes as two hex digits a part, and the squared distances summed over parts."""
    parts, _, width = books.entries.shape
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, distance = books.assign(_array(batch.column(2), parts * width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(distance.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decode_vectors(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the vectors that (vec_id, code) stand for, on the scale of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _codes(pa.array([bytes.fromhex(c) for c in batch.column(1).to_pylist()], pa.binary()), books.entries.shape[0])
            vectors = books.decode(code) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(len(code) + 1, dtype=np.int32) * vectors.shape[1], vectors.ravel())], names=["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def _label_key() -> Column:
    """A label as text that equals itself, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over the rows of one label.

    The sums are broadcast while there are at most ``SMALL`` labels; beyond that only those of labels with over ``MANY`` rows,
    fewer than one in ``MANY`` rows, and the others are joined by shuffle.
    """
    keyed = coded.withColumn("label_key", _label_key())
    sums = materialise(keyed.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("label_rows")), "vector_label_errors")
    if sums.count() <= SMALL:
        joined = keyed.join(F.broadcast(sums), "label_key")
    else:
        large = F.broadcast(sums.where(F.col("label_rows") > MANY))
        rest = keyed.join(large.select("label_key"), "label_key", "left_anti").join(sums.where(F.col("label_rows") <= MANY), "label_key")
        joined = keyed.join(large, "label_key").unionByName(rest)
    return joined.select(*coded.columns, "label_error")


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: its code, its error, the error of its label, and the digest of the codebooks."""
    state, books = train_codes(integer_vectors(rows, id_col, vector_col, label_col), parts, entries, rounds)
    coded = materialise(encode_vectors(state, books), "vector_codes_final")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every row of ``embeddings``."""
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql_round(k: int) -> str:
    """One assignment to the entries of ``book{k}``."""
    return f"""near{k} AS (
  SELECT x.r, x.p, arg_min(b.e, list_value(d, b.e)) AS e, min(d) AS d
  FROM cells x JOIN book{k} b ON x.p = b.p, LATERAL (SELECT CAST(list_sum(list_transform(range(1, {{width}} + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS BIGINT) AS d) GROUP BY x.r, x.p)"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT r, p, v[4 * p + 1 : 4 * p + 4] AS v FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, CAST(r - 1 AS BIGINT) AS e, v FROM cells WHERE r <= 64),
{_sql_round(0)},
book1 AS (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book0 b LEFT JOIN (
    SELECT n.p, n.e, [CAST(floor(sum(x.v[1]) / count(*)) AS BIGINT), CAST(floor(sum(x.v[2]) / count(*)) AS BIGINT), CAST(floor(sum(x.v[3]) / count(*)) AS BIGINT), CAST(floor(sum(x.v[4]) / count(*)) AS BIGINT)] AS v
    FROM near0 n JOIN cells x ON n.r = x.r AND n.p = x.p GROUP BY n.p, n.e) m ON b.p = m.p AND b.e = m.e),
{_sql_round(1)},
book2 AS (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book1 b LEFT JOIN (
    SELECT n.p, n.e, [CAST(floor(sum(x.v[1]) / count(*)) AS BIGINT), CAST(floor(sum(x.v[2]) / count(*)) AS BIGINT), CAST(floor(sum(x.v[3]) / count(*)) AS BIGINT), CAST(floor(sum(x.v[4]) / count(*)) AS BIGINT)] AS v
    FROM near1 n JOIN cells x ON n.r = x.r AND n.p = x.p GROUP BY n.p, n.e) m ON b.p = m.p AND b.e = m.e),
{_sql_round(2)},
codes AS (SELECT r, string_agg(lower(printf('%02x', CAST(e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM kept k JOIN codes c ON k.r = c.r, digest d
""".replace("{width}", "4")
