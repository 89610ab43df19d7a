"""Byte-level BPE by overlapping chunks.

Texts longer than a chunk are cut into overlapping windows that are pre-tokenised in parallel. Where two
neighbours share a boundary inside their overlap, pre-tokenisation has resynchronised: it depends only
on where it stands, so both agree from there on. Each window then encodes its own piece, from its first
shared boundary to the next window's, and the pieces are joined in order. If an overlap holds no shared
boundary (a single pre-token longer than the overlap), the text from the last sure boundary on is
encoded in one go, so the ids are always those of the whole text. Decoding joins the ids' bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; null ids and repeated rows
are kept row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import id_and_text, text_groups
from quillframe.llm.pretokens import PRETOKENS_KEPT, _Memo

CHUNK = 1 << 16
OVERLAP = 1 << 10


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """Each rank's bytes; ranks that are not used have none."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


class Coder:
    """A worker's encoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo = _Memo(lambda p: array("I", encoding.encode_ordinary(p)).tobytes(), PRETOKENS_KEPT)

    def encode(self, text: str) -> bytes:
        """Ids of a text, each match of the pattern by itself, as little-endian 32-bit integers."""
        return self.encode_all(self.pattern.findall(text))

    def encode_all(self, pretokens: list[str]) -> bytes:
        """Ids of pre-tokens, end to end."""
        return b"".join(map(self.memo.__getitem__, pretokens))

    def bounds(self, text: str, at_end: bool) -> np.ndarray:
        """Where pre-tokens begin or end; unless the text ends here, the last match may go on and is left out."""
        ends = np.cumsum([0, *map(len, self.pattern.findall(text))])
        return ends if at_end else ends[:-1]


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    if shared.id not in _coders:
        _coders.clear()
        _coders[shared.id] = Coder(*shared.value)
    return _coders[shared.id]


def _forget_coder() -> None:
    """The worker goes on to other work, and a coder takes more memory than time to make. Tasks call this by name: what they name themselves is sent as a copy."""
    _coders.clear()


class _Shared:
    """A broadcast with a number that names it in workers."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self._broadcast = spark.sparkContext.broadcast((ranks, pattern))
        self.id = hash((len(ranks), pattern, frozenset(ranks)))

    @property
    def value(self):
        return self._broadcast.value


def _lists(blobs: list[bytes]) -> pa.Array:
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.frombuffer(b"".join(blobs), np.int32))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids) of every text."""
    shared = _Shared(docs.sparkSession, read_ranks(ranks_path), pattern)
    texts = id_and_text(docs, id_col, text_col)
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for start, group in text_groups(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(group)), _lists([coder.encode(t) for t in group])], names=["doc_id", "token_ids"])
        _forget_coder()

    short = texts.where(~long).mapInArrow(whole, "doc_id long, token_ids array<int>")
    return short.unionByName(_encode_long(texts.where(long), shared, chunk, overlap))


def _encode_long(texts: DataFrame, shared: _Shared, chunk: int, overlap: int) -> DataFrame:
    """Texts above a chunk, by windows: ``row`` names a row of the input, ``chunk`` a window of it."""
    last = F.floor((F.length("text") - 1) / chunk).cast("int")
    windows = texts.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), last.alias("last")).select(
        "doc_id", "row", "last", "text", F.explode(F.sequence(F.lit(0), "last")).alias("chunk")
    )
    windows = windows.select("doc_id", "row", "last", "chunk", F.expr(f"substring(text, chunk * {chunk} + 1, {chunk + overlap})").alias("text")).repartition("row", "chunk")

    def pretokenise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each window's row, and its boundaries in the overlaps for both neighbours, in the neighbour's positions."""
        coder = _coder(shared)
        for frame in frames:
            out = []
            for doc, row, last_chunk, c, text in frame.itertuples(index=False):
                bounds = coder.bounds(text, c == last_chunk)
                out.append((doc, row, c, "own", text, last_chunk, bounds.astype(np.int32)))
                if c > 0:
                    out.append((doc, row, c - 1, "next", None, last_chunk, (bounds[bounds <= overlap] + chunk).astype(np.int32)))
                if c < last_chunk:
                    out.append((doc, row, c + 1, "previous", None, last_chunk, (bounds[bounds >= chunk] - chunk).astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "row", "chunk", "kind", "text", "last", "bounds"])
        _forget_coder()

    def stitch(frame: pd.DataFrame) -> pd.DataFrame:
        """A window's piece between shared boundaries; an unshared start or end is marked and leaves text to be encoded later."""
        coder, parts = _coder(shared), {r.kind: r for r in frame.itertuples(index=False)}
        own = parts["own"]
        begin, end = 0, len(own.text)
        if own.chunk > 0:
            common = np.intersect1d(own.bounds, parts["previous"].bounds)
            begin = int(common[0]) if len(common) else -1
        sure = True
        if own.chunk < own.last:
            common = np.intersect1d(own.bounds, parts["next"].bounds)
            sure = len(common) > 0
            end = int(common[0]) if sure else int(own.bounds[own.bounds <= chunk][-1])
        rest = own.text if own.chunk == own.last else own.text[:chunk]
        if begin < 0:
            ids, tail = b"", ""
        else:
            cuts = own.bounds[(own.bounds >= begin) & (own.bounds <= end)]
            ids = coder.encode_all([own.text[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
            tail = "" if sure else rest[end:]
        return pd.DataFrame({"doc_id": [own.doc_id], "row": [own.row], "chunk": [own.chunk], "sure": [sure], "ids": [ids], "tail": [tail], "rest": [rest]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        """A text's pieces in order; from an unshared boundary on, the text itself."""
        coder, ids, text = _coder(shared), b"", None
        for piece in frame.sort_values("chunk").itertuples(index=False):
            if text is not None:
                text += piece.rest
                continue
            ids += piece.ids
            if not piece.sure:
                text = piece.tail
        ids += coder.encode(text) if text else b""
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1], "token_ids": [np.frombuffer(ids, np.int32)]})

    marked = windows.mapInPandas(pretokenise, "doc_id long, row long, chunk int, kind string, text string, last int, bounds array<int>")
    pieces = marked.groupBy("row", "chunk").applyInPandas(stitch, "doc_id long, row long, chunk int, sure boolean, ids binary, tail string, rest string")
    return pieces.groupBy("row").applyInPandas(join, "doc_id long, token_ids array<int>")


def decode_ids(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, content): the bytes of each row's ids, end to end."""
    shared = tokens.sparkSession.sparkContext.broadcast(token_table(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            contents = [b"".join(map(table.__getitem__, ids)) for ids in _id_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], names=["doc_id", "content"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, content binary")


def _id_rows(lists: pa.Array) -> Iterator[list[int]]:
    bounds, values = lists.offsets.to_numpy().tolist(), lists.values.to_numpy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield values[a:b].tolist()


def digests(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """Per row: the number of ids, and SHA-256 of the ids in decimal and of the bytes they decode to."""
    shared = tokens.sparkSession.sparkContext.broadcast(token_table(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.__getitem__
        decimals = [str(i) for i in range(len(shared.value))].__getitem__
        for batch in batches:
            rows = [(len(ids), hashlib.sha256(" ".join(map(decimals, ids)).encode()).hexdigest(), hashlib.sha256(b"".join(map(table, ids))).hexdigest()) for ids in _id_rows(batch.column(1))]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every row of ``documents``, decode the ids and digest both."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN), ranks)
