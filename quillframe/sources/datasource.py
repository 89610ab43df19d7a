"""Tag/loop files as a Spark data source: planned byte ranges in, whole entries as files out by commit.

    register(spark)
    spark.read.format("tagloop").load(folder)                       # (file, seg, last, text)
    entries.write.format("tagloop").option("as", "json").mode("append").save(folder)   # of (entry_id, text)

Reading: a plain file is planned in ranges of ``split`` bytes, small files share a task up to as many bytes, and each range yields
segments of about ``segment`` bytes. A range begins with the first line at or after its first byte that does not begin with
a semicolon, and ends where the next one begins; so ranges are found without reading what lies before. Gzip and zlib
files are told by their first bytes, whatever their names, and streamed by one task. Names that begin with a dot or an underscore
are left out.

Writing: a task writes one file an entry into a folder of its own under ``_temporary``; the commit renames one folder a task, and
the abort removes what was staged. A task that fails, or an attempt that is not the one committed, leaves nothing.

Paths are those of ``pyarrow.fs``: local ones, or URIs of the stores it knows. ``star.read_files`` reads all stores that Spark reads.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType

from quillframe.sources import star

NAME = "tagloop"
SCHEMA = "file string, seg int, last boolean, text string"
SEGMENT, SPLIT = 4 << 20, 64 << 20
#: Endings of written files by what they hold.
FORMATS = {"text": ".str", "json": ".json"}
_BLOCK, _HEAD = 1 << 16, 512
_TEMPORARY = "_temporary"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def compression(head: bytes) -> str | None:
    """What a file's first bytes (``_HEAD`` of them, or all it has) tell: gzip, zlib or nothing."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if len(head) > 1 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0:
        stream = zlib.decompressobj()
        try:
            stream.decompress(head)
        except zlib.error:
            return None
        return "zlib" if stream.eof or len(head) >= _HEAD else None
    return None


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip (of any number of members) or zlib stream; one that ends early is an error."""
    stream = zlib.decompressobj(47)
    for piece in pieces:
        while piece:
            if stream.eof:
                stream = zlib.decompressobj(47)
            yield stream.decompress(piece)
            piece = stream.unused_data
    if not stream.eof:
        raise ValueError("a compressed file ends early")


def _cut_after(data: bytes, at: int) -> int:
    """The first place at or after ``at`` where a line begins that begins with no semicolon; -1 without one."""
    at = max(at, 1)
    while (end := data.find(b"\n", at - 1)) >= 0:
        if end + 1 >= len(data):
            return -1
        if data[end + 1] != 0x3B:
            return end + 1
        at = end + 2
    return -1


def _segments(pieces: Iterator[bytes], size: int) -> Iterator[tuple[bytes, bool]]:
    """A stream in segments of at least ``size`` bytes, but the last, and whether each is the last."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while len(held) > size and (cut := _cut_after(held, size)) > 0:
            yield bytes(held[:cut]), False
            del held[:cut]
    yield bytes(held), True


@dataclass
class Part(InputPartition):
    """What a task reads: (file, range, first byte, end) each; a compressed file has the range -1."""

    pieces: list[tuple[str, int, int, int]]


class Reader(DataSourceReader):
    """Plans ranges over the files of a folder and reads segments."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.segment, self.split = int(options.get("segment", SEGMENT)), int(options.get("split", SPLIT))
        if not 1 <= self.segment <= self.split:
            raise ValueError("a segment has one byte at least, and no more than a split")
        #: Numbers of segments that a range may use: each but its last has ``segment`` bytes.
        self.numbers = self.split // self.segment + 2

    def partitions(self) -> list[Part]:
        store, path = _store(self.path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        parts, held, size = [], [], 0
        for file in sorted((f for f in files if f.type == fs.FileType.File and not self._hidden(f.path[len(path) :])), key=lambda f: f.path):
            # whether a file is compressed is only known once a task opens it: its first range then reads all of it
            for number, start in enumerate(range(0, max(file.size, 1), self.split)):
                end = min(start + self.split, file.size)
                if held and size + end - start > self.split:
                    parts.append(Part(held))
                    held, size = [], 0
                held.append((file.path, number, start, file.size))
                size += end - start
        return parts + ([Part(held)] if held else [])

    @staticmethod
    def _hidden(path: str) -> bool:
        return any(x[:1] in (".", "_") for x in path.split("/"))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for path, number, start, size in part.pieces:
            with store.open_input_file(path) as file:
                for seg, text, last in self._read(file, number, start, size):
                    yield pa.RecordBatch.from_pydict({"file": [path], "seg": pa.array([seg], pa.int32()), "last": [last], "text": [text.decode("utf-8", "replace")]})

    def _read(self, file: pa.NativeFile, number: int, start: int, size: int) -> Iterator[tuple[int, bytes, bool]]:
        packed = compression(file.read_at(min(size, _HEAD), 0)) is not None
        if packed:
            if number == 0:
                file.seek(0)
                for i, (text, last) in enumerate(_segments(inflated(iter(lambda: file.read(_BLOCK), b"")), self.segment)):
                    yield i, text, last
            return
        begin = self._line(file, start, size) if start else 0
        end = self._line(file, start + self.split, size) if start + self.split < size else size
        at, i = begin, 0
        while at < end or size == 0 and i == 0:
            cut = min(self._line(file, at + self.segment, size) if at + self.segment < end else end, end)
            yield number * self.numbers + i, file.read_at(cut - at, at) if cut > at else b"", cut == size
            at, i = cut, i + 1
            if size == 0:
                return

    @staticmethod
    def _line(file: pa.NativeFile, at: int, size: int) -> int:
        """The first cut at or after a byte; the file's size without one."""
        begin, held = at - 1, b""
        while begin + len(held) < size:
            held += file.read_at(min(_BLOCK, size - begin - len(held)), begin + len(held))
            if (cut := _cut_after(held, 1)) > 0:
                return begin + cut
        return size


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, and the number of its files."""

    folder: str
    files: int


class Writer(DataSourceWriter):
    """Stages one file an entry, and commits one folder a task."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        kind = options.get("as", "text")
        if kind not in FORMATS:
            raise ValueError(f"{kind!r} is no format of entries: {', '.join(FORMATS)}")
        self.ending = FORMATS[kind]

    def _staged(self, path: str) -> str:
        return f"{path}/{_TEMPORARY}/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        store, path = _store(self.path)
        folder, names = f"{self._staged(path)}/{uuid.uuid4().hex}", set()
        try:
            for row in iterator:
                if row[0] is None or row[1] is None:
                    raise ValueError("an entry to be written needs an id and a text")
                name = quote(row[0], safe=" ") + self.ending
                if name in names:
                    raise ValueError(f"there are two entries {row[0]}")
                if not names:
                    store.create_dir(folder)
                names.add(name)
                with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(row[1].encode())
        except BaseException:
            if names:
                store.delete_dir(folder)
            raise
        return Written(folder, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path)):
                if old.base_name != _TEMPORARY:
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        for n, message in enumerate(m for m in messages if m is not None and m.files):
            store.move(message.folder, f"{path}/part-{n:05d}-{self.job}")
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(self._staged(path)).type == fs.FileType.Directory:
            store.delete_dir(self._staged(path))
        top = f"{path}/{_TEMPORARY}"
        if store.get_file_info(top).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(top)):
            store.delete_dir(top)


class TagLoopSource(DataSource):
    """The data source ``tagloop``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        kinds = [f.dataType.simpleString() for f in schema.fields]
        if kinds != ["string", "string"]:
            raise ValueError("entries are written from (entry_id, text), both text")
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the data source known to a session."""
    spark.dataSource.register(TagLoopSource)


def read_segments(spark: SparkSession, path: str, segment: int = SEGMENT, split: int = SPLIT) -> DataFrame:
    """The files under a path as segments (file, seg, last, text)."""
    register(spark)
    read = spark.read.format(NAME).option("segment", segment).option("split", split).load(path)
    return read.withColumn("text", star.repaired(F.col("text")))


def read_large_files(spark: SparkSession, path: str, segment: int = SEGMENT, split: int = SPLIT) -> star.StarTables:
    """The files under a path, however large, plain, gzip or zlib, as tables."""
    return star.parse_segments(read_segments(spark, path, segment, split))


def write_entries(entries: DataFrame, path: str, kind: str = "text", mode: str = "append", id_col: str = "entry_id", text_col: str = "text") -> None:
    """One file an entry, as text or JSON; all of them or none."""
    if kind not in FORMATS:
        raise ValueError(f"{kind!r} is no format of entries: {', '.join(FORMATS)}")
    register(entries.sparkSession)
    entries.select(F.col(id_col).cast("string").alias("entry_id"), F.col(text_col).alias("text")).write.format(NAME).option("as", kind).mode(mode).save(path)


@F.arrow_udf(StringType())
def inflate(data: pa.Array) -> pa.Array:
    """The text of a binary column whose values are gzip, zlib or plain; null stays."""
    whole = lambda x: (b"".join(inflated(iter([x]))) if compression(x) else x).decode("utf-8", "replace")
    return pa.array([None if x is None else whole(x) for x in data.to_pylist()], pa.string())


@F.arrow_udf(BinaryType())
def deflate(text: pa.Array) -> pa.Array:
    """A text column as zlib bytes; null stays."""
    return pa.array([None if x is None else zlib.compress(x.encode()) for x in text.to_pylist()], pa.binary())
