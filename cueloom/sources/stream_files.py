"""Large binary streams as sources whose partitions are byte ranges: transport streams, program streams, presentation graphics.

A partition finds the first record that begins in its range, looking at a little of what is before it too, and reads every
record that begins there, the last one beyond the end of the range. A record begins where its mark stands and where, by the records' own sizes, a chain of further
marks follows; so bytes within a record that look like a mark are no record, and junk before, between and behind
records is skipped, wherever a file is cut into ranges. A task holds a few megabytes of a file, however large that is.

``spark.dataSource.register(StreamFiles)``, or ``read_stream``, which numbers the records of a file too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Marks in a row that make a chain, if the file does not end before.
CHAIN = 6
#: Bytes of a file read at once, and of a range where the option says nothing.
CHUNK, RANGE = 1 << 20, 64 << 20
#: Rows of a batch, and bytes after which a batch ends.
ROWS, BATCH = 4096, 4 << 20
#: Kinds of segments of presentation graphics, and the bytes of a transport packet.
SEGMENTS, PACKET = (0x14, 0x15, 0x16, 0x17, 0x80), 188

#: What is known of a record from its first bytes: its size; None if it is none, 0 if more bytes are needed.
Sized = Callable[[bytes, int], int | None]


def ts_size(data: bytes, at: int) -> int | None:
    return PACKET if data[at] == 0x47 else None


def ps_size(data: bytes, at: int) -> int | None:
    if data[at : at + 3] != b"\0\0\1":
        return None if at + 3 <= len(data) or not b"\0\0\1".startswith(data[at:]) else 0
    if at + 4 > len(data):
        return 0
    kind = data[at + 3]
    if kind == 0xB9:
        return 4
    if kind < 0xB9:
        return None
    if kind == 0xBA:
        # the first form of a pack header has no stuffing
        if at + 14 > len(data):
            return 0
        return 14 + (data[at + 13] & 7) if data[at + 4] >> 6 == 1 else 12
    return 6 + int.from_bytes(data[at + 4 : at + 6], "big") if at + 6 <= len(data) else 0


def pgs_size(data: bytes, at: int) -> int | None:
    if data[at : at + 2] != b"PG":
        return None if at + 2 <= len(data) or data[at] != 0x50 else 0
    if at + 13 > len(data):
        return 0
    return 13 + int.from_bytes(data[at + 11 : at + 13], "big") if data[at + 10] in SEGMENTS else None


@dataclass(frozen=True)
class Kind:
    size: Sized
    #: Bytes that every record begins with, and the least and the most that it has.
    mark: bytes
    least: int
    most: int
    #: Whether a record that the end of the file cuts is a row.
    cut: bool
    schema: str
    fields: Callable[[bytes], tuple]


_PG = lambda d: (int.from_bytes(d[2:6], "big"), int.from_bytes(d[6:10], "big"), d[10], d[13:])
KINDS = {
    "ts": Kind(ts_size, b"\x47", PACKET, PACKET, False, "data binary", lambda d: (d,)),
    "ps": Kind(ps_size, b"\0\0\1", 4, 6 + 65535, True, "kind int, data binary", lambda d: (d[3], d)),
    "pgs": Kind(pgs_size, b"PG", 13, 13 + 65535, True, "pts long, dts long, type int, body binary", _PG),
}


class _Window:
    """Some bytes of a file, from a place on, that move forward."""

    def __init__(self, file: pa.NativeFile, at: int, size: int) -> None:
        self.file, self.size, self.base, self.data = file, size, at, b""
        file.seek(at)

    def reach(self, end: int) -> bool:
        """Reads on to a place; whether there are bytes up to it."""
        while self.base + len(self.data) < min(end, self.size):
            more = self.file.read(max(CHUNK, end - self.base - len(self.data)))
            if not more:
                self.size = self.base + len(self.data)
                break
            self.data += more
        return end <= self.size

    def forget(self, at: int) -> None:
        """Lets go of what is before a place, now and then."""
        if at - self.base > CHUNK:
            self.data, self.base = self.data[at - self.base :], at


def _chained(window: _Window, kind: Kind, at: int) -> bool:
    """Whether CHAIN records follow each other from a place on, or all up to the end of the file."""
    for n in range(CHAIN):
        window.reach(at + 16)
        if at >= window.size:
            return n > 0 and (kind.cut or n > 1 or at == window.size)
        size = kind.size(window.data, at - window.base)
        if size == 0:  # the file ends within the first bytes of a record
            return n > 0
        if size is None:
            return False
        at += size
    return True


def _next(window: _Window, kind: Kind, at: int, end: int) -> int:
    """The first place from at on, before end, where a chain begins; end if there is none."""
    while at < end:
        window.forget(at)
        window.reach(at + CHUNK // 2)
        found = window.data.find(kind.mark, at - window.base, min(len(window.data), end - window.base + len(kind.mark) - 1))
        if found < 0:
            at = max(at + 1, min(end, window.base + len(window.data) - len(kind.mark) + 1))
            continue
        at = window.base + found
        if at < end and _chained(window, kind, at):
            return at
        at += 1
    return end


def records(file: pa.NativeFile, size: int, kind: Kind, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the records of a file that begin from start on and before end."""
    # a chain that begins before the range says more than the few records that may be left behind its head
    before = max(0, start - CHAIN * kind.most)
    window = _Window(file, before, size)
    at = _next(window, kind, before, min(end, size))
    while at < min(end, size):
        window.forget(at)
        window.reach(at + 16)
        n = kind.size(window.data, at - window.base)
        if not n:
            # junk, or the first bytes of a record that the file does not go on with
            at = _next(window, kind, at + 1, min(end, size)) if n is None else min(end, size)
            continue
        if not window.reach(at + n) and not kind.cut:
            return
        if at >= start:
            yield at, window.data[at - window.base : at - window.base + n]
        at += n


@dataclass
class Range(InputPartition):
    uri: str
    name: str
    size: int
    start: int
    end: int


def _files(path: str, pattern: str) -> list[tuple[str, str, int]]:
    """Path for pyarrow, name, and size of each file below a path that the pattern fits."""
    import fnmatch

    system, root = fs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    found = system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    authority = path.split("://")[1].split("/")[0] if scheme and scheme != "file://" else ""
    hidden = lambda f: any(p[0] in "._" for p in f.path.removeprefix(root).split("/") if p)
    kept = sorted((f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not hidden(f)), key=lambda f: f.path)
    # the name that Spark's own sources give to the same file
    uri = lambda p: f"{scheme or 'file://'}{authority}{p}"
    return [(uri(f.path), uri(f.path) if scheme and scheme != "file://" else f"file:{f.path}", f.size) for f in kept]


class StreamFiles(DataSource):
    """Options: path, kind (ts, ps, pgs), pathGlobFilter, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "stream_files"

    def _kind(self) -> Kind:
        name = self.options.get("kind", "")
        if name not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}, not {name!r}")
        return KINDS[name]

    def schema(self) -> str:
        return f"path string, start long, pos long, {self._kind().schema}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options.get("kind", ""), self.options["path"], self.options.get("pathglobfilter", "*"), int(self.options.get("rangebytes", RANGE)), schema)


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str, pattern: str, size: int, schema: StructType) -> None:
        if size < 1:
            raise ValueError("rangeBytes is 1 at least")
        self.kind, self.path, self.pattern, self.range, self.names = kind, path, pattern, size, schema.names

    def partitions(self) -> list[InputPartition]:
        return [Range(uri, name, size, a, min(size, a + self.range)) for uri, name, size in _files(self.path, self.pattern) for a in range(0, size, self.range)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind = KINDS[self.kind]
        kinds = [pa.string(), pa.int64(), pa.int64(), *({"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}[f.split(" ")[-1]] for f in kind.schema.split(", "))]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=self.names)

        system, path = fs.FileSystem.from_uri(partition.uri)
        rows, held = [], 0
        with system.open_input_file(path) as file:
            for at, data in records(file, partition.size, kind, partition.start, partition.end):
                rows.append((partition.name, partition.start, at, *kind.fields(data)))
                held += len(data)
                if len(rows) >= ROWS or held >= BATCH:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


def read_stream(spark: SparkSession, path: str, kind: str, pattern: str = "*", range_bytes: int = RANGE, number: str = "pkt_no") -> DataFrame:
    """file_id, the number of each record in its file from 1, pos and the columns of its kind.

    Numbers come from counts of ranges, summed up over a file, and windows within a range, so no file is gathered in a task.
    """
    spark.dataSource.register(StreamFiles)
    rows = spark.read.format("stream_files").option("kind", kind).option("pathGlobFilter", pattern).option("rangeBytes", str(range_bytes)).load(path)
    rows = rows.withColumn("file_id", F.xxhash64("path"))
    counts = rows.groupBy("file_id", "start").agg(F.count("*").alias("n"))
    before = counts.select("file_id", "start", (F.sum("n").over(Window.partitionBy("file_id").orderBy("start")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("file_id", "start").orderBy("pos"))
    numbered = rows.withColumn("in_range", within).join(before, ["file_id", "start"])
    rest = [f.split(" ")[0] for f in KINDS[kind].schema.split(", ")]
    return numbered.select("file_id", (F.col("before") + F.col("in_range")).cast("int").alias(number), "pos", *rest)


def read_ts(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE) -> DataFrame:
    """The columns of ts_packets(), numbered from 0."""
    from cueloom.operators.binary_streams import ts_fields

    rows = read_stream(spark, path, "ts", pattern, range_bytes)
    return ts_fields(rows.select("file_id", (F.col("pkt_no") - 1).alias("pkt_no"), "data"))


def read_ps(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE) -> DataFrame:
    """The columns of ps_packets()."""
    return read_stream(spark, path, "ps", pattern, range_bytes)


def read_pgs(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE) -> DataFrame:
    """The columns of pgs_segments()."""
    return read_stream(spark, path, "pgs", pattern, range_bytes, "seg_no")
