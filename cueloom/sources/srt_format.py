"""SubRip files as a source and a sink of Spark: ``spark.read.format("srt")`` and ``df.write.format("srt")``.

Written files have the names that the rows give them. Each task writes its files into a folder of the job's own, and
the commit moves them to their places once all tasks have ended, so a task that fails or runs twice leaves nothing
behind. A file that is there already is never replaced.
"""

from __future__ import annotations

import codecs
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cueloom.functions.bom import BOMS
from cueloom.functions.timecode import TIME_LINE
from cueloom.sources.stream_files import _files

SCHEMA = "name string, cue_no long, src_number long, start_ms long, end_ms long, text string, malformed boolean"
#: Charsets that a mark says, by the mark's bytes, the longest first.
_MARKED = sorted(((bytes.fromhex(mark), {1: "utf-8", 2: "utf-16-be", 3: "utf-16-le", 4: "utf-32-be", 5: "utf-32-le", 11: "gb18030"}.get(no)) for no, _, mark in BOMS), key=lambda x: -len(x[0]))
#: And the marks of charsets that have one.
MARKS = {name: mark for mark, name in _MARKED if name}
_TIME, _NUMBER = re.compile(TIME_LINE), re.compile(r"\s*([+-]?\d+)")
#: Bytes of files that a task reads, about.
TOGETHER = 16 << 20


def charset_of(name: str) -> str:
    """The name of a charset as Python has it; raises if there is none."""
    return codecs.lookup(name).name


def decoded(content: bytes, charset: str) -> str:
    """A file's text: a mark says its charset, else that given; without carriage returns."""
    for mark, name in _MARKED:
        if content.startswith(mark):
            return content[len(mark) :].decode(name or charset, "replace").replace("\r", "")
    return content.decode(charset, "replace").replace("\r", "")


def cues_of(text: str) -> Iterator[tuple]:
    """cue_no, src_number, start_ms, end_ms, text and malformed of each block of a SubRip file."""
    text = text.strip("\n")
    for no, block in enumerate(re.split("\n{2,}", text) if text else [], 1):
        number, line, body = (*block.split("\n", 2), "", "")[:3]
        n, m = _NUMBER.match(number), _TIME.match(line)
        if m:
            a, b = ((int(h) * 60 + int(mi)) * 60_000 + int(s) * 1000 + int(ms) for h, mi, s, ms in (m.groups()[:4], m.groups()[4:]))
        yield no, int(n[1]) if n else None, a if m else None, b if m else None, body, not m or len(m[4]) == 2


def clock(ms: int) -> str:
    sign, ms = "-" * (ms < 0), abs(ms)
    return f"{sign}{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def block(no: int, start: int, end: int, text: str) -> str:
    return f"{no}\n{clock(start)} --> {clock(end)}\n{text}{chr(10) if text else ''}\n"


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, str, int]]


@dataclass
class _Written(WriterCommitMessage):
    """Where a task's files are, by their names."""

    parts: dict[str, str] = field(default_factory=dict)


class SrtFormat(DataSource):
    """Options: path, charset (UTF-8), pathGlobFilter (*.srt), and for writing mark (false): whether the charset's mark goes in front.

    Rows to write have name, cue_no, start_ms, end_ms and text; write_srt_files() brings the rows of a file together."""

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("pathglobfilter", "*.srt"), charset_of(self.options.get("charset", "UTF-8")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files that are there are never replaced; write with mode append")
        missing = {"name", "cue_no", "start_ms", "end_ms", "text"} - set(schema.names)
        if missing:
            raise ValueError(f"rows of SubRip files need {', '.join(sorted(missing))}")
        charset = charset_of(self.options.get("charset", "UTF-8"))
        marked = self.options.get("mark", "false").lower() == "true"
        if marked and charset not in MARKS:
            raise ValueError(f"{charset} has no mark")
        return _Writer(self.options["path"], charset, MARKS[charset] if marked else b"")


class _Reader(DataSourceReader):
    def __init__(self, path: str, pattern: str, charset: str) -> None:
        self.path, self.pattern, self.charset = path, pattern, charset

    def partitions(self) -> list[InputPartition]:
        """Small files together, a task for about TOGETHER bytes."""
        out: list[_Files] = []
        held = TOGETHER
        for file in _files(self.path, self.pattern):
            if held >= TOGETHER:
                out.append(_Files([]))
                held = 0
            out[-1].files.append(file)
            held += file[2]
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for uri, name, _ in partition.files:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_stream(path) as file:
                text = decoded(file.read(), self.charset)
            for row in cues_of(text):
                yield (name.rsplit("/", 1)[-1], *row)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, charset: str, mark: bytes) -> None:
        self.path, self.charset, self.mark = path, charset, mark
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.path)
        context = TaskContext.get()
        # attempts of a task do not meet
        folder = f"{root}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        parts: dict[str, str] = {}
        for name, group in groupby(rows, key=lambda r: r["name"]):
            if not name or "/" in name or name[0] in "._":
                raise ValueError(f"{name!r} is no name for a file")
            if name in parts:
                raise ValueError(f"the rows of {name} are not together")
            parts[name] = f"{folder}/{name}"
            before = None
            with system.open_output_stream(parts[name]) as out:
                out.write(self.mark)
                for r in group:
                    if before is not None and r["cue_no"] < before:
                        raise ValueError(f"the cues of {name} are not in order")
                    before = r["cue_no"]
                    out.write(block(r["cue_no"], r["start_ms"], r["end_ms"], r["text"] or "").encode(self.charset))
        return _Written(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        parts: dict[str, str] = {}
        for message in messages:
            for name, part in (message.parts if message else {}).items():
                if name in parts:
                    self.abort(messages)
                    raise ValueError(f"the rows of {name} were in two tasks")
                parts[name] = part
        there = [i.base_name for i in system.get_file_info([f"{root}/{n}" for n in parts]) if i.type != fs.FileType.NotFound]
        if there:
            self.abort(messages)
            raise FileExistsError(f"{self.path} has {', '.join(sorted(there)[:5])} already")
        for name, part in parts.items():
            system.move(part, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Removes what the job's tasks have left."""
        system, root = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


def write_srt_files(cues: DataFrame, path: str, charset: str = "UTF-8", mark: bool = False, name: str = "name") -> None:
    """A SubRip file of each name in the folder path; refuses to replace one that is there."""
    cues.sparkSession.dataSource.register(SrtFormat)
    rows = cues.withColumnRenamed(name, "name").select("name", "cue_no", "start_ms", "end_ms", "text")
    together = rows.repartition("name").sortWithinPartitions("name", "cue_no")
    together.write.format("srt").option("charset", charset).option("mark", str(mark).lower()).mode("append").save(path)


def read_srt_files(spark: SparkSession, path: str, charset: str = "UTF-8", pattern: str = "*.srt") -> DataFrame:
    """name and the columns of read_srt() of each cue below path."""
    spark.dataSource.register(SrtFormat)
    return spark.read.format("srt").option("charset", charset).option("pathGlobFilter", pattern).load(path)
