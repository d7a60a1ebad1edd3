"""Cues as files: SubRip, plain text, chapters, bitmaps. Writing never replaces what is there."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions import bom, timecode


def srt_text(cues: DataFrame, mark: int = 0) -> DataFrame:
    """file_id, content (BINARY) of one SubRip file a file_id; mark: number of a byte-order mark."""
    time = F.concat(timecode.ms_to_clock(F.col("start_ms")), F.lit(" --> "), timecode.ms_to_clock(F.col("end_ms")))
    body = F.when(F.col("text") == "", "").otherwise(F.concat("text", F.lit("\n")))
    block = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), time, F.lit("\n"), body, F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("cue_no", block.alias("block"))))
    out = cues.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "").alias("s"))
    content = F.encode("s", "UTF-8")
    return out.select("file_id", (bom.write_bom(content, mark) if mark else content).alias("content"))


CHAPTERS_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<Chapters>\n  <EditionEntry>\n'
CHAPTER = (
    "    <ChapterAtom>\n      <ChapterTimeStart>%s</ChapterTimeStart>\n      <ChapterDisplay>\n        <ChapterString>Chapter %02d</ChapterString>\n"
    "        <ChapterLanguage>eng</ChapterLanguage>\n      </ChapterDisplay>\n    </ChapterAtom>\n"
)
CHAPTERS_TAIL = "  </EditionEntry>\n</Chapters>\n"


def chapters_xml(chapters: DataFrame) -> DataFrame:
    """file_id, xml: one document of chapters a file."""
    ms = F.floor(F.col("start_ms") + 0.5).cast("long")
    atom = F.format_string(CHAPTER, timecode.ms_to_clock(ms, "."), "chapter_no")
    ordered = F.array_sort(F.collect_list(F.struct("chapter_no", atom.alias("a"))))
    body = F.array_join(F.transform(ordered, lambda x: x["a"]), "")
    return chapters.groupBy("file_id").agg(F.concat(F.lit(CHAPTERS_HEAD), body, F.lit(CHAPTERS_TAIL)).alias("xml"))


def write_lines(lines: DataFrame, path: str, order: str = "line_no") -> None:
    """line of each file_id as text in a folder of its own; refuses to overwrite."""
    placed = lines.repartition("file_id").sortWithinPartitions("file_id", order)
    placed.select("file_id", F.col("line").alias("value")).write.partitionBy("file_id").mode("errorifexists").text(path)


def write_texts(files: DataFrame, path: str, content: str = "content") -> None:
    """One text file with the content (BINARY in UTF-8, or STRING) of each file_id, in a folder file_id=... of its own; refuses to overwrite.

    A content that does not end with a line end gets one.
    """
    text = F.regexp_replace(F.col(content).cast("string"), "\n\\z", "")
    files.select("file_id", text.alias("value")).repartition("file_id").write.partitionBy("file_id").mode("errorifexists").text(path)


def write_srt(cues: DataFrame, path: str, mark: int = 0) -> None:
    """SubRip files on disk; mark: 1 for a mark of UTF-8."""
    write_texts(srt_text(cues, mark), path)


def write_binaries(files: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """content (BINARY) of each row as a file of that name in the folder path, which must not exist yet. Names must differ.

    Each task writes its own files through pyarrow's file systems, each first under another name, so that a task
    that is run again leaves whole files only.
    """
    filesystem, root = fs.FileSystem.from_uri(path)
    if filesystem.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    filesystem.create_dir(root, recursive=True)

    def write(rows) -> None:
        there, folder = fs.FileSystem.from_uri(path)
        for row in rows:
            part = f"{folder}/_{row[0]}.{uuid.uuid4().hex}"
            with there.open_output_stream(part) as out:
                out.write(row[1])
            there.move(part, f"{folder}/{row[0]}")

    files.select(name, content).filter(F.col(content).isNotNull()).foreachPartition(write)


def bitmap_name(start_ms, end_ms):
    """The name of a bitmap's file, which says its times and which named_cues() reads."""
    clock = lambda c: F.translate(timecode.ms_to_clock(c), ":,", "__")
    return F.concat(clock(start_ms), F.lit("__"), clock(end_ms), F.lit(".bmp"))


def write_contents(files: DataFrame, path: str) -> None:
    """content (BINARY) of each file_id, as a Parquet table of whole files; refuses to overwrite."""
    files.write.mode("errorifexists").parquet(path)


def premultiplied(rows):
    """Hex rows of RRGGBB pixels from rows of RRGGBBAA: colours times alpha / 255, rounded down."""
    value = lambda p, i: F.conv(F.substring(p, i, 2), 16, 10).cast("long")
    pixel = lambda p: F.concat(*[F.lpad(F.hex(F.floor(value(p, i) * value(p, 7) / 255).cast("long")), 2, "0") for i in (1, 3, 5)])
    return F.transform(rows, lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit("([0-9A-F]{8})")), pixel), ""))


def bmp(width, height, rgb):
    """A bottom-up 24-bit bitmap (BINARY) of hex rows top to bottom, each of RRGGBB pixels; rgb: array<string>."""
    pad = (F.lit(4) - (width * 3) % 4) % 4
    row = lambda r: F.concat(F.regexp_replace(r, "(..)(..)(..)", "$3$2$1"), F.repeat(F.lit("00"), pad))
    data = F.array_join(F.transform(F.reverse(rgb), row), "")
    size = (width * 3 + pad) * height
    le = lambda v: F.concat(*[F.lpad(F.hex(F.shiftright(v.cast("long"), s).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for s in (0, 8, 16, 24)])
    head = F.concat(F.lit("424D"), le(size + 54), F.lit("0000000036000000" + "28000000"), le(width), le(height), F.lit("0100180000000000"), le(size), F.lit("C21E0000C21E0000" + "00000000" + "00000000"))
    return F.unhex(F.concat(head, data))
