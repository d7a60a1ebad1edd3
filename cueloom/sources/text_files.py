"""Whole text files as rows: SubRip, SubStation Alpha, VobSub index, text blocks, named texts.

A file is one row of the binaryFile source and is parsed by built-in expressions; ordinals come from
positions within the file, so nothing depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions import bom, timecode


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file_id, path, content, length of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("file_id"), "path", "content", "length")


def as_text(files: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """file_id, bom_id, text: without mark and carriage returns, runs of final line ends cut to one."""
    text = F.translate(F.decode(bom.strip_bom(F.col("content")), charset), "\r", "")
    return files.select("file_id", bom.bom_id(F.col("content")).alias("bom_id"), F.regexp_replace(text, "\n+\\z", "\n").alias("text"))


def lines(texts: DataFrame) -> DataFrame:
    """file_id, line_no (from 1), line."""
    body = F.regexp_replace("text", "\n\\z", "")
    return texts.select("file_id", F.posexplode(F.split(body, "\n")).alias("p", "line")).select("file_id", (F.col("p") + 1).alias("line_no"), "line")


def srt_blocks(texts: DataFrame) -> DataFrame:
    """file_id, cue_no, number_line, time_line, text of every blank-line-separated block."""
    blocks = F.split(F.btrim("text", F.lit("\n")), "\n{2,}")
    each = texts.filter(F.btrim("text", F.lit("\n")) != "").select("file_id", F.posexplode(blocks).alias("p", "block"))
    parts = F.split("block", "\n", 3)
    return each.select(
        "file_id",
        (F.col("p") + 1).cast("long").alias("cue_no"),
        F.get(parts, 0).alias("number_line"),
        F.coalesce(F.get(parts, 1), F.lit("")).alias("time_line"),
        F.coalesce(F.get(parts, 2), F.lit("")).alias("text"),
    )


def srt_cues(blocks: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Cues with src_number and malformed (null times, or a two-digit millisecond part)."""
    line = F.col("time_line")
    start, end = timecode.line_start_ms(line), timecode.line_end_ms(line)
    if fail_fast:
        start = F.when(start.isNull(), F.raise_error(F.concat(F.lit("malformed time line: "), line)).cast("long")).otherwise(start)
    number = F.regexp_extract("number_line", r"^\s*([+-]?\d+)", 1).try_cast("long")
    return blocks.select(
        "file_id", "cue_no", number.alias("src_number"), start.alias("start_ms"), end.alias("end_ms"), "text",
        (start.isNull() | timecode.two_digit_start(line)).alias("malformed"),
    )


def read_srt(spark: SparkSession, path: str, charset: str = "UTF-8", fail_fast: bool = False) -> DataFrame:
    return srt_cues(srt_blocks(as_text(read_files(spark, path, "*.srt"), charset)), fail_fast)


def text_blocks(texts: DataFrame) -> DataFrame:
    """file_id, cue_no, text of blank-line-separated blocks."""
    body = F.btrim("text", F.lit("\n"))
    each = texts.filter(body != "").select("file_id", F.posexplode(F.split(body, "\n{2,}")).alias("p", "text"))
    return each.select("file_id", (F.col("p") + 1).cast("long").alias("cue_no"), "text")


NAME = r"(\d\d_\d\d_\d\d_\d{3})__(\d\d_\d\d_\d\d_\d{3})"


def named_cues(files: DataFrame, group: str = "file_id", listed: DataFrame | None = None) -> DataFrame:
    """Cues from files whose names are their times (hh_mm_ss_mmm__hh_mm_ss_mmm); files: group, path, content.

    listed: lines (file_id, line_no, line) of list files; cues then come in their order, and only those listed.
    """
    name = F.element_at(F.split("path", "/"), -1)
    df = files.select(
        F.col(group).alias("file_id"),
        name.alias("name"),
        timecode.clock_to_ms(F.regexp_extract(name, NAME, 1)).alias("start_ms"),
        timecode.clock_to_ms(F.regexp_extract(name, NAME, 2)).alias("end_ms"),
        F.btrim(F.translate(F.decode("content", "UTF-8"), "\r", ""), F.lit("\n")).alias("text"),
    )
    order = ["start_ms", "name"]
    if listed is not None:
        names = listed.select("file_id", "line_no", F.element_at(F.split(F.trim("line"), "/"), -1).alias("name"))
        df, order = df.join(names, ["file_id", "name"]), ["line_no"]
    w = Window.partitionBy("file_id").orderBy(*order)
    return df.withColumn("cue_no", F.row_number().over(w)).select("file_id", "cue_no", "start_ms", "end_ms", "text")


# SubStation Alpha


def _in_section(all_lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(r"^\[.*\]\s*$"), F.trim("line"))
    df = all_lines.withColumn("section", F.last(head, ignorenulls=True).over(w))
    form = F.when(F.col("line").startswith("Format:"), F.transform(F.split(F.substring("line", F.lit(8), F.length("line")), ","), lambda c: F.trim(c)))
    ws = Window.partitionBy("file_id", "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("format", F.last(form, ignorenulls=True).over(ws))


def _field(name: str, values: str = "values"):
    """A field by the name of its column in the format line; null if there is none."""
    place = F.array_position("format", name)
    return F.when(place > 0, F.get(F.col(values), place.cast("int") - 1))


def ssa_styles(all_lines: DataFrame) -> DataFrame:
    df = _in_section(all_lines).filter(F.col("section").isin("[V4 Styles]", "[V4+ Styles]") & F.col("line").startswith("Style:"))
    df = df.withColumn("values", F.transform(F.split(F.substring("line", F.lit(7), F.length("line")), ","), lambda c: F.trim(c)))
    number = lambda n: _field(n).try_cast("int")
    w = Window.partitionBy("file_id").orderBy("line_no")
    return df.select(
        "file_id", F.row_number().over(w).alias("style_idx"), _field("Name").alias("name"), _field("PrimaryColour").alias("primary_colour"),
        number("Bold").alias("bold"), number("Italic").alias("italic"), number("Underline").alias("underline"), number("StrikeOut").alias("strikeout"), number("Alignment").alias("alignment"),
    )


def ssa_events(all_lines: DataFrame) -> DataFrame:
    df = _in_section(all_lines).filter((F.col("section") == "[Events]") & F.col("line").startswith("Dialogue: "))
    # the last field keeps its commas
    df = df.withColumn("values", F.split(F.substring("line", F.lit(11), F.length("line")), F.lit(","), F.size("format")))
    w = Window.partitionBy("file_id").orderBy("line_no")
    time = lambda n: timecode.ssa_clock_to_ms(F.trim(_field(n)))
    return df.select("file_id", F.row_number().over(w).alias("event_no"), time("Start").alias("start_ms"), time("End").alias("end_ms"), F.trim(_field("Style")).alias("style"), _field("Text").alias("text"))


# VobSub index

IDX_KEY = r"^([A-Za-z/ ]+?): *(.*)$"


def idx_keywords(all_lines: DataFrame) -> DataFrame:
    """file_id, line_no, keyword, value; comments and empty lines go."""
    df = all_lines.filter(~F.col("line").rlike(r"^\s*(#|$)"))
    return df.select("file_id", "line_no", F.regexp_extract("line", IDX_KEY, 1).alias("keyword"), F.regexp_extract("line", IDX_KEY, 2).alias("value")).filter("keyword <> ''")


def idx_palette(keywords: DataFrame) -> DataFrame:
    each = keywords.filter("keyword = 'palette'").select("file_id", F.posexplode(F.split("value", r"\s*,\s*")).alias("pal_idx", "rgb"))
    part = lambda i: F.conv(F.substring("rgb", i, 2), 16, 10).cast("int")
    return each.select("file_id", "pal_idx", part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def idx_entries(keywords: DataFrame) -> DataFrame:
    """file_id, lang, lang_index, ts_no, start_ms, filepos of every stamp; languages carry down the lines."""
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_id = F.col("keyword") == "id"
    df = keywords.withColumns({
        "lang": F.last(F.when(is_id, F.regexp_extract("value", r"^(\w*)", 1)), ignorenulls=True).over(w),
        "lang_index": F.last(F.when(is_id, F.regexp_extract("value", r"index: *(\d+)", 1).try_cast("int")), ignorenulls=True).over(w),
    }).filter("keyword = 'timestamp'")
    stamp = r"^(\d\d:\d\d:\d\d:\d{3}), filepos: *([0-9A-Fa-f]+)"
    by_lang = Window.partitionBy("file_id", "lang_index").orderBy("line_no")
    return df.select(
        "file_id", "lang", "lang_index", F.row_number().over(by_lang).alias("ts_no"),
        timecode.clock_to_ms(F.regexp_extract("value", stamp, 1)).alias("start_ms"), F.conv(F.regexp_extract("value", stamp, 2), 16, 10).cast("long").alias("filepos"),
    )


def idx_retimed(all_lines: DataFrame, ms: int) -> DataFrame:
    """Lines with stamps moved, not below zero, other lines as they are."""
    p = r"^timestamp: (\d\d:\d\d:\d\d:\d{3})(.*)$"
    moved = F.greatest(timecode.clock_to_ms(F.regexp_extract("line", p, 1)) + ms, F.lit(0))
    new = F.concat(F.lit("timestamp: "), timecode.ms_to_clock(F.col("__ms"), ":"), F.regexp_extract("line", p, 2))
    stamped = all_lines.withColumn("__ms", moved)
    return stamped.withColumn("line", F.when(F.col("line").rlike(p), new).otherwise(F.col("line"))).drop("__ms")
