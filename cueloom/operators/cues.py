"""Operators over cues: file_id, cue_no (from 1 in each file), start_ms, end_ms, text.

Every file is a group of windows; rows of one file are as many as one subtitle file has. Where a file may be larger than a
task, combine(), reorder() and check_cues() take ``size``, the cues of a range, and work by ranges (``ranges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cueloom.functions import bom, markup, timecode
from cueloom.operators import ranges

CUE = ["file_id", "cue_no", "start_ms", "end_ms", "text"]


def by_file() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("cue_no")


def renumber(cues: DataFrame, *order: Column | str) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy(*(order or ("cue_no",)))
    return cues.withColumn("cue_no", F.row_number().over(w))


def _with_previous(cues: DataFrame, previous: dict[str, Column | str], size: int | None) -> DataFrame:
    if size:
        return ranges.with_previous(cues, previous, ranges.by_number("cue_no", size))
    return cues.withColumns({name: F.lag(c).over(by_file()) for name, c in previous.items()})


def combine(cues: DataFrame, size: int | None = None) -> DataFrame:
    """Adjacent cues of the same text, each starting where the one before ends, become one."""
    known = _with_previous(cues, {"__pe": "end_ms", "__pt": "text"}, size)
    same = (F.col("start_ms") == F.col("__pe")) & (F.col("text") == F.col("__pt"))
    begins = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    if size:
        grouped = ranges.running_sum(known, begins, "__g", ranges.by_number("cue_no", size), ["cue_no"])
    else:
        grouped = known.withColumn("__b", begins).withColumn("__g", F.sum("__b").over(by_file().rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy("file_id", F.col("__g").cast("int").alias("cue_no")).agg(
        F.min_by("start_ms", "cue_no").alias("start_ms"), F.max_by("end_ms", "cue_no").alias("end_ms"), F.min_by("text", "cue_no").alias("text")
    )
    return out.select(*CUE)


def split(cues: DataFrame) -> DataFrame:
    """Every cue becomes two halves."""
    middle = timecode.div(F.col("start_ms") + F.col("end_ms"), 2)
    halves = F.array(
        F.struct((F.col("cue_no") * 2 - 1).alias("n"), F.col("start_ms").alias("a"), middle.alias("b")),
        F.struct((F.col("cue_no") * 2).alias("n"), middle.alias("a"), F.col("end_ms").alias("b")),
    )
    out = cues.select("file_id", F.explode(halves).alias("h"), "text")
    return out.select("file_id", F.col("h.n").alias("cue_no"), F.col("h.a").alias("start_ms"), F.col("h.b").alias("end_ms"), "text")


def offset(cues: DataFrame, ms: int, clamp: bool = False) -> DataFrame:
    """Moves all cues; negative times are flagged, or become zero."""
    start, end = F.col("start_ms") + ms, F.col("end_ms") + ms
    if clamp:
        start, end = F.greatest(start, F.lit(0)), F.greatest(end, F.lit(0))
    return cues.select("file_id", "cue_no", start.alias("start_ms"), end.alias("end_ms"), "text", ((start < 0) | (end < 0)).alias("underflow"))


def sync(cues: DataFrame, old_first: int, old_last: int, new_first: int, new_last: int) -> DataFrame:
    """Starts follow the line through two anchors; durations stay."""
    if old_first == old_last:
        raise ValueError("the anchors are the same")
    ratio = (new_last - new_first) / (old_last - old_first)
    start = (F.lit(float(new_first)) + (F.col("start_ms") - old_first) * F.lit(ratio)).cast("long")
    return cues.select("file_id", "cue_no", start.alias("start_ms"), (start + F.col("end_ms") - F.col("start_ms")).alias("end_ms"), "text")


def reorder(cues: DataFrame, span: int | None = None) -> DataFrame:
    """By start; of equal starts the earlier number first. span: milliseconds of a range, for files too large for one task."""
    if span:
        placed = ranges.running_sum(cues, F.lit(1), "__no", ranges.by_number("start_ms", span), ["start_ms", "cue_no"])
        return placed.withColumn("cue_no", F.col("__no").cast("int")).select(*CUE)
    return renumber(cues, "start_ms", "cue_no").select(*CUE)


def drop_ellipses(cues: DataFrame) -> DataFrame:
    return renumber(cues.filter(~markup.is_ellipsis(F.col("text")))).select(*CUE)


def map_text(cues: DataFrame, f) -> DataFrame:
    return cues.withColumn("text", f(F.col("text")))


def text_lines(cues: DataFrame, spaced: bool = True) -> DataFrame:
    """file_id, line_no, line: the texts alone, with an empty line after each cue if spaced."""
    lines = F.split("text", "\n")
    lines = F.concat(lines, F.array(F.lit(""))) if spaced else lines
    out = cues.select("file_id", "cue_no", F.posexplode(lines).alias("p", "line"))
    w = Window.partitionBy("file_id").orderBy("cue_no", "p")
    return out.select("file_id", F.row_number().over(w).alias("line_no"), "line")


def times_and_texts(timed: DataFrame, texts: DataFrame) -> DataFrame:
    """Times of one file of cues, texts of the other, by number; matched is false where either lacks one."""
    a = timed.select("file_id", "cue_no", "start_ms", "end_ms")
    b = texts.select("file_id", "cue_no", "text")
    out = a.join(b, ["file_id", "cue_no"], "full_outer")
    return out.select(*CUE, (F.col("start_ms").isNotNull() & F.col("text").isNotNull()).alias("matched"))


def transfer_tags(tagged: DataFrame, plain: DataFrame) -> DataFrame:
    """Tags of the lines of one file around the lines of the other: file_id, cue_no, line_no, line."""
    lines = lambda df, n: df.select("file_id", "cue_no", F.posexplode(F.split("text", "\n")).alias("line_no", n))
    both = lines(tagged, "a").join(lines(plain, "b"), ["file_id", "cue_no", "line_no"])
    line = F.concat(markup.leading_tags(F.col("a")), F.col("b"), markup.later_tags(F.col("a")))
    return both.select("file_id", "cue_no", F.col("line_no").cast("int").alias("line_no"), line.alias("line"))


#: Code and severity of each rule, in the order in which the first error counts.
RULES = {
    "not_closed": "ERROR",
    "bom": "INFO",
    "blank_lines": "ERROR",
    "number_not_integer": "ERROR",
    "number_start": "ERROR",
    "time_format": "ERROR",
    "no_text": "WARN",
    "many_lines": "WARN",
    "number_order": "WARN",
    "number_gap": "WARN",
    "end_before_start": "ERROR",
    "overlap": "ERROR",
}


def check_cues(cues: DataFrame, size: int | None = None) -> DataFrame:
    """file_id, cue_no, code, severity of every rule that parsed cues break; cues may have src_number."""
    number = F.col("src_number") if "src_number" in cues.columns else F.col("cue_no")
    df = _with_previous(cues, {"__pn": number, "__pe": "end_ms"}, size).withColumn("__n", number)
    lines = F.size(F.split("text", "\n"))
    tests = {
        "no_text": F.col("text").isNull() | (F.col("text") == ""),
        "many_lines": lines > 2,
        "number_order": F.col("__n") <= F.col("__pn"),
        "number_gap": F.col("__n") - F.col("__pn") > 1,
        "end_before_start": F.col("end_ms") <= F.col("start_ms"),
        "overlap": F.col("start_ms") < F.col("__pe"),
    }
    return _broken(df, tests)


def _broken(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), F.lit(RULES[c]).alias("severity"))) for c, t in tests.items()]))
    return df.select("file_id", "cue_no", F.explode(hits).alias("d")).select("file_id", "cue_no", "d.code", "d.severity")


def check_blocks(blocks: DataFrame) -> DataFrame:
    """Rules on the raw number and time lines: file_id, cue_no, number_line, time_line."""
    tests = {
        "number_not_integer": ~F.col("number_line").rlike(r"^\s*[+-]?\d"),
        "number_start": ~F.col("number_line").rlike(r"^\d"),
        "time_format": ~F.col("time_line").rlike(timecode.STRICT_LINE),
    }
    return _broken(blocks, tests)


def check_lines(lines: DataFrame) -> DataFrame:
    """Rules on whole files of lines (file_id, line_no, line); cue_no is the line's number."""
    w = Window.partitionBy("file_id").orderBy("line_no")
    df = lines.withColumns({"cue_no": F.col("line_no"), "__p": F.lag("line").over(w), "__last": F.lead("line_no").over(w).isNull()})
    return _broken(df, {"blank_lines": (F.col("line") == "") & (F.col("__p") == ""), "not_closed": F.col("__last") & (F.col("line") != "")})


def check_marks(files: DataFrame) -> DataFrame:
    """file_id, cue_no 0, code, severity and the mark's name of files (file_id, content) that begin with a byte-order mark."""
    found = files.select("file_id", F.lit(0).alias("cue_no"), F.lit("bom").alias("code"), F.lit(RULES["bom"]).alias("severity"), bom.bom_name(F.col("content")).alias("mark"))
    return found.filter("mark IS NOT NULL")


def summary(diagnostics: DataFrame, cues: DataFrame) -> DataFrame:
    """file_id, cues, errors, warnings and first_error of every file."""
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(RULES) for x in (c, i)])
    found = diagnostics.groupBy("file_id").agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARN").alias("warnings"),
        F.min_by(F.col("code"), F.when(F.col("severity") == "ERROR", F.struct("cue_no", rank[F.col("code")]))).alias("first_error"),
    )
    out = cues.groupBy("file_id").agg(F.count("*").alias("cues")).join(found, "file_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("file_id", "cues", zero("errors"), zero("warnings"), "first_error")


def chapters(files: DataFrame) -> DataFrame:
    """file_id, duration_ms, n (may be fractional) to file_id, chapter_no, start_ms: n equal chapters."""
    each = files.select("file_id", F.explode(F.sequence(F.lit(0), F.floor("n").cast("int") - 1)).alias("i"), (F.col("duration_ms") / F.col("n")).alias("d"))
    return each.select("file_id", (F.col("i") + 1).alias("chapter_no"), (F.col("i") * F.col("d")).alias("start_ms"))


def convert_ssa(events: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """Dialogue events (file_id, event_no, start_ms, end_ms, style, text) as cues with SubRip markup.

    styles: file_id, style_idx, name, primary_colour, bold, italic, underline, strikeout, alignment;
    a style's first definition counts, an unknown style adds nothing.
    """
    text = markup.ssa_to_srt(F.col("text"))
    if styles is None:
        return events.select("file_id", F.col("event_no").alias("cue_no"), "start_ms", "end_ms", text.alias("text"))
    fields = ["primary_colour", "bold", "italic", "underline", "strikeout", "alignment"]
    first = styles.groupBy("file_id", "name").agg(F.min_by(F.struct(*fields), "style_idx").alias("st"))
    named = events.withColumn("name", F.regexp_replace("style", r"^\*+", ""))
    joined = named.join(first, ["file_id", "name"], "left")
    s = {f: F.col(f"st.{f}") for f in fields}
    before = markup.style_open(s["primary_colour"], s["alignment"], s["bold"], s["italic"], s["underline"], s["strikeout"])
    after = markup.style_close(s["primary_colour"], s["bold"], s["italic"], s["underline"], s["strikeout"])
    whole = F.when(F.col("st").isNotNull(), F.concat(before, text, after)).otherwise(text)
    return joined.select("file_id", F.col("event_no").alias("cue_no"), "start_ms", "end_ms", whole.alias("text"))
