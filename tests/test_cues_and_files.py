import pytest
from pyspark.sql import functions as F

from cueloom.functions import binary, bom, encoding, markup, timecode
from cueloom.operators import cues as ops
from cueloom.operators import pictures
from cueloom.sources import sinks, text_files
from cueloom.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_srt_files_as_rows_and_stream(spark, tmp_path):
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nHello\r\nthere\r\n\r\n12abc\r\n00:00:02,25 --> 00:00:03,000\r\n<i>x</i>\r\n\r\n\r\n3\r\nbroken\r\nline\r\n\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_bytes(text.encode())
    rows = text_files.read_srt(spark, str(tmp_path / "in")).orderBy("cue_no").collect()
    assert [(r.src_number, r.start_ms, r.end_ms, r.text, r.malformed) for r in rows] == [(1, 1000, 2000, "Hello\nthere", False), (12, 2025, 3000, "<i>x</i>", True), (3, None, None, "line", True)]
    with pytest.raises(Exception, match="malformed time line"):
        text_files.read_srt(spark, str(tmp_path / "in"), fail_fast=True).collect()
    incremental.drain(incremental.stream_srt(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_combine_over_batches(spark, tmp_path):
    rows = [(1, 0, 10, "a"), (1, 10, 20, "a"), (1, 20, 30, "b"), (1, 31, 40, "b"), (1, 99, 99, None)]
    schema = "file_id long, start_ms long, end_ms long, text string"
    for i, part in enumerate((rows[:1], rows[1:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = incremental.combine_stream(stream).writeStream.format("memory").queryName("combined").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.start_ms, r.end_ms, r.text) for r in spark.sql("SELECT * FROM combined").collect()) == [(0, 20, "a"), (20, 30, "b"), (31, 40, "b")]


def test_combine_edges(spark):
    rows = [(1, 1, 0, 10, "a"), (1, 2, 10, 20, "a"), (1, 3, 20, 30, "a "), (1, 4, 31, 40, "a "), (2, 1, 10, 20, "a"), (1, 5, 40, 50, "a "), (1, 6, 50, 60, "a ")]
    got = ops.combine(spark.createDataFrame(rows, "file_id long, cue_no long, start_ms long, end_ms long, text string"))
    assert sorted((r.file_id, r.cue_no, r.start_ms, r.end_ms) for r in got.collect()) == [(1, 1, 0, 20), (1, 2, 20, 30), (1, 3, 31, 60), (2, 1, 10, 20)]


def test_worked_example_of_two_anchors(spark):
    rows = [(1, 1, 29280, 31880, "a"), (1, 2, 5489280, 5490920, "b")]
    frame = spark.createDataFrame(rows, "file_id long, cue_no long, start_ms long, end_ms long, text string")
    got = ops.sync(frame, 29280, 5489280, 22280, 5485000).orderBy("cue_no").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(22280, 24880), (5485000, 5486640)]
    with pytest.raises(ValueError, match="anchors"):
        ops.sync(frame, 1, 1, 2, 3)


@pytest.mark.parametrize(
    "text,want",
    [("one,\ntwo", "one, two"), ("one.\ntwo", "one.\ntwo"), ("café\ntwo", "café two"), ("wo-\nrd", "word"), ("---\ntwo", "...\ntwo"), ("one-", "one-"), ("a\nb\nc", "a b\nc"), ("É\nb", "É\nb")],
)
def test_joining_lines(spark, text, want):
    assert one(spark, markup.join_first_lines(F.lit(text))) == want


@pytest.mark.parametrize(
    "text,want",
    [("< I >x</ I>", "<i>x</i>"), ("</ i >", "</ i >"), ("<font color = \"red\">", '<font color="red">'), ("{ \\an 8 }", "{\\an8}"), ("< / b >", "</b>"), ("<fontsize=3>", "<font size=3>")],
)
def test_fixing_tags(spark, text, want):
    assert one(spark, markup.fix_tags(F.lit(text))) == want


@pytest.mark.parametrize(
    "text,want",
    [("{\\i1}a{\\i0}\\Nb", "<i>a</i>\nb"), ("{\\b1\\i1}a", "<b><i>a</i></b>"), ("{\\c&H0000FF&}r{\\c}", '<font color="#FF0000">r</font>'), ("{\\fad(1,2)}{note}x", "x"), ("{\\an8}x", "{\\an8}x"), ("< / i >x", "</i >x"), ("{\\pos(1,2)\\u1}x{\\u}", "<u>x</u>")],
)
def test_override_tags(spark, text, want):
    assert one(spark, markup.ssa_to_srt(F.lit(text))) == want


def test_clocks(spark):
    assert one(spark, timecode.ms_to_clock(F.lit(-1500), ".")) == "-00:00:01.500"
    assert one(spark, timecode.clock_to_ms(F.lit("-01:00:00,001"))) == -3_600_001
    assert one(spark, timecode.clock_to_ms(F.lit("x"))) is None
    for ticks in (0, 1, 89, 90, 2**32 - 1):
        stamp = one(spark, timecode.ms_to_pes_stamp(F.lit(ticks)))
        assert one(spark, timecode.pes_stamp_ticks(F.lit(stamp))) == ticks * 90 % 2**33


def test_marks(spark):
    for no, _, mark in bom.BOMS:
        content = F.unhex(F.lit(mark + "4142"))
        assert one(spark, bom.bom_id(content)) == no and bytes(one(spark, bom.strip_bom(content))) == b"AB"


@pytest.mark.parametrize(
    "text,codec,names",
    [
        ("Съешь ещё этих мягких французских булок, да выпей же чаю. Погода была хорошая.", "cp1251", {"cp1251"}),
        ("Съешь ещё этих мягких французских булок, да выпей же чаю. Погода была хорошая.", "koi8_r", {"koi8_r"}),
        ("Ξεσκεπάζω την ψυχοφθόρα βδελυγμία και άλλα πολλά πράγματα", "iso8859_7", {"iso8859_7"}),
        ("これは日本語の文章です。今日はとても良い天気でした。", "shift_jis", {"shift_jis"}),
        ("これは日本語の文章です。今日はとても良い天気でした。", "euc_jp", {"euc_jp"}),
        ("다람쥐 헌 쳇바퀴에 타고파 오늘은 날씨가 좋습니다", "euc_kr", {"euc_kr"}),
        ("我们在这里说的是中国人的话，大家都知道这是什么意思", "gb18030", {"gb18030"}),
        ("Voilà un café très agréable où l'été dernier nous étions à l'aise", "cp1252", {"cp1252"}),
        ("Příliš žluťoučký kůň úpěl ďábelské ódy", "cp1250", {"cp1250"}),
        ("plain text", "ascii", {"ascii"}),
        ("héllo", "utf-8", {"utf-8"}),
        ("hello", "utf-16", {"utf-16-le"}),
        ("", "ascii", {"iso8859_1"}),
    ],
)
def test_detecting_encodings(text, codec, names):
    assert encoding.detect_bytes(text.encode(codec))[0] in names


def test_run_lengths():
    assert binary.pgs_runs(bytes.fromhex("05 0003 004102 008307 00C1020800 00".replace(" ", ""))) == [(5, 1, 0), (0, 3, 0), (0, 258, 0), (7, 3, 0), (8, 258, 0), (0, 0, 0)][:5]
    assert binary.vob_runs(bytes.fromhex("55" + "0003"), 4)[:2] == [(1, 1, 0), (1, 1, 0)]
    assert binary.dvb_runs(bytes([0x12, 5, 0, 0x83, 7, 0, 2, 0, 0, 0xF0, 0x12, 9, 0, 0])) == [(5, 1, 0), (7, 3, 0), (0, 2, 0), (9, 1, 1)]


def test_patches_in_any_order(spark):
    changes = F.array(*[F.struct(F.lit(o).alias("offset"), F.unhex(F.lit(b)).alias("bytes")) for o, b in ((4, "FF"), (0, "AABB"))])
    assert bytes(one(spark, binary.patched(F.unhex(F.lit("000102030405")), changes))).hex() == "aabb0203ff05"


def test_writing_refuses_to_replace(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "file_id long, line_no int, line string")
    sinks.write_lines(lines, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out" / "file_id=1").glob("*.txt")) == "a\nb\n"
    with pytest.raises(Exception, match="exists"):
        sinks.write_lines(lines, str(tmp_path / "out"))


def run_stream(spark, tmp_path, rows, schema, operator, name):
    """Rows of operator over a stream of one file a batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = operator(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_epochs_over_batches(spark, tmp_path):
    schema = "file_id long, seg_no int, pts_ms long, state long, n_objects long, object_id long"
    rows = [[(1, 1, 0, 0x80, 1, 0)], [(1, 2, 1000, 0, 0, None), (1, 3, 1500, 0, 1, 1)], [(1, 4, 1800, 0, 1, 2), (1, 5, 1900, 0, 1, 2)], [(1, 6, None, None, None, None)]]
    got = run_stream(spark, tmp_path, rows, schema, incremental.pgs_subtitles_stream, "epochs")
    assert sorted((r.start_ms, r.end_ms) for r in got) == [(0, 1000), (1500, 1800), (1800, 1900)]


def test_page_timeouts_over_batches(spark, tmp_path):
    schema = "file_id long, pid long, page_id long, pts_ms long, timeout_s int, n_regions int"
    rows = [[(1, 1, 1, 1000, 2, 1), (2, 1, 1, 1000, 0, 1)], [(1, 1, 1, 2000, 2, 1)], [(3, 1, 1, 9000, 0, 0)], [(3, 1, 1, 9500, 0, 0)], [(2, 1, 1, 9600, 0, 0)]]
    got = run_stream(spark, tmp_path, rows, schema, incremental.dvb_pages_stream, "timeouts")
    assert sorted((r.file_id, r.start_ms, r.end_ms) for r in got) == [(1, 1000, 2000), (1, 2000, 4000), (2, 1000, 9600)]


def test_hints_settle_near_ties():
    data = "слово дело".encode("koi8_r")
    plain, hinted = encoding.detect_bytes(data), encoding.detect_bytes(data, encoding.hinted("KOI8-R", "ru", "example.ru"))
    assert plain[0] in encoding.CANDIDATES and hinted[0] == "koi8_r"
    assert encoding.detect_bytes("これは日本語の文章です".encode("shift_jis"), encoding.hinted(None, "ru"))[0] == "shift_jis"
    assert encoding.hinted("no such charset", "xx", "example.zz") == {} and set(encoding.hinted("ISO-8859-1")) == {"cp1252"}


def test_pictures_without_objects_or_colours(spark):
    schema = "file_id long, pid long, unit long, pts_ms long, seg_no int, type int, page_id int, body binary"
    empty = spark.createDataFrame([], schema)
    assert pictures.compositions(empty).count() == 0
    page, region, obj = bytes.fromhex("0508" + "00FF00000000"), bytes.fromhex("0008" + "00080008" + "6C" + "00" + "0000" + "000100000000"), bytes.fromhex("0001" + "00" + "00060000" + "1205010000F0")
    rows = [(1, 1, 1, 0, i, kind, 1, body) for i, (kind, body) in enumerate(((0x10, page), (0x11, region), (0x13, obj)))]
    got = pictures.compositions(spark.createDataFrame(rows, schema)).first()
    assert (got.width, got.height) == (2, 2) and bytes(got.pixels) == bytes.fromhex("FF00FF40FF000040" * 2)
    truncated = [(1, 1, 1, 0, i, kind, 1, body) for i, (kind, body) in enumerate(((0x10, b""), (0x11, b"\0"), (0x12, b"\0"), (0x13, b"\0"), (0x15, b"")))]
    assert pictures.compositions(spark.createDataFrame(truncated, schema)).count() == 0
