"""Files with names that say times, packets that arrive in batches, PIDs whose tables change."""

import pytest
from pyspark.sql import functions as F

from cueloom.functions import encoding
from cueloom.operators import binary_streams as bs
from cueloom.sources import sinks, text_files
from cueloom.streaming import incremental
from tests.test_cues_and_files import one, run_stream


def test_units_over_batches(spark, tmp_path):
    schema = "file_id long, pid long, pkt_no int, pusi int, payload binary"
    rows = [[(1, 5, 0, 0, b"lost"), (1, 5, 1, 1, b"ab")], [(1, 5, 2, 0, b"cd"), (1, 6, 3, 1, b"x")], [(1, 5, 4, 1, b"ef")], [(1, 5, 5, 0, None)]]
    got = run_stream(spark, tmp_path, rows, schema, incremental.reassemble_stream, "units")
    assert sorted((r.pid, bytes(r.data)) for r in got) == [(5, b"abcd"), (5, b"ef")]


def test_order_of_a_list_file(spark):
    name = lambda a, b: f"/x/00_00_0{a}_000__00_00_0{b}_000.txt"
    files = spark.createDataFrame([(1, name(1, 2), b"one\n"), (1, name(3, 4), b"two"), (1, name(5, 6), b"not listed")], "file_id long, path string, content binary")
    listed = spark.createDataFrame([(1, 1, name(3, 4)), (1, 2, " " + name(1, 2) + " ")], "file_id long, line_no int, line string")
    got = text_files.named_cues(files, listed=listed).orderBy("cue_no").collect()
    assert [(r.cue_no, r.start_ms, r.end_ms, r.text) for r in got] == [(1, 3000, 4000, "two"), (2, 1000, 2000, "one")]


def test_bitmap_files(spark, tmp_path):
    frame = spark.createDataFrame([(1000, 2500, b"BM1"), (3_600_000, 3_600_001, b"BM2"), (7, 8, None)], "start_ms long, end_ms long, content binary")
    named = frame.withColumn("name", sinks.bitmap_name(F.col("start_ms"), F.col("end_ms")))
    sinks.write_binaries(named, str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"00_00_01_000__00_00_02_500.bmp": b"BM1", "01_00_00_000__01_00_00_001.bmp": b"BM2"}
    again = text_files.named_cues(text_files.read_files(spark, str(tmp_path / "out"), "*.bmp"))
    assert sorted((r.start_ms, r.end_ms) for r in again.collect()) == [(1000, 2500), (3_600_000, 3_600_001)]
    with pytest.raises(FileExistsError):
        sinks.write_binaries(named, str(tmp_path / "out"))


def test_classes_follow_the_versions_of_tables(spark):
    def pat(version, *programs):
        return bytes.fromhex("0001") + bytes([0xC1 | version << 1, 0, 0]) + b"".join(bytes.fromhex(f"{n:04X}{0xE000 | pid:04X}") for n, pid in programs)

    def pmt(program, version, *pids):
        return bytes.fromhex(f"{program:04X}") + bytes([0xC1 | version << 1, 0, 0]) + bytes.fromhex("E000F000") + b"".join(bytes.fromhex(f"06{0xE000 | pid:04X}F000") for pid in pids)

    tables = [(1, 0, 1, 1, 0, pat(0, (1, 256))), (1, 256, 1, 2, 2, pmt(1, 0, 300)), (1, 256, 2, 4, 2, pmt(1, 0, 300)), (1, 0, 2, 6, 0, pat(1, (1, 257))), (1, 257, 1, 8, 2, pmt(1, 1, 301))]
    sections = spark.createDataFrame(tables, "file_id long, pid long, section_no int, pkt_no int, table_id long, body binary")
    packets = spark.createDataFrame([(1, n, pid, "x") for n in range(10) for pid in (256, 257, 300, 301, 8191, 17)] + [(2, 5, 300, None)], "file_id long, pkt_no int, pid long, extra string")
    got = bs.pid_classes(packets, sections)
    assert got.columns == [*packets.columns, "class"]
    seen = {}
    for r in got.orderBy("pkt_no").collect():
        seen.setdefault((r.file_id, r.pid), []).append({"unknown": "u", "psi": "t", "pes": "s", "null": "n"}[r["class"]])
    assert {k: "".join(v) for k, v in seen.items()} == {
        (1, 256): "utttttuuuu", (1, 257): "uuuuuutttt", (1, 300): "uussssssuu", (1, 301): "uuuuuuuuss", (1, 8191): "n" * 10, (1, 17): "t" * 10, (2, 300): "u",
    }
    assert bs.pid_classes(packets, sections.limit(0)).filter("class = 'pes'").count() == 0


def test_declared_charsets():
    page = lambda head: (head + "слово дело").encode("koi8_r")
    for head in ("<META http-equiv=x content='text/html; charset=koi8-r'>", "<?xml version='1.0' encoding='KOI8-R'?>", "a" * 300_000 + '<meta charset="koi8-r">'):
        assert encoding.declared_charset(page(head)).lower() == "koi8-r" and encoding.detect_bytes(page(head))[0] == "koi8_r"
    assert encoding.declared_charset(b"charset=koi8-r") is None
    # what the bytes say goes before what a page says
    assert encoding.detect_bytes('<meta charset="koi8-r">これは日本語の文章です。今日はとても良い天気でした。'.encode("shift_jis"))[0] == "shift_jis"
