import io
import os
import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import binary_streams as bs
from cueloom.sources import srt_format, stream_files, text_files


def ts_stream(rng, packets):
    return [b"\x47" + bytes([rng.randrange(256) & 0x5F, rng.randrange(256), 0x10 | n % 16]) + bytes(rng.choice([0x47, 0, 255, *range(9)]) for _ in range(184)) for n in range(packets)]


def ps_stream(rng, packets):
    out = []
    for n in range(packets):
        if n % 7 == 0:
            stuffing = rng.randrange(8)
            out.append(b"\0\0\1\xba\x44" + bytes(rng.randrange(256) for _ in range(8)) + bytes([0xF8 | stuffing]) + b"\xff" * stuffing)
        else:
            body = b"".join(rng.choice([b"\0\0\1\xbd\0\x05", b"\0\0\1\xba", bytes([rng.randrange(256)])]) for _ in range(rng.randrange(300)))
            out.append(b"\0\0\1" + bytes([rng.choice([0xBD, 0xE0, 0xBE])]) + len(body).to_bytes(2, "big") + body)
    return [*out, b"\0\0\1\xb9"]


def pgs_stream(rng, segments):
    out = []
    for n in range(segments):
        body = b"".join(rng.choice([b"PG", b"PG" + b"\0" * 8 + b"\x16\0\x03", bytes([rng.randrange(256)])]) for _ in range(rng.randrange(200)))
        out.append(b"PG" + (n * 900).to_bytes(4, "big") + b"\0\0\0\0" + bytes([rng.choice(stream_files.SEGMENTS)]) + len(body).to_bytes(2, "big") + body)
    return out


STREAMS = {"ts": ts_stream, "ps": ps_stream, "pgs": pgs_stream}


def found(data, kind, size):
    return [r for a in range(0, len(data), size) for r in stream_files.records(io.BytesIO(data), len(data), stream_files.KINDS[kind], a, min(len(data), a + size))]


@pytest.mark.parametrize("kind", list(STREAMS))
def test_ranges_give_the_records_of_the_whole(kind, monkeypatch):
    for seed in range(4):
        rng = random.Random(seed)
        parts = STREAMS[kind](rng, 60)
        junk = [bytes(rng.choice([0, 1, 0x47, 0x50, 7]) for _ in range(rng.randrange(400))) for _ in range(2)]
        # a mark right behind a record would be taken for the next one
        data, want, junk[1] = junk[0], [], b"\7" + junk[1]
        for k, part in enumerate(parts):
            if k == 30:
                data += junk[1]
            want.append((len(data), part))
            data += part
        whole = found(data, kind, len(data))
        # junk may look like a record only if a chain follows it
        assert [w for w in want if w in whole] == want and len(whole) <= len(want) + 1
        for chunk in (64, 1 << 20):
            monkeypatch.setattr(stream_files, "CHUNK", chunk)
            for size in (37, 188, 1000, 5000):
                assert found(data, kind, size) == whole, (seed, chunk, size)


def test_ends_that_are_cut():
    ts = b"".join(ts_stream(random.Random(1), 8))
    assert len(found(ts[:-1], "ts", 500)) == 7 and found(b"", "ts", 5) == [] and found(b"\x47" * 100, "ts", 10) == []
    pgs = b"".join(pgs_stream(random.Random(1), 8))
    assert len(found(pgs + b"PG\0\0", "pgs", 90)) == 8
    assert found(b"junk only", "pgs", 4) == found(b"\0\0", "ps", 1) == []


@pytest.mark.parametrize("kind,read,whole,key", [("ts", stream_files.read_ts, bs.ts_packets, "pkt_no"), ("ps", stream_files.read_ps, bs.ps_packets, "pkt_no"), ("pgs", stream_files.read_pgs, bs.pgs_segments, "seg_no")])
def test_sources_equal_the_operators_on_whole_files(spark, tmp_path, kind, read, whole, key):
    os.makedirs(tmp_path / "in/_hidden")
    for n in range(3):
        (tmp_path / f"in/{n}.bin").write_bytes(b"".join(STREAMS[kind](random.Random(n), 40 * n + 5)))
    (tmp_path / "in/empty.bin").write_bytes(b"")
    (tmp_path / "in/note.txt").write_bytes(b"PG")
    (tmp_path / "in/_hidden/x.bin").write_bytes(b"".join(STREAMS[kind](random.Random(9), 9)))
    path = str(tmp_path / "in")
    want = whole(text_files.read_files(spark, path, "*.bin"))
    rows = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    for size in (1 << 20, 700):
        got = read(spark, path, "*.bin", size)
        assert set(want.columns) <= set(got.columns) and rows(got) == rows(want)
    assert spark.read.format("stream_files").option("kind", kind).option("rangeBytes", "700").load(path).rdd.getNumPartitions() > 5


def test_options_of_streams(spark, tmp_path):
    spark.dataSource.register(stream_files.StreamFiles)
    with pytest.raises(Exception, match="kind is one of"):
        spark.read.format("stream_files").option("kind", "mkv").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="none-here"):
        spark.read.format("stream_files").option("kind", "ts").load(str(tmp_path / "none-here")).count()


CUES = [("a.srt", 1, 0, 1500, "Ünï\nzwei"), ("a.srt", 2, 1500, 3_723_004, ""), ("b.srt", 1, 5, 10, "日本"), ("b.srt", 2, 10, 20, "<i>x</i>"), ("long.srt", 1, 0, 1, "y")]


def frame(spark, rows=CUES):
    return spark.createDataFrame(rows, "name string, cue_no int, start_ms long, end_ms long, text string").repartition(5)


@pytest.mark.parametrize("charset,mark", [("UTF-8", False), ("utf-8", True), ("utf-16-le", True), ("UTF-16BE", True), ("utf-32-be", True), ("gb18030", True), ("gb18030", False)])
def test_written_files_are_read_again(spark, tmp_path, charset, mark):
    rows = [r for r in CUES if charset != "gb18030" or True]
    path = str(tmp_path / "out")
    srt_format.write_srt_files(frame(spark, rows), path, charset, mark)
    assert sorted(os.listdir(path)) == ["a.srt", "b.srt", "long.srt"]
    # a mark says the charset
    got = srt_format.read_srt_files(spark, path, "latin-1" if mark else charset)
    assert sorted((r.name, r.cue_no, r.start_ms, r.end_ms, r.text) for r in got.collect()) == [(n, c, a, b, t) for n, c, a, b, t in rows]
    if charset == "UTF-8":
        assert (tmp_path / "out/a.srt").read_bytes() == "1\n00:00:00,000 --> 00:00:01,500\nÜnï\nzwei\n\n2\n00:00:01,500 --> 01:02:03,004\n\n".encode()
        by_text = text_files.read_srt(spark, path).join(text_files.read_files(spark, path, "*.srt").select("file_id", F.element_at(F.split("path", "/"), -1).alias("name")), "file_id")
        columns = ["name", "cue_no", "src_number", "start_ms", "end_ms", "text", "malformed"]
        assert sorted(map(repr, by_text.select(columns).collect())) == sorted(map(repr, got.select(columns).collect()))


def test_odd_files_read_as_by_the_operators(spark, tmp_path):
    odd = ["", "\n\n", "1\n00:00:01,00 --> 00:00:02,000\nx\n\n\n\nfoo\nbar\nbaz\nqux\n\n12abc\n00:00:01.000 --> 00:00:02.000\n", " 7\r\n00:00:01,000 --> 00:00:02,000 X1\r\ntext\r\n\r\n", "1\n\n2"]
    for n, text in enumerate(odd):
        (tmp_path / f"{n}.srt").write_bytes(text.encode())
    columns = ["cue_no", "src_number", "start_ms", "end_ms", "text", "malformed"]
    got = srt_format.read_srt_files(spark, str(tmp_path)).select(columns)
    want = text_files.read_srt(spark, str(tmp_path)).select(columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_nothing_is_replaced_and_nothing_is_left(spark, tmp_path):
    path = str(tmp_path / "out")
    srt_format.write_srt_files(frame(spark, CUES[:2]), path)
    before = (tmp_path / "out/a.srt").read_bytes()
    with pytest.raises(Exception, match="a.srt already"):
        srt_format.write_srt_files(frame(spark), path)
    assert os.listdir(path) == ["a.srt"] and (tmp_path / "out/a.srt").read_bytes() == before
    srt_format.write_srt_files(frame(spark, CUES[2:]), path)
    assert len(os.listdir(path)) == 3
    with pytest.raises(Exception, match="never replaced"):
        frame(spark).write.format("srt").mode("overwrite").save(path)


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="no name for a file"):
        srt_format.write_srt_files(frame(spark, [*CUES, ("../x.srt", 1, 0, 1, "")]), path)
    assert not os.path.exists(path) or os.listdir(path) == []
    spark.dataSource.register(srt_format.SrtFormat)
    with pytest.raises(Exception, match="in two tasks|not together|not in order"):
        frame(spark, [("a.srt", n, 0, 1, "") for n in range(40)]).repartition(2, "cue_no").write.format("srt").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    with pytest.raises(Exception, match="need"):
        frame(spark).drop("text").write.format("srt").mode("append").save(path)
    with pytest.raises(Exception, match="has no mark"):
        srt_format.write_srt_files(frame(spark), path, "cp1252", True)
