"""Operators with state give the rows of the batch operators, however the rows are cut into batches, and keep nothing in the end."""

import random

import pytest

from cueloom.operators import binary_streams as bs
from cueloom.operators import cues as ops
from cueloom.streaming import incremental


def streamed(spark, folder, batches, schema, operator, name):
    """Rows of operator over one file a batch, and how many values its state keeps at the end."""
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).repartition(2).coalesce(1).write.parquet(str(folder / "in" / f"{i:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in" / "*"))
    query = operator(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "c")).start()
    query.processAllAvailable()
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    return spark.table(name), kept


def cut(rng, rows, parts):
    at = sorted(rng.sample(range(1, len(rows)), parts - 1))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)], strict=True)]


def section(rng, number):
    body = bytes(rng.randrange(256) for _ in range(rng.choice([5, 20, 200, 900])))
    size = len(body) + 4
    return bytes([number % 64, 0xB0 | size >> 8, size & 255]) + body + b"CRC!"


def table_packets(rng, file_id, pid, first):
    """Packets of 184 bytes with sections one behind the other, pointers, stuffing, and a section that the end cuts."""
    data, begins = b"", []
    for n in range(12):
        begins.append(len(data))
        data += section(rng, n)
    rows, at, no = [], 0, first
    while at < len(data):
        here = [b for b in begins if at <= b < at + 183]
        if here and len(rows) % 5 != 4 or not rows:
            pointer = (here[0] - at) if here else 0
            payload = bytes([pointer]) + data[at : at + 183]
            at += 183
            rows.append((file_id, pid, no, 1, bytearray(payload)))
        else:
            rows.append((file_id, pid, no, 0, bytearray(data[at : at + 184])))
            at += 184
        no += 3
    return rows[:-1] if pid == 17 else rows


@pytest.mark.parametrize("parts", [1, 4])
def test_sections_and_units(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [r for f, p in ((1, 0), (1, 17), (2, 0)) for r in table_packets(rng, f, p, p)]
    rows.sort(key=lambda r: (r[2], r[0], r[1]))
    rows.insert(3, (1, 0, rows[2][2], 0, bytearray(b"")))
    schema = "file_id long, pid long, pkt_no long, pusi long, payload binary"
    batch = spark.createDataFrame(rows, schema)
    ends = [(f, p, 1 << 40, 0, None) for f, p in ((1, 0), (1, 17), (2, 0), (3, 9))]
    got, kept = streamed(spark, tmp_path / "s", [*cut(rng, rows, parts), ends], schema, incremental.sections_stream, f"sections{parts}")
    columns = ["file_id", "pid", "section_no", "pkt_no", "table_id", "body"]
    want = bs.psi_sections(batch).select(columns)
    assert want.count() > 20 and kept == 0
    assert sorted(map(repr, got.select(columns).collect())) == sorted(repr(r).replace("bytearray", "bytearray") for r in want.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_cues(spark, tmp_path, parts):
    rng, rows = random.Random(parts), []
    for file_id in (1, 2, 3):
        at = 0
        for no in range(25):
            at += rng.choice([0, 0, 5])
            rows.append((file_id, no, at, at + 10, rng.choice("aab")))
            at += 10
    rows.sort(key=lambda r: r[2])
    schema = "file_id long, cue_no long, start_ms long, end_ms long, text string"
    ends = [(f, 999, 1 << 40, 1 << 40, None) for f in (1, 2, 3)]
    got, kept = streamed(spark, tmp_path, [*cut(rng, rows, parts), ends], schema, incremental.combine_stream, f"cues{parts}")
    want = ops.combine(spark.createDataFrame(rows, schema))
    columns = ["file_id", "start_ms", "end_ms", "text"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect())) and kept == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_epochs(spark, tmp_path, parts):
    rng, rows = random.Random(parts), []
    for file_id in (1, 2):
        for no in range(30):
            n = rng.choice([0, 1, 1])
            rows.append((file_id, no, no * 100 + file_id, rng.choice([0, 0, 0, 0x40, 0x80]), n, rng.randrange(2) if n else None))
    rows.sort(key=lambda r: r[2])
    schema = "file_id long, seg_no long, pts_ms long, state long, n_objects long, object_id long"
    ends = [(f, 1 << 40, None, None, None, None) for f in (1, 2)]
    got, kept = streamed(spark, tmp_path, [*cut(rng, rows, parts), ends], schema, incremental.pgs_subtitles_stream, f"epochs{parts}")
    want = bs.pgs_subtitles(spark.createDataFrame(rows, schema)).select("file_id", "start_ms", "end_ms")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and kept == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_pages_in_any_order_within_the_delay(spark, tmp_path, parts):
    rng, rows = random.Random(parts), []
    for file_id in (1, 2):
        at = 0
        for no in range(20):
            at += rng.choice([400, 900, 2500])
            rows.append((file_id, 7, 1, no, at, rng.choice([0, 1, 2]), rng.choice([0, 1, 2])))
        rows.append((file_id, 7, 1, 99, at + 3000, 1, 0))
    schema = "file_id long, pid long, page_id long, unit long, pts_ms long, timeout_s int, n_regions int"
    # up to two seconds late, in one order for all files
    arrived = sorted(rows, key=lambda r: r[4] + rng.randrange(2000))
    last = [(9, 7, 1, 0, 10_000_000, 0, 0)]
    got, kept = streamed(spark, tmp_path, [*cut(rng, arrived, parts), last, [(9, 7, 1, 1, 10_000_001, 0, 0)]], schema, lambda s: incremental.dvb_pages_stream(s, "2 seconds"), f"pages{parts}")
    want = bs.dvb_subtitles(spark.createDataFrame(rows, schema))
    columns = ["file_id", "page_id", "start_ms", "end_ms"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    # what is left waits for the watermark: the two compositions of the last file
    assert kept <= 6
