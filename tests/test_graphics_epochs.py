import random
import time

import pytest
from pyspark.sql import functions as F

from cueloom.functions import binary
from cueloom.operators import binary_streams as bs


def segment(kind, ms, body=b""):
    return b"PG" + (ms * 90).to_bytes(4, "big") + bytes(4) + bytes([kind]) + len(body).to_bytes(2, "big") + body


def composition(ms, state, palette, objects):
    head = bytes.fromhex("07800438100001") + bytes([state, 0, palette, len(objects)])
    return segment(0x16, ms, head + b"".join(bytes([0, o, 0, 0, 0, 16, 0, 32]) for o in objects))


def stream(rng, n):
    """Segments, and what each composition's objects are drawn with: {(segment, object): (colours of the line)}."""
    out, want, no = b"", {}, 0
    objects, palettes = {}, {}
    for k in range(n):
        state = 0x80 if k == 0 else rng.choice([0] * 9 + [0x40, 0x80])
        if state == 0x80:
            objects = {}
        if state in (0x40, 0x80):
            palettes = {}
        palette, shown = rng.randrange(2), [rng.randrange(3) for _ in range(rng.choice([0, 1, 2]))]
        out += composition(k * 100, state, palette, shown)
        no += 1
        at = no
        for _ in range(rng.choice([0, 1, 2])):
            which, entries = rng.randrange(2), {rng.randrange(1, 5): rng.randrange(16, 236) for _ in range(2)}
            out += segment(0x14, k * 100, bytes([which, 0]) + b"".join(bytes([e, y, 128, 128, 255]) for e, y in entries.items()))
            palettes.setdefault(which, {}).update(entries)
            no += 1
        for _ in range(rng.choice([0, 1])):
            which, line = rng.randrange(3), [rng.randrange(1, 5) for _ in range(3)]
            rle = bytes(line) + b"\0\0"
            out += segment(0x15, k * 100, bytes([0, which, 0, 0xC0]) + (len(rle) + 4).to_bytes(3, "big") + bytes([0, 3, 0, 1]) + rle)
            objects[which] = line
            no += 1
        out += segment(0x80, k * 100)
        no += 1
        for i, o in enumerate(shown):
            if o in objects:
                want[at, i] = [palettes.get(palette, {}).get(c) for c in objects[o]]
    return out, want


@pytest.mark.parametrize("seed", [1, 2])
def test_pictures_equal_a_player(spark, seed):
    rng = random.Random(seed)
    streams = {f: stream(rng, 40) for f in (1, 2)}
    files = spark.createDataFrame([(f, s[0]) for f, s in streams.items()], "file_id long, content binary")
    segments = bs.pgs_segments(files)
    # what the colour functions make of each luma
    lumas = {r.y: r.rgba for r in bs.pgs_colours(segments).select("y", "rgba").distinct().collect()}
    got = {(r.file_id, r.seg_no, r.object_no): list(r.rows) for r in bs.pgs_pictures(segments).collect()}
    want = {(f, *at): ["".join("00000000" if y is None else lumas[y] for y in line)] for f, s in streams.items() for at, line in s[1].items()}
    assert len(want) > 30 and got == want


def test_lines_of_runs(spark):
    rng = random.Random(0)
    runs = [(rng.randrange(6), rng.randrange(4), line) for line in (0, 0, 1, 3, 3, 3) for _ in range(3)]
    rows = spark.createDataFrame([(runs, ["aa", "bb", None, "dd"]), (None, ["aa"]), ([], ["aa"]), (runs, None)], "runs array<struct<color:int,length:int,line:int>>, palette array<string>")
    got = [r[0] for r in rows.select(binary.pixel_rows(F.col("runs"), F.col("palette"), "--")).collect()]
    names = {0: "aa", 1: "bb", 3: "dd"}
    assert got == [["".join(names.get(c, "--") * n for c, n, at in runs if at == i) for i in range(4)], None, None, None]


def test_time_grows_with_the_lines(spark):
    def seconds(lines):
        runs = F.expr(f"flatten(transform(sequence(0, {lines - 1}), l -> transform(sequence(0, 39), c -> named_struct('color', c, 'length', 5, 'line', l))))")
        frame = spark.range(1).select(runs.alias("runs"))
        began = time.perf_counter()
        frame.select(binary.pixel_rows(F.col("runs"), F.array(*[F.lit("0A0B0C")] * 40)).alias("r")).selectExpr("size(r)").collect()
        return time.perf_counter() - began

    seconds(100)
    assert seconds(2000) < 10
