"""Queries on keys as large tables have them, and what their plans send through the driver."""

import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cueloom.functions import timecode
from cueloom.operators import binary_streams as bs
from cueloom.plans import file_queries, text_queries
from tests.comparing import TABLES, same_rows

QUERIES = {**text_queries.QUERIES, **file_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **file_queries.ORACLES}
#: Keys with stamps on both sides of 32 bits, and of 33 where times are long.
LARGE = {"customer": ("c_custkey", [1, 477_190, 477_205, 477_217, 477_218, 477_219, 900_000]), "orders": ("o_orderkey", [1, 73_362, 73_363, 3_670_850, 8_999_999])}


@pytest.fixture(scope="module")
def large_dir(tmp_path_factory, sf_dir):
    folder = tmp_path_factory.mktemp("large")
    for name in TABLES:
        if name in LARGE:
            key, values = LARGE[name]
            pq.write_table(pa.table({key: pa.array(values, pa.int64())}), folder / f"{name}.parquet")
        else:
            os.symlink(f"{sf_dir}/{name}.parquet", folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["byte_patch", "pgs_pictures", "pgs_sync", "ms_to_pes_bytes", "ms_to_u32_bytes", "pgs_boundaries", "pgs_segments", "sql_pgs_segments"])
def test_large_keys(spark, large_dir, name):
    same_rows(QUERIES[name](spark, large_dir), ORACLES[name], large_dir)


def test_stamps_begin_anew(spark):
    row = spark.range(1).select(
        timecode.ms_to_u32(F.lit(50_000_000)).alias("u32"),
        *[timecode.unwrapped(F.lit(t), F.lit(n), 32).alias(f"t{i}") for i, (t, n) in enumerate(((5, 1 << 32), (0xFFFFFFFF, 1 << 32), (0xFFFFFFFF, 0), (7, 3 << 32)))],
    ).first()
    assert row.u32 == "10C388D00"
    assert [row[f"t{i}"] for i in range(4)] == [(1 << 32) + 5, 0xFFFFFFFF, 0xFFFFFFFF, (3 << 32) + 7]
    stamp = lambda t: b"PG" + (t & 0xFFFFFFFF).to_bytes(4, "big") + bytes(4) + b"\x80\0\0"
    times = [(1 << 32) - 90, (1 << 32) + 90, 5 << 30, 7 << 30, (1 << 33) + 1]
    files = spark.createDataFrame([(1, b"".join(map(stamp, times)), 40_000_000), (2, stamp(9), None)], "file_id long, content binary, about_ms long")
    assert [r.pts for r in bs.pgs_segments(files).orderBy("file_id", "seg_no").collect()] == [*times, 9]
    assert [r.pts for r in bs.pgs_segments(bs.pgs_retimed(files, 1)).orderBy("file_id", "seg_no").collect()] == [*[t + 90 for t in times], 99]


@pytest.mark.parametrize("name,broadcasts", [("byte_patch", 0), ("dvb_compositions", 1), ("pgs_pictures", 0), ("pgs_sync", 0), ("vob_images", 0), ("vob_retime", 0), ("vob_colour_changes", 0), ("dvb_display_sets", 0), ("pid_classify", 0)])
def test_no_relation_of_a_stream_goes_through_the_driver(spark, sf_dir, name, broadcasts):
    """Default colours of DVB alone do, a fixed table."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"BroadcastExchange", plan)) == broadcasts


def test_colour_changes_decode_each_unit_once(spark, sf_dir):
    plan = QUERIES["vob_colour_changes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_documents_in_all_encodings_are_dealt_out(spark, sf_dir):
    written = file_queries._written(spark, sf_dir)
    assert written.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_documents_are_written_once_a_script(spark, sf_dir):
    """Letters are replaced by tables, below the step that makes a row for each encoding of a script."""
    plan = file_queries._written(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    encodings, scripts = (i for i, line in enumerate(plan.splitlines()) if "Generate explode" in line)
    written = next(i for i, line in enumerate(plan.splitlines()) if "ArrowEvalPython [_in_script" in line)
    assert encodings < written < scripts and "regexp_replace" not in plan


def test_letters_of_a_script(spark):
    texts = ["Añb, É 1\n😀 дё", "", "ZИzﬁ"]
    frame = spark.createDataFrame([(t, s) for t in texts for s in file_queries._SCRIPTS] + [("a", "latin"), (None, "thai")], "text string, script string")
    for r in frame.select("text", "script", file_queries._in_script("text", "script").alias("out")).collect():
        letters = file_queries._SCRIPTS.get(r.script)
        small = None if letters is None or r.text is None else r.text.lower().translate(str.maketrans(file_queries._LETTERS, letters))
        assert r.out == (None if small is None else re.sub(f"[^\\x00-\\x7F{letters}]", "", small))


def test_size_of_chapters_beyond_a_hundred_hours(spark, tmp_path):
    """The size is that of the file, with all digits of the hours."""
    pq.write_table(pa.table({"p_partkey": pa.array([1, 479_999, 480_000, 1_200_000], pa.int64())}), tmp_path / "part.parquet")
    rows = QUERIES["chapters_xml"](spark, str(tmp_path)).collect()
    size = {r.file_id: r.size - len(r.starts) for r in rows}
    assert len(set(size.values())) == 1 and {r.file_id: len(r.starts) for r in rows} == {1: 51, 479_999: 51, 480_000: 52, 1_200_000: 53}
