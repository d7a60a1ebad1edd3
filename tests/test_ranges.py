import random
import time

import pytest
from pyspark.sql import functions as F

from cueloom.operators import cues as ops


def cues(spark, seed):
    rng, rows = random.Random(seed), []
    for file_id, n in ((1, 120), (2, 7), (3, 1), (4, 40)):
        at = 0
        for no in range(1, n + 1):
            if rng.random() < 0.1:
                continue  # numbers may have gaps
            at += rng.choice([0, 0, 0, 3, -5])
            rows.append((file_id, no, at, at + rng.choice([10, 10, 0]), rng.choice(["a", "a", "b", "", None]), rng.choice([no, no, no + 1, 1])))
            at += 10
    rows += [(9, 5, None, None, "x", None), (9, 6, 4, 4, "x", 2)]
    return spark.createDataFrame(rows, "file_id long, cue_no int, start_ms long, end_ms long, text string, src_number int").repartition(3)


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("size", [1, 3, 16, 1000])
def test_ranges_give_what_files_give(spark, size):
    frame = cues(spark, size)
    plain = frame.drop("src_number")
    assert rows_of(ops.combine(plain, size)) == rows_of(ops.combine(plain))
    assert rows_of(ops.reorder(plain, size * 7)) == rows_of(ops.reorder(plain))
    assert rows_of(ops.check_cues(frame, size)) == rows_of(ops.check_cues(frame))
    assert ops.combine(plain.limit(0), size).count() == 0


def test_one_large_file_is_many_tasks(spark):
    n = 400_000
    frame = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("file_id"), F.col("id").cast("int").alias("cue_no"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 10).alias("end_ms"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("text"))
    began = time.perf_counter()
    out = ops.combine(frame, 10_000)
    assert out.count() == n - (n + 1) // 3
    assert time.perf_counter() - began < 60
    windows = ops.reorder(frame, 40_000)._jdf.queryExecution().executedPlan().toString()
    assert "__range" in windows
