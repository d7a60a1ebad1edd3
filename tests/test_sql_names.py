from pyspark.sql import functions as F

from cueloom.functions import sql_names, timecode
from cueloom.operators import binary_streams as bs


def test_scalars_equal_the_column_functions(spark):
    sql_names.register(spark)
    rows = spark.createDataFrame([(x, t) for x in (0, 1, 999, -1, -3_723_004, 359_999_999, None) for t in ("01:02:03,004", "-1:00:00.5", "x", "", None, "01_02_03_004")], "ms long, t string")
    got = rows.selectExpr("ms_clock(ms) AS a", "clock_ms(t) AS b", "ticks_ms(ms) AS c")
    want = rows.select(timecode.ms_to_clock(F.col("ms")).alias("a"), timecode.clock_to_ms(F.col("t")).alias("b"), timecode.ticks_to_ms(F.col("ms")).alias("c"))
    assert got.collect() == want.collect()


def test_table_functions_on_odd_contents(spark):
    sql_names.register(spark)
    packet = bytes.fromhex("47410130" + "B7" + "00" + "FF" * 182)
    half = bytes.fromhex("47010120" + "B7" + "00" + "FF" * 182)
    frame = spark.createDataFrame([(1, bytearray(packet + half)), (2, None), (3, bytearray(b"")), (4, bytearray(b"junk"))], "file_id long, content binary")
    for name in sql_names.TABLES:
        rows = spark.sql(f"SELECT file_id, x.* FROM {{f}} f, LATERAL {name}(f.content) x", f=frame).collect()
        assert {r.file_id for r in rows} <= {1}
    got = spark.sql("SELECT p.* FROM {f} f, LATERAL ts_packets(f.content) p ORDER BY p.pkt_no", f=frame).collect()
    want = bs.ts_packets(frame).orderBy("pkt_no").collect()
    columns = ["pkt_no", "tei", "pusi", "pid", "tsc", "afc", "cc", "payload"]
    assert [[r[c] for c in columns] for r in got] == [[r[c] for c in columns] for r in want]
