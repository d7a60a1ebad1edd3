"""The library's functions under names for SQL: table functions over the bytes of a stream, and scalar functions.

``register(spark)`` once; then for example ``SELECT f.file_id, s.* FROM files f, LATERAL pgs_segments(f.content) s``. A null content
gives no rows. Bytes that are no record are skipped, as in the sources of byte ranges.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cueloom.functions import encoding
from cueloom.operators.binary_streams import pgs_time
from cueloom.sources.stream_files import KINDS, records


def _records(content: bytes | None, kind: str) -> Iterator[tuple[int, int, bytes]]:
    data = bytes(content or b"")
    for no, (at, record) in enumerate(records(io.BytesIO(data), len(data), KINDS[kind], 0, len(data)), 1):
        yield no, at, record


class PgsSegments:
    """Segments of presentation graphics, as pgs_segments() has them; about_ms may be given as there."""

    def eval(self, content: bytes, about_ms: int | None = None):
        near = None if about_ms is None else about_ms * 90
        for no, at, d in _records(content, "pgs"):
            pts, dts, *rest = KINDS["pgs"].fields(d)
            if near is not None:
                near = pts = pgs_time(pts, near)
                dts = pgs_time(dts, near) if dts else 0
            yield no, at, pts, dts, *rest


class VobPackets:
    """Packets of a program stream, as ps_packets() has them."""

    def eval(self, content: bytes):
        for no, at, d in _records(content, "ps"):
            yield no, at, *KINDS["ps"].fields(d)


class TsPackets:
    """Packets of a transport stream with the fields of their four bytes and their payload, numbered from 0."""

    def eval(self, content: bytes):
        for no, at, d in _records(content, "ts"):
            head = int.from_bytes(d[:4], "big")
            control = head >> 4 & 3
            start = (5 + d[4] if control & 2 else 4) if control & 1 else len(d)
            yield no - 1, at, head >> 23 & 1, head >> 22 & 1, head >> 8 & 0x1FFF, head >> 6 & 3, control, head & 15, d[start:] if control & 1 else None


class DvbSegments:
    """Segments of a subtitling payload, as dvb_segments() has them."""

    def eval(self, payload: bytes):
        data, at, no = bytes(payload or b""), 2, 0
        while at + 6 <= len(data) and data[at] == 0x0F:
            size = int.from_bytes(data[at + 4 : at + 6], "big")
            yield no, data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big"), data[at + 6 : at + 6 + size]
            at, no = at + 6 + size, no + 1


TABLES = {
    "pgs_segments": (PgsSegments, "seg_no int, pos long, pts long, dts long, type int, body binary"),
    "vob_packets": (VobPackets, "pkt_no int, pos long, kind int, data binary"),
    "ts_packets": (TsPackets, "pkt_no int, pos long, tei int, pusi int, pid int, tsc int, afc int, cc int, payload binary"),
    "dvb_segments": (DvbSegments, "seg_no int, type int, page_id int, body binary"),
}
#: Scalar functions, in SQL, so that they stay in the JVM: arguments, result, and body.
SCALARS = {
    "clock_ms": ("t STRING", "BIGINT", r"CASE WHEN t RLIKE '^-?\\d+[:_]\\d\\d[:_]\\d\\d[,.:_]\\d{1,3}' THEN IF(t LIKE '-%', -1, 1) * (((CAST(regexp_extract(t, '(\\d+)[:_]', 1) AS BIGINT) * 60 + CAST(regexp_extract(t, '[:_](\\d\\d)[:_]', 1) AS BIGINT)) * 60 + CAST(regexp_extract(t, '[:_]\\d\\d[:_](\\d\\d)', 1) AS BIGINT)) * 1000 + CAST(regexp_extract(t, '[:_]\\d\\d[:_]\\d\\d[,.:_](\\d{1,3})', 1) AS BIGINT)) END"),
    "ms_clock": ("ms BIGINT", "STRING", "concat(IF(ms < 0, '-', ''), format_string('%02d:%02d:%02d,%03d', abs(ms) div 3600000, abs(ms) div 60000 % 60, abs(ms) div 1000 % 60, abs(ms) % 1000))"),
    "ticks_ms": ("ticks BIGINT", "BIGINT", "(ticks + 45) div 90"),
    "strip_tags": ("t STRING", "STRING", "regexp_replace(t, '</?[A-Za-z][^<>]*>', '')"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known in a session, as temporary ones."""
    for name, (table, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(table, returnType=schema))
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udf.register("detect_encoding", encoding.detect_udf())
