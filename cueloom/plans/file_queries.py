"""Queries over files and streams made from the driver's tables: text formats, binary formats, encodings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import binary, bytepairs, encoding, markup, sql_names, timecode
from cueloom.operators import binary_streams as bs
from cueloom.operators import cues as ops
from cueloom.operators import dictionaries, pictures
from cueloom.plans.adapters import cues_conv, table, with_adapters
from cueloom.sources import sinks, text_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLES[name] = with_adapters(sql)


# SubRip files written and read again, texts by name, text blocks


def _srt_files(s: SparkSession, d: str) -> DataFrame:
    return sinks.srt_text(cues_conv(s, d).withColumn("text", F.regexp_replace("text", "\n{2,}", "\n")), mark=1)


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    texts = text_files.as_text(_srt_files(s, d))
    cues = text_files.srt_cues(text_files.srt_blocks(texts)).join(texts.select("file_id", "bom_id"), "file_id")
    return cues.select("file_id", "cue_no", "src_number", "start_ms", "end_ms", "text", "malformed", "bom_id")


_NUM = "row_number() OVER (PARTITION BY file_id ORDER BY cue_no)"
add("srt_round_trip", _round_trip, f"SELECT file_id, {_NUM} AS cue_no, cue_no AS src_number, start_ms, end_ms, regexp_replace(text, '\\n{{2,}}', chr(10), 'g') AS text, false AS malformed, 1 AS bom_id FROM cues_conv")
add(
    "txt2srt_ordinal",
    lambda s, d: ops.times_and_texts(cues_conv(s, d), text_files.text_blocks(_joined_texts(s, d))),
    f"SELECT file_id, {_NUM} AS cue_no, start_ms, end_ms, regexp_replace(text, '\\n{{2,}}', chr(10), 'g') AS text, true AS matched FROM cues_conv",
)


def _joined_texts(s: SparkSession, d: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("cue_no", F.regexp_replace("text", "\n{2,}", "\n").alias("t"))))
    return cues_conv(s, d).groupBy("file_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("text"))


def _named(s: SparkSession, d: str) -> DataFrame:
    stamp = lambda c: F.translate(timecode.ms_to_clock(F.col(c), "_"), ":", "_")
    path = F.concat(F.lit("/subs/"), stamp("start_ms"), F.lit("__"), stamp("end_ms"), F.lit(".txt"))
    return cues_conv(s, d).select("file_id", path.alias("path"), F.encode(F.concat("text", F.lit("\r\n")), "UTF-8").alias("content"))


add("file_list_cues", lambda s, d: text_files.named_cues(_named(s, d)), f"SELECT file_id, {_NUM}::INT AS cue_no, start_ms, end_ms, text FROM cues_conv")


def _ssa_texts(s: SparkSession, d: str) -> DataFrame:
    head = "[Script Info]\nTitle: x\n\n[V4+ Styles]\nFormat: Name, Fontname, PrimaryColour, Bold, Italic, Underline, StrikeOut, Alignment\nStyle: Default,Arial,&H000000FF,-1,0,0,0,2\nStyle: Top,Arial,&H0000FF00,0,-1,0,0,6\n\n[Events]\nFormat: Layer, Start, End, Style, Name, Text\n"
    clock = lambda c: F.expr(f"substring(format_string('%02d:%02d:%02d.%02d', {c} div 3600000, {c} div 60000 % 60, {c} div 1000 % 60, {c} % 1000 div 10), 2)")
    line = F.concat(F.lit("Dialogue: 0,"), clock("start_ms"), F.lit(","), clock("end_ms"), F.when(F.col("cue_no") % 2 == 0, ",Top,,").otherwise(",Default,,"), F.lit("{\\i1}"), F.replace("text", F.lit("\n"), F.lit("\\N")), F.lit(", end"))
    ordered = F.array_sort(F.collect_list(F.struct("cue_no", line.alias("l"))))
    return cues_conv(s, d).groupBy("file_id").agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda x: x["l"]), "\n"), F.lit("\n")).alias("text"))


def _ssa(s: SparkSession, d: str) -> DataFrame:
    lines = text_files.lines(_ssa_texts(s, d))
    return ops.convert_ssa(text_files.ssa_events(lines), text_files.ssa_styles(lines))


add(
    "ssa_text_convert",
    _ssa,
    f"SELECT file_id, {_NUM}::INT AS cue_no, start_ms // 10 * 10 AS start_ms, end_ms // 10 * 10 AS end_ms, CASE WHEN cue_no % 2 = 0 THEN '<font color=\"#00FF00\">{{\\an8}}<i><i>' || text || ', end</i></i></font>' ELSE '<font color=\"#FF0000\"><b><i>' || text || ', end</i></b></font>' END AS text FROM cues_conv",
)


def _overrides(s: SparkSession, d: str) -> DataFrame:
    """Eight overrides in a group, and one group right after another."""
    tags = F.lit("{\\fs20\\fnArial\\shad1\\bord2\\blur1\\i1\\b1\\an8}{\\u1\\k5}")
    return cues_conv(s, d).select("file_id", "cue_no", markup.ssa_to_srt(F.concat(tags, F.lit("x "), F.translate("text", "<>{}\\", ""), F.lit("{\\i0\\b0\\u0} end"))).alias("text"))


add("ssa_overrides", _overrides, "SELECT file_id, cue_no, '<i><b>{\\an8}<u>x ' || translate(text, '<>{}\\', '') || '</i></b></u> end' AS text FROM cues_conv")


def _idx_lines(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select((F.col("o_orderkey") % 50).alias("file_id"), "o_orderkey")
    lang = F.col("o_orderkey") % 100 >= 50
    stamp = F.concat(F.lit("timestamp: "), timecode.ms_to_clock(F.col("o_orderkey") * 40, ":"), F.format_string(", filepos: %09x", F.col("o_orderkey") * 2048))
    stamps = o.select("file_id", (F.col("o_orderkey") + F.when(lang, 10_000_000).otherwise(10)).alias("line_no"), stamp.alias("line"))
    heads = s.range(50).select(F.col("id").alias("file_id"), F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(t).alias("line")) for n, t in ((0, "# index"), (1, "size: 720x576"), (2, "palette: 000000, ff8000, 0080ff, ffffff"), (3, "id: en, index: 0"), (9_999_999, "id: fr, index: 1"))])).alias("h"))
    return stamps.union(heads.select("file_id", "h.line_no", "h.line"))


_IDX = "SELECT file_id, CASE WHEN k THEN 'fr' ELSE 'en' END AS lang, k::INT AS lang_index, row_number() OVER (PARTITION BY file_id, k ORDER BY o_orderkey)::INT AS ts_no, o_orderkey * 40 AS start_ms, o_orderkey * 2048 AS filepos FROM (SELECT o_orderkey % 50 AS file_id, o_orderkey % 100 >= 50 AS k, o_orderkey FROM orders)"
add("idx_entries", lambda s, d: text_files.idx_entries(text_files.idx_keywords(_idx_lines(s, d))), _IDX)
add("idx_palette", lambda s, d: text_files.idx_palette(text_files.idx_keywords(_idx_lines(s, d))), "SELECT f::BIGINT AS file_id, c.* FROM range(50) x(f), (VALUES (0, 0, 0, 0), (1, 255, 128, 0), (2, 0, 128, 255), (3, 255, 255, 255)) c(pal_idx, r, g, b)")
add(
    "idx_rewrite",
    lambda s, d: text_files.idx_retimed(_idx_lines(s, d), -400_000).filter("line LIKE 'timestamp%'").select("file_id", F.regexp_extract("line", "timestamp: ([^,]*),", 1).alias("stamp"), "line_no"),
    "SELECT o_orderkey % 50 AS file_id, printf('%02d:%02d:%02d:%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS stamp, o_orderkey + CASE WHEN o_orderkey % 100 >= 50 THEN 10000000 ELSE 10 END AS line_no FROM (SELECT o_orderkey, greatest(o_orderkey * 40 - 400000, 0) AS m FROM orders)",
)
add("max_stamps_by_language", lambda s, d: text_files.idx_entries(text_files.idx_keywords(_idx_lines(s, d))).groupBy("lang").agg(F.max("ts_no").alias("most"), F.countDistinct("file_id").alias("files")), f"SELECT lang, max(ts_no) AS most, count(DISTINCT file_id) AS files FROM ({_IDX}) GROUP BY lang")
add(
    "chapters_xml",
    lambda s, d: sinks.chapters_xml(ops.chapters(table(s, d, "part").select(F.col("p_partkey").alias("file_id"), (F.col("p_partkey") * 1000).cast("double").alias("duration_ms"), F.lit(4.0).alias("n")))).select("file_id", F.length("xml").cast("long").alias("size"), F.regexp_extract_all("xml", F.lit("TimeStart>([0-9][^<]*)<")).alias("starts")).select("file_id", "size", F.array_join("starts", " ").alias("starts")),
    f"SELECT p_partkey AS file_id, {len(sinks.CHAPTERS_HEAD + sinks.CHAPTERS_TAIL) + 4 * len(sinks.CHAPTER % ('00:00:00.000', 1))}::BIGINT AS size, array_to_string([printf('%02d:%02d:%02d.%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) FOR m IN [p_partkey * 250 * i FOR i IN range(4)]], ' ') AS starts FROM part",
)

# presentation graphics


def _hex(v: Column, n: int) -> Column:
    """The last n digits, as a field of that size holds them."""
    return F.substring(F.lpad(F.hex(v.cast("long")), 16, "0"), 17 - n, n)


def _pgs_files(s: SparkSession, d: str) -> DataFrame:
    def seg(kind: str, ms: Column, body: str) -> Column:
        return F.concat(F.lit("5047"), _hex(ms * 90, 8), F.lit("00000000" + kind + f"{len(body) // 2:04X}" + body))

    pcs = lambda state, obj: "07800438100001" + state + "0000" + ("00" if obj is None else f"01{obj:04X}000000100020")
    t = F.col("c_custkey") * 100
    ods = "0001" + "00" + "C0" + "00000B" + "0004" + "0002" + "0102" + "0082" + "03" + "0000" + "0004" + "0000"
    parts = [
        seg("16", t, pcs("80", 0)), seg("17", t, "010000100020000400" + "02"), seg("14", t, "0000" + "01108080FF" + "03EB8080FF"), seg("15", t, ods), seg("80", t, ""), seg("16", t + 1000, pcs("00", None)), seg("80", t + 1000, ""),
        seg("16", t + 1500, pcs("00", 1)), seg("80", t + 1500, ""), seg("16", t + 1800, pcs("00", 2)), seg("16", t + 1900, pcs("00", 2)), seg("16", t + 2500, pcs("40", None)),
    ]
    return table(s, d, "customer").select(F.col("c_custkey").alias("file_id"), F.unhex(F.concat(*parts)).alias("content"), timecode.whole_hours(t).alias("about_ms"))


add(
    "pgs_segments",
    lambda s, d: bs.pgs_segments(_pgs_files(s, d)).groupBy("file_id", "type").agg(F.count("*").alias("n"), F.min("pts").alias("first_pts"), F.sum(F.length("body")).alias("size")),
    "SELECT c_custkey AS file_id, k AS type, n::BIGINT AS n, c_custkey * 9000 AS first_pts, z::BIGINT AS size FROM customer, (VALUES (22, 6, 4 * 19 + 2 * 11), (23, 1, 10), (20, 1, 12), (21, 1, 22), (128, 3, 0)) x(k, n, z)",
)
add("pgs_boundaries", lambda s, d: bs.pgs_subtitles(bs.pgs_compositions(bs.pgs_segments(_pgs_files(s, d)))), "SELECT c_custkey AS file_id, n AS sub_no, c_custkey * 100 + a AS start_ms, c_custkey * 100 + b AS end_ms FROM customer, (VALUES (1, 0, 1000), (2, 1500, 1800), (3, 1800, 2500)) x(n, a, b)")
add("pgs_palette", lambda s, d: bs.pgs_palette_entries(bs.pgs_segments(_pgs_files(s, d))).drop("seg_no"), "SELECT c_custkey AS file_id, 0::BIGINT AS palette_id, e::BIGINT AS entry, y::BIGINT AS y, 128::BIGINT AS cr, 128::BIGINT AS cb, 255::BIGINT AS alpha FROM customer, (VALUES (1, 16), (3, 235)) x(e, y)")
add("pgs_windows", lambda s, d: bs.pgs_windows(bs.pgs_segments(_pgs_files(s, d))).drop("seg_no"), "SELECT c_custkey AS file_id, 0::BIGINT AS window_id, 16::BIGINT AS x, 32::BIGINT AS y, 4::BIGINT AS width, 2::BIGINT AS height FROM customer")


def _pgs_images(s: SparkSession, d: str) -> DataFrame:
    objects = bs.pgs_objects(bs.pgs_segments(_pgs_files(s, d))).withColumn("runs", binary.decode_pgs("rle"))
    palette = F.array(*[F.lit(x) for x in ("000000", "102030", "405060", "FFFFFF")])
    objects = objects.withColumn("rows", binary.pixel_rows(F.col("runs"), palette))
    return objects.select("file_id", "object_id", "width", "height", F.array_join("rows", "/").alias("rows"), F.hex(sinks.bmp(F.col("width"), F.col("height"), F.slice("rows", 1, 2))).alias("bmp"))


_ROWS = "102030" + "405060" + "FFFFFF" * 2, "000000" * 4
_BMP = "424D4E000000000000003600000028000000040000000200000001001800000000001800000" "0C21E0000C21E00000000000000000000" + "000000" * 4 + "302010" + "605040" + "FFFFFF" * 2
add("pgs_images", _pgs_images, f"SELECT c_custkey AS file_id, 1::BIGINT AS object_id, 4::BIGINT AS width, 2::BIGINT AS height, '{_ROWS[0]}/{_ROWS[1]}' AS rows, '{_BMP}' AS bmp FROM customer")


def _pgs_retimed(s: SparkSession, d: str) -> DataFrame:
    files = _pgs_files(s, d)
    moved = bs.pgs_retimed(files, -300)
    return bs.pgs_subtitles(bs.pgs_compositions(bs.pgs_segments(moved)))


add("byte_patch", _pgs_retimed, "SELECT c_custkey AS file_id, n AS sub_no, greatest(c_custkey * 100 + a - 300, 0) AS start_ms, greatest(c_custkey * 100 + b - 300, 0) AS end_ms FROM customer, (VALUES (1, 0, 1000), (2, 1500, 1800), (3, 1800, 2500)) x(n, a, b)")



def _pgs_two_epochs(s: SparkSession, d: str) -> DataFrame:
    """Two objects in a composition, one cropped; then a palette changed; then an epoch that clears both."""
    def seg(kind: str, ms: int, body: str) -> Column:
        t = F.col("c_custkey") * 100 + ms
        return F.concat(F.lit("5047"), _hex(t * 90, 8), F.lit("00000000" + kind + f"{len(body) // 2:04X}" + body))

    pcs = lambda state, *objects: "07800438100001" + state + "0000" + f"{len(objects):02X}" + "".join(objects)
    two = ("00010000" + "00100020", "00020140" + "00300040" + "0001000000020001")
    ods = lambda no, width, rle: f"{no:04X}00C0{len(rle) // 2 + 4:06X}{width:04X}0001{rle}"
    parts = [
        seg("16", 0, pcs("80", *two)), seg("14", 0, "0000" + "01108080FF" + "02EB808080"), seg("15", 0, ods(1, 2, "01020000")), seg("15", 0, ods(2, 3, "0102020000")), seg("80", 0, ""),
        seg("16", 500, pcs("00", two[0])), seg("14", 500, "0001" + "01EB8080FF"), seg("80", 500, ""),
        seg("16", 900, pcs("80", two[0])), seg("15", 900, ods(1, 1, "020000")), seg("80", 900, ""),
        seg("16", 1200, pcs("00", two[1])), seg("80", 1200, ""),
    ]
    files = table(s, d, "customer").select(F.col("c_custkey").alias("file_id"), F.unhex(F.concat(*parts)).alias("content"), timecode.whole_hours(F.col("c_custkey") * 100).alias("about_ms"))
    out = bs.pgs_pictures(bs.pgs_segments(files))
    return out.select("file_id", "seg_no", "object_no", "pts_ms", "x", "y", "width", "height", F.array_join("rows", "/").alias("rows"), F.array_join(sinks.premultiplied(F.col("rows")), "/").alias("premultiplied"))


add(
    "pgs_pictures",
    _pgs_two_epochs,
    "SELECT c_custkey AS file_id, n AS seg_no, o AS object_no, c_custkey * 100 + t AS pts_ms, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS width, 1::BIGINT AS height, r AS rows, p AS premultiplied FROM customer, "
    "(VALUES (1, 0, 0, 16, 32, 2, '000000FFFFFFFF80', '000000808080'), (1, 1, 0, 48, 64, 2, 'FFFFFF80FFFFFF80', '808080808080'), (6, 0, 500, 16, 32, 2, 'FFFFFFFFFFFFFF80', 'FFFFFF808080'), (9, 0, 900, 16, 32, 1, '00000000', '000000')) v(n, o, t, x, y, w, r, p)",
)


def _pgs_synced(s: SparkSession, d: str) -> DataFrame:
    files = _pgs_files(s, d)
    moved = bs.pgs_retimed(files, bs.on_line(0, 1000, 500, 2500))
    return bs.pgs_subtitles(bs.pgs_compositions(bs.pgs_segments(moved)))


add("pgs_sync", _pgs_synced, "SELECT c_custkey AS file_id, n AS sub_no, 500 + 2 * (c_custkey * 100 + a) AS start_ms, 500 + 2 * (c_custkey * 100 + b) AS end_ms FROM customer, (VALUES (1, 0, 1000), (2, 1500, 1800), (3, 1800, 2500)) x(n, a, b)")

# program streams


def _vob_files(s: SparkSession, d: str) -> DataFrame:
    spu = "0020" + "0010" + "C0" + "44" * 11 + "0000" + "0010" + "03" + "3210" + "04" + "FFF0" + "01" + "02" + "FF" + "0000" + "00"
    spu = spu[: 32 * 2]
    ms = F.col("p_partkey") * 40
    pack = F.lit("000001BA" + "440004000401" + "0189C3" + "F8")
    cut = 40
    first = F.concat(F.lit(f"000001BD{3 + 5 + 1 + cut // 2:04X}818005"), timecode.ms_to_pes_stamp(ms), F.lit("20" + spu[:cut]))
    rest = spu[cut:]
    second = F.lit(f"000001BD{3 + 1 + len(rest) // 2:04X}810000" + "20" + rest)
    return table(s, d, "part").select(F.col("p_partkey").alias("file_id"), F.unhex(F.concat(pack, first, pack, second, F.lit("000001B9"))).alias("content"))


add("vob_packets", lambda s, d: bs.ps_packets(_vob_files(s, d)).groupBy("file_id", "kind").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")), "SELECT p_partkey AS file_id, k AS kind, n::BIGINT AS n, p::BIGINT AS first_pos FROM part, (VALUES (186, 2, 0), (189, 2, 14), (185, 1, 85)) x(k, n, p)")


def _vob_retimed(s: SparkSession, d: str) -> DataFrame:
    files = _vob_files(s, d)
    moved = bs.apply_changes(files, bs.pes_changes(bs.ps_packets(files), -2000))
    return bs.sub_pictures(bs.pes_payloads(bs.ps_packets(moved))).select("file_id", "substream", "pts_ms")


add("vob_retime", _vob_retimed, "SELECT p_partkey AS file_id, 32::BIGINT AS substream, greatest(p_partkey * 40 - 2000, 0) AS pts_ms FROM part")


def _vob_indexed(s: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    entries = table(s, d, "part").select(key.alias("file_id"), F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(i).alias("lang_index"), F.lit(1).alias("ts_no"), (F.col("p_partkey") * 40 + i).alias("start_ms"), F.lit(p).cast("long").alias("filepos")) for x, i, p in (("en", 0, 14), ("fr", 1, 85))])).alias("e")).select("file_id", "e.*")
    return bs.indexed_packets(entries, bs.ps_packets(_vob_files(s, d)))


add("idx_packets", _vob_indexed, "SELECT p_partkey AS file_id, v.n AS pkt_no, v.p::BIGINT AS pos, v.k AS kind, v.l AS lang, v.i AS lang_index, CASE WHEN v.l IS NOT NULL THEN 1 END AS ts_no, p_partkey * 40 + v.i AS start_ms FROM part, (VALUES (1, 0, 186, NULL, NULL), (2, 14, 189, 'en', 0), (3, 49, 186, 'en', 0), (4, 63, 189, 'en', 0), (5, 85, 185, 'fr', 1)) v(n, p, k, l, i)")


def _pictures(s: SparkSession, d: str) -> DataFrame:
    spu = bs.sub_pictures(bs.pes_payloads(bs.ps_packets(_vob_files(s, d))))
    commands = F.transform(bs.control_commands("data", F.col("control_at").cast("int")), lambda c: c["command"].cast("string"))
    return spu.select("file_id", "substream", "pts_ms", "size", "control_at", F.length("data").cast("long").alias("have"), F.array_join(commands, ",").alias("commands"))


add("vob_sub_pictures", _pictures, "SELECT p_partkey AS file_id, 32::BIGINT AS substream, p_partkey * 40 AS pts_ms, 32::BIGINT AS size, 16::BIGINT AS control_at, 32::BIGINT AS have, '3,4,1,2' AS commands FROM part")

# transport streams

add(
    "ts_header_bits",
    lambda s, d: bs.ts_fields(table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("pkt_no"), F.unhex(F.concat(_hex(F.lit(0x47000000) + F.col("l_partkey") * 7919 % 16777216, 8), F.lit("00"))).alias("data"))).select("file_id", "pkt_no", "tei", "pusi", "priority", "pid", "tsc", "afc", "cc"),
    "SELECT l_orderkey AS file_id, l_linenumber AS pkt_no, (h >> 23) & 1 AS tei, (h >> 22) & 1 AS pusi, (h >> 21) & 1 AS priority, (h >> 8) & 8191 AS pid, (h >> 6) & 3 AS tsc, (h >> 4) & 3 AS afc, h & 15 AS cc FROM (SELECT *, l_partkey * 7919 % 16777216 AS h FROM lineitem)",
)


def _ts_files(s: SparkSession, d: str) -> DataFrame:
    packet = lambda body: F.rpad(body, 376, "F")
    k = F.col("s_suppkey")
    page = lambda ms, timeout, regions: F.concat(
        F.lit("47410110" + "000001BD" + ("001F" if regions else "0019") + "808005"), timecode.ms_to_pes_stamp(ms), F.lit("2000" + "0F100001" + ("0008" if regions else "0002")), _hex(timeout, 2), F.lit("08" + ("000000100020" if regions else "") + "0F8000010000" + "FF")
    )
    sdt = "42" + "F017" + "0001C10000" + "0001FF" + "0001" + "FC" + "8006" + "4804" + "01" + "0141" + "00" + "00000000"
    sdt = "42" + f"F0{8 + 5 + 8 + 4:02X}" + "0001C10000" + "0001FF" + "0001" + "FC" + "8008" + "4806" + "01" + "0141" + "024263" + "00000000"
    parts = [
        packet(F.lit("47400010" + "00" + "00B00D0001C100000001E10000000000")), packet(F.lit("47410010" + "00" + "02B0120001C10000E1FFF00006E101F00000000000")), packet(F.lit("47401110" + "00" + sdt)),
        packet(page(k * 10, k % 4, True)), packet(page(k * 10 + 2500, F.lit(0), False)), packet(F.lit("471FFF10")),
    ]
    return table(s, d, "supplier").select(k.alias("file_id"), F.unhex(F.concat(*parts)).alias("content"))


def _dvb(s: SparkSession, d: str) -> DataFrame:
    packets = bs.ts_packets(_ts_files(s, d))
    sections = bs.psi_sections(packets.filter("pid <= 256"))
    streams = bs.pmt_streams(sections)
    mine = bs.matched(packets, streams.select("file_id", "pid").distinct(), ["file_id", "pid"], "left_semi")
    return bs.dvb_segments(bs.pes_units(mine))


def _psi(s: SparkSession, d: str) -> DataFrame:
    """Three sections in two packets: one whole, one that ends before the second packet's pointer, one after it."""
    k = F.col("s_suppkey")
    section = lambda table_id, size, fill: F.concat(F.lit(f"{table_id:02X}F0{size:02X}"), _hex(k, 8), F.repeat(F.lit(fill), size - 4))
    stream = F.concat(section(0x42, 40, "AB"), section(0x46, 200, "CD"))
    first, second = F.substring(stream, 1, 366), F.substring(stream, 367, 1000)
    packets = F.concat(F.lit("47401110" + "00"), first, F.rpad(F.concat(F.lit("47401111" + f"{43 + 203 - 183:02X}"), second, section(0x4A, 30, "EF")), 376, "F"))
    sections = bs.psi_sections(bs.ts_packets(table(s, d, "supplier").select(k.alias("file_id"), F.unhex(packets).alias("content"))))
    return sections.select("file_id", "pid", "section_no", "pkt_no", "table_id", F.length("body").alias("size"), F.hex(F.substring("body", 1, 5)).alias("head"))


add("psi_sections", _psi, "SELECT s_suppkey AS file_id, 17::BIGINT AS pid, n AS section_no, p AS pkt_no, t::BIGINT AS table_id, z AS size, printf('%08X', s_suppkey) || f AS head FROM supplier, (VALUES (1, 0, 66, 36, 'AB'), (2, 0, 70, 196, 'CD'), (3, 1, 74, 26, 'EF')) x(n, p, t, z, f)")
add("dvb_display_sets", lambda s, d: bs.dvb_subtitles(bs.dvb_pages(_dvb(s, d))), "SELECT s_suppkey AS file_id, 1 AS page_id, s_suppkey * 10 AS start_ms, s_suppkey * 10 + CASE WHEN s_suppkey % 4 IN (1, 2) THEN s_suppkey % 4 * 1000 ELSE 2500 END AS end_ms FROM supplier")
add("dvb_region_places", lambda s, d: bs.dvb_region_places(_dvb(s, d)).drop("unit", "seg_no", "i"), "SELECT s_suppkey AS file_id, 257::BIGINT AS pid, 1 AS page_id, 0::BIGINT AS region_id, 16::BIGINT AS x, 32::BIGINT AS y FROM supplier")


def _classes(s: SparkSession, d: str) -> DataFrame:
    packets = bs.ts_packets(_ts_files(s, d))
    sections = bs.psi_sections(packets.filter("pid <= 256"))
    return bs.pid_classes(packets, sections).groupBy("file_id", "class").agg(F.count("*").alias("n"))


add("pid_classify", _classes, "SELECT s_suppkey AS file_id, c AS class, n::BIGINT AS n FROM supplier, (VALUES ('psi', 3), ('pes', 2), ('null', 1)) x(c, n)")
add("sdt_services", lambda s, d: bs.services(bs.psi_sections(bs.ts_packets(_ts_files(s, d)).filter("pid = 17"))), "SELECT s_suppkey AS file_id, 2 AS pkt_no, 1 AS service_id, 1 AS type, 'A' AS provider, 'Bc' AS name FROM supplier")

# pictures of pages and of sub-pictures, whole headers


def _unit(s: SparkSession, d: str) -> DataFrame:
    """Segments of one display set a part: two regions, one with colours of its own, and disparities."""
    seg = lambda kind, *body: F.concat(F.lit(f"0F{kind}0001"), _hex(F.length(F.concat(*body)) / 2, 4), *body)
    const = lambda x: F.lit(x.replace(" ", ""))
    payload = F.concat(
        F.lit("2000"), seg("10", const("0508 00FF000A0014 01FF000C0015")),
        seg("11", const("00 08 0003 0002 24 00 00 00 0001 0000 0000")), seg("11", const("01 08 0004 0002 48 01 00 00 0002"), _hex(F.col("p_partkey") % 3, 4), const("0000")),
        seg("12", const("00 0F 01 81 C8808000 02 80 A221 03 81 00808000")), seg("13", const("0001 00 0004 0000 106C00F0")), seg("13", const("0002 02 0004 0000 111700F0")),
        seg("15", const("28FE 07015F90 02 0103 02FC 01 81 00100020 0580 0300005A00 00300040 FF00 0300005A00")), seg("80", const("")), F.lit("FF"),
    )
    units = table(s, d, "part").select(F.col("p_partkey").alias("file_id"), F.lit(1).alias("pid"), F.lit(1).alias("unit"), (F.col("p_partkey") * 10).alias("pts_ms"), F.lit(0xBD).alias("stream_id"), F.unhex(payload).alias("payload"))
    return bs.dvb_segments(units)


def _compositions(s: SparkSession, d: str) -> DataFrame:
    return pictures.compositions(_unit(s, d)).select("file_id", "left", "top", "width", "height", F.hex("pixels").alias("pixels"))


_LINE = "C8C8C8FFA8A8A8AA"
add("dvb_compositions", _compositions, f"SELECT p_partkey AS file_id, 10::BIGINT AS \"left\", 20::BIGINT AS top, 4 + p_partkey % 3 AS width, 3::BIGINT AS height, '{_LINE}' || repeat('00000000', 2 + p_partkey % 3) || '{_LINE}' || repeat('00000000', 1 + p_partkey % 3) || 'FFFFFFFF' || repeat('00000000', 3 + p_partkey % 3) || 'FFFFFFFF' AS pixels FROM part")
add("dvb_object_sizes", lambda s, d: pictures.object_sizes(pictures.object_spans(_unit(s, d))).select("file_id", "object_id", "width", "height"), "SELECT p_partkey AS file_id, o::BIGINT AS object_id, w::INT AS width, 2 AS height FROM part, (VALUES (1, 3), (2, 2)) x(o, w)")
add("dvb_clut_entries", lambda s, d: bs.dvb_clut_entries(_unit(s, d)).select("file_id", "entry", "full", "y", "cr", "cb", "t"), "SELECT p_partkey AS file_id, x.* FROM part, (VALUES (1, 1, 200, 128, 128, 0), (2, 0, 160, 128, 128, 85), (3, 1, 0, 128, 128, 0)) x(entry, \"full\", y, cr, cb, t)")
add("dvb_disparities", lambda s, d: bs.dvb_disparities(_unit(s, d)).select("file_id", "version", "default_shift", "region_id", "subregion", "x", "width", "shift", "sixteenths", F.array_join("intervals", ",").alias("intervals"), "interval_ms", F.array_join("shifts", ",").alias("shifts")), "SELECT p_partkey AS file_id, x.* FROM part, (VALUES (2, -2, NULL, NULL, NULL, NULL, NULL, NULL, '1,2', 1000, '3,-4'), (2, -2, 1, 0, 16, 32, 5, 8, '', 1, ''), (2, -2, 1, 1, 48, 64, -1, 0, '', 1, '')) x(version, default_shift, region_id, subregion, x, width, shift, sixteenths, intervals, interval_ms, shifts)")
add("dvb_complete_pages", lambda s, d: bs.dvb_complete_pages(_unit(s, d)).select("file_id", "page_id", "complete"), "SELECT p_partkey AS file_id, 1 AS page_id, TRUE AS complete FROM part")
add("dvb_segment_names", lambda s, d: dictionaries.named(_unit(s, d), "segment_types", "type").groupBy("type", "name").agg(F.count("*").alias("n")), "SELECT x.t AS type, x.n AS name, k * count(*) AS n FROM part, (VALUES (16, 'page composition', 1), (17, 'region composition', 2), (18, 'CLUT definition', 1), (19, 'object data', 2), (21, 'disparity signalling', 1), (128, 'end of display set', 1)) x(t, n, k) GROUP BY x.t, x.n, k")


def _sub_pictures(s: SparkSession, d: str, spu: str = "0026 0008 11 600030 0000 0020 033210 04FFF0 05010013020021 0600040005 01 FF 0058 0020 02 FF") -> DataFrame:
    """Units of two lines of four pixels with an end of their own."""
    spu = spu.replace(" ", "")
    packet = F.concat(F.lit(f"000001BD{3 + 5 + 1 + len(spu) // 2:04X}818005"), timecode.ms_to_pes_stamp(F.col("p_partkey") * 40), F.lit("20" + spu + "000001B9"))
    files = table(s, d, "part").select(F.col("p_partkey").alias("file_id"), F.unhex(packet).alias("content"))
    return bs.sub_pictures(bs.pes_payloads(bs.ps_packets(files)))


def _sub_images(s: SparkSession, d: str) -> DataFrame:
    palette = table(s, d, "part").select(F.col("p_partkey").alias("file_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("color")).withColumn("rgb", F.col("color").cast("long") * 0x111111)
    out = pictures.sub_picture_images(pictures.sub_picture_spans(_sub_pictures(s, d)), palette)
    return out.select("file_id", "x0", "y0", "width", "height", F.hex("pixels").alias("pixels"))


add("vob_images", _sub_images, f"SELECT p_partkey AS file_id, 16::BIGINT AS x0, 32::BIGINT AS y0, 4 AS width, 2 AS height, '{'111111FF' * 4 + '222222FF' + '333333FF' * 3}' AS pixels FROM part")
add("vob_times", lambda s, d: pictures.sub_picture_times(_sub_pictures(s, d)).select("file_id", "start_ms", "end_ms"), "SELECT p_partkey AS file_id, p_partkey * 40 AS start_ms, p_partkey * 40 + 1001 AS end_ms FROM part")


def _pes_headers(s: SparkSession, d: str) -> DataFrame:
    escr = 1 << 42 | 1 << 26 | 1 << 10 | 1 | 5 << 11 | 7 << 1
    stamp = lambda ms: timecode.ms_to_pes_stamp(ms)
    k = F.col("p_partkey")
    tail = f"{escr:012X}" + f"{0x800001 | 1000 << 1:06X}" + "55" + "AA" + "BEEF" + "F1" + "00112233445566778899AABBCCDDEEFF" + "02AABB" + "89C3" + "6064" + "8100"
    data = F.unhex(F.concat(F.lit("000001BD0050" + "8DFF" + f"{10 + len(tail) // 2:02X}"), stamp(k * 40), stamp(k * 20), F.lit(tail)))
    fields = ["scrambling", "priority", "aligned", "copyright", "original", "malformed", "pts", "dts", "escr", "es_rate", "trick_mode", "trick_bits", "copy_info", "previous_crc", "sequence", "mpeg1", "stuffing", "std_scale", "std_size", "extension_2"]
    out = bs.pes_headers(table(s, d, "part").select(k.alias("file_id"), data.alias("data")))
    return out.select("file_id", *fields, F.hex("private_data").alias("private_data"), F.hex("pack_header").alias("pack_header"))


add("pes_headers", _pes_headers, "SELECT p_partkey AS file_id, 0::BIGINT AS scrambling, 1::BIGINT AS priority, 1::BIGINT AS aligned, 0::BIGINT AS copyright, 1::BIGINT AS original, FALSE AS malformed, p_partkey * 3600 AS pts, p_partkey * 1800 AS dts, 1507::BIGINT AS escr, 1000::BIGINT AS es_rate, 2::BIGINT AS trick_mode, 21::BIGINT AS trick_bits, 42::BIGINT AS copy_info, 48879::BIGINT AS previous_crc, 9::BIGINT AS sequence, 1::BIGINT AS mpeg1, 3::BIGINT AS stuffing, 1::BIGINT AS std_scale, 100::BIGINT AS std_size, 1::BIGINT AS extension_2, '00112233445566778899AABBCCDDEEFF' AS private_data, 'AABB' AS pack_header FROM part")


def _adaptation(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    head = F.concat(F.lit("47410130" + "22" + "FF"), _hex(F.shiftleft(k, 15) + 0x7E00 + 5, 12), F.lit(f"{2 << 15 | 0x7E00 | 1:012X}" + "FE" + "02ABCD" + "0B" + "FF" + "8123" + "C003E8" + "31000100B5"))
    out = bs.adaptation_fields(table(s, d, "supplier").select(k.alias("file_id"), F.lit(0).alias("pkt_no"), F.unhex(F.rpad(head, 376, "F")).alias("data")))
    return out.withColumn("private_data", F.hex("private_data"))


add("ts_adaptation_fields", _adaptation, "SELECT s_suppkey AS file_id, 0 AS pkt_no, 34::BIGINT AS af_length, 1::BIGINT AS discontinuity, 1::BIGINT AS random_access, 1::BIGINT AS es_priority, s_suppkey * 300 + 5 AS pcr, 601::BIGINT AS opcr, -2::BIGINT AS splice_countdown, 'ABCD' AS private_data, 1::BIGINT AS ltw_valid, 291::BIGINT AS ltw_offset, 1000::BIGINT AS piecewise_rate, 3::BIGINT AS splice_type, 90::BIGINT AS next_dts FROM supplier")

# encodings

_CODECS = ["utf-8", "cp1252", "utf-16-le", "utf-8-sig"]

#: Commands behind a change of colours and contrast, in the first sequence and in the one with the end.
_CHANGED = "0034 0008 11 600030 0000 0027 033210 04FFF0 07 0004 0FFFFFFF 05010013020021 0600040005 01 FF 0058 0027 07 0002 FFFF 02 FF"


def _colour_changes(s: SparkSession, d: str) -> DataFrame:
    units = pictures.sub_picture_fields(pictures.with_times(_sub_pictures(s, d, _CHANGED))).filter(F.size("even") + F.size("odd") > 0)
    commands = F.array_join(F.transform("commands", lambda c: F.concat(c["command"].cast("string"), F.lit(":"), F.hex(c["args"]))), " ")
    return units.select("file_id", "start_ms", "end_ms", commands.alias("commands"), "width", "height")


add("vob_colour_changes", _colour_changes, "SELECT p_partkey AS file_id, p_partkey * 40 AS start_ms, p_partkey * 40 + 1001 AS end_ms, '3:3210 4:FFF0 7:00040FFFFFFF 5:010013020021 6:00040005 1: 7:0002FFFF 2:' AS commands, 4 AS width, 2 AS height FROM part")


def _encoded(s: SparkSession, d: str) -> DataFrame:
    """Texts in several encodings by doc_id; those that Java encodes itself."""
    t = F.col("text")
    content = F.when(F.col("doc_id") % 3 == 0, F.encode(t, "UTF-8")).when(F.col("doc_id") % 3 == 1, F.encode(t, "ISO-8859-1")).otherwise(F.encode(F.concat(F.lit("﻿"), t), "UTF-16LE"))
    return table(s, d, "documents").select("doc_id", "text", content.alias("content"))


#: A text in each encoding; what detection calls it is the same name.
_RU = "Съешь же ещё этих мягких французских булок, да выпей чаю. Ёжик идёт домой, и Маша тоже."
_FR = "Dès Noël, où un zéphyr haï me vêt de glaçons, je dîne d'exquis rôtis de bœuf à l'ail, été comme hiver."
_FR_850 = _FR.replace("œ", "oe")
_SAMPLES = [
    ("cp1251", _RU), ("koi8_r", _RU), ("iso8859_5", _RU), ("cp866", _RU), ("mac_cyrillic", _RU), ("cp1252", _FR), ("mac_roman", _FR), ("cp850", _FR_850), ("utf-8", _FR + _RU),
    ("iso8859_7", "Τα παιδιά παίζουν στον κήπο και η γιαγιά μαγειρεύει το φαγητό για όλους."), ("cp1255", "הילדים משחקים בגן והסבתא מבשלת את האוכל לכולם היום"), ("cp1256", "الأطفال يلعبون في الحديقة والجدة تطبخ الطعام للجميع اليوم"),
    ("cp874", "เด็กๆเล่นในสวนและคุณยายทำอาหารให้ทุกคนในวันนี้"), ("iso8859_9", "Çocuklar bahçede oynuyor, büyükanne herkes için güzel bir akşam yemeği pişiriyor, ığdır şehri."), ("cp1257", "Vaikai žaidžia sode, o močiutė verda valgį visiems šiandien, ąžuolas, ėjo, įėjo, ūkis."),
    ("cp1250", "Zażółć gęślą jaźń. Dzieci bawią się w ogrodzie, a źrebię śpi, świat jest piękny, ćma i łąka."), ("iso8859_2", "Zażółć gęślą jaźń. Dzieci bawią się w ogrodzie, a źrebię śpi, świat jest piękny, ćma i łąka."),
    ("shift_jis", "これは日本語の文章です。今日はとても良い天気でしたから、子供たちは公園で遊びました。"), ("euc_jp", "これは日本語の文章です。今日はとても良い天気でしたから、子供たちは公園で遊びました。"), ("euc_kr", "아이들은 공원에서 놀고 할머니는 모두를 위해 음식을 만듭니다 오늘은 날씨가 좋습니다"),
    ("gb18030", "今天天气很好，我们一起去公园玩，大家都很高兴，这是一个美丽的国家，人们生活得很好。"), ("big5", "今天天氣很好，我們一起去公園玩，大家都很高興，這是一個美麗的國家，人們生活得很好。"), ("utf-16-le", "今天天气很好我们一起去公园玩大家都很高兴这是一个美丽的国家人们生活得很好"), ("utf-16-be", "今天天气很好我们一起去公园玩大家都很高兴这是一个美丽的国家人们生活得很好"),
]
_WIDE_FROM = len(_SAMPLES) - 2


def _sampled(s: SparkSession, d: str) -> DataFrame:
    """A sample behind plain ASCII of the document: none, 20 kB or, for every 240th, 400 kB; wide ones stand alone."""
    k = (F.col("doc_id") % len(_SAMPLES)).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(x[i]) for x in _SAMPLES]), k)
    plain = F.concat(F.regexp_replace("text", r"[^\x20-\x7e]", " "), F.lit(" plain text "))
    size = F.when(k >= _WIDE_FROM, 0).when(F.col("doc_id") % 240 < 24, 400_000).when(F.col("doc_id") % 2 == 0, 20_000).otherwise(0)
    head = F.substring(F.repeat(plain, F.when(size > 0, size / F.length(plain) + 1).otherwise(0).cast("int")), F.lit(1), size)
    docs = table(s, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", encoding.encode_as(F.concat(head, pick(1)), pick(0)).alias("content"))


add("detect_encoding", lambda s, d: _sampled(s, d).select("doc_id", encoding.detect("content")["encoding"].alias("encoding")), "SELECT doc_id, [" + ", ".join(f"'{n}'" for n, _ in _SAMPLES) + f"][doc_id % {len(_SAMPLES)} + 1] AS encoding FROM documents WHERE text IS NOT NULL")


def _model(s: SparkSession, d: str) -> bytepairs.Model:
    """The default model, and the languages of three quarters of the documents."""
    return bytepairs.trained(table(s, d, "documents").filter("crc32(cast(doc_id AS string)) % 4 <> 2"))


add("transcode_utf8", lambda s, d: _encoded(s, d).select("doc_id", F.decode(encoding.to_utf8(F.col("content"), _model(s, d)), "UTF-8").alias("text")), "SELECT doc_id, text FROM documents")


def _hinted(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return _encoded(s, d).select("doc_id", encoding.detect_hinted("content", none, F.lit("de"), none, model=_model(s, d))["encoding"].alias("encoding"))


_PLAIN = r"NOT regexp_matches(coalesce(text, ''), '[^\x00-\x7F]')"
add("detect_encoding_hinted", _hinted, f"SELECT doc_id, CASE WHEN text IS NULL OR text = '' AND doc_id % 3 < 2 THEN 'iso8859_1' WHEN doc_id % 3 = 2 THEN 'utf-16-le' WHEN {_PLAIN} THEN 'ascii' WHEN doc_id % 3 = 0 THEN 'utf-8' ELSE 'cp1252' END AS encoding FROM documents")

#: Letters of other scripts, by how frequent they are, for the Latin ones of documents.
_LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
_SCRIPTS = {
    "cyrillic": "оеаинтсрвлкмдпуяыьгзбчйхжш", "arabic": "اليمنورتبةعدفسكقحجشصطخضذزث", "hebrew": "יוהלאמרתבשנכעדקחפגטצזסךםןף", "thai": "านรอกเงมยลวดทสตะปบคหแจพชขใ", "japanese": "のいしたんてにはなかとるがでをうれりすこまらさもあき",
    "korean": "이다는에의을가고하지로기은사도나서를어리자인아한대시", "simplified": "的一是不了在有人我他这中大来上个国到说们为子和你地出", "traditional": "的一是不了在有人我他這中大來上個國到說們為子和你地出",
}
_WRITTEN = [
    ("latin", "utf-8"), ("latin", "cp1252"), ("latin", "mac_roman"), ("latin", "cp850"), ("latin", "utf-16-le"), ("latin", "utf-32-be"), ("cyrillic", "cp1251"), ("cyrillic", "koi8_r"), ("cyrillic", "iso8859_5"), ("cyrillic", "cp866"), ("cyrillic", "mac_cyrillic"), ("cyrillic", "utf-8"),
    ("arabic", "cp1256"), ("hebrew", "cp1255"), ("thai", "cp874"), ("japanese", "shift_jis"), ("japanese", "euc_jp"), ("japanese", "iso2022_jp"), ("korean", "euc_kr"), ("korean", "iso2022_kr"), ("simplified", "gb18030"), ("simplified", "hz"), ("simplified", "utf-16-be"), ("traditional", "big5"),
]


@F.pandas_udf(T.StringType())
def _in_script(text: pd.Series, script: pd.Series) -> pd.Series:
    """text in small letters, with letters of a script for the Latin ones; other letters go, as the encodings lack them. Null in no script of these."""
    tables = {}
    for name, letters in _SCRIPTS.items():
        # a code point that is left out is 0x110000; the last place is for all beyond
        table = np.full(65_536, 0x110000, np.uint32)
        table[:128] = np.arange(128)
        kept = np.array([ord(c) for c in letters])
        table[kept] = kept
        table[[ord(c) for c in _LETTERS]] = kept[: len(_LETTERS)]
        tables[name] = table

    def one(t: str | None, name: str) -> str | None:
        if t is None or name not in tables:
            return None
        points = tables[name][np.minimum(np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32), 65_535)]
        return points[points < 0x110000].tobytes().decode("utf-32-le")

    return pd.Series([one(t, name) for t, name in zip(text, script, strict=True)], dtype=object)


def _written(s: SparkSession, d: str) -> DataFrame:
    """Every document in each of the encodings, in the script that goes with it: doc_id, script, encoding, text, content."""
    # a few splits of a file, or one, would be all tasks of work that is 24 times the texts
    docs = table(s, d, "documents").filter("text <> ''").select("doc_id", "text").repartition(4 * s.sparkContext.defaultParallelism, "doc_id")
    scripts = {a: [e for x, e in _WRITTEN if x == a] for a, _ in _WRITTEN}
    each = docs.select("doc_id", "text", F.explode(F.array(*[F.struct(F.lit(a).alias("script"), F.array(*map(F.lit, some)).alias("some")) for a, some in scripts.items()])).alias("w")).select("doc_id", "text", "w.*")
    # each script is written once, then each of its encodings
    changed = each.select("doc_id", "script", "some", F.when(F.col("script").isin(*_SCRIPTS), _in_script("text", "script")).otherwise(F.col("text")).alias("text"))
    written = changed.select("doc_id", "text", "script", F.explode("some").alias("encoding"))
    return written.withColumn("content", encoding.encode_as("text", "encoding"))


def _judged(s: SparkSession, d: str) -> DataFrame:
    """How often detection reads a document as it was written."""
    found = _written(s, d).withColumn("found", encoding.detect("content", _model(s, d)))
    # where the names are the same so are the readings, and none is made
    other = F.when(F.col("found.encoding") != F.col("encoding"), F.col("content"))
    same = other.isNull() | (encoding.decode_as(other, F.col("found.encoding")) == encoding.decode_as(other, F.col("encoding")))
    right = F.sum(F.when(same, 1).otherwise(0))
    counts = found.groupBy("script", "encoding").agg(F.count("*").alias("n"), right.alias("right"), F.sum(F.when(~same & F.col("found.reliable"), 1).otherwise(0)).alias("wrong"), F.sum("found.consumed").alias("consumed"), F.sum(F.length("content")).alias("bytes"))
    return counts.select("script", "encoding", "n", (F.col("right") >= 0.99 * F.col("n")).alias("nearly_all_right"), (F.col("wrong") <= 0.005 * F.col("n")).alias("reliable"), (F.col("consumed") == F.col("bytes")).alias("whole"))


add("detect_encoding_documents", _judged, "SELECT w.script, w.encoding, count(*) AS n, TRUE AS nearly_all_right, TRUE AS reliable, TRUE AS whole FROM documents, (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _WRITTEN) + ") w(script, encoding) WHERE text <> '' GROUP BY ALL")


def _damaged(s: SparkSession, d: str) -> DataFrame:
    """Documents in UTF-8, with a stray byte behind every other one, cut within the last character of the rest."""
    sign, stray = F.encode(F.lit(" à é ü — ñ"), "UTF-8"), F.unhex(F.lit("FF"))
    whole = F.concat(F.encode("text", "UTF-8"), sign)
    docs = table(s, d, "documents").filter("text IS NOT NULL")
    damaged = F.when(F.col("doc_id") % 2 == 0, F.concat(whole, stray)).otherwise(F.substring(whole, F.lit(1), F.length(whole) - 1))
    return docs.select("doc_id", encoding.detect(damaged).alias("found")).select("doc_id", "found.encoding", "found.reliable", "found.second")


add("detect_damaged_utf8", _damaged, "SELECT doc_id, 'utf-8' AS encoding, doc_id % 2 = 1 AS reliable, NULL::VARCHAR AS second FROM documents WHERE text IS NOT NULL")


def _priced(s: SparkSession, d: str) -> DataFrame:
    """Short texts with one sign, and what a hint makes of them: a charset that was declared, or a language."""
    docs = table(s, d, "documents")
    sign = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("£"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(" °C")))
    hint = F.get(F.array(*[F.lit(x) for x in ("windows-1252", "ISO-8859-1", "iso-8859-9", None)]), (F.col("doc_id") % 4).cast("int"))
    language = F.when(F.col("doc_id") % 4 == 3, F.lit("en"))
    found = encoding.detect_hinted(encoding.encode_as(sign, F.lit("cp1252")), hint, language, F.lit(None).cast("string"))
    return docs.select("doc_id", found["encoding"].alias("encoding"))


add("detect_hinted_signs", _priced, "SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'iso8859_9' ELSE 'cp1252' END AS encoding FROM documents")
add("encoding_names", lambda s, d: encoding.encoding_names(s).groupBy("family").agg(F.count("*").alias("n")), "SELECT * FROM (VALUES ('unicode', 9::BIGINT), ('multi', 14), ('single', 39), ('ascii', 1), ('binary', 1)) x(family, n)")


def _marked(s: SparkSession, d: str) -> DataFrame:
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return ops.check_marks(table(s, d, "documents").select(F.col("doc_id").alias("file_id"), content.alias("content")))


add("check_bom", _marked, "SELECT doc_id AS file_id, 0 AS cue_no, 'bom' AS code, 'INFO' AS severity, 'UTF-8' AS mark FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL")


# the same functions by their names in SQL


def _in_sql(sql: str, **frames: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        sql_names.register(s)
        return s.sql(sql, **{name: make(s, d) for name, make in frames.items()})

    return run


add("sql_pgs_segments", _in_sql("SELECT file_id, s.type, count(*) AS n, min(s.pts) AS first_pts, sum(length(s.body)) AS size FROM {files} f, LATERAL pgs_segments(f.content, f.about_ms) s GROUP BY file_id, s.type", files=_pgs_files), ORACLES["pgs_segments"])
add("sql_vob_packets", _in_sql("SELECT file_id, p.kind, count(*) AS n, min(p.pos) AS first_pos FROM {files} f, LATERAL vob_packets(f.content) p GROUP BY file_id, p.kind", files=_vob_files), ORACLES["vob_packets"])
add(
    "sql_ts_packets",
    _in_sql("SELECT file_id, p.pid, count(*) AS n, sum(p.pusi) AS starts, sum(CASE WHEN p.payload IS NULL THEN 0 ELSE 184 - length(p.payload) END) AS adaptation FROM {files} f, LATERAL ts_packets(f.content) p GROUP BY file_id, p.pid", files=_ts_files),
    "SELECT s_suppkey AS file_id, x.p AS pid, x.n::BIGINT AS n, x.s::BIGINT AS starts, 0::BIGINT AS adaptation FROM supplier, (VALUES (0, 1, 1), (17, 1, 1), (256, 1, 1), (257, 2, 2), (8191, 1, 0)) x(p, n, s)",
)
add(
    "sql_dvb_segments",
    _in_sql("SELECT s.type, count(*) AS n, sum(length(s.body)) AS size FROM {units} u, LATERAL dvb_segments(u.payload) s GROUP BY s.type", units=lambda s, d: bs.pes_units(bs.ts_packets(_ts_files(s, d)).filter("pid = 257"))),
    "SELECT x.t AS type, 2 * count(*) AS n, x.z * count(*) AS size FROM supplier, (VALUES (16, 10), (128, 0)) x(t, z) GROUP BY x.t, x.z",
)
add(
    "sql_scalars",
    _in_sql("SELECT l_orderkey, l_linenumber, ms_clock(l_partkey * 1717 - 90000) AS clock, clock_ms(ms_clock(l_partkey * 1717 - 90000)) AS ms, ticks_ms(l_suppkey * 77) AS ticks, strip_tags(concat('<i>', l_linestatus, '</i> <font color=\"x\">', l_returnflag, '</font> 1 < 2')) AS text, detect_encoding(encode(concat(l_linestatus, 'é è'), 'UTF-8')).encoding AS encoding FROM {lines}", lines=lambda s, d: table(s, d, "lineitem")),
    "SELECT l_orderkey, l_linenumber, CASE WHEN v < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%02d,%03d', abs(v) // 3600000, abs(v) // 60000 % 60, abs(v) // 1000 % 60, abs(v) % 1000) AS clock, v AS ms, (l_suppkey * 77 + 45) // 90 AS ticks, l_linestatus || ' ' || l_returnflag || ' 1 < 2' AS text, 'utf-8' AS encoding FROM (SELECT *, l_partkey * 1717 - 90000 AS v FROM lineitem)",
)
