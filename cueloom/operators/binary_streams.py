"""Subtitle streams as relations: presentation graphics, program streams, transport streams with DVB.

Finding record borders that depend on each other is a small loop over one file's bytes; everything
after it, from fields to epochs, reassembly and times, is expressions, windows and groupings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions.binary import bits, decode_pgs, joined, pixel_rows, u
from cueloom.functions.color import ycbcr_to_rgb
from cueloom.functions.timecode import ms_to_pes_stamp, ticks_to_ms


def _list(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left.join(right) by sorting both. What the bytes of a stream become is far more than Spark estimates from the size of its table,
    so that without a hint whole relations would go through the driver to every executor."""
    return left.join(right.hint("merge"), on, how)


# presentation graphics


def pgs_time(ticks: int, near: int | None) -> int:
    """The time, not below zero, that is closest to near of all that a 32-bit stamp stands for."""
    return ticks if near is None else ticks + (max(near + (1 << 31) - ticks >> 32, 0) << 32)


def _walk(data: bytes, about_ms: int | None) -> Iterator[tuple[int, int, int]]:
    """pos, pts and dts of the segments of a file."""
    pos, near = 0, None if about_ms is None else about_ms * 90
    while pos + 13 <= len(data) and data[pos : pos + 2] == b"PG":
        pts, dts = int.from_bytes(data[pos + 2 : pos + 6], "big"), int.from_bytes(data[pos + 6 : pos + 10], "big")
        if near is not None:
            near = pts = pgs_time(pts, near)
            dts = pgs_time(dts, near) if dts else 0
        yield pos, pts, dts
        pos += 13 + int.from_bytes(data[pos + 11 : pos + 13], "big")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file_id, content, about_ms in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = content or b""
            for no, (pos, pts, dts) in enumerate(_walk(data, about_ms), 1):
                size = int.from_bytes(data[pos + 11 : pos + 13], "big")
                rows.append((file_id, no, pos, pts, dts, data[pos + 10], data[pos + 13 : pos + 13 + size]))
        names = ["file_id", "seg_no", "pos", "pts", "dts", "type", "body"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def pgs_segments(files: DataFrame) -> DataFrame:
    """file_id, seg_no, pos, pts, dts (90 kHz), type, body of files (file_id, content).

    Stamps have 32 bits, which begin anew every 13 hours. Files may have about_ms, when they begin, to within six hours, as a
    playlist tells it: then each stamp is the time closest to the one before, the first that closest to about_ms. A decoding
    stamp of 0 stands for none. Without about_ms, or where it is null, stamps are as they stand in the file."""
    out = "file_id long, seg_no int, pos long, pts long, dts long, type int, body binary"
    about = F.col("about_ms") if "about_ms" in files.columns else F.lit(None)
    return files.select(F.col("file_id").cast("long"), "content", about.cast("long").alias("about_ms")).mapInArrow(_segments, out)


def pgs_compositions(segments: DataFrame) -> DataFrame:
    """One row a composition: size, state, palette, number of objects, first object, epoch."""
    b = F.col("body")
    pcs = segments.filter("type = 22").select(
        "file_id", "seg_no", ticks_to_ms(F.col("pts")).alias("pts_ms"), u(b, 0, 2).alias("width"), u(b, 2, 2).alias("height"), u(b, 4, 1).alias("rate_code"),
        u(b, 5, 2).alias("composition"), u(b, 7, 1).alias("state"), bits(u(b, 8, 1), 7, 1).alias("palette_update"), u(b, 9, 1).alias("palette_id"), u(b, 10, 1).alias("n_objects"), u(b, 11, 2).alias("object_id"),
    )
    w = Window.partitionBy("file_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    return pcs.withColumn("epoch", F.sum(F.when(F.col("state").isin(0x40, 0x80), 1).otherwise(0)).over(w))


def pgs_windows(segments: DataFrame) -> DataFrame:
    wds = segments.filter("type = 23").select("file_id", "seg_no", "body", F.explode(F.sequence(F.lit(0), u(F.col("body"), 0, 1).cast("int") - 1)).alias("i"))
    at, b = F.col("i") * 9 + 1, F.col("body")
    return wds.select("file_id", "seg_no", *[u(b, at + o, n).alias(x) for x, o, n in (("window_id", 0, 1), ("x", 1, 2), ("y", 3, 2), ("width", 5, 2), ("height", 7, 2))])


def pgs_palette_entries(segments: DataFrame) -> DataFrame:
    pds = segments.filter("type = 20 AND length(body) >= 7")
    pds = pds.select("file_id", "seg_no", "body", F.explode(F.sequence(F.lit(0), F.expr("int((length(body) - 2) div 5) - 1"))).alias("i"))
    at, b = F.col("i") * 5 + 2, F.col("body")
    return pds.select("file_id", "seg_no", u(b, 0, 1).alias("palette_id"), *[u(b, at + k, 1).alias(n) for k, n in enumerate(("entry", "y", "cr", "cb", "alpha"))])


def pgs_objects(segments: DataFrame) -> DataFrame:
    """Whole objects from their fragments: file_id, first_seg, object_id, width, height, rle."""
    b = F.col("body")
    ods = segments.filter("type = 21").select("file_id", "seg_no", u(b, 0, 2).alias("object_id"), bits(u(b, 3, 1), 7, 1).alias("first"), "body")
    w = Window.partitionBy("file_id", "object_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    ods = ods.withColumn("part", F.sum("first").over(w))
    data = F.when(F.col("first") == 1, F.expr("substring(body, 12)")).otherwise(F.expr("substring(body, 5)"))
    return ods.groupBy("file_id", "object_id", "part").agg(
        F.min("seg_no").alias("first_seg"),
        F.max(F.when(F.col("first") == 1, u(b, 7, 2))).alias("width"),
        F.max(F.when(F.col("first") == 1, u(b, 9, 2))).alias("height"),
        joined(F.col("seg_no"), data).alias("rle"),
    ).drop("part")


def _walked(body: Column, start: Column, count: Column, size) -> Column:
    """Places of count records that follow each other from start on; size(place) is the bytes of the record there."""
    first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, _: F.struct((acc["at"] + size(acc["at"])).cast("int").alias("at"), F.when(acc["at"] < F.length(body), F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"]).alias("out"))
    return F.when(count > 0, F.aggregate(F.sequence(F.lit(1), count.cast("int")), first, step)["out"]).otherwise(F.array().cast("array<int>"))


def pgs_epochs(segments: DataFrame) -> DataFrame:
    """segments with display_set, object_epoch and palette_epoch. An epoch start (0x80) clears objects and palettes, an acquisition
    point (0x40) palettes."""
    w = Window.partitionBy("file_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("type") == 22, u(F.col("body"), 7, 1))
    counted = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w)
    return segments.withColumns({"display_set": counted(state.isNotNull()), "object_epoch": counted(state == 0x80), "palette_epoch": counted(state.isin(0x40, 0x80))})


def pgs_composition_objects(segments: DataFrame) -> DataFrame:
    """One row an object of a composition: its id, window, place, and the part of it that is shown (null: all of it)."""
    b = F.col("body")
    cropped = lambda at: bits(u(b, at + 3, 1), 6, 1) == 1
    places = _walked(b, F.lit(11), u(b, 10, 1), lambda at: F.when(cropped(at), 16).otherwise(8))
    each = segments.filter("type = 22").select("file_id", "seg_no", "display_set", "object_epoch", "palette_epoch", "pts", "body", F.posexplode(places).alias("object_no", "at"))
    at = F.col("at")
    crop = {n: F.when(cropped(at), u(b, at + o, 2)) for n, o in (("crop_x", 8), ("crop_y", 10), ("crop_width", 12), ("crop_height", 14))}
    return each.select(
        "file_id", "seg_no", "display_set", "object_epoch", "palette_epoch", ticks_to_ms(F.col("pts")).alias("pts_ms"), u(b, 9, 1).alias("palette_id"), "object_no",
        u(b, at, 2).alias("object_id"), u(b, at + 2, 1).alias("window_id"), u(b, at + 4, 2).alias("x"), u(b, at + 6, 2).alias("y"), *[v.alias(n) for n, v in crop.items()],
    )


def pgs_colours(segments: DataFrame) -> DataFrame:
    """pgs_palette_entries with rgba, eight hex digits."""
    rgb = ycbcr_to_rgb(F.col("y"), F.col("cb"), F.col("cr"))
    return pgs_palette_entries(segments).withColumn("rgba", F.concat(*[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (*rgb, F.col("alpha"))]))


def _as_of(uses: DataFrame, definitions: DataFrame, key: list[str], value: str) -> DataFrame:
    """uses with the value of the last definition of the same key up to their display set; null without one.

    Both have key, display_set and seg_no. One sort of both together, so each use meets one definition."""
    carried = F.struct(*[F.col(c) for c in uses.columns if c not in key])
    ours = uses.select(*key, "display_set", F.lit(1).alias("used"), "seg_no", F.lit(None).cast(definitions.schema[value].dataType).alias(value), carried.alias("use"))
    theirs = definitions.select(*key, "display_set", F.lit(0).alias("used"), "seg_no", value, F.lit(None).cast(ours.schema["use"].dataType).alias("use"))
    w = Window.partitionBy(*key).orderBy("display_set", "used", "seg_no").rowsBetween(Window.unboundedPreceding, 0)
    both = theirs.unionByName(ours).withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("used = 1")
    return both.select(*[c if c in key else F.col(f"use.{c}").alias(c) for c in uses.columns], value)


def pgs_pictures(segments: DataFrame) -> DataFrame:
    """What each composition shows: file_id, seg_no, object_no, pts_ms, x, y, width, height, rows (hex of RRGGBBAA pixels, one a line).

    Of an object and of a palette's entry the last definition up to the composition's display set counts, within the
    epoch that has not cleared it; entries never defined are transparent, objects never defined show nothing.
    """
    known = pgs_epochs(segments)
    shown = pgs_composition_objects(known)
    use = ["file_id", "seg_no", "object_no"]
    where = known.select("file_id", F.col("seg_no").alias("first_seg"), "display_set", "object_epoch")
    objects = matched(pgs_objects(segments), where, ["file_id", "first_seg"])
    pixels = _as_of(shown, objects.select("file_id", "object_epoch", "object_id", "display_set", F.col("first_seg").alias("seg_no"), F.struct("width", "height", "rle").alias("o")), ["file_id", "object_epoch", "object_id"], "o")

    # a version of a palette is what its entries are after one of its segments
    palette = ["file_id", "palette_epoch", "palette_id"]
    at = known.select("file_id", "seg_no", "display_set", "palette_epoch")
    entries = matched(pgs_colours(segments), at, ["file_id", "seg_no"]).groupBy(*palette, "display_set", "seg_no", "entry").agg(F.last("rgba").alias("rgba"))
    versions = entries.select(*palette, "display_set", "seg_no").distinct()
    grid = matched(matched(versions, entries.select(*palette, "entry").distinct(), palette), entries, [*palette, "display_set", "seg_no", "entry"], "left")
    so_far = Window.partitionBy(*palette, "entry").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.withColumn("rgba", F.last("rgba", ignorenulls=True).over(so_far)).filter("rgba IS NOT NULL")
    colours = filled.groupBy(*palette, F.col("seg_no").alias("version")).agg(F.map_from_entries(F.collect_list(F.struct("entry", "rgba"))).alias("m"))
    pixels = _as_of(pixels.filter("o IS NOT NULL"), versions.withColumn("version", F.col("seg_no")), palette, "version")

    clear = F.lit("00000000")
    rgba = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("long")), clear))
    whole = matched(pixels, colours, [*palette, "version"], "left").withColumn("runs", decode_pgs("o.rle")).withColumn("palette", rgba)
    whole = whole.withColumn("rows", pixel_rows(F.col("runs"), F.col("palette"), "00000000"))
    # rows end with what their runs cover; the object's size counts
    rows = F.transform(F.slice("rows", F.lit(1), F.col("o.height").cast("int")), lambda r: F.rpad(r, F.col("o.width").cast("int") * 8, "0"))
    cut = F.transform(F.slice(rows, F.col("crop_y").cast("int") + 1, F.col("crop_height").cast("int")), lambda r: F.substring(r, F.col("crop_x").cast("int") * 8 + 1, F.col("crop_width").cast("int") * 8))
    return whole.select(
        *use, "pts_ms", "x", "y", F.coalesce("crop_width", "o.width").alias("width"), F.coalesce("crop_height", "o.height").alias("height"), F.when(F.col("crop_x").isNull(), rows).otherwise(cut).alias("rows")
    )


def pgs_subtitles(compositions: DataFrame) -> DataFrame:
    """file_id, sub_no, start_ms, end_ms. A composition that clears, starts an epoch, or changes its object
    ends the one shown; one with objects then begins, or goes on if the object is the same."""
    w = Window.partitionBy("file_id").orderBy("seg_no")
    shows = F.col("n_objects") > 0
    anew = F.col("state").isin(0x40, 0x80) | (F.col("object_id") != F.lag("object_id").over(w)) | ~F.coalesce(F.lag("n_objects").over(w) > 0, F.lit(False))
    df = compositions.withColumns({"begins": shows & F.coalesce(anew, F.lit(True)), "last_ms": F.max("pts_ms").over(Window.partitionBy("file_id"))})
    borders = df.filter(F.col("begins") | ~shows).withColumn("end_ms", F.lead("pts_ms").over(w)).filter("begins")
    return borders.select("file_id", F.row_number().over(w).alias("sub_no"), F.col("pts_ms").alias("start_ms"), F.coalesce("end_ms", "last_ms").alias("end_ms"))


def on_line(old_first: int, old_last: int, new_first: int, new_last: int):
    """A change of times in ms for pgs_changes and pes_changes: along the line through two anchors."""
    if old_first == old_last:
        raise ValueError("the anchors are the same")
    ratio = (new_last - new_first) / (old_last - old_first)
    return lambda ms: (F.lit(float(new_first)) + (ms - old_first) * F.lit(ratio)).cast("long")


def _moved_stamps(segment, change) -> Column:
    """Patches (offset, bytes) of both stamps of a segment with pos, pts and dts; the field has the last 32 bits."""
    new = (lambda c: c + change * 90) if isinstance(change, int) else (lambda c: change(ticks_to_ms(c)) * 90)
    moved = lambda c: F.unhex(F.substring(F.lpad(F.hex(F.greatest(new(c), F.lit(0))), 16, "0"), 9, 8))
    return F.array(*[F.struct((segment["pos"] + at).alias("offset"), moved(segment[c]).alias("bytes")) for c, at in (("pts", 2), ("dts", 6))])


def pgs_changes(segments: DataFrame, change) -> DataFrame:
    """file_id, offset, bytes: patches that change both stamps of every segment, not below zero. change: ms to add, or
    a function of the old time in ms such as on_line()."""
    return segments.select("file_id", F.explode(_moved_stamps(segments, change)).alias("c")).select("file_id", "c.offset", "c.bytes")


@F.udf(_list(pos=T.LongType(), pts=T.LongType(), dts=T.LongType()), useArrow=True)
def _stamps_of(content, about_ms):
    """The stamps of a file's segments, as pgs_segments() has them."""
    return list(_walk(bytes(content or b""), about_ms))


def pgs_retimed(files: DataFrame, change) -> DataFrame:
    """file_id, content, about_ms of files (as for pgs_segments) with all stamps changed, as pgs_changes() and apply_changes() would; change as
    in pgs_changes. A file's patches are made from its own row, so nothing is shuffled."""
    about = (F.col("about_ms") if "about_ms" in files.columns else F.lit(None)).cast("long")
    stamps = files.select(F.col("file_id").cast("long"), "content", about.alias("about_ms")).withColumn("s", _stamps_of("content", "about_ms"))
    each = stamps.select("file_id", "content", F.flatten(F.transform("s", lambda x: _moved_stamps(x, change))).alias("c"), "about_ms")
    later = F.greatest(F.col("about_ms") + change if isinstance(change, int) else change(F.col("about_ms")), F.lit(0)).cast("long")
    moved = each.withColumn("about_ms", F.when(F.col("about_ms").isNotNull(), later))
    return moved.mapInArrow(_patched, "file_id long, content binary, about_ms long")


def _patched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file_id, content and c, its patches, and further columns: without c, the content with the patches."""
    for batch in batches:
        out = []
        for content, changed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = bytearray(content or b"")
            for c in changed or []:
                data[c["offset"] : c["offset"] + len(c["bytes"])] = c["bytes"]
            out.append(bytes(data))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *batch.columns[3:]], names=["file_id", "content", *batch.schema.names[3:]])


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """file_id, content with its patches; bytes between patches are cut once, so time is linear."""
    ends = changes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("offset", "bytes"))).alias("c"))
    both = matched(files.select(F.col("file_id").cast("long"), "content"), ends, ["file_id"], "left")
    return both.mapInArrow(_patched, "file_id long, content binary")


# program streams


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, pos, no = content or b"", 0, 0
            while pos + 4 <= len(data) and data[pos : pos + 3] == b"\0\0\1":
                kind = data[pos + 3]
                size = 14 + (data[pos + 13] & 7) if kind == 0xBA and pos + 14 <= len(data) else 6 + int.from_bytes(data[pos + 4 : pos + 6], "big")
                if kind == 0xB9:
                    size = 4
                no += 1
                rows.append((file_id, no, pos, kind, data[pos : pos + size]))
                pos += size
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file_id", "pkt_no", "pos", "kind", "data"])


def ps_packets(files: DataFrame) -> DataFrame:
    """file_id, pkt_no, pos, kind (stream id), data of the packets of a program stream."""
    return files.select(F.col("file_id").cast("long"), "content").mapInArrow(_packets, "file_id long, pkt_no int, pos long, kind int, data binary")


def stamp(data: Column, offset: int) -> Column:
    """33-bit ticks of five stamp bytes."""
    b = lambda i: u(data, offset + i, 1)
    return bits(b(0), 1, 3) * (1 << 30) + b(1) * (1 << 22) + bits(b(2), 1, 7) * (1 << 15) + b(3) * 128 + bits(b(4), 1, 7)


def clock_reference(v: Column) -> Column:
    """27 MHz units of the 48 bits of a system clock reference, its marker bits skipped."""
    return (bits(v, 43, 3) * (1 << 30) + bits(v, 27, 15) * (1 << 15) + bits(v, 11, 15)) * 300 + bits(v, 1, 9)


def pack_headers(packets: DataFrame) -> DataFrame:
    """file_id, pkt_no, scr (27 MHz), rate (kB/s) of pack headers."""
    p = packets.filter("kind = 186")
    d, v = F.col("data"), u(F.col("data"), 4, 6)
    return p.select("file_id", "pkt_no", clock_reference(v).alias("scr"), F.expr("(conv(hex(substring(data, 11, 3)), 16, 10) div 4 * 50 + 500) div 1000").cast("long").alias("rate_kb"), bits(u(d, 13, 1), 0, 3).alias("stuffing"))


def pes_payloads(packets: DataFrame) -> DataFrame:
    """Private stream 1: file_id, pkt_no, pos, pts_ms, dts_ms, substream, payload."""
    d = F.col("data")
    p = packets.filter("kind = 189")
    flags, header = bits(u(d, 7, 1), 6, 2), u(d, 8, 1)
    return p.select(
        "file_id", "pkt_no", "pos",
        F.when(flags >= 2, ticks_to_ms(stamp(d, 9))).alias("pts_ms"),
        F.when(flags == 3, ticks_to_ms(stamp(d, 14))).alias("dts_ms"),
        u(d, header.cast("int") + 9, 1).alias("substream"),
        F.substring(d, header.cast("int") + 11, F.length(d)).alias("payload"),
    )


def pes_changes(packets: DataFrame, change) -> DataFrame:
    """file_id, offset, bytes: patches of the stamps in packets of private stream 1; change as in pgs_changes."""
    d = F.col("data")
    flags = bits(u(d, 7, 1), 6, 2)
    new = (lambda t: ticks_to_ms(t) + change) if isinstance(change, int) else (lambda t: change(ticks_to_ms(t)))
    patch = lambda on, at, prefix: F.when(on, F.struct((F.col("pos") + at).alias("offset"), F.unhex(ms_to_pes_stamp(F.greatest(new(stamp(d, at)), F.lit(0)), prefix)).alias("bytes")))
    each = F.explode(F.array_compact(F.array(patch(flags == 2, 9, 2), patch(flags == 3, 9, 3), patch(flags == 3, 14, 1))))
    return packets.filter("kind = 189").select("file_id", each.alias("c")).select("file_id", "c.offset", "c.bytes")


def indexed_packets(entries: DataFrame, packets: DataFrame) -> DataFrame:
    """packets of program streams with lang, lang_index, ts_no and start_ms of the index entry whose place in the file they follow.

    Both have file_id; an entry's place is filepos, a packet's pos. Packets before the first entry have none.
    """
    columns = ["lang", "lang_index", "ts_no", "start_ms"]
    mark = entries.select("file_id", F.col("filepos").alias("pos"), F.lit(0).alias("kind_of_row"), F.struct(*columns).alias("entry"), F.lit(None).cast("int").alias("pkt_no"), F.lit(None).cast("int").alias("kind"))
    rows = packets.select("file_id", "pos", F.lit(1).alias("kind_of_row"), F.lit(None).cast(mark.schema["entry"].dataType).alias("entry"), "pkt_no", "kind")
    w = Window.partitionBy("file_id").orderBy("pos", "kind_of_row").rowsBetween(Window.unboundedPreceding, 0)
    both = mark.unionByName(rows).withColumn("entry", F.last("entry", ignorenulls=True).over(w)).filter("kind_of_row = 1")
    return both.select("file_id", "pkt_no", "pos", "kind", *[F.col(f"entry.{c}").alias(c) for c in columns])


def pes_headers(packets: DataFrame) -> DataFrame:
    """All fields of the headers of packets (data from its start code): flags, stamps and the optional parts in their order.

    A part that is absent is null; stamps are ticks, escr is in 27 MHz units, es_rate in units of 50 bytes.
    """
    d = F.col("data")
    one, two = u(d, 6, 1), u(d, 7, 1)
    flag = lambda k: bits(two, k, 1)
    stamps = bits(two, 6, 2)
    fixed = packets.withColumns({
        "scrambling": bits(one, 4, 2), "priority": bits(one, 3, 1), "aligned": bits(one, 2, 1), "copyright": bits(one, 1, 1), "original": bits(one, 0, 1), "header_length": u(d, 8, 1),
        "malformed": (stamps == 1) | (bits(one, 6, 2) != 2), "__escr": F.when(stamps == 3, 19).when(stamps == 2, 14).otherwise(9),
    })
    after = lambda c, present, size: F.col(c) + F.when(present == 1, size).otherwise(0)
    at = fixed.withColumn("__rate", after("__escr", flag(5), 6)).withColumn("__trick", after("__rate", flag(4), 3)).withColumn("__copy", after("__trick", flag(3), 1))
    at = at.withColumn("__crc", after("__copy", flag(2), 1)).withColumn("__ext", after("__crc", flag(1), 2)).withColumn("__flags", F.when(flag(0) == 1, u(d, F.col("__ext"), 1)))
    ext = lambda k: F.coalesce(bits(F.col("__flags"), k, 1), F.lit(0))
    at = at.withColumn("__pack", F.col("__ext") + 1 + F.when(ext(7) == 1, 16).otherwise(0))
    at = at.withColumn("__seq", F.col("__pack") + F.when(ext(6) == 1, u(d, F.col("__pack"), 1).cast("int") + 1).otherwise(0))
    at = at.withColumn("__std", after("__seq", ext(5), 2)).withColumn("__two", after("__std", ext(4), 2))
    v, trick, std, seq = u(d, F.col("__escr"), 6), u(d, F.col("__trick"), 1), u(d, F.col("__std"), 2), u(d, F.col("__seq"), 2)
    return at.withColumns({
        "pts": F.when(stamps >= 2, stamp(d, 9)), "dts": F.when(stamps == 3, stamp(d, 14)), "escr": F.when(flag(5) == 1, clock_reference(v)), "es_rate": F.when(flag(4) == 1, bits(u(d, F.col("__rate"), 3), 1, 22)),
        "trick_mode": F.when(flag(3) == 1, bits(trick, 5, 3)), "trick_bits": F.when(flag(3) == 1, bits(trick, 0, 5)), "copy_info": F.when(flag(2) == 1, bits(u(d, F.col("__copy"), 1), 0, 7)),
        "previous_crc": F.when(flag(1) == 1, u(d, F.col("__crc"), 2)), "private_data": F.when(ext(7) == 1, F.substring(d, F.col("__ext") + 2, F.lit(16))),
        "pack_header": F.when(ext(6) == 1, F.substring(d, F.col("__pack") + 2, u(d, F.col("__pack"), 1).cast("int"))), "sequence": F.when(ext(5) == 1, bits(seq, 8, 7)), "mpeg1": F.when(ext(5) == 1, bits(seq, 6, 1)),
        "stuffing": F.when(ext(5) == 1, bits(seq, 0, 6)), "std_scale": F.when(ext(4) == 1, bits(std, 13, 1)), "std_size": F.when(ext(4) == 1, bits(std, 0, 13)), "extension_2": F.when(ext(0) == 1, bits(u(d, F.col("__two"), 1), 0, 7)),
    }).drop("__escr", "__rate", "__trick", "__copy", "__crc", "__ext", "__flags", "__pack", "__seq", "__std", "__two")


def sub_pictures(payloads: DataFrame) -> DataFrame:
    """Sub-picture units: file_id, substream, spu_no, pts_ms, size, control_at, data. A packet with a stamp begins one."""
    w = Window.partitionBy("file_id", "substream").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, 0)
    df = payloads.withColumn("spu_no", F.sum(F.when(F.col("pts_ms").isNotNull(), 1).otherwise(0)).over(w))
    spu = df.groupBy("file_id", "substream", "spu_no").agg(F.min("pts_ms").alias("pts_ms"), joined(F.col("pkt_no"), F.col("payload")).alias("data"))
    return spu.select("file_id", "substream", "spu_no", "pts_ms", u(F.col("data"), 0, 2).alias("size"), u(F.col("data"), 2, 2).alias("control_at"), "data")


#: Bytes of arguments of each command of a control sequence. A change of colours and contrast states its own size.
ARGUMENTS = {0: 0, 1: 0, 2: 0, 3: 2, 4: 2, 5: 6, 6: 4}
COLOUR_CHANGE = 7


@F.udf(_list(delay=T.IntegerType(), command=T.IntegerType(), args=T.BinaryType()), useArrow=True)
def control_commands(data, start):
    """The commands of a sub-picture's control sequences, in the order of their links.

    The size that a change of colours states counts the bytes behind it; one that exceeds the unit ends the sequence."""
    out, at = [], start
    data = bytes(data or b"")
    while at is not None and at + 4 <= len(data):
        delay, following = int.from_bytes(data[at : at + 2], "big"), int.from_bytes(data[at + 2 : at + 4], "big")
        i = at + 4
        while i < len(data) and (data[i] in ARGUMENTS or data[i] == COLOUR_CHANGE):
            n = 2 + int.from_bytes(data[i + 1 : i + 3], "big") if data[i] == COLOUR_CHANGE else ARGUMENTS[data[i]]
            if i + 1 + n > len(data):
                break
            out.append((delay, data[i], data[i + 1 : i + 1 + n]))
            i += 1 + n
        at = following if following > at else None
    return out


# transport streams


def ts_packets(files: DataFrame) -> DataFrame:
    """The fixed 188-byte records: pid, flags, counter, payload. Expressions only."""
    f = files.filter(F.length("content") >= 188).select("file_id", "content", F.explode(F.sequence(F.lit(0), F.expr("int(length(content) div 188) - 1"))).alias("pkt_no"))
    return ts_fields(f.select("file_id", "pkt_no", F.substring("content", F.col("pkt_no") * 188 + 1, F.lit(188)).alias("data")))


def ts_fields(packets: DataFrame) -> DataFrame:
    d = F.col("data")
    head = u(d, 0, 4)
    out = packets.select(
        "file_id", "pkt_no", bits(head, 24, 8).alias("sync"), bits(head, 23, 1).alias("tei"), bits(head, 22, 1).alias("pusi"), bits(head, 21, 1).alias("priority"), bits(head, 8, 13).alias("pid"),
        bits(head, 6, 2).alias("tsc"), bits(head, 4, 2).alias("afc"), bits(head, 0, 4).alias("cc"), F.when(bits(head, 5, 1) == 1, u(d, 4, 1)).alias("af_length"), "data",
    )
    start = F.when(F.col("af_length").isNotNull(), F.col("af_length") + 6).otherwise(5).cast("int")
    payload = F.when(bits(F.col("afc"), 0, 1) == 1, F.substring("data", start, F.lit(188)))
    pcr_on = (F.col("af_length") > 6) & (bits(u(F.col("data"), 5, 1), 4, 1) == 1)
    v = u(F.col("data"), 6, 6)
    pcr = F.when(pcr_on, bits(v, 15, 33) * 300 + bits(v, 0, 9))
    return out.withColumns({"payload": payload, "pcr": pcr, "discontinuity": F.when(F.col("af_length") > 0, bits(u(F.col("data"), 5, 1), 7, 1))}).drop("data")


def adaptation_fields(packets: DataFrame) -> DataFrame:
    """All fields of the adaptation fields of packets (file_id, pkt_no, data); absent parts are null.

    pcr and opcr are in 27 MHz units, splice_countdown is signed, ltw_offset and piecewise_rate as in the extension.
    """
    d = F.col("data")
    p = packets.filter((bits(u(d, 3, 1), 5, 1) == 1) & (u(d, 4, 1) > 0))
    flags = u(d, 5, 1)
    flag = lambda k: bits(flags, k, 1)
    after = lambda c, present, size: F.col(c) + F.when(present == 1, size).otherwise(0)
    p = p.withColumn("__pcr", F.lit(6)).withColumn("__opcr", after("__pcr", flag(4), 6)).withColumn("__splice", after("__opcr", flag(3), 6)).withColumn("__private", after("__splice", flag(2), 1))
    p = p.withColumn("__ext", F.col("__private") + F.when(flag(1) == 1, u(d, F.col("__private"), 1).cast("int") + 1).otherwise(0)).withColumn("__flags", F.when(flag(0) == 1, u(d, F.col("__ext") + 1, 1)))
    ext = lambda k: F.coalesce(bits(F.col("__flags"), k, 1), F.lit(0))
    p = p.withColumn("__ltw", F.col("__ext") + 2).withColumn("__rate", after("__ltw", ext(7), 2)).withColumn("__seam", after("__rate", ext(6), 3))
    clock = lambda c: bits(u(d, F.col(c), 6), 15, 33) * 300 + bits(u(d, F.col(c), 6), 0, 9)
    splice, ltw = u(d, F.col("__splice"), 1), u(d, F.col("__ltw"), 2)
    b = lambda i: u(d, F.col("__seam") + i, 1)
    next_dts = bits(b(0), 1, 3) * (1 << 30) + b(1) * (1 << 22) + bits(b(2), 1, 7) * (1 << 15) + b(3) * 128 + bits(b(4), 1, 7)
    return p.select(
        "file_id", "pkt_no", u(d, 4, 1).alias("af_length"), flag(7).alias("discontinuity"), flag(6).alias("random_access"), flag(5).alias("es_priority"),
        F.when(flag(4) == 1, clock("__pcr")).alias("pcr"), F.when(flag(3) == 1, clock("__opcr")).alias("opcr"), F.when(flag(2) == 1, F.when(splice > 127, splice - 256).otherwise(splice)).alias("splice_countdown"),
        F.when(flag(1) == 1, F.substring(d, F.col("__private") + 2, u(d, F.col("__private"), 1).cast("int"))).alias("private_data"),
        F.when(ext(7) == 1, bits(ltw, 15, 1)).alias("ltw_valid"), F.when(ext(7) == 1, bits(ltw, 0, 15)).alias("ltw_offset"), F.when(ext(6) == 1, bits(u(d, F.col("__rate"), 3), 0, 22)).alias("piecewise_rate"),
        F.when(ext(5) == 1, bits(b(0), 4, 4)).alias("splice_type"), F.when(ext(5) == 1, next_dts).alias("next_dts"),
    )


def _unit_parts(packets: DataFrame) -> DataFrame:
    """file_id, pid, unit, pkt_no, data: what a packet adds to a unit. The bytes before a pointer end the unit before."""
    w = Window.partitionBy("file_id", "pid").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, 0)
    p = packets.filter(F.length("payload") > 0).withColumn("unit", F.sum("pusi").over(w))
    pointer, payload = u(F.col("payload"), 0, 1).cast("int"), F.col("payload")
    part = lambda unit, data: F.struct(unit.alias("unit"), data.alias("data"))
    starts = F.array(part(F.col("unit") - 1, F.substring(payload, F.lit(2), pointer)), part(F.col("unit"), F.substring(payload, pointer + 2, F.lit(188))))
    each = p.select("file_id", "pid", "pkt_no", F.explode(F.when(F.col("pusi") == 1, starts).otherwise(F.array(part(F.col("unit"), payload)))).alias("p"))
    return each.select("file_id", "pid", "pkt_no", "p.unit", "p.data").filter("unit > 0")


def psi_sections(packets: DataFrame) -> DataFrame:
    """Sections of table PIDs: file_id, pid, section_no, pkt_no, table_id, body (after the length, without CRC).

    A unit goes from a pointer to the next; it holds one section or more, up to stuffing. A section that
    its unit does not hold whole, as at the end of a cut stream, is left out. pkt_no is that of the unit's first packet."""
    whole = _unit_parts(packets).groupBy("file_id", "pid", "unit").agg(F.min("pkt_no").alias("pkt_no"), joined(F.col("pkt_no"), F.col("data")).alias("data"))
    data, none = F.col("data"), F.lit(None).cast("int")

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        size = bits(u(data, at + 1, 2), 0, 12).cast("int") + 3
        good = at.isNotNull() & (u(data, at, 1) != 0xFF) & (at + size <= F.length(data))
        return F.struct(F.when(good, at + size).otherwise(none).alias("at"), F.when(good, F.concat(acc["out"], F.array(F.struct(at.alias("at"), size.alias("size"))))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,size:int>>").alias("out"))
    # a section has seven bytes at least
    places = F.aggregate(F.sequence(F.lit(0), F.expr("int(length(data) div 7)")), start, step)["out"]
    each = whole.select("file_id", "pid", "unit", "pkt_no", "data", F.inline(places))
    number = F.row_number().over(Window.partitionBy("file_id", "pid").orderBy("unit", "at"))
    return each.select("file_id", "pid", number.alias("section_no"), "pkt_no", u(data, F.col("at"), 1).alias("table_id"), F.substring(data, F.col("at") + 4, F.col("size") - 7).alias("body"))


def pat_programs(sections: DataFrame) -> DataFrame:
    s = sections.filter("table_id = 0 AND length(body) >= 9").select("file_id", "pkt_no", "body", F.explode(F.sequence(F.lit(0), F.expr("int((length(body) - 5) div 4) - 1"))).alias("i"))
    at, b = F.col("i") * 4 + 5, F.col("body")
    return s.select("file_id", "pkt_no", bits(u(b, 2, 1), 1, 5).alias("version"), u(b, at, 2).alias("program"), bits(u(b, at + 2, 2), 0, 13).alias("pid")).filter("program > 0")


@F.udf(_list(stream_type=T.IntegerType(), pid=T.IntegerType()), useArrow=True)
def pmt_streams_of(body):
    """Elementary streams of a program map's body; descriptors are skipped."""
    body, out = bytes(body or b""), []
    at = 9 + (int.from_bytes(body[7:9], "big") & 0xFFF)
    while at + 5 <= len(body):
        out.append((body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF))
        at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    return out


def pmt_streams(sections: DataFrame) -> DataFrame:
    s = sections.filter("table_id = 2").select("file_id", "pkt_no", u(F.col("body"), 0, 2).alias("program"), F.explode(pmt_streams_of("body")).alias("s"))
    return s.select("file_id", "pkt_no", "program", "s.stream_type", "s.pid")


@F.udf(_list(service_id=T.IntegerType(), type=T.IntegerType(), provider=T.StringType(), name=T.StringType()), useArrow=True)
def services_of(body):
    """Services of a description table's body with their 0x48 descriptors."""
    body, out, at = bytes(body or b""), [], 8
    while at + 5 <= len(body):
        sid, size = int.from_bytes(body[at : at + 2], "big"), int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF
        i, end = at + 5, min(at + 5 + size, len(body))
        while i + 2 <= end:
            tag, n = body[i], body[i + 1]
            if tag == 0x48 and n >= 3:
                p = body[i + 3]
                provider, rest = body[i + 4 : i + 4 + p], i + 4 + p
                out.append((sid, body[i + 2], provider.decode("latin-1"), body[rest + 1 : rest + 1 + body[rest]].decode("latin-1") if rest < len(body) else ""))
            i += 2 + n
        at += 5 + size
    return out


def services(sections: DataFrame) -> DataFrame:
    s = sections.filter("table_id IN (66, 70)").select("file_id", "pkt_no", F.explode(services_of("body")).alias("s"))
    return s.select("file_id", "pkt_no", "s.*")


def _listed(tables: DataFrame, key: list[str], entries: DataFrame) -> DataFrame:
    """file_id, pid, pkt_no, change: where a table's version begins to list a PID (1) and where the next version ends that (-1).

    tables: key, pkt_no and version of each section, key being the columns that tell tables apart; entries: key, pkt_no, pid.
    """
    w = Window.partitionBy(*key).orderBy("pkt_no")
    anew = F.coalesce(F.col("version") != F.lag("version").over(w), F.lit(True))
    known = tables.distinct().withColumn("run", F.sum(F.when(anew, 1).otherwise(0)).over(w))
    starts = known.groupBy(*key, "run").agg(F.min("pkt_no").alias("start"))
    starts = starts.withColumn("end", F.lead("start").over(Window.partitionBy(*key).orderBy("run")))
    mine = matched(matched(entries, known, [*key, "pkt_no"]).groupBy(*key, "run", "pid").agg(F.min("pkt_no").alias("pkt_no")), starts, [*key, "run"])
    changes = F.array(F.struct("pkt_no", F.lit(1).alias("change")), F.struct(F.col("end").alias("pkt_no"), F.lit(-1).alias("change")))
    return mine.select("file_id", "pid", F.inline(changes)).filter("pkt_no IS NOT NULL")


def pid_classes(packets: DataFrame, sections: DataFrame) -> DataFrame:
    """packets with class: null, psi, pes or unknown.

    A PID is of a program map (psi) or an elementary stream (pes) from the packet on in which a table lists it, until a
    new version of that table does not. A repeated version changes nothing. Packets before their table are unknown.
    """
    b = F.col("body")
    pats = sections.filter("table_id = 0 AND length(body) >= 5").select("file_id", "pkt_no", bits(u(b, 2, 1), 1, 5).alias("version"))
    pmts = sections.filter("table_id = 2 AND length(body) >= 9").select("file_id", u(b, 0, 2).alias("program"), "pkt_no", bits(u(b, 2, 1), 1, 5).alias("version"))
    maps = _listed(pats, ["file_id"], pat_programs(sections).select("file_id", "pkt_no", "pid"))
    streams = _listed(pmts, ["file_id", "program"], pmt_streams(sections).select("file_id", "program", "pkt_no", "pid"))
    marks = maps.withColumn("of", F.lit("psi")).unionByName(streams.withColumn("of", F.lit("pes")))
    w = Window.partitionBy("file_id", "pid").orderBy("pkt_no", F.col("change").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    on = lambda kind: F.sum(F.when(F.col("of") == kind, F.col("change")).otherwise(0)).over(w) > 0
    both = packets.unionByName(marks, allowMissingColumns=True).withColumns({"__psi": on("psi"), "__pes": on("pes")}).filter("change IS NULL")
    kind = F.when(F.col("pid") == 0x1FFF, "null").when((F.col("pid") < 0x20) | F.col("__psi"), "psi").when(F.col("__pes"), "pes").otherwise("unknown")
    return both.withColumn("class", kind).drop("__psi", "__pes", "of", "change")


def pes_units(packets: DataFrame) -> DataFrame:
    """Reassembled packets of elementary streams: file_id, pid, unit, pkt_no, stream_id, pts_ms, payload."""
    w = Window.partitionBy("file_id", "pid").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, 0)
    p = packets.filter(F.col("payload").isNotNull()).withColumn("unit", F.sum("pusi").over(w)).filter("unit > 0")
    whole = p.groupBy("file_id", "pid", "unit").agg(F.min("pkt_no").alias("pkt_no"), joined(F.col("pkt_no"), F.col("payload")).alias("d"))
    d = F.col("d")
    header = u(d, 8, 1).cast("int")
    size = u(d, 4, 2).cast("int")
    end = F.when(size > 0, size + 6).otherwise(F.length(d))
    return whole.filter(F.hex(F.substring("d", 1, 3)) == "000001").select(
        "file_id", "pid", "unit", "pkt_no", u(d, 3, 1).alias("stream_id"), F.when(bits(u(d, 7, 1), 7, 1) == 1, ticks_to_ms(stamp(d, 9))).alias("pts_ms"),
        F.substring(d, header + 10, end - header - 9).alias("payload"),
    )


@F.udf(_list(type=T.IntegerType(), page_id=T.IntegerType(), body=T.BinaryType()), useArrow=True)
def dvb_segments_of(payload):
    """Segments of a subtitling payload. Every type is skipped by its length."""
    data, out, at = bytes(payload or b""), [], 2
    while at + 6 <= len(data) and data[at] == 0x0F:
        size = int.from_bytes(data[at + 4 : at + 6], "big")
        out.append((data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big"), data[at + 6 : at + 6 + size]))
        at += 6 + size
    return out


def dvb_segments(units: DataFrame) -> DataFrame:
    """file_id, pid, unit, pts_ms, seg_no, type, page_id, body of private streams that carry subtitles."""
    good = units.filter((F.col("stream_id") == 0xBD) & (F.hex(F.substring("payload", 1, 2)) == "2000"))
    each = good.select("file_id", "pid", "unit", "pts_ms", F.posexplode(dvb_segments_of("payload")).alias("seg_no", "s"))
    return each.select("file_id", "pid", "unit", "pts_ms", "seg_no", "s.type", "s.page_id", "s.body")


def _repeated(segments: DataFrame, kind: int, head: int, size: int) -> DataFrame:
    s = segments.filter((F.col("type") == kind) & (F.length("body") >= head + size))
    return s.withColumn("i", F.explode(F.sequence(F.lit(0), F.expr(f"int((length(body) - {head}) div {size}) - 1")))).withColumn("at", F.col("i") * size + head)


KEY = ["file_id", "pid", "unit", "page_id"]


def dvb_pages(segments: DataFrame) -> DataFrame:
    b = F.col("body")
    return segments.filter("type = 16").select(*KEY, "pts_ms", u(b, 0, 1).alias("timeout_s"), bits(u(b, 1, 1), 4, 4).alias("version"), bits(u(b, 1, 1), 2, 2).alias("state"), F.expr("int((length(body) - 2) div 6)").alias("n_regions"))


def dvb_region_places(segments: DataFrame) -> DataFrame:
    b, at = F.col("body"), F.col("at")
    return _repeated(segments, 0x10, 2, 6).select(*KEY, "seg_no", "i", u(b, at, 1).alias("region_id"), u(b, at + 2, 2).alias("x"), u(b, at + 4, 2).alias("y"))


def dvb_regions(segments: DataFrame) -> DataFrame:
    b = F.col("body")
    s = segments.filter("type = 17")
    return s.select(*KEY, "seg_no", u(b, 0, 1).alias("region_id"), bits(u(b, 1, 1), 3, 1).alias("fill"), u(b, 2, 2).alias("width"), u(b, 4, 2).alias("height"), bits(u(b, 6, 1), 2, 3).alias("depth"), u(b, 7, 1).alias("clut_id"), u(b, 8, 1).alias("fill8"), bits(u(b, 9, 1), 4, 4).alias("fill4"), bits(u(b, 9, 1), 2, 2).alias("fill2"))


@F.udf(_list(object_id=T.IntegerType(), object_type=T.IntegerType(), provider=T.IntegerType(), x=T.IntegerType(), y=T.IntegerType(), foreground=T.IntegerType(), background=T.IntegerType()), useArrow=True)
def object_places_of(body):
    """Objects of a region's body; those of characters have two colours more."""
    body, out, at = bytes(body or b""), [], 10
    while at + 6 <= len(body):
        head, low = int.from_bytes(body[at + 2 : at + 4], "big"), int.from_bytes(body[at + 4 : at + 6], "big")
        colored = head >> 14 in (1, 2) and at + 8 <= len(body)
        fg, bg = (body[at + 6], body[at + 7]) if colored else (None, None)
        out.append((int.from_bytes(body[at : at + 2], "big"), head >> 14, head >> 12 & 3, head & 0xFFF, low & 0xFFF, fg, bg))
        at += 8 if colored else 6
    return out


def dvb_object_places(segments: DataFrame) -> DataFrame:
    s = segments.filter("type = 17").select(*KEY, "seg_no", u(F.col("body"), 0, 1).alias("region_id"), F.posexplode(object_places_of("body")).alias("i", "o"))
    return s.select(*KEY, "seg_no", "i", "region_id", "o.*")


@F.udf(_list(entry=T.IntegerType(), f2=T.IntegerType(), f4=T.IntegerType(), f8=T.IntegerType(), full=T.IntegerType(), y=T.IntegerType(), cr=T.IntegerType(), cb=T.IntegerType(), t=T.IntegerType()), useArrow=True)
def clut_entries_of(body):
    """Entries of a table's body in 8 bits a value; those of reduced resolution give the high bits, and all of t."""
    body, out, at = bytes(body or b""), [], 2
    while at + 4 <= len(body):
        flags = body[at + 1]
        if flags & 1:
            if at + 6 > len(body):
                break
            values, size = tuple(body[at + 2 : at + 6]), 6
        else:
            v = int.from_bytes(body[at + 2 : at + 4], "big")
            values, size = (v >> 10 << 2, (v >> 6 & 15) << 4, (v >> 2 & 15) << 4, (v & 3) * 85), 4
        out.append((body[at], flags >> 7, flags >> 6 & 1, flags >> 5 & 1, flags & 1, *values))
        at += size
    return out


def dvb_clut_entries(segments: DataFrame) -> DataFrame:
    """Entries of colour tables with the tables (f2, f4, f8) they are for."""
    s = segments.filter("type = 18").select(*KEY, "seg_no", u(F.col("body"), 0, 1).alias("clut_id"), F.posexplode(clut_entries_of("body")).alias("i", "e"))
    return s.select(*KEY, "seg_no", "i", "clut_id", "e.*")


def dvb_objects(segments: DataFrame) -> DataFrame:
    """Pixel objects: top and bottom field; an empty bottom field repeats the top one."""
    b = F.col("body")
    top, bottom = u(b, 3, 2).cast("int"), u(b, 5, 2).cast("int")
    s = segments.filter((F.col("type") == 0x13) & (bits(u(b, 2, 1), 2, 2) == 0))
    first = F.substring(b, F.lit(8), top)
    return s.select(*KEY, "seg_no", u(b, 0, 2).alias("object_id"), bits(u(b, 2, 1), 1, 1).alias("non_modifying"), first.alias("top"), F.when(bottom == 0, first).otherwise(F.substring(b, top + 8, bottom)).alias("bottom"))


def dvb_displays(segments: DataFrame) -> DataFrame:
    b = F.col("body")
    return segments.filter("type = 20").select(*KEY, (u(b, 1, 2) + 1).alias("width"), (u(b, 3, 2) + 1).alias("height"))


@F.udf(_list(version=T.IntegerType(), default_shift=T.IntegerType(), region_id=T.IntegerType(), subregion=T.IntegerType(), x=T.IntegerType(), width=T.IntegerType(), shift=T.IntegerType(), sixteenths=T.IntegerType(), intervals=T.ArrayType(T.IntegerType()), interval_ms=T.IntegerType(), shifts=T.ArrayType(T.IntegerType())), useArrow=True)
def disparities_of(body):
    """Disparity of a page (region_id null) and of every part of its regions, with later updates."""
    body, at, out = bytes(body or b""), 2, []
    signed = lambda v: v - 256 if v > 127 else v

    def updates(on):
        nonlocal at
        if not on or at + 5 > len(body):
            return [], None, []
        ms, n = (int.from_bytes(body[at + 1 : at + 4], "big") + 45) // 90, body[at + 4]
        pairs = body[at + 5 : at + 5 + 2 * n]
        at += 5 + 2 * n
        return list(pairs[0::2]), ms, [signed(v) for v in pairs[1::2]]

    if len(body) < 2:
        return out
    version, default = body[0] >> 4, signed(body[1])
    out.append((version, default, None, None, None, None, None, None, *updates(body[0] >> 3 & 1)))
    while at + 2 <= len(body):
        region, flags = body[at], body[at + 1]
        at += 2
        for k in range((flags & 3) + 1):
            x = width = None
            if flags & 3:
                x, width = int.from_bytes(body[at : at + 2], "big"), int.from_bytes(body[at + 2 : at + 4], "big")
                at += 4
            if at + 2 > len(body):
                return out
            shift, part = signed(body[at]), body[at + 1] >> 4
            at += 2
            out.append((version, default, region, k, x, width, shift, part, *updates(flags >> 7)))
    return out


def dvb_disparities(segments: DataFrame) -> DataFrame:
    """Rows of disparity segments: the page's default, then every part of a region."""
    return segments.filter("type = 21").select(*KEY, "seg_no", F.explode(disparities_of("body")).alias("d")).select(*KEY, "seg_no", "d.*")


def dvb_complete_pages(segments: DataFrame) -> DataFrame:
    """Display sets with complete: whether an end segment came and a region is defined."""
    return segments.groupBy(*KEY).agg((F.max((F.col("type") == 0x80).cast("int")) + F.max((F.col("type") == 0x11).cast("int")) == 2).alias("complete"))


def dvb_subtitles(pages: DataFrame) -> DataFrame:
    """file_id, page_id, start_ms, end_ms of shown pages: until the timeout or the page's next composition,
    five seconds if that gives no time."""
    w = Window.partitionBy("file_id", "pid", "page_id").orderBy("pts_ms", "unit")
    following = F.lead("pts_ms").over(w)
    limit = F.when(F.col("timeout_s") > 0, F.col("pts_ms") + F.col("timeout_s") * 1000)
    end = F.least(limit, following)
    out = pages.withColumn("end_ms", F.when(end > F.col("pts_ms"), end).otherwise(F.col("pts_ms") + 5000)).filter("n_regions > 0")
    return out.select("file_id", "page_id", F.col("pts_ms").alias("start_ms"), "end_ms")
