"""Pictures of subtitles: objects placed in regions on a page, and the two fields of a sub-picture.

A picture is a set of spans, one row a run of equal pixels. Where a span lies, and its colour, come from
joins; only the last step puts the spans of one picture, which a screen bounds, into an array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions import binary, color
from cueloom.functions.binary import bits, u
from cueloom.operators import binary_streams as bs

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("color", "x", "length", "line")]))


def _placed(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    out, x, at = [], 0, None
    for c, n, line in runs:
        if line != at:
            x, at = 0, line
        out.append((c, x, n, line))
        x += n
    return out


@F.udf(SPANS, useArrow=True)
def dvb_spans(data):
    return None if data is None else _placed(binary.dvb_runs(bytes(data)))


@F.udf(SPANS, useArrow=True)
def vob_spans(data, width):
    return None if data is None or width is None else _placed(binary.vob_runs(bytes(data), width))


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last definition of each key; rows have seg_no."""
    values = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*[c for c in ("seg_no", "i") if c in values])).alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values if c not in ("seg_no", "i")])


def object_spans(segments: DataFrame) -> DataFrame:
    """Spans of pixel objects: display-set key, object_id, non_modifying, y, x, length, color. Fields alternate lines."""
    objects = _latest(bs.dvb_objects(segments), [*bs.KEY, "object_id"])
    fields = F.explode(F.array(F.struct(F.lit(0).alias("odd"), dvb_spans("top").alias("s")), F.struct(F.lit(1).alias("odd"), dvb_spans("bottom").alias("s"))))
    each = objects.select(*bs.KEY, "object_id", "non_modifying", fields.alias("f")).select(*bs.KEY, "object_id", "non_modifying", "f.odd", F.explode("f.s").alias("s"))
    return each.select(*bs.KEY, "object_id", "non_modifying", (F.col("s.line") * 2 + F.col("odd")).alias("y"), F.col("s.x").alias("x"), F.col("s.length").alias("length"), F.col("s.color").alias("color"))


def object_sizes(spans: DataFrame) -> DataFrame:
    """width and height of every object: the ends of its longest and its last line."""
    return spans.groupBy(*bs.KEY, "object_id").agg(F.max(F.col("x") + F.col("length")).alias("width"), (F.max("y") + 1).alias("height"))


def placed_objects(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Objects that a page shows: left, top, width, height on the page, depth, clut_id, and the order of painting."""
    places = bs.dvb_region_places(segments).withColumnsRenamed({"x": "region_x", "y": "region_y", "i": "region_order"}).drop("seg_no")
    regions = _latest(bs.dvb_regions(segments), [*bs.KEY, "region_id"]).select(*bs.KEY, "region_id", "depth", "clut_id")
    objects = bs.dvb_object_places(segments).withColumnsRenamed({"x": "object_x", "y": "object_y", "seg_no": "region_seg", "i": "object_order"})
    shown = bs.matched(bs.matched(places, regions, [*bs.KEY, "region_id"]), objects, [*bs.KEY, "region_id"])
    shown = bs.matched(shown, object_sizes(spans), [*bs.KEY, "object_id"])
    return shown.select(
        *bs.KEY, "object_id", "depth", "clut_id", (F.col("region_x") + F.col("object_x")).alias("left"), (F.col("region_y") + F.col("object_y")).alias("top"), "width", "height",
        F.struct("region_order", "region_seg", "object_order").alias("paint"),
    )


def bounding_boxes(placed: DataFrame) -> DataFrame:
    """left, top, width, height of the picture of every display set that shows an object."""
    box = placed.groupBy(*bs.KEY).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"))
    return box.select(*bs.KEY, "left", "top", (F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"))


def _default_colors(spark: SparkSession) -> DataFrame:
    """bits, entry, rgba of the default tables: 276 rows."""
    tables = [color.default_clut(spark, n).select(F.lit(n).alias("bits"), "entry", rgba(F.col("r"), F.col("g"), F.col("b"), 255 - F.col("t")).alias("default_rgba")) for n in (2, 4, 8)]
    return tables[0].union(tables[1]).union(tables[2])


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return r.cast("long") * (1 << 24) + g.cast("long") * (1 << 16) + b.cast("long") * 256 + a.cast("long")


def custom_colors(segments: DataFrame) -> DataFrame:
    """display-set key, clut_id, bits, entry, rgba of entries that a stream defines; the last definition counts.

    An entry of luma 0 is transparent. Entries of reduced resolution count as the high bits of their values.
    """
    e = bs.dvb_clut_entries(segments)
    y, cr, cb = F.col("y"), F.col("cr"), F.col("cb")
    full, reduced = color.bt601_to_rgb(y, cb, cr, True), color.bt601_to_rgb(y, cb, cr, False)
    painted = F.when(F.col("full") == 1, rgba(*full, 255 - F.col("t"))).otherwise(rgba(*reduced, 255 - F.col("t")))
    sizes = F.array_compact(F.array(*[F.when(F.col(f"f{n}") == 1, F.lit(n)) for n in (2, 4, 8)]))
    each = e.withColumn("rgba", F.when(y == 0, F.lit(0)).otherwise(painted)).withColumn("bits", F.explode(sizes))
    each = each.withColumn("entry", F.col("entry").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("bits")) - 1).cast("int"))
    return _latest(each.select(*bs.KEY, "clut_id", "bits", "entry", "seg_no", "i", "rgba"), [*bs.KEY, "clut_id", "bits", "entry"])


#: Which defined table a region of each depth looks in: first the one of its own, then these.
ORDER = {2: (2, 8, 4), 4: (4, 8, 2), 8: (8, 4, 2)}


def page_spans(segments: DataFrame) -> DataFrame:
    """Spans on the pages' pictures: display-set key, box, paint, y, x, length, rgba, in coordinates of the bounding box."""
    spans = object_spans(segments)
    placed = placed_objects(segments, spans)
    customs = custom_colors(segments)
    have = customs.groupBy(*bs.KEY, "clut_id").agg(F.collect_set("bits").alias("have"))
    depth = F.call_function("shiftleft", F.lit(1), F.col("depth").cast("int"))
    known = F.coalesce(F.col("have"), F.array().cast("array<int>"))
    table = F.lit(None).cast("int")
    for own, order in ORDER.items():
        first = F.coalesce(*[F.when(F.array_contains(known, n), F.lit(n)) for n in order], F.lit(own))
        table = F.when(F.col("own_bits") == own, first).otherwise(table)
    placed = bs.matched(placed, have, [*bs.KEY, "clut_id"], "left").withColumn("own_bits", depth.cast("int")).withColumn("bits", table).drop("have")
    boxes = bounding_boxes(placed).select(*bs.KEY, F.struct("left", "top", "width", "height").alias("box"))
    placed = bs.matched(placed, boxes, bs.KEY).withColumn("dx", F.col("left") - F.col("box.left")).withColumn("dy", F.col("top") - F.col("box.top"))
    # An object covers its whole rectangle, so what its lines leave open is transparent.
    blank = placed.select(*bs.KEY, "paint", F.lit(0).alias("layer"), F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y0"), "dx", "dy", "width", "box")
    blank = blank.select(*bs.KEY, "box", "paint", "layer", (F.col("y0") + F.col("dy")).alias("y"), F.col("dx").alias("x"), F.col("width").alias("length"), F.lit(0).cast("long").alias("rgba"))
    runs = bs.matched(spans, placed.drop("width", "height"), [*bs.KEY, "object_id"])
    own = F.col("color").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("own_bits")) - 1)
    entry = own
    for a in (2, 4, 8):
        for b in (2, 4, 8):
            if a != b:
                entry = F.when((F.col("own_bits") == a) & (F.col("bits") == b), color.map_depth(own, a, b)).otherwise(entry)
    runs = runs.withColumn("entry", entry.cast("int")).withColumn("open", (F.col("non_modifying") == 1) & (own == 1))
    runs = bs.matched(runs, customs, [*bs.KEY, "clut_id", "bits", "entry"], "left").join(F.broadcast(_default_colors(segments.sparkSession)), ["bits", "entry"], "left")
    value = F.when(F.col("open"), F.lit(0)).otherwise(F.coalesce("rgba", "default_rgba")).cast("long")
    runs = runs.select(*bs.KEY, "box", "paint", F.lit(1).alias("layer"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "length", value.alias("rgba"))
    return blank.unionByName(runs)


@F.pandas_udf(T.BinaryType())
def painted(width: pd.Series, height: pd.Series, spans: pd.Series) -> pd.Series:
    """RGBA pixels, row by row, of spans (y, x, length, rgba) laid over each other in order; outside parts are cut."""
    out = []
    for w, h, rows in zip(width, height, spans, strict=True):
        picture = np.zeros((h, w), ">u4")
        for s in rows:
            if 0 <= s["y"] < h:
                picture[s["y"], max(s["x"], 0) : max(s["x"] + s["length"], 0)] = s["rgba"]
        out.append(picture.tobytes())
    return pd.Series(out)


def compositions(segments: DataFrame) -> DataFrame:
    """One picture a display set: its key, left, top, width, height, pixels (RGBA)."""
    spans = page_spans(segments)
    ordered = F.array_sort(F.collect_list(F.struct("paint", "layer", "y", "x", "length", "rgba")))
    whole = spans.groupBy(*bs.KEY, "box").agg(ordered.alias("spans"))
    pixels = painted(F.col("box.width").cast("int"), F.col("box.height").cast("int"), "spans")
    return whole.select(*bs.KEY, "box.left", "box.top", "box.width", "box.height", pixels.alias("pixels"))


# sub-pictures of program streams


def with_commands(pictures: DataFrame) -> DataFrame:
    """pictures with the commands of their units; those that have them stay as they are."""
    return pictures if "commands" in pictures.columns else pictures.withColumn("commands", bs.control_commands("data", F.col("control_at").cast("int")))


def sub_picture_fields(pictures: DataFrame) -> DataFrame:
    """with_commands() of units that show something, one row a unit, with x0, y0, width, height, map, contrast, and even and odd, the spans of the two fields.

    The last command of a kind counts.
    """
    args = lambda kind: F.element_at(F.filter("commands", lambda c: c["command"] == kind), -1)["args"]
    df = with_commands(pictures).withColumns({"map": args(3), "contrast": args(4), "area": args(5), "fields": args(6)}).filter("area IS NOT NULL AND fields IS NOT NULL")
    a = u(F.col("area"), 0, 6)
    x0, x1, y0, y1 = (bits(a, s, 12) for s in (36, 24, 12, 0))
    df = df.withColumns({"x0": x0, "y0": y0, "width": (x1 - x0 + 1).cast("int"), "height": (y1 - y0 + 1).cast("int")}).filter("width > 0 AND height > 0")
    at = lambda n: u(F.col("fields"), n, 2).cast("int")
    field = lambda n: vob_spans(F.substring("data", at(n) + 1, F.length("data")), F.col("width"))
    return df.withColumns({"even": field(0), "odd": field(2)}).drop("area", "fields")


def sub_picture_spans(pictures: DataFrame) -> DataFrame:
    """Pictures of units (file_id, substream, spu_no, control_at, data): their key, x0, y0, width, height and spans.

    Lines of the first field are the even ones. A span's color is one of the index file's palette, alpha is 0 to 255.
    """
    key = ["file_id", "substream", "spu_no"]
    df = sub_picture_fields(pictures)
    both = F.explode(F.array(F.struct(F.lit(0).alias("odd"), F.col("even").alias("s")), F.struct(F.lit(1).alias("odd"), F.col("odd").alias("s"))))
    each = df.select(*key, "x0", "y0", "width", "height", "map", "contrast", both.alias("f")).select("*", F.explode("f.s").alias("s"))
    each = each.withColumn("y", F.col("s.line") * 2 + F.col("f.odd")).filter("y < height")
    nibble = lambda c: F.call_function("shiftright", F.conv(F.hex(c), 16, 10).cast("int"), F.col("s.color") * 4).bitwiseAND(15)
    return each.select(*key, "x0", "y0", "width", "height", "y", F.col("s.x").alias("x"), F.col("s.length").alias("length"), nibble(F.col("map")).alias("color"), (nibble(F.col("contrast")) * 17).alias("alpha"))


def sub_picture_images(spans: DataFrame, palette: DataFrame) -> DataFrame:
    """pixels (RGBA) of every unit; palette: file_id, color, rgb (long) of the index file, 16 rows a file."""
    key = ["file_id", "substream", "spu_no", "x0", "y0", "width", "height"]
    colored = bs.matched(spans, palette, ["file_id", "color"], "left").withColumn("rgba", F.coalesce("rgb", F.lit(0)).cast("long") * 256 + F.col("alpha"))
    whole = colored.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("y", "x", "length", "rgba"))).alias("spans"))
    return whole.select(*key, painted("width", "height", "spans").alias("pixels"))


def with_times(pictures: DataFrame) -> DataFrame:
    """with_commands() with start_ms and end_ms: delays of the commands that start and stop the display, in steps of 1024 ticks.

    Without an end after the start a picture stays for five seconds.
    """
    df = with_commands(pictures)
    delay = lambda *kinds: F.array_min(F.transform(F.filter("commands", lambda c: c["command"].isin(*kinds)), lambda c: c["delay"]))
    ms = lambda d: F.floor((d * 1024 + 45) / 90).cast("long")
    out = df.withColumn("start_ms", F.col("pts_ms") + F.coalesce(ms(delay(0, 1)), F.lit(0))).withColumn("e", F.col("pts_ms") + ms(delay(2)))
    end = F.when(F.col("e") > F.col("start_ms"), F.col("e")).otherwise(F.col("start_ms") + 5000)
    return out.withColumn("end_ms", end).drop("e")


def sub_picture_times(pictures: DataFrame) -> DataFrame:
    """file_id, substream, spu_no, start_ms, end_ms of units, as with_times() has them."""
    return with_times(pictures).select("file_id", "substream", "spu_no", "start_ms", "end_ms")


def numbered(df: DataFrame) -> DataFrame:
    """sub_no from 1 in every file by time."""
    return df.withColumn("sub_no", F.row_number().over(Window.partitionBy("file_id").orderBy("start_ms", "end_ms")))
