"""Colour conversion as column expressions, and the luma constants of BT.709 from its primaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: BT.709 luma weights to ten digits, and those of BT.601.
KR, KG, KB = 0.2126390059, 0.7151686788, 0.0721923154
KR_601, KB_601 = 0.299, 0.114


def _clip(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.greatest((x + 0.5).cast("int"), F.lit(low)), F.lit(high))


def _rgb(y: Column, cb: Column, cr: Column, kr: float, kb: float) -> list[Column]:
    """Non-linear RGB of normalised components."""
    kg = 1 - kr - kb
    r = y + cr * (2 * (1 - kr))
    b = y + cb * (2 * (1 - kb))
    return [r, (y - r * kr - b * kb) / kg, b]


def _bt709_to_srgb(v: Column) -> Column:
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    linear = F.when(v < 0.081, v / 4.5).otherwise(F.pow((v + 0.099) / 1.099, F.lit(1 / 0.45)))
    return F.when(linear <= 0.0031308, linear * 12.92).otherwise(F.pow(linear, F.lit(1 / 2.4)) * 1.055 - 0.055)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    """8-bit sRGB of limited-range BT.709."""
    parts = _rgb((y - 16) / 219.0, (cb - 128) / 224.0, (cr - 128) / 224.0, KR, KB)
    return [_clip(_bt709_to_srgb(p) * 255.0) for p in parts]


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    """Limited-range BT.709 of 8-bit sRGB."""

    def encoded(c: Column) -> Column:
        v = c / 255.0
        linear = F.when(v <= 12.92 * 0.0031308, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
        return F.when(linear < 0.018, linear * 4.5).otherwise(F.pow(linear, F.lit(0.45)) * 1.099 - 0.099)

    er, eg, eb = encoded(r), encoded(g), encoded(b)
    y = er * KR + eg * KG + eb * KB
    return [_clip(y * 219.0 + 16.0, 16, 235), _clip((eb - y) / (2 * (1 - KB)) * 224.0 + 128.0, 16, 240), _clip((er - y) / (2 * (1 - KR)) * 224.0 + 128.0, 16, 240)]


def bt601_to_rgb(y: Column, cb: Column, cr: Column, full_range: bool) -> list[Column]:
    """8-bit RGB of BT.601, without a change of transfer function."""
    if full_range:
        parts = _rgb(y / 255.0, (cb - 128) / 255.0, (cr - 128) / 255.0, KR_601, KB_601)
    else:
        parts = _rgb((y - 16) / 219.0, (cb - 128) / 224.0, (cr - 128) / 224.0, KR_601, KB_601)
    return [_clip(p * 255.0) for p in parts]


@dataclass(frozen=True)
class Primaries:
    """Chromaticities x, y of red, green, blue and white."""

    red: tuple[float, float] = (0.64, 0.33)
    green: tuple[float, float] = (0.30, 0.60)
    blue: tuple[float, float] = (0.15, 0.06)
    white: tuple[float, float] = (0.3127, 0.3290)


def luma_weights(spark: SparkSession, p: Primaries | None = None) -> DataFrame:
    """kr, kg, kb: the row of luminance of the normalised primary matrix, by Cramer's rule in SQL."""
    p = p or Primaries()
    at = {n: F.lit(float(v)) for n, v in zip(("xr", "yr", "xg", "yg", "xb", "yb", "xw", "yw"), (*p.red, *p.green, *p.blue, *p.white), strict=True)}
    df = spark.range(1).select(*[v.alias(n) for n, v in at.items()])
    z = "(1 - x{0} - y{0})"

    def det(a: str, b: str, c: str) -> str:
        col = lambda k: ("xw/yw", "1.0D", f"({z.format('w')})/yw") if k == "w" else (f"x{k}", f"y{k}", z.format(k))
        (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = col(a), col(b), col(c)
        return f"({a1}*({b2}*{c3}-{c2}*{b3}) - {b1}*({a2}*{c3}-{c2}*{a3}) + {c1}*({a2}*{b3}-{b2}*{a3}))"

    full = det("r", "g", "b")
    return df.selectExpr(
        f"round(yr*{det('w', 'g', 'b')}/{full}, 10) AS kr", f"round(yg*{det('r', 'w', 'b')}/{full}, 10) AS kg", f"round(yb*{det('r', 'g', 'w')}/{full}, 10) AS kb"
    )


def default_clut(spark: SparkSession, bits: int) -> DataFrame:
    """entry, r, g, b, t of the default look-up tables of 2, 4 and 8 bits; t: transparency."""
    df = spark.range(1 << bits).select(F.col("id").cast("int").alias("entry"))
    bit = lambda k: F.shiftright("entry", k).bitwiseAND(1)
    zero = F.lit(0)
    if bits == 2:
        white = F.when(F.col("entry") == 1, 255).when(F.col("entry") == 3, 127).otherwise(0)
        rgb = [white, white, white]
        t = F.when(F.col("entry") == 0, 255).otherwise(zero)
    elif bits == 4:
        level = F.when(bit(3) == 0, 255).otherwise(127)
        rgb = [F.when(bit(k) == 1, level).otherwise(0) for k in (0, 1, 2)]
        t = F.when(F.col("entry") == 0, 255).otherwise(zero)
    else:
        group = bit(7) * 2 + bit(3)
        low = [F.when(F.col("entry") < 8, F.when(bit(k) == 1, 255).otherwise(0)) for k in (0, 1, 2)]
        rgb = []
        for k in (0, 1, 2):
            weighted = {
                0: bit(k) * 85 + bit(k + 4) * 170,
                1: bit(k) * 85 + bit(k + 4) * 170,
                2: bit(k) * 43 + bit(k + 4) * 85 + 127,
                3: bit(k) * 43 + bit(k + 4) * 85,
            }
            value = F.when(group == 0, weighted[0]).when(group == 1, weighted[1]).when(group == 2, weighted[2]).otherwise(weighted[3])
            rgb.append(F.coalesce(low[k], value))
        t = F.when(F.col("entry") == 0, 255).when(F.col("entry") < 8, 191).when(group == 1, 127).otherwise(zero)
    return df.select("entry", *[c.cast("int").alias(n) for c, n in zip(rgb, "rgb", strict=True)], t.cast("int").alias("t"))


def map_depth(index: Column, source: int, target: int) -> Column:
    """An entry of a table of source bits in one of target bits."""
    if source >= target:
        return F.shiftright(index, source - target) if source > target else index
    if (source, target) == (2, 4):
        return F.when(index == 1, 7).when(index == 2, 8).when(index == 3, 15).otherwise(0)
    if (source, target) == (2, 8):
        return F.when(index == 1, 0x77).when(index == 2, 0x88).when(index == 3, 0xFF).otherwise(0)
    return index * 17
