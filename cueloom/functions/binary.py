"""Big-endian fields of BINARY columns, ordered joins of fragments, byte patches, run lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def u(data: Column, offset: Column | int, size: int) -> Column:
    """Unsigned integer of size bytes at a 0-based offset; null beyond the end."""
    at = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    part = F.substring(data, at, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def bits(value: Column, shift: int, width: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def joined(order: Column, data: Column) -> Column:
    """Aggregate: data in ascending order, as one BINARY."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.hex(data).alias("d"))))
    return F.unhex(F.array_join(F.transform(parts, lambda x: x["d"]), ""))


def patched(content: Column, changes: Column) -> Column:
    """content with changes (array<struct<offset, bytes BINARY>>, offsets from 0) put over it, in any order."""
    return F.aggregate(changes, content, lambda acc, c: F.overlay(acc, c["bytes"], c["offset"].cast("int") + 1, F.length(c["bytes"])))


RUNS = T.ArrayType(T.StructType([T.StructField("color", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("line", T.IntegerType())]))


def pgs_runs(data: bytes) -> list[tuple[int, int, int]]:
    """Colour, length and line of the runs of a presentation-graphics object."""
    out, i, line = [], 0, 0
    while i < len(data):
        c = data[i]
        i += 1
        if c:
            out.append((c, 1, line))
            continue
        if i >= len(data):
            break
        f = data[i]
        i += 1
        if f == 0:
            line += 1
            continue
        n = f & 63
        if f & 64 and i < len(data):
            n = n << 8 | data[i]
            i += 1
        color = 0
        if f & 128 and i < len(data):
            color = data[i]
            i += 1
        out.append((color, n, line))
    return out


def vob_runs(data: bytes, width: int) -> list[tuple[int, int, int]]:
    """Runs of one field of a sub-picture; lines start at whole bytes."""
    half = np.frombuffer(data, np.uint8)
    half = np.stack([half >> 4, half & 15], axis=1).ravel().tolist()
    out, i, line, x = [], 0, 0, 0
    while i < len(half):
        v, n = half[i], 1
        while n < 4 and v < 1 << 2 * n and i + n < len(half):
            v, n = v << 4 | half[i + n], n + 1
        i += n
        length, color = v >> 2, v & 3
        length = width - x if length == 0 else min(length, width - x)
        out.append((color, length, line))
        x += length
        if x >= width:
            x, line = 0, line + 1
            i += i % 2
    return out


#: Fixed values of code strings: width of a pixel, and for zero runs etc. see dvb_runs.
def dvb_runs(data: bytes) -> list[tuple[int, int, int]]:
    """Runs of one field of a DVB object: code strings of 2, 4 and 8 bits; 0xF0 ends a line."""
    out, pos, line = [], 0, 0
    n_bits = len(data) * 8

    def take(n: int) -> int:
        nonlocal pos
        v = 0
        for _ in range(n):
            v = v << 1 | (data[pos >> 3] >> (7 - (pos & 7)) & 1 if pos < n_bits else 0)
            pos += 1
        return v

    def two() -> bool:
        c = take(2)
        if c:
            out.append((c, 1, line))
        elif take(1):
            n = take(3) + 3
            out.append((take(2), n, line))
        elif take(1):
            out.append((0, 1, line))
        else:
            k = take(2)
            if k == 0:
                return False
            if k == 1:
                out.append((0, 2, line))
            else:
                n = take(4) + 12 if k == 2 else take(8) + 29
                out.append((take(2), n, line))
        return True

    def four() -> bool:
        c = take(4)
        if c:
            out.append((c, 1, line))
        elif not take(1):
            n = take(3)
            if n == 0:
                return False
            out.append((0, n + 2, line))
        elif not take(1):
            n = take(2) + 4
            out.append((take(4), n, line))
        else:
            k = take(2)
            if k < 2:
                out.append((0, k + 1, line))
            else:
                n = take(4) + 9 if k == 2 else take(8) + 25
                out.append((take(4), n, line))
        return True

    def eight() -> bool:
        c = take(8)
        if c:
            out.append((c, 1, line))
        elif not take(1):
            n = take(7)
            if n == 0:
                return False
            out.append((0, n, line))
        else:
            n = take(7)
            out.append((take(8), n, line))
        return True

    while pos + 8 <= n_bits:
        kind = take(8)
        if kind == 0xF0:
            line += 1
            continue
        step = {0x10: two, 0x11: four, 0x12: eight}.get(kind)
        if step is None:
            break
        while pos < n_bits and step():
            pass
        pos = (pos + 7) & ~7
    return out


def _udf(f):
    @F.udf(RUNS, useArrow=True)
    def run(data, *args):
        return None if data is None else f(bytes(data), *args)

    return run


decode_pgs = _udf(pgs_runs)
decode_vob = _udf(vob_runs)
decode_dvb = _udf(dvb_runs)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _rows(color: pd.Series, length: pd.Series, line: pd.Series, palette: pd.Series, missing: pd.Series) -> pd.Series:
    out = []
    for colors, lengths, lines, known, other in zip(color, length, line, palette, missing, strict=True):
        if lines is None or known is None or not len(lines):
            out.append(None)
            continue
        names = [other if k is None else k for k in known]
        rows: list[list[str]] = [[] for _ in range(max(lines) + 1)]
        for c, n, i in zip(colors, lengths, lines, strict=True):
            rows[i].append((names[c] if c < len(names) else other) * n)
        out.append(["".join(r) for r in rows])
    return pd.Series(out, dtype=object)


def pixel_rows(runs: Column, palette: Column, missing: str = "000000") -> Column:
    """Hex rows of runs by line, through a palette of strings of one length, as RRGGBB; a line without runs is an empty row. One pass over the runs."""
    return _rows(runs.getField("color"), runs.getField("length"), runs.getField("line"), palette, F.lit(missing))
