"""Clocks and ticks as column expressions. The canonical time is a LONG of milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SubRip time line; a two-digit millisecond part of the start is tolerated and taken as it is.
TIME_LINE = r"^(\d\d):(\d\d):(\d\d)[,.](\d{2,3}) --> (\d\d):(\d\d):(\d\d)[,.](\d{3})"
STRICT_LINE = r"^\d\d:\d\d:\d\d,\d\d\d --> \d\d:\d\d:\d\d,\d\d\d"
CLOCK = r"^(-?)(\d+)[:_](\d\d)[:_](\d\d)[,.:_](\d{1,3})"


def div(a: Column, b: int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def clock_parts(h: Column, m: Column, s: Column, ms: Column) -> Column:
    return ((h.cast("long") * 60 + m.cast("long")) * 60 + s.cast("long")) * 1000 + ms.cast("long")


def _group(text: Column, pattern: str, no: int) -> Column:
    return F.regexp_extract(text, pattern, no)


def clock_to_ms(text: Column) -> Column:
    """Milliseconds of hh:mm:ss,mmm (any of , . : _ before the milliseconds); null if malformed."""
    value = clock_parts(*[_group(text, CLOCK, i) for i in (2, 3, 4, 5)])
    signed = F.when(_group(text, CLOCK, 1) == "-", -value).otherwise(value)
    return F.when(text.rlike(CLOCK), signed)


def line_start_ms(line: Column) -> Column:
    return F.when(line.rlike(TIME_LINE), clock_parts(*[_group(line, TIME_LINE, i) for i in (1, 2, 3, 4)]))


def line_end_ms(line: Column) -> Column:
    return F.when(line.rlike(TIME_LINE), clock_parts(*[_group(line, TIME_LINE, i) for i in (5, 6, 7, 8)]))


def two_digit_start(line: Column) -> Column:
    """Whether the start's millisecond part has two digits."""
    return F.when(line.rlike(TIME_LINE), F.length(_group(line, TIME_LINE, 4)) == 2)


def ms_to_clock(ms: Column, separator: str = ",") -> Column:
    """hh:mm:ss,mmm; negative values get one sign in front."""
    a = F.abs(ms)
    body = F.format_string(f"%02d:%02d:%02d{separator}%03d", div(a, 3_600_000), div(a, 60_000) % 60, div(a, 1000) % 60, a % 1000)
    return F.when(ms < 0, F.concat(F.lit("-"), body)).otherwise(body)


def clock_fields(ms: Column) -> Column:
    """struct<h, m, s, ms>, each truncated toward zero."""
    return F.struct(
        div(ms, 3_600_000).cast("int").alias("h"),
        (div(ms, 60_000) % 60).cast("int").alias("m"),
        (div(ms, 1000) % 60).cast("int").alias("s"),
        (ms % 1000).cast("int").alias("ms"),
    )


def ssa_clock_to_ms(text: Column) -> Column:
    """h:mm:ss.cc of SubStation Alpha."""
    p = r"^\s*(\d+):(\d{1,2}):(\d{1,2})(?:\.(\d{1,3}))?"
    fraction = F.rpad(_group(text, p, 4), 3, "0")
    return F.when(text.rlike(p), clock_parts(*[_group(text, p, i) for i in (1, 2, 3)], fraction))


def ticks_to_ms(ticks: Column) -> Column:
    """90 kHz ticks, rounded."""
    return div(ticks + 45, 90)


def clock27_to_ms(ticks: Column) -> Column:
    """27 MHz ticks, rounded."""
    return div(ticks + 13_500, 27_000)


def spu_delay_to_ms(delay: Column) -> Column:
    """Delays of sub-picture units, in 1024/90000 s."""
    return div(delay.cast("long") * 1_024_000, 90_000)


def whole_hours(ms: Column) -> Column:
    """ms down to the hour, as a coarse clock tells it."""
    return div(ms, 3_600_000) * 3_600_000


def ms_to_u32(ms: Column) -> Column:
    """A 90 kHz stamp as eight hex digits; one beyond 32 bits (from 13 h 15 min on) has more, nothing is cut. A field takes the last eight."""
    return F.format_string("%08X", ms.cast("long") * 90)


def unwrapped(ticks: Column, near: Column, bits: int) -> Column:
    """The time, not below zero, that is closest to near of all that a stamp of so many bits stands for."""
    turns = F.greatest(F.shiftright(near + (1 << bits - 1) - ticks, bits), F.lit(0).cast("long"))
    return ticks + turns * (1 << bits)


def ms_to_pes_stamp(ms: Column, prefix: int = 2) -> Column:
    """A 33-bit 90 kHz stamp as the ten hex digits of its five bytes with marker bits."""
    t = ms.cast("long") * 90

    def bits(shift: int, mask: int) -> Column:
        return F.shiftright(t, shift).bitwiseAND(F.lit(mask).cast("long"))

    b0 = F.lit(prefix << 4).cast("long").bitwiseOR(bits(30, 7) * 2).bitwiseOR(F.lit(1).cast("long"))
    b2 = (bits(15, 127) * 2).bitwiseOR(F.lit(1).cast("long"))
    b4 = (bits(0, 127) * 2).bitwiseOR(F.lit(1).cast("long"))
    return F.concat(*[F.lpad(F.hex(b), 2, "0") for b in (b0, bits(22, 255), b2, bits(7, 255), b4)])


def pes_stamp_ticks(hex_digits: Column, near_ms: Column | None = None) -> Column:
    """Ticks of five stamp bytes given as hex. Their 33 bits begin anew every 26.5 hours; near_ms, a time within 13 hours of the
    stamp's such as that of a clock beside it, says which of the times is meant."""
    b = [F.conv(F.substring(hex_digits, 2 * i + 1, 2), 16, 10).cast("long") for i in range(5)]
    top = F.shiftleft(F.shiftright(b[0], 1).bitwiseAND(F.lit(7).cast("long")), 30)
    ticks = top + b[1] * (1 << 22) + F.shiftright(b[2], 1) * (1 << 15) + b[3] * 128 + F.shiftright(b[4], 1)
    return ticks if near_ms is None else unwrapped(ticks, near_ms.cast("long") * 90, 33)


#: Frames a second of each rate code.
FRAME_RATES = {0x10: 24000 / 1001, 0x20: 24.0, 0x30: 25.0, 0x40: 30000 / 1001, 0x50: 30.0, 0x60: 50.0, 0x70: 60000 / 1001}
OTHER_RATE = 23.976


def frame_rate(code: Column) -> Column:
    out = F
    for k, v in FRAME_RATES.items():
        out = out.when(code == k, F.lit(v))
    return out.otherwise(F.lit(OTHER_RATE))
