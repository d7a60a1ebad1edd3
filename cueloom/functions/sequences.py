"""Checkers of byte sequences: each is an automaton, run as a pattern or over arrays, that counts the sequences of an
encoding that are well formed and those that are not."""

from __future__ import annotations

import base64
import re

import numpy as np

Counts = tuple[int, int]


def utf8(data: np.ndarray, high: int) -> tuple[int, int, int]:
    """Well-formed sequences, bytes beyond ASCII in none, and how many of the latter are a sequence that the end cuts.

    data: the bytes; high: how many of them are beyond ASCII."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    goes_on = (padded & 0xC0) == 0x80
    one, two, three = goes_on[1:-2], goes_on[2:-1], goes_on[3:]
    second = padded[1:-2]
    # no longer forms than needed, no surrogates, nothing beyond the last plane
    ok = [
        (data >= 0xC2) & (data < 0xE0) & one,
        (data >= 0xE0) & (data < 0xF0) & one & two & ~((data == 0xE0) & (second < 0xA0)) & ~((data == 0xED) & (second > 0x9F)),
        (data >= 0xF0) & (data < 0xF5) & one & two & three & ~((data == 0xF0) & (second < 0x90)) & ~((data == 0xF4) & (second > 0x8F)),
    ]
    n = [int(np.count_nonzero(x)) for x in ok]
    stray = high - 2 * n[0] - 3 * n[1] - 4 * n[2]
    tail = _CUT.search(data[-3:].tobytes())
    return sum(n), stray, len(tail[0]) if tail else 0


def utf8_most(counts: np.ndarray) -> int:
    """The most bytes that can be in well-formed sequences; counts: how often each byte stands in a text."""
    two, three, four = counts[0xC2:0xE0].sum(), counts[0xE0:0xF0].sum(), counts[0xF0:0xF5].sum()
    return int(min(2 * counts[0x80:0xC0].sum(), 2 * two + 3 * three + 4 * four))


#: A sequence that the end cuts.
_CUT = re.compile(rb"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})\Z")
_GB4 = re.compile(rb"[\x81-\x84\x90-\xe3][0-9][\x81-\xfe][0-9]")
_GB2 = re.compile(rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]")


def gb18030(data: bytes, high: int) -> Counts:
    """Sequences of four bytes, and bytes beyond ASCII that are in no sequence."""
    raw = np.frombuffer(data, np.uint8)
    digit, beyond = (raw - np.uint8(48)) < 10, raw > 127
    if len(raw) < 4 or not (beyond[:-3] & digit[1:-2] & beyond[2:-1] & digit[3:]).any():
        return 0, high
    four = len(_GB4.findall(data))
    rest = _GB4.sub(b"", data)
    pairs = b"".join(_GB2.findall(rest))
    inside = 2 * four + int((np.frombuffer(pairs, np.uint8) > 127).sum())
    return four, high - inside


_EUC_JP = re.compile(rb"(?:[\xa1-\xa8\xb0-\xf4][\xa1-\xfe]|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2})+")


def euc_jp(data: bytes, high: int) -> Counts:
    """Bytes in sequences of two or three, and bytes beyond ASCII in none."""
    inside = sum(map(len, _EUC_JP.findall(data)))
    return inside // 2, high - inside


_JP_ESCAPE = re.compile(rb"\x1b(?:\$[@B]|\$\([D@B]|\([BJI])")
_PAIRS = re.compile(rb"(?:[\x21-\x7e]{2}|[\r\n])*")
#: Good runs with what must follow them, found in one pass. Where all are good none is looked at alone.
_JP_GOOD = re.compile(rb"\x1b\$(?:[@B]|\([D@B])(?:(?:[\x21-\x7e]{2})++|[\r\n])++(?=\x1b(?:\$[@B]|\$\([D@B]|\([BJI]))")
_KR_GOOD = re.compile(rb"\x0e(?:(?:[\x21-\x7e]{2})++|[\r\n])++(?:\x0f|\Z)")
_HZ_GOOD = re.compile(rb"~\{(?:[\x21-\x77][\x21-\x7e])++~\}")


def iso2022_jp(data: bytes) -> Counts:
    """Runs in two-byte sets that have whole pairs, and those that have not or that nothing ends."""
    good = len(_JP_GOOD.findall(data))
    if good == sum(map(data.count, (b"\x1b$@", b"\x1b$B", b"\x1b$(D", b"\x1b$(@", b"\x1b$(B"))):
        return good, 0
    good = bad = 0
    marks = list(_JP_ESCAPE.finditer(data))
    for mark, after in zip(marks, [*marks[1:], None], strict=False):
        if b"$" in mark[0]:
            run = data[mark.end() : after.start() if after else len(data)]
            fine = bool(run) and _PAIRS.fullmatch(run) is not None and (after is not None or b"\n" not in run.rstrip(b"\r\n"))
            good, bad = good + fine, bad + (not fine)
    return good, bad


_KR_HEAD = b"\x1b$)C"
_KR_RUN = re.compile(rb"\x0e([^\x0e\x0f]*)(\x0f|\Z)")


def iso2022_kr(data: bytes) -> Counts:
    """Shifted runs of whole pairs after the heading, and others; without the heading none is good."""
    good = len(_KR_GOOD.findall(data))
    if good == data.count(b"\x0e") and _KR_HEAD in data:
        return good, 0
    runs = _KR_RUN.findall(data)
    if not data.lstrip().startswith(_KR_HEAD) and _KR_HEAD not in data:
        return 0, len(runs)
    good = sum(1 for run, _ in runs if run and _PAIRS.fullmatch(run.replace(b" ", b"")))
    return good, len(runs) - good


_HZ = re.compile(rb"~\{((?:[^~]|~(?!\}))*)(~\}|\Z)")


def hz(data: bytes) -> Counts:
    """Runs between ~{ and ~} of whole pairs of GB 2312, and others."""
    good = len(_HZ_GOOD.findall(data))
    if good == data.count(b"~{"):
        return good, 0
    runs = _HZ.findall(data)
    good = sum(1 for run, end in runs if end and run and len(run) % 2 == 0 and re.fullmatch(rb"(?:[\x21-\x77][\x21-\x7e])+", run))
    return good, len(runs) - good


_UTF7 = re.compile(rb"\+([A-Za-z0-9/]*)(-?)")


def utf7(data: bytes) -> Counts:
    """Shifted runs that are UTF-16 in base 64, and plus signs that begin none."""
    good = bad = 0
    for run, end in _UTF7.findall(data):
        if not run:
            bad += not end
            continue
        units, rest = divmod(len(run) * 6, 16)
        try:
            raw = base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
            text = raw[: 2 * units].decode("utf-16-be")
            fine = units > 0 and rest < 6 and not any(raw[2 * units :]) and any(c > "\x7f" or c in "~\\+&<>{}|=" for c in text) and all(c.isprintable() or c in "\r\n\t" for c in text)
        except (ValueError, UnicodeDecodeError):
            fine = False
        good, bad = good + fine, bad + (not fine)
    return good, bad


#: Control bytes that text does not have: all but tab, line feed, form feed, carriage return, shifts and escape.
_CONTROL = np.isin(np.arange(256), [*range(9), 11, *range(16, 27), *range(28, 32), 127]).astype(np.int64)


def binary_density(counts: np.ndarray) -> float:
    """Share of control bytes among all; counts: how often each byte stands in a text."""
    return float(counts @ _CONTROL / max(1, counts.sum()))
