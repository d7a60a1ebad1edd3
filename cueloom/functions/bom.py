"""Byte-order marks and leading bytes, as expressions over BINARY columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Byte-order marks by number, name and bytes.
BOMS: list[tuple[int, str, str]] = [
    (1, "UTF-8", "EFBBBF"),
    (2, "UTF-16 (BE)", "FEFF"),
    (3, "UTF-16 (LE)", "FFFE"),
    (4, "UTF-32 (BE)", "0000FEFF"),
    (5, "UTF-32 (LE)", "FFFE0000"),
    (6, "UTF-7", "2B2F76"),
    (7, "UTF-1", "F7644C"),
    (8, "UTF-EBCDIC", "DD736673"),
    (9, "SCSU", "0EFEFF"),
    (10, "BOCU-1", "FBEE28"),
    (11, "GB18030", "84319533"),
]
#: Leading bytes of files that are not text.
MAGICS: list[tuple[str, str]] = [
    ("FFD8FF", "jpeg"),
    ("89504E47", "png"),
    ("47494638", "gif"),
    ("504B0304", "zip"),
    ("1F8B", "gzip"),
    ("25504446", "pdf"),
    ("435753", "swf"),
    ("465753", "swf"),
    ("7F454C46", "elf"),
    ("4D4D002A", "tiff"),
    ("49492A00", "tiff"),
    ("38425053", "psd"),
    ("789C", "zlib"),
    ("2A004D4D", "tiff"),
    ("01666370", "final cut"),
    ("43435344", "ccsd"),
    ("53494D50", "fits"),
    ("48575020446F63756D656E742046696C652056", "hwp"),
    ("4857502E446F63756D656E742E46696C652E56", "hwp"),
    ("5044535F56455253494F4E5F4944", "pds"),
]
_LONGEST_FIRST = sorted(BOMS, key=lambda b: (-len(b[2]), b[0]))


def _first(content: Column, n: int = 4) -> Column:
    return F.hex(F.substring(content, 1, n))


def bom_id(content: Column) -> Column:
    """Number of the mark that content begins with, the longest counting; 0: none."""
    head, out = _first(content), F
    for no, _, mark in _LONGEST_FIRST:
        out = out.when(head.startswith(mark), F.lit(no))
    return out.otherwise(F.lit(0))


def bom_name(content: Column) -> Column:
    head, out = _first(content), F
    for _, name, mark in _LONGEST_FIRST:
        out = out.when(head.startswith(mark), F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def strip_bom(content: Column) -> Column:
    head, out = _first(content), F
    for _, _, mark in _LONGEST_FIRST:
        out = out.when(head.startswith(mark), F.expr(f"{len(mark) // 2}"))
    return F.substring(content, out.otherwise(0) + 1, F.length(content))


def write_bom(content: Column, no: int) -> Column:
    """content with a mark in front, unless it has one."""
    mark = next(m for n, _, m in BOMS if n == no)
    return F.when(bom_id(content) == 0, F.concat(F.unhex(F.lit(mark)), content)).otherwise(content)


def magic(content: Column) -> Column:
    head, out = _first(content, max(len(m) for m, _ in MAGICS) // 2), F
    for prefix, name in MAGICS:
        out = out.when(head.startswith(prefix), F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def plain_ascii(text: Column) -> Column:
    """Printable ASCII, tabs and line ends only."""
    return text.rlike(r"^[\x09\x0A\x0D\x20-\x7E]*$")
