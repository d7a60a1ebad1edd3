"""Subtitle markup as column expressions: repair, removal, counts, joining lines, style tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = ("i", "b", "u", "s")
#: Texts of cues that hold ellipsis marks only. Fixed values.
ELLIPSES = ["...", "...\n...", "...\n ...", " ...\n...", "---", "---\n---", "---\n ---", " ---\n---"]
#: Lower-case letters after which a line goes on. Fixed values.
FRENCH = "àéèùâêîôûëïüç"
#: Characters after which a line goes on. Fixed values.
GOES_ON = r"[,>#-+0-;A-\[a-{\]]"


def open_re(letter: str) -> str:
    return f"(?i)< ?{letter} ?>"


def close_re(letter: str) -> str:
    return f"(?i)(?:</ ?{letter}>|</{letter} >|< / ?{letter}>|< / {letter} >)"


def font_re(attribute: str) -> str:
    """The beginning of a font tag with its accepted misspellings."""
    return f"(?i)(?:<font {attribute} ?= ?|< font {attribute}= ?|< font {attribute} = |<font{attribute}=)"


FONT_CLOSE_RE = "(?i)(?:</ ?font>|</font >|< /font ?>)"
POSITION_RE = r"(?i)\{ ?\\ ?an ?"


def fix_tags(text: Column) -> Column:
    """Misspelt tags in their plain form. Texts without a bracket are not searched further."""
    given = text
    for x in LETTERS:
        text = F.regexp_replace(text, open_re(x), f"<{x}>")
        text = F.regexp_replace(text, close_re(x), f"</{x}>")
    for a in ("color", "size"):
        text = F.regexp_replace(text, font_re(a), f"<font {a}=")
    text = F.regexp_replace(text, FONT_CLOSE_RE, "</font>")
    text = F.regexp_replace(text, POSITION_RE, r"{\\an")
    text = F.regexp_replace(text, r"([1-9]) \}", "$1}")
    return F.when(given.rlike("[<{}]"), text).otherwise(given)


def tag_count(text: Column, tag: str) -> Column:
    """Occurrences of a literal tag in any case."""
    return F.regexp_count(text, F.lit(rf"(?i)\Q{tag}\E"))


def unclosed(text: Column, kind: str) -> Column:
    """Opening tags less closing ones, not below zero; kind: a letter or font."""
    if kind == "font":
        n = tag_count(text, "<font color=") + tag_count(text, "<font size=") - tag_count(text, "</font>")
    else:
        n = tag_count(text, f"<{kind}>") - tag_count(text, f"</{kind}>")
    return F.greatest(n, F.lit(0))


def close_tags(text: Column) -> Column:
    """The text with missing closing tags at its end."""
    return F.concat(text, *[F.repeat(F.lit(f"</{k}>"), unclosed(text, k)) for k in (*LETTERS, "font")])


#: Classes of markup that can be removed, each with its patterns in order.
CLASSES = {
    **{name: [open_re(x), close_re(x)] for name, x in zip(("italic", "bold", "underline", "strike"), LETTERS, strict=True)},
    "font": [font_re("color") + "[^>]*>", font_re("size") + "[^>]*>", FONT_CLOSE_RE],
    "position": [POSITION_RE + r"[^}]*\}"],
}


def strip_tags(text: Column, classes: list[str] | None = None) -> Column:
    """The text without some classes of markup (default: all). Texts without a bracket are not searched further."""
    given = text
    for name in CLASSES if classes is None else classes:
        for pattern in CLASSES[name]:
            text = F.regexp_replace(text, pattern, "")
    return F.when(given.rlike("[<{]"), text).otherwise(given)


def leading_tags(line: Column) -> Column:
    return F.regexp_extract(line, r"^((?:<[^>]*>)+)", 1)


def later_tags(line: Column) -> Column:
    rest = F.regexp_replace(line, r"^(?:<[^>]*>)+", "")
    return F.array_join(F.regexp_extract_all(rest, F.lit(r"(<[^>]*>)")), "")


def join_first_lines(text: Column) -> Column:
    """The first two lines as one where the first does not end a sentence."""
    first = F.substring_index(text, "\n", 1)
    rest = F.substring(text, F.length(first) + 2, F.length(text))
    spaced = F.concat(first, F.lit(" "), rest)
    return (
        F.when(~text.contains("\n"), text)
        .when(first.rlike(f"{GOES_ON}$") | first.rlike(f"[{FRENCH}]$"), spaced)
        .when(first == "---", F.concat(F.lit("...\n"), rest))
        .when(first.endswith("-"), F.concat(F.regexp_replace(first, "-$", ""), rest))
        .otherwise(text)
    )


def is_ellipsis(text: Column) -> Column:
    return text.isin(ELLIPSES)


#: Positions on a numeric pad of the older alignment codes; 2 is the default.
ALIGNMENT = {1: 1, 3: 3, 5: 7, 6: 8, 7: 9, 9: 4, 10: 5, 11: 6}


def ssa_alignment(code: Column) -> Column:
    """{\\anN} of an alignment code; empty for the default, null for an unknown code."""
    out = F.when(code == 2, F.lit(""))
    for k, v in ALIGNMENT.items():
        out = out.when(code == k, F.lit(f"{{\\an{v}}}"))
    return out


def ssa_color(text: Column) -> Column:
    """#RRGGBB of &HBBGGRR, &HAABBGGRR or a decimal number."""
    hexa = F.upper(F.regexp_extract(text, r"(?i)^\s*&H([0-9A-F]+)&?", 1))
    decimal = F.hex(F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long"))
    digits = F.lpad(F.when(hexa != "", hexa).otherwise(F.coalesce(decimal, F.lit(""))), 8, "0")
    known = text.rlike(r"(?i)^\s*(&H[0-9A-F]+|\d+)")
    return F.when(known, F.concat(F.lit("#"), F.substring(digits, 7, 2), F.substring(digits, 5, 2), F.substring(digits, 3, 2)))


def fix_angles(text: Column) -> Column:
    """Spaces after < and after </ go, if a > follows."""
    return F.regexp_replace(text, r"< *(/?) *(?=[^\n]*>)", "<$1")


def ssa_to_srt(text: Column) -> Column:
    """Override tags of a dialogue as SubRip markup; unknown overrides and comments go.

    Every group in braces is cut into single overrides; openers without a closer get one at the end.
    """
    text = F.regexp_replace(fix_angles(text), r"\\[nN]", "\n")
    # one override a group, however many a group has: each begins at its brace or where the one before ended
    text = F.regexp_replace(text, r"(?:\{(?=\\[^{}]*\})|(?!^)(?<!\})\G)(\\[^{}\\]*)\}?", "{$1}")
    for x in LETTERS:
        text = F.regexp_replace(text, rf"\{{\\{x}1\}}", f"<{x}>")
        text = F.regexp_replace(text, rf"\{{\\{x}0?\}}", f"</{x}>")
    text = F.regexp_replace(text, r"(?i)\{\\1?c&H([0-9A-F]{2})([0-9A-F]{2})([0-9A-F]{2})&?\}", '<font color="#$3$2$1">')
    text = F.regexp_replace(text, r"\{\\1?c\}", "</font>")
    text = F.regexp_replace(text, r"\{(?!\\an?\d)[^{}]*\}", "")
    closers = [F.repeat(F.lit(f"</{k}>"), unclosed(text, k)) for k in ("s", "u", "i", "b", "font")]
    return F.concat(text, *closers)


def style_open(color: Column, alignment: Column, bold: Column, italic: Column, underline: Column, strike: Column) -> Column:
    """Tags that open what a style asks for; -1 means on."""
    on = lambda c, x: F.when(c == -1, F.lit(f"<{x}>")).otherwise("")
    font = F.coalesce(F.concat(F.lit('<font color="'), ssa_color(color), F.lit('">')), F.lit(""))
    place = F.coalesce(ssa_alignment(alignment), F.lit(""))
    return F.concat(font, place, on(bold, "b"), on(italic, "i"), on(underline, "u"), on(strike, "s"))


def style_close(color: Column, bold: Column, italic: Column, underline: Column, strike: Column) -> Column:
    off = lambda c, x: F.when(c == -1, F.lit(f"</{x}>")).otherwise("")
    font = F.when(ssa_color(color).isNotNull(), F.lit("</font>")).otherwise("")
    return F.concat(off(strike, "s"), off(underline, "u"), off(italic, "i"), off(bold, "b"), font)
