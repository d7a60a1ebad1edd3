"""Detection of a text's encoding, and conversion.

Marks and other leading bytes come first, then checkers of sequences (``sequences``), then a learned model of byte pairs
(``bytepairs``). The pairs of a text are scored in steps of growing size. After each step, encodings that are
far behind are dropped; when one is left, or only such that read the text alike, the rest of the text is only
validated. A text that the leader cannot decode is scored again, whole, without it.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bom, bytepairs, sequences
from .bytepairs import MULTI, Model, codec_name, default_model, points

MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\x84\x31\x95\x33", "gb18030")]
CANDIDATES = list(dict.fromkeys(e for group in bytepairs.ENCODINGS.values() for e in group))
#: Two-byte encodings that a text may have without a mark.
WIDE = ["utf-16-le", "utf-16-be"]

#: Encodings that texts of a language often have; a country's domain stands for its language.
LANGUAGE_ENCODINGS = {
    "ja": ("shift_jis", "euc_jp"), "ko": ("euc_kr",), "zh": ("gb18030", "big5"), "ru": ("cp1251", "koi8_r", "iso8859_5"), "bg": ("cp1251",), "uk": ("cp1251", "koi8_r"), "el": ("iso8859_7",), "he": ("cp1255",), "ar": ("cp1256",),
    "fa": ("cp1256",), "tr": ("iso8859_9",), "th": ("cp874",), "lt": ("cp1257",), "lv": ("cp1257",), "et": ("cp1257",), "cs": ("cp1250",), "pl": ("cp1250",), "hu": ("cp1250",), "ro": ("cp1250",), "sk": ("cp1250",), "hr": ("cp1250",),
    "de": ("cp1252",), "fr": ("cp1252",), "es": ("cp1252",), "pt": ("cp1252",), "it": ("cp1252",), "nl": ("cp1252",), "sv": ("cp1252",), "da": ("cp1252",), "no": ("cp1252",), "fi": ("cp1252",), "en": ("cp1252",),
}
DOMAIN_LANGUAGES = {"jp": "ja", "kr": "ko", "cn": "zh", "tw": "zh", "hk": "zh", "ua": "uk", "gr": "el", "il": "he", "ir": "fa", "cz": "cs", "dk": "da", "se": "sv", "at": "de", "br": "pt", "ee": "et", "mx": "es", "uk": "en"}
#: What hints add, as logarithms of probabilities: a charset that is declared, a language, a domain, an encoding that is given as a guess,
#: and what most texts of the corpus have.
WEIGHTS = {"charset": 7.0, "language": 4.0, "domain": 3.0, "guess": 8.0, "corpus": 2.0}
#: Hints count in full from so many different byte pairs on, and at least so many parts of that.
FULL_FROM, LEAST_PARTS = 12, 3


def hinted(charset: str | None = None, language: str | None = None, domain: str | None = None, guess: str | None = None, corpus: str | None = None) -> dict[str, float]:
    """What hints add to scores, by encoding; what is not known adds nothing."""
    out: dict[str, float] = {}

    def add(encodings, weight: float) -> None:
        # of several encodings of a language the first is the likeliest
        for k, e in enumerate(encodings):
            out[e] = out.get(e, 0.0) + weight / (1 + k / 4)

    last = (domain or "").lower().rsplit(".", 1)[-1]
    add(LANGUAGE_ENCODINGS.get((language or "").lower().replace("_", "-").split("-")[0], ()), WEIGHTS["language"])
    add(LANGUAGE_ENCODINGS.get(DOMAIN_LANGUAGES.get(last, last), ()), WEIGHTS["domain"])
    for kind, name in (("charset", charset), ("guess", guess), ("corpus", corpus)):
        declared = codec_name(name)
        if declared:
            add([e for e in CANDIDATES if codec_name(e) == SUPERSETS.get(declared, declared)], WEIGHTS[kind])
    return out


#: Declared charsets that stand for a larger one.
SUPERSETS = {"iso8859-1": "cp1252", "gb2312": "gb18030", "gbk": "gb18030", "iso8859-8": "cp1255", "iso8859-6": "cp1256", "iso8859-13": "cp1257", "tis-620": "cp874", "cp1253": "iso8859-7", "cp1254": "iso8859-9", "cp932": "shift_jis", "cp949": "euc_kr"}

#: Registered names of the encodings, and their family.
NAMES = [
    ("ascii", "US-ASCII", "ascii"), ("binary", None, "binary"), ("utf-8", "UTF-8", "unicode"), ("utf-8-utf-8", None, "unicode"), ("utf-7", "UTF-7", "unicode"), ("utf-16-be", "UTF-16BE", "unicode"), ("utf-16-le", "UTF-16LE", "unicode"),
    ("utf-32-be", "UTF-32BE", "unicode"), ("utf-32-le", "UTF-32LE", "unicode"), ("utf-16", "UTF-16", "unicode"), ("euc_jp", "EUC-JP", "multi"), ("shift_jis", "Shift_JIS", "multi"), ("iso2022_jp", "ISO-2022-JP", "multi"), ("euc_kr", "EUC-KR", "multi"),
    ("gb18030", "GB18030", "multi"), ("big5", "Big5", "multi"), ("hz", "HZ-GB-2312", "multi"), ("iso8859_1", "ISO-8859-1", "single"), ("cp1252", "windows-1252", "single"), ("cp1250", "windows-1250", "single"), ("cp1251", "windows-1251", "single"),
    ("koi8_r", "KOI8-R", "single"), ("iso8859_5", "ISO-8859-5", "single"), ("iso8859_7", "ISO-8859-7", "single"), ("cp1255", "windows-1255", "single"), ("cp1256", "windows-1256", "single"), ("iso8859_9", "ISO-8859-9", "single"), ("cp1257", "windows-1257", "single"),
    ("cp874", "windows-874", "single"), ("iso8859_2", "ISO-8859-2", "single"), ("cp866", "IBM866", "single"), ("mac_cyrillic", "x-mac-cyrillic", "single"), ("mac_roman", "macintosh", "single"), ("cp850", "IBM850", "single"),
    # not detected, but known to conversion
    ("iso8859_3", "ISO-8859-3", "single"), ("iso8859_4", "ISO-8859-4", "single"), ("iso8859_6", "ISO-8859-6", "single"), ("iso8859_8", "ISO-8859-8", "single"), ("iso8859_10", "ISO-8859-10", "single"), ("iso8859_11", "ISO-8859-11", "single"),
    ("iso8859_13", "ISO-8859-13", "single"), ("iso8859_14", "ISO-8859-14", "single"), ("iso8859_15", "ISO-8859-15", "single"), ("iso8859_16", "ISO-8859-16", "single"), ("cp1253", "windows-1253", "single"), ("cp1254", "windows-1254", "single"),
    ("cp1258", "windows-1258", "single"), ("cp437", "IBM437", "single"), ("cp852", "IBM852", "single"), ("cp855", "IBM855", "single"), ("cp857", "IBM857", "single"), ("cp862", "IBM862", "single"), ("cp864", "IBM864", "single"), ("cp775", "IBM775", "single"),
    ("koi8_u", "KOI8-U", "single"), ("tis_620", "TIS-620", "single"), ("gbk", "GBK", "multi"), ("gb2312", "GB2312", "multi"), ("big5hkscs", "Big5-HKSCS", "multi"), ("cp932", "Windows-31J", "multi"), ("cp949", "KS_C_5601-1987", "multi"),
    ("johab", "Johab", "multi"), ("iso2022_kr", "ISO-2022-KR", "multi"), ("utf-32", "UTF-32", "unicode"),
]


def encoding_names(spark: SparkSession) -> DataFrame:
    """encoding, mime_name, family: one row an encoding that detection returns or conversion takes."""
    return spark.createDataFrame(NAMES, "encoding string, mime_name string, family string")


#: What a page says of itself: a meta element or an XML declaration, however long its tag is.
_DECLARED = re.compile(rb"""<(?:meta\b[^<>]*?charset|\?xml\b[^<>]*?encoding)\s*=\s*["']?\s*([A-Za-z0-9_:.-]{1,40})""", re.IGNORECASE)


def declared_charset(data: bytes) -> str | None:
    """The charset that a page declares first, wherever that stands; null if none."""
    found = _DECLARED.search(data)
    return found[1].decode("ascii") if found else None


#: Bytes beyond ASCII scored before encodings are dropped for the first time, and each time how many times more.
FIRST_STEP, GROWTH = 64, 4
#: Encodings that are so far behind are dropped, and a result is reliable with such a lead (10 bits); both are natural logarithms.
BEHIND, LEAD = 40.0, 7.0
#: Mean logarithm of a pair's probability below which bytes are no text.
NO_TEXT = -11.0
#: Share of control bytes that makes a content binary.
BINARY = 0.02
#: Sequences in UTF-8 that a text needs to be called so in spite of others, and their share.
UTF8_LEAST, UTF8_SHARE = 2, 0.75
#: Bytes that doubly encoded text has too many, from which it is reliable.
DOUBLE = 4
#: What encodings of other alphabets lose where bytes beyond ASCII stand one by one among more ASCII letters, since words of such
#: alphabets have more letters than one.
ALONE = 25.0
#: What all encodings but those of Latin letters lose, at most ALONE, for each time that ASCII letters are e times as many as bytes beyond ASCII: a few such
#: bytes among many words of Latin letters are rather letters of such words, and pairs of ASCII letters, which are the same in all encodings, do not tell so.
AMONG_LATIN = 6.0
_OTHER_ALPHABETS = [e for g, some in bytepairs.ENCODINGS.items() if g not in bytepairs.LATIN for e in some if e not in MULTI]
#: Signs that stand in pairs, and what an encoding loses in which a text has one of a pair without the other.
PAIRED, UNPAIRED = ("«»", "‹›"), 9.0
_SIGNS = [(e, *x) for e in CANDIDATES if e not in MULTI for x in ((p.encode(e, "ignore")) for p in PAIRED) if len(x) == 2]
#: And in which it has a sign of division, but not beside a digit.
_DIVISIONS = [(e, x, re.compile(rb"[0-9] ?%b|%b ?[0-9]" % (re.escape(x), re.escape(x)))) for e in CANDIDATES if e not in MULTI and (x := "÷".encode(e, "ignore"))]
#: What a well-formed sequence of four bytes adds to the score of its encoding, in which it counts as four unlikely pairs.
FOUR_BYTES = 25.0
_MAGICS = tuple(bytes.fromhex(m) for m, _ in bom.MAGICS)
_ASCII_LETTERS = np.array([b < 128 and chr(b).isalpha() for b in range(256)], np.int64)
_ASCII_PAIRS = re.compile(rb"[\x20-\x7e][\x20-\x7e]")

Found = tuple[str, int, bool, str | None]


def _seven_bit(data: bytes) -> Found:
    """Encodings that need no byte beyond ASCII; the one with more good sequences than bad ones."""
    counts = []
    if b"\x1b" in data:
        counts += [("iso2022_jp", *sequences.iso2022_jp(data)), ("iso2022_kr", *sequences.iso2022_kr(data))]
    if b"~{" in data:
        counts.append(("hz", *sequences.hz(data)))
    if b"+" in data:
        counts.append(("utf-7", *sequences.utf7(data)))
    counts = [c for c in counts if c[1] > c[2]]
    if not counts:
        return "ascii", len(data), True, None
    name, good, bad = max(counts, key=lambda c: c[1] - c[2])
    return name, len(data), bad == 0 and (name != "utf-7" or good > 1), "ascii"


def _wide(data: bytes, known: np.ndarray) -> Found | None:
    """Text in two bytes a character without a mark: most of its characters are known ones in one order of bytes, and not in the other."""
    if len(data) % 2 or len(data) < 4:
        return None
    share = {name: np.count_nonzero(known[np.frombuffer(data, "<u2" if name == "utf-16-le" else ">u2")]) / (len(data) // 2) for name in WIDE}
    best, other = sorted(WIDE, key=lambda name: -share[name])
    if share[best] < 0.75 or share[other] > 0.5:
        return None
    raw = np.frombuffer(data, np.uint8)
    plain = (raw >= 32) & (raw < 127)
    # text of one byte a character has Latin letters and spaces side by side
    if 2 * np.count_nonzero(plain[0::2] & plain[1::2]) > len(data) // 2 or not _decodes(data, best):
        return None
    return best, len(data), share[best] - share[other] > 0.5 and len(data) >= 12, other


def _decodes(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _with_nuls(data: bytes, known: np.ndarray) -> Found:
    even, odd = data[0::2].count(0), data[1::2].count(0)
    used = len(data)
    if even + odd > used * 0.6:
        return ("utf-32-be" if data[0] == 0 else "utf-32-le"), used, True, None
    if max(even, odd) > 2 * min(even, odd) + 2:
        name = "utf-16-be" if even > odd else "utf-16-le"
        return (name, used, True, None) if _decodes(data[: used // 2 * 2], name) else ("binary", used, True, name)
    return _wide(data, known) or ("binary", used, True, None)


_ONE_BYTE = [e for e in CANDIDATES if e not in MULTI]
_POINTS = np.stack([points(e) for e in _ONE_BYTE])
_PLACE = {e: i for i, e in enumerate(_ONE_BYTE)}


def _valid(data: bytes, encoding: str) -> bool:
    """Whether data is text in an encoding of several bytes, but for a character that the end cuts. Of the others only possible ones are asked for."""
    if encoding not in MULTI:
        return True
    try:
        codecs.getincrementaldecoder(encoding)().decode(data, final=False)
        return True
    except UnicodeDecodeError:
        return False


class _Readings:
    """How one-byte encodings read the bytes beyond ASCII of a text. seen: how often each byte stands in it."""

    def __init__(self, seen: np.ndarray) -> None:
        self.here = _POINTS[:, 128 + np.flatnonzero(seen[128:])]
        self.whole = (self.here >= 0).all(axis=1)

    def lacking(self) -> set[str]:
        """Encodings that lack some of the bytes."""
        return {_ONE_BYTE[i] for i in np.flatnonzero(~self.whole)}

    def alike(self, one: str, other: str) -> bool:
        i, k = _PLACE.get(one), _PLACE.get(other)
        return i is not None and k is not None and bool(self.whole[i] and self.whole[k]) and np.array_equal(self.here[i], self.here[k])


def _scored(bytes_: np.ndarray, high: np.ndarray, model: Model, out: set[str], bonus: dict[str, float], hints: dict[str, float], reads: _Readings) -> tuple[float, list[tuple[float, str]]]:
    """Mean score of a pair in the best encoding; how far behind it each encoding is, or was when it was dropped, the best first."""
    tables, _, prior = model.tables
    names, of = model.encodings
    added, hint = (np.array([d.get(e, 0.0) for e in names]) for d in (bonus, hints))
    live = np.flatnonzero(np.array([e not in out for e in names])[of])
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([[32], bytes_, [32]]).astype(np.uint16)
    behind = np.full(len(names), np.nan)
    at, step, mean = 0, FIRST_STEP, 0.0
    while len(live):
        part = high[at : at + step] + 1
        here = padded[part]
        after = here << 8 | padded[part + 1]
        new, n = _counted(np.concatenate([padded[part - 1] << 8 | here, after[(after & 128) == 0]]))  # else the pair is that of the next byte
        pairs, counts = _added(pairs, counts, new, n) if at else (new, n)
        at += step
        step *= GROWTH
        # what is repeated tells less each time, above all where little else is seen
        derate = min(1.0, max(LEAST_PARTS, len(pairs) + 1) / FULL_FROM)
        weight = (1 + derate * np.log(counts)).astype(np.float32)
        score = np.full(len(names), -np.inf)
        np.maximum.at(score, of[live], (weight @ tables[pairs])[live] + prior[live])
        score = score + added + derate * hint
        best = int(score.argmax())
        mean = score[best] / weight.sum()
        gap = score[best] - score
        ranked = np.isfinite(gap)
        behind[ranked] = gap[ranked]
        near = gap <= BEHIND
        live = live[near[of[live]]]
        if at >= len(high) or all(i == best or reads.alike(names[i], names[best]) for i in np.flatnonzero(near).tolist()):
            break
    return mean, sorted((behind[i].item(), names[i]) for i in np.flatnonzero(~np.isnan(behind)).tolist())


def _counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs.sort()
    last = np.append((pairs[1:] != pairs[:-1]).nonzero()[0], len(pairs) - 1)
    n = last + 1
    n[1:] -= n[:-1].copy()
    return pairs[last].astype(np.int64), n


def _added(pairs: np.ndarray, counts: np.ndarray, new: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.union1d(pairs, new)
    out = np.zeros(len(both), np.int64)
    out[np.searchsorted(both, pairs)] = counts
    out[np.searchsorted(both, new)] += n
    return both, out


def _among_latin(data: bytes, seen: np.ndarray, high: np.ndarray, bonus: dict[str, float], hints: dict[str, float]) -> None:
    """Adds to bonus what encodings lose by what stands beside the bytes beyond ASCII; Latin letters around do not speak against an encoding that hints name."""
    letters = int(seen @ _ASCII_LETTERS)
    loss = dict.fromkeys([e for e in (*_OTHER_ALPHABETS, *MULTI) if e not in hints], min(ALONE, AMONG_LATIN * float(np.log1p(letters / len(high)))))
    if letters > len(high):
        if not (high[1:] - high[:-1] == 1).any():
            loss |= dict.fromkeys(_OTHER_ALPHABETS, ALONE)
        for e, a, b in _SIGNS:
            if (seen[a] == 0) != (seen[b] == 0):
                loss[e] = loss.get(e, 0.0) + UNPAIRED
        for e, sign, beside in _DIVISIONS:
            if seen[sign[0]] and not beside.search(data):
                loss[e] = loss.get(e, 0.0) + UNPAIRED
    for e, x in loss.items():
        bonus[e] = bonus.get(e, 0.0) - x


def detect_bytes(data: bytes, hints: dict[str, float] | None = None, model: Model | None = None) -> Found:
    """Encoding, bytes looked at, whether that is reliable, and the second best. hints: what to add to scores by encoding;
    a charset declared in the text itself is one."""
    used = len(data)
    if not used:
        return "iso8859_1", 0, True, None
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, used, True, None
    if data.startswith(_MAGICS):
        return "binary", used, True, None
    model = model or default_model()
    if b"\0" in data:
        return _with_nuls(data, model.known)
    if data.isascii():
        return _seven_bit(data)
    if _decodes(data, "utf-8"):
        try:
            twice = data.decode("utf-8").encode("cp1252")
        except UnicodeError:
            return "utf-8", used, True, None
        return ("utf-8-utf-8", used, len(data) - len(twice) >= DOUBLE, "utf-8") if _decodes(twice, "utf-8") else ("utf-8", used, True, None)
    bytes_ = np.frombuffer(data, np.uint8)
    high = np.flatnonzero(bytes_ > 127)
    seen = np.bincount(bytes_, minlength=256)
    # most texts in other encodings cannot have so many sequences by their counts of bytes alone
    may = sequences.utf8_most(seen)
    good, stray, cut = (0, 0, 0) if may < UTF8_SHARE * len(high) and len(high) - may > 3 else sequences.utf8(bytes_, len(high))
    if good >= UTF8_LEAST and 1 - stray / len(high) >= UTF8_SHARE or good and stray == cut:
        return "utf-8", used, stray == cut and good >= UTF8_LEAST, None
    if found := _wide(data, model.known):
        return found
    if sequences.binary_density(seen) > BINARY:
        return "binary", used, True, None

    bonus: dict[str, float] = {}
    four, outside = sequences.gb18030(data, len(high))
    if four and not outside:
        bonus["gb18030"] = FOUR_BYTES * four
    hints = dict(hints or {})
    for name, score in hinted(declared_charset(data)).items() if b"<" in data else ():
        hints[name] = max(hints.get(name, 0.0), score)
    _among_latin(data, seen, high, bonus, hints)
    reads = _Readings(seen)
    out = reads.lacking()
    while True:
        mean, ranked = _scored(bytes_, high, model, out, bonus, hints, reads)
        if not ranked:
            return "binary", used, False, None
        best = ranked[0][1]
        if _valid(data, best):
            break
        out.add(best)
    # of encodings that read the text alike the one that hints name, and they are no rivals
    if hints:
        best = max([best, *(e for _, e in ranked if reads.alike(e, best))], key=lambda e: hints.get(e, 0.0))
    rivals = ((lead, e) for lead, e in ranked[1:] if not reads.alike(e, best) and _valid(data, e))
    lead, second = next(rivals, (BEHIND, None))
    if mean < NO_TEXT:
        return "binary", used, False, best
    return best, used, lead >= LEAD, second


DETECTED = T.StructType(
    [T.StructField("encoding", T.StringType()), T.StructField("consumed", T.IntegerType()), T.StructField("reliable", T.BooleanType()), T.StructField("second", T.StringType())]
)


def detect_udf(model: Model | None = None):
    """The function that detect() applies, for registration under a name."""
    model = model or default_model()

    @F.pandas_udf(DETECTED)
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect_bytes(bytes(c) if c is not None else b"", None, model) for c in content], columns=["encoding", "consumed", "reliable", "second"])

    return run


def detect(content: Column | str, model: Model | None = None) -> Column:
    """encoding, consumed, reliable and second of a binary column; without a model the default one."""
    return detect_udf(model)(content)


def detect_hinted(content: Column | str, charset: Column | str, language: Column | str, domain: Column | str, guess: Column | str | None = None, corpus: str | None = None, model: Model | None = None) -> Column:
    """detect with what was declared about a text: a charset, a language, the domain it is from, a guess; each may be null. corpus: what most texts have."""
    model = model or default_model()

    @F.pandas_udf(DETECTED)
    def run(content: pd.Series, charset: pd.Series, language: pd.Series, domain: pd.Series, guess: pd.Series) -> pd.DataFrame:
        given = zip(content, charset, language, domain, guess, strict=True)
        return pd.DataFrame([detect_bytes(bytes(c) if c is not None else b"", hinted(*h, corpus), model) for c, *h in given], columns=["encoding", "consumed", "reliable", "second"])

    return run(content, charset, language, domain, F.lit(None).cast("string") if guess is None else guess)


@F.pandas_udf(T.StringType())
def decode_as(content: pd.Series, charset: pd.Series) -> pd.Series:
    """Text of content in the charset named; what cannot be decoded becomes U+FFFD, unknown charsets null."""

    def one(c, name):
        if c is None or name is None:
            return None
        try:
            if name == "utf-8-utf-8":
                return bytes(c).decode("utf-8").encode("cp1252", "replace").decode("utf-8", "replace")
            return bytes(c).decode(name, "replace").removeprefix("﻿")
        except LookupError:
            return None

    return pd.Series([one(c, n) for c, n in zip(content, charset, strict=True)])


@F.pandas_udf(T.BinaryType())
def encode_as(text: pd.Series, charset: pd.Series) -> pd.Series:
    """text in the charset named; characters that it lacks become question marks."""
    return pd.Series([None if t is None or n is None else _in_charset(t, n) for t, n in zip(text, charset, strict=True)], dtype=object)


def _in_charset(text: str, charset: str) -> bytes:
    at = _charmap(charset)
    return codecs.charmap_encode(text, "replace", at)[0] if at else text.encode(charset, "replace")


@lru_cache(maxsize=256)
def _charmap(charset: str):
    """What codecs of some code pages, which look each character up in a dict, take faster; none for other codecs."""
    if charset not in CANDIDATES or charset in MULTI:
        return None
    return codecs.charmap_build("".join(chr(p) if p >= 0 else "\ufffe" for p in points(charset).tolist()))


def to_utf8(content: Column, model: Model | None = None) -> Column:
    """content in UTF-8, whatever its detected encoding."""
    return F.encode(decode_as(content, detect(content, model)["encoding"]), "UTF-8")
