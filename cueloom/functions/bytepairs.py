"""A model of neighbouring bytes for each encoding, learned from texts and pieces of words.

Texts teach how often two characters are neighbours, in groups of languages that share a script and its code pages.
A group's counts, encoded by Python's codecs, give a table of log-probabilities of a byte after another for
each of its encodings. Only pairs with a byte beyond ASCII count, since the others are the same in all encodings.

Counts come from three sources: pieces of a public vocabulary, which are ordered by how frequent they are in many languages;
a few fixed phrases with signs that follow their own rules, like prices and quotations; and texts of one's own with
known languages, counted by a Spark job (``count_pairs``).
"""

from __future__ import annotations

import base64
import codecs
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Byte pairs of words of many languages, by rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

MULTI = ["euc_jp", "shift_jis", "euc_kr", "gb18030", "big5"]
WESTERN, CENTRAL = ["cp1252", "mac_roman", "cp850"], ["cp1250", "iso8859_2"]
CYRILLIC = ["cp1251", "koi8_r", "iso8859_5", "cp866", "mac_cyrillic"]
#: Encodings of each group, the likelier first.
ENCODINGS = {
    "western": WESTERN, "central": CENTRAL, "turkish": ["iso8859_9"], "baltic": ["cp1257"], "cyrillic": CYRILLIC, "greek": ["iso8859_7"], "hebrew": ["cp1255"], "arabic": ["cp1256"], "thai": ["cp874"],
    "japanese": ["shift_jis", "euc_jp"], "korean": ["euc_kr"], "simplified": ["gb18030"], "traditional": ["big5"],
}
LATIN = ("western", "central", "turkish", "baltic")
#: Letters beyond ASCII of the languages of a group.
LETTERS = {
    "western": "àáâãäåæçèéêëìíîïñòóôõöøùúûüßœ", "central": "áäčďéěíňóöřšťúůüýžąćęłńśźżőűăâîșț", "turkish": "çğıöşüâîûİ", "baltic": "āčēģīķļņšūžąęėįų",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ", "greek": "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊΐ", "hebrew": "אבגדהוזחטיכלמנסעפצקרשתךםןףץ", "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهويةىءآأإؤئپچگ", "thai": "กขคงจฉชซญดตถทธนบปผฝพฟภมยรลวศษสหอฮะาำเแโใไๆ",
}
_SCRIPTS = {"CYRILLIC": "cyrillic", "GREEK": "greek", "HEBREW": "hebrew", "ARABIC": "arabic", "THAI": "thai", "HANGUL": "korean", "HIRAGANA": "japanese", "KATAKANA": "japanese", "KATAKANA-HIRAGANA": "japanese"}
#: Fixed phrases: how signs beyond ASCII stand in any text.
PHRASES = "£100 £5 £20, (£3) €5 10 € 10€ 25 €. 5 °C 30°C 20° 12 °F 90 ° © 2020 © 1999 (© ® ™ § 5 §12 ½ 1½ ¼ ² ³ m² km² « oui » «да» “yes” “No” ‘no’ it’s don’t I’m you’re he’ll we’ve John’s dogs’ l’été d’un c’est qu’il j’ai n’est s’il – — 5–6 a – b word—word … no… yes… „ja“ ¿qué? ¿Cómo ¡sí! ¡No ♪ · • • a nº 1º 2ª 15 µm ±2 × 3×4 ÷"
#: Log-probabilities of a group before any byte is seen.
PRIOR = {"western": 0.0, "central": -3.0, "turkish": -3.5, "baltic": -3.0, "cyrillic": -1.0, "greek": -2.0, "hebrew": -2.0, "arabic": -2.0, "thai": -2.0, "japanese": -1.0, "korean": -1.5, "simplified": -1.0, "traditional": -1.5}
#: And of an encoding among those of its group, by its place in the list.
LATER = -0.5
#: Counts of a group are scaled to so many characters; one that was never seen after another counts as its frequency alone times BACK.
SCALE, BACK, FLOOR = 10_000.0, 3.0, 0.003
#: Counts of SCALE that fixed phrases get among Latin letters and others, and that a letter of a Latin alphabet and of another gets.
SIGNS, LATIN_LETTER, OTHER_LETTER = (300.0, 60.0), 60.0, 3.0
#: Kinds of bytes, and how often a byte beyond ASCII follows one of each kind; how often each kind follows such a byte. For Latin letters, other
#: alphabets, and encodings of several bytes.
KINDS = ("letter", "space", "digit", "sign")
LATIN_SHARES = {"letter": 0.04, "space": 0.015, "digit": 0.01, "sign": 0.01, "high": 0.06, "after": (0.70, 0.14, 0.02, 0.08)}
SCRIPT_SHARES = {"letter": 0.002, "space": 0.5, "digit": 0.005, "sign": 0.08, "high": 0.8, "after": (0.001, 0.12, 0.002, 0.077)}
MULTI_SHARES = {"letter": 0.003, "space": 0.3, "digit": 0.03, "sign": 0.08}
#: Different pairs of a group that count as half of what it could have.
FEW = 200
#: How often a piece of a word stands in capitals, among Latin letters and others.
UPPER = (0.1, 0.02)
#: What all characters of an encoding that were never seen have together, of SCALE.
NEVER = 30.0
_HIGH = np.arange(256) > 127
_KIND = {
    "letter": np.array([b < 128 and chr(b).isalpha() for b in range(256)]), "space": np.isin(np.arange(256), [9, 10, 13, 32]), "digit": np.array([48 <= b <= 57 for b in range(256)]),
}
_KIND["sign"] = ~(_HIGH | _KIND["letter"] | _KIND["space"] | _KIND["digit"])

#: Digits and signs that follow characters of several bytes less often than commas and full stops.
_RARER = [b for b in range(33, 127) if not chr(b).isalpha() and b not in (44, 46)]

Pairs = dict[tuple[str, str], float]


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0] if c > "\x7f" and (c.isalpha() or unicodedata.category(c)[0] == "M") else ""


def _fits(text: str, encoding: str) -> bool:
    try:
        text.encode(encoding)
    except UnicodeEncodeError:
        return False
    return True


def groups_of(piece: str) -> list[str]:
    """The groups whose texts may have a piece of a word; none for pure ASCII. Pieces with signs alone are a kind of their own."""
    scripts = {script(c) for c in piece} - {""}
    if not scripts:
        return ["signs"] if any(c > "\x7f" for c in piece) else []
    if scripts == {"LATIN"}:
        special = {c for c in piece.lower() if c > "\x7f" and c.isalpha()}
        return [g for g in LATIN if special <= set(LETTERS[g])]
    found = {_SCRIPTS.get(s, "CJK" if s == "CJK" else "?") for s in scripts}
    if found == {"CJK"}:
        return [g for g, e in (("simplified", "gb2312"), ("traditional", "big5"), ("japanese", "shift_jis")) if _fits(piece, e)]
    found.discard("CJK")
    return list(found) if len(found) == 1 and "?" not in found else []


def pairs_of(text: str, weight: float, into: Pairs) -> None:
    for a, b in zip(text, text[1:], strict=False):
        if a > "\x7f" or b > "\x7f":
            into[a, b] = into.get((a, b), 0.0) + weight


def pieces(path: str = VOCABULARY) -> Iterator[tuple[str, float]]:
    """Pieces of a vocabulary, with a weight that falls by rank; none if there is no such file."""
    if not Path(path).exists():
        return
    for line in Path(path).read_bytes().splitlines():
        token, rank = line.split()
        try:
            yield base64.b64decode(token).decode(), 1 / (int(rank) + 100)
        except UnicodeDecodeError:
            continue


def learn(some: Iterable[tuple[str, float]]) -> dict[str, Pairs]:
    """Pairs of characters of each group from weighted pieces of words."""
    out: dict[str, Pairs] = {g: {} for g in [*ENCODINGS, "signs"]}
    for piece, weight in some:
        for group in groups_of(piece):
            for text, share in ((piece, 1.0), (piece.upper(), UPPER[group not in LATIN]), (piece.title(), 0.1)):
                pairs_of(text if len(text) > 1 else " " + text, weight * share, out[group])
    return out


def count_pairs(texts: DataFrame, text: str = "text", language: str = "lang", most: int = 20_000) -> dict[str, Pairs]:
    """Pairs of neighbouring characters, one beyond ASCII at least, of all texts by language: counted within tasks first; the driver gets
    the most frequent pairs of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                points = np.frombuffer((t.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                key = points[:-1] << 21 | points[1:]
                values, n = np.unique(key[(points[:-1] > 127) | (points[1:] > 127)], return_counts=True)
                for v, k in zip(values.tolist(), n.tolist(), strict=True):
                    total[lang, v] += k
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["lang", "pair", "n"])

    narrow = texts.filter(F.col(f"`{language}`").isNotNull()).select(F.col(f"`{language}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    counted = narrow.mapInArrow(run, "lang string, pair long, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n"))
    best = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "pair"))).filter(F.col("k") <= most)
    out: dict[str, Pairs] = {}
    for r in best.select("lang", "pair", "n").collect():
        out.setdefault(r.lang, {})[chr(r.pair >> 21), chr(r.pair & 0x1FFFFF)] = float(r.n)
    return out


@lru_cache(maxsize=None)
def points(encoding: str) -> np.ndarray:
    """Code point of each byte of a one-byte encoding, -1 where there is none."""
    out = np.full(256, -1, np.int64)
    for b in range(256):
        try:
            out[b] = ord(bytes([b]).decode(encoding))
        except (UnicodeDecodeError, TypeError):
            continue
    return out


def _encoded(c: str, encoding: str) -> bytes:
    try:
        return c.encode(encoding)
    except UnicodeEncodeError:
        return b""


def _frequencies(pairs: Pairs) -> dict[str, float]:
    """Of characters beyond ASCII."""
    out: dict[str, float] = {}
    for pair, n in pairs.items():
        for c in pair:
            if c > "\x7f":
                out[c] = out.get(c, 0.0) + n / 2
    return out


def _weighted(pairs: Pairs, signs: Pairs, most: float) -> list[tuple[str, str, float]]:
    """Pairs scaled to SCALE characters, and those of signs and of the fixed phrases, which have half of most each."""
    phrases: Pairs = {}
    pairs_of(f" {PHRASES} ", 1.0, phrases)
    out = []
    # a group with few pairs leans on its alphabet
    for some, total in ((pairs, SCALE * len(pairs) / (len(pairs) + FEW)), (signs, most / 2), (phrases, most / 2)):
        scale = total / (sum(_frequencies(some).values()) or 1.0)
        out += [(a, b, n * scale) for (a, b), n in some.items()]
    return out


def table(pairs: Pairs, group: str, encoding: str, signs: Pairs | None = None, most: float | None = None) -> np.ndarray:
    """Log-probability of each byte after each, 256 x 256, for texts of a group in an encoding. most: what signs get of SCALE."""
    each = _weighted(pairs, signs or {}, most or SIGNS[group not in LATIN])
    known = {c: _encoded(c, encoding) for a, b, _ in each for c in (a, b)}
    made = _of_several_bytes(each, known, encoding) if encoding in MULTI else _of_one_byte(each, known, group, encoding)
    return np.log(np.maximum(made, 1e-9)).astype(np.float32)


def _of_several_bytes(each: list[tuple[str, str, float]], known: dict[str, bytes], encoding: str) -> np.ndarray:
    count, first = np.zeros((256, 256)), np.zeros(256)
    for a, b, n in each:
        x, y = known[a], known[b]
        if x and y:
            count[x[-1], y[0]] += n
        for raw in (x, y):
            if raw and raw[0] > 127:
                first[raw[0]] += n / 2
                np.add.at(count, (list(raw[:-1]), list(raw[1:])), n / 2)
                # spaces and signs may follow any character
                count[raw[-1], [10, 32, 44, 46]] += n * 0.02
                count[raw[-1], _RARER] += n * 0.001
    legal = np.zeros((256, 256))
    for lead in range(128, 256):
        for trail in range(256):
            try:
                legal[lead, trail] = len(bytes([lead, trail]).decode(encoding)) == 1
            except UnicodeDecodeError:
                continue
    trails = legal.sum(axis=1, keepdims=True)
    first += NEVER * trails[:, 0] / trails.sum() + FLOOR
    first /= first.sum()
    back = 0.9 * np.where(trails > 0, legal / np.maximum(trails, 1), 0) + 0.1 * first
    total = count.sum(axis=1, keepdims=True)
    out = (count + BACK * back) / (total + BACK)
    for kind, share in MULTI_SHARES.items():
        high = count[_KIND[kind]] * _HIGH
        out[_KIND[kind]] = share * (high + BACK * first) / (high.sum(axis=1, keepdims=True) + BACK)
    return out


def _of_one_byte(each: list[tuple[str, str, float]], known: dict[str, bytes], group: str, encoding: str) -> np.ndarray:
    latin = group in LATIN
    shares = LATIN_SHARES if latin else SCRIPT_SHARES
    count, alone = np.zeros((256, 256)), np.zeros(256)
    for a, b, n in each:
        x, y = known[a], known[b]
        if x and y:
            count[x[0], y[0]] += n
        for raw in (x, y):
            if raw and raw[0] > 127:
                alone[raw[0]] += n / 2
    for c in LETTERS[group]:
        for form, part in ((c, 1.0), (c.upper(), 0.15)):
            raw = _encoded(form, encoding)
            if len(raw) == 1 and raw[0] > 127:
                alone[raw[0]] += part * (LATIN_LETTER if latin else OTHER_LETTER)
    at = points(encoding)
    base = np.where(_HIGH & (at >= 0), alone + FLOOR, 1e-6 * _HIGH)
    base = base / base.sum()
    high = count * _HIGH
    after = (high + BACK * base) / (high.sum(axis=1, keepdims=True) + BACK)
    out = np.zeros((256, 256))
    for kind in KINDS:
        out[_KIND[kind]] = shares[kind] * after[_KIND[kind]]
    # after a letter all kinds have fixed shares, after a sign those that were counted as well
    letter = np.array([p > 127 and chr(p).isalpha() for p in at.tolist()])
    kinds = np.stack([count[:, _HIGH].sum(axis=1)] + [count[:, _KIND[k]].sum(axis=1) for k in KINDS], axis=1)
    fixed = np.array([shares["high"], *shares["after"]])
    counted = (kinds + fixed) / (kinds.sum(axis=1, keepdims=True) + 1)
    share = np.where(letter[:, None], fixed, 0.3 * fixed + 0.7 * counted)
    out[_HIGH] = (share[:, :1] * after)[_HIGH]
    for k, kind in enumerate(KINDS, 1):
        low = count * _KIND[kind] + BACK * _KIND[kind] / _KIND[kind].sum()
        out[_HIGH] += (share[:, k : k + 1] * low / low.sum(axis=1, keepdims=True))[_HIGH]
    return out


class Model:
    """Tables of all groups in all their encodings, made from counts where they are first needed; only counts are sent to tasks."""

    def __init__(self, groups: dict[str, Pairs], languages: dict[str, Pairs] | None = None) -> None:
        self.groups, self.languages = groups, languages or {}
        self._tables: tuple | None = None
        self._encodings: tuple | None = None
        self._known: np.ndarray | None = None

    def __reduce__(self) -> tuple:
        return Model, (self.groups, self.languages)

    @property
    def tables(self) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Log-probabilities by pair (first byte times 256 and second) and table; each table's encoding and prior."""
        if self._tables is None:
            made, names, prior = [], [], []
            sources = [(g, self.groups.get(g, {}), None) for g in ENCODINGS]
            sources += [(self.group_of(pairs), pairs, None) for pairs in self.languages.values()]
            # English has signs for the most part
            sources.append(("western", {}, SCALE))
            for group, pairs, most in sources:
                for k, e in enumerate(ENCODINGS[group]):
                    made.append(table(pairs, group, e, self.groups.get("signs"), most).ravel())
                    names.append(e)
                    prior.append(PRIOR[group] + k * LATER)
            self._tables = np.stack(made, axis=1), names, np.array(prior, np.float32)
        return self._tables

    @property
    def encodings(self) -> tuple[list[str], np.ndarray]:
        """Each encoding once, and the place there of each table's encoding."""
        if self._encodings is None:
            names = self.tables[1]
            each = list(dict.fromkeys(names))
            self._encodings = each, np.array([each.index(e) for e in names])
        return self._encodings

    @staticmethod
    def group_of(pairs: Pairs) -> str:
        """The group that has most of the letters of a language's pairs."""
        votes: Counter = Counter()
        for (a, b), n in pairs.items():
            for c in (a, b):
                for g in groups_of(c):
                    votes[g] += n
        return max(ENCODINGS, key=lambda g: votes[g])  # the first of equals, Western for texts without such letters

    @property
    def known(self) -> np.ndarray:
        """Which of the first 65,536 code points are ASCII text or were seen in training."""
        if self._known is None:
            self._known = np.zeros(65536, bool)
            self._known[[9, 10, 13, *range(32, 127)]] = True
            self._known[[ord(c) for p in (*self.groups.values(), *self.languages.values()) for pair in p for c in pair if "\x7f" < c < "\U00010000"]] = True
        return self._known


@lru_cache(maxsize=4)
def default_model(path: str = VOCABULARY) -> Model:
    return Model(learn(pieces(path)))


def trained(texts: DataFrame, text: str = "text", language: str = "lang", path: str = VOCABULARY) -> Model:
    """The default model, and the languages of some texts."""
    return Model(default_model(path).groups, count_pairs(texts, text, language))


def codec_name(name: str | None) -> str | None:
    try:
        return codecs.lookup(name.strip()).name if name else None
    except LookupError:
        return None
