"""Language identification of mixed-language text.

A language's letters in context (each letter with its neighbours in the word) give a score for
every word; the script of a word, from ranges of code points, narrows the languages that may
have written it. Viterbi over the words of a text, with a penalty for switching, labels spans;
the language of most letters is the text's.

Training counts trigrams on the executors over a sample of labelled rows of at most about
``SAMPLE`` rows a language, chosen by a hash of the id; what comes to the driver is
``BUCKETS`` numbers a language, for at most ``MOST_LANGUAGES`` (more are an error).

Defined results: null and empty texts, and those without a letter, are ``und`` with score 0 and
no spans; very long texts are labelled whole, word by word; with no labelled rows everything is ``und``; an empty table gives an
empty result; repeated rows are judged one by one; ties between languages go to the smaller name; columns of the input other than the text are passed
on unless one has the name of an output column.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage

#: Bound on the expected number of training rows a language.
SAMPLE = 3_000
BUCKETS = 1 << 16
#: Languages of a model at most: 65,536 numbers each are broadcast, 131 MB in all.
MOST_LANGUAGES = 500
#: Cost of a switch of language between two words, in nats.
SWITCH = 10.0
#: Cost of a language never seen in a word's script.
FOREIGN = 50.0
UNDETERMINED = "und"
#: Code points labelled at once.
BLOCK = 2_000_000

#: Script ranges: first and last code point.
SCRIPTS: list[tuple[str, int, int]] = [
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("han", 0x20000, 0x2FA1F),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(n for n, _, _ in SCRIPTS)]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, whether it is part of a word, its script."""
    n = 0x110000
    letter, part, script = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int8)
    for c in [*range(0xD800), *range(0xE000, 0x323B0)]:
        kind = unicodedata.category(chr(c))[0]
        letter[c], part[c] = kind == "L", kind in "LM"
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return letter, part, script


@dataclass(frozen=True)
class Words:
    """Words of some texts in a row: bucket of each letter, first letter of each word, words a text."""

    buckets: np.ndarray
    starts: np.ndarray
    script: np.ndarray
    per_text: np.ndarray
    has_letter: np.ndarray
    #: Code point offset of each word in its text, and its length.
    offset: np.ndarray
    length: np.ndarray


def split_words(texts: list[str]) -> Words:
    letter, part, script = _tables()
    # one separator after each text; where a lower-cased text is longer, letters that become two stay as they are
    lower = [low if len(low := t.lower()) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t) for t in texts]
    codes = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = part[codes]
    shown = np.where(inside, codes, 0)
    before = np.concatenate([[0], shown[:-1]])
    after = np.concatenate([shown[1:], [0]])
    h = (before * 1_000_003 + shown) * 1_000_003 + after
    at = np.flatnonzero(inside)
    buckets = ((h[at] * 0x9E3779B1) >> 15) & (BUCKETS - 1)
    first = inside[at] & ~np.concatenate([[False], inside[:-1]])[at]
    starts = np.flatnonzero(first)
    words_at = at[starts]
    text_of = np.searchsorted(ends, words_at, side="right")
    per_text = np.bincount(text_of, minlength=len(texts))
    has = np.zeros(len(texts), bool)
    has[np.searchsorted(ends, np.flatnonzero(letter[codes]), side="right")] = True
    begin = ends - np.array([len(t) + 1 for t in texts], np.int64) if texts else np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(at)))
    return Words(buckets, starts, script[codes[words_at]], per_text, has, words_at - begin[text_of], length)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: Bucket by language: log-probability of a letter with its neighbours.
    logp: np.ndarray
    #: Script by language: cost.
    script_cost: np.ndarray


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{key}`"), F.lit("language")).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = cut_lineage(rows.groupBy("lang").agg(F.count("*").alias("n")))
    if (languages := sizes.count()) > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages; a model has at most {MOST_LANGUAGES}")
    sizes = F.broadcast(sizes)  # texts need no shuffle
    share = F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    sample = rows.join(sizes, "lang").filter(share * F.col("n") < SAMPLE).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("lang"):
                w = split_words(list(group["text"]))
                letters = np.bincount(w.buckets, minlength=BUCKETS)
                seen = np.bincount(w.script, minlength=len(SCRIPT_NAMES))
                ids = np.concatenate([np.flatnonzero(letters), BUCKETS + np.flatnonzero(seen)])
                yield pd.DataFrame({"lang": name, "id": ids, "n": np.concatenate([letters[letters > 0], seen[seen > 0]])})

    counts = sample.mapInPandas(count, "lang string, id int, n long").groupBy("lang", "id").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    table[counts["id"].to_numpy(np.int64), counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = counts["n"]
    letters, seen = table[:BUCKETS], table[BUCKETS:]
    logp = np.log((letters + 0.05) / (letters.sum(axis=0) + 0.05 * BUCKETS)).astype(np.float32)
    # a script counts as a language's if one word in a thousand is in it; one that no language has narrows nothing
    own = seen >= np.maximum(1, 0.001 * seen.sum(axis=0))
    cost = np.where(own | ~own.any(axis=1, keepdims=True), 0.0, FOREIGN).astype(np.float32)
    return Model(langs, logp, cost)


def viterbi(scores: np.ndarray, per_text: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; all texts advance together, word by word."""
    total, n = scores.shape
    order = np.argsort(-per_text, kind="stable")
    starts = (np.cumsum(per_text) - per_text)[order]
    counts = per_text[order]
    most = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(most), side="left")
    stay = np.zeros((total, n), bool)
    came = np.zeros(total, np.int8 if n < 128 else np.int32)
    value = np.zeros((len(counts), n), np.float32)
    for t in range(most):
        k = active[t]
        at = starts[:k] + t
        v = value[:k]
        if t:
            top = v.argmax(axis=1)
            jump = v[np.arange(k), top] - switch
            keep = v >= jump[:, None]
            stay[at], came[at] = keep, top
            v = np.where(keep, v, jump[:, None])
            v -= v.max(axis=1, keepdims=True)
        value[:k] = v + scores[at]
    label = np.zeros(total, np.int64)
    state = value.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        s = state[:k]
        label[at] = s
        if t:
            state[:k] = np.where(stay[at, s], s, came[at])
    return label


def label(texts: list[str], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans (start, end, language) of each text."""
    w = split_words(texts)
    if not len(w.starts) or not model.langs:
        return [(UNDETERMINED, 0.0, []) for _ in texts]
    scores = np.stack([np.add.reduceat(model.logp[:, i][w.buckets], w.starts) for i in range(len(model.langs))], axis=1)
    scores -= model.script_cost[w.script]
    labels = viterbi(scores, w.per_text)
    text_of = np.repeat(np.arange(len(texts)), w.per_text)
    letters = np.bincount(text_of * len(model.langs) + labels, weights=w.length, minlength=len(texts) * len(model.langs)).reshape(len(texts), -1)
    best = letters.argmax(axis=1)
    share = letters[np.arange(len(texts)), best] / np.maximum(1, letters.sum(axis=1))
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(labels)) - 1
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for t, a, b, x in zip(text_of[at].tolist(), w.offset[at].tolist(), (w.offset[last] + w.length[last]).tolist(), labels[at].tolist(), strict=True):
        spans[t].append((a, b, model.langs[x]))
    return [
        (model.langs[best[i]], round(float(share[i]), 6), spans[i]) if w.has_letter[i] and w.per_text[i] else (UNDETERMINED, 0.0, [])
        for i in range(len(texts))
    ]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def predict(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """docs without the text, with lang_pred, score, n_spans and, if asked for, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("n_spans", T.IntegerType())] + [("lang_spans", SPANS)] * spans
    names = [n for n, _ in new]
    rest = [c for c in docs.columns if c not in names and c != text]
    fields = [docs.schema[c] for c in rest] + [T.StructField(n, t) for n, t in new]
    arrow = [pa.string(), pa.float64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(len(rest))]
            found, start, size = [], 0, 0
            for i, t in enumerate(texts):
                if size and size + len(t) > BLOCK:
                    found += label(texts[start:i], shared.value)
                    start, size = i, 0
                size += len(t)
            found += label(texts[start:], shared.value)
            values = [[f[0] for f in found], [f[1] for f in found], [len(f[2]) for f in found]]
            if spans:
                values.append([[{"start": a, "end": b, "lang": x} for a, b, x in f[2]] for f in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, t) for v, t in zip(values, arrow, strict=False))], names=[*rest, *names])

    narrow = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"))
    return narrow.mapInArrow(run, T.StructType(fields))
