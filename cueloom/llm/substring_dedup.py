"""Removal of word passages that repeat: seed and extend.

A word goes if a window of ``WINDOW`` words that covers it also starts anywhere else.

* Seeds. The anchor of a window is the run of ``GRAM`` words in it with the least hash (winnowing), so equal windows have
  equal anchors at the same place. An anchor and the windows that it stands for make a region, from the first word of
  the first window to the last of the last. Occurrences of one anchor are joined on its hash; anchors that occur once end here.
* Copies. Occurrences whose whole regions are equal are one kind with a count. If the count is above one, all
  windows of the region repeat, and the region is done.
* Extension. What is left are kinds that share an anchor but differ somewhere in their regions. A match is extended from the anchor
  to both sides, by steps: a window has some words on the left of its anchor and the rest on the right, so the
  possible splits are a range, and all windows of a narrower range share more words on both sides. Each step cuts ranges
  into ``STEPS`` narrower ones and keeps those whose words, on both sides, another kind has as well. At the last
  step a range is one window. Neighbouring windows join to maximal repeats, all of WINDOW words or more.

A step counts by key and joins the counts back, so no group is gathered anywhere, and no pairs are made within a group: an anchor
in a third of all documents is a count, and its rows are dealt by their longer keys in the next step.
Only kinds are extended, so the thousand copies of a page count once.

Words are compared by 64-bit hashes of their sequences, always an anchor's and those of both sides together, and whole regions by
two hashes.

Defined results: null texts and texts without a word have no words, none removed, and the hash of no bytes; a very long text is a text as any
other, whose anchors are emitted in blocks; of repeated rows each is a repeat of the other; ties of least hashes fall on the leftmost
run; a text shorter than a window loses nothing; an empty table gives an empty result; other columns are kept, unless
they have an output's name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, join_by_key
from .suffix_dedup import Hashes, _batch, _bytes, _keyed, _longs, _mix, _open, _pack, _squeezed, _unpack, merged, served

WINDOW = 35
GRAM = 12
#: Ways to split the words of a window that are not its anchor's between its left and right.
SPLITS = WINDOW - GRAM + 1
#: Splits in a range after each step of extension.
STEPS = (6, 1)
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
OUT = ["n_words", "n_removed", "kept_sha256"]
SEEDS = ["k1", "k2", "packed", "anchor", "e1", "e2"]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    inside = np.concatenate([[False], ~_SPACES[data], [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def _sequences(data: np.ndarray, which: int) -> Hashes:
    """Hashes of all runs of words."""
    begin, end = word_spans(data)
    return Hashes(_mix(Hashes(data, which).of(begin, end) + (end - begin).astype(np.uint64)), which)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SEEDS of each text: its anchors, packed with the starts that they serve, and two hashes of their regions."""
    for batch in batches:
        parts: list[list[np.ndarray]] = []
        size = 0
        for k1, k2, text in zip(*batch.columns, strict=True):
            data = _bytes(text.as_py())
            one, two = _sequences(data, 0), _sequences(data, 1)
            starts = len(one.sums) - WINDOW
            if starts < 1:
                continue
            at, first, last = served(one, starts, SPLITS, GRAM)
            shape = ((at - first) * SPLITS + (at - last)).astype(np.uint64)
            region = [_mix(h.of(first, last + WINDOW) + shape).view(np.int64) for h in (one, two)]
            n = len(at)
            parts.append([np.full(n, k1.as_py()), np.full(n, k2.as_py()), _pack(at, first, last), one.of(at, at + GRAM).view(np.int64), *region])
            size += n
            if size > 200_000:
                yield _batch(parts, SEEDS)
                parts, size = [], 0
        if parts:
            yield _batch(parts, SEEDS)


KINDS = ["anchor", "k1", "k2", "packed", "n"]


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """KINDS and, of each kind, hashes of the words left and right of its anchor. Columns: k1, k2, z, wanted.

    left[i] has the i words before the anchor and right[i] the i words after it, as far as its windows reach."""
    steps = np.arange(SPLITS)
    for batch in batches:
        for k1, k2, z, wanted in zip(*batch.columns, strict=True):
            words = _sequences(_open(z), 0)
            anchor, packed, n = (np.array(w) for w in wanted.values.flatten())
            for a in range(0, len(packed), 10_000):
                at, _, _ = _unpack(packed[a : a + 10_000])
                end, total = at + GRAM, len(words.sums) - 1
                left = words.of(np.maximum(at[:, None] - steps, 0), np.broadcast_to(at[:, None], (len(at), SPLITS)))
                right = words.of(np.broadcast_to(end[:, None], (len(at), SPLITS)), np.minimum(end[:, None] + steps, total))
                offsets = pa.array(np.arange(0, SPLITS * (len(at) + 1), SPLITS, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64).ravel())) for x in (left, right)]
                longs = [anchor[a : a + 10_000], np.full(len(at), k1.as_py()), np.full(len(at), k2.as_py()), packed[a : a + 10_000], n[a : a + 10_000]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, longs), *lists], names=[*KINDS, "left", "right"])


def _packed() -> tuple[Column, Column, Column]:
    """Anchor, and how far before it the first and the last of its windows start."""
    packed = F.col("packed")
    return F.call_function("shiftright", packed, F.lit(20)), F.call_function("shiftright", packed, F.lit(10)).bitwiseAND(1023), packed.bitwiseAND(1023)


def _extended(kinds: DataFrame) -> DataFrame:
    """k1, k2, start, end of the windows of kinds that another kind of the same anchor has as well."""
    at, far, near = _packed()
    now = kinds.withColumns({"low": F.lit(0), "high": F.lit(SPLITS - 1)})
    for width in STEPS:
        # a range of splits, low to high words on the left of the anchor; left and right have the hashes of these splits alone
        cut = now.withColumn("l", F.explode(F.sequence(F.col("low"), F.col("high"), F.lit(width)))).withColumn("h", F.least(F.col("l") + width - 1, F.col("high")))
        cut = cut.filter((F.col("l") <= far) & (F.col("h") >= near))
        part = lambda side, skip: F.slice(side, skip + 1, F.col("h") - F.col("l") + 1)
        cut = cut.withColumns({"left": part("left", F.col("l") - F.col("low")), "right": part("right", F.col("high") - F.col("h"))})
        # what all windows of the range have: l words on the left, and as many on the right as the window of h has
        cut = cut.withColumns({"before": F.get("left", F.lit(0)), "after": F.get("right", F.lit(0))}).drop("low", "high").withColumnsRenamed({"l": "low", "h": "high", "n": "copies"})
        key = ["anchor", "low", "before", "after"]
        met = cut_lineage(cut.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"))
        total = met.agg(F.sum("n")).first()[0] or 0
        now = cut_lineage(join_by_key(cut, met, key, total).drop("n", "before", "after").withColumnRenamed("copies", "n"))
    # kinds of several occurrences are whole repeats already
    return now.filter("n = 1").select("k1", "k2", (at - F.col("low")).alias("start"), (at - F.col("low") + WINDOW).alias("end"))


def repeats(keyed: DataFrame) -> DataFrame:
    """k1, k2, start, end: runs of words of repeated windows; runs of a text may overlap."""
    seeds = keyed.select("k1", "k2", "text").mapInArrow(_seeds, _longs(SEEDS))
    twice = cut_lineage(seeds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    total = twice.agg(F.sum("n")).first()[0] or 0
    # seeds are dear to make, so they are read once; tasks of a frequent anchor are split by the adaptive join
    shared = cut_lineage(seeds.join(twice.select("anchor"), "anchor", "left_semi"))

    kinds = cut_lineage(shared.groupBy("anchor", "e1", "e2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "packed")).alias("one")))
    copied = kinds.filter("n > 1").select("anchor", "e1", "e2", "n")
    copies = join_by_key(shared, copied, ["anchor", "e1", "e2"], total)
    at, far, near = _packed()
    whole = copies.select("k1", "k2", (at - far).alias("start"), (at - near + WINDOW).alias("end"))

    several = cut_lineage(kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    different = join_by_key(kinds.select("anchor", "one", F.col("n").alias("copies")), several, ["anchor"], several.agg(F.sum("n")).first()[0] or 0)
    wanted = different.select("one.k1", "one.k2", F.struct("anchor", "one.packed", F.col("copies").alias("n")).alias("want"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("want").alias("wanted"))
    texts = _squeezed(keyed, F.col("text"), []).join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "z", "wanted")
    sides = texts.mapInArrow(_sides, _longs(KINDS) + ", left array<long>, right array<long>")
    return whole.union(_extended(cut_lineage(sides)))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OUT from the last columns: z, runs."""
    for batch in batches:
        results = []
        for z, runs in zip(*batch.columns[-2:], strict=True):
            data = _open(z)
            begin, end = word_spans(data)
            spans = merged(runs.values.flatten()) if runs.is_valid and len(runs) else []
            kept, at, gone, raw = hashlib.sha256(), 0, 0, data.tobytes()
            glue = b""
            for a, b in [*spans, (len(begin), len(begin))]:
                if at < a:
                    kept.update(glue + b" ".join(raw[begin[at] : end[a - 1]].split()))
                    glue = b" "
                at, gone = b, gone + b - a
            results.append((len(begin), gone, kept.hexdigest()))
        columns = [pa.array([r[i] for r in results], pa.int64() if i < 2 else pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:-2], *columns], names=[*batch.schema.names[2:-2], *OUT])


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_removed and kept_sha256."""
    rest = [c for c in docs.columns if c not in (*OUT, text)]
    keyed = _keyed(docs, text, rest)
    found = repeats(keyed).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    joined = _squeezed(keyed, F.col("text"), ["row"]).join(found, ["k1", "k2"], "left").select("k1", "k2", "row", "z", "runs")
    fields = [keyed.schema["row"]] + [T.StructField(c, T.StringType() if c == "kept_sha256" else T.LongType()) for c in OUT]
    return joined.mapInArrow(_without, T.StructType(fields)).select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *OUT)


#: The same rows in SQL, by the text of every window.
ORACLE_SQL = f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
    starts AS (SELECT row, s, sha256(array_to_string(words[s : s + {WINDOW} - 1], ' ')) AS h FROM docs, unnest(range(1, len(words) - {WINDOW} + 2)) t(s)),
    twice AS (SELECT row, s FROM starts WHERE h IN (SELECT h FROM starts GROUP BY h HAVING count(*) > 1)),
    gone AS (SELECT row, list_distinct(flatten(list(range(s, s + {WINDOW})))) AS places FROM twice GROUP BY row),
    kept AS (SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
        list_filter(words, lambda x, i: NOT list_contains(coalesce(places, []), i)) AS left_ FROM docs LEFT JOIN gone USING (row))
    SELECT doc_id, n_words, n_removed, sha256(array_to_string(left_, ' ')) AS kept_sha256 FROM kept"""
