"""Removal of long repeats by blockwise suffix sorting with a cover sample.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. That is so for
a start whose suffix agrees with a neighbour in the corpus's suffix array on LENGTH bytes. The
array is never built whole:

* Buckets. Every start is served by an anchor: the position of the least hash of 16 bytes within
  the WINDOW positions from the start on. Equal strings choose equal anchors, so starts whose
  anchors have different ``LENGTH - WINDOW + 1`` following bytes are never equal: the hash of these
  bytes names a suffix bucket. Buckets of one member, most of the text, end here.
* Regions. The starts that an anchor serves and their strings form a region. Equal regions are
  counted as one; a region that occurs twice is settled as a whole, without sorting.
* Sorting. Only buckets with different regions are sorted, one at a time, from one copy of
  each region's bytes. Starts at the same distance from their anchors are compared by their first
  and last bytes, COVER in all, and then, as long ties, by the precomputed rank of the string
  between, which exists for every COVER-th position around an anchor only. So memory is bounded by a
  block of regions. As anchors align the suffixes of a bucket, one residue covers all differences.
* Buckets with more than ``HOT`` different regions are spread instead: their regions are cut into pieces
  of ``PIECE`` starts, named by the bytes that all their strings share, and what differs is compared by
  groupings. Nothing is capped.

Names of strings are 64-bit hashes within a bucket, 128-bit ones across the corpus.

Passages that other documents have too, but whose LENGTH bytes do not repeat, are reported and not removed:
``n_shared_words`` counts the words that such passages cover. The anchors are the same, of words
instead of bytes: the least hash of ``WORD_GRAM`` words in every window of ``WORD_WINDOW`` words, and the
``WORD_TAIL`` words from there on are a passage if another document has them. So every passage of
``WORD_WINDOW + WORD_TAIL - 1`` (51) words that repeats across documents is found, and none of fewer
than WORD_TAIL words is.

Defined results: null counts as empty; texts shorter than LENGTH keep everything; a very long text is one of
many anchors, and only its own runs meet in one task; repeated rows remove each other, but are one document to
n_shared_words; strings that tie are all removed, the first included; an empty table gives an empty result;
columns of the input other than the text are passed on unless one has the name of an output column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage

LENGTH = 400
WINDOW = 256
GRAM = 16
COVER = 64
HOT = 256
PIECE = 16
WORD_GRAM = 3
WORD_WINDOW = 27
WORD_TAIL = 25
#: Region bytes sorted at once.
BLOCK = 400_000
#: Rows that a task makes before it hands them on, and regions cut at once.
ROWS, CUT = 60_000, 700

_rng = np.random.default_rng(20_24)
_TABLES = [_rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, n at least."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, 1 << 16)
        _powers.clear()
        for base in _BASES:
            pair = []
            for x in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, x, np.uint64)
                steps[0] = 1
                pair.append(np.multiply.accumulate(steps))
            _powers.append((pair[0], pair[1]))
    return _powers[which]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of all substrings of some bytes, or runs of some numbers, by one pass over them."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        up, self.down = _power(which, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        each = _TABLES[which][data] if data.dtype == np.uint8 else _mix(data * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        np.cumsum(each * up[:n], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def served(hashes: Hashes, starts: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of so many starts, and the first and last start that each serves."""
    n = starts + window - 1
    at = np.arange(n, dtype=np.uint64)
    key = ((hashes.sums[gram : gram + n] - hashes.sums[:n]) * hashes.down[:n]) * np.uint64(0x94D049BB133111EB)
    key = (_mix(key) & np.uint64(0xFFFFFFFF00000000)) | at
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    grid = padded.reshape(blocks, window)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[:starts], head[window - 1 : window - 1 + starts]) & np.uint64(0xFFFFFFFF)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [starts]]) - 1
    return least[first].astype(np.int64), first, last


def _pack(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Anchor and the distances of the first and last start before it, in one long."""
    return (anchor << 20) | ((anchor - first) << 10) | (anchor - last)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    anchor = packed >> 20
    return anchor, anchor - (packed >> 10 & 1023), anchor - (packed & 1023)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, packed, bucket, e1, e2 of each anchor."""
    for batch in batches:
        parts: list[list[np.ndarray]] = []
        size = 0
        for k1, k2, text in zip(*batch.columns, strict=True):
            data = _bytes(text.as_py())
            if len(data) < LENGTH:
                continue
            one, two = Hashes(data, 0), Hashes(data, 1)
            anchor, first, last = served(one, len(data) - LENGTH + 1, WINDOW, GRAM)
            bucket = one.of(anchor, anchor + LENGTH - WINDOW + 1)
            e1, e2 = one.of(first, last + LENGTH), two.of(first, last + LENGTH)
            n = len(anchor)
            parts.append([np.full(n, k1.as_py()), np.full(n, k2.as_py()), _pack(anchor, first, last), bucket.view(np.int64), e1.view(np.int64), e2.view(np.int64)])
            size += n
            if size > ROWS:
                yield _batch(parts, ANCHORS)
                parts, size = [], 0
        if parts:
            yield _batch(parts, ANCHORS)


ANCHORS = ["k1", "k2", "packed", "bucket", "e1", "e2"]
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, passage, word: a hash of the WORD_TAIL words at each anchor of a text, and the anchor's word."""
    for batch in batches:
        parts: list[list[np.ndarray]] = []
        size = 0
        for k1, k2, text in zip(*batch.columns, strict=True):
            data = _bytes(text.as_py())
            inside = np.concatenate([[False], ~_SPACES[data], [False]])
            begin = np.flatnonzero(inside[1:] & ~inside[:-1])
            starts = len(begin) - WORD_WINDOW - WORD_TAIL + 2
            if starts < 1:
                continue
            end = np.flatnonzero(inside[:-1] & ~inside[1:])
            words = Hashes(Hashes(data, 0).of(begin, end), 1)
            at, _, _ = served(words, starts, WORD_WINDOW, WORD_GRAM)
            n = len(at)
            parts.append([np.full(n, k1.as_py()), np.full(n, k2.as_py()), words.of(at, at + WORD_TAIL).view(np.int64), at])
            size += n
            if size > ROWS:
                yield _batch(parts, PASSAGES)
                parts, size = [], 0
        if parts:
            yield _batch(parts, PASSAGES)


PASSAGES = ["k1", "k2", "passage", "word"]


def _batch(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=names)


def _longs(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def _squeezed(docs: DataFrame, text: Column, extra: list[str]) -> DataFrame:
    """Keys, the columns extra, and the text compressed, as texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            small = [press.compress(_bytes(x.as_py()).tobytes()) for x in batch.column(len(extra) + 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(small, pa.binary())], names=["k1", "k2", *extra, "z"])

    narrow = docs.select("k1", "k2", *[F.col(f"`{c}`") for c in extra], text.alias("__text"))
    fields = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), *[docs.schema[c] for c in extra]]
    return narrow.mapInArrow(run, T.StructType([*fields, T.StructField("z", T.BinaryType())]))


def _open(z) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z.as_py()), np.uint8)


REGIONS = ["bucket", "k1", "k2", "packed", "n", "kinds"]


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each region wanted of a text. Columns: k1, k2, z, wanted."""
    for batch in batches:
        for k1, k2, z, wanted in zip(*batch.columns, strict=True):
            data = _open(z)
            want = wanted.values.flatten()
            bucket, packed, n, kinds = (np.array(w) for w in want)
            _, first, last = _unpack(packed)
            content = [data[a : b + LENGTH].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            longs = [bucket, np.full(len(n), k1.as_py()), np.full(len(n), k2.as_py()), packed, n, kinds]
            yield pa.RecordBatch.from_arrays([*map(pa.array, longs), pa.array(content, pa.binary())], names=[*REGIONS, "content"])


def _suffixes(content: list[bytes], packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The regions' bytes in a row; of every start: its region, place, and distance to the anchor."""
    data = np.frombuffer(b"".join(content), np.uint8)
    sizes = np.fromiter(map(len, content), np.int64, len(content))
    offset = np.cumsum(sizes) - sizes
    anchor, first, last = _unpack(packed)
    count = last - first + 1
    region = np.repeat(np.arange(len(content)), count)
    step = np.arange(len(region)) - np.repeat(np.cumsum(count) - count, count)
    return data, region, offset[region] + step, (anchor - first)[region] - step


def equal_starts(bucket: np.ndarray, packed: np.ndarray, content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the suffixes of some whole buckets. Of every start: region, step within the region,
    and whether another region of the bucket has its LENGTH bytes."""
    data, region, place, distance = _suffixes(content, packed)
    hashes = Hashes(data, 0)
    # the cover sample: positions whole COVERs before the anchor, each with the rank of the bytes in the middle
    skip = distance % COVER
    sample = place + skip
    rank_of, to_sample = np.unique(sample, return_inverse=True)
    rank = hashes.of(rank_of, rank_of + LENGTH - COVER)
    ends = _mix(hashes.of(place, place + skip) * np.uint64(31) + hashes.of(sample + LENGTH - COVER, place + LENGTH))
    prefix = _mix(bucket.view(np.uint64)[region] * np.uint64(3) + distance.astype(np.uint64))
    key = _mix(_mix(prefix + ends * np.uint64(5)) + rank[to_sample] * np.uint64(7))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    _, first, _ = _unpack(packed)
    sizes = np.fromiter(map(len, content), np.int64, len(content))
    return region, place - (np.cumsum(sizes) - sizes)[region], twice


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, start, end of removed runs; the input has whole buckets, sorted by bucket."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > BLOCK:
            table = pa.Table.from_batches(held).combine_chunks()
            bucket = table.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1], side="left"))
            if cut:
                yield from _runs(table.slice(0, cut))
            rest = table.slice(cut)
            held, size = rest.to_batches(), rest.nbytes
    if held:
        yield from _runs(pa.Table.from_batches(held))


def _runs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    bucket = table.column("bucket").to_numpy()
    sizes = np.cumsum([len(x) for x in table.column("content").to_pylist()])
    a = 0
    while a < len(bucket):  # whole buckets of about BLOCK bytes
        b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BLOCK, side="right"))
        b = int(np.searchsorted(bucket, bucket[min(max(b, a + 1), len(bucket)) - 1], side="right"))
        part = table.slice(a, b - a)
        packed, n = part.column("packed").to_numpy(), part.column("n").to_numpy()
        region, step, twice = equal_starts(bucket[a:b], packed, part.column("content").to_pylist())
        hit = np.flatnonzero(twice & (n[region] == 1))  # a region that occurs twice is settled already
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (region[hit][1:] != region[hit][:-1]) | (step[hit][1:] != step[hit][:-1] + 1)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(hit)) - 1
            r = region[hit][begin]
            first = _unpack(packed)[1][r]
            yield _batch([[part.column("k1").to_numpy()[r], part.column("k2").to_numpy()[r], first + step[hit][begin], first + step[hit][end] + LENGTH]], RUNS)
        a = b


RUNS = ["k1", "k2", "start", "end"]
PIECES = ["s1", "s2", "k1", "k2", "start", "n"]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions in pieces of at most PIECE starts: a hash of the bytes that all strings of a piece
    share, with their distance to the anchor, and the bytes on the left and right that they do not."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        for a in range(0, batch.num_rows, CUT):
            packed = columns["packed"].slice(a, CUT).to_numpy()
            data, region, place, distance = _suffixes(columns["content"].slice(a, CUT).to_pylist(), packed)
            # a piece ends where the distance to the anchor is a multiple of PIECE, or with its region
            begin = np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (distance[1:] % PIECE == PIECE - 1)))
            end = np.append(begin[1:], len(region)) - 1
            first, last, r, aligned = place[begin], place[end], region[begin], distance[begin] // PIECE
            # what any string of a piece covers, wherever its region cut the piece short
            inner = first + distance[begin] % PIECE
            outer = inner - (PIECE - 1) + LENGTH
            shape = aligned.astype(np.uint64) * np.uint64(9)
            names = [_mix(Hashes(data, k).of(inner, outer) + shape).view(np.int64) for k in range(2)]
            of = lambda name: columns[name].slice(a, CUT).to_numpy()[r]  # noqa: B023, E731
            longs = [*names, of("k1"), of("k2"), (packed >> 20)[r] - distance[begin], of("n")]
            raw = data.tobytes()
            left = [raw[x:y] for x, y in zip(first.tolist(), inner.tolist(), strict=True)]
            right = [raw[x : y + LENGTH] for x, y in zip(outer.tolist(), last.tolist(), strict=True)]
            ends = [pa.array(left, pa.binary()), pa.array(right, pa.binary())]
            yield pa.RecordBatch.from_arrays([*map(pa.array, longs), *ends], names=[*PIECES, "left", "right"])


def _spread(regions: DataFrame) -> DataFrame:
    """k1, k2, start, end of the repeated starts of regions of very common buckets.

    Pieces that are equal as a whole are settled by counting. The rest, whose shared bytes occur in
    other pieces too, become rows for each start, which are equal if what differs within
    the pieces is. Everything is counted by shuffles over many keys.
    """
    pieces = cut_lineage(regions.mapInArrow(_cut, _longs(PIECES) + ", left binary, right binary"))
    whole = pieces.groupBy("s1", "s2", "left", "right").agg(F.sum("n").alias("c"), F.count("*").alias("members"))
    whole = cut_lineage(whole)
    here = pieces.filter("n = 1").join(whole.filter("c > 1").select("s1", "s2", "left", "right"), ["s1", "s2", "left", "right"], "left_semi")
    settled = here.select("k1", "k2", "start", (F.col("start") + F.length("left") + F.length("right") - (PIECE - 1) + LENGTH).alias("end"))

    kinds = whole.groupBy("s1", "s2").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("s1", "s2")
    ends = whole.join(kinds, ["s1", "s2"], "left_semi").select("s1", "s2", "left", "right", "c")
    each = ends.select("*", F.explode(F.sequence(F.lit(PIECE - 1) - F.length("right"), F.length("left"))).alias("j"))
    each = each.select("s1", "s2", "left", "right", "c", "j", F.expr("substring(left, length(left) - j + 1)").alias("before"), F.expr(f"substring(right, 1, {PIECE - 1} - j)").alias("after"))
    key = ["s1", "s2", "j", "before", "after"]
    equal = each.groupBy(*key).agg(F.count("*").alias("m")).filter("m > 1").select(*key)
    found = each.filter("c = 1").join(equal, key, "left_semi").select("s1", "s2", "left", "right", "j")
    single = pieces.filter("n = 1").join(found, ["s1", "s2", "left", "right"])
    at = F.col("start") + F.length("left") - F.col("j")
    loose = single.select("k1", "k2", at.alias("start"), (at + LENGTH).alias("end"))
    return settled.union(loose)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_bytes, n_removed, n_spans, n_shared_words, kept_sha256 from the last columns: z, runs, words."""
    for batch in batches:
        results = []
        for z, runs, words in zip(*batch.columns[-3:], strict=True):
            data = _open(z)
            spans = merged(runs.values.flatten()) if runs.is_valid and len(runs) else []
            at = np.sort(words.values.to_numpy()) if words.is_valid else np.zeros(0, np.int64)
            shared = int(np.minimum(np.diff(at), WORD_TAIL).sum()) + WORD_TAIL if len(at) else 0
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[at:a].tobytes())
                at = b
            kept.update(data[at:].tobytes())
            results.append((len(data), sum(b - a for a, b in spans), len(spans), shared, kept.hexdigest()))
        columns = [pa.array([r[i] for r in results], pa.int64() if i < 4 else pa.string()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:-3], *columns], names=[*batch.schema.names[2:-3], *OUT])


OUT = ["n_bytes", "n_removed", "n_spans", "n_shared_words", "kept_sha256"]


def merged(runs) -> list[tuple[int, int]]:
    """Maximal runs of the union of [start, end) pairs, given as two columns."""
    start, end = (np.array(x, np.int64) for x in runs)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return list(zip(start[new].tolist(), end[np.append(new[1:], True)].tolist(), strict=True))


def _keyed(docs: DataFrame, text: str, rest: list[str]) -> DataFrame:
    """row (the columns rest), text, and a key of 128 bits that rows share only if they are the same."""
    column = F.col(f"`{text}`")
    plain = [F.col(f"`{c}`") for c in rest if not any(t in docs.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    return docs.select(row.alias("row"), column.alias("text"), F.xxhash64(*plain, column).alias("k1"), F.xxhash64(column, *plain, F.lit("second")).alias("k2"))


def repeats(keyed: DataFrame, text: Column) -> DataFrame:
    """k1, k2, start, end: runs of bytes of repeated strings; runs of a text may overlap."""
    anchors = keyed.select("k1", "k2", text.alias("text")).mapInArrow(_anchors, _longs(ANCHORS))
    twice = cut_lineage(anchors.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket"))
    shared = cut_lineage(anchors.join(twice, "bucket", "left_semi"))

    regions = shared.groupBy("bucket", "e1", "e2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "packed")).alias("one"))
    regions = cut_lineage(regions)
    settled = shared.join(regions.filter("n > 1").select("bucket", "e1", "e2"), ["bucket", "e1", "e2"], "left_semi")
    anchor = F.call_function("shiftright", F.col("packed"), F.lit(20))
    runs = settled.select(
        "k1",
        "k2",
        (anchor - F.call_function("shiftright", F.col("packed"), F.lit(10)).bitwiseAND(1023)).alias("start"),
        (anchor - F.col("packed").bitwiseAND(1023) + LENGTH).alias("end"),
    )

    kinds = regions.groupBy("bucket").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    wanted = regions.join(kinds, "bucket").select("one.k1", "one.k2", F.struct("bucket", "one.packed", "n", "kinds").alias("want"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("want").alias("wanted"))
    squeezed = _squeezed(keyed, text, [])
    open_ = squeezed.join(wanted, ["k1", "k2"]).select("k1", "k2", "z", "wanted").mapInArrow(_regions, _longs(REGIONS) + ", content binary")
    open_ = cut_lineage(open_)

    few = open_.filter(F.col("kinds") <= HOT).repartition("bucket").sortWithinPartitions("bucket")
    few = few.mapInArrow(_sorted_buckets, _longs(RUNS))

    return runs.union(few).union(_spread(open_.filter(F.col("kinds") > HOT)))


def shared_passages(keyed: DataFrame, text: Column) -> DataFrame:
    """k1, k2, word: the first word of each passage at an anchor that another document has too."""
    passages = keyed.select("k1", "k2", text.alias("text")).mapInArrow(_passages, _longs(PASSAGES))
    one = F.struct("k1", "k2")
    twice = passages.groupBy("passage").agg(F.min(one).alias("a"), F.max(one).alias("b")).filter("a <> b").select("passage")
    return passages.join(cut_lineage(twice), "passage", "left_semi").select("k1", "k2", "word")


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes, n_removed, n_spans, n_shared_words and kept_sha256."""
    rest = [c for c in docs.columns if c not in (*OUT, text)]
    keyed = _keyed(docs, text, rest)
    none = F.lit(None).cast("long")
    runs = repeats(keyed, F.col("text")).select("k1", "k2", F.struct("start", "end").alias("run"), none.alias("word"))
    words = shared_passages(keyed, F.col("text")).select("k1", "k2", F.when(F.lit(False), F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).alias("run"), "word")
    found = runs.union(words).groupBy("k1", "k2").agg(F.collect_set("run").alias("runs"), F.collect_set("word").alias("words"))
    joined = _squeezed(keyed, F.col("text"), ["row"]).join(found, ["k1", "k2"], "left").select("k1", "k2", "row", "z", "runs", "words")
    fields = [keyed.schema["row"]] + [T.StructField(c, T.LongType() if c != "kept_sha256" else T.StringType()) for c in OUT]
    return joined.mapInArrow(_without, T.StructType(fields)).select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *OUT)
