"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits from the hashes of all word shingles. Two fingerprints link if at most
``DISTANCE`` bits differ. The 64 bits stand on a ring of ``SEGMENTS`` segments. If the ring's
total difference is at most d, some chain of consecutive segments keeps every prefix of k segments
within k * d / SEGMENTS differing bits. For d = 2 and 16 segments, the first seven segments of
the chain are equal, so equal 28-bit keys at some rotation find every link; the chain's further
prefixes prune the candidates before the full check.

Copies are collapsed first: only distinct fingerprints are compared. A key that more than ``HOT`` distinct
fingerprints share is split: at most d of the bits beside the key differ, so of d + 1 groups of those bits one is
equal, and each group makes a longer key; so on until at most ``LOOSE`` bits are left, which bounds
the fingerprints of a key. No link is lost, and every candidate passes the same chain check.

Defined results: null texts and texts without a word have fingerprint zero and link as any
other; a very long text is counted in blocks of its shingles; null ids count as no id in the component's least id;
a bit of just half the shingles (a tie) is 0; repeated rows are in one component; an empty table gives an empty result;
columns beside key and text are not looked at, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, join_by_key, packed
from .components import components

SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
#: Segments of a chain that must be equal: prefixes whose budget is below one bit.
EQUAL = (SEGMENTS - 1) // DISTANCE
HOT = 50
#: Bits beside a key at which it is split no more: at most 2 ** LOOSE fingerprints share it.
LOOSE = 12
#: Marks of rows (16 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_MARKS = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """As an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    of = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [of(b" ".join(words), seed)]
    else:
        hashes = [of(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some unsigned 64-bit numbers."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs without the text, with fp (the fingerprint's bits as a long)."""
    rest = [c for c in docs.columns if c not in ("fp", text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(len(rest))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*rest, "fp"])

    narrow = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"))
    return narrow.mapInArrow(run, T.StructType([docs.schema[c] for c in rest] + [T.StructField("fp", T.LongType())]))


def _rotated(x: Column, by: Column) -> Column:
    """x with the bits of segment number `by` first."""
    left = F.call_function("shiftleft", x, by * WIDTH)
    return F.when(by == 0, x).otherwise(left.bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(64) - by * WIDTH)))


def _chain_holds(difference: Column, by: Column) -> Column:
    """Whether the chain that starts at segment `by` keeps the budget of each of its prefixes."""
    ring = _rotated(difference, by)
    ok = F.bit_count(difference) <= DISTANCE
    for budget in range(DISTANCE):
        # the longest prefix with this budget has the most bits of all that have it
        segments = next(k for k in range(SEGMENTS, 0, -1) if k * DISTANCE // SEGMENTS == budget)
        ok = ok & (F.bit_count(F.call_function("shiftrightunsigned", ring, F.lit(64 - segments * WIDTH))) <= budget)
    return ok


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Bits of a key from the first segment of its chain on, and the longer keys that it is split into.
FIRST_KEY = ((1 << EQUAL * WIDTH) - 1) << (64 - EQUAL * WIDTH)


def _split(mask: int) -> list[int]:
    left = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(left) * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
    return [mask | sum(1 << b for b in left[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def links(distinct: DataFrame) -> DataFrame:
    """u, v: all links between distinct fingerprints (fp)."""
    rows = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("by")).withColumns({"ring": _rotated(F.col("fp"), F.col("by")), "mask": F.lit(_signed(FIRST_KEY)).cast("long")})
    masks, found, most = [FIRST_KEY], [], SEGMENTS * distinct.count()
    while True:
        keys = rows.withColumn("part", F.col("ring").bitwiseAND(F.col("mask")))
        counted = cut_lineage(packed(keys.groupBy("by", "mask", "part").agg(F.count("*").alias("n")).filter("n > 1"), most))
        total = counted.agg(F.sum("n")).first()[0] or 0
        here = cut_lineage(packed(join_by_key(keys.select("fp", "by", "ring", "mask", "part"), counted, ["by", "mask", "part"], total), most))
        last = all(64 - m.bit_count() <= LOOSE for m in masks)
        cold = here if last else here.filter(F.col("n") <= HOT)
        a = cold.select("by", "mask", "part", F.col("fp").alias("u"))
        b = cold.select("by", "mask", "part", F.col("fp").alias("v"))
        pairs = packed(a.join(b, ["by", "mask", "part"]).filter("u < v"), total * (1 << LOOSE if last else HOT))
        found.append(pairs.filter(_chain_holds(F.col("u").bitwiseXOR(F.col("v")), F.col("by"))).select("u", "v"))
        hot = here.filter(F.col("n") > HOT)
        if last or hot.isEmpty():
            return reduce(DataFrame.union, found)
        longer = F.create_map(*[y for m in masks for y in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in _split(m)]))])
        rows = hot.select("fp", "by", "ring", F.explode(F.try_element_at(longer, F.col("mask"))).alias("mask"))
        masks, most = [x for m in masks for x in _split(m)], (DISTANCE + 1) * total


def classes(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """fp, root, component_id of each fingerprint of marked (key, fp), and n, its rows."""
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min(f"`{key}`").alias("least"), F.count("*").alias("n")))
    linked = components(links(distinct.select("fp")))
    rooted = cut_lineage(distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return join_by_key(rooted.select("fp", "root", F.col("n").alias("rows")), least, ["root"], rooted.count()).select("fp", "root", "component_id", F.col("rows").alias("n"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """key, fingerprint (hex) and component_id of each row."""
    marked = cut_lineage(fingerprints(docs.select(key, F.col(f"`{text}`").alias("text")), shingle=shingle))
    joined = join_by_key(marked, cut_lineage(classes(marked, key)), ["fp"], marked.count())
    return joined.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_rows(docs: DataFrame, rooted: DataFrame, mark: Column, total: int) -> DataFrame:
    """The row of docs of the least key (null last) of each root; rooted: root, key, mark of every row, total in all."""
    # the row of the least key, then mark; counted, as rows may be repeated
    each = packed(rooted.groupBy("root", "key", "mark").agg(F.count("*").alias("n")), total)
    order = F.struct(F.col("key").isNull().alias("null"), F.col("key").alias("key"), F.col("mark").alias("mark"), F.col("n").alias("n"))
    chosen = cut_lineage(packed(each.groupBy("root").agg(F.min(order).alias("c")).select("c.key", "c.mark", "c.n"), total))
    with_mark = docs.withColumn("__mark", mark)
    # a key and a hash of it and the text name a row; texts are shuffled only where the marks are too many to go to every task
    few = chosen.count() <= BROADCAST_MARKS
    marks = lambda which: (F.broadcast if few else lambda x: x)(chosen.filter(which).select(F.col("mark").alias("__mark")))
    once = with_mark.join(marks("n = 1"), "__mark", "left_semi")
    more = with_mark.join(marks("n > 1"), "__mark", "left_semi")
    return once.drop("__mark").unionByName(more.dropDuplicates(["__mark"]).drop("__mark"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of the least key (null last), whole row unchanged."""
    mark = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), mark.alias("mark"))
    marked = cut_lineage(fingerprints(rows))
    total = marked.count()
    rooted = join_by_key(marked, cut_lineage(classes(marked, "key")), ["fp"], total)
    return least_rows(docs, rooted.select("root", "key", "mark"), mark, total)
