"""SimHash near-duplicates whose links are exact: a Jaccard similarity of word shingles.

Two texts link if the sets of their ``SHINGLE``-word shingles have a Jaccard similarity of at least
``OVER`` / ``UNDER``; components of links are one. First come the pairs that SimHash finds: fingerprints of the sets,
linked by pigeonring chains as in ``simhash``, and texts of one fingerprint with the least of them. Each pair's sets are then
compared. Fingerprints of similar sets may differ in more bits than a chain can search, so SimHash alone
loses links. The rest come from a prefix filter, which loses none: of sets in one total order, two that
are so similar share one of the first n - ceil(n * OVER / UNDER) + 1 shingles of each, so texts
with a shared prefix shingle are candidates, unless it stands too far back: what comes before the first shared shingle of two sets
is in one of them only, and all shared ones come after it, so its two places and the difference of what follows tell how
many shingles differ at least. A shingle of one set alone changes one bit at most of the
sets' parity sketches, so candidates whose sketches differ in more bits than their sets may go, and the sets
of all others are compared. The order has shingles that are frequent in a sample last; it decides how many
candidates there are, not which links.

Equal sets are collapsed first. Of the texts that share a prefix shingle, each is first compared with the one that has it
foremost: rare shingles come first, so that text has the fewest of its own, and whatever is like another copy of one text
is like the least changed copy. Only pairs that all these links do not connect are compared after that, so a large group of
near copies leaves few candidates. A stage of many steps would leave files and tasks in proportion to steps and partitions, however few rows there are,
so relations are in as few parts as their rows need. Looking for them still meets every pair of texts that share a frequent prefix shingle and are of
more than one component, by sizes and places alone: that part is quadratic in time, not in rows.

Defined results: ASCII case and the kind of spaces do not count; a text with fewer words than a shingle is one
shingle, null texts and texts without a word are one empty shingle; a very long text has a set as any other, held by one
task for one text at a time; of texts that tie for the least key any one stays; repeated rows are one; an empty table gives an empty
result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WIDE, cut_lineage, join_by_key, packed, spread
from .components import components
from .simhash import _LOWER, SEED, least_rows, majority
from .simhash import links as fingerprint_links

SHINGLE = 5
OVER, UNDER = 4, 5
#: Texts, about, in the sample that counts shingles, and the least count of a frequent one there.
SAMPLE, FREQUENT = 5000, 3
#: The sample is one in so many texts at least, since the order of rarer shingles decides how far back a shared one stands.
ONE_IN = 8
#: Frequent shingles in the order's table at most; any other is ordered by its hash alone.
TABLE = 200_000
#: Rows whose texts are compared again: their marks are broadcast up to so many (16 MB), and joined by a shuffle beyond.
BROADCAST_MARKS = 1_000_000
#: Least bits of a sketch, the parity of a set's hashes by their last bits; a set has twice as many bits as shingles or more.
BITS = 1024


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    of = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [of(b" ".join(words), SEED)]
    else:
        hashes = [of(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(width)), strict=False)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def prefix_size(n: int) -> int:
    return n - -(-n * OVER // UNDER) + 1


def sketch(s: np.ndarray) -> np.ndarray:
    bits = max(BITS, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _folded(x: Column, y: Column) -> Column:
    """Sketch x in the bits of sketch y, which has as many or half as many."""
    half = F.size(y)
    return F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(x)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def sets(rows: DataFrame) -> DataFrame:
    """mark and shingles of rows (mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(x.as_py()) for x in batch.column(1)])], names=["mark", "shingles"])

    return rows.select("mark", "text").mapInArrow(run, "mark long, shingles array<long>")


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of frequent shingles of rows (mark, text), and their counts in the sample."""
    every = max(1, min(rows.count() // SAMPLE, ONE_IN))
    each = sets(rows.filter(F.pmod("mark", F.lit(every)) == 0)).select(F.explode("shingles").alias("x"))
    found = each.groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "x").limit(TABLE).collect()
    found = np.array(sorted((r.x, r.n) for r in found), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def prefixes(rows: DataFrame) -> DataFrame:
    """key, mark, sig (a hash of the set), n, fp, prefix and sketch of rows (key, mark, text)."""
    known, counts = frequent(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, sizes, prints, firsts, drawn = [], [], [], [], []
            for x in batch.column(2):
                s = shingles(x.as_py())
                often = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[at] == s, counts[at], 0)
                sigs.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                prints.append(majority(s.view(np.uint64)))
                drawn.append(sketch(s))
                firsts.append(s[np.lexsort((s, often))[: prefix_size(len(s))]])
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            made = [longs(sigs), pa.array(sizes, pa.int32()), longs(prints), _lists(firsts), _lists(drawn)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["key", "mark", "sig", "n", "fp", "prefix", "sketch"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "mark", "text").mapInArrow(run, f"key {kind}, mark long, sig long, n int, fp long, prefix array<long>, sketch array<long>")


def _near(a: str, b: str) -> Column:
    """Whether sets of two sizes can be similar."""
    return F.lit(UNDER) * F.least(a, b) >= F.lit(OVER) * F.greatest(a, b)


def _possible(i: Column, m: Column, j: Column, n: Column) -> Column:
    """Whether sets of m and n shingles can be similar if their first shared one is at places i and j, from 0."""
    return F.lit(OVER + UNDER) * (i + j + F.abs((m - i) - (n - j))) <= F.lit(UNDER - OVER) * (m + n)


def _plausible(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Those of pairs (u, v and their sizes m, n) whose sizes and sketches allow similar sets, and the bits in which their sketches differ; distinct: sig and sketch."""
    side = lambda sig, name: distinct.select(F.col("sig").alias(sig), F.col("sketch").alias(name))
    total = pairs.count()
    drawn = packed(packed(packed(pairs, total).filter(_near("m", "n")).join(side("v", "b"), "v"), total, WIDE).join(side("u", "a"), "u"), total, WIDE)
    bits = F.aggregate(F.zip_with(_folded(F.col("a"), F.col("b")), _folded(F.col("b"), F.col("a")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return cut_lineage(drawn.select("u", "v", "m", "n", bits.alias("bits")).filter((OVER + UNDER) * F.col("bits") <= (UNDER - OVER) * (F.col("m") + F.col("n"))).select("u", "v", "bits"))


def _verified(pairs: DataFrame, distinct: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose sets are similar; distinct: sig and the mark of one of its rows."""
    total = pairs.count()
    if not total:
        return pairs
    pairs = packed(pairs, total)
    wanted = packed(pairs.select(F.explode(F.array("u", "v")).alias("sig")).distinct(), 2 * total)
    named = cut_lineage(packed(wanted.join(distinct.select("sig", "mark"), "sig"), 2 * total))
    many = named.count()
    # texts are shuffled only where the marks wanted are too many to go to every task
    named = F.broadcast(named) if many <= BROADCAST_MARKS else named
    texts = packed(rows.join(named.select("mark"), "mark", "left_semi").dropDuplicates(["mark"]), many, WIDE)
    found = cut_lineage(packed(sets(texts).join(named, "mark").select("sig", "shingles"), many, WIDE))
    a, b = found.select(F.col("sig").alias("u"), F.col("shingles").alias("a")), found.select(F.col("sig").alias("v"), F.col("shingles").alias("b"))
    # many pairs may have one u, the least text of a large group
    both = packed(packed(spread(pairs, a, "u", "v", total), total, WIDE).join(b, "v"), total, WIDE)
    # J = i / (a + b - i) >= OVER / UNDER
    alike = (OVER + UNDER) * F.size(F.array_intersect("a", "b")) >= OVER * (F.size("a") + F.size("b"))
    return cut_lineage(both.filter(alike).select("u", "v"))


def _apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Those of pairs (u, v) that links do not connect; linked: node, component."""
    side = lambda c, x: linked.select(F.col("node").alias(c), F.col("component").alias(x))
    total = pairs.count()
    both = packed(packed(packed(pairs, total).join(side("u", "x"), "u", "left"), total).join(side("v", "y"), "v", "left"), total)
    return both.filter(F.coalesce("x", "u") != F.coalesce("y", "v")).select("u", "v")


def _by_fingerprint(distinct: DataFrame, total: int) -> DataFrame:
    """u, v and their sizes m, n: sigs of one fingerprint with the least of them, and the least of fingerprints that link; distinct: total rows."""
    sized = F.struct("sig", F.col("n").alias("size"))
    least = cut_lineage(packed(distinct.groupBy("fp").agg(F.min(sized).alias("c"), F.count("*").alias("n")), total))
    own = packed(join_by_key(distinct.select("fp", sized.alias("d")), least, ["fp"], total), total).select("c", "d")
    side = lambda fp, c: least.select(F.col("fp").alias(fp), F.col("c").alias(c))
    near = cut_lineage(fingerprint_links(least.select("fp")).withColumnsRenamed({"u": "a", "v": "b"}))
    many = near.count()
    linked = packed(packed(packed(near, many).join(side("a", "x"), "a"), many).join(side("b", "y"), "b"), many)
    both = own.filter("c.sig <> d.sig").union(linked.select(F.least("x", "y"), F.greatest("x", "y")))
    return both.select(F.col("c.sig").alias("u"), F.col("d.sig").alias("v"), F.col("c.size").alias("m"), F.col("d.size").alias("n"))


def _still_apart(joined: DataFrame) -> DataFrame:
    """u, v, m, n: pairs of sets of different components (of) that share a shingle (at) and can be similar by its places (pos). joined: at, sig, size, pos, of."""
    apart = joined.groupBy("at").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x < y").select("at")
    some = cut_lineage(packed(joined.join(apart, "at", "left_semi"), joined.count()))
    side = lambda sig, size, pos, of: some.select("at", F.col("sig").alias(sig), F.col("size").alias(size), F.col("pos").alias(pos), F.col("of").alias(of))
    both = side("u", "m", "i", "x").join(side("v", "n", "j", "y"), "at")
    return both.filter((F.col("u") < F.col("v")) & (F.col("x") != F.col("y")) & _possible(*map(F.col, "imjn"))).select("u", "v", "m", "n").distinct()


def links(marked: DataFrame, rows: DataFrame) -> DataFrame:
    """u, v: links between sigs that have the same components as all links."""
    # of equal sets, whose prefixes and sketches are equal too, one row
    kinds = marked.groupBy("sig").agg(F.min("mark").alias("mark"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("sketch").alias("sketch"), F.any_value("prefix").alias("prefix"))
    distinct = cut_lineage(packed(kinds, marked.count(), WIDE))
    each = distinct.select(F.posexplode("prefix").alias("pos", "at"), "sig", F.col("n").alias("size"))
    texts, total = distinct.agg(F.count("*"), F.sum(F.size("prefix"))).first()
    total = total or 0
    met = cut_lineage(packed(each.groupBy("at").agg(F.count("*").alias("n")).filter("n > 1"), total))
    shared = cut_lineage(packed(join_by_key(each, met, ["at"], total), total).select("at", "sig", "size", "pos"))
    many = shared.count()
    shared = packed(shared, many)
    foremost = cut_lineage(packed(shared.groupBy("at").agg(F.min(F.struct("pos", "sig", "size")).alias("c"), F.count("*").alias("n")), many))
    around = packed(join_by_key(shared, foremost, ["at"], many), many).filter((F.col("c.sig") != F.col("sig")) & _possible(F.col("c.pos"), F.col("c.size"), F.col("pos"), F.col("size")))
    stars = around.select(F.col("c.sig").alias("u"), F.col("sig").alias("v"), F.col("c.size").alias("m"), F.col("size").alias("n"))
    some = _plausible(cut_lineage(packed(stars.union(_by_fingerprint(distinct, texts)).distinct(), many)), distinct)
    # the likeliest pair of each set first, which connects most; then those that are still apart
    likeliest = packed(some.groupBy("v").agg(F.min(F.struct("bits", "u")).alias("c")), texts).select("c.u", "v")
    first = _verified(cut_lineage(likeliest), distinct, rows)
    rest = cut_lineage(_apart(some, cut_lineage(components(first, texts))))
    first = cut_lineage(first.union(_verified(rest, distinct, rows)))

    linked = components(first, first.count()).withColumnRenamed("node", "sig")
    joined = packed(shared.join(linked, "sig", "left"), many).withColumn("of", F.coalesce("component", "sig"))
    pairs = cut_lineage(_still_apart(cut_lineage(joined.select("at", "sig", "size", "pos", "of"))))
    return cut_lineage(first.union(_verified(_plausible(pairs, distinct).select("u", "v"), distinct, rows)))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that of the least key (null last), whole row unchanged."""
    mark = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), mark.alias("mark"), F.col(f"`{text}`").alias("text"))
    marked = cut_lineage(prefixes(rows))
    found, total = links(marked, rows), marked.count()
    linked = components(found, found.count()).withColumnRenamed("node", "sig")
    # one row a set, of which there may be very many copies
    roots = marked.groupBy("sig").agg(F.count("*").alias("n")).join(linked, "sig", "left").select("sig", F.coalesce("component", "sig").alias("root"), "n")
    rooted = packed(join_by_key(marked.select("key", "mark", "sig"), cut_lineage(packed(roots, total)), ["sig"], total), total).drop("n")
    return least_rows(docs, rooted, mark, total)
