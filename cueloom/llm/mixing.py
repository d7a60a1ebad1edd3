"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Within a source every document has an expected number of
copies of its own: in proportion to a preference that grows with its length (the number of binary digits
of its words, plus ``FLAT``), never above ``MOST_COPIES``, and scaled so that the words expected
are the target. The whole part of that number is certain; the rest is its inclusion probability p.
Documents are ranked by the random odds u / (1 - u) divided by the inclusion odds p / (1 - p), and the
sample takes the least ranks up to its fixed size, the words that certain copies leave of the target.
The random number is a hash of the row, so reruns agree.

No source is gathered in one task: sums over ``BINS`` ranges of the rank come first, the
one range in which the sample ends is cut again, ``LEVELS`` times in all, and only what is left of it,
one in BINS ** LEVELS of a source, is sorted to find the rank at which the sample ends. What decides a
document is then a comparison with a few numbers of its source.

Defined results: a null or empty text has no words and is taken 0 times; a very long text counts as
any other, however many words it has; null is a source of its own, last in order; rows of equal rank,
repeated rows that is, are taken together or not at all; an empty table gives an empty result; further
columns are passed on unless they have an output's name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, word_count

#: By the rank of the source, repeating.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
#: Preference of a document: FLAT and the binary digits of its number of words.
FLAT = 4
BINS, LEVELS = 256, 3
#: Tables of one row a source are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_SOURCES = 50_000
SEED = "mix-1"


def _uniform(key: Column) -> Column:
    """In (0, 1), from 52 bits of a hash of the key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), key)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _preference(size: Column) -> Column:
    return (F.length(F.bin(size)) + FLAT).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size and target of each source; one row a source, however many rows it has.

    The water level that shares TOTAL_SHARE of all words by weight, with no source above
    MOST_COPIES times its size, comes from running sums over the sources in order of cap by
    weight. These windows see one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    per = per.withColumn("w", F.get(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS)))
    per = per.withColumn("cap", F.lit(MOST_COPIES) * F.col("source_size"))
    ratio = F.col("cap") / F.col("w")
    order = Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    per = per.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    per = per.withColumn("want", F.sum("source_size").over(everything) * F.lit(TOTAL_SHARE))
    per = per.withColumn("level", (F.col("want") - F.col("capped")) / F.col("w_left"))
    # the level of the first source in this order that is not capped by it holds for all after it;
    # there it is largest
    per = per.withColumn("level", F.max(F.when(F.col("level") <= ratio, F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))
    )
    return per.select("source", "source_size", target.alias("target"))


def _per_source(frame: DataFrame) -> DataFrame:
    """A table of one row a source, computed once, broadcast where its counted rows are few."""
    kept = cut_lineage(frame)
    return F.broadcast(kept) if kept.count() <= BROADCAST_SOURCES else kept


def _expected(scale: Column, preference: Column) -> Column:
    """Expected copies of a document of a source."""
    return F.least(F.lit(float(MOST_COPIES)), scale * preference)


def _rates(sized: DataFrame) -> DataFrame:
    """s, source_size, target, scale (expected copies by preference) and rest (words the sample is to have) of each source."""
    classes = sized.groupBy("source", _preference(F.col("size")).alias("g")).agg(F.sum("size").alias("in_class"))
    classes = cut_lineage(classes)
    targets = source_targets(classes.select("source", F.col("in_class").alias("size")))
    each = classes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    # classes of the greatest preference reach MOST_COPIES first; a source has a class for each binary length at most
    ahead = Window.partitionBy("s").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("s")
    each = each.withColumn("full", F.coalesce(F.sum("in_class").over(ahead), F.lit(0)))
    each = each.withColumn("open", F.sum(F.col("in_class") * F.col("g")).over(everything) - F.coalesce(F.sum(F.col("in_class") * F.col("g")).over(ahead), F.lit(0)))
    scale = F.try_divide(F.col("target") - MOST_COPIES * F.col("full"), F.col("open"))
    # the scale of the first class that stays below MOST_COPIES holds for it and all after it; where all are at
    # MOST_COPIES any scale that takes the smallest preference there will do
    each = each.withColumn("fits", F.when(scale * F.col("g") <= MOST_COPIES, scale))
    scales = each.groupBy("s").agg(F.coalesce(F.max("fits"), F.lit(float(MOST_COPIES))).alias("scale"))
    whole = F.floor(_expected(F.col("scale"), F.col("g"))) * F.col("in_class")
    rest = each.join(scales.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")))
    return rest.groupBy("s").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("scale").alias("scale"),
        F.greatest(F.first("target") - F.sum(whole), F.lit(0.0)).alias("rest"),
    )


def _ranked(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """sized with its source's numbers, whole (certain copies) and z, the rank in [0, 1]; 1: not in the sample."""
    rows = sized.join(rates, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    expected = _expected(F.col("scale"), _preference(F.col("size")))
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.floor(expected)).otherwise(0).cast("int"))
    p = expected - F.floor(expected)
    quotient = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return rows.withColumn("z", F.when((p > 0) & (F.col("rest") > 0) & (F.col("size") > 0), quotient / (1 + quotient)).otherwise(1.0))


def _cuts(ranked: DataFrame, rates: DataFrame) -> DataFrame:
    """s and last, the greatest rank in the sample of a source that has one; ranked: source, size, z, rest."""
    rows = ranked.filter("z < 1").select("source", "size", "z", "rest", F.lit(0).cast("long").alias("below"))
    width, found = 1.0, []
    for _ in range(LEVELS):
        width /= BINS
        place = F.least(F.floor(F.col("z") / width), F.lit(round(1 / width) - 1))
        rows = rows.withColumn("bin", place)
        bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"), F.max("z").alias("top"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = cut_lineage(bins.withColumn("at", F.col("below") + F.coalesce(F.sum("in_bin").over(ahead), F.lit(0))))
        # ranges before the one in which the sample ends are in it whole
        found.append(bins.filter(F.col("at") + F.col("in_bin") < F.col("rest")).select("source", "top"))
        ends = bins.filter((F.col("at") < F.col("rest")) & (F.col("rest") <= F.col("at") + F.col("in_bin")))
        ends = _per_source(ends.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.col("at").alias("from")))
        rows = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).withColumn("below", F.col("from")).drop("s", "b", "from", "bin")
    peers = rows.groupBy("source", "z").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("below").alias("below"))
    upto = Window.partitionBy("source").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.col("below") + F.sum("size").over(upto) - F.col("size") / 2
    found.append(peers.withColumn("reach", reach).filter("reach <= rest").select("source", F.col("z").alias("top")))
    cuts = reduce(DataFrame.unionByName, found).groupBy("source").agg(F.max("top").alias("last"))
    return cuts.withColumnRenamed("source", "s")


def _sized(docs: DataFrame, text: str, source: str, key: str, carry: Column) -> DataFrame:
    col = lambda c: F.col(f"`{c}`")
    seed = F.coalesce(col(key).cast("string"), F.md5(col(text)), F.lit(""))
    return docs.select(col(source).alias("source"), word_count(col(text)).alias("size"), _uniform(seed).alias("u"), carry.alias("row"))


def _mixed(docs: DataFrame, text: str, source: str, key: str, rest: list[str], slim: bool) -> DataFrame:
    carry = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None)
    # words are counted once for all that follows; where whole rows are carried, once more at the end
    sized = _sized(docs, text, source, key, carry)
    light = sized = cut_lineage(sized) if slim else sized
    if not slim:
        light = cut_lineage(sized.select("source", "size", "u"))
    rates = _per_source(_rates(light))
    cuts = _per_source(_cuts(_ranked(light, rates), rates))
    rows = _ranked(sized, rates).join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return rows.withColumn("copies", F.col("whole") + F.when(F.coalesce((F.col("z") < 1) & (F.col("z") <= F.col("last")), F.lit(False)), 1).otherwise(0))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (default: all) with size, source_size, target, expected (copies before
    the draw), copies and taken (words taken, copies counted)."""
    new = ["size", "source_size", "target", "expected", "copies", "taken"]
    rest = [c for c in (docs.columns if carry is None else carry) if c not in new]
    rows = _mixed(docs, text, source, key, rest, carry is not None and text not in carry)
    expected = F.when(F.col("size") > 0, _expected(F.col("scale"), _preference(F.col("size")))).otherwise(0.0)
    return rows.select(
        *[F.col(f"row.`{c}`").alias(c) for c in rest],
        "size",
        "source_size",
        "target",
        expected.alias("expected"),
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def resampled(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with each row as often as the mix takes it, columns as they are."""
    taken = _mixed(docs, text, source, key, docs.columns, False)
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, size, length(bin(size)) + 4 AS g, u FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS want,
  coalesce(sum(2 * source_size) OVER o, 0)::BIGINT AS capped, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS w_left FROM s
  WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN (want - capped) / w_left <= cap::DOUBLE / w THEN (want - capped) / w_left END) OVER () AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * w) END AS target FROM l),
k AS (SELECT source, g, sum(size)::BIGINT AS in_class FROM d GROUP BY source, g),
o AS (SELECT k.*, t.source_size, t.target, coalesce(sum(in_class) OVER a, 0)::BIGINT AS taken_before, (sum(in_class * g) OVER (PARTITION BY k.source) - coalesce(sum(in_class * g) OVER a, 0))::BIGINT AS open
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WINDOW a AS (PARTITION BY k.source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, coalesce(max(CASE WHEN open > 0 AND (target - 2 * taken_before) / open * g <= 2 THEN (target - 2 * taken_before) / open END) OVER (PARTITION BY source), 2.0) AS scale FROM o),
r AS (SELECT source, any_value(source_size) AS source_size, any_value(target) AS target, any_value(scale) AS scale,
  greatest(any_value(target) - sum(floor(least(2.0, scale * g))::BIGINT * in_class)::BIGINT, 0.0) AS rest FROM f GROUP BY source),
e AS (SELECT d.doc_id, d.source, d.size, d.u, r.* EXCLUDE (source), least(2.0, r.scale * d.g) AS expected FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
p AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p, size > 0 AND rest > 0 AND expected > floor(expected) AS asked FROM e),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM p),
z AS (SELECT *, CASE WHEN asked THEN q / (1 + q) END AS z FROM q),
n AS (SELECT *, sum(CASE WHEN asked THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY z NULLS LAST) AS upto, sum(size) OVER (PARTITION BY source, z) AS peers FROM z),
m AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN asked AND upto - peers / 2.0 <= rest THEN 1 ELSE 0 END END AS copies FROM n)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN expected ELSE 0.0 END AS expected, copies::INT AS copies, (copies * size)::BIGINT AS taken FROM m
"""
