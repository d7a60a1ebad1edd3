"""Windows over ranges of a file, for files too large for one task.

A file is cut into ranges of an order; a range is a task's share at most. What a row needs of the rows before its range
are few numbers: the last row before, or a sum over all ranges before. Both come from one row a range: edge rows and
sums are found by grouping, windows of a file see one row a range, and their results are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cues of a range, where the number of a cue decides, and milliseconds, where its time does.
CUES, SPAN = 50_000, 600_000


def by_number(column: str = "cue_no", size: int = CUES) -> Column:
    """The range of a number; nulls are a range before all."""
    return F.coalesce(F.call_function("div", F.col(column).cast("long"), F.lit(size).cast("long")), F.lit(-(1 << 62)).cast("long"))


def with_previous(rows: DataFrame, previous: dict[str, Column | str], range_: Column, order: str = "cue_no", file: str = "file_id") -> DataFrame:
    """rows with columns of the row before in the file, as lag() over the file would give them. Ranges follow each other in the order."""
    ranged = rows.withColumn("__range", range_)
    value = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in previous.items()])
    edges = ranged.groupBy(file, "__range").agg(F.max_by(value, order).alias("__edge"))
    edges = edges.withColumn("__before", F.lag("__edge").over(Window.partitionBy(file).orderBy("__range"))).drop("__edge")
    within = Window.partitionBy(file, "__range").orderBy(order)
    inside = ranged.withColumn("__inside", F.lag(value).over(within)).withColumn("__first", F.row_number().over(within) == 1)
    both = inside.join(edges, [file, "__range"]).withColumn("__p", F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__inside")))
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__p.`{name}`").alias(name) for name in previous])


def running_sum(rows: DataFrame, value: Column, name: str, range_: Column, order: list[str], file: str = "file_id") -> DataFrame:
    """rows with the sum of a value up to and with each row of a file, in an order of which the range is the first part."""
    ranged = rows.withColumns({"__range": range_, "__value": value})
    sums = ranged.groupBy(file, "__range").agg(F.sum("__value").alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(file).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    within = Window.partitionBy(file, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = ranged.withColumn("__here", F.sum("__value").over(within)).join(sums, [file, "__range"])
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__before") + F.col("__here")).alias(name))
