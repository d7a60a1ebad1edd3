"""What several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is evaluated once a row.

    The optimizer may copy an expression into every place that refers to it, a lambda's body
    among them; a variable of a lambda is never copied.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD_RE})")), F.lit(0)).cast("long")


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one is made only where Spark runs on one machine."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="cueloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a few numbers, and rows with a text's hashes, in one part of a relation whose rows are few.
NARROW, WIDE = 50_000, 500


def packed(df: DataFrame, rows: int, each: int = NARROW) -> DataFrame:
    """df, of so many rows about, in a part for `each` of them, but no fewer parts than cores and no more than it has.

    Every shuffle deals to spark.sql.shuffle.partitions, and a task costs some kB of files and log even if it has no row. Parts are
    put together as they are, without a shuffle; where rows are many, nothing changes.
    """
    return df.coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder's path below the shared folder."""
    return f"{_shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key is hot from one in so many of the rows on.
HOT_SHARE = 1000


def join_by_key(rows: DataFrame, table: DataFrame, key: list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined with table, which has one row a key and in column n how many of the rows, total in all, have it.

    Keys of more than a HOT_SHARE-th of the rows are fewer than HOT_SHARE, so their rows of table are broadcast,
    and no task of the join by shuffle gets more rows of one key than that share. rows should be cheap to read twice.
    """
    hot = F.broadcast(table.filter(F.col(n) * HOT_SHARE > total))
    cold = table.filter(F.col(n) * HOT_SHARE <= total)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


def spread(rows: DataFrame, table: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """rows, total in all, joined with table, which has one row a key that may be large. A key of more than a HOT_SHARE-th of the rows is cut into
    parts by the column by, and its row of table is copied to each: HOT_SHARE copies and one a key more at most in all.

    What is broadcast is the number of parts of each hot key. rows should be cheap to read twice.
    """
    counts = cut_lineage(packed(rows.groupBy(key).agg(F.count("*").alias("__n")), total))
    parts = F.broadcast(counts.filter(F.col("__n") * HOT_SHARE > total).select(key, F.ceil(F.col("__n") * HOT_SHARE / F.lit(total)).cast("long").alias("__parts")))
    of = F.coalesce("__parts", F.lit(1).cast("long"))
    dealt = rows.join(parts, key, "left").withColumn("__part", F.pmod(F.xxhash64(by), of)).drop("__parts")
    copies = table.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), of - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"]).drop("__part")
