"""Relations of cues from the driver's tables, in Spark and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions.timecode import div


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 4000 + (F.col("conv_id") * 37) % 1000
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", start.alias("s"))
    return df.select(
        F.col("conv_id").alias("file_id"),
        (F.col("turn") + 1).alias("cue_no"),
        F.col("s").alias("start_ms"),
        (F.col("s") + 1000 + F.length("text") % 3000).alias("end_ms"),
        "text",
    )


def cues_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", micros.alias("us"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    df = df.withColumns({"cue_no": F.row_number().over(w), "start_ms": div(F.col("us") - F.min("us").over(Window.partitionBy("user_id")), 1000)})
    end = F.coalesce(F.lead("start_ms").over(Window.partitionBy("user_id").orderBy("cue_no")), F.col("start_ms") + 1000)
    return df.select(F.col("user_id").alias("file_id"), F.col("cue_no").cast("long").alias("cue_no"), "start_ms", end.alias("end_ms"), F.col("event_type").alias("text"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("p", "line")).select("file_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def cues_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cue a line; every seventh is an ellipsis mark."""
    df = doc_lines(spark, sf_dir)
    return df.select("file_id", F.col("line_no").alias("cue_no"), (F.col("line_no") * 2000).alias("start_ms"), (F.col("line_no") * 2000 + 2000).alias("end_ms"), F.when(F.col("line_no") % 7 == 0, "...").otherwise(F.col("line")).alias("text"))


def cues_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML of pages with tags of every class and misspelling put in."""
    marked = F.concat(
        F.lit('{ \\an8 }< i >'), F.substring("html", 1, 40), F.lit('</ i><FONT COLOR = "#ff0000">'), F.substring("html", 41, 200), F.lit("< /font ><U>x</u ><s>"), F.substring("html", F.lit(241), F.length("html"))
    )
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.lit(1).cast("long").alias("cue_no"), F.lit(0).cast("long").alias("start_ms"), F.lit(1000).cast("long").alias("end_ms"), marked.alias("text"))


SQL = {
    "cues_conv": "SELECT conv_id AS file_id, turn + 1 AS cue_no, turn * 4000 + (conv_id * 37) % 1000 AS start_ms, turn * 4000 + (conv_id * 37) % 1000 + 1000 + length(text) % 3000 AS end_ms, text FROM conversations",
    "cues_events": "SELECT file_id, cue_no, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY file_id ORDER BY cue_no), start_ms + 1000) AS end_ms, text FROM (SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cue_no, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS start_ms, event_type AS text FROM events)",
    "doc_lines": "SELECT doc_id AS file_id, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)",
    "cues_docs": "SELECT file_id, line_no AS cue_no, line_no * 2000 AS start_ms, line_no * 2000 + 2000 AS end_ms, CASE WHEN line_no % 7 = 0 THEN '...' ELSE line END AS text FROM doc_lines",
    "cues_pages": "SELECT page_id AS file_id, 1::BIGINT AS cue_no, 0::BIGINT AS start_ms, 1000::BIGINT AS end_ms, '{ \\an8 }< i >' || substr(html, 1, 40) || '</ i><FONT COLOR = \"#ff0000\">' || substr(html, 41, 200) || '< /font ><U>x</u ><s>' || substr(html, 241) AS text FROM pages",
}


def with_adapters(sql: str) -> str:
    """sql, with the adapters it names in front."""
    used = [n for n in SQL if n in sql]
    if "cues_docs" in used and "doc_lines" not in used:
        used.insert(used.index("cues_docs"), "doc_lines")
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    if not head:
        return sql
    return f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"
