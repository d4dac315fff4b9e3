"""Line dedup in column expressions: lines that several documents share stay in the first only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower

#: Keys shorter than this are never dropped.
MIN_CHARS = 10


def _key(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(line, f"^[{SPACE}]+|[{SPACE}]+\\z", ""))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key (stripped, A-Z lower-cased) at least ``min_docs``
    documents hold, except in the smallest id that holds it.

    A row for every input row: doc_id, kept_text, n_lines, n_dropped. A null
    or empty text is one empty line. Rows with a null id take no part and keep
    all lines. Repeated rows are one document: none makes the other lose
    lines, and each comes back. An empty table gives no rows; other columns
    are not read.

    Only hashes and positions of lines are shuffled, never their text: two
    independent hashes of together 96 bits stand for a key. A line that a
    third of the documents hold is counted in each task before the shuffle,
    and the join that hands out the verdict is one that Spark splits at hot
    keys.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"mark": F.xxhash64("text"), "lines": F.split("text", "\n", -1)})
    keyed = rows.where("doc_id IS NOT NULL").select("doc_id", "mark", F.posexplode("lines").alias("pos", "line"))
    keyed = keyed.withColumn("key", _key(F.col("line"))).where(F.length("key") >= min_chars)
    keyed = keyed.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    if min_docs == 2:
        shared = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    else:
        once = keyed.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
        shared = once.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    lost = (
        keyed.join(shared.select("h1", "h2", "first"), ["h1", "h2"])
        .where(F.col("doc_id") != F.col("first"))
        .groupBy("doc_id", "mark")
        .agg(F.collect_set("pos").alias("lost"))
    )
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost")), lambda i: F.element_at(F.col("lines"), i + 1)
    )
    return rows.join(lost, ["doc_id", "mark"], "left").select(
        "doc_id",
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
