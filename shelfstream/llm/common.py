"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"
#: Tables of at most this many rows and bytes (told as JSON) are broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``.

    Where that is unset, one of our own if Spark runs in one process (as in
    tests); on a cluster that is an error, as executors would not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again.

    Cuts the lineage at a table that outlives lost executors.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows of a narrow table, kept in the shared folder in as few files as their size asks for."""
    shared_dir(df.sparkSession)
    return df.hint("rebalance").checkpoint(eager=True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the table's rows and bytes, both counted, are few; as it is where not."""
    rows, size = df.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*df.columns))).cast("long"))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df
