"""Tables that iterations start anew from."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of at most this many rows and bytes (told as JSON) are broadcast; larger ones are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def _checkpoint_dir(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the folder that ``spark.checkpoint.dir`` names, which outlives lost executors.

    Where that is unset, a folder of our own if Spark runs in one process; on a
    cluster that is an error, as executors would not see it.
    """
    _checkpoint_dir(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``settled``, as columns in Parquet: for tables of many narrow rows, which a checkpoint writes one object a row."""
    path = f"{_checkpoint_dir(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over as many tasks as a shuffle has, by ``keys``, ahead of columns that cost or rows that multiply.

    A narrow table of millions of rows may be one small file, and so one task.
    What is grouped by the keys afterwards, or by more columns, is not dealt again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the table's rows and bytes, both counted, are few; as it is where not."""
    rows, size = df.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*df.columns))).cast("long"))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df
