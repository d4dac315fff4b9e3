"""Latest rows, top rows, running sums, gates and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import settled, small


def _cols(keys) -> list:
    return [keys] if isinstance(keys, (str, Column)) else list(keys)


def ranked(df: DataFrame, keys, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*_cols(keys)).orderBy(*order)))


def top(df: DataFrame, keys, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark keeps no more than n a key in each task."""
    return ranked(df, keys, order, "_rank").where(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, keys, by: list[str]) -> DataFrame:
    """The row of each key with the largest values of ``by``, by an aggregate that combines before the shuffle."""
    keys = _cols(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")).select(*keys, "_row.*")


def running(df: DataFrame, keys, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the sum of a whole number over the rows of a key up to and with this one, in order.

    No key is one task: rows are dealt by ranges of (keys, order), counted in
    each range, and shifted by what the key has in the ranges before. ``order``
    must tell a key's rows apart for the sums to be determined.
    """
    keys, names = _cols(keys), list(sums)
    rows = df.withColumns({f"_v{i}": sums[n].cast("long") for i, n in enumerate(names)})
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    at = settled(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    within = W.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    at_part = at.groupBy(*keys, "_part").agg(*[F.sum(f"_v{i}").alias(f"_p{i}") for i in range(len(names))])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = at_part.select(*[F.col(k).alias(f"_k{j}") if isinstance(k, str) else k.alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_part").alias("_in"), *[F.coalesce(F.sum(f"_p{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(names))])
    at = at.withColumns({f"_v{i}": F.sum(f"_v{i}").over(within) for i in range(len(names))})
    same = F.col("_part") == F.col("_in")
    for j, k in enumerate(keys):
        same &= (F.col(k) if isinstance(k, str) else k).eqNullSafe(F.col(f"_k{j}"))
    out = at.join(small(shift), same)
    return out.withColumns({n: F.col(f"_v{i}") + F.col(f"_s{i}") for i, n in enumerate(names)}).select(*df.columns, *names)


def places(df: DataFrame, keys, order: list, name: str = "rank") -> DataFrame:
    """Adds each row's place in its key, from 1, without a key being one task (see ``running``)."""
    return running(df, keys, order, {name: F.lit(1)})


def gate(df: DataFrame, keys, order: list, limit: Column) -> DataFrame:
    """Adds ``accepted``: the first ``limit`` rows of each key in order; a null limit accepts all."""
    out = places(df, keys, order, "_n")
    return out.withColumn("accepted", limit.isNull() | (F.col("_n") <= limit)).drop("_n")


def page(df: DataFrame, keys, order: list, number: int, size: int) -> DataFrame:
    """Rows of one page of each key; a number beyond the last page gives the last."""
    keys = _cols(keys)
    whole = W.partitionBy(*keys)
    out = ranked(df, keys, order).withColumn("_pages", F.greatest(F.ceil(F.count("*").over(whole) / size), F.lit(1)))
    at = F.least(F.lit(max(1, number)), F.col("_pages"))
    return out.where((F.col("rank") > (at - 1) * size) & (F.col("rank") <= at * size)).drop("_pages")
