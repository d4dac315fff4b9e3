"""Mixing sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, small

#: Leading hex digits of a row's seeded digest that make its part of a source.
PART_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of the text; what is left between them is one blank each."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.size(F.split(bare, " ", -1))).cast("long")


def _digest(seed: str, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Targets for (source, source_size, weight) rows, of which there are few.

    Each source's target is its weight's share of all sizes; those above
    max_epochs times their size are clamped there and the excess is dealt to
    the others by weight, until none is above. In order of size over weight
    the clamped sources come first, so that running sums find all of them at
    once; every number but the last quotient is an integer.
    """
    n = max_epochs
    order = W.partitionBy("all").orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("all")
    s = sources.withColumn("all", F.lit(1))
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "weights": F.sum("weight").over(everything),
            "size_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    left, shared = F.col("total") - F.lit(n) * F.col("size_before"), F.col("weights") - F.col("weight_before")
    s = s.withColumns({"left": left, "shared": shared, "clamped": F.col("weight") * left > F.lit(n) * F.col("source_size") * shared})
    # The first source that is not clamped has the largest share of weights left.
    first = F.max(F.when(~F.col("clamped"), F.struct("shared", "left"))).over(everything)
    s = s.withColumn("open", first)
    return s.select(
        "source",
        "source_size",
        F.when(F.col("clamped"), (F.lit(n) * F.col("source_size")).cast("double"))
        .otherwise((F.col("weight") * F.col("open.left")).cast("double") / F.col("open.shared").cast("double"))
        .alias("target"),
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each row, so that sources meet their weights' targets.

    Sources in order of code point, null last, weigh ``weights`` in turn. A
    row for every input row: doc_id, size (words), source, source_size,
    target, repeats, taken (repeats * size). A source is taken whole as often
    as its target holds it, and for the rest its rows are taken once more in
    the order of a seeded digest of their ids until the sum is nearest to the
    target; reruns agree. Null and empty texts have size 0 and repeats of
    whole rounds only. Repeated rows count each. A source without words has
    target 0. An empty table gives no rows; other columns are not read.

    The cut is found from sums of the parts of each source (leading digits of
    the digest), then inside one part only, so no task needs a whole source.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        _digest(seed, F.col(id_col)).alias("digest"),
    )
    rows = rows.withColumn("part", F.substring("digest", 1, PART_DIGITS))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sources = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("rank", rank).withColumn("weight", pick.cast("long"))
    plan = water_fill(sources, max_epochs)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("rounds", rounds.cast("long")).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    # At most 16**PART_DIGITS rows a source: joined to the rows by a shuffle that Spark splits at a hot source.
    deal = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(starts["source"].alias("s"), starts["part"].alias("p"), "start", "source_size", "target", "rounds", "rest")
    inside = W.partitionBy("source", "part").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = numbered.join(deal, (numbered["part"] == deal["p"]) & numbered["source"].eqNullSafe(deal["s"]))
    # One more while more than half of the row still lies below the rest.
    more = (F.col("size") > 0) & (2 * (F.col("start") + F.col("inside")) + F.col("size") <= 2 * F.col("rest"))
    repeats = F.col("rounds") + F.when(more, 1).otherwise(0)
    return out.select("doc_id", "size", "source", "source_size", "target", "rounds", "digest", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row as often as ``mix_sources`` takes it, with all its columns.

    What decides is a source's whole rounds and the last digest taken once
    more, so the texts meet a table of sources only and are not shuffled.
    """
    plan = mix_sources(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    last = F.max(F.when(F.col("repeats") > F.col("rounds"), F.struct(F.col("digest").alias("d"), F.col("doc_id").alias("i"), F.col("size").alias("s"))))
    plan = checkpointed(plan.groupBy(F.col("source").alias("_s")).agg(F.max("rounds").alias("_rounds"), last.alias("_last")))
    own = F.struct(_digest(seed, F.col(id_col)).alias("d"), F.col(id_col).cast("long").alias("i"), word_count(F.col(text_col)).alias("s"))
    last, rounds, copy = F.col("plan._last"), F.col("plan._rounds"), "_copy"
    while copy in docs.columns:
        copy += "_"
    more = last.isNotNull() & (own <= last) & (own["s"] > 0)
    times = (rounds + F.when(more, 1).otherwise(0)).cast("int")
    joined = docs.alias("docs").join(small(plan).alias("plan"), F.col(f"docs.{source_col}").cast("string").eqNullSafe(F.col("plan._s")))
    return joined.select("docs.*", F.explode(F.array_repeat(F.lit(0), times)).alias(copy)).drop(copy)
