"""Sharding by jump consistent hashing, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts into which a shard's rows are numbered side by side.
SLOT_PARTS = 256

#: Fixed values of the generator of jump consistent hashing: 64-bit factor, in halves.
FACTOR = 2862933555777941757
F_HI, F_LO = FACTOR >> 32, FACTOR & 0xFFFFFFFF


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(state * FACTOR + 1) mod 2**64 in halves of 32 bits; no step exceeds 52 bits."""
    m16, m32 = F.lit(0xFFFF), F.lit(0xFFFFFFFF)
    l1, l0 = F.shiftright(lo, 16), lo.bitwiseAND(m16)
    h1, h0 = F.shiftright(hi, 16), hi.bitwiseAND(m16)
    t0, t1 = l0 * F.lit(F_LO), l1 * F.lit(F_LO)
    low = t0.bitwiseAND(m32) + F.shiftleft(t1.bitwiseAND(m16), 16) + F.lit(1)

    def product(a1: Column, a0: Column, c: int) -> Column:
        return a0 * F.lit(c) + F.shiftleft((a1 * F.lit(c)).bitwiseAND(m16), 16)

    high = F.shiftright(low, 32) + F.shiftright(t0, 32) + F.shiftright(t1, 16) + product(h1, h0, F_LO) + product(l1, l0, F_HI)
    return high.bitwiseAND(m32), low.bitwiseAND(m32)


def jump_hash(key: Column, shards: int, most: int) -> tuple[Column, Column]:
    """The key's shard among ``shards``, and among ``most`` (>= shards), from one walk.

    Each jump goes to a later shard, so ``most`` steps end every walk; further
    steps change nothing.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"),
        zero.alias("a"),
        zero.alias("b"),
        zero.alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next_state(s["hi"], s["lo"])
        a = F.when(s["j"] < shards, s["j"]).otherwise(s["a"])
        b = F.when(s["j"] < most, s["j"]).otherwise(s["b"])
        scale = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")
        jump = F.floor((b + F.lit(1)).cast("double") * scale)
        return F.struct(hi.alias("hi"), lo.alias("lo"), a.alias("a"), b.alias("b"), F.when(s["j"] < most, jump).otherwise(s["j"]).alias("j"))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)
    return walk["a"], walk["b"]


def with_shards(docs: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """The rows with ``shard`` and ``grown_shard`` (with one shard more); a null id hashes as 0. Columns that have
    these names are replaced. Nothing is shuffled."""
    shard, grown = jump_hash(F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), shards, shards + 1)
    return docs.withColumns({"shard": shard.cast("int"), "grown_shard": grown.cast("int")})


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard by its id alone and number the shard's rows from 0.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law ('key'), shard,
    slot, grown_shard (with one shard more, which takes rows only into
    itself). A null text counts as empty. A null id hashes as 0 and is
    numbered first. Repeated rows go to the same shard and get slots of their
    own. An empty table gives no rows; other columns are not read.

    A shard's rows are numbered in parts (id mod SLOT_PARTS), each behind the
    rows of the parts before it, so no task sees a whole shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce("doc_id", F.lit(0).cast("long"))
    rows = with_shards(rows, shards).withColumn("part", F.pmod(key, F.lit(SLOT_PARTS)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most shards * SLOT_PARTS rows
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    numbered = rows.withColumn("row", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("row")).cast("long").alias("slot"), "grown_shard"
    )
