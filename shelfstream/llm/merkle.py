"""Merkle manifest of a table: lag and lead windows over the nodes of each level."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: About so many consecutive nodes share one window; it grows by powers of the run length.
WINDOW_NODES = 256


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' UTF-8 bytes, one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: Iterable[Column]) -> Column:
    """Digest of a row: each value as its bytes' number, a colon and its text; a null as a dash."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with ``pos``, their place from 0 in their group by the columns of ``order``, and ``n``, the group's size.

    Rows are dealt by ranges of (group, order), whatever the groups' sizes,
    and written; a row's place is its place in its range plus the rows of the
    group in the ranges before.
    """
    keys = ["group", *order]
    at = written(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    at = at.withColumn("part", F.shiftright("at", 33))
    parts = at.groupBy("group", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    w = Window.partitionBy("group")
    before = F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("group", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("n"))
    return at.join(small(parts), ["group", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def climbed(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """Nodes (group, pos, n, digest) with ``steps``, their siblings on each of the next levels, and ``top``, their ancestor behind these.

    A level's nodes stand at the first of their rows. Lag and lead columns of
    fixed offsets give their siblings, masked by the node's slot in its run
    and by the run's length; the first child of a run hashes the parent. Each
    row then takes the siblings of its ancestors from the last node before.
    """
    w = Window.partitionBy("group", "block").orderBy("pos")
    pos, n = F.col("pos"), F.col("n")
    rows = nodes.withColumn("block", F.floor(pos / fan**levels)).withColumn("d0", F.col("digest"))
    for j in range(levels):
        step, own = fan**j, F.col(f"d{j}")
        slot = F.floor(pos / step) % fan
        there = F.ceil(n / step) - F.floor(pos / (step * fan)) * fan  # the level's nodes from this run's first on
        node = (pos % step == 0) & (n > step)
        lag = {i: F.when(slot >= i, F.lag(own, i * step).over(w)) for i in range(1, fan)}
        lead = {i: F.when(slot + i < there, F.when(slot + i < fan, F.lead(own, i * step).over(w))) for i in range(1, fan)}
        rows = rows.withColumns({
            "left": F.concat_ws("", *[lag[i] for i in range(fan - 1, 0, -1)]),
            "right": F.concat_ws("", *[lead[i] for i in range(1, fan)]),
        }).withColumns({
            f"s{j}": F.when(node, F.struct("left", "right")),
            f"d{j + 1}": F.when(pos % (step * fan) == 0, F.when(node, digest(own, F.col("right"))).otherwise(own)),
        }).drop("left", "right")
    steps = [F.last(f"s{j}", ignorenulls=True).over(w).alias(f"s{j}") for j in range(levels)]
    top = F.first(f"d{levels}").over(w).alias("top")
    kept = [c for c in rows.columns if c not in {f"s{j}" for j in range(levels)} | {f"d{j}" for j in range(levels + 1)}]
    return rows.select(*kept, *steps, top).withColumn("steps", F.array_compact(F.array(*[f"s{j}" for j in range(levels)]))).drop(*[f"s{j}" for j in range(levels)])


def paths(nodes: DataFrame, fan: int) -> DataFrame:
    """Nodes (group, pos, n, digest) with ``steps``, the siblings on the way to their group's root, and ``top``, that root.

    Windows hold ``WINDOW_NODES`` consecutive nodes; what they give are the
    nodes of the next, much smaller table.
    """
    levels = 1
    while fan ** (levels + 1) <= WINDOW_NODES:
        levels += 1
    return _paths(nodes, fan, levels, nodes.agg(F.max("n")).first()[0] or 0)


def _paths(nodes: DataFrame, fan: int, levels: int, most: int) -> DataFrame:
    span, rows = fan**levels, climbed(nodes, fan, levels)
    if most <= span:
        return rows.drop("block")
    tops = written(rows.where(F.col("pos") % span == 0).select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / span).alias("n"), F.col("top").alias("digest")))
    above = _paths(tops, fan, levels, -(-most // span)).select("group", F.col("pos").alias("block"), F.col("steps").alias("more"), F.col("top").alias("root"))
    joined = rows.drop("top").join(small(above), ["group", "block"])
    return joined.withColumn("steps", F.concat("steps", "more")).withColumnRenamed("root", "top").drop("more", "block")


def folded(steps: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def siblings(steps: Column) -> Column:
    """All siblings of a path, one digest after another."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def merkle_manifest(docs: DataFrame, columns: list[str], group_col: str = "lang", id_col: str = "doc_id", fan: int = 2, also: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, ``leaf``, its group's ``subroot``, ``root``, and ``steps``, its proof.

    A leaf is the digest of the named columns. In each group leaves ascend by
    id (equal ids by leaf); while several nodes are left, every ``fan``
    consecutive ones (the last run: those that are left, even one) become
    their digest. Groups' roots, ordered by group (null first), become one
    root in the same way. Each step has the digests of the run's other nodes
    to the left and to the right. ``also`` names expressions over docs that
    are carried along, such as the leaf of the row as it is found now.

    A null value is a dash, a null group its own group, a null id the first
    of its group; equal rows are separate leaves of equal digest; an empty
    table has no rows. Other columns are not read.
    """
    also = also or {}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("group"),
        F.col(id_col).alias("id"), leaf_of(F.col(c) for c in columns).alias("digest"), *[v.alias(f"also_{k}") for k, v in also.items()],
    )
    own = paths(numbered(rows, ["id", "digest"]), fan).withColumnRenamed("top", "subroot")
    subroots = written(own.where("pos = 0").select(F.col("group").alias("of"), F.col("subroot").alias("digest"), F.lit("").alias("group")))
    roots = paths(numbered(subroots, ["of"]), fan).select(F.col("of").alias("group"), F.col("top").alias("root"), F.col("steps").alias("more"))
    out = own.join(small(roots), "group")
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", F.concat("steps", "more").alias("steps"), *[F.col(f"also_{k}").alias(k) for k in also])
