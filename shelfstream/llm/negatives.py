"""Hard negatives by a vertical scan: dimensions are read in the order of an anchor's magnitudes until bounds settle the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, written

#: Rows of a block, and anchors that meet a block at once; fewer where vectors are long.
BLOCK_ROWS, BLOCK_ANCHORS, BLOCK_NUMBERS = 4096, 4096, 1 << 20
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Components of this size and above are an error: sums of products must stay 64-bit integers.
LIMIT = 1 << 26

_FOUND = "anchor_id long, place int, other_id long, score long"


def vertical_scan(m: np.ndarray, a: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, survivors: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``rows`` that ``survivors`` leaves, and their exact inner products with ``a``.

    ``m`` is columnar, one line a dimension. Lines are read in descending
    magnitude of the anchor's component, a few at a time. What the lines
    still unread may add lies between sums of ``low`` and ``high`` values
    times the component; ``survivors(least, most, totals)`` tells from these
    bounds which candidates stay, or None if they can't rule out any.
    """
    order = np.argsort(-np.abs(a), kind="stable")[: np.count_nonzero(a)]
    ends = np.stack([a[order] * low[order], a[order] * high[order]])
    least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
    most = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
    total = np.zeros(len(rows), dtype=m.dtype)
    for start in range(0, len(order), STEP):
        if not len(rows):
            break
        lines = order[start : start + STEP]
        part = m[lines] if len(rows) == m.shape[1] else m[np.ix_(lines, rows)]
        total = total + a[lines] @ part
        end = start + len(lines)
        if end < len(order) and (keep := survivors(least[end], most[end], total)) is not None:
            rows, total = rows[keep], total[keep]
    return rows, total


def best_of(k: int) -> Callable:
    """Survivors among which are the k largest totals and all that tie with them."""

    def survivors(least, most, total):
        if len(total) <= k or most - least >= total.max() - total.min():
            return None
        return total + most >= np.partition(total, len(total) - k)[len(total) - k] + least

    return survivors


def best_in(windows: list[tuple[int, int]], k: int) -> Callable:
    """Survivors among which are the k largest totals of each window of scores and all that tie with them."""
    first, last = min(x for x, _ in windows), max(y for _, y in windows)

    def survivors(least, most, total):
        small, large = total.min(), total.max()
        if small + most >= first and large + least <= last and most - least >= large - small:
            return None
        keep = np.zeros(len(total), dtype=bool)
        for lo, hi in windows:
            possible = (total + most >= lo) & (total + least <= hi)
            sure = total[(total + least >= lo) & (total + most <= hi)]
            if len(sure) > k:
                possible &= total + most >= np.partition(sure, len(sure) - k)[len(sure) - k] + least
            keep |= possible
        return keep

    return survivors


def first_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


class Block:
    """Rows of a block in the order of their labels, their components by dimension."""

    def __init__(self, packed: pa.ListScalar, dims: int):
        ids, labels, vectors = packed.values.flatten()[:3]
        label = labels.to_numpy()
        order = np.argsort(label, kind="stable")
        self.ids, self.label = ids.to_numpy()[order], label[order]
        self.m = np.ascontiguousarray(_matrix(vectors, dims)[order].T)
        self.low, self.high = self.m.min(axis=1), self.m.max(axis=1)
        self.bounds: dict = {}

    def of(self, label) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))

    def bounds_of(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, j) not in self.bounds:
            self.bounds[i, j] = self.m[:, i:j].min(axis=1), self.m[:, i:j].max(axis=1)
        return self.bounds[i, j]


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as lines of whole numbers, padded with zeros; doubles where these hold every possible sum exactly."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy().astype(np.int64)
    if len(sizes) and (sizes == dims).all():
        m = flat.reshape(len(sizes), dims)
    else:
        m = np.zeros((len(sizes), dims), dtype=np.int64)
        m[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return m


def _exact(block: Block, anchors: np.ndarray, dims: int) -> np.ndarray:
    """The anchors, and the block with them, as doubles if no sum can pass 2**53."""
    if dims * float(np.abs(anchors).max(initial=0)) * float(np.abs(block.m).max(initial=0)) < 2.0**53:
        for name in ("m", "low", "high"):
            setattr(block, name, getattr(block, name).astype(np.float64))
        return anchors.astype(np.float64)
    return anchors


def positives_in(block: Block, anchor_id: int, label: int, a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's first k other rows of its label in the block, and their scores."""
    i, j = block.of(label)
    if i == j:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    rows = np.arange(i, j)
    rows, total = vertical_scan(block.m, a, rows[block.ids[rows] != anchor_id], *block.bounds_of(i, j), best_of(k))
    best = first_k(block.ids[rows], total, k)
    return block.ids[rows[best]], total[best]


def negatives_in(block: Block, label: int, a: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores the first k rows of other labels in the block, and their scores."""
    i, j = block.of(label)
    rows = np.concatenate([np.arange(i), np.arange(j, len(block.ids))])
    rows, total = vertical_scan(block.m, a, rows, block.low, block.high, best_in(windows, k))
    out = []
    for lo, hi in windows:
        inside = np.flatnonzero((total >= lo) & (total <= hi))
        best = inside[first_k(block.ids[rows[inside]], total[inside], k)]
        out.append((block.ids[rows[best]], total[best]))
    return out


def _prepared(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label and vector in whole numbers of the rows that take part."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(fine)
    whole = F.transform("x", lambda x: F.floor(x * scale))
    beyond = F.exists(whole, lambda x: F.abs(x) >= LIMIT)
    return rows.select("id", "label", F.when(beyond, F.raise_error(F.lit("a component is too large for whole scores"))).otherwise(whole).cast("array<int>").alias("v"))


def _packed(rows: DataFrame, parts: int, columns: list[str], part: str, name: str) -> DataFrame:
    number = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(part)
    return rows.select(number, F.struct(*columns).alias("r")).groupBy(part).agg(F.collect_list("r").alias(name))


def _met(blocks: DataFrame, anchors: DataFrame, parts: int, groups: int, task: Callable) -> DataFrame:
    """What ``task`` finds in each block for each group of anchors; a task has all blocks of a lane for one group."""
    spark = blocks.sparkSession
    lanes = min(parts, max(1, -(-2 * partitions_for(spark) // groups)))
    tasks = 3 * lanes * groups
    left = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("lane", F.col("part") % lanes)
    right = anchors.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    pairs = left.repartition(tasks, "group", "lane").join(right.repartition(tasks, "group", "lane"), ["group", "lane"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                found = task(batch.column(0)[n], batch.column(1)[n])
                if found:
                    anchor, place, other, score = (np.concatenate([f[i] for f in found]) for i in range(4))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(other.astype(np.int64)), pa.array(score.astype(np.int64))], ["anchor_id", "place", "other_id", "score"])

    return pairs.select("rows", "anchors").mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, positive and hard negative.

    Components become floor(scale * x); a score is the whole inner product
    with the anchor, higher ones first, ties by the smaller id. Anchors are
    the rows whose id ``every`` divides. An anchor's positives are its first
    other rows of the same label; for each, the negatives are the first rows
    of other labels whose score is between the window's percents of the
    positive's, both included.

    Rows without id, label or vector or with a null or non-finite component
    take no part. Shorter vectors count as padded with zeros. Repeated rows
    each take part; of rows that share an anchor's id the least (label,
    vector) is the anchor, and none is its positive. A positive score below
    zero has no window. An empty table, or one without anchors, gives no
    rows. Other columns are not read.
    """
    spark = rows.sparkSession
    out_columns = [F.col("anchor_id"), F.col("positive_id"), F.col("rank"), F.col("other_id").alias("negative_id"), F.col("positive_score"), F.col("score").alias("negative_score")]
    data = _prepared(rows, id_col, label_col, vector_col, scale)
    anchor = F.pmod(F.col("id"), F.lit(every)) == 0
    n, n_anchors, dims = data.agg(F.count("*"), F.count_if(anchor), F.max(F.size("v"))).first()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    fit = lambda most: max(16, min(most, BLOCK_NUMBERS // max(1, dims)))
    parts, groups = -(-n // fit(BLOCK_ROWS)), -(-n_anchors // fit(BLOCK_ANCHORS))
    blocks = written(_packed(data, parts, ["id", "label", "v"], "part", "rows"))
    heads = data.where(anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")

    def look_for_positives(block, packed):
        block = Block(block, dims)
        ids, labels, vectors = packed.values.flatten()
        a, out = _exact(block, _matrix(vectors, dims), dims), []
        for i, (anchor_id, label) in enumerate(zip(ids.to_pylist(), labels.to_pylist())):
            other, score = positives_in(block, anchor_id, label, a[i], positives)
            if len(other):
                out.append((np.full(len(other), anchor_id), np.zeros(len(other)), other, score))
        return out

    def look_for_negatives(block, packed):
        block = Block(block, dims)
        ids, labels, vectors, scores = packed.values.flatten()
        a, out = _exact(block, _matrix(vectors, dims), dims), []
        for i, (anchor_id, label, own) in enumerate(zip(ids.to_pylist(), labels.to_pylist(), scores.to_pylist())):
            windows = [(-(-window[0] * s // 100), window[1] * s // 100) for s in own]
            for place, (other, score) in enumerate(negatives_in(block, label, a[i], windows, negatives), 1):
                if len(other):
                    out.append((np.full(len(other), anchor_id), np.full(len(other), place), other, score))
        return out

    found = _met(blocks, _packed(heads, groups, ["id", "label", "v"], "group", "anchors"), parts, groups, look_for_positives)
    near = written(_ranked(found, ["anchor_id"], positives).select(F.col("anchor_id").alias("id"), F.col("rank").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    found = _met(blocks, _packed(heads.join(scores, "id"), groups, ["id", "label", "v", "scores"], "group", "anchors"), parts, groups, look_for_negatives)
    best = _ranked(found, ["anchor_id", "place"], negatives)
    return best.join(near.withColumnRenamed("id", "anchor_id"), ["anchor_id", "place"]).select(*out_columns)
