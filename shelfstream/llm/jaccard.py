"""N-gram Jaccard join: count-vector R-trees over blocks of documents that share a rare shingle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, written
from .components import components
from .kernels import WordHash, chunks, mix, shingle_sets, slices

#: Groups of a count vector; a count of MOST or more is stored as MOST and bounds nothing.
GROUPS, MOST = 128, 255
#: Cells of the table of shingle counts that orders shingles from rare to frequent; its size does not depend on the data.
CELLS = 1 << 18
#: Documents of a leaf of the R-tree, nodes under an inner node, and documents on either side of a block.
LEAF, FAN, BLOCK_ROWS = 32, 8, 2048
#: Keys of a node by which a pair's first common block is told.
FIRSTS = 16


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, int, int, list[np.ndarray]]]:
    hashes = WordHash(5)
    for batch in slices(batches):
        texts = [(x or "").encode().lower() for x in batch.column(1).to_pylist()]
        for a, b in chunks([len(t) for t in texts]):
            yield batch, a, b, shingle_sets(texts[a:b], k, hashes)


def count_vector(shingles: np.ndarray) -> bytes:
    return np.minimum(np.bincount((shingles >> np.uint64(57)).astype(np.int64), minlength=GROUPS), MOST).astype(np.uint8).tobytes()


def _vectors(column: pa.Array) -> np.ndarray:
    v = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, GROUPS).astype(np.int32)
    v[v == MOST] = 1 << 24
    return v


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all documents fall into each of CELLS cells; a table of fixed size."""
    pieces = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for _, _, _, sets in _sets(batches, k):
            whole = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            total += np.bincount((whole & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        parts = [x.tobytes() for x in total.reshape(pieces, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(x.as_buffer(), dtype=np.int64)
                totals[part] = totals[part] + more if part in totals else more
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["part", "counts"])

    kind = "part int, counts binary"
    rows = docs.mapInArrow(count, kind).repartition(pieces, "part").mapInArrow(add, kind).collect()
    out = np.zeros((pieces, CELLS // pieces), dtype=np.int64)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return out.ravel()


def sample_limit(num: int, den: int) -> int:
    """Shingles whose top 32 bits are below this are sampled: 1.7 times the share in which two linked sets may differ."""
    return min(1 << 32, int((1 << 32) * 1.7 * (den - num) / den) + 1)


def signatures(docs: DataFrame, k: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """(doc, n, d1, d2, sample): set size, digest of the set, and its sampled shingles.

    Whether a shingle is sampled depends on the shingle alone, and those of
    crowded cells never are. Of equal sets in one task the first carries the
    sample.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts > 16 * max(1, int(counts.mean())))
    limit = np.uint64(sample_limit(num, den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded, seen = sent.value, set()
        for batch, a, b, sets in _sets(batches, k):
            d1, d2, sample = [], [], []
            for s in sets:
                d1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                d2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                if (d1[-1], d2[-1]) in seen:
                    s = s[:0]
                seen.add((d1[-1], d2[-1]))
                s = s[(s >> np.uint64(32)) < limit]
                sample.append(s[~crowded[(s & np.uint64(CELLS - 1)).astype(np.int64)]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sample, pa.list_(pa.int64()))],
                ["doc", "n", "d1", "d2", "sample"],
            )

    return docs.mapInArrow(run, "doc long, n long, d1 long, d2 long, sample array<long>")


def shared_samples(rows: DataFrame) -> DataFrame:
    """(d1, n) how many sampled shingles of each set another set holds, per task, from (key, d1) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, True  # the row before, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, d1 = (batch.column(i).to_numpy() for i in range(2))
            if last is not None:
                key, d1 = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], d1])
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (d1[1:] != d1[:-1])))  # copies of one set count once
            key, d1 = key[new], d1[new]
            same = key[1:] == key[:-1]
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            if last is not None:
                end = bool(shared[0]) or told if len(key) == 1 else bool(shared[-1])
                shared[0] = shared[0] and not told
                told = end if len(key) > 1 else told or bool(shared[0])
            else:
                told = bool(shared[-1])
            last = (key[-1], d1[-1])
            sets, n = np.unique(d1[shared], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array(n.astype(np.int64))], ["d1", "n"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "d1")
    return dealt.mapInArrow(run, "d1 long, n long")


def viable_sets(signs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The distinct sets (n, d1, d2, node) and, of these, the nodes that may be linked at all.

    A sampled shingle that no other set holds is missing from every partner;
    a set with more of them than n - ceil(n * num / den) has no partner.
    """
    held = signs.where("n > 0 AND doc IS NOT NULL")
    shared = shared_samples(held.select(F.explode("sample").alias("key"), "d1")).groupBy("d1").agg(F.sum("n").alias("shared"))
    sets = held.groupBy("n", "d1", "d2").agg(F.min("doc").alias("node"), F.max(F.size("sample")).alias("sampled"))
    sets = written(sets.join(shared, "d1", "left").withColumn("single", F.col("sampled") - F.coalesce("shared", F.lit(0))))
    spare = F.col("n") - F.ceil(F.col("n") * num / den)
    return sets.select("n", "d1", "d2", "node"), sets.where(F.col("single") <= spare).select("node").distinct()


def shared_keys(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(key, node, n, leader) of the keys that several nodes hold, from (key, node, n) rows.

    A leader is the first node, in order of size, whose set is not too small
    to match. Rows of a key stream past one leader, however many they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (key, node, n, leader, leader's n, told)

        def scan(key, node, n, last):
            if last is not None:  # the row before stands in front
                key, node, n = (np.concatenate([[last[i]], x]) for i, x in enumerate((key, node, n)))
            same = key[1:] == key[:-1]
            start = np.concatenate(([True], ~same))
            lead = np.zeros(len(key), dtype=np.int64)
            multi = np.flatnonzero(np.concatenate((same, [False])) | ~start)
            lead[start] = np.flatnonzero(start)
            lead = np.maximum.accumulate(lead)
            first_lead = None
            if last is not None:
                first_lead = (last[3], last[4])
            leader, size = node[lead].copy(), n[lead].copy()
            if first_lead is not None:
                run0 = lead == 0
                leader[run0], size[run0] = first_lead
            # A set too large for the leader's starts a new one within its key.
            far = np.flatnonzero(size * den < n * num)
            while len(far):
                i = far[0]
                end = i + int(np.argmax(np.concatenate((start[i + 1 :], [True])))) + 1
                leader[i:end], size[i:end] = node[i], n[i]
                far = np.flatnonzero(size * den < n * num)
            keep = np.zeros(len(key), dtype=bool)
            keep[multi] = True
            tail_told = bool(keep[-1])
            if last is not None:
                keep[0] = keep[0] and not last[5]
                tail_told = tail_told or len(key) == 1 and last[5]
            new_last = (key[-1], node[-1], n[-1], leader[-1], size[-1], tail_told)
            cols = [c[keep] for c in (key, node, n, leader)]
            return cols, new_last

        for batch in batches:
            if not batch.num_rows:
                continue
            cols, last = scan(*(batch.column(i).to_numpy() for i in range(3)), last)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "node", "n", "leader"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "n", "node")
    return dealt.mapInArrow(run, "key long, node long, n long, leader long")


def node_sets(docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """(node, n, vector, shingles, keys) of the given nodes: count vector, shingles, and the rarest of them.

    Two sets with intersection/union >= num/den share at least one of the
    first n - ceil(n * num / den) + 1 shingles in any common order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for batch, a, b, sets in _sets(batches, k):
            keys = []
            for s in sets:
                rank = order[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                keys.append(s[np.lexsort((s, rank))[: len(s) - -(-len(s) * num // den) + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([count_vector(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                ["node", "n", "vector", "shingles", "keys"],
            )

    wanted = docs.join(small(nodes.select(F.col("node").alias("doc"))), "doc", "left_semi")
    return wanted.mapInArrow(run, "node long, n long, vector binary, shingles array<long>, keys array<long>")


def possible(pairs: DataFrame, vectors: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs whose count vectors' summed minima reach num / (num + den) of both sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = np.minimum(_vectors(batch.column(4)), _vectors(batch.column(5))).sum(axis=1)
                sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(both * (num + den) >= num * sizes)))

    x = vectors.withColumnsRenamed({"node": "a", "n": "n_a", "vector": "v_a"})
    y = vectors.withColumnsRenamed({"node": "b", "n": "n_b", "vector": "v_b"})
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "v_a", "v_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs whose sets have den * intersection >= num * union."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.where(F.col("both") * (num + den) >= num * (F.col("n") + F.col("m"))).select("a", "b")


class CountTree:
    """R-tree over count vectors: leaves of LEAF points in order of size and first coordinates, FAN nodes under each inner one.

    A node keeps the least and greatest size below it and the upper corner of its box.
    """

    def __init__(self, n: np.ndarray, vectors: np.ndarray, rows: np.ndarray):
        self.rows = rows[np.lexsort((vectors[rows, 1], vectors[rows, 0], n[rows]))]
        low = high = n[self.rows]
        top, step, self.levels = vectors[self.rows], LEAF, []
        while True:
            at = np.arange(0, len(low), step)
            low, high, top = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(top, at, axis=0)
            self.levels.append((low, high, top))
            if len(at) == 1:
                break
            step = FAN

    def leaf(self, i: int) -> np.ndarray:
        return self.rows[i * LEAF : (i + 1) * LEAF]


def _near(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of nodes of two levels below which points may match."""
    keep = (x[1][i] * den >= y[0][j] * num) & (y[1][j] * den >= x[0][i] * num)
    i, j = i[keep], j[keep]
    keep = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), 4096):
        a, b = i[k : k + 4096], j[k : k + 4096]
        keep[k : k + 4096] = np.minimum(x[2][a], y[2][b]).sum(axis=1) * (num + den) >= num * (x[0][a] + y[0][b])
    return i[keep], j[keep]


def _children(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each i replaced by its FAN children on the level of this size, beside its j."""
    i, j = (i[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(j, FAN)
    return i[i < size], j[i < size]


def tree_pairs(n: np.ndarray, vectors: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (row of left, row of right) whose sets may reach num/den, and the bound of their similarity, by pairs of leaves.

    Two R-trees over the count vectors are descended together. The sum of the
    smaller coordinates of two points, or of the upper corners of two nodes,
    bounds the intersection; it must reach num / (num + den) of both sizes.
    """
    if not len(left) or not len(right):
        return
    a, b = CountTree(n, vectors, left), CountTree(n, vectors, right)
    p, q = len(a.levels) - 1, len(b.levels) - 1
    i = j = np.zeros(1, dtype=np.int64)
    while True:
        i, j = _near(a.levels[p], b.levels[q], i, j, num, den)
        if not p and not q:
            break
        if p >= q:
            p -= 1
            i, j = _children(i, j, len(a.levels[p][0]))
        else:
            q -= 1
            j, i = _children(j, i, len(b.levels[q][0]))
    for k, m in zip(i, j):
        x, y = a.leaf(k), b.leaf(m)
        both = np.minimum(vectors[x][:, None, :], vectors[y][None, :, :]).sum(axis=2)
        sizes = n[x][:, None] + n[y][None, :]
        u, v = np.nonzero(both * (num + den) >= num * sizes)
        yield x[u], y[v], both[u, v] / sizes[u, v]


def spanning(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of pairs (x, y) that make up a spanning forest, each tree's heaviest way out first."""
    names, flat = np.unique(np.concatenate((x, y)), return_inverse=True)
    label, open_ = np.arange(len(names)), np.arange(len(x))
    x, y, taken = flat[: len(x)], flat[len(x) :], []
    order = np.lexsort((y, x, -weight))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    while True:
        open_ = open_[label[x[open_]] != label[y[open_]]]
        if not len(open_):
            return np.concatenate(taken) if taken else open_
        best = np.full(len(names), len(rank))
        for end in (x, y):
            np.minimum.at(best, label[end[open_]], rank[open_])
        picked = order[np.unique(best[best < len(rank)])]
        taken.append(picked)
        u, v = label[x[picked]], label[y[picked]]
        root = np.arange(len(names))
        while True:  # the picked pairs hang together in trees; all take the least label
            least = np.minimum(root[u], root[v])
            before = root.copy()
            np.minimum.at(root, u, least)
            np.minimum.at(root, v, least)
            root = root[root]
            if (root == before).all():
                break
        label = root[label]


def open_pairs(blocks: DataFrame, comps: DataFrame, vectors: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """(a, b) pairs of different components that share a key and that the R-tree does not exclude: all of them, or of
    each block only a spanning forest over its components, the likeliest pairs first.

    Keys of two nodes were settled with their leader, and keys whose nodes are
    all linked fall away; of keys with the same nodes one stays. What is left
    of a key is its largest component against the others, and these among
    themselves: never the largest within itself. Sides beyond BLOCK_ROWS nodes are split, each pair of
    parts is a block. A pair of several keys is left to the least of them where
    that is among the first FIRSTS of both nodes.
    """
    rows = blocks.select("key", "node").join(comps.select("node", "component"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    keys = rows.groupBy("key", "comp").agg(F.count("*").alias("n"), *marks)
    keys = keys.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), *[F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(2)])
    keys = keys.where("size > 2 AND size > main.n").groupBy("size", "x0", "x1").agg(F.min(F.struct("key", "main")).alias("k"))
    parts = lambda n: F.greatest(F.ceil(n / BLOCK_ROWS), F.lit(1)).cast("int")
    keys = checkpointed(keys.select("k.key", F.col("k.main.comp").alias("main"), parts(F.col("k.main.n")).alias("mains"), parts(F.col("size") - F.col("k.main.n")).alias("others")))
    held = rows.join(keys, "key").withColumn("in_main", F.col("comp") == F.col("main"))
    held = held.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    block = lambda kind, p, q: F.xxhash64("key", F.lit(kind), p, q).alias("block")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    cross = lambda p, q, left: F.struct(block(0, p, q), F.lit(left).alias("left"), (p == 0).alias("own"))
    of_main = F.transform(every(F.col("others")), lambda q: cross(F.col("part"), q, True))
    of_rest = F.concat(
        F.transform(every(F.col("mains")), lambda p: cross(p, F.col("part"), False)),
        F.transform(
            F.filter(every(F.col("others")), lambda q: q != F.col("part")),
            lambda q: F.struct(block(1, F.least(q, F.col("part")), F.greatest(q, F.col("part"))), (F.col("part") < q).alias("left"), F.lit(False).alias("own")),
        ),
    )
    first = held.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRSTS).alias("firsts"))
    split = held.select("key", "node", "comp", F.inline(F.when(F.col("in_main"), of_main).otherwise(of_rest)))
    split = split.join(vectors.join(first, "node"), "node").select("block", "key", "left", "own", "node", "comp", "n", "vector", "firsts")

    def search(key, left, own, node, comp, n, vectors, firsts):
        rows = np.arange(len(node))
        a, b = rows[left], rows[~left]
        found = list(tree_pairs(n, vectors, a, b, num, den)) + (list(tree_pairs(n, vectors, b, b, num, den)) if own.any() else [])
        if not found:
            return None
        x, y, bound = (np.concatenate(c) for c in zip(*found))
        keep = (comp[x] != comp[y]) & (left[x] | left[y] | (node[x] < node[y]))
        x, y, bound = x[keep], y[keep], bound[keep]
        keep = np.ones(len(x), dtype=bool)
        for i in range(0, len(x), 4096):
            f, g = firsts[x[i : i + 4096]], firsts[y[i : i + 4096]]
            keep[i : i + 4096] = ~((f[:, :, None] == g[:, None, :]) & (f < key[0])[:, :, None]).any(axis=(1, 2))
        x, y, bound = x[keep], y[keep], bound[keep]
        if forest and len(x):
            taken = spanning(comp[x], comp[y], bound)
            x, y = x[taken], y[taken]
        return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_none(batches):
            if batch is not None and batch.num_rows:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest is None or batch is not None and not batch.num_rows:
                continue
            block = rest.column(0).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            done = len(block) if batch is None else edges[-2]
            if not done:
                continue
            cols = [rest.column(i).slice(0, done).to_numpy() for i in range(1, 7)]
            vectors = _vectors(rest.column(7).slice(0, done))
            firsts = np.full((done, FIRSTS), np.iinfo(np.int64).max)
            for i, x in enumerate(rest.column(8).slice(0, done).to_pylist()):
                firsts[i, : len(x)] = x
            found = [search(*(c[i:j] for c in (*cols, vectors, firsts))) for i, j in zip(edges[:-1], edges[1:]) if j <= done and j - i > 1]
            found = [f for f in found if f is not None and len(f[0])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])
            rest = rest.slice(done)
            rest = rest if rest.num_rows else None

    dealt = split.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "a long, b long")


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose k-word shingle sets have intersection / union >= num / den.

    A row for every input row: doc_id, n_shingles (of its set), component_id
    (least doc_id that links reach), exact up to collisions of 64-bit shingle
    hashes. Words are runs of other than white space, A-Z lower-cased. A text
    of fewer than k words is one shingle; without words (null, empty) it is
    linked with nothing. Rows with a null id take no part (component null).
    Rows that repeat an id are one document. An empty table gives no rows;
    other columns are not read.

    Equal sets first become one node, by digest. A consistent sample of their
    shingles tells which nodes have too much that no other has, and these are
    done. Of the others' sets only the rarest shingles are dealt out as keys:
    sets that match share one. Nodes of a key
    are held against a leader first, which links groups of copies without
    their pairs; what is then still in different components of a key meets in
    R-trees of count vectors: first the likeliest pairs that would join them
    all, then, among what these leave apart, all pairs. Survivors are verified
    on whole sets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    counts = shingle_counts(rows, k)
    signs = written(signatures(rows, k, num, den, counts))
    reps, viable = viable_sets(signs, num, den)
    sets = written(node_sets(rows, checkpointed(viable), k, num, den, counts))
    blocks = written(shared_keys(sets.select(F.explode("keys").alias("key"), "node", "n"), num, den))
    vectors = sets.select("node", "n", "vector")

    def links_of(pairs: DataFrame) -> DataFrame:
        return checkpointed(verified(pairs.distinct(), sets, num, den))

    stars = blocks.where("leader <> node").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    comps = checkpointed(components(links_of(possible(stars, vectors, num, den))))
    for forest in (True, False):  # the likeliest pairs first: what they link needs no pairs any more
        more = links_of(open_pairs(blocks, comps, vectors, num, den, forest))
        if not more.isEmpty():
            comps = checkpointed(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    same = signs.where("n > 0 AND doc IS NOT NULL").select("doc", "n", "d1", "d2").join(reps, ["n", "d1", "d2"]).select("doc", "n", "node")
    rest = signs.where("n = 0 OR doc IS NULL").select("doc", "n", F.col("doc").alias("node"))
    return (
        same.unionByName(rest)
        .join(comps, "node", "left")
        .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    )
