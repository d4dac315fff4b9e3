"""Exact dedup against a minimal perfect hash of the digests seen before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .kernels import mix

#: Digests that one hash function of the index holds, about.
BUCKET_ROWS = 20_000
#: Digests for each displacement of the hash function, on average.
PER_SEED = 4


def _words(digests: list[bytes]) -> np.ndarray:
    """The digests' first 24 bytes as three 64-bit numbers a row."""
    return np.frombuffer(b"".join(d[:24] for d in digests), dtype="<u8").reshape(-1, 3)


def _slots(words: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix(words + seeds * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def build_hash(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash-and-displace: a seed for each small group such that all digests get different slots 0..n-1.

    Returns the seeds and each digest's slot. Digests must be distinct.
    """
    n, w = len(digests), _words(digests)
    groups = max(1, -(-n // PER_SEED))
    group = (w[:, 0] % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    seeds, slots, free = np.zeros(groups, dtype=np.uint32), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for g in np.argsort(-np.diff(bounds), kind="stable"):
        rows = order[bounds[g] : bounds[g + 1]]
        if not len(rows):
            break
        first = 0
        while True:  # 64 seeds at a time
            tried = np.arange(first, first + 64, dtype=np.uint64)
            at = _slots(w[rows, 1][None, :] ^ (w[rows, 2][None, :] >> np.uint64(1)), tried[:, None], n)
            good = free[at].all(axis=1)
            if len(rows) > 1:
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[g], slots[rows] = first + k, at[k]
                free[at[k]] = False
                break
            first += 64
    return seeds, slots


def lookup(digests: list[bytes], seeds: np.ndarray, n: int) -> np.ndarray:
    """Each digest's slot; right for members, any slot for others."""
    w = _words(digests)
    seed = seeds[(w[:, 0] % np.uint64(len(seeds))).astype(np.int64)].astype(np.uint64)
    return _slots(w[:, 1] ^ (w[:, 2] >> np.uint64(1)), seed, n)


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Index of (digest, winner, rows): a row for each bucket with seeds, and in slot order the full digests, winners and counts."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = [bytes(x) for x in pdf["digest"]]
        seeds, slots = build_hash(digests)
        order = np.argsort(slots)
        return pd.DataFrame(
            {
                "bucket": pdf["bucket"].iloc[:1].to_numpy(),
                "seeds": [seeds.tobytes()],
                "slots": [b"".join(digests[i] for i in order)],
                "winners": [pdf["winner"].to_numpy()[order].astype("<i8").tobytes()],
                "counts": [pdf["n"].to_numpy()[order].astype("<i8").tobytes()],
            }
        )

    return (
        history.withColumn("bucket", _bucket(buckets))
        .groupBy("bucket")
        .applyInPandas(build, "bucket long, seeds binary, slots binary, winners binary, counts binary")
    )


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 53, 12), 16, 10).cast("long"), F.lit(buckets))


def match_index(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(digest, winner, n) of the new rows, all digests of the index included.

    New digests find their slot and are held against the full digest in it;
    members add to the slot's entry, others keep a group of their own.
    """

    def match(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        digests = [bytes(x) for x in left["digest"]]
        win, cnt = left["winner"].to_numpy(dtype="i8"), left["n"].to_numpy(dtype="i8")
        if not len(right):
            return pd.DataFrame({"digest": digests, "winner": win, "n": cnt})
        held, seeds = right["slots"].iloc[0], np.frombuffer(right["seeds"].iloc[0], dtype=np.uint32)
        winners, counts = (np.frombuffer(right[c].iloc[0], dtype="<i8").copy() for c in ("winners", "counts"))
        slots = [held[i : i + 32] for i in range(0, len(held), 32)]
        alone = np.ones(len(digests), dtype=bool)
        if digests:
            at = lookup(digests, seeds, len(slots))
            alone = np.array([slots[s] != d for s, d in zip(at, digests)])
            hit = at[~alone]
            np.maximum.at(winners, hit, win[~alone])
            np.add.at(counts, hit, cnt[~alone])
        rest = np.flatnonzero(alone)
        return pd.DataFrame(
            {
                "digest": slots + [digests[i] for i in rest],
                "winner": np.concatenate([winners, win[rest]]),
                "n": np.concatenate([counts, cnt[rest]]),
            }
        )

    return (
        new.withColumn("bucket", _bucket(buckets))
        .groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(match, "digest binary, winner long, n long")
    )


def exact_dedup(history: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group equal texts of both tables; the largest id of a group stays.

    A row for every row of both: doc_id, keep_id, group_size, kept,
    text_sha256. A null text equals the empty text. A null id is the smallest
    id: it stays only where its whole group has none (keep_id is then null).
    Of repeated rows with the largest id each is kept, since they are one
    document. Empty tables give no rows; other columns are not read.
    """

    def digests(df: DataFrame, old: bool) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        return df.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.lit(old).alias("old"))

    low = F.lit(-(1 << 63))
    rows = checkpointed(digests(history, True).unionByName(digests(new, False)))
    groups = rows.groupBy("digest", "old").agg(F.max(F.coalesce("doc_id", low)).alias("winner"), F.count("*").alias("n"))
    groups = checkpointed(groups)
    buckets = max(1, groups.count() // BUCKET_ROWS)
    index = build_index(groups.where("old").drop("old"), buckets)
    merged = match_index(groups.where("NOT old").drop("old"), index, buckets)
    return (
        rows.join(merged, "digest")
        .select(
            "doc_id",
            F.when(F.col("winner") != low, F.col("winner")).alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.coalesce("doc_id", low) == F.col("winner")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
