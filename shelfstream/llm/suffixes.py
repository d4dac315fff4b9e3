"""Removal of long repeated byte strings with a logarithmic family of sampled suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .kernels import Rolling, chunks, mix, slices

#: Bytes of a string that counts as a repeat.
MATCH_BYTES = 100
#: Bytes whose hash picks the sampled suffixes.
GRAM_BYTES = 24
#: Suffixes that make up one new batch of an index family.
BATCH_ROWS = 1 << 16


class Levels:
    """Sorted runs of 64-bit keys with rows of payload, sizes growing geometrically.

    A new batch becomes a run of its own; while the run before it is not
    twice as large, the two are merged. A key is looked up in every run.
    """

    def __init__(self):
        self.runs = []

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Which of the sorted keys some run has, and for each run (rows of keys, payload, rows of payload)."""
        hit, where = np.zeros(len(keys), dtype=bool), []
        for own, payload in self.runs:
            at = np.searchsorted(own, keys)
            at[at == len(own)] = 0
            same = own[at] == keys
            hit |= same
            rows = np.flatnonzero(same)
            where.append((rows, payload, at[rows]))
        return hit, where

    def add(self, keys: np.ndarray, payload: np.ndarray) -> None:
        """Sorted keys that no run has yet."""
        if not len(keys):
            return
        self.runs.append((keys, payload))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            (a, x), (b, y) = self.runs[-2:]
            keys = np.concatenate([a, b])
            order = np.argsort(keys, kind="stable")
            self.runs[-2:] = [(keys[order], np.concatenate([x, y])[order])]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each pair, one after another."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def anchors(buf: np.ndarray, begins: np.ndarray, sizes: np.ndarray, roll: Rolling, match: int, gram: int) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of the texts in a buffer: (gram hash, hash of all covered bytes, text, first window, windows).

    Of each ``match``-byte window the leftmost gram of least hash is the
    anchor, so equal windows have the same anchor at the same place; windows
    that follow each other mostly share one.
    """
    windows = np.maximum(sizes - match + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    if not len(owner):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    s = _ranges(begins, windows)
    sums = roll.sums(buf)
    at = np.arange(len(buf) - gram + 1)
    h = roll.ranges(sums, at, at + gram)
    w = match - gram + 1
    low = _sliding_min(h, w)[s]
    new = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1] + 1) | (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]))))
    first, least, text = s[new], low[new], owner[new]
    count = np.diff(np.concatenate((new, [len(s)])))
    place = np.empty(len(first), dtype=np.int64)
    for i in range(0, len(first), 4096):
        seen = h[first[i : i + 4096, None] + np.arange(w)] == least[i : i + 4096, None]
        place[i : i + 4096] = first[i : i + 4096] + seen.argmax(axis=1)
    split = np.flatnonzero(place < first + count - 1)
    if len(split):  # the leftmost gram leaves the window and an equal one follows
        keep = np.ones(len(first), dtype=bool)
        keep[split] = False
        parts = [[x[keep]] for x in (first, least, text, count, place)]
        for i in split:
            starts = np.arange(first[i], first[i] + count[i])
            places = first[i] + np.flatnonzero(h[first[i] : first[i] + count[i] - 1 + w] == least[i])
            where = places[np.searchsorted(places, starts)]
            cut = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1))
            n = np.diff(np.concatenate((cut, [len(starts)])))
            for part, x in zip(parts, (starts[cut], np.full(len(cut), least[i]), np.full(len(cut), text[i]), n, where[cut])):
                part.append(x)
        first, least, text, count, place = (np.concatenate(x) for x in parts)
    body = roll.ranges(sums, first, first + count - 1 + match)
    return least, mix(body ^ (place - first).astype(np.uint64)), text, first - begins[text], count


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, where each begins, sizes) of about a megabyte at a time."""
    for batch in slices(batches):
        texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
        for a, b in chunks([len(t) for t in texts]):
            sizes = np.array([len(t) for t in texts[a:b]], dtype=np.int64)
            yield batch.slice(a, b - a), np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def sampled_suffixes(docs: DataFrame, match: int, gram: int) -> DataFrame:
    """(key, body, doc, lo, n) of all anchors of (doc, text) rows; keys as signed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(11)
        for part, buf, begins, sizes in _chunked(batches):
            if len(buf) < match:
                continue
            ids = part.column(0).to_numpy()
            key, body, text, lo, n = anchors(buf, begins, sizes, roll, match, gram)
            cols = (key.view(np.int64), body.view(np.int64), ids[text], lo.astype(np.int32), n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "body", "doc", "lo", "n"])

    return docs.mapInArrow(run, "key long, body long, doc long, lo int, n int")


def scan_repeats(entries: DataFrame) -> DataFrame:
    """Merge-scan of (key, body, doc, lo, n) entries in order of (doc, lo) against the index family of their key's partition.

    Returns rows (doc, lo, n, key, sure): sure where the whole body was seen
    before; else an entry with a new body whose key has more than one body.

    Each partition keeps, of all keys it has seen, the first entry only, and
    of all bodies their hash: copies of one body take no room, whatever their
    number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_seen, bodies_seen = Levels(), Levels()

        def scan(key, body, doc, lo, n):
            whole = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ body)
            distinct, at = np.unique(whole, return_index=True)  # the first of each in order
            old, _ = bodies_seen.find(distinct)
            fresh = np.zeros(len(key), dtype=bool)
            fresh[at[~old]] = True
            bodies_seen.add(distinct[~old], np.zeros((int((~old).sum()), 0), dtype=np.int64))
            rows = np.flatnonzero(fresh)
            order = rows[np.argsort(key[rows], kind="stable")]
            uniq, first, times = np.unique(key[order], return_index=True, return_counts=True)
            hit, where = keys_seen.find(uniq)
            check = order[np.repeat(hit | (times > 1), times)]
            extra = [np.zeros((0, 4), dtype=np.int64)]
            for k, payload, at in where:  # first entries of keys that turn out to recur
                untold = payload[at, 3] == 0
                extra.append(np.column_stack([payload[at[untold], :3], uniq[k[untold]].view(np.int64)]))
                payload[at[untold], 3] = 1
            head = order[first[~hit]]
            keys_seen.add(uniq[~hit], np.column_stack([doc[head], lo[head], n[head], (times[~hit] > 1).astype(np.int64)]))
            sure, extra = np.flatnonzero(~fresh), np.concatenate(extra)
            cols = [np.concatenate([c[sure], c[check], extra[:, j]]) for j, c in enumerate((doc, lo, n, key.view(np.int64)))]
            flag = np.arange(len(cols[0])) < len(sure)
            kinds = (np.int64, np.int32, np.int32, np.int64)
            return pa.RecordBatch.from_arrays([*(pa.array(c.astype(k)) for c, k in zip(cols, kinds)), pa.array(flag)], ["doc", "lo", "n", "key", "sure"])

        def columns(held: list[pa.RecordBatch]):
            t = pa.Table.from_batches(held)
            c = [t.column(i).to_numpy() for i in range(5)]
            return c[0].view(np.uint64), c[1].view(np.uint64), *(x.astype(np.int64) for x in c[2:])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BATCH_ROWS:
                yield scan(*columns(held))
                held, size = [], 0
        if size:
            yield scan(*columns(held))

    dealt = entries.repartition("key").sortWithinPartitions("doc", "lo")
    return dealt.mapInArrow(run, "doc long, lo int, n int, key long, sure boolean")


def _spans(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and counts of a column of lists of (lo, n)."""
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()) if column.null_count == 0 else column.value_lengths().fill_null(0).to_numpy())
    flat = column.flatten()
    return rows, flat.field("lo").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)


def window_entries(checks: DataFrame, docs: DataFrame, match: int) -> DataFrame:
    """(key, doc, lo, hashes) of the checked entries: the anchor's hash and, packed, a hash of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(21)
        for part, buf, begins, sizes in _chunked(batches):
            text, lo, n = _spans(part.column(2))
            keys = part.column(2).flatten().field("key").to_numpy()
            start = _ranges(begins[text] + lo, n)
            packed = roll.ranges(roll.sums(buf), start, start + match).tobytes()
            at = np.concatenate(([0], np.cumsum(n))) * 8
            hashes = pa.array([packed[i:j] for i, j in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part.column(0).to_numpy()[text]), pa.array(lo.astype(np.int32)), hashes], ["key", "doc", "lo", "hashes"])

    spans = checks.groupBy("doc").agg(F.collect_list(F.struct("lo", "n", "key")).alias("spans"))
    # Built from the spans, whose rows the texts are streamed past: no text is sorted.
    joined = docs.join(spans.hint("shuffle_hash"), "doc").select("doc", "text", "spans")
    return joined.mapInArrow(run, "key long, doc long, lo int, hashes binary")


def scan_windows(entries: DataFrame) -> DataFrame:
    """(doc, lo, n) runs of windows whose hash was seen earlier, in order of (doc, lo), by the same kind of index family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Levels()
        for batch in batches:
            packed = batch.column(3).to_pylist()
            sizes = np.array([len(x) // 8 for x in packed], dtype=np.int64)
            h = np.frombuffer(b"".join(packed), dtype=np.uint64)
            doc = np.repeat(batch.column(1).to_numpy(), sizes)
            lo = _ranges(batch.column(2).to_numpy().astype(np.int64), sizes)
            distinct, at = np.unique(h, return_index=True)
            old, _ = seen.find(distinct)
            lost = np.ones(len(h), dtype=bool)
            lost[at[~old]] = False
            seen.add(distinct[~old], np.zeros((int((~old).sum()), 0), dtype=np.int64))
            doc, lo = doc[lost], lo[lost]
            if len(doc):
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + 1))))
                n = np.diff(np.concatenate((first, [len(doc)])))
                yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(lo[first].astype(np.int32)), pa.array(n.astype(np.int32))], ["doc", "lo", "n"])

    dealt = entries.repartition("key").sortWithinPartitions("doc", "lo")
    return dealt.mapInArrow(run, "doc long, lo int, n int")


def remove_repeats(docs: DataFrame, match: int = MATCH_BYTES, gram: int = GRAM_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte that a ``match``-byte string covers which also starts
    earlier: in a smaller id, or in the same document at an earlier place.

    A row for every input row: doc_id, kept (binary), n_bytes, n_removed,
    n_spans (maximal removed runs). Strings are judged on the input; matches
    may overlap, never cross documents, and are exact up to a collision of
    64-bit hashes within a partition. A null text counts as empty. Rows with a
    null id take no part and stay whole. Of repeated rows of one id, which are
    to hold one text, the second is an exact repeat, and so both lose
    everything a repeat loses. An empty table gives no rows; other columns are
    not read.

    Suffixes are sampled at anchors (about one in 39 bytes) that equal windows
    share. Their hashes are dealt to partitions; each keeps its own family of
    sorted runs, scans each new batch against them and merges runs of equal
    size. Where an anchor's whole surroundings were seen before, all its
    windows repeat; where only the anchor recurs, its windows are compared one
    by one in a second such scan.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("doc IS NOT NULL")
    found = written(scan_repeats(sampled_suffixes(known, match, gram)))
    again = scan_windows(window_entries(found.where("NOT sure"), known, match))
    cover = found.where("sure").select("doc", "lo", "n").unionByName(again)
    cover = cover.groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, begins, sizes in _chunked(batches):
            text, lo, n = _spans(part.column(2))
            delta = np.zeros(len(buf) + 1, dtype=np.int32)
            np.add.at(delta, begins[text] + lo, 1)
            np.add.at(delta, begins[text] + lo + n - 1 + match, -1)
            lost = np.cumsum(delta[:-1]) > 0
            kept, removed = buf[~lost].tobytes(), np.concatenate(([0], np.cumsum(lost)))
            starts = np.concatenate((lost[:1], lost[1:] & ~lost[:-1]))
            starts[begins[sizes > 0]] = lost[begins[sizes > 0]]
            runs, ends = np.concatenate(([0], np.cumsum(starts))), begins + sizes
            n_removed = removed[ends] - removed[begins]
            at = np.concatenate(([0], np.cumsum(sizes - n_removed)))
            texts = pa.array([kept[i:j] for i, j in zip(at[:-1], at[1:])], pa.binary())
            counts = (sizes, n_removed.astype(np.int64), (runs[ends] - runs[begins]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), texts, *(pa.array(c) for c in counts)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = rows.join(cover.hint("shuffle_hash"), "doc", "left").select("doc", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
