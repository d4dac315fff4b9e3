"""Toxicity by votes of the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .kernels import WordHash, chunks, slices

#: Bound of the labelled sample that makes up the index: the rows of smallest md5 of their id.
MAX_EXAMPLES = 4096
NEIGHBOURS, BLOCK = 15, 64
#: Weight of a term that speaks for neither label, beside 1 for one that only occurs with label 1, and the
#: deviations of the Wilson interval whose lower end tells how surely a term speaks for it.
LEAST_WEIGHT, Z = 0.03, 3.0
#: Weight of the base rate among the votes.
PRIOR_VOTES = 0.25
#: Examples that are scored first.
FIRST = 32

#: Bytes between terms: all of ASCII but letters and digits. Other characters are part of terms.
_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def term_counts(texts: list[bytes], hashes: WordHash) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes of its distinct terms, ascending, and how often each occurs."""
    words, at = hashes.words(texts)
    return [np.unique(words[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in slices(batches):
        texts = [(x or "").lower().encode() for x in batch.column(1).to_pylist()]
        for a, b in chunks([len(t) for t in texts]):
            yield batch.slice(a, b - a), texts[a:b]


class BlockMaxIndex:
    """Unit vectors of examples, in blocks of about equal numbers of terms, under an inverted index with block maxima.

    Most terms have postings. Terms of more than a quarter of the examples
    have their weights side by side, and the largest of each block. An
    example's bound is its exact sum over the query's other terms plus its
    block's sum of weight times maximum over these. Examples are scored in
    whole in order of that bound until it falls below the k-th best cosine so
    far: the k nearest are exact.
    """

    def __init__(self, terms: int, term: np.ndarray, example: np.ndarray, weight: np.ndarray, n: int):
        self.n, self.blocks = n, max(1, -(-n // BLOCK))
        self.number = np.argsort(np.bincount(example, minlength=n), kind="stable")  # of each place: blocks hold examples of like size
        place = np.empty(n, dtype=np.int64)
        place[self.number] = np.arange(n)
        order = np.lexsort((place[example], term))
        term, at, weight = term[order], place[example][order], weight[order]
        df = np.bincount(term, minlength=terms)
        frequent = df > max(BLOCK, n // 4)
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
        self.side = np.zeros((int(frequent.sum()), self.blocks * BLOCK))
        often = frequent[term]
        self.side[self.row[term[often]], at[often]] = weight[often]
        self.maxima = self.side.reshape(len(self.side), self.blocks, BLOCK).max(axis=2)
        self.posting, self.weight = at[~often], weight[~often]
        self.range = np.concatenate(([0], np.cumsum(np.where(frequent, 0, df))))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest with a cosine above 0; of equal ones the lower number."""
        row = self.row[ids]
        rows, asked = row[row >= 0], weights[row >= 0][:, None]
        begin, end = self.range[ids[row < 0]], self.range[ids[row < 0] + 1]
        pieces = list(zip(begin.tolist(), end.tolist()))
        if pieces:
            at, own = (np.concatenate([x[i:j] for i, j in pieces]) for x in (self.posting, self.weight))
            exact = np.bincount(at, weights=own * np.repeat(weights[row < 0], end - begin), minlength=self.n)
        else:
            exact = np.zeros(self.n)
        upper = exact + np.repeat((self.maxima[rows] * asked).sum(axis=0), BLOCK)[: self.n]
        found, best, least = np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
        chosen = np.argpartition(-upper, FIRST)[:FIRST] if self.n > FIRST else np.arange(self.n)
        for turn in range(2):
            if turn:
                upper[chosen] = 0
                chosen = np.flatnonzero((upper > 0) & (upper >= least - 1e-9))
            score = exact[chosen] + (self.side[rows[:, None], chosen] * asked).sum(axis=0)
            found, best = np.concatenate([found, chosen[score > 0]]), np.concatenate([best, score[score > 0]])
            top = np.lexsort((self.number[found], -best))[:k]
            found, best = found[top], best[top]
            least = best[-1] if len(best) == k else 0.0
        return self.number[found], best


def term_weights(bad: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """Weights of terms found in n examples of which bad have label 1: how far the lower end of their share of label 1
    (Wilson interval) lies above the base rate, and a small weight for each term."""
    p = bad / n
    low = (p + Z * Z / 2 / n - Z * np.sqrt(p * (1 - p) / n + Z * Z / 4 / (n * n))) / (1 + Z * Z / n)
    return LEAST_WEIGHT + (1 - LEAST_WEIGHT) * np.clip((low - rate) / max(1 - rate, 1e-9), 0, 1)


class Neighbours:
    """The fitted examples: their terms, term factors (IDF times weight), index, labels and ids."""

    def __init__(self, vocabulary: np.ndarray, factor: np.ndarray, index: BlockMaxIndex, toxic: np.ndarray, names: np.ndarray, rate: float, bare: float):
        self.vocabulary, self.factor, self.index, self.toxic, self.names, self.rate, self.bare = vocabulary, factor, index, toxic, names, rate, bare

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.vocabulary, terms)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == terms if len(self.vocabulary) else np.zeros(len(terms), dtype=bool)
        ids = at[known]
        w = (1 + np.log(counts[known])) * self.factor[ids]
        return ids, w / np.sqrt((w * w).sum()) if len(w) else w

    def vote(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        ids, weights = self.vector(terms, counts)
        if not len(ids):
            return self.bare, []
        near, cos = self.index.nearest(ids, weights, NEIGHBOURS)
        return (float(cos @ self.toxic[near]) + PRIOR_VOTES * self.rate) / (float(cos.sum()) + PRIOR_VOTES), self.names[near[:3]].tolist()


def _gathered(examples: DataFrame) -> list:
    """(doc_id, toxic, terms, counts) of the examples, terms and counts packed, in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash(31, _BREAKS)
        for part, texts in _texts(batches):
            found = term_counts(texts, hashes)
            cols = [pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols, part.column(2)], ["doc_id", "terms", "counts", "toxic"])

    rows = examples.mapInArrow(run, "doc_id long, terms binary, counts binary, toxic int").collect()
    return sorted(set(rows))


def document_frequencies(rows: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """How many rows there are, and how many hold each term of the vocabulary, over all rows."""
    sent, pieces = rows.sparkSession.sparkContext.broadcast(vocabulary), 16
    edges = np.linspace(0, len(vocabulary), pieces + 1).astype(int)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = sent.value, WordHash(31, _BREAKS)
        total, n = np.zeros(len(own), dtype=np.int64), 0
        for part, texts in _texts(batches):
            n += part.num_rows
            found = [x for x, _ in term_counts(texts, hashes) if len(x)]
            if found and len(own):
                terms = np.sort(np.concatenate(found))
                at = np.searchsorted(own, terms)
                at[at == len(own)] = 0
                total += np.bincount(at[own[at] == terms], minlength=len(own))
        packed = [total[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([n] * pieces, pa.int64()), pa.array(packed, pa.binary())], ["part", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple] = {}
        for batch in batches:
            for part, n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                old, more = totals.get(part, (0, 0)), np.frombuffer(x.as_buffer(), dtype=np.int64)
                totals[part] = old[0] + n, old[1] + more
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([n for n, _ in totals.values()], pa.int64()), pa.array([x.tobytes() for _, x in totals.values()], pa.binary())], ["part", "n", "counts"]
        )

    kind = "part int, n long, counts binary"
    got = {r["part"]: r for r in rows.mapInArrow(count, kind).repartition(pieces, "part").mapInArrow(add, kind).collect()}
    if not got:
        return 0, np.zeros(len(vocabulary), dtype=np.int64)
    return got[0]["n"], np.concatenate([np.frombuffer(got[i]["counts"], dtype=np.int64) for i in range(pieces)])


def fit(rows: DataFrame, known: DataFrame, max_examples: int) -> Neighbours:
    """The index of at most ``max_examples`` of the (doc_id, toxic) rows, with frequencies over all (doc_id, text) rows."""
    sample = checkpointed(known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_examples))
    examples = _gathered(rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"))
    terms = [np.frombuffer(r["terms"], dtype=np.uint64) for r in examples]
    counts = [np.frombuffer(r["counts"], dtype=np.int32) for r in examples]
    toxic = np.array([r["toxic"] for r in examples], dtype=np.float64)
    names = np.array([r["doc_id"] for r in examples], dtype=np.int64)
    sizes = np.array([len(x) for x in terms], dtype=np.int64)
    vocabulary, term = np.unique(np.concatenate([*terms, np.zeros(0, dtype=np.uint64)]), return_inverse=True)
    total, df = document_frequencies(rows, vocabulary)
    example = np.repeat(np.arange(len(examples)), sizes)
    n = np.bincount(term, minlength=len(vocabulary)).astype(np.float64)
    bad = np.bincount(term, weights=toxic[example], minlength=len(vocabulary))
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.0
    empty = toxic[sizes == 0]
    bare = (empty.sum() + PRIOR_VOTES * rate) / (len(empty) + PRIOR_VOTES)
    factor = np.log((1.0 + total) / np.maximum(df, 1)) * term_weights(bad, np.maximum(n, 1), rate)
    weight = (1 + np.log(np.concatenate([*counts, np.ones(0, dtype=np.int32)]))) * factor[term]
    norm = np.sqrt(np.bincount(example, weights=weight * weight, minlength=len(examples)))
    index = BlockMaxIndex(len(vocabulary), term, example, weight / np.maximum(norm, 1e-300)[example], len(examples))
    return Neighbours(vocabulary, factor, index, toxic, names, float(rate), float(bare))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted, evidence
    (ids of up to three nearest examples, nearest first).

    Examples are the rows of ``labels`` (doc_id, toxic) whose crc32 of the id
    as text is not divisible by 5, at most ``max_examples``. All their terms
    (runs of letters, digits and characters beyond ASCII, lower case) make
    TF-IDF vectors, with frequencies over all documents; a term's IDF is
    multiplied by how surely it occurs with label 1 more often than other
    terms, and never by 0. Each document's score is the vote of its nearest
    examples, weighted by cosine, with the base rate as a small further vote.

    Texts without a term of any example (null, empty) get the share of label 1
    among examples without terms, drawn to the base rate. Null labels are left
    out, rows with a null id are scored and not held out. Without examples the
    score is 0. Of equal cosines the lower id is nearer. Repeated rows get equal scores;
    an empty table gives no rows; other columns are not read.

    The index passes through the driver and goes to each task; its size is
    that of ``max_examples`` texts, whatever the corpus.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fitted = fit(rows, known, max_examples)
    # Plain arrays travel; the small classes around them come with the function.
    sent = docs.sparkSession.sparkContext.broadcast([fitted.vocabulary, fitted.factor, vars(fitted.index), fitted.toxic, fitted.names, fitted.rate, fitted.bare])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, factor, parts, *rest = sent.value
        index = BlockMaxIndex.__new__(BlockMaxIndex)
        vars(index).update(parts)
        near, hashes = Neighbours(vocabulary, factor, index, *rest), WordHash(31, _BREAKS)
        for part, texts in _texts(batches):
            scores, evidence, done = [], [], {}
            for text, (terms, counts) in zip(texts, term_counts(texts, hashes)):
                if text not in done:
                    done[text] = near.vote(terms, counts)
                scores.append(done[text][0])
                evidence.append(done[text][1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    out = rows.mapInArrow(score, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
