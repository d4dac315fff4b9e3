"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices

#: Bytes encoded in one call, so that a batch's ids stay small whatever its rows.
BATCH_BYTES = 1 << 20
#: Longer texts are split at safe places into pieces of about this size.
PIECE_CHARS = 1 << 13

_SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces whose token counts add up to the text's.

    A cut drops one blank between two ASCII letters or digits: the encoder
    puts the blank's mark in front of each piece itself, and no entry of a
    vocabulary that ``cuts_are_safe`` accepts spans such a place. A text
    without such a place stays whole.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def cuts_are_safe(model) -> bool:
    """No entry has the blank's mark after another character, and a lone blank is marked as a text's start is."""
    marks = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    return not marks and len(model.encode("a b")) == 2 * len(model.encode("a"))


def _piece_counter(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    cut = cuts_are_safe(model)
    return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), cut


def _json_counter(path: str):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]), False


def counter(path: str):
    """A function from texts to token counts for the file's library, and whether texts may be cut."""
    return _json_counter(path) if path.endswith(".json") else _piece_counter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, bytes of the text, its tokens, and whether they exceed ``limit``.

    Works for any table with the two columns; others are not read. A null
    text counts as empty (0 bytes), a null id is kept, repeated rows each get
    their row, an empty table gives no rows. Texts are never shortened.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, cut = counter(model_path)
        for batch in slices(batches, 1024):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes, totals = [len(x.encode()) for x in texts], [0] * len(texts)
            held, rows, weight = [], [], 0

            def flush():
                for row, n in zip(rows, encode(held)):
                    totals[row] += n
                held.clear()
                rows.clear()

            for i, text in enumerate(texts):
                for piece in safe_pieces(text) if cut else [text]:
                    held.append(piece)
                    rows.append(i)
                    weight += len(piece)
                    if weight >= BATCH_BYTES:
                        flush()
                        weight = 0
            flush()
            weight = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
