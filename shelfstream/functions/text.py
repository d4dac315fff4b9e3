"""Text folds, tokens and small parsers as native column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that lexical tokens leave out.
LEXICAL_STOP = (
    "a an the for with without to from on at in of and or "
    "i me my want need find show something someone best good "
    "most more less cheap cheapest expensive premium budget "
    "toi muon can tim cho voi va mot cai nay do de"
).split()
# Words that context tokens leave out.
CONTEXT_STOP = "a an and buy cho cua cùng do find for gia giá in la là loai mau màu mot một mua need of phù san sản the tim tìm to tu từ va và voi với with want".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


@lru_cache
def _accents() -> tuple[str, str]:
    """Latin letters with marks, and their bare letters."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if bare != chr(code) and len(bare) == 1:
            out[chr(code)] = bare
    return "".join(out), "".join(out.values())


def _ascii(c: Column) -> Column:
    """Whether a text has nothing that could lose a mark; far cheaper to tell than to look at each letter."""
    return F.octet_length(c) == F.char_length(c)


def strip_marks(c: Column) -> Column:
    """Letters without their combining marks, for Latin letters."""
    return F.when(_ascii(c), c).otherwise(F.regexp_replace(F.translate(c, *_accents()), "[̀-ͯ]", ""))


def _words_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def query_fold(c: Column) -> Column:
    """Lower case, no marks, đ as d, other than letters and digits as one blank."""
    return _words_only(F.when(_ascii(c), F.lower(c)).otherwise(F.translate(strip_marks(F.lower(c)), "đ", "d")))


def semantic_fold(c: Column) -> Column:
    """As ``query_fold``, but đ stays."""
    return _words_only(F.lower(strip_marks(c)))


def unicode_fold(c: Column) -> Column:
    """Lower case with accents, of text in composed form."""
    return _words_only(F.lower(c))


def analytics_fold(c: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: t != "")


#: A letter whose fold is left to Spark; all others are Latin, and folded alike by Python and by Spark.
_NOT_LATIN = "[\u0130\u0250-\U0010ffff]"


def token_counts(docs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``docs`` with, for ``text``, its number of tokens ``len`` and ``counts``, an array of (term, n), of its query fold.

    Words are counted where the text is, so that no row is made for each word
    of it; with ``only``, terms other than these (and some that Spark folds)
    are left out of ``counts``, not of ``len``. Words with letters beyond
    Latin are folded by Spark; a term may then come twice.
    """
    names = [c for c in docs.columns if c != "text"]
    marks = {**{ord(a): b for a, b in zip(*_accents())}, ord("đ"): "d"}
    not_latin, asked = _NOT_LATIN, None if only is None else frozenset(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, other = re.compile(r"[^\W_]+").findall, re.compile(not_latin).search
        for batch in batches:
            terms, counts, ends, sizes, rest = [], [], [0], [], []
            for text in batch.column(len(names)).to_pylist():
                text, left = text or "", ""
                if not text.isascii() and other(text):
                    words = text.split()
                    left = " ".join([w for w in words if other(w)])
                    text = " ".join([w for w in words if not other(w)])
                words = found(text.lower())
                if not text.isascii():
                    words = [w if w.isascii() else w.translate(marks) for w in words]
                own = Counter(words if asked is None else filter(asked.__contains__, words))
                terms += own.keys()
                counts += own.values()
                ends.append(len(terms))
                sizes.append(len(words))
                rest.append(left)
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "n"])
            made = [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(rest, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], [*names, "len", "counts", "rest"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["len bigint, counts array<struct<term:string,n:bigint>>, rest string"])
    rows = docs.select(*names, "text").mapInArrow(count, schema).withColumn("rest", tokens(query_fold(F.col("rest"))))
    others = F.transform("rest", lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("n")))
    return rows.select(*names, (F.col("len") + F.size("rest")).alias("len"), F.concat("counts", others).alias("counts"))


def _without(values: Column, words: list[str]) -> Column:
    stop = F.array(*[F.lit(w) for w in words])
    return F.filter(values, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def meaningful_tokens(c: Column) -> Column:
    return _without(tokens(semantic_fold(c)), CONTEXT_STOP)


def lexical_tokens(c: Column) -> Column:
    """Distinct tokens of a query, at most eight; else none."""
    found = F.array_distinct(_without(tokens(query_fold(c)), LEXICAL_STOP))
    return F.when(F.size(found) <= 8, found).otherwise(F.array().cast("array<string>"))


def anchor(found: Column) -> Column:
    """The longest token (the first of equal ones) if it has three letters; else null."""
    longest = F.aggregate(found, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    return F.when(F.length(longest) >= 3, longest)


def singular(t: Column) -> Column:
    plain_s = (F.length(t) > 3) & t.endswith("s") & ~t.rlike("(ss|us|is)$")
    return (
        F.when((F.length(t) > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(plain_s, F.substring(t, F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )


def equivalence_key(c: Column) -> Column:
    """The query fold with every token singular."""
    return F.array_join(F.transform(tokens(query_fold(c)), singular), " ")


def variants(t: Column) -> Column:
    """A token with its singular and plural forms."""
    n = F.length(t)
    return F.array_distinct(
        F.array_compact(
            F.array(
                t,
                F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y"))),
                F.when((n > 4) & t.endswith("es"), F.substring(t, F.lit(1), n - 2)),
                F.when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), n - 1)),
                F.when((n > 2) & ~t.endswith("s"), F.concat(t, F.lit("s"))),
            )
        )
    )


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens follow each other in the text; both folded."""
    return F.instr(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) > 0


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Half goes up, also below zero."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale if digits else F.floor(c + 0.5)


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 as hex, from two SHA-256 over padded keys."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = (bytearray(b ^ pad for b in raw) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)
