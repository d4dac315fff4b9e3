"""Benchmark decontamination in column expressions: SimHash of item-sized windows, then exact similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small

#: Words of a shingle, and the similarity of a match in hundredths.
SHINGLE, PERCENT = 5, 80
#: Bits in which a window's fingerprint may differ from its item's; at similarity 0.8 about 10 of 64 do (deviation 3).
RADIUS = 23
BITS, BLOCKS = 64, 8


def _shingles(df: DataFrame, text: str, k: int) -> DataFrame:
    """Adds ``shingles``: hashes of k successive words (lower case, letters and digits), in order."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(own: Column) -> Column:
        every = F.transform(own, lambda _, i: F.xxhash64(*[F.get(own, i + j) for j in range(k)]))
        return F.slice(every, F.lit(1), F.greatest(F.size(own) - (k - 1), F.lit(0)))

    # The words are the variable of an outer function: evaluated once, wherever the optimizer puts the expression.
    return df.withColumn("shingles", F.transform(F.array(hashes), grams)[0])


def _count_bit(b: int):
    return lambda n, h: n + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int")


def simhash(shingles: Column) -> Column:
    """64-bit SimHash of a bag of 64-bit hashes: bit b is set where more than half of them have it."""
    half = F.size(shingles)
    out = F.lit(0).cast("long")
    for b in range(BITS):
        ones = F.aggregate(shingles, F.lit(0), _count_bit(b))
        out = out.bitwiseOR(F.when(2 * ones > half, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return out


def _blocks(fingerprint: Column) -> Column:
    """BLOCKS disjoint blocks of the bits, as (block, value)."""
    width = BITS // BLOCKS
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("value")) for i in range(BLOCKS)])


def _probes(fingerprint: Column, radius: int) -> Column:
    """The blocks of all fingerprints within the radius, of which one at least is met: some block differs in radius // BLOCKS bits at most."""
    width, flips = BITS // BLOCKS, [m for m in range(1 << (BITS // BLOCKS)) if m.bit_count() <= radius // BLOCKS]
    assert radius < BITS and width * BLOCKS == BITS
    masks = F.array(*[F.lit(m) for m in flips])
    return F.flatten(F.transform(_blocks(fingerprint), lambda b: F.transform(masks, lambda m: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(m).alias("value")))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items that documents hold: doc_id, item_id, start (word), n_words, similarity of the best window.

    A window has as many words as its item; its similarity is the sum of
    minima over the sum of maxima of the counts of each k-word shingle, at
    least percent/100 for a match. For each size that items have, windows of that size are
    taken at every start from which they hold as many shingles of items of that
    size, whichever they are of and in whatever order, as such a similarity needs.
    Which items a window may match is told by its SimHash alone: BLOCKS blocks
    of bits, each met by every block value of an item within radius // BLOCKS bits,
    bring together all fingerprints within the radius; exact counts decide.

    Null or empty texts and items of fewer than k words take no part, nor do
    null ids. Items that repeat are each reported; repeated rows of a document
    are reported once. Empty tables give no rows; other columns are not read.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("item")).where("item_id IS NOT NULL AND item IS NOT NULL")
    items = _shingles(items, "item", k).where(F.size("shingles") > 0).drop("item").withColumn("m", F.size("shingles"))
    items = checkpointed(items.withColumn("item_print", simhash(F.col("shingles"))))
    grams = items.select("item_id", "m", F.explode("shingles").alias("gram"))
    weights = checkpointed(grams.groupBy("item_id", "gram").agg(F.max("m").alias("m"), F.count("*").cast("int").alias("weight")))
    sizes = checkpointed(weights.select("m", "gram").distinct())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("mark", F.xxhash64("text"))
    # The outer form, as the other would evaluate the shingles once more in a filter; the join drops its null.
    hits = _shingles(rows, "text", k).select("doc_id", "mark", F.size("shingles").alias("n"), F.posexplode_outer("shingles").alias("pos", "gram")).join(small(sizes), "gram")
    # A window of the wanted similarity holds at least `need` hits, whatever their order: hit i and the need - 1 after it
    # lie in the windows that start from at[i + need - 1] - size + 1 to at[i]; those up to at[i - 1] belong to hit i - 1.
    size = F.least("n", "m")
    need = ((percent * (size + F.col("m")) + (99 + percent)) / (100 + percent)).cast("int")
    held = hits.groupBy("doc_id", "mark", "m").agg(F.sort_array(F.collect_set("pos")).alias("at"), F.max("n").alias("n"))
    held = held.select("doc_id", "mark", "m", size.alias("size"), (F.col("n") - size).alias("last"), need.alias("need"), "at").where(F.size("at") >= F.col("need"))
    low = lambda p, i: F.greatest(F.get("at", i + F.col("need") - 1) - F.col("size") + 1, F.coalesce(F.get("at", i - 1) + 1, F.lit(0)), F.lit(0))
    runs = F.transform(F.slice("at", F.lit(1), F.size("at") - F.col("need") + 1), lambda p, i: F.struct(low(p, i).alias("low"), F.least(p, F.col("last")).alias("high")))
    runs = checkpointed(held.select("doc_id", "mark", "m", "size", F.inline(runs)).where("low <= high"))

    # Windows are cut where the texts are read: no text is shuffled while the windows are few.
    wanted = runs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("m", "size", "low", "high")).alias("wanted"))
    cut = _shingles(rows.join(small(checkpointed(wanted)), ["doc_id", "mark"]), "text", k).select("doc_id", "shingles", F.inline_outer("wanted"))
    cut = cut.select("doc_id", "m", "size", "low", "high", F.slice("shingles", F.col("low") + 1, F.col("high") - F.col("low") + F.col("size")).alias("part"))
    cut = cut.select("doc_id", "m", "size", "low", "part", F.explode(F.sequence("low", "high")).alias("start"))
    cut = cut.select("doc_id", "m", "start", F.slice("part", F.col("start") - F.col("low") + 1, F.col("size")).alias("shingles")).distinct()
    cut = checkpointed(cut.withColumn("print", simhash(F.col("shingles"))))
    key = ["m", "block", "value"]
    ours = cut.select("doc_id", "start", "m", "print", F.inline(_blocks(F.col("print"))))
    theirs = checkpointed(items.select("item_id", "item_print", "m", F.inline(_probes(F.col("item_print"), radius))).distinct())
    near = ours.join(small(theirs), key).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    near = near.select("doc_id", "m", "start", "print", "item_id").distinct()

    counts = near.join(cut, ["doc_id", "m", "start", "print"]).select("doc_id", "item_id", "start", F.size("shingles").alias("size"), F.explode("shingles").alias("gram"))
    counts = counts.groupBy("doc_id", "item_id", "start", "gram").agg(F.count("*").cast("int").alias("n"), F.max("size").alias("size"))
    same = counts.join(small(weights), ["item_id", "gram"]).groupBy("doc_id", "item_id", "start").agg(F.sum(F.least("n", "weight")).alias("both"), F.max("size").alias("size"), F.max("m").alias("m"))
    every = F.col("size") + F.col("m") - F.col("both")
    found = same.where(100 * F.col("both") >= percent * every).withColumn("similarity", F.col("both") / every)
    best = F.max_by(F.struct(F.col("start"), (F.col("size") + (k - 1)).alias("n_words"), F.col("similarity")), F.struct("similarity", -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.start", "best.n_words", "best.similarity")
