"""Probes: the further texts by which a shopper's demand is looked for, from a profile of the query.

A profile is a row with ``mode`` (DIRECT, DISCOVERY or COMPLEMENT), ``query``,
``semantic_query`` and ``intent`` (texts), and arrays of texts: ``types``
(names of the wanted product, best first), ``facets``, ``negatives``,
``reference_terms``, ``expansions``, ``axes`` (values of outcome, use, context, quality,
audience and style, an array each, or null), ``needs`` (stands for null axes),
``blocked`` (contexts that are ruled out), ``catalog_types`` and ``catalog_values``
(terms of the catalog that the query resolved to).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTEXT_STOP, let, semantic_fold
from .lineage import spread

# Contexts that say nothing, words that are no residual, audience words and single letters of identities.
GENERIC_CONTEXT = "apparel clothing gear equipment item items product products goods outfit outfits fashion".split()
RESIDUAL_STOP = (
    "i m im do you have has that are is am be been being a an the for with to in on of and or but still something anything looking "
    "need want suitable enough please show me find get"
).split()
AUDIENCE_WORDS = "man men male woman women female boy boys girl girls kid kids child children baby toddler youth adult adults unisex nam nu".split()
IDENTITY_LETTERS = "t v u x".split()
PROBE_CHARS, EXPANSION_CHARS, PAIR_CHARS = 260, 300, 220

def _none() -> Column:
    return F.array().cast("array<string>")


def _in(words: list[str], c: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(w) for w in words]), c)


def _squashed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _texts(c: Column) -> Column:
    """The array's values with single blanks, empty ones left out."""
    return F.filter(F.transform(F.coalesce(c, _none()), lambda x: _squashed(F.coalesce(x, F.lit("")))), lambda x: x != "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _keyed(texts: Column) -> Column:
    """The array's texts with what they fold to: structs of key and text."""
    return F.transform(texts, lambda x: F.struct(semantic_fold(x).alias("key"), x.alias("text")))


def _keys(texts: Column) -> Column:
    return F.transform(texts, semantic_fold)


def _once(rows: Column) -> Column:
    """The array without rows of the same key as one before."""
    return let(rows, lambda own: let(own["key"], lambda keys: F.filter(own, lambda r, i: F.array_position(keys, r["key"]) == i + 1)))


def listed(values: Column) -> Column:
    """``a``, ``a and b``, or ``a, b, and c``."""
    def of(c: Column) -> Column:
        head = F.array_join(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), ", ")
        last = F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(""))
        return F.when(F.size(c) <= 1, last).when(F.size(c) == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))

    return let(values, of)


def contexts(limit: int = 8) -> Column:
    """What the demand must keep in every probe, as key and text: the first value of each axis, then the others."""
    axes = F.transform(F.col("axes"), lambda a: F.coalesce(a, _none()))
    firsts = F.transform(F.filter(axes, lambda a: F.size(a) > 0), lambda a: a[0])
    rest = F.flatten(F.transform(axes, lambda a: F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))))
    values = _texts(F.coalesce(F.concat(firsts, rest), F.col("needs")))

    def says(r: Column, barred: Column) -> Column:
        return ~r["text"].rlike(r"\d") & (r["key"] != "") & ~F.array_contains(barred, r["key"]) & F.exists(_words(r["key"]), lambda w: ~_in(GENERIC_CONTEXT, w))

    kept = let(_keys(_texts(F.col("blocked"))), lambda barred: F.filter(_keyed(values), lambda r: says(r, barred)))
    return F.slice(_once(kept), 1, limit)


def _holds(longer: Column, shorter: Column) -> Column:
    """Whether all words of ``shorter``, two at least, stand in ``longer`` in a row."""
    return (F.size(_words(shorter)) >= 2) & F.contains(F.concat(F.lit(" "), longer, F.lit(" ")), F.concat(F.lit(" "), shorter, F.lit(" ")))


def names_the_same(a: Column, b: Column) -> Column:
    """Two folded names are equal, or one of several words is a part of the other."""
    return (a != "") & (b != "") & ((a == b) | _holds(a, b) | _holds(b, a))


def _class_words(c: Column) -> Column:
    return F.filter(_words(c), lambda w: (F.length(w) >= 2) & ~_in(CONTEXT_STOP, w) & ~_in(GENERIC_CONTEXT, w))


def is_of_type(expansion: Column, kind: Column) -> Column:
    """Two folded names agree on their last word, and on another one where both have several."""
    def of(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(b)))
        single = (F.size(a) == 1) | (F.size(b) == 1)
        return (F.size(a) > 0) & (F.size(b) > 0) & (F.try_element_at(a, F.lit(-1)) == F.try_element_at(b, F.lit(-1))) & (single | (common >= 2))

    return let(_class_words(expansion), lambda a: let(_class_words(kind), lambda b: of(a, b)))


def _grounded_first(grounded: Callable[[Column], Column]) -> Column:
    """Expansions with grounded ones first, else in their order: structs with text and key."""
    row = lambda r, i: F.struct((~grounded(r["key"])).cast("int").alias("tier"), i.alias("i"), r["text"].alias("text"), r["key"].alias("key"))
    return F.array_sort(F.transform(_keyed(_texts(F.col("expansions"))), row))


def _discovery(primary: Column, ctx: Column) -> Column:
    def rows(types: Column) -> Column:
        found = _grounded_first(lambda key: F.exists(types, lambda t: is_of_type(key, t)))
        return F.filter(found, lambda r: (r["key"] != "") & (r["key"] != primary) & ((primary == "") | ~(F.contains(primary, r["key"]) | F.contains(r["key"], primary))))

    def probe(r: Column) -> Column:
        def add(kept: Column, c: Column) -> Column:
            known = F.contains(r["key"], c["key"]) | F.exists(kept, lambda k: F.contains(k["key"], c["key"]))
            return F.when(known, kept).otherwise(F.concat(kept, F.array(c)))

        needs = F.aggregate(ctx, F.array().cast("array<struct<key:string,text:string>>"), add)
        text = let(needs, lambda n: F.when(F.size(n) > 0, F.concat(r["text"], F.lit(" suitable for "), listed(n["text"]))).otherwise(r["text"]))
        return F.struct(F.lit("EXPANSION").alias("kind"), F.trim(F.substring(text, 1, PROBE_CHARS)).alias("text"))

    return F.transform(F.slice(_once(let(_keys(_texts(F.col("catalog_types"))), rows)), 1, 4), probe)


def _complement(primary: Column, identity: Column) -> Column:
    empty = F.array().cast("array<struct<kind:string,text:string,key:string>>")

    def rows(own: Column, values: Column) -> Column:
        found = _grounded_first(lambda key: F.exists(values, lambda v: names_the_same(key, v)))
        return F.filter(found, lambda r: (r["key"] != "") & (r["key"] != primary) & F.exists(_words(r["key"]), lambda w: ~F.array_contains(own, w)))

    def paired(reference: Column) -> Column:
        pair = F.trim(F.substring(F.concat(F.coalesce(identity, F.col("semantic_query"), F.col("query")), F.lit(" ; pair with "), reference), 1, PAIR_CHARS))
        return let(F.struct(F.lit("PAIR").alias("kind"), pair.alias("text"), semantic_fold(pair).alias("key")), lambda p: F.when(reference.isNotNull() & (p["key"] != primary), F.array(p)).otherwise(empty))

    def of(references: Column) -> Column:
        own = F.flatten(F.transform(references, lambda v: _words(semantic_fold(v))))
        found = let(own, lambda o: let(_keys(_texts(F.col("catalog_values"))), lambda values: rows(o, values)))
        rest = lambda first: F.filter(_once(found), lambda r: ~F.exists(first, lambda p: p["key"] == r["key"]))
        said = lambda r: F.struct(F.lit("EXPANSION").alias("kind"), F.substring(r["text"], 1, PAIR_CHARS).alias("text"))
        plain = lambda first: F.transform(first, lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("text")))
        return let(paired(F.try_element_at(references, F.lit(1))), lambda first: F.concat(plain(first), F.transform(rest(first), said)))

    return F.slice(let(_texts(F.col("reference_terms")), of), 1, 4)


def _direct(primary: Column, ctx: Column) -> Column:
    whole = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), F.trim(text).alias("text")))

    def facet(key: Column, barred: Column, raw: Column) -> Column:
        rows = F.filter(raw, lambda r: ~r["text"].rlike(r"^\s*\d+([.,]\d+)?\s*$") & ~F.array_contains(barred, r["key"]))
        rows = F.slice(F.filter(_once(rows), lambda r: ~F.contains(key, r["key"])), 1, 4)
        return let(rows, lambda own: F.when(F.size(own) > 0, F.substring(F.concat(primary, F.lit(" with "), listed(own["text"])), 1, PROBE_CHARS)).otherwise(""))

    def residual(key: Column, barred: Column, raw: Column) -> Column:
        known = F.concat(_words(key), F.flatten(F.transform(raw, lambda r: _words(r["key"]))), F.flatten(F.transform(barred, _words)))
        words = _words(semantic_fold(F.coalesce("semantic_query", "query")))
        left = let(known, lambda own: F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(own, w) & ~_in(RESIDUAL_STOP, w))))
        return let(left, lambda own: F.when(F.size(own) > 0, F.substring(F.concat(primary, F.lit(" for "), F.array_join(own, " ")), 1, PROBE_CHARS)).otherwise(""))

    def expansions(key: Column, barred: Column) -> Column:
        rows = _once(F.filter(_keyed(_texts(F.col("expansions"))), lambda r: ~F.array_contains(barred, r["key"])))
        rows = F.slice(F.filter(rows, lambda r: r["key"] != key), 1, 2)
        wide = lambda v: F.when(F.size(ctx) > 0, F.substring(F.concat(v, F.lit(" suitable for "), listed(ctx["text"])), 1, EXPANSION_CHARS)).otherwise(v)
        return F.transform(rows, lambda r: F.struct(F.lit("EXPANSION").alias("kind"), F.trim(wide(r["text"])).alias("text")))

    def of(key: Column, barred: Column, raw: Column) -> Column:
        rows = F.concat(whole("IDENTITY", F.coalesce(_identity_words(), F.lit(""))), whole("FACETS", facet(key, barred, raw)), whole("RESIDUAL", residual(key, barred, raw)), expansions(key, barred))
        rows = F.transform(rows, lambda r: F.struct(r["kind"].alias("kind"), r["text"].alias("text"), semantic_fold(r["text"]).alias("key")))
        rows = F.slice(_once(F.filter(rows, lambda r: (r["text"] != "") & (r["key"] != key))), 1, 3)
        return F.transform(rows, lambda r: F.struct(r["kind"].alias("kind"), r["text"].alias("text")))

    return let(semantic_fold(primary), lambda key: let(_keys(_texts(F.col("negatives"))), lambda barred: let(_keyed(_texts(F.col("facets"))), lambda raw: of(key, barred, raw))))


def _identity_words() -> Column:
    """The first type that names a product, in words that do; facets are not taken from it."""
    def words(v: Column) -> Column:
        own = F.filter(_words(semantic_fold(v)), lambda w: (((F.length(w) >= 2) & ~_in(CONTEXT_STOP, w)) | _in(IDENTITY_LETTERS, w)) & ~_in(AUDIENCE_WORDS, w))
        return F.array_join(own, " ")

    return F.try_element_at(F.filter(F.transform(_texts(F.col("types")), words), lambda v: v != ""), F.lit(1))


def demand_probes(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """The probes of each profile, the primary text first: keys, probe (from 0), kind and text.

    DIRECT: the product's identity, the text with its facets, with what is
    left of the query beyond these, and two expansions with all contexts;
    three at most. DISCOVERY: expansions that neither hold the primary text
    nor are held by it, those of a catalog type first, each with the contexts
    it lacks; four at most. COMPLEMENT: the target with its reference, then
    expansions that are not the reference again, those of a catalog value
    first; four at most. Texts that fold alike come once, ruled-out ones
    never. An unknown mode has its primary text alone; null arrays are empty, null values in them left out.
    """
    empty = F.array().cast("array<struct<kind:string,text:string>>")
    text = lambda c: F.when(_squashed(F.col(c)) != "", F.col(c))
    rows = spread(profiles, *keys).withColumns({c: text(c) for c in ("query", "semantic_query", "intent")})
    identity = F.try_element_at(_texts(F.col("types")), F.lit(1))
    direct = F.coalesce("query", "semantic_query", "intent", _identity_words(), F.lit(""))
    wide = F.coalesce("intent", "semantic_query", "query", F.lit(""))
    paired = F.coalesce("semantic_query", "intent", "query", F.lit(""))
    rows = rows.withColumns({"_ctx": contexts(), "_primary": F.when(F.col("mode") == "DISCOVERY", wide).when(F.col("mode") == "COMPLEMENT", paired).otherwise(direct)})
    mode, primary, ctx = (F.col(c) for c in ("mode", "_primary", "_ctx"))
    wider = let(semantic_fold(primary), lambda key: F.when(mode == "DISCOVERY", _discovery(key, ctx)).when(mode == "COMPLEMENT", _complement(key, identity)))
    more = F.when(mode == "DIRECT", _direct(primary, ctx)).otherwise(wider)
    first = F.array(F.struct(F.lit("PRIMARY").alias("kind"), F.col("_primary").alias("text")))
    every = F.concat(first, F.filter(F.coalesce(more, empty), lambda r: r["text"] != ""))
    return rows.select(*keys, F.posexplode(every).alias("probe", "r")).select(*keys, "probe", "r.kind", "r.text")
