"""Context terms, identity matches, span winners and the typed re-rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.queries import bound
from ..functions.text import contains_phrase, tokens
from .ranking import ranked, top

# Kinds that count for context only on a strong mention, and the least score of a context term.
STRONG_ONLY = ("ATTRIBUTE", "VARIANT", "VARIANT_OPTION", "MEASUREMENT", "TAG", "VENDOR", "SKU", "BRAND", "MODEL", "IDENTIFIER")
MIN_CONTEXT = 8.0
# Which field wins a span that several share, at equal confidence.
FIELD_PRIORITY = {"IDENTIFIER": 100, "MODEL": 90, "PRODUCT_TYPE": 80, "BRAND": 70, "COMPATIBILITY": 60, "MEASUREMENT": 55, "AUDIENCE": 50, "ATTRIBUTE": 40, "CATEGORY": 30, "CONTEXT": 20, "ALIAS": 10}


def context_scores(signals: DataFrame, terms: DataFrame) -> DataFrame:
    """Score of each shop term for each query by its best signal: (query_id, kind, norm_value, score).

    signals: query_id, shop, signal, weight; terms: shop, kind, norm_value,
    products. Signals and terms meet on a shared token; equal text counts 30,
    containment of several words 15, else shared tokens and both coverages.
    """
    s = signals.withColumn("sw", F.array_distinct(tokens(F.col("signal"))))
    t = terms.withColumn("tw", F.array_distinct(tokens(F.col("norm_value"))))
    pairs = s.withColumn("token", F.explode("sw")).join(t.withColumn("token", F.explode("tw")), ["shop", "token"])
    pairs = pairs.dropDuplicates(["query_id", "signal", "shop", "kind", "norm_value"])
    common = F.size(F.array_intersect("sw", "tw"))
    exact = F.col("signal") == F.col("norm_value")
    inside = (contains_phrase(F.col("signal"), F.col("norm_value")) | contains_phrase(F.col("norm_value"), F.col("signal"))) & (F.size("sw") > 1) & (F.size("tw") > 1)
    loose = F.when((common >= 2) & ~F.col("kind").isin(*STRONG_ONLY), common * 2 + common / F.size("tw") * 6 + common / F.size("sw") * 5).otherwise(0.0)
    score = F.when(exact, 30.0).when(inside, 15.0).otherwise(F.when(F.col("kind") != "PRODUCT_TITLE", loose).otherwise(0.0)) * F.col("weight")
    best = pairs.withColumn("score", score).groupBy("query_id", "shop", "kind", "norm_value", "products").agg(F.max("score").alias("score")).where("score > 0")
    bonus = F.least(F.lit(2.0), F.log2(F.col("products") + 1) * 0.35)
    return best.withColumn("score", F.round(F.col("score") + bonus, 6))


def context_terms(scores: DataFrame, most: int) -> DataFrame:
    """The best terms of each query: a text that is a canonical type hides its other kinds, each text once."""
    typed = F.max(F.when(F.col("kind") == "CANONICAL_PRODUCT_TYPE", 1).otherwise(0)).over(W.partitionBy("query_id", "norm_value"))
    rows = scores.where(F.col("score") >= MIN_CONTEXT).withColumn("_typed", typed).where("_typed = 0 OR kind = 'CANONICAL_PRODUCT_TYPE'").drop("_typed")
    once = top(rows, ["query_id", "norm_value"], [F.desc("score"), "kind"])
    return ranked(once, "query_id", [F.desc("score"), "norm_value"]).where(F.col("rank") <= most)


def same_word(a: Column, b: Column) -> Column:
    """Whether two words are equal or one is a plural of the other."""
    plural_of = lambda x, y: (y == F.concat(x, F.lit("s"))) | (y == F.concat(x, F.lit("es"))) | (x.endswith("y") & (F.length(x) > 3) & (y == F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit("ies"))))
    return (a == b) | ((F.length(a) >= 3) & (F.length(b) >= 3) & (plural_of(a, b) | plural_of(b, a)))


def identity_score(term: Column, signal: Column, fallback: Column) -> Column:
    """How far a catalog type is the product a query names, from 0 to 1; fallback: the signal is the whole query, not a named product.

    Nothing in common, another head noun, or a further noun behind the
    signal's words give 0; a signal of one word is met; a type of one word
    within a fallback signal counts 0.9; else the larger coverage, if the
    signal's is half at least.
    """

    def of(x: Column) -> Column:
        t, s, fallback = x["t"], x["s"], x["fallback"]
        has = lambda words, w: F.exists(words, lambda v: same_word(v, w))
        common = F.size(F.filter(F.array_distinct(s), lambda w: has(t, w)))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - F.size(s), F.lit(0))), lambda i: F.forall(F.transform(s, lambda w, j: same_word(w, F.coalesce(F.get(t, i + j), F.lit("")))), lambda y: y))
        followed = (F.size(t) > F.size(s)) & (F.size(starts) > 0) & (F.get(starts, F.lit(0)) + F.size(s) < F.size(t))
        own, other = common / F.size(F.array_distinct(s)), common / F.size(F.array_distinct(t))
        return (
            F.when(F.array_join(t, " ") == F.array_join(s, " "), 1.0)
            .when((common == 0) | ((F.size(F.array_distinct(s)) >= 2) & ~has(t, F.try_element_at(s, F.lit(-1)))) | followed, 0.0)
            .when(F.size(s) == 1, 1.0)
            .when(fallback & (F.size(t) == 1) & (common == 1) & (F.length(t[0]) >= 3), 0.9)
            .when((common >= 2) & (own >= 0.5), F.greatest(own, other))
            .otherwise(0.0)
        )

    return bound(F.struct(tokens(term).alias("t"), tokens(signal).alias("s"), fallback.alias("fallback")), of)


# Fields whose last words may turn out to be the product, and how many more products those must have.
SUFFIX_FIELDS, SUFFIX_SUPPORT = ("ATTRIBUTE", "ALIAS", "CATEGORY"), 3


def span_winners(matches: DataFrame) -> DataFrame:
    """The matches of each query that stand: query_id, phrase, field, start, n, confidence.

    matches: query_id, phrase, field, confidence, start, n, products. Of the
    matches on one phrase the surest stays, by field where equal. A product
    type that begins with an attribute and ends with another product type
    gives way to these two; words at its end that name far more products
    become a product type for that. Then a match inside a longer one of its
    field goes, and so does one inside a product type, unless it is an
    attribute of one word at its beginning. The few matches of a query are
    one array.
    """
    priority = F.create_map(*[F.lit(x) for kv in FIELD_PRIORITY.items() for x in kv])[F.col("field")]
    best = top(matches.withColumn("_p", F.coalesce(priority, F.lit(0))), ["query_id", "phrase"], [F.desc("confidence"), F.desc("_p"), "field"])
    span = F.struct("start", (F.col("start") + F.col("n")).alias("end"), "n", "phrase", "field", "confidence", "products")
    spans = best.groupBy("query_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    typed = lambda m: m["field"] == "PRODUCT_TYPE"
    led = lambda all_, m, least: F.exists(all_, lambda x: (x["field"] == "ATTRIBUTE") & (x["start"] == m["start"]) & (x["end"] < m["end"]) & (x["confidence"] >= least))

    def promote(all_: Column) -> Column:
        weak = F.filter(all_, lambda m: typed(m) & (m["confidence"] <= 0.92) & led(all_, m, 0.5))
        wide = lambda m: m["field"].isin(*SUFFIX_FIELDS) & F.exists(weak, lambda i: (m["start"] > i["start"]) & (m["end"] == i["end"]) & (m["products"] >= F.greatest(F.lit(SUFFIX_SUPPORT), i["products"] * SUFFIX_SUPPORT)))
        return F.transform(all_, lambda m: F.when(wide(m), m.withField("field", F.lit("PRODUCT_TYPE")).withField("confidence", F.greatest(m["confidence"], F.lit(0.8)))).otherwise(m))

    def keep(all_: Column) -> Column:
        splits = lambda m: typed(m) & led(all_, m, 0.0) & F.exists(all_, lambda x: typed(x) & (x["start"] > m["start"]) & (x["end"] == m["end"]))
        wider = lambda o, m: (o["start"] <= m["start"]) & (o["end"] >= m["end"]) & ((o["start"] < m["start"]) | (o["end"] > m["end"]))
        dominated = lambda m: F.exists(all_, lambda o: (o["field"] == m["field"]) & ~splits(o) & wider(o, m))
        owner = lambda m: F.get(F.filter(all_, lambda o: typed(o) & wider(o, m)), F.lit(0))
        leads = lambda m: (m["field"] == "ATTRIBUTE") & (m["n"] == 1) & (m["start"] == owner(m)["start"]) & (m["end"] < owner(m)["end"])
        return F.filter(all_, lambda m: ~splits(m) & ~dominated(m) & (typed(m) | owner(m).isNull() | leads(m)))

    kept = spans.select("query_id", F.explode(bound(bound(F.col("spans"), promote), keep)).alias("m"))
    return kept.select("query_id", "m.phrase", "m.field", "m.start", "m.n", "m.confidence")


# Words of a rest that say nothing about products.
CONTROL_WORDS = ("only", "just", "exactly", "please", "show", "find", "need", "want", "chi", "chỉ", "dung", "đúng")
# Fields that refine a product softly, and fields that fix it.
SOFT_FIELDS, FIRM_FIELDS = ("ATTRIBUTE", "CONTEXT", "AUDIENCE"), ("BRAND", "MODEL", "IDENTIFIER", "COMPATIBILITY", "MEASUREMENT")


def query_routes(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """How each query is to be answered, and why: (query_id, route, reason).

    queries: query_id, unresolved (segments of words that no term explains),
    measured (number of measurements), is_complex, is_conflicting; matches:
    query_id, field, confidence.
    """
    f, sure = F.col("field"), F.col("confidence")
    has = lambda test, name: F.coalesce(F.bool_or(test), F.lit(False)).alias(name)
    flags = matches.groupBy("query_id").agg(
        F.count("*").alias("n"), has((f == "IDENTIFIER") & (sure == 1), "exact"), has((f == "MODEL") & (sure >= 0.99), "model"), has((f == "BRAND") & (sure >= 0.9), "brand"),
        has(f == "PRODUCT_TYPE", "typed"), has((f == "ALIAS") & (sure >= 0.8), "alias"), has((f == "CATEGORY") & (sure >= 0.9), "category"), has(f.isin(*SOFT_FIELDS) & (sure >= 0.5), "soft"),
        has(f.isin(*FIRM_FIELDS) & (sure >= 0.9), "firm_match"),
    )
    names = ("exact", "model", "brand", "typed", "alias", "category", "soft", "firm_match")
    rows = queries.join(flags, "query_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), **{c: F.coalesce(c, F.lit(False)) for c in names}})
    c = {n: F.col(n) for n in names}
    rest_words = F.filter(F.split(F.lower(F.array_join("unresolved", " ")), " +"), lambda w: w != "")
    open_rest = F.exists(rest_words, lambda w: ~w.isin(*CONTROL_WORDS))
    done, identity, firm = F.size("unresolved") == 0, c["typed"] | c["alias"], (F.col("measured") > 0) | c["firm_match"]
    named = c["model"] & ~open_rest & (identity | c["brand"] | (F.col("measured") > 0) | done)
    ladder = [
        (c["exact"], "STRUCTURED_ONLY", "EXACT_IDENTIFIER"),
        (named, "STRUCTURED_ONLY", "STRONG_EXACT_MODEL"),
        (F.col("is_complex"), "FULL_LLM", "COMPLEX_RELATION_OR_NEGATION"),
        (F.col("is_conflicting"), "FULL_LLM", "CONFLICTING_CONSTRAINTS"),
        (done & ~identity & c["category"] & c["soft"], "LIGHT_LLM", "BROAD_CATEGORY_CONTEXT_DISCOVERY"),
        (done & c["typed"] & c["soft"], "CODE_SEMANTIC", "IDENTITY_WITH_SOFT_SEMANTIC_MODIFIER"),
        (done & c["typed"] & (F.col("n") <= 2), "STRUCTURED_ONLY", "DICTIONARY_FULLY_RESOLVED"),
        (done & c["typed"], "CODE_SEMANTIC", "DICTIONARY_FULLY_RESOLVED"),
        (done & c["alias"], "CODE_SEMANTIC", "IDENTITY_ALIAS_RESOLVED"),
        (done & firm, "STRUCTURED_ONLY", "STRUCTURED_CONSTRAINTS_FULLY_RESOLVED"),
        (done & (F.col("n") > 0), "CODE_SEMANTIC", "NON_IDENTITY_TERMS_FULLY_RESOLVED"),
        (identity & open_rest & (F.size(rest_words) >= 3), "LIGHT_LLM", "IDENTITY_WITH_SUBSTANTIAL_SEMANTIC_REMAINDER"),
        (identity & open_rest, "LIGHT_LLM", "IDENTITY_WITH_UNGROUNDED_SEMANTIC_REMAINDER"),
        (identity, "VECTOR_SEMANTIC", "IDENTITY_RESOLVED_CONTROL_REMAINDER"),
        ((F.size("unresolved") <= 1) & (F.col("n") > 0), "LIGHT_LLM", "PARTIALLY_RESOLVED_SINGLE_REMAINDER"),
    ]
    out = F.when(F.lit(False), F.struct(F.lit("").alias("route"), F.lit("").alias("reason")))
    for test, route, reason in ladder:
        out = out.when(test, F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason")))
    out = out.otherwise(F.struct(F.lit("FULL_LLM").alias("route"), F.lit("IDENTITY_UNRESOLVED_OR_AMBIGUOUS").alias("reason")))
    return rows.select("query_id", out.alias("r")).select("query_id", "r.route", "r.reason")


# Kinds that an expansion may add to a query's own terms.
EXPANDABLE = ("ATTRIBUTE", "AUDIENCE", "CONTEXT", "COMPATIBILITY")


def merge_terms(source: DataFrame, expansion: DataFrame, negatives: DataFrame) -> DataFrame:
    """A query's terms: its own, and of an expansion those that refine it, plus one product type if it has none of its own.

    source, expansion: query_id, kind, norm_value, mode; negatives: query_id,
    norm_value, whose terms become MUST_NOT. Each kind and value stays once, the query's own first.
    """
    typed = source.where("kind = 'PRODUCT_TYPE'").select("query_id").distinct()
    one = top(expansion.where("kind = 'PRODUCT_TYPE'").join(typed, "query_id", "left_anti"), "query_id", ["norm_value"])
    more = expansion.where(F.col("kind").isin(*EXPANDABLE)).unionByName(one)
    rows = source.withColumn("_source", F.lit(0)).unionByName(more.withColumn("_source", F.lit(1)))
    rows = top(rows, ["query_id", "kind", "norm_value"], ["_source", "mode"]).drop("_source")
    no = negatives.select("query_id", "norm_value", F.lit(True).alias("_no")).distinct()
    return rows.join(no, ["query_id", "norm_value"], "left").withColumn("mode", F.when(F.col("_no"), "MUST_NOT").otherwise(F.col("mode"))).drop("_no")


def owned_terms(queries: DataFrame, terms: DataFrame, least: float = 0.7) -> DataFrame:
    """Extracted terms that a query's own words support: contained whole, or most of their tokens."""
    rows = terms.join(queries.select("query_id", "folded"), "query_id")
    want = F.array_distinct(tokens(F.col("term")))
    cover = F.size(F.array_intersect(want, tokens(F.col("folded")))) / F.size(want)
    return rows.where(contains_phrase(F.col("folded"), F.col("term")) | (cover >= least)).drop("folded")


# Identity from which a product is the one a query names, and the share of typed colours from which colours filter.
NAMED, COLOUR_COVERAGE = 0.75, 0.9


def typed_rerank(candidates: DataFrame, asked: DataFrame, matches: DataFrame, excluded: DataFrame, needed: DataFrame, identity: DataFrame, colours: DataFrame, wanted_colours: DataFrame, most: int) -> DataFrame:
    """Re-rank candidates (query_id, product_id, score, cosine) by the typed facts they match.

    asked: query_id, asked (weight of all positive terms); matches: query_id,
    product_id, weight, soft; excluded: query_id, product_id; needed: those
    that meet all hard groups; identity: query_id, product_id, identity;
    colours: query_id, product_id, colour of candidates; wanted_colours: query_id, colour.

    Excluded products go. Where any candidate meets the hard groups, is the
    named product, or, if nearly all have a typed colour, has a wanted colour, only such
    stay. The matched share of the asked weight becomes a bounded bonus. Order:
    named products, cosine with the query, soft facets met, whole coverage,
    facets met, final score, score, id.
    """
    key, no = ["query_id", "product_id"], F.lit(False)
    per = matches.groupBy(*key).agg(F.sum("weight").alias("weight"), F.count("*").alias("matched"), F.count_if("soft").alias("soft"))
    best = identity.groupBy(*key).agg(F.max("identity").alias("identity"))
    own = colours.join(wanted_colours.select("query_id", "colour", F.lit(True).alias("_asked")).distinct(), ["query_id", "colour"], "left")
    own = own.groupBy(*key).agg(F.lit(True).alias("coloured"), F.coalesce(F.bool_or("_asked"), no).alias("fits_colour"))
    rows = candidates.join(excluded.select(*key).distinct(), key, "left_anti").join(per, key, "left").join(best, key, "left").join(own, key, "left").join(asked, "query_id", "left")
    rows = rows.join(needed.select(*key, F.lit(True).alias("hard")).distinct(), key, "left").join(wanted_colours.select("query_id", F.lit(True).alias("asks_colour")).distinct(), "query_id", "left")
    rows = rows.withColumns({**{c: F.coalesce(c, no) for c in ("hard", "coloured", "fits_colour", "asks_colour")}, **{c: F.coalesce(c, F.lit(0)) for c in ("matched", "soft")}, "named": F.coalesce(F.col("identity") >= NAMED, no)})
    whole = W.partitionBy("query_id")
    rows = rows.withColumn("by_colour", F.col("asks_colour") & (F.avg(F.col("coloured").cast("int")).over(whole) >= COLOUR_COVERAGE))
    for test in ("hard", "named"):
        rows = rows.withColumn("_any", F.bool_or(test).over(whole)).where(f"{test} OR NOT _any").drop("_any")
    rows = rows.withColumn("_any", F.bool_or(F.col("by_colour") & F.col("fits_colour")).over(whole)).where("NOT _any OR fits_colour").drop("_any")
    cover = F.coalesce(F.col("weight") / F.col("asked"), F.lit(0.0))
    base = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(0.995))
    rows = rows.withColumns({"cover": F.round(cover, 6), "final": F.round(base + (0.995 - base) * F.least(cover * 0.7, F.lit(0.7)), 6)})
    order = [F.desc("named"), F.coalesce("cosine", F.lit(-1.0)).desc(), F.desc("soft"), (F.col("cover") >= 1).desc(), F.desc("matched"), F.desc("final"), F.desc("score"), "product_id"]
    return ranked(rows, "query_id", order, "final_rank").where(F.col("final_rank") <= most)
