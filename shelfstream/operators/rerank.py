"""Typed re-rank from a table of features: one row per candidate and signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from .ranking import ranked

_TYPES = ("CANONICAL_PRODUCT_TYPE", "PRODUCT_TYPE", "ALIAS")
# Kinds of facts that a kind of signal is looked for in (empty: any), hard kinds, and the bars of the filters.
SIGNAL_FACTS: dict[str, tuple[str, ...]] = {
    "IDENTIFIER": ("IDENTIFIER", "SKU", "BARCODE"), "MODEL": ("MODEL",), "BRAND": ("BRAND", "VENDOR"), "COMPATIBILITY": ("COMPATIBILITY",), "NUMERIC": ("MEASUREMENT", "VARIANT_OPTION"),
    "IDENTITY": _TYPES, "REFERENCE": _TYPES, "EXPANSION": (*_TYPES, "CATEGORY"), "CATEGORY": ("CATEGORY",), "AUDIENCE": ("AUDIENCE",), "COLOUR": ("COLOUR",),
    "ATTRIBUTE": ("ATTRIBUTE",), "FACET": ("ATTRIBUTE", "VARIANT_OPTION", "USE_CASE"), "NEED": (), "SOURCE": (), "NEGATIVE": (),
}
HARD_KINDS = ("BRAND", "MODEL", "IDENTIFIER", "COMPATIBILITY", "NUMERIC")
MALE, FEMALE = ("men", "man", "male", "boys", "boy", "nam"), ("women", "woman", "female", "girls", "girl", "nu")
MATCHED, HALF, WEAK, COLOURED, CEILING, MOST_BONUS = 0.75, 0.5, 0.34, 0.9, 0.995, 0.7
KEY = ["query_id", "product_id"]


def signal_features(candidates: DataFrame, signals: DataFrame, facts: DataFrame) -> DataFrame:
    """How far each candidate has each signal of its query: query_id, product_id, kind, value, hard, coverage, exact.

    Coverage is the largest share of the signal's distinct words that one
    fitting fact has, 0 where there is none; exact is whether a fact equals it.
    """
    fits = F.array(*[F.lit(f"{s}:{f}") for s, kinds in SIGNAL_FACTS.items() for f in kinds])
    free = [s for s, kinds in SIGNAL_FACTS.items() if not kinds]
    own = candidates.select(*KEY).distinct().join(signals.select("query_id", "kind", "value", "hard"), "query_id")
    f = facts.select("product_id", F.col("kind").alias("fact"), F.col("norm_value").alias("fact_value"))
    near = own.join(f, "product_id").where(F.col("kind").isin(*free) | F.array_contains(fits, F.concat_ws(":", "kind", "fact")))
    want = F.array_distinct(tokens(F.col("value")))
    share = F.size(F.array_intersect(want, tokens(F.col("fact_value")))) / F.size(want)
    best = near.groupBy(*KEY, "kind", "value").agg(F.max(F.when(F.size(want) > 0, share).otherwise(0.0)).alias("coverage"), F.bool_or(F.col("value") == F.col("fact_value")).alias("exact"))
    rows = own.groupBy(*KEY, "kind", "value").agg(F.bool_or("hard").alias("hard")).join(best, [*KEY, "kind", "value"], "left")
    return rows.select(*KEY, "kind", "value", "hard", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("exact", F.lit(False)).alias("exact"))


def _known(facts: DataFrame) -> DataFrame:
    """What is known of each product: typed identity, category, colour, and for whom it is."""
    has = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    who = lambda words: F.bool_or((F.col("kind") == "AUDIENCE") & F.arrays_overlap(tokens(F.col("norm_value")), F.array(*[F.lit(w) for w in words])))
    return facts.groupBy("product_id").agg(has(*_TYPES).alias("has_identity"), has("CATEGORY").alias("has_category"), has("COLOUR").alias("has_colour"), who(MALE).alias("male"), who(FEMALE).alias("female"))


def rerank_rows(candidates: DataFrame, signals: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates with the sums of their features, the filter that drops them (null: none), bonus and final score.

    candidates: query_id, product_id, score, cosine, mode, target_evidence
    (dense evidence of the target itself). signals: query_id, kind, value
    (folded), hard, fallback. facts: product_id, kind, norm_value.

    Filters, the first that applies: AUDIENCE (the product is for the other
    sex alone), COLOUR (nearly all candidates have a typed colour, this one
    another than the wanted ones), REFERENCE (it is what the wanted one goes
    with), IDENTITY (a target of the shopper's own, or one that candidates
    ground, and the product is known as something else), NEGATIVE, CATEGORY
    (some candidate has the category, this one a known other one), and the
    hard kinds. Open needs, facets and expansions never filter.
    """
    no, zero = F.lit(False), F.lit(0.0)
    feats = signal_features(candidates, signals, facts)
    of = lambda kind: F.col("kind") == kind
    most = lambda kind: F.coalesce(F.max(F.when(of(kind), F.col("coverage"))), zero)
    hits = lambda kind: F.count_if(of(kind) & (F.col("coverage") >= MATCHED))
    share = lambda kind: F.coalesce(hits(kind) / F.nullif(F.count_if(of(kind)), F.lit(0)), zero)
    per = feats.groupBy(*KEY).agg(
        *[most(k).alias(k.lower()) for k in ("IDENTITY", "REFERENCE", "CATEGORY", "AUDIENCE", "COLOUR", "ATTRIBUTE", "EXPANSION", *HARD_KINDS)],
        hits("FACET").alias("facets"), share("NEED").alias("need"), share("SOURCE").alias("source"),
        F.coalesce(F.bool_or(of("NEGATIVE") & (F.col("coverage") >= 1)), no).alias("excluded"),
    )
    asked = signals.groupBy("query_id").agg(
        *[F.coalesce(F.bool_or(of(k) & F.col("hard")), no).alias(f"asks_{k.lower()}") for k in HARD_KINDS],
        *[F.coalesce(F.bool_or(of(k)), no).alias(f"asks_{k.lower()}") for k in ("COLOUR", "CATEGORY", "REFERENCE")],
        F.coalesce(F.bool_or(of("AUDIENCE") & F.col("value").isin(*MALE)), no).alias("for_male"), F.coalesce(F.bool_or(of("AUDIENCE") & F.col("value").isin(*FEMALE)), no).alias("for_female"),
        F.coalesce(F.bool_or(of("IDENTITY") & F.col("hard")), no).alias("own_target"), F.coalesce(F.bool_or(of("IDENTITY") & ~F.col("fallback")), no).alias("typed_target"), F.count_if(of("SOURCE")).alias("sources"),
    )
    rows = candidates.join(asked, "query_id", "left").join(per, KEY, "left").join(_known(facts), "product_id", "left")
    flags = [c for c, t in rows.dtypes if t == "boolean"]
    numbers = [c for c in per.columns if c not in (*KEY, "excluded")] + ["sources"]
    rows = rows.withColumns({**{c: F.coalesce(c, no) for c in flags}, **{c: F.coalesce(c, F.lit(0)) for c in numbers}})
    c, whole = F.col, W.partitionBy("query_id")
    aimed = (c("mode") == "DIRECT") | (c("mode") == "COMPLEMENT")
    rows = rows.withColumn("own_target", c("own_target") & aimed)
    grounded = ((c("mode") == "DIRECT") | ((c("mode") == "COMPLEMENT") & c("own_target"))) & (F.max("identity").over(whole) >= HALF) & c("typed_target")
    rows = rows.withColumns({"grounded": grounded, "colour_known": F.avg(c("has_colour").cast("int")).over(whole) >= COLOURED, "in_category": c("asks_category") & (F.max("category").over(whole) >= MATCHED)})
    one_sex = c("for_male") != c("for_female")
    other_sex = one_sex & (c("male") != c("female")) & F.when(c("for_male"), c("female")).otherwise(c("male"))
    another = ~c("target_evidence") & (c("identity") < WEAK)
    dropped = (
        F.when(other_sex, "AUDIENCE")
        .when(c("asks_colour") & c("colour_known") & c("has_colour") & (c("colour") < 1), "COLOUR")
        .when((c("mode") == "COMPLEMENT") & (c("reference") >= MATCHED), "REFERENCE")
        .when((c("own_target") & another) | (c("grounded") & c("has_identity") & another), "IDENTITY")
        .when(c("excluded"), "NEGATIVE")
        .when(c("in_category") & c("has_category") & (c("category") < HALF), "CATEGORY")
    )
    for k in HARD_KINDS:
        dropped = F.coalesce(dropped, F.when(c(f"asks_{k.lower()}") & (c(k.lower()) < HALF), k))
    part = lambda column, weight, top: F.least(F.lit(top), c(column) * weight)
    bonus = (
        F.when(c("grounded"), part("identity", 0.22, 0.24)).otherwise(part("identity", 0.12, 0.14)) + part("attribute", 0.03, 0.03) + F.when(c("sources") >= 2, part("source", 0.08, 0.08)).otherwise(0.0)
        + part("facets", 0.08, 0.08) + F.when(c("mode") == "DISCOVERY", 0.0).otherwise(part("need", 0.1, 0.1)) + part("expansion", 0.08, 0.08)
        + F.least(F.lit(0.08), sum((c(k.lower()) for k in (*HARD_KINDS, "AUDIENCE")), F.lit(0.0)) * 0.02)
    )
    base = F.least(F.greatest(c("score"), zero), F.lit(CEILING))
    return rows.withColumns({"dropped": dropped, "bonus": F.round(bonus, 6), "final": F.round(base + (CEILING - base) * F.least(F.greatest(bonus, zero), F.lit(MOST_BONUS)), 6)})


def sort_keys() -> list[Column]:
    """Target named, demand as a whole, source facets, and, by mode, coverage, facets and grounding; then the scores and the id."""
    c = F.col
    wide, aimed = c("mode") == "DISCOVERY", c("grounded") | c("own_target")
    only = lambda test, value: F.when(test, value.cast("double")).otherwise(0.0).desc()
    return [
        F.when(c("grounded") & (c("identity") >= MATCHED), 2).when(c("own_target") & c("target_evidence"), 1).otherwise(0).desc(),
        F.coalesce("cosine", F.lit(-1.0)).desc(),
        only(c("mode") == "DIRECT", (c("facets") > 0) & (c("identity") >= MATCHED)),
        only(wide & (c("sources") >= 2), c("source") >= 1),
        only(aimed, c("facets")),
        only(wide, c("source") >= MATCHED),
        only(wide, F.round("expansion", 6)),
        only(wide, c("expansion") >= MATCHED),
        c("final").desc(), c("score").desc(), c("product_id"),
    ]


def featured_rerank(candidates: DataFrame, signals: DataFrame, facts: DataFrame, most: int) -> DataFrame:
    """The first ``most`` candidates that no filter drops (see ``rerank_rows``): query_id, product_id, final, final_rank.

    A candidate without facts has no features and is dropped by a hard kind
    or a target of the shopper's own only; a query without signals keeps all.
    """
    rows = rerank_rows(candidates, signals, facts).where("dropped IS NULL")
    return ranked(rows, "query_id", sort_keys(), "final_rank").where(F.col("final_rank") <= most).select(*KEY, "final", "final_rank")
