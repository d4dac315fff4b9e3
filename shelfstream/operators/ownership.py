"""Which extracted targets and constraints a query's own words support, and in which mode it is then searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_fold, tokens

# Words behind which a noun is context, words that a quality describes, and phrases that ask for what follows.
BOUNDARIES = "for with on at from using without while when during about around because to".split()
UNNAMED = r"\b(something|anything|nothing|thing|things)( (very|quite|really|more|less))?$"
REQUEST = r"(^| )(need|want|find|buy|get|looking for|show me|can|muon|tim|mua)( (a|an|some|the|my|your|mot|chiec|cai))?( [a-z0-9]+){0,4}$"
SHORT_QUERY, NAMED_SHARE = 6, 0.7


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def contains_words(folded: Column, phrase: Column) -> Column:
    return (phrase != "") & F.contains(_padded(folded), _padded(phrase))


def owns_target(folded: Column, start: Column) -> Column:
    """Whether the words from ``start`` (from 0) of a folded query are what it asks for, not context of it."""
    words = tokens(folded)
    boundary = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(w.isin(*BOUNDARIES), i)), lambda i: i.isNotNull()))
    before = F.slice(words, 1, F.greatest(start, F.lit(0)))
    tail = F.array_join(F.slice(before, F.greatest(F.size(before) - 5, F.lit(1)), 6), " ")
    return (
        F.when(F.size(words) == 0, False)
        .when(F.array_join(before, " ").rlike(UNNAMED), False)
        .when(F.coalesce(start > boundary, F.lit(False)), False)
        .when((F.size(words) <= SHORT_QUERY) | (start <= 0) | tail.rlike(REQUEST), True)
        .otherwise(boundary.isNull() | (start < boundary))
    )


def _concepts(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts (query_id, target, source) whose source stands in the query, with its first place there."""
    rows = concepts.select("query_id", query_fold(F.col("target")).alias("target"), query_fold(F.col("source")).alias("source")).join(queries.select("query_id", query_fold(F.col("query")).alias("folded")), "query_id")
    rows = rows.where(contains_words(F.col("folded"), F.col("source")))
    head = F.substring(_padded(F.col("folded")), F.lit(1), F.expr("instr(concat(' ', folded, ' '), concat(' ', source, ' '))"))
    return rows.withColumn("start", F.size(tokens(head)))


def owned_identities(queries: DataFrame, identities: DataFrame, concepts: DataFrame, exact: DataFrame, modifiers: DataFrame) -> DataFrame:
    """The targets of a query's own: query_id, identity, once each.

    queries: query_id, query; identities: query_id, identity; concepts:
    query_id, target, source (the query's words for it); exact: query_id,
    value (constraints that the shopper states); modifiers: query_id, value.
    An identity is owned where a concept whose words the query asks for has
    it as its target, or as its target behind words that are all exact
    constraints. Modifiers at the front of the target are taken off, longer
    ones first. Nothing extracted for a query gives no row.
    """
    words = exact.select("query_id", F.explode(tokens(query_fold(F.col("value")))).alias("w")).groupBy("query_id").agg(F.collect_set("w").alias("exact"))
    front = modifiers.select("query_id", query_fold(F.col("value")).alias("m")).where("m <> ''").distinct()
    front = front.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("m")).alias("n"), "m"))), lambda r: r["m"]).alias("modifiers"))
    none = F.array().cast("array<string>")
    rows = identities.select("query_id", query_fold(F.col("identity")).alias("identity")).where("identity <> ''").join(_concepts(queries, concepts), "query_id")
    rows = rows.join(words, "query_id", "left").join(front, "query_id", "left").withColumns({"exact": F.coalesce("exact", none), "modifiers": F.coalesce("modifiers", none)})
    more = F.filter(tokens(F.col("identity")), lambda w: ~F.array_contains(tokens(F.col("target")), w))
    wraps = F.endswith(F.col("identity"), F.concat(F.lit(" "), F.col("target"))) & (F.size(more) > 0) & F.forall(more, lambda w: F.array_contains(F.col("exact"), w))
    rows = rows.where(((F.col("identity") == F.col("target")) | wraps) & owns_target(F.col("folded"), F.col("start")))
    bare = F.aggregate("modifiers", F.col("target"), lambda t, m: F.when(F.startswith(t, F.concat(m, F.lit(" "))), F.substring(t, F.length(m) + 2, F.length(t))).otherwise(t))
    return rows.select("query_id", bare.alias("identity")).where("identity <> ''").distinct()


def owned_constraints(queries: DataFrame, constraints: DataFrame, concepts: DataFrame) -> DataFrame:
    """Constraints (query_id, value) that are the target of a concept whose words stand in the query."""
    here = _concepts(queries, concepts).select("query_id", "target").distinct()
    rows = constraints.withColumn("target", query_fold(F.col("value")))
    return rows.where("target <> ''").join(here, ["query_id", "target"], "left_semi").drop("target").distinct()


def resolved_mode(raw: Column, has_target: Column) -> Column:
    """COMPLEMENT stays; a target of the query's own makes it DIRECT; DISCOVERY stays; anything else is DIRECT."""
    return F.when(raw == "COMPLEMENT", "COMPLEMENT").when(has_target, "DIRECT").when(raw == "DISCOVERY", "DISCOVERY").otherwise("DIRECT")


def names_its_target(folded: Column, musts: Column, route: Column, grounded: Column, mode: Column) -> Column:
    """Whether a query that a model was asked about names its target itself: one required term is the whole query, or they have most of its words."""
    long = lambda c: F.filter(c, lambda w: F.length(w) >= 2)
    own, terms = long(tokens(folded)), F.transform(musts, query_fold)
    required = long(F.flatten(F.transform(terms, tokens)))
    share = F.size(F.filter(own, lambda w: F.array_contains(required, w))) / F.size(own)
    exact = F.array_contains(terms, folded) | ((F.size(own) >= 2) & (share >= NAMED_SHARE))
    return F.coalesce(route.isin("FULL_LLM", "LIGHT_LLM") & ~mode.eqNullSafe(F.lit("COMPLEMENT")) & exact & grounded, F.lit(False))
