"""Which engine answers a search URL, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that do not change what a search means, and the values of two of them that do not.
SAFE_PARAMS = ("q", "type", "page", "sort_by", "options[prefix]")
PLAIN_SORT = ("relevance",)
PLAIN_PREFIX = ("last", "none")
MOST_CHARS, LEAST_CHARS = 500, 3


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def url_params(text: Column) -> Column:
    """The parameters of a query string, in order: structs with key and value, both decoded."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(_decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), _decoded(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)).alias("value")))


def _first(params: Column, key: str) -> Column:
    """The first value of a parameter; null where there is none."""
    return F.try_element_at(F.transform(F.filter(params, lambda p: p["key"] == key), lambda p: p["value"]), F.lit(1))


def unsafe_param(params: Column) -> Column:
    """The first parameter that may change what the search means; null where there is none."""
    return F.try_element_at(F.transform(F.filter(params, lambda p: ~p["key"].isin(*SAFE_PARAMS)), lambda p: p["key"]), F.lit(1))


def is_search_syntax(query: Column) -> Column:
    """Wildcards, Boolean operators in capitals, field:value, or a whole text in quotes."""
    return query.rlike(r"\*") | query.rlike(r"\b(AND|OR|NOT)\b") | query.rlike(r"^[^\s:]+:[^\s]+") | query.rlike(r"\s[^\s:]+:[^\s]+") | query.rlike(r"""^"(.+)"$""") | query.rlike(r"""^'(.+)'$""")


def search_route(query: Column, target: Column) -> Column:
    """Struct of ``engine`` (AI or NATIVE) and ``reason``, the first that applies.

    AI answers a query of 3 to 500 characters without search syntax for a
    search path whose type is product alone and whose other parameters are
    safe ones with values that keep the order by relevance. A null query
    counts as empty; a null target is no search path.
    """
    q = F.trim(F.coalesce(query, F.lit("")))
    plain = F.split_part(F.coalesce(target, F.lit("")), F.lit("#"), F.lit(1))
    path, text = F.split_part(plain, F.lit("?"), F.lit(1)), F.regexp_extract(plain, r"^[^?]*\??(.*)$", 1)
    known = F.coalesce(target, F.lit("")).rlike(r"^/(?!/)") & ~F.contains(F.coalesce(target, F.lit("")), F.lit("..")) & path.rlike(r"(?i)/search/?$")
    params = url_params(text)
    given = F.flatten(F.transform(F.filter(params, lambda p: p["key"] == "type"), lambda p: F.split(p["value"], ",")))
    types = F.array_distinct(F.filter(F.transform(given, lambda v: F.lower(F.trim(v))), lambda v: v != ""))
    page = _first(params, "page")
    number = F.regexp_extract(page, r"^\s*([+-]?\d{1,15})", 1)
    bad_page = (page != "") & ((number == "") | (number.try_cast("long") < 1))
    value = lambda key: F.coalesce(F.lower(F.trim(_first(params, key))), F.lit(""))
    sort, prefix, unsafe = value("sort_by"), value("options[prefix]"), unsafe_param(params)
    reason = (
        F.when(q == "", "EMPTY_QUERY")
        .when(F.length(q) > MOST_CHARS, "QUERY_TOO_LONG")
        .when(F.length(q) < LEAST_CHARS, "QUERY_TOO_SHORT_FOR_SEMANTIC")
        .when(is_search_syntax(q), "QUERY_SYNTAX")
        .when(~known, "NATIVE_SEARCH_CONTEXT_MISSING")
        .when(F.size(types) == 0, "SEARCH_TYPES_UNSCOPED")
        .when((F.size(types) > 1) | (types[0] != "product"), "SEARCH_TYPES_NOT_PRODUCT_ONLY")
        .when(unsafe.isNotNull(), F.concat(F.lit("UNSUPPORTED_SEARCH_PARAM:"), unsafe))
        .when(F.coalesce(bad_page, F.lit(False)), "INVALID_PAGE")
        .when((sort != "") & ~sort.isin(*PLAIN_SORT), "NON_RELEVANCE_SORT")
        .when((prefix != "") & ~prefix.isin(*PLAIN_PREFIX), "UNSUPPORTED_PREFIX_MODE")
    )
    return F.struct(F.when(reason.isNull(), "AI").otherwise("NATIVE").alias("engine"), F.coalesce(reason, F.lit("SEMANTIC_PRODUCT_SEARCH")).alias("reason"))
