"""What a shopper's query says beyond its terms: measurements, compatibility, exclusions, intents, audience."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_phrase, meaningful_tokens, query_fold, semantic_fold, tokens

# Words and units of measurements.
SIZES = ("xs", "s", "m", "l", "xl", "xxl", "small", "medium", "large", "xsmall", "xlarge", "xxlarge")
UNITS = ("ml", "l", "gb", "tb", "inch", "cm", "mm", "kg", "g", "w", "mah")
PACKS = ("pack of", "goi", "bo")
# Words that introduce what a product must fit, words that may follow its number, and words that rule it out.
FITS = ("compatible with", "compatibility with", "work with", "works with", "fit", "fits", "fit with", "fits with")
FITS_LOOSELY = ("for", "cho")
VERSION_WORDS = ("pro", "max", "mini", "plus", "ultra")
NO_DEVICE = (
    "size age ages year years month months day days hour hours pack capacity waist inseam toddler toddlers child children kid kids boy boys girl girls men women man woman adult adults"
).split()
DEVICE_FAMILIES = "playstation ps xbox iphone ipad ipod galaxy pixel macbook surface switch rtx gtx".split()
# Words that exclude what follows, and words that end it.
EXCLUDE = ("khong phai", "khong mau", "khong", "loai tru", "ngoai tru", "without", "except", "not")
EXCLUDE_END = ("va", "hoac", "nhung", "phai", "cang", "and", "or", "but")
PRICE_WORDS = ("qua", "hon", "duoi", "tren")
# Phrases of intents.
REQUIRED = ("bat buoc", "phai co", "must", "required")
PREFERRED = ("cang tot", "neu co", "uu tien", "prefer", "ideally")
SORTS = {
    "PRICE_ASC": ("re nhat", "gia tang dan", "thap den cao", "cheapest", "lowest price"),
    "PRICE_DESC": ("dat nhat", "gia giam dan", "cao den thap", "most expensive", "highest price"),
    "NEWEST": ("moi nhat", "hang moi", "newest", "latest"),
}
BUDGET = (
    "gia re", "binh dan", "tiet kiem", "hop tui tien", "budget", "affordable", "inexpensive", "cheap", "low cost", "value for money", "not too expensive", "doesn t cost too much",
    "does not cost too much",
)
PREMIUM = ("cao cap", "hang sang", "luxury", "premium")
ANY_OF, ALL_OF = ("hoac", "or", "either"), ("va", "and", "kem theo", "bo gom")
# Last words that name no product.
GENERIC_FAMILIES = "apparel clothing clothes fashion gear equipment accessory accessories outfit outfits product products item items".split()
# Words of an audience; those of the first list also count in what is excluded.
MALE, MALE_ALSO, MALE_SIGN = ("nam", "male", "man", "men"), ("homme", "hommes"), "男"
FEMALE, FEMALE_ALSO, FEMALE_SIGN = ("nu", "female", "woman", "women"), ("femme", "femmes"), "女"
# Names of assigned facets, kinds of contexts, words that deny the next one.
ASSIGNED = ("color", "colour", "material", "fabric", "finish", "pattern")
CONTEXT_KINDS = ("USE_CASE", "SOFT_CONTEXT")
DENIALS = ("no", "without", "non")
# Fields of an analysis whose presence makes it say something about products.
FACET_TEXTS = ("productType", "category", "subcategory")
FACET_LISTS = ("productTypes", "brands", "models", "identifiers", "audience", "requiredAttributes", "compatibility", "useCases", "semanticMustTerms", "semanticSourceMustTerms")


def bound(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def says(folded: Column, phrases) -> Column:
    """Whether folded text holds one of the phrases as whole words."""
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(padded, F.lit(f" {p} "))
    return out


def measurements(c: Column) -> Column:
    """Measurements a text names, in order: sizes, dimensions, numbers with a unit, packs."""

    def of(words: Column) -> Column:
        at = lambda i: F.coalesce(F.get(words, i), F.lit(""))
        number = lambda t: t.rlike(r"^\d+$")
        two = lambda i: F.concat_ws(" ", at(i), at(i + 1))
        packs = [(p, len(p.split(" "))) for p in PACKS]

        def one(t: Column, i: Column) -> Column:
            out = F.when((t == "size") & (number(at(i + 1)) | at(i + 1).isin(*SIZES)), two(i))
            out = out.when(t.rlike(r"^\d+(x\d+)+[a-z]*$") | t.rlike(rf"^\d+({'|'.join(UNITS)})$"), t).when(number(t) & at(i + 1).isin(*UNITS), two(i))
            for phrase, n in packs:
                said = t == phrase if n == 1 else two(i) == phrase
                out = out.when(said & number(at(i + n)), F.concat_ws(" ", F.lit(phrase), at(i + n)))
            return out.when(t.isin("xl", "xxl") & (at(i - 1) != "size"), t)

        return F.array_compact(F.transform(words, one))

    return bound(tokens(query_fold(c)), of)


def compatibility(c: Column) -> Column:
    """Versioned devices that a product must fit: after a verb of fitting, or after a loose word where the family is a known one."""
    device = rf"(?:an? )?([a-z][a-z0-9]*(?: [a-z][a-z0-9]*){{0,2}} [0-9]{{1,3}}(?: (?:{'|'.join(VERSION_WORDS)}))?)(?: |$)"
    folded = query_fold(c)
    found = lambda verbs: F.regexp_extract_all(folded, F.lit(rf"(?:^| )(?:{'|'.join(sorted(verbs, key=len, reverse=True))}) {device}"), F.lit(1))
    has = lambda x, words: F.arrays_overlap(F.split(x, " "), F.array(*[F.lit(w) for w in words]))
    strict = F.filter(found(FITS), lambda x: ~has(x, NO_DEVICE))
    loose = F.filter(found(FITS_LOOSELY), lambda x: ~has(x, NO_DEVICE) & has(x, DEVICE_FAMILIES))
    return F.array_distinct(F.concat(strict, loose))


def exclusions(c: Column) -> Column:
    """What a text excludes: the words behind a word of exclusion, up to a conjunction or the end."""

    def mark(words: Column) -> Column:
        price = lambda i: F.coalesce(F.get(words, i + 1), F.lit("")).isin(*PRICE_WORDS)
        return F.transform(words, lambda w, i: F.when(w.isin(*EXCLUDE_END) & ~((w == "phai") & (F.coalesce(F.get(words, i - 1), F.lit("")) == "khong")), ";").when((w == "khong") & price(i), "khong_").otherwise(w))

    marked = F.array_join(bound(tokens(query_fold(c)), mark), " ")
    found = F.regexp_extract_all(marked, F.lit(rf"(?:^| )(?:{'|'.join(EXCLUDE)}) ([^;]+)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def sort_intent(folded: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, phrases in SORTS.items():
        out = out.when(says(folded, phrases), name)
    return out.otherwise("RELEVANCE")


def market(folded: Column) -> Column:
    return F.when(says(folded, BUDGET), "BUDGET").when(says(folded, PREMIUM), "PREMIUM").otherwise("ANY")


def relation(folded: Column) -> Column:
    return F.when(says(folded, ANY_OF), "ANY").when(says(folded, ALL_OF), "ALL").otherwise("SINGLE")


def is_complex(folded: Column, excluded: Column) -> Column:
    return (says(folded, ANY_OF) & says(folded, ALL_OF)) | (F.size(excluded) > 1)


def is_conflicting(folded: Column) -> Column:
    return says(folded, BUDGET) & says(folded, PREMIUM)


def is_generic_family(c: Column) -> Column:
    return F.coalesce(F.try_element_at(tokens(query_fold(c)), F.lit(-1)).isin(*GENERIC_FAMILIES), F.lit(False))


def gender(c: Column, excluded: Column) -> Column:
    """MALE or FEMALE where the text, less what it excludes, asks for one of them; excluding one asks for the other."""
    text, out = query_fold(c), query_fold(excluded)
    male, female = says(text, MALE + MALE_ALSO) | F.contains(text, F.lit(MALE_SIGN)), says(text, FEMALE + FEMALE_ALSO) | F.contains(text, F.lit(FEMALE_SIGN))
    no_male, no_female = says(out, MALE) | F.contains(out, F.lit(MALE_SIGN)), says(out, FEMALE) | F.contains(out, F.lit(FEMALE_SIGN))
    wants_male, wants_female = (male & ~no_male) | no_female, (female & ~no_female) | no_male
    return F.when(wants_male & ~wants_female, "MALE").when(wants_female & ~wants_male, "FEMALE")


def has_facets(analysis: Column, status: Column) -> Column:
    """Whether an analysis (JSON) names any facet of products; not for queries outside the catalog or bad JSON."""
    schema = ", ".join([f"{n} string" for n in FACET_TEXTS] + [f"{n} array<string>" for n in FACET_LISTS])

    def of(a: Column) -> Column:
        full = lambda x: F.trim(x) != ""
        out = F.lit(False)
        for n in FACET_TEXTS:
            out = out | F.coalesce(full(a[n]), F.lit(False))
        for n in FACET_LISTS:
            out = out | F.coalesce(F.exists(a[n], full), F.lit(False))
        return out

    return F.coalesce(bound(F.from_json(analysis, schema), of), F.lit(False)) & (F.coalesce(status, F.lit("")) != "OUTSIDE_CATALOG")


def assigned_value(value: Column, names=ASSIGNED) -> Column:
    """The folded value of ``name=value`` or ``name: value`` for the names of facets; else null."""
    found = F.regexp_extract(value, rf"(?i)^\s*(?:{'|'.join(names)})\s*[=:]\s*(.+?)\s*$", 1)
    return F.when(found != "", semantic_fold(found))


def same_measurement(value: Column, want: Column) -> Column:
    """Whether a value has all numbers and words of a wanted measurement; 7x3 is 7 and 3."""
    plain = lambda c: tokens(F.regexp_replace(semantic_fold(c), r"(\d)[x×](?=\d)", "$1 "))
    need = F.filter(plain(want), lambda t: t.rlike(r"\d") | ((F.length(t) > 1) & (t != "of")))
    return (F.size(need) > 0) & (F.size(F.array_except(need, plain(value))) == 0)


def versioned_entity(c: Column) -> Column:
    """struct(name, family) of a name with a version number, or null: two to eight words, the first of Latin letters, not all of them measures."""

    def of(words: Column) -> Column:
        measure = lambda t: t.rlike(r"\d") | t.isin("x", "gb", "tb", "cm", "mm", "ml", "kg", "mah", "inch", "size")
        named = (F.size(words) >= 2) & (F.size(words) <= 8) & F.exists(words, lambda t: t.rlike(r"\d")) & words[0].rlike("^[a-z][a-z0-9-]*$") & ~F.forall(words, measure)
        return F.when(named, F.struct(F.array_join(words, " ").alias("name"), words[0].alias("family")))

    return bound(meaningful_tokens(c), of)


def version_match(value: Column, entity: Column) -> Column:
    """EXACT where the value holds the entity's whole name, FAMILY where it has the family and some number."""
    own = meaningful_tokens(value)
    family = F.array_contains(own, entity["family"]) & F.exists(own, lambda t: t.rlike(r"\d"))
    return F.when(F.contains(semantic_fold(value), entity["name"]), "EXACT").when(family, "FAMILY")


def has_excluded(value: Column, excluded: Column) -> Column:
    """Whether a value has all words of an excluded facet; a single word that the value denies does not count."""
    plain = lambda c: F.transform(tokens(query_fold(c)), lambda t: F.when(t == "hooded", "hood").otherwise(t))

    def of(both: Column) -> Column:
        own, no = both[0], both[1]
        denied = F.exists(F.transform(own, lambda t, i: (t == no[0]) & F.coalesce(F.get(own, i - 1), F.lit("")).isin(*DENIALS)), lambda x: x)
        return (F.size(no) > 0) & ~((F.size(no) == 1) & denied) & (F.size(F.array_except(no, own)) == 0)

    return bound(F.array(plain(value), plain(excluded)), of)


def facet_matches(kind: Column, value: Column, want: Column) -> Column:
    """Whether a catalog value of a kind is what a signal asks for.

    Attributes: an assigned value must have the same words, any other all of the signal's. One-word
    contexts: the signal must be the value's last word. Else either holds the other as a phrase.
    """

    def of(x: Column) -> Column:
        own, ask, assigned = meaningful_tokens(x["value"]), meaningful_tokens(x["want"]), assigned_value(x["value"])
        v, w = semantic_fold(x["value"]), semantic_fold(x["want"])
        given = meaningful_tokens(assigned)
        attribute = F.when(assigned.isNotNull(), (F.size(given) == F.size(ask)) & (F.size(F.array_except(ask, given)) == 0)).otherwise(F.size(F.array_except(ask, own)) == 0)
        context = F.try_element_at(own, F.lit(-1)) == ask[0]
        exact = (v == w) | F.coalesce((x["kind"] == "ATTRIBUTE") & (assigned == w), F.lit(False))
        return (
            F.when((v == "") | (w == ""), False)
            .when(F.size(ask) == 0, exact)
            .when(x["kind"] == "ATTRIBUTE", attribute)
            .when(x["kind"].isin(*CONTEXT_KINDS) & (F.size(ask) == 1) & (F.size(own) > 1), context)
            .otherwise(contains_phrase(v, w) | contains_phrase(w, v))
        )

    return bound(F.struct(kind.alias("kind"), value.alias("value"), want.alias("want")), of)


def redacted(most_depth: int = 6, most_items: int = 100, most_chars: int = 2000):
    """Arrow UDF over JSON texts: values of secret keys are hidden, whatever their depth; deep parts, long arrays and long
    texts are cut. Text that is no JSON gives null."""
    import json
    import re

    # Parts of the names of secret keys.
    secret = re.compile("password|authorization|access[_-]?token|api[_-]?key|secret|session|cookie|database_url|csrf", re.IGNORECASE)

    def clean(x, depth):
        if depth > most_depth:
            return "[TRUNCATED]"
        if isinstance(x, list):
            return [clean(y, depth + 1) for y in x[:most_items]]
        if isinstance(x, dict):
            return {k: "[REDACTED]" if secret.search(k) else clean(y, depth + 1) for k, y in x.items()}
        return x[:most_chars] + "…" if isinstance(x, str) and len(x) > most_chars else x

    def one(text):
        try:
            return json.dumps(clean(json.loads(text), 0), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(one)

    return udf
