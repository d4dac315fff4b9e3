"""Product documents, typed facts, postings and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let, query_fold, semantic_fold
from .lineage import spread
from .ranking import ranked, top

# Limits of documents and facts.
MAX_DOCUMENT, MAX_TAGS, MAX_SPARSE, MAX_FACTS, MAX_STORED = 20_000, 100, 4_000, 240, 320
# Order of kinds in a product's exact-fact tokens.
KIND_PRIORITY = {"IDENTIFIER": 10, "SKU": 10, "BARCODE": 10, "MODEL": 20, "BRAND": 30, "VENDOR": 30, "CANONICAL_PRODUCT_TYPE": 40, "PRODUCT_TYPE": 50, "CATEGORY": 60, "ALIAS": 70, "COMPATIBILITY": 80, "MEASUREMENT": 90, "VARIANT_OPTION": 100, "ATTRIBUTE": 110, "AUDIENCE": 120}
# Dictionary fields of fact kinds.
FIELDS = {"CANONICAL_PRODUCT_TYPE": "PRODUCT_TYPE", "PRODUCT_TYPE": "PRODUCT_TYPE", "ALIAS": "PRODUCT_TYPE", "CATEGORY": "PRODUCT_TYPE", "VENDOR": "BRAND", "BRAND": "BRAND", "MODEL": "MODEL", "ATTRIBUTE": "ATTRIBUTE", "MEASUREMENT": "MEASUREMENT"}


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def unique_sorted(values: Column, most: int) -> Column:
    """Cleaned values, one of each lower-case form (the first), in order of that form."""
    pairs = F.transform(values, lambda v, i: let(clean(v), lambda x: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("v"))))
    first = lambda rows: F.filter(rows, lambda p, i: (i == 0) | (p["k"] != F.get(rows, i - 1)["k"]))
    return F.slice(let(F.array_sort(F.filter(pairs, lambda p: p["k"] != "")), first)["v"], 1, most)


def document(title: Column, kind: Column, vendor: Column, tags: Column, variants: Column, skus: Column, options: Column) -> Column:
    """Labelled sections of a product in fixed order; lists are sorted so that their order does not matter. options: (name, value)."""
    named = F.transform(options, lambda o: F.struct(clean(o["name"]).alias("name"), clean(o["value"]).alias("value")))
    pairs = F.transform(F.filter(named, lambda o: (o["name"] != "") & (o["value"] != "")), lambda o: F.concat_ws("=", o["name"], o["value"]))
    section = lambda label, text: let(text, lambda x: F.when(x != "", F.concat(F.lit(f"{label}: "), x, F.lit("."))))
    joined = lambda values: F.array_join(unique_sorted(values, MAX_TAGS), ", ")
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("Product: "), clean(title), F.lit(".")),
            section("Product type", clean(kind)),
            section("Vendor", clean(vendor)),
            section("Tags", joined(tags)),
            section("Variants", joined(variants)),
            section("SKUs", joined(skus)),
            section("Options", joined(pairs)),
        )
    )
    return F.substring(F.array_join(parts, "\n"), 1, MAX_DOCUMENT)


def sparse_document(title: Column, kind: Column, vendor: Column, rest: Column) -> Column:
    """Text for term statistics: title three times, type and vendor twice, all else once."""
    parts = F.concat(F.array_repeat(clean(title), 3), F.array_repeat(clean(kind), 2), F.array_repeat(clean(vendor), 2), F.transform(rest, clean))
    return F.trim(F.substring(F.array_join(F.filter(parts, lambda p: p != ""), " "), 1, MAX_SPARSE))


def content_hash(text: Column, language: str, version: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(version), F.lit(language), text), 256)


def point_id(shop: Column, product: Column) -> Column:
    """A stable id in the shape of a UUID from shop and product."""
    h = F.substring(F.sha2(F.concat(F.lower(F.trim(shop)), F.lit("\0"), F.trim(product)), 256), 1, 32)
    nibble = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), nibble, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def fact_token(kind: Column, value: Column) -> Column:
    """22 characters that stand for an exact fact."""
    raw = F.unhex(F.sha2(F.concat(kind, F.lit("\0"), value), 256))
    return F.substring(F.translate(F.base64(raw), "+/", "-_"), 1, 22)


def product_tokens(facts: DataFrame) -> DataFrame:
    """Each product's fact tokens in order of kind, at most MAX_STORED, with a hash of all and whether all fit."""
    priority = F.create_map(*[F.lit(x) for kv in KIND_PRIORITY.items() for x in kv])[F.col("kind")]
    rows = facts.where(priority.isNotNull()).select("shop", "product_id", priority.alias("p"), fact_token(F.col("kind"), F.col("norm_value")).alias("t")).distinct()
    per = ranked(rows, ["shop", "product_id"], ["p", "t"], "n").groupBy("shop", "product_id").agg(
        F.count("*").alias("facts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= MAX_STORED, F.struct("n", "t")))), lambda x: x["t"]), ",").alias("tokens")
    )
    return per.select("shop", "product_id", F.sha2("tokens", 256).alias("payload_hash"), F.length("tokens").alias("chars"), (F.col("facts") <= MAX_STORED).alias("complete"))


def fingerprint(vector: Column, size: int = 64) -> Column:
    """Signed bucket sums of a vector of any length, scaled to unit length, six decimals; null for empty, zero or broken vectors."""
    sign = lambda i: F.when(F.shiftright(i.cast("long") * 2654435761, 30) % 2 == 0, 1.0).otherwise(-1.0)
    signed = F.transform(vector.cast("array<double>"), lambda v, i: v * sign(i))

    def sums(own: Column) -> Column:
        places = lambda b: F.sequence(b + 1, F.size(own), F.lit(size))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.when(b < F.size(own), F.aggregate(places(b), F.lit(0.0), lambda a, i: a + F.element_at(own, i))).otherwise(0.0))

    def scaled(own: Column) -> Column:
        return let(F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.when(norm > 0, F.transform(own, lambda x: F.round(x / norm, 6))))

    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(whole, let(let(signed, sums), scaled))


# Words in the names of options, and the kinds of facts that such options become.
OPTION_KINDS = {
    "MEASUREMENT": "size|capacity|weight|length|width|height|dimension|volume|quantity|count|pack|waist|inseam|shoe",
    "ATTRIBUTE": "color|colour|material|fabric|style|fit|pattern|finish|flavor|flavour|scent|condition|format",
    "AUDIENCE": "gender|audience|age group|age_group|recipient",
    "MODEL": "model|series",
    "COMPATIBILITY": "compatibility|compatible with|device",
}
#: Kinds whose facts carry the option's name beside its value.
NAMED_KINDS = ("MEASUREMENT", "ATTRIBUTE")
# Fact kinds of the fields of an analysis.
ANALYSIS_KINDS = {
    "canonicalProductType": "CANONICAL_PRODUCT_TYPE", "category": "CATEGORY", "brandTerms": "BRAND", "modelTerms": "MODEL", "identifiers": "IDENTIFIER", "audiences": "AUDIENCE", "compatibility": "COMPATIBILITY",
    "exactAttributes": "ATTRIBUTE", "measurements": "MEASUREMENT", "explicitContexts": "USE_CASE", "compatibleContexts": "SOFT_CONTEXT", "aliases": "ALIAS",
}


def option_facts(options: Column) -> Column:
    """Facts (kind, value) of a product's options (name, value): each value, and what the option's name makes of it."""
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    both = lambda o: F.concat_ws("=", o["name"], o["value"])

    def of(o: Column) -> Column:
        out = F.array(fact("VARIANT_OPTION", o["value"]), fact("VARIANT_OPTION", both(o)))
        none = F.array().cast("array<struct<kind:string,value:string>>")
        for kind, names in OPTION_KINDS.items():
            own = F.array(fact(kind, o["value"]), *[fact(kind, both(o))] * (kind in NAMED_KINDS))
            out = F.concat(out, F.when(o["name"].rlike(f"(?i)({names})"), own).otherwise(none))
        return out

    real = F.filter(options, lambda o: (clean(o["name"]) != "") & (clean(o["value"]) != "") & ~((F.lower(o["name"]) == "title") & F.lower(o["value"]).isin("default title", "title default title")))
    return F.flatten(F.transform(real, of))


def extract_facts(products: DataFrame) -> DataFrame:
    """Typed facts of products: one row per kind and folded value; of equal ones the last gives the value, the first the place.

    products: shop, product_id, title, product_type, vendor, analysis (JSON
    of ANALYSIS_KINDS, a list each), tags, options (array of name, value).
    """
    c = F.col
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    read = F.from_json("analysis", ", ".join(f"{n} array<string>" for n in ANALYSIS_KINDS))
    all_of = lambda kind, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: one(kind, v))
    own = F.array(one("PRODUCT_TITLE", c("title")), one("PRODUCT_TYPE", c("product_type")), one("VENDOR", c("vendor")))
    pairs = let(read, lambda a: F.concat(own, *[all_of(kind, a[name]) for name, kind in ANALYSIS_KINDS.items()], all_of("TAG", c("tags")), option_facts(c("options"))))
    pairs = F.transform(pairs, lambda f: let(clean(f["value"]), lambda v: F.struct(f["kind"].alias("kind"), v.alias("value"), semantic_fold(v).alias("norm_value"))))
    dealt = spread(products, "shop", "product_id")
    rows = dealt.select("shop", "product_id", F.posexplode(pairs).alias("pos", "f")).select("shop", "product_id", "pos", "f.*").where("norm_value <> ''")
    once = rows.groupBy("shop", "product_id", "kind", "norm_value").agg(F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    return top(once, ["shop", "product_id"], ["pos"], MAX_FACTS).drop("pos")


def ground(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts that occur in their product's folded document; audiences that do not are kept as inferred."""
    told = facts.withColumn("_said", query_fold(F.col("norm_value")))
    rows = told.join(documents.select("shop", "product_id", query_fold(F.col("document")).alias("_folded")), ["shop", "product_id"])
    found = F.contains("_folded", "_said")
    kind = F.when(~found & (F.col("kind") == "AUDIENCE"), "INFERRED_AUDIENCE").when(found, F.col("kind"))
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").drop("_folded", "_said")


def postings(facts: DataFrame) -> DataFrame:
    """Products of each shop, kind and value; counted in each task first, so a value that all products have is no hot key."""
    return facts.groupBy("shop", "kind", "norm_value").agg(F.count("*").alias("rows"), F.countDistinct("product_id").alias("products"), F.min("product_id").alias("first_product"))


def posting_sketches(facts: DataFrame, slice_col: str, precision: int = 14) -> DataFrame:
    """One mergeable sketch of the products of each shop, kind, value and slice, such as a day: a table that new slices are added to."""
    return facts.groupBy("shop", "kind", "norm_value", slice_col).agg(F.hll_sketch_agg("product_id", precision).alias("sketch"))


def merged_postings(sketches: DataFrame) -> DataFrame:
    """Products of each shop, kind and value, estimated from the union of its sketches, without the facts."""
    return sketches.groupBy("shop", "kind", "norm_value").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("products"), F.count("*").alias("slices"))


def facet_samples(products: DataFrame, facts: DataFrame, patterns: list[str], most: int = 8, facets: int = 18, options: int = 6) -> DataFrame:
    """For each pattern the first products whose title has it: pattern, product_id, title, facets, options.

    Products with a vector, in order of id; ``facets`` are kind:value of the
    first facts by kind and value, without options and identifiers, and
    ``options`` the first typed options. Titles meet the list of patterns in
    each row, so there is no join with it.
    """
    hits = products.where("has_vector").select("shop", "product_id", "title", F.explode(F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(F.lower("title"), F.lower(p)))).alias("pattern"))
    hits = top(hits, ["shop", "pattern"], ["product_id"], most)
    own = facts.join(hits.select("shop", "product_id").distinct(), ["shop", "product_id"], "left_semi").select("shop", "product_id", "kind", "norm_value").distinct()
    first = lambda rows, value, n, name: top(rows, ["shop", "product_id"], ["kind", "norm_value"], n).groupBy("shop", "product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "norm_value"))), value).alias(name))
    named = first(own.where("kind NOT IN ('VARIANT_OPTION', 'IDENTIFIER')"), lambda r: F.concat_ws(":", r["kind"], r["norm_value"]), facets, "facets")
    typed = first(own.where("kind = 'VARIANT_OPTION' AND contains(norm_value, '=')"), lambda r: r["norm_value"], options, "options")
    none = F.array().cast("array<string>")
    out = hits.join(named, ["shop", "product_id"], "left").join(typed, ["shop", "product_id"], "left")
    return out.select("shop", "pattern", "product_id", "title", F.coalesce("facets", none).alias("facets"), F.coalesce("options", none).alias("options"))


def dictionary(facts: DataFrame) -> DataFrame:
    """Phrases of each shop by field with support, confidence and a stable id."""
    field = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])[F.col("kind")]
    rows = facts.withColumn("field", field).where("field IS NOT NULL")
    out = rows.groupBy("shop", "field", "norm_value").agg(F.countDistinct("product_id").alias("support"), F.max(F.when(F.col("kind") == "CANONICAL_PRODUCT_TYPE", 1.0).otherwise(0.9)).alias("confidence"))
    return out.withColumn("concept_id", F.substring(F.sha2(F.concat_ws("|", "shop", "field", "norm_value"), 256), 1, 24))


def dictionary_order(entries: DataFrame) -> DataFrame:
    """Rank of each entry in its shop: identity fields first, then more words, confidence, support."""
    tier = F.when(F.col("field").isin("MODEL", "BRAND", "PRODUCT_TYPE"), 0).otherwise(1)
    return ranked(entries, "shop", [tier, F.desc(F.size(F.split("norm_value", " "))), F.desc("confidence"), F.desc("support"), "field", "norm_value"])


def coverage(products: DataFrame, facts: DataFrame) -> DataFrame:
    """Per shop: products, those with facts, with a canonical type, and the share that has one."""
    per = facts.groupBy("shop", "product_id").agg(F.bool_or(F.col("kind") == "CANONICAL_PRODUCT_TYPE").alias("typed"))
    rows = products.select("shop", "product_id").join(per, ["shop", "product_id"], "left")
    out = rows.groupBy("shop").agg(F.count("*").alias("products"), F.count("typed").alias("with_facts"), F.count_if("typed").alias("typed"))
    return out.withColumns({"ratio": F.round(F.col("typed") / F.col("products"), 6), "missing": F.col("products") - F.col("with_facts")})


def identifying_keys(products: DataFrame) -> DataFrame:
    """Combinations of a product's fields that no other product of its shop has."""
    combos = {"title": ("title",), "title_vendor": ("title", "vendor"), "title_type": ("title", "product_type"), "title_vendor_type": ("title", "vendor", "product_type"), "title_vendor_size": ("title", "vendor", "size_no")}
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.sha2(F.concat_ws("|", *[F.lower(F.col(c).cast("string")) for c in cols]), 256).alias("signature")) for k, cols in combos.items()])
    rows = products.select("shop", "product_id", F.inline(found))
    single = rows.groupBy("shop", "kind", "signature").agg(F.count("*").alias("n"), F.min("product_id").alias("product_id")).where("n = 1")
    return single.select("shop", "product_id", "kind", "signature")


def bounded_prefix(items: DataFrame, keys: list[str], order: str, value: str, most_bytes: int) -> DataFrame:
    """The longest prefix of each key's items whose JSON array fits into so many bytes."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    size = F.octet_length(F.to_json(F.struct(F.col(value).alias("v")))) - F.octet_length(F.lit('{"v":}')) + 1
    rows = items.withColumn("_sum", F.sum(size).over(w) + 1).where(F.col("_sum") <= most_bytes)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("kept")).select(*keys, F.to_json(F.transform("kept", lambda x: x[value])).alias("json"))


def scroll(payloads: DataFrame, groups: list[tuple[str, ...]], size: int) -> DataFrame:
    """Products (shop, product_id, values) that hold a value of every group, numbered in pages of each shop, with the shop's count."""
    hit = F.lit(True)
    for g in groups:
        hit = hit & F.arrays_overlap("values", F.array(*[F.lit(v) for v in g]))
    found = payloads.where(hit).select("shop", "product_id")
    totals = found.groupBy("shop").agg(F.count("*").alias("total"))
    return ranked(found, "shop", ["product_id"]).join(totals, "shop").select("shop", "product_id", F.floor((F.col("rank") - 1) / size).alias("page"), "total")


def axis_sentences(rows: DataFrame) -> DataFrame:
    """One text for each owner and id of what is supplied or asked: (owner, id, sentence).

    rows: owner, id, axis (its order), label, value, negative. Each axis is a
    sentence of its values; a value is said in its first axis only, values
    with digits are left out, and what is excluded comes last.
    """
    kept = rows.where(~F.col("value").rlike("[0-9]")).withColumns({"axis": F.when(F.col("negative"), 1 << 20).otherwise(F.col("axis")), "label": F.when(F.col("negative"), "Not").otherwise(F.col("label"))})
    once = top(kept, ["owner", "id", "value", "negative"], ["axis", "label"])
    said = once.groupBy("owner", "id", "axis", "label").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("said"))
    parts = F.array_sort(F.collect_list(F.struct("axis", "label", "said")))
    return said.groupBy("owner", "id").agg(F.array_join(F.transform(parts, lambda p: F.concat(p["label"], F.lit(": "), p["said"], F.lit("."))), " ").alias("sentence"))


# Characters of a description, and of a document that becomes a vector.
MAX_DESCRIPTION, MAX_VECTOR = 650, 1800


def vector_document(title: Column, kind: Column, vendor: Column, facts: Column, description: Column) -> Column:
    """Title, facts (or type and vendor where there are none) and the beginning of the description."""
    base = F.filter(F.array(clean(kind), clean(vendor)), lambda x: x != "")
    about = F.array_join(F.when(F.size(facts) > 0, facts).otherwise(base), ". ")
    parts = F.filter(F.array(clean(title), about, F.rtrim(F.substring(clean(description), 1, MAX_DESCRIPTION))), lambda x: x != "")
    return F.substring(F.array_join(parts, ". "), 1, MAX_VECTOR)
