"""Queries of product documents, facts and dictionaries."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators.lineage import spread
from ..operators.ranking import top
from .registry import query
from .retrieval import fold

P, FACTS = ("products",), ("facts",)
_TAGS = "list_sort(list_distinct([lower(product_type), lower(vendor), lower(split_part(title, ' ', 1))]))"
_DOC = f"""docs AS (SELECT shop, product_id, concat('Product: ', title, '.', chr(10), 'Product type: ', product_type, '.', chr(10), 'Vendor: ', vendor, '.', chr(10), 'Tags: ', array_to_string({_TAGS}, ', '), '.', chr(10), 'Variants: Size ', CAST(size_no AS VARCHAR), '.', chr(10), 'SKUs: ', handle, '.', chr(10), 'Options: Colour=', split_part(title, ' ', 1), ', Size=', CAST(size_no AS VARCHAR), '.') AS document FROM products)"""


def documents(t):
    c = F.col
    tags = F.array(F.lower("product_type"), F.lower("vendor"), F.lower(F.split_part("title", F.lit(" "), F.lit(1))), F.lower("vendor"))
    size = F.concat(F.lit("Size "), c("size_no").cast("string"))
    option = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    options = F.array(option("Size", c("size_no").cast("string")), option("Colour", F.split_part("title", F.lit(" "), F.lit(1))), option("Fit", F.lit(" ")))
    doc = C.document(c("title"), c("product_type"), c("vendor"), tags, F.array(size, F.lower(size)), F.array("handle", F.upper("handle")), options)
    return spread(t("products"), "shop", "product_id").select("shop", "product_id", doc.alias("document"))


@query("doc1_product_documents", P, f"WITH {_DOC} SELECT * FROM docs")
def _(t):
    return documents(t)


@query("doc2_sparse_documents", P, "SELECT shop, product_id, concat_ws(' ', title, title, title, product_type, product_type, vendor, vendor, concat('size ', CAST(size_no AS VARCHAR))) AS sparse FROM products")
def _(t):
    c = F.col
    rest = F.array(F.concat(F.lit("size "), c("size_no").cast("string")), F.lit(""))
    return t("products").select("shop", "product_id", C.sparse_document(c("title"), c("product_type"), c("vendor"), rest).alias("sparse"))


@query("doc3_content_hashes", P, f"WITH {_DOC} SELECT shop, product_id, sha256(concat('v9|en|', document)) AS document_hash, sha256(document) AS source_hash FROM docs")
def _(t):
    return documents(t).select("shop", "product_id", C.content_hash(F.col("document"), "en", "v9").alias("document_hash"), F.sha2("document", 256).alias("source_hash"))


@query("doc4_migration_test", P, f"WITH {_DOC}, h AS (SELECT shop, product_id, CASE product_id % 3 WHEN 0 THEN sha256(concat('v8|en|', document)) WHEN 1 THEN sha256(concat('v9|en|', document)) ELSE sha256('other') END AS old, sha256(concat('v9|en|', document)) AS new, sha256(concat('v8|en|', document)) AS legacy FROM docs) SELECT shop, product_id, old <> new AND old = legacy AS migrates FROM h")
def _(t):
    new, legacy = (C.content_hash(F.col("document"), "en", v) for v in ("v9", "v8"))
    old = F.when(F.col("product_id") % 3 == 0, legacy).when(F.col("product_id") % 3 == 1, new).otherwise(F.sha2(F.lit("other"), 256))
    return documents(t).select("shop", "product_id", ((old != new) & F.array_contains(F.array(legacy), old)).alias("migrates"))


@query("doc5_hash_backfill", P, "SELECT shop, CASE WHEN NOT has_vector THEN 'NO_VECTOR' WHEN product_id % 4 = 0 THEN 'BACKFILL' ELSE 'HASHED' END AS state, count(*) AS n FROM products GROUP BY ALL")
def _(t):
    p = t("products").select("shop", "product_id", "has_vector")
    hashed = p.where("has_vector AND product_id % 4 <> 0").select("shop", "product_id", F.lit("x").alias("hash"))
    state = F.when(~F.col("has_vector"), "NO_VECTOR").when(F.col("hash").isNull(), "BACKFILL").otherwise("HASHED")
    return p.join(hashed, ["shop", "product_id"], "left").groupBy("shop", state.alias("state")).agg(F.count("*").alias("n"))


@query("doc6_typed_facts", P, r"""WITH b AS (SELECT *, split_part(title, ' ', 1) AS a, split_part(title, ' ', 2) AS n, CAST(size_no AS VARCHAR) AS z FROM products),
f AS (SELECT shop, product_id, unnest([{'pos': 0, 'kind': 'PRODUCT_TITLE', 'value': title}, {'pos': 1, 'kind': 'PRODUCT_TYPE', 'value': product_type}, {'pos': 2, 'kind': 'VENDOR', 'value': vendor}, {'pos': 3, 'kind': 'CANONICAL_PRODUCT_TYPE', 'value': CASE WHEN product_id % 6 <> 0 THEN n END},
  {'pos': 4, 'kind': 'ATTRIBUTE', 'value': CASE WHEN product_id % 6 <> 0 THEN a END}, {'pos': 5, 'kind': 'USE_CASE', 'value': CASE WHEN product_id % 6 <> 0 THEN concat('for ', n) END}, {'pos': 6, 'kind': 'TAG', 'value': a}, {'pos': 7, 'kind': 'VARIANT_OPTION', 'value': z}, {'pos': 8, 'kind': 'VARIANT_OPTION', 'value': concat('Shoe Size=', z)},
  {'pos': 9, 'kind': 'MEASUREMENT', 'value': z}, {'pos': 10, 'kind': 'MEASUREMENT', 'value': concat('Shoe Size=', z)}, {'pos': 11, 'kind': 'VARIANT_OPTION', 'value': upper(a)}, {'pos': 12, 'kind': 'VARIANT_OPTION', 'value': concat('Colour=', upper(a))}, {'pos': 13, 'kind': 'ATTRIBUTE', 'value': upper(a)}, {'pos': 14, 'kind': 'ATTRIBUTE', 'value': concat('Colour=', upper(a))},
  {'pos': 15, 'kind': 'VARIANT_OPTION', 'value': CASE WHEN product_id % 2 = 0 THEN 'kids' END}, {'pos': 16, 'kind': 'VARIANT_OPTION', 'value': CASE WHEN product_id % 2 = 0 THEN 'Age group=kids' END}, {'pos': 17, 'kind': 'AUDIENCE', 'value': CASE WHEN product_id % 2 = 0 THEN 'kids' END}], recursive := true) FROM b),
g AS (SELECT *, trim(regexp_replace(strip_accents(lower(value)), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm_value FROM f WHERE value IS NOT NULL)
SELECT shop, product_id, kind, norm_value, arg_max(value, pos) AS value FROM g GROUP BY 1, 2, 3, 4""")
def _(t):
    """Facts of products with an analysis (five of six products), tags and options; a placeholder option gives none."""
    c, words = F.col, [F.split_part("title", F.lit(" "), F.lit(i)) for i in (1, 2)]
    analysis = F.when(c("product_id") % 6 != 0, F.to_json(F.struct(F.array(words[1]).alias("canonicalProductType"), F.array(words[0]).alias("exactAttributes"), F.array(F.concat(F.lit("for "), words[1])).alias("explicitContexts"))))
    option = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    age = F.when(c("product_id") % 2 == 0, F.lit("kids")).otherwise("")
    options = F.array(option("Title", F.lit("Default Title")), option("Shoe Size", c("size_no").cast("string")), option("Colour", F.upper(words[0])), option("Age group", age))
    return C.extract_facts(t("products").select("*", analysis.alias("analysis"), F.array(words[0]).alias("tags"), options.alias("options")))


@query("doc7_grounded_facts", P, f"""WITH {_DOC}, f AS (SELECT shop, product_id, 'AUDIENCE' AS kind, CASE WHEN product_id % 2 = 0 THEN 'women' ELSE split_part(title, ' ', 1) END AS norm_value FROM products UNION ALL SELECT shop, product_id, 'ATTRIBUTE', CASE WHEN product_id % 3 = 0 THEN 'waterproof' ELSE split_part(title, ' ', 2) END FROM products)
SELECT shop, product_id, CASE WHEN contains(lower(document), norm_value) THEN kind ELSE 'INFERRED_AUDIENCE' END AS kind, norm_value FROM f JOIN docs USING (shop, product_id) WHERE contains(lower(document), norm_value) OR kind = 'AUDIENCE'""")
def _(t):
    p, c = spread(t("products"), "shop", "product_id"), F.col
    words = [F.split_part("title", F.lit(" "), F.lit(i)) for i in (1, 2)]
    audience = F.struct(F.lit("AUDIENCE").alias("kind"), F.when(c("product_id") % 2 == 0, "women").otherwise(words[0]).alias("norm_value"))
    attribute = F.struct(F.lit("ATTRIBUTE").alias("kind"), F.when(c("product_id") % 3 == 0, "waterproof").otherwise(words[1]).alias("norm_value"))
    return C.ground(p.select("shop", "product_id", F.inline(F.array(audience, attribute))), documents(t))


@query("doc8_axis_sentences", ("typed_facts", "wanted"), """WITH r AS (SELECT 'product' AS owner, product_id AS id, CASE kind WHEN 'CANONICAL_PRODUCT_TYPE' THEN 1 WHEN 'PRODUCT_TYPE' THEN 2 WHEN 'ATTRIBUTE' THEN 3 WHEN 'USE_CASE' THEN 4 ELSE 5 END AS axis, CASE kind WHEN 'CANONICAL_PRODUCT_TYPE' THEN 'Product' WHEN 'PRODUCT_TYPE' THEN 'Type' WHEN 'ATTRIBUTE' THEN 'Attributes' WHEN 'USE_CASE' THEN 'Uses' ELSE 'Other' END AS label, norm_value AS value, false AS negative FROM typed_facts
  UNION ALL SELECT 'query', query_id, CASE kind WHEN 'PRODUCT_TYPE' THEN 1 WHEN 'BRAND' THEN 2 ELSE 3 END, CASE kind WHEN 'PRODUCT_TYPE' THEN 'Product' WHEN 'BRAND' THEN 'Brand' ELSE 'Attributes' END, norm_value, mode = 'MUST_NOT' FROM wanted),
k AS (SELECT owner, id, CASE WHEN negative THEN 1048576 ELSE axis END AS axis, CASE WHEN negative THEN 'Not' ELSE label END AS label, value, negative FROM r WHERE NOT regexp_matches(value, '[0-9]') QUALIFY row_number() OVER (PARTITION BY owner, id, value, negative ORDER BY CASE WHEN negative THEN 1048576 ELSE axis END, CASE WHEN negative THEN 'Not' ELSE label END) = 1),
s AS (SELECT owner, id, axis, label, string_agg(value, ', ' ORDER BY value) AS said FROM k GROUP BY 1, 2, 3, 4) SELECT owner, id, string_agg(concat(label, ': ', said, '.'), ' ' ORDER BY axis, label) AS sentence FROM s GROUP BY 1, 2""")
def _(t):
    """What products supply and what queries ask, as sentences of one form."""
    kind = F.col("kind")
    named = lambda names, rest: [F.coalesce(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v[i])])[kind], F.lit(rest[i])) for i in (0, 1)]
    supply = named({"CANONICAL_PRODUCT_TYPE": (1, "Product"), "PRODUCT_TYPE": (2, "Type"), "ATTRIBUTE": (3, "Attributes"), "USE_CASE": (4, "Uses")}, (5, "Other"))
    demand = named({"PRODUCT_TYPE": (1, "Product"), "BRAND": (2, "Brand")}, (3, "Attributes"))
    row = lambda df, owner, key, axes, negative: df.select(F.lit(owner).alias("owner"), F.col(key).alias("id"), axes[0].alias("axis"), axes[1].alias("label"), F.col("norm_value").alias("value"), negative.alias("negative"))
    return C.axis_sentences(row(t("typed_facts"), "product", "product_id", supply, F.lit(False)).unionByName(row(t("wanted"), "query", "query_id", demand, F.col("mode") == "MUST_NOT")))


@query("doc9_vector_documents", ("facts", "products"), r"""WITH f AS (SELECT product_id, string_agg(norm_value, '. ' ORDER BY kind, norm_value) AS facts FROM facts WHERE product_id % 6 <> 0 GROUP BY 1),
d AS (SELECT p.shop, p.product_id, p.title, coalesce(f.facts, concat_ws('. ', product_type, vendor)) AS about, rtrim(substr(trim(regexp_replace(coalesce(d.text, ''), '\s+', ' ', 'g')), 1, 650)) AS said FROM products p LEFT JOIN f ON f.product_id = p.product_id LEFT JOIN documents d ON d.doc_id = p.product_id)
SELECT shop, product_id, substr(concat(title, '. ', about, CASE WHEN said <> '' THEN concat('. ', said) ELSE '' END), 1, 1800) AS document FROM d""")
def _(t):
    """Five of six products have facts; the text of the same number describes a product."""
    facts = t("facts").where("product_id % 6 <> 0").groupBy("shop", "product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "norm_value"))), lambda x: x["norm_value"]).alias("facts"))
    texts = t("documents").select(F.col("doc_id").alias("product_id"), F.col("text").alias("description"))
    rows = t("products").join(facts, ["shop", "product_id"], "left").join(texts, "product_id", "left")
    doc = C.vector_document(F.col("title"), F.col("product_type"), F.col("vendor"), F.coalesce("facts", F.array().cast("array<string>")), F.col("description"))
    return rows.select("shop", "product_id", doc.alias("document"))


@query("doc10_fact_tokens", FACTS, """WITH t AS (SELECT DISTINCT shop, product_id, CASE kind WHEN 'VENDOR' THEN 30 WHEN 'CANONICAL_PRODUCT_TYPE' THEN 40 WHEN 'PRODUCT_TYPE' THEN 50 WHEN 'MEASUREMENT' THEN 90 ELSE 110 END AS p, substr(translate(base64(unhex(sha256(concat(kind, chr(0), norm_value)))), '+/', '-_'), 1, 22) AS t FROM facts),
a AS (SELECT shop, product_id, string_agg(t, ',' ORDER BY p, t) AS tokens FROM t GROUP BY 1, 2) SELECT shop, product_id, sha256(tokens) AS payload_hash, CAST(length(tokens) AS INTEGER) AS chars, true AS complete FROM a""")
def _(t):
    return C.product_tokens(t("facts"))


@query("doc11_point_ids", P, """WITH h AS (SELECT shop, product_id, substr(sha256(concat(shop, chr(0), CAST(product_id AS VARCHAR))), 1, 32) AS h FROM products)
SELECT shop, product_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', (CAST(concat('0x', substr(h, 17, 1)) AS INTEGER) % 4) + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS point_id FROM h""")
def _(t):
    return t("products").select("shop", "product_id", C.point_id(F.col("shop"), F.col("product_id").cast("string")).alias("point_id"))


@query("doc12_fingerprints", (), """WITH s AS (SELECT vec_id, list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * CASE WHEN ((i * 2654435761) >> 30) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s) SELECT vec_id, round(v[1] / norm, 6) AS first, round(v[64] / norm, 6) AS last FROM n""")
def _(t):
    f = C.fingerprint(F.col("embedding"))
    return t("embeddings").select("vec_id", f.alias("f")).select("vec_id", F.col("f")[0].alias("first"), F.col("f")[63].alias("last"))


@query("doc12_fingerprint_vectors", (), """WITH s AS (SELECT vec_id, list_transform(range(64), lambda i: CAST(embedding[i + 1] AS DOUBLE) * CASE WHEN ((i * 2654435761) >> 30) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s) SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(round(round(x / norm, 6) * 10000) AS BIGINT)), ',') AS fingerprint FROM n""")
def _(t):
    """All numbers of each fingerprint, in ten-thousandths."""
    f = C.fingerprint(F.col("embedding"))
    return t("embeddings").select("vec_id", F.array_join(F.transform(f, lambda x: F.round(x * 10_000).cast("long").cast("string")), ",").alias("fingerprint"))


@query("doc13_product_gids", P, "SELECT product_id, CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN concat('gid://shop/Product/', raw) END AS gid FROM (SELECT product_id, CASE WHEN product_id % 10 = 0 THEN concat('x', product_id) ELSE CAST(product_id AS VARCHAR) END AS raw FROM products)")
def _(t):
    raw = F.when(F.col("product_id") % 10 == 0, F.concat(F.lit("x"), F.col("product_id").cast("string"))).otherwise(F.col("product_id").cast("string"))
    return t("products").select("product_id", F.when(raw.rlike("^[0-9]+$"), F.concat(F.lit("gid://shop/Product/"), raw)).alias("gid"))


@query("doc14_profile_maps", FACTS, """SELECT shop, product_id, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS n_values FROM (SELECT shop, product_id, kind, count(DISTINCT norm_value) AS n FROM facts GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    per = t("facts").groupBy("shop", "product_id", "kind").agg(F.array_sort(F.collect_set("norm_value")).alias("v"))
    profile = per.groupBy("shop", "product_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "v"))))).alias("json"))
    read = F.from_json("json", "map<string,array<string>>")
    sizes = F.aggregate(F.map_values(read), F.lit(0).cast("long"), lambda s, v: s + F.size(v))
    return profile.select("shop", "product_id", F.size(read).cast("long").alias("kinds"), sizes.alias("n_values"))


@query("doc14_profiles", FACTS, """WITH k AS (SELECT shop, product_id, kind, string_agg(DISTINCT concat('"', norm_value, '"'), ',' ORDER BY concat('"', norm_value, '"')) AS v FROM facts GROUP BY 1, 2, 3)
SELECT shop, product_id, concat('{', string_agg(concat('"', kind, '":[', v, ']'), ',' ORDER BY kind), '}') AS profile FROM k GROUP BY 1, 2""")
def _(t):
    """Each product's facts as one JSON text."""
    per = t("facts").groupBy("shop", "product_id", "kind").agg(F.array_sort(F.collect_set("norm_value")).alias("v"))
    return per.groupBy("shop", "product_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "v"))))).alias("profile"))


@query("doc15_demand_branches", ("query_log",), f"""WITH q AS (SELECT DISTINCT shop, query FROM query_log), b AS (SELECT shop, query, 0 AS ix, query AS text FROM q UNION ALL SELECT shop, query, 1, split_part(query, ' ', 2) FROM q UNION ALL SELECT shop, query, 2, split_part(query, ' ', 1) FROM q UNION ALL SELECT shop, query, 3, query FROM q)
SELECT shop, query, text, CAST(row_number() OVER (PARTITION BY shop, query ORDER BY min(ix)) AS INTEGER) AS branch FROM b WHERE text <> '' GROUP BY shop, query, text""")
def _(t):
    from ..operators.ranking import ranked

    words = [F.split_part("query", F.lit(" "), F.lit(i)) for i in (2, 1)]
    rows = t("query_log").select("shop", "query").distinct().select("shop", "query", F.posexplode(F.array(F.col("query"), *words, F.col("query"))).alias("ix", "text")).where("text <> ''")
    once = rows.groupBy("shop", "query", "text").agg(F.min("ix").alias("ix"))
    return ranked(once, ["shop", "query"], ["ix"], "branch").drop("ix")


@query("doc15_demand_probes", ("asks", "typed_facts"))
def _(t):
    """Each ask in a mode of its turn, its axes and expansions from the facts of its product and of its type."""
    from ..operators.demand import demand_probes

    facts = t("typed_facts").groupBy("product_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("norm_value")))).alias(k) for k in ("CANONICAL_PRODUCT_TYPE", "PRODUCT_TYPE", "ATTRIBUTE", "VENDOR", "MEASUREMENT", "USE_CASE", "VARIANT_OPTION")])
    rows = t("asks").join(facts, F.col("ask_id") == F.col("product_id"))
    word = lambda i: F.split_part("title", F.lit(" "), F.lit(i))
    turn = F.col("ask_id")
    one = lambda c: F.array(c)
    return demand_probes(rows.select(
        "ask_id", "shop", F.element_at(F.array(F.lit("DIRECT"), F.lit("DISCOVERY"), F.lit("COMPLEMENT")), (turn % 3 + 1).cast("int")).alias("mode"), "query",
        F.when(turn % 2 == 0, F.concat("query", F.lit(" as a gift"))).alias("semantic_query"), F.when(turn % 5 < 3, F.col("title")).alias("intent"),
        F.col("CANONICAL_PRODUCT_TYPE").alias("types"), F.concat("ATTRIBUTE", "VENDOR", "MEASUREMENT").alias("facets"), F.when(turn % 4 == 0, F.col("ATTRIBUTE")).alias("negatives"),
        F.when(turn % 9 != 2, one(word(1))).alias("reference_terms"), F.concat(F.col("PRODUCT_TYPE"), F.col("USE_CASE"), one(F.concat(word(1), F.lit(" "), word(2))), one(F.concat(F.lit("new "), word(2))), F.col("VENDOR")).alias("expansions"),
        F.when(turn % 7 != 3, F.array(F.col("USE_CASE"), F.col("VENDOR"), F.col("ATTRIBUTE"))).alias("axes"), F.col("VENDOR").alias("needs"), F.when(turn % 8 == 1, F.col("VENDOR")).alias("blocked"),
        F.col("CANONICAL_PRODUCT_TYPE").alias("catalog_types"), F.concat("USE_CASE", "PRODUCT_TYPE").alias("catalog_values"),
    ), ["ask_id", "shop"])


@query("agg21_postings", FACTS, "SELECT shop, kind, norm_value, count(*) AS rows, count(DISTINCT product_id) AS products, min(product_id) AS first_product FROM facts GROUP BY 1, 2, 3")
def _(t):
    return C.postings(t("facts"))


@query("agg21_merged_postings", FACTS, "SELECT shop, kind, norm_value, count(DISTINCT product_id % 7) AS slices, true AS close FROM facts GROUP BY 1, 2, 3")
def _(t):
    """Estimates from the sketches of seven days, products of a day being those of one rest, held against the exact counts."""
    facts = t("facts").withColumn("day", F.col("product_id") % 7)
    exact = C.postings(facts).select("shop", "kind", "norm_value", F.col("products").alias("exact"))
    merged = C.merged_postings(C.posting_sketches(facts, "day")).join(exact, ["shop", "kind", "norm_value"])
    return merged.select("shop", "kind", "norm_value", "slices", (F.abs(F.col("products") - F.col("exact")) <= 0.02 * F.col("exact")).alias("close"))


_DICT = """dict AS (SELECT shop, CASE kind WHEN 'VENDOR' THEN 'BRAND' WHEN 'ATTRIBUTE' THEN kind WHEN 'MEASUREMENT' THEN kind ELSE 'PRODUCT_TYPE' END AS field, norm_value, count(DISTINCT product_id) AS support, max(CASE WHEN kind = 'CANONICAL_PRODUCT_TYPE' THEN CAST(1 AS DOUBLE) ELSE 0.9 END) AS confidence FROM facts GROUP BY 1, 2, 3)"""


@query("agg22_dictionary", FACTS, f"WITH {_DICT} SELECT *, substr(sha256(concat_ws('|', shop, field, norm_value)), 1, 24) AS concept_id FROM dict")
def _(t):
    return C.dictionary(t("facts"))


@query("agg23_dictionary_order", FACTS, f"WITH {_DICT} SELECT shop, field, norm_value, CAST(row_number() OVER (PARTITION BY shop ORDER BY CASE WHEN field IN ('MODEL', 'BRAND', 'PRODUCT_TYPE') THEN 0 ELSE 1 END, len(string_split(norm_value, ' ')) DESC, confidence DESC, support DESC, field, norm_value) AS INTEGER) AS rank FROM dict")
def _(t):
    return C.dictionary_order(C.dictionary(t("facts"))).select("shop", "field", "norm_value", "rank")


@query("agg24_context_coverage", ("products", "facts"), "WITH f AS (SELECT shop, product_id, bool_or(kind = 'CANONICAL_PRODUCT_TYPE') AS typed FROM facts WHERE product_id % 9 <> 0 GROUP BY 1, 2) SELECT p.shop, count(*) AS products, count(typed) AS with_facts, count_if(typed) AS typed, round(count_if(typed) / count(*), 6) AS ratio, count(*) - count(typed) AS missing FROM products p LEFT JOIN f USING (shop, product_id) GROUP BY 1")
def _(t):
    return C.coverage(t("products"), t("facts").where("product_id % 9 <> 0"))


@query("agg25_payload_coverage", ("products", "facts"), "WITH c AS (SELECT shop, count(DISTINCT product_id) AS complete FROM facts GROUP BY 1) SELECT p.shop, count(*) AS registered, any_value(c.complete) AS complete, count(*) = any_value(c.complete) AS covered FROM products p LEFT JOIN c ON c.shop = p.shop GROUP BY 1")
def _(t):
    done = C.product_tokens(t("facts")).where("complete").groupBy("shop").agg(F.count("*").alias("complete"))
    own = t("products").groupBy("shop").agg(F.count("*").alias("registered")).join(done, "shop", "left")
    return own.withColumn("covered", F.col("registered") == F.col("complete"))


@query("agg26_kind_histogram", FACTS, "SELECT kind, count(*) AS n, count(DISTINCT norm_value) AS n_values, min(norm_value) AS sample FROM facts GROUP BY 1")
def _(t):
    return t("facts").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("norm_value").alias("n_values"), F.min("norm_value").alias("sample"))


@query("agg26_facet_samples", (*P, "typed_facts"), """WITH h AS (SELECT shop, product_id, title, unnest(['bolt', 'RING', 'red', 'blue', 'gear']) AS pattern FROM products WHERE has_vector),
k AS (SELECT * FROM h WHERE contains(lower(title), lower(pattern)) QUALIFY row_number() OVER (PARTITION BY shop, pattern ORDER BY product_id) <= 8), f AS (SELECT DISTINCT shop, product_id, kind, norm_value FROM typed_facts),
n AS (SELECT shop, product_id, string_agg(concat(kind, ':', norm_value), ';' ORDER BY kind, norm_value) AS facets FROM (SELECT * FROM f WHERE kind NOT IN ('VARIANT_OPTION', 'IDENTIFIER') QUALIFY row_number() OVER (PARTITION BY shop, product_id ORDER BY kind, norm_value) <= 4) GROUP BY 1, 2),
o AS (SELECT shop, product_id, string_agg(norm_value, ';' ORDER BY norm_value) AS options FROM (SELECT * FROM f WHERE kind = 'VARIANT_OPTION' AND contains(norm_value, '=') QUALIFY row_number() OVER (PARTITION BY shop, product_id ORDER BY norm_value) <= 6) GROUP BY 1, 2)
SELECT k.shop, pattern, k.product_id, title, coalesce(facets, '') AS facets, coalesce(options, '') AS options FROM k LEFT JOIN n USING (shop, product_id) LEFT JOIN o USING (shop, product_id)""")
def _(t):
    out = C.facet_samples(t("products"), t("typed_facts"), ["bolt", "RING", "red", "blue", "gear"], facets=4)
    return out.withColumns({"facets": F.array_join("facets", ";"), "options": F.array_join("options", ";")})


@query("agg29_identifying_keys", P, """WITH k AS (SELECT shop, product_id, 'title' AS kind, lower(title) AS s FROM products UNION ALL SELECT shop, product_id, 'title_vendor', lower(concat_ws('|', title, vendor)) FROM products UNION ALL SELECT shop, product_id, 'title_type', lower(concat_ws('|', title, product_type)) FROM products
UNION ALL SELECT shop, product_id, 'title_vendor_type', lower(concat_ws('|', title, vendor, product_type)) FROM products UNION ALL SELECT shop, product_id, 'title_vendor_size', lower(concat_ws('|', title, vendor, CAST(size_no AS VARCHAR))) FROM products)
SELECT shop, min(product_id) AS product_id, kind, sha256(s) AS signature FROM k GROUP BY shop, kind, s HAVING count(*) = 1""")
def _(t):
    return C.identifying_keys(t("products"))


@query("src1_tenant_scan", P, "SELECT product_id, title, vector_status FROM products WHERE shop = 'shop_1'")
def _(t):
    return t("products").where("shop = 'shop_1'").select("product_id", "title", "vector_status")


@query("src2_published_products", P, "SELECT shop, product_id FROM products WHERE blocked_reason IS DISTINCT FROM 'UNPUBLISHED' AND product_id % 2 = 0")
def _(t):
    p = t("products").withColumns({"status": F.when(F.col("product_id") % 2 == 0, "active").otherwise("DRAFT")})
    return p.where((F.upper("status") == "ACTIVE") & ~F.col("blocked_reason").eqNullSafe(F.lit("UNPUBLISHED"))).select("shop", "product_id")


@query("src3_price_ranges", P, "SELECT product_id, CASE WHEN product_id % 8 <> 0 THEN round(price, 2) END AS min_price, CASE WHEN product_id % 8 <> 0 THEN round(price + size_no, 2) END AS max_price FROM products")
def _(t):
    """Nested price ranges read from JSON; a range counts only with both bounds and a currency."""
    c = F.col
    node = F.to_json(F.struct(F.struct(F.round("price", 2).alias("min"), F.round(c("price") + c("size_no"), 2).alias("max"), F.when(c("product_id") % 8 != 0, "USD").alias("currency")).alias("range")))
    read = F.from_json(node, "range struct<min:double,max:double,currency:string>")
    rows = t("products").select("product_id", read.alias("n"))
    whole = c("n.range.min").isNotNull() & c("n.range.max").isNotNull() & c("n.range.currency").isNotNull()
    return rows.select("product_id", F.when(whole, c("n.range.min")).alias("min_price"), F.when(whole, c("n.range.max")).alias("max_price"))


@query("src4_tolerant_ranked", (), "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS kept, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 100 AS BIGINT) END AS k FROM events")
def _(t):
    raw = F.when(F.col("event_id") % 5 == 0, "[{broken").otherwise(F.concat(F.lit('[{"productId":'), (F.col("event_id") % 100).cast("string"), F.lit('},{"other":1}]')))
    items = F.filter(F.coalesce(F.from_json(raw, "array<struct<productId:bigint>>"), F.array().cast("array<struct<productId:bigint>>")), lambda x: x["productId"].isNotNull())
    return t("events").select("event_id", items.alias("x")).select("event_id", F.size("x").alias("kept"), F.get("x", F.lit(0))["productId"].alias("k"))


@query("src5_profile_facts", FACTS, "SELECT shop, product_id, kind, norm_value FROM facts GROUP BY ALL")
def _(t):
    """Profiles of two versions: a list of entries, and a map of lists; read back into facts."""
    per = t("facts").groupBy("shop", "product_id", "kind").agg(F.collect_set("norm_value").alias("v"))
    v1 = F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(F.struct("kind", F.col("v")[0].alias("value"))).alias("facts")))
    v2 = F.to_json(F.struct(F.lit(2).alias("version"), F.map_from_entries(F.collect_list(F.struct("kind", "v"))).alias("map")))
    rows = per.groupBy("shop", "product_id").agg(F.when(F.col("product_id") % 2 == 0, v1).otherwise(v2).alias("json"))
    old = F.from_json("json", "facts array<struct<kind:string,value:string>>")["facts"]
    new = F.flatten(F.transform(F.map_entries(F.from_json("json", "map map<string,array<string>>")["map"]), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("kind"), v.alias("value")))))
    out = rows.select("shop", "product_id", F.inline(F.coalesce(old, new))).select("shop", "product_id", "kind", F.col("value").alias("norm_value"))
    return top(out.dropDuplicates(), ["shop", "product_id"], ["kind", "norm_value"], C.MAX_STORED)


@query("src6_searchable_facts", ("products", "facts"), "SELECT f.shop, f.product_id, kind, norm_value FROM facts f WHERE EXISTS (SELECT 1 FROM products p WHERE p.shop = f.shop AND p.product_id = f.product_id AND p.searchable AND p.has_vector)")
def _(t):
    return t("facts").join(t("products").where("searchable AND has_vector").select("shop", "product_id"), ["shop", "product_id"], "left_semi")


@query("src8_bounded_json", ("ranked",), """WITH s AS (SELECT log_id, rnk, product_id, sum(length(CAST(product_id AS VARCHAR)) + 1) OVER (PARTITION BY log_id ORDER BY rnk) + 1 AS bytes FROM ranked)
SELECT log_id, concat('[', string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY rnk), ']') AS json FROM s WHERE bytes <= 40 GROUP BY 1""")
def _(t):
    return C.bounded_prefix(t("ranked"), ["log_id"], "rnk", "product_id", 40)


@query("src9_payload_filter", FACTS, """WITH h AS (SELECT shop, product_id FROM facts GROUP BY 1, 2 HAVING bool_or(kind = 'VENDOR') AND bool_or(norm_value IN ('bolt', 'ring', 'gear')) AND bool_or(norm_value IN ('small', 'red', 'promo')))
SELECT shop, product_id, CAST(floor((row_number() OVER (PARTITION BY shop ORDER BY product_id) - 1) / 50) AS BIGINT) AS page, count(*) OVER (PARTITION BY shop) AS total FROM h""")
def _(t):
    """Products with a vendor and one value of each group, in pages of 50, with each shop's count."""
    tokens = t("facts").groupBy("shop", "product_id").agg(F.collect_set("norm_value").alias("values"), F.collect_set("kind").alias("kinds"))
    return C.scroll(tokens.where(F.array_contains("kinds", "VENDOR")), [("bolt", "ring", "gear"), ("small", "red", "promo")], 50)
