"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, read_back
from .common import table
from .decontam import find_leaks
from .exact import exact_dedup
from .jaccard import jaccard_components
from .lines import dedup_lines
from .merkle import digest, folded, leaf_of, merkle_manifest, siblings
from .mixing import mix_sources
from .negatives import hard_negatives
from .pieces import encode_pieces
from .shards import FACTOR, assign_shards
from .suffixes import remove_repeats
from .tokens import count_tokens
from .toxicity import score_toxicity

SHARDS, TOKEN_LIMIT = 24, 4096


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.unionByName(extra)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids are the history that the index holds, odd ids the new batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.coalesce(F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.lit(False))
    return exact_dedup(docs.where(old), docs.where(~old))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and whether each one, a seventh of them tampered with, still folds to the root."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = [F.when(hit, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in columns]
    out = merkle_manifest(table(spark, sf_dir, "documents"), columns, also={"found": F.when(hit, leaf_of(found))})
    out = out.withColumn("folded_root", folded(F.col("steps"), F.coalesce("found", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("steps"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod(F.col("vec_id"), F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_hard_negatives": op13_hard_negatives,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_step() -> str:
    """One byte of CRC-32: the table entry of a byte is the sum (xor) of those of its bits."""
    bit = []
    for i in range(8):
        c = 1 << i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        bit.append(c)
    x = "(xor(c, b) & 255)"
    terms = [f"((({x}) >> {i}) & 1) * {v}" for i, v in enumerate(bit)]
    step = "(c >> 8)"
    for t in terms:
        step = f"xor({step}, {t})"
    return step


def _leaf(n_chars: str) -> str:
    """The leaf's digest in SQL."""
    texts = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return f"sha256(concat({', '.join(f"coalesce(concat(octet_length(encode({t})), ':', {t}), '-')" for t in texts)}))"


ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2], ' ', ws[i + 3]) END AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) k ON k.x = d.doc_id""",
    "op2_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS f FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, (s.f IS NOT NULL AND s.f <> k.doc_id) AS lost FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op3_sharding": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, (CAST(doc_id AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS k,
         CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM (SELECT DISTINCT doc_id FROM d)
  UNION ALL
  SELECT doc_id, (k * {FACTOR} + 1) % 18446744073709551616, CASE WHEN j < {SHARDS} THEN j ELSE a END, j,
         CAST(floor(CAST(j + 1 AS DOUBLE) * (CAST(2147483648 AS DOUBLE)
           / CAST(((k * {FACTOR} + 1) % 18446744073709551616) // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM w WHERE j < {SHARDS + 1}),
e AS (SELECT doc_id, max(a) AS a, max(b) AS b FROM w GROUP BY doc_id),
c AS (SELECT doc_id, CAST(octet_length(encode(t)) + 8 AS BIGINT) AS size,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
          list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))),
          lambda c, b: {_crc_step()}), 4294967295) AS text_crc32 FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(a AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY a ORDER BY doc_id % 256, doc_id, size, text_crc32) - 1 AS slot, CAST(b AS INTEGER) AS grown_shard
FROM c JOIN e USING (doc_id)""",
    "op4_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(t) - length(translate(t, '\#<', '')) + length(role) - length(translate(role, '\#<:', '')) AS marks FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), t, chr(10)), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(t) + length(role) + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5(concat('mix:', CAST(doc_id AS VARCHAR))) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, r % 3 + 1 AS weight FROM s),
o AS (SELECT *, sum(n) OVER () AS total, sum(weight) OVER () AS weights,
        coalesce(sum(n) OVER b, 0) AS n_before, coalesce(sum(weight) OVER b, 0) AS w_before
      FROM w WINDOW b AS (ORDER BY n / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, total - 3 * n_before AS rest, weights - w_before AS shared,
        weight * (total - 3 * n_before) > 3 * n * (weights - w_before) AS clamped FROM o),
f AS (SELECT rest AS open_rest, shared AS open_shared FROM c WHERE NOT clamped ORDER BY shared DESC LIMIT 1),
p AS (SELECT source, n, CASE WHEN clamped THEN CAST(3 * n AS DOUBLE) ELSE CAST(weight * open_rest AS DOUBLE) / CAST(open_shared AS DOUBLE) END AS target
      FROM c LEFT JOIN f ON true),
q AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS rounds FROM p),
x AS (SELECT d.doc_id, d.size, q.n, q.target, q.rounds, q.target - q.rounds * q.n AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * (rounds + CASE WHEN size > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE c AS (SELECT doc_id, lang, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))), lambda c, b: {_crc_step()}) AS crc,
    {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS other FROM documents),
f AS (SELECT *, coalesce(xor(crc, 4294967295) % 7 = 0, false) AS hit, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM c),
t AS (SELECT lang AS g, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM f
  UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, level, pos // 2, n),
r AS (SELECT 0 AS level, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n FROM t WHERE n = 1
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM r WHERE n > 1 GROUP BY level, pos // 2, n),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS place FROM t WHERE n = 1),
p AS (SELECT f.lang AS g, f.pos AS leaf_pos, v.level AS step, CASE WHEN o.h IS NULL THEN '' WHEN o.pos < v.pos THEN concat('L', o.h) ELSE concat('R', o.h) END AS sib
  FROM f JOIN t v ON v.g IS NOT DISTINCT FROM f.lang AND v.pos = f.pos >> v.level AND v.n > 1
  LEFT JOIN t o ON o.g IS NOT DISTINCT FROM f.lang AND o.level = v.level AND o.pos = xor(v.pos, 1)
  UNION ALL SELECT f.lang, f.pos, 1000 + v.level, CASE WHEN o.h IS NULL THEN '' WHEN o.pos < v.pos THEN concat('L', o.h) ELSE concat('R', o.h) END
  FROM f JOIN s ON s.g IS NOT DISTINCT FROM f.lang JOIN r v ON v.pos = s.place >> v.level AND v.n > 1 LEFT JOIN r o ON o.level = v.level AND o.pos = xor(v.pos, 1)),
w AS (SELECT g, leaf_pos, list(sib ORDER BY step) AS way FROM p GROUP BY g, leaf_pos),
e AS (SELECT f.doc_id, f.leaf, s.subroot, (SELECT h FROM r WHERE n = 1) AS root, coalesce(w.way, []) AS way, CASE WHEN f.hit THEN f.other ELSE f.leaf END AS found
  FROM f JOIN s ON s.g IS NOT DISTINCT FROM f.lang LEFT JOIN w ON w.g IS NOT DISTINCT FROM f.lang AND w.leaf_pos = f.pos),
z AS (SELECT *, list_reduce(list_prepend(found, way), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN concat(x[2:], a) ELSE concat(a, x[2:]) END)) AS folded_root FROM e)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY rank <= 10""",
}
