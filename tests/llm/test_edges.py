"""Very long texts, and pipeline stages on odd tables."""

import hashlib
import random
import zlib

import pytest

import corpus_pipeline
from shelfstream.llm import chat, decontam, exact, kernels, lines, mixing, shards, suffixes
from test_operators import brute_repeats, jump


def long_text(seed, words=60_000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" + ("\n" if i % 40 == 39 else "") for i in range(words))


def test_long_lines_shards_and_copies(documents):
    a, b = long_text(1), long_text(2)
    rows = [(1, a), (2, b), (3, a), (4, b + "\n" + a.split("\n")[0]), (5, "x" * 400_000)]
    got = {r["doc_id"]: r for r in lines.dedup_lines(documents(rows)).collect()}
    n = len(a.split("\n"))
    assert (got[1]["n_lines"], got[1]["n_dropped"], got[3]["n_dropped"]) == (n, 0, sum(len(x.strip()) >= 10 for x in a.split("\n")))
    assert got[4]["kept_text"].strip() == "" and got[5]["kept_text"] == rows[4][1] and got[2]["kept_text"] == b
    cut = {r["doc_id"]: r for r in shards.assign_shards(documents(rows), 24).collect()}
    assert all((cut[i]["size"], cut[i]["text_crc32"], cut[i]["shard"]) == (len(t) + 8, zlib.crc32(t.encode()), jump(i, 24)) for i, t in rows)
    same = {r["doc_id"]: r["keep_id"] for r in exact.exact_dedup(documents(rows[:2]), documents(rows[2:])).collect()}
    assert same == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix_sources(documents(rows)).collect()}
    assert sizes == {i: len(t.split()) for i, t in rows}


def test_long_conversation(spark):
    r = random.Random(3)
    turns = [(7, i, ("user", "assistant")[i % 2], "### " * r.randrange(4) + "\\<" * r.randrange(300)) for i in range(300)] + [(8, 0, "assistant", "</turn>" * 60_000)]
    got = {x["conv_id"]: x for x in chat.read_back(chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (7, 8):
        own = [t for t in turns if t[0] == c]
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()


def test_long_texts_around_leaks(spark, documents):
    item = " ".join(f"q{i * i % 997}" for i in range(50))
    text = long_text(5)
    rows = [(1, text + " " + item + " " + text), (2, text), (3, item.replace("q4 ", "zz ", 1))]
    bench = spark.createDataFrame([(0, item), (1, item), (2, "q1 q2 q3 q4 q5 q6 q7 q8")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["start"], x["similarity"]) for x in decontam.find_leaks(documents(rows), bench).collect()}
    assert got[1, 0] == got[1, 1] == (60_000, 1.0) and set(got) >= {(3, 0), (3, 1)} and not any(d == 2 for d, _ in got)


def test_repeats_in_texts_beyond_a_chunk(documents):
    r = random.Random(9)
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(80))
    big = long_text(6, 110_000)
    assert len(big) > kernels.CHUNK
    rows = [(1, "short " + passage), (2, big[:300_000] + passage + big[300_000:] + passage), (3, big[400_000:400_700]), (4, "end " + big[-260:])]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffixes.remove_repeats(documents(rows)).collect()}
    assert got == brute_repeats(rows, 100)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, sf_dir, stage):
    """Null ids, null and empty texts, repeated rows, an empty table, and columns of names that the stages use."""
    run = dict(corpus_pipeline.STAGES)[stage]
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(12)
    odd = spark.sql("SELECT * FROM VALUES (CAST(NULL AS BIGINT), 'a b c d e f', 'en', 's', 1), (900001L, CAST(NULL AS STRING), 'en', CAST(NULL AS STRING), 0), (900002L, '', 'en', 's', 0), (900003L, 'x y', 'en', 's', 3), (900003L, 'x y', 'en', 's', 3) AS t(doc_id, text, lang, source, n_chars)")
    docs = base.unionByName(odd.select(*[odd[c].cast(base.schema[c].dataType).alias(c) for c in base.columns]))
    for c in ("_s", "_copy", "shard", "n", "key", "score", "component_id", "size", "target", "repeats", "mark"):
        docs = docs.withColumn(c, docs["lang"])
    out = run(spark, docs, sf_dir)
    more = ["grown_shard"] if stage == "sharding" else []
    assert out.columns == docs.columns + more
    ids = [r["doc_id"] for r in out.collect()]
    if stage not in ("mixing",):
        assert None in ids and {900001, 900002, 900003} <= set(ids)
    assert run(spark, docs.limit(0), sf_dir).count() == 0
