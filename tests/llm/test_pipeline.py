"""Each stage of the pipeline does its whole job on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from shelfstream.llm.common import written
from test_operators import brute_components, brute_leaks, brute_toxicity, jump

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir)))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1]) and stages[-1].columns == [*COLUMNS, "shard", "grown_shard"]


def test_toxic_ones_go(spark, sf_dir, stages):
    """What goes is what the vote of all cosines rejects, and labels agree."""
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    before, after = texts(stages[0]), texts(stages[1])
    want = {i for i, (score, _) in brute_toxicity(list(before.items()), labels).items() if score >= 0.5}
    assert set(before) - set(after) == want
    known = [y for i, y in labels if i in want]
    assert sum(known) >= 0.9 * len(known) and len(after) >= 0.75 * len(before)


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after) == set(brute_components(list(before.items()), 5, 80, 100).values())


def test_leaks_go(spark, sf_dir, stages):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) - set(after) == {i for i, _ in brute_leaks(list(before.items()), items)}


def test_mix_meets_targets(stages):
    def size(t):
        return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))

    before = stages[3].collect()
    taken = Counter()
    for r in stages[4].collect():
        taken[r["source"]] += size(r["text"])
    own, most = Counter(), Counter()
    for r in before:
        own[r["source"]] += size(r["text"])
        most[r["source"]] = max(most[r["source"]], size(r["text"]))
    order = sorted(own)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    clamped = set()
    while True:
        left, w = sum(own.values()) - sum(3 * own[s] for s in clamped), sum(weight[s] for s in order if s not in clamped)
        over = {s for s in order if s not in clamped and weight[s] * left / w > 3 * own[s]}
        if not over:
            break
        clamped |= over
    for s in order:
        target = 3 * own[s] if s in clamped else weight[s] * left / w
        assert abs(taken[s] - target) <= most[s], s
    assert max(Counter(r["doc_id"] for r in stages[4].collect()).values()) <= 3


def test_shards(stages):
    assert all((r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 24), jump(r["doc_id"], 25)) for r in stages[5].select("doc_id", "shard", "grown_shard").collect())
    assert stages[5].count() == stages[4].count()
