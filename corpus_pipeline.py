"""From raw documents to sharded training data: five stages over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again for the next. Labels and the benchmark come from
sf_dir. A decision names a doc_id; the texts themselves are not shuffled while
the ids that go are few enough to broadcast.

In every stage rows with a null id stay, null and empty texts stay (the mix
takes no empty text but in whole rounds of its source), repeated rows fare
alike, an empty table gives an empty table, and columns beyond those of documents are
carried along; sharding replaces columns named shard and grown_shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfstream.llm.common import checkpointed, small, table, written
from shelfstream.llm.decontam import find_leaks
from shelfstream.llm.jaccard import jaccard_components
from shelfstream.llm.mixing import mixed
from shelfstream.llm.shards import with_shards
from shelfstream.llm.toxicity import score_toxicity

SHARDS = 24


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows with one of the (doc_id) ids; rows with a null id stay."""
    return docs.join(small(checkpointed(ids.select("doc_id").distinct())), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return _without(docs, score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of 5-word shingle similarity 0.8 the least doc_id stays."""
    return _without(docs, jaccard_components(docs, k=5, num=80, den=100).where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of similarity 0.8 to a benchmark item go."""
    return _without(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources (weights 1, 2, 3 in turn, at most 3 rounds) takes it."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard (of 24) and grown_shard (of 25)."""
    return with_shards(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Votes of nearest examples cannot be told in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
