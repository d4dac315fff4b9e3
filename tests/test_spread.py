"""A table that is one small file is dealt over all tasks before its rows cost or multiply, and what is used often is worked out once."""

import re

import pytest
from pyspark.sql import functions as F

from shelfstream import plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_are_dealt_before_they_multiply(spark, sf_dir):
    """one exchange, of products; their facts are sorted where they arise."""
    text = plan(plans.QUERIES["doc6_typed_facts"](spark, sf_dir))
    assert len(re.findall("Exchange ", text)) == 1 and text.index("Generate ") < text.index("Exchange ")


def test_probes_are_dealt(spark, sf_dir):
    """profiles that come in one partition are worked on in as many tasks as a shuffle has."""
    from shelfstream.operators.demand import demand_probes
    from test_demand import SCHEMA, profiles

    rows = spark.createDataFrame(profiles(20), SCHEMA).coalesce(1)
    assert demand_probes(rows, ["id"]).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_titles_meet_signals_once(spark, sf_dir):
    """signals meet distinct titles; products are neither multiplied nor made distinct."""
    text = plan(plans.QUERIES["txt21_phrase_containment"](spark, sf_dir))
    assert "Join" in text and not re.search(r"Aggregate\(keys=\[[^\]]*product_id", text)


def test_bounds_are_read_once(spark, sf_dir):
    """no text of a bound is read for each ranked product."""
    assert "regexp_extract_all" not in plan(plans.QUERIES["jn14_price_residual"](spark, sf_dir))


@pytest.mark.parametrize("name", ["doc1_product_documents", "doc3_content_hashes", "doc4_migration_test", "doc7_grounded_facts"])
def test_documents_are_dealt(name, spark, sf_dir):
    """products are dealt over all tasks before their documents are written."""
    assert "REPARTITION_BY_NUM" in plan(plans.QUERIES[name](spark, sf_dir))


def test_documents_keep_the_first_form(spark):
    """One of each lower-case form, the first, in order of the forms; blanks alone are nothing."""
    from shelfstream.operators.catalog import unique_sorted

    df = spark.createDataFrame([(["b  B", "A", " ", "a", None, "B b", "c"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(unique_sorted(F.col("v"), 2)).collect()] == [["A", "b  B".replace("  ", " ")], [], None]
