"""Named queries over the input tables, each with the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Tables, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _counts_as_bigint(sql: str) -> str:
    """DuckDB's count_if is wider than Spark's; casts each call."""
    out, rest = "", sql
    while "count_if(" in rest:
        head, rest = rest.split("count_if(", 1)
        depth = i = 1
        while depth:
            depth += (rest[i - 1] == "(") - (rest[i - 1] == ")")
            i += 1
        out += f"{head}CAST(count_if({rest[: i - 1]} AS BIGINT)"
        rest = rest[i - 1 :]
    return out + rest


def query(name: str, views: tuple[str, ...] = (), sql: str = ""):
    """Registers a function of ``Tables``; ``sql`` may read the views and may begin with WITH."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            own, body = ctes(views), _counts_as_bigint(sql.strip())
            recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE") else ""
            if body.startswith("WITH"):
                body = body.removeprefix("WITH").strip().removeprefix("RECURSIVE").strip()
                ORACLES[name] = f"WITH {recursive}{', '.join([*own, body])}"
            else:
                ORACLES[name] = (f"WITH {', '.join(own)} " if own else "") + body
        return f

    return add
