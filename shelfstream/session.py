"""A session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "shelfstream", **conf: str) -> SparkSession:
    """UTC, adaptive execution, a state store with timers for streams; everything else is left to the cluster."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
