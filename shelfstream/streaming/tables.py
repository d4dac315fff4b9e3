"""Tables that streams write: versions that appear whole, late rows beside the others, catalog scans."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sync import stale_actions, upsert

BUCKETS = 64


class VersionedTable:
    """A Parquet table in buckets of its keys' hash, of which a manifest names the folder of each bucket.

    A batch rewrites the buckets it touches into a new folder and then writes
    the manifest of its number, one file whose appearance is the new version.
    Until then readers see the version before; a batch that is torn leaves
    only a folder that no manifest names, and a batch whose number the
    manifest already has changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """Number of the last whole batch, -1 before the first."""
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return -1
        done = [f.getPath() for f in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return max((int(d.getName()[1:]) for d in done), default=-1)

    def _folders(self, version: int) -> dict[int, str]:
        if version < 0:
            return {}
        return {r["bucket"]: r["folder"] for r in self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/manifest/v{version}").collect()}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, the last whole one unless named."""
        at = self._folders(self.version() if version is None else version)
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(at.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, number: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Makes version ``number``: ``change(before, rows)`` of the buckets that the rows touch. False if it is there already."""
        last = self.version()
        if number <= last:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}
        folder, at = f"b{number}-{uuid.uuid4().hex}", self._folders(last)
        if touched:
            after = change(self.read(last, touched), rows).withColumn("bucket", bucket)
            after.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            fs, p = self._fs(f"{self.path}/data/{folder}")
            held = {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if "=" in f.getPath().getName()}
            at = {b: f for b, f in at.items() if b not in touched} | {b: folder for b in held}
        self.spark.createDataFrame(sorted(at.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{number}")
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` versions and the folders that only these named."""
        fs, p = self._fs(f"{self.path}/manifest")
        numbers = sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(p))
        kept, gone = numbers[-keep:], numbers[:-keep]
        used = {f for n in kept for f in self._folders(n).values()}
        data = self._fs(f"{self.path}/data")[1]
        for n in gone:
            fs.delete(self._fs(f"{self.path}/manifest/v{n}")[1], True)
        for f in fs.listStatus(data):
            if f.getPath().getName() not in used:
                fs.delete(f.getPath(), True)


def upsert_sink(path: str, schema: str, keys: list[str], version: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """SRC7 in streams: a function for foreachBatch that merges each batch's latest rows into a ``VersionedTable``."""

    def write(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path, schema, keys, buckets)
        table.merge(batch, number, lambda before, rows: upsert(before, rows.select(*before.columns), keys, version))

    return write


def split_late(path: str, time: str, late_seconds: int) -> Callable[[DataFrame, int], None]:
    """STR13: a function for foreachBatch that puts rows in time into ``path/rows`` and later ones into ``path/late``, by batch.

    A row is late if the newest time of all batches before is more than
    ``late_seconds`` ahead of it. Each batch writes its own folders and, last,
    the newest time so far; a batch that is repeated writes the same again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, F.unix_micros(F.col(time).cast("timestamp"))
        newest = spark.read.schema("newest long").parquet(f"{path}/marks/batch={number - 1}").first()[0] if number else None
        is_late = F.lit(False) if newest is None else F.coalesce(at < newest - late_seconds * 1_000_000, F.lit(False))
        flagged = batch.withColumn("_late", is_late).persist()
        try:
            flagged.where("NOT _late").drop("_late").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            flagged.where("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            mark = flagged.agg(F.greatest(F.max(at), F.lit(newest).cast("long")).alias("newest"))
            mark.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        finally:
            flagged.unpersist()

    return write


REGISTRY = "shop string, product_id long, scan_id long, page int, seen_at timestamp, action string"


def scan_sink(path: str, live: Callable[[SparkSession], DataFrame] | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """STR12: a function for foreachBatch that keeps a catalog's registry from the pages of its scans.

    Batches hold products (shop, scan_id, page, pages, product_id, published,
    seen_at), ``pages`` being null but on the last page of a scan; a page
    without products has one row without product. ``path/pages`` has the pages
    seen of each shop's newest scan, ``path/registry`` each product with its
    last scan. Only when all pages of a scan are there are the products that
    it did not see held against ``live`` (shop, product_id, published): what
    is not there, or all without ``live``, is REMOVED. What a scan saw is SEEN
    or UNPUBLISHED. A page that comes again is the same page; pages of an
    older scan than the newest are left aside; a scan that stops removes
    nothing, whatever follows it.

    A batch makes two versions of the registry, what was seen and what a
    whole scan did not see, and last one of the pages; a batch that is torn
    goes on behind the last of these that is whole.
    """
    page_schema = "shop string, scan_id long, page int, last_page int, done boolean"

    def put(before: DataFrame, rows: DataFrame) -> DataFrame:
        return upsert(before, rows, ["shop", "product_id"], "scan_id")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pages = VersionedTable(spark, f"{path}/pages", page_schema, ["shop"], buckets)
        registry = VersionedTable(spark, f"{path}/registry", REGISTRY, ["shop", "product_id"], buckets)
        if pages.version() >= number:
            return
        batch = batch.persist()
        try:
            new = batch.groupBy("shop", "scan_id", "page").agg(F.max("pages").alias("last_page"), F.lit(False).alias("done"))
            shops = new.select("shop").distinct()
            every = pages.read().join(shops, "shop", "left_semi").unionByName(new)
            every = every.groupBy("shop", "scan_id", "page").agg(F.max("last_page").alias("last_page"), F.max("done").alias("done"))
            newest = every.groupBy("shop").agg(F.max("scan_id").alias("scan_id"))
            every = every.join(newest, ["shop", "scan_id"])
            whole = every.groupBy("shop", "scan_id").agg(F.max("last_page").alias("last"), F.count("*").alias("there"), F.max("done").alias("was")).where("there >= last AND NOT was")
            seen = batch.where("product_id IS NOT NULL").join(newest, ["shop", "scan_id"])
            registry.merge(seen.select("shop", "product_id", "scan_id", "page", "seen_at", F.when(F.col("published"), "SEEN").otherwise("UNPUBLISHED").alias("action")), 2 * number, put)
            lost = registry.read().join(whole.select("shop", F.col("scan_id").alias("whole_scan")), "shop").where("scan_id < whole_scan AND action <> 'REMOVED'")
            if not lost.isEmpty():
                there = live(spark) if live else spark.createDataFrame([], "shop string, product_id long, published boolean")
                acts = stale_actions(lost.select("shop", "product_id"), there).withColumnRenamed("action", "act")
                action = F.when(F.col("act") == "REMOVE", "REMOVED").when(F.col("act") == "TOUCH", "SEEN").otherwise("UNPUBLISHED")
                lost = lost.join(acts, ["shop", "product_id"]).select("shop", "product_id", F.col("whole_scan").alias("scan_id"), "page", "seen_at", action.alias("action"))
                registry.merge(lost, 2 * number + 1, put)
            told = every.join(whole.select("shop", F.lit(True).alias("ends")), "shop", "left")
            told = told.select("shop", "scan_id", "page", "last_page", (F.col("done") | F.coalesce("ends", F.lit(False))).alias("done"))
            pages.merge(told, number, lambda before, rows: before.join(rows.select("shop").distinct(), "shop", "left_anti").unionByName(rows))
        finally:
            batch.unpersist()

    return write
