"""Stores on Parquet: standards tables, write-once rows, and derived results that are kept by fingerprint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import ids


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class StandardStore:
    """documents, pages, chapters and articles of standards, partitioned by standard_id, so that a scope reads its own files only."""

    TABLES = ("documents", "pages", "chapters", "articles")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        if name not in self.TABLES:
            raise ValueError(f"no table {name}")
        return f"{self.root}/{name}"

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace the partitions that ``rows`` holds; the file commit makes it whole or not at all."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("standard_id").parquet(self.path(name))

    def read(self, name: str, standard_ids: Sequence[str] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path(name))
        return rows if standard_ids is None else rows.where(F.col("standard_id").isin(*standard_ids))

    def listing(self) -> DataFrame:
        """Documents with counts of pages and articles, the newest first."""
        out = self.read("documents")
        for name in ("pages", "articles"):
            if exists(self.spark, self.path(name)):
                out = out.join(self.read(name).groupBy("standard_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "standard_id", "left").na.fill(0, [f"n_{name}"])
        return out.orderBy(F.desc("created_at"), "standard_id")

    def has_fields(self, name: str, required: Sequence[str]) -> bool:
        """Whether stored rows are there and have all columns."""
        if not exists(self.spark, self.path(name)):
            return False
        rows = self.read(name)
        return set(required) <= set(rows.columns) and not rows.isEmpty()

    def unknown(self, wanted: DataFrame) -> DataFrame:
        """Wanted standard_ids without a document."""
        return wanted.join(self.read("documents").select("standard_id"), "standard_id", "left_anti")

    def compatible(self, parser_version: str, semantics_version: str) -> DataFrame:
        """standard_ids that need no new parse."""
        return self.read("documents").where((F.col("parser_version") == parser_version) & (F.col("semantics_version") == semantics_version)).select("standard_id")


def append_once(spark: SparkSession, path: str, rows: DataFrame, key: str) -> DataFrame:
    """Append rows whose key is new; returns the keys that are there with other contents, which are never overwritten.

    ``rows`` gets the column content_hash over all of its others.
    """
    rest = {c: F.col(c).cast("string") for c in rows.columns if c != key}
    hashed = rows.withColumn("content_hash", F.sha2(ids.canonical_json(rest), 256))
    if not exists(spark, path):
        hashed.dropDuplicates([key]).write.parquet(path)
        return hashed.groupBy(key).agg(F.countDistinct("content_hash").alias("n")).where("n > 1").select(key)
    held = spark.read.parquet(path).select(key, F.col("content_hash").alias("held"))
    met = hashed.join(held, key, "left")
    conflicts = met.where("held is not null and held <> content_hash").select(key).distinct()
    conflicts = spark.createDataFrame(conflicts.toArrow()) if not conflicts.isEmpty() else conflicts.limit(0)
    met.where("held is null").drop("held").dropDuplicates([key]).write.mode("append").parquet(path)
    return conflicts


def cached(spark: SparkSession, path: str, inputs: DataFrame, key: str, version: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results by key, computed only for inputs whose (version, key, fingerprint) is not held yet, and held afterwards."""
    rest = {c: F.col(c).cast("string") for c in inputs.columns if c != key}
    marked = inputs.withColumn("fingerprint", F.sha2(ids.canonical_json(rest), 256)).withColumn("version", F.lit(version))
    keys = ["version", key, "fingerprint"]
    todo = marked.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if exists(spark, path) else marked
    fresh = compute(todo.drop("fingerprint", "version")).join(todo.select(*keys), key)
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(marked.select(*keys), keys, "left_semi")
