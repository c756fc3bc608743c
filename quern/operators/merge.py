"""Dedupe and merge rules that keep order: first wins, best payload at the first place, first non-null, append if new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row a key: the one that comes first. An aggregation, not a sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, *(f"r.{c}" for c in rest))


def best_at_first_place(rows: DataFrame, key: Sequence[str], order: str, score: Column) -> DataFrame:
    """One row a key: the one with the highest score (ties: the first), with ``place``, where the key first came."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(score, -F.col(order)))
    return rows.groupBy(*key).agg(best.alias("r"), F.min(order).alias("place")).select(*key, *(f"r.{c}" for c in rest), "place")


def first_values(rows: DataFrame, key: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """For each key the first non-null value of each column by order."""
    return rows.groupBy(*key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def append_new(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """All of ``first``, and the rows of ``second`` whose key is new."""
    return first.unionByName(second.join(first.select(*key).distinct(), list(key), "left_anti"))


def span_with_summary(rows: DataFrame, key: Sequence[str], start: str, end: str, summary: Column) -> DataFrame:
    """Earliest start and latest end of each key, from summary rows where there are any; days only from those."""
    picked = rows.withColumn("__s", summary)
    agg = picked.groupBy(*key).agg(
        F.coalesce(F.min(F.when(F.col("__s"), F.col(start))), F.min(start)).alias("first"), F.coalesce(F.max(F.when(F.col("__s"), F.col(end))), F.max(end)).alias("last"), F.coalesce(F.bool_or("__s"), F.lit(False)).alias("from_summary")
    )
    return agg.withColumn("days", F.when(F.col("from_summary"), F.datediff("last", "first").cast("long")))


def vote(rows: DataFrame, doc: str, title: str, on_cover: Column, order: str) -> DataFrame:
    """Each document's title: of distinct titles the one on a cover, then the longest, then the most frequent, then the first in code-point order; with its votes and first place."""
    counted = rows.withColumn("__c", on_cover).groupBy(doc, title).agg(F.bool_or("__c").alias("cover"), F.count(F.lit(1)).alias("votes"), F.min(order).alias("place"))
    best = F.max_by(F.struct(title, "cover", "votes", "place"), F.struct("cover", F.length(title), "votes", -F.col("place")))
    return counted.groupBy(doc).agg(best.alias("b")).select(doc, f"b.{title}", "b.cover", "b.votes", "b.place")


def presence(rows: DataFrame, doc: str, line: str, patterns: dict[str, str]) -> DataFrame:
    """Whether any line of a document has each pattern."""
    return rows.groupBy(doc).agg(*(F.coalesce(F.bool_or(F.regexp_like(line, F.lit(p))), F.lit(False)).alias(n) for n, p in patterns.items()))
