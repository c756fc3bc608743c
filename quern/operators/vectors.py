"""A store of vectors as a table: rows are replaced, deleted and summed up, never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store (vec_id, embedding) with the rows of ``new`` in place of those with their ids."""
    return store.select("vec_id", "embedding").join(new.select("vec_id").distinct(), "vec_id", "left_anti").unionByName(new.select("vec_id", "embedding"))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the rows whose vec_id is in ``ids``."""
    return store.join(ids.select("vec_id").distinct(), "vec_id", "left_anti")


def manifest(store: DataFrame) -> DataFrame:
    """One row: count, least and most dimensions, the ids at both ends, and how many vectors are zero or hold no number."""
    empty = F.size("embedding") == 0
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    zero = F.forall("embedding", lambda x: x == 0)
    return store.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).cast("long").alias("least_dim"), F.max(F.size("embedding")).cast("long").alias("most_dim"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"),
        F.count_if(empty | odd | zero).alias("n_unusable"),
    )
