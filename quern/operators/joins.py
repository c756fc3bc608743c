"""Joins beyond equality: as-of, band, interval and arg-max, as windows or bucketed equi-joins.

None of them is a nested loop: positions are cut into buckets that serve as a
join key, and the exact condition is a residual of the equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: Column, right_at: Column, width: float, how: str = "inner") -> DataFrame:
    """Pairs with equal keys and |left_at - right_at| <= width. Columns of both sides must differ but for the keys."""
    a = left.withColumn("__l", left_at).withColumn("__b", F.explode(F.array(*(F.floor(F.col("__l") / width) + i for i in (-1, 0, 1)))))
    b = right.withColumn("__r", right_at).withColumn("__b", F.floor(F.col("__r") / width))
    meets = F.col("a.__b") == F.col("b.__b")
    for k in keys:
        meets = meets & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.alias("a").join(b.alias("b"), meets & (F.abs(F.col("__l") - F.col("__r")) <= width), how)
    own = [F.col(f"a.{c}") for c in left.columns]
    return pairs.select(*own, *([] if how in ("left_semi", "left_anti") else [F.col(f"b.{c}") for c in right.columns if c not in keys]))


def against(rows: DataFrame, key: str, queries: DataFrame, block: int = 64) -> DataFrame:
    """Every row with every query of a stated set, in blocks: an equality join by block and salt.

    Queries (with query_id) are dealt over blocks of about ``block``, each one row
    with an array; a row goes to each block once, to a salt by its ``key``, so that
    no task gets all rows of a block. The set is what grows the work.
    """
    blocks = max(1, -(-queries.count() // block))
    salts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    dealt = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("__block")).agg(F.collect_list(F.struct(*queries.columns)).alias("__queries"))
    dealt = dealt.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sent = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    met = sent.join(dealt, ["__block", "__salt"])
    return met.select(*rows.columns, F.explode("__queries").alias("__q")).select(*rows.columns, "__q.*")


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: Column, first: Column, last: Column, width: float) -> DataFrame:
    """Points with the intervals that hold them (ends included): intervals are dealt to the buckets they touch, a point lies in one."""
    a = points.withColumn("__p", point).withColumn("__b", F.floor(F.col("__p") / width))
    b = intervals.withColumn("__f", first).withColumn("__t", last).withColumn("__b", F.explode(F.sequence(F.floor(F.col("__f") / width), F.floor(F.col("__t") / width))))
    met = a.join(b, [*keys, "__b"]).where("__p between __f and __t")
    return met.drop("__p", "__b", "__f", "__t")


def asof_backward(doc: str, order: Sequence[str], value: Column) -> Column:
    """The last non-null value up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def rows_after(doc: str, order: Sequence[str]) -> WindowSpec:
    """The rows after each row, from the last one on: Spark sums up frames that grow, but makes frames that shrink anew for each row."""
    return Window.partitionBy(doc).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)


def asof_forward(doc: str, order: Sequence[str], value: Column) -> Column:
    """The first non-null value after the row."""
    return F.last(value, ignorenulls=True).over(rows_after(doc, order))


def neighbour_best(doc: str, order: Sequence[str], reach: int, score: str, value: str, cost: int = 3) -> Column:
    """struct(score, distance, value) of the neighbour within ``reach`` rows with the highest score less cost for each row of distance; ties go to the nearer, then to the earlier."""
    w = Window.partitionBy(doc).orderBy(*order)
    near = [F.struct((F.lag(score, k).over(w) - cost * abs(k)).alias("score"), F.lit(-abs(k)).alias("near"), F.lit(k).alias("back"), F.lag(value, k).over(w).alias("value")) for k in range(-reach, reach + 1) if k]
    best = F.array_max(F.filter(F.array(*near), lambda s: s["score"].isNotNull()))
    return best


def adjacent(doc: str, order: Sequence[str], value: Column) -> Column:
    """The row's own value, else that of the row before, else that of the row after."""
    w = Window.partitionBy(doc).orderBy(*order)
    return F.coalesce(value, F.lag(value).over(w), F.lead(value).over(w))


def best_match(items: DataFrame, parts: DataFrame, item: str, page: str) -> DataFrame:
    """For each item the page that shares most of its parts by length: item, page and score; ties go to the first page.

    ``items``: item and part, ``parts``: page and part; both are distinct rows. An
    equality join on parts, one aggregation, one arg-max.
    """
    scored = items.join(parts, "part").groupBy(item, page).agg(F.sum(F.length("part")).alias("score"))
    return scored.groupBy(item).agg(F.max_by(F.struct(page, "score"), F.struct("score", -F.col(page))).alias("b")).select(item, f"b.{page}", "b.score")


def lookup_status(left: DataFrame, right: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the only row of ``right`` that has its key, and lookup: FOUND, UNKNOWN or CONFLICT."""
    told = right.groupBy(key).agg(F.countDistinct(F.struct(*values)).alias("n"), *(F.min(v).alias(v) for v in values))
    out = left.join(told, key, "left")
    clear = F.col("n") == 1
    return out.select(*left.columns, *(F.when(clear, F.col(v)).alias(v) for v in values), F.when(F.col("n").isNull(), "UNKNOWN").when(clear, "FOUND").otherwise("CONFLICT").alias("lookup"))
