"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are range
partitioned by the key's leading bits and sorted by the key inside each range;
word counts are summed per range, prefix-summed over the ranges, and then summed
along each range, which gives every document its place on the source's line of
words. A source whose target is e whole epochs and a rest takes e copies of
everything and the line up to exactly the rest. All steps are DataFrame
operations; only (source, range) sums are shared between ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """32 hexadecimal digits that look random, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """no_source, source, source_size and target of each source.

    ``sizes`` has no_source (true for null), source and size. Sources by code
    point, null last, take ``weights`` in turn and share ``share`` times all
    words; a target stops at ``epochs`` times its source's size and what is over
    goes to the others by weight until none is above (water filling: with sources
    by cap over weight, the level that fits is found by one running sum). One
    row a source reaches this step's windows.
    """
    names = Window.orderBy("no_source", "source")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    after = Window.orderBy(F.desc(F.col("cap") / F.col("weight")), F.desc("no_source"), F.desc("source")).rowsBetween(Window.unboundedPreceding, 0)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    turn = (F.row_number().over(names) - 1) % len(weights)
    out = sizes.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    out = out.withColumn("cap", epochs * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    out = out.withColumn("own_level", level).withColumn("fits", F.col("own_level") * F.col("weight") < F.col("cap"))
    out = out.withColumn("level", F.min_by("own_level", F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "no_source", "source"))).over(everything))
    target = F.when(F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("weight")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return out.select("no_source", "source", "source_size", target.alias("target"))


def _placed(docs: DataFrame, weights: Sequence[int], share: float, epochs: int, seed: int, range_digits: int, rows: bool) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row, and with ``rows`` the whole row as a struct."""
    own = [F.struct(*docs.columns).alias("row")] if rows else []
    sized = docs.select("doc_id", "source", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"), size_of(F.col("text")).alias("size"), *own)
    sized = sized.withColumn("key", random_key(F.col("doc_id"), seed)).withColumn("range", F.substring("key", 1, range_digits))
    ranges = sized.groupBy("no_source", "name", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.select("no_source", F.col("name").alias("source"), F.col("range_size").alias("size")), weights, share, epochs)
    targets = targets.withColumnRenamed("source", "name")
    line = Window.partitionBy("no_source", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(line), F.lit(0))).drop("range_size").join(targets, ["no_source", "name"])
    inside = Window.partitionBy("no_source", "name", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("size").over(inside)).join(starts, ["no_source", "name", "range"])
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("upto") + F.col("size")))
    taken = (whole * F.col("size") + part).cast("long").alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken, *(["row"] if rows else []))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 7, range_digits: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row.

    taken counts the words that the mix takes of the document, repeats included,
    from 0 to ``epochs`` times its size; each source's taken words are its target
    rounded down. A null text has size 0, a null source is a source of its own.
    Repeated rows each count; rows with equal doc_id and size are interchangeable,
    and reruns agree. ``range_digits`` is the number of leading hexadecimal digits
    of the key that make a range (16**3 ranges a source). Other columns are
    ignored; an empty table gives an empty result.
    """
    return _placed(docs, weights, share, epochs, seed, range_digits, rows=False)


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its word number ``count``, white space kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), count.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 7, range_digits: int = 3) -> DataFrame:
    """The mix itself: each row once for every whole copy taken, and once cut to the words of a partial copy.

    Rows of which nothing is taken go, except that documents without a word cost
    nothing and stay once. The columns are those of ``docs``; where there is
    n_chars, cut rows get their own. Rows travel with their plan: repeated and
    null doc_ids are rows like any other. Other cases are those of :func:`mix`.
    """
    placed = _placed(docs, weights, share, epochs, seed, range_digits, rows=True)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    rows = placed.select("size", "taken", "row", copies.alias("copies")).where("copies > 0")
    rows = rows.select("size", "taken", "row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    words = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    cut = (F.col("size") > 0) & (words < F.col("size"))
    rows = rows.select("row", cut.alias("cut"), F.when(cut, first_words(F.col("row.text"), words)).otherwise(F.col("row.text")).alias("said"))
    own = {"text": F.col("said"), "n_chars": F.when(F.col("cut"), F.length("said")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*((own[c].cast(t) if c in own else F.col("row").getField(c)).alias(c) for c, t in docs.dtypes))
