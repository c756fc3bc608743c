"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors by a key of concatenated random sign hashes of its
own and compares each vector with the next ``window`` in that order; pairs at or
above the threshold are links, and the links of all passes are united. Vectors
that lie close agree in most hashes, so in some pass they stand side by side.
The number of passes follows from the number of vectors: a window covers fewer
leading hashes of a longer order, so that more passes are needed for the same
chance to meet. Every vector's place in the order is exact, and windows go over
the borders of tasks: results do not depend on how rows are dealt.
What a bounded window leaves out inside dense groups is made up exactly: the
vectors of each component are compared in full, in blocks, which counts all
links without writing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import discard, materialize

KEY_BITS = 60
#: Vectors in a block of a component, least and most: a sixteenth of it in between, for tasks of even size and few copies.
BLOCKS = 256, 2000
#: Places of the order that are compared in one group.
SPAN = 2048


def _matrix(vectors: pa.Array | pd.Series) -> np.ndarray:
    """Rows of unit length in double precision; all vectors have one dimension."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, KEY_BITS))


def projection_keys(x: np.ndarray, seed: int) -> np.ndarray:
    """KEY_BITS sign hashes of each row, the first as the highest bit."""
    signs = (x @ _planes(seed, x.shape[1]) > 0).astype(np.int64)
    return signs @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))


def passes_for(vectors: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which two vectors at the threshold, alone among ``vectors`` spread evenly, have met with probability ``recall``.

    In one pass they meet if they agree in the leading hashes that tell windows apart.
    """
    agree = 1 - acos(min(1.0, max(-1.0, threshold))) / pi
    meet = agree ** max(0.0, log2(max(2, vectors) / window))
    return max(8, ceil(log(1 - recall) / log(1 - meet))) if meet < 1 else 8


def _keyed(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """pass, dim, key and node: every vector once for each pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                x = _matrix(part["vector"])
                for p in range(passes):
                    yield pd.DataFrame({"pass": p, "dim": dim, "key": projection_keys(x, seed + p), "node": part["node"].to_numpy()})

    return vectors.mapInPandas(run, "pass int, dim int, key long, node long")


def _placed(keyed: DataFrame, window: int) -> DataFrame:
    """pass, dim, node, place (in the order of all, from 0) and span: every place in its own span, and the first ``window`` of a span at the end of the one before too."""
    order = ["pass", "dim", "key", "node"]
    told = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, F.monotonically_increasing_id().alias("id"))
    told = materialize(told, "order")
    part, at = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    # One row a partition: their sizes give each its first place.
    sizes = told.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = told.withColumn("part", part).join(starts, "part").withColumn("place", F.col("start") + at)
    own = F.floor(F.col("place") / SPAN)
    spans = F.when((F.col("place") % SPAN < window) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    out = materialize(placed.select("pass", "dim", "node", "place", F.explode(spans).alias("span")), "places")
    discard(told)
    return out


class _Union:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _neighbour_links(placed: DataFrame, vectors: DataFrame, threshold: float, window: int) -> DataFrame:
    """A spanning forest of the links that each span of the order shows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        union, pdf = _Union(), pdf.sort_values("place")
        for _, part in pdf.groupby(["pass", "dim"], sort=False):
            x, node, own = _matrix(part["vector"]), part["node"].to_numpy(), (part["place"] // SPAN == part["span"]).to_numpy()
            for step in range(1, min(window, len(x) - 1) + 1):
                near = np.flatnonzero(own[:-step] & (np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold))
                for i in near.tolist():
                    union.link(int(node[i]), int(node[i + step]))
        return pd.DataFrame({"a": list(union.parent), "b": [union.find(v) for v in union.parent]}, dtype="int64")

    return placed.join(vectors.select("node", "vector"), "node").groupBy("span").applyInPandas(run, "a long, b long")


def _count_links(members: DataFrame, threshold: float) -> DataFrame:
    """node and n: the weights of all vectors linked to it, by blocks of each component. ``members``: root, node, vector, weight, blocks."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sent = members.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        x, w, node, block = _matrix(pdf["vector"]), pdf["weight"].to_numpy(), pdf["node"].to_numpy(), pdf["block"].to_numpy()
        if low == high:
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            return pd.DataFrame({"node": node, "n": near @ w})
        a, b = block == low, block == high
        near = x[a] @ x[b].T >= threshold
        return pd.DataFrame({"node": np.concatenate([node[a], node[b]]), "n": np.concatenate([near @ w[b], near.T @ w[a]])})

    return sent.groupBy("root", "low", "high").applyInPandas(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(rows: DataFrame, threshold: float = 0.95, recall: float = 0.999, window: int = 48, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``rows`` (vec_id, embedding).

    Vectors with cosine >= ``threshold`` (double precision) that a pass or their
    component brings together are linked; ``recall`` is what passes_for aims at. A null, empty or zero vector and one
    with a null, NaN or infinite component links with nothing, nor do vectors of
    different dimensions. Equal vectors are collapsed first and count for each
    other. vec_id must be unique; repeated rows come back as often and count once
    in n_links. A row with a null vec_id links with nothing and has a null
    component. Other columns are ignored; an empty table gives an empty result.
    """
    fine = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(embedding, v -> v <> 0)"
    good = rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).distinct()
    classes = materialize(good.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("vector")), "vectors")
    passes = passes_for(classes.count(), threshold, window, recall)
    placed = _placed(_keyed(classes.select("dim", "node", "vector"), passes, seed), window)
    roots = materialize(components(_neighbour_links(placed, classes, threshold, window)), "roots")
    discard(placed)
    size = F.count(F.lit(1))
    block = F.least(F.lit(BLOCKS[1]), F.greatest(F.lit(BLOCKS[0]), size / 16))
    blocks = roots.groupBy("root").agg(F.ceil(size / block).cast("int").alias("blocks"))
    members = classes.join(roots, "node").join(blocks, "root").select("root", "node", "vector", "weight", "blocks")
    counted = classes.select("node", "weight").join(_count_links(members, threshold), "node", "left").join(roots, "node", "left")
    counted = counted.select("node", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    by_id = good.join(classes.select("vector", "node"), "vector").select("vec_id", "node").join(counted, "node").select(F.col("vec_id").alias("__id"), "n_links", "root")
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id")).join(by_id, F.col("vec_id") == F.col("__id"), "left")
    # All members of a component have one root, the smallest of the classes' smallest ids.
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))
