"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a midpoint within r bits of
each. Every distinct fingerprint emits all variants within r bits; fingerprints
that meet at a variant are linked. The shuffle does not carry all variants: a
fingerprint is sent once for each value that the leading ``route_bits`` of its
variants take (37 copies of 8 bits for r = 2), with the flips it has left, and
expands the trailing bits where it lands. Fingerprints that meet at one variant
are all linked with each other, so a star to the smallest suffices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import materialize, small_batches

BITS = 64
#: Variants that are held in memory at once.
HELD = 2_000_000


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The fingerprint of one UTF-8 text; zero if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lasts = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:z], 42) for a, z in zip(starts[:n].tolist(), lasts.tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, flips: int, shift: int) -> list[tuple[int, int]]:
    """(mask, number of flips) for every way to flip at most ``flips`` of ``bits`` bits above ``shift``."""
    return [(sum(1 << (shift + b) for b in c), k) for k in range(flips + 1) for c in combinations(range(bits), k)]


def _meet(fp: np.ndarray, node: np.ndarray, at: np.ndarray, left: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stars (node, head, and their fingerprints) among rows that meet at a variant.

    ``at`` is each row's variant so far; its lowest ``low`` bits may still take
    ``left`` flips. More variants than HELD are split by their next bits first.
    """
    if len(fp) < 2:
        return
    most = int(left.max())
    ways = np.array([sum(comb(low, j) for j in range(k + 1)) for k in range(most + 1)])
    if low and int(ways[left].sum()) > HELD:
        take = min(4, low)
        low -= take
        moved = [(np.flatnonzero(left >= k), mask, k) for mask, k in _masks(take, most, low)]
        for value in range(1 << take):
            picked = [(r := rows[((at[rows] ^ np.uint64(mask)) >> np.uint64(low)) & np.uint64((1 << take) - 1) == value], at[r] ^ np.uint64(mask), left[r] - k) for rows, mask, k in moved]
            rows, variants, rest = (np.concatenate(x) for x in zip(*picked, strict=True))
            yield from _meet(fp[rows], node[rows], variants, rest, low)
        return
    rows, variants = [], []
    for k in range(most + 1):
        able = np.flatnonzero(left >= k)
        masks = np.array([m for m, n in _masks(low, k, 0) if n == k], np.uint64)
        if len(able) and len(masks):
            rows.append(np.repeat(able, len(masks)))
            variants.append((at[able][:, None] ^ masks[None, :]).ravel())
    row, variant = np.concatenate(rows), np.concatenate(variants)
    order = np.argsort(variant, kind="stable")
    row, variant = row[order], variant[order]
    new = np.concatenate(([True], variant[1:] != variant[:-1]))
    if new.all():
        return
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(node[row], first)
    order = np.lexsort((node[row], group))
    head = row[order][first]
    other = row != head[group]
    pairs = np.unique(np.stack([row[other], head[group][other]]), axis=1)
    assert (node[head] == least).all()
    yield node[pairs[0]], node[pairs[1]], fp[pairs[0]], fp[pairs[1]]


def near_links(nodes: DataFrame, distance: int = 4, route_bits: int | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within ``distance`` bits (an even number).

    ``nodes`` has one row for each distinct fp, with its node id. ``route_bits``
    defaults to a number by which each of the routes holds some thousand
    fingerprints.
    """
    flips = distance // 2
    if distance % 2:
        raise ValueError("distance must be even: both sides flip half of it")
    if route_bits is None:
        route_bits = min(24, max(8, nodes.count().bit_length() - 10))
    low = BITS - route_bits
    routes = _masks(route_bits, flips, low)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    table = F.array(*(F.struct(F.lit(signed(m)).cast("long").alias("mask"), F.lit(flips - k).alias("left")) for m, k in routes))
    sent = nodes.select("fp", "node", F.explode(table).alias("r")).select("fp", "node", F.col("fp").bitwiseXOR(F.col("r.mask")).alias("at"), "r.left")
    sent = sent.withColumn("route", F.shiftrightunsigned("at", low))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, at = pdf["fp"].to_numpy().view(np.uint64), pdf["at"].to_numpy().view(np.uint64)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for a, b, fa, fb in _meet(fp, pdf["node"].to_numpy(), at, pdf["left"].to_numpy(), low):
            near = np.bitwise_count(fa ^ fb) <= distance
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        return pd.DataFrame({"a": list(parent), "b": [find(x) for x in parent]}, dtype="int64")

    return sent.groupBy("route").applyInPandas(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp (long) and component_id of every document.

    Documents whose fingerprints differ in at most ``distance`` bits are linked;
    component_id is the smallest doc_id reachable. A null or wordless text has
    fingerprint zero and is linked like any other. Rows with a null doc_id keep
    their fingerprint's component; repeated rows come back as often. Other
    columns are ignored. An empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    roots = components(near_links(nodes, distance))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` that are the smallest of their group, with their columns; of repeated doc_ids all rows stay."""
    kept = simhash_groups(docs, shingle, distance).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")
