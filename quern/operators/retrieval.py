"""Ranked retrieval for many queries at once: BM25, cosine, fusion, rerank, acceptance, scope, paging and metrics.

Queries are a table with query_id; every result is per query. Corpus statistics
are aggregations, scoring is one join of query tokens with postings and one
aggregation, ranks are windows per query (which Catalyst limits before the
shuffle).
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25, fusion, boosts (before the division by 100 in reranking) and acceptance levels.
K1, B = 1.5, 0.75
FIELD_WEIGHTS = {"content": 3, "number": 5, "chapter": 2, "name": 1}
RRF_K, POOL_FACTOR, POOL_LEAST = 60, 4, 20
PHRASE_BOOST, NUMBER_BOOST, CODE_BOOST = 4.0, 10.0, 5.0
RERANK = {"phrase": 4.0, "number": 10.0, "overlap": 3.0, "code": 5.0}
ACCEPT_STRONG, ACCEPT_PLAIN, ACCEPT_PHRASE, LOW_CONFIDENCE = 0.25, 0.60, 0.45, 0.30
#: Cosine search: a call has QUERY_BLOCK queries at least, VECTOR_BLOCK queries and as many vectors at most; CALLS are enough. A matrix product takes a slice of both.
QUERY_BLOCK, VECTOR_BLOCK, CALLS, QUERY_SLICE, SLICE = 1024, 16384, 32, 256, 2048


def weighted_tokens(fields: Mapping[str, Column], weights: Mapping[str, int] = FIELD_WEIGHTS) -> Column:
    """Array of (token, weight) over the token arrays of some fields; a field adds its weight once a token."""
    def weighted(found: Column, weight: int) -> Column:
        return F.transform(found, lambda x: F.struct(x.alias("token"), F.lit(weight).alias("weight")))

    return F.flatten(F.array(*(weighted(t, weights[f]) for f, t in fields.items())))


def postings(docs: DataFrame, weighted: Column, key: str = "doc_id") -> DataFrame:
    """key, token and weight: weights of equal tokens are summed."""
    return docs.select(key, F.explode(weighted).alias("t")).groupBy(key, F.col("t.token").alias("token")).agg(F.sum("t.weight").alias("weight"))


def top_ranks(scored: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Rank rows of each query and keep k; limited before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key and score of all documents that share a token with a query.

    ``docs`` has key and tokens (array of distinct tokens, weight 1); ``queries``
    has query_id and tokens. Only tokens of queries leave a document's row.
    """
    asked = queries.select("query_id", F.explode("tokens").alias("token"))
    matched = held_tokens(docs, queries, key)
    n = matched.agg(F.count(F.lit(1)).alias("n")).scalar()
    mean = matched.agg(F.greatest(F.coalesce(F.avg("length"), F.lit(1.0)), F.lit(1.0)).alias("m")).scalar()
    hits = matched.select(key, "length", F.explode("held").alias("token"))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("idf") * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("length") / mean))
    weighted = asked.join(df.select("token", idf.alias("idf")), "token")
    return hits.join(weighted, "token").groupBy("query_id", key).agg(F.sum(part).alias("score"))


def held_tokens(docs: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, length (number of tokens) and held (the tokens that any query has): texts are read once, and this small table is what statistics and scores share.

    The words of the stated query set become a literal of the plan.
    """
    words = sorted(r[0] for r in queries.select(F.explode("tokens")).distinct().collect())
    wanted = F.array(*map(F.lit, words)).cast("array<string>")
    return docs.select(key, F.size("tokens").alias("length"), F.array_intersect("tokens", wanted).alias("held")).repartition(key)


def exact_boost(query: Mapping[str, Column], text: Column, text_tokens: Column, number: Column, code: Column) -> Column:
    """Boost for whole phrases, the exact number, the code named in the query, and the share of query tokens held.

    ``query`` has phrases (array), numbers (array), text and tokens (array).
    """
    phrases = F.size(F.filter(query["phrases"], lambda p: F.contains(text, p))) * PHRASE_BOOST
    exact = F.when(F.array_contains(query["numbers"], number), NUMBER_BOOST).otherwise(0.0)
    named = F.when((F.coalesce(code, F.lit("")) != "") & F.contains(query["text"], code), CODE_BOOST).otherwise(0.0)
    overlap = F.when(F.size(query["tokens"]) > 0, F.size(F.array_intersect(query["tokens"], text_tokens)) / F.size(query["tokens"])).otherwise(0.0)
    return phrases + exact + named + overlap


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest by cosine > 0; ``queries``: query_id and query, a stated set or all vectors.

    Every vector meets every query, in blocks of both: the work is their product,
    so all vectors as queries cost the square of the table. Each pair of blocks
    hands on its k best a query. Ties go by vec_id. Vectors that are null or hold a
    null, and pairs of different lengths, have no cosine.
    """
    blocks, parts = _blocks(queries.count(), vectors.count())
    known = lambda key, v: F.col(key).isNotNull() & F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.where(known("vec_id", "embedding")).select("vec_id", "embedding", every(blocks).alias("__block"), dealt(parts, "vec_id", "embedding").alias("__part"))
    asked = queries.where(known("query_id", "query")).select("query_id", "query", dealt(blocks, "query_id", "query").alias("__block"), every(parts).alias("__part"))

    def best(v: pa.Table, q: pa.Table) -> pa.Table:
        return _nearest(v, q, k, digits)

    schema = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, score double"
    # A number of partitions that is stated is kept: blocks are small but work long, and would else be put into few tasks.
    rows, asked = (x.repartition(2 * blocks * parts, "__block", "__part").groupBy("__block", "__part") for x in (rows, asked))
    return top_ranks(rows.cogroup(asked).applyInArrow(best, schema), [F.desc("score"), F.asc("vec_id")], k)


def _blocks(queries: int, vectors: int) -> tuple[int, int]:
    """Number of blocks of queries and of vectors. A row is sent to all blocks of the other side, so they are few: long ones, but for calls enough to share the work."""
    parts = max(1, -(-vectors // VECTOR_BLOCK))
    return max(1, -(-queries // VECTOR_BLOCK), min(queries // QUERY_BLOCK, -(-CALLS // parts))), parts


def _nearest(vectors: pa.Table, queries: pa.Table, k: int, digits: int) -> pa.Table:
    """query_id, vec_id and score of the k best vectors of each query within two blocks."""
    ids, asked = (t.column(c).combine_chunks() for t, c in ((vectors, "vec_id"), (queries, "query_id")))
    code = np.unique(np.concatenate([x.to_numpy(zero_copy_only=False) for x in (ids, asked)]), return_inverse=True)[1]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for (v_at, v), (q_at, q) in _by_length(vectors.column("embedding"), queries.column("query")):
        q_in, v_in, score = _best_pairs(v, q, code[: len(ids)][v_at], code[len(ids) :][q_at], k, digits)
        found.append((q_at[q_in], v_at[v_in], score))
    q_all, v_all, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"query_id": asked.take(pa.array(q_all)), "vec_id": ids.take(pa.array(v_all)), "score": score})


def _by_length(*columns: pa.ChunkedArray):
    """For each length that vectors of all the columns have: their places in each column and their matrix in double precision."""
    lists = [c.combine_chunks() for c in columns]
    lengths = [pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in lists]
    for n in sorted(set.intersection(*(set(x.tolist()) for x in lengths)) - {0}):
        at = [np.flatnonzero(x == n) for x in lengths]
        yield [(i, c.take(pa.array(i)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)) for i, c in zip(at, lists, strict=True)]


def _best_pairs(v: np.ndarray, q: np.ndarray, v_code: np.ndarray, q_code: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q`` and of ``v`` with a different code, and their score: the k best of each query, ties by code.

    A matrix product only tells which pairs may be among the k best; their cosine
    is then summed up component by component, so that no score depends on blocks.
    Numbers beyond its reach are always computed so. NaN counts as the highest.
    """
    with np.errstate(all="ignore"):
        by_code = np.argsort(v_code, kind="stable")
        v, v_code = v[by_code], v_code[by_code]
        v_norm, q_norm = _norms(v), _norms(q)
        v_unit, q_unit = _units(v, v_norm), _units(q, q_norm)
        v_cols = np.ascontiguousarray(v.T)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo in range(0, len(q), QUERY_SLICE):
            at = slice(lo, lo + QUERY_SLICE)
            q_in, v_in, score = _best_of_slice(v_cols, v_unit, v_norm, v_code, q[at], q_unit[at], q_norm[at], q_code[at], k, digits)
            found.append((q_in + lo, by_code[v_in], score))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best_of_slice(v_cols, v_unit, v_norm, v_code, q, q_unit, q_norm, q_code, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _best_pairs; vectors come by code, so a later one must score higher than the k-th so far, not alike."""
    unit = 10.0**-digits
    products, marks = (np.empty(len(q) * min(SLICE, len(v_code)), kind) for kind in (np.float64, bool))
    q_cols = np.ascontiguousarray(q.T)
    q_in, v_in, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, len(v_code), SLICE):
        width = min(SLICE, len(v_code) - lo)
        about = np.matmul(q_unit, v_unit[lo : lo + width].T, out=products[: len(q) * width].reshape(len(q), width))
        own = np.flatnonzero(np.isin(v_code[lo : lo + width], q_code))
        q_own, v_own = np.nonzero(q_code[:, None] == v_code[None, lo + own])
        about[q_own, own[v_own]] = -np.inf
        if lo == 0:
            kth = np.full(len(q), -np.inf)
            if width > k:
                kth = -np.partition(-about, k - 1, axis=1)[:, k - 1]
                kth[np.isnan(kth)] = -np.inf
            least = np.maximum(kth - unit, unit / 4)
        below = np.less(about, least[:, None], out=marks[: about.size].reshape(about.shape))
        qs, vs = np.divmod(np.flatnonzero(np.logical_not(below, out=below)), width)
        vs = vs + lo
        dot = np.zeros(len(qs))
        for a, b in zip(v_cols, q_cols, strict=True):
            dot += a[vs] * b[qs]
        size = v_norm[vs] * q_norm[qs]
        said = _half_up(dot / size, digits)
        good = (size != 0) & ~(said <= 0)
        q_in, v_in, score = (np.concatenate((x, y[good])) for x, y in ((q_in, qs), (v_in, vs), (score, said)))
        high = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((v_code[v_in], -high, q_in))
        q_in, v_in, score, high = q_in[order], v_in[order], score[order], high[order]
        turn = np.arange(len(q_in)) - np.searchsorted(q_in, q_in)
        least = np.full(len(q), unit / 4)
        least[q_in[turn == k - 1]] = high[turn == k - 1] + unit / 4
        q_in, v_in, score = (x[turn < k] for x in (q_in, v_in, score))
    return q_in, v_in, score


def _norms(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    for x in m.T:
        total += x * x
    return np.sqrt(total)


def _units(m: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Rows of length one; NaN where squares leave the range of doubles; zero for those that have no cosine."""
    out = m / norm[:, None]
    out[~((norm > 1e-140) & (norm < 1e140))] = np.nan
    out[norm == 0] = 0
    return out


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark's round does: the shortest decimal form, halves away from zero; positive numbers."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def fuse(*routes: DataFrame, key: str = "vec_id") -> DataFrame:
    """Reciprocal-rank fusion of ranked routes (query_id, key, rank): fused score, and the rank in each route."""
    rows = [r.select("query_id", key, "rank", F.lit(i).alias("route")) for i, r in enumerate(routes)]
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    ranks = [F.max(F.when(F.col("route") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(routes))]
    return every.groupBy("query_id", key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("hybrid_score"), *ranks)


def pool_size(k: int) -> int:
    return max(POOL_FACTOR * k, POOL_LEAST)


def rerank_score(base: Column, phrases: Column, number: Column, overlap: Column, code: Column) -> Column:
    """Base score (zero where there is none) and a hundredth of the boosts."""
    boost = phrases * RERANK["phrase"] + number.cast("int") * RERANK["number"] + overlap * RERANK["overlap"] + code.cast("int") * RERANK["code"]
    return F.coalesce(base, F.lit(0.0)) + boost / 100


def acceptance(coverage: Column, strong: Column, phrase: Column, has_hit: Column) -> Column:
    """ACCEPT, LOW_CONFIDENCE or NO_MATCH from the idf-weighted share of the query that the best hit holds."""
    accept = ((coverage >= ACCEPT_STRONG) & strong) | (coverage >= ACCEPT_PLAIN) | ((coverage >= ACCEPT_PHRASE) & phrase)
    return F.when(~has_hit, "NO_MATCH").when(accept, "ACCEPT").when(coverage >= LOW_CONFIDENCE, "LOW_CONFIDENCE").otherwise("NO_MATCH")


def coverage(queries: DataFrame, top: DataFrame, df: DataFrame, n: Column) -> DataFrame:
    """query_id and coverage: sum of idf of query tokens in the best hit over the sum of all.

    ``queries``: query_id, token; ``top``: query_id, token of the best hit; ``df``:
    token, df. Its idf, ln(1 + (n + 0.5) / (df + 0.5)), is not that of BM25.
    """
    idf = F.log(1 + (n + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5))
    held = top.select("query_id", "token").distinct().withColumn("held", F.lit(True))
    rows = queries.join(df, "token", "left").join(held, ["query_id", "token"], "left")
    share = F.sum(F.when(F.col("held"), idf).otherwise(0.0)) / F.sum(idf)
    return rows.groupBy("query_id").agg(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("coverage"))


def ranking_metrics(ranks: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: macro recall at each cut and mean reciprocal rank. Queries without a relevant item count zero.

    ``ranks``: query_id, item, rank; ``relevant``: query_id, item.
    """
    met = relevant.join(ranks, ["query_id", "item"], "left")
    recalls = [(F.count_if(F.col("rank") <= c) / F.count(F.lit(1))).alias(f"recall_{c}") for c in cuts]
    one = met.groupBy("query_id").agg(*recalls, F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    every = ranks.select("query_id").union(relevant.select("query_id")).distinct().join(one, "query_id", "left").na.fill(0.0)
    return every.agg(*(F.round(F.avg(f"recall_{c}"), 6).alias(f"recall_{c}") for c in cuts), F.round(F.avg("rr"), 6).alias("mrr"))


def label_metrics(ranks: DataFrame, labels: DataFrame, asked: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """As ranking_metrics where the relevant items of a query are all others of its label: these are counted by label, never listed.

    ``ranks``: query_id, item, rank; ``labels``: item, label; ``asked``: query_id, label.
    """
    labels, asked = labels.where("item is not null"), asked.where("query_id is not null")
    of_label = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    itself = labels.groupBy(F.col("item").alias("query_id"), "label").agg(F.count(F.lit(1)).alias("own"))
    counted = asked.join(of_label, "label").join(itself, ["query_id", "label"], "left")
    totals = counted.groupBy("query_id").agg(F.sum(F.col("n") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")
    # Items listed more than once count as often as their pairs would.
    hits = [F.count_if(F.col("rank") <= c).alias(f"hits_{c}") for c in cuts]
    seen = ranks.groupBy("query_id", "item").agg(*hits, F.min("rank").alias("first"), F.count(F.lit(1)).alias("times"))
    # Ranks are read once, so the search runs once: queries without a hit of their label stay, with nulls.
    pairs = seen.join(labels, "item", "left").join(asked.withColumn("met", F.lit(True)), ["query_id", "label"], "left")
    of_met = lambda c: F.when(F.col("met"), c)
    met = pairs.groupBy("query_id").agg(*(F.sum(of_met(F.col(f"hits_{c}"))).alias(f"hits_{c}") for c in cuts), F.min(of_met(F.col("first"))).alias("first"), F.sum(of_met(F.col("times") - 1)).alias("again"))
    every = totals.join(met, "query_id", "full")
    every = every.select(*((F.col(f"hits_{c}") / (F.col("n") + F.col("again"))).alias(f"recall_{c}") for c in cuts), (1 / F.col("first")).alias("rr")).na.fill(0.0)
    return every.agg(*(F.round(F.avg(f"recall_{c}"), 6).alias(f"recall_{c}") for c in cuts), F.round(F.avg("rr"), 6).alias("mrr"))


def prefer_flagged(hits: DataFrame) -> DataFrame:
    """Reorder hits so that, where a number occurs both plain and flagged, the first flagged one comes at the number's first place.

    ``hits``: query_id, rank, number, flagged. Rows keep their columns and get
    position. Of one number's rows, flagged ones go first, then by rank; the rows
    share the places that the number had.
    """
    of_number = Window.partitionBy("query_id", "number")
    place = F.row_number().over(of_number.orderBy("rank"))
    wish = F.row_number().over(of_number.orderBy(F.desc("flagged"), "rank"))
    places = hits.select("query_id", "number", F.col("rank").alias("position"), place.alias("turn"))
    return hits.withColumn("turn", wish).join(places, ["query_id", "number", "turn"]).drop("turn")


def scope_status(codes: Column, malformed: Column, matches: Column, allowed: Column) -> Column:
    """How a query names its scope: codes (array of distinct canonical codes), whether a malformed one stands in it,
    the number of documents that its only code has, and whether the caller allows that document."""
    return (
        F.when((F.size(codes) == 0) & ~malformed, "NO_EXPLICIT_SCOPE").when(malformed, "INVALID_SCOPE").when(F.size(codes) != 1, "CONFLICTING_SCOPE")
        .when(matches == 0, "UNKNOWN_SCOPE").when(matches > 1, "AMBIGUOUS_SCOPE").when(~allowed, "CONFLICTING_SCOPE").otherwise("RESOLVED_UNIQUE_SCOPE")
    )


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a listing and the total on every row; limit is 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    total = rows.count()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long"))


def containment(wanted: Column, have: Column) -> Column:
    """Whether all wanted numbers are available; the missing ones are array_except(wanted, have)."""
    return F.size(F.array_except(wanted, have)) == 0
