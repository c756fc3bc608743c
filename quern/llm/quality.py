"""Quality rules with risk-controlled thresholds.

Fixed base rules drop the plainly broken. Beyond them, a document is rejected if
a rule feature exceeds its cutoff. Cutoffs come per stratum from labelled
documents: candidates are quantiles of one half of the labelled good documents,
from the highest (level 1.0) down; on the other half, an exact binomial
(Clopper-Pearson) upper bound on the share of good documents that the features
reject together must stay within the allowed risk. Levels are tested in this
fixed order and the walk ends at the first that fails, so that one stratum's
levels need no further correction; strata share the error probability equally
(Bonferroni). Strata with too few labels for the bound are merged with their
neighbour first: the bound then holds for the merged stratum, and the walk ends
too where a member exceeds the risk on its own labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialize, small_batches
from .wordhash import Words, byte_chunks, span_hashes

#: What the base rules and the features count.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: The marks of shouting.
MARKS = b"!?"
_SYMBOL, _MARK = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (SYMBOLS, MARKS))


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _seen_before(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, repeated): the stable order by row and value, and whether the entry has the value of the one before it."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    same = np.zeros(len(r), bool)
    same[1:] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    return order, same


def count_chunk(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each row of one run of texts."""
    words, n = Words(data, offsets), len(offsets) - 1
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(lead[words.ends] - lead[words.starts])))
    out = {"n_words": words.counts(), "word_chars": chars[words.first[1:]] - chars[words.first[:-1]], "n_symbols": _row_sums(_SYMBOL[data], offsets)}
    out |= {"n_capitals": _row_sums((data >= 65) & (data <= 90), offsets), "n_marks": _row_sums(_MARK[data], offsets)}
    hashes = words.hashes()
    at, row, value = words.windows(hashes, window)
    order, same = _seen_before(row, value)
    twice = same.copy()
    twice[:-1] |= same[1:]
    cover = np.zeros(len(hashes) + 1, np.int64)
    starts = at[order[twice]]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    out["n_repeat_words"] = _row_sums(np.cumsum(cover[:-1]) > 0, words.first)
    breaks = np.flatnonzero(data == 10)
    inner = breaks[breaks + 1 < offsets[np.searchsorted(offsets, breaks, "right")]] + 1
    starts = np.sort(np.concatenate((offsets[:-1][np.diff(offsets) > 0], inner)))
    row = np.searchsorted(offsets, starts, "right") - 1
    keep = (row < n) & (starts < len(data))
    starts, row = starts[keep], row[keep]
    nexts = np.append(breaks, len(data))[np.searchsorted(breaks, starts)] if len(starts) else starts
    ends = np.minimum(nexts, offsets[row + 1])
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[filled], ends[filled], row[filled]
    order, same = _seen_before(row, span_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, 0xD6E8FEB86659FD93))
    out["n_dup_lines"] = np.bincount(row[order[same]], minlength=n)
    return out


def quality_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of COUNTS (long) for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_chunks(batch.column(1)):
                counts = count_chunk(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: Rule features in parts per 1000 of the text, larger is worse.
FEATURES = {
    "symbol_rate": "n_symbols * 1000.0 / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines * 1000.0 / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words * 1000.0 / greatest(n_words, 1)",
    "word_length": "abs(word_chars * 1.0 / greatest(n_words, 1) - 5.0)",
    "capital_rate": "n_capitals * 1000.0 / greatest(word_chars, 1)",
    "mark_rate": "n_marks * 1000.0 / greatest(n_words, 1)",
}
#: A document's stratum, by number of words, and the strata in order.
STRATUM = "case when n_words < 50 then 'short' when n_words < 500 then 'middle' else 'long' end"
STRATA = ("short", "middle", "long")
#: Quantiles of good documents that are tried as cutoffs, in this order.
LEVELS = (1.0, 0.9998, 0.9995, 0.999, 0.998, 0.995, 0.99)


#: Least share of the bad documents of a stratum that a feature must reject at the last level to be used there.
USEFUL = 0.02


def binomial_cdf(k: int, n: int, p: float) -> float:
    """Sums from k down and stops where terms no longer count, so its time does not follow k."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    first = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p)
    term = total = 1.0
    for i in range(k, 0, -1):
        step = i * (1 - p) / ((n - i + 1) * p)
        term *= step
        total += term
        if term > 1e200:
            term, total, first = term * 1e-200, total * 1e-200, first + 200 * log(10)
        if step < 1 and term < 1e-17 * total * (1 - step):
            break
    return min(1.0, exp(min(0.0, first + log(total))))


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Clopper-Pearson: the largest share under which k or fewer of n still has probability alpha."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_cdf(k, n, middle) > alpha else (low, middle)
    return high


def merged_strata(proofs: dict[str, int], least: int) -> list[list[str]]:
    """STRATA in groups of neighbours with ``least`` proving documents each, if all together have as many; else none."""
    groups: list[list[str]] = []
    for stratum in STRATA:
        if groups and sum(proofs.get(s, 0) for s in groups[-1]) < least:
            groups[-1].append(stratum)
        else:
            groups.append([stratum])
    if len(groups) > 1 and sum(proofs.get(s, 0) for s in groups[-1]) < least:
        groups[-2:] = [groups[-2] + groups[-1]]
    return [g for g in groups if sum(proofs.get(s, 0) for s in g) >= least]


def fit_cutoffs(labelled: DataFrame, risk: float = 0.01, confidence: float = 0.95) -> dict[tuple[str, str], float]:
    """(stratum, feature) -> cutoff, from all rows with doc_id, stratum, quality and FEATURES.

    With ``confidence``, the cutoffs of each stratum (or of strata merged for
    want of labels) together reject at most ``risk`` of its good documents.
    Quantiles and error counts are exact; the driver gets them only, a few for
    each stratum, feature and level. Features are chosen by the bad documents and
    the proposing half, never by the proving half. Returns nothing where labels
    are too few for the bound even without an error.
    """
    alpha = (1 - confidence) / len(STRATA)
    least = ceil(log(alpha) / log1p(-risk))
    role = F.when(F.col("quality") == 0, "bad").when(hash_half(F.col("doc_id")) == 0, "propose").otherwise("prove")
    told = materialize(labelled.where("quality in (0, 1)").select("stratum", role.alias("role"), *(F.col(f).cast("double").alias(f) for f in FEATURES)), "labelled")
    groups = merged_strata({r["stratum"]: r["n"] for r in told.where("role = 'prove'").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}, least)
    name = reduce(lambda out, g: F.when(F.col("stratum").isin(g), "+".join(g)).otherwise(out), groups, F.lit(None).cast("string"))
    rows = told.withColumn("group", name).where("group is not null")
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES)))
    propose = rows.where("role = 'propose'").select("group", values.alias("x")).select(F.concat_ws(":", "group", "x.feature").alias("rule"), "x.value")
    counts = materialize(propose.groupBy("rule", "value").agg(F.count(F.lit(1)).alias("n")), "proposed")
    levels = _quantiles(counts, LEVELS) if groups else {}
    over = lambda f, k: reduce(lambda out, g: F.when(F.col("group") == g, F.col(f) > levels[f"{g}:{f}"][k]).otherwise(out), [g for g in map("+".join, groups) if f"{g}:{f}" in levels], F.lit(False))
    share = lambda cond: F.coalesce(F.avg(cond.cast("double")), F.lit(0.0))
    caught = rows.where("role = 'bad'").groupBy("group").agg(*(share(over(f, -1)).alias(f) for f in FEATURES)).collect() if levels else []
    used = {r["group"]: [f for f in FEATURES if r[f] >= USEFUL and f"{r['group']}:{f}" in levels] for r in caught}
    any_over = lambda k: reduce(lambda out, g: F.when(F.col("group") == g, reduce(lambda a, b: a | b, (F.col(f) > levels[f"{g}:{f}"][k] for f in used[g]), F.lit(False))).otherwise(out), used, F.lit(False))
    errors = [F.count_if(any_over(k)).alias(f"e{k}") for k in range(len(LEVELS))]
    proofs = rows.where("role = 'prove'").groupBy("group", "stratum").agg(F.count(F.lit(1)).alias("n"), *errors).collect() if used else []
    discard(told, counts)
    out: dict[tuple[str, str], float] = {}
    for g, features in used.items():
        own = [r for r in proofs if r["group"] == g]
        n = sum(r["n"] for r in own)
        passed = -1
        # A stratum merged with others must keep the risk on its own labels too, though these few cannot prove it.
        while passed + 1 < len(LEVELS) and upper_bound(sum(r[f"e{passed + 1}"] for r in own), n, alpha) <= risk and all(r[f"e{passed + 1}"] <= risk * r["n"] for r in own):
            passed += 1
        if passed >= 0:
            out |= {(s, f): levels[f"{g}:{f}"][passed] for s in g.split("+") for f in features}
    return out


def _quantiles(counts: DataFrame, quantiles: tuple[float, ...]) -> dict[str, list[float]]:
    """rule -> the exact quantiles (the higher neighbour) of its values, from rule, value (0 or more) and n.

    Ranks go to bins by prefix sums over the bins of a rule (256 for each doubling
    of 1 + value, so their number has a bound), then to values within those bins only.
    """
    bin_ = F.floor(F.log2(1 + F.col("value")) * 256)
    sums = counts.groupBy("rule", bin_.alias("bin")).agg(F.sum("n").alias("n"))
    along = Window.partitionBy("rule").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("rule", "bin", "n", F.sum("n").over(along).alias("upto"), F.sum("n").over(Window.partitionBy("rule")).alias("total"))
    ranks = sums.select("*", F.posexplode(F.array(*(F.lit(q) for q in quantiles))).alias("k", "q")).withColumn("rank", F.ceil(F.col("q") * (F.col("total") - 1)))
    aims = ranks.where("upto - n <= rank and rank < upto").select("rule", "bin", "k", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).collect()
    if not aims:
        return {}
    key = F.concat_ws(":", "rule", bin_.cast("string"))
    wanted: dict[str, list] = {}
    for a in aims:
        wanted.setdefault(f"{a['rule']}:{a['bin']}", []).append(a)
    inside = counts.select("rule", "value", "n", key.alias("key")).where(F.col("key").isin(list(wanted)))
    running = F.sum("n").over(Window.partitionBy("key").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("upto", running)
    hit = [(F.col("key") == name) & (F.col("upto") > int(a["rank"])) & (F.col("upto") - F.col("n") <= int(a["rank"])) for name, of in wanted.items() for a in of]
    rows = inside.where(reduce(lambda a, b: a | b, hit)).collect()
    out: dict[str, list[float]] = {}
    for a in aims:
        value = next(r["value"] for r in rows if r["key"] == f"{a['rule']}:{a['bin']}" and r["upto"] - r["n"] <= a["rank"] < r["upto"])
        out.setdefault(a["rule"], [0.0] * len(quantiles))[a["k"]] = value
    return out


def hash_half(doc_id: Column) -> Column:
    """0 or 1, as good as random and the same in every run: bit 40 of doc_id times an odd constant, in steps that fit in a long."""
    d, k = doc_id.cast("long").bitwiseAND(F.lit((1 << 41) - 1)), 0x9E3779B97F4A7C15
    high = (F.shiftright(d, 21) * F.lit(k & ((1 << 20) - 1))).bitwiseAND(F.lit((1 << 20) - 1))
    low = d.bitwiseAND(F.lit((1 << 21) - 1)) * F.lit(k & ((1 << 41) - 1))
    return F.shiftright(F.shiftleft(high, 21) + low, 40).bitwiseAND(F.lit(1))


def quality_filter(docs: DataFrame, labels: DataFrame, risk: float = 0.01, confidence: float = 0.95) -> DataFrame:
    """Counts, base_failed, rule (the first accepted cutoff broken, else null) and kept for every row of ``docs``.

    ``labels`` has doc_id and quality (1 good, 0 bad); documents with repeated or
    null labels count once at most (a bad label wins); of rows that share a
    doc_id one is taken for its label. base_failed: fewer than 10
    words, or more than 20 % of the words in repeated windows. With too few
    labels no cutoff is accepted and only base_failed rejects. An empty table
    gives an empty result.
    """
    counted = materialize(quality_counts(docs), "counts")
    rated = counted.select("*", *(F.expr(e).alias(f) for f, e in FEATURES.items()), F.expr(STRATUM).alias("stratum"))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = counted.join(marks, "doc_id").dropDuplicates(["doc_id"]).where(~failed).select("doc_id", "quality", *(F.expr(e).alias(f) for f, e in FEATURES.items()), F.expr(STRATUM).alias("stratum"))
    cutoffs = fit_cutoffs(known, risk, confidence)
    rules = [F.when((F.col("stratum") == s) & (F.col(f) > c), F.lit(f"{s}:{f}")) for (s, f), c in sorted(cutoffs.items())]
    out = rated.withColumn("base_failed", failed).withColumn("rule", reduce(lambda a, b: F.coalesce(a, b), rules, F.lit(None).cast("string")))
    return out.select("doc_id", *COUNTS, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
