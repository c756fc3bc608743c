"""Secret scans: base patterns and multipart credential linking, all in DataFrame operations.

A scan keeps, per pattern, the lengths of matches and of the gaps between them;
running sums over the exploded lengths give code-point offsets, so texts are read
once and never shuffled. Linking is an interval join: a weak candidate (a
random-looking string, an endpoint) is sent to the scope bucket it starts in and
to both neighbours, and is reported only if a part of another role (access
identifier, secret, endpoint) starts within ``scope`` code points of it. A bucket
of a text holds few spans, as each is some characters long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kind -> (pattern, group whose length counts, its least length, what the match must hold too).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ()),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, ()),
    "hex": (r"[0-9a-f]{32,}", 0, 32, ()),
}
#: Kinds that count only beside a complementary part.
WEAK = {
    "weak_secret": (r"[A-Za-z0-9+/]{20,}={0,2}", 0, 20, ("[A-Z]", "[a-z]", "[0-9]")),
    "endpoint": (r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/-]*)?|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?", 0, 7, ()),
}
PATTERNS = BASE | WEAK
ROLE = {"access": "identifier", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "endpoint"}
RANK = {kind: i for i, kind in enumerate(PATTERNS)}


def _found(text: Column, kind: str) -> Column:
    """Array of (gap, size, ok) of the leftmost non-overlapping matches; gap is the distance to the match before."""
    pattern, group, least, holds = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    ok = F.transform(measured, lambda v: _all(v, holds) & (F.length(v) >= least))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    joined = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), F.transform(matches, F.length).alias("size"), ok.alias("ok"))
    return F.when(F.regexp_like(text, F.lit(pattern)), joined)


def _all(value: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & F.regexp_like(value, F.lit(p))
    return out


def _spans(docs: DataFrame) -> DataFrame:
    """doc_id, print, kind, start and end (code points, end exclusive) of all matches that pass, once for equal rows."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("print"), *(_found(F.col("text"), k).alias(k) for k in PATTERNS))
    hits = marked.where(F.coalesce(*PATTERNS).isNotNull()).groupBy("doc_id", "print").agg(*(F.first(k).alias(k) for k in PATTERNS))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in PATTERNS))
    rows = hits.select("doc_id", "print", F.explode(kinds).alias("k")).select("doc_id", "print", "k.kind", F.posexplode("k.found").alias("at", "m"))
    upto = Window.partitionBy("doc_id", "print", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(upto)
    placed = rows.select("doc_id", "print", "kind", (end - F.col("m.size")).alias("start"), end.alias("end"), "m.ok")
    return placed.where("ok").drop("ok")


def linked_spans(docs: DataFrame, scope: int = 256) -> DataFrame:
    """All base spans and the weak ones that are reported: doc_id, print, kind, start, end.

    A weak span that overlaps a base span of its text is not a candidate.
    """
    spans = _spans(docs)
    base = spans.where(F.col("kind").isin(*BASE))
    role = F.element_at(F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv)), F.col("kind"))
    text = Window.partitionBy("doc_id", "print")
    # What follows is read from the end: frames that only grow cost one pass, however many spans a text has.
    before, after = (text.orderBy(*(d(c) for c in ("start", "end", "kind"))).rowsBetween(Window.unboundedPreceding, -1) for d in (F.asc, F.desc))
    covered = F.max(F.when(F.col("kind").isin(*BASE), F.col("end"))).over(before)
    opens = F.min(F.when(F.col("kind").isin(*BASE), F.col("start"))).over(after)
    free = F.col("kind").isin(*BASE) | ((F.coalesce("covered", F.lit(-1)) <= F.col("start")) & (F.coalesce("opens", F.col("end")) >= F.col("end")))
    parts = spans.withColumn("covered", covered).withColumn("opens", opens).where(free).drop("covered", "opens")
    parts = parts.withColumn("role", role).withColumn("bucket", F.floor(F.col("start") / scope))
    weak = parts.where(F.col("kind").isin(*WEAK)).withColumn("bucket", F.explode(F.array(*(F.col("bucket") + i for i in (-1, 0, 1))))).alias("w")
    near = parts.alias("p")
    meets = (F.col("w.doc_id").eqNullSafe(F.col("p.doc_id"))) & (F.col("w.print") == F.col("p.print")) & (F.col("w.bucket") == F.col("p.bucket"))
    meets = meets & (F.col("w.role") != F.col("p.role")) & (F.abs(F.col("w.start") - F.col("p.start")) <= scope)
    told = weak.join(near, meets, "left_semi").select("doc_id", "print", "kind", "start", "end").distinct()
    return base.union(told)


def secret_report(docs: DataFrame, scope: int = 256) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of ``docs``.

    A null text counts as empty; a text without spans has zero counts, the digest
    of the empty string and empty spans. Equal rows get equal results, rows with
    equal doc_id and different texts are told apart. Other columns are ignored.
    """
    spans = linked_spans(docs, scope)
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), F.col("kind"))
    entry = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("said"))
    found = spans.groupBy("doc_id", "print").agg(F.array_sort(F.collect_list(entry)).alias("s"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE))
    join = lambda s: F.array_join(F.transform(s, lambda x: x["said"]), ",")
    found = found.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), *(f"n_{k}" for k in BASE), join(F.filter("s", lambda x: x["rank"] < len(BASE))).alias("base"), join(F.col("s")).alias("all"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("print"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("print") == F.col("__print")), "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("all", F.lit("")).alias("spans"))
