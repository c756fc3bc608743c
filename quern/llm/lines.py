r"""Line dedup: an exact set-similarity join of lines, all in DataFrame operations.

A line goes if an earlier line (by doc_id, then by place) has the same text or a
Jaccard similarity of at least 0.8 between the sets of their ``shingle``-word
phrases; a line of fewer words is one phrase. Earlier lines count whether or not
they go themselves.

1. Of equal lines, told by two hashes, only the first goes on.
2. The phrases of a line are put in one order, and the first fifth (n // 5 + 1,
   the prefix) is kept: two lines that similar share a phrase of both prefixes.
   The order is by hash at first, and phrases are counted in these prefixes.
3. Lines that share phrases of their prefixes make pairs; at a common phrase a
   line meets only the first line that has it. So a group of near copies costs
   one pair a line and phrase, not all pairs.
4. Lines that this does not settle and that hold a common phrase meet all lines
   that hold the same one, under the order of rarity: common phrases come last, by
   count, and the prefixes are new. Counting all phrases outright would shuffle
   more than the texts themselves.

Pairs pass a length filter and a positional one, in step 3 also a bound from the
number of phrases that their prefixes share, in step 4 one from bitmaps; all of
these only drop pairs that cannot be similar enough. What is left is verified on
whole phrase sets. The bound of step 3 needs the number of shared phrases whole:
pairs that share a common phrase, of which it counts too few, meet in step 4.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, if_small, materialize

#: Similarity NUMER / DENOM or more.
NUMER, DENOM = 4, 5
#: A phrase in the first prefixes of more lines than this is common: it comes late in the order. Results do not depend on it.
COMMON = 64
#: Phrases up to this number are hashed by generated code; longer lines take a loop, with equal results.
UNROLLED = 192
#: Columns of a line's bitmap: the parity of the phrases at each of its places.
BITS = ("b0", "b1", "b2", "b3")


def _spaced() -> Column:
    """Whether the text has white space beside blanks and line ends."""
    return reduce(lambda a, b: a | b, (F.contains("text", F.lit(space)) for space in "\t\x0b\x0c\r"))


def _lines(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, columns ``also``, line_no, line and spaced of all lines."""
    # spaced is told before lines are made: beside posexplode it would be told again for each line.
    told = docs.select("doc_id", *also, "text", _spaced().alias("spaced"))
    return told.select("doc_id", *also, "spaced", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _with_phrases(rows: DataFrame, shingle: int) -> DataFrame:
    """The ``rows`` whose line has a word, with phrases, the sorted distinct hashes of the phrases of the line, in place of line and spaced.

    Each step is a projection of its own, so that all but the hashes of words run in generated code.
    """
    others = [c for c in rows.columns if c not in ("line", "spaced")]
    plain = F.when(F.col("spaced"), F.translate("line", "\t\x0b\x0c\r", "    ")).otherwise(F.col("line"))
    words = rows.select(*others, F.array_remove(F.split(plain, " "), "").alias("ws"))
    hashed = words.where(F.size("ws") > 0).select(*others, F.transform("ws", lambda w: F.xxhash64(w)).alias("ws"))
    at = lambda i: "xxhash64(" + ", ".join(f"get(ws, {i} + {k})" for k in range(shingle)) + ")"
    n = f"(size(ws) - {shingle - 1})"
    unrolled = ", ".join(f"if({n} > {i}, {at(i)}, 0L)" for i in range(UNROLLED))
    phrases = F.expr(f"case when {n} < 1 then array(xxhash64(ws)) when {n} <= {UNROLLED} then slice(array({unrolled}), 1, {n}) else transform(sequence(0, {n} - 1), i -> {at('i')}) end")
    return hashed.select(*others, phrases.alias("phrases")).select(*others, F.sort_array(F.array_distinct("phrases")).alias("phrases"))


def _prefix_size(n: Column) -> Column:
    return F.floor(n * (DENOM - NUMER) / DENOM).cast("int") + 1


def _prefix(phrases: Column) -> Column:
    return F.slice(phrases, F.lit(1), _prefix_size(F.size(phrases)))


def _rarest_first(sets: DataFrame, held: DataFrame, counts: DataFrame) -> DataFrame:
    """Second prefixes of the lines ``held``: phrase, at, n, doc_id, line_no and BITS; ``counts`` has the common phrases."""
    line = ["doc_id", "line_no"]
    own = sets.join(if_small(held), line)
    each = own.select(*line, F.explode("phrases").alias("phrase"))
    late = materialize(each.join(counts, "phrase").groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("lines", "phrase"))).alias("late")), "late")
    place, one = F.col("phrase").bitwiseAND(F.lit(64 * len(BITS) - 1)).cast("int"), F.lit(1).cast("long")
    parity = [F.bit_xor(F.when(F.floor(place / 64) == i, F.call_function("shiftleft", one, place.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long"))).alias(b) for i, b in enumerate(BITS)]
    bits = materialize(each.groupBy(*line).agg(*parity), "bits")
    ordered = own.join(late, line).select(*line, F.concat(F.array_except("phrases", F.col("late.phrase")), F.col("late.phrase")).alias("phrases")).join(bits, line)
    return ordered.select(*line, *BITS, F.size("phrases").alias("n"), F.posexplode(_prefix(F.col("phrases"))).alias("at", "phrase"))


def _met(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """A row for each phrase at which a line meets an earlier one: doc_id, line_no, n, doc_y, line_y, m.

    With BITS, the places in which bitmaps differ bound the number of phrases that
    only one line has, and the positional filter takes each phrase for the first
    that both share: similar lines pass at the one that is, and few others do.
    """
    x, y, c = later.alias("x"), earlier.alias("y"), F.col
    left = F.least(c("x.n") - c("x.at"), c("y.n") - c("y.at"))
    both = c("x.n") + c("y.n")
    meets = (
        (c("x.phrase") == c("y.phrase"))
        & ((c("y.doc_id") < c("x.doc_id")) | ((c("y.doc_id") == c("x.doc_id")) & (c("y.line_no") < c("x.line_no"))))
        & (DENOM * F.least("x.n", "y.n") >= NUMER * F.greatest("x.n", "y.n"))
    )
    if BITS[0] in later.columns:
        differ = reduce(lambda a, b: a + b, (F.bit_count(c(f"x.{b}").bitwiseXOR(c(f"y.{b}"))) for b in BITS))
        meets = meets & ((NUMER + DENOM) * left >= NUMER * both) & ((NUMER + DENOM) * differ <= (DENOM - NUMER) * both)
    else:
        meets = meets & ((NUMER + DENOM) * (F.least("x.at", "y.at") + left) >= NUMER * both)
    return x.join(y, meets).select(c("x.doc_id").alias("doc_id"), c("x.line_no").alias("line_no"), c("x.n").alias("n"), c("y.doc_id").alias("doc_y"), c("y.line_no").alias("line_y"), c("y.n").alias("m"))


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs that may be similar enough by the number of phrases at which they meet.

    All phrases of one of the two prefixes come before the last of the other, so
    what that one does not share there it does not share at all.
    """
    pairs = met.groupBy("doc_id", "line_no", "doc_y", "line_y", "n", "m").agg(F.count(F.lit(1)).alias("shared"))
    most = F.greatest(F.col("n") - _prefix_size(F.col("n")), F.col("m") - _prefix_size(F.col("m"))) + F.col("shared")
    return pairs.where((NUMER + DENOM) * most >= NUMER * (F.col("n") + F.col("m"))).select("doc_id", "line_no", "doc_y", "line_y")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id and line_no of the first lines of the pairs that are similar enough on whole sets."""
    asked = materialize(_both(pairs).distinct(), "asked")
    own = materialize(sets.join(if_small(asked), ["doc_id", "line_no"], "left_semi"), "own")
    right = own.select(F.col("doc_id").alias("doc_y"), F.col("line_no").alias("line_y"), "phrases")
    full = pairs.join(own.withColumnRenamed("phrases", "own"), ["doc_id", "line_no"]).join(right, ["doc_y", "line_y"])
    same = F.size(F.array_intersect("own", "phrases"))
    found = full.where((NUMER + DENOM) * same >= NUMER * (F.size("own") + F.size("phrases"))).select("doc_id", "line_no").distinct()
    out = materialize(found, "verified")
    discard(asked, own)
    return out


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("doc_id", "line_no").union(pairs.select("doc_y", "line_y"))


def _near(shared: DataFrame, known: DataFrame, shingle: int) -> DataFrame:
    """doc_id and line_no of the lines that are similar to an earlier one.

    ``shared`` has the phrases of first prefixes that two lines or more have:
    phrase, at, n, doc_id, line_no, and lines, the number of lines that have it.
    """
    line, mark = ["doc_id", "line_no"], ["phrase", "at", "n", "doc_id", "line_no"]
    rare, common = (shared.where((F.col("lines") > COMMON) == x).select(*mark, "lines") for x in (False, True))
    pairs = materialize(_pairs(_met(rare, rare).union(_met(common, _heads(common)))), "pairs")
    wanted = common.select(*line).union(_both(pairs)).groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted"))
    wanted = materialize(wanted, "wanted")
    picked = _lines(known.join(if_small(wanted), "doc_id"), "wanted").where(F.array_contains("wanted", F.col("line_no")))
    sets = materialize(_with_phrases(picked.drop("wanted"), shingle), "sets")
    easy = _verified(pairs, sets)
    discard(pairs, wanted)

    asked = common.join(easy, line, "left_anti").select("phrase").distinct()
    held = materialize(common.join(asked, "phrase", "left_semi").select(*line).distinct(), "held")
    second = materialize(_rarest_first(sets, held, common.select("phrase", "lines").distinct()).select(*mark, *BITS), "second")
    more = materialize(_met(second.join(easy, line, "left_anti"), second).drop("n", "m").distinct(), "pairs")
    rest = _verified(more, sets)
    out = materialize(easy.union(rest), "near")
    discard(sets, easy, held, second, more, rest)
    return out


def _heads(marks: DataFrame) -> DataFrame:
    """The marks of the first line that has each phrase."""
    return marks.groupBy("phrase").agg(F.min(F.struct("doc_id", "line_no", "at", "n")).alias("h")).select("phrase", "h.*")


def repeated_lines(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and gone (places of the lines that go, from 0) of the documents that lose lines."""
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    keys = [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), "line").alias("k2")]
    told = _with_phrases(_lines(known).select("doc_id", "line_no", *keys, "spaced", "line"), shingle)
    told = materialize(told.select("doc_id", "line_no", "k1", "k2", F.size("phrases").alias("n"), _prefix(F.col("phrases")).alias("prefix")), "lines")
    # doc_id, then place, as one number: hashed aggregation keeps it.
    place = F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")
    firsts = told.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("k1", "k2", "first")
    # A table of its own, so that the join with it can be split at lines that are very common.
    firsts = materialize(firsts, "firsts")
    later = F.coalesce(place != F.col("first"), F.lit(False))
    parted = told.join(if_small(firsts), ["k1", "k2"], "left").select("doc_id", "line_no", later.alias("later"), "n", F.when(~later, F.col("prefix")).alias("prefix"))
    parted = materialize(parted, "parted")
    discard(told, firsts)
    marks = parted.where("not later").select("doc_id", "line_no", "n", F.posexplode("prefix").alias("at", "phrase"))
    twice = materialize(marks.groupBy("phrase").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1"), "twice")
    shared = materialize(marks.join(if_small(twice), "phrase"), "shared")
    discard(twice)
    near = _near(shared, known, shingle)
    discard(shared)
    out = materialize(parted.where("later").select("doc_id", "line_no").union(near).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")), "gone")
    discard(parted, near)
    return out


def dedup_lines(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """All rows and columns of ``docs``, text without the lines that go, and __n_lines and __n_removed.

    A null text stays null; lines without a word never go. Rows with a null
    doc_id keep all lines and remove none elsewhere. Rows that share a doc_id are
    one document: a place that goes from one of them goes from all. A document
    may become empty; its row stays. An empty table gives an empty result.
    """
    gone = if_small(repeated_lines(docs, shingle)).select(F.col("doc_id").alias("__id"), "gone")
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left")
    keep = lambda lines: F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(keep(F.split("text", "\n")))
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1)
    columns = [text.alias("text") if name == "text" else F.col(name) for name in docs.columns]
    return joined.select(*columns, n_lines.cast("long").alias("__n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("__n_removed"))
