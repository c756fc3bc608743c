"""Spans of a pattern in a text with code-point offsets, without Python.

A split gives the gaps, an extraction the matches; running sums of both lengths
give the offsets. Sums run inside an array, for texts of page size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentence and clause grammars.
SENTENCE = "[^。！？!?；;\r\n]+[。！？!?；;]?"
CLAUSE = "[^。！？!?；;，,\r\n]+[。！？!?；;，,]?"


def pattern_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the leftmost non-overlapping matches; end is exclusive, offsets from 0."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("text")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        span = F.struct(first.alias("start"), (first + x["size"]).alias("end"), x["text"].alias("text"))
        return F.struct((first + x["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def trimmed(span: Column) -> Column:
    """The span without white space at its ends."""
    lead = F.length(span["text"]) - F.length(F.regexp_replace(span["text"], r"(?U)^\s+", ""))
    text = F.regexp_replace(span["text"], r"(?U)^\s+|\s+$", "")
    return F.struct((span["start"] + lead).alias("start"), (span["start"] + lead + F.length(text)).alias("end"), text.alias("text"))


def clauses(text: Column, pattern: str = CLAUSE) -> Column:
    """Trimmed non-empty spans of a clause or sentence grammar."""
    return F.filter(F.transform(pattern_spans(text, pattern), trimmed), lambda s: s["end"] > s["start"])


def bounded_clauses(text: Column, most: int = 320) -> Column:
    """Sentences of at most ``most`` characters; longer ones as their comma clauses that are not longer."""
    inner = lambda s: F.transform(clauses(s["text"], "[^，,]+[，,]?"), lambda c: F.struct((c["start"] + s["start"]).alias("start"), (c["end"] + s["start"]).alias("end"), c["text"].alias("text")))
    parts = F.transform(clauses(text, SENTENCE), lambda s: F.when(s["end"] - s["start"] <= most, F.array(s)).otherwise(inner(s)))
    return F.array_distinct(F.filter(F.flatten(parts), lambda s: s["end"] - s["start"] <= most))


def windows(text: Column, signal: str, most: int = 280) -> Column:
    """Clauses of at most ``most`` characters; longer ones as windows of that size around each signal."""
    def around(s: Column) -> Column:
        size = s["end"] - s["start"]

        def cut(hit: Column) -> Column:
            center = F.floor((hit["start"] + hit["end"]) / 2).cast("int")
            first = F.greatest(F.lit(0), center - most // 2)
            last = F.least(size, first + most)
            first = F.greatest(F.lit(0), last - most)
            return trimmed(F.struct((s["start"] + first).alias("start"), (s["start"] + last).alias("end"), F.substring(s["text"], first + 1, last - first).alias("text")))

        return F.when(size <= most, F.array(s)).otherwise(F.transform(pattern_spans(s["text"], signal), cut))

    return F.array_distinct(F.flatten(F.transform(clauses(text), around)))
