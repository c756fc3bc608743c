"""Completeness: evidence counts by check, a rule table, and the score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import rules as RU

KINDS = ("chapters", "fields", "items", "components", "broad")


def check_status(check: str = "check_id", special: Column | None = None, checks: Sequence[tuple[str, str, str, bool]] = RU.CHECKS) -> Column:
    """PASS, PARTIAL, MISSING or NOT_APPLICABLE of a row with the counts of KINDS and flag; ``special`` tells plans that must pass SPECIAL_CHECK too."""
    status = F.lit(None).cast("string")
    for name, passes, partly, needed in checks:
        must = F.coalesce(special, F.lit(False)) if name == RU.SPECIAL_CHECK and special is not None else F.lit(needed)
        missing = F.when(must, "MISSING").otherwise("NOT_APPLICABLE")
        status = F.when(F.col(check) == name, F.when(F.expr(passes), "PASS").when(F.expr(partly), "PARTIAL").otherwise(missing)).otherwise(status)
    return status


def chapter_evidence(chapters: DataFrame, doc: str) -> DataFrame:
    """doc, check_id, kind and value of the chapters (doc, title, page) whose title is evidence; equal titles of a page count once."""
    hits = F.array_compact(F.array(*(F.when(F.regexp_like("title", F.lit(p)), F.struct(F.lit(c).alias("check_id"), F.lit(k).alias("kind"))) for c, k, p in RU.CHAPTER_EVIDENCE)))
    rows = chapters.select(doc, "title", "page", F.explode(hits).alias("e"))
    value = F.when(F.col("e.kind") == "components", F.col("title")).otherwise(F.concat_ws("\n", "title", "page"))
    return rows.select(doc, "e.check_id", "e.kind", value.alias("value")).distinct()


def field_evidence(fields: DataFrame, doc: str) -> DataFrame:
    """doc, check_id, kind and value (the path) of the fields (doc, path, value) that are filled; a section's flag counts if its value is true."""
    value = F.trim(F.coalesce("value", F.lit("")))
    hits = F.array_compact(F.array(*(F.when(F.startswith("path", F.lit(p)), F.struct(F.lit(c).alias("check_id"), F.lit(k).alias("kind"))) for c, k, p in RU.FIELD_EVIDENCE)))
    filled = fields.where(value != "").where(~F.startswith("path", F.lit("section_presence.")) | (F.lower(value) == "true"))
    return filled.select(doc, "path", F.explode(hits).alias("e")).select(doc, "e.check_id", "e.kind", F.col("path").alias("value")).distinct()


def checks(evidence: DataFrame, doc: str, docs: DataFrame, special: Column | None = None) -> DataFrame:
    """doc, check_id, the counts and status for every document and check. ``evidence``: doc, check_id, kind (of KINDS or flag), value (counted once).

    ``special``: where true, the document must pass SPECIAL_CHECK too.
    """
    distinct = evidence.select(doc, "check_id", "kind", "value").distinct()
    counted = distinct.groupBy(doc, "check_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), F.bool_or(F.col("kind") == "flag").alias("flag"))
    every = docs.withColumn("check_id", F.explode(F.array(*(F.lit(c[0]) for c in RU.CHECKS))))
    rows = every.join(counted, [doc, "check_id"], "left").na.fill(0, list(KINDS)).na.fill(False, ["flag"])
    return rows.withColumn("status", check_status(special=special))


def score(rows: DataFrame, doc: str) -> DataFrame:
    """doc, the counts of the four statuses and score: floor(100 * (PASS + PARTIAL / 2) / applicable + 0.5)."""
    counts = {s: F.count_if(F.col("status") == s) for s in ("PASS", "PARTIAL", "MISSING", "NOT_APPLICABLE")}
    out = rows.groupBy(doc).agg(*(c.alias(s.lower()) for s, c in counts.items()))
    usable = F.col("pass") + F.col("partial") + F.col("missing")
    points = 100 * (F.col("pass") + 0.5 * F.col("partial")) / F.nullif(usable, F.lit(0))
    return out.withColumn("score", F.coalesce(F.floor(points + 0.5), F.lit(0)).cast("long"))


def profile(document_type: Column) -> Column:
    """Review profile by document type."""
    return F.when(F.regexp_like(F.coalesce(document_type, F.lit("")), F.lit("专项(?:施工)?方案")), "special_construction_plan").otherwise("general_construction_plan")
