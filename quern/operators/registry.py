"""Standards on hand: the registry, what of it is qualified, and the records that a search may see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: kinds of articles that are searched unless others are named.
SEARCHED = ("NORMATIVE", "APPENDIX", "EXPLANATION")


def folded(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def listing(registry: DataFrame, status: str | None = None, discipline: str | None = None, jurisdiction: str | None = None) -> DataFrame:
    """Entries (standard_code, standard_name, status, discipline, jurisdiction, effective_date) that fit, with place from 1 by code, date and name."""
    rows = registry if status is None else registry.where(F.col("status") == status)
    for column, wanted in (("discipline", discipline), ("jurisdiction", jurisdiction)):
        if wanted is not None:
            rows = rows.where(folded(F.col(column)) == F.lower(F.lit(wanted)))
    order = Window.orderBy(folded(F.col("standard_code")), F.coalesce(F.col("effective_date").cast("string"), F.lit("")), folded(F.col("standard_name")))
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def canonical(code: Column) -> Column:
    """A code in capitals without white space, with plain dashes; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(F.regexp_replace(code, r"(?U)\s+", ""), "[—–]", "-")), F.lit(""))


def is_qualified() -> Column:
    """Whether a document's identity, parsing and official source are settled; its binding is a struct of confirmed and source_checksum."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return F.coalesce(
        (F.col("identity_status") == "CONFIRMED") & (F.col("parse_status") == "PARSED") & filled("canonical_code") & filled("standard_code") & filled("standard_name")
        & F.regexp_like("source_checksum", F.lit("^[0-9a-f]{64}$")) & F.col("binding.confirmed") & (F.col("binding.source_checksum") == F.col("source_checksum")),
        F.lit(False),
    )


def qualified_scopes(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """standard_id, standard_code, canonical_code, standard_name and source_checksum of qualified documents whose code is active, each once."""
    active = registry.where(F.col("status") == "ACTIVE").select(canonical(F.col("standard_code")).alias("canonical_code")).distinct()
    named = documents.where(is_qualified()).withColumn("canonical_code", canonical(F.col("canonical_code")))
    return named.join(active, "canonical_code", "left_semi").select("standard_id", "standard_code", "canonical_code", "standard_name", "source_checksum")


def unknown_ids(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """The standard_ids that are asked for and not there."""
    return asked.select("standard_id").distinct().join(documents.select("standard_id"), "standard_id", "left_anti")


def search_records(documents: DataFrame, articles: DataFrame, kinds: Sequence[str] = SEARCHED, chapters: Sequence[str] | None = None, active: DataFrame | None = None) -> DataFrame:
    """Articles of the kinds and chapters with their document, embedding_text, and pages that are null unless they lie in the document in order.

    ``documents``: standard_id, standard_name, standard_code, canonical_code,
    page_count; ``articles``: standard_id, article_number, chapter_number,
    chapter_title, content, article_type, page_start, page_end. ``active``, a
    table with standard_code, limits documents to its codes.
    """
    rows = articles.where(F.col("article_type").isin(*kinds))
    if chapters is not None:
        rows = rows.where(F.col("chapter_number").isin(*chapters))
    if active is not None:
        codes = active.select(folded(F.coalesce(canonical(F.col("standard_code")), F.col("standard_code"))).alias("__code")).distinct()
        own = documents.withColumn("__code", folded(F.coalesce("canonical_code", canonical(F.col("standard_code")), "standard_code")))
        documents = own.where("__code <> ''").join(codes, "__code", "left_semi").drop("__code")
    met = rows.join(documents, "standard_id")
    said = F.concat_ws("\n", *(F.nullif(F.col(c), F.lit("")) for c in ("standard_name", "chapter_title", "article_number", "content")))
    fine = (F.col("page_start") <= F.col("page_end")) & (F.col("page_end") <= F.col("page_count"))
    pages = [F.when(fine, F.col(c)).alias(c) for c in ("page_start", "page_end")]
    return met.select("standard_id", "standard_code", "standard_name", "article_number", "chapter_number", "article_type", "content", said.alias("embedding_text"), *pages)
