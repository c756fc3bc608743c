"""Page sources: tables of page text, and binary documents with a pluggable extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

PAGE_SCHEMA = StructType([
    StructField("document_id", StringType()), StructField("page_number", IntegerType()), StructField("text", StringType()),
    StructField("image_count", IntegerType()), StructField("image_coverage", DoubleType()),
])
#: Largest document in bytes, fewest filled characters of a document.
MOST_BYTES, LEAST_CHARACTERS = 30 * 1024 * 1024, 10


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Pages from Parquet or JSON with the fixed schema; unreadable rows fail."""
    reader = spark.read.schema(PAGE_SCHEMA)
    return reader.option("mode", "FAILFAST").json(path) if kind == "json" else reader.format(kind).load(path)


def display_name(path: Column) -> Column:
    """The file's own name without folders of either style."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def is_pdf(name: Column, content: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".pdf")) & (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def binary_documents(spark: SparkSession, path: str, suffix: str = "*.pdf") -> DataFrame:
    """path, name, bytes, fits and content of the files of a folder; larger and empty files do not fit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)
    return files.select("path", display_name(F.col("path")).alias("name"), F.col("length").alias("bytes"), F.col("length").between(1, MOST_BYTES).alias("fits"), "content")


def extract_pages(documents: DataFrame, extract: Callable[[bytes], Iterable[tuple[int, str, int, float]]]) -> DataFrame:
    """Pages of documents that fit: ``extract`` gives (page_number, text, image_count, image_coverage) of one file's bytes.

    A file that cannot be read gives no pages; see :func:`unreadable`.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(path, *row) for row in extract(content)]
                except ValueError:
                    rows = []
                yield pd.DataFrame(rows, columns=PAGE_SCHEMA.names)

    return documents.where("fits").select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def unreadable(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """path and reason of documents without usable pages."""
    filled = pages.groupBy(F.col("document_id").alias("path")).agg(F.sum(F.length(F.regexp_replace("text", r"(?U)\s+", ""))).alias("n"))
    reason = F.when(~F.col("fits"), "SIZE").when(F.col("n").isNull(), "UNREADABLE").when(F.col("n") < LEAST_CHARACTERS, "NO_TEXT")
    return documents.join(filled, "path", "left").select("path", reason.alias("reason")).where("reason is not null")


def image_coverage(images: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, page_number, image_count and coverage: area of distinct images (xref, width, height) over the page's (area), at most 1."""
    distinct = images.dropDuplicates(["document_id", "page_number", "xref"])
    sums = distinct.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("image_count"), F.sum(F.col("width") * F.col("height")).alias("covered"))
    out = pages.join(sums, ["document_id", "page_number"], "left")
    share = F.least(F.coalesce("covered", F.lit(0.0)) / F.greatest(F.col("area"), F.lit(1.0)), F.lit(1.0))
    return out.select("document_id", "page_number", F.coalesce("image_count", F.lit(0)).alias("image_count"), share.alias("coverage"))


def documents_of(pages: DataFrame) -> DataFrame:
    """One row a document: page_count, char_count and text (pages in order, joined by line ends). A document must fit one row."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), F.sum(F.length("text")).alias("char_count"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


#: Fixed value: the shape of a stored document's id.
DOCUMENT_ID = "^[0-9a-fA-F-]{36}$"


def lookup(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked (document_id) with ``lookup``: MALFORMED, NOT_FOUND or FOUND among ``stored`` (document_id)."""
    have = stored.select("document_id").distinct().withColumn("__have", F.lit(True))
    state = F.when(~F.coalesce(F.regexp_like("document_id", F.lit(DOCUMENT_ID)), F.lit(False)), "MALFORMED").when(F.col("__have").isNull(), "NOT_FOUND").otherwise("FOUND")
    return asked.join(have, "document_id", "left").withColumn("lookup", state).drop("__have")


def page_numbers(text: DataFrame, structure: DataFrame, doc: str) -> DataFrame:
    """doc and page_number of pages that have text or hold a structural position, each once."""
    return text.select(doc, "page_number").union(structure.select(doc, "page_number")).distinct()
