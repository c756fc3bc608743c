"""Pluggable stages: embeddings, recognition and language-model extraction as callables over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def embed(rows: DataFrame, text: str, provider: Callable[[Sequence[str]], Sequence[Sequence[float]]], dimension: int) -> DataFrame:
    """rows with ``embedding``; a vector of another dimension or with a value that is not finite fails the task."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def vectors(texts: pd.Series) -> pd.Series:
        out = [list(map(float, v)) for v in provider(texts.fillna("").tolist())]
        for v in out:
            if len(v) != dimension or any(x != x or x in (float("inf"), float("-inf")) for x in v):
                raise ValueError("bad embedding")
        return pd.Series(out)

    return rows.withColumn("embedding", vectors(text))


def recognise(pages: DataFrame, provider: Callable[[bytes], list[tuple[str, float, list[list[float]]]]]) -> DataFrame:
    """document_id, page_number, line_id, text, confidence and polygon of recognised lines; a page that fails gives one row with error.

    ``pages``: document_id, page_number and image (bytes).
    """
    schema = "document_id string, page_number int, reading_order int, line_id string, text string, confidence double, polygon array<array<double>>, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, page, image in zip(pdf["document_id"], pdf["page_number"], pdf["image"], strict=True):
                try:
                    for n, (text, confidence, polygon) in enumerate(provider(image)):
                        name = "ocrline_" + hashlib.sha256(repr((page, n, text, polygon)).encode()).hexdigest()
                        rows.append((doc, page, n, name, text, confidence, polygon, None))
                except (RuntimeError, ValueError) as e:
                    rows.append((doc, page, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "reading_order", "line_id", "text", "confidence", "polygon", "error"])

    return pages.select("document_id", "page_number", "image").mapInPandas(run, schema)


def complete(chunks: DataFrame, key: str, provider: Callable[[str], str] | None = None) -> DataFrame:
    """key and answer of each chunk's content; without a provider there are no answers."""
    kind = dict(chunks.dtypes)[key]
    if provider is None:
        return chunks.select(key, F.lit(None).cast("string").alias("answer")).limit(0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "answer": [provider(c) for c in pdf["content"]]})

    return chunks.select(key, "content").mapInPandas(run, f"{key} {kind}, answer string")


def first_object(answer: Column) -> Column:
    """The JSON object in a model's answer: a fenced one, else from the first brace to the last."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit("")))


def parse_object(answer: Column, schema: str) -> Column:
    """The answer's object by schema; null where it is none. Unknown fields are dropped."""
    return F.from_json(first_object(answer), schema, {"mode": "PERMISSIVE"})
