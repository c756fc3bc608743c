"""The corpus pipeline: from documents to token ids, each stage over all that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return
the columns of documents. Between stages tables are written as Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, langid, lines, mixing, simhash
from quern.llm.storage import materialize, table

VOCABULARY = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models do not reject."""
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; n_chars follows the text."""
    kept = lines.dedup_lines(docs)
    chars = F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*(chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in target proportions by source: whole copies, and one cut document a source."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digest of the text decoded from the ids."""
    return bpe.encode_checked(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("source mixing", source_mixing),
    ("BPE encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, "documents", sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs


#: Trained models and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None
QUERIES = {"pipeline": run}
ORACLE_SQL_BY_QUERY: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
