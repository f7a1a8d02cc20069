"""The corpus pipeline: five stages over ``documents``, each of which works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, jaccard, mixing, quality, tokenids
from ledgerloom.llm.common import Scratch, scratch, table
from ledgerloom.llm.queries import tokenizer_path

#: Of all tokens, what the mix takes; no document is taken twice.
SHARE, EPOCHS, SEED = (9, 10), 1, 1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and empty texts are rejected. Columns of ``docs`` may have any names."""
    book = quality.ledger(docs.select(F.struct("*").alias("__doc"), "text"))
    return book.where(quality.passes("full-1")).select("__doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest doc_id stays, once; documents without doc_id are grouped like
    others and stay if their group has none with one. Rows that share a doc_id are judged each by its text."""
    return jaccard.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with or without doc_id."""
    return decontam.without_hits(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with or without doc_id."""
    return mixing.taken(docs, SHARE, mixing.WEIGHTS, EPOCHS, SEED)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what the token files hold; null doc_ids come first, rows that share one by text."""
    path = scratch(spark, "token-ids")
    tokenids.write_ids(docs, tokenizer_path(), path)
    return tokenids.documents_of(tokenids.read_ids(spark, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]
#: The token files hold a tokenizer's ids, which SQL can't make.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written as Parquet, read again, and dropped when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as kept:
        for name, stage in STAGES[:-1]:
            docs = kept.put("stage", stage(spark, docs, sf_dir))
        out = kept.put("result", STAGES[-1][1](spark, docs, sf_dir))
        kept.keep("result")
        return out
