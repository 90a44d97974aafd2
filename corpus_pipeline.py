"""A training corpus in five stages, each written as Parquet and reread as the next one's documents.

toxicity (rejected documents go) -> exact dedup -> n-gram Jaccard join (one
document of each group stays) -> secret scans (secrets are masked) -> packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronotext.llm import exact_dedup, ngram_join, packing, secret_scan, toxicity
from chronotext.llm.common import stored, table
from chronotext.session import ensure_checkpoint_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model trained on ``labels``.

    Null and empty texts score as one empty window; null ids, repeated rows and
    extra columns stay as they are; an empty table gives an empty table.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the largest id of each group of equal texts.

    Null counts as empty, so of null and empty texts one stays; of rows that
    repeat id and text one stays; a null id gives way to any other; extra
    columns stay as they are; an empty table gives an empty table.
    """
    return exact_dedup.drop_copies(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of linked texts.

    Null texts and texts without words link with nothing and stay; null ids come
    last; of rows that repeat id and text one stays; extra columns stay as they
    are; an empty table gives an empty table.
    """
    return ngram_join.drop_near_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted anew where one was.

    Null and empty texts, null ids, repeated rows and extra columns stay as they
    are; an empty table gives an empty table.
    """
    return secret_scan.mask_secrets(docs, length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and offset.

    Null and empty texts are one piece of the end token; null ids and repeated
    rows are packed like others; extra columns aren't read; an empty table gives
    an empty table.
    """
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_dedup_stage), ("near_copies", near_copies_stage),
          ("secrets", secrets_stage), ("packing", packing_stage)]

# SQL can't express a trained network, links followed to their end, or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
