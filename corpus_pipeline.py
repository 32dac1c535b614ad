"""The corpus pipeline: from the table of documents to packed sequences.

Each stage works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.best_fit import pack
from tidemark.llm.decontaminate import remove_contamination
from tidemark.llm.jaccard_join import jaccard_classes
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import BYTE_BPE
from tidemark.llm.secret_scan import redact_secrets
from tidemark.llm.staged import Staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality and toxicity scorers keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by Jaccard similarity; all other rows stay.

    Every row is a text of its own, whatever its id: rows that repeat an id or have
    none go only if they are linked to another row. Of a group the row with the least
    ``doc_id`` stays, NULL last; of rows with the same, any one. Rows without words have
    no links and stay. The rows are written with a key each, so that it is the same
    in all scans.
    """
    staged = Staged(spark, "near-duplicates")
    key = "row key"
    while key in {name.lower() for name in docs.columns}:
        key += " of pipeline"
    keyed = staged.put("keyed", docs.withColumn(key, F.monotonically_increasing_id()))
    classes = jaccard_classes(keyed, key)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", key)
    rows = classes.join(keyed.select(key, "doc_id"), key)
    first = rows.groupBy("component_id").agg(F.min(place).alias("first")).select(F.col("first")[key].alias(key))
    return keyed.join(first, key, "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those that were little else go."""
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the values of secrets replaced."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences."""
    return pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: Training a scorer, an automaton, Markov models and byte pairs can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; each stage's is written to the shared folder and read again."""
    staged = Staged(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = staged.put(f"stage-{place}", stage(spark, docs, sf_dir))
        staged.drop(f"stage-{place - 1}")
        staged.release()
    return docs
