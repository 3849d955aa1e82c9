"""Corpus pipeline: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents, whatever their names; the last returns the places of the tokenized pieces in
packed sequences.

Defined results: an empty table gives none through all stages. Null and empty texts are
judged by quality as the empty text, are no copies of other documents' (equal ones of
one id count once), hold no benchmark item and no personal data, and are one piece.
Rows without id stay in every stage. Repeated rows count once from the second stage on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, jaccard, packing, pii, quality
from loomspan.llm.common import drop_tables, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of docs, doesn't reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels)
    return quality.predict(docs, model, score="__score").where(F.col("__score") >= 0.5).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a Jaccard similarity of 0.8."""
    return jaccard.keep_one(docs, 5, 80, 100)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express these stages; test_pipeline.py holds them against the operators and plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one is written, but for the last."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            drop_tables(spark, [f"{folder}/{before}"] if before else [])
            before = name
    return docs
