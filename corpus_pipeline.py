"""Training-data pipeline over ``documents``: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. All but the last return the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyproof.llm.common import keep, stored
from tallyproof.llm.decontaminate import decontaminate
from tallyproof.llm.exact import exact_dedup
from tallyproof.llm.jaccard import similar
from tallyproof.llm.packing import packed
from tallyproof.llm.quality import classify
from tallyproof.llm.queries import table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects as junk or toxic. Without labels nothing is rejected."""
    return keep(docs, classify(docs, table(spark, sf_dir, "labels")).where("kept"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, then the one with the smallest id; repeated rows become one."""
    return keep(docs, exact_dedup(docs).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose five-word shingles are similar to 0.8 or more, the one with the smallest id stays."""
    found = similar(docs, n_words=5, percent=80)
    return keep(docs, found.where("doc_id <=> component_id"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents: at least one word in twenty lies in a 13-word window of a benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.where("not contaminated").select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of all documents in sequences of 2048 tokens."""
    return packed(docs, tokenizer())


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies),
          ("benchmark_passages", benchmark_passages), ("packing", packing)]

#: The classifier and the tokenizer have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
