"""The corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all but the last return the columns of documents. run() writes
each stage's result as Parquet into the shared folder and reads it back as the next stage's documents, so that a lost executor costs
one stage's tasks at most; what a stage wrote for itself, and the input of the stage before, is removed then. Defined results for nulls, repeated rows and empty tables are those of the operators' docstrings:
documents without words go at the first stage, as nothing can be judged or trained on; documents of which line dedup
leaves nothing go there; contaminated documents go whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import decontamination, line_dedup, near_dedup, packing, quality_classifier
from plinth.llm.common import discard, materialise, scope, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.clean(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the language model, the sketches and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scope(spark):
            docs = materialise(stage(spark, docs, sf_dir), outside=True)
        discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
