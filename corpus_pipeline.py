"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents that it keeps; the last writes
them as token shards and returns what these hold. Stages in a shared run are written as Parquet and read again.

Defined cases, of every stage: null texts, ids and sources are kept as what they are (a null text is an empty one), but
where its operator says otherwise; an empty table gives an empty table; very long texts are taken whole; extra columns
pass through whatever their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import common, decontamination, jaccard_join, mixing, sstable, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the examples come from the stage's own input. Repeated rows are kept or go together; without
    labels, or with labels of one class, no document is told apart: all stay unless every example is toxic."""
    return toxicity.clean(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id (of no id only where none has one). Texts
    without words are copies of one another; of rows equal in id and text one stays."""
    return jaccard_join.dedupe(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go. Each row is judged by itself."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times. Equal lengths are drawn in a seeded order; a null
    source is a source of its own."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' place, length and checksum in the token shards, in the order of ids (null first), repeats side by
    side."""
    return sstable.encode_and_read(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", contaminated),
    ("mixing", mixture),
    ("token_output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The mix's seeded choice and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
