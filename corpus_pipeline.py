"""Corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, personal data, mixing.

Each stage works on all its predecessor kept and returns the columns of documents; the last one adds copy, as a document stands
in the mix once per copy it takes. Stages are written as Parquet in the shared checkpoint folder and read again, so a lost
executor never costs more than a stage.

Defined cases, in every stage: a null text counts as empty (it is never toxic by its words, never a near copy, never contaminated,
and stays null); a null doc_id or source keeps its row; rows that repeat are near copies of each other, so one stays; an empty
table gives an empty table; columns besides those of documents pass through all stages, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductwork.llm import decontamination, mixing, pii, setjoin, toxicity
from ductwork.llm.common import shared_folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Documents whose toxicity reaches the threshold go. The model learns from the labelled documents of the whole table."""
    model = toxicity.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.with_score(docs, model, "__toxic").where(F.col("__toxic") < threshold).drop("__toxic")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: 85 % of four-word shingles shared, linked directly or through others."""
    return setjoin.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to their kinds in brackets."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as its source's target asks: documents' columns and copy."""
    return mixing.emit(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: The toxicity stage can't be expressed in SQL; tests compare the pipeline with plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
