"""The training-data pipeline: documents to a clean, mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; its result is written as
Parquet and read again as the next one's docs. Learnt and fixed inputs (labels, benchmark) come from
sf_dir. The last stage returns a row for each copy that the mix takes, with its number in `copy`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.decontaminate import decontaminate
from proselens.llm.jaccard_join import keep_first
from proselens.llm.line_dedup import dedup_lines
from proselens.llm.mixing import mix_sources
from proselens.llm.shared import written
from proselens.llm.toxicity import drop_toxic


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where documents have that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("line dedup", dedup_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark_passages),
    ("mixing", mix_to_targets),
]

#: The first stage is a learnt classifier, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
