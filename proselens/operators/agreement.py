"""Consensus of two labelers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def agreement(a: Column, b: Column) -> Column:
    """Full, partial or conflict; two empty sets agree in full."""
    return F.when(F.array_sort(a) == F.array_sort(b), "full").when(F.arrays_overlap(a, b), "partial").otherwise("conflict")


def united(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def agreed(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def consensus(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of both labelers, their union, intersection and agreement; items with both only."""
    both = first.withColumnRenamed("labels", "a").join(second.withColumnRenamed("labels", "b"), keys)
    return both.select(*keys, united(F.col("a"), F.col("b")).alias("labels"), agreed(F.col("a"), F.col("b")).alias("labels_agreed"), agreement(F.col("a"), F.col("b")).alias("agreement"))


def with_labels(pairs: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """pairs(keys, labels) with the consensus where there is one; else their own labels, in full agreement."""
    found = decided.withColumnsRenamed({"labels": "l", "labels_agreed": "la", "agreement": "ag"})
    own = F.coalesce("l", "labels")
    return pairs.join(found, keys, "left").select(*pairs.drop("labels").columns, own.alias("labels"), F.coalesce("la", "labels").alias("labels_agreed"), F.coalesce("ag", F.lit("full")).alias("agreement"))


def read_batches(spark: SparkSession, folder: str, labeler: str) -> DataFrame:
    """out_NN_A.json or out_NN_B.json of a folder: batch, i, labels."""
    rows = spark.read.schema("i int, labels array<string>").option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", f"out_*_{labeler}.json").json(folder)
    return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"out_(\d+)_", 1)).select("batch", "i", "labels")
