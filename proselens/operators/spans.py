"""Spans against sentences (K6-K10, J9): overlap join, interval merge, naming of units, what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(sentences: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """K6: for each span(key, rule, start, end) the first and last sentence(key, i, s, e) it touches: an equi-join with a range residual."""
    hit = spans.join(sentences, key).filter((F.col("s") >= 0) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    return hit.groupBy(key, "rule", "start", "end").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))


def merge_intervals(ranges: DataFrame, key: str) -> DataFrame:
    """K7: ranges(key, lo, hi) with the number of their unit; ranges that share a sentence are one unit."""
    order = Window.partitionBy(key).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("lo") <= reach, 0).otherwise(1)
    return ranges.withColumn("new", new).withColumn("unit", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def name_units(ranges: DataFrame, key: str, order: tuple[str, ...] = ("P14", "P13", "P15")) -> DataFrame:
    """K8: per unit the first rule of the order that has a span in it, how many of its spans, and the unit's sentences."""
    rank = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("rule")).cast("int")
    units = merge_intervals(ranges, key).withColumn("rank", rank)
    return units.groupBy(key, "unit").agg(
        F.min("lo").alias("first_sentence"), F.max("hi").alias("last_sentence"), F.min_by("rule", "rank").alias("rule"), F.min("rank").alias("best"), F.collect_list("rank").alias("ranks")
    ).select(key, "unit", "first_sentence", "last_sentence", "rule", F.size(F.filter("ranks", lambda r: r == F.col("best"))).cast("long").alias("n_spans"))


def unclaimed(sentences: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Sentences in no unit: a range anti-join."""
    u = units.select(F.col(key).alias("__key"), "first_sentence", "last_sentence")
    return sentences.join(u, (F.col(key) == F.col("__key")) & F.col("i").between(F.col("first_sentence"), F.col("last_sentence")), "left_anti")


def orphans(spans: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """K9: spans that touch no located sentence; they stand for the whole comment."""
    return spans.join(placed.select(key, "rule", "start", "end"), [key, "rule", "start", "end"], "left_anti")


def disabled_lines(lines: DataFrame, key: str) -> DataFrame:
    """lines(key, pos, off, on): off takes effect on its own line, on after its own."""
    order = Window.partitionBy(key).orderBy("pos")
    change = F.when(F.col("on"), F.lit(False)).when(F.col("off"), F.lit(True))
    after = F.last(change, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("after", after)
    return marked.withColumn("disabled", F.col("off") | F.coalesce(F.lag("after").over(order), F.lit(False))).drop("after")


def live_blocks(blocks: DataFrame, disabled: DataFrame, key: str) -> DataFrame:
    """blocks(key, start, end) that touch no disabled line: a range anti-join."""
    d = disabled.filter("disabled").select(F.col(key).alias("__key"), "pos")
    return blocks.join(d, (F.col(key) == F.col("__key")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")), "left_anti")
