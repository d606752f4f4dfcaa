"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source expects the same number of copies, target / source size; its whole part is
sure and its fraction is a probability. Pairs of fractional documents transfer mass, in words, at
random until one of the two is integral, so that every document keeps its expectation and the words
taken keep their sum. A bucket of a source's documents leaves at most one fractional document; such
residuals combine in a reduction tree of buckets of buckets until one a source is left, which is
rounded by its own probability. Large documents are paired first, so what is left last is a small one. A
source's words so differ from its target by less than one document.

All random draws are hashes of the seed, the bucket and the position in doc_id order, so reruns,
retries and other partitionings agree.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its
own, weighed last; a source without words has target 0; repeated rows are rounded one by one; an
empty table gives an empty result; a null doc_id is kept; columns of docs stay, whatever their names, but
one that has the name asked for the number of a copy (`copy`) is replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselens.llm.shared import shuffle_partitions, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0

#: Documents in a bucket on average, and buckets that one bucket of the next level combines.
BUCKET_ROWS = 1024
FAN_IN = 64

_ROW = "doc_id long, text_hash long, source string, bucket long, size long, copies int, p double"


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source_size, n_docs and target. Targets share `share` times all sizes by weight; where a share is above
    cap times the source's size it stops there and the rest is shared again, which is water-filling in order of cap / weight.
    The windows without a key run over one row a source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumn("weight", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, total = everything.rowsBetween(Window.unboundedPreceding, -1), everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = share * F.sum("source_size").over(total) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", mass / left).withColumn("full", F.col("level") >= F.col("ratio"))
    last = F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(total)["level"]
    return level.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(last * F.col("weight"))).select("source", "source_size", "n_docs", "target")


def _uniform(seed: int, *parts: int) -> float:
    """A draw in (0, 1) that depends on its arguments alone."""
    h = seed & (2**64 - 1)
    for x in parts:
        h = (h ^ (x & (2**64 - 1))) * 0x9E3779B97F4A7C15 & (2**64 - 1)
        h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
        h ^= h >> 32
    return ((h >> 12) + 0.5) / 2**52


def transfer(a: float, p: float, b: float, q: float, u: float) -> tuple[float, float]:
    """Moves mass between probabilities p and q of sizes a and b until one is 0 or 1; keeps a * p + b * q and both expectations."""
    up, down = min(1 - p, q * b / a), min(p, (1 - q) * b / a)
    if u * (up + down) < down:  # with probability down / (up + down), p grows
        return (1.0, max(0.0, q - (1 - p) * a / b)) if 1 - p <= q * b / a else (p + q * b / a, 0.0)
    return (0.0, min(1.0, q + p * a / b)) if p <= (1 - q) * b / a else (p - (1 - q) * b / a, 1.0)


def _pivot(seed: int, level: int, final: bool):
    """Rounds the rows of each (source, bucket), which come together and in order. final: the residual is rounded too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, held = None, 0, None
        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, mark, source, bucket, size, copies, p = row
                if (source, bucket) != group:
                    if held:
                        done.append(close(held, group, at))
                    group, at, held = (source, bucket), 0, None
                    place = (level, -1 if source is None else zlib.crc32(source.encode()), bucket)
                at += 1
                u = _uniform(seed, *place, at)
                if p <= 0 or p >= 1 or not size:
                    done.append((doc, mark, source, bucket, size, copies + int(p >= 1 or (0 < p and u < p)), 0.0))
                elif held is None:
                    held = row
                else:
                    was, now = transfer(held[4], held[6], size, p, u)
                    old = (*held[:6], was)
                    new = (doc, mark, source, bucket, size, copies, now)
                    held = None
                    for x in (old, new):
                        if 0 < x[6] < 1 and held is None:
                            held = x
                        else:
                            done.append((*x[:5], x[5] + int(x[6] >= 0.5), 0.0))
            yield table(done)
        if held:
            yield table([close(held, group, at)])

    def close(held: tuple, group: tuple, at: int) -> tuple:
        if final:
            return (*held[:5], held[5] + int(_uniform(seed, level, group[1], at, -1) < held[6]), 0.0)
        return held

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=["doc_id", "text_hash", "source", "bucket", "size", "copies", "p"])

    return run


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17) -> DataFrame:
    """Per row of docs: doc_id, text_hash, source, size, source_size, target and how many copies the mix takes."""
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), _size().alias("size")), "mix-sizes")
    targets = written(source_targets(sized, weights, share, cap), "mix-targets")
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    n = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS))
    per_doc = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "text_hash", "source", F.pmod(F.xxhash64("doc_id", "text_hash"), n).cast("long").alias("bucket"), "size", F.floor(per_doc).cast("int").alias("copies"), (per_doc - F.floor(per_doc)).alias("p")
    )
    level, buckets, parts = 0, max(1, -(-most // BUCKET_ROWS)), []
    while True:
        order = ["source", "bucket", F.desc("size"), "doc_id", "text_hash", "copies", "p"]
        rounded = rows.repartition(shuffle_partitions(spark), "source", "bucket").sortWithinPartitions(*order)
        rounded = written(rounded.mapInArrow(_pivot(seed, level, final=buckets == 1), _ROW), f"mix-level{level}")
        parts.append(rounded.filter("p = 0"))
        if buckets == 1:
            break
        level, buckets = level + 1, -(-buckets // FAN_IN)
        rows = rounded.filter("p > 0").withColumn("bucket", F.expr(f"bucket div {FAN_IN}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies")


def mix_sources(docs: DataFrame, into: str = "copy", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its number in a column `into` (from 1).
    Rows that share doc_id and text take one another's places."""
    taken = copies(docs, **options).select("doc_id", "text_hash", "copies")
    names = [c for c in docs.columns if c.lower() != into.lower()]
    repeated = taken.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_list("copies")).alias("__each"))
    joined = docs.withColumn("__own", F.xxhash64("text")).join(repeated, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")))
    once = joined.filter("size(__each) = 1").withColumn("__copies", F.element_at("__each", 1))
    place = F.row_number().over(Window.partitionBy("doc_id", "__own").orderBy("source"))
    many = joined.filter("size(__each) > 1").withColumn("__place", place).withColumn("__copies", F.expr("__each[__place - 1]"))
    both = once.select(*names, "__copies").unionByName(many.select(*names, "__copies")).filter("__copies > 0")
    return both.withColumn(into, F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*names, into)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
