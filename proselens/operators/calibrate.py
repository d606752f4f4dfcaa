"""Thresholds and metrics as aggregates (A9-A18, A23). Scored rows: p, y (0 or 1) and further columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATE_PRECISION, RULE_PRECISION, FALSE_ALARMS = 0.75, 0.5, 0.03
GATE_FALLBACK, RULE_OFF = 0.95, 1.01


def grid(df: DataFrame) -> DataFrame:
    """The 91 cuts from 0.05 to 0.95."""
    return df.sparkSession.range(5, 96).select((F.col("id") / 100).alias("t"))


def realistic(df: DataFrame) -> DataFrame:
    """Revised texts count only where they are positive."""
    return df.filter((F.col("y") == 1) | (F.col("kind") != "after"))


def _curve(df: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """Precision and recall at each cut that is precise enough. A row passes the cuts below its p, so counts per
    cut come from one histogram of rows by their highest cut, summed from above: rows are read once."""
    bucket = F.greatest(F.lit(4), F.least(F.lit(95), F.ceil(F.col("p") * 100 - 1e-9).cast("int") - 1))
    counts = df.groupBy(*keys, bucket.alias("b")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    cuts = counts.select(*keys).distinct().crossJoin(F.broadcast(df.sparkSession.range(4, 96).select(F.col("id").cast("int").alias("b"))))
    above = Window.partitionBy(*keys).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    full = cuts.join(counts, [*keys, "b"], "left").select(*keys, "b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pos", F.lit(0)).alias("pos"))
    full = full.select(*keys, "b", F.sum("n").over(above).alias("fired"), F.sum("pos").over(above).alias("hit"), F.sum("pos").over(everything).alias("all"))
    return full.filter((F.col("b") >= 5) & (F.col("fired") > 0) & (F.col("hit") / F.col("fired") >= least)).select(*keys, (F.col("b") / 100).alias("t"), (F.col("hit") / F.col("all")).alias("recall"))


def gate_cut(df: DataFrame) -> DataFrame:
    """The cut of highest recall among precise ones, the first on ties; 0.95 if there is none. One row."""
    best = _curve(df.withColumn("__all", F.lit(1)), GATE_PRECISION, ["__all"]).agg(F.max_by("t", F.struct("recall", -F.col("t"))).alias("t"))
    return best.select(F.coalesce("t", F.lit(GATE_FALLBACK)).alias("gate_cut"))


def rule_cuts(df: DataFrame, key: str = "rule") -> DataFrame:
    """Per rule, the last cut on ties; 1.01 where no cut is precise or there are no positives."""
    best = _curve(df, RULE_PRECISION, [key]).filter("recall IS NOT NULL AND recall > 0").groupBy(key).agg(F.max_by("t", F.struct("recall", "t")).alias("t"))
    return df.select(key).distinct().join(best, key, "left").select(key, F.coalesce("t", F.lit(RULE_OFF)).alias("rule_cut"))


def scan_cut(df: DataFrame) -> DataFrame:
    """The exact, interpolated quantile of negatives' scores that leaves a share of false alarms."""
    return df.filter("y = 0").agg(F.expr(f"percentile(p, {1 - FALSE_ALARMS})").alias("q")).select(F.coalesce("q", F.lit(GATE_FALLBACK)).alias("scan_cut"))


def auc(df: DataFrame) -> DataFrame:
    """By ranks, ties at their mean, from counts per distinct score."""
    counts = df.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    below = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p1"), F.sum(F.col("n") - F.col("pos")).alias("p0"))
    return total.select(F.when((F.col("p1") > 0) & (F.col("p0") > 0), (F.col("r") - F.col("p1") * (F.col("p1") + 1) / 2) / (F.col("p1") * F.col("p0"))).alias("auc"))


def pos_weights(df: DataFrame, key: str = "rule", cap: float = 20.0) -> DataFrame:
    """A10: negatives to positives, at most the cap; 1 without positives."""
    n = df.groupBy(key).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return n.select(key, F.when(F.col("pos") == 0, F.lit(1.0)).otherwise(F.least(F.col("neg") / F.greatest(F.col("pos"), F.lit(1)), F.lit(cap))).alias("weight"))


def flag_rates(df: DataFrame, cut: float) -> DataFrame:
    """The share above the cut in either class."""
    return df.groupBy("y").agg(F.avg(F.when(F.col("p") > cut, 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("n"))


def confusion(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Counts, precision and recall of each predicate against y, in one pass."""
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(f"{n}_{k}") for k, p in predicates.items() for n, c in (("tp", p & (F.col("y") == 1)), ("fp", p & (F.col("y") == 0)), ("fn", ~p & (F.col("y") == 1)))]
    wide = df.agg(*sums)
    stack = ", ".join(f"'{k}', tp_{k}, fp_{k}, fn_{k}" for k in predicates)
    long = wide.selectExpr(f"stack({len(predicates)}, {stack}) AS (predicate, tp, fp, fn)")
    return long.select("*", F.expr("tp / nullif(tp + fp, 0)").alias("precision"), F.expr("tp / nullif(tp + fn, 0)").alias("recall"))


def hit_rates(df: DataFrame, labels: list[str], ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The share of rows(probs, true) with a true label among the k best, for each k."""
    ranked = F.transform(F.array_sort(F.array(*[F.struct((-F.col("probs")[i]).alias("s"), F.lit(i).alias("i"), F.lit(x).alias("rule")) for i, x in enumerate(labels)])), lambda p: p["rule"])
    return df.agg(*[F.avg(F.when(F.arrays_overlap(F.slice(ranked, 1, k), F.col("true")), 1.0).otherwise(0.0)).alias(f"top_{k}") for k in ks])


def f1(df: DataFrame) -> DataFrame:
    """Micro and macro F1 over rows(rule, y, z), z the prediction."""
    per = df.groupBy("rule").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("tp", F.expr("y = 1 AND z = 1")), ("fp", F.expr("y = 0 AND z = 1")), ("fn", F.expr("y = 1 AND z = 0")))])
    return per.agg(F.expr("2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)").alias("f1_micro"), F.avg(F.expr("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)")).alias("f1_macro"))
