"""Reports on labels and checkers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LOOSE_COMMA = r"[a-z],\s+[a-z ]{4,80},\s+[a-z]"
HYPHEN_FENCE = r"\s-\s[^.;:]+\s-\s"

REPLICATES = 200


def violated(findings: DataFrame) -> DataFrame:
    """A4: the distinct rules with findings, in one sorted list."""
    return findings.agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def supported(rows: DataFrame, order: list[str], least: int = 10) -> DataFrame:
    """Per rule of the taxonomy, in its order: support, and whether it reaches the least; the others are the dropped ones."""
    counts = rows.groupBy("rule").agg(F.count("*").alias("n"))
    listed = rows.sparkSession.createDataFrame(list(enumerate(order)), "place int, rule string")
    return F.broadcast(listed).join(counts, "rule", "left").select("place", "rule", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= least).alias("kept")).orderBy("place")


def totals(rows: DataFrame) -> DataFrame:
    """Per rule its number of labels, the most frequent first, ties by name."""
    return rows.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def random_baseline(rows: DataFrame, n_labels: int) -> DataFrame:
    """The share of set labels among all places of rows(labels)."""
    return rows.agg((F.sum(F.size("labels")) / (F.count("*") * n_labels)).alias("baseline"))


def micro(rows: DataFrame) -> DataFrame:
    """Precision and recall over all rules together, and the rules with a positive, of rows(rule, y, z)."""
    hit = F.sum(F.expr("IF(y = 1 AND z = 1, 1, 0)"))
    return rows.agg((hit / F.expr("nullif(sum(z), 0)")).alias("precision"), (hit / F.expr("nullif(sum(y), 0)")).alias("recall"), F.count_distinct(F.when(F.col("y") == 1, F.col("rule"))).alias("live"))


def _opened(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))


def edit_shape(before: Column, after: Column, dashes: Column) -> Column:
    """What a revision did to a fence. dashes: the number of dash fences before."""
    parens, comma = _opened(after) > _opened(before), before.rlike(LOOSE_COMMA)
    shape = F.when((dashes > 0) & parens, "dash -> parentheses").when(before.rlike(HYPHEN_FENCE) & parens, "spaced hyphens -> parentheses")
    return shape.when(comma & parens, "comma -> parentheses").when(comma & ~after.rlike(LOOSE_COMMA), "comma -> commas dropped").otherwise("something else")


def dash_outcome(before: Column, after: Column, dashes: Column, left: Column) -> Column:
    """What became of dash fences; null where there was none. left: their number after."""
    return F.when(dashes == 0, None).when(left >= dashes, "kept").when(_opened(after) > _opened(before), "parens").otherwise("rewritten")


def firing(rows: DataFrame, spans: str = "spans") -> DataFrame:
    """Comments that fire, and spans in all."""
    n = F.coalesce(F.size(spans), F.lit(0))
    return rows.agg(F.count_if(n > 0).alias("comments"), F.sum(n).alias("spans"))


def split_half(rows: DataFrame, half: Column | None = None, replicates: int = REPLICATES) -> DataFrame:
    """The median and the 5th and 95th percentile of precision over halves of rows(id, y, z), one half a replicate. half: whether a row
    is in the half of replicate r; by hash if none is given. Every row is expanded within its task and summed at once."""
    half = F.pmod(F.xxhash64("id", "r"), F.lit(2)) == 0 if half is None else half
    each = rows.filter("z = 1").select("id", "y", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r")).filter(half)
    shares = each.groupBy("r").agg(F.avg("y").alias("p"))
    return shares.agg(*[F.expr(f"percentile(p, {q})").alias(n) for q, n in ((0.5, "median"), (0.05, "low"), (0.95, "high"))])
