"""Training rows and what training leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CLEAN = 2500
#: Shares of the pool that calibrate and test, in hundredths.
CALIBRATE, TEST = 15, 15


def known(labels: Column, ids: list[str]) -> Column:
    """The labels that are trained, in their own order."""
    return F.filter(F.array(*[F.lit(x) for x in ids]), lambda x: F.coalesce(F.array_contains(labels, x), F.lit(False)))


def examples(pairs: DataFrame, clean: DataFrame, ids: list[str], key: str, most_clean: int = MAX_CLEAN, seed: int = 0) -> DataFrame:
    """Key, text, labels, labels_eval, eval_ok and kind. A labelled pair gives its text before, with the labels, and after, without
    any; an unlabelled pair gives nothing, as its text was edited for some reason; clean(key, text) gives at most
    most_clean rows without labels, chosen by hash. Where labelers conflict, or agree on no label, a row is not evaluated."""
    own, agreed, none = known(F.col("labels"), ids), known(F.coalesce("labels_agreed", "labels"), ids), F.array().cast("array<string>")
    sure = (F.coalesce("agreement", F.lit("full")) != "conflict") & (F.size("__agreed") > 0)
    row = lambda text, labels, evaluated, ok, kind: F.struct(text.alias("text"), labels.alias("labels"), evaluated.alias("labels_eval"), ok.alias("eval_ok"), F.lit(kind).alias("kind"))
    both = F.array(row(F.col("before"), F.col("__own"), F.col("__agreed"), sure, "before"), row(F.col("after"), none, none, F.lit(True), "after"))
    labelled = pairs.withColumns({"__own": own, "__agreed": agreed}).filter("size(__own) > 0").select(key, F.explode(both).alias("r")).select(key, "r.*")
    kept = clean.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(most_clean)
    return labelled.unionByName(kept.select(key, "text", none.alias("labels"), none.alias("labels_eval"), F.lit(True).alias("eval_ok"), F.lit("clean").alias("kind")))


def three_way(rows: DataFrame, place: Column) -> DataFrame:
    """Rows with split and the labels that hold there. place: 0 to 99, evenly. Rows that are not evaluated only train; training takes
    the union of labels, calibration and test what labelers agreed on."""
    held = F.col("eval_ok") & (place < CALIBRATE + TEST)
    split = F.when(~held, "train").when(place < CALIBRATE, "calib").otherwise("test")
    return rows.withColumn("split", split).withColumn("labels", F.when(F.col("split") == "train", F.col("labels")).otherwise(F.col("labels_eval")))


def coverage(ids: list[str], cuts: dict[str, float], trained: list[str], gate: float, scan: float, auc: float) -> dict:
    """What a model covers and its cuts, as one small JSON object."""
    off = sorted(r for r in trained if cuts.get(r, 1.01) > 1)
    return {"rules": ids, "trained": trained, "untrained": [r for r in ids if r not in trained], "silent": off, "thresholds": {r: cuts[r] for r in trained if r not in off} | {"__gate__": gate, "__scan__": scan}, "gate_auc": auc}


def coverage_report(found: dict) -> list[str]:
    """The same for a reader."""
    lines = [f"{len(found['trained'])} of {len(found['rules'])} rules trained, gate AUC {found['gate_auc']:.3f}, cuts {found['thresholds']['__gate__']:.2f} (one comment) and {found['thresholds']['__scan__']:.2f} (scan)"]
    lines += [f"  {r}: {'not trained' if r in found['untrained'] else 'never fires' if r in found['silent'] else f'cut {found["thresholds"][r]:.2f}'}" for r in found["rules"]]
    return lines
