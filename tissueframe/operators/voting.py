"""From slices to images: votes, pseudo-labels and balanced samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import argmax


def _mix(df: DataFrame, weight: Column, classes: int) -> DataFrame:
    p = F.array(*[F.sum(weight * F.col("probs")[i]) for i in range(classes)])
    out = df.groupBy("id").agg(p.alias("probs"))
    return out.withColumns({"y_pred": argmax(F.col("probs")), "confidence": F.array_max("probs")})


def slice_weights(df: DataFrame) -> DataFrame:
    """Weights of an image's slices: areas scaled from 0 to 1, then to sum to 1; equal weights where all areas are."""
    w = W.partitionBy("id")
    lo, hi, n = F.min("area").over(w), F.max("area").over(w), F.count("*").over(w)
    raw = df.withColumn("weight", F.when(hi > lo, (F.col("area") - lo) / (hi - lo)).otherwise(1 / n))
    return raw.withColumn("weight", F.col("weight") / F.sum("weight").over(w))


def slice_vote(df: DataFrame, classes: int = 3) -> DataFrame:
    """Area-weighted sum of the slices' probabilities. ``df(id, slice, area, probs)``."""
    return _mix(slice_weights(df), F.col("weight"), classes)


def gaussian_vote(df: DataFrame, classes: int = 3) -> DataFrame:
    """Mean of the slices' probabilities, weighted by a bell around the middle slice with a quarter of their number as
    deviation. ``slice`` counts from 0."""
    w = W.partitionBy("id")
    n = F.count("*").over(w)
    d = (F.col("slice") - F.floor(n / 2)) / (n / 4)
    raw = df.withColumn("weight", F.exp(-0.5 * d * d))
    return _mix(raw.withColumn("weight", F.col("weight") / F.sum("weight").over(w)), F.col("weight"), classes)


def _order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def undersample(df: DataFrame, label: str, key: str = "id", seed: int = 42) -> DataFrame:
    """As many rows of each class as the rarest has, in the order of a seeded hash of the key.

    Exact, and without one class's rows meeting in a task: rows are counted by the hash's first digits, ``_cut`` says
    within which prefix a class reaches its number, and only that prefix's rows are ranked.
    """
    rows = df.withColumn("_h", _order(key, seed)).withColumn("_p", F.substring("_h", 1, 4))
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    least = sizes.agg(F.min("_n").alias("_k"))
    by = rows.groupBy(label, "_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(label).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = by.withColumn("_before", before).crossJoin(F.broadcast(least)).filter("_before < _k").withColumn("_room", F.least(F.col("_c"), F.col("_k") - F.col("_before")))
    placed = rows.join(plan.select(label, "_p", "_c", "_room"), [label, "_p"])
    whole = placed.filter("_room = _c")
    part = placed.filter("_room < _c").withColumn("_r", F.row_number().over(W.partitionBy(label, "_p").orderBy("_h", key))).filter("_r <= _room").drop("_r")
    return whole.unionByName(part).drop("_h", "_p", "_c", "_room")


def stratified_split(df: DataFrame, label: str, key: str = "id", test: float = 0.2, valid: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: of each class the first ``test`` by a seeded hash, of the rest the first ``valid``, then train. The
    place in a class is its prefix's offset plus the place within the prefix."""
    rows = df.withColumn("_h", _order(key, seed)).withColumn("_p", F.substring("_h", 1, 4))
    by = rows.groupBy(label, "_p").agg(F.count("*").alias("_c"))
    w = W.partitionBy(label)
    plan = by.withColumns({"_n": F.sum("_c").over(w), "_before": F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    r = F.row_number().over(W.partitionBy(label, "_p").orderBy("_h", key)) + F.col("_before")
    tests = F.floor(F.col("_n") * test)
    valids = F.floor((F.col("_n") - tests) * valid)
    split = F.when(F.col("_r") <= tests, "test").when(F.col("_r") <= tests + valids, "valid").otherwise("train")
    return rows.join(plan.select(label, "_p", "_n", "_before"), [label, "_p"]).withColumn("_r", r).withColumn("split", split).drop("_h", "_p", "_n", "_before", "_r")


def pseudo_labels(slices: DataFrame, threshold: float, iteration: int, balanced: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Images whose vote is surer than max(0.5, threshold - 0.05 iteration), evened out over classes if asked, and the
    slices of all others."""
    sure = gaussian_vote(slices).filter(F.col("confidence") > max(0.5, threshold - 0.05 * iteration))
    picked = undersample(sure, "y_pred", "id", seed) if balanced else sure
    return picked, slices.join(picked.select("id"), "id", "left_anti")


def explode_slices(images: DataFrame) -> DataFrame:
    """One row for each slice of ``images(id, n_slices, probs)``, named id_slice, with the image's soft label."""
    rows = images.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices").cast("int") - 1)))
    return rows.withColumn("name", F.concat_ws("_", "id", "slice"))


def union_labels(*parts: DataFrame) -> DataFrame:
    """Tables below each other; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
