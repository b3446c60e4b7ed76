"""Class probabilities: calibration maps, calibration measures, losses and scores over prediction tables.

Probabilities and logits are arrays, ``y_true`` the number of the true class.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import argmax, softmax
from ..workspace import Workspace
from .graph import running_total

EPS = 1e-6


def _each(values: Column, fn) -> Column:
    return F.transform(values, fn)


def temperature(z: Column, t: float | Column) -> Column:
    return softmax(_each(z, lambda v: v / t))


def vector_scaling(z: Column, scale: list[float], bias: list[float]) -> Column:
    return softmax(F.array(*[z[i] * s + b for i, (s, b) in enumerate(zip(scale, bias))]))


def matrix_scaling(z: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """z W + b; ``weights[i][j]`` leads from logit i to class j."""
    n = range(len(bias))
    return softmax(F.array(*[sum((z[i] * weights[i][j] for i in n), F.lit(0.0)) + bias[j] for j in n]))


def dirichlet(p: Column, alpha: list[float]) -> Column:
    """p^softplus(alpha), scaled to sum to 1."""
    import math

    raw = F.array(*[F.pow(p[i], F.lit(math.log1p(math.exp(a)))) for i, a in enumerate(alpha)])
    total = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raw, lambda v: v / total)


def argmax_class(df: DataFrame, probs: str = "probs") -> DataFrame:
    """The first class of the greatest probability, and that probability."""
    return df.withColumns({"y_pred": argmax(F.col(probs)), "confidence": F.array_max(probs)})


def one_hot(y: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == y).cast("double"))


#: The classes of cell division.
CLASSES = ("Prophase/Metaphase", "Anaphase/Telophase", "Interphase")


def class_names(df: DataFrame, label: str = "y_true") -> DataFrame:
    return df.withColumn("class_name", F.element_at(F.array(*map(F.lit, CLASSES)), F.col(label).cast("int") + 1))


def _correct() -> Column:
    return F.when(F.col("y_pred") == F.col("y_true"), 1.0).otherwise(0.0)


def ece(df: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """Expected calibration error over ``bins`` equal bins (lo, hi] of the confidence."""
    rows = argmax_class(df).withColumn("bin", F.ceil(F.col("confidence") * bins) - 1)
    b = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.abs(F.avg(_correct()) - F.avg("confidence")).alias("gap"))
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def reliability_curve(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Share of correct classes and mean confidence in equal bins [lo, hi), the last one closed; empty bins don't occur."""
    rows = argmax_class(df).withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(_correct()).alias("accuracy"), F.avg("confidence").alias("confidence"))


def confidence_histogram(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Share of rows per bin of [0, 1], with the overall mean confidence and accuracy."""
    rows = argmax_class(df)
    total = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("confidence").alias("mean_confidence"), F.avg(_correct()).alias("accuracy"))
    n = rows.groupBy(*by, F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    joined = n.join(total, by) if by else n.crossJoin(F.broadcast(total))
    return joined.withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def nll_brier(df: DataFrame, by: list[str], classes: int = 3) -> DataFrame:
    """Mean negative log-probability of the true class, and the mean over classes of their Brier scores."""
    y = one_hot(F.col("y_true"), classes)
    brier = F.aggregate(F.zip_with(y, "probs", lambda a, p: (a - p) * (a - p)), F.lit(0.0), lambda s, v: s + v) / classes
    nll = -F.log(F.greatest(F.element_at("probs", F.col("y_true").cast("int") + 1), F.lit(1e-15)))
    return df.groupBy(*by).agg(F.avg(nll).alias("nll"), F.avg(brier).alias("brier"))


def confusion_matrix(df: DataFrame, by: list[str]) -> DataFrame:
    rows = argmax_class(df).groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*(by or [F.lit(1)]))))


def classification_report(df: DataFrame, by: list[str], classes: int = 3) -> DataFrame:
    """Precision, recall, F1 and support of each class, 0 where undefined."""
    rows = argmax_class(df).withColumn("class", F.explode(F.array(*[F.lit(c) for c in range(classes)])))
    is_, says = (F.when(F.col(c) == F.col("class"), 1).otherwise(0) for c in ("y_true", "y_pred"))
    n = rows.groupBy(*by, "class").agg(F.sum(is_ * says).alias("tp"), F.sum(says).alias("said"), F.sum(is_).alias("support"))
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0e0 END"
    out = n.withColumns({"precision": F.expr(ratio("tp", "said")), "recall": F.expr(ratio("tp", "support"))})
    return out.withColumn("f1", F.expr(ratio("2 * precision * recall", "(precision + recall)"))).drop("tp", "said")


def multilabel_auc(df: DataFrame, by: list[str], classes: int = 3, work: Workspace | None = None) -> DataFrame:
    """The rank-sum AUC of each class against the rest, ties at their mean rank. Ranks are running totals over the distinct
    scores of a class, in two levels, however the scores are spread."""
    rows = df.select(*by, "y_true", F.posexplode("probs").alias("class", "p"))
    v = rows.groupBy(*by, "class", "p").agg(F.count("*").alias("n"), F.sum(F.when(F.col("y_true") == F.col("class"), 1).otherwise(0)).alias("pos"))
    r = running_total(v, [*by, "class"], ["p"], "n", "__below", work).withColumn("__rank", F.col("__below") + (F.col("n") + 1) / 2)
    r = r.groupBy(*by, "class").agg(F.sum(F.col("__rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return r.select(*by, "class", F.expr("CASE WHEN p > 0 AND p < n THEN (s - p * (p + 1) / 2) / (p * (n - p)) END").alias("auc"))


# --- losses ----------------------------------------------------------------------------------------

def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _totals(df: DataFrame, y: str, classes: int) -> DataFrame:
    return df.agg(F.count("*").alias("_n"), F.array(*[F.sum(F.col(y)[i]) for i in range(classes)]).alias("_t"))


def weighted_ce(df: DataFrame, classes: int = 3, y: str = "y", z: str = "z") -> DataFrame:
    """Weighted cross entropy on logits: positives weigh one over their share of all labels."""
    weight = df.agg((1 / (F.avg(_sum(F.col(y))) / classes + 1e-9)).alias("_w"))
    both = F.arrays_zip(F.col(y).alias("t"), F.col(z).alias("l"))
    part = lambda e: (1 - e["t"]) * e["l"] + (1 + (F.col("_w") - 1) * e["t"]) * (F.log1p(F.exp(-F.abs(e["l"]))) + F.greatest(-e["l"], F.lit(0.0)))
    return df.crossJoin(F.broadcast(weight)).agg(F.avg(_sum(F.transform(both, part)) / classes).alias("weighted_ce"))


def extended_weighted_ce(df: DataFrame, classes: int = 3, y: str = "y", p: str = "probs", logits: bool = False) -> DataFrame:
    """Binary cross entropies with weights total / positives and total / negatives of each class; on probabilities or on
    logits, which go through the sigmoid."""
    rows = df.crossJoin(F.broadcast(_totals(df, y, classes)))
    parts = []
    for i in range(classes):
        t, n = F.col("_t")[i], F.col("_n")
        q = F.col(p)[i] if not logits else 1 / (1 + F.exp(-F.col(p)[i]))
        parts.append(n / (t + EPS) * F.col(y)[i] * F.log(q + EPS) + n / (n - t + EPS) * (1 - F.col(y)[i]) * F.log(1 - q + EPS))
    return rows.agg((-F.avg(sum(parts, F.lit(0.0)) / classes)).alias("extended_ce"))


def multiclass_ce(df: DataFrame, classes: int = 3, y: str = "y", p: str = "probs") -> DataFrame:
    rows = df.crossJoin(F.broadcast(_totals(df, y, classes)))
    total = sum((F.col("_t")[i] for i in range(classes)), F.lit(0.0))
    loss = -sum((F.col(y)[i] * F.log(F.col(p)[i] + EPS) * total / (F.col("_t")[i] + EPS) for i in range(classes)), F.lit(0.0))
    return rows.agg(F.avg(loss).alias("multiclass_ce"))


def soft_ce(df: DataFrame, classes: int = 3, y: str = "y", p: str = "probs") -> DataFrame:
    """Cross entropy of soft labels, times the sum of the class weights max(total) / total, averaged."""
    weights = df.agg(F.array(*[F.sum(F.col(y)[i]) for i in range(classes)]).alias("_t"))
    w = sum((F.array_max("_t") / (F.col("_t")[i] + EPS) for i in range(classes)), F.lit(0.0))
    scaled = _sum(F.col(p))
    loss = -sum((F.col(y)[i] * F.log(F.greatest(F.least(F.col(p)[i] / scaled, F.lit(1 - 1e-7)), F.lit(1e-7))) for i in range(classes)), F.lit(0.0))
    return df.crossJoin(F.broadcast(weights)).agg(F.avg(w * loss).alias("soft_ce"))


def focal_loss(df: DataFrame, classes: int = 3, gamma: float = 2.0, alpha: float = 0.25, y: str = "y", p: str = "probs") -> DataFrame:
    parts = []
    for i in range(classes):
        t, q = F.col(y)[i], F.greatest(F.least(F.col(p)[i], F.lit(1 - 1e-7)), F.lit(1e-7))
        pt = t * q + (1 - t) * (1 - q)
        parts.append(-(t * alpha + (1 - t) * (1 - alpha)) * F.pow(1 - pt, F.lit(gamma)) * F.log(pt))
    return df.agg(F.avg(sum(parts, F.lit(0.0)) / classes).alias("focal_loss"))


def lse_pool(df: DataFrame, key: list[str], value: str, r: float = 10.0) -> DataFrame:
    """max + log(mean(exp(r (x - max)))) / r of each group."""
    top = df.groupBy(*key).agg(F.max(value).alias("_m"))
    e = df.join(top, key).groupBy(*key).agg(F.first("_m").alias("_m"), F.avg(F.exp(r * (F.col(value) - F.col("_m")))).alias("_e"))
    return e.select(*key, (F.col("_m") + F.log("_e") / r).alias("lse"))


# --- fits ------------------------------------------------------------------------------------------

def fit_temperature(df: DataFrame, grid: list[float], z: str = "z") -> DataFrame:
    """The temperature of the grid with the least negative log-likelihood, the lower on ties; one pass over the rows."""
    top = F.array_max(z)

    def loss(t: float) -> Column:
        return F.avg(F.log(_sum(F.transform(z, lambda v: F.exp((v - top) / t)))) - (F.element_at(z, F.col("y_true").cast("int") + 1) - top) / t)

    row = df.agg(F.array(*map(loss, grid)).alias("nll"))
    at = F.array_position("nll", F.array_min("nll")).cast("int")
    return row.select(F.element_at(F.array(*map(F.lit, grid)), at).alias("temperature"), F.array_min("nll").alias("nll"))


def fit_vector(df: DataFrame, z: str = "z", classes: int = 3, bias: bool = True, rounds: int = 50, ridge: float = 1e-3) -> tuple[list[float], list[float]]:
    """Scales and biases of vector scaling, softmax(s z + b), of least mean negative log-likelihood plus ``ridge`` / 2 times
    their squares (scales measured from 1), by Newton steps. The loss is convex; each step is one aggregation of a
    gradient and a curvature with a few dozen numbers, halved until the loss falls. The rows are written once and read by
    all steps; a warning tells if the steps haven't come to rest after ``rounds``."""
    import numpy as np

    df = Workspace(df.sparkSession).write(df.select(z, "y_true"))

    n = classes * (2 if bias else 1)
    at = np.concatenate([np.ones(classes), np.zeros(n - classes)])
    home = at.copy()
    y, feature = F.col("y_true").cast("int"), [F.col(z)[i] for i in range(classes)] + [F.lit(1.0)] * (n - classes)

    def look(w: np.ndarray, slopes: bool) -> tuple[float, np.ndarray | None, np.ndarray | None]:
        p = softmax(F.array(*[F.col(z)[i] * float(w[i]) + (float(w[classes + i]) if bias else 0.0) for i in range(classes)]))
        rows = df.select(p.alias("p"), F.col(z), "y_true")
        out = [F.avg(-F.log(F.greatest(F.element_at("p", y + 1), F.lit(1e-300))))]
        pairs = [(a, b) for a in range(n) for b in range(a, n)]
        if slopes:
            of = [F.col("p")[a % classes] for a in range(n)]
            out += [F.avg((of[a] - (y == a % classes).cast("double")) * feature[a]) for a in range(n)]
            out += [F.avg((of[a] * (1.0 if a % classes == b % classes else 0.0) - of[a] * of[b]) * feature[a] * feature[b]) for a, b in pairs]
        row = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(out)]).first()
        loss = row[0] + ridge / 2 * float(((w - home) ** 2).sum())
        if not slopes:
            return loss, None, None
        h = np.zeros((n, n))
        for (a, b), v in zip(pairs, row[n + 1 :]):
            h[a, b] = h[b, a] = v
        return loss, np.array(row[1 : n + 1]) + ridge * (w - home), h + ridge * np.eye(n)

    if df.isEmpty():
        return at[:classes].tolist(), at[classes:].tolist() or [0.0] * classes
    for _ in range(rounds):
        loss, g, h = look(at, True)
        step, size = np.linalg.solve(h, g), 1.0
        while np.abs(step).max() * size > 1e-8 and look(at - size * step, False)[0] > loss:
            size /= 2
        at = at - size * step
        if np.abs(step).max() * size < 1e-7:
            break
    else:
        warnings.warn(f"vector scaling hasn't come to rest after {rounds} steps", RuntimeWarning, stacklevel=2)
    return at[:classes].tolist(), at[classes:].tolist() or [0.0] * classes


def fit_dirichlet(df: DataFrame, probs: str = "probs", classes: int = 3) -> list[float]:
    """The alphas of ``dirichlet``: p^softplus(alpha) scaled to 1 is vector scaling of log p without biases, with scales
    that are softplus(alpha); a scale of 0 or less counts as 1e-6."""
    import math

    logs = df.select(F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(1e-12)))).alias("z"), "y_true")
    scales, _ = fit_vector(logs, "z", classes, bias=False)
    return [s + math.log(-math.expm1(-s)) for s in (max(s, 1e-6) for s in scales)]


def fit_matrix(df: DataFrame, probs: str = "probs", rounds: int = 100) -> DataFrame:
    """Weights and biases of matrix scaling, by multinomial logistic regression on log-probabilities: a row per class. A
    warning tells if it hasn't come to rest after ``rounds`` steps."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(1e-12))))).alias("features"), F.col("y_true").cast("double").alias("label"))
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=rounds).fit(rows)
    if model.summary.totalIterations >= rounds:
        warnings.warn(f"matrix scaling hasn't come to rest after {rounds} steps", RuntimeWarning, stacklevel=2)
    out = [(k, [float(x) for x in w], float(b)) for k, (w, b) in enumerate(zip(model.coefficientMatrix.toArray(), model.interceptVector.toArray()))]
    return df.sparkSession.createDataFrame(out, "class int, weights array<double>, bias double")


def calibration_table(df: DataFrame, methods: dict[str, Column], classes: int = 3) -> DataFrame:
    """ECE, NLL, Brier score and mean AUC of each method: the probabilities of all methods side by side in one table."""
    rows = df.select("y_true", F.explode(F.array(*[F.struct(F.lit(k).alias("method"), c.alias("probs")) for k, c in methods.items()])).alias("m")).select("y_true", "m.*")
    auc = multilabel_auc(rows, ["method"], classes).groupBy("method").agg(F.avg("auc").alias("auc"))
    return ece(rows, ["method"]).join(nll_brier(rows, ["method"], classes), "method").join(auc, "method")
