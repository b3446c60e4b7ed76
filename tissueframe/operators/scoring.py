"""Scores of a segmentation against a reference, from the contingency table of their labels.

Tables hold one row per voxel with both labels (``align`` makes them from two label tables); label 0 is background.
``by`` names the columns that tell volumes or configurations apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace
from .graph import components


def align(pred: DataFrame, gt: DataFrame, on: list[str]) -> DataFrame:
    """Voxels of two sparse label tables side by side; what one lacks is background."""
    a, b = pred.withColumnRenamed("label", "pred"), gt.withColumnRenamed("label", "gt")
    return a.join(b, on, "full_outer").withColumns({"pred": F.coalesce("pred", F.lit(0)), "gt": F.coalesce("gt", F.lit(0))})


def label_overlap(voxels: DataFrame, by: list[str]) -> DataFrame:
    """``pred, gt, n, n_pred, n_gt`` and the overlap as a share of each and of both. The voxels are counted once; sizes
    are sums over the few rows of that table."""
    n = voxels.groupBy(*by, "pred", "gt").agg(F.count("*").alias("n"))
    sizes = n.withColumns({"n_pred": F.sum("n").over(W.partitionBy(*by, "pred")), "n_gt": F.sum("n").over(W.partitionBy(*by, "gt"))})
    return sizes.withColumns({
        "pred_in_gt": F.col("n") / F.col("n_pred"), "gt_in_pred": F.col("n") / F.col("n_gt"),
        "jaccard": F.col("n") / (F.col("n_pred") + F.col("n_gt") - F.col("n")),
    })


def best_match(df: DataFrame, key: list[str], value: str, tie: str) -> DataFrame:
    """The row with the greatest value of each key; of equals, that with the least ``tie``."""
    w = W.partitionBy(*key).orderBy(F.desc(value), F.asc(tie))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _references(overlap: DataFrame, by: list[str]) -> DataFrame:
    return overlap.filter("gt <> 0").select(*by, "gt", "n_gt").distinct()


def dice_cells(overlap: DataFrame, by: list[str], threshold: float = 0.3) -> DataFrame:
    """Each reference cell with the target that covers most of it, if more than ``threshold``, and their Dice score;
    0 without one."""
    found = best_match(overlap.filter((F.col("pred") != 0) & (F.col("gt") != 0) & (F.col("gt_in_pred") > threshold)), [*by, "gt"], "gt_in_pred", "pred")
    found = found.select(*by, "gt", "pred", (2 * F.col("n") / (F.col("n_pred") + F.col("n_gt"))).alias("dice"))
    return _references(overlap, by).drop("n_gt").join(found, [*by, "gt"], "left").fillna({"pred": 0, "dice": 0.0})


def dice(overlap: DataFrame, by: list[str], threshold: float = 0.3) -> DataFrame:
    return dice_cells(overlap, by, threshold).groupBy(*by).agg(F.avg("dice").alias("dice"))


def volume_jaccard(overlap: DataFrame, by: list[str]) -> DataFrame:
    """The best Jaccard index of each reference cell, weighted by its volume."""
    found = best_match(overlap.filter("pred <> 0 AND gt <> 0"), [*by, "gt"], "jaccard", "pred").select(*by, "gt", "jaccard")
    cells = _references(overlap, by).join(found, [*by, "gt"], "left").fillna({"jaccard": 0.0})
    return cells.groupBy(*by).agg((F.sum(F.col("jaccard") * F.col("n_gt")) / F.sum("n_gt")).alias("vji"))


def by_prediction(overlap: DataFrame, by: list[str], missing: bool = True) -> DataFrame:
    """Each predicted cell with the reference of the greatest Jaccard index; references that none has taken follow with
    scores of 0 if ``missing``."""
    pairs = overlap.filter("pred <> 0 AND gt <> 0")
    found = best_match(pairs, [*by, "pred"], "jaccard", "gt").withColumn("dice", 2 * F.col("n") / (F.col("n_pred") + F.col("n_gt")))
    found = found.select(*by, "pred", "gt", "n_gt", "jaccard", "dice")
    if not missing:
        return found
    rest = _references(overlap, by).join(found.select(*by, "gt").distinct(), [*by, "gt"], "left_anti")
    return found.unionByName(rest.select(*by, F.lit(0).cast("long").alias("pred"), "gt", "n_gt", F.lit(0.0).alias("jaccard"), F.lit(0.0).alias("dice")))


def jaccard_by_pred(overlap: DataFrame, by: list[str]) -> DataFrame:
    return by_prediction(overlap, by).groupBy(*by).agg(F.avg("jaccard").alias("jaccard"))


def vji_by_pred(overlap: DataFrame, by: list[str]) -> DataFrame:
    return by_prediction(overlap, by).groupBy(*by).agg((F.sum(F.col("jaccard") * F.col("n_gt")) / F.sum("n_gt")).alias("vji"))


def dice_by_pred(overlap: DataFrame, by: list[str]) -> DataFrame:
    return by_prediction(overlap, by, missing=False).groupBy(*by).agg(F.avg("dice").alias("dice"))


def _same(*names: str) -> Column:
    """Whether columns equal those of the same name after two underscores; nulls equal each other."""
    out: Column = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out


def segmentation_states(overlap: DataFrame, by: list[str], background: float = 0.6, least: float = 0.5, work: Workspace | None = None) -> DataFrame:
    """``side, label, state``: for every cell of either segmentation that is associated, the state of its group: correct,
    under_segmented, over_segmented, confused, background (a target on background) or missing (a reference on it).

    Overlaps of at most ``least`` are ignored first, then cells that lie on background by more than ``background`` are
    set apart; of the rest each cell goes with the one that holds most of it, and components of these links are groups.
    """
    sides = {"target": ("pred", "gt", "pred_in_gt"), "reference": ("gt", "pred", "gt_in_pred")}
    links, alone = [], []
    for side, (own, other, share) in sides.items():
        some = overlap.filter((F.col(own) != 0) & (F.col(share) > least))
        bare = some.filter((F.col(other) == 0) & (F.col(share) > background)).select(*by, own)
        alone.append(bare.select(*by, F.lit(side).alias("side"), F.col(own).alias("label"), F.lit("background" if side == "target" else "missing").alias("state")))
        rest = some.filter(F.col(other) != 0).join(bare.select(*[F.col(c).alias(f"__{c}") for c in (*by, own)]), _same(*by, own), "left_anti")
        links.append(best_match(rest, [*by, own], share, other).select(*by, "pred", "gt"))
    links = links[0].unionByName(links[1]).distinct()

    def node(side: str, label: str) -> Column:
        return F.struct(*by, F.lit(side).alias("__side"), F.col(label).alias("__label"))

    edges = links.select(node("l", "pred").alias("u"), node("r", "gt").alias("v"))
    comp = components(edges, work)
    left = links.select(*by, F.lit("target").alias("side"), F.col("pred").alias("label"), node("l", "pred").alias("node")).distinct()
    right = links.select(*by, F.lit("reference").alias("side"), F.col("gt").alias("label"), node("r", "gt").alias("node")).distinct()
    cells = left.unionByName(right).join(comp, "node")
    sizes = cells.groupBy("component").agg(F.sum(F.expr("int(side = 'target')")).alias("t"), F.sum(F.expr("int(side = 'reference')")).alias("r"))
    state = F.expr("CASE WHEN t = 1 AND r = 1 THEN 'correct' WHEN t = 1 THEN 'under_segmented' WHEN r = 1 THEN 'over_segmented' ELSE 'confused' END")
    return cells.join(sizes, "component").select(*by, "side", "label", state.alias("state")).unionByName(alone[0]).unionByName(alone[1])


def segmentation_stats(overlap: DataFrame, by: list[str], background: float = 0.6, least: float = 0.5, ignore_background: bool = True, work: Workspace | None = None) -> DataFrame:
    """Percentages of target cells by state, their number, and the percentage of reference cells that are missing."""
    cells = segmentation_states(overlap, by, background, least, work)
    states = ["correct", "under_segmented", "over_segmented", "confused"] + ["background"] * (not ignore_background)
    named = F.col("state").isin(states) & (F.col("side") == "target")
    total = F.sum(F.when(named, 1).otherwise(0))
    share = lambda s: F.round(100 * F.sum(F.when((F.col("side") == "target") & (F.col("state") == s), 1).otherwise(0)) / total, 2).alias(s)
    missing = 100 * F.sum(F.expr("int(state = 'missing')")) / F.sum(F.expr("int(side = 'reference')"))
    return cells.groupBy(*by).agg(*map(share, states), total.cast("long").alias("total"), F.round(missing, 2).alias("missing"))


def boundary(voxels: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Voxels of a label with a neighbour of another label, or none, among the four in its slice."""
    own = voxels.filter(F.col(label) != 0).select(*by, "x", "y", "z", F.col(label).alias("label"))
    around = own.select(*by, "z", "label", F.explode(F.expr("array(named_struct('x', x+1, 'y', y), named_struct('x', x-1, 'y', y), named_struct('x', x, 'y', y+1), named_struct('x', x, 'y', y-1))")).alias("p"))
    inner = around.select(*by, "z", "label", "p.x", "p.y").groupBy(*by, "x", "y", "z", "label").agg(F.count("*").alias("n")).filter("n = 4")
    return own.join(inner.drop("n"), [*by, "x", "y", "z", "label"], "left_anti")


def boundary_f1(voxels: DataFrame, by: list[str], distance: int = 2) -> DataFrame:
    """Precision, recall and F1 of boundary voxels: those with one of the other segmentation closer than ``distance`` in
    the same slice."""
    sides = {s: boundary(voxels, s, by).select(*by, "x", "y", "z").distinct() for s in ("pred", "gt")}
    near = [(dx, dy) for dx in range(-distance, distance + 1) for dy in range(-distance, distance + 1) if dx * dx + dy * dy < distance * distance]
    shifts = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in near]))

    def rate(a: str, b: str, name: str) -> DataFrame:
        reach = sides[b].withColumn("s", shifts).select(*by, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "z").distinct()
        hit = sides[a].join(reach.withColumn("hit", F.lit(1.0)), [*by, "x", "y", "z"], "left")
        return hit.groupBy(*by).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias(name))

    both = rate("pred", "gt", "precision").join(rate("gt", "pred", "recall"), by)
    return both.withColumn("f1", F.expr("CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END"))


def boundary_f1_cells(voxels: DataFrame, overlap: DataFrame, by: list[str], distance: int = 2) -> DataFrame:
    """Boundary F1 of associated cells, a row for each row of ``by_prediction``: ``gt, n_gt`` and precision, recall and F1
    of the boundary of the reference cell's first predicted cell, 0 where it has none. Voxels of the two boundaries hit
    each other closer than ``distance`` in the same slice."""
    rows = by_prediction(overlap, by).select(*by, "pred", "gt", "n_gt")
    pairs = rows.groupBy(*by, "gt").agg(F.min("pred").alias("pred")).filter("pred <> 0")
    a = boundary(voxels, "pred", by).withColumnRenamed("label", "pred").join(pairs, [*by, "pred"]).select(*by, "gt", "x", "y", "z")
    b = boundary(voxels, "gt", by).withColumnRenamed("label", "gt").join(pairs.select(*by, "gt"), [*by, "gt"]).select(*by, "gt", "x", "y", "z")
    near = [(dx, dy) for dx in range(-distance, distance + 1) for dy in range(-distance, distance + 1) if dx * dx + dy * dy < distance * distance]
    shifts = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in near]))

    def rate(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        reach = other.withColumn("s", shifts).select(*by, "gt", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "z").distinct()
        hit = own.join(reach.withColumn("hit", F.lit(1.0)), [*by, "gt", "x", "y", "z"], "left")
        return hit.groupBy(*by, "gt").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias(name))

    scores = rate(a, b, "precision").join(rate(b, a, "recall"), [*by, "gt"])
    f1 = F.expr("CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END")
    return rows.drop("pred").join(scores.withColumn("f1", f1), [*by, "gt"], "left").fillna(0.0, ["precision", "recall", "f1"])


def boundary_f1_weighted(cells: DataFrame, by: list[str]) -> DataFrame:
    """The mean of ``boundary_f1_cells``, plain and weighted by the reference cells' volumes."""
    return cells.groupBy(*by).agg(F.avg("f1").alias("f1"), (F.sum(F.col("f1") * F.col("n_gt")) / F.sum("n_gt")).alias("f1_weighted"))


def dice_adjusted(quality: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """The quality table with the mean Dice of matched cells only."""
    return quality.join(cells.filter("dice > 0").groupBy(*by).agg(F.avg("dice").alias("dice_adjusted")), by, "left")


def adjust_percent(quality: DataFrame, columns: list[str], reference_cells: int) -> DataFrame:
    """Percentages of predicted cells as shares of a fixed number of reference cells, and the ratio of the two counts."""
    return quality.withColumns({c: F.col(c) * F.col("n_cells") / reference_cells for c in columns} | {"labels_ratio": F.col("n_cells") / reference_cells})


def _first_component(quality: DataFrame, metrics: list[str]):
    """The centred metrics as vectors ``_v``, the model of their first principal component, and the sign that makes a
    greater first metric a better score."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=metrics, outputCol="_raw").transform(quality)
    rows = StandardScaler(inputCol="_raw", outputCol="_v", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=1, inputCol="_v", outputCol="_p").fit(rows)
    return rows, model, 1.0 if model.pc.toArray()[0, 0] >= 0 else -1.0


def quality_score(quality: DataFrame, metrics: list[str], key: str) -> DataFrame:
    """A min-max scaled score from the first principal component of the centred metrics."""
    rows, model, sign = _first_component(quality, metrics)
    scored = model.transform(rows).select(key, (_first("_p") * sign).alias("pc1"))
    ends = scored.agg(F.min("pc1").alias("lo"), F.max("pc1").alias("hi"))
    return scored.join(F.broadcast(ends)).select(key, "pc1", F.expr("CASE WHEN hi > lo THEN (pc1 - lo) / (hi - lo) ELSE 0e0 END").alias("score"))


def quality_loadings(quality: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric, loading, explained, place``: the weights of the first principal component, the share of the variance it
    explains, and the place of each weight by absolute value, of equals by name."""
    _, model, sign = _first_component(quality, metrics)
    rows = sorted(((m, sign * float(w)) for m, w in zip(metrics, model.pc.toArray()[:, 0])), key=lambda r: (-abs(r[1]), r[0]))
    explained = float(model.explainedVariance[0])
    return quality.sparkSession.createDataFrame([(m, w, explained, k + 1) for k, (m, w) in enumerate(rows)], "metric string, loading double, explained double, place long")


def _first(vector: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(vector)[0]
