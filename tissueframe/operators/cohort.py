"""Cohort statistics: counts per specimen and stage, regression over stages, depth decay, joins of feature tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace, dealt


def stage_counts(cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """Mean and sample deviation over specimens of their numbers of cells, by stage and level."""
    n = cells.groupBy("specimen", "level").agg(F.count("*").alias("n")).join(catalog, "specimen")
    return n.groupBy("stage", "level").agg(F.count("*").alias("specimens"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"))


def stage_ratio(counts: DataFrame, a: str = "Nuclei", b: str = "Membrane") -> DataFrame:
    """The ratio of the mean numbers of two levels by stage."""
    mean = lambda level: F.max(F.when(F.col("level") == level, F.col("mean")))
    return counts.groupBy("stage").agg((mean(a) / mean(b)).alias("ratio"))


def regression(df: DataFrame, x: str, y: str, order: str, by: list[str]) -> DataFrame:
    """Ordinary least squares of y on x with its usual statistics: R2, adjusted R2, F, standard errors, t, Durbin-Watson
    over rows in ``order`` and Jarque-Bera. Groups with fewer than three rows have null errors. An exact fit, residuals of no
    more than rounding, has errors of 0, and null where they would divide: F, t, Durbin-Watson and Jarque-Bera; a constant
    x has no slope, and so no more than its count."""
    fit = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
    )
    # Residuals below rounding of y are none.
    exact = F.expr("syy * (1 - r2) <= 1e-24 * (n * my * my + syy)")
    fit = fit.withColumn("r2", F.when(exact, F.lit(1.0)).otherwise(F.col("r2")))
    res = df.join(fit, by).filter("r2 < 1 OR r2 IS NULL").withColumn("e", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
    res = res.withColumn("d", F.col("e") - F.lag("e").over(W.partitionBy(*by).orderBy(order)))
    tests = res.groupBy(*by).agg(F.try_divide(F.sum(F.col("d") * F.col("d")), F.sum(F.col("e") * F.col("e"))).alias("durbin_watson"), (F.count("*") / 6 * (F.pow(F.skewness("e"), F.lit(2)) + F.pow(F.kurtosis("e"), F.lit(2)) / 4)).alias("jarque_bera"))
    full = fit.join(tests, by, "left").withColumn("s2", F.when(F.col("n") > 2, F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2)))
    return full.select(
        *by, "n", "slope", "intercept", "r2", F.expr("CASE WHEN n > 2 THEN 1 - (1 - r2) * (n - 1) / (n - 2) END").alias("adjusted_r2"),
        F.expr("CASE WHEN n > 2 THEN try_divide(slope * slope * sxx, s2) END").alias("f"), F.sqrt(F.try_divide("s2", "sxx")).alias("slope_error"),
        F.expr("sqrt(s2 * (1e0 / n + try_divide(mx * mx, sxx)))").alias("intercept_error"), F.expr("try_divide(slope, sqrt(try_divide(s2, sxx)))").alias("t"), "durbin_watson", "jarque_bera",
    )


def class_shares(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count("*").alias("_t")))).select(label, "n", (F.col("n") / F.col("_t")).alias("share"))


def confidence_summary(df: DataFrame, by: list[str], sure: float = 0.9) -> DataFrame:
    """Confidence by class: ends, mean, quartiles, and percentages of correct rows overall and among sure ones."""
    right = F.when(F.col("y_pred") == F.col("y_true"), 1.0).otherwise(0.0)
    q = [F.percentile("confidence", F.lit(p)).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), *q,
        (100 * F.avg(right)).alias("correct"), (100 * F.avg(F.when(F.col("confidence") >= sure, right))).alias("correct_when_sure"),
    )


def overwrite_merge(df: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A left join in which every column of ``new`` replaces one of the same name."""
    return df.drop(*[c for c in new.columns if c not in key]).join(new, key, "left")


# --- depth decay -----------------------------------------------------------------------------------

class Decay(NamedTuple):
    """A model of intensity over depth that is linear in all but the parameters of ``ranges``."""

    names: str
    need: int
    #: Bounds of what is searched for.
    ranges: tuple[tuple[float, float], ...]
    #: (z, z scaled to 0 ... 1, searched) -> the functions whose best combination is the model.
    parts: Callable[[Column, Column, list[Column]], list[Column]]
    #: Whether a constant belongs to the combination.
    level: bool
    #: (factors, searched, least z, span of z) -> the parameters in the order of their names.
    result: Callable[[list[Column], list[Column], Column, Column], list[Column]]


def _falling(t: Column, p: Column) -> Column:
    return F.exp(-F.sinh(p) * t)


def _exponential(f: list[Column], p: list[Column], low: Column, span: Column) -> list[Column]:
    """Factor and rate of each falling part, taken from scaled depth to z."""
    out = []
    for k, q in enumerate(p):
        rate = F.sinh(q) / span
        out += [f[k] * F.exp(rate * low), rate]
    return out


def _gompertz(f: list[Column], p: list[Column], low: Column, span: Column) -> list[Column]:
    rate = F.sinh(p[1]) / span
    return [f[0], F.exp(p[0] - rate * low), rate]


#: Rates are searched as logarithms or inverse hyperbolic sines of their size over the whole depth.
DECAYS = {
    "logistic": Decay("abcd", 5, ((-2.3, 5.3), (-1.0, 2.0)), lambda z, t, p: [1 / (1 + F.exp(F.exp(p[0]) * (t - p[1])))], True, lambda f, p, low, span: [f[0], F.exp(p[0]) / span, low + p[1] * span, f[1]]),
    "exponential": Decay("abc", 3, ((-4.0, 4.0),), lambda z, t, p: [_falling(t, p[0])], True, lambda f, p, low, span: [*_exponential(f, p, low, span), f[1]]),
    "logarithmic": Decay("ab", 3, (), lambda z, t, p: [F.log1p(z)], True, lambda f, p, low, span: [f[1], f[0]]),
    "gompertz": Decay("abc", 3, ((-8.0, 3.0), (-4.0, 4.0)), lambda z, t, p: [F.exp(-F.exp(p[0] + F.sinh(p[1]) * t))], False, _gompertz),
    "biexponential": Decay("abcd", 5, ((-4.0, 4.0), (-4.0, 4.0)), lambda z, t, p: [_falling(t, p[0]), _falling(t, p[1])], False, _exponential),
}

#: Half the number of steps across the bounds, and across the two steps around the best afterwards, by searched parameters.
SEARCH = {0: (0, 0), 1: (200, 20), 2: (24, 12)}
NEAR = 1e-7
#: A move to the edge of a table counts if it takes this share of the error away: valleys without an end are left.
GAIN = 1e-6


def _best_factors(model: Decay, y: Column, parts: list[Column]) -> tuple[list[Column], Callable[[], tuple[Column, list[Column]]]]:
    """Sums over a profile, and from them the squared error left by the best combination of the parts, and its factors."""
    if model.level:
        x = parts[0]
        sums = [F.regr_slope(y, x).alias("__s0"), F.regr_intercept(y, x).alias("__s1"), F.regr_syy(y, x).alias("__s2"), F.regr_sxy(y, x).alias("__s3")]
        return sums, lambda: (F.expr("__s2 - __s0 * __s3"), [F.col("__s0"), F.col("__s1")])
    if len(parts) == 1:
        sums = [F.sum(parts[0] * parts[0]).alias("__s0"), F.sum(parts[0] * y).alias("__s1"), F.sum(y * y).alias("__s2")]
        return sums, lambda: (F.expr("__s2 - try_divide(__s1 * __s1, __s0)"), [F.expr("try_divide(__s1, __s0)")])
    u, v = parts
    sums = [F.sum(a * b).alias(f"__s{k}") for k, (a, b) in enumerate(((u, u), (u, v), (v, v), (u, y), (v, y), (y, y)))]
    det = "(__s0 * __s2 - __s1 * __s1)"
    f = [F.expr(f"try_divide(__s2 * __s3 - __s1 * __s4, {det})"), F.expr(f"try_divide(__s0 * __s4 - __s1 * __s3, {det})")]
    return sums, lambda: (F.col("__s5") - f[0] * F.col("__s3") - f[1] * F.col("__s4"), f)


def decay_fit(profile: DataFrame, by: list[str], model: str = "logistic", value: str = "foreground", rounds: int = 40, work: Workspace | None = None) -> DataFrame:
    """Parameters ``a, b, ...`` of a decay with depth of least squared error for each volume's profile (a row per slice),
    over its finite points, and ``converged``. Fewer than five of them (three for the models of two or three parameters),
    points of one depth alone, or a null key, give null.

    Linear factors follow from sums over the profile. The one or two other parameters are searched for within bounds: a
    table of candidates over all of them, then over two steps around the best, until steps are below 1e-7 of the bounds; a
    round doubles its steps where the best lies on the edge of its table and its error is less by a millionth. ``converged`` is
    false for a volume whose search ends at a bound, as in a profile without such a decay, or hasn't ended after ``rounds``.
    Each round is a written table of a row a volume, which meets the points dealt by volume; candidates are spelled out
    beside the points and leave sums alone. Exponential parts come in the order of their rates."""
    work, m = work or Workspace(profile.sparkSession), DECAYS[model]
    n, (first, later) = len(m.ranges), SEARCH[len(m.ranges)]
    finite = lambda c: F.abs(F.col(c)) < F.lit(math.inf)
    points = profile.select(*by, F.col("z").cast("double").alias("__z"), F.col(value).cast("double").alias("__y")).filter(finite("__z") & finite("__y"))
    ends = points.groupBy(*by).agg(F.min("__z").alias("__low"), (F.max("__z") - F.min("__z")).alias("__span"), F.count("*").alias("__n"))
    points = work.write(points.join(ends.filter((F.col("__n") >= m.need) & (F.col("__span") > 0)), by).withColumn("__t", (F.col("__z") - F.col("__low")) / F.col("__span")))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [F.col(f"__p{k}") for k in range(n)]
    step, active, half = F.col("__step"), points.select(*by, "__low", "__span").distinct(), first
    active = active.select("*", *[F.lit((a + b) / 2).alias(f"__p{k}") for k, (a, b) in enumerate(m.ranges)], F.lit(1 / max(2 * first, 1)).alias("__step"), F.lit(math.inf).alias("__was"))
    ended = []
    for turn in range(rounds if n else 1):
        table = points.repartition(tasks, *by).join(dealt(active.drop("__low", "__span")), by)
        for k, (a, b) in enumerate(m.ranges):
            table = table.withColumn(f"__o{k}", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn(f"__p{k}", at[k] + F.col(f"__o{k}") * step * (b - a)).filter(at[k].between(a, b))
        if len(m.parts(F.lit(0.0), F.lit(0.0), at)) == 2:
            table = table.filter(at[0] < at[1])
        tried = [f"__{c}{k}" for c in "po" for k in range(n)]
        sums, solve = _best_factors(m, F.col("__y"), m.parts(F.col("__z"), F.col("__t"), at))
        sums = table.groupBy(*by, "__low", "__span", "__step", "__was", *tried).agg(*sums)
        error, factors = solve()
        error = F.when(error.isNotNull(), error).otherwise(math.nan)
        best = sums.groupBy(*by, "__low", "__span", "__step", "__was").agg(F.min(F.struct(error.alias("__error"), *tried, *[f.alias(f"__f{k}") for k, f in enumerate(factors)])).alias("__b"))
        edge = reduce(lambda a, b: a | b, [F.abs(F.col(f"__o{k}")) == half for k in range(n)], F.lit(False)) & F.lit(turn > 0) & (F.col("__error") < F.col("__was") * (1 - GAIN))
        found = best.select(*by, "__low", "__span", "__step", "__was", "__b.*").withColumn("__next", F.when(edge, step * 2).otherwise(step * 2 / max(later, 1)))
        rest = (F.col("__next") < NEAR) if n else F.lit(True)
        seen = Observation()
        found = work.write(found.withColumn("__rest", rest).observe(seen, F.coalesce(F.sum((~rest).cast("long")), F.lit(0)).alias("n")))
        ended.append(found if turn == (rounds if n else 1) - 1 else found.filter("__rest"))
        if not seen.get["n"]:
            break
        active, half = found.filter("NOT __rest").select(*by, "__low", "__span", *[f"__p{k}" for k in range(n)], F.col("__next").alias("__step"), F.greatest("__error", F.lit(0.0)).alias("__was")), later
    inside = reduce(lambda a, b: a & b, [at[k].between(a + 1e-6 * (b - a), b - 1e-6 * (b - a)) for k, (a, b) in enumerate(m.ranges)], F.col("__rest"))
    given = m.result([F.col(f"__f{k}") for k in range(2 if m.level else len(m.parts(F.lit(0.0), F.lit(0.0), at)))], at, F.col("__low"), F.col("__span"))
    fits = reduce(DataFrame.unionByName, ended).filter("NOT isnan(__error)").select(*by, *[c.alias(name) for name, c in zip(m.names, given)], inside.alias("converged"))
    return profile.select(*by).distinct().join(fits, by, "left")


# --- configuration grid ----------------------------------------------------------------------------

def step_orders(steps: DataFrame, excluded: list[tuple[str, str]] = ()) -> DataFrame:
    """``place, steps``: every ordered choice of ``steps(step)`` but those that hold an excluded pair, and the choice of
    none, numbered by length and names. Each length joins the steps to the orders one shorter; the table is a dimension
    of as many rows as a handful of steps has orders."""
    fits = lambda c: " AND ".join(["true", *[f"NOT (array_contains({c}, '{a}') AND array_contains({c}, '{b}'))" for a, b in excluded]])
    level = steps.select(F.array("step").alias("steps"))
    out = level.unionByName(steps.sparkSession.createDataFrame([([],)], "steps array<string>"))
    for _ in range(steps.count() - 1):
        level = level.join(steps, ~F.array_contains("steps", F.col("step"))).select(F.concat("steps", F.array("step")).alias("steps")).filter(fits("steps"))
        out = out.unionByName(level)
    return out.withColumn("place", F.row_number().over(W.orderBy(F.size("steps"), F.concat_ws(",", "steps"))) - 1)


def config_grid(first: DataFrame, last: DataFrame, parameters: dict[str, DataFrame], prefix: str) -> DataFrame:
    """All combinations of orders of steps (``place, steps``) before and after, and of one-column parameter tables; rows
    whose names coincide count once. The tables are dimensions of a few rows each."""
    grid = first.select(F.col("place").alias("i"), F.col("steps").alias("before")).crossJoin(last.select(F.col("place").alias("j"), F.col("steps").alias("after")))
    names = []
    for k, df in parameters.items():
        grid = grid.crossJoin(df.select(F.col(df.columns[0]).alias(k)))
        names += [F.lit(k), F.col(k).cast("string")]
    named = grid.withColumn("name", F.concat_ws("_", F.lit(prefix), *names, F.col("i").cast("string"), F.col("j").cast("string")))
    return named.dropDuplicates(["name"])
