"""Voxel volumes as rows: one row per voxel with integer x, y, z, grouped by the columns ``by``.

Box-shaped and ball-shaped neighbourhoods are windows along one axis after the other, which multiply no rows. Volumes are dense where it says so: a row for each voxel of the frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace, dealt

AXES = ("x", "y", "z")


def crop(df: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """Voxels in the half-open box; a plain filter, so it reaches a Parquet scan."""
    for axis, (lo, hi) in box.items():
        df = df.filter((F.col(axis) >= lo) & (F.col(axis) < hi))
    return df


def restore(df: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """Coordinates of a crop in the full frame."""
    return df.withColumns({axis: F.col(axis) + lo for axis, (lo, _) in box.items()})


def restore_dense(df: DataFrame, box: dict[str, tuple[int, int]], frame: DataFrame, value: str, by: list[str]) -> DataFrame:
    """A crop in its place, 0 in the rest of the frame."""
    return frame.join(restore(df, box), [*by, *AXES], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def _padded(df: DataFrame, group: list[str], margin: int, resolution: int, z_size: Column) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    ends = df.groupBy(*group).agg(*[F.min(a).alias(f"{a}0") for a in AXES], *[F.max(a).alias(f"{a}1") for a in AXES])
    lo = {f"{a}0": F.greatest(F.col(f"{a}0") - margin, F.lit(0)) for a in AXES}
    hi = {f"{a}1": F.least(F.col(f"{a}1") + margin, F.lit(resolution)) for a in AXES}
    return ends, lo, hi | {"z1": F.least(hi["z1"] + margin, z_size)}


def tissue_box(tissue: DataFrame, by: list[str], codes: list[int] | None = None, margin: int = 10, resolution: int = 1024, sizes: DataFrame | None = None) -> DataFrame:
    """Padded bounds of the voxels of some tissue codes (any but 0 without a list). The upper z bound is padded twice and
    clamped to the volume's depth, as the method has it. ``sizes(by, z_size)`` default to the deepest voxel."""
    own = tissue.filter(F.col("tissue").isin(codes) if codes else F.col("tissue") > 0)
    sizes = sizes if sizes is not None else tissue.groupBy(*by).agg((F.max("z") + 1).alias("z_size"))
    ends, lo, hi = _padded(own, by, margin, resolution, F.col("z_size"))
    return ends.join(sizes, by).withColumns(lo | hi).drop("z_size")


def cell_box(labels: DataFrame, by: list[str], label: str, margin: int = 5, resolution: int = 1024, sizes: DataFrame | None = None) -> DataFrame:
    """The padded bounds of every cell, in one aggregation."""
    sizes = sizes if sizes is not None else labels.groupBy(*by).agg((F.max("z") + 1).alias("z_size"))
    ends, lo, hi = _padded(labels.filter(F.col(label) != 0), [*by, label], margin, resolution, F.col("z_size"))
    return ends.join(sizes, by).withColumns(lo | hi).drop("z_size")


def permute_axes(df: DataFrame, order: str) -> DataFrame:
    """Axes of an array in another order: the n-th letter names the old axis that becomes the n-th new one."""
    new = {a: F.col(o.lower()) for a, o in zip(AXES, order)}
    return df.withColumns(new)


def physical_coords(df: DataFrame, meta: DataFrame, by: list[str]) -> DataFrame:
    return df.join(meta, by).withColumns({f"p{a}": F.col(a) * F.col(f"{a}_res") for a in AXES})


def update_affine(affine: Column, old: list[Column], new: list[Column]) -> Column:
    """A 4 x 4 affine (array of rows) for other resolutions: the first three columns of its first three rows times
    new / old; a null one counts as the identity."""
    one = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(4)]) for i in range(4)])
    scale = F.array(*[n / o for o, n in zip(old, new)], F.lit(1.0))
    return F.transform(F.coalesce(affine, one), lambda row, i: F.when(i < 3, F.zip_with(row, scale, lambda v, f: v * f)).otherwise(row))


def halved(meta: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Metadata (``x_size``, ``x_res``, ..., ``affine``) of a volume after ``downsample_half``. Along x and y alone sizes
    halve and resolutions double; the isotropic form, along all axes, halves the resolutions, as the method has it."""
    by = 0.5 if set(axes) == set(AXES) else 2.0
    new = {f"{a}_res": F.col(f"{a}_res") * by for a in axes} | {f"{a}_size": F.floor(F.col(f"{a}_size") / 2) for a in axes}
    old = [F.col(f"{a}_res") for a in AXES]
    return meta.withColumns(new | {"affine": update_affine(F.col("affine"), old, [F.col(f"{a}_res") * (by if a in axes else 1.0) for a in AXES])})


def attenuate(df: DataFrame, by: list[str], axis: str = "x", value: str = "intensity") -> DataFrame:
    """Fades a volume along an axis by exp(-3 position), position from 0 to 1."""
    last = df.groupBy(*by).agg(F.max(axis).alias("_last"))
    return df.join(last, by).withColumn(value, F.col(value) * F.exp(-3.0 * F.col(axis) / F.greatest(F.col("_last"), F.lit(1)))).drop("_last")


def channel_stack(a: DataFrame, b: DataFrame, on: list[str], names: tuple[str, str]) -> DataFrame:
    """Two channels side by side, 0 where one is absent."""
    both = a.withColumnRenamed("intensity", names[0]).join(b.withColumnRenamed("intensity", names[1]), on, "full_outer")
    return both.fillna(0.0, list(names))


def rescale_slices(df: DataFrame, by: list[str], value: str = "intensity") -> DataFrame:
    w = W.partitionBy(*by, "z")
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(value, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0))


#: Values that one window ranks at most; steps of a sketch by which a bracket around a rank narrows.
RANKED, STEPS = 1 << 16, 256


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], work: Workspace | None = None, most: int = RANKED) -> DataFrame:
    """``by`` and exact percentiles, interpolated linearly, by name. Each wanted rank has a bracket of values, at first all
    of its group. While one holds more than ``most`` distinct values, a sketch of its own values cuts it to a few of
    ``STEPS`` parts, wherever these lie, so outliers and ties don't keep it wide; then the values inside are ranked.
    Nulls don't count; without a value a percentile is null."""
    work, keys = work or Workspace(df.sparkSession), [F.col(k) for k in by]
    one = [] if by else [F.lit(1).alias("__all")]
    group = [*by] if by else ["__all"]
    some = df.filter(F.col(value).isNotNull()).select(*keys, *one, F.col(value).cast("double").alias("__x"))
    ends = work.write(some.groupBy(*group).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count("*").alias("__m"), F.approx_count_distinct("__x").alias("__d")))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("__m") - 1)).alias("r")) for name, q in shares.items()]))
    state = ends.select(*group, asked.alias("q"), "__lo", "__hi", F.lit(0).cast("long").alias("__below"), "__m", "__d").select(*group, "q.*", "__lo", "__hi", "__below", "__m", "__d")
    inside = lambda s: some.join(F.broadcast(s) if not by else s, group).filter("__x BETWEEN __lo AND __hi")
    widest = state.agg(F.max("__d")).first()[0] or 0
    while widest > most:
        grid = F.percentile_approx("__x", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), F.lit(100 * STEPS)).alias("__g")
        cut = inside(state.drop("__m", "__d")).groupBy(*group, "name", "r", "__lo", "__hi", "__below").agg(grid, F.count("*").alias("__m"))
        place = lambda add, extra: F.expr(f"int(least(greatest(floor((r - __below + {add}) / __m * {STEPS}) + {extra}, 0), {STEPS}))")
        lo = F.when(place(0, -1) > 0, F.get("__g", place(0, -1))).otherwise(F.col("__lo"))
        hi = F.when(place(2, 2) < STEPS, F.get("__g", place(2, 2))).otherwise(F.col("__hi"))
        cut = work.write(cut.select(*group, "name", "r", lo.alias("__lo2"), hi.alias("__hi2"), F.col("__lo"), F.col("__hi"), "__below"))
        held = F.col("__x").between(F.col("__lo2"), F.col("__hi2"))
        told = inside(cut).groupBy(*group, "name", "r", "__lo2", "__hi2", "__below").agg(F.sum(F.expr("int(__x < __lo2)")).alias("__less"), F.sum(held.cast("int")).alias("__m"), F.approx_count_distinct(F.when(held, F.col("__x"))).alias("__d"))
        state = work.write(told.select(*group, "name", "r", F.col("__lo2").alias("__lo"), F.col("__hi2").alias("__hi"), (F.col("__below") + F.col("__less")).alias("__below"), "__m", "__d"))
        before, widest = widest, state.agg(F.max("__d")).first()[0]
        if widest > 0.9 * before:
            break
    each = inside(state.select(*group, "name", "r", "__lo", "__hi", "__below")).groupBy(*group, "name", "r", "__below", "__x").agg(F.count("*").alias("__c"))
    upto = F.col("__below") + F.sum("__c").over(W.partitionBy(*group, "name").orderBy("__x"))
    each = each.withColumn("__to", upto).filter("__to > floor(r) AND __to - __c <= ceil(r)")
    both = each.groupBy(*group, "name", "r").agg(F.min("__x").alias("__a"), F.max("__x").alias("__b"))
    return both.groupBy(*group).agg(*[F.max(F.when(F.col("name") == n, F.expr("__a + (r - floor(r)) * (__b - __a)"))).alias(n) for n in shares]).select(*by, *shares)


def percentile_normalize(df: DataFrame, by: list[str], low: float, high: float, clip: bool = True, value: str = "intensity") -> DataFrame:
    """Scales so that two exact percentiles of each volume become 0 and 1."""
    ends = percentiles(df, by, value, {"_lo": low / 100, "_hi": high / 100})
    out = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.join(ends, by).withColumn(value, F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)) if clip else out).drop("_lo", "_hi")


def equalize_hist(df: DataFrame, by: list[str], bins: int = 256, value: str = "intensity") -> DataFrame:
    """The cumulative histogram of each volume, interpolated between bin centres, as transfer function."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    rows = df.join(ends, by).withColumn("_p", F.expr(f"CASE WHEN _hi > _lo THEN ({value} - _lo) / (_hi - _lo) * {bins} ELSE 0e0 END"))
    counts = rows.groupBy(*by, F.least(F.floor("_p"), F.lit(bins - 1)).alias("_b")).agg(F.count("*").alias("c"))
    every = ends.select(*by, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("_b"))
    w = W.partitionBy(*by).orderBy("_b")
    cdf = every.join(counts, [*by, "_b"], "left").withColumn("_c", F.sum(F.coalesce("c", F.lit(0))).over(w) / F.col("_n"))
    cdf = cdf.withColumn("_d", F.lead("_c", 1).over(w)).select(*by, "_b", "_c", F.coalesce("_d", "_c").alias("_d"))
    at = F.expr(f"least(greatest(_p - 5e-1, 0e0), {bins - 1}e0)")
    placed = rows.withColumn("_q", at).withColumn("_b", F.floor("_q"))
    out = placed.join(cdf, [*by, "_b"]).withColumn(value, F.expr("_c + (_q - _b) * (_d - _c)"))
    return out.select(df.columns)


def z_profile(df: DataFrame, by: list[str], mask: Column, value: str = "intensity") -> DataFrame:
    return df.groupBy(*by, "z").agg(F.avg(F.when(mask, F.col(value))).alias("foreground"), F.avg(F.when(~mask, F.col(value))).alias("background"))


def z_profile_nomask(df: DataFrame, by: list[str], value: str = "intensity") -> DataFrame:
    """Foreground is what exceeds mean + 3 deviations of its slice, or reaches its greatest value if that is less."""
    stats = df.groupBy(*by, "z").agg(F.least(F.max(value), F.avg(value) + 3 * F.stddev_pop(value)).alias("_t"))
    return z_profile(df.join(stats, [*by, "z"]), by, F.col(value) >= F.col("_t"), value)


def iqr_slice_filter(df: DataFrame, cell: list[str], value: str = "intensity") -> DataFrame:
    """Drops slices of a cell whose mean doesn't exceed p35 - (p95 - p35) / 10 of the means of its slices."""
    means = df.groupBy(*cell, "z").agg(F.avg(value).alias("_m"))
    ends = means.groupBy(*cell).agg(F.percentile("_m", F.lit(0.35)).alias("_a"), F.percentile("_m", F.lit(0.95)).alias("_b"))
    good = means.join(ends, cell).filter("_m > _a - 0.1 * (_b - _a)").select(*cell, "z")
    return df.join(good, [*cell, "z"], "left_semi")


def dim_stack_filter(df: DataFrame, cell: list[str], least: float, value: str = "intensity") -> DataFrame:
    """Drops cells whose mean is below ``least``."""
    return df.join(df.groupBy(*cell).agg(F.avg(value).alias("_m")).filter(F.col("_m") < least), cell, "left_anti")


def stack_means(df: DataFrame, cell: list[str], value: str = "intensity") -> DataFrame:
    return df.groupBy(*cell).agg(F.avg(value).alias("mean"))


def mean_histogram(df: DataFrame, cell: list[str], bins: int = 100, value: str = "intensity") -> DataFrame:
    """How many stacks have their mean in each of ``bins`` equal bins between the least and the greatest; empty bins don't
    occur."""
    means = stack_means(df, cell, value)
    ends = means.agg(F.min("mean").alias("_lo"), F.max("mean").alias("_hi"))
    at = F.expr(f"CASE WHEN _hi > _lo THEN least(floor((mean - _lo) / (_hi - _lo) * {bins}), {bins - 1}) ELSE 0 END").cast("long")
    return means.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def resample_nearest(df: DataFrame, by: list[str], scale: dict[str, float], value: str) -> DataFrame:
    """A grid of round(n scale) voxels along each axis, each with the value of the nearest old one; dense volumes. Each old
    voxel names the new ones that are nearest to it, so a frame that is mostly empty isn't spelled out."""
    sizes = df.groupBy(*by).agg(*[(F.max(a) + 1).alias(f"_n{a}") for a in AXES])
    sizes = sizes.withColumns({f"_m{a}": F.greatest(F.bround(F.col(f"_n{a}") * F.lit(scale.get(a, 1.0))).cast("long"), F.lit(1)) for a in AXES})
    out = df.select(*by, *AXES, value).join(F.broadcast(sizes), by)
    for a in AXES:
        # Bounds by division, a place wider on either side, and then the places that fall on the voxel.
        first = f"least(greatest(floor({a} * _m{a} / greatest(_n{a}, 1) - 15e-1), 0), _m{a} - 1)"
        last = f"least(greatest(ceil(({a} + 1) * _m{a} / greatest(_n{a}, 1) + 5e-1), 0), _m{a} - 1)"
        nearest = F.expr(f"filter(sequence({first}, {last}), t -> least(floor((t + 5e-1) * _n{a} / _m{a}), _n{a} - 1) = {a})")
        out = out.withColumn(f"_t{a}", F.explode(nearest))
    return out.select(*by, *[F.col(f"_t{a}").alias(a) for a in AXES], value)


def downsample_half(df: DataFrame, by: list[str], value: str = "intensity", axes: tuple[str, ...] = AXES) -> DataFrame:
    """Half as many voxels along each axis, by linear interpolation between corner-aligned grids; dense volumes. Each old
    voxel adds to the at most two new ones it lies next to along an axis."""
    out = df
    for a in axes:
        ends = out.groupBy(*by).agg((F.max(a) + 1).alias("_n"))
        ends = ends.withColumn("_m", F.greatest(F.floor(F.col("_n") / 2), F.lit(1))).withColumn("_s", F.expr("CASE WHEN _m > 1 THEN (_n - 1) / (_m - 1) ELSE 0e0 END"))
        need = ends.select(*by, "_s", "_n", F.explode(F.expr("sequence(0L, _m - 1)")).alias("_t"))
        need = need.withColumn("_p", F.expr("_t * _s")).withColumn("_f", F.expr("least(floor(_p), _n - 1)"))
        need = need.select(*by, "_t", F.explode(F.expr("array(named_struct('v', _f, 'w', 1 - (_p - _f)), named_struct('v', least(_f + 1, _n - 1), 'w', _p - _f))")).alias("e"))
        need = need.select(*by, "_t", F.col("e.v").alias(a), F.col("e.w").alias("_w")).filter("_w > 0")
        rest = [x for x in AXES if x != a]
        out = out.join(need, [*by, a]).groupBy(*by, *rest, F.col("_t").alias(a)).agg(F.sum(F.col(value) * F.col("_w")).alias(value))
    return out.select(*by, *AXES, value)


def _slide(df: DataFrame, by: list[str], value: str, radius: int, fn, axes: tuple[str, ...]) -> DataFrame:
    for a in axes:
        w = W.partitionBy(*by, *[x for x in AXES if x != a]).orderBy(a).rangeBetween(-radius, radius)
        df = df.withColumn(value, fn(value).over(w))
    return df


def dilate(df: DataFrame, by: list[str], value: str, size: int = 3, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Greatest value in a box of ``size``, as running windows along each axis; what lies outside the frame doesn't
    count. Dense volumes."""
    return _slide(df, by, value, size // 2, F.max, axes)


def erode(df: DataFrame, by: list[str], value: str, size: int = 3, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    return _slide(df, by, value, size // 2, F.min, axes)


def opening(df: DataFrame, by: list[str], value: str, size: int = 3, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    return dilate(erode(df, by, value, size, axes), by, value, size, axes)


def closing(df: DataFrame, by: list[str], value: str, size: int = 3, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    return erode(dilate(df, by, value, size, axes), by, value, size, axes)


def over_ball(df: DataFrame, by: list[str], value: str, radius: int, kind: str) -> DataFrame:
    """``df`` with ``value`` the ``kind`` (max, min or sum) of it over the voxels of the table within ``radius``. A ball is a
    run along x for each (dy, dz): windows along x make the runs of every half width, windows along y put the runs of a
    disc together for each dz, windows along z the discs. No row is multiplied. A run counts where the voxel in its middle
    has a row, as all have in dense volumes."""
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[kind]
    half = {(dy, dz): math.isqrt(radius * radius - dy * dy - dz * dz) for dy in range(-radius, radius + 1) for dz in range(radius + 1) if dy * dy + dz * dz <= radius * radius}

    def joined(parts: list[Column]) -> Column:
        if len(parts) == 1:
            return parts[0]
        if kind == "sum":
            out = F.coalesce(parts[0], F.lit(0))
            for p in parts[1:]:
                out = out + F.coalesce(p, F.lit(0))
            return out
        return (F.greatest if kind == "max" else F.least)(*parts)

    def along(axis: str) -> W:
        return W.partitionBy(*by, *[a for a in AXES if a != axis]).orderBy(axis)

    out = df.select("*", *[agg(value).over(along("x").rangeBetween(-h, h)).alias(f"__m{h}") for h in sorted(set(half.values()))])
    out = out.select(*df.columns, *[joined([F.max(f"__m{h}").over(along("y").rangeBetween(dy, dy)) for (dy, z), h in half.items() if z == dz]).alias(f"__d{dz}") for dz in range(radius + 1)])
    return out.withColumn(value, joined([F.max(f"__d{abs(dz)}").over(along("z").rangeBetween(dz, dz)) for dz in range(-radius, radius + 1)])).select(df.columns)


def _holes(df: DataFrame, by: list[str]) -> DataFrame:
    """The places inside each volume's bounds without a row; only lines along x that lack some are spelled out."""
    ends = df.groupBy(*by).agg(*[f(a).alias(f"__{n}{a}") for a in AXES for n, f in (("a", F.min), ("b", F.max))])
    lines = ends.withColumn("y", F.explode(F.sequence("__ay", "__by"))).withColumn("z", F.explode(F.sequence("__az", "__bz")))
    seen = df.groupBy(*by, "y", "z").agg(F.count("*").alias("__c"))
    bare = lines.join(seen, [*by, "y", "z"], "left").filter("__c IS NULL OR __c < __bx - __ax + 1")
    return bare.select(*by, F.explode(F.sequence("__ax", "__bx")).alias("x"), "y", "z").join(df, [*by, *AXES], "left_anti")


def _dense_over_ball(df: DataFrame, by: list[str], value: str, radius: int, kind: str) -> DataFrame:
    own = df.withColumn("__own", F.lit(True))
    out = over_ball(own.unionByName(_holes(df, by), allowMissingColumns=True), by, value, radius, kind)
    return out.filter("__own").select(df.columns)


def dilate_ball(df: DataFrame, by: list[str], value: str, radius: int = 3) -> DataFrame:
    """Greatest value within a distance; what lies outside the frame, or has no row, doesn't count."""
    return _dense_over_ball(df, by, value, radius, "max")


def erode_ball(df: DataFrame, by: list[str], value: str, radius: int = 3) -> DataFrame:
    """Least value within a distance, as ``dilate_ball``."""
    return _dense_over_ball(df, by, value, radius, "min")


def median_filter(df: DataFrame, by: list[str], value: str = "intensity") -> DataFrame:
    """Median of the 27 voxels around each, borders mirrored (a voxel at the border is its own neighbour beyond it); dense
    volumes. Neighbours are gathered axis by axis, by windows, into an array of 27 whose middle counts, so no row
    multiplies."""
    out = df.withColumn("_v", F.array(value))
    for a in AXES:
        w = W.partitionBy(*by, *[x for x in AXES if x != a]).orderBy(a)
        out = out.withColumn("_v", F.concat(F.coalesce(F.lag("_v").over(w), F.col("_v")), "_v", F.coalesce(F.lead("_v").over(w), F.col("_v"))))
    return out.withColumn(value, F.element_at(F.sort_array("_v"), 14)).select(df.columns)


def anisodiff(df: DataFrame, by: list[str], niter: int, kappa: float = 50.0, gamma: float = 0.1, option: int = 1, work: Workspace | None = None, value: str = "intensity") -> DataFrame:
    """Anisotropic diffusion, ``niter`` - 1 steps: forward differences, conductance exp(-(d/kappa)^2) or
    1 / (1 + (d/kappa)^2), and the divergence of the flow. Dense volumes; every third step is a written table."""
    work, out = work or Workspace(df.sparkSession), df.withColumn(value, F.col(value).cast("double"))
    for step in range(1, niter):
        total: Column = F.lit(0.0)
        for a in AXES:
            w = W.partitionBy(*by, *[x for x in AXES if x != a]).orderBy(a)
            out = out.withColumn(f"_d{a}", F.coalesce(F.lead(value).over(w) - F.col(value), F.lit(0.0)))
            d = F.col(f"_d{a}") / kappa
            out = out.withColumn(f"_f{a}", F.col(f"_d{a}") * (F.exp(-d * d) if option == 1 else 1 / (1 + d * d)))
            total = total + F.col(f"_f{a}") - F.coalesce(F.lag(f"_f{a}").over(w), F.lit(0.0))
        out = out.withColumn(value, F.col(value) + gamma * total).select(df.columns)
        if step % 3 == 0 and step + 1 < niter:
            out = work.write(out)
    return out


def exposed_faces(labels: DataFrame, by: list[str], label: str) -> DataFrame:
    """Sides of cells' voxels whose neighbour isn't the same cell: one row per side, with its axis and direction."""
    own = labels.filter(F.col(label) != 0).select(*by, *AXES, label)
    sides = [(a, s) for a in AXES for s in (-1, 1)]
    steps = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side")) for a, s in sides])
    step = lambda a, sign: F.when(F.col("__s.axis") == a, sign * F.col("__s.side")).otherwise(0)
    seen = own.withColumn("__s", F.explode(steps)).withColumns({a: F.col(a) + step(a, 1) for a in AXES})
    bare = seen.join(dealt(own), [*by, label, *AXES], "left_anti").withColumns({a: F.col(a) + step(a, -1) for a in AXES})
    return bare.select(*by, label, *AXES, "__s.axis", "__s.side")


def depth_correction(df: DataFrame, params: DataFrame, by: list[str], z_ref: float = 0.0, value: str = "intensity") -> DataFrame:
    """Multiplies each slice by f(z_ref) / f(z), f the inverted logistic with the fitted ``a, b, c, d``; 1 where f is 0."""
    f = lambda z: F.expr(f"d + a / (1 + exp(b * ({z} - c)))")
    rows = df.join(params, by).withColumn("_f", f("z"))
    return rows.withColumn(value, F.col(value) * F.when(F.col("_f") == 0, 1.0).otherwise(f(f"{z_ref}e0") / F.col("_f"))).select(df.columns)


def i_divergence(measured: DataFrame, estimate: DataFrame, by: list[str], chunk: int, floor: float = 1e-12) -> DataFrame:
    """Sum of m ln(m / e) - (m - e) for each chunk of slices."""
    m, e = (F.greatest(F.col(c), F.lit(floor)) for c in ("m", "e"))
    both = measured.select(*by, *AXES, F.col("intensity").alias("m")).join(estimate.select(*by, *AXES, F.col("intensity").alias("e")), [*by, *AXES])
    return both.groupBy(*by, F.floor(F.col("z") / chunk).alias("chunk")).agg(F.sum(m * F.log(m / e) - (m - e)).alias("divergence"))
