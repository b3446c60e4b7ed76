"""Label volumes: sparse rows of x, y, z and a label, 0 meaning background, grouped by the columns ``by``."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.linalg import eigenvalues
from ..workspace import Workspace, dealt
from .graph import components, greedy_matching, numbered
from .scoring import best_match
from .voxels import AXES, dilate, exposed_faces, opening, over_ball


def relabel(df: DataFrame, mapping: DataFrame, label: str, keep: bool = False, by: list[str] | None = None) -> DataFrame:
    """Labels by ``mapping(by, label, new)``; those it lacks become 0, or stay."""
    by = by or []
    out = df.join(mapping.withColumnRenamed("label", label), [*by, label], "left")
    return out.withColumn(label, F.coalesce("new", F.col(label) if keep else F.lit(0))).drop("new")


def state_colors(df: DataFrame, states: DataFrame, colors: DataFrame, label: str, by: list[str], default: int = 0) -> DataFrame:
    """The class code of each voxel by the state of its label."""
    coded = states.join(colors, "state").select(*by, F.col("label").alias(label), "code")
    return df.join(coded, [*by, label], "left").withColumn("code", F.coalesce("code", F.lit(default)))


def filter_by_tissue(labels: DataFrame, tissue: DataFrame, by: list[str], label: str, codes: list[int], size: int = 0) -> DataFrame:
    """Whole cells with a voxel in one of the tissues; with ``size`` these are opened and dilated in each slice before.
    Where tissues meet, the higher code wins."""
    if size:
        tissue = dilate(opening(tissue, by, "tissue", 3), by, "tissue", size)
    inside = tissue.filter(F.col("tissue").isin(codes)).select(*by, *AXES)
    touched = labels.filter(F.col(label) != 0).join(inside, [*by, *AXES], "left_semi").select(*by, label).distinct()
    return labels.join(touched, [*by, label], "left_semi")


def border_filter(labels: DataFrame, by: list[str], label: str, margin: int = 1, axes: tuple[str, str] = ("y", "z"), sizes: DataFrame | None = None) -> DataFrame:
    """Drops whole cells with a voxel within ``margin`` of the frame's border along two axes. ``sizes(by, x_size, y_size,
    z_size)`` holds the frames, as ``volume_metadata`` gives them; without it the labels have to be dense, a row for each
    voxel, and the frame ends at the last one."""
    if sizes is None:
        sizes = labels.groupBy(*by).agg(*[(F.max(a) + 1).alias(f"{a}_size") for a in axes])
    at: Column = F.lit(False)
    for a in axes:
        at = at | (F.col(a) < margin) | (F.col(a) >= F.col(f"{a}_size") - margin)
    cut = labels.filter(F.col(label) != 0).join(F.broadcast(sizes.select(*by, *[f"{a}_size" for a in axes])), by).filter(at).select(*by, label).distinct()
    return labels.join(cut, [*by, label], "left_anti")


def label_sizes(labels: DataFrame, by: list[str], label: str) -> DataFrame:
    return labels.filter(F.col(label) != 0).groupBy(*by, label).agg(F.count("*").alias("volume"))


def region_props(labels: DataFrame, by: list[str], label: str, least: int = 20) -> DataFrame:
    """Volume, rounded centroid, bounds, and the label at the centroid; cells of at most ``least`` voxels, or with
    background there, go."""
    own = labels.filter(F.col(label) != 0)
    props = own.groupBy(*by, label).agg(
        F.count("*").alias("volume"), *[F.bround(F.avg(a)).cast("long").alias(f"c{a}") for a in AXES],
        *[F.min(a).alias(f"{a}0") for a in AXES], *[F.max(a).alias(f"{a}1") for a in AXES],
    ).filter(F.col("volume") > least)
    at = own.select(*by, *[F.col(a).alias(f"c{a}") for a in AXES], F.col(label).alias("label_at_centroid"))
    return props.join(at, [*by, "cx", "cy", "cz"])


def nuclei_in_membrane(nuclei: DataFrame, membranes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each nucleus with the membrane label at its centroid (null outside), and each membrane with the number and sorted
    ids of its nuclei. ``nuclei(by, cell_id, cx, cy, cz)``, ``membranes(by, x, y, z, label)``."""
    at = membranes.filter("label <> 0").select(*by, *[F.col(a).alias(f"c{a}") for a in AXES], F.col("label").alias("membrane"))
    own = nuclei.join(at, [*by, "cx", "cy", "cz"], "left")
    held = own.filter("membrane IS NOT NULL").groupBy(*by, "membrane").agg(F.count_distinct("cell_id").alias("n"), F.sort_array(F.collect_set("cell_id")).alias("ids"))
    cells = membranes.filter("label <> 0").select(*by, F.col("label").alias("membrane")).distinct()
    return own.select(*by, "cell_id", "membrane"), cells.join(held, [*by, "membrane"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def colocation_rates(nuclei: DataFrame, membranes: DataFrame, by: list[str]) -> DataFrame:
    """Percentages of membranes with three nuclei or more, of nuclei without a membrane, of membranes without a nucleus."""
    a = membranes.groupBy(*by).agg((100 * F.avg(F.expr("int(n >= 3)"))).alias("crowded"), (100 * F.avg(F.expr("int(n = 0)"))).alias("empty"))
    b = nuclei.groupBy(*by).agg((100 * F.avg(F.expr("int(membrane IS NULL)"))).alias("unassigned"))
    return a.join(b, by)


def dominant_tissue(labels: DataFrame, tissue: DataFrame, by: list[str], label: str, tile: int = 16) -> DataFrame:
    """The commonest tissue code in each cell's bounding box, 0 only if alone, the smaller code on ties. Boxes meet
    voxels by tile, so the join is an equi-join."""
    box = labels.filter(F.col(label) != 0).groupBy(*by, label).agg(*[F.min(a).alias(f"{a}0") for a in AXES], *[F.max(a).alias(f"{a}1") for a in AXES])
    tiles = box
    for a in AXES:
        tiles = tiles.withColumn(f"_t{a}", F.explode(F.expr(f"sequence({a}0 div {tile}, {a}1 div {tile})")))
    keyed = tissue.select(*by, *AXES, "tissue", *[F.expr(f"{a} div {tile}").alias(f"_t{a}") for a in AXES])
    inside: Column = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1"))
    counts = tiles.join(keyed, [*by, "_tx", "_ty", "_tz"]).filter(inside).groupBy(*by, label, "tissue").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_w", F.when(F.col("tissue") == 0, -1).otherwise(F.col("n")))
    return best_match(ranked, [*by, label], "_w", "tissue").select(*by, label, "tissue")


def first_order(voxels: DataFrame, cell: list[str], bin_width: float, value: str = "intensity") -> DataFrame:
    """First-order intensity statistics of each cell; entropy and uniformity over bins of a fixed width."""
    v, p = F.col(value), lambda q: F.percentile(value, F.lit(q))
    base = voxels.groupBy(*cell).agg(
        F.count("*").alias("n"), F.sum(v * v).alias("energy"), F.min(v).alias("minimum"), p(0.1).alias("p10"), p(0.9).alias("p90"), F.max(v).alias("maximum"), F.avg(v).alias("mean"),
        p(0.5).alias("median"), (p(0.75) - p(0.25)).alias("iqr"), (F.max(v) - F.min(v)).alias("range"), F.sqrt(F.avg(v * v)).alias("rms"), F.var_pop(v).alias("variance"), F.skewness(v).alias("skewness"), (F.kurtosis(v) + 3).alias("kurtosis"),
    )
    back = voxels.join(base.select(*cell, "mean", "p10", "p90"), cell)
    inner = (v >= F.col("p10")) & (v <= F.col("p90"))
    robust = W.partitionBy(*cell)
    back = back.withColumn("_rm", F.avg(F.when(inner, v)).over(robust))
    mad = back.groupBy(*cell).agg(F.avg(F.abs(v - F.col("mean"))).alias("mad"), F.avg(F.when(inner, F.abs(v - F.col("_rm")))).alias("rmad"))
    bins = voxels.groupBy(*cell, F.floor(v / bin_width).alias("_b")).agg(F.count("*").alias("c"))
    share = F.col("c") / F.sum("c").over(W.partitionBy(*cell))
    texture = bins.withColumn("_s", share).groupBy(*cell).agg((-F.sum(F.col("_s") * F.log2("_s"))).alias("entropy"), F.sum(F.col("_s") * F.col("_s")).alias("uniformity"))
    return base.join(mad, cell).join(texture, cell)


def axis_lengths(labels: DataFrame, by: list[str], label: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Lengths 4 sqrt(eigenvalue) of the principal axes of each cell's voxels, longest first, and the ratios of the middle
    and the shortest to the longest."""
    own = labels.filter(F.col(label) != 0).select(*by, label, *[(F.col(a) * s).alias(a) for a, s in zip(AXES, spacing)])
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    cov = own.groupBy(*by, label).agg(*[F.covar_pop(a, b).alias(a + b) for a, b in pairs])
    values = eigenvalues(*(F.col(a + b) for a, b in pairs))
    out = cov.select(*by, label, values.alias("__e"))
    length = [(4 * F.sqrt(F.greatest(F.col("__e")[i], F.lit(0.0)))).alias(n) for i, n in enumerate(("major", "minor", "least"))]
    ratio = lambda i: F.expr(f"CASE WHEN __e[0] > 0 THEN sqrt(greatest(__e[{i}], 0e0) / __e[0]) ELSE 0e0 END")
    return out.select(*by, label, *length, ratio(1).alias("elongation"), ratio(2).alias("flatness"))


def surface_voxels(labels: DataFrame, by: list[str], label: str) -> DataFrame:
    return exposed_faces(labels, by, label).select(*by, label, *AXES).distinct()


def feret_diameter(labels: DataFrame, by: list[str], label: str, tile: int = 8) -> DataFrame:
    """The greatest distance between two voxels of each cell. Surface voxels meet by pairs of tiles, and only by those
    whose farthest corners lie as far apart as two voxels already seen: of a ball, tiles that face each other."""
    skin = surface_voxels(labels, by, label)
    centre = skin.groupBy(*by, label).agg(*[F.avg(a).alias(f"_c{a}") for a in AXES])
    apart = lambda p, q: F.sqrt(sum((F.col(f"{p}{a}") - F.col(f"{q}{a}")) ** 2 for a in AXES))
    far = skin.join(centre, [*by, label]).groupBy(*by, label).agg(F.max(F.struct(apart("", "_c").alias("r"), *AXES)).alias("m"))
    end = skin.join(far.select(*by, label, *[F.col(f"m.{a}").alias(f"_m{a}") for a in AXES]), [*by, label])
    seen = end.groupBy(*by, label).agg(F.max(apart("", "_m")).alias("_seen"))
    tiled = skin.withColumn("_t", F.struct(*[F.floor(F.col(a) / tile).alias(a) for a in AXES]))
    tiles = tiled.groupBy(*by, label, "_t").agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("_lo", F.min), ("_hi", F.max))])
    other = tiles.select(*by, label, F.col("_t").alias("_u"), *[F.col(f"{n}{a}").alias(f"{n}2{a}") for a in AXES for n in ("_lo", "_hi")])
    reach = F.sqrt(sum(F.greatest(F.col(f"_hi{a}") - F.col(f"_lo2{a}"), F.col(f"_hi2{a}") - F.col(f"_lo{a}")) ** 2 for a in AXES))
    pairs = tiles.join(other, [*by, label]).filter(F.col("_t") <= F.col("_u")).join(seen, [*by, label]).filter(reach >= F.col("_seen") - 1e-9).select(*by, label, "_t", "_u")
    b = tiled.select(*by, label, F.col("_t").alias("_u"), *[F.col(a).alias(f"_{a}") for a in AXES])
    return pairs.join(tiled, [*by, label, "_t"]).join(b, [*by, label, "_u"]).groupBy(*by, label).agg(F.max(apart("", "_")).alias("feret"))


def shape_features(labels: DataFrame, by: list[str], label: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Volume, exposed-face area, their ratio, sphericity, axis lengths and diameter of each cell."""
    sx, sy, sz = spacing
    area = exposed_faces(labels, by, label).groupBy(*by, label).agg(F.sum(F.expr(f"CASE axis WHEN 'x' THEN {sy * sz}e0 WHEN 'y' THEN {sx * sz}e0 ELSE {sx * sy}e0 END")).alias("area"))
    size = label_sizes(labels, by, label).withColumn("volume", F.col("volume") * (sx * sy * sz))
    out = size.join(area, [*by, label]).join(axis_lengths(labels, by, label, spacing), [*by, label]).join(feret_diameter(labels, by, label), [*by, label])
    return out.withColumns({"surface_to_volume": F.col("area") / F.col("volume"), "sphericity": F.expr("power(36 * pi() * volume * volume, 1e0 / 3) / area")})


def extract_cells(voxels: DataFrame, by: list[str], label: str, bin_width: float, least: int = 20) -> DataFrame:
    """The table of cells: region properties, dominant tissue and intensity statistics; a cell that lacks one of the
    latter keeps its row."""
    props = region_props(voxels, by, label, least)
    tissue = dominant_tissue(voxels, voxels, by, label)
    stats = first_order(voxels.filter(F.col(label) != 0), [*by, label], bin_width)
    return props.join(tissue, [*by, label], "left").join(stats.drop("n"), [*by, label], "left")


def size_percentile_filter(cells: DataFrame, by: list[str], low: float | None = 2, high: float | None = 98, value: str = "volume") -> DataFrame:
    """Drops cells below one exact percentile or above the other."""
    ends = cells.groupBy(*by).agg(F.percentile(value, F.lit((low or 0) / 100)).alias("_a"), F.percentile(value, F.lit((high if high is not None else 100) / 100)).alias("_b"))
    return cells.join(ends, by).filter(F.col(value).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def cell_crops(voxels: DataFrame, by: list[str], label: str, half: int = 25, tile: int = 50) -> DataFrame:
    """Intensities in a window around each cell's centroid over its slices, 0 outside of the cell; slices without any of
    it don't occur. Windows meet voxels by tile."""
    own = voxels.filter(F.col(label) != 0)
    box = own.groupBy(*by, label).agg(F.bround(F.avg("x")).cast("long").alias("_cx"), F.bround(F.avg("y")).cast("long").alias("_cy"), F.min("z").alias("_z0"), F.max("z").alias("_z1")).withColumnRenamed(label, "cell")
    tiles = box
    for a in ("x", "y"):
        tiles = tiles.withColumn(f"_t{a}", F.explode(F.expr(f"sequence(greatest(_c{a} - {half}, 0) div {tile}, (_c{a} + {half - 1}) div {tile})")))
    keyed = voxels.select(*by, *AXES, F.col(label).alias("_l"), "intensity", *[F.expr(f"{a} div {tile}").alias(f"_t{a}") for a in ("x", "y")])
    inside = F.expr(f"x >= _cx - {half} AND x < _cx + {half} AND y >= _cy - {half} AND y < _cy + {half} AND z BETWEEN _z0 AND _z1")
    rows = tiles.join(keyed, [*by, "_tx", "_ty"]).filter(inside)
    out = rows.select(*by, "cell", F.expr(f"x - _cx + {half}").alias("x"), F.expr(f"y - _cy + {half}").alias("y"), "z", F.expr("CASE WHEN _l = cell THEN intensity ELSE 0e0 END").alias("intensity"))
    some = out.filter("intensity <> 0").select(*by, "cell", "z").distinct()
    return out.join(some, [*by, "cell", "z"], "left_semi")


# --- components ------------------------------------------------------------------------------------

def voxel_components(labels: DataFrame, by: list[str], label: str, neighbours: int = 6, work: Workspace | None = None) -> DataFrame:
    """Labelled voxels with ``component``, the least voxel (by, x, y, z) of theirs that neighbouring voxels of the same
    label lead to; 6, 18 or 26 neighbours. Runs along x are found by a window; only runs of neighbouring rows that touch
    are linked, so the rounds run over a graph of runs with long ids instead of voxels."""
    work, reach = work or Workspace(labels.sparkSession), {6: 1, 18: 2, 26: 3}[neighbours]
    row = W.partitionBy(*by, "y", "z", label).orderBy("x")
    own = labels.filter(F.col(label) != 0).select(*by, *AXES, label).withColumn("__g", F.col("x") - F.row_number().over(row))
    runs = own.groupBy(*by, "y", "z", label, "__g").agg(F.min("x").alias("__a"), F.max("x").alias("__b"))
    runs = work.write(runs.withColumn("__node", F.monotonically_increasing_id()))
    rows = [(dy, dz, int(abs(dy) + abs(dz) < reach)) for dy, dz in ((0, 1), (1, -1), (1, 0), (1, 1)) if abs(dy) + abs(dz) <= reach]
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dz).alias("dz"), F.lit(dx).alias("dx")) for dy, dz, dx in rows]))
    # Runs of a row meet by tiles of x, so a row of many short runs isn't compared with all of the next one.
    tiles = lambda a, b: F.explode(F.expr(f"sequence(floor(({a}) / {RUN_TILE}), floor(({b}) / {RUN_TILE}))")).alias("__t")
    moved = runs.withColumn("__o", steps).select(*by, label, F.col("__node").alias("__u"), (F.col("y") + F.col("__o.dy")).alias("y"), (F.col("z") + F.col("__o.dz")).alias("z"), *[(F.col(c) + s * F.col("__o.dx")).alias(f"__m{c}") for c, s in (("__a", -1), ("__b", 1))])
    moved = moved.select("*", tiles("__m__a", "__m__b"))
    near = runs.select(*by, label, "y", "z", "__a", "__b", F.col("__node").alias("__v"), tiles("__a", "__b"))
    edges = moved.join(dealt(near), [*by, label, "y", "z", "__t"]).filter("__a <= __m__b AND __b >= __m__a").select(F.col("__u").alias("u"), F.col("__v").alias("v")).distinct()
    comp = components(edges, work)
    named = runs.join(dealt(comp.select(F.col("node").alias("__node"), F.col("component").alias("__of"))), "__node", "left").withColumn("__c", F.coalesce("__of", "__node"))
    least = named.groupBy("__c").agg(F.min(F.struct(*by, F.col("__a").alias("x"), "y", "z")).alias("component"))
    return own.join(dealt(named.join(least, "__c").select(*by, "y", "z", label, "__g", "component")), [*by, "y", "z", label, "__g"]).select(*by, *AXES, label, "component")


#: Width of the tiles by which runs of neighbouring rows meet.
RUN_TILE = 64


def filter_components(labels: DataFrame, by: list[str], label: str, low: int = 20, high: int = 4500, neighbours: int = 6, work: Workspace | None = None) -> DataFrame:
    """The largest of those components of each label that have low < size < high; of equals, the first."""
    comp = voxel_components(labels, by, label, neighbours, work)
    sizes = comp.groupBy(*by, label, "component").agg(F.count("*").alias("n")).filter((F.col("n") > low) & (F.col("n") < high))
    best = best_match(sizes, [*by, label], "n", "component")
    return comp.join(best.select("component", label), ["component", label], "left_semi").select(*by, *AXES, label)


def _by_percentile(labels: DataFrame, by: list[str], label: str, share: float, small: bool, neighbours: int, work: Workspace | None) -> DataFrame:
    comp = voxel_components(labels, by, label, neighbours, work)
    sizes = comp.groupBy(*by, "component").agg(F.count("*").alias("n"))
    ends = sizes.groupBy(*by).agg(F.percentile("n", F.lit(share / 100)).alias("_p"))
    kept = sizes.join(ends, by).filter(F.col("n") >= F.col("_p") if small else F.col("n") <= F.col("_p"))
    return comp.join(kept.select("component"), "component", "left_semi").select(*by, *AXES, label)


def remove_small(labels: DataFrame, by: list[str], label: str, small_percentile: float = 2, neighbours: int = 26, work: Workspace | None = None) -> DataFrame:
    """Drops components smaller than a percentile of the sizes of all components of their volume."""
    return _by_percentile(labels, by, label, small_percentile, True, neighbours, work)


def remove_large(labels: DataFrame, by: list[str], label: str, large_percentile: float = 98, neighbours: int = 26, work: Workspace | None = None) -> DataFrame:
    """Drops components larger than a percentile of the sizes of all components of their volume."""
    return _by_percentile(labels, by, label, large_percentile, False, neighbours, work)


def _ball(radius: int) -> list[tuple[int, int, int]]:
    return [o for o in product(range(-radius, radius + 1), repeat=3) if sum(v * v for v in o) <= radius * radius]


def _framed(labels: DataFrame, by: list[str], sizes: DataFrame | None) -> DataFrame:
    """Labels with the sizes of their frame, a row a volume; without ``sizes`` it ends at the last row of each axis."""
    if sizes is None:
        sizes = labels.groupBy(*by).agg(*[(F.max(a) + 1).alias(f"{a}_size") for a in AXES])
    return labels.join(F.broadcast(sizes.select(*by, *[f"{a}_size" for a in AXES])), by)


def _around(framed: DataFrame, by: list[str], label: str, radius: int) -> DataFrame:
    """All places of the frame within ``radius`` of a labelled voxel, with the label or null: runs along x are widened for
    each (dy, dz) of the ball, and runs of a row that overlap are joined before they are spelled out."""
    size = [f"{a}_size" for a in AXES]
    line = W.partitionBy(*by, "y", "z").orderBy("x")
    runs = framed.withColumn("__g", F.col("x") - F.row_number().over(line)).groupBy(*by, *size, "y", "z", "__g").agg(F.min("x").alias("__a"), F.max("x").alias("__b"))
    discs = [(dy, dz, math.isqrt(radius * radius - dy * dy - dz * dz)) for dy in range(-radius, radius + 1) for dz in range(-radius, radius + 1) if dy * dy + dz * dz <= radius * radius]
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dz).alias("dz"), F.lit(h).alias("h")) for dy, dz, h in discs]))
    wide = runs.withColumn("__o", steps).select(*by, *size, (F.col("y") + F.col("__o.dy")).alias("y"), (F.col("z") + F.col("__o.dz")).alias("z"), F.greatest(F.col("__a") - F.col("__o.h"), F.lit(0)).alias("__a"), F.least(F.col("__b") + F.col("__o.h"), F.col("x_size") - 1).alias("__b"))
    wide = wide.filter("y >= 0 AND y < y_size AND z >= 0 AND z < z_size").distinct()
    order = W.partitionBy(*by, "y", "z").orderBy("__a", "__b")
    begun = F.coalesce(F.col("__a") > F.max("__b").over(order.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int")
    merged = wide.withColumn("__n", begun).withColumn("__n", F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy(*by, "y", "z", "__n").agg(F.min("__a").alias("__a"), F.max("__b").alias("__b"))
    places = merged.select(*by, F.explode(F.sequence("__a", "__b")).alias("x"), "y", "z")
    return places.join(framed.select(*by, *AXES, label), [*by, *AXES], "left")


def grow(labels: DataFrame, by: list[str], label: str, radius: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """Grey dilation of sparse labels by a ball: the greatest label within ``radius``, inside the frame."""
    own = _framed(labels.filter(F.col(label) != 0).select(*by, *[F.col(a).cast("long").alias(a) for a in AXES], label), by, sizes)
    return over_ball(_around(own, by, label, radius), by, label, radius, "max").select(*by, *AXES, label)


def shrink(labels: DataFrame, by: list[str], label: str, radius: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """Grey erosion of sparse labels by a ball: the least label within ``radius``, where no background lies within it;
    what is outside the frame doesn't count."""
    own = _framed(labels.filter(F.col(label) != 0).select(*by, *[F.col(a).cast("long").alias(a) for a in AXES], label), by, sizes).withColumn("__n", F.lit(1).cast("long"))
    seen = over_ball(over_ball(own, by, label, radius, "min"), by, "__n", radius, "sum")
    offsets = ", ".join(f"named_struct('x', {x}, 'y', {y}, 'z', {z})" for x, y, z in _ball(radius))
    inside = " AND ".join(f"{a} + o.{a} >= 0 AND {a} + o.{a} < {a}_size" for a in AXES)
    whole = F.when(F.expr(" AND ".join(f"{a} BETWEEN {radius} AND {a}_size - {radius + 1}" for a in AXES)), len(_ball(radius))).otherwise(F.expr(f"size(filter(array({offsets}), o -> {inside}))"))
    return seen.filter(F.col("__n") == whole).select(*by, *AXES, label)


def clean_opening(labels: DataFrame, by: list[str], label: str, erosion_radius: int = 3, dilation_radius: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """Boundaries cleaned by erosion, then dilation."""
    sizes = sizes if sizes is not None else labels.groupBy(*by).agg(*[(F.max(a) + 1).alias(f"{a}_size") for a in AXES])
    return grow(shrink(labels, by, label, erosion_radius, sizes), by, label, dilation_radius, sizes)


def clean_closing(labels: DataFrame, by: list[str], label: str, erosion_radius: int = 3, dilation_radius: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """Boundaries cleaned by dilation, then erosion."""
    sizes = sizes if sizes is not None else labels.groupBy(*by).agg(*[(F.max(a) + 1).alias(f"{a}_size") for a in AXES])
    return shrink(grow(labels, by, label, dilation_radius, sizes), by, label, erosion_radius, sizes)


def split_components(labels: DataFrame, by: list[str], label: str, least: int = 500, neighbours: int = 18, work: Workspace | None = None) -> DataFrame:
    """Components of at least ``least`` voxels with labels 1, 2, ... of their own, in the order of old label and place."""
    work = work or Workspace(labels.sparkSession)
    comp = work.write(voxel_components(labels, by, label, neighbours, work))
    sizes = comp.groupBy(*by, label, "component").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    new = numbered(sizes.drop("__n"), by, [label, "component"], "__new", work)
    return comp.join(dealt(new.select("component", "__new")), "component").select(*by, *AXES, F.col("__new").alias(label))


def touching(labels: DataFrame, by: list[str], label: str, radius: int, some: DataFrame) -> DataFrame:
    """``by, a, b``: pairs of regions of which ``a`` is in ``some(by, label)`` and that have voxels within ``radius`` of
    each other. Surface voxels meet by tile."""
    skin, tile = surface_voxels(labels, by, label), radius + 1
    near = skin.join(some, [*by, label], "left_semi")
    for a in AXES:
        near = near.withColumn(f"__t{a}", F.explode(F.expr(f"sequence(cast(floor(({a} - {radius}) / {tile}) AS long), cast(floor(({a} + {radius}) / {tile}) AS long))")))
    other = skin.select(*by, F.col(label).alias("__b"), *[F.col(a).alias(f"__{a}") for a in AXES], *[F.expr(f"cast(floor({a} / {tile}) AS long)").alias(f"__t{a}") for a in AXES])
    close = sum((F.col(a) - F.col(f"__{a}")) * (F.col(a) - F.col(f"__{a}")) for a in AXES) <= radius * radius
    pairs = near.join(dealt(other), [*by, *[f"__t{a}" for a in AXES]]).filter((F.col("__b") != F.col(label)) & close)
    return pairs.select(*by, F.col(label).alias("a"), F.col("__b").alias("b")).distinct()


def merge_small(labels: DataFrame, by: list[str], label: str, least: int = 500, radius: int = 9, neighbours: int = 18, work: Workspace | None = None) -> DataFrame:
    """Regions, the components of equal labels, numbered 1, 2, ... by their first voxel; one smaller than ``least`` takes
    the number of the largest region with a voxel within ``radius``, the lower of equals. Small regions choose in the
    order of their numbers, and a region takes part in one merge at most."""
    work = work or Workspace(labels.sparkSession)
    comp = work.write(voxel_components(labels, by, label, neighbours, work))
    regions = comp.groupBy(*by, "component").agg(F.count("*").alias("__size"))
    regions = work.write(numbered(regions, by, ["component"], "__region", work))
    placed = work.write(comp.join(dealt(regions.select("component", "__region")), "component").select(*by, *AXES, "__region"))
    sizes = regions.select(*by, F.col("__region").alias("b"), F.col("__size").alias("weight"))
    pairs = touching(placed, by, "__region", radius, dealt(regions.filter(F.col("__size") < least).select(*by, "__region")))
    merged = greedy_matching(pairs.join(dealt(sizes), [*by, "b"]), by, work).select(*by, F.col("a").alias("__region"), F.col("b").alias("__to"))
    out = placed.join(dealt(merged), [*by, "__region"], "left")
    return out.select(*by, *AXES, F.coalesce("__to", "__region").alias(label))


def slice_links(labels: DataFrame, by: list[str], label: str, distance: float = 5.0) -> DataFrame:
    """Pairs of 2-D cells in neighbouring slices with centroids at most ``distance`` apart; met by tile."""
    flat = labels.filter(F.col(label) != 0).groupBy(*by, "z", label).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    tiled = flat.withColumns({"_tx": F.floor(F.col("cx") / distance), "_ty": F.floor(F.col("cy") / distance)})
    up = tiled.select(*by, (F.col("z") - 1).alias("z"), F.col(label).alias("next_label"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), "_tx", "_ty")
    for t in ("_tx", "_ty"):
        up = up.withColumn(t, F.explode(F.expr(f"sequence({t} - 1, {t} + 1)")))
    close = (F.col("cx") - F.col("_x")) ** 2 + (F.col("cy") - F.col("_y")) ** 2 <= distance * distance
    return tiled.join(dealt(up), [*by, "z", "_tx", "_ty"]).filter(close).select(*by, "z", label, "next_label")


def link_slices(labels: DataFrame, by: list[str], label: str, distance: float = 5.0, work: Workspace | None = None) -> DataFrame:
    """2-D cells of neighbouring slices joined into 3-D cells, numbered 1, 2, ... by their first slice and label."""
    work = work or Workspace(labels.sparkSession)
    links = slice_links(labels, by, label, distance)
    node = lambda z, lab: F.struct(*by, F.expr(z).alias("z"), F.col(lab).alias("l"))
    comp = components(links.select(node("z", label).alias("u"), node("z + 1", "next_label").alias("v")), work)
    cells = labels.filter(F.col(label) != 0).select(*by, "z", label).distinct().withColumn("node", node("z", label))
    named = work.write(cells.join(dealt(comp), "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node"))
    new = numbered(named.select(*by, "component").distinct(), by, ["component"], "__new", work)
    named = named.join(dealt(new.select("component", "__new")), "component").select(*by, "z", label, "__new")
    return labels.join(dealt(named), [*by, "z", label]).drop(label).withColumnRenamed("__new", label)


#: Named steps of post-processing.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "remove_small_objects": remove_small, "remove_large_objects": remove_large, "split": split_components, "merge_connected_components": merge_small, "merge_graph": link_slices,
    "clean_boundaries_opening": clean_opening, "clean_boundaries_closing": clean_closing, "filter_components": filter_components, "border": border_filter,
}


def postprocess(labels: DataFrame, steps: list[str | tuple[str, dict[str, object]]], **options: object) -> DataFrame:
    """Named steps in order; each takes those of the options that it knows, and those given with its name before them. What
    a step returns is a written table, so that the next one doesn't do its work again."""
    work = options["work"] = options.get("work") or Workspace(labels.sparkSession)
    for step in steps:
        name, own = (step, {}) if isinstance(step, str) else step
        if name not in STEPS:
            raise ValueError(f"unknown step {name}; known: {', '.join(STEPS)}")
        known = inspect.signature(STEPS[name]).parameters
        if unknown := set(own) - set(known):
            raise ValueError(f"{name} takes no {', '.join(sorted(unknown))}")
        labels = work.write(labels.transform(STEPS[name], **{k: v for k, v in (options | own).items() if k in known}))
    return labels
