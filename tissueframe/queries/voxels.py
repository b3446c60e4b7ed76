"""Queries of voxel operators."""

from pyspark.sql import functions as F

from ..operators import voxels as V
from .registry import query

BY = ["specimen"]
VOX = "specimen, x, y, z, intensity"


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("crop_box", f"SELECT {VOX} FROM fx_volume WHERE x >= 3 AND x < 12 AND y >= 0 AND y < 7 AND z >= 2 AND z < 9")
def _(d):
    return V.crop(d.fx_volume.select("specimen", "x", "y", "z", "intensity"), {"x": (3, 12), "y": (0, 7), "z": (2, 9)})


@query("restore_box", "SELECT specimen, x, y, z, CASE WHEN x >= 3 AND x < 12 AND y < 7 THEN intensity ELSE 0e0 END AS intensity FROM fx_volume")
def _(d):
    v, box = d.fx_volume, {"x": (3, 12), "y": (0, 7)}
    small = d.sql("SELECT specimen, x - 3 AS x, y, z, intensity FROM fx_volume WHERE x >= 3 AND x < 12 AND y < 7")
    return V.restore_dense(small, box, v.select("specimen", "x", "y", "z"), "intensity", BY)


BOX = """greatest(min(x) - {m}, 0) AS x0, greatest(min(y) - {m}, 0) AS y0, greatest(min(z) - {m}, 0) AS z0,
least(max(x) + {m}, 1024) AS x1, least(max(y) + {m}, 1024) AS y1, least(least(max(z) + {m}, 1024) + {m}, max(z_size)) AS z1"""
SIZED = "(SELECT v.*, s.z_size FROM fx_volume v JOIN (SELECT specimen, max(z) + 1 AS z_size FROM fx_volume GROUP BY 1) s USING (specimen)) t"


@query("tissue_box", f"SELECT specimen, {BOX.format(m=10)} FROM {SIZED} WHERE tissue = 5 GROUP BY 1")
def _(d):
    return V.tissue_box(d.fx_volume, BY, [5])


@query("cell_box", f"SELECT specimen, pred, {BOX.format(m=5)} FROM {SIZED} WHERE pred <> 0 GROUP BY 1, 2")
def _(d):
    return V.cell_box(d.fx_volume, BY, "pred")


@query("permute_axes", "SELECT specimen, z AS x, y, x AS z, intensity FROM fx_volume")
def _(d):
    return V.permute_axes(d.fx_volume.select("specimen", "x", "y", "z", "intensity"), "ZYX")


META = "SELECT specimen, 38e-2 + specimen % 3 / 1e2 AS x_res, 38e-2 + specimen % 3 / 1e2 AS y_res, 5e-1 + specimen % 4 / 2e0 AS z_res FROM fx_volume GROUP BY specimen"


@query("physical_coords", f"WITH meta AS ({META}) SELECT specimen, x, y, z, round(x * x_res, 6) AS px, round(y * y_res, 6) AS py, round(z * z_res, 6) AS pz FROM fx_volume JOIN meta USING (specimen)")
def _(d):
    out = V.physical_coords(d.fx_volume, d.sql(META), BY)
    return r6(out.select("specimen", "x", "y", "z", "px", "py", "pz"), "px", "py", "pz")


FULL = f"SELECT m.specimen, x_size, y_size, z_size, x_res, y_res, z_res FROM ({META}) m JOIN (SELECT specimen, max(x) + 1 AS x_size, max(y) + 1 AS y_size, max(z) + 1 AS z_size FROM fx_volume GROUP BY 1) s ON s.specimen = m.specimen"


@query("halved_metadata", f"""WITH m AS ({FULL}) SELECT 'plane' AS form, specimen, CAST(floor(x_size / 2) AS BIGINT) AS x_size, z_size, round(x_res * 2, 6) AS x_res, round(z_res, 6) AS z_res, round(2 * x_res, 6) AS a00, round(2 * y_res, 6) AS a11, round(z_res, 6) AS a22, round(-9e0, 6) AS a03 FROM m
UNION ALL SELECT 'isotropic', specimen, CAST(floor(x_size / 2) AS BIGINT), CAST(floor(z_size / 2) AS BIGINT), round(x_res / 2, 6), round(z_res / 2, 6), round(x_res / 2, 6), round(y_res / 2, 6), round(z_res / 2, 6), round(-9e0, 6) FROM m""")
def _(d):
    """Metadata and affine after halving, in the plane and along all axes."""
    meta = d.sql(FULL).withColumn("affine", F.expr("array(array(x_res, 0e0, 0e0, -9e0), array(0e0, y_res, 0e0, 1e0), array(0e0, 0e0, z_res, 2e0), array(0e0, 0e0, 0e0, 1e0))"))
    out = None
    for form, axes in (("plane", ("x", "y")), ("isotropic", V.AXES)):
        one = V.halved(meta, axes).select(F.lit(form).alias("form"), "specimen", F.col("x_size").cast("long").alias("x_size"), F.col("z_size").cast("long").alias("z_size"), "x_res", "z_res", *[F.col("affine")[i][j].alias(f"a{i}{j}") for i, j in ((0, 0), (1, 1), (2, 2), (0, 3))])
        out = one if out is None else out.unionByName(one)
    return r6(out, "x_res", "z_res", "a00", "a11", "a22", "a03")


@query("attenuate", f"SELECT specimen, x, y, z, round(intensity * exp(-3e0 * x / (SELECT max(x) FROM fx_volume)), 6) AS intensity FROM fx_volume")
def _(d):
    return r6(V.attenuate(d.fx_volume.select("specimen", "x", "y", "z", "intensity"), BY), "intensity")


@query("channel_stack", "SELECT specimen, x, y, z, CASE WHEN pred <> 0 THEN intensity ELSE 0e0 END AS nuclei, CASE WHEN gt <> 0 THEN intensity ELSE 0e0 END AS membrane FROM fx_volume WHERE pred <> 0 OR gt <> 0")
def _(d):
    a, b = (d.fx_volume.filter(f"{c} <> 0").select("specimen", "x", "y", "z", "intensity") for c in ("pred", "gt"))
    return V.channel_stack(a, b, ["specimen", "x", "y", "z"], ("nuclei", "membrane"))


@query("rescale_slices", "SELECT specimen, x, y, z, round((intensity - lo) / (hi - lo), 6) AS intensity FROM (SELECT *, min(intensity) OVER (PARTITION BY specimen, z) AS lo, max(intensity) OVER (PARTITION BY specimen, z) AS hi FROM fx_volume) t")
def _(d):
    return r6(V.rescale_slices(d.fx_volume.select("specimen", "x", "y", "z", "intensity"), BY), "intensity")


@query("percentile_normalize", """SELECT specimen, x, y, z, round(least(greatest((intensity - lo) / (hi - lo), 0e0), 1e0), 6) AS intensity
FROM fx_volume JOIN (SELECT specimen, quantile_cont(intensity, 0.05) AS lo, quantile_cont(intensity, 0.95) AS hi FROM fx_volume GROUP BY 1) p USING (specimen)""")
def _(d):
    return r6(V.percentile_normalize(d.fx_volume.select("specimen", "x", "y", "z", "intensity"), BY, 5, 95), "intensity")


@query("equalize_hist", """WITH e AS (SELECT specimen, min(intensity) AS lo, max(intensity) AS hi, count(*) AS n FROM fx_volume GROUP BY 1),
p AS (SELECT v.specimen, x, y, z, (intensity - lo) / (hi - lo) * 256 AS p FROM fx_volume v JOIN e USING (specimen)),
b AS (SELECT specimen, b, sum(c) OVER (PARTITION BY specimen ORDER BY b) / n AS cdf FROM (SELECT e.specimen, e.n, g.b, coalesce(c, 0) AS c FROM e CROSS JOIN (SELECT unnest(range(256)) AS b) g LEFT JOIN (SELECT specimen, CAST(least(floor(p), 255) AS BIGINT) AS b, count(*) AS c FROM p GROUP BY 1, 2) h ON h.specimen = e.specimen AND h.b = g.b) t),
q AS (SELECT specimen, x, y, z, least(greatest(p - 0.5e0, 0e0), 255e0) AS q FROM p)
SELECT q.specimen, x, y, z, round(a.cdf + (q - floor(q)) * (c.cdf - a.cdf), 6) AS intensity FROM q JOIN b a ON a.specimen = q.specimen AND a.b = CAST(floor(q) AS BIGINT) JOIN b c ON c.specimen = q.specimen AND c.b = least(CAST(floor(q) AS BIGINT) + 1, 255)""")
def _(d):
    return r6(V.equalize_hist(d.fx_volume.select("specimen", "x", "y", "z", "intensity"), BY), "intensity")


@query("z_profile", "SELECT specimen, z, round(avg(CASE WHEN pred <> 0 THEN intensity END), 6) AS foreground, round(avg(CASE WHEN pred = 0 THEN intensity END), 6) AS background FROM fx_volume GROUP BY 1, 2")
def _(d):
    return r6(V.z_profile(d.fx_volume, BY, F.col("pred") != 0), "foreground", "background")


@query("z_profile_nomask", """SELECT specimen, z, round(avg(CASE WHEN intensity >= t THEN intensity END), 6) AS foreground, round(avg(CASE WHEN intensity < t THEN intensity END), 6) AS background
FROM fx_volume JOIN (SELECT specimen, z, least(max(intensity), avg(intensity) + 3 * stddev_pop(intensity)) AS t FROM fx_volume GROUP BY 1, 2) s USING (specimen, z) GROUP BY 1, 2""")
def _(d):
    return r6(V.z_profile_nomask(d.fx_volume, BY), "foreground", "background")


@query("iqr_slice_filter", """WITH m AS (SELECT specimen, pred, z, avg(intensity) AS m FROM fx_volume WHERE pred <> 0 GROUP BY 1, 2, 3), p AS (SELECT specimen, pred, quantile_cont(m, 0.35) AS a, quantile_cont(m, 0.95) AS b FROM m GROUP BY 1, 2)
SELECT v.specimen, v.pred, v.x, v.y, v.z FROM fx_volume v JOIN m USING (specimen, pred, z) JOIN p USING (specimen, pred) WHERE m.m > a - 0.1 * (b - a)""")
def _(d):
    return V.iqr_slice_filter(d.fx_volume.filter("pred <> 0"), ["specimen", "pred"]).select("specimen", "pred", "x", "y", "z")


@query("dim_stack_filter", "SELECT specimen, pred, count(*) AS n FROM fx_volume WHERE pred <> 0 GROUP BY 1, 2 HAVING avg(intensity) >= 150000")
def _(d):
    return V.dim_stack_filter(d.fx_volume.filter("pred <> 0"), ["specimen", "pred"], 150_000).groupBy("specimen", "pred").agg(F.count("*").alias("n"))



@query("mean_histogram", """WITH m AS (SELECT specimen, pred, avg(intensity) AS mean FROM fx_volume WHERE pred <> 0 GROUP BY 1, 2), e AS (SELECT min(mean) AS lo, max(mean) AS hi FROM m)
SELECT CAST(least(floor((mean - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM m, e GROUP BY 1""")
def _(d):
    return V.mean_histogram(d.fx_volume.filter("pred <> 0"), ["specimen", "pred"], 20)


@query("resample_nearest", """WITH s AS (SELECT specimen, max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM fx_volume GROUP BY 1),
g AS (SELECT s.*, x, y, z FROM s, (SELECT unnest(range(12)) AS x) a, (SELECT unnest(range(50)) AS y) b, (SELECT unnest(range(1000)) AS z) c WHERE z < nz)
SELECT g.specimen, g.x, g.y, g.z, v.pred FROM g JOIN fx_volume v ON v.specimen = g.specimen AND v.x = least(CAST(floor((g.x + 0.5e0) * nx / 12) AS BIGINT), nx - 1) AND v.y = least(CAST(floor((g.y + 0.5e0) * ny / 50) AS BIGINT), ny - 1) AND v.z = g.z""")
def _(d):
    return V.resample_nearest(d.fx_volume, BY, {"x": 0.5, "y": 2.0}, "pred")


@query("downsample_isotropic", """WITH zs AS (SELECT specimen, max(z) - min(z) + 1 AS n, min(z) AS z0 FROM fx_volume GROUP BY 1), v AS (SELECT f.specimen, x, y, f.z - z0 AS z, intensity, n FROM fx_volume f JOIN zs USING (specimen)),
g AS (SELECT unnest(range(12)) AS i), a AS (SELECT i, CAST(floor(i * 24e0 / 11) AS BIGINT) AS f, i * 24e0 / 11 - floor(i * 24e0 / 11) AS w FROM g), k AS (SELECT i, f AS v, 1 - w AS w FROM a UNION ALL SELECT i, least(f + 1, 24), w FROM a),
h AS (SELECT specimen, n, i, CASE WHEN m > 1 THEN i * (n - 1e0) / (m - 1) ELSE 0e0 END AS p FROM (SELECT specimen, n, greatest(floor(n / 2), 1) AS m, unnest(range(CAST(greatest(floor(n / 2), 1) AS BIGINT))) AS i FROM zs) t),
kz AS (SELECT specimen, i, least(CAST(floor(p) AS BIGINT), n - 1) AS v, 1 - (p - floor(p)) AS w FROM h UNION ALL SELECT specimen, i, least(CAST(floor(p) AS BIGINT) + 1, n - 1), p - floor(p) FROM h)
SELECT v.specimen, kx.i AS x, ky.i AS y, kz.i AS z, round(sum(v.intensity * kx.w * ky.w * kz.w), 4) AS intensity FROM v JOIN k kx ON kx.v = v.x JOIN k ky ON ky.v = v.y JOIN kz ON kz.specimen = v.specimen AND kz.v = v.z GROUP BY 1, 2, 3, 4""")
def _(d):
    """All three axes; only whole slices, so that the volume is dense."""
    low = d.sql("SELECT f.specimen, x, y, f.z - z0 AS z, intensity FROM fx_volume f JOIN (SELECT specimen AS s, min(z) AS z0 FROM fx_volume GROUP BY 1) m ON m.s = f.specimen")
    return V.downsample_half(low, BY).withColumn("intensity", F.round("intensity", 4))


@query("downsample_half", """WITH g AS (SELECT unnest(range(12)) AS i), a AS (SELECT i, CAST(floor(i * 24e0 / 11) AS BIGINT) AS f, i * 24e0 / 11 - floor(i * 24e0 / 11) AS w FROM g),
k AS (SELECT i, f AS v, 1 - w AS w FROM a UNION ALL SELECT i, least(f + 1, 24), w FROM a)
SELECT v.specimen, kx.i AS x, ky.i AS y, v.z, round(sum(v.intensity * kx.w * ky.w), 4) AS intensity FROM fx_volume v JOIN k kx ON kx.v = v.x JOIN k ky ON ky.v = v.y GROUP BY 1, 2, 3, 4""")
def _(d):
    return V.downsample_half(d.fx_volume, BY, axes=("x", "y")).withColumn("intensity", F.round("intensity", 4))


def stencil(fn: str, inner: str = "pred", table: str = "fx_volume") -> str:
    return f"SELECT v.specimen, v.x, v.y, v.z, {fn}(w.{inner}) AS pred FROM {table} v JOIN {table} w ON w.specimen = v.specimen AND w.z = v.z AND w.x BETWEEN v.x - 1 AND v.x + 1 AND w.y BETWEEN v.y - 1 AND v.y + 1 GROUP BY 1, 2, 3, 4"


for _name, _first, _then, _fn in (("dilate", "max", None, V.dilate), ("erode", "min", None, V.erode), ("opening", "min", "max", V.opening), ("closing", "max", "min", V.closing)):
    _sql = stencil(_first) if _then is None else f"WITH one AS ({stencil(_first)}) {stencil(_then, table='one')}"

    @query(_name, _sql)
    def _(d, fn=_fn):
        return fn(d.fx_volume.select("specimen", "x", "y", "z", "pred"), BY, "pred")


for _name, _fn, _ball in (("dilate_ball", "max", V.dilate_ball), ("erode_ball", "min", V.erode_ball)):
    query(_name, f"SELECT v.specimen, v.x, v.y, v.z, {_fn}(w.gt) AS gt FROM fx_volume v JOIN fx_volume w ON w.specimen = v.specimen AND w.x BETWEEN v.x - 3 AND v.x + 3 AND w.y BETWEEN v.y - 3 AND v.y + 3 AND w.z BETWEEN v.z - 3 AND v.z + 3 AND (w.x-v.x)*(w.x-v.x) + (w.y-v.y)*(w.y-v.y) + (w.z-v.z)*(w.z-v.z) <= 9 GROUP BY 1, 2, 3, 4")(
        lambda d, ball=_ball: ball(d.fx_volume, BY, "gt").select("specimen", "x", "y", "z", "gt")
    )


#: The volume with the last slice filled up, so that it is dense.
DENSE = """SELECT s.specimen, i.x, j.y, s.z, coalesce(v.intensity, 0e0) AS intensity FROM (SELECT DISTINCT specimen, z FROM fx_volume) s CROSS JOIN (SELECT DISTINCT x FROM fx_volume) i CROSS JOIN (SELECT DISTINCT y FROM fx_volume) j
LEFT JOIN fx_volume v ON v.specimen = s.specimen AND v.x = i.x AND v.y = j.y AND v.z = s.z"""


@query("median_filter", f"""WITH dense AS MATERIALIZED ({DENSE}), o AS (SELECT -1 AS o UNION ALL SELECT 0 UNION ALL SELECT 1), e AS (SELECT specimen, max(z) AS mz, min(z) AS nz FROM dense GROUP BY 1),
n AS MATERIALIZED (SELECT v.specimen, v.x, v.y, v.z, greatest(least(v.x + ox.o, 24), 0) AS px, greatest(least(v.y + oy.o, 24), 0) AS py, greatest(least(v.z + oz.o, mz), nz) AS pz FROM dense v JOIN e USING (specimen) CROSS JOIN o ox CROSS JOIN o oy CROSS JOIN o oz),
m AS MATERIALIZED (SELECT specimen, x AS px, y AS py, z AS pz, intensity FROM dense)
SELECT n.specimen, x, y, z, round(quantile_cont(intensity, 0.5), 6) AS intensity FROM n JOIN m USING (specimen, px, py, pz) GROUP BY 1, 2, 3, 4""")
def _(d):
    return r6(V.median_filter(d.sql(DENSE), BY), "intensity")


def diffusion_sql(steps: int) -> str:
    """``steps`` rounds: forward differences, their flow, and its divergence."""
    axes = {"x": "y, z", "y": "x, z", "z": "x, y"}
    ctes, last = [], "(SELECT specimen, x, y, z, intensity FROM fx_volume)"
    for k in range(steps):
        lead = ", ".join(f"coalesce(lead(intensity) OVER (PARTITION BY specimen, {o} ORDER BY {a}) - intensity, 0e0) AS d{a}" for a, o in axes.items())
        flow = ", ".join(f"d{a} * exp(-(d{a} / 5e4) * (d{a} / 5e4)) AS f{a}" for a in axes)
        out = " + ".join(f"f{a} - coalesce(lag(f{a}) OVER (PARTITION BY specimen, {o} ORDER BY {a}), 0e0)" for a, o in axes.items())
        ctes += [f"d{k} AS (SELECT *, {lead} FROM {last} t)", f"f{k} AS (SELECT *, {flow} FROM d{k})", f"s{k} AS (SELECT specimen, x, y, z, intensity + 1e-1 * ({out}) AS intensity FROM f{k})"]
        last = f"s{k}"
    return f"WITH {', '.join(ctes)} SELECT specimen, x, y, z, round(intensity, 4) AS intensity FROM {last}"


@query("anisodiff", diffusion_sql(3))
def _(d):
    out = V.anisodiff(d.fx_volume.select("specimen", "x", "y", "z", "intensity"), BY, 4, kappa=50_000.0)
    return out.withColumn("intensity", F.round("intensity", 4))


@query("exposed_faces", """WITH s AS (SELECT * FROM (VALUES ('x', -1, -1, 0, 0), ('x', 1, 1, 0, 0), ('y', -1, 0, -1, 0), ('y', 1, 0, 1, 0), ('z', -1, 0, 0, -1), ('z', 1, 0, 0, 1)) t(axis, side, dx, dy, dz))
SELECT v.specimen, v.pred, axis, side, count(*) AS n FROM fx_volume v CROSS JOIN s LEFT JOIN fx_volume w ON w.specimen = v.specimen AND w.pred = v.pred AND w.x = v.x + dx AND w.y = v.y + dy AND w.z = v.z + dz WHERE v.pred <> 0 AND w.pred IS NULL GROUP BY 1, 2, 3, 4""")
def _(d):
    return V.exposed_faces(d.fx_volume, BY, "pred").groupBy("specimen", "pred", "axis", "side").agg(F.count("*").alias("n"))


PARAMS = "SELECT specimen, 1e5 + specimen AS a, 1e-1 AS b, 6e0 AS c, 2e4 AS d FROM fx_volume GROUP BY specimen"


@query("depth_correction", f"WITH p AS ({PARAMS}) SELECT specimen, x, y, z, round(intensity * (d + a / (1 + exp(b * (0 - c)))) / (d + a / (1 + exp(b * (z - c)))), 6) AS intensity FROM fx_volume JOIN p USING (specimen)")
def _(d):
    return r6(V.depth_correction(d.fx_volume.select("specimen", "x", "y", "z", "intensity"), d.sql(PARAMS), BY), "intensity")


@query("i_divergence", "SELECT specimen, CAST(floor(z / 4) AS BIGINT) AS chunk, round(sum(intensity * ln(intensity / (intensity * (1 + x / 1e2))) - (intensity - intensity * (1 + x / 1e2))), 3) AS divergence FROM fx_volume GROUP BY 1, 2")
def _(d):
    v = d.fx_volume
    out = V.i_divergence(v, v.withColumn("intensity", F.expr("intensity * (1 + x / 1e2)")), BY, 4)
    return out.withColumn("divergence", F.round("divergence", 3))
