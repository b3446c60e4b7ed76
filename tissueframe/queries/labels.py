"""Queries of label operators."""

from pyspark.sql import functions as F

from ..operators import labels as L
from ..workspace import Workspace
from .registry import eigen_sql, query
from .voxels import r6

BY = ["specimen"]


def r4(name):
    """Four digits; the factor keeps exact ties from falling either way by the order of a sum."""
    return F.round(F.col(name) * (1 + 1e-10), 4).alias(name)


@query("relabel", "SELECT specimen, x, y, z, CASE WHEN pred % 3 = 0 AND pred <> 0 THEN pred + 7 ELSE 0 END AS pred FROM fx_volume")
def _(d):
    mapping = d.sql("SELECT DISTINCT specimen, pred AS label, pred + 7 AS new FROM fx_volume WHERE pred % 3 = 0 AND pred <> 0")
    return L.relabel(d.fx_volume.select("specimen", "x", "y", "z", "pred"), mapping, "pred", by=BY)


STATES = "SELECT DISTINCT specimen, pred AS label, CASE WHEN pred % 3 = 0 THEN 'correct' WHEN pred % 3 = 1 THEN 'missing' ELSE 'other' END AS state FROM fx_volume WHERE pred <> 0"
COLORS = "SELECT 'correct' AS state, 1 AS code UNION ALL SELECT 'missing', 2"


@query("state_colors", "SELECT specimen, x, y, z, CAST(CASE WHEN pred = 0 THEN 9 WHEN pred % 3 = 0 THEN 1 WHEN pred % 3 = 1 THEN 2 ELSE 9 END AS INTEGER) AS code FROM fx_volume")
def _(d):
    return L.state_colors(d.fx_volume.select("specimen", "x", "y", "z", "pred"), d.sql(STATES), d.sql(COLORS), "pred", BY, 9).drop("pred")


@query("filter_by_tissue", "SELECT specimen, x, y, z, pred FROM fx_volume v WHERE pred <> 0 AND EXISTS (SELECT 1 FROM fx_volume w WHERE w.specimen = v.specimen AND w.pred = v.pred AND w.tissue = 5)")
def _(d):
    v = d.fx_volume
    return L.filter_by_tissue(v.select("specimen", "x", "y", "z", "pred"), v, BY, "pred", [5])


@query("filter_by_tissue_dilated", """WITH a AS (SELECT v.specimen, v.x, v.y, v.z, v.pred, min(w.tissue) AS t FROM fx_volume v JOIN fx_volume w ON w.specimen = v.specimen AND w.z = v.z AND w.x BETWEEN v.x - 1 AND v.x + 1 AND w.y BETWEEN v.y - 1 AND v.y + 1 GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT v.specimen, v.x, v.y, v.z, v.pred, max(w.t) AS t FROM a v JOIN a w ON w.specimen = v.specimen AND w.z = v.z AND w.x BETWEEN v.x - 1 AND v.x + 1 AND w.y BETWEEN v.y - 1 AND v.y + 1 GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT v.specimen, v.x, v.y, v.z, v.pred, max(w.t) AS t FROM b v JOIN b w ON w.specimen = v.specimen AND w.z = v.z AND w.x BETWEEN v.x - 1 AND v.x + 1 AND w.y BETWEEN v.y - 1 AND v.y + 1 GROUP BY 1, 2, 3, 4, 5)
SELECT specimen, x, y, z, pred FROM c v WHERE pred <> 0 AND EXISTS (SELECT 1 FROM c w WHERE w.specimen = v.specimen AND w.pred = v.pred AND w.t = 5)""")
def _(d):
    v = d.fx_volume
    return L.filter_by_tissue(v.select("specimen", "x", "y", "z", "pred"), v.select("specimen", "x", "y", "z", "tissue"), BY, "pred", [5], 3)


#: Frames a little wider than the last labelled voxel, as volumes have them.
SIZES = "SELECT specimen, max(x) + 2 AS x_size, max(y) + 3 AS y_size, max(z) + 2 AS z_size FROM fx_volume GROUP BY 1"


@query("border_filter", f"""WITH e AS ({SIZES}), cut AS (SELECT DISTINCT specimen, gt FROM fx_volume JOIN e USING (specimen) WHERE gt <> 0 AND (x < 2 OR y < 2 OR x >= x_size - 2 OR y >= y_size - 2))
SELECT v.specimen, v.x, v.y, v.z, v.gt FROM fx_volume v LEFT JOIN cut USING (specimen, gt) WHERE v.gt <> 0 AND cut.gt IS NULL""")
def _(d):
    """Sparse labels: background has no rows, and the frame comes from the volumes' metadata."""
    return L.border_filter(d.fx_volume.filter("gt <> 0").select("specimen", "x", "y", "z", "gt"), BY, "gt", 2, ("x", "y"), d.sql(SIZES))


@query("label_sizes", "SELECT specimen, pred, count(*) AS volume FROM fx_volume WHERE pred <> 0 GROUP BY 1, 2")
def _(d):
    return L.label_sizes(d.fx_volume, BY, "pred")


EVEN = "CAST(round_even(avg({a}), 0) AS BIGINT) AS c{a}"
PROPS = f"""SELECT p.*, c.gt AS label_at_centroid FROM (SELECT specimen, gt, count(*) AS volume, {', '.join(EVEN.format(a=a) for a in 'xyz')}, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM fx_volume WHERE gt <> 0 GROUP BY 1, 2) p
JOIN fx_volume c ON c.specimen = p.specimen AND c.x = cx AND c.y = cy AND c.z = cz AND c.gt <> 0 WHERE volume > 20"""


@query("region_props", PROPS)
def _(d):
    return L.region_props(d.fx_volume, BY, "gt")


NUCLEI = f"SELECT specimen, pred AS cell_id, {', '.join(EVEN.format(a=a) for a in 'xyz')} FROM fx_volume WHERE pred <> 0 GROUP BY 1, 2"
OWN = f"own AS (SELECT n.specimen, cell_id, nullif(v.gt, 0) AS membrane FROM ({NUCLEI}) n LEFT JOIN fx_volume v ON v.specimen = n.specimen AND v.x = cx AND v.y = cy AND v.z = cz)"


def nuclei(d):
    v = d.fx_volume
    cells = v.filter("pred <> 0").groupBy("specimen", F.col("pred").alias("cell_id")).agg(*[F.bround(F.avg(a)).cast("long").alias(f"c{a}") for a in "xyz"])
    return L.nuclei_in_membrane(cells, v.select("specimen", "x", "y", "z", F.col("gt").alias("label")), BY)


@query("nuclei_in_membrane", f"WITH {OWN}, m AS (SELECT DISTINCT specimen, gt AS membrane FROM fx_volume WHERE gt <> 0) SELECT m.specimen, m.membrane, count(own.cell_id) AS n, coalesce(string_agg(CAST(own.cell_id AS VARCHAR), ',' ORDER BY own.cell_id), '') AS ids FROM m LEFT JOIN own USING (specimen, membrane) GROUP BY 1, 2")
def _(d):
    return nuclei(d)[1].withColumn("ids", F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")))


@query("colocation_rates", f"""WITH {OWN}, m AS (SELECT v.specimen, v.gt, count(own.cell_id) AS n FROM (SELECT DISTINCT specimen, gt FROM fx_volume WHERE gt <> 0) v LEFT JOIN own ON own.specimen = v.specimen AND own.membrane = v.gt GROUP BY 1, 2)
SELECT a.specimen, round(crowded, 6) AS crowded, round(empty, 6) AS empty, round(unassigned, 6) AS unassigned FROM (SELECT specimen, 100 * avg(CASE WHEN n >= 3 THEN 1e0 ELSE 0e0 END) AS crowded, 100 * avg(CASE WHEN n = 0 THEN 1e0 ELSE 0e0 END) AS empty FROM m GROUP BY 1) a
JOIN (SELECT specimen, 100 * avg(CASE WHEN membrane IS NULL THEN 1e0 ELSE 0e0 END) AS unassigned FROM own GROUP BY 1) b USING (specimen)""")
def _(d):
    return r6(L.colocation_rates(*nuclei(d), BY), "crowded", "empty", "unassigned")


DOMINANT = """dom AS (SELECT specimen, gt, tissue FROM (SELECT b.specimen, b.gt, v.tissue, row_number() OVER (PARTITION BY b.specimen, b.gt ORDER BY CASE WHEN v.tissue = 0 THEN -1 ELSE count(*) END DESC, v.tissue) AS r
FROM (SELECT specimen, gt, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM fx_volume WHERE gt <> 0 GROUP BY 1, 2) b
JOIN fx_volume v ON v.specimen = b.specimen AND v.x BETWEEN x0 AND x1 AND v.y BETWEEN y0 AND y1 AND v.z BETWEEN z0 AND z1 GROUP BY 1, 2, 3) t WHERE r = 1)"""


@query("dominant_tissue", f"WITH {DOMINANT} SELECT specimen, gt, tissue FROM dom")
def _(d):
    return L.dominant_tissue(d.fx_volume, d.fx_volume, BY, "gt")


FIRST = """st AS (SELECT specimen, gt, count(*) AS n, sum(intensity*intensity) AS energy, min(intensity) AS minimum, quantile_cont(intensity, 0.1) AS p10, quantile_cont(intensity, 0.9) AS p90, max(intensity) AS maximum, avg(intensity) AS mean,
 quantile_cont(intensity, 0.5) AS median, quantile_cont(intensity, 0.75) - quantile_cont(intensity, 0.25) AS iqr, max(intensity) - min(intensity) AS range, sqrt(avg(intensity*intensity)) AS rms, var_pop(intensity) AS variance FROM fx_volume WHERE gt <> 0 GROUP BY 1, 2),
mo AS (SELECT v.specimen, v.gt, avg(power((intensity - mean) / sqrt(variance), 3)) AS skewness, avg(power((intensity - mean) / sqrt(variance), 4)) AS kurtosis, avg(abs(intensity - mean)) AS mad, avg(CASE WHEN intensity BETWEEN p10 AND p90 THEN intensity END) AS rm FROM fx_volume v JOIN st USING (specimen, gt) GROUP BY 1, 2),
rb AS (SELECT v.specimen, v.gt, avg(CASE WHEN intensity BETWEEN p10 AND p90 THEN abs(intensity - rm) END) AS rmad FROM fx_volume v JOIN st USING (specimen, gt) JOIN mo USING (specimen, gt) GROUP BY 1, 2),
en AS (SELECT specimen, gt, -sum(s * log2(s)) AS entropy, sum(s * s) AS uniformity FROM (SELECT specimen, gt, count(*) / sum(count(*)) OVER (PARTITION BY specimen, gt) AS s FROM fx_volume WHERE gt <> 0 GROUP BY specimen, gt, floor(intensity / 25e3)) t GROUP BY 1, 2)"""
COLS = "minimum p10 p90 maximum mean median iqr range rms skewness kurtosis mad rmad entropy uniformity".split()


@query("first_order", f"WITH {FIRST} SELECT specimen, gt, n, {', '.join(f'round({c} * (1 + 1e-10), 4) AS {c}' for c in COLS)} FROM st JOIN mo USING (specimen, gt) JOIN rb USING (specimen, gt) JOIN en USING (specimen, gt) WHERE n > 20")
def _(d):
    out = L.first_order(d.fx_volume.filter("gt <> 0"), ["specimen", "gt"], 25e3).filter("n > 20")
    return out.select("specimen", "gt", "n", *[r4(c) for c in COLS])


@query("extract_cells", f"WITH {FIRST}, {DOMINANT}, props AS ({PROPS}) SELECT p.*, dom.tissue, round(mean * (1 + 1e-10), 4) AS mean, round(entropy * (1 + 1e-10), 4) AS entropy FROM props p LEFT JOIN dom USING (specimen, gt) LEFT JOIN st USING (specimen, gt) LEFT JOIN en USING (specimen, gt)")
def _(d):
    out = L.extract_cells(d.fx_volume, BY, "gt", 25e3)
    return out.select("specimen", "gt", "volume", "cx", "cy", "cz", "x0", "y0", "z0", "x1", "y1", "z1", "label_at_centroid", "tissue", r4("mean"), r4("entropy"))


LENGTHS = ", ".join(f"4*sqrt(greatest(e{i}, 0e0)) AS {n}" for i, n in ((1, "major"), (2, "minor"), (3, "least"))) + ", " + ", ".join(f"CASE WHEN e1 > 0 THEN sqrt(greatest(e{i}, 0e0)/e1) ELSE 0e0 END AS {n}" for i, n in ((2, "elongation"), (3, "flatness")))
AXES5 = "major minor least elongation flatness".split()


def r5(df, *names):
    return df.withColumns({n: F.round(n, 5) for n in names})


@query("axis_lengths", f"WITH {eigen_sql('(SELECT specimen, gt, x, y, z FROM fx_volume WHERE gt <> 0) v', 'specimen, gt')}, l AS (SELECT specimen, gt, {LENGTHS} FROM eig) SELECT specimen, gt, {', '.join(f'round({c}, 5) AS {c}' for c in AXES5)} FROM l")
def _(d):
    return r5(L.axis_lengths(d.fx_volume, BY, "gt"), *AXES5)


@query("feret_diameter", "SELECT a.specimen, a.gt, round(max(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))), 6) AS feret FROM fx_volume a JOIN fx_volume b USING (specimen, gt) WHERE a.gt <> 0 GROUP BY 1, 2")
def _(d):
    return r6(L.feret_diameter(d.fx_volume, BY, "gt"), "feret")


@query("shape_features", f"""WITH {eigen_sql('(SELECT specimen, gt, x*5e-1 AS x, y*5e-1 AS y, z*1e0 AS z FROM fx_volume WHERE gt <> 0) v', 'specimen, gt')}, l AS (SELECT specimen, gt, n*0.25e0 AS volume, {LENGTHS} FROM eig),
s AS (SELECT * FROM (VALUES (-1, 0, 0, 5e-1), (1, 0, 0, 5e-1), (0, -1, 0, 5e-1), (0, 1, 0, 5e-1), (0, 0, -1, 25e-2), (0, 0, 1, 25e-2)) t(dx, dy, dz, w)),
ar AS (SELECT v.specimen, v.gt, sum(s.w) AS area FROM fx_volume v CROSS JOIN s LEFT JOIN fx_volume o ON o.specimen = v.specimen AND o.gt = v.gt AND o.x = v.x + dx AND o.y = v.y + dy AND o.z = v.z + dz WHERE v.gt <> 0 AND o.gt IS NULL GROUP BY 1, 2),
fe AS (SELECT a.specimen, a.gt, max(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS feret FROM fx_volume a JOIN fx_volume b USING (specimen, gt) WHERE a.gt <> 0 GROUP BY 1, 2)
SELECT specimen, gt, round(volume, 5) AS volume, round(area, 5) AS area, {', '.join(f'round({c}, 5) AS {c}' for c in AXES5)}, round(feret, 5) AS feret, round(area/volume, 5) AS surface_to_volume, round(power(36*pi()*volume*volume, 1e0/3)/area, 5) AS sphericity FROM l JOIN ar USING (specimen, gt) JOIN fe USING (specimen, gt)""")
def _(d):
    out = L.shape_features(d.fx_volume, BY, "gt", (0.5, 0.5, 1.0))
    return r5(out, *[c for c in out.columns if c not in ("specimen", "gt")])


@query("size_percentile_filter", "SELECT cell_id, level, volume FROM fx_cells JOIN (SELECT level, quantile_cont(volume, 0.02) AS a, quantile_cont(volume, 0.98) AS b FROM fx_cells GROUP BY 1) p USING (level) WHERE volume BETWEEN a AND b")
def _(d):
    return L.size_percentile_filter(d.fx_cells, ["level"]).select("cell_id", "level", "volume")


@query("cell_crops", """WITH b AS (SELECT specimen, pred AS cell, CAST(round_even(avg(x), 0) AS BIGINT) AS cx, CAST(round_even(avg(y), 0) AS BIGINT) AS cy, min(z) AS z0, max(z) AS z1 FROM fx_volume WHERE pred <> 0 GROUP BY 1, 2),
r AS (SELECT b.specimen, b.cell, v.x - cx + 3 AS x, v.y - cy + 3 AS y, v.z, CASE WHEN v.pred = cell THEN intensity ELSE 0e0 END AS intensity FROM b JOIN fx_volume v ON v.specimen = b.specimen AND v.x >= cx - 3 AND v.x < cx + 3 AND v.y >= cy - 3 AND v.y < cy + 3 AND v.z BETWEEN z0 AND z1)
SELECT * FROM r WHERE EXISTS (SELECT 1 FROM r s WHERE s.specimen = r.specimen AND s.cell = r.cell AND s.z = r.z AND s.intensity <> 0)""")
def _(d):
    return L.cell_crops(d.fx_volume, BY, "pred", 3, 8)


# Components of the whole volume; labels are taken modulo 3, so that each has several components of different sizes.
VOX = "vox AS (SELECT specimen, x, y, z, CASE WHEN pred = 0 THEN 0 ELSE 1 + pred % 3 END AS lab, k FROM fx_volume)"
REACH = """own AS (SELECT k, specimen, x, y, z, lab FROM vox WHERE lab <> 0),
adj AS (SELECT a.k AS u, b.k AS v FROM own a JOIN own b ON b.specimen = a.specimen AND b.lab = a.lab AND abs(b.x-a.x) + abs(b.y-a.y) + abs(b.z-a.z) = 1 AND b.x BETWEEN a.x-1 AND a.x+1),
reach AS (SELECT k AS node, k AS seen FROM own UNION SELECT reach.node, adj.v FROM reach JOIN adj ON adj.u = reach.seen),
rank_ AS (SELECT k, row_number() OVER (ORDER BY specimen, x, y, z) AS o FROM own),
comp AS (SELECT node, min(o) AS c FROM reach JOIN rank_ ON rank_.k = reach.seen GROUP BY 1),
cv AS (SELECT own.*, c FROM own JOIN comp ON comp.node = own.k)"""


def vox(d):
    return d.sql("SELECT specimen, x, y, z, CASE WHEN pred = 0 THEN 0 ELSE 1 + pred % 3 END AS lab FROM fx_volume")


@query("voxel_components", f"WITH {VOX}, {REACH} SELECT specimen, lab, CAST(count(DISTINCT c) AS BIGINT) AS components, CAST(max(n) AS BIGINT) AS largest FROM (SELECT specimen, lab, c, count(*) AS n FROM cv GROUP BY 1, 2, 3) t GROUP BY 1, 2", recursive=True)
def _(d):
    sizes = L.voxel_components(vox(d), BY, "lab").groupBy("specimen", "lab", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("specimen", "lab").agg(F.count("*").alias("components"), F.max("n").alias("largest"))


@query("largest_component", f"WITH {VOX}, {REACH}, s AS (SELECT specimen, lab, c, count(*) AS n FROM cv GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY specimen, lab ORDER BY n DESC, c) AS r FROM s) SELECT cv.specimen, x, y, z, cv.lab FROM cv JOIN b ON b.c = cv.c AND b.r = 1", recursive=True)
def _(d):
    return L.filter_components(vox(d), BY, "lab", 0, 10**9)


@query("filter_components", f"WITH {VOX}, {REACH}, s AS (SELECT specimen, lab, c, count(*) AS n FROM cv GROUP BY 1, 2, 3 HAVING count(*) > 20 AND count(*) < 120), b AS (SELECT *, row_number() OVER (PARTITION BY specimen, lab ORDER BY n DESC, c) AS r FROM s) SELECT cv.specimen, x, y, z, cv.lab FROM cv JOIN b ON b.c = cv.c AND b.r = 1", recursive=True)
def _(d):
    """Bounds between the sizes of the largest components, so that some labels keep their second largest one."""
    return L.filter_components(vox(d), BY, "lab", 20, 120)


@query("remove_small_objects", f"WITH {VOX}, {REACH.replace('abs(b.x-a.x) + abs(b.y-a.y) + abs(b.z-a.z) = 1', 'b.y BETWEEN a.y-1 AND a.y+1 AND b.z BETWEEN a.z-1 AND a.z+1')}, s AS (SELECT specimen, c, count(*) AS n FROM cv GROUP BY 1, 2), p AS (SELECT specimen, quantile_cont(n, 0.4) AS q FROM s GROUP BY 1) SELECT cv.specimen, x, y, z, cv.lab FROM cv JOIN s ON s.c = cv.c JOIN p ON p.specimen = cv.specimen WHERE s.n >= q", recursive=True)
def _(d):
    return L.remove_small(vox(d), BY, "lab", 40)


@query("remove_large_objects", f"WITH {VOX}, {REACH.replace('abs(b.x-a.x) + abs(b.y-a.y) + abs(b.z-a.z) = 1', 'b.y BETWEEN a.y-1 AND a.y+1 AND b.z BETWEEN a.z-1 AND a.z+1')}, s AS (SELECT specimen, c, count(*) AS n FROM cv GROUP BY 1, 2), p AS (SELECT specimen, quantile_cont(n, 0.6) AS q FROM s GROUP BY 1) SELECT cv.specimen, x, y, z, cv.lab FROM cv JOIN s ON s.c = cv.c JOIN p ON p.specimen = cv.specimen WHERE s.n <= q", recursive=True)
def _(d):
    return L.remove_large(vox(d), BY, "lab", 60)


def morph_sql(first: str, then: str, r: int = 1) -> str:
    """Ball of radius r on the dense frame: the least, then the greatest value, or the other way."""
    near = "SELECT v.specimen, v.x, v.y, v.z, {fn}(w.gt) AS gt FROM {t} v JOIN {t} w ON w.specimen = v.specimen AND w.x BETWEEN v.x - {r} AND v.x + {r} AND w.y BETWEEN v.y - {r} AND v.y + {r} AND (w.x-v.x)*(w.x-v.x) + (w.y-v.y)*(w.y-v.y) + (w.z-v.z)*(w.z-v.z) <= {r2} GROUP BY 1, 2, 3, 4"
    base = "SELECT s.specimen, i.x, j.y, s.z, coalesce(v.gt, 0) AS gt FROM (SELECT DISTINCT specimen, z FROM fx_volume) s CROSS JOIN (SELECT unnest(range(25)) AS x) i CROSS JOIN (SELECT unnest(range(25)) AS y) j LEFT JOIN fx_volume v ON v.specimen = s.specimen AND v.x = i.x AND v.y = j.y AND v.z = s.z"
    return f"WITH base AS ({base}), one AS ({near.format(fn=first, t='base', r=r, r2=r * r)}), two AS ({near.format(fn=then, t='one', r=r, r2=r * r)}) SELECT * FROM two WHERE gt <> 0"


#: The frame of a dense volume; z of a specimen starts where that of the one before ends, so it is moved to 0.
FRAME = "SELECT specimen, 25 AS x_size, 25 AS y_size, max(z) - min(z) + 1 AS z_size FROM fx_volume GROUP BY specimen"
LOWERED = "SELECT v.specimen, x, y, z - z0 AS z, gt FROM fx_volume v JOIN (SELECT specimen AS s, min(z) AS z0 FROM fx_volume GROUP BY 1) m ON m.s = v.specimen WHERE gt <> 0"


def raised(d, out):
    low = d.sql("SELECT specimen, min(z) AS _z0 FROM fx_volume GROUP BY 1")
    return out.join(low, "specimen").select("specimen", "x", "y", (F.col("z") + F.col("_z0")).alias("z"), "gt")


@query("clean_boundaries_opening", morph_sql("min", "max"))
def _(d):
    return raised(d, L.clean_opening(d.sql(LOWERED), BY, "gt", 1, 1, d.sql(FRAME)))


@query("clean_boundaries_closing", morph_sql("max", "min", 3))
def _(d):
    return raised(d, L.clean_closing(d.sql(LOWERED), BY, "gt", sizes=d.sql(FRAME)))


def comp_sql(p: str, src: str, near: int) -> str:
    """Common table expressions whose names start with ``p``, the last being ``{p}cv``: voxels of ``src(specimen, x, y, z,
    lab)`` with their component c, numbered over all volumes by first voxel; 6 or 18 neighbours."""
    step = "abs(b.x-a.x) + abs(b.y-a.y) + abs(b.z-a.z) = 1" if near == 6 else "abs(b.y-a.y) <= 1 AND abs(b.z-a.z) <= 1 AND abs(b.x-a.x) + abs(b.y-a.y) + abs(b.z-a.z) BETWEEN 1 AND 2"
    return f"""{p}own AS MATERIALIZED (SELECT row_number() OVER (ORDER BY specimen, x, y, z) AS k, * FROM (SELECT specimen, x, y, z, lab FROM {src} WHERE lab <> 0) t),
{p}adj AS MATERIALIZED (SELECT a.k AS u, b.k AS v FROM {p}own a JOIN {p}own b ON b.specimen = a.specimen AND b.lab = a.lab AND b.x BETWEEN a.x-1 AND a.x+1 AND {step}),
{p}reach AS (SELECT k AS node, k AS seen FROM {p}own UNION SELECT r.node, j.v FROM {p}reach r JOIN {p}adj j ON j.u = r.seen),
{p}cv AS MATERIALIZED (SELECT o.specimen, o.x, o.y, o.z, o.lab, c FROM {p}own o JOIN (SELECT node, min(seen) AS c FROM {p}reach GROUP BY 1) m ON m.node = o.k)"""


def split_sql(p: str, src: str, least: int, near: int) -> str:
    """{p}out: components of at least ``least`` voxels, numbered by label and place."""
    return f"""{comp_sql(p, src, near)},
{p}out AS MATERIALIZED (SELECT cv.specimen, x, y, z, new AS lab FROM {p}cv cv JOIN (SELECT c, row_number() OVER (PARTITION BY specimen ORDER BY lab, c) AS new FROM (SELECT specimen, lab, c FROM {p}cv GROUP BY ALL HAVING count(*) >= {least}) s) b ON b.c = cv.c)"""


def merge_sql(p: str, src: str, least: int, radius: int, near: int) -> str:
    """{p}out: the walk through small regions by number, with the list of those that took part in a merge."""
    return f"""{comp_sql(p, src, near)},
{p}g AS MATERIALIZED (SELECT specimen, c, count(*) AS n, row_number() OVER (PARTITION BY specimen ORDER BY c) AS id FROM {p}cv GROUP BY 1, 2),
{p}v AS MATERIALIZED (SELECT cv.specimen, x, y, z, id, n FROM {p}cv cv JOIN {p}g g ON g.c = cv.c),
{p}e AS MATERIALIZED (SELECT specimen, a, list(b ORDER BY n DESC, b) AS near, row_number() OVER (PARTITION BY specimen ORDER BY a) AS i FROM (SELECT DISTINCT a.specimen, a.id AS a, b.id AS b, b.n FROM {p}v a JOIN {p}v b ON b.specimen = a.specimen AND b.id <> a.id AND a.n < {least}
 AND b.x BETWEEN a.x - {radius} AND a.x + {radius} AND b.y BETWEEN a.y - {radius} AND a.y + {radius} AND (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z) <= {radius * radius}) t GROUP BY specimen, a),
{p}w AS (SELECT specimen, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS took, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT DISTINCT specimen FROM {p}v) s
 UNION ALL SELECT specimen, i, CASE WHEN b IS NULL THEN took ELSE list_concat(took, [a, b]) END, a, b FROM (SELECT w.specimen, e.i, w.took, e.a, CASE WHEN list_contains(w.took, e.a) THEN NULL ELSE list_filter(e.near, lambda t: NOT list_contains(w.took, t))[1] END AS b FROM {p}w w JOIN {p}e e ON e.specimen = w.specimen AND e.i = w.i + 1) t),
{p}out AS MATERIALIZED (SELECT v.specimen, x, y, z, coalesce(w.b, v.id) AS lab FROM {p}v v LEFT JOIN {p}w w ON w.specimen = v.specimen AND w.a = v.id AND w.b IS NOT NULL)"""


@query("split_components", f"WITH {VOX}, {split_sql('s', 'vox', 20, 18)} SELECT * FROM sout", recursive=True)
def _(d):
    return L.split_components(vox(d), BY, "lab", 20)


#: Labels in two bits and pieces: parts of one label lie apart, and some of them are small.
PATCHY = "SELECT specimen, x, y, z, CASE WHEN pred = 0 AND (x + y + z) % 3 > 0 THEN 0 WHEN (x * 7 + y * 3 + z) % 11 < 4 THEN 1 + pred % 2 ELSE 3 + gt % 3 END AS lab FROM fx_volume"


@query("merge_small", f"WITH vox AS ({PATCHY}), {merge_sql('m', 'vox', 12, 2, 18)} SELECT * FROM mout", recursive=True)
def _(d):
    return L.merge_small(d.sql(PATCHY), BY, "lab", 12, 2)


def ball_sql(p: str, src: str, first: str, then: str) -> str:
    """{p}out: a ball of radius 1 on the dense frame, once with the one and once with the other aggregate."""
    near = "SELECT v.specimen, v.x, v.y, v.z, {fn}(w.lab) AS lab FROM {t} v JOIN {t} w ON w.specimen = v.specimen AND w.x BETWEEN v.x - 1 AND v.x + 1 AND (w.x-v.x)*(w.x-v.x) + (w.y-v.y)*(w.y-v.y) + (w.z-v.z)*(w.z-v.z) <= 1 GROUP BY 1, 2, 3, 4"
    return f"""{p}base AS MATERIALIZED (SELECT f.specimen, f.x, f.y, f.z, coalesce(v.lab, 0) AS lab FROM frame f LEFT JOIN {src} v ON v.specimen = f.specimen AND v.x = f.x AND v.y = f.y AND v.z = f.z),
{p}one AS MATERIALIZED ({near.format(fn=first, t=p + 'base')}), {p}two AS MATERIALIZED ({near.format(fn=then, t=p + 'one')}), {p}out AS MATERIALIZED (SELECT * FROM {p}two WHERE lab <> 0)"""


def by_percentile_sql(p: str, src: str, share: float, keep: str) -> str:
    return f"""{comp_sql(p, src, 18)}, {p}n AS (SELECT specimen, c, count(*) AS n FROM {p}cv GROUP BY 1, 2), {p}q AS (SELECT specimen, quantile_cont(n, {share}) AS q FROM {p}n GROUP BY 1),
{p}out AS MATERIALIZED (SELECT cv.specimen, x, y, z, cv.lab FROM {p}cv cv JOIN {p}n n ON n.c = cv.c JOIN {p}q q ON q.specimen = cv.specimen WHERE n.n {keep} q)"""


#: Volumes of their own frame: z of a specimen starts where that of the one before ends, so it is moved to 0.
LOW = "SELECT v.specimen, x, y, z - z0 AS z, lab FROM ({src}) v JOIN (SELECT specimen AS s, min(z) AS z0 FROM fx_volume GROUP BY 1) m ON m.s = v.specimen"
FRAMES = "frame AS MATERIALIZED (SELECT specimen, i.x, j.y, k.z FROM (SELECT specimen, max(z) - min(z) + 1 AS nz FROM fx_volume GROUP BY 1) s, (SELECT unnest(range(25)) AS x) i, (SELECT unnest(range(25)) AS y) j, (SELECT unnest(range(200)) AS z) k WHERE k.z < nz)"
LINK = """{p}f AS MATERIALIZED (SELECT specimen, z, lab, avg(x) AS cx, avg(y) AS cy, row_number() OVER (ORDER BY specimen, z, lab) AS id FROM {src} GROUP BY 1, 2, 3),
{p}l AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM {p}f a JOIN {p}f b ON b.specimen = a.specimen AND b.z = a.z + 1 AND (a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) <= {d}),
{p}s AS (SELECT u, v FROM {p}l UNION SELECT v, u FROM {p}l), {p}r AS (SELECT id AS node, id AS seen FROM {p}f UNION SELECT r.node, s.v FROM {p}r r JOIN {p}s s ON s.u = r.seen),
{p}out AS MATERIALIZED (SELECT v.specimen, v.x, v.y, v.z, n.new AS lab FROM {src} v JOIN (SELECT f.specimen, f.z, f.lab, dense_rank() OVER (PARTITION BY f.specimen ORDER BY c) AS new FROM {p}f f JOIN (SELECT node, min(seen) AS c FROM {p}r GROUP BY 1) c ON c.node = f.id) n ON n.specimen = v.specimen AND n.z = v.z AND n.lab = v.lab)"""


@query("postprocess_pipeline", f"""WITH {FRAMES}, vox AS MATERIALIZED ({LOW.format(src=PATCHY)}), {by_percentile_sql('a', 'vox', 0.05, '>=')}, {by_percentile_sql('b', 'aout', 0.995, '<=')}, {split_sql('c', 'bout', 3, 18)}, {merge_sql('d', 'cout', 12, 2, 18)},
{ball_sql('e', 'dout', 'max', 'min')}, {ball_sql('f', 'eout', 'min', 'max')}, {comp_sql('g', 'fout', 6)}, gs AS (SELECT specimen, lab, c, row_number() OVER (PARTITION BY specimen, lab ORDER BY count(*) DESC, c) AS r FROM gcv GROUP BY 1, 2, 3 HAVING count(*) > 3 AND count(*) < 400),
gout AS MATERIALIZED (SELECT cv.specimen, x, y, z, cv.lab FROM gcv cv JOIN gs ON gs.c = cv.c AND gs.r = 1), {LINK.format(p='h', src='gout', d='4e0')}, cut AS (SELECT DISTINCT specimen, lab FROM hout WHERE x < 1 OR y < 1 OR x >= 24 OR y >= 24)
SELECT h.* FROM hout h LEFT JOIN cut ON cut.specimen = h.specimen AND cut.lab = h.lab WHERE cut.lab IS NULL""", recursive=True)
def _(d):
    """All nine steps, each with the keywords that it knows of those given to all, or its own."""
    steps = [("remove_small_objects", {"small_percentile": 5}), ("remove_large_objects", {"large_percentile": 99.5}), ("split", {"least": 3}), ("merge_connected_components", {"least": 12, "radius": 2}), "clean_boundaries_closing", "clean_boundaries_opening", ("filter_components", {"low": 3, "high": 400, "neighbours": 6}), "merge_graph", "border"]
    frame = d.sql("SELECT specimen, 25 AS x_size, 25 AS y_size, max(z) - min(z) + 1 AS z_size FROM fx_volume GROUP BY specimen")
    return L.postprocess(d.sql(LOW.format(src=PATCHY)), steps, by=BY, label="lab", neighbours=18, erosion_radius=1, dilation_radius=1, distance=2.0, axes=("x", "y"), sizes=frame, work=Workspace(d.spark))


LINKS = """f AS (SELECT specimen, z, gt, avg(x) AS cx, avg(y) AS cy FROM fx_volume WHERE gt <> 0 GROUP BY 1, 2, 3),
l AS (SELECT a.specimen, a.z, a.gt, b.gt AS next_label FROM f a JOIN f b ON b.specimen = a.specimen AND b.z = a.z + 1 AND (a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) <= 2.25)"""


@query("slice_links", f"WITH {LINKS} SELECT * FROM l")
def _(d):
    return L.slice_links(d.fx_volume, BY, "gt", 1.5)


@query("link_slices", f"""WITH {LINKS}, n AS (SELECT specimen, z, gt, row_number() OVER (ORDER BY specimen, z, gt) AS id FROM f),
e AS (SELECT a.id AS u, b.id AS v FROM l JOIN n a ON a.specimen = l.specimen AND a.z = l.z AND a.gt = l.gt JOIN n b ON b.specimen = l.specimen AND b.z = l.z + 1 AND b.gt = l.next_label), sym AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT id AS node, id AS seen FROM n UNION SELECT reach.node, sym.v FROM reach JOIN sym ON sym.u = reach.seen), c AS (SELECT node, min(seen) AS c FROM reach GROUP BY 1),
d AS (SELECT n.*, dense_rank() OVER (PARTITION BY specimen ORDER BY c) AS new FROM n JOIN c ON c.node = n.id)
SELECT v.specimen, v.x, v.y, v.z, d.new AS gt FROM fx_volume v JOIN d ON d.specimen = v.specimen AND d.z = v.z AND d.gt = v.gt""", recursive=True)
def _(d):
    return L.link_slices(d.fx_volume.select("specimen", "x", "y", "z", "gt"), BY, "gt", 1.5)
