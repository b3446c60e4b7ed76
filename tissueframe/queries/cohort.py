"""Queries of cohort statistics, joins of feature tables, and scalar columns."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cohort as H
from ..operators import voxels as V
from .calibration import A, P, pred
from .registry import query
from .voxels import r6

COUNTS = """cnt AS (SELECT stage, group_no, level, count(*) AS specimens, avg(n) AS mean, stddev_samp(n) AS std FROM (SELECT specimen, level, count(*) AS n FROM fx_cells GROUP BY 1, 2) c JOIN fx_catalog USING (specimen) GROUP BY 1, 2, 3)"""


def counts(d):
    return H.stage_counts(d.fx_cells, d.fx_catalog.select("specimen", "stage"))


@query("stage_counts", f"WITH {COUNTS} SELECT stage, level, specimens, round(mean, 6) AS mean, round(std, 6) AS std FROM cnt")
def _(d):
    return r6(counts(d), "mean", "std")


@query("stage_ratio", f"WITH {COUNTS} SELECT stage, round(max(CASE WHEN level = 'Nuclei' THEN mean END)/max(CASE WHEN level = 'Membrane' THEN mean END), 6) AS ratio FROM cnt GROUP BY 1")
def _(d):
    return r6(H.stage_ratio(counts(d)), "ratio")


STATS = "slope intercept r2 adjusted_r2 f slope_error intercept_error t durbin_watson jarque_bera".split()


@query("stage_regression", f"""WITH {COUNTS}, d AS (SELECT level, CAST(group_no AS DOUBLE) AS x, mean AS y FROM cnt), f AS (SELECT level, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, avg(x) AS mx FROM d GROUP BY 1),
e AS (SELECT level, x, y - intercept - slope*x AS e FROM d JOIN f USING (level)), g AS (SELECT level, e, e - lag(e) OVER (PARTITION BY level ORDER BY x) AS d FROM e), m AS (SELECT level, avg(e*e) AS v, avg(e) AS m1 FROM g GROUP BY 1),
j AS (SELECT level, sum(d*d)/sum(e*e) AS durbin_watson, count(*)/6e0*(power(avg(power(e-m1, 3))/power(max(v), 1.5), 2) + power(avg(power(e-m1, 4))/power(max(v), 2) - 3, 2)/4) AS jarque_bera FROM g JOIN m USING (level) GROUP BY 1),
k AS (SELECT *, syy*(1-r2)/(n-2) AS s2 FROM f JOIN j USING (level)),
o AS (SELECT level, n, slope, intercept, r2, 1-(1-r2)*(n-1)/(n-2) AS adjusted_r2, slope*slope*sxx/s2 AS f, sqrt(s2/sxx) AS slope_error, sqrt(s2*(1e0/n+mx*mx/sxx)) AS intercept_error, slope/sqrt(s2/sxx) AS t, durbin_watson, jarque_bera FROM k)
SELECT level, n, {', '.join(f'round({c}, 6) AS {c}' for c in STATS)} FROM o""")
def _(d):
    c = counts(d).select("level", F.col("mean").alias("y"), C.stage_number(F.col("stage")).cast("double").alias("x"))
    return r6(H.regression(c, "x", "y", "x", ["level"]), *STATS)


@query("class_shares", "SELECT cell_division, count(*) AS n, round(count(*)/sum(count(*)) OVER (), 6) AS share FROM fx_cells GROUP BY 1")
def _(d):
    return r6(H.class_shares(d.fx_cells, "cell_division"), "share")


@query("confidence_summary", f"""WITH {P}, {A} SELECT y_pred, count(*) AS n, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, round(quantile_cont(confidence, 0.25), 6) AS q25, round(quantile_cont(confidence, 0.5), 6) AS q50, round(quantile_cont(confidence, 0.75), 6) AS q75,
round(100*avg(CASE WHEN y_pred = y_true THEN 1e0 ELSE 0e0 END), 6) AS correct, round(100*avg(CASE WHEN confidence >= 0.9 THEN CASE WHEN y_pred = y_true THEN 1e0 ELSE 0e0 END END), 6) AS correct_when_sure FROM arg GROUP BY 1""")
def _(d):
    from ..operators.calibration import argmax_class

    return r6(H.confidence_summary(argmax_class(pred(d)), ["y_pred"]), "mean", "least", "most", "q25", "q50", "q75", "correct", "correct_when_sure")


@query("overwrite_merge", "SELECT cell_id, level, CASE WHEN level = 'Nuclei' THEN 1 - sphericity END AS sphericity, CASE WHEN level = 'Nuclei' THEN volume * 2 END AS doubled FROM fx_cells")
def _(d):
    new = d.sql("SELECT cell_id, 1 - sphericity AS sphericity, volume * 2 AS doubled FROM fx_cells WHERE level = 'Nuclei'")
    return H.overwrite_merge(d.fx_cells.select("cell_id", "level", "sphericity"), new, ["cell_id"])


@query("inner_merge", "SELECT a.specimen, a.cell_id, a.volume, b.perpendicularity FROM (SELECT specimen, cell_id, volume FROM fx_cells WHERE sphericity > 2e-1) a JOIN (SELECT cell_id, perpendicularity FROM fx_cells WHERE perpendicularity < 9e-1) b ON b.cell_id = a.cell_id")
def _(d):
    """Two feature tables of the same cells, each with rows that the other lacks."""
    shape = d.sql("SELECT specimen, cell_id, volume FROM fx_cells WHERE sphericity > 2e-1")
    mesh = d.sql("SELECT cell_id, perpendicularity FROM fx_cells WHERE perpendicularity < 9e-1")
    return shape.join(mesh, "cell_id", "inner")


@query("filter_features", "SELECT cell_id, volume FROM fx_cells WHERE EXISTS (SELECT 1 FROM fx_volume WHERE pred = cell_id)")
def _(d):
    return d.fx_cells.select("cell_id", "volume").join(d.fx_volume.select(F.col("pred").alias("cell_id")), "cell_id", "left_semi")


@query("cells_with_features", "SELECT DISTINCT pred AS cell_id FROM fx_volume WHERE pred IN (SELECT cell_id FROM fx_cells WHERE sphericity > 0.5)")
def _(d):
    return d.fx_volume.select(F.col("pred").alias("cell_id")).distinct().join(d.fx_cells.filter("sphericity > 0.5"), "cell_id", "left_semi")


@query("id_sets", "SELECT 'both' AS kind, id FROM (SELECT cell_id AS id FROM fx_cells WHERE level = 'Nuclei' INTERSECT SELECT cell_id FROM fx_cells WHERE sphericity > 5e-1) a UNION ALL SELECT 'first', id FROM (SELECT cell_id AS id FROM fx_cells WHERE level = 'Nuclei' EXCEPT SELECT cell_id FROM fx_cells WHERE sphericity > 5e-1) b")
def _(d):
    a, b = (d.fx_cells.filter(c).select(F.col("cell_id").alias("id")) for c in ("level = 'Nuclei'", "sphericity > 5e-1"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "id").unionByName(a.subtract(b).select(F.lit("first").alias("kind"), "id"))


@query("recode_division", "SELECT cell_id, CAST(CASE WHEN cell_division IS NULL THEN NULL WHEN cell_division > 1 THEN 0 ELSE 1 END AS INTEGER) AS division, CAST(CASE WHEN cell_division > 1 THEN 0 ELSE 1 END AS INTEGER) AS division_compat FROM fx_cells")
def _(d):
    c = F.col("cell_division")
    return d.fx_cells.select("cell_id", C.recode_division(c).alias("division"), C.recode_division(c, True).alias("division_compat"))


@query("columnarity", "SELECT cell_id, round((1-sphericity)*perpendicularity, 6) AS columnarity, round((1-sphericity)*(1-perpendicularity), 6) AS columnarity_parallel FROM fx_cells")
def _(d):
    s, p = F.col("sphericity"), F.col("perpendicularity")
    return d.fx_cells.select("cell_id", F.round(C.columnarity(s, p), 6).alias("columnarity"), F.round(C.columnarity_parallel(s, p), 6).alias("columnarity_parallel"))


@query("stage_number", "SELECT specimen, stage, CAST(regexp_extract(stage, '(\\d+)', 1) AS INTEGER) AS number FROM fx_catalog")
def _(d):
    return d.fx_catalog.select("specimen", "stage", C.stage_number(F.col("stage")).alias("number"))


@query("parse_point", "SELECT o_orderkey AS cell_id, CAST(o_orderkey % 25 AS INTEGER) AS x, CAST(o_custkey % 31 AS INTEGER) AS y, CAST(7 AS INTEGER) AS z FROM orders")
def _(d):
    text = d.sql("SELECT o_orderkey AS cell_id, concat('[', o_orderkey % 25, ', ', o_custkey % 31, ', 7]') AS t FROM orders")
    return text.withColumn("p", C.parse_point(F.col("t"))).select("cell_id", "p.x", "p.y", "p.z")


@query("parse_neighbors", "SELECT o_orderkey AS face, unnest([o_custkey, o_orderkey % 7]) AS neighbor FROM orders WHERE o_orderkey % 5 > 0")
def _(d):
    text = d.sql("SELECT o_orderkey AS face, CASE WHEN o_orderkey % 5 = 0 THEN '[ ]' ELSE concat('[', o_custkey, '   ', o_orderkey % 7, ' ]') END AS t FROM orders")
    return text.select("face", F.explode(C.parse_neighbors(F.col("t"))).alias("neighbor"))


@query("decay_fit")
def _(d):
    profile = V.z_profile_nomask(d.fx_volume, ["specimen"])
    return r6(H.decay_fit(profile, ["specimen"], value="background"), "a", "b", "c", "d")


@query("decay_fit_log", """WITH p AS (SELECT specimen, z, avg(CASE WHEN intensity < t THEN intensity END) AS y FROM fx_volume JOIN (SELECT specimen, z, least(max(intensity), avg(intensity) + 3 * stddev_pop(intensity)) AS t FROM fx_volume GROUP BY 1, 2) s USING (specimen, z) GROUP BY 1, 2)
SELECT specimen, CASE WHEN n >= 3 THEN round(a, 4) END AS a, CASE WHEN n >= 3 THEN round(b, 4) END AS b, CASE WHEN n >= 3 THEN true END AS converged FROM (SELECT specimen, count(*) AS n, regr_intercept(y, ln(1 + z)) AS a, regr_slope(y, ln(1 + z)) AS b FROM p WHERE y IS NOT NULL GROUP BY 1) f""")
def _(d):
    """The model that is linear in all its parameters."""
    fits = H.decay_fit(V.z_profile_nomask(d.fx_volume, ["specimen"]), ["specimen"], "logarithmic", "background")
    return fits.withColumns({c: F.round(c, 4) for c in "ab"})


def orders_sql(name: str, steps: str, excluded: str = "true") -> str:
    return f"""{name}_s AS ({steps}), {name}_o AS (SELECT [step] AS steps FROM {name}_s UNION ALL SELECT list_append({name}_o.steps, step) FROM {name}_o JOIN {name}_s ON NOT list_contains({name}_o.steps, step)),
{name} AS (SELECT row_number() OVER (ORDER BY n, s) - 1 AS place, s FROM (SELECT len(steps) AS n, array_to_string(steps, ',') AS s FROM {name}_o WHERE {excluded} UNION ALL SELECT 0, '') t)"""


FIRST, LAST, THR = "SELECT DISTINCT l_returnflag AS step FROM lineitem", "SELECT DISTINCT event_type AS step FROM events", "SELECT DISTINCT round(dice, 1) AS thr FROM fx_quality"


@query("config_grid", f"""WITH {orders_sql("a", FIRST)}, {orders_sql("b", LAST, "NOT (list_contains(steps, 'click') AND list_contains(steps, 'view'))")}
SELECT concat('pipeline_2D_thr_', CAST(thr AS VARCHAR), '_', a.place, '_', b.place) AS name, a.s AS before, b.s AS after, thr FROM a CROSS JOIN b CROSS JOIN ({THR}) t""", recursive=True)
def _(d):
    """Orders of the steps that the tables name, before and after, with the distinct thresholds of the quality rows."""
    grid = H.config_grid(H.step_orders(d.sql(FIRST)), H.step_orders(d.sql(LAST), [("click", "view")]), {"thr": d.sql(THR)}, "pipeline_2D")
    return grid.select("name", F.concat_ws(",", "before").alias("before"), F.concat_ws(",", "after").alias("after"), "thr")
