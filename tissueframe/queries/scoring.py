"""Queries of segmentation scores and of the quality table."""

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators.graph import components
from ..workspace import Workspace
from .registry import query

BY = ["specimen"]
OVERLAP = """ov AS (SELECT specimen, pred, gt, n, sum(n) OVER (PARTITION BY specimen, pred) AS n_pred, sum(n) OVER (PARTITION BY specimen, gt) AS n_gt
  FROM (SELECT specimen, pred, gt, count(*) AS n FROM fx_volume GROUP BY 1, 2, 3) c)"""


def overlap(d, by=BY):
    return S.label_overlap(d.fx_volume, by)


@query("label_overlap", f"""WITH {OVERLAP} SELECT specimen, pred, gt, n, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_gt AS BIGINT) AS n_gt, round(n/n_pred, 6) AS pred_in_gt, round(n/n_gt, 6) AS gt_in_pred, round(n/(n_pred+n_gt-n), 6) AS jaccard FROM ov""")
def _(d):
    r = overlap(d)
    return r.select("specimen", "pred", "gt", "n", "n_pred", "n_gt", *[F.round(c, 6).alias(c) for c in ("pred_in_gt", "gt_in_pred", "jaccard")])


@query("best_match", f"""WITH {OVERLAP} SELECT specimen, gt, pred, n FROM (SELECT *, row_number() OVER (PARTITION BY specimen, gt ORDER BY n DESC, pred) AS r FROM ov WHERE pred <> 0 AND gt <> 0) t WHERE r = 1""")
def _(d):
    return S.best_match(overlap(d).filter("pred <> 0 AND gt <> 0"), ["specimen", "gt"], "n", "pred").select("specimen", "gt", "pred", "n")


DICE = f"""{OVERLAP},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY specimen, gt ORDER BY n/n_gt DESC, pred) AS r FROM ov WHERE pred <> 0 AND gt <> 0 AND n/n_gt > 0.3) t WHERE r = 1),
cells AS (SELECT a.specimen, a.gt, coalesce(b.pred, 0) AS pred, coalesce(2*b.n/(b.n_pred+b.n_gt), 0e0) AS dice FROM (SELECT DISTINCT specimen, gt FROM ov WHERE gt <> 0) a LEFT JOIN best b USING (specimen, gt))"""


@query("dice", f"WITH {DICE} SELECT specimen, round(avg(dice), 6) AS dice FROM cells GROUP BY 1")
def _(d):
    return S.dice(overlap(d), BY).select("specimen", F.round("dice", 6).alias("dice"))


@query("volume_jaccard", f"""WITH {OVERLAP}, best AS (SELECT specimen, gt, max(n/(n_pred+n_gt-n)) AS j FROM ov WHERE pred <> 0 AND gt <> 0 GROUP BY 1, 2)
SELECT specimen, round(sum(coalesce(j, 0e0)*n_gt)/sum(n_gt), 6) AS vji FROM (SELECT DISTINCT specimen, gt, n_gt FROM ov WHERE gt <> 0) a LEFT JOIN best USING (specimen, gt) GROUP BY 1""")
def _(d):
    return S.volume_jaccard(overlap(d), BY).select("specimen", F.round("vji", 6).alias("vji"))


BYPRED = f"""{OVERLAP},
best AS (SELECT * FROM (SELECT *, n/(n_pred+n_gt-n) AS j, row_number() OVER (PARTITION BY specimen, pred ORDER BY n/(n_pred+n_gt-n) DESC, gt) AS r FROM ov WHERE pred <> 0 AND gt <> 0) t WHERE r = 1),
assoc AS (SELECT specimen, gt, n_gt, j FROM best UNION ALL
  SELECT DISTINCT specimen, gt, n_gt, 0e0 FROM ov WHERE gt <> 0 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.specimen = ov.specimen AND b.gt = ov.gt))"""


@query("jaccard_by_pred", f"WITH {BYPRED} SELECT specimen, round(avg(j), 6) AS jaccard FROM assoc GROUP BY 1")
def _(d):
    return S.jaccard_by_pred(overlap(d), BY).select("specimen", F.round("jaccard", 6).alias("jaccard"))


@query("vji_by_pred", f"WITH {BYPRED} SELECT specimen, round(sum(j*n_gt)/sum(n_gt), 6) AS vji FROM assoc GROUP BY 1")
def _(d):
    return S.vji_by_pred(overlap(d), BY).select("specimen", F.round("vji", 6).alias("vji"))


@query("dice_by_pred", f"WITH {BYPRED} SELECT specimen, round(avg(2*n/(n_pred+n_gt)), 6) AS dice FROM best GROUP BY 1")
def _(d):
    return S.dice_by_pred(overlap(d), BY).select("specimen", F.round("dice", 6).alias("dice"))


def states_sql(group: str) -> str:
    """Cells with the states of their groups, of volumes told apart by the columns ``group`` of ``ov``."""
    return f"""t0 AS (SELECT *, n/n_pred AS s FROM ov WHERE pred <> 0 AND n/n_pred > 0.5), r0 AS (SELECT *, n/n_gt AS s FROM ov WHERE gt <> 0 AND n/n_gt > 0.5),
tb AS (SELECT {group}, pred FROM t0 WHERE gt = 0 AND s > 0.6), rb AS (SELECT {group}, gt FROM r0 WHERE pred = 0 AND s > 0.6),
links AS (SELECT {group}, pred, gt FROM t0 WHERE gt <> 0 AND ({group}, pred) NOT IN (SELECT {group}, pred FROM tb)
  UNION SELECT {group}, pred, gt FROM r0 WHERE pred <> 0 AND ({group}, gt) NOT IN (SELECT {group}, gt FROM rb)),
nodes AS (SELECT DISTINCT {group}, 'target' AS side, pred AS label FROM links UNION SELECT DISTINCT {group}, 'reference', gt FROM links),
reach AS (SELECT {group}, side, label, side AS s2, label AS l2 FROM nodes UNION
  SELECT reach.{group}, reach.side, reach.label, CASE WHEN s2 = 'target' THEN 'reference' ELSE 'target' END, CASE WHEN s2 = 'target' THEN links.gt ELSE links.pred END
  FROM reach JOIN links ON links.{group} = reach.{group} AND l2 = CASE WHEN s2 = 'target' THEN links.pred ELSE links.gt END),
sizes AS (SELECT {group}, side, label, sum(CASE WHEN s2 = 'target' THEN 1 ELSE 0 END) AS t, sum(CASE WHEN s2 = 'reference' THEN 1 ELSE 0 END) AS r FROM reach GROUP BY 1, 2, 3),
states AS (SELECT {group}, side, label, CASE WHEN t = 1 AND r = 1 THEN 'correct' WHEN t = 1 THEN 'under_segmented' WHEN r = 1 THEN 'over_segmented' ELSE 'confused' END AS state FROM sizes
  UNION ALL SELECT {group}, 'target', pred, 'background' FROM tb UNION ALL SELECT {group}, 'reference', gt, 'missing' FROM rb)"""


def stats_sql(group: str) -> str:
    share = ", ".join(f"round(100*sum(CASE WHEN side = 'target' AND state = '{s}' THEN 1 ELSE 0 END)/sum(CASE WHEN side = 'target' AND state <> 'background' THEN 1 ELSE 0 END), 2) AS {s}" for s in ("correct", "under_segmented", "over_segmented", "confused"))
    return f"""SELECT {group}, {share}, CAST(sum(CASE WHEN side = 'target' AND state <> 'background' THEN 1 ELSE 0 END) AS BIGINT) AS total,
round(100*sum(CASE WHEN state = 'missing' THEN 1 ELSE 0 END)/sum(CASE WHEN side = 'reference' THEN 1 ELSE 0 END), 2) AS missing FROM states GROUP BY 1"""


@query("segmentation_states", f"WITH {OVERLAP}, {states_sql('specimen')} SELECT * FROM states", recursive=True)
def _(d):
    return S.segmentation_states(Workspace(d.spark).write(overlap(d)), BY)


@query("segmentation_stats", f"WITH {OVERLAP}, {states_sql('specimen')} {stats_sql('specimen')}", recursive=True)
def _(d):
    return S.segmentation_stats(Workspace(d.spark).write(overlap(d)), BY)


@query("connected_components", """WITH e AS (SELECT DISTINCT specimen * 1000000 + pred AS u, specimen * 1000000 + 500000 + gt AS v FROM fx_volume WHERE pred <> 0 AND gt <> 0),
sym AS (SELECT u, v FROM e UNION SELECT v, u FROM e), reach AS (SELECT u AS node, u AS seen FROM sym UNION SELECT reach.node, sym.v FROM reach JOIN sym ON sym.u = reach.seen)
SELECT node, min(seen) AS component FROM reach GROUP BY 1""", recursive=True)
def _(d):
    e = d.sql("SELECT DISTINCT specimen * 1000000 + pred AS u, specimen * 1000000 + 500000 + gt AS v FROM fx_volume WHERE pred <> 0 AND gt <> 0")
    return components(e)


#: The same volume under three treatments, as configurations of a sweep.
SWEEP = "SELECT c.test_name, pred * CASE WHEN c.test_name = 2 AND pred % 2 = 0 THEN 0 ELSE 1 END AS pred, CASE WHEN c.test_name = 3 AND gt % 5 = 0 THEN 0 ELSE gt END AS gt FROM fx_volume CROSS JOIN (SELECT CAST(1 AS BIGINT) AS test_name UNION ALL SELECT 2 UNION ALL SELECT 3) c"


@query("quality_sweep", f"""WITH sweep AS ({SWEEP}), {OVERLAP.replace('specimen', 'test_name').replace('fx_volume', 'sweep')}, {states_sql('test_name')}, stats AS ({stats_sql('test_name')}),
{DICE.split('best AS', 1)[1].join(['best AS', '']).replace('specimen', 'test_name')}, jb AS (SELECT test_name, gt, max(n/(n_pred+n_gt-n)) AS j FROM ov WHERE pred <> 0 AND gt <> 0 GROUP BY 1, 2),
vj AS (SELECT test_name, round(sum(coalesce(j, 0e0)*n_gt)/sum(n_gt), 6) AS vji FROM (SELECT DISTINCT test_name, gt, n_gt FROM ov WHERE gt <> 0) a LEFT JOIN jb USING (test_name, gt) GROUP BY 1)
SELECT stats.*, dice, vji FROM stats JOIN (SELECT test_name, round(avg(dice), 6) AS dice FROM cells GROUP BY 1) d USING (test_name) JOIN vj USING (test_name)""", recursive=True)
def _(d):
    o = Workspace(d.spark).write(S.label_overlap(d.sql(SWEEP), ["test_name"]))
    by = ["test_name"]
    return S.segmentation_stats(o, by).join(S.dice(o, by).select("test_name", F.round("dice", 6).alias("dice")), by).join(S.volume_jaccard(o, by).select("test_name", F.round("vji", 6).alias("vji")), by)


@query("boundary_f1", """WITH b AS (SELECT 'pred' AS side, specimen, x, y, z FROM fx_volume v WHERE pred <> 0 AND (SELECT count(*) FROM fx_volume w WHERE w.specimen = v.specimen AND w.z = v.z AND w.pred = v.pred AND abs(w.x - v.x) + abs(w.y - v.y) = 1) < 4
  UNION ALL SELECT 'gt', specimen, x, y, z FROM fx_volume v WHERE gt <> 0 AND (SELECT count(*) FROM fx_volume w WHERE w.specimen = v.specimen AND w.z = v.z AND w.gt = v.gt AND abs(w.x - v.x) + abs(w.y - v.y) = 1) < 4),
h AS (SELECT a.side, a.specimen, a.x, a.y, a.z, max(CASE WHEN c.x IS NULL THEN 0e0 ELSE 1e0 END) AS hit FROM b a LEFT JOIN b c ON c.specimen = a.specimen AND c.z = a.z AND c.side <> a.side AND (c.x-a.x)*(c.x-a.x) + (c.y-a.y)*(c.y-a.y) < 4 GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT specimen, avg(CASE WHEN side = 'pred' THEN hit END) AS precision_, avg(CASE WHEN side = 'gt' THEN hit END) AS recall_ FROM h GROUP BY 1)
SELECT specimen, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(2*precision_*recall_/(precision_+recall_), 6) AS f1 FROM p""")
def _(d):
    r = S.boundary_f1(d.fx_volume, BY)
    return r.select("specimen", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("dice_adjusted", f"WITH {DICE}, q AS (SELECT specimen, round(avg(dice), 6) AS dice FROM cells GROUP BY 1) SELECT q.specimen, q.dice, round(a.v, 6) AS dice_adjusted FROM q LEFT JOIN (SELECT specimen, avg(dice) AS v FROM cells WHERE dice > 0 GROUP BY 1) a USING (specimen)")
def _(d):
    cells = S.dice_cells(overlap(d), BY)
    q = cells.groupBy("specimen").agg(F.round(F.avg("dice"), 6).alias("dice"))
    return S.dice_adjusted(q, cells, BY).select("specimen", "dice", F.round("dice_adjusted", 6).alias("dice_adjusted"))


@query("adjust_percent", "SELECT test_name, round(correct*n_cells/188, 6) AS correct, round(missing*n_cells/188, 6) AS missing, round(n_cells/188e0, 6) AS labels_ratio FROM fx_quality")
def _(d):
    r = S.adjust_percent(d.fx_quality, ["correct", "missing"], 188)
    return r.select("test_name", *[F.round(c, 6).alias(c) for c in ("correct", "missing", "labels_ratio")])


METRICS = ["dice", "jaccard", "correct", "missing", "over_segmented"]
COV = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in METRICS) + "]" for a in METRICS)
# The first principal component by power iteration on the covariance matrix, 400 rounds.
PC = f"""c AS (SELECT [{COV}] AS m FROM fx_quality), it AS (SELECT 0 AS k, [1e0, 1e0, 1e0, 1e0, 1e0] AS v UNION ALL SELECT k + 1, list_transform(w, lambda x: x / n) FROM (SELECT k, w, sqrt(list_dot_product(w, w)) AS n FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM it, c) a WHERE k < 400) b),
pc AS (SELECT list_transform(v, lambda x: CASE WHEN v[1] >= 0 THEN x ELSE -x END) AS v FROM it WHERE k = 400)"""


@query("quality_score", f"""WITH {PC}, mu AS (SELECT {', '.join(f'avg({m}) AS {m}_' for m in METRICS)} FROM fx_quality), s AS (SELECT test_name, {' + '.join(f'({m} - {m}_) * v[{i + 1}]' for i, m in enumerate(METRICS))} AS pc1 FROM fx_quality, mu, pc)
SELECT test_name, round(pc1, 5) AS pc1, round((pc1 - (SELECT min(pc1) FROM s)) / ((SELECT max(pc1) FROM s) - (SELECT min(pc1) FROM s)), 5) AS score FROM s""", recursive=True)
def _(d):
    out = S.quality_score(d.fx_quality, METRICS, "test_name")
    return out.select("test_name", F.round("pc1", 5).alias("pc1"), F.round("score", 5).alias("score"))


@query("ordered_loadings", f"""WITH {PC}, l AS (SELECT unnest({METRICS}) AS metric, unnest(v) AS loading, sqrt(list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), list_transform(m, lambda r: list_dot_product(r, v)))) / ({' + '.join(f'm[{i}][{i}]' for i in range(1, 6))}) AS explained FROM pc, c)
SELECT metric, round(loading, 5) AS loading, round(explained, 5) AS explained, row_number() OVER (ORDER BY abs(loading) DESC, metric) AS place FROM l""", recursive=True)
def _(d):
    out = S.quality_loadings(d.fx_quality, METRICS)
    return out.select("metric", F.round("loading", 5).alias("loading"), F.round("explained", 5).alias("explained"), "place")


EDGE = "(SELECT '{s}' AS side, v.specimen, v.{s} AS label, v.x, v.y, v.z FROM fx_volume v LEFT JOIN fx_volume w ON w.specimen = v.specimen AND w.z = v.z AND w.{s} = v.{s} AND abs(w.x - v.x) + abs(w.y - v.y) = 1 AND w.x BETWEEN v.x - 1 AND v.x + 1 WHERE v.{s} <> 0 GROUP BY ALL HAVING count(w.x) < 4)"


@query("boundary_f1_weighted", f"""WITH {BYPRED.replace("SELECT specimen, gt, n_gt, j FROM best", "SELECT specimen, pred, gt, n_gt, j FROM best").replace("SELECT DISTINCT specimen, gt, n_gt, 0e0", "SELECT DISTINCT specimen, 0, gt, n_gt, 0e0")}, pr AS (SELECT specimen, gt, min(pred) AS pred FROM assoc GROUP BY 1, 2 HAVING min(pred) <> 0),
a AS (SELECT e.specimen, pr.gt, x, y, z FROM {EDGE.format(s='pred')} e JOIN pr ON pr.specimen = e.specimen AND pr.pred = e.label), b AS (SELECT e.specimen, pr.gt, x, y, z FROM {EDGE.format(s='gt')} e JOIN pr ON pr.specimen = e.specimen AND pr.gt = e.label),
pc_ AS (SELECT specimen, gt, avg(hit) AS p FROM (SELECT a.specimen, a.gt, a.x, a.y, a.z, max(CASE WHEN b.x IS NULL THEN 0e0 ELSE 1e0 END) AS hit FROM a LEFT JOIN b ON b.specimen = a.specimen AND b.gt = a.gt AND b.z = a.z AND (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) < 4 GROUP BY 1, 2, 3, 4, 5) t GROUP BY 1, 2),
rc AS (SELECT specimen, gt, avg(hit) AS r FROM (SELECT b.specimen, b.gt, b.x, b.y, b.z, max(CASE WHEN a.x IS NULL THEN 0e0 ELSE 1e0 END) AS hit FROM b LEFT JOIN a ON b.specimen = a.specimen AND b.gt = a.gt AND b.z = a.z AND (b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) < 4 GROUP BY 1, 2, 3, 4, 5) t GROUP BY 1, 2),
f AS (SELECT assoc.specimen, assoc.n_gt, coalesce(CASE WHEN p + r > 0 THEN 2*p*r/(p + r) ELSE 0e0 END, 0e0) AS f1 FROM assoc LEFT JOIN pc_ ON pc_.specimen = assoc.specimen AND pc_.gt = assoc.gt LEFT JOIN rc ON rc.specimen = assoc.specimen AND rc.gt = assoc.gt)
SELECT specimen, round(avg(f1), 6) AS f1, round(sum(f1*n_gt)/sum(n_gt), 6) AS f1_weighted FROM f GROUP BY 1""")
def _(d):
    cells = S.boundary_f1_cells(d.fx_volume, overlap(d), BY)
    return S.boundary_f1_weighted(cells, BY).select("specimen", *[F.round(c, 6).alias(c) for c in ("f1", "f1_weighted")])
