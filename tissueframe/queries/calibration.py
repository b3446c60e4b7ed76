"""Queries of calibration, votes and samples."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import calibration as K
from ..operators import voting as V
from .registry import query
from .voxels import r6

P = "prd AS (SELECT id, slice, area, y_true, z0, z1, z2, exp(z0-m)/s AS p0, exp(z1-m)/s AS p1, exp(z2-m)/s AS p2 FROM (SELECT *, exp(z0-m)+exp(z1-m)+exp(z2-m) AS s FROM (SELECT *, greatest(z0, z1, z2) AS m FROM fx_pred) a) b)"
A = "arg AS (SELECT *, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS y_pred, greatest(p0, p1, p2) AS confidence FROM prd)"


def z(d):
    return d.fx_pred.select("id", "slice", "area", "y_true", F.array("z0", "z1", "z2").alias("z"))


def pred(d):
    return z(d).withColumn("probs", C.softmax(F.col("z")))


def flat(df, *keys, col="probs"):
    return df.select(*keys, *[F.round(F.col(col)[i], 6).alias(f"p{i}") for i in range(3)])


def soft(z0, z1, z2):
    return f"SELECT id, slice, round(exp(a)/(exp(a)+exp(b)+exp(c)), 6) AS p0, round(exp(b)/(exp(a)+exp(b)+exp(c)), 6) AS p1, round(exp(c)/(exp(a)+exp(b)+exp(c)), 6) AS p2 FROM (SELECT id, slice, {z0} AS a, {z1} AS b, {z2} AS c FROM fx_pred) t"


@query("calibrate_temperature", soft("z0/1.5", "z1/1.5", "z2/1.5"))
def _(d):
    return flat(z(d).withColumn("probs", K.temperature(F.col("z"), 1.5)), "id", "slice")


@query("calibrate_vector", soft("z0*0.9e0+0.1", "z1*1.1e0", "z2-0.1"))
def _(d):
    return flat(z(d).withColumn("probs", K.vector_scaling(F.col("z"), [0.9, 1.1, 1.0], [0.1, 0.0, -0.1])), "id", "slice")


@query("calibrate_matrix", soft("z0*0.9e0+z1*0.1e0+0.1", "z1*0.8e0+z2*0.2e0", "z2+z0*0.05e0-0.1"))
def _(d):
    return flat(z(d).withColumn("probs", K.matrix_scaling(F.col("z"), [[0.9, 0.0, 0.05], [0.1, 0.8, 0.0], [0.0, 0.2, 1.0]], [0.1, 0.0, -0.1])), "id", "slice")


@query("calibrate_dirichlet", f"WITH {P} SELECT id, slice, round(a/(a+b+c), 6) AS p0, round(b/(a+b+c), 6) AS p1, round(c/(a+b+c), 6) AS p2 FROM (SELECT id, slice, power(p0, ln(1+exp(0.5e0))) AS a, power(p1, ln(1+exp(1e0))) AS b, power(p2, ln(1+exp(0e0))) AS c FROM prd) t")
def _(d):
    return flat(pred(d).withColumn("probs", K.dirichlet(F.col("probs"), [0.5, 1.0, 0.0])), "id", "slice")


@query("argmax_class", f"WITH {P}, {A} SELECT id, slice, y_pred, round(confidence, 6) AS confidence FROM arg")
def _(d):
    return r6(K.argmax_class(pred(d)).select("id", "slice", "y_pred", "confidence"), "confidence")


@query("class_names", "SELECT id, slice, CASE y_true WHEN 0 THEN 'Prophase/Metaphase' WHEN 1 THEN 'Anaphase/Telophase' ELSE 'Interphase' END AS class_name, CASE WHEN y_true = 0 THEN 1e0 ELSE 0e0 END AS h0, CASE WHEN y_true = 1 THEN 1e0 ELSE 0e0 END AS h1, CASE WHEN y_true = 2 THEN 1e0 ELSE 0e0 END AS h2 FROM fx_pred")
def _(d):
    h = K.one_hot(F.col("y_true"), 3)
    return K.class_names(d.fx_pred).select("id", "slice", "class_name", *[h[i].alias(f"h{i}") for i in range(3)])


@query("image_names", "SELECT id, slice, lpad(CAST(id AS VARCHAR), CAST(greatest(3, length(CAST(id AS VARCHAR))) AS INTEGER), '0') || '.tif' AS name, lpad(CAST(id AS VARCHAR), CAST(greatest(3, length(CAST(id AS VARCHAR))) AS INTEGER), '0') || '_' || slice || '.tif' AS slice_name FROM fx_pred")
def _(d):
    return d.fx_pred.select("id", "slice", C.image_name(F.col("id")).alias("name"), C.image_name(F.col("id"), F.col("slice")).alias("slice_name"))


@query("ece", f"WITH {P}, {A} SELECT slice, round(sum(n*gap)/sum(n), 6) AS ece FROM (SELECT slice, ceil(confidence*15)-1 AS b, count(*) AS n, abs(avg(CASE WHEN y_pred = y_true THEN 1e0 ELSE 0e0 END) - avg(confidence)) AS gap FROM arg GROUP BY 1, 2) t GROUP BY 1")
def _(d):
    return r6(K.ece(pred(d), ["slice"]), "ece")


@query("reliability_curve", f"WITH {P}, {A} SELECT slice, CAST(least(floor(confidence*10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN y_pred = y_true THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(confidence), 6) AS confidence FROM arg GROUP BY 1, 2")
def _(d):
    return r6(K.reliability_curve(pred(d), ["slice"]), "accuracy", "confidence")


@query("confidence_histogram", f"WITH {P}, {A}, t AS (SELECT count(*) AS t, avg(confidence) AS m, avg(CASE WHEN y_pred = y_true THEN 1e0 ELSE 0e0 END) AS a FROM arg) SELECT CAST(least(floor(confidence*10), 9) AS BIGINT) AS bin, count(*) AS n, round(count(*)/max(t), 6) AS share, round(max(m), 6) AS mean_confidence, round(max(a), 6) AS accuracy FROM arg CROSS JOIN t GROUP BY 1")
def _(d):
    return r6(K.confidence_histogram(pred(d), []), "share", "mean_confidence", "accuracy")


@query("nll_brier", f"WITH {P} SELECT slice, round(avg(-ln(CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS nll, round(avg((power(p0-CASE WHEN y_true=0 THEN 1 ELSE 0 END, 2)+power(p1-CASE WHEN y_true=1 THEN 1 ELSE 0 END, 2)+power(p2-CASE WHEN y_true=2 THEN 1 ELSE 0 END, 2))/3), 6) AS brier FROM prd GROUP BY 1")
def _(d):
    return r6(K.nll_brier(pred(d), ["slice"]), "nll", "brier")


@query("confusion_matrix", f"WITH {P}, {A} SELECT y_true, y_pred, count(*) AS n, round(count(*)/sum(count(*)) OVER (), 6) AS share FROM arg GROUP BY 1, 2")
def _(d):
    return r6(K.confusion_matrix(pred(d), []), "share")


@query("classification_report", f"""WITH {P}, {A}, c AS (SELECT CAST(c AS INTEGER) AS class, sum(CASE WHEN y_true = c AND y_pred = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_pred = c THEN 1 ELSE 0 END) AS said, CAST(sum(CASE WHEN y_true = c THEN 1 ELSE 0 END) AS BIGINT) AS support FROM arg CROSS JOIN (SELECT unnest(range(3)) AS c) k GROUP BY 1),
r AS (SELECT class, support, CASE WHEN said > 0 THEN tp/said ELSE 0e0 END AS p, CASE WHEN support > 0 THEN tp/support ELSE 0e0 END AS r FROM c) SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p+r > 0 THEN 2*p*r/(p+r) ELSE 0e0 END, 6) AS f1 FROM r""")
def _(d):
    return r6(K.classification_report(pred(d), []), "precision", "recall", "f1")


@query("multilabel_auc", f"""WITH {P}, l AS (SELECT 0 AS class, p0 AS p, y_true = 0 AS y FROM prd UNION ALL SELECT 1, p1, y_true = 1 FROM prd UNION ALL SELECT 2, p2, y_true = 2 FROM prd),
r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY p) + (count(*) OVER (PARTITION BY class, p) - 1) / 2e0 AS r FROM l)
SELECT CAST(class AS INTEGER) AS class, round((sum(CASE WHEN y THEN r ELSE 0 END) - sum(CASE WHEN y THEN 1 ELSE 0 END)*(sum(CASE WHEN y THEN 1 ELSE 0 END)+1)/2e0)/(sum(CASE WHEN y THEN 1 ELSE 0 END)*sum(CASE WHEN y THEN 0 ELSE 1 END)), 6) AS auc FROM r GROUP BY 1""")
def _(d):
    return r6(K.multilabel_auc(pred(d), []), "auc")


Y = "(CASE WHEN y_true={0} THEN 1e0 ELSE 0e0 END)"
T = "tot AS (SELECT count(*) AS n, " + ", ".join(f"sum({Y.format(i)}) AS t{i}" for i in range(3)) + " FROM fx_pred)"


def labelled(d):
    return pred(d).withColumn("y", K.one_hot(F.col("y_true"), 3))


@query("weighted_ce", f"WITH {T} SELECT round(avg((" + " + ".join(f"(1-{Y.format(i)})*z{i} + (1+(w-1)*{Y.format(i)})*(ln(1+exp(-abs(z{i})))+greatest(-z{i}, 0e0))" for i in range(3)) + ")/3), 6) AS weighted_ce FROM fx_pred CROSS JOIN (SELECT 1/((t0+t1+t2)/(3*n)+1e-9) AS w FROM tot) k")
def _(d):
    return r6(K.weighted_ce(labelled(d)), "weighted_ce")


def ext(q):
    return "round(-avg((" + " + ".join(f"n/(t{i}+1e-6)*{Y.format(i)}*ln({q.format(i)}+1e-6) + n/(n-t{i}+1e-6)*(1-{Y.format(i)})*ln(1-{q.format(i)}+1e-6)" for i in range(3)) + ")/3), 6)"


@query("extended_weighted_ce", f"WITH {P}, {T} SELECT {ext('p{0}')} AS on_probs, {ext('(1/(1+exp(-z{0})))')} AS on_logits FROM prd CROSS JOIN tot")
def _(d):
    a, b = K.extended_weighted_ce(labelled(d)), K.extended_weighted_ce(labelled(d), p="z", logits=True)
    return r6(a.withColumnRenamed("extended_ce", "on_probs").crossJoin(b.withColumnRenamed("extended_ce", "on_logits")), "on_probs", "on_logits")


@query("multiclass_ce", f"WITH {P}, {T} SELECT round(avg(-(" + " + ".join(f"{Y.format(i)}*ln(p{i}+1e-6)*n/(t{i}+1e-6)" for i in range(3)) + ")), 6) AS multiclass_ce FROM prd CROSS JOIN tot")
def _(d):
    return r6(K.multiclass_ce(labelled(d)), "multiclass_ce")


@query("soft_ce", f"WITH {P}, {T} SELECT round(avg((greatest(t0,t1,t2)/(t0+1e-6)+greatest(t0,t1,t2)/(t1+1e-6)+greatest(t0,t1,t2)/(t2+1e-6)) * -(" + " + ".join(f"{Y.format(i)}*ln(greatest(least(p{i}, 1-1e-7), 1e-7))" for i in range(3)) + ")), 6) AS soft_ce FROM prd CROSS JOIN tot")
def _(d):
    return r6(K.soft_ce(labelled(d)), "soft_ce")


def focal(i):
    y, q = Y.format(i), f"greatest(least(p{i}, 1-1e-7), 1e-7)"
    pt = f"({y}*{q}+(1-{y})*(1-{q}))"
    return f"-({y}*0.25+(1-{y})*0.75)*power(1-{pt}, 2)*ln({pt})"


@query("focal_loss", f"WITH {P} SELECT round(avg(({focal(0)} + {focal(1)} + {focal(2)})/3), 6) AS focal_loss FROM prd")
def _(d):
    return r6(K.focal_loss(labelled(d)), "focal_loss")


@query("lse_pool", "SELECT id, round(max(m) + ln(avg(exp(10*(z0-m))))/10, 6) AS lse FROM (SELECT id, z0, max(z0) OVER (PARTITION BY id) AS m FROM fx_pred) t GROUP BY 1")
def _(d):
    return r6(K.lse_pool(d.fx_pred, ["id"], "z0"), "lse")


@query("fit_temperature", """WITH g AS (SELECT unnest([0.5e0, 1e0, 1.5e0, 2e0, 3e0, 5e0, 8e0, 12e0]) AS t), n AS (SELECT t, avg(ln(exp((z0-m)/t)+exp((z1-m)/t)+exp((z2-m)/t)) - (CASE y_true WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END - m)/t) AS nll FROM (SELECT *, greatest(z0, z1, z2) AS m FROM fx_pred) p CROSS JOIN g GROUP BY 1)
SELECT t AS temperature, round(nll, 6) AS nll FROM n ORDER BY n.nll, t LIMIT 1""")
def _(d):
    return r6(K.fit_temperature(z(d), [0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0, 12.0]), "nll")


@query("fit_vector")
def _(d):
    """Vector scaling and Dirichlet calibration of the logits: parameters, and the mean log-likelihood they reach."""
    scales, bias = K.fit_vector(z(d))
    alphas = K.fit_dirichlet(pred(d))
    both = {"vector": K.vector_scaling(F.col("z"), scales, bias), "dirichlet": K.dirichlet(C.softmax(F.col("z")), alphas), "none": C.softmax(F.col("z"))}
    out = K.calibration_table(z(d), both)
    given = d.spark.createDataFrame([("vector", scales, bias), ("dirichlet", alphas, [0.0] * 3), ("none", [1.0] * 3, [0.0] * 3)], "method string, scales array<double>, bias array<double>")
    return r6(out.join(given, "method").select("method", "nll", "ece", *[F.round(F.col(c)[i], 4).alias(f"{c}{i}") for c in ("scales", "bias") for i in range(3)]), "nll", "ece")


@query("fit_matrix")
def _(d):
    return K.fit_matrix(pred(d)).select("class", *[F.round(F.col("weights")[i], 3).alias(f"w{i}") for i in range(3)], F.round("bias", 3).alias("bias"))


CAL = "prd AS (SELECT method, y_true, exp(z0/t-m)/s AS p0, exp(z1/t-m)/s AS p1, exp(z2/t-m)/s AS p2 FROM (SELECT *, exp(z0/t-m)+exp(z1/t-m)+exp(z2/t-m) AS s FROM (SELECT *, greatest(z0, z1, z2)/t AS m FROM fx_pred CROSS JOIN (SELECT 'none' AS method, 1e0 AS t UNION ALL SELECT 'temperature', 2e0) k) a) b)"


@query("calibration_table", f"""WITH {CAL}, {A}, e AS (SELECT method, sum(n*gap)/sum(n) AS ece FROM (SELECT method, ceil(confidence*15)-1 AS b, count(*) AS n, abs(avg(CASE WHEN y_pred = y_true THEN 1e0 ELSE 0e0 END) - avg(confidence)) AS gap FROM arg GROUP BY 1, 2) t GROUP BY 1),
n AS (SELECT method, avg(-ln(CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS nll, avg((power(p0-{Y.format(0)}, 2)+power(p1-{Y.format(1)}, 2)+power(p2-{Y.format(2)}, 2))/3) AS brier FROM prd GROUP BY 1),
l AS (SELECT method, 0 AS class, p0 AS p, y_true = 0 AS y FROM prd UNION ALL SELECT method, 1, p1, y_true = 1 FROM prd UNION ALL SELECT method, 2, p2, y_true = 2 FROM prd),
r AS (SELECT method, class, y, rank() OVER (PARTITION BY method, class ORDER BY p) + (count(*) OVER (PARTITION BY method, class, p) - 1) / 2e0 AS r FROM l),
a AS (SELECT method, class, (sum(CASE WHEN y THEN r ELSE 0 END) - sum(CASE WHEN y THEN 1 ELSE 0 END)*(sum(CASE WHEN y THEN 1 ELSE 0 END)+1)/2e0)/(sum(CASE WHEN y THEN 1 ELSE 0 END)*sum(CASE WHEN y THEN 0 ELSE 1 END)) AS auc FROM r GROUP BY 1, 2)
SELECT method, round(ece, 6) AS ece, round(nll, 6) AS nll, round(brier, 6) AS brier, round((SELECT avg(auc) FROM a WHERE a.method = e.method), 6) AS auc FROM e JOIN n USING (method)""")
def _(d):
    c = F.col("z")
    return r6(K.calibration_table(z(d), {"none": C.softmax(c), "temperature": K.temperature(c, 2.0)}), "ece", "nll", "brier", "auc")


def vote_sql(weight: str) -> str:
    return f"""w0 AS (SELECT *, {weight} AS w FROM prd), w1 AS (SELECT *, w / sum(w) OVER (PARTITION BY id) AS v FROM w0),
vote AS (SELECT *, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS y_pred, greatest(p0, p1, p2) AS confidence FROM (SELECT id, sum(v*p0) AS p0, sum(v*p1) AS p1, sum(v*p2) AS p2 FROM w1 GROUP BY 1) t)"""


AREA = vote_sql("CASE WHEN max(area) OVER (PARTITION BY id) > min(area) OVER (PARTITION BY id) THEN (area - min(area) OVER (PARTITION BY id))/(max(area) OVER (PARTITION BY id) - min(area) OVER (PARTITION BY id)) ELSE 1e0 END")
BELL = vote_sql("exp(-0.5e0*power((slice - floor(count(*) OVER (PARTITION BY id)/2))/(count(*) OVER (PARTITION BY id)/4e0), 2))")
VOTE = "id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, y_pred, round(confidence, 6) AS confidence"


def voted(df):
    return df.select("id", *[F.round(F.col("probs")[i], 6).alias(f"p{i}") for i in range(3)], "y_pred", F.round("confidence", 6).alias("confidence"))


@query("slice_vote", f"WITH {P}, {AREA} SELECT {VOTE} FROM vote")
def _(d):
    return voted(V.slice_vote(pred(d)))


@query("gaussian_vote", f"WITH {P}, {BELL} SELECT {VOTE} FROM vote")
def _(d):
    return voted(V.gaussian_vote(pred(d)))


UNDER = "SELECT id, y FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) AS r FROM {t}) a WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {t} GROUP BY y) b)"
IMAGES = "SELECT cell_id AS id, coalesce(cell_division, 2) AS y FROM fx_cells"


@query("undersample", f"WITH t AS ({IMAGES}) {UNDER.format(t='t')}")
def _(d):
    return V.undersample(d.sql(IMAGES), "y")


@query("stratified_split", f"""WITH t AS ({IMAGES}), r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) AS r, count(*) OVER (PARTITION BY y) AS n FROM t),
k AS (SELECT *, floor(n*0.2e0) AS a FROM r) SELECT id, y, CASE WHEN r <= a THEN 'test' WHEN r <= a + floor((n-a)*0.2e0) THEN 'valid' ELSE 'train' END AS split FROM k""")
def _(d):
    return V.stratified_split(d.sql(IMAGES), "y").select("id", "y", "split")


@query("pseudo_labels", f"WITH {P}, {BELL}, t AS (SELECT id, y_pred AS y, confidence FROM vote WHERE confidence > 0.5), u AS ({UNDER.format(t='t')}) SELECT u.id, u.y AS y_pred, round(confidence, 6) AS confidence FROM u JOIN t USING (id)")
def _(d):
    return r6(V.pseudo_labels(pred(d), 0.55, 2)[0].select("id", "y_pred", "confidence"), "confidence")


@query("explode_slices", f"WITH {P}, {BELL}, n AS (SELECT id, count(*) AS n FROM fx_pred GROUP BY 1) SELECT id || '_' || s AS name, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM vote JOIN n USING (id) JOIN (SELECT unnest(range(100)) AS s) k ON s < n")
def _(d):
    images = V.gaussian_vote(pred(d)).join(d.fx_pred.groupBy("id").agg(F.count("*").alias("n_slices")), "id")
    return flat(V.explode_slices(images), "name")


@query("union_labels", "SELECT cell_id AS id, cell_division AS label, NULL::DOUBLE AS confidence FROM fx_cells WHERE cell_division IS NOT NULL UNION ALL SELECT cell_id, 2, 5e-1 FROM fx_cells WHERE cell_division IS NULL")
def _(d):
    a = d.sql("SELECT cell_id AS id, cell_division AS label FROM fx_cells WHERE cell_division IS NOT NULL")
    b = d.sql("SELECT cell_id AS id, CAST(2 AS BIGINT) AS label, 5e-1 AS confidence FROM fx_cells WHERE cell_division IS NULL")
    return V.union_labels(a, b)


@query("anti_labelled", "SELECT DISTINCT id FROM fx_pred WHERE id NOT IN (SELECT cell_id FROM fx_cells WHERE cell_division = 1)")
def _(d):
    return d.fx_pred.select("id").distinct().join(d.fx_cells.filter("cell_division = 1").select(F.col("cell_id").alias("id")), "id", "left_anti")
