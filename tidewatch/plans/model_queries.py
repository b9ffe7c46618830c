"""Registered queries of models, inference and diagnostics, and SQL that says the same."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions import copulas, models
from tidewatch.functions.intensities import Intensity
from tidewatch.operators import curves, degradation, observations, recurrent
from tidewatch.plans import accelerated, cox, design, fit, regression, renewal, schedules, tree
from tidewatch.plans.queries import _CURVE, _DEG, _EV, _OBS, _RISK, _causes, _curve, _obs, _paths, _query, _read, _rec, shipments

_TIES = f"""{_OBS}, o AS (SELECT x, c, q, EXP(0.01 * q) AS w FROM obs),
k AS (SELECT x, SUM(w) AS s0, SUM(w * q) AS s1, SUM(w * q * q) AS s2, COUNT(*) FILTER (WHERE c = 0) AS d, SUM(CASE WHEN c = 0 THEN w ELSE 0 END) AS t0, SUM(CASE WHEN c = 0 THEN w * q ELSE 0 END) AS t1,
 SUM(CASE WHEN c = 0 THEN w * q * q ELSE 0 END) AS t2, SUM(CASE WHEN c = 0 THEN q ELSE 0 END) AS dq FROM o GROUP BY x),
r AS (SELECT x, d, dq, t0, t1, t2, SUM(s0) OVER w AS r0, SUM(s1) OVER w AS r1, SUM(s2) OVER w AS r2 FROM k WINDOW w AS (ORDER BY x DESC))"""


@_query(f"""WITH {_TIES}, e AS (SELECT *, UNNEST(range(d)) / d::DOUBLE AS f FROM r WHERE d > 0), a AS (SELECT r0 - f * t0 AS a0, r1 - f * t1 AS a1, r2 - f * t2 AS a2 FROM e)
SELECT ROUND((SELECT SUM(0.01 * dq) FROM r WHERE d > 0) - SUM(LN(a0)), 2) AS ll, ROUND((SELECT SUM(dq) FROM r WHERE d > 0) - SUM(a1 / a0), 3) AS u_0, ROUND(SUM(a2 / a0 - a1 / a0 * a1 / a0), 1) AS h_0_0 FROM a""")
def efron_terms(spark, sf_dir):
    t = regression.cox_terms(shipments(spark, sf_dir), "x", "c", ["q"], [0.01], ties="efron")
    return t.select(F.round("ll", 2).alias("ll"), F.round("u_0", 3).alias("u_0"), F.round("h_0_0", 1).alias("h_0_0"))


@_query("""SELECT CAST(0 AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS steps""")
def efron_regression(spark, sf_dir):
    """The score at the fitted coefficients, relative to the information: zero where the fit has ended."""
    own = shipments(spark, sf_dir)
    m = regression.fit_cox(own, "x", "c", ["q", "disc"], ties="efron")
    row = regression.cox_terms(own, "x", "c", m.names, list(m.beta), ties="efron").first()
    worst = max(abs(row[f"u_{i}"]) * m.covariance[i, i] ** 0.5 for i in range(2))
    return spark.createDataFrame([(float(round(worst, 4)) + 0.0, 0.0)], "score double, steps double")


_BASE = f"""{_TIES}, b AS (SELECT x, SUM(d / r0) OVER (ORDER BY x) AS hh, SUM(d / r0 * r1 / r0) OVER (ORDER BY x) AS bb, r1 / r0 AS m FROM r)"""


@_query(f"""WITH {_BASE}, p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS t, (p_partkey % 50) * 1.0 AS q FROM part)
SELECT p_partkey, ROUND(COALESCE(hh, 0) * EXP(0.01 * q), 7) AS "Hf", ROUND(EXP(-COALESCE(hh, 0) * EXP(0.01 * q)), 7) AS sf FROM p ASOF LEFT JOIN b ON p.t >= b.x""")
def cox_predictions(spark, sf_dir):
    base = regression.cox_baseline(shipments(spark, sf_dir), "x", "c", ["q"], [0.01])
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("t"), (F.col("p_partkey") % 50).cast("double").alias("q"))
    return cox.predict(base, rows, "t", ["q"], [0.01]).select("p_partkey", F.round("Hf", 7).alias("Hf"), F.round("sf", 7).alias("sf"))


@_query(f"""WITH {_BASE}, p AS (SELECT p_partkey AS u, CAST(p_size AS DOUBLE) AS t, (p_partkey % 50) * 1.0 AS q FROM part),
e AS (SELECT u, 0.0::DOUBLE AS xl, t AS xr, q FROM p UNION ALL SELECT u, t, t + 30, q + 10 FROM p),
j AS (SELECT e.*, COALESCE(b.hh, 0) AS h1 FROM e ASOF LEFT JOIN b ON e.xr >= b.x), l AS (SELECT j.*, COALESCE(b.hh, 0) AS h0 FROM j ASOF LEFT JOIN b ON j.xl >= b.x)
SELECT u AS p_partkey, xr, ROUND(SUM((h1 - h0) * EXP(0.01 * q)) OVER (PARTITION BY u ORDER BY xr), 7) AS "Hf" FROM l""")
def cox_path_predictions(spark, sf_dir):
    base = regression.cox_baseline(shipments(spark, sf_dir), "x", "c", ["q"], [0.01])
    t, q = F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")
    legs = F.explode(F.array(F.struct(F.lit(0.0).alias("xl"), t.alias("xr"), q.alias("q")), F.struct(t.alias("xl"), (t + 30).alias("xr"), (q + 10).alias("q"))))
    path = _read(spark, sf_dir, "part").select("p_partkey", legs.alias("e")).select("p_partkey", "e.*")
    return cox.predict_path(base, path, "p_partkey", ["q"], [0.01]).select("p_partkey", "xr", F.round("Hf", 7).alias("Hf"))


_SCORES = f"{_BASE}, sc AS (SELECT g, prio, (1 - c) * (q - m) - EXP(0.01 * q) * (q * hh - bb) AS s FROM obs JOIN b USING (x)), hx AS (SELECT SUM(d * (r2 / r0 - r1 / r0 * r1 / r0)) AS h FROM r WHERE d > 0)"


@_query(f"WITH {_SCORES} SELECT g, ROUND(SUM(s), 2) AS total, ROUND(MAX(s), 5) AS most, ROUND(SUM(s) / (SELECT h FROM hx), 8) AS moved FROM sc GROUP BY g")
def score_residuals(spark, sf_dir):
    own = shipments(spark, sf_dir)
    h = regression.cox_terms(own, "x", "c", ["q"], [0.01]).first().h_0_0
    out = cox.score_residuals(own, "x", "c", ["q"], [0.01])
    moved = cox.dfbeta(own, "x", "c", ["q"], [0.01], np.array([[1 / h]])).groupBy("g").agg(F.round(F.sum("dfbeta_q"), 8).alias("moved"))
    return out.groupBy("g").agg(F.round(F.sum("score_q"), 2).alias("total"), F.round(F.max("score_q"), 5).alias("most")).join(moved, "g")


@_query(f"WITH {_SCORES}, p AS (SELECT prio, SUM(s) AS s FROM sc GROUP BY prio) SELECT ROUND((SELECT SUM(s * s) FROM sc) / (h * h) * 1e6, 4) AS rows, ROUND((SELECT SUM(s * s) FROM p) / (h * h) * 1e6, 4) AS clusters FROM hx")
def robust_covariance(spark, sf_dir):
    own = shipments(spark, sf_dir)
    v = np.array([[1 / regression.cox_terms(own, "x", "c", ["q"], [0.01]).first().h_0_0]])
    both = [float(cox.robust_covariance(own, "x", "c", ["q"], [0.01], v, k)[0, 0]) * 1e6 for k in (None, "prio")]
    return spark.createDataFrame([tuple(both)], "rows double, clusters double").select(F.round("rows", 4).alias("rows"), F.round("clusters", 4).alias("clusters"))


@_query(f"""WITH {_TIES}, e AS (SELECT x, d, dq - d * r1 / r0 AS s, d * (r2 / r0 - r1 / r0 * r1 / r0) AS h, SUM(d) OVER (ORDER BY x) / SUM(d) OVER () AS g FROM r WHERE d > 0),
t AS (SELECT SUM(d) AS n, SUM(d * g) / SUM(d) AS gb, SUM(h) AS h FROM e), u AS (SELECT SUM((g - gb) * s) AS u, SUM(d * (g - gb) * (g - gb)) AS gg FROM e, t)
SELECT k AS covariate, ROUND(n * u * u / (gg * h), 4) AS statistic, CAST(1 AS INT) AS df FROM t, u, (SELECT UNNEST(['q', NULL]) AS k)""")
def proportionality(spark, sf_dir):
    return cox.proportionality(shipments(spark, sf_dir), "x", "c", ["q"], [0.01]).select("covariate", F.round("statistic", 4).alias("statistic"), "df")


@_query(f"""WITH {_OBS}, k AS (SELECT x, q, CASE WHEN c = 0 THEN prio END AS cause FROM obs), cs AS (SELECT UNNEST(['1-URGENT', '2-HIGH']) AS cause, UNNEST([0.01, -0.005]) AS b),
a AS (SELECT cs.cause, x, COUNT(*) FILTER (WHERE k.cause = cs.cause) AS d, SUM(EXP(b * q)) AS s, ANY_VALUE(b) AS b FROM k, cs GROUP BY 1, 2),
h AS (SELECT cause, x, d / SUM(s) OVER (PARTITION BY cause ORDER BY x DESC) * EXP(b * 25) AS h FROM a),
c AS (SELECT *, SUM(h) OVER (PARTITION BY cause ORDER BY x) AS hh FROM h), s AS (SELECT x, EXP(-SUM(hh)) AS s FROM c GROUP BY x)
SELECT cause, x, ROUND(hh, 7) AS cum_hazard, ROUND(s, 7) AS sf, ROUND(SUM(h * s) OVER (PARTITION BY cause ORDER BY x), 7) AS cif FROM c JOIN s USING (x)""")
def cause_specific_incidence(spark, sf_dir):
    out = cox.cause_specific_incidence(_causes(spark, sf_dir), "x", "cause", ["q"], {"1-URGENT": [0.01], "2-HIGH": [-0.005]}, [25.0])
    return out.select("cause", "x", F.round("cum_hazard", 7).alias("cum_hazard"), F.round("sf", 7).alias("sf"), F.round("cif", 7).alias("cif"))


_WEIBULL_LIMITS = """p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part), s AS (SELECT *, EXP(-POW(x / 20, 1.5)) AS s, POW(x / 20, 1.5) AS u FROM p),
v AS (SELECT *, s * 1.5 / 20 * u AS da, -s * u * LN(x / 20) AS db FROM s), w AS (SELECT *, 1.959963984540054 * SQRT(da * da * 0.5 + 2 * da * db * 0.01 + db * db * 0.02) / (s * (1 - s)) AS h, LN(s / (1 - s)) AS l FROM v)"""


@_query(f"WITH {_WEIBULL_LIMITS} SELECT p_partkey, ROUND(1 / (1 + EXP(-(l - h))), 5) AS lower, ROUND(1 / (1 + EXP(-(l + h))), 5) AS upper, ROUND(-LN(1 / (1 + EXP(-(l + h)))), 4) AS \"H_lower\" FROM w")
def life_model_limits(spark, sf_dir):
    m = models.LifeModel("weibull", [20.0, 1.5], [[0.5, 0.01], [0.01, 0.02]])
    x = F.col("p_size").cast("double")
    (low, high), (h_low, _) = m.limits(x), m.limits(x, "Hf")
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(low, 5).alias("lower"), F.round(high, 5).alias("upper"), F.round(h_low, 4).alias("H_lower"))


@_query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, (p_partkey % 97 + 1) / 100.0::DOUBLE AS q FROM part)
SELECT p_partkey, ROUND(CASE WHEN x > 5 THEN 1 - 0.02 - 0.78 * (1 - EXP(-POW((x - 5) / 20, 1.5))) WHEN x = 5 THEN 0.98 ELSE 1 END, 8) AS sf,
ROUND(CASE WHEN q <= 0.02 THEN 5 WHEN q < 0.8 THEN 5 + 20 * POW(-LN(1 - (q - 0.02) / 0.78), 1 / 1.5) ELSE 1e9 END, 6) AS qf FROM p""")
def life_model_round_trip(spark, sf_dir):
    """A model with offset, failures at the start and survivors, after it was written and read."""
    m = models.from_json(models.LifeModel("weibull", [20.0, 1.5], gamma=5.0, p=0.8, f0=0.02).to_json())
    q = m.qf((F.col("p_partkey") % 97 + 1) / 100.0)
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(m.sf(F.col("p_size").cast("double")), 8).alias("sf"), F.round(F.least(q, F.lit(1e9)), 6).alias("qf"))


@_query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, EXP(0.02 * (p_partkey % 50)) AS f, 0.0002 * (p_partkey % 50) AS l FROM part), b AS (SELECT *, POW(x / 20, 1.5) AS h, 1.5 / 20 * POW(x / 20, 0.5) AS r FROM p)
SELECT p_partkey, ROUND(EXP(-f * h), 8) AS ph, ROUND(f * r, 8) AS ph_hf, ROUND(EXP(-POW(f * x / 20, 1.5)), 8) AS aft, ROUND(f * 1.5 / 20 * POW(f * x / 20, 0.5), 8) AS aft_hf,
ROUND(f * EXP(-h) / (1 - EXP(-h) + f * EXP(-h)), 8) AS po, ROUND(r / (1 - EXP(-h) + f * EXP(-h)), 8) AS po_hf, ROUND(EXP(-h - l * x), 8) AS ah, ROUND(r + l, 8) AS ah_hf FROM b""")
def regression_models(spark, sf_dir):
    x = F.col("p_size").cast("double")
    rows = _read(spark, sf_dir, "part").withColumn("z", F.col("p_partkey") % 50)
    own = {k: models.from_json(models.RegressionModel(k, "weibull", [20.0, 1.5], ["z"], [0.0002 if k == "ah" else 0.02]).to_json()) for k in ("ph", "aft", "po", "ah")}
    return rows.select("p_partkey", *[F.round(m.sf(x), 8).alias(k) for k, m in own.items()], *[F.round(m.hf(x), 8).alias(f"{k}_hf") for k, m in own.items()])


@_query("""WITH g AS (SELECT i * 60.0::DOUBLE / 499 AS x FROM range(500) t(i)), f AS (SELECT x, 1.5 / 20 * POW(x / 20, 0.5) * EXP(-POW(x / 20, 1.5)) * EXP(-0.03 * x) AS wear, 0.03 * EXP(-0.03 * x) * EXP(-POW(x / 20, 1.5)) AS shock FROM g),
l AS (SELECT *, x - LAG(x) OVER (ORDER BY x) AS dx, LAG(wear) OVER (ORDER BY x) AS w0, LAG(shock) OVER (ORDER BY x) AS s0 FROM f),
c AS (SELECT x, SUM(COALESCE(dx * (wear + w0) / 2, 0)) OVER (ORDER BY x) AS wear, SUM(COALESCE(dx * (shock + s0) / 2, 0)) OVER (ORDER BY x) AS shock FROM l)
SELECT 'wear' AS cause, ROUND(x, 6) AS x, ROUND(wear, 7) AS cif FROM c UNION ALL SELECT 'shock', ROUND(x, 6), ROUND(shock, 7) FROM c""")
def latent_competing_risks(spark, sf_dir):
    own = {"wear": models.LifeModel("weibull", [20.0, 1.5]), "shock": models.LifeModel("exponential", [0.03])}
    return models.competing_incidence(own, 60.0, 500)(spark).select("cause", F.round("x", 6).alias("x"), F.round("cif", 7).alias("cif"))


@_query(f"""WITH {_CURVE}, p AS (SELECT DISTINCT g, CAST(t AS DOUBLE) AS t FROM obs, (SELECT UNNEST([-1, 2.5, 10, 45.25, 4000]) AS t)),
lo AS (SELECT p.*, curve.x AS xa, curve.km AS ka FROM p ASOF LEFT JOIN curve ON p.g = curve.g AND p.t >= curve.x), hi AS (SELECT lo.*, curve.x AS xb, curve.km AS kb FROM lo ASOF LEFT JOIN curve ON lo.g = curve.g AND lo.t <= curve.x)
SELECT g, t, ROUND(CASE WHEN xa IS NULL OR xb IS NULL THEN NULL WHEN xa = xb THEN ka ELSE ka + (kb - ka) * (t - xa) / (xb - xa) END, 7) AS km FROM hi""")
def curve_between_times(spark, sf_dir):
    c = _curve(spark, sf_dir)
    probes = c.select("g").distinct().withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in (-1, 2.5, 10, 45.25, 4000)])))
    return curves.at_linear(c, probes, ["km"], ("g",)).select("g", "t", F.round("km", 7).alias("km"))


@_query(f"""WITH {_CURVE}, w AS (SELECT MIN(x) AS x, o FROM (SELECT x, (1 - km) / (1 - (SELECT MIN(km) FROM curve WHERE g = 'A')) AS o FROM curve WHERE g = 'A') GROUP BY o), u AS (SELECT p_partkey AS id, (p_partkey % 97 + 0.4713) / 98.237::DOUBLE AS u FROM part)
SELECT u.id, w.x AS t FROM u ASOF LEFT JOIN w ON u.u <= w.o""")
def curve_draws(spark, sf_dir):
    one = _curve(spark, sf_dir).filter("g = 'A'")
    u = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 97 + 0.4713) / 98.237).alias("u"))
    return curves.draws(one, 0, 0, u=u).select("id", "t")


@_query(f"""WITH {_RISK}, k AS (SELECT g, x, r, d, MAX(r) OVER (PARTITION BY g) AS n, PRODUCT((r + 1 - d) / (r + 1)) OVER (PARTITION BY g ORDER BY x) AS p, ROW_NUMBER() OVER (PARTITION BY g ORDER BY x) AS i, ROW_NUMBER() OVER (PARTITION BY g ORDER BY x DESC) AS j FROM risk)
SELECT g, x, ROUND(CASE WHEN j = 1 THEN POW(0.5, 1 / n) WHEN i = 1 THEN 1 - POW(0.5, 1 / n) ELSE ((n + 1) * (1 - p) - 0.3175) / (n + 0.365) END, 7) AS f FROM k""")
def filliben_positions(spark, sf_dir):
    return curves.filliben_positions(_obs(spark, sf_dir), ("g",)).select("g", "x", F.round("f", 7).alias("f"))


@_query("SELECT DISTINCT event_type AS e FROM events WHERE event_type IS NOT NULL")
def event_types(spark, sf_dir):
    return recurrent.event_types(_rec(spark, sf_dir))


@_query(f"""WITH {_EV}, o AS (SELECT i, x, MAX(x) OVER (PARTITION BY i) AS t, ROW_NUMBER() OVER (PARTITION BY i ORDER BY x DESC) AS k FROM ev), u AS (SELECT POW(x / t, 1.2) AS u FROM o WHERE k > 1 AND t > 0),
j AS (SELECT u, ROW_NUMBER() OVER (ORDER BY u) AS j, COUNT(*) OVER () AS m FROM u) SELECT CAST(MAX(m) AS DOUBLE) AS m, ROUND(1 / (12.0 * MAX(m)) + SUM(POW(u - (2 * j - 1) / (2.0 * m), 2)), 5) AS cvm FROM j""")
def cramer_von_mises(spark, sf_dir):
    model = Intensity("crow-amsaa", (100.0, 1.2))
    out = recurrent.cramer_von_mises(recurrent.conditional_uniforms(_rec(spark, sf_dir), model.cif))
    return out.select("m", F.round("cvm", 5).alias("cvm"))


@_query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, EXP(0.01 * (p_partkey % 50)) AS s FROM part)
SELECT p_partkey, ROUND(s * POW(x / 100, 1.2), 8) AS power, ROUND(s * 0.012 * POW(x / 100, 0.2), 8) AS power_iif, ROUND(0.3 * POW(x, 0.8), 8) AS duane, ROUND(EXP(-2) / 0.01 * (EXP(0.01 * x) - 1), 8) AS cox_lewis,
ROUND(LN(1 + x * 0.01 / EXP(-2)) / 0.01, 6) AS cox_lewis_inverse FROM p""")
def intensity_models(spark, sf_dir):
    x = F.col("p_size").cast("double")
    power, duane, lewis = Intensity("crow-amsaa", (100.0, 1.2), ("z",), (0.01,)), Intensity("duane", (0.8, 0.3)), Intensity("cox-lewis", (-2.0, 0.01))
    rows = _read(spark, sf_dir, "part").withColumn("z", F.col("p_partkey") % 50)
    return rows.select("p_partkey", F.round(power.cif(x), 8).alias("power"), F.round(power.iif(x), 8).alias("power_iif"), F.round(duane.cif(x), 8).alias("duane"), F.round(lewis.cif(x), 8).alias("cox_lewis"),
                       F.round(lewis.inv_cif(x), 6).alias("cox_lewis_inverse"))


@_query(f"""WITH {_EV}, w AS (SELECT i, LAG(x) OVER (PARTITION BY i ORDER BY x) AS p1, LAG(x, 2) OVER (PARTITION BY i ORDER BY x) AS p2 FROM ev)
SELECT i, ROUND(SUM(COALESCE(0.3 * 0.012 * POW(p1 / 100, 0.2), 0) + COALESCE(0.3 * 0.7 * 0.012 * POW(p2 / 100, 0.2), 0)), 6) AS reduction FROM w GROUP BY i""")
def intensity_reduction(spark, sf_dir):
    model = Intensity("crow-amsaa", (100.0, 1.2))
    return recurrent.intensity_reduction(_rec(spark, sf_dir), model.iif, 0.3, 2).groupBy("i").agg(F.round(F.sum("reduction"), 6).alias("reduction"))


@_query(f"""WITH {_EV}, w AS (SELECT i, ROW_NUMBER() OVER (PARTITION BY i ORDER BY x) AS k, x - COALESCE(LAG(x) OVER (PARTITION BY i ORDER BY x), 0) AS gap FROM ev)
SELECT a.i, ROUND(SUM(POW(0.4, a.k - b.k) * b.gap), 3) AS ages FROM w a JOIN w b ON a.i = b.i AND b.k < a.k GROUP BY a.i""")
def virtual_age_kijima_2(spark, sf_dir):
    out = recurrent.virtual_age(_rec(spark, sf_dir), 0.4, kind=2)
    return out.groupBy("i").agg(F.round(F.sum("virtual_age"), 3).alias("ages"), F.count("*").alias("n")).filter("n > 1").drop("n")


@_query(f"""WITH {_OBS}, t AS (SELECT UNNEST([10.0::DOUBLE, 25.0::DOUBLE, 40.0::DOUBLE]) AS cut), a AS (SELECT cut, x, CAST(SUM(1 - c) AS DOUBLE) AS d, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CASE WHEN q <= cut THEN 1 - c ELSE 0 END) AS DOUBLE) AS dl,
  CAST(COUNT(*) FILTER (WHERE q <= cut) AS DOUBLE) AS nl FROM obs, t GROUP BY cut, x), r AS (SELECT cut, d, dl, SUM(n) OVER w AS r, SUM(nl) OVER w AS l FROM a WINDOW w AS (PARTITION BY cut ORDER BY x DESC))
SELECT cut, ROUND(ABS(SUM(dl - d * l / r) / SQRT(SUM(CASE WHEN r > 1 THEN d * (l / r) * (1 - l / r) * (r - d) / (r - 1) ELSE 0 END))), 5) AS z FROM r GROUP BY cut""")
def logrank_split_gains(spark, sf_dir):
    return tree.logrank_gains(shipments(spark, sf_dir), "x", "c", {"q": [10.0, 25.0, 40.0]}).select("cut", F.round("z", 5).alias("z"))


@_query("""WITH s AS (SELECT CAST(i AS DOUBLE) AS t, CASE WHEN (i % 24) >= 8 AND (i % 24) < 18 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS v FROM range(200) r(i)), n AS (SELECT *, CASE WHEN v = LAG(v) OVER (ORDER BY t) THEN 0 ELSE 1 END AS k FROM s), g AS (SELECT *, SUM(k) OVER (ORDER BY t) AS g FROM n)
SELECT MIN(t) AS start, MAX(t) + 1 AS "end", v AS value FROM g GROUP BY g, v""")
def schedule_expression(spark, sf_dir):
    return schedules.from_expression(spark, "2 if 8 <= t % 24 < 18 else 0.5", 200.0)


@_query("""WITH r AS (SELECT CAST(p_size AS DOUBLE) AS r, CAST(p_partkey % 30 AS DOUBLE) - 1 AS d FROM part)
SELECT 'value missing' AS rule, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'nobody at risk', COUNT(*) FILTER (WHERE r <= 0) FROM r UNION ALL SELECT 'events negative', COUNT(*) FILTER (WHERE d < 0) FROM r
UNION ALL SELECT 'more events than at risk', COUNT(*) FILTER (WHERE d > r) FROM r UNION ALL SELECT 'not whole numbers', 0""")
def risk_table_rules(spark, sf_dir):
    own = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("double").alias("x"), F.col("p_size").cast("double").alias("r"), ((F.col("p_partkey") % 30) - 1).cast("double").alias("d"))
    return observations.risk_violations(own)


@_query(f"WITH {_OBS} SELECT 'observed' AS kind, COUNT(*) AS n FROM obs WHERE c = 0 UNION ALL SELECT 'right', COUNT(*) FROM obs WHERE c = 1 UNION ALL SELECT 'left', 0 UNION ALL SELECT 'interval', 0 UNION ALL SELECT 'truncated', COUNT(*) FROM obs")
def observation_types(spark, sf_dir):
    kinds = observations.by_type(_obs(spark, sf_dir, "entry"))
    out = None
    for k, rows in kinds.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out




# --- degradation, copulas, designs: paths are made from known parameters where a fit must give these back ---------

_KNOWN = "SELECT p_partkey, 1::DOUBLE + p_size AS a, 0.02::DOUBLE + (p_partkey % 7) / 100::DOUBLE AS b FROM part WHERE p_partkey <= 40"


def _known_paths(spark, sf_dir, f):
    own = _read(spark, sf_dir, "part").filter("p_partkey <= 40").select("p_partkey", (1.0 + F.col("p_size")).alias("a"), (0.02 + (F.col("p_partkey") % 7) / 100.0).alias("b"))
    return own.withColumn("t", F.explode(F.expr("transform(sequence(1, 12), k -> cast(k as double))"))).withColumn("y", f(F.col("t"), F.col("a"), F.col("b")))


@_query(f"SELECT p_partkey AS unit, ROUND(a, 4) AS exp_a, ROUND(b, 4) AS exp_b, ROUND(a, 3) AS mm_a, ROUND(100 * b, 3) AS mm_b FROM ({_KNOWN})")
def curved_paths(spark, sf_dir):
    one = degradation.fit_curved_paths(_known_paths(spark, sf_dir, lambda t, a, b: a * F.exp(b * t)), "p_partkey", "t", "y", "exponential")
    two = degradation.fit_curved_paths(_known_paths(spark, sf_dir, lambda t, a, b: a * t / (100 * b + t)), "p_partkey", "t", "y", "michaelis-menten")
    part = lambda df, a, b, d: df.select("unit", F.round(F.col("params")[0], d).alias(a), F.round(F.col("params")[1], d).alias(b))
    return part(one, "exp_a", "exp_b", 4).join(part(two, "mm_a", "mm_b", 3), "unit")


@_query(f"""WITH {_DEG}, f AS (SELECT i AS unit, MAX(x) AS now, REGR_INTERCEPT(y, x) AS a, REGR_SLOPE(y, x) AS b FROM y GROUP BY i HAVING COUNT(DISTINCT x) > 1)
SELECT unit, ROUND(now, 4) AS now, ROUND(GREATEST(0, (5000 - a) / b - now), 1) AS remaining FROM f WHERE b <> 0""")
def remaining_life(spark, sf_dir):
    out = degradation.remaining_life(_paths(spark, sf_dir), "user_id", "x", "y", 5000.0).filter("x is not null")
    return out.select("unit", F.round("now", 4).alias("now"), F.round("remaining", 1).alias("remaining"))


@_query("""WITH p AS (SELECT LN(p_retailprice) AS v, SQRT(p_size) AS t FROM part), s AS (SELECT CAST(COUNT(*) AS DOUBLE) AS m, REGR_INTERCEPT(v, t) AS a, REGR_SLOPE(v, t) AS b, SUM(v) AS sv FROM p),
r AS (SELECT SUM((v - a - b * t) * (v - a - b * t)) / MAX(m) AS q FROM p, s) SELECT ROUND(a, 6) AS intercept, ROUND(b, 6) AS slope, ROUND(SQRT(q), 6) AS sigma, ROUND(m * (LN(2 * PI() * q) + 1) + 2 * sv + 6 + 24 / (m - 4), 2) AS aic_c FROM s, r""")
def destructive_degradation(spark, sf_dir):
    out = degradation.destructive_fit(_read(spark, sf_dir, "part"), "p_size", "p_retailprice", "sqrt")
    return out.select(F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"), F.round("sigma", 6).alias("sigma"), F.round("aic_c", 2).alias("aic_c"))


_PATH_FIT = "y AS (SELECT i, x, SUM(value) OVER (PARTITION BY i ORDER BY x, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM ev)"


@_query(f"""WITH {_EV}, {_PATH_FIT}, m AS (SELECT i, 'linear' AS path, x AS z, v FROM y UNION ALL SELECT i, 'square-root', SQRT(x), v FROM y),
f AS (SELECT path, i, REGR_INTERCEPT(v, z) AS a, REGR_SLOPE(v, z) AS b FROM m GROUP BY 1, 2), s AS (SELECT m.path, CAST(COUNT(*) AS DOUBLE) AS m, SUM(POW(v - a - COALESCE(b, 0) * z, 2)) AS s, 2 * COUNT(DISTINCT m.i) + 1 AS k FROM m JOIN f ON m.path = f.path AND m.i = f.i GROUP BY 1)
SELECT path, m, ROUND(m * LN(s / m) + 2 * k + 2.0 * k * (k + 1) / GREATEST(m - k - 1, 1e-9), 2) AS aic_c FROM s""")
def path_choice(spark, sf_dir):
    return degradation.choose_path(_paths(spark, sf_dir), "user_id", "x", "y", ("linear", "square-root")).select("path", "m", F.round("aic_c", 2).alias("aic_c"))


@_query("""WITH p AS (SELECT p_partkey, (p_size + 0.5) / 52.0::DOUBLE AS u, (p_partkey % 97 + 1) / 99.0::DOUBLE AS w FROM part)
SELECT p_partkey, ROUND(POW(POW(u, -2) * (POW(w, -2.0 / 3) - 1) + 1, -0.5), 7) AS v FROM p""")
def copula_sample(spark, sf_dir):
    """Clayton, whose conditional probability has a closed inverse."""
    own = _read(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") + 0.5) / 52.0).alias("u"), ((F.col("p_partkey") % 97 + 1) / 99.0).alias("w"))
    return copulas.sample(own, "clayton", 2.0).select("p_partkey", F.round("v", 7).alias("v"))


@_query(f"""WITH {_OBS} SELECT g, prio, ROUND(SUM(q), 3) AS q, CAST(SUM(CASE WHEN g = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS n, ROUND(SUM(CASE WHEN g = 'R' THEN q ELSE 0 END), 3) AS rq FROM obs GROUP BY g, prio""")
def formula_design(spark, sf_dir):
    own = shipments(spark, sf_dir)
    made, names = design.design(own, "q + g + g:q").apply(own)
    z = {n: f"z{k}" for k, n in enumerate(names)}
    return made.groupBy("g", "prio").agg(F.round(F.sum(z["q"]), 3).alias("q"), F.sum(z["g[N]"]).alias("n"), F.round(F.sum(z["g[R]:q"]), 3).alias("rq"))


@_query(f"""WITH {_OBS}, k AS (SELECT UNNEST(['1-URGENT', '5-LOW']) AS cause) SELECT cause, ROUND(SUM(CASE WHEN c = 0 AND prio = cause THEN 1 ELSE 0 END) / SUM(x), 9) AS rate FROM obs, k WHERE x > 0 GROUP BY cause""")
def latent_causes(spark, sf_dir):
    """Exponential lives of two of the causes: the maximum likelihood is events over time."""
    own = _causes(spark, sf_dir).filter("x > 0").withColumn("cause", F.when(F.col("cause").isin("1-URGENT", "5-LOW"), F.col("cause")))
    fits = fit.fit_latent(own, "x", "cause", "exponential")
    return spark.createDataFrame([(k, round(m.params["rate"], 9)) for k, m in fits.items()], "cause string, rate double")


@_query(f"""WITH {_EV}, s AS (SELECT SUM(t) AS t FROM (SELECT MAX(x) AS t FROM ev GROUP BY i)) SELECT e, ROUND(LN(COUNT(*) / ANY_VALUE(t)), 4) AS log_rate FROM ev, s WHERE x > 0 GROUP BY e""")
def intensities_by_cause(spark, sf_dir):
    """Homogeneous intensities of each mark: events over all items' time."""
    fits = renewal.fit_intensity_by_cause(_rec(spark, sf_dir), "homogeneous")
    return spark.createDataFrame([(k, round(m["p0"], 4)) for k, m in fits.items()], "e string, log_rate double")


@_query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, UNNEST([5.0::DOUBLE, 20.0::DOUBLE]) AS t FROM part) SELECT p_partkey, t, ROUND(EXP(-EXP(0.02 * (p_partkey % 50)) * POW(t / 20, 1.5)), 8) AS sf FROM p""")
def survival_at_times(spark, sf_dir):
    model = models.RegressionModel("ph", "weibull", [20.0, 1.5], ["z"], [0.02])
    rows = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("z"))
    return fit.survival_probability(rows, model, [5.0, 20.0]).select("p_partkey", "t", F.round("sf", 8).alias("sf"))


@_query(f"""WITH {_OBS}, s AS (SELECT CASE WHEN q <= 25 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS z, SUM(x) / SUM(1 - c) AS life FROM obs WHERE x > 0 GROUP BY 1),
p AS (SELECT MAX(life) FILTER (WHERE z = 1) AS l1, MAX(life) FILTER (WHERE z = 2) AS l2 FROM s)
SELECT relation, ROUND(LN(l1), 4) AS life_1, ROUND(LN(l2), 4) AS life_2 FROM p, (SELECT UNNEST(['power', 'eyring']) AS relation)""")
def accelerated_life(spark, sf_dir):
    """With two stresses, any relation of two parameters fits both groups' lives: time over events."""
    own = shipments(spark, sf_dir).withColumn("z", F.when(F.col("q") <= 25, 1.0).otherwise(2.0))
    out = []
    for k in ("power", "eyring"):
        m = accelerated.fit_accelerated(own, "x", "c", ["z"], k, "exponential")
        lives = spark.createDataFrame([(1.0,), (2.0,)], "z double").select(m.life().alias("l")).collect()
        out.append((k, round(math.log(lives[0].l), 4), round(math.log(lives[1].l), 4)))
    return spark.createDataFrame(out, "relation string, life_1 double, life_2 double")


@_query(f"WITH {_CURVE}, s AS (SELECT g, x, km, LEAD(x, 1, x) OVER (PARTITION BY g ORDER BY x) AS nx, ROW_NUMBER() OVER (PARTITION BY g ORDER BY x) AS k FROM curve) SELECT g, ROUND(SUM(km * (nx - x)) + SUM(CASE WHEN k = 1 THEN x ELSE 0 END), 5) AS mean FROM s GROUP BY g")
def mean_life(spark, sf_dir):
    return curves.mean_life(_curve(spark, sf_dir), by=("g",)).select("g", F.round("mean", 5).alias("mean"))


# --- fits whose Newton steps SQL can spell out --------------------------------------------------------------------

def _newton(first: str, step: str, rounds: int, start: str = "0.0::DOUBLE") -> str:
    """CTEs b0 .. bN of one row and column b: step is SQL for the next value, with {b} for the table of the last one."""
    out = [first, f"b0 AS (SELECT {start} AS b)"]
    for k in range(rounds):
        out.append(f"b{k + 1} AS ({step.replace('{b}', f'b{k}')})")
    return ", ".join(out)


_COX_STEP = """SELECT ANY_VALUE(b) + SUM(dq - d * r1 / r0) / SUM(d * (r2 / r0 - r1 / r0 * r1 / r0)) AS b FROM (
 SELECT b, d, dq, SUM(s0) OVER w AS r0, SUM(s1) OVER w AS r1, SUM(s2) OVER w AS r2 FROM (
  SELECT g, x, b, SUM(1 - c) AS d, SUM((1 - c) * q) AS dq, SUM(EXP(b * q)) AS s0, SUM(q * EXP(b * q)) AS s1, SUM(q * q * EXP(b * q)) AS s2 FROM obs, {b} GROUP BY g, x, b)
 WINDOW w AS (PARTITION BY g ORDER BY x DESC)) WHERE d > 0"""


@_query(f"WITH {_newton(_OBS, _COX_STEP, 6)} SELECT ROUND(b, 7) AS beta FROM b6")
def cox_coefficient(spark, sf_dir):
    m = regression.fit_cox(shipments(spark, sf_dir), "x", "c", ["q"], strata=("g",))
    return spark.createDataFrame([(round(float(m.beta[0]), 7),)], "beta double")


_WEIBULL_STEP = """SELECT b - (1 / b + ld / d - s1 / s0) / (-1 / (b * b) - (s2 / s0 - s1 / s0 * s1 / s0)) AS b FROM (
 SELECT ANY_VALUE(b) AS b, SUM(1 - c) AS d, SUM((1 - c) * LN(x)) AS ld, SUM(POW(x, b)) AS s0, SUM(POW(x, b) * LN(x)) AS s1, SUM(POW(x, b) * LN(x) * LN(x)) AS s2 FROM obs, {b} WHERE x > 0)"""


@_query(f"WITH {_newton(_OBS, _WEIBULL_STEP, 12, '1.0::DOUBLE')} SELECT ROUND(b, 5) AS beta, ROUND(LN(POW(SUM(POW(x, b)) / SUM(1 - c), 1 / b)), 5) AS log_alpha FROM obs, b12 WHERE x > 0 GROUP BY b")
def weibull_likelihood(spark, sf_dir):
    m = fit.fit_mle(observations.observations(shipments(spark, sf_dir).filter("x > 0"), x="x", c="c"), "weibull")
    return spark.createDataFrame([(round(m.params["beta"], 5), round(math.log(m.params["alpha"]), 5))], "beta double, log_alpha double")


_PH_STEP = """SELECT b + (dq - d * s1 / s0) / (d * (s2 / s0 - s1 / s0 * s1 / s0)) AS b FROM (SELECT ANY_VALUE(b) AS b, SUM(1 - c) AS d, SUM((1 - c) * q / 50) AS dq, SUM(x * EXP(b * q / 50)) AS s0,
 SUM(x * q / 50 * EXP(b * q / 50)) AS s1, SUM(x * q * q / 2500 * EXP(b * q / 50)) AS s2 FROM obs, {b} WHERE x > 0)"""


@_query(f"WITH {_newton(_OBS, _PH_STEP, 6)} SELECT ROUND(b, 4) AS beta, ROUND(LN(SUM(x * EXP(b * q / 50)) / SUM(1 - c)), 4) AS log_scale FROM obs, b6 WHERE x > 0 GROUP BY b")
def exponential_regression(spark, sf_dir):
    own = shipments(spark, sf_dir).filter("x > 0").withColumn("z", F.col("q") / 50)
    m = regression.fit_parametric(own, "x", "c", ["z"], "ph", "exponential")
    return spark.createDataFrame([(round(m["z"], 4), round(m["log_scale"], 4))], "beta double, log_scale double")
