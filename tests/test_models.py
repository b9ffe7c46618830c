"""Models, inference and diagnostics on published numbers, loops and awkward input."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import copulas, intensities, models
from tidewatch.operators import competing, curves, degradation, metrics, observations, recurrent, risk
from tidewatch.plans import accelerated, cox, design, fit, regression, renewal, schedules, tree
from tidewatch.sources import datasets


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(1, 25) * 1.0, int(rng.random() < 0.4), rng.gauss(0, 1), float(rng.randint(0, 1)), rng.choice("abc"), rng.choice([None, "x", "y"])) for k in range(160)]
    return rows, spark.createDataFrame(rows, "id int, x double, c int, z double, w double, g string, e string")


def test_concordance_of_pairs(spark, cohort):
    """Every pair by its rule."""
    for rows in ([(1, 0, 3), (1, 0, 2), (2, 0, 2), (3, 1, 1)], [(r[1], r[2], round(r[3])) for r in cohort[0]], [(2.0, 1, 1.0), (2.0, 1, 0.0)]):
        good = pairs = 0.0
        for (x1, c1, s1), (x2, c2, s2) in itertools.combinations(rows, 2):
            if (x1, c1) > (x2, c2):
                x1, c1, s1, x2, c2, s2 = x2, c2, s2, x1, c1, s1
            if c1 == 1:
                continue
            pairs += 1
            if x1 != x2:
                good += 1 if s1 > s2 else 0.5 if s1 == s2 else 0
            elif c2 == 0:
                good += 1 if s1 == s2 else 0.5
            else:
                good += 1 if s1 > s2 else 0.5
        out = metrics.concordance(spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, c double, s double"), "x", "c", "s").first()
        assert out.comparable == pairs and out.c_index == (pytest.approx(good / pairs) if pairs else None)


def _censoring(rows, t):
    g = 1.0
    for u in sorted({r[1] for r in rows}):
        if u <= t:
            g *= 1 - sum(r[1] == u and r[2] == 1 for r in rows) / sum(r[1] >= u for r in rows)
    return g


@pytest.mark.parametrize("shift", [0.0, 20_000.0])
def test_brier_and_roc(spark, cohort, shift):
    rows = [(r[0], r[1] + shift, *r[2:]) for r in cohort[0]]
    df = cohort[1].withColumn("x", F.col("x") + shift).withColumn("s", 1 / (1 + F.exp(-F.col("z"))))
    t = 12.0 + shift
    g_t, total = _censoring(rows, t), 0.0
    for r in rows:
        s = 1 / (1 + math.exp(-r[3]))
        if r[1] <= t and r[2] == 0:
            g = _censoring(rows, r[1])
            total += s * s / g if g > 0 else 0
        elif r[1] > t:
            total += (1 - s) ** 2 / g_t
    for train in (None, df):
        assert metrics.brier_score(df, "x", "c", {t: "s"}, train).first().brier == pytest.approx(total / len(rows))
    num = den = 0.0
    for a in rows:
        if a[1] <= t and a[2] == 0:
            w = 1 / _censoring(rows, a[1])
            for b in rows:
                if b[1] > t:
                    den += w
                    num += w * (1 if a[3] > b[3] else 0.5 if a[3] == b[3] else 0)
    assert metrics.roc_at(df, "x", "c", "z", t).first().auc == pytest.approx(num / den)
    assert metrics.roc_at(df, "x", "c", "z", shift).first().auc is None


@pytest.mark.parametrize("rho", [0.0, 1.0])
def test_gray(spark, cohort, rho):
    """The loop over the cause's times."""
    rows, df = cohort
    groups = sorted({r[5] for r in rows})
    g = lambda t: math.prod(1 - sum(r[1] == u and r[6] is None for r in rows) / sum(r[1] >= u for r in rows) for u in sorted({r[1] for r in rows}) if u <= t)
    u, v, cif, s = np.zeros(3), np.zeros((3, 3)), 0.0, 1.0
    for t in sorted({r[1] for r in rows}):
        risk, now = sum(r[1] >= t for r in rows), [r for r in rows if r[1] == t]
        d_all, dk = sum(r[6] is not None for r in now), sum(r[6] == "x" for r in now)
        if dk:
            weight = [sum((1.0 if r[1] >= t else g(t) / g(r[1]) if r[6] == "y" and g(r[1]) > 0 else 0.0) for r in rows if r[5] == k) for k in groups]
            R, d = sum(weight), np.array([sum(r[6] == "x" and r[5] == k for r in now) for k in groups])
            w, p = (1 - cif) ** rho, np.array(weight) / R
            u += w * (d - dk * p)
            v += w * w * dk * (R - dk) / (R - 1) * (np.diag(p) - np.outer(p, p)) if R > 1 else 0
        cif += s * dk / risk
        s *= 1 - d_all / risk
    want = u[:2] @ np.linalg.solve(v[:2, :2], u[:2])
    out = competing.gray_test(df, "x", "e", "g", "x", rho).first()
    assert out.statistic == pytest.approx(want) and out.df == 2 and out.p_value == pytest.approx(math.exp(-want / 2))
    with pytest.raises(ValueError, match="no events"):
        competing.gray_test(df, "x", "e", "g", "unknown")


def test_efron_and_inference(spark, cohort):
    rows, df = cohort
    m = regression.fit_cox(df, "x", "c", ["z", "w"], ties="efron")
    b = m.beta

    def ll(beta):
        out = 0.0
        for t in {r[1] for r in rows if r[2] == 0}:
            risk = [math.exp(beta[0] * r[3] + beta[1] * r[4]) for r in rows if r[1] >= t]
            dead = [beta[0] * r[3] + beta[1] * r[4] for r in rows if r[1] == t and r[2] == 0]
            out += sum(dead) - sum(math.log(sum(risk) - k / len(dead) * sum(map(math.exp, dead))) for k in range(len(dead)))
        return out

    assert m.log_likelihood == pytest.approx(ll(b)) and all(ll(b) >= ll(b + np.array(e)) for e in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))
    fit = regression.fit_cox(df, "x", "c", ["z", "w"])
    scores = cox.score_residuals(df, "x", "c", ["z", "w"], list(fit.beta)).agg(F.sum("score_z"), F.sum("score_w")).first()
    assert scores[0] == pytest.approx(0, abs=1e-6) and scores[1] == pytest.approx(0, abs=1e-6)
    robust = cox.robust_covariance(df, "x", "c", ["z", "w"], list(fit.beta), fit.covariance)
    assert np.allclose(robust, robust.T) and (np.linalg.eigvalsh(robust) > 0).all()
    clustered = cox.robust_covariance(df, "x", "c", ["z", "w"], list(fit.beta), fit.covariance, "id")
    assert np.allclose(robust, clustered)
    tests = cox.proportionality(df, "x", "c", ["z", "w"], list(fit.beta), "rank").collect()
    assert [t.covariate for t in tests] == ["z", "w", None] and all(0 <= t.p_value <= 1 for t in tests) and tests[2].df == 2


def test_models_are_written_and_read(spark):
    m = models.LifeModel("weibull", [10.0, 2.0], [[1.0, 0.0], [0.0, 0.1]], gamma=1.0, p=0.9, f0=0.1)
    assert models.from_json(m.to_json()) == m
    r = models.RegressionModel("po", "loglogistic", [5.0, 2.0], ["z"], [0.3])
    assert models.from_json(r.to_json()) == r
    with pytest.raises(ValueError, match="version"):
        models.from_json(m.to_json().replace('"version": 1', '"version": 99'))
    for bad in (("nothing", [1.0]), ("weibull", [1.0])):
        with pytest.raises(ValueError):
            models.LifeModel(*bad)
    row = spark.range(1).select(m.qf(F.lit(0.05)).alias("start"), m.qf(F.lit(0.95)).alias("never"), m.sf(F.lit(0.5)).alias("before"), m.sf(m.qf(F.lit(0.4))).alias("back"), m.ff(F.lit(1e9)).alias("all")).first()
    assert (row.start, row.never, row.before) == (1.0, math.inf, 1.0) and row.back == pytest.approx(0.6) and row["all"] == pytest.approx(0.9)
    low, high = m.limits(F.lit(8.0))
    s = spark.range(1).select(low.alias("a"), m.sf(F.lit(8.0)).alias("b"), high.alias("c")).first()
    assert s.a < s.b < s.c


def test_regression_hazards_are_derivatives(spark):
    for kind in ("ph", "aft", "po", "ah"):
        for base, params in (("weibull", [5.0, 1.7]), ("loglogistic", [5.0, 2.0]), ("exponential", [4.0]), ("gumbel", [5.0, 2.0]), ("logistic", [5.0, 2.0]), ("rayleigh", [3.0])):
            m = models.RegressionModel(kind, base, params, ["z"], [0.1])
            x, h = F.lit(3.0), 1e-5
            row = spark.createDataFrame([(0.5,)], "z double").select(m.hf(x).alias("a"), ((m.Hf(x + h) - m.Hf(x - h)) / (2 * h)).alias("b"), m.df(x).alias("c"), ((m.ff(x + h) - m.ff(x - h)) / (2 * h)).alias("d")).first()
            assert row.a == pytest.approx(row.b, rel=1e-5) and row.c == pytest.approx(row.d, rel=1e-5)


def test_simulated_histories(spark):
    model = intensities.Intensity("crow-amsaa", (10.0, 1.5))
    out = intensities.simulate(spark, model, 400, until=30.0, seed=4)
    counts = out.filter("c = 0").groupBy("i").count()
    mean = counts.agg(F.sum("count")).first()[0] / 400
    assert mean == pytest.approx(3**1.5, rel=0.1) and out.filter("c = 1").count() == 400 and out.agg(F.max("x")).first()[0] == 30
    u = recurrent.conditional_uniforms(recurrent.recurrent_events(out, "i", "x", c="c"), model.cif)
    assert recurrent.cramer_von_mises(u).first().cvm < 1.2
    curve = intensities.mean_count(out, 400)
    assert curve.agg(F.max("mcf")).first()[0] == pytest.approx(mean)
    fixed = intensities.simulate(spark, model, 5, events=7, seed=4)
    assert fixed.groupBy("i").count().filter("count = 7").count() == 5
    with pytest.raises(ValueError):
        intensities.simulate(spark, model, 5)


def test_schedules(spark):
    out = schedules.from_expression(spark, "1 if t >= 2 and not t > 5 else floor(t / 4) * 2", 8.0).orderBy("start").collect()
    assert [(r.start, r.end, r.value) for r in out] == [(0, 2, 0), (2, 6, 1), (6, 8, 2)]
    for bad in ("t * 2", "1 + t if t < 3 else 0"):
        with pytest.raises(schedules.ContinuousSchedule):
            schedules.from_expression(spark, bad, 8.0)
    for bad in ("__import__('os')", "open('x')", "t.real", "[1]", "'a'"):
        with pytest.raises(ValueError):
            schedules.from_expression(spark, bad, 8.0)


def test_inputs_are_checked(spark, cohort):
    df = cohort[1]
    observations.validate_regression(df, "x", "c", ["z", "w"])
    with pytest.raises(ValueError, match="constant covariates: k"):
        observations.validate_regression(df.withColumn("k", F.lit(1.0)), "x", "c", ["z", "k"])
    with pytest.raises(ValueError, match="event without cause"):
        observations.validate_competing(df, "x", "e", "c")
    with pytest.raises(ValueError, match="more events than at risk"):
        observations.validate_risk(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, r double, d double"))
    with pytest.raises(ValueError, match="overlap"):
        observations.validate_episodes(spark.createDataFrame([(1, 0.0, 5.0), (1, 4.0, 6.0)], "i int, a double, b double"), "i", "a", "b")
    late = recurrent.recurrent_events(spark.createDataFrame([(1, 3.0, 0, 1.0), (1, 2.0, 1, 1.0)], "i int, x double, c int, t double"), "i", "x", c="c", tl="t")
    with pytest.raises(ValueError, match="delayed entry, censoring before"):
        recurrent.require_plain(late, "this model")
    assert [tree.features_tried(r, 16) for r in (3, 0.5, "sqrt", "log2", "all")] == [3, 8, 4, 4, 16]
    with pytest.raises(ValueError):
        tree.features_tried("some", 4)


def test_curves_and_models_are_kept(spark, tmp_path):
    obs = observations.observations(datasets.automotive(spark), x="x", c="c")
    curve = curves.survival_curves(risk.risk_table(obs))
    datasets.save_curve(curve, str(tmp_path / "curve"))
    again = datasets.load_curve(spark, str(tmp_path / "curve"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, curve.collect()))
    m = fit.life_model(fit.fit_mle(obs, "weibull"))
    datasets.save_life_model(spark, str(tmp_path / "models"), "a", m)
    assert datasets.load_life_model(spark, str(tmp_path / "models"), "a") == m
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no curve"):
        datasets.load_curve(spark, str(tmp_path / "other"))


def test_gaussian_copula(spark):
    df = spark.createDataFrame([(0.3, 0.6), (0.9, 0.2), (0.5, 0.5)], "u double, v double")
    for rho in (-0.7, 0.0, 0.5):
        rows = df.select("u", "v", copulas.gaussian_probability(F.col("u"), F.col("v"), rho).alias("c"), copulas.gaussian_density(F.col("u"), F.col("v"), rho).alias("d")).collect()
        assert rows[2].c == pytest.approx(0.25 + math.asin(rho) / (2 * math.pi))
        h = 1e-3
        for r in rows:
            near = spark.createDataFrame([(r.u + a, r.v + b) for a in (h, -h) for b in (h, -h)], "u double, v double").select(copulas.gaussian_probability(F.col("u"), F.col("v"), rho).alias("c")).collect()
            assert (near[0].c - near[1].c - near[2].c + near[3].c) / (4 * h * h) == pytest.approx(r.d, rel=1e-2)
    assert copulas.spearman_rho("independence", 0.0) == pytest.approx(0, abs=1e-6) and copulas.tail_dependence("clayton", 2.0)[0] == pytest.approx(2**-0.5)
    # Gumbel has no closed inverse: the sampled value has the wanted conditional probability
    out = copulas.sample(spark.createDataFrame([(0.3, 0.6), (0.8, 0.1)], "u double, w double"), "gumbel", 2.0)
    for r in out.withColumn("p", copulas.COPULAS["gumbel"].given_u(F.col("u"), F.col("v"), 2.0)).collect():
        assert r.p == pytest.approx(r.w, abs=1e-9)


def test_goodness_of_a_power_law(spark):
    model = intensities.Intensity("crow-amsaa", (10.0, 1.5))
    good = recurrent.recurrent_events(intensities.simulate(spark, model, 30, until=40.0, seed=2), "i", "x", c="c")
    out = renewal.power_law_goodness(good, replicates=39, seed=5).first()
    assert out.p_value > 0.05 and out.replicates == 39
    bad = good.withColumn("x", F.when(F.col("c") == 0, 20 + F.col("x") / 2).otherwise(F.col("x")))
    assert renewal.power_law_goodness(bad, replicates=39, seed=5).first().p_value <= 0.05


def test_designs(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", 1), (2.0, 3.0, "b", 2), (3.0, 5.0, None, 1)], "p double, q double, g string, k int")
    made = design.design(df, "y ~ 0 + p * q + g + C(k):p")
    out, names = made.apply(df)
    assert names == ["p", "q", "p:q", "g[b]", "k[2]:p"]
    assert [tuple(r)[4:] for r in out.collect()] == [(1, 2, 2, 0, 0), (2, 3, 6, 1, 2), (3, 5, 15, 0, 0)]
    new, _ = made.apply(spark.createDataFrame([(1.0, 1.0, "unseen", 9)], df.schema))
    assert tuple(new.first())[4:] == (1, 1, 1, 0, 0)
    for bad in ("p + nothing", "p + f(q)", "p * q * g"):
        with pytest.raises(ValueError):
            design.design(df, bad)


def test_curved_paths_and_units(spark):
    rng = random.Random(2)
    rows = [(k, float(t), 50 * math.exp(-3 * math.exp(-0.4 * t)) + rng.gauss(0, 0.01), 1.0) for k in range(3) for t in range(15)] + [(9, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "unit int, t double, y double, z double")
    for r in degradation.fit_curved_paths(df, "unit", "t", "y", "gompertz").collect():
        assert r.params is None if r.unit == 9 else r.params == pytest.approx([50, 3, 0.4], rel=1e-2)
    assert degradation.unit_covariates(df, "unit", ["z"]).count() == 4
    with pytest.raises(ValueError, match="change within a unit: y"):
        degradation.unit_covariates(df, "unit", ["z", "y"])
    share = degradation.destructive_failure(df, "t", 2.0, -0.1, 0.5, 5.0).agg(F.min("ff"), F.max("ff")).first()
    assert 0 < share[0] < share[1] < 1


def test_fits_refuse_what_the_driver_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(fit, "LOCAL_ROWS", 10)
    with pytest.raises(ValueError, match="at most 10 distinct rows"):
        fit.fit_mixture(observations.observations(datasets.bearings(spark), x="x"))


def test_accelerated_life(spark):
    """Known parameters come back; hazards are derivatives."""
    rng = random.Random(11)
    rows = []
    for _ in range(6000):
        z, w = rng.choice([1.0, 2.0, 4.0]), rng.choice([300.0, 350.0])
        t = 5 * z**-1.5 * math.exp(900 / w) * rng.weibullvariate(1, 2.5)
        rows.append((min(t, 40.0), int(t > 40), w, z))
    df = spark.createDataFrame(rows, "x double, c int, w double, z double")
    m = accelerated.fit_accelerated(df, "x", "c", ["w", "z"], "power-exponential", "weibull")
    assert m.params["a"] == pytest.approx(900, rel=0.06) and m.params["n"] == pytest.approx(-1.5, rel=0.03) and m.shape == pytest.approx(2.5, rel=0.05)
    row = df.limit(1).select(m.hf(F.lit(3.0)).alias("h"), ((m.Hf(F.lit(3.0 + 1e-5)) - m.Hf(F.lit(3.0 - 1e-5))) / 2e-5).alias("d")).first()
    assert row.h == pytest.approx(row.d, rel=1e-6) and (np.diag(m.covariance) > 0).all()
    with pytest.raises(ValueError, match="takes 2 stresses"):
        accelerated.fit_accelerated(df, "x", "c", ["w"], "dual-power")


def test_bands_and_first_passages(spark):
    assert curves.band_width(0.001, 0.999) == pytest.approx(1.36, abs=0.04)  # fixed value: Kolmogorov's at 5 %
    c = curves.band_width(0.1, 0.9, equal_precision=True)
    density = math.exp(-c * c / 2) / math.sqrt(2 * math.pi)
    assert 4 * density / c + density * (c - 1 / c) * math.log(81) == pytest.approx(0.05, abs=0.01)  # the tail of large values
    obs = observations.observations(datasets.automotive(spark), x="x", c="c")
    curve = curves.survival_curves(risk.risk_table(obs))
    for method in ("hall-wellner", "nair"):
        rows = curves.simultaneous_band(curve, 31.0, method=method, paths=1000).filter("lower is not null").collect()
        assert rows and all(0 <= r.lower < r.km < r.upper <= 1 for r in rows)
    with pytest.raises(ValueError, match="no time"):
        curves.simultaneous_band(curve.filter("d = 0").limit(1), 31.0)
    rng = np.random.default_rng(3)
    steps = rng.normal(0.5 * 0.02, 0.8 * 0.02**0.5, (4000, 2500)).cumsum(axis=1)
    hits = np.where((steps >= 4).any(axis=1), (steps >= 4).argmax(axis=1) * 0.02, 50.0)
    row = degradation.wiener_remaining(spark.createDataFrame([(6.0,), (10.0,), (12.0,)], "y double"), "y", 10.0, 0.5, 0.8, (0.25, 0.5, 0.75)).collect()
    assert [row[0]["q_0.25"], row[0]["q_0.5"], row[0]["q_0.75"]] == pytest.approx(list(np.quantile(hits, [0.25, 0.5, 0.75])), rel=0.06)
    assert row[0].mean_remaining == 8 and row[1]["q_0.5"] == row[2]["q_0.5"] == 0
