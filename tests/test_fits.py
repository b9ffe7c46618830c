import numpy as np
import pytest

from tidewatch.functions import special
from tidewatch.operators import observations
from tidewatch.plans import fit, regression, turnbull

# A fatigue sample with counts and a set of inspection intervals; expected numbers are published estimates.
A = ([40.8, 42.075, 43.35, 44.625, 45.9, 47.175, 48.45, 49.725, 51, 52.275, 53.55, 54.825], [10, 23, 48, 80, 63, 65, 45, 33, 19, 10, 3, 1])
LEFT = [.5, 1, 2, 2.5, 3, 4, 5, 6, 7.5, 9, 11, 13]
RIGHT = [1.5, 2, 3, 4, 4.5, 6, 7, 8, 10, 12, 14, 18]


def counted(spark):
    return observations.observations(spark.createDataFrame(list(zip(map(float, A[0]), A[1])), "t double, m int"), x="t", n="m")


@pytest.mark.parametrize("family, want", [
    ("weibull", (47.60872015, 16.79055124)), ("exponential", (.02160643872,)), ("lognormal", (3.83301888, .05896327642)),
    ("loglogistic", (46.13467731, 29.23314098)), ("normal", (46.28249991, 2.746433999)), ("gumbel", (47.69627366, 2.868474177)),
])
def test_maximum_likelihood(spark, family, want):
    assert list(fit.fit_mle(counted(spark), family).params.values()) == pytest.approx(want, rel=1e-3)


@pytest.mark.parametrize("family, want", [("weibull", (7.047279793, 1.501594688)), ("exponential", (1 / 6.362860081,)), ("lognormal", (1.573762988, .8009838454)), ("loglogistic", (5.047925354, 2.108218055))])
def test_interval_censored(spark, family, want):
    obs = observations.observations(spark.createDataFrame(list(zip(map(float, LEFT), map(float, RIGHT))), "a double, b double"), xl="a", xr="b")
    assert list(fit.fit_mle(obs, family).params.values()) == pytest.approx(want, rel=1e-3)


def test_distributed_objective_gives_the_same(spark, monkeypatch):
    local = fit.fit_mle(counted(spark), "weibull").params
    monkeypatch.setattr(fit, "LOCAL_ROWS", 0)
    full = fit.newton
    monkeypatch.setattr(fit, "newton", lambda f, start: full(f, start, steps=6))
    assert fit.fit_mle(counted(spark), "weibull").params["beta"] == pytest.approx(local["beta"], rel=0.05)


def test_fit_best(spark):
    assert fit.fit_best(counted(spark), ["exponential", "normal", "weibull"]).family == "normal"


def test_turnbull(spark):
    left = [.5, 1.2, 2.1, 1.8, 3.4, 4.2, 5.1, 4.8, 6.3, 7.2, 2.7, 8.4]
    right = [2.4, 3.1, 4.5, 6.1, 5.6, 6.8, 7.9, 9.2, 8.8, 9.9, 10.4, 11.3]
    out = turnbull.turnbull(observations.observations(spark.createDataFrame(list(zip(left, right)), "a double, b double"), xl="a", xr="b")).toPandas()
    sf = [1 - out.loc[out.x_hi <= t, "mass"].sum() for t in (2.5, 4.6, 5.7, 8.0)]
    assert sf == pytest.approx([.714780, .714622, .326064, .325946], abs=1e-2)


def test_cox_score_is_zero_and_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(60, 2))
    x = np.ceil(rng.exponential(1 / np.exp(z @ [0.5, -0.3])) * 10)
    c = (rng.random(60) < 0.3).astype(int)
    tl = np.where(rng.random(60) < 0.3, np.maximum(0, x - 3), 0.0)
    df = spark.createDataFrame([(float(a), int(b), float(u), float(v), float(t)) for a, b, (u, v), t in zip(x, c, z, tl)], "x double, c int, z1 double, z2 double, tl double")
    m = regression.fit_cox(df, "x", "c", ["z1", "z2"], tl="tl")

    def ll(beta):
        eta = z @ beta
        return sum(eta[i] - np.log(np.exp(eta)[(x >= x[i]) & (tl < x[i])].sum()) for i in range(60) if c[i] == 0)

    assert np.abs(m.score).max() < 1e-6
    assert m.log_likelihood == pytest.approx(ll(m.beta))
    for e in np.eye(2) * 1e-3:
        assert ll(m.beta) >= max(ll(m.beta + e), ll(m.beta - e))


def test_special_functions():
    assert special.gammainc(1.0, 2.0) == pytest.approx(1 - np.exp(-2))
    assert special.betainc(1.0, 3.0, 0.2) == pytest.approx(1 - 0.8**3)
    assert special.betainc(2.0, 2.0, 0.5) == pytest.approx(0.5)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
