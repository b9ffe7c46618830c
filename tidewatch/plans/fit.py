"""Parametric fits. Rows are compressed by an aggregation first; objectives run over what remains.

Up to LOCAL_ROWS distinct rows a fit iterates in numpy on the driver; beyond, every evaluation is one
aggregation in Spark with the parameters as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import special
from tidewatch.operators.observations import INF, compress
from tidewatch.operators.risk import simple_risk_table

LOCAL_ROWS = 200_000


def _local(rows: DataFrame):
    """Distinct rows on the driver, up to LOCAL_ROWS; ValueError where there are more."""
    found = rows.limit(LOCAL_ROWS + 1).toPandas()
    if len(found) > LOCAL_ROWS:
        raise ValueError(f"this fit takes at most {LOCAL_ROWS} distinct rows; round the times first")
    return found


@dataclass
class Family:
    """A family for fitting: log survival and log density in numpy, start values, and which parameters are positive."""

    params: tuple[str, ...]
    log_sf: object
    log_df: object
    start: object
    positive: tuple[bool, ...]


def _moments(x, n):
    m = float(np.average(x, weights=n))
    return m, max(float(np.sqrt(np.average((x - m) ** 2, weights=n))), 1e-6 * (abs(m) + 1))


def _log_moments(x, n):
    return _moments(np.log(x[x > 0]), n[x > 0])


def _norm_log_sf(z):
    return np.log(np.maximum(special.norm_cdf(-z), 1e-300))


_gammainc = np.vectorize(special.gammainc, otypes=[float])
FAMILIES = {
    "exponential": Family(("rate",), lambda x, r: -r * x, lambda x, r: np.log(r) - r * x, lambda x, n: [1 / _moments(x, n)[0]], (True,)),
    "weibull": Family(("alpha", "beta"), lambda x, a, b: -((x / a) ** b), lambda x, a, b: np.log(b / a) + (b - 1) * np.log(x / a) - (x / a) ** b,
                      lambda x, n: [math.exp(_log_moments(x, n)[0]) * 1.3, 1.2 / _log_moments(x, n)[1]], (True, True)),
    "rayleigh": Family(("sigma",), lambda x, s: -x * x / (2 * s * s), lambda x, s: np.log(x) - 2 * np.log(s) - x * x / (2 * s * s), lambda x, n: [_moments(x, n)[0] / 1.25], (True,)),
    "gumbel": Family(("mu", "sigma"), lambda x, m, s: -np.exp((x - m) / s), lambda x, m, s: (x - m) / s - np.exp((x - m) / s) - np.log(s),
                     lambda x, n: [_moments(x, n)[0] + 0.45 * _moments(x, n)[1], 0.78 * _moments(x, n)[1]], (False, True)),
    "gumbel_lev": Family(("mu", "sigma"), lambda x, m, s: np.log(-np.expm1(-np.exp(-(x - m) / s))), lambda x, m, s: -(x - m) / s - np.exp(-(x - m) / s) - np.log(s),
                         lambda x, n: [_moments(x, n)[0] - 0.45 * _moments(x, n)[1], 0.78 * _moments(x, n)[1]], (False, True)),
    "logistic": Family(("mu", "sigma"), lambda x, m, s: -np.logaddexp(0, (x - m) / s), lambda x, m, s: -(x - m) / s - np.log(s) - 2 * np.logaddexp(0, -(x - m) / s),
                       lambda x, n: [_moments(x, n)[0], 0.55 * _moments(x, n)[1]], (False, True)),
    "loglogistic": Family(("alpha", "beta"), lambda x, a, b: -np.log1p((x / a) ** b), lambda x, a, b: np.log(b / a) + (b - 1) * np.log(x / a) - 2 * np.log1p((x / a) ** b),
                          lambda x, n: [math.exp(_log_moments(x, n)[0]), 1.8 / _log_moments(x, n)[1]], (True, True)),
    "normal": Family(("mu", "sigma"), lambda x, m, s: _norm_log_sf((x - m) / s), lambda x, m, s: -0.5 * ((x - m) / s) ** 2 - np.log(s * math.sqrt(2 * math.pi)),
                     lambda x, n: list(_moments(x, n)), (False, True)),
    "lognormal": Family(("mu", "sigma"), lambda x, m, s: _norm_log_sf((np.log(x) - m) / s), lambda x, m, s: -0.5 * ((np.log(x) - m) / s) ** 2 - np.log(s * math.sqrt(2 * math.pi)) - np.log(x),
                        lambda x, n: list(_log_moments(x, n)), (False, True)),
    "gamma": Family(("alpha", "beta"), lambda x, a, b: np.log(np.maximum(1 - _gammainc(a, b * x), 1e-300)),
                    lambda x, a, b: a * np.log(b) + (a - 1) * np.log(x) - b * x - math.lgamma(a),
                    lambda x, n: [(_moments(x, n)[0] / _moments(x, n)[1]) ** 2, _moments(x, n)[0] / _moments(x, n)[1] ** 2], (True, True)),
}


@dataclass
class Fit:
    """A fitted family: parameters, their covariance, negative log-likelihood and information criteria."""

    family: str
    params: dict[str, float]
    covariance: np.ndarray
    neg_ll: float
    n: float
    n_observed: float
    extra: dict = field(default_factory=dict)

    @property
    def aic(self) -> float:
        return 2 * len(self.params) + 2 * self.neg_ll

    @property
    def bic(self) -> float:
        return len(self.params) * math.log(self.n_observed) + 2 * self.neg_ll

    @property
    def aic_c(self) -> float:
        k = len(self.params)
        return self.aic + 2 * k * (k + 1) / max(self.n - k - 1, 1e-9)

    def limits(self, name: str, alpha: float = 0.05) -> tuple[float, float]:
        """Wald limits of a parameter, on the log scale if it is positive by nature."""
        k = list(self.params).index(name)
        z, v, s = NormalDist().inv_cdf(1 - alpha / 2), self.params[name], math.sqrt(self.covariance[k, k])
        if FAMILIES[self.family].positive[k]:
            return v * math.exp(-z * s / v), v * math.exp(z * s / v)
        return v - z * s, v + z * s


def log_likelihood(rows: dict[str, np.ndarray], family: Family, params) -> float:
    """Weighted log-likelihood of canonical rows: all four censoring flags, and truncation."""
    x, hi, c, n, tl, tr = (rows[k] for k in ("x", "x_hi", "c", "n", "tl", "tr"))
    out = np.zeros(len(x))
    with np.errstate(all="ignore"):
        sf = lambda v: np.where(np.isneginf(v), 1.0, np.where(np.isposinf(v), 0.0, np.exp(family.log_sf(np.where(np.isfinite(v), v, 1.0), *params))))
        for flag, f in ((0, lambda m: family.log_df(x[m], *params)), (1, lambda m: family.log_sf(x[m], *params)),
                        (-1, lambda m: np.log(-np.expm1(family.log_sf(x[m], *params)))), (2, lambda m: np.log(sf(x[m]) - sf(hi[m])))):
            m = c == flag
            if m.any():
                out[m] = f(m)
        cut = np.isfinite(tl) | np.isfinite(tr)
        if cut.any():
            out[cut] -= np.log(sf(tl[cut]) - sf(tr[cut]))
        total = float(np.sum(n * out))
    return total if np.isfinite(total) else -math.inf


def newton(f, start: np.ndarray, tol: float = 1e-10, steps: int = 200, many=None) -> tuple[np.ndarray, np.ndarray]:
    """(minimum, Hessian there) by damped Newton steps on central differences; the step shrinks until f falls.

    many: values at a list of points at once, so that a distributed objective needs one aggregation per step.
    """
    many = many or (lambda points: [f(p) for p in points])
    p = np.array(start, float)
    k = len(p)

    def derive(p):
        h = np.diag(1e-4 * np.maximum(1.0, np.abs(p)))
        pairs = [(i, j) for i in range(k) for j in range(i)]
        points = [p, *(p + e for e in h), *(p - e for e in h)]
        points += [p + a * h[i] + b * h[j] for i, j in pairs for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
        v = np.array(many(points), float)
        step, up, down = h.diagonal(), v[1 : k + 1], v[k + 1 : 2 * k + 1]
        hess = np.diag((up - 2 * v[0] + down) / step**2)
        for (i, j), q in zip(pairs, v[2 * k + 1 :].reshape(-1, 4)):
            hess[i, j] = hess[j, i] = (q[0] - q[1] - q[2] + q[3]) / (4 * step[i] * step[j])
        return v[0], (up - down) / (2 * step), hess

    for _ in range(steps):
        value, grad, hess = derive(p)
        if not (np.isfinite(grad).all() and np.isfinite(hess).all()):
            break
        vals, vecs = np.linalg.eigh(hess)
        move = -vecs @ ((vecs.T @ grad) / np.maximum(np.abs(vals), 1e-8))
        scales = [0.5**i for i in range(8)]
        tried = np.array(many([p + s * move for s in scales]), float)
        better = np.flatnonzero(tried < value)
        if not len(better):
            break
        best = better[0]
        p = p + scales[best] * move
        if value - tried[best] <= tol * (abs(value) + tol):
            break
    return p, derive(p)[2]


def at_points(rows: DataFrame, points: list[np.ndarray], value) -> list[float]:
    """Means over the rows of value(*parameters) at a few points: one aggregation. The points are a small table
    joined to the rows, so that Spark compiles the expression once for all steps of a search. A null makes a mean
    infinite."""
    width = len(points[0])
    names = ", ".join(f"__p{k} double" for k in range(width))
    table = rows.sparkSession.createDataFrame([(j, *map(float, p)) for j, p in enumerate(points)], f"__point int, {names}").coalesce(1)
    v = value(*[F.col(f"__p{k}") for k in range(width)])
    found = rows.join(F.broadcast(table)).groupBy("__point").agg(F.avg(v).alias("v"), F.count_if(v.isNull() | F.isnan(v)).alias("bad")).collect()
    means = {r["__point"]: math.inf if r.bad or r.v is None else r.v for r in found}
    return [means.get(j, math.inf) for j in range(len(points))]


def fit_mle(obs: DataFrame, family: str = "weibull") -> Fit:
    """Maximum likelihood for canonical rows. Positive parameters are searched on the log scale."""
    spec = FAMILIES[family]
    packed = compress(obs).cache()
    if packed.count() <= LOCAL_ROWS:
        pdf = packed.toPandas()
        rows = {k: pdf[k].to_numpy(float) for k in pdf}
        ll = lambda params: log_likelihood(rows, spec, params)
        x, n, c = (rows["x"] + rows["x_hi"]) / 2, rows["n"], rows["c"]
        total, seen, start = float(n.sum()), float(n[c == 0].sum()), spec.start(x, n)
    else:
        ll, total, seen, start = _distributed(packed, family, spec)
    pos = np.array(spec.positive)
    to = lambda q: np.where(pos, np.exp(np.clip(q, -700, 700)), q)
    best, hess = newton(lambda q: -ll(to(q)) / total, np.where(pos, np.log(np.where(pos, start, 1.0)), start))
    packed.unpersist()
    params = to(best)
    jac = np.diag(np.where(pos, params, 1.0))
    return Fit(family, dict(zip(spec.params, map(float, params))), jac @ np.linalg.pinv(hess * total) @ jac.T, -ll(params), total, seen or total)


def _distributed(packed: DataFrame, family: str, spec: Family):
    """The likelihood as one aggregation per evaluation, for families whose functions are columns."""
    from tidewatch.functions.distributions import DISTRIBUTIONS

    dist = DISTRIBUTIONS[family]
    agg = packed.agg(F.sum("n"), F.sum(F.when(F.col("c") == 0, F.col("n"))), F.sum(F.col("n") * F.col("x")) / F.sum("n"), F.sqrt(F.sum(F.col("n") * F.col("x") * F.col("x")) / F.sum("n"))).first()
    mid = np.array([max(agg[2] * 0.5, 1e-9), max(agg[2], 1e-9), max(agg[2] * 1.5, 2e-9)])

    def ll(params) -> float:
        p = [float(v) for v in params]
        sf = lambda v: F.when(v == -INF, 1.0).when(v == INF, 0.0).otherwise(dist.sf(v, *p))
        x, hi = F.col("x"), F.col("x_hi")
        one = F.when(F.col("c") == 0, dist.log_df(x, *p)).when(F.col("c") == 1, F.ln(dist.sf(x, *p))).when(F.col("c") == -1, F.ln(1 - dist.sf(x, *p))).otherwise(F.ln(dist.sf(x, *p) - dist.sf(hi, *p)))
        cut = F.when((F.col("tl") > -INF) | (F.col("tr") < INF), F.ln(sf(F.col("tl")) - sf(F.col("tr")))).otherwise(0.0)
        out = packed.agg(F.sum(F.col("n") * (one - cut))).first()[0]
        return -math.inf if out is None or math.isnan(out) else out

    return ll, float(agg[0]), float(agg[1] or agg[0]), spec.start(mid, np.ones(3))


def fit_best(obs: DataFrame, families: list[str] | None = None, metric: str = "aic") -> Fit:
    """The family with the least aic, aic_c, bic or neg_ll."""
    fits = [fit_mle(obs, f) for f in families or list(FAMILIES)]
    return min(fits, key=lambda m: getattr(m, metric))


#: Straight-line transforms of (time, failure probability): the probability plot's axes, and parameters from (slope, intercept).
PLOT = {
    "weibull": (F.ln, lambda p: F.ln(-F.log1p(-p)), lambda b, a: {"alpha": F.exp(-a / b), "beta": b}),
    "exponential": (lambda x: x, lambda p: -F.log1p(-p), lambda b, a: {"rate": b}),
    "gumbel": (lambda x: x, lambda p: F.ln(-F.log1p(-p)), lambda b, a: {"mu": -a / b, "sigma": 1 / b}),
    "gumbel_lev": (lambda x: x, lambda p: -F.ln(-F.ln(p)), lambda b, a: {"mu": -a / b, "sigma": 1 / b}),
    "logistic": (lambda x: x, lambda p: F.ln(p / (1 - p)), lambda b, a: {"mu": -a / b, "sigma": 1 / b}),
    "loglogistic": (F.ln, lambda p: F.ln(p / (1 - p)), lambda b, a: {"alpha": F.exp(-a / b), "beta": b}),
}


def fit_plot(curve: DataFrame, family: str, f: str = "f", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, parameters): a least-squares line through the probability plot, for all groups in one aggregation."""
    fx, fy, back = PLOT[family]
    own = curve.filter((F.col(f) > 0) & (F.col(f) < 1) & (F.col("d") > 0)).select(*by, fx(F.col("x")).alias("u"), fy(F.col(f)).alias("v"))
    line = own.groupBy(*by).agg(F.regr_slope("v", "u").alias("b"), F.regr_intercept("v", "u").alias("a"))
    return line.select(*by, *[v.alias(k) for k, v in back(F.col("b"), F.col("a")).items()])


def fit_closed(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, exp_rate, exp_neg_ll, rayleigh_sigma, uniform_a, uniform_b): fits that are one aggregation, for rows with flags 0 and 1."""
    n, x = F.col("n"), F.col("x")
    d = F.sum(F.when(F.col("c") == 0, n).otherwise(0.0))
    return obs.groupBy(*by).agg(d.alias("d"), F.sum(n * x).alias("t"), F.sum(n * x * x).alias("t2"), F.min("x").alias("uniform_a"), F.max("x").alias("uniform_b")).select(
        *by, (F.col("d") / F.col("t")).alias("exp_rate"), (F.col("d") - F.col("d") * F.ln(F.nullif(F.col("d") / F.col("t"), F.lit(0.0)))).alias("exp_neg_ll"),
        F.sqrt(F.col("t2") / (2 * F.nullif(F.col("d"), F.lit(0.0)))).alias("rayleigh_sigma"), "uniform_a", "uniform_b")


def moments(obs: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, m1 .. mk): weighted raw moments."""
    return obs.groupBy(*by).agg(*[(F.sum(F.col("n") * F.pow("x", F.lit(float(j)))) / F.sum("n")).alias(f"m{j}") for j in range(1, k + 1)])


def fit_defective(obs: DataFrame, family: str = "weibull") -> Fit:
    """A family where only a share p ever fails (rows with flags 0 and 1): survival 1 - p + p S."""
    spec = FAMILIES[family]
    pdf = _local(compress(obs))
    x, c, n = (pdf[k].to_numpy(float) for k in ("x", "c", "n"))
    dead = c == 0

    def loss(q):
        p = 1 / (1 + math.exp(-q[-1])) if abs(q[-1]) < 700 else float(q[-1] > 0)
        params = [math.exp(min(v, 700)) if pos else v for v, pos in zip(q[:-1], spec.positive)]
        with np.errstate(all="ignore"):
            out = np.where(dead, math.log(max(p, 1e-300)) + spec.log_df(x, *params), np.log(1 - p + p * np.exp(spec.log_sf(x, *params))))
        total = float(np.sum(n * out))
        return -total / n.sum() if np.isfinite(total) else math.inf

    share = float(n[dead].sum() / n.sum())
    start = [math.log(v) if pos else v for v, pos in zip(spec.start(x[dead], n[dead]), spec.positive)] + [math.log(share / max(1 - share, 1e-6)) + 0.5]
    best, hess = newton(loss, np.array(start))
    params = {k: (math.exp(v) if pos else float(v)) for k, v, pos in zip(spec.params, best, spec.positive)}
    return Fit(family, params, np.linalg.pinv(hess * n.sum()), loss(best) * n.sum(), float(n.sum()), float(n[dead].sum()), {"p": 1 / (1 + math.exp(-best[-1]))})


def fit_mixture(obs: DataFrame, components: int = 2, steps: int = 200, tol: float = 1e-9) -> list[tuple[float, float, float]]:
    """(weight, alpha, beta) of a mixture of Weibulls by EM on compressed rows with flags 0 and 1.

    Each M-step solves the weighted shape equation of every component by Newton's method.
    """
    pdf = _local(compress(obs)).sort_values("x")
    x, c, n = (pdf[k].to_numpy(float) for k in ("x", "c", "n"))
    dead, spec = c == 0, FAMILIES["weibull"]
    part = np.minimum((np.cumsum(n) / n.sum() * components).astype(int), components - 1)
    resp = np.where(np.arange(components)[:, None] == part, 0.8, 0.2 / max(1, components - 1))
    old = -math.inf
    out = []
    for _ in range(steps):
        out = []
        for k in range(components):
            w = resp[k] * n
            b, d = 1.0, float(w[dead].sum())
            for _ in range(60):
                xb = x**b
                s0, s1, s2 = (w * xb).sum(), (w * xb * np.log(x)).sum(), (w * xb * np.log(x) ** 2).sum()
                f = 1 / b + (w[dead] * np.log(x[dead])).sum() / d - s1 / s0
                step = f / (-1 / b**2 - (s2 / s0 - (s1 / s0) ** 2))
                b = max(b - step, b / 3)
                if abs(step) < 1e-12:
                    break
            out.append((float(w.sum() / n.sum()), float(((w * x**b).sum() / d) ** (1 / b)), float(b)))
        like = np.array([m * np.exp(np.where(dead, spec.log_df(x, a, b), spec.log_sf(x, a, b))) for m, a, b in out])
        total = like.sum(axis=0)
        resp = like / total
        now = float((n * np.log(total)).sum())
        if abs(now - old) < tol * abs(now):
            break
        old = now
    return sorted(out, key=lambda t: t[1])


def fit_spacings(obs: DataFrame, family: str = "weibull") -> dict[str, float]:
    """Maximum product of spacings for complete rows; ties count by density."""
    spec = FAMILIES[family]
    pdf = _local(compress(obs.filter("c = 0"))).groupby("x", as_index=False)["n"].sum().sort_values("x")
    x, n = pdf["x"].to_numpy(float), pdf["n"].to_numpy(float)
    pos = np.array(spec.positive)

    def loss(q):
        params = np.where(pos, np.exp(np.clip(q, -700, 700)), q)
        with np.errstate(all="ignore"):
            sf = np.concatenate(([1.0], np.exp(spec.log_sf(x, *params)), [0.0]))
            out = np.log(np.maximum(sf[:-1] - sf[1:], 1e-300)).sum() + ((n - 1) * spec.log_df(x, *params)).sum()
        return -float(out) / n.sum() if np.isfinite(out) else math.inf

    start = spec.start(x, n)
    best, _ = newton(loss, np.where(pos, np.log(np.where(pos, start, 1.0)), start))
    return dict(zip(spec.params, map(float, np.where(pos, np.exp(best), best))))


def fit_curve(curve: DataFrame, family: str = "weibull", sf: str = "fh") -> dict[str, float]:
    """Least squares of a family's failure probability against an estimated curve."""
    spec = FAMILIES[family]
    pdf = _local(curve.filter("d > 0").select("x", sf))
    x, s = pdf["x"].to_numpy(float), pdf[sf].to_numpy(float)
    pos = np.array(spec.positive)

    def loss(q):
        with np.errstate(all="ignore"):
            out = float(((np.exp(spec.log_sf(x, *np.where(pos, np.exp(np.clip(q, -700, 700)), q))) - s) ** 2).sum())
        return out if np.isfinite(out) else math.inf

    start = spec.start(x, np.ones(len(x)))
    best, _ = newton(loss, np.where(pos, np.log(np.where(pos, start, 1.0)), start))
    return dict(zip(spec.params, map(float, np.where(pos, np.exp(best), best))))


def fit_moments(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, parameters) by the method of moments for complete rows: normal, exponential, gamma, gumbel and uniform, in one aggregation."""
    m = moments(obs, 2, by)
    var = F.col("m2") - F.col("m1") * F.col("m1")
    sd = F.sqrt(var)
    return m.select(*by, F.col("m1").alias("normal_mu"), sd.alias("normal_sigma"), (1 / F.col("m1")).alias("exponential_rate"), F.try_divide(F.col("m1") * F.col("m1"), var).alias("gamma_alpha"),
                    F.try_divide(F.col("m1"), var).alias("gamma_beta"), (sd * math.sqrt(6) / math.pi).alias("gumbel_sigma"), (F.col("m1") + 0.5772156649015329 * sd * math.sqrt(6) / math.pi).alias("gumbel_mu"),
                    (F.col("m1") - math.sqrt(3) * sd).alias("uniform_a"), (F.col("m1") + math.sqrt(3) * sd).alias("uniform_b"))


def life_model(fit: Fit):
    """A fit as a model of columns."""
    from tidewatch.functions.models import LifeModel

    return LifeModel(fit.family, list(fit.params.values()), fit.covariance.tolist(), p=fit.extra.get("p", 1.0))


def fit_latent(df: DataFrame, x: str, cause: str, family: str = "weibull", n: str | None = None) -> dict[str, Fit]:
    """A family for each cause of independent competing risks: other causes count as censored there."""
    from tidewatch.operators.observations import observations

    causes = [r[0] for r in df.select(cause).filter(F.col(cause).isNotNull()).distinct().orderBy(cause).collect()]  # a handful by nature
    out = {}
    for k in causes:
        own = observations(df.withColumn("__c", F.when(F.col(cause) == k, 0).otherwise(1)), x=x, c="__c", n=n)
        out[k] = fit_mle(own, family)
    return out


def survival_probability(rows: DataFrame, model, times: list[float], *arguments: str) -> DataFrame:
    """The rows, once for each time t, with sf: a model's survival at t (model.sf takes a column)."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in times]))
    return rows.withColumn("t", grid).withColumn("sf", model.sf(F.col("t"), *map(F.col, arguments)))
