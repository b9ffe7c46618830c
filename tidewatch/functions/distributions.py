"""Life distributions as column expressions, evaluated inside whole-stage code."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewatch.functions import special


@dataclass(frozen=True)
class Distribution:
    """A family: survival, log density and quantile as functions of a column and parameters."""

    name: str
    params: tuple[str, ...]
    sf: Callable[..., Column]
    log_df: Callable[..., Column]
    qf: Callable[..., Column]
    mean: Callable[..., float]

    def ff(self, x: Column, *p: float) -> Column:
        return 1 - self.sf(x, *p)

    def df(self, x: Column, *p: float) -> Column:
        return F.exp(self.log_df(x, *p))

    def Hf(self, x: Column, *p: float) -> Column:
        return -F.ln(F.nullif(self.sf(x, *p), F.lit(0.0)))

    def hf(self, x: Column, *p: float) -> Column:
        return F.try_divide(self.df(x, *p), self.sf(x, *p))

    def cs(self, x: Column, given: Column, *p: float) -> Column:
        """Survival of x more, given survival to `given`."""
        return F.least(F.lit(1.0), F.try_divide(self.sf(x + given, *p), self.sf(given, *p)))


def _kernel(f: Callable) -> Callable:
    """A column function from a numpy kernel, in Arrow batches."""
    def build(x: Column, *p: float) -> Column:
        @pandas_udf("double")
        def run(v: pd.Series) -> pd.Series:
            return pd.Series(f(v.to_numpy(float), *p))
        return run(x)
    return build


_each = lambda f: lambda v, *p: np.array([f(t, *p) for t in v])
_normal_sf = _kernel(lambda v, m, s: special.norm_cdf(-(v - m) / s))
_normal_qf = _kernel(lambda v, m, s: m + s * special.norm_ppf(v))
_gamma_sf = _kernel(_each(lambda t, a, b: 1 - special.gammainc(a, b * t)))
_gamma_qf = _kernel(_each(lambda q, a, b: special.invert(lambda t: special.gammainc(a, b * t), q, 0.0, (a + 40 * math.sqrt(a) + 40) / b)))
_beta_sf = _kernel(_each(lambda t, a, b: 1 - special.betainc(a, b, t)))
_beta_qf = _kernel(_each(lambda q, a, b: special.invert(lambda t: special.betainc(a, b, t), q, 0.0, 1.0)))
_poisson_sf = _kernel(_each(lambda k, m: special.gammainc(math.floor(k) + 1, m)))
_binomial_sf = _kernel(_each(lambda k, n, p: 1.0 if k < 0 else special.betainc(math.floor(k) + 1, n - math.floor(k), p) if k < n else 0.0))
_negative_binomial_sf = _kernel(_each(lambda k, r, p: 1.0 if k < 1 else special.betainc(math.floor(k), r, 1 - p)))
_beta_geometric_sf = _kernel(_each(lambda k, a, b: math.exp(math.lgamma(b + k) - math.lgamma(a + b + k) - math.lgamma(b) + math.lgamma(a + b))))


def _count_qf(sf: Callable[..., float], first: int) -> Callable:
    """The least count at which 1 - survival reaches p: doubling, then bisection."""
    def find(p: float, *args: float) -> float:
        low, high = first - 1, first
        while 1 - sf(high, *args) < p and high < 2**40:
            low, high = high, 2 * high + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if 1 - sf(mid, *args) >= p else (mid, high)
        return float(high)
    return _kernel(_each(find))


_log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
_EULER = 0.5772156649015329  # fixed value


def _z(x: Column, m: float, s: float) -> Column:
    return (x - m) / s


DISTRIBUTIONS: dict[str, Distribution] = {d.name: d for d in (
    Distribution("weibull", ("alpha", "beta"), lambda x, a, b: F.exp(-F.pow(x / a, F.lit(b))),
                 lambda x, a, b: math.log(b / a) + (b - 1) * F.ln(x / a) - F.pow(x / a, F.lit(b)),
                 lambda p, a, b: a * F.pow(-F.log1p(-p), F.lit(1 / b)), lambda a, b: a * math.gamma(1 + 1 / b)),
    Distribution("exponential", ("rate",), lambda x, r: F.exp(-r * x), lambda x, r: math.log(r) - r * x, lambda p, r: -F.log1p(-p) / r, lambda r: 1 / r),
    Distribution("rayleigh", ("sigma",), lambda x, s: F.exp(-x * x / (2 * s * s)), lambda x, s: F.ln(x) - 2 * math.log(s) - x * x / (2 * s * s),
                 lambda p, s: s * F.sqrt(-2 * F.log1p(-p)), lambda s: s * math.sqrt(math.pi / 2)),
    Distribution("expo_weibull", ("alpha", "beta", "mu"), lambda x, a, b, m: 1 - F.pow(1 - F.exp(-F.pow(x / a, F.lit(b))), F.lit(m)),
                 lambda x, a, b, m: math.log(m * b / a) + (b - 1) * F.ln(x / a) - F.pow(x / a, F.lit(b)) + (m - 1) * F.ln(1 - F.exp(-F.pow(x / a, F.lit(b)))),
                 lambda p, a, b, m: a * F.pow(-F.log1p(-F.pow(p, F.lit(1 / m))), F.lit(1 / b)), lambda a, b, m: math.nan),
    Distribution("gumbel", ("mu", "sigma"), lambda x, m, s: F.exp(-F.exp(_z(x, m, s))), lambda x, m, s: _z(x, m, s) - F.exp(_z(x, m, s)) - math.log(s),
                 lambda p, m, s: m + s * F.ln(-F.log1p(-p)), lambda m, s: m - s * _EULER),
    Distribution("gumbel_lev", ("mu", "sigma"), lambda x, m, s: 1 - F.exp(-F.exp(-_z(x, m, s))), lambda x, m, s: -_z(x, m, s) - F.exp(-_z(x, m, s)) - math.log(s),
                 lambda p, m, s: m - s * F.ln(-F.ln(p)), lambda m, s: m + s * _EULER),
    Distribution("logistic", ("mu", "sigma"), lambda x, m, s: 1 / (1 + F.exp(_z(x, m, s))), lambda x, m, s: -_z(x, m, s) - math.log(s) - 2 * F.log1p(F.exp(-_z(x, m, s))),
                 lambda p, m, s: m + s * (F.ln(p) - F.log1p(-p)), lambda m, s: m),
    Distribution("loglogistic", ("alpha", "beta"), lambda x, a, b: 1 / (1 + F.pow(x / a, F.lit(b))),
                 lambda x, a, b: math.log(b / a) + (b - 1) * F.ln(x / a) - 2 * F.log1p(F.pow(x / a, F.lit(b))),
                 lambda p, a, b: a * F.pow(p / (1 - p), F.lit(1 / b)), lambda a, b: a * (math.pi / b) / math.sin(math.pi / b) if b > 1 else math.nan),
    Distribution("normal", ("mu", "sigma"), _normal_sf, lambda x, m, s: -0.5 * _z(x, m, s) * _z(x, m, s) - math.log(s * math.sqrt(2 * math.pi)), _normal_qf, lambda m, s: m),
    Distribution("lognormal", ("mu", "sigma"), lambda x, m, s: _normal_sf(F.ln(x), m, s),
                 lambda x, m, s: -0.5 * _z(F.ln(x), m, s) * _z(F.ln(x), m, s) - math.log(s * math.sqrt(2 * math.pi)) - F.ln(x),
                 lambda p, m, s: F.exp(_normal_qf(p, m, s)), lambda m, s: math.exp(m + s * s / 2)),
    Distribution("gamma", ("alpha", "beta"), _gamma_sf, lambda x, a, b: a * math.log(b) + (a - 1) * F.ln(x) - b * x - math.lgamma(a), _gamma_qf, lambda a, b: a / b),
    Distribution("beta", ("alpha", "beta"), _beta_sf,
                 lambda x, a, b: (a - 1) * F.ln(x) + (b - 1) * F.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b), _beta_qf, lambda a, b: a / (a + b)),
    Distribution("uniform", ("a", "b"), lambda x, a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (b - x) / (b - a))), lambda x, a, b: F.lit(-math.log(b - a)) + x * 0,
                 lambda p, a, b: a + p * (b - a), lambda a, b: (a + b) / 2),
    Distribution("geometric", ("p",), lambda x, p: F.pow(F.lit(1 - p), x), lambda x, p: (x - 1) * math.log1p(-p) + math.log(p),
                 lambda u, p: F.greatest(F.ceil(F.log1p(-u) / math.log1p(-p)), F.lit(1)).cast("double"), lambda p: 1 / p),
    Distribution("discrete_weibull", ("q", "beta"), lambda x, q, b: F.pow(F.lit(q), F.pow(x, F.lit(b))),
                 lambda x, q, b: F.ln(F.pow(F.lit(q), F.pow(x - 1, F.lit(b))) - F.pow(F.lit(q), F.pow(x, F.lit(b)))),
                 lambda u, q, b: F.ceil(F.pow(F.log1p(-u) / math.log(q), F.lit(1 / b))).cast("double"), lambda q, b: math.nan),
    Distribution("beta4", ("alpha", "beta", "a", "b"), lambda x, p, q, a, b: _beta_sf((x - a) / (b - a), p, q),
                 lambda x, p, q, a, b: (p - 1) * F.ln((x - a) / (b - a)) + (q - 1) * F.ln((b - x) / (b - a)) + math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) - math.log(b - a),
                 lambda u, p, q, a, b: a + (b - a) * _beta_qf(u, p, q), lambda p, q, a, b: a + (b - a) * p / (p + q)),
    Distribution("poisson", ("mu",), _poisson_sf, _kernel(_each(lambda k, m: k * math.log(m) - m - math.lgamma(k + 1))), _count_qf(lambda k, m: special.gammainc(k + 1, m), 0), lambda m: m),
    Distribution("binomial", ("n", "p"), _binomial_sf, _kernel(_each(lambda k, n, p: _log_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p))),
                 _count_qf(lambda k, n, p: special.betainc(k + 1, n - k, p) if k < n else 0.0, 0), lambda n, p: n * p),
    Distribution("negative_binomial", ("r", "p"), _negative_binomial_sf,
                 _kernel(_each(lambda k, r, p: math.lgamma(k - 1 + r) - math.lgamma(r) - math.lgamma(k) + r * math.log(p) + (k - 1) * math.log1p(-p))),
                 _count_qf(lambda k, r, p: special.betainc(k, r, 1 - p), 1), lambda r, p: 1 + r * (1 - p) / p),
    Distribution("beta_geometric", ("a", "b"), _beta_geometric_sf,
                 _kernel(_each(lambda k, a, b: math.lgamma(a + 1) + math.lgamma(b + k - 1) - math.lgamma(a + b + k) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))),
                 _count_qf(lambda k, a, b: math.exp(math.lgamma(b + k) - math.lgamma(a + b + k) - math.lgamma(b) + math.lgamma(a + b)), 1), lambda a, b: (a + b - 1) / (a - 1) if a > 1 else math.inf),
    Distribution("exact", ("t",), lambda x, t: F.when(x < t, 1.0).otherwise(0.0), lambda x, t: F.when(x == t, 0.0).otherwise(-math.inf), lambda p, t: p * 0 + t, lambda t: t),
    Distribution("never", (), lambda x: x * 0 + 1.0, lambda x: x * 0 - math.inf, lambda p: p * 0 + math.inf, lambda: math.inf),
    Distribution("at_once", (), lambda x: x * 0, lambda x: x * 0 - math.inf, lambda p: p * 0, lambda: 0.0),
)}


def custom(name: str, params: tuple[str, ...], cumulative_hazard: Callable[..., Column], hazard: Callable[..., Column] | None = None) -> Distribution:
    """A family given by its cumulative hazard as a column; the hazard is a central difference unless given."""
    h = hazard or (lambda x, *p: (cumulative_hazard(x + 1e-5, *p) - cumulative_hazard(x - 1e-5, *p)) / 2e-5)
    missing = lambda *_: F.lit(None).cast("double")
    return Distribution(name, params, lambda x, *p: F.exp(-cumulative_hazard(x, *p)), lambda x, *p: F.ln(h(x, *p)) - cumulative_hazard(x, *p), missing, lambda *p: math.nan)


def discretized(d: Distribution) -> Distribution:
    """Counts whose survival at k is that of d."""
    return Distribution(f"discrete_{d.name}", d.params, d.sf, lambda k, *p: F.ln(d.sf(k - 1, *p) - d.sf(k, *p)), lambda u, *p: F.ceil(d.qf(u, *p)).cast("double"), lambda *p: math.nan)


def sample(spark, d: Distribution, size: int, *params: float, seed: int = 1):
    """(id, x): draws by the quantile of uniform numbers."""
    return spark.range(size).select("id", d.qf(F.rand(seed), *params).alias("x"))


def first_passage(t: Column, level: float, drift: float, sigma: float) -> Column:
    """P(a Wiener process with drift has crossed the level by t): the inverse Gaussian distribution."""
    root = sigma * F.sqrt(t)
    return _normal_sf((level - drift * t) / root, 0.0, 1.0) + math.exp(min(700.0, 2 * drift * level / sigma**2)) * _normal_sf((level + drift * t) / root, 0.0, 1.0)


def series(parts: list[Column]) -> Column:
    """Survival of a system that needs all of its parts."""
    out = F.lit(1.0)
    for s in parts:
        out = out * s
    return out


def parallel(parts: list[Column]) -> Column:
    """Survival of a system that needs one of its parts."""
    out = F.lit(1.0)
    for s in parts:
        out = out * (1 - s)
    return 1 - out


def mixture(parts: list[tuple[float, Column]]) -> Column:
    """Survival of a weighted mixture."""
    return sum((w * s for w, s in parts), F.lit(0.0))


def limited_failure(sf: Column, p: float, f0: float = 0.0) -> Column:
    """Survival where only the share p ever fails and the share f0 failed at the start."""
    return 1 - p + (p - f0) * sf


#: Life-stress relations: a life parameter as a function of stress columns.
STRESS = {
    "power": lambda z, a, n: a * F.pow(z, F.lit(n)),
    "inverse-power": lambda z, a, n: 1 / (a * F.pow(z, F.lit(n))),
    "exponential": lambda z, a, b: b * F.exp(a / z),
    "inverse-exponential": lambda z, a, b: 1 / (b * F.exp(a / z)),
    "eyring": lambda z, a, c: F.exp(-(c - a / z)) / z,
    "inverse-eyring": lambda z, a, c: z * F.exp(c - a / z),
    "linear": lambda z, a, b: a + b * z,
    "log-linear": lambda z, a, b: F.exp(a + b * z),
}
