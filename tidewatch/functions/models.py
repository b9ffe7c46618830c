"""Fitted or given models as columns: life distributions and regressions, with limits, saved as JSON."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.distributions import DISTRIBUTIONS

#: Newer payloads than this are refused.
VERSION = 1


@dataclass
class LifeModel:
    """A family with parameters, and optionally an offset, a share that ever fails (p) and a share that fails at 0 (f0)."""

    family: str
    params: list[float]
    covariance: list[list[float]] = field(default_factory=list)
    gamma: float = 0.0
    p: float = 1.0
    f0: float = 0.0

    def __post_init__(self) -> None:
        if self.family not in DISTRIBUTIONS:
            raise ValueError(f"unknown family {self.family}")
        if len(self.params) != len(DISTRIBUTIONS[self.family].params):
            raise ValueError(f"{self.family} has the parameters {', '.join(DISTRIBUTIONS[self.family].params)}")
        if not 0 <= self.f0 < self.p <= 1:
            raise ValueError("0 <= f0 < p <= 1 is needed")

    def _sf(self, x: Column, params: list[float]) -> Column:
        d = DISTRIBUTIONS[self.family]
        base = d.sf(x - self.gamma if self.gamma else x, *params)
        base = F.when(x > self.gamma, base).otherwise(1.0) if self.gamma else base
        return base if (self.p, self.f0) == (1.0, 0.0) else F.when(x >= self.gamma, 1 - self.f0 - (self.p - self.f0) * (1 - base)).otherwise(1.0)

    def sf(self, x: Column) -> Column:
        return self._sf(x, self.params)

    def ff(self, x: Column) -> Column:
        return 1 - self.sf(x)

    def Hf(self, x: Column) -> Column:
        return -F.ln(F.nullif(self.sf(x), F.lit(0.0)))

    def df(self, x: Column) -> Column:
        t = x - self.gamma if self.gamma else x
        return (self.p - self.f0) * DISTRIBUTIONS[self.family].df(t, *self.params)

    def hf(self, x: Column) -> Column:
        return F.try_divide(self.df(x), self.sf(x))

    def qf(self, q: Column) -> Column:
        """The time by which a share q has failed; infinite beyond the share that ever fails."""
        inside = (q - self.f0) / (self.p - self.f0)
        found = self.gamma + DISTRIBUTIONS[self.family].qf(F.greatest(F.lit(0.0), inside), *self.params)
        return F.when(q <= self.f0, F.lit(self.gamma)).when(q >= self.p, F.when((q == 1.0) & F.lit(self.p == 1.0), found).otherwise(math.inf)).otherwise(found)

    def random(self, seed: int) -> Column:
        return self.qf(F.rand(seed))

    def _variance(self, f) -> Column:
        """Delta-method variance of f(params) with a central difference for each parameter."""
        grads = []
        for j, v in enumerate(self.params):
            h = 1e-5 * max(abs(v), 1e-3)
            up, down = list(self.params), list(self.params)
            up[j], down[j] = v + h, v - h
            grads.append((f(up) - f(down)) / (2 * h))
        return sum((grads[i] * grads[j] * float(self.covariance[i][j]) for i in range(len(grads)) for j in range(len(grads))), F.lit(0.0))

    def limits(self, x: Column, on: str = "sf", alpha: float = 0.05) -> tuple[Column, Column]:
        """(lower, upper) of sf, ff or Hf, symmetric on the logit scale of the survival; of hf or df on the log scale."""
        if not self.covariance:
            raise ValueError("the model has no covariance")
        z = NormalDist().inv_cdf(1 - alpha / 2)
        if on in ("hf", "df"):
            d = DISTRIBUTIONS[self.family]
            rate = (lambda q: d.df(x, *q) / d.sf(x, *q)) if on == "hf" else (lambda q: d.df(x, *q))
            if (self.gamma, self.p, self.f0) != (0.0, 1.0, 0.0):
                raise ValueError("limits of rates are for plain models")
            value = rate(self.params)
            width = F.exp(z * F.sqrt(self._variance(rate)) / value)
            return value / width, value * width
        s = self.sf(x)
        half = z * F.sqrt(self._variance(lambda q: self._sf(x, q))) / (s * (1 - s))
        logit = F.ln(s / (1 - s))
        low, high = (F.when((s > 0) & (s < 1), 1 / (1 + F.exp(-(logit + k * half)))).otherwise(s) for k in (-1, 1))
        return {"sf": (low, high), "ff": (1 - high, 1 - low), "Hf": (-F.ln(high), -F.ln(low))}[on]

    def to_json(self) -> str:
        return json.dumps({"kind": "life", "version": VERSION} | asdict(self))


#: Baselines of regressions: cumulative hazard and hazard of time, with positive parameters.
BASELINES = {
    "exponential": (lambda x, a: x / a, lambda x, a: x * 0 + 1 / a),
    "weibull": (lambda x, a, b: F.pow(x / a, F.lit(b)), lambda x, a, b: b / a * F.pow(x / a, F.lit(b - 1))),
    "loglogistic": (lambda x, a, b: F.log1p(F.pow(x / a, F.lit(b))), lambda x, a, b: b / a * F.pow(x / a, F.lit(b - 1)) / (1 + F.pow(x / a, F.lit(b)))),
    "gumbel": (lambda x, m, s: F.exp((x - m) / s), lambda x, m, s: F.exp((x - m) / s) / s),
    "logistic": (lambda x, m, s: F.log1p(F.exp((x - m) / s)), lambda x, m, s: 1 / (s * (1 + F.exp(-(x - m) / s)))),
    "rayleigh": (lambda x, s: x * x / (2 * s * s), lambda x, s: x / (s * s)),
}


@dataclass
class RegressionModel:
    """Hazards times phi (ph), time times phi (aft), odds times phi (po), hazards plus zb (ah), with phi = exp(zb)."""

    kind: str
    baseline: str
    params: list[float]
    names: list[str]
    beta: list[float]

    def __post_init__(self) -> None:
        if self.kind not in ("ph", "aft", "po", "ah") or self.baseline not in BASELINES:
            raise ValueError(f"unknown model {self.kind} {self.baseline}")

    def lin(self) -> Column:
        return sum((F.lit(float(b)) * F.col(k) for b, k in zip(self.beta, self.names)), F.lit(0.0))

    def phi(self) -> Column:
        return F.exp(self.lin())

    def Hf(self, x: Column) -> Column:
        H = lambda t: BASELINES[self.baseline][0](t, *self.params)
        if self.kind == "ph":
            return self.phi() * H(x)
        if self.kind == "aft":
            return H(self.phi() * x)
        if self.kind == "ah":
            return H(x) + self.lin() * x
        s = F.exp(-H(x))
        return -F.ln(self.phi() * s / (1 - s + self.phi() * s))

    def hf(self, x: Column) -> Column:
        H, h = (lambda t, f=f: f(t, *self.params) for f in BASELINES[self.baseline])
        if self.kind == "ph":
            return self.phi() * h(x)
        if self.kind == "aft":
            return self.phi() * h(self.phi() * x)
        if self.kind == "ah":
            return F.greatest(F.lit(0.0), h(x) + self.lin())
        s = F.exp(-H(x))
        return h(x) / (1 - s + self.phi() * s)

    def sf(self, x: Column) -> Column:
        return F.exp(-self.Hf(x))

    def ff(self, x: Column) -> Column:
        return -F.expm1(-self.Hf(x))

    def df(self, x: Column) -> Column:
        return self.hf(x) * self.sf(x)

    def to_json(self) -> str:
        return json.dumps({"kind": "regression", "version": VERSION} | {("form" if k == "kind" else k): v for k, v in asdict(self).items()})


def from_json(text: str) -> LifeModel | RegressionModel:
    """The model that to_json wrote; payloads of a newer version are refused."""
    data = json.loads(text)
    kind, version = data.pop("kind"), data.pop("version")
    if version > VERSION:
        raise ValueError(f"model of version {version}; this engine reads up to {VERSION}")
    if kind == "life":
        return LifeModel(**data)
    return RegressionModel(kind=data.pop("form"), **data)


def competing_incidence(models: dict[str, LifeModel], t_max: float, steps: int = 4000):
    """A function of a session: (cause, x, iif, cif) of independent latent causes on an even grid up to t_max.

    cif is the trapezoid integral of the cause's density times the other causes' survival.
    """
    def build(spark):
        from tidewatch.operators.running import latest, running, total

        names = list(models)
        grid = spark.range(steps).select((F.col("id") * (t_max / (steps - 1))).alias("x"))
        x = F.col("x")
        density = lambda k: models[k].df(x) * math.prod([models[j].sf(x) for j in names if j != k], start=F.lit(1.0))
        grid = grid.select("x", *[density(k).alias(f"f{j}") for j, k in enumerate(names)])
        finite = {f"f{j}": F.when(F.col(f"f{j}").isNull() | F.isnan(f"f{j}") | (F.abs(F.col(f"f{j}")) == math.inf), 0.0).otherwise(F.col(f"f{j}")) for j in range(len(names))}
        grid = running(grid.withColumns(finite), (), "x", {"p": latest(x, before=True)} | {f"b{j}": latest(F.col(f"f{j}"), before=True) for j in range(len(names))})
        area = lambda j: F.coalesce((x - F.col("p")) * (F.col(f"f{j}") + F.col(f"b{j}")) / 2, F.lit(0.0))
        grid = running(grid, (), "x", {f"c{j}": total(area(j)) for j in range(len(names))})
        rows = F.explode(F.array(*[F.struct(F.lit(k).alias("cause"), F.col(f"f{j}").alias("iif"), F.col(f"c{j}").alias("cif")) for j, k in enumerate(names)]))
        return grid.select("x", rows.alias("k")).select("k.cause", "x", "k.iif", "k.cif")

    return build
