"""Accelerated life: a family whose life parameter follows from stresses by a relation.

All relations are lines on the log scale, ln life = b0 + sum of b_k g_k(stress), some with a known offset, so one
likelihood serves them; their usual parameters are read off the coefficients.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.fit import at_points, newton

_log, _inverse, _same = F.ln, (lambda z: 1 / z), (lambda z: z)


@dataclass(frozen=True)
class Relation:
    """Transforms of the stresses (one for each, or one for all), the offset, and the usual parameters from coefficients."""

    transforms: tuple[Callable[[Column], Column], ...]
    back: Callable[[list[float]], dict[str, float]]
    offset: Callable[[Column], Column] | None = None

    def terms(self, z: list[str]) -> list[Column]:
        own = self.transforms * len(z) if len(self.transforms) == 1 else self.transforms
        if len(own) != len(z):
            raise ValueError(f"this relation takes {len(self.transforms)} stresses")
        return [g(F.col(k).cast("double")) for g, k in zip(own, z)]


RELATIONS: dict[str, Relation] = {
    "power": Relation((_log,), lambda b: {"a": math.exp(b[0]), "n": b[1]}),
    "inverse-power": Relation((_log,), lambda b: {"a": math.exp(-b[0]), "n": -b[1]}),
    "exponential": Relation((_inverse,), lambda b: {"a": b[1], "b": math.exp(b[0])}),
    "inverse-exponential": Relation((_inverse,), lambda b: {"a": -b[1], "b": math.exp(-b[0])}),
    "eyring": Relation((_inverse,), lambda b: {"a": b[1], "c": -b[0]}, lambda z: -F.ln(z)),
    "inverse-eyring": Relation((_inverse,), lambda b: {"a": -b[1], "c": b[0]}, lambda z: F.ln(z)),
    "general-log-linear": Relation((_same,), lambda b: {f"b{k}": v for k, v in enumerate(b)}),
    "dual-power": Relation((_log, _log), lambda b: {"c": math.exp(b[0]), "m": b[1], "n": b[2]}),
    "dual-exponential": Relation((_inverse, _inverse), lambda b: {"c": math.exp(b[0]), "a": b[1], "b": b[2]}),
    "power-exponential": Relation((_inverse, _log), lambda b: {"c": math.exp(b[0]), "a": b[1], "n": b[2]}),
}
#: Cumulative hazard and log hazard at time x of a life l (both columns) and a log shape.
FAMILIES = {
    "exponential": (False, lambda x, l, s: F.exp(F.ln(x) - l), lambda x, l, s: -l),
    "weibull": (True, lambda x, l, s: F.exp(F.exp(s) * (F.ln(x) - l)), lambda x, l, s: s - F.ln(x) + F.exp(s) * (F.ln(x) - l)),
    "loglogistic": (True, lambda x, l, s: F.log1p(F.exp(F.exp(s) * (F.ln(x) - l))), lambda x, l, s: s - F.ln(x) + F.exp(s) * (F.ln(x) - l) - F.log1p(F.exp(F.exp(s) * (F.ln(x) - l)))),
}


@dataclass
class AcceleratedLife:
    """A fitted relation: coefficients on the log scale, the shape (1 without one), its usual parameters, neg_ll."""

    family: str
    relation: str
    z: list[str]
    coefficients: list[float]
    shape: float
    neg_ll: float
    covariance: np.ndarray

    @property
    def params(self) -> dict[str, float]:
        return RELATIONS[self.relation].back(self.coefficients) | ({"shape": self.shape} if FAMILIES[self.family][0] else {})

    def log_life(self) -> Column:
        own = RELATIONS[self.relation]
        out = sum((float(b) * t for b, t in zip(self.coefficients[1:], own.terms(self.z))), F.lit(float(self.coefficients[0])))
        return out + own.offset(F.col(self.z[0]).cast("double")) if own.offset else out

    def life(self) -> Column:
        """The life parameter at the row's stresses."""
        return F.exp(self.log_life())

    def Hf(self, x: Column) -> Column:
        return FAMILIES[self.family][1](x, self.log_life(), F.lit(math.log(self.shape)))

    def sf(self, x: Column) -> Column:
        return F.exp(-self.Hf(x))

    def hf(self, x: Column) -> Column:
        return F.exp(FAMILIES[self.family][2](x, self.log_life(), F.lit(math.log(self.shape))))


def fit_accelerated(df: DataFrame, x: str, c: str, z: list[str], relation: str = "power", family: str = "weibull", n: str | None = None) -> AcceleratedLife:
    """Maximum likelihood for events and right-censored rows (c 0 and 1) with positive times; rows with nulls go.

    Equal rows are summed first; each Newton step is one aggregation over all shifted parameters.
    """
    shaped, H, log_h = FAMILIES[family]
    own = RELATIONS[relation]
    weight = F.col(n).cast("double") if n else F.lit(1.0)
    rows = df.dropna(subset=[x, c, *z]).filter(F.col(x) > 0).groupBy(F.col(x).cast("double").alias("x"), F.col(c).alias("c"), *z).agg(F.sum(weight).alias("n"))
    rows = rows.select("x", "c", "n", *[t.alias(f"g{k}") for k, t in enumerate(own.terms(z))], (own.offset(F.col(z[0]).cast("double")) if own.offset else F.lit(0.0)).alias("o")).cache()
    total, groups, start = rows.agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * (F.ln("x") - F.col("o"))) / F.sum("n")).first()
    size = 1 + len(z)

    def loss(*p: Column) -> Column:
        life = F.col("o") + p[0] + sum((b * F.col(f"g{k}") for k, b in enumerate(p[1:size])), F.lit(0.0))
        shape = p[size] if shaped else F.lit(0.0)
        return F.col("n") * (H(F.col("x"), life, shape) - F.when(F.col("c") == 0, log_h(F.col("x"), life, shape)).otherwise(0.0))

    many = lambda points: [v * groups / total for v in at_points(rows, points, loss)]
    best, hess = newton(lambda p: many([p])[0], np.array([float(start)] + [0.0] * len(z) + [0.0] * shaped), tol=1e-10, steps=40, many=many)
    value = many([best])[0] * total
    rows.unpersist()
    return AcceleratedLife(family, relation, z, [float(b) for b in best[:size]], math.exp(best[size]) if shaped else 1.0, float(value), np.linalg.pinv(hess * total))
