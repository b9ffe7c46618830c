"""Copulas as column expressions: joint probability, density, conditional probability and Kendall's tau."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.running import running, total


@dataclass(frozen=True)
class Copula:
    name: str
    cdf: Callable[..., Column]
    given_u: Callable[..., Column]  # P(V <= v | U = u)
    pdf: Callable[..., Column]
    tau: Callable[[float], float]
    from_tau: Callable[[float], float]


def _pow(x, k: float) -> Column:
    return F.pow(x, F.lit(k))


def _gumbel_sum(u, v, t):
    return _pow(-F.ln(u), t) + _pow(-F.ln(v), t)


def _gumbel_cdf(u, v, t):
    return F.exp(-_pow(_gumbel_sum(u, v, t), 1 / t))


def _frank_cdf(u, v, t):
    return -F.ln(1 + (F.exp(-t * u) - 1) * (F.exp(-t * v) - 1) / math.expm1(-t)) / t


def _frank_tau(t: float) -> float:
    if abs(t) < 1e-8:
        return 0.0
    x = np.linspace(1e-9, abs(t), 4001)
    debye = np.trapezoid(x / np.expm1(x), x) / abs(t)
    return math.copysign(1 - 4 / abs(t) * (1 - debye), t)


def _invert(f, target: float, low: float, high: float) -> float:
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < target else (low, mid)
    return (low + high) / 2


COPULAS = {c.name: c for c in (
    Copula("independence", lambda u, v, t=0: u * v, lambda u, v, t=0: v, lambda u, v, t=0: u * 0 + 1.0, lambda t=0: 0.0, lambda tau: 0.0),
    Copula("clayton", lambda u, v, t: _pow(_pow(u, -t) + _pow(v, -t) - 1, -1 / t),
           lambda u, v, t: _pow(u, -t - 1) * _pow(_pow(u, -t) + _pow(v, -t) - 1, -1 / t - 1),
           lambda u, v, t: (1 + t) * _pow(u * v, -t - 1) * _pow(_pow(u, -t) + _pow(v, -t) - 1, -1 / t - 2),
           lambda t: t / (t + 2), lambda tau: 2 * tau / (1 - tau)),
    Copula("gumbel", _gumbel_cdf,
           lambda u, v, t: _gumbel_cdf(u, v, t) * _pow(_gumbel_sum(u, v, t), 1 / t - 1) * _pow(-F.ln(u), t - 1) / u,
           lambda u, v, t: _gumbel_cdf(u, v, t) / (u * v) * _pow(F.ln(u) * F.ln(v), t - 1) * _pow(_gumbel_sum(u, v, t), 1 / t - 2) * (_pow(_gumbel_sum(u, v, t), 1 / t) + t - 1),
           lambda t: 1 - 1 / t, lambda tau: 1 / (1 - tau)),
    Copula("frank", _frank_cdf,
           lambda u, v, t: F.exp(-t * u) * (F.exp(-t * v) - 1) / (math.expm1(-t) + (F.exp(-t * u) - 1) * (F.exp(-t * v) - 1)),
           lambda u, v, t: -t * math.expm1(-t) * F.exp(-t * (u + v)) / _pow(math.expm1(-t) + (F.exp(-t * u) - 1) * (F.exp(-t * v) - 1), 2.0),
           _frank_tau, lambda tau: math.copysign(_invert(lambda t: _frank_tau(t), abs(tau), 1e-6, 200.0), tau)),
)}


def pseudo_observations(df: DataFrame, x: str, y: str) -> DataFrame:
    """The rows with u and v: mean ranks over n + 1. Ranks come from counts of distinct values, joined back."""
    n = df.count()
    out = df
    for value, name in ((x, "u"), (y, "v")):
        counts = df.groupBy(F.col(value).alias("__k")).agg(F.count("*").alias("__m"))
        counts = running(counts, (), "__k", {"__b": total(F.col("__m"))})
        ranks = counts.select("__k", ((F.col("__b") - (F.col("__m") - 1) / 2) / (n + 1)).alias(name))
        out = out.join(ranks, out[value] == ranks["__k"]).drop("__k")
    return out


def log_likelihood(df: DataFrame, copula: str, theta: float) -> float:
    """Sum of log densities of the columns u and v."""
    return df.agg(F.sum(F.ln(COPULAS[copula].pdf(F.col("u"), F.col("v"), theta)))).first()[0]


def fit_copula(df: DataFrame, copula: str, low: float, high: float, rounds: int = 4, grid: int = 16) -> float:
    """The likeliest parameter between low and high: a grid per pass, each pass one aggregation, then narrower."""
    pdf = COPULAS[copula].pdf
    for _ in range(rounds):
        points = np.linspace(low, high, grid)
        row = df.agg(*[F.sum(F.ln(pdf(F.col("u"), F.col("v"), float(t)))).alias(f"p{k}") for k, t in enumerate(points)]).first()
        values = [-math.inf if row[f"p{k}"] is None or math.isnan(row[f"p{k}"]) else row[f"p{k}"] for k in range(grid)]
        k = int(np.argmax(values))
        low, high = float(points[max(0, k - 1)]), float(points[min(grid - 1, k + 1)])
    return (low + high) / 2


def sample(rows: DataFrame, copula: str, theta: float, u: str = "u", w: str = "w", steps: int = 60) -> DataFrame:
    """The rows with v, so that (u, v) has the copula if u and w are independent uniforms: bisection of P(V <= v | u) = w."""
    given = COPULAS[copula].given_u
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        low = given(F.col(u), mid, theta) < F.col(w)
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    state = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)
    return rows.withColumn("v", (state["lo"] + state["hi"]) / 2)


def gaussian_density(u: Column, v: Column, rho: float) -> Column:
    """Density of the Gaussian copula."""
    from tidewatch.functions.distributions import DISTRIBUTIONS

    a, b = (DISTRIBUTIONS["normal"].qf(p, 0.0, 1.0) for p in (u, v))
    return F.exp(-(rho * rho * (a * a + b * b) - 2 * rho * a * b) / (2 * (1 - rho * rho))) / math.sqrt(1 - rho * rho)


#: Gauss-Legendre nodes and weights on (0, 1).
_NODES = tuple((float((x + 1) / 2), float(w / 2)) for x, w in zip(*np.polynomial.legendre.leggauss(24)))


def gaussian_probability(u: Column, v: Column, rho: float) -> Column:
    """P(U <= u, V <= v) of the Gaussian copula: uv plus the integral of the bivariate density over the correlation."""
    from tidewatch.functions.distributions import DISTRIBUTIONS

    a, b = (DISTRIBUTIONS["normal"].qf(p, 0.0, 1.0) for p in (u, v))
    grown = sum((F.exp(-(a * a - 2 * a * b * (rho * t) + b * b) / (2 * (1 - (rho * t) ** 2))) * (w * rho / (2 * math.pi * math.sqrt(1 - (rho * t) ** 2))) for t, w in _NODES), F.lit(0.0))
    return u * v + grown


def spearman_rho(copula: str, theta: float, nodes: int = 64) -> float:
    """Spearman's rho, 12 times the integral of C(u, v) less 3, on a Gauss-Legendre grid; Clayton, Frank and independence."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    u, w = (x + 1) / 2, w / 2
    a, b = np.meshgrid(u, u)
    c = {"clayton": lambda: (a**-theta + b**-theta - 1) ** (-1 / theta), "frank": lambda: -np.log1p(np.expm1(-theta * a) * np.expm1(-theta * b) / np.expm1(-theta)) / theta,
         "gumbel": lambda: np.exp(-(((-np.log(a)) ** theta + (-np.log(b)) ** theta) ** (1 / theta))), "independence": lambda: a * b}[copula]()
    return float(12 * (w[:, None] * w[None, :] * c).sum() - 3)


def tail_dependence(copula: str, theta: float) -> tuple[float, float]:
    """(lower, upper) tail dependence."""
    return {"clayton": (2 ** (-1 / theta) if theta > 0 else 0.0, 0.0), "gumbel": (0.0, 2 - 2 ** (1 / theta)), "frank": (0.0, 0.0), "independence": (0.0, 0.0)}[copula]
