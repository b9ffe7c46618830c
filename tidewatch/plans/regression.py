"""Regression of event times on covariates.

Cox: each Newton step is one aggregation per distinct time and one running sum; covariates never leave Spark.
Lin-Ying additive hazards have a closed form from the same sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.running import latest, running, times, total


@dataclass
class CoxFit:
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    score: np.ndarray
    steps: int


def _sums(z: list[str], w: Column) -> dict[str, Column]:
    p = range(len(z))
    out = {"s0": w} | {f"s1_{i}": w * F.col(z[i]) for i in p}
    return out | {f"s2_{i}_{j}": w * F.col(z[i]) * F.col(z[j]) for i in p for j in p if j <= i}


def cox_terms(df: DataFrame, x: str, c: str, z: list[str], beta: list[float], strata: tuple[str, ...] = (), n: str | None = None, tl: str | None = None,
              ties: str = "breslow") -> DataFrame:
    """One row: ll, the score u_i and the information h_i_j at beta, with strata and delayed entry.

    Sums over the risk set are sums from the right over distinct times, less those of rows that enter later. ties:
    breslow, or efron, where the k-th of d failures at a time sees the risk set without k/d of them (rows count one).
    """
    p = range(len(z))
    weight = F.col(n).cast("double") if n else F.lit(1.0)
    eta = sum((F.lit(float(b)) * F.col(k) for b, k in zip(beta, z)), F.lit(0.0))
    own = df.withColumns({"__w": weight, "__eta": eta}).withColumn("__risk", F.col("__w") * F.exp("__eta"))
    event = F.col(c) == 0
    sums = _sums(z, F.col("__risk"))
    grid = own.groupBy(*strata, F.col(x).cast("double").alias("__x")).agg(
        *[F.sum(v).alias(k) for k, v in sums.items()], F.sum(F.when(event, F.col("__w")).otherwise(0.0)).alias("d"),
        F.sum(F.when(event, F.col("__w") * F.col("__eta")).otherwise(0.0)).alias("de"),
        *[F.sum(F.when(event, F.col("__w") * F.col(z[i])).otherwise(0.0)).alias(f"dz_{i}") for i in p],
        *[F.sum(F.when(event, v).otherwise(0.0)).alias(f"t_{k}") for k, v in sums.items() if ties == "efron"])
    if tl:
        late = own.filter(F.col(tl).isNotNull()).groupBy(*strata, F.col(tl).cast("double").alias("__x")).agg(*[F.sum(-v).alias(k) for k, v in sums.items()])
        zero = {k: F.lit(0.0) for k in ["d", "de", *[f"dz_{i}" for i in p], *[f"t_{k}" for k in sums if ties == "efron"]]}
        # rows that enter at or after a time aren't at risk there: taken off from the entry time downwards
        both = grid.withColumn("__late", F.lit(0)).unionByName(late.withColumns(zero | {"__late": F.lit(1)}))
    else:
        both = grid.withColumn("__late", F.lit(0))
    risk = running(both, strata, "__x", {f"r_{k}": total(F.col(k)) for k in sums}, descending=True, ties=("__late",)).filter("__late = 0 and d > 0")
    if ties == "efron":  # a row per failure; what is counted once a time stays with the first
        share, first = F.col("k") / F.col("m"), F.col("k") == 0
        once = {c: F.when(first, F.col(c)).otherwise(0.0) for c in ["de", *[f"dz_{i}" for i in p]]}
        risk = risk.withColumn("m", F.col("d").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        risk = risk.withColumns({f"r_{k}": F.col(f"r_{k}") - share * F.col(f"t_{k}") for k in sums} | once | {"d": F.lit(1.0)})
    mean = {i: F.col(f"r_s1_{i}") / F.col("r_s0") for i in p}
    return risk.agg(
        F.sum(F.col("de") - F.col("d") * F.ln("r_s0")).alias("ll"), *[F.sum(F.col(f"dz_{i}") - F.col("d") * mean[i]).alias(f"u_{i}") for i in p],
        *[F.sum(F.col("d") * (F.col(f"r_s2_{i}_{j}") / F.col("r_s0") - mean[i] * mean[j])).alias(f"h_{i}_{j}") for i in p for j in p if j <= i])


def _climb(terms, z: list[str], tol: float, steps: int) -> CoxFit:
    """Newton steps with halving on a row of ll, u_i and h_i_j as a function of beta."""
    beta, best, k = np.zeros(len(z)), None, 0
    step = np.zeros(len(z))
    u, h = np.zeros(len(z)), np.eye(len(z))
    for k in range(steps):
        row = terms(list(beta))
        if best is not None and row.ll < best.ll - 1e-12 * abs(best.ll):
            step = step / 2
            beta = beta - step
            continue
        best = row
        u = np.array([row[f"u_{i}"] for i in range(len(z))])
        h = np.array([[row[f"h_{max(i, j)}_{min(i, j)}"] for j in range(len(z))] for i in range(len(z))])
        step = np.linalg.solve(h, u)
        if np.abs(step).max() < tol:
            break
        beta = beta + step
    return CoxFit(z, beta, np.linalg.inv(h), best.ll, u, k + 1)


def fit_cox(df: DataFrame, x: str, c: str, z: list[str], strata: tuple[str, ...] = (), n: str | None = None, tl: str | None = None, tol: float = 1e-9, steps: int = 30,
            ties: str = "breslow") -> CoxFit:
    """Proportional hazards, with Breslow's or Efron's ties. c: 0 event, 1 censored; rows with null covariates go. Episodes of
    time-varying covariates are rows with their starts in tl."""
    own = df.dropna(subset=[x, c, *z]).select(*dict.fromkeys([*strata, x, c, *z, *([n] if n else []), *([tl] if tl else [])])).cache()
    fit = _climb(lambda beta: cox_terms(own, x, c, z, beta, strata, n, tl, ties).first(), z, tol, steps)
    own.unpersist()
    return fit


def fit_fine_gray(df: DataFrame, x: str, cause: str, z: list[str], of: str, tol: float = 1e-9, steps: int = 30) -> CoxFit:
    """Subdistribution hazard regression of one cause; a null cause is censored."""
    from tidewatch.operators.competing import fine_gray_terms

    own = df.dropna(subset=[x, *z]).select(*dict.fromkeys([x, cause, *z])).cache()
    fit = _climb(lambda beta: fine_gray_terms(own, x, cause, z, beta, of).first(), z, tol, steps)
    own.unpersist()
    return fit


def episodes(df: DataFrame, unit: str, x: str, c: str) -> DataFrame:
    """A timeline of covariate changes as episodes (xl, xr]: each row lasts to the unit's next row, the flag is
    that of the terminal row, which itself gives no episode."""
    w = Window.partitionBy(unit).orderBy(x)
    own = df.withColumns({"xl": F.col(x).cast("double"), "xr": F.lead(x).over(w).cast("double"), "__c": F.lead(c).over(w), "__end": F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(x)))})
    return own.filter("xr is not null").withColumn("flag", F.when(F.col("__end") == 2, F.col("__c")).otherwise(1)).drop("__c", "__end")


def martingale_residuals(df: DataFrame, x: str, c: str, z: list[str], beta: list[float]) -> DataFrame:
    """The rows with martingale and deviance residuals: each time's baseline joins back on the time."""
    base = cox_baseline(df, x, c, z, beta).select(F.col("x").alias("__x"), F.col("cum_hazard").alias("__h"))
    eta = sum((F.lit(float(b)) * F.col(k) for b, k in zip(beta, z)), F.lit(0.0))
    d = F.when(F.col(c) == 0, 1.0).otherwise(0.0)
    out = df.withColumn("__x", F.col(x).cast("double")).join(base, "__x").withColumn("martingale", d - F.col("__h") * F.exp(eta))
    m = F.col("martingale")
    size = F.sqrt(F.greatest(F.lit(0.0), -2 * (m + d * F.ln(F.when(d - m > 0, d - m).otherwise(1.0)))))
    return out.withColumn("deviance", F.signum(m) * size).drop("__x", "__h")


def schoenfeld_residuals(df: DataFrame, x: str, c: str, z: list[str], beta: list[float]) -> DataFrame:
    """(x, d, one column per covariate): per event time, the events' covariates less their risk-set means."""
    p = range(len(z))
    eta = sum((F.lit(float(b)) * F.col(k) for b, k in zip(beta, z)), F.lit(0.0))
    event = F.col(c) == 0
    grid = df.withColumn("__p", F.exp(eta)).groupBy(F.col(x).cast("double").alias("x")).agg(
        F.sum(event.cast("double")).alias("d"), F.sum("__p").alias("s0"), *[F.sum(F.col("__p") * F.col(z[i])).alias(f"s{i + 1}") for i in p],
        *[F.sum(F.when(event, F.col(z[i])).otherwise(0.0)).alias(f"dz{i}") for i in p])
    sums = running(grid, (), "x", {f"r{i}": total(F.col(f"s{i}")) for i in range(len(z) + 1)}, descending=True).filter("d > 0")
    return sums.select("x", "d", *[(F.col(f"dz{i}") - F.col("d") * F.col(f"r{i + 1}") / F.col("r0")).alias(z[i]) for i in p])


def _baselines():
    """Log hazard and cumulative hazard of baselines as columns of a time and parameters on the log scale."""
    w = lambda x, a, b: F.pow(x / F.exp(a), F.exp(b))
    return {
        "exponential": (1, lambda x, a: F.exp(-a) * x, lambda x, a: -a + x * 0),
        "weibull": (2, w, lambda x, a, b: b - a + (F.exp(b) - 1) * (F.ln(x) - a)),
        "loglogistic": (2, lambda x, a, b: F.log1p(w(x, a, b)), lambda x, a, b: b - a + (F.exp(b) - 1) * (F.ln(x) - a) - F.log1p(w(x, a, b))),
    }


def fit_parametric(df: DataFrame, x: str, c: str, z: list[str], kind: str = "ph", baseline: str = "weibull", tl: str | None = None) -> dict[str, float]:
    """Parametric regression: hazards times exp(Zb) (ph), time times exp(Zb) (aft), odds times exp(Zb) (po) or
    hazards plus Zb (ah). Each Newton step is one aggregation over the rows at all shifted parameters."""
    from tidewatch.plans.fit import at_points, newton

    size, H0, h0 = _baselines()[baseline]
    own = df.dropna(subset=[x, c, *z]).filter(F.col(x) > 0).select(*dict.fromkeys([x, c, *z, *([tl] if tl else [])])).cache()
    mean = own.agg(F.avg(x)).first()[0]

    def loss(*params: Column) -> Column:
        base, beta = params[:size], params[size:]
        lin = sum((b * F.col(k) for b, k in zip(beta, z)), F.lit(0.0))

        def cum(t):
            if kind == "ph":
                return F.exp(lin) * H0(t, *base)
            if kind == "aft":
                return H0(F.exp(lin) * t, *base)
            if kind == "po":  # S = phi S0 / (F0 + phi S0)
                s = F.exp(-H0(t, *base))
                return -F.ln(F.exp(lin) * s / (1 - s + F.exp(lin) * s))
            return H0(t, *base) + lin * t

        def log_hazard(t):
            if kind == "ph":
                return lin + h0(t, *base)
            if kind == "aft":
                return lin + h0(F.exp(lin) * t, *base)
            if kind == "po":
                s = F.exp(-H0(t, *base))
                return h0(t, *base) - F.ln(1 - s + F.exp(lin) * s)
            rate = F.exp(h0(t, *base)) + lin
            return F.ln(F.when(rate > 0, rate))

        t = F.col(x).cast("double")
        entry = F.when(F.col(tl) > 0, cum(F.greatest(F.col(tl).cast("double"), F.lit(1e-12)))).otherwise(0.0) if tl else F.lit(0.0)
        return cum(t) - entry - F.when(F.col(c) == 0, log_hazard(t)).otherwise(0.0)

    many = lambda points: at_points(own, points, loss)
    start = np.zeros(size + len(z))
    start[0] = np.log(mean)
    best, _ = newton(lambda p: many([p])[0], start, tol=1e-8, steps=25, many=many)
    own.unpersist()
    return dict(zip([*(f"log_{k}" for k in ("scale", "shape")[:size]), *z], map(float, best)))


def cox_baseline(df: DataFrame, x: str, c: str, z: list[str], beta: list[float], strata: tuple[str, ...] = ()) -> DataFrame:
    """(strata, x, d, risk, hazard, cum_hazard): Breslow's baseline hazard."""
    eta = sum((F.lit(float(b)) * F.col(k) for b, k in zip(beta, z)), F.lit(0.0))
    grid = df.groupBy(*strata, F.col(x).cast("double").alias("x")).agg(F.sum((F.col(c) == 0).cast("double")).alias("d"), F.sum(F.exp(eta)).alias("own"))
    out = running(grid, strata, "x", {"risk": total(F.col("own"))}, descending=True).withColumn("hazard", F.col("d") / F.col("risk"))
    return running(out, strata, "x", {"cum_hazard": total(F.col("hazard"))}).drop("own")


def additive_hazards_terms(df: DataFrame, x: str, c: str, z: list[str]) -> DataFrame:
    """One row: a_i_j and b_i of the Lin-Ying equations A beta = b."""
    p = range(len(z))
    sums = _sums(z, F.lit(1.0))
    event = F.col(c) == 0
    grid = df.groupBy(F.col(x).cast("double").alias("x")).agg(*[F.sum(v).alias(k) for k, v in sums.items()], F.sum(event.cast("double")).alias("d"),
                                                             *[F.sum(F.when(event, F.col(z[i])).otherwise(0.0)).alias(f"dz_{i}") for i in p])
    risk = running(grid, (), "x", {f"r_{k}": total(F.col(k)) for k in sums}, descending=True)
    risk = running(risk, (), "x", {"last": latest(F.col("x"), before=True)}).withColumn("dt", F.col("x") - F.coalesce("last", F.lit(0.0)))
    mean = {i: F.col(f"r_s1_{i}") / F.col("r_s0") for i in p}
    return risk.agg(*[F.sum(F.col("dt") * (F.col(f"r_s2_{i}_{j}") - F.col(f"r_s1_{i}") * mean[j])).alias(f"a_{i}_{j}") for i in p for j in p if j <= i],
                    *[F.sum(F.col(f"dz_{i}") - F.col("d") * mean[i]).alias(f"b_{i}") for i in p])


def fit_additive_hazards(df: DataFrame, x: str, c: str, z: list[str]) -> np.ndarray:
    """Lin-Ying coefficients."""
    row = additive_hazards_terms(df.dropna(subset=[x, c, *z]), x, c, z).first()
    k = len(z)
    a = np.array([[row[f"a_{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.solve(a, np.array([row[f"b_{i}"] for i in range(k)]))


def fit_buckley_james(df: DataFrame, x: str, c: str, z: list[str], tol: float = 1e-5, steps: int = 60) -> dict[str, float]:
    """Censored linear regression of log time: censored rows get the mean of larger residuals under the residuals'
    Kaplan-Meier curve. Each round is one aggregation by residual, two running sums and the normal equations.

    Coefficients have the sign of hazards: a positive one shortens life. A two-cycle ends in its mean.
    """
    own = df.dropna(subset=[x, c, *z]).filter(F.col(x) > 0).select(F.ln(x).alias("y"), F.col(c).alias("c"), *z).cache()
    k = range(len(z))
    gamma, seen = np.zeros(len(z)), []
    for _ in range(steps):
        fitted = sum((F.lit(float(g)) * F.col(v) for g, v in zip(gamma, z)), F.lit(0.0))
        rows = own.withColumn("e", F.round(F.col("y") - fitted, 12))
        grid = rows.groupBy("e").agg(F.sum((F.col("c") == 0).cast("double")).alias("d"), F.count("*").cast("double").alias("m"))
        grid = running(grid, (), "e", {"r": total(F.col("m"))}, descending=True)
        grid = grid.withColumn("d", F.when(F.col("r") == F.col("m"), F.greatest("d", F.lit(1.0))).otherwise(F.col("d")))  # the largest residual fails
        keeps = 1 - F.least(F.lit(1.0), F.col("d") / F.col("r"))
        grid = running(grid, (), "e", {"s": times(keeps), "earlier": times(keeps, before=True)})
        grid = running(grid, (), "e", {"after": total((F.col("earlier") - F.col("s")) * F.col("e"), before=True)}, descending=True)
        grid = grid.withColumn("tail", F.when(F.col("s") > 0, F.col("after") / F.col("s")).otherwise(F.col("e")))
        full = rows.join(grid.select("e", "tail"), "e").withColumn("v", F.when(F.col("c") == 0, F.col("y")).otherwise(fitted + F.col("tail")))
        row = full.agg(F.count("*").alias("n"), F.sum("v").alias("v"), *[F.sum(z[i]).alias(f"z{i}") for i in k], *[F.sum(F.col(z[i]) * F.col("v")).alias(f"zv{i}") for i in k],
                       *[F.sum(F.col(z[i]) * F.col(z[j])).alias(f"zz{i}_{j}") for i in k for j in k if j <= i]).first()
        s1 = np.array([row[f"z{i}"] for i in k])
        a = np.array([[row[f"zz{max(i, j)}_{min(i, j)}"] for j in k] for i in k]) - np.outer(s1, s1) / row.n
        new = np.linalg.solve(a, np.array([row[f"zv{i}"] for i in k]) - s1 * row.v / row.n)
        if np.abs(new - gamma).max() < tol:
            gamma = new
            break
        if len(seen) > 1 and np.abs(new - seen[-2]).max() < tol:
            gamma = (new + gamma) / 2
            break
        seen.append(new)
        gamma = new
    own.unpersist()
    return dict(zip(z, map(float, -gamma)))


def schedule_segments(schedule: DataFrame, t_max: float, period: float | None = None) -> DataFrame:
    """(start, end, values) of a piecewise-constant covariate path up to t_max; with a period, the pattern repeats."""
    own = schedule
    if period:
        own = own.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(int(np.ceil(t_max / period)) - 1))))
        own = own.withColumns({"start": F.col("start") + F.col("__k") * period, "end": F.col("end") + F.col("__k") * period}).drop("__k")
    return own.filter(F.col("start") < t_max).withColumn("end", F.least("end", F.lit(float(t_max))))


def coalesce_segments(segments: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Neighbouring segments of equal value as one."""
    w = Window.partitionBy(*by).orderBy("start")
    new = F.coalesce((F.col(value) != F.lag(value).over(w)) | (F.col("start") != F.lag("end").over(w)), F.lit(True))
    own = segments.withColumn("__g", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return own.groupBy(*by, "__g", value).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")
