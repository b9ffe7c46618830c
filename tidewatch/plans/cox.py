"""What follows from a fitted Cox regression: predictions, influence, robust covariance, tests of proportional hazards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.special import chi2_sf
from tidewatch.operators.curves import at
from tidewatch.operators.running import running, total
from tidewatch.plans.regression import cox_baseline, cox_terms


def linear(z: list[str], beta: list[float]) -> Column:
    return sum((F.lit(float(b)) * F.col(k) for b, k in zip(beta, z)), F.lit(0.0))


def predict(baseline: DataFrame, rows: DataFrame, t: str, z: list[str], beta: list[float]) -> DataFrame:
    """The rows with Hf, sf, ff at their time t and covariates; baseline: (x, cum_hazard) of cox_baseline.

    Times are looked up once per distinct value. Before the baseline's first time the hazard is 0.
    """
    own = rows.withColumn("__t", F.col(t).cast("double"))
    found = at(baseline, own.select(F.col("__t").alias("t")).distinct(), {"cum_hazard": 0.0}).withColumnsRenamed({"t": "__t", "cum_hazard": "__h"})
    out = own.join(found, "__t").withColumn("Hf", F.col("__h") * F.exp(linear(z, beta)))
    return out.withColumns({"sf": F.exp(-F.col("Hf")), "ff": -F.expm1(-F.col("Hf"))}).drop("__t", "__h")


def predict_path(baseline: DataFrame, path: DataFrame, unit: str, z: list[str], beta: list[float]) -> DataFrame:
    """(unit, xl, xr, Hf, sf) along paths of covariates that change: rows (unit, xl, xr, z) are episodes in (xl, xr].

    Hf, sf: at the end of each episode, with the baseline's steps of every episode under its own covariates.
    """
    own = path.select(unit, F.col("xl").cast("double").alias("xl"), F.col("xr").cast("double").alias("xr"), *z)
    ends = own.select(F.explode(F.array("xl", "xr")).alias("t")).distinct()
    h = at(baseline, ends, {"cum_hazard": 0.0})
    both = own.join(h.withColumnsRenamed({"t": "xl", "cum_hazard": "__a"}), "xl").join(h.withColumnsRenamed({"t": "xr", "cum_hazard": "__b"}), "xr")
    step = (F.col("__b") - F.col("__a")) * F.exp(linear(z, beta))
    out = running(both.withColumn("__s", step), (unit,), "xr", {"Hf": total(F.col("__s"))})
    return out.select(unit, "xl", "xr", "Hf", F.exp(-F.col("Hf")).alias("sf"))


def _risk_means(df: DataFrame, x: str, c: str, z: list[str], beta: list[float]) -> DataFrame:
    """(__x, m_i, a, b_i): risk-set means at each time, and running sums of the hazard's steps and of steps times means."""
    p = range(len(z))
    own = df.withColumn("__p", F.exp(linear(z, beta)))
    grid = own.groupBy(F.col(x).cast("double").alias("__x")).agg(
        F.sum((F.col(c) == 0).cast("double")).alias("d"), F.sum("__p").alias("s"), *[F.sum(F.col("__p") * F.col(z[i])).alias(f"s{i}") for i in p])
    grid = running(grid, (), "__x", {"r": total(F.col("s"))} | {f"r{i}": total(F.col(f"s{i}")) for i in p}, descending=True)
    step = F.col("d") / F.col("r")
    grid = running(grid, (), "__x", {"a": total(step)} | {f"b_{i}": total(step * F.col(f"r{i}") / F.col("r")) for i in p})
    return grid.select("__x", "a", *[F.col(f"b_{i}") for i in p], *[(F.col(f"r{i}") / F.col("r")).alias(f"m_{i}") for i in p])


def score_residuals(df: DataFrame, x: str, c: str, z: list[str], beta: list[float]) -> DataFrame:
    """The rows with score_<z>: each row's part in the score, its events less what it was expected to add while at risk."""
    rows = df.withColumn("__x", F.col(x).cast("double")).join(_risk_means(df, x, c, z, beta), "__x")
    hit, w = F.when(F.col(c) == 0, 1.0).otherwise(0.0), F.exp(linear(z, beta))
    parts = {f"score_{k}": hit * (F.col(k) - F.col(f"m_{i}")) - w * (F.col(k) * F.col("a") - F.col(f"b_{i}")) for i, k in enumerate(z)}
    return rows.withColumns(parts).select(*df.columns, *parts)


def dfbeta(df: DataFrame, x: str, c: str, z: list[str], beta: list[float], covariance: np.ndarray) -> DataFrame:
    """The rows with dfbeta_<z>: about how much each row moves each coefficient."""
    own = score_residuals(df, x, c, z, beta)
    moves = {f"dfbeta_{k}": sum((F.col(f"score_{m}") * float(covariance[j, i]) for j, m in enumerate(z)), F.lit(0.0)) for i, k in enumerate(z)}
    return own.withColumns(moves).select(*df.columns, *moves)


def robust_covariance(df: DataFrame, x: str, c: str, z: list[str], beta: list[float], covariance: np.ndarray, cluster: str | None = None) -> np.ndarray:
    """The sandwich: products of dfbetas, summed over clusters (each row its own without `cluster`)."""
    own = score_residuals(df, x, c, z, beta)
    names = [f"score_{k}" for k in z]
    if cluster:
        own = own.groupBy(cluster).agg(*[F.sum(k).alias(k) for k in names])
    p = range(len(z))
    row = own.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i in p for j in p if j <= i]).first()
    meat = np.array([[row[f"q{max(i, j)}_{min(i, j)}"] for j in p] for i in p])
    v = np.asarray(covariance, float)
    return v @ meat @ v


def proportionality(df: DataFrame, x: str, c: str, z: list[str], beta: list[float], transform: str = "km") -> DataFrame:
    """(covariate, statistic, df, p_value): slopes of Schoenfeld residuals on a transform of time; covariate null: all jointly.

    transform: km (the share of events up to a time), identity, log, or rank (the mean rank of events at a time).
    """
    p = range(len(z))
    own = df.withColumn("__p", F.exp(linear(z, beta)))
    event = F.col(c) == 0
    grid = own.groupBy(F.col(x).cast("double").alias("x")).agg(
        F.sum(event.cast("double")).alias("d"), F.sum("__p").alias("s"), *[F.sum(F.col("__p") * F.col(z[i])).alias(f"s{i}") for i in p],
        *[F.sum(F.when(event, F.col(z[i])).otherwise(0.0)).alias(f"dz{i}") for i in p])
    grid = running(grid, (), "x", {"r": total(F.col("s"))} | {f"r{i}": total(F.col(f"s{i}")) for i in p}, descending=True).filter("d > 0")
    grid = running(grid, (), "x", {"upto": total(F.col("d"))})
    g = {"km": F.col("upto"), "identity": F.col("x"), "log": F.ln("x"), "rank": F.col("upto") - (F.col("d") + 1) / 2}[transform]
    res = [F.col(f"dz{i}") - F.col("d") * F.col(f"r{i}") / F.col("r") for i in p]
    row = grid.agg(F.sum("d").alias("n"), F.sum(F.col("d") * g).alias("g"), F.sum(F.col("d") * g * g).alias("gg"),
                   *[F.sum(res[i]).alias(f"u{i}") for i in p], *[F.sum(g * res[i]).alias(f"gu{i}") for i in p]).first()
    info = cox_terms(df, x, c, z, beta).first()
    h = np.array([[info[f"h_{max(i, j)}_{min(i, j)}"] for j in p] for i in p])
    scale = row.n if transform == "km" else 1.0  # shares instead of counts
    mean = row.g / row.n
    spread = (row.gg - row.n * mean * mean) / scale**2
    u = np.array([(row[f"gu{i}"] - mean * row[f"u{i}"]) / scale for i in p])
    if spread <= 0:
        raise ValueError("all events are at one time")
    tests = [(z[i], float(row.n * u[i] ** 2 / (spread * h[i, i])), 1) for i in p] + [(None, float(row.n / spread * u @ np.linalg.pinv(h) @ u), len(z))]
    return df.sparkSession.createDataFrame([(k, q, n, float(chi2_sf(q, n))) for k, q, n in tests], "covariate string, statistic double, df int, p_value double")


def cause_specific_incidence(df: DataFrame, x: str, cause: str, z: list[str], betas: dict[str, list[float]], given: list[float]) -> DataFrame:
    """(cause, x, hazard, cum_hazard, sf, cif) at the covariates `given`, from a Cox regression for each cause.

    betas: cause -> coefficients, of fits in which other causes are censored. All causes' baselines lie on the union
    of times; the incidence adds the cause's hazard times exp(-H) of all causes at the time itself.
    """
    names = list(betas)
    weights = {k: F.exp(linear(z, betas[k])) for k in names}
    grid = df.groupBy(F.col(x).cast("double").alias("x")).agg(
        *[F.sum(F.when(F.col(cause) == k, 1.0).otherwise(0.0)).alias(f"d{j}") for j, k in enumerate(names)], *[F.sum(weights[k]).alias(f"s{j}") for j, k in enumerate(names)])
    grid = running(grid, (), "x", {f"r{j}": total(F.col(f"s{j}")) for j in range(len(names))}, descending=True)
    scale = [float(np.exp(sum(b * v for b, v in zip(betas[k], given)))) for k in names]
    steps = {f"h{j}": F.col(f"d{j}") / F.col(f"r{j}") * scale[j] for j in range(len(names))}
    grid = running(grid.withColumns(steps), (), "x", {f"cum{j}": total(F.col(f"h{j}")) for j in range(len(names))})
    grid = grid.withColumn("sf", F.exp(-sum((F.col(f"cum{j}") for j in range(len(names))), F.lit(0.0))))
    grid = running(grid, (), "x", {f"c{j}": total(F.col(f"h{j}") * F.col("sf")) for j in range(len(names))})
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("cause"), F.col(f"h{j}").alias("hazard"), F.col(f"cum{j}").alias("cum_hazard"), F.col(f"c{j}").alias("cif")) for j, k in enumerate(names)]))
    return grid.select("x", "sf", rows.alias("k")).select("k.cause", "x", "k.hazard", "k.cum_hazard", "sf", "k.cif")
