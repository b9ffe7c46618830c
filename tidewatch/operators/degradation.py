"""Degradation: paths of units fitted by least squares, and the times at which they reach a threshold."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Path models that are straight lines after a transform of time and measurement: (time, measurement, solve time).
PATHS = {
    "linear": (lambda x: x, lambda y: y, lambda z: z),
    "exponential": (lambda x: x, F.ln, lambda z: z),
    "power": (F.ln, F.ln, F.exp),
    "logarithmic": (F.ln, lambda y: y, F.exp),
    "square-root": (F.sqrt, lambda y: y, lambda z: z * z),
}


def fit_paths(df: DataFrame, unit: str, x: str, y: str, path: str = "linear", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, unit, m, intercept, slope, r2): each unit's least-squares path, one aggregation for all units."""
    fx, fy, _ = PATHS[path]
    own = df.select(*by, F.col(unit).alias("unit"), fx(F.col(x).cast("double")).alias("z"), fy(F.col(y).cast("double")).alias("v"))
    return own.groupBy(*by, "unit").agg(F.count("*").alias("m"), F.regr_intercept("v", "z").alias("intercept"), F.regr_slope("v", "z").alias("slope"), F.regr_r2("v", "z").alias("r2"))


def failure_times(fits: DataFrame, threshold: float, path: str = "linear") -> DataFrame:
    """The fits with x, where the path meets the threshold; null for paths that never do."""
    _, fy, solve = PATHS[path]
    return fits.withColumn("x", F.when(F.col("slope") != 0, solve((fy(F.lit(float(threshold))) - F.col("intercept")) / F.col("slope"))))


def increments(df: DataFrame, unit: str, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, unit, dt, dy): steps from one measurement of a unit to the next."""
    w = Window.partitionBy(*by, unit).orderBy(x)
    return df.select(*by, F.col(unit).alias("unit"), (F.col(x) - F.lag(x).over(w)).cast("double").alias("dt"), (F.col(y) - F.lag(y).over(w)).cast("double").alias("dy")).filter("dt is not null")


def wiener_fit(steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, m, drift, sigma): the closed-form fit of a Wiener process to increments."""
    own = steps.filter("dt > 0")
    drift = own.groupBy(*by).agg(F.count("*").alias("m"), (F.sum("dy") / F.sum("dt")).alias("drift"), F.sum(F.col("dy") * F.col("dy") / F.col("dt")).alias("s2"),
                                 F.sum("dy").alias("sy"), F.sum("dt").alias("st"))
    return drift.select(*by, "m", "drift", F.sqrt((F.col("s2") - F.col("sy") * F.col("sy") / F.col("st")) / F.col("m")).alias("sigma"))


def quadratic_paths(df: DataFrame, unit: str, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, unit, m, a, b, c): y = a + b x + c x^2 by least squares; the 3 by 3 system is solved by Cramer's rule
    on centred times, one aggregation for all units."""
    from pyspark.sql import Window as W

    centre = F.avg(x).over(W.partitionBy(*by, unit))
    own = df.select(*by, F.col(unit).alias("unit"), centre.alias("o"), (F.col(x).cast("double") - centre).alias("z"), F.col(y).cast("double").alias("v"))
    z, v = F.col("z"), F.col("v")
    s = own.groupBy(*by, "unit").agg(F.max("o").alias("o"), F.count("*").cast("double").alias("m"), F.sum(z * z).alias("s2"), F.sum(z * z * z).alias("s3"), F.sum(z * z * z * z).alias("s4"),
                                     F.sum(v).alias("t0"), F.sum(z * v).alias("t1"), F.sum(z * z * v).alias("t2"))
    m, s2, s3, s4, t0, t1, t2 = (F.col(k) for k in ("m", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = m * (s2 * s4 - s3 * s3) - s2 * s2 * s2
    c = F.try_divide(m * (s2 * t2 - s3 * t1) - s2 * s2 * t0, det)
    b = F.try_divide(t1 - c * s3, s2)
    a = (t0 - c * s2) / m
    o = F.col("o")
    return s.select(*by, "unit", m.cast("long").alias("m"), (a - b * o + c * o * o).alias("a"), (b - 2 * c * o).alias("b"), c.alias("c"))


def gamma_process_terms(steps: DataFrame, shape: float) -> DataFrame:
    """One row of the sums that the likelihood of a gamma process needs at a shape rate: m, s_dt, s_dy, s_log, s_shape_log."""
    own = steps.filter("dt > 0 and dy > 0")
    return own.agg(F.count("*").alias("m"), F.sum("dt").alias("s_dt"), F.sum("dy").alias("s_dy"), F.sum(F.ln("dy")).alias("s_log"), F.sum((shape * F.col("dt") - 1) * F.ln("dy")).alias("s_shape_log"))


def gamma_process_fit(steps: DataFrame) -> tuple[float, float]:
    """(shape rate, scale) of increments Gamma(shape dt, scale): steps are counted per distinct dt, and the profile
    likelihood in the shape runs over those."""
    from tidewatch.functions.special import lgamma

    rows = steps.filter("dt > 0 and dy > 0").groupBy("dt").agg(F.count("*").alias("m"), F.sum("dy").alias("y"), F.sum(F.ln("dy")).alias("l")).toPandas()
    dt, m, y, log_y = (rows[k].to_numpy(float) for k in ("dt", "m", "y", "l"))

    def loss(q):
        a = math.exp(q)
        scale = y.sum() / (a * (m * dt).sum())
        return -float(((a * dt - 1) * log_y - m * lgamma(a * dt) - m * a * dt * math.log(scale)).sum() - y.sum() / scale)

    grid = np.linspace(-12, 12, 49)
    k = int(np.argmin([loss(q) for q in grid]))
    lo, hi = grid[max(0, k - 1)], grid[min(48, k + 1)]
    for _ in range(100):  # golden section
        a, b = hi - (hi - lo) * 0.618, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    shape = math.exp((lo + hi) / 2)
    return shape, float(y.sum() / (shape * (m * dt).sum()))


def unit_covariates(df: DataFrame, unit: str, z: list[str]) -> DataFrame:
    """(unit, z): covariates of each unit; ValueError where they change within one."""
    own = df.groupBy(F.col(unit).alias("unit")).agg(*[F.min(k).alias(k) for k in z], *[F.max(k).alias(f"__max_{k}") for k in z])
    row = own.agg(*[F.max((F.col(k) != F.col(f"__max_{k}")).cast("int")).alias(k) for k in z]).first()
    if changing := [k for k in z if row[k]]:
        raise ValueError(f"covariates change within a unit: {', '.join(changing)}")
    return own.select("unit", *z)


def choose_path(df: DataFrame, unit: str, x: str, y: str, paths: tuple[str, ...] = ("linear", "logarithmic", "square-root")) -> DataFrame:
    """(path, m, aic_c): least-squares path models that keep the measurement's scale, by AICc over all units, the best first."""
    out = None
    for path in paths:
        fx, _, _ = PATHS[path]
        fits = fit_paths(df, unit, x, y, path).select("unit", "intercept", "slope")
        own = df.select(F.col(unit).alias("unit"), fx(F.col(x).cast("double")).alias("z"), F.col(y).cast("double").alias("v")).join(fits, "unit")
        r = F.col("v") - F.col("intercept") - F.coalesce("slope", F.lit(0.0)) * F.col("z")
        one = own.agg(F.count("*").cast("double").alias("m"), F.sum(r * r).alias("s"), F.countDistinct("unit").alias("u")).select(F.lit(path).alias("path"), "m", "s", (2 * F.col("u") + 1).alias("k"))
        out = one if out is None else out.unionByName(one)
    k, m = F.col("k"), F.col("m")
    aic = m * F.ln(F.col("s") / m) + 2 * k + 2 * k * (k + 1) / F.greatest(m - k - 1, F.lit(1e-9))
    return out.select("path", "m", aic.alias("aic_c")).orderBy("aic_c")


def remaining_life(df: DataFrame, unit: str, x: str, y: str, threshold: float, path: str = "linear") -> DataFrame:
    """(unit, now, x, remaining): when each unit's own path meets the threshold, and how long that is after its last measurement."""
    fits = failure_times(fit_paths(df, unit, x, y, path), threshold, path).select("unit", "x")
    now = df.groupBy(F.col(unit).alias("unit")).agg(F.max(x).cast("double").alias("now"))
    return now.join(fits, "unit").select("unit", "now", "x", F.greatest(F.lit(0.0), F.col("x") - F.col("now")).alias("remaining"))


#: Paths that are no straight lines: y of time and parameters, and start values from times and measurements.
CURVED = {
    "exponential": (lambda t, a, b: a * np.exp(b * t), lambda t, y: _line(t, np.log(np.maximum(y, 1e-12)), lambda a, b: (np.exp(a), b))),
    "power": (lambda t, a, b: a * t**b, lambda t, y: _line(np.log(np.maximum(t, 1e-12)), np.log(np.maximum(y, 1e-12)), lambda a, b: (np.exp(a), b))),
    "gompertz": (lambda t, a, b, c: a * np.exp(-b * np.exp(-c * t)), lambda t, y: (y.max() * 1.05, -np.log(max(y[0] / (y.max() * 1.05), 1e-9)), 1 / max(np.ptp(t), 1e-9) * 3)),
    "offset-exponential": (lambda t, a, b, c: a + b * np.expm1(c * t), lambda t, y: (y[0], (y[-1] - y[0]) / 1.7, 1 / max(np.ptp(t), 1e-9))),
    "michaelis-menten": (lambda t, a, b: a * t / (b + t), lambda t, y: _line(1 / np.maximum(t, 1e-12), 1 / np.maximum(y, 1e-12), lambda a, b: (1 / max(a, 1e-9), b / max(a, 1e-9)))),
}


def _line(u, v, back):
    b, a = np.polyfit(u, v, 1)
    return back(a, b)


def _least_squares(f, t: np.ndarray, y: np.ndarray, p: np.ndarray, steps: int = 200) -> np.ndarray:
    """Levenberg-Marquardt with a numerical Jacobian."""
    damp, r = 1e-3, y - f(t, *p)
    for _ in range(steps):
        h = 1e-6 * np.maximum(np.abs(p), 1e-6)
        J = np.stack([(f(t, *(p + h * e)) - f(t, *(p - h * e))) / (2 * h @ e) for e in np.eye(len(p))], axis=1)
        A, g = J.T @ J, J.T @ r
        while True:
            step = np.linalg.lstsq(A + damp * np.diag(np.diag(A) + 1e-12), g, rcond=None)[0]
            with np.errstate(all="ignore"):
                new = y - f(t, *(p + step))
            if np.isfinite(new).all() and new @ new <= r @ r:
                break
            damp *= 4
            if damp > 1e12:
                return p
        done = np.abs(step).max() <= 1e-12 * (1 + np.abs(p).max())
        p, r, damp = p + step, new, damp / 8
        if done:
            break
    return p


def fit_curved_paths(df: DataFrame, unit: str, x: str, y: str, path: str) -> DataFrame:
    """(unit, m, params, rss): each unit's least-squares path of a curved model; a unit's measurements are one group.

    params is null for units with fewer measurements than the model has parameters.
    """
    import pyarrow as pa

    f, start = CURVED[path]
    size = f.__code__.co_argcount - 1

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t, v = table.column("t").to_numpy(), table.column("v").to_numpy()
        params, rss = None, None
        if len(t) >= size:
            best = _least_squares(f, t, v, np.array(start(t, v), float))
            params, rss = [float(b) for b in best], float(((v - f(t, *best)) ** 2).sum())
        return pa.table({"unit": table.column("unit").slice(0, 1), "m": pa.array([len(t)], pa.int64()), "params": pa.array([params], pa.list_(pa.float64())), "rss": pa.array([rss], pa.float64())})

    own = df.select(F.col(unit).alias("unit"), F.col(x).cast("double").alias("t"), F.col(y).cast("double").alias("v")).dropna()
    return own.groupBy("unit").applyInArrow(run, f"unit {own.schema['unit'].dataType.simpleString()}, m long, params array<double>, rss double")


#: Transforms of time under which the location of a destructive measurement is a line.
DESTRUCTIVE = {"linear": lambda t: t, "log": F.ln, "sqrt": F.sqrt, "reciprocal": lambda t: 1 / t}


def destructive_fit(df: DataFrame, x: str, y: str, transform: str = "linear", logs: bool = True) -> DataFrame:
    """(intercept, slope, sigma, m, aic_c): one measurement a unit, (log-)normal around a line in the transformed time; complete rows."""
    t, v = DESTRUCTIVE[transform](F.col(x).cast("double")), F.ln(y) if logs else F.col(y).cast("double")
    own = df.select(t.alias("t"), v.alias("v"))
    s = own.agg(F.count("*").cast("double").alias("m"), F.regr_intercept("v", "t").alias("intercept"), F.regr_slope("v", "t").alias("slope"), F.regr_syy("v", "t").alias("syy"), F.regr_sxy("v", "t").alias("sxy"), F.sum("v").alias("sv"))
    m = F.col("m")
    var = (F.col("syy") - F.col("slope") * F.col("sxy")) / m
    ll = -m / 2 * (F.ln(2 * np.pi * var) + 1) - (F.col("sv") if logs else F.lit(0.0))
    return s.select("intercept", "slope", F.sqrt(var).alias("sigma"), "m", (-2 * ll + 6 + 24 / (m - 4)).alias("aic_c"))


def destructive_failure(rows: DataFrame, t: str, intercept: float, slope: float, sigma: float, threshold: float, transform: str = "linear", logs: bool = True, falling: bool = True) -> DataFrame:
    """The rows with ff: the share of units that have crossed the threshold by the time t."""
    from tidewatch.functions.distributions import DISTRIBUTIONS

    level = math.log(threshold) if logs else float(threshold)
    z = (level - intercept - slope * DESTRUCTIVE[transform](F.col(t).cast("double"))) / sigma
    above = DISTRIBUTIONS["normal"].sf(z, 0.0, 1.0)
    return rows.withColumn("ff", 1 - above if falling else above)


def wiener_remaining(rows: DataFrame, y: str, threshold: float, drift: float, sigma: float, probabilities: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """The rows with mean_remaining and q_<p>: times until a Wiener process with positive drift first reaches the threshold from y.

    First passages are inverse Gaussian; quantiles are found by bisection of their distribution, whole columns at a time.
    A level at the threshold or past it has 0 left.
    """
    if drift <= 0:
        raise ValueError("the drift must be positive")
    from tidewatch.functions.special import norm_cdf

    def below(t: np.ndarray, a: np.ndarray) -> np.ndarray:
        root = sigma * np.sqrt(t)
        with np.errstate(all="ignore"):
            tail = norm_cdf(-(a + drift * t) / root)
            echo = np.where(tail > 0, np.exp(np.minimum(2 * drift * a / sigma**2 + np.log(np.maximum(tail, 1e-300)), 0.0)), 0.0)
        return norm_cdf((drift * t - a) / root) + echo

    def quantile(p: float):
        @pandas_udf("double")
        def run(level: pd.Series) -> pd.Series:
            a = np.maximum(threshold - level.to_numpy(float), 0.0)
            lo, hi = np.zeros(len(a)), np.maximum(a, 1e-12) / drift + 1e-12
            while (short := below(hi, a) < p).any():
                hi = np.where(short, 2 * hi, hi)
            for _ in range(80):
                mid = (lo + hi) / 2
                low = below(np.maximum(mid, 1e-300), a) < p
                lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
            return pd.Series(np.where(a > 0, (lo + hi) / 2, 0.0))
        return run(F.col(y).cast("double"))

    left = F.greatest(F.lit(0.0), threshold - F.col(y)) / drift
    return rows.withColumns({"mean_remaining": left} | {f"q_{p:g}": quantile(p) for p in probabilities})
