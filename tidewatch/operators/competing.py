"""Competing risks: cumulative incidence by cause."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.special import chi2_sf
from tidewatch.operators.running import running, times, total


def cumulative_incidence(df: DataFrame, x: str, cause: str, n: str | None = None, by: tuple[str, ...] = (), method: str = "na", left_limit: bool = False) -> DataFrame:
    """(by, cause, x, r, d, cs_hazard, iif, cif); a null cause is censored.

    iif = S d/r and cif its running sum, with S the survival from all causes: exp of minus the Nelson-Aalen sum
    (method na) or Kaplan-Meier (km), at the time itself or, with left_limit, just before it (Aalen-Johansen is
    km with left_limit). Times of all causes are aggregated once, and sums run within (by, cause).
    """
    weight = F.col(n).cast("double") if n else F.lit(1.0)
    cells = df.groupBy(*by, F.col(x).cast("double").alias("x"), F.col(cause).alias("cause")).agg(F.sum(weight).alias("d"))
    grid = cells.groupBy(*by, "x").agg(F.sum("d").alias("out"), F.sum(F.when(F.col("cause").isNotNull(), F.col("d")).otherwise(0.0)).alias("any"),
                                       F.collect_list(F.when(F.col("cause").isNotNull(), F.struct("cause", "d"))).alias("own"))  # a cause has one row a time
    grid = running(grid, by, "x", {"r": total(F.col("out"))}, descending=True)
    step = F.col("any") / F.col("r")
    grid = running(grid, by, "x", {"s": total(step, left_limit) if method == "na" else times(1 - step, left_limit)})
    s = F.exp(-F.col("s")) if method == "na" else F.col("s")
    own = grid.select(*by, "x", "r", s.alias("s"), F.explode("own").alias("o")).select(*by, "o.cause", "x", "r", "o.d", (F.col("s") * F.col("o.d") / F.col("r")).alias("iif"))
    return running(own, (*by, "cause"), "x", {"cs_hazard": total(F.col("d") / F.col("r")), "cif": total(F.col("iif"))})


def gray_terms(df: DataFrame, x: str, cause: str, group: str, of: str, rho: float = 0.0, n: str | None = None) -> DataFrame:
    """(group, other, z, v): Gray's comparison of one cause's incidence between groups; a null cause is censored.

    Those who failed from another cause stay at risk, weighted by G(t)/G(x) of the pooled censoring curve: per
    group a running sum of 1/G over earlier competing failures, times G at the time. No pairs of rows are made.
    Weights are (1 - F)**rho with the pooled Aalen-Johansen incidence F before the time, and the variance is
    hypergeometric in these risk sets, with ties.
    """
    kind = F.when(F.col(cause).isNull(), "c").when(F.col(cause) == of, "d").otherwise("o")
    weight = F.col(n).cast("double") if n else F.lit(1.0)
    cells = df.groupBy(F.col(x).cast("double").alias("x"), F.col(group).alias("g")).agg(*[F.sum(F.when(kind == k, weight).otherwise(0.0)).alias(k) for k in "cdo"])
    groups = [r[0] for r in cells.select("g").distinct().orderBy("g").collect()]  # a handful by nature
    k = range(len(groups))
    pick = lambda c, j: F.sum(F.when(F.col("g").eqNullSafe(F.lit(groups[j])), F.col(c)).otherwise(0.0)).alias(f"{c}{j}")
    t = cells.groupBy("x").agg(*[pick(c, j) for c in "cdo" for j in k])
    whole = lambda c: sum((F.col(f"{c}{j}") for j in k), F.lit(0.0))
    t = running(t, (), "x", {f"y{j}": total(F.col(f"c{j}") + F.col(f"d{j}") + F.col(f"o{j}")) for j in k}, descending=True)
    t = t.withColumns({"c": whole("c"), "d": whole("d"), "o": whole("o"), "y": whole("y")})
    t = running(t, (), "x", {"g": times(1 - F.col("c") / F.col("y")), "s": times(1 - (F.col("d") + F.col("o")) / F.col("y"), before=True)})
    stays = lambda j: total(F.when(F.col("g") > 0, F.col(f"o{j}") / F.col("g")), before=True)
    t = running(t, (), "x", {f"q{j}": stays(j) for j in k} | {"inc": total(F.col("s") * F.col("d") / F.col("y"), before=True)})
    t = t.withColumns({f"r{j}": F.col(f"y{j}") + F.col("g") * F.col(f"q{j}") for j in k}).withColumn("r", whole("r")).filter("d > 0 and r > 0")
    w, d, r = F.pow(1 - F.col("inc"), F.lit(float(rho))), F.col("d"), F.col("r")
    spread = F.when(r > 1, w * w * d * (r - d) / (r - 1)).otherwise(0.0)
    one = t.agg(*[F.sum(w * (F.col(f"d{j}") - d * F.col(f"r{j}") / r)).alias(f"z{j}") for j in k], *[
        F.sum(spread * F.col(f"r{j}") / r * (F.lit(1.0 if j == m else 0.0) - F.col(f"r{m}") / r)).alias(f"v{j}_{m}") for j in k for m in k])
    rows = [F.struct(F.lit(str(groups[j])).alias("group"), F.lit(str(groups[m])).alias("other"), F.col(f"z{j}").alias("z"), F.col(f"v{j}_{m}").alias("v")) for j in k for m in k]
    return one.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def gray_test(df: DataFrame, x: str, cause: str, group: str, of: str, rho: float = 0.0, n: str | None = None) -> DataFrame:
    """One row: statistic, df, p_value of Gray's test."""
    rows = gray_terms(df, x, cause, group, of, rho, n).collect()
    names = list(dict.fromkeys(r["group"] for r in rows))
    if len(names) < 2:
        raise ValueError("at least two groups are compared")
    if any(r["z"] is None for r in rows):
        raise ValueError(f"no events of cause {of!r}")
    z = np.array([next(r["z"] for r in rows if r["group"] == g) for g in names])
    v = np.array([[next(r["v"] for r in rows if (r["group"], r["other"]) == (g, h)) for h in names] for g in names])
    stat = float(z[:-1] @ np.linalg.lstsq(v[:-1, :-1], z[:-1], rcond=None)[0])
    return df.sparkSession.createDataFrame([(stat, len(names) - 1, float(chi2_sf(stat, len(names) - 1)))], "statistic double, df int, p_value double")


def fine_gray_terms(df: DataFrame, x: str, cause: str, z: list[str], beta: list[float], of: str) -> DataFrame:
    """One row: ll, u_i and h_i_j of the subdistribution hazard's partial likelihood at beta.

    The weighted risk set splits into those still under observation and earlier competing failures weighted by
    G(t)/G(x): running sums over distinct times.
    """
    p = range(len(z))
    eta = sum((F.lit(float(b)) * F.col(v) for b, v in zip(beta, z)), F.lit(0.0))
    own = df.withColumns({"__e": eta, "__p": F.exp(eta)})
    hit, other = F.coalesce(F.col(cause) == of, F.lit(False)), F.coalesce(F.col(cause) != of, F.lit(False))
    sums = {"s0": F.col("__p")} | {f"s1_{i}": F.col("__p") * F.col(z[i]) for i in p} | {f"s2_{i}_{j}": F.col("__p") * F.col(z[i]) * F.col(z[j]) for i in p for j in p if j <= i}
    when = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    t = own.groupBy(F.col(x).cast("double").alias("x")).agg(
        F.sum(F.col(cause).isNull().cast("double")).alias("c"), F.count("*").cast("double").alias("m"), when(hit, F.lit(1.0)).alias("d"), when(hit, F.col("__e")).alias("de"),
        *[when(hit, F.col(z[i])).alias(f"dz_{i}") for i in p], *[F.sum(v).alias(k) for k, v in sums.items()], *[when(other, v).alias(f"o_{k}") for k, v in sums.items()])
    t = running(t, (), "x", {"y": total(F.col("m"))} | {f"y_{k}": total(F.col(k)) for k in sums}, descending=True)
    t = running(t, (), "x", {"g": times(1 - F.col("c") / F.col("y"), before=True)})
    t = running(t, (), "x", {f"q_{k}": total(F.try_divide(F.col(f"o_{k}"), F.col("g")), before=True) for k in sums})
    t = t.withColumns({f"r_{k}": F.col(f"y_{k}") + F.col("g") * F.col(f"q_{k}") for k in sums}).filter("d > 0")
    mean = {i: F.col(f"r_s1_{i}") / F.col("r_s0") for i in p}
    return t.agg(F.sum(F.col("de") - F.col("d") * F.ln("r_s0")).alias("ll"), *[F.sum(F.col(f"dz_{i}") - F.col("d") * mean[i]).alias(f"u_{i}") for i in p],
                 *[F.sum(F.col("d") * (F.col(f"r_s2_{i}_{j}") / F.col("r_s0") - mean[i] * mean[j])).alias(f"h_{i}_{j}") for i in p for j in p if j <= i])


def cause_as_event(df: DataFrame, cause: str, of: str) -> DataFrame:
    """Rows with a flag c for one cause: its events, everything else censored."""
    return df.withColumn("c", F.when(F.col(cause) == of, 0).otherwise(1))
