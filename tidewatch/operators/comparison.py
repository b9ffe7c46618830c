"""Tests that compare groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.special import chi2_sf
from tidewatch.operators.running import latest, running, times


def logrank_terms(risk: DataFrame, group: str, weighting: str = "log-rank", rho: float = 0.0, gamma: float = 0.0, strata: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: (group, z) and, per pair of groups, the covariance: (group, other, z, v).

    risk: (strata, group, x, r, d). Every group's numbers at risk are carried to all event times; weights: log-rank, gehan, tarone-ware, fleming-harrington (rho, gamma).
    """
    groups = [r[0] for r in risk.select(group).distinct().orderBy(group).collect()]  # a handful by nature
    k = range(len(groups))
    wide = risk.groupBy(*strata, "x").agg(
        *[F.sum(F.when(F.col(group) == g, F.col("d")).otherwise(0.0)).alias(f"d{j}") for j, g in enumerate(groups)],
        *[F.max(F.when(F.col(group) == g, F.col("r"))).alias(f"r{j}") for j, g in enumerate(groups)])
    wide = running(wide, strata, "x", {f"q{j}": latest(F.col(f"r{j}")) for j in k}, descending=True)
    wide = wide.withColumns({f"r{j}": F.coalesce(f"q{j}", F.lit(0.0)) for j in k})
    wide = wide.withColumns({"d": sum((F.col(f"d{j}") for j in k), F.lit(0.0)), "r": sum((F.col(f"r{j}") for j in k), F.lit(0.0))}).filter("r > 0")
    wide = running(wide, strata, "x", {"s": times(1 - F.col("d") / F.col("r"), before=True)})
    s = F.col("s")
    weight = {"log-rank": F.lit(1.0), "gehan": F.col("r"), "tarone-ware": F.sqrt("r"),
              "fleming-harrington": F.pow(s, F.lit(rho)) * F.pow(1 - s, F.lit(gamma))}[weighting]
    wide = wide.withColumn("w", weight).filter("d > 0")
    w, d, r = F.col("w"), F.col("d"), F.col("r")
    spread = F.when(r > 1, w * w * d * (r - d) / (r - 1)).otherwise(0.0)
    z = [F.sum(w * (F.col(f"d{j}") - d * F.col(f"r{j}") / r)) for j in k]
    rows = [F.struct(F.lit(str(groups[j])).alias("group"), F.lit(str(groups[m])).alias("other"), F.col(f"z{j}").alias("z"), F.col(f"v{j}_{m}").alias("v")) for j in k for m in k]
    one = wide.agg(*[z[j].alias(f"z{j}") for j in k], *[
        F.sum(spread * (F.col(f"r{j}") / r * (F.lit(1.0 if j == m else 0.0) - F.col(f"r{m}") / r))).alias(f"v{j}_{m}") for j in k for m in k])
    return one.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def logrank(risk: DataFrame, group: str, **options) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p-value) of the k-group test."""
    rows = logrank_terms(risk, group, **options).collect()
    names = sorted({r["group"] for r in rows})
    z = np.array([next(r["z"] for r in rows if r["group"] == g) for g in names])
    v = np.array([[next(r["v"] for r in rows if r["group"] == g and r["other"] == h) for h in names] for g in names])
    stat = float(z[:-1] @ np.linalg.solve(v[:-1, :-1], z[:-1]))
    return stat, len(names) - 1, chi2_sf(stat, len(names) - 1)
