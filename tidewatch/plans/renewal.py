"""Repairable systems: imperfect repair by virtual ages, and intensities, fitted on aggregates.

The likelihood of each row is a column of its gap and virtual age; one aggregation evaluates all shifted
parameters of a Newton step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.recurrent import interarrival
from tidewatch.plans.fit import at_points, newton

#: Baselines by name: number of parameters, cumulative hazard and log hazard with parameters on the log scale.
BASELINES = {
    "exponential": (1, lambda x, a: F.exp(-a) * x, lambda x, a: -a + x * 0),
    "weibull": (2, lambda x, a, b: F.pow(x / F.exp(a), F.exp(b)), lambda x, a, b: b - a + (F.exp(b) - 1) * (F.ln(F.when(x > 0, x)) - a)),
}
#: Intensities by name: cumulative and log intensity, parameters on the log scale where positive.
INTENSITIES = {
    "homogeneous": (1, lambda x, a: F.exp(a) * x, lambda x, a: a + x * 0),
    "crow-amsaa": (2, lambda x, a, b: F.pow(x / F.exp(a), F.exp(b)), lambda x, a, b: b - a + (F.exp(b) - 1) * (F.ln(F.when(x > 0, x)) - a)),
    "duane": (2, lambda x, a, b: F.exp(b) * F.pow(x, F.exp(a)), lambda x, a, b: a + b + (F.exp(a) - 1) * F.ln(F.when(x > 0, x))),
    "cox-lewis": (2, lambda x, a, b: F.exp(a) * (F.exp(b * x) - 1) / F.when(F.abs(b) > 1e-12, b).otherwise(1e-12), lambda x, a, b: a + b * x),
}


def _minimise(rows: DataFrame, nll, start: list[float]) -> tuple[np.ndarray, float]:
    own = rows.cache()
    n = own.count()
    many = lambda points: at_points(own, points, nll)
    best, _ = newton(lambda p: many([p])[0], np.array(start), tol=1e-8, steps=25, many=many)
    value = many([best])[0] * n
    own.unpersist()
    return best, value


def fit_renewal(events: DataFrame, kind: str = "kijima-1", baseline: str = "exponential", by: tuple[str, ...] = ()) -> dict[str, float]:
    """{log parameters, q, neg_ll} of general repair (kijima-1, kijima-2) or of the G1 renewal process (g1).

    kijima: the age after a repair keeps q of the gap (1) or of all age (2); g1: gap j is stretched by (1+q)**j.
    """
    size, H, h = BASELINES[baseline]
    w = Window.partitionBy(*by, "i").orderBy("x", "c")
    rows = interarrival(events, by).withColumn("k", (F.row_number().over(w) - 1).cast("double"))
    mean = rows.agg(F.avg("gap")).first()[0]
    if kind == "kijima-2":  # a row per item: its history goes through the recurrence of ages once
        rows = rows.groupBy(*by, "i").agg(F.array_sort(F.collect_list(F.struct("k", "gap", "c"))).alias("history")).select("history")
    else:
        rows = rows.filter("gap > 0 or c = 1").select("gap", "previous", "k", "c")

    def nll(*p: Column) -> Column:
        base, q = p[:size], p[size]
        if kind == "g1":
            ratio = F.pow(1 + q, F.col("k"))
            gap = F.col("gap") / ratio
            return H(gap, *base) - F.when(F.col("c") == 0, h(gap, *base) - F.ln(ratio)).otherwise(0.0)
        def loss(gap: Column, age: Column, c: Column) -> Column:
            return H(gap + age, *base) - H(age, *base) - F.when(c == 0, h(gap + age, *base)).otherwise(0.0)

        if kind == "kijima-1":
            return loss(F.col("gap"), F.greatest(q * F.col("previous"), F.lit(0.0)), F.col("c"))

        def step(s: Column, r: Column) -> Column:
            age = F.greatest(s["age"], F.lit(0.0))
            used = (r["gap"] > 0) | (r["c"] == 1)
            return F.struct((q * (s["age"] + r["gap"])).alias("age"), (s["loss"] + F.when(used, loss(r["gap"], age, r["c"])).otherwise(0.0)).alias("loss"))

        return F.aggregate("history", F.struct(F.lit(0.0).alias("age"), F.lit(0.0).alias("loss")), step)["loss"]

    best, value = _minimise(rows, nll, [np.log(mean)] + [0.0] * (size - 1) + [0.1])
    names = [f"log_{n}" for n in ("scale", "shape")[:size]] + ["q"]
    return dict(zip(names, map(float, best))) | {"neg_ll": value}


def fit_intensity(events: DataFrame, kind: str = "crow-amsaa", z: list[str] | None = None, by: tuple[str, ...] = ()) -> dict[str, float]:
    """{parameters, neg_ll} of a Poisson process, its intensity times exp(Zb) with covariates."""
    size, cum, log = INTENSITIES[kind]
    z = z or []
    rows = interarrival(events, by).select("x", "previous", "c", *z)

    def nll(*p: Column) -> Column:
        base = p[:size]
        lin = sum((b * F.col(k) for b, k in zip(p[size:], z)), F.lit(0.0))
        grown = cum(F.col("x"), *base) - F.when(F.col("previous") > 0, cum(F.greatest("previous", F.lit(1e-12)), *base)).otherwise(0.0)
        return F.exp(lin) * grown - F.when(F.col("c") == 0, lin + log(F.col("x"), *base)).otherwise(0.0)

    top, n, units = rows.agg(F.max("x"), F.sum((F.col("c") == 0).cast("double")), F.sum((F.col("previous") <= 0).cast("double"))).first()
    rate = max(n, 1.0) / max(units, 1.0) / top
    start = {"homogeneous": [np.log(rate)], "crow-amsaa": [-np.log(rate), 0.0], "duane": [0.0, np.log(rate)], "cox-lewis": [np.log(rate), 1e-6]}[kind]
    best, value = _minimise(rows.filter("x > 0"), nll, start + [0.0] * len(z))
    return dict(zip([*(f"p{k}" for k in range(size)), *z], map(float, best))) | {"neg_ll": value}


def rescaled_gaps(events: DataFrame, cum, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with `residual`: the expected number of events since the item's previous one, unit-exponential if the model holds."""
    own = interarrival(events, by)
    return own.withColumn("residual", cum(F.col("x")) - F.when(F.col("previous") > 0, cum(F.col("previous"))).otherwise(0.0))


def fit_intensity_by_cause(events: DataFrame, kind: str = "crow-amsaa", by: tuple[str, ...] = ()) -> dict[str, dict[str, float]]:
    """An intensity for each mark; items are observed for all marks alike, so events of others only end their gaps."""
    marks = [r.e for r in events.select("e").filter("e is not null").distinct().orderBy("e").collect()]  # a handful by nature
    return {m: fit_intensity(events.withColumn("c", F.when(F.col("e") == m, F.col("c")).otherwise(1)), kind, by=by) for m in marks}


def power_law_goodness(events: DataFrame, replicates: int = 200, seed: int = 1) -> DataFrame:
    """(cvm, p_value, replicates): Cramer-von Mises distance of a power-law process, fitted in closed form, from its data,
    against that of histories drawn from the fit and fitted again. Items start at 0 and end at a common time.

    All replicates are made, fitted and compared in one job each; replicates without events count as not worse.
    """
    from tidewatch.functions.intensities import Intensity, simulate
    from tidewatch.operators.recurrent import conditional_uniforms, cramer_von_mises, crow_amsaa

    spark = events.sparkSession
    fit = crow_amsaa(events).first()
    model = Intensity("crow-amsaa", (float(fit.alpha), float(fit.beta)))
    own = cramer_von_mises(conditional_uniforms(events, model.cif)).first().cvm
    items, end = events.agg(F.countDistinct("i"), F.max("x")).first()
    drawn = simulate(spark, model, int(items) * replicates, until=float(end), seed=seed)
    drawn = drawn.select((F.col("i") / int(items)).cast("int").alias("rep"), "i", "x", "c", F.lit(0.0).alias("tl"))
    # uniforms of a power law depend on its shape alone: (x / T)^beta
    again = crow_amsaa(drawn, ("rep",)).select("rep", "beta")
    u = conditional_uniforms(drawn, lambda x: x, ("rep",)).join(again, "rep").select("rep", F.pow("u", F.col("beta")).alias("u"))
    found = cramer_von_mises(u, ("rep",))
    return found.agg(F.lit(float(own)).alias("cvm"), ((F.count_if(F.col("cvm") >= own) + 1) / F.lit(replicates + 1)).alias("p_value"), F.lit(replicates).alias("replicates"))
