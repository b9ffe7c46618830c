"""Survival curves from risk tables, their variances and limits, and what is read off them."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.running import Run, latest, running, times, total


def _digamma(z: str) -> str:
    """The logarithmic derivative of the gamma function for z >= 1, to about 1e-13: the asymptotic series at z + 10,
    brought back by the recurrence."""
    y, less = f"({z} + 10)", " + ".join(f"1 / ({z} + {k})" for k in range(10))
    q = f"(1 / ({y} * {y}))"
    return f"(ln({y}) - 0.5D / {y} - {q} * (1 / 12D - {q} * (1 / 120D - {q} * (1 / 252D - {q} * (1 / 240D - {q} / 132D)))) - ({less}))"


def _trigamma(z: str) -> str:
    """The derivative of the digamma function, likewise."""
    y, more = f"({z} + 10)", " + ".join(f"1 / (({z} + {k}) * ({z} + {k}))" for k in range(10))
    q = f"(1 / ({y} * {y}))"
    return f"(1 / {y} + 0.5D * {q} + {q} / {y} * (1 / 6D - {q} * (1 / 30D - {q} * (1 / 42D - {q} * (1 / 30D - {q} * 5 / 66D)))) + {more})"


def _ladder(power: int) -> Column:
    """Sum of 1/(r-k)**power for k below the number of ties, the last step in part for a fractional count.

    Sums of reciprocals are differences of the digamma or trigamma function, so ties cost nothing.
    """
    high, low = "(r + 1)", "(r - floor(d) + 1)"
    steps = f"{_digamma(high)} - {_digamma(low)}" if power == 1 else f"{_trigamma(low)} - {_trigamma(high)}"
    rest = f"case when d > floor(d) then (d - floor(d)) / power(r - floor(d), {power}) else 0D end"
    return F.expr(f"case when d = 1 then 1 / power(r, {power}) when d > 0 then {steps} + {rest} else 0D end")


def survival_curves(risk: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, r, d) with km, na and fh (survival by Kaplan-Meier, Nelson-Aalen, Fleming-Harrington), the hazards
    na_h and fh_h, and the variances greenwood (null from where r = d), na_var and fh_var of the log survival."""
    r, d = F.col("r"), F.col("d")
    step = F.when(r > 0, d / r).otherwise(0.0)
    out = running(risk, by, "x", {
        "km": times(1 - step), "na_h": total(step), "fh_h": total(_ladder(1)), "greenwood": total(F.when(r > d, d / (r * (r - d)))),
        "na_var": total(F.when(r > 0, d / (r * r)).otherwise(0.0)), "fh_var": total(_ladder(2)), "__end": Run("max", (r <= d).cast("int")),
    })
    return out.withColumn("greenwood", F.when(F.col("__end") == 0, F.col("greenwood"))).drop("__end").withColumns({"na": F.exp(-F.col("na_h")), "fh": F.exp(-F.col("fh_h"))})


def confidence_limits(curve: DataFrame, sf: str = "km", var: str = "greenwood", alpha: float = 0.05, kind: str = "exp", by: tuple[str, ...] = ()) -> DataFrame:
    """lower and upper limits of a curve: on the log-log scale (kind exp) or plain (kind normal).

    Where a limit isn't finite, the lower is 0 and the upper the smallest finite one of the group.
    """
    z = NormalDist().inv_cdf(1 - alpha / 2)
    s, v = F.col(sf), F.col(var)
    if kind == "normal":
        half = z * s * F.sqrt(v)
        low, high = s - half, s + half
    else:
        usable = (s > 0) & (s < 1) & v.isNotNull()
        half = F.when(usable, z * F.sqrt(v) / F.ln(s))
        low = F.when(s == 1, 1.0).otherwise(F.exp(-F.exp(F.ln(-F.ln(F.when(usable, s))) - half)))
        high = F.when(s == 1, 1.0).otherwise(F.exp(-F.exp(F.ln(-F.ln(F.when(usable, s))) + half)))
    # limits are without value only from where the curve ends, so the smallest finite one comes before
    own = running(curve.withColumns({"lower": low, "upper": high}), by, "x", {"__least": Run("min", F.col("upper"))})
    return own.withColumns({"upper": F.coalesce("upper", "__least"), "lower": F.coalesce("lower", F.lit(0.0))}).drop("__least")


def at(curve: DataFrame, probes: DataFrame, values: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Values of a step curve at probe times: an as-of lookup by one union and running last values, no range join.

    values: column -> value before the curve's first time. probes: (by, t).
    """
    tagged = curve.select(*by, "x", F.lit(0).alias("__probe"), *[F.col(v).alias(v) for v in values]).unionByName(
        probes.select(*by, F.col("t").cast("double").alias("x"), F.lit(1).alias("__probe"), *[F.lit(None).cast("double").alias(v) for v in values]))
    filled = running(tagged, by, "x", {f"__{v}": latest(F.col(v)) for v in values}, ties=("__probe",))
    return filled.filter("__probe = 1").select(*by, F.col("x").alias("t"), *[F.coalesce(f"__{v}", F.lit(before)).alias(v) for v, before in values.items()])


def quantiles(curve: DataFrame, probabilities: list[float], sf: str = "km", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, p, q): the first time at which 1 - survival reaches p; null if it never does."""
    found = curve.groupBy(*by).agg(*[F.min(F.when(1 - F.col(sf) >= p - 1e-12, F.col("x"))).alias(f"q{k}") for k, p in enumerate(probabilities)])
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"q{k}").alias("q")) for k, p in enumerate(probabilities)]))
    return found.select(*by, pairs.alias("s")).select(*by, "s.p", "s.q")


def _areas(curve: DataFrame, tau: float | None, sf: str, by: tuple[str, ...]) -> DataFrame:
    """The curve with area: what lies under it up to each time (or tau, if that is earlier)."""
    own = running(curve, by, "x", {"__x": latest(F.col("x"), before=True), "__s": latest(F.col(sf), before=True)})
    upto = (lambda c: F.least(F.lit(float(tau)), c)) if tau is not None else (lambda c: c)
    step = F.coalesce("__s", F.lit(1.0)) * (upto(F.col("x")) - upto(F.coalesce("__x", F.lit(0.0))))
    return running(own.select(*curve.columns, step.alias("__a")), by, "x", {"area": total(F.col("__a"))})


def restricted_mean(curve: DataFrame, tau: float, sf: str = "km", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, rmst, variance): area under the curve up to tau, and the sum of squared later areas by Greenwood terms."""
    own = _areas(curve, tau, sf, by)
    term = F.when((F.col("r") > F.col("d")) & (F.col("x") <= tau), F.col("d") / (F.col("r") * (F.col("r") - F.col("d")))).otherwise(0.0)
    # the area after a time is the whole less the area up to it, so its square needs three sums
    sums = own.groupBy(*by).agg(F.max("area").alias("a"), F.max("x").alias("last"), F.max_by(sf, "x").alias("s"), F.sum(term).alias("t0"),
                                F.sum(term * F.col("area")).alias("t1"), F.sum(term * F.col("area") * F.col("area")).alias("t2"))
    whole = F.col("a") + F.col("s") * F.greatest(F.lit(0.0), tau - F.col("last"))
    own = sums.withColumn("rmst", whole)
    return own.select(*by, "rmst", (F.col("rmst") * F.col("rmst") * F.col("t0") - 2 * F.col("rmst") * F.col("t1") + F.col("t2")).alias("variance"))


def hazard_steps(probed: DataFrame, h: str, by: tuple[str, ...] = ()) -> DataFrame:
    """hf: increments of a cumulative hazard from probe to probe; flat stretches carry the last increment on."""
    w = Window.partitionBy(*by).orderBy("t")
    step = F.nullif(F.col(h) - F.lag(h).over(w), F.lit(0.0))
    own = probed.withColumn("__s", step)
    run = F.last("__s", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    second = F.lead("__s").over(w)
    return own.withColumn("hf", F.when(F.row_number().over(w) == 1, second).otherwise(run)).drop("__s")


def smoothed_hazard(curve: DataFrame, probes: DataFrame, bandwidth: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, t, hf): Epanechnikov kernel over the hazard's steps. Probes meet only the steps of their own and the
    neighbouring cells of one bandwidth, so the join is an equi-join on cells."""
    b = float(bandwidth)
    cell = lambda c: F.floor(F.col(c) / b).cast("long")
    steps = curve.filter("d > 0").select(*by, "x", (F.col("d") / F.col("r")).alias("__h"), F.explode(F.array(cell("x") - 1, cell("x"), cell("x") + 1)).alias("__cell"))
    near = probes.withColumn("__cell", cell("t")).join(steps, [*by, "__cell"], "left")
    u = (F.col("t") - F.col("x")) / b
    weight = F.when(F.abs(u) <= 1, 0.75 * (1 - u * u) / b).otherwise(0.0)
    return near.groupBy(*by, "t").agg(F.coalesce(F.sum(weight * F.col("__h")), F.lit(0.0)).alias("hf"))


#: Constants A and B of the plotting position (rank - A) / (N + B).
POSITIONS = {
    "Blom": (0.375, 0.25), "Median": (0.3, 0.4), "ECDF": (0.0, 0.0), "ECDF_Adj": (0.0, 1.0), "Mean": (0.0, 1.0), "Weibull": (0.0, 1.0),
    "Modal": (1.0, -1.0), "Midpoint": (0.5, 0.0), "Benard": (0.3, 0.2), "Beard": (0.31, 0.38), "Hazen": (0.5, 0.0), "Gringorten": (0.44, 0.12),
    "Larsen": (0.567, -0.134), "Larsen2": (1 / 3, 1 / 3), "None": (0.0, 0.0),
}


def plotting_positions(obs: DataFrame, heuristic: str = "Blom", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, r, d, rank, f): Johnson-adjusted ranks of the times and their plotting positions.

    The adjusted rank after a failure is (N+1)(1 - product of (1 - 1/(remaining+1))) over failures so far: a
    running product per distinct time, in which d failures among r at risk give the factor (r+1-d)/(r+1).
    """
    from tidewatch.operators.risk import simple_risk_table

    a, b = POSITIONS[heuristic]
    risk = simple_risk_table(obs, by)
    own = running(risk, by, "x", {"__n": Run("max", F.col("r")), "__p": times((F.col("r") + 1 - F.col("d")) / (F.col("r") + 1))})  # all are at risk at first
    return own.withColumn("rank", (F.col("__n") + 1) * (1 - F.col("__p"))).withColumn("f", F.when(F.col("rank") > 0, (F.col("rank") - a) / (F.col("__n") + b)).otherwise(0.0)).drop("__n", "__p")


def success_run(n: Column, alpha: float = 0.05) -> Column:
    """The reliability that n successes in a row show."""
    return F.pow(F.lit(alpha), 1 / n)


def restricted_mean_difference(curve: DataFrame, group: str, tau: float, alpha: float = 0.05, sf: str = "km") -> DataFrame:
    """(a, b, difference, se, lower, upper, ratio, z): restricted means of each pair of groups, the first less the second."""
    own = restricted_mean(curve, tau, sf, (group,))
    a = own.select(F.col(group).alias("a"), F.col("rmst").alias("ra"), F.col("variance").alias("va"), F.lit(0).alias("k"))
    b = own.select(F.col(group).alias("b"), F.col("rmst").alias("rb"), F.col("variance").alias("vb"), F.lit(0).alias("k"))
    z = NormalDist().inv_cdf(1 - alpha / 2)
    both = a.join(b, "k").filter("a < b").withColumns({"difference": F.col("ra") - F.col("rb"), "se": F.sqrt(F.col("va") + F.col("vb"))})
    return both.select("a", "b", "difference", "se", (F.col("difference") - z * F.col("se")).alias("lower"), (F.col("difference") + z * F.col("se")).alias("upper"),
                       F.try_divide("ra", "rb").alias("ratio"), F.try_divide("difference", "se").alias("z"))


def quantile_limits(limits: DataFrame, p: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, lower, upper): limits of a quantile, by inverting the curve's limits (rows with lower and upper)."""
    return limits.groupBy(*by).agg(F.min(F.when(F.col("lower") <= 1 - p, F.col("x"))).alias("lower"), F.min(F.when(F.col("upper") < 1 - p, F.col("x"))).alias("upper"))


def bootstrap_limits(obs: DataFrame, times: list[float], replicates: int = 200, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """(t, lower, upper): percentile limits of Kaplan-Meier from Poisson-weighted replicates.

    Rows are compressed first; each distinct row then meets each replicate once, with a Poisson count that stands
    for its n rows (a normal approximation above 30), and all replicates' curves are made in one job.
    """
    from tidewatch.operators.observations import compress
    from tidewatch.operators.risk import simple_risk_table

    packed = compress(obs).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.rand(seed)
    small = F.aggregate(F.sequence(F.lit(0), F.lit(80)), F.struct(F.lit(0.0).alias("k"), F.exp(-F.least("n", F.lit(30.0))).alias("p"), F.lit(0.0).alias("c"), F.col("u").alias("u")), lambda a, i: F.struct(
        F.when(a["c"] + a["p"] < a["u"], a["k"] + 1).otherwise(a["k"]).alias("k"), (a["p"] * F.least("n", F.lit(30.0)) / (i + 1)).alias("p"), (a["c"] + a["p"]).alias("c"), a["u"].alias("u")), lambda a: a["k"])
    drawn = F.when(F.col("n") <= 30, small).otherwise(F.greatest(F.lit(0.0), F.round(F.col("n") + F.sqrt("n") * F.col("g"))))
    weighted = packed.withColumns({"u": u, "g": F.randn(seed + 1)}).withColumn("n", drawn).filter("n > 0").select("rep", "x", "x_hi", "c", "n", "tl", "tr")
    curve = survival_curves(simple_risk_table(weighted, ("rep",)), ("rep",))
    probes = curve.select("rep").distinct().withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    found = at(curve, probes, {"km": 1.0}, ("rep",))
    return found.groupBy("t").agg(F.percentile("km", F.lit(alpha / 2)).alias("lower"), F.percentile("km", F.lit(1 - alpha / 2)).alias("upper"))


def band_width(low: float, high: float, alpha: float = 0.05, equal_precision: bool = False, paths: int = 10_000, steps: int = 1000, seed: int = 1) -> float:
    """The quantile of the largest value, on (low, high), of simulated Brownian bridges, or of these over their standard error."""
    import numpy as np

    rng = np.random.default_rng(seed)
    grid = np.arange(1, steps + 1) / steps
    inside = (grid >= low) & (grid <= high) & (grid < 1)
    if not inside.any():
        inside = np.abs(grid - (low + high) / 2) == np.abs(grid - (low + high) / 2).min()
    scale = np.sqrt(grid * (1 - grid))[inside] if equal_precision else 1.0
    tops = []
    for k in range(0, paths, 500):  # 4 MB of paths at a time
        moves = rng.normal(0, (1 / steps) ** 0.5, (min(500, paths - k), steps)).cumsum(axis=1)
        tops.append((np.abs(moves - grid * moves[:, -1:])[:, inside] / scale).max(axis=1))
    return float(np.quantile(np.concatenate(tops), 1 - alpha))


def simultaneous_band(curve: DataFrame, n: float, alpha: float = 0.05, paths: int = 10_000, steps: int = 1000, seed: int = 1, method: str = "hall-wellner", kind: str = "exp") -> DataFrame:
    """The curve's rows with lower and upper of a band that holds the whole curve: Hall-Wellner, or equal-precision (nair).

    n: rows of the sample. kind: on the log-log scale (exp) or plain (normal). Limits are null outside the times at
    which the variance is positive and the survival between 0 and 1; ValueError where there are none.
    """
    if method not in ("hall-wellner", "nair") or kind not in ("exp", "normal"):
        raise ValueError("method is hall-wellner or nair, kind exp or normal")
    v, s = F.col("greenwood"), F.col("km")
    usable = v.isNotNull() & (v > 0) & (s > 0) & (s < 1)
    low, high = curve.filter(usable).agg(F.min(n * v / (1 + n * v)), F.max(n * v / (1 + n * v))).first()
    if low is None:
        raise ValueError("no time has a variance")
    c = band_width(low, high, alpha, method == "nair", paths, steps, seed)
    half = F.when(usable, c * F.sqrt(v) if method == "nair" else c * (1 + n * v) / n**0.5)
    if kind == "normal":
        return curve.withColumns({"lower": s - half, "upper": s + half})
    theta, se = F.ln(-F.ln(F.when(usable, s))), half / F.abs(F.ln(F.when(usable, s)))
    return curve.withColumns({"lower": F.exp(-F.exp(theta + se)), "upper": F.exp(-F.exp(theta - se))})


def at_linear(curve: DataFrame, probes: DataFrame, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Values between a curve's points by straight lines; null before the first and after the last point."""
    tagged = curve.select(*by, "x", F.lit(0).alias("__probe"), *[F.struct("x", F.col(v).cast("double").alias("y")).alias(v) for v in values]).unionByName(
        probes.select(*by, F.col("t").cast("double").alias("x"), F.lit(1).alias("__probe")), allowMissingColumns=True)
    own = running(tagged, by, "x", {f"__a_{v}": latest(F.col(v)) for v in values}, ties=("__probe",))
    own = own.withColumn("__probe", 1 - F.col("__probe"))  # from the right, points come first again
    own = running(own, by, "x", {f"__b_{v}": latest(F.col(v)) for v in values}, descending=True, ties=("__probe",)).filter("__probe = 0")

    def line(v: str) -> Column:
        a, b = F.col(f"__a_{v}"), F.col(f"__b_{v}")
        return F.when(a.isNull() | b.isNull(), None).when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col("x") - a["x"]) / (b["x"] - a["x"]))

    return own.select(*by, F.col("x").alias("t"), *[line(v).alias(v) for v in values])


def from_distribution(points: DataFrame, x: str, f: str) -> DataFrame:
    """(x, km): a curve of given shares failed; without variances."""
    return points.select(F.col(x).cast("double").alias("x"), (1 - F.col(f)).cast("double").alias("km"))


def draws(curve: DataFrame, size: int, seed: int, sf: str = "km", u: DataFrame | None = None) -> DataFrame:
    """(id, u, t): event times drawn with the mass that a curve gives its times; mass that is left goes to all in proportion.

    u: rows (id, u) of uniforms to use instead of new ones.
    """
    own = (curve.filter("d > 0") if "d" in curve.columns else curve).select("x", F.col(sf).alias("s"))  # times with mass
    least = own.agg(F.min("s")).first()[0]
    if least is None or least >= 1:
        raise ValueError("the curve has no mass")
    uniforms = u if u is not None else curve.sparkSession.range(size).select("id", F.rand(seed).alias("u"))
    shares = own.select(((1 - F.col("s")) / (1 - least)).alias("o"), F.lit(0).alias("k"), F.col("x").alias("t"), F.lit(None).cast("long").alias("id"))
    both = shares.unionByName(uniforms.select(F.col("u").alias("o"), F.lit(-1).alias("k"), F.lit(None).cast("double").alias("t"), F.col("id").cast("long").alias("id")))
    # the first time at which the share failed is u or more: from above, the latest point before the draw; of flat
    # stretches the first time has the mass, and it is the least of its share
    first = both.filter("k = 0").groupBy("o", "k").agg(F.min("t").alias("t")).withColumn("id", F.lit(None).cast("long"))
    found = running(first.unionByName(both.filter("k = -1")), (), "o", {"found": latest(F.col("t"))}, descending=True, ties=("k",))
    return found.filter("k = -1").select("id", F.col("o").alias("u"), F.col("found").alias("t"))


def filliben_positions(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, r, d, rank, f): Filliben's medians (rank - 0.3175) / (N + 0.365), the first and the last by 0.5^(1/N)."""
    own = plotting_positions(obs, "None", by)
    own = running(own, by, "x", {"__first": latest(F.col("x"), before=True), "__n": Run("max", F.col("r"))})
    own = running(own, by, "x", {"__last": latest(F.col("x"), before=True)}, descending=True)
    n, edge = F.col("__n"), F.pow(F.lit(0.5), 1 / F.col("__n"))
    f = F.when(F.col("__last").isNull(), edge).when(F.col("__first").isNull(), 1 - edge).otherwise((F.col("rank") - 0.3175) / (n + 0.365))
    return own.withColumn("f", f).drop("__first", "__last", "__n")


def mean_life(curve: DataFrame, sf: str = "km", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mean): the area under a curve up to its last time."""
    return _areas(curve, None, sf, by).groupBy(*by).agg(F.max("area").alias("mean"))
