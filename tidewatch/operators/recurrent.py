"""Recurrent events of items: inter-arrival times, mean cumulative functions, trend tests, closed-form intensities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.observations import INF
from tidewatch.operators.running import running, total


def recurrent_events(df: DataFrame, item: str, x: str, c: str | None = None, n: str | None = None, tl: str | float | None = None, mark: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in canonical form: (by, i, x, c, n, tl, e). A missing mark means censored where no flag is given."""
    flag = F.col(c).cast("int") if c else (F.when(F.col(mark).isNull(), 1).otherwise(0) if mark else F.lit(0))
    entry = F.lit(-INF) if tl is None else (F.col(tl).cast("double") if isinstance(tl, str) else F.lit(float(tl)))
    return df.select(*by, F.col(item).alias("i"), F.col(x).cast("double").alias("x"), flag.alias("c"),
                     (F.col(n) if n else F.lit(1)).cast("double").alias("n"), F.coalesce(entry, F.lit(-INF)).alias("tl"),
                     (F.col(mark) if mark else F.lit(None).cast("string")).alias("e"))


def _item(by: tuple[str, ...]):
    return Window.partitionBy(*by, "i").orderBy("x", "c")


def interarrival(events: DataFrame, by: tuple[str, ...] = (), start: float = 0.0) -> DataFrame:
    """previous (the item's last time, or its finite entry, or `start`) and gap of every row."""
    entry = F.when(F.col("tl") > -INF, F.col("tl")).otherwise(F.lit(float(start)))
    return events.withColumn("previous", F.coalesce(F.lag("x").over(_item(by)), entry)).withColumn("gap", F.col("x") - F.col("previous"))


def first_events(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each item's first row."""
    return events.withColumn("__k", F.row_number().over(_item(by))).filter("__k = 1").drop("__k")


def mean_cumulative(risk: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, r, d) with mcf and its variance: running sums over the times."""
    r, d = F.col("r"), F.col("d")
    var = F.when((d > 0) & (r > 0), (d * F.pow(1 - 1 / r, F.lit(2)) + (r - d) / (r * r)) / (r * r)).otherwise(0.0)
    return running(risk, by, "x", {"mcf": total(F.when(r > 0, d / r).otherwise(0.0)), "variance": total(var)})


def trend_tests(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, t_total, laplace, mil_hdbk): trend statistics pooled over items.

    Items end at their censoring row or, without one, at their last event, which then isn't counted. laplace:
    standardised mean of event times; mil_hdbk: 2 sum ln(T/x), chi-square with 2n degrees without a trend.
    """
    own = events.withColumn("__end", F.max("x").over(Window.partitionBy(*by, "i")))
    stopped = F.max(F.col("c") == 1).over(Window.partitionBy(*by, "i"))
    last = F.row_number().over(Window.partitionBy(*by, "i").orderBy(F.desc("x"), F.desc("c"))) == 1
    own = own.withColumns({"__stop": stopped, "__last": last}).filter("__end > 0")
    used = (F.col("c") == 0) & (F.col("__stop") | ~F.col("__last")) & (F.col("x") > 0)
    item = own.groupBy(*by, "i").agg(
        F.sum(used.cast("long")).alias("m"), F.max("__end").alias("t"), F.sum(F.when(used, F.col("x"))).alias("sx"),
        F.sum(F.when(used, F.ln(F.col("__end") / F.col("x")))).alias("sl"))
    return item.groupBy(*by).agg(
        F.sum("m").alias("n"), F.sum("t").alias("t_total"),
        (F.sum(F.coalesce("sx", F.lit(0.0)) - F.col("m") * F.col("t") / 2) / F.sqrt(F.nullif(F.sum(F.col("m") * F.col("t") * F.col("t") / 12), F.lit(0.0)))).alias("laplace"),
        (2 * F.sum(F.coalesce("sl", F.lit(0.0)))).alias("mil_hdbk"))


def homogeneous_poisson(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, exposure, rate, neg_ll): events over observed time, the closed-form fit."""
    item = events.groupBy(*by, "i").agg(F.sum(F.when(F.col("c") != 1, F.col("n")).otherwise(0.0)).alias("n"),
                                        (F.max("x") - F.greatest(F.lit(0.0), F.min("tl"))).alias("t"))
    both = item.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("t").alias("exposure")).withColumn("rate", F.try_divide("n", "exposure"))
    return both.withColumn("neg_ll", F.col("rate") * F.col("exposure") - F.col("n") * F.ln(F.nullif(F.col("rate"), F.lit(0.0))))


def crow_amsaa(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, alpha, beta) of the power-law intensity for items that all start at 0 and end at a common time:
    beta = n / sum ln(T/x), alpha such that the expected count over all items is n."""
    used = (F.col("c") == 0) & (F.col("x") > 0)
    agg = events.groupBy(*by).agg(F.countDistinct("i").cast("double").alias("k"), F.max("x").alias("t"), F.sum(F.when(F.col("c") == 0, 1.0).otherwise(0.0)).alias("n"),
                                  F.sum(F.when(used, 1.0)).alias("m"), F.sum(F.when(used, F.ln("x"))).alias("l"))
    fit = agg.withColumn("s", F.col("m") * F.ln("t") - F.col("l")).withColumn("beta", F.try_divide("n", "s"))
    return fit.select(*by, "n", (F.col("t") / F.pow(F.col("n") / F.col("k"), 1 / F.col("beta"))).alias("alpha"), "beta")


def virtual_age(events: DataFrame, q: float, kind: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """virtual_age just before each event's gap: Kijima I keeps q of every gap, Kijima II q of all age so far."""
    own = interarrival(events, by)
    before = _item(by).rowsBetween(Window.unboundedPreceding, -1)
    if kind == 1:
        return own.withColumn("virtual_age", F.coalesce(F.lit(q) * F.sum("gap").over(before), F.lit(0.0)))
    # a linear recurrence: one pass over each item's gaps
    import pyarrow as pa

    place = F.row_number().over(_item(by))
    kept = own.columns

    def ages(table: pa.Table) -> pa.Table:
        table = table.sort_by("__k")
        out, v = [], 0.0
        for g in table.column("gap").to_pylist():
            out.append(v)
            v = q * (v + g)
        return table.select(kept).append_column("virtual_age", pa.array(out, pa.float64()))

    from pyspark.sql import types as T

    schema = T.StructType([*own.schema.fields, T.StructField("virtual_age", T.DoubleType())])
    return own.withColumn("__k", place).groupBy(*by, "i").applyInArrow(ages, schema)


def arithmetic_reduction_age(events: DataFrame, rho: float, m: int, by: tuple[str, ...] = ()) -> DataFrame:
    """virtual_age under reduction of age with memory m: the last time less rho-discounted earlier ones."""
    own = interarrival(events, by)
    last = F.reverse(F.collect_list("x").over(_item(by).rowsBetween(-m, -1)))
    cut = F.aggregate(F.transform(last, lambda t, j: F.lit(rho) * F.pow(F.lit(1 - rho), j) * t), F.lit(0.0), lambda a, v: a + v)
    return own.withColumn("virtual_age", F.coalesce(F.get(last, 0) - cut, F.lit(0.0)))


def in_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events with the entry `tl` and end `close` of the observation window they fall into: an equi-join by item and
    a range test; of touching windows the first counts. Events outside all windows of their item are dropped: see
    `outside_windows`."""
    own = events.drop("tl").join(windows.select("i", F.col("start").cast("double").alias("tl"), F.col("end").cast("double").alias("close")), "i").filter("x >= tl and x <= close")
    first = Window.partitionBy("i", "x", "c").orderBy("tl")
    return own.withColumn("__k", F.dense_rank().over(first)).filter("__k = 1").drop("__k")


def outside_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events that no window of their item holds."""
    own = windows.select(F.col("i").alias("__i"), "start", "end")
    return events.join(own, (events["i"] == own["__i"]) & (events["x"] >= own["start"]) & (events["x"] <= own["end"]), "left_anti")


def mcf_limits(mcf: DataFrame, alpha: float = 0.05, kind: str = "exp") -> DataFrame:
    """lower and upper of a mean cumulative function: on the log scale (exp) or plain (normal)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - alpha / 2)
    m, se = F.col("mcf"), F.sqrt("variance")
    if kind == "normal":
        return mcf.withColumns({"lower": m - z * se, "upper": m + z * se})
    w = F.exp(z * F.try_divide(se, m))
    return mcf.withColumns({"lower": m / w, "upper": m * w})


def event_types(events: DataFrame) -> DataFrame:
    """(e): the marks that occur, in order."""
    return events.select("e").filter("e is not null").distinct().orderBy("e")


def truncation_close(events: DataFrame, tr: str) -> DataFrame:
    """(i, last, close) of items whose observation ends at a finite time."""
    return events.groupBy("i").agg(F.max("x").alias("last"), F.max(tr).cast("double").alias("close")).filter(F.col("close") < INF)


def require_plain(events: DataFrame, model: str, entries: bool = False, marks: bool = True) -> DataFrame:
    """The events unchanged, or ValueError where a model can't take them: delayed entries (unless `entries`), flags other
    than event and right-censored, a censored row that isn't its item's last."""
    last = F.max("x").over(Window.partitionBy("i"))
    row = events.withColumn("__last", last).agg(
        F.max((F.col("tl") > 0).cast("int")).alias("late"), F.max((~F.col("c").isin(0, 1)).cast("int")).alias("flags"),
        F.max(((F.col("c") == 1) & (F.col("x") < F.col("__last"))).cast("int")).alias("inside")).first()
    found = [text for text, bad in (("delayed entry", row.late and not entries), ("interval or left-censored rows", row.flags), ("censoring before an item's end", row.inside)) if bad]
    if found:
        raise ValueError(f"{model} can't take {', '.join(found)}")
    return events


def conditional_uniforms(events: DataFrame, cif, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, u): each event's share of its item's expected events, (cif(x) - cif(entry)) / (cif(end) - cif(entry)).

    An item ends at its censoring row; without one at its last event, which then isn't used. cif: column -> column.
    """
    w = Window.partitionBy(*by, "i")
    own = events.withColumns({"__end": F.max("x").over(w), "__stop": F.max((F.col("c") == 1).cast("int")).over(w), "__from": F.greatest(F.lit(0.0), F.min("tl").over(w)),
                              "__k": F.row_number().over(w.orderBy(F.desc("x"), F.desc("c")))})
    used = own.filter("c = 0 and (__stop = 1 or __k > 1)")
    base = cif(F.col("__from"))
    u = (cif(F.col("x")) - base) / F.nullif(cif(F.col("__end")) - base, F.lit(0.0))
    return used.select(*by, "i", u.alias("u")).filter("u is not null")


def cramer_von_mises(uniforms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, m, cvm): the distance of the values u from the uniform distribution, 1/(12m) + sum (u - (2j-1)/(2m))^2."""
    grid = uniforms.groupBy(*by, "u").agg(F.count("*").cast("double").alias("k"))
    grid = running(grid, by, "u", {"upto": total(F.col("k"))})
    # of k equal values with ranks a+1..a+k: sums of (u - (2j-1)/2m) over these ranks need the first two powers of j only
    last, first, k, u = F.col("upto"), F.col("upto") - F.col("k"), F.col("k"), F.col("u")
    s1 = (last * (last + 1) - first * (first + 1)) / 2
    s2 = (last * (last + 1) * (2 * last + 1) - first * (first + 1) * (2 * first + 1)) / 6
    sums = grid.groupBy(*by).agg(F.sum("k").alias("m"), F.sum(k * u * u).alias("a"), F.sum(u * (2 * s1 - k)).alias("b"), F.sum(4 * s2 - 4 * s1 + k).alias("c"))
    m = F.col("m")
    return sums.select(*by, "m", (1 / (12 * m) + F.col("a") - F.col("b") / m + F.col("c") / (4 * m * m)).alias("cvm"))


def intensity_reduction(events: DataFrame, iif, rho: float, m: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows with `reduction` just before each event: rho * sum (1-rho)^j iif of the last m events, the newest first."""
    past = F.reverse(F.collect_list(iif(F.col("x"))).over(_item(by).rowsBetween(-m, -1)))
    cut = F.aggregate(F.transform(past, lambda v, j: F.lit(rho) * F.pow(F.lit(1 - rho), j) * v), F.lit(0.0), lambda a, v: a + v)
    return events.withColumn("reduction", cut)
