"""How well predictions order and calibrate event times.

Censoring is weighted by the inverse of G, the Kaplan-Meier curve of the censoring time, at the row's own time (its
value after any censoring there). Everything is aggregated by distinct time or risk before anything is sorted; no
pairs of rows are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.curves import at
from tidewatch.operators.running import running, times, total


def _censoring(grid: DataFrame) -> DataFrame:
    """A grid of times with m rows and q censored ones each, with g: the censoring curve."""
    return running(running(grid, (), "x", {"y": total(F.col("m"))}, descending=True), (), "x", {"g": times(1 - F.col("q") / F.col("y"))}).drop("y")


def _grid(df: DataFrame, x: str, c: str, more: dict[str, Column] | None = None) -> DataFrame:
    return df.groupBy(F.col(x).cast("double").alias("x")).agg(
        F.count("*").cast("double").alias("m"), F.sum((F.col(c) == 1).cast("double")).alias("q"), *[F.sum(v).alias(k) for k, v in (more or {}).items()])


def censoring_curve(df: DataFrame, x: str, c: str) -> DataFrame:
    """(x, g): Kaplan-Meier of the censoring time."""
    return _censoring(_grid(df, x, c)).select("x", "g")


def _with_g(grid: DataFrame, train: DataFrame | None, x: str, c: str) -> DataFrame:
    """The grid with g, from its own rows or those of a training set."""
    if train is None:
        return _censoring(grid)
    curve = censoring_curve(train, x, c)
    found = at(curve, grid.select(F.col("x").alias("t")), {"g": 1.0})
    return grid.join(found, grid["x"] == found["t"]).drop("t")


def brier_score(df: DataFrame, x: str, c: str, predicted: dict[float, str], train: DataFrame | None = None) -> DataFrame:
    """(t, brier): squared errors of predicted survival at horizons, weighted by the inverse censoring curve.

    predicted: horizon -> column of predicted survival. train: rows that the censoring curve is taken from, if not
    the scored ones. One aggregation by time holds all horizons' sums; weights are the same for all rows of a time.
    """
    horizons = [float(t) for t in predicted]
    more = {f"a{k}": F.when((F.col(x) <= t) & (F.col(c) == 0), F.col(s) * F.col(s)).otherwise(0.0) for k, (t, s) in enumerate(predicted.items())}
    more |= {f"b{k}": F.when(F.col(x) > t, (1 - F.col(s)) * (1 - F.col(s))).otherwise(0.0) for k, (t, s) in enumerate(predicted.items())}
    grid = _with_g(_grid(df, x, c, more), train, x, c)
    if train is None:
        g_t = [F.coalesce(F.min(F.when(F.col("x") <= t, F.col("g"))), F.lit(1.0)) for t in horizons]
    else:
        probes = df.sparkSession.createDataFrame([(t,) for t in horizons], "t double")
        known = {r.t: r.g for r in at(censoring_curve(train, x, c), probes, {"g": 1.0}).collect()}  # a row per horizon
        g_t = [F.lit(known[t]) for t in horizons]
    weight = F.when(F.col("g") > 0, 1 / F.col("g")).otherwise(0.0)
    score = lambda k: (F.sum(F.col(f"a{k}") * weight) + F.when(g_t[k] > 0, F.sum(f"b{k}") / g_t[k]).otherwise(0.0)) / F.sum("m")
    one = grid.agg(*[score(k).alias(f"s{k}") for k in range(len(horizons))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"s{k}").alias("brier")) for k, t in enumerate(horizons)])).alias("s")).select("s.*")


def integrated_brier_score(scores: DataFrame) -> DataFrame:
    """(ibs): the trapezoid mean of (t, brier) over their range of times; of a single time, its score."""
    w = Window.orderBy("t")  # a row per horizon
    own = scores.withColumns({"__dt": F.col("t") - F.lag("t").over(w), "__m": (F.col("brier") + F.lag("brier").over(w)) / 2})
    span = F.max("t") - F.min("t")
    return own.agg(F.when(span > 0, F.sum(F.col("__dt") * F.col("__m")) / span).otherwise(F.avg("brier")).alias("ibs"))


def concordance(df: DataFrame, x: str, c: str, risk: str) -> DataFrame:
    """(comparable, concordant, tied, c_index): Harrell's index of pairs in which the one who failed first had the higher risk.

    Pairs whose earlier time is censored, and pairs censored at one time, don't count. Two failures at a time count
    as concordant with equal risks, else half; a failure and a censoring at one time as concordant if the failure's
    risk is higher, else half. Equal means the same number.

    Pairs are counted, not made. Risks are numbered; for each of the number's bits, rows that agree in all higher bits
    meet: those with a one pass over the later rows with a zero as a running sum over time. So a row takes part in
    as many sums as the number of risks has bits.
    """
    cells = df.groupBy(F.col(x).cast("double").alias("x"), F.col(risk).cast("double").alias("s")).agg(
        F.sum((F.col(c) == 0).cast("double")).alias("d"), F.sum((F.col(c) == 1).cast("double")).alias("q")).filter("x is not null and s is not null")
    risks = running(cells.groupBy("s").agg(F.lit(1.0).alias("one")), (), "s", {"k": total(F.col("one"))}).select("s", F.col("k").cast("long").alias("k"))
    most = risks.agg(F.max("k").alias("most"))  # a row
    ranked = cells.join(risks, "s").crossJoin(F.broadcast(most))
    # levels from 0 are bits; the others are all rows, rows of one risk, and rows of one time by their risk
    rows = F.expr("""concat(
        transform(sequence(0, cast(floor(log2(most)) as int)), b -> named_struct('level', b, 'grp', cast(shiftright(k, b + 1) as double), 'at', -x,
            'd', if(shiftright(k, b) & 1 = 1, d, 0D), 'n', if(shiftright(k, b) & 1 = 0, d + q, 0D), 'q', 0D)),
        array(named_struct('level', -1, 'grp', 0D, 'at', -x, 'd', d, 'n', d + q, 'q', q), named_struct('level', -2, 'grp', s, 'at', -x, 'd', d, 'n', d + q, 'q', 0D),
            named_struct('level', -3, 'grp', x, 'at', s, 'd', d, 'n', q, 'q', 0D)))""")
    spread = ranked.select(F.explode(rows).alias("r")).select("r.*")
    # a row per group and place, so that rows of one time never see each other
    spread = spread.groupBy("level", "grp", "at").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.sum("q").alias("q"))
    seen = running(spread, ("level", "grp"), "at", {"before": total(F.col("n"), before=True)})
    of = lambda where, v: F.coalesce(F.sum(F.when(F.expr(where), F.expr(v))), F.lit(0.0))
    one = seen.agg(of("level >= 0", "d * before").alias("right"), of("level = -1", "d * before").alias("later"), of("level = -1", "d * (d - 1) / 2").alias("deaths"),
                   of("level = -1", "d * q").alias("mixed"), of("level = -2", "d * before").alias("equal"), of("level = -2", "d * (d - 1) / 2").alias("twins"), of("level = -3", "d * before").alias("above"))
    comparable = F.expr("later + deaths + mixed")
    concordant = F.expr("right + twins + above")
    tied = F.expr("equal + deaths - twins + mixed - above")
    return one.select(comparable.alias("comparable"), concordant.alias("concordant"), tied.alias("tied"), F.try_divide(concordant + tied / 2, comparable).alias("c_index"))


def roc_at(df: DataFrame, x: str, c: str, risk: str, t: float, train: DataFrame | None = None) -> DataFrame:
    """(auc): cumulative cases, weighted by the inverse censoring curve, against dynamic controls at a horizon.

    Null without cases or controls. One running sum over distinct risks.
    """
    case, control = (F.col(x) <= t) & (F.col(c) == 0), F.col(x) > t
    cells = df.groupBy(F.col(x).cast("double").alias("x"), F.col(risk).cast("double").alias("s")).agg(F.sum(case.cast("double")).alias("case"), F.sum(control.cast("double")).alias("control"))
    curve = _with_g(_grid(df, x, c), train, x, c).select("x", F.when(F.col("g") > 0, 1 / F.col("g")).otherwise(0.0).alias("w"))
    by_risk = cells.join(curve, "x").groupBy("s").agg(F.sum(F.col("case") * F.col("w")).alias("case"), F.sum("control").alias("control"))
    ranked = running(by_risk, (), "s", {"below": total(F.col("control"), before=True)})
    return ranked.agg(F.try_divide(F.sum(F.col("case") * (F.col("below") + F.col("control") / 2)), F.sum("case") * F.sum("control")).alias("auc"))
