"""The admission gate: rows of time-to-event data in canonical form.

Canonical columns: x (time), x_hi (upper bound; equals x unless the row is interval-censored), c (-1 left-
censored, 0 event, 1 right-censored, 2 interval-censored), n (count), tl and tr (entry and exit of the
observation window; infinite where there is none), next to the grouping columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def _col(value: str | float | None, default: float | int) -> Column:
    if value is None:
        return F.lit(default)
    return F.col(value) if isinstance(value, str) else F.lit(value)


def observations(df: DataFrame, x: str | None = None, c: str | None = None, n: str | None = None, tl: str | float | None = None, tr: str | float | None = None,
                 xl: str | None = None, xr: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in canonical form: give either x, or xl and xr. Infinite bounds become one-sided censoring."""
    low = F.col(x if xl is None else xl).cast("double")
    high = F.col(x if xr is None else xr).cast("double")
    flag = F.col(c).cast("int") if c else F.when(low < high, 2).otherwise(0)
    flag = F.when(high == INF, 1).when(low == -INF, -1).otherwise(flag)
    return df.select(
        *by, F.when(low == -INF, high).otherwise(low).alias("x"), F.when(high == INF, low).otherwise(high).alias("x_hi"),
        flag.cast("int").alias("c"), F.coalesce(_col(n, 1), F.lit(1)).cast("double").alias("n"),
        F.coalesce(_col(tl, -INF).cast("double"), F.lit(-INF)).alias("tl"), F.coalesce(_col(tr, INF).cast("double"), F.lit(INF)).alias("tr"),
    )


#: Rule name -> condition that breaks it.
def _rules() -> dict[str, Column]:
    x, hi, c, n, tl, tr = (F.col(k) for k in ("x", "x_hi", "c", "n", "tl", "tr"))
    return {
        "time missing": x.isNull() | F.isnan(x) | hi.isNull() | F.isnan(hi),
        "interval reversed": x > hi,
        "censor flag unknown": ~c.isin(-1, 0, 1, 2),
        "interval needs flag 2": (x < hi) & (c != 2),
        "flag 2 needs an interval": (x == hi) & (c == 2),
        "count not positive": n <= 0,
        "window empty": tl >= tr,
        "time outside its window": (F.when(c == -1, tl).otherwise(x) < tl) | (F.when(c == 1, tl).otherwise(hi) > tr),
    }


def validate(obs: DataFrame) -> DataFrame:
    """The rows unchanged, or ValueError naming every broken rule: one pass of boolean aggregates."""
    rules = _rules()
    found = obs.agg(*[F.max(F.coalesce(cond, F.lit(False)).cast("int")).alias(name) for name, cond in rules.items()]).first()
    broken = [name for name in rules if found[name]]
    if broken:
        raise ValueError("; ".join(broken))
    return obs


def violations(obs: DataFrame) -> DataFrame:
    """Broken rules and their rows: rule, rows."""
    rules = _rules()
    counts = obs.agg(*[F.sum(F.coalesce(cond, F.lit(False)).cast("long")).alias(name) for name, cond in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(F.col(f"`{name}`"), F.lit(0)).cast("long").alias("rows")) for name in rules]))
    return counts.select(pairs.alias("p")).select("p.rule", "p.rows")


def compress(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal rows summed into one; the usual first step, aggregated before any shuffle."""
    return obs.groupBy(*by, "x", "x_hi", "c", "tl", "tr").agg(F.sum("n").alias("n"))


def expand(obs: DataFrame, flag: int | None = None) -> DataFrame:
    """One row per counted observation, of one censor flag or of all."""
    own = obs if flag is None else obs.filter(F.col("c") == flag)
    return own.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("__k").withColumn("n", F.lit(1.0))


def from_lists(spark, failures=(), suspensions=(), left=(), intervals=()) -> DataFrame:
    """Canonical rows of lists of failures, suspensions, left-censored times and intervals."""
    rows = [(float(v), float(v), 0) for v in failures] + [(float(v), float(v), 1) for v in suspensions]
    rows += [(float(v), float(v), -1) for v in left] + [(float(a), float(b), 2) for a, b in intervals]
    df = spark.createDataFrame(rows, "x double, x_hi double, c int")
    return compress(df.withColumns({"n": F.lit(1.0), "tl": F.lit(-INF), "tr": F.lit(INF)}))


def round_significant(value: Column, digits: int = 2) -> Column:
    """The value to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, 0.0).otherwise(F.round(value * scale) / scale)


def _broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule, in one pass; a condition that is null breaks nothing."""
    counts = df.agg(*[F.sum(F.coalesce(cond, F.lit(False)).cast("long")).alias(f"k{j}") for j, cond in enumerate(rules.values())])
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(f"k{j}", F.lit(0)).cast("long").alias("rows")) for j, name in enumerate(rules)]))
    return counts.select(pairs.alias("p")).select("p.rule", "p.rows")


def _required(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    broken = [r.rule for r in _broken(df, rules).collect() if r.rows]  # a row per rule
    if broken:
        raise ValueError("; ".join(broken))
    return df


def _risk_rules() -> dict[str, Column]:
    r, d = F.col("r"), F.col("d")
    return {
        "value missing": F.col("x").isNull() | r.isNull() | d.isNull(), "nobody at risk": r <= 0, "events negative": d < 0,
        "more events than at risk": d > r, "not whole numbers": (r != F.floor(r)) | (d != F.floor(d)),
    }


def risk_violations(risk: DataFrame) -> DataFrame:
    """Broken rules of a given risk table (x, r, d) and their rows."""
    return _broken(risk, _risk_rules())


def validate_risk(risk: DataFrame) -> DataFrame:
    """The risk table unchanged, or ValueError naming every broken rule."""
    return _required(risk, _risk_rules())


def validate_competing(df: DataFrame, x: str, cause: str, c: str | None = None, n: str | None = None) -> DataFrame:
    """Rows of competing risks unchanged: times are there, a flagged event has a cause and a censored row none, counts are positive."""
    rules = {"time missing": F.col(x).isNull() | F.isnan(F.col(x).cast("double"))}
    if c:
        rules |= {"censor flag unknown": ~F.col(c).isin(0, 1), "event without cause": (F.col(c) == 0) & F.col(cause).isNull(), "censored with a cause": (F.col(c) == 1) & F.col(cause).isNotNull()}
    if n:
        rules["count not positive"] = F.col(n) <= 0
    return _required(df, rules)


def validate_regression(df: DataFrame, x: str, c: str, z: list[str], n: str | None = None, tl: str | None = None) -> DataFrame:
    """Rows of a regression unchanged: flags 0 and 1, positive counts, covariates that are numbers and vary, entries before times."""
    rules = {"time missing": F.col(x).isNull(), "censor flag unknown": ~F.col(c).isin(0, 1)}
    rules |= {f"{k} is not a number": F.isnan(F.col(k).cast("double")) | (F.abs(F.col(k)) == INF) for k in z}
    if n:
        rules["count not positive"] = F.col(n) <= 0
    if tl:
        rules["entry not before the time"] = F.col(tl) >= F.col(x)
    _required(df, rules)
    row = df.agg(*[F.min(k).alias(f"a{j}") for j, k in enumerate(z)], *[F.max(k).alias(f"b{j}") for j, k in enumerate(z)]).first()
    constant = [k for j, k in enumerate(z) if row[f"a{j}"] == row[f"b{j}"]]
    if constant:
        raise ValueError(f"constant covariates: {', '.join(constant)}")
    return df


def validate_episodes(df: DataFrame, unit: str, xl: str, xr: str) -> DataFrame:
    """Episodes (xl, xr] unchanged: none is empty, and a unit's don't overlap."""
    from pyspark.sql import Window

    before = F.max(xr).over(Window.partitionBy(unit).orderBy(xl, xr).rowsBetween(Window.unboundedPreceding, -1))
    _required(df.withColumn("__before", before), {"episode empty": F.col(xl) >= F.col(xr), "episodes overlap": F.col("__before") > F.col(xl)})
    return df


def by_type(obs: DataFrame) -> dict[str, DataFrame]:
    """The rows of each kind: observed, right, left, interval, and truncated (any of these in a window)."""
    kinds = {"observed": F.col("c") == 0, "right": F.col("c") == 1, "left": F.col("c") == -1, "interval": F.col("c") == 2, "truncated": (F.col("tl") > -INF) | (F.col("tr") < INF)}
    return {k: obs.filter(cond) for k, cond in kinds.items()}
