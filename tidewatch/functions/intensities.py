"""Intensities of recurrent events as columns: expected count, rate and inverse, and event histories drawn from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.running import running, total

#: kind -> (parameters, cif, iif, inverse of cif)
KINDS = {
    "homogeneous": (("rate",), lambda x, r: r * x, lambda x, r: x * 0 + r, lambda y, r: y / r),
    "crow-amsaa": (("alpha", "beta"), lambda x, a, b: F.pow(x / a, F.lit(b)), lambda x, a, b: b / a * F.pow(x / a, F.lit(b - 1)), lambda y, a, b: a * F.pow(y, F.lit(1 / b))),
    "duane": (("alpha", "beta"), lambda x, a, b: b * F.pow(x, F.lit(a)), lambda x, a, b: a * b * F.pow(x, F.lit(a - 1)), lambda y, a, b: F.pow(y / b, F.lit(1 / a))),
    "cox-lewis": (("alpha", "beta"), lambda x, a, b: F.exp(F.lit(a)) / b * F.expm1(b * x), lambda x, a, b: F.exp(a + b * x), lambda y, a, b: F.log1p(y * b / F.exp(F.lit(a))) / b),
}


@dataclass(frozen=True)
class Intensity:
    """An intensity with parameters; with covariates, rates are multiplied by exp(zb)."""

    kind: str
    params: tuple[float, ...]
    names: tuple[str, ...] = ()
    beta: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS or len(self.params) != len(KINDS[self.kind][0]):
            raise ValueError(f"unknown intensity {self.kind} of {len(self.params)} parameters")

    def scale(self) -> Column:
        return F.exp(sum((F.lit(float(b)) * F.col(k) for b, k in zip(self.beta, self.names)), F.lit(0.0)))

    def cif(self, x: Column) -> Column:
        return self.scale() * KINDS[self.kind][1](x, *self.params) if self.names else KINDS[self.kind][1](x, *self.params)

    def iif(self, x: Column) -> Column:
        return self.scale() * KINDS[self.kind][2](x, *self.params) if self.names else KINDS[self.kind][2](x, *self.params)

    def inv_cif(self, y: Column) -> Column:
        return KINDS[self.kind][3](y / self.scale() if self.names else y, *self.params)


def simulate(spark: SparkSession, intensity: Intensity, items: int, events: int | None = None, until: float | None = None, seed: int = 1, most: int = 10_000) -> DataFrame:
    """(i, k, x, c): histories of items, each of a number of events or until a time, which is then a censored row.

    Expected counts at the events are running sums of exponential steps, made in Spark; inverses give the times.
    `most`: events that an item may have before `until`; ValueError where it isn't enough for the expected count.
    """
    if (events is None) == (until is None):
        raise ValueError("give either a number of events or a time")
    base = spark.range(items).withColumnRenamed("id", "i")
    if events is None:
        mean = base.limit(1).select(intensity.cif(F.lit(float(until)))).first()[0]
        events = int(mean + 12 * mean**0.5 + 24)
        if events > most:
            raise ValueError(f"{events} events an item are over the {most} allowed")
    steps = base.select("i", F.explode(F.sequence(F.lit(1), F.lit(events))).alias("k")).withColumn("e", -F.ln(1 - F.rand(seed)))
    w = Window.partitionBy("i").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one item's events
    out = steps.select("i", "k", intensity.inv_cif(F.sum("e").over(w)).alias("x")).withColumn("c", F.lit(0))
    if until is None:
        return out
    ends = base.select("i", F.lit(events + 1).alias("k"), F.lit(float(until)).alias("x"), F.lit(1).alias("c"))
    return out.filter(F.col("x") <= until).unionByName(ends)


def mean_count(history: DataFrame, items: int) -> DataFrame:
    """(x, mcf): the mean count of simulated histories."""
    grid = history.filter("c = 0").groupBy("x").agg(F.count("*").alias("k"))
    return running(grid, (), "x", {"n": total(F.col("k"))}).select("x", (F.col("n") / items).alias("mcf"))
