"""Survival trees and forests grown level by level: one aggregation finds the splits of all leaves of all trees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidate thresholds per feature.
CANDIDATES = 16


def _nodes(rules: list[tuple]) -> Column:
    """The leaf of each row: rules are (node, feature, threshold) in the order they were made."""
    node = F.lit(1)
    for at, feature, cut in rules:
        node = F.when(node == at, F.when(F.col(feature) <= cut, 2 * at).otherwise(2 * at + 1)).otherwise(node)
    return node


def split_gains(df: DataFrame, node: Column, x: str, c: str, features: dict[str, list[float]], weight: Column | None = None) -> DataFrame:
    """(node, feature, cut, gain, n_left, n_right, d_left, d_right): exponential deviance gain of every candidate split.

    Each row meets each candidate through one array of structs; sums of events and exposure per side follow from
    one aggregation, so all leaves and candidates cost one pass.
    """
    w = weight if weight is not None else F.lit(1.0)
    tests = [F.struct(F.lit(f).alias("feature"), F.lit(float(t)).alias("cut"), (F.col(f) <= t).alias("left")) for f, ts in features.items() for t in ts]
    own = df.select(node.alias("node"), F.col(x).cast("double").alias("x"), (F.col(c) == 0).cast("double").alias("d"), w.alias("w"), F.explode(F.array(*tests)).alias("s"))
    side = own.groupBy("node", "s.feature", "s.cut").agg(*[
        F.sum(F.when(F.col("s.left") == v, F.col("w") * F.col(k)).otherwise(0.0)).alias(f"{k}_{name}") for v, name in ((True, "left"), (False, "right")) for k in ("d", "x")], *[
        F.sum(F.when(F.col("s.left") == v, F.col("w")).otherwise(0.0)).alias(f"n_{name}") for v, name in ((True, "left"), (False, "right"))])
    ll = lambda d, t: F.when((d > 0) & (t > 0), d * F.ln(d / t)).otherwise(0.0)
    gain = ll(F.col("d_left"), F.col("x_left")) + ll(F.col("d_right"), F.col("x_right")) - ll(F.col("d_left") + F.col("d_right"), F.col("x_left") + F.col("x_right"))
    return side.select("node", "feature", "cut", gain.alias("gain"), "n_left", "n_right", "d_left", "d_right")


def candidates(df: DataFrame, features: list[str], k: int = CANDIDATES) -> dict[str, list[float]]:
    """Thresholds at quantiles of each feature."""
    cuts = [i / (k + 1) for i in range(1, k + 1)]
    row = df.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in features]).first()
    return {f: sorted(set(map(float, row[f] or []))) for f in features}


def grow_tree(df: DataFrame, x: str, c: str, features: list[str], depth: int = 3, least: float = 5, least_failures: float = 2, weight: Column | None = None, among: dict[int, list[str]] | None = None) -> list[tuple]:
    """Rules (node, feature, threshold). A level is one job; the driver sees one best split per leaf."""
    cuts = candidates(df, features)
    rules: list[tuple] = []
    for level in range(depth):
        gains = split_gains(df, _nodes(rules), x, c, cuts, weight).filter(
            (F.col("n_left") >= least) & (F.col("n_right") >= least) & (F.col("d_left") >= least_failures) & (F.col("d_right") >= least_failures) & (F.col("gain") > 1e-6))
        w = Window.partitionBy("node").orderBy(F.desc("gain"), "feature", "cut")
        best = gains.withColumn("k", F.row_number().over(w)).filter(f"k = 1 and node >= {2**level}").orderBy("node").collect()
        if not best:
            break
        rules += [(r.node, r.feature, r.cut) for r in best]
    return rules


def leaf_rates(df: DataFrame, rules: list[tuple], x: str, c: str) -> DataFrame:
    """(node, n, d, exposure, rate): the exponential model of each leaf."""
    own = df.withColumn("node", _nodes(rules))
    return own.groupBy("node").agg(F.count("*").alias("n"), F.sum((F.col(c) == 0).cast("double")).alias("d"), F.sum(F.col(x).cast("double")).alias("exposure")).withColumn("rate", F.try_divide("d", "exposure"))


def grow_forest(df: DataFrame, x: str, c: str, features: list[str], trees: int = 10, depth: int = 3, seed: int = 1) -> list[tuple[list[tuple], dict[int, float]]]:
    """Trees on Poisson bootstrap weights and random halves of the features, with their leaves' rates."""
    import random

    rng, out = random.Random(seed), []
    for k in range(trees):
        u = F.rand(seed + k)
        weight = sum((F.when(u > sum(math.exp(-1) / math.factorial(j) for j in range(m)), 1.0).otherwise(0.0) for m in range(1, 6)), F.lit(0.0))
        own = df.withColumn("__w", weight).filter("__w > 0")
        picked = rng.sample(features, max(1, round(math.sqrt(len(features)))))
        rules = grow_tree(own, x, c, picked, depth, weight=F.col("__w"))
        out.append((rules, {r.node: r.rate or 0.0 for r in leaf_rates(own, rules, x, c).collect()}))
    return out


def forest_survival(forest: list[tuple[list[tuple], dict[int, float]]], t: Column) -> Column:
    """Mean survival at t over the trees, as a column of the features."""
    parts = []
    for rules, rates in forest:
        node, rate = _nodes(rules), F.lit(0.0)
        for leaf, r in rates.items():
            rate = F.when(node == leaf, r).otherwise(rate)
        parts.append(F.exp(-rate * t))
    return sum(parts, F.lit(0.0)) / len(parts)


def logrank_gains(df: DataFrame, x: str, c: str, features: dict[str, list[float]], node: Column | None = None, least: float = 1, least_failures: float = 0) -> DataFrame:
    """(node, feature, cut, z, n_left, n_right): the log-rank statistic of every candidate split, without sign.

    Rows are summed by time and side of each candidate first; numbers at risk are running sums from the right.
    """
    from tidewatch.operators.running import running, total

    tests = [F.struct(F.lit(f).alias("feature"), F.lit(float(t)).alias("cut"), (F.col(f) <= t).alias("left")) for f, ts in features.items() for t in ts]
    own = df.select((node if node is not None else F.lit(1)).alias("node"), F.col(x).cast("double").alias("x"), (F.col(c) == 0).cast("double").alias("d"), F.explode(F.array(*tests)).alias("s"))
    keys = ("node", "feature", "cut")
    on_left = lambda v: F.sum(F.when(F.col("s.left"), v).otherwise(0.0))
    grid = own.groupBy("node", F.col("s.feature").alias("feature"), F.col("s.cut").alias("cut"), "x").agg(
        F.sum("d").alias("d"), F.count("*").cast("double").alias("n"), on_left(F.col("d")).alias("dl"), on_left(F.lit(1.0)).alias("nl"))
    grid = running(grid, keys, "x", {"r": total(F.col("n")), "rl": total(F.col("nl"))}, descending=True)
    d, r, rl = F.col("d"), F.col("r"), F.col("rl")
    spread = F.when(r > 1, d * (rl / r) * (1 - rl / r) * (r - d) / (r - 1)).otherwise(0.0)
    sums = grid.groupBy(*keys).agg(F.sum(F.col("dl") - d * rl / r).alias("u"), F.sum(spread).alias("v"), F.sum("nl").alias("n_left"), F.sum(F.col("n") - F.col("nl")).alias("n_right"),
                                   F.sum("dl").alias("d_left"), F.sum(d - F.col("dl")).alias("d_right"))
    enough = (F.least("n_left", "n_right") >= least) & (F.least("d_left", "d_right") >= least_failures)
    return sums.filter(enough & (F.col("v") > 0)).select(*keys, F.abs(F.col("u") / F.sqrt("v")).alias("z"), "n_left", "n_right")


def features_tried(rule: int | float | str, n: int) -> int:
    """How many of n features a split tries: a number, a share, sqrt, log2 or all."""
    if rule == "all":
        return n
    if rule in ("sqrt", "log2"):
        return max(1, int(math.sqrt(n) if rule == "sqrt" else math.log2(n)))
    if isinstance(rule, bool) or not isinstance(rule, (int, float)):
        raise ValueError(f"unknown rule {rule!r}")
    k = rule if isinstance(rule, int) else int(rule * n)
    if not 1 <= k <= n:
        raise ValueError(f"{rule!r} of {n} features")
    return k
