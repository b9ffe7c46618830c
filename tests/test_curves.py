import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import comparison, curves, observations, recurrent, risk, running

# Small samples (times, flags, counts, entries); expected values below come from the estimators' definitions.
G1 = ([3, 5, 5, 8, 12, 12, 12, 20, 25, 30], [0] * 10, [2, 1, 3, 2, 1, 4, 2, 1, 5, 1], None)
G2 = ([4, 7, 9, 13, 16, 21, 28, 33, 41, 50], [0, 0, 1, 0, 0, 1, 0, 1, 0, 0], [1, 2, 1, 3, 1, 2, 1, 1, 4, 1], None)
G3 = ([6, 9, 14, 18, 22, 27, 33, 40, 48, 55], [0, 1, 0, 0, 1, 0, 0, 1, 0, 0], [1, 1, 2, 1, 1, 3, 1, 1, 2, 1], [0, 2, 5, 5, 10, 12, 0, 20, 25, 30])


def rows(spark, x, c, n, tl=None):
    df = spark.createDataFrame([(float(a), b, d, float(e)) for a, b, d, e in zip(x, c, n, tl or [0] * len(x))], "t double, k int, m int, e double")
    return observations.observations(df, x="t", c="k", n="m", tl="e" if tl else None)


def at(spark, obs, probes, column, before):
    curve = curves.survival_curves(risk.risk_table(obs))
    out = curves.at(curve, spark.createDataFrame([(float(p),) for p in probes], "t double"), {column: before})
    return [r[column] for r in out.orderBy("t").collect()]


@pytest.mark.parametrize("data, probes, want", [
    (G1, [1, 4, 5, 6, 12, 19, 25, 31], [1, .909090909091, .727272727273, .727272727273, .318181818182, .318181818182, .045454545455, 0]),
    (G2, [2, 7, 10, 16, 28, 41, 55], [1, .823529411765, .823529411765, .570135746606, .488687782805, .097737556561, 0]),
    (G3, [3, 9, 18, 27, 40, 55, 60], [1, .833333333333, .520833333333, .297619047619, .238095238095, 0, 0]),
])
def test_kaplan_meier(spark, data, probes, want):
    assert at(spark, rows(spark, *data), probes, "km", 1.0) == pytest.approx(want, abs=1e-9)


def test_nelson_aalen(spark):
    assert at(spark, rows(spark, *G1), [1, 4, 5, 6, 12, 19, 25, 31], "na_h", 0.0) == pytest.approx(
        [0, .090909090909, .290909090909, .290909090909, .915909090909, .915909090909, 1.892099567100, 2.892099567100], abs=1e-9)
    assert at(spark, rows(spark, *G2), [2, 7, 10, 16, 28, 41, 55], "na_h", 0.0) == pytest.approx(
        [0, .183823529412, .183823529412, .514592760181, .657449903038, 1.457449903038, 2.457449903038], abs=1e-9)


def test_tie_ladder(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 0.5), (3.0, 5.0, 2.0)], "x double, r double, d double")
    h = [r.h for r in df.select("x", curves._ladder(1).alias("h")).orderBy("x").collect()]
    assert h == pytest.approx([0.2, 0.1, 1 / 5 + 1 / 4])


def test_recurrent_risk_table_with_entry(spark):
    df = spark.createDataFrame([(2.0, 1, 0, 0.0), (5.0, 1, 0, 0.0), (10.0, 1, 1, 0.0), (6.0, 2, 0, 4.0), (8.0, 2, 0, 4.0), (12.0, 2, 1, 4.0)], "t double, item int, k int, e double")
    out = risk.recurrent_risk_table(recurrent.recurrent_events(df, "item", "t", c="k", tl="e")).orderBy("x").collect()
    assert [(r.x, r.r, r.d) for r in out] == [(2, 1, 1), (5, 2, 1), (6, 2, 1), (8, 2, 1), (10, 2, 0), (12, 1, 0)]


def test_logrank(spark):
    one = list(zip([9, 13, 13, 18, 23, 28, 31, 34, 45, 48, 161], [0, 0, 1, 0, 0, 1, 0, 0, 1, 0, 1]))
    two = list(zip([5, 5, 8, 8, 12, 16, 23, 27, 30, 33, 43, 45], [0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0]))
    df = spark.createDataFrame([(float(x), c, g) for g, rows_ in (("a", one), ("b", two)) for x, c in rows_], "t double, k int, g string")
    table = risk.simple_risk_table(observations.observations(df, x="t", c="k", by=("g",)), ("g",))
    stat, dof, p = comparison.logrank(table, "g")
    assert (stat, dof, p) == pytest.approx((3.3964, 1, 0.0653), abs=1e-3)
    for weighting in ("gehan", "tarone-ware", "fleming-harrington"):
        assert comparison.logrank(table, "g", weighting=weighting, rho=1.0)[0] > 0


def test_laplace(spark):
    x = [10, 19, 27, 34, 40, 45, 49, 52, 54]
    df = spark.createDataFrame([(float(v), 0) for v in x] + [(60.0, 1)], "t double, k int").withColumn("item", F.lit(1))
    out = recurrent.trend_tests(recurrent.recurrent_events(df, "item", "t", c="k")).first()
    assert out.laplace == pytest.approx((sum(x) - 9 * 30) / (60 * math.sqrt(9 / 12)))
    assert out.mil_hdbk == pytest.approx(2 * sum(math.log(60 / v) for v in x))


@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("descending", [False, True])
def test_running_values_over_parts(spark, by, descending):
    """Against loops, over times of all sizes and signs, null groups, ties and rows without a value."""
    rng = random.Random(3)
    times_ = [0.0, -0.0, 1e-300, 1e300, -1e300, float("inf"), float("-inf")] + [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 9) for _ in range(300)]
    rows_ = [(rng.choice([None, "a", "b"]), t, k, rng.choice([None, rng.uniform(0.5, 1.5)])) for t in times_ for k in (0, 1)]
    df = spark.createDataFrame(rows_, "g string, t double, k int, v double").repartition(5)
    runs = {"s": running.total(F.col("v")), "sb": running.total(F.col("v"), before=True), "p": running.times(F.col("v")), "m": running.Run("max", F.col("v")), "l": running.latest(F.col("v")), "lb": running.latest(F.col("v"), before=True)}
    got = {(r.g, r.t, r.k): r for r in running.running(df, by, "t", runs, descending, ties=("k",)).collect()}
    assert len(got) == len({(g, t, k) for g, t, k, _ in rows_}) or 0.0 in times_
    for group in ([None, "a", "b"] if by else ["all"]):
        own = sorted([r for r in rows_ if group == "all" or r[0] == group], key=lambda r: (-r[1], -r[2]) if descending else (r[1], r[2]))
        own = [r for r in own if r[1] != 0]  # 0 and -0 are one time in no given order
        s, p, m, last = sum(r[3] or 0 for r in rows_ if r[1] == 0 and group in ("all", r[0])), 1.0, None, None
        zero = [r[3] for r in rows_ if r[1] == 0 and group in ("all", r[0]) and r[3] is not None]
        passed = False
        s = 0.0
        for g, t, k, v in own:
            if not passed and (t < 0 if descending else t > 0):
                passed = True
                s += sum(zero)
                p *= math.prod(zero)
                m = max([x for x in [m, *zero] if x is not None], default=None)
                last = "zero" if zero else last
            r = got[g, t, k]
            assert r.sb == pytest.approx(s, rel=1e-12) and (last == "zero" or r.lb == last)
            s, p, m, last = s + (v or 0), p * (v if v is not None else 1), v if m is None else max(m, v if v is not None else m), v if v is not None else last
            assert r.s == pytest.approx(s, rel=1e-12) and r.p == pytest.approx(p, rel=1e-9) and r.m == m and (last == "zero" or r.l == last)


def test_no_task_holds_all_times(spark):
    """With one group and thousands of distinct times, only the parts' totals may meet in one partition."""
    obs = observations.observations(spark.range(5000).withColumns({"t": F.col("id") + 1.0, "k": F.lit(0)}), x="t", c="k")
    curve = curves.survival_curves(risk.risk_table(obs))
    assert curve.count() == 5000
    assert obs.select(running.part("x").alias("p")).distinct().count() > 100
    assert running.running(obs, (), "x", {"s": running.total(F.lit(1.0))}).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 4000


def test_ladder_of_ties(spark):
    """The digamma forms against the sums they stand for."""
    cases = [(r, d) for r in (1.0, 2.0, 5.0, 40.0, 1000.0, 250_000.0) for d in (1.0, 2.0, 2.5, 5.0, 7.25, 300.0) if d <= r]
    df = spark.createDataFrame(cases, "r double, d double").select("r", "d", curves._ladder(1).alias("a"), curves._ladder(2).alias("b"))
    for row in df.collect():
        for power, value in ((1, row.a), (2, row.b)):
            want = sum(min(1.0, row.d - k) / (row.r - k) ** power for k in range(math.ceil(row.d)))
            assert value == pytest.approx(want, rel=1e-9, abs=1e-13)


def test_round_trip_of_a_risk_table(spark):
    table = risk.simple_risk_table(rows(spark, *G2))
    again = risk.simple_risk_table(risk.to_observations(table)).filter("d > 0 or r > 0")
    assert again.orderBy("x").collect() == table.orderBy("x").collect()


def test_validation_names_rules(spark):
    df = spark.createDataFrame([(1.0, 0, 1), (2.0, 5, 1), (3.0, 0, -1)], "t double, k int, m int")
    with pytest.raises(ValueError, match="censor flag unknown; count not positive"):
        observations.validate(observations.observations(df, x="t", c="k", n="m"))


def test_infinite_bounds_become_censoring(spark):
    df = spark.createDataFrame([(1.0, float("inf")), (float("-inf"), 2.0), (3.0, 4.0), (5.0, 5.0)], "a double, b double")
    assert [r.c for r in observations.observations(df, xl="a", xr="b").collect()] == [1, -1, 2, 0]


def test_empty(spark):
    obs = observations.observations(spark.createDataFrame([], "t double, k int"), x="t", c="k")
    assert curves.survival_curves(risk.risk_table(obs)).count() == 0


def test_plotting_positions_match_sequential_ranks(spark):
    x, c = [5, 8, 8, 12, 20, 25], [0, 1, 0, 0, 1, 0]
    got = curves.plotting_positions(rows(spark, x, c, [1] * 6), "Blom").orderBy("x").collect()
    n, rank, want = 6, 0.0, {}
    for i, (t, k) in enumerate(sorted(zip(x, c), key=lambda v: (v[0], v[1]))):
        if k == 0:
            rank += (n + 1 - rank) / (1 + n - i)
        want[t] = rank
    assert [r["rank"] for r in got] == pytest.approx([want[t] for t in sorted(want)])
