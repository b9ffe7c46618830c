import pytest
from pyspark.sql import functions as F

from tidewatch.functions import copulas
from tidewatch.operators import observations, recurrent, risk
from tidewatch.plans import fit, regression, renewal, tree
from tidewatch.sources import datasets
from tidewatch.streaming import risk_stream


def test_data_sets(spark):
    assert datasets.bearings(spark).count() == 23 and datasets.automotive(spark).count() == 31 and datasets.general_repair(spark).count() == 33
    assert datasets.circuits(spark).agg(F.sum("n")).first()[0] == 4156
    assert datasets.renewal_system(spark).agg(F.max("x")).first()[0] == 227
    assert datasets.steel(spark).count() == 10


def test_json_round_trip(spark, tmp_path):
    obs = observations.compress(observations.observations(datasets.automotive(spark), x="x", c="c"))
    datasets.write_observations(obs, str(tmp_path / "o"))
    again = datasets.read_observations(spark, str(tmp_path / "o"))
    columns = ["x", "x_hi", "c", "n", "tl", "tr"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, obs.select(columns).collect()))


def test_model_catalogue(spark, tmp_path):
    path = str(tmp_path / "models")
    datasets.save_model(spark, path, "a", "weibull", {"alpha": 2.0})
    assert datasets.load_model(spark, path, "a") == ("weibull", {"alpha": 2.0})
    with pytest.raises(KeyError):
        datasets.load_model(spark, path, "b")


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,c\n1.5,0\n2.5,1\n")
    assert datasets.read_csv(spark, str(tmp_path / "t.csv"), "x double, c int").collect() == datasets.read_csv(spark, str(tmp_path / "t.csv")).collect()


def test_stream_gives_the_batch_table(spark, tmp_path):
    obs = observations.observations(datasets.automotive(spark), x="x", c="c")
    for k in range(2):
        obs.filter(F.pmod(F.xxhash64("x"), F.lit(2)) == k).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = risk_stream.stream_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = risk_stream.risk_from_counts(spark.table("counts")).orderBy("x").collect()
    assert got == risk.simple_risk_table(obs).orderBy("x").collect()


def test_g1_renewal(spark):
    events = recurrent.recurrent_events(datasets.renewal_system(spark).withColumn("i", F.lit(1)), "i", "x")
    found = renewal.fit_renewal(events, "g1", "exponential")
    assert found["q"] == pytest.approx(0.232, abs=2e-3) and 2.718281828 ** found["log_scale"] == pytest.approx(4.781, abs=2e-2)


def test_homogeneous_intensity_matches_the_closed_form(spark):
    events = recurrent.recurrent_events(datasets.general_repair(spark), "i", "x", c="c")
    rate = recurrent.homogeneous_poisson(events).first().rate
    assert 2.718281828459045 ** renewal.fit_intensity(events, "homogeneous")["p0"] == pytest.approx(rate, rel=1e-4)


def test_exponential_regression_recovers_a_coefficient(spark):
    rows = spark.range(4000).select((-F.ln(1 - F.rand(3)) / F.exp(0.7 * (F.col("id") % 2)) * 10).alias("x"), F.lit(0).alias("c"), (F.col("id") % 2).cast("double").alias("z"))
    assert regression.fit_parametric(rows, "x", "c", ["z"], "ph", "exponential")["z"] == pytest.approx(0.7, abs=0.08)


def test_copula_fit_recovers_theta(spark):
    own = spark.range(4000).select(F.rand(1).alias("u"), F.rand(2).alias("w"))
    theta = 2.0  # conditional inversion of the Clayton copula
    own = own.withColumn("v", F.pow(F.pow("u", F.lit(-theta)) * (F.pow("w", F.lit(-theta / (1 + theta))) - 1) + 1, F.lit(-1 / theta)))
    assert copulas.fit_copula(own, "clayton", 0.1, 8.0) == pytest.approx(theta, abs=0.2)
    assert copulas.COPULAS["frank"].tau(copulas.COPULAS["frank"].from_tau(0.4)) == pytest.approx(0.4, abs=1e-3)


def test_tree_finds_the_split(spark):
    rows = spark.range(2000).select((F.rand(5) * 10).alias("a"), F.rand(6).alias("b"), F.lit(0).alias("c"), F.rand(7).alias("w"))
    rows = rows.withColumn("x", -F.ln(1 - F.col("w")) * F.when(F.col("a") <= 5, 1.0).otherwise(8.0))
    (node, feature, cut), *_ = tree.grow_tree(rows, "x", "c", ["a", "b"], depth=1)
    assert (node, feature) == (1, "a") and cut == pytest.approx(5, abs=0.5)


def test_mixture_and_defective_fits(spark):
    rows = spark.range(3000).select((F.pow(-F.ln(1 - F.rand(8)), F.lit(1 / 3)) * F.when(F.col("id") % 3 == 0, 2.0).otherwise(20.0)).alias("x"))
    found = fit.fit_mixture(observations.observations(rows, x="x"), 2)
    assert [round(w, 1) for w, _, _ in found] == [0.3, 0.7] and found[1][1] == pytest.approx(20, rel=0.05)
    cure = fit.fit_defective(observations.observations(datasets.circuits(spark), x="x", c="c", n="n"))
    assert cure.extra["p"] == pytest.approx(28 / 4156, rel=0.1)


def test_count_distributions_against_sums(spark):
    import math

    from tidewatch.functions.distributions import DISTRIBUTIONS as D

    df = spark.createDataFrame([(float(k), (k + 0.5) / 12) for k in range(1, 12)], "k double, u double")
    args = {"poisson": (4.0,), "binomial": (15.0, 0.3), "negative_binomial": (3.0, 0.4), "beta_geometric": (2.0, 3.0)}
    mass = {
        "poisson": lambda k: 4.0**k * math.exp(-4) / math.factorial(k), "binomial": lambda k: math.comb(15, k) * 0.3**k * 0.7 ** (15 - k),
        "negative_binomial": lambda k: math.comb(k + 1, k - 1) * 0.4**3 * 0.6 ** (k - 1) if k else 0.0,
        "beta_geometric": lambda k: math.gamma(3) * math.gamma(2 + k) / math.gamma(5 + k) * math.gamma(5) / (math.gamma(2) * math.gamma(3)) if k else 0.0,
    }
    rows = df.select("k", "u", *[D[n].sf(F.col("k"), *a).alias(n) for n, a in args.items()], *[D[n].qf(F.col("u"), *a).alias(f"q_{n}") for n, a in args.items()]).collect()
    for n, f in mass.items():
        cdf = {k: sum(f(j) for j in range(k + 1)) for k in range(60)}
        for r in rows:
            assert 1 - r[n] == pytest.approx(cdf[int(r.k)], abs=1e-9)
            assert r[f"q_{n}"] == min(k for k in cdf if cdf[k] >= r.u)
