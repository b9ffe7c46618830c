"""Registered queries of the engine's own operators, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import copulas
from tidewatch.functions.distributions import DISTRIBUTIONS, STRESS, limited_failure, mixture, parallel, series
from tidewatch.operators import comparison, competing, curves, degradation, metrics, observations, recurrent, risk
from tidewatch.plans import fit, regression, renewal, tree, turnbull
from tidewatch.sources import datasets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipment, by return flag; open lines are censored; a line enters after its number of days."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber", "l_quantity", "l_discount")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    days = F.datediff("l_shipdate", "o_orderdate").cast("double")
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).withColumn("x", days).filter("x >= 0")
    return both.select(F.col("l_returnflag").alias("g"), "x", F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("c"),
                       F.col("l_linenumber").cast("double").alias("entry"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"), F.col("o_orderpriority").alias("prio"))


_OBS = """obs AS (SELECT l_returnflag AS g, CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) AS x,
  CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS c, CAST(l_linenumber AS DOUBLE) AS entry, l_quantity AS q, l_discount AS disc, o_orderpriority AS prio
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) >= 0)"""
_RISK = f"""{_OBS}, a AS (SELECT g, x, CAST(SUM(1-c) AS DOUBLE) AS d, CAST(COUNT(*) AS DOUBLE) AS o FROM obs GROUP BY g, x),
risk AS (SELECT g, x, SUM(o) OVER (PARTITION BY g ORDER BY x DESC) AS r, d FROM a)"""
_CURVE = f"""{_RISK}, curve AS (SELECT g, x, r, d, PRODUCT(1 - d / r) OVER w AS km, SUM(d / r) OVER w AS na_h,
  SUM(CASE WHEN d > 0 THEN list_sum(list_transform(range(0, CAST(d AS BIGINT)), lambda k: 1.0::DOUBLE / (r - k))) ELSE 0 END) OVER w AS fh_h,
  CASE WHEN MAX(CASE WHEN r <= d THEN 1 ELSE 0 END) OVER w = 0 THEN SUM(CASE WHEN r > d THEN d / (r * (r - d)) END) OVER w END AS greenwood,
  SUM(d / (r * r)) OVER w AS na_var
  FROM risk WINDOW w AS (PARTITION BY g ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _obs(spark: SparkSession, sf_dir: str, tl: str | None = None) -> DataFrame:
    return observations.observations(shipments(spark, sf_dir), x="x", c="c", tl=tl, by=("g",))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.survival_curves(risk.simple_risk_table(_obs(spark, sf_dir), ("g",)), ("g",))


@_query(f"WITH {_OBS} SELECT g, x, x AS x_hi, c, CAST(COUNT(*) AS DOUBLE) AS n FROM obs GROUP BY g, x, c")
def compress(spark, sf_dir):
    return observations.compress(_obs(spark, sf_dir), ("g",)).select("g", "x", "x_hi", "c", "n")


@_query("""WITH o AS (SELECT CAST(l_linenumber AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS h, CAST(CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END AS INT) AS c FROM lineitem)
SELECT 'time missing' AS rule, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'interval reversed', COUNT(*) FILTER (WHERE x > h) FROM o
UNION ALL SELECT 'censor flag unknown', 0 UNION ALL SELECT 'interval needs flag 2', COUNT(*) FILTER (WHERE x < h AND c <> 2) FROM o
UNION ALL SELECT 'flag 2 needs an interval', COUNT(*) FILTER (WHERE x = h AND c = 2) FROM o
UNION ALL SELECT 'count not positive', 0 UNION ALL SELECT 'window empty', 0 UNION ALL SELECT 'time outside its window', 0""")
def validate(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").withColumn("flag", F.when(F.col("l_linestatus") == "F", 2).otherwise(0))
    return observations.violations(observations.observations(rows, xl="l_linenumber", xr="l_quantity", c="flag"))


@_query(f"WITH {_RISK} SELECT g, x, r, d FROM risk")
def risk_table(spark, sf_dir):
    return risk.risk_table(_obs(spark, sf_dir), ("g",))


@_query("""WITH o AS (SELECT o_totalprice AS x, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS d FROM orders), a AS (SELECT x, CAST(SUM(d) AS DOUBLE) AS d, CAST(COUNT(*) AS DOUBLE) AS o FROM o GROUP BY x)
SELECT x, SUM(o) OVER (ORDER BY x DESC) AS r, d FROM a""")
def risk_table_of_prices(spark, sf_dir):
    """Nearly as many distinct values as rows, in one group."""
    own = _read(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("c"))
    return risk.risk_table(observations.observations(own, x="x", c="c"))


@_query(f"""WITH {_OBS}, e AS (SELECT * FROM obs WHERE entry <= x),
t AS (SELECT g, x, CAST(SUM(1-c) AS DOUBLE) AS d FROM e GROUP BY g, x),
i AS (SELECT g, x, SUM(m) OVER (PARTITION BY g ORDER BY x, k) AS r, k FROM (
  SELECT g, x, k, CAST(SUM(m) AS DOUBLE) AS m FROM (
    SELECT g, entry AS x, 0 AS k, 1 AS m FROM e UNION ALL SELECT g, x, 1, 0 FROM e UNION ALL SELECT g, x, 2, -1 FROM e) GROUP BY g, x, k))
SELECT g, x, i.r, d FROM t JOIN i USING (g, x) WHERE k = 1""")
def risk_table_delayed_entry(spark, sf_dir):
    own = observations.observations(shipments(spark, sf_dir).filter("entry <= x"), x="x", c="c", tl="entry", by=("g",))
    return risk.risk_table(own, ("g",))


@_query(f"""WITH {_RISK}, s AS (SELECT g, x, r, d, ABS(r - LEAD(r, 1, 0) OVER (PARTITION BY g ORDER BY x)) - d AS s FROM risk)
SELECT g, x, CAST(0 AS INT) AS c, d AS n FROM s WHERE d > 0 UNION ALL SELECT g, x, 1, s FROM s WHERE s > 0""")
def risk_to_observations(spark, sf_dir):
    return risk.to_observations(risk.simple_risk_table(_obs(spark, sf_dir), ("g",)), ("g",)).select("g", "x", "c", "n")


@_query(f"WITH {_CURVE} SELECT g, x, r, d, ROUND(km, 7) AS km, ROUND(EXP(-na_h), 7) AS na, ROUND(EXP(-fh_h), 7) AS fh, ROUND(greenwood, 8) AS greenwood, ROUND(na_var, 8) AS na_var FROM curve")
def survival_curves(spark, sf_dir):
    c = _curve(spark, sf_dir)
    return c.select("g", "x", "r", "d", *[F.round(k, 7).alias(k) for k in ("km", "na", "fh")], F.round("greenwood", 8).alias("greenwood"), F.round("na_var", 8).alias("na_var"))


@_query(f"""WITH {_CURVE}, l AS (SELECT g, x, km, CASE WHEN km = 1 THEN 1 WHEN km > 0 AND greenwood IS NOT NULL THEN EXP(-EXP(LN(-LN(km)) - 1.959963984540054 * SQRT(greenwood) / LN(km))) END AS lo,
 CASE WHEN km = 1 THEN 1 WHEN km > 0 AND greenwood IS NOT NULL THEN EXP(-EXP(LN(-LN(km)) + 1.959963984540054 * SQRT(greenwood) / LN(km))) END AS hi FROM curve)
SELECT g, x, ROUND(COALESCE(lo, 0), 6) AS lower, ROUND(COALESCE(hi, MIN(hi) OVER (PARTITION BY g)), 6) AS upper FROM l""")
def confidence_limits(spark, sf_dir):
    return curves.confidence_limits(_curve(spark, sf_dir), by=("g",)).select("g", "x", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@_query(f"""WITH {_CURVE}, p AS (SELECT DISTINCT g, CAST(t AS DOUBLE) AS t FROM obs, (SELECT UNNEST([-1, 0, 10, 45, 400]) AS t))
SELECT p.g, p.t, ROUND(COALESCE(curve.km, 1), 7) AS km, ROUND(COALESCE(curve.na_h, 0), 7) AS na_h FROM p ASOF LEFT JOIN curve ON p.g = curve.g AND p.t >= curve.x""")
def curve_at_times(spark, sf_dir):
    c = _curve(spark, sf_dir)
    probes = c.select("g").distinct().withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in (-1, 0, 10, 45, 400)])))
    return curves.at(c, probes, {"km": 1.0, "na_h": 0.0}, ("g",)).select("g", "t", F.round("km", 7).alias("km"), F.round("na_h", 7).alias("na_h"))


@_query(f"WITH {_CURVE} SELECT g, CAST(p AS DOUBLE) AS p, MIN(CASE WHEN 1 - km >= p - 1e-12 THEN x END) AS q FROM curve, (SELECT UNNEST([0.1, 0.25, 0.5, 0.9]) AS p) GROUP BY g, p")
def curve_quantiles(spark, sf_dir):
    return curves.quantiles(_curve(spark, sf_dir), [0.1, 0.25, 0.5, 0.9], by=("g",))


@_query(f"""WITH {_CURVE}, s AS (SELECT g, x, r, d, km * GREATEST(0, LEAST(60.0::DOUBLE, LEAD(x, 1, 60.0::DOUBLE) OVER (PARTITION BY g ORDER BY x)) - x) AS a,
  CASE WHEN ROW_NUMBER() OVER (PARTITION BY g ORDER BY x) = 1 THEN LEAST(60.0::DOUBLE, x) ELSE 0 END AS f FROM curve),
l AS (SELECT *, SUM(a) OVER (PARTITION BY g ORDER BY x DESC) AS later FROM s)
SELECT g, ROUND(SUM(a + f), 6) AS rmst, ROUND(SUM(later * later * CASE WHEN r > d AND x <= 60 THEN d / (r * (r - d)) ELSE 0 END), 6) AS variance FROM l GROUP BY g""")
def restricted_mean(spark, sf_dir):
    return curves.restricted_mean(_curve(spark, sf_dir), 60.0, by=("g",)).select("g", F.round("rmst", 6).alias("rmst"), F.round("variance", 6).alias("variance"))


@_query(f"""WITH {_CURVE}, p AS (SELECT DISTINCT g, CAST(t AS DOUBLE) AS t FROM obs, (SELECT UNNEST([5, 20, 60]) AS t))
SELECT p.g, p.t, ROUND(COALESCE(SUM(CASE WHEN ABS((t - x) / 7) <= 1 THEN 0.75 * (1 - ((t - x) / 7) * ((t - x) / 7)) / 7 * d / r ELSE 0 END), 0), 7) AS hf FROM p LEFT JOIN curve ON p.g = curve.g AND d > 0 GROUP BY p.g, p.t""")
def smoothed_hazard(spark, sf_dir):
    c = _curve(spark, sf_dir)
    probes = c.select("g").distinct().withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in (5, 20, 60)])))
    return curves.smoothed_hazard(c, probes, 7.0, ("g",)).select("g", "t", F.round("hf", 7).alias("hf"))


@_query(f"""WITH {_RISK}, k AS (SELECT g, x, r, d, MAX(r) OVER (PARTITION BY g) AS n, PRODUCT((r + 1 - d) / (r + 1)) OVER (PARTITION BY g ORDER BY x) AS p FROM risk)
SELECT g, x, r, d, ROUND((n + 1) * (1 - p), 5) AS rank, ROUND(CASE WHEN (n + 1) * (1 - p) > 0 THEN ((n + 1) * (1 - p) - 0.375) / (n + 0.25) ELSE 0 END, 7) AS f FROM k""")
def plotting_positions(spark, sf_dir):
    return curves.plotting_positions(_obs(spark, sf_dir), "Blom", ("g",)).select("g", "x", "r", "d", F.round("rank", 5).alias("rank"), F.round("f", 7).alias("f"))


@_query(f"""WITH {_RISK}, t AS (SELECT DISTINCT x FROM risk), gs AS (SELECT DISTINCT g FROM risk),
f AS (SELECT gs.g, t.x, COALESCE(risk.r, 0) AS r, CASE WHEN risk.x = t.x THEN d ELSE 0 END AS d FROM t CROSS JOIN gs ASOF LEFT JOIN risk ON gs.g = risk.g AND t.x <= risk.x),
s AS (SELECT *, SUM(r) OVER (PARTITION BY x) AS rr, SUM(d) OVER (PARTITION BY x) AS dd FROM f),
z AS (SELECT g, SUM(d - dd * r / rr) AS z FROM s WHERE dd > 0 GROUP BY g),
v AS (SELECT a.g, b.g AS h, SUM(CASE WHEN a.rr > 1 THEN a.dd * (a.rr - a.dd) / (a.rr - 1) * (a.r / a.rr) * ((CASE WHEN a.g = b.g THEN 1 ELSE 0 END) - b.r / b.rr) ELSE 0 END) AS v
  FROM s a JOIN s b ON a.x = b.x WHERE a.dd > 0 GROUP BY 1, 2)
SELECT v.g AS "group", v.h AS other, ROUND(z, 5) AS z, ROUND(v, 5) AS v FROM v JOIN z ON v.g = z.g""")
def logrank_terms(spark, sf_dir):
    return comparison.logrank_terms(risk.simple_risk_table(_obs(spark, sf_dir), ("g",)), "g").select("group", "other", F.round("z", 5).alias("z"), F.round("v", 5).alias("v"))


# --- recurrent events: a user's actions, in hours since the first of all --------------------------

_EV = """ev AS (SELECT user_id AS i, event_type AS e, ROUND(date_diff('second', TIMESTAMP '2020-01-01', ts) / 3600.0::DOUBLE, 6) AS x, value FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "value")
    return ev.withColumn("x", F.round((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1577836800)) / 3600.0, 6))


def _rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.recurrent_events(_events(spark, sf_dir), "user_id", "x", mark="event_type")


_RR = f"""{_EV}, last AS (SELECT i, MAX(x) AS x FROM ev GROUP BY i), t AS (SELECT x, COUNT(*) AS d FROM ev GROUP BY x),
rr AS (SELECT t.x, CAST((SELECT COUNT(*) FROM last) - COALESCE(b.n, 0) AS DOUBLE) AS r, CAST(d AS DOUBLE) AS d FROM t
  ASOF LEFT JOIN (SELECT x, SUM(COUNT(*)) OVER (ORDER BY x) AS n FROM last GROUP BY x) b ON t.x > b.x)"""


@_query(f"WITH {_RR} SELECT x, r, d FROM rr")
def recurrent_risk_table(spark, sf_dir):
    return risk.recurrent_risk_table(_rec(spark, sf_dir))


@_query(f"""WITH {_RR} SELECT x, ROUND(SUM(d / r) OVER (ORDER BY x), 6) AS mcf,
ROUND(SUM((d * (1 - 1 / r) * (1 - 1 / r) + (r - d) / (r * r)) / (r * r)) OVER (ORDER BY x), 6) AS variance FROM rr""")
def mean_cumulative_function(spark, sf_dir):
    return recurrent.mean_cumulative(risk.recurrent_risk_table(_rec(spark, sf_dir))).select("x", F.round("mcf", 6).alias("mcf"), F.round("variance", 6).alias("variance"))


@_query(f"""WITH {_RR}, m AS (SELECT rr.x, r, CAST((SELECT COUNT(*) FROM ev WHERE ev.x = rr.x AND e = 'click') AS DOUBLE) AS d FROM rr)
SELECT x, r, d, ROUND(SUM(d / r) OVER (ORDER BY x), 6) AS mcf FROM m""")
def cause_specific_mcf(spark, sf_dir):
    return recurrent.mean_cumulative(risk.recurrent_risk_table(_rec(spark, sf_dir), mark="click")).select("x", "r", "d", F.round("mcf", 6).alias("mcf"))


@_query(f"""WITH {_EV}, w AS (SELECT i, x, x - COALESCE(LAG(x) OVER (PARTITION BY i ORDER BY x), 0) AS gap FROM ev)
SELECT i, COUNT(*) AS m, ROUND(SUM(gap), 5) AS total, ROUND(MAX(gap), 5) AS longest FROM w GROUP BY i""")
def interarrival_times(spark, sf_dir):
    return recurrent.interarrival(_rec(spark, sf_dir)).groupBy("i").agg(F.count("*").alias("m"), F.round(F.sum("gap"), 5).alias("total"), F.round(F.max("gap"), 5).alias("longest"))


_TREND = f"""{_EV}, o AS (SELECT i, x, MAX(x) OVER (PARTITION BY i) AS t, ROW_NUMBER() OVER (PARTITION BY i ORDER BY x DESC) AS k FROM ev),
it AS (SELECT i, MAX(t) AS t, COUNT(*) FILTER (WHERE k > 1) AS m, COALESCE(SUM(x) FILTER (WHERE k > 1), 0) AS sx, COALESCE(SUM(LN(t / x)) FILTER (WHERE k > 1), 0) AS sl FROM o WHERE t > 0 AND x > 0 GROUP BY i)"""


@_query(f"""WITH {_TREND} SELECT CAST(SUM(m) AS BIGINT) AS n, ROUND(SUM(t), 4) AS t_total, ROUND(SUM(sx - m * t / 2) / SQRT(SUM(m * t * t / 12)), 6) AS laplace, ROUND(2 * SUM(sl), 5) AS mil_hdbk FROM it""")
def trend_tests(spark, sf_dir):
    return recurrent.trend_tests(_rec(spark, sf_dir)).select("n", F.round("t_total", 4).alias("t_total"), F.round("laplace", 6).alias("laplace"), F.round("mil_hdbk", 5).alias("mil_hdbk"))


@_query(f"""WITH {_EV}, it AS (SELECT i, CAST(COUNT(*) AS DOUBLE) AS n, MAX(x) AS t FROM ev GROUP BY i), s AS (SELECT SUM(n) AS n, SUM(t) AS t FROM it)
SELECT n, ROUND(t, 4) AS exposure, ROUND(n / t, 9) AS rate, ROUND(n - n * LN(n / t), 4) AS neg_ll FROM s""")
def homogeneous_poisson(spark, sf_dir):
    h = recurrent.homogeneous_poisson(_rec(spark, sf_dir))
    return h.select("n", F.round("exposure", 4).alias("exposure"), F.round("rate", 9).alias("rate"), F.round("neg_ll", 4).alias("neg_ll"))


@_query(f"""WITH {_EV}, o AS (SELECT *, MAX(x) OVER () AS t FROM ev), s AS (SELECT CAST(COUNT(DISTINCT i) AS DOUBLE) AS k, MAX(t) AS t, CAST(COUNT(*) AS DOUBLE) AS n, SUM(CASE WHEN x > 0 THEN LN(t / x) END) AS s FROM o)
SELECT n, ROUND(t / POW(n / k, s / n), 6) AS alpha, ROUND(n / s, 8) AS beta FROM s""")
def crow_amsaa(spark, sf_dir):
    return recurrent.crow_amsaa(_rec(spark, sf_dir)).select("n", F.round("alpha", 6).alias("alpha"), F.round("beta", 8).alias("beta"))


@_query(f"""WITH {_EV}, w AS (SELECT i, x, COALESCE(0.4 * LAG(x) OVER (PARTITION BY i ORDER BY x), 0) AS v FROM ev)
SELECT i, ROUND(SUM(v), 4) AS ages, ROUND(MAX(v), 4) AS oldest FROM w GROUP BY i""")
def virtual_age_kijima(spark, sf_dir):
    return recurrent.virtual_age(_rec(spark, sf_dir), 0.4).groupBy("i").agg(F.round(F.sum("virtual_age"), 4).alias("ages"), F.round(F.max("virtual_age"), 4).alias("oldest"))


@_query(f"""WITH {_EV}, w AS (SELECT i, x, LAG(x) OVER (PARTITION BY i ORDER BY x) AS p1, LAG(x, 2) OVER (PARTITION BY i ORDER BY x) AS p2 FROM ev)
SELECT i, ROUND(SUM(COALESCE(p1 - 0.3 * p1 - 0.3 * 0.7 * COALESCE(p2, 0), 0)), 4) AS ages FROM w GROUP BY i""")
def virtual_age_reduction(spark, sf_dir):
    return recurrent.arithmetic_reduction_age(_rec(spark, sf_dir), 0.3, 2).groupBy("i").agg(F.round(F.sum("virtual_age"), 4).alias("ages"))


# --- competing risks: an order's line ends by status, open ones are censored ------------------------

@_query(f"""WITH {_OBS}, k AS (SELECT g, x, CASE WHEN c = 0 THEN prio END AS cause FROM obs), t AS (SELECT g, x, cause, CAST(COUNT(*) AS DOUBLE) AS d FROM k GROUP BY g, x, cause),
a AS (SELECT g, x, SUM(d) AS o, COALESCE(SUM(d) FILTER (WHERE cause IS NOT NULL), 0) AS dd FROM t GROUP BY g, x),
r AS (SELECT g, x, dd, SUM(o) OVER (PARTITION BY g ORDER BY x DESC) AS r FROM a),
s AS (SELECT g, x, r, EXP(-SUM(dd / r) OVER (PARTITION BY g ORDER BY x)) AS s FROM r)
SELECT g, cause, x, r, d, ROUND(SUM(d / r) OVER w, 7) AS cs_hazard, ROUND(SUM(s * d / r) OVER w, 7) AS cif, ROUND(s * d / r, 8) AS iif
FROM t JOIN s USING (g, x) WHERE cause IS NOT NULL WINDOW w AS (PARTITION BY g, cause ORDER BY x)""")
def cumulative_incidence(spark, sf_dir):
    out = competing.cumulative_incidence(_causes(spark, sf_dir), "x", "cause", by=("g",))
    return out.select("g", "cause", "x", "r", "d", F.round("cs_hazard", 7).alias("cs_hazard"), F.round("cif", 7).alias("cif"), F.round("iif", 8).alias("iif"))


def _causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipments(spark, sf_dir).withColumn("cause", F.when(F.col("c") == 0, F.col("prio")))


@_query(f"""WITH {_OBS}, k AS (SELECT g, x, CASE WHEN c = 0 THEN prio END AS cause FROM obs), t AS (SELECT g, x, cause, CAST(COUNT(*) AS DOUBLE) AS d FROM k GROUP BY g, x, cause),
a AS (SELECT g, x, SUM(d) AS o, COALESCE(SUM(d) FILTER (WHERE cause IS NOT NULL), 0) AS dd FROM t GROUP BY g, x),
r AS (SELECT g, x, dd, SUM(o) OVER (PARTITION BY g ORDER BY x DESC) AS r FROM a),
s AS (SELECT g, x, r, COALESCE(PRODUCT(1 - dd / r) OVER (PARTITION BY g ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS s FROM r)
SELECT g, cause, x, ROUND(SUM(s * d / r) OVER (PARTITION BY g, cause ORDER BY x), 7) AS cif FROM t JOIN s USING (g, x) WHERE cause IS NOT NULL""")
def aalen_johansen(spark, sf_dir):
    out = competing.cumulative_incidence(_causes(spark, sf_dir), "x", "cause", by=("g",), method="km", left_limit=True)
    return out.select("g", "cause", "x", F.round("cif", 7).alias("cif"))


_CAUSES = f"""{_OBS}, k AS (SELECT g, x, q, CASE WHEN c = 0 THEN prio END AS cause FROM obs),
tx AS (SELECT x, COUNT(*) AS m, COUNT(*) FILTER (WHERE cause IS NULL) AS c FROM k GROUP BY x), yx AS (SELECT x, c, SUM(m) OVER (ORDER BY x DESC) AS y FROM tx),
gx AS (SELECT x, y, COALESCE(PRODUCT(1 - c / y::DOUBLE) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS gg FROM yx)"""


_GRAY = f"""{_CAUSES}, gr AS (SELECT x, y, c, PRODUCT(1 - c / y::DOUBLE) OVER (ORDER BY x) AS gi FROM yx),
al AS (SELECT x, CAST(COUNT(*) FILTER (WHERE cause IS NOT NULL) AS DOUBLE) AS da, CAST(COUNT(*) FILTER (WHERE cause = '1-URGENT') AS DOUBLE) AS dk FROM k GROUP BY x),
aj AS (SELECT x, dk / y * COALESCE(PRODUCT(1 - da / y) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS f FROM al JOIN gr USING (x)),
fx AS (SELECT x, COALESCE(SUM(f) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inc FROM aj),
n AS (SELECT g, x, CAST(COUNT(*) AS DOUBLE) AS m, CAST(COUNT(*) FILTER (WHERE cause = '1-URGENT') AS DOUBLE) AS d FROM k GROUP BY g, x),
-- risk sets as they are defined: every row still there, and earlier competing failures with their weight
pr AS (SELECT t.x, a.g, SUM(CASE WHEN a.x >= t.x THEN a.m WHEN ga.gi > 0 THEN a.o * gt.gi / ga.gi ELSE 0 END) AS r
  FROM (SELECT x FROM al WHERE dk > 0) t CROSS JOIN (SELECT g, x, CAST(COUNT(*) AS DOUBLE) AS m, CAST(COUNT(*) FILTER (WHERE cause <> '1-URGENT') AS DOUBLE) AS o FROM k GROUP BY g, x) a
  JOIN gr gt ON gt.x = t.x JOIN gr ga ON ga.x = a.x GROUP BY 1, 2),
s AS (SELECT pr.g, pr.x, r, COALESCE(d, 0) AS d, SUM(r) OVER (PARTITION BY pr.x) AS rr, SUM(COALESCE(d, 0)) OVER (PARTITION BY pr.x) AS dd, 1 - inc AS w FROM pr LEFT JOIN n ON n.g = pr.g AND n.x = pr.x JOIN fx ON fx.x = pr.x)"""


def _gray_sql(rho: str) -> str:
    return f"""{_GRAY}, z AS (SELECT g, SUM(POW(w, {rho}) * (d - dd * r / rr)) AS z FROM s GROUP BY g),
v AS (SELECT a.g, b.g AS h, SUM(CASE WHEN a.rr > 1 THEN POW(a.w, 2 * {rho}) * a.dd * (a.rr - a.dd) / (a.rr - 1) * (a.r / a.rr) * ((CASE WHEN a.g = b.g THEN 1 ELSE 0 END) - b.r / b.rr) ELSE 0 END) AS v FROM s a JOIN s b ON a.x = b.x GROUP BY 1, 2)"""


@_query(f"""WITH {_gray_sql("0")} SELECT v.g AS "group", v.h AS other, ROUND(z, 4) AS z, ROUND(v, 4) AS v FROM v JOIN z ON v.g = z.g""")
def gray_terms(spark, sf_dir):
    out = competing.gray_terms(_causes(spark, sf_dir), "x", "cause", "g", "1-URGENT")
    return out.select("group", "other", F.round("z", 4).alias("z"), F.round("v", 4).alias("v"))


@_query(f"""WITH {_gray_sql("1.5")} SELECT v.g AS "group", v.h AS other, ROUND(z, 4) AS z, ROUND(v, 4) AS v FROM v JOIN z ON v.g = z.g""")
def gray_terms_weighted(spark, sf_dir):
    out = competing.gray_terms(_causes(spark, sf_dir), "x", "cause", "g", "1-URGENT", rho=1.5)
    return out.select("group", "other", F.round("z", 4).alias("z"), F.round("v", 4).alias("v"))


@_query(f"""WITH {_gray_sql("0")}, a AS (SELECT MAX(z) FILTER (WHERE g = 'A') AS za, MAX(z) FILTER (WHERE g = 'N') AS zn FROM z),
c AS (SELECT MAX(v) FILTER (WHERE g = 'A' AND h = 'A') AS vaa, MAX(v) FILTER (WHERE g = 'A' AND h = 'N') AS van, MAX(v) FILTER (WHERE g = 'N' AND h = 'N') AS vnn FROM v),
t AS (SELECT (za * za * vnn - 2 * za * zn * van + zn * zn * vaa) / (vaa * vnn - van * van) AS q FROM a, c)
SELECT ROUND(q, 5) AS statistic, CAST(2 AS INT) AS df, ROUND(EXP(-q / 2), 6) AS p_value FROM t""")
def gray_test(spark, sf_dir):
    out = competing.gray_test(_causes(spark, sf_dir), "x", "cause", "g", "1-URGENT")
    return out.select(F.round("statistic", 5).alias("statistic"), "df", F.round("p_value", 6).alias("p_value"))


@_query(f"""WITH {_CAUSES}, n AS (SELECT x, SUM(EXP(0.01 * q)) AS s0, SUM(EXP(0.01 * q) * q) AS s1, COALESCE(SUM(EXP(0.01 * q)) FILTER (WHERE cause <> '1-URGENT'), 0) AS o0,
  COALESCE(SUM(EXP(0.01 * q) * q) FILTER (WHERE cause <> '1-URGENT'), 0) AS o1, CAST(COUNT(*) FILTER (WHERE cause = '1-URGENT') AS DOUBLE) AS d, COALESCE(SUM(q) FILTER (WHERE cause = '1-URGENT'), 0) AS dq FROM k GROUP BY x),
r AS (SELECT x, d, dq, SUM(s0) OVER b + gg * COALESCE(SUM(CASE WHEN gg > 0 THEN o0 / gg END) OVER u, 0) AS r0, SUM(s1) OVER b + gg * COALESCE(SUM(CASE WHEN gg > 0 THEN o1 / gg END) OVER u, 0) AS r1 FROM n JOIN gx USING (x)
  WINDOW b AS (ORDER BY x DESC), u AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ROUND(SUM(0.01 * dq - d * LN(r0)), 2) AS ll, ROUND(SUM(dq - d * r1 / r0), 3) AS u_0 FROM r WHERE d > 0""")
def fine_gray_terms(spark, sf_dir):
    t = competing.fine_gray_terms(_causes(spark, sf_dir), "x", "cause", ["q"], [0.01], "1-URGENT")
    return t.select(F.round("ll", 2).alias("ll"), F.round("u_0", 3).alias("u_0"))


# --- prediction ----------------------------------------------------------------------------------

@_query(f"""WITH {_OBS}, k AS (SELECT x, q AS s, CAST(SUM(1-c) AS DOUBLE) AS d, CAST(SUM(c) AS DOUBLE) AS z FROM obs GROUP BY x, q),
p AS (SELECT a.d * (b.d + b.z) AS w, CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END AS v FROM k a JOIN k b ON b.x > a.x WHERE a.d > 0
  UNION ALL SELECT a.d * b.d, 0.5 FROM k a JOIN k b ON b.x = a.x AND b.s > a.s
  UNION ALL SELECT d * (d - 1) / 2, 1 FROM k
  UNION ALL SELECT a.d * b.z, CASE WHEN a.s > b.s THEN 1 ELSE 0.5 END FROM k a JOIN k b ON b.x = a.x)
SELECT SUM(w) AS comparable, SUM(CASE WHEN v = 1 THEN w ELSE 0 END) AS concordant, SUM(CASE WHEN v = 0.5 THEN w ELSE 0 END) AS tied, ROUND(SUM(w * v) / SUM(w), 9) AS c_index FROM p""")
def concordance(spark, sf_dir):
    return metrics.concordance(shipments(spark, sf_dir), "x", "c", "q").withColumn("c_index", F.round("c_index", 9))


_CENSORING = f"""{_OBS}, ga AS (SELECT x, CAST(SUM(c) AS DOUBLE) AS d, CAST(COUNT(*) AS DOUBLE) AS o FROM obs GROUP BY x), gb AS (SELECT x, d, SUM(o) OVER (ORDER BY x DESC) AS r FROM ga),
g AS (SELECT x, PRODUCT(1 - d / r) OVER (ORDER BY x) AS g FROM gb)"""


@_query(f"""WITH {_CENSORING}, e AS (SELECT q, CASE WHEN obs.x <= 60 AND c = 0 THEN CASE WHEN g.g > 0 THEN 1 / g.g ELSE 0 END END AS w, CASE WHEN obs.x > 60 THEN 1 END AS k FROM obs JOIN g USING (x)),
a AS (SELECT q, SUM(w) AS w FROM e WHERE w IS NOT NULL GROUP BY q), b AS (SELECT q, COUNT(*) AS n FROM e WHERE k = 1 GROUP BY q)
SELECT ROUND(SUM(a.w * b.n * CASE WHEN a.q > b.q THEN 1 WHEN a.q = b.q THEN 0.5 ELSE 0 END) / ((SELECT SUM(w) FROM a) * (SELECT SUM(n) FROM b)), 9) AS auc FROM a CROSS JOIN b""")
def roc_auc(spark, sf_dir):
    return metrics.roc_at(shipments(spark, sf_dir), "x", "c", "q", 60.0).select(F.round("auc", 9).alias("auc"))


@_query(f"""WITH {_CENSORING}, h AS (SELECT CAST(t AS DOUBLE) AS t, COALESCE(MIN(g.g), 1) AS gt FROM (SELECT UNNEST([30, 60, 90]) AS t) LEFT JOIN g ON g.x <= t GROUP BY t)
SELECT t, ROUND(AVG(CASE WHEN x <= t AND c = 0 THEN CASE WHEN g.g > 0 THEN EXP(-t / 60) * EXP(-t / 60) / g.g ELSE 0 END WHEN x > t AND gt > 0 THEN (1 - EXP(-t / 60)) * (1 - EXP(-t / 60)) / gt ELSE 0 END), 8) AS brier FROM h, obs JOIN g USING (x) GROUP BY t""")
def brier_score(spark, sf_dir):
    own = shipments(spark, sf_dir).withColumns({f"s{t}": F.exp(F.lit(-t / 60.0)) for t in (30, 60, 90)})
    return metrics.brier_score(own, "x", "c", {30.0: "s30", 60.0: "s60", 90.0: "s90"}).select("t", F.round("brier", 8).alias("brier"))


# --- degradation: a user's cumulated value -----------------------------------------------------------

_DEG = f"""{_EV}, y AS (SELECT i, x, SUM(value) OVER (PARTITION BY i ORDER BY x, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM ev)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("x", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _events(spark, sf_dir).select("user_id", "x", F.sum("value").over(w).alias("y"))


@_query(f"""WITH {_DEG}, f AS (SELECT i AS unit, COUNT(*) AS m, REGR_INTERCEPT(y, x) AS a, REGR_SLOPE(y, x) AS b FROM y GROUP BY i HAVING COUNT(DISTINCT x) > 1)
SELECT unit, m, ROUND(a, 3) AS intercept, ROUND(b, 5) AS slope, ROUND(CASE WHEN b <> 0 THEN (5000 - a) / b END, 2) AS x FROM f""")
def degradation_paths(spark, sf_dir):
    fits = degradation.failure_times(degradation.fit_paths(_paths(spark, sf_dir), "user_id", "x", "y").filter("slope is not null"), 5000.0)
    return fits.select("unit", "m", F.round("intercept", 3).alias("intercept"), F.round("slope", 5).alias("slope"), F.round("x", 2).alias("x"))


@_query(f"""WITH {_DEG}, s AS (SELECT x - LAG(x) OVER w AS dt, y - LAG(y) OVER w AS dy FROM y WINDOW w AS (PARTITION BY i ORDER BY x)), k AS (SELECT * FROM s WHERE dt > 0)
SELECT COUNT(*) AS m, ROUND(SUM(dy) / SUM(dt), 6) AS drift, ROUND(SQRT((SUM(dy * dy / dt) - SUM(dy) * SUM(dy) / SUM(dt)) / COUNT(*)), 4) AS sigma FROM k""")
def wiener_process(spark, sf_dir):
    steps = degradation.increments(_paths(spark, sf_dir), "user_id", "x", "y")
    return degradation.wiener_fit(steps).select("m", F.round("drift", 6).alias("drift"), F.round("sigma", 4).alias("sigma"))


# --- distributions and fits -------------------------------------------------------------------------

@_query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)
SELECT p_partkey, ROUND(EXP(-POW(x / 20, 1.5)), 8) AS weibull, ROUND(EXP(-0.05 * x), 8) AS exponential, ROUND(EXP(-x * x / 200), 8) AS rayleigh,
ROUND(1 - POW(1 - EXP(-POW(x / 20, 1.5)), 2), 8) AS expo_weibull, ROUND(EXP(-EXP((x - 20) / 5)), 8) AS gumbel, ROUND(1 - EXP(-EXP(-(x - 20) / 5)), 8) AS gumbel_lev,
ROUND(1 / (1 + EXP((x - 20) / 5)), 8) AS logistic, ROUND(1 / (1 + POW(x / 20, 2)), 8) AS loglogistic, ROUND(GREATEST(0, LEAST(1, (40 - x) / 40)), 8) AS uniform,
ROUND(POW(0.9, x), 8) AS geometric, ROUND(POW(0.99, POW(x, 1.2)), 8) AS discrete_weibull FROM p""")
def distribution_survival(spark, sf_dir):
    x = F.col("p_size").cast("double")
    args = {"weibull": (20.0, 1.5), "exponential": (0.05,), "rayleigh": (10.0,), "expo_weibull": (20.0, 1.5, 2.0), "gumbel": (20.0, 5.0), "gumbel_lev": (20.0, 5.0), "logistic": (20.0, 5.0),
            "loglogistic": (20.0, 2.0), "uniform": (0.0, 40.0), "geometric": (0.1,), "discrete_weibull": (0.99, 1.2)}
    return _read(spark, sf_dir, "part").select("p_partkey", *[F.round(DISTRIBUTIONS[k].sf(x, *a), 8).alias(k) for k, a in args.items()])


@_query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 51 AS p FROM part)
SELECT p_partkey, ROUND(20 * POW(-LN(1 - p), 1 / 1.5), 6) AS weibull, ROUND(-LN(1 - p) / 0.05, 6) AS exponential, ROUND(20 + 5 * LN(-LN(1 - p)), 6) AS gumbel,
ROUND(20 + 5 * LN(p / (1 - p)), 6) AS logistic, ROUND(20 * POW(p / (1 - p), 0.5), 6) AS loglogistic FROM p""")
def distribution_quantiles(spark, sf_dir):
    p = F.col("p_size").cast("double") / 51
    args = {"weibull": (20.0, 1.5), "exponential": (0.05,), "gumbel": (20.0, 5.0), "logistic": (20.0, 5.0), "loglogistic": (20.0, 2.0)}
    return _read(spark, sf_dir, "part").select("p_partkey", *[F.round(DISTRIBUTIONS[k].qf(p, *a), 6).alias(k) for k, a in args.items()])


def _phi(z: str) -> str:
    """SQL for the normal distribution function: Simpson's rule over its density."""
    return f"(0.5 + ({z}) / 600 * list_sum(list_transform(range(0, 201), lambda i: (CASE WHEN i = 0 OR i = 200 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * EXP(-POW(({z}) * i / 200, 2) / 2) / SQRT(2 * PI()))))"


@_query(f"""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)
SELECT p_partkey, ROUND(1 - {_phi("(x - 20) / 5")}, 6) AS normal, ROUND(1 - {_phi("(LN(x) - 3) / 0.5")}, 6) AS lognormal, ROUND(EXP(-0.1 * x) * (1 + 0.1 * x), 6) AS gamma,
ROUND(1 - x / 51 * x / 51 * (6 - 8 * x / 51 + 3 * x / 51 * x / 51), 6) AS beta FROM p""")
def distribution_kernels(spark, sf_dir):
    x = F.col("p_size").cast("double")
    args = {"normal": (20.0, 5.0), "lognormal": (3.0, 0.5), "gamma": (2.0, 0.1)}
    return _read(spark, sf_dir, "part").select("p_partkey", *[F.round(DISTRIBUTIONS[k].sf(x, *a), 6).alias(k) for k, a in args.items()],
                                              F.round(DISTRIBUTIONS["beta"].sf(x / 51, 2.0, 3.0), 6).alias("beta"))


@_query("""WITH p AS (SELECT p_partkey, EXP(-POW(p_size / 20.0::DOUBLE, 1.5)) AS a, EXP(-0.05 * p_size) AS b FROM part)
SELECT p_partkey, ROUND(a * b, 8) AS series, ROUND(1 - (1 - a) * (1 - b), 8) AS parallel, ROUND(0.3 * a + 0.7 * b, 8) AS mixture, ROUND(1 - 0.6 + 0.5 * a, 8) AS limited FROM p""")
def system_reliability(spark, sf_dir):
    x = F.col("p_size").cast("double")
    a, b = DISTRIBUTIONS["weibull"].sf(x, 20.0, 1.5), DISTRIBUTIONS["exponential"].sf(x, 0.05)
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(series([a, b]), 8).alias("series"), F.round(parallel([a, b]), 8).alias("parallel"),
                                              F.round(mixture([(0.3, a), (0.7, b)]), 8).alias("mixture"), F.round(limited_failure(a, 0.6, 0.1), 8).alias("limited"))


@_query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS z FROM part) SELECT p_partkey, ROUND(3 * POW(z, 0.5), 7) AS power, ROUND(1 / (3 * POW(z, 0.5)), 7) AS inverse_power,
ROUND(2 * EXP(1.5 / z), 7) AS exponential, ROUND(EXP(-(2 - 1.5 / z)) / z, 7) AS eyring, ROUND(1.5 + 2 * z, 7) AS linear, ROUND(EXP(0.1 + 0.05 * z), 7) AS log_linear FROM p""")
def life_stress(spark, sf_dir):
    z = F.col("p_size").cast("double")
    args = {"power": (3.0, 0.5), "inverse-power": (3.0, 0.5), "exponential": (1.5, 2.0), "eyring": (1.5, 2.0), "linear": (1.5, 2.0), "log-linear": (0.1, 0.05)}
    return _read(spark, sf_dir, "part").select("p_partkey", *[F.round(STRESS[k](z, *a), 7).alias(k.replace("-", "_")) for k, a in args.items()])


@_query(f"""WITH {_OBS}, s AS (SELECT g, CAST(SUM(1-c) AS DOUBLE) AS d, SUM(x) AS t, SUM(x * x) AS t2, MIN(x) AS a, MAX(x) AS b FROM obs GROUP BY g)
SELECT g, ROUND(d / t, 9) AS exp_rate, ROUND(d - d * LN(NULLIF(d / t, 0)), 3) AS exp_neg_ll, ROUND(SQRT(t2 / (2 * NULLIF(d, 0))), 6) AS rayleigh_sigma, a AS uniform_a, b AS uniform_b FROM s""")
def closed_form_fits(spark, sf_dir):
    f = fit.fit_closed(_obs(spark, sf_dir), ("g",))
    return f.select("g", F.round("exp_rate", 9).alias("exp_rate"), F.round("exp_neg_ll", 3).alias("exp_neg_ll"), F.round("rayleigh_sigma", 6).alias("rayleigh_sigma"), "uniform_a", "uniform_b")


@_query(f"""WITH {_RISK}, k AS (SELECT g, x, r, d, MAX(r) OVER (PARTITION BY g) AS n, PRODUCT((r + 1 - d) / (r + 1)) OVER (PARTITION BY g ORDER BY x) AS p FROM risk),
f AS (SELECT g, x, d, CASE WHEN (n + 1) * (1 - p) > 0 THEN ((n + 1) * (1 - p) - 0.375) / (n + 0.25) ELSE 0 END AS f FROM k),
l AS (SELECT g, LN(x) AS u, LN(-LN(1 - f)) AS v FROM f WHERE f > 0 AND f < 1 AND d > 0 AND x > 0), b AS (SELECT g, REGR_SLOPE(v, u) AS b, REGR_INTERCEPT(v, u) AS a FROM l GROUP BY g)
SELECT g, ROUND(EXP(-a / b), 5) AS alpha, ROUND(b, 7) AS beta FROM b""")
def weibull_plot_fit(spark, sf_dir):
    positions = curves.plotting_positions(_obs(spark, sf_dir), "Blom", ("g",)).filter("x > 0")
    return fit.fit_plot(positions, "weibull", by=("g",)).select("g", F.round("alpha", 5).alias("alpha"), F.round("beta", 7).alias("beta"))


@_query(f"WITH {_OBS} SELECT g, ROUND(AVG(x), 6) AS m1, ROUND(AVG(x * x), 5) AS m2, ROUND(AVG(x * x * x), 3) AS m3 FROM obs GROUP BY g")
def raw_moments(spark, sf_dir):
    return fit.moments(_obs(spark, sf_dir), 3, ("g",)).select("g", F.round("m1", 6).alias("m1"), F.round("m2", 5).alias("m2"), F.round("m3", 3).alias("m3"))


@_query()
def maximum_likelihood_fits(spark, sf_dir):
    own = observations.observations(shipments(spark, sf_dir).filter("x > 0"), x="x", c="c")
    rows = []
    for family in ("weibull", "exponential", "lognormal", "loglogistic"):
        m = fit.fit_mle(own, family)
        rows += [(family, k, v, m.neg_ll, m.aic) for k, v in m.params.items()]
    return spark.createDataFrame(rows, "family string, param string, value double, neg_ll double, aic double")


@_query(f"""WITH {_OBS}, o AS (SELECT x, c, q, disc, EXP(0.01 * q - 0.5 * disc) AS w FROM obs),
k AS (SELECT x, SUM(w) AS s0, SUM(w * q) AS s1, SUM(w * disc) AS s2, SUM(w * q * q) AS s11, SUM(w * q * disc) AS s12, SUM(w * disc * disc) AS s22, CAST(SUM(1-c) AS DOUBLE) AS d,
 SUM((1-c) * (0.01 * q - 0.5 * disc)) AS de, SUM((1-c) * q) AS dq, SUM((1-c) * disc) AS dd FROM o GROUP BY x),
r AS (SELECT x, d, de, dq, dd, SUM(s0) OVER w AS s0, SUM(s1) OVER w AS s1, SUM(s2) OVER w AS s2, SUM(s11) OVER w AS s11, SUM(s12) OVER w AS s12, SUM(s22) OVER w AS s22 FROM k WINDOW w AS (ORDER BY x DESC))
SELECT ROUND(SUM(de - d * LN(s0)), 2) AS ll, ROUND(SUM(dq - d * s1 / s0), 3) AS u_0, ROUND(SUM(dd - d * s2 / s0), 4) AS u_1, ROUND(SUM(d * (s11 / s0 - s1 / s0 * s1 / s0)), 1) AS h_0_0,
ROUND(SUM(d * (s12 / s0 - s1 / s0 * s2 / s0)), 3) AS h_1_0, ROUND(SUM(d * (s22 / s0 - s2 / s0 * s2 / s0)), 4) AS h_1_1 FROM r WHERE d > 0""")
def cox_terms(spark, sf_dir):
    t = regression.cox_terms(shipments(spark, sf_dir), "x", "c", ["q", "disc"], [0.01, -0.5])
    digits = {"ll": 2, "u_0": 3, "u_1": 4, "h_0_0": 1, "h_1_0": 3, "h_1_1": 4}
    return t.select(*[F.round(k, d).alias(k) for k, d in digits.items()])


@_query()
def cox_regression(spark, sf_dir):
    m = regression.fit_cox(shipments(spark, sf_dir), "x", "c", ["q", "disc"], strata=("g",))
    rows = [(k, float(b), float(v) ** 0.5, m.log_likelihood) for k, b, v in zip(m.names, m.beta, m.covariance.diagonal())]
    return spark.createDataFrame(rows, "covariate string, beta double, se double, log_likelihood double")


@_query(f"""WITH {_OBS}, k AS (SELECT x, CAST(SUM(1-c) AS DOUBLE) AS d, SUM(EXP(0.01 * q)) AS o FROM obs GROUP BY x), r AS (SELECT x, d, SUM(o) OVER (ORDER BY x DESC) AS r FROM k)
SELECT x, d, ROUND(r, 4) AS risk, ROUND(d / r, 9) AS hazard, ROUND(SUM(d / r) OVER (ORDER BY x), 8) AS cum_hazard FROM r""")
def cox_baseline(spark, sf_dir):
    b = regression.cox_baseline(shipments(spark, sf_dir), "x", "c", ["q"], [0.01])
    return b.select("x", "d", F.round("risk", 4).alias("risk"), F.round("hazard", 9).alias("hazard"), F.round("cum_hazard", 8).alias("cum_hazard"))


@_query(f"""WITH {_OBS}, k AS (SELECT x, CAST(COUNT(*) AS DOUBLE) AS s0, SUM(q) AS s1, SUM(q * q) AS s2, CAST(SUM(1-c) AS DOUBLE) AS d, SUM((1-c) * q) AS dq FROM obs GROUP BY x),
r AS (SELECT x, d, dq, SUM(s0) OVER w AS s0, SUM(s1) OVER w AS s1, SUM(s2) OVER w AS s2, x - LAG(x, 1, 0) OVER (ORDER BY x) AS dt FROM k WINDOW w AS (ORDER BY x DESC))
SELECT ROUND(SUM(dt * (s2 - s1 * s1 / s0)), 2) AS a_0_0, ROUND(SUM(dq - d * s1 / s0), 3) AS b_0 FROM r""")
def additive_hazards(spark, sf_dir):
    t = regression.additive_hazards_terms(shipments(spark, sf_dir), "x", "c", ["q"])
    return t.select(F.round("a_0_0", 2).alias("a_0_0"), F.round("b_0", 3).alias("b_0"))


@_query()
def turnbull_curve(spark, sf_dir):
    own = shipments(spark, sf_dir).select((F.col("x") - F.col("entry")).alias("lo"), F.col("x").alias("hi"), "c")
    rows = own.select(F.when(F.col("c") == 1, F.col("hi")).otherwise(F.greatest(F.lit(0.0), "lo")).alias("lo"), F.when(F.col("c") == 1, F.lit(float("inf"))).otherwise(F.col("hi")).alias("hi"))
    return turnbull.turnbull(observations.observations(rows, xl="lo", xr="hi"), tol=1e-7, steps=500)


@_query(f"""WITH {_OBS}, a AS (SELECT x, CAST(SUM(1-c) AS DOUBLE) AS d, SUM(EXP(0.01 * q)) AS o FROM obs GROUP BY x), h AS (SELECT x, d / SUM(o) OVER (ORDER BY x DESC) AS h FROM a),
b AS (SELECT x, SUM(h) OVER (ORDER BY x) AS hh FROM h) SELECT g, ROUND(SUM((1 - c) - hh * EXP(0.01 * q)), 4) AS total, ROUND(MIN((1 - c) - hh * EXP(0.01 * q)), 6) AS least FROM obs JOIN b USING (x) GROUP BY g""")
def martingale_residuals(spark, sf_dir):
    out = regression.martingale_residuals(shipments(spark, sf_dir), "x", "c", ["q"], [0.01])
    return out.groupBy("g").agg(F.round(F.sum("martingale"), 4).alias("total"), F.round(F.min("martingale"), 6).alias("least"))


@_query(f"""WITH {_OBS}, a AS (SELECT x, CAST(SUM(1-c) AS DOUBLE) AS d, SUM((1-c) * q) AS dq, SUM(EXP(0.01 * q)) AS s0, SUM(q * EXP(0.01 * q)) AS s1 FROM obs GROUP BY x),
r AS (SELECT x, d, dq, SUM(s0) OVER (ORDER BY x DESC) AS r0, SUM(s1) OVER (ORDER BY x DESC) AS r1 FROM a) SELECT x, d, ROUND(dq - d * r1 / r0, 5) AS q FROM r WHERE d > 0""")
def schoenfeld_residuals(spark, sf_dir):
    return regression.schoenfeld_residuals(shipments(spark, sf_dir), "x", "c", ["q"], [0.01]).select("x", "d", F.round("q", 5).alias("q"))


@_query(f"""WITH {_EV}, n AS (SELECT i, x AS xl, LEAD(x) OVER (PARTITION BY i ORDER BY x) AS xr, ROW_NUMBER() OVER (PARTITION BY i ORDER BY x DESC) AS k FROM (SELECT DISTINCT i, x FROM ev))
SELECT i, xl, xr, CAST(CASE WHEN k = 2 THEN 0 ELSE 1 END AS INT) AS flag FROM n WHERE xr IS NOT NULL""")
def covariate_episodes(spark, sf_dir):
    line = _events(spark, sf_dir).select(F.col("user_id").alias("i"), "x").distinct().withColumn("c", F.lit(0))
    return regression.episodes(line, "i", "x", "c").select("i", "xl", "xr", "flag")


@_query()
def fine_gray_regression(spark, sf_dir):
    m = regression.fit_fine_gray(_causes(spark, sf_dir), "x", "cause", ["q", "disc"], "1-URGENT")
    return spark.createDataFrame([(k, float(b)) for k, b in zip(m.names, m.beta)], "covariate string, beta double")


@_query()
def parametric_regressions(spark, sf_dir):
    own = shipments(spark, sf_dir).filter("x > 0").withColumn("z", F.col("q") / 50)
    rows = [(kind, k, v) for kind in ("ph", "aft", "po", "ah") for k, v in regression.fit_parametric(own, "x", "c", ["z"], kind, "exponential" if kind == "ah" else "weibull").items()]
    return spark.createDataFrame(rows, "kind string, param string, value double")


@_query("""WITH p AS (SELECT p_partkey, (p_size + 0.5) / 52.0::DOUBLE AS u, (p_partkey % 97 + 1) / 99.0::DOUBLE AS v FROM part)
SELECT p_partkey, ROUND(POW(POW(u, -2) + POW(v, -2) - 1, -0.5), 7) AS clayton, ROUND(EXP(-SQRT(POW(-LN(u), 2) + POW(-LN(v), 2))), 7) AS gumbel,
ROUND(-LN(1 + (EXP(-3 * u) - 1) * (EXP(-3 * v) - 1) / (EXP(-3) - 1)) / 3, 7) AS frank, ROUND(u * v, 7) AS independence FROM p""")
def copula_probability(spark, sf_dir):
    own = _read(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") + 0.5) / 52.0).alias("u"), ((F.col("p_partkey") % 97 + 1) / 99.0).alias("v"))
    theta = {"clayton": 2.0, "gumbel": 2.0, "frank": 3.0, "independence": 0.0}
    return own.select("p_partkey", *[F.round(copulas.COPULAS[k].cdf(F.col("u"), F.col("v"), t), 7).alias(k) for k, t in theta.items()])


@_query()
def copula_fit(spark, sf_dir):
    own = copulas.pseudo_observations(_read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("x"), (F.col("p_retailprice") + 20 * F.col("p_size")).alias("y")), "x", "y")
    rows = [(k, copulas.fit_copula(own, k, lo, hi)) for k, lo, hi in (("clayton", 0.05, 12.0), ("gumbel", 1.01, 12.0), ("frank", 0.1, 30.0))]
    return spark.createDataFrame(rows, "copula string, theta double")


@_query(f"""WITH {_OBS}, t AS (SELECT UNNEST([10.0::DOUBLE, 25.0::DOUBLE, 40.0::DOUBLE]) AS cut), s AS (SELECT cut, CAST(SUM(1-c) FILTER (WHERE q <= cut) AS DOUBLE) AS dl, SUM(x) FILTER (WHERE q <= cut) AS xl,
 CAST(SUM(1-c) FILTER (WHERE q > cut) AS DOUBLE) AS dr, SUM(x) FILTER (WHERE q > cut) AS xr, CAST(COUNT(*) FILTER (WHERE q <= cut) AS DOUBLE) AS nl FROM obs, t GROUP BY cut)
SELECT cut, ROUND(dl * LN(dl / xl) + dr * LN(dr / xr) - (dl + dr) * LN((dl + dr) / (xl + xr)), 4) AS gain, nl AS n_left, dl AS d_left FROM s""")
def tree_split_gains(spark, sf_dir):
    out = tree.split_gains(shipments(spark, sf_dir), F.lit(1), "x", "c", {"q": [10.0, 25.0, 40.0]})
    return out.select("cut", F.round("gain", 4).alias("gain"), "n_left", "d_left")


@_query()
def survival_tree(spark, sf_dir):
    own = shipments(spark, sf_dir)
    rules = tree.grow_tree(own, "x", "c", ["q", "disc"], depth=2)
    return tree.leaf_rates(own, rules, "x", "c")


@_query()
def survival_forest(spark, sf_dir):
    own = shipments(spark, sf_dir)
    forest = tree.grow_forest(own, "x", "c", ["q", "disc"], trees=2, depth=2)
    return own.groupBy("g").agg(F.avg(tree.forest_survival(forest, F.lit(60.0))).alias("sf_60"))


@_query()
def renewal_fits(spark, sf_dir):
    systems = datasets.general_repair(spark)
    events = recurrent.recurrent_events(systems, "i", "x", c="c")
    rows = [(k, n, v) for k in ("kijima-1", "kijima-2", "g1") for n, v in renewal.fit_renewal(events, k, "weibull").items()]
    rows += [(k, n, v) for k in ("homogeneous", "crow-amsaa", "duane", "cox-lewis") for n, v in renewal.fit_intensity(events.withColumn("x", F.col("x") / 1000), k).items()]
    return spark.createDataFrame(rows, "model string, param string, value double")


@_query("SELECT CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(x - p), 4) AS total FROM (SELECT x, COALESCE(LAG(x) OVER (PARTITION BY i ORDER BY x), 0) AS p FROM (SELECT user_id AS i, ROUND(date_diff('second', TIMESTAMP '2020-01-01', ts) / 3600.0::DOUBLE, 6) AS x FROM events))")
def rescaled_gaps(spark, sf_dir):
    out = renewal.rescaled_gaps(_rec(spark, sf_dir), lambda t: t)
    return out.agg(F.count("*").alias("n"), F.round(F.sum("residual"), 4).alias("total"))


@_query(f"""WITH {_CURVE}, s AS (SELECT g, x, r, d, km * GREATEST(0, LEAST(60.0::DOUBLE, LEAD(x, 1, 60.0::DOUBLE) OVER (PARTITION BY g ORDER BY x)) - x) AS a,
  CASE WHEN ROW_NUMBER() OVER (PARTITION BY g ORDER BY x) = 1 THEN LEAST(60.0::DOUBLE, x) ELSE 0 END AS f FROM curve), m AS (SELECT g, SUM(a + f) AS m FROM s GROUP BY g)
SELECT p.g AS a, q.g AS b, ROUND(p.m - q.m, 5) AS difference, ROUND(p.m / q.m, 6) AS ratio FROM m p JOIN m q ON p.g < q.g""")
def restricted_mean_difference(spark, sf_dir):
    out = curves.restricted_mean_difference(_curve(spark, sf_dir), "g", 60.0)
    return out.select("a", "b", F.round("difference", 5).alias("difference"), F.round("ratio", 6).alias("ratio"))


@_query(f"""WITH {_CURVE}, l AS (SELECT g, x, km, CASE WHEN km = 1 THEN 1 WHEN km > 0 AND greenwood IS NOT NULL THEN EXP(-EXP(LN(-LN(km)) - 1.959963984540054 * SQRT(greenwood) / LN(km))) END AS lo,
 CASE WHEN km = 1 THEN 1 WHEN km > 0 AND greenwood IS NOT NULL THEN EXP(-EXP(LN(-LN(km)) + 1.959963984540054 * SQRT(greenwood) / LN(km))) END AS hi FROM curve),
b AS (SELECT g, x, COALESCE(lo, 0) AS lo, COALESCE(hi, MIN(hi) OVER (PARTITION BY g)) AS hi FROM l)
SELECT g, MIN(CASE WHEN lo <= 0.5 THEN x END) AS lower, MIN(CASE WHEN hi < 0.5 THEN x END) AS upper FROM b GROUP BY g""")
def median_limits(spark, sf_dir):
    return curves.quantile_limits(curves.confidence_limits(_curve(spark, sf_dir), by=("g",)), 0.5, ("g",))


@_query()
def bootstrap_limits(spark, sf_dir):
    return curves.bootstrap_limits(observations.observations(shipments(spark, sf_dir), x="x", c="c"), [10.0, 45.0], replicates=20)


@_query()
def simultaneous_band(spark, sf_dir):
    table = risk.simple_risk_table(observations.observations(shipments(spark, sf_dir), x="x", c="c"))
    n = table.agg(F.max("r")).first()[0]
    return curves.simultaneous_band(curves.survival_curves(table), n).select("x", "km", "lower", "upper")


@_query(f"""WITH {_OBS}, m AS (SELECT g, AVG(x) AS a, AVG(x * x) - AVG(x) * AVG(x) AS v FROM obs GROUP BY g)
SELECT g, ROUND(a, 6) AS normal_mu, ROUND(SQRT(v), 6) AS normal_sigma, ROUND(a * a / v, 6) AS gamma_alpha, ROUND(a / v, 8) AS gamma_beta, ROUND(a - SQRT(3) * SQRT(v), 5) AS uniform_a FROM m""")
def moment_fits(spark, sf_dir):
    m = fit.fit_moments(_obs(spark, sf_dir), ("g",))
    digits = {"normal_mu": 6, "normal_sigma": 6, "gamma_alpha": 6, "gamma_beta": 8, "uniform_a": 5}
    return m.select("g", *[F.round(k, d).alias(k) for k, d in digits.items()])


@_query()
def other_fits(spark, sf_dir):
    own = observations.observations(shipments(spark, sf_dir).filter("x > 0"), x="x", c="c")
    complete = observations.observations(datasets.bearings(spark), x="x")
    rows = [("spacings", k, v) for k, v in fit.fit_spacings(complete).items()]
    rows += [("curve", k, v) for k, v in fit.fit_curve(curves.survival_curves(risk.simple_risk_table(own))).items()]
    cure = fit.fit_defective(observations.observations(datasets.circuits(spark), x="x", c="c", n="n"))
    rows += [("defective", k, v) for k, v in [*cure.params.items(), *cure.extra.items()]]
    rows += [("mixture", f"{n}_{j}", v) for j, t in enumerate(fit.fit_mixture(complete)) for n, v in zip(("weight", "alpha", "beta"), t)]
    return spark.createDataFrame(rows, "method string, param string, value double")


@_query(f"""WITH {_DEG}, c AS (SELECT i, x - AVG(x) OVER (PARTITION BY i) AS z, AVG(x) OVER (PARTITION BY i) AS o, y FROM y),
s AS (SELECT i AS unit, CAST(COUNT(*) AS DOUBLE) AS m, SUM(z*z) AS s2, SUM(z*z*z) AS s3, SUM(z*z*z*z) AS s4, SUM(y) AS t0, SUM(z*y) AS t1, SUM(z*z*y) AS t2 FROM c GROUP BY i HAVING COUNT(*) > 4)
SELECT unit, ROUND((m * (s2 * t2 - s3 * t1) - s2 * s2 * t0) / (m * (s2 * s4 - s3 * s3) - s2 * s2 * s2), 6) AS c FROM s""")
def quadratic_paths(spark, sf_dir):
    return degradation.quadratic_paths(_paths(spark, sf_dir), "user_id", "x", "y").filter("m > 4").select("unit", F.round("c", 6).alias("c"))


@_query()
def gamma_process(spark, sf_dir):
    shape, scale = degradation.gamma_process_fit(degradation.increments(_paths(spark, sf_dir), "user_id", "x", "y"))
    return spark.createDataFrame([(shape, scale)], "shape double, scale double")


@_query(f"""WITH {_EV}, w AS (SELECT i, x FROM ev WHERE (x >= 0 AND x <= 200) OR (x >= 300 AND x <= 100000)) SELECT i, COUNT(*) AS n, ROUND(SUM(CASE WHEN x <= 200 THEN 0 ELSE 300 END), 3) AS entries FROM w GROUP BY i""")
def observation_windows(spark, sf_dir):
    ev = _rec(spark, sf_dir)
    items = ev.select("i").distinct()
    spans = F.explode(F.array(F.struct(F.lit(0.0).alias("start"), F.lit(200.0).alias("end")), F.struct(F.lit(300.0).alias("start"), F.lit(100000.0).alias("end"))))
    windows = items.select("i", spans.alias("s")).select("i", "s.start", "s.end")
    return recurrent.in_windows(ev, windows).groupBy("i").agg(F.count("*").alias("n"), F.round(F.sum("tl"), 3).alias("entries"))


@_query(f"""WITH {_RR}, m AS (SELECT x, SUM(d / r) OVER (ORDER BY x) AS m, SUM((d * (1 - 1 / r) * (1 - 1 / r) + (r - d) / (r * r)) / (r * r)) OVER (ORDER BY x) AS v FROM rr)
SELECT x, ROUND(m / EXP(1.959963984540054 * SQRT(v) / m), 6) AS lower, ROUND(m * EXP(1.959963984540054 * SQRT(v) / m), 6) AS upper FROM m""")
def mcf_limits(spark, sf_dir):
    out = recurrent.mcf_limits(recurrent.mean_cumulative(risk.recurrent_risk_table(_rec(spark, sf_dir))))
    return out.select("x", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@_query(ORACLE_SQL["brier_score"].replace("SELECT t, ROUND(AVG(", "SELECT t, (AVG(").replace(", 8) AS brier", ") AS brier").join(["SELECT ROUND(SUM(dt * m) / (MAX(t) - MIN(t)), 7) AS ibs FROM (SELECT t, t - LAG(t) OVER (ORDER BY t) AS dt, (brier + LAG(brier) OVER (ORDER BY t)) / 2 AS m FROM (", "))"]))
def integrated_brier_score(spark, sf_dir):
    own = shipments(spark, sf_dir).withColumns({f"s{t}": F.exp(F.lit(-t / 60.0)) for t in (30, 60, 90)})
    return metrics.integrated_brier_score(metrics.brier_score(own, "x", "c", {30.0: "s30", 60.0: "s60", 90.0: "s90"})).select(F.round("ibs", 7).alias("ibs"))


@_query("""WITH p AS (SELECT p_partkey, p_size AS k, CAST(p_size AS DOUBLE) AS x FROM part), s AS (SELECT p_partkey, x,
 list_sum(list_transform(range(0, k + 1), lambda j: EXP(-20 + j * LN(20) - LGAMMA(j + 1)))) AS po, list_sum(list_transform(range(0, k + 1), lambda j: EXP(LGAMMA(61) - LGAMMA(j + 1) - LGAMMA(61 - j) + j * LN(0.4) + (60 - j) * LN(0.6)))) AS bi,
 list_sum(list_transform(range(0, k), lambda j: EXP(LGAMMA(j + 3) - LGAMMA(j + 1) - LGAMMA(3) + 3 * LN(0.2) + j * LN(0.8)))) AS nb FROM p)
SELECT p_partkey, ROUND(1 - po, 6) AS poisson, ROUND(1 - bi, 6) AS binomial, ROUND(1 - nb, 6) AS negative_binomial, ROUND(EXP(LGAMMA(5 + x) - LGAMMA(7 + x) - LGAMMA(5) + LGAMMA(7)), 6) AS beta_geometric,
ROUND(1 - x / 60 * x / 60 * (6 - 8 * x / 60 + 3 * x / 60 * x / 60), 6) AS beta4 FROM s""")
def count_distributions(spark, sf_dir):
    x = F.col("p_size").cast("double")
    args = {"poisson": (20.0,), "binomial": (60.0, 0.4), "negative_binomial": (3.0, 0.2), "beta_geometric": (2.0, 5.0), "beta4": (2.0, 3.0, 0.0, 60.0)}
    return _read(spark, sf_dir, "part").select("p_partkey", *[F.round(DISTRIBUTIONS[k].sf(x, *a), 6).alias(k) for k, a in args.items()])


@_query()
def buckley_james(spark, sf_dir):
    own = shipments(spark, sf_dir).filter("x > 0").withColumn("z", F.col("q") / 50)
    return spark.createDataFrame(list(regression.fit_buckley_james(own, "x", "c", ["z"], steps=8).items()), "covariate string, beta double")


@_query("""WITH p AS (SELECT p_partkey AS start, p_partkey + 1 AS e, p_size // 10 AS v FROM part), n AS (SELECT *, CASE WHEN v = LAG(v) OVER (ORDER BY start) AND start = LAG(e) OVER (ORDER BY start) THEN 0 ELSE 1 END AS k FROM p),
g AS (SELECT *, SUM(k) OVER (ORDER BY start) AS g FROM n) SELECT CAST(v AS BIGINT) AS v, CAST(MIN(start) AS DOUBLE) AS start, CAST(MAX(e) AS DOUBLE) AS "end" FROM g GROUP BY g, v""")
def schedule_runs(spark, sf_dir):
    own = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("double").alias("start"), (F.col("p_partkey") + 1).cast("double").alias("end"), F.floor(F.col("p_size") / 10).cast("long").alias("v"))
    return regression.coalesce_segments(own, "v").select("v", "start", "end")
