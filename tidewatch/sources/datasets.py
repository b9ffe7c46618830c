"""Well-known small data sets, tables as JSON, and a catalogue of fitted models."""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Published data, by source.
BEARINGS = (17.88, 28.92, 33, 41.52, 42.12, 45.6, 48.4, 51.84, 51.96, 54.12, 55.56, 67.8, 68.64, 68.64, 68.88, 84.12, 93.12, 98.64, 105.12, 105.84, 127.92, 128.04, 173.4)
RENEWAL_GAPS = (3, 6, 11, 5, 16, 9, 19, 22, 37, 23, 31, 45)
STEEL = ((40.8, 10), (42.075, 23), (43.35, 48), (44.625, 80), (45.9, 63), (47.175, 65), (48.45, 47), (49.725, 33), (51.0, 14), (53.55, 6))
AUTOMOTIVE_FAILURES = (5248, 7454, 16890, 17200, 38700, 45000, 49390, 69040, 72280, 131900)
AUTOMOTIVE_SUSPENSIONS = (3961, 4007, 4734, 6054, 7298, 10190, 23060, 27160, 28690, 37100, 40060, 45670, 53000, 67000, 69630, 77350, 78470, 91680, 105700, 106300, 150400)
CIRCUITS = (0.1, 0.1, 0.15, 0.6, 0.8, 0.8, 1.2, 2.5, 3, 4, 4, 6, 10, 10, 12.5, 20, 20, 43, 43, 48, 48, 54, 74, 84, 94, 168, 263, 593)
CIRCUITS_TESTED, CIRCUITS_END = 4156, 1370.0
GENERAL_REPAIR = {
    1: (2227.08, 2733.229, 3524.214, 5568.634, 5886.165, 5946.301, 6018.219, 7202.724, 8760), 2: (772.9542, 1034.458, 3011.114, 3121.458, 3624.158, 3758.296, 5000),
    3: (900.9855, 1289.95, 2689.878, 3928.824, 4328.317, 4704.24, 5052.586, 5473.171, 6200), 4: (411.407, 1122.74, 1300), 5: (688.897, 915.101, 2650), 6: (105.824, 500),
}


def bearings(spark: SparkSession) -> DataFrame:
    """Cycles to failure of ball bearings, in millions: x."""
    return spark.createDataFrame([(float(v),) for v in BEARINGS], "x double")


def renewal_system(spark: SparkSession) -> DataFrame:
    """Failure times of one repairable system: x."""
    return spark.createDataFrame([(float(v),) for v in accumulate(RENEWAL_GAPS)], "x double")


def steel(spark: SparkSession) -> DataFrame:
    """Tensile strength of steel specimens: x, n."""
    return spark.createDataFrame([(float(x), n) for x, n in STEEL], "x double, n int")


def automotive(spark: SparkSession) -> DataFrame:
    """Heavily censored failures: x, c."""
    rows = [(float(v), 0) for v in AUTOMOTIVE_FAILURES] + [(float(v), 1) for v in AUTOMOTIVE_SUSPENSIONS]
    return spark.createDataFrame(rows, "x double, c int")


def circuits(spark: SparkSession) -> DataFrame:
    """A life test in which few can fail at all: x, c, n."""
    failures = spark.createDataFrame([(float(v),) for v in CIRCUITS], "x double").groupBy("x").agg(F.count("*").alias("n"))
    rest = spark.createDataFrame([(CIRCUITS_END, 1, CIRCUITS_TESTED - len(CIRCUITS))], "x double, c int, n long")
    return failures.select("x", F.lit(0).alias("c"), "n").unionByName(rest)


def general_repair(spark: SparkSession) -> DataFrame:
    """Failures of six repairable systems, each ended by censoring: x, i, c."""
    return spark.createDataFrame([(float(v), i, int(k == len(xs) - 1)) for i, xs in GENERAL_REPAIR.items() for k, v in enumerate(xs)], "x double, i int, c int")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header; give a schema for data of any size, so that it is read once."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_observations(obs: DataFrame, path: str) -> None:
    """Canonical rows as JSON lines."""
    obs.write.json(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Rows that write_observations wrote; infinite windows come back as infinities."""
    return spark.read.schema("x double, x_hi double, c int, n double, tl double, tr double").json(path)


def to_event_time(df: DataFrame, x: str, c: str) -> DataFrame:
    """(event, time) as other libraries want them."""
    return df.select((F.col(c) == 0).alias("event"), F.col(x).cast("double").alias("time"))


SCHEMA_VERSION = 1


def save_model(spark: SparkSession, path: str, name: str, kind: str, payload: dict) -> None:
    """Add a fitted model to the catalogue at `path`."""
    spark.createDataFrame([(name, kind, SCHEMA_VERSION, json.dumps(payload))], "name string, kind string, version int, payload string").write.mode("append").parquet(path)


def load_model(spark: SparkSession, path: str, name: str) -> tuple[str, dict]:
    """(kind, payload) of a model; models of a newer version are refused."""
    row = spark.read.parquet(path).filter(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    if row.version > SCHEMA_VERSION:
        raise ValueError(f"model of version {row.version}; this engine reads up to {SCHEMA_VERSION}")
    return row.kind, json.loads(row.payload)


def save_curve(curve: DataFrame, path: str) -> None:
    """A curve with all its columns, as a table."""
    curve.write.parquet(path)


def load_curve(spark: SparkSession, path: str) -> DataFrame:
    """A curve that save_curve wrote; ValueError if it isn't one."""
    found = spark.read.parquet(path)
    if not {"x", "r", "d"} <= set(found.columns) and not {"x", "km"} <= set(found.columns):
        raise ValueError(f"no curve at {path}")
    return found


def save_life_model(spark: SparkSession, path: str, name: str, model) -> None:
    """Add a model (functions.models) to the catalogue at `path`."""
    save_model(spark, path, name, type(model).__name__, json.loads(model.to_json()))


def load_life_model(spark: SparkSession, path: str, name: str):
    """A model that save_life_model wrote, ready to use."""
    from tidewatch.functions.models import from_json

    return from_json(json.dumps(load_model(spark, path, name)[1]))
