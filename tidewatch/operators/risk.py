"""Risk tables: at each distinct time, how many are at risk and how many events happen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.observations import INF
from tidewatch.operators.running import latest, running, total


def risk_table(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, r, d) of canonical rows with flags 0 and 1, weighted by n, with delayed entry.

    r: those who entered by x (tl <= x) and neither failed nor left before x. One aggregation by time, then
    one running sum: entries add at tl, exits take off after x, so no range join is needed.
    """
    own = obs.filter(F.col("c").isin(0, 1))
    failed = F.when(F.col("c") == 0, F.col("n")).otherwise(0.0)
    # entries at a time count before the events at that time; a time of entries alone gives no row
    moves = own.select(*by, F.explode(F.array(
        F.struct(F.col("x").alias("x"), failed.alias("d"), F.col("n").alias("out"), F.lit(0.0).alias("came"), F.lit(True).alias("real")),
        F.struct(F.col("tl").alias("x"), F.lit(0.0).alias("d"), F.lit(0.0).alias("out"), F.col("n").alias("came"), F.lit(False).alias("real")))).alias("m")).select(*by, "m.*")
    grid = moves.groupBy(*by, "x").agg(F.sum("d").alias("d"), F.sum("out").alias("out"), F.sum("came").alias("came"), F.max("real").alias("real"))
    cum = running(grid, by, "x", {"came_by": total(F.col("came")), "out_by": total(F.col("out"), before=True)})
    return cum.filter("real").select(*by, "x", (F.col("came_by") - F.col("out_by")).alias("r"), "d")


def simple_risk_table(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, r, d) where nobody enters late: one aggregation and one running sum from the right."""
    grid = obs.groupBy(*by, "x").agg(F.sum(F.when(F.col("c") == 0, F.col("n")).otherwise(0.0)).alias("d"), F.sum("n").alias("out"))
    return running(grid, by, "x", {"r": total(F.col("out"))}, descending=True).select(*by, "x", "r", "d")


def to_observations(risk: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows that give a risk table back: failures, and suspensions where more leave than fail."""
    after = running(risk, by, "x", {"after": latest(F.col("r"), before=True)}, descending=True)
    gone = after.withColumn("s", F.abs(F.col("r") - F.coalesce("after", F.lit(0.0))) - F.col("d"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("c"), F.col("d").alias("n")), F.struct(F.lit(1).alias("c"), F.col("s").alias("n"))))
    rows = gone.select(*by, "x", F.col("x").alias("x_hi"), kinds.alias("k")).select(*by, "x", "x_hi", "k.c", "k.n").filter("n > 0")
    return rows.withColumns({"tl": F.lit(-INF), "tr": F.lit(INF)})


def recurrent_risk_table(events: DataFrame, by: tuple[str, ...] = (), mark: str | None = None) -> DataFrame:
    """(by, x, r, d) of recurrent rows (i, x, c, n, tl): items under observation and events at each time.

    An item is at risk from its entry to its last row. With `mark`, d counts the events of that mark only, while
    the times and the risk set stay those of all events.
    """
    item = events.groupBy(*by, "i").agg(F.max("x").alias("last"), F.min(F.coalesce("tl", F.lit(-INF))).alias("tl"))
    hit = F.when(F.col("c") != 1, F.col("n")).otherwise(0.0)
    if mark is not None:
        hit = F.when(F.col("e") == mark, hit).otherwise(0.0)
    grid = events.groupBy(*by, "x").agg(F.sum(hit).alias("d"))
    flat = lambda df, x, plus, minus: df.select(*by, F.col(x).alias("x"), F.lit(0.0).alias("d"), F.lit(plus).alias("plus"), F.lit(minus).alias("minus"), F.lit(False).alias("real"))
    moves = grid.select(*by, "x", "d", F.lit(0.0).alias("plus"), F.lit(0.0).alias("minus"), F.lit(True).alias("real"))
    moves = moves.unionByName(flat(item, "tl", 1.0, 0.0)).unionByName(flat(item, "last", 0.0, 1.0))
    whole = moves.groupBy(*by, "x").agg(F.sum("d").alias("d"), F.sum("plus").alias("plus"), F.sum("minus").alias("minus"), F.max("real").alias("real"))
    cum = running(whole, by, "x", {"in_by": total(F.col("plus")), "out_by": total(F.col("minus"), before=True)})
    return cum.filter("real").select(*by, "x", (F.col("in_by") - F.col("out_by")).alias("r"), "d")
