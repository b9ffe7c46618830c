"""Running sums, products and last values along a time, split so that no group is one task's work.

A window over all times of a group puts them into one task. Here the times of each group fall into parts, by a rule
that keeps their order and needs no look at the data. Every part's total is a row of a small table; its running total
is added to the next part as a first row, the carry, and a window within (group, part) then gives the whole
running value. There is no join, and null groups are groups like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART, ROW = "__part", "__row"
#: Parts for each factor e between times, at most; durations of data mostly lie within three or four such factors.
DENSITY = 64
#: Beyond the logarithm of any finite double.
_RANGE = 760


@dataclass(frozen=True)
class Run:
    """One running value: kind is sum, product, max, min or last (the latest value that isn't null).

    before: without the row's own value.
    """

    kind: str
    value: Column
    before: bool = False


def total(value: Column, before: bool = False) -> Run:
    return Run("sum", value, before)


def times(value: Column, before: bool = False) -> Run:
    return Run("product", value, before)


def latest(value: Column, before: bool = False) -> Run:
    return Run("last", value, before)


def _part(order: str) -> str:
    x = f"cast(`{order}` as double)"
    size = f"floor((greatest(-{_RANGE}D, least({_RANGE}D, ln(abs({x})))) + {_RANGE}) * {DENSITY}) + 1"
    return f"cast(case when {x} > 0 then {size} when {x} < 0 then -({size}) else 0 end as bigint)"


def part(order: str) -> Column:
    """The part of a time: its logarithm in steps, with the sign. Logarithms never fall as times rise, so parts don't."""
    return F.expr(_part(order))


_PLAIN = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}
_NEUTRAL = {"sum": 0.0, "product": 1.0}


def running(df: DataFrame, by: tuple[str, ...], order: str, runs: dict[str, Run], descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """The rows with running values along `order` within the groups `by`.

    Sums of nothing are 0, products 1, other kinds null. ties: columns by which rows of equal time are ordered, in the
    same direction. Rows of equal order and ties come in any order.
    """
    way = F.desc if descending else F.asc
    pick = F.min_by if descending else F.max_by
    keys, names, columns = [*by, PART], [f"__v_{k}" for k in runs], df.columns
    # Rows and totals read one table. Both read all of its columns, so their plans are equal down to its last shuffle,
    # and Spark runs what lies below once.
    row = F.expr(f"cast(xxhash64({', '.join(f'`{c}`' for c in columns)}) & 0 as int) + 1").alias(ROW)
    own = df.select("*", part(order).alias(PART), row, *[(r.value if r.kind == "last" else r.value.cast("double")).alias(v) for v, r in zip(names, runs.values())])

    def of_part(r: Run, v: str) -> Column:
        if r.kind == "last":
            return pick(v, F.when(F.col(v).isNotNull(), F.struct(order, *ties)))
        return _PLAIN[r.kind](v)

    def so_far(r: Run, v: str, w) -> Column:
        return F.last(v, True).over(w) if r.kind == "last" else _PLAIN[r.kind](v).over(w)

    # the carry of each part: what all parts before it come to
    totals = own.groupBy(*keys).agg(F.max(ROW).alias(ROW), *[of_part(r, v).alias(v) for v, r in zip(names, runs.values())])
    earlier = Window.partitionBy(*by).orderBy(way(PART)).rowsBetween(Window.unboundedPreceding, -1)
    carried = {PART: F.col(PART), ROW: F.col(ROW) - 1} | {c: F.col(c) for c in by} | {v: so_far(r, v, earlier) for v, r in zip(names, runs.values())}
    carry = totals.select(*[carried[c].alias(c) if c in carried else F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns])
    # the totals come first: a union keeps all names below its first table, which would tell the two plans apart
    both = carry.union(own)
    frame = Window.partitionBy(*keys).orderBy(F.asc(ROW), way(order), *map(way, ties))
    upto = {False: frame.rowsBetween(Window.unboundedPreceding, Window.currentRow), True: frame.rowsBetween(Window.unboundedPreceding, -1)}
    def value(v: str, r: Run) -> Column:
        found = so_far(r, v, upto[r.before])
        return F.coalesce(found, F.lit(_NEUTRAL[r.kind])) if r.kind in _NEUTRAL else found

    kept = [c for c in columns if c not in runs]
    out = both.select(ROW, *kept, *[value(v, r).alias(k) for v, (k, r) in zip(names, runs.items())])
    return out.filter(f"{ROW} = 1").select(*kept, *runs)
