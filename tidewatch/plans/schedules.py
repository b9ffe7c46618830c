"""Step-valued covariate schedules written as expressions of t."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.regression import coalesce_segments

#: Functions that an expression may use, and their names in SQL; those that make steps of t.
FUNCTIONS = {"abs": "abs", "sqrt": "sqrt", "exp": "exp", "log": "ln", "sin": "sin", "cos": "cos", "min": "least", "max": "greatest", "floor": "floor", "ceil": "ceil", "round": "round"}
STEPS = frozenset(("floor", "ceil", "round"))
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%"}
_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "<>"}


class ContinuousSchedule(ValueError):
    """An expression that changes with t between its steps."""


def _varies(node: ast.AST) -> bool:
    """Whether a value changes continuously with t: t itself, but for within a comparison or a rounding."""
    if isinstance(node, ast.Name):
        return node.id == "t"
    if isinstance(node, ast.Compare) or isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in STEPS:
        return False
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.FloorDiv):
        return False
    if isinstance(node, ast.IfExp):
        return _varies(node.body) or _varies(node.orelse)
    return any(_varies(n) for n in ast.iter_child_nodes(node))


def _sql(node: ast.AST) -> str:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return f"{float(node.value)!r}D"
    if isinstance(node, ast.Name) and node.id == "t":
        return "t"
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd, ast.Not)):
        return f"({'not ' if isinstance(node.op, ast.Not) else '-' if isinstance(node.op, ast.USub) else ''}{_sql(node.operand)})"
    if isinstance(node, ast.BinOp):
        a, b = _sql(node.left), _sql(node.right)
        if isinstance(node.op, ast.Pow):
            return f"power({a}, {b})"
        if isinstance(node.op, ast.FloorDiv):
            return f"floor({a} / {b})"
        if type(node.op) in _BINARY:
            return f"({a} {_BINARY[type(node.op)]} {b})"
    if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
        sides = [node.left, *node.comparators]
        return "(" + " and ".join(f"{_sql(a)} {_COMPARE[type(o)]} {_sql(b)}" for a, o, b in zip(sides, node.ops, sides[1:])) + ")"
    if isinstance(node, ast.BoolOp):
        return "(" + (" and " if isinstance(node.op, ast.And) else " or ").join(map(_sql, node.values)) + ")"
    if isinstance(node, ast.IfExp):
        return f"if({_sql(node.test)}, {_sql(node.body)}, {_sql(node.orelse)})"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
        return f"{FUNCTIONS[node.func.id]}({', '.join(map(_sql, node.args))})"
    raise ValueError(f"not allowed in a schedule: {ast.dump(node)[:80]}")


def from_expression(spark: SparkSession, expression: str, horizon: float, resolution: float = 1.0, start: float = 0.0) -> DataFrame:
    """(start, end, value): a schedule sampled at steps of `resolution` up to the horizon, equal neighbours joined.

    The language has numbers, t, arithmetic, comparisons, and/or/not, `a if b else c` and a few functions; nothing
    else is evaluated. A value that changes with t other than in steps raises ContinuousSchedule.
    """
    tree = ast.parse(expression, mode="eval").body
    sql = _sql(tree)
    if _varies(tree):
        raise ContinuousSchedule(expression)
    n = max(1, int(-(-(horizon - start) // resolution)))
    grid = spark.range(n).select((start + F.col("id") * resolution).alias("t"))
    own = grid.select(F.col("t").alias("start"), F.least(start + (F.round((F.col("t") - start) / resolution) + 1) * resolution, F.lit(float(horizon))).alias("end"), F.expr(f"cast({sql} as double)").alias("value"))
    return coalesce_segments(own, "value").select("start", "end", "value")
