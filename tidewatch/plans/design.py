"""Design columns of regressions from formulas, to be applied again at prediction."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Levels that a category may have.
MOST_LEVELS = 1000
_NAME = r"[A-Za-z_][A-Za-z_0-9.]*"


@dataclass
class Design:
    """What a formula became: the levels of its categories (the first is the base), and the terms in order."""

    terms: list[tuple[str, ...]]
    levels: dict[str, list[str]] = field(default_factory=dict)

    def columns(self) -> dict[str, Column]:
        """Design columns by name; a value that no level has gives zeros in all of a category's columns."""
        out: dict[str, Column] = {}
        for term in self.terms:
            parts: list[tuple[str, Column]] = [("", F.lit(1.0))]
            for name in term:
                if name in self.levels:
                    own = [(f"{name}[{v}]", F.when(F.col(f"`{name}`").cast("string") == v, 1.0).otherwise(0.0)) for v in self.levels[name][1:]]
                else:
                    own = [(name, F.col(f"`{name}`").cast("double"))]
                parts = [(f"{a}:{b}" if a else b, x * y) for a, x in parts for b, y in own]
            out.update(parts)
        return out

    def apply(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """The rows with the design columns z0, z1, ... and what these are called."""
        made = self.columns()
        return df.withColumns({f"z{k}": c for k, c in enumerate(made.values())}), list(made)


def design(df: DataFrame, formula: str) -> Design:
    """The design of a formula such as `age + C(site) + age:dose` or `a * b`; there is no intercept.

    Text columns and C(...) are categories, whose levels are read from the rows; a:b is a product, a * b means a + b + a:b.
    """
    right = formula.split("~")[-1]
    terms: list[tuple[str, ...]] = []
    named: set[str] = set()
    for piece in (t.strip() for t in right.split("+")):
        if piece in ("0", "-1", ""):
            continue
        factors = [f.strip() for f in re.split(r"[:*]", piece)]
        for k, f in enumerate(factors):
            if m := re.fullmatch(rf"C\(\s*({_NAME})\s*\)", f):
                factors[k] = m[1]
                named.add(m[1])
            elif not re.fullmatch(_NAME, f):
                raise ValueError(f"not a term: {f!r}")
            if factors[k] not in df.columns:
                raise ValueError(f"no column {factors[k]!r}")
        if "*" in piece:
            if ":" in piece or len(factors) != 2:
                raise ValueError(f"not a term: {piece!r}")
            terms += [(factors[0],), (factors[1],), tuple(factors)]
        else:
            terms.append(tuple(factors))
    terms = list(dict.fromkeys(terms))
    named |= {n for t in terms for n in t if isinstance(df.schema[n].dataType, StringType)}
    levels = {}
    for n in sorted(named):
        found = [r[0] for r in df.select(F.col(f"`{n}`").cast("string")).filter(F.col(f"`{n}`").isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()]
        if len(found) > MOST_LEVELS:
            raise ValueError(f"over {MOST_LEVELS} levels in {n}")
        levels[n] = sorted(found)
    return Design(terms, levels)
