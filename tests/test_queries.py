"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tests.conftest import DATA
from tidewatch.plans import model_queries  # noqa: F401  registers its queries
from tidewatch.plans.queries import ORACLE_SQL, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows):
    out = []
    for row in rows:
        out.append(tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) + 0.0 if isinstance(v, (int, float)) else str(v) for v in row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    assert got
    if name in ORACLE_SQL:
        want = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
        assert len(got) == len(want)
        for a, b in zip(plain(got), plain(want)):
            assert a == pytest.approx(b, abs=2e-6) if all(isinstance(v, float) for v in a) else a == b
