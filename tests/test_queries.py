"""Every query without training-data operators against its SQL twin, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from selvage.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) if abs(v) < 2**53 else int(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(records, columns):
    order = sorted(columns)
    return sorted((tuple(plain(r[c]) for c in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows([r.asDict() for r in df.collect()], df.columns)
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.astype(object).to_dict("records"), list(want.columns))
