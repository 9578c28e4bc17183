"""Every query against DuckDB on the smallest tables."""

import numbers
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tradewind.plans import registry

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(x) -> str:
    if pd.isna(x):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (numbers.Number, np.number)):
        return f"{float(x):.9g}"
    return str(x)[:19].replace(" 00:00:00", "") if hasattr(x, "year") else str(x)


def rows(df: pd.DataFrame) -> tuple[list, list]:
    df = df[sorted(df.columns)]
    lists = lambda x: x.tolist() if isinstance(x, np.ndarray) else x
    value = lambda x: str(lists(x)) if isinstance(x, (np.ndarray, list, dict, tuple)) else plain(x)
    return list(df.columns), sorted(tuple(map(value, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got, want = registry.queries()[name](spark, str(SF)).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
