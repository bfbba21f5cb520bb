"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tapewright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        cells = []
        for x in row:
            if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
                cells.append("null")
            elif isinstance(x, (bool,)) or type(x).__name__ == "bool":
                cells.append(str(bool(x)))
            elif isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf":
                cells.append(f"{round(float(x), 4) + 0.0:.4f}")
            else:
                cells.append(str(x)[:19] if hasattr(x, "year") else str(x))
        out.append(tuple(cells))
    return sorted(out)


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.QUERIES.items() if sql])
def test_query_matches_sql(spark, duck, name):
    build, sql = registry.QUERIES[name]
    got, want = build(spark, SF).toPandas(), duck.execute(sql).fetchdf()
    for df in (got, want):
        for c in df.columns:
            if str(df[c].dtype).startswith("datetime") or df[c].map(lambda x: hasattr(x, "year")).any():
                df[c] = df[c].map(lambda x: None if pd.isna(x) else str(x)[:19].removesuffix(" 00:00:00"))
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b) if x != y and not all(p == q or _close(p, q) for p, q in zip(x, y))]
    assert not off, off[:3]


def _close(p: str, q: str) -> bool:
    try:
        return abs(float(p) - float(q)) <= 2e-4 * max(1.0, abs(float(q)))
    except ValueError:
        return False


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.QUERIES.items() if not sql])
def test_query_runs(spark, name):
    rows = registry.QUERIES[name][0](spark, SF).collect()
    assert len({len(r) for r in rows}) <= 1
