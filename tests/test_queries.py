"""Every registered query against its SQL form in DuckDB, on the tables in QUERY_SF_DIR; those without SQL must run."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from alertmill.plans import addresses, analysis, decided, documents, exports, extra, measures, queries, registry, reports, streams  # noqa: F401  (they fill the registry)

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def as_rows(frame: pd.DataFrame) -> list[str]:
    """Rows as text, columns by name, floats to nine digits, in any order."""

    def cell(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
            return "[" + ",".join(map(cell, x if isinstance(x, (list, tuple)) else x.tolist() if x.ndim else [x.item()])) + "]"
        if isinstance(x, dict):
            return "{" + ",".join(f"{k}:{cell(v)}" for k, v in sorted(x.items())) + "}"
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool):
            return str(x)
        return f"{float(x):.9g}" if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)

    names = sorted(frame.columns)
    return sorted("|".join(cell(row[k]) for k in range(len(names))) for row in frame[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF_DIR)
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns, dtype=object)
    assert as_rows(rows) == as_rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_point_is_the_registry():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
