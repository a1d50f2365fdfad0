"""Every plan with SQL gives the rows that DuckDB gives on the same tables; the others run."""

from pathlib import Path

import duckdb
import pytest

from tidewatch import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return "[" + ",".join(map(text, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted("|".join(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_plan(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    if name in plans.ORACLE_SQL:
        asked = duck.execute(plans.ORACLE_SQL[name])
        assert got == digest([c[0] for c in asked.description], asked.fetchall())
