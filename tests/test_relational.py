import datetime
import math

import duckdb
import pytest

from loamwork.plans import extended, relational, rounds, scale, streams  # noqa: F401
from loamwork.sources import TABLES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=str)


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(relational.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, tables, name):
    found = relational.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({relational.ORACLE_SQL[name]})").fetchall()
    assert rows_of(found.select(*columns).collect()) == rows_of(want)
