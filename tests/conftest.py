"""One local session for all tests, and an engine to hold results against."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("ODFLUX_DRIVER_MEMORY", "6g")
    from odflux.session import build_session, ship_package

    session = build_session("odflux-tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    """A value without types that differ between engines; floats to nine digits."""
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(plain(x) for x in value)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(x)) for k, x in value.items()))
    return value


def canonical(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir, duck):
    """Hold a query against its SQL over the same files."""

    def check(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        got = canonical(df.select(*[f"`{c}`" for c in columns]).collect())
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert [names[i] for i in order] == columns
        assert got == canonical([[r[i] for i in order] for r in rel.fetchall()])

    return check
