"""Queries in the form for huge keys give what their SQL says.

A sample here; CHECK_HOT=1 python check_oracle.py runs every query in that form.
"""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check_oracle import norm
from support import SF

NAMES = [
    "detector_summaries", "iceberg_events", "book_quotes_at_events", "horizon_price_and_volatility", "flow_autocorrelation",
    "trade_technicals", "asof_last_price", "walk_forward_by_rows", "user_rolling_function", "var_cvar",
    "trade_runs", "barrier_exits", "position_average_cost", "rolling_time_flow",
]


@pytest.fixture(scope="module")
def hot(spark):
    for key, value in (("tickloom.hotKeyRows", "50"), ("tickloom.cellRows", "80")):
        spark.conf.set(key, value)
    yield spark
    for key in ("tickloom.hotKeyRows", "tickloom.cellRows"):
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_hot_form(hot, duck, name):
    df = queries()[name](hot, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=str)
