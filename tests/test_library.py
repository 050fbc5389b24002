"""Inventory, canonical columns, user functions and a sample of oracle queries."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import norm
from support import SF
from tickloom.functions import batches, canonical
from tickloom.operators import models
from tickloom.sources import inventory


def test_duplicate_files_keep_one(spark, tmp_path):
    for name, text in (("a_20240101_x.csv", "same"), ("b_20240102_x.csv", "same"), ("c.csv", "diff")):
        (tmp_path / name).write_text(text)
    files = inventory.list_files(spark, f"file://{tmp_path}")
    dup = inventory.duplicates(files).collect()
    assert sorted((r["file_name"], r["is_duplicate"]) for r in dup) == [("a_20240101_x.csv", False), ("b_20240102_x.csv", True)]
    assert [r["date"] for r in inventory.dates_in_names(files).collect()] == ["20240102", "20240101"]


def test_required_columns(spark):
    d = spark.range(3).withColumnRenamed("id", "x")
    with pytest.raises(ValueError):
        canonical.with_required(d)


def test_groups_in_one_piece_and_merged(frame, events):
    schema = "instrument string, n long, most double"
    whole = lambda p: pd.DataFrame({"instrument": [p.instrument.iloc[0]], "n": [len(p)], "most": [p.price.max()]})
    merge = lambda p: pd.DataFrame({"instrument": [p.instrument.iloc[0]], "n": [p.n.sum()], "most": [p.most.max()]})
    one = batches.process_groups(frame, ["instrument"], whole, schema)
    parts = batches.combine_groups(frame, ["instrument"], whole, merge, schema)
    want = sorted((k, len(g), g.price.max()) for k, g in events.groupby("instrument"))
    assert sorted(map(tuple, one.collect())) == want == sorted(map(tuple, parts.collect()))


def test_ensemble_weights_must_sum(spark):
    p = spark.createDataFrame([("a", 1, 1.0, 0.1, 0.5)], "model string, k int, direction double, price_change double, confidence double")
    w = spark.createDataFrame([("a", 60.0)], "model string, weight double")
    with pytest.raises(ValueError):
        models.ensemble(p, w, ["k"])


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


SAMPLE = [
    "footprint_minute", "support_resistance", "order_lifecycle", "asof_last_price", "book_levels_clamped",
    "tick_filter_trading_hours", "rsi", "label_3class", "backtest_simple", "inventory_rollup",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=str)
