import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def events():
    """Random order events: one key holds most rows, some clocks tie, books get cleared."""
    r = np.random.default_rng(7)
    n = 900
    gaps = r.integers(0, 3, n) * 1_000_000
    pdf = pd.DataFrame(
        {
            "instrument": np.where(r.random(n) < 0.8, "HOT", "COLD"),
            "ts_event": 1_700_000_000_000_000_000 + np.cumsum(gaps),
            "sequence": np.arange(n),
            "action": r.choice(["A", "C", "F", "M", "R"], n, p=[0.5, 0.2, 0.17, 0.12, 0.01]),
            "side": r.choice(["B", "A", "N"], n, p=[0.47, 0.47, 0.06]),
            "order_id": r.integers(0, 60, n).astype(str),
            "price": 100 + 0.25 * r.integers(0, 12, n),
            "size": r.integers(1, 40, n),
        }
    )
    return pdf


@pytest.fixture(scope="session")
def frame(spark, events):
    return spark.createDataFrame(events).repartition(5).cache()
