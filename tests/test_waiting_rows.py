"""Rows that wait over a long time take few state calls; orders share a state."""

import numpy as np
import pandas as pd

from test_streaming import Clock, Echo, Held, released, shuffled
from tickloom.streaming import sources as ss
from tickloom.streaming import state as st


def test_waiting_rows_over_a_long_time_take_few_state_calls():
    held, p = Held(), Echo()
    p.timed = True
    p.init(held)
    clock = np.random.default_rng(3).permutation(1000) * 60_000  # one a minute: a stretch of its own each
    given = pd.DataFrame({"ts_event": clock * 1_000_000, "sequence": clock, "action": "A", "side": "B", "order_id": "x", "price": 1.5, "size": 3})
    list(p.handleInputRows(("I",), iter([given[:600], given[600:]]), Clock(0)))
    assert len(held.rows) <= 16
    out = lambda mark: [int(q) for f in p.handleExpiredTimer(("I",), Clock(mark), None) for q in f["sequence"]]
    got = [out(m) for m in (1, 20_000_000, 20_000_000, 59_000_000, 70_000_000)]
    assert got[0] == [0] and got[2] == [] and sum(got, []) == sorted(clock) and held.rows == {}


def test_spoofing_by_shares_of_orders(spark, events, frame, tmp_path):
    s = shuffled(spark, events, f"file://{tmp_path}/in").select(*st.EVENT_COLUMNS, st.order_share(2).alias("share"))
    p = st.OrderLives(10, 200_000_000, 60_000)
    live = ss.run_to_table(st.stateful(s, ["instrument", "share"], p, late="500 milliseconds"), f"file://{tmp_path}/out")
    want, added = [], {}
    for r in released(frame, events, 500).orderBy("sequence").collect():
        o = (r["instrument"], r["order_id"])
        if r["action"] == "A":
            added[o] = r
        elif r["action"] == "C" and o in added and added[o]["size"] >= 10 and r["ts_event"] - added[o]["ts_event"] <= 200_000_000:
            want.append((*o, r["sequence"], added[o]["size"], r["ts_event"] - added[o]["ts_event"]))
    cols = ["instrument", "order_id", "sequence", "placed_size", "time_to_cancel"]
    assert want and sorted(tuple(r) for r in live.select(*cols).collect()) == sorted(want)
