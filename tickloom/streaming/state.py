"""Stateful stream operators on ``transformWithStateInPandas``.

State is keyed, so Spark spreads keys over tasks; each processor keeps only what its
result needs (live levels, live orders, a bounded tail) and expires the rest.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_COLUMNS = ["instrument", "event_time", "ts_event", "sequence", "action", "side", "order_id", "price", "size"]


def use_rocksdb(spark) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(rows)
    if not parts:
        return pd.DataFrame()
    return pd.concat(parts, ignore_index=True).sort_values(["ts_event", "sequence"], kind="stable")


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as one Arrow stream."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all().to_pandas()


class Released(StatefulProcessor):
    """Applies events in event-time order across micro-batches.

    Rows wait in map state until the watermark has passed them, as Arrow bytes by stretch of
    ``bucket_ms`` of event time and by arrival; an arrival that reaches over more than
    ``most`` of them is held by longer stretches, so state calls follow the batches of rows
    and not their clocks. A timer at the oldest waiting row releases what is due, sorted, to
    ``apply``: it reads the stretches that are due and writes back the rest of those that the
    watermark stands in; later ones are not touched, however long they are. Rows behind
    the watermark are dropped by it, so the order of arrival never changes a result.
    Without a watermark (``late=None``) rows are applied as they come.
    """

    timed = False
    bucket_ms = 10_000
    most = 8
    columns = ["ts_event", "sequence", "action", "side", "order_id", "price", "size"]

    def wait(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "rows binary")
        self.stretches = handle.getValueState("stretches", "bucket array<long>, first_ms array<long>, parts array<long>")

    def _empty(self) -> pd.DataFrame:
        return pd.DataFrame({c.split()[0]: pd.Series(dtype="float64" if c.endswith("double") else "object") for c in self.output.split(", ")})

    def _known(self) -> dict[int, tuple[int, int]]:
        """Oldest millisecond and number of parts of every stretch with waiting rows."""
        held = self.stretches.get()
        return {} if held is None else {b: (first, n) for b, first, n in zip(*held)}

    def _remember(self, known: dict[int, tuple[int, int]]) -> None:
        if known:
            self.stretches.update(([*known], [first for first, _ in known.values()], [n for _, n in known.values()]))
        else:
            self.stretches.clear()

    def handleInputRows(self, key, rows, timerValues):
        if not self.timed:
            yield from self.apply(key, _sorted(rows))
            return
        known, due = self._known(), None
        for pdf in rows:
            ms = pdf["ts_event"] // 1_000_000
            due = int(ms.min()) if due is None else min(due, int(ms.min()))
            bucket_of, wide = ms // self.bucket_ms, 1
            while (bucket_of // wide).nunique() > self.most:
                wide *= 2
            for bucket, part in pdf[self.columns].groupby(bucket_of // wide * wide, sort=False):
                first, n = known.get(int(bucket), (1 << 62, 0))
                self.waiting.updateValue((int(bucket), n), (_packed(part),))
                known[int(bucket)] = (min(first, int(part["ts_event"].min() // 1_000_000)), n + 1)
        if due is not None:
            self._remember(known)
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs()) + 1)
        yield self._empty()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark, known, ready = timerValues.getCurrentWatermarkInMs(), self._known(), []
        for bucket in sorted(b for b, (first, _) in known.items() if first < mark):
            _, n = known.pop(bucket)
            held = pd.concat([_unpacked(self.waiting.getValue((bucket, i))[0]) for i in range(n)], ignore_index=True)
            for i in range(n):
                self.waiting.removeKey((bucket, i))
            due = held["ts_event"] // 1_000_000 < mark
            ready.append(held[due])
            if not due.all():  # only stretches that the watermark stands in
                rest = held[~due]
                self.waiting.updateValue((bucket, 0), (_packed(rest),))
                known[bucket] = (int(rest["ts_event"].min() // 1_000_000), 1)
        if not ready:
            yield self._empty()
            return
        self._remember(known)
        if known:
            self.handle.registerTimer(max(min(first for first, _ in known.values()), mark) + 1)
        yield from self.apply(key, pd.concat(ready, ignore_index=True).sort_values(["ts_event", "sequence"], kind="stable"))


class LiveBook(Released):
    """Best bid and ask after each event; a clear empties the book."""

    output = "instrument string, ts_event long, sequence long, best_bid double, best_ask double, bid_size long, ask_size long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wait(handle)
        self.levels = handle.getMapState("levels", "side string, price double", "size long")

    def apply(self, key, pdf):
        sizes = {"B": {}, "A": {}}
        for (side, price), (size,) in self.levels.iterator():
            sizes[side][price] = size
        prices = {s: sorted(v) for s, v in sizes.items()}
        touched: set = set()
        out = []
        for r in pdf.itertuples(index=False):
            if r.action == "R":
                touched |= {(s, p) for s, v in sizes.items() for p in v}
                sizes, prices = {"B": {}, "A": {}}, {"B": [], "A": []}
            elif r.side in sizes and r.action in ("A", "C", "F"):
                book, line = sizes[r.side], prices[r.side]
                old = book.get(r.price, 0)
                new = old + r.size if r.action == "A" else max(0, old - r.size)
                touched.add((r.side, r.price))
                if new > 0:
                    if r.price not in book:
                        insort(line, r.price)
                    book[r.price] = new
                elif r.price in book:
                    del book[r.price]
                    line.pop(bisect_left(line, r.price))
            bid = prices["B"][-1] if prices["B"] else None
            ask = prices["A"][0] if prices["A"] else None
            out.append((key[0], r.ts_event, r.sequence, bid, ask, sizes["B"].get(bid), sizes["A"].get(ask)))
        for side, price in touched:
            size = sizes[side].get(price, 0)
            if size > 0:
                self.levels.updateValue((side, price), (int(size),))
            elif self.levels.containsKey((side, price)):
                self.levels.removeKey((side, price))
        cols = ["instrument", "ts_event", "sequence", "best_bid", "best_ask", "bid_size", "ask_size"]
        frame = pd.DataFrame(out, columns=cols)
        yield frame.astype({"best_bid": "float64", "best_ask": "float64", "bid_size": "Int64", "ask_size": "Int64"})

    def close(self) -> None:
        pass


class OrderLives(Released):
    """Cancels of recently added large orders, scored; orders expire after a while.

    Keyed by instrument and a share of its orders (``order_share``): one state holds the live
    orders of a share, so a trigger reads and writes it once, however many orders it touches.
    """

    output = "instrument string, order_id string, ts_event long, sequence long, placed_size long, time_to_cancel long, spoofing_score double"

    def __init__(self, min_size: int = 500, within_ns: int = 5_000_000_000, expire_ms: int = 60_000):
        self.min_size, self.within_ns, self.expire_ms = min_size, within_ns, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wait(handle)
        self.orders = handle.getValueState("orders", "order_id array<string>, added_ts array<long>, size array<long>")

    def _live(self) -> dict[str | None, tuple[int, int]]:
        held = self.orders.get()
        return {} if held is None else {o: (ts, size) for o, ts, size in zip(*held)}

    def _keep(self, live: dict[str | None, tuple[int, int]]) -> None:
        if live:
            self.orders.update(([*live], [ts for ts, _ in live.values()], [size for _, size in live.values()]))
        else:
            self.orders.clear()

    def apply(self, key, pdf):
        out, live, changed = [], self._live(), False
        acts = pdf[pdf["action"].isin(["A", "C"])]
        names = acts["order_id"].astype("object").where(acts["order_id"].notna(), None)
        for order, ts, seq, action, size in zip(names, acts["ts_event"], acts["sequence"], acts["action"], acts["size"]):
            if action == "A":
                live[order], changed = (int(ts), int(size)), True
            elif order in live:
                added, placed = live[order]
                life = ts - added
                if placed >= self.min_size and life <= self.within_ns:
                    score = min(1.0, (self.within_ns - life) / self.within_ns)
                    out.append((key[0], order, ts, seq, placed, life, score))
        if changed:
            self._keep(live)
            if self.timed:
                self.handle.registerTimer(min(ts for ts, _ in live.values()) // 1_000_000 + self.expire_ms)
        cols = ["instrument", "order_id", "ts_event", "sequence", "placed_size", "time_to_cancel", "spoofing_score"]
        yield pd.DataFrame(out, columns=cols)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        now, live = expiredTimerInfo.getExpiryTimeInMs(), self._live()
        kept = {o: x for o, x in live.items() if x[0] // 1_000_000 + self.expire_ms > now}
        if len(kept) < len(live):
            self._keep(kept)
            if kept:
                self.handle.registerTimer(min(ts for ts, _ in kept.values()) // 1_000_000 + self.expire_ms)

    def close(self) -> None:
        pass


def order_share(shares: int = 64) -> Column:
    """Which share of an instrument's orders a row belongs to."""
    return F.pmod(F.xxhash64("order_id"), F.lit(shares)).cast("int")


class IcebergCandidates(Released):
    """Large adds repeated at one price inside a window opened by the first of them.

    Keyed by (instrument, price).
    """

    output = "instrument string, price double, ts_event long, sequence long, replenishment_count long, visible_size long, confidence_score double"
    _cols = ["instrument", "price", "ts_event", "sequence", "replenishment_count", "visible_size", "confidence_score"]

    def __init__(self, min_size: int = 500, refills: int = 3, window_ns: int = 60_000_000_000):
        self.min_size, self.refills, self.window_ns = min_size, refills, window_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wait(handle)
        self.candidate = handle.getValueState("candidate", "first_ts long, last_ts long, n long, visible long, g1 double, g2 double")

    def apply(self, key, pdf):
        out = []
        c = self.candidate.get() if self.candidate.exists() else None
        for r in pdf.itertuples(index=False):
            if r.action != "A" or r.size < self.min_size:
                continue
            if c is None or r.ts_event - c[0] > self.window_ns:
                c = (int(r.ts_event), int(r.ts_event), 1, int(r.size), 0.0, 0.0)
                self.handle.registerTimer(int((r.ts_event + self.window_ns) // 1_000_000) + 1)
            else:
                gap = float(r.ts_event - c[1])
                c = (c[0], int(r.ts_event), c[2] + 1, c[3] + int(r.size), c[4] + gap, c[5] + gap * gap)
            if c[2] >= self.refills:
                n = c[2] - 1
                mean = c[4] / n
                sd = np.sqrt(max(c[5] / n - mean * mean, 0.0))
                conf = min(0.9, 0.8 / (1 + sd / mean)) if mean else 0.8
                out.append((key[0], key[1], r.ts_event, r.sequence, c[2], c[3], conf))
        if c is not None:
            self.candidate.update(c)
        yield pd.DataFrame(out, columns=self._cols)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.candidate.exists():
            first = self.candidate.get()[0]
            if (first + self.window_ns) // 1_000_000 < expiredTimerInfo.getExpiryTimeInMs():
                self.candidate.clear()

    def close(self) -> None:
        pass


class RollingTail(Released):
    """Online features of every row over the last ``n`` rows of its key, kept as list state.

    The same columns as the batch bundle of basic features; running totals reach back over
    the kept rows, and ``rows`` says how many these are.
    """

    output = (
        "instrument string, ts_event long, sequence long, price_change double, direction int, delta double, cum_delta double, imbalance double, volatility double, "
        "size_norm double, delta_norm double, buy_size double, sell_size double, buy_velocity double, sell_velocity double, bid_ask_imbalance_ratio double, "
        "delta_pressure_gradient double, vwap50 double, vwap_dev double, price_mom double, delta_mom double, mom_divergence double, rows long"
    )

    def __init__(self, n: int = 512):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wait(handle)
        self.tail = handle.getListState("tail", "price double, size double, side string")

    def features(self, rows: pd.DataFrame, first: bool) -> pd.DataFrame:
        """Of rows in order; ``first`` says that the first of them is the key's first."""
        price, size = rows["price"].astype("float64"), rows["size"].astype("float64")
        buy, sell = size.where(rows["side"] == "B", 0.0), size.where(rows["side"] == "A", 0.0)
        total = lambda x, k: x.rolling(k, min_periods=1).sum()
        spread = lambda x, k: x.rolling(k, min_periods=2).std().fillna(0.0)
        part = lambda x, y: (x / y.where(y != 0)).fillna(0.0)
        delta, change = buy - sell, price.diff().fillna(0.0)
        ret = change / price.shift().where(price.shift() != 0)
        bought, sold = total(buy, 20), total(sell, 20)
        vwap = (total(price * size, 50) / total(size, 50).where(total(size, 50) != 0)).fillna(price)
        momentum, pressure = total(change, 20), total(delta, 20)
        gradient = delta.copy()
        if first and len(gradient):
            gradient.iloc[0] = 0.0
        return pd.DataFrame(
            {
                "price_change": change, "direction": (change > 0).astype("int32"), "delta": delta, "cum_delta": total(delta, self.n), "imbalance": pressure,
                "volatility": spread(ret, 50), "size_norm": part(size, size.rolling(100, min_periods=1).mean()), "delta_norm": delta / (spread(size, 100) + 1e-6),
                "buy_size": buy, "sell_size": sell, "buy_velocity": bought, "sell_velocity": sold, "bid_ask_imbalance_ratio": part(bought - sold, bought + sold),
                "delta_pressure_gradient": gradient, "vwap50": vwap, "vwap_dev": part(price - vwap, vwap), "price_mom": momentum, "delta_mom": pressure,
                "mom_divergence": momentum.where(momentum.abs() > 1e-9, 1.0) - pressure, "rows": np.minimum(np.arange(1, len(rows) + 1), self.n),
            }
        )

    def apply(self, key, new):
        old = pd.DataFrame(list(self.tail.get()), columns=["price", "size", "side"])
        both = pd.concat([old, new[["price", "size", "side"]]], ignore_index=True) if len(old) else new[["price", "size", "side"]].reset_index(drop=True)
        out = self.features(both, first=not len(old)).iloc[len(old):]
        out.insert(0, "instrument", key[0])
        out.insert(1, "ts_event", new["ts_event"].to_numpy())
        out.insert(2, "sequence", new["sequence"].to_numpy())
        keep = both.iloc[-self.n:]
        self.tail.put([(float(p), float(s), str(d)) for p, s, d in keep.itertuples(index=False)])
        yield out

    def close(self) -> None:
        pass


class SignalChanges(Released):
    """A row whenever the side of the newest event differs from the one before."""

    output = "instrument string, ts_event long, sequence long, side string, previous string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wait(handle)
        self.last = handle.getValueState("last", "side string")

    def apply(self, key, pdf):
        prev = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in pdf.itertuples(index=False):
            if prev is not None and r.side != prev:
                out.append((key[0], r.ts_event, r.sequence, r.side, prev))
            prev = r.side
        if prev is not None:
            self.last.update((prev,))
        yield pd.DataFrame(out, columns=["instrument", "ts_event", "sequence", "side", "previous"])

    def close(self) -> None:
        pass


def stateful(df: DataFrame, keys: list[str], processor: StatefulProcessor, late: str | None = None, mode: str = "append") -> DataFrame:
    """Run a processor per key; with ``late`` its timers follow the event-time watermark."""
    use_rocksdb(df.sparkSession)
    # the stream's own Python runner does not see added files, so processors travel by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    if late:
        df = df.withWatermark("event_time", late)
    if isinstance(processor, Released):
        processor.timed = bool(late)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode=mode, timeMode="EventTime" if late else "None"
    )
