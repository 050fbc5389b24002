"""Quote, bar, direction and signal bundles, and the registry of feature sets."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cols import flag, pct_change, roll, safe_div
from tickloom.functions.ema import ema, reach, span_alpha
from tickloom.functions.fast import quantiles_in, rolling
from tickloom.operators import book as bk
from tickloom.operators import classification, detectors, horizons, labels, microstructure, normalise, order_flow, tick_features
from tickloom.operators.joins import level_totals
from tickloom.order import HELD_CELL, HELD_NUMBER, EventOrder, Frames, one_pin, windowed
from tickloom.session import scratch_path


def _macd(d: DataFrame, f: Frames, price: str) -> DataFrame:
    d = ema(d, f, {"ema_12": (price, span_alpha(12), True), "ema_26": (price, span_alpha(26), True)})
    d = d.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    d = ema(d, f, {"macd_signal": ("macd", span_alpha(9), True)})
    return d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def quote_features(df: DataFrame, order: EventOrder, drop_warmup: bool = True) -> DataFrame:
    """Mid, spread, imbalance, momentum, averages, volatility, lags and rolling
    statistics of a quote table (bid/ask price and size per row)."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        w = f.ordered()
        bid, ask, bs, qs = F.col("bid_price"), F.col("ask_price"), F.col("bid_size"), F.col("ask_size")
        d = d.withColumns(
            {
                "mid_price": (bid + ask) / 2, "spread": ask - bid, "total_volume": bs + qs, "volume_imbalance": bs - qs,
                "volume_ratio": bs / (qs + 1e-8),
            }
        )
        change = lambda c: F.col(c) - F.lag(c).over(w)
        at = F.timestamp_micros(F.expr("ts_event div 1000"))
        tick = F.col("mid_price") * 0.0001
        d = d.withColumns(
            {
                "spread_bps": F.col("spread") / F.col("mid_price") * 10000, "price_change": change("mid_price"),
                "price_change_pct": pct_change("mid_price", f), "volume_change": change("total_volume"),
                "volume_change_pct": pct_change("total_volume", f), "tick_size": tick,
                "price_levels": F.bround(F.col("mid_price") / tick), "spread_ticks": F.bround(F.col("spread") / tick),
                "hour": F.hour(at), "minute": F.minute(at), "day_of_week": F.weekday(at),
                "is_market_open": flag((F.hour(at) >= 9) & (F.hour(at) < 16)),
            }
        )
        cols = {"price_acceleration": change("price_change"), "sma_5": roll("mid_price", f, 5, "mean"), "sma_20": roll("mid_price", f, 20, "mean")}
        cols |= {f"volatility_{n}": roll("price_change", f, n, "std") for n in (5, 20)}
        cols["realized_volatility"] = F.sqrt(F.when(F.count("price_change").over(f.rows(20)) >= 20, F.sum(F.col("price_change") * F.col("price_change")).over(f.rows(20))))
        for k in (1, 2, 3, 5, 10):
            cols |= {f"price_lag_{k}": F.lag("mid_price", k).over(w), f"volume_lag_{k}": F.lag("total_volume", k).over(w), f"spread_lag_{k}": F.lag("spread", k).over(w)}
        for n in (5, 10, 20):
            cols |= {f"price_mean_{n}": roll("mid_price", f, n, "mean"), f"price_std_{n}": roll("mid_price", f, n, "std"),
                     f"volume_mean_{n}": roll("total_volume", f, n, "mean"), f"spread_mean_{n}": roll("spread", f, n, "mean")}
        return _macd(d.withColumns(cols), f, "mid_price")

    out = windowed(df, order, body, before=reach(span_alpha(26), span_alpha(9)))
    return out.na.drop(subset=["realized_volatility", "price_std_20", "price_acceleration"]) if drop_warmup else out


# Fixed values (columns a bar model reads).
BAR_MODEL_COLUMNS = [
    "price_change", "high_low_ratio", "close_open_ratio", "price_vs_sma_5", "price_vs_sma_10", "price_vs_sma_20", "rsi",
    "macd", "macd_signal", "macd_histogram", "bb_position", "volume_ratio", "volatility",
]
# End of fixed values.


def bar_technicals(bars: DataFrame, key: str = "instrument", time: str = "bar_start") -> DataFrame:
    """Ratios, averages, RSI, MACD, Bollinger position and volume ratio of OHLCV bars."""
    order = EventOrder(keys=(key,), order=(time,), ts=time, hot=False)  # bars per key are few

    def body(d: DataFrame, f: Frames) -> DataFrame:
        c = F.col("close")
        d = d.withColumn("_chg", c - F.lag("close").over(f.ordered()))
        mean = {n: roll("close", f, n, "mean") for n in (5, 10, 20)}
        sd = roll("close", f, 20, "std")
        w = f.rows(14)
        ready = F.count(F.lit(1)).over(w) >= 14
        gain = F.avg(F.when(F.col("_chg") > 0, F.col("_chg")).otherwise(0.0)).over(w)
        loss = F.avg(F.when(F.col("_chg") < 0, -F.col("_chg")).otherwise(0.0)).over(w)
        d = d.withColumns({"_g": gain, "_l": loss, "_mid": mean[20], "_sd": sd})
        cols = {
            "price_change": pct_change("close", f), "high_low_ratio": F.col("high") / F.col("low"), "close_open_ratio": c / F.col("open"),
            **{f"price_vs_sma_{n}": c / mean[n] - 1 for n in mean},
            "rsi": F.when(ready, F.when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l"))).when(F.col("_g") > 0, 100.0)),
            "bb_position": safe_div(c - (F.col("_mid") - 2 * F.col("_sd")), 4 * F.col("_sd")),
            "volume_ratio": F.col("volume") / roll("volume", f, 20, "mean"), "volatility": F.col("_sd"),
        }
        return _macd(d.withColumns(cols), f, "close").drop("_chg", "_g", "_l", "_mid", "_sd")

    return windowed(bars, order, body, before=reach(span_alpha(26)))


def direction_features(df: DataFrame, order: EventOrder) -> DataFrame:
    """Direction, momentum 60/300/900 rows, volatility, trend strength and consistency."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        up = F.col("price") > F.lag("price").over(f.ordered())
        d = d.withColumn("price_direction", F.when(up, 1).otherwise(-1))
        d = rolling(d, f, {"volatility_60r": ("price", 60, "std"), "volatility_300r": ("price", 300, "std")}, strict=True)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        first = F.first("price_direction").over(f.rows(10))
        same = F.when(F.count(F.lit(1)).over(f.rows(10)) >= 10, (F.sum("price_direction").over(f.rows(10)) * first + 10) / 20)
        d = d.withColumns(
            {
                "price_direction_ma": zero(roll("price_direction", f, 5, "mean")),
                **{f"momentum_{n}r": zero(pct_change("price", f, n)) for n in (60, 300, 900)},
                "volatility_60r": zero(F.col("volatility_60r")), "volatility_300r": zero(F.col("volatility_300r")),
                "trend_consistency": zero(same),
            }
        )
        return d.withColumn("trend_strength", F.abs("price_direction_ma"))

    return windowed(df, order, body, before=901)


def pattern_signals(df: DataFrame, order: EventOrder) -> DataFrame:
    """Large orders, low-impact volume, level volume and the iceberg, order-block and
    absorption signals with their confidence."""
    order = order.measured(df)
    d = df.withColumn("_level", F.round("price", 2))
    d = level_totals(d, "_level", "size", "level_volume", list(order.keys)).drop("_level")

    def body(x: DataFrame, f: Frames) -> DataFrame:
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        x = quantiles_in(x, f, {"_q": ("size", 100, 0.95)})
        up = F.col("price") > F.lag("price").over(f.ordered())
        signed = F.when(F.col("side") == "B", F.col("size")).when(F.col("side") == "A", -F.col("size")).otherwise(0)
        x = x.withColumns(
            {
                "volume_imbalance": signed.cast("double"), "price_impact": zero(F.abs(pct_change("price", f))),
                "large_order_threshold": zero(F.col("_q")),
                "_dir": F.when(up, 1).otherwise(-1), "level_volume_ma": zero(roll("level_volume", f, 50, "mean")),
            }
        )
        big = F.col("size") > F.col("_q")
        imp, lv, lm = F.col("price_impact"), F.col("level_volume"), F.col("level_volume_ma")
        turned = F.lag("_dir").over(f.ordered()).isNull() | (F.lag("_dir").over(f.ordered()) != F.col("_dir"))
        x = x.withColumns(
            {
                "volume_imbalance_ma": zero(roll("volume_imbalance", f, 20, "mean")), "volume_imbalance_std": zero(roll("volume_imbalance", f, 20, "std")),
                "large_buy_orders": flag((F.col("side") == "B") & big), "large_sell_orders": flag((F.col("side") == "A") & big),
                "low_impact_volume": F.col("size") * (1 - imp),
                "iceberg_signal": flag((F.abs("volume_imbalance") > 0.3) & (imp < 0.001)),
                "order_block_signal": flag((lv > lm * 2) & (imp > 0.002)), "absorption_signal": flag((imp > 0.003) & turned),
            }
        )
        return x.withColumns(
            {
                "iceberg_confidence": F.abs("volume_imbalance") * (1 - imp) * F.col("iceberg_signal"),
                "order_block_confidence": lv / F.when(lm == 0, 1.0).otherwise(lm) * imp * F.col("order_block_signal"),
                "absorption_confidence": imp * F.col("absorption_signal"),
            }
        ).drop("_q", "_dir")

    return windowed(d, order, body, before=101)


def fallback_features(df: DataFrame, order: EventOrder) -> DataFrame:
    """Price and size averages over 5 and 10 rows, side flags and their imbalance."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        d = d.withColumns({"is_buy": flag(F.col("side") == "B"), "is_sell": flag(F.col("side") == "A")})
        d = d.withColumn("side_imbalance", F.col("is_buy") - F.col("is_sell"))
        cols = {f"{c}_ma_{n}": zero(roll(c, f, n, "mean")) for c in ("price", "size") for n in (5, 10)}
        cols["price_change"] = zero(F.col("price") - F.lag("price").over(f.ordered()))
        cols["side_imbalance_ma"] = zero(roll("side_imbalance", f, 5, "mean"))
        return d.withColumns(cols)

    return windowed(df, order, body, before=10)


# ---------------------------------------------------------------- feature sets

ROW = "_feature_row"
TASK_ROWS = 100_000  # whole rows of a set that one task puts together

Step = Callable[[DataFrame, EventOrder], DataFrame]


def _with_book(d: DataFrame, o: EventOrder) -> DataFrame:
    traded = detectors.execution_footprint(d, o)  # before rows carry the arrays of the book
    book = bk.depth_features(bk.normalised_depth(bk.book_at_events(bk.level_book(traded, o), o)))
    late = [c for c in traded.columns if c not in d.columns]
    return detectors.fair_values(book.select(*[c for c in book.columns if c not in late], *late), 0.25)


def _normalised(d: DataFrame, o: EventOrder) -> DataFrame:
    return normalise.normalise_events(d.withColumn("_mid", F.coalesce("mid", "price")), o, 0.25, mid="_mid").drop("_mid")


def _horizons(*names: str) -> Step:
    hs = {n: horizons.horizon_ns(n) for n in names}
    return lambda d, o: horizons.cross_horizon(horizons.multi_horizon(d, o, hs))


STEPS: dict[str, Step] = {
    "book": _with_book,
    "normalised": _normalised,
    "clock": lambda d, o: tick_features.clock_features(d),
    "horizons_core": _horizons("1s", "1m", "5m"),
    "horizons_all": _horizons(*horizons.HORIZONS_MS),
    "ofi": lambda d, o: detectors.multi_scale_ofi(d, o),
    "absorption": lambda d, o: detectors.absorption_counts(d, o),
    "history": lambda d, o: tick_features.history_features(d, o),
    "basic": lambda d, o: tick_features.basic_features(d, o),
    "cancel_share": lambda d, o: bk.cancel_modify_share(d, o),
    "event_windows": lambda d, o: microstructure.event_windows(d, o),
    "queues": lambda d, o: microstructure.queue_position(d, o),
    "voids": lambda d, o: microstructure.liquidity_void(d, o),
    "runs": lambda d, o: microstructure.trade_runs(d, o),
    "classification": lambda d, o: classification.classify(classification.flow_features(d, o)),
}

# Each set holds everything of the one before it.
FEATURE_SETS: dict[str, list[str]] = {}
FEATURE_SETS["raw_mbo_v1"] = []
FEATURE_SETS["basic_normalized_v1"] = ["book", "normalised"]
FEATURE_SETS["advanced_features_v1"] = ["book", "normalised", "ofi", "cancel_share"]
FEATURE_SETS["execution_aware_light_v1"] = ["book", "normalised", "clock", "ofi", "horizons_core"]
FEATURE_SETS["execution_aware_medium_v1"] = [*FEATURE_SETS["execution_aware_light_v1"], "absorption", "history"]
FEATURE_SETS["execution_aware_heavy_v1"] = [
    s if s != "horizons_core" else "horizons_all" for s in [*FEATURE_SETS["execution_aware_medium_v1"], "basic", "cancel_share"]
]
FEATURE_SETS["execution_aware_extreme_v1"] = [
    *FEATURE_SETS["execution_aware_heavy_v1"], "event_windows", "queues", "voids", "runs", "classification",
]


# Steps that read what earlier steps added, and what; all others need only the event columns.
CHAINED: dict[str, list[str]] = {"book": [], "normalised": ["mid"], "ofi": ["ofi_norm"]}


def feature_set(df: DataFrame, order: EventOrder, name: str, columns: list[str] | None = None) -> DataFrame:
    """Run a named feature set; with ``columns`` the optimizer drops what they do not need.

    Short keys (up to ``tickloom.wideRows`` rows) run as one pass: every step works on the rows
    of the step before, so steps over one key share its shuffle and sort, and nothing is joined
    back. What earlier steps added rides along in one column while a step that needs only the
    event columns runs.

    Every window of that chain holds the wide rows of a key. Longer keys are numbered once and
    each step runs on the event columns in small cells; what it adds is written as columns, and
    all are joined on the row at the end. A name that two steps give keeps the value of the first.
    """
    if name not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {name}; known: {', '.join(FEATURE_SETS)}")
    steps = sorted(FEATURE_SETS[name], key=lambda step: step not in CHAINED)  # stable: the others after, in their order
    order = order.spread(df, times=1)
    out = (_in_parts if order.hot and steps else _in_one_pass)(df, order, steps)
    return out.select(*columns) if columns else out


def _written(d: DataFrame, cut: str) -> DataFrame:
    path = scratch_path(d.sparkSession, f"features-{cut}")
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)


def _rows_in_cells(df: DataFrame, order: EventOrder) -> tuple[DataFrame, EventOrder, Callable[[DataFrame], DataFrame]]:
    """The rows with their number, written once; the order that knows it; how parts are dealt by row to be joined."""
    order = replace(order, order=(*order.order, ROW), above=4 * order.rows_per_cell(df, 1))  # rows that tie keep one order in all steps
    numbered, order = order.pinned(df.withColumn(ROW, F.monotonically_increasing_id()))
    numbered = _written(numbered, "rows")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(numbered.count() / TASK_ROWS))
    return numbered, replace(order, whole=True), lambda d: d.repartition(tasks, ROW)


def _in_parts(df: DataFrame, order: EventOrder, steps: list[str]) -> DataFrame:
    made = list(df.columns)
    numbered, order, dealt = _rows_in_cells(df, order)
    out, found = dealt(numbered.select(ROW, *made)), {}
    for step in steps:
        source = numbered
        for c in CHAINED.get(step, []):
            source = source.join(found[c].select(ROW, c), ROW, "left")
        part = STEPS[step](source, order)
        fresh = [c for c in part.columns if c not in made and c not in numbered.columns]
        part = _written(part.select(ROW, *fresh), step)
        made += fresh
        found |= {c: part for c in fresh}
        out = out.join(dealt(part).hint("merge"), ROW, "left")
    return out.select(*made)


@one_pin
def _in_one_pass(df: DataFrame, order: EventOrder, steps: list[str]) -> DataFrame:
    order = replace(order.measured(df), largest=None)  # one layout for all steps: none cuts the wide rows anew
    base, out = list(df.columns), df
    for step in steps:
        if step in CHAINED:
            out = STEPS[step](out, order)
    for step in steps:
        if step not in CHAINED:
            made = [c for c in out.columns if c not in base]
            packed = out.select(*base, F.struct(*made).alias("earlier_features")) if made else out
            out = STEPS[step](packed, order)
            fresh = [c for c in out.columns if c not in base and c not in made and c != "earlier_features"]
            out = out.select(*base, *[F.col(f"earlier_features.{c}").alias(c) for c in made], *fresh)
    return out


def mbo_pipeline(df: DataFrame, order: EventOrder, minutes: tuple[int, ...] = (5,), targets: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Book, flow, history, rolling, cross, event windows and targets.

    Short keys run in one plan. Long ones are numbered once; the book is written as columns,
    the windows run on the few columns they read, and all are joined on the row.
    """
    order = order.spread(df)
    if order.hot:
        return _pipeline_in_parts(df, order, minutes, targets)
    order = replace(order, largest=None)  # one layout for all steps
    d = bk.depth_features(bk.book_at_events(bk.level_book(df, order), order))
    d = tick_features.flow_features(d, order, list(minutes))
    d = tick_features.history_features(d, order)
    d = d.withColumn("mid_price", F.coalesce("mid", "price"))
    d = tick_features.time_rolling(d, order, ["mid_price", "imbalance_ratio"])
    d = tick_features.cross_features(d)
    d = microstructure.event_windows(d, order)
    return labels.horizon_targets(d, order, targets, price="mid_price")


def _pipeline_in_parts(df: DataFrame, order: EventOrder, minutes: tuple[int, ...], targets: tuple[int, ...]) -> DataFrame:
    made = list(df.columns)
    numbered, order, dealt = _rows_in_cells(df, order)
    place = [c for c in numbered.columns if c in (*order.keys, *order.order, HELD_NUMBER, HELD_CELL)]
    lean = numbered.select(*dict.fromkeys([*place, "action", "side", "price", "size"]))
    fresh = lambda d: [c for c in d.columns if c not in numbered.columns and c not in made and not c.startswith("_")]

    book = bk.depth_features(bk.book_at_events(bk.level_book(lean, order), order))
    book = _written(book.select(ROW, *fresh(book)), "book")
    made += fresh(book)
    flow = tick_features.flow_features(lean, order, list(minutes))
    first = fresh(flow)
    flow = tick_features.history_features(flow, order)
    made += [*first, *[c for c in fresh(flow) if c not in first], "mid_price"]
    flow = microstructure.event_windows(flow, order)
    events = fresh(flow)
    quotes = lean.select(*place, "price").join(book.select(ROW, "mid", "imbalance_ratio"), ROW, "left")
    quotes = quotes.withColumn("mid_price", F.coalesce("mid", "price")).drop("mid", "price")
    quotes = tick_features.time_rolling(quotes, order, ["mid_price", "imbalance_ratio"])
    means = [c for c in fresh(quotes) if c != "imbalance_ratio"]
    quotes = labels.horizon_targets(quotes, order, targets, price="mid_price")
    ahead = [c for c in fresh(quotes) if c not in (*means, "imbalance_ratio")]

    out = dealt(numbered.select(ROW, *df.columns))
    for part in (book, flow.select(ROW, *[c for c in flow.columns if c in made and c not in df.columns], *events), quotes.select(ROW, "mid_price", *means, *ahead)):
        out = out.join(dealt(part).hint("merge"), ROW, "left")
    out = tick_features.cross_features(out)
    crossed = [c for c in out.columns if c not in (ROW, *made, *means, *events, *ahead)]
    return out.select(*made, *means, *crossed, *events, *ahead)
