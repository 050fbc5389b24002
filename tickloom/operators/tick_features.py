"""Feature bundles over ticks and order events (rows in replay order per key)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cols import clip, flag, pct_change, roll, safe_div
from tickloom.functions.ema import ema, reach, span_alpha
from tickloom.functions.fast import per_group, rolling, rolling_quantile
from tickloom.operators.bars import signed_size
from tickloom.operators.filters import local_time
from tickloom.operators.horizons import NO_CLOCK, frame_rows, range_sums, sparse_horizons, trailing, trailing_range
from tickloom.operators.joins import asof_last
from tickloom.operators.quantiles import exact_quantiles
from tickloom.order import EventOrder, Frames, one_pin, running, time_cells, time_windowed, windowed

CELL_REACH = 100_000  # rows that a window in cells may hold


@one_pin
def basic_features(df: DataFrame, order: EventOrder, convention: str = "aggressor") -> DataFrame:
    """Price change, delta, imbalance, volatility, velocities, VWAP deviation, divergence."""
    order = order.measured(df)
    df = running(df.withColumn("delta", signed_size(convention=convention)), order, {"cum_delta": ("sum", "delta")})

    def body(d: DataFrame, f: Frames) -> DataFrame:
        lag = F.lag("price").over(f.ordered())
        d = d.withColumns(
            {
                "price_change": F.coalesce(F.col("price") - lag, F.lit(0.0)),
                "_ret": pct_change("price", f),
                "buy_size": F.when(F.col("side") == "B", F.col("size")).otherwise(0),
                "sell_size": F.when(F.col("side") == "A", F.col("size")).otherwise(0),
                "_pv": F.col("price") * F.col("size"),
            }
        )
        loose = lambda c, n, how: roll(c, f, n, how, strict=False)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        d = d.withColumns(
            {
                "direction": flag(F.col("price_change") > 0),
                "imbalance": loose("delta", 20, "sum"),
                "volatility": zero(loose("_ret", 50, "std")),
                "size_norm": zero(safe_div(F.col("size").cast("double"), loose("size", 100, "mean"))),
                "delta_norm": F.col("delta") / (zero(loose("size", 100, "std")) + 1e-6),
                "buy_velocity": loose("buy_size", 20, "sum"),
                "sell_velocity": loose("sell_size", 20, "sum"),
                "delta_pressure_gradient": F.when(lag.isNull(), 0).otherwise(F.col("delta")),
                "vwap50": F.coalesce(
                    safe_div(loose("_pv", 50, "sum"), loose("size", 50, "sum").cast("double")), F.col("price")
                ),
                "price_mom": loose("price_change", 20, "sum"),
                "delta_mom": loose("delta", 20, "sum"),
            }
        )
        both = F.col("buy_velocity") + F.col("sell_velocity")
        return d.withColumns(
            {
                "bid_ask_imbalance_ratio": zero((F.col("buy_velocity") - F.col("sell_velocity")) / F.nullif(both, F.lit(0))),
                "vwap_dev": zero(safe_div(F.col("price") - F.col("vwap50"), F.col("vwap50"))),
                "mom_divergence": F.when(F.abs("price_mom") > 1e-9, F.col("price_mom")).otherwise(1.0) - F.col("delta_mom"),
            }
        ).drop("_ret", "_pv")

    return windowed(df, order, body, before=101)


@one_pin
def event_features(df: DataFrame, order: EventOrder) -> DataFrame:
    """Absorption, iceberg, spoofing, aggression surge, liquidity void.

    ``spoofing_flag`` looks ten rows ahead (label-like); the iceberg bucket width uses
    the median price of the whole table.
    """
    order, given = order.measured(df), df.columns
    mid = exact_quantiles(df.select(F.abs("price").alias("p")), "p", {"_median": 0.5})
    df = df.crossJoin(F.broadcast(mid)).withColumn(
        "_bucket", F.round(F.col("price") / F.greatest(F.col("_median") * 1e-6, F.lit(0.01)), 2)
    )
    if "delta" not in df.columns:
        df = df.withColumn("delta", signed_size())

    def refill(d: DataFrame, f: Frames) -> DataFrame:
        return d.withColumn("_refill", F.sum("size").over(f.rows(10)))

    df = windowed(df, order.by(*order.keys, "_bucket"), refill, before=10)

    def medians(g):
        return {
            "_delta_med": rolling_quantile(g["_delta_abs"], 200, 0.5, strict=False),
            "_vel_med": rolling_quantile(g["_vel"], 200, 0.5, strict=False),
        }

    def body(d: DataFrame, f: Frames) -> DataFrame:
        loose = lambda c, n, how: roll(c, f, n, how, strict=False)
        change = F.coalesce(F.col("price") - F.lag("price").over(f.ordered()), F.lit(0.0))
        d = d.withColumns(
            {
                "_chg": change,
                "_abs": F.abs(change),
                "_traded": F.when(F.col("side").isin("B", "A"), F.col("size")).otherwise(0),
            }
        )
        d = rolling(d, f, {"_m500": ("size", 500, "mean"), "_m50": ("size", 50, "mean")})
        d = d.withColumns(
            {
                "_vol50": loose("size", 50, "sum"),
                "_delta20": F.abs(loose("delta", 20, "sum")),
                "_move20": loose("_abs", 20, "sum") + 1e-6,
                "_delta_abs": F.abs(loose("delta", 30, "sum")),
                "_price30": loose("_chg", 30, "sum"),
                "_std50": F.coalesce(loose("price", 50, "std"), F.lit(0.0)),
                "_vel": loose("_traded", 20, "sum"),
            }
        )
        d = per_group(d, f, {"_delta_med": "double", "_vel_med": "double"}, medians, ["_delta_abs", "_vel"], 200)
        ahead = F.coalesce(F.lead("_price30", 10).over(f.ordered()), F.lit(0.0))
        absorbed = F.coalesce(safe_div(F.col("_delta20").cast("double"), F.col("_vol50").cast("double")), F.lit(0.0))
        return d.withColumns(
            {
                "absorption_strength": clip(absorbed / F.col("_move20"), 0, 10),
                "iceberg_score": clip(F.col("_refill") / (F.col("_m50") + 1e-6), 0, 10),
                "spoofing_flag": flag(
                    (F.col("_delta_abs") > F.col("_delta_med") * 3)
                    & (F.abs("_price30") < F.col("_std50") * 0.2)
                    & (ahead * F.col("_price30") < 0)
                ),
                "aggression_surge": flag(F.col("_vel") > F.col("_vel_med") * 3),
                "liquidity_void": flag(F.col("_m50") < F.col("_m500") * 0.25),
            }
        )

    out = windowed(df, order, body, before=501, after=10)
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in given])


def flow_features(df: DataFrame, order: EventOrder, minutes: list[int]) -> DataFrame:
    """Volumes by side and action, price range and counts over trailing minutes.

    Long keys whose windows fit a cell are shuffled once, into cells of time; all windows of a
    cell come from its rows and those within reach before it.
    """
    horizons = {f"w{m}": m * 60_000_000_000 for m in minutes}
    out = _flow_in_cells(df, order, horizons)
    return _flow_columns(_flow_by_scans(df, order, horizons) if out is None else out, minutes)


def _flow_columns(out: DataFrame, minutes: list[int]) -> DataFrame:
    cols = {}
    for m in minutes:
        g = lambda n, h=f"w{m}": F.col(f"{h}_{n}")
        n = g("events")
        var = g("pxx") / n - (g("px") / n) * (g("px") / n)
        cols |= {
            f"volume_{m}m": g("volume"),
            f"buy_volume_{m}m": g("buy"),
            f"ask_volume_{m}m": g("ask"),
            f"net_flow_{m}m": g("buy") - g("ask"),
            f"net_flow_ratio_{m}m": F.when(g("volume") > 0, (g("buy") - g("ask")) / g("volume")).otherwise(0.0),
            f"add_volume_{m}m": g("add"),
            f"cancel_volume_{m}m": g("cancel"),
            f"execute_volume_{m}m": g("execute"),
            f"price_range_{m}m": g("range"),
            f"price_volatility_{m}m": F.sqrt(F.greatest(var, F.lit(0.0))),
            f"order_count_{m}m": n,
            f"unique_orders_{m}m": g("unique"),
            f"avg_order_size_{m}m": g("volume") / n,
        }
    scratch = [c for c in out.columns if c.split("_")[0] in {f"w{m}" for m in minutes}]
    return out.withColumns(cols).drop(*scratch)


def _within(values: np.ndarray, first: np.ndarray, last: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """Extreme of values[first:last] of each row, by spans whose length is a power of two."""
    out, now = np.empty(len(first)), values
    level = np.frexp((last - first).astype("float64"))[1] - 1
    for k in range(int(level.max()) + 1):
        here, span = np.flatnonzero(level == k), 1 << k
        out[here] = pick(now[first[here]], now[last[here] - span])
        now = pick(now[:-span], now[span:])
    return out


def _flow_of(horizons: dict[str, int], names: tuple[str, ...]) -> Callable[[dict[str, np.ndarray]], dict[str, pa.Array]]:
    """All windows of one cell, its copied rows included."""

    def fn(g: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        at, size, out = g["_t_at"], g["_t_size"], {}
        known, price = g["_t_known"].astype(bool), g["price"].astype("float64") + 0.0
        side, action = g["side"], g["action"]
        number = known & ~np.isnan(price)
        base = price[number][0] if number.any() else 0.0
        x = np.where(known, price - base, 0.0)
        with np.errstate(invalid="ignore"):
            square = x * x
        inputs = [size, *[np.where(c, size, 0) for c in (side == "B", side == "A", action == "A", action == "C", action == "F")], x, square]
        sums = {n: range_sums(v) for n, v in zip(names, inputs)}
        having, numbers = range_sums(known.astype("int64")), range_sums(number.astype("int64"))
        low, high = np.where(number, price, np.inf), np.where(number, price, -np.inf)
        # rows of one price and side, one after the other
        kinds = np.where(known, np.unique(price, return_inverse=True)[1] + 1, 0)
        sides = pd.factorize(side, use_na_sentinel=False)[0]
        of = kinds * (int(sides.max()) + 1) + sides
        by = np.argsort(of, kind="stable")
        same = of[by[1:]] == of[by[:-1]]
        gap = np.where(same, at[by[1:]] - at[by[:-1]], -1)
        last, timeless = np.searchsorted(at, at, side="right"), at == NO_CLOCK
        for h, ns in horizons.items():
            first = np.searchsorted(at, at - ns, side="left")
            # the time a value is in the window starts and ends where it does not come again in time
            meets = same & (gap >= 0) & (gap <= ns)
            starts, ends = np.ones(len(at), dtype="int64"), np.ones(len(at), dtype="int64")
            starts[by[1:]], ends[by[:-1]] = ~meets, ~meets
            unique = np.cumsum(starts)[last - 1] - np.concatenate([[0], np.cumsum(ends)])[first]
            some, real = having(first, last), numbers(first, last)
            with np.errstate(invalid="ignore"):
                wide = _within(high, first, last, np.maximum) - _within(low, first, last, np.minimum)
            out |= {f"{h}_{n}": pa.array(between(first, last)) for n, between in sums.items()}
            out[f"{h}_events"] = pa.array(last - first)
            out[f"{h}_range"] = pa.array(np.where(some > real, np.nan, wide), mask=some == 0)
            out[f"{h}_unique"] = pa.array(np.where(timeless, last - first, unique))  # one by one, as by scans
        return out

    return fn


def _flow_in_cells(df: DataFrame, order: EventOrder, horizons: dict[str, int]) -> DataFrame | None:
    """Windows of long keys in cells of time; None where they, or the columns' types, do not fit."""
    types, reach = dict(df.dtypes), max(horizons.values())
    whole = ("tinyint", "smallint", "int", "bigint")
    if types[order.ts] != "bigint" or types["price"] != "double" or types["size"] not in whole:
        return None
    order = order.spread(df)
    if not order.hot:
        return None
    if order.density is None:
        order = replace(order, density=frame_rows(df, order))
    if order.density * reach > CELL_REACH:
        return None
    size = max(order.rows_per_cell(df, 1), int(8 * order.density * reach))
    names = ("volume", "buy", "ask", "add", "cancel", "execute", "px", "pxx")
    kind = lambda n: "double" if n in ("px", "pxx", "range") else "bigint"
    outputs = {f"{h}_{n}": kind(n) for h in horizons for n in (*names, "events", "range", "unique")}
    given = {"_t_at": F.coalesce(F.col(order.ts), F.lit(NO_CLOCK)), "_t_size": F.coalesce(F.col("size"), F.lit(0)).cast("long"), "_t_known": F.col("price").isNotNull()}

    def body(d: DataFrame, f: Frames) -> DataFrame:
        return per_group(d.withColumns(given), f, outputs, _flow_of(horizons, names), [*given, "price", "side", "action"]).drop(*given)

    return time_cells(df, order, body, reach, size)


@one_pin
def _flow_by_scans(df: DataFrame, order: EventOrder, horizons: dict[str, int]) -> DataFrame:
    """The same windows by running sums, however many rows they hold.

    Distinct (price, side): an occurrence covers the time until it leaves the window. Where
    the cover of a value starts anew a row counts one; where it ends before the value comes
    again, the row takes it back once it has left. So the count is the covers open now: a
    running sum of starts less ends, plus the ends of rows still in the window.
    """
    order = order.measured(df)
    clock = F.col(order.ts)

    def near(d: DataFrame, f: Frames) -> DataFrame:
        w = f.ordered()
        gaps = {"_since": clock - F.lag(order.ts).over(w), "_until": F.lead(order.ts).over(w) - clock}
        return d.withColumns(gaps)

    base = windowed(df, order.by(*order.keys, "price", "side"), near, before=1, after=1)
    covers = {}
    for h, ns in horizons.items():
        covers[f"_end_{h}"] = F.when(F.col("_until") <= ns, 0).otherwise(1)
        covers[f"_open_{h}"] = F.when(F.col("_since") <= ns, 0).otherwise(1) - F.when(F.col("_until") <= ns, 0).otherwise(1)
    base = base.withColumns(covers).drop("_since", "_until")
    base = running(base, order, {"_base": ("first", "price"), **{f"_covers_{h}": ("sum", f"_open_{h}") for h in horizons}})
    x = F.col("price") - F.col("_base")
    size_if = lambda c: F.when(c, F.col("size")).otherwise(0)
    sums: dict[str, Column] = {
        "volume": F.col("size"),
        "buy": size_if(F.col("side") == "B"),
        "ask": size_if(F.col("side") == "A"),
        "add": size_if(F.col("action") == "A"),
        "cancel": size_if(F.col("action") == "C"),
        "execute": size_if(F.col("action") == "F"),
        "px": x,
        "pxx": x * x,
    }
    out = trailing(base, order, sums, horizons)

    few = sparse_horizons(out, order, horizons)

    def spread(d: DataFrame, f: Frames) -> DataFrame:
        cols = {}
        for h, ns in few.items():
            w = f.trailing(ns)
            cols[f"{h}_range"] = F.max("price").over(w) - F.min("price").over(w)
            cols[f"{h}_unique"] = F.sum(f"_end_{h}").over(w) + F.max(F.struct(*order.order, f"_covers_{h}")).over(f.trailing(0))[f"_covers_{h}"]
        return d.withColumns(cols)

    if few:
        out = time_windowed(out, order, spread, max(few.values()))
    for h, ns in horizons.items():
        if h not in few:
            out = trailing_range(out, order, h, ns, "price", {"ended": f"_end_{h}"}, [f"_covers_{h}"])
            out = out.withColumn(f"{h}_unique", F.col(f"{h}_ended") + F.col(f"_covers_{h}"))
    return out.drop("_base", *[f"{c}{h}" for h in horizons for c in ("_end_", "_open_", "_covers_")])


def history_features(df: DataFrame, order: EventOrder, large: float = 100) -> DataFrame:
    """Momentum over 60 and 300 rows, volume ratio, price efficiency, large share.

    NULL until ten rows of history exist; the history holds the last 500 rows.
    """

    def body(d: DataFrame, f: Frames) -> DataFrame:
        w = f.ordered()
        d = d.withColumns(
            {
                "_k": F.row_number().over(w),
                "_chg": F.col("price") - F.lag("price").over(w),
                "_big": F.when(F.col("size") >= large, 1).otherwise(0),
            }
        )
        d = d.withColumn("_abs", F.abs("_chg"))
        specs = {
            "_v60": ("size", 60, "sum"), "_v500": ("size", 500, "sum"), "_m100": ("size", 100, "mean"),
            "_move": ("_chg", 499, "sum"), "_path": ("_abs", 499, "sum"), "_large": ("_big", 100, "sum"),
        }
        d = rolling(d, f, specs)
        p60, p300 = F.lag("price", 59).over(w), F.lag("price", 299).over(w)
        ready = F.col("_k") >= 10
        recent = F.when(F.col("_k") >= 60, F.col("_v60")).otherwise(F.col("_v500"))
        out = {
            "price_momentum_60r": F.coalesce((F.col("price") - p60) / p60, F.lit(0.0)),
            "price_momentum_300r": F.coalesce((F.col("price") - p300) / p300, F.lit(0.0)),
            "volume_ratio": F.when(F.col("_m100") > 0, recent / F.col("_m100")).otherwise(1.0),
            "price_efficiency": F.when(F.col("_path") > 0, F.abs("_move") / F.col("_path")).otherwise(0.0),
            "large_trade_ratio": F.col("_large") / F.least(F.col("_k"), F.lit(100)),
        }
        return d.withColumns({n: F.when(ready, c) for n, c in out.items()}).drop("_k", "_chg", "_big", "_abs", *specs)

    return windowed(df, order, body, before=501)


@one_pin
def time_rolling(df: DataFrame, order: EventOrder, cols: list[str], minutes: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    """Mean and sample deviation of columns over (t - m minutes, t]."""
    order = order.measured(df)
    horizons = {f"_r{m}": m * 60_000_000_000 - 1 for m in minutes}
    out = running(df, order, {f"_o_{c}": ("first", c) for c in cols})
    sums: dict[str, Column] = {}
    for c in cols:
        d = F.col(c) - F.col(f"_o_{c}")
        sums |= {f"s_{c}": d, f"q_{c}": d * d, f"n_{c}": F.col(c).isNotNull().cast("long")}
    out = trailing(out, order, sums, horizons)
    new = {}
    for m in minutes:
        for c in cols:
            s, q, n = (F.col(f"_r{m}_{k}_{c}") for k in ("s", "q", "n"))
            mean = s / F.nullif(n, F.lit(0))
            new[f"{c}_ma_{m}m"] = mean + F.col(f"_o_{c}")
            new[f"{c}_std_{m}m"] = F.when(n > 1, F.sqrt(F.greatest(q - s * mean, F.lit(0.0)) / (n - 1)))
    out = out.withColumns(new)
    return out.drop(*[c for c in out.columns if c.startswith("_r") or c.startswith("_o_")])


def rolling_columns(columns: list[str]) -> list[str]:
    """Columns a rolling expansion applies to: prices, volumes, spread, imbalance."""
    fixed = {"mid_price", "spread", "imbalance_ratio"}
    return [c for c in columns if c in fixed or ("volume_" in c and "ratio" not in c)]


def cross_features(df: DataFrame) -> DataFrame:
    """Interaction products of whichever inputs are present."""
    # Fixed values (feature name, factors).
    products = {
        "price_volume_interaction": ("mid_price", "volume_5m"),
        "spread_volume_interaction": ("spread", "volume_5m"),
        "imbalance_spread_interaction": ("imbalance_ratio", "spread"),
        "order_pressure": ("imbalance_ratio", "volume_5m"),
        "volatility_volume_interaction": ("price_volatility_5m", "volume_5m"),
    }
    # End of fixed values.
    have = set(df.columns)
    return df.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in products.items() if {a, b} <= have})


def trade_action(d: DataFrame, f: Frames, window: int = 50) -> DataFrame:
    """Price action and volume profile of trades."""
    w = f.ordered()
    lagp = lambda k: F.lag("price", k).over(w)
    d = d.withColumns({"_k": F.row_number().over(w), "_prev": lagp(1), "_vprev": F.lag("size").over(w)})
    d = rolling(
        d,
        f,
        {
            "price_volatility": ("price", window, "std_pop"),
            "volume_ma": ("size", window, "mean"),
            "volume_std": ("size", window, "std_pop"),
        },
    )
    first = F.first("price").over(f.past())
    mean = lambda a, b: F.avg("size").over(f.between(a, b))
    buy = F.sum(F.when(F.col("side") == "B", F.col("size")).otherwise(0)).over(f.rows(10))
    ask = F.sum(F.when(F.col("side") == "A", F.col("size")).otherwise(0)).over(f.rows(10))
    m1, m2 = mean(-4, 0) - mean(-9, -5), mean(-9, -5) - mean(-14, -10)
    k, none = F.col("_k"), F.lit(0.0)
    out = {
        "price_change": F.coalesce(F.col("price") - F.col("_prev"), none),
        "price_change_pct": F.when(F.col("_prev") > 0, (F.col("price") - F.col("_prev")) / F.col("_prev") * 100).otherwise(none),
        "price_volatility": F.when(k >= 2, F.col("price_volatility")).otherwise(none),
        "price_momentum": F.when(k >= 10, F.col("price") - lagp(9)).otherwise(F.col("price") - first),
        "price_acceleration": F.when(k >= 20, (F.col("price") - lagp(9)) - (lagp(9) - lagp(19))).otherwise(none),
        "volume_change": F.coalesce(F.col("size") - F.col("_vprev"), F.lit(0)),
        "volume_change_pct": F.when(F.col("_vprev") > 0, (F.col("size") - F.col("_vprev")) / F.col("_vprev") * 100).otherwise(none),
        "volume_ma": F.when(k >= 2, F.col("volume_ma")).otherwise(none),
        "volume_std": F.when(k >= 2, F.col("volume_std")).otherwise(none),
        "volume_imbalance": F.when((k >= 10) & (buy + ask > 0), (buy - ask) / (buy + ask)).otherwise(none),
        "volume_momentum": F.when(k >= 10, m1).otherwise(none),
        "volume_acceleration": F.when(k >= 15, m1 - m2).otherwise(none),
    }
    return d.withColumns(out).drop("_k", "_prev", "_vprev")


def technicals(d: DataFrame, f: Frames) -> DataFrame:
    """RSI-14 (simple means), MACD, Bollinger(20, population), EMA 10 and 20 on trades."""
    w = f.ordered()
    d = d.withColumns({"_n": F.row_number().over(w), "_d": F.col("price") - F.lag("price").over(w)})
    alphas = {f"_e{s}": ("price", span_alpha(s), False) for s in (10, 12, 20, 26)}
    d = ema(d, f, alphas)
    gain = F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(f.rows(14))
    loss = F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(f.rows(14))
    mean, sd = F.avg("price").over(f.rows(20)), F.stddev_pop("price").over(f.rows(20))
    ready, zero = F.col("_n") >= 20, F.lit(0.0)
    d = d.withColumns({"_gain": gain, "_loss": loss, "_up": mean + 2 * sd, "_low": mean - 2 * sd})
    rsi = F.when(F.col("_loss") != 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss"))).otherwise(100.0)
    place = F.when(F.col("_up") != F.col("_low"), (F.col("price") - F.col("_low")) / (F.col("_up") - F.col("_low"))).otherwise(0.5)
    out = {
        "rsi": F.when(ready, rsi).otherwise(zero),
        "macd": F.when(F.col("_n") >= 26, F.col("_e12") - F.col("_e26")).otherwise(zero),
        "bollinger_upper": F.when(ready, F.col("_up")).otherwise(zero),
        "bollinger_lower": F.when(ready, F.col("_low")).otherwise(zero),
        "bollinger_position": F.when(ready, place).otherwise(zero),
        "ema_short": F.when(ready, F.col("_e10")).otherwise(zero),
        "ema_long": F.when(ready, F.col("_e20")).otherwise(zero),
    }
    return d.withColumns(out).drop("_n", "_d", "_gain", "_loss", "_up", "_low", *alphas)


TRADE_COLUMNS = [
    "price_change", "price_change_pct", "price_volatility", "price_momentum", "price_acceleration", "volume_change",
    "volume_change_pct", "volume_ma", "volume_std", "volume_imbalance", "volume_momentum", "volume_acceleration",
]
TECHNICAL_COLUMNS = ["rsi", "macd", "bollinger_upper", "bollinger_lower", "bollinger_position", "ema_short", "ema_long"]


def trade_features(df: DataFrame, order: EventOrder, window: int = 50, on_all_events: bool = False) -> DataFrame:
    """Price action, volume profile and technicals of fills, optionally carried to
    every event as of its time."""
    order = order.measured(df)
    fills = df.filter(F.col("action") == "F")

    def body(d: DataFrame, f: Frames) -> DataFrame:
        return technicals(trade_action(d, f, window), f)

    out = windowed(fills, order, body, before=reach(span_alpha(26)))
    if not on_all_events:
        return out
    cols = [*TRADE_COLUMNS, *TECHNICAL_COLUMNS]
    carried = asof_last(df, out.select(*order.keys, *order.order, *cols), cols, order)
    return carried.fillna(0.0, subset=cols)


def clock_features(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """Hour, minute, second, session flag and progress (9:30 to 16:00), weekday flags."""
    at = local_time("ts_event", zone)
    hour, minute, second = F.hour(at), F.minute(at), F.second(at)
    dec = hour + minute / 60.0 + second / 3600.0
    inside = dec.between(9.5, 16.0)
    day = F.weekday(at)
    return df.withColumns(
        {
            "hour": hour,
            "minute": minute,
            "second": second,
            "time_decimal": dec,
            "is_market_open": flag(inside),
            "session_progress": F.when(inside, (dec - 9.5) / 6.5).otherwise(0.0),
            "weekday": day,
            "is_monday": flag(day == 0),
            "is_friday": flag(day == 4),
            "is_weekend": flag(day >= 5),
        }
    )
