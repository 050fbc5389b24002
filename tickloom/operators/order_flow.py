"""Order-flow feature bundles: volume, imbalance, patterns, regimes, risk, momentum.

Each ``*_body`` adds columns inside one partitioning, so bundles share a single sort;
``order_flow`` runs any selection of them. Row windows are named ``_{n}r``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cols import flag, full, pct_change, roll, safe_div
from tickloom.functions.ema import ema, reach, span_alpha
from tickloom.functions.fast import correlations, extremes, per_group, quantiles_in, rolling, rolling_quantile, tail_means
from tickloom.operators.joins import level_totals
from tickloom.operators.quantiles import equal_width_bins, quantile_bins
from tickloom.order import EventOrder, Frames, windowed

SHORT, MEDIUM, LONG = (1, 5, 15), (30, 60, 120), (240, 480, 1440)
EPS = 1e-8


def base_body(d: DataFrame, f: Frames) -> DataFrame:
    """Return, side volumes and imbalance that the bundles build on."""
    buy = F.when(F.col("side") == "B", F.col("size")).otherwise(0)
    sell = F.when(F.col("side") == "A", F.col("size")).otherwise(0)
    d = d.withColumns(
        {
            "volume": F.col("size"),
            "ret": pct_change("price", f),
            "gap": F.col("ts_event") - F.lag("ts_event").over(f.ordered()),
            "buy_volume": buy,
            "sell_volume": sell,
        }
    )
    imb = (F.col("buy_volume") - F.col("sell_volume")) / (F.col("buy_volume") + F.col("sell_volume") + EPS)
    return d.withColumns({"abs_ret": F.abs("ret"), "volume_imbalance": imb})


def autocorr(c: str, f: Frames, n: int, lag: int) -> Column:
    """Correlation of a value with its own lag inside the last n rows."""
    pairs = f.rows(n - lag)
    return full(F.corr(F.col(c), F.lag(c, lag).over(f.ordered())).over(pairs), f.rows(n), n, F.col(c))


def volume_body(d: DataFrame, f: Frames) -> DataFrame:
    mean20 = roll("volume", f, 20, "mean")
    cols = {
        "volume_ma": mean20,
        "volume_std": roll("volume", f, 20, "std"),
        "volume_ratio": F.col("volume") / mean20,
        "buy_volume_ma": roll("buy_volume", f, 20, "mean"),
        "sell_volume_ma": roll("sell_volume", f, 20, "mean"),
        "buy_sell_ratio": F.col("buy_volume") / (F.col("sell_volume") + EPS),
        **{f"volume_momentum_{w}r": pct_change("volume", f, w) for w in SHORT},
    }
    d = d.withColumns(cols)
    d = d.withColumns({f"volume_acceleration_{w}r": pct_change(f"volume_momentum_{w}r", f) for w in SHORT})
    specs = {f"volume_volatility_{w}r": ("volume", w, "std") for w in MEDIUM}
    specs |= {"volume_profile_skew": ("volume", 100, "skew"), "volume_profile_kurtosis": ("volume", 100, "kurt")}
    return rolling(d, f, specs, strict=True)


def imbalance_body(d: DataFrame, f: Frames) -> DataFrame:
    signs = F.when(F.col("side") == "B", 1).when(F.col("side") == "A", -1).otherwise(0)
    d = d.withColumn("order_flow_imbalance", signs)
    return d.withColumns(
        {
            "volume_imbalance_ma": roll("volume_imbalance", f, 20, "mean"),
            "volume_imbalance_std": roll("volume_imbalance", f, 20, "std"),
            **{f"volume_imbalance_momentum_{w}r": pct_change("volume_imbalance", f, w) for w in SHORT},
            "price_imbalance": F.col("ret"),
            "price_imbalance_ma": roll("ret", f, 20, "mean"),
            "price_volume_imbalance": F.col("ret") * F.col("volume_imbalance"),
            "order_flow_imbalance_ma": roll("order_flow_imbalance", f, 20, "mean"),
        }
    )


def with_levels(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Total size of the row's price level and of its price bin (50 equal bins)."""
    keys = list(keys)
    d = df.withColumn("_level", F.round("price", 2))
    d = level_totals(d, "_level", "size", "order_block_volume", keys)
    d = equal_width_bins(d, "price", "_bin", 50, keys)
    return level_totals(d, "_bin", "size", "support_resistance_volume", keys).drop("_level", "_bin")


def pattern_body(d: DataFrame, f: Frames) -> DataFrame:
    d = quantiles_in(
        d, f,
        {"_q95": ("size", 100, 0.95), "_b90": ("order_block_volume", 50, 0.9), "_s95": ("support_resistance_volume", 100, 0.95)},
    )
    d = d.withColumns(
        {
            "_vr": F.col("volume") / roll("volume", f, 20, "mean"),
            "_bmax": roll("order_block_volume", f, 50, "max"),
        }
    )
    d = d.withColumns(
        {
            "iceberg_detection": flag(F.col("size") > F.col("_q95")),
            "absorption_detection": flag((F.col("_vr") > 2) & (F.col("abs_ret") < 0.001)),
            "absorption_intensity": F.col("_vr") * (1 - F.col("abs_ret")),
            "order_block_detection": flag(F.col("order_block_volume") > F.col("_b90")),
            "support_resistance_detection": flag(F.col("support_resistance_volume") > F.col("_s95")),
        }
    )
    return d.withColumns(
        {
            "iceberg_persistence": roll("iceberg_detection", f, 10, "sum"),
            "iceberg_confidence": F.col("iceberg_detection") * (F.col("size") / F.col("_q95")),
            "absorption_confidence": F.col("absorption_detection") * F.col("absorption_intensity"),
            "order_block_confidence": F.col("order_block_detection") * (F.col("order_block_volume") / F.col("_bmax")),
        }
    ).drop("_q95", "_vr", "_b90", "_bmax", "_s95")


def microstructure_body(d: DataFrame, f: Frames) -> DataFrame:
    prev = F.lag("side").over(f.ordered())
    d = d.withColumns(
        {
            "estimated_spread": roll("abs_ret", f, 20, "mean"),
            "spread_volatility": roll("abs_ret", f, 20, "std"),
            "order_book_depth": roll("volume", f, 10, "sum"),
            "_vmax": roll("volume", f, 100, "max"),
            "_turn": F.when(prev.isNull() | (prev != F.col("side")), 1).otherwise(0),
        }
    )
    d = d.withColumns(
        {
            "depth_imbalance": pct_change("order_book_depth", f),
            "market_impact": F.col("abs_ret") / (F.col("volume") / F.col("_vmax") + EPS),
            "liquidity_ratio": F.col("volume") / (F.col("estimated_spread") + EPS),
            "order_flow_toxicity": roll("_turn", f, 50, "mean"),
        }
    )
    return d.withColumn("liquidity_ma", roll("liquidity_ratio", f, 20, "mean")).drop("_vmax", "_turn")


def risk_body(d: DataFrame, f: Frames) -> DataFrame:
    def tails(g: dict) -> dict:
        r = g["ret"].astype("float64")
        out = {"var_95": rolling_quantile(r, 100, 1 - 0.95), "var_99": rolling_quantile(r, 100, 1 - 0.99)}
        return {**out, "cvar_95": tail_means(r, out["var_95"], 100), "cvar_99": tail_means(r, out["var_99"], 100)}

    names = ["var_95", "var_99", "cvar_95", "cvar_99"]
    d = per_group(d, f, {n: "double" for n in names}, tails, ["ret"], 100)
    d = extremes(d, f, {"_peak": ("price", 100, "max")})
    specs = {f"volatility_{w}": ("ret", w, "std") for w in (20, 50, 100)}
    specs |= {"returns_skew": ("ret", 100, "skew"), "returns_kurtosis": ("ret", 100, "kurt")}
    d = rolling(d, f, specs, strict=True)
    full_peak = full(F.col("_peak"), f.rows(100), 100)
    d = d.withColumns({**{n: F.when(~F.isnan(n), F.col(n)) for n in names}, "_peak": full_peak})
    d = d.withColumn("drawdown", (F.col("price") - F.col("_peak")) / F.col("_peak"))
    d = rolling(d, f, {f"volatility_of_volatility_{w}": (f"volatility_{w}", w, "std") for w in (20, 50, 100)}, strict=True)
    d = extremes(d, f, {"_low": ("drawdown", 100, "min")})
    deep = F.when(F.count("drawdown").over(f.rows(100)) >= 100, F.col("_low"))
    return d.withColumn("max_drawdown", deep).drop("_peak", "_low")


def statistics_body(d: DataFrame, f: Frames) -> DataFrame:
    windows = SHORT + MEDIUM
    specs = {}
    for c, tag in (("price", "price"), ("volume", "vol")):
        for w in windows:
            specs[f"{tag}_ma_{w}r"] = (c, w, "mean")
            specs[f"{tag}_std_{w}r"] = (c, w, "std")
    d = rolling(d, f, specs, strict=True)
    z = {}
    for c, tag in (("price", "price"), ("volume", "vol")):
        for w in windows:
            z[f"{tag}_zscore_{w}r"] = safe_div(F.col(c) - F.col(f"{tag}_ma_{w}r"), F.col(f"{tag}_std_{w}r"))
    d = d.withColumns(z)
    p, v, w_ = F.col("price"), F.col("volume"), f.ordered()
    seen = F.row_number().over(w_)
    pairs = {f"price_volume_corr_{w}": (p, v, w) for w in (20, 50, 100)}
    pairs |= {f"price_autocorr_lag_{k}": (p, F.lag("price", k).over(w_), 50 - k) for k in (1, 5, 10)}
    d = correlations(d, f, pairs)
    late = {f"price_volume_corr_{w}": w for w in (20, 50, 100)} | {f"price_autocorr_lag_{k}": 50 for k in (1, 5, 10)}
    d = d.withColumns({c: F.when(seen >= n, F.col(c)) for c, n in late.items()})

    def entropy(g: dict) -> dict:
        return {"price_entropy": histogram_entropy(g["price"].astype("float64"), 20, 10)}

    d = per_group(d, f, {"price_entropy": "double"}, entropy, ["price"], 20)
    return d.withColumn("price_entropy", F.when(~F.isnan("price_entropy"), F.col("price_entropy")))


def histogram_entropy(values: np.ndarray, n: int, bins: int) -> np.ndarray:
    """Entropy in nats of an equal-width histogram over each n-row window's own range."""
    out = np.full(len(values), np.nan)
    if len(values) < n:
        return out
    view = np.lib.stride_tricks.sliding_window_view(values, n)
    step = max(1, 4_000_000 // n)
    for i in range(0, len(view), step):
        part = view[i : i + step]
        lo = part.min(axis=1, keepdims=True)
        width = part.max(axis=1, keepdims=True) - lo
        place = np.where(width > 0, np.minimum(np.floor((part - lo) / np.where(width > 0, width, 1.0) * bins), bins - 1), 0)
        total = np.zeros(len(part))
        for b in range(bins):
            share = (place == b).sum(axis=1) / n
            total -= np.where(share > 0, share * np.log(np.where(share > 0, share, 1.0)), 0.0)
        out[n - 1 + i : n - 1 + i + len(part)] = total
    return out


def temporal_body(d: DataFrame, f: Frames) -> DataFrame:
    at = F.timestamp_micros(F.floor(F.col("ts_event") / 1000).cast("long"))
    hour, minute, day = F.hour(at), F.minute(at), F.weekday(at)
    turn = lambda c, n: F.lit(2 * math.pi) * c / F.lit(float(n))
    d = d.withColumns(
        {
            "hour_of_day": hour, "minute_of_hour": minute, "day_of_week": day,
            "hour_sin": F.sin(turn(hour, 24)), "hour_cos": F.cos(turn(hour, 24)),
            "minute_sin": F.sin(turn(minute, 60)), "minute_cos": F.cos(turn(minute, 60)),
            "day_sin": F.sin(turn(day, 7)), "day_cos": F.cos(turn(day, 7)),
            "time_since_last_event": F.col("gap"),
            "time_since_last_event_ma": roll("gap", f, 20, "mean"),
            "event_frequency": 1 / (F.col("gap") + EPS),
        }
    )
    return d.withColumn("event_frequency_ma", roll("event_frequency", f, 20, "mean"))


def greeks_body(d: DataFrame, f: Frames) -> DataFrame:
    d = d.withColumns(
        {
            "delta": F.col("ret"),
            "delta_ma": roll("ret", f, 20, "mean"),
            "gamma": pct_change("ret", f),
            "theta": F.col("gap") / (roll("gap", f, 100, "mean") + EPS),
            "_vol": roll("ret", f, 20, "std"),
        }
    )
    return d.withColumns(
        {
            "delta_gamma": F.col("gamma"),
            "gamma_ma": roll("gamma", f, 20, "mean"),
            "vega": pct_change("_vol", f),
        }
    ).drop("_vol")


def liquidity_body(d: DataFrame, f: Frames) -> DataFrame:
    prev = F.lag("ret").over(f.ordered())
    d = d.withColumns({"amihud_illiquidity": F.col("abs_ret") / (F.col("volume") + EPS), "_prev": prev})
    pairs = F.count(F.col("ret") * F.col("_prev")).over(f.rows(20))
    cov = F.when(pairs >= 20, F.covar_samp("ret", "_prev").over(f.rows(20)))
    d = d.withColumns({"_cov": cov, "_back": flag(F.col("ret") * F.col("_prev") < 0)})
    return d.withColumns(
        {
            "amihud_ma": roll("amihud_illiquidity", f, 20, "mean"),
            "kyle_lambda": F.col("ret") / (F.col("volume") * F.col("volume_imbalance") + EPS),
            "roll_spread": F.when(F.col("_cov") <= 0, 2 * F.sqrt(-F.col("_cov"))),
            "bid_ask_bounce": roll("_back", f, 20, "mean"),
        }
    ).drop("_prev", "_cov", "_back")


def rsi(change: str, f: Frames, n: int) -> Column:
    up = F.when(F.col(change) > 0, F.col(change)).otherwise(0.0)
    down = F.when(F.col(change) < 0, -F.col(change)).otherwise(0.0)
    w = f.rows(n)
    rs = F.avg(up).over(w) / (F.avg(down).over(w) + EPS)
    return full(100 - 100 / (1 + rs), w, n)


def momentum_body(d: DataFrame, f: Frames) -> DataFrame:
    windows = SHORT + MEDIUM
    d = d.withColumns(
        {
            "_chg": F.col("price") - F.lag("price").over(f.ordered()),
            **{f"price_momentum_{w}r": pct_change("price", f, w) for w in windows},
            **{f"vol_momentum_{w}r": pct_change("volume", f, w) for w in SHORT},
        }
    )
    specs = {f"price_momentum_ma_{w}r": (f"price_momentum_{w}r", w, "mean") for w in windows}
    specs |= {f"vol_momentum_ma_{w}r": (f"vol_momentum_{w}r", w, "mean") for w in SHORT}
    d = rolling(d, f, specs, strict=True)
    d = d.withColumns({f"rsi_{n}": rsi("_chg", f, n) for n in (14, 20, 50)})
    d = ema(d, f, {"_e12": ("price", span_alpha(12), True), "_e26": ("price", span_alpha(26), True)})
    d = d.withColumn("macd", F.col("_e12") - F.col("_e26"))
    d = ema(d, f, {"macd_signal": ("macd", span_alpha(9), True)})
    return d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_chg", "_e12", "_e26")


def divergence_body(d: DataFrame, f: Frames) -> DataFrame:
    p5, p20, v5 = pct_change("price", f, 5), pct_change("price", f, 20), pct_change("volume", f, 5)
    d = d.withColumns({"_p5": p5, "_p20": p20, "_v5": v5})
    return d.withColumns(
        {
            "price_volume_divergence": F.signum("_p5") * F.signum("_v5"),
            "divergence_strength": F.abs("_p5") * F.abs("_v5"),
            "momentum_divergence": F.signum("_p5") * F.signum("_p20"),
            "momentum_divergence_strength": F.abs(F.col("_p5") - F.col("_p20")),
            "volume_imbalance_interaction": F.col("volume") * F.col("volume_imbalance"),
            "volume_imbalance_ratio": F.col("volume") / (F.abs("volume_imbalance") + EPS),
            "price_volume_interaction": F.col("ret") * F.col("volume"),
        }
    ).drop("_p5", "_p20", "_v5")


def timeframes_body(d: DataFrame, f: Frames) -> DataFrame:
    every = SHORT + MEDIUM + LONG
    d = d.withColumns({f"mtf_momentum_{w}r": pct_change("price", f, w) for w in every})
    d = rolling(d, f, {f"mtf_volatility_{w}r": ("ret", w, "std") for w in every}, strict=True)
    s = [F.signum(f"mtf_momentum_{g[0]}r") for g in (SHORT, MEDIUM, LONG)]
    return d.withColumn("momentum_alignment", (s[0] + s[1] + s[2]) / 3)


def intelligence_body(d: DataFrame, f: Frames) -> DataFrame:
    d = quantiles_in(d, f, {"_v90": ("volume", 100, 0.9), "_r10": ("abs_ret", 100, 0.1)})
    d = d.withColumns(
        {
            "_list": F.collect_list("volume").over(f.rows(10)),
            "_cut": roll("volume", f, 10, "mean") + roll("volume", f, 10, "std"),
            "_auto": autocorr("ret", f, 20, 1),
        }
    )
    return d.withColumns(
        {
            "smart_money_detection": flag((F.col("volume") > F.col("_v90")) & (F.col("abs_ret") < F.col("_r10"))),
            "order_clustering": F.when(
                F.col("_cut").isNotNull(), F.size(F.filter("_list", lambda x: x > F.col("_cut")))
            ),
            "market_efficiency": 1 - F.abs("_auto"),
        }
    ).drop("_v90", "_r10", "_list", "_cut", "_auto")


BODIES = {
    "volume": volume_body,
    "imbalance": imbalance_body,
    "patterns": pattern_body,
    "microstructure": microstructure_body,
    "risk": risk_body,
    "statistics": statistics_body,
    "temporal": temporal_body,
    "greeks": greeks_body,
    "liquidity": liquidity_body,
    "momentum": momentum_body,
    "divergence": divergence_body,
    "timeframes": timeframes_body,
    "intelligence": intelligence_body,
}
REACH = LONG[-1]
EMA_REACH = reach(span_alpha(26), span_alpha(9))


def order_flow(df: DataFrame, order: EventOrder, bundles: list[str] | None = None) -> DataFrame:
    """Run the chosen bundles (all by default) over one partitioning and sort."""
    order = order.spread(df)
    bundles = bundles or list(BODIES)
    if "patterns" in bundles:
        df = with_levels(df, order.keys)

    def body(d: DataFrame, f: Frames) -> DataFrame:
        d = base_body(d, f)
        for name in bundles:
            d = BODIES[name](d, f)
        return d

    return windowed(df, order, body, before=REACH + (EMA_REACH if "momentum" in bundles else 0))


def regimes(df: DataFrame, order: EventOrder, fit_on: Column | None = None) -> DataFrame:
    """Volatility and volume quintiles per key, changes, state, persistence, momentum.

    Quintile edges come from the rows where ``fit_on`` holds (all rows by default,
    which looks ahead).
    """
    order = order.measured(df)

    def volatility(d: DataFrame, f: Frames) -> DataFrame:
        d = d.withColumn("_ret", pct_change("price", f))
        return d.withColumn("_vol", roll("_ret", f, 20, "std"))

    d = windowed(df, order, volatility, before=21)
    keys = list(order.keys)
    if fit_on is not None:
        d = d.withColumns({"_fv": F.when(fit_on, F.col("_vol")), "_fs": F.when(fit_on, F.col("size"))})
        d = quantile_bins(d, "_vol", "volatility_regime", 5, keys, fit="_fv")
        d = quantile_bins(d, "size", "volume_regime", 5, keys, fit="_fs")
    else:
        d = quantile_bins(d, "_vol", "volatility_regime", 5, keys)
        d = quantile_bins(d, "size", "volume_regime", 5, keys)
    d = d.withColumns(
        {
            "market_state": F.col("volatility_regime") + F.col("volume_regime"),
            "regime_interaction": F.col("volatility_regime") * F.col("volume_regime"),
        }
    )

    def changes(x: DataFrame, f: Frames) -> DataFrame:
        w = f.ordered()
        distinct = F.size(F.collect_set("market_state").over(f.rows(50)))
        x = x.withColumns(
            {
                "regime_change": F.abs(F.col("volatility_regime") - F.lag("volatility_regime").over(w)),
                "volume_regime_change": F.abs(F.col("volume_regime") - F.lag("volume_regime").over(w)),
                "state_persistence": full(F.lit(50) - distinct, f.rows(50), 50, F.col("market_state")),
            }
        )
        return rolling(x, f, {f"regime_momentum_{w_}r": ("market_state", w_, "mean") for w_ in MEDIUM}, strict=True)

    out = windowed(d, order, changes, before=121)
    return out.drop("_ret", "_vol", "_fv", "_fs")
