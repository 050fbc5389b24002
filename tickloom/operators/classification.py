"""Toxic / benign flow classification from rolling behaviour of the event stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cols import clip, flag
from tickloom.functions.fast import correlation, per_group, rolling, rolling_quantile
from tickloom.operators.normalise import scored
from tickloom.order import EventOrder, Frames, one_pin, windowed
from tickloom.session import pin

WINDOW = 1000

# Fixed values (toxicity weights of the features that vary, class limits).
TOXICITY_WEIGHTS = {
    "flow_aggressive_ratio": 0.15,
    "flow_size_clustering": 0.10,
    "flow_timing_precision": 0.15,
    "flow_price_impact_accuracy": 0.20,
    "flow_adverse_selection_prob": 0.15,
}
TOXIC_FROM = 0.7
BENIGN_TO = 0.3
# End of fixed values.


def _share(values: np.ndarray, limit: np.ndarray, n: int, above: bool) -> np.ndarray:
    """Share of each n-row window above (below) that row's limit; NaN before n rows."""
    out = np.full(len(values), np.nan)
    if len(values) < n:
        return out
    view = np.lib.stride_tricks.sliding_window_view(values, n)
    ends = limit[n - 1 :]
    step = max(1, 4_000_000 // n)
    for i in range(0, len(view), step):
        part = view[i : i + step]
        cut = ends[i : i + step, None]
        hits = (part > cut) if above else (part < cut)
        out[n - 1 + i : n - 1 + i + len(part)] = hits.sum(axis=1) / n
    out[n - 1 :][np.isnan(ends)] = np.nan
    return out


def _mode_share(values: np.ndarray, n: int) -> np.ndarray:
    """Share of the most frequent value in each n-row window; NaN before n rows.

    Windows are taken n at a time. A value's count in all of them is a difference of its
    running count; values come in order of how often they occur near these windows, and
    the rest is left out once it occurs no more often than every window's mode so far.
    """
    out = np.full(len(values), np.nan)
    codes = np.unique(values, return_inverse=True)[1]
    for first in range(n - 1, len(values), n):
        near = codes[first - n + 1 : first + n]
        often = np.bincount(near)
        best = np.zeros(len(near) - n + 1, dtype=np.int64)
        for code in np.argsort(-often, kind="stable"):
            if often[code] <= best.min():
                break
            seen = np.concatenate([[0], np.cumsum(near == code)])
            np.maximum(best, seen[n:] - seen[:-n], out=best)
        out[first : first + len(best)] = best / n
    return out


@one_pin
def by_side(df: DataFrame, order: EventOrder, n: int) -> DataFrame:
    """Within one side: share of sizes above the window's 0.8 quantile, fill ratio,
    continuation, and correlation of size with the price five rows ahead."""

    def ahead(d: DataFrame, f: Frames) -> DataFrame:
        w = f.ordered()
        return d.withColumn("_p5", F.lead("price", 5).over(w))

    d = windowed(df, order, ahead, before=0, after=5)

    def aggressive(g: dict) -> dict:
        q = rolling_quantile(g["size"], n, 0.8)
        return {"flow_aggressive_ratio": _share(g["size"].astype("float64"), q, n, above=True)}

    def body(d: DataFrame, f: Frames) -> DataFrame:
        d = per_group(d, f, {"flow_aggressive_ratio": "double"}, aggressive, ["size"], n)
        w = f.ordered()
        d = d.withColumns(
            {
                "_fill": flag(F.col("action") == "F"),
                "_up": flag(F.col("size") > F.lag("size").over(w)),
                "_side_gap": F.col("ts_event") - F.lag("ts_event").over(w),
            }
        )
        d = rolling(d, f, {"flow_fill_ratio": ("_fill", n, "mean"), "_seen": ("_fill", n, "count")}, strict=True)
        d = rolling(d, f, {"_ups": ("_up", n - 1, "sum")})
        d = correlation(d, f, "_corr", F.col("size"), F.col("_p5"), n)
        pairs = F.col("_seen")
        return d.withColumns(
            {
                "flow_continuation_prob": F.when(pairs.isNotNull(), F.col("_ups") / n),
                "flow_price_correlation": F.when(pairs.isNotNull() & F.col("_p5").isNotNull(), F.col("_corr")),
            }
        ).drop("_fill", "_up", "_seen", "_ups", "_corr", "_p5")

    return windowed(d, order.by(*order.keys, "side"), body, before=n + 1)


def modification_rate(df: DataFrame, order: EventOrder, n: int) -> DataFrame:
    """Share of adds and modifies in the last n events of an order."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        d = d.withColumn("_am", flag(F.col("action").isin("A", "M")))
        return rolling(d, f, {"flow_modification_rate": ("_am", n, "mean")}, strict=True).drop("_am")

    return windowed(df, order.by(*order.keys, "order_id"), body, before=n)


def iceberg_probability(df: DataFrame, order: EventOrder, n: int) -> DataFrame:
    """Five times the share of the commonest size at a price and side, at most 1."""

    def fn(g: dict) -> dict:
        share = _mode_share(g["size"], n)
        return {"flow_iceberg_probability": np.minimum(share * 5, 1.0) if n >= 20 else share * 0.0}

    body = lambda d, f: per_group(d, f, {"flow_iceberg_probability": "double"}, fn, ["size"], n)
    return windowed(df, order.by(*order.keys, "price", "side"), body, before=n)


@one_pin
def flow_features(df: DataFrame, order: EventOrder, n: int = WINDOW) -> DataFrame:
    """All flow features. ``flow_price_impact_accuracy`` and ``flow_price_correlation``
    look five rows ahead (label-like)."""
    order = order.measured(df)
    d = by_side(df, order, n)
    d = modification_rate(d, order, n)
    d = iceberg_probability(d, order, n)

    def ranks(g: dict) -> dict:
        size = pd.Series(g["size"].astype("float64"))
        gaps = np.diff(g["ts_event"].astype("float64"), prepend=np.nan)
        return {
            "flow_size_percentile": size.rolling(n).rank(pct=True).to_numpy(),
            "_q95": rolling_quantile(g["size"], n, 0.95),
            "flow_submission_clustering": _share(gaps, rolling_quantile(gaps, n - 1, 0.25), n - 1, above=False),
            "flow_latency_advantage": _share(gaps, rolling_quantile(gaps, n, 0.1), n, above=False),
        }

    ranked = {c: "double" for c in ("flow_size_percentile", "_q95", "flow_submission_clustering", "flow_latency_advantage")}

    def body(x: DataFrame, f: Frames) -> DataFrame:
        x = per_group(x, f, ranked, ranks, ["size", "ts_event"], n + 1)
        w = f.ordered()
        x = x.withColumns(
            {
                "_gap": F.col("ts_event") - F.lag("ts_event").over(w),
                "_fill": flag(F.col("action") == "F"),
                "_buy": flag(F.col("side") == "B"),
                "_ret": (F.col("price") - F.lag("price").over(w)) / F.nullif(F.lag("price").over(w), F.lit(0.0)),
                "_dir": F.when(F.col("side") == "B", 1).otherwise(-1),
                "flow_size_momentum": F.col("size") - F.lag("size", 10).over(w),
            }
        )
        x = x.withColumns({"_gap2": F.col("_gap") - F.lag("_gap").over(w), "_future": F.coalesce(F.lead("_ret", 5).over(w), F.lit(0.0))})
        x = x.withColumn("_round", flag(F.col("_gap2") % 1000 == 0))
        x = rolling(
            x,
            f,
            {
                "_mean": ("size", n, "mean"), "_std": ("size", n, "std"), "_sum": ("size", n, "sum"),
                "_fills": ("_fill", n, "mean"), "_buys": ("_buy", n, "mean"), "_gaps": ("_gap", n, "count"),
                "flow_execution_speed": ("_side_gap", n, "mean"),
            },
            strict=True,
        )
        x = rolling(
            x, f, {"_g2m": ("_gap2", n - 1, "mean"), "_g2s": ("_gap2", n - 1, "std"), "_rounds": ("_round", n - 1, "mean")}
        )
        x = correlation(x, f, "_acc", F.col("_dir"), F.col("_future"), n, exclusive=True)
        x = correlation(x, f, "_auto", F.col("size"), F.lag("size").over(w), n - 1)
        half: Column = F.lit(0.5)
        prior = F.row_number().over(w) > n
        accuracy = F.when(prior, F.coalesce(F.abs("_acc"), half)).otherwise(half)
        timing = F.when(F.col("_g2s") == 0, 1.0).otherwise(1 / (1 + F.col("_g2s") / (F.col("_g2m") + 1e-8)))
        ready = F.col("_mean").isNotNull()
        x = x.withColumns({"flow_price_impact_accuracy": accuracy, "flow_execution_timing": F.when(F.col("_gaps").isNotNull(), timing)})
        return x.withColumns(
            {
                "flow_size_clustering": 1 / (1 + F.col("_std") / (F.col("_mean") + 1e-8)),
                "flow_aggressiveness_score": F.col("size") / F.col("_mean"),
                "flow_large_order_flag": flag(F.col("size") > F.col("_q95")),
                "flow_size_volatility": F.col("_std") / F.col("_mean"),
                "flow_timing_precision": F.when(F.col("_gaps").isNotNull(), F.col("_rounds")),
                "flow_directional_accuracy": F.col("flow_price_impact_accuracy"),
                "flow_alpha_potential": F.col("flow_price_impact_accuracy") * F.col("flow_price_impact_accuracy"),
                "flow_adverse_selection_prob": F.col("flow_price_impact_accuracy"),
                "flow_liquidity_consumption": F.col("_sum") / n,
                "flow_conditional_fill_rate": F.coalesce(F.col("_fills"), half),
                "flow_directional_persistence": F.coalesce(2 * F.abs(F.col("_buys") - 0.5), half),
                "flow_size_persistence": F.when(ready, F.coalesce(F.abs("_auto"), half)),
            }
        )

    out = windowed(d, order, body, before=2 * n + 2, after=5)
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])


FLOW_COLUMNS = [
    "flow_aggressive_ratio", "flow_size_clustering", "flow_fill_ratio", "flow_size_percentile", "flow_timing_precision",
    "flow_submission_clustering", "flow_latency_advantage", "flow_price_impact_accuracy", "flow_alpha_potential",
    "flow_conditional_fill_rate", "flow_continuation_prob", "flow_directional_persistence", "flow_size_persistence",
]


def classify(df: DataFrame) -> DataFrame:
    """Toxicity score over the table's own ranges (looks ahead), class and confidence.

    The ranges need a pass of their own over the features, so these are pinned first
    rather than computed twice.
    """
    d = scored(pin(df), TOXICITY_WEIGHTS, "flow_toxicity_score")
    score = F.col("flow_toxicity_score")
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.5)) for c in FLOW_COLUMNS])
    k = len(FLOW_COLUMNS)
    d = d.withColumn("_row", row)
    mean = F.aggregate("_row", F.lit(0.0), lambda a, x: a + x) / k
    d = d.withColumn("_mean", mean)
    sq = F.aggregate("_row", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    return d.withColumns(
        {
            "flow_classification": F.when(score >= TOXIC_FROM, "toxic").when(score <= BENIGN_TO, "benign").otherwise("neutral"),
            "flow_classification_confidence": clip(1 - F.sqrt(sq / (k - 1)) / (F.col("_mean") + 1e-8), 0, 1),
            "flow_information_content": (F.col("flow_directional_accuracy") + F.col("flow_alpha_potential")) / 2,
            "flow_adverse_selection_risk": F.col("flow_adverse_selection_prob"),
            "flow_size_aggressiveness": F.col("flow_aggressiveness_score"),
            "flow_timing_sophistication": F.col("flow_timing_precision"),
        }
    ).drop("_row", "_mean")
