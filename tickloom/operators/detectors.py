"""Detected events (absorption, icebergs, spoofing, regimes, stress, anomalies) and the
execution-aware features derived from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cols import flag, full, ratio
from tickloom.functions.ema import ema, ema_in_cells, reach
from tickloom.functions.fast import correlation, per_group, rolling
from tickloom.operators.bars import signed_size
from tickloom.operators.book import level_book
from tickloom.operators.horizons import trailing
from tickloom.operators.joins import asof_last
from tickloom.order import EventOrder, Frames, one_pin, running, windowed
from tickloom.session import pin

MINUTE = 60_000_000_000


def _is_fill() -> Column:
    return F.col("action").isin("F", "T")


def execution_footprint(df: DataFrame, order: EventOrder, convention: str = "aggressor") -> DataFrame:
    """Session buy/sell volume, delta, last execution and seconds since it."""
    fill, d = _is_fill(), signed_size(convention=convention)
    session = order.by(*order.keys, "trade_date") if "trade_date" not in order.keys else order
    out = running(
        df,
        session,
        {
            "session_buy_volume": ("sum", F.when(fill & (d > 0), F.col("size")).otherwise(0)),
            "session_sell_volume": ("sum", F.when(fill & (d < 0), F.col("size")).otherwise(0)),
            "session_delta": ("sum", F.when(fill, d).otherwise(0)),
            "session_value": ("sum", F.when(fill, F.col("price") * F.col("size")).otherwise(0.0)),
            "session_volume": ("sum", F.when(fill, F.col("size")).otherwise(0)),
            "last_execution_price": ("last", F.when(fill, F.col("price"))),
            "last_execution_volume": ("last", F.when(fill, F.col("size"))),
            "_last_ts": ("last", F.when(fill, F.col("ts_event"))),
        },
    )
    both = F.col("session_buy_volume") + F.col("session_sell_volume")
    return out.withColumns(
        {
            "delta_ratio": ratio(F.col("session_buy_volume") - F.col("session_sell_volume"), both),
            "time_since_last_execution": (F.col("ts_event") - F.col("_last_ts")) / 1e9,
            "session_vwap": F.col("session_value") / F.nullif(F.col("session_volume"), F.lit(0)),
        }
    ).drop("_last_ts", "session_value")


def fair_values(df: DataFrame, tick: float, mid: str = "mid", depth: Column | None = None) -> DataFrame:
    """Session VWAP, imbalance-adjusted and execution-weighted mid prices.

    Needs ``execution_footprint`` columns and the book's totals.
    """
    total = depth if depth is not None else F.col("bid_total") + F.col("ask_total")
    weight = F.least(F.col("last_execution_volume") / 1000, F.lit(1.0))
    m = F.col(mid)
    return df.withColumns(
        {
            "vwap_mid": F.coalesce("session_vwap", m),
            "imbalance_adjusted_mid": F.when(total > 0, m + F.col("session_delta") / total * tick).otherwise(m),
            "execution_weighted_mid": F.when(
                F.col("last_execution_volume") > 0, (1 - weight) * m + weight * F.col("last_execution_price")
            ).otherwise(m),
        }
    )


def posted_volume(df: DataFrame, order: EventOrder) -> DataFrame:
    """``posted``: size resting at the event's price on both sides before it."""
    order = order.measured(df)
    levels = level_book(df, order)
    at_price = order.by(*order.keys, "book_epoch", "price")
    own = lambda s: F.when(F.col("level_side") == s, F.col("level_size"))
    out = running(levels, at_price, {"_pb": ("last", own("B")), "_pa": ("last", own("A"))}, exclusive=("_pb", "_pa"))
    return out.withColumn("posted", F.coalesce("_pb", F.lit(0)) + F.coalesce("_pa", F.lit(0))).drop("_pb", "_pa")


def absorption_exhaustion(df: DataFrame, order: EventOrder) -> DataFrame:
    """Fills that take over half of the posted size, or find under a tenth of their own."""
    d = posted_volume(df, order)
    share = F.col("size") / F.nullif(F.col("posted"), F.lit(0))
    return d.withColumns(
        {
            "absorption_ratio": F.when(_is_fill(), share),
            "is_absorption": _is_fill() & F.coalesce(share > 0.5, F.lit(False)),
            "is_exhaustion": _is_fill() & (F.col("posted") < F.col("size") * 0.1),
        }
    )


def absorption_counts(df: DataFrame, order: EventOrder, window_ns: int = MINUTE) -> DataFrame:
    """Absorption and exhaustion events, and the mean ratio, in the trailing window."""
    d = absorption_exhaustion(df, order)
    hit = F.col("is_absorption")
    sums = {"a": flag(hit), "r": F.when(hit, F.col("absorption_ratio")).otherwise(0.0), "x": flag(F.col("is_exhaustion"))}
    d = trailing(d, order, sums, {"_w": window_ns - 1})
    return d.withColumns(
        {
            "absorption_events_1m": F.col("_w_a"),
            "exhaustion_events_1m": F.col("_w_x"),
            "avg_absorption_ratio": ratio(F.col("_w_r"), F.col("_w_a")),
        }
    ).drop("_w_a", "_w_r", "_w_x", "_w_events")


@one_pin
def large_orders(df: DataFrame, order: EventOrder, large: int = 1000) -> DataFrame:
    """Events of at least ``large`` with the fragments their order showed before."""
    order = order.measured(df)
    piece = F.col("action").isin("A", "M")
    per = order.by(*order.keys, "order_id")
    d = running(
        df,
        per,
        {
            "fragment_count": ("count", F.when(piece, F.lit(1))),
            "total_fragmented_size": ("sum", F.when(piece, F.col("size")).otherwise(0)),
            "_first": ("first", F.when(piece, F.col("ts_event"))),
            "_last": ("last", F.when(piece, F.col("ts_event"))),
        },
        exclusive=("fragment_count", "total_fragmented_size", "_first", "_last"),
    )
    several = F.col("fragment_count") > 1
    return (
        d.filter(F.col("size") >= large)
        .withColumns(
            {
                "is_fragmented": several,
                "total_fragmented_size": F.when(several, F.col("total_fragmented_size")).otherwise(0),
                "time_to_complete": F.when(several, F.col("_last") - F.col("_first")).otherwise(0),
            }
        )
        .drop("_first", "_last")
    )


def anchored_groups(df: DataFrame, order: EventOrder, window_ns: int, out: str = "group") -> DataFrame:
    """Number groups that open at a row and hold rows up to ``window_ns`` after it; the
    first row beyond opens the next group."""

    def fn(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ts = g[order.ts]
        ids = np.zeros(len(ts), dtype="int64")
        start, k = 0, 0
        while start < len(ts):
            end = int(np.searchsorted(ts, ts[start] + window_ns, side="right"))
            ids[start:end] = k
            start, k = end, k + 1
        return {out: ids}

    order = order.measured(df)
    if order.hot:
        return _anchored_in_cells(df, order, window_ns, out)
    return per_group(df, order.frames(), {out: "bigint"}, fn, [order.ts])


def _anchored_in_cells(df: DataFrame, order: EventOrder, window_ns: int, out: str) -> DataFrame:
    """The same for keys that fit no task: every instant knows the start that would follow
    a group opened at it, and the starts reached from the first one are found by doubling
    those jumps, in as many rounds as the number of groups has binary digits."""
    keys = list(order.keys)
    at = pin(df.select(*keys, F.col(order.ts).alias("_t")).distinct())
    # read backwards in time, the last instant before a window's end is the next start
    ends = at.select(*keys, (-(F.col("_t") + window_ns)).alias("_neg"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_seen"), "_t")
    own = at.select(*keys, (-F.col("_t")).alias("_neg"), F.lit(1).alias("_kind"), F.col("_t").alias("_seen"), "_t")
    back = EventOrder(keys=order.keys, order=("_neg", "_kind", "_t"), ts="_neg", hot=True, cell_rows=order.cell_rows)
    seen = running(ends.unionByName(own), back, {"_next": ("last", "_seen")})
    jump = pin(seen.filter((F.col("_kind") == 0) & F.col("_next").isNotNull()).select(*keys, "_t", "_next"))
    starts = pin(at.groupBy(*keys).agg(F.min("_t").alias("_t")))
    count, more = starts.count(), True
    while more:
        reached = starts.join(jump, [*keys, "_t"]).select(*keys, F.col("_next").alias("_t"))
        starts = pin(starts.union(reached).distinct())
        more, count = starts.count() > count, starts.count()
        if more:
            far = jump.select(*keys, F.col("_t").alias("_next"), F.col("_next").alias("_far"))
            jump = pin(jump.join(far, [*keys, "_next"]).select(*keys, "_t", F.col("_far").alias("_next")))
    marked = at.join(starts.withColumn("_start", F.lit(1)), [*keys, "_t"], "left")
    forth = EventOrder(keys=order.keys, order=("_t",), ts="_t", hot=True, cell_rows=order.cell_rows)
    numbered = running(marked, forth, {"_n": ("count", "_start")})
    return df.join(numbered.select(*keys, F.col("_t").alias(order.ts), (F.col("_n") - 1).alias(out)), [*keys, order.ts])


@one_pin
def icebergs(
    df: DataFrame, order: EventOrder, min_size: int = 500, refills: int = 3, window_ns: int = MINUTE
) -> DataFrame:
    """Repeated large adds at one price within a window opened by the first of them."""
    order = order.measured(df)
    adds = df.filter((F.col("action") == "A") & (F.col("size") >= min_size))
    level = order.by(*order.keys, "price")
    d = anchored_groups(adds, level, window_ns, "_candidate")
    cand = level.by(*level.keys, "_candidate")

    def gaps(x: DataFrame, f: Frames) -> DataFrame:
        return x.withColumn("_gap", (F.col("ts_event") - F.lag("ts_event").over(f.ordered())).cast("double"))

    d = windowed(d, cand, gaps, before=1)
    d = running(
        d,
        cand,
        {
            "replenishment_count": ("count", F.lit(1)),
            "visible_size": ("sum", "size"),
            "iceberg_side": ("first", "side"),
            "_g1": ("sum", "_gap"),
            "_g2": ("sum", F.col("_gap") * F.col("_gap")),
        },
    )
    n = F.col("replenishment_count") - 1
    mean = F.col("_g1") / n
    sd = F.sqrt(F.greatest(F.col("_g2") / n - mean * mean, F.lit(0.0)))
    consistency = 1 / (1 + sd / F.nullif(mean, F.lit(0.0)))
    return (
        d.filter(F.col("replenishment_count") >= refills)
        .withColumns(
            {
                "confidence_score": F.least(F.coalesce(consistency, F.lit(1.0)) * 0.8, F.lit(0.9)),
                "estimated_hidden_size": F.floor(F.col("visible_size") * 7.5),
            }
        )
        .drop("_candidate", "_gap", "_g1", "_g2")
    )


@one_pin
def spoofing_events(df: DataFrame, order: EventOrder, min_size: int = 500, within_ns: int = 5_000_000_000, layer: int = 1000) -> DataFrame:
    """Large orders cancelled soon after they were added, scored and typed."""
    order = order.measured(df)
    added = F.col("action") == "A"
    per = order.by(*order.keys, "order_id")
    d = running(df, per, {"_life": ("count", F.when(added, F.lit(1)))})
    d = running(
        d,
        per.by(*per.keys, "_life"),
        {
            "_t0": ("first", F.when(added, F.col("ts_event"))),
            "placed_size": ("first", F.when(added, F.col("size"))),
            "placed_price": ("first", F.when(added, F.col("price"))),
        },
    )
    life = F.col("ts_event") - F.col("_t0")
    hit = (F.col("action") == "C") & (F.col("_life") > 0) & (F.col("placed_size") >= min_size) & (life <= within_ns)
    kind = F.when(F.col("placed_size") > layer, "layering").when(life < 1_000_000_000, "quote_stuffing").otherwise("spoofing")
    return (
        d.filter(hit)
        .withColumns(
            {
                "time_to_cancel": life,
                "spoofing_score": F.least(F.lit(1.0), (within_ns - life) / F.lit(float(within_ns))),
                "spoofing_type": kind,
            }
        )
        .drop("_life", "_t0")
    )


def _fills(df: DataFrame, order: EventOrder) -> DataFrame:
    """Executions with the change from the previous execution price (0 for the first)."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        return d.withColumn("_chg", F.coalesce(F.col("price") - F.lag("price").over(f.ordered()), F.lit(0.0)))

    fills = df.filter(_is_fill()).withColumns({"_d": signed_size(), "_size": F.col("size").cast("double")})
    return windowed(fills, order, body, before=1)


def institutional_flow(df: DataFrame, order: EventOrder, n: int = 100) -> DataFrame:
    """Flow direction, strength and confidence over the last n executions."""
    order = order.measured(df)
    d = _fills(df, order)

    def body(x: DataFrame, f: Frames) -> DataFrame:
        x = rolling(
            x,
            f,
            {"volume_impact": ("_size", n, "sum"), "_delta": ("_d", n, "sum"), "price_impact": ("_chg", n, "sum"),
             "_mean": ("_size", n, "mean"), "_sd": ("_size", n, "std_pop")},
            strict=True,
        )
        share = F.col("_delta") / F.nullif(F.col("volume_impact"), F.lit(0.0))
        strong = F.abs(share) > 0.3
        return x.withColumns(
            {
                "flow_type": F.when(strong & (share > 0), "buy_pressure").when(strong, "sell_pressure").otherwise("neutral"),
                "strength": F.when(strong, F.least(F.abs(share), F.lit(1.0))).otherwise(0.0),
                "confidence": F.when(F.col("_mean") > 0, 1 / (1 + F.col("_sd") / F.col("_mean"))).otherwise(0.0),
            }
        )

    out = windowed(d, order, body, before=n)
    return out.filter(F.col("volume_impact") > 0).drop("_chg", "_d", "_size", "_delta", "_mean", "_sd")


def regime_events(df: DataFrame, order: EventOrder, n: int = 200) -> DataFrame:
    """Volatile / trending / quiet / mean-reverting over the last n executions."""
    order = order.measured(df)
    d = _fills(df, order).withColumn("_abs", F.abs("_chg"))

    def body(x: DataFrame, f: Frames) -> DataFrame:
        x = rolling(
            x,
            f,
            {"volatility_level": ("_abs", n, "std_pop"), "liquidity_level": ("_size", n, "mean"),
             "_trend": ("_chg", n, "mean"), "_tsd": ("_chg", n, "std_pop")},
            strict=True,
        )
        kind = (
            F.when(F.col("volatility_level") > 2.0, "volatile")
            .when((F.abs("_trend") > 1.0) & (1 / (1 + F.col("_tsd")) > 0.7), "trending")
            .when(F.col("liquidity_level") < 100, "quiet")
            .otherwise("mean_reverting")
        )
        x = x.withColumn("regime_type", F.when(F.col("volatility_level").isNotNull(), kind))
        prev = F.lag("regime_type").over(f.ordered())
        p = F.when(prev.isNull(), 0.2).when(prev == F.col("regime_type"), 0.1).otherwise(0.3)
        return x.withColumn("transition_probability", p)

    out = windowed(d, order, body, before=n + 1)
    return out.filter(F.col("regime_type").isNotNull()).drop("_chg", "_d", "_size", "_abs", "_trend", "_tsd")


def liquidity_stress(book: DataFrame, order: EventOrder, n: int = 50) -> DataFrame:
    """Executions where the spread widened or the touch thinned against n executions."""
    order = order.measured(book)
    d = book.filter(_is_fill() & F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull())
    d = d.withColumn("touch_depth", F.col("bid_size") + F.col("ask_size"))

    def body(x: DataFrame, f: Frames) -> DataFrame:
        w = f.rows(n)
        spread, depth = full(F.avg("spread").over(w), w, n), full(F.avg("touch_depth").over(w), w, n)
        x = x.withColumns({"_s": spread, "_q": depth})
        return x.withColumns(
            {
                "spread_widening": F.when(F.col("_s") > 0, (F.col("spread") - F.col("_s")) / F.col("_s")).otherwise(0.0),
                "depth_reduction": F.when(F.col("_q") > 0, (F.col("_q") - F.col("touch_depth")) / F.col("_q")).otherwise(0.0),
            }
        )

    out = windowed(d, order, body, before=n)
    level = F.when(F.col("spread_widening") > 0.5, 0.5).otherwise(0.0) + F.when(F.col("depth_reduction") > 0.7, 0.5).otherwise(0.0)
    return out.withColumn("stress_level", level).filter(F.col("_s").isNotNull() & (F.col("stress_level") > 0.3)).drop("_s", "_q")


def anomalies(book: DataFrame, order: EventOrder, tick: float, n: int = 100, spreads: int = 50) -> DataFrame:
    """One row per anomaly: volume_spike (3 sigma), price_jump (5 ticks), spread_widening
    (twice the mean). One execution can give several."""
    order = order.measured(book)
    d = _fills(book, order)
    quoted = F.when(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull(), F.col("spread"))

    def carry(x: DataFrame) -> DataFrame:
        x = running(x.withColumn("_q", quoted), order, {"_qn": ("count", "_q")})
        # the last `spreads` quoted executions, as of any execution
        only = x.filter(F.col("_q").isNotNull())
        mean = windowed(
            only, order, lambda y, f: y.withColumn("_qm", full(F.avg("_q").over(f.rows(spreads)), f.rows(spreads), spreads)), spreads
        )
        mean = mean.select(*order.keys, *order.order, "_qm", F.col("_q").alias("_now"))
        return asof_last(x, mean, ["_qm", "_now"], order)

    d = carry(d)

    def body(x: DataFrame, f: Frames) -> DataFrame:
        return rolling(x, f, {"_mean": ("_size", n, "mean"), "_sd": ("_size", n, "std_pop")}, strict=True)

    d = windowed(d, order, body, before=n)
    size, jump = F.col("_size"), F.abs("_chg")

    def row(kind: str, cond: Column, severity: Column, impact: Column) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(kind).alias("anomaly_type"), F.least(F.lit(1.0), severity).alias("severity"), impact.alias("impact_score")
            ),
        )

    found = F.array_compact(
        F.array(
            row("volume_spike", size > F.col("_mean") + 3 * F.col("_sd"), (size - F.col("_mean")) / (3 * F.col("_sd")), size / F.col("_mean")),
            row("price_jump", jump > 5 * tick, jump / (5 * tick), jump / tick),
            row("spread_widening", F.col("_now") > 2 * F.col("_qm"), (F.col("_now") - F.col("_qm")) / (2 * F.col("_qm")), F.col("_now") / F.col("_qm")),
        )
    )
    return d.select(*order.keys, *order.order, F.explode(found).alias("_a")).select(*order.keys, *order.order, "_a.*")


def _last_k(df: DataFrame, order: EventOrder, cols, k: int) -> DataFrame:
    return windowed(df, order, lambda d, f: d.withColumns(cols(f)), before=k)


def _slope(c: str, f: Frames, k: int) -> Column:
    return F.regr_slope(F.col(c), F.col("_i").cast("double")).over(f.rows(k))


def detector_summaries(df: DataFrame, flows: DataFrame, regimes: DataFrame, stress: DataFrame, order: EventOrder) -> DataFrame:
    """State of the latest detected events as of every row of ``df``."""
    order = order.measured(df)
    number = lambda d: running(d, order, {"_i": ("count", F.lit(1))})

    def flow_cols(f: Frames) -> dict[str, Column]:
        share = lambda t: F.count_if(F.col("flow_type") == t).over(f.rows(50))
        seen = F.count(F.lit(1)).over(f.rows(20))
        return {
            "institutional_flow_strength": F.avg("strength").over(f.rows(100)) * F.avg("confidence").over(f.rows(100)),
            "flow_predictability": F.greatest(*[share(t) for t in ("buy_pressure", "sell_pressure", "neutral")])
            / F.count(F.lit(1)).over(f.rows(50)),
            "flow_exhaustion_signals": F.when(
                seen >= 5, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -_slope("strength", f, 20)) * 10)
            ).otherwise(0.0),
        }

    def regime_cols(f: Frames) -> dict[str, Column]:
        # transitions among the last ten events: nine neighbouring pairs
        pairs = F.count(F.col("_prev")).over(f.rows(9))
        turns = F.count_if(F.col("_prev") != F.col("regime_type")).over(f.rows(9))
        return {
            "volatility_regime_share": F.count_if(F.col("regime_type") == "volatile").over(f.rows(20))
            / F.count(F.lit(1)).over(f.rows(20)),
            "regime_transition_probability": F.when(pairs > 0, turns / pairs).otherwise(0.0),
            "regime_persistence": 1 - F.when(pairs > 0, turns / pairs).otherwise(0.0),
        }

    def stress_cols(f: Frames) -> dict[str, Column]:
        seen = F.count(F.lit(1)).over(f.rows(10))
        return {
            "liquidity_regime": F.least(F.lit(1.0), F.avg("stress_level").over(f.rows(20))),
            "liquidity_stress_now": F.col("stress_level"),
            "liquidity_recovery_signals": F.when(
                seen >= 3, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -_slope("stress_level", f, 10)) * 5)
            ).otherwise(0.0),
        }

    prev = windowed(regimes, order, lambda d, f: d.withColumn("_prev", F.lag("regime_type").over(f.ordered())), before=1)
    out = df
    for events, cols, k in ((number(flows), flow_cols, 100), (prev, regime_cols, 20), (number(stress), stress_cols, 20)):
        done = _last_k(events, order, cols, k)
        names = list(cols(order.frames()))
        out = asof_last(out, done.select(*order.keys, *order.order, *names), names, order).fillna(0.0, subset=names)
    return out


def flow_autocorrelation(df: DataFrame, order: EventOrder, n: int = 100, least: int = 50) -> DataFrame:
    """|lag-1 autocorrelation| of execution delta over the last n executions."""
    order = order.measured(df)
    d = _fills(df, order)

    def body(x: DataFrame, f: Frames) -> DataFrame:
        value, w = F.col("_d").cast("double"), f.rows(n)
        x = x.withColumns({"_x": value, "_y": F.lag(value).over(f.ordered())})
        # sums over the frame; the pair that reaches out of it is taken off again
        x = x.withColumns(
            {"_n": F.count("_x").over(w), "_s": F.sum("_x").over(w), "_ss": F.sum(F.col("_x") * F.col("_x")).over(w),
             "_p": F.sum(F.col("_x") * F.col("_y")).over(w), "_one": F.struct(F.first("_x").over(w).alias("x"), F.first("_y").over(w).alias("y"))}
        )
        size, mu, head = F.col("_n"), F.col("_s") / F.col("_n"), F.col("_one.x")
        inner = F.coalesce("_p", F.lit(0.0)) - F.coalesce(head * F.col("_one.y"), F.lit(0.0))
        var = F.col("_ss") / size - mu * mu
        cov = inner - mu * (2 * F.col("_s") - head - F.col("_x")) + (size - 1) * mu * mu
        share = F.when(var > 1e-12 * (1 + mu * mu), F.least(F.lit(1.0), F.abs(cov / ((size - 1) * var)))).otherwise(0.0)
        x = x.withColumn("flow_autocorrelation", F.when(size >= least, share).otherwise(0.0))
        return x.drop("_y", "_n", "_s", "_ss", "_p", "_one")

    return windowed(d, order, body, before=n).drop("_x", "_mu", "_chg", "_d", "_size")


def multi_scale_ofi(df: DataFrame, order: EventOrder, ofi: str = "ofi_norm", n: int = 1000) -> DataFrame:
    """Fast, medium and slow averages of imbalance (started at 0) and volatility."""
    alphas = {"ofi_fast": 0.1, "ofi_medium": 0.01, "ofi_slow": 0.001}
    order = order.measured(df)
    df = df.withColumn("_x", F.coalesce(F.col(ofi), F.lit(0.0)))
    if order.hot:  # the slow average reaches back farther than a cell
        df = ema_in_cells(df, order, "_x", alphas)

    def body(d: DataFrame, f: Frames) -> DataFrame:
        d = d.withColumns(
            {
                "_chg": F.col("price") - F.lag("price").over(f.ordered()),
                "_gap": F.col("ts_event") - F.lag("ts_event").over(f.ordered()),
            }
        )
        if not order.hot:
            d = ema(d, f, {name: ("_x", a, None) for name, a in alphas.items()})
        d = rolling(
            d, f,
            {"_sd": ("_chg", n, "std_pop"), "_k": ("_chg", n, "count"), "_m": ("_chg", n, "mean"), "_im": ("_x", n, "mean"), "_g": ("_gap", n, "mean")},
        )
        zero = F.lit(0.0)
        return d.withColumns(
            {
                "volatility_estimate": F.when(F.col("_k") > 1, F.col("_sd")).otherwise(zero),
                "microstructure_indicators": F.concat(
                    F.array(F.coalesce("_m", zero), F.coalesce("_im", zero), F.coalesce(1 / F.nullif(F.col("_g"), zero), zero)),
                    F.array_repeat(zero, 7),
                ),
            }
        ).drop("_x", "_chg", "_gap", "_sd", "_k", "_m", "_im", "_g")

    return windowed(df, order, body, before=n + 1)


# ---------------------------------------------------------------- documented features


def cumulative_delta(df: DataFrame, order: EventOrder, horizons: dict[str, int]) -> DataFrame:
    """Session delta and trailing-horizon deltas of executions."""
    d = execution_footprint(df, order)
    return trailing(d, order, {"delta": F.when(_is_fill(), signed_size()).otherwise(0)}, horizons)


def absorption_profile(df: DataFrame, order: EventOrder, horizons: dict[str, int]) -> DataFrame:
    """Per horizon: absorption ratio and strength, exhaustion rate, depletion, refill."""
    d = absorption_exhaustion(df, order)
    change = F.col("level_size") - F.col("level_size_before")
    sums = {
        "taken": F.when(_is_fill(), F.col("size")).otherwise(0),
        "posted": F.when(_is_fill(), F.col("posted")).otherwise(0),
        "absorbed": F.when(F.col("is_absorption"), F.col("size")).otherwise(0),
        "exhausted": flag(F.col("is_exhaustion")),
        "fills": flag(_is_fill()),
        "lost": F.when(change < 0, -change).otherwise(0),
        "added": F.when(change > 0, change).otherwise(0),
    }
    out = trailing(d, order, sums, horizons)
    cols = {}
    for h in horizons:
        g = lambda c, h=h: F.col(f"{h}_{c}")
        cols |= {
            f"{h}_absorption_ratio": ratio(g("taken"), g("posted")),
            f"{h}_absorption_strength": ratio(g("absorbed"), g("taken")),
            f"{h}_exhaustion_rate": ratio(g("exhausted"), g("fills")),
            f"{h}_depth_depletion": g("lost"),
            f"{h}_refill_rate": ratio(g("added"), g("lost")),
        }
    scratch = [f"{h}_{c}" for h in horizons for c in (*sums, "events")]
    return out.withColumns(cols).drop(*scratch)


def weighted_prices(df: DataFrame, order: EventOrder, horizons: dict[str, int]) -> DataFrame:
    """Trade-weighted average, execution VWAP and absorption-adjusted price per horizon."""
    d = absorption_exhaustion(df, order)
    free = _is_fill() & ~F.col("is_absorption")
    sums = {
        "n": flag(_is_fill()),
        "p": F.when(_is_fill(), F.col("price")).otherwise(0.0),
        "v": F.when(_is_fill(), F.col("size")).otherwise(0),
        "pv": F.when(_is_fill(), F.col("price") * F.col("size")).otherwise(0.0),
        "fv": F.when(free, F.col("size")).otherwise(0),
        "fpv": F.when(free, F.col("price") * F.col("size")).otherwise(0.0),
    }
    out = trailing(d, order, sums, horizons)
    cols = {}
    for h in horizons:
        g = lambda c, h=h: F.col(f"{h}_{c}")
        cols |= {
            f"{h}_trade_avg_price": ratio(g("p"), g("n"), None),
            f"{h}_execution_vwap": ratio(g("pv"), g("v"), None),
            f"{h}_absorption_adjusted_price": ratio(g("fpv"), g("fv"), None),
        }
    return out.withColumns(cols).drop(*[f"{h}_{c}" for h in horizons for c in (*sums, "events")])


def conversion(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """Fill ratio, posted-to-filled and conversion efficiency per level or time bucket."""
    posted = F.sum(F.when(F.col("action") == "A", F.col("size")).otherwise(0))
    filled = F.sum(F.when(_is_fill(), F.col("size")).otherwise(0))
    adds, fills = F.count_if(F.col("action") == "A"), F.count_if(_is_fill())
    out = df.groupBy(*by).agg(posted.alias("posted"), filled.alias("filled"), adds.alias("adds"), fills.alias("fills"))
    return out.withColumns(
        {
            "fill_ratio": ratio(F.col("fills"), F.col("adds")),
            "posted_to_filled": ratio(F.col("posted"), F.col("filled")),
            "conversion_efficiency": ratio(F.col("filled"), F.col("posted")),
        }
    )


def phantom_liquidity(df: DataFrame, mids: DataFrame, order: EventOrder, far: float) -> DataFrame:
    """Per key: never-filled orders placed farther than ``far`` from the mid."""
    from tickloom.operators.joins import order_lifecycle

    life = order_lifecycle(df, (*order.keys, "order_id")).filter(F.col("added_ts").isNotNull())
    placed = life.withColumnsRenamed({"added_ts": order.ts}).withColumn(
        order.order[-1], F.lit(9223372036854775807).cast("long")
    )
    seen = asof_last(placed, mids.select(*order.keys, *order.order, "mid"), ["mid"], order)
    away = F.abs(F.col("added_price") - F.col("mid"))
    ghost = (F.col("fills") == 0) & (away > far)
    return seen.groupBy(*order.keys).agg(
        F.count_if(ghost).alias("phantom_orders"),
        F.avg(F.when(ghost, away)).alias("phantom_distance"),
        (F.sum(F.when(ghost, F.col("added_size")).otherwise(0)) / F.sum("added_size")).alias("phantom_volume_ratio"),
    )


def footprint_clusters(grid: DataFrame) -> DataFrame:
    """Per window: concentration of volume over levels, centroid move, run of its sign.

    Takes a price-by-time footprint grid.
    """
    from pyspark.sql import Window

    v = (F.col("buy_volume") + F.col("sell_volume")).cast("double")
    g = grid.groupBy("instrument", "bar_start").agg(
        F.sum(v).alias("volume"), F.sum(v * v).alias("_vv"), F.sum(v * F.col("level")).alias("_vl"), F.sum("delta").alias("delta")
    )
    g = g.filter(F.col("volume") > 0)
    w = Window.partitionBy("instrument").orderBy("bar_start")
    g = g.withColumns(
        {
            "cluster_strength": F.col("_vv") / (F.col("volume") * F.col("volume")),
            "centroid": F.col("_vl") / F.col("volume"),
            "_sign": F.signum("delta"),
        }
    )
    g = g.withColumn("_turn", flag(F.lag("_sign").over(w).isNull() | (F.lag("_sign").over(w) != F.col("_sign"))))
    g = g.withColumn("_run", F.sum("_turn").over(w))
    run = Window.partitionBy("instrument", "_run").orderBy("bar_start")
    return g.withColumns(
        {"cluster_migration": F.col("centroid") - F.lag("centroid").over(w), "cluster_persistence": F.row_number().over(run)}
    ).drop("_vv", "_vl", "_sign", "_turn", "_run")


def aggressor_profile(df: DataFrame, order: EventOrder, n: int = 100, window_ns: int = MINUTE) -> DataFrame:
    """Size quantiles of the last n executions, their frequency, length of same-side runs."""
    from tickloom.operators.microstructure import trade_runs

    order = order.measured(df)
    d = trade_runs(df, order).filter(_is_fill())

    def body(x: DataFrame, f: Frames) -> DataFrame:
        w = f.rows(n)
        q = F.percentile("size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
        return x.withColumn("aggressor_size_quartiles", q)

    d = windowed(d, order, body, before=n)
    d = trailing(d, order, {}, {"_w": window_ns})
    return d.withColumns(
        {
            "aggressor_frequency": F.col("_w_events") / (window_ns / 1e9),
            "aggressor_persistence": F.col("micro_aggressive_sequence_length"),
        }
    ).drop("_w_events")


def impact_and_stability(book: DataFrame, order: EventOrder, by: list[str]) -> DataFrame:
    """Per group: slope of |price move| on size, share of unchanged quotes."""
    order = order.measured(book)

    def quotes(d: DataFrame, f: Frames) -> DataFrame:
        w = f.ordered()
        same = F.col("best_bid").eqNullSafe(F.lag("best_bid").over(w)) & F.col("best_ask").eqNullSafe(F.lag("best_ask").over(w))
        return d.withColumn("_same", flag(same))

    q = windowed(book, order, quotes, before=1)
    stable = q.groupBy(*by).agg(F.avg("_same").alias("quote_stability"))
    fills = _fills(book, order)
    slope = fills.groupBy(*by).agg(F.regr_slope(F.abs("_chg"), F.col("_size")).alias("impact_slope"))
    return stable.join(slope, by, "left")


def resilience(stress: DataFrame, book: DataFrame, order: EventOrder) -> DataFrame:
    """Seconds from each stressed execution to the next execution that is not stressed."""
    order = order.measured(book)
    keys, ids = list(order.keys), list(order.order)
    fills = book.filter(_is_fill()).select(*keys, *ids)
    marked = fills.join(stress.select(*keys, *ids, F.lit(True).alias("_hit")), [*keys, *ids], "left")
    back = EventOrder(keys=order.keys, order=("_back", "_tie"), ts="_back", hot=order.hot, cell_rows=order.cell_rows)
    marked = marked.withColumns({"_back": -F.col(order.ts), "_tie": -F.col(ids[-1])})
    calm = running(marked, back, {"_calm": ("last", F.when(F.col("_hit").isNull(), F.col(order.ts)))})
    return calm.filter("_hit").select(*keys, *ids, ((F.col("_calm") - F.col(order.ts)) / 1e9).alias("recovery_seconds"))


def horizon_relations(df: DataFrame, order: EventOrder, short: str, long: str, n: int = 50) -> DataFrame:
    """Rolling correlation of two horizon deltas, momentum persistence, reversal signal."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        s, g = F.col(f"{short}_delta"), F.col(f"{long}_delta")
        d = correlation(d, f, "delta_correlation", s.cast("double"), g.cast("double"), n)
        agree = flag((F.signum(s) == F.signum(g)) & (s != 0))
        d = d.withColumn("_agree", agree)
        return d.withColumns(
            {
                "momentum_persistence": F.avg("_agree").over(f.rows(n)),
                "reversal_signal": flag((s * g < 0) & (F.abs(s) > 0.5 * F.abs(g))),
            }
        ).drop("_agree")

    return windowed(df, order, body, before=n)


def bounded_norms(df: DataFrame, order: EventOrder, horizon: str, alpha: float = 0.01) -> DataFrame:
    """Execution volume against its own average, and delta squashed to (-1, 1)."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        d = ema(d, f, {"_avg": (F.col(f"{horizon}_total_volume").cast("double"), alpha, False)})
        return d.withColumns(
            {
                "execution_volume_norm": ratio(F.col(f"{horizon}_total_volume"), F.col("_avg")),
                "delta_norm": F.tanh(ratio(F.col(f"{horizon}_delta"), F.col("_avg"))),
            }
        ).drop("_avg")

    return windowed(df, order, body, before=reach(alpha))


def sweeps(book: DataFrame, order: EventOrder, n: int = 100) -> DataFrame:
    """Probability and intensity of multi-level fills, with rolling counts."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        k = F.col("sweep_levels")
        d = d.withColumns(
            {
                "probability": F.when(k > 1, F.least(F.lit(1.0), k / 5.0)).otherwise(0.0),
                "multi_level_consumption": flag(k > 1),
                "intensity": F.coalesce(F.col("size") * k, F.lit(0.0)),
            }
        )
        d = d.withColumn("_hit", flag(F.col("probability") > 0.5))
        return rolling(d, f, {"recent": ("_hit", n, "sum"), "volume_rate": ("intensity", n, "mean")}, strict=True).drop("_hit")

    return windowed(book, order, body, before=n)
