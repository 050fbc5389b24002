"""Event-scale features: windows of events, queues, voids, spoofing, runs, intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cols import flag, roll
from tickloom.functions.fast import per_group, rolling, rolling_quantile
from tickloom.operators.horizons import trailing
from tickloom.order import EventOrder, Frames, one_pin, running, windowed

EVENT_WINDOWS = (10, 25, 50, 100, 200, 500)
LARGE_HISTORY = 1000


@one_pin
def clamped_sum(
    df: DataFrame, order: EventOrder, delta: Column, after: str, before: str | None = None, reset: str | None = None
) -> DataFrame:
    """Running sum that never goes below zero, per key of ``order``.

    max(0, .) at every step equals S - min(0, running min of S), so it is two scans.
    """
    order = order.measured(df)
    d = df.withColumn("_delta", delta)
    d = running(d, order, {"_s": ("sum", "_delta")})
    d = running(d, order, {"_m": ("min", "_s")})
    d = d.withColumn(after, F.col("_s") - F.least(F.col("_m"), F.lit(0)))
    if before:
        prev_s = F.col("_s") - F.col("_delta")
        d = running(d, order, {"_pm": ("min", "_s")}, exclusive=("_pm",))
        d = d.withColumn(before, prev_s - F.least(F.coalesce(F.col("_pm"), F.lit(0)), F.lit(0))).drop("_pm")
    return d.drop("_delta", "_s", "_m")


def large_threshold(d: DataFrame, f: Frames, n: int = LARGE_HISTORY) -> DataFrame:
    """``_q90``: rolling 0.9 quantile of size, NULL until n rows."""

    def fn(g):
        return {"_q90": rolling_quantile(g["size"], n, 0.9)}

    return per_group(d, f, {"_q90": "double"}, fn, ["size"], n)


def event_windows(df: DataFrame, order: EventOrder, windows: tuple[int, ...] = EVENT_WINDOWS, history: int = LARGE_HISTORY) -> DataFrame:
    """Shares of fills, buys and large orders, volume and volatility over event counts."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        d = large_threshold(d, f, history)
        w = f.ordered()
        gap = F.col("ts_event") - F.lag("ts_event").over(w)
        p9 = F.lag("price", 9).over(w)
        d = d.withColumns(
            {
                "_fill": flag(F.col("action") == "F"),
                "_buy": flag(F.col("side") == "B"),
                "_big": flag(F.col("size") > F.col("_q90")),
                "micro_price_momentum_10e": (F.col("price") - p9) / F.nullif(p9, F.lit(0.0)),
                "micro_tick_direction": F.signum(F.col("price") - F.lag("price").over(w)),
                "micro_time_since_last": gap,
                "micro_event_rate": 1.0 / (gap / 1_000_000 + 1e-6),
            }
        )
        specs = {}
        for n in windows:
            specs |= {
                f"micro_aggression_ratio_{n}e": ("_fill", n, "mean"),
                f"micro_buy_ratio_{n}e": ("_buy", n, "mean"),
                f"micro_volume_intensity_{n}e": ("size", n, "sum"),
                f"micro_price_volatility_{n}e": ("price", n, "std"),
                f"micro_large_order_freq_{n}e": ("_big", n, "mean"),
            }
        d = rolling(d, f, specs, strict=True)
        return d.withColumn("micro_tick_momentum_50e", roll("micro_tick_direction", f, 50, "sum")).drop(
            "_q90", "_fill", "_buy", "_big"
        )

    return windowed(df, order, body, before=history + max(windows))


@one_pin
def queue_position(df: DataFrame, order: EventOrder) -> DataFrame:
    """Orders ahead of an added order at its price and side, and 1/position."""
    level = order.by(*order.keys, "price", "side")
    step = F.when(F.col("action") == "A", 1).when(F.col("action") == "C", -1).otherwise(0).cast("long")
    d = clamped_sum(df, level, step, "micro_queue_length", "_ahead")
    added = F.col("action") == "A"
    return d.withColumns(
        {
            "micro_ahead_in_queue": F.when(added, F.col("_ahead")),
            "micro_queue_position_advantage": F.when(added, 1 / (F.col("_ahead") + 1)),
        }
    ).drop("_ahead")


def dominance(df: DataFrame, order: EventOrder, n: int = 100) -> DataFrame:
    """Dominance flips, level concentration and book-flip intensity over n events."""

    def body(d: DataFrame, f: Frames) -> DataFrame:
        d = d.withColumns(
            {
                "_b": F.when(F.col("side") == "B", F.col("size")).otherwise(0),
                "_a": F.when(F.col("side") == "A", F.col("size")).otherwise(0),
                "_bn": flag(F.col("side") == "B"),
                "_an": flag(F.col("side") == "A"),
            }
        )
        d = rolling(d, f, {"_bs": ("_b", n, "sum"), "_as": ("_a", n, "sum")}, strict=True)
        d = d.withColumn("_dom", (F.col("_bs") - F.col("_as")) / (F.col("_bs") + F.col("_as") + 1e-8))
        prior = f.between(-n, -1)
        enough = F.count(F.lit(1)).over(prior) >= n
        nb, na = F.sum("_bn").over(prior), F.sum("_an").over(prior)
        return d.withColumns(
            {
                "micro_book_dominance_flip": F.coalesce(
                    F.abs(F.col("_dom") - F.lag("_dom").over(f.ordered())), F.lit(0.0)
                ),
                "micro_level_concentration": F.when(
                    enough, F.size(F.collect_set("price").over(prior)) / F.lit(float(n))
                ).otherwise(0.5),
                "micro_book_flip_intensity": F.when(
                    enough & (nb + na > 0), 1 - F.abs(nb - na) / (nb + na)
                ).otherwise(0.0),
            }
        ).drop("_b", "_a", "_bn", "_an", "_bs", "_as", "_dom")

    return windowed(df, order, body, before=n + 1)


@one_pin
def liquidity_void(df: DataFrame, order: EventOrder, n: int = 100) -> DataFrame:
    """Volume pulled by cancels, its speed, void probability and momentum."""
    order = order.measured(df)
    level = order.by(*order.keys, "price", "side")
    step = F.when(F.col("action") == "A", F.col("size")).when(F.col("action") == "C", -F.col("size")).otherwise(0)
    d = clamped_sum(df, level, step, "_after", "_prev").drop("_after")

    def body(x: DataFrame, f: Frames) -> DataFrame:
        gap = F.col("ts_event") - F.lag("ts_event").over(f.ordered())
        cancel = F.col("action") == "C"
        x = x.withColumns(
            {
                "micro_liquidity_pulled_volume": F.when(cancel, F.least(F.col("size"), F.col("_prev"))).otherwise(0),
                "_gap": gap,
                "_c": flag(cancel),
                "_a": flag(F.col("action") == "A"),
            }
        )
        prior = f.between(-n, -1)
        enough = F.count(F.lit(1)).over(prior) >= n
        share = F.sum("_c").over(prior) / F.greatest(F.sum("_a").over(prior), F.lit(1))
        return x.withColumns(
            {
                "micro_void_creation_speed": F.when(
                    F.col("_gap") > 0, F.col("micro_liquidity_pulled_volume") / F.col("_gap")
                ).otherwise(0.0),
                "micro_void_probability": F.when(enough, F.least(share, F.lit(1.0))).otherwise(0.0),
                "micro_liquidity_momentum": roll("micro_liquidity_pulled_volume", f, n, "sum"),
            }
        ).drop("_gap", "_c", "_a", "_prev")

    return windowed(d, order, body, before=n + 1)


@one_pin
def spoofing(
    df: DataFrame,
    order: EventOrder,
    n: int = 100,
    history: int = LARGE_HISTORY,
    fast_ns: int = 1_000_000,
    mod_rate: float = 0.001,
) -> DataFrame:
    """Spoof score of cancels from the life of their order since it was last added."""
    order = order.measured(df)

    def local(d: DataFrame, f: Frames) -> DataFrame:
        d = large_threshold(d, f, history)
        prior = f.between(-n, -1)
        enough = F.count(F.lit(1)).over(prior) >= n
        gone = F.sum(F.when(F.col("action") == "C", F.col("size")).otherwise(0)).over(prior)
        fake = gone / F.greatest(F.sum("size").over(prior), F.lit(1))
        return d.withColumn("micro_fake_liquidity_ratio", F.when(enough, fake).otherwise(0.0))

    d = windowed(df, order, local, before=max(history, n + 1))
    per_order = order.by(*order.keys, "order_id")
    added = F.col("action") == "A"
    d = running(d, per_order, {"_life": ("count", F.when(added, F.lit(1)))})
    life = per_order.by(*per_order.keys, "_life")
    d = running(
        d,
        life,
        {
            "_placed_ts": ("first", F.when(added, F.col("ts_event"))),
            "_placed": ("first", F.when(added, F.col("size"))),
            "_mods": ("count", F.when(F.col("action") == "M", F.lit(1))),
            "_filled": ("sum", F.when(F.col("action") == "F", F.col("size")).otherwise(0)),
        },
    )
    alive = F.col("ts_event") - F.col("_placed_ts")
    quick = (F.col("_placed") > F.col("_q90")) & (alive < fast_ns) & (F.col("_filled") / F.col("_placed") < 0.1)
    score = (
        F.when(quick, 0.4).otherwise(0.0)
        + F.when(F.col("_mods") > 2, 0.3).otherwise(0.0)
        + F.when((alive > 0) & (F.col("_mods") / alive > mod_rate), 0.3).otherwise(0.0)
    )
    judged = (F.col("action") == "C") & (F.col("_life") > 0)
    d = d.withColumn("micro_order_lifecycle_suspicion", F.when(judged, score).otherwise(0.0))
    d = d.withColumn("micro_spoof_probability", F.least(F.col("micro_order_lifecycle_suspicion"), F.lit(1.0)))
    return d.withColumn(
        "micro_manipulation_score",
        0.4 * F.col("micro_spoof_probability")
        + 0.3 * F.col("micro_fake_liquidity_ratio")
        + 0.3 * F.col("micro_order_lifecycle_suspicion"),
    ).drop("_q90", "_life", "_placed_ts", "_placed", "_mods", "_filled")


@one_pin
def trade_runs(df: DataFrame, order: EventOrder, keep: int = 20) -> DataFrame:
    """Runs of same-side fills: length, momentum, size escalation, urgency and trends.

    Rows that are not fills do not end a run; ratios use the last ``keep`` fills of it.
    """
    order = order.measured(df)
    fill = F.col("action") == "F"
    side = F.when(fill, F.col("side"))
    d = running(df, order, {"_prev": ("last", side)}, exclusive=("_prev",))
    turn = fill & (F.col("_prev").isNull() | (F.col("_prev") != F.col("side")))
    d = running(d.withColumn("_fill", fill), order, {"_run": ("count", F.when(turn, F.lit(1)))})
    run = order.by(*order.keys, "_run", "_fill")
    d = running(d, run, {"_len": ("count", F.lit(1))})

    def inside(x: DataFrame, f: Frames) -> DataFrame:
        w = f.ordered()
        x = x.withColumns({"_ps": F.lag("size").over(w), "_pt": F.lag("ts_event").over(w)})
        # within the last `keep` fills: keep - 1 steps between neighbours
        steps = f.rows(keep - 1)
        up = F.sum(flag(F.col("size") > F.col("_ps"))).over(steps)
        n = F.count(F.col("_ps")).over(steps)
        pause = F.avg(F.col("ts_event") - F.col("_pt")).over(steps)
        return x.withColumns(
            {
                "micro_size_escalation": F.when(F.col("_fill") & (n > 0), up / n).otherwise(0.0),
                "micro_sequence_urgency": F.when(
                    F.col("_fill") & (n > 0), F.least(F.lit(1.0), 1.0 / (pause / 1_000_000 + 1))
                ).otherwise(0.0),
            }
        )

    d = windowed(d, run, inside, before=keep)
    d = d.withColumn("micro_aggressive_sequence_length", F.when(F.col("_fill"), F.col("_len")).otherwise(0))
    d = d.withColumn("micro_sequence_momentum", F.least(F.lit(1.0), F.col("micro_aggressive_sequence_length") / 10.0))

    def trends(x: DataFrame, f: Frames) -> DataFrame:
        w = f.ordered()
        x = x.withColumn("_i", F.row_number().over(w).cast("double"))
        slope = F.regr_slope(F.col("micro_sequence_urgency"), F.col("_i")).over(f.rows(10))
        return x.withColumns(
            {
                "micro_momentum_acceleration": F.col("micro_sequence_momentum")
                - F.lag("micro_sequence_momentum").over(w),
                "micro_urgency_trend": F.when(F.count(F.lit(1)).over(f.rows(10)) >= 10, slope),
            }
        )

    d = windowed(d, order, trends, before=10)
    return d.drop("_prev", "_fill", "_run", "_len", "_ps", "_pt", "_i")


def flow_intensity(
    df: DataFrame,
    order: EventOrder,
    windows_us: dict[str, int] | None = None,
    main: str = "1ms",
    n: int = 100,
) -> DataFrame:
    """Events per microsecond in trailing windows, burst ratio and density change."""
    windows_us = windows_us or {"100us": 100, "1ms": 1_000, "10ms": 10_000}
    order = order.measured(df)
    d = trailing(df, order, {}, {f"_w{k}": us * 1000 for k, us in windows_us.items()})
    d = d.withColumns({f"micro_flow_intensity_{k}": F.col(f"_w{k}_events") / float(us) for k, us in windows_us.items()})
    d = d.drop(*[f"_w{k}_events" for k in windows_us])
    x = f"micro_flow_intensity_{main}"

    def body(y: DataFrame, f: Frames) -> DataFrame:
        prior = f.between(-n, -1)
        mean = F.avg(x).over(prior)
        enough = F.count(F.lit(1)).over(prior) >= n
        return y.withColumns(
            {
                "micro_flow_burst_ratio": F.when(
                    enough & (mean > 0), F.least(F.lit(10.0), F.col(x) / mean)
                ).otherwise(0.0),
                "micro_flow_density_change": F.col(x) - F.lag(x).over(f.ordered()),
                "micro_adaptive_window": 1.0 / (F.col(x) + 0.001),
            }
        )

    return windowed(d, order, body, before=n + 1)


def alpha_remaining(elapsed_ms: Column, latency_ms: Column, half_life_ms: float) -> Column:
    """Percentage of a signal's value left after its age and the latency to act."""
    return F.lit(100.0) * F.exp(-(elapsed_ms + latency_ms) / F.lit(half_life_ms))


def latency_features(df: DataFrame, our_latency_ms: float, half_life_ms: float, window_ms: float) -> DataFrame:
    """Receive latency, total latency, alpha remaining and the competitive window."""
    receive = (F.col("ts_recv") - F.col("ts_event")) / F.lit(1e6)
    total = receive + our_latency_ms
    return df.withColumns(
        {
            "receive_latency_ms": receive,
            "total_latency_ms": total,
            "alpha_remaining": alpha_remaining(receive, F.lit(our_latency_ms), half_life_ms),
            "competitive_window_ms": F.greatest(F.lit(0.0), F.lit(window_ms) - total),
        }
    )
