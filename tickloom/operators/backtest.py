"""Back-tests, risk and trade metrics as windows and grouped aggregates."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.cols import flag, ratio
from tickloom.functions.fast import per_group
from tickloom.operators.joins import asof_last
from tickloom.operators.quantiles import exact_quantiles
from tickloom.order import EventOrder, Frames, number_rows, one_pin, running, windowed
from tickloom.session import pin

YEAR = 252


@one_pin
def vector_backtest(
    df: DataFrame, order: EventOrder, prediction: str = "prediction",
    commission: float = 0.0, slippage_ticks: float = 0.0, tick: float = 0.25,
) -> DataFrame:
    """Direction (+1 / -1), pnl after costs and equity per row.

    The position of a row earns that row's price change; turns pay slippage and
    commission per unit of position changed (the first row opens from flat).
    """
    order = order.measured(df)

    def body(d: DataFrame, f: Frames) -> DataFrame:
        w = f.ordered()
        d = d.withColumn("direction", F.col(prediction) * 2.0 - 1.0)
        move = F.coalesce(F.col("price") - F.lag("price").over(w), F.lit(0.0))
        turn = F.abs(F.col("direction") - F.coalesce(F.lag("direction").over(w), F.lit(0.0)))
        return d.withColumn("pnl", F.col("direction") * move - turn * (slippage_ticks * tick) - turn * commission)

    d = windowed(df, order, body, before=1)
    return running(d, order, {"equity": ("sum", "pnl")})


@one_pin
def with_drawdown(df: DataFrame, order: EventOrder, equity: str = "equity", eps: float = 1e-9) -> DataFrame:
    """(equity - running peak) / (peak + eps)."""
    d = running(df, order, {"_peak": ("max", equity)})
    return d.withColumn("drawdown", (F.col(equity) - F.col("_peak")) / (F.col("_peak") + eps)).drop("_peak")


def risk_aggregates(pnl: str = "pnl", eps: float = 1e-9) -> dict[str, Column]:
    """Sum, Sharpe, Sortino (population deviations), win rate; one pass per group."""
    x = F.col(pnl)
    root = F.lit(float(YEAR) ** 0.5)
    down = F.stddev_pop(F.when(x < 0, x))
    return {
        "pnl": F.sum(x),
        "sharpe": F.avg(x) / (F.stddev_pop(x) + eps) * root,
        "sortino": F.avg(x) / (F.coalesce(down, F.lit(0.0)) + eps) * root,
        "win_rate": F.avg(flag(x > 0)),
        "rows": F.count(F.lit(1)),
    }


def backtest_metrics(trades: DataFrame, order: EventOrder, by: list[str]) -> DataFrame:
    """Risk metrics and max drawdown per group of back-tested rows."""
    d = with_drawdown(trades, order)
    return d.groupBy(*by).agg(
        *[c.alias(n) for n, c in risk_aggregates().items()], F.min("drawdown").alias("max_drawdown")
    )


def averaged(metrics: DataFrame, by: list[str], cols: list[str], prefix: str) -> DataFrame:
    """Means of metrics over periods, with prefixed names."""
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(f"{prefix}_{c}") for c in cols])


# Poisson(1): the chances of 0, of at most 1, ... of at most 7 draws
_DRAWS = [sum(1 / math.factorial(i) for i in range(k + 1)) / math.e for k in range(8)]


def bootstrap_sharpe(df: DataFrame, pnl: str, block: str | list[str], iterations: int = 1000, seed: int = 42) -> DataFrame:
    """Block bootstrap of the Sharpe ratio of rows: p05, p50, p95.

    Rows of a block (a day, a trade) are drawn together, so dependence inside it is kept. In
    every replicate a block gets a Poisson(1) weight from the MD5 of seed, replicate and
    block, so results do not depend on partitioning. Only the sums of a block meet the
    replicates; resampled rows are never formed.
    """
    block = [block] if isinstance(block, str) else block
    x = F.col(pnl).cast("double")
    sums = df.groupBy(*block).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in block])
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), name))
    u = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    drawn = drawn.withColumn("_u", u)
    drawn = drawn.withColumn("_w", sum((flag(F.col("_u") >= cut) for cut in _DRAWS), F.lit(0)))
    per = drawn.groupBy("rep").agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in "nsq"])
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    sharpe = per.filter("n > 0").select((mean / (sd + 1e-9) * F.lit(float(YEAR) ** 0.5)).alias("sharpe"))
    # one value per replicate: a fixed, small number of rows
    return sharpe.agg(
        F.percentile("sharpe", F.lit(0.05)).alias("sharpe_p05"),
        F.percentile("sharpe", F.lit(0.5)).alias("sharpe_p50"),
        F.percentile("sharpe", F.lit(0.95)).alias("sharpe_p95"),
    )


def trade_pairs(trades: DataFrame, order: EventOrder, tick_value: float = 1.0) -> DataFrame:
    """Trades 1-2, 3-4, ... of a key as round trips; pairs on one side are left out."""
    order = order.measured(trades)
    d = number_rows(trades, order, "_rn").withColumn("pair", F.expr("(_rn - 1) div 2"))
    at = F.col("_rn")
    p = d.groupBy(*order.keys, "pair").agg(
        F.min_by("side", at).alias("side"), F.max_by("side", at).alias("_exit_side"),
        F.min_by("price", at).alias("entry_price"), F.max_by("price", at).alias("exit_price"),
        F.min_by("size", at).alias("size"), F.count(F.lit(1)).alias("_n"),
    )
    p = p.filter((F.col("_n") == 2) & (F.col("side") != F.col("_exit_side")))
    sign = F.when(F.col("side") == "B", 1.0).otherwise(-1.0)
    return p.withColumn("pnl", sign * (F.col("exit_price") - F.col("entry_price")) * F.col("size") * tick_value).drop("_exit_side", "_n")


def trade_statistics(pairs: DataFrame, by: list[str], pnl: str = "pnl") -> DataFrame:
    """Counts, win rate, averages, profit factor."""
    x = F.col(pnl)
    out = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(x > 0).alias("wins"),
        F.count_if(x < 0).alias("losses"),
        F.avg(x).alias("avg_pnl"),
        F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(x < 0, x)), F.lit(0.0)).alias("avg_loss"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("_gain"),
        F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("_loss"),
    )
    return out.withColumns(
        {
            "win_rate": ratio(F.col("wins"), F.col("trades")),
            "profit_factor": F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")),
        }
    ).drop("_gain", "_loss")


@one_pin
def equity_risk(equity: DataFrame, order: EventOrder, initial: float, date: str = "trade_date") -> DataFrame:
    """Per key: return, daily Sharpe and volatility, drawdown, VaR and CVaR of days."""
    order = order.measured(equity)
    keys = list(order.keys)

    def body(d: DataFrame, f: Frames) -> DataFrame:
        prev = F.lag("equity").over(f.ordered())
        return d.withColumn("_ret", F.coalesce((F.col("equity") - prev) / F.nullif(prev, F.lit(0.0)), F.lit(0.0)))

    d = windowed(equity, order, body, before=1)
    peaks = running(d, order, {"_peak": ("max", "equity")})
    whole = peaks.groupBy(*keys).agg(
        F.max_by("equity", F.struct(*order.order)).alias("_final"),
        F.min((F.col("equity") - F.col("_peak")) / F.col("_peak")).alias("_dd"),
    )
    daily = d.groupBy(*keys, date).agg(F.sum("_ret").alias("day_return"))
    var = exact_quantiles(daily, "day_return", {"var_95": 0.05}, keys)
    days = daily.join(var, keys).groupBy(*keys).agg(
        F.avg("day_return").alias("_mu"), F.stddev_samp("day_return").alias("_sd"), F.max("var_95").alias("var_95"),
        F.avg(F.when(F.col("day_return") <= F.col("var_95"), F.col("day_return"))).alias("cvar_95"),
    )
    root = F.lit(float(YEAR) ** 0.5)
    return whole.join(days, keys).select(
        *keys,
        ((F.col("_final") - initial) / initial).alias("total_return"),
        F.when(F.col("_sd") > 0, F.col("_mu") / F.col("_sd") * root).otherwise(0.0).alias("sharpe"),
        F.abs("_dd").alias("max_drawdown"),
        (F.coalesce(F.col("_sd"), F.lit(0.0)) * root).alias("volatility"),
        "var_95",
        "cvar_95",
    )


def affine_scan(df: DataFrame, order: EventOrder, a: Column, b: Column, before: str, after: str) -> DataFrame:
    """y_t = a_t * y_(t-1) + b_t from y = 0, before and after each row.

    Affine maps compose, so a group is scanned by doubling (maps of 1, 2, 4, ... rows), and
    a hot key per cell with the few cell maps chained afterwards.
    """
    order = order.measured(df)

    def scan(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, y = g["_step_a"].astype("float64"), g["_step_b"].astype("float64")
        reach = 1
        while reach < len(x):  # row i stands for the maps of its last 2 * reach rows
            y = np.concatenate([y[:reach], x[reach:] * y[:-reach] + y[reach:]])
            x = np.concatenate([x[:reach], x[reach:] * x[:-reach]])
            reach *= 2
        return {"_map_a": x, "_map_b": y}

    d = df.withColumns({"_step_a": a.cast("double"), "_step_b": b.cast("double")})
    maps = {"_map_a": "double", "_map_b": "double"}
    if not order.hot:
        out = per_group(d, order.frames(), maps, scan, ["_step_a", "_step_b"]).withColumn(after, F.col("_map_b"))
    else:
        keys = list(order.keys)
        size = order.rows_per_cell(d, 1)
        d = number_rows(d, order).withColumn("_cell", F.expr(f"(_rn - 1) div {size}"))
        out = per_group(d, Frames((*keys, "_cell"), ("_rn",), "_rn"), maps, scan, ["_step_a", "_step_b"])
        ends = out.groupBy(*keys, "_cell").agg(F.max_by("_map_a", "_rn").alias("_step_a"), F.max_by("_map_b", "_rn").alias("_step_b"))
        chained = per_group(ends, Frames(tuple(keys), ("_cell",), "_cell"), maps, scan, ["_step_a", "_step_b"])
        carry = chained.select(*keys, (F.col("_cell") + 1).alias("_cell"), F.col("_map_b").alias("_y0"))
        out = out.join(carry, [*keys, "_cell"], "left")
        out = out.withColumn(after, F.col("_map_a") * F.coalesce(F.col("_y0"), F.lit(0.0)) + F.col("_map_b")).drop("_y0", "_cell", "_rn")
    out = windowed(
        out, order, lambda x, f: x.withColumn(before, F.coalesce(F.lag(after).over(f.ordered()), F.lit(0.0))), before=1
    )
    return out.drop("_step_a", "_step_b", "_map_a", "_map_b")


@one_pin
def positions(fills: DataFrame, order: EventOrder) -> DataFrame:
    """Position, average cost and realised pnl after each fill.

    Adds move the average, reductions keep it; a fill larger than the position closes
    it and opens the rest on the other side.
    """
    order = order.measured(fills)
    d = fills.withColumn("_q", F.when(F.col("side") == "B", F.col("size")).otherwise(-F.col("size")).cast("double"))
    d = running(d, order, {"position": ("sum", "_q")})
    prev = F.col("position") - F.col("_q")
    d = d.withColumn("_prev", prev)
    adds = F.col("_prev") * F.col("_q") >= 0
    cuts = ~adds & (F.col("_prev") * F.col("position") > 0)
    a = F.when(adds, 1.0).when(cuts, F.col("position") / F.nullif(F.col("_prev"), F.lit(0.0))).otherwise(0.0)
    b = F.when(adds, F.abs("_q") * F.col("price")).when(cuts, 0.0).otherwise(F.abs("position") * F.col("price"))
    d = affine_scan(d, order, a, b, "_cost_before", "_cost")
    avg_before = F.col("_cost_before") / F.nullif(F.abs("_prev"), F.lit(0.0))
    closed = F.when(adds, 0.0).otherwise(F.least(F.abs("_q"), F.abs("_prev")))
    gain = F.when(closed > 0, closed * F.signum("_prev") * (F.col("price") - avg_before)).otherwise(0.0)
    d = d.withColumns({"avg_price": F.coalesce(F.col("_cost") / F.nullif(F.abs("position"), F.lit(0.0)), F.lit(0.0)), "trade_pnl": gain})
    d = running(d, order, {"realized_pnl": ("sum", "trade_pnl")})
    return d.drop("_q", "_prev", "_cost", "_cost_before")


def market_impact(size: Column, coefficient: float, model: str = "linear") -> Column:
    x = {"none": lambda: F.lit(0.0), "linear": lambda: coefficient * size, "square_root": lambda: coefficient * F.sqrt(size)}
    return x[model]()


def priced_orders(
    orders: DataFrame, quotes: DataFrame, order: EventOrder, commission: float, impact: float,
    model: str = "linear", slippage: Column | None = None,
) -> DataFrame:
    """Fill price, slippage, commission and impact of orders against the quotes in force.

    Market orders cross the spread plus slippage; limit orders fill at the better of
    limit and quote, and only when the quote has reached the limit.
    """
    d = asof_last(orders, quotes, ["best_bid", "best_ask"], order)
    buy = F.col("side") == "B"
    quote = F.when(buy, F.col("best_ask")).otherwise(F.col("best_bid"))
    slip = slippage if slippage is not None else F.lit(0.0)
    market = quote + F.when(buy, slip).otherwise(-slip)
    reached = F.when(buy, quote <= F.col("limit_price")).otherwise(quote >= F.col("limit_price"))
    limit = F.when(reached, F.when(buy, F.least("limit_price", quote)).otherwise(F.greatest("limit_price", quote)))
    is_market = F.col("limit_price").isNull()
    d = d.withColumn("fill_price", F.when(quote.isNotNull(), F.when(is_market, market).otherwise(limit)))
    filled = F.col("fill_price").isNotNull()
    return d.withColumns(
        {
            "slippage": F.when(filled, F.when(is_market, F.abs(F.col("fill_price") - quote)).otherwise(0.0)),
            "commission": F.when(filled, F.col("size") * commission),
            "market_impact": F.when(filled, market_impact(F.col("size").cast("double"), impact, model)),
        }
    )


def execution_quality(filled: DataFrame, by: list[str]) -> DataFrame:
    """Average slippage and impact, fill rate and volume of priced orders."""
    hit = F.col("fill_price").isNotNull()
    return filled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("orders"),
        F.avg("slippage").alias("avg_slippage"),
        F.avg("market_impact").alias("avg_market_impact"),
        F.avg(flag(hit)).alias("fill_rate"),
        F.sum(F.when(hit, F.col("size")).otherwise(0)).alias("volume"),
    )


class _Tree:
    """Segment tree answering "first index from i on with value >= x" for many rows."""

    def __init__(self, values: np.ndarray):
        self.n = 1 << max(0, int(len(values) - 1).bit_length())
        self.t = np.full(2 * self.n, -np.inf)
        self.t[self.n : self.n + len(values)] = values
        level = self.n
        while level > 1:
            level //= 2
            self.t[level : 2 * level] = np.maximum(self.t[2 * level : 4 * level : 2], self.t[2 * level + 1 : 4 * level : 2])

    def first(self, start: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Index per query, or n when there is none."""
        none = self.n
        node = np.where(start < self.n, start + self.n, 1)
        found = (start < self.n) & (self.t[node] >= x)
        live = (start < self.n) & ~found
        while live.any():  # climb until a right sibling holds a hit
            right = live & (node % 2 == 0)
            hit = np.zeros_like(live)
            hit[right] = self.t[node[right] + 1] >= x[right]
            node[hit] += 1
            found |= hit
            live &= ~hit
            node[live] //= 2
            live &= node > 1
        out = np.full(len(start), none)
        down = found.copy()
        while True:  # descend to the leftmost leaf
            inner = down & (node < self.n)
            if not inner.any():
                break
            left = node[inner] * 2
            node[inner] = np.where(self.t[left] >= x[inner], left, left + 1)
        out[found] = node[found] - self.n
        return out


def _exits(ts: np.ndarray, px: np.ndarray, start: np.ndarray, buy: np.ndarray, up: np.ndarray, down: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exit row, reason and whether a barrier was met, for positions that see rows from ``start`` on."""
    above, below = _Tree(px).first(start, up), _Tree(-px).first(start, -down)
    take, lose = np.where(buy, above, below), np.where(buy, below, above)
    last = np.searchsorted(ts, until, side="right") - 1
    met = np.minimum(take, lose) <= last
    reason = np.where(lose <= last, np.where(lose < take, "stop_loss", "take_profit"), np.where(take <= last, "take_profit", "time_limit"))
    return np.minimum(np.minimum(take, lose), last), reason, met


_EXIT_COLUMNS = {"exit_reason": "string", "exit_ts": "bigint", "exit_price": "double"}


def _exits_of_group(order: EventOrder, entry: str, side: str, stop: float, target: float, hold_ns: int):
    """Exits inside one sorted group; ``_open`` marks entries that no row of the group has decided."""

    def solve(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        ts, px = g[order.ts], g["price"].astype("float64")
        n, idx = len(ts), np.flatnonzero(g[entry].astype(bool))
        buy = g[side][idx] == "B"
        up, down = px[idx] + np.where(buy, target, stop), px[idx] - np.where(buy, stop, target)
        at, why, met = _exits(ts, px, idx + 1, buy, up, down, ts[idx] + hold_ns)
        reason, exit_ts, exit_px, open_ = np.full(n, None, dtype=object), np.full(n, -1, dtype="int64"), np.full(n, np.nan), np.zeros(n, dtype=bool)
        reason[idx], exit_ts[idx], exit_px[idx], open_[idx] = why, ts[at], px[at], ~met & (at == n - 1)
        return {"exit_reason": reason, "exit_ts": exit_ts, "exit_price": exit_px, "_open": open_}

    return solve


def _exits_beyond(d: DataFrame, order: EventOrder, side: str, stop: float, target: float, hold_ns: int, size: int) -> DataFrame:
    """Exits of the entries that their own cell left open: keys, _rn and the exit columns.

    A cell's summary is its first time and its price range. In a tree over the summaries
    of the cells in reach an entry finds the one cell that decides it, the first whose range
    meets a barrier or else the last one in time, and only there it meets rows. So cells are
    joined with cells, entries with summaries and each open entry with one cell; no row is
    copied because an entry might reach it. A cell that decides many is copied per ``size`` of them.
    """
    keys, ts = list(order.keys), order.ts
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    on = [f"_key{i}" for i in range(len(keys))]
    buy = F.col(side) == "B"
    waiting = d.filter("_open").select(
        *named, "_cell", "_rn", buy.alias("buy"), (F.col(ts) + hold_ns).alias("until"),
        (F.col("price") + F.when(buy, target).otherwise(stop)).cast("double").alias("up"), (F.col("price") - F.when(buy, stop).otherwise(target)).cast("double").alias("down"),
    )
    cells = d.groupBy(*named, "_cell").agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.min("price").cast("double").alias("lo"), F.max("price").cast("double").alias("hi"))
    width = max(hold_ns, 1)
    near = F.explode(F.sequence(F.expr(f"_to div {width}"), F.expr(f"(_to + {hold_ns}) div {width}")))
    left = cells.select(*on, "_cell", "_to", near.alias("_b"))
    right = cells.select(*on, F.col("_cell").alias("_next"), F.col("_from").alias("_start"), "lo", "hi", F.expr(f"_from div {width}").alias("_b"))
    reach = left.join(right, [*on, "_b"]).filter((F.col("_next") > F.col("_cell")) & (F.col("_start") <= F.col("_to") + hold_ns))
    reach = reach.select(*on, "_cell", "_next", "_start", "lo", "hi")
    held = ", ".join(f"_key{i} {d.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    columns = [*on, "_next", "_rn", "buy", "until", "up", "down"]

    def decide(entries: pa.Table, ahead: pa.Table) -> pa.Table:
        ahead = ahead.sort_by("_next")
        start, lo, hi, cell = (ahead[c].to_numpy() for c in ("_start", "lo", "hi", "_next"))
        until, up, down = (entries[c].to_numpy() for c in ("until", "up", "down"))
        last = np.searchsorted(start, until, side="right") - 1
        zero = np.zeros(len(until), dtype=np.int64)
        hit = np.minimum(_Tree(hi).first(zero, up), _Tree(-lo).first(zero, -down)) if len(cell) else zero
        goes = last >= 0
        to = np.minimum(hit, last)[goes]
        entries = entries.filter(pa.array(goes)).append_column("_next", pa.array(cell[to], pa.int64()))
        return entries.select(columns)

    decide.__annotations__ = {"entries": pa.Table, "ahead": pa.Table, "return": pa.Table}
    schema = f"{held}, _next long, _rn long, buy boolean, until long, up double, down double"
    reach = reach.withColumnsRenamed({c: f"{c}_" for c in (*on, "_cell")})
    visits = pin(waiting.groupBy(*on, "_cell").cogroup(reach.groupBy(*[f"{c}_" for c in (*on, "_cell")])).applyInArrow(decide, schema))
    parts = visits.groupBy(*on, "_next").agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    rows = d.select(*named, F.col("_cell").alias("_next"), F.col("_rn").alias("_at"), F.col(ts).alias("ts"), F.col("price").cast("double").alias("px"))
    rows = rows.join(parts, [*on, "_next"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    guests = visits.join(parts, [*on, "_next"]).withColumn("_part", F.pmod(F.xxhash64("_rn"), F.col("_parts"))).drop("_parts")
    found = [*on, "_rn", *(f"late_{c}" for c in _EXIT_COLUMNS)]

    def visit(cell: pa.Table, entries: pa.Table) -> pa.Table:
        cell = cell.sort_by("_at")
        clock, px = cell["ts"].to_numpy(), cell["px"].to_numpy()
        until, up, down = (entries[c].to_numpy() for c in ("until", "up", "down"))
        bought = entries["buy"].to_numpy(zero_copy_only=False).astype(bool)
        at, why, _ = _exits(clock, px, np.zeros(len(until), dtype=np.int64), bought, up, down, until)
        entries = entries.rename_columns([c.removesuffix("_") for c in entries.column_names])
        entries = entries.append_column("late_exit_reason", pa.array(why.astype(object), pa.string()))
        entries = entries.append_column("late_exit_ts", pa.array(clock[at], pa.int64())).append_column("late_exit_price", pa.array(px[at], pa.float64()))
        return entries.select(found)

    visit.__annotations__ = {"cell": pa.Table, "entries": pa.Table, "return": pa.Table}
    by = [*on, "_next", "_part"]
    guests = guests.withColumnsRenamed({c: f"{c}_" for c in by})
    late = rows.groupBy(*by).cogroup(guests.groupBy(*[f"{c}_" for c in by])).applyInArrow(visit, f"{held}, _rn long, late_exit_reason string, late_exit_ts long, late_exit_price double")
    return late.withColumnsRenamed({f"_key{i}": f"_of{i}" for i in range(len(keys))} | {"_rn": "_of_rn"})


def barrier_exits(
    df: DataFrame, order: EventOrder, entry: str, side: str, stop: float, target: float, hold_ns: int,
    tick: float = 0.25, tick_value: float = 12.5,
) -> DataFrame:
    """First stop, target or time exit after each entry (trades may overlap).

    ``entry`` is a boolean column, ``side`` is B or A, ``stop`` and ``target`` are price
    distances. A position that meets neither barrier within ``hold_ns`` leaves at the
    last price inside it. Exits are searched in a tree of price ranges over the rows of a
    key; a huge key is cut into cells, and what a cell leaves open is searched in a tree
    over the cells behind it. No entry-tick pairs are formed and no cell grows with ``hold_ns``.
    """
    order = order.measured(df)
    solve = _exits_of_group(order, entry, side, stop, target, hold_ns)
    inputs, cols = [order.ts, "price", entry, side], {**_EXIT_COLUMNS, "_open": "boolean"}
    if not order.hot:
        out = per_group(df, order.frames(), cols, solve, inputs).filter(F.col(entry))
    else:
        keys, size = list(order.keys), order.rows_per_cell(df, 1)
        d = number_rows(df, order, "_rn").withColumn("_cell", F.expr(f"(_rn - 1) div {size}"))
        d = pin(per_group(d, Frames((*keys, "_cell"), ("_rn",), "_rn"), cols, solve, inputs))
        late = _exits_beyond(d, order, side, stop, target, hold_ns, size)
        same = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)]
        out = d.filter(F.col(entry)).join(late, reduce(lambda a, b: a & b, same, F.col("_rn") == F.col("_of_rn")), "left")
        out = out.withColumns({c: F.coalesce(f"late_{c}", c) for c in _EXIT_COLUMNS})
        out = out.drop("_rn", "_cell", "_of_rn", *[f"_of{i}" for i in range(len(keys))], *[f"late_{c}" for c in _EXIT_COLUMNS])
    sign = F.when(F.col(side) == "B", 1.0).otherwise(-1.0)
    ticks = sign * (F.col("exit_price") - F.col("price")) / tick
    return out.drop("_open").withColumns({"pnl_ticks": ticks, "pnl_dollars": ticks * tick_value})


@one_pin
def trade_history_summary(trades: DataFrame, order: EventOrder, by: list[str], initial: float = 100_000.0) -> DataFrame:
    """Wins, losses, profit factor, drawdown, Sharpe, Sortino, Calmar, VaR, CVaR per group.

    The portfolio starts at ``initial`` and adds each trade's dollars in order.
    """
    order = order.measured(trades)
    d = running(trades, order, {"_cum": ("sum", "pnl_dollars")})
    value = F.lit(initial) + F.col("_cum")
    d = d.withColumns({"_value": value, "_ret": F.col("pnl_dollars") / (value - F.col("pnl_dollars"))})
    var = exact_quantiles(d, "_ret", {"var_95": 0.05}, by)
    x, r = F.col("pnl_dollars"), F.col("_ret")
    root = F.lit(float(YEAR) ** 0.5)
    g = d.join(var, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(x > 0).alias("winning_trades"), F.count_if(x < 0).alias("losing_trades"),
        F.sum(x).alias("total_pnl_dollars"), F.sum("pnl_ticks").alias("total_pnl_ticks"),
        F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_win_dollars"),
        F.coalesce(F.avg(F.when(x < 0, x)), F.lit(0.0)).alias("avg_loss_dollars"),
        F.greatest(F.max("_value"), F.lit(initial)).alias("_peak"),
        F.max_by("_value", F.struct(*order.order)).alias("final_value"),
        F.avg(r).alias("_mu"), F.stddev_pop(r).alias("_sd"), F.stddev_pop(F.when(r < 0, r)).alias("_dn"),
        F.max("var_95").alias("var_95"), F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"),
    )
    g = g.withColumn("max_drawdown", (F.col("_peak") - F.col("final_value")) / F.col("_peak"))
    lost = F.abs(F.col("avg_loss_dollars") * F.col("losing_trades"))
    return g.withColumns(
        {
            "win_rate": F.col("winning_trades") / F.col("total_trades"),
            "profit_factor": F.when(lost > 0, F.abs(F.col("avg_win_dollars") * F.col("winning_trades")) / lost),
            "sharpe_ratio": F.when(F.col("_sd") > 0, F.col("_mu") / F.col("_sd") * root).otherwise(0.0),
            "sortino_ratio": F.when(F.col("_dn") > 0, F.col("_mu") / F.col("_dn") * root).otherwise(0.0),
            "calmar_ratio": F.when(F.col("max_drawdown") > 0, F.col("_mu") * YEAR / F.col("max_drawdown")).otherwise(0.0),
            "return_pct": (F.col("final_value") - initial) / initial * 100,
        }
    ).drop("_peak", "_mu", "_sd", "_dn")


def strategy_summary(trades: DataFrame, by: str = "strategy") -> DataFrame:
    """Wins, losses and pnl per strategy (a flat trade counts as a loss)."""
    x = F.col("pnl_dollars")
    out = trades.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(x > 0).alias("wins"), F.count_if(x <= 0).alias("losses"), F.sum(x).alias("total_pnl")
    )
    return out.withColumns({"win_rate": F.col("wins") / F.col("total_trades"), "avg_pnl_per_trade": F.col("total_pnl") / F.col("total_trades")})


def delayed_execution(df: DataFrame, order: EventOrder, latencies_ms: list[int], horizon_ms: int, prediction: str = "prediction") -> DataFrame:
    """Mean pnl per latency when a signal trades at the price ``latency`` later and is
    closed ``horizon`` after its time: the decay of the signal.

    All latencies are looked up in one stacked as-of scan.
    """
    order = order.measured(df)
    keys = list(order.keys)
    seq = order.order[-1]
    waits = [*latencies_ms, *[horizon_ms]]
    probes = df.select(
        *keys, seq, prediction, F.col(order.ts).alias("_t0"),
        F.explode(F.array(*[F.lit(int(w)) for w in dict.fromkeys(waits)])).alias("_wait"),
    ).withColumn(order.ts, F.col("_t0") + F.col("_wait").cast("long") * 1_000_000)
    prices = df.select(*keys, *order.order, F.col("price").alias("_px"))
    seen = asof_last(probes, prices, ["_px"], order)
    back = seen.groupBy(*keys, seq, "_t0", prediction).agg(
        *[F.max(F.when(F.col("_wait") == w, F.col("_px"))).alias(f"_p{w}") for w in dict.fromkeys(waits)]
    )
    sign = F.col(prediction) * 2.0 - 1.0
    per = F.array(
        *[F.struct(F.lit(w).alias("latency_ms"), (sign * (F.col(f"_p{horizon_ms}") - F.col(f"_p{w}"))).alias("pnl")) for w in latencies_ms]
    )
    rows = back.select(F.explode(per).alias("r")).select("r.*")
    return rows.groupBy("latency_ms").agg(*[c.alias(n) for n, c in risk_aggregates().items()])
