"""Order books as window computations.

A level's size is a running sum of signed changes, so levels are independent of each
other and need no replay. Only "the best level now" mixes levels: it is solved per cell
of events, where a cell starts from the levels that are live at its first row.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.cols import ratio
from tickloom.functions.fast import per_group
from tickloom.operators.levels import near, side_of, taken
from tickloom.operators.microstructure import clamped_sum
from tickloom.order import EventOrder, join_null_safe, one_pin, running
from tickloom.session import pin

LEVEL = ("book_epoch", "level_side", "price")


def with_epoch(df: DataFrame, order: EventOrder) -> DataFrame:
    """``book_epoch``: how many times the key's book was cleared so far."""
    return running(df, order, {"book_epoch": ("count", F.when(F.col("action") == "R", F.lit(1)))})


@one_pin
def level_book(df: DataFrame, order: EventOrder, fills: str = "own") -> DataFrame:
    """Each event with the size of the level it touches before and after it.

    Adds raise, cancels lower; fills lower their ``own`` side, the ``opposite`` side,
    or ``none``. Sizes never go below zero and restart at each clear.
    """
    order = order.measured(df)
    d = with_epoch(df, order)
    flip = F.when(F.col("side") == "B", "A").when(F.col("side") == "A", "B").otherwise(F.col("side"))
    fill = F.col("action") == "F"
    side = F.when(fill, flip).otherwise(F.col("side")) if fills == "opposite" else F.col("side")
    gone = F.col("action").isin("C") if fills == "none" else F.col("action").isin("C", "F")
    known = F.col("side").isin("A", "B")
    step = F.when(known & (F.col("action") == "A"), F.col("size")).when(known & gone, -F.col("size")).otherwise(0)
    d = d.withColumn("level_side", side)
    return clamped_sum(d, order.by(*order.keys, *LEVEL), step, "level_size", "level_size_before")


@one_pin
def order_states(df: DataFrame, order: EventOrder, fills_reduce: bool = False) -> DataFrame:
    """Each event with its order's resting price, side and size after it.

    Add sets the order, modify moves it, cancel (and fill on request) reduces it and
    removes it at zero; a clear forgets all orders. Modifies of unknown orders and
    sides other than B/A have no effect.
    """
    order = order.measured(df)
    d = with_epoch(df, order)
    per_order = order.by(*order.keys, "book_epoch", "order_id")
    added = (F.col("action") == "A") & F.col("side").isin("A", "B")
    sets = added | (F.col("action") == "M")
    d = running(d, per_order, {"_life": ("count", F.when(added, F.lit(1))), "_seg": ("count", F.when(sets, F.lit(1)))})
    cuts = F.col("action").isin("C", "F") if fills_reduce else F.col("action") == "C"
    segment = per_order.by(*per_order.keys, "_life", "_seg")
    d = running(
        d,
        segment,
        {
            "_size0": ("first", F.when(sets, F.col("size"))),
            "_price0": ("first", F.when(sets, F.col("price"))),
            "_cut": ("sum", F.when(cuts, F.col("size")).otherwise(0)),
        },
    )
    d = d.withColumn("_rest", F.greatest(F.col("_size0") - F.col("_cut"), F.lit(0)))
    life = per_order.by(*per_order.keys, "_life")
    d = running(d, life, {"_side0": ("first", F.when(added, F.col("side"))), "_low": ("min", "_rest")}, exclusive=("_low",))
    live = (F.col("_life") > 0) & (F.col("_low").isNull() | (F.col("_low") > 0)) & (F.col("_rest") > 0)
    d = d.withColumns(
        {
            "order_size": F.when(live, F.col("_rest")).otherwise(0),
            "order_price": F.when(live, F.col("_price0")),
            "order_side": F.when(live, F.col("_side0")),
        }
    )
    return d.drop("_life", "_seg", "_size0", "_price0", "_cut", "_rest", "_side0", "_low")


@one_pin
def order_book(df: DataFrame, order: EventOrder, fills_reduce: bool = False) -> DataFrame:
    """Level changes of the order-level book: each event leaves the order's old level
    and enters its new one; ``level_size`` is the level's size afterwards."""
    order = order.measured(df)
    states = order_states(df, order, fills_reduce)
    per_order = order.by(*order.keys, "book_epoch", "order_id")
    now = F.struct(F.col("order_side").alias("s"), F.col("order_price").alias("p"), F.col("order_size").alias("q"))
    d = running(states.withColumn("_now", now), per_order, {"_was": ("last", "_now")}, exclusive=("_was",))
    part = lambda i, s, p, q: F.struct(
        F.lit(i).alias("part"), s.alias("level_side"), p.alias("price"), q.alias("delta")
    )
    moves = F.array(
        part(0, F.col("_was.s"), F.col("_was.p"), -F.col("_was.q")), part(1, F.col("order_side"), F.col("order_price"), F.col("order_size"))
    )
    moves = F.filter(moves, lambda m: m["level_side"].isNotNull() & (m["delta"] != 0))
    keep = [*order.keys, *order.order, "action", "order_id", "book_epoch"]
    changes = d.select(*keep, F.explode_outer(moves).alias("_m")).select(*keep, "_m.*")
    changes = changes.withColumn("part", F.coalesce(F.col("part"), F.lit(0)))
    level = EventOrder(keys=(*order.keys, *LEVEL), order=(*order.order, "part"), ts=order.ts, hot=False if order.hot is False else None, cell_rows=order.cell_rows)
    return running(changes, level, {"level_size": ("sum", F.coalesce(F.col("delta"), F.lit(0)))})


def _replayer(k: int, distance: float | None = None):
    """Best levels, totals and top-k depth after each row of a sorted cell; with a
    ``distance`` also the levels that near its centre, however deep they lie."""

    def fn(g: dict[str, np.ndarray]) -> dict[str, np.ndarray | pa.Array]:
        clear, take = g["_clear"].astype(bool), g["_take"].astype("float64")
        price, size = g["_price"].astype("float64"), g["_size"].astype("float64")
        epoch, n = np.cumsum(clear), len(clear)
        out: dict[str, np.ndarray | pa.Array] = {}
        sides = {name: side_of(code, g["_side"], price, size, epoch) for name, code in (("bid", "B"), ("ask", "A"))}
        for name, side in sides.items():
            tops = np.stack([best for best, _ in zip(side.levels(), range(max(k, 1)))], axis=1)
            first, here = tops[:, 0], tops[:, 0] >= 0
            for c, values in ((f"best_{name}", side.price), (f"{name}_size", side.size)):
                out[c] = np.full(n, np.nan)
                out[c][here] = values[first[here]]
            out[f"{name}_total"] = side.totals()
            if distance is not None:
                out[f"{name}_near_levels"], out[f"{name}_near_volume"] = near(side, g["_centre"].astype("float64"), distance)
            tops = tops[:, :k]
            offsets = np.concatenate([[0], np.cumsum((tops >= 0).sum(axis=1))]).astype("int32")
            flat = tops[tops >= 0]
            for c, values in ((f"{name}_prices", side.price), (f"{name}_sizes", side.size)):
                out[c] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[flat], pa.float64()))
        out["sweep_levels"] = np.full(n, np.nan)
        takes = np.flatnonzero(take > 0)
        buys = g["_taker"][takes] == "B"
        for at, side, above in ((takes[buys], sides["ask"], False), (takes[~buys], sides["bid"], True)):
            if len(at):  # the book before the row, empty after a clear
                out["sweep_levels"][at] = taken(side, np.where(clear[at], -1, at - 1), g["_limit"][at].astype("float64"), take[at], above)
        return out

    return fn


def _live_levels(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows that open a book as these rows leave it."""
    clears = np.flatnonzero(g["_clear"].astype(bool))
    at = np.arange(clears[-1] if len(clears) else 0, len(g["_side"]))
    at = at[g["_side"][at] != ""]
    side, price = (g["_side"][at] == "B").astype(int), g["_price"][at].astype("float64")
    by = np.lexsort((at, price, side))
    at, side, price = at[by], side[by], price[by]
    last = np.ones(len(at), dtype=bool)
    last[:-1] = (side[1:] != side[:-1]) | (price[1:] != price[:-1])
    at = at[last]
    at = at[g["_size"][at].astype("float64") > 0]
    none = {"_clear": False, "_take": 0.0, "_taker": "", "_limit": 0.0, "_centre": np.nan}
    return {c: np.full(len(at), none[c], dtype=a.dtype) if c in none else a[at] for c, a in g.items()}


_REPLAY = {
    **{c: "double" for c in ("best_bid", "best_ask", "bid_size", "ask_size", "bid_total", "ask_total", "sweep_levels")},
    **{c: "array<double>" for c in ("bid_prices", "bid_sizes", "ask_prices", "ask_sizes")},
}
_NEAR = {f"{s}_near_{c}": t for s in ("bid", "ask") for c, t in (("levels", "int"), ("volume", "double"))}


def book_at_events(changes: DataFrame, order: EventOrder, depth: int = 10, around: tuple[Column, float] | None = None) -> DataFrame:
    """The book after each event: best prices and sizes, totals, top levels.

    ``around`` is a price of the row and a distance: levels and volume within it are counted
    over the whole book, whatever ``depth`` is.

    ``changes`` has one or more rows per event (``part`` orders them) with the level's
    side, price and resulting size. Cells of a hot key are opened with the levels live
    at their start, so every cell is replayed on its own.
    """
    from tickloom.order import number_rows

    order = order.measured(changes)
    keys, ids = list(order.keys), list(order.order)
    d = changes if "part" in changes.columns else changes.withColumn("part", F.lit(1))
    seq = EventOrder(keys=order.keys, order=(*ids, "part"), ts=order.ts, hot=order.hot, cell_rows=order.cell_rows)
    if "part" not in changes.columns:  # one row an event: numbers it carries are those of its changes
        seq = replace(order, order=seq.order)
    fill = F.col("action") == "F" if {"side", "size"} <= set(d.columns) else F.lit(False)
    touched = F.col("level_side").isin("A", "B") & F.col("price").isNotNull()
    d = d.withColumns(
        {
            "_side": F.when(touched, F.col("level_side")).otherwise(""),
            "_price": F.when(touched, F.col("price").cast("double")).otherwise(0.0),
            "_size": F.when(touched, F.col("level_size").cast("double")).otherwise(0.0),
            "_clear": F.col("action") == "R",
            "_take": F.when(fill, F.col("size").cast("double")).otherwise(0.0) if "size" in d.columns else F.lit(0.0),
            "_taker": F.when(fill, F.col("side")).otherwise("") if "side" in d.columns else F.lit(""),
            "_limit": F.when(fill, F.col("price").cast("double")).otherwise(0.0),
        }
    )
    cols = ["_side", "_price", "_size", "_clear", "_take", "_taker", "_limit"]
    made, replay = _REPLAY, _replayer(depth)
    if around:
        d, cols = d.withColumn("_centre", around[0].cast("double")), [*cols, "_centre"]
        made, replay = _REPLAY | _NEAR, _replayer(depth, around[1])
    if not order.hot:
        out = per_group(d, seq.frames(), made, replay, cols, _live_levels)
    else:
        size = order.rows_per_cell(d, 1)
        d = number_rows(d, seq).withColumn("_cell", F.expr(f"(_rn - 1) div {size}"))
        levels = d.select(*keys, "book_epoch", "_side", "_price", "_size", "_cell", "_rn")
        opened = _opening_levels(pin(levels), keys).select(
            *keys, "_cell", F.lit(0).cast("long").alias("_rn"), "_side", "_price", "_size",
            F.lit(False).alias("_clear"), F.lit(0.0).alias("_take"), F.lit("").alias("_taker"), F.lit(0.0).alias("_limit"),
            F.lit(True).alias("_opening"),
        )
        both = d.unionByName(opened, allowMissingColumns=True)
        both = both.withColumn("_tie", F.col("_price"))
        cell = EventOrder(keys=(*order.keys, "_cell"), order=("_rn", "_side", "_tie"), ts="_rn")
        out = per_group(both, cell.frames(), made, replay, cols, _live_levels)
        out = out.filter(F.col("_opening").isNull()).drop("_opening", "_tie", "_rn", "_cell")
    # the state after an event is the state after its last part
    if "part" in changes.columns:
        last = out.groupBy(*keys, *ids).agg(F.max("part").alias("part"))
        out = out.join(last, [*keys, *ids, "part"], "left_semi")
    out = out.drop(*cols, *(["part"] if "part" not in changes.columns else []))
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    out = out.withColumns({c: nan(c) for c, t in _REPLAY.items() if t == "double"})
    return out.withColumns(
        {
            "spread": F.col("best_ask") - F.col("best_bid"),
            "mid": (F.col("best_ask") + F.col("best_bid")) / 2,
        }
    )


def _opening_levels(d: DataFrame, keys: list[str]) -> DataFrame:
    """Levels with size at the start of each cell.

    Levels change state at most once per cell here, so the output is (live levels) x
    (cells), far below the number of events.
    """
    touched = d.filter("_side <> ''")
    ends = touched.groupBy(*keys, "book_epoch", "_side", "_price", "_cell").agg(F.max_by("_size", "_rn").alias("_size"))
    spans = d.groupBy(*keys, "book_epoch").agg(F.min("_cell").alias("_first"))
    last = d.groupBy(*keys).agg(F.max("_cell").alias("_last"))
    by_key = Window.partitionBy(*keys).orderBy("book_epoch")
    spans = join_null_safe(spans, last, keys).withColumn("_stop", F.coalesce(F.lead("_first").over(by_key), F.col("_last")))
    level = Window.partitionBy(*keys, "book_epoch", "_side", "_price").orderBy("_cell")
    ends = join_null_safe(ends.withColumn("_next", F.lead("_cell").over(level)), spans, [*keys, "book_epoch"])
    until = F.coalesce(F.col("_next"), F.col("_stop"))
    live = ends.filter((F.col("_size") > 0) & (until > F.col("_cell")))
    return live.withColumn("_open", F.explode(F.sequence(F.col("_cell") + 1, until))).select(
        *keys, F.col("_open").alias("_cell"), "_side", "_price", "_size"
    )


def book_as_of(df: DataFrame, order: EventOrder, at_ns: int, k: int = 10, fills: str = "own") -> DataFrame:
    """Top-k levels of every key at one instant: last state per level, then rank."""
    levels = level_book(df.filter(F.col(order.ts) <= at_ns), order, fills)
    at = F.struct(*order.order)
    state = levels.groupBy(*order.keys, *LEVEL).agg(F.max_by("level_size", at).alias("level_size"))
    now = levels.groupBy(*order.keys).agg(F.max("book_epoch").alias("_now"))
    live = state.join(now, list(order.keys)).filter(
        (F.col("book_epoch") == F.col("_now")) & (F.col("level_size") > 0) & F.col("level_side").isin("A", "B")
    )
    rank = F.row_number().over(
        Window.partitionBy(*order.keys, "level_side").orderBy(
            F.when(F.col("level_side") == "B", -F.col("price")).otherwise(F.col("price"))
        )
    )
    return live.withColumn("level", rank).filter(F.col("level") <= k).drop("book_epoch", "_now")


# ------------------------------------------------------------ features of depth arrays


def _sum(arr: Column, k: int | None = None) -> Column:
    part = F.slice(arr, 1, k) if k else arr
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x)


def depth_features(book: DataFrame, large: float = 100) -> DataFrame:
    """Spread in bps, totals, imbalance, large levels and depth imbalance 1/3/5/10."""
    b, a = F.col("bid_sizes"), F.col("ask_sizes")
    two = (F.size(b) > 0) & (F.size(a) > 0)
    both = lambda c: F.when(two, c)
    cols = {
        "spread_bps": both(ratio(F.col("spread") * 10000, F.col("mid"))),
        "total_bid_size": both(_sum(b)),
        "total_ask_size": both(_sum(a)),
        "imbalance_ratio": both(ratio(_sum(b) - _sum(a), _sum(b) + _sum(a))),
        "large_bid_levels": both(F.size(F.filter(b, lambda x: x >= large))),
        "large_ask_levels": both(F.size(F.filter(a, lambda x: x >= large))),
    }
    for k in (1, 3, 5, 10):
        deep = (F.size(b) >= k) & (F.size(a) >= k)
        cols[f"depth_imbalance_{k}"] = F.when(deep, ratio(_sum(b, k) - _sum(a, k), _sum(b, k) + _sum(a, k)))
    return book.withColumns(cols)


def side_summary(book: DataFrame) -> DataFrame:
    """Per side: levels, total, first share, price span, size-weighted price."""
    cols = {}
    for s in ("bid", "ask"):
        p, q = F.col(f"{s}_prices"), F.col(f"{s}_sizes")
        weighted = F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda u, v: u + v)
        some = F.size(q) > 0
        cols |= {
            f"{s}_levels": F.size(q),
            f"{s}_total_size": _sum(q),
            f"{s}_first_share": F.when(some, F.get(q, 0) / _sum(q)).otherwise(0.0),
            f"{s}_price_span": F.when(some, F.abs(F.get(p, 0) - F.element_at(p, -1))).otherwise(0.0),
            f"{s}_weighted_price": F.when(some, weighted / _sum(q)).otherwise(0.0),
        }
    return book.withColumns(cols)


def localised(changes: DataFrame, order: EventOrder, centre: Column, distance: float, depth: int = 10) -> DataFrame:
    """The book at events with the levels of the whole book within ``distance`` of a
    price, their volume, and the volume beyond it."""
    book = book_at_events(changes, order, depth, (centre, distance))
    return book.withColumns({f"{s}_far_volume": F.col(f"{s}_total") - F.col(f"{s}_near_volume") for s in ("bid", "ask")})


def wide_levels(book: DataFrame, k: int = 10) -> DataFrame:
    """k bid and ask levels as 4k columns, absent levels 0."""
    cols = {}
    for s in ("bid", "ask"):
        for i in range(k):
            cols[f"{s}_price_{i + 1}"] = F.coalesce(F.get(f"{s}_prices", F.lit(i)), F.lit(0.0))
            cols[f"{s}_size_{i + 1}"] = F.coalesce(F.get(f"{s}_sizes", F.lit(i)), F.lit(0.0))
    return book.withColumns(cols)


def arrays_from_wide(df: DataFrame, k: int = 5) -> DataFrame:
    """bid_price_i / bid_size_i columns to arrays of (price, size), absent levels left out."""
    out = {}
    for s in ("bid", "ask"):
        levels = [F.struct(F.col(f"{s}_price_{i}").alias("price"), F.col(f"{s}_size_{i}").alias("size")) for i in range(1, k + 1)]
        out[f"{s}s"] = F.filter(F.array(*levels), lambda x: x["price"].isNotNull() & (x["price"] > 0))
    return df.withColumns(out)


def snapshot_changes(book: DataFrame, order: EventOrder) -> DataFrame:
    """Differences between successive snapshots: mid, spread, volumes."""
    from tickloom.order import windowed

    cols = ["mid", "spread", "bid_total", "ask_total"]

    def body(d: DataFrame, f) -> DataFrame:
        return d.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(f.ordered()) for c in cols})

    return windowed(book, order, body, before=1)


def normalised_depth(book: DataFrame, k: int = 10) -> DataFrame:
    """log1p depth arrays padded to k, order-flow imbalance of the depth."""
    from tickloom.operators.normalise import depth_log

    pad = lambda c: F.slice(F.concat(F.col(c), F.array_repeat(F.lit(0.0), k)), 1, k)
    b, a = _sum(F.col("bid_sizes")), _sum(F.col("ask_sizes"))
    return book.withColumns(
        {
            "depth_bid_norm": depth_log(pad("bid_sizes")),
            "depth_ask_norm": depth_log(pad("ask_sizes")),
            "ofi_norm": ratio(b - a, a + b),
        }
    )


def queue_snapshot(k: int = 10) -> Column:
    """Interleaved [bid price, bid size, ask price, ask size] per level, 4k values."""
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(0.0))
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda i: F.array(at("bid_prices", i), at("bid_sizes", i), at("ask_prices", i), at("ask_sizes", i)),
        )
    )


def book_image(tick: float, cells: int = 400, half: int = 10) -> Column:
    """Fixed-length image: the first 2*half cells hold level sizes by tick offset from
    the mid price (asks win a shared cell), the rest are 0."""
    place = lambda p: ((p - F.col("mid")) / tick).cast("int") + half  # noqa: E731  (towards zero)

    def cell(s: str, i: Column) -> Column:
        pairs = F.arrays_zip(F.col(f"{s}_prices").alias("p"), F.col(f"{s}_sizes").alias("q"))
        return F.get(F.filter(pairs, lambda x: place(x["p"]) == i), F.lit(0))["q"]

    return F.transform(
        F.sequence(F.lit(0), F.lit(cells - 1)),
        lambda i: F.when(
            F.col("mid").isNotNull() & (i < 2 * half), F.coalesce(cell("ask", i), cell("bid", i), F.lit(0.0))
        ).otherwise(0.0),
    )


def event_tokens() -> Column:
    """[action code, side code] as small integers."""
    # Fixed values (token numbers).
    actions = {"A": 0, "M": 1, "C": 2, "R": 3, "F": 4, "T": 5, "N": 6}
    sides = {"B": 0, "A": 1, "N": 2}
    # End of fixed values.
    code = lambda c, table, other: F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c)), F.lit(other)
    )
    return F.array(code("action", actions, 6), code("side", sides, 2))


def cancel_modify_share(df: DataFrame, order: EventOrder) -> DataFrame:
    """Running share of cancels and modifies among adds, modifies and cancels."""
    kinds = F.when(F.col("action").isin("A", "M", "C"), F.lit(1))
    moved = F.when(F.col("action").isin("M", "C"), F.lit(1))
    d = running(df, order, {"_all": ("count", kinds), "_cm": ("count", moved)})
    return d.withColumn("cancel_modify_ratio", ratio(F.col("_cm"), F.col("_all"))).drop("_all", "_cm")


def price_table(df: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Bid and ask size per price for the k prices around the middle of the range."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0))
    t = df.groupBy(*by, "price").agg(side("B").alias("bid_size"), side("A").alias("ask_size"))
    w = Window.partitionBy(*by)
    t = t.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy("price")) - 1})
    start = F.greatest(F.floor(F.col("_n") / 2) - k // 2, F.lit(0))
    return t.filter((F.col("_i") >= start) & (F.col("_i") < start + k)).drop("_n", "_i")


def walk_slippage(orders: DataFrame, tick: float, levels: str = "levels", size: str = "order_size") -> DataFrame:
    """Cost of a market order that walks the given levels, best first.

    ``slippage`` adds up the distance from the best price of every level touched (one
    tick when there are no levels); ``fill_price`` is the average over what was filled
    and ``unfilled`` is what the levels could not fill.
    """
    best = F.get(levels, F.lit(0))["price"]
    state = F.struct(F.col(size).cast("double").alias("left"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("slip"))

    def step(s: Column, x: Column) -> Column:
        take = F.least(s["left"], x["size"].cast("double"))
        away = F.when(s["left"] > 0, F.abs(x["price"] - best)).otherwise(0.0)
        return F.struct(
            (s["left"] - take).alias("left"), (s["cost"] + take * x["price"]).alias("cost"), (s["slip"] + away).alias("slip")
        )

    d = orders.withColumn("_w", F.aggregate(F.col(levels), state, step))
    filled = F.col(size) - F.col("_w.left")
    return d.withColumns(
        {
            "unfilled": F.col("_w.left"),
            "fill_price": F.when(filled > 0, F.col("_w.cost") / filled),
            "slippage": F.when(F.size(levels) > 0, F.col("_w.slip")).otherwise(F.lit(float(tick))),
        }
    ).drop("_w")
