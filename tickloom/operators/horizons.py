"""Trailing time windows: many horizons per event without re-reading wide frames.

Two physical forms give the same numbers. ``frame`` is a RANGE window, right when few
rows fall into it. ``scan`` takes differences of running sums: each event looks up the
running sums in force just before its window opened, for all horizons in one stacked
scan. ``auto`` reads the event density once and chooses per horizon. Keys cut into cells
read a horizon that fits a cell from the cell and the rows copied into it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.fast import per_group
from tickloom.order import EventOrder, Frames, running, time_windowed, windowed

FRAME_ROWS = 200
NO_CLOCK = -(1 << 62)

# Fixed values (horizon names and lengths in milliseconds).
HORIZONS_MS = {
    "10ms": 10, "50ms": 50, "100ms": 100, "500ms": 500, "1s": 1_000, "3s": 3_000, "10s": 10_000, "30s": 30_000,
    "1m": 60_000, "2m": 120_000, "5m": 300_000, "10m": 600_000, "20m": 1_200_000, "30m": 1_800_000, "1h": 3_600_000,
}
# End of fixed values.


def horizon_ns(name: str) -> int:
    return HORIZONS_MS[name] * 1_000_000


def frame_rows(df: DataFrame, order: EventOrder) -> float:
    """Rows per nanosecond of the densest key."""
    per = df.groupBy(*order.keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max(order.ts) - F.min(order.ts)).alias("span")
    )
    top = per.agg(F.max(F.col("n") / F.greatest(F.col("span"), F.lit(1)))).first()[0]
    return float(top or 0.0)


def sparse_horizons(df: DataFrame, order: EventOrder, horizons: dict[str, int], most: int = FRAME_ROWS) -> dict[str, int]:
    """Those whose windows hold few rows, so that a frame may read them."""
    density = order.density if order.density is not None else frame_rows(df, order)
    return {h: ns for h, ns in horizons.items() if density * ns <= most}


def trailing(
    df: DataFrame,
    order: EventOrder,
    sums: dict[str, Column | str],
    horizons: dict[str, int],
    method: str = "auto",
) -> DataFrame:
    """Sums over the closed window [t - h, t] of the same key.

    Adds ``{horizon}_{name}`` per horizon and sum, plus ``{horizon}_events``. NULL
    inputs count as 0.
    """
    order = order.spread(df)
    cols = {f"_t_{n}": F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for n, c in sums.items()}
    exact = any(t.startswith("decimal") for _, t in df.select(*cols.values()).dtypes)
    in_cells = order.hot and method == "auto" and not exact
    if in_cells:
        sparse = sparse_horizons(df, order, horizons, order.rows_per_cell(df, 1))
    elif method == "auto":
        sparse = sparse_horizons(df, order, horizons)
    else:
        sparse = dict(horizons) if method == "frame" else {}
    dense = {h: ns for h, ns in horizons.items() if h not in sparse}
    out = df.withColumns({**cols, "_t_events": F.lit(1).cast("long")})
    names = [*sums, "events"]
    if sparse:
        out = (_by_cell if in_cells else _by_frame)(out, order, names, sparse)
    if dense:
        out = _by_scan(out, order, names, dense)
    return out.drop(*[f"_t_{n}" for n in names])


def _by_frame(df: DataFrame, order: EventOrder, names: list[str], horizons: dict[str, int]) -> DataFrame:
    def body(d: DataFrame, f: Frames) -> DataFrame:
        return d.withColumns(
            {f"{h}_{n}": F.sum(f"_t_{n}").over(f.trailing(ns)) for h, ns in horizons.items() for n in names}
        )

    return time_windowed(df, order, body, max(horizons.values()))


def range_sums(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Sums of values[i:j] for arrays of i and j; a NaN or infinity counts only where it lies inside."""
    whole = lambda v: np.concatenate([[0], np.cumsum(v)])
    if values.dtype.kind != "f" or np.isfinite(values).all():
        sums = whole(values)
        return lambda i, j: sums[j] - sums[i]
    sums = whole(np.where(np.isfinite(values), values, 0.0))
    odd = {v: whole(np.isnan(values) if np.isnan(v) else values == v) for v in (np.inf, -np.inf, np.nan)}

    def between(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = sums[j] - sums[i]
        with np.errstate(invalid="ignore"):  # both infinities give NaN
            for v, seen in odd.items():
                out = np.where(seen[j] > seen[i], out + v, out)
        return out

    return between


def _by_cell(df: DataFrame, order: EventOrder, names: list[str], horizons: dict[str, int]) -> DataFrame:
    """Differences of the running sums of a cell, its copied rows included, for all horizons at once."""
    types = {n: t if (t := dict(df.dtypes)[f"_t_{n}"]) in ("double", "float") else "bigint" for n in names}
    outputs = {f"{h}_{n}": "double" if types[n] != "bigint" else "bigint" for h in horizons for n in names}

    def fn(g: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        at, out = g["_t_at"], {}
        sums = {n: range_sums(g[f"_t_{n}"]) for n in names}
        last = np.searchsorted(at, at, side="right")
        for h, ns in horizons.items():
            first = np.searchsorted(at, at - ns, side="left")
            out |= {f"{h}_{n}": pa.array(between(first, last)) for n, between in sums.items()}  # keeps NaN apart from null
        return out

    def body(d: DataFrame, f: Frames) -> DataFrame:
        d = d.withColumn("_t_at", F.coalesce(F.col(order.ts), F.lit(NO_CLOCK)))  # rows without a clock are peers
        return per_group(d, f, outputs, fn, ["_t_at", *[f"_t_{n}" for n in names]]).drop("_t_at")

    return time_windowed(df, order, body, max(horizons.values()))


def _look_back(df: DataFrame, order: EventOrder, own: Column, horizons: dict[str, int]) -> tuple[DataFrame, list[str]]:
    """Every row with ``own`` of the last row before each of its windows opens (``_b0``,
    ``_b1``, ...) and of the last row of its own instant (``_now``), by one stacked scan.

    Other columns travel once, packed in ``_row``; their names are returned.
    """
    keys, ids = list(order.keys), list(order.order)
    payload = [c for c in df.columns if c not in keys and c not in ids]
    steps = list(horizons.items())
    # kind 0 reads before a window opens, kind 1 is the row itself, kind 2 reads after
    # every row of the same instant (windows include peers)
    probes = F.array(
        *[F.struct((F.col(order.ts) - ns).alias("at"), F.lit(0).alias("kind"), F.lit(i).alias("h")) for i, (_, ns) in enumerate(steps)],
        F.struct(F.col(order.ts).alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("h")),
        F.struct(F.col(order.ts).alias("at"), F.lit(2).alias("kind"), F.lit(-2).alias("h")),
    )
    stacked = (
        df.select(*keys, *ids, *payload, own.alias("_own"), F.explode(probes).alias("_q"))
        .select(*keys, *ids, *payload, "_own", F.col("_q.at").alias("_at"), F.col("_q.kind").alias("_kind"), F.col("_q.h").alias("_h"))
        .withColumns(
            {
                "_own_if": F.when(F.col("_h") == -1, F.col("_own")),
                # the payload travels once, with the row itself
                "_row": F.when(F.col("_h") == -1, F.struct(*payload) if payload else F.struct(F.lit(1))),
            }
        )
        .drop(*payload)
    )
    tie = [c for c in ids if c != order.ts]
    clock = EventOrder(keys=order.keys, order=("_at", "_kind", *tie, "_h"), ts="_at", hot=order.hot, cell_rows=order.cell_rows)
    seen = running(stacked, clock, {"_before": ("last", "_own_if")})
    # rows that come twice stay two
    picks = [F.collect_list("_row").alias("_rows"), F.max(F.when(F.col("_h") == -2, F.col("_before"))).alias("_now")]
    picks += [F.max(F.when(F.col("_h") == i, F.col("_before"))).alias(f"_b{i}") for i in range(len(steps))]
    found = seen.groupBy(*keys, *ids).agg(*picks)
    return found.withColumn("_row", F.explode("_rows")).drop("_rows"), payload


def _by_scan(df: DataFrame, order: EventOrder, names: list[str], horizons: dict[str, int]) -> DataFrame:
    prefix = running(df, order, {f"_p_{n}": ("sum", f"_t_{n}") for n in names})
    back, payload = _look_back(prefix, order, F.struct(*[F.col(f"_p_{n}").alias(n) for n in names]), horizons)
    result = [
        (F.col(f"_now.{n}") - F.coalesce(F.col(f"_b{i}.{n}"), F.lit(0))).alias(f"{h}_{n}")
        for i, h in enumerate(horizons)
        for n in names
    ]
    return back.select(*order.keys, *order.order, *[F.col(f"_row.{c}").alias(c) for c in payload], *result)


def trailing_price(
    df: DataFrame, order: EventOrder, horizons: dict[str, int], price: str = "price"
) -> DataFrame:
    """``{h}_price_change``: price less the first price inside [t - h, t].

    The first row of a window is the one after the last row before it, so each row
    carries the price that follows it and no window is read.
    """
    order = order.spread(df)
    after = windowed(df, order, lambda d, f: d.withColumn("_next", F.lead(price).over(f.ordered())), before=0, after=1)
    opened = running(after, order, {"_first": ("first", F.struct(F.col(price).alias("p")))})
    back, payload = _look_back(opened, order, F.struct(F.col("_next").alias("p")), horizons)
    change = {
        f"{h}_price_change": F.col(price) - F.when(F.col(f"_b{i}").isNotNull(), F.col(f"_b{i}.p")).otherwise(F.col("_first.p"))
        for i, h in enumerate(horizons)
    }
    out = back.select(*order.keys, *order.order, *[F.col(f"_row.{c}").alias(c) for c in payload], *[f"_b{i}" for i in range(len(horizons))])
    return out.withColumns(change).drop("_next", "_first", *[f"_b{i}" for i in range(len(horizons))])


def trailing_range(
    df: DataFrame, order: EventOrder, name: str, ns: int, column: str, sums: dict[str, str], newest: list[str]
) -> DataFrame:
    """``{name}_range``: max less min of a column in [t - ns, t], without reading the window.

    Time is cut into blocks of ``ns``. A window is the end of one block and the start of the
    next, or the start of one only; both ends come from running extremes. ``sums`` adds
    ``{name}_{out}``, the window's sum of a column; each of ``newest`` becomes its value in
    the last row of the row's instant.
    """
    order = order.measured(df)
    block = F.expr(f"({order.ts} - pmod({order.ts}, {ns})) div {ns}")
    d = df.withColumn("_block", block)
    d = running(d, order, {"_num": ("count", F.lit(1)), **{f"_upto_{n}": ("sum", F.coalesce(F.col(c), F.lit(0))) for n, c in sums.items()}})
    inside = order.by(*order.keys, "_block")
    d = running(d, inside, {"_hi": ("max", column), "_lo": ("min", column)})
    back = EventOrder(keys=inside.keys, order=("_rev",), ts="_rev", hot=inside.hot, cell_rows=order.cell_rows)
    d = running(d.withColumn("_rev", -F.col("_num")), back, {"_top": ("max", column), "_low": ("min", column)})
    d = d.withColumn("_ends", F.struct("_block", "_top", "_low")).drop("_num", "_rev", "_top", "_low")
    d = windowed(d, order, lambda x, f: x.withColumn("_next", F.lead("_ends").over(f.ordered())), before=0, after=1)
    d = running(d, order, {"_first": ("first", "_ends")})
    own = F.struct("_next", "_hi", "_lo", *[f"_upto_{n}" for n in sums], *newest)
    found, payload = _look_back(d, order, own, {name: ns})
    opened = F.when(F.col("_b0").isNotNull(), F.col("_b0._next")).otherwise(F.col("_row._first"))
    found = found.withColumns({"_opened": opened, "_at_block": F.col("_row._block")})
    before = F.col("_opened._block") < F.col("_at_block")
    hi = F.greatest(F.col("_now._hi"), F.when(before, F.col("_opened._top")))
    lo = F.least(F.col("_now._lo"), F.when(before, F.col("_opened._low")))
    made = {f"{name}_range": hi - lo}
    made |= {f"{name}_{n}": F.col(f"_now._upto_{n}") - F.coalesce(F.col(f"_b0._upto_{n}"), F.lit(0)) for n in sums}
    made |= {c: F.col(f"_now.{c}") for c in newest}
    kept = [F.col(f"_row.{c}").alias(c) for c in payload if c in df.columns and c not in newest]
    return found.select(*order.keys, *order.order, *kept, *[v.alias(c) for c, v in made.items()])


def multi_horizon(
    df: DataFrame,
    order: EventOrder,
    horizons: dict[str, int] | None = None,
    convention: str = "aggressor",
    method: str = "auto",
) -> DataFrame:
    """Volumes, delta, delta ratio, price change and volatility of fills per horizon.

    Every column is a window of the stated length ending at the event.
    """
    from tickloom.operators.bars import signed_size

    horizons = horizons or {h: horizon_ns(h) for h in HORIZONS_MS}
    order = order.spread(df)
    fill = F.col("action").isin("F", "T")
    d = signed_size(convention=convention)
    based = running(df, order, {"_base": ("first", "price")})
    x = F.col("price") - F.col("_base")
    sums = {
        "buy_volume": F.when(fill & (d > 0), F.col("size")).otherwise(0),
        "sell_volume": F.when(fill & (d < 0), F.col("size")).otherwise(0),
        "total_volume": F.when(fill, F.col("size")).otherwise(0),
        "delta": F.when(fill, d).otherwise(0),
        "px": x,
        "pxx": x * x,
    }
    out = trailing(based, order, sums, horizons, method)
    extra = {}
    for h in horizons:
        n = F.col(f"{h}_events")
        var = F.col(f"{h}_pxx") / n - (F.col(f"{h}_px") / n) * (F.col(f"{h}_px") / n)
        extra[f"{h}_volatility"] = F.sqrt(F.greatest(var, F.lit(0.0)))
        extra[f"{h}_delta_ratio"] = F.when(
            F.col(f"{h}_total_volume") > 0, F.col(f"{h}_delta") / F.col(f"{h}_total_volume")
        ).otherwise(0.0)
    out = out.withColumns(extra).drop("_base", *[f"{h}_{c}" for h in horizons for c in ("px", "pxx")])
    return out


def cross_horizon(df: DataFrame) -> DataFrame:
    """Ratios and divergences between horizons that are present."""
    have = set(df.columns)

    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(0.0)

    out: dict[str, Column] = {}
    for a, b in (("1s", "1m"), ("1m", "20m")):
        if {f"{a}_delta", f"{b}_delta"} <= have:
            out[f"delta_momentum_{a}_{b}"] = over(f"{a}_delta", f"{b}_delta")
    if {"10s_total_volume", "1m_total_volume", "5m_total_volume"} <= have:
        s, m, l5 = (F.col(f"{h}_total_volume") for h in ("10s", "1m", "5m"))
        out["volume_acceleration_ratio"] = F.when((m > 0) & (l5 > 0), (s / m) / (m / l5)).otherwise(0.0)
    if {"1s_delta", "1h_delta"} <= have:
        short = F.col("1s_delta") / F.greatest(F.col("1s_total_volume"), F.lit(1))
        long = F.col("1h_delta") / F.greatest(F.col("1h_total_volume"), F.lit(1))
        out["delta_divergence_1s_1h"] = short - long
    return df.withColumns(out)


def event_counts(df: DataFrame, order: EventOrder, kinds: list[str], horizons: dict[str, int], kind: str = "event_kind") -> DataFrame:
    """Detected events of each kind in the trailing horizons of every row."""
    return trailing(df, order, {k: F.when(F.col(kind) == k, 1).otherwise(0) for k in kinds}, horizons)
