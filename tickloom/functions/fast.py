"""Rolling aggregates whose cost per row does not grow with the frame.

Spark re-aggregates a sliding frame for every row. Wide frames are instead taken from
running sums (difference of two prefixes) and, for extremes, from block prefixes and
suffixes. Quantiles and ranks of wide frames run in Arrow batches per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tickloom.functions.cols import roll
from tickloom.order import EventOrder, Frames, windowed

NATIVE_ROWS = 60
STRETCH_ROWS = 50_000


def rolling(df: DataFrame, f: Frames, specs: dict[str, tuple[str, int, str]], strict: bool = False) -> DataFrame:
    """Add ``{out: (column, n, how)}``; how: sum, mean, count, std, std_pop, skew, kurt
    (population skewness and excess kurtosis, 0 for a flat frame).

    Values are shifted by the key's first value before squaring, and a frame without
    any change of value has deviation exactly 0. ``strict`` gives NULL until n
    non-null values are in the frame. Frames up to NATIVE_ROWS use Spark's own.
    """
    narrow = {k: v for k, v in specs.items() if v[1] <= NATIVE_ROWS}
    if narrow:
        df = df.withColumns({k: roll(c, f, n, how, strict) for k, (c, n, how) in narrow.items()})
        specs = {k: v for k, v in specs.items() if k not in narrow}
        if not specs:
            return df
    inputs = list(dict.fromkeys(c for c, _, _ in specs.values()))
    spread = {c for c, _, how in specs.values() if how not in ("sum", "mean", "count")}
    shape = {c for c, _, how in specs.values() if how in ("skew", "kurt")}
    w, past = f.ordered(), f.past()
    base, sums = {}, {}
    for i, c in enumerate(inputs):
        base[f"_o{i}"] = F.first(c, ignorenulls=True).over(past).cast("double")
        base[f"_v{i}"] = F.col(c).cast("double")
        if c in spread:
            prev = F.last(c, ignorenulls=True).over(f.between(Window.unboundedPreceding, -1))
            base[f"_c{i}"] = F.when(F.col(c).isNotNull() & (F.col(c) != prev), 1).otherwise(0)
            first = F.col(c).isNotNull() & prev.isNull()
            base[f"_c{i}"] = F.when(first, 0).otherwise(base[f"_c{i}"])
    out = df.withColumns(base)
    for i, c in enumerate(inputs):
        d = F.coalesce(F.col(f"_v{i}") - F.col(f"_o{i}"), F.lit(0.0))
        sums[f"_s{i}"] = F.sum(d).over(past)
        sums[f"_n{i}"] = F.count(F.col(f"_v{i}")).over(past)
        if c in spread:
            sums[f"_q{i}"] = F.sum(d * d).over(past)
            sums[f"_k{i}"] = F.sum(f"_c{i}").over(past)
        if c in shape:
            sums[f"_3{i}"] = F.sum(d * d * d).over(past)
            sums[f"_4{i}"] = F.sum(d * d * d * d).over(past)
    out = out.withColumns(sums)
    results = {}
    for name, (c, n, how) in specs.items():
        i = inputs.index(c)
        diff = lambda p, back=n: F.col(f"{p}{i}") - F.coalesce(F.lag(f"{p}{i}", back).over(w), F.lit(0))
        s, k, o = diff("_s"), diff("_n"), F.col(f"_o{i}")
        mean_d = s / F.nullif(k, F.lit(0))
        if how == "count":
            value: Column = k
        elif how == "sum":
            value = F.when(k > 0, s + k * o)
        elif how == "mean":
            value = mean_d + o
        elif how in ("skew", "kurt"):
            first_k = F.coalesce(F.lag(f"_k{i}", n - 1).over(w), F.lit(0))
            m1, m2, m3 = mean_d, diff("_q") / k, diff("_3") / k
            var = m2 - m1 * m1
            if how == "skew":
                raw = (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / F.pow(var, F.lit(1.5))
            else:
                m4 = diff("_4") / k
                raw = (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / (var * var) - 3
            flat = (F.col(f"_k{i}") - first_k == 0) | (var * k / (k - 1) <= 1e-10)
            value = F.when(k > 1, F.when(flat, F.lit(0.0)).otherwise(raw))
        else:
            ss = F.greatest(diff("_q") - s * mean_d, F.lit(0.0))
            den = k if how == "std_pop" else k - 1
            first_k = F.coalesce(F.lag(f"_k{i}", n - 1).over(w), F.lit(0))
            flat = F.col(f"_k{i}") - first_k == 0
            value = F.when(k > (0 if how == "std_pop" else 1), F.when(flat, F.lit(0.0)).otherwise(F.sqrt(ss / den)))
        results[name] = F.when(k >= n, value) if strict else value
    out = out.withColumns(results)
    return out.drop(*[f"{p}{i}" for i in range(len(inputs)) for p in ("_o", "_v", "_c", "_s", "_n", "_q", "_k", "_3", "_4")])


def correlations(df: DataFrame, f: Frames, specs: dict[str, tuple[Column, Column, int]], exclusive: bool = False) -> DataFrame:
    """Rolling Pearson correlations ``{out: (x, y, n)}`` of the rows where both are known.

    Taken from running sums, all in the same few projections. ``exclusive`` covers the n
    rows before the current one. NULL when either side is flat.
    """
    w, past = f.ordered(), f.past()
    raw, shifted, sums, spans, out = {}, {}, {}, {}, {}
    for i, (x, y, _) in enumerate(specs.values()):
        both = x.isNotNull() & y.isNotNull()
        raw |= {f"_x{i}": F.when(both, x.cast("double")), f"_y{i}": F.when(both, y.cast("double"))}
        shifted |= {f"_{v}{i}": F.col(f"_{v}{i}") - F.first(f"_{v}{i}", True).over(past) for v in "xy"}
    d = df.withColumns(raw).withColumns(shifted)
    at = 1 if exclusive else 0
    for i, (_, _, n) in enumerate(specs.values()):
        x, y = F.col(f"_x{i}"), F.col(f"_y{i}")
        terms = {"n": x.isNotNull().cast("long"), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
        sums |= {f"_s{i}_{k}": F.sum(F.coalesce(t, F.lit(0))).over(past) for k, t in terms.items()}
        for k in terms:
            c = f"_s{i}_{k}"
            end = F.lag(c, at).over(w) if at else F.col(c)
            spans[f"_d{i}_{k}"] = F.coalesce(end, F.lit(0)) - F.coalesce(F.lag(c, n + at).over(w), F.lit(0))
    d = d.withColumns(sums).withColumns(spans)
    for i, name in enumerate(specs):
        c = {k: F.col(f"_d{i}_{k}") for k in ("n", "x", "y", "xx", "yy", "xy")}
        cov = c["xy"] * c["n"] - c["x"] * c["y"]
        vx, vy = c["xx"] * c["n"] - c["x"] * c["x"], c["yy"] * c["n"] - c["y"] * c["y"]
        # running sums leave rounding noise where the frame is flat
        solid = (vx > 1e-9 * (c["xx"] * c["n"] + 1e-30)) & (vy > 1e-9 * (c["yy"] * c["n"] + 1e-30))
        out[name] = F.when((c["n"] > 1) & solid, cov / F.sqrt(vx * vy))
    return d.withColumns(out).drop(*raw, *sums, *spans)


def correlation(df: DataFrame, f: Frames, out: str, x: Column, y: Column, n: int, exclusive: bool = False) -> DataFrame:
    """One rolling correlation, see ``correlations``."""
    return correlations(df, f, {out: (x, y, n)}, exclusive)


def extremes(df: DataFrame, f: Frames, specs: dict[str, tuple[str, int, str]]) -> DataFrame:
    """Rolling min / max over n rows from block prefixes and suffixes (short frames at
    the start of a key use what is there)."""
    out = df.withColumn("_p", F.row_number().over(f.ordered()) - 1)
    for name, (c, n, how) in specs.items():
        agg, pick = (F.max, F.greatest) if how == "max" else (F.min, F.least)
        out = out.withColumn("_b", F.expr(f"_p div {n}"))
        head = Window.partitionBy(*f.keys, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        tail = Window.partitionBy(*f.keys, "_b").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({"_h": agg(c).over(head), "_t": agg(c).over(tail)})
        back = F.lag("_t", n - 1).over(f.ordered())
        out = out.withColumn(name, F.when(F.col("_p") % n == n - 1, F.col("_h")).otherwise(pick(F.col("_h"), back)))
        out = out.drop("_b", "_h", "_t")
    return out.drop("_p")


def _spans(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Start offsets of the runs of equal keys in a sorted table."""
    change = np.zeros(len(table), dtype=bool)
    change[0] = True
    for k in keys:
        v = table[k].to_pandas().to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def per_group(
    df: DataFrame,
    f: Frames,
    outputs: dict[str, str],
    fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray | pa.Array]],
    inputs: list[str],
    ahead: int | Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]] | None = None,
) -> DataFrame:
    """Add columns computed by numpy over one sorted group (a key, or a cell of it).

    A row number over the window first puts every key into one partition (no shuffle if
    it is there already). The optimizer may move that window below another one, so the
    order is also asked for on its own; Spark drops that sort where it already holds.
    Arrow batches are then cut at the key changes, so many small groups cost no
    per-group transfer.

    Only keys, clock and inputs become numpy arrays. Every other column stays in its
    Arrow form, so clocks keep their nanoseconds where some rows have none.

    With ``ahead`` a worker holds a stretch of about ``STRETCH_ROWS`` rows, however long the
    group is. It says which input rows stand ahead of the next stretch: that many last ones,
    if a result depends on at most so many earlier rows, or what it makes of the rows so far.
    """
    placed = df.withColumn("_place", F.row_number().over(f.ordered())).sortWithinPartitions(*f.keys, *f.order)
    types = {n: T._parse_datatype_string(t) for n, t in outputs.items()}
    fields = [*placed.schema.fields, *[T.StructField(n, t) for n, t in types.items()]]
    arrow = {n: to_arrow_type(t) for n, t in types.items()}
    keys, stretch = list(f.keys), STRETCH_ROWS
    rest = (lambda g: {c: a[max(len(a) - ahead, 0) :] for c, a in g.items()}) if isinstance(ahead, int) else ahead

    lead = f.order[0]

    def solve(table: pa.Table, opening: dict[str, np.ndarray] | None, last: bool) -> tuple[pa.Table, dict[str, np.ndarray] | None]:
        """The table with its outputs, and the rows ahead of what follows in its last group."""
        starts = _spans(table, keys)
        clock = table[lead].combine_chunks()
        back = pc.less(clock.slice(1), clock.slice(0, len(clock) - 1)).fill_null(False).to_numpy(zero_copy_only=False).copy()
        back[starts[1:] - 1] = False
        if back.any():
            raise RuntimeError(f"rows of a group arrived out of order on {lead}")
        ends = [*starts[1:], len(table)]
        arrays = {c: table[c].to_pandas().to_numpy() for c in inputs}
        groups = [{c: a[i:j] for c, a in arrays.items()} for i, j in zip(starts, ends)]
        cut = 0
        if opening is not None:
            cut = len(opening[inputs[0]])
            groups[0] = {c: np.concatenate([opening[c], a]) for c, a in groups[0].items()}
        parts = [fn(g) for g in groups]
        if cut:
            parts[0] = {n: v.slice(cut) if isinstance(v, pa.Array) else v[cut:] for n, v in parts[0].items()}
        for n in outputs:
            if isinstance(parts[0][n], pa.Array):
                table = table.append_column(n, pa.concat_arrays([p[n] for p in parts]).cast(arrow[n]))
                continue
            values = pd.Series(np.concatenate([p[n] for p in parts]))
            table = table.append_column(n, pa.Array.from_pandas(values, mask=values.isnull().to_numpy(), type=arrow[n]))
        return table.combine_chunks(), None if last else {c: a.copy() for c, a in rest(groups[-1]).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        opening: dict[str, np.ndarray] | None = None  # of the group whose key is ``now``
        now: list | None = None
        ends = lambda batch, i: [batch[k][i].as_py() for k in keys]
        for batch in batches:
            if not batch.num_rows:
                continue
            first, end = ends(batch, 0), ends(batch, batch.num_rows - 1)
            if not held and first != now:
                opening = None
            if first != end or (held and first != now):
                whole = pa.Table.from_batches([*held, batch])
                cut = int(_spans(whole, keys)[-1])
                if cut:
                    solved, opening = solve(whole.slice(0, cut), opening, True)
                    yield from solved.to_batches()
                held = whole.slice(cut).combine_chunks().to_batches()
            else:
                held.append(batch)
            now = end
            if rest and sum(b.num_rows for b in held) >= stretch:
                solved, opening = solve(pa.Table.from_batches(held), opening, False)
                held = []
                yield from solved.to_batches()
        if held:
            solved, _ = solve(pa.Table.from_batches(held), opening, True)
            yield from solved.to_batches()

    return placed.mapInArrow(run, T.StructType(fields)).drop("_place")


def rolling_quantile(values: np.ndarray, n: int, q: float, strict: bool = True) -> np.ndarray:
    """Linear-interpolation quantile of the last n values."""
    return pd.Series(values.astype("float64")).rolling(n, min_periods=n if strict else 1).quantile(q).to_numpy()


def tail_means(values: np.ndarray, limit: np.ndarray, n: int) -> np.ndarray:
    """Mean of the values at or below that row's limit in each n-row window."""
    out = np.full(len(values), np.nan)
    if len(values) < n:
        return out
    view = np.lib.stride_tricks.sliding_window_view(values, n)
    ends = limit[n - 1 :]
    step = max(1, 4_000_000 // n)
    for i in range(0, len(view), step):
        part = view[i : i + step]
        hit = part <= ends[i : i + step, None]
        count = hit.sum(axis=1)
        total = np.where(hit, part, 0.0).sum(axis=1)
        out[n - 1 + i : n - 1 + i + len(part)] = np.where(count > 0, total / np.maximum(count, 1), np.nan)
    return out


def quantiles_in(d: DataFrame, f: Frames, specs: dict[str, tuple[str, int, float]], strict: bool = True) -> DataFrame:
    """Rolling quantiles inside a body that already runs over these frames."""

    def fn(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {name: rolling_quantile(g[c], n, q, strict) for name, (c, n, q) in specs.items()}

    d = per_group(d, f, {n: "double" for n in specs}, fn, sorted({c for c, _, _ in specs.values()}), max(n for _, n, _ in specs.values()))
    return d.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in specs})


def wide_quantiles(
    df: DataFrame, order: EventOrder, specs: dict[str, tuple[str, int, float]], strict: bool = True
) -> DataFrame:
    """Rolling quantiles ``{out: (column, n, q)}`` with linear interpolation."""

    def fn(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {name: rolling_quantile(g[c], n, q, strict) for name, (c, n, q) in specs.items()}

    reach = max(n for _, n, _ in specs.values())
    inputs = sorted({c for c, _, _ in specs.values()})
    return windowed(df, order, lambda d, f: per_group(d, f, {n: "double" for n in specs}, fn, inputs, reach), before=reach)
