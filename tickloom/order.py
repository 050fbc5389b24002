"""Ordered computation per key that stays parallel when one key is huge.

Two physical forms of the same operators:

* plain: ``Window.partitionBy(keys)``, one shuffle. Right while every key fits a task.
* cells: rows get a dense row number per key, every key is cut into cells of a fixed
  number of rows, and each cell carries the neighbour rows ("halo") its frames reach
  back (or ahead) to. Unbounded frames become a scan inside the cell plus a scan over
  the few cell totals.

``EventOrder.measured`` counts rows per key once and picks the form; nothing is
dropped or capped in either.

An operator of several steps sorts a huge key once: ``EventOrder.pinned`` numbers the
rows, writes them with their number and cell, and every later scan over the key, or over
finer keys inside it, works on those cells (``one_pin`` wraps an operator so).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.session import pin

HOT_ROWS_CONF = "tickloom.hotKeyRows"
CELL_ROWS_CONF = "tickloom.cellRows"
WIDE_ROWS_CONF = "tickloom.wideRows"
DEFAULT_HOT_ROWS = 4_000_000
DEFAULT_CELL_ROWS = 500_000
DEFAULT_WIDE_ROWS = 50_000
MOST_BLOCKS = 200_000
_INDEX_BITS = 33  # monotonically_increasing_id: partition above, place in it below
HELD_NUMBER, HELD_CELL = "_held_rn", "_held_cell"


@dataclass(frozen=True)
class EventOrder:
    """Which rows belong together (keys) and in what order they are replayed.

    ``order`` must be unique within a key; ``ts`` is the nanosecond clock used by
    time frames. ``hot`` is the measured decision: True uses cells. ``density`` is the
    measured number of rows per clock unit of the densest key, ``largest`` that of the
    rows of the largest. ``held`` names the keys within which rows already carry a number
    and a cell, ``whole`` says that no row was left out since. ``above`` is the number of
    rows from which a key is cut, if it is not the setting for huge keys.
    """

    keys: tuple[str, ...] = ("instrument",)
    order: tuple[str, ...] = ("ts_event", "sequence")
    ts: str = "ts_event"
    hot: bool | None = None
    cell_rows: int | None = None
    density: float | None = None
    largest: int | None = None
    held: tuple[str, ...] = ()
    whole: bool = False
    above: int | None = None

    def pinned(self, df: DataFrame) -> tuple[DataFrame, "EventOrder"]:
        """``df`` numbered and written once, if its largest key is huge, and the order that knows it."""
        order = self.measured(df)
        if not order.hot or order.carried(df):
            return df, order
        order = replace(order, held=())
        size = order.rows_per_cell(df, 1)
        numbered = number_rows(df, order, HELD_NUMBER).withColumn(HELD_CELL, F.expr(f"({HELD_NUMBER} - 1) div {size}"))
        return numbered, replace(order, held=order.keys)

    def carried(self, df: DataFrame) -> bool:
        """Do the rows carry number and cell within some of these keys?"""
        return bool(self.held) and set(self.held) <= set(self.keys) and {HELD_NUMBER, HELD_CELL} <= set(df.columns)

    def measured(self, df: DataFrame) -> "EventOrder":
        """Decide plain or cells from the largest key of ``df`` (one pruned count)."""
        if self.hot is not None:
            return self
        limit = self.above or int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))
        span = F.greatest(F.max(self.ts) - F.min(self.ts), F.lit(1))
        numeric = dict(df.dtypes)[self.ts] in ("bigint", "int", "double")
        per_key = df.groupBy(*self.keys).agg(
            F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / span if numeric else F.lit(None).cast("double")).alias("d")
        )
        top = per_key.agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
        return replace(self, hot=(top["n"] or 0) > limit, density=top["d"], largest=top["n"] or 0)

    def spread(self, df: DataFrame, times: int = 4) -> "EventOrder":
        """The order for operators whose rows are wide or many: every window of a chain holds
        its rows, so keys are cut into small cells long before they are huge. Below ``times``
        cells a key they cost more than they save."""
        order = self.measured(df)
        size = int(df.sparkSession.conf.get(WIDE_ROWS_CONF, str(DEFAULT_WIDE_ROWS)))
        if not order.hot and (order.largest or 0) <= times * size:
            return order
        return replace(order, hot=True, cell_rows=min(order.rows_per_cell(df, 1), size))

    def by(self, *keys: str) -> "EventOrder":
        """The same order within finer or other keys; measured anew when it was not cold.

        Adding keys to a cold order can only shrink groups, so the decision is kept.
        """
        finer = set(self.keys) <= set(keys)
        hot = False if (finer and self.hot is False) else None
        return replace(self, keys=tuple(keys), hot=hot, density=self.density if finer else None, largest=self.largest if finer else None)

    def frames(self, *extra: str) -> "Frames":
        return Frames((*self.keys, *extra), self.order, self.ts)

    def rows_per_cell(self, df: DataFrame, reach: int) -> int:
        size = self.cell_rows or int(df.sparkSession.conf.get(CELL_ROWS_CONF, str(DEFAULT_CELL_ROWS)))
        return max(size, reach, 1)


@dataclass(frozen=True)
class Frames:
    """Window specifications over one partitioning, so many frames share one sort."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    ts: str

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, n: int) -> WindowSpec:
        """The last n rows, current row included."""
        return self.ordered().rowsBetween(-(n - 1), 0)

    def between(self, start: int, end: int) -> WindowSpec:
        return self.ordered().rowsBetween(start, end)

    def past(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def trailing(self, start_ns: int, end_ns: int = 0) -> WindowSpec:
        """Rows whose clock lies in [t - start_ns, t + end_ns], both ends closed."""
        return Window.partitionBy(*self.keys).orderBy(self.ts).rangeBetween(-start_ns, end_ns)

    def by(self, *extra: str) -> "Frames":
        return Frames((*self.keys, *extra), self.order, self.ts)


def one_pin(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator(df, order, ...)`` whose steps share one sort of a huge key."""

    @wraps(operator)
    def run(df: DataFrame, order: EventOrder, *args, **options) -> DataFrame:
        if HELD_NUMBER in df.columns:  # an operator around this one holds the order
            return operator(df, order, *args, **options)
        held, order = order.pinned(df)
        return operator(held, order, *args, **options).drop(HELD_NUMBER, HELD_CELL)

    return run


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names; null meets null."""
    names = {c: f"_on{i}" for i, c in enumerate(on)}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return left.join(right.withColumnsRenamed(names), reduce(lambda a, b: a & b, same), how).drop(*names.values())


def number_rows(df: DataFrame, order: EventOrder, name: str = "_rn") -> DataFrame:
    """Dense 1-based row number per key in replay order.

    A huge key is dealt by ranges of (key, order) and sorted there; a row's number is its
    place in its range, less that of its key's first row, plus the key's rows in earlier
    ranges. Range bounds come from a sample, so the sorted rows are pinned first.
    """
    order = order.measured(df)
    if not order.hot:
        return df.withColumn(name, F.row_number().over(order.frames().ordered()).cast("long"))
    if order.carried(df):
        if order.whole and order.held == order.keys:
            return df.withColumn(name, F.col(HELD_NUMBER))
        return running(df, order, {name: ("count", F.lit(1))})
    keys, ids = list(order.keys), [F.col(c) for c in (*order.keys, *order.order)]
    ranged = pin(df.repartitionByRange(*ids).sortWithinPartitions(*ids).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_blk", F.shiftright("_at", _INDEX_BITS))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy(*keys, "_blk").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    firsts = firsts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    firsts = firsts.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)} | {"_blk": "_of"})
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    placed = ranged.join(firsts, reduce(lambda a, b: a & b, same, F.col("_blk") == F.col("_of")))
    number = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long")
    return placed.withColumn(name, number).drop("_at", "_blk", "_of", "_first", "_before", *[f"_key{i}" for i in range(len(keys))])


def windowed(
    df: DataFrame,
    order: EventOrder,
    body: Callable[[DataFrame, Frames], DataFrame],
    before: int,
    after: int = 0,
) -> DataFrame:
    """Run ``body`` whose result for a row depends on at most ``before`` earlier and
    ``after`` later rows of the same key (nested frames add up)."""
    order = order.measured(df)
    if not order.hot:
        return body(df, order.frames())
    size = order.rows_per_cell(df, before + after)
    numbered = number_rows(df, order)
    cell = F.expr(f"(_rn - 1) div {size}")
    pos = F.expr(f"(_rn - 1) % {size}")
    homes = F.array_compact(
        F.array(
            F.struct(cell.alias("cell"), F.lit(False).alias("halo")),
            F.when(pos >= size - before, F.struct((cell + 1).alias("cell"), F.lit(True).alias("halo"))),
            F.when((pos < after) & (cell > 0), F.struct((cell - 1).alias("cell"), F.lit(True).alias("halo"))),
        )
    )
    spread = numbered.withColumn("_home", F.explode(homes)).select("*", "_home.*").drop("_home", "_rn")
    spread = spread.withColumnsRenamed({"cell": "_cell", "halo": "_halo"})
    return body(spread, order.frames("_cell")).filter(~F.col("_halo")).drop("_cell", "_halo")


def time_windowed(
    df: DataFrame,
    order: EventOrder,
    body: Callable[[DataFrame, Frames], DataFrame],
    before_ns: int,
) -> DataFrame:
    """Run ``body`` whose frames reach back at most ``before_ns`` on the clock.

    Cells own a fixed number of rows; how far a row must be copied forward is read from
    the start times of the cells. A cell's copies are the rows within ``before_ns`` of it,
    so a burst denser than cells makes them many: keep such reaches to sums (``trailing``).
    """
    order = order.measured(df)
    if not order.hot:
        return body(df, order.frames())
    size = order.rows_per_cell(df, 1)
    keys = list(order.keys)
    numbered = number_rows(df, order).withColumn("_cell", F.expr(f"(_rn - 1) div {size}")).drop("_rn")
    spans = numbered.groupBy(*keys, "_cell").agg(F.min(order.ts).alias("_from"), F.max(order.ts).alias("_to"))
    # Later cells start no earlier than this cell ends, so only starts in
    # [_to, _to + before_ns] matter: an equi-join on two clock buckets finds them.
    width = max(before_ns, 1)
    buckets = F.explode(F.sequence(F.expr(f"_to div {width}"), F.expr(f"(_to + {before_ns}) div {width}")))
    left = spans.withColumn("_b", buckets)
    right = spans.select(*keys, F.col("_cell").alias("_next"), F.col("_from").alias("_start")).withColumn(
        "_b", F.expr(f"_start div {width}")
    )
    pairs = (
        join_null_safe(left, right, [*keys, "_b"])
        .filter((F.col("_next") > F.col("_cell")) & (F.col("_start") <= F.col("_to") + before_ns))
        .groupBy(*keys, "_cell")
        .agg(F.collect_list(F.struct(F.col("_start").alias("start"), F.col("_next").alias("cell"))).alias("_reach"))
    )
    # A frame also holds peers: rows of later cells on the very instant this cell ends at.
    ends = spans.select(*keys, F.col("_to").alias("_at"), F.col("_cell").alias("_earlier"))
    peers = (
        join_null_safe(spans.select(*keys, F.col("_from").alias("_at"), "_cell"), ends, [*keys, "_at"])
        .filter(F.col("_earlier") < F.col("_cell"))
        .groupBy(*keys, "_cell")
        .agg(F.collect_list(F.struct(F.col("_at").alias("start"), F.col("_earlier").alias("cell"))).alias("_peers"))
    )
    none = F.expr("array()").cast("array<struct<start:bigint,cell:bigint>>")
    clock = F.col(order.ts)
    copy = lambda r: F.struct(r["cell"].alias("cell"), F.lit(True).alias("halo"))
    homes = F.concat(
        F.array(F.struct(F.col("_cell").alias("cell"), F.lit(False).alias("halo"))),
        F.transform(F.filter(F.coalesce("_reach", none), lambda r: r["start"] <= clock + before_ns), copy),
        F.transform(F.filter(F.coalesce("_peers", none), lambda r: r["start"].eqNullSafe(clock)), copy),
    )
    spread = (
        join_null_safe(join_null_safe(numbered, pairs, [*keys, "_cell"], "left"), peers, [*keys, "_cell"], "left")
        .withColumn("_home", F.explode(homes))
        .drop("_cell", "_reach", "_peers")
        .select("*", F.col("_home.cell").alias("_cell"), F.col("_home.halo").alias("_halo"))
        .drop("_home")
    )
    return body(spread, order.frames("_cell")).filter(~F.col("_halo")).drop("_cell", "_halo")


def time_cells(df: DataFrame, order: EventOrder, body: Callable[[DataFrame, Frames], DataFrame], reach: int, size: int) -> DataFrame | None:
    """Run ``body`` whose frames reach back at most ``reach`` on the clock, without numbering rows.

    The clock is cut into blocks of at least ``reach``; their counts say which blocks in a row
    make a cell of about ``size`` rows. So a row is shuffled once, and copied only into the
    cell that starts with the next block. None where a block alone holds many cells of rows.
    """
    keys, clock = list(order.keys), F.col(order.ts)
    width = max(reach, int(size / (8 * order.density)) if order.density else 0, 1)
    placed = df.withColumn("_block", F.expr(f"({order.ts} - pmod({order.ts}, {width})) div {width}"))
    blocks = placed.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys).orderBy("_block")
    before = F.coalesce(F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_cell", (before / size).cast("long"))
    after = F.when(F.lead("_block").over(by_key) == F.col("_block") + 1, F.lead("_cell").over(by_key))
    blocks = pin(blocks.withColumn("_after", F.when(after > F.col("_cell"), after)))
    held = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.max("_n").alias("most")).first()
    if (held["most"] or 0) > 4 * size:
        return None
    blocks = blocks.drop("_n")
    spread = join_null_safe(placed, F.broadcast(blocks) if held["blocks"] <= MOST_BLOCKS else blocks, [*keys, "_block"])
    near = F.col("_after").isNotNull() & (clock + reach >= (F.col("_block") + 1) * width)
    homes = F.array_compact(F.array("_cell", F.when(near, F.col("_after"))))
    spread = spread.select(*df.columns, F.posexplode(homes).alias("_copy", "_cell")).withColumn("_halo", F.col("_copy") > 0).drop("_copy")
    return body(spread, order.frames("_cell")).filter(~F.col("_halo")).drop("_cell", "_halo")


_SCANS = {
    "sum": (F.sum, lambda carry, own: F.coalesce(carry + own, own, carry)),
    "count": (F.sum, lambda carry, own: F.coalesce(carry, F.lit(0)) + own),
    "min": (F.min, lambda carry, own: F.least(carry, own)),
    "max": (F.max, lambda carry, own: F.greatest(carry, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda carry, own: F.coalesce(own, carry)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda carry, own: F.coalesce(carry, own)),
}


def running(
    df: DataFrame,
    order: EventOrder,
    scans: dict[str, tuple[str, Column | str]],
    exclusive: Iterable[str] = (),
) -> DataFrame:
    """Prefix scans: ``{out: (kind, column)}`` over all earlier rows of the key.

    kinds: sum, count, min, max, last, first (nulls skipped). Names in ``exclusive``
    leave out the current row.
    """
    order = order.measured(df)
    exclusive = set(exclusive)
    as_col = {n: (F.col(c) if isinstance(c, str) else c) for n, (_, c) in scans.items()}
    source = {
        n: F.when(as_col[n].isNotNull(), F.lit(1)).otherwise(0).cast("long") if kind == "count" else as_col[n]
        for n, (kind, _) in scans.items()
    }

    def frame(frames: Frames, name: str) -> WindowSpec:
        return frames.between(Window.unboundedPreceding, -1 if name in exclusive else 0)

    if not order.hot:
        f = order.frames()
        cols = {n: _SCANS[kind][0](source[n]).over(frame(f, n)) for n, (kind, _) in scans.items()}
        cols = {n: F.coalesce(c, F.lit(0)) if scans[n][0] == "count" else c for n, c in cols.items()}
        return df.withColumns(cols)

    keys = list(order.keys)
    size = order.rows_per_cell(df, 1)
    inputs = {f"_in_{n}": c for n, c in source.items()}
    if order.carried(df):
        cells = df.withColumns({**inputs, "_scan_rn": F.col(HELD_NUMBER), "_scan_cell": F.col(HELD_CELL)})
    else:
        cells = number_rows(df.withColumns(inputs), order, "_scan_rn").withColumn("_scan_cell", F.expr(f"(_scan_rn - 1) div {size}"))
    inner = Frames((*keys, "_scan_cell"), ("_scan_rn",), "_scan_rn")
    local = cells.withColumns(
        {f"_own_{n}": _SCANS[kind][0](F.col(f"_in_{n}")).over(frame(inner, n)) for n, (kind, _) in scans.items()}
    )
    totals = []
    for n, (kind, _) in scans.items():
        c = F.col(f"_in_{n}")
        if kind == "last":
            totals.append(F.max_by(c, F.when(c.isNotNull(), F.col("_scan_rn"))).alias(f"_tot_{n}"))
        elif kind == "first":
            totals.append(F.min_by(c, F.when(c.isNotNull(), F.col("_scan_rn"))).alias(f"_tot_{n}"))
        else:
            totals.append(_SCANS[kind][0](c).alias(f"_tot_{n}"))
    over_cells = Window.partitionBy(*keys).orderBy("_scan_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.groupBy(*keys, "_scan_cell").agg(*totals)
    carried = carried.select(
        *keys,
        "_scan_cell",
        *[_SCANS[kind][0](F.col(f"_tot_{n}")).over(over_cells).alias(f"_carry_{n}") for n, (kind, _) in scans.items()],
    )
    # every row of a cell has its row in ``carried``, null keys too
    carried = carried.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)} | {"_scan_cell": "_of"})
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    joined = local.join(carried, reduce(lambda a, b: a & b, same, F.col("_scan_cell") == F.col("_of")), "left")
    out = {}
    for n, (kind, _) in scans.items():
        own = F.col(f"_own_{n}")
        own = F.coalesce(own, F.lit(0)) if kind == "count" else own
        out[n] = _SCANS[kind][1](F.col(f"_carry_{n}"), own)
    scratch = [f"{p}{n}" for n in scans for p in ("_in_", "_own_", "_carry_")] + [f"_key{i}" for i in range(len(keys))]
    return joined.withColumns(out).drop("_scan_cell", "_scan_rn", "_of", *scratch)


def global_order(*order: str) -> EventOrder:
    """One sequence over the whole table (index-like row numbers)."""
    return EventOrder(keys=("_all",), order=tuple(order), ts=order[0])
