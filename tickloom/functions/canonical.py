"""Canonical event columns: codes, prices, clocks, flags, defaults, null policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.cols import col
from tickloom.order import EventOrder, running

# Fixed values (wire format): codes, accepted spellings, flag bits, undefined markers.
ACTIONS = {
    "A": "Add order to book",
    "M": "Modify existing order",
    "C": "Cancel order from book",
    "R": "Clear all orders for instrument",
    "T": "Trade executed (aggressor)",
    "F": "Order filled (resting)",
    "N": "No action (flags/info only)",
}
SIDES = {"B": "Buy/Bid", "A": "Ask/Sell", "N": "No side specified"}
ACTION_WORDS = {
    "ADD": "A", "MODIFY": "M", "CANCEL": "C", "D": "C", "DELETE": "C", "EXECUTE": "F", "FILL": "F",
    "TRADE": "T", "CLEAR": "R", "NONE": "N",
}
SIDE_WORDS = {"BID": "B", "BUY": "B", "ASK": "A", "S": "A", "SELL": "A", "NONE": "N"}
FLAGS = {
    "is_last": (128, "Last record in event"),
    "is_tob": (64, "Top-of-book message"),
    "is_snapshot": (32, "Snapshot/replay data"),
    "is_mbp": (16, "Aggregated price level"),
    "bad_ts_recv": (8, "Bad receive timestamp"),
    "maybe_bad_book": (4, "Possible book gap"),
    "publisher_specific": (2, "Publisher-specific"),
    "reserved": (1, None),
}
UNDEF_PRICE = 9223372036854775807
UNDEF_TIMESTAMP = 18446744073709551615
PRICE_SCALE = 1_000_000_000
MBO_RECORD_TYPE = 160
# End of fixed values.

EVENT_DEFAULTS: dict[str, object] = {
    "ts_recv": None,
    "action": "N",
    "side": "N",
    "price": 0.0,
    "size": 0,
    "order_id": "0",
    "flags": 0,
    "sequence": 0,
    "instrument": "UNKNOWN",
}

MBO_SCHEMA = T.StructType(
    [
        T.StructField("ts_event", T.LongType(), False),
        T.StructField("ts_recv", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("instrument", T.StringType()),
    ]
)


def _lookup(code: Column, table: dict[str, str], default: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, code), default)


def canonical_action(c: Column | str) -> Column:
    """Any accepted spelling to one of A M C R T F N; unknown gives N."""
    return _lookup(F.upper(F.trim(col(c))), {**{k: k for k in ACTIONS}, **ACTION_WORDS}, F.lit("N"))


def canonical_side(c: Column | str) -> Column:
    """Any accepted spelling to one of B A N; unknown gives N."""
    return _lookup(F.upper(F.trim(col(c))), {**{k: k for k in SIDES}, **SIDE_WORDS}, F.lit("N"))


def action_text(c: Column | str) -> Column:
    return _lookup(col(c), ACTIONS, F.concat(F.lit("Unknown action: "), col(c)))


def side_text(c: Column | str) -> Column:
    return _lookup(col(c), SIDES, F.concat(F.lit("Unknown side: "), col(c)))


def price_from_fixed(c: Column | str) -> Column:
    """Fixed-point 1e-9 integer to decimal(18,9); the undefined marker gives NULL."""
    c = col(c)
    scaled = (c.cast("decimal(19,0)") * F.lit("0.000000001").cast("decimal(9,9)")).cast("decimal(18,9)")
    return F.when(c == UNDEF_PRICE, None).otherwise(scaled)


def price_to_fixed(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.isNull(), F.lit(UNDEF_PRICE)).otherwise(
        F.round(c.cast("decimal(28,9)") * PRICE_SCALE, 0).cast("long")
    )


def price_of_either_unit(c: Column | str) -> Column:
    """Values in (0, 100000) are prices already, others are 1e-9 units."""
    c = col(c)
    return F.when((c > 0) & (c < 100000), c.cast("double")).otherwise(c / F.lit(1e9))


def timestamp_from_ns(c: Column | str) -> Column:
    """Nanosecond clock to timestamp (microseconds); undefined gives NULL."""
    c = col(c)
    wide = c.cast("decimal(20,0)")
    undefined = wide == F.lit(str(UNDEF_TIMESTAMP)).cast("decimal(20,0)")
    return F.when(undefined | c.isNull(), None).otherwise(
        F.timestamp_micros(F.floor(wide / 1000).cast("long"))
    )


def ns_from_timestamp(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp")) * 1000


def first_clock(df: DataFrame) -> Column:
    """The best available clock: ts_event, ts_recv, ts_recv - ts_in_delta, ts_out."""
    have = set(df.columns)
    choices = [c for c in ("ts_event",) if c in have]
    if "ts_recv" in have:
        choices.append("ts_recv")
    exprs = [F.col(c) for c in choices]
    if {"ts_recv", "ts_in_delta"} <= have and "ts_event" not in have:
        exprs.insert(0, F.col("ts_recv") - F.col("ts_in_delta"))
    if "ts_out" in have:
        exprs.append(F.col("ts_out"))
    if not exprs:
        raise ValueError("no clock column among ts_event, ts_recv, ts_out")
    return F.coalesce(*exprs)


def flag_columns(c: Column | str = "flags") -> dict[str, Column]:
    return {name: col(c).bitwiseAND(F.lit(bit)) != 0 for name, (bit, _) in FLAGS.items()}


def flag_text(c: Column | str = "flags") -> Column:
    parts = [
        F.when(col(c).bitwiseAND(F.lit(bit)) != 0, F.lit(text)) for _, (bit, text) in FLAGS.items() if text
    ]
    joined = F.concat_ws("; ", *parts)
    return F.when(joined == "", F.lit("No special flags")).otherwise(joined)


def with_required(df: DataFrame, defaults: dict[str, object] = EVENT_DEFAULTS) -> DataFrame:
    """Add absent event columns with their defaults; ts_event itself must exist."""
    if "ts_event" not in df.columns:
        raise ValueError("ts_event is required")
    fallback = {"ts_recv": F.col("ts_event"), "sequence": F.lit(0).cast("long")}
    missing = [c for c in defaults if c not in df.columns]
    return df.withColumns({c: fallback.get(c, F.lit(defaults[c])) for c in missing})


def coerce(df: DataFrame, types: dict[str, str], default: object = 0) -> DataFrame:
    """Cast columns, turning values that do not parse into ``default``."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast(t), F.lit(default).cast(t)) for c, t in types.items()})


def align(df: DataFrame, side: str = "side", ts: str = "ts_event") -> DataFrame:
    """Drop rows without a usable clock and fold unknown sides to N."""
    return df.filter(F.col(ts).isNotNull() & (F.col(ts) > 0)).withColumn(
        side, F.when(F.col(side).isin("B", "A", "N"), F.col(side)).otherwise("N")
    )


def canonicalise(df: DataFrame) -> DataFrame:
    """Any accepted event table to the ten canonical columns (extra columns kept)."""
    df = with_required(df)
    typed = coerce(df, {"size": "bigint", "flags": "int", "sequence": "bigint"})
    return align(
        typed.withColumns(
            {
                "action": canonical_action("action"),
                "side": canonical_side("side"),
                "price": F.col("price").cast("double"),
                "order_id": F.col("order_id").cast("string"),
            }
        )
    )


def executions(df: DataFrame) -> DataFrame:
    """Fills only, as ticks (ts in seconds, buy/sell side)."""
    return df.filter(F.col("action") == "F").select(
        (F.col("ts_event") / F.lit(1e9)).alias("ts"),
        "ts_event",
        "sequence",
        "instrument",
        "price",
        F.col("size").cast("double").alias("size"),
        F.when(F.col("side") == "B", "buy").otherwise("sell").alias("side"),
        "order_id",
    )


def tick_from_message(df: DataFrame) -> DataFrame:
    """Generic message columns to a tick, with the message defaults."""
    have = set(df.columns)

    def pick(names: list[str], default: object) -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in have], F.lit(default))

    return df.select(
        pick(["ts", "timestamp"], 0.0).cast("double").alias("ts"),
        pick(["price"], 0.0).cast("double").alias("price"),
        pick(["size"], 1.0).cast("double").alias("size"),
        pick(["side"], "buy").alias("side"),
        pick(["symbol", "instrument"], "").alias("symbol"),
    )


def narrowed(df: DataFrame, keep_wide: tuple[str, ...] = ("price", "ts_event", "ts_recv")) -> DataFrame:
    """Store integers in the smallest type that holds their range (one min/max pass)."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))]
    ints = [c for c in ints if c not in keep_wide]
    if not ints:
        return df
    bounds = df.agg(*[F.min(c).alias(f"lo_{c}") for c in ints], *[F.max(c).alias(f"hi_{c}") for c in ints]).first()
    plan = {}
    for c in ints:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if lo is None:
            continue
        for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            if -(1 << bits) <= lo and hi < (1 << bits):
                plan[c] = F.col(c).cast(name)
                break
    return df.withColumns(plan)


def fill_gaps(df: DataFrame, order: EventOrder, cols: list[str]) -> DataFrame:
    """±inf and NaN to NULL, then the last known value of the key, then 0."""
    clean = df.withColumns(
        {c: F.when(F.isnan(c) | F.abs(F.col(c)).isin(float("inf")), None).otherwise(F.col(c)) for c in cols}
    )
    filled = running(clean, order, {f"_ff_{c}": ("last", c) for c in cols})
    return filled.withColumns({c: F.coalesce(F.col(f"_ff_{c}"), F.lit(0.0)) for c in cols}).drop(
        *[f"_ff_{c}" for c in cols]
    )


def impute(df: DataFrame, order: EventOrder, carry: list[str], median: list[str]) -> DataFrame:
    """Carry ``carry`` columns forward, set ``median`` columns to their median, then 0."""
    from tickloom.operators.quantiles import exact_quantiles

    out = running(df, order, {f"_ff_{c}": ("last", c) for c in carry})
    out = out.withColumns({c: F.col(f"_ff_{c}") for c in carry}).drop(*[f"_ff_{c}" for c in carry])
    for c in median:
        mid = exact_quantiles(df, c, {f"_med_{c}": 0.5})
        out = out.crossJoin(F.broadcast(mid)).withColumn(c, F.coalesce(F.col(c), F.col(f"_med_{c}"))).drop(f"_med_{c}")
    return out.fillna(0.0, subset=[*carry, *median])


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=subset)


def unique_columns(*frames_columns: list[str]) -> list[str]:
    """Column names in first-seen order without repeats."""
    return list(dict.fromkeys(reduce(lambda a, b: a + b, frames_columns, [])))


def side_by_side(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Frames joined on their key columns; a column that repeats is taken from the first frame that has it."""
    out = frames[0]
    for other in frames[1:]:
        fresh = [c for c in unique_columns(out.columns, other.columns) if c not in out.columns]
        out = out.join(other.select(*on, *fresh), on)
    return out
