"""Row predicates on the clock, and statistics about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCHANGE_ZONE = "America/New_York"

# Fixed values (named time-of-day ranges).
TIMEFRAMES = {
    "extended_day": ("09:00:00", "16:30:00"),
    "full_day": ("00:00:00", "23:59:00"),
    "business": ("08:00:00", "17:00:00"),
    "regular": ("09:30:00", "16:00:00"),
}
# End of fixed values.


def local_time(ts_ns: Column | str = "ts_event", zone: str = EXCHANGE_ZONE) -> Column:
    """Wall-clock timestamp in ``zone``; daylight saving follows the zone's rules."""
    c = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    return F.from_utc_timestamp(F.timestamp_micros(F.floor(c / F.lit(1000)).cast("long")), zone)


def in_hours(start: str, end: str, ts_ns: Column | str = "ts_event", zone: str = EXCHANGE_ZONE) -> Column:
    """Time of day within [start, end], both ends included, to the microsecond."""
    at = F.date_format(local_time(ts_ns, zone), "HH:mm:ss.SSSSSS")
    return at.between(f"{start}.000000", f"{end}.000000")


def trading_hours(df: DataFrame, zone: str = EXCHANGE_ZONE) -> DataFrame:
    return df.filter(in_hours(*TIMEFRAMES["regular"], zone=zone))


def timeframe(df: DataFrame, name: str, zone: str = EXCHANGE_ZONE) -> DataFrame:
    return df.filter(in_hours(*TIMEFRAMES[name], zone=zone))


def timeframe_stats(df: DataFrame, start: str, end: str, zone: str = EXCHANGE_ZONE) -> DataFrame:
    """Rows kept and dropped by a time-of-day range, in one pass."""
    keep = in_hours(start, end, zone=zone)
    out = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(keep).alias("kept_rows"))
    return out.withColumns(
        {
            "dropped_rows": F.col("total_rows") - F.col("kept_rows"),
            "kept_pct": F.when(F.col("total_rows") > 0, F.col("kept_rows") / F.col("total_rows") * 100).otherwise(0.0),
        }
    )


def between_clock(df: DataFrame, start_ns: int | None = None, end_ns: int | None = None, ts: str = "ts_event") -> DataFrame:
    """Half-open [start, end) filter that reaches the scan as a plain comparison."""
    if start_ns is not None:
        df = df.filter(F.col(ts) >= start_ns)
    if end_ns is not None:
        df = df.filter(F.col(ts) < end_ns)
    return df


def last_minutes(df: DataFrame, minutes: int, ts: str = "ts_event") -> DataFrame:
    """Rows within ``minutes`` of the newest row; the bound is one broadcast row."""
    bound = df.agg((F.max(ts) - minutes * 60_000_000_000).alias("_bound"))
    return df.join(F.broadcast(bound), F.col(ts) >= F.col("_bound"), "inner").drop("_bound")


def minute_chunk(df: DataFrame, trade_date: str, start_minute: int, minutes: int, open_at: str = "09:30:00", zone: str = EXCHANGE_ZONE) -> DataFrame:
    """Half-open chunk of a session, counted from the open in exchange time."""
    opened = F.to_utc_timestamp(F.lit(f"{trade_date} {open_at}").cast("timestamp"), zone)
    at = F.unix_micros(opened) * 1000
    lo = at + start_minute * 60_000_000_000
    return df.filter((F.col("ts_event") >= lo) & (F.col("ts_event") < lo + minutes * 60_000_000_000))


def session_label(ts_ns: Column | str = "ts_event") -> Column:
    """asia, london, new_york or overnight by UTC hour; London is tested before New York."""
    c = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    hour = F.hour(F.timestamp_micros(F.floor(c / F.lit(1000)).cast("long")))
    return (
        F.when(hour < 8, "asia").when(hour < 16, "london").when(hour < 21, "new_york").otherwise("overnight")
    )


def session_labels(ts_ns: Column | str = "ts_event") -> Column:
    """All sessions an hour belongs to (London and New York overlap from 13)."""
    c = F.col(ts_ns) if isinstance(ts_ns, str) else ts_ns
    hour = F.hour(F.timestamp_micros(F.floor(c / F.lit(1000)).cast("long")))
    found = F.array_compact(
        F.array(
            F.when(hour < 8, F.lit("asia")),
            F.when((hour >= 8) & (hour < 16), F.lit("london")),
            F.when((hour >= 13) & (hour < 21), F.lit("new_york")),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("overnight"))).otherwise(found)
