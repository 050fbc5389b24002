"""Event statistics, data quality reports, conformance and feature checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.canonical import ACTIONS, MBO_RECORD_TYPE, SIDES, UNDEF_PRICE
from tickloom.order import EventOrder


def event_statistics(df: DataFrame) -> DataFrame:
    """One row per instrument: counts, clock range, price range, size moments."""
    return df.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("ts_event").alias("first_ts"),
        F.max("ts_event").alias("last_ts"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.avg("size").alias("mean_size"),
        F.stddev_samp("size").alias("std_size"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.sum("size").alias("volume"),
    )


def distribution(df: DataFrame, *by: str) -> DataFrame:
    """Counts and shares of code combinations (combined before the shuffle)."""
    from pyspark.sql import Window

    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("volume"))
    return counts.withColumn("share", F.col("events") / F.sum("events").over(Window.partitionBy(F.lit(1))))


def dataset_summary(df: DataFrame, order: EventOrder) -> DataFrame:
    """Totals with code sets, distinct counts and the number of sequence gaps."""
    gaps = sequence_gaps(df, order).agg(F.count(F.lit(1)).alias("sequence_gaps"))
    codes = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    totals = df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("instrument").alias("instruments"),
        F.min("ts_event").alias("first_ts"),
        F.max("ts_event").alias("last_ts"),
        ((F.max("ts_event") - F.min("ts_event")) / F.lit(1e9)).alias("seconds"),
        codes("action").alias("actions"),
        codes("side").alias("sides"),
        F.avg("price").alias("mean_price"),
        F.sum("size").alias("volume"),
        F.count_if(F.col("flags").bitwiseAND(F.lit(128)) != 0).alias("last_flagged"),
    )
    return totals.crossJoin(F.broadcast(gaps))  # one row by one row


def sequence_gaps(df: DataFrame, order: EventOrder) -> DataFrame:
    """Rows whose sequence does not follow its predecessor, with the gap width."""
    from tickloom.order import windowed

    def body(d: DataFrame, f) -> DataFrame:
        return d.withColumn("prev_sequence", F.lag("sequence").over(f.ordered()))

    out = windowed(df, order, body, before=1)
    return out.filter(F.col("prev_sequence") + 1 != F.col("sequence")).withColumn(
        "gap", F.col("sequence") - F.col("prev_sequence") - 1
    )


def _long(row: DataFrame, names: dict[str, str]) -> DataFrame:
    """One wide row to (check, key, value) rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(check).alias("check"), F.lit(key).alias("key"), F.col(f"`{check}|{key}`").cast("double").alias("value"))
            for (check, key) in names
        ]
    )
    return row.select(F.explode(pairs).alias("r")).select("r.*")


def quality_report(df: DataFrame, top_symbols: int = 10) -> DataFrame:
    """(check, key, value): nulls, valid clocks and prices, code counts, top symbols."""
    checks: dict[tuple[str, str], Column] = {("rows", "total"): F.count(F.lit(1))}
    for c in ("ts_event", "price", "size", "side", "action", "order_id"):
        checks[("nulls", c)] = F.count_if(F.col(c).isNull())
    checks[("clock", "valid")] = F.count_if(F.col("ts_event") > 0)
    checks[("clock", "invalid")] = F.count_if(~(F.col("ts_event") > 0) | F.col("ts_event").isNull())
    bad_price = ~(F.col("price") > 0) | F.col("price").isNull() | (F.col("price") == float(UNDEF_PRICE))
    checks[("price", "valid")] = F.count_if(~bad_price)
    checks[("price", "invalid")] = F.count_if(bad_price)
    for a in ACTIONS:
        checks[("action", a)] = F.count_if(F.col("action") == a)
    for s in SIDES:
        checks[("side", s)] = F.count_if(F.col("side") == s)
    checks[("action", "invalid")] = F.count_if(~F.col("action").isin(*ACTIONS))
    checks[("side", "invalid")] = F.count_if(~F.col("side").isin(*SIDES))
    wide = df.agg(*[c.alias(f"{k[0]}|{k[1]}") for k, c in checks.items()])
    top = (
        df.groupBy(F.col("instrument").alias("key"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .orderBy(F.desc("value"), "key")
        .limit(top_symbols)
        .select(F.lit("symbol").alias("check"), "key", "value")
    )
    return _long(wide, checks).unionByName(top)


def conformance(df: DataFrame, required: list[str], allowed: dict[str, list] | None = None) -> DataFrame:
    """(check, key, value): presence of columns, record type, code sets, allowed values."""
    have = set(df.columns)
    checks: dict[tuple[str, str], Column] = {}
    for c in required:
        checks[("has", c)] = F.max(F.lit(1.0 if c in have else 0.0))
    if "rtype" in have:
        checks[("rtype", "wrong")] = F.count_if(F.col("rtype") != MBO_RECORD_TYPE)
    for c, values in {"action": list(ACTIONS), "side": list(SIDES), **(allowed or {})}.items():
        if c in have:
            checks[("outside", c)] = F.count_if(~F.col(c).isin(*values))
    checks[("range", "first_ts")] = F.min("ts_event")
    checks[("range", "last_ts")] = F.max("ts_event")
    return _long(df.agg(*[c.alias(f"{k[0]}|{k[1]}") for k, c in checks.items()]), checks)


def processed_check(df: DataFrame, expected: list[str]) -> DataFrame:
    """(column, status, filled): missing, extra and all-null columns of a stored table."""
    have, want = set(df.columns), set(expected)
    names = sorted(have | want)
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_c_{c}") for c in df.columns])
    rows = []
    for c in names:
        filled = F.col(f"`_c_{c}`") if c in have else F.lit(0)
        if c not in have:
            status = F.lit("missing")
        else:
            base = "extra" if c not in want else "ok"
            status = F.when((filled == 0) & (F.col("_n") > 0), "all_null").otherwise(base)
        rows.append(F.struct(F.lit(c).alias("column"), status.alias("status"), filled.cast("long").alias("filled")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_quality(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per feature: nulls, infinities and whether it is constant, in one pass."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count_if(x.isNull() | F.isnan(x)).alias(f"{c}|nulls"),
            F.count_if(F.abs(x) == float("inf")).alias(f"{c}|infs"),
            F.coalesce(F.min(x) == F.max(x), F.lit(True)).alias(f"{c}|constant"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"`{c}|nulls`").alias("nulls"),
            F.col(f"`{c}|infs`").alias("infs"),
            F.col(f"`{c}|constant`").alias("constant"),
        )
        for c in cols
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def correlated_groups(df: DataFrame, cols: list[str], limit: float = 0.95) -> list[list[str]]:
    """Greedy groups of columns whose |corr| reaches ``limit`` (k by k on the driver)."""
    strong = {(r["left"], r["right"]) for r in correlation_pairs(df, cols).collect() if r["corr"] and abs(r["corr"]) >= limit}
    linked = lambda a, b: (a, b) in strong or (b, a) in strong
    groups, used = [], set()
    for c in cols:
        if c in used:
            continue
        mates = [d for d in cols if d != c and d not in used and linked(c, d)]
        if mates:
            groups.append([c, *mates])
            used.update([c, *mates])
    return groups


def ranked_by_target(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Features ordered by |corr| with the target, computed in one aggregate."""
    wide = df.agg(*[F.abs(F.corr(c, target)).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("abs_corr")) for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").orderBy(F.desc_nulls_last("abs_corr"), "feature")


def compare_tables(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: rows, columns and volume of raw against processed data."""
    a = raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.sum("size").alias("raw_volume"))
    b = processed.agg(F.count(F.lit(1)).alias("processed_rows"), F.sum("size").alias("processed_volume"))
    return a.crossJoin(F.broadcast(b)).withColumns(
        {
            "raw_columns": F.lit(len(raw.columns)),
            "processed_columns": F.lit(len(processed.columns)),
            "kept_share": F.col("processed_rows") / F.col("raw_rows"),
        }
    )
