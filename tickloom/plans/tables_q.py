"""Sources, sinks, inventory, joins, sorts and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import joins, quantiles
from tickloom.order import EventOrder, number_rows
from tickloom.plans.binding import MBO_SQL, W, mbo, mbo_order, table
from tickloom.plans.registry import query
from tickloom.session import scratch_path
from tickloom.sources import events as src
from tickloom.sources import inventory as inv


@query(
    "parquet_scan_columns",
    "l_orderkey l_linenumber",
    "l_quantity",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
)
def parquet_scan_columns(spark, sf):
    return src.read_events(spark, f"{sf}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_quantity"])


@query(
    "parquet_sink_partitioned",
    "trade_date action events volume",
    "",
    f"WITH {MBO_SQL} SELECT trade_date, action, count(*) AS events, CAST(sum(size) AS BIGINT) AS volume FROM mbo GROUP BY 1, 2",
)
def parquet_sink_partitioned(spark, sf):
    path = scratch_path(spark, "mbo")
    src.write_events(mbo(spark, sf).repartitionByRange("trade_date", "sequence"), path, by=["trade_date"])
    stored = spark.read.parquet(path)
    return stored.groupBy("trade_date", "action").agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("volume"))


@query(
    "csv_json_round_trip",
    "fmt instrument events volume",
    "price_sum",
    f"""WITH {MBO_SQL} SELECT f AS fmt, instrument, count(*) AS events, CAST(sum(size) AS BIGINT) AS volume, sum(price) AS price_sum
      FROM mbo, (VALUES ('csv'), ('json')) AS v(f) GROUP BY 1, 2""",
)
def csv_json_round_trip(spark, sf):
    m = mbo(spark, sf).select([f.name for f in src.MBO_SCHEMA.fields])
    parts = []
    for fmt in ("csv", "json"):
        path = scratch_path(spark, fmt)
        src.write_events(m, path, fmt=fmt)
        parts.append(src.read_events(spark, path, fmt=fmt).withColumn("fmt", F.lit(fmt)))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("fmt", "instrument").agg(
        F.count(F.lit(1)).alias("events"), F.sum("size").alias("volume"), F.sum("price").alias("price_sum")
    )


@query(
    "date_range_load",
    "sequence trade_date",
    "",
    f"WITH {MBO_SQL} SELECT sequence, trade_date FROM mbo WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'",
)
def date_range_load(spark, sf):
    return src.date_range(mbo(spark, sf), "2024-01-05", "2024-01-09")


@query(
    "source_date_tag",
    "source_date events off_date",
    "",
    "SELECT CAST(ts AS DATE) AS source_date, count(*) AS events, 0 AS off_date FROM events GROUP BY 1",
)
def source_date_tag(spark, sf):
    """One folder a day, the day in its name; rows have to get the day of their own clock."""
    path = scratch_path(spark, "dated")
    day = F.date_format("ts", "yyyyMMdd").alias("day")
    table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("own"), day).write.partitionBy("day").parquet(path)
    tagged = src.with_source_date(spark.read.parquet(path), r"day=(\d{8})", "file_path")
    off = F.count_if(F.col("source_date") != F.col("own"))
    return tagged.groupBy("source_date").agg(F.count(F.lit(1)).alias("events"), off.cast("int").alias("off_date"))


@query(
    "first_events_sample",
    "sequence ts_event",
    "",
    f"WITH {MBO_SQL} SELECT sequence, ts_event FROM mbo ORDER BY ts_event, sequence LIMIT 500",
)
def first_events_sample(spark, sf):
    return src.first_events(mbo(spark, sf), 500)


@query(
    "tick_range_pushdown",
    "sequence",
    "price",
    f"""WITH {MBO_SQL} SELECT sequence, price FROM mbo WHERE ts >= TIMESTAMP '2024-01-03 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'""",
)
def tick_range_pushdown(spark, sf):
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-03 06:00:00", "2024-01-12 18:00:00"))
    return mbo(spark, sf, (F.col("ts") >= lo) & (F.col("ts") < hi))


@query(
    "materialise_schema",
    "trade_date events volume",
    "",
    f"WITH {MBO_SQL} SELECT trade_date, count(*) AS events, CAST(sum(size) AS BIGINT) AS volume FROM mbo GROUP BY 1",
)
def materialise_schema(spark, sf):
    path = scratch_path(spark, "features")
    m = mbo(spark, sf)
    keep = ["ts_event", "sequence", "instrument", "action", "size", "price", "trade_date"]
    src.materialise(spark, src.date_range(m, "2024-01-01", "2024-01-15"), path, "basic", lambda d: d.select(*keep))
    # the second run stores only the dates that are not there yet
    stored = src.materialise(spark, m, path, "basic", lambda d: d.select(*keep))
    return stored.groupBy("trade_date").agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("volume"))


@query(
    "union_of_dates",
    "sequence note",
    "",
    f"""WITH {MBO_SQL} SELECT sequence, 'fill' AS note FROM mbo WHERE action = 'F' UNION ALL SELECT sequence, NULL FROM mbo WHERE action = 'C'""",
)
def union_of_dates(spark, sf):
    m = mbo(spark, sf).select("sequence", "action")
    fills = m.filter("action = 'F'").withColumn("note", F.lit("fill"))
    return src.union_dates([fills, m.filter("action = 'C'")])


@query(
    "lineage_columns",
    "source_name schema_version source_file events",
    "",
    "SELECT 'exchange' AS source_name, '1.0.0' AS schema_version, 'events.parquet' AS source_file, count(*) AS events FROM events",
)
def lineage_columns(spark, sf):
    d = src.with_lineage(table(spark, sf, "events"), "exchange")
    return d.groupBy("source_name", "schema_version", "source_file").agg(F.count(F.lit(1)).alias("events"))


@query(
    "save_named_tables",
    "name n",
    "",
    "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part",
)
def save_named_tables(spark, sf):
    paths = src.save_tables({n: table(spark, sf, n) for n in ("orders", "part")}, scratch_path(spark, "tables"))
    parts = [spark.read.parquet(p).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("file_inventory", "file_name dataset is_compressed hash_length", "")
def file_inventory(spark, sf):
    files = inv.with_hashes(inv.list_files(spark, sf))
    return files.withColumn("hash_length", F.length("file_hash"))


@query("duplicate_files", "file_name is_duplicate duplicate_of", "")
def duplicate_files(spark, sf):
    """Folder scan over the supplied files plus two copies of one of them."""
    path = scratch_path(spark, "copies")
    for i in range(2):
        table(spark, sf, "nation").coalesce(1).write.parquet(f"{path}/{i}")
    files = inv.list_files(spark, path).filter("file_name like '%parquet'")
    return inv.duplicates(files.unionByName(inv.list_files(spark, sf)))


@query(
    "duplicate_content_rows",
    "doc_id is_duplicate duplicate_of",
    "",
    """WITH d AS (SELECT doc_id, sha256(text) AS h, n_chars FROM documents),
    k AS (SELECT h, arg_min(doc_id, (-n_chars, doc_id)) AS keep, count(*) AS n FROM d GROUP BY 1)
    SELECT doc_id, doc_id <> keep AS is_duplicate, CASE WHEN doc_id <> keep THEN keep END AS duplicate_of FROM d JOIN k USING (h) WHERE n > 1""",
)
def duplicate_content_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "n_chars")
    return inv.mark_duplicates(d, "h", "n_chars", "doc_id")


@query(
    "inventory_rollup",
    "dataset schema level files bytes smallest largest",
    "",
    """SELECT lang AS dataset, source AS schema, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS files,
      CAST(sum(n_chars) AS BIGINT) AS bytes, min(n_chars) AS smallest, max(n_chars) AS largest
    FROM documents GROUP BY ROLLUP (lang, source)""",
)
def inventory_rollup(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("dataset"), F.col("source").alias("schema"), "n_chars")
    return inv.rollup(d, ["dataset", "schema"], "n_chars")


@query("available_dates", "trade_date", "", f"WITH {MBO_SQL} SELECT DISTINCT trade_date FROM mbo")
def available_dates(spark, sf):
    return inv.available_dates(mbo(spark, sf))


@query(
    "catalogue_summary",
    "instrument dates first_date last_date events",
    "",
    f"""WITH {MBO_SQL} SELECT instrument, count(DISTINCT trade_date) AS dates, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS events FROM mbo GROUP BY 1""",
)
def catalogue_summary(spark, sf):
    return inv.catalogue(mbo(spark, sf), ["instrument"])


@query(
    "dates_in_file_names",
    "date",
    "",
    "SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS date FROM orders",
)
def dates_in_file_names(spark, sf):
    o = table(spark, sf, "orders")
    names = o.select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_orders_basic.parquet")).alias("file_name"))
    return inv.dates_in_names(names)


# ---------------------------------------------------------------- joins


@query(
    "level_volume_join",
    "sequence level_volume",
    "",
    f"""WITH {MBO_SQL}, t AS (SELECT instrument, price, CAST(sum(size) AS BIGINT) AS level_volume FROM mbo GROUP BY 1, 2)
    SELECT sequence, level_volume FROM mbo JOIN t USING (instrument, price)""",
)
def level_volume_join(spark, sf):
    return joins.level_totals(mbo(spark, sf), "price", "size", "level_volume", ["instrument"])


@query(
    "price_bin_volume_join",
    "sequence bin bin_volume",
    "",
    f"""WITH {MBO_SQL}, r AS (SELECT instrument, min(price) lo, max(price) hi FROM mbo GROUP BY 1),
    b AS (SELECT sequence, m.instrument, size, CAST(least(greatest(ceil((price - lo) / ((hi - lo) / 50.0)) - 1, 0), 49) AS INTEGER) AS bin FROM mbo m JOIN r USING (instrument))
    SELECT sequence, bin, CAST(sum(size) OVER (PARTITION BY instrument, bin) AS BIGINT) AS bin_volume FROM b""",
)
def price_bin_volume_join(spark, sf):
    b = quantiles.equal_width_bins(mbo(spark, sf), "price", "bin", 50, ["instrument"])
    return joins.level_totals(b, "bin", "size", "bin_volume", ["instrument"])


@query(
    "features_targets_join",
    "instrument sequence",
    "price target",
    f"""WITH {MBO_SQL} SELECT f.instrument, f.sequence, f.price, t.value AS target FROM (SELECT * FROM mbo WHERE action <> 'C') f
      JOIN (SELECT * FROM mbo WHERE side <> 'N') t USING (instrument, sequence)""",
)
def features_targets_join(spark, sf):
    m = mbo(spark, sf)
    f = m.filter("action <> 'C'").select("instrument", "sequence", "price")
    t = m.filter("side <> 'N'").select("instrument", "sequence", F.col("value").alias("target"))
    return joins.features_with_targets(f, t, ["instrument", "sequence"])


@query(
    "ticks_predictions_join",
    "instrument sequence prediction",
    "price",
    f"WITH {MBO_SQL} SELECT instrument, sequence, price, CAST(value > 30 AS INTEGER) AS prediction FROM mbo",
)
def ticks_predictions_join(spark, sf):
    m = mbo(spark, sf)
    key = ["instrument", "ts_event", "sequence"]
    p = m.select(*key, (F.col("value") > 30).cast("int").alias("prediction"))
    return joins.by_position(m.select(*key, "price"), p, mbo_order(m))


@query(
    "semi_join_split",
    "sequence",
    "",
    f"WITH {MBO_SQL} SELECT sequence FROM mbo WHERE trade_date IN (SELECT trade_date FROM mbo GROUP BY 1 HAVING count(*) > (SELECT count(*) / count(DISTINCT trade_date) FROM mbo))",
)
def semi_join_split(spark, sf):
    m = mbo(spark, sf)
    per = m.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    busy = per.join(F.broadcast(per.agg(F.avg("n").alias("a"))), F.col("n") > F.col("a"))
    return joins.semi_by_split(m, busy, ["trade_date"])


@query(
    "anti_join_unprocessed",
    "sequence trade_date",
    "",
    f"WITH {MBO_SQL} SELECT sequence, trade_date FROM mbo WHERE trade_date NOT IN (SELECT trade_date FROM mbo WHERE action = 'R')",
)
def anti_join_unprocessed(spark, sf):
    m = mbo(spark, sf)
    return joins.anti_processed(m, m.filter("action = 'R'"), ["trade_date"])


LIFECYCLE_SQL = """life AS (SELECT instrument, order_id, min(ts_event) FILTER (action = 'A') AS added_ts,
      arg_min(price, (ts_event, sequence)) FILTER (action = 'A') AS added_price, arg_min(size, (ts_event, sequence)) FILTER (action = 'A') AS added_size,
      arg_min(side, (ts_event, sequence)) FILTER (action = 'A') AS side, count(*) FILTER (action = 'M') AS modifications,
      count(*) FILTER (action = 'F') AS fills, CAST(coalesce(sum(size) FILTER (action = 'F'), 0) AS BIGINT) AS filled_size,
      max(ts_event) FILTER (action = 'C') AS cancelled_ts, max(ts_event) - min(ts_event) AS lifetime_ns, count(*) AS events
    FROM mbo GROUP BY 1, 2)"""


@query(
    "order_lifecycle",
    "instrument order_id added_ts added_size side modifications fills filled_size cancelled_ts lifetime_ns events",
    "added_price fill_ratio",
    f"WITH {MBO_SQL}, {LIFECYCLE_SQL} SELECT *, filled_size / added_size AS fill_ratio FROM life",
)
def order_lifecycle(spark, sf):
    return joins.order_lifecycle(mbo(spark, sf))


@query(
    "asof_last_price",
    "instrument sequence fill_sequence",
    "fill_price",
    f"""WITH {MBO_SQL}, f AS (SELECT instrument, ts_event, price AS fill_price, sequence AS fill_sequence FROM mbo WHERE action = 'F'),
    o AS (SELECT instrument, sequence, ts_event + 250000000 AS at FROM mbo WHERE action = 'A')
    SELECT o.instrument, o.sequence, fill_sequence, fill_price FROM o ASOF LEFT JOIN f ON o.instrument = f.instrument AND o.at >= f.ts_event""",
)
def asof_last_price(spark, sf):
    """The last fill known 250 ms after each added order."""
    m = mbo(spark, sf)
    o = mbo_order(m)
    left = m.filter("action = 'A'").select("instrument", "sequence", (F.col("ts_event") + 250_000_000).alias("ts_event"))
    right = m.filter("action = 'F'").select(
        "instrument", "ts_event", "sequence", F.col("price").alias("fill_price"), F.col("sequence").alias("fill_sequence")
    )
    return joins.asof_last(left, right, ["fill_price", "fill_sequence"], o)


# ---------------------------------------------------------------- sorts and sets


@query(
    "sorted_row_numbers",
    "instrument sequence rn",
    "",
    f"WITH {MBO_SQL} SELECT instrument, sequence, row_number() OVER ({W}) AS rn FROM mbo",
)
def sorted_row_numbers(spark, sf):
    m = mbo(spark, sf)
    return number_rows(m, mbo_order(m), "rn")


@query(
    "sorted_row_numbers_cells",
    "instrument sequence rn",
    "",
    f"WITH {MBO_SQL} SELECT instrument, sequence, row_number() OVER ({W}) AS rn FROM mbo",
)
def sorted_row_numbers_cells(spark, sf):
    """The same numbers through the form used for keys too large for a task."""
    return number_rows(mbo(spark, sf), EventOrder(hot=True), "rn")


@query(
    "newest_orders_topk",
    "o_orderkey",
    "o_totalprice",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def newest_orders_topk(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "oldest_open_order",
    "o_orderpriority o_orderkey",
    "",
    """SELECT o_orderpriority, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""",
)
def oldest_open_order(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'O'")
    return o.groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query(
    "top_and_bottom_fifth",
    "p_brand band",
    "score",
    """WITH s AS (SELECT p_brand, avg(p_retailprice) AS score FROM part GROUP BY 1),
    r AS (SELECT *, percent_rank() OVER (ORDER BY score) AS pr FROM s)
    SELECT p_brand, score, CASE WHEN pr >= 0.8 THEN 'top' WHEN pr <= 0.2 THEN 'bottom' ELSE 'middle' END AS band FROM r""",
)
def top_and_bottom_fifth(spark, sf):
    s = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("score"))
    pr = F.percent_rank().over(Window.orderBy("score"))  # one row per brand
    s = s.withColumn("pr", pr)
    return s.withColumn("band", F.when(F.col("pr") >= 0.8, "top").when(F.col("pr") <= 0.2, "bottom").otherwise("middle"))


@query(
    "distinct_dates_union",
    "d",
    "",
    "SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem",
)
def distinct_dates_union(spark, sf):
    a = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    b = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return a.distinct().union(b.distinct()).distinct()


@query(
    "set_difference_parts",
    "p_partkey",
    "",
    "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
)
def set_difference_parts(spark, sf):
    used = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").distinct().join(used, "p_partkey", "left_anti")


@query(
    "key_intersection",
    "k",
    "",
    "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'",
)
def key_intersection(spark, sf):
    a = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return a.intersect(b)


@query(
    "leaderboard",
    "strategy rank trades",
    "total_return",
    """WITH s AS (SELECT o_orderpriority AS strategy, count(*) AS trades, avg(o_totalprice) AS total_return FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT *, CAST(rank() OVER (ORDER BY total_return DESC) AS INTEGER) AS rank FROM s""",
)
def leaderboard(spark, sf):
    s = (
        table(spark, sf, "orders")
        .filter("o_orderstatus <> 'P'")
        .groupBy(F.col("o_orderpriority").alias("strategy"))
        .agg(F.count(F.lit(1)).alias("trades"), F.avg("o_totalprice").alias("total_return"))
    )
    return quantiles.ranked(s, [], [F.desc("total_return")])


@query(
    "leaderboard_grouping_sets",
    "priority status level trades",
    "mean_value best worst",
    """SELECT o_orderpriority AS priority, o_orderstatus AS status, CAST(grouping(o_orderpriority, o_orderstatus) AS BIGINT) AS level,
      count(*) AS trades, avg(o_totalprice) AS mean_value, max(o_totalprice) AS best, min(o_totalprice) AS worst
    FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""",
)
def leaderboard_grouping_sets(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_totalprice"
    )
    p, s = F.col("priority"), F.col("status")
    return o.groupingSets([[p], [s], []], p, s).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("trades"),
        F.avg("o_totalprice").alias("mean_value"),
        F.max("o_totalprice").alias("best"),
        F.min("o_totalprice").alias("worst"),
    )


@query(
    "registry_statistics_cube",
    "kind status level runs",
    "mean_score total",
    """SELECT o_orderpriority AS kind, o_orderstatus AS status, CAST(grouping(o_orderpriority, o_orderstatus) AS BIGINT) AS level, count(*) AS runs,
      avg(o_totalprice) AS mean_score, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100 AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""",
    digits=2,
)
def registry_statistics_cube(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), "o_totalprice"
    )
    return o.cube("kind", "status").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("runs"),
        F.avg("o_totalprice").alias("mean_score"),
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100).alias("total"),
    )
