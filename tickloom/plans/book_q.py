"""Order book and detector queries."""

from pyspark.sql import functions as F

from tickloom.operators import bars, book, detectors as det
from tickloom.operators import horizons as hz
from tickloom.order import EventOrder
from tickloom.plans.binding import MBO_SQL, TICK, W, mbo, mbo_order, rows, span, strict, trailing
from tickloom.plans.registry import query

_L = "PARTITION BY instrument, epoch, level_side, price ORDER BY ts_event, sequence"


def book_sql(fills: str = "own") -> str:
    side = {"own": "side", "none": "side", "opposite": "CASE WHEN action = 'F' THEN CASE side WHEN 'B' THEN 'A' WHEN 'A' THEN 'B' ELSE side END ELSE side END"}[fills]
    cut = "('C')" if fills == "none" else "('C', 'F')"
    up, prev = span(None, 0, _L), span(None, -1, _L)
    return f"""ep AS (SELECT *, count(*) FILTER (action = 'R') OVER {span(None, 0)} AS epoch, row_number() OVER ({W}) AS rn FROM mbo),
    lv0 AS (SELECT *, {side} AS level_side, CASE WHEN side NOT IN ('A', 'B') THEN 0 WHEN action = 'A' THEN size WHEN action IN {cut} THEN -size ELSE 0 END AS dl FROM ep),
    lv1 AS (SELECT *, CAST(sum(dl) OVER {up} AS BIGINT) AS s FROM lv0),
    lv AS (SELECT *, s - least(min(s) OVER {up}, 0) AS level_size, s - dl - least(coalesce(min(s) OVER {prev}, 0), 0) AS level_size_before FROM lv1)"""


AT_SQL = f"""ends AS (SELECT instrument, epoch, max(rn) + 1 AS stop FROM ep GROUP BY ALL),
    iv AS (SELECT instrument, level_side, price, level_size AS q, rn AS a, coalesce(lead(rn) OVER ({_L}), stop) AS b FROM lv JOIN ends USING (instrument, epoch) WHERE level_side IN ('A', 'B')),
    at0 AS (SELECT e.instrument, e.sequence, max(iv.price) FILTER (level_side = 'B') AS best_bid, min(iv.price) FILTER (level_side = 'A') AS best_ask,
      arg_max(q, iv.price) FILTER (level_side = 'B') AS bid_size, arg_min(q, iv.price) FILTER (level_side = 'A') AS ask_size,
      coalesce(sum(q) FILTER (level_side = 'B'), 0) AS bid_total, coalesce(sum(q) FILTER (level_side = 'A'), 0) AS ask_total,
      coalesce((list(iv.price ORDER BY iv.price DESC) FILTER (level_side = 'B'))[1:10], []) AS bp, coalesce((list(q ORDER BY iv.price DESC) FILTER (level_side = 'B'))[1:10], []) AS bq,
      coalesce((list(iv.price ORDER BY iv.price) FILTER (level_side = 'A'))[1:10], []) AS ap, coalesce((list(q ORDER BY iv.price) FILTER (level_side = 'A'))[1:10], []) AS aq
      FROM ep e LEFT JOIN iv ON e.instrument = iv.instrument AND e.rn >= iv.a AND e.rn < iv.b AND q > 0 GROUP BY 1, 2),
    bk AS (SELECT m.*, at0.* EXCLUDE (instrument, sequence), best_ask - best_bid AS spread, (best_ask + best_bid) / 2 AS mid FROM mbo m JOIN at0 ON m.instrument = at0.instrument AND m.sequence = at0.sequence)"""
ALL_SQL = f"{MBO_SQL}, {book_sql()}, {AT_SQL}"


def the_book(spark, sf, depth: int = 10, fills: str = "own"):
    m = mbo(spark, sf)
    o = mbo_order(m)
    return book.book_at_events(book.level_book(m, o, fills), o, depth), o


for _fills in ("own", "opposite", "none"):

    def _plan(spark, sf, fills=_fills):
        m = mbo(spark, sf)
        return book.level_book(m, mbo_order(m), fills)

    query(
        "book_levels_clamped" if _fills == "own" else f"book_levels_fills_{_fills}",
        "instrument sequence book_epoch level_side level_size level_size_before",
        "",
        f"WITH {MBO_SQL}, {book_sql(_fills)} SELECT *, epoch AS book_epoch FROM lv",
    )(_plan)


@query("order_level_book", "instrument sequence part level_side level_size", "price")
def order_level_book(spark, sf):
    m = mbo(spark, sf)
    return book.order_book(m, mbo_order(m))


@query("order_level_book_quotes", "instrument sequence", "best_bid best_ask")
def order_level_book_quotes(spark, sf):
    m = mbo(spark, sf)
    o = mbo_order(m)
    return book.book_at_events(book.order_book(m, o), o, 0)


@query(
    "book_quotes_at_events",
    "instrument sequence",
    "best_bid best_ask bid_size ask_size bid_total ask_total spread mid",
    f"WITH {ALL_SQL} SELECT * FROM bk",
)
def book_quotes_at_events(spark, sf):
    return the_book(spark, sf, 0)[0]


@query(
    "book_quotes_at_events_cells",
    "instrument sequence",
    "best_bid best_ask bid_size ask_size bid_total ask_total",
    f"WITH {ALL_SQL} SELECT * FROM bk",
)
def book_quotes_at_events_cells(spark, sf):
    """The same quotes with every instrument split into cells opened at their live levels."""
    o = EventOrder(hot=True, cell_rows=400)
    return book.book_at_events(book.level_book(mbo(spark, sf), o), o, 0)


@query(
    "book_topk_asof",
    "instrument level_side level level_size",
    "price",
    f"""WITH {MBO_SQL}, {book_sql()}, cut AS (SELECT * FROM lv WHERE ts_event <= epoch_us(TIMESTAMP '2024-01-16 12:00:00') * 1000),
    st AS (SELECT instrument, epoch, level_side, price, arg_max(level_size, rn) AS level_size FROM cut WHERE level_side IN ('A', 'B') GROUP BY ALL),
    nw AS (SELECT instrument, max(epoch) AS epoch FROM cut GROUP BY 1)
    SELECT st.*, CAST(row_number() OVER (PARTITION BY instrument, level_side ORDER BY CASE WHEN level_side = 'B' THEN -price ELSE price END) AS INTEGER) AS level
    FROM st JOIN nw USING (instrument, epoch) WHERE level_size > 0 QUALIFY level <= 10""",
)
def book_topk_asof(spark, sf):
    m = mbo(spark, sf)
    at = 1_705_406_400_000_000_000
    return book.book_as_of(m, mbo_order(m), at, 10)


def _sl(a: str, k: int) -> str:
    return f"coalesce(list_sum({a}[1:{k}]), 0)"


@query(
    "book_depth_features",
    "instrument sequence large_bid_levels large_ask_levels",
    "spread_bps total_bid_size total_ask_size imbalance_ratio depth_imbalance_1 depth_imbalance_3 depth_imbalance_5 depth_imbalance_10",
    f"""WITH {ALL_SQL} SELECT *, CASE WHEN mid > 0 THEN spread / mid * 10000 END AS spread_bps, CASE WHEN two THEN tb END AS total_bid_size, CASE WHEN two THEN ta END AS total_ask_size,
      CASE WHEN two THEN (tb - ta) / (tb + ta) END AS imbalance_ratio, CASE WHEN two THEN CAST(len([x for x in bq if x >= 100]) AS INTEGER) END AS large_bid_levels,
      CASE WHEN two THEN CAST(len([x for x in aq if x >= 100]) AS INTEGER) END AS large_ask_levels, {', '.join(f"CASE WHEN len(bq) >= {k} AND len(aq) >= {k} THEN ({_sl('bq', k)} - {_sl('aq', k)}) / ({_sl('bq', k)} + {_sl('aq', k)}) END AS depth_imbalance_{k}" for k in (1, 3, 5, 10))}
    FROM (SELECT *, len(bq) > 0 AND len(aq) > 0 AS two, {_sl('bq', 10)} AS tb, {_sl('aq', 10)} AS ta FROM bk)""",
)
def book_depth_features(spark, sf):
    return book.depth_features(the_book(spark, sf)[0])


@query(
    "book_side_summary",
    "instrument sequence bid_levels ask_levels",
    "bid_total_size bid_first_share bid_price_span bid_weighted_price ask_total_size ask_first_share ask_price_span ask_weighted_price",
    f"""WITH {ALL_SQL} SELECT instrument, sequence, {', '.join(
        f"CAST(len({q}) AS INTEGER) AS {s}_levels, {_sl(q, 10)} AS {s}_total_size, coalesce({q}[1] / list_sum({q}), 0) AS {s}_first_share, coalesce(abs({p}[1] - {p}[-1]), 0) AS {s}_price_span, coalesce(list_sum([{p}[i] * {q}[i] for i in range(1, len({q}) + 1)]) / list_sum({q}), 0) AS {s}_weighted_price"
        for s, p, q in (("bid", "bp", "bq"), ("ask", "ap", "aq")))} FROM bk""",
)
def book_side_summary(spark, sf):
    return book.side_summary(the_book(spark, sf)[0])


@query(
    "book_localised",
    "instrument sequence bid_near_levels ask_near_levels",
    "bid_near_volume ask_near_volume bid_far_volume ask_far_volume",
    f"""WITH {ALL_SQL.replace("[1:10]", "")}, n AS (SELECT *, coalesce(list_sum([bq[i] for i in range(1, len(bq) + 1) if abs(bp[i] - price) <= 2]), 0) AS bn, coalesce(list_sum([aq[i] for i in range(1, len(aq) + 1) if abs(ap[i] - price) <= 2]), 0) AS an FROM bk)
    SELECT instrument, sequence, CAST(len([x for x in bp if abs(x - price) <= 2]) AS INTEGER) AS bid_near_levels, CAST(len([x for x in ap if abs(x - price) <= 2]) AS INTEGER) AS ask_near_levels,
      bn AS bid_near_volume, an AS ask_near_volume, bid_total - bn AS bid_far_volume, ask_total - an AS ask_far_volume FROM n""",
)
def book_localised(spark, sf):
    m = mbo(spark, sf)
    o = mbo_order(m)
    return book.localised(book.level_book(m, o), o, F.col("price"), 2.0)


_WIDE = [f"{s}_{c}_{i}" for s in ("bid", "ask") for c in ("price", "size") for i in range(1, 6)]


@query(
    "book_wide_levels",
    "instrument sequence",
    " ".join(_WIDE),
    f"""WITH {ALL_SQL} SELECT instrument, sequence, {', '.join(f"coalesce({s[0]}{'p' if c == 'price' else 'q'}[{i}], 0) AS {s}_{c}_{i}" for s in ('bid', 'ask') for c in ('price', 'size') for i in range(1, 6))} FROM bk""",
)
def book_wide_levels(spark, sf):
    return book.wide_levels(the_book(spark, sf)[0], 5)


@query(
    "book_wide_round_trip",
    "instrument sequence bids asks",
    "best_bid best_ask",
    f"WITH {ALL_SQL} SELECT instrument, sequence, CAST(least(len(bp), 5) AS INTEGER) AS bids, CAST(least(len(ap), 5) AS INTEGER) AS asks, bp[1] AS best_bid, ap[1] AS best_ask FROM bk",
)
def book_wide_round_trip(spark, sf):
    d = book.arrays_from_wide(book.wide_levels(the_book(spark, sf)[0], 5), 5)
    top = lambda c: F.get(c, F.lit(0))["price"]
    return d.select(
        "instrument", "sequence", F.size("bids").alias("bids"), F.size("asks").alias("asks"),
        top("bids").alias("best_bid"), top("asks").alias("best_ask"),
    )


@query(
    "book_snapshot_changes",
    "instrument sequence",
    "mid_change spread_change bid_total_change ask_total_change",
    f"WITH {ALL_SQL} SELECT instrument, sequence, {', '.join(f'{c} - lag({c}) OVER ({W}) AS {c}_change' for c in ('mid', 'spread', 'bid_total', 'ask_total'))} FROM bk",
)
def book_snapshot_changes(spark, sf):
    b, o = the_book(spark, sf, 0)
    return book.snapshot_changes(b, o)


@query(
    "book_normalised_depth",
    "instrument sequence",
    "depth_bid_1 depth_ask_2 depth_len ofi_norm",
    f"""WITH {ALL_SQL} SELECT instrument, sequence, ln(1 + coalesce(bq[1], 0)) AS depth_bid_1, ln(1 + coalesce(aq[2], 0)) AS depth_ask_2, 10 AS depth_len,
      CASE WHEN {_sl('bq', 10)} + {_sl('aq', 10)} > 0 THEN ({_sl('bq', 10)} - {_sl('aq', 10)}) / ({_sl('bq', 10)} + {_sl('aq', 10)}) ELSE 0 END AS ofi_norm FROM bk""",
)
def book_normalised_depth(spark, sf):
    d = book.normalised_depth(the_book(spark, sf)[0])
    return d.withColumns(
        {"depth_bid_1": F.get("depth_bid_norm", F.lit(0)), "depth_ask_2": F.get("depth_ask_norm", F.lit(1)), "depth_len": F.size("depth_bid_norm")}
    )


@query(
    "book_snapshot_vector",
    "instrument sequence n action_token side_token",
    "total image_total",
    f"""WITH {ALL_SQL} SELECT instrument, sequence, 40 AS n, CASE action WHEN 'A' THEN 0 WHEN 'M' THEN 1 WHEN 'C' THEN 2 WHEN 'R' THEN 3 WHEN 'F' THEN 4 END AS action_token,
      CASE side WHEN 'B' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS side_token, coalesce(list_sum(bp), 0) + {_sl('bq', 10)} + coalesce(list_sum(ap), 0) + {_sl('aq', 10)} AS total,
      CASE WHEN mid IS NULL THEN 0 ELSE list_sum([coalesce([aq[j] for j in range(1, len(aq) + 1) if trunc((ap[j] - mid) / {TICK}) + 10 = i][1], [bq[j] for j in range(1, len(bq) + 1) if trunc((bp[j] - mid) / {TICK}) + 10 = i][1], 0) * (i + 1) for i in range(0, 20)]) END AS image_total FROM bk""",
)
def book_snapshot_vector(spark, sf):
    b = the_book(spark, sf)[0].withColumns({"_t": book.event_tokens()})
    b = b.withColumns({"_v": book.queue_snapshot(), "_img": book.book_image(TICK)})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    weighted = F.transform("_img", lambda x, i: x * (i + 1))
    return b.withColumns(
        {"n": F.size("_v"), "action_token": F.get("_t", F.lit(0)), "side_token": F.get("_t", F.lit(1)), "total": total(F.col("_v")), "image_total": total(weighted)}
    )


@query(
    "cancel_modify_share",
    "instrument sequence",
    "cancel_modify_ratio",
    f"WITH {MBO_SQL} SELECT instrument, sequence, coalesce(count(*) FILTER (action IN ('M', 'C')) OVER {span(None, 0)} / nullif(count(*) FILTER (action IN ('A', 'M', 'C')) OVER {span(None, 0)}, 0), 0) AS cancel_modify_ratio FROM mbo",
)
def cancel_modify_share(spark, sf):
    m = mbo(spark, sf)
    return book.cancel_modify_share(m, mbo_order(m))


@query(
    "book_price_table",
    "instrument bid_size ask_size",
    "price",
    f"""WITH {MBO_SQL}, t AS (SELECT instrument, price, CAST(sum(CASE WHEN side = 'B' THEN size ELSE 0 END) AS BIGINT) AS bid_size, CAST(sum(CASE WHEN side = 'A' THEN size ELSE 0 END) AS BIGINT) AS ask_size FROM mbo GROUP BY 1, 2),
    r AS (SELECT *, count(*) OVER (PARTITION BY instrument) AS n, row_number() OVER (PARTITION BY instrument ORDER BY price) - 1 AS i FROM t)
    SELECT instrument, price, bid_size, ask_size FROM r WHERE i >= greatest(n // 2 - 10, 0) AND i < greatest(n // 2 - 10, 0) + 20""",
)
def book_price_table(spark, sf):
    return book.price_table(mbo(spark, sf), 20, ["instrument"])


@query(
    "walk_the_book_slippage",
    "instrument sequence",
    "unfilled fill_price slippage",
    f"""WITH {ALL_SQL}, w AS (SELECT instrument, sequence, ap, aq, 3 * size AS need, [0] || [list_sum(aq[1:i]) for i in range(1, len(aq) + 1)] AS cum FROM bk WHERE action = 'A'),
    t AS (SELECT *, [greatest(least(aq[i], need - cum[i]), 0) for i in range(1, len(aq) + 1)] AS take FROM w)
    SELECT instrument, sequence, need - coalesce(list_sum(take), 0) AS unfilled, list_sum([take[i] * ap[i] for i in range(1, len(aq) + 1)]) / list_sum(take) AS fill_price,
      CASE WHEN len(aq) = 0 THEN {TICK} ELSE list_sum([CASE WHEN need > cum[i] THEN abs(ap[i] - ap[1]) ELSE 0 END for i in range(1, len(aq) + 1)]) END AS slippage FROM t""",
)
def walk_the_book_slippage(spark, sf):
    b = the_book(spark, sf)[0].filter("action = 'A'")
    levels = F.zip_with("ask_prices", "ask_sizes", lambda p, q: F.struct(p.alias("price"), q.alias("size")))
    return book.walk_slippage(b.withColumns({"levels": levels, "order_size": F.col("size") * 3}), TICK)


@query(
    "sweep_levels",
    "instrument sequence",
    "sweep_levels probability intensity recent volume_rate",
    f"""WITH {ALL_SQL}, p AS (SELECT b.*, lag(ap) OVER w AS pa, lag(aq) OVER w AS qa, lag(bp) OVER w AS pb, lag(bq) OVER w AS qb FROM
      (SELECT m.instrument, m.sequence, m.ts_event, m.action, m.side, m.price, m.size, ap, aq, bp, bq FROM mbo m JOIN at1 USING (instrument, sequence)) b WINDOW w AS (PARTITION BY instrument ORDER BY ts_event, sequence)),
    l AS (SELECT *, CASE WHEN side = 'B' THEN [qa[i] for i in range(1, len(pa) + 1) if pa[i] <= price] ELSE [qb[i] for i in range(1, len(pb) + 1) if pb[i] >= price] END AS ql FROM p),
    c AS (SELECT *, CASE WHEN action = 'F' THEN coalesce(len([i for i in range(1, len(ql) + 1) if coalesce(list_sum(ql[1:i - 1]), 0) < size]), 0) END AS k FROM l),
    s AS (SELECT *, CASE WHEN k > 1 THEN least(1, k / 5) ELSE 0 END AS pr, coalesce(size * k, 0) AS inten FROM c)
    SELECT instrument, sequence, k AS sweep_levels, pr AS probability, inten AS intensity, CAST({strict("sum(CASE WHEN {c} > 0.5 THEN 1 ELSE 0 END)", 'pr', 100)} AS DOUBLE) AS recent, {strict('avg({c})', 'inten', 100)} AS volume_rate FROM s""".replace(
        "bk AS (", "at1 AS (SELECT e.instrument, e.sequence, coalesce(list(iv.price ORDER BY iv.price DESC) FILTER (level_side = 'B'), []) AS bp, coalesce(list(q ORDER BY iv.price DESC) FILTER (level_side = 'B'), []) AS bq, coalesce(list(iv.price ORDER BY iv.price) FILTER (level_side = 'A'), []) AS ap, coalesce(list(q ORDER BY iv.price) FILTER (level_side = 'A'), []) AS aq FROM ep e LEFT JOIN iv ON e.instrument = iv.instrument AND e.rn >= iv.a AND e.rn < iv.b AND q > 0 GROUP BY 1, 2), bk AS ("
    ),
)
def sweep_levels(spark, sf):
    b, o = the_book(spark, sf, 0)
    return det.sweeps(b, o)


# ---------------------------------------------------------------- detectors

_FOOT = """fo AS (SELECT *, action IN ('F', 'T') AS fl FROM mbo), ft AS (SELECT *, coalesce(sum(size) FILTER (fl AND side = 'B') OVER s, 0) AS sb, coalesce(sum(size) FILTER (fl AND side = 'A') OVER s, 0) AS ss,
      sum(size) FILTER (fl) OVER s AS sv, sum(price * size) FILTER (fl) OVER s AS spv, last_value(CASE WHEN fl THEN price END IGNORE NULLS) OVER s AS lp, last_value(CASE WHEN fl THEN size END IGNORE NULLS) OVER s AS lq,
      last_value(CASE WHEN fl THEN ts_event END IGNORE NULLS) OVER s AS lt FROM fo WINDOW s AS (PARTITION BY instrument, trade_date ORDER BY ts_event, sequence ROWS UNBOUNDED PRECEDING))"""


@query(
    "execution_footprint_state",
    "instrument sequence session_buy_volume session_sell_volume session_delta last_execution_volume",
    "delta_ratio last_execution_price time_since_last_execution session_vwap",
    f"""WITH {MBO_SQL}, {_FOOT} SELECT instrument, sequence, CAST(sb AS BIGINT) AS session_buy_volume, CAST(ss AS BIGINT) AS session_sell_volume, CAST(sb - ss AS BIGINT) AS session_delta, lq AS last_execution_volume,
      CASE WHEN sb + ss > 0 THEN (sb - ss) / (sb + ss) ELSE 0 END AS delta_ratio, lp AS last_execution_price, (ts_event - lt) / 1e9 AS time_since_last_execution, spv / sv AS session_vwap FROM ft""",
    digits=8,
)
def execution_footprint_state(spark, sf):
    m = mbo(spark, sf)
    return det.execution_footprint(m, mbo_order(m))


@query(
    "fair_value_mids",
    "instrument sequence",
    "vwap_mid imbalance_adjusted_mid execution_weighted_mid",
    f"""WITH {ALL_SQL}, {_FOOT} SELECT bk.instrument, bk.sequence, coalesce(spv / sv, mid) AS vwap_mid, CASE WHEN bid_total + ask_total > 0 THEN mid + (sb - ss) / (bid_total + ask_total) * {TICK} ELSE mid END AS imbalance_adjusted_mid,
      CASE WHEN lq > 0 THEN (1 - least(lq / 1000, 1)) * mid + least(lq / 1000, 1) * lp ELSE mid END AS execution_weighted_mid FROM bk JOIN ft USING (instrument, sequence)""",
    digits=9,
)
def fair_value_mids(spark, sf):
    b, o = the_book(spark, sf, 0)
    return det.fair_values(det.execution_footprint(b, o), TICK)


_POST = f"""po0 AS (SELECT *, last_value(CASE WHEN level_side = 'B' THEN level_size END IGNORE NULLS) OVER pp AS pb, last_value(CASE WHEN level_side = 'A' THEN level_size END IGNORE NULLS) OVER pp AS pa FROM lv
      WINDOW pp AS (PARTITION BY instrument, epoch, price ORDER BY ts_event, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    po AS (SELECT *, coalesce(pb, 0) + coalesce(pa, 0) AS posted, action = 'F' AS fl FROM po0),
    ax AS (SELECT *, CASE WHEN fl THEN size / nullif(posted, 0) END AS ar, fl AND coalesce(size / nullif(posted, 0) > 0.5, false) AS is_absorption, fl AND posted < size * 0.1 AS is_exhaustion FROM po)"""


@query(
    "absorption_exhaustion_events",
    "instrument sequence posted is_absorption is_exhaustion",
    "absorption_ratio",
    f"WITH {MBO_SQL}, {book_sql()}, {_POST} SELECT *, ar AS absorption_ratio FROM ax WHERE fl",
)
def absorption_exhaustion_events(spark, sf):
    m = mbo(spark, sf)
    return det.absorption_exhaustion(m, mbo_order(m)).filter("action = 'F'")


_H = 3_600_000_000_000


@query(
    "absorption_counts_trailing",
    "instrument sequence absorption_events_1m exhaustion_events_1m",
    "avg_absorption_ratio",
    f"""WITH {MBO_SQL}, {book_sql()}, {_POST} SELECT instrument, sequence, count(*) FILTER (is_absorption) OVER w AS absorption_events_1m, count(*) FILTER (is_exhaustion) OVER w AS exhaustion_events_1m,
      coalesce(avg(ar) FILTER (is_absorption) OVER w, 0) AS avg_absorption_ratio FROM ax WINDOW w AS (PARTITION BY instrument ORDER BY ts_event RANGE BETWEEN {6 * _H - 1} PRECEDING AND CURRENT ROW)""",
)
def absorption_counts_trailing(spark, sf):
    m = mbo(spark, sf)
    return det.absorption_counts(m, mbo_order(m), 6 * _H)


@query(
    "large_order_fragments",
    "instrument sequence fragment_count is_fragmented total_fragmented_size time_to_complete",
    "",
    f"""WITH {MBO_SQL}, f AS (SELECT *, count(*) FILTER (action IN ('A', 'M')) OVER w AS n, coalesce(sum(size) FILTER (action IN ('A', 'M')) OVER w, 0) AS s, min(ts_event) FILTER (action IN ('A', 'M')) OVER w AS a, max(ts_event) FILTER (action IN ('A', 'M')) OVER w AS b
      FROM mbo WINDOW w AS (PARTITION BY instrument, order_id ORDER BY ts_event, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT instrument, sequence, n AS fragment_count, n > 1 AS is_fragmented, CASE WHEN n > 1 THEN CAST(s AS BIGINT) ELSE 0 END AS total_fragmented_size, CASE WHEN n > 1 THEN b - a ELSE 0 END AS time_to_complete FROM f WHERE size >= 90""",
)
def large_order_fragments(spark, sf):
    m = mbo(spark, sf)
    return det.large_orders(m, mbo_order(m), 90)


@query(
    "iceberg_events",
    "instrument sequence replenishment_count visible_size estimated_hidden_size",
    "confidence_score",
    f"""WITH RECURSIVE {MBO_SQL}, ad AS (SELECT instrument, price, ts_event, sequence, size, row_number() OVER (PARTITION BY instrument, price ORDER BY ts_event, sequence) AS k FROM mbo WHERE action = 'A' AND size >= 30),
    ch AS (SELECT instrument, price, k, ts_event, sequence, size, ts_event AS t0, 0 AS c FROM ad WHERE k = 1 UNION ALL
      SELECT a.instrument, a.price, a.k, a.ts_event, a.sequence, a.size, CASE WHEN a.ts_event - ch.t0 > {24 * _H} THEN a.ts_event ELSE ch.t0 END, CASE WHEN a.ts_event - ch.t0 > {24 * _H} THEN ch.c + 1 ELSE ch.c END
      FROM ch JOIN ad a ON a.instrument = ch.instrument AND a.price = ch.price AND a.k = ch.k + 1),
    g AS (SELECT *, CAST(ts_event - lag(ts_event) OVER (PARTITION BY instrument, price, c ORDER BY k) AS DOUBLE) AS gap FROM ch),
    r AS (SELECT *, count(*) OVER w AS n, CAST(sum(size) OVER w AS BIGINT) AS vis, avg(gap) OVER w AS mu, stddev_pop(gap) OVER w AS sd FROM g WINDOW w AS (PARTITION BY instrument, price, c ORDER BY k))
    SELECT instrument, sequence, n AS replenishment_count, vis AS visible_size, CAST(floor(vis * 7.5) AS BIGINT) AS estimated_hidden_size, least(0.8 / (1 + sd / mu), 0.9) AS confidence_score FROM r WHERE n >= 3""",
)
def iceberg_events(spark, sf):
    m = mbo(spark, sf)
    return det.icebergs(m, mbo_order(m), min_size=30, window_ns=24 * _H)


@query(
    "spoofing_events",
    "instrument sequence placed_size time_to_cancel spoofing_type",
    "spoofing_score placed_price",
    f"""WITH {MBO_SQL}, a AS (SELECT *, count(*) FILTER (action = 'A') OVER (PARTITION BY instrument, order_id ORDER BY ts_event, sequence ROWS UNBOUNDED PRECEDING) AS life FROM mbo),
    l AS (SELECT *, first_value(ts_event) OVER w AS t0, first_value(size) OVER w AS s0, first_value(price) OVER w AS p0 FROM a WINDOW w AS (PARTITION BY instrument, order_id, life ORDER BY ts_event, sequence))
    SELECT instrument, sequence, s0 AS placed_size, p0 AS placed_price, ts_event - t0 AS time_to_cancel, least(1, ({72 * _H} - (ts_event - t0)) / {72 * _H}) AS spoofing_score,
      CASE WHEN s0 > 60 THEN 'layering' WHEN ts_event - t0 < 1000000000 THEN 'quote_stuffing' ELSE 'spoofing' END AS spoofing_type FROM l WHERE action = 'C' AND life > 0 AND s0 >= 20 AND ts_event - t0 <= {72 * _H}""",
)
def spoofing_events(spark, sf):
    m = mbo(spark, sf)
    return det.spoofing_events(m, mbo_order(m), 20, 72 * _H, 60)


_FILLS = f"""fi AS (SELECT *, coalesce(price - lag(price) OVER ({W}), 0) AS chg, CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END AS d, row_number() OVER ({W}) AS n FROM mbo WHERE action = 'F')"""
_INST = f"""fw AS (SELECT *, sum(size) OVER {rows(100)} AS v, sum(d) OVER {rows(100)} AS dd, sum(chg) OVER {rows(100)} AS pi, avg(size) OVER {rows(100)} AS mu, stddev_pop(size) OVER {rows(100)} AS sd FROM fi),
    inst AS (SELECT *, CASE WHEN dd / v > 0.3 THEN 'buy_pressure' WHEN dd / v < -0.3 THEN 'sell_pressure' ELSE 'neutral' END AS flow_type, CASE WHEN abs(dd / v) > 0.3 THEN least(1, abs(dd / v)) ELSE 0 END AS strength, 1 / (1 + sd / mu) AS confidence FROM fw WHERE n >= 100)"""


@query(
    "institutional_flow",
    "instrument sequence flow_type",
    "strength confidence volume_impact price_impact",
    f"WITH {MBO_SQL}, {_FILLS}, {_INST} SELECT *, v AS volume_impact, pi AS price_impact FROM inst",
)
def institutional_flow(spark, sf):
    m = mbo(spark, sf)
    return det.institutional_flow(m, mbo_order(m))


_REG = f"""rg0 AS (SELECT *, stddev_pop(abs(chg)) OVER {rows(200)} AS vl, avg(size) OVER {rows(200)} AS ll, avg(chg) OVER {rows(200)} AS tr, stddev_pop(chg) OVER {rows(200)} AS ts2 FROM fi),
    rg1 AS (SELECT *, CASE WHEN vl > 2 THEN 'volatile' WHEN abs(tr) > 1 AND 1 / (1 + ts2) > 0.7 THEN 'trending' WHEN ll < 100 THEN 'quiet' ELSE 'mean_reverting' END AS regime_type FROM rg0 WHERE n >= 200),
    rg AS (SELECT *, lag(regime_type) OVER ({W}) AS prev FROM rg1)"""


@query(
    "regime_events",
    "instrument sequence regime_type",
    "volatility_level liquidity_level transition_probability",
    f"WITH {MBO_SQL}, {_FILLS}, {_REG} SELECT *, vl AS volatility_level, ll AS liquidity_level, CASE WHEN prev IS NULL THEN 0.2 WHEN prev = regime_type THEN 0.1 ELSE 0.3 END AS transition_probability FROM rg",
)
def regime_events(spark, sf):
    m = mbo(spark, sf)
    return det.regime_events(m, mbo_order(m))


_STRESS = f"""sq AS (SELECT *, bid_size + ask_size AS td, row_number() OVER ({W}) AS n FROM bk WHERE action = 'F' AND best_bid IS NOT NULL AND best_ask IS NOT NULL),
    sw AS (SELECT *, avg(spread) OVER {rows(50)} AS sm, avg(td) OVER {rows(50)} AS dm FROM sq),
    st0 AS (SELECT *, CASE WHEN sm > 0 THEN (spread - sm) / sm ELSE 0 END AS wide, CASE WHEN dm > 0 THEN (dm - td) / dm ELSE 0 END AS thin FROM sw WHERE n >= 50),
    stress AS (SELECT *, CASE WHEN wide > 0.5 THEN 0.5 ELSE 0 END + CASE WHEN thin > 0.7 THEN 0.5 ELSE 0 END AS lvl FROM st0 WHERE wide > 0.5 OR thin > 0.7)"""


@query(
    "liquidity_stress",
    "instrument sequence",
    "stress_level spread_widening depth_reduction",
    f"WITH {ALL_SQL}, {_STRESS} SELECT instrument, sequence, lvl AS stress_level, wide AS spread_widening, thin AS depth_reduction FROM stress",
)
def liquidity_stress(spark, sf):
    b, o = the_book(spark, sf, 0)
    return det.liquidity_stress(b, o)


@query(
    "anomaly_events",
    "instrument sequence anomaly_type",
    "severity impact_score",
    f"""WITH {ALL_SQL}, fb AS (SELECT *, coalesce(price - lag(price) OVER ({W}), 0) AS chg, row_number() OVER ({W}) AS n, CASE WHEN best_bid IS NOT NULL AND best_ask IS NOT NULL THEN spread END AS q FROM bk WHERE action = 'F'),
    qs AS (SELECT instrument, sequence, ts_event, q AS cur, CASE WHEN row_number() OVER ({W}) >= 50 THEN avg(q) OVER {rows(50)} END AS qm FROM fb WHERE q IS NOT NULL),
    x AS (SELECT fb.*, cur, qm FROM fb ASOF LEFT JOIN qs ON fb.instrument = qs.instrument AND fb.ts_event >= qs.ts_event),
    y AS (SELECT *, CASE WHEN n >= 100 THEN avg(size) OVER {rows(100)} END AS mu, CASE WHEN n >= 100 THEN stddev_pop(size) OVER {rows(100)} END AS sd FROM x)
    SELECT instrument, sequence, 'volume_spike' AS anomaly_type, least(1, (size - mu) / (3 * sd)) AS severity, size / mu AS impact_score FROM y WHERE size > mu + 3 * sd
    UNION ALL SELECT instrument, sequence, 'price_jump', least(1, abs(chg) / {5 * TICK}), abs(chg) / {TICK} FROM y WHERE abs(chg) > {5 * TICK}
    UNION ALL SELECT instrument, sequence, 'spread_widening', least(1, (cur - qm) / (2 * qm)), cur / qm FROM y WHERE cur > 2 * qm""",
)
def anomaly_events(spark, sf):
    b, o = the_book(spark, sf, 0)
    return det.anomalies(b, o, TICK)


@query(
    "detector_summaries",
    "instrument sequence",
    "institutional_flow_strength flow_predictability volatility_regime_share regime_transition_probability liquidity_regime liquidity_stress_now",
    f"""WITH {ALL_SQL}, {_FILLS}, {_INST}, {_REG}, {_STRESS},
    i2 AS (SELECT instrument, ts_event, avg(strength) OVER {rows(100)} * avg(confidence) OVER {rows(100)} AS fs, greatest(count(*) FILTER (flow_type = 'buy_pressure') OVER {rows(50)}, count(*) FILTER (flow_type = 'sell_pressure') OVER {rows(50)}, count(*) FILTER (flow_type = 'neutral') OVER {rows(50)}) / count(*) OVER {rows(50)} AS fp FROM inst),
    r2 AS (SELECT instrument, ts_event, count(*) FILTER (regime_type = 'volatile') OVER {rows(20)} / count(*) OVER {rows(20)} AS vs, coalesce(count(*) FILTER (prev <> regime_type) OVER {rows(9)} / nullif(count(prev) OVER {rows(9)}, 0), 0) AS tp FROM rg),
    s2 AS (SELECT instrument, ts_event, least(1, avg(lvl) OVER {rows(20)}) AS lr, lvl FROM stress)
    SELECT m.instrument, m.sequence, coalesce(fs, 0) AS institutional_flow_strength, coalesce(fp, 0) AS flow_predictability, coalesce(vs, 0) AS volatility_regime_share, coalesce(tp, 0) AS regime_transition_probability,
      coalesce(lr, 0) AS liquidity_regime, coalesce(lvl, 0) AS liquidity_stress_now
    FROM mbo m ASOF LEFT JOIN i2 ON m.instrument = i2.instrument AND m.ts_event >= i2.ts_event ASOF LEFT JOIN r2 ON m.instrument = r2.instrument AND m.ts_event >= r2.ts_event ASOF LEFT JOIN s2 ON m.instrument = s2.instrument AND m.ts_event >= s2.ts_event""",
)
def detector_summaries(spark, sf):
    b, o = the_book(spark, sf, 0)
    m = mbo(spark, sf)
    return det.detector_summaries(m, det.institutional_flow(m, o), det.regime_events(m, o), det.liquidity_stress(b, o), o)


@query(
    "flow_autocorrelation",
    "instrument sequence",
    "flow_autocorrelation",
    f"""WITH {MBO_SQL}, {_FILLS}, l AS (SELECT *, [CAST(z AS DOUBLE) for z in list(d) OVER {rows(100)}] AS xs FROM fi), m AS (SELECT *, list_avg(xs) AS mu, list_var_pop(xs) AS vp FROM l)
    SELECT instrument, sequence, CASE WHEN len(xs) >= 50 AND vp > 0 THEN least(1, abs(list_sum([(xs[i] - mu) * (xs[i - 1] - mu) for i in range(2, len(xs) + 1)]) / ((len(xs) - 1) * vp))) ELSE 0 END AS flow_autocorrelation FROM m""",
)
def flow_autocorrelation(spark, sf):
    m = mbo(spark, sf)
    return det.flow_autocorrelation(m, mbo_order(m))


@query(
    "multi_scale_ofi",
    "instrument sequence",
    "ofi_fast ofi_medium ofi_slow volatility_estimate mean_change",
    f"""WITH {MBO_SQL}, s AS (SELECT *, CASE side WHEN 'B' THEN size / 7 WHEN 'A' THEN -size / 7 ELSE 0 END AS x, row_number() OVER ({W}) AS n, price - lag(price) OVER ({W}) AS chg FROM mbo),
    e AS (SELECT m.instrument, m.sequence, sum(p.x * 0.1 * pow(0.9, m.n - p.n)) AS f, sum(p.x * 0.01 * pow(0.99, m.n - p.n)) AS md, sum(p.x * 0.001 * pow(0.999, m.n - p.n)) AS sl FROM s m JOIN s p ON m.instrument = p.instrument AND p.n <= m.n GROUP BY 1, 2)
    SELECT s.instrument, s.sequence, f AS ofi_fast, md AS ofi_medium, sl AS ofi_slow, CASE WHEN n > 2 THEN stddev_pop(chg) OVER {rows(1000, W.replace('instrument', 's.instrument').replace('sequence', 's.sequence'))} ELSE 0 END AS volatility_estimate,
      coalesce(avg(chg) OVER {rows(1000, W.replace('instrument', 's.instrument').replace('sequence', 's.sequence'))}, 0) / 3 AS mean_change FROM s JOIN e ON s.instrument = e.instrument AND s.sequence = e.sequence""",
    digits=8,
)
def multi_scale_ofi(spark, sf):
    m = mbo(spark, sf).withColumn("x", bars.signed_size() / 7)
    d = det.multi_scale_ofi(m, mbo_order(m), "x")
    return d.withColumn("mean_change", F.get("microstructure_indicators", F.lit(0)) / 3)


# ---------------------------------------------------------------- documented features

_HZ = {"20m": hz.horizon_ns("20m"), "1h": hz.horizon_ns("1h")}


@query(
    "cumulative_delta_horizons",
    "instrument sequence session_delta d20 d60",
    "",
    f"""WITH {MBO_SQL}, {_FOOT} SELECT instrument, sequence, CAST(sb - ss AS BIGINT) AS session_delta, CAST(sum(CASE WHEN fl THEN CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END ELSE 0 END) OVER {trailing(_HZ['20m'])} AS BIGINT) AS d20,
      CAST(sum(CASE WHEN fl THEN CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END ELSE 0 END) OVER {trailing(_HZ['1h'])} AS BIGINT) AS d60 FROM ft""",
)
def cumulative_delta_horizons(spark, sf):
    m = mbo(spark, sf)
    d = det.cumulative_delta(m, mbo_order(m), _HZ)
    return d.withColumnsRenamed({"20m_delta": "d20", "1h_delta": "d60"})


@query(
    "absorption_profile_horizons",
    "instrument sequence depletion",
    "ratio_ strength exhaustion refill",
    f"""WITH {MBO_SQL}, {book_sql()}, {_POST}, q AS (SELECT *, level_size - level_size_before AS ch FROM ax), w AS (SELECT instrument, sequence, sum(CASE WHEN fl THEN size ELSE 0 END) OVER w AS taken, sum(CASE WHEN fl THEN posted ELSE 0 END) OVER w AS post,
      sum(CASE WHEN is_absorption THEN size ELSE 0 END) OVER w AS absd, sum(CASE WHEN is_exhaustion THEN 1 ELSE 0 END) OVER w AS exh, sum(CASE WHEN fl THEN 1 ELSE 0 END) OVER w AS fills, sum(greatest(-ch, 0)) OVER w AS lost, sum(greatest(ch, 0)) OVER w AS added FROM q
      WINDOW w AS (PARTITION BY instrument ORDER BY ts_event RANGE BETWEEN {6 * _H} PRECEDING AND CURRENT ROW))
    SELECT instrument, sequence, CAST(lost AS BIGINT) AS depletion, coalesce(taken / nullif(post, 0), 0) AS ratio_, coalesce(absd / nullif(taken, 0), 0) AS strength, coalesce(exh / nullif(fills, 0), 0) AS exhaustion, coalesce(added / nullif(lost, 0), 0) AS refill FROM w""",
)
def absorption_profile_horizons(spark, sf):
    m = mbo(spark, sf)
    d = det.absorption_profile(m, mbo_order(m), {"h": 6 * _H})
    return d.withColumnsRenamed(
        {"h_absorption_ratio": "ratio_", "h_absorption_strength": "strength", "h_exhaustion_rate": "exhaustion", "h_depth_depletion": "depletion", "h_refill_rate": "refill"}
    )


@query(
    "weighted_price_horizons",
    "instrument sequence",
    "avg_price vwap adjusted",
    f"""WITH {MBO_SQL}, {book_sql()}, {_POST} SELECT instrument, sequence, avg(price) FILTER (fl) OVER w AS avg_price, sum(price * size) FILTER (fl) OVER w / sum(size) FILTER (fl) OVER w AS vwap,
      sum(price * size) FILTER (fl AND NOT is_absorption) OVER w / sum(size) FILTER (fl AND NOT is_absorption) OVER w AS adjusted FROM ax WINDOW w AS (PARTITION BY instrument ORDER BY ts_event RANGE BETWEEN {6 * _H} PRECEDING AND CURRENT ROW)""",
    digits=8,
)
def weighted_price_horizons(spark, sf):
    m = mbo(spark, sf)
    d = det.weighted_prices(m, mbo_order(m), {"h": 6 * _H})
    return d.withColumnsRenamed({"h_trade_avg_price": "avg_price", "h_execution_vwap": "vwap", "h_absorption_adjusted_price": "adjusted"})


_CONV = """count(*) FILTER (action = 'A') AS adds, count(*) FILTER (action = 'F') AS fills, CAST(coalesce(sum(size) FILTER (action = 'A'), 0) AS BIGINT) AS posted, CAST(coalesce(sum(size) FILTER (action = 'F'), 0) AS BIGINT) AS filled"""


@query(
    "fill_conversion_by_level",
    "instrument adds fills posted filled",
    "price fill_ratio posted_to_filled conversion_efficiency",
    f"""WITH {MBO_SQL}, c AS (SELECT instrument, price, {_CONV} FROM mbo GROUP BY 1, 2) SELECT *, coalesce(fills / nullif(adds, 0), 0) AS fill_ratio, coalesce(posted / nullif(filled, 0), 0) AS posted_to_filled,
      coalesce(filled / nullif(posted, 0), 0) AS conversion_efficiency FROM c""",
)
def fill_conversion_by_level(spark, sf):
    return det.conversion(mbo(spark, sf), ["instrument", "price"])


@query(
    "fill_conversion_by_time",
    "instrument bucket adds fills posted filled",
    "fill_ratio conversion_efficiency",
    f"""WITH {MBO_SQL}, c AS (SELECT instrument, epoch_us(date_trunc('hour', ts)) AS bucket, {_CONV} FROM mbo GROUP BY 1, 2) SELECT *, coalesce(fills / nullif(adds, 0), 0) AS fill_ratio, coalesce(filled / nullif(posted, 0), 0) AS conversion_efficiency FROM c""",
)
def fill_conversion_by_time(spark, sf):
    hour = F.unix_micros(F.date_trunc("hour", F.timestamp_micros(F.expr("ts_event div 1000"))))
    return det.conversion(mbo(spark, sf).withColumn("bucket", hour), ["instrument", "bucket"])


@query(
    "phantom_liquidity",
    "instrument phantom_orders",
    "phantom_distance phantom_volume_ratio",
    f"""WITH {ALL_SQL}, life AS (SELECT instrument, order_id, min(ts_event) FILTER (action = 'A') AS ts_event, arg_min(price, (ts_event, sequence)) FILTER (action = 'A') AS ap0, arg_min(size, (ts_event, sequence)) FILTER (action = 'A') AS sz, count(*) FILTER (action = 'F') AS fills
      FROM mbo GROUP BY 1, 2 HAVING count(*) FILTER (action = 'A') > 0), mm AS (SELECT instrument, ts_event, mid FROM bk),
    s AS (SELECT life.*, mid, abs(ap0 - mid) AS away FROM life ASOF LEFT JOIN mm ON life.instrument = mm.instrument AND life.ts_event >= mm.ts_event)
    SELECT instrument, count(*) FILTER (fills = 0 AND away > 5) AS phantom_orders, avg(away) FILTER (fills = 0 AND away > 5) AS phantom_distance, coalesce(sum(sz) FILTER (fills = 0 AND away > 5), 0) / sum(sz) AS phantom_volume_ratio FROM s GROUP BY 1""",
)
def phantom_liquidity(spark, sf):
    b, o = the_book(spark, sf, 0)
    return det.phantom_liquidity(mbo(spark, sf), b, o, 5.0)


@query(
    "footprint_clusters",
    "instrument start_us cluster_persistence",
    "cluster_strength cluster_migration",
    f"""WITH {MBO_SQL}, g AS (SELECT instrument, time_bucket(INTERVAL 60 MINUTE, ts) AS b, round(price / {TICK}) AS lvl, sum(CASE WHEN side IN ('A', 'B') THEN size ELSE 0 END) AS v, sum(CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END) AS d FROM mbo GROUP BY 1, 2, 3),
    a AS (SELECT instrument, b, sum(v * v) / (sum(v) * sum(v)) AS cs, sum(v * lvl) / sum(v) AS ce, sign(sum(d)) AS sg FROM g GROUP BY 1, 2 HAVING sum(v) > 0),
    t AS (SELECT *, ce - lag(ce) OVER w AS mg, CASE WHEN lag(sg) OVER w IS NULL OR lag(sg) OVER w <> sg THEN 1 ELSE 0 END AS tn FROM a WINDOW w AS (PARTITION BY instrument ORDER BY b)), r AS (SELECT *, sum(tn) OVER (PARTITION BY instrument ORDER BY b) AS run FROM t)
    SELECT instrument, epoch_us(b) AS start_us, cs AS cluster_strength, mg AS cluster_migration, CAST(row_number() OVER (PARTITION BY instrument, run ORDER BY b) AS INTEGER) AS cluster_persistence FROM r""",
    digits=9,
)
def footprint_clusters(spark, sf):
    g = bars.footprint_grid(mbo(spark, sf), "60 minutes", TICK)
    return det.footprint_clusters(g).withColumn("start_us", F.unix_micros("bar_start"))


@query(
    "aggressor_profile",
    "instrument sequence aggressor_persistence",
    "q25 q50 q75 frequency",
    f"""WITH {MBO_SQL}, f AS (SELECT *, lag(side) OVER ({W}) AS ps FROM mbo WHERE action = 'F'), r AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> side THEN 1 ELSE 0 END) OVER {span(None, 0)} AS run FROM f)
    SELECT instrument, sequence, row_number() OVER (PARTITION BY instrument, run ORDER BY ts_event, sequence) AS aggressor_persistence, quantile_cont(size, 0.25) OVER {rows(100)} AS q25, quantile_cont(size, 0.5) OVER {rows(100)} AS q50,
      quantile_cont(size, 0.75) OVER {rows(100)} AS q75, count(*) OVER {trailing(_H)} / 3600 AS frequency FROM r""",
)
def aggressor_profile(spark, sf):
    m = mbo(spark, sf)
    d = det.aggressor_profile(m, mbo_order(m), window_ns=_H)
    at = lambda i: F.get("aggressor_size_quartiles", F.lit(i))
    return d.withColumns({"q25": at(0), "q50": at(1), "q75": at(2), "frequency": F.col("aggressor_frequency")})


@query(
    "impact_and_quote_stability",
    "instrument trade_date",
    "impact_slope quote_stability",
    f"""WITH {ALL_SQL}, {_FILLS}, s AS (SELECT *, CASE WHEN best_bid IS NOT DISTINCT FROM lag(best_bid) OVER ({W}) AND best_ask IS NOT DISTINCT FROM lag(best_ask) OVER ({W}) THEN 1 ELSE 0 END AS same FROM bk),
    q AS (SELECT instrument, trade_date, avg(same) AS quote_stability FROM s GROUP BY 1, 2), i AS (SELECT instrument, trade_date, regr_slope(abs(chg), size) AS impact_slope FROM fi GROUP BY 1, 2)
    SELECT q.*, impact_slope FROM q LEFT JOIN i USING (instrument, trade_date)""",
)
def impact_and_quote_stability(spark, sf):
    b, o = the_book(spark, sf, 0)
    return det.impact_and_stability(b, o, ["instrument", "trade_date"])


@query(
    "liquidity_resilience",
    "instrument sequence",
    "recovery_seconds",
    f"""WITH {ALL_SQL}, {_STRESS}, f AS (SELECT b.instrument, b.sequence, b.ts_event, s.sequence IS NOT NULL AS hit FROM bk b LEFT JOIN stress s ON b.instrument = s.instrument AND b.sequence = s.sequence WHERE b.action = 'F'),
    n AS (SELECT *, min(CASE WHEN NOT hit THEN ts_event END) OVER {span(1, 1000000)} AS calm FROM f)
    SELECT instrument, sequence, (calm - ts_event) / 1e9 AS recovery_seconds FROM n WHERE hit""",
)
def liquidity_resilience(spark, sf):
    m = mbo(spark, sf)
    o = mbo_order(m).spread(m)
    b = book.book_at_events(book.level_book(m, o), o, 0)
    return det.resilience(det.liquidity_stress(b, o), b, o)


@query(
    "horizon_relations",
    "instrument sequence reversal_signal",
    "delta_correlation momentum_persistence",
    f"""WITH {MBO_SQL}, f AS (SELECT *, CASE WHEN action = 'F' THEN CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END ELSE 0 END AS d FROM mbo), h AS (SELECT *, CAST(sum(d) OVER {trailing(_HZ['20m'])} AS BIGINT) AS s, CAST(sum(d) OVER {trailing(_HZ['1h'])} AS BIGINT) AS g FROM f)
    SELECT instrument, sequence, CAST(s * g < 0 AND abs(s) > 0.5 * abs(g) AS INTEGER) AS reversal_signal, corr(s, g) OVER {rows(50)} AS delta_correlation, avg(CASE WHEN sign(s) = sign(g) AND s <> 0 THEN 1 ELSE 0 END) OVER {rows(50)} AS momentum_persistence FROM h""",
)
def horizon_relations(spark, sf):
    m = mbo(spark, sf)
    o = mbo_order(m)
    return det.horizon_relations(hz.multi_horizon(m, o, _HZ), o, "20m", "1h")


@query(
    "execution_volume_norms",
    "instrument sequence",
    "execution_volume_norm delta_norm",
    f"""WITH {MBO_SQL}, f AS (SELECT *, row_number() OVER ({W}) AS n, sum(CASE WHEN action = 'F' THEN size ELSE 0 END) OVER {trailing(_H)} AS v, sum(CASE WHEN action = 'F' THEN CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END ELSE 0 END) OVER {trailing(_H)} AS d FROM mbo),
    e AS (SELECT m.instrument, m.sequence, sum(p.v * CASE WHEN p.n = 1 THEN 1 ELSE 0.01 END * pow(0.99, m.n - p.n)) AS y FROM f m JOIN f p ON m.instrument = p.instrument AND p.n <= m.n GROUP BY 1, 2)
    SELECT f.instrument, f.sequence, CASE WHEN y > 0 THEN v / y ELSE 0 END AS execution_volume_norm, CASE WHEN y > 0 THEN tanh(d / y) ELSE 0 END AS delta_norm FROM f JOIN e ON f.instrument = e.instrument AND f.sequence = e.sequence""",
)
def execution_volume_norms(spark, sf):
    m = mbo(spark, sf)
    o = mbo_order(m)
    return det.bounded_norms(hz.multi_horizon(m, o, {"1h": _H}), o, "1h")


_KINDS = ["volume_spike", "price_jump", "spread_widening"]


@query("detector_counts_per_horizon", "instrument sequence h_volume_spike h_price_jump h_spread_widening", "")
def detector_counts_per_horizon(spark, sf):
    b, o = the_book(spark, sf, 0)
    a = det.anomalies(b, o, TICK)
    o2 = EventOrder(keys=o.keys, order=(*o.order, "anomaly_type"), ts=o.ts, hot=o.hot)
    return hz.event_counts(a, o2, _KINDS, {"h": _H}, "anomaly_type")
