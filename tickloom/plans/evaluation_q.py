"""Labels, splits, models, back-tests and trade metrics."""

from pyspark.sql import functions as F

from tickloom.operators import backtest as bt
from tickloom.operators import labels as lb
from tickloom.operators import models as md
from tickloom.operators import order_flow as of
from tickloom.operators import quality
from tickloom.order import EventOrder, running
from tickloom.plans.binding import MBO_SQL, TICK, W, mbo, mbo_order, rows, span, table
from tickloom.plans.book_q import ALL_SQL, the_book
from tickloom.plans.registry import query
from tickloom.session import pin


@query(
    "targets_horizons",
    "instrument sequence price_direction_3r",
    "price_change_1r price_return_3r price_change_5r price_volatility_3r price_volatility_5r",
    f"""WITH {MBO_SQL} SELECT instrument, sequence, lead(price, 1) OVER ({W}) - price AS price_change_1r, (lead(price, 3) OVER ({W}) - price) / price AS price_return_3r, lead(price, 5) OVER ({W}) - price AS price_change_5r,
      CAST(coalesce(lead(price, 3) OVER ({W}) > price, false) AS INTEGER) AS price_direction_3r, CASE WHEN count(*) OVER {span(1, 3)} = 3 THEN stddev_samp(price) OVER {span(1, 3)} END AS price_volatility_3r,
      CASE WHEN count(*) OVER {span(1, 5)} = 5 THEN stddev_samp(price) OVER {span(1, 5)} END AS price_volatility_5r FROM mbo""",
    digits=9,
)
def targets_horizons(spark, sf):
    m = mbo(spark, sf)
    return lb.horizon_targets(m, mbo_order(m))


@query(
    "target_log_return",
    "instrument sequence",
    "target",
    f"WITH {MBO_SQL} SELECT instrument, sequence, 100 * ln(lead(price, 100) OVER ({W}) / price) AS target FROM mbo",
)
def target_log_return(spark, sf):
    m = mbo(spark, sf)
    return lb.log_return_target(m, mbo_order(m), 100)


@query(
    "target_minutes",
    "instrument sequence",
    "return_target_1m direction_target_1m return_target_5m direction_target_5m",
    f"WITH {MBO_SQL} SELECT instrument, sequence, "
    + ", ".join(f"(lead(price, {60 * k}) OVER ({W}) - price) / price AS return_target_{k}m, sign(lead(price, {60 * k}) OVER ({W}) - price) AS direction_target_{k}m" for k in (1, 5))
    + " FROM mbo",
    digits=9,
)
def target_minutes(spark, sf):
    m = mbo(spark, sf)
    return lb.minute_targets(m, mbo_order(m))


@query(
    "target_from_last_fill",
    "instrument sequence",
    "target_pct",
    f"""WITH {MBO_SQL}, f AS (SELECT *, last_value(CASE WHEN action = 'F' THEN price END IGNORE NULLS) OVER {span(None, 0)} AS lf, lead(price, 10) OVER ({W}) AS ahead FROM mbo)
    SELECT instrument, sequence, (ahead - lf) / lf * 100 AS target_pct FROM f""",
    digits=8,
)
def target_from_last_fill(spark, sf):
    m = mbo(spark, sf)
    return lb.change_from_last_fill(m, mbo_order(m))


@query(
    "label_3class",
    "instrument sequence label",
    "",
    f"""WITH {MBO_SQL}, r AS (SELECT instrument, sequence, (lead(price) OVER ({W}) - price) / price AS r FROM mbo)
    SELECT instrument, sequence, CASE WHEN r > 0.001 THEN 2 WHEN r < -0.001 THEN 0 WHEN r IS NOT NULL THEN 1 END AS label FROM r""",
)
def label_3class(spark, sf):
    m = mbo(spark, sf)
    return lb.three_class(m, mbo_order(m), 0.001)


@query(
    "sequence_windows",
    "instrument sequence n",
    "first_price total_size",
    f"""WITH {MBO_SQL}, s AS (SELECT instrument, sequence, list(price) OVER {span(-20, -1)} AS p, list(size) OVER {span(-20, -1)} AS q FROM mbo)
    SELECT instrument, sequence, 20 AS n, p[1] AS first_price, list_sum(q) AS total_size FROM s WHERE len(p) = 20""",
)
def sequence_windows(spark, sf):
    m = mbo(spark, sf)
    d = lb.sequences(m, mbo_order(m), ["price", "size"], 20)
    total = F.aggregate("sequence_window", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    return d.withColumns({"n": F.size("sequence_window"), "first_price": F.get("sequence_window", F.lit(0))["price"], "total_size": total})


@query(
    "time_split",
    "instrument sequence split",
    "",
    f"""WITH {MBO_SQL}, r AS (SELECT instrument, sequence, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY instrument) AS n FROM mbo)
    SELECT instrument, sequence, CASE WHEN rn <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def time_split(spark, sf):
    m = mbo(spark, sf)
    return lb.time_split(m, mbo_order(m))


def _pct_sql(key: str, seed: int = 42) -> str:
    return f"(CAST('0x' || md5('{seed}:' || {key})[1:8] AS BIGINT) % 100)"


@query(
    "random_split",
    "sequence split",
    "",
    f"WITH {MBO_SQL} SELECT sequence, CASE WHEN {_pct_sql('sequence')} < 80 THEN 'train' ELSE 'test' END AS split FROM mbo",
)
def random_split(spark, sf):
    return lb.random_split(mbo(spark, sf), F.col("sequence"))


@query(
    "session_split",
    "sequence session trade_date split",
    "",
    f"""WITH {MBO_SQL}, s AS (SELECT *, CASE WHEN hour(ts) < 8 THEN 'asia' WHEN hour(ts) < 16 THEN 'london' WHEN hour(ts) < 21 THEN 'new_york' ELSE 'overnight' END AS session FROM mbo),
    a AS (SELECT session, row_number() OVER (ORDER BY md5('42:' || session)) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM s)),
    b AS (SELECT trade_date, row_number() OVER (ORDER BY md5('42:' || CAST(trade_date AS VARCHAR))) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM s)),
    ra AS (SELECT session, CASE WHEN i <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS r FROM a),
    rb AS (SELECT trade_date, CASE WHEN i <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS r FROM b)
    SELECT sequence, session, trade_date, CASE WHEN ra.r = rb.r THEN ra.r END AS split FROM s JOIN ra USING (session) JOIN rb USING (trade_date)""",
)
def session_split(spark, sf):
    return lb.session_split(mbo(spark, sf))


@query(
    "walk_forward_by_dates",
    "period role events first_date last_date",
    "",
    f"""WITH {MBO_SQL}, d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM mbo)),
    p AS (SELECT CAST(k AS BIGINT) AS period FROM range(100) AS r(k) WHERE k * 3 < (SELECT max(n) FROM d) - 10),
    x AS (SELECT trade_date, period, CASE WHEN i - period * 3 BETWEEN 0 AND 7 THEN 'train' WHEN i - period * 3 BETWEEN 8 AND 10 THEN 'val' WHEN i - period * 3 BETWEEN 11 AND 13 THEN 'test' END AS role FROM d, p)
    SELECT period, role, count(*) AS events, min(trade_date) AS first_date, max(trade_date) AS last_date FROM mbo JOIN x USING (trade_date) WHERE role IS NOT NULL GROUP BY 1, 2""",
)
def walk_forward_by_dates(spark, sf):
    d = lb.walk_forward_dates(mbo(spark, sf), window=10, step=3)
    return d.groupBy("period", "role").agg(
        F.count(F.lit(1)).alias("events"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date")
    )


_WFR = f"""n AS (SELECT count(*) AS n FROM mbo), pr AS (SELECT i AS period, i * CAST(greatest(100, floor(n * 0.1)) AS BIGINT) AS a, CAST(floor(n * 0.6) AS BIGINT) AS t, CAST(floor(n * 0.2) AS BIGINT) AS v, n FROM n, range(20) AS r(i)),
    sl AS (SELECT * FROM pr WHERE a + t + v < n), nr AS (SELECT *, row_number() OVER (ORDER BY ts_event, sequence) - 1 AS rn FROM mbo),
    wf AS (SELECT nr.*, CAST(period AS INTEGER) AS period, CASE WHEN rn < a + t THEN 'train' WHEN rn < a + t + v THEN 'val' ELSE 'test' END AS role FROM nr JOIN sl ON rn >= a)"""


def global_rows(spark, sf):
    m = mbo(spark, sf).withColumn("_all", F.lit(0))
    return m, EventOrder(keys=("_all",)).measured(m)


@query(
    "walk_forward_by_rows",
    "period role events first_sequence",
    "",
    f"WITH {MBO_SQL}, {_WFR} SELECT period, role, count(*) AS events, min(sequence) AS first_sequence FROM wf GROUP BY 1, 2",
)
def walk_forward_by_rows(spark, sf):
    m, o = global_rows(spark, sf)
    d = lb.walk_forward_rows(m, o)
    return d.groupBy("period", "role").agg(F.count(F.lit(1)).alias("events"), F.min("sequence").alias("first_sequence"))


# ---------------------------------------------------------------- back-tests

_BT = f"""pd AS (SELECT *, CASE WHEN value > 20 THEN 1 ELSE 0 END * 2.0::DOUBLE - 1 AS dir FROM mbo),
    pb AS (SELECT *, dir * coalesce(price - lag(price) OVER ({W}), 0) - abs(dir - coalesce(lag(dir) OVER ({W}), 0)) * (1 * {TICK} + 0.5) AS pnl FROM pd),
    pe AS (SELECT *, sum(pnl) OVER {span(None, 0)} AS equity FROM pb), pk AS (SELECT *, (equity - max(equity) OVER {span(None, 0)}) / (max(equity) OVER {span(None, 0)} + 1e-9) AS dd FROM pe)"""
_RISK = "sum(pnl) AS pnl, avg(pnl) / (stddev_pop(pnl) + 1e-9) * sqrt(252) AS sharpe, avg(pnl) / (coalesce(stddev_pop(pnl) FILTER (pnl < 0), 0) + 1e-9) * sqrt(252) AS sortino, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS win_rate, count(*) AS \"rows\""


def traded(spark, sf):
    m = mbo(spark, sf).withColumn("prediction", F.when(F.col("value") > 20, 1).otherwise(0))
    o = mbo_order(m)
    return bt.vector_backtest(m, o, commission=0.5, slippage_ticks=1, tick=TICK), o


@query(
    "backtest_with_trades",
    "instrument sequence",
    "direction pnl equity",
    f"WITH {MBO_SQL}, {_BT} SELECT instrument, sequence, dir AS direction, pnl, equity FROM pe",
)
def backtest_with_trades(spark, sf):
    return traded(spark, sf)[0]


@query(
    "backtest_simple",
    "instrument rows",
    "pnl sharpe sortino win_rate max_drawdown",
    f"WITH {MBO_SQL}, {_BT} SELECT instrument, {_RISK}, min(dd) AS max_drawdown FROM pk GROUP BY 1",
)
def backtest_simple(spark, sf):
    t, o = traded(spark, sf)
    return bt.backtest_metrics(t, o, ["instrument"])


@query(
    "walk_forward_metrics",
    "period role rows",
    "pnl sharpe sortino win_rate",
    f"WITH {MBO_SQL}, {_BT}, wfx AS (SELECT * FROM pb), {_WFR.replace('AS rn FROM mbo', 'AS rn FROM wfx')} SELECT period, role, {_RISK} FROM wf GROUP BY 1, 2",
)
def walk_forward_metrics(spark, sf):
    t, _ = traded(spark, sf)
    t = t.withColumn("_all", F.lit(0))
    d = lb.walk_forward_rows(t, EventOrder(keys=("_all",)).measured(t))
    return d.groupBy("period", "role").agg(*[c.alias(n) for n, c in bt.risk_aggregates().items()])


@query(
    "walk_forward_averages",
    "role",
    "wf_sharpe wf_win_rate",
    f"WITH {MBO_SQL}, {_BT}, wfx AS (SELECT * FROM pb), {_WFR.replace('AS rn FROM mbo', 'AS rn FROM wfx')}, g AS (SELECT period, role, {_RISK} FROM wf GROUP BY 1, 2) SELECT role, avg(sharpe) AS wf_sharpe, avg(win_rate) AS wf_win_rate FROM g GROUP BY 1",
)
def walk_forward_averages(spark, sf):
    return bt.averaged(walk_forward_metrics(spark, sf), ["role"], ["sharpe", "win_rate"], "wf")


@query(
    "bootstrap_sharpe",
    "",
    "sharpe_p05 sharpe_p50 sharpe_p95",
    f"""WITH {MBO_SQL}, {_BT}, b AS (SELECT instrument || '|' || CAST(trade_date AS VARCHAR) AS k, count(*) AS n, sum(pnl) AS s, sum(pnl * pnl) AS q FROM pe GROUP BY 1),
    u AS (SELECT b.*, r, CAST('0x' || substr(md5('42:' || r || ':' || k), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM b, range(1000) t(r)),
    w AS (SELECT *, {' + '.join(f"CAST(u >= {c!r}::DOUBLE AS INTEGER)" for c in bt._DRAWS)} AS w FROM u),
    m AS (SELECT r, sum(w * n) AS n, sum(w * s) AS s, sum(w * q) AS q FROM w GROUP BY r HAVING sum(w * n) > 0),
    h AS (SELECT s / n / (sqrt(greatest(q / n - pow(s / n, 2), 0)) + 1e-9) * sqrt(252) AS x FROM m)
    SELECT quantile_cont(x, 0.05) AS sharpe_p05, quantile_cont(x, 0.5) AS sharpe_p50, quantile_cont(x, 0.95) AS sharpe_p95 FROM h""",
    digits=6,
)
def bootstrap_sharpe(spark, sf):
    """Days of an instrument are drawn together."""
    return bt.bootstrap_sharpe(traded(spark, sf)[0], "pnl", ["instrument", "trade_date"])


_PAIRS = f"""fl AS (SELECT *, row_number() OVER ({W}) AS rn FROM mbo WHERE action = 'F' AND side <> 'N'), pr AS (SELECT instrument, (rn - 1) // 2 AS pair, arg_min(side, rn) AS s1, arg_max(side, rn) AS s2, arg_min(price, rn) AS p1, arg_max(price, rn) AS p2, arg_min(size, rn) AS q, count(*) AS n FROM fl GROUP BY 1, 2),
    pp AS (SELECT *, CASE WHEN s1 = 'B' THEN 1 ELSE -1 END * (p2 - p1) * q AS pnl FROM pr WHERE n = 2 AND s1 <> s2)"""


def sided_fills(spark, sf):
    m = mbo(spark, sf).filter("action = 'F' AND side <> 'N'")
    return m, mbo_order(m)


@query(
    "trade_pairs_pnl",
    "instrument pair side size",
    "entry_price exit_price pnl",
    f"WITH {MBO_SQL}, {_PAIRS} SELECT instrument, pair, s1 AS side, q AS size, p1 AS entry_price, p2 AS exit_price, pnl FROM pp",
)
def trade_pairs_pnl(spark, sf):
    return bt.trade_pairs(*sided_fills(spark, sf))


@query(
    "trade_pair_statistics",
    "instrument trades wins losses",
    "avg_pnl avg_win avg_loss win_rate profit_factor",
    f"""WITH {MBO_SQL}, {_PAIRS} SELECT instrument, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, avg(pnl) AS avg_pnl, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win,
      coalesce(avg(pnl) FILTER (pnl < 0), 0) AS avg_loss, count(*) FILTER (pnl > 0) / count(*) AS win_rate, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS profit_factor FROM pp GROUP BY 1""",
)
def trade_pair_statistics(spark, sf):
    return bt.trade_statistics(bt.trade_pairs(*sided_fills(spark, sf)), ["instrument"])


@query(
    "equity_daily_risk",
    "instrument",
    "total_return sharpe max_drawdown volatility var_95 cvar_95",
    f"""WITH {MBO_SQL}, {_BT}, eq AS (SELECT instrument, trade_date, ts_event, sequence, 100000 + equity AS e FROM pe), r AS (SELECT *, coalesce(e / lag(e) OVER ({W}) - 1, 0) AS ret, max(e) OVER {span(None, 0)} AS pk FROM eq),
    dy AS (SELECT instrument, trade_date, sum(ret) AS dr FROM r GROUP BY 1, 2), v AS (SELECT instrument, quantile_cont(dr, 0.05) AS var_95 FROM dy GROUP BY 1),
    w AS (SELECT instrument, arg_max(e, (ts_event, sequence)) / 100000 - 1 AS total_return, abs(min((e - pk) / pk)) AS max_drawdown FROM r GROUP BY 1)
    SELECT instrument, total_return, max_drawdown, avg(dr) / stddev_samp(dr) * sqrt(252) AS sharpe, stddev_samp(dr) * sqrt(252) AS volatility, max(var_95) AS var_95, avg(dr) FILTER (dr <= var_95) AS cvar_95
    FROM dy JOIN v USING (instrument) JOIN w USING (instrument) GROUP BY ALL""",
    digits=6,
)
def equity_daily_risk(spark, sf):
    t, o = traded(spark, sf)
    return bt.equity_risk(t.withColumn("equity", F.col("equity") + 100000.0), o, 100000.0)


@query(
    "position_average_cost",
    "instrument sequence position",
    "avg_price trade_pnl realized_pnl",
    f"""WITH RECURSIVE {MBO_SQL}, f AS (SELECT instrument, sequence, price, CASE WHEN side = 'B' THEN size ELSE -size END AS q, row_number() OVER ({W}) AS rn FROM mbo WHERE action = 'F' AND side <> 'N'),
    p AS (
      SELECT instrument, sequence, rn, CAST(q AS BIGINT) AS position, price AS avg_price, 0.0::DOUBLE AS trade_pnl, 0.0::DOUBLE AS realized_pnl FROM f WHERE rn = 1
      UNION ALL
      SELECT f.instrument, f.sequence, f.rn, p.position + f.q,
        CASE WHEN p.position + f.q = 0 THEN 0 WHEN p.position * f.q >= 0 THEN (abs(p.position) * p.avg_price + abs(f.q) * f.price) / abs(p.position + f.q)
          WHEN p.position * (p.position + f.q) > 0 THEN p.avg_price ELSE f.price END,
        CASE WHEN p.position * f.q >= 0 THEN 0 ELSE least(abs(f.q), abs(p.position)) * sign(p.position) * (f.price - p.avg_price) END,
        p.realized_pnl + CASE WHEN p.position * f.q >= 0 THEN 0 ELSE least(abs(f.q), abs(p.position)) * sign(p.position) * (f.price - p.avg_price) END
      FROM p JOIN f ON f.instrument = p.instrument AND f.rn = p.rn + 1
    ) SELECT * FROM p""",
)
def position_average_cost(spark, sf):
    m, o = sided_fills(spark, sf)
    return bt.positions(m, o).withColumn("position", F.col("position").cast("long"))


@query(
    "order_costs",
    "instrument sequence",
    "fill_price slippage commission market_impact",
    f"""WITH {ALL_SQL}, q AS (SELECT instrument, ts_event, best_bid, best_ask FROM bk), o AS (SELECT instrument, sequence, ts_event, side, size, CASE WHEN sequence % 3 <> 0 THEN price END AS lim FROM mbo WHERE action = 'F' AND side <> 'N'),
    j AS (SELECT o.*, CASE WHEN side = 'B' THEN best_ask ELSE best_bid END AS qt FROM o ASOF LEFT JOIN q ON o.instrument = q.instrument AND o.ts_event >= q.ts_event),
    f AS (SELECT *, CASE WHEN qt IS NULL THEN NULL WHEN lim IS NULL THEN qt + CASE WHEN side = 'B' THEN {TICK} ELSE -{TICK} END WHEN side = 'B' AND qt <= lim THEN least(lim, qt) WHEN side = 'A' AND qt >= lim THEN greatest(lim, qt) END AS fp FROM j)
    SELECT instrument, sequence, fp AS fill_price, CASE WHEN fp IS NOT NULL THEN CASE WHEN lim IS NULL THEN {TICK} ELSE 0 END END AS slippage, CASE WHEN fp IS NOT NULL THEN size * 2.5 END AS commission, CASE WHEN fp IS NOT NULL THEN 0.01 * sqrt(size) END AS market_impact FROM f""",
)
def order_costs(spark, sf):
    b, o = the_book(spark, sf, 0)
    f = mbo(spark, sf).filter("action = 'F' AND side <> 'N'")
    f = f.select("instrument", "sequence", "ts_event", "side", "size", F.when(F.col("sequence") % 3 != 0, F.col("price")).alias("limit_price"))
    q = b.select("instrument", "ts_event", "sequence", "best_bid", "best_ask")
    return bt.priced_orders(f, q, o, 2.5, 0.01, "square_root", F.lit(TICK))


@query(
    "execution_quality",
    "instrument orders volume",
    "avg_slippage avg_market_impact fill_rate",
    f"""WITH {ALL_SQL}, q AS (SELECT instrument, ts_event, best_bid, best_ask FROM bk), o AS (SELECT instrument, sequence, ts_event, side, size, CASE WHEN sequence % 3 <> 0 THEN price END AS lim FROM mbo WHERE action = 'F' AND side <> 'N'),
    j AS (SELECT o.*, CASE WHEN side = 'B' THEN best_ask ELSE best_bid END AS qt FROM o ASOF LEFT JOIN q ON o.instrument = q.instrument AND o.ts_event >= q.ts_event),
    f AS (SELECT *, qt IS NOT NULL AND (lim IS NULL OR (side = 'B' AND qt <= lim) OR (side = 'A' AND qt >= lim)) AS ok FROM j)
    SELECT instrument, count(*) AS orders, CAST(coalesce(sum(size) FILTER (ok), 0) AS BIGINT) AS volume, avg(CASE WHEN lim IS NULL THEN {TICK} ELSE 0 END) FILTER (ok) AS avg_slippage, avg(0.01 * sqrt(size)) FILTER (ok) AS avg_market_impact, avg(CASE WHEN ok THEN 1 ELSE 0 END) AS fill_rate FROM f GROUP BY 1""",
    digits=7,
)
def execution_quality(spark, sf):
    return bt.execution_quality(order_costs(spark, sf), ["instrument"])


_DAYNS = 86_400_000_000_000
_EXIT = f"""nb AS (SELECT instrument, sequence, ts_event, side, price, row_number() OVER ({W}) AS rn FROM mbo), en AS (SELECT n.* FROM nb n JOIN mbo m USING (instrument, sequence) WHERE m.action = 'F' AND m.side <> 'N'),
    ht AS (SELECT e.instrument, e.sequence, min(CASE WHEN CASE WHEN e.side = 'B' THEN t.price <= e.price - 2 ELSE t.price >= e.price + 2 END THEN t.rn END) AS sh, min(CASE WHEN CASE WHEN e.side = 'B' THEN t.price >= e.price + 3 ELSE t.price <= e.price - 3 END THEN t.rn END) AS th, max(t.rn) AS lst
      FROM en e LEFT JOIN nb t ON t.instrument = e.instrument AND t.rn > e.rn AND t.ts_event <= e.ts_event + {_DAYNS} GROUP BY 1, 2),
    ex AS (SELECT e.*, CASE WHEN sh IS NULL AND th IS NULL THEN 'time_limit' WHEN th IS NULL OR sh < th THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason, coalesce(least(sh, th), lst, e.rn) AS xr FROM en e JOIN ht ON e.instrument = ht.instrument AND e.sequence = ht.sequence),
    tr AS (SELECT ex.*, x.ts_event AS exit_ts, x.price AS exit_price, CASE WHEN ex.side = 'B' THEN 1 ELSE -1 END * (x.price - ex.price) / {TICK} AS pnl_ticks FROM ex JOIN nb x ON x.instrument = ex.instrument AND x.rn = ex.xr)"""


def exits(spark, sf):
    m = mbo(spark, sf)
    o = mbo_order(m)
    go = (F.col("action") == "F") & (F.col("side") != "N")
    return bt.barrier_exits(m.withColumn("go", go), o, "go", "side", 2.0, 3.0, _DAYNS, TICK), o


@query(
    "barrier_exits",
    "instrument sequence exit_reason exit_ts",
    "exit_price pnl_ticks pnl_dollars",
    f"WITH {MBO_SQL}, {_EXIT} SELECT instrument, sequence, exit_reason, exit_ts, exit_price, pnl_ticks, pnl_ticks * 12.5 AS pnl_dollars FROM tr",
)
def barrier_exits(spark, sf):
    return exits(spark, sf)[0]


@query(
    "trade_history_summary",
    "instrument total_trades winning_trades losing_trades",
    "total_pnl_dollars avg_win_dollars avg_loss_dollars max_drawdown sharpe_ratio sortino_ratio calmar_ratio var_95 cvar_95 profit_factor return_pct",
    f"""WITH {MBO_SQL}, {_EXIT}, d AS (SELECT *, pnl_ticks * 12.5 AS x, 10000000 + sum(pnl_ticks * 12.5) OVER {span(None, 0)} AS v FROM tr), r AS (SELECT *, x / (v - x) AS r FROM d), q AS (SELECT instrument, quantile_cont(r, 0.05) AS var_95 FROM r GROUP BY 1),
    g AS (SELECT instrument, count(*) AS total_trades, count(*) FILTER (x > 0) AS winning_trades, count(*) FILTER (x < 0) AS losing_trades, sum(x) AS total_pnl_dollars, avg(x) FILTER (x > 0) AS avg_win_dollars, avg(x) FILTER (x < 0) AS avg_loss_dollars,
      greatest(max(v), 10000000) AS pk, arg_max(v, (ts_event, sequence)) AS fin, avg(r) AS mu, stddev_pop(r) AS sd, stddev_pop(r) FILTER (r < 0) AS dn, max(var_95) AS var_95, avg(r) FILTER (r <= var_95) AS cvar_95, sum(x) FILTER (x > 0) / -sum(x) FILTER (x < 0) AS profit_factor FROM r JOIN q USING (instrument) GROUP BY 1)
    SELECT *, (pk - fin) / pk AS max_drawdown, mu / sd * sqrt(252) AS sharpe_ratio, mu / dn * sqrt(252) AS sortino_ratio, CASE WHEN pk > fin THEN mu * 252 / ((pk - fin) / pk) ELSE 0 END AS calmar_ratio, (fin - 10000000) / 10000000 * 100 AS return_pct FROM g""",
    digits=6,
)
def trade_history_summary(spark, sf):
    t, o = exits(spark, sf)
    return bt.trade_history_summary(t, o, ["instrument"], 10_000_000.0)


@query(
    "strategy_performance",
    "strategy total_trades wins losses",
    "total_pnl win_rate avg_pnl_per_trade",
    f"""WITH {MBO_SQL}, {_EXIT} SELECT side || '-' || exit_reason AS strategy, count(*) AS total_trades, count(*) FILTER (pnl_ticks > 0) AS wins, count(*) FILTER (pnl_ticks <= 0) AS losses, sum(pnl_ticks * 12.5) AS total_pnl,
      count(*) FILTER (pnl_ticks > 0) / count(*) AS win_rate, avg(pnl_ticks * 12.5) AS avg_pnl_per_trade FROM tr GROUP BY 1""",
    digits=6,
)
def strategy_performance(spark, sf):
    t = exits(spark, sf)[0].withColumn("strategy", F.concat_ws("-", "side", "exit_reason"))
    return bt.strategy_summary(t)


@query(
    "delayed_execution_decay",
    "latency_ms rows",
    "pnl sharpe win_rate",
    f"""WITH {MBO_SQL}, s AS (SELECT instrument, sequence, ts_event, CASE WHEN value > 20 THEN 1 ELSE -1 END AS sg FROM mbo), p AS (SELECT instrument, ts_event, price FROM mbo), l(latency_ms) AS (VALUES (100), (200), (500)),
    a AS (SELECT s.*, latency_ms, ts_event + latency_ms * 1000000 AS at, ts_event + 7200000000000 AS fin FROM s, l),
    b AS (SELECT a.*, p.price AS px FROM a ASOF LEFT JOIN p ON a.instrument = p.instrument AND a.at >= p.ts_event), c AS (SELECT b.*, p.price AS pf FROM b ASOF LEFT JOIN p ON b.instrument = p.instrument AND b.fin >= p.ts_event), t AS (SELECT latency_ms, sg * (pf - px) AS pnl FROM c)
    SELECT latency_ms, {_RISK} FROM t GROUP BY 1""",
)
def delayed_execution_decay(spark, sf):
    m = mbo(spark, sf).withColumn("prediction", F.when(F.col("value") > 20, 1).otherwise(0))
    return bt.delayed_execution(m, mbo_order(m), [100, 200, 500], 7_200_000)


# ---------------------------------------------------------------- evaluation


@query(
    "regression_metrics_by_split",
    "split rows",
    "rmse mae r2",
    f"""WITH {MBO_SQL}, r AS (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY instrument) AS n, avg(price) OVER {rows(20)} AS p FROM mbo), s AS (SELECT *, CASE WHEN rn <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)
    SELECT split, count(*) AS "rows", sqrt(avg((p - price) ** 2)) AS rmse, avg(abs(p - price)) AS mae, 1 - sum((p - price) ** 2) / (var_pop(price) * count(*)) AS r2 FROM s GROUP BY 1""",
)
def regression_metrics_by_split(spark, sf):
    from tickloom.order import windowed

    m = mbo(spark, sf)
    o = mbo_order(m)
    d = windowed(m, o, lambda x, f: x.withColumn("p", F.avg("price").over(f.rows(20))), before=20)
    return md.regression_metrics(lb.time_split(d, o), "p", "price", ["split"])


@query(
    "financial_metrics",
    "instrument total_trades profitable_trades",
    "total_return volatility sharpe_ratio max_drawdown win_rate profit_factor avg_win avg_loss var_95 cvar_95 calmar_ratio sortino_ratio",
    f"""WITH {MBO_SQL}, x AS (SELECT *, (price - lag(price) OVER ({W})) / lag(price) OVER ({W}) AS act, (value - 20) / 7 AS pred FROM mbo), c AS (SELECT *, stddev_pop(pred) OVER (PARTITION BY instrument) * 0.5 AS cut FROM x),
    p AS (SELECT *, CASE WHEN pred > cut THEN 1.0 WHEN pred < -cut THEN -1.0 ELSE 0 END AS pos FROM c), r AS (SELECT *, coalesce(coalesce(lag(pos) OVER ({W}), 0) * act, 0) AS r FROM p),
    u AS (SELECT *, sum(r) OVER {span(None, 0)} AS cum FROM r), k AS (SELECT *, max(cum) OVER {span(None, 0)} AS pk FROM u), v AS (SELECT instrument, quantile_cont(r, 0.05) AS var_95 FROM r GROUP BY 1),
    g AS (SELECT instrument, sum(r) AS total_return, stddev_pop(r) AS volatility, min(cum - pk) AS max_drawdown, count(*) FILTER (r > 0) AS profitable_trades, count(*) FILTER (r <> 0) AS total_trades, avg(r) FILTER (r > 0) AS avg_win, avg(r) FILTER (r < 0) AS avg_loss,
      sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS profit_factor, stddev_pop(r) FILTER (r < 0) AS dn, max(var_95) AS var_95, avg(r) FILTER (r <= var_95) AS cvar_95 FROM k JOIN v USING (instrument) GROUP BY 1)
    SELECT *, total_return / volatility AS sharpe_ratio, profitable_trades / total_trades AS win_rate, total_return / abs(max_drawdown) AS calmar_ratio, total_return / dn AS sortino_ratio FROM g""",
)
def financial_metrics(spark, sf):
    from tickloom.functions.cols import pct_change
    from tickloom.order import windowed

    m = mbo(spark, sf).withColumn("pred", (F.col("value") - 20) / 7)
    o = mbo_order(m)
    d = windowed(m, o, lambda x, f: x.withColumn("act", pct_change("price", f)), before=1)
    return md.financial_metrics(d, o, "pred", "act")


@query(
    "prediction_accuracy",
    "instrument n",
    "direction price overall",
    f"""WITH {MBO_SQL}, a AS (SELECT instrument, price - 110 AS ad, price AS ap, CASE WHEN sequence % 2 = 0 THEN 1 ELSE -1 END AS pd, price * (1 + (size - 50) / 100) AS pt FROM mbo),
    s AS (SELECT *, CASE WHEN pd * ad > 0 THEN 1 ELSE 0 END AS d, CASE WHEN pt > 0 THEN greatest(0, 1 - abs(ap - pt) / pt) ELSE 0 END AS p FROM a) SELECT instrument, count(*) AS n, avg(d) AS direction, avg(p) AS price, avg((d + p) / 3) AS overall FROM s GROUP BY 1""",
)
def prediction_accuracy(spark, sf):
    m = mbo(spark, sf).select(
        "instrument",
        F.when(F.col("sequence") % 2 == 0, 1).otherwise(-1).alias("predicted_direction"),
        (F.col("price") * (1 + (F.col("size") - 50) / 100)).alias("price_target"),
        (F.col("price") - 110).alias("actual_direction"),
        F.col("price").alias("actual_price"),
    )
    d = md.prediction_accuracy(m)
    return d.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("n"), F.avg("direction_accuracy").alias("direction"), F.avg("price_accuracy").alias("price"), F.avg("overall_accuracy").alias("overall")
    )


_MODELS = "SELECT sequence, instrument, ts_event, price, unnest(['lgb', 'lstm', 'tf', 'other']) AS model, unnest([(size - 50) / 50, (flags - 128) / 128, sin(value), 0.1]) AS direction, unnest([(size - 50) / 5000, (flags - 128) / 12800, sin(value) / 100, 0.0]) AS price_change, unnest([size / 100, flags / 256, 0.7, 0.9]) AS confidence FROM mbo"
_ENS = f"""mp AS ({_MODELS}), wt(model, weight) AS (VALUES ('lgb', 50), ('lstm', 30), ('tf', 20)),
    es AS (SELECT sequence, count(*) AS models, sum(direction * weight) / sum(weight) AS direction, sum(price_change * weight) / sum(weight) AS price_change, sum(confidence * weight) / sum(weight) AS confidence FROM mp JOIN wt USING (model) GROUP BY 1)"""


def combined(spark, sf):
    m = mbo(spark, sf)
    p = lambda name, d, c, k: F.struct(F.lit(name).alias("model"), d.alias("direction"), c.alias("price_change"), k.alias("confidence"))
    s, g, v = F.col("size"), F.col("flags"), F.sin("value")
    preds = m.select(
        "sequence",
        F.explode(
            F.array(
                p("lgb", (s - 50) / 50, (s - 50) / 5000, s / 100), p("lstm", (g - 128) / 128, (g - 128) / 12800, g / 256),
                p("tf", v, v / 100, F.lit(0.7)), p("other", F.lit(0.1), F.lit(0.0), F.lit(0.9)),
            )
        ).alias("m"),
    ).select("sequence", "m.*")
    w = spark.createDataFrame([("lgb", 50.0), ("lstm", 30.0), ("tf", 20.0)], "model string, weight double")
    return m, md.ensemble(preds, w, ["sequence"])


@query(
    "ensemble_weighted",
    "sequence models",
    "direction price_change confidence price_target stop_loss take_profit",
    f"""WITH {MBO_SQL}, {_ENS} SELECT es.*, price * (1 + price_change) AS price_target, CASE WHEN direction > 0 THEN price - 2.5 ELSE price + 2.5 END AS stop_loss, CASE WHEN direction > 0 THEN price + 5 ELSE price - 5 END AS take_profit FROM es JOIN mbo USING (sequence)""",
    digits=9,
)
def ensemble_weighted(spark, sf):
    m, e = combined(spark, sf)
    return md.trade_levels(e.join(m.select("sequence", "price"), "sequence"), "price", TICK, 10, 20)


@query(
    "strategy_and_gates",
    "sequence strategy reason should_trade alpha_reason alpha_action quantity",
    "execution_price",
    f"""WITH {MBO_SQL}, {_ENS}, s AS (SELECT es.*, price, size / 100 AS ab, (flags % 100) / 100 AS ob, CASE WHEN size % 2 = 0 THEN price - 3 END AS sup, CASE WHEN size % 3 = 0 THEN price + 3 END AS res, (flags % 90) / 90 AS pc, 100 * exp(-size / 50) AS al, (size % 30) AS cw FROM es JOIN mbo USING (sequence)),
    g AS (SELECT *, ab > 0.6 OR ob > 0.6 AS pat FROM s)
    SELECT sequence, CASE WHEN direction > 0 THEN CASE WHEN pat THEN 'buy_limit' WHEN confidence > 0.8 THEN 'buy_market' ELSE 'buy_bid' END ELSE CASE WHEN pat THEN 'sell_limit' WHEN confidence > 0.8 THEN 'sell_market' ELSE 'sell_bid' END END AS strategy,
      CASE WHEN direction > 0 THEN CASE WHEN pat THEN coalesce(sup, price - 1.25) WHEN confidence > 0.8 THEN price + 0.25 ELSE price - 0.25 END ELSE CASE WHEN pat THEN coalesce(res, price + 1.25) WHEN confidence > 0.8 THEN price - 0.25 ELSE price + 0.25 END END AS execution_price,
      CASE WHEN confidence < 0.6 THEN 'confidence' WHEN abs(direction) < 0.3 THEN 'direction' WHEN pc < 0.3 THEN 'pattern' ELSE 'ok' END AS reason, confidence >= 0.6 AND abs(direction) >= 0.3 AND pc >= 0.3 AS should_trade,
      CASE WHEN al < 30 THEN 'alpha' WHEN cw < 10 THEN 'window' WHEN confidence < 0.6 THEN 'confidence' WHEN abs(direction) < 0.3 THEN 'direction' ELSE 'ok' END AS alpha_reason,
      CASE WHEN al >= 30 AND cw >= 10 AND confidence >= 0.6 AND abs(direction) >= 0.3 THEN CASE WHEN direction > 0 THEN 'buy' ELSE 'sell' END END AS alpha_action,
      CASE WHEN pat AND ob > 0.9 THEN 0 WHEN confidence < 0.55 THEN 0 WHEN pc < 0.1 THEN 1 WHEN confidence > 0.65 THEN 2 ELSE 1 END AS quantity FROM g""",
)
def strategy_and_gates(spark, sf):
    m, e = combined(spark, sf)
    p, s, g = F.col("price"), F.col("size"), F.col("flags")
    d = e.join(m.select("sequence", "price", "size", "flags"), "sequence").withColumns(
        {
            "absorption_confidence": s / 100,
            "order_block_confidence": (g % 100) / 100,
            "support_level": F.when(s % 2 == 0, p - 3),
            "resistance_level": F.when(s % 3 == 0, p + 3),
            "overall_pattern_confidence": (g % 90) / 90,
            "alpha_remaining": 100 * F.exp(-s / 50),
            "competitive_window_ms": (s % 30).cast("double"),
        }
    )
    d = md.signal_gate(md.choose_strategy(d, "price", TICK))
    a = md.alpha_gate(d.drop("reason")).select("sequence", F.col("reason").alias("alpha_reason"), F.col("action").alias("alpha_action"))
    spoof = ((F.col("absorption_confidence") > 0.6) | (F.col("order_block_confidence") > 0.6)) & (F.col("order_block_confidence") > 0.9)
    d = d.withColumn("quantity", md.order_quantity(F.col("confidence"), F.col("overall_pattern_confidence"), spoof))
    return d.join(a, "sequence")


@query(
    "prediction_velocity_entries",
    "instrument sequence entry_side",
    "velocity",
    f"""WITH {MBO_SQL}, p AS (SELECT *, sin(value) AS p FROM mbo), v AS (SELECT *, coalesce(p - lag(p) OVER ({W}), 0) AS velocity FROM p)
    SELECT instrument, sequence, velocity, CASE WHEN abs(p) >= 0.2 AND abs(velocity) >= 0.1 THEN CASE WHEN p > 0 AND velocity > 0 THEN 'B' WHEN p < 0 AND velocity < 0 THEN 'A' END END AS entry_side FROM v""",
)
def prediction_velocity_entries(spark, sf):
    m = mbo(spark, sf).withColumn("prediction", F.sin("value"))
    return md.prediction_velocity(m, mbo_order(m), 0.2, 0.1)


@query(
    "run_diagnostics",
    "instrument advice",
    "convergence_rate stability_score overfitting_score underfitting_score",
    f"""WITH {MBO_SQL}, r AS (SELECT instrument, list(v ORDER BY trade_date) AS l, max(ta) AS ta, max(va) AS va FROM (SELECT instrument, trade_date, avg(size) AS v, max(price) / 250 AS ta, min(value + 60) / 100 AS va FROM mbo GROUP BY 1, 2) GROUP BY 1),
    d AS (SELECT *, (l[1] - l[-1]) / l[1] AS cr, 1 / (1 + list_var_pop(l[-10:])) AS ss, greatest(0, (ta - va) / ta) AS o, CASE WHEN va < 0.8 THEN (0.8 - va) / 0.8 ELSE 0 END AS u FROM r)
    SELECT instrument, cr AS convergence_rate, ss AS stability_score, o AS overfitting_score, u AS underfitting_score, CASE WHEN o > 0.2 THEN 'add regularisation or data' WHEN u > 0.3 THEN 'raise capacity or add features' WHEN cr < 0.1 THEN 'raise the learning rate or train longer' ELSE 'no change' END AS advice FROM d""",
)
def run_diagnostics(spark, sf):
    daily = mbo(spark, sf).groupBy("instrument", "trade_date").agg(
        F.avg("size").alias("v"), (F.max("price") / 250).alias("ta"), (F.min(F.col("value") + 60) / 100).alias("va")
    )
    r = daily.groupBy("instrument").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("trade_date", "v"))), lambda x: x["v"]).alias("losses"),
        F.max("ta").alias("train_accuracy"),
        F.max("va").alias("val_accuracy"),
    )
    return md.run_diagnostics(r)


_MI = [("price", 10), ("size", 10)]


@query(
    "mutual_information",
    "feature",
    "mutual_information",
    f"WITH {MBO_SQL}, "
    + ", ".join(
        f"""e{c} AS (SELECT list_distinct(quantile_cont({c}, [{', '.join(str(i / 10) for i in range(11))}])) AS e FROM mbo), b{c} AS (SELECT least(greatest(len([x for x in e if x < {c}]) - 1, 0), len(e) - 2) AS bin, action AS y, count(*) AS n FROM mbo, e{c} GROUP BY 1, 2)"""
        for c, _ in _MI
    )
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, sum(n / t * ln(n * t / (px * py))) AS mutual_information FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY bin) AS px, sum(n) OVER (PARTITION BY y) AS py FROM b{c})"
        for c, _ in _MI
    ),
    digits=6,
)
def mutual_information(spark, sf):
    return md.mutual_information(mbo(spark, sf), ["price", "size"], "action")


@query(
    "feature_stability",
    "feature",
    "mean_score stability",
    f"""WITH {MBO_SQL}, s AS (SELECT trade_date, unnest(['price', 'size', 'flags']) AS feature, unnest([abs(corr(price, value)), abs(corr(size, value)), abs(corr(flags, value))]) AS score FROM mbo GROUP BY 1)
    SELECT feature, avg(score) AS mean_score, 1 / (1 + stddev_pop(score) / (abs(avg(score)) + 1e-8)) AS stability FROM s GROUP BY 1""",
)
def feature_stability(spark, sf):
    per = mbo(spark, sf).groupBy("trade_date").agg(*[F.abs(F.corr(c, "value")).alias(c) for c in ("price", "size", "flags")])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("score")) for c in ("price", "size", "flags")]))
    return md.stability(per.select(pairs.alias("p")).select("p.*"))


_FEATS = ["price_ma_15r", "price_std_15r", "vol_ma_15r", "price_momentum_5r", "order_flow_imbalance_ma"]


def _training(spark, sf):
    m = mbo(spark, sf)
    o = mbo_order(m).spread(m)
    d = lb.time_split(lb.horizon_targets(m, o, (1, 5)), o)  # targets and split read few columns
    d = of.order_flow(d, o, ["imbalance", "statistics", "momentum"])
    keep = ["instrument", "sequence", "split", "price_return_1r", "price_return_5r", "price_direction_5r", *_FEATS]
    return pin(d.select(*keep).na.drop())  # fits read it many times


@query("gbt_regression_by_horizon", "split horizon rows", "rmse mae r2")
def gbt_regression_by_horizon(spark, sf):
    d = _training(spark, sf)
    train = d.filter("split = 'train'").persist()
    models = md.train_horizons(train, _FEATS, ["price_return_1r", "price_return_5r"], maxIter=3, maxDepth=3)
    scored = md.score(d, models)
    parts = [
        md.regression_metrics(scored, f"pred_{t}", t, ["split"]).withColumn("horizon", F.lit(t)) for t in models
    ]
    train.unpersist()
    return parts[0].unionByName(parts[1])


@query("gbt_direction_accuracy", "split n", "accuracy")
def gbt_direction_accuracy(spark, sf):
    d = _training(spark, sf)
    model = md.train_direction(d.filter("split = 'train'"), _FEATS, "price_direction_5r", maxIter=3, maxDepth=3)
    s = model.transform(d)
    return s.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("price_direction_5r")).cast("double")).alias("accuracy")
    )


@query("forest_feature_importance", "feature", "importance")
def forest_feature_importance(spark, sf):
    return md.forest_importance(_training(spark, sf), _FEATS, "price_return_5r", numTrees=5, maxDepth=3)


@query("tuned_regressor_metrics", "split rows", "rmse mae r2")
def tuned_regressor_metrics(spark, sf):
    d = _training(spark, sf)
    best = md.tuned_regressor(d.filter("split = 'train'"), _FEATS, "price_return_5r", [2, 3], [0.1], folds=2)
    return md.regression_metrics(best.transform(d), "prediction", "price_return_5r", ["split"])


@query(
    "feature_category_counts",
    "family columns filled",
    "",
    f"""WITH {MBO_SQL}, n AS (SELECT count(*) AS c FROM mbo) SELECT * FROM (VALUES ('volume', 1), ('pattern', 0), ('imbalance', 0), ('momentum', 0), ('risk', 0), ('microstructure', 0)) AS t(family, columns), (SELECT c AS filled FROM n)""",
)
def feature_category_counts(spark, sf):
    m = mbo(spark, sf)
    groups = md.feature_categories(m.columns)
    rows_ = [F.struct(F.lit(k).alias("family"), F.lit(len(v)).alias("columns")) for k, v in groups.items()]
    return m.agg(F.count(F.lit(1)).alias("filled")).select(F.explode(F.array(*rows_)).alias("r"), "filled").select("r.*", "filled")


@query(
    "cross_model_means",
    "o_orderpriority n",
    "mean_o_totalprice",
    "SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean_o_totalprice FROM orders GROUP BY 1",
)
def cross_model_means(spark, sf):
    return md.model_means(table(spark, sf, "orders"), ["o_orderpriority"], ["o_totalprice"])
