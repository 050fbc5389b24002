"""Workers hold a stretch of a long group."""

from support import rows
from tickloom.functions import fast
from tickloom.operators import book
from tickloom.order import EventOrder

ORDER = EventOrder(hot=False)


def test_a_worker_holds_a_stretch_of_a_long_group(spark, frame, monkeypatch):
    columns = ["instrument", "sequence", "best_bid", "best_ask", "bid_total", "ask_sizes", "sweep_levels", "q"]

    def both():
        seen = spark.sparkContext.accumulator(0)

        def fn(g):
            seen.add(len(g["size"]) > 200)  # 100 rows ahead, a batch of 16 beyond the stretch
            return {"q": fast.rolling_quantile(g["size"], 100, 0.5)}

        quotes = book.book_at_events(book.level_book(frame, ORDER), ORDER, 3)
        return rows(fast.per_group(quotes, ORDER.frames(), {"q": "double"}, fn, ["size"], 100), *columns), seen.value

    whole, long = both()
    assert long > 0
    monkeypatch.setattr(fast, "STRETCH_ROWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        cut, long = both()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert long == 0 and cut == whole
