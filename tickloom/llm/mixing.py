"""Mixing sources to target weights by systematic sampling.

Within a source the expected copies of its documents are summed from the largest document
to the smallest, one random offset is added, and a document is taken once for every integer
the sum crosses at it. Sums are integers in units of 2^-24, so no document crosses more
than the expected copies rounded up.

A few documents may hold most words of a source. The ``FIRST`` largest therefore get as
expected copies what is still to be taken over what is still to come: what one of them
misses or exceeds is spread over those behind it. Behind them the quotient stays as it is.
Taken words differ from the target by about the largest document behind the first ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.frames import by_position, pick, position
from tickloom.llm.numbering import numbered
from tickloom.session import pin

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 2024
FIRST = 64
UNIT_BITS = 24
WORD = r"[^\x20\x09-\x0D]+"


def _source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point, null last."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def _draw(text: Column, digits: int) -> Column:
    """The first hex digits of the SHA-256 of the seed and a text, as an integer."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), text), 256), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, size) of sources with weight and target.

    Weights repeat over the sources in key order. Together they share ``share`` of all sizes;
    a target stops at ``most`` times its source's size and the excess is shared again by
    weight until none is above. Two sums reach the driver a round.
    """
    ranked = numbered(sizes, [], [F.col("key")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = pin(ranked.withColumns({"weight": weight, "most": F.lit(float(most)) * F.col("size")}).drop("n"))
    whole = table.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    total, each, capped = float(share) * (whole["size"] or 0), 0.0, None
    while True:
        full = F.col("most") <= each * F.col("weight")
        held = table.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most"))).alias("words"), F.sum(F.when(full, F.col("weight"))).alias("weight")).first()
        left = (whole["weight"] or 0.0) - (held["weight"] or 0.0)
        if held["n"] == capped or left <= 0:
            break
        capped, each = held["n"], max((total - (held["words"] or 0.0)) / left, each)
    return table.withColumn("target", F.least("most", F.lit(each) * F.col("weight")))


def _first_places(first: Column, target: Column, size: Column, offset: Column, most: float) -> Column:
    """Running sums at the first documents and the step behind them, by a fold over their sizes."""
    unit = 1 << UNIT_BITS

    def step(words: Column, left: Column) -> Column:
        wanted = F.when(left > 0, F.greatest(F.least(words / left, F.lit(float(most))), F.lit(0.0))).otherwise(0.0)
        return F.floor(wanted * F.lit(float(unit)))

    def taken(state: Column, one: Column) -> Column:
        at = state["places"][F.size(state["places"]) - 1]
        now = at + step(state["words"], state["left"])
        copies = F.shiftright(now, UNIT_BITS) - F.shiftright(at, UNIT_BITS)
        return F.struct(
            (state["words"] - copies * one).alias("words"), (state["left"] - one).alias("left"), F.concat(state["places"], F.array(now)).alias("places")
        )

    start = F.struct(target.alias("words"), size.cast("double").alias("left"), F.array(offset).alias("places"))
    return F.aggregate(first, start, taken, lambda s: F.struct(s["places"].alias("places"), step(s["words"], s["left"]).alias("step")))


def _copies(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(doc_id, key, size, tie, ...) with source_size, target and copies."""
    sizes = pin(rows.groupBy("key").agg(F.sum("size").alias("size")))
    order = [F.col("size").desc(), F.col("draw"), F.col("doc_id"), F.col("tie"), F.col("row")]
    placed = numbered(rows, ["key"], order)
    head = placed.where(F.col("n") <= FIRST).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "size"))), lambda x: x["size"].cast("double")).alias("first"))
    about = targets(sizes, weights, share, most).withColumnRenamed("size", "source_size").join(head, "key")
    offset = _draw(F.col("key.name"), UNIT_BITS // 4)
    about = pin(about.select("key", "source_size", "target", _first_places(F.col("first"), F.col("target"), F.col("source_size"), offset, most).alias("fold")))
    out = placed.join(about, "key")
    places, behind = F.col("fold.places"), F.col("n") - FIRST

    def place(n: Column) -> Column:  # places[0] is the offset
        late = F.element_at(places, -1) + (n - FIRST) * F.col("fold.step")
        return F.when(n <= FIRST, F.get(places, n.cast("int"))).otherwise(late)

    crossed = F.shiftright(place(F.col("n")), UNIT_BITS) - F.shiftright(place(F.col("n") - 1), UNIT_BITS)
    return out.withColumn("copies", F.when(F.col("size") > 0, crossed).otherwise(F.lit(0)).cast("long"))


def _rows(docs: DataFrame) -> DataFrame:
    columns = {
        "key": _source_key(F.col("source")),
        "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "draw": _draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8),
        "tie": F.xxhash64("text"),
        "row": F.monotonically_increasing_id(),
    }
    return docs.withColumns(columns)


def mix_sizes(
    df: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target, copies, taken.

    Size is the number of words (space and bytes 9 to 13 separate them); null, empty and blank
    texts have size 0 and are not taken. A null source is a source of its own, after all others.
    Rows of equal size follow a hash of their id, then id and text, so reruns agree; null ids are
    like any other; repeated rows are rows of their own. A source without words has target 0. An
    empty table gives no rows. Other columns are not read. No text leaves its task.
    """
    docs = _rows(pick(df, doc_id=id_col, text=text_col, source=source_col))
    out = _copies(pin(docs.drop("text", "source")), weights, share, most)
    source = F.when(~F.col("key.none"), F.col("key.name"))
    return out.select("doc_id", source.alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(
    df: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: rows of ``df`` with their columns, each as often as ``mix_sizes`` takes it.

    Whole rows go through the one shuffle by size; ties and odd rows are as there.
    """
    flat = by_position(df)
    at = {name: F.col(f"_{position(df, old)}") for name, old in (("doc_id", id_col), ("text", text_col), ("source", source_col))}
    rows = _rows(flat.withColumns(at)).drop("text", "source")
    out = _copies(pin(rows), weights, share, most).where(F.col("copies") > 0)
    repeated = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*flat.columns).toDF(*df.columns)
