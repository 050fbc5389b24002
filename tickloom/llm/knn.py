"""Exact top-k inner products as a Voronoi k-nearest-neighbour join.

Inner products become distances by one more coordinate: with M the largest length,
x gains sqrt(M^2 - |x|^2) and a query gains 0, so the nearest is the one with the
largest product. Pivots split the vectors into cells. Per cell a summary (radius, the
smallest distances to its pivot) is gathered; from the summaries every group of queries
gets an upper bound of its k-th distance, and a vector is sent to a group only if the
triangle inequality leaves it a chance. Groups are solved in blocks of bounded size and
the blocks' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.frames import few_by_hash, pick
from tickloom.session import pin

PIVOTS = 48
QUERIES_PER_GROUP = 2_048
ROWS_PER_BLOCK = 16_384
SLACK = 1e-6


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as float64 rows (products of up to 2^53 stay exact), short ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass(frozen=True)
class Cells:
    """Pivots in the space with one more coordinate, and the squared length that fills it up."""

    pivots: np.ndarray
    most: float

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", x, x), 0.0))
        return np.concatenate([x, extra[:, None]], axis=1)

    def nearest(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = np.einsum("ij,ij->i", lifted, lifted)[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots)[None] - 2 * lifted @ self.pivots.T
        cell = d2.argmin(axis=1)
        return cell, np.linalg.norm(lifted - self.pivots[cell], axis=1)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as long; rows with a null, an empty or a non-finite vector go."""
    rows = pick(df, vec_id=id_col, v=vector_col).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.forall("v", lambda x: real(x.cast("double"))) & (F.size("v") > 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _in_cells(vectors: DataFrame, cells, width: int, query: bool) -> DataFrame:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            cell, d = cells.value.nearest(cells.value.lift(_matrix(column, width), query))
            yield pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d)], names=["cell", "d"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return vectors.withColumn("c", F.arrow_udf(run, "cell int, d double")("v")).select("vec_id", "v", "c.cell", "c.d")


def _smallest(rows: DataFrame, keep: int) -> list:
    """Per cell: the ``keep`` smallest distances to its pivot, at most one an id; an id stands in one cell only.

    Every distance left is that of a row of an id of its own, so whatever the number of a
    query's own rows, they take one of the places. Rows are salted, so a full cell is shared out.
    """
    alone = rows.groupBy("vec_id").agg(F.min(F.struct("d", "cell")).alias("m")).select("vec_id", "m.cell", "m.d")
    salted = alone.select("cell", F.col("d"), F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("s"))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("cell", "s").orderBy("d"))).where(F.col("r") <= keep)
    return few.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("d")), 1, keep).alias("near")).collect()


def _sent(summary: list, radius: dict[int, float], cells: Cells, k: int) -> dict[int, np.ndarray]:
    """For every query cell: the smallest distance to its pivot that a vector of each data cell must have to be sent."""
    between = np.linalg.norm(cells.pivots[:, None] - cells.pivots[None], axis=2)
    out = {}
    for i, far in radius.items():
        upper = np.sort(np.concatenate([far + between[i, r["cell"]] + np.array(r["near"]) for r in summary]))
        bound = upper[k - 1] if len(upper) >= k else np.inf
        out[i] = between[i] - far - bound
    return out


def top_products(df: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Of every row whose id is divisible by ``every``: its ``k`` largest integer products with other rows.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id, fewer rows
    if there are fewer candidates. Rows with a null id, a null or empty vector, or a null
    or non-finite component take no part; shorter vectors read as padded with zeros.
    Repeated rows are candidates each, but a row never meets its own id, and equal
    query rows are answered once. An empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = pin(integer_vectors(df, id_col, vector_col, scale))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w"), F.max(square).alias("m")).first()
    out = "query_id long, vec_id long, score long"
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = shape["w"]
    first = few_by_hash(vectors, "vec_id", "v", count=4 * PIVOTS).collect()
    chosen = list(dict.fromkeys(tuple(r["v"]) for r in first))[:PIVOTS]
    points = np.array([list(p) + [0] * (width - len(p)) for p in chosen], dtype=np.float64)
    bare = Cells(np.zeros((1, width + 1)), float(shape["m"]))
    cells = Cells(bare.lift(points), float(shape["m"]))
    held = spark.sparkContext.broadcast(cells)
    data = _in_cells(vectors, held, width, query=False)
    asked = _in_cells(vectors.where(F.col("vec_id") % every == 0).distinct(), held, width, query=True)
    summary = _smallest(data, k + 1)  # one more: one row of a query's own id may be among them
    sizes = {r["cell"]: (r["n"], r["far"]) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    need = _sent(summary, {c: far for c, (_, far) in sizes.items()}, cells, k + 1)
    # groups: full cells are split by a hash of the id, small cells share a group with their nearest
    group_of: dict[int, tuple[int, int]] = {}
    bounds, room = [], 0
    for c in sorted(sizes, key=lambda c: tuple(np.linalg.norm(cells.pivots - cells.pivots[c], axis=1))):
        n = sizes[c][0]
        if n > QUERIES_PER_GROUP:
            parts = -(-n // QUERIES_PER_GROUP)
            group_of[c] = (len(bounds), parts)
            bounds += [need[c]] * parts
            room = 0
        elif n > room:
            group_of[c] = (len(bounds), 1)
            bounds.append(need[c])
            room = QUERIES_PER_GROUP - n
        else:
            group_of[c] = (len(bounds) - 1, 1)
            bounds[-1] = np.minimum(bounds[-1], need[c])
            room -= n
    bound = np.array(bounds)
    table = spark.sparkContext.broadcast((bound * (1 - SLACK * np.sign(bound)) - SLACK, group_of))
    blocks = max(1, -(-shape["n"] // ROWS_PER_BLOCK))

    def sent_to(cell: pa.Array, d: pa.Array) -> pa.Array:
        goes = np.asarray(d)[:, None] >= table.value[0].T[np.asarray(cell)]
        offsets = np.concatenate([[0], np.cumsum(goes.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(goes)[1].astype(np.int32)))

    sent_to.__annotations__ = {"cell": pa.Array, "d": pa.Array, "return": pa.Array}

    def group(cell: pa.Array, vec_id: pa.Array) -> pa.Array:
        of = table.value[1]
        return pa.array([of[c][0] + i // every % of[c][1] for c, i in zip(cell.to_pylist(), vec_id.to_pylist())], pa.int32())

    group.__annotations__ = {"cell": pa.Array, "vec_id": pa.Array, "return": pa.Array}
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    left = data.select("vec_id", "v", F.explode(F.arrow_udf(sent_to, "array<int>")("cell", "d")).alias("g"), block.alias("b"))
    right = asked.select("vec_id", "v", F.arrow_udf(group, "int")("cell", "vec_id").alias("g")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def solve(near: pa.Table, ask: pa.Table) -> pa.Table:
        ids, own = np.asarray(near["vec_id"].combine_chunks()), np.asarray(ask["vec_id"].combine_chunks())
        x, q = _matrix(near["v"], width), _matrix(ask["v"], width)
        got: tuple[list, list, list] = ([], [], [])
        for a in range(0, len(q), 256):
            scores = q[a : a + 256] @ x.T if len(x) else np.zeros((min(256, len(q) - a), 0))
            for i, s in enumerate(scores):
                other = ids != own[a + i]
                s, named = s[other], ids[other]
                if len(s) > k:
                    best = np.flatnonzero(s >= np.partition(s, -k)[-k])
                else:
                    best = np.arange(len(s))
                best = best[np.lexsort((named[best], -s[best]))[:k]]
                got[0].append(np.full(len(best), own[a + i]))
                got[1].append(named[best])
                got[2].append(s[best].astype(np.int64))
        return pa.table({n: pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), got)})

    solve.__annotations__ = {"near": pa.Table, "ask": pa.Table, "return": pa.Table}
    local = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(solve, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
