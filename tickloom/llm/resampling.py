"""Target-distribution importance resampling.

Every feature falls into one of ``buckets`` by its checksum; counts of the documents and of
the target texts give each bucket an integer gain, and a text's weight is read from that
array. A score adds Gumbel noise from a hash of the id, so the highest scores are a draw
without replacement in proportion to the weights.

The cutoff of the draw: a quantile sketch gives a bracket around it; exact counts above and
inside the bracket validate it or widen it; only the bracket is sorted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.frames import pick, texts_of
from tickloom.llm.numbering import numbered
from tickloom.llm.word_pieces import Words
from tickloom.session import pin

BUCKETS = 10_000
RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
ACCURACY = 10_000
MEMO = 200_000
BETWEEN = rb"\x00-\x2F\x3A-\x60\x7B-\x7F"


class Features:
    """Bucket counts of the runs of 1 to ``run`` consecutive words of a text."""

    def __init__(self, buckets: int, run: int) -> None:
        self.buckets, self.run, self.words, self.memo = buckets, run, Words(BETWEEN), {}

    def bucket(self, feature: bytes) -> int:
        at = self.memo.get(feature)
        if at is None:
            at = crc32(feature) % self.buckets
            if len(self.memo) < MEMO and len(feature) < 100:
                self.memo[feature] = at
        return at

    def counted(self, text: str | None) -> Iterator[tuple[int, Counter]]:
        """(words, features with their counts) of each piece of a text; runs reach over pieces."""
        carried: list[bytes] = []
        for found in self.words.pieces(text):
            features = Counter(found)
            chain = carried + found
            for size in range(2, self.run + 1):
                first = max(len(carried) - size + 1, 0)
                features.update(b" ".join(chain[i : i + size]) for i in range(first, len(chain) - size + 1))
            carried = chain[-(self.run - 1) :] if self.run > 1 else []
            yield len(found), features


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How often each bucket occurs in column ``text``: ``buckets`` sums, added up in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, totals = Features(buckets, run), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                for _, found in features.counted(text):
                    for feature, n in found.items():
                        totals[features.bucket(feature)] += n
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]  # at most ``buckets`` rows
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share over the smoothed source share, per bucket, in doubles."""
    size = len(source)
    all_source, all_target = float(source.sum() + size), float(target.sum() + size)
    of = lambda s, t: math.floor(1000.0 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target)))
    return np.array([of(float(s), float(t)) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """``docs`` with n_words, n_features and weight of column ``text``."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = held.value.tolist()
        features = Features(len(table), run)
        for column in batches:
            out: tuple[list[int], ...] = ([], [], [])
            for text in texts_of(column):
                sums = [0, 0, 0]
                for words, found in features.counted(text):
                    sums[0] += words
                    sums[1] += found.total()
                    sums[2] += sum(table[features.bucket(f)] * n for f, n in found.items())
                for values, value in zip(out, sums, strict=True):
                    values.append(value)
            yield pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in out], names=["n_words", "n_features", "weight"])

    weigh.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(weigh, "n_words long, n_features long, weight long")
    return docs.withColumn("_w", made("text")).select(*docs.columns, "_w.*")


def noise(doc_id: Column) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of the SHA-256 of the seed and the id."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def cutoff_bracket(rows: DataFrame, total: int, drawn: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, rows above high) of scores that enclose the ``drawn``-th highest of ``total``.

    The sketch errs by about total / accuracy rows; exact counts decide, and the bracket
    widens fourfold until they hold, at last to all scores.
    """
    reach = 2.0 / accuracy
    while True:
        at = 1.0 - drawn / total
        edges = [max(at - reach, 0.0), min(at + reach, 1.0)]
        low, high = rows.agg(F.percentile_approx("score", edges, accuracy).alias("e")).first()["e"]
        if reach >= 1.0:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        counts = rows.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score") >= low).alias("reached")).first()
        if counts["above"] < drawn <= counts["reached"]:
            return low, high, counts["above"]
        reach *= 4


def ranked_draw(scored: DataFrame, eligible: Column, percent: int, accuracy: int = ACCURACY) -> DataFrame:
    """``scored`` (pinned: doc_id, score, row, ...) with rank 1, 2, 3, ... of the drawn rows, null for others."""
    total = scored.where(eligible).count()
    drawn = percent * total // 100
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    rows = scored.where(eligible)
    low, high, above = cutoff_bracket(rows, total, drawn, accuracy)
    inside = numbered(rows.where(F.col("score").between(low, high)).select("score", "doc_id", "row"), [], order)
    last = inside.where(F.col("n") == drawn - above).first()
    tie = F.col("doc_id").isNull() if last["doc_id"] is None else F.col("doc_id") == last["doc_id"]
    before = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.coalesce(F.col("doc_id") < last["doc_id"], F.lit(False))
    even = (F.col("score") == last["score"]) & (before | (F.coalesce(tie, F.lit(False)) & (F.col("row") <= last["row"])))
    taken = F.coalesce(eligible & ((F.col("score") > last["score"]) | even), F.lit(False))
    first = numbered(scored.where(taken), [], order, "rank")
    return first.unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    df: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN,
    accuracy: int = ACCURACY, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_features, weight, score, rank.

    Drawn are ``percent`` of the rows with ``least_words`` words or more, the highest scores
    first, ties to the smaller id, null ids last; the rank of other rows is null. Null and
    empty texts have no features and weight 0; a null id hashes like an empty one. Repeated
    rows are rows of their own; among rows equal in id and score the order is free. An empty
    target leaves the smoothing alone, an empty table gives no rows. Other columns are not read.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    gain = gains(bucket_counts(docs, buckets, run), bucket_counts(pick(target, text=target_col), buckets, run))
    scored = weighed(docs, gain, run).drop("text").withColumns({"score": F.col("weight") + noise(F.col("doc_id")), "row": F.monotonically_increasing_id()})
    out = ranked_draw(pin(scored), F.col("n_words") >= least_words, percent, accuracy)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
