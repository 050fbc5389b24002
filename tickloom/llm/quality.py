"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features come from its own shape and from the lines
beside it; transitions tie neighbours together. Forward-backward gives each line's
probability of being good, and a document's quality is their mean weighted by line
length. Training lines take their document's label (no line labels exist).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.frames import byte_blocks, lean, pick
from tickloom.llm.hashing import span_hashes, word_spans

SAMPLE_DOCUMENTS = 3_000
SAMPLE_BYTES = 65_536
BLOCK_BYTES = 1 << 19  # a block's features take 80 times its bytes
SHAPE_SLOTS = 64
STEPS = 150
THRESHOLD = 0.3

# byte classes: 0 space, 1 upper, 2 lower, 3 digit, 4 beyond ASCII, 5 sentence marks, 6 brackets and quotes, 7 other marks
KIND = np.full(256, 7, dtype=np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 1, 2, 3, 4
KIND[[ord(c) for c in ".,;:?"]] = 5
KIND[[ord(c) for c in "()[]{}\"'<>"]] = 6
OWN = 8 + 9
WIDTH = 3 * OWN + SHAPE_SLOTS


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of non-blank lines, and the number of lines before each text and in all."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = np.where(data[ends - 1] == 10, ends - 1, ends)
    filled = np.concatenate([[0], np.cumsum(KIND[data] != 0, dtype=np.int64)])
    full = filled[ends] > filled[starts]
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per line: own figures, those of the line before and after in its text, and byte-class trigrams."""
    n = len(starts)
    if not n:
        return np.zeros((0, WIDTH), dtype=np.float32)
    size = (ends - starts).astype(np.float64)
    kind = KIND[data]
    line = np.repeat(np.arange(n), ends - starts)
    at = np.arange(len(line)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts) + np.repeat(starts, ends - starts)
    per = np.bincount(line * 8 + kind[at], minlength=8 * n).reshape(n, 8) / size[:, None]
    w_start, w_end = word_spans(data, offsets)
    w_line = np.searchsorted(starts, w_start, side="right") - 1
    count = np.maximum(np.bincount(w_line, minlength=n), 1).astype(np.float64)
    h = span_hashes(data, w_start, w_end) >> np.uint64(24)
    keyed = np.sort((w_line.astype(np.uint64) << np.uint64(40)) | h)
    new = np.ones(len(keyed), dtype=bool)
    new[1:] = keyed[1:] != keyed[:-1]
    distinct = np.bincount((keyed[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (w_line[1:] == w_line[:-1])
    marked = (kind[w_end - 1] == 7) if len(w_end) else np.zeros(0, bool)
    lower_first = (kind[w_start] == 2) if len(w_start) else np.zeros(0, bool)
    mean = lambda x: np.bincount(w_line[x], minlength=n) / count
    letters = np.maximum(per[:, 1] + per[:, 2] + per[:, 4], 1e-9)
    own = np.column_stack([
        per, per[:, 1] / letters, distinct / count, 4 * mean(again), mean(marked), mean(lower_first),
        np.minimum(size / count, 30) / 10, np.log1p(count) / 5, kind[ends - 1] == 5, np.minimum(np.log1p(count) / 5, 1) * (1 - distinct / count) * 2,
    ])
    last = np.zeros(n, dtype=bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    opening = np.roll(last, 1)
    before[opening], after[last] = own[opening], own[last]  # a text's edge stands beside itself
    k = kind[at].astype(np.int64)
    three = np.zeros(len(k), dtype=np.int64)
    three[2:] = (k[:-2] * 64 + k[1:-1] * 8 + k[2:]) * 0x9E37 >> 4 & (SHAPE_SLOTS - 1)
    whole = np.zeros(len(k), dtype=bool)
    whole[2:] = line[2:] == line[:-2]
    shape = np.bincount(line[whole] * SHAPE_SLOTS + three[whole], minlength=n * SHAPE_SLOTS).reshape(n, SHAPE_SLOTS)
    return np.concatenate([own, before, after, np.sqrt(shape / size[:, None])], axis=1).astype(np.float32)


@dataclass(frozen=True)
class LineField:
    """Weights of line features for "good" against "bad", and rewards for staying bad or good."""

    weights: np.ndarray
    bias: float
    stay: tuple[float, float]


def chain(emission: np.ndarray, first: np.ndarray, stay: tuple[float, float], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once, one step a line.

    Returns P(good) of each line, and the expected numbers of neighbours that stay bad and
    stay good, each line counted by ``weight`` (left out without weights).
    """
    length = np.diff(first)
    good, log_z, pairs = np.zeros(len(emission)), np.zeros(len(length)), np.zeros(2)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    if not len(order):
        return good, pairs
    sizes = length[order]
    at0 = first[:-1][order]
    active = [len(order) - int(np.searchsorted(sizes[::-1], t, side="right")) for t in range(sizes[0])]
    fwd = np.zeros((len(emission), 2))
    fwd[at0, 1] = emission[at0]
    for t in range(1, sizes[0]):
        i = at0[: active[t]] + t
        p = fwd[i - 1]
        fwd[i, 0] = np.logaddexp(p[:, 0] + stay[0], p[:, 1])
        fwd[i, 1] = np.logaddexp(p[:, 0], p[:, 1] + stay[1]) + emission[i]
    end = at0 + sizes - 1
    log_z[order] = np.logaddexp(fwd[end, 0], fwd[end, 1])
    z = np.repeat(log_z, length)
    bwd = np.zeros((len(emission), 2))
    for t in range(sizes[0] - 1, 0, -1):
        i = at0[: active[t]] + t
        b0, b1 = bwd[i, 0], bwd[i, 1] + emission[i]
        bwd[i - 1, 0] = np.logaddexp(b0 + stay[0], b1)
        bwd[i - 1, 1] = np.logaddexp(b0, b1 + stay[1])
        if weight is not None:
            pairs[0] += (weight[i] * np.exp(fwd[i - 1, 0] + stay[0] + b0 - z[i])).sum()
            pairs[1] += (weight[i] * np.exp(fwd[i - 1, 1] + stay[1] + b1 - z[i])).sum()
    good = np.exp(np.minimum(fwd[:, 1] + bwd[:, 1] - z, 0.0))
    return good, pairs


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS, decay: float = 1e-3) -> LineField:
    """Maximum likelihood of every line taking its text's label, both labels weighted alike, by Adam."""
    length = np.diff(first)
    held = length > 0
    y = np.repeat(labels, length).astype(float)
    share = np.array([max((labels[held] == k).sum(), 1) for k in (0, 1)])
    # a text weighs by its label's rarity and not by its number of lines
    text_weight = (1.0 / share)[labels] / np.maximum(length, 1)
    weight = np.repeat(text_weight, length)
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1][held]] = False
    seen = np.array([(weight * inner * (y == k)).sum() for k in (0, 1)])  # the label never changes inside a text
    w = np.zeros(features.shape[1] + 3)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        good, pairs = chain(features @ w[:-3] + w[-3], first, (w[-2], w[-1]), weight)
        d = weight * (good - y)
        g = np.concatenate([features.T @ d, [d.sum()], pairs - seen]) + decay * w
        g[-2:] += 0.02 * w[-2:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return LineField(w[:-3].astype(np.float32), float(w[-3]), (float(w[-2]), float(w[-1])))


def line_marginals(data: np.ndarray, offsets: np.ndarray, model: LineField) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line starts, ends, lines before each text, and P(good) of each line."""
    starts, ends, first = lines_of(data, offsets)
    e = line_features(data, starts, ends, first, offsets) @ model.weights + model.bias
    return starts, ends, first, chain(e.astype(float), first, model.stay)[0]


def text_scores(data: np.ndarray, offsets: np.ndarray, model: LineField) -> np.ndarray:
    """Length-weighted mean of the line marginals; 0 for a text without a line."""
    starts, ends, first, good = line_marginals(data, offsets, model)
    total = np.concatenate([[0.0], np.cumsum(good * (ends - starts))])
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    n = size[first[1:]] - size[first[:-1]]
    mean = np.where(n > 0, (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1), 0.0)
    return np.clip(np.round(mean, 6), 0.0, 1.0)  # the last bits depend on the other texts of a block


def train(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS, most_bytes: int = SAMPLE_BYTES) -> LineField:
    """Fit on rows (key, text) and (key, label): at most ``documents`` whole texts of each label, chosen by a hash of the key.

    Texts over ``most_bytes`` bytes are left to other rows; features are computed in
    tasks. Keys are chosen before texts are read, so no other text is moved.
    """
    fit_for = docs.where((F.octet_length("text") <= most_bytes) & (F.length("text") > 0))
    few = fit_for.select("key").join(labels.where(F.col("label").isin(0, 1)), "key").select("key", "label", F.xxhash64("key").alias("_h"))
    counts = {r["label"]: r["n"] for r in few.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return LineField(np.zeros(WIDTH, np.float32), 8.0 if 1 in counts else -8.0 if 0 in counts else 0.0, (0.0, 0.0))
    near = F.lit(False)
    for label, n in counts.items():
        near = near | ((F.col("label") == label) & (F.pmod("_h", F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.5 * documents / n + 50 / n))))
    order = Window.partitionBy("label").orderBy("_h", "key")
    chosen = few.where(near).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= documents)
    sample = fit_for.join(F.broadcast(chosen.select("key", "label").distinct()), "key")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, at = batch.column("label"), 0
            for data, offsets in byte_blocks(batch.column("text"), BLOCK_BYTES):
                starts, ends, first = lines_of(data, offsets)
                x = line_features(data, starts, ends, first, offsets).astype(np.float16)
                parts = [x[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([labels.slice(at, len(parts)).cast(pa.int32()), pa.array(parts, pa.binary())], names=["label", "lines"])
                at += len(parts)

    got = sample.select("label", "text").mapInArrow(lean(measured, "quality"), "label int, lines binary").collect()
    got.sort(key=lambda r: (r["label"], r["lines"]))
    parts = [np.frombuffer(r["lines"], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in got]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return fit(np.concatenate(parts), first, np.array([r["label"] for r in got]))


def quality_score(text: Column, broadcast) -> Column:
    """Quality of a text column between 0 and 1; 0 for null and blank texts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            scores = [text_scores(data, offsets, broadcast.value) for data, offsets in byte_blocks(column, BLOCK_BYTES)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(lean(run, "quality"), "double")(text)


def quality_of(df: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, score, predicted (1 from 0.3 on).

    Null ids stay; repeated rows repeat; an empty table gives no rows; only id and text are read.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    held = df.sparkSession.sparkContext.broadcast(model)
    scored = docs.select("doc_id", quality_score(F.col("text"), held).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
