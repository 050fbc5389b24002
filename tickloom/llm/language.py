"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, a logistic regression on
hashed byte n-grams, predicts that bit. Decoding takes the codeword with the smallest
sum of bit losses, each bit weighted by how well its classifier did on training rows,
and flags a text as ambiguous when the second is nearly as close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.frames import BLOCK_BYTES, byte_blocks, lean, pick

FEATURE_BITS = 13
SAMPLE_TEXTS = 3_200
STEPS = 200
AMBIGUOUS = 0.6
UNCLEAR = 0.3  # below this no language is accepted where texts are filtered
UNKNOWN = "und"


def codewords(classes: int, seed: int = 11) -> np.ndarray:
    """Rows of +1/-1, one per class: all distinct splits up to 6 classes, else random ones kept far apart."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        bits = [[1 if c in chosen else -1 for c in range(classes)] for k in range(classes - 1) for chosen in ({0, *rest} for rest in combinations(range(1, classes), k))]
        return np.array(bits).T.astype(float)
    r = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(classes)))
    tries = (np.where(r.random((classes, length)) < 0.5, 1.0, -1.0) for _ in range(60))

    def apart(m: np.ndarray) -> float:
        gram = m @ m.T
        return -np.max(gram[~np.eye(classes, dtype=bool)])

    return max((m for m in tries if (np.abs(m.sum(0)) < classes).all()), key=apart)


# lower-cased ASCII; every other byte but letters and bytes beyond ASCII becomes a space
FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def gram_slots(data: np.ndarray, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2-gram and 3-gram slots that end at each byte (from the second and the third)."""
    b = FOLD[data].astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:]
    mix = lambda x, k: ((x * np.uint32(k)) >> np.uint32(32 - bits)).astype(np.int32)
    return mix(two, 0x9E3779B1), mix(three, 0x85EBCA6B)


def gram_vectors(data: np.ndarray, offsets: np.ndarray, bits: int = FEATURE_BITS) -> np.ndarray:
    """Root of the relative n-gram frequencies of each text, unit length; a row of zeros for texts under two bytes."""
    out = np.zeros((len(offsets) - 1, 1 << bits), dtype=np.float32)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        if b - a >= 2:
            counts = sum(np.bincount(s, minlength=1 << bits) for s in gram_slots(data[a:b], bits))
            out[i] = np.sqrt(counts / counts.sum())
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding
    bits: int = FEATURE_BITS

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each language for each text."""
        margins = np.empty((len(offsets) - 1, self.code.shape[1]))
        for at in range(0, len(offsets) - 1, 256):
            margins[at : at + 256] = gram_vectors(data, offsets[at : at + 257], self.bits) @ self.weights
        return self.decode(margins + self.bias)

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted decoding: logistic loss of every bit against every codeword, as probabilities."""
        loss = np.logaddexp(0.0, -margins[:, None, :] * self.code[None, :, :]) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit(vectors: np.ndarray, classes: np.ndarray, languages: tuple[str, ...], steps: int = STEPS, decay: float = 1e-4) -> LanguageModel:
    """One logistic regression per bit, classes weighted alike, by full-batch Adam from zero weights."""
    code = codewords(len(languages))
    target = (code[classes] + 1) / 2
    share = np.bincount(classes, minlength=len(languages))
    weight = (1.0 / np.maximum(share, 1)[classes] / len(languages)).astype(np.float32)[:, None]
    w = np.zeros((vectors.shape[1] + 1, code.shape[1]), dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(vectors @ w[:-1] + w[-1])))
        d = weight * (p - target).astype(np.float32)
        g = np.concatenate([vectors.T @ d + decay * w[:-1], d.sum(0, keepdims=True)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    right = (weight * ((vectors @ w[:-1] + w[-1] > 0) == (target > 0.5))).sum(0)
    return LanguageModel(languages, code, w[:-1], w[-1].astype(float), np.maximum(right, 0.5) / np.maximum(right, 0.5).sum() * code.shape[1])


def train(labelled: DataFrame, texts: int = SAMPLE_TEXTS) -> LanguageModel:
    """Fit on rows (key, text, lang): at most ``texts`` whole texts, an equal share of each
    language (or all it has), chosen by a hash of the key.

    Rows without language, text or letters are left out. The sample's n-gram vectors are
    computed in tasks; only they (bounded by the parameter) reach the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("_h", "key")
    few = rows.select("key", "lang", F.xxhash64("key").alias("_h"))
    counts = {r["lang"]: r["n"] for r in few.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel((), np.ones((0, 1)), np.zeros((1 << FEATURE_BITS, 1), np.float32), np.zeros(1), np.ones(1))
    per_language = max(1, texts // len(counts))
    # a hash threshold keeps a little more than the sample, so that the window sorts few rows
    share = F.create_map(*[x for a, n in counts.items() for x in (F.lit(a), F.lit(min(1.0, 1.5 * per_language / n + 50 / n)))])
    near = (F.pmod("_h", F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")]
    chosen = few.where(near).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language)
    sample = rows.join(F.broadcast(chosen.select("key", "lang").distinct()), ["key", "lang"])
    languages = tuple(sorted(counts))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, at = batch.column("lang"), 0
            for data, offsets in byte_blocks(batch.column("text")):
                for few in range(0, len(offsets) - 1, 256):
                    for v in gram_vectors(data, offsets[few : few + 257]):
                        held = np.flatnonzero(v).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([lang.slice(at, 1), pa.array([held.tobytes()], pa.binary()), pa.array([v[held].astype(np.float32).tobytes()], pa.binary())], names=["lang", "slots", "values"])
                        at += 1

    got = sample.select("lang", "text").mapInArrow(lean(vectors, "language"), "lang string, slots binary, values binary").collect()
    got.sort(key=lambda r: (r["lang"], r["slots"], r["values"]))
    x = np.zeros((len(got), 1 << FEATURE_BITS), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["slots"], np.int32)] = np.frombuffer(r["values"], np.float32)
    return fit(x, np.array([languages.index(r["lang"]) for r in got]), languages)


def predict(text: Column, broadcast) -> Column:
    """Struct: lang_pred, score (its probability), ambiguous.

    A null text, and one without any letter, is ``und`` with score 0.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = broadcast.value
        for column in batches:
            known, best, score = [], [], []
            for data, offsets in byte_blocks(column, BLOCK_BYTES):
                letters = np.concatenate([[0], np.cumsum((FOLD[data] != 32) & (data < 128), dtype=np.int64)])
                has = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in np.flatnonzero(~has):
                    has[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8"))
                p = model.scores(data, offsets) if model.languages else np.zeros((len(has), 1))
                best.append(p.argmax(axis=1))
                score.append(np.where(has, np.round(p.max(axis=1), 6), 0.0))  # the last bits depend on the block
                known.append(has & bool(model.languages))
            known, best, score = (np.concatenate(x) if x else np.zeros(0) for x in (known, best, score))
            names = np.array([*model.languages, UNKNOWN], dtype=object)
            lang = names[np.where(known.astype(bool), best, len(names) - 1).astype(int)]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(score < AMBIGUOUS)], names=["lang_pred", "score", "ambiguous"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(lean(run, "language"), "lang_pred string, score double, ambiguous boolean")(text)


def language_of(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, lang_pred, score, ambiguous.

    Null ids stay; repeated rows repeat; an empty table gives no rows; only id and text are read.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    held = df.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", predict(F.col("text"), held).alias("p")).select("doc_id", "p.*")
