"""Near duplicates of documents by fast similarity sketching.

Sketch: in round r every shingle of a set is hashed to one bin and a value; a bin keeps
the smallest value of the first round that reaches it. After ``bins`` rounds, round
``bins + i`` sends every shingle to bin i, so all bins fill. Agreement of two sketches
estimates the similarity with concentration as if all bins were independent.

Documents with equal sets are one class. Classes whose sketches agree on all bins of a
band are candidates. To lose no link and still not write all pairs of a bucket:

1. every class is compared with the centre of its buckets, the member met most often;
2. classes that share a bucket but not yet a component meet by their rarest shingles
   (prefix and position filters, which are exact), and are compared pair by pair.

Every link is confirmed on the full sets; components follow from the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.frames import byte_blocks, lean, pick
from tickloom.llm.hashing import mix, shingle_sets
from tickloom.llm.membership import maybe_in
from tickloom.session import pin

BINS = 256
BANDS = 32
BAND_BINS = 5  # a pair at 0.85 shares no band with probability 7e-9, at 0.8 with 3e-6
BLOCK_BYTES = 1 << 20
PARTNERS = 512  # partners a copy of a centre's text


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values per set; a row of the largest value for an empty set."""
    n = len(sets)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, bins), top, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    rows = np.flatnonzero(sizes)
    active, x, local = None, None, None
    for r in range(2 * bins):
        if not len(rows):
            break
        if active is None or len(rows) < len(active):
            active = rows
            x = np.concatenate([sets[i] for i in rows])
            local = np.repeat(np.arange(len(rows)), sizes[rows])
        h = mix(x, r + 1)
        at = (h % np.uint64(bins)).astype(np.int64) if r < bins else np.full(len(x), r - bins)
        value = h >> np.uint64(11) | np.uint64(min(r, 2047)) << np.uint64(53)  # an earlier round is always smaller
        found = np.full((len(rows), bins), top, dtype=np.uint64)
        np.minimum.at(found.reshape(-1), local * bins + at, value)
        out[rows] = np.minimum(out[rows], found)
        rows = rows[(out[rows] == top).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per row and band."""
    n, width = len(sketch), BAND_BINS
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for i in range(width):
        key = mix(key ^ sketch[:, i : bands * width : width], 7)
    return key


def one_bits(sketch: np.ndarray) -> np.ndarray:
    """One bit of each value, packed into 64-bit words."""
    bits = (mix(sketch, 5) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def _fingerprint(s: np.ndarray, salt: int) -> int:
    """64 bits of a set, whatever its order: sum of mixed members, mixed with the size."""
    return int(mix(mix(s, salt).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(s)), salt)[0])


def signatures(docs: DataFrame, words: int, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """doc_id, h, n (shingles), f1 and f2 (fingerprint of the set), bits, bands for every row of (doc_id, text, h)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n, f, bits, keys = [], ([], []), [], []
            for data, offsets in byte_blocks(column, BLOCK_BYTES):
                sets = shingle_sets(data, offsets, words)
                sketch = sketches(sets, bins)
                n += [len(s) for s in sets]
                for at, salt in enumerate((101, 202)):
                    f[at].extend(_fingerprint(s, salt) for s in sets)
                bits.append(one_bits(sketch))
                keys.append(band_keys(sketch, bands))
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))

            def lists(parts: list[np.ndarray], width: int) -> pa.Array:
                flat = np.concatenate(parts).view(np.int64).ravel() if parts else np.zeros(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * width), pa.array(flat))

            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), signed(f[0]), signed(f[1]), lists(bits, bins // 64), lists(keys, bands)], names=["n", "f1", "f2", "bits", "bands"]
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(lean(run, "near_duplicates"), "n long, f1 long, f2 long, bits array<long>, bands array<long>")
    return docs.select("doc_id", "h", made("text").alias("s")).select("doc_id", "h", "s.*")


def linked(n_a, n_b, shared, percent: int):
    """100 * |A and B| >= percent * |A or B|."""
    return 100 * shared >= percent * (n_a + n_b - shared)


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``texts.id`` whose full shingle sets are similar enough.

    Rows of a task stand by centre ``b``, its text first, then those of its partners, and
    are read as a stream: what a task holds is one centre's set and one block of texts. A
    centre's text is sent once for every ``PARTNERS`` partners, which may be in tasks of
    their own; a partner's text once a pair.
    """
    pairs = pin(pairs)
    degree = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    partners = pairs.join(degree, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"), F.lit(1).alias("kind"), F.col("a").alias("id"))
    centres = partners.select("b", "part").distinct().select("b", "part", F.lit(0).alias("kind"), F.col("b").alias("id"))
    wanted = centres.union(partners)
    texts = maybe_in(texts, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")  # most texts are in no pair and stay where they are
    rows = wanted.join(texts, "id").select("b", "part", "kind", "id", "text")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            of, part, kind = (batch.column(c).to_numpy() for c in ("b", "part", "kind"))
            good, at = np.zeros(batch.num_rows, dtype=bool), 0
            for data, offsets in byte_blocks(batch.column("text"), BLOCK_BYTES):
                for s in shingle_sets(data, offsets, words):
                    here = (of[at], part[at])
                    if not kind[at]:
                        centre, kept = here, s
                    elif here == centre:
                        shared = len(np.intersect1d(s, kept, assume_unique=True))
                        good[at] = linked(len(s), len(kept), shared, percent) and shared > 0
                    else:
                        raise RuntimeError("a partner came without its centre")
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return rows.mapInArrow(lean(run, "near_duplicates"), "a long, b long")


def _key(*columns: str):
    """A class's number: of rows of one id with equal texts, whichever is read, the set is the same."""
    return F.xxhash64(*columns)


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z and split at space and bytes 9 to 13; a text with fewer
    than ``words`` words is one shingle; null, empty and blank texts have none and link
    with nothing. component_id is the smallest id reachable over links, kept says that a
    row's id is that. Rows with a null id link with nothing, their component is null and
    they are kept. Rows of one id are one node, linked by each of their texts. An empty
    table gives no rows; other columns are not read.
    """
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("h", F.xxhash64("text"))
    signed = pin(signatures(docs, words))
    full = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # pinned: a join of its own exchange can be split where one set has a third of all rows
    reps = pin(full.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "h")).alias("m")).select("f1", "f2", "n", F.col("m.doc_id").alias("rep"), F.col("m.h").alias("h")))
    classes = pin(
        full.select("doc_id", "h", "f1", "f2", "n", "bits", "bands")
        .join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "h", "f1", "f2", "n"])
        .dropDuplicates(["doc_id", "h"])
        .select(_key("doc_id", "h").alias("id"), F.col("doc_id").alias("rep"), "n", "bits", "bands")
    )
    # an id may stand for several texts, each in a class of its own
    sets = F.struct("f1", "f2", "n")
    several = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min(sets).alias("lo"), F.max(sets).alias("hi")).where(F.col("c") > 1)
    several = pin(several.select("doc_id", (F.col("lo") != F.col("hi")).alias("apart")))
    named = docs.where(F.col("doc_id").isNotNull()).select(_key("doc_id", "h").alias("id"), "text")
    if several.count():
        named = named.dropDuplicates(["id"])
    same = full.join(several.where("apart"), "doc_id").join(reps.drop("h"), ["f1", "f2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()

    keyed = classes.select("id", F.explode("bands").alias("key"))
    dense = pin(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1))
    rows = pin(maybe_in(keyed, "key", dense, "key").join(dense, "key"))

    # step 1: the member of a bucket that shares the most buckets with the most others is its centre
    weight = rows.groupBy("id").agg(F.sum("c").alias("w"))
    weighed = rows.join(weight, "id")
    centre = weighed.groupBy("key").agg(F.max(F.struct("w", "id")).alias("top"))
    best = rows.join(centre, "key").where(F.col("id") != F.col("top.id")).groupBy("id").agg(F.max("top").alias("top"))
    pairs = best.select(F.col("id").alias("a"), F.col("top.id").alias("b"))
    about = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    similar = percent / 100
    differ = BINS * (1 - similar) / 2
    limit = int(differ + 6 * (BINS * (1 - similar) / 2 * (1 + similar) / 2) ** 0.5)
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = pairs.join(about("a"), "a").join(about("b"), "b").where(sized & (apart <= limit)).select("a", "b")
    first_links = pin(confirm(pairs, named, words, percent))
    first = components(first_links).withColumnRenamed("id", "of")

    # step 2: buckets that still hold several components
    place = F.coalesce("component", "id").alias("comp")
    here = rows.join(first, rows["id"] == first["of"], "left").select("key", "id", place)
    mixed = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") < F.col("hi")).select("key")
    open_ = pin(here.join(mixed, "key").select("id", "comp").distinct().join(classes.select("id", "n"), "id"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("id"), 0
            for data, offsets in byte_blocks(batch.column("text"), BLOCK_BYTES):
                found = shingle_sets(data, offsets, words)
                sizes = np.array([len(s) for s in found])
                take = pa.array(np.repeat(np.arange(at, at + len(found)), sizes))
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(take), pa.array(flat)], names=["id", "s"])
                at += len(found)

    texts = open_.select("id").join(maybe_in(named, "id", open_, "id"), "id")
    shingles = pin(texts.mapInArrow(lean(sets_of, "near_duplicates"), "id long, s long"))
    common = pin(shingles.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1))
    shared = maybe_in(shingles, "s", common, "s").join(common, "s")
    # rarest first: shingles of one class only stand at the front and need no partner
    each = Window.partitionBy("id")
    ranked = shared.withColumns({"_rank": F.row_number().over(each.orderBy("df", "s")), "_shared": F.count(F.lit(1)).over(each)})
    placed = ranked.join(open_, "id").withColumn("p", F.col("n") - F.col("_shared") + F.col("_rank"))
    prefix = pin(placed.where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("s", "id", "comp", "n", "p"))
    a, b = prefix.alias("a"), prefix.alias("b")
    n_a, n_b = F.col("a.n"), F.col("b.n")
    reach = 1 + F.least(n_a - F.col("a.p"), n_b - F.col("b.p"))
    near = (F.col("a.id") < F.col("b.id")) & (F.col("a.comp") != F.col("b.comp")) & (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
    near = near & ((100 + percent) * reach >= percent * (n_a + n_b))
    more = a.join(b, (F.col("a.s") == F.col("b.s")) & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    links = first_links.union(confirm(more, named, words, percent))
    rep = lambda c, r: classes.select(F.col("id").alias(c), F.col("rep").alias(r))
    edges = links.join(rep("a", "rep_a"), "a").join(rep("b", "rep_b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    found = components(edges.union(same))

    # a row without a set goes with its id, which may stand in a class elsewhere
    member = signed.select("doc_id", "n", "f1", "f2").join(reps.drop("h"), ["f1", "f2", "n"], "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    placed = member.join(found, member["rep"] == found["id"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    out = placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
