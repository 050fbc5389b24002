"""Best-fit packing by bin completion.

Tokenising, numbering and placing pieces is distributed. What the search needs is only
how many pieces of each length there are, at most one row per possible length, so it
runs on the driver at any size of the input.

Search: take the longest length left; the fillings of the space beside it are
enumerated by branch and bound over lengths (longest first). A filling is undominated
if no piece left outside fits the space it wastes and no single piece in it can be
exchanged for a longer one. The best-fit filling is the incumbent, and a branch is cut
when even a full use of its space cannot beat it. The chosen filling is applied as
often as its scarcest length allows, so equal bins are decided once. A second pass,
longest pieces paired best-fit only, competes; the pass with fewer sequences wins, and
a pass that reaches ceil(total / capacity) is optimal. Each branch and bound ends after
``SEARCH_NODES`` steps. If that happened and the bound is missed, the pieces of the bins
that are not full are searched again with ``SEARCH_AGAIN`` times, then its square times
the steps. No piece is left out in any case; what the limits can cost is sequences.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.frames import Memo, lean, pick, texts_of
from tickloom.llm.token_counts import blocks, library, stand_ins
from tickloom.session import pin

MEMO_ENTRIES = 300_000
MARKS, LATIN_END = ".,", "\u0250"
SEARCH_NODES = 4_000
SEARCH_AGAIN = 16
BUCKET_ROWS = 50_000
PIECE = "struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>"


class ByteLevelIds:
    """Ids of texts as little-endian 32-bit bytes, in one Python worker.

    A byte-level vocabulary never merges across a space or a line break between two
    characters other than white space, so what stands between them is encoded once and
    reused. The memo keeps the pieces that come back; those of one block only make room. Texts with longer runs of white space, and texts
    that hold an added token (it ends a segment, and so a run of white space, anywhere),
    go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = library(path)
        self.unsafe = re.compile(r"\s\s(?:\s|\Z)").search
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        of = {b: c for c, b in stand_ins().items()}
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith(of[32])
        self.line, *self.marks = self.whole(["\n", *MARKS])
        self.breaks = int(np.frombuffer(self.line, "<u4")[0])
        self.memo = Memo(MEMO_ENTRIES)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, text: str) -> bool:
        """Does the text have to go to the library whole?"""
        return any(a in text for a in self.added) or self.unsafe(text) is not None

    def _side_by_side(self, parts: list[str], joined: str, starts) -> dict[str, bytes]:
        """Parts encoded as one text; ``starts`` finds where each begins. Empty if they do not fall apart again."""
        if any(a in joined for a in self.added):
            return {}
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        at = starts(ids)
        if len(at) != len(parts):
            return {}
        raw, edges = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
        return {p: raw[a:b] for p, a, b in zip(parts, edges, edges[1:])}

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of pieces: " " + piece, or the piece itself if it opens with a line break."""
        # a sentence mark after a letter is a pre-token of its own
        ended = {p: p[:-1] for p in missing if len(p) > 1 and p[-1] in MARKS and p[-2].isalpha() and p[-2] < LATIN_END}
        memo = self.memo.of
        plain = (missing - ended.keys()) | {q for q in ended.values() if q not in memo}
        clear = [p for p in plain if p and not p[-1].isspace()]
        spaced = [p for p in clear if not p[0].isspace()]
        bare = [p for p in clear if p[0] == "\n" and not p[1].isspace()]
        out: dict[str, bytes] = {}
        if spaced:
            out = self._side_by_side(spaced, " " + " ".join(spaced), lambda ids: np.flatnonzero(self.opens[ids]))
        if bare:
            out |= self._side_by_side(bare, "".join(bare), lambda ids: np.flatnonzero(ids == self.breaks))
        apart = [p for p in plain if p not in out]
        if apart:
            out.update(zip(apart, self.whole([p if p[:1] == "\n" else f" {p}" for p in apart])))
        mark = dict(zip(MARKS, self.marks))
        out.update((p, (memo.get(q) or out[q]) + mark[p[-1]]) for p, q in ended.items())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if self.apart(t) else t.replace("\n", " \n").split(" ") for t in texts]
        heads = self.whole([s[0] if s else t for s, t in zip(split, texts)])
        rest = [s[1:] if s else () for s in split]
        missing = self.memo.missing(set().union(*rest))
        if missing:
            self.memo.learn(self._learn(missing))
        of = self.memo.of.__getitem__
        out = [h + b"".join(map(of, r)) for h, r in zip(heads, rest)]
        self.memo.settle()
        return out


@lru_cache(maxsize=2)
def id_coder(path: str) -> ByteLevelIds:
    """One coder a worker process: what a task learned serves the next."""
    return ByteLevelIds(path)


def token_pieces(text: Column, path: str, most: int, end_id: int) -> Column:
    """Array of pieces of a text column: its ids, then ``end_id``, cut at ``most``; only the first may be shorter."""
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = id_coder(path)
        for column in batches:
            counts, starts, lengths, sums = [], [], [], []
            for block in blocks(texts_of(column)):
                for ids in coder.encode(block):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % most or most, n + 1, most)]
                    counts.append(len(cuts) - 1)
                    for a, b in zip(cuts, cuts[1:]):
                        starts.append(a)
                        lengths.append(b - a)
                        sums.append(zlib.crc32(ids[4 * a : 4 * b]))
            offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
            piece = np.arange(offsets[-1], dtype=np.int32) - np.repeat(offsets[:-1], counts)
            values = pa.StructArray.from_arrays([pa.array(piece, pa.int32()), *[pa.array(v, pa.int64()) for v in (starts, lengths, sums)]], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(lean(run, "packing", id_coder.cache_clear), f"array<{PIECE}>")(text)


def _best_fit(space: int, lengths: list[int], left: dict[int, int]) -> list[tuple[int, int]]:
    """Greedy filling: the longest that fits, as often as it fits."""
    out = []
    at = bisect_right(lengths, space) - 1
    while at >= 0 and space:
        length = lengths[at]
        k = min(left[length], space // length)
        if k:
            out.append((length, k))
            space -= k * length
        at = min(at - 1, bisect_right(lengths, space) - 1)
    return out


def completion(space: int, lengths: list[int], left: dict[int, int], nodes: int = SEARCH_NODES, report: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """The filling of ``space`` that wastes least, as (length, times); ties keep the earlier, with longer pieces.

    ``report`` counts under "ended" the searches that ``nodes`` has ended.

    ``lengths`` ascend and have ``left`` pieces each. Fillings are tried longest first;
    every filling reached is maximal (nothing left fits its waste), which with the
    longest-first order leaves out the dominated ones. Smaller waste wins, so a branch
    whose space cannot be used up further than the incumbent's is cut.
    """
    best = _best_fit(space, lengths, left)
    waste = space - sum(a * k for a, k in best)
    below = [0]  # tokens in all pieces up to each length: a bound on what a branch can still place
    for a in lengths:
        below.append(below[-1] + a * left[a])
    budget = nodes

    def branch(at: int, room: int, held: list[tuple[int, int]]) -> None:
        nonlocal best, waste, budget
        at = min(at, bisect_right(lengths, room) - 1)
        if room < waste:
            best, waste = list(held), room
        while at >= 0 and waste and budget:
            if room - below[at + 1] >= waste:  # even all that is left cannot use more
                return
            length = lengths[at]
            for k in range(min(left[length], room // length), 0, -1):
                budget -= 1
                held.append((length, k))
                branch(at - 1, room - k * length, held)
                held.pop()
                if not waste or not budget:
                    return
            at -= 1

    if waste:
        branch(len(lengths) - 1, space, [])
    if report is not None and waste and not budget:
        report["ended"] = report.get("ended", 0) + 1
    return best


def bin_patterns(counts: dict[int, int], capacity: int, nodes: int = SEARCH_NODES, report: dict[str, int] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, times)]) that place every piece; lengths must be 1 to ``capacity``.

    ``report`` gets the number of bins, their lower bound, and the searches made and ended by ``nodes``.
    """
    if any(not 0 < a <= capacity for a in counts):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    bound = -(-sum(a * n for a, n in counts.items()) // capacity)

    told = {"searches": 0, "ended": 0}

    def solve(fill, counts: dict[int, int]) -> list[tuple[int, list[tuple[int, int]]]]:
        left, out = {a: n for a, n in counts.items() if n}, []
        lengths = sorted(left)
        while lengths:
            longest = lengths[-1]
            left[longest] -= 1
            beside = fill(capacity - longest, lengths, left)
            left[longest] += 1
            bin_: dict[int, int] = {longest: 1}
            for a, k in beside:
                bin_[a] = bin_.get(a, 0) + k
            times = min(left[a] // k for a, k in bin_.items())
            out.append((times, sorted(bin_.items(), reverse=True)))
            for a, k in bin_.items():
                left[a] -= times * k
                if not left[a]:
                    del left[a]
                    lengths.remove(a)
        return out

    def searched(counts: dict[int, int], nodes: int) -> list[tuple[int, list[tuple[int, int]]]]:
        def fill(space: int, lengths: list[int], left: dict[int, int]) -> list[tuple[int, int]]:
            told["searches"] += 1
            return completion(space, lengths, left, nodes, told)

        return solve(fill, counts)

    def size(patterns: list[tuple[int, list[tuple[int, int]]]]) -> int:
        return sum(n for n, _ in patterns)

    best = searched(counts, nodes)
    if size(best) > bound:
        best = min(best, solve(_best_fit, counts), key=size)
    for more in (SEARCH_AGAIN * nodes, SEARCH_AGAIN**2 * nodes):
        if size(best) <= bound or not told["ended"]:
            break
        full = [(n, items) for n, items in best if sum(a * k for a, k in items) == capacity]
        rest: dict[int, int] = {}
        for n, items in best:
            if sum(a * k for a, k in items) < capacity:
                for a, k in items:
                    rest[a] = rest.get(a, 0) + n * k
        best = min(best, full + searched(rest, more), key=size)
    if report is not None:
        report.update(told, bins=size(best), bound=bound)
    return best


def placement(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Where the i-th piece of a length goes: per length, runs (first i, first bin, pieces a bin, bins, offset in a bin)."""
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for bins, pieces in patterns:
        offset = 0
        for length, k in pieces:
            at = used.get(length, 0)
            runs.setdefault(length, []).append((at, first, k, bins, offset))
            used[length] = at + k * bins
            offset += k * length
        first += bins
    return runs


def pack_pieces(pieces: DataFrame, capacity: int, nodes: int = SEARCH_NODES) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset added; every length is at most ``capacity``.

    Pieces of one length are numbered without one task per length: rows go to buckets
    by a hash of their key, are numbered inside (length, bucket), and bucket totals are
    added up. Repeated (doc_id, piece) rows are placed apart. ``pieces`` is pinned first.
    """
    spark = pieces.sparkSession
    pieces = pin(pieces)
    total = pieces.count()
    buckets = max(1, -(-total // BUCKET_ROWS)) * 4
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)).cast("int"))
    per = pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = placement(bin_patterns(counts, capacity, nodes))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = (
        pieces.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_bucket"])
        .withColumn("_i", F.col("_rank") + F.col("_before"))
    )
    table = spark.sparkContext.broadcast({a: np.array(r, dtype=np.int64) for a, r in runs.items()})

    def place(length: pa.Array, i: pa.Array) -> pa.Array:
        of, at = np.asarray(length), np.asarray(i)
        sequence, offset = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for a in np.unique(of):
            here = np.flatnonzero(of == a)
            run = table.value[a]
            r = run[np.searchsorted(run[:, 0], at[here], side="right") - 1]
            within = at[here] - r[:, 0]
            sequence[here] = r[:, 1] + within % r[:, 3]
            offset[here] = r[:, 4] + within // r[:, 3] * a
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    place.__annotations__ = {"length": pa.Array, "i": pa.Array, "return": pa.Array}
    placed = numbered.withColumn("_at", F.arrow_udf(place, "sequence_id long, offset long")("length", "_i"))
    return placed.select(*[c for c in pieces.columns if c != "_bucket"], "_at.sequence_id", "_at.offset")


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; null ids stay; repeated rows are packed
    each; an empty table gives no rows; other columns are not read.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    pieces = docs.select("doc_id", F.explode(token_pieces(F.col("text"), path, capacity, end_id)).alias("p")).select("doc_id", "p.*")
    return pack_pieces(pieces, capacity)
