"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut where a rolling hash of the bytes before a space hits a mask, so equal
passages give equal chunks wherever they stand. A worker encodes each chunk once while
its memo holds it; a chunk that is new is cut again, at every space, into pieces that
are reused the same way, and only pieces never seen reach the library, in one batch.
A join of two chunks or pieces holds only if encoding both sides together equals both
apart; this is asked of the library for each new pair of characters around a join.
Where it fails, the join is taken out and the two sides are encoded as one, until
every join left agrees.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.frames import Memo, byte_blocks, pick
from tickloom.llm.token_counts import library

WINDOW = 8
MASK_BITS = 7
CHUNK_MEMO = 40_000
PIECE_MEMO = 250_000


class Coded(NamedTuple):
    """Encoded form of a stretch of text: number of ids, ids in decimal joined by a space, decoded text."""

    n: int
    ids: str
    text: str


def cut_points(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, bits: int = MASK_BITS) -> np.ndarray:
    """Positions of spaces, not at a text's edge, whose preceding ``window`` bytes hash to 0 in ``bits`` bits."""
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[spaces >= window]
    h = np.zeros(len(spaces), dtype=np.uint32)
    for k in range(1, window + 1):
        h = h * np.uint32(0x01000193) + data[spaces - k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    hit = spaces[(h & np.uint32((1 << bits) - 1)) == 0]
    doc = np.searchsorted(offsets, hit, side="right") - 1
    return hit[(hit - window >= offsets[doc]) & (hit + 1 < offsets[doc + 1])]


class Codec:
    """Encodes and decodes texts in one Python worker."""

    def __init__(self, path: str) -> None:
        self.tokenizer = library(path)
        with open(path, encoding="utf-8") as f:
            # tokens are joined by a space unless the file states a decoder, whose output cannot be joined
            self.joins = json.load(f).get("decoder") is None
        self.chunks: dict[str, Coded] = {}
        self.pieces = Memo(PIECE_MEMO)
        self.agrees: dict[str, bool] = {}
        self.decimal = [str(i) for i in range(self.tokenizer.get_vocab_size())]

    def library_codes(self, texts: list[str]) -> list[Coded]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False) if self.joins else [""] * len(ids)
        return [Coded(len(i), " ".join(map(self.decimal.__getitem__, i)), d) for i, d in zip(ids, decoded)]

    def joinable(self, left: str, right: str, between: str = " ") -> bool:
        """Does a cut between two non-empty sides leave the ids as they are?

        Asked of the library with the characters next to the cut, once for each pair.
        """
        pair = left[-1] + between + right[0]
        if pair not in self.agrees:
            texts = [pair, pair[0], between + right[0], right[0]]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.agrees[pair] = ids[0] == ids[1] + ids[2] == ids[1] + ids[3]
        return self.agrees[pair]

    def repaired(self, sides: list[str]) -> list[str]:
        """``sides`` with every join that does not agree taken out again."""
        agrees = self.agrees
        if "" not in sides and all(agrees.get(f"{a[-1]} {b[0]}") for a, b in zip(sides, sides[1:])):
            return sides
        out = sides[:1]
        for side in sides[1:]:
            if not out[-1] or not side or not self.joinable(out[-1], side):
                out[-1] = f"{out[-1]} {side}"
            else:
                out.append(side)
        return out

    def join(self, parts: list[Coded]) -> Coded:
        if not parts:
            return Coded(0, "", "")
        n, ids, texts = zip(*parts)
        if 0 in n:  # nothing is joined to what has no ids
            return self.join([p for p in parts if p.n]) if any(n) else Coded(0, "", "")
        return Coded(sum(n), " ".join(ids), " ".join(texts))

    def encode(self, texts: list[list[str]]) -> list[Coded]:
        """Codes of texts given as their chunks (cut at spaces)."""
        texts = [self.repaired(chunks) for chunks in texts]
        new = {c for chunks in texts for c in chunks}.difference(self.chunks)
        if len(self.chunks) + len(new) > CHUNK_MEMO:
            self.chunks.clear()
            new = {c for chunks in texts for c in chunks}
        split = {c: self.repaired(c.split(" ")) for c in new}
        missing = self.pieces.missing(set().union(*split.values()))
        if missing:
            self.pieces.learn(self.learned(missing))
        of = self.pieces.of.__getitem__
        self.chunks.update((c, self.join(list(map(of, pieces)))) for c, pieces in split.items())
        self.pieces.settle()
        return [self.join([self.chunks[c] for c in chunks]) for chunks in texts]

    def parts(self, piece: str) -> list[str] | None:
        """Where a new piece may be cut once more: at line breaks and before a closing mark."""
        sides = piece.split("\n")
        if len(sides) > 1:
            if "" not in sides and all(self.joinable(a, b, "\n") for a, b in zip(sides, sides[1:])):
                return sides
        elif len(piece) > 1 and piece[-1] in ".," and piece[-2].isalpha() and self.joinable(piece[:-1], piece[-1], ""):
            return [piece[:-1], piece[-1]]
        return None

    def learned(self, missing: set[str]) -> dict[str, Coded]:
        """Codes of new pieces; all that cannot be joined from known ones go to the library in one batch."""
        known, levels = self.pieces.of, []
        for _ in range(2):  # lines first, then the marks that close them
            cut = {p: parts for p in missing if (parts := self.parts(p))}
            levels.append(cut)
            missing = (missing - cut.keys()) | {q for parts in cut.values() for q in parts if q not in known}
        last = list(missing)
        out = dict(zip(last, self.library_codes(last))) if last else {}
        for cut in reversed(levels):
            out.update((p, self.join([known.get(q) or out[q] for q in parts])) for p, parts in cut.items())
        return out

    def decoded(self, code: Coded) -> str:
        if self.joins:
            return code.text
        return self.tokenizer.decode([int(i) for i in code.ids.split()], skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One codec a worker process: what a task learned serves the next."""
    return Codec(path)


def chunked(data: np.ndarray, offsets: np.ndarray) -> list[list[str]]:
    """The chunks of each text; joined by a space they are the text."""
    cuts = cut_points(data, offsets)
    first = np.searchsorted(cuts, offsets)
    raw, cuts, at = data.tobytes(), cuts.tolist(), offsets.tolist()
    out = []
    for i in range(len(at) - 1):
        edges = [at[i] - 1, *cuts[first[i] : first[i + 1]], at[i + 1]]
        out.append([raw[a + 1 : b].decode("utf-8") for a, b in zip(edges, edges[1:])])
    return out


def bpe_code(text: Column, path: str, with_text: bool = False) -> Column:
    """Struct of a text column: n_tokens, ids_sha256, decoded_sha256; with ``with_text`` also ids and decoded."""
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if with_text else "")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(path)
        for column in batches:
            n, ids, decoded, kept = [], [], [], ([], [])
            for data, offsets in byte_blocks(column):
                for code in codec.encode(chunked(data, offsets)):
                    back = codec.decoded(code)
                    n.append(code.n)
                    ids.append(hashlib.sha256(code.ids.encode()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_text:
                        kept[0].append(code.ids)
                        kept[1].append(back)
            arrays = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                arrays += [pa.array(k, pa.string()) for k in kept]
                names += ["ids", "decoded"]
            yield pa.StructArray.from_arrays(arrays, names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, fields)(text)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded on request).

    Null and empty texts have no tokens and the digests of the empty string; null ids stay;
    repeated rows repeat; an empty table gives no rows; other columns are not read.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    return docs.select("doc_id", bpe_code(F.col("text"), path, with_text).alias("code")).select("doc_id", "code.*")
