"""Token counts by whole-token shortcut.

Offline (on the driver, once per vocabulary file) it is proved by the library itself
which vocabulary strings encode alone as exactly one token, and for which characters
the pre-token pattern splits as the library splits. A pre-token that is a proven string
counts 1 without any merge; merges run only for the rest, once per distinct pre-token
and worker while its memo holds it. Texts with a character that is not proven, and
vocabularies of another kind, are counted by the library as they are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.frames import pick, texts_of

# The byte-level pre-token pattern and the first code point of its stand-ins for bytes.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STAND_IN_START = 256

MEMO_ENTRIES = 300_000
BLOCK_CHARS = 1 << 20


def stand_ins() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: that character -> byte."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = sorted(set(range(256)) - set(kept))
    return {chr(b): b for b in kept} | {chr(STAND_IN_START + i): b for i, b in enumerate(others)}


def library(path: str):
    """The tokenizer of a .json file; its threads stay off, because Spark runs the tasks in parallel."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@dataclass(frozen=True)
class Proof:
    """What was proved of a vocabulary file: one-token strings, unproven characters, special strings."""

    path: str
    single: frozenset[str] = frozenset()
    unproven: str = ""
    specials: tuple[str, ...] = ()
    shortcut: bool = field(default=False)


def prove(path: str) -> Proof:
    """Run the library over its own vocabulary and over the characters of the basic plane."""
    if not path.endswith(".json"):
        return Proof(path)
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    pre = stated.get("pre_tokenizer") or {}
    added = stated.get("added_tokens", [])
    plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in added)
    if stated.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        return Proof(path)
    tokenizer, of = library(path), stand_ins()
    strings = []
    for token in stated["model"]["vocab"]:
        try:
            strings.append(bytes(of[c] for c in token).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue  # a special string, or part of a character: never a whole pre-token
    find = regex.compile(PRE_TOKEN).findall
    strings = [s for s in strings if find(s) == [s]]
    single = frozenset(s for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1)
    split = tokenizer.pre_tokenizer.pre_tokenize_str

    def cuts(pieces: list[str]) -> list[int]:
        return [len(p) for p in pieces]

    odd = []
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        probe = f"a{chr(code)}1{chr(code)}!{chr(code)} {chr(code)}b"
        if [b - a for _, (a, b) in split(probe)] != cuts(find(probe)):
            odd.append(code)
    unproven = "".join(f"\\U{c:08x}" for c in odd) + "\\U00010000-\\U0010ffff"
    return Proof(path, single, f"[{unproven}]", tuple(a["content"] for a in added), True)


class Counter:
    """Counts tokens in one Python worker."""

    def __init__(self, proof: Proof) -> None:
        self.proof, self.memo = proof, {}
        if proof.path.endswith(".json"):
            self.tokenizer = library(proof.path)
            self.whole = lambda texts: [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=proof.path)
            self.whole = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
        if proof.shortcut:
            self.find = regex.compile(PRE_TOKEN).findall
            self.odd = regex.compile(proof.unproven).search
            self.special = regex.compile("|".join(map(regex.escape, proof.specials))) if proof.specials else None
            size = self.tokenizer.get_vocab_size()
            self.opens = np.zeros(size, dtype=bool)
            space = next(c for c, b in stand_ins().items() if b == 32)
            for token, i in self.tokenizer.get_vocab().items():
                self.opens[i] = token.startswith(space)

    def _merge(self, missing: list[str]) -> None:
        """Token counts of pre-tokens not yet in the memo, by the library."""
        # " word" pre-tokens can stand side by side in one text: each opens with the only space it has
        side = [p for p in missing if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        if side:
            ids = self.tokenizer.encode_batch_fast(["".join(side)], add_special_tokens=False)[0].ids
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(side):
                self.memo.update(zip(side, np.diff(np.append(starts, len(ids))).tolist()))
        apart = [p for p in missing if p not in self.memo]
        if apart:
            self.memo.update(zip(apart, self.whole(apart)))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.proof.shortcut:
            return self.whole(texts)
        out, rests, single = [], [], self.proof.single
        for text in texts:
            if not text.isascii() and self.odd(text):
                out.append(self.whole([text])[0])
                rests.append(())
                continue
            n, parts = 0, [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                n = len(parts) - 1
            rest = []
            for part in parts:
                found = self.find(part)
                more = [p for p in found if p not in single]
                n += len(found) - len(more)
                rest += more
            out.append(n)
            rests.append(rest)
        missing = set().union(*rests).difference(self.memo)
        if len(self.memo) + len(missing) > MEMO_ENTRIES:
            self.memo.clear()
            missing = set().union(*rests)
        if missing:
            self._merge(list(missing))
        of = self.memo.__getitem__
        return [n + sum(map(of, rest)) for n, rest in zip(out, rests)]


def blocks(texts: Iterator[str], chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Lists of texts of about ``chars`` characters; one text at least."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_count(text: Column, proof: Proof) -> Column:
    """Number of tokens of a text column (long; 0 for null and empty texts)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(proof)
        for column in batches:
            yield pa.array([n for block in blocks(texts_of(column)) for n in counter.counts(block)], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(text)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows
    give repeated rows; an empty table gives none; other columns are not read.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = docs.select("doc_id", n_bytes.alias("n_bytes"), token_count(F.col("text"), prove(path)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
