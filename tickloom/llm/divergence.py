"""Divergence between the sources of a language, over run-length columns.

Terms are counted by (language, source). A language keeps the terms of enough documents.
Its vocabulary is put into an order in which terms with equal counts stand together and is
cut into blocks; in a block every source is a column of runs of equal counts, a pair's runs
are intersected, and the difference of two runs counts for all terms they share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.frames import pick
from tickloom.llm.numbering import numbered
from tickloom.llm.word_pieces import Words
from tickloom.session import pin

LEAST_DOCS = 30
TOP = 50
UNITS = 1_000_000_000
SMOOTH = 5
BLOCK_TERMS = 4_096
HELD_TERMS = 200_000
BETWEEN = rb"\x00-\x40\x5B-\x60\x7B-\x7F"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents of a term in a group, partly added up.

    A row with an empty term stands for the group itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(BETWEEN), {}, 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (occurs, within) in held.items():
                terms = list(occurs)
                n = len(terms) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                        pa.array([b"", *terms], pa.binary()).cast(pa.string()),
                        pa.array([0, *occurs.values()], pa.int64()), pa.array([0, *(within[t] for t in terms)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "c", "d"],
                )
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                occurs, within = held.setdefault((lang.as_py() or "", source.as_py() or ""), (Counter(), Counter()))
                before, seen = len(occurs), set()
                for found in words.pieces(text.as_py()):
                    occurs.update(found)
                    seen.update(found)
                within.update(seen)
                size += len(occurs) - before
                if size > HELD_TERMS:
                    yield from rows()
                    size = 0
        yield from rows()

    return docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, c long, d long")


class Runs:
    """A column of counts as runs: where they start and the smoothed share of each."""

    def __init__(self, counts: np.ndarray, total: int, terms: int) -> None:
        change = np.flatnonzero(counts[1:] != counts[:-1]) + 1
        self.starts = np.concatenate([[0], change])
        values, back = np.unique(counts[self.starts], return_inverse=True)
        share = [1 + UNITS * (c + SMOOTH) // (total + SMOOTH * terms) for c in values.tolist()]  # integers of any size
        self.share = np.array(share, dtype=np.int64)[back]

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.share[np.searchsorted(self.starts, places, side="right") - 1]


def difference(a: Runs, b: Runs, size: int) -> int:
    """Sum of |share of a - share of b| over ``size`` terms, one product per shared run."""
    starts = np.union1d(a.starts, b.starts)
    return int((np.abs(a.at(starts) - b.at(starts)) * np.diff(starts, append=size)).sum())


def _block(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Parts of one block: sums of pairs (item after source) and the best terms of each source."""
    out: dict[str, list] = {k: [] for k in ("lang", "source", "part", "item", "value")}
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    size = terms.num_rows
    if size and groups.num_rows:
        terms = terms.sort_by("n")
        names = groups.column("source").to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i].encode())
        lang, kept, all_of_lang = (groups.column(c)[0].as_py() for c in ("of_lang", "terms", "lang_total"))
        lists = terms.column("counts").combine_chunks()
        inner = lists.flatten()
        row = np.repeat(np.arange(size), np.diff(lists.offsets.to_numpy()))
        code = {name: i for i, name in enumerate(names)}
        of = np.array([code[s] for s in inner.field("source").to_pylist()], dtype=np.int64)
        counts = inner.field("c").to_numpy(zero_copy_only=False)
        by_source = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[by_source], np.arange(len(names) + 1))
        words = terms.column("term").to_pylist()
        whole = np.add.reduceat(counts, lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())
        norm = Runs(whole, all_of_lang, kept).at(np.arange(size))
        columns = []
        for i, total in enumerate(groups.column("total").to_pylist()):
            own = by_source[edges[i] : edges[i + 1]]
            column = np.zeros(size, np.int64)
            column[row[own]] = counts[own]
            columns.append(Runs(column, total, kept))
            excess = np.where(column > 0, columns[-1].at(np.arange(size)) - norm, 0)
            best = np.flatnonzero(excess > 0)
            if len(best) > TOP:
                best = best[excess[best] >= np.partition(excess[best], len(best) - TOP)[len(best) - TOP]]
            for at in sorted(best.tolist(), key=lambda at: (-excess[at], words[at].encode()))[:TOP]:
                for k, v in zip(out, (lang, names[i], "term", words[at], int(excess[at])), strict=True):
                    out[k].append(v)
        for x, i in enumerate(order):
            for j in order[x + 1 :]:
                for k, v in zip(out, (lang, names[i], "pair", names[j], difference(columns[i], columns[j], size)), strict=True):
                    out[k].append(v)
    return pa.Table.from_pydict(out, schema=schema)


def divergence(
    df: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) that occurs.

    Part ``pair``: every other source of the language with the summed difference of their
    smoothed shares (parts in a billion, exact), ranked by it. Part ``term``: the ``top`` (at
    most 50) kept terms the group has more of than its language. Ties go to the smaller item in
    UTF-8. Null text, lang or source read as empty; a group without terms has all counts 0, a
    language without kept terms has pairs of value 0. Repeated rows count each time. An empty
    table gives no rows. Other columns are not read.
    """
    if top > TOP:
        raise ValueError(f"top is at most {TOP}")
    docs = pick(df, text=text_col, lang=lang_col, source=source_col)
    counts = pin(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d")))
    occurring = counts.where(F.col("term") == "").select("lang", "source")
    per_term = counts.where(F.col("term") != "").groupBy("lang", "term")
    enough = per_term.agg(F.sum("d").alias("d"), F.sort_array(F.collect_list(F.struct("source", "c"))).alias("counts")).where(F.col("d") >= least_docs)
    # a list holds each source once
    kept = pin(enough.select("lang", "term", "counts", F.size("counts").alias("sources")))
    totals = kept.select("lang", F.explode("counts").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.c").alias("total"))
    groups = pin(occurring.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang")

    # the first counts suffice to put equal ones together, and keep the sampled bounds small
    placed = numbered(kept, ["lang"], [F.col("sources"), F.slice("counts", 1, 8), F.col("term")])
    blocks = placed.withColumn("block", F.expr(f"(n - 1) DIV {block_terms}")).select("lang", "block", "n", "term", "counts")
    number = F.sequence(F.lit(0).cast("long"), F.expr(f"(terms - 1) DIV {block_terms}"))
    headers = groups.join(langs, "lang").select(F.col("lang").alias("of_lang"), "source", "total", "lang_total", "terms", F.explode(number).alias("of_block"))
    both = blocks.groupBy("lang", "block").cogroup(headers.groupBy("of_lang", "of_block"))
    parts = pin(both.applyInArrow(_block, "lang string, source string, part string, item string, value long"))

    sums = parts.where(F.col("part") == "pair").groupBy("lang", F.col("source").alias("lo"), F.col("item").alias("hi")).agg(F.sum("value").alias("value"))
    a, b = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    pairs = a.join(b, "lang").where(F.col("source") != F.col("item")).withColumns({"lo": F.least("source", "item"), "hi": F.greatest("source", "item")})
    pairs = pairs.join(sums, ["lang", "lo", "hi"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = parts.where(F.col("part") == "term")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).where(F.col("rank") <= top))
