"""Mixing, resampling and divergence against plain Python over all rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import divergence, mixing, resampling, word_pieces
from tickloom.llm.numbering import numbered

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text, digits):
    return int(hashlib.sha256(f"2024:{text}".encode()).hexdigest()[:digits], 16)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


# ---- numbers ----


def test_numbers_of_a_hot_group(spark):
    df = spark.range(0, 3000, 1, 7).selectExpr("IF(id % 3 = 0, 'few', 'hot') AS g", "CAST(id % 40 AS int) AS v", "id")
    out = numbered(df.repartition(9), ["g"], [F.col("v").desc(), F.col("id")]).collect()
    for g in ("few", "hot"):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: (-r["v"], r["id"]))
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
    assert numbered(df.where("id < 0"), [], [F.col("id")]).count() == 0


# ---- mixing ----


def brute_mix(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """rows of (doc_id, source, size); returns sorted (doc_id, size, source_size, target, taken)."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    capped, total = set(), share * sum(size.values())
    while True:
        free = [s for s in sources if s not in capped]
        each = (total - sum(most * size[s] for s in capped)) / max(sum(weight[s] for s in free), 1e-9)
        more = {s for s in free if each * weight[s] >= most * size[s]}
        if not more:
            break
        capped |= more
    target = {s: most * size[s] if s in capped else each * weight[s] for s in sources}
    out, unit = [], 1 << 24
    for s in sources:
        mine = sorted(((i, n) for i, t, n in rows if t == s), key=lambda x: (-x[1], sha("" if x[0] is None else x[0], 8), -1 if x[0] is None else x[0]))
        left, to_take, place, step = size[s], target[s], sha(s or "", 6), 0
        for at, (i, n) in enumerate(mine):
            if at <= mixing.FIRST:
                step = math.floor(min(max(to_take / left, 0), most) * unit) if left > 0 else 0
            copies = (place + step) // unit - place // unit
            place += step
            to_take, left = to_take - copies * n, left - n
            out.append((i, n, size[s], round(target[s], 6), copies * n if n else 0))
    return sorted(out, key=str)


def mix_rows(df, **options):
    got = mixing.mix_sizes(df, **options).collect()
    assert all(r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] for r in got)
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=str)


def test_mix_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["source"], len(words_of(r["text"]))) for r in df.collect()]
    assert mix_rows(df) == brute_mix(rows)
    assert mix_rows(df.repartition(13)) == brute_mix(rows)
    assert mix_rows(df, weights=(1, 9), share=0.4) == brute_mix(rows, (1, 9), 0.4)


def test_taken_words_come_near_their_targets(spark):
    """A hot source with a few documents that hold half of its words, a small one, one of equal sizes."""
    r = np.random.default_rng(3)
    hot = [("hot", int(n)) for n in r.integers(1, 60, 1500)] + [("hot", n) for n in (3000, 4000, 9000, 20_000)]
    sized = hot + [("small", int(n)) for n in r.integers(1, 90, 40)] + [("even", 7)] * 300
    df = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sized)], "doc_id long, text string, source string")
    out = mixing.mix_sizes(df, weights=(2, 3, 1), share=0.9)
    for row in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(row["taken"] - row["target"]) <= 60, row
    assert all(x["copies"] in (0, 1, 2) for x in out.collect())


def test_expected_copies(spark):
    """Over sources that differ by their offset only, every place is taken as often as its share says."""
    df = spark.range(45).crossJoin(spark.range(60).selectExpr("concat('s', id) AS source")).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 5 AS int)) AS text", "source")
    taken = Counter()
    for r in mixing.mix_sizes(df, weights=(1,), share=0.5).collect():
        taken[r["doc_id"]] += r["copies"]
    assert len(taken) == 45 and min(taken.values()) > 0
    assert all(abs(n / 60 - 0.5) < 0.35 for n in taken.values()) and abs(sum(taken.values()) / 2700 - 0.5) < 0.02


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("source", F.expr("CASE WHEN doc_id < 6 THEN 'a' WHEN doc_id = 6 THEN '' END")).withColumn("SIZE", F.lit("x")).withColumn("Key", F.lit(1))
    rows = [(r["doc_id"], r["source"], len(words_of(r["text"]))) for r in docs.collect()]
    assert mix_rows(docs) == brute_mix(rows)
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    want = Counter({})
    for r in mixing.mix_sizes(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    assert Counter((r["doc_id"], len(words_of(r["text"]))) for r in whole.collect()) == +want
    assert mixing.mix_sizes(no_docs.withColumn("source", F.lit("a"))).count() == 0
    assert mixing.mixed(no_docs.withColumn("source", F.lit("a"))).count() == 0


# ---- resampling ----


def features_of(text, run):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute_resampled(docs, target, percent, least, buckets, run):
    code = lambda f: crc32(f.encode()) % buckets
    s, t = Counter(code(f) for _, x in docs for f in features_of(x, run)[1]), Counter(code(f) for x in target for f in features_of(x, run)[1])
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * big_s / (float(s[b] + 1) * big_t))) for b in s}
    out = []
    for i, x in docs:
        w, f = features_of(x, run)
        weight = sum(gain[code(y)] for y in f)
        noise = math.floor(-1000 * math.log(-math.log((sha("" if i is None else i, 8) + 0.5) / 4294967296)))
        out.append([i, len(f), weight, weight + noise, None, len(w) >= least])
    drawn = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(drawn[: percent * len(drawn) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("run, buckets, percent, accuracy", [(1, 10_000, 10, 10_000), (3, 97, 55, 4)])
def test_resampling_against_brute_force(spark, monkeypatch, run, buckets, percent, accuracy):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resampling.resampled(docs, target, percent, 20, buckets, run, accuracy).collect()
    want = brute_resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], percent, 20, buckets, run)
    assert sorted(map(tuple, got), key=str) == want


def test_runs_reach_over_pieces(monkeypatch):
    monkeypatch.setattr(word_pieces, "PIECE", 16)
    text = "one two three four Five six-seven eight ninety " * 5 + "é" * 40 + " end"
    for run in (1, 2, 4):
        counted = [c for c in resampling.Features(1000, run).counted(text)]
        assert len(counted) > 5
        assert sum((c for _, c in counted), Counter()) == Counter(f.encode() for f in features_of(text, run)[1])
        assert sum(n for n, _ in counted) == len(features_of(text, run)[0])


def test_resampling_of_odd_rows(spark, odd_docs, no_docs):
    """Ties, repeated rows, null ids; a target without rows; an empty table."""
    docs = odd_docs.union(odd_docs.where("doc_id = 1 OR doc_id = 6 OR doc_id IS NULL")).withColumn("Score", F.lit(1))
    target = odd_docs.where("doc_id = 8")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for percent, least in ((50, 1), (100, 0), (3, 0)):
        got = sorted(map(tuple, resampling.resampled(docs, target, percent, least, 50).collect()), key=str)
        assert got == brute_resampled(rows, [r["text"] for r in target.collect()], percent, least, 50, 1)
    got = resampling.resampled(docs, no_docs, 50, 1, 50).collect()
    assert sorted(map(tuple, got), key=str) == brute_resampled(rows, [], 50, 1, 50, 1)
    assert resampling.resampled(no_docs, odd_docs).count() == 0


@pytest.mark.parametrize("accuracy", [1, 3, 10_000])
def test_bracket_holds_the_cutoff(spark, accuracy):
    """Heavy ties and coarse sketches: exact counts widen the bracket until it holds."""
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 7, id % 50 * 100) AS score", "id AS doc_id", "id AS row").cache()
    scores = sorted((r["score"] for r in df.collect()), reverse=True)
    for drawn in (1, 2, 499, 1700, 4999, 5000):
        low, high, above = resampling.cutoff_bracket(df, 5000, drawn, accuracy)
        assert low <= scores[drawn - 1] <= high and above == sum(s > high for s in scores) < drawn


# ---- divergence ----


def brute_divergence(rows, least, top):
    terms = lambda x: re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (x or "").translate(LOWER))
    rows = [(a or "", b or "", terms(x)) for a, b, x in rows]
    docs, count = Counter(), defaultdict(Counter)
    for lang, source, found in rows:
        docs.update((lang, t) for t in set(found))
        count[lang, source].update(found)
    out = []
    for lang in {x for x, _ in count}:
        kept = [t for (a, t), n in docs.items() if a == lang and n >= least]
        own = {s: {t: c[t] for t in kept} for (a, s), c in count.items() if a == lang}
        norm = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        p, q = {s: share(c) for s, c in own.items()}, share(norm)
        for s in own:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]}
            parts["term"] = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


@pytest.mark.parametrize("least, top, block", [(30, 50, 8192), (2, 3, 64)])
def test_divergence_against_brute_force(spark, least, top, block):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = divergence.divergence(df, least, top, block)
    want = brute_divergence([(r["lang"], r["source"], r["text"]) for r in df.collect()], least, top)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_divergence_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(word_pieces, "PIECE", 64)
    docs = odd_docs.withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 3 = 1 THEN 'é' END")).withColumn("TERM", F.lit("x")).withColumn("Rank", F.lit(1))
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    for least, block in ((1, 3), (2, 8192), (1000, 8192)):
        got = divergence.divergence(docs, least, 4, block)
        assert sorted(map(tuple, got.collect())) == brute_divergence(rows, least, 4)
    assert divergence.divergence(no_docs.withColumn("source", F.lit("a"))).count() == 0


def test_shares_beyond_64_bits():
    """Counts whose products leave 64 bits stay exact."""
    runs = divergence.Runs(np.array([0, 0, 10**13, 10**13, 7]), 3 * 10**13, 5)
    want = [1 + 10**9 * (c + 5) // (3 * 10**13 + 25) for c in (0, 0, 10**13, 10**13, 7)]
    assert runs.at(np.arange(5)).tolist() == want and len(runs.starts) == 3
    other = divergence.Runs(np.array([1, 1, 1, 2, 2]), 7, 5)
    assert divergence.difference(runs, other, 5) == sum(abs(a - b) for a, b in zip(want, other.at(np.arange(5)).tolist(), strict=True))
