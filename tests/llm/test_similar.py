import re

import numpy as np
import pytest

from tickloom.llm import components, knn, near_duplicates
from tickloom.llm.hashing import shingle_sets, words

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    """(id, set size, component) by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def result(df, k, percent):
    out = near_duplicates.near_duplicates(df, words=k, percent=percent).collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


def edited(r, base, edits):
    w = list(base)
    for at in r.choice(len(w), edits, replace=False):
        w[at] = f"new{r.integers(1 << 30)}"
    return " ".join(w)


def test_words_and_shingles_of_a_block():
    texts = ["A b  C\td", "", " \n", "one", "one two", "é É x y", "a b c d", "A B C D e"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    sets = shingle_sets(data, offsets, 3)
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    assert set(sets[0]) == set(sets[6]) and len(set(sets[6]) & set(sets[7])) == 2
    hashes, first = words(data, offsets)
    assert np.diff(first).tolist() == [4, 0, 0, 1, 2, 4, 4, 5] and hashes[0] == hashes[13 - 2]


def test_sketches_estimate_and_fill():
    r = np.random.default_rng(6)
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for n, keep in ((1, 1), (3, 2), (40, 36), (900, 765), (2000, 1000)):
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:keep], pool[2000 : 2000 + n - keep]]))
        s = near_duplicates.sketches([a, np.zeros(0, np.uint64), b, a])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert (s[0] < np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (s[0] == s[3]).all()
        assert abs((s[0] == s[2]).mean() - true) < 6 * (0.25 / near_duplicates.BINS) ** 0.5
        bits = np.bitwise_count(near_duplicates.one_bits(s)[0] ^ near_duplicates.one_bits(s)[2]).sum()
        assert abs(1 - 2 * bits / near_duplicates.BINS - true) < 6 / near_duplicates.BINS**0.5


def test_documents_against_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for k, percent in ((3, 85), (5, 80)):
        assert result(df, k, percent) == brute(rows, k, percent)


def test_near_copies_of_every_distance(spark):
    """A base with copies from close to far, chains that only hang together by their ends, and shared passages."""
    r = np.random.default_rng(8)
    base = [f"w{r.integers(500)}" for _ in range(160)]
    texts = [edited(r, base, e) for e in r.integers(0, 22, 60)] + [" ".join(base)] * 5
    chain = list(base[::-1])
    for _ in range(25):
        at = r.integers(len(chain))
        chain[at] = f"c{r.integers(1 << 30)}"
        texts.append(" ".join(chain))
    passage = " ".join(base[:40])
    texts += [f"{passage} " + " ".join(f"p{r.integers(1 << 30)}" for _ in range(n)) for n in r.integers(2, 60, 40)]
    order = r.permutation(len(texts))
    rows = [(int(i), texts[j]) for i, j in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 85), (5, 80)):
        want = brute(rows, k, percent)
        assert 5 < len({c for _, _, c in want}) < len(rows)
        assert result(df, k, percent) == want


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert result(odd_docs, 3, 85) == brute(rows, 3, 85)
    assert near_duplicates.near_duplicates(no_docs).count() == 0


def test_ids_that_stand_for_several_texts(spark):
    """Every text of a repeated id links it: with the larger and with the smaller id repeated, and beside an empty row."""
    r = np.random.default_rng(5)
    bases = [[f"{c}{r.integers(1 << 30)}" for _ in range(60)] for c in "pqrst"]
    near = [edited(r, b, 1) for b in bases]
    rows = [(50, " ".join(b)) for b in bases[:3]] + [(10 + i, t) for i, t in enumerate(near[:3])]
    rows += [(3, " ".join(bases[3])), (3, " ".join(bases[4])), (3, " ".join(bases[4])), (30, near[3]), (31, near[4]), (31, ""), (60, None), (60, near[3])]
    for k, percent in ((3, 85), (5, 80)):
        want = brute(rows, k, percent)
        assert {c for i, _, c in want if i in (10, 11, 12, 50)} == {10} and {c for i, _, c in want if i in (3, 30, 31, 60)} == {3}
        assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent) == want


def test_partners_of_a_hot_centre(spark, monkeypatch):
    """One text with many near copies: its partners are dealt out to several tasks."""
    monkeypatch.setattr(near_duplicates, "PARTNERS", 7)
    r = np.random.default_rng(12)
    base = [f"w{r.integers(1 << 30)}" for _ in range(90)]
    rows = [(i, edited(r, base, 1)) for i in range(60)] + [(100 + i, edited(r, base, 30)) for i in range(20)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85) == brute(rows, 3, 85)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(i + 1, i) for i in range(5)] + [(100, 101), (7, 7), (None, 3), (5, None)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, every, k):
    clean = [(i, np.floor(256 * np.array(v, dtype=float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in clean:
        if i % every == 0:
            other = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in clean if j != i)[:k]
            out |= {(i, rank, j, int(-s)) for rank, (s, j) in enumerate(other, 1)}
    return sorted(out)


@pytest.mark.parametrize("block, group", [(16_384, 2_048), (20, 3)])
def test_top_products(spark, monkeypatch, block, group):
    monkeypatch.setattr(knn, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(knn, "QUERIES_PER_GROUP", group)
    r = np.random.default_rng(9)
    near = r.normal(size=(4, 6))
    vectors = [(near[i % 4] * 3 + r.normal(size=6) * 0.1).tolist() for i in range(120)] + [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0]] * 40
    rows = list(enumerate(vectors)) + [(200, None), (205, []), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (215, [float("nan")] * 6), (220, [float("inf")] + [0.0] * 5), (225, [2.0, 1.0]), (None, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS Rank")
    rows = [(x["vec_id"], x["embedding"]) for x in df.collect()]
    got = sorted(map(tuple, knn.top_products(df, every=5, k=5).collect()))
    assert got == brute_top(rows, 5, 5)


def test_top_products_prunes(spark):
    """Of far clusters only the near one is sent."""
    r = np.random.default_rng(10)
    x = np.concatenate([r.normal(size=(60, 3)) * 0.01 + c for c in np.eye(3) * 50])
    cells = knn.Cells(knn.Cells(np.zeros((1, 4)), float((x * x).sum(1).max())).lift(x[::60]), float((x * x).sum(1).max()))
    cell, d = cells.nearest(cells.lift(x))
    summary = [{"cell": c, "near": np.sort(d[cell == c])[:6].tolist()} for c in range(3)]
    q_cell, q_d = cells.nearest(cells.lift(x[:5], query=True))
    need = knn._sent(summary, {int(q_cell[0]): float(q_d.max())}, cells, 6)
    assert (d[cell == q_cell[0]] >= need[int(q_cell[0])][q_cell[0]]).all()


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert knn.top_products(spark.createDataFrame([], schema)).count() == 0
    assert knn.top_products(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    assert knn.top_products(spark.createDataFrame([(50, [1.0])], schema)).count() == 0
    got = knn.top_products(spark.createDataFrame([(50, [1.0]), (3, [0.5]), (2, [0.5])], schema)).collect()
    assert sorted(map(tuple, got)) == [(50, 1, 2, 256 * 128), (50, 2, 3, 256 * 128)]


def test_bound_counts_an_id_once(spark):
    rows = spark.createDataFrame([(50, 0, 0.0)] * 6 + [(50, 1, 0.5), (1, 0, 2.0), (2, 1, 3.0)], "vec_id long, cell int, d double")
    assert sorted((r["cell"], r["near"]) for r in knn._smallest(rows, 3)) == [(0, [0.0, 2.0]), (1, [3.0])]
