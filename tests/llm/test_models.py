import numpy as np
import pytest

from tickloom.llm import language, licences, quality
from tickloom.llm.queries import language_model, quality_model

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def languages(docs):
    return language_model(docs)


@pytest.fixture(scope="module")
def field(spark, docs):
    return quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_codewords_keep_apart():
    for n in (2, 3, 4, 6, 7, 20):
        code = language.codewords(n)
        agree = (code @ code.T)[~np.eye(n, dtype=bool)] / code.shape[1]
        assert agree.max() < 0.5 and (np.abs(code.sum(0)) < n).all()
    assert language.codewords(4).shape == (4, 7)
    assert language.codewords(1).shape == (1, 1) and language.codewords(0).shape == (0, 1)


def test_decoding_corrects_a_wrong_bit():
    code = language.codewords(4)
    model = language.LanguageModel(("a", "b", "c", "d"), code, np.zeros((4, 7)), np.zeros(7), np.ones(7))
    for c in range(4):
        for wrong in range(7):
            margins = 4 * code[c].copy()
            margins[wrong] *= -0.5
            assert model.decode(margins[None]).argmax() == c
    assert model.decode(np.zeros((1, 7))).max() == pytest.approx(0.25)


def test_held_out_language(docs, languages):
    rows = language.language_of(docs, languages).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(cast(doc_id AS string)) % 3 = 1").collect()
    assert len(rows) > 250
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_rows(odd_docs, no_docs, languages):
    rows = language.language_of(odd_docs, languages).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == "en" and by[1]["score"] == by[2]["score"]
    assert by[7]["lang_pred"] in languages.languages
    assert language.language_of(no_docs, languages).count() == 0


def test_language_without_rows_to_learn_from(odd_docs, no_docs):
    model = language.train(no_docs.selectExpr("doc_id AS key", "text", "lang"))
    assert {r["lang_pred"] for r in language.language_of(odd_docs, model).collect()} == {"und"}
    one = language.train(odd_docs.selectExpr("doc_id AS key", "text", "lang"))
    assert one.languages == ("en",)
    assert {r["lang_pred"] for r in language.language_of(odd_docs, one).collect()} == {"und", "en"}


def test_slots_of_a_batch_are_those_of_each_text():
    texts = [b"abc", b"", b"x", b"Hello World", "süß".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = language.gram_vectors(data, offsets)
    for i, t in enumerate(texts):
        own = np.frombuffer(t, np.uint8)
        assert (whole[i] == language.gram_vectors(own, np.array([0, len(own)]))[0]).all()


def test_held_out_quality(spark, docs, field):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_of(docs, field).join(labels, "doc_id").where("crc32(cast(doc_id AS string)) % 5 = 0").collect()
    assert len(rows) > 40
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_rows(odd_docs, no_docs, field):
    rows = quality.quality_of(odd_docs, field).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert [(by[i]["score"], by[i]["predicted"]) for i in (3, 4, 5)] == [(0.0, 0)] * 3
    assert by[1]["score"] == by[2]["score"]
    assert quality.quality_of(no_docs, field).count() == 0


def test_quality_without_labels(odd_docs):
    rows = odd_docs.selectExpr("doc_id AS key", "text")
    model = quality.train(rows, rows.selectExpr("key", "CAST(NULL AS int) AS label"))
    assert {round(r["score"], 6) for r in quality.quality_of(odd_docs, model).collect()} <= {0.0, 0.5}


def paths(emission, stay):
    """Every labelling of a short text with its weight."""
    n = len(emission)
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        yield y, np.exp(sum(e for e, k in zip(emission, y) if k) + sum(stay[a] for a, b in zip(y, y[1:]) if a == b))


def test_marginals_against_all_labellings():
    r = np.random.default_rng(5)
    sizes = [3, 0, 1, 6, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, stay, weight = r.normal(size=sum(sizes)), (0.7, 1.1), r.random(sum(sizes))
    good, pairs = quality.chain(e, first, stay, weight)
    expected = np.zeros(2)
    for a, b in zip(first, first[1:]):
        all_ = list(paths(e[a:b], stay))
        z = sum(w for _, w in all_)
        for i in range(a, b):
            assert good[i] == pytest.approx(sum(w for y, w in all_ if y[i - a]) / z)
            if i > a:
                for k in (0, 1):
                    expected[k] += weight[i] * sum(w for y, w in all_ if y[i - a] == y[i - a - 1] == k) / z
    assert pairs == pytest.approx(expected)


def test_line_features_do_not_depend_on_the_batch():
    texts = [b"One line here.\nAnd ANOTHER!! line | x\n\n  \nthird", b"", b"\n\n", b"single", "Über süß.\nNo".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, first = quality.lines_of(data, offsets)
    assert np.diff(first).tolist() == [3, 0, 0, 1, 2]
    whole = quality.line_features(data, starts, ends, first, offsets)
    for i, t in enumerate(texts):
        own, at = np.frombuffer(t, np.uint8), np.array([0, len(t)])
        s, e, f = quality.lines_of(own, at)
        assert np.allclose(whole[first[i] : first[i + 1]], quality.line_features(own, s, e, f, at))


@pytest.fixture(scope="module")
def licence_model(docs):
    return licences.train(docs)


def test_licences_found(spark, docs, licence_model):
    out = licences.licence_scan(docs, licence_model).join(docs.select("doc_id", "text"), "doc_id").collect()
    known = {"Licensed under the Apache License": "apache", "Released under the MIT License": "mit", "GNU General Public License": "gpl", "CC BY-NC": "cc"}
    for r in out:
        want = {f for mark, f in known.items() if mark in r["text"]}
        if want:
            assert r["licence"] in want and r["confirmed"], r["text"][-200:]
        elif "rights reserved" not in r["text"]:
            assert r["licence"] == "none", r["text"]


def test_native_scores_equal_the_model(spark, licence_model):
    """Brute force in plain Python of what the expression computes."""
    m = licence_model
    lines = ["Released under the MIT License.", "Licensed under the Frobnitz License.", "plain words only", "some licensed software", "This work is dedicated to the public domain, it is."]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    for r in licences.licence_scan(df, m).collect():
        words = licences.words_of(lines[r["doc_id"]])
        if not set(words) & set(m.anchors):
            assert r["licence"] == "none" and r["n_licensed"] == 0
            continue
        z = np.array(m.bias) + sum((np.array(m.weights[g]) for g in set(licences.grams_of(words)) if g in m.weights), np.zeros(len(m.classes)))
        p = np.exp((z - z.max()) / m.temperature)
        p /= p.sum()
        best = m.classes[p.argmax()]
        if best not in ("unknown", "none") and p.max() < m.clear:
            best = "none" if p[-1] > p[-2] else "unknown"
        assert r["licence"] == best
        if best != "none":
            assert r["probability"] == pytest.approx(p.max(), abs=1e-5)


def test_unknown_licence(spark, licence_model):
    df = spark.createDataFrame([(1, "Licensed under the Wobble License."), (2, "Released under the MIT License.")], "doc_id long, text string")
    assert {r["doc_id"]: r["licence"] for r in licences.licence_scan(df, licence_model).collect()} == {1: "unknown", 2: "mit"}


def test_families_left_out_of_the_fit(licence_model):
    """Paragraphs of a family the fit has not seen get no other family's name; those of the families keep theirs."""
    assert licences.CLEAR <= licence_model.clear < 1
    assert licence_model.known >= 0.95 and licence_model.unseen >= 0.75


def test_prose_with_licence_words(spark, licence_model):
    """Sentences that use the words of licences in no licence's order, and a licence of no known family."""
    prose = [
        "The driver lost his license after the third accident.",
        "The software version 3 of the game was released to the public in March, under the terms of the agreement.",
        "All rights were reserved for the general public, free of charge.",
        "A fishing license is required on the lake from April to October.",
        "The museum granted permission to use the hall without limitation.",
    ]
    strange = ["Licensed under the EUPL 1.2.", "Licensed under the Zlib License.", "SPDX-License-Identifier: EPL-2.0", "Released under the Artistic License 2.0."]
    known = ["Released under the MIT License, see the file.", "Parts of it are licensed under the Apache License, Version 2.0, others are not.", "All rights reserved."]
    df = spark.createDataFrame(list(enumerate(prose + strange + known)), "doc_id long, text string")
    out = [(r["licence"], r["confirmed"]) for r in licences.licence_scan(df, licence_model).orderBy("doc_id").collect()]
    assert out[: len(prose)] == [("none", False)] * len(prose)
    assert out[len(prose) : -len(known)] == [("unknown", False)] * len(strange)
    assert out[-len(known) :] == [("mit", True), ("apache", True), ("proprietary", True)]


def test_sentences_kept_from_the_fit(spark, licence_model):
    """Written after the fit was settled: prose with licence words, and licences of families that have no template."""
    prose = [
        "Her pilot's licence was suspended by the authority last week.",
        "The court ruled that the copyright belonged to the heirs of the painter.",
        "Fishermen must carry a valid license and obey the rules of the harbour.",
        "The public library reserves a room for readers on Mondays.",
        "He was licensed as an architect in two states.",
        "The company released its yearly report under pressure from investors.",
        "Use of the pool is free of charge for any person staying at the hotel.",
        "The work was dedicated to his mother and performed in the public square.",
        "This file was found in the archive, and a copy was sent to the police.",
        "Version 4 of the plan was distributed to all members of the foundation.",
        "You may not enter the domain of the king without permission.",
        "The general spoke to the public about the conditions of the war.",
        "The software was free, but the support had to be paid.",
        "A dog license costs ten dollars in this county.",
        "The terms of the mortgage were subject to approval by the bank.",
        "They reserved the right to cancel the concert.",
        "The taxi licence system limits the number of cars.",
        "Prior written notice is required to end the lease.",
        "The poetic license of the author annoyed the historians.",
        "No part of the story was true, said the publication.",
    ]
    strange = [
        "Licensed under the Eclipse Public License 2.0.",
        "This library is distributed under the Boost Software License.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: BSL-1.0",
        "Licensed under the WTFPL.",
        "Distributed under the Open Font License, version 1.1.",
        "Licensed under the European Union Public Licence.",
        "This work is licensed under the Open Database License.",
        "Licensed under the PostgreSQL License.",
        "Released under the Python Software Foundation License.",
    ]
    df = spark.createDataFrame(list(enumerate(prose + strange)), "doc_id long, text string")
    out = [r["licence"] for r in licences.licence_scan(df, licence_model).orderBy("doc_id").collect()]
    assert out == ["none"] * len(prose) + ["unknown"] * len(strange)


def test_cover_needs_order_and_name(spark, licence_model):
    """Brute force of the cover: runs of two and three words, and a name where the template has one."""
    lines = ["Licensed under the MIT License.", "License MIT the under licensed.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."]
    for line in lines:
        words = licences.words_of(line)
        runs = set(licences.ordered_grams(words))
        want = max(
            len(runs & set(licences.ordered_grams(licences.words_of(t)))) / len(licences.ordered_grams(licences.words_of(t)))
            for t in licences.TEMPLATES["mit"]
            if licences.named("mit", words) or not licences.named("mit", licences.words_of(t))
        )
        found = licences.licence_scan(spark.createDataFrame([(1, line)], "doc_id long, text string"), licence_model).first()
        if found["licence"] == "mit":
            assert found["cover"] == pytest.approx(want, abs=1e-6) and found["confirmed"] == (want >= licences.COVER)
        else:
            assert not found["confirmed"]
    assert licences.licence_scan(spark.createDataFrame([(1, lines[0])], "doc_id long, text string"), licence_model).first()["cover"] == 1.0


def test_licence_rows(odd_docs, no_docs, licence_model):
    out = licences.licence_scan(odd_docs, licence_model)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["n_paragraphs"] == 0 and by[i]["licence"] == "none" for i in (3, 4, 5))
    assert (by[11]["licence"], by[11]["confirmed"], by[11]["n_licensed"]) == ("apache", True, 1)
    assert licences.licence_scan(no_docs, licence_model).count() == 0


def test_all_licences_of_a_text(spark, licence_model):
    """Every family is kept, with the paragraph it stands in."""
    text = "A title of it\n\nLicensed under the Apache License, Version 2.0.\nplain words\nReleased under the MIT License.\nLicensed under the Wobble License.\nReleased under the MIT License."
    df = spark.createDataFrame([(1, text), (2, "plain words")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licences.licence_scan(df, licence_model).collect()}
    assert [(x["licence"], x["paragraph"], x["confirmed"]) for x in rows[1]["licences"]] == [("apache", 2, True), ("mit", 4, True), ("unknown", 5, False)]
    assert (rows[1]["n_paragraphs"], rows[1]["n_licensed"], rows[2]["licences"]) == (6, 4, [])
    best = next(x for x in rows[1]["licences"] if x["licence"] == rows[1]["licence"])
    assert [best[c] for c in ("probability", "cover", "confirmed")] == [rows[1][c] for c in ("probability", "cover", "confirmed")]
    each = licences.licence_paragraphs(df, licence_model).orderBy("paragraph").collect()
    assert [(r["doc_id"], r["paragraph"], r["licence"]) for r in each] == [(1, 2, "apache"), (1, 4, "mit"), (1, 5, "unknown"), (1, 6, "mit")]
