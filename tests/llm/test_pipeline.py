import public_tokenizers
from test_similar import brute
from test_tokens import check_packed
from tokenizers import Tokenizer

import corpus_pipeline
from tickloom.llm import language, quality
from tickloom.llm.queries import ORACLE_SQL, QUERIES, language_model, quality_model

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    """Filters by the operators' own scores, near duplicates by all pairs, packing by checking every bin."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality.quality_of(docs, quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect() if r["predicted"]}
    said = {r["doc_id"] for r in language.language_of(docs, language_model(docs)).collect() if r["lang_pred"] != "und" and r["score"] >= language.UNCLEAR}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good & said]
    kept = {i for i, _, c in brute(rows, 5, 80) if i == c}
    assert 0 < len(kept) < len(rows) < docs.count()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, SF).collect()
    bins = check_packed(out, [(i, t) for i, t in rows if i in kept], tokenizer, 2048)
    assert bins <= 1 + -(-sum(r["length"] for r in out) // 2048)


def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (odd_docs, no_docs):
            assert stage(spark, df, SF).columns == df.columns, name
    labelled = corpus_pipeline.keep_one(spark, odd_docs, SF).collect()
    ids = [r["doc_id"] for r in labelled]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2 and {3, 4, 5, 6, 8} <= set(ids) and 9 not in ids
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, SF).count() > 0


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "packing"]


def test_registered():
    import __spark_entry__

    assert [q for q in __spark_entry__.queries() if q.startswith("op")] == list(QUERIES)
    assert "pipeline" in __spark_entry__.queries() and set(ORACLE_SQL) <= set(QUERIES)
