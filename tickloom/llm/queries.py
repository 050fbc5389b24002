"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe_codec, divergence, html_text, knn, language, licences, media, mixing, near_duplicates, packing, quality, resampling, token_counts
from tickloom.session import ship_package


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def language_model(docs: DataFrame, held: int | None = 1) -> language.LanguageModel:
    """Fitted on documents outside fold ``held`` of 3 (of all for None)."""
    rows = docs if held is None else docs.where(_fold(3) != held)
    return language.train(rows.select(F.col("doc_id").alias("key"), "text", "lang"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.language_of(docs, language_model(docs))
    return out.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.licence_scan(docs, licences.train(docs))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.LineField:
    """Fitted on labelled documents outside fold 0 of 5."""
    marked = labels.where(_fold(5) != 0).select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("label"))
    return quality.train(docs.select(F.col("doc_id").alias("key"), "text"), marked)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.quality_of(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_products(table(spark, sf_dir, "embeddings"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_text(table(spark, sf_dir, "pages"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates,
        op2_token_counts,
        op3_language,
        op4_licences,
        op5_quality,
        op6_packing,
        op7_media,
        op8_top_products,
        op9_bpe_codec,
        op10_page_text,
        op11_source_mix,
        op12_resampling,
        op13_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), x -> x <> '') AS ws
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), i -> ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
            FROM w
        ), flat AS (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS h FROM s),
        rare AS (SELECT h, count(*) AS df FROM flat GROUP BY h HAVING count(*) > 1),
        kept AS (SELECT f.* FROM flat f JOIN rare USING (h)),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
            FROM kept a JOIN kept b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), edges AS (
            SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)
            UNION ALL SELECT b, a FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)
        ), reach AS (
            SELECT doc_id AS id, doc_id AS r FROM documents
            UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a
        ), c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.id
    """,
    "op8_top_products": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
            FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_source_mix": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS draw
            FROM documents
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, draw, doc_id) AS n FROM d),
        w AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM d GROUP BY source
        ), level AS (
            SELECT (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS each
            FROM w WINDOW before AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT *, least(2.0 * source_size, (SELECT max(each) FROM level) * weight) AS target,
                CAST('0x' || substr(sha256('2024:' || coalesce(source, '')), 1, 6) AS BIGINT) AS start
            FROM w
        ), fold AS (
            SELECT source, 0 AS n, target AS words, CAST(source_size AS DOUBLE) AS rest, start AS place, 0 AS copies FROM t
            UNION ALL
            SELECT source, n, words - copies * size, rest - size, place, copies FROM (
                SELECT f.source, r.n, f.words, f.rest, r.size, f.place + s.step AS place, ((f.place + s.step) >> 24) - (f.place >> 24) AS copies
                FROM fold f JOIN ranked r ON f.source IS NOT DISTINCT FROM r.source AND r.n = f.n + 1 AND r.n <= 64,
                LATERAL (SELECT CAST(CASE WHEN f.rest > 0 THEN floor(greatest(least(f.words / f.rest, 2.0), 0.0) * 16777216) ELSE 0 END AS BIGINT) AS step) s
            )
        ), late AS (
            SELECT source, place, CAST(CASE WHEN rest > 0 THEN floor(greatest(least(words / rest, 2.0), 0.0) * 16777216) ELSE 0 END AS BIGINT) AS step FROM fold WHERE n = 64
        )
        SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, t.source_size, t.target,
            CAST(r.size * CASE WHEN r.size = 0 THEN 0 WHEN r.n <= 64 THEN f.copies ELSE ((l.place + (r.n - 64) * l.step) >> 24) - ((l.place + (r.n - 65) * l.step) >> 24) END AS BIGINT) AS taken
        FROM ranked r JOIN t ON r.source IS NOT DISTINCT FROM t.source
        LEFT JOIN fold f ON r.source IS NOT DISTINCT FROM f.source AND r.n = f.n
        LEFT JOIN late l ON r.source IS NOT DISTINCT FROM l.source
    """,
    "op12_resampling": r"""
        WITH RECURSIVE bits AS (
            SELECT i, 0 AS k, i AS c FROM range(256) r(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8
        ), tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
        words AS (
            SELECT row_id, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
            FROM (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents UNION ALL SELECT -item_id - 1, NULL, text FROM benchmark)
        ), counted AS (SELECT row_id, w, count(*) AS n FROM words GROUP BY ALL),
        codes AS (
            SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, 2 * strlen(w), 2), lambda i: CAST('0x' || substr(hex(encode(w)), i, 2) AS BIGINT))),
                lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) % 10000 AS bucket
            FROM (SELECT DISTINCT w FROM counted), tab
        ), sums AS (
            SELECT bucket, sum(n) FILTER (row_id >= 0) AS s, sum(n) FILTER (row_id < 0) AS t FROM counted JOIN codes USING (w) GROUP BY bucket
        ), whole AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
        gain AS (
            SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(sums.t, 0) AS DOUBLE) + 1) * (CAST(whole.s AS DOUBLE) + 10000) / ((CAST(coalesce(sums.s, 0) AS DOUBLE) + 1) * (CAST(whole.t AS DOUBLE) + 10000)))) AS BIGINT) AS g
            FROM sums, whole
        ), weights AS (
            SELECT row_id, sum(n) AS n_features, sum(n * g) AS weight FROM counted JOIN codes USING (w) JOIN gain USING (bucket) WHERE row_id >= 0 GROUP BY row_id
        ), scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM (SELECT row_number() OVER () AS row_id, doc_id FROM documents) LEFT JOIN weights USING (row_id)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS total FROM scored
        )
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
            CASE WHEN n_features >= 20 AND place <= 10 * total // 100 THEN CAST(place AS BIGINT) END AS rank
        FROM placed
    """,
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        words AS (SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT row_id) >= 30),
        grp AS (SELECT DISTINCT lang, source FROM d),
        own AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
        size AS (SELECT grp.lang, grp.source, coalesce(sum(c), 0) AS n FROM grp LEFT JOIN own USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT size.lang, size.source, kept.term, coalesce(own.c, 0) AS c, 1 + 1000000000 * (coalesce(own.c, 0) + 5)::HUGEINT // (size.n + 5 * v.v) AS p,
                1 + 1000000000 * (kept.c + 5)::HUGEINT // (v.n + 5 * v.v) AS q
            FROM size JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN own ON own.lang = size.lang AND own.source = size.source AND own.term = kept.term
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
            FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
                ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        ), both_parts AS (
            SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM both_parts)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 50
    """,
}
