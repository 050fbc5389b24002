"""A training corpus from documents: quality, language, near duplicates, packing.

Every stage takes (spark, docs, sf_dir); the runner writes its result as Parquet and
reads it again as the next stage's docs. Filtering stages return the columns they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import language, near_duplicates, packing, quality
from tickloom.llm.frames import by_position, kept_rows, position
from tickloom.llm.queries import language_model, quality_model, table, tokenizer_path
from tickloom.session import pin, scratch_path, ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier predicts 1; the model is that of the query, fitted on the supplied labels."""
    model = quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = spark.sparkContext.broadcast(model)
    return kept_rows(docs, "text", lambda text: quality.quality_score(text, held) >= quality.THRESHOLD)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those without letters, or that no codeword fits clearly, go."""
    model = language_model(table(spark, sf_dir, "documents"))
    held = spark.sparkContext.broadcast(model)

    def clear(text: Column) -> Column:
        said = language.predict(text, held)
        return (said["lang_pred"] != language.UNKNOWN) & (said["score"] >= language.UNCLEAR)

    return kept_rows(docs, "text", clear)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that with the smallest id.

    Rows with a null id stay; of rows that repeat an id one stays.
    """
    found = near_duplicates.near_duplicates(docs, words=5, percent=80)
    kept = pin(found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("rows")))
    flat, own = by_position(docs), F.col(f"_{position(docs, 'doc_id')}")
    chosen = flat.join(kept.select("kept_id"), own == F.col("kept_id"))
    if not kept.where("rows > 1").isEmpty():
        chosen = chosen.dropDuplicates(["kept_id"])
    chosen = chosen.drop("kept_id")
    return chosen.union(flat.where(own.isNull())).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences, by best-fit packing."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_one),
    ("packing", pack),
]

#: The classifiers and the tokenizer have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            folder = scratch_path(spark, f"pipeline-{name}")
            out.write.parquet(folder)
            out = spark.read.parquet(folder)
        docs = out
    return docs
