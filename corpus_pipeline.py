"""From raw documents to tokens: five stages, each over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.llm import bpe, decontaminate, jaccard, language, pii
from popweave.session import cut

#: Calibrated probability below which a language is not trusted; it is far below what running text of a known language gets.
MIN_LANGUAGE_SCORE = 0.4
#: Characters below which a text is too short to be distrusted.
SHORT_TEXT = 80
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones too) and longer texts of no trusted language; changes no row.

    The model learns from the labelled rows of ``docs``.  If none is labelled nothing can be told apart, and
    only texts without letters go.
    """
    model = language.fit(docs, language.remainder("i", 4) != 2)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = language.identify(docs, model, lang_out="_language", score_out="_language_score")
    trusted = (F.col("_language_score") >= MIN_LANGUAGE_SCORE) | (F.length("text") < SHORT_TEXT)
    return named.where((F.col("_language") != language.UNKNOWN) & trusted).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of copies and near copies (5 words, similarity 0.8).

    Rows are judged by id and text: where an id is repeated with other texts, a text that no other row is
    like stays, and of near copies under the smallest id one stays.  Repeated rows of one id and text become
    one row; rows without an id are kept, as nothing can name them.  Texts without words are never copies.
    """
    found = jaccard.near_duplicates(docs, width=5, num=4, den=5)
    gone = found.where(F.col("doc_id").isNotNull() & ~F.col("first")).select("doc_id", F.col("text_hash").alias("_text_hash")).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("_text_hash", F.xxhash64("text"))
    kept = named.join(gone, ["doc_id", "_text_hash"], "left_anti").drop("_text_hash").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover at least a twentieth of the words; changes no other."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; keeps every row, and n_chars right."""
    clean = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return clean.select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, their number and digest, and the digest of what they decode to."""
    return bpe.token_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: The stages train models and read whole texts in ways that SQL has no words for; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
