"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame with the columns of documents (the last adds ids).

Results for special input, of every stage: other columns than those of documents are left out; an empty table gives an empty table with the stage's columns. A null or
empty text has no language, so it goes in the first stage; in a later one, given such rows itself, it is in no group, matches no passage, holds no personal data and has no ids, and stays.
Null doc_ids stay as they are, and only count as greater than others where one of a group is chosen. Of repeated rows one stays as of any group of copies; before and after that stage they are rows
like others. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, language_ppm, pii

#: A document is rejected when no language is found or the best one has less than this share of the likelihood.
LEAST_SCORE = 0.5
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no learned language fits better than the rest together."""
    model = language_ppm.fit_model(docs)
    told = language_ppm.predict(docs.select(*DOCUMENT_COLUMNS), model, lang_col="_told", score_col="_score")
    return told.where((F.col("_told") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*DOCUMENT_COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id; documents without words stay."""
    from ledgerloom.llm import ngram_join

    return ngram_join.keep_representatives(docs.select(*DOCUMENT_COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    from ledgerloom.llm import decontaminate

    return decontaminate.drop_matching(docs.select(*DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    clean = pii.redact_text(docs.select(*DOCUMENT_COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each text and whether decoding them gives the text back."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = byte_bpe.round_trip(docs.select(*DOCUMENT_COLUMNS), path, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return back.select(*DOCUMENT_COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))
