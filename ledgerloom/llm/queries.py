"""The registered queries: each applies one operator to its whole table and digests its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, chat_tree, conversation_repair, decontaminate, hard_negatives, html_extract, language_ppm, ngram_join, pii, quality_mcd, sstable, substring_dedup, word_bpe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality_mcd.judge(_table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    nodes, leaves = chat_tree.build_trees(chats, path, pattern)
    back = chat_tree.read_back(nodes, leaves, path)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op5_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_ppm.fit_model(docs.where(~_held_out()))
    told = language_ppm.predict(docs.select("doc_id", "text"), model, score_col="score")
    return told.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def counted(kind: str):
        return F.size(F.filter("plain_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("plain_spans").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op7_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = html_extract.extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return told.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = byte_bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, without=("text",))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = sstable.write_tables(docs, tokenizer_file("word_bpe_49k.json"), sstable.default_folder(docs))
    return sstable.token_digests(sstable.read_tables(manifest))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), "start", "words", "distance")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = conversation_repair.repair(conversation_repair.damage(_table(spark, sf_dir, "conversations")))
    return told.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = word_bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"), without=("text",))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.integer_rows(_table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 256)
    return hard_negatives.hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return {**dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0]))), "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from ledgerloom.llm.oracles import ORACLES

    return dict(ORACLES)
