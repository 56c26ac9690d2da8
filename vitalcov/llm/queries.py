"""The registered queries of the corpus operators: each applies its operator to whole tables and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalcov.llm import common, decontaminate, fill_middle, jaccard_join, langid, line_dedup, lm_score, packing, pattern_packing, quality_crf, rules, substring_dedup, token_files, whitening

#: Files of the public tokenizers that the two token queries use.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(common.table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(common.table(spark, sf_dir, "documents"), n=5, threshold=(4, 5))


#: A document counts as good from this score on.
GOOD = 0.7


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = common.table(spark, sf_dir, "documents"), common.crc_of_id(F.col("doc_id")) % 4
    model = quality_crf.train(docs, common.table(spark, sf_dir, "labels"), fold=fold != 2)
    scored = quality_crf.score(docs, model)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), window=13))
    items = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(common.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    token_files.write_tokens(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), 2, spaced=True)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, classes=line_dedup.CLASSES)
    return kept.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = common.table(spark, sf_dir, "documents"), common.crc_of_id(F.col("doc_id")) % 5
    model = langid.train(docs.where(fold != 0))
    return langid.predict(docs, model).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path(WORD_BPE), 1, length=2048, spaced=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents whose quality label is 1."""
    good = common.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("target", F.lit(True))
    docs = common.left_join(common.table(spark, sf_dir, "documents").select("doc_id", "text"), good, "doc_id")
    return lm_score.score_documents(docs, "target")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = {"output_sha256": F.col("output"), "restored_sha256": fill_middle.restored(F.col("output"), F.col("form"))}
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(c.cast("binary"), 256).alias(name) for name, c in digests.items()])


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pattern_packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 2, length=1024, spaced=True)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_fill_middle": op11_fill_middle,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_pattern_packing": op13_pattern_packing,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op5_quality_rules": rules.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
}
