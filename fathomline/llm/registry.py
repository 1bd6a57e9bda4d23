"""The queries of this subpackage, each over its whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomline.llm import conversation_repair, decontaminate, fingerprint, html_text, language_id, licenses, multi_index, ngram_join, packing, quality, sql, substring_dedup, warc, wavelet_rank
from fathomline.llm.frames import fold, read_table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(spark, read_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.scan(docs, bench))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edited(spark, read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(spark, read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = language_id.train(docs, learn=~held_out)
    named = language_id.predict(docs, model)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_bundles(warc.archive(spark, read_table(spark, sf_dir, "pages")), payloads=False)
    as_id = lambda c: F.when(c != "", c).cast("long")
    return records.select(as_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id(F.col("refers_to")).alias("refers_to"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, read_table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read_table(spark, sf_dir, "documents"), F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), learn=~held_out)
    return quality.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(spark, read_table(spark, sf_dir, "embeddings"), asks=F.col("id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(read_table(spark, sf_dir, "conversations"))
    return conversation_repair.digest(rows, conversation_repair.audit(rows))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = wavelet_rank.build(spark, read_table(spark, sf_dir, "documents"))
    return wavelet_rank.search(spark, index, read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_license_scan": op8_license_scan,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": sql.NGRAM_JOIN,
    "op2_benchmark_decontamination": sql.DECONTAMINATION,
    "op7_warc": sql.WARC,
    "op13_ranked_lexical_search": sql.RANKED,
}
