"""Registered queries of the problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import cutoff, encoding_repair, format_copies, names, packing, plain_text, spans, terms, tokens
from wordloom.session import ship_package
from wordloom.sources import tables


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship_package(spark)  # the operators run Python in the executors
    return tables.table(spark, d, name)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = cutoff.line_cutoffs(table(spark, d, "raw_freq"), table(spark, d, "quality"), table(spark, d, "keep_targets"))
    return found.select("language", "cutoff", "kept")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.repaired_rows(table(spark, d, "raw_freq")).select("row_id")


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding_repair.repaired_rows(table(spark, d, "raw_freq"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    typed = names.typed_names(table(spark, d, "lepzig_shortcuts"), table(spark, d, "ud_language_mapping"))
    return names.match_names(typed, table(spark, d, "languages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).filter(F.col("iso_code").isNotNull()).select("tbl", "entry_id", "iso_code")


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return names.unmatched_names(_names(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return plain_text.disguised_rows(table(spark, d, "raw_freq"), table(spark, d, "segmented"))


def p4_plain(spark: SparkSession, d: str) -> DataFrame:
    return plain_text.plain_rows(table(spark, d, "raw_freq"), table(spark, d, "segmented"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "raw_freq")).filter(F.col("mark").isNotNull()).select("lang", "term", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "raw_freq"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.format_copies(table(spark, d, "raw_freq"), table(spark, d, "raw_lines"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.copy_counts(table(spark, d, "raw_freq"), table(spark, d, "raw_lines"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_characters(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_repaired, p3_found, p3_unmatched, p4_found, p4_plain, p5_found, p5_counts, p6_found, p6_counts, p7_ids, p8_containers, p9_found, p9_shared)}
