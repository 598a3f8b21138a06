"""Readers and writers of list files: frequency CSV, annotated CSV, segmented TSV, XML, CoNLL-U, ignore lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.text import clean_word


def _name() -> F.Column:
    return F.col("_metadata.file_name").alias("file")


def read_raw_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(lang, file, ord, word, frequency) of raw CSV files: rows before the header (first cell 'item' or 'word')
    and rows without a whole number are dropped; a byte order mark is taken off. ``ord`` is the row's place."""
    rows = (
        spark.read.schema("c0 string, c1 string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .csv(folder, pathGlobFilter="*.csv")
        .select(_name(), F.regexp_replace("c0", "^﻿", "").alias("word"), "c1", F.monotonically_increasing_id().alias("at"))
    )
    placed = rows.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("at")).cast("bigint"))
    header = placed.filter(F.lower(F.trim("word")).isin("item", "word")).groupBy("file").agg(F.min("ord").alias("header"))
    return (
        placed.join(header, "file")
        .filter(F.col("ord") > F.col("header"))
        .select(F.substring("file", 1, 3).alias("lang"), "file", "ord", "word", F.expr("try_cast(c1 AS BIGINT)").alias("frequency"))
        .filter(F.col("frequency").isNotNull() & F.col("word").isNotNull())
    )


def read_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(lang, word, frequency[, ppm]) of aggregated or annotated CSV files; lang is the file's stem."""
    rows = spark.read.option("header", True).csv(folder, pathGlobFilter="*.csv")
    ppm = F.expr("try_cast(ppm AS DOUBLE)") if "ppm" in rows.columns else F.lit(None).cast("double")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return rows.select(stem.alias("lang"), "word", F.expr("try_cast(frequency AS BIGINT)").alias("frequency"), ppm.alias("ppm")).filter("frequency is not null")


def read_segmented(spark: SparkSession, folder: str) -> DataFrame:
    """(file, word, frequency, segmentation, annotation) of TSV files."""
    rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(folder, pathGlobFilter="*.tsv")
    return rows.select(_name(), "word", F.expr("try_cast(frequency AS DOUBLE)").alias("frequency"), "segmentation", "annotation")


def read_ignored(spark: SparkSession, path: str) -> DataFrame:
    """(file) of a list with one name a line and '#' comments."""
    return spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("file")).filter("file <> ''")


def read_script_codes(spark: SparkSession, path: str) -> DataFrame:
    """(name, code) of a list parted by commas or semicolons, without its header."""
    cells = F.split("value", "[,;]")
    return spark.read.text(path).select(F.trim(cells[0]).alias("name"), F.trim(F.get(cells, F.lit(1))).alias("code")).filter("name not in ('', 'name')")


def read_conllu(spark: SparkSession, path: str, field: str = "form") -> DataFrame:
    """(file, word, frequency): clean words of the FORM or LEMMA column; comments and ranges are skipped."""
    cells = F.split("value", "\t")
    column = {"form": 1, "lemma": 2}[field]
    tokens = spark.read.text(path).select(_name(), cells.alias("c")).filter((F.size("c") == 10) & F.col("c")[0].rlike("^[0-9]+$"))
    words = tokens.select("file", clean_word(F.col("c")[column]).alias("word")).filter(F.col("word").isNotNull())
    return words.groupBy("file", "word").agg(F.count(F.lit(1)).alias("frequency"))


def read_xml_segments(spark: SparkSession, path: str, tag: str = "seg") -> DataFrame:
    """(file, text) of every element with the tag."""
    return spark.read.format("xml").option("rowTag", tag).schema("_VALUE string").load(path).select(_name(), F.col("_VALUE").alias("text"))


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) without reading contents."""
    rows = spark.read.format("binaryFile").load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def write_lists(words: DataFrame, folder: str) -> None:
    """One folder of CSV files per language, each sorted by falling frequency.

    A language is range-partitioned with its frequencies, so that a large one is written by many tasks.
    """
    ordered = words.repartitionByRange("lang", F.col("frequency").desc(), "word")
    ordered.sortWithinPartitions("lang", F.col("frequency").desc(), "word").write.partitionBy("lang").option("header", True).mode("overwrite").csv(folder)


def write_annotated(words: DataFrame, folder: str) -> None:
    """As ``write_lists``, with ppm to three places."""
    write_lists(words.withColumn("ppm", F.format_string("%.3f", "ppm")), folder)


def write_table(rows: DataFrame, folder: str, *order: str) -> None:
    """A result table as CSV, sorted."""
    rows.orderBy(*order).write.option("header", True).mode("overwrite").csv(folder)
