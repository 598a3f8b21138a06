"""Quality scores of frequency lists; adding a check is one entry of ``CHECKS``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import ENGLISH_WORDS, SCRIPT_CODES, dominant_script, is_program, punct_signs


def fence(size: str, factor: float) -> Column:
    """Upper whisker of a box plot: Q3 + factor * (Q3 - Q1), quartiles interpolated."""
    q1, q3 = F.percentile(size, F.lit(0.25)), F.percentile(size, F.lit(0.75))
    return q3 + F.lit(factor) * (q3 - q1)


def _pct(condition: Column) -> Column:
    return F.lit(100.0) * F.count_if(condition) / F.count(F.lit(1))


def _bad() -> Column:
    return F.col("is_long") | F.col("is_foreign") | F.col("is_program")


#: Checks over flagged words (word, frequency, size, is_long, is_foreign, is_program) of one file.
CHECKS: dict[str, Callable[[], Column]] = {
    "foreign_script_pct": lambda: _pct(F.col("is_foreign")),
    "long_outlier_pct": lambda: _pct(F.col("is_long")),
    "punct_char_pct": lambda: F.coalesce(F.lit(100.0) * F.try_divide(F.sum(F.col("puncts") * F.col("frequency")), F.sum(F.col("size") * F.col("frequency"))), F.lit(0.0)),
    "program_pct": lambda: _pct(F.col("is_program")),
    "corrupted_pct": lambda: _pct(_bad()),
    "corrupted_freq_pct": lambda: F.lit(100.0) * F.sum(F.when(_bad(), F.col("frequency")).otherwise(0)) / F.sum("frequency"),
    "eng_stopwords": lambda: F.when(F.first("lang") == "eng", F.lit(0)).otherwise(F.count_distinct(F.when(F.lower("word").isin(*ENGLISH_WORDS), F.lower("word")))).cast("int"),
}


def word_marks(rows: DataFrame) -> DataFrame:
    """(word, size, puncts, found, is_program) of each distinct word; ``found`` is its script."""
    word = F.col("word")
    return rows.select("word").distinct().select(
        "word", F.length(word).alias("size"), punct_signs(word).alias("puncts"), dominant_script(word).alias("found"), is_program(word).alias("is_program")
    )


def flagged(rows: DataFrame, scripts: DataFrame) -> DataFrame:
    """Lines with the flags that the checks count. ``scripts``: (lang, script), the script expected of each language."""
    limits = rows.withColumn("size", F.length("word")).groupBy("file").agg(fence("size", 3.0).alias("long_threshold"))
    # words are judged once, however many lines hold them
    return (
        rows.join(word_marks(rows), "word")
        .join(scripts, "lang", "left")
        .join(limits, "file")
        .withColumn("is_long", F.col("size") > F.col("long_threshold"))
        .withColumn("is_foreign", F.coalesce((F.col("found") != F.col("script")) & (F.col("found") != "Common"), F.lit(False)))
    )


def top_words_long(rows: DataFrame, top: int = 20) -> DataFrame:
    """(file, top20_long_pct, top20_threshold): long words among a file's most frequent ones, by their own fence."""
    order = Window.partitionBy("file").orderBy(F.col("frequency").desc(), "ord", "word")
    best = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).withColumn("size", F.length("word"))
    limits = best.groupBy("file").agg(fence("size", 1.5).alias("top20_threshold"))
    return best.join(limits, "file").groupBy("file", "top20_threshold").agg(_pct(F.col("size") > F.col("top20_threshold")).alias("top20_long_pct"))


def quality(rows: DataFrame, scripts: DataFrame) -> DataFrame:
    """One row per file with all checks."""
    words = flagged(rows, scripts)
    scored = words.groupBy("file").agg(
        F.first("lang").alias("lang"),
        *(check().alias(name) for name, check in CHECKS.items()),
        F.first("long_threshold").alias("long_threshold"),
        F.count(F.lit(1)).alias("total_types"),
        F.sum("frequency").alias("total_frequency"),
    )
    return scored.join(top_words_long(rows), "file")


def with_empty(scored: DataFrame, files: DataFrame) -> DataFrame:
    """Scores of all files of a list; zero where a file has no usable line."""
    numbers = [f.name for f in scored.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
    return files.select("file").distinct().join(scored, "file", "left").na.fill(0, numbers)


def expected_scripts(segmented: DataFrame) -> DataFrame:
    """(lang, script) from file names that end in a script code; the first code by name where there are several."""
    names = F.create_map(*(F.lit(x) for pair in SCRIPT_CODES.items() for x in pair))
    code = F.regexp_extract("file", r"_([A-Z][a-z]{3})\.tsv$", 1)
    found = segmented.select(F.substring("file", 1, 3).alias("lang"), names[code].alias("script")).filter(F.col("script").isNotNull())
    return found.groupBy("lang").agg(F.min("script").alias("script"))
