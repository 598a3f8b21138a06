"""Problem 4: text that looks the same but is built of other characters.

Method. A quick check on whole columns (inside the JVM) leaves only texts with signs beyond their
language's letters and ASCII. In each of these the segments that are not stable under normalisation
(marks, variants of letters and signs, invisible signs, other blanks) are isolated with the starter
before them and the sign after them, normalised alone and spliced into the unchanged rest; runs of
letters that mix scripts are brought to the script of the list. A run that is all of another script
stays unless it only looks like the list's letters and its letter pairs are more usual there.

Edge cases: null texts are no cases; an empty table gives no rows; texts of any length are handled
sign by sign; rows of problem 2 are no cases; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.encoding_repair import judged_words, lang_of, split_usual, word_verdicts


def plain_rows(raw_freq: DataFrame, segmented: DataFrame) -> DataFrame:
    """(tbl, row_key, field, text, plain) of every text that is not in its plain spelling."""
    found, frame, verdicts = judged_words(raw_freq)
    words = raw_freq.filter(F.col("word").isNotNull() & F.col("file").isNotNull()).select(
        F.col("row_id").alias("row_key"), lang_of().alias("lang"), "word"
    )
    disguised = verdicts.filter("kind = 'disguised'")
    raw = split_usual(words, frame)[1].join(disguised, ["lang", "word"])
    raw = raw.select(F.lit("raw_freq").alias("tbl"), "row_key", F.lit("word").alias("field"), F.col("word").alias("text"), "fixed")
    texts = (
        segmented.filter(F.col("file").isNotNull())
        .select(F.col("seg_id").alias("row_key"), lang_of().alias("lang"), F.col("word").alias("a"), F.col("segmentation").alias("b"))
        .select("row_key", "lang", F.explode(F.create_map(F.lit("word"), "a", F.lit("segmentation"), "b")).alias("field", "text"))
        .filter(F.col("text").isNotNull())
    )
    odd_texts = split_usual(texts, frame, "text", capitals=False)[1]
    of_texts = word_verdicts(odd_texts.select("lang", F.col("text").alias("word")).distinct(), found).filter("kind = 'disguised'")
    seg = odd_texts.join(of_texts.withColumnRenamed("word", "text"), ["lang", "text"])
    seg = seg.select(F.lit("segmented").alias("tbl"), "row_key", "field", "text", "fixed")
    return raw.unionByName(seg).select("tbl", "row_key", "field", "text", F.col("fixed").alias("plain"))


def disguised_rows(raw_freq: DataFrame, segmented: DataFrame) -> DataFrame:
    """(tbl, row_key): each row once, however many of its texts are disguised."""
    rows = plain_rows(raw_freq, segmented).select("tbl", "row_key")
    # only a row of segmented can come up twice; its key is unique, so this is a small shuffle
    return rows.distinct()
