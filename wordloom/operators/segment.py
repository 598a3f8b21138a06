"""Words cut into parts by a pluggable segmenter; each part has the frequency of its words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import clean_word


def segmented_words(words: DataFrame, segmenter: Callable[[str], list[str]]) -> DataFrame:
    """(lang, word, frequency): parts instead of words, added up and cleaned.

    Words of one character are not cut; blank parts are dropped; a word without parts stays.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [[p for p in segmenter(w) if p.strip()] or [w] if len(w) > 1 else [w] for w in batch["word"]]
            yield batch.assign(parts=parts)

    cut_words = words.select("lang", "word", "frequency").mapInPandas(cut, "lang string, word string, frequency bigint, parts array<string>")
    parts = cut_words.select("lang", F.explode("parts").alias("word"), "frequency")
    cleaned = parts.withColumn("word", clean_word(F.col("word"))).filter(F.col("word").isNotNull())
    return cleaned.groupBy("lang", "word").agg(F.sum("frequency").alias("frequency"))


def every_two(word: str) -> list[str]:
    """Parts of two characters."""
    return [word[i : i + 2] for i in range(0, len(word), 2)]
