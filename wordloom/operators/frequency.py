"""Frequency lists: merging, spectrum, coverage, ranks, truncation.

Everything that needs the order of a language's words works on its spectrum (how many words have each
frequency), which has at most about sqrt(2 * tokens) rows, so no language is sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import clean_word, has_letter, ppm, stripped
from wordloom.session import checkpointed

# Coverage levels in per cent.
LEVELS = (
    50.0, 55.0, 60.0, 65.0, 70.0, 72.0, 74.0, 76.0, 78.0, 80.0, 81.0, 82.0, 83.0, 84.0, 85.0, 86.0, 87.0, 88.0, 89.0, 90.0,
    90.5, 91.0, 91.5, 92.0, 92.5, 93.0, 93.5, 94.0, 94.5, 95.0, 95.5, 96.0, 96.5, 97.0, 97.5, 98.0, 98.5, 99.0, 99.5, 100.0,
)


def lines(raw_freq: DataFrame) -> DataFrame:
    """(lang, file, ord, word, frequency): the distinct usable lines; a line delivered again counts once."""
    return (
        raw_freq.filter(F.col("word").isNotNull() & F.col("file").isNotNull() & (F.col("frequency") >= 1))
        .select("file", "ord", "word", "frequency")
        .distinct()
        .select(F.substring("file", 1, 3).alias("lang"), "file", "ord", "word", "frequency")
    )


def cleaned(rows: DataFrame) -> DataFrame:
    """Lines with a clean word in ``word``."""
    return rows.withColumn("word", clean_word(F.col("word"))).filter(F.col("word").isNotNull())


def merged(rows: DataFrame) -> DataFrame:
    """(lang, word, frequency): the words of all files of a language added up."""
    return cleaned(rows).groupBy("lang", "word").agg(F.sum("frequency").alias("frequency"))


def text_words(documents: DataFrame, by: str = "lang") -> DataFrame:
    """(by, word, frequency): clean words of texts split at white space."""
    words = documents.filter(F.col("text").isNotNull()).select(by, F.explode(F.split("text", r"\s+")).alias("word"))
    return words.withColumn("word", clean_word(F.col("word"))).filter(F.col("word").isNotNull()).groupBy(by, "word").agg(F.count(F.lit(1)).alias("frequency"))


def merge_report(rows: DataFrame) -> DataFrame:
    """Per file: tokens before and after cleaning, words, dropped words, signs stripped per token, words new to the language.

    Words of which nothing is left add no stripped signs, but count as tokens. A word is new in the
    first file (by name) of its language that has it.
    """
    word, left = clean_word(F.col("word")), F.length(stripped(F.col("word")))
    signs = F.when(left > 0, F.col("frequency") * (F.length("word") - left)).otherwise(0)
    per_file = rows.groupBy("lang", "file").agg(
        F.sum("frequency").alias("tokens_raw"),
        F.sum(F.when(word.isNotNull(), F.col("frequency")).otherwise(0)).alias("tokens_clean"),
        F.count_distinct("word").alias("types_raw"),
        (F.sum(signs) / F.sum("frequency")).alias("avg_stripped"),
    )
    pairs = cleaned(rows).select("lang", "file", "word").distinct()
    first = pairs.groupBy("lang", "word").agg(F.min("file").alias("first"))
    types = pairs.groupBy("lang", "file").agg(F.count(F.lit(1)).alias("types"))
    new = first.groupBy("lang", F.col("first").alias("file")).agg(F.count(F.lit(1)).alias("new_types"))
    return (
        per_file.join(types, ["lang", "file"], "left")
        .join(new, ["lang", "file"], "left")
        .na.fill(0, ["types", "new_types"])
        .withColumn("ignored", F.col("types_raw") - F.col("types"))
    )


def spectrum(words: DataFrame) -> DataFrame:
    """(lang, frequency, n): how many words of a language have each frequency."""
    return words.groupBy("lang", "frequency").agg(F.count(F.lit(1)).alias("n"))


def _falling() -> Window:
    return Window.partitionBy("lang").orderBy(F.col("frequency").desc()).rowsBetween(Window.unboundedPreceding, 0)


def cumulated(spec: DataFrame) -> DataFrame:
    """The spectrum with words and tokens down to each frequency and their totals."""
    tokens, whole = F.col("frequency") * F.col("n"), Window.partitionBy("lang")
    return (
        spec.withColumn("types_upto", F.sum("n").over(_falling()))
        .withColumn("tokens_upto", F.sum(tokens).over(_falling()))
        .withColumn("types", F.sum("n").over(whole))
        .withColumn("tokens", F.sum(tokens).over(whole))
    )


def totals(words: DataFrame) -> DataFrame:
    """(lang, types, tokens) with the usual frequency cutoffs: words and tokens of 100 and of 10 or more."""
    above = lambda least: (
        F.count_if(F.col("frequency") >= least).alias(f"freq{least}_types"),
        F.sum(F.when(F.col("frequency") >= least, F.col("frequency")).otherwise(0)).alias(f"freq{least}_tokens"),
    )
    return words.groupBy("lang").agg(F.count(F.lit(1)).alias("types"), F.sum("frequency").alias("tokens"), F.min("frequency").alias("least"), *above(100), *above(10))


def top_share(words: DataFrame, shares: tuple[int, ...] = (5, 30)) -> DataFrame:
    """(lang, share_pct, types, tokens) of the most frequent words; at least one word."""
    spec = cumulated(spectrum(words)).withColumn("share_pct", F.explode(F.array(*(F.lit(s) for s in shares))))
    keep = F.greatest(F.lit(1), F.floor(F.col("types") * F.col("share_pct") / 100)).cast("bigint")
    return _cut(spec.withColumn("keep", keep), "share_pct")


def _cut(spec: DataFrame, *by: str) -> DataFrame:
    """(lang, by, types, tokens) of the first ``keep`` words: whole frequencies and a part of one."""
    inside = F.least(F.col("n"), F.greatest(F.lit(0).cast("bigint"), F.col("keep") - (F.col("types_upto") - F.col("n"))))
    return spec.groupBy("lang", *by).agg(F.sum(inside).alias("types"), F.sum(inside * F.col("frequency")).alias("tokens"))


def coverage(words: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(lang, level, types, tokens): the shortest list of most frequent words that covers each level.

    One running sum over the spectrum serves all levels; inside the frequency that crosses a level
    the number of words is computed, not counted.
    """
    spec = cumulated(spectrum(words)).withColumn("level", F.explode(F.array(*(F.lit(p) for p in levels))))
    goal = F.col("tokens") * F.col("level") / 100
    before = F.col("tokens_upto") - F.col("frequency") * F.col("n")
    needed = F.col("types_upto") - F.col("n") + F.ceil((goal - before) / F.col("frequency"))
    crossing = spec.filter((before < goal) & ((F.col("tokens_upto") >= goal) | (F.col("tokens_upto") == F.col("tokens"))))
    first = crossing.groupBy("lang", "level").agg(F.min(F.least(needed, F.col("types"))).cast("bigint").alias("keep"))
    return _cut(spec.join(first, ["lang", "level"]), "level")


def wide_coverage(long: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """One row per language with a pair of columns for each level."""
    from wordloom.functions.text import coverage_column

    return long.groupBy("lang").agg(
        *(
            F.max(F.when(F.col("level") == level, F.col(what))).alias(f"{coverage_column(level)}_{what}")
            for level in levels
            for what in ("types", "tokens")
        )
    )


def ranked(words: DataFrame) -> DataFrame:
    """Words with ``rank`` by falling frequency, equal ones by word, and the tokens down to them.

    Ranks are counted inside groups of one frequency and first letters and offset by the groups
    before, so that neither a language nor a frequency is sorted in one task.
    """
    keyed = words.withColumn("head", F.substring("word", 1, 2))
    groups = keyed.groupBy("lang", "frequency", "head").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("frequency").desc(), "head")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("ranks_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "tokens_before", F.coalesce(F.sum(F.col("n") * F.col("frequency")).over(before), F.lit(0))
    )
    inner = F.row_number().over(Window.partitionBy("lang", "frequency", "head").orderBy("word"))
    return (
        keyed.withColumn("inner", inner)
        .join(offsets.drop("n"), ["lang", "frequency", "head"])
        .select("lang", "word", "frequency", (F.col("ranks_before") + F.col("inner")).alias("rank"), (F.col("tokens_before") + F.col("inner") * F.col("frequency")).alias("tokens_upto"))
    )


def cut_band(words: DataFrame, level: float = 94.0) -> DataFrame:
    """(lang, last, needed, tied, tokens): the frequency at which a level cuts a language, how many of its ``tied`` words are kept."""
    keep = coverage(words, (level,)).select("lang", F.col("types").alias("keep"))
    spec = cumulated(spectrum(words)).join(keep, "lang")
    return spec.filter((F.col("types_upto") - F.col("n") < F.col("keep")) & (F.col("keep") <= F.col("types_upto"))).select(
        "lang", F.col("frequency").alias("last"), (F.col("keep") - F.col("types_upto") + F.col("n")).alias("needed"), F.col("n").alias("tied"), "tokens"
    )


def tokens_at(words: DataFrame, *shares: float) -> DataFrame:
    """(lang, share, tokens_upto): tokens down to a rank that is a share of the words, between ranks interpolated.

    Inside a frequency the tokens grow evenly with the rank, so the spectrum is enough. Before the first rank its tokens hold.
    """
    spec = cumulated(spectrum(words)).withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    rank = F.greatest(F.lit(1.0), F.col("share") * F.col("types"))
    before = F.col("types_upto") - F.col("n")
    at = F.col("tokens_upto") - F.col("frequency") * F.col("n") + (rank - before) * F.col("frequency")
    return spec.filter((rank > before) & (rank <= F.col("types_upto"))).select("lang", "share", at.alias("tokens_upto"))


def truncated(words: DataFrame, level: float = 94.0, seed: int | None = None) -> DataFrame:
    """(lang, word, frequency, ppm): the most frequent words that cover a level.

    Of the words of the last frequency only as many are kept as needed: the first by word or, with a
    seed, a random choice that depends on word and seed alone. ppm is of the whole list.
    """
    words = checkpointed(words)  # for the spectrum, the band and the words themselves
    band = cut_band(words, level)
    order = F.col("word") if seed is None else F.md5(F.concat("word", F.lit(f":{seed}")))
    head = F.substring(order, 1, 2)
    above = words.join(band.drop("tied"), "lang").filter(F.col("frequency") >= F.col("last")).withColumn("order", order).withColumn("head", head)
    tied = above.filter(F.col("frequency") == F.col("last"))
    by_head = Window.partitionBy("lang").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tied.groupBy("lang", "head").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by_head), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("lang", "head").orderBy("order", "word"))
    chosen = tied.withColumn("place", place).join(offsets.drop("n"), ["lang", "head"]).filter(F.col("before") + F.col("place") <= F.col("needed"))
    columns = ["lang", "word", "frequency", ppm(F.col("frequency"), F.col("tokens")).alias("ppm")]
    return above.filter(F.col("frequency") > F.col("last")).select(*columns).unionByName(chosen.select(*columns))


def top_languages(words: DataFrame, n: int) -> DataFrame:
    """The n languages with the most tokens; equal ones by code."""
    return totals(words).select("lang", "tokens").orderBy(F.col("tokens").desc(), "lang").limit(n)


def chosen_languages(rows: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """Rows whose language, or its part before '_', is one of the codes."""
    wanted = [c.lower() for c in codes]
    return rows.filter(F.col("lang").isin(wanted) | F.split_part("lang", F.lit("_"), F.lit(1)).isin(wanted))


def bag_union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def hapax_words(rows: DataFrame) -> DataFrame:
    """(lang, file, word): words with a letter that a file lists with frequency 1, each once."""
    return rows.filter((F.col("frequency") == 1) & has_letter(F.col("word"))).select("lang", "file", "word").distinct()


def rounded(column: Column | str, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)
