"""Metrics of segmented words: morphs, roots, affixes, compounding, affix balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import inline_form, roles
from wordloom.operators.metrics import entropy


def parsed(segmented: DataFrame) -> DataFrame:
    """(file, word, frequency, morphs, annotation) of the usable rows, each row of the list once."""
    usable = segmented.filter(
        F.col("word").isNotNull() & F.col("segmentation").isNotNull() & F.col("annotation").isNotNull() & (F.col("frequency") > 0)
    )
    return usable.select("file", "word", "frequency", "segmentation", "annotation").distinct().select(
        "file", "word", "frequency", F.split("segmentation", r"\+").alias("morphs"), F.split("annotation", r"\+").alias("annotation")
    )


def _count(role: str) -> Column:
    return F.size(F.filter("roles", lambda r: r == role)).cast("double")


def word_features(rows: DataFrame) -> DataFrame:
    """Per word its numbers of morphs, roots, affixes, prefixes and suffixes."""
    return (
        rows.withColumn("roles", roles(F.col("annotation")))
        .withColumn("n", F.size("morphs").cast("double"))
        .withColumn("roots", _count("root"))
        .withColumn("affixes", F.size(F.filter("annotation", lambda a: a == "A")).cast("double"))
        .withColumn("prefixes", _count("prefix"))
        .withColumn("suffixes", _count("suffix"))
    )


def _weighted(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.sum(value * F.col("frequency")) / F.sum(F.when(value.isNotNull(), F.col("frequency")))


def morph_metrics(rows: DataFrame) -> DataFrame:
    """One row per file: averages by word and by token, compounding index, affix deviation."""
    compounding = F.coalesce(F.try_divide(F.col("roots"), F.col("n")), F.lit(0.0))
    less = F.least("prefixes", "suffixes")
    deviation = F.when(less > 0, (F.col("suffixes") - F.col("prefixes")) / less)
    parts = ("n", "roots", "affixes", "prefixes", "suffixes")
    return word_features(rows).groupBy("file").agg(
        F.count(F.lit(1)).alias("words"),
        F.sum("frequency").alias("word_tokens"),
        F.sum(F.col("n") * F.col("frequency")).alias("morph_tokens"),
        *(F.avg(p).alias(f"avg_{'morphs' if p == 'n' else p}") for p in parts),
        *(_weighted(p).alias(f"weighted_{'morphs' if p == 'n' else p}") for p in parts),
        F.avg(compounding).alias("compounding_index"),
        _weighted(compounding).alias("weighted_compounding_index"),
        F.avg(deviation).alias("affix_deviation"),
        _weighted(deviation).alias("weighted_affix_deviation"),
    )


def role_metrics(rows: DataFrame) -> DataFrame:
    """(file, role, morphs, entropy, type_entropy) for roots, affixes, prefixes and suffixes; prefixes and suffixes are affixes too."""
    each = rows.withColumn("roles", roles(F.col("annotation"))).select(
        "file", "frequency", F.explode(F.arrays_zip("morphs", "roles", "annotation")).alias("m")
    )
    kinds = F.filter(
        F.array(
            F.when(F.col("m.annotation") == "R", "root"), F.when(F.col("m.annotation") == "A", "affix"),
            F.when(F.col("m.roles").isin("prefix", "suffix"), F.col("m.roles")),
        ),
        lambda k: k.isNotNull(),
    )
    counts = each.filter(F.col("m.morphs").isNotNull()).select("file", "frequency", F.col("m.morphs").alias("morph"), F.explode(kinds).alias("role"))
    keyed = counts.groupBy("file", "role", "morph").agg(F.sum("frequency").alias("f"), F.count(F.lit(1)).cast("double").alias("c"))
    return keyed.groupBy("file", "role").agg(F.count(F.lit(1)).alias("morphs"), entropy(F.col("f")).alias("entropy"), entropy(F.col("c")).alias("type_entropy"))


def inline_metrics(rows: DataFrame) -> DataFrame:
    """The averages of words in inline form ('un @break able'); a word without '@' is one root."""
    words = rows.select("file", "frequency", F.split(inline_form(F.col("morphs"), F.col("annotation")), r"\s+").alias("parts"))
    marks = F.filter(F.transform("parts", lambda m, i: F.when(m.startswith("@"), i)), lambda i: i.isNotNull())
    first, last, n = F.array_min(marks), F.array_max(marks), F.size(marks)
    none = n == 0
    features = {
        "roots": F.when(none, 1).otherwise(n),
        "prefixes": F.when(none, 0).otherwise(first),
        "suffixes": F.when(none, 0).otherwise(F.size("parts") - last - 1),
        "interfixes": F.when(none, 0).otherwise(last - first + 1 - n),
    }
    made = words.select("file", "frequency", *(c.cast("double").alias(k) for k, c in features.items()))
    return made.groupBy("file").agg(*(F.avg(k).alias(f"avg_{k}") for k in features), *(_weighted(k).alias(f"weighted_{k}") for k in features))
