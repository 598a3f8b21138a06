"""Lexical metrics of a frequency distribution; adding a metric is one entry of ``METRICS``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.frequency import ranked

def _f() -> Column:
    return F.col("f").cast("double")


def _c() -> Column:
    return F.col("c").cast("double")


def entropy(counts: Column) -> Column:
    """Entropy in bits of positive counts, in one pass: log2 T - sum(f log2 f) / T."""
    return F.log2(F.sum(counts)) - F.sum(counts * F.log2(counts)) / F.sum(counts)


#: Metrics over rows (key, f: frequency, c: records, size: characters).
METRICS: dict[str, Callable[[], Column]] = {
    "types": lambda: F.count(F.lit(1)),
    "tokens": lambda: F.sum("f"),
    "ttr": lambda: F.count(F.lit(1)) / F.sum(_f()),
    "hapax_count": lambda: F.count_if(F.col("c") == 1),
    "hapax_ratio": lambda: F.count_if(F.col("c") == 1) / F.count(F.lit(1)),
    "freq_hapax_count": lambda: F.count_if(F.col("f") == 1),
    "freq_hapax_ratio": lambda: F.count_if(F.col("f") == 1) / F.count(F.lit(1)),
    "mean_type_length": lambda: F.avg("size"),
    "mean_token_length": lambda: F.sum(F.col("size") * _f()) / F.sum(_f()),
    "entropy": lambda: entropy(_f()),
    "perplexity": lambda: F.pow(F.lit(2.0), entropy(_f())),
    "type_entropy": lambda: entropy(_c()),
    "type_perplexity": lambda: F.pow(F.lit(2.0), entropy(_c())),
}


def keyed_counts(rows: DataFrame, by: str, key: str, frequency: str = "frequency") -> DataFrame:
    """(by, key, f, c, size): summed frequency and number of records of each key."""
    return (
        rows.groupBy(by, key)
        .agg(F.sum(frequency).alias("f"), F.count(F.lit(1)).alias("c"))
        .withColumn("size", F.length(key))
    )


def metrics(counts: DataFrame, by: str, names: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """One row per group with the named metrics."""
    return counts.filter(F.col("f") > 0).groupBy(by).agg(*(METRICS[n]().alias(n) for n in names))


def zipf_slope(words: DataFrame) -> DataFrame:
    """(lang, zipf_slope): slope of log frequency on log rank; null for fewer than two words."""
    points = ranked(words).filter(F.col("frequency") > 0)
    return points.groupBy("lang").agg(
        F.when(F.count(F.lit(1)) > 1, F.regr_slope(F.log(F.col("frequency").cast("double")), F.log(F.col("rank").cast("double")))).alias("zipf_slope")
    )


def record_metrics(lines: DataFrame) -> DataFrame:
    """All metrics of each language; a record is a line of a file."""
    return metrics(keyed_counts(lines, "lang", "word"), "lang")
